"""Pairing control and treatment arms, and what follows from pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairwell.functions import stats


def last_wins(rows: DataFrame, keys: list[str], pos: str = "pos") -> DataFrame:
    """One row per key, that of the greatest position. One aggregation with partial sums, no window."""
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), pos).alias("row"))
    return best.select(*keys, "row.*")


def repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that occur more than once, for arms that must not repeat an item."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def checked_unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, failing at run time if a key is repeated."""
    rest = [c for c in rows.columns if c not in keys]
    one = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.first(F.struct(*rest)).alias("row"))
    checked = F.when(F.col("n") > 1, F.raise_error(F.concat(F.lit("repeated keys: "), F.to_json(F.struct(*keys))))).otherwise(F.col("row"))
    return one.select(*keys, checked.alias("row")).select(*keys, "row.*")


def strict_pairs(treatment: DataFrame, control: DataFrame, key: str, name: str = "comparison") -> DataFrame:
    """key, t and c (structs) of the keys that both arms have. A repeated key fails the job and is named; without any
    common key the pairing is refused at once."""
    sides = []
    for side, rows in (("t", treatment), ("c", control)):
        rest = [c for c in rows.columns if c != key]
        sides.append(checked_unique(rows, [key]).select(key, F.struct(*rest).alias(side)))
    out = sides[0].join(sides[1], key)
    if out.isEmpty():
        raise ValueError(f"{name}: no shared keys")
    return out


def looked_up(rows: DataFrame, dimension: DataFrame, key: str, as_name: str = "found") -> DataFrame:
    """rows with the dimension's row of their key. A key that the dimension lacks or repeats fails the job and is named; null keys count as lacking."""
    rest = [c for c in dimension.columns if c != key]
    table = checked_unique(dimension, [key]).select(F.col(key).alias("__key"), F.struct(*rest).alias("__found"))
    both = rows.join(table, F.col(key) == F.col("__key"), "left")
    missing = F.raise_error(F.concat(F.lit("no row for key: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return both.select(*rows.columns, F.when(F.col("__found").isNull(), missing).otherwise(F.col("__found")).alias(as_name))


def with_answers(questions: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """questions with answer (a struct) or a reason: missing_ground_truth. An answer that is repeated fails the job and is named."""
    rest = [c for c in answers.columns if c != key]
    known = checked_unique(answers, [key]).select(F.col(key).alias("__key"), F.struct(*rest).alias("answer"))
    both = questions.join(known, F.col(key) == F.col("__key"), "left")
    return both.select(*questions.columns, "answer", F.when(F.col("answer").isNull(), "missing_ground_truth").alias("reason"))


def paired(rows: DataFrame, comparisons: list[tuple[str, str, str]], by: list[str], item: str = "item_id", condition: str = "condition") -> DataFrame:
    """Inner pairs of every declared comparison (name, treatment, control): by, item, comparison, t and c (structs).

    Rows are keyed once by item and pivoted to arms in the same aggregation, so any number of comparisons
    costs one shuffle and no self-join. Rows must be unique per item and condition; comparisons without
    common items give no rows.
    """
    rest = [c for c in rows.columns if c not in [*by, item, condition]]
    arms = sorted({x for _, t, c in comparisons for x in (t, c)})
    at = rows.filter(F.col(condition).isin(*arms)).groupBy(*by, item).agg(*[F.first(F.when(F.col(condition) == a, F.struct(*rest)), ignorenulls=True).alias(f"arm_{i}") for i, a in enumerate(arms)])
    sides = [F.struct(F.lit(n).alias("comparison"), F.col(f"arm_{arms.index(t)}").alias("t"), F.col(f"arm_{arms.index(c)}").alias("c")) for n, t, c in comparisons]
    return at.select(*by, item, F.explode(F.array(*sides)).alias("p")).select(*by, item, "p.*").filter("t is not null and c is not null")


def contingency(pairs: DataFrame, treatment: Column, control: Column, by: list[str]) -> DataFrame:
    """Two-by-two counts of every comparison, the difference, its exact interval and the exact McNemar p-value."""
    t, c = F.coalesce(treatment, F.lit(False)), F.coalesce(control, F.lit(False))
    out = pairs.groupBy(*by).agg(
        F.count("*").alias("pairs"),
        F.count_if(t & ~c).alias("treatment_only"),
        F.count_if(c & ~t).alias("control_only"),
        F.count_if(t & c).alias("both_correct"),
        F.count_if(~t & ~c).alias("both_wrong"),
    )
    return out.withColumns({"delta": (F.col("treatment_only") - F.col("control_only")) / F.col("pairs"), "mcnemar_p": stats.mcnemar(F.col("treatment_only"), F.col("control_only"))})


def with_exact_interval(counts: DataFrame) -> DataFrame:
    """counts of contingency() with the exact paired bootstrap interval; one small row a comparison."""
    return counts.withColumn("bootstrap", stats.exact_bootstrap("pairs", "treatment_only", "control_only"))


def ordered_mismatches(control: DataFrame, treatment: DataFrame, pos: str = "pos", item: str = "item_id") -> DataFrame:
    """Positions at which two arms do not hold the same item: a strict one-to-one pairing has none."""
    c = control.select(F.col(pos).alias("p"), F.col(item).alias("control_item"))
    t = treatment.select(F.col(pos).alias("q"), F.col(item).alias("treatment_item"))
    both = c.join(t, F.col("p") == F.col("q"), "full_outer")
    return both.filter(~F.col("control_item").eqNullSafe(F.col("treatment_item"))).select(F.coalesce("p", "q").alias(pos), "control_item", "treatment_item")


def subset_effects(control: DataFrame, treatment: DataFrame, success: str, subset: str = "subset", pos: str = "pos", item: str = "item") -> DataFrame:
    """Two arms by subset: rows, positions that do not hold one item in both arms, items that an arm repeats, pairs, and what the treatment repairs and breaks.

    A subset is paired strictly where mismatched and repeated are 0. Pairs are positions that hold the same item in both arms; a null success is none.
    """
    side = lambda rows: rows.select(F.col(subset).alias("subset"), F.col(pos).alias("pos"), F.col(item).alias("item"), F.coalesce(F.col(success), F.lit(False)).alias("ok"))
    arms = side(control).withColumn("arm", F.lit(0)).unionByName(side(treatment).withColumn("arm", F.lit(1)))
    here = lambda arm, name: F.max(F.when(F.col("arm") == arm, F.col(name)))
    at = arms.groupBy("subset", "pos").agg(here(0, "item").alias("c"), here(1, "item").alias("t"), here(0, "ok").alias("c_ok"), here(1, "ok").alias("t_ok"), F.count_if(F.col("arm") == 0).alias("c_n"), F.count_if(F.col("arm") == 1).alias("t_n"))
    same = F.coalesce(F.col("c") == F.col("t"), F.lit(False))
    found = at.groupBy("subset").agg(
        F.sum("c_n").alias("control_rows"),
        F.sum("t_n").alias("treatment_rows"),
        F.count_if(~same).alias("mismatched"),
        F.count_if(same).alias("pairs"),
        F.count_if(same & F.col("t_ok") & ~F.col("c_ok")).alias("repaired"),
        F.count_if(same & F.col("c_ok") & ~F.col("t_ok")).alias("broken"),
    )
    repeats = arms.groupBy(F.col("subset").alias("s"), "arm", "item").agg(F.count("*").alias("n")).filter("n > 1").groupBy("s").agg(F.count("*").alias("repeated"))
    return found.join(repeats, F.col("subset").eqNullSafe(F.col("s")), "left").drop("s").withColumn("repeated", F.coalesce("repeated", F.lit(0).cast("long")))


def transitions(pairs: DataFrame, treatment: Column, control: Column) -> DataFrame:
    """pairs with transition: 0 both wrong, 1 lost, 2 repaired, 3 both right."""
    t, c = F.coalesce(treatment, F.lit(False)), F.coalesce(control, F.lit(False))
    return pairs.withColumn("transition", F.when(t & c, 3).when(t, 2).when(c, 1).otherwise(0))


def field_differences(left: DataFrame, right: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """A row for every field in which two versions of a row differ, null-safe; values as text."""
    both = left.select(*keys, F.struct(*fields).alias("l")).join(right.select(*keys, F.struct(*fields).alias("r")), keys)
    cells = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"l.{f}").cast("string").alias("stored"), F.col(f"r.{f}").cast("string").alias("replayed")) for f in fields])
    return both.select(*keys, F.explode(cells).alias("x")).select(*keys, "x.*").filter(~F.col("stored").eqNullSafe(F.col("replayed")))


def field_agreement(differences: DataFrame, pairs: DataFrame, fields: list[str], item: str) -> DataFrame:
    """Per field the pairs that agree and those that do not, fields without a difference included."""
    named = pairs.agg(F.count("*").alias("pairs")).select("pairs", F.explode(F.array(*map(F.lit, fields))).alias("field"))
    counts = differences.groupBy("field").agg(F.count("*").alias("differing"), F.min(item).alias("first_item"))
    differing = F.coalesce("differing", F.lit(0))
    return named.join(counts, "field", "left").select("field", (F.col("pairs") - differing).alias("agreeing"), differing.alias("differing"), "first_item")
