"""Mixing sources to target weights along a time-varying curriculum.

Each source has a weight schedule over training time 0..1, linear between knots. Its integral is the
source's cumulative token demand; inverting it turns the place of a document's words in the source's token
line into a time, and the share of all words that all sources have demanded by then is the training position: so
positions are spread evenly over the words trained, and at each the sources stand in the ratio of their weights
then. Documents are range-sorted by position. Targets are the schedules' total
integrals, stopped at max_repeats times the source's size with the excess reshared.

A source's token line runs over its documents in hash order, epoch after epoch, equal rows one after another. Its
running sum is taken in three steps, over spans of cells, over cells of about CELL_ROWS keys and within each, so no
task holds a source. Only sums of all sources reach the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairwell.llm.common import cut, written

MAX_REPEATS = 3
#: Rows of a cell; every cell is one window of a task.
CELL_ROWS = 512
#: Weights of the sources in code point order, repeating.
CYCLE = (5.0, 2.0, 1.0)
#: How a source's share moves over training, as (time, factor) knots, repeating as the weights do: heavy sources fade, light ones rise.
SCHEDULES = (((0.0, 1.4), (0.5, 1.0), (1.0, 0.6)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def word_count(text: str = "text") -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """sources with rank from 0 by code point, null last. One row a source: the table of sources fits one task."""
    return sources.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)


def targeted(sources: DataFrame, repeats: float) -> DataFrame:
    """sources (source_size, weight) with target: the total shared by weight, none above repeats times its size.

    A source stays below its cap exactly if cap / weight exceeds the level; the level rises round by round
    as capped sources give up their excess, and each round is one aggregate.
    """
    cap = F.col("source_size") * F.lit(float(repeats))
    level, before = 0.0, -1
    while True:
        full = F.col("weight") * level >= cap
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("weight"),
            F.count_if(full).alias("n"),
        ).first()
        if row.n == before or not row.weight:
            return sources.withColumn("target", F.least(F.col("weight") * level, cap) if row.weight else cap)
        before, level = row.n, (row.total - row.held) / row.weight


def integral(t: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The share of a schedule's whole integral that lies before a time of 0 to 1."""
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False))
    out = F.lit(0.0)
    for a, b in zip(knots, knots[1:], strict=False):
        x = F.greatest(F.least(t, F.lit(b[0])) - a[0], F.lit(0.0))
        out = out + x * (a[1] + x * ((b[1] - a[1]) / (b[0] - a[0]) / 2))
    return out / whole


def inverse(u: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of a schedule (linear between knots) reaches the share u of its whole.

    Beyond 1 time goes on as u does: documents that the mix does not reach lie behind its end.
    """
    areas = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:], strict=False)]
    whole, out, done = sum(areas), u, 0.0
    steps = []
    for (a, b), area in zip(zip(knots, knots[1:], strict=False), areas, strict=True):
        rest = u * whole - done
        slope = (b[1] - a[1]) / (b[0] - a[0])
        if abs(slope) < 1e-12:
            t = F.lit(a[0]) + rest / a[1]
        else:  # a[1] x + slope x^2 / 2 = rest
            t = F.lit(a[0]) + (F.sqrt(F.greatest(F.lit(a[1] ** 2) + 2 * slope * rest, F.lit(0.0))) - a[1]) / slope
        done += area
        steps.append((done / whole, t))
    for bound, t in reversed(steps):
        out = F.when(u <= bound, t).otherwise(out)
    return out


#: Cells whose sums one window adds up.
CELL_SPAN = 4096


def _before(sums: DataFrame) -> DataFrame:
    """sums (source, cell, cell_size) with before: the sizes of the source's cells before each, added up in two levels."""
    span = F.floor(F.col("cell") / CELL_SPAN).alias("span")
    spans = sums.groupBy("source", span).agg(F.sum("cell_size").alias("n"))
    first = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(F.col("source").alias("s"), F.col("span").alias("p"), F.coalesce(F.sum("n").over(first), F.lit(0)).alias("base"))
    inner = Window.partitionBy("source", "span").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = sums.select("source", "cell", span, "cell_size").withColumn("inner", F.coalesce(F.sum("cell_size").over(inner), F.lit(0)))
    both = cells.join(spans, F.col("source").eqNullSafe(F.col("s")) & (F.col("span") == F.col("p")))
    return both.select("source", "cell", (F.col("base") + F.col("inner")).alias("before"))


KEY = ["doc_id", "source", "size"]


def _numbered(rows: DataFrame) -> DataFrame:
    """rows (KEY, n, tag) with nth: the number from 0 of a row among the n rows of its key.

    Rows of one key are counted in each partition that tags were made in, so no window holds more of them than such a partition.
    """
    part = F.shiftrightunsigned("tag", 33)
    many = cut(rows.filter("n > 1").withColumn("part", part))
    per = many.groupBy(*KEY, "part").agg(F.count("*").alias("here"))
    earlier = Window.partitionBy(*KEY).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*(F.col(c).alias(f"k_{c}") for c in KEY), F.col("part").alias("k_part"), F.coalesce(F.sum("here").over(earlier), F.lit(0)).alias("skip"))
    local = F.row_number().over(Window.partitionBy(*KEY, "part").orderBy("tag")) - 1
    match = F.col("part") == F.col("k_part")
    for c in KEY:
        match = match & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    nth = many.withColumn("local", local).join(per, match).select(*rows.columns, (F.col("skip") + F.col("local")).alias("nth"))
    return rows.filter("n = 1").withColumn("nth", F.lit(0).cast("long")).unionByName(nth)


def curriculum(docs: DataFrame, weight: Callable[[Column], Column] | None = None, schedules: tuple = SCHEDULES, repeats: int = MAX_REPEATS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, source, size (words), source_size, target, taken (words the mix takes), copies (whole
    documents it takes), position (share of all words trained before the first copy, above 1 if none) and positions
    (of all copies).

    Every document is a row; taken is at most repeats times its size, and each source's taken words add up
    to its target, rounded: the last document of a source is taken in part (copies counts it if half of it
    or more is taken). Null and empty texts have size 0 and nothing taken. A null source is a source of its
    own, the last one. Repeated rows count each, one after another; ties go by hash, id and size, so reruns agree. A text of any
    length is counted whole. An empty table gives an empty result. Further columns are not used. The table of
    sources (a row each) is ranked in one task.
    """
    return planned(docs.select("doc_id", "source", word_count().alias("size"), F.monotonically_increasing_id().alias("tag")), weight, schedules, repeats, cell_rows).drop("tag")


def planned(sized: DataFrame, weight: Callable[[Column], Column] | None = None, schedules: tuple = SCHEDULES, repeats: int = MAX_REPEATS, cell_rows: int = CELL_ROWS) -> DataFrame:
    """The columns of curriculum() with tag, of rows (doc_id, source, size and a tag of their own, partition << 33 | number).

    Rows of equal id, source and size are placed as one key, counted before they move; each then has its own place
    within the key. So cells hold keys, and no cell grows with a row's repetitions.
    """
    sized = cut(sized.select(*KEY, "tag"))
    keys = cut(sized.groupBy(*KEY).agg(F.count("*").alias("n")))
    cells = max(64, -(-keys.count() // cell_rows))
    keys = keys.select(*KEY, "n", F.xxhash64("doc_id", "size").alias("h"))
    cell = F.floor((F.shiftrightunsigned("h", 1) / float(1 << 63)) * cells).cast("long")
    keys = keys.withColumn("cell", F.least(cell, F.lit(cells - 1)))
    whole = F.col("size") * F.col("n")
    sums = cut(keys.groupBy("source", "cell").agg(F.sum(whole).alias("cell_size")))
    sources = sums.groupBy("source").agg(F.sum("cell_size").alias("source_size"))
    if weight is None:
        weight = lambda rank: F.element_at(F.array(*map(F.lit, CYCLE)), (rank % len(CYCLE) + 1).cast("int"))
    sources = cut(ranked(sources).withColumn("weight", weight(F.col("rank"))))
    sources = targeted(sources, repeats)
    kind = (F.col("rank") % len(schedules)).cast("int")
    shares = {r.kind: r.n or 0.0 for r in sources.groupBy(kind.alias("kind")).agg(F.sum("target").alias("n")).collect()}
    total = sum(shares.values())
    own = F.struct("rank", "source_size", "target")
    offsets = _before(sums).join(sources.select(F.col("source").alias("s"), own.alias("own")), F.col("source").eqNullSafe(F.col("s")))
    offsets = offsets.select(F.col("source").alias("s"), F.col("cell").alias("c"), "before", "own")
    within = Window.partitionBy("source", "cell").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    line = keys.withColumn("inner", F.coalesce(F.sum(whole).over(within), F.lit(0)))
    line = line.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("cell") == F.col("c")))
    line = cut(line.select(*(F.col(c).alias(f"k_{c}") for c in KEY), "n", "own", (F.col("before") + F.col("inner")).alias("start")))
    match = F.col("size") == F.col("k_size")
    for c in KEY[:2]:
        match = match & F.col(c).eqNullSafe(F.col(f"k_{c}"))
    # two plain shuffles, so that Spark can split the one of a key with many rows
    rows = _numbered(cut(sized.join(line, match).select(*KEY, "tag", "n", "own", "start")))
    line = rows.select(*KEY, "tag", "own.*", (F.col("start") + F.col("nth") * F.col("size")).alias("start"))
    goal = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(goal / F.col("source_size"))).otherwise(0).cast("long")
    line = line.withColumns({"epochs": epochs, "part": F.greatest(F.lit(0), F.least(F.col("size"), goal - epochs * F.col("source_size") - F.col("start")))})
    copies = F.col("epochs") + F.when((F.col("size") > 0) & (2 * F.col("part") >= F.col("size")), 1).otherwise(0)
    missed = (F.col("epochs") == 0) & (F.col("part") == 0)

    def share(k: Column) -> Column:
        """The share of its source's demand at which the middle of the k-th copy's words lies."""
        u = (k * F.col("source_size") + F.col("start") + F.col("size") / 2) / F.greatest(F.col("target"), F.lit(1.0))
        return F.when(missed, F.greatest(u, F.lit(1.0)) + 1e-9).otherwise(F.least(u, F.lit(1.0)))

    def moment(u: Column) -> Column:
        """The time of a share, by the schedule of the source."""
        out = u
        for i, knots in enumerate(schedules):
            out = F.when(F.col("rank") % len(schedules) == i, inverse(u, knots)).otherwise(out)
        return out

    def place(t: Column) -> Column:
        """The training position at a time."""
        trained = sum((integral(t, knots) * (shares.get(i, 0.0) / total) for i, knots in enumerate(schedules)), F.lit(0.0)) if total else t
        return F.when(missed, t).otherwise(F.least(trained, F.lit(1.0)))

    # step by step: one expression of all three, in which each holds the one before many times over, is costly to plan and to compile
    line = line.withColumn("copies", copies)
    kth = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("copies"), F.lit(1)) - 1)
    line = line.withColumn("positions", F.transform(F.transform(F.transform(kth, share), moment), place))
    return line.select(
        "doc_id",
        "source",
        "size",
        "tag",
        "source_size",
        "target",
        (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"),
        "copies",
        F.get("positions", F.lit(0)).alias("position"),
        "positions",
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The rows of docs as the mix takes them: each as often as it has copies, sorted by training position.

    Every row has a decision of its own, rows of equal id, source and size too. Null and empty texts are taken
    not at all. An empty table gives an empty result.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = written(docs.select(whole.alias("row"), "doc_id", "source", word_count().alias("size"), F.monotonically_increasing_id().alias("tag")))
    plan = planned(rows.select(*KEY, "tag")).filter("copies > 0")
    plan = cut(plan.select(F.col("tag").alias("t"), F.slice("positions", 1, F.col("copies").cast("int")).alias("places")))
    taken = rows.join(plan, F.col("tag") == F.col("t")).select("row", "doc_id", F.explode("places").alias("place"))
    return taken.orderBy("place", "doc_id").select("row.*")
