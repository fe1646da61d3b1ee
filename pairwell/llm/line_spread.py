"""Line dedup by distinct-site spread, in DataFrame functions only.

A line is boilerplate if it stands on min_sites distinct sites or more. Each line hash gets a HyperLogLog
sketch of its sites, built per task and merged by aggregation. Where the estimate lies within band of the
threshold, the line's distinct sites are counted exactly. Only hashes and positions are written and shuffled for
this; a text is rebuilt once, and only the positions to drop are joined to it. Only texts that a table of key bits
marks as losing lines are shuffled; the others pass by.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairwell.llm.common import bits_of, cut, text_key, with_bit, without, written

MIN_SITES = 5
#: Sketches have 2**LOG_BUCKETS buckets: a standard error of about 1.6 %.
LOG_BUCKETS = 12
#: Share of the threshold on either side within which sites are counted exactly, about 15 standard errors.
BAND = 0.25
RESULT = ["n_lines", "n_removed", "clean_text"]


def lines(docs: DataFrame, site: str) -> DataFrame:
    """Every line that is not blank: text key, position, site and two hashes of the trimmed line."""
    trimmed = F.transform(F.split("text", "\n", -1), lambda x: F.btrim(x, F.lit(" \t\r")))
    # the key in a projection of its own: next to posexplode it would be computed again for every line
    rows = docs.filter(F.col("text").isNotNull()).select(text_key().alias("tkey"), F.col(f"`{site}`").alias("site"), trimmed.alias("lines"))
    rows = rows.select("tkey", "site", F.posexplode("lines").alias("pos", "line"))
    return rows.filter("line <> ''").select("tkey", "site", "pos", F.xxhash64("line").alias("h"), F.hash("line").alias("g"))


def spread_lines(each: DataFrame, min_sites: int, band: float) -> DataFrame:
    """Hashes (h, g) of the lines that stand on min_sites distinct sites or more; a null site is none."""
    sites = each.filter(F.col("site").isNotNull()).select("h", "g", F.col("site").cast("string").alias("site"))
    sketches = sites.groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_BUCKETS))).alias("estimate"))
    # cut here and below, so that joins read plain shuffles and Spark can split the one of a very common line
    wide = cut(sketches.filter(F.col("estimate") >= min_sites * (1 - band)))
    sure = wide.filter(F.col("estimate") > min_sites * (1 + band)).select("h", "g")
    near = wide.filter(F.col("estimate") <= min_sites * (1 + band)).select("h", "g")
    # distinct first: it keeps a row a site of a line in every task, before any line's rows meet
    exact = sites.distinct().join(near, ["h", "g"], "left_semi").groupBy("h", "g").agg(F.count("*").alias("n")).filter(F.col("n") >= min_sites)
    return cut(sure.unionByName(exact.select("h", "g")))


def remove_spread_lines(docs: DataFrame, site: str = "source", min_sites: int = MIN_SITES, band: float = BAND) -> DataFrame:
    """docs with n_lines (lines that are not blank), n_removed and clean_text (the text without boilerplate lines).

    Lines are compared without blanks and tabs at their ends; blank lines are kept and never counted. A null
    text has no lines and stays null; a document that loses all its lines has the empty text. Rows with a
    null site keep their lines, which add no site, but lose boilerplate too. Repeated rows and copies on
    one site add one site. A very long text is rebuilt in time that grows with its lines. An empty table gives an
    empty result. Input columns named as a result column give way to it.
    """
    docs = without(docs, RESULT)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    each = written(lines(docs, site))  # a tenth of the text: counted twice and joined once, split and hashed once
    spread = spread_lines(each, min_sites, band)
    drops = each.select("tkey", "pos", "h", "g").join(spread, ["h", "g"]).groupBy("tkey").agg(F.collect_set("pos").alias("gone"))
    drops = cut(drops)  # as above, for a text with very many copies
    marked = with_bit(docs.select(row, text_key().alias("key")), cut(bits_of(drops)), "key", "loses")
    rows = marked.filter("loses").join(drops, F.col("key") == F.col("tkey"), "left").select("row", "gone")
    rows = rows.unionByName(marked.filter("not loses").select("row", F.lit(None).cast("array<int>").alias("gone")))
    text = F.col("row.text")
    parts = F.split(text, "\n", -1)
    # positions to keep by one hashed difference, then each line by its position; the lines are bound to a variable,
    # as an expression would be split anew for each of them
    stay = lambda p: F.array_except(F.sequence(F.lit(0), F.size(p) - 1), "gone")
    clean = F.get(F.transform(F.array(parts), lambda p: F.array_join(F.transform(stay(p), lambda i: F.get(p, i)), "\n")), F.lit(0))
    full = F.size(F.filter(parts, lambda x: F.btrim(x, F.lit(" \t\r")) != ""))
    return rows.select(
        "row.*",
        F.when(text.isNull(), 0).otherwise(full).cast("long").alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), text).otherwise(clean).alias("clean_text"),
    )
