"""Operator 9: mixing sources to target weights.

Sources in code point order (null last) have the weights 3, 1, 2, repeating. Together they get 150 % of all words; no
source gets more than twice its own, and what it leaves is shared by weight among the rest. That level is found in closed
form from running sums over the sources. Within a source, documents stand in the order of a hash of their id. The place where a
source's budget ends is found by distributed prefix sums: totals of key ranges (the hash's first four digits) first, then the keys of
the one range in which the budget ends. Each document then knows its share from its own key: no rows are sorted in one task
and no document is shuffled with its text.

Defined results: a null or empty text has size 0 and is taken 0 times; null sources form one source. Rows that are equal in id
and size share a cut evenly, rounded down. An empty table gives no rows. Other columns are ignored by mix() and kept by mixed().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from granary.llm.common import documents, written

WORD = r"[^\x20\x09-\x0D]+"
SPACED_WORD = r"[\x20\x09-\x0D]*" + WORD
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
SEED = "mix-1"
#: Hex digits of the key that name a range: 65,536 ranges a source.
RANGE_DIGITS = 4


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def key_of(doc_id: Column, seed: str = SEED) -> Column:
    """Hash-random order of a document: 16 hex digits; a null id counts as an empty one."""
    return F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|" + seed))), 1, 16)


def sized(docs: DataFrame) -> DataFrame:
    rows = documents(docs, "doc_id", "source", "text")
    return rows.select("doc_id", "source", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id")).alias("key"))


def targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target, budget (whole words). totals: one row per source, so the windows hold sources, not documents."""
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = totals.withColumn("weight", weight)
    by_cap = W.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = by_cap.rowsBetween(W.unboundedPreceding, -1), by_cap.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rows = rows.select(
        "*",
        F.coalesce(F.sum("source_size").over(before), F.lit(0)).alias("s"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("w"),
        F.sum("source_size").over(everything).alias("total"),
    )
    level = (share * F.col("total") - most * F.col("s")) / F.col("w")
    stays = level * F.col("weight") <= most * F.col("source_size")
    rows = rows.withColumn("level", F.max(F.when(stays, level)).over(everything))
    target = F.least((most * F.col("source_size")).cast("double"), F.coalesce(F.col("level"), F.lit(0.0)) * F.col("weight"))
    return rows.select("source", "source_size", target.alias("target"), F.least(F.round(target).cast("bigint"), most * F.col("source_size")).alias("budget"))


def cuts(sizes: DataFrame, **options) -> DataFrame:
    """One row per source: source_size, target, epochs, and where the last, partial epoch ends.

    Before (cut_key, cut_size) documents are taken once more, from it on no more; the documents on it have cut_words words each.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(totals, **options)
    epochs = F.when(F.col("source_size") > 0, F.call_function("div", F.col("budget"), F.nullif(F.col("source_size"), F.lit(0)))).otherwise(F.lit(0))
    goal = goal.withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    goal = written(goal)
    part = F.substring("key", 1, RANGE_DIGITS)
    ranges = sizes.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words"))
    in_source = W.partitionBy("source").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(in_source), F.lit(0)))
    g, r = goal.alias("g"), ranges.alias("r")
    hit = r.join(g, F.col("r.source").eqNullSafe(F.col("g.source"))).filter((F.col("r.before") <= F.col("rest")) & (F.col("rest") < F.col("r.before") + F.col("words")))
    hit = written(hit.select(F.col("g.source").alias("source"), "part", "before", "rest"))
    h, k = hit.alias("h"), sizes.withColumn("part", part).alias("k")
    near = k.join(h, F.col("k.source").eqNullSafe(F.col("h.source")) & (F.col("k.part") == F.col("h.part")))
    keys = near.groupBy(F.col("h.source").alias("source"), F.col("h.before").alias("before"), F.col("h.rest").alias("rest"), F.col("k.key").alias("key"), F.col("k.size").alias("size")).agg(F.count("*").alias("copies"))
    in_part = W.partitionBy("source").orderBy("key", "size").rowsBetween(W.unboundedPreceding, -1)
    keys = keys.withColumn("left", F.col("rest") - F.col("before") - F.coalesce(F.sum(F.col("size") * F.col("copies")).over(in_part), F.lit(0)))
    ends = keys.filter((F.col("left") >= 0) & (F.col("left") < F.col("size") * F.col("copies")))
    ends = ends.select(F.col("source").alias("cut_source"), F.col("key").alias("cut_key"), F.col("size").alias("cut_size"), F.call_function("div", F.col("left"), F.col("copies")).alias("cut_words"))
    out = goal.join(ends, F.col("source").eqNullSafe(F.col("cut_source")), "left")
    return written(out.select(F.col("source").alias("goal_source"), "source_size", "target", "epochs", "cut_key", "cut_size", "cut_words"))


def taken_of() -> Column:
    """Words that a document of `size` and `key` is taken, beside the columns of cuts()."""
    earlier = (F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("size") < F.col("cut_size")))
    on = (F.col("key") == F.col("cut_key")) & (F.col("size") == F.col("cut_size"))
    more = F.when(earlier, F.col("size")).when(on, F.col("cut_words")).otherwise(F.lit(0))
    return (F.col("epochs") * F.col("size") + more).cast("bigint")


def mix(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, one row per row of docs.

    The cuts have a row per source; they are a small written table, so Spark broadcasts them while their size allows.
    """
    sizes = written(sized(docs))
    found = sizes.join(cuts(sizes, **options), F.col("source").eqNullSafe(F.col("goal_source")))
    return found.select("doc_id", "size", "source_size", "target", taken_of().alias("taken"), "source")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(SPACED_WORD), F.lit(0)), F.lit(1), n.cast("int")), "")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' rows repeated by whole epochs; where a source's budget ends, the words up to there."""
    sizes = written(sized(docs))
    cols = docs.columns
    rows = docs.select(
        F.struct(*[F.col(c) for c in cols]).alias("_row"), F.col("source").cast("string").alias("source"),
        size_of(F.col("text").cast("string")).alias("size"), key_of(F.col("doc_id").cast("bigint")).alias("key"),
    ).join(cuts(sizes, **options), F.col("source").eqNullSafe(F.col("goal_source")))
    rows = rows.withColumn("taken", taken_of()).filter("taken > 0")
    whole = F.call_function("div", F.col("taken"), F.col("size"))
    lengths = F.array_repeat(F.lit(-1).cast("bigint"), whole.cast("int"))
    rest = F.col("taken") - whole * F.col("size")
    lengths = F.concat(lengths, F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select("_row", F.explode(lengths).alias("_words"))

    whole_text, text = F.col("_words") < 0, F.col("_row.text").cast("string")
    rows = rows.withColumn("_text", F.when(whole_text, text).otherwise(first_words(text, F.col("_words"))))
    new = {"text": F.col("_text"), "n_chars": F.when(whole_text, F.col("_row.n_chars") if "n_chars" in cols else F.lit(None)).otherwise(F.length("_text"))}
    return rows.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("_row")[c].alias(c) for c in cols])


SQL = r"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
  substr(md5(coalesce(doc_id::VARCHAR, '') || '|mix-1'), 1, 16) AS key FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::BIGINT AS weight FROM t),
c AS (SELECT *, coalesce(sum(source_size) OVER b, 0)::DOUBLE AS s, (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS rw,
  (sum(source_size) OVER ())::DOUBLE AS total FROM w
  WINDOW b AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((1.5 * total - 2 * s) / rw) AS level FROM c),
g AS (SELECT source, source_size, least((2 * source_size)::DOUBLE, coalesce(level, 0) * weight) AS target FROM c, l),
e AS (SELECT *, least(round(target)::BIGINT, 2 * source_size) AS budget FROM g),
f AS (SELECT *, coalesce(budget // nullif(source_size, 0), 0) AS epochs, budget - coalesce(budget // nullif(source_size, 0), 0) * source_size AS rest FROM e),
k AS (SELECT source, key, size, count(*) AS copies FROM d GROUP BY ALL),
p AS (SELECT k.*, coalesce(sum(size * copies) OVER (PARTITION BY source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k)
SELECT d.doc_id, d.size, f.source_size, f.target, d.source,
  (f.epochs * d.size + CASE WHEN p.before + p.size * p.copies <= f.rest THEN d.size WHEN p.before < f.rest THEN (f.rest - p.before) // p.copies ELSE 0 END)::BIGINT AS taken
FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
JOIN p ON p.source IS NOT DISTINCT FROM d.source AND p.key = d.key AND p.size = d.size"""
