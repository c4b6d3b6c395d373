"""Operator 2: exact top-k search over binary codes by incremental multi-index hashing.

A code is the signs of a vector, cut into segments about as long as the logarithm of the number of codes. One table has a row for
each segment of each code; a cell is a segment and its value. The search goes by rounds: in round a each open query asks for the cells whose value differs
from its own in just a bits, and codes met there for the first time are verified: met first means that no segment is nearer than a, and none
before this one as near, which the two codes alone tell. By the pigeonhole principle all codes within Hamming distance
segments * (a + 1) - 1 have then been met, so a query is done when its k-th verified distance is within this radius; codes at equal
distance are all known then, and the smaller id wins. Only the open queries go on to the next round.

Rounds are joins by cell; verification counts bits in the JVM; each query keeps its k best rows, which Spark limits before it shuffles. Equal codes are one
entry with their k smallest ids, which is all that a top-k can need, so a code that a third of all rows share costs as much as any.

Defined results: null vectors have no code: they are never found and find nothing; a vector of another length is an error, since its signs can't be
compared, unless `skip_other_lengths`: then it is like a null. A null or NaN value
has the bit 0. A query finds itself, too, if it is among the rows. Fewer than k rows give fewer results; repeated rows are found
once each. Null ids are never queries and come first among ties. Other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from granary.llm.common import discard, map_batches, written

BITS = 64


def codes(vectors: DataFrame, bits: int = BITS, skip_other_lengths: bool = False) -> DataFrame:
    """vec_id and code (the signs of the embedding, as a long) of the rows that have one."""

    def rows(batch) -> dict:
        x = np.array(batch["embedding"].flatten().fill_null(0.0).to_numpy(zero_copy_only=False), np.float32).reshape(-1, bits)
        packed = np.packbits(x > 0, axis=1, bitorder="little")
        wide = np.zeros((len(x), 8), np.uint8)
        wide[:, : packed.shape[1]] = packed
        return {"vec_id": batch["vec_id"], "code": wide.reshape(-1).view(np.int64)}

    if not 0 < bits <= 64:
        raise ValueError("codes have 1 to 64 bits")
    found = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))
    fits = F.size("embedding") == bits
    if not skip_other_lengths:
        fits = F.when(fits, True).otherwise(F.raise_error(F.concat(F.lit(f"an embedding hasn't {bits} values: "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null")))).cast("boolean"))
    return map_batches(found.filter(F.col("embedding").isNotNull()).filter(fits), "vec_id long, code long", rows)


class Segments:
    """How codes are cut: `parts` segments of `width` bits, the last maybe shorter. A cell holds about four codes, so asking and verifying cost about the same."""

    def __init__(self, n_codes: int, bits: int = BITS):
        self.parts = max(1, round(bits / max(4, min(20, max(2, n_codes).bit_length() - 3))))
        self.width = -(-bits // self.parts)
        self.parts = -(-bits // self.width)
        self.widths = [min(self.width, bits - b * self.width) for b in range(self.parts)]

    def value(self, code: Column, b: int) -> Column:
        return F.shiftrightunsigned(code, b * self.width).bitwiseAND(F.lit((1 << self.widths[b]) - 1))

    def cells(self, code: str) -> Column:
        """The cell of each segment of a code."""
        return F.array(*[self.value(F.col(code), b) + F.lit(b << self.width) for b in range(self.parts)])

    def asked(self, code: str, a: int) -> Column:
        """Cells at distance a of each segment."""

        def flip(own: Column, b: int):
            return lambda x: own.bitwiseXOR(x) + F.lit(b << self.width)

        asked = []
        for b, width in enumerate(self.widths):
            flips = ",".join(str(sum(1 << i for i in c)) for c in combinations(range(width), a))
            if flips:
                asked.append(F.transform(F.split(F.lit(flips), ",").cast("array<bigint>"), flip(self.value(F.col(code), b), b)))
        return F.flatten(F.array(*asked))

    def met_first(self, a: int, cell: str, x: str, y: str) -> Column:
        """Whether the codes x and y, which meet in a cell at distance a, have no nearer segment, and none before this one as near."""
        b = F.shiftrightunsigned(cell, self.width)
        apart = F.col(x).bitwiseXOR(F.col(y))
        tests = [F.bit_count(self.value(apart, i)) >= a + F.when(b > i, 1).otherwise(0) for i in range(self.parts)]
        return reduce(Column.__and__, tests)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, bits: int = BITS, skip_other_lengths: bool = False, with_search: bool = False) -> DataFrame:
    """query_id, rank (from 1), neighbor_id and distance. queries: rows like vectors.

    On request also radius (the distance up to which the query has met all codes) and verified (how many codes were compared with it).
    """
    every = codes(vectors, bits, skip_other_lengths)
    by_code = W.partitionBy("code").orderBy(F.col("vec_id").asc_nulls_first())
    first = every.withColumn("place", F.row_number().over(by_code)).filter(F.col("place") <= k)
    entries = written(first.groupBy("code").agg(F.sort_array(F.collect_list(F.struct(F.col("vec_id")))).alias("ids")))
    n = entries.count()
    cut = Segments(n, bits)
    table = written(entries.select(F.explode(cut.cells("code")).alias("cell"), "code", F.col("ids.vec_id").alias("ids")))
    discard(entries)
    asked = written(codes(queries, bits, skip_other_lengths).filter(F.col("vec_id").isNotNull()))
    open_ = written(asked.select(F.col("code").alias("query"), F.lit(0).cast("long").alias("verified"), F.lit(None).cast("array<struct<distance:int,id:bigint>>").alias("best")).distinct())
    ended, width = [], max(cut.widths)
    order = ["distance", F.col("id").asc_nulls_first()]
    for a in range(width + 1):
        probes = open_.select("query", F.explode(cut.asked("query", a)).alias("cell"))
        # a merge join, whatever Spark takes the exploded queries' size for; it splits cells that many codes share
        met = probes.join(table.hint("merge"), "cell").filter(cut.met_first(a, "cell", "query", "code"))
        met = met.select("query", F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).alias("distance"), "ids")
        counts = met.groupBy("query").agg(F.count("*").alias("more"))
        rows = met.select("query", "distance", F.explode("ids").alias("id")).unionByName(open_.select("query", F.inline("best")))
        best = rows.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("place") <= k)
        best = best.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("place", "distance", "id"))).alias("x"))
        best = best.select("query", F.transform("x", lambda r: F.struct(r["distance"].alias("distance"), r["id"].alias("id"))).alias("best"))
        state = open_.select("query", "verified").join(best, "query", "left").join(counts, "query", "left")
        state = state.select("query", (F.col("verified") + F.coalesce("more", F.lit(0))).alias("verified"), "best")
        radius = cut.parts * (a + 1) - 1
        done = (F.coalesce(F.size("best"), F.lit(0)) >= k) & (F.element_at("best", -1)["distance"] <= radius) if a < width else F.lit(True)
        state = written(state.withColumn("done", F.coalesce(done, F.lit(False))).withColumn("radius", F.lit(min(radius, bits))))
        ended.append(state.filter("done").drop("done"))
        open_ = state.filter("not done").select("query", "verified", "best")
        if open_.isEmpty():
            break
    found = reduce(DataFrame.unionByName, ended)
    out = asked.join(found, asked["code"] == found["query"]).select(F.col("vec_id").alias("query_id"), F.posexplode("best").alias("rank", "b"), "radius", "verified")
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("b.id").alias("neighbor_id"), "b.distance", *["radius", "verified"] * with_search)


SQL = """WITH p AS (SELECT q.vec_id AS query_id, e.vec_id AS neighbor_id,
  list_sum(list_transform(range(1, 65), lambda i: ((q.embedding[i] > 0) <> (e.embedding[i] > 0))::INTEGER))::INTEGER AS distance
  FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10"""
