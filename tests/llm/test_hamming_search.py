import numpy as np
import pytest

from granary.llm import hamming_search
from tests.llm import fixtures

SCHEMA = "vec_id long, embedding array<float>, label int, code string, rank int"


def vectors(spark, rng):
    centres = rng.normal(size=(5, 64))
    rows = [(i, (centres[i % 5] + rng.normal(size=64) * (0.05 if i % 2 else 1)).tolist(), 0, "c", 1) for i in range(400)]
    rows += [(1000 + i, rows[3][1], 0, "c", 1) for i in range(40)]
    rows += [(2000, None, 0, "c", 1), (2001, [1.0], 0, "c", 1), (None, rows[3][1], 0, "c", 1), (2002, [float("nan"), None] * 32, 0, "c", 1)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(rows, queries, k):
    bits = [(i, [x is not None and x == x and x > 0 for x in e]) for i, e in rows if e is not None and len(e) == 64]
    out = []
    for q, e in queries:
        if q is None or e is None or len(e) != 64:
            continue
        own = [x is not None and x == x and x > 0 for x in e]
        best = sorted(((sum(a != b for a, b in zip(own, other)), i is not None, i or 0, i) for i, other in bits))[:k]
        out += [(q, n, i, d) for n, (d, _, _, i) in enumerate(best, 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("k", [10, 10_000])
def test_matches_all_pairs(spark, k):
    every = vectors(spark, np.random.default_rng(1))
    asked = every.filter("vec_id % 50 = 0 OR vec_id IS NULL OR vec_id >= 2000")
    pairs = lambda df: [(r["vec_id"], r["embedding"]) for r in fixtures.local(df)]
    got = fixtures.local(hamming_search.top_k(every, asked, k, skip_other_lengths=True))
    assert sorted(((r["query_id"], r["rank"], r["neighbor_id"], r["distance"]) for r in got), key=repr) == brute(pairs(every), pairs(asked), k)


def test_other_lengths_are_an_error(spark):
    every = vectors(spark, np.random.default_rng(1))
    with pytest.raises(Exception, match="hasn't 64 values: 2001"):
        hamming_search.top_k(every, every.filter("vec_id = 1")).collect()


def test_few_codes_are_verified(spark):
    """Of 100,000 codes around 2,000 centres, at most a twentieth; results against all pairs."""
    rng = np.random.default_rng(5)
    bits = np.repeat(rng.random((2000, 64)) < 0.5, 50, axis=0) ^ (rng.random((100_000, 64)) < 0.06)
    rows = [(i, x) for i, x in enumerate(np.where(bits, 1.0, -1.0).tolist())]
    every = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = fixtures.local(hamming_search.top_k(every, every.filter("vec_id % 5000 = 0"), with_search=True))
    packed = np.packbits(bits, axis=1).view(np.uint64).reshape(-1)
    for q in range(0, 100_000, 5000):
        d = np.bitwise_count(packed ^ packed[q])
        want = np.lexsort((np.arange(len(d)), d))[:10]
        own = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [(r["neighbor_id"], r["distance"]) for r in own] == [(i, d[i]) for i in want]
        assert all(r["distance"] <= r["radius"] for r in own)
    assert np.mean([r["verified"] for r in got]) < 5000


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hamming_search.top_k(none, none).count() == 0
