import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from granary.llm import bin_packing
from granary.llm.registry import tokenizer_path
from tests.llm import fixtures

PATH = tokenizer_path("word_bpe_49k.json")
ODD = ["<|endoftext|> x", "a<|startoftext|>b", "İstanbul ǅ ß ﬁ don't I'LL we've 's", "x...y!?,.:;#&%$ ... '", "日本語 テスト", "é e ́", "a b c", "naïve café NAÏVE", "123 4,567.89 a1b2", "' '' 'tis", "é, É. ü!"]


def test_ids_are_the_tokenizers():
    whole, chunks = Tokenizer.from_file(PATH), bin_packing.ChunkIds(PATH)
    for text in [*filter(None, fixtures.AWKWARD), *ODD]:
        assert np.frombuffer(chunks.ids(text), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


def check(rows, docs, capacity):
    whole = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for d in docs:
        ids = [*(whole.encode(d["text"], add_special_tokens=False).ids if d["text"] else []), 1]
        for k, a in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[a : a + capacity], "<u4")
            want[d["doc_id"], k, a, len(part), zlib.crc32(part.tobytes())] += 1
    got, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        got[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert got == want
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), max(-(-sum(r["length"] for r in rows) // capacity), sum(2 * r["length"] > capacity for r in rows))


@pytest.mark.parametrize("shard_pieces", [8192, 40])
def test_pieces_and_places(spark, shard_pieces):
    docs = fixtures.frame(spark, fixtures.texts() + fixtures.AWKWARD + ODD)
    p = bin_packing.Parameters(capacity=512, shard_pieces=shard_pieces)
    used, least = check(fixtures.local(bin_packing.pack(docs, PATH, p)), fixtures.local(docs), 512)
    assert used <= 1.05 * least + 2
    assert bin_packing.pack(docs, PATH, p).count() > 0


def triples(seed=5, n=60):
    """Lengths that n bins of 1000 hold exactly, three in each, and which best fit decreasing doesn't pack so."""
    rng = np.random.default_rng(seed)
    lengths = np.array([400, 350, 250] * n) + rng.integers(-20, 20, 3 * n)
    lengths[2::3] = 1000 - lengths[0::3] - lengths[1::3]
    return lengths


def fits(best, lengths):
    assert best.min() == 0 and np.bincount(best, weights=lengths).max() <= 1000
    return len(np.unique(best))


def test_genetic_search_beats_its_founders():
    """Where the optimum is 60, best fit decreasing needs more, and so do closely filled bins; the search finds 60 or 61 and gains on the latter."""
    p, gains = bin_packing.Parameters(capacity=1000, offspring=60, population=6), 0
    for seed in (5, 6, 7):
        lengths = triples(seed)
        first = fits(bin_packing.refill(np.full(180, -1, np.int32), np.arange(180), lengths, 1000), lengths)
        founder = fits(bin_packing.found(lengths, 1, p, np.random.default_rng(seed))[0], lengths)
        best = fits(bin_packing.evolve(lengths, [], p, np.random.default_rng(seed), 1)[0], lengths)
        assert best <= 61 < first and best <= founder
        gains += founder - best
    assert gains > 0


def test_islands_differ_and_migrants_carry_gains(spark):
    lengths = triples()
    p = bin_packing.Parameters(capacity=1000, offspring=0)
    founded = [bin_packing.evolve(lengths, [], p, np.random.default_rng([0, i]), i)[0] for i in range(3)]
    assert len({x.tobytes() for x in founded}) == 3
    good = bin_packing.evolve(lengths, [], bin_packing.Parameters(capacity=1000, offspring=60, population=6), np.random.default_rng(1))[0]
    poor = bin_packing.refill(np.full(180, -1, np.int32), np.arange(180), lengths, 1000)
    rows = [(0, 1, False, np.arange(180).tobytes(), lengths.tobytes(), poor.tobytes()), (0, 1, True, None, None, good.tobytes())]
    out = bin_packing._epoch(p, 1)(pa.Table.from_batches([bin_packing._state_batch(rows)])).to_pylist()
    home = next(r for r in out if not r["migrant"])
    assert fits(np.frombuffer(home["genomes"], np.int32)[:180], lengths) == fits(good, lengths) < fits(poor, lengths)
    assert next(r for r in out if r["migrant"])["island"] == 2


def test_levels_shrink_and_meet_the_optimum(spark):
    """Bins that stay open go on level by level, also when these are most: as few as one shard finds, but for two."""
    lengths = triples(n=200)
    items = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "item long, length long").repartition(3)
    p = bin_packing.Parameters(capacity=1000, shard_pieces=150, offspring=10)
    rows = fixtures.local(bin_packing.pack_items(items, p))
    assert sorted(r["item"] for r in rows) == list(range(600))
    assert len({r["sequence_id"] for r in rows}) <= 210


def test_empty(spark):
    assert bin_packing.pack(fixtures.empty(spark), PATH).count() == 0
