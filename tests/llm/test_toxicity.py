import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from granary.llm import toxicity
from tests.llm import fixtures

BAD = ["vile", "scum", "hateful", "rotten", "filthy"]


def corpus(spark, n=1500):
    rng = random.Random(4)
    rows, labels = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = fixtures.words(rng, rng.choice([10, 40, 120]), 3000)
        for _ in range(max(2, len(w) // 12) if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(BAD)
        rows.append((i, " ".join(w), "en", "s", 0, "", 0, "", 0, "", ""))
        labels.append((i, 1, int(bad)))
    rows += [(n + k, t, None, None, None, "", 0, "", 0, "", "") for k, t in enumerate(fixtures.AWKWARD)] + [(None, "vile scum", None, None, 0, "", 0, "", 0, "", "")]
    return spark.createDataFrame(rows, fixtures.DOCS).repartition(4), spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    rows = fixtures.local(toxicity.toxicity(docs, labels))
    assert len(rows) == docs.count()
    truth = {r["doc_id"]: r["toxic"] for r in fixtures.local(labels) if r["toxic"] is not None}
    held = [r for r in rows if r["held_out"] and r["doc_id"] in truth]
    assert all(r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert len(held) > 200 and np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97


def test_held_out_labels_are_not_read(spark):
    docs, labels = corpus(spark, 600)
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(doc_id AS string)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    key = lambda labels: sorted(((r["doc_id"], r["score"]) for r in fixtures.local(toxicity.toxicity(docs, labels))), key=repr)
    assert key(labels) == key(flipped)


@pytest.mark.parametrize("common", [0.0, 0.09, 2.0])
def test_neighbours_are_exact(monkeypatch, common):
    rng = np.random.default_rng(6)
    idf = rng.uniform(1, 4, 40)
    terms = [sorted(rng.choice(40, rng.integers(1, 6), replace=False).tolist()) for _ in range(300)]
    counts = [rng.integers(1, 5, len(t)).tolist() for t in terms]
    monkeypatch.setattr(toxicity, "COMMON", common)
    ix = toxicity.Index.of(idf, list(range(300)), [0] * 300, terms, counts, 16)
    assert (ix.column >= 0).sum() == (0 if common > 1 else (np.bincount(np.concatenate(terms), minlength=40) >= max(2, common * 300)).sum())
    for t, n in zip(terms[:60], counts[:60]):
        q = np.zeros(40)
        q[t] = ix.weight(idf, t, n)
        dense = np.zeros((300, 40))
        for i, (a, b) in enumerate(zip(terms, counts)):
            dense[i, a] = ix.weight(idf, a, b)
        want = np.sort(dense @ q)[::-1][:15]
        places, cosines = ix.nearest(np.array(t), ix.weight(idf, t, n).astype(float), 15)
        assert np.allclose(cosines, want[want > 1e-9][: len(cosines)], atol=1e-5)
        assert len(cosines) == min(15, int((dense @ q > 1e-9).sum()))


def test_rare_and_ordinary_words_count(spark):
    """Cosines over all words, also those of few toxic texts and those of no example, against dictionaries."""
    rng = random.Random(8)
    texts = [" ".join(["Slur!", "slur"] * (i % 50 == 0) + fixtures.words(rng, 12, 300)) for i in range(400)]
    docs = spark.createDataFrame([*enumerate(texts), (None, "slur nowhere nowhere w1"), (None, "w1, W2 w3 other")], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 50 == 0)) for i in range(400)], "doc_id long, toxic int")
    bags = {r["doc_id"] if r["doc_id"] is not None else r["text"]: Counter(w.rstrip(",!").lower() for w in r["text"].split()) for r in fixtures.local(docs)}
    df = Counter(w for b in bags.values() for w in b)
    vector = lambda b: {w: (1 + math.log(c)) * (math.log((1 + len(bags)) / (1 + df[w])) + 1) for w, c in b.items()}
    unit = {k: {w: x / math.sqrt(sum(y * y for y in v.values())) for w, x in v.items()} for k, v in ((k, vector(b)) for k, b in bags.items())}
    examples = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    rows = fixtures.local(toxicity.toxicity(docs, labels))
    evidence = [[float(x.split(":")[1]) for x in r["evidence"].split(",")] for r in rows if r["doc_id"] is None]
    want = [sorted((sum(x * unit[i].get(w, 0) for w, x in unit[k].items()) for i in examples), reverse=True)[:3] for k in bags if isinstance(k, str)]
    assert np.allclose(sorted(evidence), sorted(want), atol=1e-4)


def test_without_labels_and_empty(spark):
    docs, labels = corpus(spark, 50)
    assert {r["score"] for r in fixtures.local(toxicity.toxicity(docs, labels.limit(0)))} == {0.0}
    assert toxicity.toxicity(fixtures.empty(spark), labels).count() == 0
