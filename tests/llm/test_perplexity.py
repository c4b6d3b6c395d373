import math
import random
from collections import Counter, defaultdict

import pytest

from granary.llm import perplexity
from tests.llm import fixtures

A, Z = "<s>", "</s>"


def discounts(counts):
    n = Counter(counts.values())
    out = []
    for k, usual in ((1, 0.5), (2, 1.0), (3, 1.5)):
        d = k - (k + 1) * n[1] / (n[1] + 2 * n[2]) * n[k + 1] / n[k] if n[1] + 2 * n[2] and n[k] else None
        out.append(d if d is not None and 0 < d < k else usual)
    return lambda c: out[min(c, 3) - 1]


class Brute:
    """Interpolated modified Kneser-Ney from dictionaries."""

    def __init__(self, texts):
        self.c3 = Counter(g for t in texts for x in [[A, A, *t, Z]] for g in zip(x, x[1:], x[2:]))
        left = defaultdict(set)
        for u, v, w in self.c3:
            left[v, w].add(u)
        self.c2 = {(v, w): sum(self.c3[A, A, w] for _ in [0]) if v == A else len(us) for (v, w), us in left.items()}
        self.c1 = Counter(w for _, w in self.c2)
        self.d = [discounts(c) for c in (self.c1, self.c2, self.c3)]

    def part(self, counts, d, context, w):
        """Own part and weight of the lower order; an unknown context leaves all to it."""
        same = self.by(counts)[context]
        total = sum(same.values())
        if not total:
            return 0.0, 1.0
        c = same.get(w, 0)
        return (c - d(c)) / total if c else 0.0, sum(map(d, same.values())) / total

    def by(self, counts):
        name = f"_{id(counts)}"
        if not hasattr(self, name):
            out = defaultdict(dict)
            for g, c in counts.items():
                *context, w = g if isinstance(g, tuple) else (g,)
                out[tuple(context)][w] = c
            setattr(self, name, out)
        return getattr(self, name)

    def p(self, u, v, w):
        own1, low1 = self.part(self.c1, self.d[0], (), w)
        p1 = own1 + low1 / (len(self.c1) + 1)
        own2, low2 = self.part(self.c2, self.d[1], (v,), w)
        p2 = own2 + low2 * p1
        own3, low3 = self.part(self.c3, self.d[2], (u, v), w)
        return own3 + low3 * p2

    def perplexity(self, words):
        x = [A, A, *words, Z]
        return math.exp(-sum(math.log(self.p(*g)) for g in zip(x, x[1:], x[2:])) / (len(words) + 1))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(9)
    rows = []
    for i in range(300):
        text = " ".join(f"w{min(rng.randrange(40), rng.randrange(40))}" + rng.choice(["", "", ".", ","]) for _ in range(rng.choice([3, 30, 90])))
        rows.append((i, text if i % 10 else " ".join(f"z{rng.randrange(10**5)}" for _ in range(50)), ["en", "de", None][i % 3], "s", 0, "", 0, "", 0, "", ""))
    rows += rows[1:3]
    rows += [(400 + k, t, "en", None, None, "", 0, "", 0, "", "") for k, t in enumerate(fixtures.AWKWARD)] + [(None, "w1 w2", "xx", None, 0, "", 0, "", 0, "", "")]
    labels = spark.createDataFrame([(i, int(i % 10 > 0), 0) for i in range(300)] + [(None, 1, 0)], "doc_id long, quality int, toxic int")
    return spark.createDataFrame(rows, fixtures.DOCS).repartition(3), labels


@pytest.mark.parametrize("p", [perplexity.Parameters(min_trusted=5), perplexity.Parameters(pack_words=400, shard_words=500, broadcast_ids=0, rounds=3, round_bytes=20_000, min_trusted=5)])
def test_perplexities_match_dictionaries(spark, tables, p):
    """Also of long texts and repeated rows; and whatever the sizes of packs, shards and rounds."""
    docs, labels = tables
    ids = {r["doc_id"] for r in fixtures.local(perplexity.trusted_ids(labels).filter(~perplexity.held_out()))}
    rows = fixtures.local(docs)
    words = lambda t: [w.decode() for w in perplexity.words_of(t)]
    models = {lang: Brute([words(r["text"]) for r in rows if r["doc_id"] in ids and r["lang"] == lang]) for lang in ("en", "de", None)}
    out = fixtures.local(perplexity.classify(docs, labels, p))
    got = {r["doc_id"]: r for r in out}
    assert len(out) == len(rows) and Counter(r["doc_id"] for r in out) == Counter(r["doc_id"] for r in rows)
    for r in rows:
        w, x = words(r["text"]), got[r["doc_id"]]
        assert x["n_words"] == len(w)
        if not w:
            assert x["perplexity"] is None and not x["kept"]
        elif r["lang"] in models:
            assert math.isclose(x["perplexity"], models[r["lang"]].perplexity(w), rel_tol=1e-9), r["doc_id"]
        if x["limit"] is not None and w:
            assert x["kept"] == (x["perplexity"] <= x["limit"])
    assert sum(got[i]["kept"] for i in range(300) if i % 10) > 260 and not any(got[i]["kept"] for i in range(0, 300, 10))


def test_probabilities_sum_to_one():
    model = Brute([["a", "b", "a", "c"], ["a", "b"], ["c"]])
    for u, v in ((A, A), (A, "a"), ("a", "b"), ("x", "a")):
        assert math.isclose(sum(model.p(u, v, w) for w in [*model.c1, "unknown"]), 1.0)


def test_without_labels_and_empty(spark, tables):
    docs, labels = tables
    assert all(r["kept"] == (r["n_words"] > 0) for r in fixtures.local(perplexity.classify(docs, labels.limit(0))))
    assert perplexity.classify(fixtures.empty(spark), labels).count() == 0


def test_all_trusted_documents_are_learnt_from(spark):
    """A language without trusted documents has no limit; a text with conflicting labels isn't trusted."""
    docs = spark.createDataFrame([(i, f"w{i % 7} w{i % 5} w{i % 3}", "en") for i in range(900)] + [(900, "q r s", "rare"), (901, "odd words", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(900)] + [(901, 1, 0), (901, 0, 0)], "doc_id long, quality int, toxic int")
    wanted = perplexity.trusted_ids(labels).filter(~perplexity.held_out()).count()
    model = perplexity.learnt(docs, labels)
    words = model.table.filter("kind = 1").agg({"total": "sum"}).first()[0]
    vocabulary, grams = {f"w{k}" for k in range(7)} | {Z}, set()
    for r in fixtures.local(docs.join(perplexity.trusted_ids(labels).filter(~perplexity.held_out()), "doc_id", "left_semi")):
        w = [A, *r["text"].split(), Z]
        grams |= set(zip(w, w[1:]))
        assert set(w[1:]) <= vocabulary
    assert words == len(grams) and wanted > 600
    got = {r["doc_id"]: r for r in fixtures.local(perplexity.classify(docs, labels))}
    assert got[900]["limit"] is None and got[900]["kept"] and got[0]["limit"] is not None and not got[901]["kept"]


def test_limits_are_each_languages_own(spark):
    """One held-out trusted document in a hundred is above the quantile, whatever its length; languages differ in their limits."""
    rng = random.Random(3)
    rows = [(i, " ".join(f"{'en' if i % 2 else 'de'}{int(rng.paretovariate(0.7 if i % 2 else 1.4)) % 3000}" for _ in range(rng.choice([5, 40, 300]))), "en" if i % 2 else "de") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3000)], "doc_id long, quality int, toxic int")
    held = {r["doc_id"] for r in fixtures.local(labels.filter(perplexity.held_out()))}
    got = [r for r in fixtures.local(perplexity.classify(docs, labels)) if r["doc_id"] in held]
    for odd in (0, 1):
        own = [r for r in got if r["doc_id"] % 2 == odd]
        assert 0.97 < sum(r["kept"] for r in own) / len(own) <= 1
        assert all(sum(r["kept"] for r in own if r["n_words"] == n) > 0.94 * sum(r["n_words"] == n for r in own) for n in (5, 40, 300))
    first = {odd: {r["limit"] for r in got if r["doc_id"] % 2 == odd and r["n_words"] == 40} for odd in (0, 1)}
    assert all(len(x) == 1 for x in first.values()) and first[0] != first[1]
