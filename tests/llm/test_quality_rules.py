import math
import random
import re
from collections import Counter

from granary.llm import quality_rules as quality
from tests.llm import fixtures

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": sum(c in "#*$%&|<>" for c in text), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}


def labelled(spark, docs):
    ids = [r["doc_id"] for r in fixtures.local(docs.select("doc_id"))]
    return spark.createDataFrame([(i, 1, 0, "x") for i in ids] + [(None, 1, 0, "x")], "doc_id long, quality int, toxic int, lang string")


def test_counts_and_base_match_python(spark):
    docs = fixtures.frame(spark, fixtures.texts() + fixtures.AWKWARD + ["#a *b <c>|d& $%\n\n \n#a *b <c>|d& $%\n" * 9])
    want = sorted(((r["doc_id"], *base(r["text"]).values()) for r in fixtures.local(docs)), key=repr)
    got = fixtures.local(quality.quality_rules(docs, labelled(spark, docs)))
    assert sorted(((r["doc_id"], *[r[c] for c in quality.BASE]) for r in got), key=repr) == want
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"])
        assert not (r["base_failed"] and r["kept"])


def test_binomial_bound_is_exact():
    for n, k, p in [(10, 0, 0.1), (40, 3, 0.2), (200, 199, 0.99), (300, 3, 0.01)]:
        whole = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
        assert math.isclose(quality.binomial_tail(n, k, p), whole, rel_tol=1e-9)
    assert quality.binomial_tail(10**9, 10**7 - 10**4, 0.01) < 0.01


def test_false_rejections_stay_below_the_risk(spark):
    """Cutoffs learnt on one half reject at most the risk of the good texts of the other half, in each stratum."""
    rng = random.Random(2)
    rows = []
    for i in range(6000):
        good = i % 3 > 0
        share = rng.betavariate(1, 30) if good else rng.betavariate(8, 4)
        text = " ".join(f"#{rng.randrange(10**6)}" if rng.random() < share else f"w{rng.randrange(10**6)}" for _ in range(40))
        rows.append((i, text, "en" if i % 2 else "de", good))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, int(g)) for i, _, _, g in rows if i % 4 < 2], "doc_id long, quality int")
    kept = {r["doc_id"]: r["kept"] for r in fixtures.local(quality.quality_rules(docs, labels))}
    for lang in ("en", "de"):
        fresh = [kept[i] for i, _, x, g in rows if g and x == lang and i % 4 >= 2]
        assert 1 - sum(fresh) / len(fresh) <= 0.05
    bad = [kept[i] for i, *_, g in rows if not g]
    assert sum(bad) / len(bad) < 0.6


def stratum_rows(spark, sizes, marked):
    """Texts of 40 words, so many a language; the share `marked` of them with a mark at half of the words."""
    rows = [(lang, i, i < marked.get(lang, 0) * n) for lang, n in sizes.items() for i in range(n)]
    made = [(k, " ".join(f"{lang}{i}x{j}" + "#" * (odd and j % 2) for j in range(40)), lang) for k, (lang, i, odd) in enumerate(rows)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string").repartition(3)
    return docs, spark.createDataFrame([(k, 1) for k in range(len(made))], "doc_id long, quality int")


def test_strata_have_live_steps(spark):
    """Languages with texts enough have their own step, the others one together; one whose good texts look bad stops early; none is off."""
    docs, labels = stratum_rows(spark, {"en": 300, "de": 150, "es": 120, "fr": 60, "it": 50}, {"de": 0.2})
    got = {r["stratum"]: (r["n_good"], r["step"]) for r in fixtures.local(quality.steps(quality.features(docs), labels))}
    assert got == {"en": (300, 8), "de": (150, 6), "es": (120, 8), None: (110, 8)}
    assert quality.least_texts(3, quality.Parameters()) == 86
    # too few of the others: all languages together
    docs, labels = stratum_rows(spark, {"en": 300, "fr": 20}, {})
    assert {r["stratum"]: (r["n_good"], r["step"]) for r in fixtures.local(quality.steps(quality.features(docs), labels))} == {"en": (300, 8), None: (320, 8)}
    docs, labels = stratum_rows(spark, {"en": 40}, {})
    assert {r["stratum"]: (r["n_good"], r["step"]) for r in fixtures.local(quality.steps(quality.features(docs), labels))} == {None: (40, 0)}


def test_conflicting_labels_are_not_good(spark):
    docs, labels = stratum_rows(spark, {"en": 100}, {})
    both = labels.unionByName(labels.filter("doc_id < 40").selectExpr("doc_id", "0 AS quality")).unionByName(labels)
    assert [r["n_good"] for r in fixtures.local(quality.steps(quality.features(docs), both))] == [60]


def test_without_labels_and_empty(spark):
    docs = fixtures.frame(spark)
    none = labelled(spark, docs).limit(0)
    assert all(r["kept"] != r["base_failed"] for r in fixtures.local(quality.quality_rules(docs, none)))
    assert quality.quality_rules(fixtures.empty(spark), none).count() == 0
    kept = quality.keep_good(docs, none)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in fixtures.local(quality.quality_rules(docs, none)))
