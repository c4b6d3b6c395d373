import math
import re
from collections import defaultdict

from granary.llm import source_mixing
from tests.llm import fixtures


def size(text):
    return len(re.findall(source_mixing.WORD, text or ""))


def shares(sizes):
    """Targets by sharing again and again what sources above twice their size leave."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if unit * weight[s] >= 2 * sizes[s]}
        if not full:
            return target | {s: unit * weight[s] for s in open_}
        target |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return target


def test_targets_and_words_taken(spark):
    docs = fixtures.frame(spark)
    rows = fixtures.local(source_mixing.mix(docs))
    assert len(rows) == docs.count()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in fixtures.local(docs):
        sizes[r["source"]] += size(r["text"])
    goal = shares(sizes)
    assert math.isclose(sum(goal.values()), 1.5 * sum(sizes.values()))
    for r in rows:
        assert 0 <= r["taken"] <= 2 * r["size"]
        assert r["source_size"] == sizes[r["source"]] and math.isclose(r["target"], goal[r["source"]])
        taken[r["source"]] += r["taken"]
    for s, t in goal.items():
        assert abs(taken[s] - t) <= 2, s
    again = fixtures.local(source_mixing.mix(docs))
    assert sorted(map(repr, again)) == sorted(map(repr, rows))


def test_the_mix_has_the_words_taken(spark):
    docs = fixtures.frame(spark)
    want = defaultdict(int)
    for r in fixtures.local(source_mixing.mix(docs)):
        want[r["doc_id"], r["source"]] += r["taken"]
    out = source_mixing.mixed(docs)
    assert out.columns == docs.columns
    got = defaultdict(int)
    for r in fixtures.local(out):
        got[r["doc_id"], r["source"]] += size(r["text"])
        assert r["n_chars"] == len(r["text"])
    assert got == {k: v for k, v in want.items() if v}


def test_cut_texts_are_beginnings(spark):
    texts = [" \t a  bé\n\n漢字 c\u00a0d e ", "x y z", "\n"]
    docs = spark.createDataFrame([(t, n) for t in texts for n in (1, 2, 3)], "text string, n long")
    for text, n, cut in docs.select("text", "n", source_mixing.first_words(docs.text, docs.n)).collect():
        words = list(re.finditer(source_mixing.WORD, text))[:n]
        assert cut == text[: words[-1].end() if words else 0]


def test_extreme_sources(spark):
    for given in [{"a": 1, "b": 1000, "c": 5}, {"a": 0, "b": 3}, {"a": 7}, {"a": 0}]:
        rows = [(i, "w " * n, "en", s, 0, "", 0, "", 0, "", "") for i, (s, n) in enumerate(given.items())]
        out = fixtures.local(source_mixing.mix(spark.createDataFrame(rows, fixtures.DOCS)))
        goal = shares(given)
        assert all(math.isclose(r["target"], goal[r["source"]]) for r in out)
        assert all(abs(r["taken"] - goal[r["source"]]) <= 1 for r in out)


def test_empty(spark):
    assert source_mixing.mix(fixtures.empty(spark)).count() == 0
    assert source_mixing.mixed(fixtures.empty(spark)).count() == 0
