import re
from itertools import combinations

import numpy as np
import pytest

from granary.llm import jaccard_join
from tests.llm import fixtures


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """component_id of each row by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
            root[find(j)] = find(i)
    out = []
    for i, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((doc_id, len(sets[i]), (min(ids) if ids else None) if sets[i] else doc_id))
    return sorted(out, key=repr)


@pytest.mark.parametrize("group_rows", [4096, 8])
def test_components_match_all_pairs(spark, group_rows):
    docs = fixtures.frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in fixtures.local(docs)]
    got = fixtures.local(jaccard_join.jaccard_components(docs, group_rows))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)


def test_many_random_sets_near_the_threshold(spark):
    import random

    rng = random.Random(3)
    base = [" ".join(f"v{rng.randrange(30)}" for _ in range(rng.choice([6, 12, 24, 40]))) for _ in range(12)]
    given = [fixtures.near(rng, rng.choice(base), rng.choice([0, 0.03, 0.08, 0.12])) for _ in range(200)]
    docs = fixtures.frame(spark, given, list(range(200)))
    rows = [(r["doc_id"], r["text"]) for r in fixtures.local(docs)]
    got = fixtures.local(jaccard_join.jaccard_components(docs, 16))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)


def test_answers_derived_from_a_similar_set_are_its_own(monkeypatch):
    rng = np.random.default_rng(5)
    base, sets = rng.permutation(4000)[:200].astype(np.uint64), []
    for k in range(60):  # each differs from the one before in a few shingles, so the first and the last share few
        base[rng.permutation(200)[:6]] = 5000 + 6 * k + np.arange(6)
        sets.append(np.sort(base))
    group = jaccard_join.Group(np.array([len(s) for s in sets]), sets)
    exact = lambda x: np.array([len(np.intersect1d(sets[x], s)) for s in sets])
    known = group.overlaps(0, None, None)
    for x in range(1, 60):  # along a chain, so an error would add up
        known = group.overlaps(x, x - 1, known)
        assert (known == exact(x)).all()
    derived, read = [], jaccard_join.Group.postings
    monkeypatch.setattr(jaccard_join.Group, "postings", lambda self, tokens: derived.append(len(tokens)) or read(self, tokens))
    label = group.components()
    assert len(set(label)) == 1
    assert max(derived) == 200 and np.median(derived) < 40  # one set in full, the rest by what differs


def test_a_large_group_of_near_copies_is_not_sent_to_all_its_blocks(spark, monkeypatch):
    """One large component, and texts that share its passage without a link: rows sent grow with the group, not with its square."""
    import random

    rng, sent = random.Random(8), []
    base = [f"b{i}" for i in range(60)]
    copies = [" ".join([*base[:k], f"n{k}x", *base[k + 1 :]]) for k in range(60)] + [" ".join([*base, f"t{k}"]) for k in range(140)]
    others = [" ".join([*base[:30], *(f"o{k}_{rng.randrange(9)}" for _ in range(40))]) for k in range(6)]
    docs = fixtures.frame(spark, copies + others, list(range(206)))
    rows = [(r["doc_id"], r["text"]) for r in fixtures.local(docs)]
    linked = jaccard_join._linked
    monkeypatch.setattr(jaccard_join, "_linked", lambda grouped, n: sent.append(grouped.count()) or linked(grouped, n))
    got = fixtures.local(jaccard_join.jaccard_components(docs, 16))
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)
    within, across = sent
    assert within <= 2 * 206
    assert across <= 3 * 206  # 26 blocks: all their pairs would be 26 * 206 rows


def test_one_of_each_component_stays(spark):
    docs = fixtures.frame(spark)
    rows = [(r["doc_id"], r["text"]) for r in fixtures.local(docs)]
    want = sorted({(c if c is not None else None) for d, n, c in brute(rows) if n}, key=repr) + sorted((d for d, n, _ in brute(rows) if not n), key=repr)
    kept = jaccard_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in fixtures.local(kept)), key=repr) == sorted(want, key=repr)


def test_components_without_ids_or_with_the_same_id_all_stay(spark):
    texts = [" ".join(f"{k}{i}" for i in range(30)) for k in "abcdefg"]
    docs = fixtures.frame(spark, [*texts, texts[0]], [None, None, None, 5, 5, 6, 7, 8])  # frame() repeats two rows
    kept = fixtures.local(jaccard_join.keep_one(docs))
    assert sorted((r["text"], r["doc_id"]) for r in kept if r["doc_id"] is not None) == [(texts[0], 8), *zip(texts[3:], [5, 5, 6, 7])]
    assert sorted(r["text"] for r in kept if r["doc_id"] is None) == texts[1:3]


def test_empty(spark):
    assert jaccard_join.jaccard_components(fixtures.empty(spark)).count() == 0
    assert jaccard_join.keep_one(fixtures.empty(spark)).count() == 0
