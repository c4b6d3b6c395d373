"""Small document tables with the awkward cases in them."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, _row int, text_hash string, key int, fp string, n_words string"


def words(rng, n, vocabulary=400):
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def near(rng, text, share):
    """The text with about that share of its words changed, in one stretch."""
    w = text.split()
    a = rng.randrange(len(w))
    for i in range(a, min(len(w), a + max(1, int(share * len(w))))):
        w[i] = f"x{rng.randrange(10**6)}"
    return " ".join(w)


def texts(seed=1, n=60):
    rng = random.Random(seed)
    out = [" ".join(words(rng, rng.choice([3, 5, 30, 80, 200]))) for _ in range(n)]
    out += [near(rng, t, rng.choice([0.01, 0.05, 0.1, 0.2])) for t in out for _ in range(2)]
    out += [out[0]] * 20 + [near(rng, out[7], 0.02) for _ in range(25)]
    shared = " ".join(words(rng, 60))
    out += [f"{' '.join(words(rng, 40))} {shared}" for _ in range(15)]
    return out


AWKWARD = [None, "", " \n\t ", "one", "One two\vthree  FOUR", "a b c d e", "A b C d e", "　\u0085x \x1c y", "ÄÖ é́ \U0001f600 " * 5, "the same words again " * 40, "same line\n" * 30, "long " * 20_000]


def frame(spark, given=None, ids=None):
    """Rows with null ids, languages and sources, a repeated row, and extra columns with names that the operators use."""
    given = texts() + AWKWARD if given is None else given
    rng = random.Random(7)
    ids = ids or [*range(len(given) - 1), None]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", None]), None if t is None else len(t), "x", 1, None, 2, "y", "z") for i, t in zip(ids, given)]
    return spark.createDataFrame(rows + rows[3:4] + rows[-2:-1], DOCS).repartition(4)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def local(df):
    return [r.asDict(recursive=True) for r in df.collect()]
