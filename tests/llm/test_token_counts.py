import math
import random
import tracemalloc

from tokenizers import Tokenizer
from tokenizers.models import Unigram

from granary.llm import token_counts
from granary.llm.registry import tokenizer_path
from tests.llm import fixtures

PATH = tokenizer_path("piece_bpe_32k.model")


def real(vocabulary):
    """The unigram tokenizer of the installed library on the same pieces."""
    return Tokenizer(Unigram([("<unk>", 0.0), *vocabulary], 0, False))


def test_counts_match_the_unigram_tokenizer(spark):
    vocabulary = token_counts.read_vocabulary(PATH)
    tokenizer = real([(p, s) for p, s in vocabulary])
    docs = fixtures.frame(spark, fixtures.texts() + fixtures.AWKWARD + ["日本語 unbelievable \U0001f600\U0001f600x ▁x ▁▁ naïve"])
    text = {r["doc_id"]: r["text"] for r in fixtures.local(docs)}
    for r in fixtures.local(token_counts.token_counts(docs, PATH)):
        w = [x.decode() for x in (text[r["doc_id"]] or "").encode().split()]
        assert r["n_words"] == len(w)
        assert r["n_tokens"] == sum(len(tokenizer.encode(x if x.startswith("▁") else "▁" + x).ids) for x in w)


def test_ties_and_unknowns():
    rng = random.Random(1)
    for _ in range(300):
        pieces = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 8))}
        vocabulary = [(p, -float(rng.randrange(1, 4))) for p in sorted(pieces)]
        counter, tokenizer = token_counts.Counter.of(vocabulary), real(vocabulary)
        for _ in range(10):
            text = "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 12)))
            assert counter.count(text) == len(tokenizer.encode(text).ids), (vocabulary, text)


def test_unknown_characters_count_their_bytes(spark):
    """The unigram tokenizer with byte fallback on the file's pieces and byte pieces, in scripts that the vocabulary doesn't cover."""
    vocabulary, fallback = token_counts.read_vocabulary(PATH), sorted(token_counts.byte_pieces(PATH))
    tokenizer = Tokenizer(Unigram([("<unk>", 0.0), *vocabulary, *[(f"<0x{b:02X}>", -1e9) for b in fallback]], 0, True))
    rng = random.Random(5)
    given = ["ᚠᚢᚦ", *("".join(rng.choice("ᚠᚢᚦ𓀀𓀁ab日é") for _ in range(rng.randrange(1, 9))) for _ in range(200))]
    docs = spark.createDataFrame(list(enumerate(given)), "doc_id long, text string")
    got = {r["doc_id"]: r["n_tokens"] for r in fixtures.local(token_counts.token_counts(docs, PATH))}
    assert got == {i: len(tokenizer.encode("▁" + x).ids) for i, x in enumerate(given)}
    assert got[0] == 10
    some = token_counts.Counter.of([("a", -1.0)], frozenset("é".encode()))  # without a piece for each byte a stretch is one unknown
    assert [some.count(x) for x in ("éa", "éü", "aéaü")] == [3, 1, 5]


def test_empty(spark):
    assert token_counts.token_counts(fixtures.empty(spark), PATH).count() == 0


def test_long_words_need_little_memory():
    """Words of a million characters, known and unknown ones, against the unigram tokenizer on a shorter one and in memory that doesn't grow."""
    vocabulary = token_counts.read_vocabulary(PATH)
    counter = token_counts.Counter.of(vocabulary, token_counts.byte_pieces(PATH))
    tokenizer = Tokenizer(Unigram([("<unk>", 0.0), *vocabulary, *[(f"<0x{b:02X}>", -1e9) for b in range(256)]], 0, True))
    for unit in ("unbelievable", "ᚠ", "xᚢy"):
        short = "▁" + unit * 300
        assert counter.count(short) == len(tokenizer.encode(short).ids)
        long = "▁" + unit * (1_000_000 // len(unit))
        tracemalloc.start()
        counter.count(long)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 6_000_000, unit  # the automaton has the text in four bytes a character


def test_scores_follow_the_order_of_pieces():
    vocabulary = token_counts.read_vocabulary(PATH)
    scores = [s for _, s in vocabulary]
    assert scores == sorted(scores, reverse=True) and math.isclose(math.fsum(map(math.exp, scores)), 1)
