"""Operator 7: a quality classifier by the perplexity of an interpolated modified Kneser-Ney trigram model.

The model learns from all trusted documents (label quality 1, toxic 0) outside the held-out fifth, a language each. Texts are hashed in
packs, a language each; what a pack sends on are its distinct n-grams only, sorted by key, a row for each shard of the keys:

1. Pairs. A shard finds in how many contexts each pair (v, w) is (the adjusted count; at a text's start there is one context, so its count
   stays), and per word the sums over its pairs, which a second shuffle adds up.
2. Contexts. A shard counts the words that follow each pair (u, v).
3. Scoring, in `rounds` of packs: a pack asks the shards for its distinct words, pairs and triples; the shards answer with counts in the
   same order; the pack adds up the logarithms of its texts' probabilities. Discounts are one row a language.

Keys are 48 bits of a word (with its language) and 56 bits of a pair; a triple is a word under its pair. No key gathers the rows of a
frequent word: pairs and contexts are sharded by both of their words, and sums per word are added up before they are shuffled.

A document's log perplexity x per word is compared within its language: m is the mean of the held-out trusted documents of the language and
a + b / (n + 1) the variance about it that least squares give for n words, so short texts may deviate more. The document is kept if
(x - m) / sqrt(a + b / (n + 1)) is at most the `quantile` of that ratio among them. The model has seen none of these.
Languages with fewer than `min_trusted` of them use the ratios and moments of all languages; one that the model doesn't know has no limit.

A word's closing . , ; : doesn't count. Unknown words share what the unigrams' discounts leave, in equal parts.

Defined results: a null or empty text has no words, null perplexity and isn't kept. A null language is the language ""; languages
that the model doesn't know are scored with unknown words of probability 1e-7, and their texts with words are kept: nothing was learnt
that could speak against them. Labels that conflict count as not trusted. Without trusted labels nothing is judged and every text with
words is kept. Repeated rows give repeated rows (a trusted text counts as often in training); other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Recent, bucketed, discard, documents, map_batches, mixed, written

UNKNOWN_LANGUAGE = float(np.log(1e-7))
PAIRS, WORDS, CONTEXTS = 0, 1, 2


@dataclass(frozen=True)
class Parameters:
    """pack_words: words of a language that a task gathers into a pack. shard_words: training words that a shard of the model stands for.
    broadcast_ids: up to so many ids of training documents are broadcast; more are joined by shuffle.

    rounds: how many parts of the documents are scored one after the other, at most; a part is not made smaller than round_bytes of text.
    Both bound what is on disk at a time, not what is scored. quantile: of the held-out trusted documents that are kept.
    """

    pack_words: int = 2_000_000
    shard_words: int = 500_000
    broadcast_ids: int = 1_000_000
    rounds: int = 6
    round_bytes: int = 64_000_000
    quantile: float = 0.99
    min_trusted: int = 20


def words_of(text: str | None) -> list[bytes]:
    return [w.rstrip(b".,;:") or w for w in text.encode().split()] if text else []


def trusted_ids(labels: DataFrame) -> DataFrame:
    rows = labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
    return rows.agg(F.min("quality").alias("q"), F.max("toxic").alias("t")).filter((F.col("q") == 1) & (F.coalesce("t", F.lit(0)) == 0)).select("doc_id")


def held_out() -> Column:
    """Trusted documents that only thresholds are learnt from."""
    return F.pmod(F.xxhash64(F.col("doc_id"), F.lit("held out")), F.lit(5)) == 0


class Hashes(Recent):
    """64-bit hashes of words without their closing marks, the same in every process."""

    def compute(self, key: bytes) -> int:
        return xxhash.xxh3_64_intdigest(key.rstrip(b".,;:") or key)


def word_keys(lang: str, h: np.ndarray) -> np.ndarray:
    """48-bit keys of a language's words from their hashes."""
    return mixed(h ^ np.uint64(xxhash.xxh3_64_intdigest(lang.encode(), seed=7))) >> np.uint64(16)


def ends(lang: str) -> np.ndarray:
    """Keys of the marks of a text's beginning and end, which no word has."""
    return word_keys(lang, np.array([xxhash.xxh3_64_intdigest(x, seed=1) for x in (b"begin", b"end")], np.uint64))


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """56-bit keys of pairs of words."""
    with np.errstate(over="ignore"):
        return mixed(mixed(v * np.uint64(0x9FB21C651E98DF25)) + w * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(8)


def low(w: np.ndarray) -> np.ndarray:
    """32 bits that tell words under a pair apart."""
    return (w & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def shard_of(key: np.ndarray, bits: int, shards: int) -> np.ndarray:
    """Shards are ranges of keys, so sorted keys have sorted shards."""
    return (key >> np.uint64(bits - 32)) * np.uint64(shards) >> np.uint64(32)


def squeeze(x: np.ndarray) -> bytes:
    """Counts as planes of as many bytes as the largest needs, compressed; the reader knows how many there are."""
    top = int(x.max()) if len(x) else 0
    size = next(s for s in (1, 2, 4, 8) if top < 1 << 8 * s)
    planes = x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T
    return bytes([size]) + pa.compress(np.ascontiguousarray(planes).tobytes(), codec="zstd", asbytes=True)


def unsqueeze(data: bytes, n: int) -> np.ndarray:
    size = data[0]
    planes = np.frombuffer(pa.decompress(data[1:], n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").reshape(-1).astype(np.int64)


def low_bytes(x: np.ndarray, n: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n]).tobytes()


def from_low_bytes(data: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.view("<u8").reshape(-1).astype(np.uint64)


def sorted_keys(keys: np.ndarray, bits: int) -> list[bytes]:
    """Sorted keys: their first 16 bits as steps, the rest plain."""
    return [squeeze(np.diff(keys >> np.uint64(bits - 16), prepend=np.uint64(0))), low_bytes(keys, bits // 8 - 2)]


def read_sorted(steps: bytes, rest: bytes, bits: int) -> np.ndarray:
    out = from_low_bytes(rest, bits // 8 - 2)
    return np.cumsum(unsqueeze(steps, len(out))).astype(np.uint64) << np.uint64(bits - 16) | out


def bundle(*parts: bytes) -> bytes:
    return np.array([len(p) for p in parts], "<u4").tobytes() + b"".join(parts)


def unbundle(data: bytes, n: int) -> list[bytes]:
    at = 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(data[: 4 * n], "<u4").astype(np.int64))])
    return [data[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]


def runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts."""
    return np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.empty(0, np.int64)


def emit(schema: pa.Schema, rows: list[tuple]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


PACKS = "pack long, lang string, doc_ids array<long>, sizes array<int>, words binary"
_PACKS = pa.schema([("pack", pa.int64()), ("lang", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int32())), ("words", pa.binary())])


def packs(docs: DataFrame, pack_words: int) -> DataFrame:
    """Whole texts as word keys, a language each: the distinct keys, most frequent first, and each word's place among them."""

    def row(pack: int, lang: str, held: list) -> tuple:
        h, place, n = np.unique(np.concatenate([x for _, x in held]), return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        rank = np.empty(len(h), np.int64)
        rank[order] = np.arange(len(h))
        words = bundle(low_bytes(word_keys(lang, h[order]), 6), squeeze(rank[place]))
        return pack, lang, [d for d, _ in held], [len(x) for _, x in held], words

    def run(batches):
        known, held, total = Hashes(), defaultdict(list), defaultdict(int)
        pack = TaskContext.get().partitionId() << 36
        for batch in batches:
            for doc_id, lang, text in zip(batch["doc_id"].to_pylist(), batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
                words = text.encode().split() if text else []
                held[lang or ""].append((doc_id, np.fromiter((known[w] for w in words), np.uint64, len(words))))
                total[lang or ""] += len(words) + 1
                if sum(total.values()) >= pack_words:
                    most = max(total, key=total.get)
                    yield from emit(_PACKS, [row(pack, most, held.pop(most))])
                    pack += 1
                    del total[most]
        for k, (lang, texts) in enumerate(held.items()):
            yield from emit(_PACKS, [row(pack + k, lang, texts)])

    return documents(docs, "doc_id", "lang", "text").mapInArrow(run, PACKS)


class Grams:
    """A pack's words and n-grams: u, v, w per place, the pairs (v, w) and the contexts (u, v)."""

    def __init__(self, lang: str, sizes: list[int], words: bytes):
        keys, places = unbundle(words, 2)
        self.vocabulary = from_low_bytes(keys, 6)
        self.sizes = np.array(sizes, np.int64)
        n = int(self.sizes.sum())
        self.place = unsqueeze(places, n) if n else np.empty(0, np.int64)
        begin, end = ends(lang)
        self.every = np.concatenate([self.vocabulary, [begin, end]])
        worded = self.sizes[self.sizes > 0]
        at = np.concatenate([[0], np.cumsum(worded + 3)])
        x = np.full(at[-1], len(self.vocabulary), np.int64)  # two beginnings before each text, an end behind it
        x[at[1:] - 1] = len(self.vocabulary) + 1
        inner = np.ones(len(x), bool)
        inner[at[:-1]] = inner[at[:-1] + 1] = inner[at[1:] - 1] = False
        x[inner] = self.place
        third = np.ones(len(x), bool)
        third[at[:-1]] = third[at[:-1] + 1] = False
        w = np.flatnonzero(third)
        self.u, self.v, self.w = x[w - 2], x[w - 1], x[w]
        self.begin = len(self.vocabulary)
        self.pair = pair_keys(self.every[self.v], self.every[self.w])
        self.context = pair_keys(self.every[self.u], self.every[self.v])

    def __bool__(self) -> bool:
        return len(self.w) > 0


def nested(parent: np.ndarray, child: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (parent number, child) sorted: parents, children, how often, and for each input its number."""
    found, number, n = np.unique(parent.astype(np.uint64) << np.uint64(32) | child.astype(np.uint64), return_inverse=True, return_counts=True)
    return (found >> np.uint64(32)).astype(np.int64), low(found), n, number


SENT = "shard int, lang string, kind int, pack long, data binary"
_SENT = pa.schema([("shard", pa.int32()), ("lang", pa.string()), ("kind", pa.int32()), ("pack", pa.int64()), ("data", pa.binary())])


def by_shard(shard: np.ndarray, shards: int) -> list[tuple[int, int, int]]:
    """(shard, first, end) of the shards that occur in sorted shard numbers."""
    at = np.searchsorted(shard, np.arange(shards + 1))
    return [(s, int(at[s]), int(at[s + 1])) for s in np.flatnonzero(at[1:] > at[:-1])]


def _send(held: DataFrame, rows) -> DataFrame:
    """mapInArrow over packs; rows(grams, lang, pack) gives rows of SENT."""

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                g = Grams(r["lang"], r["sizes"], r["words"])
                if g:
                    yield from emit(_SENT, rows(g, r["lang"], r["pack"]))

    return held.mapInArrow(run, SENT)


def sent_pairs(held: DataFrame, shards: int) -> DataFrame:
    """A pack's distinct pairs (v, w), sorted by key: both words, how many words u before it and these, and how often each."""

    def rows(g: Grams, lang: str, pack: int) -> list[tuple]:
        keys, first, number = np.unique(g.pair, return_index=True, return_inverse=True)
        parent, child, n, _ = nested(number, low(g.every[g.u]))
        kids = np.bincount(parent, minlength=len(keys))
        starts = np.concatenate([[0], np.cumsum(kids)])
        v, w = g.every[g.v[first]], g.every[g.w[first]]
        n = np.where(g.v[first][parent] == g.begin, n, 1)
        return [
            (s, lang, PAIRS, pack, bundle(low_bytes(v[a:b], 6), low_bytes(w[a:b], 6), squeeze(kids[a:b]), child[starts[a] : starts[b]].tobytes(), squeeze(n[starts[a] : starts[b]])))
            for s, a, b in by_shard(shard_of(keys, 56, shards), shards)
        ]

    return _send(held, rows)


def sent_contexts(held: DataFrame, shards: int) -> DataFrame:
    """A pack's distinct contexts (u, v), sorted by key: how many words follow and these, and how often each."""

    def rows(g: Grams, lang: str, pack: int) -> list[tuple]:
        keys, number = np.unique(g.context, return_inverse=True)
        parent, child, n, _ = nested(number, low(g.every[g.w]))
        kids = np.bincount(parent, minlength=len(keys))
        starts = np.concatenate([[0], np.cumsum(kids)])
        return [
            (s, lang, CONTEXTS, pack, bundle(*sorted_keys(keys[a:b], 56), squeeze(kids[a:b]), child[starts[a] : starts[b]].tobytes(), squeeze(n[starts[a] : starts[b]])))
            for s, a, b in by_shard(shard_of(keys, 56, shards), shards)
        ]

    return _send(held, rows)


MODEL = "shard int, lang string, kind int, pack long, data binary, c1 long, c2 long, c3 long, c4 long, total long, types long"
_MODEL = pa.schema([*_SENT, *((n, pa.int64()) for n in ("c1", "c2", "c3", "c4", "total", "types"))])


def counts_of(counts: np.ndarray) -> tuple[int, ...]:
    """How many counts are 1, 2, 3 and 4, their sum and number: what a language's discounts are made of."""
    return (*[int((counts == k).sum()) for k in (1, 2, 3, 4)], int(counts.sum()), len(counts))


def by_three(place: np.ndarray, counts: np.ndarray, n: int) -> list[np.ndarray]:
    """Per place the sum of counts, and how many are 1, 2 and above."""
    add = lambda x: np.bincount(place, weights=x, minlength=n).astype(np.int64)
    return [add(counts), add(counts == 1), add(counts == 2), add(counts > 2)]


def _merged(sent: DataFrame, shards: int, merge) -> DataFrame:
    """merge(lang, shard, rows' data) gives rows of MODEL; called for each shard and language."""

    def run(batches):
        now, held = None, []
        for batch in batches:
            for shard, lang, data in zip(batch["shard"].to_pylist(), batch["lang"].to_pylist(), batch["data"].to_pylist(), strict=True):
                if (shard, lang) != now and held:
                    yield from emit(_MODEL, merge(now[1], now[0], held))
                    held = []
                now = shard, lang
                held.append(data)
        if held:
            yield from emit(_MODEL, merge(now[1], now[0], held))

    return sent.repartitionById(shards, "shard").sortWithinPartitions("shard", "lang").mapInArrow(run, MODEL)


def _gathered(keys: list[np.ndarray], kids: list[np.ndarray], child: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys, where each first was, and the distinct (key number, child) with their sums."""
    every, first, number = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    parent = np.repeat(number, np.concatenate(kids))
    key, at = np.unique(parent.astype(np.uint64) << np.uint64(32) | np.concatenate(child).astype(np.uint64), return_inverse=True)
    return every, first, (key >> np.uint64(32)).astype(np.int64), low(key), np.bincount(at, weights=np.concatenate(n), minlength=len(key)).astype(np.int64)


def merge_pairs(shards: int):
    def merge(lang: str, shard: int, held: list[bytes]) -> list[tuple]:
        vs, ws, kids, child, n = [], [], [], [], []
        for data in held:
            v, w, k, c, m = unbundle(data, 5)
            vs.append(from_low_bytes(v, 6))
            ws.append(from_low_bytes(w, 6))
            kids.append(unsqueeze(k, len(vs[-1])))
            child.append(np.frombuffer(c, np.uint32))
            n.append(unsqueeze(m, len(child[-1])))
        v, w = np.concatenate(vs), np.concatenate(ws)
        keys, first, parent, _, n = _gathered([pair_keys(v, w)], kids, child, n)
        v, w = v[first], w[first]
        n = np.where(v[parent] == ends(lang)[0], n, 1)  # packs may have the same triple
        c2 = np.bincount(parent, weights=n, minlength=len(keys)).astype(np.int64)
        out = [(shard, lang, PAIRS, None, bundle(*sorted_keys(keys, 56), squeeze(c2)), *counts_of(c2))]
        words = np.unique(np.concatenate([v, w]))
        sums = by_three(np.searchsorted(words, v), c2, len(words))
        before = np.bincount(np.searchsorted(words, w), minlength=len(words))
        for s, a, b in by_shard(shard_of(words, 48, shards), shards):
            out.append((s, lang, WORDS, None, bundle(low_bytes(words[a:b], 6), squeeze(before[a:b]), *[squeeze(x[a:b]) for x in sums]), *[None] * 6))
        return out

    return merge


def merge_words(lang: str, shard: int, held: list[bytes]) -> list[tuple]:
    rows = [unbundle(d, 6) for d in held]
    keys = [from_low_bytes(r[0], 6) for r in rows]
    words, at = np.unique(np.concatenate(keys), return_inverse=True)
    sums = [np.bincount(at, weights=np.concatenate([unsqueeze(r[i], len(k)) for r, k in zip(rows, keys, strict=True)]), minlength=len(words)).astype(np.int64) for i in range(1, 6)]
    return [(shard, lang, WORDS, None, bundle(*sorted_keys(words, 48), *map(squeeze, sums)), *counts_of(sums[0][sums[0] > 0]))]


def merge_contexts(lang: str, shard: int, held: list[bytes]) -> list[tuple]:
    keys, kids, child, n = [], [], [], []
    for data in held:
        a, b, k, c, m = unbundle(data, 5)
        keys.append(read_sorted(a, b, 56))
        kids.append(unsqueeze(k, len(keys[-1])))
        child.append(np.frombuffer(c, np.uint32))
        n.append(unsqueeze(m, len(child[-1])))
    every, _, parent, child, n = _gathered(keys, kids, child, n)
    kids = np.bincount(parent, minlength=len(every))
    return [(shard, lang, CONTEXTS, None, bundle(*sorted_keys(every, 56), squeeze(kids), child.tobytes(), squeeze(n)), *counts_of(n))]


@dataclass
class Model:
    """shards, the table of pairs, words and contexts, and per language the discounts of each order and the share of unknown words."""

    shards: int
    table: DataFrame
    languages: DataFrame


#: Buckets of the model's table that Spark allows.
MOST_BUCKETS = 100_000


def discounts(order: int) -> list[Column]:
    """d1, d2, d3 from the counts of counts; where they don't work out, 0.5, 1 and 1.5."""
    n = [F.col(f"c{k}").cast("double") for k in (1, 2, 3, 4)]
    y = n[0] / F.nullif(n[0] + 2 * n[1], F.lit(0.0))
    out = []
    for k, usual in ((1, 0.5), (2, 1.0), (3, 1.5)):
        d = k - (k + 1) * y * n[k] / F.nullif(n[k - 1], F.lit(0.0))
        out.append(F.when((d > 0) & (d < k), d).otherwise(F.lit(usual)).alias(f"d{order}{k}"))
    return out


def train(held: DataFrame, shards: int) -> Model:
    """The model of packs of training documents, which go when their n-grams have been counted."""
    pairs = written(_merged(sent_pairs(held, shards), shards, merge_pairs(shards)))
    words = written(_merged(pairs.filter(F.col("kind") == WORDS).select(*_SENT.names), shards, merge_words))
    contexts = written(_merged(sent_contexts(held, shards), shards, merge_contexts))
    discard(held)
    every = pairs.filter(F.col("kind") == PAIRS).unionByName(words).unionByName(contexts)
    table = bucketed(every, max(4, min(shards // 2, MOST_BUCKETS)), "shard")
    discard(pairs, words, contexts)
    sums = table.groupBy("lang", "kind").agg(*[F.sum(c).alias(c) for c in _MODEL.names[5:]])
    of = lambda kind: sums.filter(F.col("kind") == kind)
    one = of(WORDS).select("lang", *discounts(1), "total", "types", "c1", "c2")
    left = F.col("d11") * F.col("c1") + F.col("d12") * F.col("c2") + F.col("d13") * (F.col("types") - F.col("c1") - F.col("c2"))
    one = one.select("lang", "d11", "d12", "d13", F.col("total").cast("double").alias("total"), (left / F.col("total") / (F.col("types") + 1)).alias("unknown"))
    two, three = of(PAIRS).select("lang", *discounts(2)), of(CONTEXTS).select("lang", *discounts(3))
    return Model(shards, table, written(one.join(two, "lang").join(three, "lang").coalesce(1)))


ASK = 3


def asked(held: DataFrame, shards: int) -> DataFrame:
    """What a pack wants to know: its distinct words; its distinct pairs, as pairs and as contexts; and the distinct words after each."""

    def rows(g: Grams, lang: str, pack: int) -> list[tuple]:
        q = Question(g)
        starts = np.concatenate([[0], np.cumsum(q.kids)])
        own = {s: (a, b) for s, a, b in by_shard(shard_of(q.words, 48, shards), shards)}
        keys = {s: (a, b) for s, a, b in by_shard(shard_of(q.keys, 56, shards), shards)}
        out = []
        for s in sorted({*own, *keys}):
            (a, b), (c, d) = own.get(s, (0, 0)), keys.get(s, (0, 0))
            out.append((s, lang, ASK, pack, bundle(*sorted_keys(q.words[a:b], 48), *sorted_keys(q.keys[c:d], 56), squeeze(q.kids[c:d]), q.child[starts[c] : starts[d]].tobytes())))
        return out

    return _send(held, rows)


class Question:
    """The distinct words, pairs and triples of a pack in the order in which they are asked for, and where each place's are."""

    def __init__(self, g: Grams):
        used = np.concatenate([g.vocabulary, g.every[-2:]])
        self.words, self.word = np.unique(used, return_inverse=True)
        self.keys, number = np.unique(np.concatenate([g.pair, g.context]), return_inverse=True)
        self.pair, self.context = number[: len(g.pair)], number[len(g.pair) :]
        parent, self.child, _, self.triple = nested(self.context, low(g.every[g.w]))
        self.kids = np.bincount(parent, minlength=len(self.keys))


def found_at(model: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted key is among the sorted keys of the model, and whether it is."""
    at = np.minimum(np.searchsorted(model, wanted), max(0, len(model) - 1))
    return at, (model[at] == wanted) if len(model) else np.zeros(len(wanted), bool)


class Shard:
    """A language's words, pairs and contexts of one shard."""

    def __init__(self, rows: dict[int, bytes]):
        none = np.empty(0, np.uint64)
        self.words, self.sums = none, [np.empty(0, np.int64)] * 5
        if WORDS in rows:
            a, b, *sums = unbundle(rows[WORDS], 7)
            self.words = read_sorted(a, b, 48)
            self.sums = [unsqueeze(s, len(self.words)) for s in sums]
        self.pairs, self.c2 = none, np.empty(0, np.int64)
        if PAIRS in rows:
            a, b, c = unbundle(rows[PAIRS], 3)
            self.pairs = read_sorted(a, b, 56)
            self.c2 = unsqueeze(c, len(self.pairs))
        self.contexts, self.triples, self.c3, self.after = none, none, np.empty(0, np.int64), [np.empty(0, np.int64)] * 4
        if CONTEXTS in rows:
            a, b, k, c, n = unbundle(rows[CONTEXTS], 5)
            self.contexts = read_sorted(a, b, 56)
            parent = np.repeat(np.arange(len(self.contexts)), unsqueeze(k, len(self.contexts)))
            child = np.frombuffer(c, np.uint32)
            self.triples = parent.astype(np.uint64) << np.uint64(32) | child
            self.c3 = unsqueeze(n, len(child))
            self.after = by_three(parent, self.c3, len(self.contexts))

    def answer(self, data: bytes) -> bytes:
        a, b, c, d, k, child = unbundle(data, 6)
        words, keys, child = read_sorted(a, b, 48), read_sorted(c, d, 56), np.frombuffer(child, np.uint32)
        value = lambda at, hit, x: squeeze(np.where(hit, x[at], 0) if len(x) else np.zeros(len(at), np.int64))
        at, hit = found_at(self.words, words)
        out = [value(at, hit, x) for x in self.sums]
        at, hit = found_at(self.pairs, keys)
        out.append(value(at, hit, self.c2))
        at, hit = found_at(self.contexts, keys)
        out += [value(at, hit, x) for x in self.after]
        kids = unsqueeze(k, len(keys))
        parent, known = np.repeat(at, kids), np.repeat(hit, kids)
        at, hit = found_at(self.triples, parent.astype(np.uint64) << np.uint64(32) | child)
        out.append(value(at, hit & known, self.c3))
        return bundle(np.array([len(words), len(keys), len(child)], "<u4").tobytes(), *out)


def answered(model: Model, questions: DataFrame) -> DataFrame:
    """The shards' answers: pack, shard, data. The model's buckets stay where they are; a shard's questions are joined to them."""
    schema = pa.schema([("pack", pa.int64()), ("shard", pa.int32()), ("data", pa.binary())])

    def run(own: pa.Table, questions: pa.Table) -> pa.Table:
        held, out = defaultdict(dict), []
        for r in own.to_pylist():
            held[r["lang"]][r["kind"]] = r["data"]
        now, shard = None, None
        for r in questions.sort_by("lang").to_pylist():
            if r["lang"] != now:
                now, shard = r["lang"], Shard(held[r["lang"]])
            out.append((r["pack"], r["shard"], shard.answer(r["data"])))
        return pa.table([list(x) for x in zip(*out, strict=True)], schema=schema) if out else schema.empty_table()

    asked_by = questions.select("shard", "lang", "pack", "data").groupBy("shard")
    return model.table.select("shard", "lang", "kind", "data").groupBy("shard").cogroup(asked_by).applyInArrow(run, "pack long, shard int, data binary")


SCORED = "doc_id long, lang string, n_words long, known boolean, total double"
CONSTANTS = ["d11", "d12", "d13", "total", "unknown", "d21", "d22", "d23", "d31", "d32", "d33"]


def cut(counts: np.ndarray, d: list[float]) -> np.ndarray:
    """The discount of each count."""
    return np.array([0.0, *d])[np.minimum(counts, 3)]


def log_probabilities(g: Grams, constants: dict, answers: list[bytes]) -> np.ndarray:
    """Of each place of a pack. answers: of all shards that were asked, in their order."""
    q = Question(g)
    parts = [unbundle(a, 12) for a in answers]
    sizes = [np.frombuffer(p[0], "<u4").astype(int) for p in parts]
    kinds = [0] * 5 + [1] * 5 + [2]
    x = [np.concatenate([unsqueeze(p[i + 1], n[kind]) for p, n in zip(parts, sizes, strict=True)]) for i, kind in enumerate(kinds)]
    c1, *after1 = x[:5]
    c2, *after2, c3 = x[5:]
    d = [[constants[f"d{order}{k}"] for k in (1, 2, 3)] for order in (1, 2, 3)]

    def lower(after: list[np.ndarray], d: list[float]) -> np.ndarray:
        """The weight of the lower order in each context: all where nothing was learnt."""
        total, *n = after
        left = sum(y * z for y, z in zip(d, n, strict=True))
        return np.where(total > 0, left / np.maximum(total, 1), 1.0)

    v, w = q.word[g.v], q.word[g.w]
    p = ((c1 - cut(c1, d[0])) / constants["total"] + constants["unknown"])[w]
    p = ((c2 - cut(c2, d[1]))[q.pair] / np.maximum(after1[0], 1)[v]) + lower(after1, d[1])[v] * p
    return np.log((c3 - cut(c3, d[2]))[q.triple] / np.maximum(after2[0], 1)[q.context] + lower(after2, d[2])[q.context] * p)


def settled(held: DataFrame, answers: DataFrame, model: Model) -> DataFrame:
    """The texts of packs with the sums of their logarithms."""
    schema = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("n_words", pa.int64()), ("known", pa.bool_()), ("total", pa.float64())])

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        rows = own.to_pylist()
        if not rows:
            return schema.empty_table()
        r = rows[0]
        g = Grams(r["lang"], r["sizes"], r["words"])
        known = r["unknown"] is not None
        totals = np.zeros(len(g.sizes))
        if g and known:
            by = answers.sort_by("shard")["data"].to_pylist()
            worded = g.sizes > 0
            first = np.concatenate([[0], np.cumsum(g.sizes[worded] + 1)[:-1]])
            totals[worded] = np.add.reduceat(log_probabilities(g, r, by), first)
        elif g:
            totals = (g.sizes + 1) * UNKNOWN_LANGUAGE
        return pa.table([r["doc_ids"], [r["lang"]] * len(totals), g.sizes, [known] * len(totals), totals], schema=schema)

    own = held.join(model.languages, "lang", "left").select("pack", "lang", "doc_ids", "sizes", "words", *CONSTANTS)
    return own.groupBy("pack").cogroup(answers.groupBy("pack")).applyInArrow(run, SCORED)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0


def learnt(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> Model | None:
    """The model of all trusted documents outside the held-out fifth; none, if they have no words."""
    ids = written(trusted_ids(labels).filter(~held_out()))
    few = F.broadcast(ids) if ids.count() <= p.broadcast_ids else ids
    held = written(packs(documents(docs, "doc_id", "lang", "text").join(few, "doc_id", "left_semi"), p.pack_words))
    discard(ids)
    words = held.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")).first()["n"]
    if not words:
        return None
    return train(held, max(16, -(-words // p.shard_words)))


def perplexities(docs: DataFrame, model: Model, p: Parameters = Parameters()) -> DataFrame:
    """doc_id, lang, n_words, known (whether the model knows the language) and perplexity of every whole text."""
    rows = documents(docs, "doc_id", "lang", "text")
    n = max(1, min(p.rounds, -(-text_bytes(rows) // p.round_bytes)))
    part = F.pmod(F.xxhash64("doc_id", F.octet_length("text")), F.lit(n))
    done = []
    for k in range(n):
        held = written(packs(rows.filter(part == k), p.pack_words))
        done.append(written(settled(held, answered(model, asked(held, model.shards)), model)))
        discard(held)
    perplexity = F.when(F.col("n_words") > 0, F.exp(F.least(F.lit(500.0), -F.col("total") / (F.col("n_words") + 1))))
    return reduce(DataFrame.unionByName, done).select("doc_id", "lang", "n_words", "known", perplexity.alias("perplexity"))


def limits(trusted: DataFrame, p: Parameters) -> DataFrame:
    """lang, n, mean, a, b and top (the quantile of the ratio) of the trusted documents of each lang."""
    rows = trusted.select("lang", F.log("perplexity").alias("x"), (1 / (F.col("n_words") + 1)).alias("inv"))
    means = rows.groupBy("lang").agg(F.avg("x").alias("mean"), F.count("*").alias("n"))
    off = (F.col("x") - F.col("mean")) * (F.col("x") - F.col("mean"))
    fit = rows.join(means, "lang").withColumn("y", off).groupBy("lang", "mean", "n").agg(
        F.regr_slope("y", "inv").alias("slope"), F.regr_intercept("y", "inv").alias("level"), F.avg("y").alias("flat"), F.avg("inv").alias("inv_mean"))
    # a negative part of the variance is none; the other then has all of it
    good = F.col("slope").isNotNull() & (F.col("slope") >= 0) & (F.col("level") > 0)
    only = F.coalesce(F.col("slope") > 0, F.lit(False)) & ~good
    a = F.when(good, F.col("level")).when(only, F.lit(0.0)).otherwise(F.col("flat"))
    b = F.when(good, F.col("slope")).when(only, F.col("flat") / F.col("inv_mean")).otherwise(F.lit(0.0))
    fit = fit.select("lang", "mean", "n", (a + 1e-6).alias("a"), b.alias("b"))
    ratio = (F.col("x") - F.col("mean")) / F.sqrt(F.col("a") + F.col("b") * F.col("inv"))
    return rows.join(fit, "lang").groupBy("lang", "mean", "n", "a", "b").agg(F.percentile_approx(ratio, F.lit(p.quantile), F.lit(10_000)).alias("top"))


def classify(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """doc_id, n_words, perplexity, limit and kept, one row per row of docs."""
    model = learnt(docs, labels, p)
    if model is None:
        rows = map_batches(documents(docs, "doc_id", "text"), "doc_id long, n_words long", lambda b: {"doc_id": b["doc_id"], "n_words": [len(words_of(t)) for t in b["text"].to_pylist()]})
        none = F.lit(None).cast("double")
        return rows.select("doc_id", "n_words", none.alias("perplexity"), none.alias("limit"), (F.col("n_words") > 0).alias("kept"))
    scored = perplexities(docs, model, p)
    trusted = written(scored.filter("n_words > 0 AND known").join(trusted_ids(labels).filter(held_out()), "doc_id", "left_semi"))
    discard(model.table)
    moments = ("mean", "a", "b", "top")
    own = written(limits(trusted, p).filter(F.col("n") >= p.min_trusted).drop("n"))
    every = limits(trusted.withColumn("lang", F.lit("")), p)
    every = written(every.select(F.lit(True).alias("known"), *[F.col(c).alias(f"all_{c}") for c in moments]))
    # one row a language, and one in all: Spark broadcasts them if they are small enough
    rows = scored.join(own, "lang", "left").join(every, "known", "left")
    x = {c: F.coalesce(c, f"all_{c}") for c in moments}
    limit = F.when(F.col("known") & (F.col("n_words") > 0), F.exp(x["mean"] + x["top"] * F.sqrt(x["a"] + x["b"] / (F.col("n_words") + 1))))
    rows = rows.select("doc_id", "n_words", "perplexity", limit.alias("limit"))
    kept = (F.col("n_words") > 0) & F.coalesce(F.col("perplexity") <= F.col("limit"), F.lit(True))
    return rows.select("doc_id", "n_words", "perplexity", "limit", kept.alias("kept"))
