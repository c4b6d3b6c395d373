"""Operator 4: packing tokenized documents into sequences with a grouping genetic algorithm.

Documents are tokenized in full, closed with an end id and cut into pieces of at most `capacity` tokens; whole pieces are sequences of
their own. The rest is dealt at random into shards of a bounded number of pieces. Each shard is packed by `islands` populations, one per
row: an individual maps pieces to bins. Crossover injects the fullest bins of one parent whole into the other, removes the bins that
hold the same pieces, and packs the displaced ones again: single pieces and pairs that fill a bin's room exactly are looked for first, then new bins are
closed as tightly as a piece or a pair can, and what is left goes where it fits best. Mutation empties the worst bins and some others. Islands have different founders: best fit decreasing on
the first, closely filled bins from different random choices on the others. After each epoch
every island sends its best individual to the next (a shuffle by shard and island). An island stops when its best uses no
more bins than the total length needs. The bins that stay poorly filled give their pieces back, at most half of a shard's, those of the emptiest bins first; these go on to the next
level, with fewer shards, until one shard holds what is left.

Defined results: a null text is empty and has the end id only. Repeated rows are packed like others. An empty table gives no rows.
Other columns are ignored. Runs agree: item numbers are written once, and all random choices are seeded by shard, island and epoch.
"""

from __future__ import annotations

import os
import struct
import unicodedata
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Recent, documents, written

PIECES = "item long, doc_id long, piece int, start long, length long, ids_crc32 long"


@dataclass(frozen=True)
class Parameters:
    """well_filled: bins under this share of the capacity are packed again on the next level."""

    capacity: int = 4096
    end_id: int = 1
    shard_pieces: int = 8192
    islands: int = 3
    population: int = 3
    epochs: int = 2
    offspring: int = 3
    injected: float = 0.3
    mutated: float = 0.1
    well_filled: float = 0.98


def _byte_letters() -> dict[int, str]:
    """The letters by which a byte-level vocabulary writes bytes: printable ones stand for themselves, the others follow U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class ChunkIds(Recent):
    """Token ids, as bytes, of stretches of text between spaces.

    White space is a border for this tokenizer, so a text's ids are those of its stretches. A stretch of letters is one word to its
    model, which then needs no further preparation than lower case and byte letters; all else takes the tokenizer's full way.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(250_000)
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters = self.tokenizer.model, _byte_letters()

    def word(self, text: str) -> bytes:
        """Ids of a stretch of letters."""
        return struct.pack(f"<{len(found)}I", *[t.id for t in found]) if (found := self.model.tokenize(text)) else b""

    def compute(self, chunk: bytes) -> bytes:
        """A letter before closing punctuation is a border, too, but for contractions."""
        if chunk.isalpha() and chunk.islower():
            return self.word(chunk.decode())
        core = chunk.rstrip(b".,!?*$%&#:;")
        text = core.decode()
        if text.isalpha() and text.lower().isalpha() and b"'" not in chunk:
            if core != chunk:
                return self[core] + self[chunk[len(core) :]]
            if unicodedata.is_normalized("NFC", text) and text == text.lower() and not text.isascii():
                return self.word(core.decode("latin-1").translate(self.letters))
        return np.array(self.tokenizer.encode(chunk.decode(), add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        data = text.encode()
        # the names of special tokens are looked for before letters are lowered
        return b"".join(map(self.__getitem__, (data if b"<|" in data else data.lower()).split()))


_CHUNKS: dict[str, ChunkIds] = {}


def chunk_ids(path: str) -> ChunkIds:
    """One per Python worker: it serves many tasks."""
    if path not in _CHUNKS:
        _CHUNKS[path] = ChunkIds(path)
    return _CHUNKS[path]


def pieces(docs: DataFrame, tokenizer: str, p: Parameters = Parameters()) -> DataFrame:
    """item (a number that is unique once this is written), doc_id, piece, start, length and ids_crc32."""
    schema = pa.schema([("item", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
    end = int(p.end_id).to_bytes(4, "little")
    step = 4 * p.capacity

    def run(batches):
        chunks, item = chunk_ids(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist(), strict=True):
                ids = chunks.ids(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at : at + step]
                    rows.append((item, doc_id, k, at // 4, len(part) // 4, zlib.crc32(part)))
                    item += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return documents(docs, "doc_id", "text").mapInArrow(run, PIECES)


class Bins:
    """Bins with room, ordered by how much is left, for best fit."""

    def __init__(self, capacity: int, used: np.ndarray):
        self.capacity = capacity
        self.next = len(used)
        self.room = sorted((capacity - int(u), k) for k, u in enumerate(used) if u < capacity)

    def place(self, length: int) -> int:
        """The fullest bin that takes the length, or a new one."""
        i = bisect_left(self.room, (length, -1))
        if i == len(self.room):
            left, k = self.capacity, self.next
            self.next += 1
        else:
            left, k = self.room.pop(i)
        if left > length:
            insort(self.room, (left - length, k))
        return k


class Supply:
    """Free pieces by length."""

    def __init__(self, free: np.ndarray, lengths: np.ndarray, capacity: int):
        self.count = np.bincount(lengths[free], minlength=capacity + 1)
        order = free[np.argsort(lengths[free], kind="stable")]
        at = np.concatenate([[0], np.cumsum(self.count)])
        self.pieces = {int(n): order[at[n] : at[n + 1]].tolist() for n in np.flatnonzero(self.count)}
        self.update()

    def update(self) -> None:
        """The longest piece of at most each length; 0, if there is none."""
        self.at_most = np.maximum.accumulate(np.where(self.count > 0, np.arange(len(self.count)), 0))

    def take(self, length: int) -> int:
        self.count[length] -= 1
        if not self.count[length]:
            self.update()
        return self.pieces[length].pop()

    def pair(self, room: int, rng: np.random.Generator) -> tuple[int, int]:
        """Lengths of two pieces that fill most of a room; one of the best such pairs."""
        a = np.flatnonzero(self.count[: room + 1])
        b = self.at_most[room - a]
        twice = (b == a) & (self.count[a] < 2)
        b[twice] = self.at_most[np.maximum(a[twice] - 1, 0)]
        total = np.where(b > 0, a + b, 0)
        if not len(a) or not total.max():
            return 0, 0
        best = rng.choice(np.flatnonzero(total == total.max()))
        return int(a[best]), int(b[best])

    def fill(self, room: int, exactly: bool, rng: np.random.Generator) -> list[int]:
        """Pieces for a bin's room. exactly: one or two that leave nothing, or none."""
        out: list[int] = []
        while room and (one := int(self.at_most[room])):
            a, b = (one, 0) if one == room else self.pair(room, rng)
            if exactly and a + b != room:
                break
            # long pieces are placed while they leave room for two more; the last ones close the bin as a single piece or a pair can
            chosen = [one] if a + b != room and self.at_most[room - one] and room > 3 * one else [a, b] if a + b > one else [one]
            for n in filter(None, chosen):
                out.append(self.take(n))
                room -= n
        return out


def close(bins: np.ndarray, lengths: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """bins with the free pieces (-1) packed so that as many bins as can be are full."""
    held, dense = np.unique(bins[bins >= 0], return_inverse=True)
    out = np.full(len(bins), -1, np.int32)
    out[bins >= 0] = dense
    used = np.bincount(dense, weights=lengths[bins >= 0], minlength=len(held)).astype(np.int64)
    supply = Supply(np.flatnonzero(out < 0), lengths, capacity)
    for k in np.argsort(-used, kind="stable"):
        if used[k] < capacity:
            out[supply.fill(int(capacity - used[k]), True, rng)] = k
    k = len(held)
    while longest := int(supply.at_most[-1]):
        first = supply.take(longest)
        rest = supply.fill(capacity - longest, False, rng)
        out[[first, *rest]] = k
        k += 1
    # the emptiest bins may fit into the room of others
    last = np.argsort(np.bincount(out, weights=lengths))[:2]
    loose = np.isin(out, last)
    best = refill(np.where(loose, -1, out), np.flatnonzero(loose), lengths, capacity)
    return best if best.max() <= out.max() else out


def refill(bins: np.ndarray, free: np.ndarray, lengths: np.ndarray, capacity: int, order: np.ndarray | None = None) -> np.ndarray:
    """bins (piece -> bin, -1: free) with the free pieces best-fitted, longest first or by the order given."""
    _, dense = np.unique(bins[bins >= 0], return_inverse=True)
    out = np.full(len(bins), -1, np.int32)
    out[bins >= 0] = dense
    used = np.bincount(dense, weights=lengths[bins >= 0]).astype(np.int64) if len(dense) else np.empty(0, np.int64)
    store = Bins(capacity, used)
    keys = lengths if order is None else order
    for i in free[np.argsort(-keys[free], kind="stable")]:
        out[i] = store.place(int(lengths[i]))
    return out


def score(bins: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones; smaller is better."""
    used = np.bincount(bins, weights=lengths)
    return len(used), -float(np.square(used / capacity).sum())


def crossover(a: np.ndarray, b: np.ndarray, lengths: np.ndarray, p: Parameters, rng: np.random.Generator) -> np.ndarray:
    """b with some of a's fullest bins injected whole."""
    used = np.bincount(a, weights=lengths)
    n = max(1, int(p.injected * len(used)))
    chosen = np.zeros(len(used), bool)
    chosen[np.argsort(-used + rng.random(len(used)) * 0.02 * p.capacity)[:n]] = True
    given = chosen[a]
    broken = np.zeros(int(b.max()) + 1, bool)
    broken[b[given]] = True
    child = np.where(given, a + len(broken), np.where(broken[b], -1, b))
    return close(child, lengths, p.capacity, rng)


def mutate(bins: np.ndarray, lengths: np.ndarray, p: Parameters, rng: np.random.Generator) -> np.ndarray:
    """The emptiest bins and a few others lose their pieces."""
    used = np.bincount(bins, weights=lengths)
    gone = np.zeros(len(used), bool)
    gone[np.argsort(used)[:3]] = True
    gone |= rng.random(len(used)) < np.where(used < p.capacity, 0.3, p.mutated)
    return close(np.where(gone[bins], -1, bins), lengths, p.capacity, rng)


def found(lengths: np.ndarray, island: int, p: Parameters, rng: np.random.Generator) -> list[np.ndarray]:
    """An island's first individuals: best fit decreasing on the first island, closely filled bins on the others; more of these, if the first is not at the bound."""
    none = np.full(len(lengths), -1, np.int32)
    least = -(-int(lengths.sum()) // p.capacity)
    out = [close(none, lengths, p.capacity, rng) if island else refill(none, np.arange(len(lengths)), lengths, p.capacity)]
    while len(out) < p.population and score(out[0], lengths, p.capacity)[0] > least:
        out.append(close(none, lengths, p.capacity, rng))
    return out


def evolve(lengths: np.ndarray, population: list[np.ndarray], p: Parameters, rng: np.random.Generator, island: int = 0) -> list[np.ndarray]:
    """One epoch of an island; an empty population is founded first."""
    least = -(-int(lengths.sum()) // p.capacity)
    rate = lambda x: score(x, lengths, p.capacity)
    population = sorted(population or found(lengths, island, p, rng), key=rate)
    for _ in range(p.offspring):
        if rate(population[0])[0] <= least:
            break
        a, b = rng.choice(len(population), 2, replace=len(population) < 2)
        child = mutate(crossover(population[a], population[b], lengths, p, rng), lengths, p, rng)
        population = sorted([*population, child], key=rate)[: p.population]
    return population


STATE = "shard long, island int, migrant boolean, items binary, lengths binary, genomes binary"


def _state_batch(rows: list[tuple]) -> pa.RecordBatch:
    schema = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("migrant", pa.bool_()), ("items", pa.binary()), ("lengths", pa.binary()), ("genomes", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _epoch(p: Parameters, epoch: int):
    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        home = next(r for r in rows if not r["migrant"])
        lengths = np.frombuffer(home["lengths"], np.int64)
        own = np.frombuffer(home["genomes"], np.int32).reshape(-1, len(lengths))
        guests = sorted(r["genomes"] for r in rows if r["migrant"])
        population = [*own, *(np.frombuffer(g, np.int32) for g in guests)]
        rng = np.random.default_rng([home["shard"] % 2**63, home["island"], epoch])
        population = [g.astype(np.int32) for g in evolve(lengths, population, p, rng, home["island"])]
        out = [(home["shard"], home["island"], False, home["items"], home["lengths"], np.concatenate(population).tobytes())]
        if p.islands > 1:
            out.append((home["shard"], (home["island"] + 1) % p.islands, True, None, None, population[0].tobytes()))
        return pa.Table.from_batches([_state_batch(out)])

    return run


def _islands(p: Parameters):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("item")
        items = table["item"].to_numpy().astype(np.int64).tobytes()
        lengths = table["length"].to_numpy().astype(np.int64).tobytes()
        shard = table["shard"][0].as_py()
        return pa.Table.from_batches([_state_batch([(shard, i, False, items, lengths, b"") for i in range(p.islands)])])

    return run


def _best(p: Parameters, last: bool):
    """item, bin (null: given back), offset and seq of a shard's best individual."""

    def run(table: pa.Table) -> pa.Table:
        rows = [r for r in table.to_pylist() if not r["migrant"]]
        lengths, items = np.frombuffer(rows[0]["lengths"], np.int64), np.frombuffer(rows[0]["items"], np.int64)
        found = [g for r in sorted(rows, key=lambda r: r["island"]) for g in np.frombuffer(r["genomes"], np.int32).reshape(-1, len(lengths))]
        best = min(found, key=lambda g: score(g, lengths, p.capacity))
        used = np.bincount(best, weights=lengths)
        good = np.full(len(used), True)
        if not last:  # the emptiest bins give back at most half of the pieces, so each level has at most half of those of the one before
            emptiest = np.argsort(used, kind="stable")
            half = np.cumsum(np.bincount(best)[emptiest]) <= len(best) // 2
            good[emptiest[half & (used[emptiest] < p.well_filled * p.capacity)]] = False
        order = np.argsort(best, kind="stable")
        ends = np.cumsum(lengths[order])
        first = np.concatenate([[0], np.cumsum(np.bincount(best))[:-1]])
        before = (ends - lengths[order]) - (ends - lengths[order])[first][best[order]]
        offset = np.empty(len(best), np.int64)
        offset[order] = before
        lead = np.full(len(used), np.iinfo(np.int64).max)
        np.minimum.at(lead, best, items)
        return pa.table({"item": items, "length": lengths, "sequence_id": lead[best], "offset": offset, "placed": good[best]})

    return run


def pack_items(items: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """item, sequence_id (the smallest item in it) and offset. items: item and length, at most the capacity each."""
    whole = items.filter(F.col("length") >= p.capacity).select("item", F.col("item").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    done, rest, level = [whole], items.filter(F.col("length") < p.capacity).select("item", "length"), 0
    n = rest.count()
    while n:
        shards = -(-n // p.shard_pieces)
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("item", F.lit(level)), F.lit(shards)))
        state = written(dealt.groupBy("shard").applyInArrow(_islands(p), STATE))
        for epoch in range(p.epochs):
            state = written(state.groupBy("shard", "island").applyInArrow(_epoch(p, epoch), STATE))
        packed = written(state.groupBy("shard").applyInArrow(_best(p, shards == 1), "item long, length long, sequence_id long, offset long, placed boolean"))
        left = packed.filter("not placed").count() if shards > 1 else 0
        done.append(packed.filter("placed").select("item", "sequence_id", "offset"))
        rest, n, level = packed.filter("not placed").select("item", "length"), left, level + 1
    return reduce(DataFrame.unionByName, done)


def pack(docs: DataFrame, tokenizer: str, p: Parameters = Parameters()) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset, one row per piece."""
    items = written(pieces(docs, tokenizer, p))
    placed = pack_items(items, p)
    return items.join(placed, "item").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
