"""Operator 5: exact Jaccard join of documents' word shingles, and the components of its links.

The join follows set relations, after a reduction that every document passes through in bounded pieces:

1. Equal sets are one class (a 64-bit fingerprint of the sorted shingles); copies are never compared.
2. One pass over the texts deals shingles to buckets by their hash, packed per task, each set once a pack. A bucket counts in how
   many sets each shingle is and drops those of one set only: they can't be common to two. The others go back to their pack.
3. A class whose shared shingles are under the threshold's part of its size can't link with any other and leaves. The rest is
   kept as a core: its shared shingles, rarest first. A class stands in the lists of its first core shingles (prefix filter).
4. Classes that share a list form candidate groups (contracting star rounds over lists and classes; no pairs are made).
5. Within a group, index lists are ordered by how many shingles of a set are left from the list's position, so that a list is
   read only as far as a link is still possible (position skipping); and the answers of a set are derived from those of a
   similar one: its intersections with all sets are that one's, less the lists of shingles which only that one has, plus the lists
   of those which only it has. Links are few lists apart, so a large group costs little more than its first set.
   A group of over GROUP_ROWS classes or GROUP_BYTES is dealt to blocks by MIXES different hashes, each block one task: near copies of one
   another find together, each class being sent MIXES times. Only lists with classes of different components are then left; what they
   hold goes to blocks again, by component, and each pair of blocks that aren't of the same component is one task of bounded size.

Defined results: a text without words, or null, has the empty set and is linked with nothing, not even with other empty ones.
Repeated rows are copies. component_id is the smallest doc_id of a component (nulls don't count, unless there is no other).
An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import documents, map_batches, window_hashes, written

WIDTH = 5
#: Sets link at intersection / union >= NUM / DEN.
NUM, DEN = 4, 5
#: Shingles that a map task packs before it sends them on; shingles to a bucket; classes and bytes that one group task holds;
#: by how many hashes a larger group is dealt to blocks.
FLUSH = 2_000_000
BUCKET_SHINGLES = 2_000_000
GROUP_ROWS = 1024
GROUP_BYTES = 64_000_000
MIXES = 2
_KNOWN_WORDS = 300_000
#: Up to so many candidates of a set are compared with it one by one; its intersections with all sets are worth their cost beyond.
FEW = 4


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a fixed number."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= _KNOWN_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str | None, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of the 5-word shingles of a text, A-Z lowered; a shorter text is one shingle."""
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    found = np.sort(window_hashes(h, min(WIDTH, len(words))))
    return found[np.append(True, found[1:] != found[:-1])]


def need(a, b):
    """Least intersection of linked sets of these sizes."""
    return -(-NUM * (a + b) // (NUM + DEN))


def fingerprint(found: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(found.tobytes()) if len(found) else 0


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _emit(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def _runs(x: np.ndarray) -> np.ndarray:
    """Where each run of equal values starts, and the end."""
    return np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)


def _small(x: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest needs; the reader knows how many there are."""
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32) if x.max() <= np.iinfo(t).max)).tobytes()


def _from_small(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(data, {1: np.uint8, 2: np.uint16, 4: np.uint32}[len(data) // n])


PACKED = "bucket int, pack long, runs int, places binary, counts binary, values binary"
#: A document in the head of its pack; place is that of its set, -1 for the empty one.
DOCUMENT = np.dtype([("doc_id", np.int64), ("none", np.bool_), ("text_hash", np.int64), ("place", np.int32)])


def _packed(docs: DataFrame, n_buckets: int) -> DataFrame:
    """Shingles (upper 48 bits) by bucket, packed: a pack holds the distinct sets that a task has met since its last one.

    A row has the places of sets in the pack, their numbers of shingles in the bucket, and these. One row per pack, with a bucket
    below 0, is its head: its documents, and the fingerprints and sizes of its sets.
    """
    schema = pa.schema([("bucket", pa.int32()), ("pack", pa.int64()), ("runs", pa.int32()), ("places", pa.binary()), ("counts", pa.binary()), ("values", pa.binary())])

    def flush(pack: int, sets: dict[int, np.ndarray], heads: list[tuple]) -> pa.RecordBatch:
        sizes = np.array([len(s) for s in sets.values()], np.int64)
        out = {"bucket": [-1 - pack % n_buckets], "pack": [pack], "runs": [len(sets)], "places": [np.array(heads, DOCUMENT).tobytes()],
               "counts": [sizes.astype(np.uint32).tobytes()], "values": [np.fromiter(sets, np.uint64, len(sets)).tobytes()]}
        every = np.concatenate([np.empty(0, np.uint64), *sets.values()]) >> np.uint64(16)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        bucket = (every % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        every, owner, bucket = every[order], owner[order], bucket[order]
        six = every.view(np.uint8).reshape(-1, 8)[:, :6]
        at = _runs(bucket)
        for a, b in zip(at[:-1], at[1:], strict=True):  # no bucket if all sets are empty
            inner = _runs(owner[a:b])
            out["bucket"].append(int(bucket[a]))
            out["pack"].append(pack)
            out["runs"].append(len(inner) - 1)
            out["places"].append(_small(owner[a:b][inner[:-1]]))
            out["counts"].append(_small(np.diff(inner)))
            out["values"].append(six[a:b].tobytes())
        return _emit(schema, **out)

    def run(batches):
        known, sets, places, heads, total, pack = WordHashes(), {}, {}, [], 0, TaskContext.get().partitionId() << 24
        for batch in batches:
            for doc_id, text, text_hash in zip(*(batch[k].to_pylist() for k in ("doc_id", "text", "text_hash")), strict=True):
                s = shingles(text, known)
                fp = fingerprint(s)
                if len(s) and fp not in sets:
                    places[fp] = len(sets)
                    sets[fp] = s
                    total += len(s)
                heads.append((doc_id or 0, doc_id is None, text_hash, places[fp] if len(s) else -1))
                if total >= FLUSH or len(heads) >= FLUSH // 8:
                    yield flush(pack, sets, heads)
                    sets, places, heads, total, pack = {}, {}, [], 0, pack + 1
        if heads:
            yield flush(pack, sets, heads)

    texts = documents(docs, "doc_id", "text").withColumn("text_hash", F.xxhash64(F.col("doc_id").isNull(), "text"))
    return texts.mapInArrow(run, PACKED)


def _read_six(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8).reshape(-1, 6)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :6] = raw
    return out.reshape(-1).view(np.uint64)


def _shared(packed: DataFrame, partitions: int) -> DataFrame:
    """The shingles that two or more sets have, back by pack: places, and words (shingle << 16 | number of sets, at most 65535).

    Copies in different packs count as sets here; that keeps more than needed, never less. Rows with sizes pass on the packs' heads.
    Buckets go to partitions by their number, so each partition has as many as the next.
    """
    schema = pa.schema([("pack", pa.int64()), ("places", pa.binary()), ("sizes", pa.binary()), ("words", pa.binary())])

    def count(rows: list) -> pa.RecordBatch:
        h = np.concatenate([_read_six(v) for *_, v in rows])
        row = np.repeat(np.arange(len(rows)), [len(v) // 6 for *_, v in rows])
        place = np.concatenate([np.repeat(_from_small(p, n), _from_small(c, n)) for _, n, p, c, _ in rows]).astype(np.uint32)
        order = np.argsort(h, kind="stable")
        n = np.diff(_runs(h[order]))
        sets = np.empty(len(h), np.int64)
        sets[order] = np.repeat(n, n)
        shared = sets > 1
        words = h[shared] << np.uint64(16) | np.minimum(sets[shared], 65535).astype(np.uint64)
        row, place = row[shared], place[shared]
        at = _runs(row)
        spans = list(zip(at[:-1], at[1:], strict=True)) if len(row) else []
        return _emit(schema, pack=[rows[row[a]][0] for a, _ in spans], places=[place[a:b].tobytes() for a, b in spans], sizes=[None] * len(spans), words=[words[a:b].tobytes() for a, b in spans])

    def run(batches):
        now, rows = None, []
        for batch in batches:
            for bucket, *row in zip(*(batch[k].to_pylist() for k in ("bucket", "pack", "runs", "places", "counts", "values")), strict=True):
                if bucket != now and rows:
                    yield count(rows)
                    rows = []
                now = bucket
                if bucket < 0:
                    yield _emit(schema, pack=[row[0]], places=[row[2]], sizes=[row[3]], words=[row[4]])
                else:
                    rows.append(row)
        if rows:
            yield count(rows)

    dealt = packed.repartitionById(partitions, F.pmod("bucket", F.lit(partitions))).sortWithinPartitions("bucket")
    return dealt.mapInArrow(run, "pack long, places binary, sizes binary, words binary")


#: Rows of documents have no core, those of sets have neither doc_id nor text_hash.
SETTLED = "doc_id long, text_hash long, fp long, n long, core binary"


def _settled(shared: DataFrame, partitions: int) -> DataFrame:
    """Every document with its set's fp and size; and fp, n and core of the sets that may link with others, at least once each.

    core: 48-bit shingles, fewest sets first.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.int64()), ("n", pa.int64()), ("core", pa.binary())])

    def owners(docs: bytes, fps: np.ndarray, sizes: np.ndarray) -> pa.RecordBatch:
        d = np.frombuffer(docs, DOCUMENT)
        fp, n = (np.append(x, 0)[d["place"]] for x in (fps, sizes.astype(np.int64)))  # place -1 is the 0 at the end
        return pa.RecordBatch.from_arrays([pa.array(d["doc_id"], mask=d["none"]), pa.array(d["text_hash"]), pa.array(fp), pa.array(n), pa.nulls(len(d), pa.binary())], schema=schema)

    def settle(heads: tuple | None, places: list, words: list) -> Iterator[pa.RecordBatch]:
        if not heads:
            return
        docs, fps, sizes = heads
        yield owners(docs, fps, sizes)
        if not places:
            return
        place, w = np.concatenate(places), np.concatenate(words)
        order = np.lexsort((w >> np.uint64(16), w & np.uint64(65535), place))
        place, w = place[order], w[order] >> np.uint64(16)
        at = _runs(place)
        out = defaultdict(list)
        for a, b in zip(at[:-1], at[1:], strict=True):
            n = int(sizes[place[a]])
            if b - a >= -(-NUM * n // DEN):
                for k, v in (("doc_id", None), ("text_hash", None), ("fp", int(fps[place[a]])), ("n", n), ("core", w[a:b].tobytes())):
                    out[k].append(v)
        if out:
            yield _emit(schema, **out)

    def run(batches):
        now, heads, places, words = None, None, [], []
        for batch in batches:
            for pack, p, sizes, w in zip(*(batch[k].to_pylist() for k in ("pack", "places", "sizes", "words")), strict=True):
                if pack != now:
                    yield from settle(heads, places, words)
                    now, heads, places, words = pack, None, [], []
                if sizes is not None:
                    heads = p, np.frombuffer(w, np.int64), np.frombuffer(sizes, np.uint32)
                else:
                    places.append(np.frombuffer(p, np.uint32))
                    words.append(np.frombuffer(w, np.uint64))
        yield from settle(heads, places, words)

    dealt = shared.repartition(partitions, "pack").sortWithinPartitions("pack")
    return dealt.mapInArrow(run, SETTLED)


def prefix_length(n: int, core: int) -> int:
    """How many core shingles are in the prefix; shingles of one class only come first and take the rest of it."""
    return n - -(-NUM * n // DEN) + 1 - (n - core)


def _lists(cores: DataFrame) -> DataFrame:
    """list (a shingle) and v (a class) for each prefix shingle of each core."""

    def rows(batch) -> dict:
        cores_ = [np.frombuffer(c, np.uint64) for c in batch["core"].to_pylist()]
        heads = [c[: prefix_length(n, len(c))] for c, n in zip(cores_, batch["n"].to_pylist(), strict=True)]
        fps = np.repeat(np.array(batch["fp"].to_pylist(), np.int64), [len(h) for h in heads])
        return {"list": _signed(np.concatenate(heads)), "v": fps}

    return map_batches(cores.select("fp", "n", "core"), "list long, v long", rows)


def groups_of(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """v and root for every v of edges(list, v) that shares a list with another, directly or through others.

    Each round moves a class to the smallest class of its lists and merges equal rows, so the lists shrink; ids are hashes, which
    makes the expected number of rounds logarithmic. Every round is written, so a lost executor costs one round at most.
    """
    moves: list[DataFrame] = []
    for _ in range(max_rounds):
        ends = edges.groupBy("list").agg(F.min("v").alias("m"), F.max("v").alias("x")).filter("m < x").drop("x")
        edges = written(edges.join(ends, "list"))
        if edges.isEmpty():
            break
        moves.append(written(edges.groupBy("v").agg(F.min("m").alias("to"))))
        edges = edges.drop("m").join(moves[-1], "v").select("list", F.col("to").alias("v")).distinct()
    else:
        raise RuntimeError("groups did not settle")
    if not moves:
        return edges.select("v", F.col("v").alias("root"))

    def then(a: DataFrame, b: DataFrame) -> DataFrame:
        nxt = b.select(F.col("v").alias("to"), F.col("to").alias("further"))
        return a.join(nxt, "to", "left").select("v", F.coalesce("further", "to").alias("to"))

    return written(reduce(then, moves).withColumnRenamed("to", "root"))


class Group:
    """Sets of one candidate group in memory, with two indexes: all shingles, and prefixes ordered by what is left."""

    def __init__(self, sizes: np.ndarray, cores: list[np.ndarray]):
        self.n = sizes
        self.m = len(cores)
        lengths = np.array([len(c) for c in cores])
        every = np.concatenate(cores)
        _, token = np.unique(every, return_inverse=True)
        self.at = np.concatenate([[0], np.cumsum(lengths)])
        self.token = token
        owner = np.repeat(np.arange(self.m), lengths)
        order = np.argsort(token, kind="stable")
        self.docs = owner[order]
        self.start = np.concatenate([[0], np.cumsum(np.bincount(token))])
        self.first = np.array([prefix_length(int(n), int(c)) for n, c in zip(sizes, lengths, strict=True)])
        place = np.arange(len(every)) - self.at[owner]
        head = place < self.first[owner]
        left = lengths[owner] - place
        t, d, r = token[head], owner[head], left[head]
        order = np.lexsort((-r, t))
        self.head_doc, self.head_left = d[order], r[order]
        self.head_start = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(self.start) - 1))])

    def candidates(self, x: int) -> np.ndarray:
        """Sets whose first common shingle with x leaves enough on both sides."""
        n, a = int(self.n[x]), self.at[x]
        core, found = self.at[x + 1] - a, []
        least = -(-NUM * n // DEN)
        for q in range(self.first[x]):
            if core - q < least:
                break
            t = self.token[a + q]
            lo, hi = self.head_start[t], self.head_start[t + 1]
            end = lo + np.searchsorted(-self.head_left[lo:hi], -least, side="right")
            if end - lo > 1:
                found.append(self.head_doc[lo:end])
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)

    def postings(self, tokens: np.ndarray) -> np.ndarray:
        """How many of these shingles each set has."""
        lists = [self.docs[self.start[t] : self.start[t + 1]] for t in tokens]
        return np.bincount(np.concatenate(lists), minlength=self.m) if lists else np.zeros(self.m, np.int64)

    def tokens(self, x: int) -> np.ndarray:
        return self.token[self.at[x] : self.at[x + 1]]

    def overlaps(self, x: int, pivot: int | None, known: np.ndarray | None) -> np.ndarray:
        """Exact intersection sizes of x with every set: the pivot's, less what only the pivot has, plus what only x has."""
        if known is None:
            return self.postings(self.tokens(x))
        gone, come = (np.setdiff1d(self.tokens(p), self.tokens(q), assume_unique=True) for p, q in ((pivot, x), (x, pivot)))
        return known - self.postings(gone) + self.postings(come)

    def components(self) -> np.ndarray:
        """A component number for each set."""
        label = np.full(self.m, -1)
        for seed in np.argsort(-self.n, kind="stable"):
            if label[seed] >= 0:
                continue
            label[seed] = seed
            waiting = [(seed, None, None)]
            while waiting and (label < 0).any():
                x, pivot, known = waiting.pop()
                if known is None:
                    open_ = self.candidates(x)
                    open_ = open_[label[open_] < 0]
                else:  # a derived answer covers all sets, so no list is searched
                    open_ = np.flatnonzero(label < 0)
                if known is None and len(open_) <= FEW:
                    own = self.tokens(x)
                    common = np.array([np.isin(self.tokens(y), own).sum() for y in open_], np.int64)
                else:
                    known = self.overlaps(x, pivot, known)
                    common = known[open_]
                hit = open_[(NUM + DEN) * common >= NUM * (self.n[x] + self.n[open_])]
                label[hit] = seed
                waiting += [(y, x, known) for y in hit]
        return label


def _linked(grouped: DataFrame, partitions: int) -> DataFrame:
    """fp and seed, a class of its local component, for classes that have links, from rows of (task, fp, n, core)."""
    schema = pa.schema([("fp", pa.int64()), ("seed", pa.int64())])

    def solve(rows: dict) -> Iterator[pa.RecordBatch]:
        if len(rows) < 2:
            return
        fps = np.array(sorted(rows), np.int64)
        sets = [rows[f] for f in fps.tolist()]
        label = Group(np.array([n for n, _ in sets]), [np.frombuffer(c, np.uint64) for _, c in sets]).components()
        keep = np.flatnonzero(np.bincount(label, minlength=len(fps))[label] > 1)
        if len(keep):
            yield _emit(schema, fp=fps[keep], seed=fps[label[keep]])

    def run(batches):
        now, rows = None, {}
        for batch in batches:
            for task, fp, n, core in zip(*(batch[k].to_pylist() for k in ("task", "fp", "n", "core")), strict=True):
                if task != now:
                    yield from solve(rows)
                    now, rows = task, {}
                rows[fp] = n, core
        yield from solve(rows)

    dealt = grouped.select("task", "fp", "n", "core").repartition(partitions, "task").sortWithinPartitions("task")
    return dealt.mapInArrow(run, "fp long, seed long")


def _size(members: str, of_bytes: str, group_rows: int):
    """Blocks of half a task's size for so many classes and bytes, so that two blocks fit a task."""
    return F.ceil(F.greatest(2 * F.col(members) / group_rows, 2 * F.col(of_bytes) / GROUP_BYTES)).cast("int")


def _seeds(links: DataFrame) -> DataFrame:
    """fp and seed by links (fp, seed) of different tasks: linked classes have one seed."""
    edges = links.select(F.xxhash64("fp", "seed").alias("list"), F.explode(F.array("fp", "seed")).alias("v"))
    return groups_of(edges).select(F.col("v").alias("fp"), F.col("root").alias("seed"))


def _between(large: DataFrame, seeds: DataFrame, lists: DataFrame, group_rows: int) -> DataFrame:
    """Tasks (task, fp, n, core) that hold every pair of classes of large(fp, n, core) that may link and have different seeds.

    Lists within one component are settled. What the other lists hold together is dealt to blocks: a component of over half a task has blocks of its own,
    the rest shares some. Pairs of blocks are tasks, but for blocks of the same component.
    """
    known = lists.withColumnRenamed("v", "fp").join(large.select("fp"), "fp", "left_semi").join(seeds, "fp", "left").withColumn("seed", F.coalesce("seed", "fp"))
    open_ = known.groupBy("list").agg(F.min("seed").alias("a"), F.max("seed").alias("z")).filter("a < z").select("list")
    left = written(known.join(open_, "list"))
    roots = groups_of(left.select("list", F.col("fp").alias("v"))).select(F.col("v").alias("fp"), "root")
    classes = left.select("fp", "seed").distinct().join(roots, "fp").join(large, "fp")
    parts = classes.groupBy("root", "seed").agg(F.count("*").alias("members"), F.sum(F.length("core")).alias("bytes"))
    parts = written(parts.withColumn("own", (2 * F.col("members") > group_rows) | (2 * F.col("bytes") > GROUP_BYTES)))
    blocks = parts.groupBy("root", F.when(F.col("own"), F.col("seed")).alias("key")).agg(F.sum("members").alias("members"), F.sum("bytes").alias("bytes"))
    blocks = blocks.select("root", "key", _size("members", "bytes", group_rows).alias("blocks"))
    by_root = Window.partitionBy("root")
    until = F.sum("blocks").over(by_root.orderBy("key").rowsBetween(Window.unboundedPreceding, 0))
    blocks = blocks.select("root", "key", "blocks", (until - F.col("blocks")).alias("first"), F.sum("blocks").over(by_root).alias("of"))
    placed = classes.join(parts.select("root", "seed", F.when(F.col("own"), F.col("seed")).alias("key")), ["root", "seed"])
    placed = placed.join(blocks.withColumnsRenamed({"root": "_root", "key": "_key"}), (F.col("root") == F.col("_root")) & F.col("key").eqNullSafe(F.col("_key")))
    own = F.col("first") + F.pmod(F.xxhash64("fp"), "blocks")
    meets = F.filter(F.sequence(F.lit(0).cast("bigint"), F.col("of") - 1), lambda j: F.col("key").isNull() | (j < F.col("first")) | (j >= F.col("first") + F.col("blocks")))
    task = F.transform(meets, lambda j: F.xxhash64("root", F.least(own, j), F.greatest(own, j)))
    return placed.select(F.explode(task).alias("task"), "fp", "n", "core")


def class_links(cores: DataFrame, partitions: int, group_rows: int = GROUP_ROWS) -> DataFrame:
    """fp and seed: classes that are linked, directly or through others, have the same seed."""
    lists = _lists(cores)
    roots = groups_of(lists).withColumnRenamed("v", "fp")
    placed = cores.dropDuplicates(["fp"]).join(roots, "fp")
    sizes = cores.select("fp", F.length("core").alias("b")).distinct().join(roots, "fp")
    sizes = sizes.groupBy("root").agg(F.count("*").alias("members"), F.sum("b").alias("bytes"))
    big = (F.col("members") > group_rows) | (F.col("bytes") > GROUP_BYTES)
    large = written(sizes.filter(big).select("root", _size("members", "bytes", group_rows).alias("blocks")))
    if large.isEmpty():
        return written(_linked(placed.withColumn("task", F.col("root")), partitions))
    placed = placed.join(large, "root", "left")
    mixes = [F.xxhash64("root", F.pmod(F.xxhash64("fp", F.lit(k)), "blocks"), F.lit(k)) for k in range(MIXES)]
    task = F.when(F.col("blocks").isNull(), F.array("root")).otherwise(F.array(*mixes))
    within = written(_linked(placed.withColumn("task", F.explode(task)), partitions))
    split = written(placed.filter("blocks IS NOT NULL").select("fp", "n", "core"))
    across = written(_linked(_between(split, _seeds(within), lists, group_rows), partitions))
    return _seeds(within.unionByName(across))


def keep_one(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The rows of docs with one row left of each component, that of its smallest doc_id; rows with an empty set all stay.

    Components are told apart by their seeds: those without ids, or with the same id, have equal component_ids. Ids and text hashes of the rows that go or stay are joined to the texts, which are shuffled once.
    """
    key = [F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("_id"), F.xxhash64(F.col("doc_id").isNull(), F.col("text").cast("string")).alias("_hash")]
    found = jaccard_components(docs, group_rows, with_keys=True)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash"))
    full = found.filter("n_shingles > 0")
    stays = full.groupBy("seed").agg(first.alias("x")).select(F.coalesce("x.doc_id", F.lit(0)).alias("_id"), F.col("x.text_hash").alias("_hash"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), *key)
    worded = F.regexp_like(F.coalesce(F.col("_row.text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]"))
    kept = rows.filter(worded).join(stays, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"])
    return kept.unionByName(rows.filter(~worded)).select("_row.*")


def jaccard_components(docs: DataFrame, group_rows: int = GROUP_ROWS, with_keys: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and class_id (the smallest doc_id with an equal set), one row per row of docs.

    On request also text_hash and seed, which tells components apart.
    """
    # A text has about a shingle in six bytes. Buckets and packs grow in number with the data, not in size.
    total = (docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first()["n"] or 0) // 6
    partitions = max(8, -(-total // BUCKET_SHINGLES))
    settled = written(_settled(_shared(_packed(docs, partitions), partitions), max(8, -(-total // (FLUSH // 2)))))
    found = settled.filter("core IS NULL").select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "fp")
    cores = settled.filter("core IS NOT NULL").select("fp", "n", "core")
    classes = written(found.groupBy("fp", "n_shingles").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies")))
    links = class_links(cores, partitions, group_rows)
    named = classes.join(links, "fp", "left").withColumn("seed", F.coalesce("seed", "fp"))
    least = named.groupBy("seed").agg(F.min("first").alias("component_id"))
    named = named.select("fp", "seed", "first").join(least, "seed").select("fp", "seed", "component_id", "first")
    out = found.join(named, "fp")
    own = lambda x: F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col(x))
    return out.select("doc_id", "n_shingles", own("component_id").alias("component_id"), own("first").alias("class_id"), *["text_hash", "seed"] * with_keys)


SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_sort(list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')))) END AS g FROM w),
n AS (SELECT doc_id, len(g)::BIGINT AS n_shingles, CASE WHEN len(g) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY g) END AS class_id FROM s),
x AS (SELECT doc_id, unnest(g) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n_shingles + nb.n_shingles - c)),
l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id, doc_id AS root FROM n UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.doc_id AND r.root < l.b)
SELECT doc_id, n_shingles, min(root) AS component_id, any_value(class_id) AS class_id FROM r JOIN n USING (doc_id) GROUP BY doc_id, n_shingles"""
