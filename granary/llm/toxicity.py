"""Operator 6: toxicity by the nearest labelled examples.

1. Examples. A bounded sample of training documents, up to `index_each` of either label, stands for the rest; each with all its words,
   A-Z lowered and without closing punctuation.
2. Vectors. Every whole text becomes its counts of words; weights are TF-IDF with document frequencies over all documents. Words of the examples
   are numbered; the others, of which no example has any, only count for a text's length: their frequencies are joined by a hash.
3. Index. Inverted lists: per word the examples that have it, by blocks, with the word's largest weight per block. A query adds these to upper
   bounds, visits the blocks of the highest bounds, then those whose bound reaches the k-th cosine found: the k nearest are exact.
   Words that many examples have are columns of a matrix instead: a batch's products with it are the exact part of every bound.
4. Votes. The neighbours' labels are weighted by the square of their cosine. The share and the text's lean (the largest of its words' smoothed log odds
   among the examples) become a probability by a logistic regression over all training documents; one that is an example itself is left out of
   its own neighbours and odds. The nearest examples are kept as evidence.

Training rows are those whose crc32(doc_id as text) mod 5 is not 0; labels of the others are never read.

Defined results: a null or empty text, or one without words of the examples, has no neighbours and gets the calibrated score of such texts. Null
ids are never training rows and count as held out. Without training labels all scores are 0. Conflicting labels count as toxic. Repeated rows give repeated rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import Recent, discard, documents, map_batches, written


@dataclass(frozen=True)
class Parameters:
    """index_each: examples of either label in the index; the only bound on what is learnt from."""

    index_each: int = 2048
    k: int = 15
    block: int = 64


#: Added to a word's numbers of toxic and of clean examples, so that rare words have odds near 1.
ODDS_PRIOR = 4.0
#: Blocks visited before the others are compared with the k-th cosine.
FIRST_BLOCKS = 4
#: Classes of votes in which labels are counted for the calibration, which sees each class's means.
CELLS = 64
#: Marks hashes of words that no example has; numbers are below.
OTHER = 1 << 63


def term_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest((word.rstrip(b".,;:!?*$%&#") or word).decode().lower().encode())


class WordTerms(Recent):
    """The number of a word that examples have, else its hash, marked."""

    def __init__(self, hashes: np.ndarray):
        super().__init__()
        self.numbers = {h: i for i, h in enumerate(hashes.tolist())}

    def compute(self, word: bytes) -> int:
        h = term_hash(word)
        return self.numbers.get(h, h | OTHER)


def training(labels: DataFrame) -> DataFrame:
    """doc_id and toxic of the rows that may be learnt from."""
    rows = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    return rows.filter(F.crc32(F.col("doc_id").cast("string")) % 5 != 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))


def _first(rows: DataFrame, n: int) -> DataFrame:
    """n rows of either label in the order of a hash."""
    order = [F.xxhash64("doc_id", F.lit("index")), F.col("doc_id")]
    half = lambda y: rows.filter(F.col("toxic") == y).orderBy(*order).limit(n)
    return written(half(1).unionByName(half(0)))


def example_rows(docs: DataFrame, learn: DataFrame, p: Parameters) -> dict[str, list]:
    """doc_id, toxic, hashes (of all words, distinct) of at most 2 * index_each training documents with words, and counts."""
    texts = documents(docs, "doc_id", "text").filter(F.regexp_like(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]")))
    picked = _first(texts.select("doc_id").join(learn, "doc_id").distinct(), p.index_each)

    def rows(batch) -> dict:
        found = [Counter(map(term_hash, t.encode().split())) for t in batch["text"].to_pylist()]
        hashes = [np.array(list(f), np.uint64).view(np.int64) for f in found]
        return {"doc_id": batch["doc_id"], "toxic": batch["toxic"], "hashes": hashes, "counts": [list(f.values()) for f in found]}

    taken = texts.join(F.broadcast(picked), "doc_id").dropDuplicates(["doc_id"])  # bounded, hence the broadcast
    out = map_batches(taken, "doc_id long, toxic int, hashes array<long>, counts array<int>", rows).toArrow()
    return out.sort_by("doc_id").to_pydict()


def vectors(docs: DataFrame, hashes: np.ndarray) -> DataFrame:
    """row (a number), doc_id, terms and counts (arrays) of every whole text, and the same of words that no example has (others: hashes)."""
    sent = docs.sparkSession.sparkContext.broadcast(hashes)

    def rows(batch, state: dict) -> dict:
        words, n = state["words"], batch.num_rows
        columns = {c: [] for c in ("terms", "counts", "others", "other_counts")}
        for text in batch["text"].to_pylist():
            tokens = text.encode().split() if text else []
            found, counts = np.unique(np.fromiter(map(words.__getitem__, tokens), np.uint64, len(tokens)), return_counts=True)
            at = np.searchsorted(found, np.uint64(OTHER))
            for c, x in (("terms", found[:at].astype(np.int32)), ("counts", counts[:at].astype(np.int32)), ("others", found[at:].view(np.int64)), ("other_counts", counts[at:].astype(np.int32))):
                columns[c].append(x)
        state["next"] += n
        return {"row": np.arange(state["next"] - n, state["next"]), "doc_id": batch["doc_id"]} | columns

    schema = "row long, doc_id long, terms array<int>, counts array<int>, others array<long>, other_counts array<int>"
    return map_batches(documents(docs, "doc_id", "text"), schema, rows, lambda: {"words": WordTerms(sent.value), "next": TaskContext.get().partitionId() << 36})


def frequencies(found: DataFrame, n_terms: int) -> np.ndarray:
    """In how many documents each numbered term is."""

    def run(batches):
        total = np.zeros(n_terms, np.int64)
        for batch in batches:
            total += np.bincount(batch["terms"].flatten().to_numpy(), minlength=n_terms)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["term", "n"])

    rows = found.select("terms").mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(n_terms, np.int64)
    out[rows["term"].to_numpy()] = rows["n"].to_numpy()
    return out


def other_squares(found: DataFrame, n: int) -> DataFrame:
    """row and rest: the sum of squared weights of a text's words that no example has."""
    pairs = found.select("row", F.explode(F.arrays_zip("others", "other_counts")).alias("x")).select("row", F.col("x.others").alias("h"), F.col("x.other_counts").alias("c"))
    seen = pairs.groupBy("h").agg(F.count("*").alias("df"))
    weight = (1 + F.log("c")) * (F.log((1 + n) / (1 + F.col("df"))) + 1)
    return pairs.join(seen, "h").groupBy("row").agg(F.sum(weight * weight).alias("rest"))


def _ranges(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges in turn, and each range's length."""
    n = ends - starts
    return np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()), n


#: Words in so large a part of the examples have no lists but columns of a matrix, whose products with a batch's texts are exact.
COMMON = 1 / 32


@dataclass
class Index:
    """Examples in blocks. A term's entries, one per block, hold the block, the largest weight, and where its list of examples starts.

    Terms that many examples have (column: their place, else -1) stand in `dense`, a row an example.
    """

    idf: np.ndarray
    ids: np.ndarray
    toxic: np.ndarray
    entry_at: np.ndarray
    entry_block: np.ndarray
    entry_top: np.ndarray
    list_at: np.ndarray
    places: np.ndarray
    weights: np.ndarray
    odds: np.ndarray
    block: int
    column: np.ndarray
    dense: np.ndarray

    @classmethod
    def of(cls, idf: np.ndarray, ids: list[int], toxic: list[int], terms: list[list[int]], counts: list[list[int]], block: int) -> Index:
        """Examples with the same foremost common term stand together, which makes the blocks' largest weights tight."""
        w = [cls.weight(idf, t, n) for t, n in zip(terms, counts, strict=True)]
        have = np.bincount(np.concatenate([np.array(t, np.int64) for t in terms]), minlength=len(idf)) if terms else np.zeros(len(idf), np.int64)
        common = have * 20 >= len(ids)
        first = [max(((x, t) for x, t in zip(v.tolist(), ts, strict=True) if common[t]), default=(0, -1))[1] for v, ts in zip(w, terms, strict=True)]
        order = np.lexsort((np.array(ids), np.array(first))) if len(ids) else np.empty(0, np.int64)
        term = np.concatenate([np.array(terms[i], np.int64) for i in order]) if len(ids) else np.empty(0, np.int64)
        place = np.repeat(np.arange(len(ids)), [len(terms[i]) for i in order])
        weight = np.concatenate([w[i] for i in order]) if len(ids) else np.empty(0, np.float32)
        by = np.lexsort((place, term))
        term, place, weight = term[by], place[by], weight[by]
        labels = np.array(toxic, np.float64)[order]
        odds = np.stack([np.bincount(term, weights=labels[place], minlength=len(idf)), np.bincount(term, weights=1 - labels[place], minlength=len(idf))])
        many = np.flatnonzero(have >= max(2, COMMON * len(ids)))
        column = np.full(len(idf), -1)
        column[many] = np.arange(len(many))
        dense = np.zeros((len(ids), len(many)))
        far = column[term] >= 0
        dense[place[far], column[term[far]]] = weight[far]
        term, place, weight = term[~far], place[~far], weight[~far]
        n_blocks = -(-len(ids) // block)
        entry = term * max(1, n_blocks) + place // block
        at = np.flatnonzero(np.concatenate([[True], entry[1:] != entry[:-1]])) if len(entry) else np.empty(0, np.int64)
        top = np.maximum.reduceat(weight, at) if len(at) else np.empty(0, np.float32)
        return cls(
            idf, np.array(ids, np.int64)[order], labels, np.searchsorted(term[at], np.arange(len(idf) + 1)), place[at] // block, top,
            np.append(at, len(term)), place, weight, odds, block, column, dense,
        )

    @staticmethod
    def weight(idf: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(np.asarray(counts, np.float64))) * idf[np.asarray(terms)]
        return (w / math.sqrt(float(w @ w))).astype(np.float32)

    def lean(self, terms: np.ndarray, own: int | None = None) -> float:
        """The largest of the terms' log odds of standing in a toxic example; own: the place of an example that doesn't count."""
        n = np.array([self.toxic.sum(), len(self.toxic) - self.toxic.sum()])
        seen = self.odds[:, terms]
        if own is not None:
            label = 0 if self.toxic[own] else 1
            n[label] -= 1
            seen[label] -= 1
        share = (seen + ODDS_PRIOR) / (n[:, None] + 2 * ODDS_PRIOR)
        return float(np.log(share[0] / share[1]).max())

    def products(self, terms: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
        """What common words add to the cosines of a batch's texts (rows) with the examples."""
        q = np.zeros((len(terms), self.dense.shape[1]))
        for row, (t, w) in enumerate(zip(terms, weights, strict=True)):
            c = self.column[t]
            q[row, c[c >= 0]] = w[c >= 0]
        return q @ self.dense.T

    def nearest(self, terms: np.ndarray, q: np.ndarray, k: int, own: int | None = None, common: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a cosine above 0, ties by id; own: the place of an example that doesn't count.

        q: the terms' weights. common: the text's row of products(). A block's bound is its best such product and the largest weights of the other words.
        """
        common = self.products([terms], [q])[0] if common is None else common
        rare = self.column[terms] < 0
        terms, q = terms[rare], q[rare]
        at, n = _ranges(self.entry_at[terms], self.entry_at[terms + 1])
        q, blocks = np.repeat(q, n), self.entry_block[at]
        n_blocks = -(-len(self.ids) // self.block)
        bound = np.maximum.reduceat(common, np.arange(n_blocks) * self.block) + np.bincount(blocks, weights=self.entry_top[at] * q, minlength=n_blocks)
        open_, places, cosines = bound > 0, np.empty(0, np.int64), np.empty(0)
        visit = np.zeros(n_blocks, bool)
        visit[np.argsort(-bound, kind="stable")[:FIRST_BLOCKS]] = True
        for _ in range(2):
            visit &= open_
            here = visit[blocks]
            found, m = _ranges(self.list_at[at[here]], self.list_at[at[here] + 1])
            c = np.bincount(self.places[found], weights=self.weights[found] * np.repeat(q[here], m), minlength=len(self.ids))
            c = np.where(np.repeat(visit, self.block)[: len(c)], c + common, 0)
            if own is not None:
                c[own] = 0
            hit = np.flatnonzero(c > 0)
            places, cosines = np.concatenate([places, hit]), np.concatenate([cosines, c[hit]])
            if len(places) > 4 * k:  # all that may be among the k nearest, with those as near as the k-th
                keep = cosines >= np.partition(cosines, -k)[-k] - 1e-5
                places, cosines = places[keep], cosines[keep]
            keep = np.lexsort((self.ids[places], -np.round(cosines, 6)))[:k]
            places, cosines = places[keep], cosines[keep]
            open_ &= ~visit
            visit = bound >= cosines[k - 1] - 1e-5 if len(cosines) >= k else np.ones(n_blocks, bool)
        return places, cosines


@dataclass(frozen=True)
class Calibration:
    """Logistic regression of label 1 on a text's vote and lean; its weights."""

    weights: tuple[float, ...] | None
    base: float

    @staticmethod
    def inputs(vote: np.ndarray, lean: np.ndarray) -> np.ndarray:
        """vote: NaN without neighbours."""
        none = np.isnan(vote)
        vote = np.where(none, 0, vote)
        return np.stack([np.ones(len(vote)), none, vote, lean, lean * lean, vote * lean], axis=1)

    @classmethod
    def of(cls, vote: np.ndarray, lean: np.ndarray, toxic: np.ndarray, n: np.ndarray) -> Calibration:
        """From cells: their mean vote and lean, labels 1 and rows."""
        total, ones = n.sum(), toxic.sum()
        if not total or not 0 < ones < total:
            return cls(None, float(ones / total) if total else 0.0)
        x = cls.inputs(vote, lean)
        w = np.zeros(x.shape[1])
        for _ in range(50):  # Newton steps, with a little pull to 0 that keeps separable labels finite
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w)), x.T @ (toxic - n * p) - RIDGE * w)
            w += step
            if np.abs(step).max() < 1e-9:
                break
        return cls(tuple(w.tolist()), float(ones / total))

    def scores(self, vote: np.ndarray, lean: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(vote), self.base)
        return 1 / (1 + np.exp(-np.clip(self.inputs(vote, lean) @ np.array(self.weights), -30, 30)))


#: Pull of the calibration's weights to 0.
RIDGE = 0.1


def toxicity(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """doc_id, held_out, score, predicted, and evidence (ids and cosines of the nearest examples), one row per row of docs."""
    learn = written(training(labels))
    held = (F.crc32(F.col("doc_id").cast("string")) % 5 == 0) | F.col("doc_id").isNull()
    examples = example_rows(docs, learn, p)
    if not examples["doc_id"]:
        return documents(docs, "doc_id").select("doc_id", held.alias("held_out"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), F.lit("").alias("evidence"))
    hashes = [np.array(h, np.int64).view(np.uint64) for h in examples["hashes"]]
    every = np.unique(np.concatenate(hashes))
    found = written(vectors(docs, every))
    n = found.count()
    idf = np.log((1 + n) / (1 + frequencies(found, len(every)))) + 1
    index = Index.of(idf, examples["doc_id"], examples["toxic"], [np.searchsorted(every, h).tolist() for h in hashes], examples["counts"], p.block)
    sent = docs.sparkSession.sparkContext.broadcast(index)
    rest = written(other_squares(found, n))

    def rows(batch, state: tuple) -> dict:
        ix, own = state
        arrays = lambda c: np.split(batch[c].flatten().to_numpy(), np.cumsum(pc.list_value_length(batch[c]).to_numpy())[:-1])
        terms, counts = arrays("terms"), arrays("counts")
        weights = [ix.weight(ix.idf, t, n).astype(np.float64) if len(t) else np.empty(0) for t, n in zip(terms, counts, strict=True)]
        common = ix.products(terms, weights)
        votes, leans, ids, cosines, squares = [], [], [], [], []
        for row, (doc_id, t, n, q) in enumerate(zip(batch["doc_id"].to_pylist(), terms, counts, weights, strict=True)):
            places, c = ix.nearest(t, q, p.k, own.get(doc_id), common[row]) if len(t) else (np.empty(0, np.int64), np.empty(0))
            w = np.square(c)
            votes.append(float(w @ ix.toxic[places] / w.sum()) if len(places) else None)
            leans.append(ix.lean(t, own.get(doc_id)) if len(t) else 0.0)
            ids.append(ix.ids[places[:3]])
            cosines.append(c[:3])
            squares.append(float(np.square((1 + np.log(n)) * ix.idf[t]).sum()) if len(t) else 0.0)
        return {"row": batch["row"], "doc_id": batch["doc_id"], "vote": votes, "lean": leans, "ids": ids, "cosines": cosines, "own": squares}

    schema = "row long, doc_id long, vote double, lean double, ids array<long>, cosines array<double>, own double"
    setup = lambda: (sent.value, {d: i for i, d in enumerate(sent.value.ids.tolist())})
    voted = written(map_batches(found.select("row", "doc_id", "terms", "counts"), schema, rows, setup))
    discard(found)
    # the calibration meets all training documents, in cells: CELLS votes, or none, and 2 * CELLS + 1 leans at most
    near = F.floor(F.least(F.lit(CELLS - 1), F.col("vote") * CELLS))
    side = F.greatest(F.lit(-CELLS), F.least(F.lit(CELLS), F.floor(F.col("lean") * 8)))
    cells = voted.join(learn, "doc_id").groupBy(near.alias("near"), side.alias("side"))
    cells = cells.agg(F.avg("vote").alias("vote"), F.avg("lean").alias("lean"), F.sum("toxic").alias("toxic"), F.count("*").alias("n")).orderBy("near", "side").toArrow()
    column = lambda c: cells[c].to_numpy().astype(np.float64)
    fit = Calibration.of(column("vote"), column("lean"), column("toxic"), column("n"))

    def scored(batch) -> dict:
        return {c: batch[c] for c in ("row", "doc_id", "ids", "cosines", "own")} | {"score": fit.scores(batch["vote"].to_numpy(zero_copy_only=False).astype(np.float64), batch["lean"].to_numpy())}

    out = map_batches(voted, "row long, doc_id long, ids array<long>, cosines array<double>, own double, score double", scored)
    out = out.join(rest, "row", "left")
    # the cosines so far are over the examples' words; the others make the text's vector longer
    scale = F.sqrt(F.col("own") / (F.col("own") + F.coalesce("rest", F.lit(0.0))))
    evidence = F.array_join(F.zip_with("ids", "cosines", lambda i, c: F.concat(i.cast("string"), F.lit(":"), F.format_string("%.4f", c * scale))), ",")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), evidence.alias("evidence"))
