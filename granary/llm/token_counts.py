"""Operator 3: token counts under a unigram vocabulary with byte fallback, without making the tokens.

Every word, led by the mark U+2581 unless it has it already, is cut so that the sum of its pieces' scores is largest. An Aho-Corasick automaton lists
the vocabulary's matches by their ends; dynamic programming keeps, for as many ends as the longest piece has characters, the best score and the
number of pieces on that path, and nothing else. The rules are those of the unigram tokenizer: sums are doubles, added from the left; among equal sums the
first found, that is the longest last piece, stays; a character that is no piece costs the smallest score less 10. A stretch of neighbouring unknown characters
counts as its UTF-8 bytes if the vocabulary has a piece for each of them, else as one.

The pieces are those of a public file, which holds no probabilities but the order in which its pieces were found. No tokenizer is trained here, so
a piece's score is the logarithm of its probability under Zipf's law for that order: the n-th piece has 1 / (n + 2.7), to a common factor.

Defined results: a null text, or one without words, has no tokens. Repeated rows give repeated rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
from pyspark.sql import DataFrame

from granary.llm.common import Recent, documents, map_batches

MARK = "▁"
#: Fixed value: what an unknown character costs below the smallest score.
UNKNOWN_PENALTY = 10.0
#: Mandelbrot's shift of the ranks in Zipf's law.
ZIPF_SHIFT = 2.7


def byte_pieces(path: str) -> frozenset[int]:
    """The bytes that have pieces <0x00> to <0xFF> in a SentencePiece file."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    return frozenset(int(sp.id_to_piece(i)[1:-1], 16) for i in range(sp.get_piece_size()) if sp.is_byte(i))


def read_vocabulary(path: str) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece file in its order, without control, unknown and byte pieces."""
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=path)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
    weights = [1 / (n + ZIPF_SHIFT) for n in range(1, len(pieces) + 1)]
    total = math.fsum(weights)
    return [(piece, math.log(w / total)) for piece, w in zip(pieces, weights, strict=True)]


@dataclass
class Counter:
    """Counts the pieces of a word. longest: characters of the longest piece."""

    words: ahocorasick.Automaton
    unknown: float
    longest: int
    fallback: frozenset[int] = frozenset()

    @classmethod
    def of(cls, vocabulary: list[tuple[str, float]], fallback: frozenset[int] = frozenset()) -> Counter:
        automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            automaton.add_word(piece, (len(piece), float(score)))
        automaton.make_automaton()
        return cls(automaton, min(s for _, s in vocabulary) - UNKNOWN_PENALTY, max(len(p) for p, _ in vocabulary), fallback)

    def matches(self, text: str) -> Iterator[list[tuple[int, float]]]:
        """(length, score) of the pieces that end at each character in turn, the longest first."""
        at, here = 0, []
        for end, found in self.words.iter(text):
            while at < end:
                yield here
                at, here = at + 1, []
            here.append(found)  # the automaton lists the longest first
        while at < len(text):
            yield here
            at, here = at + 1, []

    def count(self, text: str) -> int:
        """Pieces on the best path through a text that holds no space, in memory for as many ends as the longest piece has characters."""
        size = self.longest + 1
        # by end: the best score; pieces before the unknown stretch that the path ends with; that stretch's bytes, and whether all have pieces
        score, pieces, stretch, covered = [0.0] * size, [0] * size, [0] * size, [True] * size
        e = 0
        for e, found in enumerate(self.matches(text), 1):
            best, from_, unknown = None, 0, False
            for length, s in found:
                s += score[(e - length) % size]
                if best is None or s > best:
                    best, from_ = s, e - length
            if not found or found[-1][0] != 1:
                s = self.unknown + score[(e - 1) % size]
                if best is None or s > best:
                    best, from_, unknown = s, e - 1, True
            at, before = e % size, from_ % size
            score[at] = best
            if unknown:
                data = text[e - 1].encode()
                pieces[at], stretch[at], covered[at] = pieces[before], stretch[before] + len(data), covered[before] and self.fallback.issuperset(data)
            else:
                pieces[at], stretch[at], covered[at] = self.closed(pieces[before], stretch[before], covered[before]) + 1, 0, True
        return self.closed(*[x[e % size] for x in (pieces, stretch, covered)])

    @staticmethod
    def closed(pieces: int, stretch: int, covered: bool) -> int:
        """Pieces of a path, with those of the unknown stretch that it ends with."""
        return pieces + ((stretch if covered else 1) if stretch else 0)


class WordCounts(Recent):
    """Counts of words seen lately."""

    def __init__(self, counter: Counter):
        super().__init__()
        self.counter = counter

    def compute(self, word: bytes) -> int:
        text = word.decode()
        return self.counter.count(text if text.startswith(MARK) else MARK + text)


_COUNTS: dict[str, WordCounts] = {}


def worker_counts(path: str) -> WordCounts:
    """One per Python worker: it serves many tasks."""
    if path not in _COUNTS:
        _COUNTS[path] = WordCounts(Counter.of(read_vocabulary(path), byte_pieces(path)))
    return _COUNTS[path]


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_words and n_tokens, one row per row of docs."""

    def rows(batch, counts) -> dict:
        words = [t.encode().split() if t else [] for t in batch["text"].to_pylist()]
        return {"doc_id": batch["doc_id"], "n_words": [len(w) for w in words], "n_tokens": [sum(map(counts.__getitem__, w)) for w in words]}

    return map_batches(documents(docs, "doc_id", "text"), "doc_id long, n_words long, n_tokens long", rows, lambda: worker_counts(vocabulary))
