"""Operator 1: quality rules with risk-controlled thresholds.

Every rule compares one ratio of a text with a cutoff; all rules together have one path of cutoffs, from the loosest to the strictest, fixed
beforehand. In each stratum the steps of the path are tested in turn on distinct good labelled texts, and testing ends at the first step that can't be
shown to reject, by any of its rules, at most the share `risk` of them. A test is the exact binomial one: with n texts of which k are rejected,
P(Bin(n, risk) <= k) must not exceed `error` / strata, which is the same as a Clopper-Pearson upper bound of at most risk. A fixed sequence
needs no correction within it; Bonferroni over strata makes all bounds hold at once with probability 1 - `error`.

Strata are the languages, those with most good texts first, as long as a language has texts enough to prove a step that rejects none of them (90 at
4 languages). All other languages together are one more stratum, tested on their own labels, whose bound holds for them together; if these are too
few for that, it is tested on the labels of all languages. Where a stratum's labels prove nothing, only the base decides there.

Defined results: a null or empty text has no words, fails the base and isn't kept. A null language is one of the others. A document whose labels conflict isn't good.
Repeated rows give repeated rows; labels of repeated texts count once.
Without labels only the base decides. Other columns of the inputs are ignored, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm.common import byte_words, documents, hashes, map_batches, window_hashes, written

FEATURES = "doc_id long, lang string, text_hash long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_upper long, n_marks long, n_lines long"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
WINDOW = 8
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_IS_SYMBOL = np.isin(np.arange(256), _SYMBOLS)
_IS_SPACE = np.isin(np.arange(256), np.frombuffer(b" \t\n\v\f\r", np.uint8))
_IS_MARK = np.isin(np.arange(256), np.frombuffer(b"!?", np.uint8))
#: Bits of a byte: starts a code point outside the six separators; symbol; capital A-Z; ! or ?
_CLASS = (
    (((np.arange(256) & 0xC0) != 0x80) & ~_IS_SPACE).astype(np.uint8)
    | _IS_SYMBOL.astype(np.uint8) << 1
    | ((np.arange(256) >= 65) & (np.arange(256) <= 90)).astype(np.uint8) << 2
    | _IS_MARK.astype(np.uint8) << 3
)


@dataclass(frozen=True)
class Parameters:
    """risk: share of good documents of a stratum that the method may reject, by all rules together.

    error: probability that any stratum's true share is above that. max_strata: how many languages are strata of their own at most, so the
    table of steps has a fixed size limit and may be broadcast.
    """

    risk: float = 0.05
    error: float = 0.05
    max_strata: int = 256


def _per_word(x: str) -> Column:
    return F.col(x) / F.greatest(F.col("n_words"), F.lit(1))


#: Cutoffs of each rule by step, from the loosest to the strictest. A text is rejected if any of its ratios exceeds the step's cutoff.
PATH: dict[str, tuple[float, ...]] = {
    "symbols": (3.0, 2.0, 1.5, 1.0, 0.7, 0.5, 0.3, 0.2),
    "marks": (2.0, 1.5, 1.2, 1.0, 0.7, 0.5, 0.4, 0.3),
    "capitals": (0.8, 0.7, 0.6, 0.5, 0.45, 0.4, 0.35, 0.3),
    "repeats": (0.3, 0.28, 0.26, 0.24, 0.22, 0.2, 0.18, 0.15),
    "lines": (0.8, 0.7, 0.6, 0.55, 0.5, 0.45, 0.4, 0.35),
}
STEPS = 8


def ratios() -> dict[str, Column]:
    """The rules' ratios. Columns need a session, hence a function."""
    return {
        "symbols": _per_word("n_symbols"), "marks": _per_word("n_marks"), "capitals": F.col("n_upper") / F.greatest(F.col("word_chars"), F.lit(1)),
        "repeats": _per_word("n_repeat_words"), "lines": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
    }


def rejected_from() -> Column:
    """The first step (from 0) that rejects a text; STEPS, if none does. Cutoffs fall along the path, so all later steps do, too."""
    passed = [sum(((ratio <= cut).cast("int") for cut in PATH[name]), F.lit(0)) for name, ratio in ratios().items()]
    return F.least(*passed)


def text_features(text: str | None) -> tuple[int, ...]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper, n_marks, n_lines of a whole text."""
    if not text:
        return (0,) * 8
    data = text.encode()
    words = data.split()
    counts = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=16)
    bit = lambda k: int(sum(counts[i] for i in range(16) if i >> k & 1))
    lines = [x for x in text.split("\n") if x and not x.isspace() or _has_word(x)]
    n_repeat = 0
    if len(words) > WINDOW:
        h = window_hashes(hashes(words), WINDOW)
        order = np.sort(h)
        twice = order[1:][order[1:] == order[:-1]]
        if len(twice):
            hit = np.flatnonzero(np.isin(h, twice))
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, hit, 1)
            np.add.at(edges, hit + WINDOW, -1)
            n_repeat = int((np.cumsum(edges) > 0).sum())
    return len(words), bit(0), bit(1), len(lines) - len(set(lines)), n_repeat, bit(2), bit(3), len(lines)


def _has_word(line: str) -> bool:
    return bool(byte_words(line))


def _rows(batch) -> dict:
    found = list(zip(*map(text_features, batch["text"].to_pylist()), strict=True))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines"]
    return {name: batch[name] for name in batch.schema.names} | dict(zip(names, found, strict=True))


def features(docs: DataFrame) -> DataFrame:
    """The ratios' counts of every text; the text itself goes no further."""
    rows = documents(docs, "doc_id", "text", "lang").withColumn("text_hash", F.xxhash64("text"))
    return map_batches(rows, FEATURES, _rows)


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def binomial_tail(n: int, k: int, p: float) -> float:
    """P(Bin(n, p) <= k), summed beside the largest term."""
    if k >= n:
        return 1.0
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    most, total = log(min(k, int(n * p))), 0.0
    for i in range(k, -1, -1):  # from the largest terms down, until they no longer count
        x = log(i) - most
        if x < -40 and i < n * p:
            break
        total += math.exp(x)
    return min(1.0, math.exp(most) * total)


def surely_below(n: int, k: int, p: float, error: float) -> bool:
    """Whether k of n shows a rate of at most p, but for the error. More than n * p rejections never do, at any n."""
    return n > 0 and k <= n * p and binomial_tail(n, k, p) <= error


def least_texts(rank: int, p: Parameters) -> int:
    """Good texts that the language of this rank (from 1) needs to prove a step that rejects none of them, beside one more stratum."""
    return math.ceil(math.log(p.error / (rank + 1)) / math.log1p(-p.risk) - 1e-9)


def steps(found: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """stratum (null: the other languages), n_good and step: how many steps of the path are proved; the last of them decides (0: none). found: features()."""
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("quality")).filter("doc_id IS NOT NULL AND quality IS NOT NULL")
    good = labels.groupBy("doc_id").agg(F.min("quality").alias("q")).filter("q = 1").select("doc_id")
    once = found.filter(~base_failed()).join(good, "doc_id", "left_semi").select("lang", "text_hash", rejected_from().alias("at")).distinct()
    counts = [F.count("*").alias("n_good")] + [F.sum((F.col("at") <= i).cast("long")).alias(f"k{i}") for i in range(STEPS)]
    per_lang = written(once.groupBy("lang").agg(*counts))
    # at most max_strata rows come to the driver; the rest is added up where it is
    ranked = per_lang.filter(F.col("lang").isNotNull()).orderBy(F.desc("n_good"), "lang").limit(p.max_strata).collect()
    own = []
    for rank, row in enumerate(ranked, 1):
        if row["n_good"] < least_texts(rank, p):
            break
        own.append(row)
    names = [r["lang"] for r in own]
    others = per_lang.filter(F.col("lang").isNull() | ~F.col("lang").isin(names)) if names else per_lang
    sums = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in per_lang.columns[1:]]
    rest = others.agg(*sums).first()
    if rest["n_good"] < least_texts(len(own), p) and own:
        rest = per_lang.agg(*sums).first()

    def proved(row) -> int:
        done = 0
        while done < STEPS and surely_below(row["n_good"], row[f"k{done}"], p.risk, p.error / (len(own) + 1)):
            done += 1
        return done

    rows = [(r["lang"], r["n_good"], proved(r)) for r in own] + [(None, rest["n_good"], proved(rest))]
    return found.sparkSession.createDataFrame(rows, "stratum string, n_good long, step int")


def judged(found: DataFrame, table: DataFrame) -> DataFrame:
    """found with base_failed, step and kept. The table has at most max_strata + 1 rows, hence the broadcast."""
    own = F.broadcast(table.select(F.col("stratum").alias("_stratum"), F.col("step").alias("_own")).filter("_stratum IS NOT NULL"))
    other = table.filter("stratum IS NULL").first()["step"]
    step = F.coalesce("_own", F.lit(other))
    failed = base_failed()
    rows = found.join(own, F.col("lang") == F.col("_stratum"), "left")
    return rows.select(*[found[c] for c in found.columns], failed.alias("base_failed"), step.alias("step"), (~failed & (rejected_from() >= step)).alias("kept"))


def quality_rules(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, the other counts and the step that decided, one row per row of docs."""
    found = written(features(docs))
    out = judged(found, steps(found, labels, p))
    return out.select("doc_id", *BASE, "base_failed", "kept", "n_upper", "n_marks", "n_lines", "step")


def keep_good(docs: DataFrame, labels: DataFrame, p: Parameters = Parameters()) -> DataFrame:
    """The rows of docs that the rules keep, with their own columns. Texts are counted once and written beside their rows."""
    tagged = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = written(map_batches(tagged.withColumn("text_hash", F.xxhash64("text")), _with_row(FEATURES, docs), _rows))
    return judged(counted, steps(counted.drop("_row"), labels, p)).filter("kept").select("_row.*")


def _with_row(schema: str, docs: DataFrame):
    from pyspark.sql import types as T

    out = T._parse_datatype_string(schema)
    return T.StructType([T.StructField("_row", docs.schema), *out.fields])


def _sql() -> str:
    """The whole query as DuckDB SQL, its rules and numbers taken from here."""
    p = Parameters()
    ratio = {
        "symbols": "n_symbols / greatest(n_words, 1)", "marks": "n_marks / greatest(n_words, 1)", "capitals": "n_upper / greatest(word_chars, 1)",
        "repeats": "n_repeat_words / greatest(n_words, 1)", "lines": "n_dup_lines / greatest(n_lines, 1)",
    }
    passed = ", ".join(" + ".join(f"({x} <= {cut}::DOUBLE)::INTEGER" for cut in PATH[name]) for name, x in ratio.items())
    return rf"""WITH d AS (SELECT doc_id, lang, text, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
v AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i:i + 7], ' '))) AS g FROM d WHERE len(w) > 7),
h AS (SELECT doc_id, i FROM v QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM h, range(0, 8) AS r(k) GROUP BY doc_id),
c AS (SELECT doc_id, lang, text, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, length(regexp_replace(t, '[^A-Z]', '', 'g'))::BIGINT AS n_upper, length(regexp_replace(t, '[^!?]', '', 'g'))::BIGINT AS n_marks,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words FROM d LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, len(lines)::BIGINT AS n_lines, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c),
f AS (SELECT *, least({passed}) AS passes FROM b),
once AS (SELECT DISTINCT lang, text, passes FROM f WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1)),
ranked AS (SELECT lang, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, lang) AS r FROM once WHERE lang IS NOT NULL GROUP BY lang),
enough AS (SELECT *, n >= ceil(ln({p.error!r} / (r + 1)) / ln(1 - {p.risk!r}) - 1e-9) AND r <= {p.max_strata} AS ok FROM ranked),
own AS (SELECT lang FROM enough e WHERE ok AND NOT EXISTS (FROM enough o WHERE o.r < e.r AND NOT o.ok)),
m AS (SELECT count(*) AS own FROM own),
few AS (SELECT count(*) < (SELECT ceil(ln({p.error!r} / (own + 1)) / ln(1 - {p.risk!r}) - 1e-9) FROM m) AS few FROM once WHERE lang IS NULL OR lang NOT IN (FROM own)),
strata AS (SELECT lang AS stratum, passes FROM once WHERE lang IN (FROM own) UNION ALL SELECT NULL, passes FROM once WHERE (SELECT few FROM few) OR lang IS NULL OR lang NOT IN (FROM own)),
tests AS (SELECT stratum, i, count(*) AS n, count(*) FILTER (WHERE passes <= i) AS k FROM strata, range(0, {STEPS}) AS s(i) GROUP BY stratum, i),
shown AS (SELECT *, k <= n * {p.risk!r} AND list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1)
  + j * ln({p.risk!r}) + (n - j) * ln(1 - {p.risk!r})))) <= {p.error!r} / (SELECT own + 1 FROM m) AS safe FROM tests),
step AS (SELECT s.stratum, coalesce(min(s.i) FILTER (WHERE NOT safe), {STEPS})::INTEGER AS step FROM shown s GROUP BY s.stratum),
j AS (SELECT f.*, CASE WHEN lang IN (FROM own) THEN (SELECT step FROM step WHERE stratum = f.lang) ELSE coalesce((SELECT step FROM step WHERE stratum IS NULL), 0) END AS step FROM f)
SELECT doc_id, {", ".join(BASE)}, base_failed, NOT base_failed AND passes >= step AS kept, n_upper, n_marks, n_lines, step FROM j"""


SQL = _sql()
