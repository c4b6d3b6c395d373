"""Operator 8: secrets in whole texts.

One Aho-Corasick pass over the text (A-Z lowered) finds keywords; regular expressions are anchored at those hits only.
Formats that carry a check are then verified: the CRC-32 at the end of platform tokens, the JSON header of web tokens,
in key blocks the DER length, the length fields of OpenSSH keys, or whole cipher blocks after the header lines of encrypted ones,
the check digits of card numbers (Luhn) and of account numbers (97). Long runs of hexadecimal digits have no keyword; they are found by the gaps between other bytes.

Kinds in order: assign, access, hex (the base), then github, npm, jwt, pem, card, iban. Spans are code points, end exclusive.
Within a kind, matches are leftmost and don't overlap; a match that is too short is dropped but its characters stay used.

Defined results: a null text is empty and has no spans; repeated rows give repeated rows; a null doc_id stays null; other columns
are ignored by scan() and kept by redacted().
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
import zlib

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from granary.llm.common import documents, map_batches

KINDS = ("assign", "access", "hex", "github", "npm", "jwt", "pem", "card", "iban")
BASE_KINDS = KINDS[:3]
#: Keywords (lower case) with the kind whose expression is tried where they start.
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github",
    "npm_": "npm", "eyj": "jwt", "-----begin ": "pem", "card": "card", "iban": "iban",
}
ANCHORED = {
    "assign": re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"),
    "pem": re.compile(r"-----BEGIN ((?:[A-Z]+ )?PRIVATE KEY)-----\s++((?:[ \t]*[A-Za-z0-9-]+:[^\n]*\n)*+)([A-Za-z0-9+/=\s]++)-----END \1-----"),
    "card": re.compile(r"""(?i:card)(?i:[\x20_-]?(?:number|num|no\.?))?["']?\x20*+[:=#]?\x20*+["']?((?:[0-9][\x20-]?){12,18}[0-9])(?![\x20-]?[0-9])"""),
    "iban": re.compile(r"""(?i:iban)["']?\x20*+[:=#]?\x20*+["']?([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?)(?![A-Za-z0-9])"""),
}
HEX_LENGTH = 24
_NO_HEX = ~np.isin(np.arange(256), np.frombuffer(b"0123456789abcdef", np.uint8))
_DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_base62(payload: str) -> str:
    """CRC-32 of a token's payload as six digits of base 62."""
    n, out = zlib.crc32(payload.encode()), ""
    for _ in range(6):
        n, k = divmod(n, 62)
        out = _DIGITS62[k] + out
    return out


def _crc_fits(m: re.Match) -> bool:
    return crc_base62(m[1][:30]) == m[1][30:]


def _json_header(text: str, start: int, end: int) -> bool:
    """Whether that part of a text is a JSON object that names an algorithm. Longer and longer beginnings are looked at, so what isn't JSON ends soon."""
    size = 64
    try:
        while start + size < end:
            if not _may_begin_json(base64.urlsafe_b64decode(text[start : start + size]).decode(errors="ignore")):
                return False
            size *= 8
        head = text[start:end]
        found = json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
        return isinstance(found, dict) and "alg" in found
    except (ValueError, TypeError, RecursionError):
        return False


def _may_begin_json(start: str) -> bool:
    """Whether more characters could make JSON of this: an error before the last few characters says no."""
    try:
        json.loads(start)
    except json.JSONDecodeError as e:
        return "Unterminated" in e.msg or e.pos >= len(start) - 12
    return False  # whole already, but something follows


def _der_fits(data: bytes) -> bool:
    """One DER sequence of just its stated length."""
    if len(data) < 2 or data[0] != 0x30:
        return False
    if data[1] < 0x80:
        return len(data) == 2 + data[1]
    size = data[1] & 0x7F
    return 0 < size <= 4 and len(data) == 2 + size + int.from_bytes(data[2 : 2 + size], "big")


OPENSSH_MAGIC = b"openssh-key-v1\0"


def _openssh_fits(data: bytes) -> bool:
    """The magic, then cipher, kdf, its options, the number of keys, as many public keys and one private part, by their length fields."""
    if not data.startswith(OPENSSH_MAGIC):
        return False
    at, left, counted = len(OPENSSH_MAGIC), 3, False
    while left or not counted:
        if at + 4 > len(data):
            return False
        n = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if left:
            at, left = at + n, left - 1
        else:
            left, counted = n + 1, True
    return at == len(data)


def _key_fits(m: re.Match) -> bool:
    """The block decodes to what its label and header lines say."""
    try:
        data = base64.b64decode("".join(m[3].split()), validate=True)
    except (binascii.Error, ValueError):
        return False
    if "ENCRYPTED" in m[2]:
        size = 16 if re.search("AES|CAMELLIA|SEED", m[2]) else 8
        return len(data) > 0 and len(data) % size == 0
    return _openssh_fits(data) if m[1].startswith("OPENSSH ") else _der_fits(data)


#: Beginnings of card numbers and their lengths.
CARDS = re.compile(r"4[0-9]{12}(?:[0-9]{3}){0,2}|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6[0-9]{15,18}")


def _card_fits(m: re.Match) -> bool:
    """Known beginning and length, and Luhn's check digit."""
    number = re.sub("[ -]", "", m[1])
    digits = [int(c) for c in reversed(number)]
    return bool(CARDS.fullmatch(number)) and (sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])) % 10 == 0


def _iban_fits(m: re.Match) -> bool:
    """The account number, its first four characters moved to the end and letters read as 10 to 35, is 1 modulo 97."""
    number = m[1].replace(" ", "")
    return int("".join(str(int(c, 36)) for c in number[4:] + number[:4])) % 97 == 1


VALID = {
    "assign": lambda m: len(m[2]) >= 6,
    "access": lambda m: len(m[0]) >= 20,
    "github": _crc_fits,
    "npm": _crc_fits,
    "pem": _key_fits,
    "card": _card_fits,
    "iban": _iban_fits,
}


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


def hex_runs(data: bytes) -> list[tuple[int, int]]:
    """Byte spans of runs of 24 or more digits 0-9a-f."""
    if len(data) < HEX_LENGTH:
        return []
    other = np.flatnonzero(_NO_HEX[np.frombuffer(data, np.uint8)])
    ends = np.append(other, len(data))
    starts = np.append(-1, other) + 1
    long = np.flatnonzero(ends - starts >= HEX_LENGTH)
    return [(int(starts[i]), int(ends[i])) for i in long]


_PART = re.compile(r"[A-Za-z0-9_-]*+")


class WebTokens:
    """Web tokens: eyJ and five more characters, a dot, eyJ and two more, a dot, and 20. Where the parts end is found once for all hits in a stretch."""

    def __init__(self, text: str):
        self.text, self.first, self.last = text, -1, 0

    def end(self, start: int) -> int:
        """Where the token that starts here ends; 0, if there is none."""
        text = self.text
        if start >= self.first:
            self.first, self.last = _PART.match(text, start).end(), 0
            if text[self.first : self.first + 4] == ".eyJ":
                second = _PART.match(text, self.first + 1).end()
                third = _PART.match(text, second + 1).end() if text[second : second + 1] == "." else 0
                if second - self.first > 5 and third - second > 20:
                    self.last = third
        return self.last if self.last and self.first - start >= 8 and _json_header(text, start, self.first) else 0


def spans(text: str | None, words: ahocorasick.Automaton) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all secrets by start, then kind in the order of KINDS."""
    if not text:
        return []
    data = text.encode()
    out = []
    at = start = 0  # the same place in bytes and in code points
    for a, b in hex_runs(data):
        start += a - at if len(data) == len(text) else len(data[at:a].decode())
        at = a
        out.append((start, start + b - a, "hex"))
    hits = sorted((end - n + 1, kind) for end, (kind, n) in words.iter(data.lower().decode()))
    used, tokens = dict.fromkeys(KINDS, 0), WebTokens(text)
    for start, kind in hits:
        if start < used[kind]:
            continue
        if kind == "jwt":
            if end := tokens.end(start):
                out.append((start, end, kind))
                used[kind] = end
            continue
        if not (m := ANCHORED[kind].match(text, start)):
            continue
        if VALID[kind](m):
            out.append((start, m.end(), kind))
        elif kind not in BASE_KINDS:
            continue
        used[kind] = m.end()
    return sorted(out, key=lambda x: (x[0], KINDS.index(x[2])))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in found)


def redact(text: str, found: list[tuple[int, int, str]], mark: str) -> str:
    """The text with each stretch of overlapping spans replaced by one mark."""
    out, at = [], 0
    for a, b, _ in found:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def _scan_rows(batch, words) -> dict:
    found = [spans(t, words) for t in batch["text"].to_pylist()]
    base = [[x for x in f if x[2] in BASE_KINDS] for f in found]
    counts = {f"n_{k}": [sum(x[2] == k for x in f) for f in found] for k in KINDS}
    return counts | {
        "doc_id": batch["doc_id"],
        "base_sha256": [hashlib.sha256(joined(b).encode()).hexdigest() for b in base],
        "spans": [joined(f) for f in found],
    }


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, a count per kind, base_sha256 and spans, one row per row of docs."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_github long, n_npm long, n_jwt long, n_pem long, n_card long, n_iban long"
    return map_batches(documents(docs, "doc_id", "text"), schema, _scan_rows, automaton)


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """docs with every secret in `text` replaced by the mark, and n_chars, if there, the new length of changed texts."""

    def rows(batch, words) -> dict:
        texts = batch["text"].to_pylist()
        clean = [t if not (found := spans(t, words)) else redact(t, found, mark) for t in texts]
        return {"_row": batch["_row"], "_clean": clean}

    schema = T.StructType([T.StructField("_row", docs.schema), T.StructField("_clean", T.StringType())])
    tagged = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), F.col("text").cast("string").alias("text"))
    out = map_batches(tagged, schema, rows, automaton)
    changed = ~F.col("_clean").eqNullSafe(F.col("_row.text"))
    new = {"text": F.col("_clean"), "n_chars": F.when(changed, F.length("_clean").cast("bigint")).otherwise(F.col("_row.n_chars") if "n_chars" in docs.columns else F.lit(None))}
    return out.select(*[new[c].cast(docs.schema[c].dataType).alias(c) if c in new else F.col("_row")[c].alias(c) for c in docs.columns])
