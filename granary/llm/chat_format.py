"""Operator 10: chat formatting of typed content parts.

A turn's content is a text or a JSON list of parts: {"type": "text", "text": ...}, {"type": "image", "ref", "width", "height"},
{"type": "audio", "ref", "seconds"}, {"type": "document", "ref", "pages"} or with "parts", which may nest. A visitor walks the parts
in order; text is escaped, each attachment becomes a placeholder <|kind|>, and its reference and the tokens that the
placeholder stands for are recorded. A turn is written as <|turn|>role, newline, content, <|end|>, newline.

Escaping puts a backslash before every backslash and inside every control string, so that none is left; unescaping drops it.

Turns are formatted where they are. For digests a conversation's turns are sorted by Spark and read as a stream, so a
conversation of any length needs memory for a batch only; one digest is by nature computed in one task.

Defined results: a null text or role is empty. Turns with equal numbers stand by role, then formatted string; null turns come first; repeated rows are
repeated turns. Null conversation ids form one conversation. Content, in a column
that the caller names, that isn't a JSON list of objects is an error naming the turn's start. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import map_batches

#: Control strings of this and of common templates, and where the backslash goes.
ESCAPES = (
    ("\\", "\\\\"), ("<|", "<\\|"), ("<s>", "<\\s>"), ("</s>", "<\\/s>"), ("[INST]", "[\\INST]"), ("[/INST]", "[\\/INST]"),
    ("<<SYS>>", "<\\<SYS>>"), ("<</SYS>>", "<\\</SYS>>"),
)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_TURN = re.compile(r"<\|turn\|>((?:[^\\\n]|\\.)*)\n(.*)<\|end\|>\n", re.DOTALL)
_PLACE = re.compile(r"<\|(image|audio|document)\|>")

TURNS = (
    "conv_id long, turn long, formatted string, loss_start long, loss_end long, "
    "attachments array<struct<kind:string,ref:string,position:long,tokens:long>>, expanded_tokens long"
)
DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_attachments long, expanded_tokens long"


def escape(text: str) -> str:
    for plain, safe in ESCAPES:
        text = text.replace(plain, safe)
    return text


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text) if "\\" in text else text


@dataclass(frozen=True)
class Costs:
    """Tokens that a placeholder stands for: image patches of `patch` pixels square, audio per second, document per page."""

    patch: int = 28
    audio_per_second: float = 25.0
    document_per_page: int = 512


@dataclass
class Flattener:
    """Visits parts in order; the result is in `out`, `length` and `attachments`."""

    costs: Costs
    out: list[str] = field(default_factory=list)
    length: int = 0
    attachments: list[dict] = field(default_factory=list)

    def visit(self, part: dict) -> None:
        handler = getattr(self, f"visit_{part.get('type')}", None)
        if handler is None:
            raise ValueError(f"unknown content part: {part.get('type')!r}")
        handler(part)

    def put(self, text: str) -> None:
        self.out.append(text)
        self.length += len(text)

    def attach(self, kind: str, part: dict, tokens: int) -> None:
        self.attachments.append({"kind": kind, "ref": part.get("ref"), "position": self.length, "tokens": tokens})
        self.put(f"<|{kind}|>")

    def visit_text(self, part: dict) -> None:
        self.put(escape(part.get("text") or ""))

    def visit_image(self, part: dict) -> None:
        side = lambda x: max(1, math.ceil((part.get(x) or 0) / self.costs.patch))
        self.attach("image", part, side("width") * side("height"))

    def visit_audio(self, part: dict) -> None:
        self.attach("audio", part, math.ceil((part.get("seconds") or 0) * self.costs.audio_per_second))

    def visit_document(self, part: dict) -> None:
        self.attach("document", part, (part.get("pages") or 0) * self.costs.document_per_page)
        for inner in part.get("parts") or ():
            self.visit(inner)


def format_turn(role: str | None, text: str | None, content: str | None, costs: Costs) -> tuple[str, int, int, list[dict]]:
    """Formatted turn, start and end of its content, attachments. content, if given, stands for the text."""
    head = f"<|turn|>{escape(role or '').replace(chr(10), chr(92) + chr(10))}\n"
    flat = Flattener(costs, length=len(head))
    parts = json.loads(content) if content is not None else [{"type": "text", "text": text}]
    if not isinstance(parts, list) or not all(isinstance(p, dict) for p in parts):
        raise ValueError(f"content is no list of parts: {str(content)[:40]!r}")
    for part in parts:
        flat.visit(part)
    return f"{head}{''.join(flat.out)}<|end|>\n", len(head), flat.length, flat.attachments


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of a formatted turn; placeholders stay in the text."""
    m = _TURN.fullmatch(formatted)
    if not m:
        raise ValueError("no formatted turn")
    return unescape(m[1]), unescape(m[2])


def format_turns(conversations: DataFrame, trained_roles: tuple[str, ...] = ("assistant",), costs: Costs = Costs(), parts: str | None = None) -> DataFrame:
    """One formatted turn per row, with its part under the loss mask (null: none) and its attachments. parts: the column of typed parts, if any."""
    content = (F.col(parts) if parts else F.lit(None)).cast("string")
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), content.alias("content"))

    def run(batch) -> dict:
        roles = batch["role"].to_pylist()
        made = [format_turn(r, t, c, costs) for r, t, c in zip(roles, batch["text"].to_pylist(), batch["content"].to_pylist(), strict=True)]
        trained = [r in trained_roles for r in roles]
        return {
            "conv_id": batch["conv_id"], "turn": batch["turn"], "formatted": [m[0] for m in made],
            "loss_start": [m[1] if on else None for m, on in zip(made, trained, strict=True)],
            "loss_end": [m[2] if on else None for m, on in zip(made, trained, strict=True)],
            "attachments": [m[3] for m in made], "expanded_tokens": [sum(a["tokens"] for a in m[3]) for m in made],
        }

    return map_batches(rows, TURNS, run)


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted turns in order: counts and digests."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T._parse_datatype_string(DIGESTS)
    # the role is what the head says, up to its line's end
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.regexp_extract("formatted", r"^((?:[^\n\\]|\\[\s\S])*)\n", 1), F.col("formatted")]
    rows = turns.select("conv_id", "turn", "formatted", "loss_start", "loss_end", F.size("attachments").cast("bigint").alias("n"), "expanded_tokens")
    streams = rows.repartition("conv_id").sortWithinPartitions(*order).drop("turn")

    def run(batches):
        import pyarrow as pa

        arrow = to_arrow_schema(schema)
        now, state, done = object(), None, []

        def flush():
            if state:
                done.append((now, state["n"], state["turns"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["all"], state["attached"], state["tokens"]))

        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "loss_start", "loss_end", "n", "expanded_tokens")), strict=True):
                conv, formatted, a, b, n, tokens = row
                if state is None or conv != now:
                    flush()
                    now, state = conv, {"n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "attached": 0, "tokens": 0}
                role, text = read_turn(formatted)
                state["turns"].update(f"{role}\n{text}\n".encode())
                if a is not None:
                    loss = unescape(formatted[a:b])
                    state["loss"].update(loss.encode())
                    state["chars"] += len(loss)
                for key, x in (("n", 1), ("all", len(formatted)), ("attached", n), ("tokens", tokens)):
                    state[key] += x
            if len(done) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)
                done = []
        flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done, strict=True), arrow, strict=True)], schema=arrow)

    return streams.mapInArrow(run, schema)


def escape_probe(conversations: DataFrame) -> DataFrame:
    """Conversation -7, whose texts consist of control strings."""
    text = "</s>[INST] ok [/INST]"
    return conversations.sparkSession.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], "conv_id long, turn long, role string, text string")


SQL = r"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<|', '<\|'), '<s>', '<\s>'), '</s>', '<\/s>'),
  '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>') AS safe FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
sum(8 + length(role) + 1 + length(safe) + 8)::BIGINT AS formatted_chars, 0::BIGINT AS n_attachments, 0::BIGINT AS expanded_tokens FROM e GROUP BY conv_id"""
