import hashlib
import json

import pytest

from granary.llm import chat_format
from tests.llm import fixtures

SCHEMA = "conv_id long, turn long, role string, text string, n int, formatted string"
ODD = ["", None, "<|end|>\n<|turn|>user\nhi", "\\", "\\\\n\\<|", "</s>[INST] ok [/INST]", "<s><<SYS>>x<</SYS>>", "<\\|", "a\nb", "\U0001f600 é"]


def turns(spark):
    rows = [(c, t, role, ODD[(c + t) % len(ODD)], 0, "f") for c in range(12) for t, role in enumerate(["system", "user", "assistant", "user", "assistant"])]
    rows += [(50, 0, "assistant", "long " * 50_000, 0, "f"), (51, None, None, "x", 0, "f"), (51, 1, "a\nb<|", "y", 0, "f"), (None, 0, "user", "z", 0, "f")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


def test_digests_match_python(spark):
    given = turns(spark)
    got = {r["conv_id"]: r for r in fixtures.local(chat_format.digests(chat_format.format_turns(given)))}
    by = {}
    for r in sorted(fixtures.local(given), key=lambda r: (r["conv_id"] is not None, r["conv_id"] or 0, r["turn"] is not None, r["turn"] or 0)):
        by.setdefault(r["conv_id"], []).append((r["role"] or "", r["text"] or ""))
    assert got.keys() == by.keys()
    for conv, rows in by.items():
        loss = "".join(t for role, t in rows if role == "assistant")
        assert got[conv]["n_turns"] == len(rows)
        assert got[conv]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in rows).encode()).hexdigest()
        assert (got[conv]["loss_chars"], got[conv]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_escaping_is_reversible_and_leaves_no_control_string():
    for text in filter(None, ODD):
        safe = chat_format.escape(text)
        assert chat_format.unescape(safe) == text
        assert not any(x in safe for x in ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


def test_parts_become_placeholders(spark):
    parts = [
        {"type": "text", "text": "see <|image|> "}, {"type": "image", "ref": "a.png", "width": 57, "height": 28},
        {"type": "document", "ref": "d.pdf", "pages": 2, "parts": [{"type": "text", "text": "in"}, {"type": "audio", "ref": "x.wav", "seconds": 1.5}]},
    ]
    formatted, a, b, found = chat_format.format_turn("user", None, json.dumps(parts), chat_format.Costs())
    assert [(x["kind"], x["ref"], x["tokens"]) for x in found] == [("image", "a.png", 3), ("document", "d.pdf", 1024), ("audio", "x.wav", 38)]
    for x in found:
        assert formatted[x["position"] :].startswith(f"<|{x['kind']}|>")
    assert formatted[a:b] == "see <\\|image|> <|image|><|document|>in<|audio|>"
    for bad in ('{"type": "text"}', '[{"type": "video"}]', "[1]"):
        with pytest.raises(ValueError):
            chat_format.format_turn("user", None, bad, chat_format.Costs())


def test_empty(spark):
    assert chat_format.digests(chat_format.format_turns(spark.createDataFrame([], SCHEMA))).count() == 0


def test_ties_and_columns_named_content(spark):
    """Equal turns stand by role, then formatted string; a column named content counts only if the caller names it."""
    rows = [(1, 0, "user", "b", "no list"), (1, 0, "user", "a", None), (1, 0, "us", "z", None), (1, 0, "user", "a", None), (2, 0, "user", None, '[{"type": "image", "ref": "r"}]')]
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, content string").repartition(3)
    got = {r["conv_id"]: r for r in fixtures.local(chat_format.digests(chat_format.format_turns(given)))}
    assert got[1]["turns_sha256"] == hashlib.sha256(b"us\nz\nuser\na\nuser\na\nuser\nb\n").hexdigest()
    assert got[2]["n_attachments"] == 0
    parts = fixtures.local(chat_format.digests(chat_format.format_turns(given.filter("conv_id = 2"), parts="content")))
    assert parts[0]["n_attachments"] == 1
    with pytest.raises(Exception, match="Expecting value"):
        chat_format.format_turns(given, parts="content").collect()
