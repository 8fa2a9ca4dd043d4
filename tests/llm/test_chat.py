from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from quaymetrics.llm import chat

ROWS = [
    (1, 1, "assistant", "yes & <b>no</b>"), (1, 0, "user", "a\nb"), (1, 2, "user", None), (2, 0, "assistant", "</turn>\n<turn:assistant>"),
    (2, 0, "assistant", "&lt;turn&amp;&gt;"), (3, 0, None, "x"), (3, 1, "od>d<r&", ""), (4, None, "user", "first"), (4, 0, "assistant", "é🙂"),
    (5, 0, "assistant", ""), (5, 0, "assistant", ""), (None, 0, "user", "nobody"), (-7, 0, "user", "\\### Assistant: </turn> ok"),
    (-7, 1, "assistant", "\\### Assistant: </turn> ok"), (6, 0, "assistant", "<" * 50_000),
]
KINDS = "conv_id long, turn int, role string, text string, at string, turns int, body double"


def brute():
    out = {}
    for conv in {r[0] for r in ROWS}:
        turns = sorted(((r[1] is not None, r[1] or 0), r[2] or "", r[3] or "") for r in ROWS if r[0] == conv)
        said = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        out[conv] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def table(spark):
    return spark.createDataFrame([(*r, "x", 3, 1.0) for r in ROWS], KINDS)


def test_reads_back_what_was_said(spark):
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.chat_report(table(spark).repartition(3)).collect()}
    assert got == brute()


def test_loss_mask_covers_each_assistant_text_once(spark):
    for r in chat.format_chat(table(spark)).collect():
        spans = [(s["start"], s["end"]) for s in r["loss"]]
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False))
        for start, end in spans:
            assert r["formatted"][:start].endswith("<turn:assistant>") and r["formatted"][end:].startswith("</turn>\n")
        assert r["formatted"].count("<turn:") == r["formatted"].count("</turn>") == r["n_turns"]


def test_parts_become_ordered_placeholders(spark):
    part = "struct(type, text, ref, width, height, seconds, pages)"
    parts = spark.createDataFrame(
        [
            (1, 0, "user", [("text", "see <", None, None, None, None, None), ("image", None, "i.png", 1024, 513, None, None), ("audio", None, "a.wav", None, None, 2.5, None), ("text", "!", None, None, None, None, None)]),
            (1, 1, "assistant", [("text", "a", None, None, None, None, None), ("document", None, "d.pdf", None, None, None, 3), ("text", "b", None, None, None, None, None), ("odd", None, "o", None, None, None, None)]),
            (2, 0, "assistant", None),
        ],
        f"conv_id long, turn int, role string, parts array<{chat.PART}>",
    )
    assert part
    out = {r["conv_id"]: r for r in chat.format_chat(parts, F.col("parts")).collect()}
    one = out[1]
    assert one["formatted"] == "<turn:user>see &lt;<image:1><audio:2>!</turn>\n<turn:assistant>a<document:1>b<other:2></turn>\n"
    assert [one["formatted"][s["start"] : s["end"]] for s in one["loss"]] == ["a", "b"]
    assert [tuple(a) for a in one["attachments"]] == [(0, 1, "i.png", 680), (0, 2, "a.wav", 63), (1, 1, "d.pdf", 1800), (1, 2, "o", 1)]
    assert one["attachment_tokens"] == 680 + 63 + 1800 + 1 and out[2]["formatted"] == "<turn:assistant></turn>\n"


def test_empty_table(spark):
    assert chat.chat_report(table(spark).limit(0)).collect() == []
