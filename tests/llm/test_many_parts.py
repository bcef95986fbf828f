"""Chat messages of very many parts, against plain Python."""

import time

from ledgerlens.llm import chat


def test_messages_of_many_parts(spark):
    n = 32_000
    kinds = [("text", f"t{i}<|") if i % 3 else ("image", None) for i in range(n)]
    parts = [{"kind": k, "text": t, "uri": None if t else f"u{i}"} for i, (k, t) in enumerate(kinds)]
    rows = [(1, 0, "user", parts[:5]), (1, 1, "assistant", parts), (2, 0, "assistant", None), (3, 0, None, [])]
    table = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    began = time.monotonic()
    got = {r["conv_id"]: r for r in chat.format_chat(table, parts_col="parts").collect()}
    assert time.monotonic() - began < 60

    body, spans, attached = "<|im_start|>user\n", [], []
    for turn, here in enumerate((kinds[:5], kinds)):
        if turn:
            body += "<|im_end|>\n<|im_start|>assistant\n"
        pieces, at = [], len(body)
        for i, (kind, text) in enumerate(here):
            piece = text.replace("<|", "<\\|") if text else "<|image|>"
            if text and turn:
                spans.append((at, len(piece)))
            if not text:
                attached.append((len(attached), turn, "image", f"u{i}", chat.IMAGE_TOKENS))
            pieces.append(piece)
            at += len(piece)
        body += "".join(pieces)
    assert got[1]["formatted"] == body + "<|im_end|>\n"
    assert [tuple(s) for s in got[1]["loss_spans"]] == spans
    assert [tuple(a) for a in got[1]["attachments"]] == attached
    assert got[1]["expanded_tokens"] == chat.IMAGE_TOKENS * len(attached)
    assert got[2]["formatted"] == "<|im_start|>assistant\n<|im_end|>\n" and got[2]["loss_spans"] == []
    assert got[3]["formatted"] == "<|im_start|>\n<|im_end|>\n"
