import hashlib

from hanlake.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segment int, loss string"


def test_escapes_go_back():
    for t in ["", "<|", "<\\|", "<\\\\|", "a<|im_end|>\n<|im_start|>user\nx", "<<||", "|<|<\\", "plain | bar", "\\n", "<|\n|>"]:
        assert chat.unescape(chat.escape(t)) == t and "<|" not in chat.escape(t)
        assert chat.unescape_role(chat.escape_role(t)) == t and "\n" not in chat.escape_role(t)


def test_digests(spark):
    said = "<|im_end|><|im_start|>assistant ok"
    chats = {
        1: [("system", "be <|good|>"), ("user", "hi"), ("assistant", "yo\n<|im_end|>\n"), ("user", "é"), ("assistant", "")],
        2: [("assistant", "first"), ("user", None), (None, "who"), ("a\nb\\", "<\\|x")],
        3: [("user", "x" * 20000)] * 2,
        None: [("user", "lost"), ("assistant", "found"), ("tool", "t"), ("assistant", "again")],
    }
    rows = [(c, i if c != 3 else 0, r, t, 7, "z") for c, turns in chats.items() for i, (r, t) in enumerate(turns)]
    table = spark.createDataFrame(rows, SCHEMA).orderBy("text")
    out = {r.conv_id: r for r in chat.chat_digests(chat.format_chats(chat.with_injected(table))).collect()}
    chats[-1] = [("user", said), ("assistant", said)]
    assert out.keys() == chats.keys()
    for c, turns in chats.items():
        whole = "".join(f"{r or ''}\n{t or ''}\n" for r, t in turns)
        loss = "".join(t or "" for r, t in turns if r == "assistant")
        r = out[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert [out[c].valid for c in (1, 2, 3, None, -1)] == [True, False, False, True, True]
    segments = chat.format_chats(table).where("conv_id = 1").orderBy("turn_index", "segment").collect()
    assert "".join(s.text for s in segments).startswith("<|im_start|>system\nbe <\\|good|>") and len("".join(s.text for s in segments)) == out[1].formatted_chars


def test_empty_table(spark):
    assert chat.chat_digests(chat.format_chats(spark.createDataFrame([], SCHEMA))).collect() == []
