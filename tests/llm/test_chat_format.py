import hashlib

from quillspark.llm.chat_format import chat_digest, format_chats, read_chats

TURNS = [
    (1, 0, "system", "be \\ kind"), (1, 1, "user", "hi <|end|> <|start|>assistant<|sep|>no"), (1, 2, "user", None), (1, 3, "assistant", "\\<|join|>\\"), (1, 4, "assistant", "é😀\n<"),
    (2, 5, "assistant", ""), (2, 5, "assistant", ""), (2, 1, "user", "<|<||>\\|"), (3, 0, None, "no role"), (3, None, "assistant", "first"), (None, 0, "user", "lost"), (4, 0, "a<|b\\", "x"),
    (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
]


def expected():
    out = {}
    for c, t, r, x in sorted(TURNS, key=lambda v: (str(v[0]), v[1] is not None, v[1] or 0, v[2] or "", v[3] or "")):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def test_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id bigint, turn bigint, role string, text string").selectExpr("*", "1 AS t", "2 AS formatted").repartition(3)
    made = format_chats(df)
    want = expected()
    for r in read_chats(made).collect():
        assert [tuple(t) for t in r.turns] == want[r.conv_id]
    for r in made.collect():
        said = [r.formatted[s.start : s.start + s.length] for s in r.loss_spans]
        assert [s.replace("\\\\", "\0").replace("<\\|", "<|").replace("\0", "\\") for s in said] == [x for role, x in want[r.conv_id] if role == "assistant"]
    one = next(r.formatted for r in made.collect() if r.conv_id == 1)
    assert one.count("<|start|>") == 3 and one.count("<|join|>") == 2
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in chat_digest(made).collect():
        turns = want[r.conv_id]
        loss = "".join(x for role, x in turns if role == "assistant")
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)), len(loss), sha(loss))


def test_long_and_empty(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"t{i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    assert chat_digest(format_chats(df)).first().n_turns == 3000
    assert chat_digest(format_chats(df.where("turn < 0"))).count() == 0


def test_the_loss_mask_makes_the_loss_digest(spark):
    long = [(9, 0, "user", "q" * 5000), (9, 1, "assistant", "😀\\" * 6000), (9, 2, "user", ""), (9, 3, "assistant", "end"), (9, 4, "assistant", None)]
    made = format_chats(spark.createDataFrame(TURNS + long, "conv_id bigint, turn bigint, role string, text string"))
    right = {r.conv_id: r for r in chat_digest(made).collect()}
    assert right[9].loss_chars == 12_003
    assert right[9].loss_sha256 == hashlib.sha256(("😀\\" * 6000 + "end").encode()).hexdigest()
    shifted = made.selectExpr("conv_id", "formatted", "transform(loss_spans, s -> named_struct('start', s.start - 1, 'length', s.length)) AS loss_spans")
    none = made.selectExpr("conv_id", "formatted", "filter(loss_spans, s -> false) AS loss_spans")
    for r in chat_digest(shifted).collect():
        if right[r.conv_id].loss_chars:
            assert r.loss_sha256 != right[r.conv_id].loss_sha256 and r.turns_sha256 == right[r.conv_id].turns_sha256
    assert all(r.loss_chars == 0 for r in chat_digest(none).collect())
