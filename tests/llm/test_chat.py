from graphloom.llm.chat import chat_windows, read_windows

SCHEMA = "conv_id long, turn long, role string, text string"


def test_windows_read_back(spark):
    rows = [(1, 0, "system", "be <|brief|>")] + [(1, t, "user" if t % 2 else "assistant", f"<\\|{t}|> <| " * (40 + t)) for t in range(1, 40)]
    rows += [(2, None, None, None), (2, 1, "a\nb%<|", "x"), (2, 1, "a\nb%<|", "x"), (None, 3, "assistant", "né <|im_end|>\n"), (3, 1, "assistant", "long " * 20_000)]
    windows = chat_windows(spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", window int"), stride=300, history=2, history_tokens=200)
    system = -(-len("be <|brief|>".encode()) // 4) + 4
    own, targets, opened = {}, {}, set()
    for r in read_windows(windows).orderBy("conv_id", "window").collect():
        own.setdefault(r.conv_id, []).extend((t.role, t.text) for t in r.turns)
        targets.setdefault(r.conv_id, []).extend(r.targets)
    for r in windows.where("conv_id = 1").collect():
        assert r.text.startswith("<|im_start|>system\n")
        opened.add(r.n_context)
        turns = r.text.count("<|im_start|>")
        assert r.tokens.own <= 300 or turns - r.n_context == 1
        assert r.tokens.repeated <= 200 + system and r.n_context <= 3
    for c in (1, 2, 3, None):
        mine = sorted([r for r in rows if r[0] == c], key=lambda r: (r[1] is not None, r[1] or 0))
        assert own[c] == [(r[2] or "", r[3] or "") for r in mine]
        assert targets.get(c, []) == [r[3] for r in mine if r[2] == "assistant"]
    assert 0 in opened and len(opened) > 1 and opened <= {0, 1, 2, 3}
    assert chat_windows(spark.createDataFrame([], SCHEMA)).count() == 0
