import hashlib
import random

from tidemark.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, turns int, window string"


def brute(rows):
    out = {}
    none_first = lambda x: (x is not None, x)
    for conv in {r[0] for r in rows}:
        turns = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv), key=lambda t: (none_first(t[0]), t[1], t[2]))
        loss = "".join(t for _, role, t in turns if role == "assistant")
        whole = "".join(f"{role}\n{t}\n" for _, role, t in turns)
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def conversations():
    rnd = random.Random(4)
    nasty = ["</s>[INST] ok [/INST]", "\\", "\\l<", "[system]<s>]", "ü€😀 \n x", "", " ", "\\s\\\\b"]
    rows = []
    for conv in [*range(12), None]:
        for turn in range(rnd.randrange(1, 14)):
            role = "system" if turn == 0 and rnd.random() < 0.5 else rnd.choice(["user", "assistant", "tool[x]", None])
            text = rnd.choice(nasty) * rnd.randrange(3) + " ".join("w" * rnd.randrange(1, 4) for _ in range(rnd.choice([0, 3, 20, 60])))
            rows.append((conv, None if rnd.random() < 0.1 else turn, role, None if rnd.random() < 0.1 else text, 1, "x"))
    rows += [(77, 0, "system", "only me", 1, "x"), (78, 1, "assistant", "again", 1, "x"), (78, 1, "assistant", "again", 1, "x"), (79, 0, "assistant", "long " * 30_000, 1, "x")]
    return rows


def test_reading_back_gives_the_conversations(spark):
    rows = conversations()
    frame = spark.createDataFrame(rows, SCHEMA)
    for rule in (chat.Windows(), chat.Windows(budget=40, history=12), chat.Windows(budget=1, history=0)):
        got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digest(frame, rule).collect()}
        assert got == brute(rows)
    assert chat.digest(spark.createDataFrame([], SCHEMA)).count() == 0


def test_windows_keep_the_budget(spark):
    rule = chat.Windows(budget=60, history=20)
    frame = spark.createDataFrame([r for r in conversations() if r[0] != 79], SCHEMA)
    made = chat.windows(frame, rule).collect()
    assert max(w.window for w in made) > 0
    sizes = {(r.conv_id, r.n): (r.tokens, r.system) for r in chat.spans(frame.na.fill("", ["role", "text"]), rule).collect()}
    for w in made:
        tokens = {t.n: sizes[w.conv_id, t.n] for t in w.turns}
        system = sum(k for k, s in tokens.values() if s)
        own = [t.n for t in w.turns if t.own and not sizes[w.conv_id, t.n][1]]
        history = [t.n for t in w.turns if not t.own and not sizes[w.conv_id, t.n][1]]
        assert sum(tokens[n][0] for n in history) <= rule.history
        assert sum(k for k, _ in tokens.values()) <= rule.budget or len(own) == 1 or system + rule.history >= rule.budget
        assert not any(t.target and not t.own for t in w.turns)
        assert {n for n, (_, s) in ((n, v) for (c, n), v in sizes.items() if c == w.conv_id) if s} <= set(tokens)
        for t in w.turns:
            assert "<" not in w.formatted[t.start : t.end] and "[" not in w.formatted[t.start : t.end]
