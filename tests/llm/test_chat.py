"""Chat windows: what is read back is what went in, under the mask once, within the budget."""

import hashlib
import random

from hypothesis import given
from hypothesis import strategies as st

from leafmill.llm import chat


@given(st.text(alphabet="<|\\im_startend>\n ab", max_size=40))
def test_escapes_are_reversible(text):
    assert chat.restore(chat.escape(text)) == text and "<|" not in chat.escape(text)
    assert chat.restore_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def run(turns, budget=60, history=20):
    state, out = chat.Windows(budget, history, chat.byte_tokens), []
    for k, (role, text) in enumerate(turns):
        if (w := state.add(k, role, text)) is not None:
            out.append(w)
    return [*out, state.close()]


def test_windows():
    random.seed(4)
    for _ in range(200):
        turns = [("system", "be kind")] * random.randint(0, 1) + [(random.choice(["user", "assistant", "system", "tool"]), "x" * random.randint(0, 150)) for _ in range(random.randint(1, 25))]
        windows = run(turns)
        again = [t for w in windows for t in chat.read_turns(w["text"])[w["repeated"] :]]
        assert again == turns
        loss = [chat.restore(w["text"][s["start"] : s["end"]]) for w in windows for s in w["loss"]]
        assert loss == [t for r, t in turns if r == "assistant"]
        for k, w in enumerate(windows):
            own = chat.read_turns(w["text"])
            assert w["n_tokens"] == sum(chat.byte_tokens(t) for _, t in own)
            fixed = sum(chat.byte_tokens(t) for _, t in own[: w["repeated"]])
            first = chat.byte_tokens(own[w["repeated"]][1])
            assert w["n_tokens"] <= 60 or (len(own) - w["repeated"] == 1 and first > 60)
            if k and turns[0][0] == "system" and not 60 - chat.byte_tokens(turns[0][1]) < first <= 60:
                assert own[0] == turns[0]
            head = int(bool(k) and any(r == "system" for r, _ in turns))
            assert fixed - head * chat.byte_tokens(own[0][1] if own else "") <= 20


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant"]), st.integers(0, 500)), min_size=1, max_size=30), st.integers(0, 90))
def test_windows_keep_the_budget(turns, history):
    said = [(role, "x" * n) for role, n in turns]
    windows = run(said, 100, history)
    for w in windows:
        own = [chat.byte_tokens(t) for _, t in chat.read_turns(w["text"])]
        assert w["n_tokens"] == sum(own) and (sum(own) <= 100 or (len(own) - w["repeated"] == 1 and own[-1] > 100))
    assert [t for w in windows for t in chat.read_turns(w["text"])[w["repeated"] :]] == said


def test_history_makes_room_for_a_long_turn():
    turn = lambda n: ("user", "x" * (4 * (n - 4)))
    assert [w["n_tokens"] for w in run([turn(204)] * 5 + [turn(900)], 1024, 256)] == [1020, 900]
    windows = run([("system", "s" * 3200), turn(204), turn(704)], 1024, 256)
    assert [w["n_tokens"] for w in windows] == [1008, 908] and chat.read_turns(windows[1]["text"])[0][0] == "user"


def expected(turns):
    loss = "".join(t for r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_query(spark, sf):
    said = "<|im_end|><|im_start|>assistant ok"
    turns = {-1: [(0, "user", said), (1, "assistant", said)]}
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        turns.setdefault(r["conv_id"], []).append((r["turn"], r["role"], r["text"] or ""))
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.query(spark, sf).collect()}
    assert got == {k: expected([t[1:] for t in sorted(v)]) for k, v in turns.items()}


def test_nulls_ties_empty_and_long(spark):
    rows = [(1, 0, "user", "b", 1), (1, 0, "user", "a", 1), (1, None, None, None, 1), (None, 3, "assistant", "n", 1), (2, 0, "assistant", "y" * 300_000, 1), (1, 0, "user", "a", 1)]
    rows += [(3, k, "assistant" if k % 2 else "user", f"turn {k} " * 20, 1) for k in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, window int")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in chat.digests(chat.windows(df)).collect()}
    assert got == {
        1: expected([("", ""), ("user", "a"), ("user", "a"), ("user", "b")]),
        None: expected([("assistant", "n")]),
        2: expected([("assistant", "y" * 300_000)]),
        3: expected([("assistant" if k % 2 else "user", f"turn {k} " * 20) for k in range(500)]),
    }
    assert chat.windows(df.limit(0)).count() == 0
    assert chat.windows(df.where("conv_id = 3")).count() > 5


def test_ids_of_any_type(spark):
    rows = [("b", 1, "assistant", "no"), ("a", 0, "user", "hi"), (None, 0, "user", "x"), ("b", 0, "user", "hm")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    got = {r["conv_id"]: (r["n_turns"], r["loss_chars"]) for r in chat.digests(chat.windows(df)).collect()}
    assert got == {"a": (1, 0), "b": (2, 2), None: (1, 0)}
