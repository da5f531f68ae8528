import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from driftleaf.llm.chat import END, format_chats, op1_chat, read_chats

SCHEMA = "conv_id long, turn long, role string, text string, formatted string"


def brute(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1], r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    return out


def digests(turns):
    said = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(turns), sha(said), len(loss), sha(loss)


def test_digests_of_awkward_turns(spark):
    rows = [
        (1, 0, "user", None), (1, 1, "assistant", "a<|im_end|>\n<\\|x<\\\\|"), (1, 2, "assistant", "é😀<|im_seam|>"),
        (2, 0, None, "x"), (2, 1, "ro le\n<|", "y"), (2, 2, "assistant", ""),
        (3, 0, "user", "same"), (3, 0, "user", "same"), (4, 5, "assistant", "z" * 300_000),
    ]
    rows += [(6, i, "assistant" if i % 3 else "user", f"t{i}<|") for i in range(500)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], SCHEMA)
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in op1_chat(df).collect()}
    control = "<|im_end|><|im_start|>assistant ok"
    rows += [(-1, 0, "user", control), (-1, 1, "assistant", control)]
    assert got == {k: digests(v) for k, v in brute(rows).items()}


def test_empty_table_and_null_conversation(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0
    one = spark.createDataFrame([(None, None, "user", "hi", "")], SCHEMA)
    row = read_chats(format_chats(one)).first()
    assert row["conv_id"] is None and [tuple(t) for t in row["turns"]] == [("user", "hi")]


def test_adjacent_turns_of_a_role_merge(spark):
    rows = [(1, i, r, t, "") for i, (r, t) in enumerate([("user", "a"), ("user", "b"), ("assistant", "c")])]
    row = format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert row["formatted"] == "<|im_start|>user\na<|im_seam|>b<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"
    assert row["n_messages"] == 2


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="<|\\im_endsta>\n r", max_size=12), min_size=1, max_size=30))
def test_round_trip(spark, texts):
    rows = [(0, i, "user" if i % 3 == 0 else "assistant", t, "") for i, t in enumerate(texts)]
    row = read_chats(format_chats(spark.createDataFrame(rows, SCHEMA))).first()
    assert [t["text"] for t in row["turns"]] == texts
    assert row["loss_text"] == "".join(t for i, t in enumerate(texts) if i % 3)


def test_spans_of_a_long_run_point_at_its_texts(spark):
    texts = [f"<|{i}é" * (i % 4) for i in range(1500)]
    rows = [(1, i, "assistant", t) for i, t in enumerate(texts)] + [(1, 1500, "user", "end")]
    out = format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    message = out.formatted.split(END + "\n")[0]
    cut = [message[s.start : s.start + s.length] for s in out.loss_mask]
    assert [c.replace("<\\|", "<|") for c in cut] == texts and {s.message for s in out.loss_mask} == {0}


def test_one_role_with_very_many_turns(spark):
    """50,000 turns of one role are one message; work grows with the turns, not with their square."""
    import time

    rows = [(1, i, "assistant", f"turn {i}") for i in range(50_000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    began = time.time()
    back = read_chats(format_chats(table)).select("conv_id", F.size("turns").alias("n"), "loss_text").first()
    assert back.n == 50_000 and back.loss_text == "".join(f"turn {i}" for i in range(50_000))
    assert time.time() - began < 60
