import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqloom.llm import chat_format as C

SCHEMA = "conv_id long, turn long, role string, text string, segments string"
NASTY = ["", "\\", "</turn>\n", "<turn user>\n", "<next/>", "\\l/turn>", "\\b", "a\\lb<turn", "ok", "</turn", "\n", "\\### Assistant: </turn> ok", ">\n", "é<"]


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    out = C.format_conversations(df)
    back = out.withColumn("turns", C.read_back(F.col("formatted"))).collect()
    return {r["conv_id"]: r for r in back}, {r["conv_id"]: r for r in C.digests(out).collect()}


def test_round_trip(spark):
    rows, want, k = [], {}, 0
    for conv, a in enumerate(NASTY):
        for turn, b in enumerate(NASTY):
            role = ["user", "assistant", "user", "we>ird\n<turn\\"][(conv + turn) % 4]
            rows.append((conv, turn, role, a + b, "x"))
            want.setdefault(conv, []).append((role, a + b))
            k += 1
    formatted, digests = run(spark, rows)
    for conv, turns in want.items():
        r, d = formatted[conv], digests[conv]
        assert [(t["role"], t["text"]) for t in r["turns"]] == turns
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
        loss = "".join(t for role, t in turns if role == "assistant")
        assert d["loss_chars"] == len(loss) and d["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
        assert d["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert d["n_turns"] == len(turns) and d["formatted_chars"] == len(r["formatted"])


def test_merges_adjacent_roles(spark):
    rows = [(1, i, role, f"t{i}", "x") for i, role in enumerate(["user", "user", "assistant", "assistant", "user"])]
    formatted, digests = run(spark, rows)
    assert formatted[1]["formatted"] == "<turn user>\nt0<next/>t1</turn>\n<turn assistant>\nt2<next/>t3</turn>\n<turn user>\nt4</turn>\n"
    assert digests[1]["n_blocks"] == 3 and digests[1]["n_turns"] == 5


def test_defined_cases(spark):
    rows = [
        (1, None, "user", "first", "x"),
        (1, 0, None, None, "x"),
        (1, 1, "assistant", "same", "x"),
        (1, 1, "assistant", "same", "x"),
        (None, 5, "assistant", "lost", "x"),
        (None, 4, "user", "and found", "x"),
        (2, 0, "assistant", "z" * 200_000, "x"),
    ]
    formatted, digests = run(spark, rows)
    assert [(t["role"], t["text"]) for t in formatted[1]["turns"]] == [("user", "first"), ("", ""), ("assistant", "same"), ("assistant", "same")]
    assert [t["text"] for t in formatted[None]["turns"]] == ["and found", "lost"]
    assert digests[2]["loss_chars"] == 200_000
    assert run(spark, [])[0] == {}


def test_same_turn_is_ordered_by_role_and_text(spark):
    rows = [(1, 0, "user", "b", "x"), (1, 0, "user", "a", "x"), (1, 0, "assistant", "c", "x")]
    assert [(t["role"], t["text"]) for t in run(spark, rows)[0][1]["turns"]] == [("assistant", "c"), ("user", "a"), ("user", "b")]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<turn", "</turn", ">\n", "\\", "b", "l", "<next/>", " ", "x"]), max_size=8).map("".join), min_size=1, max_size=30))
def test_random_texts(texts):
    from pyspark.sql import SparkSession

    from seqloom.session import local_session

    spark = SparkSession.getActiveSession() or local_session("tests", cpus=4)
    rows = [(1, i, "user" if i % 3 else "assistant", t, "x") for i, t in enumerate(texts)]
    assert [t["text"] for t in run(spark, rows)[0][1]["turns"]] == texts
