import random
from collections import Counter

import pytest

from seqloom.llm import quality_rules as Q

SCHEMA = "doc_id long, text string, lang string, source string, kept string, _words string"


def base(text):
    text = text or ""
    import re

    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choices("abcdefgé", k=n))
    found = [None, "", " \t\n", "one", "a b a b a b", "x " * 500, "same line\n" * 60, "\u00a0nbsp is a letter\u00a0", "\x1c\x85 x", "long " + "y" * 100_000]
    found += [" ".join(word(rng.choice([2, 5, 7])) for _ in range(rng.choice([60, 200]))) for _ in range(60)]
    found += [" ".join(word(5) + "$$$" for _ in range(100)), "\n".join(f"{word(5)} {word(6)}" if i % 2 else "dup line" for i in range(120))]
    found += [" ".join(rng.choices(["aa", "bb", "cc"], k=300)), "MANY!! " * 3 + " ".join(word(14) for _ in range(80))]
    return found


def test_base_and_verdicts(spark):
    rows = [(i, t, "en", "s", "was here", "x") for i, t in enumerate(texts())]
    got = {r["doc_id"]: r for r in Q.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == base(t)
        assert r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"])
        assert not (r["kept"] and r["base_failed"])
    assert all(got[i]["kept"] for i in range(10, 70))  # plain prose stays
    assert not any(got[i]["kept"] for i in range(70, 74))  # symbols, repeated lines, repeats, long words go


def test_verdict_can_be_filtered(spark):
    rows = [(i, t, "en", "s", None, None) for i, t in enumerate(texts())]
    judged = Q.judge(spark.createDataFrame(rows, SCHEMA))
    assert judged.where("kept").count() == sum(r["kept"] for r in judged.collect())


def test_groups_have_their_own_thresholds(spark):
    rng = random.Random(2)
    def prose(n):
        return " ".join("".join(rng.choices("abcdef", k=n)) for _ in range(100))
    rows = [(i, prose(5), "en", None, None, None) for i in range(20)] + [(100 + i, prose(12), None, "b", None, None) for i in range(20)]
    rows += [(200, prose(12), "en", None, None, None), (201, prose(5), None, "b", None, None)]
    kept = {r["doc_id"]: r["kept"] for r in Q.judge(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(kept[i] for i in range(20)) and all(kept[100 + i] for i in range(20))
    assert not kept[200] and not kept[201]


def test_beyond_broadcast(spark, monkeypatch):
    rows = [(i, t, "en", f"s{i % 3}" if i % 4 else None, None, None) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, SCHEMA)
    want = sorted(Q.judge(df).select("doc_id", "kept").collect())
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", 0)
    assert sorted(Q.judge(df).select("doc_id", "kept").collect()) == want


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, "a b c " * 30, "en", "s", None, None)] * 3 + [(None, None, None, None, None, None)]
    assert Q.judge(spark.createDataFrame(rows, SCHEMA)).count() == 4
    assert Q.judge(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("column", ["n_words", "base_failed", "symbols_pm"])
def test_clashing_columns(spark, column):
    rows = [(1, "word " * 60, "en", "s", "mine")]
    out = Q.judge(spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, {column} string"))
    assert out.columns.count(column) == 1 and out.first()["n_words"] == 60


def test_any_column_passes_through(spark):
    names = ["_lang", "_source", "_max_symbols_pm", "_words", "_lines", "_n_lines", "_grams", "_at", "doc", "a.b", "c`d", "N_WORDS", "kept"]
    schema = "doc_id long, text string, lang string, source string, " + ", ".join("`" + n.replace("`", "``") + "` string" for n in names)
    rows = [(i, t, "en", "s", *[f"{n} {i}" for n in names]) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, schema)
    judged = Q.judge(df)
    assert [c for c in judged.columns if c in df.columns] == [c for c in df.columns if c not in ("N_WORDS", "kept")] + ["kept"]
    plain = {r["doc_id"]: r["kept"] for r in Q.judge(df.select("doc_id", "text", "lang", "source")).collect()}
    assert {r["doc_id"]: r["kept"] for r in judged.collect()} == plain
    good = Q.keep_good(df)
    assert good.columns == df.columns
    assert sorted(tuple(r) for r in good.collect()) == sorted(r for r in rows if plain[r[0]])
