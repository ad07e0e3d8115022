"""Each stage against a plain version of it, on the smallest tables and on hand-made documents."""

import os
import random

import duckdb
import numpy as np
import pytest

import corpus_pipeline as C
from seqloom.llm import decontaminate, packing, pii, queries
from tests.llm.test_jaccard_join import brute as brute_classes
from tests.llm.test_packing import check

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Documents with every kind of case, and a benchmark."""
    root = tmp_path_factory.mktemp("tables")
    rng = random.Random(1)
    word = lambda: "".join(rng.choices("abcdefghé", k=rng.choice([3, 4, 5, 6])))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, f"What is {prose(12)}? It is {prose(6)}.") for i in range(8)]
    texts = [prose(rng.choice([60, 90, 150])) for _ in range(60)]
    texts += texts[:6] + [t + " more words" for t in texts[6:12]]
    texts += [prose(40) + " " + items[i][1] + " " + prose(40) for i in range(8)]
    texts += [prose(70) + f" mail a{i}@b{i}.co or +1 555 555 {1000 + i} " + prose(9) for i in range(6)]
    texts += [prose(80) + f" mail a{i} (at) b{i} (dot) co" for i in range(3)]
    texts += [None, "", "short", "$$$ " * 90, "x y " * 80, " ".join(word() + "***" for _ in range(90)), "same line here now\n" * 50]
    rows = [(i, t, rng.choice(["en", "de", None]), rng.choice(["a", "b", None]), None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("where", ["made", "given"])
def test_stages(spark, tables, tmp_path, where):
    sf = tables if where == "made" else SMALL
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(C.STAGES)
    assert len(C.STAGES) == 5

    def step(name, docs):
        stages[name](spark, docs, sf).write.parquet(str(tmp_path / name))
        return spark.read.parquet(str(tmp_path / name))

    kept = step("quality rules", docs)
    assert kept.columns == COLUMNS
    con = duckdb.connect()
    place = f"{sf}/documents.parquet" + ("/*.parquet" if os.path.isdir(f"{sf}/documents.parquet") else "")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{place}'")
    want = {d for (d,) in con.execute(f"SELECT doc_id FROM ({queries.OP4_SQL}) WHERE kept").fetchall()}
    assert {r["doc_id"] for r in kept.collect()} == want and want

    single = step("near duplicates", kept)
    assert single.columns == COLUMNS
    rows = [(r["doc_id"], r["text"]) for r in kept.collect()]
    assert {r["doc_id"] for r in single.collect()} == {c for _, c, _ in brute_classes(rows)}

    clean = step("benchmark decontamination", single)
    assert clean.columns == COLUMNS
    items = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    parts = [[decontaminate.Part(p) for p in decontaminate.question_and_answer(t)] for t in items]
    leaks = lambda t: any(min(p.overlap(w) for p in two) >= 0.8 - 1e-9 for w in [decontaminate.words_of(t)] for two in parts)
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in single.collect() if not leaks(r["text"])}

    redacted = step("personal data", clean)
    assert redacted.columns == COLUMNS
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    found = {r["doc_id"]: r for r in redacted.collect()}
    assert set(found) == set(texts)
    for d, r in found.items():
        assert r["text"] == pii.redact_text(texts[d]) and r["n_chars"] == len(r["text"]) and pii.find_plain(r["text"]) == []
    if where == "made":
        assert sum("<EMAIL>" in r["text"] for r in found.values()) == 9

    encode = packing.encoder(queries.tokenizer_files()["vocabulary"])
    pieces = step("packing", redacted).collect()
    documents = {d: np.append(encode(r["text"]), np.uint32(1)) for d, r in found.items()}
    check([(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in pieces], documents, 2048)

    whole = sorted((r["doc_id"], r["start"]) for r in C.run(spark, sf).collect())
    assert len({d for d, _ in whole}) == len(documents) and {d for d, _ in whole} == set(documents)
