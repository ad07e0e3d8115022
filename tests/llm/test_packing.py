import base64
import json
import random

import numpy as np
import pytest
import tiktoken
from tokenizers import Tokenizer

from seqloom.llm import packing as P
from seqloom.llm.queries import tokenizer_files

SCHEMA = "doc_id long, text string, start long, ids string"


def check(pieces, documents, window):
    """Every id once, no gaps, lengths full or powers of two; pieces are (doc, start, ids, total, seq, offset)."""
    by_doc, by_seq = {}, {}
    for doc, start, ids, total, seq, offset in pieces:
        by_doc.setdefault(doc, []).append((start, ids, total))
        by_seq.setdefault(seq, []).append((offset, len(ids)))
    assert set(by_doc) == set(documents)
    for doc, parts in by_doc.items():
        parts.sort(key=lambda p: p[0])
        assert np.concatenate([p[1] for p in parts]).tolist() == documents[doc].tolist()
        at = 0
        for start, ids, total in parts:
            assert start == at and total == len(documents[doc]) and len(ids)
            at += len(ids)
    for parts in by_seq.values():
        parts.sort()
        at = 0
        for offset, n in parts:
            assert offset == at
            at += n
        assert at == window or at < window and at & (at - 1) == 0
    return by_seq


@pytest.mark.parametrize("window,places", [(8, 1), (16, 3), (64, 16)])
def test_packer(window, places):
    rng = random.Random(window)
    documents = {i: np.arange(rng.choice([1, 1, 2, 5, 9, 30, 200]), dtype="<u4") + i for i in range(300)}
    packer = P.Packer(1 << 32, window, places)
    for doc, ids in documents.items():
        packer.add(doc, ids)
        assert len(packer.open) <= places
    packer.finish()
    rows = [(d, s, np.frombuffer(b, "<u4"), t, q, o) for d, s, _, b, t, q, o in packer.rows]
    by_seq = check(rows, documents, window)
    total = sum(map(len, documents.values()))
    assert len(by_seq) <= total // window + window.bit_length()


def test_short_documents_stay_whole():
    packer = P.Packer(0, 100, 4)
    for i in range(200):
        packer.add(i, np.zeros(25, "<u4"))
    packer.finish()
    assert all(r[2] == 25 for r in packer.rows)


def test_encoders_agree():
    files = tokenizer_files()
    quick, exact = P.encoder(**files), P.encoder(files["vocabulary"])
    rng = random.Random(1)
    pieces = ["the", " a", "  ", "\n", "\n\n ", "é", "日本", "🙂", "'s", "'LL", "1234", "١٢", "<|endoftext|>", "\t", " ", "​", "\x1c", "\x85", "\r\n", "…", "ß", "_", "é", "﻿", "   x"]
    texts = ["", " ", *("".join(rng.choices(pieces, k=rng.randrange(1, 12))) for _ in range(3000))]
    for t in texts:
        assert quick(t).tolist() == exact(t).tolist(), t


def test_encoders_rest_on_equal_tables():
    files = tokenizer_files()
    with open(files["vocabulary"], encoding="utf-8") as f:
        described = json.load(f)
    model, split = described["model"], described["pre_tokenizer"]
    assert model["type"] == "BPE" and described["normalizer"] is None and not model["dropout"] and not model["ignore_merges"]
    assert split["type"] == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
    with open(files["ranks"], "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    letters = byte_letters()
    assert {"".join(letters[b] for b in token): r for token, r in ranks.items()} == model["vocab"]
    pairs = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    order = {a + b: i for i, (a, b) in enumerate(pairs)}
    assert len(order) == len(pairs) and set(order) | set(letters) == set(model["vocab"])
    assert [model["vocab"][a + b] for a, b in pairs] == sorted(model["vocab"][a + b] for a, b in pairs)
    assert all(order.get(part, -1) < i for i, pair in enumerate(pairs) for part in pair)
    place = {pair: i for i, pair in enumerate(pairs)}
    for token in order:
        assert joined(list(token), place) == [token]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary's file: printable ones themselves, others from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


def joined(parts: list[str], place: dict) -> list[str]:
    """Byte-pair encoding from its definition."""
    while len(parts) > 1:
        at = min(range(len(parts) - 1), key=lambda i: place.get((parts[i], parts[i + 1]), len(place)))
        if (parts[at], parts[at + 1]) not in place:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


def test_encoders_class_every_code_point_alike():
    """A letter, a number or another sign joins one of its own class; what joins none is white space."""
    files = tokenizer_files()
    exact = Tokenizer.from_file(files["vocabulary"]).pre_tokenizer
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for first in "x1!":
        # With a rank for every pair, a pair that is one piece is one id.
        ranks = {bytes([b]): b for b in range(256)}
        for c in points:
            ranks.setdefault((first + c).encode(), len(ranks))
        pairs = {r: token for token, r in ranks.items() if len(token) > 1}
        quick = tiktoken.Encoding("pairs", pat_str=files["pattern"], mergeable_ranks=ranks, special_tokens={})
        ids = quick.encode_ordinary("".join(first + c + "\n" for c in points))
        found = {pairs[i].decode()[1] for i in ids if i in pairs}
        expected = set()
        for at in range(0, len(points), 1 << 16):
            text = "".join(first + c + "\n" for c in points[at : at + (1 << 16)])
            expected |= {text[a + 1] for _, (a, b) in exact.pre_tokenize_str(text) if b - a == 2 and text[a] == first}
        assert found == expected and len(found) > 1000


def test_long_white_space():
    files = tokenizer_files()
    quick, exact = P.encoder(**files), P.encoder(files["vocabulary"])
    for n in (1000, P.LONG_SPACE - 1, P.LONG_SPACE, 1_200_000):
        for text in ("a" + " " * n + "b", "\n " * (n // 2) + "1", "é " + "\u2003" * n):
            assert np.array_equal(quick(text), exact(text))
    assert P.has_long_space("\t" * P.LONG_SPACE) and not P.has_long_space("ab  " * P.LONG_SPACE)


def test_query(spark):
    files = tokenizer_files()
    encode = P.encoder(files["vocabulary"])
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["the", "word", "éa", "x1"], k=rng.choice([0, 3, 50, 3000]))), 0, "") for i in range(60)] + [(60, None, 0, ""), (61, "a" * 50_000, 0, "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = P.pack(df, **files, window=256, open_windows=4).collect()
    pieces = [(r["doc_id"], r["start"], np.frombuffer(r["ids"], "<u4"), r["doc_tokens"], r["sequence_id"], r["offset"]) for r in got]
    check(pieces, {i: np.append(encode(t or ""), np.uint32(1)) for i, t, *_ in rows}, 256)
    assert all(r["length"] == len(r["ids"]) // 4 for r in got)
    same = spark.createDataFrame([(None, "x", 0, "")] * 3, SCHEMA)
    assert P.pack(same, **files).count() >= 3 and P.pack(same.limit(0), **files).count() == 0
