"""Operator 3 against a plain version."""

import hashlib
import re

import xxhash
from pyspark.sql import functions as F

from twinscan.llm import winnowing as W
from twinscan.llm import queries

from .helpers import ODD, no_docs, odd_docs

M = (1 << 64) - 1


def plain(text, k=W.K, w=W.W):
    tokens = [xxhash.xxh64(t.encode(), 42).intdigest() for t in re.findall(W.TOKEN, text or "", re.ASCII)]
    if not tokens:
        return []
    rotate = lambda x, n: ((x << n) | (x >> (64 - n))) & M if n else x
    coded = []
    for i in range(max(1, len(tokens) - k + 1)):
        h = 0
        for j in range(k):
            h ^= rotate(tokens[i + j] if i + j < len(tokens) else 0, k - 1 - j)
        h = (h & ~W._PLACES) | (W._PLACES - i)
        coded.append(h - (1 << 64) if h >> 63 else h)
    out = []
    for i in range(max(1, len(coded) - w + 1)):
        least = min(coded[i : i + w])
        if least not in out:
            out.append(least)
    return out


def test_marks(spark):
    texts = ["a b c d e f g h i j k l", "same same same same same same same same same same", "x", "", "é ü 漢字 b", "word " * 40]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in W.fingerprint(df).collect():
        assert r.marks == plain(texts[r.doc_id]), texts[r.doc_id]


def test_tokens_by_ranges_are_those_of_the_negated_class():
    plain_token = rf"[{W._ALONE}]|[^\s{W._ALONE}]{{1,16}}"
    edges = [chr(c + d) for c in (9, 13, 32, 133, 0x3000, 0x3040, 0x30FF, 0x3400, 0x9FFF, 0xAC00, 0xD7AF, 0x10FFFE, 0x1F600) for d in (-1, 0, 1)]
    text = "".join(f"{a}{b}x" for a in edges for b in edges) + "y" * 40
    assert re.findall(W.TOKEN, text, re.ASCII) == re.findall(plain_token, text, re.ASCII)
    assert r"\s" not in W.TOKEN


def test_marks_of_any_sizes_without_an_array_per_window(spark):
    texts = [" ".join("abcab"[i * i % 5] * (1 + i % 3) for i in range(n)) for n in range(14)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for k, w in ((4, 6), (1, 1), (3, 5), (5, 2)):
        found = df.select("doc_id", W.marks(F.col("text"), k, w).alias("m"))
        assert "array_min" not in found._jdf.queryExecution().toString()
        assert all(r.m == plain(texts[r.doc_id], k, w) for r in found.collect())


def test_rightmost_of_equal_hashes(spark):
    df = spark.createDataFrame([(0, "z " * 30)], "doc_id long, text string")
    [r] = W.fingerprint(df).collect()
    assert r.positions == list(range(W.W - 1, 30 - W.K + 1))


def test_shared_run_is_found(spark):
    shared = " ".join(f"s{i}" for i in range(W.W + W.K - 1))
    df = spark.createDataFrame([(0, f"a b c {shared} d e f"), (1, f"u v {shared} w x y z")], "doc_id long, text string")
    a, b = (set(r.hashes) for r in W.fingerprint(df).collect())
    assert a & b


def test_edited_texts(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet").orderBy("doc_id").collect()
    got = {r.doc_id: r for r in queries.op3_winnowing(spark, tiny).collect()}
    assert len(got) == len(docs)
    for i, d in enumerate(docs):
        after, m = docs[(i + 1) % len(docs)].text, len(d.text) // 4
        text = d.text[: len(d.text) - m] + after[:m]
        assert got[d.doc_id].edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        mine, theirs, other = ({x >> W.PLACE_BITS for x in plain(t)} for t in (d.text, text, after))
        for a, b, found in ((mine, theirs, got[d.doc_id].near_edited), (mine, other, got[d.doc_id].near_next)):
            assert abs(found - (len(a & b) / len(a | b) if a | b else 1.0)) < 1e-12


def test_ranges_join_up(spark):
    df = spark.createDataFrame([(i * 37 % 1009 - 50, f"t{i}") for i in range(500)], "doc_id long, text string")
    rows = sorted((r.doc_id, r.text, r.next_text) for r in W.with_next(df, "doc_id", ["text"], ["text"], rows=20).collect())
    assert len(rows) == 500
    assert [r[2] for r in rows] == [r[1] for r in rows[1:]] + [rows[0][1]]


def test_odd_rows(spark):
    got = W.edited(odd_docs(spark)).select("doc_id", "n_chars", W.digest(F.col("marks")).alias("f")).collect()
    assert len(got) == len(ODD)
    assert len({r.f for r in got if r.doc_id in (1, 5)}) == 1
    assert {r.doc_id: r.n_chars for r in got}[2] == 0
    assert W.edited(no_docs(spark)).count() == 0
    alone = spark.createDataFrame([(None, "a b c d e f g h")], "doc_id long, text string")
    assert W.edited(alone).count() == 1
