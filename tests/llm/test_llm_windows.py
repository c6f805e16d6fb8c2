"""Substring dedup against brute force: words (op9) and bytes (op10)."""

import hashlib
import random
import re

import pytest

from arauto.llm.op9_substrings import levels, substring_dedup
from arauto.llm.op10_suffixes import offsets, suffix_dedup

WORDS = re.compile(rb"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string"


def brute_words(rows, n):
    docs = sorted(((i, WORDS.findall((t or "").encode())) for i, t in rows), key=lambda x: x[0])
    first, out = {}, {}
    for i, w in docs:
        for p in range(len(w) - n + 1):
            first.setdefault(tuple(w[p : p + n]), (i, p))
    for i, w in docs:
        gone = [False] * len(w)
        for p in range(len(w) - n + 1):
            if first[tuple(w[p : p + n])] != (i, p):
                gone[p : p + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode())
    return out


def brute_bytes(rows, n):
    docs = sorted(((i, (t or "").encode()) for i, t in rows), key=lambda x: x[0])
    first, out = {}, {}
    for i, b in docs:
        for p in range(len(b) - n + 1):
            first.setdefault(b[p : p + n], i)
    for i, b in docs:
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first[b[p : p + n]] != i:
                gone[p : p + n] = b"\1" * n
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest(), kept)
    return out


def words_found(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in df.collect()}


def bytes_found(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, bytes(r.kept)) for r in df.collect()}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(11)
    vocabulary = "ab cd e ﬀ é".split()
    out = [(i, " ".join(rnd.choice(vocabulary) for _ in range(rnd.randrange(0, 160)))) for i in range(50)]
    passage = " ".join(f"p{i}" for i in range(70))
    out += [(100 + i, f"start{i} x " + passage + f" and end{i}") for i in range(30)]
    near = [f"n{i}" for i in range(120)]
    for i in range(20):
        w = list(near)
        w[rnd.randrange(120)] = f"edit{i}"
        out.append((200 + i, "  ".join(w)))
    out += [(300, None), (301, ""), (302, " \n\t "), (303, "a" * 400), (304, "a" * 130), (305, "é " * 90), (306, "w " * 300)]
    rnd.shuffle(out)
    return out


def test_ladders_double():
    assert levels(20) == (2, 3, 5, 10, 20) and offsets(50) == ((2, 3, 5, 10, 20, 40, 50), 20)
    for ladder in [*map(levels, range(2, 90)), *(offsets(n)[0] for n in range(8, 90))]:
        assert all(a < b <= 2 * a for a, b in zip((1, *ladder), ladder))


@pytest.mark.parametrize("n", [20, 7, 2])
def test_words(spark, rows, n):
    assert words_found(substring_dedup(spark.createDataFrame(rows, SCHEMA), n)) == brute_words(rows, n)


@pytest.mark.parametrize("n", [50, 21])
def test_bytes(spark, rows, n):
    assert bytes_found(suffix_dedup(spark.createDataFrame(rows, SCHEMA), n)) == brute_bytes(rows, n)


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert words_found(substring_dedup(docs)) == brute_words(rows, 20)
    assert bytes_found(suffix_dedup(docs)) == brute_bytes(rows, 50)


def test_a_third_of_all_rows_are_one_text(spark):
    passage = " ".join(f"q{i}" for i in range(60))
    rows = [(i, passage) for i in range(300)] + [(1000 + i, " ".join(f"u{i}_{j}" for j in range(40))) for i in range(600)]
    got = words_found(substring_dedup(spark.createDataFrame(rows, SCHEMA)))
    assert got[0][1] == 0 and all(got[i][1] == 60 for i in range(1, 300)) and all(got[1000 + i][1] == 0 for i in range(600))


def test_repeated_and_null_ids_and_extra_columns(spark):
    text = " ".join(f"q{i}" for i in range(30))
    rows = [(5, text, 1), (5, text, 1), (None, text, 2), (7, text, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed) for r in substring_dedup(df).collect())
    assert got == [(5, 0), (5, 0), (7, 30), (99, 30)]
    got = sorted((r.doc_id if r.doc_id is not None else 99, r.n_removed) for r in suffix_dedup(df).collect())
    n = len(text)
    assert got == [(5, 0), (5, 0), (7, n), (99, n)]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert substring_dedup(empty).collect() == [] and suffix_dedup(empty).collect() == []


def test_texts_larger_than_a_slice(spark, monkeypatch):
    from arauto.llm import common

    monkeypatch.setattr(common, "SLICE_BYTES", 64)
    rnd = random.Random(2)
    rows = [(i, " ".join(rnd.choice("a b".split()) for _ in range(60))) for i in range(12)]
    assert words_found(substring_dedup(spark.createDataFrame(rows, SCHEMA), 8)) == brute_words(rows, 8)
