"""Spelling variants against brute force over all pairs of words."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from arauto.llm import op13_spelling
from arauto.llm.op13_spelling import build_filters, document_variants, edits, near_pairs, spelling_variants, vocabulary
from arauto.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
TEXTS = "doc_id long, text string"
WORDS = "word string, n long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(rows, least=7, least_n=2, damage=31):
    count = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += len(run) >= least
    return {w: n for w, n in count.items() if n >= least_n}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_near(words):
    """By deleting each letter: words near each other share a deletion or one is a deletion of the other."""
    meet = defaultdict(set)
    for w in words:
        for v in {w} | {w[:i] + w[i + 1 :] for i in range(len(w))}:
            meet[v].add(w)
    return {tuple(sorted((a, b))) for group in meet.values() for a in group for b in group if a < b and one_edit(a, b)}


def brute_variants(words, ratio=10):
    near = defaultdict(set)
    for a, b in brute_near(words):
        near[a].add(b)
        near[b].add(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = QUERIES["op13_spelling"](spark, SMALL)
    assert dict(got.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
    want = brute_variants(brute_words(rows))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 100
    assert sum(w[1] is not None for w in want) > 0


def test_chains_ties_and_words_of_any_letters(spark):
    chain = {"aaaaaaab": 1, "aaaaaaabb": 10, "aaaaaaabbb": 100, "aaaaaaabbbb": 1000, "aaaaaaabbbbb": 10000}
    ties = {"kitchen": 1, "kitchén": 10, "kitcher": 10, "mitchen": 10}
    odd = {"straßen": 3, "strassen": 40, "ÿÿÿÿÿÿÿ": 5, "ÿÿÿÿÿÿÿÿ": 50, "÷×aaaaa": 7, "x" * 3000: 2, "x" * 3001: 30, "x" * 2999 + "y": 400}
    words = {**chain, **ties, **odd}
    got = {tuple(r) for r in spelling_variants(spark.createDataFrame(list(words.items()), WORDS)).collect()}
    assert got == brute_variants(words)
    by = {r[0]: r for r in got}
    assert by["aaaaaaab"][2] == "aaaaaaabbbbb" and by["kitchen"][1] == "kitcher"


def test_random_words_meet_exactly_once(spark):
    rng = np.random.default_rng(5)
    words = {"".join(rng.choice(list("abé"), rng.integers(7, 10))): int(rng.integers(1, 500)) for _ in range(1500)}
    vocab = spark.createDataFrame(list(words.items()), WORDS)
    pairs = [tuple(sorted((r.word, r.other))) for r in near_pairs(vocab).collect()]
    assert len(pairs) == len(set(pairs)) and set(pairs) == brute_near(words)


def test_full_filters_only_let_more_through(spark, monkeypatch):
    """Filters squeezed to one block a length hold nearly everything; the join still gives the same pairs."""
    words = {f"{a}{b}cdefg": i + 1 for i, (a, b) in enumerate((a, b) for a in "abcdefgh" for b in "stuvwxyz")}
    vocab = spark.createDataFrame(list(words.items()), WORDS)
    monkeypatch.setattr(op13_spelling, "FILTER_BYTES", 8)
    assert build_filters(vocab).blocks.sum() == 1
    assert {tuple(sorted((r.word, r.other))) for r in near_pairs(vocab).collect()} == brute_near(words)


def test_edits_stay_in_bounded_slices(spark, monkeypatch):
    monkeypatch.setattr(op13_spelling, "EDITS", 50)
    words = {"abcdefg" * 4: 1, "abcdefg" * 3 + "abcdefh": 20, "abcdefg" * 3 + "abcdef": 3}
    vocab = spark.createDataFrame(list(words.items()), WORDS)
    filters, alphabet = build_filters(vocab), np.frombuffer(b"abcdefgh", np.uint8).astype(np.uint64)
    letters = np.frombuffer(b"abcdefg" * 4, np.uint8).reshape(1, 28)
    found = [(int(i), int(x)) for row, at, letter in edits(letters, filters, alphabet) for i, x in zip(at, letter, strict=True)]
    assert (27, -1) in found and (27, ord("h")) in found


def test_nulls_empties_repeats_and_clashing_columns(spark):
    rows = [(None, "Wordwords"), (None, "wordwords"), (1, None), (2, ""), (3, "12 ..."), (4, "Āā short"), (5, "Repeated repeated"), (5, "Repeated repeated"), (6, "wordwords " * 9000 + "wordwordz wordwordz")]
    docs = spark.createDataFrame(rows, TEXTS).withColumns({"word": F.lit("x"), "n": F.lit(1), "h": F.lit(2), "id": F.lit(3)})
    assert {tuple(r) for r in document_variants(docs).collect()} == brute_variants(brute_words(rows))
    assert document_variants(spark.createDataFrame([], TEXTS)).collect() == []
    assert vocabulary(spark.createDataFrame([], "word string")).collect() == []
