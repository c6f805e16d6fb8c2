"""Hard negatives by the multi-index against brute force over all rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from arauto.llm import op11_negatives
from arauto.llm.op11_negatives import MultiIndex, best, build_index, hard_negatives, products, sequence
from arauto.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<double>, label int"


def brute(rows, every=50, positives=5, negatives=3, scale=256):
    clean = [(i, [math.floor(scale * x) for x in v], y) for i, v, y in rows if i is not None and v is not None and y is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for i, q, y in clean:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q, r, strict=True)), j, z) for j, r, z in clean if j != i and len(r) == len(q))
        for p, j, _ in [s for s in scored if s[2] == y][:positives]:
            window = [(n, k) for n, k, z in scored if z != y and 50 * -p <= 100 * -n <= 95 * -p][:negatives]
            out += [(i, j, rank + 1, k, -p, -n) for rank, (n, k) in enumerate(window)]
    return sorted(out)


def mined(spark, rows, **options):
    return sorted(tuple(r) for r in hard_negatives(spark.createDataFrame(rows, ROWS), **options).collect())


def vectors(n, dim=16, labels=4, clusters=6, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((clusters, dim))
    x = centres[rng.integers(clusters, size=n)] + 0.4 * rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return [(i, v.tolist(), int(y)) for i, (v, y) in enumerate(zip(x, rng.integers(labels, size=n), strict=True))]


def test_the_query_equals_brute_force(spark):
    table = spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in table]
    got = QUERIES["op11_hard_negatives"](spark, SMALL)
    assert [t for _, t in got.dtypes] == ["bigint", "bigint", "int", "bigint", "bigint", "bigint"]
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_many_cells_and_small_seeds_lose_nothing(spark, monkeypatch, seed):
    monkeypatch.setattr(op11_negatives, "CELL_ROWS", 8)
    monkeypatch.setattr(op11_negatives, "SEED_ROWS", 40)
    rows = vectors(1500, seed=seed)
    assert mined(spark, rows, every=25) == brute(rows, every=25)


def test_a_crowded_cell_is_cut_and_ties_go_by_id(spark):
    """Two thirds of all rows are copies of one vector: one cell, cut into groups; ties everywhere."""
    rows = [(i, [1.0, 0.5, 0.0, -0.25], i % 3) for i in range(1400)] + [(1400 + i, [0.7, 0.4, 0.1 * (i % 4), 0.0], i % 3) for i in range(700)]
    index, books = build_index(spark.createDataFrame([(i, i, y, 4, np.floor(256 * np.array(v)).astype(np.int16).tobytes()) for i, v, y in rows], "key long, vec_id long, label long, dim int, q binary"), 50)
    assert books[4].groups >= 4 and index.groupBy("group").count().agg(F.max("count")).first()[0] < 700
    assert mined(spark, rows) == brute(rows)


def test_nulls_oddities_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = vectors(120, dim=6, labels=2, seed=3)
    rows += [(500, None, 1), (550, [0.1] * 6, None), (600, [0.1, None] * 3, 1), (650, [nan] * 6, 1), (700, [inf] + [0.0] * 5, 0), (None, [0.5] * 6, 0), (750, [0.0] * 6, 1)]
    rows += [rows[50], rows[50], (50, [0.2] * 6, 1), (7, [0.3] * 6, 0)]  # repeats, and ids with another vector
    rows += [(800, [0.5, 0.5], 0), (801, [0.5, 0.4], 0), (802, [0.4, 0.4], 1), (850, [1.0], 0), (851, [0.9], 0), (852, [0.6], 1), (900, [], 0), (901, [], 0), (902, [], 1), (950, [0.25] * 3, 5)]
    frame = spark.createDataFrame(rows, ROWS).withColumns({"key": F.lit(1), "group": F.lit("g"), "low": F.lit(0.5), "q": F.lit("q"), "score": F.lit(3)})
    assert sorted(tuple(r) for r in hard_negatives(frame).collect()) == brute(rows)
    assert hard_negatives(spark.createDataFrame([], ROWS)).collect() == []
    assert mined(spark, [(0, [1.0], 0)]) == []
    assert mined(spark, [(0, [1.0], 0), (1, [-1.0], 0), (2, [-0.6], 1)]) == []  # a negative positive has an empty window


def test_large_components_are_exact_and_saturate(spark):
    rows = [(0, [1e6, 3.0], 0), (1, [1e6 - 1, 2.0], 0), (2, [8e5, 1.0], 1), (3, [9.4e5, 7.0], 2), (4, [-1e6, 1.0], 1)]
    assert mined(spark, rows) == brute(rows)
    assert products(np.array([[1e200, 1.0]]), np.array([[1e200, 1.0], [-1e200, 0.0]])).tolist() == [[2**63 - 1, -(2**63) + 1]]


def test_the_heap_gives_all_cells_by_falling_bound():
    rng = np.random.default_rng(4)
    for n, m in ((1, 1), (1, 9), (8, 5), (12, 12)):
        a, b = rng.integers(0, 6, n).astype(float), rng.standard_normal(m)
        got = list(sequence(a, b))
        assert sorted((i, j) for _, i, j in got) == [(i, j) for i in range(n) for j in range(m)]
        assert all(x[0] >= y[0] for x, y in zip(got, got[1:], strict=False))
        assert all(s == a[i] + b[j] for s, i, j in got)


def test_bounds_hold_for_every_row(spark):
    rng = np.random.default_rng(6)
    x = np.floor(256 * rng.standard_normal((400, 10)))
    book = MultiIndex.fit(10, 12_800, x[:200])
    cells, far = np.zeros(400, np.int64), []
    for half, words in zip(book.halves(x), book.words, strict=True):
        near = op11_negatives.nearest(half, words)
        cells = cells * len(words) + near
        far.append(np.sqrt(((half - words[near]) ** 2).sum(1)))
    book.fill([(int(c), int((cells == c).sum()), far[0][cells == c].max(), far[1][cells == c].max(), 1) for c in np.unique(cells)], 0, 0)
    most, more, least, less = book.bounds(x)
    i, j = np.divmod(cells, len(book.words[1]))
    score = products(x, x)
    assert (score <= most[:, i] + more[:, j]).all() and (score >= least[:, i] + less[:, j]).all()


def test_best_keeps_first_columns_of_ties():
    none = op11_negatives.NONE
    row, col = best(np.array([[5, 7, 7, 5, 7], [none, none, 1, none, none], [none] * 5]), 3)
    assert (row.tolist(), col.tolist()) == ([0, 0, 0, 1], [1, 2, 4, 2])
