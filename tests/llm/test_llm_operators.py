"""The other operators against brute force, held-out accuracy and round trips; nulls, ties, empties and hot groups."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from arauto.llm import op2_mixing, op3_jaccard
from arauto.llm.graph import components
from arauto.llm.op1_sharding import ShardTree, shard_documents, with_shard
from arauto.llm.op2_mixing import mix_documents, source_targets
from arauto.llm.op3_jaccard import RTree, jaccard_groups, overlap_bound
from arauto.llm.op4_language import fit, identify
from arauto.llm.op5_fingerprints import fingerprint_documents
from arauto.llm.op6_caps import cap_groups
from arauto.llm.op7_pages import extract, main_text, site_noise
from arauto.llm.op8_pieces import DEFAULT_MODEL, Coder, encode_documents, load, prepare, viterbi

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
TEXTS = "doc_id long, text string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


# --- op1 ----------------------------------------------------------------------------------------------------------------


def test_slots_are_gapless_and_growth_takes_only_into_the_new_shard(spark):
    rows = [(i, "x" * (i % 7)) for i in range(2000)] + [(None, None), (7, "again"), (7, "again")]
    got = shard_documents(spark.createDataFrame(rows, TEXTS)).collect()
    assert len(got) == len(rows) and {r.law for r in got} == {"key"}
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 16)
    assert set(slots) == set(range(16)) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert 60 < sum(r.grown_shard == 16 for r in got) < 190
    want = {(i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows}
    assert {(r.doc_id, r.size, r.text_crc32) for r in got} == want


def test_a_changed_weight_moves_rows_only_into_or_out_of_its_subtrees(spark):
    keys = spark.range(4000).withColumnRenamed("id", "doc_id")
    before, after = ShardTree(16), ShardTree(16, weights={5: 2.0})
    moved = with_shard(with_shard(keys, "doc_id", before, "a"), "doc_id", after, "b").filter("a != b").collect()
    assert moved and all(r.b in range(0, 8) for r in moved)  # region 0 holds shard 5
    assert all(r.b in range(4, 8) for r in moved if r.a in range(0, 4))  # within it, only its rack gains
    heavy = with_shard(keys, "doc_id", after, "b").groupBy("b").count().collect()
    assert max(heavy, key=lambda r: r["count"]).b == 5


def test_sharding_is_native_and_empty_is_empty(spark, docs):
    plan = shard_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert shard_documents(spark.createDataFrame([], TEXTS)).collect() == []


# --- op2 ----------------------------------------------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, most=2):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * weight[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        open_ -= over
    return target


@pytest.mark.parametrize("fan", [4096, 6])
def test_mix_meets_targets(spark, monkeypatch, fan):
    monkeypatch.setattr(op2_mixing, "FAN", fan)
    rnd = random.Random(4)
    rows = [(i, "w " * rnd.choice([0, 1, 2, 3, 40, 500]), rnd.choice(["hot"] * 6 + ["b", "c", "d", "é", None, "Z"])) for i in range(700)]
    rows += [(900, None, "b"), (901, "x y", "only"), (None, "x y z", "c"), (5, "dup", "c"), (5, "dup", "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix_documents(df).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want, taken = brute_targets(sizes), Counter()
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source])
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) < 1 for s in sizes)
    again = mix_documents(df.repartition(3)).collect()
    assert sorted((str(r.doc_id), r.size, r.taken) for r in got) == sorted((str(r.doc_id), r.size, r.taken) for r in again)


def test_mix_of_nothing(spark):
    schema = "doc_id long, text string, source string"
    assert mix_documents(spark.createDataFrame([], schema)).collect() == []
    (row,) = mix_documents(spark.createDataFrame([(1, None, None)], schema)).collect()
    assert (row["size"], row.taken, row.target) == (0, 0, 0.0)
    assert source_targets(spark.createDataFrame([], "source string, size long")).collect() == []


# --- op3 ----------------------------------------------------------------------------------------------------------------


def brute_groups(rows):
    sets, lower = {}, str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t in rows:
        w = WORD.findall((t or "").translate(lower))
        sets[i] = frozenset(tuple(w[p : p + 5]) for p in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                u, v = root(a), root(b)
                parent[max(u, v)] = min(u, v)
    return {i: (len(sets[i]), root(i)) for i in sets}


@pytest.fixture(scope="module")
def similar():
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rnd.choice(words[: 2 + i % 4]) for _ in range(rnd.randrange(0, 40)))) for i in range(150)]
    base = [f"v{rnd.randrange(500)}" for _ in range(150)]
    for i in range(300, 380):
        w = list(base)
        for _ in range(rnd.randrange(0, 10)):
            w[rnd.randrange(150)] = f"z{rnd.randrange(99)}"
        rows.append((i, " ".join(w)))
    return rows + [(500, None), (501, ""), (502, " \t\n"), (503, "a b"), (504, "A  B"), (505, "a b c")]


@pytest.mark.parametrize("page", [4096, 3])
def test_jaccard_groups(spark, monkeypatch, similar, page):
    monkeypatch.setattr(op3_jaccard, "PAGE", page)
    monkeypatch.setattr(op3_jaccard, "LEAF", 4 if page == 3 else 32)
    df = spark.createDataFrame([(i, t, "x") for i, t in similar], "doc_id long, text string, component_id string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(df).collect()} == brute_groups(similar)


def test_jaccard_groups_of_odd_rows(spark):
    assert jaccard_groups(spark.createDataFrame([], TEXTS)).collect() == []
    text = "one two three four five six"
    rows = [(9, text), (9, text), (None, text), (4, text.upper())]
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in jaccard_groups(spark.createDataFrame(rows, TEXTS)).collect())
    assert got == [(0, 2, 0), (4, 2, 4), (9, 2, 4), (9, 2, 4)]


def test_rows_that_repeat_an_id_keep_all_their_links(spark):
    """In any order of rows: document 1 has two texts, which link with documents 2 and 3."""
    words = [[f"{k}{i}" for i in range(60)] for k in "abcd"]
    near = lambda w: " ".join([*w[:-2], "x", "y"])
    rows = [(1, " ".join(words[0])), (1, " ".join(words[1])), (2, near(words[1])), (3, near(words[0])), (4, " ".join(words[2])), (5, near(words[2])), (5, None), (6, ""), (6, " ".join(words[3]))]
    for order in (rows, rows[::-1], rows[3:] + rows[:3]):
        got = sorted((r.doc_id, r.component_id) for r in jaccard_groups(spark.createDataFrame(order, TEXTS)).collect())
        assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (5, 4), (6, 6), (6, 6)])


@pytest.mark.parametrize("page", [4096, 60])
def test_near_copies_are_not_tried_pair_by_pair(spark, monkeypatch, page):
    """400 copies with changes of their own, few of which link: what blocks give and what is verified grows with the copies, not with their pairs."""
    monkeypatch.setattr(op3_jaccard, "PAGE", page)
    rnd, rows = random.Random(5), []
    for i in range(400):
        words = [f"v{k}" for k in range(200)]
        for p in rnd.sample(range(20), 4 if i % 9 else 9):
            words[10 * p + 5] = f"x{p}"
        rows.append((i, " ".join(words)))
    real, made = op3_jaccard.staged, []

    def counted(df, name):
        out = real(df, name)
        if name in ("pairs", "candidates"):
            made.append(out.count())
        return out

    monkeypatch.setattr(op3_jaccard, "staged", counted)
    df = spark.createDataFrame(rows, TEXTS)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_groups(df).collect()} == brute_groups(rows)
    assert made and max(made) <= 16 * len(rows)


def test_forest_connects_what_the_edges_connect():
    rng = np.random.default_rng(4)
    for nodes, edges in ((300, 200), (300, 5000), (50, 0), (2, 3)):
        a, b = rng.integers(0, nodes, (2, edges))
        at = op3_jaccard.forest(a, b, nodes)
        roots = []
        for kept in (range(edges), at.tolist()):
            root = list(range(nodes))
            for e in kept:
                x, y = root[a[e]], root[b[e]]
                root = [min(x, y) if r in (x, y) else r for r in root]
            roots.append(root)
        assert roots[0] == roots[1] and len(at) == nodes - len(set(roots[0]))


@pytest.mark.parametrize("num, den", [(3, 4), (1, 2)])
def test_links_of_a_cluster_join_what_links(num, den):
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 2**63, 30)) for _ in range(4)]
    sets += [np.unique(np.where(rng.random(len(s)) < rng.choice([0.02, 0.1, 0.2]), rng.integers(0, 2**63, len(s)), s)) for s in sets for _ in range(15)]
    table = pa.table({"node": np.arange(len(sets)) * 7, "component": np.where(np.arange(len(sets)) % 5, np.arange(len(sets)) * 7, 0), "shingles": [s.astype(np.uint64).tobytes() for s in sets]})
    links = op3_jaccard._cluster_links(num, den)(table.take(rng.permutation(len(sets))))
    got = list(zip((links["a"].to_numpy() // 7).tolist(), (links["b"].to_numpy() // 7).tolist(), strict=True))
    similar = lambda x, y: den * len(np.intersect1d(sets[x], sets[y])) >= num * len(np.union1d(sets[x], sets[y]))
    assert got and all(a < b and similar(a, b) for a, b in got)
    roots = []
    for edges in (got, [(x, y) for y in range(len(sets)) for x in range(y) if similar(x, y)]):
        root = [0 if i % 5 == 0 else i for i in range(len(sets))]
        for a, b in edges:
            x, y = root[a], root[b]
            root = [min(x, y) if r in (x, y) else r for r in root]
        roots.append(root)
    assert roots[0] == roots[1] and len(got) == len({i if i % 5 else 0 for i in range(len(sets))}) - len(set(roots[0]))


def test_r_tree_keeps_every_possible_pair():
    rng = np.random.default_rng(1)
    points = rng.poisson(1.5, (400, 8))
    points[200:] = points[:200]
    size = points.sum(1)
    a, b = RTree(points, size).pairs(3, 4, np.arange(400))
    got = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if 4 * size[i] >= 3 * size[j] and 4 * size[j] >= 3 * size[i] and 7 * overlap_bound(points[i], points[j]) >= 3 * (size[i] + size[j])}
    assert got == want


def test_points_of_any_grouping_bound_the_overlap():
    """The bound of two sets is never below what they share, and unrelated long sets are told apart."""
    rng = np.random.default_rng(8)
    sets = [np.unique(rng.integers(0, 2**63, n).astype(np.uint64)) for n in (3, 40, 50, 60, 130, 700, 900, 5000, 6000, 200_000)]
    sets += [np.unique(np.concatenate([s[: len(s) * 9 // 10], rng.integers(0, 2**63, len(s) // 10).astype(np.uint64)])) for s in sets]
    cells = op3_jaccard.pack_points(np.concatenate(sets), np.append(0, np.cumsum([len(s) for s in sets])))
    pairs = [(i, j) for i in range(len(sets)) for j in range(i)]
    x, y = [cells[i] for i, _ in pairs], [cells[j] for _, j in pairs]
    n, m = (np.array([len(sets[p[k]]) for p in pairs]) for k in (0, 1))
    ok = op3_jaccard.possible(x, y, n, m, 3, 4)
    shared = np.array([len(np.intersect1d(sets[i], sets[j])) for i, j in pairs])
    assert ok[4 * shared >= 3 * (n + m - shared)].all() and (4 * shared >= 3 * (n + m - shared)).sum() >= 8
    assert ok.sum() <= (4 * shared >= 3 * (n + m - shared)).sum() + 3
    heavy = op3_jaccard.pack_points(np.full(700, np.uint64(5 << 40)), np.array([0, 700]))  # a count beyond a byte
    assert heavy[0][0] == 4 and op3_jaccard.points_of(heavy, 32).sum() == 700 and op3_jaccard.pack_points(np.zeros(0, np.uint64), np.array([0, 0]))


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (7, 7)] + [(200, 200 + i) for i in range(1, 50)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 103)} == {100} and {got[200 + i] for i in range(50)} == {200}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


# --- op4 ----------------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark, docs):
    got = {r.doc_id: r for r in identify(docs, fit(docs)).collect()}
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, r in got.items() if r.held_out} == set(held)
    assert sum(got[i].lang_pred == truth[i] for i in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_language_ignores_labels_and_takes_odd_texts(spark, docs):
    models = fit(docs)
    odd = [(1, None, "en"), (2, "", "de"), (3, "123 !?", None), (None, "the", None), (5, "é" * 3, "fr"), (5, "é" * 3, "xx")]
    got = identify(spark.createDataFrame(odd, "doc_id long, text string, lang string"), models).collect()
    by = {(r.doc_id, r.lang_pred, r.score) for r in got}
    assert {(1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0)} <= by and len({x for x in by if x[0] == 5}) == 1
    empty = spark.createDataFrame([], DOCS)
    assert fit(empty) is None and identify(empty, None).collect() == []


def test_code_lengths_are_those_of_the_context_trees(spark):
    """Against a plain recursive PPM with method C over the same symbols."""
    rows = [(i, t, lang, "s", 1) for i, (t, lang) in enumerate([("abracadabra", "x"), ("banana band", "y"), ("cab bac", "x"), ("nab", "y"), ("dad cab", "x"), ("ana", "y")])]
    df = spark.createDataFrame(rows, DOCS)
    m = fit(df)
    from arauto.llm.common import Texts
    from arauto.llm.op4_language import ORDER, SYMBOLS, code_lengths
    import pyarrow as pa

    counts = {lang: defaultdict(Counter) for lang in m.langs}
    for i, t, lang, _, _ in rows:
        if zlib.crc32(str(i).encode()) % 5:
            s = [0] * ORDER + m.symbol[list(t.encode())].tolist()
            for p in range(ORDER, len(s)):
                for k in range(ORDER + 1):
                    counts[lang][tuple(s[p - k : p])][s[p]] += 1

    def cost(c, context, symbol):
        seen = c.get(context)
        below = math.log(SYMBOLS) if not context else cost(c, context[1:], symbol) if not seen or symbol not in seen else None
        if not seen:
            return below
        n, d = sum(seen.values()), len(seen)
        if symbol in seen:
            return -math.log(seen[symbol] / (n + d))
        return -math.log(d / (n + d)) + below

    texts = ["abra", "ban cad", "zzz", ""]
    got = code_lengths(m, Texts(pa.array(texts)))
    for i, t in enumerate(texts):
        s = [0] * ORDER + m.symbol[list(t.encode())].tolist()
        for j, lang in enumerate(m.langs):
            want = sum(cost(counts[lang], tuple(s[p - ORDER : p]), s[p]) for p in range(ORDER, len(s)))
            assert math.isclose(got[i, j], want, rel_tol=1e-4, abs_tol=1e-4)


# --- op5 ----------------------------------------------------------------------------------------------------------------


def jaccard(a, b):
    a, b = Counter(WORD.findall(a)), Counter(WORD.findall(b))
    union = sum((a | b).values())
    return sum((a & b).values()) / union if union else 1.0


def test_fingerprints(spark, docs, monkeypatch):
    from arauto.llm import op5_fingerprints

    monkeypatch.setattr(op5_fingerprints, "BUCKET_DOCS", 40)
    df = fingerprint_documents(docs)
    got = {r.doc_id: r for r in df.collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), reverse=True)
    error = []
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        r = got[doc_id]
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        error += [r.near_edited - jaccard(text, edited), r.near_next - jaccard(text, after)]
    assert abs(np.mean(error)) < 0.02 and np.sqrt(np.mean(np.square(error))) < 0.1
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprints_of_odd_texts(spark):
    rows = [(3, "same words here"), (2, "same words here"), (1, None), (0, ""), (None, "x"), (2, "same words here")]
    got = fingerprint_documents(spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, n_chars double")).collect()
    assert len(got) == len(rows) and len({r.fingerprint for r in got if r.n_chars == 15}) == 1
    assert len({r.fingerprint for r in got if r.n_chars == 0}) == 1
    by = {r.doc_id: r for r in got}
    assert by[3].near_next == 1.0 and by[1].near_next == 1.0 and by[0].near_next == 0.0 and by[1].near_edited == 1.0
    assert fingerprint_documents(spark.createDataFrame([], TEXTS)).collect() == []
    (one,) = fingerprint_documents(spark.createDataFrame([(1, "abc")], TEXTS)).collect()
    assert one.edited_sha256 == hashlib.sha256(b"aba").hexdigest() and one.near_next == 1.0


@pytest.mark.parametrize(("shared", "times", "own"), [(1, 1000, 100), (3, 100, 100), (1, 10, 1)])
def test_fingerprints_of_texts_that_a_few_words_dominate(spark, shared, times, own):
    rows = []
    for i in range(30):
        common = [f"s{i}x{w}" for w in range(shared) for _ in range(times)]
        rows += [(2 * i + side, " ".join(common + [f"o{i}x{side}x{w}" for w in range(own)])) for side in (0, 1)]
    texts = dict(rows)
    got = {r.doc_id: r.near_next for r in fingerprint_documents(spark.createDataFrame(rows, TEXTS)).collect()}
    error = [got[2 * i + 1] - jaccard(texts[2 * i + 1], texts[2 * i]) for i in range(30)]
    assert abs(np.mean(error)) < 0.05


# --- op6 ----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("page", [2048, 7])
def test_cap_groups(spark, monkeypatch, page):
    from arauto.llm import op6_caps

    monkeypatch.setattr(op6_caps, "PAGE", page)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((150, 32))
    x = np.concatenate([base, base[:60] + rng.standard_normal((60, 32)) * 0.12, base[0] + rng.standard_normal((40, 32)) * 0.08, base[1:2].repeat(30, 0)])
    cells = [v.astype(np.float32).astype(float).tolist() for v in x]
    rows = [(1000 - i, v, i % 3) for i, v in enumerate(cells)]
    odd = [(1, None), (2, [0.0] * 32), (3, [None] + [1.0] * 31), (4, [float("nan")] * 32), (5, [1.0, 2.0]), (6, [2.0, 4.0]), (7, []), (8, [float("inf")] + [1.0] * 31)]
    df = spark.createDataFrame(rows + [(i, v, 0) for i, v in odd], "vec_id long, embedding array<float>, label int")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in cap_groups(df).collect()}
    ids = np.array([r[0] for r in rows])
    u = np.array(cells)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    found = np.array([got[i][0] for i in ids])
    assert (found <= near.sum(1)).all() and found.sum() >= 0.99 * near.sum()
    label = ids.copy()
    while (least := np.minimum(label, np.where(near, label[None], 10**9).min(1))).tolist() != label.tolist():
        label = least
    assert np.mean([got[i][1] == c for i, c in zip(ids, label)]) > 0.99
    assert got[5][:2] == (1, 5) and got[6][:2] == (1, 5) and all(got[i] == (0, i, True) for i in (1, 2, 3, 4, 7, 8))
    assert cap_groups(df.limit(0)).collect() == []


# --- op7 ----------------------------------------------------------------------------------------------------------------


def test_pages_table(spark):
    pages = spark.read.parquet(f"{SMALL}/pages.parquet")
    import html

    def plain(page):
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", page, re.S)
        text = re.sub(r"</?b>", "", re.sub(r"</?(p|h1|br)>", " ", m[1] if m else ""))
        return " ".join(html.unescape(text).split())

    got = {r.page_id: r for r in extract(pages).collect()}
    for r in pages.collect():
        assert got[r.page_id].text == plain(r.html) and got[r.page_id].n_chars == len(got[r.page_id].text)


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""),
        ("", ""),
        ("just words &amp; more", "just words & more"),
        ("<body><nav>menu</nav><div class='cookie-notice'>ok?</div><main><h1>T</h1><p>a<b>b</b>c<br>d</p></main><footer>f</footer>", "T abc d"),
        ("<article><header><h1>Title</h1></header><p>one<p>two<ul><li>x<li>y</ul><form>q</form><aside>s</aside><section id=comments>no</section></article>", "Title one two x y"),
        ("<article>a</article><p>between</p><article class='comment'>reply</article><article>b</article>", "a b"),
        ("<header>h</header><div>body &lt;b&gt; &#233;&nbsp;x</div><script>var t='</p>';</script><style>p{}</style>", "body <b> é x"),
        ("<p>cut off <a href='x", "cut off"),
        ("<p>1 < 2 and <!-- no --> 3 > 2</p></div></p>", "1 < 2 and 3 > 2"),
        ("<div>" * 3000 + "deep" + "<b>" * 3000, "deep"),
    ],
)
def test_main_text(page, want):
    assert main_text(page) == want


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<body class='no-sidebar'><article>a</article></body>", "a"),
        ("<body class='comments-open'><main>m</main></body>", "m"),
        ("<html class='search'><body class='sidebar' id=footer><p>b</p></body></html>", "b"),
        ("<body class='header'><div id='content-widget'><p>b</p></div></body>", "b"),
        ("<article class='post category-search'>a</article>", "a"),
        ("<div id='content-widget'><article>a</article></div>", "a"),
        ("<div class='widget'><div class='header'><article class='search'>a<div class='ad-share'>x</div></article></div></div>", "a"),
        ("<div class='widget'><main class='search'>m</main></div>", "m"),
        ("<article>a</article><div class='widget'><article>other</article></div>", "a"),
        ("<div><p>text</p></div><section id=comments><article>reply</article></section>", "text"),
        ("<main>m<section id=comments><article class='comment'>reply</article></section></main>", "m"),
        ("<article class='comment'>a</article>", "a"),
        ("<main><div class='widget'><article>a</article></div></main>", "a"),
        ("<div class='cookie-notice'>ok?</div><p>b</p>", "b"),
        ("<aside class='widget'><article>a</article></aside><p>b</p>", "b"),
    ],
)
def test_names_do_not_take_the_whole_page(page, want):
    assert main_text(page) == want


def test_site_noise_goes_and_articles_stay(spark):
    box = "<div class='box'>the same promise on every page</div>"
    rows = [(i, f"https://H.example/{i}", f"<body>{box}<div class='text'>story number {i} with words {i * 7}</div></body>") for i in range(30)]
    rows += [(100, None, f"<body>{box}<p>x</p></body>"), (101, "not a url", "<p>y</p>"), (102, "https://h.example/a", None)]
    rows += [(200 + i, f"https://copies.example/{i}", "<body><div>one page, many copies</div></body>") for i in range(20)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extract(df).collect()}
    assert all(got[i] == f"story number {i} with words {i * 7}" for i in range(30))
    assert got[100] == "the same promise on every page x" and got[101] == "y" and got[102] == ""
    assert all(got[200 + i] == "one page, many copies" for i in range(20))
    assert [r.host for r in site_noise(df).collect()] == ["h.example"]
    assert extract(df.limit(0)).collect() == []


# --- op8 ----------------------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def model():
    return load()


def test_ids_are_the_library_s_and_decode(model, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=DEFAULT_MODEL)
    rnd = random.Random(1)
    texts = [r.text for r in docs.limit(80).collect()]
    texts += ["", " ", "  a  b ", "x\n\ty\r\n  z", "naïve 日本語 テスト 😀😀 a", "x" * 700, "n't, 'tis (o.k.); a.b,c!!", "\U0010ffff"]
    texts += ["".join(rnd.choice("abc eito nrs\n.é日😀,'  ") for _ in range(rnd.randrange(150))) for _ in range(200)]
    coder = Coder(model)
    ids, at = coder.encode(texts)
    back = coder.decode(ids, at)
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == sp.encode(t) or "\U0010ffff" in t
        assert back[i].decode() == t or "\U0010ffff" in t


def test_encode_documents(spark, model):
    rows = [(1, "Hello world"), (2, None), (3, ""), (None, "ab▁cd"), (1, "Hello world")]
    got = encode_documents(spark.createDataFrame([(i, t, "q") for i, t in rows], "doc_id long, text string, ids string"), model).collect()
    assert len(got) == 5 and all(r.round_trip for r in got)
    by = {r.doc_id: r for r in got}
    assert by[2].ids is None and by[2].n_ids is None and by[3].ids == [] and by[None].decoded == "ab▁cd"
    assert encode_documents(spark.createDataFrame([], TEXTS), model).collect() == []


def test_viterbi_finds_the_best_sum_of_scores():
    pieces = ["a", "b", "c", "ab", "bc", "abc", "ca", "cab"]
    score = np.array([-2.0, -2.1, -2.2, -2.5, -3.9, -6.0, -2.9, -4.6])
    m = prepare(pieces, score, np.ones(8, bool), np.zeros(256, np.int32), merges=False)

    def best(w):
        if not w:
            return 0.0
        return max(best(w[: -len(p)]) + s for p, s in zip(pieces, score) if w.endswith(p))

    rnd = random.Random(8)
    for size in (1, 4, 9):
        words = ["".join(rnd.choice("abc") for _ in range(size)) for _ in range(40)]
        flat, counts = viterbi(m, words)
        for word, ids in zip(words, np.split(flat, np.cumsum(counts)[:-1])):
            assert "".join(pieces[i] for i in ids) == word and math.isclose(sum(score[ids]), best(word))


# --- pipeline -----------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, docs):
    import corpus_pipeline as p
    from arauto.llm.common import staged

    assert [n for n, _ in p.STAGES] == ["language", "near_duplicates", "substring_dedup", "mixing", "pieces"] and p.ORACLE_SQL is None
    extra = spark.createDataFrame([(9001, None, "en", "src0", 0), (9002, "123", "en", "src0", 3), (None, "la casa de queos", None, None, 16)], DOCS)
    df = docs.unionByName(extra)
    kept = {}
    for name, stage in p.STAGES:
        df = staged(stage(spark, df, SMALL), name)
        kept[name] = df
        if name != "pieces":
            assert df.columns == list(p.COLUMNS)
    first = {r.doc_id for r in docs.collect()}
    language = {r.doc_id: r for r in kept["language"].collect()}
    assert set(language) == first | {None}
    groups = brute_groups([(r.doc_id, r.text) for r in language.values() if r.doc_id is not None])
    near = {r.doc_id: r for r in kept["near_duplicates"].collect()}
    assert set(near) == {i for i, (_, c) in groups.items() if i == c} | {None}
    passages = {r.doc_id: r for r in kept["substring_dedup"].collect()}
    assert set(passages) <= set(near) and all(len(r.text) == r.n_chars for r in passages.values())
    mixed = Counter(r.doc_id for r in kept["mixing"].collect())
    assert max(mixed.values()) <= 3 and set(mixed) <= set(passages)
    words = lambda rows: sum(len(WORD.findall(r.text)) for r in rows)
    assert abs(words(kept["mixing"].collect()) - 1.5 * words(passages.values())) <= 20
    assert all(r.round_trip for r in kept["pieces"].collect()) and kept["pieces"].count() == kept["mixing"].count()


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = [n for n in entry.queries() if n.startswith("op") or n == "pipeline"]
    assert len([n for n in names if re.match(r"op\d+_", n)]) == 10 and "pipeline" in names
