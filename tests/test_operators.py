"""Operators against hand-written cases and brute force."""

import json
import random
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from arauto import dims, schemas
from arauto.operators import classify, contracts, dedup, digest, enrich, gate, listing, match, ops, tables
from arauto.operators.lookup import heavy_keys, lookup


def institutions(spark, *extra):
    rows = [
        ("1", "0521", "UFRGS", "Universidade Federal do Rio Grande do Sul", "", "", "RS", "", True, True),
        ("2", "0578", "USP", "Universidade de Sao Paulo", "", "", "SP", "", True, True), *extra]
    return spark.createDataFrame(rows, schemas.INSTITUTIONS)


# --- dedup ---


def test_canonical_hash(spark):
    rows = [("Edital X", "UFRGS", "ufrgs"), ("edital  X ", "ufrgs", "ufrgs"), ("Edital X", "UFRGS", "capes"), ("Édital X", "UFRGS", "ufrgs")]
    df = spark.createDataFrame(rows, "titulo string, ies_nome string, fonte_codigo string").withColumns({
        "nivel": F.lit("mba"), "modalidade": F.lit("ead"), "periodo_inscricao": F.lit(None).cast(schemas.PERIOD)})
    a, b, c, d = [r.h for r in df.select(dedup.canonical_hash().alias("h")).collect()]
    assert a == b == d and a != c


def test_simhash_distances_and_forms(spark):
    texts = ["Edital de Mestrado em Computacao Cientifica vagas 10", "Edital de Mestrado em Computacao Cientifica vagas 12",
             "Mestrado em Geologia", "Doutorado em Linguistica de corpus", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    grouped = {r.id: r.simhash for r in dedup.simhash64(df, "id", "t").collect()}
    in_row = {r.id: r.s for r in df.select("id", dedup.simhash_of("t").alias("s")).collect()}
    assert grouped == in_row and grouped[4] == grouped[5] == 0
    distance = lambda a, b: bin((grouped[a] ^ grouped[b]) & (2**64 - 1)).count("1")
    assert distance(0, 1) <= 8 and distance(2, 3) > 8


def _signed(v):
    return v - (1 << 64) if v >> 63 else v


def _near_values(n, seed):
    rnd = random.Random(seed)
    base = [rnd.getrandbits(64) for _ in range(n)]
    for b in base[: n // 2]:
        v = b
        for bit in rnd.sample(range(64), rnd.randint(1, 5)):
            v ^= 1 << bit
        base.append(v)
    crowd = rnd.getrandbits(40) << 24
    base += [crowd | rnd.getrandbits(24) for _ in range(n)]
    return [_signed(v) for v in base] + [0, 0]


@pytest.mark.parametrize("leaf", [dedup.LEAF, 30, 4])
def test_near_duplicates_equal_brute_force(spark, leaf):
    values = _near_values(150, 7)
    df = spark.createDataFrame([(v,) for v in values + values[:20]], "simhash bigint")
    got = {tuple(r) for r in dedup.near_duplicates(df, k=3, leaf=leaf).collect()}
    distinct = sorted(set(values) - {0})
    want = {(a, b, d) for i, a in enumerate(distinct) for b in distinct[i + 1:]
            if (d := bin((a ^ b) & (2**64 - 1)).count("1")) <= 3}
    assert got == want and want
    assert dedup.near_duplicates(df, k=3, leaf=leaf).count() == len(want)


def brute_families(values, k=3):
    near = {v: [] for v in values}
    for i, a in enumerate(values):
        for b in values[i + 1:]:
            if bin((a ^ b) & (2**64 - 1)).count("1") <= k:
                near[a].append(b)
                near[b].append(a)
    label = {}
    for start in sorted(values):
        stack = [start]
        while stack:
            v = stack.pop()
            if v not in label:
                label[v] = start
                stack += near[v]
    return label


@pytest.mark.parametrize("leaf", [dedup.LEAF, 8])
def test_families_of_crowded_keys_equal_brute_force(spark, leaf):
    rnd = random.Random(6)
    values = _near_values(120, 6)
    ball = rnd.getrandbits(64)
    values += [_signed(ball ^ (1 << i) ^ (1 << j)) for i in range(12) for j in range(i)]  # near their centre, not each other
    values = sorted(set(values) - {0})
    edges = dedup.joining_edges(spark.createDataFrame([(v,) for v in values], "simhash bigint"), leaf=leaf)
    assert all(bin((r.u ^ r.v) & (2**64 - 1)).count("1") <= 3 for r in edges.collect())
    got = {r.node: r.label for r in dedup.components(edges).collect()}
    want = brute_families(values)
    assert {v: got.get(v, v) for v in values} == want and len(set(want.values())) < len(values)


def test_ten_thousand_values_under_one_key(spark):
    """A crowd that shares half its bits: pairs by division, one family of them by a few edges a value."""
    rnd = random.Random(8)
    high = rnd.getrandbits(32) << 32
    crowd = {_signed(high | rnd.getrandbits(32)) for _ in range(10_000)}
    near = [v ^ (1 << rnd.randrange(32)) for v in rnd.sample(sorted(crowd), 60)]
    df = spark.createDataFrame([(v,) for v in {*crowd, *near}], "simhash bigint").repartition(4)
    pairs = {(r.simhash_a, r.simhash_b) for r in dedup.near_duplicates(df).collect()}
    assert {(min(v, v ^ w), max(v, v ^ w)) for v in near for w in (1 << b for b in range(32)) if v ^ w in crowd} <= pairs
    assert all(bin((a ^ b) & (2**64 - 1)).count("1") <= 3 for a, b in pairs)
    ball = [_signed(high | sum(1 << b for b in rnd.sample(range(32), 3))) for _ in range(3000)]
    ball = spark.createDataFrame([(v,) for v in {*ball, _signed(high)}], "simhash bigint")
    edges = dedup.joining_edges(ball)
    assert edges.distinct().count() < 12 * ball.count()  # of some hundred pairs a value
    assert dedup.components(edges).select("label").distinct().count() == 1


def test_find_near(spark):
    values = _near_values(60, 3)
    stored = spark.createDataFrame([(v,) for v in values], "simhash bigint")
    probes = spark.createDataFrame([(values[0],), (values[5] ^ 1,)], "simhash bigint")
    got = {tuple(r) for r in dedup.find_near(probes, stored, k=3).collect()}
    want = {(p, s, d) for p in (values[0], values[5] ^ 1) for s in set(values) - {0}
            if (d := bin((p ^ s) & (2**64 - 1)).count("1")) <= 3}
    assert got == want


def test_components_and_families(spark):
    rnd = random.Random(5)
    edges = [(a, b) for a, b in ((rnd.randrange(300), rnd.randrange(300)) for _ in range(220)) if a != b]
    edges += [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    got = {r.node: r.label for r in dedup.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {x: find(x) for x in parent}

    df = spark.createDataFrame([(1, 0b1111), (2, 0b1111), (3, 0b1110), (4, 1 << 60), (5, 0), (6, 0), (7, 0b11111111)], "id int, simhash bigint")
    got = {r.id: r.family for r in dedup.families(df, "id", k=3).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 7} or got[1] == got[2] == got[3] == 1 and got[5] == 5 and got[6] == 6


def test_simhash_within_the_row_is_numpy_s_at_any_length(spark):
    rnd = random.Random(8)
    texts = [" ".join(str(rnd.randrange(1000)) for _ in range(n)) for n in (dedup.VOTERS + 500, 40, 1, 0)]
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "id int, text string")
    inside = df.select("id", dedup.simhash_of("text").alias("simhash"))
    assert sorted(map(tuple, inside.collect())) == sorted(map(tuple, dedup.simhash64(df, "id", "text").collect()))
    assert "zip_with" not in inside._jdf.queryExecution().optimizedPlan().toString()  # no lambda that counts 64 votes a token


def test_change_kinds(spark):
    df = spark.createDataFrame([(None, 5), (0b1111, 0b1110), (0, 0b1111111111), (7, 7)], "p bigint, n bigint")
    assert [r.c for r in df.select(dedup.change_kind("p", "n").alias("c")).collect()] == ["insert", "cosmetic", "update", "cosmetic"]


def test_classify_change_chains_within_batch(spark):
    t = datetime(2026, 1, 1)
    rows = [("a", "k1", t, 0), ("a", "k2", t + timedelta(hours=3), 1), ("a", "k3", t + timedelta(hours=9), 0xFFFF), ("b", "k4", t, 1)]
    incoming = spark.createDataFrame(rows, "canonical_hash string, notice_key string, fetched_at timestamp, simhash bigint")
    stored = spark.createDataFrame([("b", 3)], "canonical_hash string, simhash bigint")
    got = {r.notice_key: r.change for r in dedup.classify_change(incoming, stored).collect()}
    assert got == {"k1": "insert", "k2": "cosmetic", "k3": "update", "k4": "cosmetic"}


# --- classify, gate ---


@pytest.mark.parametrize("title, body, area, low", [
    ("Mestrado em Ciencia da Computacao", "redes neurais e algoritmos", "10300007", 0.4),
    ("Mestrado em Geologia", "geofisica e sensoriamento remoto", "10700001", 0.4),
    ("Doutorado em Filosofia Contemporanea", "", None, -1),
    ("Matemática e estatística", "", "10100002", 0.4),
])
def test_classify(spark, title, body, area, low):
    df = spark.createDataFrame([(title, body, None, body, None)],
                               "titulo string, texto_resumo string, area_concentracao string, texto_completo string, area_cnpq_codigo string")
    r = classify.classify_area(df).first()
    assert r.classification.area == area and r.area_cnpq_codigo == area and r.classification.confidence > low
    if area is None:
        assert r.classification.confidence == 0 and r.classification.evidence == []


def test_a_keyword_table_gives_what_the_dictionary_gives(spark):
    words = [(code, order, w) for order, (code, ws) in enumerate(dims.AREA_KEYWORDS.items()) for w in ws]
    keywords = spark.createDataFrame([*words, ("none", 99, ""), ("none", 99, None), words[0]], "area string, rank int, keyword string")
    rnd = random.Random(4)
    texts = [(i, " ".join(rnd.choice(words)[2] if rnd.random() < 0.5 else rnd.choice(["xyz", "ab", "mestrado"]) for _ in range(rnd.randrange(6)))) for i in range(120)]
    frame = spark.createDataFrame([*texts, (1000, None), (1001, "")], "id int, text string")
    plain = {r.id: r.c for r in frame.select("id", classify.area_of(F.coalesce("text", F.lit(""))).alias("c")).collect()}
    got = {r.id: r for r in classify.classify_by_table(frame, keywords).collect()}
    assert set(got) == set(plain)
    for i, want in plain.items():
        assert (got[i].area, got[i].confidence) == (want.area, want.confidence) and got[i].evidence == sorted(set(want.evidence))
    short = spark.createDataFrame([("a", 0, "x"), ("b", 1, "xy"), ("c", 2, "wxyz")], "area string, rank int, keyword string")
    hits = classify.keyword_hits(spark.createDataFrame([(1, "x"), (2, "axy"), (3, "wxyz"), (4, "y")], "id int, text string"), short)
    assert {tuple(r) for r in hits.collect()} == {(1, "x"), (2, "x"), (2, "xy"), (3, "x"), (3, "xy"), (3, "wxyz")}


@pytest.mark.parametrize("part", [1 << 20, 9])
def test_texts_are_judged_by_a_keyword_table_where_they_are_read(spark, monkeypatch, part):
    """Equal to brute force, for a table sent as a whole and in parts; rows that share an id count for one another, as ever."""
    monkeypatch.setattr(classify, "KEYWORDS", part)
    rnd = random.Random(9)
    syllables = ["a", "bé", "co", "dü", "😀", "\n"]
    word = lambda n: "".join(rnd.choice(syllables) for _ in range(n))
    table = {(f"A{k % 4}", None if k % 4 == 3 else k % 4 // 2, word(rnd.randrange(1, 16))) for k in range(150)} | {("A0", 0, "bébébé"), ("A1", 0, "bébébé")}
    bodies = [word(rnd.randrange(400)) for _ in range(40)] + [None, ""]
    rows = [*enumerate(bodies), (7, bodies[7]), (7, bodies[7]), (None, "bébébé")]
    texts = spark.createDataFrame(rows, "id long, text string")
    keywords = spark.createDataFrame([*table, ("A9", 9, ""), ("A9", 9, None)], "area string, rank int, keyword string")
    got = classify.classify_by_table(texts, keywords).collect()
    assert len(got) == len(rows)
    for r in got:
        times = 9 if r.id == 7 else 1
        body = bodies[r.id] if r.id is not None else None
        hits = {(a, k): sorted((w for b, l, w in table if (b, l) == (a, k) and w in (body or "")) , key=str.encode) for a, k, _ in table}
        best = max(((len(h), k is not None, -(k or 0)) for (a, k), h in hits.items()), default=(0,))
        if not best[0]:
            assert (r.area, r.confidence, r.evidence) == (None, 0, [])
            continue
        of = {a: h for (a, k), h in hits.items() if (len(h), k is not None, -(k or 0)) == best}
        assert r.area in of and r.evidence == [w for w in of[r.area] for _ in range(times)] and r.confidence == pytest.approx(min(0.95, 0.3 + 0.15 * best[0] * times))
    words = {w for _, _, w in table}
    want = [(i, w) for i, b in enumerate(bodies) for w in words if b and w in b for _ in range(9 if i == 7 else 1)]
    assert sorted(map(tuple, classify.keyword_hits(texts, keywords).collect())) == sorted(want)


def test_no_text_is_shuffled_to_meet_a_keyword_table(spark):
    texts = spark.createDataFrame([(1, "quer idade"), (2, "x")], "id int, text string")
    plan = classify.classify_by_table(texts, spark.createDataFrame([("a", 0, "idade")], "area string, rank int, keyword string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_a_text_meets_its_candidate_keywords_once(spark):
    words = ["a", "😀b", "abcdefg", "abcdefgh", "xabcdefg", "zzzabcdefg", "quer\nidade", "idade", "", None]
    bodies = ["xabcdefgh", "abcdefg", "so quer\nidade 😀b", "😀😀xabcdef", "zzabcdefgzz", "", None]
    texts = spark.createDataFrame(list(enumerate(bodies)), "id int, text string")
    hits = classify.keyword_hits(texts, spark.createDataFrame([(w,) for w in words * 2], "keyword string"))
    want = {(i, w) for i, t in enumerate(bodies) for w in words if t and w and w in t}
    assert sorted(map(tuple, hits.collect())) == sorted(want)
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    held = plan[:plan.index("Join")]  # what is done with the texts: a list of candidates each, and no row for each of them
    assert "filter(__tried" in held and "Aggregate" not in held


def test_registry_gate(spark):
    inst = institutions(spark, ("3", "9", "PAGA", "Pos Paga", "", "", "", "", False, False))
    names = ["UFRGS", "ufrgs", "Universidade de São Paulo", "USP - Campus Sao Carlos", "Faculdade Pirata", "PAGA", "", "xuspx", None]
    df = spark.createDataFrame([(n,) for n in names], "ies_nome string")
    got = {r.ies_nome: r.in_registry for r in gate.registry_gate(df, inst).collect()}
    assert got == {"UFRGS": True, "ufrgs": True, "Universidade de São Paulo": True, "USP - Campus Sao Carlos": True,
                   "Faculdade Pirata": False, "PAGA": False, "": False, "xuspx": True, None: False}
    words = {r.ies_nome: r.in_registry for r in gate.registry_gate(df, inst, whole_words=True).collect()}
    assert words["USP - Campus Sao Carlos"] and not words["xuspx"]
    assert gate.registry_size(inst).first().size == 3


def test_resolve_institution(spark):
    df = spark.createDataFrame([(q,) for q in ("usp ", "Rio Grande", "universidade", "nada", "")], "ies_nome string")
    got = {r.ies_nome: r.ies_id for r in gate.resolve_institution(df, institutions(spark)).collect()}
    assert got == {"usp ": "2", "Rio Grande": "1", "universidade": "1", "nada": None, "": None}


@pytest.fixture()
def plain_joins(spark):
    """Joins as shuffles, and no help from adaptive execution."""
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_lookups_split_heavy_keys_and_spread_rows_without_one(spark, plain_joins):
    rows = spark.range(6000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE 'k' || id % 500 END AS k", "map(id, id) AS m")
    dim = spark.createDataFrame([("hot", 1), ("k2", 2), ("k5", 5), (None, 9)], "k string, v int")
    assert set(heavy_keys(rows, "k")) == {"hot"} and heavy_keys(rows, "k")["hot"] >= 8
    got = lookup(rows, dim, "k")
    assert largest_share(rows.join(dim, "k", "left")) > 0.3 and largest_share(got) < 0.15
    assert got.count() == 6000 and got.where("v = 1").count() == 2000 and got.where("v = 9").count() == 0
    assert got.where("v IN (2, 5)").count() == sum(1 for i in range(6000) if i % 3 == 2 and i % 500 in (2, 5))
    assert lookup(rows.where("false"), dim, "k").count() == 0


def test_gate_and_digest_items_of_hot_keys(spark, plain_joins):
    """A third of all rows names one institution, a third none."""
    names = spark.range(3000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'UFRGS' WHEN id % 3 = 1 THEN '' ELSE 'Escola ' || id END AS ies_nome")
    for got in (gate.registry_gate(names, institutions(spark)), gate.resolve_institution(names, institutions(spark))):
        assert got.count() == 3000 and largest_share(got) < 0.2
    assert gate.registry_gate(names, institutions(spark)).where("in_registry").count() == 1000
    assert gate.resolve_institution(names, institutions(spark)).where("ies_id = '1'").count() == 1000
    n = spark.range(3000).selectExpr("string(id) AS id", "'T' AS titulo", "CASE WHEN id % 3 = 0 THEN '1' END AS ies_id", "'mba' AS nivel", "'ead' AS modalidade",
                                     "CASE WHEN id % 3 = 1 THEN '10300007' END AS area_cnpq_codigo", "date'2026-01-01' AS inscricao_ate", "'u' AS url_origem", "'p' AS url_pdf")
    m = n.selectExpr("id", "'s' AS subscriber_id", "id AS edital_id", "1.0D AS score")
    items = digest.digest_items(m, n, institutions(spark), dims.areas(spark))
    assert items.count() == 3000 and largest_share(items) < 0.2
    assert items.where("ies_nome <> ''").count() == 1000 and items.where("area_label <> ''").count() == 1000


def test_a_hot_hour_of_a_host_is_many_buckets(spark, plain_joins):
    rows = [(i, "h", datetime(2026, 1, 1) + timedelta(seconds=i), i % 5 != 0) for i in range(3600)]
    df = spark.createDataFrame(rows, "id int, host string, ts timestamp, failed boolean")
    assert largest_share(ops.circuit_open(df)) < 0.5


# --- match ---


def profile(spark, minimum=0.7, **over):
    row = {"id": "s", "nome": "s", "email": "", "formacao": "", "areas_alvo": list(dims.SEED_PROFILE_AREAS),
           "niveis_aceitos": list(dims.LEVELS[:5]), "modalidades_aceitas": list(dims.MODES[:4]), "apenas_gratuitos": True,
           "apenas_ies_emec_publicas": True, "score_minimo": minimum, "digest_cron": "", "ativo": True, **over}
    return spark.createDataFrame([tuple(row.values())], schemas.SUBSCRIBERS)


CASES = [
    ("cc", "10300007", "mestrado_academico", "presencial", True, "UFRGS"),
    ("paid", "10300007", "mba", "ead", False, "UFRGS"),
    ("pirate", "10300007", "mestrado_academico", "presencial", True, "Faculdade Pirata"),
    ("geo", "10700001", "mestrado_academico", "presencial", True, "USP"),
    ("law", "60100009", "mestrado_academico", "presencial", True, "USP"),
    ("level", "10300007", "desconhecido", "presencial", True, "USP"),
    ("mode", "10300007", "mba", "desconhecida", True, "USP"),
    ("none", None, "mba", "ead", True, "USP"),
]


def notices(spark):
    return spark.createDataFrame(CASES, "id string, area_cnpq_codigo string, nivel string, modalidade string, is_gratuito boolean, ies_nome string")


def test_matching_splits_the_keys_that_hold_much(spark, plain_joins):
    n = spark.range(3000).selectExpr("string(id) AS id", "CASE WHEN id % 3 < 2 THEN '10300007' ELSE '1' || id % 700 END AS area_cnpq_codigo", "'mba' AS nivel", "'ead' AS modalidade",
                                     "true AS is_gratuito", "'UFRGS' AS ies_nome")
    got = match.match_notices(n, profile(spark), institutions(spark))
    assert got.count() == 2000 and largest_share(got) < 0.3
    everything = match.match_notices(n, profile(spark, 0.0), institutions(spark))
    assert everything.count() == 3000 and everything.select("edital_id").distinct().count() == 3000


@pytest.mark.parametrize("minimum", [0.0, 0.7])
def test_notices_of_a_kind_meet_an_offer_as_lists(spark, monkeypatch, minimum):
    """Pairs become rows after the join; ids that repeat, or are null, stay rows of their own."""
    monkeypatch.setattr(match, "LISTED", 3)
    rnd = random.Random(6)
    rows = [(rnd.choice([str(i), str(i % 5), None]), rnd.choice(["10300007", "60100009", None]), rnd.choice([*dims.LEVELS[:3], None]), rnd.choice([*dims.MODES[:2], None]),
             rnd.choice([True, False, None]), rnd.choice(["UFRGS", "x", None])) for i in range(200)]
    n = spark.createDataFrame(rows, "id string, area_cnpq_codigo string, nivel string, modalidade string, is_gratuito boolean, ies_nome string")
    s = profile(spark, minimum).union(profile(spark, minimum, id="t", apenas_gratuitos=False, apenas_ies_emec_publicas=False))
    listed = {a["codigo_cnpq"] for a in profile(spark).first().areas_alvo}

    def fits(who, _id, area, level, mode, free, name):
        strict = who == "s"
        return bool(level and mode and level in dims.LEVELS[:5] and mode in dims.MODES[:4] and (not strict or (free and name == "UFRGS")) and (area in listed or minimum <= 0))

    got = match.match_notices(n, s, institutions(spark))
    want = [(who, r[0]) for who in "st" for r in rows if fits(who, *r)]
    key = lambda p: (p[0], p[1] or "")
    pairs = [(r.subscriber_id, r.edital_id) for r in got.collect()]
    assert sorted(pairs, key=key) == sorted(want, key=key) and len(want) > 5
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "explode(editais" in plan[:plan.index("Join")] and "RepartitionByExpression" in plan


@pytest.mark.parametrize("salts", [None, 1, 5])
def test_match_notices(spark, salts):
    got = {r.edital_id: r for r in match.match_notices(notices(spark), profile(spark), institutions(spark), salts).collect()}
    assert set(got) == {"cc", "geo"}
    assert got["cc"].score == 1.0 and got["cc"].bucket == "high" and got["geo"].score == 0.7 and got["geo"].bucket == "mid"
    assert got["geo"].contributing_areas == ["10700001:cross_discipline:+0.70"]
    assert got["geo"].reasons == ["soft:score=0.70>=min=0.7"]


def test_zero_minimum_matches_everything_that_passes(spark):
    got = {r.edital_id for r in match.match_notices(notices(spark), profile(spark, 0.0), institutions(spark)).collect()}
    assert got == {"cc", "geo", "law", "none"}


@pytest.mark.parametrize("minimum", [0.7, 0.0])
def test_counted_matches_take_a_row_per_kind_of_notice(spark, minimum):
    many = notices(spark).withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(50)))).withColumn("id", F.concat_ws("-", "id", "copy")).drop("copy")
    by = ["subscriber", "bucket", "score", "explanation_json"]
    pairs = match.match_notices(many, profile(spark, minimum), institutions(spark))
    counted = match.match_notices(many, profile(spark, minimum), institutions(spark), counted=True)
    want = sorted(map(tuple, pairs.groupBy(*by).count().collect()))
    assert sorted(map(tuple, counted.groupBy(*by).agg(F.sum("notices")).collect())) == want
    assert counted.count() * 50 == pairs.count() > 0


def test_explain_pairs_agrees_with_matching(spark):
    pairs = spark.createDataFrame([("s", c[0]) for c in CASES], "subscriber_id string, edital_id string")
    got = {r.edital_id: r for r in match.explain_pairs(pairs, notices(spark), profile(spark), institutions(spark)).collect()}
    assert {k for k, r in got.items() if r.matched} == {"cc", "geo"}
    assert got["paid"].reasons == ["hard:nao_gratuito"]
    assert got["pirate"].reasons == ["hard:ies_fora_whitelist:Faculdade Pirata"]
    assert got["level"].reasons == ["hard:nivel_nao_aceito:desconhecido"]
    assert got["mode"].reasons == ["hard:modalidade_nao_aceita:desconhecida"]
    assert got["law"].reasons == ["soft:score=0.00<min=0.7"]


def test_profile_json_round_trip(spark):
    p = profile(spark)
    assert match.profile_from_json(match.profile_to_json(p)).select(*p.columns).collect() == p.collect()
    bare = spark.createDataFrame([("x", "{}")], "nome string, profile_json string")
    r = match.profile_from_json(bare).first()
    assert r.niveis_aceitos == [] and r.modalidades_aceitas == [] and r.apenas_gratuitos and r.areas_alvo == []


# --- tables ---


def test_upsert_matches_sequential_application(spark):
    rnd = random.Random(1)
    stored = [(k, k * 10, f"s{k}", None if k % 2 else k) for k in range(6)]
    incoming = [(i, rnd.randrange(10), rnd.randrange(100), f"i{i}", rnd.choice([None, i])) for i in range(40)]
    want = {k: (a, b, c) for k, a, b, c in stored}
    for _, k, a, b, c in incoming:
        want[k] = (want[k][0], b, c) if k in want else (a, b, c)
    s = spark.createDataFrame(stored, "k int, a int, b string, c int")
    i = spark.createDataFrame(incoming, "seq int, k int, a int, b string, c int")
    got = tables.upsert(s, i, ["k"], ["b", "c"], ["seq"])
    assert {r.k: (r.a, r.b, r.c) for r in got.collect()} == want
    again = tables.upsert(got, i.where("seq = 39"), ["k"], ["b", "c"], ["seq"])
    assert {r.k: (r.a, r.b, r.c) for r in again.collect()} == want


def test_insert_absent_mark_and_expire(spark):
    s = spark.createDataFrame([("a", 1)], "codigo string, v int")
    i = spark.createDataFrame([("a", 2), ("b", 3), ("b", 4)], "codigo string, v int")
    assert tables.insert_absent(s, i, ["codigo"], ["v"]).collect() == [("b", 3)]
    m = spark.createDataFrame([("1", False, None), ("2", False, None)], "id string, notified boolean, notified_at timestamp")
    now = F.lit(datetime(2026, 1, 1))
    got = tables.mark_notified(m, m.where("id = '1'"), now).orderBy("id").collect()
    assert [(r.notified, r.notified_at) for r in got] == [(True, datetime(2026, 1, 1)), (False, None)]
    n = spark.createDataFrame([(date(2026, 1, 1), "publicado"), (date(2026, 1, 2), "publicado"), (None, "publicado")],
                              "inscricao_ate date, status string").withColumn("updated_at", F.lit(None).cast("timestamp"))
    assert [r.status for r in tables.expire(n, F.lit(date(2026, 1, 2)), now).collect()] == ["expirado", "publicado", "publicado"]


def test_batches_fold_and_rerun(spark, tmp_path):
    path = str(tmp_path / "t")
    schema = "k string, a int, b int"
    assert tables.read_batches(spark, path, schema).count() == 0
    for batch, rows in enumerate([[("x", 1, 1)], [("x", 2, 2), ("y", 5, 5)]]):
        for _ in range(2):
            tables.write_batch(spark.createDataFrame(rows, schema), path, batch)
    folded = lambda **kw: {tuple(r) for r in tables.current(tables.read_batches(spark, path, schema, **kw), ["k"], ("b",)).collect()}
    assert folded() == {("x", 1, 2), ("y", 5, 5)} and folded(below=1) == {("x", 1, 1)}


# --- contracts, robots ---


def test_contracts(spark):
    rows = [("w", b"x" * 250), ("w", b"x" * 10), ("d", b"x" * 200), ("d", b'{"ITEMS":[]}' + b"x" * 200), ("other", b"x" * 99)]
    raw = spark.createDataFrame([(s, b, "u", None) for s, b in rows], "source string, body binary, url string, fetched_at timestamp")
    c = spark.createDataFrame([("w", 200, 1000, []), ("d", 100, 1000, ["items"])], schemas.SOURCE_CONTRACTS)
    got = sorted((r.source, r.violation or "") for r in contracts.check_contracts(raw, c).collect())
    assert got == [("d", ""), ("d", "missing:items"), ("other", "too_small"), ("w", ""), ("w", "too_small")]
    good, dead = contracts.apply_contracts(raw, c)
    assert good.count() == 2 and dead.count() == 3
    assert contracts.without_letters(dead, contracts.oldest_letters(dead, 1)).count() == 2


def test_robots(spark):
    rules = spark.createDataFrame([("a.org", "/", False), ("a.org", "/pub", True), ("a.org", "/pub/*.pdf$", False), ("b.org", "/x", False), ("b.org", "/x", True)],
                                  "host string, prefix string, allow boolean")
    urls = ["https://A.org/z", "https://a.org/pub/1", "https://a.org/pub/1.pdf", "https://a.org/pub/1.pdf?x", "https://b.org/x", "https://c.org/", "https://a.org"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    got = {r.url: r.allowed for r in contracts.robots_verdict(df, rules).collect()}
    assert [got[u] for u in urls] == [False, True, False, True, True, True, False]


def test_robots_of_many_rules_equal_brute_force(spark):
    """Ten thousand rules of one host meet paths by equality; only patterns are matched as such."""
    import re

    rnd = random.Random(12)
    part = lambda: "".join(rnd.choice("ab.") for _ in range(rnd.randrange(4)))
    rules = {("/" + "/".join(part() for _ in range(rnd.randrange(5))) + rnd.choice(["", "", "*", "$", "*" + part() + "$", "$x"]), rnd.random() < 0.5) for _ in range(4000)}
    rules |= {(f"/n/{i}", bool(i % 2)) for i in range(10_000)} | {("", False)}
    paths = {"/" + "/".join(part() for _ in range(rnd.randrange(5))) for _ in range(300)} | {f"/n/{i}" for i in range(0, 99_999, 997)}

    def fits(rule, path):
        body = rule[:-1] if rule.endswith("$") else rule
        return re.match(re.escape(body).replace(r"\*", ".*") + ("$" if rule.endswith("$") else ""), path) is not None

    want = {p: max(((len(r), allow) for r, allow in rules if fits(r, p)), default=(0, True))[1] for p in paths}
    df = spark.createDataFrame([(f"https://h.org{p}",) for p in paths] + [(f"https://h.org{p}",) for p in list(paths)[:50]], "url string")
    got = contracts.robots_verdict(df, spark.createDataFrame([("H.org", r, a) for r, a in rules], "host string, prefix string, allow boolean"))
    rows = got.collect()
    assert len(rows) == len(paths) + 50 and all(want[r.url.removeprefix("https://h.org")] == r.allowed for r in rows)


# --- enrichment ---


def test_merge_enrichment(spark):
    parsed = spark.createDataFrame(
        [("a", "T", "", "desconhecido", "ead", None, None, None, None, None, 0.3, "p", {"k": "v"}), ("b", "T", "I", "mba", "ead", None, True, 0, None, "u", 0.9, "p", {})],
        "notice_key string, titulo string, ies_nome string, nivel string, modalidade string, area_concentracao string, is_gratuito boolean, "
        f"vagas int, periodo_inscricao {schemas.PERIOD}, url_pdf string, confidence double, parser_name string, extras map<string,string>")
    e = spark.createDataFrame([(k, "", "Mestrado", None, "USP", "X", 0, False, '{"de":"2026-01-01"}', "l", None) for k in "ab"], schemas.ENRICHMENT)
    got = {r.notice_key: r for r in enrich.merge_enrichment(parsed, e).collect()}
    a = got["a"]
    assert (a.titulo, a.ies_nome, a.nivel, a.modalidade, a.vagas, a.is_gratuito, a.url_pdf, a.confidence, a.parser_name) == (
        "T", "USP", "mestrado_academico", "ead", 0, False, "l", 0.7, "p+llm")
    assert a.extras == {"k": "v", "llm_enriched": "true"} and a.periodo_inscricao.de == date(2026, 1, 1)
    assert got["b"].confidence == 0.9 and not got["b"].enriched and got["b"].ies_nome == "I"
    letters = contracts.enrichment_conflicts(parsed, e).collect()
    assert len(letters) == 1 and letters[0].reason == "conflict:nivel"


# --- listing, digest ---


def test_listing(spark):
    rows = [(f"{i:032x}", "mba" if i % 2 else "doutorado", date(2026, 1, 1) + timedelta(days=i) if i % 3 else None) for i in range(30)]
    n = spark.createDataFrame(rows, "id string, nivel string, inscricao_ate date")
    chosen = listing.filter_notices(n, today=F.lit(date(2026, 1, 10)), level="mba")
    want = sorted((r for r in rows if r[1] == "mba" and (r[2] is None or r[2] >= date(2026, 1, 10))),
                  key=lambda r: (r[2] is None, r[2] or date.min, r[0]))
    assert [r.id for r in listing.page(chosen, 5, 2).collect()] == [r[0] for r in want[2:7]]
    assert listing.total(chosen).first().total == len(want)
    assert listing.get_notice(n, rows[3][0]).count() == 1
    for bad in (lambda: listing.get_notice(n, "x"), lambda: listing.page(n, 201), lambda: listing.page(n, 0)):
        with pytest.raises(ValueError):
            bad()


def test_digest_parts_hold_every_item_once_in_order(spark):
    rnd = random.Random(2)
    rows = [(f"m{i:04d}", "big" if i % 4 else "small", f"T<{i}>", "I", rnd.choice(["Mba", "Doutorado"]), "Ead", "", None, "u", None,
             rnd.choice([0.7, 1.0, 1.7])) for i in range(400)]
    items = spark.createDataFrame(rows, "match_id string, subscriber_id string, titulo string, ies_nome string, nivel_label string, "
                                  "modalidade_label string, area_label string, prazo string, url_origem string, url_pdf string, score double")
    ranked = digest.ranked(items, 120).collect()
    for who, n in (("big", 300), ("small", 100)):
        mine = sorted((r for r in ranked if r.subscriber_id == who), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, n + 1))
        assert [r.score for r in mine] == sorted((r.score for r in mine), reverse=True)
    small = sorted((r for r in ranked if r.subscriber_id == "small"), key=lambda r: r["rank"])
    assert [r.match_id for r in small] == [r.match_id for r in sorted(small, key=lambda r: (-r.score, r.match_id))]
    people = spark.createDataFrame([("big", "Big", "b@x", True), ("small", "S", "", True), ("idle", "I", "", True)], "id string, nome string, email string, ativo boolean")
    d = digest.render_digests(items, people, F.lit(date(2026, 1, 1)), "d@x", part_size=120).collect()
    assert sorted((r.subscriber_id, r.part, r.parts) for r in d) == [("big", 1, 3), ("big", 2, 3), ("big", 3, 3), ("small", 1, 1)]
    small = next(r for r in d if r.subscriber_id == "small")
    assert small.recipient == "d@x" and small.subject == "[editais] 100 novo(s) edital(is) — 2026-01-01"
    assert small.body_text.count("- T<") == 100 and small.body_html.count("T&lt;") == 100 and small.body_html.count("<h2>") == 2
    everyone = digest.render_digests(items, people, F.lit(date(2026, 1, 1)), only_on_match=False).collect()
    assert {r.subscriber_id for r in everyone} == {"big", "small", "idle"}


def test_pending(spark):
    now = datetime(2026, 1, 2)
    m = spark.createDataFrame([("a", False, now - timedelta(hours=24)), ("b", True, now), ("c", False, now - timedelta(hours=25))],
                              "id string, notified boolean, created_at timestamp")
    assert {r.id for r in digest.pending(m, F.lit(now)).collect()} == {"a"}
    assert {r.id for r in digest.pending(m, F.lit(now), since=F.lit(now - timedelta(hours=25))).collect()} == {"a", "b", "c"}


# --- fetch log ---


def fetch_log(spark, seed, n=900, hosts=3, span=20_000, p=0.6):
    rnd = random.Random(seed)
    base = datetime(2026, 1, 1)
    rows = [(i, f"h{rnd.randrange(hosts)}", base + timedelta(seconds=rnd.randrange(span), microseconds=i), rnd.random() < p) for i in range(n)]
    return rows, spark.createDataFrame(rows, "id int, host string, ts timestamp, failed boolean")


def by_host(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        out.setdefault(r[1], []).append(r)
    return out


def micros(t):
    return round((t - datetime(1970, 1, 1)) / timedelta(microseconds=1))


def test_throttle_equals_simulation(spark):
    rows, df = fetch_log(spark, 4)
    got = {r.id: r.permitted_us for r in ops.throttle(df, 0.05, 3).collect()}
    want = {}
    for mine in by_host(rows).values():
        due = None
        for i, _, t, _ in mine:
            t = micros(t)
            want[i] = t if due is None else max(t, due - 2 * 20_000_000)
            due = (t if due is None else max(t, due)) + 20_000_000
    assert got == want and any(want[r[0]] > micros(r[2]) for r in rows)


def test_throttle_of_many_requests_in_an_hour(spark):
    start = datetime(2026, 1, 1)
    df = spark.createDataFrame([(i, "h", start + timedelta(seconds=i)) for i in range(100)], "id int, host string, ts timestamp")
    got = [r.permitted_us - micros(start) for r in ops.throttle(df, 1 / 60, 2).orderBy("id").collect()]
    assert got == [max(i * 1_000_000, (i - 1) * 60_000_000) for i in range(100)]


def test_circuit_open_equals_scan(spark):
    rows, df = fetch_log(spark, 5, n=3000)
    got = {r.id: r.opens for r in ops.circuit_open(df).collect()}
    want = {}
    for mine in by_host(rows).values():
        recent = []
        for i, _, t, failed in mine:
            if not failed:
                recent = []
                continue
            recent = [r for r in recent if t - r <= timedelta(seconds=60)] + [t]
            want[i] = len(recent) >= 3
    assert got == want and any(want.values())


def simulate_circuit(rows):
    want = {}
    for mine in by_host(rows).values():
        recent, opened = [], None
        for i, _, t, failed in mine:
            trial = opened is not None and t - opened >= timedelta(seconds=300)
            allowed = opened is None or trial
            if allowed and failed:
                recent = [r for r in recent if t - r <= timedelta(seconds=60)] + [t]
                if trial or len(recent) >= 3:
                    opened = t
            elif allowed:
                recent, opened = [], None
            want[i] = (allowed, "closed" if opened is None else "open")
    return want


@pytest.mark.parametrize("p", [0.2, 0.6, 0.9])
def test_circuit_replay_equals_simulation(spark, p):
    rows, df = fetch_log(spark, 6, n=2500, span=60_000, p=p)
    got = {r.id: (r.allowed, r.state) for r in ops.circuit_replay(df).collect()}
    assert got == simulate_circuit(rows)
    segments = ops.circuit_segments(df, 300, "host", "ts", "id", "failed").select("host", "segment").distinct().count()
    assert segments > 3 or p == 0.9


def test_counters(spark):
    df = spark.createDataFrame([("a", 200, 0.05), ("a", 503, 0.3), ("b", 429, 40.0)], "source string, status int, latency double")
    h = {r.source: r for r in ops.latency_histogram(df).collect()}
    assert h["a"].le_0_1 == 1 and h["a"].le_0_5 == 2 and h["b"].le_30_0 == 0 and h["b"].n == 1
    assert {(r.source, r.status, r.n) for r in ops.stage_counters(df, "source", "status", totals=True).collect()} >= {("a", None, 2), (None, None, 3)}
    assert [r.f for r in df.select(ops.is_failure("status").alias("f")).collect()] == [False, True, False]


def test_digest_order_and_group_sizes_do_not_follow_the_part_size(spark):
    rows = [(f"m{i:02d}", "s", None if i == 3 else f"T{i}", "I", "Mba", "Ead", "", None, "u", None, 1.0) for i in range(8)]
    items = spark.createDataFrame(rows, "match_id string, subscriber_id string, titulo string, ies_nome string, nivel_label string, "
                                  "modalidade_label string, area_label string, prazo string, url_origem string, url_pdf string, score double")
    people = spark.createDataFrame([("s", "S", "s@x", True)], "id string, nome string, email string, ativo boolean")
    for size in (8, 3, 1):
        assert [r.match_id for r in digest.ranked(items, size).orderBy("rank").collect()] == [r[0] for r in rows]
        parts = digest.render_digests(items, people, F.lit(date(2026, 1, 1)), part_size=size).collect()
        assert len(parts) == -(-8 // size) and all("<h2>Mba (8)</h2>" in p.body_html for p in parts)
        assert sum(p.body_html.count("<div>") for p in parts) == 8


def test_conflicts_read_the_enrichment_s_raw_text(spark):
    parsed = spark.createDataFrame([("k", "doutorado", "ead"), ("l", "mba", "ead")], "notice_key string, nivel string, modalidade string")
    said = spark.createDataFrame([("k", "Doutorado em Computacao", "EAD"), ("l", "Doutorado", "EAD")], "notice_key string, nivel string, modalidade string")
    assert [(r.reason, json.loads(r.payload)["notice_key"]) for r in contracts.enrichment_conflicts(parsed, said).collect()] == [("conflict:nivel", "l")]
