"""Extraction jobs, sources and the ingest plan on inline pages."""

import json
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from arauto import dims, schemas
from arauto.operators import extract, tables
from arauto.plans import ingest
from arauto.sources import frontier, pages
from arauto.sources.plugins import register_source
from arauto.streaming import jobs

NOW = datetime(2026, 2, 1, 12)
HTML, XML, JSON = "text/html; charset=utf-8", "application/rss+xml", "application/json"


def raw(spark, *rows, at=NOW):
    """Rows of (url, content type, body, source)."""
    data = [(u, u, 200, {"content-type": ct}, b if isinstance(b, (bytes, bytearray)) else b.encode(), at, "httpx", s) for u, ct, b, s in rows]
    return pages.with_content_type(spark.createDataFrame(data, schemas.RAW_RESPONSES))


BLOG = """<!doctype html><html><head><meta name="generator" content="WordPress 6.4"><title>Edital 02/2026 PPGCC</title></head>
<body><article><h1 class="entry-title">Edital 02/2026 - Mestrado em Ciencia da Computacao</h1><div class="entry-content">
<p>O PPGCC abre processo seletivo para o Mestrado.</p><p>Inscricoes: de 01/03/2026 a 15/04/2026. 20 vagas. Curso gratuito.</p>
<p>Modalidade presencial.</p><p><a href="https://www.example.com/wp-content/uploads/2026/edital.pdf">Baixar edital PDF</a></p>
</div></article></body></html>"""


def test_blog_notice(spark):
    df = raw(spark, ("https://e.com/a", HTML, BLOG, "w"))
    assert df.select(extract.route(extract.default_parsers())).first()[0] == "wordpress"
    r = extract.extract_routed(df, extract.default_parsers()).first()
    assert "Mestrado" in r.titulo and r.url_pdf == "https://www.example.com/wp-content/uploads/2026/edital.pdf"
    assert r.periodo_inscricao.ate == date(2026, 4, 15) and r.nivel == "mestrado_academico" and r.modalidade == "presencial"
    assert r.confidence == 0.9 and r.parser_name == "wordpress" and r.fonte_codigo == "w"


def test_html_notice(spark):
    page = """<html><head><title>Portal</title></head><body><nav>menu</nav><main><h1> Edital&nbsp;5 </h1><script>var x='30 vagas'</script>
    <p>Especialização a distância, 12 vagas, gratuita.<p>Prazo: ate 30/06/2026 <a href='x/e.pdf'>e</a></main></body>"""
    r = extract.extract_html_notice(raw(spark, ("https://e.com/a", HTML, page, ""))).first()
    assert (r.titulo, r.vagas, r.is_gratuito, r.nivel, r.modalidade, r.url_pdf) == ("Edital 5", 12, True, "especializacao", "ead", "x/e.pdf")
    assert r.periodo_inscricao.ate == date(2026, 6, 30) and r.confidence == 0.8 and r.fonte_codigo == "html_generic"
    assert "menu" not in r.texto_completo and "var x" not in r.texto_completo
    empty = extract.extract_html_notice(raw(spark, ("https://e.com/b", HTML, "<p>", "s"))).first()
    assert empty.titulo == dims.UNTITLED and empty.confidence == 0.2


def feed(items):
    body = "".join(f"<item><title>{t}</title><link> {u} </link><description>{d}</description></item>" for t, u, d in items)
    return f'<?xml version="1.0"?><rss xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>c</title>{body}</channel></rss>'


def test_feed(spark):
    items = [("Edital MBA online", "https://a/1", "&lt;p&gt;Inscricoes 01/03/2026 a 02/03/2026&lt;/p&gt;"), ("Festa", "https://a/2", "x"),
             *[(f"Chamada {i}", f"https://a/c{i}", "texto") for i in range(25)]]
    df = raw(spark, ("https://a/feed", XML, feed(items), "ifrs"), ("https://b/feed", "text/plain", feed(items[:1]), "ifrs"),
             ("https://c/feed", XML, "<rss><channel><item>", "ifrs"))
    assert [r[0] for r in df.select(extract.listing_route(F.col("content_type"), F.col("body"))).collect()] == ["feed"] * 3
    got = extract.extract_feed(df).orderBy("page_url", "position").collect()
    a = [r for r in got if r.page_url == "https://a/feed"]
    assert len(a) == 20 and a[0].titulo == "Edital MBA online" and a[1].titulo == "Chamada 0"
    assert (a[0].nivel, a[0].modalidade, a[0].confidence, a[0].url_origem) == ("mba", "ead", 0.55, "https://a/1")
    assert (a[1].modalidade, a[1].confidence, a[1].parser_name) == ("presencial", 0.40, "ifrs+rss")
    assert [r.url for r in extract.broken_feeds(df).collect()] == ["https://c/feed"]


@pytest.mark.parametrize("broken", [False, True])
def test_the_rows_of_a_feed_do_not_carry_the_feed(spark, broken):
    df = raw(spark, ("https://a/feed", XML, feed([(f"Chamada {i}", f"https://a/c{i}", "texto") for i in range(3)]), "ifrs"), ("https://c/feed", XML, "<rss><channel><item>", "ifrs"))
    got = extract.extract_feed(df, broken=broken)
    assert sorted(r.parser_name for r in got.collect()) == [extract.BROKEN_FEED] * broken + ["ifrs+rss"] * 3
    made = [line for line in got._jdf.queryExecution().executedPlan().toString().splitlines() if "Generate" in line]
    assert made and all("feed#" not in line for line in made)


def test_listing_stages(spark):
    block = lambda i, t: f'<article><h2><a href="/n{i}">{t}</a></h2><p>Inscricoes 0{1 + i % 9}/03/2026</p></article>'
    one = "<body>" + "".join(block(i, f"Edital {i}" if i % 2 else "Notícia") for i in range(60)) + '<a href="/z">Edital avulso</a></body>'
    two = """<body><article><p>nada</p></article><a href="/a">Edital de seleção</a><a href="/a">Edital de seleção de novo</a>
    <a href="b#x">Processo  seletivo</a><a href="">Edital vazio</a><a href="/c">edital</a><a href="/d">Contato geral</a></body>"""
    got = extract.extract_listing(raw(spark, ("https://s.org/p/", HTML, one, "ifsp"), ("https://t.org/p/", HTML, two, "ifsp"))).orderBy("position").collect()
    first = [r for r in got if r.page_url == "https://s.org/p/"]
    assert len(first) == 20 and first[0].titulo == "Edital 1" and first[0].url_origem == "/n1" and first[0].confidence == 0.45
    second = [(r.titulo, r.url_origem, r.confidence, r.parser_name) for r in got if r.page_url == "https://t.org/p/"]
    assert second == [("Edital de seleção", "https://t.org/a", 0.35, "ifsp+keyword-links"),
                      ("Processo seletivo", "https://t.org/p/b#x", 0.35, "ifsp+keyword-links")]


def test_documents(spark):
    header = "Universidade X - Edital"
    texts = {"d": [f"{header}\nEDITAL Nº 5/2026 Mestrado\n \nlinha a\nigual", f"{header}\n15 vagas, isento\nigual  ", f"{header}\n" + "prazo 01/02/2026 " * 8],
             "short": ["abc"], "big": ["x" * 6_000_000]}
    rows = [(d, i, t) for d, ps in texts.items() for i, t in enumerate(ps)]
    texto = extract.document_text(spark.createDataFrame(rows, "doc_id string, page_no int, page_text string"))
    got = {r.doc_id: r.texto for r in texto.collect()}
    assert set(got) == {"d", "short", "big"} and got["big"] == "x" * 6_000_000
    assert header not in got["d"] and "igual" not in got["d"]
    assert got["d"].startswith("EDITAL No 5/2026 Mestrado\nlinha a\n15 vagas, isento\nprazo")
    docs = texto.select(F.col("doc_id").alias("url"), F.lit(NOW).alias("fetched_at"), F.lit("s").alias("source"), "texto")
    parsed = {r.page_url: r for r in extract.extract_document(docs).collect()}
    d = parsed["d"]
    assert d.vagas == 15 and d.is_gratuito and d.nivel == "mestrado_academico" and d.extras == {"needs_ocr": "false"}
    assert d.titulo.startswith("EDITAL No 5/2026 Mestrado linha a") and d.confidence == pytest.approx(0.76)
    assert parsed["short"].extras == {"needs_ocr": "true"} and parsed["short"].confidence == pytest.approx(0.22)


def test_search_and_table(spark):
    hits = [{"title": "Edital MBA", "urlTitulo": "/web/1", "orgao": "MEC", "ementa": "e" * 1200, "secao": 3}, {"titulo": " T ", "url": "http://x/2"}, {"title": "no url"}]
    html = '<a class="big resultado" href="/r">Edital R</a><a href="/q">Edital Q</a>'
    df = raw(spark, ("u1", JSON, json.dumps({"items": [], "hits": hits}), "dou"), ("u2", HTML, html, "dou"), ("u3", JSON, "{broken", "dou"))
    got = extract.extract_search(df).orderBy("page_url", "position").collect()
    assert [(r.page_url, r.titulo, r.url_origem, r.ies_nome) for r in got] == [
        ("u1", "Edital MBA", "https://www.in.gov.br/web/1", "MEC"), ("u1", "T", "http://x/2", "Diario Oficial da Uniao"),
        ("u2", "Edital R", "https://www.in.gov.br/r", "Diario Oficial da Uniao")]
    assert got[0].extras["dou_secao"] == "3" and len(got[0].texto_resumo) == 1000 and got[0].nivel == "mba"
    table = '<table id="listagem"><tr><th>P</th></tr><tr><td>PPGCC (42)</td><td>USP</td><td>CC</td><td>Mestrado</td></tr><tr><td>a</td></tr></table>'
    r = extract.extract_table(raw(spark, ("u", HTML, table, "sucupira"))).collect()
    assert len(r) == 1 and r[0].extras == {"catalog_only": "true", "codigo_programa_sucupira": "42", "nivel_texto": "Mestrado"}
    assert r[0].texto_resumo == "PPG: PPGCC (42) - Mestrado" and r[0].area_concentracao == "CC"


def test_feed_discovery_and_pages(spark):
    page = '<link rel="alternate" type="text/html" href="/x"><link rel="alternate" type="application/RSS+xml" href="feed/">'
    df = raw(spark, ("https://a.org/b/", HTML, page, "s"), ("https://a.org/c", HTML, "<p>", "s"))
    assert {r.url: r.feed_url for r in extract.find_feed(df).collect()} == {"https://a.org/b/": "https://a.org/b/feed/", "https://a.org/c": None}
    bad = raw(spark, ("u", "TEXT/HTML ; x", b"ok \xff", "s")).select("content_type", "is_html", pages.body_text().alias("t")).first()
    assert (bad.content_type, bad.is_html, bad.t) == ("text/html", True, "ok �")


def test_snapshots_replay_sitemap_registry(spark, tmp_path):
    df = raw(spark, ("u1", HTML, "same", "s"), ("u2", HTML, "same", "s"), ("u3", "application/pdf", "%PDF", "s"))
    path = str(tmp_path / "snap")
    tables.write_batch(pages.snapshot_rows(df.union(df), F.to_date("fetched_at")), path, 0, by=("source", "date"))
    stored = tables.read_batches(spark, path, schemas.SNAPSHOTS)
    assert stored.count() == 2  # also of captures that repeat in every column
    assert {(r.url, r.storage_path.split("/")[1]) for r in stored.collect()} == {("u1", "2026-02-01"), ("u3", "2026-02-01")}
    assert pages.new_snapshots(df, stored, F.to_date("fetched_at")).count() == 0
    sha = stored.first().sha256
    assert pages.find_snapshot(stored, sha).count() == 1
    assert {(r.url, bytes(r.body)) for r in pages.replay(stored).select("url", "body").collect()} == {("u1", b"same"), ("u3", b"%PDF")}

    sm = lambda *u: "<urlset>" + "".join(f"<url><loc> {x} </loc></url>" for x in u) + "</urlset>"
    today, before = (pages.sitemap_urls(raw(spark, ("s", XML, sm(*u), "x"))) for u in (("a", "b", "b"), ("a",)))
    assert [r.url for r in pages.new_urls(today, before).collect()] == ["b"]

    file = tmp_path / "registry.json"
    row = {"codigo_emec": "1", "sigla": "A", "nome": "AA", "categoria_administrativa": "F", "ativa": True, "publica": True}
    file.write_text(json.dumps({"ies": [row, {**row, "codigo_emec": "2", "publica": False}, {**row, "codigo_emec": "3", "ativa": False}]}))
    assert [r.codigo_emec for r in pages.read_registry(spark, str(file)).collect()] == ["1"]
    assert {(r.codigo_emec, r.gratuita) for r in pages.read_registry(spark, str(file), only_public=False).collect()} == {("1", True), ("2", False)}


def test_frontiers(spark):
    got = {r.source: r.url for r in frontier.listing_frontier(frontier.active(dims.active_sources(spark))).collect()}
    assert got["ifrs"].endswith("/feed/") and got["enap"] == "https://www.enap.gov.br/" and len(got) == 8
    assert frontier.listing_frontier(dims.seed_sources(spark)).count() == 0
    days = spark.createDataFrame([(date(2026, 1, 10),)], "d date")
    urls = [r.url for r in frontier.search_frontier(days, "d").collect()]
    assert len(urls) == 5 and urls[0] == ("https://www.in.gov.br/consulta/-/buscar/dou?q=edital+pos-graduacao&delta=ate&publicadoDe=03-01-2026"
                                          "&publicadoAte=10-01-2026&currentPage=1&rowsPerPage=50")
    assert frontier.catalogue_frontier(dims.areas(spark)).count() == 15


# --- ingest ---


def dimensions(spark):
    inst = spark.createDataFrame(
        [("9", "9", "IFRS", "Instituto Federal de Educacao, Ciencia e Tecnologia do Rio Grande do Sul", "", "", "RS", "", True, True)], schemas.INSTITUTIONS)
    return ingest.default_dimensions(spark, inst, dims.seed_profile(spark))


def day_pages(spark, extra="", at=NOW):
    pad = "<!--" + "x" * 600 + "-->"
    items = [("Edital Especialização em Ciência da Computação", "https://ifrs/1", "Inscricoes 01/03/2026 a 15/03/2026, redes neurais" + extra),
             ("Edital MBA Geologia", "https://ifrs/2", "Prazo 10/03/2026 a 01/03/2026")]
    table = pad + '<table id="listagem"><tr><td>Programa (1)</td><td>USP</td><td>CC</td><td>M</td></tr></table>'
    return raw(spark, ("https://ifrs/feed", XML, feed(items), "ifrs"), ("https://enap/", HTML, pad + '<a href="/e">Edital de chamada</a>', "enap"),
               ("https://suc/", HTML, table, "sucupira"), ("https://ifsp/", HTML, "tiny", "ifsp"), ("https://u/x", HTML, BLOG, "unknown"), at=at
               ).select(*[f.name for f in schemas.struct(schemas.RAW_RESPONSES)])


def check_first_day(spark, root):
    n = ingest.current_notices(spark, root)
    assert n.count() == 3
    top = n.where("titulo like '%Especializa%'").first()
    assert (top.nivel, top.area_cnpq_codigo, top.ies_id, top.is_gratuito, top.status) == ("especializacao", "10300007", "9", True, "publicado")
    letters = {(r.stage, r.reason) for r in tables.read_batches(spark, f"{root}/dead_letters", schemas.DEAD_LETTERS).collect()}
    assert letters == {("fetch", "too_small"), ("parse", "reversed window")}
    assert spark.read.parquet(f"{root}/catalogue").count() == 1
    m = ingest.current_matches(spark, root).collect()
    assert len(m) == 1 and m[0].edital_id == top.id and m[0].score == 1.0
    assert spark.read.parquet(f"{root}/snapshots").count() == 4


def test_ingest_batches(spark, tmp_path):
    root, d = str(tmp_path / "root"), dimensions(spark)
    for _ in range(2):  # a retried batch changes nothing
        ingest.run_batch(day_pages(spark), d, root, 0, F.lit(NOW))
        check_first_day(spark, root)
    stats = {r.source: r for r in spark.read.parquet(f"{root}/stats").collect()}
    assert (stats["ifrs"].discovered, stats["ifrs"].parsed, stats["ifrs"].persisted, stats["ifrs"].matched, stats["ifrs"].failed) == (1, 2, 1, 1, 1)
    assert stats["ifsp"].failed == 1 and stats["ifsp"].parsed == 0

    later = datetime(2026, 2, 2)
    ingest.run_batch(day_pages(spark, at=later), d, root, 1, F.lit(later))
    assert spark.read.parquet(f"{root}/matches").where("batch = 1").count() == 0 and spark.read.parquet(f"{root}/snapshots").where("batch = 1").count() == 0
    assert {r.change for r in spark.read.parquet(f"{root}/changes/batch=1").collect()} == {"cosmetic"}
    changed = " algoritmos " + " ".join(f"novo{i} texto{i}" for i in range(40))
    ingest.run_batch(day_pages(spark, changed, at=later), d, root, 2, F.lit(later))
    assert spark.read.parquet(f"{root}/matches/batch=2").count() == 1 and len(ingest.current_matches(spark, root).collect()) == 1
    n = ingest.current_notices(spark, root)
    assert n.count() == 3 and "novo39" in n.where("titulo like '%Especializa%'").first().texto_resumo
    assert ingest.match_all(n, d).count() == 1


def test_stream_ingest_equals_batch(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "root")
    day_pages(spark).coalesce(1).write.parquet(source)
    jobs.start_ingest(spark, source, root, str(tmp_path / "ck"), lambda: dimensions(spark), lambda: F.lit(NOW)).awaitTermination()
    check_first_day(spark, root)


def test_feeds_in_the_wild(spark):
    def feed(title, head='<?xml version="1.0"?>', tail="</channel></rss>"):
        return f"{head}<rss><channel><item><title>{title}</title><link>https://x/1</link><description>Inscrições até 30/06/2026</description></item>{tail}"

    latin = feed("Seleção de Mestrado", '<?xml version="1.0" encoding="ISO-8859-1"?>').encode("latin-1")
    rows = [("https://s/latin", latin), ("https://s/amp", feed("Mestrado em A & B").encode()), ("https://s/nbsp", feed("Mestrado&nbsp;A").encode()),
            ("https://s/cut", feed("Mestrado cortado", tail="<item><title>Doutor").encode()), ("https://s/blank", ("\n" * 300 + feed("Mestrado depois")).encode()),
            ("https://s/none", b"not a feed at all")]
    df = spark.createDataFrame([(u, u, 200, {"content-type": "text/plain"}, b, NOW, "http", "src") for u, b in rows], schemas.RAW_RESPONSES)
    df = pages.with_content_type(df)
    got = {r.page_url: r.titulo for r in extract.extract_feed(df, r"mestrado").collect()}
    assert got["https://s/latin"] == "Seleção de Mestrado" and got["https://s/amp"] == "Mestrado em A & B"
    assert set(got) == {u for u, _ in rows} - {"https://s/none"}
    assert [r.url for r in extract.broken_feeds(df).collect()] == ["https://s/none"]
    routes = {r.url: r.r for r in df.select("url", extract.listing_route(F.col("content_type"), F.col("body")).alias("r")).collect()}
    assert routes["https://s/blank"] == "feed" and routes["https://s/none"] is None


def test_inline_tags_join_and_deep_pages_are_linear(spark):
    page = "<html><body><main><h1>M<b>estr</b>ado</h1><p>um<br>dois</p><ul><li>a<li>b</ul><td>c</td></main></body></html>"
    deep = "<p>x" + "<b></b><b>" * 30_000 + "<p>fim"
    df = raw(spark, ("https://u/1", HTML, page, "s"), ("https://u/2", HTML, deep, "s"))
    got = {r.page_url: r for r in extract.extract_html_notice(df).collect()}
    assert got["https://u/1"].titulo == "Mestrado" and got["https://u/1"].nivel == "mestrado_academico"
    assert got["https://u/1"].texto_completo == "Mestrado um dois a b c" and got["https://u/2"].texto_completo.endswith("x fim")


def test_search_hits_lose_white_space_around(spark):
    hits = [{"title": "\n Edital\t", "url": "\nhttps://z/1\n"}]
    (r,) = extract.extract_search(raw(spark, ("u", JSON, json.dumps({"hits": hits}), "dou"))).collect()
    assert (r.titulo, r.url_origem) == ("Edital", "https://z/1")


def test_a_new_kind_of_source_the_digest_job_and_expiry(spark, tmp_path):
    root, d = str(tmp_path / "root"), dimensions(spark)
    own = spark.createDataFrame([("mine", "letters")], "codigo string, kind string")
    sources = d.sources.select("codigo", "kind", "ies_nome").unionByName(own, allowMissingColumns=True)
    d = ingest.Dimensions(sources, d.contracts, d.institutions, d.subscribers)
    as_table = dict(ingest.EXTRACTORS, letters=lambda raw: extract.extract_document(raw.withColumn("texto", pages.body_text())))
    letter = raw(spark, ("https://mine/1", "text/plain", "Edital de mestrado. " + "Doutorado em letras com 12 vagas. " * 30, "mine"))
    more = letter.select(*[f.name for f in schemas.struct(schemas.RAW_RESPONSES)])
    ingest.run_batch(day_pages(spark).unionByName(more), d, root, 0, F.lit(NOW), extractors=as_table)
    assert spark.read.parquet(f"{root}/parsed").where("fonte_codigo = 'mine'").count() == 1

    sent = []
    ingest.run_digest(spark, root, d, 1, F.lit("2026-02-01"), F.lit(NOW), sink=lambda rows: sent.extend(rows.collect()))
    assert len(sent) == 1 and sent[0].total == 1 and "Especialização" in sent[0].body_text
    assert [(m.notified, m.notified_at) for m in ingest.current_matches(spark, root).collect()] == [(True, NOW)]
    ingest.run_digest(spark, root, d, 2, F.lit("2026-02-01"), F.lit(NOW), sink=lambda rows: sent.extend(rows.collect()))
    assert len(sent) == 1  # nothing is pending any more

    before = {r.canonical_hash: r.status for r in ingest.current_notices(spark, root).collect()}
    ingest.run_expiry(spark, root, 3, F.lit(date(2026, 4, 1)), F.lit(NOW))
    after = {r.canonical_hash: (r.status, r.inscricao_ate) for r in ingest.current_notices(spark, root).collect()}
    assert set(before.values()) == {"publicado"} and set(after) == set(before)
    assert all((status == "expirado") == (until is not None and until < date(2026, 4, 1)) for status, until in after.values())
    assert any(status == "expirado" for status, _ in after.values())


def test_a_source_as_a_table_function(spark):
    def parse(url, body, content_type):
        if b"broken" in body:
            raise ValueError("no such page")
        for part in body.decode().split(";"):
            yield {"titulo": part, "texto": "Mestrado EAD, inscricoes 01/03/2026 a 15/03/2026"} if part else {"titulo": content_type}

    mine = register_source(spark, "my_source", parse)
    df = raw(spark, ("https://m/1", HTML, "um;dois;", "mine"), ("https://m/2", HTML, "broken", "mine"), ("https://m/3", HTML, "x", "other"))
    sources = spark.createDataFrame([("mine", "mine", "USP"), ("other", "none", "")], "codigo string, kind string, ies_nome string")
    got = ingest.extract_all(df, sources, {"mine": mine.extract}).orderBy("position").collect()
    assert [(r.position, r.titulo, r.nivel, r.modalidade) for r in got[:2]] == [(0, "um", "mestrado_academico", "ead"), (1, "dois", "mestrado_academico", "ead")]
    assert got[2].titulo == "text/html" and got[2].nivel == "desconhecido" and len(got) == 3
    assert got[0].periodo_inscricao.de == date(2026, 3, 1) and {r.parser_name for r in got} == {"my_source"}
    assert [(r.url, r.error) for r in mine.failures(df).collect()] == [("https://m/2", "ValueError: no such page")]
    df.createOrReplaceTempView("fetched")
    rows = spark.sql("SELECT f.url, t.titulo FROM fetched f, LATERAL my_source(f.url, f.body, f.content_type) t WHERE t.error IS NULL").collect()
    assert {(r.url, r.titulo) for r in rows} == {("https://m/1", "um"), ("https://m/1", "dois"), ("https://m/1", "text/html"), ("https://m/3", "x")}


def test_documents_are_assembled_in_one_shuffle_and_in_the_ingest(spark):
    pages_ = [(1, 1, "Head\nUm  texto\u2028outro\n"), (1, 2, "Head\nDois\n\n"), (1, 3, "Head\nTres"), (2, 1, "Head\nsolo"), (3, 1, None), (4, 1, " \n ")]
    df = spark.createDataFrame(pages_, "doc_id int, page_no int, page_text string")
    got = extract.document_text(df)
    assert {r.doc_id: r.texto for r in got.collect()} == {1: "Um texto\noutro\nDois\nTres", 2: "Head\nsolo", 3: "", 4: ""}
    assert got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange") <= 2
    text = "\f".join(f"Universidade X\nPagina com edital de mestrado parte {i}. Inscricoes 01/03/2026 a 15/03/2026." for i in range(3))
    (n,) = extract.extract_routed(raw(spark, ("https://d/1", "application/pdf", text, "s")), extract.default_parsers()).collect()
    assert "Universidade X" not in n.texto_completo and n.texto_completo.count("parte") == 3
