"""Static dimensions and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arauto import schemas

# --- Fixed values -----------------------------------------------------------------------------------------

LEVELS = ("especializacao", "mba", "mestrado_academico", "mestrado_profissional", "doutorado", "desconhecido")
MODES = ("presencial", "ead", "semipresencial", "uab", "desconhecida")
STATUSES = ("descoberto", "normalizado", "classificado", "publicado", "expirado", "invalidado")
SOURCE_TYPES = (
    "capes", "uab", "universidade_federal", "instituto_federal", "universidade_estadual",
    "sigaa", "dou", "emec", "outro",
)
MATCH_MODES = ("exact", "cross_discipline")
CHANGE_KINDS = ("insert", "cosmetic", "update")

# code, name, broad area
AREAS = (
    ("10100002", "Matematica", "Ciencias Exatas e da Terra"),
    ("10200006", "Probabilidade e Estatistica", "Ciencias Exatas e da Terra"),
    ("10300007", "Ciencia da Computacao", "Ciencias Exatas e da Terra"),
    ("10400000", "Astronomia", "Ciencias Exatas e da Terra"),
    ("10500003", "Fisica", "Ciencias Exatas e da Terra"),
    ("10600007", "Quimica", "Ciencias Exatas e da Terra"),
    ("10700001", "Geociencias", "Ciencias Exatas e da Terra"),
    ("10800005", "Oceanografia", "Ciencias Exatas e da Terra"),
    ("30100007", "Engenharia Civil", "Engenharias"),
    ("30200002", "Engenharia de Minas", "Engenharias"),
    ("30300006", "Engenharia de Materiais e Metalurgica", "Engenharias"),
    ("30400000", "Engenharia Eletrica", "Engenharias"),
    ("30500004", "Engenharia Mecanica", "Engenharias"),
    ("30700007", "Engenharia Quimica", "Engenharias"),
    ("30900008", "Engenharia de Producao", "Engenharias"),
)

# areas that admit computing graduates
AREAS_ADMITTING_COMPUTING = ("10300007", "10100002", "10200006", "10700001", "30400000", "30900008")

# area -> keywords; the order of the areas breaks ties
AREA_KEYWORDS = {
    "10300007": (
        "ciencia da computacao", "ciencias da computacao", "computacao", "inteligencia artificial",
        "machine learning", "engenharia de software", "ciencia de dados", "data science", "redes neurais",
        "sistemas distribuidos", "algoritmos", "banco de dados", "informatica",
    ),
    "10700001": (
        "geociencias", "ciencias da terra", "geologia", "geografia fisica", "geofisica", "geoquimica",
        "paleontologia", "sensoriamento remoto", "geoinformatica", "hidrogeologia", "geotecnia",
    ),
    "10100002": ("matematica", "matematica aplicada", "matematica pura"),
    "10200006": ("estatistica", "probabilidade", "bioestatistica"),
    "30400000": ("engenharia eletrica", "sistemas embarcados", "sinais"),
    "30900008": ("engenharia de producao", "pesquisa operacional"),
}

MONTHS = {
    "janeiro": 1, "fevereiro": 2, "marco": 3, "março": 3, "abril": 4, "maio": 5, "junho": 6, "julho": 7,
    "agosto": 8, "setembro": 9, "outubro": 10, "novembro": 11, "dezembro": 12,
    "jan": 1, "fev": 2, "mar": 3, "abr": 4, "mai": 5, "jun": 6,
    "jul": 7, "ago": 8, "set": 9, "out": 10, "nov": 11, "dez": 12,
}

# Patterns, written for Java's regex engine with case-insensitive Unicode matching.
RE_FLAGS = "(?iU)"
RE_RELEVANT = (
    r"\b(edital|processo\s+seletivo|inscri[cç][aã]o|chamada|sele[cç][aã]o|especializa[cç][aã]o|mba"
    r"|p[oó]s[\s-]graduacao|forma[cç][aã]o|capacita[cç][aã]o)\b"
)
RE_DOCTORATE = r"\bdoutorad[oa]s?\b|\bphd\b"
RE_MBA = r"\bmba\b"
RE_PROFESSIONAL = r"\bmestrado\s+profissional\b"
RE_MASTER = r"\bmestrado\b|\bmestre\b"
RE_SPECIALISATION = r"\bespecializa[cç][ãa]o\b|\blato\s+sensu\b"
RE_UAB = r"\bUAB\b|universidade\s+aberta"
RE_HYBRID = r"\bsemipresencial\b|\bsemi-presencial\b|h[ií]brid[oa]"
RE_DISTANCE = r"\bEAD\b|\bensino\s+a\s+dist[aâ]ncia\b|\ba\s+dist[aâ]ncia\b|\bonline\b"
RE_ON_SITE = r"\bpresencial\b"
RE_DATE_NUMERIC = r"\b\d{1,2}[/-]\d{1,2}[/-]\d{4}\b"
RE_DATE_WORDS = r"\b(\d{1,2})\s+de\s+([a-zçãáéíóú]+)(?:\s+de)?\s+(\d{4})\b"
RE_SEATS_HTML = r"(\d+)\s+vagas?"
RE_SEATS_DOCUMENT = r"(\d{1,3})\s+vagas?"
RE_FREE_HTML = r"\b(gratuit[ao]|sem\s+custo|sem\s+\w+\s+mensalidad|publico)\b"
RE_FREE_DOCUMENT = r"\b(gratuit[oa]|sem\s+\w+\s+mensalidad|isent[oa])\b"
RE_DOCUMENT_TITLE = r"EDITAL\s+N[ºo°]?\s*\d+\s*/?\s*\d{2,4}[^\n]{0,200}"

# application-window keys in the order they are tried, and the words that mark a closing date
WINDOW_KEYS = ("inscric", "prazo", "periodo de inscri", "submissao")
CLOSING_WORDS = ("ate", "limite", "prazo")

# field widths
MAX_TITLE = 512
MAX_SUMMARY = 1_000
MAX_BODY = 30_000
MAX_FEED_TEXT = 5_000
MAX_CLASSIFIER_TEXT = 3_000
MAX_LEVEL_TEXT = 2_000
MAX_MODE_TEXT = 5_000
MAX_ROWS_PER_PAGE = 20
UNTITLED = "(sem titulo)"

CONFIDENCE_THRESHOLD = 0.65
HIGH_SCORE = 0.85
RETRYABLE_STATUS = (408, 425, 429, 500, 502, 503, 504)
LATENCY_BUCKETS = (0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0)

GAZETTE = "dou"
GAZETTE_HOST = "https://www.in.gov.br"
GAZETTE_SEARCH = "https://www.in.gov.br/consulta/-/buscar/dou"
GAZETTE_PUBLISHER = "Diario Oficial da Uniao"
GAZETTE_TERMS = (
    "edital pos-graduacao", "processo seletivo mestrado", "processo seletivo doutorado",
    "chamada publica especializacao", "edital programa de pos-graduacao",
)
CATALOGUE = "sucupira"
CATALOGUE_SEARCH = "https://sucupira.capes.gov.br/sucupira/public/consultas/coleta/programa/listaPrograma.jsf"
CATALOGUE_AREAS = (("10300007", "Ciencia da Computacao"), ("10700001", "Geociencias"))

# code, institution, feed, listing — in dispatch order
ACTIVE_SOURCES = (
    ("ifrs", "Instituto Federal de Educacao, Ciencia e Tecnologia do Rio Grande do Sul",
     "https://ifrs.edu.br/feed/", "https://ifrs.edu.br/noticias/"),
    ("ifsp", "Instituto Federal de Educacao, Ciencia e Tecnologia de Sao Paulo",
     None, "https://www.ifsp.edu.br/processos-seletivos"),
    ("enap", "Escola Nacional de Administracao Publica", None, "https://www.enap.gov.br/"),
    ("uab", "Universidade Aberta do Brasil", None, "https://educapes.capes.gov.br/"),
    ("ufrgs-inf", "Universidade Federal do Rio Grande do Sul",
     "https://www.inf.ufrgs.br/site/feed/", "https://www.inf.ufrgs.br/site/pos-graduacao/"),
    ("usp-ime", "Universidade de Sao Paulo",
     "https://www.ime.usp.br/feed/", "https://www.ime.usp.br/posgraduacao/"),
    ("ufmg-dcc", "Universidade Federal de Minas Gerais", None, "https://www.ppgcc.dcc.ufmg.br/"),
    ("unicamp-ime", "Universidade Estadual de Campinas",
     "https://www.ime.unicamp.br/feed/", "https://www.ime.unicamp.br/pos-graduacao"),
)

# code, name, type, base url
SEED_SOURCES = (
    ("dou", "Diario Oficial da Uniao", "dou", "https://www.in.gov.br"),
    ("sucupira", "Plataforma Sucupira (CAPES)", "capes", "https://sucupira.capes.gov.br"),
    ("emec", "Cadastro e-MEC", "emec", "https://emec.mec.gov.br"),
)

# source, min bytes, max bytes, required tokens
CONTRACTS = (
    *((code, 200, 10_000_000, []) for code, *_ in ACTIVE_SOURCES),
    (GAZETTE, 100, 10_000_000, ["items"]),
    (CATALOGUE, 500, 10_000_000, ["Programa"]),
)
DEFAULT_CONTRACT = (100, 5_000_000)
CONTRACT_HEAD_BYTES = 50_000

# the seeded profile: areas, levels, threshold
SEED_PROFILE_AREAS = (("10300007", "exact", 1.0, False), ("10700001", "cross_discipline", 0.7, True))
SEED_PROFILE_LEVELS = ("especializacao", "mba")
SEED_PROFILE_MODES = ("presencial", "ead", "semipresencial", "uab")
DEFAULT_MIN_SCORE = 0.70

# --- The same values as DataFrames ------------------------------------------------------------------------


def areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(AREAS), "codigo string, nome string, grande_area string")


def area_keywords(spark: SparkSession, keywords: dict[str, tuple[str, ...]] = AREA_KEYWORDS) -> DataFrame:
    rows = [(code, i, list(words)) for i, (code, words) in enumerate(keywords.items())]
    return spark.createDataFrame(rows, "area string, area_order int, keywords array<string>")


def active_sources(spark: SparkSession) -> DataFrame:
    """The registry of listing and feed sources, in dispatch order."""
    rows = [
        (code, name, "outro", listing, True, 180, name, feed, listing, "listing", i)
        for i, (code, name, feed, listing) in enumerate(ACTIVE_SOURCES)
    ]
    return spark.createDataFrame(rows, schemas.SOURCES)


def seed_sources(spark: SparkSession) -> DataFrame:
    kinds = {GAZETTE: "search", CATALOGUE: "catalogue"}
    rows = [
        (code, name, kind, base, True, 180, None, None, None, kinds.get(code), None)
        for code, name, kind, base in SEED_SOURCES
    ]
    return spark.createDataFrame(rows, schemas.SOURCES)


def contracts(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CONTRACTS), schemas.SOURCE_CONTRACTS)


def seed_profile(spark: SparkSession, nome: str = "padrao", email: str = "") -> DataFrame:
    row = (
        nome, nome, email, "bacharelado_ciencia_computacao", list(SEED_PROFILE_AREAS),
        list(SEED_PROFILE_LEVELS), list(SEED_PROFILE_MODES), True, True, DEFAULT_MIN_SCORE, "0 7 * * *", True,
    )
    return spark.createDataFrame([row], schemas.SUBSCRIBERS)
