"""Derived tables: URLs, feeds, scores and logs built from part, pages and events.

Each derived table is a plain SELECT stated once and rendered for Spark SQL and
for DuckDB; only list access, integer division and the hash differ.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostsift import rules as R
from hostsift.session import scratch_path, use_utc

RULES = R.DEFAULT_RULES
AS_OF = "2024-01-31 00:00:00"
RETENTION_AS_OF = "2024-02-10 00:00:00"

PUNYCODE_HOSTS = ("xn--pypal-4ve.com", "xn--goole-2nd.com", "secure-xn--microsft-jbb.com", "xn--80ak6aa92e.com")


class Spark:
    @staticmethod
    def h(x: str) -> str:
        return f"cast(conv(substr(md5({x}), 1, 8), 16, 10) as bigint)"

    @staticmethod
    def div(a: str, n: int) -> str:
        return f"({a} div {n})"

    @staticmethod
    def item(values, index: str) -> str:
        return f"element_at(array({', '.join(quote(v) for v in values)}), cast({index} + 1 as int))"

    @staticmethod
    def regexp_replace(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {quote(pattern)}, {quote(to)})"


class Duck:
    @staticmethod
    def h(x: str) -> str:
        return f"CAST('0x' || substr(md5({x}), 1, 8) AS BIGINT)"

    @staticmethod
    def div(a: str, n: int) -> str:
        return f"({a} // {n})"

    @staticmethod
    def item(values, index: str) -> str:
        return f"([{', '.join(quote(v) for v in values)}])[{index} + 1]"

    @staticmethod
    def regexp_replace(x: str, pattern: str, to: str) -> str:
        return f"regexp_replace({x}, {quote(pattern)}, {quote(to)}, 'g')"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


PHISHING_SHAPES = (9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 23)


def url_shape(d) -> str:
    """URL of one part row: 24 shapes by ``k mod 24``."""
    k = "p_partkey"
    name = "replace(p_name, ' ', '-')"
    nk = f"{name} || {k}"
    b = d.item(RULES.brands, f"({d.div(k, 24)} % {len(RULES.brands)})")
    w = d.item(RULES.keywords, f"({d.div(k, 7)} % {len(RULES.keywords)})")
    w2 = d.item(RULES.keywords, f"({d.div(k, 5)} % {len(RULES.keywords)})")
    t = d.item(RULES.suspicious_tlds, f"({d.div(k, 3)} % {len(RULES.suspicious_tlds)})")
    sh = d.item(RULES.shared_hosting_roots, f"({d.div(k, 24)} % {len(RULES.shared_hosting_roots)})")
    tr = d.item(RULES.trusted_roots, f"({d.div(k, 24)} % {len(RULES.trusted_roots)})")
    xn = d.item(PUNYCODE_HOSTS, f"({d.div(k, 24)} % {len(PUNYCODE_HOSTS)})")
    shapes = (
        f"'https://' || {nk} || '.com'",
        f"'https://www.' || {nk} || '.com/products/item/' || {k}",
        f"{nk} || '.net'",
        f"'http://' || {nk} || '.co.uk/home'",
        f"'https://' || {tr} || '/login'",
        f"'https://' || {nk} || '.' || {sh} || '/x'",
        f"'http-' || {nk} || '.org/a'",
        f"'http://localhost:8000/' || {w}",
        f"'http://127.0.0.' || ({k} % 250 + 1) || '/admin'",
        f"'http://[2001:db8::' || ({k} % 100) || ']:443/x'",
        f"'http://45.' || ({k} % 200) || '.67.' || ({k} % 250) || '/login'",
        f"'http://' || {b} || '.com@' || {nk} || '.' || {t} || '/' || {w}",
        f"'http://' || {b} || '-' || {w} || '.' || {t}",
        f"'http://' || substr({b}, 1, length({b}) - 1) || '1.com/' || {w}",
        f"'http://' || translate({b}, 'oleia', '01314') || '-' || {w} || '.com'",
        # A tab inside the authority, which parsers drop.
        f"'http://' || {b} || '.' || {name} || CASE WHEN {d.div(k, 24)} % 3 = 0 THEN chr(9) ELSE '' END || {k} || '.com/' || {w}",
        f"'http://' || {w} || '-' || {w2} || '-now.' || {t}",
        f"'hxxp://' || {nk} || '[.]' || {t} || '/' || {w}",
        f"'https://' || {nk} || '[dot]com//////' || {w}",
        f"'http://' || {xn} || '/' || {k}",
        f"'http://аpple' || {k} || '.com'",
        f"'https://' || {nk} || '.in/login/verify/account/secure/update/confirm/billing'",
        f"'https://' || {nk} || '.org/contact?email=a@b.com'",
        f"'https://' || {b} || '-' || {w} || '.' || {sh} || '/login/'",
    )
    cases = " ".join(f"WHEN {i} THEN {text}" for i, text in enumerate(shapes))
    return f"CASE {k} % 24 {cases} END"


def selects(d) -> dict[str, str]:
    """Derived table name -> SELECT over the given tables and earlier derived ones."""
    h, div = d.h, d.div
    shapes = ", ".join(map(str, PHISHING_SHAPES))
    kind = f"CASE WHEN p_partkey % 24 IN ({shapes}) THEN 'phishing' ELSE 'legitimate' END"
    out = {
        "fx_urls": f"""
            SELECT p_partkey AS url_id, {url_shape(d)} AS url, {kind} AS type,
                   'feed' || ({h("CAST(p_partkey AS STRING) || 'src'")} % 3) AS source,
                   CAST(p_partkey % 24 AS INT) AS shape
            FROM part
            UNION ALL
            SELECT 10000000 + page_id AS url_id, url, 'legitimate' AS type, 'pages' AS source, CAST(-1 AS INT) AS shape
            FROM pages""",
        "fx_scored": f"""
            SELECT url_id, url, type, source, shape, CASE WHEN type = 'phishing' THEN 1 ELSE 0 END AS label,
                   CAST({h("url || 'p'")} % 700 + CASE WHEN type = 'phishing' THEN 300 ELSE 0 END AS DOUBLE) / 1000 AS prob
            FROM fx_urls""",
        "fx_blocklist": f"""
            SELECT CASE WHEN url_id % 4 = 0 THEN {d.regexp_replace("url", "^http", "hxxp")} ELSE url END
                   || CASE WHEN url_id % 3 = 0 THEN '/' ELSE '' END AS url
            FROM fx_urls
            WHERE (type = 'phishing' AND {h("url || 'blk'")} % 10 < 3)
               OR (shape IN (4, 5) AND {div("url_id", 24)} % 5 = 0)""",
        "fx_sources": f"""
            SELECT url, type, 'phish_a' AS source, 0 AS prio, url_id AS line_no FROM fx_urls WHERE type = 'phishing'
            UNION ALL
            SELECT url, 'phishing' AS type, 'phish_b' AS source, 1 AS prio, url_id AS line_no FROM fx_urls
            WHERE {h("url || 's2'")} % 10 < 3
            UNION ALL
            SELECT url, type, 'legit' AS source, 2 AS prio, url_id AS line_no FROM fx_urls WHERE type = 'legitimate'
            UNION ALL
            SELECT url, 'legitimate' AS type, 'mixed' AS source, 3 AS prio, url_id AS line_no FROM fx_urls
            WHERE type = 'phishing' AND {h("url || 'mis'")} % 10 = 0
            UNION ALL
            SELECT CAST(NULL AS STRING) AS url, 'legitimate' AS type, 'mixed' AS source, 3 AS prio,
                   url_id + 50000000 AS line_no
            FROM fx_urls WHERE {h("url || 'null'")} % 20 = 0""",
        "fx_feed_old": f"SELECT url FROM fx_urls WHERE {h("url || 'f'")} % 10 <= 5",
        "fx_feed_new": f"SELECT url FROM fx_urls WHERE {h("url || 'f'")} % 10 BETWEEN 4 AND 8",
        "fx_scan_log": f"""
            SELECT e.event_id AS id, 'url' AS type, u.url AS content,
                   CASE WHEN e.event_type = 'error' THEN 'PHISHING' WHEN e.event_type = 'signup' THEN 'SUSPICIOUS'
                        ELSE 'SAFE' END AS result,
                   least(e.value / 50, 10.0) AS risk_score, e.value / 100 AS response_time, e.ts AS ts
            FROM (SELECT *, (SELECT count(*) FROM part) AS n,
                         event_id % ((SELECT count(*) FROM part) + (SELECT count(*) FROM pages)) AS at FROM events) e
            JOIN fx_urls u ON u.url_id = CASE WHEN e.at < e.n THEN e.at ELSE 10000000 + e.at - e.n END""",
    }
    return out


VIEW_NAMES = tuple(selects(Duck))


@lru_cache(maxsize=None)
def _duck_selects() -> dict[str, str]:
    return {k: v.replace("AS STRING", "AS VARCHAR") for k, v in selects(Duck).items()}


def duck_ctes(*names: str) -> list[str]:
    """CTE texts of the named derived tables and whatever they read, in order."""
    texts = _duck_selects()
    needed: set[str] = set()

    def add(name: str) -> None:
        needed.add(name)
        for other in VIEW_NAMES:
            if other != name and other not in needed and other in texts[name]:
                add(other)

    for n in names:
        add(n)
    return [f"{n} AS ({texts[n]})" for n in VIEW_NAMES if n in needed]


def with_duck(names: tuple[str, ...], *ctes: str, select: str) -> str:
    return "WITH " + ",\n".join([*duck_ctes(*names), *ctes]) + "\n" + select


_SCHEMAS = {
    "part": "p_partkey bigint, p_name string",
    "pages": "page_id bigint, url string",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double",
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    use_utc(spark)
    schema = T._parse_datatype_string(_SCHEMAS[name]) if name in _SCHEMAS else None
    reader = spark.read.schema(schema) if schema is not None else spark.read
    df = reader.parquet(f"{sf_dir}/{name}.parquet")
    if name == "events":
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


_STAGED: dict[tuple[str, str, str], str] = {}


def derived(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table, written once per application to the shared folder.

    The jobs under test then read a Parquet table, as they would in production.
    """
    at = (spark.sparkContext.applicationId, sf_dir, name)
    use_utc(spark)
    if at not in _STAGED:
        df = _select(spark, sf_dir, name)
        path = scratch_path(spark, name)
        # One file per core: the jobs are CPU-bound, and these tables are far below a scan split.
        df.repartition(spark.sparkContext.defaultParallelism).write.parquet(path)
        _STAGED[at] = path
        _SCHEMA_OF[name] = df.schema
    return spark.read.schema(_SCHEMA_OF[name]).parquet(_STAGED[at])


_SCHEMA_OF: dict[str, T.StructType] = {}


def _select(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = selects(Spark)[name]
    inputs: dict[str, DataFrame] = {}
    for table in (*VIEW_NAMES, "part", "pages", "events"):
        if table != name and f" {table}" in text.replace("\n", " "):
            inputs[table] = derived(spark, sf_dir, table) if table in VIEW_NAMES else given(spark, sf_dir, table)
    for table in inputs:
        text = text.replace(f"FROM {table}", f"FROM {{{table}}}").replace(f"JOIN {table}", f"JOIN {{{table}}}")
    return spark.sql(text, **inputs)
