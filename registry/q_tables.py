"""Joins, set algebra, metrics and ranked reports (sections E, F, G, H)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostsift import rules as R
from hostsift.functions import urls as U
from hostsift.functions.features import feature_parts
from hostsift.functions.hashing import hash32
from hostsift.functions.idn import with_idn
from hostsift.operators import augment as A
from hostsift.operators import brand_tables as BT
from hostsift.operators import joins as J
from hostsift.operators import metrics as M
from hostsift.operators import ranking as K
from hostsift.operators import sets as S
from hostsift.operators import sketches as SK
from hostsift.plans import kpis as KP
from hostsift.plans import verdict as V
from hostsift.session import scratch_path, staged
from registry.base import LCS, ORACLES, blocked_ctes, feature_ctes, h, parsed, query, sql_in, sql_list, tier_cte
from registry.corpus import AS_OF, RULES, derived, with_duck

TRUSTED, NOISE = sql_in(RULES.trusted_roots), sql_in(R.NOISE_ROOTS)
LISTED = sql_in(sorted(set(RULES.trusted_roots) | set(R.NOISE_ROOTS)))


def parsed_urls(spark, sf, table="fx_urls"):
    return V.parsed(derived(spark, sf, table))


# --- E: joins ---------------------------------------------------------------


@query(
    "blocklist_match",
    with_duck(
        ("fx_urls", "fx_blocklist"), parsed("p", "fx_urls"), *blocked_ctes("b", "p"),
        select="SELECT url_id, norm, blocklisted FROM b",
    ),
)
def blocklist_match(spark, sf):
    out = J.blocklist_match(parsed_urls(spark, sf), derived(spark, sf, "fx_blocklist"))
    return out.select("url_id", "norm", "blocklisted")


@query(
    "allowlist_match",
    with_duck(("fx_urls",), parsed("p", "fx_urls"), select=f"SELECT url_id, root, root IN {TRUSTED} AS trusted FROM p"),
)
def allowlist_match(spark, sf):
    return J.allowlist_match(parsed_urls(spark, sf)).select("url_id", "root", "trusted")


@query(
    "allowlist_table_match",
    with_duck(
        ("fx_urls",), parsed("p", "fx_urls"),
        select="""SELECT url_id, root, coalesce(root IN (SELECT root FROM p WHERE type = 'legitimate' AND url_id % 2 = 0), FALSE)
            AS trusted FROM p""",
    ),
)
def allowlist_table_match(spark, sf):
    """An allowlist that is a table: the roots of every other legitimate URL."""
    table = parsed_urls(spark, sf)
    allowed = table.filter("type = 'legitimate' AND url_id % 2 = 0").select("root")
    return J.allowlist_match(table, allowed=allowed).select("url_id", "root", "trusted")


# Platforms as a table: every root that serves more than one host in the corpus.
PLATFORMS = "platforms AS (SELECT root FROM p WHERE host <> '' GROUP BY root HAVING count(DISTINCT host) > 1)"


@query(
    "shared_host_join",
    with_duck(
        ("fx_urls",), parsed("p", "fx_urls"), PLATFORMS,
        select="""SELECT DISTINCT p.host, q.root FROM (SELECT DISTINCT host FROM p WHERE host <> '') p JOIN platforms q
            ON p.host = q.root OR ends_with(p.host, '.' || q.root)""",
    ),
)
def shared_host_join(spark, sf):
    table = parsed_urls(spark, sf).select("host", "root")
    per_root = table.filter("host <> ''").groupBy("root").agg(F.count_distinct("host").alias("n"))
    return J.shared_host_join(table.select("host"), per_root.filter("n > 1").select("root"))


@query(
    "brand_fuzzy_join",
    with_duck(
        ("fx_urls",), *feature_ctes("fx_urls"),
        select="SELECT p AS piece, b AS brand, round(sim, 6) AS similarity FROM f_hit",
    ),
)
def brand_fuzzy_join(spark, sf):
    hosts = with_idn(feature_parts(derived(spark, sf, "fx_urls")).select("f_host"), "f_host")
    return J.brand_fuzzy_join(hosts).withColumn("similarity", F.round("similarity", 6))


#: A brand table: names of legitimate domains, and the rules' brands.
BRAND_TABLE = f"""names AS (SELECT DISTINCT b FROM (SELECT translate(regexp_replace(f_domain, '[^a-z0-9]', '', 'g'), '013', 'ole') AS b
    FROM f_parts WHERE type = 'legitimate' UNION ALL SELECT unnest({sql_list(RULES.brands)})) WHERE len(b) BETWEEN 4 AND 62)"""


def brand_names(spark, sf):
    parts = feature_parts(derived(spark, sf, "fx_urls")).filter("type = 'legitimate'")
    folded = F.translate(F.regexp_replace("f_domain", "[^a-z0-9]", ""), "013", "ole")
    listed = spark.createDataFrame([(b,) for b in RULES.brands], "brand string")
    return parts.select(folded.alias("brand")).union(listed).filter(F.length("brand").between(4, 62))


@query(
    "brand_table_join",
    with_duck(
        ("fx_urls",), *feature_ctes("fx_urls"), BRAND_TABLE,
        """near AS (SELECT p, b FROM f_piece, names WHERE abs(len(p) - len(b)) <= 0.15 * (len(p) + len(b))
            AND levenshtein(p, b) < 0.15 * (len(p) + len(b)))""",
        f"hits AS (SELECT p, b, 2.0 * {LCS} / (len(p) + len(b)) AS sim FROM near)",
        select="SELECT p AS piece, b AS brand, round(sim, 6) AS similarity FROM hits WHERE sim > 0.85",
    ),
)
def brand_table_join(spark, sf):
    hosts = with_idn(feature_parts(derived(spark, sf, "fx_urls")).select("f_host"), "f_host")
    return BT.brand_table_join(hosts, brand_names(spark, sf)).withColumn("similarity", F.round("similarity", 6))


@query(
    "typo_table_join",
    with_duck(
        ("fx_urls",), parsed("p", "fx_urls"), *feature_ctes("fx_urls")[:1], BRAND_TABLE,
        """labels AS (SELECT DISTINCT string_split(host, '.')[1] AS name FROM p)""",
        """typos AS (SELECT name, min(b) AS typo_brand FROM labels, names
            WHERE abs(len(name) - len(b)) <= 1 AND levenshtein(name, b) = 1 GROUP BY name)""",
        select="SELECT url_id, typo_brand FROM p LEFT JOIN typos ON name = string_split(host, '.')[1]",
    ),
)
def typo_table_join(spark, sf):
    """Brands in the order of their names."""
    brands = brand_names(spark, sf).withColumn("ordinal", F.col("brand"))
    return BT.typo_table_join(parsed_urls(spark, sf), brands).select("url_id", "typo_brand")


FEED_ROOTS = [
    parsed("n_p", "fx_feed_new"),
    "n_roots AS (SELECT DISTINCT root FROM n_p WHERE contains(root, '.'))",
    parsed("k_p", "fx_urls"),
    "ph_roots AS (SELECT DISTINCT root FROM k_p WHERE type = 'phishing' AND source <> 'feed0')",
    "lg_roots AS (SELECT DISTINCT root FROM k_p WHERE type = 'legitimate')",
    "novel AS (SELECT root FROM n_roots WHERE root NOT IN (SELECT root FROM ph_roots))",
]
FEED_TABLES = ("fx_feed_new", "fx_urls")


def root_tables(spark, sf):
    feed = parsed_urls(spark, sf, "fx_feed_new").select("root").filter(F.col("root").contains("."))
    known = parsed_urls(spark, sf)
    phishing = known.filter("type = 'phishing' AND source <> 'feed0'").select("root")
    legit = known.filter("type = 'legitimate'").select("root")
    return feed, phishing, legit


@query("novel_roots", with_duck(FEED_TABLES, *FEED_ROOTS, select="SELECT root FROM novel"))
def novel_roots(spark, sf):
    feed, phishing, _ = root_tables(spark, sf)
    return J.novel_roots(feed, phishing)


@query(
    "clean_roots",
    with_duck(
        FEED_TABLES, *FEED_ROOTS,
        select=f"SELECT root FROM novel WHERE root NOT IN (SELECT root FROM lg_roots) AND root NOT IN {LISTED}",
    ),
)
def clean_roots(spark, sf):
    feed, phishing, legit = root_tables(spark, sf)
    return J.clean_roots(J.novel_roots(feed, phishing), legit)


def noise_sql(where: str, *more: str) -> str:
    ctes = (parsed("p", "fx_urls"), *more)
    return with_duck(("fx_urls",), *ctes, select=f"SELECT url_id, url, type, root FROM p WHERE {where}")


NOISE_OUT = ("url_id", "url", "type", "root")


@query("label_noise_trusted", noise_sql(f"NOT (type = 'phishing' AND root IN {TRUSTED})"))
def label_noise_trusted(spark, sf):
    return J.label_noise_trusted(parsed_urls(spark, sf)).select(*NOISE_OUT)


@query("label_noise_shared_roots", noise_sql(f"root NOT IN {NOISE}"))
def label_noise_shared_roots(spark, sf):
    return J.label_noise_shared_roots(parsed_urls(spark, sf)).select(*NOISE_OUT)


CONTESTED = "contested AS (SELECT root FROM p GROUP BY root HAVING count(DISTINCT type) = 2)"


@query(
    "label_noise_contested_roots",
    noise_sql("NOT (type = 'phishing' AND root IN (SELECT root FROM contested))", CONTESTED),
)
def label_noise_contested_roots(spark, sf):
    return J.label_noise_contested_roots(parsed_urls(spark, sf)).select(*NOISE_OUT)


@query(
    "novelty_flag",
    with_duck(
        ("fx_scored",), parsed("p", "fx_scored"),
        "known AS (SELECT DISTINCT root FROM p WHERE type = 'phishing' AND source = 'feed1')",
        select="SELECT url_id, root, root NOT IN (SELECT root FROM known) AS novel FROM p WHERE source <> 'feed1'",
    ),
)
def novelty_flag(spark, sf):
    scored = parsed_urls(spark, sf, "fx_scored")
    known = scored.filter("type = 'phishing' AND source = 'feed1'").select("root")
    return J.novelty_flag(scored.filter("source <> 'feed1'"), known).select("url_id", "root", "novel")


# Metadata lookups: one per scan, up to half an hour before it.
META_DUCK = [
    parsed("m_p", "fx_urls"),
    "sc AS (SELECT l.id, l.ts, l.result, m.url_id, m.host AS domain, m.type FROM (SELECT * FROM fx_scan_log) l "
    "JOIN m_p m ON m.url_id = l.id % (SELECT count(*) FROM part))",
    f"""meta AS (SELECT domain,
        CASE WHEN {h("domain || 'age'")} % 5 = 0 THEN -1 ELSE CAST({h("domain || 'age'")} % 6000 AS INT) END AS age_days,
        {h("domain || 'dns'")} % 9 <> 0 AS dns_ok,
        {h("domain || 'ssl'")} % 7 <> 0 AS ssl_valid,
        CASE WHEN {h("domain || 'ssl'")} % 7 <> 0 THEN CAST({h("domain || 'cert'")} % 90 AS INT) END AS cert_age_days,
        ts - to_seconds({h("CAST(id AS VARCHAR) || 'chk'")} % 1800) AS checked_at
        FROM sc WHERE {h("CAST(id AS VARCHAR) || 'keep'")} % 4 <> 0)""",
]


def scans_and_meta(spark, sf):
    urls = parsed_urls(spark, sf).select("url_id", F.col("host").alias("domain"), F.col("type").alias("label_type"))
    log = derived(spark, sf, "fx_scan_log").select("id", "ts", "result", "content")
    n = derived(spark, sf, "fx_urls").filter("url_id < 10000000").count()
    scans = log.withColumn("url_id", F.col("id") % n).join(urls, "url_id")
    domain, key = F.col("domain"), F.col("id").cast("string")
    age, ssl = hash32(domain, "age"), hash32(domain, "ssl") % 7 != 0
    meta = scans.filter(hash32(key, "keep") % 4 != 0).select(
        "domain",
        F.when(age % 5 == 0, -1).otherwise((age % 6000).cast("int")).alias("age_days"),
        (hash32(domain, "dns") % 9 != 0).alias("dns_ok"),
        ssl.alias("ssl_valid"),
        F.when(ssl, (hash32(domain, "cert") % 90).cast("int")).alias("cert_age_days"),
        (F.col("ts") - F.make_dt_interval(secs=hash32(key, "chk") % 1800)).alias("checked_at"),
    )
    return scans, meta


ENRICHED = [
    *META_DUCK,
    """nearest AS (SELECT s.id, s.domain, m.age_days, m.ssl_valid, m.cert_age_days,
        row_number() OVER (PARTITION BY s.id ORDER BY m.checked_at DESC) AS rn
        FROM sc s LEFT JOIN meta m ON m.domain = s.domain AND m.checked_at <= s.ts
        AND m.checked_at > s.ts - INTERVAL 900 SECOND)""",
    """enriched AS (SELECT id, domain, coalesce(age_days, -1) AS age_days, coalesce(ssl_valid, FALSE) AS ssl_valid,
        cert_age_days FROM nearest WHERE rn = 1)""",
]


@query("domain_meta_enrich", with_duck(("fx_urls", "fx_scan_log"), *ENRICHED, select="SELECT * FROM enriched"))
def domain_meta_enrich(spark, sf):
    scans, meta = scans_and_meta(spark, sf)
    return J.domain_meta_enrich(scans, meta).select("id", "domain", "age_days", "ssl_valid", "cert_age_days")


# --- F: set operations --------------------------------------------------------


@query(
    "union_sources",
    with_duck(
        ("fx_sources",),
        select="SELECT source, type, count(*) AS rows, count(url) AS urls FROM fx_sources GROUP BY source, type",
    ),
)
def union_sources(spark, sf):
    table = derived(spark, sf, "fx_sources")
    feeds = [table.filter(F.col("source") == s) for s in ("phish_a", "phish_b", "legit", "mixed")]
    merged = S.union_sources(*feeds)
    return merged.groupBy("source", "type").agg(F.count(F.lit(1)).alias("rows"), F.count("url").alias("urls"))


FEEDS = ("fx_feed_old", "fx_feed_new")


@query(
    "feed_union_refresh",
    with_duck(
        FEEDS, "o AS (SELECT DISTINCT url FROM fx_feed_old)", "n AS (SELECT DISTINCT url FROM fx_feed_new)",
        select="""SELECT (SELECT count(*) FROM o) AS existing, (SELECT count(*) FROM n) AS fresh,
            (SELECT count(*) FROM n WHERE url NOT IN (SELECT url FROM o)) AS new,
            (SELECT count(*) FROM (SELECT url FROM o UNION SELECT url FROM n)) AS union_size""",
    ),
)
def feed_union_refresh(spark, sf):
    return S.feed_union_report(derived(spark, sf, "fx_feed_old"), derived(spark, sf, "fx_feed_new"))


@query(
    "feed_refresh",
    with_duck(FEEDS, select="SELECT url, FALSE AS written_again FROM (SELECT url FROM fx_feed_old UNION SELECT url FROM fx_feed_new)"),
)
def feed_refresh(spark, sf):
    """The table as the first refresh writes it; the second finds nothing new and writes nothing."""
    old, new = derived(spark, sf, "fx_feed_old"), derived(spark, sf, "fx_feed_new")
    version = scratch_path(spark, "feed-version")
    S.feed_refresh(old, new, version)
    table = spark.read.schema("url string").parquet(version)
    again = S.feed_refresh(table, new, scratch_path(spark, "feed-version"))
    return table.withColumn("written_again", F.lit(again))


@query(
    "feed_union",
    with_duck(FEEDS, select="SELECT url FROM fx_feed_old UNION SELECT url FROM fx_feed_new"),
)
def feed_union(spark, sf):
    return S.feed_union(derived(spark, sf, "fx_feed_old"), derived(spark, sf, "fx_feed_new"))


@query(
    "roots_except",
    with_duck(
        FEEDS, parsed("a", "fx_feed_new"), parsed("b", "fx_feed_old"),
        select="SELECT root FROM a EXCEPT SELECT root FROM b",
    ),
)
def roots_except(spark, sf):
    return S.roots_except(parsed_urls(spark, sf, "fx_feed_new"), parsed_urls(spark, sf, "fx_feed_old"))


@query(
    "roots_intersect_report",
    with_duck(
        FEED_TABLES, *FEED_ROOTS,
        select=f"""SELECT count(*) AS novel, count(*) FILTER (root IN (SELECT root FROM lg_roots)) AS in_legit,
            count(*) FILTER (root IN {TRUSTED}) AS in_trusted, count(*) FILTER (root IN {NOISE}) AS in_noise FROM novel""",
    ),
)
def roots_intersect_report(spark, sf):
    feed, phishing, legit = root_tables(spark, sf)
    return S.roots_intersect_report(J.novel_roots(feed, phishing), legit)


@query(
    "dedup_keep_first",
    with_duck(
        ("fx_sources",),
        """r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY prio, line_no, type) AS rn FROM fx_sources
            WHERE url IS NOT NULL)""",
        select="SELECT url, type, source, prio, line_no FROM r WHERE rn = 1",
    ),
)
def dedup_keep_first(spark, sf):
    table = derived(spark, sf, "fx_sources").dropna(subset=["url"])
    return S.dedup_keep_first(table, ["prio", "line_no"]).select("url", "type", "source", "prio", "line_no")


@query("dedup_increments", ORACLES["dedup_keep_first"])
def dedup_increments(spark, sf):
    """The sources as three increments, the second one twice."""
    rows = derived(spark, sf, "fx_sources").dropna(subset=["url"])
    table = S.first_rows_table(spark, scratch_path(spark, "first-rows"), rows, ["prio", "line_no"], buckets=8)
    for batch, part in enumerate(("prio = 0", "prio = 1", "prio > 1")):
        kept = S.dedup_increment(table, rows.filter(part), "sources", batch)
        if batch == 1:
            kept = S.dedup_increment(table, rows.filter(part), "sources", batch)
    return kept.select("url", "type", "source", "prio", "line_no")


@query(
    "dedup_report",
    with_duck(
        ("fx_sources",),
        select="SELECT count(*) AS rows, count(DISTINCT url) AS kept, count(*) - count(DISTINCT url) AS removed FROM fx_sources",
    ),
)
def dedup_report(spark, sf):
    return S.dedup_report(derived(spark, sf, "fx_sources"))


@query("dedup_distinct", with_duck(("fx_sources",), select="SELECT DISTINCT url FROM fx_sources"))
def dedup_distinct(spark, sf):
    return S.dedup_distinct(derived(spark, sf, "fx_sources").select("url"))


# --- G: aggregations ----------------------------------------------------------

KPI = """count(*) AS total_scans, count(*) FILTER (result = 'PHISHING') AS phishing_count,
    count(*) FILTER (result = 'SUSPICIOUS') AS suspicious_count, count(*) FILTER (result = 'SAFE') AS safe_count"""


def pct(part: str, whole: str, dp: int = 4) -> str:
    return f"round(coalesce({part} * 100.0 / nullif({whole}, 0), 0.0), {dp})"


@query(
    "scan_kpis",
    with_duck(
        ("fx_scan_log",),
        select=f"""SELECT {KPI}, count(*) FILTER (type = 'url') AS url_scans,
            {pct("count(*) FILTER (result = 'PHISHING')", "count(*)", 2)} AS detection_rate,
            round(avg(response_time) * 1000, 1) AS avg_response_time_ms FROM fx_scan_log""",
    ),
)
def scan_kpis(spark, sf):
    return M.scan_kpis(derived(spark, sf, "fx_scan_log"))


@query(
    "daily_breakdown",
    with_duck(
        ("fx_scan_log",),
        select=f"""SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS total,
            count(*) FILTER (result = 'PHISHING') AS phishing FROM fx_scan_log
            WHERE ts >= CAST(TIMESTAMP '{AS_OF}' AS DATE) - INTERVAL 7 DAY GROUP BY 1""",
    ),
)
def daily_breakdown(spark, sf):
    out = M.daily_breakdown(derived(spark, sf, "fx_scan_log"), F.lit(AS_OF).cast("timestamp"))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query(
    "top_threats",
    with_duck(
        ("fx_scan_log",),
        select="""SELECT content, count(*) AS cnt FROM fx_scan_log WHERE result IN ('PHISHING', 'SUSPICIOUS')
            AND type = 'url' GROUP BY content ORDER BY cnt DESC, content LIMIT 10""",
    ),
)
def top_threats(spark, sf):
    return M.top_threats(derived(spark, sf, "fx_scan_log"))


@query(
    "repeat_threat_rate",
    with_duck(
        ("fx_scan_log",), parsed("p", "fx_scan_log", "content"),
        "d AS (SELECT host, count(*) AS n FROM p WHERE result IN ('PHISHING', 'SUSPICIOUS') GROUP BY host)",
        select=f"""SELECT count(*) AS flagged_domains, count(*) FILTER (n > 1) AS repeated_domains,
            {pct("count(*) FILTER (n > 1)", "count(*)", 2)} AS repeat_threat_rate FROM d""",
    ),
)
def repeat_threat_rate(spark, sf):
    log = derived(spark, sf, "fx_scan_log")
    return M.repeat_threat_rate(log.withColumn("domain", U.parse_host(U.normalize_url(F.col("content")))))


@query(
    "class_distribution", with_duck(("fx_sources",), select="SELECT type, count(*) AS rows FROM fx_sources GROUP BY type")
)
def class_distribution(spark, sf):
    return M.class_distribution(derived(spark, sf, "fx_sources"))


@query(
    "pathed_fraction_by_class",
    with_duck(
        ("fx_urls",), parsed("p", "fx_urls"),
        select="""SELECT type, count(*) AS rows, round(avg(CASE WHEN trim(regexp_extract(CASE WHEN regexp_matches(norm,
            '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN norm ELSE 'http://' || norm END,
            '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^#]*)', 1), '/?') <> '' THEN 1.0 ELSE 0.0 END) * 100, 4)
            AS pathed_pct FROM p GROUP BY type""",
    ),
)
def pathed_fraction_by_class(spark, sf):
    table = parsed_urls(spark, sf)
    return M.pathed_fraction_by_class(table, U.has_path(F.col("norm")))


@query(
    "distinct_roots",
    with_duck(("fx_urls",), parsed("p", "fx_urls"), select="SELECT type, count(DISTINCT root) AS roots FROM p GROUP BY type"),
)
def distinct_roots(spark, sf):
    return M.distinct_roots(parsed_urls(spark, sf))


CM = """m AS (SELECT count(*) FILTER (label = 0 AND prob <= 0.6) AS tn, count(*) FILTER (label = 0 AND prob > 0.6) AS fp,
    count(*) FILTER (label = 1 AND prob <= 0.6) AS fn, count(*) FILTER (label = 1 AND prob > 0.6) AS tp FROM fx_scored)"""


def scored(spark, sf):
    return derived(spark, sf, "fx_scored")


@query("confusion_matrix", with_duck(("fx_scored",), CM, select="SELECT tn, fp, fn, tp FROM m"))
def confusion_matrix(spark, sf):
    return M.confusion_matrix(M.with_prediction(scored(spark, sf)))


REPORT = """SELECT 'legitimate' AS row, round(tn / (tn + fn), 6) AS precision, round(tn / (tn + fp), 6) AS recall,
        round(2.0 * tn / (2 * tn + fn + fp), 6) AS f1, tn + fp AS support FROM m
    UNION ALL SELECT 'phishing', round(tp / (tp + fp), 6), round(tp / (tp + fn), 6),
        round(2.0 * tp / (2 * tp + fp + fn), 6), tp + fn FROM m
    UNION ALL SELECT 'accuracy', round((tn + tp) / (tn + fp + fn + tp), 6), round((tn + tp) / (tn + fp + fn + tp), 6),
        round((tn + tp) / (tn + fp + fn + tp), 6), tn + fp + fn + tp FROM m
    UNION ALL SELECT 'macro avg', round((tn / (tn + fn) + tp / (tp + fp)) / 2, 6),
        round((tn / (tn + fp) + tp / (tp + fn)) / 2, 6),
        round((2.0 * tn / (2 * tn + fn + fp) + 2.0 * tp / (2 * tp + fp + fn)) / 2, 6), tn + fp + fn + tp FROM m
    UNION ALL SELECT 'weighted avg',
        round((tn / (tn + fn) * (tn + fp) + tp / (tp + fp) * (tp + fn)) / (tn + fp + fn + tp), 6),
        round((tn / (tn + fp) * (tn + fp) + tp / (tp + fn) * (tp + fn)) / (tn + fp + fn + tp), 6),
        round((2.0 * tn / (2 * tn + fn + fp) * (tn + fp) + 2.0 * tp / (2 * tp + fp + fn) * (tp + fn))
              / (tn + fp + fn + tp), 6), tn + fp + fn + tp FROM m"""


@query("classification_report", with_duck(("fx_scored",), CM, select=REPORT))
def classification_report(spark, sf):
    return M.classification_report(M.with_prediction(scored(spark, sf)))


@query(
    "fp_rate",
    with_duck(
        ("fx_scored",),
        select=f"""SELECT count(*) AS legit, count(*) FILTER (prob > 0.6) AS false_positives,
            {pct("count(*) FILTER (prob > 0.6)", "count(*)")} AS fp_pct FROM fx_scored WHERE label = 0""",
    ),
)
def fp_rate(spark, sf):
    return M.fp_rate(scored(spark, sf))


RATES = f"""SELECT t AS threshold,
    {pct("count(*) FILTER (label = 0 AND prob > t)", "count(*) FILTER (label = 0)")} AS fp_pct,
    {pct("count(*) FILTER (label = 1 AND prob > t)", "count(*) FILTER (label = 1)")} AS recall_pct"""


@query(
    "threshold_sweep",
    with_duck(
        ("fx_scored",),
        f"th AS (SELECT CAST(unnest([{', '.join(map(str, M.SWEEP_THRESHOLDS))}]) AS DOUBLE) AS t)",
        select=f"{RATES} FROM fx_scored, th GROUP BY t",
    ),
)
def threshold_sweep(spark, sf):
    return M.threshold_sweep(scored(spark, sf))


def grid_ctes(name: str, prob: str) -> list[str]:
    return [
        f"""{name}_g AS (SELECT i, count(*) FILTER (label = 0 AND {prob} > i / 1000) * 100.0
                / nullif(count(*) FILTER (label = 0), 0) AS fp_pct,
                count(*) FILTER (label = 1 AND {prob} > i / 1000) * 100.0
                / nullif(count(*) FILTER (label = 1), 0) AS recall_pct
            FROM fx_scored, (SELECT unnest(range(300, 951, 5)) AS i) GROUP BY i)""",
        f"{name} AS (SELECT * FROM {name}_g WHERE fp_pct <= 9.7 ORDER BY i LIMIT 1)",
    ]


@query(
    "equal_fp_operating_point",
    with_duck(
        ("fx_scored",), *grid_ctes("a", "prob"),
        select="""SELECT CAST(i AS INT) AS threshold_milli, round(fp_pct, 4) AS fp_pct,
            round(recall_pct, 4) AS recall_pct FROM a""",
    ),
)
def equal_fp_operating_point(spark, sf):
    return M.equal_fp_operating_point(scored(spark, sf))


@query(
    "model_gate",
    with_duck(
        ("fx_scored",), *grid_ctes("a", "prob"), *grid_ctes("b", "(prob * 0.9)"),
        select="""SELECT CAST(a.i AS INT) AS candidate_threshold_milli, round(a.recall_pct, 4) AS candidate_recall_pct,
            CAST(b.i AS INT) AS shipped_threshold_milli, round(b.recall_pct, 4) AS shipped_recall_pct,
            round(a.recall_pct, 4) > round(b.recall_pct, 4) AS ships FROM a, b""",
    ),
)
def model_gate(spark, sf):
    table = scored(spark, sf)
    return M.model_gate(table, table.withColumn("prob", F.col("prob") * 0.9))


NOVEL = [
    parsed("p", "fx_scored"),
    "known AS (SELECT DISTINCT root FROM p WHERE type = 'phishing' AND source = 'feed1')",
    f"""s AS (SELECT *, root NOT IN (SELECT root FROM known) AS novel, root IN {TRUSTED} AS trusted,
        regexp_matches(regexp_replace(lower(norm), '^[a-z]+://', ''), '/+[^/]|\\?') AS pathed FROM p WHERE label = 1)""",
]


def novel_scored(spark, sf):
    table = parsed_urls(spark, sf, "fx_scored")
    known = table.filter("type = 'phishing' AND source = 'feed1'").select("root")
    out = J.novelty_flag(J.allowlist_match(table).filter("label = 1"), known)
    return out.withColumn("pathed", U.has_path(F.col("norm"), "split"))


@query(
    "recall_by_slice",
    with_duck(
        ("fx_scored",), *NOVEL,
        select=f"""SELECT slice, t AS threshold, count(*) FILTER (prob > t) AS hits, count(*) AS total,
            {pct("count(*) FILTER (prob > t)", "count(*)")} AS recall_pct
            FROM (SELECT 'all' AS slice, prob FROM s UNION ALL SELECT 'novel', prob FROM s WHERE novel),
                 (SELECT CAST(unnest([0.6, 0.5]) AS DOUBLE) AS t) GROUP BY slice, t""",
    ),
)
def recall_by_slice(spark, sf):
    return M.recall_by_slice(novel_scored(spark, sf))


@query(
    "slice_composition",
    with_duck(
        ("fx_scored",), *NOVEL,
        select="SELECT count(*) AS total, "
        + ", ".join(
            f"count(*) FILTER ({c}) AS {c}, {pct(f'count(*) FILTER ({c})', 'count(*)')} AS {c}_pct"
            for c in ("novel", "pathed", "trusted")
        )
        + " FROM s",
    ),
)
def slice_composition(spark, sf):
    return M.slice_composition(novel_scored(spark, sf))


@query(
    "prob_percentiles",
    with_duck(
        ("fx_scored",),
        select=" UNION ALL ".join(
            f"SELECT type, 'p{int(q * 100)}' AS stat, round(quantile_cont(prob, {q}), 6) AS value FROM fx_scored GROUP BY type"
            for q in M.PERCENTILES
        )
        + " UNION ALL SELECT type, 'mean', round(avg(prob), 6) FROM fx_scored GROUP BY type",
    ),
)
def prob_percentiles(spark, sf):
    return M.prob_percentiles(scored(spark, sf), ["type"])


@query(
    "prob_histogram",
    with_duck(
        ("fx_scored",),
        """b AS (SELECT CASE WHEN prob < 0.25 THEN '[0.00,0.25)' WHEN prob < 0.5 THEN '[0.25,0.50)'
            WHEN prob < 0.75 THEN '[0.50,0.75)' ELSE '[0.75,1.01)' END AS bucket FROM fx_scored)""",
        select=f"""SELECT bucket, count(*) AS rows, {pct("count(*)", "(SELECT count(*) FROM b)")} AS pct
            FROM b GROUP BY bucket""",
    ),
)
def prob_histogram(spark, sf):
    return M.prob_histogram(scored(spark, sf))


TIERS = (parsed("p", "fx_scored"), *feature_ctes("p", "norm"), tier_cte())


def tiered(spark, sf):
    return V.override_tier(parsed_urls(spark, sf, "fx_scored"))


@query(
    "detection_rate_two_views",
    with_duck(
        ("fx_scored",), *TIERS,
        select=f"""SELECT count(*) AS total, count(*) FILTER (pred = 1) AS full_hits,
            {pct("count(*) FILTER (pred = 1)", "count(*)")} AS full_pct, count(*) FILTER (prob > 0.6) AS model_hits,
            {pct("count(*) FILTER (prob > 0.6)", "count(*)")} AS model_pct FROM tiers WHERE label = 1""",
    ),
)
def detection_rate_two_views(spark, sf):
    held_out = parsed_urls(spark, sf, "fx_scored").filter("label = 1")
    return M.detection_rate_two_views(V.override_tier(held_out))


PROFILE = [
    *META_DUCK,
    f"""prof AS (SELECT x.type, count(*) AS n,
        {pct("count(*) FILTER (age_days >= 0)", "count(*)")} AS lookup_pct,
        {pct("count(*) FILTER (age_days < 0)", "count(*)")} AS fail_pct,
        {pct("count(*) FILTER (dns_ok)", "count(*)")} AS dns_pct,
        {pct("count(*) FILTER (age_days BETWEEN 0 AND 364)", "count(*) FILTER (age_days >= 0)")} AS fresh_pct,
        {pct("count(*) FILTER (age_days BETWEEN 365 AND 1094)", "count(*) FILTER (age_days >= 0)")} AS mid_pct,
        {pct("count(*) FILTER (age_days >= 1095)", "count(*) FILTER (age_days >= 0)")} AS old_pct,
        {pct("count(cert_age_days)", "count(*)")} AS cert_pct,
        quantile_cont(CAST(age_days AS DOUBLE), 0.5) FILTER (age_days >= 0) AS median_age,
        quantile_cont(CAST(cert_age_days AS DOUBLE), 0.5) AS median_cert_age
        FROM meta m JOIN (SELECT DISTINCT domain, type FROM sc) x USING (domain) GROUP BY x.type)""",
]


def profile(spark, sf):
    scans, meta = scans_and_meta(spark, sf)
    kinds = scans.select("domain", F.col("label_type").alias("type")).distinct()
    return M.signal_profile(meta.join(kinds, "domain"))


@query(
    "signal_profile",
    with_duck(("fx_urls", "fx_scan_log"), *PROFILE, select="SELECT * FROM prof"),
)
def signal_profile(spark, sf):
    return profile(spark, sf)


@query(
    "signal_verdict",
    with_duck(
        ("fx_urls", "fx_scan_log"), *PROFILE,
        """v AS (SELECT max(fail_pct) FILTER (type = 'phishing') - max(fail_pct) FILTER (type = 'legitimate') AS gap,
            max(fresh_pct) FILTER (type = 'phishing') AS phishing_fresh_pct,
            max(median_age) FILTER (type = 'phishing') AS phishing_median_age FROM prof)""",
        select="""SELECT round(gap, 4) AS fail_gap, phishing_fresh_pct, phishing_median_age,
            CASE WHEN phishing_fresh_pct < 30 AND phishing_median_age > 1095 THEN 'reject'
                 WHEN round(gap, 4) > 25 THEN 'partial' ELSE 'viable' END AS verdict FROM v""",
    ),
)
def signal_verdict(spark, sf):
    return M.signal_verdict(profile(spark, sf))


SUFFIXES = ["", "/courses", "/user/profile/settings/account", "/login/verify/account/secure/update/confirm/billing"]
GRID = [
    parsed("p", "fx_urls"),
    "hosts AS (SELECT DISTINCT host FROM p WHERE contains(host, '.'))",
    f"""grid AS (SELECT host, suffix, 'https://' || host || suffix AS url, suffix = '' AS bare
        FROM hosts, (SELECT unnest([{", ".join(repr(s) for s in SUFFIXES)}]) AS suffix))""",
]


def grid(spark, sf):
    hosts = parsed_urls(spark, sf).select("host").filter(F.col("host").contains(".")).distinct()
    return A.path_variant_grid(hosts, SUFFIXES)


@query("path_variant_grid", with_duck(("fx_urls",), *GRID, select="SELECT host, suffix, url, bare FROM grid"))
def path_variant_grid(spark, sf):
    return grid(spark, sf)


GRID_SCORED = [*GRID, f"gs AS (SELECT *, CAST({h('url')} % 1000 AS DOUBLE) / 1000 AS prob FROM grid)"]
FLIPS = """fl AS (SELECT host, max(prob) FILTER (bare) AS bare_prob, max(prob) FILTER (NOT bare) AS worst_prob,
    coalesce(bare_prob <= 0.6 AND worst_prob > 0.6, FALSE) AS flips FROM gs GROUP BY host)"""


@query("path_flip_report", with_duck(("fx_urls",), *GRID_SCORED, FLIPS, select="SELECT * FROM fl"))
def path_flip_report(spark, sf):
    table = grid(spark, sf).withColumn("prob", (hash32(F.col("url")) % 1000).cast("double") / 1000)
    return M.path_flip_report(table)


@query(
    "path_flip_summary",
    with_duck(
        ("fx_urls",), *GRID_SCORED, FLIPS,
        select="SELECT count(*) AS hosts, count(*) FILTER (flips) AS flipped, max(worst_prob) AS worst_prob FROM fl",
    ),
)
def path_flip_summary(spark, sf):
    return M.path_flip_summary(path_flip_report(spark, sf))


@query(
    "labelled_case_scorecard",
    with_duck(
        ("fx_scored",),
        select=f"""SELECT shape AS bucket, count(*) AS cases, count(*) FILTER ((prob > 0.5) = (label = 1)) AS correct,
            count(*) FILTER (prob > 0.5 AND label = 0) AS false_positives,
            count(*) FILTER (prob <= 0.5 AND label = 1) AS false_negatives,
            {pct("count(*) FILTER ((prob > 0.5) = (label = 1))", "count(*)")} AS accuracy_pct
            FROM fx_scored GROUP BY shape""",
    ),
)
def labelled_case_scorecard(spark, sf):
    return M.labelled_case_scorecard(scored(spark, sf).withColumnRenamed("shape", "bucket"))


@query(
    "decision_tier_counts",
    with_duck(("fx_scored",), *TIERS, select="SELECT tier, count(*) AS urls FROM tiers GROUP BY tier"),
)
def decision_tier_counts(spark, sf):
    return M.decision_tier_counts(tiered(spark, sf))


# --- H: order, top-k ------------------------------------------------------------


@query(
    "recent_events",
    with_duck(
        ("fx_scan_log",),
        select="SELECT id, content, result, round(risk_score, 6) AS risk_score FROM fx_scan_log ORDER BY id DESC LIMIT 20",
    ),
)
def recent_events(spark, sf):
    newest = K.recent_events(derived(spark, sf, "fx_scan_log"))
    return newest.select("id", "content", "result", F.round("risk_score", 6).alias("risk_score"))


@query(
    "worst_offenders",
    with_duck(
        ("fx_scored",),
        select="""SELECT url_id, url, prob FROM fx_scored WHERE label = 0 AND prob > 0.6
            ORDER BY prob DESC, url, url_id LIMIT 15""",
    ),
)
def worst_offenders(spark, sf):
    return K.worst_offenders(scored(spark, sf)).select("url_id", "url", "prob")


@query(
    "verdict_cache_topn",
    with_duck(
        ("fx_scan_log",),
        "r AS (SELECT *, row_number() OVER (PARTITION BY content ORDER BY ts DESC, id DESC) AS rn FROM fx_scan_log)",
        select="SELECT content AS url, id, result FROM r WHERE rn = 1 ORDER BY ts DESC, content LIMIT 200",
    ),
)
def verdict_cache_topn(spark, sf):
    log = derived(spark, sf, "fx_scan_log").select(F.col("content").alias("url"), "ts", "id", "result")
    return K.verdict_cache_topn(log).select("url", "id", "result")


# --- reports from stored partial results and sketches

_CELLS: dict[tuple, object] = {}


def kpi_cells(spark, sf):
    """The log as four batches, one of them written twice, and the scores as three."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _CELLS:
        table = KP.kpi_table(spark, scratch_path(spark, "kpi-cells"))
        log, scores = derived(spark, sf, "fx_scan_log"), scored(spark, sf)
        for batch in (0, 1, 2, 2, 3):
            table.add(KP.log_cells(log.filter(F.col("id") % 4 == batch)), "log", batch)
        for batch in range(3):
            table.add(KP.score_cells(scores.filter(F.col("url_id") % 3 == batch), F.col("source")), "scores", batch)
        _CELLS[at] = table
    return _CELLS[at].totals()


@query("kpi_cells_scan_kpis", ORACLES["scan_kpis"])
def kpi_cells_scan_kpis(spark, sf):
    return KP.scan_kpis(kpi_cells(spark, sf))


@query("kpi_cells_daily_breakdown", ORACLES["daily_breakdown"])
def kpi_cells_daily_breakdown(spark, sf):
    out = KP.daily_breakdown(kpi_cells(spark, sf), F.lit(AS_OF).cast("timestamp"))
    return out.withColumn("day", F.date_format("day", "yyyy-MM-dd"))


@query("kpi_cells_top_threats", ORACLES["top_threats"])
def kpi_cells_top_threats(spark, sf):
    return KP.top_threats(kpi_cells(spark, sf)).drop("missing")


@query("kpi_cells_threshold_sweep", ORACLES["threshold_sweep"])
def kpi_cells_threshold_sweep(spark, sf):
    return KP.threshold_sweep(kpi_cells(spark, sf))


@query("kpi_cells_operating_point", ORACLES["equal_fp_operating_point"])
def kpi_cells_operating_point(spark, sf):
    return KP.operating_point(kpi_cells(spark, sf))


@query("sketched_roots", ORACLES["distinct_roots"])
def sketched_roots(spark, sf):
    """By class, from sketches by feed and class; exact while the sets are smaller than a sketch."""
    sketches = staged(SK.root_sketches(parsed_urls(spark, sf), ["source", "type"]), "root-sketches")
    return SK.sketched_roots(sketches, "type")


@query("sketched_roots_report", ORACLES["roots_intersect_report"])
def sketched_roots_report(spark, sf):
    feed, phishing, legit = root_tables(spark, sf)
    listed = {"in_trusted": RULES.trusted_roots, "in_noise": R.NOISE_ROOTS}
    tables = {"feed": feed, "known": phishing, "in_legit": legit} | {
        name: spark.createDataFrame([(r,) for r in roots], "root string") for name, roots in listed.items()
    }
    sketches = {name: staged(SK.root_sketches(table, []), f"sketch-{name}") for name, table in tables.items()}
    return SK.sketched_report(sketches.pop("feed"), sketches.pop("known"), sketches)
