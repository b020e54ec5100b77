"""Verdict ladder, scan log, retention and star schema (sections A9, H5, K, L1, M)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostsift.functions.hashing import hash32
from hostsift.operators import ranking as K
from hostsift.operators.joins import domain_meta_enrich
from hostsift.plans import bi
from hostsift.plans import retention as T
from hostsift.plans import verdict as V
from hostsift.session import scratch_path
from hostsift.sources import sinks
from registry.base import (
    ORACLES, SPOOF_CONFIRMED, any_keyword, blocked_ctes, brand_in_domain, feature_ctes, h, parsed, query, quote, sql_in, sub_brand,
    typo_brand, verdict_ctes,
)
from registry.corpus import AS_OF, RETENTION_AS_OF, RULES, derived, with_duck
from registry.q_tables import ENRICHED, KPI, TIERS, pct, scans_and_meta, scored, tiered

TABLES = ("fx_scored", "fx_blocklist")
AGE = f"CASE WHEN {h("url || 'age'")} % 5 = 0 THEN -1 ELSE CAST({h("url || 'age'")} % 60 AS INT) END"
TLS = h("url || 'ssl'")
SSL = f"CASE WHEN {TLS} % 11 <> 0 THEN {TLS} % 7 <> 0 END"
# Some scores and TLS states are missing.
VERDICT = verdict_ctes("(SELECT * REPLACE (CASE WHEN url_id % 29 <> 0 THEN prob END AS prob) FROM fx_scored)", AGE, SSL)


def scans(spark, sf):
    """Scored URLs with an age and TLS state; some of both states and scores are missing."""
    age, tls = hash32(F.col("url"), "age"), hash32(F.col("url"), "ssl")
    return scored(spark, sf).withColumns(
        {
            "prob": F.when(F.col("url_id") % 29 != 0, F.col("prob")),
            "age_days": F.when(age % 5 == 0, -1).otherwise((age % 60).cast("int")),
            "ssl_valid": F.when(tls % 11 != 0, tls % 7 != 0),
        }
    )


def judged(spark, sf):
    return V.verdicts(scans(spark, sf), derived(spark, sf, "fx_blocklist"))


@query("override_tier", with_duck(("fx_scored",), *TIERS, select="SELECT url_id, tier, pred, score, override FROM tiers"))
def override_tier(spark, sf):
    return tiered(spark, sf).select("url_id", "tier", "pred", "score", "override")


@query(
    "explain_tier",
    with_duck(
        ("fx_scored",), *TIERS,
        select="""SELECT url_id, CASE WHEN tier IN ('localhost', 'trusted') THEN 'ALLOWLIST' WHEN tier = 'critical'
            THEN 'STRUCTURAL' ELSE 'MODEL' END AS layer, coalesce(override, 'model score') AS why FROM tiers""",
    ),
)
def explain_tier(spark, sf):
    return V.explain_tier(tiered(spark, sf)).select("url_id", "layer", "why")


@query("gate_ladder", with_duck(TABLES, *VERDICT, select="SELECT url_id, gate, result FROM verdict"))
def gate_ladder(spark, sf):
    return judged(spark, sf).select("url_id", "gate", "result")


@query(
    "heuristic_score",
    with_duck(
        TABLES, *VERDICT,
        select="""SELECT url_id, round(points, 6) AS points, CASE WHEN points IS NULL THEN 'UNSCORED' WHEN points > 4.5 THEN 'PHISHING'
            WHEN points >= 3.0 THEN 'SUSPICIOUS' ELSE 'SAFE' END AS heuristic_result FROM verdict""",
    ),
)
def heuristic_score(spark, sf):
    return judged(spark, sf).select("url_id", F.round("heuristic_points", 6).alias("points"), "heuristic_result")


@query(
    "verdict_record",
    with_duck(
        TABLES, *VERDICT,
        select="""SELECT url_id, norm AS input, host AS domain, round(score, 4) AS ml_probability, risk_score, result,
            reasons, domain_age_days, ssl_valid FROM verdict""",
    ),
)
def verdict_record(spark, sf):
    return judged(spark, sf).select(
        "url_id", "input", "domain", "ml_probability", "risk_score", "result",
        F.array_join("reasons", "|").alias("reasons"), "meta.domain_age_days", "meta.ssl_valid",
    )


@query(
    "verdict_counts",
    with_duck(TABLES, *VERDICT, select="SELECT result, gate, count(*) AS urls FROM verdict GROUP BY result, gate"),
)
def verdict_counts(spark, sf):
    """Flagship: every URL through the whole ladder."""
    return judged(spark, sf).groupBy("result", "gate").agg(F.count(F.lit(1)).alias("urls"))


@query(
    "append_scan_log",
    with_duck(
        TABLES, *VERDICT,
        select="""SELECT url_id AS id, 'url' AS type, norm AS content, substr(norm, 1, 500) AS content_shown, result, risk_score,
            round(url_id / 7.0, 4) AS response_time, strftime(make_timestamp((1706659200 + url_id % 864000) * 1000000), '%Y-%m-%d')
            AS event_date FROM verdict""",
    ),
)
def append_scan_log(spark, sf):
    path = scratch_path(spark, "scan-log")
    rows = judged(spark, sf).withColumns(
        {
            "id": F.col("url_id"),
            "response_time": F.col("url_id") / 7,
            "ts": F.timestamp_seconds(F.lit(1706659200) + F.col("url_id") % 864000),
        }
    )
    sinks.append_scan_log(rows, path)
    stored = spark.read.schema(sinks.scan_log_rows(rows).schema).parquet(path)
    return stored.select(
        "id", "type", "content", "content_shown", "result", "risk_score", "response_time",
        F.date_format("event_date", "yyyy-MM-dd").alias("event_date"),
    )


LADDER = [
    parsed("kp", "fx_scored"), *blocked_ctes("kb", "kp"), *feature_ctes("kb", "norm"),
    f"""kl AS (SELECT *, {brand_in_domain("host")} AS bf, {typo_brand("host")} IS NOT NULL AS tf,
        {sub_brand("norm")} IS NOT NULL AS sf,
        CASE WHEN contains(norm, 'localhost') OR contains(norm, '127.0.0.1') OR root IN {sql_in(RULES.trusted_roots)}
             THEN 'SAFE' WHEN dotted_quad = 1 OR authority_at = 1 OR {SPOOF_CONFIRMED} THEN 'PHISHING'
             WHEN prob <= 0.6 AND prob < 0.35 AND NOT (bf OR tf OR sf) THEN 'SAFE' END AS fixed,
        {any_keyword("lower(norm)")} AS kw,
        prob * 3.0 + CASE WHEN bf THEN 3.0 ELSE 0.0 END + CASE WHEN tf THEN 3.0 ELSE 0.0 END
            + CASE WHEN sf THEN 3.0 ELSE 0.0 END + CASE WHEN dotted_quad = 1 THEN 2.5 ELSE 0.0 END
            + CASE WHEN blocklisted THEN 4.0 ELSE 0.0 END AS pts FROM feat)""",
    """kg AS (SELECT *, CASE WHEN fixed IS NOT NULL THEN fixed <> 'SAFE' ELSE (pts + CASE WHEN kw AND prob >= gate
        THEN 1.5 ELSE 0.0 END) * CASE WHEN prob < 0.3 THEN 0.5 ELSE 1.0 END >= 3.0 END AS flagged,
        kw AND prob >= 0.4 AND prob < 0.6 AS affected
        FROM kl, (SELECT CAST(unnest([0.4, 0.45, 0.5, 0.55, 0.6]) AS DOUBLE) AS gate))""",
    "kbase AS (SELECT url_id, flagged AS before FROM kg WHERE gate = 0.4)",
]


def ladder(spark, sf):
    return V.with_weighted_ladder(scored(spark, sf), derived(spark, sf, "fx_blocklist"))


@query(
    "keyword_gate_sweep",
    with_duck(
        TABLES, *LADDER,
        """ks AS (SELECT gate, count(*) FILTER (label = 1 AND flagged) * 100.0 / count(*) FILTER (label = 1) AS r,
            count(*) FILTER (label = 0 AND flagged) * 100.0 / count(*) FILTER (label = 0) AS f,
            count(*) FILTER (affected AND label = 1) AS phishing_affected,
            count(*) FILTER (affected AND label = 0) AS legit_affected,
            count(*) FILTER (affected AND label = 1 AND before AND NOT flagged) AS phishing_lost,
            count(*) FILTER (affected AND label = 0 AND before AND NOT flagged) AS legit_fixed
            FROM kg JOIN kbase USING (url_id) GROUP BY gate)""",
        select="""SELECT gate, round(r, 4) AS recall_pct, round(f, 4) AS fp_pct,
            round(r - (SELECT r FROM ks WHERE gate = 0.4), 4) AS recall_change,
            round(f - (SELECT f FROM ks WHERE gate = 0.4), 4) AS fp_change,
            phishing_affected, legit_affected, phishing_lost, legit_fixed FROM ks""",
    ),
)
def keyword_gate_sweep(spark, sf):
    return V.keyword_gate_sweep(ladder(spark, sf))


@query(
    "lost_examples",
    with_duck(
        TABLES, *LADDER,
        select="""SELECT url_id, url, prob FROM kg JOIN kbase USING (url_id) WHERE gate = 0.6 AND label = 1 AND before
            AND NOT flagged ORDER BY prob DESC, url, url_id LIMIT 12""",
    ),
)
def lost_examples(spark, sf):
    both = ladder(spark, sf).withColumns({"flagged_before": V.flagged_at(0.40), "flagged_after": V.flagged_at(0.60)})
    return K.lost_examples(both).select("url_id", "url", "prob")


# --- L1, M: retention and star schema ---------------------------------------------


def log(spark, sf):
    return derived(spark, sf, "fx_scan_log")


CUT = f"TIMESTAMP '{RETENTION_AS_OF}' - INTERVAL 30 DAY"


@query("retention_filter", with_duck(("fx_scan_log",), select=f"SELECT id, content FROM fx_scan_log WHERE ts >= {CUT}"))
def retention_filter(spark, sf):
    return T.retention_filter(log(spark, sf), F.lit(RETENTION_AS_OF)).select("id", "content")


@query(
    "retention_counts",
    with_duck(
        ("fx_scan_log",),
        select=f"SELECT count(*) FILTER (ts < {CUT}) AS deleted, count(*) FILTER (ts >= {CUT}) AS kept FROM fx_scan_log",
    ),
)
def retention_counts(spark, sf):
    return T.retention_counts(log(spark, sf), F.lit(RETENTION_AS_OF))


@query(
    "fact_events",
    with_duck(
        ("fx_scan_log",),
        select="""SELECT id, CAST(strftime(ts, '%Y%m%d') AS INT) AS date_key, CAST(hour(ts) AS INT) AS hour, type, result,
            CASE WHEN substr(content, 1, 1) IN ('=', '+', '-', '@') THEN '''' ELSE '' END || content AS content,
            CASE WHEN substr(content, 1, 1) IN ('=', '+', '-', '@') THEN '''' ELSE '' END || substr(content, 1, 200)
                AS content_shown, round(risk_score, 6) AS risk_score,
            round(response_time, 6) AS response_time FROM fx_scan_log""",
    ),
)
def fact_events(spark, sf):
    fact = bi.fact_events(log(spark, sf))
    return fact.withColumns({c: F.round(c, 6) for c in ("risk_score", "response_time")})


@query(
    "dim_date",
    with_duck(
        ("fx_scan_log",),
        select="""SELECT DISTINCT CAST(strftime(ts, '%Y%m%d') AS INT) AS date_key, CAST(year(ts) AS INT) AS year,
            CAST(month(ts) AS INT) AS month, strftime(ts, '%B') AS month_name, CAST(day(ts) AS INT) AS day_of_month,
            strftime(ts, '%A') AS weekday, CAST(weekofyear(ts) AS INT) AS iso_week FROM fx_scan_log""",
    ),
)
def dim_date(spark, sf):
    return bi.dim_date(log(spark, sf))


@query(
    "dim_type",
    with_duck(("fx_scan_log",), select="SELECT 'url' AS type, 'URL scan' AS type_name, count(*) AS events FROM fx_scan_log"),
)
def dim_type(spark, sf):
    return bi.dimension_usage(log(spark, sf), bi.dim_type(spark), "type")


RESULT_VALUES = ", ".join(f"({quote(a)}, {quote(b)}, {quote(c)}, CAST({d} AS INT))" for a, b, c, d in bi.RESULT_ROWS)


@query(
    "dim_result",
    with_duck(
        ("fx_scan_log",),
        select=f"""SELECT d.result, d.severity, d.colour, d.sort_order, count(l.id) AS events
            FROM (VALUES {RESULT_VALUES}) d(result, severity, colour, sort_order)
            LEFT JOIN fx_scan_log l ON l.result = d.result GROUP BY ALL""",
    ),
)
def dim_result(spark, sf):
    return bi.dimension_usage(log(spark, sf), bi.dim_result(spark), "result")


@query(
    "kpi_summary",
    with_duck(
        ("fx_scan_log",),
        select=f"""SELECT {KPI}, {pct("count(*) FILTER (result = 'PHISHING')", "count(*)", 2)} AS detection_rate,
            round(avg(response_time) * 1000, 1) AS avg_response_time_ms, round(avg(risk_score), 2) AS avg_risk_score,
            count(*) FILTER (result IN ('PHISHING', 'SUSPICIOUS')
                AND ts >= CAST(TIMESTAMP '{AS_OF}' AS DATE) - INTERVAL 7 DAY) AS threats_this_week FROM fx_scan_log""",
    ),
)
def kpi_summary(spark, sf):
    return bi.kpi_summary(log(spark, sf), F.lit(AS_OF).cast("timestamp"))


@query(
    "scan_log_verdicts",
    with_duck(
        ("fx_urls", "fx_scan_log", "fx_blocklist"),
        *ENRICHED,
        f"""sl AS (SELECT id, content AS url, age_days, ssl_valid, CAST({h("content || 'p'")} % 1000 AS DOUBLE) / 1000 AS prob
            FROM fx_scan_log JOIN enriched USING (id))""",
        *verdict_ctes("sl", "age_days", "ssl_valid"),
        select="SELECT result, gate, count(*) AS scans, round(sum(risk_score), 2) AS risk FROM verdict GROUP BY result, gate",
    ),
)
def scan_log_verdicts(spark, sf):
    """The whole scan log, with the metadata known at each scan, through the ladder."""
    table = domain_meta_enrich(*scans_and_meta(spark, sf)).select("id", F.col("content").alias("url"), "age_days", "ssl_valid")
    table = table.withColumn("prob", (hash32(F.col("url"), "p") % 1000).cast("double") / 1000)
    out = V.verdicts(table, derived(spark, sf, "fx_blocklist"), repeated=True)
    return out.groupBy("result", "gate").agg(
        F.count(F.lit(1)).alias("scans"), F.round(F.sum("risk_score"), 2).alias("risk")
    )


def loaded_star(spark, sf):
    """Four batches of the log in no order of time, each with some events of the one before, one of them loaded twice."""
    path = scratch_path(spark, "star")
    for batch in (0, 1, 2, 2, 3):
        bi.load_star(spark, path, log(spark, sf).filter((F.col("id") % 4 == batch) | (F.col("id") % 40 == batch - 1)), "log", batch, 8)
    return bi.star_tables(spark, path, 8)


@query("loaded_fact_events", ORACLES["fact_events"])
def loaded_fact_events(spark, sf):
    return loaded_star(spark, sf)[0].read().withColumns({c: F.round(c, 6) for c in ("risk_score", "response_time")})


@query("loaded_dim_date", ORACLES["dim_date"])
def loaded_dim_date(spark, sf):
    return loaded_star(spark, sf)[1].read()
