"""URL normalisation, parsing, features and predicates (sections B, C, D)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from hostsift import rules as R
from hostsift.functions import features as X
from hostsift.functions import urls as U
from hostsift.functions.hashing import hash32
from hostsift.functions.idn import idn_skeleton, with_idn
from hostsift.operators import predicates as P
from hostsift.plans import verdict as V
from registry.base import (
    SCHEME, SPOOF_CONFIRMED, any_keyword, ascii_form, brand_in_domain, feature_ctes, h, hosted, is_ip, is_loopback,
    netloc, no_brackets, no_www, parsed, query, shared_host, skeleton, sql_in, strip, sub_brand, typo_brand, with_scheme,
)
from registry.corpus import RULES, derived, with_duck

U_ONLY = ("fx_urls",)


def urls(spark, sf):
    return derived(spark, sf, "fx_urls")


@query("normalize_url", with_duck(U_ONLY, parsed("p", "fx_urls"), select="SELECT url_id, norm FROM p"))
def normalize_url(spark, sf):
    return urls(spark, sf).select("url_id", U.normalize_url(F.col("url")).alias("norm"))


@query(
    "ensure_scheme",
    with_duck(U_ONLY, select=f"SELECT url_id, {with_scheme(strip('url'))} AS full_url FROM fx_urls"),
)
def ensure_scheme(spark, sf):
    return urls(spark, sf).select("url_id", U.ensure_scheme(F.col("url")).alias("full_url"))


@query("parse_host", with_duck(U_ONLY, hosted("p", "fx_urls"), select="SELECT url_id, host FROM p"))
def parse_host(spark, sf):
    return urls(spark, sf).select("url_id", U.parse_host(F.col("url")).alias("host"))


@query(
    "strip_www",
    with_duck(
        U_ONLY,
        f"s AS (SELECT url_id, {netloc(with_scheme(strip('url')))} AS net FROM fx_urls)",
        select=f"SELECT url_id, {no_www('net')} AS bare FROM s",
    ),
)
def strip_www(spark, sf):
    net = U.netloc(U.ensure_scheme(F.col("url")))
    return urls(spark, sf).select("url_id", U.strip_www(net).alias("bare"))


@query("registrable_root", with_duck(U_ONLY, parsed("p", "fx_urls"), select="SELECT url_id, root FROM p"))
def registrable_root(spark, sf):
    norm = U.normalize_url(F.col("url"))
    return urls(spark, sf).withColumn("norm", norm).select("url_id", U.registrable_root(F.col("norm")).alias("root"))


@query(
    "registrable_root_pairs",
    with_duck(
        U_ONLY,
        f"""s AS (SELECT url_id, regexp_replace(lower({strip('url')}), '^[a-z]+://', '') AS rest,
            string_split(string_split(string_split(string_split(rest, '/')[1], '?')[1], '@')[-1], ':')[1] AS raw,
            {no_www('raw')} AS host, list_filter(string_split(host, '.'), lambda x: x <> '') AS parts FROM fx_urls)""",
        select=f"""SELECT url_id, CASE WHEN len(parts) <= 2 THEN host
            WHEN array_to_string(parts[-2:], '.') IN {sql_in(R.SUFFIX_PAIRS)} THEN array_to_string(parts[-3:], '.')
            ELSE array_to_string(parts[-2:], '.') END AS root FROM s""",
    ),
)
def registrable_root_pairs(spark, sf):
    return urls(spark, sf).select("url_id", U.registrable_root_pairs(F.col("url")).alias("root"))


@query(
    "host_is_ip", with_duck(U_ONLY, hosted("p", "fx_urls"), select=f"SELECT url_id, {is_ip('host')} AS is_ip FROM p")
)
def host_is_ip(spark, sf):
    table = urls(spark, sf).withColumn("host", U.parse_host(F.col("url")))
    return table.select("url_id", U.host_is_ip(F.col("host")).alias("is_ip"))


@query(
    "host_is_loopback",
    with_duck(U_ONLY, hosted("p", "fx_urls"), select=f"SELECT url_id, {is_loopback('host')} AS loopback FROM p"),
)
def host_is_loopback(spark, sf):
    table = urls(spark, sf).withColumn("host", U.parse_host(F.col("url")))
    return table.select("url_id", U.host_is_loopback(F.col("host")).alias("loopback"))


@query(
    "strip_to_host",
    with_duck(
        U_ONLY,
        f"s AS (SELECT url_id, {with_scheme(strip(no_brackets('url')))} AS u FROM fx_urls)",
        select=f"SELECT url_id, lower(string_split(u, '://')[1]) || '://' || {netloc('u')} AS bare FROM s",
    ),
)
def strip_to_host(spark, sf):
    return urls(spark, sf).select("url_id", U.strip_to_host(F.col("url")).alias("bare"))


@query(
    "has_path",
    with_duck(
        U_ONLY,
        f"""s AS (SELECT url_id, {with_scheme(strip(no_brackets('url')))} AS a, {with_scheme(strip('url'))} AS c,
            regexp_replace(lower({strip('url')}), '^[a-z]+://', '') AS b FROM fx_urls)""",
        select=f"""SELECT url_id,
            trim(regexp_extract(a, '{SCHEME}[^/?#]*([^?#]*)', 1), '/') <> ''
                OR regexp_extract(a, '\\?([^#]*)', 1) <> '' AS path_or_query,
            trim(substr(b, length(string_split(b, '/')[1]) + 1), '/') <> '' OR contains(b, '?') AS split,
            trim(regexp_extract(c, '{SCHEME}[^/?#]*([^?#]*)', 1), '/') <> '' AS path FROM s""",
    ),
)
def has_path(spark, sf):
    modes = [U.has_path(F.col("url"), m).alias(m) for m in ("path_or_query", "split", "path")]
    return urls(spark, sf).select("url_id", *modes)


@query(
    "strip_http_scheme",
    with_duck(U_ONLY, select="SELECT url_id, regexp_replace(url, '^https?://', '') AS text FROM fx_urls"),
)
def strip_http_scheme(spark, sf):
    return urls(spark, sf).select("url_id", U.strip_http_scheme(F.col("url")).alias("text"))


# A cell per row, some starting with a formula character.
_CELL_SPARK = "CASE url_id % 6 WHEN 0 THEN '=' || url WHEN 1 THEN '+' || url WHEN 2 THEN '-' || url WHEN 3 THEN '@' || url WHEN 4 THEN url END"


@query(
    "csv_safe",
    with_duck(
        U_ONLY,
        f"c AS (SELECT url_id, coalesce({_CELL_SPARK}, '') AS cell FROM fx_urls)",
        select="SELECT url_id, CASE WHEN substr(cell, 1, 1) IN ('=', '+', '-', '@', chr(9), chr(13)) "
        "THEN '''' || cell ELSE cell END AS guarded FROM c",
    ),
)
def csv_safe(spark, sf):
    return urls(spark, sf).select("url_id", U.csv_safe(F.expr(_CELL_SPARK)).alias("guarded"))


@query(
    "leet_fold",
    with_duck(
        U_ONLY,
        select="""SELECT url_id, translate(regexp_replace(url, '[^a-z0-9]', '', 'g'), '013', 'ole') AS folded,
            translate(url, 'oleia', '01314') AS obfuscated FROM fx_urls""",
    ),
)
def leet_fold(spark, sf):
    u = F.col("url")
    return urls(spark, sf).select("url_id", U.leet_fold(u).alias("folded"), U.leet_obfuscate(u).alias("obfuscated"))


@query(
    "idn_skeleton",
    with_duck(
        U_ONLY, hosted("p", "fx_urls"),
        f"q AS (SELECT url_id, host, {skeleton('host')} AS shown FROM p)",
        select=f"SELECT url_id, host, {ascii_form('shown')} AS skeleton FROM q",
    ),
)
def skeletons(spark, sf):
    table = urls(spark, sf).select("url_id", U.parse_host(F.col("url")).alias("host"))
    return idn_skeleton(table)


@query(
    "skip_internal_urls",
    with_duck(
        U_ONLY,
        f"""n AS (SELECT url_id, CASE {h("url || 'nav'")} % 8 WHEN 0 THEN 'chrome://settings/' || url_id
            WHEN 1 THEN 'about:blank' WHEN 2 THEN 'file:///tmp/' || url_id WHEN 3 THEN NULL ELSE url END AS url
            FROM fx_urls)""",
        select="""SELECT url_id, url FROM n WHERE url IS NOT NULL AND NOT (starts_with(url, 'chrome://')
            OR starts_with(url, 'chrome-extension://') OR starts_with(url, 'about:') OR starts_with(url, 'file://')
            OR starts_with(url, 'data:'))""",
    ),
)
def skip_internal_urls(spark, sf):
    pick = hash32(F.col("url"), "nav") % 8
    key = F.col("url_id").cast("string")
    nav = (
        F.when(pick == 0, F.concat(F.lit("chrome://settings/"), key))
        .when(pick == 1, "about:blank")
        .when(pick == 2, F.concat(F.lit("file:///tmp/"), key))
        .when(pick > 3, F.col("url"))
    )
    return P.skip_internal_urls(urls(spark, sf).select("url_id", nav.alias("url")))


def feature_sql(columns: str) -> str:
    return with_duck(U_ONLY, *feature_ctes("fx_urls"), select=f"SELECT url_id, {columns} FROM feat")


def parts(spark, sf):
    return X.feature_parts(urls(spark, sf))


@query("feat_lexical", feature_sql("length, dots, hyphens, slashes, digits"))
def feat_lexical(spark, sf):
    return X.lexical(parts(spark, sf)).select("url_id", "length", "dots", "hyphens", "slashes", "digits")


@query("feat_entropy", feature_sql("round(entropy, 6) AS entropy"))
def feat_entropy(spark, sf):
    return parts(spark, sf).select("url_id", F.round(X.entropy(F.col("f_url")), 6).alias("entropy"))


@query("feat_keywords", feature_sql("keywords, host_keywords"))
def feat_keywords(spark, sf):
    return X.keywords(parts(spark, sf)).select("url_id", "keywords", "host_keywords")


@query(
    "feat_brand_similarity",
    feature_sql("round(brand_similarity, 6) AS brand_similarity, brand_spoof, brand_with_keyword"),
)
def feat_brand_similarity(spark, sf):
    out = X.brand_similarity(X.keywords(with_idn(parts(spark, sf), "f_host")))
    sim = F.round("brand_similarity", 6).alias("brand_similarity")
    return out.select("url_id", sim, "brand_spoof", "brand_with_keyword")


STRUCTURE = (
    "dotted_quad", "authority_at", "authority_at_dot", "path_segments", "domain_hyphen", "subdomain_labels",
    "suspicious_tld", "loopback_text",
)


@query("feat_structure", feature_sql(", ".join(STRUCTURE)))
def feat_structure(spark, sf):
    return X.structure(parts(spark, sf)).select("url_id", *STRUCTURE)


@query("feat_host", feature_sql("host_hyphens, punycode, non_ascii_host"))
def feat_host(spark, sf):
    out = X.host_signals(with_idn(parts(spark, sf), "f_host"))
    return out.select("url_id", "host_hyphens", "punycode", "non_ascii_host")


@query("feature_vector", feature_sql(", ".join(f"round(CAST({n} AS DOUBLE), 6) AS {n}" for n in X.FEATURE_NAMES)))
def feature_vector(spark, sf):
    out = X.feature_vector(urls(spark, sf))
    return out.select("url_id", *[F.round(F.col("features")[i], 6).alias(n) for i, n in enumerate(X.FEATURE_NAMES)])


@query("typo_squat", with_duck(U_ONLY, parsed("p", "fx_urls"), select=f"SELECT url_id, {typo_brand('host')} AS typo_brand FROM p"))
def typo_squat(spark, sf):
    return P.typo_squat(V.parsed(urls(spark, sf))).select("url_id", "typo_brand")


@query(
    "brand_in_subdomain",
    with_duck(U_ONLY, parsed("p", "fx_urls"), select=f"SELECT url_id, {sub_brand('norm')} AS sub_brand FROM p"),
)
def brand_in_subdomain(spark, sf):
    return P.brand_in_subdomain(V.parsed(urls(spark, sf)), "norm").select("url_id", "sub_brand")


@query(
    "brand_in_domain",
    with_duck(U_ONLY, parsed("p", "fx_urls"), select=f"SELECT url_id, {brand_in_domain('host')} AS brand_flag FROM p"),
)
def brand_in_dom(spark, sf):
    return P.brand_in_domain(V.parsed(urls(spark, sf))).select("url_id", "brand_flag")


@query(
    "shared_hosting",
    with_duck(U_ONLY, parsed("p", "fx_urls"), select=f"SELECT url_id, {shared_host('host')} AS shared_host FROM p"),
)
def shared_hosting(spark, sf):
    return P.shared_hosting(V.parsed(urls(spark, sf))).select("url_id", "shared_host")


@query(
    "keyword_gate",
    with_duck(
        ("fx_scored",), select=f"SELECT url_id, prob >= 0.55 AND {any_keyword('lower(url)')} AS keyword_flag FROM fx_scored"
    ),
)
def keyword_gate(spark, sf):
    table = derived(spark, sf, "fx_scored")
    return table.select("url_id", P.keyword_gate("url", F.col("prob")).alias("keyword_flag"))


@query(
    "structural_override",
    with_duck(
        U_ONLY, parsed("p", "fx_urls"), *feature_ctes("p", "norm"),
        select=f"SELECT url_id, {is_ip('host')} OR authority_at = 1 OR {SPOOF_CONFIRMED} AS critical FROM feat",
    ),
)
def structural_override(spark, sf):
    out = X.with_features(V.parsed(urls(spark, sf)), "norm")
    return out.select("url_id", P.structural_override(F.col("host")).alias("critical"))


@query("drop_null_urls", with_duck(("fx_sources",), select="SELECT url, type, line_no FROM fx_sources WHERE url IS NOT NULL"))
def drop_null_urls(spark, sf):
    return P.drop_null_urls(derived(spark, sf, "fx_sources")).select("url", "type", "line_no")


@query(
    "drop_malformed_hosts",
    with_duck(
        U_ONLY,
        f"s AS (SELECT url_id, {with_scheme(strip(no_brackets('url')))} AS u FROM fx_urls)",
        f"b AS (SELECT url_id, lower(string_split(u, '://')[1]) || '://' || {netloc('u')} AS bare FROM s)",
        select="SELECT url_id, bare FROM b WHERE contains(string_split(bare, '//')[-1], '.')",
    ),
)
def drop_malformed_hosts(spark, sf):
    table = urls(spark, sf).select("url_id", U.strip_to_host(F.col("url")).alias("bare"))
    return P.drop_malformed_hosts(table)


#: An allowlist that lacks most shared-hosting roots.
SOME_TRUSTED = tuple(r for r in RULES.trusted_roots if r not in RULES.shared_hosting_roots[1:])


#: A rule set whose keyword gate lies above the decision, beside the default one.
BROKEN = replace(RULES, keyword_min_prob=0.7)


def threshold_lines(name: str, rules) -> list[str]:
    marks = [("zero", 0.0), ("safe", rules.ml_safe_threshold), ("keyword", rules.keyword_min_prob), ("decision", rules.ml_decision_threshold), ("one", 1.0)]
    return [
        f"SELECT '{name}' AS rules, '{low}' AS lower, '{high}' AS upper, {a} < {b} AS in_order, "
        f"(SELECT count(*) FROM fx_scored WHERE prob >= {a} AND prob < {b}) AS scores"
        for (low, a), (high, b) in zip(marks, marks[1:])
    ]


@query(
    "validate_thresholds",
    with_duck(("fx_scored",), select=" UNION ALL ".join(threshold_lines("default", RULES) + threshold_lines("broken", BROKEN))),
)
def validate_thresholds(spark, sf):
    """The order of the thresholds of two rule sets, and the scores between them."""
    scored = derived(spark, sf, "fx_scored")
    sides = [P.threshold_order(scored, rules).withColumn("rules", F.lit(name)) for name, rules in (("default", RULES), ("broken", BROKEN))]
    return sides[0].unionByName(sides[1])


@query(
    "validate_rules",
    with_duck(
        U_ONLY, parsed("p", "fx_urls"),
        select=f"""SELECT 'shared_host_not_trusted' AS problem, root AS detail FROM (SELECT DISTINCT root FROM p
            WHERE {shared_host('host')} AND root NOT IN {sql_in(SOME_TRUSTED)})""",
    ),
)
def validate_rules(spark, sf):
    """Shared-hosting roots in use that a thinned allowlist lacks."""
    table = P.shared_hosting(V.parsed(urls(spark, sf)))
    shared = table.filter("shared_host").select("root")
    trusted = table.filter(F.col("root").isin(*SOME_TRUSTED)).select("root")
    found = P.orphan_shared_roots(shared, trusted)
    return found.select(F.lit("shared_host_not_trusted").alias("problem"), F.col("root").alias("detail"))
