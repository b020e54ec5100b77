"""Registration of queries and the SQL text generators of their twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hostsift import rules as R
from registry.corpus import PUNYCODE_HOSTS, RULES, Duck, quote

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


h = Duck.h


def sql_list(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def sql_in(values) -> str:
    return "(" + ", ".join(quote(v) for v in values) + ")"


def strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


SCHEME = r"^[A-Za-z][A-Za-z0-9+.\-]*://"


def with_scheme(x: str) -> str:
    """``x`` is a stripped string expression."""
    return f"CASE WHEN regexp_matches({x}, '{SCHEME}') THEN {x} ELSE 'http://' || {x} END"


def netloc(x: str) -> str:
    return f"regexp_extract(translate({x}, chr(9) || chr(10) || chr(13), ''), '{SCHEME}([^/?#]*)', 1)"


def no_brackets(x: str) -> str:
    return f"replace(replace({x}, '[', ''), ']', '')"


def no_www(x: str) -> str:
    return f"regexp_replace(lower({x}), '^www\\.', '')"


def root_of(host: str) -> str:
    """Registrable root of a host column, by label lists."""
    labels = f"string_split({host}, '.')"
    two = sql_in(R.SECOND_LEVEL_LABELS)
    return (
        f"CASE WHEN len({labels}) >= 3 AND {labels}[-2] IN {two} THEN array_to_string({labels}[-3:], '.') "
        f"WHEN len({labels}) > 1 THEN array_to_string({labels}[-2:], '.') ELSE {host} END"
    )


def host_columns(url: str, prefix: str = "") -> str:
    """Select-list that computes ``host`` and ``root`` of a URL expression."""
    p = prefix
    return f"""
        {with_scheme(strip(f"coalesce({url}, '')"))} AS {p}sch,
        {netloc(f"{p}sch")} AS {p}net,
        regexp_extract({p}net, '([^@]*)$', 1) AS {p}tail,
        CASE WHEN contains({p}net, '[') <> contains({p}net, ']') THEN ''
             WHEN starts_with({p}tail, '[') THEN {no_www(f"regexp_extract({p}tail, '^\\[([^\\]]*)', 1)")}
             ELSE {no_www(f"regexp_extract({p}tail, '^([^:]*)', 1)")} END AS {p}host,
        {root_of(f"{p}host")} AS {p}root"""


def norm_columns(url: str) -> str:
    return rf"""
        regexp_replace({strip(f"coalesce({url}, '')")}, '^(?i:hxxp)', 'http') AS n1,
        replace(replace(replace(replace(replace(regexp_replace(n1, '(?i)\[\s*dot\s*\]', '.', 'g'),
            '[.]', '.'), '(.)', '.'), '{{.}}', '.'), '[:]', ':'), '[/]', '/') AS n2,
        CASE WHEN regexp_matches(n2, '\[[0-9a-fA-F:]+\]') THEN n2 ELSE {no_brackets("n2")} END AS n3,
        {strip(r"regexp_replace(n3, '(^|[^:])/{2,}', '\1/', 'g')")} AS norm"""


def parsed(name: str, base: str, url: str = "url") -> str:
    """CTE adding norm, host, root."""
    return f"""{name} AS (
        SELECT * EXCLUDE (n1, n2, n3, sch, net, tail)
        FROM (SELECT *, {norm_columns(url)}, {host_columns("norm")} FROM {base}))"""


def hosted(name: str, base: str, url: str = "url") -> str:
    """CTE adding host and root of the raw URL."""
    return f"""{name} AS (
        SELECT * EXCLUDE (sch, net, tail) FROM (SELECT *, {host_columns(url)} FROM {base}))"""


OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


def is_ip(host: str) -> str:
    """The corpus holds dotted quads and ``2001:db8::n`` literals."""
    v6 = r"^([0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4}){0,6})?::([0-9a-fA-F]{1,4}(:[0-9a-fA-F]{1,4}){0,6})?$"
    return f"(regexp_matches({host}, '^{OCTET}(\\.{OCTET}){{3}}$') OR regexp_matches({host}, '{v6}'))"


def is_loopback(host: str) -> str:
    return f"({host} = 'localhost' OR ({host} LIKE '127.%' AND {is_ip(host)}) OR {host} = '::1')"


def skeleton(host: str) -> str:
    """ASCII form of a host: decode the corpus's punycode labels, map look-alikes, drop the rest."""
    text = host
    for label in sorted({x for name in PUNYCODE_HOSTS for x in name.split(".") if "xn--" in x}):
        if label.startswith("xn--"):
            text = f"replace({text}, {quote(label)}, {quote(label[4:].encode().decode('punycode'))})"
    return text


def ascii_form(text: str) -> str:
    src, dst = "".join(R.CONFUSABLES), "".join(R.CONFUSABLES.values())
    return f"regexp_replace(translate({text}, '{src}', '{dst}'), '[^\\x00-\\x7F]', '', 'g')"


def part_columns(url: str) -> str:
    return f"""
        {no_brackets(strip(f"lower(coalesce({url}, ''))"))} AS f0,
        {with_scheme(strip("f0"))} AS f_url,
        {netloc("f_url")} AS f_authority,
        regexp_replace(regexp_extract(regexp_extract(f_authority, '([^@]*)$', 1), '^([^:]*)', 1), '^www\\.', '')
            AS f_host,
        string_split(f_host, '.') AS f_labels,
        CASE WHEN len(f_labels) > 1 THEN f_labels[-2] ELSE f_labels[1] END AS f_domain"""


def count_of(x: str, ch: str) -> str:
    return f"(length({x}) - length(replace({x}, '{ch}', '')))"


ENTROPY = """CASE WHEN f_url = '' THEN 0.0 ELSE
    -list_sum([(len(list_filter(string_split(f_url, ''), lambda y: y = ch)) / length(f_url))
               * log2(len(list_filter(string_split(f_url, ''), lambda y: y = ch)) / length(f_url))
               for ch in list_distinct(string_split(f_url, ''))]) END"""


#: Longest common subsequence of ``p`` and ``b``.
LCS = """list_reduce([[ascii(x)::BIGINT] for x in string_split(p, '')],
        lambda prev, ch: list_reduce([[j::BIGINT] for j in range(1, len(b) + 1)],
            lambda acc, jj: list_append(acc, CASE WHEN ch[1] = ascii(b[jj[1]]) THEN prev[jj[1]] + 1
                                                  ELSE greatest(prev[jj[1] + 1], acc[jj[1]]) END), [0::BIGINT]),
        [0::BIGINT for z in range(0, len(b) + 1)])[-1]"""


def feature_ctes(base: str, url: str = "url") -> list[str]:
    """CTE chain ending in ``feat``: every row of ``base`` plus all named features."""
    kw, brands, tlds = sql_list(RULES.keywords), sql_list(RULES.brands), sql_in(RULES.suspicious_tlds)
    pieces = f"""list_distinct(list_filter(
        [translate(regexp_replace(p, '[^a-z0-9]', '', 'g'), '013', 'ole')
         for p in list_concat(regexp_split_to_array(f_host, '[.\\-]'), regexp_split_to_array(f_skel, '[.\\-]'))],
        lambda p: len(p) >= 4))"""
    return [
        f"f_parts AS (SELECT *, {part_columns(url)}, {skeleton('f_host')} AS f_idn, {ascii_form('f_idn')} AS f_skel, "
        f"{pieces} AS f_pieces FROM {base})",
        "f_piece AS (SELECT DISTINCT unnest(f_pieces) AS p FROM f_parts)",
        f"f_pair AS (SELECT p, b, 2.0 * {LCS} / (len(p) + len(b)) AS sim FROM f_piece, (SELECT unnest({brands}) AS b))",
        "f_hit AS (SELECT p, b, sim FROM f_pair WHERE sim > 0.85)",
        """f_best AS (SELECT f_domain AS d, f_pieces AS ps, max(sim) AS sim, max(CASE WHEN b <> f_domain THEN 1 ELSE 0 END) AS spoof
            FROM (SELECT DISTINCT f_domain, f_pieces, unnest(f_pieces) AS p FROM f_parts) JOIN f_hit USING (p)
            GROUP BY f_domain, f_pieces)""",
        f"""feat AS (
            SELECT f.* EXCLUDE (f0),
                length(f_url) / 100 AS length,
                {count_of("f_url", ".")} AS dots, {count_of("f_url", "-")} AS hyphens,
                {count_of("f_url", "/")} AS slashes,
                length(regexp_replace(f_url, '[^0-9]', '', 'g')) AS digits,
                {ENTROPY} AS entropy,
                len(list_filter({kw}, lambda k: contains(f_url, k))) AS keywords,
                coalesce(h.sim, 0.0) AS brand_similarity,
                coalesce(h.spoof, 0) AS brand_spoof,
                CASE WHEN coalesce(h.spoof, 0) = 1 AND keywords > 0 THEN 1 ELSE 0 END AS brand_with_keyword,
                CAST(regexp_matches(f_url, '[0-9]+\\.[0-9]+\\.[0-9]+\\.[0-9]+') AS INT) AS dotted_quad,
                CAST(contains(f_authority, '@') AS INT) AS authority_at,
                CAST(contains(f_authority, '@') AND contains(regexp_extract(f_authority, '([^@]*)$', 1), '.') AS INT)
                    AS authority_at_dot,
                len(list_filter(string_split(regexp_extract(f_url, '{SCHEME}[^/?#]*([^?#]*)', 1), '/'),
                    lambda s: s <> '')) AS path_segments,
                CAST(contains(f_domain, '-') AS INT) AS domain_hyphen,
                greatest(len(f_labels) - 2, 0) AS subdomain_labels,
                CAST(len(f_labels) > 1 AND f_labels[-1] IN {tlds} AS INT) AS suspicious_tld,
                CAST(contains(f_url, 'localhost') OR contains(f_url, '127.0.0.1') AS INT) AS loopback_text,
                len(list_filter(regexp_split_to_array(f_host, '[.\\-]'), lambda t: list_contains({kw}, t)))
                    AS host_keywords,
                {count_of("f_host", "-")} AS host_hyphens,
                CAST(contains(f_host, 'xn--') AS INT) AS punycode,
                CAST(regexp_matches(f_idn, '[^\\x00-\\x7F]') AS INT) AS non_ascii_host
            FROM f_parts f LEFT JOIN f_best h ON h.d = f.f_domain AND h.ps = f.f_pieces)""",
    ]


def brand_in_domain(host: str) -> str:
    return (
        f"len(list_filter({sql_list(RULES.brands)}, lambda b: contains({host}, b) AND "
        f"NOT ({host} = b OR {host} = b || '.com' OR ends_with({host}, '.' || b || '.com')))) > 0"
    )


def typo_brand(host: str) -> str:
    return f"list_filter({sql_list(RULES.brands)}, lambda b: levenshtein(string_split({host}, '.')[1], b) = 1)[1]"


def sub_brand(url: str) -> str:
    labels = f"string_split(string_split(string_split({url}, '//')[-1], '/')[1], '.')"
    return f"list_filter({labels}[:-3], lambda x: list_contains({sql_list(RULES.brands)}, x))[1]"


def shared_host(host: str) -> str:
    return (
        f"len(list_filter({sql_list(RULES.shared_hosting_roots)}, "
        f"lambda r: {host} = r OR ends_with({host}, '.' || r))) > 0"
    )


def any_keyword(text: str) -> str:
    return f"len(list_filter({sql_list(RULES.keywords)}, lambda k: contains({text}, k))) > 0"


SPOOF_CONFIRMED = (
    "(brand_spoof = 1 AND (brand_with_keyword = 1 OR suspicious_tld = 1 OR punycode = 1 OR non_ascii_host = 1))"
)


def tier_cte(name: str = "tiers", base: str = "feat") -> str:
    return f"""{name} AS (
        SELECT *,
            CASE WHEN {is_loopback("host")} THEN 'localhost'
                 WHEN root IN {sql_in(RULES.trusted_roots)} THEN 'trusted'
                 WHEN {is_ip("host")} OR authority_at = 1 OR {SPOOF_CONFIRMED} THEN 'critical'
                 ELSE 'model' END AS tier,
            CASE tier WHEN 'localhost' THEN 0.001 WHEN 'trusted' THEN 0.001 WHEN 'critical' THEN 0.999 ELSE prob END
                AS score,
            CASE tier WHEN 'localhost' THEN 0 WHEN 'trusted' THEN 0 WHEN 'critical' THEN 1
                 ELSE CAST(prob > 0.6 AS INT) END AS pred,
            CASE tier WHEN 'localhost' THEN {quote(R.REASON_LOCALHOST)} WHEN 'trusted' THEN {quote(R.REASON_TRUSTED)}
                 WHEN 'critical' THEN {quote(R.REASON_CRITICAL)} END AS override
        FROM {base})"""


def blocked_ctes(name: str, base: str, known: str = "TRUE") -> list[str]:
    """Adds ``blocklisted`` to a table with ``norm``; ``known`` says which entries (``b.key``) a row's scan could see."""
    return [
        parsed("bl_norm", "fx_blocklist"),
        r"bl_keys AS (SELECT DISTINCT regexp_replace(norm, '/+$', '') AS key FROM bl_norm WHERE contains(norm, '.'))",
        rf"""{name} AS (SELECT t.*, b.key IS NOT NULL AS blocklisted
            FROM {base} t LEFT JOIN bl_keys b ON {known} AND b.key = regexp_replace(t.norm, '/+$', ''))""",
    ]


def verdict_ctes(base: str, age: str = "-1", ssl: str = "FALSE", known: str = "TRUE") -> list[str]:
    """CTE chain ending in ``verdict``; ``base`` has url, prob and whatever age / ssl name."""
    r = RULES
    return [
        parsed("v_parsed", f"(SELECT *, {age} AS v_age, {ssl} AS v_ssl FROM {base})"),
        *blocked_ctes("v_blocked", "v_parsed", known),
        *feature_ctes("v_blocked", "norm"),
        tier_cte("v_tier", "feat"),
        f"""v_flags AS (SELECT *, {brand_in_domain("host")} AS brand_flag, {typo_brand("host")} AS typo_b,
            {sub_brand("norm")} AS sub_b, {is_ip("host")} AS ip_flag,
            score >= {r.keyword_min_prob} AND {any_keyword("lower(norm)")} AS keyword_flag,
            {shared_host("host")} AS on_shared, v_age <> -1 AND v_age < {r.new_domain_max_age_days} AS young
            FROM v_tier)""",
        f"""v_gate AS (SELECT *,
            CASE WHEN tier = 'critical' THEN 'critical'
                 WHEN blocklisted AND (tier = 'model' OR (tier = 'trusted' AND on_shared)) THEN 'blocklist'
                 WHEN tier = 'trusted' THEN 'trusted'
                 WHEN score IS NULL THEN 'unscored'
                 WHEN pred = 0 AND score < {r.ml_safe_threshold} AND NOT brand_flag AND typo_b IS NULL
                      AND sub_b IS NULL THEN 'safe'
                 ELSE 'heuristic' END AS gate,
            score * 3.0 + CASE WHEN brand_flag THEN 3.0 ELSE 0.0 END + CASE WHEN typo_b IS NOT NULL THEN 3.0 ELSE 0.0 END
                + CASE WHEN sub_b IS NOT NULL THEN 3.0 ELSE 0.0 END + CASE WHEN ip_flag THEN 2.5 ELSE 0.0 END
                + CASE WHEN keyword_flag THEN 1.5 ELSE 0.0 END + CASE WHEN young THEN 1.0 ELSE 0.0 END
                + CASE WHEN coalesce(v_ssl, FALSE) THEN 0.0 ELSE 0.5 END AS raw_points,
            CASE WHEN score < {r.dampener_threshold} THEN raw_points * 0.5 ELSE raw_points END AS points
            FROM v_flags)""",
        f"""verdict AS (SELECT *,
            round(CASE gate WHEN 'critical' THEN 10.0 WHEN 'blocklist' THEN 9.0 WHEN 'heuristic' THEN points
                  ELSE score * 3.0 END, 2) AS risk_score,
            CASE WHEN gate IN ('critical', 'blocklist') THEN 'PHISHING' WHEN gate IN ('trusted', 'safe') THEN 'SAFE'
                 WHEN gate = 'unscored' THEN 'UNSCORED'
                 WHEN points > {r.t_phishing} THEN 'PHISHING' WHEN points >= {r.t_suspicious} THEN 'SUSPICIOUS'
                 ELSE 'SAFE' END AS result,
            array_to_string(CASE
                WHEN gate = 'critical' THEN [override]
                WHEN gate = 'blocklist' THEN [{quote(R.REASON_BLOCKLIST)} ||
                    CASE WHEN tier = 'trusted' THEN {quote(R.REASON_BLOCKLIST_SHARED)} ELSE '' END]
                WHEN gate IN ('trusted', 'safe') THEN list_filter([override, {quote(R.REASON_ML_LOW)}],
                    lambda x: x IS NOT NULL)
                WHEN gate = 'unscored' THEN [{quote(R.REASON_UNSCORED)}]
                ELSE list_filter([override,
                    CASE WHEN score > 0.7 THEN {quote(R.REASON_ML_HIGH)}
                         WHEN score > 0.4 THEN {quote(R.REASON_ML_MODERATE)} END,
                    CASE WHEN brand_flag THEN {quote(R.REASON_BRAND)} END,
                    'Typo-squatting on ''' || typo_b || '''',
                    'Subdomain trick on ''' || sub_b || '''',
                    CASE WHEN ip_flag THEN {quote(R.REASON_IP)} END,
                    CASE WHEN keyword_flag THEN {quote(R.REASON_KEYWORD)} END,
                    CASE WHEN young THEN 'Domain only ' || v_age || ' days old' END,
                    CASE WHEN NOT coalesce(v_ssl, FALSE) THEN {quote(R.REASON_NO_SSL)} END,
                    CASE WHEN score < {r.dampener_threshold} THEN {quote(R.REASON_DAMPENED)} END],
                    lambda x: x IS NOT NULL) END, '|') AS reasons,
            CASE WHEN gate IN ('critical', 'blocklist', 'heuristic') THEN v_age ELSE -1 END AS domain_age_days,
            CASE WHEN gate IN ('critical', 'blocklist', 'heuristic') THEN v_ssl END AS ssl_valid
            FROM v_gate WHERE norm <> '')""",
    ]
