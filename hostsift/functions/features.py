"""The 22-number URL feature vector, one narrow stage per table.

Order of the vector:

 0 length/100   1 dots        2 hyphens     3 slashes     4 digits   5 entropy
 6 keywords     7 brand ratio 8 brand spoof 9 8 with 6    10 dotted quad
11 '@' in authority  12 ... with a dot after it  13 path segments
14 hyphen in domain  15 subdomain labels  16 suspicious TLD  17 loopback text
18 keyword tokens in host  19 hyphens in host  20 punycode  21 non-ASCII host
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostsift.functions import brands as B
from hostsift.functions.idn import with_idn
from hostsift.functions.literals import literal_array
from hostsift.functions.urls import count_char, ensure_scheme, label_count, netloc, py_strip, second_last_label, unparsable, url_path
from hostsift.rules import DEFAULT_RULES, RuleSet

FEATURE_NAMES = (
    "length", "dots", "hyphens", "slashes", "digits", "entropy", "keywords", "brand_similarity", "brand_spoof",
    "brand_with_keyword", "dotted_quad", "authority_at", "authority_at_dot", "path_segments", "domain_hyphen",
    "subdomain_labels", "suspicious_tld", "loopback_text", "host_keywords", "host_hyphens", "punycode",
    "non_ascii_host",
)


def feature_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add the parsed parts every feature reads: ``f_url``, ``f_authority``, ``f_host``..."""
    lowered = F.translate(py_strip(F.lower(F.coalesce(F.col(url_col), F.lit("")))), "[]", "")
    host = F.substring_index(F.substring_index(F.col("f_authority"), "@", -1), ":", 1)
    return (
        df.withColumn("f_url", ensure_scheme(lowered))
        .withColumn("f_authority", netloc(F.col("f_url")))
        .withColumn("f_host", F.regexp_replace(host, r"^www\.", ""))
        .withColumn("f_domain", second_last_label(F.col("f_host")))
    )


def entropy(text: Column) -> Column:
    """Shannon entropy in bits over the characters of a string, 0 when empty."""
    n = F.length(text).cast("double")
    counts = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda ch: (F.length(text) - F.length(F.replace(text, ch, F.lit("")))).cast("double"),
    )
    weighted = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * F.log2(c))
    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(F.log2(n) - weighted / n)


def _flag(c: Column) -> Column:
    return c.cast("int")


def lexical(df: DataFrame) -> DataFrame:
    u = F.col("f_url")
    digits = F.length(u) - F.length(F.translate(u, "0123456789", ""))
    return df.withColumns(
        {
            "length": F.length(u) / 100,
            "dots": count_char(u, "."),
            "hyphens": count_char(u, "-"),
            "slashes": count_char(u, "/"),
            "digits": digits,
        }
    )


def keywords(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    tokens = F.split(F.col("f_host"), r"[.\-]")
    listed = literal_array(rules.keywords)
    return df.withColumns(
        {
            "keywords": B.keyword_count("f_url", rules),
            "host_keywords": F.size(F.filter(tokens, lambda t: F.array_contains(listed, t))),
        }
    )


def structure(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    u, authority, host, domain = (F.col(c) for c in ("f_url", "f_authority", "f_host", "f_domain"))
    labels = label_count(host)
    front = F.substring(host, F.lit(1), F.length(host) - F.length(F.substring_index(host, ".", -2)) - 1)
    return df.withColumns(
        {
            "dotted_quad": _flag(u.rlike(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")),
            "authority_at": _flag(authority.contains("@")),
            "authority_at_dot": _flag(authority.contains("@") & F.substring_index(authority, "@", -1).contains(".")),
            "path_segments": F.regexp_count(url_path(u), F.lit("[^/]+")),
            "domain_hyphen": _flag(domain.contains("-")),
            "subdomain_labels": F.when((labels > 2) & (front != ""), labels - 2).otherwise(F.lit(0)),
            "suspicious_tld": _flag(
                (labels > 1) & F.substring_index(host, ".", -1).isin(*rules.suspicious_tlds)
            ),
            "loopback_text": _flag(u.contains("localhost") | u.contains("127.0.0.1")),
        }
    )


def host_signals(df: DataFrame) -> DataFrame:
    """Needs ``host_non_ascii`` of :func:`hostsift.functions.idn.with_idn`."""
    return df.withColumns(
        {
            "host_hyphens": count_char(F.col("f_host"), "-"),
            "punycode": _flag(F.col("f_host").contains("xn--")),
            "non_ascii_host": _flag(F.col("host_non_ascii")),
        }
    )


def brand_similarity(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Needs ``host_skeleton`` and ``keywords``; adds features 7, 8 and 9."""
    spoof = F.exists(F.col("_hits"), lambda h: h["brand"] != F.col("f_domain"))
    return (
        df.withColumn("_hits", B.brand_hits(B.host_pieces(F.col("f_host"), F.col("host_skeleton")), rules))
        .withColumn(
            "brand_similarity",
            F.coalesce(F.array_max(F.transform(F.col("_hits"), lambda h: h["similarity"])), F.lit(0.0)),
        )
        .withColumn("brand_spoof", _flag(spoof))
        .withColumn("brand_with_keyword", _flag(spoof & (F.col("keywords") > 0)))
        .drop("_hits")
    )


def with_features(df: DataFrame, url_col: str = "url", rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Add all 22 named feature columns (plus the ``f_*`` parts and IDN columns)."""
    out = with_idn(feature_parts(df, url_col), "f_host")
    out = structure(keywords(lexical(out), rules), rules)
    out = out.withColumn("entropy", entropy(F.col("f_url")))
    return brand_similarity(host_signals(out), rules)


def feature_vector(df: DataFrame, url_col: str = "url", rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Add ``features``: 22 doubles in fixed order; a NULL URL, or one that parsers refuse, gives 22 zeros."""
    out = with_features(df, url_col, rules)
    numbers = F.expr("array(" + ", ".join(f"coalesce(cast({n} AS double), 0D)" for n in FEATURE_NAMES) + ")")
    zeros = F.expr(f"array_repeat(0D, {len(FEATURE_NAMES)})")
    vector = F.when(F.col(url_col).isNotNull() & ~unparsable(F.col("f_authority")), numbers).otherwise(zeros)
    return out.withColumn("features", vector).select(*df.columns, "features")
