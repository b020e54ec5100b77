"""The verdict ladder: allowlist, blocklist, structure, model and heuristics.

All gates are columns of one narrow pass; the blocklist lookup is the only join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostsift import rules as R
from hostsift.functions.brands import any_keyword, brand_in_domain, on_shared_hosting, subdomain_brand, typo_brand
from hostsift.functions.features import with_features
from hostsift.functions.numbers import round_score
from hostsift.functions.urls import has_text, host_is_ip, host_is_loopback, normalize_url, parse_host, registrable_root_of_host
from hostsift.operators.joins import blocklist_match
from hostsift.operators.predicates import keyword_gate, structural_override
from hostsift.rules import DEFAULT_RULES, RuleSet


#: Result of rows that have no score and that no rule decides.
UNSCORED = "UNSCORED"


def parsed(df: DataFrame, url: str = "url", rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Add ``norm``, ``host`` and ``root``; whole URLs are read, so keys that differ late still differ."""
    return (
        df.withColumn("norm", normalize_url(F.col(url)))
        .withColumn("host", parse_host(F.col("norm")))
        .withColumn("root", registrable_root_of_host(F.col("host")))
    )


def with_tier(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Add ``tier``, which depends on the URL alone; reads norm, host and root.

    Strict order: loopback, trusted root, structural override, model.
    """
    featured = with_features(df, "norm", rules)
    tier = (
        F.when(host_is_loopback(F.col("host")), "localhost")
        .when(F.col("root").isin(*rules.trusted_roots), "trusted")
        .when(structural_override(F.col("host")), "critical")
        .otherwise("model")
    )
    return featured.withColumn("tier", tier).select(*df.columns, "tier")


def with_decision(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Add ``pred``, ``score`` and ``override``; reads tier and prob."""
    safe = F.col("tier").isin("localhost", "trusted")
    pred = F.when(safe, 0).when(F.col("tier") == "critical", 1)
    score = F.when(safe, F.lit(0.001)).when(F.col("tier") == "critical", F.lit(0.999))
    reason = (
        F.when(F.col("tier") == "localhost", R.REASON_LOCALHOST)
        .when(F.col("tier") == "trusted", R.REASON_TRUSTED)
        .when(F.col("tier") == "critical", R.REASON_CRITICAL)
    )
    return df.withColumns(
        {
            "pred": pred.otherwise((F.col("prob") > rules.ml_decision_threshold).cast("int")),
            "score": score.otherwise(F.col("prob")),
            "override": reason,
        }
    )


def override_tier(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Add ``tier``, ``pred``, ``score`` and ``override``; reads norm, host, root, prob."""
    return with_decision(with_tier(df, rules), rules)


def explain_tier(tiered: DataFrame) -> DataFrame:
    """Which layer decided, and why."""
    layer = (
        F.when(F.col("tier").isin("localhost", "trusted"), "ALLOWLIST")
        .when(F.col("tier") == "critical", "STRUCTURAL")
        .otherwise("MODEL")
    )
    why = F.coalesce(F.col("override"), F.lit("model score"))
    return tiered.withColumn("layer", layer).withColumn("why", why)


def url_flags(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Local signals that depend on the URL alone; reads norm and host."""
    return df.withColumns(
        {
            "brand_flag": brand_in_domain("host", rules),
            "typo_brand": typo_brand(F.col("host"), rules),
            "sub_brand": subdomain_brand(F.col("norm"), rules),
            "ip_flag": host_is_ip(F.col("host")),
            "shared_host": on_shared_hosting("host", rules),
        }
    )


def rule_flags(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The cheap local signals of the ladder; reads norm, host and score."""
    return url_flags(df, rules).withColumn("keyword_flag", keyword_gate("norm", F.col("score"), rules))


def gate_ladder(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Add ``gate``: which gate decides.  Reads tier, flags, blocklisted.

    A row without a score that no rule decides goes to ``unscored``: nothing says that it is safe.
    """
    trusted = F.col("tier") == "trusted"
    listed = F.col("blocklisted") & ((F.col("tier") == "model") | (trusted & F.col("shared_host")))
    quiet = ~F.col("brand_flag") & F.col("typo_brand").isNull() & F.col("sub_brand").isNull()
    confident = (F.col("pred") == 0) & (F.col("score") < rules.ml_safe_threshold) & quiet
    gate = (
        F.when(F.col("tier") == "critical", "critical")
        .when(listed, "blocklist")
        .when(trusted, "trusted")
        .when(F.col("score").isNull(), "unscored")
        .when(confident, "safe")
        .otherwise("heuristic")
    )
    return df.withColumn("gate", gate)


def _bump(flag: Column, weight: float) -> Column:
    return F.when(flag, F.lit(weight)).otherwise(F.lit(0.0))


def heuristic_score(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Add ``heuristic_points`` and ``heuristic_result``; reads the flags, age_days, ssl_valid."""
    points = (
        F.col("score") * 3
        + _bump(F.col("brand_flag"), rules.w_brand)
        + _bump(F.col("typo_brand").isNotNull(), rules.w_typo)
        + _bump(F.col("sub_brand").isNotNull(), rules.w_subdomain)
        + _bump(F.col("ip_flag"), rules.w_ip)
        + _bump(F.col("keyword_flag"), rules.w_keyword)
        + _bump(new_domain(rules), rules.w_new_domain)
        + _bump(no_tls(), rules.w_no_ssl)
    )
    damped = F.when(F.col("score") < rules.dampener_threshold, points * 0.5).otherwise(points)
    return df.withColumn("heuristic_points", damped).withColumn(
        "heuristic_result", result_of(F.col("heuristic_points"), rules)
    )


def new_domain(rules: RuleSet = DEFAULT_RULES) -> Column:
    return (F.col("age_days") != -1) & (F.col("age_days") < rules.new_domain_max_age_days)


def no_tls() -> Column:
    """No valid certificate is known; an unknown state counts as none."""
    return ~F.coalesce(F.col("ssl_valid"), F.lit(False))


def result_of(points: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    return (
        F.when(points.isNull(), UNSCORED).when(points > rules.t_phishing, "PHISHING").when(points >= rules.t_suspicious, "SUSPICIOUS").otherwise("SAFE")
    )


def _reasons(rules: RuleSet) -> Column:
    def when(flag: Column, text: Column | str) -> Column:
        return F.when(flag, text if isinstance(text, Column) else F.lit(text))

    def listed(*items: Column) -> Column:
        return F.array_compact(F.array(*items))

    shared = F.when(F.col("tier") == "trusted", F.lit(R.REASON_BLOCKLIST_SHARED)).otherwise(F.lit(""))
    score = F.col("score")
    heuristics = listed(
        F.col("override"),
        F.when(score > 0.7, R.REASON_ML_HIGH).when(score > 0.4, R.REASON_ML_MODERATE),
        when(F.col("brand_flag"), R.REASON_BRAND),
        when(F.col("typo_brand").isNotNull(), F.concat(F.lit("Typo-squatting on '"), "typo_brand", F.lit("'"))),
        when(F.col("sub_brand").isNotNull(), F.concat(F.lit("Subdomain trick on '"), "sub_brand", F.lit("'"))),
        when(F.col("ip_flag"), R.REASON_IP),
        when(F.col("keyword_flag"), R.REASON_KEYWORD),
        when(
            new_domain(rules), F.concat(F.lit("Domain only "), F.col("age_days").cast("string"), F.lit(" days old"))
        ),
        when(no_tls(), R.REASON_NO_SSL),
        when(score < rules.dampener_threshold, R.REASON_DAMPENED),
    )
    return (
        F.when(F.col("gate") == "critical", listed(F.col("override")))
        .when(F.col("gate") == "blocklist", listed(F.concat(F.lit(R.REASON_BLOCKLIST), shared)))
        .when(F.col("gate").isin("trusted", "safe"), listed(F.col("override"), F.lit(R.REASON_ML_LOW)))
        .when(F.col("gate") == "unscored", listed(F.lit(R.REASON_UNSCORED)))
        .otherwise(heuristics)
    )


def verdict_record(df: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Add the verdict contract: input, domain, scores, result, reasons and meta.

    Metadata is reported only by the gates that look it up.
    """
    looked_up = F.col("gate").isin("critical", "blocklist", "heuristic")
    points = (
        F.when(F.col("gate") == "critical", F.lit(10.0))
        .when(F.col("gate") == "blocklist", F.lit(9.0))
        .when(F.col("gate").isin("trusted", "safe"), F.col("score") * 3)
        .otherwise(F.col("heuristic_points"))
    )
    result = (
        F.when(F.col("gate").isin("critical", "blocklist"), "PHISHING")
        .when(F.col("gate").isin("trusted", "safe"), "SAFE")
        .when(F.col("gate") == "unscored", UNSCORED)
        .otherwise(F.col("heuristic_result"))
    )
    return df.withColumns(
        {
            "scan_type": F.lit("url"),
            "input": F.col("norm"),
            "domain": F.col("host"),
            "ml_probability": round_score(F.col("score"), 4),
            "risk_score": round_score(points, 2),
            "result": result,
            "reasons": _reasons(rules),
            "meta": F.struct(
                F.when(looked_up, F.col("age_days")).otherwise(F.lit(-1)).alias("domain_age_days"),
                F.when(looked_up, F.col("ssl_valid")).alias("ssl_valid"),
            ),
        }
    )


def verdicts(
    scored: DataFrame, blocklist: DataFrame, rules: RuleSet = DEFAULT_RULES, repeated: bool = False
) -> DataFrame:
    """Full ladder over a table with ``url`` and ``prob``; empty URLs are dropped.

    ``repeated`` is for batch tables that hold the same URLs again and again, such as logs: whatever follows from the URL is
    computed once for each distinct one and joined back. Results are the same.

    ``age_days`` and ``ssl_valid`` are used when present; what wasn't looked up is
    an unknown age and no valid TLS.
    """
    table = scored
    if "age_days" not in table.columns:
        table = table.withColumn("age_days", F.lit(-1))
    if "ssl_valid" not in table.columns:
        table = table.withColumn("ssl_valid", F.lit(False))
    table = table.filter(has_text(F.col("url")))
    if repeated:
        urls = parsed(table.select("url").distinct(), "url", rules)
        facts = url_flags(with_tier(blocklist_match(urls, blocklist), rules), rules)
        table = with_decision(table.join(facts, "url"), rules)
        table = table.withColumn("keyword_flag", keyword_gate("norm", F.col("score"), rules))
    else:
        table = blocklist_match(parsed(table, "url", rules), blocklist)
        table = rule_flags(override_tier(table, rules), rules)
    return verdict_record(heuristic_score(gate_ladder(table, rules), rules), rules)


GATES = (0.40, 0.45, 0.50, 0.55, 0.60)


def with_weighted_ladder(scored: DataFrame, blocklist: DataFrame, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """The older ladder, prepared for a sweep over keyword gates.

    Adds ``fixed`` (a verdict no gate can change, or NULL), ``points`` without
    the keyword bump, ``has_keyword`` and ``damped``.
    """
    table = blocklist_match(parsed(scored, "url", rules), blocklist)
    table = with_features(table, "norm", rules)
    host, prob = F.col("host"), F.col("prob")
    loopback = F.col("norm").contains("localhost") | F.col("norm").contains("127.0.0.1")
    spoof = (F.col("brand_spoof") == 1) & (
        (F.col("brand_with_keyword") == 1)
        | (F.col("suspicious_tld") == 1)
        | (F.col("punycode") == 1)
        | (F.col("non_ascii_host") == 1)
    )
    brand, typo, sub = brand_in_domain("host", rules), typo_brand(host, rules), subdomain_brand(F.col("norm"), rules)
    table = table.withColumns({"_brand": brand, "_typo": typo.isNotNull(), "_sub": sub.isNotNull()})
    quiet = ~(F.col("_brand") | F.col("_typo") | F.col("_sub"))
    fixed = (
        F.when(loopback | F.col("root").isin(*rules.trusted_roots), "SAFE")
        .when((F.col("dotted_quad") == 1) | (F.col("authority_at") == 1) | spoof, "PHISHING")
        .when((prob <= rules.ml_decision_threshold) & (prob < rules.ml_safe_threshold) & quiet, "SAFE")
    )
    points = (
        prob * 3
        + _bump(F.col("_brand"), rules.w_brand)
        + _bump(F.col("_typo"), rules.w_typo)
        + _bump(F.col("_sub"), rules.w_subdomain)
        + _bump(F.col("dotted_quad") == 1, rules.w_ip)
        + _bump(F.col("blocklisted"), rules.w_phishtank)
    )
    return table.withColumns(
        {
            "fixed": fixed,
            "points": points,
            "has_keyword": any_keyword("lower(norm)", rules),
            "damped": prob < rules.dampener_threshold,
        }
    ).select(*scored.columns, "norm", "fixed", "points", "has_keyword", "damped")


def flagged_at(gate: float, rules: RuleSet = DEFAULT_RULES) -> Column:
    """Is the row of :func:`with_weighted_ladder` flagged at this keyword gate?"""
    bumped = F.col("points") + _bump(F.col("has_keyword") & (F.col("prob") >= gate), rules.w_keyword)
    final = F.when(F.col("damped"), bumped * 0.5).otherwise(bumped)
    return F.when(F.col("fixed").isNotNull(), F.col("fixed") != "SAFE").otherwise(final >= rules.t_suspicious)


def keyword_gate_sweep(ladder: DataFrame, gates: tuple[float, ...] = GATES, rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Recall and false positives per gate, change against the first, flips to safe."""
    legit, phish = F.col("label") == 0, F.col("label") == 1
    affected = F.col("has_keyword") & (F.col("prob") >= 0.40) & (F.col("prob") < 0.60)
    base = flagged_at(gates[0], rules)
    counts = [
        F.count_if(legit).alias("_n0"),
        F.count_if(phish).alias("_n1"),
        F.count_if(affected & phish).alias("_a1"),
        F.count_if(affected & legit).alias("_a0"),
    ]
    for i, gate in enumerate(gates):
        now = flagged_at(gate, rules)
        counts += [
            F.count_if(phish & now).alias(f"_r{i}"),
            F.count_if(legit & now).alias(f"_f{i}"),
            F.count_if(phish & affected & base & ~now).alias(f"_l{i}"),
            F.count_if(legit & affected & base & ~now).alias(f"_x{i}"),
        ]

    def pct(part: str, whole: str) -> Column:
        return F.coalesce(F.try_divide(F.col(part) * 100.0, F.col(whole)), F.lit(0.0))

    lines = F.array(
        *[
            F.struct(
                F.lit(float(gate)).alias("gate"),
                F.round(pct(f"_r{i}", "_n1"), 4).alias("recall_pct"),
                F.round(pct(f"_f{i}", "_n0"), 4).alias("fp_pct"),
                F.round(pct(f"_r{i}", "_n1") - pct("_r0", "_n1"), 4).alias("recall_change"),
                F.round(pct(f"_f{i}", "_n0") - pct("_f0", "_n0"), 4).alias("fp_change"),
                F.col("_a1").alias("phishing_affected"),
                F.col("_a0").alias("legit_affected"),
                F.col(f"_l{i}").alias("phishing_lost"),
                F.col(f"_x{i}").alias("legit_fixed"),
            )
            for i, gate in enumerate(gates)
        ]
    )
    return ladder.agg(*counts).select(F.explode(lines).alias("r")).select("r.*")
