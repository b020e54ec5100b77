"""Scan-log KPIs and model-evaluation reports.

Reports over scored tables read ``label`` (0/1) and ``prob``.  Sweeps over many
thresholds are one pass of conditional counts; no row is multiplied.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostsift.operators.selection import exact_quantiles

SWEEP_THRESHOLDS = (0.30, 0.40, 0.50, 0.55, 0.60, 0.61, 0.62, 0.63, 0.64, 0.65, 0.70, 0.75, 0.80)
PERCENTILES = (0.10, 0.25, 0.50, 0.75, 0.90)


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 when there is nothing."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def scan_kpis(log: DataFrame) -> DataFrame:
    total = F.count(F.lit(1))
    phishing = F.count_if(F.col("result") == "PHISHING")
    return log.agg(
        total.alias("total_scans"),
        phishing.alias("phishing_count"),
        F.count_if(F.col("result") == "SUSPICIOUS").alias("suspicious_count"),
        F.count_if(F.col("result") == "SAFE").alias("safe_count"),
        F.count_if(F.col("type") == "url").alias("url_scans"),
        F.round(percent(phishing, total), 2).alias("detection_rate"),
        F.round(F.coalesce(F.avg("response_time"), F.lit(0.0)) * 1000, 1).alias("avg_response_time_ms"),
    )


def daily_breakdown(log: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    """Scans and detections per day since midnight ``days`` days before ``as_of``."""
    since = F.date_sub(F.to_date(as_of), days)
    recent = log.filter(F.col("ts") >= since.cast("timestamp"))
    return recent.groupBy(F.to_date("ts").alias("day")).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("result") == "PHISHING").alias("phishing")
    )


def top_threats(log: DataFrame, n: int = 10) -> DataFrame:
    flagged = log.filter(F.col("result").isin("PHISHING", "SUSPICIOUS") & (F.col("type") == "url"))
    counts = flagged.groupBy("content").agg(F.count(F.lit(1)).alias("cnt"))
    return counts.orderBy(F.desc("cnt"), "content").limit(n)


def repeat_threat_rate(log: DataFrame, domain: str = "domain") -> DataFrame:
    """Share of flagged domains that were flagged more than once."""
    flagged = log.filter(F.col("result").isin("PHISHING", "SUSPICIOUS"))
    per_domain = flagged.groupBy(domain).agg(F.count(F.lit(1)).alias("_n"))
    repeated = F.count_if(F.col("_n") > 1)
    return per_domain.agg(
        F.count(F.lit(1)).alias("flagged_domains"),
        repeated.alias("repeated_domains"),
        F.round(percent(repeated, F.count(F.lit(1))), 2).alias("repeat_threat_rate"),
    )


def class_distribution(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("rows"))


def pathed_fraction_by_class(df: DataFrame, pathed: Column) -> DataFrame:
    return df.groupBy("type").agg(
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(pathed.cast("double")) * 100, 4).alias("pathed_pct"),
    )


def distinct_roots(df: DataFrame, by: str = "type", root: str = "root", approximate: bool = False) -> DataFrame:
    counted = F.approx_count_distinct(root) if approximate else F.count_distinct(root)
    return df.groupBy(by).agg(counted.alias("roots"))


def _cell(label: int, positive: bool) -> Column:
    hit = F.col("pred") == (1 if positive else 0)
    return F.count_if((F.col("label") == label) & hit)


def with_prediction(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    return df.withColumn("pred", (F.col("prob") > threshold).cast("int"))


def confusion_matrix(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        _cell(0, False).alias("tn"), _cell(0, True).alias("fp"), _cell(1, False).alias("fn"), _cell(1, True).alias("tp")
    )


def classification_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class precision, recall, F1 and support, then accuracy and the two averages."""
    m = confusion_matrix(df, by)
    tn, fp, fn, tp = (F.col(c).cast("double") for c in ("tn", "fp", "fn", "tp"))

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    def scores(hit: Column, wrong: Column, missed: Column) -> list[Column]:
        return [ratio(hit, hit + wrong), ratio(hit, hit + missed), ratio(hit * 2, hit * 2 + wrong + missed)]

    neg, pos = scores(tn, fn, fp), scores(tp, fp, fn)
    n_neg, n_pos, n = tn + fp, tp + fn, tn + fp + fn + tp

    def row(name: str, values: Sequence[Column], support: Column) -> Column:
        named = [v.alias(a) for v, a in zip(values, ("precision", "recall", "f1"))]
        return F.struct(F.lit(name).alias("row"), *named, support.cast("bigint").alias("support"))

    accuracy = ratio(tn + tp, n)
    lines = F.array(
        row("legitimate", neg, n_neg),
        row("phishing", pos, n_pos),
        row("accuracy", [accuracy, accuracy, accuracy], n),
        row("macro avg", [(a + b) / 2 for a, b in zip(neg, pos)], n),
        row("weighted avg", [ratio(a * n_neg + b * n_pos, n) for a, b in zip(neg, pos)], n),
    )
    out = m.select(*by, F.explode(lines).alias("r")).select(*by, "r.*")
    return out.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


def fp_rate(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    legit = df.filter(F.col("label") == 0)
    flagged = F.count_if(F.col("prob") > threshold)
    total = F.count(F.lit(1))
    return legit.agg(
        total.alias("legit"), flagged.alias("false_positives"), F.round(percent(flagged, total), 4).alias("fp_pct")
    )


def threshold_sweep(df: DataFrame, thresholds: Sequence[float] = SWEEP_THRESHOLDS) -> DataFrame:
    """False-positive and recall percentages at each threshold."""
    # One pass of conditional counts, stated as text: two per threshold.
    counts = [F.expr(f"count_if(label = {label})").alias(f"_n{label}") for label in (0, 1)]
    for i, t in enumerate(thresholds):
        counts += [
            F.expr(f"count_if(label = {label} AND prob > {float(t)!r}D)").alias(f"_c{i}_{label}") for label in (0, 1)
        ]

    def share(i: int, label: int) -> str:
        return f"round(coalesce(try_divide(_c{i}_{label} * 100D, _n{label}), 0D), 4)"

    lines = ", ".join(
        f"named_struct('threshold', {float(t)!r}D, 'fp_pct', {share(i, 0)}, 'recall_pct', {share(i, 1)})"
        for i, t in enumerate(thresholds)
    )
    return df.agg(*counts).select(F.expr(f"inline(array({lines}))"))


GRID_START, GRID_STEP, GRID_STOP = 300, 5, 950
STEPS = (GRID_STOP - GRID_START) // GRID_STEP + 1


def grid_bucket(prob: Column) -> Column:
    """How many thresholds of the 0.300 ... 0.950 grid, step 0.005, lie below a score: 132 buckets."""
    g = F.greatest(F.lit(0), F.least(F.lit(STEPS), F.floor((prob * 1000 - GRID_START) / GRID_STEP))).cast("int")

    def above(i: Column) -> Column:
        # Exact comparison around the guess: the division may be off by one.
        t = (i * GRID_STEP + GRID_START) / 1000
        return (i.between(0, STEPS - 1) & (prob > t)).cast("int")

    return F.greatest(F.lit(0), g - 1) + above(g - 1) + above(g) + above(g + 1)


def grid_rates(df: DataFrame) -> DataFrame:
    """False-positive and recall percentages at every threshold of the grid, from one scan."""
    counted = (
        df.withColumn("_bucket", grid_bucket(F.col("prob")))
        .groupBy("_bucket")
        .agg(F.count_if(F.col("label") == 0).alias("_l"), F.count_if(F.col("label") == 1).alias("_p"))
    )
    return rates_of_buckets(counted)


def rates_of_buckets(counted: DataFrame) -> DataFrame:
    """The rates from ``_bucket``, and its legitimate (``_l``) and phishing (``_p``) rows; a bucket can have several lines."""
    thresholds = F.sequence(F.lit(0), F.lit(STEPS - 1))
    spread = counted.select("_bucket", "_l", "_p", F.explode(thresholds).alias("_i"))
    passed = F.col("_bucket") > F.col("_i")
    return (
        spread.groupBy("_i")
        .agg(
            F.sum(F.when(passed, F.col("_l")).otherwise(0)).alias("_fp"),
            F.sum(F.when(passed, F.col("_p")).otherwise(0)).alias("_tp"),
            F.sum("_l").alias("_n0"),
            F.sum("_p").alias("_n1"),
        )
        .select(
            (F.col("_i") * GRID_STEP + GRID_START).alias("threshold_milli"),
            percent(F.col("_fp"), F.col("_n0")).alias("fp_pct"),
            percent(F.col("_tp"), F.col("_n1")).alias("recall_pct"),
        )
    )


def equal_fp_operating_point(df: DataFrame, max_fp_pct: float = 9.70) -> DataFrame:
    """Lowest grid threshold whose false-positive rate is within the gate."""
    return operating_point_of(grid_rates(df), max_fp_pct)


def operating_point_of(rates: DataFrame, max_fp_pct: float = 9.70) -> DataFrame:
    """Of the rates on the grid."""
    passing = rates.filter(F.col("fp_pct") <= max_fp_pct)
    best = passing.agg(F.min(F.struct("threshold_milli", "fp_pct", "recall_pct")).alias("b"))
    return best.filter(F.col("b").isNotNull()).select(
        F.col("b.threshold_milli").cast("int").alias("threshold_milli"),
        F.round("b.fp_pct", 4).alias("fp_pct"),
        F.round("b.recall_pct", 4).alias("recall_pct"),
    )


def model_gate(candidate: DataFrame, shipped: DataFrame, max_fp_pct: float = 9.70) -> DataFrame:
    """Does the candidate recall more than the shipped model at equal false positives?"""
    sides = [
        equal_fp_operating_point(df, max_fp_pct).withColumn("_side", F.lit(side))
        for side, df in (("candidate", candidate), ("shipped", shipped))
    ]

    def of(side: str, column: str) -> Column:
        return F.max(F.when(F.col("_side") == side, F.col(column)))

    both = sides[0].unionByName(sides[1]).agg(
        of("candidate", "threshold_milli").alias("candidate_threshold_milli"),
        of("candidate", "recall_pct").alias("candidate_recall_pct"),
        of("shipped", "threshold_milli").alias("shipped_threshold_milli"),
        of("shipped", "recall_pct").alias("shipped_recall_pct"),
    )
    wins = F.col("candidate_recall_pct") > F.coalesce(F.col("shipped_recall_pct"), F.lit(-1.0))
    return both.withColumn("ships", F.coalesce(wins, F.lit(False)))


def recall_by_slice(
    df: DataFrame, by: Sequence[str] = (), thresholds: Sequence[float] = (0.60, 0.50)
) -> DataFrame:
    """Hits, denominator and recall of ``all`` and ``novel`` rows at each threshold."""
    counts = [F.count(F.lit(1)).alias("_n_all"), F.count_if("novel").alias("_n_novel")]
    for i, t in enumerate(thresholds):
        hit = F.col("prob") > t
        counts += [F.count_if(hit).alias(f"_h{i}_all"), F.count_if(hit & F.col("novel")).alias(f"_h{i}_novel")]
    lines = F.array(
        *[
            F.struct(
                F.lit(part).alias("slice"),
                F.lit(float(t)).alias("threshold"),
                F.col(f"_h{i}_{part}").alias("hits"),
                F.col(f"_n_{part}").alias("total"),
                F.round(percent(F.col(f"_h{i}_{part}"), F.col(f"_n_{part}")), 4).alias("recall_pct"),
            )
            for part in ("all", "novel")
            for i, t in enumerate(thresholds)
        ]
    )
    return df.groupBy(*by).agg(*counts).select(*by, F.explode(lines).alias("r")).select(*by, "r.*")


def slice_composition(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and shares of novel, pathed and trusted-root rows (boolean columns)."""
    total = F.count(F.lit(1))
    cells = [total.alias("total")]
    for name in ("novel", "pathed", "trusted"):
        cells += [F.count_if(name).alias(name), F.round(percent(F.count_if(name), total), 4).alias(f"{name}_pct")]
    return df.groupBy(*by).agg(*cells)


def prob_percentiles(df: DataFrame, by: Sequence[str] = (), value: str = "prob") -> DataFrame:
    """p10 ... p90 by linear interpolation, one row per percentile, and the mean."""
    quantiles = exact_quantiles(df, value, PERCENTILES, by).select(
        *by, F.concat(F.lit("p"), F.round(F.col("q") * 100).cast("int").cast("string")).alias("stat"), "value"
    )
    mean = df.groupBy(*by).agg(F.avg(value).alias("value")).select(*by, F.lit("mean").alias("stat"), "value")
    return quantiles.unionByName(mean).withColumn("value", F.round("value", 6))


def prob_histogram(df: DataFrame) -> DataFrame:
    edges = ((0.0, 0.25), (0.25, 0.5), (0.5, 0.75), (0.75, 1.01))
    bucket = F.when(F.lit(False), F.lit(""))
    for lo, hi in edges:
        bucket = bucket.when((F.col("prob") >= lo) & (F.col("prob") < hi), F.lit(f"[{lo:.2f},{hi:.2f})"))
    counted = df.withColumn("bucket", bucket).filter(F.col("bucket").isNotNull())
    total = F.sum("rows").over(Window.partitionBy())
    grouped = counted.groupBy("bucket").agg(F.count(F.lit(1)).alias("rows"))  # four rows at most
    return grouped.withColumn("pct", F.round(percent(F.col("rows"), total), 4))


def detection_rate_two_views(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Detection by the full tier order (``pred``) and by the model score alone."""
    total, full, model = F.count(F.lit(1)), F.count_if(F.col("pred") == 1), F.count_if(F.col("prob") > threshold)
    return df.agg(
        total.alias("total"),
        full.alias("full_hits"),
        F.round(percent(full, total), 4).alias("full_pct"),
        model.alias("model_hits"),
        F.round(percent(model, total), 4).alias("model_pct"),
    )


def signal_profile(meta: DataFrame, by: str = "type") -> DataFrame:
    """Per class: lookup success, DNS, age buckets and medians of stored metadata."""
    live = F.col("age_days") >= 0
    n, n_live, n_cert = F.count(F.lit(1)), F.count_if(live), F.count("cert_age_days")
    fresh, old = F.count_if(live & (F.col("age_days") < 365)), F.count_if(F.col("age_days") >= 1095)
    base = meta.groupBy(by).agg(
        n.alias("n"),
        F.round(percent(n_live, n), 4).alias("lookup_pct"),
        F.round(percent(n - n_live, n), 4).alias("fail_pct"),
        F.round(percent(F.count_if("dns_ok"), n), 4).alias("dns_pct"),
        F.round(percent(fresh, n_live), 4).alias("fresh_pct"),
        F.round(percent(n_live - fresh - old, n_live), 4).alias("mid_pct"),
        F.round(percent(old, n_live), 4).alias("old_pct"),
        F.round(percent(n_cert, n), 4).alias("cert_pct"),
    )

    def median(column: str, name: str, rows: DataFrame) -> DataFrame:
        return exact_quantiles(rows, column, (0.5,), [by], 0.0, 16384.0, 16384).select(by, F.col("value").alias(name))

    out = base.join(median("age_days", "median_age", meta.filter(live)), by, "left")
    return out.join(median("cert_age_days", "median_cert_age", meta), by, "left")


def signal_verdict(profile: DataFrame, by: str = "type") -> DataFrame:
    """Is domain age a usable signal?  One row from the two class rows."""

    def of(kind: str, column: str) -> Column:
        return F.max(F.when(F.col(by) == kind, F.col(column)))

    sides = profile.agg(
        (of("phishing", "fail_pct") - of("legitimate", "fail_pct")).alias("fail_gap"),
        of("phishing", "fresh_pct").alias("phishing_fresh_pct"),
        of("phishing", "median_age").alias("phishing_median_age"),
    )
    reject = (F.col("phishing_fresh_pct") < 30) & (F.col("phishing_median_age") > 3 * 365)
    verdict = F.when(reject, "reject").when(F.col("fail_gap") > 25, "partial").otherwise("viable")
    return sides.withColumn("fail_gap", F.round("fail_gap", 4)).withColumn("verdict", verdict)


def path_flip_report(df: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Per host: bare form safe, yet some pathed form flagged?  Reads host, bare, prob."""
    bare = F.max(F.when(F.col("bare"), F.col("prob")))
    worst = F.max(F.when(~F.col("bare"), F.col("prob")))
    flips = (bare <= threshold) & (worst > threshold)
    return df.groupBy("host").agg(
        bare.alias("bare_prob"), worst.alias("worst_prob"), F.coalesce(flips, F.lit(False)).alias("flips")
    )


def path_flip_summary(report: DataFrame) -> DataFrame:
    return report.agg(
        F.count(F.lit(1)).alias("hosts"),
        F.count_if("flips").alias("flipped"),
        F.max("worst_prob").alias("worst_prob"),
    )


def labelled_case_scorecard(df: DataFrame, bucket: str = "bucket", threshold: float = 0.5) -> DataFrame:
    """Correct, false-positive and false-negative counts per bucket of labelled cases."""
    flagged = (F.col("prob") > threshold).cast("int")
    right = F.count_if(flagged == F.col("label"))
    return df.groupBy(bucket).agg(
        F.count(F.lit(1)).alias("cases"),
        right.alias("correct"),
        F.count_if((flagged == 1) & (F.col("label") == 0)).alias("false_positives"),
        F.count_if((flagged == 0) & (F.col("label") == 1)).alias("false_negatives"),
        F.round(percent(right, F.count(F.lit(1))), 4).alias("accuracy_pct"),
    )


def decision_tier_counts(df: DataFrame, tier: str = "tier") -> DataFrame:
    return df.groupBy(tier).agg(F.count(F.lit(1)).alias("urls"))


def raw_vs_calibrated_report(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The classification report of ``raw_prob`` and ``prob`` side by side."""
    stages = F.explode(
        F.array(
            F.struct(F.lit("raw").alias("stage"), F.col("raw_prob").alias("prob")),
            F.struct(F.lit("calibrated").alias("stage"), F.col("prob").alias("prob")),
        )
    )
    long = df.select("label", stages.alias("s")).select("label", "s.stage", "s.prob")
    return classification_report(with_prediction(long, threshold), ["stage"])
