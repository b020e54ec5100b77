"""Model jobs (sections C8-C11, J, G24).

One model is trained per application on the whole corpus and shared by the
queries, with the operator's own sizes: full vocabularies, depth 7 and up to
400 rounds, as many as lower the loss on the calibrate slice.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostsift.functions.features import FEATURE_NAMES, feature_vector
from hostsift.functions.urls import normalize_url, registrable_root
from hostsift.operators import metrics as M
from hostsift.operators import sampling as Z
from hostsift.plans import model as L
from hostsift.session import scratch_path, staged
from registry.base import feature_ctes, h, hosted, parsed, query, sql_in
from registry.corpus import RULES, derived, with_duck
from registry.q_tables import TIERS, tiered

CHARS, WORDS = 3000, 1000

_MODELS: dict[tuple, tuple[PipelineModel, str]] = {}
_INPUTS: dict[tuple, DataFrame] = {}


def corpus(spark, sf) -> DataFrame:
    """Labelled corpus with model inputs and split, written once."""
    at = (spark.sparkContext.applicationId, sf)
    if at not in _INPUTS:
        table = derived(spark, sf, "fx_scored").select("url_id", "url", "type", "label", "source")
        table = table.withColumn("url", normalize_url(F.col("url"))).withColumn("root", registrable_root(F.col("url")))
        _INPUTS[at] = staged(L.model_inputs(Z.grouped_split(table)), "model-inputs")
    return _INPUTS[at]


def model(spark, sf, share: float = 1.0) -> PipelineModel:
    """Trained, calibrated, saved and loaded back; with a ``share``, the version that the first rounds of it make."""
    at = (spark.sparkContext.applicationId, sf, share)
    if at not in _MODELS:
        rows = corpus(spark, sf)
        calibrate = rows.filter("split = 'calibrate'")
        if share == 1:
            trees = L.train_boosted_trees(rows.filter("split = 'train'"), held_out=calibrate)
        else:
            whole = model(spark, sf)
            trees = L.with_rounds(whole, max(1, int(share * L.n_rounds(whole))))
        path = scratch_path(spark, "model")
        L.save_model(L.calibrate_isotonic(trees, calibrate), path)
        _MODELS[at] = (L.load_model(path), path)
    return _MODELS[at][0]


def plain(spark, sf) -> DataFrame:
    return corpus(spark, sf).select("url_id", "url", "type", "label", "source", "root", "split")


def entries(column: str, end: int | None = None) -> Column:
    """Non-zero entries of a vector column as an array, in order; with an ``end``, those before it. Zeros aren't filled in."""
    vector = F.unwrap_udt(column)
    values = vector["values"]
    if end is not None:
        places = F.coalesce(vector["indices"], F.sequence(F.lit(0), F.size(values) - 1))
        pairs = F.filter(F.arrays_zip(places.alias("at"), values.alias("x")), lambda p: p["at"] < end)
        values = F.transform(pairs, lambda p: p["x"])
    return F.filter(values, lambda x: x != 0)


def vector_summary(df: DataFrame, column: str) -> DataFrame:
    """Non-zero entries, their sum and the norm of a vector column, per row."""
    values = entries(column)
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + x * x)
    return df.select(
        "url_id", F.size(values).alias("terms"), F.round(total, 6).alias("total"), F.round(F.sqrt(square), 6).alias("norm")
    )


def tfidf_ctes(name: str, terms: str, size: int) -> list[str]:
    """CTE chain ending in ``name``: url_id, terms, sum and sum of squares of each row's normalised weights."""
    n = name
    return [
        f"{n}_tf AS (SELECT url_id, in_train, term, count(*) AS tf FROM (SELECT url_id, in_train, unnest({terms}) AS term "
        f"FROM texts) GROUP BY ALL)",
        f"""{n}_vocab AS (SELECT term, ln((1 + (SELECT count(*) FROM texts WHERE in_train = 1)) / (1 + count(*))) + 1 AS idf
            FROM {n}_tf WHERE in_train = 1 GROUP BY term ORDER BY sum(tf) DESC, term LIMIT {size})""",
        f"""{n}_sums AS (SELECT url_id, count(*) AS terms, sum(tf * idf) AS s, sqrt(sum(tf * idf * tf * idf)) AS l2
            FROM {n}_tf JOIN {n}_vocab USING (term) GROUP BY url_id)""",
        f"""{n} AS (SELECT t.url_id, coalesce(terms, 0) AS terms, coalesce(s / l2, 0) AS total,
            CASE WHEN terms > 0 THEN 1.0 ELSE 0.0 END AS norm FROM texts t LEFT JOIN {n}_sums USING (url_id))""",
    ]


CHAR_TERMS = "flatten([" + ", ".join(f"[substr(t, i, {n}) for i in range(1, length(t) - {n - 2})]" for n in (3, 4, 5)) + "])"
WORD_TERMS = r"regexp_extract_all(t, '[\p{L}\p{M}\p{N}_]{2,}')"
TEXTS = [
    parsed("mp", "fx_scored"),
    f"""texts AS (SELECT url_id, norm, lower(regexp_replace(norm, '^https?://', '')) AS t,
        CASE WHEN {h("root || 'split'")} % 1000 < 360 THEN 0 ELSE 1 END AS in_train FROM mp)""",
]
SUMMARY = "SELECT url_id, CAST(terms AS INT) AS terms, round(total, 6) AS total, round(norm, 6) AS norm FROM"


@query("tfidf_char", with_duck(("fx_scored",), *TEXTS, *tfidf_ctes("cb", CHAR_TERMS, CHARS), select=f"{SUMMARY} cb"))
def tfidf_char(spark, sf):
    rows = corpus(spark, sf)
    return vector_summary(L.tfidf_char(rows.filter("split = 'train'"), CHARS).transform(rows), "char_block")


@query("tfidf_word", with_duck(("fx_scored",), *TEXTS, *tfidf_ctes("wb", WORD_TERMS, WORDS), select=f"{SUMMARY} wb"))
def tfidf_word(spark, sf):
    rows = corpus(spark, sf)
    return vector_summary(L.tfidf_word(rows.filter("split = 'train'"), WORDS).transform(rows), "word_block")


CHAR_GRAMS = ", ".join(f"[substr(t, i, {n}) for i in range(1, length(t) - {n - 2})]" for n in (3, 4, 5))


@query(
    "char_ngram_counts",
    with_duck(
        ("fx_urls",), "x AS (SELECT lower(regexp_replace(url, '^https?://', '')) AS t FROM fx_urls)",
        select=f"""SELECT gram, count(*) AS n FROM (SELECT unnest(flatten([{CHAR_GRAMS}])) AS gram FROM x)
            GROUP BY gram ORDER BY n DESC, gram LIMIT 3000""",
    ),
)
def char_ngram_counts(spark, sf):
    """The vocabulary of the character block: the 3000 most frequent n-grams."""
    text = F.lower(L.strip_http_scheme(F.col("url")))
    grams = derived(spark, sf, "fx_urls").select(text.alias("t")).select(F.explode(L.char_ngrams(F.col("t"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "gram").limit(3000)


SPLIT_SQL = f"CASE WHEN {h("root || 'split'")} % 1000 < 360 THEN 0 ELSE 1 END AS in_train"
NUMBERS = [
    hosted("sn", "fx_urls"),
    f"st AS (SELECT *, {SPLIT_SQL} FROM sn)",
    *feature_ctes("st"),
    "mo AS (SELECT "
    + ", ".join(f"avg({n}) AS m_{n}, CASE WHEN stddev_pop({n}) = 0 THEN 1.0 ELSE stddev_pop({n}) END AS s_{n}" for n in FEATURE_NAMES)
    + " FROM feat WHERE in_train = 1)",
]


@query(
    "standardize_numeric",
    with_duck(
        ("fx_urls",), *NUMBERS,
        select="SELECT url_id, " + ", ".join(f"round(({n} - m_{n}) / s_{n}, 5) AS {n}" for n in FEATURE_NAMES) + " FROM feat, mo",
    ),
)
def standardize_numeric(spark, sf):
    rows = feature_vector(derived(spark, sf, "fx_urls")).withColumn("root", registrable_root(F.col("url")))
    rows = staged(Z.grouped_split(rows), "numbers")
    mean, std = L.feature_moments(rows.filter("split = 'train'"))
    scaled = L.standardize_numeric(rows, mean, std)
    return scaled.select("url_id", *[F.round(F.col("scaled")[i], 5).alias(n) for i, n in enumerate(FEATURE_NAMES)])


SQUARES = " + ".join(f"((f.{n} - m_{n}) / s_{n}) * ((f.{n} - m_{n}) / s_{n})" for n in FEATURE_NAMES)
STACKED = [
    *TEXTS, *tfidf_ctes("cb", CHAR_TERMS, CHARS), *tfidf_ctes("wb", WORD_TERMS, WORDS), *feature_ctes("texts", "norm"),
    NUMBERS[-1],
]


@query(
    "stack_blocks",
    with_duck(
        ("fx_scored",), *STACKED,
        select=f"""SELECT f.url_id, CAST(cb.terms + wb.terms AS INT) AS text_terms,
            round(sqrt(0.05 * 0.05 * (cb.norm + wb.norm) + 15.0 * 15.0 * ({SQUARES})), 4) AS norm
            FROM feat f JOIN cb USING (url_id) JOIN wb USING (url_id), mo""",
    ),
)
def stack_blocks(spark, sf):
    """Norm of the stacked vectors, and how many text terms are in them; the last 22 entries are the numbers."""
    rows = corpus(spark, sf)
    blocks = L.fit_blocks(rows.filter("split = 'train'"), CHARS, WORDS)
    square = F.aggregate(entries("stacked"), F.lit(0.0), lambda a, x: a + x * x)
    text = sum(len(s.vocabulary) for s in blocks.stages if isinstance(s, CountVectorizerModel))
    return blocks.transform(rows).select(
        "url_id", F.size(entries("stacked", text)).alias("text_terms"), F.round(F.sqrt(square), 4).alias("norm")
    )


@query("train_boosted_trees")
def train_boosted_trees(spark, sf):
    """Held-out report of the raw, uncalibrated trees."""
    test = L.score_batch(model(spark, sf), plain(spark, sf).filter("split = 'test'"))
    return M.classification_report(M.with_prediction(test.withColumn("prob", F.col(L.RAW)), 0.5))


@query(
    "calibrate_isotonic",
    with_duck(("fx_urls",), select="SELECT count(*) AS rows, 0 AS outside, 0 AS falling FROM fx_urls"),
)
def calibrate_isotonic(spark, sf):
    """Rows, scores outside 0 to 1, and calibrated values that a larger raw score falls below: none."""
    scored = L.score_batch(model(spark, sf), plain(spark, sf))
    steps = scored.groupBy("prob").agg(F.count(F.lit(1)).alias("n"), F.min(L.RAW).alias("low"), F.max(L.RAW).alias("high"))
    before = F.max("high").over(Window.orderBy("prob").rowsBetween(Window.unboundedPreceding, -1))  # one row per step
    return steps.withColumn("before", before).agg(
        F.sum("n").alias("rows"),
        F.count_if((F.col("prob") < 0) | (F.col("prob") > 1) | (F.col("low") < 0) | (F.col("high") > 1)).alias("outside"),
        F.count_if(F.col("low") <= F.col("before")).alias("falling"),
    )


@query("calibration_steps")
def calibration_steps(spark, sf):
    """The calibration map: raw scores per calibrated value."""
    scored = L.score_batch(model(spark, sf), plain(spark, sf))
    return scored.groupBy(F.round("prob", 6).alias("prob")).agg(
        F.round(F.min(L.RAW), 6).alias("raw_from"), F.round(F.max(L.RAW), 6).alias("raw_to"), F.count(F.lit(1)).alias("rows")
    )


@query("score_batch")
def score_batch(spark, sf):
    return L.score_batch(model(spark, sf), plain(spark, sf)).select("url_id", "raw_prob", "prob")


@query(
    "score_undecided",
    with_duck(
        ("fx_scored",), *TIERS,
        select="SELECT tier, tier = 'model' AS scored, count(*) AS urls FROM tiers GROUP BY tier",
    ),
)
def score_undecided(spark, sf):
    """Which rows reach the model: those no rule decides."""
    tiers = staged(tiered(spark, sf).select("url_id", "norm", "tier"), "tiers")
    out = L.score_undecided(model(spark, sf), tiers)
    return out.groupBy("tier", F.col("prob").isNotNull().alias("scored")).agg(F.count(F.lit(1)).alias("urls"))


@query("save_load_model", with_duck(("fx_urls",), select="SELECT count(*) AS rows, 0 AS changed FROM fx_urls"))
def save_load_model(spark, sf):
    """Rows whose score changes after saving and loading again: none."""
    first = model(spark, sf)
    path = scratch_path(spark, "model-copy")
    L.save_model(first, path)
    table = plain(spark, sf).select("url_id", "url")
    a = L.score_batch(first, table).select("url_id", F.col("prob").alias("a"))
    b = L.score_batch(L.load_model(path), table).select("url_id", F.col("prob").alias("b"))
    return a.join(b, "url_id").agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("a") != F.col("b")).alias("changed"))


@query("compare_model_versions")
def compare_model_versions(spark, sf):
    return L.compare_model_versions(model(spark, sf), model(spark, sf, 0.5), plain(spark, sf))


@query("ship_decision")
def ship_decision(spark, sf):
    return L.ship_decision(model(spark, sf), model(spark, sf, 0.5), plain(spark, sf))


@query(
    "evaluate_source_composition",
    with_duck(
        ("fx_scored",), parsed("mp", "fx_scored"),
        f"known AS (SELECT DISTINCT root FROM mp WHERE type = 'phishing' AND {h("root || 'split'")} % 1000 >= 360)",
        rf"""s AS (SELECT source, root NOT IN (SELECT root FROM known) AS novel, root IN {sql_in(RULES.trusted_roots)} AS trusted,
            regexp_matches(regexp_replace(lower(norm), '^[a-z]+://', ''), '/+[^/]|\?') AS pathed FROM mp WHERE type = 'phishing')""",
        select="SELECT source, count(*) AS total, "
        + ", ".join(f"count(*) FILTER ({c}) AS {c}, round(100.0 * count(*) FILTER ({c}) / count(*), 4) AS {c}_pct"
                    for c in ("novel", "pathed", "trusted"))
        + " FROM s GROUP BY source",
    ),
)
def evaluate_source_composition(spark, sf):
    table = plain(spark, sf)
    roots = table.filter("split = 'train' AND label = 1").select("root")
    scored = L.score_batch(model(spark, sf), table.drop("root").filter("label = 1"))
    return L.evaluate_sources(scored, roots)["composition"]


@query("evaluate_sources")
def evaluate_sources(spark, sf):
    table = plain(spark, sf)
    roots = table.filter("split = 'train' AND label = 1").select("root")
    scored = L.score_batch(model(spark, sf), table.drop("root").filter("label = 1"))
    return L.evaluate_sources(scored, roots)["recall"]


@query("evaluate_source_percentiles")
def evaluate_source_percentiles(spark, sf):
    table = plain(spark, sf)
    roots = table.filter("split = 'train' AND label = 1").select("root")
    scored = staged(L.score_batch(model(spark, sf), table.drop("root").filter("label = 1")), "scored")  # read three times
    return L.evaluate_sources(scored, roots)["percentiles"]


@query("raw_vs_calibrated_report")
def raw_vs_calibrated_report(spark, sf):
    test = plain(spark, sf).filter("split = 'test'")
    return M.raw_vs_calibrated_report(L.score_batch(model(spark, sf), test))
