"""The learned scorer: text and number blocks, boosted trees, isotonic calibration.

Everything fitted is fitted on the train slice (or, for the calibration map, on
the calibrate slice) and stored as one Spark ML ``PipelineModel``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import GBTClassificationModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    IDF,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
    VectorAssembler,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostsift.functions.features import FEATURE_NAMES, feature_vector
from hostsift.functions.urls import has_path, normalize_url, registrable_root, strip_http_scheme
from hostsift.operators import metrics
from hostsift.operators.joins import allowlist_match, novelty_flag
from hostsift.plans.boost import boost, truncated
from hostsift.plans.vocabulary import vocabulary
from hostsift.rules import BLOCK_WEIGHTS, DEFAULT_RULES, RuleSet
from hostsift.session import exists, scratch_path, staged

SEED = 42


def char_ngrams(text: Column, smallest: int = 3, largest: int = 5) -> Column:
    """All character n-grams of a string, as an array."""
    n = F.length(text)

    def grams(size: int) -> Column:
        starts = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))

    return F.concat(*[grams(size) for size in range(smallest, largest + 1)])


def model_inputs(df: DataFrame, url: str = "url", rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Add ``text``, ``grams`` and ``features`` for training or scoring."""
    text = F.lower(strip_http_scheme(F.col(url)))
    out = feature_vector(df, url, rules).withColumn("text", text)
    return out.withColumn("grams", char_ngrams(F.col("text")))


def _tfidf(train: DataFrame, source: str, target: str, size: int) -> list[Transformer]:
    """Stages for tf * (ln((1+n)/(1+df)) + 1), L2-normalised; vocabulary by corpus frequency."""
    words = vocabulary(train, source, size)
    counts = CountVectorizerModel.from_vocabulary(words, inputCol=source, outputCol=f"{target}_tf")
    idf = IDF(inputCol=f"{target}_tf", outputCol=f"{target}_idf").fit(counts.transform(train))
    weights = Vectors.dense([w + 1.0 for w in idf.idf.toArray()])
    scaled = ElementwiseProduct(scalingVec=weights, inputCol=f"{target}_tf", outputCol=f"{target}_w")
    return [counts, scaled, Normalizer(inputCol=f"{target}_w", outputCol=target, p=2.0)]


def tfidf_char(train: DataFrame, size: int = 3000) -> PipelineModel:
    return PipelineModel(_tfidf(train, "grams", "char_block", size))


def tfidf_word(train: DataFrame, size: int = 1000) -> PipelineModel:
    tokens = RegexTokenizer(inputCol="text", outputCol="words", gaps=False, pattern=r"(?U)\w\w+", toLowercase=True)
    return PipelineModel([tokens, *_tfidf(tokens.transform(train), "words", "word_block", size)])


def feature_moments(train: DataFrame, features: str = "features") -> tuple[list[float], list[float]]:
    """Mean and population deviation of each of the 22 numbers: one aggregate row."""
    cells = [F.avg(F.col(features)[i]).alias(f"m{i}") for i in range(len(FEATURE_NAMES))]
    cells += [F.stddev_pop(F.col(features)[i]).alias(f"s{i}") for i in range(len(FEATURE_NAMES))]
    row = train.agg(*cells).first()
    width = len(FEATURE_NAMES)
    return [float(v or 0.0) for v in row[:width]], [float(v or 0.0) or 1.0 for v in row[width:]]


def standardize_numeric(df: DataFrame, mean: Sequence[float], std: Sequence[float]) -> DataFrame:
    """Add ``scaled`` = (features - mean) / std."""
    m, s = (F.array(*[F.lit(float(v)) for v in values]) for values in (mean, std))
    centred = F.zip_with("features", m, lambda x, c: x - c)
    return df.withColumn("scaled", F.zip_with(centred, s, lambda x, d: x / d))


def _number_stages(train: DataFrame) -> list[Transformer]:
    mean, std = feature_moments(train)
    names = [f"n{i}" for i in range(len(FEATURE_NAMES))]
    scaled = ", ".join(f"(features[{i}] - {mean[i]!r}D) / {std[i]!r}D AS {n}" for i, n in enumerate(names))
    return [
        SQLTransformer(statement=f"SELECT *, {scaled} FROM __THIS__"),
        VectorAssembler(inputCols=names, outputCol="number_block"),
    ]


def stack_blocks(sizes: dict[str, int]) -> list[Transformer]:
    """Stages that weight the blocks and concatenate them, in order, as ``stacked``."""
    stages: list[Transformer] = []
    for (block, size), weight in zip(sizes.items(), BLOCK_WEIGHTS):
        vec = Vectors.dense([weight] * size)
        stages.append(ElementwiseProduct(scalingVec=vec, inputCol=block, outputCol=f"{block}_x"))
    stages.append(VectorAssembler(inputCols=[f"{b}_x" for b in sizes], outputCol="stacked"))
    return stages


def fit_blocks(train: DataFrame, char_size: int = 3000, word_size: int = 1000) -> PipelineModel:
    """All feature stages, fitted on the train slice only."""
    char, word = tfidf_char(train, char_size).stages, tfidf_word(train, word_size).stages
    sizes = {
        "char_block": len(char[0].vocabulary),
        "word_block": len(word[1].vocabulary),
        "number_block": len(FEATURE_NAMES),
    }
    return PipelineModel([*char, *word, *_number_stages(train), *stack_blocks(sizes)])


def _stored(rows: DataFrame, path: str) -> DataFrame:
    """The table at ``path``, written first unless an earlier run has."""
    spark = rows.sparkSession
    if not exists(spark, f"{path}/_SUCCESS"):
        rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def train_boosted_trees(
    train: DataFrame, rounds: int = 400, depth: int = 7, step: float = 0.05, char_size: int = 3000, word_size: int = 1000,
    held_out: DataFrame | None = None, path: str | None = None, patience: int = 1,
) -> PipelineModel:
    """Feature stages plus at most ``rounds`` boosted trees; ``train`` comes from :func:`model_inputs`.

    With ``held_out`` rows the loop ends when their loss no longer falls, and keeps the trees up to its least. With ``path``, a
    folder of this run's own, a run that was stopped is taken up at the last segment that it saved.
    """
    spark = train.sparkSession
    path = path or scratch_path(spark, "boosting")
    if exists(spark, f"{path}/blocks/metadata/_SUCCESS"):
        blocks = PipelineModel.load(f"{path}/blocks")
    else:
        blocks = fit_blocks(train, char_size, word_size)
        blocks.write().overwrite().save(f"{path}/blocks")
    tables = [
        None if rows is None else _stored(blocks.transform(rows).select("label", "stacked"), f"{path}/{name}")
        for name, rows in (("train", train), ("held-out", held_out))
    ]
    trees, _ = boost(*tables, f"{path}/boosting", rounds, depth, step, SEED, patience=patience)
    return PipelineModel([*blocks.stages, trees])


def with_rounds(model: PipelineModel, rounds: int) -> PipelineModel:
    """The uncalibrated model as it was after its first rounds."""
    stages = [s for s in model.stages if not isinstance(s, IsotonicRegressionModel)]
    return PipelineModel([*stages[:-1], truncated(stages[-1], rounds)])


def n_rounds(model: PipelineModel) -> int:
    return next(s.getNumTrees for s in model.stages if isinstance(s, GBTClassificationModel))


RAW = "raw_prob"


def calibrate_isotonic(model: PipelineModel, calibrate: DataFrame) -> PipelineModel:
    """Append a monotone raw -> probability map fitted on the calibrate slice."""
    isotonic = IsotonicRegression(
        featuresCol="probability", featureIndex=1, labelCol="label", predictionCol="prob", isotonic=True
    )
    fitted = isotonic.fit(model.transform(calibrate).select("label", "probability"))
    return PipelineModel([*model.stages, fitted])


def score_batch(model: PipelineModel, df: DataFrame, url: str = "url", rules: RuleSet = DEFAULT_RULES) -> DataFrame:
    """Add ``raw_prob`` and, with a calibrated model, ``prob`` to a URL table."""
    scored = model.transform(model_inputs(df, url, rules)).withColumn(RAW, vector_to_array("probability")[1])
    return scored.select(*df.columns, RAW, *[c for c in ("prob",) if c in scored.columns])


def score_undecided(
    model: PipelineModel, tiered: DataFrame, url: str = "norm", rules: RuleSet = DEFAULT_RULES
) -> DataFrame:
    """Score only the rows whose ``tier`` is ``model``; rows a rule decided keep a NULL score.

    Model stages run on every row they are given, so the table is split first.
    Both halves read ``tiered``: store it when it is costly to compute.
    """
    open_rows = F.col("tier") == "model"
    scored = score_batch(model, tiered.filter(open_rows), url, rules)
    return scored.unionByName(tiered.filter(~open_rows), allowMissingColumns=True)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def compare_model_versions(a: PipelineModel, b: PipelineModel, df: DataFrame) -> DataFrame:
    """False positives and the equal-FP operating point of two models on one URL set; both read scores that are stored."""
    lines = []
    for name, model in (("candidate", a), ("shipped", b)):
        scored = staged(score_batch(model, df).select("label", "prob"), "scored")
        rate = metrics.fp_rate(scored).withColumn("version", F.lit(name))
        point = metrics.equal_fp_operating_point(scored).select("threshold_milli", "recall_pct")
        lines.append(rate.join(point.withColumn("version", F.lit(name)), "version", "left"))
    return lines[0].unionByName(lines[1])


def ship_decision(a: PipelineModel, b: PipelineModel, df: DataFrame) -> DataFrame:
    """Whether model ``a`` replaces ``b``: more recall at equal false positives, with both operating points."""
    return metrics.model_gate(score_batch(a, df), score_batch(b, df))


def evaluate_sources(
    scored: DataFrame, train_roots: DataFrame, by: str = "source", rules: RuleSet = DEFAULT_RULES
) -> dict[str, DataFrame]:
    """Recall, composition and score quantiles of every feed in one grouped pass each."""
    table = scored.withColumn("url", normalize_url(F.col("url"))).withColumn("root", registrable_root(F.col("url")))
    table = allowlist_match(novelty_flag(table, train_roots), "root", rules)
    table = table.withColumn("pathed", has_path(F.col("url"), "split"))
    return {
        "recall": metrics.recall_by_slice(table, [by]),
        "composition": metrics.slice_composition(table, [by]),
        "percentiles": metrics.prob_percentiles(table, [by]),
    }
