"""Brand look-alikes against a table of brands of any size, by signatures instead of trying every pair.

Similarity above a ratio bounds the letters that two strings have to insert and delete, by ``d`` say. Cut the brand into parts of
six letters or more, and the piece wherever the letters fall: one of ``m`` parts then takes at most ``d / m`` of them. So a brand
offers its parts and a piece all its substrings that could be one, each also without the letters that such a part may lose or
gain, for each pair of lengths that the ratio admits; equal ones join, and what meets is measured. Shorter parts that have to stand
unchanged would be fewer keys, but common words then meet in numbers that grow with the square of the table. For one edit (the typo
test) both offer themselves and what is left when a letter is deleted.

A string makes up to hundreds of keys, which Spark's sizes, taken before they are made, don't know of: so strings are dealt over
all partitions before, and the keys always meet by sorting.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostsift.functions.brands import RATIO_PERCENT, host_pieces, lcs_length

#: The measure holds a brand's letters as bits of a long.
LONGEST = 62
#: Letters that a part has at least.
PART = 6


def most_edits(a: Column, b: Column, percent: int = RATIO_PERCENT) -> Column:
    """Most letters inserted and deleted between strings of these lengths whose similarity is above the ratio; -1 if none is."""
    bound = F.floor(((100 - percent) * (a + b) - 1) / 100).cast("int")
    apart = F.abs(a - b)
    return F.when(apart <= bound, bound - (bound - apart) % 2).otherwise(-1)


def _other_lengths(n: Column, percent: int) -> Column:
    """Lengths that a string of length ``n`` can be similar to, and some more."""
    return F.sequence(F.floor(n * percent / (200 - percent)).cast("int"), F.ceil(n * (200 - percent) / percent).cast("int"))


def _signature(a: str, b: str, i: str, text: Column) -> Column:
    return F.xxhash64(a, b, i, text).alias("signature")


def _parts(sized: DataFrame, percent: int) -> DataFrame:
    """``i``, ``start`` (from 0) and ``size`` of each of the ``m`` parts of a string of length ``b``, for strings of length ``a``.

    ``less`` and ``more`` are the letters that ``a`` is without or has beside, in all; a part has ``few`` of both at most.
    """
    pairs = sized.withColumn("edits", most_edits(F.col("a"), F.col("b"), percent)).where("edits >= 0")
    pairs = pairs.selectExpr("*", "(edits + b - a) div 2 AS less", "(edits + a - b) div 2 AS more", f"greatest(1, least(edits + 1, b div {PART})) AS m")
    each = pairs.selectExpr("*", "edits div m AS few", "explode(sequence(0, CAST(m - 1 AS INT))) AS i")
    return each.selectExpr("*", "CAST(i * b div m AS INT) AS start", "CAST((i + 1) * b div m - i * b div m AS INT) AS size")


def _gained(by: str) -> str:
    """Letters that a part gains at most when its length changes by ``by``; what it loses are these less ``by``."""
    return f"CAST(least((few + {by}) div 2, more, less + {by}) AS INT)"


def _without(text: Column, n: Column) -> Column:
    """All that is left of a string when ``n`` of its letters are deleted."""

    def one_less(t: Column) -> Column:
        places = F.when(F.length(t) > 0, F.sequence(F.lit(1), F.length(t))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))

    again = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    texts = F.aggregate(again, F.array(text), lambda held, _: F.array_distinct(F.flatten(F.transform(held, one_less))))
    return F.when(n == 0, F.array(text)).otherwise(texts)


def _dealt(strings: DataFrame, column: str) -> DataFrame:
    """The strings over as many partitions as shuffles have, however few bytes they are.

    Not by the column itself, as Spark leaves out an exchange that a distinct before it has made.
    """
    return strings.repartition(int(strings.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.xxhash64(column))


def brand_signatures(brands: DataFrame, percent: int = RATIO_PERCENT) -> DataFrame:
    """``brand`` and ``signature`` of its parts, and of what is left of them, for all lengths of pieces."""
    sized = _dealt(brands, "brand").withColumn("b", F.length("brand")).withColumn("a", F.explode(_other_lengths(F.col("b"), percent)))
    changes = "sequence(CAST(-least(few, less) AS INT), CAST(least(few, more) AS INT))"
    lost = f"explode(array_distinct(transform({changes}, by -> {_gained('by')} - by))) AS lost"
    at = _parts(sized, percent).selectExpr("*", lost)
    texts = _without(F.substring("brand", F.col("start") + 1, F.col("size")), F.col("lost"))
    return at.withColumn("text", F.explode(texts)).select("brand", _signature("a", "b", "i", F.col("text")))


def piece_signatures(pieces: DataFrame, percent: int = RATIO_PERCENT) -> DataFrame:
    """``piece`` and ``signature`` of its substrings that can be a brand's part, without the letters they may have beside."""
    sized = _dealt(pieces, "piece").withColumn("a", F.length("piece")).withColumn("b", F.explode(_other_lengths(F.col("a"), percent)))
    at = _parts(sized, percent).selectExpr("*", "explode(sequence(CAST(-least(few, less) AS INT), CAST(least(few, more) AS INT))) AS by")
    # The first part begins where the piece does, and the last one ends there.
    at = at.selectExpr(
        "*", f"{_gained('by')} AS gained", "size + by AS long",
        "greatest(0, start - less, start - less - by, IF(i = m - 1, a - size - by, 0)) AS first",
        "least(start + more, start + more - by, a - size - by, IF(i = 0, 0, a)) AS last",
    ).where("first <= last")
    found = F.transform(
        F.expr("sequence(CAST(first AS INT), CAST(last AS INT))"), lambda start: F.substring(F.col("piece"), start + 1, F.col("long"))
    )
    texts = F.flatten(F.transform(found, lambda text: _without(text, F.col("gained"))))
    return at.withColumn("text", F.explode(F.array_distinct(texts))).select("piece", _signature("a", "b", "i", F.col("text")))


def _measurable(brand: Column) -> Column:
    """The brand as the measure reads it."""
    n = F.length(brand)
    letters = F.split(brand, "")
    masks = F.map_from_entries(F.transform(F.array_distinct(letters), lambda ch: F.struct(ch, F.aggregate(
        F.transform(letters, lambda x, i: F.when(x == ch, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(0)),
        F.lit(0).cast("bigint"), lambda m, x: m.bitwiseOR(x),
    ))))
    full = F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1
    return F.struct(n.alias("n"), full.alias("full"), masks.alias("masks"))


def candidates(pieces: DataFrame, brands: DataFrame, percent: int = RATIO_PERCENT) -> DataFrame:
    """Distinct (piece, brand) that share a signature and are no farther apart than the ratio lets them."""
    offered = brand_signatures(brands, percent).hint("merge")
    met = piece_signatures(pieces, percent).join(offered, "signature").select("piece", "brand")
    edits = most_edits(F.length("piece"), F.length("brand"), percent)
    near = (edits >= 0) & (F.call_function("levenshtein", "piece", "brand", F.greatest(edits, F.lit(0))) >= 0)
    return met.where(near).distinct()


def brand_table_join(hosts: DataFrame, brands: DataFrame, host: str = "f_host", percent: int = RATIO_PERCENT) -> DataFrame:
    """Distinct (piece, brand, similarity) above the ratio, for hosts with their ``host_skeleton`` and a table of ``brand``.

    Brands are folded names of at most 62 characters; a longer one raises an error. Null and repeated brands count for nothing, and
    brands under four characters can be similar to longer pieces. No table is compared pair by pair: both are dealt by signature.
    """
    pieces = hosts.select(F.explode(host_pieces(F.col(host), F.col("host_skeleton"))).alias("piece")).distinct()
    size = F.length("brand")
    long = F.raise_error(F.concat(F.lit("a brand has more than 62 characters: "), F.col("brand")))
    known = brands.select("brand").dropna().where("brand <> ''").distinct()
    known = known.where(F.when(size > LONGEST, long.cast("boolean")).otherwise(True))
    letters = F.length("piece") + F.length("brand")
    common = lcs_length(F.col("piece"), F.col("as_bits")).alias("common")
    measured = candidates(pieces, known, percent).withColumn("as_bits", _measurable(F.col("brand"))).select("piece", "brand", common)
    return measured.where(F.col("common") * 200 > letters * percent).select(
        "piece", "brand", (F.col("common") * 2 / letters).alias("similarity")
    )


def _within_one(text: Column) -> Column:
    """The string and what is left of it without one of its characters."""
    n = F.length(text)
    without = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, n)))
    return F.array_distinct(F.concat(F.array(text), F.when(n > 0, without).otherwise(F.array().cast("array<string>"))))


def typo_table_join(df: DataFrame, brands: DataFrame, host: str = "host", order: str = "ordinal") -> DataFrame:
    """Add ``typo_brand``: the first brand, by ``order``, one edit away from the host's first label, or null.

    Each distinct label is looked up once; a label and a brand one edit apart are equal when each has lost at most one character.
    """
    label = F.substring_index(F.col(host), ".", 1)
    names = df.select(label.alias("name")).where("name IS NOT NULL").distinct()
    known = brands.select("brand", F.col(order).alias("ordinal")).dropna(subset=["brand"]).groupBy("brand").agg(F.min("ordinal").alias("ordinal"))
    met = _dealt(names, "name").withColumn("key", F.explode(_within_one(F.col("name")))).join(
        _dealt(known, "brand").withColumn("key", F.explode(_within_one(F.col("brand")))).hint("merge"), "key"
    )
    hits = met.where(F.levenshtein("name", "brand", 1) == 1)
    first = hits.groupBy("name").agg(F.min(F.struct("ordinal", "brand")).alias("first")).select("name", F.col("first.brand").alias("typo_brand"))
    return df.withColumn("_name", label).join(first.withColumnRenamed("name", "_name"), "_name", "left").drop("_name")
