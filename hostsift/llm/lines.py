"""Line dedup across documents by a deletion-neighbourhood join, in DataFrame operations only.

Two lines within one edit of each other have a common string among those made by taking out at most one character. So lines
emit the hashes of all their variants, equal hashes meet, and what meets is verified by edit distance. Two things keep that
in proportion to the input:

* A line with a near copy shares, whole, its first or its last half with it. Only lines whose half some other line has too
  emit variants, and only of the other half. That loses nothing and spares the many lines that have no near copy.
* The hash of a variant is a sum over its characters and their positions. With running sums over a line's characters, each
  variant's hash takes the same small work, however long the line is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hostsift.llm.common import fresh

LOW = 0xFFFFFFFF


def _halves(line: Column) -> Column:
    """Hashes that two lines within one edit share at least one of; the lowest bit tells a first half (1) from a last (0).

    With ``m`` the longer one's length, they share the first ``m // 2`` characters or the last ``m - m // 2``; for a line of
    ``n`` characters, ``m`` is ``n`` or ``n + 1``.
    """
    n = F.length(line)
    keys = []
    for m in (n, n + 1):
        h = F.floor(m / 2).cast("int")
        keys.append(F.xxhash64(F.lit("first"), F.substring(line, F.lit(1), h)).bitwiseOR(F.lit(1)))
        keys.append(F.xxhash64(F.lit("last"), F.substring(line, n - (m - h) + 1, m - h)).bitwiseAND(F.lit(-2)))
    return F.array(*keys)


def _first_places(lines: DataFrame) -> DataFrame:
    """Distinct lines: ``place``, the earliest, and the hashes of their halves. Lines are told apart by 128 bits."""
    first = F.min(F.struct("place", *[F.col("halves")[i].alias(f"h{i}") for i in range(4)])).alias("f")
    return lines.groupBy("a", "b").agg(first).select("f.*")


def _likely(firsts: DataFrame) -> DataFrame:
    """``place`` of lines that share a half with another, and which half of theirs may hold the edit."""
    halves = firsts.select("place", F.explode(F.array_distinct(F.array("h0", "h1", "h2", "h3"))).alias("half"))
    shared = halves.groupBy("half").agg(F.count("*").alias("n")).where("n > 1").select("half")
    is_first = F.col("half").bitwiseAND(F.lit(1)) == 1
    return (
        halves.join(shared, "half", "left_semi")
        .groupBy("place")
        .agg(F.max(is_first).alias("edit_in_last"), F.max(~is_first).alias("edit_in_first"))
    )


def _variants(lines: DataFrame) -> DataFrame:
    """``v1``, ``v2``: the hash of a variant; ``at``: the position taken out, -1 for the line itself; ``place``."""
    chars = lines.repartition("place").select(
        "place", "edit_in_first", "edit_in_last", F.length("line").alias("n"),
        F.posexplode(F.split("line", "")).alias("at", "char"),
    )
    here, moved = F.xxhash64("char", "at"), F.xxhash64("char", F.col("at") - 1)
    parts = {
        "p1": here.bitwiseAND(F.lit(LOW)), "p2": F.shiftrightunsigned(here, 32),
        "r1": moved.bitwiseAND(F.lit(LOW)), "r2": F.shiftrightunsigned(moved, 32),
    }
    whole = Window.partitionBy("place")
    upto = whole.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = chars.withColumns(parts)
    sums = sums.select(
        "place", "edit_in_first", "edit_in_last", "n", "at", "p1", "p2",
        *[F.sum(c).over(upto).alias(f"{c}_upto") for c in parts],
        *[F.sum(c).over(whole).alias(f"{c}_all") for c in parts],
    )
    without = [F.col(f"p{i}_upto") - F.col(f"p{i}") + F.col(f"r{i}_all") - F.col(f"r{i}_upto") for i in (1, 2)]
    taken_out = F.struct(without[0].alias("v1"), without[1].alias("v2"), "at")
    itself = F.struct(F.col("p1_all").alias("v1"), F.col("p2_all").alias("v2"), F.lit(-1).alias("at"))
    in_first = F.col("edit_in_first") & (F.col("at") < F.floor((F.col("n") + 1) / 2))
    in_last = F.col("edit_in_last") & (F.col("at") >= F.floor(F.col("n") / 2))
    emitted = F.array_compact(
        F.array(F.when(in_first | in_last, taken_out), F.when(F.col("at") == 0, itself))
    )
    return sums.select("place", F.explode(emitted).alias("v")).select("place", "v.*")


def _near(likely_lines: DataFrame) -> DataFrame:
    """``place`` of distinct lines that are within one edit of a line at an earlier place.

    Lines from which the same character position was taken out to give the same string are all within one edit of each
    other, and so is that string itself of all of them: the earliest of each is witness enough, and no pairs are listed.
    How many lines meet at one string is bounded by its length and the alphabet, as lines are distinct here.
    """
    met = Window.partitionBy("v1", "v2")
    itself = F.min(F.when(F.col("at") < 0, F.col("place"))).over(met)
    longer = F.min(F.when(F.col("at") >= 0, F.col("place"))).over(met)
    replaced = F.min("place").over(Window.partitionBy("v1", "v2", "at"))
    found = _variants(likely_lines).select("place", "at", itself.alias("x"), longer.alias("y"), replaced.alias("z"))
    witnesses = F.when(F.col("at") < 0, F.array("y")).otherwise(F.array("x", "z"))
    pairs = (
        found.select("place", F.explode(F.filter(witnesses, lambda w: w < F.col("place"))).alias("witness")).distinct()
    )
    texts = likely_lines.select("place", "line")
    return (
        pairs.join(texts, "place")
        .join(texts.select(F.col("place").alias("witness"), F.col("line").alias("other")), "witness")
        .where(F.levenshtein("line", "other", 1) >= 0)
        .select("place")
        .distinct()
    )


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = 30) -> DataFrame:
    """``docs`` with near copies of earlier lines taken out of ``text``, plus ``n_lines`` and ``n_dropped``.

    Lines are what line feeds separate. Places are ordered by key (null first), hash of the text, and line number. A line of
    at least ``min_chars`` characters goes if an earlier place has a line, itself kept or not, that is equal or one
    inserted, deleted or replaced character away; shorter lines stay, as one edit changes what they say, and count for
    nothing. So of several copies the earliest stays. Repeated rows, equal in key and text, stand at the same place and are
    treated alike. A null text stays null and has no lines; a text whose lines all go becomes empty. Other columns stay as
    they are, but ``n_lines`` and ``n_dropped`` are replaced; an empty table stays empty.
    """
    cols = [c for c in docs.columns if c.lower() not in ("n_lines", "n_dropped")]
    row = fresh(docs, "row_hash")
    marked = docs.select(*[f"`{c}`" for c in cols]).withColumn(row, F.xxhash64(F.col(f"`{text}`")))
    line = F.col("line")
    exploded = marked.select(
        F.col(f"`{key}`").alias("k"), F.col(row).alias("r"), F.posexplode(F.split(F.col(f"`{text}`"), "\n", -1)).alias("no", "line")
    ).where(F.length("line") >= min_chars)
    place = F.struct("k", "r", "no").alias("place")
    lines = exploded.select(
        place, F.xxhash64(line).alias("a"), F.xxhash64(F.lit(1), line).alias("b"), _halves(line).alias("halves")
    )
    firsts = _first_places(lines)
    likely = _likely(firsts)
    k, r, found = (fresh(marked, x) for x in ("k", "r", "found"))
    by_text = [F.col("place.k").alias(k), F.col("place.r").alias(r)]
    likely_docs = likely.groupBy(*by_text).agg(
        F.collect_list(F.struct("place.no", "place", "edit_in_first", "edit_in_last")).alias(found)
    )
    wanted = (
        marked.join(likely_docs, [marked[f"`{key}`"].eqNullSafe(likely_docs[k]), marked[row] == likely_docs[r]])
        .select(F.explode(found).alias("w"), F.col(f"`{text}`").alias("t"))
        .select("w.place", "w.edit_in_first", "w.edit_in_last", F.split_part("t", F.lit("\n"), F.col("w.no") + 1).alias("line"))
    )
    # Repeated rows have the same places, and equal lines there.
    near = _near(wanted.dropDuplicates(["place"]))
    seen = firsts.select("place", F.lit(False).alias("near")).union(near.select("place", F.lit(True).alias("near")))
    kept = seen.groupBy(*by_text).agg(
        F.array_except(
            F.collect_list(F.when(~F.col("near"), F.col("place.no"))), F.collect_list(F.when(F.col("near"), F.col("place.no")))
        ).alias(found)
    )
    joined = marked.join(kept, [marked[f"`{key}`"].eqNullSafe(kept[k]), marked[row] == kept[r]], "left")
    # Indices of what stays are found first; the text is split once and bound to a variable.
    split = F.split(F.col(f"`{text}`"), "\n", -1)
    stays = F.when(F.col(f"`{text}`").isNotNull(), F.transform(F.array(split), lambda ls: _rest(ls, F.col(found), min_chars))[0])
    made = fresh(joined, "made")
    out = joined.withColumn(made, stays)
    return out.select(
        *[F.col(f"{made}.text").alias(c) if c.lower() == text.lower() else F.col(f"`{c}`") for c in cols],
        F.coalesce(F.col(f"{made}.n_lines"), F.lit(0)).cast("bigint").alias("n_lines"),
        F.coalesce(F.col(f"{made}.n_dropped"), F.lit(0)).cast("bigint").alias("n_dropped"),
    )


def _rest(lines: Column, kept: Column, min_chars: int) -> Column:
    """Lines that stay: short ones, and those at the kept indices."""
    short = F.filter(F.transform(lines, lambda x, i: F.when(F.length(x) < min_chars, i)), lambda i: i.isNotNull())
    indices = F.array_sort(F.array_union(short, F.coalesce(kept, F.array().cast("array<int>"))))
    return F.struct(
        F.array_join(F.transform(indices, lambda i: F.get(lines, i)), "\n").alias("text"),
        F.size(lines).alias("n_lines"),
        (F.size(lines) - F.size(indices)).alias("n_dropped"),
    )
