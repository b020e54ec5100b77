"""Path augmentation and URL synthesis: all choices are hashes of the row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostsift import rules as R
from hostsift.functions.hashing import hash32, pick
from hostsift.functions.literals import literal_array
from hostsift.functions.urls import leet_obfuscate, strip_to_host
from hostsift.operators.predicates import drop_malformed_hosts

DEEP_PERCENT = 35


def added_path(key: Column, salt: str = "") -> Column:
    """A generated path: deep (2-7 segments) for 35 % of keys, else a section, a page in a section, or a section with a query."""

    def word(name: str, *more: Column) -> Column:
        number = hash32(F.concat(key, F.lit(f"{salt}{name}"), *more)) if more else hash32(key, f"{salt}{name}")
        return F.element_at(literal_array(R.PATH_WORDS), (number % len(R.PATH_WORDS) + 1).cast("int"))

    depth = (hash32(key, f"{salt}depth") % 6 + 2).cast("int")
    deep = F.array_join(F.transform(F.sequence(F.lit(1), depth), lambda i: word("seg", i.cast("string"))), "/")
    section, form = word("section"), hash32(key, f"{salt}form") % 3
    shallow = (
        F.when(form == 0, section)
        .when(form == 1, F.concat(section, F.lit("/"), word("page")))
        .otherwise(F.concat(section, F.lit("?item="), (hash32(key, f"{salt}item") % 10_000).cast("string")))
    )
    return F.concat(F.lit("/"), F.when(hash32(key, f"{salt}deep") % 100 < DEEP_PERCENT, deep).otherwise(shallow))


def add_path(url: Column, salt: str = "") -> Column:
    """``scheme://host`` of the URL with a generated path."""
    return F.concat(F.regexp_replace(strip_to_host(url), "/+$", ""), added_path(url, salt))


def augment_bare_pathed(df: DataFrame, salt: str = "aug") -> DataFrame:
    """Each URL twice, bare and pathed, with its label; one row per URL afterwards.

    A form both classes produce keeps the phishing label.
    """
    pair = F.explode(F.array(F.col("bare"), add_path(F.col("url"), salt)))
    forms = drop_malformed_hosts(df.withColumn("bare", strip_to_host(F.col("url"))))
    label = (F.col("type") == "phishing").cast("int")
    return forms.select(pair.alias("url"), label.alias("label")).groupBy("url").agg(F.max("label").alias("label"))


def expand_variants(df: DataFrame, n: int, url: str = "url", salt: str = "var") -> DataFrame:
    """The URL, its bare host and distinct pathed variants: up to n + 1 rows each."""
    base = F.regexp_replace(strip_to_host(F.col(url)), "/+$", "")
    tries = F.transform(
        F.sequence(F.lit(1), F.lit(6 * n)),
        lambda i: F.concat(base, added_path(F.concat(F.col(url), F.lit("#"), i.cast("string")), salt)),
    )
    forms = F.array_distinct(F.concat(F.array(F.col(url), strip_to_host(F.col(url))), tries))
    return df.withColumn(url, F.explode(F.slice(forms, 1, n + 1)))


def legit_from_ranked(ranked: DataFrame, salt: str = "rank") -> DataFrame:
    """Each ranked domain as a bare HTTPS URL and one pathed form."""
    base = F.concat(F.lit("https://"), F.col("domain"))
    return ranked.select(F.explode(F.array(base, add_path(base, salt))).alias("url"))


def oversample(df: DataFrame, times: int = 2) -> DataFrame:
    return df.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_copy")


def path_variant_grid(hosts: DataFrame, suffixes: list[str], host: str = "host") -> DataFrame:
    """Every host with every suffix; the suffix list is a literal array."""
    forms = F.explode(literal_array(suffixes)).alias("suffix")
    grid = hosts.select(host, forms)
    return grid.withColumn("url", F.concat(F.lit("https://"), host, "suffix")).withColumn("bare", F.col("suffix") == "")


def synthesize_adversarial(
    ids: DataFrame, id_col: str = "id", salad_percent: int = 45, path_percent: int = 50, seed: str = "adv"
) -> DataFrame:
    """One synthetic phishing URL per id, deduplicated: keyword salads, and brands beside keywords.

    A branded host puts a brand, as it is or with look-alike digits, before or after a keyword, joined by a hyphen or a dot,
    with or without a tail; each choice is a hash of the id.
    """
    key = F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"), F.lit(":"))
    words = R.KEYWORDS

    def chance(salt: str, percent: int) -> Column:
        return hash32(key, salt) % 100 < percent

    # Distinct words without a shuffle: the list length is prime, so steps of any
    # stride from any start visit every word before repeating.
    start, stride = hash32(key, "start"), hash32(key, "stride") % (len(words) - 1) + 1
    options = literal_array(words)
    salad = F.array_join(
        F.transform(
            F.sequence(F.lit(0), (hash32(key, "words") % 3 + 1).cast("int")),
            lambda i: F.element_at(options, ((start + stride * i) % len(words) + 1).cast("int")),
        ),
        "-",
    )
    brand = pick(R.BRANDS, key, "brand")
    shown = F.when(chance("obscured", 50), leet_obfuscate(brand)).otherwise(brand)
    word, joint = pick(words, key, "word"), F.when(chance("joint", 70), "-").otherwise(".")
    branded = F.when(chance("front", 50), F.concat(shown, joint, word)).otherwise(F.concat(word, joint, shown))
    name = F.when(chance("kind", salad_percent), salad).otherwise(branded)
    host = F.concat(name, pick(R.HOST_TAILS, key, "tail"), F.lit("."), pick(R.GENERATOR_TLDS, key, "tld"))
    out = ids.withColumn("_url", F.concat(F.lit("http://"), host))
    url = F.when(chance("pathed", path_percent), add_path(F.col("_url"), seed)).otherwise(F.col("_url"))
    return out.select(url.alias("url")).distinct().withColumn("type", F.lit("phishing"))
