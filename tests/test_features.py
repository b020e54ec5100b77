"""Feature vector facts and brute-force checks of the brand expressions."""

import random

import pytest
from pyspark.sql import functions as F

from hostsift.functions import brands as B
from hostsift.functions.features import FEATURE_NAMES, feature_vector
from hostsift.functions.idn import idn_skeleton
from hostsift.rules import BRANDS


def vectors(spark, urls):
    df = spark.createDataFrame(list(enumerate(urls)), "i int, url string")
    return [r.features for r in feature_vector(df).orderBy("i").collect()]


def test_golden_vector(spark):
    expected = [0.52, 1, 3, 4, 0, 4.310735, 5, 1, 1, 1, 0, 0, 0, 2, 1, 0, 0, 0, 3, 3, 0, 0]
    got = vectors(spark, ["http://secure-login-paypal-verify.com/account/update"])[0]
    assert got == pytest.approx(expected, abs=1e-4)


def test_always_22_numbers(spark):
    odd = ["", None, "http://", "with some spaces", "http://xn--pple-43d.com", "http://аpple.com", "h" * 5000, "[[[", "xn--"]
    got = vectors(spark, odd)
    assert [len(v) for v in got] == [len(FEATURE_NAMES)] * len(odd)
    assert got[1] == [0.0] * 22


@pytest.mark.parametrize(
    "url,index,value",
    [
        ("http://45.12.67.89/login", 10, 1),
        ("http://legit.com@evil.com", 11, 1),
        ("http://good.com/path?email=a@b.com", 11, 0),
        ("http://xn--pple-43d.com", 20, 1),
        ("http://аpple.com", 21, 1),
        ("http://g00gle-account-login.com", 8, 1),
        ("http://google.com", 8, 0),
        ("http://xn--pypal-4ve.com", 8, 1),
        ("http://x.com/a/b;c/d;e", 13, 3),
    ],
)
def test_single_features(spark, url, index, value):
    assert vectors(spark, [url])[0][index] == value


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for ch in a:
        last = row[:]
        for j, other in enumerate(b):
            row[j + 1] = last[j] + 1 if ch == other else max(last[j + 1], row[j])
    return row[-1]


def mutated(rng, word):
    letters = list(word)
    for _ in range(rng.randint(0, 4)):
        at = rng.randrange(len(letters) + 1)
        act = rng.choice("idr")
        if act == "i" or at == len(letters):
            letters.insert(at, rng.choice("abcdeiloprst0"))
        elif act == "d" and len(letters) > 2:
            del letters[at]
        else:
            letters[at] = rng.choice("abcdeiloprst")
    return "".join(letters)


def test_brand_hits_match_brute_force(spark):
    rng = random.Random(5)
    pieces = sorted({mutated(rng, rng.choice(BRANDS)) for _ in range(1500)})
    pieces = [p for p in pieces if len(p) >= 4]
    want = {
        (p, b, round(2 * lcs(p, b) / (len(p) + len(b)), 9))
        for p in pieces
        for b in BRANDS
        if 2 * lcs(p, b) * 100 > 85 * (len(p) + len(b))
    }
    df = spark.createDataFrame([(p,) for p in pieces], "p string")
    hits = df.select(F.explode(B.brand_hits(F.array("p"))).alias("h")).select("h.*").collect()
    assert {(r.piece, r.brand, round(r.similarity, 9)) for r in hits} == want
    assert len(want) > 300


def test_typo_and_subdomain(spark):
    df = spark.createDataFrame(
        [("gogle.com", "http://paypal.evil.com/login"), ("paypa1.com", "http://google.com"),
         ("google.com", "http://shop.example.com"), ("example.com", "a.apple.b.paypal.evil.com/x//http://github.q.com")],
        "host string, url string",
    )
    rows = df.select(B.typo_brand(F.col("host")), B.subdomain_brand(F.col("url"))).collect()
    assert [r[0] for r in rows] == ["google", "paypal", None, None]
    assert [r[1] for r in rows] == ["paypal", None, None, "github"]  # text after the last "//"


def test_brand_in_domain(spark):
    hosts = {"google.com": False, "mail.google.com": False, "google": False, "google.evil.com": True, "purchase.com": True,
             "example.org": False, "google.com.evil.io": True}
    df = spark.createDataFrame([(h,) for h in hosts], "host string").withColumn("flag", B.brand_in_domain("host"))
    assert {r.host: r.flag for r in df.collect()} == hosts


def test_skeleton(spark):
    facts = {"xn--pypal-4ve.com": "paypal.com", "аpple.com": "apple.com", "plain.com": "plain.com", "xn--.com": ".com",
             "ｇｏｏｇｌｅ.com": "google.com", "café.fr": "cafe.fr"}
    df = spark.createDataFrame([(h,) for h in facts], "host string")
    assert {r.host: r.skeleton for r in idn_skeleton(df).collect()} == facts


def test_independent_of_partitioning(spark, sf_dir):
    from registry.corpus import derived

    table = derived(spark, sf_dir, "fx_urls")
    one = feature_vector(table.coalesce(1)).select("url_id", "features").collect()
    many = feature_vector(table.repartition(13)).select("url_id", "features").collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


def test_refused_urls_give_zeros(spark):
    df = spark.createDataFrame([("http://a\uff0fb.com/login",), (None,), ("http://a.com/\uff0f",)], "url string")
    first, second, third = [r.features for r in feature_vector(df).collect()]
    assert first == second == [0.0] * 22 and third != first
