"""Order of the gates with injected scores, tier overrides and verdict records."""

import pytest
from pyspark.sql import functions as F

from hostsift import rules as R
from hostsift.plans import verdict as V

NEUTRAL = "https://zzq-neutral-4821.example/home"
TUMBLR = "https://some-user.tumblr.com/login"
GOOGLE = "https://google.com/account/login"
LOCAL = "http://localhost:8000/login"
MONACO = "https://microsoft.github.io/monaco-editor/"
NO_RULES = R.RuleSet(trusted_roots=R.SHARED_HOSTING_ROOTS[1:])


def judge(spark, url, prob, listed, rules=R.DEFAULT_RULES, age=-1, ssl=True):
    scored = spark.createDataFrame([(url, prob, age, ssl)], "url string, prob double, age_days int, ssl_valid boolean")
    blocklist = spark.createDataFrame([(url,)] if listed else [], "url string")
    return V.verdicts(scored, blocklist, rules).first()


@pytest.mark.parametrize(
    "url,prob,listed,result,reason",
    [
        (NEUTRAL, 0.01, False, "SAFE", "low phishing"),
        (NEUTRAL, 0.01, True, "PHISHING", "blocklist"),
        (GOOGLE, 0.9, True, "SAFE", "trusted"),
        (TUMBLR, 0.9, True, "PHISHING", "shared-hosting"),
        (TUMBLR, 0.9, False, "SAFE", "trusted"),
        (GOOGLE, 0.9, False, "SAFE", "trusted"),
        (LOCAL, 0.9, True, "SAFE", "Localhost"),
        (MONACO, 0.9, False, "SAFE", "trusted"),
    ],
)
def test_gate_order(spark, url, prob, listed, result, reason):
    got = judge(spark, url, prob, listed)
    assert got.result == result
    assert any(reason in r for r in got.reasons)


def test_brand_label_off_the_allowlist_is_suspicious(spark):
    rules = R.RuleSet(trusted_roots=("google.com",), shared_hosting_roots=())
    assert judge(spark, MONACO, 0.001, False, rules).result == "SUSPICIOUS"


def test_trailing_slash_and_defang_on_the_blocklist(spark):
    scored = spark.createDataFrame([("http://a.example/x//", 0.1), ("http://a.example", 0.1)], "url string, prob double")
    blocklist = spark.createDataFrame([("hxxp://a[.]example/x/",), ("nodots",)], "url string")
    got = {r.input: r.result for r in V.verdicts(scored, blocklist).collect()}
    assert got == {"http://a.example/x/": "PHISHING", "http://a.example": "SAFE"}


@pytest.mark.parametrize(
    "url,tier",
    [
        ("http://127.0.0.5/x", "localhost"),
        ("https://[::1]/x", "localhost"),
        ("http://localhost:8000/app", "localhost"),
        ("http://paypal-verify.tk/localhost/login", "critical"),
        ("http://45.33.32.156/login", "critical"),
        ("http://192.168.0.1/admin", "critical"),
        ("http://cdn-assets.example/v1.2.3.4/app.js", "model"),
        ("https://google.com", "trusted"),
        ("http://xn--pypal-4ve.com", "critical"),
        ("http://g00gle-verify.com", "critical"),
        ("http://faceb00k-security.net", "critical"),
        ("http://paypal.com", "trusted"),
        ("http://zerodha.com", "model"),
    ],
)
def test_tiers(spark, url, tier):
    df = spark.createDataFrame([(url, 0.2)], "url string, prob double")
    assert V.override_tier(V.parsed(df)).first().tier == tier


def test_record_of_the_heuristic_gate(spark):
    got = judge(spark, "http://paytn.evil.example/login", 0.65, False, age=3, ssl=False)
    assert got.gate == "heuristic"
    assert got.risk_score == 7.95 and got.result == "PHISHING"
    assert got.reasons == [
        "ML: moderate risk detected", "Typo-squatting on 'paytm'", "Suspicious keywords in URL (ML-confirmed)",
        "Domain only 3 days old", "No valid SSL certificate",
    ]
    assert tuple(got.meta) == (3, False)


def test_strict_and_inclusive_thresholds(spark):
    df = spark.createDataFrame([(4.5,), (4.51,), (3.0,), (2.99,)], "p double")
    assert [r[0] for r in df.select(V.result_of(F.col("p"))).collect()] == ["SUSPICIOUS", "PHISHING", "SUSPICIOUS", "SAFE"]
    at_gate = judge(spark, "http://plain-site.example/login", 0.55, False)
    assert "Suspicious keywords in URL (ML-confirmed)" in at_gate.reasons
    assert judge(spark, "http://plain-site.example/x", 0.6, False).pred == 0


def test_a_missing_score_is_never_safe(spark):
    got = judge(spark, NEUTRAL, None, False)
    assert (got.gate, got.result, got.risk_score, got.reasons) == ("unscored", "UNSCORED", None, ["No model score"])
    assert got.heuristic_result == "UNSCORED"
    assert judge(spark, NEUTRAL, None, True).result == "PHISHING"
    assert judge(spark, GOOGLE, None, False).result == "SAFE"
    assert judge(spark, "http://45.33.32.156/x", None, False).result == "PHISHING"


def test_an_unknown_tls_state_counts_as_none(spark):
    unknown, bad, good = (judge(spark, "http://plain-site.example/x", 0.5, False, ssl=s) for s in (None, False, True))
    assert (unknown.risk_score, unknown.reasons) == (bad.risk_score, bad.reasons) == (2.0, good.reasons + ["No valid SSL certificate"])
    assert good.risk_score == 1.5


def test_urls_that_differ_late_have_different_verdicts(spark):
    long = "http://a.example/" + "x" * 3000
    scored = spark.createDataFrame([(long + "1", 0.1), (long + "2", 0.1)], "url string, prob double")
    blocklist = spark.createDataFrame([(long + "1",)], "url string")
    got = {r.input[-1]: (r.result, len(r.input)) for r in V.verdicts(scored, blocklist).collect()}
    assert got == {"1": ("PHISHING", 3018), "2": ("SAFE", 3018)}


def test_scores_round_the_binary_value(spark):
    assert judge(spark, NEUTRAL, 0.345, False).risk_score == 1.03


def test_meta_is_hidden_where_it_is_not_looked_up(spark):
    assert tuple(judge(spark, NEUTRAL, 0.01, False, age=5, ssl=False).meta) == (-1, None)


def test_rule_file(tmp_path):
    path = tmp_path / "rules.json"
    path.write_text(
        '{"brands": ["Acme"], "trusted_roots": ["acme.com"], "scoring": {"W_BRAND": 2, "OTHER": 1}, "limits": {"MAX_URL_LEN": 99}}'
    )
    rules = R.RuleSet.from_json(str(path))
    assert (rules.brands, rules.trusted_roots, rules.w_brand, rules.max_url_len) == (("acme",), ("acme.com",), 2.0, 99)
    assert rules.keywords == R.KEYWORDS


def test_rule_invariants(spark):
    from hostsift.operators.predicates import validate_rules

    assert validate_rules(spark).count() == 0
    broken = R.RuleSet(trusted_roots=("a.com",), t_suspicious=5.0, ml_safe_threshold=0.7)
    kinds = {r.problem for r in validate_rules(spark, broken).collect()}
    assert kinds == {"shared_host_not_trusted", "threshold_order", "verdict_order"}
