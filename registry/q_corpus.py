"""Sources, sinks, sampling, augmentation, corpora (sections A, H3-H5, I)."""

from __future__ import annotations

from pyspark.sql import functions as F

from hostsift import rules as R
from hostsift.functions.urls import normalize_url
from hostsift.operators import augment as A
from hostsift.operators import sampling as Z
from hostsift.plans import corpus as C
from hostsift.plans import verdict as V
from hostsift.session import scratch_path, staged
from hostsift.sources import feeds, sinks
from registry.base import h, hosted, netloc, no_brackets, parsed, query, sql_in, sql_list, strip, with_scheme
from registry.corpus import RULES, derived, given, with_duck
from registry.q_tables import FEED_ROOTS, FEED_TABLES, LISTED, NOISE, TRUSTED

# --- A: sources and sinks -------------------------------------------------------

# Feed lines as they come: comments, padding, lines without a dot.
LINE = "CASE url_id % 5 WHEN 0 THEN '# ' || url WHEN 1 THEN '  ' || url || ' ' WHEN 2 THEN replace(url, '.', '') ELSE url END"
ENTRY = f"trim({LINE})"


@query(
    "read_line_feed",
    with_duck(
        ("fx_urls",), f"l AS (SELECT {ENTRY} AS url FROM fx_urls)",
        select="SELECT lower(url) AS url FROM l WHERE url <> '' AND NOT starts_with(url, '#') AND contains(url, '.')",
    ),
)
def read_line_feed(spark, sf):
    path = scratch_path(spark, "line-feed")
    derived(spark, sf, "fx_urls").select(F.expr(LINE)).write.text(path)
    return feeds.read_line_feed(spark, path, lower=True)


@query(
    "read_keyed_feed",
    with_duck(
        ("fx_urls",),
        select="SELECT 'named' AS variant, url FROM fx_urls UNION ALL SELECT 'second column', url FROM fx_urls",
    ),
)
def read_keyed_feed(spark, sf):
    out = []
    for variant, header in (("named", ("phish_id", "kind", "URL")), ("second column", ("id", "detail", "kind"))):
        path = scratch_path(spark, "keyed-feed")
        columns = [F.col("url_id"), F.col("type"), F.col("url")]
        if variant == "second column":
            columns = [F.col("url_id"), F.col("url"), F.col("type")]
        table = derived(spark, sf, "fx_urls").select(*[c.alias(n) for c, n in zip(columns, header)])
        table.write.option("header", True).option("escape", '"').csv(path)
        out.append(feeds.read_keyed_feed(spark, path).select(F.lit(variant).alias("variant"), "url"))
    return out[0].unionByName(out[1])


RANKED = [parsed("rp", "fx_urls"), "ranked AS (SELECT min(url_id) + 1 AS rank, root AS domain FROM rp "
          "WHERE type = 'legitimate' AND contains(root, '.') GROUP BY root)"]


def ranked(spark, sf):
    """A popularity list: legitimate roots, ranked by first appearance."""
    legit = V.parsed(derived(spark, sf, "fx_urls")).filter("type = 'legitimate'").filter(F.col("root").contains("."))
    return legit.groupBy(F.col("root").alias("domain")).agg((F.min("url_id") + 1).cast("int").alias("rank"))


@query("read_ranked_domains", with_duck(("fx_urls",), *RANKED, select="SELECT CAST(rank AS INT) AS rank, domain FROM ranked"))
def read_ranked_domains(spark, sf):
    path = scratch_path(spark, "ranked")
    ranked(spark, sf).select("rank", "domain").write.csv(path)
    return feeds.read_ranked_domains(spark, path)


LABEL = "CASE WHEN type = 'phishing' THEN CASE url_id % 3 WHEN 0 THEN '1' WHEN 1 THEN 'bad' ELSE 'Phishing' END ELSE 'good' END"


@query("read_mixed_labelled", with_duck(("fx_urls",), select="SELECT url, type FROM fx_urls"))
def read_mixed_labelled(spark, sf):
    path = scratch_path(spark, "mixed")
    table = derived(spark, sf, "fx_urls").select(F.col("url").alias("URL"), F.expr(LABEL).alias("Label"))
    table.write.option("header", True).option("escape", '"').csv(path)
    return feeds.read_mixed_labelled(spark, path)


@query(
    "read_feed_glob",
    with_duck(
        ("fx_feed_old", "fx_feed_new"),
        select="""SELECT lower(url) AS url, count(*) AS n FROM (SELECT url FROM fx_feed_old UNION ALL
            SELECT url FROM fx_feed_new) WHERE contains(url, '.') GROUP BY 1""",
    ),
)
def read_feed_glob(spark, sf):
    base = scratch_path(spark, "feeds")
    derived(spark, sf, "fx_feed_old").write.text(f"{base}/active")
    derived(spark, sf, "fx_feed_new").write.text(f"{base}/extra_a")
    entries = feeds.read_feed_glob(spark, f"{base}/active", f"{base}/extra_*")
    return entries.groupBy("url").agg(F.count(F.lit(1)).alias("n"))


@query(
    "feed_line_counts",
    with_duck(
        ("fx_feed_old", "fx_feed_new"),
        select="""SELECT feed, count(*) AS entries FROM (SELECT 'active' AS feed, url FROM fx_feed_old UNION ALL
            SELECT 'extra_a', url FROM fx_feed_new) WHERE contains(url, '.') GROUP BY feed""",
    ),
)
def feed_line_counts(spark, sf):
    """Entries per file, added up for each feed, which Spark writes as several files."""
    base = scratch_path(spark, "feeds")
    derived(spark, sf, "fx_feed_old").write.text(f"{base}/active")
    derived(spark, sf, "fx_feed_new").write.text(f"{base}/extra_a")
    counts = feeds.feed_line_counts(feeds.read_feed_glob(spark, f"{base}/active", f"{base}/extra_*"))
    feed = F.substring_index(F.substring_index("feed_file", "/", -2), "/", 1).alias("feed")
    return counts.groupBy(feed).agg(F.sum("entries").alias("entries"))


@query("optional_source", with_duck(("fx_urls",), select="SELECT type, count(*) AS rows FROM fx_urls GROUP BY type"))
def optional_source(spark, sf):
    missing = scratch_path(spark, "no-such-feed")
    absent = feeds.optional_source(spark, lambda: feeds.read_mixed_labelled(spark, missing))
    table = derived(spark, sf, "fx_urls").select("url", "type").unionByName(absent)
    return table.groupBy("type").agg(F.count(F.lit(1)).alias("rows"))


@query("read_pruned_phishing_urls", with_duck(("fx_urls",), select="SELECT url FROM fx_urls WHERE type = 'phishing'"))
def read_pruned_phishing_urls(spark, sf):
    path = scratch_path(spark, "labelled")
    sinks.write_labelled_dataset(derived(spark, sf, "fx_urls"), path)
    return feeds.read_pruned_phishing_urls(spark, path)


@query("write_labelled_dataset", with_duck(("fx_urls",), select="SELECT url, type FROM fx_urls"))
def write_labelled_dataset(spark, sf):
    path = scratch_path(spark, "labelled-csv")
    sinks.write_labelled_dataset(derived(spark, sf, "fx_urls"), path, "csv")
    return feeds.read_mixed_labelled(spark, path)


REPORTS = [
    parsed("fp_p", "(SELECT * FROM fx_scored WHERE label = 0 AND prob > 0.6)"),
    "fp_r AS (SELECT *, CASE WHEN url_id % 3 = 0 THEN '=1+1' ELSE 'my site' END AS reason FROM fp_p)",
]


def reports(spark, sf):
    wrong = derived(spark, sf, "fx_scored").filter("label = 0 AND prob > 0.6")
    reason = F.expr("CASE WHEN url_id % 3 = 0 THEN '=1+1' ELSE 'my site' END").alias("reason")
    return wrong.select("url", reason, F.timestamp_seconds(F.lit(1706659200) + F.col("url_id")).alias("reported"))


@query(
    "append_fp_reports",
    with_duck(
        ("fx_scored",), *REPORTS,
        select="""SELECT norm AS url, 'legitimate' AS type, host AS domain, CASE WHEN reason LIKE '=%' THEN '''' || reason
            ELSE reason END AS reason,
            strftime(make_timestamp((1706659200 + url_id) * 1000000), '%Y-%m-%dT%H:%M:%S.%f') AS reported FROM fp_r""",
    ),
)
def append_fp_reports(spark, sf):
    path = scratch_path(spark, "fp-reports")
    sinks.append_fp_reports(reports(spark, sf), path)
    return spark.read.schema(feeds.FP_REPORT).parquet(path)


@query("read_fp_reports", with_duck(("fx_scored",), *REPORTS, select="SELECT norm AS url, 'legitimate' AS type FROM fp_r"))
def read_fp_reports(spark, sf):
    path = scratch_path(spark, "fp-reports")
    sinks.append_fp_reports(reports(spark, sf), path)
    return feeds.read_fp_reports(spark, path)


# --- I: splits and samples --------------------------------------------------------


@query(
    "balance_classes",
    with_duck(
        ("fx_urls",),
        f"""r AS (SELECT url, type, row_number() OVER (PARTITION BY type ORDER BY {h("url || 'bal'")}, url) AS rn
            FROM fx_urls)""",
        "n AS (SELECT least(count(*) FILTER (type = 'phishing'), count(*) FILTER (type = 'legitimate'), 150000) AS n "
        "FROM fx_urls)",
        select="SELECT url, type FROM r, n WHERE rn <= n",
    ),
)
def balance_classes(spark, sf):
    return Z.balance_classes(derived(spark, sf, "fx_urls").select("url", "type"))


SPLIT = f"CASE WHEN {h("root || 'split'")} % 1000 < 200 THEN 'test' WHEN {h("root || 'split'")} % 1000 < 360 THEN 'calibrate' ELSE 'train' END"


@query("grouped_split", with_duck(("fx_urls",), parsed("p", "fx_urls"), select=f"SELECT url_id, root, {SPLIT} AS split FROM p"))
def grouped_split(spark, sf):
    return Z.grouped_split(V.parsed(derived(spark, sf, "fx_urls"))).select("url_id", "root", "split")


@query(
    "split_leakage_check",
    with_duck(
        ("fx_urls",), parsed("p", "fx_urls"),
        f"s AS (SELECT root, {SPLIT} AS split FROM p)",
        select="SELECT root, min(split) AS first_split, max(split) AS last_split FROM s GROUP BY root HAVING count(DISTINCT split) > 1",
    ),
)
def split_leakage_check(spark, sf):
    return Z.split_leakage(Z.grouped_split(V.parsed(derived(spark, sf, "fx_urls"))))


HOLDOUT = [
    f"cl AS (SELECT root FROM novel WHERE root NOT IN (SELECT root FROM lg_roots) AND root NOT IN {LISTED})",
    f"ho AS (SELECT root, row_number() OVER (ORDER BY {h("root || 'hold'")}, root) AS rn, count(*) OVER () AS n FROM cl)",
]
HOLDOUT_OUT = """SELECT 'http://' || root AS url, 'phishing' AS type,
    CASE WHEN rn <= least(5000, n // 5) THEN 'holdout' ELSE 'train' END AS part FROM ho"""


@query(
    "holdout_split",
    with_duck(
        ("fx_urls",), parsed("p", "fx_urls"), "cl AS (SELECT DISTINCT root FROM p)", HOLDOUT[1], select=HOLDOUT_OUT
    ),
)
def holdout_split(spark, sf):
    return Z.holdout_split(V.parsed(derived(spark, sf, "fx_urls")).select("root"))


@query("harvest_fresh_roots", with_duck(FEED_TABLES, *FEED_ROOTS, *HOLDOUT, select=HOLDOUT_OUT))
def harvest_fresh_roots(spark, sf):
    known = derived(spark, sf, "fx_urls").filter("type = 'legitimate' OR source <> 'feed0'")
    return C.harvest_fresh_roots(normalized(derived(spark, sf, "fx_feed_new")), normalized(known))


@query(
    "harvest_report",
    with_duck(
        FEED_TABLES, *FEED_ROOTS,
        select=f"""SELECT count(*) AS novel, count(*) FILTER (root IN (SELECT root FROM lg_roots)) AS in_legit,
            count(*) FILTER (root IN {TRUSTED}) AS in_trusted, count(*) FILTER (root IN {NOISE}) AS in_noise FROM novel""",
    ),
)
def harvest_report(spark, sf):
    known = derived(spark, sf, "fx_urls").filter("type = 'legitimate' OR source <> 'feed0'")
    return C.harvest_report(normalized(derived(spark, sf, "fx_feed_new")), normalized(known))


def normalized(df):
    return df.withColumn("url", normalize_url(F.col("url")))


@query(
    "head_plus_tail_sample",
    with_duck(
        ("fx_urls",), *RANKED,
        f"t AS (SELECT *, row_number() OVER (ORDER BY {h("domain || 'tail'")}, domain) AS rn FROM ranked WHERE rank > 200)",
        select="""SELECT CAST(rank AS INT) AS rank, domain FROM ranked WHERE rank <= 200
            UNION ALL SELECT CAST(rank AS INT), domain FROM t WHERE rn <= 100""",
    ),
)
def head_plus_tail_sample(spark, sf):
    return Z.head_plus_tail_sample(ranked(spark, sf).select("rank", "domain"), 200, 300)


@query(
    "one_per_root_sample",
    with_duck(
        ("fx_urls",), parsed("p", "fx_urls"),
        f"""f AS (SELECT root, url, host, row_number() OVER (PARTITION BY root ORDER BY {h("url || 'probe'")}, url, host) AS rn
            FROM p WHERE type = 'phishing' AND contains(host, '.'))""",
        select=f"SELECT root, url, host FROM f WHERE rn = 1 ORDER BY {h("root || 'probe'")}, root LIMIT 100",
    ),
)
def one_per_root_sample(spark, sf):
    return Z.one_per_root_sample(V.parsed(derived(spark, sf, "fx_urls")), "phishing")


@query(
    "sample_per_source",
    with_duck(
        ("fx_urls",),
        f"""r AS (SELECT url_id, url, source, type, row_number() OVER (PARTITION BY source, type
            ORDER BY {h("url || 'src'")}, url, url_id) AS rn FROM fx_urls)""",
        select="SELECT url_id, url, source, type FROM r WHERE rn <= 60",
    ),
)
def sample_per_source(spark, sf):
    return Z.sample_per_source(derived(spark, sf, "fx_urls").select("url_id", "url", "source", "type"), 60)


# --- I: augmentation ----------------------------------------------------------------


def added_path(key: str, salt: str = "") -> str:
    words, n = sql_list(R.PATH_WORDS), len(R.PATH_WORDS)
    hs = lambda s: h(f"{key} || '{salt}{s}'")
    word = lambda number: f"({words})[{number} % {n} + 1]"
    seg = h(f"{key} || '{salt}seg' || i")
    section = word(hs("section"))
    return f"""'/' || CASE WHEN {hs('deep')} % 100 < 35 THEN
            array_to_string([{word(seg)} for i in range(1, {hs('depth')} % 6 + 3)], '/')
        WHEN {hs('form')} % 3 = 0 THEN {section}
        WHEN {hs('form')} % 3 = 1 THEN {section} || '/' || {word(hs('page'))}
        ELSE {section} || '?item=' || ({hs('item')} % 10000) END"""


def bare_of(url: str) -> str:
    u = with_scheme(strip(no_brackets(url)))
    return f"lower(string_split({u}, '://')[1]) || '://' || {netloc(u)}"


def pathed(url: str, salt: str) -> str:
    return f"regexp_replace({bare_of(url)}, '/+$', '') || {added_path(url, salt)}"


@query("add_path", with_duck(("fx_urls",), select=f"SELECT url_id, {pathed('url', '')} AS pathed FROM fx_urls"))
def add_path(spark, sf):
    return derived(spark, sf, "fx_urls").select("url_id", A.add_path(F.col("url")).alias("pathed"))


def augmented_cte(name: str, base: str) -> list[str]:
    """bare and pathed rows of ``base`` (url, type): url, label."""
    return [
        f"{name}_b AS (SELECT url, type, {bare_of('url')} AS bare FROM {base})",
        f"""{name}_u AS (SELECT bare AS url, type FROM {name}_b WHERE contains(string_split(bare, '//')[-1], '.')
            UNION ALL SELECT {pathed('url', 'aug')}, type FROM {name}_b WHERE contains(string_split(bare, '//')[-1], '.'))""",
        f"{name} AS (SELECT url, CAST(max(CASE WHEN type = 'phishing' THEN 1 ELSE 0 END) AS INT) AS label FROM {name}_u GROUP BY url)",
    ]


@query("augment_bare_pathed", with_duck(("fx_urls",), *augmented_cte("g", "fx_urls"), select="SELECT url, label FROM g"))
def augment_bare_pathed(spark, sf):
    return A.augment_bare_pathed(derived(spark, sf, "fx_urls"))


def expanded(base: str, n: int, salt: str) -> str:
    variant = added_path("url || '#' || k", salt)
    return f"""SELECT unnest(list_slice(list_reverse(x.seen), 1, {n + 1})) AS url FROM (
        SELECT list_reduce([[v] for v in list_concat([url, {bare_of('url')}],
            [regexp_replace({bare_of('url')}, '/+$', '') || ({variant}) for k in range(1, {6 * n + 1})])],
            lambda acc, v: CASE WHEN list_contains(acc, v[1]) THEN acc ELSE list_concat(v, acc) END) AS seen FROM {base}) x"""


@query("expand_variants", with_duck(("fx_urls",), select=expanded("pages", 4, "var")))
def expand_variants(spark, sf):
    return A.expand_variants(given(spark, sf, "pages").select("url"), 4)


@query(
    "legit_from_ranked",
    with_duck(
        ("fx_urls",), *RANKED, "rb AS (SELECT 'https://' || domain AS b FROM ranked)",
        select=f"SELECT b AS url FROM rb UNION ALL SELECT {pathed('b', 'rank')} FROM rb",
    ),
)
def legit_from_ranked(spark, sf):
    return A.legit_from_ranked(ranked(spark, sf))


@query(
    "oversample",
    with_duck(("fx_urls",), select="SELECT url FROM fx_urls UNION ALL SELECT url FROM fx_urls"),
)
def oversample(spark, sf):
    return A.oversample(derived(spark, sf, "fx_urls").select("url"))


def synthetic_ctes(ids: str) -> list[str]:
    words, n = sql_list(R.KEYWORDS), len(R.KEYWORDS)
    hs = lambda s: h(f"key || '{s}'")

    def of(values, salt: str) -> str:
        return f"({sql_list(values)})[{hs(salt)} % {len(values)} + 1]"

    return [
        f"""sy AS (SELECT 'adv:' || {ids} || ':' AS key, {of(R.BRANDS, 'brand')} AS br, {of(R.KEYWORDS, 'word')} AS wd,
            CASE WHEN {hs('obscured')} % 100 < 50 THEN translate(br, 'oleia', '01314') ELSE br END AS shown,
            CASE WHEN {hs('joint')} % 100 < 70 THEN '-' ELSE '.' END AS joint,
            array_to_string([({words})[({hs('start')} + ({hs('stride')} % {n - 1} + 1) * i) % {n} + 1]
                for i in range(0, {hs('words')} % 3 + 2)], '-') AS salad,
            CASE WHEN {hs('front')} % 100 < 50 THEN shown || joint || wd ELSE wd || joint || shown END AS branded,
            'http://' || CASE WHEN {hs('kind')} % 100 < 45 THEN salad ELSE branded END || {of(R.HOST_TAILS, 'tail')} || '.'
                || {of(R.GENERATOR_TLDS, 'tld')} AS u FROM part)""",
        f"synth AS (SELECT DISTINCT CASE WHEN {hs('pathed')} % 100 < 50 THEN {pathed('u', 'adv')} ELSE u END AS url FROM sy)",
    ]


@query(
    "synthesize_adversarial",
    with_duck((), *synthetic_ctes("p_partkey"), select="SELECT url, 'phishing' AS type FROM synth"),
)
def synthesize_adversarial(spark, sf):
    return A.synthesize_adversarial(given(spark, sf, "part"), "p_partkey")


# --- I: corpora -----------------------------------------------------------------------


@query(
    "build_labelled_corpus",
    with_duck(
        ("fx_sources",),
        """r AS (SELECT url, type, row_number() OVER (PARTITION BY url ORDER BY prio, line_no, type) AS rn FROM fx_sources
            WHERE url IS NOT NULL)""",
        select="SELECT url, type FROM r WHERE rn = 1",
    ),
)
def build_labelled_corpus(spark, sf):
    table = derived(spark, sf, "fx_sources")
    return C.labelled_corpus([table.filter(F.col("source") == s) for s in ("phish_a", "phish_b", "legit", "mixed")])


CORPUS = [
    *synthetic_ctes("p_partkey"),
    *FEED_ROOTS,
    *HOLDOUT,
    f"""tc_all AS (SELECT url, type FROM fx_urls WHERE source <> 'pages'
        UNION ALL SELECT url, 'phishing' FROM synth UNION ALL SELECT url, 'phishing' FROM synth
        UNION ALL SELECT url, type FROM ({HOLDOUT_OUT}) WHERE part = 'train'
        UNION ALL SELECT url, 'legitimate' FROM pages)""",
    hosted("tc_root", "(SELECT * FROM tc_all WHERE url IS NOT NULL)"),
    f"""tc_clean AS (SELECT url, type FROM tc_root WHERE NOT (type = 'phishing' AND root IN {sql_in(RULES.trusted_roots)})
        AND root NOT IN {sql_in(R.NOISE_ROOTS)})""",
    f"""tc_rank AS (SELECT url, type, row_number() OVER (PARTITION BY type ORDER BY {h("url || 'bal'")}, url) AS rn
        FROM tc_clean)""",
    "tc_bal AS (SELECT url, type FROM tc_rank, (SELECT least(count(*) FILTER (type = 'phishing'), "
    "count(*) FILTER (type = 'legitimate'), 150000) AS n FROM tc_clean) WHERE rn <= n)",
    *augmented_cte("tc_aug", "tc_bal"),
    hosted("tc_out", "tc_aug"),
]


@query(
    "build_training_corpus",
    with_duck(FEED_TABLES, *CORPUS, select=f"SELECT url, label, root, {SPLIT} AS split FROM tc_out"),
)
def build_training_corpus(spark, sf):
    """Known and synthetic URLs, and the roots that the feed harvest adds for training."""
    base = derived(spark, sf, "fx_urls").filter("source <> 'pages'")
    # Generated once and stored, as a corpus job would.
    synthetic = staged(A.synthesize_adversarial(given(spark, sf, "part"), "p_partkey"), "synthetic")
    fresh = staged(harvest_fresh_roots(spark, sf).filter("part = 'train'").select("url"), "fresh")
    return C.training_corpus(base, synthetic, given(spark, sf, "pages"), fresh)


@query(
    "build_legit_dataset",
    with_duck(
        ("fx_scored",), *RANKED, *REPORTS, "rb AS (SELECT 'https://' || domain AS b FROM ranked)",
        f"seeds AS ({expanded('pages', 9, 'seed')})", f"told AS ({expanded('(SELECT norm AS url FROM fp_r)', 4, 'report')})",
        select=f"""SELECT url, 'legitimate' AS type FROM (SELECT b AS url FROM rb UNION SELECT {pathed('b', 'rank')} FROM rb
            UNION SELECT url FROM seeds UNION SELECT url FROM told)""",
    ),
)
def build_legit_dataset(spark, sf):
    told = sinks.fp_report_rows(reports(spark, sf))
    return C.legit_dataset(ranked(spark, sf), given(spark, sf, "pages"), told)
