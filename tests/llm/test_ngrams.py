"""The language model: exact base columns, levels of the filter, shards, and held-out probability."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import plain
import pyarrow as pa
import pytest
from cases import ROWS
from pyspark.sql import functions as F

from hostsift.llm import ngrams, queries
from hostsift.llm.ngrams import FilterShard, filter_parts, fit_language_model, levels_of, score_texts, words

END = object()


def tokens(text):
    return [*plain.words(plain.lower(text or "")), END]


def base_columns(training, texts):
    counts = Counter(t for x in training for t in tokens(x))
    n, v = sum(counts.values()), len(counts)
    for x in texts:
        own = tokens(x)
        yield len(own), sum(t in counts for t in own), n, sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in own)


def held_out(key):
    return zlib.crc32(("" if key is None else str(key)).encode()) % 7 == 2


@pytest.mark.parametrize("held_words", [0, 30, 200_000])
def test_base_columns_are_exact(spark, edge, held_words):
    model = fit_language_model(edge.where(~queries.unseen(F.col("doc_id"))))
    got = score_texts(edge, model, held_words=held_words).collect()
    want = list(base_columns([t for k, t in ROWS if not held_out(k)], [t for _, t in ROWS]))
    key = lambda r: (r[0] is None, r[0], r[1])
    for r, (k, w) in zip(sorted(got, key=key), sorted(((k, w) for (k, _), w in zip(ROWS, want)), key=lambda x: (x[0] is None, x[0], x[1][0]))):
        assert (r.doc_id, r.n_tokens, r.n_known, r.train_tokens) == (k, *w[:3])
        assert r.base_score == pytest.approx(w[3]) and -400 * r.n_tokens < r.score < 0


def test_query_matches_definition(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.QUERIES["op13_log_frequency_lm"](spark, sf_dir).collect()}
    want = base_columns([t for k, t in docs if not held_out(k)], [t for _, t in docs])
    for (k, _), w in zip(docs, want):
        r = got[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held_out(k), *w[:3]) and r.base_score == pytest.approx(w[3])


def exact_score(training, text, prior, base):
    """The same probabilities with the levels of exact counts."""
    counts, START = Counter(), object()
    for x in training:
        s = [START, *tokens(x)]
        counts.update([(t,) for t in s] + list(zip(s, s[1:])))
    n = sum(c for t, c in counts.items() if len(t) == 1 and t[0] is not START)
    v = sum(len(t) == 1 and t[0] is not START for t in counts)

    def mean(gram):
        if not counts[gram]:
            return 0.0
        q = int(levels_of(np.array([counts[gram]]), base)[0])
        return (base ** (q - 1) + max(base ** (q - 1), base**q - 1)) / 2

    s, total = [START, *tokens(text)], 0.0
    for a, b in zip(s, s[1:]):
        p, c, h = (mean((b,)) + 1) / (n + v + 1), mean((a, b)), mean((a,))
        total += math.log10(((c if h else 0) + prior * p) / (max(h, c) + prior))
    return total


def test_scores_are_those_of_exact_levels_but_for_false_positives(spark, sf_dir, docs):
    texts = [t for _, t in docs]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    roomy = fit_language_model(frame.where(~queries.unseen(F.col("doc_id"))), bits=40, probes=12)
    got = {r.doc_id: r.score for r in score_texts(frame, roomy).collect()}
    training = [t for k, t in docs if not held_out(k)]
    want = {k: exact_score(training, t, roomy.prior, roomy.base) for k, t in docs}
    off = {k: got[k] / want[k] - 1 for k in want if got[k] != pytest.approx(want[k], rel=1e-6)}
    assert not off
    usual = fit_language_model(frame.where(~queries.unseen(F.col("doc_id"))))
    off = [r.score / want[r.doc_id] - 1 for r in score_texts(frame, usual).collect()]
    assert max(map(abs, off)) < 0.05 and len(texts) == len(off)


def test_shards_change_nothing(spark, sf_dir):
    docs = queries.documents(spark, sf_dir)
    for order in (1, 2, 3):
        model = fit_language_model(docs, order=order, bits=30, probes=9)
        whole = {r.doc_id: r.score for r in score_texts(docs, model).collect()}
        size = model.table.agg(F.sum(F.octet_length("bits"))).first()[0]
        sharded = {r.doc_id: r.score for r in score_texts(docs, model, shard_bytes=size // 3 + 1).collect()}
        assert sharded == pytest.approx(whole)


def test_held_out_texts_are_likelier_than_by_base(spark):
    got = queries.QUERIES["op13_log_frequency_lm"](spark, "/root/testdata/sf0.01").where("held_out")
    base, score = got.agg(F.sum("base_score"), F.sum("score")).first()
    assert score > 0.95 * base


def test_levels_and_false_positives():
    rng = np.random.default_rng(5)
    keys = rng.integers(0, 2**64, 30_000, np.uint64)
    counts = np.minimum(rng.zipf(1.5, len(keys)), 10**6)
    deal = (keys >> np.uint64(64 - ngrams.DEAL_BITS)).astype(np.int64) >> 8 << 8  # fewer and larger parts
    keys = keys & np.uint64(2**48 - 1) | deal.astype(np.uint64) << np.uint64(48)
    shard = FilterShard(0, 2**16 - 1, list(filter_parts(deal, keys, counts, 2.0, 10, 5)), 5)
    got, true = shard.levels(keys), levels_of(counts, 2.0)
    assert (got >= true).all() and (got > true).mean() < 0.02  # never too low, seldom too high
    strange = rng.integers(0, 2**48, 30_000, np.uint64) | rng.choice(deal, 30_000).astype(np.uint64) << np.uint64(48)
    assert (shard.levels(strange) > 0).mean() < 0.02
    assert (levels_of(np.array([1, 2, 3, 4, 8, 1023, 1024]), 2.0) == [1, 2, 2, 3, 4, 10, 11]).all()


def test_nothing_to_learn_or_to_score(edge, nothing):
    empty = fit_language_model(nothing)
    assert (empty.tokens, empty.types) == (0, 0)
    rows = score_texts(edge, empty).collect()
    assert Counter(r.doc_id for r in rows) == Counter(k for k, _ in ROWS)
    assert all(r.n_known == 0 and r.base_score == 0 and r.score == 0 for r in rows)
    assert score_texts(nothing, fit_language_model(edge)).count() == 0


def test_words_of_odd_texts():
    rng = random.Random(14)
    for _ in range(300):
        text = "".join(rng.choices("aB \t\n\x0b\x0c\r\x1c\x85 Ééß日", k=rng.randint(0, 12)))
        assert [w.decode() for w in words(text)] == plain.words(plain.lower(text))


def test_any_name_of_the_key(spark):
    rows = spark.createDataFrame([(1, "a b a b", "x"), (2, None, "y")], "rest long, text string, word string")
    model = fit_language_model(rows)
    assert sorted((r["rest"], r.n_tokens) for r in score_texts(rows, model, key="rest").collect()) == [(1, 5), (2, 1)]


def test_an_ngram_is_probed_once_however_often_it_comes(monkeypatch):
    keys = np.random.default_rng(5).integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2)
    counts = np.arange(1, 51)
    shard = ngrams.FilterShard(0, (1 << ngrams.DEAL_BITS) - 1, list(ngrams.filter_parts(ngrams._deals(keys), keys, counts, 2.0, 10, 4)), 4)
    asked, hashes = [], ngrams._hashes
    monkeypatch.setattr(ngrams, "_hashes", lambda keys, *which: (asked.append(len(keys)), hashes(keys, *which))[1])
    found = shard.levels(np.tile(keys, 40))
    assert max(asked) == 50 and (found.reshape(40, 50) >= ngrams.levels_of(counts, 2.0)).all()
    assert (found.reshape(40, 50) == shard.levels(keys)).all() and len(shard.levels(keys[:0])) == 0


def test_words_are_numbered_as_they_are_split():
    texts = [None, "", " ", "\ta  B\x0b", "É\x1c\x85 a\r\nZz.\x0c", "a b a"]
    for kind in (pa.string(), pa.large_string()):
        batch = pa.RecordBatch.from_arrays([pa.array(texts, kind)], ["text"])
        ((_, t),) = ngrams._tokens(iter([batch]))
        split = [[t.words.names[i] for i in t.ids[a:b]] for a, b in zip(t.start, t.start[1:])]
        assert split == [[ngrams.START, *ngrams.words(x), ngrams.END] for x in texts]
