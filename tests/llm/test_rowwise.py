"""Operators that look at one row at a time: licenses, quality, languages, pieces."""

import hashlib
import random
import re

import plain
import public_tokenizers
import pytest
import regex
import sentencepiece
from cases import EXTRA, ROWS
from pyspark.sql import functions as F

from hostsift.llm import queries
from hostsift.llm.common import table
from hostsift.llm.language import BUCKET_BITS, _hashes, _smallest, fit_filters, held_out, identify_languages
from hostsift.llm.licenses import NOTICES, PHRASES, scan_licenses, scanner
from hostsift.llm.pieces import PieceTable, decode_pieces, encode_pieces
from hostsift.llm.quality import QualityRules, measure, quality_rules

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def base_scan(text):
    ws = WORD.findall(plain.lower(text or ""))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(ws)) if ws[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(ws), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_license_base_columns(spark, sf_dir, edge, docs):
    got = queries.QUERIES["op1_license_scan"](spark, sf_dir).collect()
    texts = dict(docs)
    assert len(got) == len(docs)
    for r in got:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_scan(texts[r.doc_id])
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
    out = scan_licenses(edge)
    assert set(edge.columns) < set(out.columns)
    for r in out.collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_scan(r.text)
        assert 0 <= r.score <= 1 and (r.source, r.part) == ("s", "x")


def test_fuzzy_notices_match_a_search_without_seeds():
    find = scanner(tuple(PHRASES.items()), NOTICES)
    rng = random.Random(3)
    for trial in range(400):
        n = rng.choice(NOTICES)
        text = list(n.text)
        for _ in range(rng.randint(0, n.edits + 2)):
            i = rng.randrange(len(text))
            text[i : i + 1] = rng.choice([[], ["x"], [text[i], "e"], [" "]])
        whole = " ".join(f"some words {''.join(text)} and more of the mit and license kind".split())
        by_seed = {(x[0].text, *x[1:]) for x in find.fuzzy(whole)}
        by_search = {
            (m.text, sum(x.fuzzy_counts), x.start(), x.end())
            for m in NOTICES for x in regex.finditer(rf"(?e)\b(?:{regex.escape(m.text)}){{e<={m.edits}}}\b", whole) if x[0] and m.stands(x[0])
        }
        assert by_seed == by_search, whole


LABELLED = {
    "Released under the MIT license.": "mit", "the MIT Licence applies": "mit", "MIT licensed": "mit", "see MIT-License": "mit",
    "Permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
    "Permission is hearby granted, free of charge to any person obtainning a copy of it": "mit",
    "Apache License, Version 2.0": "apache", "the Apache Licence": "apache", "Apache licensed code": "apache",
    "You may not use this file except in compliance with the License.": "apache",
    "you may not use these file except in compliance with the licence": "apache",
    "GNU General Public License": "gpl", "general public licence v3": "gpl", "General Public Licenses": "gpl",
    "GNU Lesser General Public Licence": "lgpl", "Lesser General Public License": "gpl,lgpl", "Affero General Public Licence": "agpl",
    "This program is free software: you can redistribute it and/or modify it": "gpl",
    "this programme is free software; you can re-distribute it and/or modify it": "gpl",
    "Redistribution and use in source and binary forms, with or without": "bsd", "redistribution or use in source and binary form": "bsd",
    "Mozilla Public License 2.0": "mpl", "Mozilla Public Licence": "mpl",
    "licensed under CC BY 4.0": "cc-by", "Licensed under CC-BY-SA 4.0": "cc-by-sa", "licensed under CC BY-ND": "cc-by-nd",
    "licenced under CC BY-NC": "cc-by-nc", "licensed under CC BY-NC-SA 3.0": "cc-by-nc-sa", "licensed under cc by nc nd": "cc-by-nc-nd",
    "Creative Commons Attribution 4.0": "cc-by", "Creative Commons Attribution-ShareAlike": "cc-by-sa",
    "creative commons attribution share alike": "cc-by-sa", "Creative Commons Attribution-NoDerivatives": "cc-by-nd",
    "Creative Commons Attribution-NonCommercial": "cc-by-nc", "creative common attribution non commercial": "cc-by-nc",
    "Creative Commons Attribution-NonCommercial-ShareAlike": "cc-by-nc-sa",
    "Creative Commons Attribution-NonCommercial-NoDerivs 2.0": "cc-by-nc-nd",
    "Permission to use, copy, modify, and/or distribute this software for any purpose": "isc",
    "Permission to use, copy, modify and distribute this software and its documentation for any purpose": "postgresql",
    "All rights reserved.": "proprietary", "All right reserved": "proprietary", "MIT license. All rights reserved": "mit",
}
NEAR_MISSES = [
    "the kit license fee", "it license costs", "bit license", "a mitt license", "summit license", "limit license plates", "MIT lecture",
    "MIT and its license office", "driver license", "the license", "fishing license", "apaches license", "Apache licking", "an apache helicopter",
    "Apace license", "general publicity license", "generals public licensing board", "the general public", "public license", "a general license",
    "Eclipse Public License", "European Union Public Licence", "Common Public License", "Mosella Public Licence",
    "you may use this file if you comply with our terms", "you may not use this door except in emergencies",
    "this program is fine software and you can distribute it", "redistribution of wealth and use of force", "binary forms and source texts",
    "licensed under CCTV by law", "licensed under section 4", "licensed under CD by NC", "cc by", "creative common sense attribution",
    "Creative Commons Zero", "creative commons contribution", "permission to use the car for any purpose",
    "Permission to use, copy, modify, and distribute this software for any purpose", "permission to copy this software",
    "permission is granted to any person", "all rights observed", "human rights reserved", "all rites preserved",
]


def test_labels_of_notices_and_of_what_is_near_them():
    find = scanner(tuple(PHRASES.items()), NOTICES)
    assert len(LABELLED) >= 40 and len(NEAR_MISSES) >= 40
    assert {t: find.scan(f"Some words. {t} and more.")[5] for t in LABELLED} == LABELLED
    assert {t: find.scan(f"Some words, {t} and more.")[5] for t in NEAR_MISSES} == dict.fromkeys(NEAR_MISSES, "")


def test_notice_spans_point_into_the_raw_text():
    text = "Ünder the  G.N.U.\nGeneral  Public Licence (3)"
    row = scanner(tuple(PHRASES.items()), NOTICES).scan(text)
    label, _, edits, start, end, first, count = row[-1][0]
    assert (label, edits, text[start:end], first, count) == ("gpl", 1, "General  Public Licence", 5, 3)
    assert row[1] == 0 and row[5] == "gpl"


def test_quality_matches_definitions(spark, sf_dir, edge, docs):
    texts = dict(docs)
    got = queries.QUERIES["op9_quality_rules"](spark, sf_dir).collect()
    for r in got:
        assert {c: r[c] for c in plain.quality(None)} == plain.quality(texts[r.doc_id])
        assert not (r.base_failed and r.kept)
    rules = QualityRules()
    for text in [t for _, t in docs[:60]] + ["a b c d e f g " * 20, "x y\n" * 30 + "z"]:
        *_, line, dups, tops = measure(text, rules)
        assert dups == pytest.approx([plain.later_share(text, n) for n, _ in rules.dup_ngram])
        assert tops == pytest.approx([plain.top_share(text, n) for n, _ in sorted(rules.top_ngram)])
    out = quality_rules(edge).collect()
    assert len(out) == len(ROWS) and all(r.source == "s" and r.part == "x" for r in out)
    assert {r.text: r.n_words for r in out} == {t: len(plain.words(t)) for _, t in ROWS}


def test_quality_keeps_clean_and_rejects_junk(spark, sf_dir):
    labels = table(spark, "/root/testdata/sf0.01", "labels")
    judged = queries.QUERIES["op9_quality_rules"](spark, "/root/testdata/sf0.01").join(labels, "doc_id")
    good = judged.where("quality = 1 AND NOT base_failed").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    bad = judged.where("quality = 0").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert good > 0.99 and bad < 0.02


def test_language_accuracy_and_undetermined(spark, sf_dir, edge, nothing):
    got = queries.QUERIES["op2_language_filters"](spark, "/root/testdata/sf0.01")
    joined = got.join(table(spark, "/root/testdata/sf0.01", "documents"), "doc_id").where("held_out")
    assert joined.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.97
    filters = fit_filters(table(spark, sf_dir, "documents").where(~held_out(F.col("doc_id"))))
    out = {r.text: r for r in identify_languages(edge, filters).collect()}
    for _, t in ROWS:
        letters = t is not None and any(c.isalpha() for c in t)
        assert (out[t].lang_pred in filters.languages) == letters and (out[t].lang_pred == "und") != letters
        assert 0 <= out[t].score <= 1
    none = fit_filters(nothing)
    assert none.languages == () and {r.lang_pred for r in identify_languages(edge, none).collect()} == {"und"}
    assert identify_languages(nothing, filters).count() == 0


def test_predictions_are_those_of_exact_sets(spark, sf_dir):
    """Sets of n-grams in place of the filters: the same language for every document, and hits beyond them as rare as stated."""
    docs = table(spark, sf_dir, "documents")
    filters = fit_filters(docs.where(~held_out(F.col("doc_id"))))
    roomy = fit_filters(docs.where(~held_out(F.col("doc_id"))), rows=1 << 22, hashes=4)  # next to no false positives
    beyond = total = 0
    for r in docs.collect():
        exact = roomy.predict(r.text)
        got = filters.predict(r.text)
        assert got[0] == exact[0] and got[2] == pytest.approx(exact[2], abs=0.03)
        for h in _hashes(r.text or "", filters.n):
            many, few = filters.masks(h)[:, 0], roomy.masks(h)[:, 0]
            assert (few & ~many == 0).all()
            absent = len(h) * len(filters.languages) - int(sum(bin(int(x)).count("1") for x in few))
            beyond += int(sum(bin(int(x)).count("1") for x in many & ~few))
            total += absent
    stated = float(filters.false_positives.mean())
    assert beyond / total < 2 * stated + 0.001


def test_sample_has_the_smallest_hashes(spark):
    rng = random.Random(2)
    rows = [("a" if i % 3 else "b", rng.getrandbits(64) - 2**63) for i in range(900)]
    df = spark.createDataFrame(rows, "lang string, h long").withColumn("bucket", F.shiftrightunsigned("h", 64 - BUCKET_BITS))
    counts = df.groupBy("lang", "bucket").agg(F.count("*").alias("texts")).collect()
    for most in (0, 1, 7, 250, 299, 300, 5000):
        want = [x for lang in "ab" for x in sorted((r for r in rows if r[0] == lang), key=lambda r: r[1] % 2**64 >> 64 - BUCKET_BITS)]
        got = sorted(tuple(r) for r in _smallest(df, counts, most).collect())
        assert {lang: sum(g[0] == lang for g in got) for lang in "ab"} == {"a": min(most, 600), "b": min(most, 300)}
        for lang in "ab":
            kept = [h % 2**64 >> 64 - BUCKET_BITS for x, h in got if x == lang]
            left = [h % 2**64 >> 64 - BUCKET_BITS for x, h in want if x == lang and (x, h) not in set(got)]
            assert not kept or not left or max(kept) <= min(left)


def test_filters_have_every_gram_put_in(spark, sf_dir):
    filters = fit_filters(table(spark, sf_dir, "documents"), grams=300)
    assert filters.false_positives.max() < 0.01
    texts = table(spark, sf_dir, "documents").where("lang = 'en'").limit(20).collect()
    best = [filters.predict(r.text)[0] for r in texts]
    assert best.count("en") >= 18


def test_many_languages_take_several_words(spark):
    rows = [(i, "".join(chr(0x4E00 + 8 * i + j) for j in range(8)) + " x", f"l{i:03d}") for i in range(70)]
    filters = fit_filters(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert filters.table.shape[1] == 2
    assert all(filters.predict(t)[0] == lang for _, t, lang in rows)


def test_pieces_equal_the_library(spark, sf_dir, edge, docs):
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = dict(docs)
    for r in queries.QUERIES["op8_sentencepiece"](spark, sf_dir).collect():
        ids = model.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(model.decode(ids)))
    for r in decode_pieces(encode_pieces(edge, queries.PIECES), queries.PIECES).collect():
        assert r.ids == model.encode(r.text or "") and r.decoded == model.decode(r.ids)
        assert [r[c] for c in EXTRA] == ["x"] * len(EXTRA)


def test_pieces_on_random_strings():
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, model, rng = PieceTable(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(8)
    pieces = list(own.ids)
    for _ in range(4000):
        text = rng.choice([
            "".join(rng.choices(pieces, k=rng.randint(1, 6))), "".join(rng.choices("abcdeinrst  ", k=rng.randint(0, 30))),
            "".join(rng.choices("a b▁\n\té日한\U0001F600\x00  ", k=rng.randint(0, 20))), " " * rng.randint(0, 40) + "====" * rng.randint(0, 9),
        ])
        ids = own.encode(text).tolist()
        assert ids == model.encode(text) and own.decode(ids) == model.decode(ids), repr(text)
    long = "na" * 60_000
    assert own.encode(long).tolist() == model.encode(long)


def test_empty_tables(nothing):
    assert scan_licenses(nothing).count() == 0 and quality_rules(nothing).count() == 0
    both = decode_pieces(encode_pieces(nothing, queries.PIECES), queries.PIECES)
    assert both.count() == 0 and both.columns == [*nothing.columns, "ids", "decoded"]


def test_nulls_among_ids(spark):
    rows = spark.createDataFrame([(1, [450, None, 6635]), (2, None), (3, [None]), (3, [None])], "doc_id long, ids array<int>")
    model = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES)
    got = sorted((r.doc_id, r.decoded) for r in decode_pieces(rows, queries.PIECES).collect())
    assert got == [(1, model.decode([450, 6635])), (2, ""), (3, ""), (3, "")]
