"""Operators that bring rows together: duplicates, top-k, shards, packing, token files, and the pipeline."""

import os
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import oracle
import plain
import public_tokenizers
import pytest
from cases import EXTRA, LONG, ROWS
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from hostsift.llm import queries, tokens
from hostsift.llm.common import table
from hostsift.llm.components import components
from hostsift.llm.lines import dedup_lines
from hostsift.llm.packing import ChunkEncoder, best_fit, pack_documents
from hostsift.llm.sharding import permuted, shard_rows
from hostsift.llm.simhash import near_links, one_of_each_group, simhash_groups
from hostsift.llm.tokens import byte_bpe, count_tokens, document_tokens, encode_text
from hostsift.llm.topk import integer_vectors, top_k
from hostsift.session import qualified, scratch_path


def signed(x):
    return x - (1 << 64) if x >> 63 else x


# --- SimHash ------------------------------------------------------------------------------------------------------------


def test_components_of_graphs(spark):
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(1000, 1060)]
    star = [(5000, 5000 + i) for i in range(1, 200)]
    loose = [(rng.randrange(120), rng.randrange(120)) for _ in range(70)]
    edges = chain + star + loose + loose[:9] + [(7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    real = {(a, b) for a, b in edges if a is not None and a != b}
    linked = real | {(b, a) for a, b in real}
    assert got == plain.groups(sorted({n for e in real for n in e}), lambda a, b: (a, b) in linked)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_links_join_all_within_two_bits(spark):
    rng, prints = random.Random(6), set()
    for _ in range(30):
        p = rng.getrandbits(64)
        for _ in range(6):
            prints.add(p)
            for b in rng.sample(range(64), rng.randint(0, 3)):
                p ^= 1 << b
    prints |= {0, 1, 1 << 63, (1 << 64) - 1}
    links = near_links(spark.createDataFrame([(signed(p),) for p in prints], "p long"), "p", 2).collect()
    assert all(bin((r.u ^ r.v) & (1 << 64) - 1).count("1") <= 2 for r in links)
    pairs = {frozenset((r.u, r.v)) for r in links}
    nodes = [signed(p) for p in prints]
    want = plain.groups(sorted(nodes), lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1") <= 2)
    assert plain.groups(sorted(nodes), lambda a, b: frozenset((a, b)) in pairs) == want


def test_simhash_groups(spark, sf_dir, docs, edge, nothing):
    want = {k: plain.fingerprint(t) for k, t in docs}
    near = plain.groups(sorted(want), lambda a, b: bin(want[a] ^ want[b]).count("1") <= 2)
    got = queries.QUERIES["op5_simhash_groups"](spark, sf_dir).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {k: (f"{want[k]:016x}", near[k]) for k in want}
    out = simhash_groups(edge).collect()
    assert Counter(r.doc_id for r in out) == Counter(k for k, _ in ROWS)
    assert {r.doc_id: r.fingerprint for r in out} == {k: f"{plain.fingerprint(t):016x}" for k, t in ROWS}
    assert {r.component_id for r in out if r.doc_id in (1, 2, 3)} == {1} and {r.component_id for r in out if r.doc_id in (5, 6, 7)} == {5}
    assert simhash_groups(nothing).count() == 0


def test_one_document_of_each_group_stays(edge, nothing):
    kept = one_of_each_group(edge)
    assert kept.columns == edge.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert set(ids) == {1, 4, 5, 8, 9, 10, 11, 12, None} and set(ids.values()) == {1}
    assert one_of_each_group(nothing).count() == 0


def test_pipeline_keeps_one_of_each_group(spark):
    rng, docs = random.Random(11), []
    for _ in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(400)]
        docs.append(" ".join(base))
        for _ in range(3):
            base[rng.randrange(400)] = "other"
            docs.append(" ".join(base))
    cases = list(enumerate([*docs, docs[0], docs[0].upper(), None, "", " ", "one two", "One TWO"]))
    prints = {k: plain.fingerprint(t, 3) for k, t in cases}
    want = plain.groups(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 2)
    assert len(set(want.values())) < len(set(prints.values()))
    kept = corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(cases, "doc_id long, text string"), "")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(want.values()))


# --- lines --------------------------------------------------------------------------------------------------------------


def line_cases():
    rng, docs = random.Random(7), []
    base = ["".join(rng.choice("abcdef é\U0001F600") for _ in range(rng.choice([29, 30, 31, 50, 51]))) for _ in range(30)]
    for k in range(60):
        lines = []
        for _ in range(rng.randint(0, 6)):
            x = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                i = rng.choice([0, len(x) // 2, len(x) - 1, rng.randrange(len(x))])
                x[i : i + 1] = rng.choice([[], [x[i], "é"], ["z"], [x[i], x[i]]])
            lines.append("".join(x))
        docs.append((k, "\n".join(lines)))
    return [*docs, (60, None), (61, ""), (62, "\n\n"), (63, "a" * 40), (64, "a" * 41), (65, "a" * 42), (66, "x" * 5000), (67, "x" * 4999 + "y")]


def test_line_dedup_matches_plain_python(spark, edge, nothing):
    cases = line_cases()
    got = dedup_lines(spark.createDataFrame(cases, "doc_id long, text string"))
    assert {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in got.collect()} == plain.without_lines(cases)
    out = dedup_lines(edge)
    assert [c for c in out.columns if c not in ("n_lines", "n_dropped")] == [c for c in edge.columns if c != "n_lines"]
    rows = out.collect()
    assert Counter(r.doc_id for r in rows) == Counter(k for k, _ in ROWS)
    twelve = [r for r in rows if r.doc_id == 12]
    assert [r.n_dropped for r in twelve] == [0, 0]  # equal rows stand at the same place
    eight = next(r for r in rows if r.doc_id == 8)
    assert eight.n_lines == 20_000 and eight.n_dropped < 20_000
    assert dedup_lines(nothing).count() == 0


def test_line_dedup_runs_no_python(spark, sf_dir):
    plan = queries.QUERIES["op6_line_dedup"](spark, sf_dir)._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct", "NestedLoop"))


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql_on_larger_tables(spark, name):
    con = oracle.duck("/root/testdata/sf0.01")
    got = oracle.spark_table(queries.QUERIES[name](spark, "/root/testdata/sf0.01"))
    assert oracle.difference(got, oracle.duck_table(con, queries.ORACLES[name])) is None


# --- top-k --------------------------------------------------------------------------------------------------------------


def test_top_k_with_ties_and_odd_vectors(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.0, 0.001, 0.5]) for _ in range(rng.choice([3, 3, 3, 1]))]) for i in range(300)]
    rows += [(301, None), (302, [1.0, None, 0.0]), (303, [float("nan")] * 3), (304, [float("inf")] * 3), (305, []), (350, []), (None, [1.0] * 3)]
    rows += [(400, [0.0] * 3), (450, [300.0, -7e6, 1e7])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit("x"), "block": F.lit("y")})
    vectors = integer_vectors(df, "vec_id", "embedding")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in top_k(vectors, vectors.where("id % 50 = 0")).collect())
    whole = {
        k: [int(np.floor(256 * float(np.float32(x)))) for x in v]
        for k, v in rows if k is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    }
    want = []
    for q in (k for k in whole if k % 50 == 0):
        scores = sorted((-sum(a * b for a, b in zip(whole[q], v)), k) for k, v in whole.items() if k != q and len(v) == len(whole[q]))
        want += [(q, n + 1, k, -s) for n, (s, k) in enumerate(scores[:5])]
    assert got == sorted(want)
    assert top_k(vectors.limit(0), vectors.limit(0)).count() == 0


# --- shards -------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 16, 17, 1000, 65_537])
def test_permutation_and_its_inverse(size):
    numbers = np.arange(size)
    at = permuted(numbers, size, seed=7)
    assert sorted(at) == list(range(size))
    assert (permuted(at, size, seed=7, back=True) == numbers).all()
    assert size < 1000 or (at != permuted(numbers, size, seed=8)).mean() > 0.9


def test_shards(spark, sf_dir, docs, edge, nothing):
    got = queries.QUERIES["op7_feistel_shards"](spark, sf_dir).collect()
    texts = dict(docs)
    slots = defaultdict(list)
    for r in got:
        raw = texts[r.doc_id].encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
        slots[r.shard].append(r.slot)
    assert sorted(slots) == list(range(8)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    again = queries.QUERIES["op7_feistel_shards"](spark.newSession(), sf_dir).repartition(3).collect()
    assert {r.doc_id: (r.shard, r.slot) for r in again} == {r.doc_id: (r.shard, r.slot) for r in got}
    out = shard_rows(edge).collect()
    assert Counter((r.doc_id, r.size) for r in out) == Counter((k, len((t or "").encode()) + 1) for k, t in ROWS)
    assert {(r.shard, r.slot) for r in out} == {(i % 8, i // 8) for i in range(len(ROWS))}
    assert shard_rows(nothing).count() == 0


# --- packing ------------------------------------------------------------------------------------------------------------


def check_packing(rows, docs, capacity=2048):
    tokenizer = Tokenizer.from_file(queries.WORDS)
    want, total = Counter(), 0
    for k, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        for n, a in enumerate(range(0, len(ids), capacity)):
            part = ids[a : a + capacity]
            want[(k, n, a, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-total // capacity)


def test_packing(spark, sf_dir, docs, edge, nothing):
    used, least = check_packing(queries.QUERIES["op10_best_fit_packing"](spark, sf_dir).collect(), docs)
    assert used <= 1.02 * least + 1
    check_packing(pack_documents(edge, queries.WORDS).collect(), ROWS)
    assert pack_documents(nothing, queries.WORDS).count() == 0
    ids = pack_documents(edge.where("doc_id = 5"), queries.WORDS, with_ids=True).first().ids
    assert ids[-1] == 0 and len(ids) == 3


def test_ids_of_random_strings():
    rng, library = random.Random(15), Tokenizer.from_file(queries.WORDS)
    own = ChunkEncoder(queries.WORDS)
    alphabets = ["abc.,;!?*#$%&|>-_(){}[]/\\`~^+=:@\"' ", "AÀéßöñÿ×÷. ", "s't've'll don't 12 3", "<|startoftext|> <|endoftext|>", "e\u0301o\u0308 \u00a0\n\t", "日本 한국 \U0001F600!!"]
    texts = []
    for _ in range(3000):
        words = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 9))) for _ in range(rng.randint(1, 6))]
        texts.append(rng.choice([" ", "\n", "  ", ""]).join(words))
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_all([*texts, *texts[:50], ""])]
    assert got == [library.encode(t, add_special_tokens=False).ids for t in [*texts, *texts[:50], ""]]
    assert len(own.tails) > 100


def test_new_chunks_among_known_ones_take_their_places(monkeypatch):
    own, library = ChunkEncoder(queries.WORDS), Tokenizer.from_file(queries.WORDS)
    list(own.encode_all(["one two three", ""]))
    asked, make = [], own._made
    monkeypatch.setattr(own, "_made", lambda chunks: (asked.append(sorted(chunks)), make(chunks))[1])
    texts = ["one  zyxel two", "zyxel\n", "", "  ", "two one", "three quuxly zyxel quuxly one"]
    for _ in range(2):
        got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)]
        assert got == [library.encode(x, add_special_tokens=False).ids for x in texts]
    assert asked == [["quuxly", "zyxel"]]  # once, though they come again


def test_plan_is_best_fit_over_counts():
    rng = random.Random(10)
    for _ in range(60):
        capacity = rng.choice([7, 20, 64])
        histogram = {rng.randint(1, capacity): rng.choice([1, 2, 3, 50, 1000]) for _ in range(rng.randint(1, 12))}
        plan = best_fit(histogram, capacity)
        rooms: list[int] = []  # one piece at a time
        for length in sorted(histogram, reverse=True):
            for _ in range(histogram[length]):
                fitting = [r for r in rooms if r >= length]
                if fitting:
                    rooms[rooms.index(min(fitting))] -= length
                else:
                    rooms.append(capacity - length)
        assert plan.sequences == len(rooms)
        filled = defaultdict(set)
        for length, n in histogram.items():
            sequence, offset = plan.look_up(np.full(n, length), np.arange(n))
            for s, o in zip(sequence, offset):
                taken = set(range(o, o + length))
                assert not taken & filled[s]
                filled[s] |= taken
        assert all(f == set(range(len(f))) and len(f) <= capacity for f in filled.values())
    assert best_fit({}, 8).sequences == 0


# --- token files --------------------------------------------------------------------------------------------------------


def test_token_counts_by_document(spark, sf_dir, docs, edge, nothing):
    encode = byte_bpe(queries.RANKS, public_tokenizers.PATTERN).encode_ordinary
    got = queries.QUERIES["op4_token_counts"](spark, sf_dir).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in got) == Counter((k, len(encode(t))) for k, t in docs)
    out = document_tokens(edge, queries.RANKS, public_tokenizers.PATTERN, 50256, width=4).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in out) == Counter((k, len(encode(t or ""))) for k, t in ROWS)
    assert document_tokens(nothing, queries.RANKS, public_tokenizers.PATTERN, 50256).count() == 0


def test_token_counts_of_long_white_space(spark):
    texts = [" " * 400_000 + "x", "a\n" + "\n \t" * 3000 + "b", "\u00a0" * 900, "  x" * 600]
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    assert [encode_text(ranks, public_tokenizers.PATTERN, t) for t in texts] == [slow.encode(t).ids for t in texts]
    got = document_tokens(spark.createDataFrame(list(enumerate(texts)), "file long, text string"), ranks, public_tokenizers.PATTERN, 50256, key="file")
    assert {r.file: r.n_tokens for r in got.collect()} == {i: len(slow.encode(t).ids) for i, t in enumerate(texts)}


def test_a_path_without_a_scheme_is_on_sparks_file_system(spark, monkeypatch):
    conf = spark._jsc.hadoopConfiguration()
    default = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://elsewhere/")
    conf.set("fs.viewfs.mounttable.elsewhere.link./shared", "file:/tmp")
    try:
        assert qualified(spark, "/shared/x") == "viewfs://elsewhere/shared/x" and qualified(spark, "file:/shared/x") == "file:/shared/x"
        made = []
        monkeypatch.setattr(tokens, "_filesystem", lambda path: made.append(path) or (_ for _ in ()).throw(StopIteration))
        with pytest.raises(StopIteration):
            document = spark.createDataFrame([(1, "a")], "key long, text string")
            tokens.write_token_files(document, queries.RANKS, public_tokenizers.PATTERN, 50256, "/shared/tokens", key="key")
        assert made == ["viewfs://elsewhere/shared/tokens"]
    finally:
        conf.unset("fs.defaultFS") if default is None else conf.set("fs.defaultFS", default)


KEYED = {
    "simhash_groups": simhash_groups, "shard_rows": shard_rows, "pack_documents": lambda d, key: pack_documents(d, queries.WORDS, key=key),
    "document_tokens": lambda d, key: document_tokens(d, queries.RANKS, public_tokenizers.PATTERN, 50256, key=key),
}
RESULTS = {"fingerprint", "component_id", "size", "text_crc32", "law", "shard", "slot", "row_no", "piece", "start", "length", "offset"}


@pytest.mark.parametrize("operator", sorted(KEYED))
def test_any_name_of_the_key(spark, operator):
    for name in ("print", "size", "part", "piece", "file", "rank", "copy"):
        rows = spark.createDataFrame([(7, "a b c", "x"), (8, None, "y")], f"`{name}` long, text string, least string")
        try:
            got = KEYED[operator](rows, key=name)
        except ValueError as error:  # the result has a column of that name
            assert name in RESULTS and name in str(error)
            continue
        assert got.columns.count(name) == 1 and dict(got.dtypes)[name] == "bigint"
        if name in ("print", "part", "file"):
            assert sorted(r[name] for r in got.collect()) == [7, 8]


def test_line_dedup_finds_its_column_whatever_its_case(spark):
    line = "a line of more than thirty characters"
    got = dedup_lines(spark.createDataFrame([(1, line), (2, line)], "doc_id long, Text string"), text="text")
    assert sorted((r.doc_id, r.Text, r.n_dropped) for r in got.collect()) == [(1, line, 0), (2, "", 1)]


@pytest.mark.parametrize("share", [0.5, 0.02, 0.0])
def test_scan_stitches_blocks(spark, share):
    rng, folder, want = random.Random(share), scratch_path(spark, "flat").removeprefix("file:"), []
    os.makedirs(folder)
    for n, size in enumerate([0, 1, 7, 8, 9, 64, 203]):
        ids = [9 if rng.random() < share else rng.randint(0, 8) for _ in range(size)]
        np.array(ids, "<u2").tofile(f"{folder}/f{n}.bin")
        ordinal = length = 0
        for i in [*ids, None]:
            if i == 9 or i is None and length:
                want.append((f"f{n}.bin", ordinal, length))
                ordinal, length = ordinal + 1, 0
            else:
                length += 1
    got = count_tokens(spark, folder, end_id=9, block=16).collect()
    assert sorted((r.file.rpartition("/")[2], r.ordinal, r.n_tokens) for r in got) == sorted(want)


# --- pipeline -----------------------------------------------------------------------------------------------------------


def plain_stages(docs):
    """doc_id -> text after each of the first four stages; the language stage keeps all documents here."""
    fine = {k: t for k, t in docs if good(t)}
    cleaned = plain.without_lines(list(fine.items()))
    left = {k: x[0] for k, x in cleaned.items() if not x[2] or len(x[0]) >= corpus_pipeline.MIN_LEFT * len(fine[k])}
    prints = {k: plain.fingerprint(t, corpus_pipeline.SHINGLE) for k, t in left.items()}
    near = plain.groups(sorted(left), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= corpus_pipeline.RADIUS)
    return [fine, fine, left, {k: t for k, t in left.items() if near[k] == k}]


def good(text):
    q, rules = plain.quality(text), corpus_pipeline.QualityRules()
    lines = (text or "").split("\n")
    repeated = sum(len("".join(plain.words(x))) for i, x in enumerate(lines) if x in lines[:i])
    return not (
        q["base_failed"] or repeated > rules.dup_line * q["word_chars"] or q["n_symbols"] > rules.symbols * q["n_words"]
        or any(plain.later_share(text, n) > most for n, most in rules.dup_ngram)
        or any(plain.top_share(text, n) > most for n, most in rules.top_ngram)
    )


def test_pipeline_matches_plain_python(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    now = docs
    for (name, stage), want in zip(corpus_pipeline.STAGES, plain_stages(rows)):
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == docs.columns, name
        assert {r.doc_id: r.text for r in now.collect()} == want, name
        assert now.where("n_chars <> length(text)").count() == 0
    check_packing(corpus_pipeline.run(spark, sf_dir).collect(), list(want.items()))


def test_pipeline_passes_columns_on(spark, sf_dir):
    extra = {c: F.concat(F.lit(f"{c} "), F.col("doc_id")) for c in (*EXTRA, "n_dropped", "N_Chars_before", "row_no", "print", "no_key")}
    start = table(spark, sf_dir, "documents").withColumns(extra)
    now = start
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, sf_dir)
        assert now.dtypes == start.dtypes, name
        rows = now.select("doc_id", *extra).collect()
        assert rows and all(r[c] == f"{c} {r.doc_id}" for r in rows for c in extra), name


def test_pipeline_on_odd_rows(spark, edge, nothing):
    for start in (edge, nothing, edge.withColumn("lang", F.lit(None).cast("string"))):
        now = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            now = stage(spark, now, "")
            assert now.columns == start.columns
        assert {r.doc_id for r in now.collect()} <= {8} and len(LONG) > 10**6
        corpus_pipeline.packed(spark, now, "").collect()


def test_language_stage_rejects_unknown_text(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    odd = docs.limit(3).select((F.col("doc_id") + 10**6).alias("doc_id"), F.lit("123 456 ---").alias("text"), "lang", "source", "n_chars")
    greek = odd.withColumns({"doc_id": F.col("doc_id") + 10, "text": F.lit("αβγ δεζ ηθι κλμ νξο πρσ " * 20), "lang": F.lit(None)})
    kept = corpus_pipeline.known_language(spark, docs.union(odd).union(greek), sf_dir)
    assert kept.where("doc_id >= 1000000").count() == 0 and kept.count() == docs.count()
