"""Alignment of two tokenizers against groups and links found by definition."""

import hashlib
import random
from collections import Counter, defaultdict
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from cases import ROWS
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hostsift.llm import queries
from hostsift.llm.alignment import align_tokenizers, linked_pairs, terminal_tokens, tokenizer_pair
from hostsift.llm.frequent import at_most

FILES = queries.BYTES, queries.PIECES, public_tokenizers.PATTERN
COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def byte_of_sign():
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def groups_of(texts):
    """For each text the groups as (A ids, B ids), by the libraries' own encoders and common ends."""
    a, b = Tokenizer.from_file(FILES[0]), sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    a.encode_special_tokens = True
    sign = byte_of_sign()

    def raw(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()

    for text in texts:
        if not text:
            yield []
            continue
        xs, ys = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        parts = [bytes(sign[c] for c in a.id_to_token(i)) for i in xs], [raw(i) for i in ys]
        if not b"".join(parts[0]) == b"".join(parts[1]) == b" " + text.encode():
            yield []
            continue
        ends = [list(accumulate(map(len, p))) for p in parts]
        common = sorted(set(ends[0]) & set(ends[1]))
        groups, x, y = [], 0, 0
        for end in common:
            p, q = x, y
            x, y = (ends[0].index(end, p) + 1), (ends[1].index(end, q) + 1)
            groups.append((xs[p:x], ys[q:y]))
        yield groups


def by_definition(texts):
    found = list(groups_of(texts))
    links = [Counter((p, q) for g in groups for p in g[0] for q in g[1]) for groups in found]
    counts = Counter(pair for own in links for pair in own)
    most = defaultdict(int)
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    for groups, own in zip(found, links):
        spelled = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        yield (
            sum(len(p) for p, _ in groups), sum(len(q) for _, q in groups), len(groups), sum(own.values()),
            sum(n for (p, q), n in own.items() if counts[p, q] == most[p]), sum(n * counts[x] for x, n in own.items()),
            hashlib.sha256(spelled.encode()).hexdigest() if groups else "",
        )


def odd_texts():
    rng = random.Random(11)
    alphabets = ["ab \n", "  \t é日本한\U0001F600", "▁ a", "the and of <|endoftext|> <s> </s> <unk>", "0123 .,'s", "\x00\x0b\x85 x"]
    texts = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 40))) for _ in range(150)]
    return [*texts, " ", "  ", "▁", "a▁b", "=" * 700, " " * 3000 + "x" + "\n" * 900, "日本" * 900, "na" * 4000, "<|endoftext|>", "Á Á"]


def test_matches_definition(spark, sf_dir, docs):
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in queries.QUERIES["op11_cross_tokenizer_alignment"](spark, sf_dir).collect()}
    assert got == dict(zip((k for k, _ in docs), by_definition([t for _, t in docs])))


@pytest.mark.parametrize("held", [0, 40, 1_000_000])
def test_odd_texts_whatever_is_held(spark, held):
    texts = odd_texts()
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r[c] for c in COLUMNS) for r in align_tokenizers(rows, *FILES, held_pairs=held).collect()}
    want = list(by_definition(texts))
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[0] == 0 for w in want) >= 3 and sum(w[3] > w[2] for w in want) > 50


def test_edge_rows(edge, nothing):
    out = align_tokenizers(edge, *FILES).collect()
    want = list(by_definition([t for _, t in ROWS]))
    assert Counter((r.doc_id, *(r[c] for c in COLUMNS)) for r in out) == Counter((k, *w) for (k, _), w in zip(ROWS, want))
    assert align_tokenizers(nothing, *FILES).count() == 0


@pytest.mark.parametrize("name", ["pairs", "key", "row_no"])
def test_any_name_of_the_key(spark, name):
    rows = spark.createDataFrame([(1, "a b", "x"), (2, None, "y")], f"`{name}` long, text string, times string")
    assert sorted((r[name], r.n_a) for r in align_tokenizers(rows, *FILES, key=name).collect()) == [(1, 2), (2, 0)]


def test_pointers_reach_the_terminal_token():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 400):
        total = 4 * n
        ends = [np.append(np.flatnonzero(rng.random(total - 1) < p) + 1, total) for p in (0.6, 0.3)]
        common = sorted(set(ends[0]) & set(ends[1]))
        a, b = terminal_tokens(*ends)
        for got, own in zip((a, b), ends):
            assert [ends[0][i] for i in got] == [next(c for c in common if c >= e) for e in own]
    # a chain as long as the text: every token overlaps the next one of the other side
    a, b = terminal_tokens(np.append(np.arange(1, 2001, 2), 2002), np.arange(2, 2003, 2))
    assert set(a) == set(b) == {1000}


def test_wide_groups_count_by_distinct_ids():
    rng = np.random.default_rng(4)
    a, b = rng.integers(0, 9, 300), rng.integers(0, 7, 260)
    n_a, n_b, doc = np.array([200, 1, 99]), np.array([150, 10, 100]), np.array([0, 0, 2])
    of, pairs, times = linked_pairs(a, b, doc, n_a, n_b, 1000)
    want, x, y = Counter(), 0, 0
    for d, p, q in zip(doc, n_a, n_b):
        want.update((int(d), int(i * 1000 + j)) for i in a[x : x + p] for j in b[y : y + q])
        x, y = x + p, y + q
    assert {(int(d), int(p)): int(n) for d, p, n in zip(of, pairs, times)} == want


def test_at_most(spark):
    rows = spark.createDataFrame([(i, 1 + i // 3) for i in range(300)], "k long, n long")
    for most in (0, 1, 50, 299, 300, 1000):
        kept = {r.k: r.n for r in at_most(rows, "n", most).collect()}
        assert len(kept) <= most and (most < 300 or len(kept) == 300)
        if 0 < len(kept) < 300:
            assert min(kept.values()) > max(1 + i // 3 for i in range(300) if i not in kept)
    assert at_most(rows.where(F.lit(False)), "n", 5).count() == 0


def test_special_strings_are_plain_text():
    pair = tokenizer_pair(*FILES)
    (ids, _), = pair.encode(["<|endoftext|>"])
    assert 50256 not in ids and b"".join(pair.a[i] for i in ids) == b" <|endoftext|>"
