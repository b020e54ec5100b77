"""Best-fit packing of token pieces, planned on the histogram of lengths.

How many sequences there are, and which lengths each holds, follows from how often each length occurs. So the plan is made on
these counts, at most one per length, by best fit from the longest down; it fits on the driver however many documents there
are. Each piece then looks its place up by its length and its rank among the pieces of that length.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hostsift.llm.common import Memory, byte_of_sign, result_key, without_collector
from hostsift.session import staged

#: Chunks and parts of chunks in each half of a worker's memory, and the longest of them.
CHUNKS, PARTS, LONGEST = 300_000, 200_000, 64
#: Strings of signs that are remembered.
TAILS = 2000
#: Letters, then punctuation that is no apostrophe.
_WORD = re.compile(r"([^\W\d_]+)([.,;:!?]*)")
#: The same in lower-case letters that need no normalizing and no further splitting.
_LETTERS = "a-zß-öø-ÿ"
#: Behind them signs that are no apostrophe and begin no special token.
_PLAIN = re.compile(rf"([{_LETTERS}]+)([!-&(-/:;=-@\[-`{{-~]*)")
#: Their bytes as a byte-level vocabulary writes them.
_SIGNS = {b: sign for sign, b in byte_of_sign().items() if ord(sign) != b}
#: Characters of the texts whose chunks are looked up together.
TOGETHER = 1 << 16


class ChunkEncoder:
    """Ids of texts as little-endian 32-bit numbers, for tokenizers that split at white space and drop it.

    Such a tokenizer gives a text the ids of its chunks between white space, one after the other, and a word with punctuation
    behind it the ids of both. So chunks and words that come again are looked up, and new ones are encoded in one go, with a
    special token between them to tell their ids apart.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        special = [(i, t.content) for i, t in sorted(added.items()) if t.special and not (t.normalized or t.single_word)]
        if not special:
            raise ValueError("a special token is needed to keep chunks apart")
        self.mark_id, self.mark = special[0]
        self.chunks, self.parts = Memory(CHUNKS), Memory(PARTS)
        self.lower = self._ids("Probe") == self._ids("probe")
        self.model = self.tokenizer.model
        probes = ["probe", "zyx", "s", "words", *(f"a{c}{c}b" for c in map(chr, range(0xDF, 0x100)) if re.match(f"[{_LETTERS}]", c))]
        self.words_alone = sys.byteorder == "little" and all(self._tokens(w) == self._ids(w) for w in probes)
        self.tails: dict[str, bytes | None] = {}
        probe = "One  two\n\tthree's 45, <|x|> four.\r\nÉte!"
        if self._ids(probe) != self.encode(probe):
            raise ValueError("only tokenizers that drop white space are supported")

    def _ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _tokens(self, word: str) -> bytes:
        """Ids of a word of ``_LETTERS``, straight from the model."""
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(_SIGNS)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _encode(self, parts: list[str]) -> list[bytes]:
        """Ids of each part; parts have no white space."""
        if any(self.mark in p for p in parts):
            return [self._ids(p) for p in parts]
        ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(parts)], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(ids == self.mark_id)
        raw = ids.tobytes()
        starts, ends = [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), len(raw)]
        return [raw[a:b] for a, b in zip(starts, ends)]

    def _split(self, chunk: str) -> tuple[str, ...]:
        m = _WORD.fullmatch(chunk)
        if not m:
            return (chunk,)
        word, tail = m.groups()
        end = word[-1].lower()
        if tail and not (len(end) == 1 and end.isalpha() and ord(end) < 0x180):
            return (chunk,)  # a mark at the word's end, maybe one that only normalizing brings out, joins the punctuation
        word = word.lower() if self.lower and word.isascii() else word
        return (word, tail) if tail else (word,)

    def _tail(self, tail: str) -> bytes | None:
        """Ids of signs behind a word, if they are the same behind every word; a few are remembered."""
        if tail not in self.tails:
            if len(self.tails) >= TAILS:
                return None
            ids = self._ids(tail)
            self.tails[tail] = ids if all(self._ids(w + tail) == self._ids(w) + ids for w in ("probe", "s", "ça")) else None
        return self.tails[tail]

    def _made(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that aren't in the newer half of the memory, and of the words in them."""
        made, split, new = {}, {}, {}
        known, old, tokens, tails = self.chunks.get, self.chunks.old.get, self._tokens, self._tail
        plain = _PLAIN.fullmatch if self.words_alone else lambda c: None
        for c in chunks:
            ids = old(c)
            if ids is None and (m := plain(c)):
                word, tail = m.groups()
                if not tail:
                    ids = made.get(c) or tokens(c)
                elif (behind := tails(tail)) is not None:
                    front = made.get(word) or known(word) or old(word)
                    if front is None:
                        front = made[word] = tokens(word)
                    ids = front + behind
            if ids is None:
                split[c] = self._split(c)
                for p in split[c]:
                    new[p] = self.parts.get(p) or self.parts.old.get(p)
            else:
                made[c] = ids
        unknown = [p for p, ids in new.items() if ids is None]
        if unknown:
            new.update(zip(unknown, self._encode(unknown)))
        self.parts.keep_all({p: ids for p, ids in new.items() if len(p) <= LONGEST})
        for c, ps in split.items():
            made[c] = new[ps[0]] + new[ps[1]] if len(ps) > 1 else new[ps[0]]
        short = made if max(map(len, made)) <= LONGEST else {c: ids for c, ids in made.items() if len(c) <= LONGEST}
        self.chunks.keep_all(short)
        return made

    def _chunks(self, text: str) -> list[str]:
        if self.lower and "<" not in text:
            if text.isascii():
                text = text.lower()
            elif unicodedata.is_normalized("NFC", text):
                plain = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # A-Z only
                # The tokenizer composes characters first, so capitals may only go where that changes nothing either way.
                text = plain if unicodedata.is_normalized("NFC", plain) else text
        return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of every text; the chunks of many texts are looked up, and new ones encoded, together."""
        at = 0
        while at < len(texts):
            rows, size = [], 0
            while at < len(texts) and size < TOGETHER:
                rows.append(self._chunks(texts[at]))
                size += len(texts[at])
                at += 1
            self.chunks[""] = b""
            known = self.chunks.get
            found = [list(map(known, row)) for row in rows]
            gaps = [[i for i, x in enumerate(ids) if x is None] for ids in found]
            new = {row[i] for row, missing in zip(rows, gaps) for i in missing}
            made = self._made(list(new)) if new else {}
            for row, ids, missing in zip(rows, found, gaps):
                for i in missing:
                    ids[i] = made[row[i]]
                yield b"".join(ids)

    def encode(self, text: str) -> bytes:
        return next(self.encode_all([text]))


@lru_cache(maxsize=2)
def chunk_encoder(path: str) -> ChunkEncoder:
    """Read once in each worker."""
    return ChunkEncoder(path)


_PIECE = pa.struct([("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def token_pieces(text: Column, tokenizer: str, capacity: int, end_id: int, with_ids: bool = False) -> Column:
    """Pieces of at most ``capacity`` ids of a text and its end id; ``with_ids`` adds the ids as an array."""
    kind = pa.struct([*_PIECE, ("ids", pa.list_(pa.int64()))]) if with_ids else _PIECE
    extra = ", ids: array<bigint>" if with_ids else ""

    @F.arrow_udf(f"array<struct<piece: int, start: bigint, length: bigint, ids_crc32: bigint{extra}>>")
    def cut(texts: pa.Array) -> pa.Array:
        rows, step, end = [], 4 * capacity, end_id.to_bytes(4, "little")
        with without_collector():
            encoded = list(chunk_encoder(tokenizer).encode_all([x.as_py() or "" for x in texts]))
        for raw in encoded:
            raw += end
            pieces = []
            for n, at in enumerate(range(0, len(raw), step)):
                part = raw[at : at + step]
                made = {"piece": n, "start": at // 4, "length": len(part) // 4, "ids_crc32": zlib.crc32(part)}
                pieces.append(made | ({"ids": np.frombuffer(part, "<u4").tolist()} if with_ids else {}))
            rows.append(pieces)
        return pa.array(rows, pa.list_(kind))

    return cut(text)


@dataclass
class Plan:
    """Slots in order of length and first rank: ranks from ``rank`` on go to sequences from ``sequence`` on, at ``offset``."""

    length: np.ndarray
    rank: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    sequences: int

    def look_up(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks are below 2**48, lengths below 2**15."""
        at = np.searchsorted((self.length << 48) | self.rank, (length << 48) | rank, side="right") - 1
        return self.sequence[at] + rank - self.rank[at], self.offset[at]


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """Best fit, from the longest length down, for all pieces of a length at once.

    Sequences with equally much room form groups; a length takes room from the group with the least room that holds it. The
    number of slots depends on the lengths that there are, at most ``capacity``, not on how many pieces have them.
    """
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> groups as first sequence and number
    mask = 0  # bit r: there is a group with room r
    slots, used = [], 0

    def add(left: int, first: int, count: int) -> None:
        nonlocal mask
        if left and count:
            room.setdefault(left, []).append((first, count))
            mask |= 1 << left

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            fitting = mask >> length
            if fitting:
                r = length + (fitting & -fitting).bit_length() - 1
                first, count = room[r].pop()
                if not room[r]:
                    mask &= ~(1 << r)
                taken = min(left, count)
                slots.append((length, rank, first, capacity - r))
                add(r, first + taken, count - taken)
                add(r - length, first, taken)
                rank, left = rank + taken, left - taken
            else:
                each = capacity // length
                new = max(1, left // each)
                for k in range(each if left >= each else left):
                    slots.append((length, rank, used, k * length))
                    rank, left = rank + new, left - new
                add(capacity - (k + 1) * length, used, new)
                used += new
    columns = np.array(sorted(slots), np.int64).reshape(-1, 4).T
    return Plan(*columns, used)


def ranked(pieces: DataFrame, order: list[str]) -> DataFrame:
    """``pieces``, with their ``part``, plus ``rank`` from 0 among the rows of the same length.

    Ranks are counted within a part and shifted by the counts of the parts before it, so no length's rows meet in a task.
    """
    rank = F.row_number().over(Window.partitionBy("part", "length").orderBy(*order)) - 1
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    rows = pieces.withColumn("rank", rank).join(shifts, ["part", "length"])
    return rows.withColumn("rank", F.col("rank") + F.col("shift")).drop("shift")


def pack_documents(
    docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", capacity: int = 2048, end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: ``key``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset`` (and ``ids``).

    A document is the ids of its whole text and the end id; a null text has the end id alone. Only documents of over
    ``capacity`` ids are cut, into pieces of ``capacity``, the last of which may be shorter. Sequences are numbered from 0,
    hold at most ``capacity`` ids, and their pieces follow each other without a gap. Repeated rows are packed each; which of
    them has which place makes no difference. No rows give no rows. ``tokenizer`` is a file that every executor has.
    """
    if not 0 < capacity < 1 << 15:
        raise ValueError("the capacity is from 1 to 32767")
    result_key(key, [*(f.name for f in _PIECE), "sequence_id", "offset", "ids"])
    made = token_pieces(F.col(f"`{text}`").cast("string"), tokenizer, capacity, end_id, with_ids)
    rows = docs.select(F.col(f"`{key}`").alias("key"), F.explode(made).alias("p")).select("key", "p.*")
    pieces = staged(rows.withColumn("part", F.spark_partition_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = best_fit(histogram, capacity)  # at most `capacity` lengths were collected

    @F.arrow_udf("struct<sequence_id: bigint, offset: bigint>")
    def place(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        found = plan.look_up(lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False))
        return pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in found], ["sequence_id", "offset"])

    placed = ranked(pieces, ["key", "piece", "ids_crc32"]).withColumn("at", place("length", "rank"))
    return placed.select(
        F.col("key").alias(key), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset", *(["ids"] if with_ids else [])
    )
