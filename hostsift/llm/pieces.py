"""SentencePiece BPE encoding with a table of last tokens, and decoding.

What BPE makes of a text's prefix ends in one token, and what stands before that token is what BPE makes of the shorter
prefix. So for every prefix only its last token is stored: of the pieces that end there (an automaton finds them), the one
that may follow the last token of the prefix before it. Whether two tokens may stand side by side depends on them alone.
Read backwards from the end, the table gives the ids. A text takes time in proportion to its length, and no merge queue.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostsift.llm.common import Memory, without_collector


SPACE = "▁"
UNKNOWN = -1
#: Encoded stretches in each half of a worker's memory, the longest of them, and pairs of pieces that it remembers.
REMEMBERED, LONGEST, PAIRS = 450_000, 48, 600_000
_STRETCH = re.compile(f"{SPACE}+[^{SPACE}]*")


class _Stretches(Memory):
    """Stretch without its first mark -> bytes of its ids, computed when first asked for."""

    def __init__(self, make):
        super().__init__(REMEMBERED)
        self.make = make

    def __missing__(self, stretch: str) -> bytes:
        ids = self.old.get(stretch)
        if ids is None:
            ids = array("i", self.make(SPACE + stretch)).tobytes()
        if len(stretch) <= LONGEST:
            self.keep(stretch, ids)
        return ids


class PieceTable:
    """Pieces of a BPE model of the identity normalizer with a space put before the text."""

    def __init__(self, path: str):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        probe = " AÄÅ  b "
        if model.decode(model.encode(probe)) != probe:
            raise ValueError("only models that leave the text as it is are supported")
        self.pieces = [model.id_to_piece(i) for i in range(model.vocab_size())]
        plain = [i for i in range(len(self.pieces)) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.rank = {i: -model.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][3:5], 16): i for i in range(len(self.pieces)) if model.is_byte(i)}
        self.unk = model.unk_id()
        self.dropped = {i for i in range(len(self.pieces)) if model.is_control(i)}
        counts: dict[float, int] = {}
        for i in plain:
            if len(self.pieces[i]) > 1:
                counts[self.rank[i]] = counts.get(self.rank[i], 0) + 1
        self.tied = {r for r, n in counts.items() if n > 1}
        self.size = [len(p) for p in self.pieces]
        #: A piece never has a space mark after another character: then a text can be cut before every run of marks.
        self.cut = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids)
        self.made: dict[int, tuple | None] = {}
        self.pairs: dict[int, bool] = {}
        self.remembered = _Stretches(self.stretch)
        self.automaton = ahocorasick.Automaton()
        for p, i in self.ids.items():
            if self.halves(i) is not None:
                self.automaton.add_word(p, (i, len(p)))
        self.automaton.make_automaton()

    def merge(self, text: str) -> tuple[list[str], tuple[str, str] | None]:
        """BPE by the rule itself, for short strings: the symbols, and the two that were joined last."""
        symbols, last = list(text), None
        while True:
            found = [
                (self.rank[i], at) for at in range(len(symbols) - 1) if (i := self.ids.get(symbols[at] + symbols[at + 1])) is not None
            ]
            if not found:
                return symbols, last
            at = min(found)[1]
            last = (symbols[at], symbols[at + 1])
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]

    def halves(self, i: int) -> tuple | None:
        """The two pieces that a piece is made of and whether they rank before it; () for a character; None if never made."""
        if i not in self.made:
            p = self.pieces[i]
            if len(p) == 1:
                self.made[i] = ()
            else:
                symbols, last = self.merge(p)
                if len(symbols) > 1:
                    self.made[i] = None
                else:
                    left, right = (self.ids.get(x, UNKNOWN) for x in last)
                    parts = [self.halves(x) for x in (left, right) if x != UNKNOWN]
                    plain = self.rank[i] not in self.tied and all(
                        h == () or h and h[2] and self.rank[x] < self.rank[i]
                        for x, h in zip((x for x in (left, right) if x != UNKNOWN), parts)
                    ) and len(parts) == 2
                    self.made[i] = (left, right, plain)
        return self.made[i]

    def side_by_side(self, a: int, b: int) -> bool:
        """Whether BPE of the two pieces' joined text gives these two pieces."""
        if any(h and not h[2] for h in (self.made[a], self.made[b])):
            return self.merge(self.pieces[a] + self.pieces[b])[0] == [self.pieces[a], self.pieces[b]]
        # Go back in time from the finished pieces: undo the later of the two merges at the seam, and look whether the ends
        # that then meet would have been joined before the merge that was just undone.
        undone, of_right = None, False
        while True:
            joined = self.ids.get(self.pieces[a] + self.pieces[b])
            if joined is not None:
                rank = self.rank[joined]
                if undone is None or rank < undone or rank == undone and of_right:
                    return False
            left, right = self.made[a], self.made[b]
            if not left and not right:
                return True
            of_right = not left or bool(right) and self.rank[b] >= self.rank[a]
            if of_right:
                undone, b = self.rank[b], right[0]
            else:
                undone, a = self.rank[a], left[1]

    def stretch(self, text: str) -> list[int]:
        """Ids of a text whose spaces are marks."""
        last = [UNKNOWN] * len(text)
        pairs, known, width = self.pairs, self.pairs.get, len(self.pieces)
        for end, (i, size) in self.automaton.iter(text):
            if last[end] < 0:
                before = last[end - size] if end >= size else UNKNOWN
                if before < 0:
                    last[end] = i
                    continue
                fits = known(before * width + i)
                if fits is None:
                    if len(pairs) >= PAIRS:
                        pairs.clear()
                    fits = pairs[before * width + i] = self.side_by_side(before, i)
                if fits:
                    last[end] = i
        ids, at = [], len(text) - 1
        while at >= 0:
            if last[at] == UNKNOWN:
                data = text[at].encode("utf-8")
                if self.bytes:
                    ids += [self.bytes[x] for x in reversed(data)]
                elif not ids or ids[-1] != self.unk:
                    ids.append(self.unk)
                at -= 1
            else:
                ids.append(last[at])
                at -= self.size[last[at]]
        ids.reverse()
        return ids

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if not self.cut:
            return np.array(self.stretch(SPACE + text.replace(" ", SPACE)), np.int32)
        if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
            stretches = [x[1:] for x in _STRETCH.findall(SPACE + text.replace(" ", SPACE))]
        else:
            stretches = text.split(" ")
        return np.frombuffer(b"".join(map(self.remembered.__getitem__, stretches)), np.int32)

    @property
    def raw(self) -> list[bytes]:
        """Bytes that each id stands for."""
        if not hasattr(self, "_raw"):
            self._raw = [
                b"" if i in self.dropped else " ⁇ ".encode() if i == self.unk else p.replace(SPACE, " ").encode()
                for i, p in enumerate(self.pieces)
            ]
            for value, i in self.bytes.items():
                self._raw[i] = bytes([value])
        return self._raw

    def decode(self, ids: list[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        first = next((i for i in ids if i not in self.dropped), self.unk)
        return text[1:] if self.pieces[first].startswith(SPACE) else text


@lru_cache(maxsize=2)
def piece_table(path: str) -> PieceTable:
    """Read once in each worker."""
    return PieceTable(path)


def encoded(text: Column, model: str) -> Column:
    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        with without_collector():
            made = [piece_table(model).encode(x.as_py() or "") for x in texts]
        ends = np.cumsum([0, *map(len, made)])
        values = np.concatenate(made) if made else np.zeros(0, np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

    return encode(text)


def decoded(ids: Column, model: str) -> Column:
    @F.arrow_udf("string")
    def decode(lists: pa.Array) -> pa.Array:
        if lists.values.null_count:
            return pa.array([piece_table(model).decode([i for i in x or [] if i is not None]) for x in lists.to_pylist()], pa.string())
        ends = lists.offsets.to_numpy()
        values = lists.values.to_numpy(zero_copy_only=False)  # a null list has no values
        return pa.array([piece_table(model).decode(values[a:b].tolist()) for a, b in zip(ends, ends[1:])], pa.string())

    return decode(ids)


def encode_pieces(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` plus ``ids``, the ids of every whole text, without begin or end ids.

    ``model`` is the path of a BPE model file that every executor has; models that normalize text are refused. A null text
    is read as empty and has no ids. Characters that no piece has become bytes, or the unknown id where the model has no
    byte pieces. Rows are handled one by one: repeated rows get equal ids, an empty table stays empty; other columns stay, and
    a column named ``ids`` is replaced.
    """
    return docs.withColumn(ids, encoded(F.col(f"`{text}`").cast("string"), model))


def decode_pieces(docs: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``docs`` plus ``text``: what the ids stand for. Null or no ids give an empty text, a null among ids counts for
    nothing, bytes that aren't UTF-8 give a replacement character. Rows are handled one by one: repeated rows get equal texts, an
    empty table stays empty; other columns stay, and a column named ``text`` is replaced."""
    return docs.withColumn(text, decoded(F.col(f"`{ids}`"), model))


