"""License scan: exact phrases, and short notices within a bounded number of edits.

A notice of ``k`` allowed edits is split into ``k + 1`` pieces. Whatever stands within ``k`` edits of the notice holds at
least one piece unchanged, so one automaton over all pieces finds every place worth a look; the bounded-error matching of
the ``regex`` library then looks at these places only. The words that tell one license from another have to stand unchanged,
whatever edits the rest has; and where notices overlap the longest one says what it is.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hostsift.llm.common import utf8, with_fields

#: Lower-cases A-Z and makes a space of every ASCII character that isn't a letter or digit; other bytes stay.
_PLAIN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)
_WORD = re.compile(rb"[^\x20]+")


@dataclass(frozen=True)
class Notice:
    """Words in lower case with one space between; ``edits``: characters inserted, deleted or replaced at most; ``firm``: words
    that have to stand unchanged, in this order."""

    label: str
    text: str
    edits: int
    firm: tuple[str, ...] = ()

    def stands(self, found: str) -> bool:
        """Whether the firm words are among the words found, in their order."""
        words = iter(found.split())
        return all(w in words for w in self.firm)

    def pieces(self) -> list[tuple[int, str]]:
        """``edits + 1`` pieces of nearly equal length with their offsets."""
        cuts = [len(self.text) * i // (self.edits + 1) for i in range(self.edits + 2)]
        return [(a, self.text[a:b]) for a, b in zip(cuts, cuts[1:])]


#: Exact phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Creative Commons: what follows "by" or "attribution" in a license's name.
_TERMS = {
    "cc-by": (), "cc-by-sa": ("sa",), "cc-by-nd": ("nd",), "cc-by-nc": ("nc",), "cc-by-nc-sa": ("nc", "sa"), "cc-by-nc-nd": ("nc", "nd"),
}
_SPELLED = {"sa": ("sharealike", "share alike"), "nd": ("noderivatives", "no derivatives", "noderivs"), "nc": ("noncommercial", "non commercial")}


def _creative_commons() -> tuple[Notice, ...]:
    made = []
    for label, terms in _TERMS.items():
        short = ("cc", "by", *terms)
        made.append(Notice(label, " ".join(("licensed under", *short)), 2, short))
        for words in product(*(_SPELLED[t] for t in terms)):
            name = " ".join(("attribution", *words))
            made.append(Notice(label, f"creative commons {name}", 2, tuple(name.split())))
    return tuple(made)


NOTICES = (
    Notice("mit", "mit license", 1, ("mit",)),
    Notice("mit", "permission is hereby granted free of charge to any person obtaining a copy", 6, ("free", "of", "charge", "person")),
    Notice("apache", "apache license", 1, ("apache",)),
    Notice("apache", "you may not use this file except in compliance with the license", 5),
    Notice("gpl", "general public license", 2, ("general", "public")),
    Notice("lgpl", "lesser general public license", 2, ("lesser", "general", "public")),
    Notice("agpl", "affero general public license", 2, ("affero", "general", "public")),
    Notice("gpl", "this program is free software you can redistribute it and or modify it", 6, ("free",)),
    Notice("bsd", "redistribution and use in source and binary forms", 4, ("source", "binary")),
    Notice("mpl", "mozilla public license", 2, ("mozilla", "public")),
    *_creative_commons(),
    Notice("isc", "permission to use copy modify and or distribute this software for any purpose", 6, ("and", "or", "for", "any")),
    Notice(
        "postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose", 6,
        ("distribute", "documentation", "for", "any"),
    ),
    Notice("proprietary", "all rights reserved", 1, ("all", "reserved")),
)
#: Stands in open notices too, so it counts only where nothing else is found.
LAST = "proprietary"
FIELDS = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"]
_TYPE = (
    "struct<n_words: bigint, n_base: bigint, first_word: bigint, last_word: bigint, base_labels: string, labels: string, "
    "score: double, matches: array<struct<label: string, notice: string, edits: int, start: bigint, end: bigint, "
    "first_word: bigint, n_words: bigint>>>"
)
_ARROW = pa.struct(
    [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()),
     ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
     ("matches", pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("edits", pa.int32()),
                                     ("start", pa.int64()), ("end", pa.int64()), ("first_word", pa.int64()),
                                     ("n_words", pa.int64())])))]
)


class Scanner:
    """Automaton and patterns of one set of phrases and notices."""

    def __init__(self, phrases: dict[str, str], notices: tuple[Notice, ...]):
        self.phrases = [(b" " + p.encode() + b" ", label) for p, label in phrases.items()]
        self.notices = notices
        self.patterns = [regex.compile(rf"(?e)\b(?:{regex.escape(n.text)}){{e<={n.edits}}}\b") for n in notices]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, n in enumerate(notices):
            for offset, piece in n.pieces():
                seeds.setdefault(piece, []).append((i, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in seeds.items():
            self.automaton.add_word(piece, (len(piece), owners))
        if seeds:
            self.automaton.make_automaton()

    def places(self, norm: bytes) -> list[tuple[int, str]]:
        """Word number and label of every place where a phrase stands; ``norm`` has a space at either end."""
        found = []
        for phrase, label in self.phrases:
            word = last = 0
            at = norm.find(phrase)
            while at >= 0:
                word, last = word + norm.count(b" ", last, at), at
                found.append((word, label))
                at = norm.find(phrase, at + 1)
        return found

    def windows(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """By notice, the joined stretches of ``text`` that seeds point at, cut at spaces."""
        hits: dict[int, list[tuple[int, int]]] = {}
        if not self.notices:
            return hits
        for last, (size, owners) in self.automaton.iter(text):
            for i, offset in owners:
                n = self.notices[i]
                start = last + 1 - size - offset
                hits.setdefault(i, []).append((max(0, start - n.edits), min(len(text), start + len(n.text) + n.edits)))
        joined = {}
        for i, spans in hits.items():
            out: list[tuple[int, int]] = []
            for a, b in sorted(spans):
                if out and a <= out[-1][1]:
                    if b > out[-1][1]:
                        out[-1] = (out[-1][0], self._end(text, b))
                else:
                    out.append((text.rfind(" ", 0, a + 1) + 1, self._end(text, b)))
            joined[i] = out
        return joined

    @staticmethod
    def _end(text: str, at: int) -> int:
        space = text.find(" ", at)
        return len(text) if space < 0 else space

    def fuzzy(self, text: str) -> list[tuple[Notice, int, int, int]]:
        """Notice, edits, start and end of the matches in text of single-spaced words."""
        found = []
        for i, spans in self.windows(text).items():
            for a, b in spans:
                for m in self.patterns[i].finditer(text, a, b):
                    if m.end() > m.start() and self.notices[i].stands(m[0]):
                        found.append((self.notices[i], sum(m.fuzzy_counts), m.start(), m.end()))
        return sorted(found, key=lambda x: (x[2], x[3], x[0].text))

    @staticmethod
    def settled(found: list[tuple[Notice, int, int, int]]) -> list[tuple[Notice, int, int, int]]:
        """Of overlapping matches the longest notice, then the one with the fewest edits."""
        kept: list[tuple[Notice, int, int, int]] = []
        group, end = [], 0

        def take() -> None:
            taken: list[tuple[Notice, int, int, int]] = []
            for x in sorted(group, key=lambda x: (-len(x[0].text), x[1], x[2], x[0].label)):
                if all(x[3] <= y[2] or x[2] >= y[3] for y in taken):
                    taken.append(x)
            kept.extend(sorted(taken, key=lambda x: x[2]))

        for x in found:  # in order of their start
            if group and x[2] >= end:
                take()
                group = []
            end = max(end, x[3]) if group else x[3]
            group.append(x)
        take()
        return kept

    def scan(self, raw: str | None) -> tuple:
        plain = utf8(raw).translate(_PLAIN)
        words = plain.split()
        norm = b" ".join(words)
        base = self.places(b" " + norm + b" ")
        text = norm.decode("utf-8", "surrogatepass")
        fuzzy = self.settled(self.fuzzy(text))
        if base or any(n.label != LAST for n, *_ in fuzzy):
            fuzzy = [x for x in fuzzy if x[0].label != LAST]
        matches = []
        if fuzzy:
            spans = [m.span() for m in _WORD.finditer(plain)]
            # Code points before each byte.
            chars = np.concatenate(([0], np.cumsum((np.frombuffer(plain, np.uint8) & 0xC0) != 0x80)))
            first = last = 0
            for n, edits, a, b in fuzzy:
                first, last = first + text.count(" ", last, a), a
                count = text.count(" ", a, b) + 1
                at, to = spans[first][0], spans[first + count - 1][1]
                matches.append((n.label, n.text, edits, int(chars[at]), int(chars[to]), first, count))
        exact = {label for _, label in base}
        near = {n.label for n, *_ in fuzzy}
        best = 1.0 if base else max((1 - edits / len(n.text) for n, edits, _, _ in fuzzy), default=0.0)
        starts = [w for w, _ in base]
        return (
            len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(exact)),
            ",".join(sorted(exact | near)), max(0.0, best), matches,
        )


@lru_cache(maxsize=8)
def scanner(phrases: tuple[tuple[str, str], ...], notices: tuple[Notice, ...]) -> Scanner:
    """Built once in each worker."""
    return Scanner(dict(phrases), notices)


def license_scan(text: Column, phrases: dict[str, str], notices: tuple[Notice, ...]) -> Column:
    key = tuple(phrases.items())

    @F.arrow_udf(_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        find = scanner(key, notices).scan
        rows = [dict(zip(FIELDS, find(x.as_py()))) for x in texts]
        for r in rows:
            r["matches"] = [
                dict(zip(("label", "notice", "edits", "start", "end", "first_word", "n_words"), m)) for m in r["matches"]
            ]
        return pa.array(rows, _ARROW)

    return scan(text)


def scan_licenses(
    docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, notices: tuple[Notice, ...] = NOTICES
) -> DataFrame:
    """License phrases and notices of every whole text.

    Adds ``n_words``; ``n_base``, ``first_word``, ``last_word`` and ``base_labels`` of the exact phrases; ``matches``, an
    array of label, notice, edits, character span (``start``, ``end``, from 0) and first word and number of words of every
    notice found, the longest one where several overlap; ``labels``, the distinct sorted labels of both; and ``score``, 1 for an exact phrase, else the share of
    the best notice's characters that stand unchanged, 0 without one.

    A null text is read as empty: no words, no matches, empty labels, null first and last word. Rows are handled one by
    one, so repeated rows get equal results and an empty table stays empty. Other columns stay as they are; a column named
    as a result is replaced. Texts of any length are read whole.
    """
    made = license_scan(F.col(f"`{text}`").cast("string"), PHRASES if phrases is None else phrases, notices)
    return with_fields(docs, made, FIELDS)
