"""Plain Python versions of the operators, by definition and pair by pair."""

from __future__ import annotations

import re
from collections import Counter
from itertools import combinations

import xxhash

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text: str | None) -> list[str]:
    return [w for w in SPACE.split(text or "") if w]


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def fingerprint(text: str | None, n: int = 3) -> int:
    ws = words(lower(text or ""))
    shingles = [" ".join(ws[i : i + n]) for i in range(len(ws) - n + 1)] or ([" ".join(ws)] if ws else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, linked) -> dict:
    """Smallest node that can be reached, by trying all pairs."""
    label = {n: n for n in nodes}

    def root(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in combinations(nodes, 2):
        if linked(a, b):
            x, y = sorted((root(a), root(b)))
            label[y] = x
    return {n: root(n) for n in nodes}


def within_one(a: str, b: str) -> bool:
    """Whether one character inserted, deleted or replaced at most makes ``b`` of ``a``."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:]


def without_lines(docs: list[tuple[int, str]], min_chars: int = 30) -> dict[int, tuple[str | None, int, int]]:
    """doc_id -> text, lines, dropped lines; ids are unique."""
    seen: list[str] = []
    out = {}
    for key, text in sorted(docs):
        if text is None:
            out[key] = (None, 0, 0)
            continue
        lines, kept = text.split("\n"), []
        for line in lines:
            if len(line) < min_chars:
                kept.append(line)
            else:
                if not any(within_one(line, s) for s in seen):
                    kept.append(line)
                seen.append(line)
        out[key] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def quality(text: str | None) -> dict:
    text = text or ""
    ws = words(text)
    windows = Counter(tuple(ws[i : i + 3]) for i in range(len(ws) - 2))
    inside = {j for i in range(len(ws) - 2) if windows[tuple(ws[i : i + 3])] > 1 for j in range(i, i + 3)}
    lines = text.split("\n")
    return {
        "n_words": len(ws),
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": sum(bool(words(x)) and x in lines[:i] for i, x in enumerate(lines)),
        "n_repeat_words": len(inside),
        "base_failed": len(ws) < 50 or 100 * len(inside) > 50 * len(ws),
    }


def later_share(text: str, n: int) -> float:
    """Share of word characters in the second and later copies of n-grams."""
    ws, seen, inside = words(text), set(), set()
    for i in range(len(ws) - n + 1):
        gram = tuple(ws[i : i + n])
        if gram in seen:
            inside |= set(range(i, i + n))
        seen.add(gram)
    return sum(len(ws[j]) for j in inside) / max(1, sum(map(len, ws)))


def top_share(text: str, n: int) -> float:
    ws = words(text)
    grams = Counter(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    most = max((k * sum(map(len, g)) for g, k in grams.items() if k > 1), default=0)
    return min(1.0, most / max(1, sum(map(len, ws))))
