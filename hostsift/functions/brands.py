"""Brand look-alike expressions.

Everything runs inside the row: the brand list is a literal array, so matching
billions of hosts needs neither a join nor a shuffle.

The similarity is the insert/delete ratio ``2 * LCS / (len_a + len_b)``.  LCS is
computed bit-parallel (Crochemore et al., 2001): the state is one BIGINT whose
zero bits count the matched brand letters, folded over the letters of the piece.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostsift.functions.literals import literal_array, quoted
from hostsift.rules import DEFAULT_RULES, RuleSet

MIN_PIECE = 4
RATIO_PERCENT = 85


def brand_dimension(brands: tuple[str, ...]) -> Column:
    """Literal array of (brand, length, edit limit, all-ones mask, letter -> position mask)."""
    rows = []
    for brand in brands:
        n = len(brand)
        masks = {ch: sum(1 << i for i, b in enumerate(brand) if b == ch) for ch in brand}
        entries = ", ".join(f"'{ch}', {mask}L" for ch, mask in masks.items())
        rows.append(
            f"named_struct('brand', '{brand}', 'n', {n}, 'limit', {max_edit_distance(brand)}, "
            f"'full', {(1 << n) - 1}L, 'masks', map({entries}))"
        )
    return F.expr(f"array({', '.join(rows)})")


def lcs_length(piece: Column, brand: Column) -> Column:
    """Longest common subsequence of a string and one entry of the brand dimension."""
    full = brand["full"]
    masks = F.transform(
        F.split(piece, ""), lambda ch: F.coalesce(F.try_element_at(brand["masks"], ch), F.lit(0).cast("bigint"))
    )
    state = F.aggregate(
        masks,
        full,
        lambda v, m: (v + v.bitwiseAND(m)).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full),
    )
    return brand["n"] - F.bit_count(state)


def max_edit_distance(brand: str) -> int:
    """Largest insert/delete distance to a brand that can still exceed the ratio.

    d < (1-r)(la+lb) and |la-lb| <= d give d < 2(1-r)/r * lb.  Levenshtein never
    exceeds the insert/delete distance, so it is a safe and native pre-filter.
    """
    r = RATIO_PERCENT / 100
    return int(2 * (1 - r) / r * len(brand))


def brand_hits(pieces: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """All (piece, brand, similarity) pairs above the ratio, as an array of structs."""
    dim = brand_dimension(rules.brands)

    def near(piece: Column):
        def test(b: Column) -> Column:
            similar_length = F.abs(F.length(piece) - b["n"]) <= b["limit"]
            return similar_length & (F.call_function("levenshtein", piece, b["brand"], b["limit"]) >= 0)

        return test

    def measured(piece: Column):
        return lambda b: F.struct(
            piece.alias("piece"),
            b["brand"].alias("brand"),
            lcs_length(piece, b).alias("common"),
            (F.length(piece) + b["n"]).alias("letters"),
        )

    pairs = F.flatten(F.transform(pieces, lambda p: F.transform(F.filter(dim, near(p)), measured(p))))
    hits = F.filter(pairs, lambda m: m["common"] * 200 > m["letters"] * RATIO_PERCENT)
    return F.transform(
        hits,
        lambda m: F.struct(m["piece"], m["brand"], (m["common"] * 2 / m["letters"]).alias("similarity")),
    )


def host_pieces(host: Column, skeleton: Column) -> Column:
    """Distinct folded pieces of a host and of its skeleton, four letters or more."""
    raw = F.split(F.concat(host, F.lit("."), skeleton), r"[.\-]")
    folded = F.transform(
        raw, lambda p: F.translate(F.regexp_replace(p, "[^a-z0-9]", ""), "013", "ole")
    )
    return F.array_distinct(F.filter(folded, lambda p: F.length(p) >= MIN_PIECE))


def bind(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body reads it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def typo_brand(host: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """First brand at Levenshtein distance exactly 1 from the first host label, or NULL."""
    brands = literal_array(rules.brands)
    return bind(
        F.substring_index(host, ".", 1),
        lambda name: F.get(F.filter(brands, lambda b: F.levenshtein(name, b, 1) == 1), F.lit(0)),
    )


def subdomain_brand(url: Column, rules: RuleSet = DEFAULT_RULES) -> Column:
    """First label before the last two that is a brand, or NULL."""
    text = F.substring_index(F.substring_index(url, "//", -1), "/", 1)
    brand = "|".join(map(re.escape, rules.brands))
    found = F.regexp_extract(text, rf"(?s)^(?:[^.]*\.)*?({brand})\.[^.]*\..*$", 1)
    return F.nullif(found, F.lit(""))


def _of_text(text: str, body: str) -> Column:
    """``body`` over the variable ``t``, bound once to a column name or SQL expression.

    The tests below are long chains over fixed lists: stated as text they are
    parsed in one call, and a chain is faster than a lambda per list entry.
    """
    return F.expr(f"get(transform(array({text}), t -> {body}), 0)")


def brand_in_domain(host: str = "host", rules: RuleSet = DEFAULT_RULES) -> Column:
    """A brand is part of the host and the host is not that brand's own."""

    def foreign(brand: str) -> str:
        b, com, under = (quoted(x) for x in (brand, f"{brand}.com", f".{brand}.com"))
        return f"(contains(t, {b}) AND NOT (t IN ({b}, {com}) OR endswith(t, {under})))"

    return _of_text(host, " OR ".join(map(foreign, rules.brands)) or "false")


def on_shared_hosting(host: str = "host", rules: RuleSet = DEFAULT_RULES) -> Column:
    tests = (f"t = {quoted(r)} OR endswith(t, {quoted('.' + r)})" for r in rules.shared_hosting_roots)
    return _of_text(host, " OR ".join(tests) or "false")


def any_keyword(text: str, rules: RuleSet = DEFAULT_RULES) -> Column:
    return _of_text(text, " OR ".join(f"contains(t, {quoted(k)})" for k in rules.keywords) or "false")


def keyword_count(text: str, rules: RuleSet = DEFAULT_RULES) -> Column:
    """How many of the listed keywords occur in the text."""
    return _of_text(text, " + ".join(f"int(contains(t, {quoted(k)}))" for k in rules.keywords) or "0")
