"""URL normalisation and parsing as built-in column expressions.

Hosts are cut out with anchored regular expressions: ``parse_url`` raises or
returns NULL for underscores, blanks and many of the malformed URLs that threat
feeds are full of, and every row has to survive.

Where possible an expression reads its input once.  Catalyst pushes filters
through projections by substitution, so a twice-read input would double the work
and the generated code at every level of nesting.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from hostsift.rules import SECOND_LEVEL_LABELS, SUFFIX_PAIRS

_SCHEME = r"[A-Za-z][A-Za-z0-9+.\-]*://"
SCHEME = f"^{_SCHEME}"
NETLOC = rf"^{_SCHEME}([^/?#]*)"
AFTER_NETLOC = rf"^{_SCHEME}[^/?#]*([^?#]*)"
NO_SCHEME = rf"^(?!{_SCHEME})"
BARE = rf"(?s)^({_SCHEME}[^/?#]*).*$"
# Some segment has text before its ';params', which only the last one may have.
HAS_PATH = rf"^{_SCHEME}[^/?#]*(?:/[^?#]*)?/(?:[^/;?#]|;[^?#]*/)"
HAS_PATH_OR_QUERY = rf"{HAS_PATH}|^{_SCHEME}[^?#]*\?[^#]"
BRACKETED_V6 = r"\[[0-9a-fA-F:]+\]"

# Userinfo up to the last '@', then an [IPv6] literal or everything before ':'.
HOST = rf"(?s)^{_SCHEME}(?:[^/?#]*@)?(?:\[([^\]/?#]*)|([^:/?#]*)).*$"
_HAS_OPEN, _HAS_CLOSE = r"[^/?#]*\[", r"[^/?#]*\]"
UNBALANCED = (
    rf"(?s)^{_SCHEME}(?:(?={_HAS_OPEN})(?!{_HAS_CLOSE})|(?={_HAS_CLOSE})(?!{_HAS_OPEN})).*$"
)

ROOT = rf"([^.]*\.(?:{'|'.join(SECOND_LEVEL_LABELS)})\.[^.]*|[^.]*\.[^.]*|[^.]*)$"

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_H = r"[0-9a-fA-F]{1,4}"


def _v6_pattern() -> str:
    """IPv6 grammar by rule: i groups, ``::``, up to 7-i groups; v4 tails count as two."""
    forms = [rf"(?:{_H}:){{7}}{_H}", rf"(?:{_H}:){{6}}{_V4}"]
    for i in range(8):
        left = "" if i == 0 else rf"{_H}(?::{_H}){{{i - 1}}}"
        right = "" if i == 7 else rf"(?:{_H}(?::{_H}){{0,{6 - i}}})?"
        forms.append(f"{left}::{right}")
        if i <= 5:
            forms.append(rf"{left}::(?:{_H}:){{0,{5 - i}}}{_V4}")
    return "(?:" + "|".join(forms) + ")(?:%[^%]+)?"


def _v6_loopback() -> str:
    """``::1`` in any spelling: zero groups, at most one ``::``, a last group of one."""
    zero, one = "0{1,4}", "0{0,3}1"
    forms = [rf"(?:{zero}:){{7}}{one}"]
    for i in range(7):
        left = "" if i == 0 else rf"{zero}(?::{zero}){{{i - 1}}}"
        forms.append(rf"{left}::(?:{zero}:){{0,{6 - i}}}{one}")
    return "(?:" + "|".join(forms) + ")"


IP_LITERAL = rf"^(?:{_V4}|{_v6_pattern()})$"
LOOPBACK = rf"^(?:localhost|127(?:\.{_OCTET}){{3}}|{_v6_loopback()})$"


def py_strip(c: Column) -> Column:
    """Trim all leading and trailing white space (``trim`` only removes blanks)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def count_char(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def normalize_url(url: Column, max_len: int | None = None) -> Column:
    """De-fang and tidy a URL: ``hxxp``, ``[.]``, stray brackets, slash runs.

    ``max_len`` cuts the input, for entry points that limit what a user may send; jobs and keys use whole URLs.
    """
    u = py_strip(F.coalesce(url, F.lit("")))
    if max_len is not None:
        u = F.substring(u, 1, max_len)
    u = F.regexp_replace(u, r"^(?i:hxxp)", "http")
    u = F.regexp_replace(u, r"(?i)\[\s*dot\s*\]", ".")
    for fanged, plain in (("[.]", "."), ("(.)", "."), ("{.}", "."), ("[:]", ":"), ("[/]", "/")):
        u = F.replace(u, F.lit(fanged), F.lit(plain))
    u = F.when(u.rlike(BRACKETED_V6), u).otherwise(F.translate(u, "[]", ""))
    return py_strip(F.regexp_replace(u, r"(?<!:)/{2,}", "/"))


def has_text(url: Column) -> Column:
    """Would anything be left after normalisation?  A cheap test on the raw value."""
    return url.rlike(r"[^\s\[\]]")


def ensure_scheme(url: Column) -> Column:
    return F.regexp_replace(py_strip(F.coalesce(url, F.lit(""))), NO_SCHEME, "http://")


def parser_view(url: Column) -> Column:
    """What a URL parser sees: tabs and line breaks inside a URL are not part of it."""
    return F.translate(url, "\t\r\n", "")


def netloc(url_with_scheme: Column) -> Column:
    return F.regexp_extract(parser_view(url_with_scheme), NETLOC, 1)


def _lookalike_delimiters() -> str:
    """Characters that become a delimiter of the authority when compatibility forms are folded; parsers refuse them."""
    folded = ((chr(c), unicodedata.normalize("NFKC", chr(c))) for c in range(0x80, 0x10000) if not 0xD800 <= c < 0xE000)
    return "".join(ch for ch, plain in folded if any(d in plain for d in "/?#@:"))


LOOKALIKE_DELIMITERS = _lookalike_delimiters()


def unparsable(authority: Column) -> Column:
    """Whether a parser refuses the authority."""
    return authority.rlike(f"[{LOOKALIKE_DELIMITERS}]")


def strip_www(host: Column) -> Column:
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def parse_host(url: Column) -> Column:
    """Serving host: no userinfo, port or ``www.``; IPv6 literals are unwrapped."""
    sound = F.regexp_replace(parser_view(ensure_scheme(url)), UNBALANCED, "")
    return strip_www(F.regexp_replace(sound, HOST, "$1$2"))


def label_count(host: Column) -> Column:
    return F.regexp_count(host, F.lit(r"\.")) + 1


def second_last_label(host: Column) -> Column:
    return F.substring_index(F.substring_index(host, ".", -2), ".", 1)


def registrable_root_of_host(host: Column) -> Column:
    """Last two labels, or three when the second-last is ``co``, ``ac``, ``gov``..."""
    return F.regexp_extract(strip_www(host), ROOT, 1)


def registrable_root(url: Column) -> Column:
    return registrable_root_of_host(parse_host(url))


def registrable_root_pairs(url: Column) -> Column:
    """Variant with an explicit suffix-pair list; built on a plain string split."""
    rest = F.regexp_replace(F.lower(py_strip(F.coalesce(url, F.lit("")))), r"^[a-z]+://", "")
    host = F.regexp_extract(rest, r"^([^/?]*)", 1)
    host = strip_www(F.substring_index(F.substring_index(host, "@", -1), ":", 1))
    dense = F.regexp_replace(F.regexp_replace(host, r"\.{2,}", "."), r"^\.|\.$", "")
    pair = F.substring_index(dense, ".", -2)
    return (
        F.when((dense == "") | (label_count(dense) <= 2), host)
        .when(pair.isin(*SUFFIX_PAIRS), F.substring_index(dense, ".", -3))
        .otherwise(pair)
    )


def host_is_ip(host: Column) -> Column:
    return host.rlike(IP_LITERAL)


def host_is_loopback(host: Column) -> Column:
    """``localhost``, 127.0.0.0/8 or ``::1``."""
    return host.rlike(LOOPBACK)


def strip_to_host(url: Column) -> Column:
    """``scheme://netloc`` of a URL, ``http`` when it has no scheme."""
    u = ensure_scheme(F.translate(F.coalesce(url, F.lit("")), "[]", ""))
    return F.concat(F.lower(F.substring_index(u, "://", 1)), F.lit("://"), netloc(u))


def url_path(url_with_scheme: Column) -> Column:
    """Path without the ``;params`` of its last segment."""
    return F.regexp_replace(F.regexp_extract(parser_view(url_with_scheme), AFTER_NETLOC, 1), r";[^/]*$", "")


def has_path(url: Column, mode: str = "path_or_query") -> Column:
    """Whether a URL carries a path.

    ``path_or_query``  a non-slash path or a non-empty query;
    ``split``          something after the first slash, or a ``?`` anywhere;
    ``path``           a non-slash path, the query ignored.
    """
    if mode == "split":
        rest = F.regexp_replace(F.lower(py_strip(F.coalesce(url, F.lit("")))), r"^[a-z]+://", "")
        return rest.rlike(r"/+[^/]|\?")
    raw = F.coalesce(url, F.lit(""))
    if mode == "path":
        return ensure_scheme(raw).rlike(HAS_PATH)
    if mode == "path_or_query":
        return ensure_scheme(F.translate(raw, "[]", "")).rlike(HAS_PATH_OR_QUERY)
    raise ValueError(f"unknown mode {mode!r}")


def strip_http_scheme(url: Column) -> Column:
    """Text the model reads: the protocol must not be a feature."""
    return F.regexp_replace(url, r"^https?://", "")


def csv_safe(value: Column) -> Column:
    """Guard a cell against being read as a spreadsheet formula."""
    v = F.coalesce(value.cast("string"), F.lit(""))
    return F.when(v.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), v)).otherwise(v)


def leet_fold(text: Column) -> Column:
    """Keep [a-z0-9], then read 0, 1, 3 as o, l, e."""
    return F.translate(F.regexp_replace(text, "[^a-z0-9]", ""), "013", "ole")


def leet_obfuscate(text: Column) -> Column:
    return F.translate(text, "oleia", "01314")
