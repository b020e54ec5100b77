"""Rows that every document operator has to take."""

#: Null and empty texts, white space, ties, repeated rows, a null id, and a very long text.
LONG = "\n".join(f"line number {i} of a very long text that goes on and on for {i * i} words" for i in range(20_000))
ROWS = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "Two words"), (6, "Two words"), (7, "two  WORDS"), (8, LONG),
    (9, "The MIT  License, and\nthe Apache-License; see the GNU General Public Licence. MIT license"),
    (10, "Ünïcödé \U0001F600 日本語 text\x00 with a null\x0bbyte"), (11, "12345 67890 --- ###"),
    (12, "the general public license the general public license"), (12, "the general public license the general public license"),
    (None, "a row without an id"),
]
#: Columns that have names of the operators' own or temporary columns.
EXTRA = ["n_words", "score", "fingerprint", "kept", "made", "part", "n_lines", "row_hash", "place", "quality", "copy"]
