"""Literals of INSERT statements back to texts, the inverse of ``rendering.sql_literal``.

A statement is split at its quotes. Pieces then stand outside and inside of literals in
turn, and an empty piece outside, between two others, is a quote that was doubled. Only
pieces outside hold structure, so what looks like structure in a literal is left alone.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUOTE = "'"
ROW, CELL = "\x1e", "\x1f"
# What literals hold of the characters that have a meaning here is written as this
# character and a letter; itself last, so that no step meets what another one made.
ESCAPE = "\x1a"
_CODES = ((ROW, "R"), (CELL, "C"), (QUOTE, "Q"), ("\\", "B"))

# Escapes of dumps that use backslashes.
BACKSLASHES = (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\0", "\x00"), ("\\Z", "\x1a"), ('\\"', '"'))


def _replaced(text: Column, old: str, new: str) -> Column:
    return F.replace(text, F.lit(old), F.lit(new))


def sheltered(line: Column, backslashes: bool = False) -> Column:
    """A line of a dump in which every quote opens, closes or doubles."""
    line = _replaced(line, ESCAPE, ESCAPE + "Z")
    if backslashes:
        line = _replaced(_replaced(line, "\\\\", ESCAPE + "B"), "\\'", ESCAPE + "Q")
    return line


def quotes(line: Column) -> Column:
    return F.char_length(line) - F.char_length(_replaced(line, QUOTE, ""))


def tuples(values: Column) -> Column:
    """Cells of each tuple of a sheltered VALUES list, as :func:`cell_text` reads them."""
    # The pieces are bound to a name, so that the statement is split once.
    marked = F.transform(F.array(F.split(values, QUOTE, -1)), _marked)
    rows = F.split(F.array_join(F.get(marked, F.lit(0)), ""), ROW, -1)
    return F.transform(rows, lambda row: F.split(row, CELL, -1))


def _marked(pieces: Column) -> Column:
    """The pieces with their structure, and what opens a literal, marked."""
    last = F.size(pieces) - 1

    def mark(piece: Column, i: Column) -> Column:
        inside = _replaced(_replaced(piece, ROW, ESCAPE + "R"), CELL, ESCAPE + "C")
        outside = F.when(i == 0, F.regexp_replace(piece, r"^\s*\(\s*", "")).otherwise(piece)
        outside = F.when(i == last, F.regexp_replace(outside, r"\s*\)\s*;?\s*$", "")).otherwise(outside)
        outside = F.regexp_replace(outside, r"\s*\)\s*,\s*\(\s*", ROW)
        outside = F.regexp_replace(outside, r"\s*,\s*", CELL)
        opening = F.when(i < last, QUOTE).otherwise("")
        return (
            F.when(i % 2 == 1, inside)
            .when((piece == "") & (i > 0) & (i < last), ESCAPE + "Q")
            .otherwise(F.concat(outside, opening))
        )

    return F.transform(pieces, mark)


def cell_text(cell: Column, backslashes: bool = False) -> Column:
    """Text of a cell; NULL without quotes is null."""
    quoted = F.substr(cell, F.lit(2))
    plain = quoted
    if backslashes:
        for mark, raw in BACKSLASHES:
            plain = _replaced(plain, mark, raw.replace(ESCAPE, ESCAPE + "Z"))
    for raw, code in _CODES:
        plain = _replaced(plain, ESCAPE + code, raw)
    plain = _replaced(plain, ESCAPE + "Z", ESCAPE)
    special = cell.contains(ESCAPE) | cell.contains("\\") if backslashes else cell.contains(ESCAPE)
    text = F.when(special, plain).otherwise(quoted)
    bare = F.when(F.upper(cell) != "NULL", cell)
    return F.when(cell.startswith(QUOTE), text).otherwise(bare)
