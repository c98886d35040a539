"""String expressions: pieces, replacement, display forms, colours, DNA."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def piece(x: Column, sep: str, i: int) -> Column:
    """The i-th piece (from 1) between separators (a pattern), NULL where there are fewer."""
    return F.try_element_at(F.split(x, sep), F.lit(i))


def strip_version(x: Column) -> Column:
    """Without a final dot and digits; other names are unchanged."""
    return F.regexp_replace(x, r"\.\d+$", "")


def replace_first(x: Column, pattern: str, by: str) -> Column:
    """Only the first match of the pattern replaced; by is literal."""
    at = F.regexp_instr(x, F.lit(pattern))
    found = F.regexp_substr(x, F.lit(pattern))
    return F.when(at == 0, x).otherwise(F.concat(F.substring(x, F.lit(1), at - 1), F.lit(by), F.substring(x, at + F.length(found), F.length(x))))


def title(x: Column) -> Column:
    """First letter in upper case, the rest as it is."""
    return F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))


def base_name(x: Column) -> Column:
    return F.element_at(F.split(x, "/"), -1)


def hex_colour(x: Column) -> Column:
    """"r,g,b" as "#RRGGBB"; NULL unless there are three numbers."""
    part = [F.lpad(F.hex(piece(x, ",", i).try_cast("int")), 2, "0") for i in (1, 2, 3)]
    return F.concat(F.lit("#"), *part)


def reverse_complement(x: Column) -> Column:
    return F.reverse(F.translate(x, "ACGTacgt", "TGCAtgca"))


def keep_empty(x: Column, missing: str = "NA") -> Column:
    """For text read with empty as NULL: empty again is "", the missing mark is NULL."""
    return F.when(x.isNull(), F.lit("")).when(x != missing, x)
