"""Text functions with Unicode semantics, as columns that stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Unicode has it, with the four separators x1C to x1F.
WS = r"[\s\x1c-\x1f]"
#: Line ends: LF, CR, VT, FF, FS to RS, NEL, LS and PS.
LINE_ENDS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def u(pattern: str) -> str:
    """A pattern whose classes follow Unicode."""
    return f"(?U){pattern}"


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that f names several times and that is computed once: it is bound as a variable."""
    return F.element_at(F.transform(F.array(value), f), 1)


def strip(c: Column) -> Column:
    return F.regexp_replace(c, u(rf"^{WS}+|{WS}+$"), "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, ends stripped."""
    return strip(F.regexp_replace(c, u(rf"{WS}+"), " "))


def is_blank(c: Column) -> Column:
    return ~F.coalesce(c, F.lit("")).rlike(u(r"[^\s\x1c-\x1f]"))


def words(c: Column) -> Column:
    """The words of a text, split at any white space."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), u(rf"{WS}+")), lambda w: w != "")


def word_count(c: Column) -> Column:
    return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(u(r"[^\s\x1c-\x1f]+")))


def lines(c: Column) -> Column:
    """Lines at any line end; a final line end opens no further line."""
    whole = lambda parts: F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return once(F.split(F.coalesce(c, F.lit("")), LINE_ENDS, -1), whole)


def is_upper(c: Column) -> Column:
    """At least one cased letter and none that is lower."""
    return (c == F.upper(c)) & (c != F.lower(c))


def utf16_length(c: Column) -> Column:
    return (F.octet_length(F.encode(c, "utf-16le")) / 2).cast("int")


def split_message(c: Column, limit: int = 3500) -> Column:
    """Pieces of at most limit UTF-16 units (two or more), cut between characters.

    The text is encoded once and cut by position: a step for each piece, not for each character. A piece ends a unit early
    where it would cut a surrogate pair, whose first unit has xD8 to xDB as its upper byte."""

    def cut(units: Column) -> Column:
        n = (F.octet_length(units) / 2).cast("int")
        upper = lambda at: F.hex(F.substring(units, 2 * at, 1))
        even = F.sequence(F.lit(0), n, F.lit(limit))
        # Where no cut between even pieces parts a pair, these are the pieces; else each one's start depends on the one before.
        parts_pair = lambda at: (at > 0) & (at < n) & upper(at).between("D8", "DB")
        after = lambda s: F.when(s + limit < n, s + limit - F.when(upper(s + limit).between("D8", "DB"), 1).otherwise(0)).otherwise(n)
        steps = F.sequence(F.lit(1), (n / (limit - 1)).cast("int") + 1)
        folded = F.aggregate(steps, F.array(F.lit(0)), lambda s, _: F.when(F.element_at(s, -1) < n, F.array_append(s, after(F.element_at(s, -1)))).otherwise(s))
        starts = F.filter(F.when(F.exists(even, parts_pair), folded).otherwise(even), lambda s: s < n)
        return F.transform(starts, lambda s: F.decode(F.substring(units, 2 * s + 1, 2 * (after(s) - s)), "utf-16le"))

    return once(F.encode(c, "utf-16le"), cut)


def sample_list(c: Column, most: int = 10) -> Column:
    """First places of an array of places from 0, counted from 1, with how many are left out."""
    n = F.size(c)
    shown = F.array_join(F.transform(F.slice(c, 1, most), lambda i: (i + 1).cast("string")), ", ")
    return F.when(n > most, F.concat(shown, F.lit(" (+"), (n - most).cast("string"), F.lit(")"))).otherwise(shown)
