"""Text scalars shared by the operators (X-01 .. X-21).

White space is the class of the ECMAScript ``\\s``: Java's and RE2's own classes
differ from it, so every pattern spells it out.  Lengths come in three kinds:
code points, code points that aren't white space, and UTF-16 units.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The white-space class and its characters.
WS = r"[\t\n\x0b\x0c\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"
SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
PILCROW = "¶"

#: Spellings of predicates that mean the same.
PREDICATE_ALIASES = {
    "location": "current_location",
    "currently_at": "current_location",
    "位于": "current_location",
    "位置": "current_location",
    "physical_condition": "physical_state",
    "health_status": "physical_state",
    "身体状态": "physical_state",
    "alive_status": "life_status",
    "is_alive": "life_status",
    "生死": "life_status",
    "held_by": "holder",
    "owner": "holder",
    "持有人": "holder",
    "relation": "relationship",
    "关系": "relationship",
    "knowledge_state": "knows",
    "is_aware": "knows",
    "知情": "knows",
}


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def solid_chars(text: Column) -> Column:
    """X-01: code points that aren't white space."""
    return F.length(F.regexp_replace(text, WS, ""))


def prompt_chars(text: Column) -> Column:
    """X-02: code points."""
    return F.length(text)


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def numbered_cost(text: Column, n: Column) -> Column:
    """X-03: length of a paragraph with its number in front."""
    return numbered_size(F.length(text), n)


def numbered_size(length: Column, n: Column) -> Column:
    """X-03 of a paragraph of which only the length is at hand."""
    return length + F.length(F.concat(F.lit(PILCROW), n.cast("string"), F.lit(" ")))


def lines(text: Column) -> Column:
    """X-05: the trimmed, non-empty lines as an array.  A line end of two
    characters counts as two, what lies between is empty."""
    return F.filter(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n"), trim), lambda x: F.length(x) > 0)


def norm_text(value: Column) -> Column:
    """X-09: case-folded with all white space gone; null becomes ''."""
    return F.coalesce(F.regexp_replace(F.lower(value), WS, ""), F.lit(""))


def canonical_predicate(value: Column) -> Column:
    """X-10."""
    n = F.regexp_replace(norm_text(value), "-", "_")
    return F.coalesce(F.create_map(*map(F.lit, chain.from_iterable(PREDICATE_ALIASES.items())))[n], n)


def fact_key(kind: Column, subject: Column, predicate: Column, perspective: Column) -> Column:
    """X-11: kind, subject, predicate and perspective; a missing part is ''."""
    return F.concat_ws(":", norm_text(kind), norm_text(subject), canonical_predicate(predicate), norm_text(perspective))


def same_value(a: Column, b: Column) -> Column:
    """X-12: equal in normal form; null is equal to ''."""
    return norm_text(a) == norm_text(b)


def ref_key(chapter: Column, chunk: Column, start: Column, end: Column) -> Column:
    """X-18: the key by which references are the same."""
    return F.format_string("%s:%s:%d-%d", chapter, chunk, start, end)


def clip(text: Column, size: int) -> Column:
    """X-14: white space collapsed, cut to ``size`` with an ellipsis."""
    flat = trim(F.regexp_replace(text, f"{WS}+", " "))
    return F.when(F.length(flat) > size, F.concat(F.substring(flat, 1, size - 1), F.lit("…"))).otherwise(flat)


def padded_id(prefix: str, i: Column, width: int = 3) -> Column:
    """X-16: ids padded with zeros, never cut."""
    return F.format_string(f"{prefix}%0{width}d", i)


def scoped_id(scope: Column, ident: Column) -> Column:
    """X-17: prefix with the scope unless it is there already."""
    head = F.concat(scope, F.lit("::"))
    return F.when(F.startswith(ident, head), ident).otherwise(F.concat(head, ident))


def safe_filename(name: Column) -> Column:
    """S-09."""
    return F.regexp_replace(name, r'[\\/:*?"<>|]', "_")


def default_title(text: Column, title: Column | None = None, fallback: str = "未命名改编") -> Column:
    """S-17: explicit title, else the first line cut to 20, else a fallback."""
    first = F.get(F.filter(F.transform(F.split(text, r"\r?\n"), trim), lambda x: F.length(x) > 0), F.lit(0))
    given = F.lit(None).cast("string") if title is None else F.nullif(trim(title), F.lit(""))
    return F.coalesce(given, F.substring(first, 1, 20), F.lit(fallback))
