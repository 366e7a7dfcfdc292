"""Scalar expressions shared by the operators. All run as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that Python's str.split() takes for white space.
SPACE = r"[\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: What Python's str.splitlines() takes for a line end.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
WORD = "[a-zA-Z_][a-zA-Z0-9_]{2,}"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def text_or_empty(x: Column | str) -> Column:
    return F.coalesce(_c(x), F.lit(""))


def stripped(x: Column | str) -> Column:
    return F.regexp_replace(_c(x), f"^{SPACE}+|{SPACE}+$", "")


def is_blank(x: Column | str) -> Column:
    return stripped(text_or_empty(x)) == ""


def tokens(x: Column | str) -> Column:
    """Lower-cased pieces between white space."""
    return F.filter(F.split(F.lower(text_or_empty(x)), f"{SPACE}+"), lambda t: t != "")


def query_terms(x: Column | str) -> Column:
    """Distinct lower-cased identifiers of three letters and more."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text_or_empty(x), F.lit(WORD), F.lit(0)), F.lower))


def slashed(x: Column | str, lower: bool = False) -> Column:
    out = F.replace(text_or_empty(x), F.lit("\\"), F.lit("/"))
    return F.lower(out) if lower else out


def haystack(text: Column | str = "text", block: Column | str = "block_name", section: Column | str = "section_title") -> Column:
    """Lower-cased text, block name and section title; absent ones are empty but keep their separator."""
    return F.lower(F.concat(text_or_empty(text), F.lit(" "), text_or_empty(block), F.lit(" "), text_or_empty(section)))


def any_of(needles: Column, hay: Column) -> Column:
    return F.coalesce(F.exists(needles, lambda n: F.contains(hay, F.lower(n))), F.lit(False))


def all_of(needles: Column, hay: Column) -> Column:
    """True for no needles."""
    return F.coalesce(F.forall(needles, lambda n: F.contains(hay, F.lower(n))), F.lit(True))


def none_given(x: Column) -> Column:
    return F.coalesce(F.size(x), F.lit(0)) <= 0


def overlap(terms: Column, hay: Column) -> Column:
    return F.size(F.filter(terms, lambda t: F.contains(hay, t)))


def snippet(x: Column | str, lines: int = 3, chars: int = 280) -> Column:
    """The first non-blank lines, cut with an ellipsis."""
    kept = F.filter(F.transform(F.split(text_or_empty(x), LINE_END), stripped), lambda t: t != "")
    out = F.array_join(F.slice(kept, 1, lines), "\n")
    return F.when(F.length(out) > chars, F.concat(F.substring(out, 1, chars - 3), F.lit("..."))).otherwise(out)


def category_of(rel_path: Column | str, inside: Column | None = None, parent: Column | None = None) -> Column:
    """`common/<x>/…` is <x>; any other path its first part; outside the tree the parent directory or `unknown`."""
    parts = F.split(slashed(rel_path), "/")
    own = F.when((F.get(parts, F.lit(0)) == "common") & (F.size(parts) > 2), F.get(parts, F.lit(1))).otherwise(F.get(parts, F.lit(0)))
    if inside is None:
        return own
    return F.when(inside, own).otherwise(F.coalesce(F.nullif(parent, F.lit("")), F.lit("unknown")))


def stem_title(path: Column | str) -> Column:
    return F.replace(F.regexp_extract(_c(path), r"([^/]*?)(?:\.[^./]*)?$", 1), F.lit("_"), F.lit(" "))


def is_wiki(parent_id: Column | str) -> Column:
    """Collection of an id whose collection is not given."""
    return F.contains(slashed(parent_id), F.lit("data/wiki")) | F.contains(F.split(text_or_empty(parent_id), "::")[0], F.lit("wiki"))


def message_of(msg: Column, message: Column, text: Column, record: Column) -> Column:
    """The first that is there and not empty, else the whole record."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in (msg, message, text)], record)
