"""Text for people: labels, escaped HTML, titles of sources, sentences from records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODE_LABELS = {"bus": "Bus", "metro": "Metro", "suburban_rail": "Suburban rail", "mrts": "MRTS"}


def label(c: Column | str, names: dict[str, str] = MODE_LABELS) -> Column:
    """The label of a code; other codes with blanks for underscores and a capital first letter; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    plain = F.replace(c, F.lit("_"), F.lit(" "))
    known = F.create_map(*(F.lit(x) for kv in names.items() for x in kv))
    return F.coalesce(F.try_element_at(known, c), F.concat(F.upper(F.substring(plain, 1, 1)), F.substr(plain, F.lit(2))))


def html(c: Column | str) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def source_title(url: Column | str) -> Column:
    """The host of an address without www; null where there is none."""
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def route_sentence(code: str, mode: str, start: str, end: str, partial: str) -> Column:
    """One line about a route; says so where its topology is incomplete."""
    text = F.format_string("%s (%s): %s → %s", F.coalesce(code, F.lit("?")), label(mode), F.coalesce(start, F.lit("?")), F.coalesce(end, F.lit("?")))
    return F.concat(text, F.when(F.col(partial), " [partial]").otherwise(""))


def canonical_json(**fields: Column) -> Column:
    """One JSON text per record whatever the order of its fields: names sorted, nulls written, no blanks."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))), {"ignoreNullFields": "false"})
