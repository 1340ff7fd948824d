"""Tag expressions over text and arrays of tags."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.text import _col, trim_ws, words


def tags_from_text(c: Column | str, *, strip_brackets: bool = True, drop_blank: bool = True) -> Column:
    """Comma-separated tags, stripped and lower-cased.

    A list that was saved as text leaves brackets and quotes in its tags;
    they are taken off unless told otherwise.
    """
    def tidy(t: Column) -> Column:
        t = trim_ws(t)
        if strip_brackets:
            t = trim_ws(F.regexp_replace(t, r"\A[\[\]'\"]+|[\[\]'\"]+\z", ""))
        return F.lower(t)

    tags = F.transform(F.split(_col(c), ","), tidy)
    return F.filter(tags, lambda t: t != "") if drop_blank else tags


def _listed(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, ","), trim_ws), lambda t: t != "")


def _no_tags() -> Column:
    return F.array().cast("array<string>")


def line_tags_lenient(line: Column | str) -> Column:
    """Tags behind the first dot, or on the whole line; a missing line has none."""
    rest = F.regexp_replace(_col(line), r"\A[^.]*\.", "")
    return F.coalesce(_listed(rest), _no_tags())


def line_tags_strict(line: Column | str, word_range: tuple[int, int] = rules.TAG_LINE_WORD_RANGE) -> Column:
    """Tags of a numbered line whose remainder has an allowed number of words."""
    rest = trim_ws(F.regexp_extract(_col(line), r"(?U)\A\d+\.\s*(.+)", 1))
    fits = F.size(words(rest)).between(*word_range)
    return F.when(fits, _listed(rest)).otherwise(_no_tags())


def keyword_tags(
    text: Column | str,
    tags: Column | str,
    *,
    keywords: list[str] | None = None,
    labels: dict[str, str] | None = None,
    match: str = "phrase",
) -> Column:
    """Labels of the keywords found in the text and not among the tags yet.

    ``match='phrase'`` looks for the whole phrase (its last word may go on) and
    compares with the tags regardless of case. ``match='first_word'`` is
    triggered by the first word alone and compares the phrase as written with
    the lower-cased tags, so phrases holding capitals always count as new.
    Each rule is one literal pattern in the plan: none is compiled per row, and
    a plain substring test spares most texts the pattern.
    """
    if match not in ("phrase", "first_word"):
        raise ValueError(f"unknown match: {match}")
    keywords = rules.KEYWORDS if keywords is None else keywords
    labels = rules.STEM_LABELS if labels is None else labels
    text = F.lower(_col(text))
    present = F.transform(F.coalesce(_col(tags), _no_tags()), F.lower)
    found = []
    for keyword in keywords:
        if match == "first_word":
            stem, known = re.escape(keyword.split()[0].lower()), keyword
        else:
            stem, known = r"\s+".join(re.escape(w) for w in keyword.lower().split()), keyword.lower()
        hit = text.contains(keyword.split()[0].lower()) & text.rlike(rf"(?U)\b{stem}") & ~F.array_contains(present, known)
        found.append(F.when(hit, F.lit(labels.get(keyword, keyword))))
    return F.array_compact(F.array(*found))


def pattern_tags(text: Column | str, patterns: list[str] | None = None) -> Column:
    """All matches of all patterns, as written, each once."""
    patterns = rules.STATUTE_PATTERNS if patterns is None else patterns
    text = _col(text)
    hits = [F.regexp_extract_all(text, F.lit(f"(?iU){p}"), F.lit(0)) for p in patterns]
    return F.array_distinct(F.transform(F.flatten(F.array(*hits)), trim_ws))


def union_tags(*tag_columns: Column | str) -> Column:
    """Sorted set union; a null array counts as empty."""
    parts = [F.coalesce(_col(c), _no_tags()) for c in tag_columns]
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def tags_to_text(c: Column | str) -> Column:
    return F.array_join(_col(c), ", ")
