"""Text expressions. All are native columns; none needs a Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A run of Unicode white space, as a pattern and as the characters themselves.
# The cheap range comes first: it turns most characters away by one comparison.
WS_RUN = r"(?U)[[^!-~]&&[\s\x1c-\x1f]]+"
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def trim_ws(c: Column | str) -> Column:
    return F.trim(_col(c), F.lit(WS_CHARS))


def collapse_ws(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), WS_RUN, " ")


def words(c: Column | str) -> Column:
    """White-space separated words; no empty ones."""
    return F.filter(F.split(_col(c), WS_RUN), lambda w: w != "")


def is_blank(c: Column | str) -> Column:
    """Null, empty or white space only."""
    c = _col(c)
    return c.isNull() | (F.length(trim_ws(c)) == 0)


def mask_tokens_removed(c: Column | str, mask: str = "X", min_run: int = 2) -> Column:
    """Masks standing as whole words, in any case, removed; runs of spaces collapsed."""
    gone = F.regexp_replace(_col(c), rf"(?iU)\b{mask}{{{min_run},}}\b", "")
    return trim_ws(F.regexp_replace(gone, "  +", " "))


def masks_removed_anywhere(c: Column | str, mask: str = "X", min_run: int = 2) -> Column:
    """Masked dates, then upper-case masks even inside words, removed."""
    run = f"{mask}{{{min_run},}}"
    gone = F.regexp_replace(_col(c), f"{run}/{run}/{run}", "")
    return trim_ws(collapse_ws(F.regexp_replace(gone, run, "")))


def nonempty_or(cleaned: Column | str, original: Column | str) -> Column:
    cleaned, original = _col(cleaned), _col(original)
    return F.when(F.length(cleaned) > 0, cleaned).otherwise(original)


def text_after_last(c: Column | str, marker: str) -> Column:
    """Text behind the last marker, or all of it where the marker is missing."""
    return trim_ws(F.substring_index(_col(c), marker, -1))


def digest(c: Column | str) -> Column:
    """32-byte key that stands for a text in shuffles and state."""
    return F.unhex(F.sha2(_col(c), 256))


def nulls_restored(c: Column | str, tokens: list[str]) -> Column:
    c = _col(c)
    return F.when(~c.isin(tokens), c)
