"""Theme cleaning, as a column and as the worker-side twin used by retries."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.text import _col, collapse_ws, trim_ws, words


@dataclass(frozen=True)
class ThemeRules:
    """What a theme must be. Both forms below, on the cluster and in a model's worker, read these."""

    low: int
    high: int
    #: Longer themes keep this many words; None: they are rejected.
    kept: int | None = None
    starts: tuple[str, ...] = ()
    #: Themes for which a model is asked again.
    ask_again: tuple[str, ...] = ()


POLICIES = {
    "truncate": ThemeRules(0, rules.THEME_MAX_WORDS, rules.THEME_KEPT_WORDS, tuple(rules.BOILERPLATE_STARTS),
                           tuple(rules.GENERIC_THEMES)),
    "range": ThemeRules(*rules.THEME_WORD_RANGE),
}

#: Characters of markup, and what ends the first phrase of a reply.
MARKUP, PHRASE_END = r"[*_`]+", r"[.:\n]"


def _rules(policy: str) -> ThemeRules:
    if policy not in POLICIES:
        raise ValueError(f"unknown policy: {policy}")
    return POLICIES[policy]


def theme_cleaned(
    c: Column | str,
    policy: str = "truncate",
    boilerplate: list[str] | None = None,
) -> Column:
    """First phrase of a model reply without markup; '' where it is unusable.

    ``truncate`` rejects boilerplate and shortens overlong themes; ``range``
    keeps only themes with an allowed number of words.
    """
    rule = _rules(policy)
    bare = F.regexp_replace(F.coalesce(_col(c), F.lit("")), MARKUP, "")
    theme = collapse_ws(trim_ws(F.split(bare, PHRASE_END, 2)[0]))
    n = F.size(words(theme))
    rejected = n < rule.low
    for start in rule.starts if boilerplate is None else boilerplate:
        rejected = rejected | F.lower(theme).startswith(start)
    short = F.lit("") if rule.kept is None else F.array_join(F.slice(words(theme), 1, rule.kept), " ")
    return (F.when(rejected, F.lit(""))
            .when(n > rule.high, short)
            .otherwise(theme))


def theme_unless_generic(c: Column | str, generic: list[str] | None = None) -> Column:
    generic = rules.GENERIC_THEMES if generic is None else generic
    c = _col(c)
    return F.when(F.lower(trim_ws(c)).isin(generic), F.lit("")).otherwise(c)


def accept_theme(policy: str = "truncate"):
    """``theme_cleaned`` for one reply inside a worker; '' also for themes worth asking again for."""
    rule = _rules(policy)

    def usable(theme: list[str]) -> bool:
        text = " ".join(theme).lower()
        long_enough = len(theme) >= rule.low and (rule.kept is not None or len(theme) <= rule.high)
        return long_enough and not any(text.startswith(start) for start in rule.starts)

    def accept(reply: str) -> str:
        theme = re.split(PHRASE_END, re.sub(MARKUP, "", reply or ""), maxsplit=1)[0].split()
        if not usable(theme):
            return ""
        said = " ".join(theme if len(theme) <= rule.high else theme[:rule.kept])
        return "" if said.lower() in rule.ask_again else said

    return accept
