"""Cleaning of narratives."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.text import (
    is_blank, mask_tokens_removed, masks_removed_anywhere, nonempty_or, nulls_restored)


def with_text(df: DataFrame, *, text: str) -> DataFrame:
    """Drop rows whose text is null; empty text stays."""
    return df.na.drop(subset=[text])


def without_blank(df: DataFrame, *, text: str) -> DataFrame:
    return df.where(~is_blank(text))


def fill_text(df: DataFrame, *, columns: Sequence[str], value: str = "") -> DataFrame:
    return df.na.fill(value, list(columns))


def restore_nulls(df: DataFrame, *, tokens: Sequence[str] = tuple(rules.NULL_TOKENS)) -> DataFrame:
    """Read the usual spellings of a missing value as null, in text columns."""
    texts = [f.name for f in df.schema if f.dataType.typeName() == "string"]
    return df.withColumns({c: nulls_restored(c, list(tokens)) for c in texts})


def remove_mask_tokens(df: DataFrame, *, text: str, mask: str = "X", min_run: int = 2) -> DataFrame:
    return df.withColumn(text, mask_tokens_removed(text, mask, min_run))


def remove_masks_anywhere(
    df: DataFrame, *, text: str, mask: str = "X", min_run: int = 2, keep_original_if_empty: bool = True,
) -> DataFrame:
    cleaned: Column = masks_removed_anywhere(text, mask, min_run)
    return df.withColumn(text, nonempty_or(cleaned, text) if keep_original_if_empty else cleaned)


def scrub_pii(
    df: DataFrame, *, text: str, pii_rules: Sequence[tuple[str, str, str, str]] = tuple(rules.PII_RULES),
) -> DataFrame:
    """Replace personal data by typed placeholders; add one hit count per type."""
    for kind, pattern, placeholder, sign in pii_rules:
        has_sign = F.col(text).rlike(sign)
        hits = F.size(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
        df = df.withColumn(f"n_{kind}", F.when(has_sign, hits).otherwise(0)).withColumn(
            text, F.when(F.col(f"n_{kind}") > 0, F.regexp_replace(text, pattern, placeholder)).otherwise(F.col(text)))
    return df


def stamp(df: DataFrame, **literals: object) -> DataFrame:
    """Record run facts (snapshot date, model version) that the caller passes in."""
    return df.withColumns({name: F.lit(value) for name, value in literals.items()})


def equals_all(df: DataFrame, **wanted: object) -> DataFrame:
    """Rows where every named column equals its value."""
    for name, value in wanted.items():
        df = df.where(F.col(name) == F.lit(value))
    return df
