"""Themes from model replies."""

from __future__ import annotations

from pyspark.sql import DataFrame

from caselens.functions.themes import theme_cleaned, theme_unless_generic


def clean_theme(df: DataFrame, *, reply: str, output: str = "theme", policy: str = "truncate") -> DataFrame:
    return df.withColumn(output, theme_cleaned(reply, policy))


def block_themes(df: DataFrame, *, theme: str, generic: list[str] | None = None) -> DataFrame:
    return df.withColumn(theme, theme_unless_generic(theme, generic))
