"""Tags from model lines, keywords and legal references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.functions.tagging import (
    keyword_tags, line_tags_lenient, line_tags_strict, pattern_tags, tags_from_text, union_tags)


def split_tags(
    df: DataFrame, *, tags: str, output: str = "tag_list", strip_brackets: bool = True, drop_blank: bool = True,
) -> DataFrame:
    """Rows with tags, as arrays."""
    return (df.na.drop(subset=[tags])
            .withColumn(output, tags_from_text(tags, strip_brackets=strip_brackets, drop_blank=drop_blank)))


def parse_reply_lines(
    batches: DataFrame, replies: DataFrame, *, batch: str, pos: str, reply: str,
    policy: str = "strict", output: str = "tags",
) -> DataFrame:
    """Match the j-th line of a batch reply with the j-th case of the batch.

    ``batches`` has one row per case, ``replies`` one per batch. A case without
    a line gets no tags.
    """
    line_tags = {"strict": line_tags_strict, "lenient": line_tags_lenient}[policy]
    lines = replies.select(batch, F.posexplode(F.split(reply, "\n")).alias(pos, "_line"))
    return (batches.join(lines, [batch, pos], "left")
            .withColumn(output, line_tags("_line")).drop("_line"))


def add_rule_tags(
    df: DataFrame, *, text: str, tags: str, output: str = "tags", match: str = "first_word",
    keywords: list[str] | None = None, patterns: list[str] | None = None,
) -> DataFrame:
    """Model tags, keyword tags and legal references as one sorted set.

    Rules need no model, so cases whose model call failed get them too.
    """
    return df.withColumn(output, union_tags(
        F.col(tags),
        keyword_tags(text, tags, keywords=keywords, match=match),
        pattern_tags(text, patterns)))
