"""The stages of a study of complaints, each one call over tables.

raw cases -> prepared cases -> themes / tags -> topic report -> indexed facts
                            -> clusters with names -> monthly trend beside indicators

Column names are those of ``sources.tables.CASE_COLUMNS``. Every function takes
and returns DataFrames; the caller decides what to write.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.dates import month_label, parse_date
from caselens.functions.tagging import line_tags_strict
from caselens.functions.text import text_after_last
from caselens.functions.themes import accept_theme
from caselens.operators import clean, clusters, dedup, geo, hierarchy, infer, joins, tags, trends, vectors

TAG_INSTRUCTION = "List two or three short keyword tags for this complaint on one numbered line, separated by commas."
THEME_INSTRUCTION = "Give a theme for this complaint: a title of three to seven words, nothing else."


def prepare(raw: DataFrame, *, date_format: str | None = None) -> DataFrame:
    """Cases with text, without copies or masks, with their date as ``ts``."""
    texts = clean.with_text(raw, text="narrative")
    unique = dedup.dedup_exact(texts, text="narrative", case_id="case_id")
    unmasked = clean.remove_masks_anywhere(unique, text="narrative")
    whole = clean.remove_mask_tokens(unmasked, text="narrative")
    return whole.withColumn("ts", parse_date("date_received", date_format))


def select_cases(cases: DataFrame, *, year: int, product: str, issue: str) -> DataFrame:
    """One product and issue in one year; the range reaches the scan of a typed date."""
    first, after = F.make_date(F.lit(year), F.lit(1), F.lit(1)), F.make_date(F.lit(year + 1), F.lit(1), F.lit(1))
    in_year = cases.where((F.col("ts") >= first) & (F.col("ts") < after))
    return clean.equals_all(in_year, product=product, issue=issue)


def label_themes(
    cases: DataFrame, *, path: str, factory: Callable[[], infer.Generate], policy: str = "truncate",
    instruction: str = THEME_INSTRUCTION, cue: str = "Theme Label:", done: Sequence[str] = ("ok", "blank", "empty"), **options,
) -> DataFrame:
    """Cases with ``theme``; asks only for the cases that ``path`` has no result for.

    A case without an accepted theme is finished; only failed calls are asked again.
    """
    check = accept_theme(policy)
    prompts = cases.select("case_id", "narrative", infer.render_prompt(instruction, "narrative", cue).alias("_prompt"))
    results = infer.generate_resumable(
        prompts, case_id="case_id", path=path, prompt="_prompt", subject="narrative", factory=factory, done=done,
        accept=lambda reply: check(reply.split(cue)[-1].strip()), **options)
    return joins.attach(cases, results.select("case_id", F.col("output").alias("theme")), case_id="case_id")


def label_tags(
    cases: DataFrame, *, path: str, factory: Callable[[], infer.Generate], match: str = "first_word",
    instruction: str = TAG_INSTRUCTION, cue: str = "Tags:", **options,
) -> DataFrame:
    """Cases with ``tag_list``: the model's tags, keywords and legal references.

    An empty reply is asked again by the next run, as a failed one is.
    """
    prompts = cases.select("case_id", "narrative", infer.render_numbered(
        instruction, F.array("narrative"), cue).alias("_prompt"))
    results = infer.generate_resumable(
        prompts, case_id="case_id", path=path, prompt="_prompt", subject="narrative", factory=factory, **options)
    first_line = F.split(text_after_last("output", cue), "\n")[0]
    lines = results.select("case_id", line_tags_strict(first_line).alias("tag_list"))
    tagged = joins.attach(cases.drop("tag_list"), lines, case_id="case_id")
    return tags.add_rule_tags(tagged, text="narrative", tags="tag_list", output="tag_list", match=match)


@dataclass
class TopicReport:
    """The tables of a topic. All are lazy; cache ``rows`` to ask for several."""

    rows: DataFrame

    @classmethod
    def of(cls, cases: DataFrame, places: DataFrame, *, stem: str, tags_column: str = "tag_list") -> TopicReport:
        lowered = cases.withColumn(tags_column, F.transform(tags_column, F.lower))
        rows = trends.topic_rows(lowered, tags=tags_column, stem=stem)
        placed = geo.attach_place(rows, places, zip_code="zip_code", case_id="case_id")
        return cls(placed.withColumn("month", month_label("ts")))

    def top(self, column: str, n: int = 20) -> DataFrame:
        """The most frequent values of ``tag``, ``state``, ``zip5``, ``city`` or ``city_state``."""
        return trends.top_n(self.rows, by=[column], n=n)

    def words(self) -> DataFrame:
        return trends.word_freq(self.rows, text="tag")

    def monthly(self, by: Sequence[str] = ()) -> DataFrame:
        return trends.monthly_series(self.rows, date="ts", case_id="case_id", by=by)

    def spikes(self, by: Sequence[str] = (), window: int = 6, z: float = 2.0) -> DataFrame:
        return trends.spikes(self.monthly(by), time="month", by=by, value="n_tags", window=window, z=z)

    def top_city_months(self, n: int = 20) -> DataFrame:
        counts = trends.count_by(self.rows, by=["month", "city_state"])
        return geo.restrict_to_top(counts, by=["city_state"], n=n, value="n")

    def city_by_month(self, n: int = 20) -> DataFrame:
        return trends.pivot_counts(self.top_city_months(n), rows="city_state", columns="month", value="n")

    def month_by_city(self, n: int = 20) -> DataFrame:
        return trends.pivot_counts(self.top_city_months(n), rows="month", columns="city_state", value="n")

    def state_months(self) -> DataFrame:
        counts = trends.count_by(self.rows, by=["month", "state_id"])
        return geo.attach_state_name(trends.share_and_rank(counts, part="month"))

    def facts(self, topic: str) -> DataFrame:
        """One sentence per month and state, ready for the index."""
        named = self.state_months().na.drop(subset=["state_name"]).withColumn("topic", F.lit(topic))
        return trends.summary_sentences(
            named, template=rules.SUMMARY_TEMPLATE, columns=["month", "state_name", "state_id", "n", "topic"],
            source=rules.SUMMARY_SOURCE)


def cluster_cases(
    embedded: DataFrame, *, min_size: int = 30, min_pts: int = 5, dims: int = 5, cell: float | None = None,
) -> DataFrame:
    """Cases with ``embedding`` to cases with ``cluster``; -1 is noise.

    Without ``cell`` the density of each cluster is found by itself.
    """
    reduced = vectors.reduce_dims(embedded, vector="embedding", k=dims)
    common = dict(case_id="case_id", vector="reduced", dims=dims, min_pts=min_pts, min_size=min_size)
    found = (hierarchy.density_hierarchy(reduced, **common) if cell is None
             else clusters.density_clusters(reduced, cell=cell, **common))
    return joins.attach(embedded, found, case_id="case_id")


def name_case_clusters(clustered: DataFrame, *, factory: Callable[[], infer.Generate], **options) -> DataFrame:
    """Add ``label``: the model's name of the cluster, or the noise label."""
    names = clusters.name_clusters(
        clustered, case_id="case_id", cluster="cluster", text="narrative", factory=factory, **options)
    return clusters.label_clusters(clustered, names)


def trend_beside_indicators(cases: DataFrame, series: DataFrame, names: Sequence[str]) -> DataFrame:
    """Monthly case counts beside the monthly means of the named series."""
    counts = trends.count_by(trends.with_month(cases, date="ts"), by=["month"])
    return trends.join_indicators(counts, trends.align_series(series, names))
