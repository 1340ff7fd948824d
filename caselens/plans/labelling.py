"""Tags and themes from model lines and rules, and model calls with resume.

The models here are deterministic callables over the prompt; a user passes a
real one the same way.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselens.functions import rules
from caselens.functions.tagging import keyword_tags, line_tags_lenient, line_tags_strict, pattern_tags, tags_to_text
from caselens.functions.text import words
from caselens.functions.themes import accept_theme
from caselens.operators import infer, joins, sampling, tags as tagging, themes, trends
from caselens.plans.registry import query, table
from caselens.runtime import new_path, spread
from caselens.sources.tables import parse_replies, parse_variants, variant_fields, write_table

_WS = "list_filter(string_split_regex({}, '\\s+'), lambda x: x <> '')"


def _sql_words(expr: str) -> str:
    return _WS.format(expr)


# Model lines planted on every document: numbered, with commas; some without a
# number, some with seven words, some with blanks between the commas.
_LINES = f"""
lines AS (
  SELECT doc_id, text, CASE doc_id % 6
    WHEN 0 THEN concat('1. ', w[1], ' ', w[2], ', ', w[3])
    WHEN 1 THEN concat('12.', w[1], ' , ,', w[2], ',')
    WHEN 2 THEN concat(w[1], ', ', w[2])
    WHEN 3 THEN '3. one two three four, five six seven'
    WHEN 4 THEN ''
    ELSE concat('7. ', w[1], ' ', w[2], ' ', w[3], ',a,b  c') END AS line
  FROM (SELECT doc_id, text, {_sql_words('text')} AS w FROM documents))"""


def model_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    w = words("text")
    first, second, third = (F.coalesce(F.get(w, i), F.lit("")) for i in range(3))
    kind = F.col("doc_id") % 6
    line = (F.when(kind == 0, F.concat(F.lit("1. "), first, F.lit(" "), second, F.lit(", "), third))
            .when(kind == 1, F.concat(F.lit("12."), first, F.lit(" , ,"), second, F.lit(",")))
            .when(kind == 2, F.concat(first, F.lit(", "), second))
            .when(kind == 3, F.lit("3. one two three four, five six seven"))
            .when(kind == 4, F.lit(""))
            .otherwise(F.concat(F.lit("7. "), first, F.lit(" "), second, F.lit(" "), third, F.lit(",a,b  c"))))
    return docs.withColumn("line", line)


_LISTED = "list_filter(list_transform(string_split({}, ','), lambda x: trim(x, chr(32) || chr(9) || chr(10))), lambda x: x <> '')"
_STRICT = f"""
CASE WHEN regexp_matches(line, '\\A[0-9]+\\.\\s*.')
  AND len({_sql_words("regexp_extract(line, '^[0-9]+[.]\\s*(.+)', 1)")}) BETWEEN 1 AND 6
  THEN {_LISTED.format("regexp_extract(line, '^[0-9]+[.]\\s*(.+)', 1)")} ELSE [] END"""


@query("parse_lines_strict", f"""
WITH {_LINES} SELECT doc_id, array_to_string({_STRICT}, '|') AS tags FROM lines""")
def parse_lines_strict(spark, sf_dir):
    return model_lines(spark, sf_dir).select("doc_id", F.array_join(line_tags_strict("line"), "|").alias("tags"))


@query("parse_lines_lenient", f"""
WITH {_LINES} SELECT doc_id, array_to_string(
  {_LISTED.format("regexp_replace(line, '\\A[^.]*\\.', '')")}, '|') AS tags FROM lines""")
def parse_lines_lenient(spark, sf_dir):
    return model_lines(spark, sf_dir).select("doc_id", F.array_join(line_tags_lenient("line"), "|").alias("tags"))


@query("parse_reply_batches", f"""
WITH {_LINES}, kept AS (SELECT * FROM lines WHERE doc_id % 12 <> 11)
SELECT doc_id, array_to_string(CASE WHEN doc_id % 12 = 11 THEN [] ELSE {_STRICT} END, '|') AS tags FROM lines""")
def parse_reply_batches(spark, sf_dir):
    """Twelve cases share a reply; the last line of every reply is missing."""
    lines = model_lines(spark, sf_dir).select(
        F.floor(F.col("doc_id") / 12).alias("batch"), (F.col("doc_id") % 12).cast("int").alias("pos"), "doc_id", "line")
    replies = (lines.where("pos <> 11").groupBy("batch")
               .agg(F.array_join(F.array_sort(F.collect_list(F.struct("pos", "line")))["line"], "\n").alias("reply")))
    parsed = tagging.parse_reply_lines(lines.drop("line"), replies, batch="batch", pos="pos", reply="reply")
    return parsed.select("doc_id", F.array_join("tags", "|").alias("tags"))


_PHRASES = [
    " I reported fraudulent and unauthorized charges and the human trafficking hotline.",
    " Under 15 U.S.C. § 1681i and 15 usc 1692g, Section 609 of the FCRA applies; see the fair credit reporting act.",
    " The CREDIT REPORT error was a debt collection scam, past the Statute of Limitations.",
    " A data line and a child account; Florida State Law and the FDCPA, FDCPA and fdcpa.",
    " Nothing to see.",
]
_PLANTED = "planted AS (SELECT doc_id, text || CASE doc_id % 5 " + " ".join(
    f"WHEN {i} THEN '{p}'" for i, p in enumerate(_PHRASES)) + """ END AS narrative,
  CASE WHEN doc_id % 3 = 0 THEN ['fraud', 'Debt Collection'] WHEN doc_id % 3 = 1 THEN [] END AS tags FROM documents)"""


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    phrase = F.element_at(F.array(*[F.lit(p) for p in _PHRASES]), (F.col("doc_id") % 5 + 1).cast("int"))
    some = F.array(F.lit("fraud"), F.lit("Debt Collection"))
    kind = F.col("doc_id") % 3
    return docs.select(
        "doc_id", F.concat("text", phrase).alias("narrative"),
        F.when(kind == 0, some).when(kind == 1, F.array().cast("array<string>")).alias("tags"))


def _keyword_sql(first_word: bool) -> str:
    """One case per keyword. Letters beyond ASCII count as part of a word."""
    edge = r"(^|[^\p{L}\p{M}\p{N}_])"
    out = []
    for k in rules.KEYWORDS:
        stem = k.split()[0].lower() if first_word else r"\s+".join(k.lower().split())
        known = k if first_word else k.lower()
        out.append(
            f"CASE WHEN regexp_matches(lower(narrative), '{edge}{stem}') AND NOT list_contains("
            f"list_transform(coalesce(tags, []), lambda x: lower(x)), '{known}') THEN '{rules.STEM_LABELS.get(k, k)}' END")
    return f"list_filter([{', '.join(out)}], lambda x: x IS NOT NULL)"


@query("inject_keywords", f"""
WITH {_PLANTED} SELECT doc_id, array_to_string({_keyword_sql(False)}, '|') AS found FROM planted""")
def inject_keywords(spark, sf_dir):
    return planted(spark, sf_dir).select(
        "doc_id", F.array_join(keyword_tags("narrative", "tags"), "|").alias("found"))


@query("inject_keywords_first_word", f"""
WITH {_PLANTED} SELECT doc_id, array_to_string({_keyword_sql(True)}, '|') AS found FROM planted""")
def inject_keywords_first_word(spark, sf_dir):
    return planted(spark, sf_dir).select(
        "doc_id", F.array_join(keyword_tags("narrative", "tags", match="first_word"), "|").alias("found"))


_PATTERN_SQL = "flatten([" + ", ".join(
    f"regexp_extract_all(narrative, '{p}', 0, 'i')" for p in rules.STATUTE_PATTERNS) + "])"
_SORTED = "array_to_string(list_sort(list_distinct({})), '|')"


@query("extract_patterns", f"""
WITH {_PLANTED} SELECT doc_id, {_SORTED.format(_PATTERN_SQL)} AS found FROM planted""")
def extract_patterns(spark, sf_dir):
    return planted(spark, sf_dir).select(
        "doc_id", F.array_join(F.array_sort(pattern_tags("narrative")), "|").alias("found"))


@query("merge_tags", f"""
WITH {_PLANTED}, merged AS (
  SELECT doc_id, list_concat(list_concat(coalesce(tags, []), {_keyword_sql(True)}), {_PATTERN_SQL}) AS t FROM planted)
SELECT doc_id, array_to_string(list_sort(list_distinct(t)), ', ') AS tags FROM merged""")
def merge_tags(spark, sf_dir):
    merged = tagging.add_rule_tags(planted(spark, sf_dir), text="narrative", tags="tags", match="first_word")
    return merged.select("doc_id", tags_to_text("tags").alias("tags"))


# Model replies planted on every document.
_REPLIES = f"""
replies AS (
  SELECT doc_id, source, CASE doc_id % 8
    WHEN 0 THEN concat('**', w[1], ' ', w[2], '**. Explanation')
    WHEN 1 THEN concat('Note: ', w[1])
    WHEN 2 THEN text
    WHEN 3 THEN array_to_string(w[1:12], '  ')
    WHEN 4 THEN ' Dispute ' || chr(10) || 'more'
    WHEN 5 THEN '.' || text
    WHEN 6 THEN concat('`', w[1], '_', w[2], '`', chr(9), w[3], ': rest')
    END AS reply
  FROM (SELECT doc_id, source, text, {_sql_words('text')} AS w FROM documents)),
phrases AS (
  SELECT doc_id, source, trim(regexp_replace(string_split_regex(
      regexp_replace(coalesce(reply, ''), '[*_`]+', '', 'g'), '[.:\\n]')[1], '\\s+', ' ', 'g')) AS p
  FROM replies),
counted AS (SELECT *, len({_sql_words('p')}) AS n FROM phrases)"""
_TRUNCATED = f"""
CASE WHEN {' OR '.join(f"starts_with(lower(p), '{b}')" for b in rules.BOILERPLATE_STARTS)} THEN ''
  WHEN n > 10 THEN array_to_string(({_sql_words('p')})[1:7], ' ') ELSE p END"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    w = words("text")
    first, second, third = (F.coalesce(F.get(w, i), F.lit("")) for i in range(3))
    kind = F.col("doc_id") % 8
    reply = (F.when(kind == 0, F.concat(F.lit("**"), first, F.lit(" "), second, F.lit("**. Explanation")))
             .when(kind == 1, F.concat(F.lit("Note: "), first))
             .when(kind == 2, F.col("text"))
             .when(kind == 3, F.array_join(F.slice(w, 1, 12), "  "))
             .when(kind == 4, F.lit(" Dispute \nmore"))
             .when(kind == 5, F.concat(F.lit("."), "text"))
             .when(kind == 6, F.concat(F.lit("`"), first, F.lit("_"), second, F.lit("`\t"), third, F.lit(": rest"))))
    return docs.select("doc_id", "source", reply.alias("reply"))


@query("theme_clean_truncate", f"WITH {_REPLIES} SELECT doc_id, {_TRUNCATED} AS theme FROM counted")
def theme_clean_truncate(spark, sf_dir):
    return themes.clean_theme(replies(spark, sf_dir), reply="reply").select("doc_id", "theme")


@query("theme_clean_range", f"""
WITH {_REPLIES} SELECT doc_id, CASE WHEN n BETWEEN 2 AND 10 THEN p ELSE '' END AS theme FROM counted""")
def theme_clean_range(spark, sf_dir):
    return themes.clean_theme(replies(spark, sf_dir), reply="reply", policy="range").select("doc_id", "theme")


_BLOCKED = f"""
WITH {_REPLIES}, t AS (SELECT doc_id, source, {_TRUNCATED} AS theme FROM counted),
blocked AS (
  SELECT doc_id, source, CASE WHEN trim(lower(theme)) IN ('', 'complaint', 'dispute', 'issue', 'problem', 'concern')
    THEN '' ELSE theme END AS theme FROM t)"""


def blocked(spark, sf_dir):
    cleaned = themes.clean_theme(replies(spark, sf_dir), reply="reply")
    return themes.block_themes(cleaned, theme="theme")


@query("theme_block", f"{_BLOCKED} SELECT doc_id, theme FROM blocked")
def theme_block(spark, sf_dir):
    return blocked(spark, sf_dir).select("doc_id", "theme")


@query("theme_frequency", f"""
{_BLOCKED} SELECT theme, count(*) AS n, count(DISTINCT source) AS n_sources FROM blocked WHERE theme <> ''
GROUP BY theme ORDER BY n DESC, theme LIMIT 20""")
def theme_frequency(spark, sf_dir):
    named = blocked(spark, sf_dir).where("theme <> ''")
    per_theme = named.groupBy("theme").agg(F.count("*").alias("n"), F.count_distinct("source").alias("n_sources"))
    return per_theme.orderBy(F.desc("n"), "theme").limit(20)


@query("theme_by_product", f"""
{_BLOCKED} SELECT source, theme, count(*) AS n FROM blocked WHERE theme <> '' GROUP BY source, theme""")
def theme_by_product(spark, sf_dir):
    return trends.count_by(blocked(spark, sf_dir).where("theme <> ''"), by=["source", "theme"])


INSTRUCTION = "Name the theme of this case in a few words."


def first_words_model(n: int = 4, fail_on: str | None = None, blank_on: str | None = None):
    """A stand-in model: the first words of the case text as the theme."""
    def build():
        def reply(prompt: str) -> str:
            body = prompt[len(INSTRUCTION):].split("Theme Label:")[0]
            found = body.split()
            if fail_on and fail_on in found:
                raise RuntimeError("model failed")
            if blank_on and found[0].startswith(blank_on):
                return ""
            return " ".join(found[:n])

        return lambda prompts: [reply(p) for p in prompts]
    return build


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases with prompts; every fortieth text is blank, some hold a word the model fails on."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    key = F.col("doc_id")
    text = (F.when(key % 40 == 0, "  \n ")
            .when(key % 30 == 7, F.concat(F.lit("FAILING "), "text"))
            .when(key % 30 == 8, F.concat(F.lit("MUTE "), "text")).otherwise(F.col("text")))
    return docs.select("doc_id", text.alias("narrative")).withColumn(
        "prompt", infer.render_prompt(INSTRUCTION, "narrative", "Theme Label:"))


_ASKED = f"""
asked AS (
  SELECT doc_id, CASE WHEN doc_id % 40 = 0 THEN '  ' || chr(10) || ' ' WHEN doc_id % 30 = 7 THEN 'FAILING ' || text
    WHEN doc_id % 30 = 8 THEN 'MUTE ' || text ELSE text END AS narrative FROM documents),
answered AS (
  SELECT doc_id, narrative, CASE WHEN doc_id % 40 = 0 THEN 'blank' WHEN doc_id % 30 = 7 THEN 'error'
    WHEN doc_id % 30 = 8 THEN 'empty' ELSE 'ok' END AS status,
    array_to_string(({_sql_words('narrative')})[1:4], ' ') AS words FROM asked)"""


@query("render_prompts", f"""
WITH {_ASKED} SELECT doc_id, '{INSTRUCTION}' || chr(10) || chr(10) ||
  regexp_replace(narrative, '\\A\\s+|\\s+\\z', '', 'g') || chr(10) || chr(10) || 'Theme Label:' AS prompt FROM asked""")
def render_prompts(spark, sf_dir):
    return asked(spark, sf_dir).select("doc_id", "prompt")


@query("render_batches", """
SELECT doc_id // 12 AS batch, 'Tag each case.' || chr(10) || chr(10) ||
  string_agg(CAST(doc_id % 12 + 1 AS VARCHAR) || '. ' || regexp_replace(text, '\\A\\s+|\\s+\\z', '', 'g'), chr(10) ORDER BY doc_id)
  || chr(10) || chr(10) || 'Tags:' AS prompt
FROM documents GROUP BY 1""")
def render_batches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 12).alias("batch"), "doc_id", "text")
    texts = F.array_sort(F.collect_list(F.struct("doc_id", "text")))["text"]
    return (docs.groupBy("batch").agg(texts.alias("texts"))
            .select("batch", infer.render_numbered("Tag each case.", "texts", "Tags:").alias("prompt")))


def _themes(spark, sf_dir, **options) -> DataFrame:
    return infer.generate(
        asked(spark, sf_dir), case_id="doc_id", prompt="prompt", subject="narrative",
        factory=first_words_model(fail_on="FAILING", blank_on="MUTE"), **options)


@query("infer_batch", f"""
WITH {_ASKED}
SELECT doc_id, CASE WHEN status = 'ok' THEN words ELSE '' END AS output, status,
  CAST(CASE status WHEN 'blank' THEN 0 WHEN 'ok' THEN 1 ELSE 3 END AS INTEGER) AS attempts FROM answered""")
def infer_batch(spark, sf_dir):
    return _themes(spark, sf_dir).select("doc_id", "output", "status", "attempts")


@query("infer_accepted", f"""
WITH {_ASKED}, phrases AS (
  SELECT doc_id, status, trim(string_split_regex(regexp_replace(words, '[*_`]+', '', 'g'), '[.:]')[1]) AS p FROM answered),
c AS (SELECT *, len({_sql_words('p')}) AS n FROM phrases)
SELECT doc_id, CASE WHEN status = 'ok' AND n BETWEEN 2 AND 10 THEN p ELSE '' END AS theme FROM c""")
def infer_accepted(spark, sf_dir):
    results = _themes(spark, sf_dir, accept=accept_theme("range"))
    return joins.attach(
        table(spark, sf_dir, "documents").select("doc_id"),
        results.select("doc_id", F.col("output").alias("theme")), case_id="doc_id")


@query("infer_resume", f"""
WITH {_ASKED}
SELECT doc_id, CASE WHEN status IN ('ok', 'error') THEN CASE WHEN doc_id % 3 = 0 THEN 'done before'
    ELSE words END ELSE '' END AS output,
  CASE WHEN status = 'blank' THEN 'blank' WHEN status = 'empty' AND doc_id % 3 <> 0 THEN 'empty' ELSE 'ok' END AS status
FROM (SELECT doc_id, words, status FROM answered WHERE status <> 'empty' OR doc_id % 3 <> 0
  UNION ALL SELECT doc_id, 'done before', 'ok' FROM answered WHERE status = 'empty' AND doc_id % 3 = 0)""")
def infer_resume(spark, sf_dir):
    """A third of the cases is done, a run fails on some, the next one ends the rest."""
    path = new_path(spark, "themes")
    cases = asked(spark, sf_dir)
    done = cases.where(F.col("doc_id") % 3 == 0).select(
        "doc_id", F.when(F.col("doc_id") % 40 == 0, "").otherwise("done before").alias("output"),
        F.when(F.col("doc_id") % 40 == 0, "blank").otherwise("ok").alias("status"),
        F.lit(1).alias("attempts"), F.lit(None).cast("string").alias("error"), F.lit(1).alias("run"))
    write_table(done, path)
    shared = dict(case_id="doc_id", path=path, prompt="prompt", subject="narrative", max_attempts=1)
    infer.generate_resumable(cases, factory=first_words_model(fail_on="FAILING", blank_on="MUTE"), slices=2, **shared)
    latest = infer.generate_resumable(cases, factory=first_words_model(blank_on="MUTE"), **shared)
    return latest.select("doc_id", "output", "status")


@query("pending_cases", """
SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)""")
def pending_cases(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    results = labels.select("doc_id", F.when(F.col("quality") == 1, "ok").otherwise("error").alias("status"))
    return joins.pending(table(spark, sf_dir, "documents").select("doc_id"), results, case_id="doc_id")


@query("sample_per_group", """
SELECT source, doc_id, CAST(r AS INTEGER) AS sample_rank FROM (
  SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY md5('7' || CAST(doc_id AS VARCHAR)), doc_id) AS r
  FROM documents) WHERE r <= 5""")
def sample_per_group(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("source", "doc_id")
    return sampling.sample_per_group(docs, by="source", case_id="doc_id", n=5, seed="7")


@query("json_replies", """
SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(json_extract_string(props, '$.k') AS INTEGER) ELSE -1 END AS k
FROM events""")
def json_replies(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    reply = F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("Tags: none")
    parsed = parse_replies(events.select("event_id", reply.alias("reply")), reply="reply", schema="k int")
    return parsed.select("event_id", F.coalesce("parsed.k", F.lit(-1)).alias("k"))


@query("variant_replies", """
SELECT event_id, event_id % 5 <> 3 AS is_json,
  CASE event_id % 5 WHEN 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) WHEN 1 THEN event_id ELSE -1 END AS k,
  CASE WHEN event_id % 5 = 2 THEN '"many"' END AS misfit FROM events""")
def variant_replies(spark, sf_dir):
    """Replies whose field is a number, a number as text, a word, null, or that are no JSON."""
    kind = F.col("event_id") % 5
    reply = (F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit('{"k": "'), "event_id", F.lit('"}')))
             .when(kind == 2, '{"k": "many", "z": [1, 2]}').when(kind == 3, "Tags: none").otherwise('{"k": null}'))
    replies = parse_variants(table(spark, sf_dir, "events").select("event_id", reply.alias("reply")), reply="reply")
    found = variant_fields(replies, fields={"k": "bigint", "z": "array<int>"})
    return found.select("event_id", F.col("value").isNotNull().alias("is_json"),
                        F.coalesce("k", F.lit(-1)).alias("k"), F.col("misfits")["k"].alias("misfit"))
