"""Chunks, their index, and the context of a question."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import trim_ws
from caselens.operators.infer import Generate, generate
from caselens.operators.vectors import (
    Cells, Encode, assign_cells, calibrate_probes, coarse_cells, encode_with, top_k, top_k_probed)
from caselens.runtime import materialize, small_enough
from caselens.sources.tables import write_table


def chunk_windows(df: DataFrame, *, case_id: str, text: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """``(case_id, chunk_no, content)``: windows of ``size`` characters, overlapping."""
    length = F.length(text)
    starts = F.sequence(F.lit(1), F.greatest(length - overlap, F.lit(1)), F.lit(size - overlap))
    return (df.where(length > 0)
            .select(case_id, F.col(text).alias("_text"), F.posexplode(starts).alias("chunk_no", "_start"))
            .select(case_id, "chunk_no", F.substring("_text", F.col("_start"), F.lit(size)).alias("content")))


def chunk_at_separators(
    df: DataFrame, *, case_id: str, text: str, size: int = 1000, overlap: int = 200,
) -> DataFrame:
    """``(case_id, chunk_no, content)``: chunks of whole lines or words, packed by running length.

    A text is cut into pieces of at most ``overlap`` characters: a line, else up
    to the last space, else as many characters as fit. A piece belongs to the
    stretch of ``size - 2 * overlap`` characters that it starts in. A chunk
    holds the pieces of a stretch, and before them those that start in the
    ``overlap`` characters ahead of its first one. No chunk is longer than
    ``size``; blank ones are left out. ``size`` must be over three times
    ``overlap``.
    """
    if size <= 3 * overlap or overlap < 1:
        raise ValueError("size must be over three times overlap, and overlap at least 1")
    stretch = size - 2 * overlap
    most, less = overlap, overlap - 1
    pattern = f"[^\\n]{{0,{less}}}\\n|[^\\n]{{1,{most}}}\\z|[^\\n]{{0,{less}}} |[^\\n]{{1,{most}}}"
    rows = _held(df.where(F.length(text) > 0).select(case_id, F.col(text).alias("_text")), [case_id], _t=F.regexp_extract_all(
        "_text", F.lit(pattern), F.lit(0)))
    rows = _held(rows, [case_id, "_t"], _s=_starts(F.transform("_t", F.length)), _n=F.size("_t"))

    def home(start: Column) -> Column:
        return F.floor(start / stretch)

    # Every stretch up to the last piece has a first piece, as pieces are shorter than stretches.
    at = F.sequence(F.lit(0), F.col("_n") - 1)
    firsts = F.filter(at, lambda i: (i == 0) | (home(F.get("_s", i)) != home(F.get("_s", F.greatest(i - 1, F.lit(0))))))
    rows = _held(rows, [case_id, "_t", "_s", "_n"], _f=firsts)
    ends = F.concat(F.slice("_f", F.lit(2), F.size("_f")), F.array("_n"))

    def content(span: Column) -> Column:
        i, end = span["i"], span["end"]
        # A piece has a character at least, so no more than `overlap` pieces start that close ahead.
        ahead = F.slice("_s", F.greatest(i - overlap, F.lit(0)) + 1, F.least(i, F.lit(overlap)))
        back = F.size(F.filter(ahead, lambda s: s >= F.get("_s", i) - overlap))
        return trim_ws(F.array_join(F.slice("_t", i - back + 1, end - i + back), ""))

    contents = F.transform(F.arrays_zip(F.col("_f").alias("i"), ends.alias("end")), content)
    return rows.select(case_id, F.posexplode(F.filter(contents, lambda c: c != "")).alias("chunk_no", "content"))


def _held(df: DataFrame, keep: Sequence[str], **columns: Column) -> DataFrame:
    """``keep`` and new columns, worked out once per row: the optimizer cannot move them into lambdas behind."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def _starts(lengths: Column, group: int = 256) -> Column:
    """Sum of the lengths before each one. An array grows by copying, so the sums are taken in groups."""
    def running(values: Column, first: Column) -> Column:
        empty = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(values, empty, lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / group).cast("int")),
                         lambda g: F.slice(lengths, g * group + 1, F.lit(group)))
    sums = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda a, n: a + n))
    return F.flatten(F.transform(F.arrays_zip(groups.alias("g"), running(sums, F.lit(0)).alias("first")),
                                 lambda x: running(x["g"], x["first"])))


def as_documents(df: DataFrame, *, doc_id: str, content: str, source: str) -> DataFrame:
    """``(doc_id, content, metadata)`` rows, ready for the index."""
    return df.select(
        F.col(doc_id).cast("string").alias("doc_id"), F.col(content).alias("content"),
        F.create_map(F.lit("source"), F.lit(source)).alias("metadata"))


#: Documents for which the number of cells to read is measured: about, and at most.
CALIBRATED, MOST_CALIBRATED = 500, 4096


def store_documents(
    encoder: PipelineModel | Callable[[], Encode], documents: DataFrame, path: str, *, append: bool = False,
    cells: int | None = None, centres: list[list[float]] | None = None, recall: float = 0.9, k: int = 5,
) -> list[list[float]] | None:
    """Embed documents and write, or append, them to the index table.

    ``encoder`` is a fitted pipeline or builds the caller's own encoder. With
    ``cells`` the index is cut into that many cells, stored apart; the centres
    are returned, for ``retrieve`` and for appending with ``centres``. They say
    how many cells a search has to read for ``recall`` of the ``k`` best hits:
    that is measured by exact search for about ``CALIBRATED`` of the stored
    documents. Where questions are unlike documents, measure with questions
    (``vectors.calibrate_probes``).
    """
    embedded = encode_with(encoder, documents, text="content")
    if cells:
        # Centres and cells are found on the vectors as written: texts are embedded once.
        embedded, centres = coarse_cells(materialize(embedded, "embedded"), vector="embedding", cells=cells)
    elif centres:
        embedded = assign_cells(embedded, centres, vector="embedding")
    write_table(embedded, path, mode="append" if append else "overwrite", partition_by=["cell"] if centres else [])
    if not cells:
        return centres
    stored = documents.sparkSession.read.parquet(path)
    share = max(1, stored.count() // CALIBRATED)
    sample = stored.where(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0).limit(MOST_CALIBRATED)
    return Cells(centres, calibrate_probes(
        sample, stored, centres, query_id="doc_id", base_id="doc_id", vector="embedding", k=k, recall=recall,
        exclude_self=True, max_queries=MOST_CALIBRATED))


def assemble_context(
    hits: DataFrame, *, query_id: str = "query_id", rank: str = "rank", content: str = "content",
    joiner: str = "\n\n", max_chars: int | None = None,
) -> DataFrame:
    """``(query_id, context)``: the retrieved chunks, best first. A query has k hits.

    With ``max_chars`` chunks are taken whole as long as the context, joiners
    included, stays within it; the first that does not fit and all behind it
    are left out. A best chunk that is too long by itself is cut, so that no
    query is left without a context.
    """
    ordered = F.array_sort(F.collect_list(F.struct(rank, content)))
    whole = hits.groupBy(query_id).agg(ordered.alias("_hits")).select(query_id, F.col(f"_hits.{content}").alias("_texts"))
    if max_chars is None:
        return whole.select(query_id, F.array_join("_texts", joiner).alias("context"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("chars"), F.lit(False).alias("full"))

    def take(acc: Column, text: Column) -> Column:
        chars = acc["chars"] + F.coalesce(F.length(text), F.lit(0)) + F.when(acc["n"] > 0, len(joiner)).otherwise(0)
        full = acc["full"] | (chars > max_chars)
        return F.struct((acc["n"] + F.when(full, 0).otherwise(1)).alias("n"),
                        F.when(full, acc["chars"]).otherwise(chars).alias("chars"), full.alias("full"))

    fitting = F.aggregate("_texts", start, take)["n"]
    # The best chunk stays in any case: the cut bites only where it is alone and too long.
    kept = F.slice("_texts", F.lit(1), F.greatest(fitting, F.lit(1)))
    return whole.select(query_id, F.substring(F.array_join(kept, joiner), 1, max_chars).alias("context"))


def retrieve(
    encoder: PipelineModel | Callable[[], Encode], questions: DataFrame, index: DataFrame, *, question_id: str, question: str,
    k: int = 5, max_questions: int = 4096, centres: list[list[float]] | None = None, probes: int | None = None,
) -> DataFrame:
    """The k best documents per question with their content.

    With the ``centres`` of an index stored by cell only the ``probes`` nearest
    cells of each question are read (default: as many as were measured when it
    was stored), so hits may be missed; without, the search is exact. Up to ``max_questions`` questions have a bounded number of hits,
    which are broadcast to the index; the contents are then read in place, not
    shuffled.
    """
    asked = encode_with(encoder, questions, text=question)
    ids = dict(query_id=question_id, base_id="doc_id", vector="embedding", k=k, max_queries=max_questions)
    hits = top_k(asked, index, **ids) if centres is None else top_k_probed(asked, index, centres, probes=probes, **ids)
    if small_enough(questions, max_questions):
        hits = F.broadcast(hits)
    return index.select(F.col("doc_id").alias("base_id"), "content", "metadata").join(hits, "base_id").select(
        "query_id", "rank", "score", "base_id", "content", "metadata")


def answer(
    encoder: PipelineModel | Callable[[], Encode],
    questions: DataFrame,
    index: DataFrame,
    *,
    question_id: str,
    question: str,
    factory: Callable[[], Generate],
    instruction: str = "Answer the question from the context only.",
    k: int = 5,
    max_chars: int | None = None,
    **search,
) -> DataFrame:
    """Retrieve, put the context and the question into a prompt, and ask the model.

    ``max_chars`` bounds the context (``assemble_context``). Lazy, as ``generate`` is: write the result before using it more than once.
    """
    context = assemble_context(
        retrieve(encoder, questions, index, question_id=question_id, question=question, k=k, **search), max_chars=max_chars)
    prompts = questions.join(context.withColumnRenamed("query_id", question_id), question_id, "left")
    prompt = F.concat(
        F.lit(instruction + "\n\nContext:\n"), F.coalesce("context", F.lit("")),
        F.lit("\n\nQuestion: "), F.col(question), F.lit("\nAnswer:"))
    return generate(
        prompts.withColumn("_prompt", prompt), case_id=question_id, prompt="_prompt", factory=factory)
