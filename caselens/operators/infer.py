"""Model calls, keyed by case. The model is a callable the caller passes in."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import _col, trim_ws
from caselens.operators.joins import pending
from caselens.runtime import new_path
from caselens.sources.tables import append_table, read_results, write_table

Generate = Callable[[list[str]], list[str]]


def render_prompt(instruction: str, text: Column | str, cue: str = "") -> Column:
    """Instruction, one text and the cue the reply follows."""
    return F.concat(F.lit(instruction + "\n\n"), trim_ws(text), F.lit("\n\n" + cue if cue else ""))


def render_numbered(instruction: str, texts: Column | str, cue: str = "") -> Column:
    """Instruction and a numbered list of texts."""
    lines = F.transform(_col(texts), lambda t, i: F.concat((i + 1).cast("string"), F.lit(". "), trim_ws(t)))
    return F.concat(F.lit(instruction + "\n\n"), F.array_join(lines, "\n"), F.lit("\n\n" + cue if cue else ""))


def _caller(
    model: Generate, last: Generate | None, accept: Callable[[str], str] | None, max_attempts: int, backoff: float,
):
    """Answer a slice of prompts as ``(output, status, attempts, error)`` each."""
    tries = [model] * max_attempts + ([last] if last else [])

    def ask(model: Generate, prompts: list[str]) -> list[str]:
        replies = list(model(prompts))
        if len(replies) != len(prompts):
            raise ValueError(f"{len(replies)} replies for {len(prompts)} prompts")
        return ["" if r is None else str(r) for r in replies]

    def once(model: Generate, prompts: list[str]) -> list[tuple[str, str | None]]:
        # A failed batch is asked again one by one, so that one bad row fails alone.
        try:
            return [(r, None) for r in ask(model, prompts)]
        except Exception as failed:
            if len(prompts) == 1:
                return [("", f"{type(failed).__name__}: {failed}")]
        return [once(model, [p])[0] for p in prompts]

    def answer(prompts: list[str]) -> list[tuple[str, str, int, str | None]]:
        results: list = [None] * len(prompts)
        left = list(range(len(prompts)))
        for attempt, model in enumerate(tries, 1):
            if attempt > 1 and backoff:
                time.sleep(backoff * 2 ** (attempt - 2))
            for i, (reply, error) in zip(left, once(model, [prompts[i] for i in left])):
                output = accept(reply) if accept and error is None else reply
                status = "error" if error else "ok" if output else "empty"
                results[i] = (output, status, attempt, error)
            left = [i for i in left if results[i][1] != "ok"]
            if not left:
                break
        return results

    return answer


def generate(
    df: DataFrame,
    *,
    case_id: str,
    prompt: str,
    factory: Callable[[], Generate],
    last_factory: Callable[[], Generate] | None = None,
    subject: str | None = None,
    accept: Callable[[str], str] | None = None,
    max_attempts: int = 3,
    batch_size: int = 16,
    backoff: float = 0.0,
    concurrency: int | None = None,
    stop_after: int | None = 100,
) -> DataFrame:
    """One ``(case_id, output, status, attempts, error)`` row per case.

    ``factory`` builds the model once per partition; ``concurrency`` is the
    number of partitions. ``accept`` turns a reply into the output, '' to ask
    again, ``max_attempts`` times (waiting ``backoff`` seconds, doubled each time, in between) and then once the model of ``last_factory``
    (one that does not sample, say). Cases whose ``subject`` (default: prompt) is blank are not asked.
    After ``stop_after`` failed cases in a row the task fails, so that a dead
    endpoint does not turn the whole table into errors (None: never).
    Status: ``ok``, ``empty`` (no accepted reply), ``error``, ``blank``. Spark may
    run a task twice; a model may then be asked twice, results stay unique. The
    result is lazy, so every action asks again: write it, or use
    ``generate_resumable``, before using it more than once.
    """
    key_type = df.schema[case_id].dataType.simpleString()
    subject_text = F.col(subject or prompt)
    blank = subject_text.isNull() | (F.length(trim_ws(subject_text)) == 0)
    asked = df.select(case_id, F.when(~blank, F.col(prompt)).alias("_prompt"))
    if concurrency:
        asked = asked.repartition(concurrency)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = None
        failed = 0
        for pdf in batches:
            results: list = [("", "blank", 0, None)] * len(pdf)
            todo = [i for i, p in enumerate(pdf["_prompt"]) if isinstance(p, str)]
            if todo and answer is None:
                answer = _caller(factory(), last_factory and last_factory(), accept, max_attempts, backoff)
            for start in range(0, len(todo), batch_size):
                part = todo[start:start + batch_size]
                for i, result in zip(part, answer([pdf["_prompt"].iat[i] for i in part])):
                    results[i] = result
                    failed = failed + 1 if result[1] == "error" else 0
                    if stop_after is not None and failed >= stop_after:
                        raise RuntimeError(f"{failed} calls in a row failed, the last one with {result[3]}")
            out = pd.DataFrame(results, columns=["output", "status", "attempts", "error"])
            out.insert(0, case_id, pdf[case_id].to_numpy())
            yield out

    return asked.mapInPandas(
        run, f"`{case_id}` {key_type}, output string, status string, attempts int, error string")


def generate_resumable(
    df: DataFrame, *, case_id: str, path: str, slices: int = 1,
    done: Sequence[str] = ("ok", "blank"), **options,
) -> DataFrame:
    """Answer the cases without a finished result, appending to the table at ``path``.

    Each slice of the keys is one atomic append, so a run that dies keeps the
    slices before it. The open cases are found once and stored by slice, so
    slices cost no further reads of ``df``. Returns one row per key, its latest
    try.
    """
    spark = df.sparkSession
    key_type = df.schema[case_id].dataType.simpleString()
    schema = (f"`{case_id}` {key_type}, output string, status string, attempts int, "
              "error string, run int")
    before = read_results(spark, path, schema=schema)
    run = (before.agg(F.max("run")).first()[0] or 0) + 1
    asked = list(dict.fromkeys(c for c in (case_id, options["prompt"], options.get("subject")) if c))
    todo = pending(df.select(*asked), before, case_id=case_id, done=done)
    if slices > 1:
        held = new_path(spark, "pending")
        sliced = todo.withColumn("_slice", F.pmod(F.xxhash64(case_id), F.lit(slices)).cast("int"))
        write_table(sliced, held, partition_by=["_slice"])
        stored = spark.read.schema(sliced.schema).parquet(held)
        parts = [stored.where(F.col("_slice") == i) for i in range(slices)]
    else:
        parts = [todo]
    for part in parts:
        results = generate(part, case_id=case_id, **options)
        append_table(results.withColumn("run", F.lit(run)), path)
    return latest_results(read_results(spark, path, schema=schema), case_id=case_id)


def latest_results(results: DataFrame, *, case_id: str, run: str = "run") -> DataFrame:
    """The last try of every key; a key has one row per run."""
    rest = [c for c in results.columns if c not in (case_id, run)]
    return (results.groupBy(case_id).agg(F.max_by(F.struct(*rest), run).alias("r"))
            .select(case_id, "r.*"))
