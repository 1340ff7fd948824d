"""Reading and writing of case tables, series, texts, results and models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselens.functions import rules
from caselens.operators.clean import restore_nulls

CASE_COLUMNS = (
    "case_id bigint, date_received string, product string, issue string, "
    "narrative string, state string, zip_code string, tags string")
RESULT_COLUMNS = "case_id bigint, output string, status string, attempts int, error string"


def read_cases(
    spark: SparkSession, path: str, *, schema: str | T.StructType = CASE_COLUMNS,
    null_tokens: Sequence[str] = tuple(rules.NULL_TOKENS), malformed: str = "fail",
) -> DataFrame:
    """Delimited file with a header; texts may hold quotes, commas and newlines.

    The schema is always given: inferred postal codes lose their leading zeros.
    A row that does not fit it (a key that is no number, a missing field) fails
    the read; with ``malformed="keep"`` it has its raw text in ``_malformed``.
    A multi-line file is one split, so convert it once (``store_cases``).
    """
    reader = (spark.read.option("header", True).option("multiLine", True)
              .option("escape", '"').option("enforceSchema", False))
    if malformed == "keep":
        shape = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
        shape = T.StructType([*shape.fields, T.StructField("_malformed", T.StringType())])
        reader = reader.schema(shape).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_malformed")
    elif malformed == "fail":
        reader = reader.schema(schema).option("mode", "FAILFAST")
    else:
        raise ValueError("malformed is 'fail' or 'keep'")
    return restore_nulls(reader.csv(path), tokens=null_tokens)


def store_cases(spark: SparkSession, path: str, out: str, *, key: str = "case_id", **options) -> DataFrame:
    """Convert a delimited file to Parquet once, and check that every row has a key of its own."""
    write_table(read_cases(spark, path, **options), out)
    stored = spark.read.parquet(out)
    n, keyed, distinct = stored.agg(F.count("*"), F.count(key), F.count_distinct(key)).first()
    if keyed < n or distinct < keyed:
        raise ValueError(f"{n - keyed} rows without {key}, {keyed - distinct} that repeat one")
    return stored


def read_places(spark: SparkSession, path: str) -> DataFrame:
    return read_cases(spark, path, schema="zip string, city string, state_id string")


def read_series(spark: SparkSession, path: str, *, start: str, end: str) -> DataFrame:
    """Staged long table ``(series, ts, value)`` between two dates, both included.

    The range is one of ``ts`` itself, so files and row groups outside are not read.
    """
    table = spark.read.parquet(path)
    kind = table.schema["ts"].dataType
    after = F.date_add(F.to_date(F.lit(end)), 1)
    return table.where((F.col("ts") >= F.to_date(F.lit(start)).cast(kind)) & (F.col("ts") < after.cast(kind)))


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """One document per file, with its source."""
    return (spark.read.text(path, wholetext=True)
            .select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("content")))


def read_results(spark: SparkSession, path: str, *, schema: str = RESULT_COLUMNS) -> DataFrame:
    """Finished keyed results, or an empty table on the first run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def parse_replies(df: DataFrame, *, reply: str, schema: str, output: str = "parsed") -> DataFrame:
    """JSON replies as a struct; a reply that is no JSON gives a struct of nulls."""
    return df.withColumn(output, F.from_json(reply, schema, {"mode": "PERMISSIVE"}))


def parse_variants(df: DataFrame, *, reply: str, output: str = "value") -> DataFrame:
    """JSON replies of any shape as VARIANT; null where a reply is no JSON."""
    return df.withColumn(output, F.try_parse_json(reply))


def variant_schema(df: DataFrame, *, value: str = "value") -> str:
    """The one schema that covers all replies; a field of several types is VARIANT there."""
    return df.agg(F.schema_of_variant_agg(value)).first()[0]


def variant_fields(
    df: DataFrame, *, fields: Mapping[str, str], value: str = "value", misfits: str = "misfits",
) -> DataFrame:
    """A column of the given type per field, read from a VARIANT object.

    A field that is there but does not fit its type is null, and kept as JSON
    text in the map ``misfits`` (name to text, empty where all fit); a missing
    field and a JSON null are null only.
    """
    typed, kept = {}, []
    for name, kind in fields.items():
        if set(name) & set('"\\'):
            raise ValueError(f"a VARIANT path cannot name the field {name}")
        path = f'$["{name}"]'
        raw = F.try_variant_get(value, path, "variant")
        typed[name] = F.try_variant_get(value, path, kind)
        bad = raw.isNotNull() & ~F.is_variant_null(raw) & typed[name].isNull()
        kept.append(F.when(bad, F.struct(F.lit(name).alias("key"), F.to_json(raw).alias("value"))))
    return df.withColumns({misfits: F.map_from_entries(F.array_compact(F.array(*kept))), **typed})


def write_table(df: DataFrame, path: str, *, mode: str = "overwrite", fmt: str = "parquet",
                partition_by: Sequence[str] = ()) -> None:
    """Write a table. CSV has a header and doubles its quotes, as ``read_cases`` expects."""
    writer = df.write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').option("quoteAll", True).csv(path)
    else:
        writer.format(fmt).save(path)


def append_table(df: DataFrame, path: str, *, fmt: str = "parquet") -> None:
    write_table(df, path, mode="append", fmt=fmt)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    """A pipeline model as ``save_model`` stored it."""
    return PipelineModel.load(path)
