"""Supervised labels, topics, and their evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import (
    CountVectorizer, HashingTF, IDF, IndexToString, StringIndexer)
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselens.functions.text import words


def hash_split(df: DataFrame, *, case_id: str, test_share: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key: the same rows on every run."""
    place = F.pmod(F.xxhash64(F.lit(seed), F.col(case_id)), F.lit(10_000))
    cut = int(test_share * 10_000)
    return df.where(place >= cut), df.where(place < cut)


def fit_classifier(train: DataFrame, *, text: str, label: str, dims: int = 1 << 14, reg: float = 0.01) -> PipelineModel:
    """tf-idf and logistic regression. Rows need ``text`` and ``label``."""
    indexer = StringIndexer(inputCol="_label", outputCol="_y", stringOrderType="alphabetAsc")
    prepared = _tokens(train, text).withColumn("_label", F.col(label).cast("string")).where("_label is not null")
    labels = indexer.fit(prepared)
    return Pipeline(stages=[
        labels,
        HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=dims),
        IDF(inputCol="_tf", outputCol="_x"),
        LogisticRegression(featuresCol="_x", labelCol="_y", predictionCol="_p", regParam=reg, maxIter=50),
        IndexToString(inputCol="_p", outputCol="predicted", labels=labels.labels),
    ]).fit(prepared)


def _tokens(df: DataFrame, text: str) -> DataFrame:
    return df.withColumn("_tokens", words(F.lower(F.coalesce(text, F.lit("")))))


def classify(model: PipelineModel, df: DataFrame, *, text: str) -> DataFrame:
    """Add ``predicted``. The label column is not needed."""
    # The indexer serves the training only.
    scored = PipelineModel(model.stages[1:]).transform(_tokens(df, text))
    return scored.drop("_tokens", "_tf", "_x", "rawPrediction", "probability", "_p")


def confusion(df: DataFrame, *, actual: str, predicted: str) -> DataFrame:
    return df.groupBy(F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def class_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall and F1 per class from a confusion table; null where undefined."""
    sides = (matrix.select(F.col("actual").alias("label"), "n", F.lit(1).alias("is_actual"),
                           (F.col("actual") == F.col("predicted")).alias("hit"))
             .unionByName(matrix.select(F.col("predicted").alias("label"), "n", F.lit(0).alias("is_actual"),
                                        F.lit(False).alias("hit"))))
    add = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    counts = sides.where("label is not null").groupBy("label").agg(
        add(F.col("is_actual") == 1).alias("support"),
        add(F.col("is_actual") == 0).alias("n_predicted"),
        add(F.col("hit")).alias("n_hit"))
    precision = F.when(F.col("n_predicted") > 0, F.col("n_hit") / F.col("n_predicted"))
    recall = F.when(F.col("support") > 0, F.col("n_hit") / F.col("support"))
    f1 = 2 * F.col("n_hit") / (F.col("support") + F.col("n_predicted"))
    return counts.withColumns({"precision": precision, "recall": recall, "f1": f1})


def errors(df: DataFrame, *, actual: str, predicted: str) -> DataFrame:
    """Wrongly predicted rows, null-safe."""
    return df.where(~F.col(actual).eqNullSafe(F.col(predicted)))


def fit_topics(
    df: DataFrame, *, text: str, k: int = 10, vocabulary: int = 1 << 14, min_docs: float = 2.0,
    max_docs: float = 0.5, max_iter: int = 10, seed: int = 42, round_cases: int = 4096,
) -> PipelineModel:
    """Latent Dirichlet allocation over word counts.

    Terms in fewer than ``min_docs`` or more than ``max_docs`` cases are left
    out; below 1 the limits are shares, else numbers of cases. Of the rest the
    ``vocabulary`` most frequent ones are used. A round reads a twentieth of
    the cases, at least ``round_cases`` where there are as many.
    """
    n = df.count()
    share = min(1.0, max(0.05, round_cases / max(1, n)))
    # Given a share, the vectorizer would hold the words of all cases to count them. A limit below one case stays a share.
    least = min_docs if min_docs >= 1 else max(1.0, min_docs * n)
    most = max_docs if max_docs >= 1 or max_docs * n < 1 else max_docs * n
    return Pipeline(stages=[
        CountVectorizer(inputCol="_tokens", outputCol="_tf", vocabSize=vocabulary, minDF=least, maxDF=most),
        LDA(featuresCol="_tf", k=k, maxIter=max_iter, seed=seed, optimizer="online", subsamplingRate=share),
    ]).fit(_tokens(df, text))


def topic_of(model: PipelineModel, df: DataFrame, *, text: str) -> DataFrame:
    """Add ``topic_weights`` and ``topic``, the strongest one."""
    scored = model.transform(_tokens(df, text))
    weights = vector_to_array("topicDistribution")
    return (scored.withColumn("topic_weights", weights)
            .withColumn("topic", (F.array_position("topic_weights", F.array_max("topic_weights")) - 1).cast("int"))
            .drop("_tokens", "_tf", "topicDistribution"))


def topic_terms(model: PipelineModel, k: int = 10) -> DataFrame:
    """The k strongest terms of each topic."""
    described = model.stages[1].describeTopics(k)
    rows = described.select("topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("place", "t"))
    names = described.sparkSession.createDataFrame(
        list(enumerate(model.stages[0].vocabulary)), "term_no int, term string")
    return (rows.join(F.broadcast(names), F.col("t.termIndices") == F.col("term_no"))
            .select("topic", (F.col("place") + 1).alias("rank"), "term", F.col("t.termWeights").alias("weight")))
