"""Quality of documents by positive-unlabelled learning.

Known are good documents (trusted positives) and any documents (unlabelled).
A logistic model over binned measures of the text is fitted to the
non-negative unbiased risk (Kiryo et al., 2017): with the share ``prior`` of
good ones among the unlabelled,

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)).

The prior is estimated first (best bin, Garg et al., 2021): among documents
that a positive-against-unlabelled model scores highest, the share of the
unlabelled ones over that of the positives.

The fit uses bounded samples, drawn by a hash of the id; scores are given to
every document over its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from caselens.llm import words as W

#: Documents of each sample at most.
SAMPLE = 20_000
#: Bins of each measure.
BINS = 12

MEASURES = ("words", "upper", "digits", "bars", "symbols", "marks", "lines", "space", "word_length", "distinct_words",
            "short_words", "long_words", "non_ascii", "distinct_pairs", "top_word", "capital_words", "distinct_lines")

_UPPER = slice(0x41, 0x5B)
_NOT_LINE = ~W.classes((0x0A, 0x0A))


def _per_text(offsets: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _distinct(keys: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys of each text, and how often the most frequent one occurs."""
    salted = keys ^ W.mix(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(salted)
    keyed, of = salted[order], owner[order]
    first = np.flatnonzero(np.concatenate([[True], keyed[1:] != keyed[:-1]])) if len(keyed) else np.zeros(0, np.int64)
    size = np.diff(np.append(first, len(keyed)))
    distinct, most = np.bincount(of[first], minlength=n), np.zeros(n, np.int64)
    np.maximum.at(most, of[first], size)
    return distinct, most


def measures(texts: pa.Array) -> np.ndarray:
    """One row of numbers per text; an empty or null text gives zeros."""
    data, offsets = W.texts_buffer(texts)
    out = np.zeros((len(texts), len(MEASURES)))
    for a, b in W.slices(offsets):
        part = offsets[a:b + 1]
        out[a:b] = _measures(data[part[0]:part[-1]], part - part[0])
    return out


def _measures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    n = len(offsets) - 1
    table = np.bincount(_per_text(offsets) * 256 + data, minlength=n * 256).reshape(n, 256)
    chars = np.maximum(table.sum(1) - table[:, 0x80:0xC0].sum(1), 1)
    upper, lower = table[:, _UPPER].sum(1), table[:, 0x61:0x7B].sum(1)
    digits = table[:, 0x30:0x3A].sum(1)
    space = table[:, 0x20] + table[:, 0x09:0x0E].sum(1)
    marks = table[:, [0x21, 0x2C, 0x2E, 0x3A, 0x3B, 0x3F]].sum(1)
    ascii_rest = table[:, 0x21:0x7F].sum(1) - upper - lower - digits - marks
    found = W.words(data, offsets)
    hashes, counts = found.hashes(), found.counts()
    owner = _per_text(found.offsets)
    size = found.ends - found.starts
    some = np.maximum(counts, 1)
    share = lambda mask: np.bincount(owner[mask], minlength=n) / some
    distinct, most = _distinct(hashes, owner, n)
    pair_ok = W.within(found.offsets, 2)
    pairs, _ = _distinct(W.windows(hashes, 2)[pair_ok], owner[:len(pair_ok)][pair_ok], n)
    first = data[found.starts] if len(found.starts) else np.zeros(0, np.uint8)
    lines = W.words(data, offsets, _NOT_LINE, lower=False)
    line_count = np.maximum(lines.counts(), 1)
    line_distinct, _ = _distinct(lines.hashes(), _per_text(lines.offsets), n)
    grown = lambda x: np.log1p(x) / np.log1p(some)  # noqa: E731  on a scale that does not follow the length
    columns = [
        np.log1p(counts), upper / np.maximum(upper + lower, 1), digits / chars, table[:, 0x7C] / some, ascii_rest / some,
        marks / some, table[:, 0x0A] / some, space / chars, np.bincount(owner, size, n) / some, grown(distinct),
        share(size <= 3), share(size >= 15), table[:, 0xC0:].sum(1) / chars, grown(pairs), most / some,
        share((first >= 0x41) & (first <= 0x5A)), line_distinct / line_count]
    out = np.stack(columns, 1)
    out[counts == 0] = 0.0
    return out


@dataclass(frozen=True)
class Model:
    edges: list[np.ndarray]  # of the bins of each measure
    weights: np.ndarray      # one per bin, then the constant
    prior: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Number of the bin of each measure, counted over all measures."""
        at = np.stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)], 1)
        return at + np.cumsum([0] + [len(e) + 1 for e in self.edges[:-1]])

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.weights[self.bins(x)].sum(1) + self.weights[-1])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass(frozen=True)
class _Rows:
    """Rows with one bin per measure and the constant, as a sparse matrix."""

    bins: np.ndarray
    width: int

    @classmethod
    def of(cls, bins: np.ndarray, width: int) -> _Rows:
        return cls(np.concatenate([bins, np.full((len(bins), 1), width - 1)], axis=1), width)

    def times(self, w: np.ndarray) -> np.ndarray:
        return w[self.bins].sum(1)

    def mean(self, values: np.ndarray) -> np.ndarray:
        """Mean over the rows of each row times its value."""
        return np.bincount(self.bins.ravel(), np.repeat(values, self.bins.shape[1]), minlength=self.width) / len(values)


def _descend(gradient, width: int, rounds: int, rate: float, decay: float) -> np.ndarray:
    """Adam."""
    w, m, v = np.zeros(width), np.zeros(width), np.zeros(width)
    for t in range(1, rounds + 1):
        g = gradient(w)
        g[:-1] += decay * w[:-1]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Best-bin estimate from scores of rows that the scoring model was not fitted on."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    levels = np.unique(np.quantile(np.concatenate([positive, unlabelled]), np.linspace(0, 0.95, 96)))
    q_p = 1 - np.searchsorted(np.sort(positive), levels) / len(positive)
    q_u = 1 - np.searchsorted(np.sort(unlabelled), levels) / len(unlabelled)
    slack = np.sqrt(np.log(200) / (2 * len(positive))) + np.sqrt(np.log(200) / (2 * len(unlabelled)))
    usable = q_p > 0
    best = np.argmin((q_u + slack)[usable] / q_p[usable])
    return float(np.clip((q_u[usable] / q_p[usable])[best], 0.02, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, *, prior: float | None = None, bins: int = BINS,
        rounds: int = 400, rate: float = 0.05, decay: float = 1e-4) -> Model:
    """Model from the measures of positives and of unlabelled documents. Without positives all scores are 0.5."""
    width_of = len(MEASURES)
    both = np.concatenate([positive, unlabelled]) if len(positive) + len(unlabelled) else np.zeros((1, width_of))
    edges = [np.unique(np.quantile(both[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width_of)]
    # Rare values at either end get bins of their own: bad documents are few.
    for j in range(width_of):
        edges[j] = np.unique(np.concatenate([edges[j], np.quantile(both[:, j], [0.005, 0.02, 0.05, 0.95, 0.98, 0.995])]))
    width = sum(len(e) + 1 for e in edges) + 1
    model = Model(edges, np.zeros(width), 0.5)
    if not len(positive) or not len(unlabelled):
        return model
    p, u = _Rows.of(model.bins(positive), width), _Rows.of(model.bins(unlabelled), width)

    given = prior
    if prior is None:
        half_p, half_u, rest_p, rest_u = (_Rows(x.bins[i::2], width) for i, x in ((0, p), (0, u), (1, p), (1, u)))

        def against(w: np.ndarray) -> np.ndarray:
            return 0.5 * (half_p.mean(_sigmoid(half_p.times(w)) - 1) + half_u.mean(_sigmoid(half_u.times(w))))

        w = _descend(against, width, rounds // 2, rate, 10 * decay)
        prior = estimate_prior(rest_p.times(w), rest_u.times(w))

    def risk(w: np.ndarray) -> np.ndarray:
        s_p, s_u = _sigmoid(p.times(w)), _sigmoid(u.times(w))
        # Logistic losses: of "good" -log(s), of "bad" -log(1 - s).
        bad = -np.log1p(-np.minimum(s_u, 1 - 1e-7)).mean() + prior * np.log1p(-np.minimum(s_p, 1 - 1e-7)).mean()
        g_bad = u.mean(s_u) - prior * p.mean(s_p)
        g_good = prior * p.mean(s_p - 1)
        return g_good + g_bad if bad >= 0 else -g_bad

    w = _descend(risk, width, rounds, rate, decay)
    if given is None:  # the fitted model tells the two apart better than the first one
        prior = min(prior, estimate_prior(p.times(w), u.times(w)))
        w = _descend(risk, width, rounds, rate, decay)
    w[-1] -= cut(p.times(w), u.times(w), prior)
    return Model(edges, w, prior)


def cut(positive: np.ndarray, unlabelled: np.ndarray, prior: float, tolerance: float = 0.005) -> float:
    """Level of least estimated error: good ones below it, and unlabelled ones above it that are not good.

    Of levels whose errors differ by less than ``tolerance``, the lowest: in doubt a document is kept.
    """
    levels = np.unique(np.concatenate([positive, unlabelled]))
    levels = np.concatenate([[levels[0] - 1], (levels[1:] + levels[:-1]) / 2])
    good = 1 - np.searchsorted(np.sort(positive), levels) / len(positive)
    above = 1 - np.searchsorted(np.sort(unlabelled), levels) / len(unlabelled)
    error = prior * (1 - good) + np.maximum(above - prior * good, 0)
    return float(levels[np.flatnonzero(error <= error.min() + tolerance)[0]])


def remainder(doc_id: Column, folds: int = 3) -> Column:
    """``crc32`` of the id as text, modulo ``folds``; a null id counts as empty."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def train(docs: DataFrame, positives: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
          sample: int = SAMPLE, prior: float | None = None) -> Model:
    """Fit on ``positives`` (ids of trusted good documents) and on ``docs`` as unlabelled ones.

    Both samples hold about ``sample`` documents at most, those of the least
    hashes; they are read in one scan.
    """
    n_good, n_all = positives.count(), docs.count()
    rank = lambda c: F.pmod(F.xxhash64(c.cast("string"), F.lit("quality")), F.lit(1 << 30))
    below = lambda n: int((1 << 30) * min(1.0, sample / max(n, 1)))
    good = F.broadcast(positives.select(F.col(positives.columns[0]).alias("_id")).distinct()
                       .where(rank(F.col("_id")) < below(n_good)).withColumn("good", F.lit(True)))  # about `sample` ids
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text"))
    drawn = F.pmod(F.xxhash64(F.col("_doc").cast("string"), F.lit("unlabelled")), F.lit(1 << 30)) < below(n_all)
    rows = (rows.withColumn("any", drawn).join(good, F.col("_doc") == F.col("_id"), "left")
            .select("text", F.coalesce("any", F.lit(False)).alias("any"), F.coalesce("good", F.lit(False)).alias("good"))
            .where("any or good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(2), pa.array(list(measures(batch.column(0))), pa.list_(pa.float64()))],
                ["any", "good", "x"])

    got = rows.mapInArrow(W.lean(run), "any boolean, good boolean, x array<double>").toArrow()
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(MEASURES))
    is_any, is_good = got["any"].to_numpy(), got["good"].to_numpy()
    order = np.lexsort(x.T)  # the fit does not depend on the order of arrival
    x, is_any, is_good = x[order], is_any[order], is_good[order]
    return fit(x[is_good], x[is_any], prior=prior)


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``docs``) and ``score`` in (0, 1), higher for better."""
    shape = StructType([StructField("row", docs.schema), StructField("score", DoubleType())])
    shipped = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row = batch.column(0)
            x = measures(row.field(row.type.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([row, pa.array(shipped.value.score(x))], ["row", "score"])

    return docs.select(F.struct("*").alias("row")).mapInArrow(W.lean(run), shape)


def trusted(docs: DataFrame, labels: DataFrame, *, fold: int = 1, folds: int = 3, doc_id: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Documents and ids of good ones outside the held-out fold."""
    own = docs.where(remainder(F.col(doc_id), folds) != fold)
    good = labels.where((F.col("quality") == 1) & (remainder(F.col("doc_id"), folds) != fold)).select("doc_id")
    return own, good


def report(docs: DataFrame, labels: DataFrame, **how) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row.

    ``labels`` (``doc_id, quality``) are learnt from outside the held-out fold
    only, and so are the unlabelled texts. Null and empty texts get the score
    of a text without words. Ids may repeat or be null.
    """
    model = train(*trusted(docs.select("doc_id", "text"), labels), **how)
    rows = score(docs.select("doc_id", "text"), model)
    return rows.select(
        "row.doc_id", (remainder(F.col("row.doc_id")) == 1).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
