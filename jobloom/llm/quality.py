"""Document quality by a regularised quadratic discriminant over transformed statistics of the text."""

from __future__ import annotations

import string
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobloom.llm.storage import cut

UPPER = string.ascii_uppercase.encode()
DIGITS = string.digits.encode()
STOPS = b".,;:?'\"-()"
OTHER_SIGNS = bytes(set(string.punctuation.encode()) - set(STOPS))
FEATURES = 12
EPS = 1e-3


def statistics(text: str | None) -> list[float]:
    """Twelve transformed statistics of a whole text; empty and null texts have fixed ones."""
    raw = (text or "").encode()
    size = max(1, len(raw))
    words = raw.split()
    n = max(1, len(words))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts = Counter(words)
    same = sum(map(bytes.__eq__, words, words[1:]))
    packed = len(zlib.compress(raw, 1))

    def log_share(part: float, whole: float) -> float:
        return float(np.log((part / whole + EPS) / (1 - min(1.0, part / whole) + EPS)))

    def without(chars: bytes) -> int:
        return len(raw) - len(raw.translate(None, chars))

    letters = max(1, len(raw.translate(None, bytes(range(65)) + bytes(range(91, 97)) + bytes(range(123, 128)))))
    return [
        float(np.log1p(len(words))),
        float(np.log((size + 1) / n)),
        log_share(without(UPPER), letters),
        log_share(without(OTHER_SIGNS), size),
        log_share(without(STOPS), size),
        log_share(without(DIGITS), size),
        float(np.log(len(counts) + 1) / np.log(n + 1)),
        log_share(same, n),
        log_share(max(counts.values(), default=0), n),
        log_share(len(set(lines)), max(1, len(lines))),
        float(np.log((packed + 20) / (size + 20))),
        float(np.log((n + 1) / (raw.count(b".") + 1))),
    ]


def _featured(id_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [statistics(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], [id_col, "x"])

    return run


def features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, x): the statistics of each row's whole text."""
    kind = docs.schema[id_col].dataType.simpleString()
    wanted = docs.select(F.col(id_col), F.col(text_col).cast("string"))
    return wanted.mapInArrow(_featured(id_col), f"`{id_col}` {kind}, x array<double>")


def held_out(id_col: Column) -> Column:
    """True for ids that no fit may see: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass
class Discriminant:
    """Class means, inverse Cholesky factors of the shrunk covariances, log determinants and log priors."""

    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 from the difference of Mahalanobis log densities."""
        logs = []
        for mean, factor, offset in zip(self.means, self.factors, self.offsets, strict=True):
            z = (x - mean) @ factor.T
            logs.append(offset - 0.5 * np.einsum("ij,ij->i", z, z))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -700, 700)))


@dataclass
class Constant:
    """What is used when the labels don't show two classes."""

    value: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), self.value)


def _moments(measured: bool):
    """Sums of products of (1, x) by label y, a row for each entry; x is in the batches, or measured here from their texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {c: np.zeros((FEATURES + 1, FEATURES + 1)) for c in (0, 1)}
        for batch in batches:
            if not batch.num_rows:
                continue
            if measured:
                x = batch.column("x").flatten().to_numpy().reshape(-1, FEATURES)
            else:
                x = np.array([statistics(t.as_py()) for t in batch.column("x")])
            x = np.hstack([np.ones((len(x), 1)), x])
            y = batch.column("y").to_numpy()
            for c in sums:
                own = x[y == c]
                sums[c] += own.T @ own
        for c, m in sums.items():
            at = np.arange(m.size)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(m.size, c)), pa.array(at), pa.array(m.ravel())], ["y", "at", "value"]
            )

    return run


def fit(labelled: DataFrame, shrinkage: float = 0.15, prior: float | None = None) -> Discriminant | Constant:
    """Fit on all rows of (x, y), x statistics or whole texts. Moments are summed per task and then by entry; 2 * 169
    numbers come to the driver.

    Each class covariance is shrunk by `shrinkage` towards the pooled one, and that towards its diagonal.
    """
    measured = labelled.schema["x"].dataType.typeName() == "array"
    cells = labelled.where("y in (0, 1)").select("x", F.col("y").cast("bigint")).mapInArrow(
        _moments(measured), "y bigint, at bigint, value double"
    )
    sums = np.zeros((2, (FEATURES + 1) ** 2))
    for r in cells.groupBy("y", "at").agg(F.sum("value").alias("value")).collect():
        sums[r.y, r.at] = r.value
    sums = sums.reshape(2, FEATURES + 1, FEATURES + 1)
    n = sums[:, 0, 0]
    if n.min() < 2:
        return Constant(float(n[1] / n.sum()) if n.sum() else 0.5)
    means = sums[:, 0, 1:] / n[:, None]
    scatter = sums[:, 1:, 1:] - n[:, None, None] * means[:, :, None] * means[:, None, :]
    pooled = scatter.sum(axis=0) / n.sum()
    pooled = 0.9 * pooled + 0.1 * np.diag(np.diag(pooled)) + 1e-4 * np.eye(FEATURES)
    factors, offsets = [], []
    for c in (0, 1):
        cov = (1 - shrinkage) * scatter[c] / n[c] + shrinkage * pooled
        root = np.linalg.cholesky(cov)
        share = n[c] / n.sum() if prior is None else (prior if c else 1 - prior)
        factors.append(np.linalg.inv(root))
        offsets.append(np.log(share) - np.log(np.diag(root)).sum())
    return Discriminant(means, np.array(factors), np.array(offsets))


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality"
) -> tuple[Discriminant | Constant, DataFrame]:
    """Fit on every labelled row that is not held out; return the model and the features of all rows."""
    x = cut(features(docs, id_col, text_col))
    seen = labels.select(F.col(id_col), F.col(label_col).alias("y")).where(~held_out(F.col(id_col)))
    return fit(x.join(seen, id_col).select("x", "y")), x


def train_on_some(
    docs: DataFrame,
    labels: DataFrame,
    most: int = 100_000,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
) -> Discriminant | Constant:
    """Fit on the labelled rows of `most` ids at most, those first by a hash of the id; no id that is held out is seen.

    The ids are sent to every task, so only labelled texts are measured and no text is shuffled.
    """
    known = labels.select(F.col(id_col), F.col(label_col).alias("y")).where(~held_out(F.col(id_col)) & F.col(label_col).isin(0, 1))
    some = known.orderBy(F.xxhash64(id_col), id_col, "y").limit(most).withColumnRenamed(id_col, "labelled_id")
    texts = docs.select(F.col(id_col).alias("labelled_id"), F.col(text_col).cast("string").alias("x"))
    return fit(texts.join(F.broadcast(some), "labelled_id").select("x", "y"))


def score(x: DataFrame, model: Discriminant | Constant, id_col: str = "doc_id") -> DataFrame:
    """(id_col, held_out, score, predicted) for every row of features.

    predicted is 1 from score 0.5. Null and empty texts are scored like any other, from fixed statistics. Repeated
    rows are kept, with equal scores; a null id is scored and never held out; an empty table gives no rows. Without
    two labelled classes every score is the share of label 1, or 0.5.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = model.score(batch.column("x").flatten().to_numpy().reshape(-1, FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(values)], [id_col, "score"])

    kind = x.schema[id_col].dataType.simpleString()
    scored = x.select(id_col, "x").mapInArrow(run, f"`{id_col}` {kind}, score double")
    return scored.select(
        id_col,
        held_out(F.col(id_col)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, model: Discriminant | Constant, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """Rows of docs, all columns, whose text scores at least `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = np.array([statistics(t.as_py()) for t in batch.column(text_col)])
                yield batch.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
