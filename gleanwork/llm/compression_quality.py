"""Quality classifier by compression.

One zstandard dictionary is trained on texts labelled good and one on texts
labelled bad. A text is compressed whole with each; the difference of the two
sizes, normalised by the text's length and by the sizes' sum, becomes a score
by logistic calibration. As a difference means more in a text that compresses
little, the sizes per byte and the length take part in the calibration.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanwork.llm._shared import bound_batches, byte_values, own_columns

#: The classifier is fitted on a bounded sample of labelled rows: so many texts
#: of each label train its dictionary, and so many others the calibration.
#: They are the first by md5 of their id, of texts of at most 64 KiB.
DICT_TEXTS = 600
FIT_TEXTS = 1500
MOST_BYTES = 64 << 10
DICT_BYTES = 64 << 10
LEVEL = 3
CUT = 0.3


@dataclass(frozen=True)
class Model:
    """Dictionaries and calibration; a few hundred KB, whatever the corpus."""

    good: bytes
    bad: bytes
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


NEUTRAL = Model(b"", b"", (0.0,) * 5, (1.0,) * 5, (0.0,) * 6)


def trained_dictionary(texts: list[bytes]) -> bytes:
    """A dictionary of the texts; of too few for training, their own content."""
    texts = [x for x in texts if x]
    try:
        return zstandard.train_dictionary(DICT_BYTES, texts).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"\n".join(texts)[:DICT_BYTES]


def compressor(data: bytes) -> zstandard.ZstdCompressor:
    if len(data) < 8:
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
    own = zstandard.ZstdCompressionDict(data)
    own.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=own, write_content_size=False, write_dict_id=False)


def features(texts: list[bytes], good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> np.ndarray:
    sizes = np.array([(len(x), len(good.compress(x)), len(bad.compress(x))) for x in texts], float).reshape(-1, 3)
    n, g, b = sizes.T
    one = np.maximum(n, 1)
    return np.stack([(b - g) / one, (b - g) / np.maximum(b + g, 1), g / one, b / one, np.log1p(n)], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, rounds: int = 60) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method, the constant last."""
    x = np.c_[x, np.ones(len(x))]
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (weight * (y - p)) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(doc_id: str = "doc_id") -> F.Column:
    """Whether crc32 of the id as text leaves no remainder by 5; such rows are not learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Model from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, quality`` 0 or 1).

    Without labelled texts of both kinds (at most 64 KiB long) all texts score
    0.5. Of repeated ids in ``labels`` the lower label counts, and of repeated
    ids in ``docs`` the least text, so that the driver gets one text for each
    drawn id; null ids and null texts are not learned from.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.withColumn("rank", F.md5(F.col("doc_id").cast("string")))
    totals = {q: n for q, n in known.groupBy("quality").count().collect()}
    if len(totals) < 2:
        return NEUTRAL
    most = DICT_TEXTS + FIT_TEXTS
    drawn = [known.where(F.col("quality") == q).orderBy("rank", "doc_id").limit(most) for q in (0, 1)]
    ids = docs.sparkSession.createDataFrame(drawn[0].union(drawn[1]).collect(), known.schema).withColumnRenamed("doc_id", "_id")  # at most 2 * most rows
    texts = docs.where(F.octet_length("text") <= MOST_BYTES).join(F.broadcast(ids), F.col("doc_id") == F.col("_id"))
    texts = texts.groupBy("quality", "rank", "doc_id").agg(F.min("text").alias("text"))
    by_label: dict[int, list[bytes]] = {0: [], 1: []}
    for q, _, _, text in sorted(texts.select("quality", "rank", "doc_id", "text").collect()):
        by_label[q].append(text.encode("utf-8", "replace"))
    split = {q: min(DICT_TEXTS, len(x) // 2) for q, x in by_label.items()}
    good, bad = (trained_dictionary(by_label[q][: split[q]]) for q in (1, 0))
    rest = {q: x[split[q] :] for q, x in by_label.items()}
    if not rest[0] or not rest[1]:
        return NEUTRAL
    y = np.array([q for q in (0, 1) for _ in rest[q]], float)
    # both labels weigh as in all labelled rows
    share = {q: totals[q] / sum(totals.values()) * len(y) / max(1, len(rest[q])) for q in (0, 1)}
    x = features([t for q in (0, 1) for t in rest[q]], compressor(good), compressor(bad))
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    w = logistic((x - mean) / scale, y, np.array([share[int(q)] for q in y]))
    return Model(good, bad, tuple(mean.tolist()), tuple(scale.tolist()), tuple(w.tolist()))


def score_quality(docs: DataFrame, model: Model, text_col: str = "text", cut: float = CUT) -> DataFrame:
    """Add ``score`` (0 to 1, higher: good likelier) and ``predicted`` (1 if score >= ``cut``) to each row.

    Only the text is looked at. Null counts as empty, and the empty text has a
    score like any other; texts of any length are compressed whole; repeated
    rows are scored one by one and an empty table gives an empty result;
    clashing input columns get the suffix ``_in``. No shuffle.
    """
    bound_batches(docs.sparkSession)
    docs = own_columns(docs, ["score", "predicted"])
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name != text_col]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "score double", "predicted int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        good, bad = compressor(m.good), compressor(m.bad)
        mean, scale, w = np.array(m.mean), np.array(m.scale), np.array(m.weights)
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            x = (features(byte_values(batch.column(at)), good, bad) - mean) / scale
            score = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
            columns = {n: batch.column(i) for i, n in enumerate(batch.schema.names) if i != at}
            yield pa.RecordBatch.from_pydict(columns | {"score": pa.array(score), "predicted": pa.array((score >= cut).astype(np.int32))})

    return docs.mapInArrow(run, schema)
