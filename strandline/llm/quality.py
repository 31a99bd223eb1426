"""Operator 1: quality classifier by co-training two views of a document.

The text view has shares of character classes, word and repetition figures of the whole text; the
metadata view has language, source and length, one-hot. Each view has a logistic model. Both first
learn from the labelled documents. In each round, documents without a label that one view is sure of
become training rows of the other view. Training is Newton's method: every step is one Spark job over
the written feature table, in which each partition sums its rows' gradients and curvatures; only sums
of a fixed size reach the driver. A fold of the labelled rows, of which at most CALIBRATION_ROWS are
used, stays out of training and calibrates both views and their combination. Documents whose
combined probability of being good is under KEEP_FROM are rejected.

Defined results: null text counts as empty, null lang, source and n_chars are values of their own;
a document with several labels takes their mean, rounded up at a half; repeated rows are all scored;
without any labels every document scores 0.5 and is kept; further columns are kept (see screen()).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common
from strandline.llm.shingles import BLOCK, shingle_sets

ROUNDS, STEPS = 3, 4
#: A view is sure above and below these probabilities.
SURE = (0.03, 0.97)
#: Strength of the quadratic penalty, in rows.
PENALTY = 1.0
#: One labelled document in CALIBRATION_FOLD is kept for calibration, at most CALIBRATION_ROWS.
CALIBRATION_FOLD, CALIBRATION_ROWS = 5, 20_000
KEEP_FROM = 0.5

_CLASS = np.zeros(256, np.int64)  # 0: other ASCII signs
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t\r\x0b\f", b"\n", b".,;:?'\"()-", b"!"), 1):
    _CLASS[list(_chars)] = _k
_CLASS[128:] = 8
_CLASSES = 9
_SOURCES, _LENGTHS, _LANGS = 16, 18, 8


def _hash(value: str | None, cells: int) -> int:
    """A cell for a name, 0 for null."""
    import zlib

    return 0 if value is None else 1 + zlib.crc32(value.encode()) % (cells - 1)


def text_view(texts: pa.Array) -> np.ndarray:
    """A row of features for each text."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", "u1")
    counts, words, k = np.zeros((len(texts), _CLASSES)), np.zeros(len(texts)), 0
    while k < len(texts):
        e = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BLOCK, "right")) - 1)
        of = np.repeat(np.arange(e - k), np.diff(offsets[k : e + 1]))
        kind = _CLASS[data[offsets[k] : offsets[e]]]
        counts[k:e] = np.bincount(of * _CLASSES + kind, minlength=(e - k) * _CLASSES).reshape(-1, _CLASSES)
        inside = (kind != 4) & (kind != 5)
        start = inside.copy()
        start[1:] &= ~inside[:-1] | (of[1:] != of[:-1])
        words[k:e] = np.bincount(of[start], minlength=e - k)
        k = e
    distinct = np.array([len(s) for s in shingle_sets(texts, 1)], float)
    size, some = counts.sum(1), np.maximum(words, 1)
    share = counts / np.maximum(size, 1)[:, None]
    letters = np.maximum(counts[:, 1] + counts[:, 2], 1)
    variety = distinct / np.maximum(some, 1) ** 0.8
    mean = size / some
    return np.stack(
        [np.ones(len(texts)), np.log1p(words) / 5, words < 10, np.minimum(mean, 30) / 10, np.abs(np.minimum(mean, 30) - 6.5) / 10, counts[:, 2] / letters, 10 * share[:, 0], 10 * share[:, 3], 10 * share[:, 5], 10 * share[:, 6], 10 * share[:, 7], share[:, 8], np.minimum(variety, 2), distinct / some, variety < 0.5, (counts[:, 0] + counts[:, 7]) / some], 1
    )


def meta_view(langs: list, sources: list, chars: list) -> np.ndarray:
    out = np.zeros((len(langs), 1 + _LANGS + _SOURCES + _LENGTHS))
    out[:, 0] = 1
    for k, (a, b, c) in enumerate(zip(langs, sources, chars)):
        out[k, 1 + _hash(a, _LANGS)] = 1
        out[k, 1 + _LANGS + _hash(b, _SOURCES)] = 1
        out[k, 1 + _LANGS + _SOURCES + (0 if c is None else min(_LENGTHS - 1, 1 + max(int(c), 0).bit_length()))] = 1
    return out


TEXT_SIZE, META_SIZE = 16, 1 + _LANGS + _SOURCES + _LENGTHS


def _views(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    return text_view(b.column("text")), meta_view(*[b.column(c).to_pylist() for c in ("lang", "source", "n_chars")])


def _prepared(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, view (both views' numbers as 32-bit floats), y (label or null), fold; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = np.concatenate(_views(b), 1).astype("<f4")
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([r.tobytes() for r in both], pa.binary())], ["doc_id", "view"])

    known = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.when(F.avg("quality") >= 0.5, 1).otherwise(0).alias("y"))
    made = _prepared(docs).mapInArrow(run, "doc_id long, view binary").join(known, "doc_id", "left")
    return common.written(made.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(CALIBRATION_FOLD)).cast("int")), "quality-features")


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(table: DataFrame, weights: list[np.ndarray], teachers: list[np.ndarray] | None) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each view, the gradient and curvature over all training rows."""
    cuts = (0, TEXT_SIZE, TEXT_SIZE + META_SIZE)

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = [(np.zeros(b - a), np.zeros((b - a, b - a))) for a, b in zip(cuts, cuts[1:])]
        for b in batches:
            x = np.frombuffer(b"".join(b.column("view").to_pylist()), "<f4").reshape(b.num_rows, -1).astype(float)
            y = np.array([np.nan if v is None else v for v in b.column("y").to_pylist()], float)
            known, fold = ~np.isnan(y), np.array(b.column("fold").to_pylist())
            views = [x[:, a:e] for a, e in zip(cuts, cuts[1:])]
            for k, v in enumerate(views):
                target, use = np.where(known, y, 0.0), known & (fold != 0)
                if teachers is not None:
                    taught = _p(views[1 - k] @ teachers[1 - k])
                    sure = ~known & ((taught < SURE[0]) | (taught > SURE[1]))
                    target, use = np.where(sure, taught > 0.5, target), use | sure
                v, target = v[use], target[use]
                p = _p(v @ weights[k])
                total[k][0][:] += v.T @ (target - p)
                total[k][1][:] += (v * (p * (1 - p))[:, None]).T @ v
        flat = np.concatenate([np.concatenate([g, h.ravel()]) for g, h in total])
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([flat.tobytes()], pa.binary())], ["part", "sums"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r["part"], r["sums"]) for b in batches for r in b.to_pylist())  # a row a partition
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]], pa.int32()), pa.array([sum(np.frombuffer(s) for _, s in rows).tobytes()], pa.binary())], ["part", "sums"])

    each = table.select("view", "y", "fold").mapInArrow(part, "part int, sums binary")
    rows = sorted((r["part"], bytes(r["sums"])) for r in each.repartition(8, "part").mapInArrow(add, "part int, sums binary").collect())
    flat, out, at = sum(np.frombuffer(s) for _, s in rows), [], 0
    for size in (TEXT_SIZE, META_SIZE):
        out.append((flat[at : at + size], flat[at + size : at + size + size * size].reshape(size, size)))
        at += size + size * size
    return out


def _fit_small(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of a few columns, with a small penalty."""
    w = np.zeros(x.shape[1])
    for _ in range(25):
        p = _p(x @ w)
        w += np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + 0.1 * np.eye(len(w)), x.T @ (y - p) - 0.1 * w)
    return w


class Model:
    """Both views' weights, their calibrations and the combination."""

    def __init__(self, views: list[np.ndarray], calibrations: list[np.ndarray], combined: np.ndarray):
        self.views, self.calibrations, self.combined = views, calibrations, combined

    def scores(self, x: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = [c[0] + c[1] * np.clip(v @ w, -30, 30) for v, w, c in zip(x, self.views, self.calibrations)]
        both = self.combined[0] + self.combined[1] * z[0] + self.combined[2] * z[1]
        return _p(z[0]), _p(z[1]), _p(both)


def train(table: DataFrame) -> Model:
    weights = [np.zeros(TEXT_SIZE), np.zeros(META_SIZE)]
    teachers = None
    for _ in range(ROUNDS):
        for _ in range(STEPS):
            for w, (g, h) in zip(weights, _sums(table, weights, teachers)):
                w += np.linalg.solve(h + PENALTY * np.eye(len(w)), g - PENALTY * w)
        teachers = [w.copy() for w in weights]
    held = table.filter("fold = 0 and y is not null").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(CALIBRATION_ROWS).select("view", "y").collect()
    if not held:
        return Model(weights, [np.array([0.0, 1.0])] * 2, np.array([0.0, 1.0, 0.0]))
    x, y = np.array([np.frombuffer(r["view"], "<f4") for r in held], float), np.array([r["y"] for r in held], float)
    z = [np.clip(v @ w, -30, 30) for v, w in zip((x[:, :TEXT_SIZE], x[:, TEXT_SIZE:]), weights)]
    calibrations = [_fit_small(np.stack([np.ones(len(y)), v], 1), y) for v in z]
    scaled = [c[0] + c[1] * v for c, v in zip(calibrations, z)]
    return Model(weights, calibrations, _fit_small(np.stack([np.ones(len(y)), *scaled], 1), y))


def score(table: DataFrame, model: Model) -> DataFrame:
    """doc_id, text_score, meta_score, score and keep of every row of the feature table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.frombuffer(b"".join(b.column("view").to_pylist()), "<f4").reshape(b.num_rows, -1).astype(float)
            a, m, s = model.scores([x[:, :TEXT_SIZE], x[:, TEXT_SIZE:]])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(a), pa.array(m), pa.array(s), pa.array(s >= KEEP_FROM)], ["doc_id", "text_score", "meta_score", "score", "keep"])

    return table.select("doc_id", "view").mapInArrow(run, "doc_id long, text_score double, meta_score double, score double, keep boolean")


def screen(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of docs that the model keeps, with all their columns; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [v.astype("<f4").astype(float) for v in _views(b)]
            yield b.filter(pa.array(model.scores(x)[2] >= KEEP_FROM))

    return docs.mapInArrow(run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document's scores, and whether it is kept."""
    table = features(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return score(table, train(table))
