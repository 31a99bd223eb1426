"""Operator 11: hard negatives by exact integer scores, with the method of the Four Russians.

Vectors become integers, floor(256 x). A vector's score for an anchor is their inner product. Dimensions
stand in groups of eight. For an anchor and a group, a table holds the sum of every subset of the
anchor's eight components: 256 entries, each made by one addition. Candidates are kept as bit planes:
for each bit of their components (two's complement) and each group, the eight components' bits are a
byte. That byte looks up the group's part of the score; the planes' parts are added from the highest
bit (which counts negatively) down, doubled from plane to plane. Scores are exact.

Anchors and candidates are written as blocks, and every pair of blocks, a tile, is one row of an
equi-join on the tile's number. A tile keeps only its best rows for each anchor while it goes through
its candidates. Two rounds go over the tiles: the first finds an anchor's positives, the second, with
the positives' scores, the negatives of each. Labels deal nothing out, so a common label is no hot key.

Defined results: rows without vec_id, label or vector, or with a null or non-finite component, take no
part; a repeated vec_id counts once, with the smallest of its vectors, then of its labels; vectors of
another length than the anchor's do not meet it; ties go to the smaller vec_id; an anchor with no other
row of its label has no positives and gives no rows, and a positive without negatives in its range
(always if its score is under 0) none either; components beyond 62 bits are cut to that, and scores
beyond 63 bits wrap, as longs do; an empty table has no rows; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import common

SCALE = 256
POSITIVES, NEGATIVES = 5, 10
#: A negative's score lies between these shares of the positive's, in per cent.
RANGE = (30, 90)
#: Anchors and candidates of a block on average, at most; numbers of such blocks; candidates that are scored at once.
ANCHORS, CANDIDATES, AT_ONCE = 256, 65_536, 1024
ANCHOR_VALUES, CANDIDATE_VALUES = 1 << 16, 1 << 22
GROUP = 8

_SUBSETS = ((np.arange(256)[:, None] >> np.arange(GROUP)) & 1).astype(bool)


def prepared(rows: DataFrame, label: Column, vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id, label, vec (array of longs) of the rows that take part."""
    fit = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    some = rows.select("vec_id", label.cast("long").alias("label"), vector).filter("vec_id is not null and label is not null").filter(F.col(vector).isNotNull() & fit)
    edge = float(1 << 62)
    whole = F.transform(vector, lambda v: F.greatest(F.lit(-edge), F.least(F.lit(edge), F.floor(v.cast("double") * scale).cast("double"))).cast("long"))
    one = some.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.struct(whole.alias("vec"), "label")).alias("row"))
    return one.select("vec_id", "row.label", "row.vec")


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(groups, 256, anchors): the sums of all subsets of each eight components of each anchor (a row)."""
    n, dim = anchors.shape
    groups = -(-dim // GROUP)
    padded = np.zeros((n, groups * GROUP), np.int64)
    padded[:, :dim] = anchors
    parts = padded.reshape(n, groups, GROUP).transpose(1, 2, 0)
    out = np.zeros((groups, 256, n), np.int64)
    for bit in range(GROUP):
        out[:, 1 << bit : 2 << bit] = out[:, : 1 << bit] + parts[:, bit, None]
    return out


def bit_planes(x: np.ndarray) -> np.ndarray:
    """(planes, groups, rows): bytes of the components' bits, the lowest plane first, the last one the sign."""
    n, dim = x.shape
    most = int(np.maximum(x, ~x).max(initial=0))  # of -2**k too, k bits are enough
    groups = -(-dim // GROUP)
    out = np.zeros((most.bit_length() + 1, groups, n), np.uint8)
    padded = np.zeros((n, groups * GROUP), np.int64)
    padded[:, :dim] = x
    for k in range(len(out)):
        bits = ((padded >> k) & 1).astype(np.uint8).reshape(n, groups, GROUP)
        out[k] = np.packbits(bits, 2, "little")[:, :, 0].T
    return out


def scores(sums: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """(rows, anchors) of exact scores, from the anchors' tables and the rows' planes."""
    total = np.zeros((planes.shape[2], sums.shape[2]), sums.dtype)
    part = np.empty_like(total)
    for k in range(len(planes) - 1, -1, -1):
        total <<= 1
        for group, byte in zip(sums, planes[k]):
            np.take(group, byte, axis=0, out=part, mode="clip")
            (np.subtract if k == len(planes) - 1 else np.add)(total, part, out=total)
    return total


def _narrow(sums: np.ndarray, planes: int) -> np.ndarray:
    """The tables in 32 bits where no score can go beyond them."""
    most = int(np.abs(sums).max(1).sum(0).max(initial=0)) if sums.size and abs(int(sums.min())) < 1 << 40 and int(sums.max()) < 1 << 40 else 1 << 62
    return sums.astype(np.int32) if most << planes < 1 << 31 else sums


def _best(score: np.ndarray, most: int) -> np.ndarray:
    """Positions of the `most` highest scores, highest first, ties in their order."""
    at = np.arange(len(score))
    if len(score) > most:
        edge = np.partition(score, len(score) - most)[len(score) - most]
        over = np.flatnonzero(score > edge)
        at = np.concatenate([over, np.flatnonzero(score == edge)[: most - len(over)]])
        at.sort()
    return at[np.argsort(-score[at], kind="stable")]


class _Kept:
    """The best rows of each key so far, as their scores and ids."""

    def __init__(self, most: int):
        self.most, self.held = most, {}

    def add(self, key: tuple, score: np.ndarray, ids: np.ndarray) -> None:
        """Rows in the order of their ids, all of them larger than those before."""
        if key in self.held:
            score, ids = np.concatenate([self.held[key][0], score]), np.concatenate([self.held[key][1], ids])
        at = _best(score, self.most)
        self.held[key] = score[at], ids[at]

    def floor(self, key: tuple) -> int:
        """What a later row's score must exceed."""
        held = self.held.get(key)
        return -(1 << 63) if held is None or len(held[0]) < self.most else int(held[0][-1])


def _positives(kept: _Kept, a_ids: np.ndarray, a_labels: np.ndarray, ids: np.ndarray, labels: np.ndarray, score: np.ndarray) -> None:
    for j in range(len(a_ids)):
        ok = (labels == a_labels[j]) & (ids != a_ids[j])
        ok &= score[:, j] > kept.floor((j,))
        if ok.any():
            kept.add((j,), score[ok, j].astype(np.int64), ids[ok])


def _bounds(score: int, low: int, high: int) -> tuple[int, int]:
    """The least and greatest negative score of a positive's."""
    return -(-low * score // 100), high * score // 100


def _negatives(kept: _Kept, asked: list[list[tuple[int, int, int]]], a_labels: np.ndarray, ids: np.ndarray, labels: np.ndarray, score: np.ndarray) -> None:
    """asked: for each anchor, its positives' number, least and greatest negative score."""
    for j, positives in enumerate(asked):
        open_ = [(p, max(low, kept.floor((j, p)) + 1), high) for p, low, high in positives]
        open_ = [x for x in open_ if x[1] <= x[2]]
        if not open_:
            continue
        s = score[:, j]
        at = np.flatnonzero((s >= min(x[1] for x in open_)) & (s <= max(x[2] for x in open_)) & (labels != a_labels[j]))
        for p, low, high in open_:
            one = at[(s[at] >= low) & (s[at] <= high)]
            if len(one):
                kept.add((j, p), s[one].astype(np.int64), ids[one])


_BLOCK = "dim int, block int, ids binary, labels binary, planes int, packed binary"
_FOUND = "anchor_id long, positive_id long, vec_id long, score long"


def _packed(t: pa.Table, planes: bool) -> pa.Table:
    """One block, in the order of ids: its numbers, or its bit planes, as bytes."""
    t = t.combine_chunks().sort_by("vec_id")
    dim = t["dim"][0].as_py()
    x = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(t.num_rows, dim)
    made = bit_planes(x) if planes else x
    row = [dim, t["block"][0].as_py(), t["vec_id"].to_numpy().astype("<i8").tobytes(), t["label"].to_numpy().astype("<i8").tobytes(), len(made) if planes else 0, made.tobytes()]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.binary()]
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["dim", "block", "ids", "labels", "planes", "packed"])


def blocked(rows: DataFrame, most: int, values: int, least: int, name: str, planes: bool) -> DataFrame:
    """Rows as blocks of `most` rows or `values` numbers on average, written; no fewer than `least` blocks of each length."""
    sizes = rows.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"))
    each = F.greatest(F.lit(16), F.least(F.lit(most), F.floor(values / F.greatest(F.lit(1), F.col("dim")))))
    sizes = sizes.select("dim", F.greatest(F.lit(least), F.ceil(F.col("n") / each)).alias("blocks"))
    dealt = rows.withColumn("dim", F.size("vec")).join(sizes, "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int"))
    made = dealt.select("dim", "block", "vec_id", "label", "vec").groupBy("dim", "block").applyInArrow(lambda t: _packed(t, planes), _BLOCK)
    return common.written(made, name)


def _tiles(anchors: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every pair of an anchors' block and a candidates' block of the same length, as a row."""
    def numbers(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("dim").agg(F.max("block").alias(name))

    a = anchors.join(numbers(candidates, "last"), "dim").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    c = candidates.join(numbers(anchors, "last"), "dim").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    a = a.select("dim", F.col("block").alias("a"), F.col("other").alias("c"), *[F.col(x).alias(f"a_{x}") for x in a.columns if x not in ("dim", "block", "other")])
    c = c.select("dim", F.col("other").alias("a"), F.col("block").alias("c"), "ids", "labels", "planes", "packed")
    return a.hint("shuffle_hash").join(c, ["dim", "a", "c"])


def _scored(anchors: DataFrame, candidates: DataFrame, most: int, span: tuple[int, int] | None) -> DataFrame:
    """The best of each tile: positives, or, with span, the negatives of every row of a_positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in b.schema.names}
                dim, long = row["dim"].as_py(), lambda c: np.frombuffer(row[c].as_py(), "<i8")  # noqa: B023
                a_ids, a_labels, ids, labels = long("a_ids"), long("a_labels"), long("ids"), long("labels")
                planes = np.frombuffer(row["packed"].as_py(), np.uint8).reshape(row["planes"].as_py(), -1, len(ids))
                sums = _narrow(subset_sums(long("a_packed").reshape(len(a_ids), dim)), len(planes))
                kept = _Kept(most)
                if span:
                    place, asked, named = {a: j for j, a in enumerate(a_ids.tolist())}, [[] for _ in a_ids], {}
                    for p in row["a_positives"].as_py() or ():
                        j = place[p["anchor_id"]]
                        named[j, p["vec_id"]] = p["vec_id"]
                        asked[j].append((p["vec_id"], *_bounds(p["score"], *span)))
                for s in range(0, len(ids), AT_ONCE):
                    cut = slice(s, s + AT_ONCE)
                    score = scores(sums, planes[:, :, cut])
                    if span:
                        _negatives(kept, asked, a_labels, ids[cut], labels[cut], score)
                    else:
                        _positives(kept, a_ids, a_labels, ids[cut], labels[cut], score)
                keys = [k for k, (v, _) in kept.held.items() for _ in v]
                if keys:
                    held = kept.held.values()
                    made = [pa.array([int(a_ids[k[0]]) for k in keys], pa.int64()), pa.array([k[1] if span else None for k in keys], pa.int64())]
                    made += [pa.array(np.concatenate([i for _, i in held]), pa.int64()), pa.array(np.concatenate([v for v, _ in held]), pa.int64())]
                    yield pa.RecordBatch.from_arrays(made, ["anchor_id", "positive_id", "vec_id", "score"])

    return _tiles(anchors, candidates).mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, most: int, *key: str) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(F.desc("score"), "vec_id")  # a few rows of each tile
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def mine(rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, span: tuple[int, int] = RANGE) -> DataFrame:
    """rows: as prepared() gives them. anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = common.written(rows, "whole-vectors")
    cores = rows.sparkSession.sparkContext.defaultParallelism
    candidates = blocked(rows, CANDIDATES, CANDIDATE_VALUES, cores, "candidate-planes", True)
    anchors = blocked(rows.filter(is_anchor), ANCHORS, ANCHOR_VALUES, 1, "anchors", False)
    near = common.written(_ranked(_scored(anchors, candidates, positives, None), positives, "anchor_id").select("anchor_id", "vec_id", "score"), "positives")
    blocks = rows.sparkSession.read.schema("dim int, block int, ids binary").parquet(anchors._scratch)
    where = blocks.mapInArrow(_listed, "block int, dim int, anchor_id long")
    asked = near.join(where, "anchor_id").groupBy("dim", "block").agg(F.collect_list(F.struct("anchor_id", "vec_id", "score")).alias("positives"))  # a block's anchors times `positives`
    found = _ranked(_scored(anchors.join(asked, ["dim", "block"]), candidates, negatives, span), negatives, "anchor_id", "positive_id")
    out = found.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"})
    out = out.join(near.select("anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["anchor_id", "positive_id"])
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each anchor of a block."""
    for b in batches:
        for dim, block, ids in zip(b.column("dim").to_pylist(), b.column("block").to_pylist(), b.column("ids")):
            of = np.frombuffer(ids.as_py(), "<i8")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), block, np.int32)), pa.array(np.full(len(of), dim, np.int32)), pa.array(of, pa.int64())], ["block", "dim", "anchor_id"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: hard negatives of every hundredth vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(prepared(common.table(spark, sf_dir, "embeddings"), label), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_inner_product(a.vec, c.vec)::BIGINT AS score
  FROM v a JOIN v c ON a.vec_id % 100 = 0 AND a.vec_id <> c.vec_id),
p AS (
  SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score,
                        row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same)
  WHERE r <= 5),
n AS (
  SELECT p.anchor_id, positive_id, positive_score, s.vec_id AS negative_id, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
"""
