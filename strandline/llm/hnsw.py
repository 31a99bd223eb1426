"""Operator 7: approximate nearest neighbours by a navigable small-world graph for each shard.

Distinct vectors go to the nearest of up to CELLS centres (k-means over a sample of at most SAMPLE
vectors and SAMPLE_VALUES numbers, the only sample here: every vector is indexed); a cell of more
vectors than a shard holds is dealt into several shards by a hash. One task builds a shard's graph:
vectors are inserted in batches, tallest first, and a new one's candidates are what a search of the
graph so far finds, and the nearest of its own batch; of them it links to up to M that are nearer to it
than to one another. Links run both ways and are thinned in the same way. Upper levels hold
geometrically fewer vectors: a level's are the first of the shard's. A shard's row holds its levels as
flat neighbour arrays.

Queries meet shards in blocks, in two rounds. The first visits the shards of a query's nearest cell; the
k-th distance found there then leaves out every cell whose ball (centre and greatest distance of its
vectors) lies beyond it, which loses nothing, and the second round visits the others. A visit is a
greedy descent, then a beam of EF at the lowest level, for all queries of the block in step. Results
are merged with exact distances in double precision.

Defined results: null vec_ids, and vectors that are null, empty, zero or hold null or non-finite
components, take no part; a repeated vec_id counts once, with the smallest of its vectors; equal
vectors are one node and come back as all their ids, smaller first; vectors of different lengths are
never compared; an empty table has no rows; further columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import common

SHARD_ROWS, SHARD_VALUES = 4096, 1 << 21
CELLS, SAMPLE, SAMPLE_VALUES = 1024, 20_000, 1 << 21
M, CANDIDATES, EF = 16, 48, 96
QUERY_BLOCK, INSERTED = 512, 2048

_INDEX = "dim int, cell int, part int, rows int, radius double, vectors binary, ids array<array<long>>, sizes array<int>, links array<binary>"


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def _best(at: np.ndarray, dist: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row, the `most` nearest in ascending order; -1 where the distance is infinite."""
    if dist.shape[1] > most:
        pick = np.argpartition(dist, most - 1, 1)[:, :most]
        at, dist = np.take_along_axis(at, pick, 1), np.take_along_axis(dist, pick, 1)
    order = np.argsort(dist, 1, kind="stable")
    at, dist = np.take_along_axis(at, order, 1), np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), at, -1), dist


def _thinned(x: np.ndarray, near: np.ndarray, dist: np.ndarray, keep: int) -> np.ndarray:
    """Of each row's candidates (ascending, -1 for none), those nearer to it than to one kept before.

    Places left are filled with the nearest of the others.
    """
    out = np.full((len(near), keep), -1, np.int32)
    for s in range(0, len(near), 512):
        c, d = near[s : s + 512], dist[s : s + 512]
        v = x[np.maximum(c, 0)]
        norm = (v * v).sum(2)
        among = norm[:, :, None] + norm[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
        chosen = np.zeros(c.shape, bool)
        blocked = np.full(c.shape, np.inf, x.dtype)
        for k in range(c.shape[1]):
            ok = (c[:, k] >= 0) & (d[:, k] < blocked[:, k]) & (chosen.sum(1) < keep)
            chosen[:, k] = ok
            blocked = np.where(ok[:, None], np.minimum(blocked, among[:, k]), blocked)
        order = np.argsort(np.where(chosen, 0, np.where(c >= 0, 1, 2)), 1, kind="stable")[:, :keep]
        out[s : s + 512, : order.shape[1]] = np.take_along_axis(c, order, 1)
    return out


def _descended(x: np.ndarray, sizes: list[int], links: list[np.ndarray], q: np.ndarray, down_to: int) -> np.ndarray:
    """The nearest node that greedy steps find for each query, through the levels above down_to."""
    now = np.zeros(len(q), np.int64)
    for level in range(len(sizes) - 1, down_to, -1):
        best, going = ((x[now] - q) ** 2).sum(1), np.arange(len(q))
        while len(going):
            c = links[level][now[going]]
            d = np.where(c >= 0, ((x[np.maximum(c, 0)] - q[going][:, None]) ** 2).sum(2), np.inf)
            j = d.argmin(1)
            low = d[np.arange(len(going)), j]
            better = low < best[going]
            going, j, low = going[better], j[better], low[better]
            now[going], best[going] = c[better, j], low
    return now


def _beam(x: np.ndarray, to: np.ndarray, n: int, start: np.ndarray, q: np.ndarray, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ef near nodes of each query among the first n, and their squared distances (unordered)."""
    ids, dist, done = np.full((len(q), ef), -1, np.int64), np.full((len(q), ef), np.inf, x.dtype), np.zeros((len(q), ef), bool)
    ids[:, 0], dist[:, 0] = start, ((x[start] - q) ** 2).sum(1)
    seen = np.zeros((len(q), n), bool)
    seen[np.arange(len(q)), start] = True
    going = np.arange(len(q))
    while True:
        open_ = np.where(done[going], np.inf, dist[going])
        j = open_.argmin(1)
        some = np.isfinite(open_[np.arange(len(going)), j])
        going, j = going[some], j[some]
        if not len(going):
            return ids, dist
        done[going, j] = True
        c = to[ids[going, j]].astype(np.int64)
        rows, cols = np.nonzero((c >= 0) & ~seen[going[:, None], np.maximum(c, 0)])
        seen[going[rows], c[rows, cols]] = True
        d = np.full(c.shape, np.inf, x.dtype)
        away = x[c[rows, cols]] - q[going[rows]]
        d[rows, cols] = np.einsum("ij,ij->i", away, away)
        every = np.concatenate([dist[going], d], 1)
        pick = np.argpartition(every, ef - 1, 1)[:, :ef]
        dist[going] = np.take_along_axis(every, pick, 1)
        ids[going] = np.take_along_axis(np.concatenate([ids[going], c], 1), pick, 1)
        done[going] = np.take_along_axis(np.concatenate([done[going], np.zeros(c.shape, bool)], 1), pick, 1)


def _linked_back(x: np.ndarray, to: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Gives nodes b links to a. Nodes with too many of them are thinned."""
    d = ((x[a] - x[b]) ** 2).sum(1)
    order = np.lexsort((d, b))
    a, b, d = a[order], b[order], d[order]
    node, first = np.unique(b, return_index=True)
    rank = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    use = rank < CANDIDATES
    row = np.searchsorted(node, b[use])
    most, width = to.shape[1], int(rank[use].max()) + 1
    near, dist = np.full((len(node), most + width), -1, np.int64), np.full((len(node), most + width), np.inf, x.dtype)
    near[:, :most] = to[node]
    for s in range(0, len(node), 1024):
        c = near[s : s + 1024, :most]
        dist[s : s + 1024, :most] = np.where(c >= 0, ((x[np.maximum(c, 0)] - x[node[s : s + 1024], None]) ** 2).sum(2), np.inf)
    near[row, most + rank[use]], dist[row, most + rank[use]] = a[use], d[use]
    near, dist = _best(near, dist, near.shape[1])
    full = near[:, most] >= 0
    to[node[~full]] = near[~full, :most]
    to[node[full]] = _thinned(x, near[full], dist[full], most)


def graph(x: np.ndarray) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """The order of nodes (tallest first), and of each level, from 0, its number of nodes and their links."""
    tall = np.floor(-np.log(np.random.default_rng(len(x)).random(len(x))) / np.log(M)).astype(int)
    order = np.argsort(-tall, kind="stable")
    x, tall = x[order], tall[order]
    sizes = [int((tall >= level).sum()) for level in range(tall.max() + 1)]
    links = [np.full((n, 2 * M if level == 0 else M), -1, np.int32) for level, n in enumerate(sizes)]
    for level in range(len(sizes) - 1, -1, -1):
        n, to, at = sizes[level], links[level], 0
        while at < n:
            end = min(n, at + max(M, min(at, INSERTED)))
            for s in range(at, end, QUERY_BLOCK):
                new = np.arange(s, min(end, s + QUERY_BLOCK))
                d = _distances(x[new], x[at : new[-1] + 1])  # those of its batch before it
                d[np.arange(at, new[-1] + 1)[None] >= new[:, None]] = np.inf
                near = np.broadcast_to(np.arange(at, new[-1] + 1), d.shape)
                if at:
                    start = _descended(x, sizes, links, x[new], level)
                    found, far = _beam(x, to, at, np.where(start < at, start, 0), x[new], CANDIDATES)
                    near, d = np.concatenate([found, near], 1), np.concatenate([far, d], 1)
                own = _thinned(x, *_best(near, d, CANDIDATES), M)
                to[new, :M] = own
            a, j = np.nonzero(to[at:end, :M] >= 0)
            if len(a):
                _linked_back(x, to, a + at, to[a + at, j].astype(np.int64))
            at = end
    return order, sizes, links


def search(x: np.ndarray, sizes: list[int], links: list[np.ndarray], q: np.ndarray, k: int) -> np.ndarray:
    """Positions of k near vectors for each query, -1 for none."""
    found = _beam(x, links[0], len(x), _descended(x, sizes, links, q, 0), q, max(EF, 2 * k))
    return _best(*found, k)[0]


def valid(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vec) of the rows that take part, one for each vec_id."""
    fit = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(vector, lambda v: v != 0)
    some = rows.filter(F.col("vec_id").isNotNull() & F.col(vector).isNotNull()).filter(fit)
    return some.groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min(F.transform(vector, lambda v: v + F.lit(0).cast("float"))).alias("vec"))


def shard_rows(dim: int) -> int:
    """Vectors of a cell on average; a cell of more than twice as many is several shards."""
    return max(256, min(SHARD_ROWS, SHARD_VALUES // dim))


def _centres(vectors: DataFrame) -> dict[int, np.ndarray]:
    """Centres of each length of vectors that the sample holds."""
    n, values = vectors.agg(F.count("*"), F.coalesce(F.sum(F.size("vec")), F.lit(0))).first()
    share = min(1.0, SAMPLE / max(n, 1), SAMPLE_VALUES / max(values, 1))
    drawn = vectors.filter(F.pmod(F.xxhash64("vec", F.lit(2)), F.lit(1 << 30)) < int(share * (1 << 30))).select("vec").toArrow()
    lengths = np.diff(drawn["vec"].combine_chunks().offsets.to_numpy()) if drawn.num_rows else np.zeros(0, int)
    out = {}
    for dim in np.unique(lengths):
        x = drawn.filter(pa.array(lengths == dim))["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(float)
        x = np.unique(x, axis=0)
        cells = int(min(CELLS, len(x), -(-len(x) // (share * shard_rows(dim)))))
        c = x[np.random.default_rng(0).permutation(len(x))[:cells]]
        for _ in range(10):
            of = _nearest_centre(x, c)[0]
            total = np.zeros_like(c)
            np.add.at(total, of, x)
            held = np.bincount(of, minlength=cells)
            c = np.where(held[:, None] > 0, total / np.maximum(held, 1)[:, None], c)
        out[int(dim)] = c
    return out


def _nearest_centre(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    of = np.concatenate([_distances(x[s : s + 1024], c).argmin(1) for s in range(0, len(x), 1024)])
    return of, np.sqrt(((x - c[of]) ** 2).sum(1))


def _by_length(t: pa.RecordBatch, name: str) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The vectors of a batch as matrices: length, rows, vectors."""
    lists = t.column(name)
    lengths = np.diff(lists.offsets.to_numpy())
    for dim in np.unique(lengths):
        at = np.flatnonzero(lengths == dim)
        yield int(dim), at, lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)


def build(vectors: DataFrame, k: int) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """The index: a row for each shard, written; and the centres. Of equal vectors, the k + 1 smallest ids are enough."""
    centres = _centres(vectors)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            cell, away = np.full(t.num_rows, -1, np.int32), np.zeros(t.num_rows)
            for dim, at, x in _by_length(t, "vec"):
                if dim in centres:  # else a length that the sample misses: one cell, which all its queries visit
                    cell[at], away[at] = _nearest_centre(x.astype(float), centres[dim])
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(cell), pa.array(away)], [*t.schema.names, "cell", "away"])

    first = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    few = vectors.withColumn("place", first).filter(F.col("place") <= k + 1)
    nodes = few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("dim", F.size("vec"))
    kind = nodes.schema["vec"].dataType.simpleString()
    celled = common.written(nodes.mapInArrow(assign, f"vec {kind}, ids array<long>, dim int, cell int, away double"), "cells")

    def one(t: pa.Table) -> pa.Table:
        t = t.combine_chunks().sort_by([("turn", "ascending"), ("first", "ascending")])
        dim, rows = t["dim"][0].as_py(), t.num_rows
        x = t["vec"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows, dim)
        order, sizes, links = graph(x)
        ids = t["ids"].combine_chunks().take(pa.array(order)).to_pylist()
        row = {"dim": dim, "cell": t["cell"][0].as_py(), "part": t["part"][0].as_py(), "rows": rows, "radius": max(t["away"].to_pylist())}
        row |= {"vectors": x[order].tobytes(), "ids": ids, "sizes": sizes, "links": [v.tobytes() for v in links]}
        types = [pa.int32()] * 4 + [pa.float64(), pa.binary(), pa.list_(pa.list_(pa.int64())), pa.list_(pa.int32()), pa.list_(pa.binary())]
        return pa.table({n: [v] for n, v in row.items()}, schema=pa.schema(list(zip(row, types))))

    size = 2 * F.greatest(F.lit(256), F.least(F.lit(SHARD_ROWS), F.floor(SHARD_VALUES / F.col("dim"))))
    parts = celled.groupBy("dim", "cell").agg(F.count("*").alias("n")).select("dim", "cell", F.ceil(F.col("n") / size).alias("parts"))
    turn = F.xxhash64("vec", F.lit(1))
    dealt = celled.join(parts, ["dim", "cell"]).select("vec", "ids", "dim", "cell", "away", F.pmod(F.xxhash64("vec"), "parts").cast("int").alias("part"), turn.alias("turn"), F.col("ids")[0].alias("first"))
    return common.written(dealt.groupBy("dim", "cell", "part").applyInArrow(one, _INDEX), "graph-index"), centres


def _visited(index: DataFrame, visits: DataFrame, k: int, real: str) -> DataFrame:
    """query_id, vec_id, score: the k nearest that each of a query's shards gives; visits: vec_id, vec, dim, cell."""

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                row = {c: b.column(c)[r] for c in b.schema.names}
                dim, n = row["dim"].as_py(), row["rows"].as_py()
                x = np.frombuffer(row["vectors"].as_py(), real).reshape(n, dim)
                sizes = row["sizes"].as_py()
                links = [np.frombuffer(v, np.int32).reshape(m, -1) for v, m in zip(row["links"].as_py(), sizes)]
                asked, ids, out = row["queries"].values, row["ids"].values, []
                q_ids = asked.field("vec_id").to_numpy()
                q = asked.field("vec").flatten().to_numpy(zero_copy_only=False).reshape(len(q_ids), dim)
                for s in range(0, len(q), QUERY_BLOCK):
                    for i, found in enumerate(search(x, sizes, links, q[s : s + QUERY_BLOCK], k + 1), s):
                        at = found[found >= 0]
                        score = np.sqrt(((x[at].astype(float) - q[i].astype(float)) ** 2).sum(1))
                        rows = sorted((s_, v) for s_, p in zip(score.tolist(), at.tolist()) for v in ids[p].as_py() if v != q_ids[i])[:k]
                        out += [(int(q_ids[i]), v, s_) for s_, v in rows]
                if out:
                    a, v, s = zip(*out)
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    blocks = visits.groupBy("dim", "cell").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("blocks"))
    packed = visits.join(blocks, ["dim", "cell"]).groupBy("dim", "cell", F.pmod(F.xxhash64("vec_id"), "blocks").alias("block"))
    packed = packed.agg(F.collect_list(F.struct("vec_id", "vec")).alias("queries"))  # about QUERY_BLOCK of them
    met = packed.join(index, ["dim", "cell"]).select("dim", "rows", "vectors", "ids", "sizes", "links", "queries")
    return met.mapInArrow(visit, "query_id long, vec_id long, score double")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(index: tuple[DataFrame, dict[int, np.ndarray]], queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each query (vec_id, vec), without itself."""
    shards, centres = index
    balls = shards.filter("cell >= 0").groupBy("dim", "cell").agg(F.max("radius").alias("radius")).collect()  # no more than centres
    held: dict[int, tuple] = {}
    for dim in centres:
        some = sorted((r["cell"], r["radius"]) for r in balls if r["dim"] == dim)
        if some:
            cells, radius = zip(*some)
            held[dim] = np.array(cells, np.int32), np.array(radius), centres[dim][list(cells)]
    kind = queries.schema["vec"].dataType.simpleString()
    real = "<f4" if "float" in kind else "<f8"

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A query's home; for queries with a limit, every other cell whose ball comes as near as that."""
        for t in batches:
            for dim, at, x in _by_length(t, "vec"):
                later = "limit" in t.schema.names
                if dim not in held:
                    row, cell = (at[:0], at[:0]) if later else (at, np.full(len(at), -1))
                else:
                    cells, radius, c = held[dim]
                    d = np.sqrt(_distances(x.astype(float), c))
                    home = d.argmin(1)
                    if later:
                        most = t.column("limit").to_numpy(zero_copy_only=False)[at]
                        near = d - radius <= most[:, None] + 1e-6 * (1 + d)
                        near[np.arange(len(at)), home] = False
                        r, j = np.nonzero(near)
                    else:
                        r, j = np.arange(len(at)), home
                    row, cell = at[r], cells[j]
                got = t.select(["vec_id", "vec"]).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*got.columns, pa.array(np.full(len(row), dim, np.int32)), pa.array(cell.astype(np.int32))], ["vec_id", "vec", "dim", "cell"])

    columns = f"vec_id long, vec {kind}, dim int, cell int"
    home = _visited(shards, queries.select("vec_id", "vec").mapInArrow(route, columns), k, real)
    near = common.written(_ranked(home, k), "home-cells")
    limits = near.groupBy(F.col("query_id").alias("vec_id")).agg(F.max("score").alias("limit"), F.count("*").alias("n"))
    limit = F.when(F.col("n") >= k, F.col("limit")).otherwise(float("inf")).alias("limit")
    others = queries.join(limits, "vec_id", "left").select("vec_id", "vec", limit).mapInArrow(route, columns)
    return _ranked(near.select("query_id", "vec_id", "score").unionByName(_visited(shards, others, k, real)), k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: the ten nearest of every hundredth vector."""
    rows = common.written(valid(common.table(spark, sf_dir, "embeddings")), "vectors")
    return nearest(build(rows, 10), rows.filter("vec_id % 100 = 0"), 10)
