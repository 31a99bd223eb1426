"""Operator 9: similarity join on word shingles with rare-first prefixes.

A document is the set of its distinct five-word shingles (64-bit hashes). Two documents link when
their sets' Jaccard similarity reaches the threshold. Steps:

1. One pass over the texts gives each document's set id and size, and counts all shingles in a
   table of fixed size. Equal sets are one class from here on.
2. A second pass orders each set rare-first (by that count, then by hash) and deals out its prefix:
   as many shingles as two linked sets cannot both miss. Each task sends a class once.
3. A prefix shingle's classes are its posting. Of a posting of at most LONG classes, all pairs are
   candidates that pass the length and positional filters. Of longer postings, the classes stay that
   these filters leave a partner at all, by the sizes and positions that the posting has; if they are few
   now, they are paired as above. Else those that such postings join, directly or not, are one crowd.
4. Candidate pairs, and pairs of blocks of a crowd, meet with their sets in tasks. Single pairs go
   through a suffix filter (histograms) and are verified by intersection. All pairs of two blocks
   are verified at once, by adding up shared shingles in a matrix. No pair is verified twice.
5. Components are those of all links; a crowd's links inside two blocks are sent on as a spanning
   forest and as numbers of links. link() gives the membership of every row with its class's number
   of links, pairs() every link between two classes.

A class is known by 128 bits; candidates carry 64 of them, and are told apart when they are verified.

Defined results: null or blank text has no shingles, is its own component and links with nothing;
fewer than five words are one shingle; repeated rows are all kept; a component's id is its smallest
doc_id (null doc_ids are smallest only among themselves); other columns of the input play no part.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common
from strandline.llm.components import components
from strandline.llm.shingles import mix, shingle_sets

#: Cells of the count table: 2**SKETCH_BITS, each one byte when it is sent to the tasks, whatever the
#: input's size. A cell holds eight times the logarithm (base 2) of its count plus one.
SKETCH_BITS = 24
SLICES = 64
#: Bits of the table that says which texts to hash again: 2**FILTER_BITS, whatever the input's size.
FILTER_BITS = 26
#: As many rows that say where a set is wanted are broadcast at most; beyond that the bit table is.
BROADCAST_KEYS = 500_000
#: Bins of the suffix filter's histograms.
BINS = 128
#: Classes of a block of single pairs, and of a crowd's block; shingles of a crowd's block, about.
BLOCK, CROWD_BLOCK, CROWD_SHINGLES = 128, 512, 1_000_000
#: Postings of a bucket's task, about. Shingles with more are dealt over several buckets.
POSTINGS_EACH = 1_000_000
#: Classes of a posting up to which its pairs are candidates by themselves.
LONG = 32

_POSTING = np.dtype([("h", "<u4"), ("sid", "<i8"), ("n", "<u4"), ("pos", "<u4"), ("salt", "<u2")])
#: kind 0: a link of a and b; 1: a and b are connected; 2: a has `shared` links.
_FOUND = "kind int, a binary, b binary, shared long, united long"


def _needed(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with which sets of sizes n and m link."""
    return -(-(percent * (n + m)) // (100 + percent))


def _set_id(s: np.ndarray) -> bytes:
    """128 bits of a set; the first 64 go with candidates."""
    if not len(s):
        return bytes(16)
    mixed = mix(s)
    return mix(np.array([s.sum(dtype=np.uint64) + np.bitwise_xor.reduce(mixed), mixed.sum(dtype=np.uint64) ^ np.uint64(len(s))], np.uint64)).astype("<u8").tobytes()


def _short(ids: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(i[:8] for i in ids), "<i8")


def survey(docs: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, key, sid, id, n) of every row, written, and the levels of the counts of all shingles."""
    shift, each = np.uint64(64 - SKETCH_BITS), (1 << SKETCH_BITS) // SLICES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held = np.zeros(1 << SKETCH_BITS, np.uint16), False
        for b in batches:
            ids, sizes, cells, size = [], [], [], 0

            def add() -> None:
                at, n = np.unique(np.concatenate(cells), return_counts=True)
                counts[at] = np.minimum(counts[at] + n, 65_535)

            for s in shingle_sets(b.column("text")):
                ids.append(_set_id(s))
                sizes.append(len(s))
                cells.append((s >> shift).astype(np.uint32))
                size += len(s)
                if size >= 250_000:
                    add()
                    cells, size = [], 0
            if cells:
                add()
            held, none = True, len(ids)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("key"), pa.array(_short(ids), pa.int64()), pa.array(ids, pa.binary()), pa.array(sizes, pa.int32()), pa.nulls(none, pa.int32()), pa.nulls(none, pa.binary())], names)
        if held:
            parts = [zlib.compress(p.tobytes(), 1) for p in counts.reshape(SLICES, each) if p.any()]
            full = np.flatnonzero(counts.reshape(SLICES, each).any(1))
            k = len(full)
            yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.int32()), pa.array(full, pa.int32()), pa.array(parts, pa.binary())], names)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, p in zip(b.column("slice").to_pylist(), b.column("counts")):
                part = np.frombuffer(zlib.decompress(p.as_py()), np.uint16)
                if k in sums:
                    sums[k] += part
                else:
                    sums[k] = part.astype(np.int64)
        if sums:
            level = [np.minimum(255, 8 * np.log2(1.0 + v)).astype(np.uint8).tobytes() for v in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(level, pa.binary())], ["slice", "counts"])

    names = ["doc_id", "key", "sid", "id", "n", "slice", "counts"]
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), "text")
    both = common.written(rows.mapInArrow(run, "doc_id long, key long, sid long, id binary, n int, slice int, counts binary"), "shingle-survey")
    sums = both.filter("slice is not null").select("slice", "counts").repartition(SLICES, "slice").mapInArrow(total, "slice int, counts binary")
    counts = np.zeros((SLICES, each), np.uint8)
    for row in sums.toLocalIterator():  # SLICES rows, of a fixed size together
        counts[row["slice"]] = np.frombuffer(row["counts"], np.uint8)
    members = both.filter("slice is null").select("doc_id", "key", "sid", "id", "n")
    members._scratch = both._scratch
    return members, counts.ravel()


def _short_pairs(p: np.ndarray, starts: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Distinct candidate pairs (rows of two sids, the smaller first) of postings of equal token in p."""
    codes = []
    names, own = np.unique(p["sid"], return_inverse=True)
    for m in np.unique(sizes).tolist():
        rows = starts[sizes == m][:, None] + np.arange(m)[None]
        i, j = np.triu_indices(m, 1)
        for k in range(0, len(rows), max(1, 2_000_000 // len(i))):
            x, y = rows[k : k + max(1, 2_000_000 // len(i))][:, i].ravel(), rows[k : k + max(1, 2_000_000 // len(i))][:, j].ravel()
            n, o, s, t = (p[f][q].astype(np.int64) for f in ("n", "pos") for q in (x, y))
            ok = (100 * np.minimum(n, o) >= percent * np.maximum(n, o)) & (np.minimum(n - s, o - t) >= _needed(n, o, percent))
            a, b = own[x[ok]], own[y[ok]]
            codes.append(np.unique(np.minimum(a, b).astype(np.int64) * len(names) + np.maximum(a, b)))
    code = np.unique(np.concatenate(codes)) if codes else np.empty(0, np.int64)
    return np.stack([names[code // len(names)], names[code % len(names)]], 1) if len(code) else np.empty((0, 2), np.int64)


def _least_needed(n: np.ndarray, first: np.ndarray, many: np.ndarray, percent: int) -> np.ndarray:
    """Of a posting's distinct sizes n, with their first positions and whether there are several of one:
    the smallest intersection with which a set of each size can link with one of the posting that the
    length and positional filters leave it. A set with less behind its position has no partner here."""
    out = np.full(len(n), 1 << 40, np.int64)
    for s in range(0, len(n), 256):
        x = n[s : s + 256, None]
        need = _needed(x, n[None], percent)
        ok = (100 * np.minimum(x, n) >= percent * np.maximum(x, n)) & (n - first >= need)
        own = np.arange(len(x))
        ok[own, s + own] &= many[s : s + 256]
        out[s : s + 256] = np.where(ok, need, 1 << 40).min(1)
    return out


def _partnered(p: np.ndarray, starts: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which rows of p have a partner in their posting, for the postings given; all others count as such."""
    out = np.ones(len(p), bool)
    for a, m in zip(starts.tolist(), sizes.tolist()):
        n, of, count = np.unique(p["n"][a : a + m].astype(np.int64), return_inverse=True, return_counts=True)
        pos = p["pos"][a : a + m].astype(np.int64)
        first = np.full(len(n), 1 << 40, np.int64)
        np.minimum.at(first, of, pos)
        out[a : a + m] = n[of] - pos >= _least_needed(n, first, count > 1, percent)[of]
    return out


def _postings(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal tokens begin in p, and their lengths."""
    starts = np.flatnonzero(np.append(True, p["h"][1:] != p["h"][:-1])) if len(p) else np.empty(0, np.int64)
    return starts, np.diff(np.append(starts, len(p)))


def candidates(docs: DataFrame, counts: np.ndarray, buckets: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Candidate pairs (a, b) of short postings, and the rows (token, sid, n, pos) of long ones; both of one
    written table. Classes that the filters leave no partner in a posting are not in it; those of postings that
    are dealt over several buckets have their pos still, and are filtered by crowds()."""
    spark = docs.sparkSession
    shared, shift = spark.sparkContext.broadcast(counts), np.uint64(64 - SKETCH_BITS)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, sent, held, size = shared.value, set(), [], 0

        def flush() -> pa.RecordBatch:
            every = np.concatenate(held)
            every = every[np.argsort(every["b"], kind="stable")]
            at = np.searchsorted(every["b"], np.arange(buckets + 1))
            out = np.empty(len(every), _POSTING)
            for f in _POSTING.names:
                out[f] = every[f]
            full = np.flatnonzero(np.diff(at))
            return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array([out[at[k] : at[k + 1]].tobytes() for k in full], pa.binary())], ["bucket", "data"])

        for b in batches:
            for s in shingle_sets(b.column("text")):
                n = len(s)
                if not n:
                    continue
                sid = int(_short([_set_id(s)])[0])
                if sid in sent:  # this task has sent the class already
                    continue
                if len(sent) >= 250_000:
                    sent.clear()
                sent.add(sid)
                length = n - -(-percent * n // 100) + 1
                level = count[s >> shift]
                order = np.argsort(level, kind="stable")[:length]
                p = np.empty(length, [("b", "<i4"), *_POSTING.descr])
                h, level = mix(s[order]), level[order]
                p["h"], p["sid"], p["n"], p["pos"] = h & np.uint64(0xFFFFFFFF), sid, n, np.arange(length)
                spread = np.clip(2.0 ** (level / 8.0) * 8 // POSTINGS_EACH, 1, 65_000).astype(np.uint64)  # buckets of a hot shingle
                salt = np.where(spread > 1, np.uint64(1) + np.uint64(sid & 0xFFFFFFFF) % spread, np.uint64(0))
                p["salt"], p["b"] = salt, ((h >> np.uint64(32)) + salt) % np.uint64(buckets)
                held.append(p)
                size += length
                if size >= 400_000:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for b in batches:
            for k, d in zip(b.column("bucket").to_pylist(), b.column("data")):
                if k != now and parts:
                    yield from meet(now, parts)
                    parts = []
                now = k
                parts.append(np.frombuffer(d.as_buffer(), _POSTING))
        if parts:
            yield from meet(now, parts)

    def meet(bucket: int, parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        p = np.concatenate(parts)
        p = p[np.lexsort((p["sid"], p["h"]))]
        new = np.ones(len(p), bool)
        new[1:] = (p["h"][1:] != p["h"][:-1]) | (p["sid"][1:] != p["sid"][:-1])
        p = p[new]  # a class once, whatever the number of tasks that sent it
        starts, sizes = _postings(p)
        whole = (sizes > LONG) & (np.maximum.reduceat(p["salt"], starts) == 0)
        p = p[_partnered(p, starts[whole], sizes[whole], percent)]
        if not len(p):
            return
        starts, sizes = _postings(p)
        hot = np.maximum.reduceat(p["salt"], starts) > 0
        short = (sizes > 1) & (sizes <= LONG) & ~hot
        pairs = _short_pairs(p, starts[short], sizes[short], percent)
        for k in range(0, len(pairs), 200_000):
            a, b = pairs[k : k + 200_000].T
            yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b), pa.nulls(len(a), pa.int32()), pa.nulls(len(a), pa.int32())], names)
        rows = np.flatnonzero(np.repeat((sizes > LONG) | hot, sizes))
        for k in range(0, len(rows), 200_000):
            q = p[rows[k : k + 200_000]]
            yield pa.RecordBatch.from_arrays([pa.array(((bucket - q["salt"].astype(np.int64)) % buckets << 32) | q["h"].astype(np.int64)), pa.array(q["sid"].astype(np.int64)), pa.nulls(len(q), pa.int64()), pa.array(q["n"].astype(np.int32)), pa.array(q["pos"].astype(np.int32), mask=q["salt"] == 0)], names)

    names = ["token", "a", "b", "n", "pos"]
    dealt = docs.select("text").mapInArrow(deal, "bucket int, data binary")
    both = common.written(dealt.repartition(max(8, buckets // 8), "bucket").sortWithinPartitions("bucket").mapInArrow(gather, "token long, a long, b long, n int, pos int"), "postings")
    shared.destroy()
    pairs, rows = both.filter("b is not null").select("a", "b").distinct(), both.filter("token is not null").select("token", F.col("a").alias("sid"), "n", "pos")
    pairs._scratch = both._scratch
    return pairs, rows


def _filtered(rows: DataFrame, percent: int) -> DataFrame:
    """rows without the classes that have no partner in a posting of several buckets (pos is not null): each
    such token has a row for each size, with its first position, and these tell what a size needs."""

    def least(t: pa.Table) -> pa.Table:
        n, first = t["n"].to_numpy().astype(np.int64), t["first"].to_numpy().astype(np.int64)
        return pa.table({"token": t["token"], "n": t["n"], "need": pa.array(_least_needed(n, first, t["many"].to_numpy(), percent))})

    hot = rows.filter("pos is not null").groupBy("token", "n").agg(F.min("pos").alias("first"), (F.count("*") > 1).alias("many"))
    need = hot.groupBy("token").applyInArrow(least, "token long, n int, need long")  # no more rows than sizes
    kept = rows.filter("pos is not null").join(need, ["token", "n"]).filter("n - pos >= need")
    return rows.filter("pos is null").select("token", "sid", "n").union(kept.select("token", "sid", "n"))


def crowds(rows: DataFrame, percent: int) -> DataFrame:
    """sid, crowd, block, blocks of the classes of long postings; written."""
    rows = _filtered(rows, percent)
    token = F.concat(F.lit("t"), F.col("token").cast("string"))
    edges = rows.select(token.alias("a"), F.col("sid").cast("string").alias("b"))
    found = components(edges).filter("node not like 't%'").select(F.col("node").cast("long").alias("sid"), F.col("component").alias("crowd"))
    sized = found.join(rows.groupBy("sid").agg(F.max("n").alias("n")), "sid")
    blocks = F.ceil(F.greatest(F.count("*") / CROWD_BLOCK, F.sum("n") / CROWD_SHINGLES)).cast("int")
    sized = sized.join(sized.groupBy("crowd").agg(blocks.alias("blocks")), "crowd")
    return common.written(sized.select("sid", "crowd", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int").alias("block"), "blocks"), "crowds")


def _filter_bits(keys: DataFrame) -> np.ndarray:
    """A bit for each hash cell that a key (column key) falls into: 2**FILTER_BITS bits."""
    width = 1 << (FILTER_BITS - 6)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits: dict[int, np.ndarray] = {}
        for b in batches:
            cell = b.column("cell").to_numpy()
            for k in np.unique(cell // width).tolist():
                bits.setdefault(k, np.zeros(width, bool))[cell[cell // width == k] % width] = True
        if bits:
            yield pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int64()), pa.array([np.packbits(v).tobytes() for v in bits.values()], pa.binary())], ["slice", "bits"])

    cells = keys.select(F.pmod(F.xxhash64("key"), F.lit(1 << FILTER_BITS)).alias("cell")).withColumn("slice", F.floor(F.col("cell") / width))
    out = np.zeros((64, width // 8), np.uint8)
    for row in cells.repartition(64, "slice").select("cell").mapInArrow(mark, "slice long, bits binary").collect():
        out[row["slice"]] |= np.frombuffer(row["bits"], np.uint8)
    return out.ravel()


def sets_for(docs: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """The sets of the classes in wanted (met, sid, side), with the columns id and hashes (ascending, 64 bits each).

    A class's set is hashed again from one of its texts, where that is read. Up to BROADCAST_KEYS rows
    of wanted are sent out to the texts; beyond, a bit table of fixed size chooses these, and the sets
    are joined. No set is left out by either way.
    """
    spark = docs.sparkSession
    keys = members.join(wanted.select("sid").distinct(), "sid", "left_semi").groupBy("id").agg(F.first("sid").alias("sid"), F.min("key").alias("key"))
    keys = common.written(keys.select("sid", "key"), "keys")
    texts = docs.select(F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"), "text")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[bytes] = set()
        for b in batches:
            if bits is not None:
                cell = b.column("cell").to_numpy()
                b = b.filter(pa.array((bits.value[cell >> 3] >> (7 - (cell & 7))) & 1 == 1))
            for k in range(0, b.num_rows, 500):
                part = b.slice(k, 500)
                out = []
                for s, to in zip(shingle_sets(part.column("text")), part.column("to").to_pylist() if bits is None else [None] * 500):
                    if len(s) and (name := _set_id(s)) not in sent:
                        if len(sent) < 250_000:
                            sent.add(name)
                        sid, data = int(_short([name])[0]), s.astype("<u8").tobytes()
                        out += [(t["met"], sid, t["side"], name, data) for t in to if t["sid"] == sid] if to is not None else [(None, sid, None, name, data)]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["met", "sid", "side", "id", "hashes"])

    made = "met long, sid long, side int, id binary, hashes binary"
    if wanted.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        bits = None
        to = wanted.join(keys, "sid").groupBy("key").agg(F.collect_list(F.struct("met", "sid", "side")).alias("to"))  # a class's blocks
        return texts.join(F.broadcast(to), "key").select("text", "to").mapInArrow(hashed, made)
    bits = spark.sparkContext.broadcast(_filter_bits(keys))
    cell = F.pmod(F.xxhash64("key"), F.lit(1 << FILTER_BITS)).alias("cell")
    return wanted.join(texts.select(cell, "text").mapInArrow(hashed, made).select("sid", "id", "hashes"), "sid")


def _placed(pairs: DataFrame) -> DataFrame:
    """Distinct pairs (a, b) with the block pair (met) in which they meet; written.

    Classes with a common partner are put into blocks of about BLOCK, and pairs into pairs of blocks:
    a set goes out once for each pair of blocks, not for each pair of classes, and a task holds the
    sets of two blocks at a time.
    """
    low = F.least("a", "b").alias("low")
    ends = pairs.select(F.col("a").alias("sid"), low).union(pairs.select(F.col("b").alias("sid"), low)).groupBy("sid").agg(F.min("low").alias("low"))
    sizes = ends.groupBy("low").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    block = ends.join(sizes, "low").select("sid", F.xxhash64("low", F.pmod(F.xxhash64("sid"), F.col("blocks"))).alias("block"))
    block = common.written(block, "blocks")
    placed = pairs.join(block.select(F.col("sid").alias("a"), F.col("block").alias("x")), "a").join(block.select(F.col("sid").alias("b"), F.col("block").alias("y")), "b")
    placed = common.written(placed.select("a", "b", F.xxhash64(F.least("x", "y"), F.greatest("x", "y")).alias("met")), "placed")
    common.drop_written(block)
    return placed


def intersections(x: list[np.ndarray], y: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of the sets x with the sets y (None: with one another)."""
    every = x if y is None else x + y
    m, first = len(every), len(x)
    tokens, owner = np.concatenate(every), np.repeat(np.arange(m), [len(s) for s in every])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1])) if len(tokens) else np.empty(0, np.int64)
    sizes = np.diff(np.append(starts, len(tokens)))
    out = np.zeros(m * m, np.int64)
    for k in range(2, 9):  # of a few sets: pair by pair
        rows = owner[starts[sizes == k][:, None] + np.arange(k)[None]]
        for i, j in zip(*np.triu_indices(k, 1)):
            out += np.bincount(rows[:, i] * m + rows[:, j], minlength=m * m) if len(rows) > m * m // 16 else 0
            if len(rows) <= m * m // 16:
                np.add.at(out, rows[:, i] * m + rows[:, j], 1)
    out = out.reshape(m, m)
    out = out + out.T
    many = np.flatnonzero(sizes > 8)
    for k in range(0, len(many), 2048):
        some = many[k : k + 2048]
        at = np.concatenate([np.arange(starts[t], starts[t] + sizes[t]) for t in some.tolist()])
        grid = np.zeros((m, len(some)), np.float32)
        grid[owner[at], np.repeat(np.arange(len(some)), sizes[some])] = 1
        out += (grid @ grid.T).astype(np.int64)
    np.fill_diagonal(out, [len(s) for s in every])
    return out if y is None else out[:first, first:]


def _forest(linked: np.ndarray) -> np.ndarray:
    """For each node of a symmetric matrix the smallest node of its component."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None], len(label)).min(1, initial=len(label)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def verified(pairs: DataFrame, crowd: DataFrame, docs: DataFrame, members: DataFrame, percent: int, every: bool) -> DataFrame:
    """Of candidate pairs and all pairs of a crowd, what links: _FOUND; written.

    A crowd's links come as counts and a spanning forest for each pair of blocks; with `every`, one by one.
    """
    spark = docs.sparkSession
    of = lambda c: crowd.select(F.col("sid").alias(c), F.col("crowd").alias(f"crowd_{c}"))
    alone = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left").filter("crowd_a is null or crowd_b is null or crowd_a <> crowd_b").select("a", "b")
    alone = common.written(alone, "pairs")
    placed = _placed(alone)
    wanted = placed.select("met", F.col("a").alias("sid")).union(placed.select("met", F.col("b").alias("sid"))).distinct().withColumn("side", F.lit(-1))
    met = crowd.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select(F.xxhash64("crowd", F.least("block", "other"), F.greatest("block", "other")).alias("met"), "sid", (F.col("block") > F.col("other")).cast("int").alias("side"))
    wanted = common.written(wanted.union(met), "wanted")
    rows = sets_for(docs, members, wanted).select("met", F.lit(0).alias("kind"), "sid", F.lit(None).cast("long").alias("b"), "side", "id", "hashes")
    rows = rows.union(placed.select("met", F.lit(1), F.col("a"), F.col("b"), F.lit(None).cast("int"), F.lit(None).cast("binary"), F.lit(None).cast("binary")))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, sides, out = None, defaultdict(list), ({}, {}), []
        for r in batches:
            for met, kind, a, b, side, name, hashes in zip(*(r.column(c).to_pylist() for c in ("met", "kind", "sid", "b", "side", "id")), r.column("hashes")):
                if met != now:
                    yield from crowded(sides)
                    now, held, sides = met, defaultdict(list), ({}, {})
                if kind == 0:
                    x = np.frombuffer(hashes.as_py(), "<u8")
                    if side >= 0:
                        sides[side][name] = x
                    elif all(name != known for known, _, _ in held[a]):
                        held[a].append((name, x, np.bincount((mix(x) >> np.uint64(57)).astype(np.int64), minlength=BINS)))
                    continue
                for first, x, p in held[a]:
                    for second, y, q in held[b]:
                        need = _needed(len(x), len(y), percent)
                        if np.minimum(p, q).sum() < need:  # suffix filter
                            continue
                        both = np.concatenate([x, y])
                        both.sort()
                        shared = int(np.count_nonzero(both[1:] == both[:-1]))
                        if shared >= need:
                            out.append((0, min(first, second), max(first, second), shared, len(both) - shared))
            if len(out) >= 10_000:
                yield result(out)
                out = []
        yield from crowded(sides)
        if out:
            yield result(out)

    def crowded(sides: tuple[dict, dict]) -> Iterator[pa.RecordBatch]:
        """All pairs of two blocks, or of one."""
        if not sides[0]:
            return
        names = [list(s) for s in sides]
        x, y = (list(s.values()) for s in sides)
        one = not y
        shared = intersections(x, None if one else y)
        n, m = np.array([len(s) for s in x]), np.array([len(s) for s in (x if one else y)])
        linked = shared >= _needed(n[:, None], m[None], percent)
        if one:
            np.fill_diagonal(linked, False)
        if every:
            out = []
            for i, j in zip(*np.nonzero(np.triu(linked) if one else linked)):
                a, b = names[0][i], names[0 if one else 1][j]
                out.append((0, min(a, b), max(a, b), int(shared[i, j]), int(n[i] + m[j] - shared[i, j])))
        else:
            whole = linked if one else np.block([[np.zeros((len(n), len(n)), bool), linked], [linked.T, np.zeros((len(m), len(m)), bool)]])
            of = names[0] + names[1]
            out = [(2, of[k], None, int(c), None) for k, c in enumerate(whole.sum(1)) if c]
            out += [(1, of[low], of[k], None, None) for k, low in enumerate(_forest(whole).tolist()) if low != k]
        for k in range(0, len(out), 10_000):
            yield result(out[k : k + 10_000])

    def result(out: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], [c.split()[0] for c in _FOUND.split(", ")])

    parts = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(parts, "met").sortWithinPartitions("met", "kind")
    found = common.written(dealt.mapInArrow(check, _FOUND), "links")
    for used in (alone, placed, wanted):
        common.drop_written(used)
    return found


def _linked(docs: DataFrame, percent: int, every: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, sid, id, n) of every row, and what links: _FOUND; both written."""
    spark = docs.sparkSession
    members, counts = survey(docs)
    total = members.agg(F.sum("n")).first()[0] or 0
    buckets = 8 * common.partitions_for(spark, total * (100 - percent) / 100, POSTINGS_EACH)
    pairs, rows = candidates(docs, counts, buckets, percent)
    crowd = crowds(rows, percent)
    found = verified(pairs, crowd, docs, members, percent, every)
    common.drop_written(pairs)
    common.drop_written(crowd)
    return members, found


def pairs(docs: DataFrame, percent: int = 75) -> DataFrame:
    """All links between different sets: class_a < class_b (16 bytes), and the sizes of intersection and union."""
    return _linked(docs, percent, True)[1].select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), "shared", "united")


def link(docs: DataFrame, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles, class_id (equal for equal sets), component_id of every row of docs, and n_links,
    the number of other classes that its class links with (rows of one class all link with each other)."""
    members, found = _linked(docs, percent, False)
    whole = components(found.filter("kind < 2").select("a", "b"))

    one = F.lit(1).cast("long").alias("n")
    ends = found.filter("kind = 0").select(F.col("a").alias("id"), one).union(found.filter("kind = 0").select("b", one)).union(found.filter("kind = 2").select("a", "shared"))
    ends = ends.groupBy("id").agg(F.sum("n").alias("n_links"))
    some = whole.withColumnRenamed("node", "id").join(ends, "id", "left")
    lows = members.filter("n > 0").groupBy("id").agg(F.min("doc_id").alias("low")).join(some, "id", "left")
    lows = common.written(lows.select("id", F.coalesce("component", "id").alias("part"), "low", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links")), "classes")
    best = lows.groupBy("part").agg(F.min("low").alias("component_id"))
    of_class = lows.join(best, "part").select("id", "component_id", "n_links")
    found = members.filter("n > 0").join(of_class, "id").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.hex("id").alias("class_id"), "component_id", "n_links")
    blank = members.filter("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.lit(None).cast("string").alias("class_id"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    return found.union(blank)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document with its number of shingles, its class and number of links, and its component."""
    return link(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id", "n_links")
