"""Operator 10: scores of whole documents by a gated recurrent language model.

Words are counted over all training documents; the counts give the base score and the model's frequent
symbols. So that no row is needed for each word, tasks work in blocks of documents: a block numbers its
own words, and its list of words, with their counts, goes out by word hash into buckets. A bucket adds up
its words' counts over all blocks and sends each block the totals of that block's words. Words and
numbers travel as packed arrays.

The model's symbols are the most frequent words (head_size(), which grows with the tokens), the end, and
one for all other words. Its softmax is factored by classes of frequency; within the class of all other words a word has its share of the
base probability, so the model gives every token a probability, and these sum to one. It is trained by
truncated backpropagation, once over every token of every training document: all documents are written as
symbols, those for training dealt over rounds and tasks by a hash of the document; in a round each task goes
over its documents from the common weights, and the tasks' weights are averaged by tokens, in slices. So the
model depends on the documents, but not on files, partitions or cores. Scoring runs over every token of every document; the state is
carried across windows.

Defined results: null or blank text is just the end token; a null doc_id is hashed as an empty string;
repeated rows are all scored and counted; without training documents every score is the base score of
an empty vocabulary; further columns of the input play no part.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common, gru, sums

HEAD = 2046
#: Tokens of a training task at most on average: a longer training has as many tasks as that makes, in
#: ROUNDS rounds. Tokens that a task holds at once.
TASK_TOKENS = 12_000_000
ROUNDS = 6
ROUND_TOKENS = 2_000_000
BLOCK_TOKENS = 2_000_000
#: Bytes of a block's words, about; rows whose texts are cut at once.
BLOCK_BYTES = 1 << 28
ROWS_AT_ONCE = 256
_END = b""

_BLOCKS = "block long, bucket int, doc_id long, held boolean, ids binary, words binary, counts binary"
_TOTALS = "block long, ids binary, counts binary, words binary, totals binary, levels binary, ends long, tokens long, distinct long"
_CODED = "doc_id long, held boolean, n_tokens long, n_known long, base double, tail double, ids binary, draw long, round int"
_LEVELS = 512
#: Rows of the documents for each bucket of words, at least.
ROWS_A_BUCKET = 500


def head_size(tokens: int) -> int:
    """Number of words that are symbols of their own, by the number of training tokens."""
    return HEAD + math.isqrt(tokens) // 4


def _level(totals: np.ndarray) -> np.ndarray:
    return (8 * np.log2(totals)).astype(np.int64)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words; bytes.split() parts at ASCII white space only."""
    return (text or b"").lower().split()


def all_words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """words_of all texts in one array, and how many each has."""
    wide = pa.types.is_large_binary(texts.type)
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts.view(pa.large_string() if wide else pa.string())))
    found = cut.flatten()
    real = pc.greater(pc.binary_length(found), 0)  # a text that is empty or begins or ends with space has empty ones
    ends = np.cumsum(pc.fill_null(pc.list_value_length(cut), 0).to_numpy())
    before = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
    return found.filter(real).view(pa.large_binary() if wide else pa.binary()), np.diff(before[np.append(0, ends)])


def _bytes_of(words: pa.Array) -> list[bytes]:
    """The values of an array of bytes without nulls."""
    wide = pa.types.is_large_binary(words.type)
    _, at, data = words.buffers()
    cuts = np.frombuffer(at, "<i8" if wide else "<i4")[words.offset : words.offset + len(words) + 1].tolist()
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in zip(cuts, cuts[1:])]


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


def _batch(schema: str, /, **columns) -> pa.RecordBatch:
    """A batch of the columns given; the others are null."""
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64()}
    n = len(next(iter(columns.values())))
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], types[t]) if c in columns else pa.nulls(n, types[t]) for c, t in fields], [c for c, _ in fields])


def blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """Documents as numbers of their block's words, and the blocks' words by bucket; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 24
        docs_, sizes, texts, size, width = [], [], [], 0, 0

        def flush() -> Iterator[pa.RecordBatch]:
            coded_ = pa.concat_arrays(texts).dictionary_encode()
            every = [*_bytes_of(coded_.dictionary), _END]
            held, ends = np.array([h for _, h in docs_]), np.cumsum(np.concatenate(sizes) + 1)
            ids, last = np.empty(ends[-1], "<u4"), np.zeros(ends[-1], bool)
            last[ends - 1] = True
            ids[last], ids[~last] = len(every) - 1, coded_.indices.to_numpy()
            cuts = np.append(0, ends)
            counts = np.bincount(ids[np.repeat(~held, np.diff(cuts))], minlength=len(every))
            for k in range(0, len(docs_), 500):
                part = docs_[k : k + 500]
                yield _batch(_BLOCKS, block=[block] * len(part), doc_id=[d for d, _ in part], held=[h for _, h in part], ids=[ids[cuts[i] : cuts[i + 1]].tobytes() for i in range(k, k + len(part))])
            of = np.fromiter(map(zlib.crc32, every), np.int64, len(every)) % buckets
            order = np.argsort(of, kind="stable")
            cuts = np.searchsorted(of[order], np.arange(buckets + 1))
            full = np.flatnonzero(np.diff(cuts))
            parts = [order[cuts[b] : cuts[b + 1]] for b in full]
            yield _batch(_BLOCKS, block=[block] * len(full), bucket=full.astype(np.int32), ids=[p.astype("<u4").tobytes() for p in parts], words=[b" ".join(every[i] for i in p.tolist()) for p in parts], counts=[counts[p].astype("<i8").tobytes() for p in parts])

        for b in (b.slice(k, ROWS_AT_ONCE) for b in batches for k in range(0, b.num_rows, ROWS_AT_ONCE)):
            docs_ += [(d, held_out(d)) for d in b.column("doc_id").to_pylist()]
            found, n = all_words(b.column("raw"))
            texts.append(found)
            sizes.append(n)
            size += int(n.sum()) + len(n)
            width += pc.sum(pc.binary_length(found)).as_py() or 0
            if size >= BLOCK_TOKENS or width >= BLOCK_BYTES:
                yield from flush()
                block += 1
                docs_, sizes, texts, size, width = [], [], [], 0, 0
        if docs_:
            yield from flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode("text", "UTF-8").alias("raw"))
    return common.written(rows.mapInArrow(run, _BLOCKS), "lm-blocks")


def totals(made: DataFrame, buckets: int) -> DataFrame:
    """Of each block's words their counts in all training documents; each bucket's figures, its words by
    count in one row, and how many have each level of count; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["bucket"] != now and rows:
                    yield from bucket(rows)
                    rows = []
                now = r["bucket"]
                rows.append(r)
        if rows:
            yield from bucket(rows)

    def bucket(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        total: defaultdict = defaultdict(int)
        for r in rows:
            r["words"] = r["words"].split(b" ")
            for w, c in zip(r["words"], np.frombuffer(r["counts"], "<i8").tolist()):
                total[w] += c
        for k in range(0, len(rows), 50):
            part = rows[k : k + 50]
            yield _batch(_TOTALS, block=[r["block"] for r in part], ids=[r["ids"] for r in part], counts=[np.fromiter(map(total.__getitem__, r["words"]), "<i8", len(r["words"])).tobytes() for r in part])
        known = [(-c, w) for w, c in total.items() if c]
        yield _batch(_TOTALS, tokens=[-sum(c for c, _ in known)], distinct=[len(known)])
        top = sorted(x for x in known if x[1] != _END)
        if top:
            most = np.array([-c for c, _ in top], "<i8")
            levels = np.bincount(_level(most), minlength=_LEVELS).astype("<i8")
            yield _batch(_TOTALS, words=[b" ".join(w for _, w in top)], totals=[most.tobytes()], levels=[levels.tobytes()])
        if total.get(_END):
            yield _batch(_TOTALS, ends=[total[_END]])

    each = made.filter("bucket is not null").select("block", "bucket", "ids", "words", "counts")
    return common.written(each.repartition(max(8, buckets // 8), "bucket").sortWithinPartitions("bucket", "block").mapInArrow(run, _TOTALS), "lm-counts")


def most_frequent(counted: DataFrame, size: int) -> list[tuple[bytes, int]]:
    """The `size` words with the highest counts, then by word: those at or above a level of count are sent on."""
    levels = np.zeros(_LEVELS, np.int64)
    for r in counted.filter("levels is not null").select("levels").collect():  # a row a bucket, of a fixed size
        levels += np.frombuffer(r["levels"], "<i8")
    above = np.cumsum(levels[::-1])[::-1]
    least = int(np.flatnonzero(above >= size).max(initial=0))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for words, totals_ in zip(b.column("words"), b.column("totals").to_pylist()):
                n = np.frombuffer(totals_, "<i8")
                k = int((_level(n) >= least).sum())  # in order of count
                if k:
                    yield pa.RecordBatch.from_arrays([pa.array(words.as_py().split(b" ")[:k], pa.binary()), pa.array(n[:k])], ["word", "total"])

    top = counted.filter("words is not null").select("words", "totals").mapInArrow(chosen, "word binary, total long")
    return [(bytes(r["word"]), r["total"]) for r in top.orderBy(F.desc("total"), "word").limit(size).collect()]


def coded(made: DataFrame, counted: DataFrame, head: dict[bytes, int], rounds: int, of_all: float, rest: float) -> DataFrame:
    """Every document as symbols, with what its words' counts give: _CODED; written by round (-1: held out).

    base is the base score, tail what the words that share a symbol add to the model's score of it.
    """
    spark = made.sparkSession
    shared, other = spark.sparkContext.broadcast(head | {_END: 0}), len(head) + 1
    kind = symbol_type(other + 1)

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Which of a block's words are frequent ones."""
        known = shared.value
        for b in batches:
            for r in b.to_pylist():
                pairs = [(i, known[w]) for i, w in zip(np.frombuffer(r["ids"], "<u4").tolist(), r["words"].split(b" ")) if w in known]
                if pairs:
                    a, s = zip(*pairs)
                    yield _batch(kinds, block=[r["block"]], kind=[1], ids=[np.array(a, "<u4").tobytes()], counts=[np.array(s, "<i8").tobytes()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lut, out = None, None, []
        numbers, symbol = [], []

        def done() -> pa.RecordBatch:
            names = [c.split()[0] for c in _CODED.split(", ")]
            return _batch(_CODED, **dict(zip(names, map(list, zip(*out)))))

        for b in batches:
            for r in b.to_pylist():
                if r["block"] != now:
                    now, numbers, symbol, lut = r["block"], [], [], None
                ids = np.frombuffer(r["ids"], "<u4")
                if r["kind"] == 0:
                    numbers.append((ids, np.frombuffer(r["counts"], "<i8")))
                elif r["kind"] == 1:
                    symbol.append((ids, np.frombuffer(r["counts"], "<i8")))
                else:
                    if lut is None:  # the block's words come first
                        cnt = np.zeros(sum(len(i) for i, _ in numbers), np.int64)
                        sym = np.full(len(cnt), other, kind)
                        for i, c in numbers:
                            cnt[i] = c
                        for i, c in symbol:
                            sym[i] = c
                        lut = np.log10((cnt + 0.5) / of_all)
                        tail, known = np.where(sym == other, lut - np.log10(rest), 0.0), cnt > 0
                    coded_ = sym[ids].tobytes()
                    draw = zlib.crc32(coded_, zlib.crc32(str(r["doc_id"]).encode()))  # of the document alone
                    out.append((r["doc_id"], r["held"], len(ids), int(known[ids].sum()), float(lut[ids].sum()), float(tail[ids].sum()), coded_, draw, -1 if r["held"] else draw % rounds))
                    if len(out) >= 500:
                        yield done()
                        out = []
        if out:
            yield done()

    kinds = "block long, kind int, doc_id long, held boolean, ids binary, counts binary"
    word_rows = made.filter("bucket is not null").select("block", "ids", "words").mapInArrow(named, kinds)
    count_rows = counted.filter("block is not null").selectExpr("block", "0 as kind", "cast(null as long) as doc_id", "cast(null as boolean) as held", "ids", "counts")
    doc_rows = made.filter("bucket is null").selectExpr("block", "2 as kind", "doc_id", "held", "ids", "cast(null as binary) as counts")
    every = count_rows.unionByName(word_rows).unionByName(doc_rows)
    parts = 3 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = common.scratch_path(spark, "lm-coded")
    rows = every.repartition(parts, "block").sortWithinPartitions("block", "kind").mapInArrow(run, _CODED)
    rows.write.option("compression", "zstd").partitionBy("round").parquet(path)
    shared.destroy()
    out = spark.read.schema(_CODED).parquet(path)
    out._scratch = path
    return out


def symbol_type(symbols: int) -> str:
    return "<u2" if symbols <= 65_536 else "<u4"


def _tasks(tokens: int) -> tuple[int, int]:
    """Tasks and rounds of training on so many tokens: by the tokens alone, so that no cluster's size matters."""
    tasks = max(1, -(-tokens // TASK_TOKENS))
    return tasks, 1 if tasks == 1 else ROUNDS


def fit(table: DataFrame, symbols: int, counts: np.ndarray, tokens: int) -> tuple[dict[str, np.ndarray], int]:
    """The model after one pass over all training documents of a coded table, and the number of tokens it learned from."""
    spark = table.sparkSession
    state, learned = gru.begun(gru.fresh(symbols, counts)), 0
    (tasks, rounds), kind = _tasks(tokens), symbol_type(symbols)
    each = tokens // (tasks * rounds)  # of a task in a round, about

    for turn in range(rounds if tokens else 0):
        shared = spark.sparkContext.broadcast(state)

        def learn(batches: Iterator[pa.RecordBatch], turn=turn, shared=shared) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            own, total = {k: v.copy() for k, v in shared.value.items()}, 0

            def chunks() -> Iterator[list[np.ndarray]]:
                nonlocal total
                texts, size = [], 0
                for b in batches:
                    for x in b.column("ids"):
                        texts.append(np.frombuffer(x.as_py(), kind).astype("<i4"))
                        size += len(texts[-1])
                        if size >= ROUND_TOKENS:
                            total += size
                            yield texts
                            texts, size = [], 0
                if texts:
                    total += size
                    yield texts

            gru.learn(own, symbols, chunks(), each, gru.lanes_for(each), turn / rounds, (turn + 1) / rounds)
            if total:
                part = TaskContext.get().partitionId()
                yield sums.sliced("tokens", part, np.array([float(total)]))
                for name, v in own.items():
                    yield sums.sliced(name, part, v.astype(float) * total)

        # a task is a partition of its own, so their number, which is that of the states to be averaged, depends on the tokens alone
        task = F.expr(f"cast(draw div {rounds} % {tasks} as int)")
        dealt = table.filter(F.col("round") == turn).select("ids", "draw").repartitionById(tasks, task).sortWithinPartitions("draw")
        got = sums.added(dealt.mapInArrow(learn, sums.PARTS))
        if got:  # one model: the mean of the tasks' states by their tokens
            n = got.pop("tokens")[0]
            learned += round(n)
            state = {name: (v / n).astype(np.float32) for name, v in got.items()}
        shared.destroy()
    return gru.unpacked(state["weights"], symbols), learned


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row."""
    spark = docs.sparkSession
    buckets = int(max(8, min(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // ROWS_A_BUCKET)))
    made = blocks(docs, buckets)
    counted = totals(made, buckets)
    row = counted.agg(F.sum("tokens").alias("n"), F.sum("distinct").alias("v"), F.sum("ends").alias("e")).first()
    n, v, end = row.n or 0, row.v or 0, row.e or 0
    top = most_frequent(counted, head_size(n))
    head = {w: k for k, (w, _) in enumerate(top, 1)}
    symbols = len(head) + 2
    frequent = np.array([end] + [c for _, c in top], float)
    of_all = n + 0.5 * (v + 1)
    rest = max(1.0 - float(((frequent + 0.5) / of_all).sum()), 1e-12) if n else 1.0
    table = coded(made, counted, head, _tasks(n)[1], of_all, rest)
    common.drop_written(made)
    common.drop_written(counted)
    weights, learned = fit(table, symbols, np.append(frequent, max(n - frequent.sum(), 0.5)), n)
    if learned != n:
        raise RuntimeError(f"the model learned from {learned} of {n} training tokens")
    shared, kind = spark.sparkContext.broadcast(weights), symbol_type(symbols)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in out.split(", ")]
        for b in pieces(batches):
            base = b.column("base").to_numpy()
            model = gru.score(shared.value, [np.frombuffer(x.as_py(), kind) for x in b.column("ids")]) / np.log(10) + b.column("tail").to_numpy() if n else base
            cols = [b.column(c) for c in ("doc_id", "held", "n_tokens", "n_known")]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(np.full(b.num_rows, n)), b.column("base"), pa.array(model, pa.float64())], names)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches of about BLOCK_TOKENS tokens."""
        for b in batches:
            ends, k = np.cumsum(b.column("n_tokens").to_numpy()), 0
            while k < b.num_rows:
                e = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BLOCK_TOKENS, "right")))
                yield b.slice(k, e - k)
                k = e

    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return table.mapInArrow(scored, out)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every document's scores."""
    return score(common.table(spark, sf_dir, "documents"))
