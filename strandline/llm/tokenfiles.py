"""Operator 2: token ids as flat binary files with 64-bit document offsets, read by memory map.

Documents are dealt by ranges of doc_id and sorted, so that shard after shard holds them in
ascending order. Each task encodes its range and writes one shard of four flat files, as it goes:

    <shard>.ids      token ids, unsigned 16-bit where the vocabulary allows it, else 32-bit
    <shard>.offsets  n + 1 unsigned 64-bit positions of the documents' first ids, within the shard
    <shard>.docs     n signed 64-bit doc_ids
    <shard>.nulls    n bytes: 1 where the doc_id is null

A manifest row for each shard goes through Spark's own commit, so that only files of tasks that
succeeded count; a lost task writes new files under another name. Each shard's base, the number of
ids before it, is a prefix sum over the manifest. Reading maps the files and adds the base.

Defined results: null text counts as empty and has just the end id; null doc_ids come first;
repeated doc_ids stay separate rows, ordered by a hash of the text; an empty table has no rows; further columns
of the input are not stored. Strings of the tokenizer's own special tokens become those tokens, as the
library has it by default.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.llm import common
from strandline.llm.pretokens import PieceCache, encoded

CACHE = 1_200_000
#: Bytes of text in a shard, about.
SHARD_BYTES = 16 << 20
_SPACE = re.compile(r"\s")
_MANIFEST = "part int, path string, docs long, ids long, width int"
_READ = "doc_id long, start long, n_tokens long, ids binary"


class FileEncoder:
    """A tokenizer file of the tokenizers library, with a cache of encoded pieces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.first = PieceCache(self.one, "", CACHE // 8)
        self.later = PieceCache(self.one, " ", CACHE)
        self.line = self.tokenizer.encode("\n", add_special_tokens=False).ids

    def raw(self, ids: list[int]) -> bytes:
        return np.array(ids, f"<u{self.width}").tobytes()

    def one(self, text: str) -> bytes:
        return self.raw(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def pieces(self, new: list[str]) -> dict[str, bytes]:
        """Ids of pieces, each after a space.

        Pieces without white space go to the library line by line, many in one text: a line's end is
        a token of its own there, and parts the answers. Two words around one line end are put
        together from theirs.
        """
        plain, broken, out = set(), {}, {}
        for p in new:
            if not p:
                out[p] = self.one(" ")
            elif not _SPACE.search(p):
                plain.add(p)
            elif (at := p.find("\n")) > 0 and at + 1 < len(p) and not _SPACE.search(p, at + 1) and not _SPACE.search(p, 0, at):
                broken[p] = at
                plain.add(p[:at])
            else:
                out[p] = self.one(" " + p)
        plain = list(plain)
        for k in range(0, len(plain), 4096):
            some = plain[k : k + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join([" " + p for p in some])], add_special_tokens=False)[0].ids, f"<u{self.width}")
            ends = np.append(np.flatnonzero(ids == self.line[0]), len(ids))
            if len(self.line) != 1 or len(ends) != len(some):
                out |= {p: self.one(" " + p) for p in some}
                continue
            flat, a = ids.tobytes(), 0
            for p, b in zip(some, (ends * self.width).tolist()):
                out[p] = flat[a:b]
                a = b + self.width
        line = self.raw(self.line)
        for p, at in broken.items():
            out[p] = out[p[:at]] + line + self.first[p[at + 1 :]]
        return out

    def known(self, words: list[str]) -> list[bytes]:
        """Ids of words after a space; those that are not in the cache go to the library together."""
        get, old = self.later.get, self.later.old.get
        out = list(map(get, words))
        new = []
        for k, ids in enumerate(out):
            if ids is None:
                ids = out[k] = old(words[k])
                if ids is None:
                    new.append(k)
                else:
                    self.later.keep(words[k], ids)
        if new:
            made = self.pieces([words[k] for k in new])
            for k in new:
                out[k] = made[words[k]]
                self.later.keep(words[k], out[k])
        return out

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Of runs of texts their ids one after another, and the number of each text's."""
        return encoded(texts, self.first.__getitem__, self.known, self.one, f"<u{self.width}", self.added)


@lru_cache(maxsize=2)
def encoder(path: str) -> FileEncoder:
    return FileEncoder(path)


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 0, shards: int | None = None) -> DataFrame:
    """Writes doc_id and text of docs as shards into `folder`; returns the manifest with bases."""
    spark = docs.sparkSession
    local = common.posix(folder)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if not shards:  # of about SHARD_BYTES, and one for each core at least
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        shards = common.partitions_for(spark, size, SHARD_BYTES)

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        one, name, part = encoder(tokenizer), None, TaskContext.get().partitionId()
        files, n, ids_ = [], 0, 0
        try:
            for batch in batches:
                if not files:
                    os.makedirs(local, exist_ok=True)
                    name = f"{local}/shard-{part:06d}-{uuid.uuid4().hex}"
                    files = [open(f"{name}.{kind}", "wb") for kind in ("ids", "offsets", "docs", "nulls")]  # noqa: SIM115
                    np.zeros(1, "<u8").tofile(files[1])
                for ids, sizes in one.encode_all(batch.column("text")):
                    ends = np.cumsum(sizes)
                    np.insert(ids, ends, end_id).tofile(files[0])
                    (ids_ + ends + np.arange(1, len(ends) + 1)).astype("<u8").tofile(files[1])
                    ids_ += int(ends[-1]) + len(ends)
                keys = batch.column("doc_id")
                keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tofile(files[2])
                keys.is_null().to_numpy(zero_copy_only=False).astype("u1").tofile(files[3])
                n += batch.num_rows
        finally:
            for f in files:
                f.close()
        if files:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [name], "docs": [n], "ids": [ids_], "width": pa.array([one.width], pa.int32())})

    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text")
    manifest = common.written(dealt.mapInArrow(shard, _MANIFEST), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each shard
    return manifest.withColumn("base", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read(manifest: DataFrame) -> DataFrame:
    """The documents of the shards: doc_id, start (ids before it in all), n_tokens, ids (raw)."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in batch.to_pylist():
                ids = np.memmap(f"{s['path']}.ids", f"<u{s['width']}", "r")
                offsets = np.memmap(f"{s['path']}.offsets", "<u8", "r")
                n = s["docs"]
                keys, null = np.memmap(f"{s['path']}.docs", "<i8", "r"), np.memmap(f"{s['path']}.nulls", "u1", "r")
                for k in range(0, n, 512):
                    cuts = offsets[k : k + 513].astype(np.int64)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(keys[k : k + 512]), pa.int64(), mask=null[k : k + 512] == 1),
                            pa.array(cuts[:-1] + s["base"], pa.int64()),
                            pa.array(np.diff(cuts), pa.int64()),
                            pa.array([ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    each = manifest.repartition(max(manifest.sparkSession.sparkContext.defaultParallelism, 64), "part")
    return each.mapInArrow(mapped, _READ)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: documents as token files, read back and digested."""
    import public_tokenizers as P

    manifest = write(common.table(spark, sf_dir, "documents"), common.scratch_path(spark, "tokens"), P.path("byte_bpe_50k.json"))
    rows = read(manifest)
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
