"""Operator 4: byte-level BPE encoding and decoding.

Tokens are put into an Aho-Corasick automaton, bytes mapped to Latin-1. It gives the longest token
that starts at each byte. From there the encoder goes left to right and takes the longest token
that is compatible with the one before it, going back to shorter ones where none is; positions that
led nowhere are remembered, so that each is left once and the work is linear. Two tokens are
compatible if merging their joined bytes by rank gives just these two again; answers are memoised.

Defined results: a null text counts as empty and gives no ids; repeated rows are each encoded; other
columns of the input are kept; where one is called like an output column, the output replaces it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import common
from strandline.llm.pretokens import WHITE, PieceCache, encoded

#: Entries of each of a worker's caches; a full cache is emptied.
CACHE = 300_000


class RankEncoder:
    """Encodes and decodes with a rank file, one pre-token at a time."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")).findall
        self.size = {i: len(t) for t, i in ranks.items()}
        # the longest shorter token that starts a token; -1 for none
        self.shorter = {i: next((ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in ranks), -1) for t, i in ranks.items()}
        self.automaton = ahocorasick.Automaton()
        for t, i in ranks.items():
            if len(t) == 1 or self.merged(t) == [i]:
                self.automaton.add_word(t.decode("latin-1"), (len(t), i))
            else:
                self.size[i] = 0  # never the result of merges; only a whole pre-token can be it
        self.automaton.make_automaton()
        self.fits: dict[tuple[int, int], bool] = {}
        self.first = PieceCache(self.encode_pieces, "", CACHE)
        self.later = PieceCache(self.encode_pieces, " ", CACHE)

    def merged(self, data: bytes) -> list[int]:
        """Plain merging: the pair of lowest rank first, the leftmost on a tie."""
        parts = [data[k : k + 1] for k in range(len(data))]
        while len(parts) > 1:
            best = min((self.ranks.get(parts[k] + parts[k + 1], 1 << 60), k) for k in range(len(parts) - 1))
            if best[0] == 1 << 60:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [self.ranks[p] for p in parts]

    def compatible(self, a: int, b: int) -> bool:
        known = self.fits.get((a, b))
        if known is None:
            if len(self.fits) >= CACHE:
                self.fits.clear()
            known = self.fits[a, b] = self.merged(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        longest = [-1] * len(piece)
        for end, (size, token) in self.automaton.iter(piece.decode("latin-1")):
            longest[end - size + 1] = token  # ends ascend, so the longest comes last
        ids: list[int] = []
        at, token, stuck, total = 0, longest[0], set(), len(piece)
        while at < total:
            while token >= 0:
                size = self.size[token]
                if size and at + size not in stuck and (not ids or self.compatible(ids[-1], token)):
                    break
                token = self.shorter[token]
            if token >= 0:
                ids.append(token)
                at += size
                token = longest[at] if at < total else -1
            else:
                stuck.add(at)
                last = ids.pop()
                at -= self.size[last]
                token = self.shorter[last]
        return ids

    def encode_pieces(self, text: str) -> bytes:
        return np.array([i for p in self.split(text) for i in self.encode_piece(p.encode())], "<u4").tobytes()

    def whole(self, text: str) -> bytes:
        return b"".join(map(self.first.__getitem__, self.split(text)))

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Ids of each text (null: none) as little-endian unsigned 32-bit integers."""
        get = self.later.__getitem__
        parts = [pa.array([], pa.large_binary())]
        for ids, sizes in encoded(texts, self.first.__getitem__, lambda words: list(map(get, words)), self.whole, "<u4"):
            offsets = 4 * np.append(0, np.cumsum(sizes)).astype("<i8")
            parts.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids)]))
        return pa.concat_arrays(parts).cast(pa.binary())

    def encode(self, text: str) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> RankEncoder:
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return RankEncoder(ranks, pattern)


def _with(df: DataFrame, name: str, kind: T.DataType, source: str, make) -> DataFrame:
    """df and one column more, made from column `source` in Arrow batches."""
    schema = T.StructType([f for f in df.schema.fields if f.name != name] + [T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = make(batch.column(source))
            kept = [(f.name, batch.column(f.name)) for f in batch.schema if f.name != name]
            yield pa.RecordBatch.from_arrays([c for _, c in kept] + [made], [n for n, _ in kept] + [name])

    return df.mapInArrow(run, schema)


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds column `ids`: the token ids as little-endian unsigned 32-bit integers."""

    def make(column: pa.Array) -> pa.Array:
        return encoder(path, pattern).encode_all(column)

    return _with(df, ids, T.BinaryType(), text, make)


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds column `decoded`: the bytes that the ids stand for (null ids: no bytes)."""

    def make(column: pa.Array) -> pa.Array:
        one = encoder(path, pattern).decode
        return pa.array([one(t.as_py() or b"") for t in column], pa.binary())

    return _with(df, decoded, T.BinaryType(), ids, make)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: every text encoded, decoded again, and both digested."""
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode(docs, path, P.PATTERN).select("doc_id", "ids")
    back = decode(coded, path, P.PATTERN)
    return back.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
