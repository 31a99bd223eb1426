"""Cutting text where byte-level BPE pre-tokens always end, and bounded caches of encoded pieces."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Unicode's White_Space, as the tokenizer libraries read \s.
WHITE = "\t-\r \x85\xa0  -     　"

# Between two pre-tokens a space opens the second, unless it lies inside a run of white space.
_INNER_SPACE = re.compile(r"\s (?:\s|\Z)")


class PieceCache(dict):
    """piece -> encoded ids, for pieces of at most 64 characters.

    Two generations of half the limit each: when the younger is full, the older is forgotten, and
    pieces still in use move up from it.
    """

    def __init__(self, encode: Callable[[str], bytes], lead: str, limit: int):
        super().__init__()
        self.encode, self.lead, self.half, self.old = encode, lead, limit // 2, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.encode(self.lead + piece)
        self.keep(piece, ids)
        return ids

    def keep(self, piece: str, ids: bytes) -> None:
        if len(piece) <= 64:
            if len(self) >= self.half:
                self.old = dict(self)
                self.clear()
            self[piece] = ids


def cut(text: str) -> list[str] | None:
    """The text cut before each space (spaces removed), or None if a cut could part a pre-token."""
    return None if _INNER_SPACE.search(text) else text.split(" ")


#: Bytes of text that are cut and looked up at once; longer texts are taken alone.
CHUNK = 2 << 20


def encoded(texts: pa.Array, first: Callable[[str], bytes], later: Callable[[list[str]], list[bytes]], whole: Callable[[str], bytes], kind: str, uncut: re.Pattern | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of runs of texts (null: empty) their ids one after another, and the number of each text's.

    Texts are cut at spaces by Arrow, and each distinct word of a run is looked up once: `first` gives
    the ids of a text's first word, `later` those of words after a space, `whole` those of a text that
    must not be cut: where a cut could part a pre-token, or where `uncut` is found.
    """
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    k = 0
    while k < len(texts):
        e = max(k + 1, int(np.searchsorted(offsets, offsets[k] + CHUNK, "right")) - 1)
        yield _run(texts.slice(k, e - k), first, later, whole, kind, uncut)
        k = e


def _run(texts: pa.Array, first: Callable, later: Callable, whole: Callable, kind: str, uncut: re.Pattern | None) -> tuple[np.ndarray, np.ndarray]:
    given = texts.to_pylist()
    odd = {k: whole(t) for k, t in enumerate(given) if _INNER_SPACE.search(t) or (uncut and uncut.search(t))}
    if odd:
        texts = pa.array(["" if k in odd else t for k, t in enumerate(given)], pa.large_string())
    words = pc.split_pattern(texts, " ")
    at = words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
    names = words.flatten().dictionary_encode()
    known = names.dictionary.to_pylist()
    code = names.indices.to_numpy().astype(np.int64)
    heads = [odd[k] if k in odd else first(t.split(" ", 1)[0]) for k, t in enumerate(given)]
    code[at] = len(known) + np.arange(len(given))
    seen = np.zeros(len(known) + len(given), bool)
    seen[code] = True
    needed = np.flatnonzero(seen[: len(known)])  # a word that only begins texts is not looked up
    table = [b""] * len(known)
    for k, ids in zip(needed.tolist(), later([known[k] for k in needed.tolist()])):
        table[k] = ids
    table += heads
    width = np.dtype(kind).itemsize
    sizes = np.fromiter(map(len, table), np.int64, len(table)) // width
    before, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(table), kind)
    count = sizes[code]
    ends = np.cumsum(count)
    total = int(ends[-1]) if len(ends) else 0
    ids = flat[np.arange(total, dtype=np.int32) + np.repeat((before[code] - (ends - count)).astype(np.int32), count)]
    return ids, np.add.reduceat(count, at)
