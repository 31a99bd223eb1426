"""Word shingles as 64-bit hashes, made for many documents at a time with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_U = np.uint64
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_IN_WORD = np.ones(256, bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_LOWER = _LOWER.astype(_U) + _U(1)
_NO_WORD = 0x5851F42D4C957F2D
#: Bytes of text hashed at once; longer documents are taken alone.
BLOCK = 1 << 18

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers["up"]) < n:
        size = max(n, 2 * BLOCK)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            p = np.full(size, base, _U)
            p[0] = 1
            _powers[name] = np.cumprod(p)
    return _powers["up"][:n], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def _block(data: np.ndarray, cuts: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Of each text data[cuts[k]:cuts[k+1]], its distinct shingles' hashes, ascending."""
    inside = _IN_WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[cuts] = True
    before = np.empty_like(inside)
    before[:1], before[1:] = False, inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty_like(inside)
    after[-1:], after[:-1] = False, inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    up, down = _power(len(data))
    total = np.zeros(len(data) + 1, _U)
    np.cumsum(_LOWER[data] * up, out=total[1:])
    words = mix((total[ends] - total[starts]) * down[starts])
    first = np.searchsorted(starts, cuts)
    n = len(words)
    padded = np.concatenate([words, np.full(width, _NO_WORD, _U)])
    runs = np.zeros(n, _U)
    for k in range(width):
        runs = runs * _U(0xD1342543DE82EF95) + padded[k : k + n]
    runs = mix(runs)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= width:
            yield np.unique(runs[a : b - width + 1])
        elif b > a:  # fewer words than a shingle: the whole sequence is one
            few = np.concatenate([words[a:b], np.full(width - (b - a), _NO_WORD, _U)])
            one = np.zeros(1, _U)
            for w in few:
                one = one * _U(0xD1342543DE82EF95) + w
            yield mix(one)
        else:
            yield np.empty(0, _U)


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """For each text (null: empty), the ascending hashes of its distinct `width`-word shingles.

    Letters A-Z are lower-cased; words are runs of anything but ASCII white space.
    """
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], "<i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", "u1")
    k = 0
    while k < len(texts):
        e = max(k + 1, int(np.searchsorted(offsets, offsets[k] + BLOCK, "right")) - 1)
        cuts = offsets[k : e + 1] - offsets[k]
        yield from _block(data[offsets[k] : offsets[e]], cuts, width)
        k = e
