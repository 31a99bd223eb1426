"""A small gated recurrent language model in numpy, with a class-factored softmax.

Symbols are 0 (end), 1 .. n - 2 (frequent words, most frequent first) and n - 1 (any other word). Class 0
has the last symbol alone; the others have WIDTH symbols each, in order of frequency.
"""

from __future__ import annotations

import math

import numpy as np

EMBED, HIDDEN, WIDTH = 24, 32, 64
LANES, STEPS = 16, 32
RATE = 1e-2
#: Rows of a softmax at a time: what they need stays in a core's cache.
ROWS = 768
#: Symbols that are scored at once, at least: windows with few lanes are gathered up to that.
AT_ONCE = 32_768


def shapes(symbols: int) -> dict[str, tuple[int, ...]]:
    classes = 1 + -(-(symbols - 1) // WIDTH)
    return {"embed": (symbols, EMBED), "inp": (EMBED, 3 * HIDDEN), "bias": (3 * HIDDEN,), "rec": (HIDDEN, 3 * HIDDEN), "cls": (HIDDEN, classes), "cls_b": (classes,), "out": (classes, HIDDEN, WIDTH), "out_b": (classes, WIDTH)}


def unpacked(flat: np.ndarray, symbols: int) -> dict[str, np.ndarray]:
    """Views of the weights that lie one after another in a vector."""
    out, at = {}, 0
    for name, shape in shapes(symbols).items():
        size = int(np.prod(shape))
        out[name] = flat[at : at + size].reshape(shape)
        at += size
    return out


def packed(w: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([w[k].ravel() for k in shapes(len(w["embed"]))]).astype(np.float32)


def fresh(symbols: int, counts: np.ndarray, seed: int = 3) -> dict[str, np.ndarray]:
    """Starting weights; output biases start at the symbols' frequencies."""
    rng = np.random.default_rng(seed)
    classes = 1 + -(-(symbols - 1) // WIDTH)
    f = np.log(np.maximum(counts, 0.5))
    inner = np.full((classes, WIDTH), -30.0)
    inner[1:].ravel()[: symbols - 1] = f[:-1]
    total = np.array([counts[-1]] + [counts[k * WIDTH : min((k + 1) * WIDTH, symbols - 1)].sum() for k in range(classes - 1)])
    small = lambda *shape: rng.normal(0, 0.5 / np.sqrt(shape[-2]), shape)
    w = {"embed": rng.normal(0, 0.3, (symbols, EMBED)), "inp": small(EMBED, 3 * HIDDEN), "bias": np.zeros(3 * HIDDEN), "rec": small(HIDDEN, 3 * HIDDEN), "cls": small(HIDDEN, classes) * 0.1, "cls_b": np.log(np.maximum(total, 0.5)), "out": small(classes, HIDDEN, WIDTH) * 0.1, "out_b": inner}
    return {k: v.astype(np.float32) for k, v in w.items()}


def places(symbols: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Class and position within it."""
    last = symbols == n - 1
    return np.where(last, 0, 1 + symbols // WIDTH), np.where(last, 0, symbols % WIDTH)


_rooms: dict[str, np.ndarray] = {}


def _room(name: str, *shape: int) -> np.ndarray:
    """Memory for an intermediate result that is used again by the next window (a task runs one at a time)."""
    size = math.prod(shape)
    if name not in _rooms or len(_rooms[name]) < size:
        _rooms[name] = np.empty(size, np.float32)
    return _rooms[name][:size].reshape(shape)


_ones: dict[int, np.ndarray] = {}


def _small(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no state, whose numbers lie between -1 and 1, has an output so large that exponentials might overflow."""
    return bool((np.abs(weights).sum(-2) + bias).max() <= 60)


def _exp(z: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray | float]:
    """Replaces z by its exponentials; returns the sum of each row, and what was taken off the row first, if they might overflow (see _small)."""
    top = 0.0
    if not small and z.size and z.max() > 60:
        top = z.max(1, keepdims=True)
        z -= top
    np.exp(z, out=z)
    if z.shape[1] not in _ones:
        _ones[z.shape[1]] = np.ones(z.shape[1], np.float32)
    return z @ _ones[z.shape[1]], top[:, 0] if isinstance(top, np.ndarray) else top


def _biased(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Weights with their bias as a row more, for states with a one (see _sorted)."""
    return np.concatenate([weights, bias[..., None, :]], -2)


def _sorted(w: dict, h: np.ndarray, rows: np.ndarray | None, y: np.ndarray):
    """Symbols y in order of their classes: that order, classes, positions, h (or some rows of it) with a one each, and where each class begins."""
    cls, at = places(y, len(w["embed"]))
    order = np.argsort(cls.astype(np.uint16), kind="stable")
    cls, at = cls[order], at[order]
    hs = _room("hs", len(y), HIDDEN + 1)
    np.take(h, order if rows is None else rows[order], 0, out=hs[:, :HIDDEN], mode="clip")
    hs[:, HIDDEN] = 1
    return order, cls, at, hs, np.searchsorted(cls, np.arange(len(w["out"]) + 1)).tolist()


def _pieces(a: int, b: int):
    return ((s, min(b, s + ROWS)) for s in range(a, b, ROWS))


def _parts(cuts: list[int]):
    """Pieces of the rows of all classes but 0, whatever the size of a class: start, end, and of each class in it the number, start and end."""
    a, parts = cuts[1], []
    for c in range(1, len(cuts) - 1):
        s = cuts[c]
        while s < cuts[c + 1]:
            e = min(cuts[c + 1], a + ROWS)
            parts.append((c, s, e))
            if e == a + ROWS:
                yield a, e, parts
                a, parts = e, []
            s = e
    if parts:
        yield a, parts[-1][2], parts


def _thirds(a: np.ndarray) -> np.ndarray:
    """Columns of the gates z and r and of what is new, each in one piece: 3 by rows by HIDDEN."""
    return np.ascontiguousarray(a.reshape(len(a), 3, HIDDEN).transpose(1, 0, 2))


def _powers(a: np.ndarray) -> np.ndarray:
    """The same as powers of e in 1 / (1 + e^-z), 1 / (1 + e^-r) and tanh n = 2 / (1 + e^-2n) - 1."""
    a = _thirds(a)
    a *= np.array([-1, -1, -2], np.float32)[:, None, None]
    return a


def states(w: dict, table: np.ndarray, x: np.ndarray, first: np.ndarray, h: np.ndarray, keep: bool = False):
    """Hidden states of the steps x (steps by lanes, rows of table, which are _powers); h starts at zero where first is set.

    They stand in memory that the next call uses again. With keep, also the states before each step, the gates z, r, new and -2 times what r was applied to.
    """
    steps, lanes = x.shape
    many = steps if keep else 1
    out, a, rec, x = _room("out", steps, lanes, HIDDEN), _room("a", 3, lanes, HIDDEN), _powers(w["rec"]), x.astype(np.intp)
    us, gates, news, befores = _room("u", 3, many, lanes, HIDDEN), _room("zr", 2, many, lanes, HIDDEN), _room("n", many, lanes, HIDDEN), _room("h", many, lanes, HIDDEN)
    starts = first.any(1)
    with np.errstate(over="ignore"):  # a gate of 1 / (1 + inf) is 0
        for t in range(steps):
            u, zr, n = us[:, t % many], gates[:, t % many], news[t % many]
            if keep or starts[t]:
                before = befores[t % many]
                before[:] = h
                h = before
            if starts[t]:
                h[first[t]] = 0
            np.take(table, x[t], 1, out=a, mode="clip")
            np.matmul(h, rec, out=u)
            np.add(a[:2], u[:2], out=zr)
            np.exp(zr, out=zr)
            zr += 1
            np.reciprocal(zr, out=zr)
            np.multiply(zr[1], u[2], out=n)
            n += a[2]
            np.exp(n, out=n)
            n += 1
            np.reciprocal(n, out=n)
            n *= 2
            n -= 1
            h = np.subtract(h, n, out=out[t])
            h *= zr[0]
            h += n
    return (out, h.copy(), (befores, gates[0], gates[1], news, us[2])) if keep else (out, h.copy())


def log_probs(w: dict, h: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Natural log probabilities of symbols y after states h."""
    order, cls, at, hs, cuts = _sorted(w, h, None, y)
    got, head, inner, each = np.empty(len(y), np.float32), _biased(w["cls"], w["cls_b"]), _biased(w["out"], w["out_b"]), np.arange(ROWS)
    small = _small(w["cls"], w["cls_b"]), _small(w["out"], w["out_b"])
    for a, b in _pieces(0, len(y)):
        z = np.matmul(hs[a:b], head, out=_room("d", b - a, head.shape[1]))
        some = z[each[: b - a], cls[a:b]]
        total, top = _exp(z, small[0])
        got[a:b] = some - top - np.log(total)
    for a, b, parts in _parts(cuts):
        z = _room("d", b - a, WIDTH)
        for c, s, e in parts:
            np.matmul(hs[s:e], inner[c], out=z[s - a : e - a])
        some = z[each[: b - a], at[a:b]]
        total, top = _exp(z, small[1])
        got[a:b] += some - top - np.log(total)
    out = np.empty(len(y), np.float32)
    out[order] = got
    return out


def _gradients(w: dict, g: dict, x: np.ndarray, y: np.ndarray, first: np.ndarray, h: np.ndarray, use: np.ndarray) -> np.ndarray:
    """Puts the gradients of the mean log loss of one window into g; returns the state after it."""
    steps, lanes = x.shape
    flat_x = x.ravel()
    by = np.argsort(flat_x.astype(np.uint16) if len(w["embed"]) <= 65_536 else flat_x, kind="stable")
    starts = np.flatnonzero(np.append(True, flat_x[by[1:]] != flat_x[by[:-1]]))
    used = flat_x[by[starts]]
    row = np.empty(len(by), np.int64)
    row[by] = np.repeat(np.arange(len(used)), np.diff(np.append(starts, len(by))))
    emb = w["embed"][used]
    out, last, (before, z, r, new, un) = states(w, _powers(emb @ w["inp"] + w["bias"]), row.reshape(steps, lanes), first, h, True)

    places_ = np.flatnonzero(use.ravel())
    order, cls, at, hs, cuts = _sorted(w, out.reshape(-1, HIDDEN), places_, y.ravel()[places_])
    places_, rows, each = places_[order], len(order), np.arange(ROWS)
    size = np.float32(1 / max(1, rows))
    head, inner, dhs = _biased(w["cls"], w["cls_b"]), _biased(w["out"], w["out_b"]), _room("dhs", rows, HIDDEN)
    g_head, turned = np.zeros_like(head), np.ascontiguousarray(w["cls"].T)
    small = _small(w["cls"], w["cls_b"]), _small(w["out"], w["out_b"])
    for a, b in _pieces(0, rows):
        d = np.matmul(hs[a:b], head, out=_room("d", b - a, head.shape[1]))
        d *= (size / _exp(d, small[0])[0])[:, None]
        d.reshape(-1)[each[: b - a] * head.shape[1] + cls[a:b]] -= size
        g_head += hs[a:b].T @ d
        np.matmul(d, turned, out=dhs[a:b])
    g["cls"][:], g["cls_b"][:] = g_head[:HIDDEN], g_head[HIDDEN]
    g_inner = _room("g_inner", *inner.shape)
    g_inner[np.diff(cuts) == 0] = g_inner[0] = 0
    for a, b, parts in _parts(cuts):
        d, more = _room("d", b - a, WIDTH), _room("more", b - a, HIDDEN)
        for c, s, e in parts:
            np.matmul(hs[s:e], inner[c], out=d[s - a : e - a])
        d *= (size / _exp(d, small[1])[0])[:, None]
        d.reshape(-1)[each[: b - a] * WIDTH + at[a:b]] -= size
        for c, s, e in parts:
            own = d[s - a : e - a]
            if s == cuts[c]:
                np.matmul(hs[s:e].T, own, out=g_inner[c])
            else:
                g_inner[c] += hs[s:e].T @ own
            np.matmul(own, w["out"][c].T, out=more[s - a : e - a])
        dhs[a:b] += more
    g["out"][:], g["out_b"][:] = g_inner[:, :HIDDEN], g_inner[:, HIDDEN]
    dh = _room("dh", steps * lanes, HIDDEN)
    dh[:] = 0
    dh[places_] = dhs
    dh = dh.reshape(steps, lanes, HIDDEN)

    # du: what comes back to the gates and to what r is applied to; dn: to what is new. The gate r's part is twice what it stands for until the end
    du, dn, back = _room("du", steps, lanes, 3 * HIDDEN), _room("dn", steps, lanes, HIDDEN), np.zeros((lanes, HIDDEN), np.float32)
    of_z, of_n, of_r, work = (_room(f"of_{k}", lanes, HIDDEN) for k in ("z", "n", "r", "w"))
    rec, opened, of_gate_r = np.ascontiguousarray(w["rec"].T), first.any(1), slice(HIDDEN, 2 * HIDDEN)
    rec[of_gate_r] *= np.float32(0.5)
    for t in range(steps - 1, -1, -1):  # truncated at the window's start
        back += dh[t]
        np.subtract(1, z[t], out=work)
        np.multiply(new[t], new[t], out=of_n)
        np.subtract(1, of_n, out=of_n)
        of_n *= work
        np.subtract(before[t], new[t], out=of_z)
        of_z *= z[t]
        of_z *= work
        np.subtract(r[t], 1, out=of_r)
        of_r *= r[t]
        of_r *= un[t]
        np.multiply(back, of_n, out=dn[t])
        np.multiply(back, of_z, out=du[t, :, :HIDDEN])
        np.multiply(dn[t], of_r, out=du[t, :, of_gate_r])
        np.multiply(dn[t], r[t], out=du[t, :, 2 * HIDDEN :])
        back *= z[t]
        back += np.matmul(du[t], rec, out=work)
        if opened[t]:
            back[first[t]] = 0
    du, dn = du.reshape(-1, 3 * HIDDEN), dn.reshape(-1, HIDDEN)
    np.matmul(before.reshape(-1, HIDDEN).T, du, out=g["rec"])
    g["rec"][:, of_gate_r] *= np.float32(0.5)
    sizes = np.diff(np.append(starts, len(by)))
    often = sizes >= 16
    rare = np.flatnonzero(~often)
    rare = rare[np.argsort(-sizes[rare], kind="stable")]
    wide = [int((sizes[rare] > k).sum()) for k in range(int(sizes[rare].max(initial=0)))]  # the first place of each rare symbol, the second, and so on
    by = np.concatenate([*(by[starts[rare[:n]] + k] for k, n in enumerate(wide)), by[np.repeat(often, sizes)]])
    da = np.take(du, by, 0, out=_room("by", *du.shape), mode="clip")
    da[:, 2 * HIDDEN :] = np.take(dn, by, 0, out=_room("by_n", *dn.shape), mode="clip")
    summed, one, at = np.empty((len(used), 3 * HIDDEN), np.float32), np.ones(int(sizes.max()), np.float32), len(rare)
    for n in wide[1:]:
        da[:n] += da[at : at + n]
        at += n
    summed[rare] = da[: len(rare)]
    for k in np.flatnonzero(often).tolist():
        n = int(sizes[k])
        np.matmul(one[:n], da[at : at + n], out=summed[k])
        at += n
    summed[:, of_gate_r] *= np.float32(0.5)
    g["bias"][:], g["inp"][:] = summed.sum(0), emb.T @ summed
    g["embed"][:] = 0
    g["embed"][used] = summed @ w["inp"].T
    return last


def streams(docs: list[np.ndarray], lanes: int, steps: int, shuffled: bool = False):
    """Documents laid end to end over lanes: windows (x, y, first, document of each place or -1).

    Long documents first, each to the lane with the least so far. x is the symbol before y, and end
    before a document's first.
    """
    import heapq

    lanes = max(1, min(lanes, len(docs)))
    heap, lane = [(0, k) for k in range(lanes)], [[] for _ in range(lanes)]
    for d in sorted(range(len(docs)), key=lambda d: (-len(docs[d]), d)):
        load, k = heapq.heappop(heap)
        lane[k].append(d)
        heapq.heappush(heap, (load + len(docs[d]), k))
    load = np.zeros(lanes, np.int64)
    for size, k in heap:
        load[k] = size
    order = np.argsort(-load, kind="stable")  # lanes that end early come last and are left out then
    ys, of = np.zeros((load.max(), lanes), np.int32), np.full((load.max(), lanes), -1, np.int32)
    first = np.ones((load.max(), lanes), bool)
    rng = np.random.default_rng(1)
    for k, q in enumerate(order):
        ds = np.array(lane[q])
        ds = ds[rng.permutation(len(ds))] if shuffled else ds
        sizes = [len(docs[d]) for d in ds]
        ys[: load[q], k], of[: load[q], k] = np.concatenate([docs[d] for d in ds]), np.repeat(ds, sizes)
        first[: load[q], k] = False
        first[np.concatenate([[0], np.cumsum(sizes)[:-1]]), k] = True
    xs = np.zeros_like(ys)
    xs[1:] = ys[:-1]
    xs[first] = 0
    active = (load[order][None] > np.arange(0, load.max(), steps)[:, None]).sum(1)
    for n, s in zip(active.tolist(), range(0, load.max(), steps)):
        yield xs[s : s + steps, :n], ys[s : s + steps, :n], first[s : s + steps, :n], of[s : s + steps, :n]


def begun(w: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """All weights in one vector, with Adam's two means of each and its number of steps."""
    flat = packed(w)
    return {"weights": flat, "m": np.zeros_like(flat), "v": np.zeros_like(flat), "steps": np.zeros(1, np.float32)}


def lanes_for(tokens: int) -> int:
    """Lanes for so many tokens: LANES, up to 16 times as many where enough updates remain."""
    return int(min(16 * LANES, max(LANES, tokens // 8192)))


def learn(state: dict[str, np.ndarray], symbols: int, chunks, tokens: int, lanes: int, begin: float = 0.0, end: float = 1.0) -> None:
    """Truncated backpropagation by Adam over lists of documents (symbols, with their end), changing state.

    The rate falls as from `begin` to `end` of a training; tokens is about their number in all chunks.
    """
    flat, m, v = state["weights"], state["m"], state["v"]
    w, grad = unpacked(flat, symbols), np.zeros_like(flat)
    g, work = unpacked(grad, symbols), np.empty_like(flat)
    updates, done = max(1, tokens // (lanes * STEPS)), 0
    for docs in chunks:
        h = None
        for x, y, first, of in streams(docs, lanes, STEPS, True):
            h = np.zeros((x.shape[1], HIDDEN), np.float32) if h is None else h[: x.shape[1]]
            h = _gradients(w, g, x, y, first, h, of >= 0)
            done += 1
            state["steps"] += 1
            step = float(state["steps"][0])
            norm = float(np.sqrt(np.vdot(grad, grad)))
            grad *= np.float32(min(1.0, 1.0 / max(norm, 1e-9)))
            rate = RATE * max(0.1, 1 - begin - (end - begin) * min(1.0, done / updates))
            m *= np.float32(0.9)
            m += np.multiply(grad, np.float32(0.1), out=work)
            np.multiply(grad, grad, out=work)
            work *= np.float32(0.01)
            v *= np.float32(0.99)
            v += work
            np.sqrt(v, out=work)
            work *= np.float32(1 / np.sqrt(1 - 0.99**step))
            work += np.float32(1e-6)
            np.divide(m, work, out=work)
            work *= np.float32(rate / (1 - 0.9**step))
            flat -= work


def train(docs: list[np.ndarray], symbols: int, counts: np.ndarray, epochs: int = 1) -> dict[str, np.ndarray]:
    """Weights after truncated backpropagation over the documents, in one task."""
    w = fresh(symbols, counts)
    state = begun(w)
    if docs:
        learn(state, symbols, [docs] * epochs, epochs * sum(map(len, docs)), LANES)
    return unpacked(state["weights"], symbols)


def score(w: dict, docs: list[np.ndarray], lanes: int = 512, steps: int = 32) -> np.ndarray:
    """Natural log probability of each whole document; the state is carried across windows."""
    total = np.zeros(len(docs))
    if not docs:
        return total
    table, h = _powers(w["embed"] @ w["inp"] + w["bias"]), None
    held, rows = [], 0

    def put() -> None:
        out, y, of = map(np.concatenate, zip(*held))
        total[:] += np.bincount(of, log_probs(w, out, y), minlength=len(docs))

    for x, y, first, of in streams(docs, lanes, steps):
        h = np.zeros((x.shape[1], HIDDEN), np.float32) if h is None else h[: x.shape[1]]
        out, h = states(w, table, x, first, h)
        there = of >= 0
        held.append((out[there], y[there], of[there]))
        rows += len(held[-1][1])
        if rows >= AT_ONCE:
            put()
            held, rows = [], 0
    if held:
        put()
    return total
