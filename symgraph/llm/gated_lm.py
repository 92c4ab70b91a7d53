"""The gated recurrent language model of operator 6, in numpy.

A GRU over token numbers; the next token's probability is P(class) * P(token | class) with about
sqrt(V) classes of about sqrt(V) tokens in order of frequency, so a step costs 2 * sqrt(V) outputs.
Training is truncated backpropagation through time: windows of ``STEPS`` tokens over parallel
streams, the state carried from window to window without gradient.  For scoring, many documents
run side by side in slots; each one's state starts at zero and is carried over all its windows.
"""

from __future__ import annotations

import copy
import heapq

import numpy as np

HIDDEN, STEPS, STREAMS, SLOTS = 32, 16, 96, 512


#: Rows of a softmax layer, and numbers of a table of weights, that are worked on at a time: they stay in a core's cache.
ROWS, NUMBERS = 512, 32768
#: Softmax layers whose logits are surely smaller than this need no shift before the exponentials.
SURE = 80.0


def _in_order(numbers: np.ndarray, below: int) -> np.ndarray:
    """The stable order of numbers from 0 to ``below`` - 1 (16 bits are sorted digit by digit)."""
    return np.argsort(numbers.astype(np.uint16) if below <= 1 << 16 else numbers, kind="stable")


def _sums_by(numbers: np.ndarray, rows: np.ndarray, often: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """(the distinct numbers, the sum of the rows of each); numbers are sorted. Those that come often are summed one by one, all others side by side."""
    first = np.flatnonzero(np.concatenate([[True], numbers[1:] != numbers[:-1]]))
    count = np.diff(np.append(first, len(numbers)))
    by_count = np.argsort(-count, kind="stable")
    first, count = first[by_count], count[by_count]
    sums, ones = rows.take(first, axis=0), np.ones(int(count[0]), rows.dtype)
    many = int(np.searchsorted(-count, -often))  # the numbers before this place come more than ``often`` times
    for i in range(many):
        np.dot(ones[: count[i]], rows[first[i] : first[i] + count[i]], out=sums[i])
    for i in range(1, often):
        to = int(np.searchsorted(-count, -i))
        sums[many:to] += rows.take(first[many:to] + i, axis=0)
    return numbers[first], sums


class GatedLM:
    """Token 0 ends a document; the state before a document's first token has just read token 0."""

    def __init__(self, counts: np.ndarray, hidden: int = HIDDEN, seed: int = 7, dtype=np.float32):
        rng, v = np.random.default_rng(seed), len(counts)
        self.v, self.h = v, hidden
        self.size = max(1, int(np.ceil(np.sqrt(v))))
        self.classes = -(-v // self.size)
        padded = np.zeros(self.classes * self.size)
        padded[:v] = counts + 0.5
        by_class = padded.reshape(self.classes, self.size)
        with np.errstate(divide="ignore"):
            inner = np.maximum(np.log(by_class / by_class.sum(axis=1, keepdims=True)), -1e9)
        self.real = by_class > 0
        self.p = {
            "E": rng.normal(0, 0.1, (v, 3 * hidden)), "U": rng.normal(0, 0.5 / hidden**0.5, (hidden, 3 * hidden)), "b": np.zeros(3 * hidden),
            "Wc": np.zeros((hidden, self.classes)), "bc": np.log(by_class.sum(axis=1) / by_class.sum()),
            "Wo": np.zeros((self.classes, hidden, self.size)), "bo": inner,
        }
        self.p["b"][:hidden] = 1.0  # keep the state at first
        self.p = {k: x.astype(dtype) for k, x in self.p.items()}

    def step(self, h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the gates z, r, c that led to them."""
        gates = self._read(x[None])[:, 0]
        out, u = np.empty((len(x), self.h), gates.dtype), np.empty_like(gates)
        self._move(np.asarray(h, gates.dtype), gates, self._by_gate(), u, out)
        return out, gates

    def _by_gate(self) -> np.ndarray:
        """U as one matrix a gate."""
        return np.ascontiguousarray(self.p["U"].reshape(self.h, 3, self.h).transpose(1, 0, 2))

    def _read(self, x: np.ndarray) -> np.ndarray:
        """E + b of tokens (steps, streams), gate by gate: (3, steps, streams, hidden)."""
        gates = self.p["E"].reshape(-1, self.h).take(x * 3 + np.arange(3)[:, None, None], axis=0)
        gates += self.p["b"].reshape(3, 1, 1, self.h)
        return gates

    @staticmethod
    def _move(h: np.ndarray, gates: np.ndarray, by_gate: np.ndarray, u: np.ndarray, out: np.ndarray) -> None:
        """The states after ``h`` into ``out``; ``gates`` holds what was read and gets z, r and c, ``u`` gets the products with U."""
        np.matmul(h, by_gate, out=u)
        zr, c = gates[:2], gates[2]
        zr += u[:2]
        zr *= 0.5  # 1 / (1 + exp(-x)) = tanh(x / 2) / 2 + 1 / 2
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        np.multiply(zr[1], u[2], out=out)
        c += out
        np.tanh(c, out=c)
        np.subtract(h, c, out=out)
        out *= zr[0]
        out += c

    def outputs(self, h: np.ndarray, y: np.ndarray, grads: dict | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """ln P of the tokens y after states h; with ``grads``, adds those of -sum and gives dh.

        Works on the rows in the order of their classes, so that each class is a slice.  Inside, the
        states end with a 1 and the weights with the biases.
        """
        p, n = self.p, self.h
        order = _in_order(y, self.v)
        hs, ys = np.ones((len(y), n + 1), h.dtype), y[order]
        hs[:, :n] = h.take(order, axis=0)
        cls = ys // self.size
        place = ys - cls * self.size
        wide = [-(-w // 8) * 8 for w in (self.classes, self.size)]  # whole vectors; what is added has a probability of 0
        wc, wo = np.zeros((n + 1, wide[0]), h.dtype), np.zeros((self.classes, n + 1, wide[1]), h.dtype)
        wc[n], wo[:, n] = -1e9, -1e9
        wc[:n, : self.classes], wc[n, : self.classes] = p["Wc"], p["bc"]
        wo[:, :n, : self.size], wo[:, n, : self.size] = p["Wo"], p["bo"]
        most = max(1.0, float(np.abs(h).max(initial=0)))
        sure_class = bool(np.abs(p["bc"]).max() + most * np.abs(p["Wc"]).sum(axis=0).max() < SURE)
        sure = (np.abs(p["bo"]).max(axis=1, where=self.real, initial=0) + most * np.abs(p["Wo"]).sum(axis=1).max(axis=1) < SURE).tolist()
        room = np.empty(ROWS * max(wide), h.dtype), np.arange(ROWS), np.ones(max(wide), h.dtype)
        found, totals = np.empty((2, len(y)), h.dtype), np.empty((2, len(y)), h.dtype)
        backs, slopes, slope, turned = (None, None), [None] * self.classes, None, [None] * self.classes
        if grads is not None:
            backs, slopes, slope = np.empty((2, *h.shape), h.dtype), np.zeros((self.classes, wide[1], n + 1), h.dtype), np.zeros((wide[0], n + 1), h.dtype)
            turned = np.ascontiguousarray(wo[:, :n].transpose(0, 2, 1))
        self._choose(hs, wc, wc[:n].T, cls, sure_class, room, found[0], totals[0], backs[0], slope)
        bounds = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        for k in range(self.classes):
            a, b = bounds[k], bounds[k + 1]
            if a < b:
                self._choose(hs[a:b], wo[k], turned[k], place[a:b], sure[k], room, found[1, a:b], totals[1, a:b], None if grads is None else backs[1, a:b], slopes[k])
        found -= np.log(totals, out=totals)
        out = np.empty_like(found[0])
        out[order] = found[0] + found[1]
        if grads is None:
            return out, None
        slope, slopes = slope[: self.classes], slopes[:, : self.size]
        grads["Wc"] += slope[:, :n].T
        grads["bc"] += slope[:, n]
        grads["Wo"] += slopes[:, :, :n].transpose(0, 2, 1)
        grads["bo"] += slopes[:, :, n] * self.real
        back = np.empty_like(h)
        back[order] = backs[0] + backs[1]
        return out, back

    @staticmethod
    def _choose(h: np.ndarray, weights: np.ndarray, turned: np.ndarray | None, chosen: np.ndarray, sure: bool, room: tuple, found: np.ndarray, total: np.ndarray, back: np.ndarray | None, slope: np.ndarray | None) -> None:
        """One softmax layer: the chosen logits and the sums of all exponentials; with ``back``, dh of -sum ln P into that, by the weights ``turned``, and the gradient of the weights, turned as well, into ``slope``."""
        width = weights.shape[1]
        for a in range(0, len(h), ROWS):
            some, sums = h[a : a + ROWS], total[a : a + ROWS]
            flat = room[0][: len(some) * width]
            x = np.matmul(some, weights, out=flat.reshape(len(some), width))
            if not sure:
                x -= x.max(axis=1, keepdims=True)
            at = room[1][: len(some)] * width
            at += chosen[a : a + ROWS]
            flat.take(at, out=found[a : a + ROWS], mode="clip")
            np.exp(flat, out=flat)
            np.dot(x, room[2][:width], out=sums)
            if back is not None:
                x *= (1 / sums)[:, None]
                flat[at] -= 1
                if a:
                    slope += x.T @ some
                else:
                    np.matmul(x.T, some, out=slope)
                np.matmul(x, turned, out=back[a : a + ROWS])

    def window(self, h: np.ndarray, x: np.ndarray, y: np.ndarray, fresh: np.ndarray, grads: dict) -> tuple[float, np.ndarray]:
        """One window (streams, steps): sum of ln P, last state; adds the gradients of -sum ln P."""
        n, (streams, steps) = self.h, x.shape
        by_gate, gates = self._by_gate(), self._read(x.T)
        u, before, states = np.empty_like(gates), np.empty_like(gates[0]), np.empty_like(gates[0])
        ends = [np.flatnonzero(fresh[:, t]) for t in range(steps)]
        for t in range(steps):
            before[t] = h
            before[t, ends[t]] = 0
            h = states[t]
            self._move(before[t], gates[:, t], by_gate, u[:, t], h)
        out, dh_all = self.outputs(states.reshape(-1, n), y.T.ravel(), grads)
        dh_all = dh_all.reshape(steps, streams, n)
        back_gate, dh = np.ascontiguousarray(by_gate.transpose(0, 2, 1)), np.zeros_like(states[0])
        moved, a, b = np.empty((3, streams, n), dh.dtype), np.empty_like(dh), np.empty_like(dh)
        for t in reversed(range(steps)):  # u becomes the gradient of h @ U, gates that of what was read
            z, r, c = gates[:, t]
            dz, dr, dc = u[:, t]
            dh += dh_all[t]
            np.subtract(1, z, out=a)
            np.multiply(a, dh, out=b)  # dh (1 - z)
            a *= z
            a *= dh  # dh z (1 - z)
            dh *= z
            np.subtract(before[t], c, out=dz)
            dz *= a
            c *= c
            np.subtract(1, c, out=c)
            c *= b
            np.subtract(1, r, out=a)
            a *= r
            a *= c
            np.multiply(a, dc, out=dr)  # dc was h @ U of the third gate
            np.multiply(c, r, out=dc)
            z[:], r[:] = dz, dr
            np.matmul(u[:, t], back_gate, out=moved)
            for part in moved:
                dh += part
            dh[ends[t]] = 0
        for k in range(3):
            grads["U"][:, k * n : (k + 1) * n] += before.reshape(-1, n).T @ u[k].reshape(-1, n)
        read = x.T.ravel()
        order = _in_order(read, self.v)
        rows = gates.reshape(-1, n).take(order[:, None] + np.arange(3) * len(read), axis=0)
        numbers, sums = _sums_by(read[order], rows.reshape(-1, 3 * n))
        grads["E"][numbers] += sums
        grads["b"] += sums.sum(axis=0)
        return float(out.sum()), h

    def train(self, docs: list[np.ndarray], epochs: int = 1, rate: float = 0.01, streams: int = STREAMS, steps: int = STEPS, falling: bool = True, adam: dict | None = None) -> None:
        """Adam over the documents, laid end to end in ``streams`` streams of equal length (the first ones a token longer).

        The embeddings and moments of tokens that a window does not read are left as they are.
        ``adam`` carries the moments from call to call; with ``falling`` the rate falls over the call.
        """
        if not docs:
            return
        y = np.concatenate(docs)
        streams = max(1, min(streams, len(y) // steps))
        length, longer = divmod(len(y), streams)
        x = np.concatenate([[0], y[:-1]])
        starts = np.arange(streams) * length + np.minimum(np.arange(streams), longer)
        adam = {} if adam is None else adam
        if not adam:
            adam.update(done=0, moments={k: (np.zeros_like(a), np.zeros_like(a)) for k, a in self.p.items()}, grads={k: np.zeros_like(a) for k, a in self.p.items()})
        parts = [(a, min(a + steps, length), streams) for a in range(0, length, steps)] + [(length, length + 1, longer)] * (longer > 0)
        total, here = epochs * len(parts), 0
        for _ in range(epochs):
            h = np.zeros((streams, self.h), self.p["U"].dtype)
            for a, b, n in parts:
                at = starts[:n, None] + np.arange(a, b)
                x_now = x[at]
                _, h = self.window(h[:n], x_now, y[at], (x_now == 0).astype(h.dtype), adam["grads"])
                here += 1
                self._descend(adam, np.flatnonzero(np.bincount(x_now.ravel(), minlength=self.v)), 1 / (at.size if a < length else streams * steps), rate * (1 - 0.9 * here / total if falling else 1))

    def _descend(self, adam: dict, read: np.ndarray, scale: float, rate: float) -> None:
        """One step of Adam by the gradients in ``adam``, which are zeros again afterwards.

        Gradients are held within -1 and 1; those of the outputs' weights are means of numbers that are.
        The moments are ten and a hundred times the usual ones.
        """
        adam["done"] += 1
        fix_m, fix_v = 1 - 0.9 ** adam["done"], 1 - 0.99 ** adam["done"]
        pace = 0.1 * rate / fix_m
        spread, least = 0.1 / (fix_v**0.5 * pace), 1e-8 / pace
        for k, whole in adam["grads"].items():
            arrays, some = [self.p[k], whole, *adam["moments"][k]], k == "E"
            if some:
                each = max(1, NUMBERS // whole.shape[1])
                parts = [read[i : i + each] for i in range(0, len(read), each)]
            else:
                arrays, parts = [a.reshape(-1) for a in arrays], [slice(i, i + NUMBERS) for i in range(0, whole.size, NUMBERS)]
            for at in parts:
                p, g, m, v = (a.take(at, axis=0) for a in arrays) if some else (a[at] for a in arrays)
                g *= scale
                if k in ("E", "U", "b"):
                    np.minimum(g, 1, out=g)
                    np.maximum(g, -1, out=g)
                m *= 0.9
                m += g
                v *= 0.99
                g *= g
                v += g
                np.sqrt(v, out=g)
                g *= spread
                g += least
                np.divide(m, g, out=g)
                p -= g
                if some:
                    arrays[0][at], arrays[2][at], arrays[3][at] = p, m, v
                arrays[1][at] = 0

    def copy(self) -> GatedLM:
        """The same model with weights of its own."""
        out = copy.copy(self)
        out.p = {k: a.copy() for k, a in self.p.items()}
        return out

    def weights(self) -> np.ndarray:
        """All weights in one row."""
        return np.concatenate([a.ravel() for a in self.p.values()])

    def put(self, row: np.ndarray) -> None:
        """The reverse of ``weights``."""
        at = 0
        for k, a in self.p.items():
            self.p[k] = row[at : at + a.size].reshape(a.shape).astype(a.dtype)
            at += a.size

    def log_likelihood(self, docs: list[np.ndarray], slots: int = SLOTS, steps: int = 64) -> np.ndarray:
        """ln P of each whole document (an array of tokens that ends with token 0)."""
        slots = max(1, min(slots, len(docs)))
        load, lanes = [(0, i) for i in range(slots)], [[] for _ in range(slots)]
        for i in sorted(range(len(docs)), key=lambda i: -len(docs[i])):
            size, lane = heapq.heappop(load)
            lanes[lane].append(i)
            heapq.heappush(load, (size + len(docs[i]), lane))
        lanes = sorted((lane for lane in lanes if lane), key=lambda lane: -sum(len(docs[i]) for i in lane))
        sizes = np.array([sum(len(docs[i]) for i in lane) for lane in lanes], np.int64)
        longest = int(sizes.max(initial=0))
        tokens, owner = np.zeros((longest, len(lanes)), np.int32), np.zeros((longest, len(lanes)), np.int32)
        for row, lane in enumerate(lanes):
            tokens[: sizes[row], row] = np.concatenate([docs[i] for i in lane])
            owner[: sizes[row], row] = np.repeat(np.array(lane, np.int32), [len(docs[i]) for i in lane])
        alive = np.searchsorted(-sizes, -np.arange(longest)).tolist()  # lanes are sorted, longest first
        out, ready, by_gate, kind = np.zeros(len(docs)), (self.p["E"] + self.p["b"]).reshape(-1, self.h), self._by_gate(), self.p["U"].dtype
        h, last = np.zeros((len(lanes), self.h), kind), np.zeros(len(lanes), np.int32)
        room, moved, seen = np.empty((2, 3 * h.size), kind), np.empty_like(h), np.empty((steps * len(lanes), self.h), kind)
        for a in range(0, longest, steps):
            z = min(a + steps, longest)
            ends = np.cumsum([0, *alive[a:z]]).tolist()
            for t in range(a, z):
                n = alive[t]
                before = moved[:n]
                before[:] = h[:n]
                last = last[:n]
                before[last == 0] = 0
                gates, u = (x[: 3 * n * self.h].reshape(3, n, self.h) for x in room)
                np.take(ready, last * 3 + np.arange(3)[:, None], axis=0, out=gates, mode="clip")
                h = seen[ends[t - a] : ends[t - a + 1]]
                self._move(before, gates, by_gate, u, h)
                last = tokens[t]
            h = h.copy()
            y = np.concatenate([tokens[t, : alive[t]] for t in range(a, z)])
            found, _ = self.outputs(seen[: ends[-1]], y)
            out += np.bincount(np.concatenate([owner[t, : alive[t]] for t in range(a, z)]), found, len(docs))
        return out
