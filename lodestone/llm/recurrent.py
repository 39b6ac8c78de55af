"""A gated recurrent language model in numpy: class-factored softmax, truncated backpropagation, states carried on.

Words and buckets of words have numbers from 0 to CLASSES * SLOTS - 1; class = number // SLOTS. The probability of a
number is that of its class times that of the number in its class.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np

from lodestone.llm.text import gather

CLASSES, SLOTS, HIDDEN = 40, 40, 32
#: Steps of a window of truncated backpropagation, steps of a window of scoring; most lanes that run side by side.
STEPS, SCORE_STEPS, LANES, SCORE_LANES = 16, 64, 512, 512
#: Windows of scoring are up to so many times longer where lanes are fewer, so that they hold as many words.
LONGER = 8
#: Windows that a replica's training is to have before it gets more lanes, and lanes at least.
WINDOWS, FEW_LANES = 256, 8
#: Words, in the order of their classes, whose outputs are worked on together: what they need stays in a core's cache.
BLOCK = 1024
RATE = 0.01
ONE, TWO = np.array(1, np.float32), np.array(2, np.float32)
#: Tokens that one lane is trained on in a run, and tokens before a later part of a text that set its state.
PART, WARM = 4096, 64


def softmax(x: np.ndarray, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-probability of each column's picked row, and what each column's exponentials, which take the place of x, add up to."""
    x -= x.max(axis=0)
    picked = x[pick, np.arange(x.shape[1])]
    np.exp(x, out=x)
    total = x.sum(axis=0)
    return picked - np.log(total), total


def apart(m: np.ndarray) -> np.ndarray:
    """The columns of the gates z and r and of the candidate as three matrices, so that each is worked on in one piece, times what their sigmoids' exponentials take."""
    out = np.ascontiguousarray(m.reshape(len(m), 3, HIDDEN).swapaxes(0, 1))
    out *= np.array([-1, -1, -2], out.dtype)[:, None, None]
    return out


def begins(text: np.ndarray) -> dict[int, np.ndarray]:
    """The lanes that begin a text, for each step with any."""
    step, lane = np.nonzero(text < 0)
    edge = np.flatnonzero(np.r_[True, step[1:] != step[:-1]]) if len(step) else step
    return dict(zip(step[edge].tolist(), np.split(lane, edge[1:])))


def sums_by(number: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers in order, and the sum of each one's rows: a run of n rows is added up in pieces of the powers of two that n is made of."""
    order = np.argsort(number.astype(np.uint16), kind="stable")  # numbers are two bytes long
    number = number[order]
    head = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    n = np.diff(np.r_[head, len(number)])
    out = np.zeros((len(head), rows.shape[1]), rows.dtype)
    for bit in range(int(n.max()).bit_length()):
        some = np.flatnonzero(n >> bit & 1)
        first = head[some] + (n[some] >> bit + 1 << bit + 1)
        piece = rows.take(order[first[:, None] + np.arange(1 << bit)], axis=0)
        out[some] += (np.ones((1, 1 << bit), rows.dtype) @ piece if bit else piece)[:, 0]
    return number[head], out


def lanes_of(lengths: np.ndarray, most: int) -> list[list[int]]:
    """Texts dealt to lanes, the longest first to the lane with the least so far; no more lanes than fill up beside the longest text."""
    if not len(lengths):
        return []
    n = int(max(1, min(most, len(lengths), lengths.sum() // max(1, lengths.max()))))
    heap, lanes = [(0, i) for i in range(n)], [[] for _ in range(n)]
    for t in np.argsort(-lengths, kind="stable"):
        load, i = heapq.heappop(heap)
        lanes[i].append(int(t))
        heapq.heappush(heap, (load + int(lengths[t]), i))
    return lanes


def lanes_for(words: int) -> int:
    """Lanes for training on so many words: more only as far as WINDOWS updates are left."""
    return max(FEW_LANES, min(LANES, words // (STEPS * WINDOWS)))


def parted(ids: np.ndarray, at: np.ndarray, start: int) -> tuple[np.ndarray, ...]:
    """Texts in parts of PART words, so that lanes are of even length: words, offsets, what each part's first step reads, and whether a word is learnt from.

    A later part begins WARM words early, on which only its state is run up; each word is learnt from in one part.
    """
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), -(-n // PART))
    nth = np.arange(len(text)) - np.searchsorted(text, text)
    begin = at[:-1][text] + nth * PART
    warm = np.where(nth > 0, WARM, 0)
    size = np.minimum(begin + PART, at[1:][text]) - begin + warm
    where = gather(begin - warm, size)
    first = np.where(nth > 0, ids[np.maximum(begin - warm - 1, 0)] if len(ids) else 0, start)
    return ids[where], np.r_[0, np.cumsum(size)], first, where >= np.repeat(begin, size)


def matrices(ids: np.ndarray, at: np.ndarray, most: int, learn: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Steps by lanes: the number of the word, -1 where a lane has ended; the text it belongs to, as -text - 1 at its first word; whether it counts."""
    lanes = lanes_of(np.diff(at), most)
    steps = max((sum(int(at[t + 1] - at[t]) for t in lane) for lane in lanes), default=0)
    word, text, counts = np.full((steps, len(lanes)), -1, np.int32), np.zeros((steps, len(lanes)), np.int32), np.zeros((steps, len(lanes)), bool)
    for i, lane in enumerate(lanes):
        k = 0
        for t in lane:
            n = int(at[t + 1] - at[t])
            word[k : k + n, i] = ids[at[t] : at[t + 1]]
            text[k : k + n, i] = t
            counts[k : k + n, i] = True if learn is None else learn[at[t] : at[t + 1]]
            if n:
                text[k, i] = -t - 1
            k += n
    return word, text, counts


class Gru:
    """Weights as one float32 vector w, with named views."""

    SHAPES = {"x": (CLASSES * SLOTS, 3 * HIDDEN), "b": (3 * HIDDEN,), "u": (HIDDEN, 3 * HIDDEN), "wc": (HIDDEN, CLASSES), "bc": (CLASSES,), "wm": (CLASSES, HIDDEN, SLOTS), "bm": (CLASSES, SLOTS)}

    def __init__(self, w: np.ndarray):
        self.w, at = w, 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, w[at : at + n].reshape(shape))
            at += n

    @classmethod
    def fresh(cls, mass: np.ndarray, seed: int = 3) -> Gru:
        """Small random weights; the biases give each word its share `mass` of all words, whatever the state."""
        rng = np.random.default_rng(seed)
        m = cls((rng.standard_normal(sum(int(np.prod(s)) for s in cls.SHAPES.values())) * 0.08).astype(np.float32))
        share = np.maximum(mass, 1e-12).reshape(CLASSES, SLOTS)
        m.b[:], m.wc[:], m.wm[:] = 0, 0, 0
        m.bc[:] = np.log(share.sum(axis=1))
        m.bm[:] = np.log(share / share.sum(axis=1, keepdims=True))
        return m

    def step(self, old: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """One step from the states old and the inputs' part x of the gates: what forward gives."""
        out = [np.empty(s, np.float32) for s in (old.shape, (3, *old.shape), old.shape)]
        self.forward(old, apart(x), apart(self.u), *out)
        return tuple(out)

    @staticmethod
    def forward(old: np.ndarray, x: np.ndarray, u: np.ndarray, new: np.ndarray, a: np.ndarray, n: np.ndarray) -> None:
        """A step from the states old, with x and u apart: new states into new; the gates z and r, and -2 times the states' part of the candidate, into a; the candidate into n."""
        np.matmul(old, u, out=a, casting="same_kind")
        zr = a[:2]
        zr += x[:2]
        np.exp(zr, out=zr)
        zr += ONE
        np.reciprocal(zr, out=zr)
        np.multiply(a[1], a[2], out=n)
        n += x[2]
        np.exp(n, out=n)  # tanh(y) is 2 / (1 + exp(-2 y)) - 1
        n += ONE
        np.divide(TWO, n, out=n)
        n -= ONE
        np.subtract(old, n, out=new)
        new *= a[0]
        new += n

    def run(self, word: np.ndarray, text: np.ndarray, h: np.ndarray, before: np.ndarray, start: int | np.ndarray, kept: bool = True) -> tuple[np.ndarray, ...]:
        """What each step reads, the lanes that begin a text at a step, by step, the states before each step, gates and candidates' parts, candidates (these three of the last step alone, unless kept) and states after."""
        read = self.inputs(word, text, before, start).astype(np.intp)
        every, u = apart(self.x + self.b), apart(self.u)
        begin = begins(text)
        steps, lanes = word.shape
        some = steps if kept else 1
        old, n, states = (np.empty((k, lanes, HIDDEN), np.float32) for k in (some, some, steps))
        a, x = np.empty((some, 3, lanes, HIDDEN), np.float32), np.empty((3, lanes, HIDDEN), np.float32)
        with np.errstate(over="ignore"):  # 1 / (1 + infinity) is the limit
            for i in range(steps):
                k = i if kept else 0
                if kept or i in begin:
                    old[k] = h
                    h = old[k]
                    if i in begin:
                        h[begin[i]] = 0
                every.take(read[i], axis=1, out=x, mode="clip")
                self.forward(h, x, u, states[i], a[k], n[k])
                h = states[i]
        return read, begin, old, a, n, states

    def inputs(self, word: np.ndarray, text: np.ndarray, before: np.ndarray, start: int | np.ndarray) -> np.ndarray:
        """The number that each step reads: the word before, or at the first word of a text start, or start[text]."""
        last = np.vstack([before[None], word[:-1]])
        return np.where(text < 0, start if np.ndim(start) == 0 else start[np.maximum(-text - 1, 0)], np.maximum(last, 0))

    def outputs(self, states: np.ndarray, word: np.ndarray, grad: Gru | None = None) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural log-probabilities of the words from the states before them, 0 for words below 0; with grad, adds the weights' gradients and gives the states'."""
        klass = (word // SLOTS).astype(np.int16)
        order = np.argsort(klass, kind="stable")
        order = order[np.searchsorted(klass[order], 0) :]
        logp, back = np.zeros(len(word)), np.zeros_like(states) if grad is not None else None
        for k in range(0, len(order), BLOCK):
            own = order[k : k + BLOCK]
            s, of, nth = states.take(own, axis=0), klass[own], np.arange(len(own))
            slot = word[own] % SLOTS
            edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1], True])
            runs = [(of[i], slice(i, j)) for i, j in zip(edge[:-1].tolist(), edge[1:].tolist())]
            x = np.empty((CLASSES + SLOTS, len(own)), self.w.dtype)  # a column for each word
            of_class, in_class = x[:CLASSES], x[CLASSES:]
            np.matmul(self.wc.T, s.T, out=of_class)
            of_class += self.bc[:, None]
            for c, run in runs:
                part = in_class[:, run]
                np.matmul(self.wm[c].T, s[run].T, out=part)
                part += self.bm[c][:, None]
            (log_class, total), (log_slot, total_in) = softmax(of_class, of), softmax(in_class, slot)
            logp[own] = log_class + log_slot
            if grad is not None:
                of_class *= 1 / total
                in_class *= 1 / total_in
                of_class[of, nth] -= 1
                in_class[slot, nth] -= 1
                grad.wc += s.T @ of_class.T
                grad.bc += of_class.sum(axis=1)
                grad.bm[of[edge[:-1]]] += np.add.reduceat(in_class, edge[:-1], axis=1).T
                d = of_class.T @ self.wc.T
                for c, run in runs:
                    part = in_class[:, run].T
                    grad.wm[c] += s[run].T @ part
                    d[run] += part @ self.wm[c].T
                back[own] = d
        return logp, back

    def score(self, ids: np.ndarray, at: np.ndarray, start: int) -> np.ndarray:
        """Natural log-probability of each whole text; states go on from window to window until the text ends."""
        word, text, _ = matrices(ids, at, SCORE_LANES)
        out = np.zeros(len(at) - 1)
        h, before = np.zeros((word.shape[1], HIDDEN), np.float32), np.zeros(word.shape[1], np.int32)
        k = 0
        while k < len(word):
            steps = SCORE_STEPS * min(LONGER, max(1, SCORE_LANES // len(h)))
            w, t = word[k : k + steps], text[k : k + steps]
            live = np.flatnonzero(w[0] >= 0)
            w, t, h, before = w[:, live], t[:, live], h[live], before[live]
            if k and len(live) < word.shape[1]:
                word, text = word[:, live], text[:, live]
            states = self.run(w, t, h, before, start, kept=False)[-1]
            h = states[-1]
            logp, _ = self.outputs(states.reshape(-1, HIDDEN), w.reshape(-1))
            of = t.reshape(-1)
            out += np.bincount(np.where(of < 0, -of - 1, of), weights=logp, minlength=len(out))
            before, k = w[-1], k + steps
        return out

    def train(self, ids: np.ndarray, at: np.ndarray, start: int, adam: Adam, lanes: int = LANES) -> int:
        """One pass over the texts, an update a window. Returns the words learnt from."""
        ids, at, first, learn = parted(ids, at, start)
        word, text, counts = matrices(ids, at, lanes, learn)
        h, before = np.zeros((word.shape[1], HIDDEN), np.float32), np.zeros(word.shape[1], np.int32)
        for k in range(0, len(word), STEPS):
            own = slice(k, k + STEPS)
            h, before = self.window(word[own], text[own], h, before, first, adam, counts[own])
        return int(counts.sum())

    def window(self, w: np.ndarray, t: np.ndarray, h: np.ndarray, before: np.ndarray, start: int | np.ndarray, adam: Adam, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        read, begin, old, a, n, states = self.run(w, t, h, before, start)
        grad = Gru(np.zeros_like(self.w))
        real = w >= 0 if counts is None else counts
        _, back = self.outputs(states.reshape(-1, HIDDEN), np.where(real, w, -1).reshape(-1), grad)
        ds = back.reshape(states.shape)
        da, parts, du = np.empty((3, *h.shape), np.float32), np.empty((3, *h.shape), np.float32), np.zeros((3, HIDDEN, HIDDEN), np.float32)
        carry, less, to_n = np.zeros_like(h), np.empty_like(h), np.empty_like(h)
        down = np.ascontiguousarray(self.u.reshape(HIDDEN, 3, HIDDEN).transpose(1, 2, 0))
        flat = np.empty((*w.shape, 3, HIDDEN), np.float32)
        for i in reversed(range(len(w))):
            d, (z, r, an), (to_z, to_r, _) = ds[i], a[i], da
            d += carry
            np.subtract(ONE, z, out=less)
            np.multiply(n[i], n[i], out=to_n)
            np.subtract(ONE, to_n, out=to_n)
            to_n *= less
            to_n *= d
            np.subtract(old[i], n[i], out=to_z)
            to_z *= z
            to_z *= less
            to_z *= d
            np.subtract(r, ONE, out=less)
            less *= 0.5  # an is -2 times the part
            np.multiply(an, r, out=to_r)
            to_r *= less
            to_r *= to_n
            np.multiply(to_n, r, out=da[2])
            np.matmul(da, down, out=parts)
            du += old[i].T @ da
            np.multiply(d, z, out=carry)
            for part in parts:
                carry += part
            if i in begin:
                carry[begin[i]] = 0
            for k, part in enumerate((to_z, to_r, to_n)):
                flat[i, :, k] = part
        grad.u += np.hstack(du)
        flat = flat.reshape(-1, 3 * HIDDEN)
        some, sums = sums_by(read.reshape(-1), flat)
        grad.x[some] += sums
        grad.b += sums.sum(axis=0)
        adam.update(self.w, grad.w / max(1, int(real.sum())))
        return states[-1], w[-1]


class Adam:
    """Steps of Adam; later rounds take smaller ones."""

    def __init__(self, n: int, turn: int = 0, rate: float = RATE):
        self.m, self.v, self.k, self.rate = np.zeros(n, np.float32), np.zeros(n, np.float32), 0, rate / (1 + turn)

    def update(self, w: np.ndarray, g: np.ndarray) -> None:
        self.k += 1
        move = g - self.m
        move *= np.float32(0.1)
        self.m += move
        np.multiply(g, g, out=move)
        move -= self.v
        move *= np.float32(0.01)
        self.v += move
        np.sqrt(self.v, out=move)
        move += np.float32(1e-8)
        np.divide(self.m, move, out=move)
        move *= np.float32(self.rate * np.sqrt(1 - 0.99**self.k) / (1 - 0.9**self.k))
        w -= move


def held(pieces: Iterator[tuple[np.ndarray, np.ndarray]], most: int) -> Iterator[tuple[list[int], np.ndarray, np.ndarray]]:
    """Joins runs of texts (ids, offsets) until they have `most` words, so that lanes fill; gives the texts of each run, and all ids and offsets."""
    ids, sizes, n = [], [], 0
    for own, at in pieces:
        ids.append(own)
        sizes.append(np.diff(at))
        n += len(own)
        if n >= most:
            yield [len(s) for s in sizes], np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(sizes))]
            ids, sizes, n = [], [], 0
    if sizes:
        yield [len(s) for s in sizes], np.concatenate(ids), np.r_[0, np.cumsum(np.concatenate(sizes))]
