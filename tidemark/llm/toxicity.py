"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as the pooled vectors of its hashed character runs (lengths ``RUNS``, its edges marked), so that
inflected and unseen forms count, and a vector of its own where it is in the vocabulary; both are learned
with the rest, and there are no other inputs.  A forward and a backward gated recurrent layer read a window of
``WINDOW`` words; attention pools the states; a logistic unit scores the window.  A window begins at every
``STRIDE``-th word, so each word but those at the ends is read in two windows, and every window of a text
is scored; the text's score is the largest, calibrated.

Labels belong to documents, not windows.  Training begins with random windows under their documents'
labels: only words of toxic documents stand out in the mean.  Then it alternates: score all windows of the
training documents, and learn from each document's highest window (and a random one of clean
documents).  Training takes about ``SAMPLE_DOCS`` documents of each label, up to ``SAMPLE_CHARS`` characters of them
and ``SAMPLE_TEXT`` of one, whatever repeats or is long; every text is scored whole.

Defined results: null and empty texts, and texts without words, get a low constant score; where
nothing was learned every score is 0; rows with equal or null ids are all returned; columns that aren't
kept are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import fresh, map_arrow, pieces_of, release
from tidemark.llm.langid import sample

SAMPLE_DOCS = 1500
#: What the driver holds for training: characters of a label's documents together, and of one document.
SAMPLE_CHARS, SAMPLE_TEXT = 8_000_000, 1 << 17
WINDOW, STRIDE = 32, 16
HIDDEN, CHAR_DIM, WORD_DIM = 8, 16, 8
RUNS = (3, 4, 5)
CHAR_BUCKETS = 1 << 15
VOCABULARY = 8000
#: Passes over random windows, passes over the highest windows, windows a step, and the rate of learning.
WARM, ROUNDS, BATCH, RATE = 4, 4, 128, 0.01
#: A small sample is passed over again until the random windows gave so many steps, and each round so many.
WARM_STEPS, ROUND_STEPS = 120, 16
WORD_CACHE = 120_000
#: Windows computed at once, training windows whose words are projected at once, and words of a text laid out at once.
BLOCK, TURN, LAID_OUT = 512, 1 << 13, 1 << 18
#: Character runs hashed or gathered at once, whatever the words.
GATHERED = 1 << 18
#: The logit of a text without words.
WORDLESS = -4.0
#: The word that stands for positions past a text's end.
PAD = " "
WORDS = re.compile(r"[^\W_]+")
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if text else []


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def parts_of(sizes: np.ndarray, most: int = GATHERED) -> Iterator[slice]:
    """Slices of neighbours with at most ``most`` together; a larger one comes alone."""
    ends, at = np.cumsum(sizes), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield slice(at, to)
        at = to


def points_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def hashed(points: np.ndarray, n: int) -> np.ndarray:
    """Buckets of the runs of ``n`` characters, by where they begin."""
    places = max(0, len(points) - n + 1)
    h = np.full(places, n, np.uint64)
    for k in range(n):
        h = (h ^ points[k : places + k]) * GOLDEN
        h ^= h >> np.uint64(29)
    return ((h >> np.uint64(40)) % np.uint64(CHAR_BUCKETS)).astype(np.uint16)


def runs_of(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, first, many): hashed character runs word by word; where a word's begin, and how many it has (1 or more).

    Beside the result it holds what ``GATHERED`` characters need, however many or long the words are.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    many = sum(np.maximum(0, sizes - n + 1) for n in RUNS)
    first = np.cumsum(many) - many
    out = np.empty(int(many.sum()), np.uint16)
    for part in parts_of(sizes):
        to = int(first[part.start])
        if sizes[part.start] > GATHERED:
            marked = f"<{words[part.start]}>"
            for n in RUNS:
                for at in range(0, len(marked) - n + 1, GATHERED):
                    got = hashed(points_of(marked[at : at + GATHERED + n - 1]), n)
                    out[to : to + len(got)] = got
                    to += len(got)
            continue
        points = points_of("".join(f"<{w}>" for w in words[part]))
        word = np.repeat(np.arange(part.stop - part.start), sizes[part])
        found, owner = [], []
        for n in RUNS:
            inside = word[: max(0, len(points) - n + 1)] == word[n - 1 :]
            found.append(hashed(points, n)[inside])
            owner.append(word[: len(inside)][inside])
        got = np.concatenate(found)[np.argsort(np.concatenate(owner), kind="stable")]
        out[to : to + len(got)] = got
    return out, first, many


def tally(buckets: np.ndarray) -> np.ndarray:
    """How often each bucket is among them."""
    out = np.zeros(CHAR_BUCKETS, np.int64)
    for at in range(0, len(buckets), GATHERED):
        out += np.bincount(buckets[at : at + GATHERED], minlength=CHAR_BUCKETS)
    return out.astype(np.float32)


def pooled(table: np.ndarray, buckets: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """(words, CHAR_DIM): sums of the words' run vectors over the root of their number.

    Words with equally many runs are gathered together; one with more runs than there are buckets goes by its buckets' tally.
    """
    out = np.empty((len(first), CHAR_DIM), np.float32)
    for k in np.unique(many).tolist():
        same = np.flatnonzero(many == k)
        if k > CHAR_BUCKETS:
            for w in same:
                out[w] = tally(buckets[first[w] : first[w] + k]) @ table / np.float32(np.sqrt(k))
            continue
        step = max(1, (1 << 16) // k)
        for at in range(0, len(same), step):
            w = same[at : at + step]
            out[w] = table[buckets[first[w][:, None] + np.arange(k)]].sum(axis=1) / np.float32(np.sqrt(k))
    return out


def summed(rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values of ``at``, sums of the ``rows`` that share each)."""
    order = np.argsort(at, kind="stable")
    ranked = at[order]
    first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
    return ranked[first], np.add.reduceat(rows[order], first, axis=0)


@dataclass
class Network:
    p: dict[str, np.ndarray]
    vocabulary: dict[str, int]
    scale: tuple[float, float] = (1.0, 0.0)

    @classmethod
    def new(cls, vocabulary: dict[str, int], seed: int = 7) -> Network:
        r = np.random.default_rng(seed)
        size = CHAR_DIM + WORD_DIM
        p = {"C": r.normal(0, 0.1, (CHAR_BUCKETS, CHAR_DIM)), "E": r.normal(0, 0.1, (len(vocabulary) + 1, WORD_DIM))}
        p |= {"v": r.normal(0, 0.3, 2 * HIDDEN), "o": r.normal(0, 0.3, 2 * HIDDEN), "b": np.array([-1.0])}
        for d in "fb":
            p |= {f"W{d}": r.normal(0, 0.3, (size, 3 * HIDDEN)), f"U{d}": r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)), f"c{d}": np.zeros(3 * HIDDEN)}
        return cls({k: x.astype(np.float32) for k, x in p.items()}, vocabulary)

    def inputs(self, words: list[str]) -> np.ndarray:
        """(words, features), before the recurrent layers."""
        own = self.p["E"][[self.vocabulary.get(w, 0) for w in words]]
        return np.concatenate([pooled(self.p["C"], *runs_of(words)), own], axis=1)

    def projected(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Inputs of both layers' gates.  Row 0 pads: its update gate stays shut, so a state passes it unchanged."""
        out = []
        for d in "fb":
            y = x @ self.p[f"W{d}"] + self.p[f"c{d}"]
            y[0] = 0
            y[0, :HIDDEN] = -1e4
            out.append(y)
        return out[0], out[1]

    def windows(self, forward: np.ndarray, backward: np.ndarray, at: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Logits of windows: ``at`` (windows, WINDOW) are rows of the projected inputs, 0 where ``mask`` has no word.

        Units run along the first axis and windows along the last, so that every step works on whole rows.
        """
        n, length = at.shape
        states = np.empty((length, 2 * HIDDEN, n), np.float32)
        half = np.float32(0.5)
        for d, x, steps in (("f", forward, range(length)), ("b", backward, range(length - 1, -1, -1))):
            u, h = np.ascontiguousarray(self.p[f"U{d}"].T), np.zeros((HIDDEN, n), np.float32)
            gates = np.ascontiguousarray(x[at.T].transpose(0, 2, 1))
            low = HIDDEN * (d == "b")
            for t in steps:
                g, hu = gates[t], u @ h
                zr = g[: 2 * HIDDEN]  # sigmoid(y) = tanh(y / 2) / 2 + 1 / 2, in place
                zr += hu[: 2 * HIDDEN]
                zr *= half
                np.tanh(zr, out=zr)
                zr *= half
                zr += half
                c = hu[2 * HIDDEN :]
                c *= zr[HIDDEN:]
                c += g[2 * HIDDEN :]
                np.tanh(c, out=c)
                c -= h
                c *= zr[:HIDDEN]
                c += h
                h = c
                states[t, low : low + HIDDEN] = h
        weigh = np.matmul(self.p["v"], states)
        weigh[mask.T == 0] = -1e9
        weigh = np.exp(weigh - weigh.max(axis=0))
        weigh /= weigh.sum(axis=0)
        return (np.matmul(self.p["o"], states) * weigh).sum(axis=0) + self.p["b"][0]

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Back through attention and both layers: (parameter gradients, gradient of x); x: (windows, length, features)."""
        n, length, _ = x.shape
        g = {k: np.zeros_like(p) for k, p in self.p.items() if k not in "CE"}
        states = np.zeros((length, n, 2 * HIDDEN), np.float32)
        memo: dict[tuple[str, int], tuple] = {}
        for d, steps in (("f", range(length)), ("b", range(length - 1, -1, -1))):
            px, u, h = x @ self.p[f"W{d}"] + self.p[f"c{d}"], self.p[f"U{d}"], np.zeros((n, HIDDEN), np.float32)
            for t in steps:
                h, memo[d, t] = _step(px[:, t], h, u, mask[:, t : t + 1])
                states[t, :, HIDDEN * (d == "b") : HIDDEN * (d == "b") + HIDDEN] = h
        weigh = states @ self.p["v"]
        weigh[mask.T == 0] = -1e9
        weigh = np.exp(weigh - weigh.max(axis=0))
        weigh /= weigh.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weigh, states)
        err = (sigmoid(pooled @ self.p["o"] + self.p["b"][0]) - y) * weight / n
        g["b"][0], g["o"] = err.sum(), err @ pooled
        back = err[:, None] * self.p["o"]
        along = states @ self.p["o"] * err
        dw = weigh * (along - (weigh * along).sum(axis=0))
        g["v"] = np.einsum("tn,tnh->h", dw, states)
        ds = weigh[:, :, None] * back + dw[:, :, None] * self.p["v"]
        dx = np.zeros_like(x)
        for d, steps in (("f", range(length - 1, -1, -1)), ("b", range(length))):
            u, carry = self.p[f"U{d}"], np.zeros((n, HIDDEN), np.float32)
            for t in steps:
                h0, z, r, c = memo[d, t]
                m = mask[:, t : t + 1]
                dh = ds[t, :, HIDDEN * (d == "b") : HIDDEN * (d == "b") + HIDDEN] + carry
                carry, dh = dh * (1 - m), dh * m
                dc = dh * z * (1 - c * c)
                dz = dh * (c - h0) * z * (1 - z)
                hu = h0 @ u[:, 2 * HIDDEN :]
                dr = dc * hu * r * (1 - r)
                gates = np.concatenate([dz, dr, dc], axis=1)
                g[f"W{d}"] += x[:, t].T @ gates
                g[f"c{d}"] += gates.sum(axis=0)
                inner = np.concatenate([dz, dr, dc * r], axis=1)
                g[f"U{d}"] += h0.T @ inner
                dx[:, t] += gates @ self.p[f"W{d}"].T
                carry = carry + dh * (1 - z) + inner @ u.T
        return g, dx


def _step(x: np.ndarray, h: np.ndarray, u: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
    """One gated step from projected inputs: the new state (the old one under a zero mask) and what its gradient needs."""
    hu = h @ u
    gates = 1 / (1 + np.exp(-(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])))
    z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
    c = np.tanh(x[:, 2 * HIDDEN :] + r * hu[:, 2 * HIDDEN :])
    return h + mask * z * (c - h), (h, z, r, c)


def window_starts(n: int) -> range:
    return range(0, max(1, n - WINDOW + STRIDE), STRIDE)


def window_rows(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, rows, mask) of every window of several texts; row 0 pads."""
    owner, begin, left = window_places([len(x) for x in ids])
    return owner, *rows_at(np.concatenate([*ids, np.zeros(1, np.int32)]), begin, left)


def window_places(sizes: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, begin, left) of every window of several texts that lie one after the other: its first place, and the words from there to the text's end."""
    sizes = np.array(sizes, np.int64)
    many = np.array([len(window_starts(n)) if n else 0 for n in sizes], np.int64)
    owner = np.repeat(np.arange(len(sizes)), many)
    first = (np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)) * STRIDE
    return owner, (np.cumsum(sizes) - sizes)[owner] + first, sizes[owner] - first


def rows_at(flat: np.ndarray, begin: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, mask) of windows; ``flat``: all texts' rows and one more."""
    mask = np.arange(WINDOW) < left[:, None]
    return np.where(mask, flat[np.minimum(begin[:, None] + np.arange(WINDOW), len(flat) - 1)], 0), mask.astype(np.float32)


def numbered(texts: list[str]) -> tuple[np.ndarray, list[int], pa.Array]:
    """(rows, sizes, words): every word of the texts as its place among the sorted distinct ``words``, from 1, and a 0 at the end; words of each text.

    Words are held as bytes in one array, not as objects.
    """
    chunks = [pa.array([w.encode("utf-8", "surrogatepass") for w in words_of(t)], pa.binary()) for t in texts]
    sizes = [len(c) for c in chunks]
    coded = pa.chunked_array(chunks, pa.binary()).combine_chunks()
    del chunks
    coded = coded.dictionary_encode()
    order = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(order), np.int32)
    place[order] = np.arange(1, len(order) + 1)
    flat = np.append(place[coded.indices.to_numpy()], np.int32(0)) if len(order) else np.zeros(1, np.int32)
    return flat, sizes, coded.dictionary.take(pa.array(order))


def runs_of_all(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`runs_of` of the padding and all ``words``, of which few are text at a time."""
    found = [runs_of([PAD])]
    for at in range(0, len(words), LAID_OUT // 8):
        found.append(runs_of([w.decode("utf-8", "surrogatepass") for w in words.slice(at, LAID_OUT // 8).to_pylist()]))
    many = np.concatenate([m for _, _, m in found])
    return np.concatenate([b for b, _, _ in found]), np.cumsum(many) - many, many


def train(texts: list[str], labels: np.ndarray, prior: float, seed: int = 7) -> Network | None:
    """A calibrated network, or None if a label is missing.  ``prior``: the share of toxic documents at large."""
    if not len(labels) or labels.min() == labels.max():
        return None
    rng = np.random.default_rng(seed)
    flat, sizes, words = numbered(texts)
    among = np.zeros(len(words), np.int64)
    ends = np.cumsum(sizes)
    for at, size in zip(ends - sizes, sizes, strict=True):
        among[np.unique(flat[at : at + size]) - 1] += 1
    common = np.flatnonzero(among >= 3)
    named = [x.decode("utf-8", "surrogatepass") for x in words.take(pa.array(common)).to_pylist()]
    ranked = sorted(zip(named, common.tolist(), strict=True), key=lambda x: (-among[x[1]], x[0]))[:VOCABULARY]
    vocabulary = {w: i + 1 for i, (w, _) in enumerate(ranked)}
    net = Network.new(vocabulary, seed)
    own = np.zeros(len(words) + 1, np.int32)
    own[[i + 1 for _, i in ranked]] = np.arange(1, len(ranked) + 1)
    buckets, first, many = runs_of_all(words)
    owner, places, left = window_places(sizes)
    if not len(owner):
        return None
    begin = np.searchsorted(owner, np.arange(len(texts) + 1))
    held = np.flatnonzero(np.diff(begin))
    y_all = labels[owner].astype(np.float32)
    moments = {k: [np.zeros_like(p), np.zeros_like(p)] for k, p in net.p.items()}
    step = 0

    def scores() -> np.ndarray:
        out = []
        for turn in range(0, len(owner), TURN):
            rows, mask = rows_at(flat, places[turn : turn + TURN], left[turn : turn + TURN])
            distinct, back = np.unique(np.append(rows, 0), return_inverse=True)  # row 0 pads
            rows = back[:-1].reshape(rows.shape)
            sides = net.projected(np.concatenate([pooled(net.p["C"], buckets, first[distinct], many[distinct]), net.p["E"][own[distinct]]], axis=1))
            out += [net.windows(*sides, rows[at : at + BLOCK], mask[at : at + BLOCK]) for at in range(0, len(rows), BLOCK)]
        return np.concatenate(out)

    def highest(s: np.ndarray) -> np.ndarray:
        order = np.lexsort((s, owner))
        return order[np.concatenate([owner[order][1:] != owner[order][:-1], [True]])]

    def drawn() -> np.ndarray:
        return begin[held] + (rng.random(len(held)) * np.diff(begin)[held]).astype(np.int64)

    def gathered(words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(some of ``words``, their buckets one after the other, where each one's begin), but for words with more runs than buckets."""
        rest = np.flatnonzero(many[words] <= CHAR_BUCKETS)
        for part in parts_of(many[words[rest]]):
            some = rest[part]
            n = many[words[some]]
            ends = np.cumsum(n)
            yield some, buckets[np.arange(ends[-1]) - np.repeat(ends - n - first[words[some]], n)], ends - n

    def learn(use: np.ndarray, rate: float) -> None:
        nonlocal step
        for at in range(0, len(use), BATCH):
            part = use[at : at + BATCH]
            r, m = rows_at(flat, places[part], left[part])
            distinct, back = np.unique(r, return_inverse=True)
            n, root = many[distinct], np.sqrt(many[distinct], dtype=np.float32)[:, None]
            chars = np.empty((len(distinct), CHAR_DIM), np.float32)
            for some, cat, starts in gathered(distinct):
                chars[some] = np.add.reduceat(net.p["C"][cat], starts, axis=0) / root[some]
            large = np.flatnonzero(n > CHAR_BUCKETS)
            if len(large):
                chars[large] = pooled(net.p["C"], buckets, first[distinct[large]], n[large])
            x = np.concatenate([chars, net.p["E"][own[distinct]]], axis=1)[back.reshape(r.shape)]
            g, dx = net.gradients(x, m, y_all[part], np.ones(len(part), np.float32))
            _, dword = summed(dx.reshape(-1, CHAR_DIM + WORD_DIM), back.reshape(-1))
            step += 1
            spelled, along = np.zeros(CHAR_BUCKETS, bool), np.zeros((CHAR_BUCKETS, CHAR_DIM), np.float32)
            dchars = dword[:, :CHAR_DIM] / root
            for some, cat, _ in gathered(distinct):
                met, slope = summed(np.repeat(dchars[some], n[some], axis=0), cat)
                spelled[met] = True
                along[met] += slope
            for i in large:
                counts = tally(buckets[first[distinct[i]] : first[distinct[i]] + n[i]])
                spelled |= counts > 0
                along += counts[:, None] * dchars[i]
            for k, (met, slope) in (
                ("C", (np.flatnonzero(spelled), along[spelled])),
                ("E", summed(dword[:, CHAR_DIM:], own[distinct])),
            ):  # of the tables only rows that were met move
                a, b = moments[k]
                a[met] += 0.1 * (slope - a[met])
                b[met] += 0.01 * (slope * slope - b[met])
                net.p[k][met] -= rate * a[met] / (np.sqrt(b[met]) + 1e-4)
            for k, slope in g.items():
                a, b = moments[k]
                a += 0.1 * (slope - a)
                b += 0.01 * (slope * slope - b)
                net.p[k] -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)

    for _ in range(max(WARM, -(-WARM_STEPS * BATCH // (2 * len(held))))):
        learn(rng.permutation(np.concatenate([drawn(), drawn()])), RATE)
    for turn in range(ROUNDS):
        top = highest(scores())
        for _ in range(max(1, -(-ROUND_STEPS * BATCH // (2 * len(held))))):
            other = drawn()
            learn(rng.permutation(np.unique(np.concatenate([top, other[labels[owner[other]] == 0]]))), RATE / (1 + turn))
    s = scores()
    top = highest(s)
    y = labels[owner[top]].astype(float)
    weight = np.where(y == 1, prior / max(1, (labels == 1).sum()), (1 - prior) / max(1, (labels == 0).sum()))
    net.scale = _calibrated(s[top].astype(float), y, weight / weight.sum())
    return net


def _calibrated(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit by Newton's method, lightly held near (1, 0)."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * x + b)
        g = np.array([(w * (p - y) * x).sum() + 1e-3 * (a - 1), (w * (p - y)).sum() + 1e-4 * b])
        q = w * p * (1 - p)
        h = np.array([[(q * x * x).sum() + 1e-3, (q * x).sum()], [(q * x).sum(), q.sum() + 1e-4]])
        da, db = np.linalg.solve(h, g)
        a, b = a - float(np.clip(da, -1, 1)), b - float(np.clip(db, -2, 2))
    return max(a, 0.05), b


class Scorer:
    """A network with a bounded cache of words' projected inputs; one for each Python worker."""

    def __init__(self, net: Network):
        self.net = net
        self._reset()

    def _reset(self) -> None:
        self.rows: dict[str, int] = {PAD: 0}
        self.forward, self.backward = self.net.projected(self.net.inputs([PAD]))

    def _known(self, found: list[list[str]]) -> list[np.ndarray]:
        """The texts' words as rows of the projected inputs."""
        distinct = set(chain.from_iterable(found))
        new = list(distinct.difference(self.rows))
        if len(self.rows) + len(new) > WORD_CACHE:
            self._reset()
            new = list(distinct)
        if new:
            f, b = self.net.projected(self.net.inputs([PAD, *new]))
            self.rows.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
            self.forward, self.backward = np.concatenate([self.forward, f[1:]]), np.concatenate([self.backward, b[1:]])
        return [np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words)) for words in found]

    def score(self, texts: list[str | None]) -> np.ndarray:
        best = np.full(len(texts), -np.inf)
        some: list[int] = []
        laid: list[list[str]] = []
        for i, text in enumerate(texts):
            words = words_of(text)
            # a text beyond LAID_OUT words comes in parts, which share what their windows share
            for at in range(0, max(1, len(words) - (WINDOW - STRIDE)), LAID_OUT):
                some.append(i)
                laid.append(words[at : at + LAID_OUT + WINDOW - STRIDE])
                if sum(map(len, laid)) >= LAID_OUT:
                    self._score(some, laid, best)
                    some, laid = [], []
        self._score(some, laid, best)
        a, b = self.net.scale
        best[~np.isfinite(best)] = WORDLESS
        return sigmoid(a * best + b)

    def _score(self, some: list[int], laid: list[list[str]], best: np.ndarray) -> None:
        owner, rows, mask = window_rows(self._known(laid)) if laid else (np.zeros(0, np.int64),) * 3
        whose = np.array(some, np.int64)
        for at in range(0, len(owner), BLOCK):
            part = slice(at, at + BLOCK)
            np.maximum.at(best, whose[owner[part]], self.net.windows(self.forward, self.backward, rows[part], mask[part]))


def fit(docs: DataFrame, labels: DataFrame, *, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id", bound: int = SAMPLE_DOCS) -> Network | None:
    """Trained on the ``docs`` that ``labels`` (id and 0 or 1) calls; null texts and labels teach nothing.

    The labels are drawn first, about ``bound`` of each kind, so no text is shuffled but those drawn.  An id may have many
    rows in either table, and texts any length: rows that repeat id, label and text count once, and what the driver gets is
    bounded in rows and characters.
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.col(label_col).alias("_label")).distinct()
    counts = {int(r[0]): r[1] for r in known.groupBy("_label").count().collect()}
    if len(counts) < 2:
        return None
    drawn = F.broadcast(sample(known, "_label", ["_id"], bound, totals=counts))
    texts = docs.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("_doc"), F.substring(text_col, 1, SAMPLE_TEXT).alias("_text"))
    met = texts.join(drawn, F.col("_doc") == F.col("_id")).select("_id", "_label", "_text").distinct()
    w = Window.partitionBy("_label").orderBy(F.xxhash64("_id"), "_id", "_text").rowsBetween(Window.unboundedPreceding, 0)
    placed = met.withColumns({"_n": F.count(F.lit(1)).over(w), "_chars": F.sum(F.length("_text")).over(w)})
    few = placed.filter((F.col("_n") <= bound * 5 // 4) & (F.col("_chars") <= SAMPLE_CHARS))
    got = sorted((r[0], int(r[1])) for r in few.select("_text", "_label").collect())
    net = train([t for t, _ in got], np.array([y for _, y in got], np.int64), counts[1] / sum(counts.values()))
    release()
    return net


def score(docs: DataFrame, net: Network | None, *, keep: list[str], text_col: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns of each row, with its score under ``name``."""
    held = docs.sparkSession.sparkContext.broadcast(net)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema] + [f"`{name}` double"])

    def run(batches):
        scorer = Scorer(held.value) if held.value else None
        for b in pieces_of(batches):
            got = scorer.score(b.column(len(keep)).to_pylist()) if scorer else np.zeros(b.num_rows)
            yield pa.record_batch([*b.columns[: len(keep)], pa.array(got, pa.float64())], [*keep, name])

    return map_arrow(docs.select(*keep, F.col(text_col).alias(fresh("_text", keep))), run, schema)
