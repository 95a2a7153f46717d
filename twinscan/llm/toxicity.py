"""Toxicity: a bidirectional gated recurrent network with attention pooling, in numpy.

Inputs of a word: an embedding of the whole lower-case word and the mean embedding of its character
n-grams (the word's beginnings of 4 and 5 bytes, and its trigrams), both hashed into tables of fixed
size. Words run through a forward and a backward gated recurrent unit; attention pools the states of
a window, and a logistic unit scores it. Inside, softsign x / (1 + |x|) takes the place of the hyperbolic
tangent, and (1 + softsign) / 2 that of the sigmoid: a tangent takes numpy several times as long as all the rest. A text's score is that of its worst window, over the windows
of 24 words that start at every word, to the last; a shorter text is one window.

Labels hold for whole texts, so learning is over instances in bags: each round takes every text's
worst window under the present model (under word counts in the first round), besides a random one of
clean texts. Margins of a held-back part of the sample calibrate the score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import bounded_batches
from .quality import _logistic
from .wordgrid import Words, mix, words

WINDOW = 24
WORD_BITS, CHAR_BITS = 14, 13
DIM, HIDDEN, ATTEND = 6, 6, 4
BLOCK = 8192  # starts of windows that are run together


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _soft(x: np.ndarray) -> np.ndarray:
    """Softsign; its slope is (1 - |softsign|)**2."""
    return x / (1 + np.abs(x))


def _soften(x: np.ndarray, room: np.ndarray) -> None:
    """Softsign in place."""
    np.abs(x, out=room)
    room += 1
    x /= room


@dataclass
class Lexicon:
    """Distinct words of a chunk: table rows of the word and of its character n-grams."""

    word: np.ndarray  # row of each distinct word
    gram: np.ndarray  # rows of n-grams, word after word
    at: np.ndarray  # where each word's n-grams begin


def _letters(chunk: Words) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words without marks around them (all-mark words stay)."""
    data = chunk.lower
    letter = ((data >= 97) & (data <= 122)) | (data >= 0x80) | ((data >= 48) & (data <= 57))
    before = np.concatenate([[0], np.cumsum(letter)])
    some = before[chunk.ends] > before[chunk.starts]
    at = np.flatnonzero(letter)
    if not len(at):
        return chunk.starts, chunk.ends
    first = at[np.minimum(np.searchsorted(at, chunk.starts), len(at) - 1)]
    last = at[np.maximum(np.searchsorted(at, chunk.ends) - 1, 0)] + 1
    return np.where(some, first, chunk.starts), np.where(some, last, chunk.ends)


def lexicon(chunk: Words) -> tuple[Lexicon, np.ndarray]:
    """The chunk's distinct words, and each word's index among them."""
    starts, ends = _letters(chunk)
    data = chunk.lower
    if not len(starts):
        return Lexicon(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)), np.zeros(0, np.int64)
    _, one, index = np.unique(chunk.hash, return_index=True, return_inverse=True)
    a, b = starts[one], ends[one]
    size = b - a
    # hash of the letters alone
    place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    byte = data[np.repeat(a, size) + place].astype(np.uint64)
    seat = np.repeat(np.arange(len(a)), size)
    value = mix(byte + (place.astype(np.uint64) << np.uint64(8)), 11)
    begin = np.cumsum(size) - size
    key = np.add.reduceat(value, begin)
    word = (mix(key, 12) >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    # beginnings of 4 and 5 bytes: sums of the first positions' values
    rows, owner = [], []
    for n in (4, 5):
        part = np.where(place < n, value, np.uint64(0))
        rows.append(mix(np.add.reduceat(part, begin), 20 + n))
        owner.append(np.arange(len(a)))
    if len(byte) >= 3:
        three = (byte[:-2] << np.uint64(16)) | (byte[1:-1] << np.uint64(8)) | byte[2:]
        inside = seat[2:] == seat[:-2]
        rows.append(mix(three[inside], 13))
        owner.append(seat[:-2][inside])
    rows, owner = np.concatenate(rows), np.concatenate(owner)
    order = np.argsort(owner, kind="stable")
    gram = (rows[order] >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
    return Lexicon(word, gram, np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(a)))])), index.reshape(-1)


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, number of words and text of every window; a text without words has none.

    A window starts at every word that has ``WINDOW`` words from there on.
    """
    size = np.diff(at)
    count = np.where(size > 0, 1 + np.maximum(0, size - WINDOW), 0)
    text = np.repeat(np.arange(len(size)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    first = at[:-1][text] + k
    return first, np.minimum(size[text], WINDOW), text


@dataclass
class Network:
    p: dict[str, np.ndarray] = field(default_factory=dict)
    slope: float = 1.0
    shift: float = 0.0
    empty: float = 0.0  # score of a text without words

    @staticmethod
    def new(seed: int = 3) -> Network:
        r = np.random.default_rng(seed)
        h, d = HIDDEN, 2 * DIM
        p = {"word": np.zeros((1 << WORD_BITS, DIM)), "char": r.normal(0, 0.1, (1 << CHAR_BITS, DIM))}
        for way in "fb":
            p[f"x{way}"] = r.normal(0, d**-0.5, (d, 3 * h))
            p[f"u{way}"] = r.normal(0, h**-0.5, (h, 3 * h))
            p[f"b{way}"] = np.zeros(3 * h)
        p |= {"a": r.normal(0, h**-0.5, (2 * h, ATTEND)), "ab": np.zeros(ATTEND), "av": r.normal(0, 1, ATTEND), "o": r.normal(0, h**-0.5, 2 * h), "ob": np.zeros(1)}
        return Network({k: v.astype(np.float32) for k, v in p.items()})

    def embed(self, lex: Lexicon) -> np.ndarray:
        size = np.diff(lex.at)[:, None]
        mean = np.add.reduceat(self.p["char"][lex.gram], lex.at[:-1], axis=0) / size if len(lex.word) else np.zeros((0, DIM), np.float32)
        return np.concatenate([self.p["word"][lex.word], mean], 1).astype(np.float32)

    def _run(self, way: str, seats: np.ndarray, length: np.ndarray, drive: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (time, window, hidden) of one direction. seats: words by time; -1 beyond the end."""
        h, steps, n = HIDDEN, seats.shape[0], seats.shape[1]
        u, out = self.p[f"u{way}"], np.zeros((steps, n, HIDDEN), np.float32)
        state = np.zeros((n, h), np.float32)
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            x = drive[seats[t]]
            g = (1 + _soft(state @ u[:, : 2 * h] + x[:, : 2 * h])) / 2
            z, r = g[:, :h], g[:, h:]
            c = _soft(x[:, 2 * h :] + (r * state) @ u[:, 2 * h :])
            new = state + z * (c - state)
            live = (t < length)[:, None]
            new = np.where(live, new, state)
            if keep is not None:
                keep.append((t, state, z, r, c, live))
            out[t] = state = new
        return out

    def forward(self, lex_x: np.ndarray, seats: np.ndarray, length: np.ndarray, tape: dict | None = None) -> np.ndarray:
        """Logit of each window. seats: (time, window) rows of ``lex_x``."""
        states = []
        for way in "fb":
            drive = lex_x @ self.p[f"x{way}"] + self.p[f"b{way}"]
            keep: list | None = [] if tape is not None else None
            states.append(self._run(way, seats, length, drive, keep))
            if tape is not None:
                tape[way] = keep
        s = np.concatenate(states, 2)
        k = _soft(s @ self.p["a"] + self.p["ab"])
        e = k @ self.p["av"]
        e[np.arange(len(seats))[:, None] >= length] = -1e9
        w = np.exp(e - e.max(0))
        w /= w.sum(0)
        pooled = np.einsum("tn,tnh->nh", w, s)
        if tape is not None:
            tape |= {"s": s, "k": k, "w": w, "pooled": pooled, "x": lex_x, "seats": seats}
        return pooled @ self.p["o"] + self.p["ob"]

    def every(self, lex_x: np.ndarray, index: np.ndarray, first: np.ndarray, length: np.ndarray) -> np.ndarray:
        """``forward`` of the given windows, made for windows that start at every word.

        Full windows are run by starts in a row, so a step's inputs are a slice of the words' and
        nothing is gathered; starts whose window would span two texts are run too and left out.
        """
        out = np.empty(len(first), np.float32)
        short = np.flatnonzero(length < WINDOW)
        for i in range(0, len(short), 4096):
            part = short[i : i + 4096]
            out[part] = self.forward(lex_x, _seats(first[part], length[part], index), length[part])
        full = np.flatnonzero(length == WINDOW)
        if not len(full):
            return out
        h, p = HIDDEN, self.p
        ways = []
        for way in "fb":
            drive = np.ascontiguousarray((lex_x @ p[f"x{way}"] + p[f"b{way}"]).T)
            u = np.ascontiguousarray(p[f"u{way}"].T)
            ways.append((drive, u[: 2 * h], u[2 * h :] * np.float32(0.5)))  # gates are computed twice as large
        mix_ = np.ascontiguousarray(np.concatenate([p["a"], p["o"][:, None]], 1).T)
        bias, av = p["ab"][:, None], p["av"]
        begin = first[full]
        i = 0
        while i < len(begin):
            start = int(begin[i])
            j = int(np.searchsorted(begin, start + BLOCK))
            n = int(begin[j - 1]) - start + 1
            seen = index[start : start + n + WINDOW - 1]
            states = np.empty((WINDOW, 2 * h, n), np.float32)
            g, c, room = np.empty((2 * h, n), np.float32), np.empty((h, n), np.float32), np.empty((2 * h, n), np.float32)
            z, r = g[:h], g[h:]
            for (drive, gates, inner), rows, times in zip(ways, (slice(0, h), slice(h, 2 * h)), (range(WINDOW), range(WINDOW - 1, -1, -1)), strict=True):
                x = np.take(drive, seen, axis=1)
                state = None
                for t in times:
                    new = states[t, rows]
                    if state is None:
                        np.copyto(z, x[:h, t : t + n])
                        _soften(z, room[:h])
                        z += 1
                        z *= 0.5
                        np.copyto(c, x[2 * h :, t : t + n])
                        _soften(c, room[:h])
                        np.multiply(z, c, out=new)
                    else:
                        np.matmul(gates, state, out=g)
                        g += x[: 2 * h, t : t + n]
                        _soften(g, room)
                        g += 1
                        r *= state
                        np.matmul(inner, r, out=c)
                        c += x[2 * h :, t : t + n]
                        _soften(c, room[:h])
                        c -= state
                        c *= z
                        c *= 0.5
                        np.add(state, c, out=new)
                    state = new
            total, pooled = np.zeros(n, np.float32), np.zeros(n, np.float32)
            for t in range(WINDOW):
                k = mix_ @ states[t]
                value, k = k[ATTEND], k[:ATTEND]
                k += bias
                _soften(k, room[:ATTEND])
                e = np.exp(av @ k)
                total += e
                e *= value
                pooled += e
            out[full[i:j]] = (pooled / total)[begin[i:j] - start] + p["ob"]
            i = j
        return out

    def backward(self, tape: dict, d_logit: np.ndarray, lex: Lexicon) -> dict[str, np.ndarray]:
        p, h, s, k, w, seats, x = self.p, HIDDEN, tape["s"], tape["k"], tape["w"], tape["seats"], tape["x"]
        g: dict[str, np.ndarray] = {"o": tape["pooled"].T @ d_logit, "ob": np.array([d_logit.sum()], np.float32)}
        d_pooled = d_logit[:, None] * p["o"]
        ds = w[:, :, None] * d_pooled
        dw = np.einsum("tnh,nh->tn", s, d_pooled)
        de = w * (dw - (w * dw).sum(0))
        dk = de[:, :, None] * p["av"] * (1 - np.abs(k)) ** 2
        g["av"] = np.einsum("tn,tna->a", de, k)
        g["a"], g["ab"] = np.einsum("tnh,tna->ha", s, dk), dk.sum((0, 1))
        ds = ds + dk @ p["a"].T
        dx = np.zeros_like(x)
        for way, cut in (("f", slice(0, h)), ("b", slice(h, 2 * h))):
            u = p[f"u{way}"]
            du = np.zeros_like(u)
            d_drive = np.zeros((len(x), 3 * h), np.float32)
            carry = np.zeros((seats.shape[1], h), np.float32)
            for t, state, z, r, c, live in reversed(tape[way]):
                d = carry + ds[t][:, cut]
                dead = np.where(live, 0, d)
                d = np.where(live, d, 0)
                dc = d * z * (1 - np.abs(c)) ** 2
                dz = d * (c - state) * (1 - np.abs(2 * z - 1)) ** 2 / 2
                rs = r * state
                drs = dc @ u[:, 2 * h :].T
                dr = drs * state * (1 - np.abs(2 * r - 1)) ** 2 / 2
                both = np.concatenate([dz, dr], 1)
                du[:, 2 * h :] += rs.T @ dc
                du[:, : 2 * h] += state.T @ both
                carry = dead + d * (1 - z) + drs * r + both @ u[:, : 2 * h].T
                np.add.at(d_drive, seats[t], np.concatenate([both, dc], 1))
            g[f"u{way}"], g[f"x{way}"], g[f"b{way}"] = du, x.T @ d_drive, d_drive.sum(0)
            dx += d_drive @ p[f"x{way}"].T
        word = np.zeros_like(p["word"])
        np.add.at(word, lex.word, dx[:, :DIM])
        char, size = np.zeros_like(p["char"]), np.diff(lex.at)
        np.add.at(char, lex.gram, np.repeat(dx[:, DIM:] / np.maximum(size, 1)[:, None], size, axis=0))
        return g | {"word": word, "char": char}

    def logits(self, chunk: Words) -> np.ndarray:
        """The worst window's logit of each text, NaN for a text without words."""
        out = np.full(chunk.texts, -np.inf, np.float32)
        lex, index = lexicon(chunk)
        if len(index):
            x = self.embed(lex)
            first, length, text = windows(chunk.at)
            np.maximum.at(out, text, self.every(x, index, first, length))
        out[np.isinf(out)] = np.nan
        return out

    def scores(self, chunk: Words) -> np.ndarray:
        logit = self.logits(chunk)
        got = _sigmoid(self.slope * logit.astype(float) + self.shift)
        return np.where(np.isnan(logit), self.empty, got)


def _seats(first: np.ndarray, length: np.ndarray, index: np.ndarray) -> np.ndarray:
    steps = np.arange(int(length.max(initial=1)))[:, None]
    return index[np.minimum(first + steps, first + length - 1)]


def fit(texts: list[bytes | str], labels: list[int], counts: dict[int, int], rounds: int = 6, batch: int = 128, rate: float = 0.01, seed: int = 3) -> Network:
    """Train on whole texts. counts: class counts of the label table, for calibration."""
    net = Network.new(seed)
    total = max(1, sum(counts.values()))
    share = (counts.get(1, 0) + 1) / (total + 2)
    net.empty = share / 2
    y = np.asarray(labels, np.float32)
    if len(set(labels)) < 2:
        net.slope, net.shift = 0.0, float(np.log(share / (1 - share)))
        return net
    r = np.random.default_rng(seed)
    order = r.permutation(len(texts))
    texts, y = [texts[i] for i in order], y[order]
    [chunk] = list(words(pa.array(texts, pa.large_string()), 1 << 62))
    lex, index = lexicon(chunk)
    first, length, text = windows(chunk.at)
    has = np.bincount(text, minlength=len(texts)) > 0
    check = (np.arange(len(texts)) % 5 == 0) & has
    learn = ~check & has
    # the first round's windows: the word most particular to toxic texts, by words and by beginnings
    strength = np.zeros(len(lex.word))
    owner = chunk.owner()
    for rows in (lex.word, lex.gram[lex.at[:-1]] if len(lex.word) else lex.word, lex.gram[lex.at[:-1] + 1] if len(lex.word) else lex.word):
        both = np.unique(owner.astype(np.int64) * (1 << 20) + rows[index])
        who, row = both >> 20, both & ((1 << 20) - 1)
        use = learn[who]
        n = [np.bincount(row[use & (y[who] == v)], minlength=1 << 20) for v in (0, 1)]
        ratio = np.log((n[1] + 0.5) / max(1, (y[learn] == 1).sum())) - np.log((n[0] + 0.5) / max(1, (y[learn] == 0).sum()))
        ratio *= (n[0] + n[1]) >= 3
        strength = np.maximum(strength, ratio[rows])
    hint = np.full(len(first), -np.inf)
    for t in range(WINDOW if len(first) else 0):
        np.maximum(hint, strength[index[np.minimum(first + t, first + length - 1)]], out=hint)

    def worst(value: np.ndarray) -> np.ndarray:
        """Index of each text's window of the largest value; texts without windows are left out."""
        by = np.lexsort((value, text))
        last = np.flatnonzero(np.append(np.diff(text[by]) > 0, True))
        return by[last]

    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    step = 0
    for turn in range(rounds):
        value = hint if turn == 0 else net.every(net.embed(lex), index, first, length)
        take = worst(value + 1e-9 * r.random(len(value)))
        clean = np.flatnonzero(y[text] == 0)
        extra = r.choice(clean, min(len(clean), len(take) // 2), replace=False) if len(clean) else clean
        pool = np.concatenate([take, extra])
        pool = pool[learn[text[pool]]]
        # a small sample is gone through more often, so that every round takes some steps
        for _ in range(min(20, max(2, 40 * batch // max(1, len(pool))))):
            for part in np.array_split(r.permutation(pool), max(1, len(pool) // batch)):
                rows, local = np.unique(index[np.minimum(first[part] + np.arange(WINDOW)[:, None], first[part] + length[part] - 1)], return_inverse=True)
                size = np.diff(lex.at)[rows]
                at = np.concatenate([[0], np.cumsum(size)])
                gram = lex.gram[np.repeat(lex.at[:-1][rows], size) + np.arange(at[-1]) - np.repeat(at[:-1], size)]
                small = Lexicon(lex.word[rows], gram, at)
                tape: dict = {}
                out = net.forward(net.embed(small), local.reshape(WINDOW, len(part)), length[part], tape)
                d = ((_sigmoid(out) - y[text[part]]) / len(part)).astype(np.float32)
                step += 1
                for k, g in net.backward(tape, d, small).items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    net.p[k] -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    value = net.every(net.embed(lex), index, first, length)
    best = worst(value)
    held = best[check[text[best]]]
    if len(set(y[text[held]].tolist())) < 2:
        held = best
    target = y[text[held]]
    weigh = np.where(target > 0, counts.get(1, 1) / max(1, (target > 0).sum()), counts.get(0, 1) / max(1, (target == 0).sum()))
    net.slope, net.shift = _logistic(value[held].astype(float), target.astype(float), weigh / weigh.mean())
    return net


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", each: int = 1500, key: str = "doc_id", text: str = "text") -> Network:
    """Fit on at most ``each`` labelled rows per class that are not held out.

    The driver receives the whole texts of this bounded sample and trains; nothing else reaches it. Of
    several labels of one key the largest holds; rows that repeat a key are all learned from. Null labels,
    keys without a row and rows without a label don't count; a text without words teaches nothing. Without
    labels of both classes the model is constant. Other columns don't matter.
    """
    bounded_batches(docs.sparkSession)
    chosen, counts = labelled.sample(labels, label, each, key)
    kept = docs.select(F.col(key), F.col(text).cast("string").alias("_t")).join(F.broadcast(chosen), key)
    found = sorted((str(r[0]), r[1] or "", r[2]) for r in kept.select(key, "_t", "_y").toLocalIterator())
    return fit([t for _, t, _ in found], [y for _, _, y in found], counts)


def score(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` of every row's whole text, however long; a text without words, or null, has a constant score.

    Equal texts score alike but for single precision, which depends on the texts of a batch. No rows give
    no rows; other columns don't matter.
    """
    return labelled.with_scores(docs.select(F.col(key), F.col(text).cast("string").alias("_text")), net, text="_text").select(key, "score")
