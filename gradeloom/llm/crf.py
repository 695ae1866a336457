"""A linear-chain conditional random field over word shapes, in numpy.

Tokens are runs of letters and digits, or single other characters. A token's class is its
shape, or the kind of cue word it is; the classes of the tokens around it score its
label, and a matrix scores neighbouring labels. Labels are kinds of spans, 0 for none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from gradeloom.llm import batch

KINDS = ("name", "national_id", "secret", "tel")
LABELS = 1 + len(KINDS)
NEAR = (-3, -2, -1, 0, 1, 2)

#: Words that announce personal data, by kind of cue.
CUES = (
    ("mr", "mrs", "ms", "dr", "prof", "herr", "frau", "monsieur", "madame", "senor", "senora", "sr", "sra"),
    ("name", "named", "called", "signed", "nombre", "nom", "contact"),
    ("tel", "phone", "call", "fax", "mobile", "telefon", "telephone", "cell"),
    ("ssn", "passport", "dni", "nin", "passeport", "pasaporte", "ausweis"),
    ("token", "secret", "password", "passwd", "apikey", "key", "pwd"),
)
MARKS = ".,-()+:=\"'/#@"
SHAPES = 14
EDGE = SHAPES + len(MARKS) + 1 + len(CUES)
CLASSES = EDGE + 1

_KIND = np.full(256, 4, dtype=np.int8)
_KIND[list(b"abcdefghijklmnopqrstuvwxyz_")] = 0
_KIND[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")] = 1
_KIND[list(b"0123456789")] = 2
_KIND[128:] = 3
_KIND[[32, 9, 10, 11, 12, 13]] = 5
_MARK = np.full(256, SHAPES + len(MARKS), dtype=np.int16)
for _i, _c in enumerate(MARKS):
    _MARK[ord(_c)] = SHAPES + _i


def _cue_hashes() -> tuple[np.ndarray, np.ndarray]:
    words = [(w.encode(), i) for i, group in enumerate(CUES) for w in group]
    data = np.frombuffer(b" ".join(w for w, _ in words), dtype=np.uint8)
    _, _, _, h = batch.words(data, np.array([0, len(data)]))
    order = np.argsort(h)
    return h[order], np.array([i for _, i in words])[order] + SHAPES + len(MARKS) + 1


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, end, class) of the tokens of a slice, by bytes."""
    if not len(data):
        empty = np.zeros(0, dtype=np.int64)
        return empty, empty, empty, empty.astype(np.int16)
    kind = _KIND[data]
    inside = kind < 4
    first = np.zeros(len(data), dtype=bool)
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    begins = kind == 4
    begins |= inside & first
    begins[0] |= inside[0]
    begins[1:] |= inside[1:] & ~inside[:-1]
    start = np.flatnonzero(begins)
    run = inside[start]
    stop = np.ones(len(data), dtype=bool)
    stop[:-1] = ~inside[1:] | first[1:]
    ends = np.flatnonzero(inside & stop) + 1
    end = start + 1
    end[run] = ends
    sums = [np.concatenate([[0], np.cumsum(kind == k, dtype=np.int32)]) for k in (0, 1, 2)]
    low, up, digit = (s[end] - s[start] for s in sums)
    n = (end - start).astype(np.int32)
    cls = np.full(len(start), 10, dtype=np.int16)
    letters = digit == 0
    cls[letters & (up == 0)] = 0
    cls[letters & (up > 0)] = 13
    cls[letters & (up == 1) & (kind[start] == 1) & (n > 1)] = 1
    cls[letters & (up == n)] = 2
    cls[letters & (up == n) & (n == 1)] = 3
    cls[letters & (n >= 20)] = 12
    cls[~letters & (n >= 16)] = 11
    for c, (lo, hi) in enumerate(((1, 2), (3, 3), (4, 4), (5, 6), (7, 9), (10, 1 << 30)), 4):
        cls[(digit == n) & (n >= lo) & (n <= hi)] = c
    cls[~run] = _MARK[data[start[~run]]]
    short = np.flatnonzero(letters & run & (n <= 9) & (n >= 2))
    if len(short):
        known, which = _cue_hashes()
        h = batch.span_hashes(batch.prefix_hashes(batch._LOWER[data]), start[short], end[short])
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        cls[short[hit]] = which[at[hit]]
    return np.searchsorted(offsets, start, side="right") - 1, start, end, cls


def around(row: np.ndarray, cls: np.ndarray) -> np.ndarray:
    """(len(NEAR), tokens): the classes near each token, EDGE beyond its row."""
    out = np.full((len(NEAR), len(cls)), EDGE, dtype=np.int16)
    for i, d in enumerate(NEAR):
        if d == 0:
            out[i] = cls
        elif abs(d) < len(cls):
            a, b = (slice(-d, None), slice(None, d)) if d < 0 else (slice(None, -d), slice(d, None))
            out[i][a] = np.where(row[a] == row[b], cls[b], EDGE)
    return out


@dataclass(frozen=True)
class Field:
    emit: np.ndarray
    move: np.ndarray

    def decode(self, row: np.ndarray, cls: np.ndarray) -> np.ndarray:
        """The best label of every token, exactly, by Viterbi over many short chains at once.

        A token whose lead of label 0 exceeds whatever transitions could win back has label 0
        in every best path; such tokens part the chains.
        """
        near = around(row, cls)
        lead = np.zeros(len(cls))
        for i in range(len(NEAR)):
            lead += (self.emit[i, :, 1:] - self.emit[i, :, :1]).max(axis=1)[near[i]]
        label = np.zeros(len(cls), dtype=np.int8)
        open_ = np.flatnonzero(lead + 2 * (self.move.max() - self.move.min()) >= 0)
        if not len(open_):
            return label
        begin = np.concatenate([[True], (np.diff(open_) > 1) | (row[open_[1:]] != row[open_[:-1]])])
        chain = np.flatnonzero(begin)
        length = np.diff(np.append(chain, len(open_)))
        order = np.argsort(-length, kind="stable")
        chain, length = chain[order], length[order]
        score = sum(self.emit[i][near[i][open_]] for i in range(len(NEAR)))
        back = np.zeros((len(open_), LABELS), dtype=np.int8)
        best = score[chain] + self.move[0]
        for step in range(1, int(length[0])):
            alive = int(np.searchsorted(-length, -step, side="left"))
            ways = best[:alive, :, None] + self.move[None]
            at = chain[:alive] + step
            back[at] = ways.argmax(axis=1)
            best[:alive] = ways.max(axis=1) + score[at]
        now = (best + self.move[:, 0]).argmax(axis=1)
        for step in range(int(length[0]) - 1, -1, -1):
            alive = int(np.searchsorted(-length, -step, side="left"))
            at = chain[:alive] + step
            label[open_[at]] = now[:alive]
            now[:alive] = back[at, now[:alive]]
        return label


def spans(row, start, end, label) -> list[tuple[int, str, int, int]]:
    """(row, kind, start, end) of the runs of one label, by bytes; no kind crosses rows."""
    some = np.flatnonzero(label)
    if not len(some):
        return []
    new = np.concatenate([[True], (np.diff(some) > 1) | (label[some[1:]] != label[some[:-1]]) | (row[some[1:]] != row[some[:-1]])])
    a = some[np.flatnonzero(new)]
    b = some[np.append(np.flatnonzero(new)[1:], len(some)) - 1]
    return [(int(row[i]), KINDS[label[i] - 1], int(start[i]), int(end[j])) for i, j in zip(a, b, strict=True)]


def train(examples: list[tuple[str, list[tuple[str, int, int]]]], *, rounds: int = 220, penalty: float = 2e-3, rate: float = 0.15) -> Field:
    """Fit by gradient steps (Adam) on the likelihood of (text, [(kind, start, end)]), by bytes."""
    texts = [t.encode() for t, _ in examples]
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    row, start, end, cls = tokens(data, offsets)
    gold = np.zeros(len(cls), dtype=np.int64)
    for r, (_, marked) in enumerate(examples):
        for kind, a, b in marked:
            gold[(row == r) & (start >= offsets[r] + a) & (end <= offsets[r] + b)] = 1 + KINDS.index(kind)
    near = around(row, cls)
    count = np.bincount(row, minlength=len(texts))
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    rank = np.argsort(-count, kind="stable")
    emit, move = np.zeros((len(NEAR), CLASSES, LABELS)), np.zeros((LABELS, LABELS))
    moments = [np.zeros_like(x) for x in (emit, emit, move, move)]
    alive = [rank[: int((count[rank] > t).sum())] for t in range(int(count.max(initial=0)))]
    for turn in range(1, rounds + 1):
        score = sum(emit[i][near[i]] for i in range(len(NEAR)))
        forward, backward = np.zeros((len(cls), LABELS)), np.zeros((len(cls), LABELS))
        for t, rows in enumerate(alive):
            at = first[rows] + t
            forward[at] = score[at] + (move[0] if t == 0 else _log_sum(forward[at - 1][:, :, None] + move[None], 1))
        for t in range(len(alive) - 1, -1, -1):
            at = first[alive[t]] + t
            last = count[alive[t]] == t + 1
            backward[at[last]] = move[:, 0]
            inner = at[~last]
            backward[inner] = _log_sum(move[None] + (score[inner + 1] + backward[inner + 1])[:, None, :], 2)
        whole = _log_sum(forward + backward, 1)
        p = np.exp(forward + backward - whole[:, None])
        error = np.eye(LABELS)[gold] - p
        g_emit = np.zeros_like(emit)
        for i in range(len(NEAR)):
            np.add.at(g_emit[i], near[i], error)
        g_move = np.zeros_like(move)
        same = np.flatnonzero(row[1:] == row[:-1])
        pair = np.exp(forward[same][:, :, None] + move[None] + (score[same + 1] + backward[same + 1])[:, None, :] - whole[same][:, None, None])
        np.add.at(g_move, (gold[same], gold[same + 1]), 1)
        g_move -= pair.sum(axis=0)
        tail = first + count - 1
        has = count > 0
        g_move[0] += error[first[has]].sum(axis=0)
        g_move[:, 0] += error[tail[has]].sum(axis=0)
        for k, (value, gradient) in enumerate(((emit, g_emit), (move, g_move))):
            gradient = gradient / len(texts) - penalty * value
            moments[2 * k] = 0.9 * moments[2 * k] + 0.1 * gradient
            moments[2 * k + 1] = 0.99 * moments[2 * k + 1] + 0.01 * gradient**2
            value += rate * (moments[2 * k] / (1 - 0.9**turn)) / (np.sqrt(moments[2 * k + 1] / (1 - 0.99**turn)) + 1e-6)
    return Field(emit, move)


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)
