"""PII by a character-level bidirectional LSTM with CRF transitions (operator 4).

Two layers find spans of e-mail addresses, IP addresses, payment cards and phone numbers:

* Base: exact patterns over the whole text, leftmost and non-overlapping per kind; card numbers must
  pass Luhn, IP parts be at most 255; failing matches are dropped without retries. They always stay.
* Method: every text is laid out in windows of ``WINDOW`` characters that overlap by ``OVERLAP``. A first
  pass over the whole text leaves out the windows in which no span could be accepted (see ``plausible``:
  without a decimal digit of any script, an "@" or a spelling of "at" or "dot"), which changes no result.
  The network reads the others, and each is decoded by Viterbi with CRF transitions, but for windows in
  which no span can gain over "outside", whatever the transitions.
  A span cut by a window's edge is left to the neighbour that holds it whole; where none does, the cut
  pieces are joined and their stretch, with ``REACH`` characters on both sides, is decoded in one piece,
  and again with more around it as long as a span is still cut. Of all spans of a text, those of higher
  confidence win overlaps. A span is added when its confidence reaches ``CONFIDENT``, it has its kind's
  digits (decimal digits of any script, but not digits spelled out as words), and no base span overlaps it.

The network is trained in numpy on the driver, from a bounded sample of ``TRAIN_DOCS`` documents, of
each ``STRETCHES`` stretches near digits or "@" and one elsewhere. Its examples are the sample's base
spans, copies of them with other digits and in other spellings (phone without prefix, other separators,
"(at)"), in place or put between other words, and the sample's other digits as counter-examples.
Positions are code points, end exclusive.

Defined results: null and empty text have no spans; without any training window only base spans are
returned; an empty table gives no rows; repeated rows give repeated results; extra columns are ignored.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import chunks

KINDS = ("email", "ip", "card", "phone")
WINDOW, OVERLAP, REACH, CONFIDENT = 192, 96, 40, 0.9
#: A text's last window is padded to a multiple of this.
PAD = 64
#: Windows that are read at a time.
AT_ONCE = 512
TRAIN_DOCS, STRETCHES, TRAIN_WINDOW, TRAIN_WINDOWS = 4000, 3, 112, 4000
EMBED, HIDDEN, STEPS, BATCH, RATE = 12, 20, 450, 48, 0.015
TAGS = 1 + 2 * len(KINDS)  # outside, then first and further characters of each kind
SYMBOLS = 130  # ASCII, other letters, other characters

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_ANCHOR = re.compile(r"[0-9@]")
_NO_DIGIT = re.compile(r"[^0-9]+")
_AT = r"[(\[{<] ?at ?[)\]}>]"
#: What an added address needs, and what any added span has at least one of.
_ADDRESS = re.compile(rf"\w ?(?:[@\uff20]|{_AT}) ?\w|\w at \w.*?\bdot\b.*?\w", re.I | re.S)
_SIGN = re.compile(r"[\d@\uff20(\[{<]")
_BRACKETED_AT, _DOT = re.compile(_AT, re.I), re.compile(r"\bdot\b", re.I)

Span = tuple[int, int, int]  # kind's number, start, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _parts_fit(ip: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in ip.split("."))


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then kind."""
    found: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((0, start, m.end()))
            free = m.end()
        else:
            free = at + 1
        at = text.find("@", free)
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if _parts_fit(m[0])]
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() <= 2 * 19 and 14 <= len(d := _NO_DIGIT.sub("", m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 10 <= len(_NO_DIGIT.sub("", m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], s[0]))


def plausible(kind: int, text: str) -> bool:
    """Does an added span have the digits and signs of its kind?"""
    digits = "".join(c for c in text if c.isdecimal())
    if kind == 0:
        return bool(_ADDRESS.search(text))
    if kind == 1:
        parts = re.findall(r"\d+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    return 14 <= len(digits) <= 19 and luhn(digits) if kind == 2 else 10 <= len(digits) <= 15


def windows(text: str) -> list[int]:
    """Starts of the windows to read: overlapping ones over the whole text."""
    return list(range(0, max(1, len(text) - OVERLAP), WINDOW - OVERLAP)) if text else []


def signs(text: str) -> Iterator[tuple[int, int]]:
    """Places (start, end) of what a span must have for ``plausible`` to accept it: digits, "@", bracketed "at", the word "dot"."""
    for m in _SIGN.finditer(text):
        if text[m.start()] not in "([{<":
            yield m.span()
        elif at := _BRACKETED_AT.match(text, m.start()):
            yield at.span()
    if "dot" in text.lower():
        yield from (m.span() for m in _DOT.finditer(text))


def candidates(text: str) -> list[int]:
    """Those of ``windows`` that hold one of ``signs``, or a part of it."""
    starts = windows(text)
    step, last = WINDOW - OVERLAP, len(starts) - 1
    wanted: set[int] = set()
    for a, b in signs(text):
        wanted.update(range(max(0, (a - WINDOW) // step + 1), min(last, (b - 1) // step) + 1))
    return [starts[i] for i in sorted(wanted)]


@cache
def _other_digits() -> tuple[np.ndarray, np.ndarray]:
    """Code points of the decimal digits beyond ASCII, and those of the ASCII digits of the same value."""
    found = [i for i in range(128, 0x110000) if chr(i).isdecimal()]
    return np.array(found, np.uint32), np.array([48 + int(chr(i)) for i in found], np.uint32)


def symbols(text: str, size: int) -> np.ndarray:
    """Numbers of ``size`` characters, padded with spaces; a digit of any script counts as the ASCII one."""
    codes = np.frombuffer(text.ljust(size).encode("utf-32-le", "surrogatepass"), np.uint32)[:size]
    if not text.isascii():
        other, plain = _other_digits()
        at = np.minimum(np.searchsorted(other, codes), len(other) - 1)
        codes = np.where(other[at] == codes, plain[at], codes)
    return np.where(codes < 128, codes, np.where(codes < 0x250, 128, 129)).astype(np.int64)


def tags(spans: list[Span], start: int, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for kind, a, b in spans:
        a, b = a - start, b - start
        if b > 0 and a < size:
            out[max(a, 0) : min(b, size)] = 2 + 2 * kind
            if a >= 0:
                out[a] = 1 + 2 * kind
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Network:
    """Embedding, an LSTM in each direction, a linear layer, and CRF transitions."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        scale = 1 / np.sqrt(EMBED + HIDDEN)
        self.p = {
            "embed": rng.normal(0, 0.3, (SYMBOLS, EMBED)), "out": rng.normal(0, scale, (2 * HIDDEN, TAGS)), "bias": np.zeros(TAGS), "next": np.zeros((TAGS, TAGS)), "first": np.zeros(TAGS),
            **{f"w{d}": rng.normal(0, scale, (EMBED + HIDDEN, 4 * HIDDEN)) for d in "fb"}, **{f"b{d}": np.repeat([0.0, 1.0, 0.0, 0.0], HIDDEN) for d in "fb"},
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.p["bias"][0] = 2.0
        blocked = np.zeros((TAGS, TAGS), np.float32)
        for kind in range(len(KINDS)):
            inside = 2 + 2 * kind
            blocked[:, inside] = -1e4
            blocked[[inside - 1, inside], inside] = 0
        self.blocked = blocked

    def _both(self, name: str) -> np.ndarray:
        return np.stack([self.p[f"{name}f"], self.p[f"{name}b"]])

    def _lstm(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        """States (direction, time, window, HIDDEN) of both directions, each in its own order of time."""
        t, n, _ = x.shape
        w, own = self._both("w"), np.stack([x, x[::-1]])
        inputs = (own.reshape(2, t * n, EMBED) @ w[:, :EMBED] + self._both("b")[:, None]).reshape(2, t, n, 4 * HIDDEN)
        h, c = np.zeros((2, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        states, cells, gates = (np.empty((2, t, n, k), np.float32) for k in (HIDDEN, HIDDEN, 4 * HIDDEN))
        for i in range(t):
            z = inputs[:, i] + h @ w[:, EMBED:]
            gate = gates[:, i]
            gate[..., : 3 * HIDDEN] = _sigmoid(z[..., : 3 * HIDDEN])
            gate[..., 3 * HIDDEN :] = np.tanh(z[..., 3 * HIDDEN :])
            c = gate[..., HIDDEN : 2 * HIDDEN] * c + gate[..., :HIDDEN] * gate[..., 3 * HIDDEN :]
            h = gate[..., 2 * HIDDEN : 3 * HIDDEN] * np.tanh(c)
            states[:, i], cells[:, i] = h, c
        return states, (own, cells, gates)

    def _lstm_back(self, grad: np.ndarray, states: np.ndarray, tape: tuple, grads: dict) -> np.ndarray:
        """Gradient of the inputs (time, window, EMBED), given that of the states."""
        own, cells, gates = tape
        _, t, n, s = states.shape
        w = self._both("w")
        again = np.ascontiguousarray(w[:, EMBED:].transpose(0, 2, 1))
        a, f, o, g = (gates[..., k * s : (k + 1) * s] for k in range(4))
        tc, none = np.tanh(cells), np.zeros((2, 1, n, s), np.float32)
        old, before = np.concatenate([none, cells[:, :-1]], 1), np.concatenate([none, states[:, :-1]], 1)
        # what dc and dh are multiplied with
        by_c = np.concatenate([g * a * (1 - a), old * f * (1 - f), a * (1 - g * g)], 3)
        by_h, through = tc * o * (1 - o), o * (1 - tc * tc)
        dz, dh, dc = np.empty_like(gates), np.zeros((2, n, s), np.float32), np.zeros((2, n, s), np.float32)
        for i in range(t - 1, -1, -1):
            dh = dh + grad[:, i]
            dc = dc + dh * through[:, i]
            now = dz[:, i]
            now[..., : 2 * s] = np.concatenate([dc, dc], 2) * by_c[:, i, :, : 2 * s]
            now[..., 2 * s : 3 * s] = dh * by_h[:, i]
            now[..., 3 * s :] = dc * by_c[:, i, :, 2 * s :]
            dh, dc = now @ again, dc * f[:, i]
        flat = dz.reshape(2, t * n, 4 * s)
        dw = np.concatenate([own.reshape(2, t * n, EMBED).transpose(0, 2, 1) @ flat, before.reshape(2, t * n, s).transpose(0, 2, 1) @ flat], 1)
        for k, d in enumerate("fb"):
            grads[f"w{d}"], grads[f"b{d}"] = dw[k], flat[k].sum(0)
        dx = (flat @ w[:, :EMBED].transpose(0, 2, 1)).reshape(2, t, n, EMBED)
        return dx[0] + dx[1, ::-1]

    def emissions(self, codes: np.ndarray) -> tuple[np.ndarray, tuple]:
        """Tag scores (time, window, tag) of (window, time) symbols, and what the gradient needs."""
        states, tape = self._lstm(self.p["embed"][codes.T])
        h = np.concatenate([states[0], states[1, ::-1]], 2)
        return h @ self.p["out"] + self.p["bias"], (h, states, tape)

    def marginals(self, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Posterior tag probabilities (time, window, tag), and expected transitions, by forward and backward sums that are scaled at each step."""
        step = np.exp(np.maximum(self.p["next"] + self.blocked, -80).astype(np.float64))
        own = np.exp((scores - scores.max(2, keepdims=True)).astype(np.float64))
        alpha, beta = np.empty_like(own), np.ones_like(own)
        own[0] *= np.exp(np.maximum(self.p["first"] + self.blocked[0], -80))
        alpha[0] = own[0] / own[0].sum(1, keepdims=True)
        for i in range(1, len(own)):
            a = (alpha[i - 1] @ step) * own[i]
            alpha[i] = a / a.sum(1, keepdims=True)
        for i in range(len(own) - 2, -1, -1):
            b = (own[i + 1] * beta[i + 1]) @ step.T
            beta[i] = b / b.sum(1, keepdims=True)
        probable = alpha * beta
        probable /= probable.sum(2, keepdims=True)
        later = own[1:] * beta[1:]
        later /= ((alpha[:-1] @ step) * later).sum(2, keepdims=True)
        pairs = step * (alpha[:-1].reshape(-1, TAGS).T @ later.reshape(-1, TAGS))
        return probable.astype(np.float32), pairs.astype(np.float32)

    def gradients(self, codes: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-likelihood of the tags ``wanted`` (window, time)."""
        n, grads = len(codes), {}
        scores, (h, states, tape) = self.emissions(codes)
        d, pairs = self.marginals(scores)
        goal = wanted.T
        grads["first"] = (d[0].sum(0) - np.bincount(goal[0], minlength=TAGS)) / n
        np.add.at(pairs, (goal[:-1].ravel(), goal[1:].ravel()), -1)
        grads["next"] = pairs / n
        d[np.arange(len(goal))[:, None], np.arange(n), goal] -= 1
        d /= n
        flat = d.reshape(-1, TAGS)
        grads["out"], grads["bias"] = h.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)
        dh = d @ self.p["out"].T
        dx = self._lstm_back(np.stack([dh[:, :, :HIDDEN], dh[::-1, :, HIDDEN:]]), states, tape, grads)
        grads["embed"] = np.zeros_like(self.p["embed"])
        for k in range(EMBED):
            grads["embed"][:, k] = np.bincount(codes.T.ravel(), dx[..., k].ravel(), SYMBOLS)
        return grads

    def train(self, codes: np.ndarray, wanted: np.ndarray, steps: int = STEPS, seed: int = 9) -> None:
        """Adam over the windows in seeded order, in whole rounds of at least ``steps`` steps.

        The rate falls to a twentieth, and the network is the mean of its parameters over the last third. Rounding, which differs
        from machine to machine, grows over training at a constant rate; so it hardly tells in the result.
        """
        rng = np.random.default_rng(seed)
        m, v, step = {k: np.zeros_like(x) for k, x in self.p.items()}, {k: np.zeros_like(x) for k, x in self.p.items()}, 0
        a_round = -(-len(codes) // BATCH)
        total = -(-steps // max(1, a_round)) * a_round
        mean, means = {k: np.zeros(x.shape) for k, x in self.p.items()}, 0
        while step < steps:
            order = rng.permutation(len(codes))
            for a in range(0, len(order), BATCH):
                grads, step = self.gradients(codes[order[a : a + BATCH]], wanted[order[a : a + BATCH]]), step + 1
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                for k, g in grads.items():
                    g = g * min(1.0, 5.0 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] -= (RATE * max(0.05, 1 - step / total) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
                if 3 * step > 2 * total:
                    means += 1
                    for k, x in self.p.items():
                        mean[k] += x
        if means:
            self.p = {k: (x / means).astype(np.float32) for k, x in mean.items()}

    def states(self, codes: np.ndarray) -> np.ndarray:
        """States (time, window, 2 * HIDDEN) as in emissions(), without what the gradient needs: both directions in one pass, gates apart, all by one exponential."""
        n, t = codes.shape
        scale = np.repeat(np.float32([-1, -2]), [3 * HIDDEN, HIDDEN])  # tanh(x) = 2 / (1 + exp(-2 x)) - 1
        inputs = [((self.p["embed"] @ self.p[f"w{d}"][:EMBED] + self.p[f"b{d}"]) * scale).reshape(SYMBOLS, 4, HIDDEN).transpose(1, 0, 2).copy() for d in "fb"]
        again = np.stack([(self.p[f"w{d}"][EMBED:] * scale).reshape(HIDDEN, 4, HIDDEN).transpose(1, 0, 2) for d in "fb"])
        h, c = np.zeros((2, 1, n, HIDDEN), np.float32), np.zeros((2, n, HIDDEN), np.float32)
        z, own, state = np.empty((2, 4, n, HIDDEN), np.float32), np.empty((2, 4, n, HIDDEN), np.float32), np.empty((t, n, 2 * HIDDEN), np.float32)
        taken, forget, shown, new = (z[:, k] for k in range(4))
        out = h[:, 0]
        order = np.ascontiguousarray(codes.T)
        with np.errstate(over="ignore"):
            for i in range(t):
                np.matmul(h, again, out=z)
                np.take(inputs[0], order[i], 1, own[0], "clip")
                np.take(inputs[1], order[t - 1 - i], 1, own[1], "clip")
                z += own
                np.exp(z, out=z)
                z += 1
                np.reciprocal(z, out=z)
                new *= 2
                new -= 1
                new *= taken
                c *= forget
                c += new
                np.multiply(c, -2, out=out)
                np.exp(out, out=out)
                out += 1
                np.divide(2, out, out=out)
                out -= 1
                out *= shown
                state[i, :, :HIDDEN], state[t - 1 - i, :, HIDDEN:] = out
        return state

    def _open(self, states: np.ndarray) -> np.ndarray:
        """Numbers of the windows in which a path with a span may be the best one.

        A span's gain over "outside" is that of its first character, its further ones and the transitions
        between, into and out of them. It is bounded from above for all starts and ends at once, with the
        best transitions. Where no span can gain, the path that is outside all along is the best.
        """
        step = self.p["next"] + self.blocked - self.p["next"][0, 0]
        begin, inside = np.arange(1, TAGS, 2), np.arange(2, TAGS, 2)
        t, n, size = states.shape
        gain = states.reshape(t * n, size) @ (self.p["out"][:, 1:] - self.p["out"][:, :1])
        gain += self.p["bias"][1:] - self.p["bias"][0]
        gain = gain.reshape(t, n, TAGS - 1)
        start = gain[:, :, ::2] + step[:, begin].max(0)
        start[0] += np.maximum(self.p["first"][begin] - self.p["first"][0], 0)
        further = gain[:, :, 1::2] + np.maximum(step[begin, inside], step[inside, inside])
        upto = np.cumsum(further, 0)
        best = upto + np.maximum.accumulate(start - upto, 0) + np.maximum(np.maximum(step[begin, 0], step[inside, 0]), 0)
        return np.flatnonzero((best > -0.1).any((0, 2)))  # 0.1 is for rounding

    def decode(self, codes: np.ndarray) -> list[list[tuple[int, int, int, float]]]:
        """Per window the spans (kind, start, end, confidence) of the best tag sequence."""
        out: list[list[tuple[int, int, int, float]]] = [[] for _ in codes]
        states = self.states(codes)
        maybe = self._open(states)
        if not len(maybe):
            return out
        scores = states[:, maybe] @ self.p["out"] + self.p["bias"]
        step, t = self.p["next"] + self.blocked, len(scores)
        across = np.ascontiguousarray(scores.transpose(0, 2, 1))
        best = np.empty_like(across)
        best[0] = across[0] + (self.p["first"] + self.blocked[0])[:, None]
        for i in range(1, t):
            best[i] = (best[i - 1][:, None, :] + step[:, :, None]).max(0) + across[i]
        path = np.empty((t, len(maybe)), np.int64)
        path[-1] = best[-1].argmax(0)
        for i in range(t - 1, 0, -1):
            path[i - 1] = (best[i - 1] + step[:, path[i]]).argmax(0)
        some = np.flatnonzero(path.any(0))
        if not len(some):
            return out
        probable, _ = self.marginals(scores[:, some])
        sure = np.take_along_axis(probable, path[:, some, None], 2)[:, :, 0]
        for k, w in enumerate(some):
            tag = path[:, w]
            for i in np.flatnonzero(tag % 2):
                end = i + 1
                while end < t and tag[end] == tag[i] + 1:
                    end += 1
                out[maybe[w]].append((int(tag[i]) // 2, int(i), int(end), float(sure[i:end, k].mean())))
        return out


def _too_many(kind: int, text: str) -> bool:
    """Has a piece more digits than a whole span of its kind may have?"""
    return kind > 0 and sum(c.isdecimal() for c in text) > (0, 12, 19, 15)[kind]


def _whole(texts: list[str], pieces: list[list[Span]], network: Network) -> Iterator[tuple[int, Span, float]]:
    """(text, span, confidence) of the stretches around pieces of spans, each stretch grown until it cuts none."""
    todo: list[tuple[int, int, int, int]] = []  # text, start, end, how much to grow by
    for i, cut in enumerate(pieces):
        start = end = -1
        for a, b in sorted((a, b) for _, a, b in cut):
            if a > end:
                if end >= 0:
                    todo.append((i, max(0, start - REACH), min(len(texts[i]), end + REACH), WINDOW))
                start = a
            end = max(end, b)
        if end >= 0:
            todo.append((i, max(0, start - REACH), min(len(texts[i]), end + REACH), WINDOW))
    while todo:
        by_size: dict[int, list[tuple[int, int, int, int]]] = {}
        for x in todo:
            by_size.setdefault(-(-(x[2] - x[1]) // WINDOW) * WINDOW, []).append(x)
        todo = []
        for size, every in by_size.items():
            at_once = max(1, AT_ONCE * WINDOW // size)
            for first in range(0, len(every), at_once):
                part = every[first : first + at_once]
                for (i, a, b, grow), spans in zip(part, network.decode(np.stack([symbols(texts[i][a:b], size) for i, a, b, _ in part]))):  # noqa: B905
                    left = right = False
                    for kind, x, y, sure in spans:
                        x, y = a + x, min(a + y, b)
                        if x < y and not ((x == a and a > 0) or (y == b and b < len(texts[i]))):
                            yield i, (kind, x, y), sure
                        elif x < y and not _too_many(kind, texts[i][x:y]):
                            left, right = left or x == a, right or y == b
                    wider = (max(0, a - grow * left), min(len(texts[i]), b + grow * right))
                    if wider != (a, b):
                        todo.append((i, *wider, 2 * grow))


def added_spans(texts: list[str], base: list[list[Span]], network: Network, places: Callable[[str], list[int]] = candidates) -> list[list[Span]]:
    """Per text the spans that the network adds to the base; ``places`` tells where a text's windows are."""
    where: list[tuple[int, int, int, int]] = []  # text, start, size, number of the window's content among those of its size
    distinct: dict[int, dict[bytes, int]] = {}
    for i, text in enumerate(texts):
        if starts := places(text):
            coded = symbols(text, len(text) + PAD - 1).astype(np.uint8).tobytes()
            for s in starts:
                size = min(WINDOW, -(-(len(text) - s) // PAD) * PAD)
                same = distinct.setdefault(size, {})
                where.append((i, s, size, same.setdefault(coded[s : s + size], len(same))))
    decoded: dict[int, list] = {}
    for size, same in distinct.items():
        contents, decoded[size] = list(same), []
        for a in range(0, len(contents), AT_ONCE):
            decoded[size] += network.decode(np.frombuffer(b"".join(contents[a : a + AT_ONCE]), np.uint8).reshape(-1, size))
    found: list[list[tuple[float, Span]]] = [[] for _ in texts]
    whole: list[list[Span]] = [[] for _ in texts]
    pieces: list[list[Span]] = [[] for _ in texts]
    for i, start, size, content in where:
        for kind, x, y, sure in decoded[size][content]:
            cut = (x == 0 and start > 0) or (y == size and start + size < len(texts[i]))
            span = (kind, start + x, min(start + y, len(texts[i])))
            if span[1] >= span[2]:
                continue
            (pieces if cut else whole)[i].append(span)
            if sure >= CONFIDENT and not cut and plausible(kind, texts[i][span[1] : span[2]]):
                found[i].append((-sure, span))
    for i, cut in enumerate(pieces):
        pieces[i] = [p for p in cut if not _too_many(p[0], texts[i][p[1] : p[2]]) and not any(k == p[0] and a <= p[1] and p[2] <= b for k, a, b in whole[i])]
    for i, span, sure in _whole(texts, pieces, network):
        if sure >= CONFIDENT and plausible(span[0], texts[i][span[1] : span[2]]):
            found[i].append((-sure, span))
    out: list[list[Span]] = []
    for i, candidates in enumerate(found):
        taken: list[Span] = []
        busy = [(a, b) for _, a, b in base[i]]
        for _, span in sorted(set(candidates)):
            if all(span[2] <= a or span[1] >= b for a, b in busy):
                busy.append(span[1:])
                taken.append(span)
        out.append(taken)
    return out


def _respelt(kind: int, text: str, rng: random.Random) -> str:
    """The same number or address in a spelling that the base patterns don't know."""
    if kind == 0:
        local, _, domain = text.partition("@")
        if rng.random() < 0.4:
            domain = domain.replace(".", rng.choice([" dot ", " (dot) ", "(dot)", "[dot]", " . "]))
        return local + rng.choice(["(at)", "[at]", " @ ", " (at) ", " [at] "]) + domain
    if kind == 1:
        return text.replace(".", rng.choice([" . ", ". ", ":", ", ", "[.]", "-"]))
    if kind == 2:
        digits = _NO_DIGIT.sub("", text)
        return rng.choice([".", "_", "/", "  ", " - "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    bare = re.sub(r"^\+[0-9]{1,2} ?", "", text)
    if rng.random() < 0.5:  # other groups of digits
        digits, parts = rng.choice(["", "0", "00"]) + _NO_DIGIT.sub("", text), []
        while digits:
            cut = rng.randrange(2, 5) if len(digits) > 5 else len(digits)
            parts.append(digits[:cut])
            digits = digits[cut:]
        return rng.choice(["+", "", "", ""]) + rng.choice([" ", "-", "/", "."]).join(parts)
    return rng.choice([bare, "00" + text[1:], text.replace("-", "/").replace(" ", "/"), text.replace(" ", "_"), text.replace(" ", ".")])


def _varied(kind: int, text: str, rng: random.Random) -> str:
    """The span with other digits, an address also with its names' letters shifted."""
    if kind == 0:
        shift = rng.randrange(26)
        return re.sub(r"[a-z]", lambda m: chr(97 + (ord(m[0]) - 97 + shift) % 26), text) if rng.random() < 0.5 else text
    if kind == 1:
        return ".".join(str(rng.randrange(256)) for _ in range(4))
    return re.sub(r"[0-9]", lambda m: str(rng.randrange(10)), text)


def _filled(text: str, spans: list[tuple[int, int, int, str]]) -> tuple[str, list[Span]]:
    """``text`` with stretches (kind, start, end, new text) replaced, and the spans of the new texts."""
    parts, at, length, out = [], 0, 0, []
    for kind, a, b, own in sorted(spans, key=lambda s: s[1:3]):
        if a < at:
            continue
        parts += [text[at:a], own]
        length += a - at
        out.append((kind, length, length + len(own)))
        length += len(own)
        at = b
    return "".join([*parts, text[at:]]), out


def examples(texts: list[str], seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Windows and their tags from texts and their base spans: as they are, varied and respelt in place, and put between other words."""
    rng = random.Random(seed)
    every = [(text, base_spans(text)) for text in texts]
    pool: list[list[str]] = [[text[a:b] for text, own in every for kind, a, b in own if kind == k] for k in range(len(KINDS))]
    kinds = [k for k in range(len(KINDS)) if pool[k]]
    codes, wanted = [], []

    def add(text: str, spans: list[Span], at: int) -> None:
        start = max(0, at - rng.randrange(TRAIN_WINDOW))
        codes.append(symbols(text[start : start + TRAIN_WINDOW], TRAIN_WINDOW))
        wanted.append(tags(spans, start, TRAIN_WINDOW))

    for text, own in every:
        for change in (False, True) if own else (False,):
            new, spans = _filled(text, [(k, a, b, _changed(k, text[a:b], rng) if change else text[a:b]) for k, a, b in own])
            for _, a, b in spans:
                add(new, spans, (a + b) // 2)
            add(new, spans, rng.randrange(len(new) + 1))
        gaps = [m.end() for m in re.finditer(r"\s", text) if all(m.end() < a - 1 or m.end() > b for _, a, b in own)]
        if kinds and gaps:
            put = []
            for at in {rng.choice(gaps) for _ in range(2)}:
                kind = rng.choice(kinds)
                put += [(kind, at, at, _changed(kind, rng.choice(pool[kind]), rng)) for _ in range(rng.choice([1, 1, 1, 2]))]
            padded = [(k, a, b, t) for k, a, b, t in put] + [(k, a, b, text[a:b]) for k, a, b in own]
            new, spans = _filled(text, padded)
            # a space after each inserted span, so that it stands between words
            shift, spaced, marks = 0, new, []
            for kind, a, b in spans:
                a, b = a + shift, b + shift
                marks.append((kind, a, b))
                if b < len(spaced) and spaced[b].isalnum():
                    spaced, shift = spaced[:b] + rng.choice([" ", " ", ", ", ". "]) + spaced[b:], shift
                    shift += len(spaced) - len(new) - shift
            add(spaced, marks, (marks[0][1] + marks[0][2]) // 2)
    return (np.stack(codes), np.stack(wanted)) if codes else (np.zeros((0, TRAIN_WINDOW), np.int64),) * 2


def _changed(kind: int, text: str, rng: random.Random) -> str:
    text = _varied(kind, text, rng) if rng.random() < 0.7 else text
    return _respelt(kind, text, rng) if rng.random() < 0.6 else text


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """STRETCHES stretches of each text at most that hold a digit or "@", and one from a place that depends on the id."""
    for batch in batches:
        ids, out = [], []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1)):  # noqa: B905
            text, at = text.as_py(), 0
            start = random.Random(i or 0).randrange(len(text) + 1)
            found = [text[start : start + 2 * TRAIN_WINDOW]]
            for _ in range(STRETCHES):
                if not (m := _ANCHOR.search(text, at)):
                    break
                found.append(text[max(at, m.start() - TRAIN_WINDOW) : m.end() + TRAIN_WINDOW])
                at = m.end() + TRAIN_WINDOW
            ids += [i] * len(found)
            out += found
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["id", "stretch"])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Network | None:
    """A network trained on about TRAIN_DOCS documents picked by a hash of their id; None without any base span."""
    part = min(1.0, TRAIN_DOCS / max(1, docs.count()))
    lot = F.pmod(F.xxhash64(F.lit(23), F.col(id_col)), F.lit(1 << 30)).cast("double") / float(1 << 30)
    some = docs.filter((lot < part) & F.col(text_col).isNotNull()).selectExpr(f"cast(`{id_col}` as long) as id", f"`{text_col}` as text").mapInArrow(_stretches, "id long, stretch string")
    # some kilobytes of a document at most, and documents whose id repeats are as many rows
    texts = [r.stretch for r in some.orderBy(F.xxhash64(F.lit(29), "id"), "id", "stretch").limit((1 + STRETCHES) * TRAIN_DOCS).collect()]
    codes, wanted = examples(texts)
    if not wanted.any():
        return None
    network = Network()
    order = np.random.default_rng(1).permutation(len(codes))
    held = wanted[order].any(1)
    order = np.concatenate([order[held][: 2 * TRAIN_WINDOWS // 3], order[~held][: TRAIN_WINDOWS // 3]])
    network.train(codes[order], wanted[order])
    return network


def find(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end, base>>) per row, by start, then kind as in KINDS."""
    shared = docs.sparkSession.sparkContext.broadcast(network)
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in chunks(batch.column(1)):
                cuts = chunk.offsets
                rows = np.flatnonzero(cuts[1:] > cuts[:-1])
                texts = [chunk.raw[cuts[i] : cuts[i + 1]].tobytes().decode() for i in rows]
                base = [base_spans(t) for t in texts]
                more = added_spans(texts, base, shared.value) if shared.value else [[] for _ in texts]
                out: list[list[dict]] = [[] for _ in range(len(chunk))]
                for i, own, extra in zip(rows, base, more):  # noqa: B905
                    every = sorted([(a, k, b, True) for k, a, b in own] + [(a, k, b, False) for k, a, b in extra])
                    out[i] = [{"kind": KINDS[k], "start": a, "end": b, "base": is_base} for a, k, b, is_base in every]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(chunk.first, len(chunk)), pa.array(out, pa.list_(span))], names=["doc_id", "spans"])

    return docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:int,end:int,base:boolean>>")
