"""Personal data: exact patterns, and a character-level bidirectional LSTM with CRF transitions in numpy.

The network is trained from lines with labelled spans that a seeded generator writes: personal data and secrets in plain,
spaced, bracketed and written-out forms, between words, dates, prices, versions and other numbers that are none. Sums of
floating-point numbers differ between processors, and a training makes much of that; so the weights were fitted once, by
`python -m tracewell.llm.pii`, rounded, and lie beside this file. Every text is read whole, in windows of WIDTH signs, the last WIDTH - STEP of which the next has too.
There the scores of both count half each; over the scores of the whole text one best path of labels is found. The
network's gates and states use z / (1 + |z|) in place of exponentials. A sign whose score for no label beats all others
by more than transitions can make up for has no label on that path, so the path is searched only between
such signs, which changes nothing.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.text import in_small_batches

#: Kinds of the base patterns, and those that only the network finds.
KINDS = ["email", "ip", "card", "phone"]
LABELS = [*KINDS, "secret"]
WIDTH, STEP = 256, 224
#: Windows of lines that the network learns from, and windows that are read at once.
LEARNT, AT_ONCE = 96, 2048
#: Signs of texts that are read at once.
PIECE = 1 << 19
_ANCHOR = re.compile(r"[0-9@]")

# The base patterns. A match may begin at the first digit of a run only, which gives the same matches.
_LOCAL_END = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL_END.match(text[start - 1]):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base patterns, by kind as listed, then by start."""
    if not _ANCHOR.search(text):
        return []
    out = [("email", a, b) for a, b in _emails(text)]
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        d = _digits(m[0]) if len(m[0]) < 64 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15]
    return out


# ---------------------------------------------------------------- labelled spans


def _entity(r: random.Random, kind: str) -> str:
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    w = lambda: "".join(r.choice("abcdefghijklmnoprstuvwy") for _ in range(r.randint(2, 9)))
    if kind == "email":
        user = r.choice([w(), f"{w()}.{w()}", f"{w()}{n(2)}", f"{w()}_{w()}", f"{w()}.{n(2)}"])
        dot = r.choice([".", ".", ".", ".", " . ", " dot ", "[.]", " [dot] ", "(dot)"])
        return user + r.choice(["@", "@", "@", " @ ", "(@)", "[@]", "@ ", " at ", " [at] ", "(at)"]) + r.choice([w(), f"mail{n(1)}{dot}{w()}"]) + dot + r.choice(["com", "org", "net", "de", "example.com"])
    if kind == "ip":
        return r.choice([".", ".", ".", " . ", "[.]", "(.)", ". "]).join(str(r.randint(0, 255)) for _ in range(4))
    if kind == "secret":
        signs = r.choice(["0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"])
        e = "".join(r.choice(signs) for _ in range(r.choice([20, 24, 32, 40, 40, 44])))
        return r.choice([e, e, e, e.upper()])
    if kind == "card":
        body = r.choice("3456") + n(r.choice([14, 14, 14, 17]))
        full = next(body + d for d in "0123456789" if luhn(body + d))
        sep = r.choice(["", "", " ", "-", ".", "/"])
        return sep.join(full[i : i + 4] for i in range(0, len(full), 4))
    a, b, c = n(3), n(3), n(4)
    return r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"00{r.randint(10, 99)} {a} {b}{c}", f"{a}.{b}.{c}", f"+{r.randint(10, 99)}{a}{b}{c}"])


def _plain(r: random.Random) -> str:
    n = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = "".join(r.choice("abcdefghiklmnoprstuvwéñö") for _ in range(r.randint(1, 11)))
    number = r.choice([n(r.randint(1, 6)), f"{n(4)}-{n(2)}-{n(2)}", f"{n(2)}/{n(2)}/{n(4)}", f"{n(2)}:{n(2)}", f"${n(3)}.{n(2)}", f"v{n(1)}.{n(1)}", f"{n(1)}.{n(1)}.{n(2)}", f"{n(1)},{n(3)},{n(3)}", "".join(r.choice("0123456789abcdef") for _ in range(r.choice([8, 32, 40]))), f"@{word}", f"{word}{n(2)}", n(r.randint(17, 24)), f"#{n(5)}", f"{n(2)}%"])
    return r.choice([word] * 7 + [word.title(), word.upper() + "!!", word + ",", word + ".", word + "$$$", "|", r.choice(["at", "dot", "token", "key", "the key is", "at " + word + " dot"]), number, number])


def labelled_line(r: random.Random) -> tuple[str, list[tuple[str, int, int]]]:
    """A line of plain words and numbers with none, one or two pieces of personal data, and their spans."""
    text, spans = "", []
    for _ in range(r.randint(3, 16)):
        if r.random() < 0.18:
            kind = r.choice([*LABELS, "secret"])
            e = _entity(r, kind)
            quote = ""
            if kind == "secret":
                quote = r.choice(['"', '"', "'", ""])
                text += r.choice(["token", "secret", "api_key", "password", "key", "TOKEN", "auth"]) + r.choice([" = ", "=", ": ", ":"]) + quote
            spans.append((kind, len(text), len(text) + len(e)))
            text += e + quote + r.choice([" ", " ", ". ", ", ", "\n", "; ", "!! ", "*** ", " | "])
        else:
            text += _plain(r) + r.choice([" "] * 8 + ["\n", ": "])
    return text, spans


# ---------------------------------------------------------------- the network

_SYMBOLS = 99  # printable ASCII, then: other letter, line end, other sign, outside the text
TAGS = 1 + 2 * len(LABELS)  # none; then begin and inside of each kind


def symbols(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.where((points >= 32) & (points < 127), points - 32, np.where(points >= 0xC0, 95, np.where(points == 10, 96, 97)))


def tags_of(size: int, spans: list[tuple[str, int, int]]) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * LABELS.index(kind)
        out[a:b] = k + 1
        out[a : a + 1] = k
    return out


def soft(z: np.ndarray) -> np.ndarray:
    """The network's activation, z / (1 + |z|): like the hyperbolic tangent, at a fifth of its cost."""
    return z / (1 + np.abs(z))


def _slope(s: np.ndarray) -> np.ndarray:
    """The activation's slope where its value is s."""
    return (1 - np.abs(s)) ** 2


@dataclass
class Net:
    """Parameters by name: for each direction w (symbol to gates), u (state to gates); then v, c, and the CRF's t, s."""

    p: dict[str, np.ndarray]
    GAP, MOST = 6.0, 1.0  # score by which none is to win; bound of a transition's weight

    @classmethod
    def new(cls, hidden: int, seed: int) -> Net:
        g = np.random.default_rng(seed)
        p = {}
        for d in "fb":
            p[f"w{d}"] = g.normal(0, 0.3, (_SYMBOLS, 4 * hidden))
            p[f"w{d}"][:, hidden : 2 * hidden] += 3.0  # forget gates begin open
            p[f"u{d}"] = g.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        p["v"] = g.normal(0, 0.3, (2 * hidden, TAGS))
        p["c"], p["t"], p["s"] = np.zeros(TAGS), np.zeros((TAGS, TAGS)), np.zeros(TAGS)
        return cls({k: x.astype(np.float32) for k, x in p.items()})

    def lstm(self, x: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        u = self.p[f"u{d}"]
        n = u.shape[0]
        h = c = np.zeros((x.shape[0], n), np.float32)
        out, steps = np.empty((*x.shape, n), np.float32), []
        for t in range(x.shape[1]):
            z = self.p[f"w{d}"][x[:, t]] + h @ u
            s = soft(z)
            gates = 0.5 + 0.5 * s[:, : 3 * n]
            i, f, o = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :]
            g = s[:, 3 * n :]
            before, c = (h, c), f * c + i * g
            th = soft(c)
            h = o * th
            steps.append((before, i, f, o, g, th))
            out[:, t] = h
        return out, steps

    def lstm_back(self, x: np.ndarray, d: str, steps: list, dh_all: np.ndarray, grad: dict) -> None:
        u = self.p[f"u{d}"]
        dw, du = np.zeros_like(self.p[f"w{d}"]), np.zeros_like(u)
        dh = dc = np.zeros_like(dh_all[:, 0])
        for t in range(x.shape[1] - 1, -1, -1):
            (h0, c0), i, f, o, g, th = steps[t]
            dh = dh + dh_all[:, t]
            dc = dc + dh * o * _slope(th)
            gate = lambda y: 0.5 * _slope(2 * y - 1)
            dz = np.concatenate([dc * g * gate(i), dc * c0 * gate(f), dh * th * gate(o), dc * i * _slope(g)], 1)
            np.add.at(dw, x[:, t], dz)
            du += h0.T @ dz
            dh, dc = dz @ u.T, dc * f
        grad[f"w{d}"], grad[f"u{d}"] = dw, du

    def emit(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        f, sf = self.lstm(x, "f")
        b, sb = self.lstm(x[:, ::-1], "b")
        h = np.concatenate([f, b[:, ::-1]], 2)
        return h @ self.p["v"] + self.p["c"], (h, sf, sb)

    def loss(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log-likelihood of the tag paths under the CRF, and the gradient of it and of each sign's own."""
        e, (h, sf, sb) = self.emit(x)
        n, size, _ = e.shape
        t, s = self.p["t"], self.p["s"]
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        alpha, beta = np.empty_like(e), np.zeros_like(e)
        alpha[:, 0] = s + e[:, 0]
        for k in range(1, size):
            alpha[:, k] = lse(alpha[:, k - 1][:, :, None] + t, 1) + e[:, k]
        for k in range(size - 2, -1, -1):
            beta[:, k] = lse(t + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
        total = lse(alpha[:, -1], 1)
        rows = np.arange(n)[:, None]
        gold = e[rows, np.arange(size), y].sum(1) + s[y[:, 0]] + t[y[:, :-1], y[:, 1:]].sum(1)
        de = np.exp(alpha + beta - total[:, None, None])
        ds = de[:, 0].sum(0)
        pair = np.exp(alpha[:, :-1, :, None] + t + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        dt = pair.sum((0, 1))
        np.add.at(dt, (y[:, :-1], y[:, 1:]), -1)
        np.add.at(ds, y[:, 0], -1)
        de[rows, np.arange(size), y] -= 1
        # Each sign by itself as well, where none is to win by a margin: so that whole texts need little path search.
        alone = e + np.where((y == 0)[:, :, None] & (np.arange(TAGS) > 0), self.GAP, 0)
        alone = np.exp(alone - alone.max(2, keepdims=True))
        alone /= alone.sum(2, keepdims=True)
        alone[rows, np.arange(size), y] -= 1
        de += 0.25 * alone
        grad = {"t": dt / n, "s": ds / n, "c": de.sum((0, 1)) / n, "v": np.tensordot(h, de, ((0, 1), (0, 1))) / n}
        dh = de @ self.p["v"].T / n
        half = dh.shape[2] // 2
        self.lstm_back(x, "f", sf, dh[:, :, :half], grad)
        self.lstm_back(x[:, ::-1], "b", sb, dh[:, ::-1, half:], grad)
        return float((total - gold).mean()), grad

    def scores(self, x: np.ndarray) -> np.ndarray:
        """(place, tag, window) scores of windows x (window, place): what `emit` gives, laid out so that each step of the
        network works on long rows."""
        n, size = x.shape
        steps = np.ascontiguousarray(x.T)
        h = self.p["uf"].shape[0]
        out = np.empty((size, 2 * h, n), np.float32)  # twice the states of both directions
        z, size_of, drawn, more = np.empty((4 * h, n), np.float32), np.empty((4 * h, n), np.float32), np.empty((n, 4 * h), np.float32), np.empty((h, n), np.float32)
        for k, d in enumerate("fb"):
            w, ut = self.p[f"w{d}"], (self.p[f"u{d}"].T * np.float32(0.5)).copy()
            state, cell = np.zeros((h, n), np.float32), np.zeros((h, n), np.float32)
            for t in range(size) if d == "f" else range(size - 1, -1, -1):
                np.matmul(ut, state, out=z)
                np.take(w, steps[t], axis=0, out=drawn, mode="clip")
                z += drawn.T
                np.abs(z, out=size_of)
                size_of += 1
                z /= size_of
                gates = z[: 3 * h]  # twice the gates
                gates += 1
                cell *= gates[h : 2 * h]
                np.multiply(gates[:h], z[3 * h :], out=more)
                cell += more
                cell *= 0.5
                np.abs(cell, out=more)
                more += 1
                np.divide(cell, more, out=more)
                state = out[t, k * h : (k + 1) * h]
                np.multiply(gates[2 * h :], more, out=state)
        got = np.matmul((self.p["v"].T * np.float32(0.5)).copy(), out)
        got += self.p["c"][:, None]
        return got

    def margins(self) -> np.ndarray:
        """For each tag by how much at most transitions can prefer it to none, whatever stands before and after."""
        t, s = self.p["t"], self.p["s"]
        before = np.r_[t, s[None]] - np.r_[t[:, :1], s[None, :1]]
        after = np.c_[t, np.zeros(TAGS, np.float32)] - np.r_[t[0], 0][None]
        return before.max(0) + after.max(1)

    def best(self, e: np.ndarray, lengths: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Best tags of stretches of scores (stretch, place, tag), none around them but where a text begins or ends."""
        t, rows = self.p["t"], np.arange(len(e))
        e = np.ascontiguousarray(e.transpose(1, 2, 0))  # rows of stretches
        score = np.empty_like(e)
        score[0] = np.where(first, self.p["s"][:, None], t[0][:, None]) + e[0]
        ways = np.empty((TAGS, TAGS, len(rows)), np.float32)
        for k in range(1, len(e)):
            np.add(score[k - 1][:, None], t[:, :, None], out=ways)
            np.max(ways, axis=0, out=score[k])
            score[k] += e[k]
        out, end = np.zeros((len(rows), len(e)), np.int64), np.where(last, 0, t[:, :1])
        final = (score[lengths - 1, :, rows] + end.T).argmax(1)
        tag = final
        for k in range(len(e) - 1, -1, -1):  # the way to the tag that was chosen is found again
            tag = np.where(k == lengths - 1, final, (score[k] + t.T[tag].T).argmax(0) if k < len(e) - 1 else final)
            here = k < lengths
            out[here, k] = tag[here]
        return out


def train(lines: list[tuple[str, list]], hidden: int = 10, batch: int = 48, epochs: int = 9, rate: float = 0.03, seed: int = 11) -> Net:
    """A net fitted to labelled lines, cut into windows, by Adam with a falling rate."""
    xs, ys = [], []
    for text, spans in lines:
        x, y = symbols(text), tags_of(len(text), spans)
        for at in range(0, max(1, len(x) - LEARNT // 2), LEARNT):
            pad = max(0, LEARNT - len(x[at : at + LEARNT]))
            xs.append(np.r_[x[at : at + LEARNT], np.full(pad, 98)])
            ys.append(np.r_[y[at : at + LEARNT], np.zeros(pad, np.int64)])
    x, y = np.array(xs), np.array(ys)
    net, g = Net.new(hidden, seed), np.random.default_rng(seed)
    m, v = ({k: np.zeros_like(a) for k, a in net.p.items()} for _ in range(2))
    steps, done = epochs * (len(x) // batch), 0
    for _ in range(epochs):
        order = g.permutation(len(x))
        for at in range(0, len(x) - batch + 1, batch):
            _, grad = net.loss(x[order[at : at + batch]], y[order[at : at + batch]])
            size = float(np.sqrt(sum((a * a).sum() for a in grad.values())))
            done += 1
            for k, a in grad.items():
                a = a * min(1.0, 5 / (size + 1e-9))
                m[k] = 0.9 * m[k] + 0.1 * a
                v[k] = 0.99 * v[k] + 0.01 * a * a
                step = rate * (1 - 0.95 * done / steps) * (m[k] / (1 - 0.9**done)) / (np.sqrt(v[k] / (1 - 0.99**done)) + 1e-6)
                net.p[k] = (net.p[k] - step).astype(np.float32)
                if k in "ts":
                    net.p[k] = net.p[k].clip(-net.MOST, net.MOST)
    return net


def fitted(lines: int = 3400, seed: int = 5, epochs: int = 9) -> Net:
    """A new training, of about a minute."""
    r = random.Random(seed)
    return train([labelled_line(r) for _ in range(lines)], epochs=epochs)


#: The weights in use, and the part of one to which they are rounded.
WEIGHTS, PARTS = Path(__file__).with_name("pii_weights.npz"), 2048


def save(net: Net, path: Path = WEIGHTS) -> None:
    np.savez_compressed(path, **{k: np.rint(x * PARTS).astype(np.int16) for k, x in net.p.items()})


@lru_cache(maxsize=1)
def trained(path: Path = WEIGHTS) -> Net:
    """The net of the weights in use."""
    with np.load(path) as f:
        return Net({k: f[k].astype(np.float32) / PARTS for k in f.files})


# ---------------------------------------------------------------- windows and spans


_AT, _DOT = re.compile(r"@|\bat\b", re.I), re.compile(r"\.|\bdot\b", re.I)


def _fits(kind: str, text: str) -> bool:
    """What a span that the network found must hold at least to be its kind at all."""
    d = _digits(text)
    if kind == "email":
        return len(_AT.findall(text)) == 1 and bool(_DOT.search(text, _AT.search(text).end()))
    if kind == "ip":
        parts = re.findall("[0-9]+", text)
        return len(parts) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts)
    if kind == "card":
        return 13 <= len(d) <= 19 and len(set(d)) > 1 and luhn(d)
    if kind == "secret":
        return len(text) >= 16 and text.isalnum() and 0 < len(d) < len(text)
    return 7 <= len(d) <= 15 and len(set(d)) > 2


def labels(texts: list[str], net: Net, first: bool = True, last: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin of each text, tags, whether a sign surely has none), one text after the other, each with room for whole steps.
    first and last say whether the texts' own begin and end are those of a whole text."""
    sizes = np.array([len(t) for t in texts])
    windows = np.maximum(1, -(-sizes // STEP))
    begin = (np.cumsum(windows) - windows) * STEP
    of, signs, margins, shared = np.repeat(np.arange(len(texts)), windows), [symbols(t) for t in texts], net.margins()[1:, None], WIDTH - STEP
    at = (np.arange(len(of)) * STEP) - begin[of]
    open_, scores, before = [], [], np.zeros((shared, TAGS, 1), np.float32)
    for k in range(0, len(of), AT_ONCE):
        own, place = of[k : k + AT_ONCE], at[k : k + AT_ONCE]
        x = np.full((len(own), WIDTH), 98, np.int64)
        for row, i, p in zip(x, own.tolist(), place.tolist(), strict=True):
            got = signs[i][p : p + WIDTH]
            row[: len(got)] = got
        e = net.scores(x)
        more = np.flatnonzero(place > 0)  # the window before is of the same text
        ends = np.concatenate([before, e[STEP:, :, :-1]], 2)
        before = e[STEP:, :, -1:].copy()
        e[:shared, :, more] = (e[:shared, :, more] + ends[:, :, more]) / 2
        hit = ((e[:STEP, 1:] + margins).max(1) > e[:STEP, 0]).T & (place[:, None] + np.arange(STEP) < sizes[own][:, None])
        window, inner = np.nonzero(hit)
        open_.append((window + k) * STEP + inner)
        scores.append(e[inner, :, window])
    where, e = np.concatenate(open_), np.concatenate(scores)
    tags, sure = np.zeros(int(windows.sum()) * STEP, np.int8), np.ones(int(windows.sum()) * STEP, bool)
    sure[where] = False
    new = np.flatnonzero(np.r_[True, (np.diff(where) > 1) | np.isin(where[1:], begin)]) if len(where) else where
    length = np.diff(np.r_[new, len(where)])
    start = where[new]
    text = np.searchsorted(begin, start, "right") - 1
    heads, tails = (start == begin[text]) & first, (start + length == begin[text] + sizes[text]) & last
    order, k = np.argsort(length, kind="stable"), 0
    while k < len(order):
        row = order[k : k + max(1, min(4096, (1 << 17) // int(length[order[k]])))]
        row = row[length[row] <= 2 * length[row[0]] + 8]
        k += len(row)
        place = new[row][:, None] + np.arange(length[row].max())
        y = net.best(e[np.minimum(place, len(e) - 1)], length[row], heads[row], tails[row])
        there = np.arange(place.shape[1]) < length[row][:, None]
        tags[where[place[there]]] = y[there]
    return begin, tags, sure


def _runs(tags: np.ndarray) -> list[tuple[str, int, int]]:
    """Labelled spans of a row of tags."""
    kind, before = (tags + 1) // 2, np.r_[0, tags[:-1]]
    new = (tags > 0) & ((tags % 2 == 1) | ((before + 1) // 2 != kind))
    start = np.flatnonzero(new)
    stop = np.flatnonzero(np.r_[(tags > 0)[:-1] & ((tags[1:] == 0) | new[1:]), tags[-1] > 0]) + 1
    return [(LABELS[int(kind[a]) - 1], int(a), int(b)) for a, b in zip(start, stop, strict=True)]


def network_spans(texts: list[str], net: Net) -> list[list[tuple[str, int, int]]]:
    """Labelled spans of whole texts, as the best path of tags has them. Texts beyond PIECE signs are read piece by piece:
    a new one begins, one window before, at a sign that surely has no label."""
    out: list[list] = [[] for _ in texts]
    group: list[int] = []
    short = [i for i, t in enumerate(texts) if 0 < len(t) <= PIECE]
    for n, i in enumerate(short):
        group.append(i)
        if n + 1 == len(short) or sum(len(texts[j]) for j in group) + len(texts[short[n + 1]]) > PIECE:
            begin, tags, _ = labels([texts[j] for j in group], net)
            ends = begin + [len(texts[j]) for j in group]
            spans = _runs(tags)
            of = np.searchsorted(begin, [a for _, a, _ in spans], "right") - 1
            for k, (kind, a, b) in zip(of.tolist(), spans, strict=True):
                out[group[k]].append((kind, a - int(begin[k]), min(b, int(ends[k])) - int(begin[k])))
            group = []
    for i, t in enumerate(texts):
        done, size, parts = 0, PIECE, []
        while len(t) > PIECE and done < len(t):
            at = max(0, done // STEP - 1) * STEP
            stop = min(len(t), at + (size // STEP) * STEP + WIDTH - STEP)
            _, tags, sure = labels([t[at:stop]], net, at == 0, stop == len(t))
            upto = len(t)
            if stop < len(t):
                safe = np.flatnonzero(sure[: stop - at - WIDTH]) + at
                upto = int(safe[-1]) if len(safe) else 0
                if upto <= done:
                    size *= 2  # no such sign in the piece: a longer one
                    continue
            parts.append(tags[done - at : upto - at])  # without the room after its end
            done, size = upto, PIECE
        if parts:
            out[i] = _runs(np.concatenate(parts))
    return out


def find(texts: list[str], net: Net) -> list[tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]]:
    """(base spans, all spans) of each text. Spans of the network are widened to whole words; those that touch a
    base span or that can't be their kind are dropped."""
    out = []
    for text, found in zip(texts, network_spans(texts, net), strict=True):
        base, more = base_spans(text) if text else [], []
        for kind, a, b in found:
            while a < b and text[a] in " \n,;:.":
                a += 1
            while a < b and text[b - 1] in " \n,;:.":
                b -= 1
            while 0 < a < b and text[a].isalnum() and text[a - 1].isalnum():
                a -= 1
            while a < b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
                b += 1
            if a < b and _fits(kind, text[a:b]) and not any(x < b and a < y for _, x, y in [*base, *more]):
                more.append((kind, a, b))
        out.append((base, sorted(base + more, key=lambda s: (LABELS.index(s[0]), s[1], s[2]))))
    return out


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", net: Net | None = None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_secret, n_spans), one row per row of docs.

    The counts of the four kinds and base_sha256 are of the base patterns' spans; spans, n_secret and n_spans have
    these and the network's. Null and empty texts have no spans. Repeated rows come out repeated; other columns are
    ignored; an empty table gives an empty result. Every text is read whole, by itself, without a shuffle; the
    network, a few kilobytes, travels with the tasks.
    """
    params = (net or trained()).p
    names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_secret", "n_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Net(params)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                got = find([t or "" for t in part.column(1).to_pylist()], own)
                counts = [pa.array([sum(s[0] == k for s in base) for base, _ in got], pa.int64()) for k in KINDS]
                more = [pa.array([sum(s[0] == "secret" for s in x) for _, x in got], pa.int64()), pa.array([len(x) for _, x in got], pa.int64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *counts, pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in got]), pa.array([joined(x) for _, x in got], pa.string()), *more], names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_small_batches(rows).mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long")


if __name__ == "__main__":
    save(fitted())
