"""Personal data by rules and by a character-level BiLSTM with a CRF on top.

The rules find e-mail addresses, IP addresses, card numbers and phone numbers; the
network, trained in numpy from labelled spans, adds what is written in ways that the
rules miss: spelled out, with odd separators, without a country code. It reads the text
around every cue, a digit, an ``@`` or a written ``at``, without which no span of any
kind is taken. Its windows overlap; in an overlap each character's scores come from the
window that sees more around it, so that one sequence of scores covers a stretch of text
and the CRF decodes it as a whole. A span is added if the best path through it beats the
path that leaves it out by a margin, and if its numbers can be of its kind.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
_EMAIL_AT = re.compile(_EMAIL)
#: The same from the start of a run only: elsewhere in it a match cannot be leftmost.
_EMAIL_RUN = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Characters of a labelled window; of a window that is decoded, and of the part that two of these share.
_WINDOW, _SEEN, _SHARED = 96, 512, 64
_HIDDEN = 20
#: Characters that go through the network together.
_BATCH = 400_000
#: Characters around a cue that the network reads.
_REACH = 64
#: What an address has, and what any span has.
_AT = re.compile(r"@|[\[(]\s?at\s?[\])]|\bat\b.{1,60}?\bdot\b|\bat\x20{1,2}[a-z0-9-]{1,40}(?:\.[a-z0-9-]{2,40}){1,4}", re.I)
_CUE = re.compile(rf"[0-9]|{_AT.pattern}", re.I)
#: What the path through an added span is better by, at least.
MARGIN = 2.0
_TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
_LETTERS = 129


def digits(text: str) -> str:
    return "".join(x for x in text if "0" <= x <= "9")


def luhn(number: str) -> bool:
    total = 0
    for k, x in enumerate(reversed(number)):
        d = int(x) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind: str, text: str) -> bool:
    """The condition that a match of a kind has to meet."""
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))
    if kind == "card":
        return 13 <= len(digits(text)) <= 19 and luhn(digits(text))
    return kind != "phone" or 9 <= len(digits(text)) <= 15


def emails(text: str) -> Iterator[tuple[int, int]]:
    end = 0
    while "@" in text:
        m = (_EMAIL_AT.match(text, end) if end else None) or _EMAIL_RUN.search(text, end)
        if not m:
            return
        yield m.span()
        end = m.end()


def rule_spans(text: str) -> list[Span]:
    """The spans of the rules: leftmost matches of each kind, without those that fail."""
    found: list[Span] = [("email", *x) for x in emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        found += [(kind, *m.span()) for m in pattern.finditer(text) if valid(kind, m.group())]
    return found


def encode_window(text: str) -> np.ndarray:
    x = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(x < 128, x, 128).astype(np.int32)


class Tagger:
    """Two LSTMs over characters, a linear layer, and a CRF."""

    def __init__(self, seed: int = 11):
        r = np.random.default_rng(seed)
        h = _HIDDEN
        draw = lambda *shape: r.normal(0, 0.15, shape).astype(np.float32)
        self.p = {"out": draw(2 * h, _TAGS), "out_b": np.zeros(_TAGS, np.float32), "move": draw(_TAGS, _TAGS), "begin": np.zeros(_TAGS, np.float32)}
        for d in "fb":
            self.p |= {f"w{d}": draw(_LETTERS, 4 * h), f"u{d}": draw(h, 4 * h), f"c{d}": np.zeros(4 * h, np.float32)}
            self.p[f"c{d}"][h : 2 * h] = 1

    def _hidden(self, x: np.ndarray, kept: dict) -> np.ndarray:
        """Hidden states of both directions, which go on together; the second one reads from the end."""
        size, (n, steps) = _HIDDEN, x.shape
        half = np.full(4 * size, 0.5, np.float32)
        half[3 * size :] = 1  # a logistic gate is a tanh of half its input
        w = [(self.p[f"w{d}"] + self.p[f"c{d}"]) * half for d in "fb"]
        u = np.stack([self.p[f"u{d}"] * half for d in "fb"])
        read = np.stack([w[0][x.T], w[1][x.T[::-1]]], axis=1)
        gates = np.empty((steps, 2, n, 4 * size), np.float32)
        cell, h = (np.zeros((steps + 1, 2, n, size), np.float32) for _ in range(2))
        for t in range(steps):
            g = np.tanh(read[t] + np.matmul(h[t], u), out=gates[t])
            g[..., : 3 * size] += 1
            g[..., : 3 * size] *= 0.5
            cell[t + 1] = g[..., size : 2 * size] * cell[t] + g[..., :size] * g[..., 3 * size :]
            h[t + 1] = g[..., 2 * size : 3 * size] * np.tanh(cell[t + 1])
        kept |= {"gates": gates, "cell": cell, "h": h}
        return np.concatenate([h[1:, 0], h[:0:-1, 1]], axis=2).transpose(1, 0, 2)

    def step(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean loss of a batch, and its gradients."""
        kept: dict = {}
        hidden = self._hidden(x, kept)
        e = hidden @ self.p["out"] + self.p["out_b"]
        n, steps, _ = e.shape
        move = self.p["move"]
        jump, top = np.exp(move), e.max(2, keepdims=True)
        emit = np.ascontiguousarray(np.exp(e - top).transpose(1, 0, 2))
        # probabilities from the left, each step scaled to sum to one, and from the right by the same scales
        ahead, back, scale = np.empty_like(emit), np.ones_like(emit), np.empty((steps, n, 1), np.float32)
        now = emit[0] * np.exp(self.p["begin"])
        for t in range(steps):
            if t:
                now = (ahead[t - 1] @ jump) * emit[t]
            scale[t] = now.sum(1, keepdims=True)
            ahead[t] = now / scale[t]
        for t in range(steps - 2, -1, -1):
            back[t] = (emit[t + 1] * back[t + 1] / scale[t + 1]) @ jump.T
        total = np.log(scale).sum((0, 2)) + top.sum((1, 2))
        grad = {k: np.zeros_like(v) for k, v in self.p.items()}
        behind = (emit * back / scale)[1:].reshape(-1, _TAGS)
        grad["move"] += jump * (ahead[:-1].reshape(-1, _TAGS).T @ behind)
        de = np.ascontiguousarray((ahead * back).transpose(1, 0, 2))
        rows = np.arange(n)
        gold = e[rows[:, None], np.arange(steps), tags].sum(1) + self.p["begin"][tags[:, 0]] + move[tags[:, :-1], tags[:, 1:]].sum(1)
        de[rows[:, None], np.arange(steps), tags] -= 1
        grad["move"] -= np.bincount((tags[:, :-1] * _TAGS + tags[:, 1:]).ravel(), minlength=_TAGS**2).reshape(_TAGS, _TAGS)
        grad["begin"] += de[:, 0].sum(0)
        grad["out"] += hidden.reshape(-1, 2 * _HIDDEN).T @ de.reshape(-1, _TAGS)
        grad["out_b"] += de.sum((0, 1))
        self._back(x, kept, de @ self.p["out"].T, grad)
        return float((total - gold).mean()), {k: v / n for k, v in grad.items()}

    def _back(self, x: np.ndarray, kept: dict, dh_all: np.ndarray, grad: dict[str, np.ndarray]) -> None:
        size, steps = _HIDDEN, x.shape[1]
        gates, cell, h = kept["gates"], kept["cell"], kept["h"]
        i, f, o, g = (gates[..., k * size : (k + 1) * size] for k in range(4))
        tc = np.tanh(cell[1:])
        slope = np.concatenate([g * i * (1 - i), cell[:-1] * f * (1 - f), tc * o * (1 - o), i * (1 - g * g)], axis=3)
        through = o * (1 - tc * tc)
        given = np.stack([dh_all[:, :, :size], dh_all[:, ::-1, size:]]).transpose(2, 0, 1, 3)
        u = np.stack([self.p[f"u{d}"].T for d in "fb"])
        dz = np.empty_like(gates)
        dh_next = dc = np.zeros_like(cell[0])
        for t in range(steps - 1, -1, -1):
            dh = given[t] + dh_next
            dc = dc + dh * through[t]
            np.multiply(np.concatenate([dc, dc, dh, dc], axis=2), slope[t], out=dz[t])
            dh_next, dc = np.matmul(dz[t], u), dc * f[t]
        for k, (d, letters) in enumerate((("f", x.T), ("b", x.T[::-1]))):
            flat = np.ascontiguousarray(dz[:, k]).reshape(-1, 4 * size)
            grad[f"w{d}"] += (letters.ravel()[None] == np.arange(_LETTERS)[:, None]).astype(np.float32) @ flat
            grad[f"u{d}"] += np.ascontiguousarray(h[:-1, k]).reshape(-1, size).T @ flat
            grad[f"c{d}"] += flat.sum(0)

    def fit(self, x: np.ndarray, tags: np.ndarray, epochs: int = 14, batch: int = 48, rate: float = 0.03, seed: int = 5) -> list[float]:
        """Adam over shuffled batches, with a rate that falls to a twentieth; returns the mean loss of each epoch."""
        r = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        n, losses, last = 0, [], epochs * -(-len(x) // batch)
        for _ in range(epochs):
            order, total = r.permutation(len(x)), []
            for at in range(0, len(x), batch):
                loss, grad = self.step(x[order[at : at + batch]], tags[order[at : at + batch]])
                total.append(loss)
                n += 1
                for k, g in grad.items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (1 - 0.95 * n / last) * (m[k] / (1 - 0.9**n)) / (np.sqrt(v[k] / (1 - 0.999**n)) + 1e-8)).astype(np.float32)
            losses.append(float(np.mean(total)))
        return losses

    def scores(self, codes: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Scores of the tags of each character of all texts, from overlapping windows."""
        starts, ends, kept = [], [], []
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            for s in range(a, max(a + 1, b - _SHARED), _SEEN - _SHARED):
                e = min(b, s + _SEEN)
                starts.append(s)
                ends.append(e)
                kept.append((s if s == a else s + _SHARED // 2, e if e == b else e - _SHARED // 2))
        out = np.empty((len(codes), _TAGS), np.float32)
        order = np.argsort(np.array(starts) - np.array(ends), kind="stable")
        for at in range(0, len(order), 512):
            which = order[at : at + 512].tolist()
            ahead, back = self._window_scores(codes, np.array([starts[i] for i in which]), np.array([ends[i] for i in which]))
            for row, i in enumerate(which):
                (a, b), s, e = kept[i], starts[i], ends[i]
                out[a:b] = ahead[row, a - s : b - s] + back[row, e - b : e - a][::-1]
        out += self.p["out_b"]
        return out

    def _window_scores(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores of windows, longest first, from the left and, in reverse order, from the right.

        Both directions go on together, and windows that are over drop out.
        """
        h_size, n, length = _HIDDEN, len(starts), ends - starts
        half = np.full((4 * h_size, 1), 0.5, np.float32)
        half[3 * h_size :] = 1  # a logistic gate is a tanh of half its input
        w = [(self.p[f"w{d}"] + self.p[f"c{d}"]).T * half for d in "fb"]
        u = np.stack([self.p[f"u{d}"].T * half for d in "fb"])
        head = np.stack([self.p["out"][:h_size].T, self.p["out"][h_size:].T])
        steps = int(length[0])
        e = np.zeros((2, steps, _TAGS, n), np.float32)
        h, cell = np.zeros((2, h_size, n), np.float32), np.zeros((2, h_size, n), np.float32)
        left = np.searchsorted(-length, -np.arange(steps), "left")  # windows longer than t
        for t in range(steps):
            k = int(left[t])
            if k < h.shape[2]:
                h, cell = np.ascontiguousarray(h[:, :, :k]), np.ascontiguousarray(cell[:, :, :k])
            z = np.matmul(u, h)
            z[0] += w[0].take(codes[starts[:k] + t], axis=1)
            z[1] += w[1].take(codes[ends[:k] - 1 - t], axis=1)
            np.tanh(z, out=z)
            gates = z[:, : 3 * h_size]
            gates += 1
            gates *= 0.5
            cell *= gates[:, h_size : 2 * h_size]
            cell += gates[:, :h_size] * z[:, 3 * h_size :]
            h = np.tanh(cell)
            h *= gates[:, 2 * h_size :]
            e[:, t, :, :k] = np.matmul(head, h)
        return tuple(np.ascontiguousarray(x.transpose(2, 0, 1)) for x in e)

    def decode(self, e: np.ndarray) -> np.ndarray:
        """The best tags of each row of scores, which begins and ends outside."""
        n, steps, _ = e.shape
        move = self.p["move"]
        score, came = e[:, 0] + move[0], np.zeros(e.shape, np.int8)
        for t in range(1, steps):
            both = score[:, :, None] + move
            came[:, t] = both.argmax(1)
            score = both.max(1) + e[:, t]
        tags = np.empty((n, steps), np.int8)
        tags[:, -1] = (score + move[:, 0]).argmax(1)
        for t in range(steps - 1, 0, -1):
            tags[:, t - 1] = came[np.arange(n), t, tags[:, t]]
        return tags

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int, float]]]:
        """Spans of each text, with the margin of each."""
        found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
        if not sum(map(len, texts)):
            return found
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
        e, move = self.scores(encode_window("".join(texts)), offsets), self.p["move"]
        outside = np.full(_TAGS, -1e9, np.float32)
        outside[0] = 0
        order = sorted(range(len(texts)), key=lambda i: len(texts[i]))
        while order:
            steps = max(1, len(texts[order[-1]]))
            part, order = order[-max(1, 100_000 // steps) :], order[: -max(1, 100_000 // steps)]
            padded = np.tile(outside, (len(part), steps, 1))
            for row, i in enumerate(part):
                padded[row, : len(texts[i])] = e[offsets[i] : offsets[i + 1]]
            for i, tags in zip(part, self.decode(padded), strict=True):
                at = offsets[i]
                for kind, a, b in spans_of(tags):
                    path = [0, *tags[a:b].tolist(), int(tags[b]) if b < steps else 0]
                    score = sum(float(move[x, y]) for x, y in zip(path, path[1:], strict=False))
                    score -= float(move[0, 0]) * (b - a) + float(move[0, path[-1]])
                    score += float((e[np.arange(at + a, at + b), tags[a:b]] - e[at + a : at + b, 0]).sum())
                    found[i].append((kind, a, b, score))
        return found


def tags_of(length: int, spans: list[Span]) -> np.ndarray:
    out = np.zeros(length, np.int64)
    for kind, start, end in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[start:end] = k + 1
        out[start] = k
    return out


def spans_of(tags: np.ndarray) -> list[Span]:
    found, at, n = [], 0, len(tags)
    inside = np.flatnonzero(tags)
    while at < n:
        k = int(tags[at])
        if not k:
            later = np.searchsorted(inside, at)
            at = int(inside[later]) if later < len(inside) else n
            continue
        kind, start = (k - 1) // 2, at
        at += 1
        while at < n and tags[at] == 2 * kind + 2:
            at += 1
        found.append((KINDS[kind], start, at))
    return found


def labelled_texts(n: int, seed: int = 3) -> list[tuple[str, list[Span]]]:
    """Made-up windows of text with their personal data labelled, in forms that rules find and in others.

    What looks like it and is none is left unlabelled: dates, amounts, versions, hashes,
    long numbers, handles, and the words that spell out addresses.
    """
    r = np.random.default_rng(seed)
    pick = lambda x: x[int(r.integers(len(x)))]
    number = lambda k: "".join(map(str, r.integers(0, 10, k)))
    common = ("the", "of", "and", "to", "in", "is", "at", "on", "dot", "de", "la", "der", "und", "es", "a", "et", "for", "re", "ea", "are", "with", "was", "Apache", "License")
    letters = "etaoinshrdluetaoinshrdlucmfwypvbgkjqxzéüñçßóäê"

    def word() -> str:
        """Letters at random, or a common word; addresses are made of the same ones, so that only what stands around tells."""
        return pick(common) if r.random() < 0.3 else "".join(pick(letters) for _ in range(int(r.integers(1, 11))))

    def ascii_word() -> str:
        return "".join(x for x in word() if x.isascii()).lower() or "info"

    def email() -> str:
        name, host = ascii_word() + pick(("", "", number(2))), ascii_word() + pick(("", number(1)))
        end = pick(("com", "org", "net", "de", "example.com"))
        at, dot = pick((("@", "."), (" at ", " dot "), (" (at) ", " (dot) "), ("[at]", "[dot]"), (" @ ", " . "), ("(at)", "."), (" [at] ", "."), (" at ", "."), (" AT ", " DOT "), (" ( at ) ", ".")))
        return (pick(("", ascii_word() + (dot if at.lower() == " at " else "."))) + name + at + host + dot + end.replace(".", dot)).strip(".")

    def ip() -> str:
        return pick((".", " dot ", "[.]", " . ", ". ", "(.)")).join(str(x) for x in r.integers(0, 256, 4))

    def card() -> str:
        body = pick("3456") + number(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        return pick((" ", "-", ".", "/", "  ", " - ", "_")).join(body[i : i + 4] for i in range(0, len(body), 4))

    def phone() -> str:
        country, a, b, e = pick(("+1 ", "+44 ", "+49 ", "", "", "001 ", "0049 ")), number(3), number(3), number(4)
        gap = pick((" ", "-", ".", "/", " - "))
        return country + pick((f"({a}) {b}-{e}", f"{a}{gap}{b}{gap}{e}", f"({a}) {b}{gap}{e}"))

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    plain = (
        lambda: number(int(r.integers(1, 8))), lambda: f"{number(1)}.{number(1)}", lambda: f"{number(4)}-{number(2)}-{number(2)}", lambda: f"{number(2)}/{number(2)}/{number(4)}",
        lambda: f'token = "{"".join(pick("0123456789abcdef") for _ in range(40))}"', lambda: f"@{word()}", lambda: number(16), lambda: number(int(r.integers(12, 20))),
        lambda: f"{number(1)},{number(3)},{number(3)}", lambda: f"version {number(1)}.{number(1)}.{number(1)}", lambda: f"{word()} at {word()}", lambda: f"a dot {word()}", lambda: f"({word()})",
        lambda: f"{number(2)}:{number(2)}:{number(2)}", lambda: f"{word()}.{word()}", lambda: f"$$$ {word()}!!", lambda: f"[{number(2)}]", lambda: f"{number(3)} - {number(3)}", lambda: f"CC BY-NC {number(1)}.0",
    )
    out = []
    for _ in range(n):
        text, spans = "", []
        rich, noisy, again = r.random() < 0.7, r.random() < 0.15, r.random() < 0.1
        while len(text) < _WINDOW + 40:
            draw = r.random()
            if draw < 0.02:
                text += pick(("call or write ", "write to ", "mail ", "reach me: ", "phone ", "contact "))
            if rich and draw < 0.13:
                kind = pick(KINDS)
                made = make[kind]()
                spans.append((kind, len(text), len(text) + len(made)))
                text += made + pick((" ", ". ", ", ", "\n", ") "))
                continue
            if noisy and draw < 0.6:
                text += word() + pick(("$$$", "***", "%%%", "&&&", "###", "!!")) + " "
                continue
            if again and draw < 0.3:
                text += (pick(common) + " ") * int(r.integers(3, 20))
                continue
            text += (pick(plain)() if draw < 0.24 else word().upper() if draw < 0.26 else word().capitalize() if draw < 0.36 else word()) + pick((" ", " ", " ", " ", ". ", ", ", "\n", "!! "))
        cut = int(r.integers(0, 40))
        text = text[cut : cut + _WINDOW].ljust(_WINDOW)
        spans = [(k, max(0, a - cut), min(_WINDOW, b - cut)) for k, a, b in spans if b > cut and a - cut < _WINDOW]
        out.append((text, spans))
    return out


def train(examples: list[tuple[str, list[Span]]]) -> Tagger:
    """A tagger from texts of window length and their labelled spans."""
    tagger = Tagger()
    x = np.stack([encode_window(t) for t, _ in examples])
    tagger.fit(x, np.stack([tags_of(_WINDOW, s) for _, s in examples]))
    return tagger


@cache
def default_tagger() -> Tagger:
    """The tagger of made-up labelled windows, trained once in a process; it depends on nothing but this module."""
    return train(labelled_texts(5_000))


def stretches(text: str) -> list[tuple[int, int]]:
    """The parts of a text that lie within reach of a cue."""
    out: list[list[int]] = []
    for m in _CUE.finditer(text):
        low, high = max(0, m.start() - _REACH), min(len(text), m.end() + _REACH)
        if out and low <= out[-1][1]:
            out[-1][1] = high
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def _possible(text: str, kind: str) -> bool:
    """Whether what an added span holds can be of its kind at all."""
    numbers = re.findall("[0-9]+", text)
    if kind == "email":
        return _AT.search(text) is not None and "\n" not in text
    if kind == "ip":
        return len(numbers) == 4 and all(len(x) <= 3 and int(x) <= 255 for x in numbers)
    if kind == "card":
        return valid("card", "".join(numbers))
    return 7 <= len("".join(numbers)) <= 15


def added_spans(texts: list[str], base: list[list[Span]], tagger: Tagger, margin: float = MARGIN) -> list[list[Span]]:
    """What the tagger adds to each text's base spans: where two overlap, the one of larger margin."""
    where = [(i, a, b) for i, text in enumerate(texts) for a, b in stretches(text)]
    found: list[list[tuple[str, int, int, float]]] = [[] for _ in texts]
    at = 0
    while at < len(where):
        to, size = at, 0
        while to < len(where) and (to == at or size + where[to][2] - where[to][1] <= _BATCH):
            size += where[to][2] - where[to][1]
            to += 1
        for (i, a, _), spans in zip(where[at:to], tagger.spans([texts[i][a:b] for i, a, b in where[at:to]]), strict=True):
            found[i] += [(kind, a + x, a + y, score) for kind, x, y, score in spans]
        at = to
    out: list[list[Span]] = []
    for text, spans, rules in zip(texts, found, base, strict=True):
        taken, kept = [(a, b) for _, a, b in rules], []
        for kind, a, b, score in sorted(spans, key=lambda x: (-x[3], x[1])):
            if score >= margin and _possible(text[a:b], kind) and not any(a < y and x < b for x, y in taken):
                taken.append((a, b))
                kept.append((kind, a, b))
        out.append(sorted(kept, key=lambda x: x[1]))
    return out


def _written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda x: (KINDS.index(x[0]), x[1])))


def find_pii(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """Personal data in every whole text.

    Returns doc_id, n_email, n_ip, n_card, n_phone (spans of the rules), base_sha256,
    spans (of rules and tagger) as text, and their number, one row per input row. Positions are code
    points, ends exclusive. A null or empty text has none; repeated rows fare alike.
    Other columns are not looked at; an empty table gives an empty result. Without a
    tagger that of default_tagger() is used.
    """
    tagger = tagger or default_tagger()
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # some 25 000 weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part, *_ in c.chunks(batch, "text"):
                n = part.num_rows
                texts = pc.fill_null(part.column("text"), "").to_pylist()
                base = [rule_spans(x) for x in texts]
                more = added_spans(texts, base, model)
                counts = np.zeros((len(KINDS), n), np.int64)
                digest, spans = [], []
                for i, (rules, extra) in enumerate(zip(base, more, strict=True)):
                    for k, kind in enumerate(KINDS):
                        counts[k, i] = sum(x[0] == kind for x in rules)
                    digest.append(hashlib.sha256(_written(rules).encode()).hexdigest())
                    spans.append(_written(rules + extra))
                total = pa.array([len(rules) + len(extra) for rules, extra in zip(base, more, strict=True)], pa.int64())
                cols = [part.column("doc_id"), *map(pa.array, counts), pa.array(digest), pa.array(spans), total]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return c.map_batches(rows, run, "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string, n_spans long")
