"""Personal data: rules, and a character-level bidirectional LSTM with CRF transitions.

The base rules find e-mail addresses, IP addresses, payment cards and phone numbers by pattern. The model labels single
characters with B and I tags of the four kinds, also in forms that the base rules don't know: phone numbers without a plus
sign, cards of 15 digits or with dots, IPv6 addresses, e-mail addresses with letters beyond ASCII or with spaces around the @. It is
trained here, in numpy, from labelled spans that `examples` makes from a seed: personal data in many forms, and numbers,
dates and codes that are none.

A text is read in windows of WINDOW characters at steps of half that; those with a digit or an @ and their neighbours are
scored (a span of any kind has one, so no other window can hold a part of one). Where two windows overlap, a character's tag
scores are their mean, weighted by its distance from the windows' edges. Each stretch of overlapping windows, however
long, is then one chain, and one Viterbi pass finds its best path by tag scores and transitions. Spans of the model that overlap a base
span are dropped; base spans always stay.

Null texts are empty. Texts of any length are read whole. Rows don't depend on each other: repeated rows and ids, ties and
other columns play no part. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import itertools
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
WINDOW, BATCH_WINDOWS = 64, 512
EMBED, HIDDEN, TAGS = 12, 32, 1 + 2 * len(KINDS)
EXAMPLES, EPOCHS, BATCH, RATE, SEED = 12_000, 6, 64, 0.01, 11
#: Tag steps of chains that are decoded side by side.
CHAIN_CELLS = 1 << 20
#: Characters of the shortest span that the model may add.
LEAST = 5
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"

# Fixed patterns of the base rules. The starts are anchored at the first digit of a run, which changes no match and keeps long runs linear.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    double = [0, 2, 4, 6, 8, 1, 3, 5, 7, 9]
    return sum(double[int(d)] if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            last = m.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def fits(kind: str, s: str) -> bool:
    """Whether a found string passes its kind's test."""
    if kind == "ip":
        return all(int(p[-4:]) <= 255 and len(p.lstrip("0")) <= 3 for p in s.split("."))
    if kind == "card":
        return 16 <= len(d := _digits(s)) <= 19 and luhn(d)
    return kind == "email" or 8 <= len(_digits(s)) <= 15


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start."""
    if not _HINT.search(text):
        return []
    found = [("email", a, b) for a, b in _emails(text)]
    for kind, pattern in (("ip", _IP), ("card", _CARD), ("phone", _PHONE)):
        found += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if fits(kind, m[0])]
    return found


# ---- examples with labelled spans


def _number(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _word(r: random.Random) -> str:
    return "".join(r.choice(("th", "er", "on", "an", "re", "he", "in", "ed", "sch", "eau", "ción", "é", "ü", "ß", "ñ", "a", "o", "st", "ng", "ly")) for _ in range(r.randint(1, 4)))


def _luhn_number(r: random.Random, first: str, n: int) -> str:
    body = first + _number(r, n - 1 - len(first))
    return next(body + str(d) for d in range(10) if luhn(body + str(d)))


def _card(r: random.Random) -> str:
    if r.random() < 0.25:  # 15 digits in groups of 4, 6 and 5
        digits, mark = _luhn_number(r, r.choice(("34", "37")), 15), r.choice(("", " ", "-"))
        return mark.join((digits[:4], digits[4:10], digits[10:]))
    digits = _luhn_number(r, r.choice("23456"), 16)
    return r.choice(("", "", " ", "-", ".")).join(digits[k : k + 4] for k in range(0, 16, 4))


def _phone(r: random.Random) -> str:
    a, b, c, d, e = _number(r, 3), _number(r, 3), _number(r, 4), _number(r, 2), _number(r, 2)
    code, mark = r.randint(1, 99), r.choice((" ", "-", "."))
    return r.choice((
        f"+{code} ({a}) {b}-{c}", f"+{code} {a} {b} {c}", f"+{code}-{a}-{b}-{c}", f"+{code}{a}{b}{c}", f"+{r.randint(30, 49)} {a} {d} {e} {d}", f"({a}) {b}-{c}", f"({a}) {b} {c}",
        f"{a}{mark}{b}{mark}{c}", f"0{d} {c} {_number(r, 4)}", f"0{a[:2]} {b} {c}", f"0{r.randint(1, 9)} {d} {e} {_number(r, 2)} {_number(r, 2)}", f"1-{a}-{b}-{c}", f"00{code} {a} {b} {c}", f"0{_number(r, 3)}/{_number(r, 6)}",
    ))


def _email(r: random.Random) -> str:
    name = r.choice((_word(r), f"{_word(r)}.{_word(r)}", f"{_word(r)}{r.randint(1, 99)}", f"{_word(r)}_{_word(r)}", f"{_word(r)}.{r.randint(1, 99)}", f"{_word(r)}-{_word(r)}+{_word(r)}"))
    host = r.choice(("example", "mail", "mail" + str(r.randint(1, 9)) + ".example", _word(r), _word(r) + "-" + _word(r)))
    at = r.choice(("@", "@", "@", "@", " @ "))
    return f"{name}{at}{host}.{r.choice(('com', 'org', 'net', 'de', 'fr', 'es', 'co.uk', 'info'))}"


def _ip(r: random.Random) -> str:
    if r.random() < 0.25:
        groups = ["".join(r.choice("0123456789abcdef") for _ in range(r.randint(1, 4))) for _ in range(8)]
        cut = r.randint(1, 5)
        return ":".join(groups) if r.random() < 0.5 else ":".join(groups[:cut]) + "::" + ":".join(groups[cut + 2 :][: r.randint(1, 4)])
    return ".".join(str(r.randint(0, 255)) for _ in range(4))


def _other(r: random.Random) -> str:
    """What looks like personal data and is none."""
    n, hexes = _number, lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    return r.choice((
        n(r, r.randint(1, 6)), f"{r.randint(1, 31)}.{r.randint(1, 12)}.{r.randint(1900, 2030)}", f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 31):02d}", f"v{r.randint(0, 9)}.{r.randint(0, 20)}.{r.randint(0, 20)}",
        f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}", f"{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}", f"${r.randint(1, 9999)}.{n(r, 2)}", f"{r.randint(1, 999)},{n(r, 3)},{n(r, 3)}", hexes(r.randint(16, 40)), f'token = "{hexes(40)}"',
        f"@{_word(r)}", n(r, r.randint(20, 30)), f"{_word(r)}{n(r, 3)}", f"{n(r, 2)} {n(r, 3)}", f"#{n(r, 5)}", f"{r.randint(1, 99)}%", f"{_word(r)} @ {_word(r)}", f"{n(r, 4)}-{n(r, 2)}", f"AK{n(r, 8)}X{n(r, 8)}",
        f"{n(r, 3)}-{n(r, 2)}-{n(r, 4)}", f"{r.randint(1, 12)}/{r.randint(1, 31)}/{r.randint(1900, 2030)}", f"{r.randint(1, 20)}.{r.randint(0, 20)}", f"{r.randint(1900, 2030)}-{r.randint(1900, 2030)}", f"{n(r, 3)} {n(r, 3)}", f"0.{n(r, 5)}", f"§ {r.randint(1, 300)}", f"{n(r, 10)}",
        f"{hexes(8)}-{hexes(4)}-{hexes(4)}", f"CC BY {r.randint(1, 4)}.0", f"{r.randint(100, 999)}-{r.randint(1, 9)}-{n(r, 2)}-{n(r, 6)}-{r.randint(0, 9)}",
    ))


def examples(n: int, seed: int, width: int = WINDOW) -> list[tuple[str, list[Span]]]:
    """Texts of width characters with their labelled spans; some are cut at an edge, as windows are."""
    r, make, out = random.Random(seed), {"email": _email, "ip": _ip, "card": _card, "phone": _phone}, []
    for _ in range(n):
        text, spans = "", []
        while len(text) < width + WINDOW:
            x = r.random()
            if x < 0.22:
                kind = r.choice(KINDS)
                s = make[kind](r)
                spans.append((kind, len(text), len(text) + len(s)))
            else:
                s = _other(r) if x < 0.45 else _word(r).capitalize() if x < 0.55 else _word(r)
            text += s + r.choice((" ", " ", " ", " ", ", ", ". ", ".\n", "*** ", "!! ", " | ", ": ", "; "))
        lo = r.randrange(len(text) - width + 1)
        out.append((text[lo : lo + width], [(k, max(a, lo) - lo, min(b, lo + width) - lo) for k, a, b in spans if a < lo + width and b > lo]))
    return out


def codes(text: str) -> np.ndarray:
    """Character classes: 1 to 128 for ASCII, 129 for the rest; 0 stands for what lies outside."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    return np.where(points < 128, points + 1, 129).astype(np.int64)


def tags(spans: list[Span], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for kind, a, b in spans:
        k = 1 + 2 * KINDS.index(kind)
        out[a:b] = k + 1
        out[a] = k
    return out


# ---- the model


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Lstm:
    """One direction. Gates stand in the order input, forget, output, candidate."""

    def __init__(self, weights: np.ndarray):
        self.w = weights  # (1 + EMBED + HIDDEN, 4 HIDDEN); the first row is the bias

    def forward(self, x: np.ndarray, keep: bool = False) -> np.ndarray:
        steps, n, _ = x.shape
        h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
        out = np.empty((steps, n, HIDDEN), x.dtype)
        into = x @ self.w[1 : 1 + EMBED] + self.w[0]
        self.saved = []
        for t in range(steps):
            z = into[t] + h @ self.w[1 + EMBED :]
            gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
            before = c
            c = gates[:, HIDDEN : 2 * HIDDEN] * before + gates[:, :HIDDEN] * new
            squashed = np.tanh(c)
            if keep:
                self.saved.append((h, before, gates, new, squashed))
            h = gates[:, 2 * HIDDEN :] * squashed
            out[t] = h
        return out

    def backward(self, x: np.ndarray, grad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of the weights and of x."""
        dw, dx = np.zeros_like(self.w), np.empty_like(x)
        dh, dc = np.zeros_like(grad[0]), np.zeros_like(grad[0])
        for t in range(len(x) - 1, -1, -1):
            h, before, gates, new, squashed = self.saved[t]
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            dh = dh + grad[t]
            dc = dc + dh * o * (1 - squashed**2)
            dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - new**2)], axis=1)
            dw[0] += dz.sum(0)
            dw[1 : 1 + EMBED] += x[t].T @ dz
            dw[1 + EMBED :] += h.T @ dz
            dx[t] = dz @ self.w[1 : 1 + EMBED].T
            dh, dc = dz @ self.w[1 + EMBED :].T, dc * f
        return dw, dx


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


#: An I tag follows a B or I of its own kind only; a window may begin inside a span.
_BARRED = np.array([[j > 0 and j % 2 == 0 and i not in (j, j - 1) for j in range(TAGS)] for i in range(TAGS)])


class Tagger:
    """Embedding, two LSTMs, a linear layer to tag scores, and CRF transitions."""

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        make = lambda *shape: (r.standard_normal(shape) * (1 / np.sqrt(shape[0]))).astype(np.float32)
        self.p = {"embed": make(130, EMBED) * 8, "left": make(1 + EMBED + HIDDEN, 4 * HIDDEN), "right": make(1 + EMBED + HIDDEN, 4 * HIDDEN), "out": make(1 + 2 * HIDDEN, TAGS), "moves": np.zeros((TAGS, TAGS), np.float32)}
        for k in ("left", "right"):
            self.p[k][0] = 0
            self.p[k][0, HIDDEN : 2 * HIDDEN] = 1

    def moves(self) -> np.ndarray:
        return np.where(_BARRED, np.float32(-30), self.p["moves"])

    def scores(self, x: np.ndarray, keep: bool = False) -> np.ndarray:
        """Tag scores (step, window, tag) of character classes (window, step)."""
        self.x = self.p["embed"][x.T]
        self.left, self.right = Lstm(self.p["left"]), Lstm(self.p["right"])
        h = np.concatenate([self.left.forward(self.x, keep), self.right.forward(self.x[::-1], keep)[::-1]], axis=2)
        self.h = h
        return h @ self.p["out"][1:] + self.p["out"][0]

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """The mean negative log-likelihood of the tag paths y, and its gradients."""
        s, moves = self.scores(x, True), self.moves()
        steps, n, _ = s.shape
        ahead, back = np.empty_like(s), np.empty_like(s)
        ahead[0], back[-1] = s[0], 0
        for t in range(1, steps):
            ahead[t] = s[t] + _log_sum(ahead[t - 1][:, :, None] + moves[None], 1)
        for t in range(steps - 2, -1, -1):
            back[t] = _log_sum(moves[None] + (s[t + 1] + back[t + 1])[:, None, :], 2)
        total = _log_sum(ahead[-1], 1)
        ds = np.exp(ahead + back - total[None, :, None])
        every, path = np.arange(n), y.T
        dm = np.zeros_like(moves)
        gold = s[np.arange(steps)[:, None], every[None], path].sum(0)
        for t in range(1, steps):
            dm += np.exp(ahead[t - 1][:, :, None] + moves[None] + (s[t] + back[t])[:, None, :] - total[:, None, None]).sum(0)
            np.add.at(dm, (path[t - 1], path[t]), -1)
            gold += moves[path[t - 1], path[t]]
        ds[np.arange(steps)[:, None], every[None], path] -= 1
        ds, dm = ds / n, np.where(_BARRED, 0, dm / n)
        flat = ds.reshape(-1, TAGS)
        dout = np.concatenate([flat.sum(0)[None], self.h.reshape(-1, 2 * HIDDEN).T @ flat])
        dh = ds @ self.p["out"][1:].T
        dl, dx = self.left.backward(self.x, dh[:, :, :HIDDEN])
        dr, dx2 = self.right.backward(self.x[::-1], dh[::-1, :, HIDDEN:])
        de = np.zeros_like(self.p["embed"])
        np.add.at(de, x.T, dx + dx2[::-1])
        return float((total - gold).mean()), {"embed": de, "left": dl, "right": dr, "out": dout, "moves": dm}


@functools.lru_cache(1)
def trained(n: int = EXAMPLES, epochs: int = EPOCHS, seed: int = SEED) -> Tagger:
    """A tagger trained with Adam on n seeded examples; the same in every process."""
    data = examples(n, seed)
    x, y = np.stack([codes(t) for t, _ in data]), np.stack([tags(s, WINDOW) for _, s in data])
    tagger, r, step = Tagger(seed), np.random.default_rng(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in tagger.p.items()} for _ in range(2))
    total = epochs * (n // BATCH)
    for _ in range(epochs):
        order = r.permutation(n)
        for lo in range(0, n - BATCH + 1, BATCH):
            rows, step = order[lo : lo + BATCH], step + 1
            _, grads = tagger.gradients(x[rows], y[rows])
            size = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            rate = RATE * (1 - 0.9 * step / total)
            for k, g in grads.items():
                g = g * min(1.0, 5 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                tagger.p[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return tagger


# ---- reading texts


def viterbi(chains: list[np.ndarray], moves: np.ndarray) -> list[np.ndarray]:
    """The best tag path of each chain of tag scores (step, tag). Chains of like length are decoded side by side."""
    out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(chains)
    order = sorted(range(len(chains)), key=lambda k: -len(chains[k]))
    while order:
        longest = max(1, len(chains[order[0]]))
        part, order = order[: max(1, CHAIN_CELLS // longest)], order[max(1, CHAIN_CELLS // longest) :]
        sizes = np.array([len(chains[k]) for k in part])
        scores = np.zeros((longest, len(part), TAGS), np.float32)
        for j, k in enumerate(part):
            scores[: sizes[j], j] = chains[k]
        best, came = scores[0].copy(), np.zeros((longest, len(part), TAGS), np.int8)
        for t in range(1, longest):
            n = np.searchsorted(-sizes, -t, side="left")  # chains longer than t stand first
            through = best[:n, :, None] + moves
            came[t, :n] = through.argmax(1)
            best[:n] = through.max(1) + scores[t, :n]
        tag = best.argmax(1)
        path = np.zeros((longest, len(part)), np.int64)
        for t in range(longest - 1, -1, -1):
            here = sizes > t
            path[t, here] = tag[here]
            tag[here] = came[t, here, tag[here]] if t else tag[here]
        for j, k in enumerate(part):
            out[k] = path[: sizes[j], j]
    return out


def chain_scores(text: str, tagger: Tagger) -> Iterator[tuple[int, np.ndarray]]:
    """Where each stretch of windows with a digit or an @ begins, and the tag scores of its characters."""
    half = WINDOW // 2
    x = codes(text)
    blocks = np.unique(np.flatnonzero(((x >= 49) & (x <= 58)) | (x == 65)) // half)
    if not len(blocks):
        return
    # A block of half a window is scored if it or a neighbour has a digit or an @; block 0 of the padded text stands before the text.
    scored = np.unique(np.concatenate([blocks, blocks + 1, blocks + 2]))
    scored = scored[(scored >= 1) & ((scored - 1) * half < len(x))]
    starts = np.unique(np.concatenate([scored - 1, scored]))
    padded = np.concatenate([np.zeros(half, np.int64), x, np.zeros(2 * half, np.int64)])
    weight = np.minimum(np.arange(1, WINDOW + 1), np.arange(WINDOW, 0, -1)).astype(np.float32)[:, None] / (half + 1)
    sums: dict[int, np.ndarray] = {}
    for lo in range(0, len(starts), BATCH_WINDOWS):
        part = starts[lo : lo + BATCH_WINDOWS]
        found = tagger.scores(np.stack([padded[k * half : k * half + WINDOW] for k in part])).transpose(1, 0, 2) * weight
        for k, s in zip(part.tolist(), found):
            for b, piece in ((k, s[:half]), (k + 1, s[half:])):
                sums[b] = sums[b] + piece if b in sums else piece
    edges = np.flatnonzero(np.diff(scored) > 1) + 1
    for run in np.split(scored, edges):
        begin = (int(run[0]) - 1) * half
        yield begin, np.concatenate([sums[b] for b in run.tolist()])[: len(x) - begin]


def model_spans(texts: list[str], tagger: Tagger) -> list[list[Span]]:
    """Spans of the model in each text, by start, before they meet base spans. Marks and spaces at their ends are no part of them."""
    out: list[list[Span]] = [[] for _ in texts]
    chains = [(k, begin, scores) for k, text in enumerate(texts) for begin, scores in chain_scores(text, tagger)]
    for (k, begin, _), path in zip(chains, viterbi([c[2] for c in chains], tagger.moves())):
        at = 0
        for p in np.flatnonzero(path).tolist():
            if p < at:
                continue
            kind, at = (int(path[p]) - 1) // 2, p + 1
            while at < len(path) and path[at] == 2 * kind + 2:
                at += 1
            a, b = begin + p, begin + at
            while a < b and not (texts[k][a].isalnum() or texts[k][a] in "+(:"):
                a += 1
            while a < b and not texts[k][b - 1].isalnum():
                b -= 1
            if b - a >= LEAST and _HINT.search(texts[k], a, b):
                out[k].append((KINDS[kind], a, b))
    return out


def merged(base: list[Span], model: list[Span]) -> list[Span]:
    """Base spans, and those of the model that overlap none of them."""
    taken = sorted((a, b) for _, a, b in base)
    starts, ends = [a for a, _ in taken], list(itertools.accumulate((b for _, b in taken), max))
    free = [s for s in model if (k := bisect.bisect_left(starts, s[2])) == 0 or ends[k - 1] <= s[1]]
    return sorted([*base, *free], key=lambda s: (KINDS.index(s[0]), s[1]))


def listed(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find_spans(docs: DataFrame, tagger: Tagger | None = None) -> DataFrame:
    """doc_id, counts of base spans by kind, the digest of base spans, all spans and their number, for every row of docs (doc_id, text)."""
    tagger = tagger or trained()

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100):
                part = batch.slice(lo, 100)
                texts = [x or "" for x in part["text"].to_pylist()]
                base = [base_spans(t) for t in texts]
                hinted = [k for k, t in enumerate(texts) if _HINT.search(t)]
                spans = list(base)
                for k, found in zip(hinted, model_spans([texts[k] for k in hinted], tagger)):
                    spans[k] = merged(base[k], found)
                counts = [pa.array([sum(s[0] == kind for s in b) for b in base], pa.int64()) for kind in KINDS]
                digest = [hashlib.sha256(listed(sorted(b, key=lambda s: (KINDS.index(s[0]), s[1]))).encode()).hexdigest() for b in base]
                yield pa.RecordBatch.from_arrays([part["doc_id"], *counts, pa.array(digest), pa.array([listed(s) for s in spans]), pa.array([len(s) for s in spans], pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_spans"])

    return docs.select("doc_id", "text").mapInArrow(apply, SCHEMA)
