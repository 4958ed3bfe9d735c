"""Personal data in whole texts: fixed patterns, and a character-level BiLSTM-CRF that adds to them."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch

KINDS = ("email", "ip", "card", "phone")
# What the network finds: the same, and keys and tokens, which no fixed pattern knows.
ALL_KINDS = (*KINDS, "secret")
# What every kind of personal data has at least one of; the network looks at all text around it.
TRIGGERS = "0123456789@"


@dataclass(frozen=True)
class PiiParams:
    """The network, its training, and the windows that texts are decoded in.

    A window overlaps half of the next one. At most `train_windows` windows with labelled spans, a
    sample by hash of id and place, are fitted in `steps` steps of `batch` windows.
    """

    hidden: int = 16
    window: int = 64
    train_windows: int = 2000
    steps: int = 220
    batch: int = 64
    rate: float = 0.02
    seed: int = 11


# --- fixed patterns ---------------------------------------------------------------------------

# The patterns of the four kinds. A match of the last three begins where a run of
# digits (or a plus) begins, so that looking behind changes nothing but saves failing starts.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"(?<![0-9])[0-9]([ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

Span = tuple[str, int, int]


def _emails(text: str) -> Iterator[Span]:
    """Leftmost matches of the local part, `@` and at least two labels, without overlap."""
    free, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > free and text[begin - 1] in _LOCAL:
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            free = found.end()
            yield "email", begin, free
        at = text.find("@", max(at + 1, free))


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _is_ip(text: str) -> bool:
    return all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in text.split("."))


def _is_card(text: str) -> bool:
    digits = _digits(text)
    return 12 <= len(digits) <= 19 and luhn(digits)


def base_spans(text: str | None) -> list[Span]:
    """Spans of the fixed patterns, by start and then by kind as listed; ends are exclusive."""
    text = text or ""
    out = list(_emails(text))
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if _is_ip(m[0])]
    out += [("card", *m.span()) for m in _CARD.finditer(text) if _is_card(m[0])]
    if "+" in text:
        out += [
            ("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15
        ]
    return sorted(out, key=span_order)


def span_order(span: Span) -> tuple:
    return span[1], ALL_KINDS.index(span[0]), span[2]


def spelled(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


# --- the network ------------------------------------------------------------------------------

# Characters by class: each mark that personal data is made of, digits, letters, space, the rest.
_MARKS = "@.-+()_%:/=\"'"
N_CLASSES = len(_MARKS) + 5
N_TAGS = 2 * len(ALL_KINDS) + 1  # outside, then first and further characters of each kind


def classes(text: str) -> np.ndarray:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return _CLASS[np.minimum(codes, 128)]


def _class_table() -> np.ndarray:
    out = np.full(129, N_CLASSES - 1, np.int64)
    out[128] = N_CLASSES - 2
    for i in range(128):
        c = chr(i)
        if c in _MARKS:
            out[i] = _MARKS.index(c)
        elif c.isdigit():
            out[i] = len(_MARKS)
        elif c.isalpha():
            out[i] = len(_MARKS) + 1
        elif c.isspace():
            out[i] = len(_MARKS) + 2
    return out


_CLASS = _class_table()


def tags_of(spans: list[Span], length: int) -> np.ndarray:
    """Tags of characters; of spans that overlap, the first is marked."""
    out = np.zeros(length, np.int64)
    for kind, start, end in spans:
        if not out[start:end].any():
            out[start:end] = 2 * ALL_KINDS.index(kind) + 2
            out[start] -= 1
    return out


def spans_of(tags: np.ndarray) -> list[Span]:
    out: list[Span] = []
    for i in np.flatnonzero(tags).tolist():
        kind, first = ALL_KINDS[(tags[i] - 1) // 2], tags[i] % 2 == 1
        if out and out[-1][0] == kind and out[-1][2] == i and not first:
            out[-1] = (kind, out[-1][1], i + 1)
        else:
            out.append((kind, i, i + 1))
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


class BiLstmCrf:
    """Weights by name; inputs are (time, batch) arrays of character classes."""

    def __init__(self, params: PiiParams):
        rng = np.random.default_rng(params.seed)
        h = params.hidden
        self.hidden = h
        self.weights = {"emit": rng.normal(0, 0.2, (2 * h, N_TAGS)), "bias": np.zeros(N_TAGS)}
        self.weights["moves"] = np.zeros((N_TAGS, N_TAGS))
        for side in ("ahead", "back"):
            self.weights[f"{side}_in"] = rng.normal(0, 0.3, (N_CLASSES, 4 * h))
            self.weights[f"{side}_state"] = rng.normal(0, 0.3, (h, 4 * h))
            offset = np.zeros(4 * h)
            offset[h : 2 * h] = 1  # gates start open for what is remembered
            self.weights[f"{side}_bias"] = offset

    def _lstm(self, x: np.ndarray, side: str) -> tuple[np.ndarray, list]:
        w, h = self.weights, self.hidden
        given = w[f"{side}_in"][x] + w[f"{side}_bias"]
        state = cell = np.zeros((x.shape[1], h))
        out, trace = np.empty((*x.shape, h)), []
        for t in range(len(x)):
            z = given[t] + state @ w[f"{side}_state"]
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            before, past = cell, state
            cell = f * cell + i * g
            squashed = np.tanh(cell)
            state = o * squashed
            out[t] = state
            trace.append((i, f, o, g, before, past, squashed))
        return out, trace

    def _lstm_grad(self, x, side: str, trace: list, d_out: np.ndarray, grads: dict) -> None:
        w, h = self.weights, self.hidden
        d_z = np.empty((*x.shape, 4 * h))
        d_state = d_cell = np.zeros((x.shape[1], h))
        d_w = np.zeros_like(w[f"{side}_state"])
        for t in range(len(x) - 1, -1, -1):
            i, f, o, g, before, past, squashed = trace[t]
            d_h = d_out[t] + d_state
            d_c = d_cell + d_h * o * (1 - squashed**2)
            d_z[t, :, :h] = d_c * g * i * (1 - i)
            d_z[t, :, h : 2 * h] = d_c * before * f * (1 - f)
            d_z[t, :, 2 * h : 3 * h] = d_h * squashed * o * (1 - o)
            d_z[t, :, 3 * h :] = d_c * i * (1 - g**2)
            d_w += past.T @ d_z[t]
            d_state = d_z[t] @ w[f"{side}_state"].T
            d_cell = d_c * f
        grads[f"{side}_state"], grads[f"{side}_bias"] = d_w, d_z.sum(axis=(0, 1))
        one = np.eye(N_CLASSES)[x.ravel()]
        grads[f"{side}_in"] = one.T @ d_z.reshape(-1, 4 * h)

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, tuple]:
        ahead, a = self._lstm(x, "ahead")
        back, b = self._lstm(x[::-1], "back")
        both = np.concatenate([ahead, back[::-1]], axis=2)
        return both @ self.weights["emit"] + self.weights["bias"], (both, a, b)

    def loss(self, x: np.ndarray, tags: np.ndarray) -> tuple[float, dict]:
        """Mean negative log likelihood of the tags, and the gradients."""
        scores, (both, a, b) = self.emissions(x)
        moves = self.weights["moves"]
        steps, batch, _ = scores.shape
        ahead = np.empty_like(scores)
        ahead[0] = scores[0]
        for t in range(1, steps):
            ahead[t] = _logsum(ahead[t - 1][:, :, None] + moves, 1) + scores[t]
        back = np.zeros_like(scores)
        for t in range(steps - 2, -1, -1):
            back[t] = _logsum(moves + (scores[t + 1] + back[t + 1])[:, None, :], 2)
        total = _logsum(ahead[-1], 1)
        one = np.eye(N_TAGS)[tags]
        pairs = np.exp(
            ahead[:-1][:, :, :, None] + moves + (scores[1:] + back[1:])[:, :, None, :]
            - total[None, :, None, None]
        ).sum(axis=(0, 1))
        seen = np.einsum("tbi,tbj->ij", one[:-1], one[1:])
        gold = (scores * one).sum() + (moves * seen).sum()
        d_scores = (np.exp(ahead + back - total[None, :, None]) - one) / batch
        grads = {"moves": (pairs - seen) / batch, "bias": d_scores.sum(axis=(0, 1))}
        grads["emit"] = np.einsum("tbh,tbk->hk", both, d_scores)
        d_both = d_scores @ self.weights["emit"].T
        self._lstm_grad(x, "ahead", a, d_both[:, :, : self.hidden], grads)
        self._lstm_grad(x[::-1], "back", b, d_both[::-1, :, self.hidden :], grads)
        return float((total.sum() - gold) / batch), grads

    def decode(self, x: np.ndarray) -> np.ndarray:
        """The most likely tags, as (time, batch)."""
        scores, _ = self.emissions(x)
        moves = self.weights["moves"]
        best, came = scores[0], np.zeros(scores.shape, np.int64)
        for t in range(1, len(x)):
            paths = best[:, :, None] + moves
            came[t] = paths.argmax(axis=1)
            best = paths.max(axis=1) + scores[t]
        out = np.empty(x.shape, np.int64)
        out[-1] = best.argmax(axis=1)
        for t in range(len(x) - 1, 0, -1):
            out[t - 1] = np.take_along_axis(came[t], out[t][:, None], 1)[:, 0]
        return out


def fit(x: np.ndarray, tags: np.ndarray, params: PiiParams) -> BiLstmCrf:
    """Fit to (windows, characters) arrays of classes and tags, by Adam."""
    model = BiLstmCrf(params)
    if not len(x):
        return model
    rng = np.random.default_rng(params.seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    for step in range(1, params.steps + 1):
        use = rng.integers(0, len(x), params.batch)
        _, grads = model.loss(x[use].T, tags[use].T)
        norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
        rate = params.rate * (1 - 0.8 * step / params.steps)
        for k, g in grads.items():
            g = g * min(1.0, 5.0 / max(norm, 1e-12))
            first[k] += 0.1 * (g - first[k])
            second[k] += 0.01 * (g**2 - second[k])
            mean, square = first[k] / (1 - 0.9**step), second[k] / (1 - 0.99**step)
            model.weights[k] -= rate * mean / (np.sqrt(square) + 1e-8)
    return model


# --- training windows and decoding ------------------------------------------------------------

# Assignments that label keys and tokens; the network learns them without the words and quotes too.
_ASSIGNED = re.compile(
    r"(?i)\b(?:token|secret|passw(?:or)?d|(?:api|access|secret)[ _-]?key)\b[\"']?\s?[:=]\s?([\"'])([^\s\"']{12,})\1"
)
# Characters of a key or token, and the least number of them.
_KEY_RUN = re.compile(r"[A-Za-z0-9_+/=-]+")
KEY_LENGTH = 20
_HEX, _MIXED = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def labelled_spans(text: str | None) -> list[Span]:
    """Spans to learn from: those of the fixed patterns, and assigned keys and tokens."""
    given = base_spans(text)
    keys = [("secret", m.start(2), m.end(2)) for m in _ASSIGNED.finditer(text or "") if _is_key(m[2])]
    free = [k for k in keys if all(k[2] <= s[1] or k[1] >= s[2] for s in given)]
    return sorted(given + free, key=span_order)


def _is_key(piece: str) -> bool:
    """Letters and digits that change often, as in no word, number or address."""
    if len(piece) < KEY_LENGTH or not _KEY_RUN.fullmatch(piece):
        return False
    kinds = ["9" if c.isdigit() else "a" for c in piece if c.isalnum()]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    return changes >= len(piece) // 8 and {"9", "a"} <= set(kinds)


def _varied(text: str, span: Span, rng: np.random.Generator) -> tuple[str, Span]:
    """The same piece of personal data as people also write it, beyond the fixed patterns."""
    kind, start, end = span
    piece = text[start:end]
    if kind == "email":
        piece = piece.replace("@", rng.choice([" @ ", "@ ", " @"]))
    elif kind == "ip":
        piece = piece.replace(".", " . ") if rng.random() < 0.5 else piece.replace(".", ". ")
    elif kind == "card":
        sep = rng.choice([".", "  ", "/", " - "])
        digits = _digits(piece)
        piece = sep.join(digits[i : i + 4] for i in range(0, len(digits), 4))
    elif kind == "secret":
        # Another value behind another mark, in other quotes or none.
        letters = list(rng.choice([_HEX, _MIXED, _HEX.upper()]))
        piece = "".join(rng.choice(letters, rng.integers(KEY_LENGTH, 56)))
        mark, quote = rng.choice([" ", "=", ": ", " = "]), rng.choice(["", '"', "'"])
        before = text[:start].rstrip("\"' =:") + mark + quote
        text = before + text[start:end] + quote + " " + text[end:].lstrip("\"' ")
        start, end = len(before), len(before) + end - start
    else:
        # Without the plus, and with or without what follows it directly.
        piece = piece[1:] if rng.random() < 0.7 else piece.replace("+", "00", 1)
    return text[:start] + piece + text[end:], (kind, start, start + len(piece))


def _labelled_rows(params: PiiParams):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                text = value.as_py()
                for kind, start, end in labelled_spans(text):
                    # Where in its window a span stands depends on it alone.
                    lead = (start * 7 + (doc_id or 0)) % (params.window // 2)
                    low = max(0, start - lead)
                    out.append((doc_id, start, text[low : low + 2 * params.window], kind, start - low, end - low))
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.record_batch(
                [pa.array(c, f.type) for c, f in zip(columns, _LABELLED)], schema=_LABELLED
            )

    return run


_LABELLED = pa.schema(
    [("doc_id", pa.int64()), ("place", pa.int64()), ("text", pa.string()), ("kind", pa.string())]
    + [("start", pa.int64()), ("end", pa.int64())]
)


def learn(docs: DataFrame, scratch: Scratch, params: PiiParams = PiiParams()) -> BiLstmCrf:
    """Fit the network to labelled spans in a bounded sample of windows.

    Labels are the matches of the fixed patterns, and keys and tokens where a text assigns one to a name.

    The sample holds as many windows of each kind as there are, up to a fifth of `train_windows`,
    those of least hash. Half of them are rewritten into other spellings of the same data, with the
    label kept, so that the network learns more than the patterns know.
    """
    texts = docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]"))
    found = scratch.table(
        texts.mapInArrow(
            _labelled_rows(params),
            "doc_id long, place long, text string, kind string, start long, end long",
        ),
        "labelled",
    )
    rng = np.random.default_rng(params.seed)
    x, y = [], []
    rows = []
    for kind in ALL_KINDS:
        rows += (
            found.where(F.col("kind") == kind)
            .orderBy(F.xxhash64("doc_id", "place"), "doc_id", "place")
            .limit(params.train_windows // len(ALL_KINDS))
            .collect()
        )
    for row in rows:
        text, span = row["text"], (row["kind"], row["start"], row["end"])
        if rng.random() < 0.5:
            text, span = _varied(text, span, rng)
        around = [s for s in labelled_spans(text) if s[2] <= span[1] or s[1] >= span[2]]
        tags = tags_of(sorted([span, *around], key=lambda s: s[1]), max(len(text), params.window))
        padded = np.full(len(tags), N_CLASSES - 1, np.int64)
        padded[: len(text)] = classes(text)
        x.append(padded[: params.window])
        y.append(tags[: params.window])
    shape = (len(x), params.window)
    return fit(np.array(x).reshape(shape).astype(int), np.array(y).reshape(shape).astype(int), params)


def _windows(text: str, size: int) -> np.ndarray:
    """Where windows begin: all places on a grid of half a window from which one has a trigger."""
    half = size // 2
    codes = classes(text)
    marks = np.flatnonzero((codes == _MARKS.index("@")) | (codes == len(_MARKS)))
    cells = np.unique(marks // half)
    return np.unique(np.concatenate([np.maximum(cells - 1, 0), cells])) * half


def _decoded(model: BiLstmCrf, texts: list[str], size: int) -> list[np.ndarray]:
    """Tags of each text; of overlapping windows, the one counts in which a character is inner.

    That is the middle half of a window, and what is beyond it at the ends of a stretch of windows.
    """
    half, quarter = size // 2, size // 4
    starts = [_windows(t, size) for t in texts]
    owner = np.repeat(np.arange(len(texts)), [len(s) for s in starts])
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    coded = [np.concatenate([classes(t), np.full(size, N_CLASSES - 1)]) for t in texts]
    tags = [np.zeros(len(t) + size, np.int64) for t in texts]
    for low in range(0, len(begin), 512):
        rows = range(low, min(low + 512, len(begin)))
        x = np.stack([coded[owner[i]][begin[i] : begin[i] + size] for i in rows], axis=1)
        y = model.decode(x)
        for j, i in enumerate(rows):
            d, at = owner[i], begin[i]
            follows = i > 0 and owner[i - 1] == d and begin[i - 1] == at - half
            leads = i + 1 < len(begin) and owner[i + 1] == d and begin[i + 1] == at + half
            a, b = quarter if follows else 0, size - quarter if leads else size
            tags[d][at + a : at + b] = y[a:b, j]
    return [t[: len(text)] for t, text in zip(tags, texts)]


def _valid(kind: str, piece: str) -> bool:
    """Whether what the network found can be what it says, apart from how it is written."""
    digits = _digits(piece)
    if kind == "email":
        return bool(re.fullmatch(r"[^\s@]+\s?@\s?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", piece))
    if kind == "ip":
        parts = re.split(r"\s*\.\s*", piece)
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", x) for x in parts) and _is_ip(".".join(parts))
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "secret":
        return _is_key(piece)
    return 9 <= len(digits) <= 15 and len(piece) <= 2 * len(digits)


def _run_around(text: str, start: int, end: int) -> tuple[int, int]:
    """The run of characters of a key that holds the longest one within a range."""
    runs = [m.span() for m in _KEY_RUN.finditer(text, start, end)]
    if not runs:
        return start, end
    start, end = max(runs, key=lambda r: r[1] - r[0])
    while start and _KEY_RUN.match(text[start - 1]):
        start -= 1
    return start, _KEY_RUN.match(text, start).end()


def added_spans(text: str, tags: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of the network that meet no base span, nor each other, and can be personal data."""
    starts = [s[1] for s in base]
    ends = list(accumulate((s[2] for s in base), max))
    out: list[Span] = []
    seen = 0
    for kind, start, end in spans_of(tags):
        if kind == "secret":
            if start < seen:
                continue
            # The whole run of characters, if the network saw half of it as one.
            low, seen = _run_around(text, start, end)
            if 2 * (end - start) < seen - low:
                continue
            start, end = low, seen
        piece = text[start:end]
        start += len(piece) - len(piece.lstrip())
        end -= len(piece) - len(piece.rstrip())
        before = bisect_left(starts, end)
        free = not before or ends[before - 1] <= start
        if free and (not out or out[-1][2] <= start) and _valid(kind, text[start:end]):
            out.append((kind, start, end))
    return out


def find(
    docs: DataFrame, model: BiLstmCrf, params: PiiParams = PiiParams(),
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: `doc_id`, `base` and `added`, arrays of (kind, start, end).

    Places are code points, ends exclusive. Base spans are all matches of the fixed patterns; added
    ones come from the network, keys and tokens (`secret`) among them, and never overlap. Null and empty texts have none. Rows may
    repeat; other columns are not read; no rows give no rows.

    The network sees every window of a whole text that has a digit or an `@`; without one nothing
    can be a span of any kind.
    """
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    names = ("kind", "start", "end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trigger = re.compile(f"[{TRIGGERS}]")
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                n = batch.num_rows
                base: list[list] = [[] for _ in range(n)]
                more: list[list] = [[] for _ in range(n)]
                some = [
                    (i, text)
                    for i, value in enumerate(batch.column(1))
                    if (text := value.as_py()) and trigger.search(text)
                ]
                decoded = _decoded(model, [t for _, t in some], params.window)
                for (i, text), tags in zip(some, decoded):
                    base[i] = base_spans(text)
                    more[i] = added_spans(text, tags, base[i])
                lists = [
                    pa.array([[dict(zip(names, s)) for s in row] for row in rows], span)
                    for rows in (base, more)
                ]
                yield pa.record_batch([batch.column(0), *lists], ["doc_id", "base", "added"])

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = "array<struct<kind: string, start: long, end: long>>"
    return texts.mapInArrow(run, f"doc_id long, base {kind}, added {kind}")
