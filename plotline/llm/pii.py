"""Personal data by a linear-chain conditional random field over word shapes.

The field is trained in numpy by full-batch gradient steps on a small labelled table, written by rule
below, and is decoded by Viterbi over padded batches of lines. Its features are shapes of a word and
its neighbours, so it also marks data that no pattern fits: card-like numbers that fail the checksum,
quoted secrets, phone numbers without a plus. Patterns for four kinds are held beside it; their spans
always stay, and spans of the field that overlap them, or that a plain look at their characters
contradicts, are dropped.

Cases: a null or empty text has no spans; a line longer than WINDOW words is decoded in windows that
overlap by OVERLAP words, each word taken from the window that holds it deeper; two spans never share
a character, except base spans of different kinds, which all stay; repeated rows are searched each by
itself; an empty table gives no rows. Redaction keeps all columns, whatever their names, and brings
``n_chars`` up to date where there is one of integers.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import fit_in_task, kept
from plotline.llm.units import bound_batches, texts_of

#: Kinds in their listed order, and the patterns of the base kinds (fixed values).
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = KINDS[:4]
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

WINDOW, OVERLAP = 192, 16
_NONDIGIT = re.compile(r"[^0-9]+")
_MEMO, _MEMO_CHARACTERS = 150_000, 8_000_000  # words remembered in a worker
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns, leftmost and non-overlapping within a kind; failing matches are dropped.

    Each takes time in proportion to the text: an address is looked for from its sign, and a number from
    its first digit only, since a match from a later digit would have been one from the first.
    """
    out = _emails(text) if "@" in text else []
    for m in _IP_RUN.finditer(text):
        if all(int(p) <= 255 if len(p) < 40 else not p.lstrip("0") for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NONDIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(_NONDIGIT.sub("", m[0])) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


_IP_RUN = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")  # IP, from the first digit of a run
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")


def _emails(text: str) -> list[Span]:
    """Matches of EMAIL: the run of local characters before each sign, with a domain behind it."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, 0, end := m.end()))
        at = text.find("@", max(at + 1, end))
    return out


# --- word features -----------------------------------------------------------------------------

_CUES = ("token", "secret", "key", "password", "=", ":", "email", "mail", "contact", "call", "phone", "tel", "card", "visa", "ip", "address", "from", "version", "in", "year", "page", "isbn", "order", "at", "$", "total", "of")
_TRIM = "\"'.,;:!?()[]{}<>|*#%&$"


def _shape(word: str) -> str:
    s = re.sub(r"[0-9]+", "d", word)
    s = re.sub(r"[A-Z]+", "X", s)
    s = re.sub(r"[^\W\d_A-Z]+", "x", s)
    return re.sub(r"(?:[dxX]{2,})", "m", s)[:10]


def word_features(word: str) -> list[str]:
    """What the field sees of one word; plain words share a handful of features."""
    core = word.strip(_TRIM)
    if core.isalpha():
        low = core.lower()
        return ["alpha", f"cue={low}"] if low in _CUES else ["alpha"]
    if not core:
        return ["sign", f"cue={word}"] if word in _CUES else ["sign"]
    digits = sum(c in "0123456789" for c in core)
    hexa = len(core) >= 16 and digits > 0 and digits < len(core) and all(c in "0123456789abcdefABCDEF" for c in core)
    out = [f"shape={_shape(core)}", f"digits={min(digits, 20)}", f"length={min(len(core), 48) // 6}"]
    mixed = len(core) >= 16 and core.isalnum() and 3 < digits < len(core) - 3
    out += [name for name, has in (("at", "@" in core[1:-1]), ("dots3", core.count(".") == 3), ("plus", word.startswith(("+", "(+"))), ("paren", word.startswith("(")), ("hex", hexa), ("mixed", mixed), ("quoted", word[:1] in "\"'"), ("all-digits", digits == len(core))) if has]
    return out


# --- the labelled table ------------------------------------------------------------------------


def labelled_table(rows: int = 420, seed: int = 7) -> list[list[tuple[str, int]]]:
    """Lines of ``(word, label)``; label 0 is outside, 1 + 2k begins kind k and 2 + 2k goes on with it."""
    rng = random.Random(seed)
    syllables = ("an", "er", "th", "ing", "ou", "re", "ti", "on", "ch", "ein", "eau", "que", "ció", "la", "ß", "ment")
    marks = ("", "", "", "", ".", ",", "!!", "%%%", "&&&", "***", "###", "$$$")

    def plain() -> str:
        w = "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
        w = rng.choice((w, w, w, w.capitalize(), w.upper()))
        return w + rng.choice(marks) if rng.random() < 0.4 else w

    def digits(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def email() -> list[str]:
        user = rng.choice((f"{plain().strip(_TRIM)}.{digits(2)}", "".join(rng.choice("abcdefghij") for _ in range(6)), f"j{digits(3)}"))
        host = rng.choice(("mail", "post", "web")) + rng.choice(("", digits(1))) + rng.choice((".example.com", ".org", ".co.uk", ".net"))
        return [f"{user}@{host}"]

    def phone() -> list[str]:
        return rng.choice((["+" + digits(1), f"({digits(3)})", f"{digits(3)}-{digits(4)}"], ["+" + digits(2), digits(3), digits(7)], ["+" + digits(11)], [f"({digits(3)})", f"{digits(3)}-{digits(4)}"], [f"{digits(3)}-{digits(3)}-{digits(4)}"]))

    def card() -> list[str]:
        return rng.choice(([digits(16)], [digits(16)], [digits(15)], [digits(4) for _ in range(4)], ["-".join(digits(4) for _ in range(4))]))

    def address() -> list[str]:
        return [".".join(str(rng.randint(0, 255)) for _ in range(4))]

    def secret() -> list[str]:
        kind = rng.choice(("0123456789abcdef", "0123456789abcdef", "ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz23456789"))
        word = "".join(rng.choice(kind) for _ in range(rng.choice((32, 40, 40, 40, 64))))
        word = word.upper() if rng.random() < 0.2 else word
        return [rng.choice((f'"{word}"', f'"{word}"', f"'{word}'", word))]

    def other() -> list[str]:
        return rng.choice((["in", str(rng.randint(1600, 2030))], ["version", f"{digits(1)}.{digits(1)}.{digits(2)}"], [f"{digits(1)}.{digits(1)}."], ["page", digits(3)], [digits(rng.randint(1, 6))], [f"{digits(2)}:{digits(2)}"], [f"{digits(4)}-{digits(2)}-{digits(2)}"], [f"${digits(3)}.{digits(2)}"], [f"{digits(2)}%"], [f"{digits(1)},{digits(3)},{digits(3)}"], ["|"], ["and/or"], [f"{digits(1)}st"], [f"B{digits(2)}"], ["https://www.example.org/a/b"], ["CC", "BY-NC", f"{digits(1)}.0."], [f"{digits(3)}-{digits(3)}"]))

    makers = (email, address, card, phone, secret)
    cues = ((), ("contact",), ("email",), ("card",), ("call",), ("token", "="), ("key", "="), ("secret", ":"), ("ip", "address"))
    table = []
    for k in range(rows):
        line = [(plain(), 0) for _ in range(rng.randint(0, 7))]
        for _ in range(rng.choice((1, 1, 2))):
            if k % 3 < 2:
                which = rng.randrange(len(makers))
                fits = {0: (1, 2), 1: (8,), 2: (3,), 3: (4,), 4: (5, 6, 7)}[which]
                line += [(c, 0) for c in cues[rng.choice((0, 0, *fits))]]
                line += [(w, 2 + 2 * which if i else 1 + 2 * which) for i, w in enumerate(makers[which]())]
                if rng.random() < 0.25:
                    line[-1] = (line[-1][0] + rng.choice(marks[4:]), line[-1][1])
            else:
                line += [(w, 0) for w in other()]
            line += [(plain(), 0) for _ in range(rng.randint(1, 7))]
        table.append(line)
    return table


# --- the field ---------------------------------------------------------------------------------

LABELS = 1 + 2 * len(KINDS)


class Field:
    """Weights: features of the word, of the one before and of the one after; and label transitions."""

    def __init__(self, features: dict[str, int], weights: np.ndarray, moves: np.ndarray):
        self.features, self.weights, self.moves = features, weights, moves

    def emissions(self, word: str) -> np.ndarray:
        """``3 x labels``: what the word says of its own label and of those of the words after and before it."""
        at = [self.features[f] for f in word_features(word) if f in self.features]
        return self.weights[:, at].sum(axis=1)


def _allowed() -> np.ndarray:
    """0 where a label may follow another, minus infinity else: a span goes on only after its own kind."""
    out = np.zeros((LABELS, LABELS))
    for k in range(len(KINDS)):
        out[:, 2 + 2 * k] = -1e4
        out[[1 + 2 * k, 2 + 2 * k], 2 + 2 * k] = 0
    return out


def train(table: list[list[tuple[str, int]]], steps: int = 80, rate: float = 0.2, ridge: float = 2e-3) -> Field:
    """Conditional likelihood, by forward and backward passes over the padded table and Adam steps."""
    names: dict[str, int] = {}
    rows = [[[names.setdefault(f, len(names)) for f in word_features(w)] for w, _ in line] for line in table]
    n, t = len(table), max(map(len, table))
    x = np.zeros((n, t + 2, len(names)), np.float32)
    y, mask = np.zeros((n, t), int), np.zeros((n, t))
    for i, line in enumerate(rows):
        for j, fs in enumerate(line):
            x[i, j + 1, fs] = 1
            y[i, j], mask[i, j] = table[i][j][1], 1
    seen = [x[:, 1:-1].reshape(n * t, -1), x[:, :-2].reshape(n * t, -1), x[:, 2:].reshape(n * t, -1)]
    fixed = _allowed()
    params = [np.zeros((3, len(names), LABELS)), np.zeros((LABELS, LABELS))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    gold = np.eye(LABELS)[y] * mask[..., None]
    gold_moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
    for step in range(1, steps + 1):
        w, moves = params
        e = sum(s @ w[k].astype(np.float32) for k, s in enumerate(seen)).reshape(n, t, LABELS).astype(float)
        a = np.exp(moves + fixed)
        e = np.where(mask[..., None] > 0, e, 0)
        scale = e.max(axis=2, keepdims=True)
        p = np.exp(e - scale)
        forward, backward = np.zeros_like(p), np.ones_like(p)
        forward[:, 0] = p[:, 0] * np.exp(fixed[0])
        forward[:, 0] /= forward[:, 0].sum(axis=1, keepdims=True)
        for j in range(1, t):
            f = (forward[:, j - 1] @ a) * p[:, j]
            forward[:, j] = np.where(mask[:, j, None] > 0, f / f.sum(axis=1, keepdims=True), forward[:, j - 1])
        pair = np.zeros((LABELS, LABELS))
        for j in range(t - 2, -1, -1):
            b = (p[:, j + 1] * backward[:, j + 1]) @ a.T
            both = forward[:, j, :, None] * a * (p[:, j + 1] * backward[:, j + 1])[:, None, :]
            both /= np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-300)
            pair += (both * mask[:, j + 1, None, None]).sum(axis=0)
            backward[:, j] = np.where(mask[:, j + 1, None] > 0, b / np.maximum(b.sum(axis=1, keepdims=True), 1e-300), 1.0)
        post = forward * backward
        post = post / post.sum(axis=2, keepdims=True) * mask[..., None]
        error = ((post - gold) / n).reshape(n * t, LABELS).astype(np.float32)
        grads = [np.stack([s.T @ error for s in seen]) + ridge * w, (pair - gold_moves) / n + ridge * moves]
        for p_, g, (m, v) in zip(params, grads, moments, strict=True):
            m += 0.1 * (g - m)
            v += 0.02 * (g * g - v)
            p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)
    return Field(names, params[0], params[1] + fixed)


def viterbi(e: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Best labels of padded lines: ``e`` is lines x words x labels; a line may not begin inside a span."""
    n, t, k = e.shape
    into = np.ascontiguousarray(moves.T, np.float32)  # to, from
    back = np.zeros((t, n, k), np.int8)
    score = e[:, 0] + _allowed()[0].astype(np.float32)
    last = score.copy()
    for j in range(1, t):
        live = int(np.searchsorted(-lengths, -j, side="left"))  # lines are sorted by falling length
        if not live:
            break
        paths = score[:live, None, :] + into
        best = paths.argmax(axis=2)
        back[j, :live] = best
        score[:live] = np.take_along_axis(paths, best[..., None], 2)[..., 0] + e[:live, j]
        last[:live] = score[:live]
    out = np.zeros((n, t), np.int8)
    at = last.argmax(axis=1)
    rows = np.arange(n)
    for j in range(t - 1, -1, -1):
        inside = lengths > j
        out[inside, j] = at[inside]
        at = np.where(inside & (j > 0), back[j, rows, at], at)
    return out


class _Words(dict):
    """Word -> number, whose emissions are filled in for all new words at once."""

    def __init__(self, field: Field):
        self.field, self.new, self.characters = field, [], 0
        self.table = np.zeros((0, 3, LABELS), np.float32)

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        self.new.append(word)
        self.characters += len(word)
        return at

    def emissions(self) -> np.ndarray:
        """Rows in the order of the numbers; the last two serve a missing neighbour."""
        if self.new:
            known: dict[tuple[str, ...], np.ndarray] = {}
            rows = []
            for w in self.new:
                if (e := known.get(f := tuple(word_features(w)))) is None:
                    at = [self.field.features[x] for x in f if x in self.field.features]
                    e = known[f] = self.field.weights[:, at].sum(axis=1).astype(np.float32)
                rows.append(e)
            self.table = np.concatenate([self.table, np.stack(rows)])
            self.new = []
        return self.table


class Finder:
    """Decodes whole texts in batches of lines."""

    def __init__(self, field: Field):
        self.field, self.words = field, _Words(field)

    def labels(self, texts: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray]]:
        """Words, their starts in code points, and their labels, for each text."""
        if len(self.words) > _MEMO or self.words.characters > _MEMO_CHARACTERS:
            self.words = _Words(self.field)
        split, ids, line_of, line = [], [], [], 0
        for text in texts:
            pieces = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
            starts = np.cumsum([0, *(len(p) + 1 for p in pieces[:-1])])
            number = np.fromiter(map(self.words.__getitem__, pieces), np.int64, len(pieces))
            full = np.fromiter(map(bool, pieces), bool, len(pieces))
            breaks = np.fromiter((m.start() for m in re.finditer("\n", text)), np.int64)
            lines = line + np.searchsorted(breaks, starts, side="left")
            line = int(lines[-1]) + 1
            split.append((pieces, starts, full))
            ids.append(number[full])
            line_of.append(lines[full])
        if not split:
            return
        flat, lines = np.concatenate(ids), np.concatenate(line_of)
        out = self._decode(flat, lines)
        at = 0
        for pieces, starts, full in split:
            n = int(full.sum())
            yield pieces, starts, full, out[at : at + n]
            at += n

    def _decode(self, flat: np.ndarray, lines: np.ndarray) -> np.ndarray:
        if not len(flat):
            return np.zeros(0, np.int8)
        table = self.words.emissions()
        e = table[flat, 0]
        same = lines[1:] == lines[:-1]
        e[1:] += np.where(same[:, None], table[flat[:-1], 1], 0)
        e[:-1] += np.where(same[:, None], table[flat[1:], 2], 0)
        first = np.flatnonzero(np.concatenate([[True], ~same]))
        length = np.diff(np.concatenate([first, [len(flat)]]))
        # windows: start, length, and the part of it whose labels count
        begin, size, lo, hi = [first], [np.minimum(length, WINDOW)], [np.zeros(len(first), int)], [np.where(length > WINDOW, WINDOW - OVERLAP // 2, length)]
        for s, n in zip(first[length > WINDOW], length[length > WINDOW], strict=True):
            k = np.arange(WINDOW - OVERLAP, n, WINDOW - OVERLAP)
            k = k[k + OVERLAP // 2 < n]
            begin.append(s + k)
            size.append(np.minimum(WINDOW, n - k))
            lo.append(np.full(len(k), OVERLAP // 2))
            hi.append(np.where(k + WINDOW >= n, n - k, WINDOW - OVERLAP // 2))
        begin, size, lo, hi = map(np.concatenate, (begin, size, lo, hi))
        out = np.zeros(len(flat), np.int8)
        order = np.argsort(-size, kind="stable")
        for a in range(0, len(order), 1024):
            part = order[a : a + 1024]
            t = int(size[part[0]])
            grid = np.minimum(begin[part, None] + np.arange(t), len(flat) - 1)
            best = viterbi(e[grid], size[part], self.field.moves)
            counts = (np.arange(t) >= lo[part, None]) & (np.arange(t) < hi[part, None])
            out[grid[counts]] = best[counts]
        return out

    def spans(self, texts: list[str]) -> Iterator[list[Span]]:
        """All spans of each text: the base ones, and the field's that neither overlap them nor look wrong."""
        for _, every in self.both(texts):
            yield every

    def both(self, texts: list[str]) -> Iterator[tuple[list[Span], list[Span]]]:
        """The base spans of each text, and all its spans."""
        for text, (pieces, starts, full, labels) in zip(texts, self.labels(texts), strict=True):
            base = found = base_spans(text)
            marked = np.flatnonzero(labels)
            if len(marked):
                where = np.flatnonzero(full)[marked]
                runs: list[list[int]] = []
                for i, w, label in zip(marked.tolist(), where.tolist(), labels[marked].tolist(), strict=True):
                    a, b, kind = int(starts[w]), int(starts[w]) + len(pieces[w]), (label - 1) // 2
                    if label % 2 == 0 and runs and runs[-1][1] == kind and runs[-1][3] == i - 1:
                        runs[-1][2:] = [b, i]
                    else:
                        runs.append([a, kind, b, i])
                own = [s for a, kind, b, _ in runs if (s := _trimmed(text, a, kind, b))]
                found = sorted(base + _apart(own, base))
            yield base, found


def _apart(own: list[Span], base: list[Span]) -> list[Span]:
    """Those of ``own`` that share no character with any of ``base``; both are sorted by start."""
    out, k, reach = [], 0, 0
    for s in own:
        while k < len(base) and base[k][0] < s[2]:
            reach, k = max(reach, base[k][2]), k + 1
        if reach <= s[0]:
            out.append(s)
    return out


def _trimmed(text: str, a: int, kind: int, b: int) -> Span | None:
    """The span without punctuation around it; None where its characters can't be of its kind."""
    keep = "+(" if kind == 3 else ""
    while a < b and text[a] in _TRIM and text[a] not in keep:
        a += 1
    while b > a and text[b - 1] in _TRIM:
        b -= 1
    word = text[a:b]
    digits = sum(c in "0123456789" for c in word)
    fits = (
        "@" in word[1:-1],
        digits >= 4 and word.count(".") == 3,
        12 <= digits <= 19 and not any(c.isalpha() for c in word),
        7 <= digits <= 15 and not any(c.isalpha() for c in word),
        len(word) >= 16 and digits >= 3 and digits < len(word) and word.isalnum(),
    )[kind]
    return (a, kind, b) if fits else None


def _finder(model) -> Finder:
    key, field = model.value
    finders = kept("pii")
    if key not in finders:
        finders.clear()
        finders[key] = Finder(field)
    return finders[key]


def _model(spark, table: list[list[tuple[str, int]]] | None):
    bound_batches(spark, 500)
    table = labelled_table() if table is None else table
    field = fit_in_task(spark.range(1), lambda _: train(table))
    return spark.sparkContext.broadcast((hashlib.sha256(repr(table).encode()).hexdigest(), field))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _find(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    finder = _finder(model)
    for batch in batches:
        texts = list(texts_of(batch.column("text")))
        base, every = zip(*finder.both(texts), strict=True) if texts else ((), ())
        counts = [pa.array([sum(k == kind for _, k, _ in b) for b in base], pa.int64()) for kind in range(len(BASE))]
        digest = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b in base])
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *counts, digest, pa.array(map(_joined, every), pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def find(docs: DataFrame, table: list[list[tuple[str, int]]] | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` of every row; nothing is shuffled."""
    model = _model(docs.sparkSession, table)
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(partial(_find, model=model), f"doc_id long, {counts}, base_sha256 string, spans string")


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the first one's kind."""
    out, at = [], 0
    for a, kind, b in spans:
        if a >= at:
            out += [text[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:]


def _redact(batches: Iterator[pa.RecordBatch], model, at: int, length: int) -> Iterator[pa.RecordBatch]:
    finder = _finder(model)
    for batch in batches:
        texts = list(texts_of(batch.column(at)))
        valid = batch.column(at).is_valid().to_pylist()
        clean = [redacted(t, s) if ok else None for t, s, ok in zip(texts, finder.spans(texts), valid, strict=True)]
        columns = list(batch.columns)
        columns[at] = pa.array(clean, batch.schema.field(at).type)
        if length >= 0:
            columns[length] = pa.array([len(t) if t is not None else None for t in clean], batch.schema.field(length).type)
        yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)


def redact(docs: DataFrame, table: list[list[tuple[str, int]]] | None = None) -> DataFrame:
    """``docs`` with personal data replaced by placeholders such as ``<EMAIL>``; all columns stay."""
    names = docs.columns
    length = names.index("n_chars") if "n_chars" in names and dict(docs.dtypes)["n_chars"] in ("int", "bigint") else -1
    return docs.mapInArrow(partial(_redact, model=_model(docs.sparkSession, table), at=names.index("text"), length=length), docs.schema)
