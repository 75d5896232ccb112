"""Quality classification by co-training a text-content view and a page-metadata view.

Content: which telling words a text has, hashed to a fixed number of buckets. Metadata: language, source,
length and layout (lines, shares of capitals, digits, symbols and distinct words). One classifier for
each view is fitted on labelled rows. Then, round after round, each view labels all unlabelled documents;
those it is confident of teach the other view, by a Newton step whose gradient and curvature are summed over
the whole table in its tasks, so that nothing of it is sampled or gathered. Both pseudo-labels have the same
say, and all of them together PSEUDO_WEIGHT of the say of the labelled rows. Each view is then calibrated on
labelled rows held out from fitting, and a logistic model of the two calibrated views scores every document.
The same is done for toxicity; documents of low quality and toxic ones are rejected.

Fitting reads at most MAX_LABELLED labelled rows, those whose ids have the least hashes; the bound is a
parameter. Everything else covers all rows and whole texts; scoring needs no shuffle.

Cases: null and empty texts have no words and are scored by their metadata; null language and source, or
tables without these columns, are levels of their own; labels of unknown ids and null labels are left out;
without labels of both kinds a target scores 0.5 throughout and rejects nothing; repeated rows are scored
each by itself, but a labelled id teaches by its smallest text alone; an empty table gives no rows; all
columns of the input are kept by the filter, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import fit_in_task, kept, materialize, summed
from plotline.llm.units import bound_batches

BUCKETS = 1 << 18
MAX_LABELLED = 20_000
PSEUDO_WEIGHT = 0.3
TELLING_WORDS = 200
ROUNDS = 3
CONFIDENT = 0.97
REJECT_TOXIC = 0.35
_STRIP = "\"'.,;:!?()[]{}<>|-*#%&$"
_MEMO = 200_000
TARGETS = ("quality", "toxic")


class _Buckets(dict):
    """Word -> bucket, remembered up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > _MEMO:
            self.clear()
        at = zlib.crc32(word.strip(_STRIP).lower().encode("utf-8", "replace")) % BUCKETS
        if len(word) < 60:
            self[word] = at
        return at


_CLASSES = np.zeros(256, np.intp)
_CLASSES[list(range(65, 91))], _CLASSES[list(range(48, 58))], _CLASSES[[10]] = 1, 2, 3
_CLASSES[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'\"-"]] = 4


def features(text: str, lang: str | None = None, source: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word buckets of a text, sorted; and layout and origin of its page, the latter as two
    hashed one-hot groups of 16 and 64 levels."""
    memo = kept("quality")
    buckets = memo.get("buckets") or memo.setdefault("buckets", _Buckets())
    words = text.split()
    often = Counter(words)
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    counts = np.bincount(_CLASSES[raw], minlength=5)
    n, w = max(1, len(raw)), max(1, len(words))
    longest = max(often.values(), default=0)
    out = np.zeros(_WIDTH, np.float32)
    out[:9] = (1, np.log1p(len(raw)) / 8, counts[1] / n * 4, counts[2] / n * 4, counts[3] / n * 20, counts[4] / n * 4, len(often) / w, min(2.0, n / w / 8), min(1.0, longest / w))
    out[9 + zlib.crc32(f"lang:{lang}".encode()) % 16] = 0.5
    out[25 + zlib.crc32(f"source:{source}".encode()) % 64] = 0.5
    return np.unique(np.fromiter(map(buckets.__getitem__, often), np.int32)), out


_WIDTH = 9 + 16 + 64


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Sparse:
    """Rows of distinct column numbers."""

    def __init__(self, rows: list[np.ndarray]):
        self.ends = np.cumsum([0, *map(len, rows)])
        self.columns = np.concatenate(rows) if rows else np.empty(0, np.int32)
        self.row = np.repeat(np.arange(len(rows)), np.diff(self.ends))

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.columns], len(self.ends) - 1)

    def dense(self, columns: np.ndarray) -> np.ndarray:
        """Presence of the given (sorted) columns, after a column of ones."""
        out = np.zeros((len(self.ends) - 1, len(columns) + 1))
        out[:, 0] = 1
        at = np.minimum(np.searchsorted(columns, self.columns), max(0, len(columns) - 1))
        if len(columns):
            hit = columns[at] == self.columns
            out[self.row[hit], at[hit] + 1] = 1
        return out


def telling(x: Sparse, y: np.ndarray, words: int = TELLING_WORDS) -> np.ndarray:
    """The buckets whose presence says most about ``y``, by the likelihood ratio of a two-by-two table."""
    n, n1 = len(y), y.sum()
    one = np.bincount(x.columns, y[x.row], BUCKETS)
    df = np.bincount(x.columns, minlength=BUCKETS).astype(float)

    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return seen * np.log(np.maximum(seen, 1e-12) / np.maximum(expected, 1e-12))

    g = part(one, df * n1 / n) + part(df - one, df * (n - n1) / n) + part(n1 - one, (n - df) * n1 / n) + part(n - n1 - df + one, (n - df) * (n - n1) / n)
    g[df < 3] = 0
    best = np.lexsort((np.arange(BUCKETS), -g))[:words]
    return np.sort(best[g[best] > 4])


def fit_dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Ridge logistic regression by Newton's method."""
    w = np.zeros(x.shape[1])
    weight = weight / weight.sum()
    for _ in range(25):
        p = _sigmoid(x @ w)
        g = x.T @ (weight * (p - y)) + ridge * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(h, g)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass
class View:
    """The fitted and calibrated pair of views of one target; ``known`` is False where labels lack a kind."""

    known: bool = False
    columns: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    words: np.ndarray = field(default_factory=lambda: np.zeros(1))  # bias, then a weight for each column
    page: np.ndarray = field(default_factory=lambda: np.zeros(_WIDTH))
    blend: np.ndarray = field(default_factory=lambda: np.zeros(3))
    calibrations: list[np.ndarray] = field(default_factory=lambda: [np.zeros(2)] * 2)

    def raw(self, buckets: Sparse, page: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        of_bucket = np.zeros(BUCKETS, np.float32)
        of_bucket[self.columns] = self.words[1:]
        return buckets.dot(of_bucket) + self.words[0], page @ self.page

    def score(self, buckets: Sparse, page: np.ndarray) -> np.ndarray:
        if not self.known:
            return np.full(len(page), 0.5)
        return _sigmoid(_pair(*(_calibrated(z, c) for z, c in zip(self.raw(buckets, page), self.calibrations, strict=True))) @ self.blend)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(a)), a, b], axis=1)


def _calibrated(z: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.clip(c[0] + c[1] * z, -8, 8)


def _balanced(y: np.ndarray) -> np.ndarray:
    return np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))


class Labelled:
    """Labelled rows of one target, four fifths to fit on and the rest to calibrate by."""

    def __init__(self, rows: list[np.ndarray], pages: np.ndarray, y: np.ndarray):
        held = np.arange(len(y)) % 5 == 0
        if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
            self.fit = self.held = np.arange(len(y))  # too few labels to hold any out
        else:
            self.fit, self.held = np.flatnonzero(~held), np.flatnonzero(held)
        self.known = len(set(y.tolist())) == 2
        self.y, self.pages = y, pages
        self.x, self.held_x = Sparse([rows[i] for i in self.fit]), Sparse([rows[i] for i in self.held])

    def calibrate(self, view: View) -> View:
        y, raw = self.y[self.held], view.raw(self.held_x, self.pages[self.held])
        view.calibrations = [fit_dense(np.stack([np.ones(len(z)), z], axis=1), y, np.ones(len(y)), 1e-4) for z in raw]
        view.blend = fit_dense(_pair(*(_calibrated(z, c) for z, c in zip(raw, view.calibrations, strict=True))), y, np.ones(len(y)), 1e-4)
        return view


def begin(data: Labelled) -> View:
    """Both views, fitted on labelled rows alone."""
    if not data.known:
        return View()
    y, view = data.y[data.fit], View(known=True, columns=telling(data.x, data.y[data.fit]))
    view.words = fit_dense(data.x.dense(view.columns), y, _balanced(y), RIDGE[0])
    view.page = fit_dense(data.pages[data.fit], y, _balanced(y), RIDGE[1])
    return data.calibrate(view)


RIDGE = (3e-4, 1e-3)  # of the content and of the metadata view


def _curve(x: np.ndarray, y: np.ndarray, weight: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and curvature of the weighted likelihood at ``w``."""
    p = _sigmoid(x @ w)
    return x.T @ (weight * (p - y)), (x * (weight * p * (1 - p))[:, None]).T @ x


def statistics(view: View, buckets: Sparse, page: np.ndarray, confident: float = CONFIDENT) -> list[np.ndarray]:
    """What unlabelled rows teach: for each view and each pseudo-label that the other view gives, the number
    of rows, and the gradient and curvature at the view's weights."""
    sure = [_sigmoid(_calibrated(z, c)) for z, c in zip(view.raw(buckets, page), view.calibrations, strict=True)]
    out = []
    for x, w, p in ((buckets.dense(view.columns), view.words, sure[1]), (page, view.page, sure[0])):
        for kind, rows in enumerate((p <= 1 - confident, p >= confident)):
            g, h = _curve(x[rows], np.full(rows.sum(), float(kind)), np.ones(rows.sum()), w)
            out += [np.array([rows.sum()]), g, h.reshape(-1)]
    return out


def step(view: View, data: Labelled, taught: np.ndarray) -> View:
    """One round: a Newton step of each view on labelled rows and on what the other view teaches it."""
    y, at, new = data.y[data.fit], 0, []
    for x, w, ridge in ((data.x.dense(view.columns), view.words, RIDGE[0]), (data.pages[data.fit], view.page, RIDGE[1])):
        g, h = _curve(x, y, _balanced(y) / len(y), w)
        for _ in range(2):
            n, size = taught[at], len(w)
            weight = PSEUDO_WEIGHT / 2 / max(n, 1.0)
            g += weight * taught[at + 1 : at + 1 + size]
            h += weight * taught[at + 1 + size : at + 1 + size + size * size].reshape(size, size)
            at += 1 + size + size * size
        move = np.linalg.solve(h + ridge * np.eye(len(w)), g + ridge * w)
        new.append(w - move / max(1.0, np.abs(move).max() / 2))  # no weight moves by more than 2
    view.words, view.page = new
    return data.calibrate(view)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labels (-1 for none), page and words of each row, as bytes."""
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in ("quality", "toxic", "text", "lang", "source")), strict=True)
        out = []
        for q, t, x, a, b in rows:
            words, page = features(x or "", a, b)
            out.append(np.array([-1 if v is None else v for v in (q, t)], "<i4").tobytes() + page.tobytes() + words.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["row"])


def _labelled(rows: list[bytes]) -> dict[str, Labelled]:
    rows = sorted(rows)  # the same split whatever the order of rows
    labels = np.array([np.frombuffer(r, "<i4", 2) for r in rows]).reshape(-1, 2)
    pages = np.array([np.frombuffer(r, "<f4", _WIDTH, 8) for r in rows], np.float64).reshape(-1, _WIDTH)
    words = [np.frombuffer(r, "<i4", -1, 8 + 4 * _WIDTH) for r in rows]
    out = {}
    for k, target in enumerate(TARGETS):
        has = np.flatnonzero(labels[:, k] >= 0)
        out[target] = Labelled([words[i] for i in has], pages[has], labels[has, k].astype(float))
    return out


def _begin(rows: list[bytes]) -> dict[str, View]:
    return {t: begin(data) for t, data in _labelled(rows).items()}


def _step(rows: list[bytes], views: dict[str, View], taught: np.ndarray) -> dict[str, View]:
    at = 0
    for t, data in _labelled(rows).items():
        if views[t].known:
            size = sum(2 * (1 + len(w) + len(w) ** 2) for w in (views[t].words, views[t].page))
            views[t] = step(views[t], data, taught[at : at + size])
            at += size
    return views


def _read(batch: pa.RecordBatch, at: list[int]) -> tuple[Sparse, np.ndarray]:
    texts = [t or "" for t in batch.column(at[0]).to_pylist()]
    origin = [batch.column(i).to_pylist() if i >= 0 else [None] * len(texts) for i in at[1:3]]
    found = [features(*x) for x in zip(texts, *origin, strict=True)]
    return Sparse([words for words, _ in found]), np.array([page for _, page in found], np.float64).reshape(-1, _WIDTH)


def _teach(batches: Iterator[pa.RecordBatch], views) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            buckets, page = _read(batch, [0, 1, 2])
            part = np.concatenate([np.concatenate(statistics(v, buckets, page)) for v in views.value.values() if v.known])
            total = part if total is None else np.add(total, part, out=total)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


def _parts(docs: DataFrame) -> DataFrame:
    """``doc_id, text, lang, source``, null where there is no such column."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *((F.col(c) if c in docs.columns else F.lit(None)).cast("string").alias(c) for c in ("lang", "source")))


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, rounds: int = ROUNDS) -> dict[str, View]:
    """One co-trained view pair for each target: labelled rows first, then ``rounds`` - 1 passes over all others."""
    spark = docs.sparkSession
    bound_batches(spark)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *(F.col(t).cast("int") for t in TARGETS)).where("doc_id is not null").groupBy("doc_id").agg(*(F.max(t).alias(t) for t in TARGETS))
    chosen = F.broadcast(materialize(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)))
    rows = _parts(docs)
    # one text for each id, so that an id with a third of all rows keeps the sample to its bound
    one = rows.join(chosen, "doc_id").groupBy("doc_id", *TARGETS).agg(F.min(F.struct("text", "lang", "source")).alias("first"))
    packed = materialize(one.select(*TARGETS, "first.*").mapInArrow(_packed, "row binary"))
    views = fit_in_task(packed, _begin)
    others = rows.join(chosen.select("doc_id"), "doc_id", "left_anti").select("text", "lang", "source")
    for _ in range(rounds - 1):
        sent = spark.sparkContext.broadcast(views)
        if any(v.known for v in views.values()) and (taught := summed(others.mapInArrow(partial(_teach, views=sent), "part binary"))) is not None:
            views = fit_in_task(packed, partial(_step, views=views, taught=taught))
    return views


def _score(batches: Iterator[pa.RecordBatch], views, at: list[int], keep_only: bool) -> Iterator[pa.RecordBatch]:
    models = views.value
    for batch in batches:
        buckets, pages = _read(batch, at)
        quality, toxic = (models[t].score(buckets, pages) for t in TARGETS)
        keep = ~(((quality < 0.5) & models["quality"].known) | ((toxic >= REJECT_TOXIC) & models["toxic"].known))
        if keep_only:
            yield batch.filter(pa.array(keep))
        else:
            yield pa.RecordBatch.from_arrays([batch.column(at[3]), *map(pa.array, (quality, toxic, quality * (1 - toxic), keep))], ["doc_id", "quality_score", "toxic_score", "score", "keep"])


def score(docs: DataFrame, views: dict[str, View]) -> DataFrame:
    """``doc_id, quality_score, toxic_score, score, keep`` of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(views)
    rows = _parts(docs).select("text", "lang", "source", "doc_id")
    return rows.mapInArrow(partial(_score, views=sent, at=[0, 1, 2, 3], keep_only=False), "doc_id long, quality_score double, toxic_score double, score double, keep boolean")


def keep_good(docs: DataFrame, views: dict[str, View]) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns."""
    sent, names = docs.sparkSession.sparkContext.broadcast(views), docs.columns
    at = [names.index(n) if n in names else -1 for n in ("text", "lang", "source", "doc_id")]
    return docs.mapInArrow(partial(_score, views=sent, at=at, keep_only=True), docs.schema)
