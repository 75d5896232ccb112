"""Language-model scores from a causal self-attention model on subword ids.

Subword ids come from a public vocabulary. The model, one attention layer in numpy, predicts the next id in
three steps: its group, the member of the group, and the id within the member. Groups hold ids that keep like
company; frequent ids are members of their own, the others share members, within which the counts decide.
Texts are cut into blocks of BLOCK ids; a window is a block and the one before it, masked so that each id
sees only earlier ones, and only the window's last block is scored: every id is scored once, with BLOCK to
2 * BLOCK - 1 ids of context where the text has them. Windows of many texts are multiplied together.

All counts (words, ids, company) and the weights come from all ids of all training documents. The weights are
fitted data-parallel: a start is fitted on one task's worth of texts, then every task goes on from it through
texts of its own, so that each id of each text is learnt from, and the weights are averaged in the tasks.

The corpus itself is remembered too: each text is cut, where its words say so, into segments of about
SEGMENT_WORDS words, and pairs of neighbouring segments are counted over all training documents. A segment's
probability is the attention model's, mixed with the share of that segment among those that followed the one
before it in the corpus; a training document's own occurrences, however many, are taken away first. So a text that stands in
the corpus elsewhere is more probable than one that does not.

After the counting, one reading of the texts (:func:`_prepare`) stores all that their words give without the model:
ids, segments, counts. The fit and the scores read those, so that each text is cut into ids once.

A word-count score stands beside it. The HOT_WORDS most frequent words are broadcast, which bounds the
broadcast whatever the corpus; a text's other words are joined to their counts by a shuffle.

Cases: a null or empty text is the end token alone; a null id counts as empty text and is held out;
words unknown to training get the smoothed floor; with no training documents the counts are zero and
all ids of a member are alike; repeated rows count and are scored each by itself; an empty table gives no
rows. Other columns are not carried along.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import pairwise, repeat
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotline.llm.bpe import read_ranks
from plotline.llm.common import fit_in_task, kept, materialize, summed
from plotline.llm.units import bound_batches

END_WORD = b"\n"  # no word can be white space
SMOOTH = 0.1
HOT_WORDS = 200_000
SPAN_BYTES = 512
IDS_PER_TASK, LEAST_STEPS = 1 << 20, 400
BLOCK, WIDTH = 16, 16
GROUPS, MEMBERS, SHARED_MEMBERS, INPUT_IDS, COMPANY = 16, 24, 4, 2048, 128
SEGMENT_WORDS, MEMORY_SHARE = 32, 0.1
LIMIT = np.float32(40)  # of a logit
_MEMO, _MEMO_BYTES = 200_000, 6_000_000
_FLUSH = 400_000


def held_out(doc_id: str | Column = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 10 == 0


def words_of(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # on bytes: A-Z and ASCII white space only


def _bytes(column: pa.Array) -> list[bytes | None]:
    return column.to_pylist()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: Counter[bytes] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], ["word", "c"])
        seen.clear()
        return out

    for batch in batches:
        for text in _bytes(batch.column("text")):
            seen.update(words_of(text))
            seen[END_WORD] += 1
            if len(seen) > _FLUSH:
                yield flush()
    yield flush()


def count_words(docs: DataFrame) -> DataFrame:
    """``word binary, c long`` over all rows of ``docs``, summed in each task before the shuffle."""
    rows = docs.select(F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(_count, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c"))


def hot_words(counts: DataFrame, most: int | None = None) -> DataFrame:
    """The most frequent words, ``most`` at the most: whole bins of counts, a sixteenth of a doubling wide, from the top.

    Only the bins' sizes, a thousand rows at most, are looked at to find where to stop.
    """
    size = F.floor(16 * F.log2("c")).cast("int")
    bins = counts.where("c > 0").groupBy(size.alias("bin")).agg(F.count("*").alias("n")).collect()
    held, least = 0, 1 << 30
    for b in sorted(bins, reverse=True):
        held += b.n
        if held > (HOT_WORDS if most is None else most):
            break
        least = b.bin
    return counts.where((F.col("c") > 0) & (size >= least))


# --- subword ids -------------------------------------------------------------------------------


def _tokenizer(ranks: list[bytes], pattern: str):
    import tiktoken

    return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks={t: i for i, t in enumerate(ranks)}, special_tokens={})


class _Coder:
    """Ids of words as they stand after a space, many words by one call of the tokenizer."""

    def __init__(self, path: str, pattern: str):
        ranks = read_ranks(path)
        self.tokenizer, self.end_id = _tokenizer(ranks, pattern), len(ranks)
        self.leads = np.array([t.startswith(b" ") for t in ranks])

    def words(self, words: list[bytes]) -> list[bytes]:
        """Two-byte ids of each word."""
        out: list[bytes] = []
        for a in range(0, len(words), 4096):
            part = [w for w in words[a : a + 4096] if w != END_WORD]
            joined = b" ".join([b"", *part]).decode("utf-8", "replace")
            ids = np.array(self.tokenizer.encode_ordinary(joined), "<u2")
            cut = (np.flatnonzero(self.leads[ids]) * 2).tolist()
            if len(cut) == len(part):
                raw = ids.tobytes()
                found = iter([raw[x:y] for x, y in pairwise([*cut, len(raw)])])
            else:  # a word that holds white space of its own
                found = iter([np.array(self.tokenizer.encode_ordinary(" " + w.decode("utf-8", "replace")), "<u2").tobytes() for w in part])
            if len(part) == len(words[a : a + 4096]):
                out += found
            else:
                end = np.array([self.end_id], "<u2").tobytes()
                out += [end if w == END_WORD else next(found) for w in words[a : a + 4096]]
        return out


def _count_ids(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    coder = _Coder(path, pattern)
    total = np.zeros(coder.end_id + 1)
    for batch in batches:
        parts = coder.words(batch.column("word").to_pylist())
        flat = np.frombuffer(b"".join(parts), "<u2")
        times = np.repeat(batch.column("c").to_numpy(), [len(p) // 2 for p in parts])
        total += np.bincount(flat, times, len(total))
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["part"])


def _spans(batches: Iterator[pa.RecordBatch], path: str, pattern: str, share: float = 1.0) -> Iterator[pa.RecordBatch]:
    """Ids of each whole text; for a ``share`` below 1, of spans of it instead, that share of its bytes in the mean."""
    coder = _Coder(path, pattern)
    for batch in batches:
        words, sizes = [], []
        for x in batch.column("text"):
            text = x.as_buffer().to_pybytes() if x.is_valid else b""
            if share >= 1:
                own = [*words_of(text), END_WORD]
                words += own
                sizes.append(len(own))
                continue
            seed = xxhash.xxh64_intdigest(text)
            wanted = len(text) * share / SPAN_BYTES + (seed & 0xFFFFFF) / (1 << 24)
            for k in range(int(wanted)):
                lo = xxhash.xxh64_intdigest(text[:64], seed + k) % max(1, len(text) - SPAN_BYTES)
                own = text[lo : lo + SPAN_BYTES].lower().split()
                own = own[lo > 0 :] if lo + SPAN_BYTES >= len(text) else own[lo > 0 : -1]  # cut words go
                if lo + SPAN_BYTES >= len(text):
                    own.append(END_WORD)
                words += own
                sizes.append(len(own))
        ids, at, out = coder.words(words), 0, []
        for n in sizes:
            out.append(b"".join(ids[at : at + n]))
            at += n
        yield pa.RecordBatch.from_arrays([pa.array([x for x in out if x], pa.binary())], ["ids"])


def _company(batches: Iterator[pa.RecordBatch], rank: np.ndarray) -> Iterator[pa.RecordBatch]:
    """How often each frequent id stands after and before each of the most frequent ones, as one array."""
    kept("attention layer")  # the words of the stage before are dropped
    rank, wide = np.minimum(rank, INPUT_IDS), 2 * (COMPANY + 1)  # all ids that are not frequent count as one more, which is left out
    total = np.zeros((INPUT_IDS + 1) * wide)
    for batch in batches:
        flat, sizes = _joined(batch.column("ids"))
        r = rank[flat]
        near, inside = np.minimum(r, COMPANY), np.ones(max(0, len(r) - 1), bool)
        inside[np.cumsum(sizes[sizes > 0])[:-1] - 1] = False  # two texts' ids are no neighbours
        for a, b, shift in ((r[1:], near[:-1], 0), (r[:-1], near[1:], COMPANY + 1)):
            total += np.bincount((a * wide + b + shift)[inside], minlength=len(total))
    yield pa.RecordBatch.from_arrays([pa.array([total[: INPUT_IDS * wide].tobytes()], pa.binary())], ["part"])


def _joined(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts (two bytes each) behind each other, and how many each text has."""
    parts = ids.to_pylist()
    return np.frombuffer(b"".join(parts), "<u2"), np.array([len(x) // 2 for x in parts], np.int64)


# --- the model ---------------------------------------------------------------------------------


def _order(counts: np.ndarray) -> np.ndarray:
    """Ids by falling count."""
    return np.lexsort((np.arange(len(counts)), -counts))


def _clusters(company: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """``k`` clusters of ids that stand beside the same others."""
    v = np.sqrt(company)
    v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)
    centre = v[np.random.default_rng(seed).permutation(min(len(v), 40 * k))[:k]]
    for _ in range(rounds):
        which = (v @ centre.T).argmax(axis=1)
        for c in range(k):
            if (own := v[which == c]).size:
                centre[c] = own.sum(axis=0) / max(np.linalg.norm(own.sum(axis=0)), 1e-9)
    return which


def _log_sum(z: np.ndarray) -> np.ndarray:
    """Logarithm of the sum of exponentials of each row; ``z`` is written over.

    Logits are held within LIMIT (:func:`_held`), so that no sum overflows or vanishes; a product sums
    short rows faster than a reduction.
    """
    np.exp(z, out=z)
    return np.log(z @ np.ones(z.shape[1], np.float32))


def _held(z: np.ndarray) -> np.ndarray:
    return np.clip(z, -LIMIT, LIMIT, out=z)


class Model:
    """Tables by id (group, member, log-probability within the member, input row) and the layer's weights."""

    def __init__(self, counts: np.ndarray, company: np.ndarray | None = None, seed: int = 5):
        order = _order(counts)
        self.group_of = np.full(len(counts), GROUPS - 1, np.int64)  # the last group is that of rare ids
        if company is not None:
            self.group_of[order[:INPUT_IDS]] = _clusters(company, GROUPS - 1, seed)
        else:
            self.group_of[order[:INPUT_IDS]] = np.arange(len(order[:INPUT_IDS])) % (GROUPS - 1)
        smooth = counts + 0.05
        self.member_of = np.zeros(len(counts), np.int64)
        single = MEMBERS - SHARED_MEMBERS
        for g in range(GROUPS):
            own = order[self.group_of[order] == g]
            self.member_of[own[:single]] = np.arange(len(own[:single]))
            mass = np.cumsum(smooth[own[single:]])
            if len(mass):
                self.member_of[own[single:]] = single + np.minimum((mass / mass[-1] * SHARED_MEMBERS).astype(int), SHARED_MEMBERS - 1)
        self.place = place = self.group_of * MEMBERS + self.member_of
        of_place = np.bincount(place, smooth, GROUPS * MEMBERS)
        self.within = np.log(smooth / of_place[place])
        self.input_of = INPUT_IDS + self.group_of
        self.input_of[order[:INPUT_IDS]] = np.arange(len(order[:INPUT_IDS]))
        self.start = INPUT_IDS + GROUPS  # what stands before the first id
        rng, of_group = np.random.default_rng(seed), of_place.reshape(GROUPS, MEMBERS).sum(axis=1)
        normal = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
        log = lambda x: np.log(np.maximum(x, 1e-9)).astype(np.float32)
        self.p = {"e": normal(self.start + 1, WIDTH), "q": normal(WIDTH, WIDTH), "k": normal(WIDTH, WIDTH), "v": normal(WIDTH, WIDTH)}
        self.p |= {"o": normal(WIDTH, GROUPS), "b": log(of_group / of_group.sum()), "d": np.zeros(2 * BLOCK, np.float32)}
        self.p |= {"m": normal(GROUPS, WIDTH, MEMBERS), "c": log(of_place.reshape(GROUPS, MEMBERS) / np.maximum(of_group, 1e-9)[:, None])}
        self.distance = BLOCK + np.arange(BLOCK)[:, None] - np.arange(2 * BLOCK)[None, :]
        self.future = self.distance < 0

    def flat(self) -> np.ndarray:
        return np.concatenate([w.reshape(-1) for w in self.p.values()]).astype(np.float64)

    def load(self, flat: np.ndarray) -> None:
        at = 0
        for name, w in self.p.items():
            self.p[name] = flat[at : at + w.size].reshape(w.shape).astype(np.float32)
            at += w.size

    def blocks(self, ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of texts of ``sizes`` ids: the place of each id, inputs and targets by place (-1: none), and which
        blocks are their text's first. A block of nothing stands before all others."""
        counts = -(-sizes // BLOCK)
        first = 1 + np.cumsum(counts) - counts
        x = np.full((int(counts.sum()) + 1) * BLOCK, self.start, np.int64)
        y = np.full(len(x), -1, np.int64)
        at = np.repeat(first * BLOCK - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(ids))
        y[at] = ids
        inside = np.ones(len(ids), bool)
        inside[np.cumsum(sizes)[sizes > 0] - 1] = False  # the last id of a text is nobody's input
        x[at[inside] + 1] = self.input_of[ids[inside]]
        lone = np.zeros(int(counts.sum()) + 1, bool)
        lone[first[counts > 0]] = True
        return at, x, y, lone

    def bias(self) -> np.ndarray:
        return np.where(self.future, np.float32(-1e9), _held(self.p["d"].copy())[np.clip(self.distance, 0, 2 * BLOCK - 1)]).astype(np.float32)

    def output(self) -> tuple[np.ndarray, np.ndarray]:
        """Weights of groups and of their members, the biases being those of a column of ones."""
        return np.concatenate([self.p["o"], self.p["b"][None]]), np.concatenate([self.p["m"], self.p["c"][:, None]], axis=1)

    def log_p(self, ids: np.ndarray, sizes: np.ndarray, batch: int = 256) -> np.ndarray:
        """Natural log-probability of each id of texts that stand behind each other.

        The queries, keys and values of an input are looked up once; a window's are a view of its two
        blocks' rows. Arrays of a batch are written into again, and small enough for a core's cache.
        """
        p, ids = self.p, ids.astype(np.int64)
        at, x, y, lone = self.blocks(ids, sizes)
        e, w = p["e"], WIDTH
        rows = np.concatenate([e @ p["q"] / np.float32(math.sqrt(w)), e @ p["k"], e @ p["v"], np.ones((len(e), 1), np.float32), e], axis=1)
        bias, out = self.bias(), np.zeros(len(x))
        scores, mixed = np.empty((batch, BLOCK, 2 * BLOCK), np.float32), np.empty((batch, BLOCK, w + 1), np.float32)
        group, member = self.group_of.astype(np.uint8), self.member_of
        ob, mc = self.output()
        for a in range(1, len(lone), batch):
            b = min(len(lone), a + batch)
            n, lo, hi = b - a, a * BLOCK, b * BLOCK
            looked = rows.take(x[lo - BLOCK : hi], axis=0)
            step, item = looked.strides
            windows = np.lib.stride_tricks.as_strided(looked, (n, 2 * BLOCK, looked.shape[1]), (BLOCK * step, step, item))
            own = looked[BLOCK:].reshape(n, BLOCK, -1)
            s, mix = scores[:n], mixed[:n]
            np.matmul(own[:, :, :w], windows[:, :, w : 2 * w].transpose(0, 2, 1), out=s)
            _held(s)
            s += bias
            s[lone[a:b], :, :BLOCK] = -1e9
            np.exp(s, out=s)
            np.matmul(s, windows[:, :, 2 * w : 3 * w + 1], out=mix)
            h = mix[..., :w] / mix[..., w:]
            h += own[:, :, 3 * w + 1 :]
            target = y[lo:hi]
            g = np.where(target < 0, GROUPS, group[target]).astype(np.uint8)
            real = np.argsort(g, kind="stable")[: np.count_nonzero(target >= 0)]
            target, g = target.take(real), g.take(real)
            hr = np.ones((len(real), w + 1), np.float32)
            hr[:, :w] = h.reshape(-1, w).take(real, axis=0)
            z = _held(hr @ ob)
            found = z.reshape(-1).take(np.arange(0, z.size, GROUPS) + g).astype(float)
            found -= _log_sum(z)
            ends = np.cumsum([0, *np.bincount(g, minlength=GROUPS)]).tolist()
            z = np.empty((len(g), MEMBERS), np.float32)
            for k in range(GROUPS):
                if ends[k] < ends[k + 1]:
                    np.matmul(hr[ends[k] : ends[k + 1]], mc[k], out=z[ends[k] : ends[k + 1]])
            _held(z)
            found += z.reshape(-1).take(np.arange(0, z.size, MEMBERS) + member.take(target))
            found -= _log_sum(z)
            out[lo + real] = found + self.within.take(target)
        return out[at]

    def score(self, texts: list[np.ndarray]) -> np.ndarray:
        """log10 probability of each text's ids."""
        sizes = np.array([len(t) for t in texts], np.int64)
        log_p = self.log_p(np.concatenate([*texts, np.zeros(0, "<u2")]), sizes)
        return np.bincount(np.repeat(np.arange(len(texts)), sizes), log_p, len(texts)) / math.log(10)

    def fit(self, texts: list[np.ndarray], rate: float = 0.03, last: float = 0.1, batch: int = 64, least_steps: int = LEAST_STEPS, seed: int = 11) -> None:
        """Adam on the likelihood, over shuffled windows: once over all, or as often as ``least_steps`` take.

        The step size falls from ``rate`` to ``last`` of it.
        """
        sizes = np.array([len(t) for t in texts], np.int64)
        if not sizes.sum():
            return
        _, x, y, lone = self.blocks(np.concatenate(texts).astype(np.int64), sizes)
        x, y = x.reshape(-1, BLOCK), y.reshape(-1, BLOCK)
        p, rng, n = self.p, np.random.default_rng(seed), len(x) - 1
        m = {name: (np.zeros_like(w), np.zeros_like(w)) for name, w in p.items()}
        each = -(-n // batch)
        passes = max(1, -(-least_steps // each))
        near, step = np.clip(self.distance, 0, 2 * BLOCK - 1).reshape(-1), 0
        for _ in range(passes):
            order = 1 + rng.permutation(n)
            for a in range(0, n, batch):
                g = self._gradient(x, y, lone, order[a : a + batch], near)
                step += 1
                pace = rate * (1 - (1 - last) * step / (passes * each))
                for name, w in p.items():
                    m1, m2 = m[name]
                    m1 += 0.1 * (g[name] - m1)
                    m2 += 0.01 * (g[name] * g[name] - m2)
                    w -= pace * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.99**step)) + 1e-8)

    def _gradient(self, x: np.ndarray, y: np.ndarray, lone: np.ndarray, rows: np.ndarray, near: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean over the windows' ids.

        Keys and values are one product, a bias is the weight of a column of ones, and attention is divided by
        its sums only when summed up, so that few arrays of a window's size are gone over.
        """
        p, w, root, n = self.p, WIDTH, np.float32(math.sqrt(WIDTH)), len(rows)
        kv, (ob, mc) = np.concatenate([p["k"], p["v"]], axis=1), self.output()
        both = np.concatenate([x[rows - 1], x[rows]], axis=1).reshape(-1)
        target = y[rows].reshape(-1)
        eb = p["e"].take(both, axis=0)
        ex = np.ascontiguousarray(eb.reshape(n, 2 * BLOCK, w)[:, BLOCK:]).reshape(-1, w)
        q = (ex @ (p["q"] / root)).reshape(n, BLOCK, w)
        looked = (eb @ kv).reshape(n, 2 * BLOCK, 2 * w)
        k, v = looked[..., :w], looked[..., w:]
        s = _held(np.matmul(q, k.transpose(0, 2, 1)))
        s += self.bias()
        s[lone[rows], :, :BLOCK] = -1e9
        np.exp(s, out=s)
        over = (1 / (s @ np.ones(2 * BLOCK, np.float32))).reshape(-1, 1)
        mix = np.matmul(s, v).reshape(-1, w)
        mix *= over
        place = self.place.take(target)  # of an id; -1 takes some place and is left out
        real = np.argsort(np.where(target < 0, GROUPS, place // MEMBERS).astype(np.uint8), kind="stable")[: np.count_nonzero(target >= 0)]
        place = place.take(real)
        group, member = np.divmod(place, MEMBERS)
        share = np.float32(1 / max(1, len(real)))
        hr = np.ones((len(real), w + 1), np.float32)
        hr[:, :w] = (ex + mix).take(real, axis=0)

        def error(z: np.ndarray, hit: np.ndarray) -> np.ndarray:
            np.exp(_held(z), out=z)
            z *= (share / (z @ np.ones(z.shape[1], np.float32)))[:, None]
            z.reshape(-1)[np.arange(0, z.size, z.shape[1]) + hit] -= share
            return z

        dz = error(hr @ ob, group)
        go = hr.T @ dz
        g = {"o": go[:w], "b": go[w]}
        dr = dz @ p["o"].T
        ends = np.cumsum([0, *np.bincount(group, minlength=GROUPS)]).tolist()
        parts = [(j, slice(ends[j], ends[j + 1])) for j in range(GROUPS) if ends[j] < ends[j + 1]]
        dz = np.empty((len(real), MEMBERS), np.float32)
        for j, part in parts:
            np.matmul(hr[part], mc[j], out=dz[part])
        error(dz, member)
        gm = np.zeros_like(mc)
        for j, part in parts:
            np.matmul(hr[part].T, dz[part], out=gm[j])
            dr[part] += dz[part] @ p["m"][j].T
        g["m"], g["c"] = gm[:, :w], gm[:, w]
        dh = np.zeros_like(ex)
        dh[real] = dr
        dm = (dh * over).reshape(n, BLOCK, w)
        ds = np.matmul(dm, v.transpose(0, 2, 1))
        ds -= np.einsum("ij,ij->i", dm.reshape(-1, w), mix).reshape(n, BLOCK, 1)
        ds *= s
        g["d"] = np.bincount(near, ds.sum(axis=0).reshape(-1) * ~self.future.reshape(-1), 2 * BLOCK).astype(np.float32)
        dq = np.matmul(ds, k).reshape(-1, w)
        dq /= root
        dkv = np.empty_like(looked)
        np.matmul(ds.transpose(0, 2, 1), q, out=dkv[..., :w])
        np.matmul(s.transpose(0, 2, 1), dm, out=dkv[..., w:])
        dkv = dkv.reshape(-1, 2 * w)
        g["q"], gkv = ex.T @ dq, eb.T @ dkv
        g["k"], g["v"] = gkv[:, :w], gkv[:, w:]
        de = kv @ dkv.T
        dh += dq @ p["q"].T
        de.reshape(w, n, 2 * BLOCK)[:, :, BLOCK:] += dh.T.reshape(w, n, BLOCK)
        g["e"] = np.stack([np.bincount(both, one, len(p["e"])) for one in de], axis=1).astype(np.float32)
        return g


def _go_on(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """A task's own weights after its spans, times their number of ids, and that number."""
    kept("attention layer")
    texts = sorted(x for batch in batches for x in batch.column("ids").to_pylist())  # the same whatever their order
    texts = [np.frombuffer(x, "<u2") for x in texts]
    if n := sum(map(len, texts)):
        model = sent.value
        model.fit(texts, rate=0.015, batch=256, least_steps=LEAST_STEPS // 4)
        yield pa.RecordBatch.from_arrays([pa.array([np.append(model.flat() * n, n).tobytes()], pa.binary())], ["part"])


def _begin(spans: list[bytes], model: Model) -> Model:
    model.fit([np.frombuffer(x, "<u2") for x in sorted(spans)])
    return model


def fit(train: DataFrame, counts: np.ndarray, vocabulary: str, pattern: str, share: float = 1.0) -> Model:
    """The attention model for ``text`` (binary) of the training documents, given the counts of all their ids.

    All ids are learnt from unless the caller asks for a ``share`` of each text.
    """
    spans = materialize(train.select("text").mapInArrow(partial(_spans, path=vocabulary, pattern=pattern, share=share), "ids binary"))
    return fit_ids(spans, counts, share)


def fit_ids(spans: DataFrame, counts: np.ndarray, share: float = 1.0) -> Model:
    """The attention model for ``ids`` of stored texts, which are ``share`` of those counted."""
    spark = spans.sparkSession
    rank = np.empty(len(counts), np.int64)
    rank[_order(counts)] = np.arange(len(counts))
    company = summed(spans.mapInArrow(partial(_company, rank=rank), "part binary"))  # one array for each part of the stored ids
    model = Model(counts, None if company is None else company.reshape(INPUT_IDS, -1))
    tasks = _tasks(counts.sum() * share, 1)
    first = spans.where(F.pmod(F.xxhash64("ids"), F.lit(tasks)) == 0).distinct()  # one task's worth at most, from all over the corpus
    model = fit_in_task(first, partial(_begin, model=model))
    sent = spark.sparkContext.broadcast(model)
    total = summed(spans.repartition(tasks).mapInArrow(partial(_go_on, sent=sent), "part binary"))
    if total is not None:
        model.load(total[:-1] / total[-1])
    return model


def _tasks(ids: float, times: int) -> int:
    return max(1, math.ceil(ids / (times * IDS_PER_TASK)))


# --- scoring -----------------------------------------------------------------------------------

_BASE = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def segments(hashes: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Content-defined segments of words: the segment of each word, and, by segment, hashes of the segment
    before it in the text (0 at the start) and of the two together. ``last`` marks the last word of a text."""
    cut = last.copy()
    cut[1:] |= _mix(hashes[1:] + _BASE * hashes[:-1]) % np.uint64(SEGMENT_WORDS) == 0
    of_word = np.cumsum(cut) - cut
    ends = np.flatnonzero(cut)
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashes * _powers(_BASE, len(hashes)), dtype=np.uint64)])
    whole = _mix((sums[ends + 1] - sums[starts]) * _powers(_BACK, len(hashes))[starts])
    before = np.zeros(len(ends), np.uint64)
    before[1:] = np.where(last[ends[:-1]], np.uint64(0), whole[:-1] | np.uint64(1))
    return of_word, before, _mix(before * _BASE + whole)


def repeats(of_text: np.ndarray, key: np.ndarray) -> np.ndarray:
    """How often each row's key stands in its own text."""
    order = np.lexsort((key, of_text))
    text, sorted_ = of_text[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (text[1:] != text[:-1]) | (sorted_[1:] != sorted_[:-1])
    run = np.cumsum(new) - 1
    out = np.empty(len(order), np.int32)
    out[order] = np.bincount(run, minlength=0)[run]
    return out


class _Words(dict):
    """Word -> number, with the word's ids and hash and, for a hot word, its count score."""

    def __init__(self, coder: _Coder, hot: dict[bytes, float]):
        self.coder, self.hot = coder, hot
        self.names: list[bytes] = []
        self.ids: list[bytes] = []
        self.values, self.hashes, self.sizes = np.zeros(0), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.fresh: list[bytes] = []
        self.rare = self.rare_bytes = 0

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.fresh.append(word)
        return at

    def learn(self) -> None:
        if self.fresh:
            ids = self.coder.words(self.fresh)
            values = np.fromiter(map(self.hot.get, self.fresh, repeat(np.nan)), float, len(ids))
            self.rare += int(np.isnan(values).sum())
            self.rare_bytes += sum(map(len, self.fresh))
            self.names += self.fresh
            self.ids += ids
            self.values = np.concatenate([self.values, values])
            self.hashes = np.concatenate([self.hashes, np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, self.fresh)), "<u8")])
            self.sizes = np.concatenate([self.sizes, np.fromiter(map(len, ids), np.int64, len(ids)) // 2])
            self.fresh = []

    def forget(self) -> None:
        """Only the hot words are kept, whose number is bounded; the others come seldom."""
        if self.rare <= _MEMO // 2 and self.rare_bytes <= _MEMO_BYTES:
            return
        keep = np.flatnonzero(~np.isnan(self.values))
        self.names, self.ids = [self.names[k] for k in keep], [self.ids[k] for k in keep]
        self.values, self.hashes, self.sizes = self.values[keep], self.hashes[keep], self.sizes[keep]
        self.clear()
        self.update(zip(self.names, range(len(self.names))))
        self.rare = self.rare_bytes = 0


_PREPARED = "row long, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_score double, rare array<struct<word: binary, times: long>>, ids binary, segments array<struct<before: long, pair: long, n_ids: int, own_before: int, own_pair: int>>"


def _prepare(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """All that the words of a text give without the model: ids, segments, the count score of hot words and the other words."""
    key, hot, path, pattern = sent.value
    held = kept("language model")
    if key not in held:
        held.clear()
        held[key] = _Words(_Coder(path, pattern), hot)
    words = held[key]
    for batch in batches:
        words.forget()
        texts = _bytes(batch.column("text"))
        numbers = [np.fromiter(map(words.__getitem__, [*words_of(t), END_WORD]), np.int64) for t in texts]
        if not numbers:
            continue
        words.learn()
        flat, lengths = np.concatenate(numbers), np.array([len(n) for n in numbers])
        of_text = np.repeat(np.arange(len(numbers)), lengths)
        values, n_ids = words.values[flat], words.sizes[flat]
        cold = np.isnan(values)
        base = np.bincount(of_text, np.where(cold, 0, values), len(numbers))
        known = np.bincount(of_text, ~cold, len(numbers)).astype(np.int64)
        rare, times, ends = [], [], [0]
        for n, lo, hi in zip(numbers, np.cumsum(lengths) - lengths, np.cumsum(lengths), strict=True):
            w, often = np.unique(n[cold[lo:hi]], return_counts=True)
            rare += map(words.names.__getitem__, w.tolist())
            times.append(often)
            ends.append(len(rare))
        ids = list(map(words.ids.__getitem__, flat.tolist()))
        ids = [b"".join(ids[hi - n : hi]) for n, hi in zip(lengths.tolist(), np.cumsum(lengths).tolist(), strict=True)]
        last = np.zeros(len(flat), bool)
        last[np.cumsum(lengths) - 1] = True
        of_word, before, pair = segments(words.hashes[flat], last)
        first = np.cumsum([0, *np.diff([-1, *of_word[last]])]).astype(np.int32)
        pairs = pa.StructArray.from_arrays([pa.array(rare, pa.binary()), pa.array(np.concatenate(times), pa.int64())], ["word", "times"])
        text_of = np.repeat(np.arange(len(numbers)), np.diff(first))
        fields = [before.view(np.int64), pair.view(np.int64), np.bincount(of_word, n_ids, len(pair)).astype(np.int32), repeats(text_of, before), repeats(text_of, pair)]
        parts = pa.StructArray.from_arrays([pa.array(x) for x in fields], ["before", "pair", "n_ids", "own_before", "own_pair"])
        columns = [batch.column("row"), batch.column("doc_id"), batch.column("held_out"), pa.array(lengths, pa.int64()), pa.array(known, pa.int64()), pa.array(base, pa.float64())]
        columns += [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs), pa.array(ids, pa.binary()), pa.ListArray.from_arrays(pa.array(first, pa.int32()), parts)]
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "hot_known", "hot_score", "rare", "ids", "segments"])


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, hot_known long, hot_score double, attention_score double, segments array<struct<before: long, pair: long, log_p: float, own_before: int, own_pair: int>>"


def _score(batches: Iterator[pa.RecordBatch], sent) -> Iterator[pa.RecordBatch]:
    """The attention model's log10 probability of each stored text and of each of its segments."""
    kept("attention layer")
    model = sent.value
    for batch in batches:
        if not batch.num_rows:
            continue
        before, pair, n_ids, own_before, own_pair = batch.column("segments").flatten().flatten()
        first = np.asarray(batch.column("segments").offsets)
        first, n_ids = first - first[0], n_ids.to_numpy()
        log_p = model.log_p(*_joined(batch.column("ids"))) / math.log(10)
        of_segment = np.bincount(np.repeat(np.arange(len(n_ids)), n_ids), log_p, len(n_ids))
        scores = np.add.reduceat(of_segment, first[:-1])
        columns = [batch.column(x) for x in ("row", "doc_id", "held_out", "n_tokens", "hot_known", "hot_score")] + [pa.array(scores, pa.float64())]
        parts = pa.StructArray.from_arrays([before, pair, pa.array(of_segment.astype(np.float32)), own_before, own_pair], ["before", "pair", "log_p", "own_before", "own_pair"])
        columns.append(pa.ListArray.from_arrays(pa.array(first, pa.int32()), parts))
        yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "hot_known", "hot_score", "attention_score", "segments"])


def _remembered(scored: DataFrame) -> DataFrame:
    """``row, gain, seen``: what the corpus's pairs of segments add to a text's score, and how many it has there.

    A training text's own pairs are taken away first, by their number in that text, so that it is told nothing by
    itself. Only pairs that stand twice in the corpus are joined back to the segments. Beginnings of texts all follow
    the same nothing, so their total is one number and not a key.
    """
    each = scored.select("row", "held_out", F.inline("segments"))
    pairs = materialize(each.groupBy("before", "pair").agg(F.count_if(~F.col("held_out")).alias("c"), F.count("*").alias("n")).where("c > 0"))
    useful = materialize(pairs.where("n > 1"))
    inner = useful.where("before <> 0")
    totals = pairs.where("before <> 0").join(inner.select("before").distinct(), "before", "left_semi").groupBy("before").agg(F.sum("c").alias("total"))
    begun = pairs.where("before = 0").agg(F.coalesce(F.sum("c"), F.lit(0))).first()[0]
    known = inner.join(totals, "before").select("before", "pair", "c", "total")
    known = materialize(known.unionByName(useful.where("before = 0").select("before", "pair", "c", F.lit(begun).cast("long").alias("total"))))
    own = lambda c: F.when(F.col("held_out"), 0).otherwise(F.col(c))
    share = (F.col("c") - own("own_pair")) / (F.col("total") - own("own_before"))
    x = F.log10(F.lit(MEMORY_SHARE / (1 - MEMORY_SHARE)) * share) - F.col("log_p")
    gain = F.when(x > 15, x).otherwise(F.log10(1 + F.pow(F.lit(10.0), x)))
    return each.join(known, ["before", "pair"]).where(F.col("c") > own("own_pair")).groupBy("row").agg(F.sum(gain).alias("gain"), F.count("*").alias("seen"))


def score(docs: DataFrame, vocabulary: str, pattern: str, share: float = 1.0) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, attention_score, n_segments, n_segments_seen`` of every row."""
    spark = docs.sparkSession
    bound_batches(spark, 250)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), held_out("doc_id").alias("held_out"))
    train = docs.where("not held_out")
    counts = materialize(count_words(train))
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    floor = n + SMOOTH * (v + 1)
    by_id = summed(counts.mapInArrow(partial(_count_ids, path=vocabulary, pattern=pattern), "part binary"))
    if by_id is None:
        by_id = np.zeros(len(read_ranks(vocabulary)) + 1)  # the end is an id of its own
    top = hot_words(counts).toArrow()
    hot = dict(zip(top.column("word").to_pylist(), np.log10((top.column("c").to_numpy() + SMOOTH) / floor).tolist(), strict=True)) if n else {}
    sent = spark.sparkContext.broadcast((uuid4().hex, hot, vocabulary, pattern))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    prepared = materialize(rows.mapInArrow(partial(_prepare, sent=sent), _PREPARED))
    model = fit_ids(prepared.where("not held_out").select("ids"), by_id) if share >= 1 else fit(train, by_id, vocabulary, pattern, share)
    sent = spark.sparkContext.broadcast(model)
    scored = materialize(prepared.drop("rare").mapInArrow(partial(_score, sent=sent), _SCORED))
    log_p = F.log10((F.coalesce("c", F.lit(0)) + SMOOTH) / F.lit(floor))
    rare = (
        prepared.select("row", F.inline("rare"))
        .join(counts, "word", "left")
        .groupBy("row")
        .agg(F.sum(F.col("times") * log_p).alias("rare_score"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    )
    zero = F.lit(0)
    n_segments = F.size("segments").cast("long")
    return scored.select("*", n_segments.alias("n_segments")).drop("segments").join(rare, "row", "left").join(_remembered(scored), "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("hot_known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("hot_score") + F.coalesce("rare_score", F.lit(0.0))).alias("base_score"),
        (F.col("attention_score") + F.col("n_segments") * math.log10(1 - MEMORY_SHARE) + F.coalesce("gain", F.lit(0.0))).alias("score"),
        "attention_score",
        "n_segments",
        F.coalesce("seen", zero).cast("long").alias("n_segments_seen"),
    )
