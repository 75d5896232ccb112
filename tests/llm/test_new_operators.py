"""Conversation trie, filter audit and substring dedup against brute force on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from plotline.llm import conversation_trie, filter_audit, substring_dedup
from plotline.llm.sorted_runs import with_earlier

from .conftest import ROWS, sentences

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


# --- sorted runs -------------------------------------------------------------------------------


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_earlier_over_boundaries(spark, partitions):
    rng = random.Random(partitions)
    rows = [(rng.choice([7, 7, 7, 7, rng.randrange(30)]), rng.choice("xyz"), None if rng.random() < 0.05 else rng.randrange(-50, 400)) for _ in range(2000)]
    df = spark.createDataFrame(rows, "k long, t string, own long").repartition(5).withColumn("t", F.col("t").cast("binary"))
    for text in (None, "t"):
        least = {}
        for k, t, own in rows:
            if own is not None:
                key = (k, t if text else None)
                least[key] = min(own, least.get(key, own))
        want = Counter((k, own, own is not None and own > least[k, t if text else None]) for k, t, own in rows)
        got = with_earlier(df.withColumn("k2", F.col("k")), ["k"], text, carried=["k2"], partitions=partitions).collect()
        assert Counter((r.k2, r.own, r.earlier) for r in got) == want


# --- filter audit ------------------------------------------------------------------------------


def _audit(rows, labels):
    least = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    good, toxic = ({x[0] for x in labels if x[k] == 1 and x[0] is not None} for k in (1, 2))
    want = defaultdict(lambda: [0] * 7)
    for doc_id, text, _, source, *_ in rows:
        text, part = text or "", source or ""
        w = WORDS.findall(text)
        failed = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)), "E": doc_id is not None and least[text] < doc_id,
        }
        for order in map("".join, permutations("ABCDE")):
            gone = False
            for step, letter in enumerate(order, 1):
                out, fails = want[part, order, step], failed[letter]
                removed = fails and not gone
                out[0] += not gone and not fails
                out[1] += removed
                out[2] += fails and gone
                out[3] += fails and sum(failed.values()) == 1
                out[4] += removed and doc_id in good
                out[5] += removed and doc_id in toxic
                gone |= fails
    shapley = Counter()
    for (part, order, step), out in want.items():
        shapley[part, order[step - 1]] += out[1]
    for (part, order, step), out in want.items():
        out[6] = shapley[part, order[step - 1]]
    return {k: tuple(v) for k, v in want.items()}


AUDIT_ROWS = [*ROWS, *((100 + i, ROWS[i % 4][1], "en", f"src{i % 2}", 1, 1, 1, 1, 1, 1, 1) for i in range(40)), (90, "A B C # " * 300, "en", None, 1, "", 1, 1, "", 1, ""), (91, sentences(5, 260), "en", "", 1, "", 1, 1, "", 1, "")]
LABELS = [(1, 1, 0), (1, 0, 0), (100, 1, 1), (103, None, 1), (None, 1, 1), (12, 0, 1), (9999, 1, 1)]


@pytest.fixture(scope="module")
def audit_docs(spark):
    rows = [(a, b, c, d, e, "x", 1, 2, "y", 3, "z") for a, b, c, d, e, *_ in AUDIT_ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, part string, mask long, fp long, own string, run long, earlier string").repartition(4)


def test_filter_audit(spark, audit_docs, no_docs):
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    got = filter_audit.audit(audit_docs, labels).collect()
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    found = {(r.part, r.filter_order, r.step): tuple(r[n] for n in names) for r in got}
    assert len(found) == len(got) and found == _audit(AUDIT_ROWS, LABELS)
    assert filter_audit.audit(no_docs, labels).count() == 0
    assert filter_audit.audit(audit_docs, labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("partitions", [2, 60])
def test_copies_under_one_fingerprint(audit_docs, partitions):
    """All texts share a fingerprint, and runs of copies cross many boundaries."""
    least = {}
    for doc_id, text, *_ in AUDIT_ROWS:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    want = Counter((r[0], r[0] is not None and least[r[1] or ""] < r[0]) for r in AUDIT_ROWS)
    got = filter_audit.masks(audit_docs, F.lit(1).cast("long"), partitions).collect()
    assert Counter((r.own, bool(r["mask"] & filter_audit.COPY)) for r in got) == want


# --- substring dedup ---------------------------------------------------------------------------


def _dedup(rows, window):
    first = {}
    for doc_id, text in rows:
        w = WORDS.findall(text or "")
        for p in range(len(w) - window + 1):
            if doc_id is not None:
                key = tuple(w[p : p + window])
                first[key] = min(doc_id, first.get(key, doc_id))
    out = Counter()
    for doc_id, text in rows:
        w = WORDS.findall(text or "")
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if doc_id is not None and first[tuple(w[p : p + window])] < doc_id:
                gone[p : p + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[doc_id, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()] += 1
    return out


def _passages():
    rng = random.Random(4)
    shared = [[rng.choice(["ab", "cd", "é", "日本"]) + str(rng.randrange(40)) for _ in range(n)] for n in (49, 50, 51, 80, 120, 300)]
    rows = [(r[0], r[1]) for r in ROWS]
    for i in range(60):
        own = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
        parts = [own(rng.randrange(90))]
        for _ in range(rng.randrange(4)):
            x = rng.choice(shared)
            lo = rng.choice([0, 0, 0, rng.randrange(len(x))])
            parts += [x[lo : rng.choice([len(x), len(x), lo + 60])], own(rng.choice([0, 3, 70]))]
        rows.append((1000 - i if i % 9 else rng.choice([None, 500]), rng.choice([" ", "\n", " \t "]).join(sum(parts, []))))
    rows += [(2000 + i, rows[-1][1]) for i in range(4)] + [(3000, " ".join(["a"] * 200)), (2999, " ".join(["a"] * 90)), (3000, " ".join(["a"] * 200))]
    return rows


@pytest.mark.parametrize("window,partitions", [(50, None), (50, 50), (31, 3), (64, None)])
def test_substring_dedup(spark, window, partitions):
    rows = _passages()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, node long, whole string").repartition(4)
    got = substring_dedup.dedup(df, window, partitions).collect()
    assert Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == _dedup(rows, window)
    for r in got:
        assert r.kept is None or hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256


def test_substring_dedup_without_rows(no_docs):
    assert substring_dedup.dedup(no_docs).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.dedup(no_docs, 30)


def test_difference_cover():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(range(substring_dedup.PERIOD))


# --- conversation trie -------------------------------------------------------------------------


def _trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    turns = {c: [x[3:] for x in sorted(t)] for c, t in own.items()}
    members = defaultdict(list)
    for c, t in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (c % 20 if c >= 0 else -(-c % 20))
        whole = tuple(turns.get(base, [])[:h] + t[h:])
        for d in range(len(whole) + 1):
            members[whole[:d]].append((c, len(whole) == d))
    out = Counter()
    for node, found in members.items():
        under = [x for x in members if x[: len(node)] == node]
        children = [x for x in under if len(x) == len(node) + 1]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in members) for x in under)
        saved = sum((len(members[x]) - 1) * len(WORDS.findall(x[-1][1])) for x in under if x)
        ends = ",".join(str(c) for c, end in sorted(found) if end)
        parent = min(members[node[:-1]])[0] if node else None
        out[min(found)[0], len(node), parent, len(found), len(children), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()] += 1
    return out


def _conversations():
    rng = random.Random(6)
    rows = []
    for c in range(-25, 130):
        if c % 20 == 0 and c % 3:
            continue  # no conversation to take turns from
        trunk = 0 if c % 3 else rng.randrange(12)
        for t in range(trunk):
            rows.append((c, t, "user", f"hello there {t}"))
        for t in range(trunk, trunk + rng.randrange(1, 4)):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["one two", "three", "", None, "é\x0bè  x"])))
    rows += [(c, t, "user", "same again") for c in range(200, 230) for t in range(6)]
    rows += [(300, t, "user", f"word {t}") for t in range(200)] + [(1, 1, "user", "tie"), (1, 1, "a", "tie"), (1, 1, "a", "tie")]
    return rows + [(None, 0, "user", "no conversation"), (7, None, None, None)]


CONVERSATION = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("max_turns", [50_000, 40, 1])
def test_conversation_trie(spark, max_turns):
    rows = _conversations()
    df = spark.createDataFrame([(*r, 5, "x") for r in rows], CONVERSATION + ", depth int, path string").repartition(3)
    got = conversation_trie.build(df, max_turns)
    columns = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == _trie(rows)


def test_conversation_trie_of_nothing(spark):
    assert conversation_trie.build(spark.createDataFrame([], CONVERSATION)).count() == 0
    assert conversation_trie.build(spark.createDataFrame([(None, 1, "user", "x")], CONVERSATION)).count() == 0
    (root,) = conversation_trie.build(spark.createDataFrame([(1, 1, "user", "x")], CONVERSATION)).where("depth = 0").collect()
    assert root.parent_conv_id is None and root.n_convs == 1
