"""The pipeline's near-duplicate stage against all pairs."""

import random

import corpus_pipeline
from plotline.llm import near_copies, simhash

from .conftest import ROWS, sentences


def _set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def _groups(texts):
    sets, group = [_set(t) for t in texts], list(range(len(texts)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if len(a & b) >= 0.8 * len(a | b):
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    return group


def _edited(text, rng, edits):
    w = text.split()
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def test_stage_drops_near_copies_beyond_three_bits(spark, docs, no_docs):
    rng = random.Random(5)
    texts = []
    for k in range(25):
        base = sentences(1000 + k, rng.choice((60, 200, 500)))
        texts += [base, *(_edited(base, rng, max(1, round(len(base.split()) * x))) for x in (0.01, 0.02, 0.025, 0.08))]
    base = sentences(999, 300)  # one large group, whose ends are linked through others alone
    for _ in range(40):
        texts.append(base := _edited(base, rng, 2))
    group = _groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    want = {min(i for i, g in enumerate(group) if g == x) for x in set(group)}
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    assert {r.doc_id for r in stage(spark, df, "").collect()} == want
    assert simhash.drop_near_duplicates(df).count() > len(want)  # op10's link is narrower
    kept = stage(spark, docs, "")
    assert kept.columns == docs.columns and kept.count() == len(set(_groups([r[1] for r in ROWS])))
    assert stage(spark, no_docs, "").count() == 0


def test_bands_find_pairs_at_the_bound():
    rng = random.Random(9)
    for _ in range(300):
        shared = [rng.getrandbits(64) for _ in range(160)]
        a, b = ([*shared, *(rng.getrandbits(64) for _ in range(20))] for _ in "ab")
        a, b = (near_copies.np.unique(near_copies.np.array(x, near_copies.np.uint64)) for x in (a, b))
        assert near_copies.similarity(a, b) == 0.8 and set(near_copies.bands(a)) & set(near_copies.bands(b))
