"""The pipeline against its stages done plainly, stage by stage, on the smallest tables."""

import os

import pytest

from .conftest import COLUMNS, ROWS
from .test_near_copies import _groups

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def test_stages_decide_and_keep_columns(spark):
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    from plotline.llm import decontaminate
    from plotline.llm.common import materialize, table

    docs = table(spark, SF, "documents")
    columns, sizes = docs.columns, [docs.count()]
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, SF))
        assert docs.columns == columns, name
        sizes.append(docs.count())
        if "simhash" in name:
            rows = sorted((r.doc_id, r.text) for r in before.collect())
            group = _groups([t for _, t in rows])  # links at a 5-word Jaccard similarity of 0.8
            assert {r.doc_id for r in docs.select("doc_id").collect()} == {min(i for (i, _), g in zip(rows, group, strict=True) if g == x) for x in set(group)}
        if "decontamination" in name:
            items = [decontaminate.normalize(r.text) for r in table(spark, SF, "benchmark").collect()]
            assert not any(i in decontaminate.normalize(r.text) for r in docs.collect() for i in items)
            gone = before.join(docs, "doc_id", "left_anti").collect()
            assert gone and all(any(i in decontaminate.normalize(r.text) for i in items) for r in gone)
        if name == "pii":
            assert not docs.where("text rlike '[a-z0-9]@mail[0-9]'").count()
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == sizes[-1]


def _tables(spark, path, rows):
    docs = spark.createDataFrame(rows, COLUMNS).repartition(3)
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, "a passage that no document has")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, 1, 0), (8, 0, 1), (60, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return docs


def test_awkward_rows_run_through_all_stages(spark, tmp_path):
    docs = _tables(spark, f"file://{tmp_path}", ROWS)
    got = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert 0 < len(got) <= len(ROWS) and {r.doc_id for r in got} <= {r[0] for r in ROWS}
    assert all(r.n_tokens == len(r.ids) for r in got)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, f"file://{tmp_path}").columns == docs.columns


def test_empty_table_runs_through_all_stages(spark, tmp_path):
    _tables(spark, f"file://{tmp_path}", [])
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
