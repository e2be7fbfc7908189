from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs.toPandas()]
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        out.append(docs.toPandas())
        docs = spark.createDataFrame(out[-1], docs.schema)
    return out


def test_stages_only_drop_or_redact(stages):
    given, clean, exact, near, redacted, packed = stages
    assert list(redacted.columns) == list(given.columns)
    for before, after in zip(stages[:4], stages[1:5], strict=True):
        assert set(after.doc_id) <= set(before.doc_id)
    assert len(set(exact.text)) == len(exact) and set(exact.text) == set(clean.text)
    assert exact.merge(clean.groupby("text").doc_id.max().reset_index(name="top"), on="text").eval("doc_id == top").all()
    assert len(redacted) == len(near) and len(near) > 0.9 * len(exact)
    assert not redacted.text.str.contains(r"[a-z]@[a-z0-9]+\.[a-z]", regex=True).any()
    assert (redacted.n_chars == redacted.text.str.len()).all()
    assert set(packed.doc_id) == set(redacted.doc_id)


def test_toxic_labels_go(stages):
    labels = duckdb.sql(f"SELECT * FROM '{SF}/labels.parquet'").df()
    gone = set(stages[0].doc_id) - set(stages[1].doc_id)
    clean = set(labels[labels.toxic == 0].doc_id)
    assert len(gone & clean) <= 0.05 * len(clean)


def test_run_gives_the_last_stage(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def test_all_ten_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names


def test_exact_dedup_matches_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()["op2_exact_dedup"]).fetchall()
    assert sorted(map(tuple, __spark_entry__.queries()["op2_exact_dedup"](spark, SF).collect())) == sorted(want)
