"""The pipeline's stages on the smallest tables, and the entry's SQL twins."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from fleetline.llm import near_dup, plans
from tests.conftest import SF_SMALL


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    assert {n.split("_")[0] for n in plans.PLANS} == {f"op{i}" for i in range(1, 14)}
    assert "pipeline" in entry.queries()


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF_SMALL)
        if name != "packing":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept[name] = {r[0] for r in docs.select("doc_id").distinct().collect()}
    assert kept["near_duplicates"] <= kept["toxicity"] and kept["decontamination"] <= kept["near_duplicates"]
    assert kept["personal_data"] == kept["decontamination"] == kept["packing"]
    # near-duplicates that stay are no near-duplicates of one another
    left = spark.read.parquet(str(tmp_path / "near_duplicates"))
    assert near_dup.near_duplicates(left).where("class_id <> doc_id").count() == 0
    clean = spark.read.parquet(str(tmp_path / "personal_data"))
    assert clean.where(r"text rlike '[A-Za-z0-9]@[a-z0-9]+[.]'").count() == 0


def test_run_packs_what_the_stages_keep(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.where("length > 1024 or offset + length > 1024").count() == 0
    assert out.count() > 0


def test_pipeline_on_odd_rows(spark, tmp_path):
    folder = str(tmp_path)
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, text, None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (None, "no id", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    assert sorted((r["doc_id"] or 0) for r in docs.collect()) == [0, 1, 3, 4]


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_sql_twin(spark, name):
    got = plans.PLANS[name](spark, SF_SMALL).toPandas()
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        path = f"{SF_SMALL}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*' if os.path.isdir(path) else ''}')")
    want = con.execute(plans.ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    norm = lambda d: d[cols].astype(str).sort_values(cols).values.tolist()
    assert norm(got) == norm(want)
