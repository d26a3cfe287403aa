"""The pipeline against a plain version of each stage, and its SQL checks on the smallest tables."""

import hashlib
import sys
from pathlib import Path

import duckdb
import pytest
import sentencepiece
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
sys.path.insert(0, str(Path(__file__).resolve().parent))

import corpus_pipeline
from check import TABLES, compare
from molq.llm import pieces, queries
from test_dedup import brute_groups, brute_removed, shingles

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables are absent")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.execute(queries.SQL[name]).fetchdf()
    if "refers_to" in got:  # an all-null column has another pandas type in either engine
        got["refers_to"], want["refers_to"] = got["refers_to"].astype("Int64"), want["refers_to"].astype("Int64")
    assert compare(got, want) == ""


def test_stages_match_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    rows = {r.doc_id: r.text for r in docs.collect()}
    after = corpus_pipeline.language(spark, docs, SF)
    assert after.columns == docs.columns and {r.doc_id for r in after.collect()} == set(rows)

    after = corpus_pipeline.near_dedup(spark, docs, SF)
    sets = {i: shingles(t) for i, t in rows.items()}
    pairs = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    kept = {i for i, low in brute_groups(pairs, sets).items() if i == low}
    assert {r.doc_id for r in after.collect()} == kept

    cut = corpus_pipeline.substring_dedup(spark, after, SF)
    want = brute_removed([(i, rows[i]) for i in kept])
    assert cut.columns == docs.columns
    assert {r.doc_id: (r.text, r.n_chars) for r in cut.collect()} == {i: (t, len(t)) for i, (_, _, t) in want.items()}

    left = {r.doc_id: r.text for r in corpus_pipeline.decontamination(spark, cut, SF).collect()}
    items = [" ".join(r.text.lower().replace(",", "").replace(".", "").split()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    plain = {i: " ".join(t.lower().replace(",", "").replace(".", "").split()) for i, (_, _, t) in want.items()}
    assert not any(item in plain[i] for i in left for item in items)
    assert all(any(item in plain[i] for item in items) for i in set(want) - set(left))

    tool = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    final = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: (r.n_pieces, r.piece_ids) for r in final} == {i: (len(x), x) for i, t in left.items() for x in [tool.encode(t)]}


def test_last_stage_decodes(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    tool = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    want = {r.doc_id: hashlib.sha256(tool.decode(tool.encode(r.text)).encode()).hexdigest() for r in docs.collect()}
    name, stage = corpus_pipeline.STAGES[-1]
    assert name == "SentencePiece encoding and decoding"
    assert {r.doc_id: r.decoded_sha256 for r in stage(spark, docs, SF).collect()} == want


def test_stages_on_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES[1:]:
        assert stage(spark, docs, SF).collect() == []


def test_nothing_to_learn_from(spark, tmp_path):
    docs, labels, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    for name, rows in (("empty", docs.limit(0)), ("unlabelled", unlabelled)):
        rows.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        labels.limit(0).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        items.write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
    assert corpus_pipeline.run(spark, f"{tmp_path}/empty").collect() == []
    assert corpus_pipeline.language(spark, unlabelled, SF).collect() == []
    for name in ("op7_quality", "op9_language_id"):
        assert queries.QUERIES[name](spark, f"{tmp_path}/empty").collect() == []
    got = queries.QUERIES["op9_language_id"](spark, f"{tmp_path}/unlabelled").collect()
    assert len(got) == docs.count() and {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}
    assert {r.score for r in queries.QUERIES["op7_quality"](spark, f"{tmp_path}/unlabelled").collect()} == {0.5}


def test_stored_tables_of_a_step_are_freed(spark):
    import os

    from molq.llm.common import freed_afterwards, stored

    with freed_afterwards(spark) as kept:
        inner = stored(spark.range(5), "inner")
        out = kept(inner.where("id > 1"), "out")
        held = [f.removeprefix("file://") for f in inner.inputFiles()]
        assert all(map(os.path.exists, held))
    assert not any(map(os.path.exists, held)) and out.count() == 3
