import hashlib
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
from pyspark.sql import functions as F
from rillflow.llm import toxicity
from rillflow.llm.queries import ORACLES, QUERIES
from rillflow.scratch import store
from tokenizers import Tokenizer

from tests.llm.helpers import awkward, awkward_rows, empty, words
from tests.llm.test_dedup import brute_components

SF_DIR = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    out = toxicity.score_documents(docs, labels).join(labels, "doc_id").filter("held_out").select("toxic", "score", "predicted").collect()
    caught = [r["predicted"] for r in out if r["toxic"] == 1]
    wrong = [r["predicted"] for r in out if r["toxic"] == 0]
    assert sum(caught) / len(caught) > 0.85 and sum(wrong) / len(wrong) < 0.03


def test_toxicity_of_awkward_tables(spark):
    labels = spark.createDataFrame([(1, 1), (3, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    for given in (labels, labels.filter("toxic = 1"), labels.limit(0)):
        out = toxicity.score_documents(awkward(spark), given).collect()
        assert len(out) == len(awkward_rows())
        assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in out)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in out)
    assert toxicity.score_documents(empty(spark), labels).count() == 0


def test_scores_ignore_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = ({r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, x).collect()} for x in (labels, flipped))
    assert one == two


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    library = Tokenizer.from_file(corpus_pipeline.BYTE_BPE())
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [tuple(r) for r in docs.collect()]
        stage(spark, docs, SF_DIR).write.parquet(str(tmp_path / str(k)))
        out = spark.read.parquet(str(tmp_path / str(k)))
        rows = [tuple(r) for r in out.collect()]
        if name != "bpe":
            assert out.columns == docs.columns and set(rows) <= set(before)
        if name == "quality_rules":
            verdicts = {r["doc_id"] for r in QUERIES["op4_quality_rules"](spark, SF_DIR).filter("kept").collect()}
            assert {r[0] for r in rows} == verdicts and len(rows) == len(verdicts)
        if name == "exact_dedup":
            best = {}
            for r in before:
                best[r[1]] = max(best.get(r[1], -1), r[0])
            assert sorted(r[0] for r in rows) == sorted(best.values())
        if name == "near_dedup":
            assert sorted(r[0] for r in rows) == [c[0] for c in sorted(brute_components([r[:2] for r in before])) if c[3]]
        if name == "mixing":
            assert abs(sum(len(words(r[1])) for r in rows) / sum(len(words(r[1])) for r in before) - 1) < 0.1
        if name == "bpe":
            want = sorted((r[0], len(library.encode(r[1], add_special_tokens=False).ids)) for r in before)
            assert sorted(r[:2] for r in rows) == want
        docs = out
    assert sorted(map(repr, corpus_pipeline.run(spark, SF_DIR).collect())) == sorted(map(repr, out.collect()))


def test_pipeline_stages_equal_sql_and_library(spark, tmp_path):
    """Verdicts, copies per document and both hashes, each over the stage's own input."""
    sf_dir = "/root/testdata/sf0.001"
    library = Tokenizer.from_file(corpus_pipeline.BYTE_BPE())
    sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
    docs, source = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{sf_dir}/documents.parquet"
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        stage(spark, docs, sf_dir).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        rows = docs.collect()
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{source}')")
        if name == "quality_rules":
            want = con.execute(f"SELECT doc_id FROM ({ORACLES['op4_quality_rules']}) WHERE kept").fetchall()
            assert 0 < len(rows) < len(before) and sorted(r["doc_id"] for r in rows) == sorted(r[0] for r in want)
        if name == "mixing":
            taken = con.execute(f"SELECT doc_id, taken // size FROM ({ORACLES['op2_mix_sources']}) WHERE taken > 0").fetchall()
            text = {r["doc_id"]: r for r in before}
            assert Counter(r["doc_id"] for r in rows) == Counter(dict(taken)) and all(r == text[r["doc_id"]] for r in rows)
        if name == "bpe":
            ids = {r["text"]: library.encode(r["text"], add_special_tokens=False).ids for r in before}
            want = [(r["doc_id"], len(i := ids[r["text"]]), sha(",".join(map(str, i))), sha(library.decode(i, skip_special_tokens=False))) for r in before]
            assert sorted(map(tuple, rows)) == sorted(want)
        source = str(tmp_path / str(k) / "*.parquet")


def test_pipeline_of_awkward_and_empty_tables(spark):
    for docs in (awkward(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = store(stage(spark, docs, SF_DIR), "test-stage")
        assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_repeated_ids_and_labels_bring_one_row_to_the_driver(spark):
    bad, good = [i for i in range(100) if zlib.crc32(str(i).encode()) % 3 != 1][:2]
    docs = spark.createDataFrame([(bad, f"text {i % 50}") for i in range(20_000)] + [(good, "other text"), (None, "t")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i in range(100) for t in (0, 0, int(i == bad))] + [(None, 1)], "doc_id long, toxic int")
    assert toxicity.training_rows(docs, labels) == (["text 0"], ["other text"])
