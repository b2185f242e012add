import base64
import hashlib
import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import jaccard, pii, toxicity, warc
from tessera.llm.queries import QUERIES, tokenizer_path
from tests.llm.conftest import documents
from tests.llm.test_joins import brute
from tests.llm.test_packing import check_packed

SF = "/root/testdata/sf0.001"


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload.encode()).digest()).decode()


def test_loser_tree():
    rng = random.Random(1)
    for k in (0, 1, 2, 3, 7, 8, 20):
        runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(30))) for _ in range(k)]
        assert list(warc.LoserTree([iter([(x, x) for x in r]) for r in runs])) == sorted(x for r in runs for x in r)


def test_records_in_any_stretches():
    rng = random.Random(2)
    bodies = ["", "a\r\n\r\nWARC/1.0\r\nb", "x" * 500, "\r\n\r\n\r\n"]
    data = b"".join(f"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: {len(b) + len(warc.HTTP_HEAD)}\r\n\r\n{warc.HTTP_HEAD}{b}\r\n\r\n".encode() for b in bodies)
    for _ in range(50):
        cuts = sorted(rng.randrange(len(data)) for _ in range(rng.randrange(12)))
        pieces = [data[a:b] for a, b in zip([0, *cuts], [*cuts, len(data)], strict=True)]
        assert [p.decode() for *_, p in warc.captures(iter(pieces))] == bodies
    assert len(list(warc.captures(iter([data[:-20]])))) == 3


def test_archive_and_history(spark):
    odd = "<p>x\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\ny</p>\r\n\r\n\r\n"
    rows = [(1, "http://b.org/x", "same"), (2, "http://a.b.org/", "same"), (9, "http://a.b.org/", "same"), (3, None, odd), (4, "HTTP://User@WWW.B.org:80/Q?x#f", None), (5, "u\r\nv", ""), (9, "http://a.b.org/", "same"), (None, "http://b.org/x", "other"), (6, "http://b.org/x", "é" * 300_000)]
    rows += [(100 + i, f"http://h{i % 7}.org/{i % 3}", f"page {i % 50}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("digest", "id", "time", "n", "sha1", "payload", "response")}).repartition(5)
    got = warc.archive_and_index(pages).collect()
    most = {}
    for i, _, h in rows:
        most[h or ""] = max(most.get(h or "", -1), -1 if i is None else i)
    count = Counter(h or "" for *_, h in rows)
    want = Counter((i, len((h or "").encode()), b32(h or ""), "revisit" if count[h or ""] > 1 and i != most[h or ""] else "response", most[h or ""] if count[h or ""] > 1 and i != most[h or ""] else None) for i, _, h in rows)
    assert Counter((r.id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    keys = [(r.url_key, r.time, r.id if r.id is not None else -1) for r in got]
    assert keys == sorted(keys)
    assert {r.url_key for r in got if r.id in (1, 2, 4)} == {"org,b)/x", "org,b,a)/", "org,b)/q?x"}
    assert warc.archive_and_index(pages.limit(0)).count() == 0


def test_merge_of_many_runs(spark, monkeypatch):
    monkeypatch.setattr(warc, "RANGE_ROWS", 100)
    found = spark.range(3000, numPartitions=8).select(
        F.concat(F.lit("f"), F.col("id") % 11).alias("file"), F.col("id").alias("offset"), F.lit(1).cast("long").alias("length"), F.lit("response").alias("record_type"), F.col("id"),
        F.when(F.col("id") % 3 == 0, "http://hot.org/").otherwise(F.concat(F.lit("http://h.org/"), F.col("id") % 40)).alias("url"), (F.col("id") % 5).cast("string").alias("time"),
        F.lit(0).cast("long").alias("payload_bytes"), F.lit("").alias("payload_digest"), F.lit(None).cast("long").alias("refers_to"),
    )
    history = warc.capture_history(found)
    rows = history.withColumn("range", F.spark_partition_id()).collect()
    keys = [(r.url_key, r.time, r.id) for r in rows]
    assert keys == sorted(keys) and len(set(keys)) == 3000
    assert max(Counter(r.range for r in rows).values()) < 600


# ------------------------------------------------------------------ pipeline


def test_stages_return_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]


def test_toxic_and_similar_documents_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = corpus_pipeline.reject_toxic(spark, docs, SF)
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {r.doc_id for r in toxicity.score(docs, model).filter("score >= 0.3").collect()}
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - bad
    linked = brute([(r.doc_id, r.text) for r in docs.collect()])
    stay = {r.doc_id for r in corpus_pipeline.keep_one_of_similar(spark, docs, SF).collect()}
    assert stay == {i for i, _, c in linked if i == c}


def test_redaction_takes_effect(spark):
    docs = documents(spark, [(1, "mail a@b.co and joe at mail dot com", "en", "s"), (2, None, "en", "s"), (3, "clean", "en", "s")], extra=False)
    out = {r.doc_id: r for r in corpus_pipeline.redact_personal_data(spark, docs, SF).collect()}
    assert out[1].text == "mail <EMAIL> and <EMAIL>" and out[1].n_chars == 24 and out[2].text is None and out[3].text == "clean"


def test_run_equals_the_stages(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
    from tessera.llm.packing import encoder

    check_packed(got, [(r.doc_id, r.text) for r in docs.collect()], encoder(tokenizer_path()))
    assert not any(pii.all_spans(r.text)[1] for r in docs.collect())


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_no_documents(spark, stage, odd_documents, no_documents):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    stage(spark, odd_documents.select(*columns), SF).collect()
    assert stage(spark, no_documents.select(*columns), SF).count() == 0
    if stage is not corpus_pipeline.pack_sequences:
        assert stage(spark, odd_documents, SF).columns == odd_documents.columns


def test_one_query_for_each_operator():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n.startswith("op")) == list(range(1, 11)) and "pipeline" in QUERIES
    assert jaccard.THRESHOLD == 75 and jaccard.WIDTH == 5


def test_run_keeps_one_stage_on_disk(spark, monkeypatch):
    gone, kept = [], []
    own = corpus_pipeline.materialize
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(str(i), lambda spark, docs, d: docs) for i in range(4)])
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df: kept.append(own(df)) or kept[-1])
    out = corpus_pipeline.run(spark, SF)
    for df in kept:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df._materialized)
        gone.append(not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path))
    assert gone == [True, True, False] and out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
