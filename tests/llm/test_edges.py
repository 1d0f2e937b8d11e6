"""Names that clash, empty tables, long texts, hot keys and paths beyond the bounds, and the pipeline stage by stage."""

import math
import re
import time

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from readlake.llm import chat_format, common, decontaminate, jaccard, license_scan, line_dedup, mixing, quality_classifier, quality_rules, queries, token_output

SF = "/root/testdata/sf0.001"
NAMES = ["_x", "_all", "_h", "_doc", "_starts", "_part", "_bits", "_lines", "_gone", "_size", "_key", "_spans", "_n_words", "_items", "_cls", "_n", "_d", "_best", "_keeps", "_docs", "_copy", "_whole", "_rest", "_taken", "_salt", "_k", "_other"]


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.read.parquet(f"{SF}/benchmark.parquet")


def test_clashing_names(spark, documents, benchmark):
    """Helper columns never take the place of a user's."""
    own = documents.select("doc_id", "text", "source", *[F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in NAMES])

    def same(out):
        assert out.columns[: len(own.columns)] == own.columns or out.columns == own.columns
        rows = out.select("doc_id", *NAMES).collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in NAMES)

    same(line_dedup.dedup_lines(own))
    same(mixing.mix(own))
    same(decontaminate.decontaminate(own, benchmark))
    same(decontaminate.decontaminate(own, benchmark, "spans", limit=2000))
    same(jaccard.keep_one(own))
    same(jaccard.keep_one(own, limit=1 << 20))


def test_empty_tables(spark, documents, benchmark):
    import corpus_pipeline

    none = documents.limit(0)
    labels = quality_classifier.labels_of(spark, SF)
    assert license_scan.scan(none).count() == 0 and quality_rules.judge(none).count() == 0
    assert quality_classifier.classify(none, labels).count() == 0 and quality_classifier.keep_good(none, labels).count() == 0
    assert decontaminate.report(none, benchmark, limit=100).count() == 0 and jaccard.keep_one(none).count() == 0
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, none, SF)
        assert out.count() == 0
    assert out.columns == ["slot", "sequence", "shard", "byte_offset", "n_tokens", "doc_ids", "sha256"]


def test_nulls_in_every_column(spark, documents):
    import corpus_pipeline

    rows = [(None,) * len(documents.columns)] * 2 + [tuple(r) for r in documents.limit(30).collect()]
    docs = spark.createDataFrame(rows, documents.schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    assert docs.count() > 0


def test_long_texts(spark):
    """Very long texts take time in proportion."""
    began = time.time()
    lines = "\n".join(f"line {i % 20000} of many" for i in range(60001))
    words = " ".join(f"w{i % 5000}" for i in range(120_000))
    d = spark.createDataFrame([(1, lines, "en", "s"), (2, lines, "en", "s"), (3, words, None, None)], "doc_id bigint, text string, lang string, source string")
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(d).collect()}
    assert got == {1: (60001, 40001), 2: (60001, 60001), 3: (1, 0)}
    n = {r.doc_id: (r.n_words, r.n_repeat_words) for r in quality_rules.judge(d).collect()}
    assert n == {1: (240004, 240004), 2: (240004, 240004), 3: (120_000, 120_000)}
    assert quality_classifier.classify(d, spark.createDataFrame([], "doc_id bigint, quality int")).count() == 3
    assert {r.n_words for r in license_scan.scan(d).collect()} == {240004, 120_000}
    talk = spark.createDataFrame([(1, i, "assistant" if i % 2 else "user", words if i < 2 else "### x") for i in range(400)], "conv_id bigint, turn bigint, role string, text string")
    r = chat_format.digest(chat_format.format_conversations(talk)).first()
    assert (r.n_turns, r.loss_chars) == (400, len(words) + 199 * 5)
    assert time.time() - began < 240


def test_shared_class_names(spark, documents):
    """Class names of six bits collide often; the groups are those of all pairs."""
    docs = [(r.doc_id, r.text) for r in documents.limit(120).collect()]
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in jaccard.cluster(df, bits=6).collect()) == sorted(jaccard.brute_force(docs, 4, 85))
    kept = sorted(r.doc_id for r in jaccard.keep_one(df, bits=6).collect())
    assert kept == sorted(r.doc_id for r in jaccard.keep_one(df, limit=1 << 20).collect())


def test_salted_join(spark):
    left = spark.range(3000).select(F.when(F.col("id") < 1000, 7).otherwise(F.col("id")).cast("bigint").alias("k"), "id").union(spark.createDataFrame([(None, 5000)], "k bigint, id bigint"))
    right = left.filter("k is not null and (k = 7 or k % 2 = 0)").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    got = common.salted_join(left, right, "k", "n", ["id"]).collect()
    assert len(got) == 3001 and all(r.v == (None if r.k is None or (r.k != 7 and r.k % 2) else 2 * r.k) for r in got)


def test_reduce_arrays(spark):
    def fill(own, batch):
        np.add.at(own, batch.column(0).to_numpy() % 64, np.uint32(1))

    assert common.reduce_arrays(spark.range(1000), fill, 64, "uint32", np.add).tolist() == [16 if i < 40 else 15 for i in range(64)]
    assert not common.reduce_arrays(spark.range(0), fill, 64, "uint32", np.add).any()


def test_mixing_sql_of_blank_source(spark):
    words = "w " * 100
    rows = [(1, words, "a"), (2, " \n", "b"), (4, words, "c"), (5, words, "d"), (6, words, None)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    con = duckdb.connect()
    con.register("documents", pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "source": [r[2] for r in rows]}))
    want = {r[0]: r[1:] for r in con.execute(f"select doc_id, size, source_size, target, taken from ({mixing.ORACLE})").fetchall()}
    got = {r.doc_id: (r["size"], r.source_size, r.target, r.taken) for r in mixing.allot(d).collect()}
    assert got == want and want[2] == (0, 0, 0.0, 0) and want[4][2] == 3 * want[1][2]


def test_classifier_is_what_its_equations_say(spark, documents):
    """Statistics by plain Python, and scores by one matrix in place of sums over partitions."""
    labels = quality_classifier.labels_of(spark, SF)
    rows = quality_classifier.features(documents.select("doc_id", "text")).collect()
    text = {r.doc_id: r.text for r in documents.collect()}
    for r in rows[:60]:
        t = text[r.doc_id] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        x = dict(zip(quality_classifier.NAMES, r.x, strict=True))
        assert math.isclose(x["log_words"], math.log1p(len(w))) and math.isclose(x["log_bytes"], math.log1p(len(t.encode())))
        assert math.isclose(x["distinct_words"], len(set(w)) / max(len(w), 1)) and math.isclose(x["bangs"], t.count("!") / max(len(w), 1))
        lines = [x for x in t.split("\n") if x]
        assert math.isclose(x["dup_lines"], 1 - len(set(lines)) / len(lines) if lines else 0, abs_tol=1e-9)
    quality = {r.doc_id: float(r.quality) for r in labels.collect()}
    known = [r for r in rows if r.doc_id in quality and r.fold != 0]
    train, calib = [r for r in known if r.fold != 1], [r for r in known if r.fold == 1]
    x = np.array([r.x for r in train])
    model = quality_classifier.Model(x.mean(0), x.std(0))
    z = model.project(x)
    model.beta = np.linalg.solve(z.T @ z + quality_classifier.RIDGE * len(z) * np.eye(z.shape[1]), z.T @ np.array([quality[r.doc_id] for r in train]))
    raw = model.raw(np.array([r.x for r in calib]))
    cell = np.floor(raw * (quality_classifier.BINS - 1))
    good = np.array([quality[r.doc_id] for r in calib])
    bins = sorted(set(cell))
    model.steps = quality_classifier.isotonic(np.array([raw[cell == c].mean() for c in bins]), np.array([good[cell == c].sum() for c in bins]), np.array([(cell == c).sum() for c in bins]))
    want = dict(zip([r.doc_id for r in rows], model.score(np.array([r.x for r in rows])), strict=True))
    got = {r.doc_id: r.score for r in quality_classifier.classify(documents, labels).collect()}
    assert len(got) == len(want) and all(abs(got[d] - want[d]) < 1e-6 for d in want)


def test_pipeline_stage_by_stage(spark, documents, benchmark):
    """Each stage against a plain version on what its predecessor kept."""
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing to target weights", "token-ID output"]
    sets = [documents]
    for stage in stages.values():
        out = stage(spark, sets[-1], SF)
        sets.append(spark.createDataFrame(out.collect(), out.schema))
    rows = [[(r.doc_id, r.text) for r in d.collect()] for d in sets[:5]]
    scored = {r.doc_id: r.predicted for r in quality_classifier.classify(documents, quality_classifier.labels_of(spark, SF)).collect()}
    assert sorted(rows[1]) == sorted(x for x in rows[0] if scored[x[0]] == 1)
    groups = jaccard.brute_force(rows[1], 5, 80)
    assert sorted(d for d, _ in rows[2]) == sorted({c if n else d for d, n, c in groups})
    marked = {r[0]: r[5] for r in decontaminate.brute_force(rows[2], [(r.item_id, r.text) for r in benchmark.collect()])}
    assert sorted(rows[3]) == sorted(x for x in rows[2] if not marked[x[0]])
    plan = {r.source: r for r in mixing.allot(sets[3]).groupBy("source").agg(F.max("target").alias("target"), F.sum("taken").alias("taken")).collect()}
    words = sets[4].groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()
    assert all(r.n == plan[r.source].taken == math.floor(plan[r.source].target) for r in words)
    assert all(d.columns == documents.columns for d in sets[:5])
    encode = token_output.tokenizer(open(token_output.VOCABULARY, "rb").read())
    assert sum(r.n_tokens for r in sets[5].collect()) == sum(len(encode.encode_ordinary(t)) + 1 for _, t in rows[4] if t)


def test_manifest_means_whole(spark, documents, tmp_path):
    """All shards are there when the call returns, however little of the index is read."""
    out = f"file://{tmp_path}/shards"
    token_output.write_shards(documents, out, seq_len=128, shard_rows=50).limit(1).collect()
    n = sum(1 for _ in token_output.read_slots(out))
    assert n == token_output.json.loads((tmp_path / "shards" / "manifest.json").read_text())["sequences"]


def test_many_shards_in_a_task(spark, documents, tmp_path, monkeypatch):
    whole = token_output.write_shards(documents, f"file://{tmp_path}/a", seq_len=64, shard_rows=20).collect()
    monkeypatch.setattr(token_output, "TASKS", 3)
    monkeypatch.setattr(token_output, "TASK_BYTES", 7 * 64 * 2 * 20)
    assert sorted(token_output.write_shards(documents, f"file://{tmp_path}/b", seq_len=64, shard_rows=20).collect()) == sorted(whole)


def test_queries_are_complete():
    assert len(queries.QUERIES) == 10 and set(queries.ORACLE) <= set(queries.QUERIES)
