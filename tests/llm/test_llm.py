"""The training-data operators against brute force, SQL, round trips and odd inputs."""

import contextlib
import hashlib
import math
import pathlib
import time
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from readlake.llm import bytewise, chat_format, common, components, decontaminate, jaccard, katz, license_scan, line_dedup, mixing, quality_classifier, quality_rules, queries, token_output

SF = "/root/testdata/sf0.001"
TABLES = ("documents", "labels", "benchmark", "conversations")
DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint, size int, n_lines string, label string, score double"


@pytest.fixture(scope="module")
def docs(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows and clashing column names."""
    line = "All rights reserved. Alpha beta gamma\nDelta éclair 9\nLast line here"
    rows = [(1, line), (1, line), (2, line), (3, None), (None, "one two three four five"), (None, None), (4, ""), (5, " \n\t "), (6, "x"), (7, "cc by cc by " + "word " * 30000), (8, "\n".join(["a b", "c d", "e f"] * 3))]
    return spark.createDataFrame([(d, t, None if i % 2 else "en", None if i % 3 else "s", None, i, "q", "r", 0.5) for i, (d, t) in enumerate(rows)], DOC)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    c = con.execute(queries.ORACLE[name])
    names = [d[0] for d in c.description]
    assert sorted(tuple(r[n] for n in names) for r in df.collect()) == sorted(c.fetchall())


def test_license(spark, docs, odd):
    for r in license_scan.scan(spark.read.parquet(f"{SF}/documents.parquet")).collect():
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == license_scan.brute_force(dict(docs)[r.doc_id])
    got = license_scan.scan(odd).collect()
    assert len(got) == odd.count()
    text = "Permission is hereby granted free of charge to all and any person obtaining a copy of this software and associated documentation files"
    r = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()
    assert r.labels == "mit" and 0.86 <= r.score <= 1


def test_mixing(spark, odd):
    got = mixing.allot(odd).collect()
    assert len(got) == odd.count() and all(r.taken <= 3 * r["size"] for r in got)
    assert mixing.mix(odd).columns == odd.columns
    assert mixing.allot(odd.limit(0)).count() == 0
    d = spark.read.parquet(f"{SF}/documents.parquet")
    plan = mixing.allot(d).groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target")).collect()
    assert all(r.taken == math.floor(r.target) for r in plan)
    words = mixing.mix(d).groupBy("source").agg(F.sum(mixing.size_of(F.col("text"))).alias("n")).collect()
    assert {r.source: r.n for r in words} == {r.source: r.taken for r in plan}


def test_mixing_blank_source(spark):
    """A source without words keeps its turn of the weights 1, 2, 3."""
    words = "w " * 100
    rows = [(1, words, "a"), (2, " \n", "b"), (3, None, "b"), (4, words, "c"), (5, words, "d")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = {r.doc_id: (r.source_size, r.target, r.taken) for r in mixing.allot(d).collect()}
    assert got == {1: (100, 60.0, 60), 2: (0, 0.0, 0), 3: (0, 0.0, 0), 4: (100, 180.0, 180), 5: (100, 60.0, 60)}
    blank = mixing.allot(d.filter("source = 'b'")).collect()
    assert [(r.target, r.taken) for r in blank] == [(0.0, 0), (0.0, 0)] and mixing.mix(d.filter("source = 'b'")).count() == 0


def test_permutation():
    for n in (1, 2, 3, 17, 1000, 4096, 4097):
        x = np.arange(n)
        y = token_output.permute(x, n)
        assert sorted(y) == list(x) and (token_output.permute(y, n, inverse=True) == x).all()


def test_token_output(spark, docs, odd, tmp_path):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    out = f"file://{tmp_path}/shards"
    rows = token_output.write_shards(d, out, seq_len=256, shard_rows=100).orderBy("slot").collect()
    e = token_output.tokenizer(open(token_output.VOCABULARY, "rb").read())
    stream = np.concatenate([np.append(e.encode_ordinary(t), token_output.END) for _, t in docs if t])
    records = list(token_output.read_slots(out))
    assert [hashlib.sha256(r.tobytes()).hexdigest() for r in records] == [r.sha256 for r in rows]
    back = np.concatenate([records[s] for s in token_output.permute(np.arange(len(records)), len(records))])
    assert (back[: len(stream)] == stream).all() and (back[len(stream) :] == token_output.END).all()
    assert [list(x) for x in token_output.read_slots(out, 95, 10)] == [list(x) for x in records[95:105]]
    assert token_output.write_shards(odd, f"file://{tmp_path}/odd", seq_len=64).count() > 0
    assert token_output.write_shards(odd.limit(0), f"file://{tmp_path}/none").count() == 0


def test_katz(spark, docs, odd):
    got = sorted(tuple(r) for r in katz.score(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    for a, b in zip(got, sorted(katz.brute_force(docs)), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-7) and math.isclose(a[6], b[6], rel_tol=1e-7)
    rows = katz.score(odd).collect()
    assert len(rows) == odd.count() and all(math.isfinite(r.score) for r in rows)
    assert katz.score(odd.limit(0)).count() == 0


def test_katz_adds_up():
    """Each history's probabilities add up to 1 over the vocabulary, the end and the unseen type;
    texts score as the product of these."""
    train = [r for r in enumerate(["a b c a b", "a c b b a d", "d a b", "c c a"] * 3) if zlib.crc32(str(r[0]).encode()) % katz.FOLDS != katz.HELD]
    p = _direct(train)
    for history in ("", "a", "b", "c", "d", "never"):
        assert math.isclose(sum(10 ** p(w, history) for w in ("a", "b", "c", "d", "end", "zzz")), 1.0, rel_tol=1e-9)
    held = next(i for i in range(100, 999) if zlib.crc32(str(i).encode()) % katz.FOLDS == katz.HELD)
    want = p("a", "") + p("d", "a") + p("zzz", "d") + p("a", "zzz") + p("end", "a")
    assert math.isclose(katz.brute_force([*train, (held, "a d zzz a")])[-1][6], want, rel_tol=1e-9)


def test_katz_blocks_and_buckets(spark, docs, monkeypatch):
    """Tallies of many blocks, spread over many buckets, give the same scores."""
    monkeypatch.setattr(katz, "BLOCK", 5000)
    monkeypatch.setattr(katz, "BUCKET", 4000)
    got = sorted(tuple(r) for r in katz.score(spark.read.parquet(f"{SF}/documents.parquet")).collect())
    for a, b in zip(got, sorted(katz.brute_force(docs)), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-7) and math.isclose(a[6], b[6], rel_tol=1e-7)


def test_katz_tallies():
    rng = np.random.default_rng(4)
    count, at = rng.integers(1, 3 * katz.GT, 500), rng.integers(0, 50, 500)
    for n in ([900, 300, 120, 70, 40, 20], [0] * 6):
        d = katz.Discounts(n)
        assert np.allclose(d.sums(katz._tally(count, at, 50)), np.bincount(at, d.mass(count), 50), rtol=1e-12)


def test_katz_disk(spark, tmp_path, monkeypatch):
    """Blocks and the shuffle files of written tables are gone before scores are read; the model's tables stay."""
    dirs = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString())

    def shuffled(but: set = frozenset()) -> dict:
        found = {}
        for f in (f for d in dirs for f in pathlib.Path(d).rglob("shuffle_*.data") if f not in but):
            with contextlib.suppress(FileNotFoundError):  # deleted meanwhile
                found[f] = f.stat().st_size
        return found

    monkeypatch.setattr(common, "shared_dir", lambda _: f"file://{tmp_path}")
    before, own = set(shuffled()), spark.conf.get(common.CLEANUP, None)
    scores = katz.score(spark.read.parquet(f"{SF}/documents.parquet"))
    assert spark.conf.get(common.CLEANUP, None) == own
    assert {f.name.rsplit("-", 1)[0] for f in tmp_path.iterdir()} == {"lm-words", "lm-pairs", "lm-partial", "lm-weights"}
    until = time.monotonic() + 20
    while sum(shuffled(before).values()) > 50_000 and time.monotonic() < until:
        time.sleep(0.2)
    assert sum(shuffled(before).values()) <= 50_000
    assert scores.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def _direct(train):
    """The model's own conditional probabilities, recomputed from counts."""
    from collections import Counter

    c, pair, hist = Counter(), Counter(), Counter()
    for _, t in train:
        words = [*t.split(), "end"]
        c.update(words)
        pair.update(zip(["", *words], words, strict=False))
        hist.update(["", *words[:-1]])
    n, types = sum(c.values()), len(c)
    uni, bi = (katz.Discounts([sum(v == r for v in x.values()) for r in range(1, katz.GT + 2)]) for x in (c, pair))
    mass = lambda d, r: float(d.mass(np.array([r]))[0])
    unseen = max(1 - sum(mass(uni, v) for v in c.values()) / n, 1 / (n + types + 1))
    p1 = lambda w: mass(uni, c[w]) / n if c[w] else unseen

    def p(w, a):
        if pair[a, w]:
            return math.log10(mass(bi, pair[a, w]) / hist[a])
        seen = [x for (h, x) in pair if h == a]
        alpha = (1 - sum(mass(bi, pair[a, x]) for x in seen) / hist[a]) / (1 - sum(p1(x) for x in seen)) if hist[a] else 1
        return math.log10(alpha * p1(w))

    return p


def test_jaccard(spark, docs, odd):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    assert sorted(tuple(r) for r in jaccard.cluster(d).collect()) == sorted(jaccard.brute_force(docs, 4, 85))
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.cluster(odd).collect()}
    assert {(1, 9, 1), (2, 9, 1), (3, 0, 3), (4, 0, 4), (None, 2, None)} <= got
    assert jaccard.cluster(odd.limit(0)).count() == 0
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id for r in kept.filter("doc_id is not null").collect()) == [1, 3, 4, 5, 6, 7, 8]


def test_jaccard_family(spark):
    """A family of near copies whose first member is no hub: every link counts."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(90):
        w = list(base)
        for j in rng.choice(120, rng.integers(0, 6), replace=False):
            w[j] = f"e{i}_{j}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert sorted(tuple(r) for r in jaccard.cluster(df).collect()) == sorted(jaccard.brute_force(rows, 4, 85))


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 200, (150, 2)) if a != b] + [(1000 + i, 1001 + i) for i in range(40)]
    got = {r.id: r.root for r in components.components(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        parent[b] = a
    assert got == {x: top(x) for x in parent}


def test_quality_rules(spark, odd):
    got = quality_rules.judge(odd).collect()
    assert len(got) == odd.count() and not any(r.kept for r in got if r.n_words < 20)
    assert next(r for r in got if r.doc_id == 7).n_repeat_words == 30000
    q = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    judged = [r for r in quality_rules.judge(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect() if r.doc_id in q and not r.base_failed]
    good = [r.kept for r in judged if q[r.doc_id] == 1]
    assert sum(good) > 0.97 * len(good) and sum(r.kept for r in judged if q[r.doc_id] == 0) <= 3


def test_quality_classifier(spark, odd):
    labels = quality_classifier.labels_of(spark, "/root/testdata/sf0.01")
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    q = {r.doc_id: r.quality for r in labels.collect()}
    held = [r for r in quality_classifier.classify(d, labels).collect() if r.held_out and r.doc_id in q]
    assert sum(r.predicted == q[r.doc_id] for r in held) > 0.92 * len(held)
    rows = quality_classifier.classify(odd, labels.limit(0)).collect()
    assert len(rows) == odd.count() and {r.score for r in rows} == {0.5}
    assert quality_classifier.keep_good(d, labels).columns == d.columns


def test_isotonic():
    x, y = quality_classifier.isotonic(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 3, 1, 4]), np.array([4, 4, 4, 4]))
    assert list(y) == sorted(y) and len(x) == 3


def test_decontamination(spark, docs, odd):
    bench = [(1, "one two three"), (1, "one two three"), (2, None), (None, "gamma delta éclair"), (3, "x"), (4, " ".join(f"t{i}" for i in range(15)))]
    b = spark.createDataFrame(bench, "item_id bigint, text string")
    mine = [(r.doc_id, r.text) for r in odd.collect()] + [(90, "a t0 t1 t2 t3 t4 t5 t6 t7 t8 t9, z")]
    d = spark.createDataFrame(mine, "doc_id bigint, text string")
    want = sorted(map(str, decontaminate.brute_force(mine, bench)))
    assert sorted(str(tuple(r)) for r in decontaminate.report(d, b).collect()) == want
    # In blocks, as beyond the broadcast's bound.
    assert sorted(str(tuple(r)) for r in decontaminate.report(d, b, limit=20).collect()) == want
    assert decontaminate.decontaminate(odd, b).columns == odd.columns
    cut = decontaminate.decontaminate(d, b, "spans").filter("doc_id = 90").first().text
    assert cut == "a , z"
    assert decontaminate.report(odd, b.limit(0)).filter("contaminated").count() == 0
    assert decontaminate.report(odd.limit(0), b).count() == 0


def test_chat(spark):
    rows = [(1, 0, "user", "a ### b"), (1, 1, "assistant", "</turn>\n### x: y"), (2, 0, None, None), (2, 0, None, None), (None, None, "assistant", "\\h## \\b"), (3, 1, "assis: tant", "### "), (4, 0, "assistant", "plain")]
    c = chat_format.with_tricky(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    out = {r.conv_id: r for r in chat_format.format_conversations(c).collect()}
    assert [(t.role, t.text) for t in out[1].turns] == [("user", "a ### b"), ("assistant", "</turn>\n### x: y")]
    assert out[-7].level == 1 and out[4].level == 0 and len(out[2].turns) == 2 and out[3].turns[0].role == "assis: tant"
    assert [t.text for t in out[None].turns] == ["\\h## \\b"]
    assert chat_format.digest(chat_format.format_conversations(c.limit(0))).count() == 0


def test_chat_loss_mask(spark):
    """Spans over the formatted text hold what the assistant said and nothing else, escaped where the text is."""
    rows = [(1, 0, "user", "q é"), (1, 1, "assistant", "é plain"), (1, 2, "assistant", ""), (2, 0, "us: er", "x"), (2, 1, "assistant", "a ### b\\"), (2, 1, "assistant", "a ### b\\"), (3, None, "assistant", "first"), (3, 0, "user", "no"), (4, 0, None, None)]
    out = chat_format.format_conversations(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"))
    cut = {r.conv_id: [r.formatted[s.start : s.start + s.length] for s in r.loss] for r in out.collect()}
    assert cut == {1: ["é plain", ""], 2: ["a \\h## b\\b"] * 2, 3: ["first"], 4: []}
    said = {r.conv_id: r.said for r in out.select("conv_id", chat_format.under_mask().alias("said")).collect()}
    assert said == {1: ["é plain", ""], 2: ["a ### b\\"] * 2, 3: ["first"], 4: []}


def test_line_dedup(spark, odd):
    got = {(r.doc_id, r.n_lines, r.n_removed) for r in line_dedup.dedup_lines(odd).collect()}
    assert {(1, 3, 0), (2, 3, 3), (3, 0, 0), (4, 1, 0), (8, 9, 6)} <= got
    assert line_dedup.dedup_lines(odd).count() == odd.count() and line_dedup.dedup_lines(odd.limit(0)).count() == 0


def test_bytewise():
    import pyarrow as pa

    x = ["Aé b  C\n", None, "", "x", "Yy zñ 9-a", " q "]
    got = [[w.text(i).decode() for i in range(w.ptr[r], w.ptr[r + 1])] for w in bytewise.scan(pa.array(x), bytewise.ALNUM, chunk=4) for r in range(w.hi - w.lo)]
    assert got == [["aé", "b", "c"], [], [], ["x"], ["yy", "zñ", "9", "a"], ["q"]]


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows)))
