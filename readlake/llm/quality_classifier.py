"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

One pass over the texts gives each document a row of statistics (bytewise, vectorised).
Random Fourier features of the standardised statistics approximate a Gaussian kernel;
partitions sum their parts of the normal equations, which add up to one small matrix whose
size depends on ``FEATURES`` only; the ridge solution scores all documents. Another fold of the
labels calibrates the scores: labels are summed in ``BINS`` bins of the score, and
pool-adjacent-violators makes the bins' rates monotone.

Labels of rows whose crc32(doc_id as text) mod 5 is 0 are held out; mod 1 calibrates; the rest
fit. Of lang, source and doc_id none enters a score: statistics come from the text alone.

Defined results: null text counts as empty and is scored; rows whose doc_id is null are
scored, and held out as the empty text's crc32 says; repeated labels of a doc_id count by
their largest; without labels for fitting every score is 0.5, and without any for
calibrating the raw score, cut to 0..1, stands.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from readlake.llm import bytewise
from readlake.llm.common import map_batches, materialize

FEATURES = 192
RIDGE = 1e-3
BINS = 512
CUT = 0.3
SEED = 20240601
#: Parts of the normal equations that reach the driver.
PARTS = 32

NAMES = (
    "log_words", "log_bytes", "word_length", "capitals", "digits", "bangs", "bars", "symbols", "stops", "commas", "other_marks", "non_ascii", "blanks", "newlines",
    "distinct_words", "log_lines", "dup_lines", "repeat_triples", "capital_words", "marked_words",
)


def _class(chars: str) -> np.ndarray:
    m = np.zeros(256, bool)
    m[[ord(c) for c in chars]] = True
    return m


_CLASSES = [
    _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789"), _class("!"), _class("|"), _class("#*$%&<>@^~_="), _class(".?"), _class(","), _class(":;()[]{}/\\-+\"'`"),
    np.arange(256) >= 0x80, _class(" \t\r\x0b\x0c"), _class("\n"),
]


def _per_row(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=sums[1:])
    return np.diff(sums[at])


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes of each row."""
    if not len(h):
        return np.zeros(n, np.int64)
    order = np.lexsort((h, row))
    r, x = row[order], h[order]
    new = np.ones(len(x), bool)
    new[1:] = (r[1:] != r[:-1]) | (x[1:] != x[:-1])
    return np.bincount(r[new], minlength=n)


_NEWLINE = np.arange(256) != 0x0A


def statistics(col: pa.Array) -> np.ndarray:
    """Rows of ``NAMES``."""
    out = []
    lines = bytewise.scan(col, _NEWLINE, lower=False)
    for w, l in zip(bytewise.scan(col, bytewise.SOLID, lower=False), lines, strict=True):
        n = w.hi - w.lo
        size = np.diff(w.off)
        words, n_lines = w.counts, l.counts
        per = lambda a, b: a / np.maximum(b, 1)
        found = [_per_row(m[w.buf], w.off) for m in _CLASSES]
        row, h = w.rows(), w.hashes()
        triples, at = w.grams(h, 3)
        n_triples = np.maximum(words - 2, 0)
        upper = _CLASSES[0][w.buf]
        capital = np.zeros(n)
        marked = np.zeros(n)
        if len(w.start):
            sums = np.zeros(len(upper) + 1, np.int64)
            np.cumsum(upper, out=sums[1:])
            length = w.end - w.start
            capital = np.bincount(row, (sums[w.end] - sums[w.start]) * 2 > length, n)
            marked = np.bincount(row, (_CLASSES[4] | _CLASSES[2] | _CLASSES[3])[w.buf[w.end - 1]], n)
        chars = np.add.reduceat(np.append(w.end - w.start, 0), np.minimum(w.ptr[:-1], len(w.start))) * (words > 0) if n else np.zeros(0)
        out.append(np.column_stack([
            np.log1p(words), np.log1p(size), per(chars, words), per(found[0], size), per(found[1], size), per(found[2], words), per(found[3], words), per(found[4], words),
            per(found[5], words), per(found[6], words), per(found[7], words), per(found[8], size), per(found[9], words), per(found[10], words),
            per(_distinct(row, h, n), words), np.log1p(n_lines), 1 - per(_distinct(l.rows(), l.hashes(), n), n_lines) * (n_lines > 0) - (n_lines == 0),
            (n_triples - _distinct(row[at], triples, n)) / np.maximum(n_triples, 1), per(capital, words), per(marked, words),
        ]))
    return np.concatenate(out)


def features(documents: DataFrame) -> DataFrame:
    """doc_id, fold, x (statistics); other columns stay."""
    keep = documents.columns
    rest = [c for c in keep if c != "text"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name != "text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = statistics(batch.column("text"))
        ptr = np.arange(0, x.size + 1, x.shape[1])
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), bytewise.list_array(x.ravel(), ptr, pa.float64())], names=[*rest, "x"])

    found = map_batches(documents, run, f"{kinds}, x array<double>", 2000)
    said = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return found.withColumn("fold", F.pmod(F.crc32(said.cast("binary")), F.lit(5)).cast("int"))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(NAMES))


class Model:
    """Standardisation, random features, ridge weights and calibration steps."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray):
        d = len(NAMES)
        rng = np.random.Generator(np.random.PCG64(SEED))
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w, self.b = rng.standard_normal((d, FEATURES)) / np.sqrt(d), rng.uniform(0, 2 * np.pi, FEATURES)
        self.beta: np.ndarray | None = None
        self.steps: tuple[np.ndarray, np.ndarray] | None = None

    def project(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6)
        return np.column_stack([np.sqrt(2 / FEATURES) * np.cos(z @ self.w + self.b), np.ones(len(z))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.full(len(x), 0.5) if self.beta is None else np.clip(self.project(x) @ self.beta, 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        return raw if self.steps is None else np.clip(np.interp(raw, *self.steps), 0, 1)


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray] | None:
    """Sums of z z' and z y over all rows, added up in two levels."""
    size = FEATURES + 1

    def part(batches):
        total = np.zeros((size, size + 1))
        for batch in batches:
            z = model.project(_matrix(batch))
            y = batch.column("quality").to_numpy(zero_copy_only=False).astype(float)
            total[:, :size] += z.T @ z
            total[:, size] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    def add(batches):
        total = sum((np.frombuffer(m, float) for batch in batches for m in batch.column("m").to_pylist()), np.zeros(size * (size + 1)))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = rows.mapInArrow(part, "m binary").repartition(PARTS).mapInArrow(add, "m binary").collect()
    # Sorted, so that sums of doubles do not depend on the order in which parts arrive.
    total = sum((np.frombuffer(p, float) for p in sorted(r[0] for r in parts)), np.zeros(size * (size + 1))).reshape(size, size + 1)
    return total[:, :size], total[:, size]


def isotonic(value: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over bins: mean values and rates of the blocks, rising."""
    blocks: list[list[float]] = []
    for v, g, c in zip(value, good, n, strict=True):
        blocks.append([v * c, g, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    # Half an observation of either kind keeps rates off 0 and 1.
    return np.array([b[0] / b[2] for b in blocks]), np.array([(b[1] + 0.5) / (b[2] + 1) for b in blocks])


def fit(rows: DataFrame, labels: DataFrame) -> Model:
    """A model from ``features`` rows and (doc_id, quality) labels."""
    own = labels.filter("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    known = materialize(rows.select("doc_id", "fold", "x").filter("fold <> 0").join(own, "doc_id").select("fold", "x", F.col("quality").cast("double").alias("quality")), "labelled")
    train, other = known.filter("fold <> 1").select("x", "quality"), known.filter("fold = 1").select("x", "quality")
    d = len(NAMES)
    moments = train.agg(F.count("*"), *[f(F.get("x", F.lit(i))) for i in range(d) for f in (F.avg, F.stddev_pop)]).first()
    if not moments[0]:
        return Model(np.zeros(d), np.ones(d))
    model = Model(np.array(moments[1::2], float), np.array(moments[2::2], float))
    a, y = _normal_equations(train, model)
    model.beta = np.linalg.solve(a + RIDGE * moments[0] * np.eye(len(a)), y)
    frozen = model

    def raw(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(frozen.raw(_matrix(batch))), batch.column("quality")], names=["raw", "quality"])

    sums = map_batches(other, raw, "raw double, quality double").groupBy(F.floor(F.col("raw") * (BINS - 1)).alias("bin")).agg(F.avg("raw"), F.sum("quality"), F.count("*")).orderBy("bin").collect()
    if sums:
        t = np.array([tuple(r)[1:] for r in sums], float)
        model.steps = isotonic(t[:, 0], t[:, 1], t[:, 2])
    return model


def score(rows: DataFrame, model: Model, cut: float = CUT) -> DataFrame:
    """``rows`` (of ``features``) with score and predicted in place of x."""
    rest = [c for c in rows.columns if c != "x"]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "x")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = model.score(_matrix(batch))
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), pa.array(s), pa.array((s >= cut).astype(np.int32))], names=[*rest, "score", "predicted"])

    return map_batches(rows, run, f"{kinds}, score double, predicted int")


def classify(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    rows = materialize(features(documents.select("doc_id", "text")), "quality-features")
    return score(rows, fit(rows, labels), cut).select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", "predicted")


def keep_good(documents: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """``documents`` without the rejected ones. Statistics are taken in the pass that
    filters, so texts are neither shuffled nor joined."""
    rows = materialize(features(documents.select("doc_id", "text")), "quality-features")
    model = fit(rows, labels)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch.filter(pa.array(model.score(statistics(batch.column("text"))) >= cut))

    return map_batches(documents, run, kinds, 2000)


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
