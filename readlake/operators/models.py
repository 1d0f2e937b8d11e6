"""Model surface: pluggable scorers in Arrow batches, samples and parameter search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F


def linear_score(x: np.ndarray) -> np.ndarray:
    """The default scorer: a logistic function of a window's mean and spread. No trained weights come with the engine."""
    return 1 / (1 + np.exp(-(x.mean(axis=1) - 1.5 * x.std(axis=1))))


def onnx_scorer(model: bytes) -> Callable[[np.ndarray], np.ndarray]:
    """A scorer from an ONNX model, opened once in each worker."""
    held: list = []

    def score(x: np.ndarray) -> np.ndarray:
        if not held:
            import onnxruntime

            held.append(onnxruntime.InferenceSession(model, providers=["CPUExecutionProvider"]))
        return held[0].run(None, {held[0].get_inputs()[0].name: x.astype(np.float32)})[0].reshape(len(x))

    return score


def score_windows(windows: DataFrame, scorer: Callable[[np.ndarray], np.ndarray] = linear_score, width: int = 1000, batch: int = 32) -> DataFrame:
    """contig, position, score of (contig, win_start, feat) rows, in batches of dense windows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                x = np.zeros((len(part), width))
                for k, feat in enumerate(part.feat):
                    for f in feat:
                        x[k, f["at"]] = f["v"]
                out.append(scorer(np.sign(x) * np.log1p(np.abs(x))))
            yield pd.DataFrame({"contig": rows.contig, "position": rows.win_start, "score": np.concatenate(out)})

    return windows.select("contig", "win_start", "feat").mapInPandas(run, "contig string, position bigint, score double")


def score_channels(windows: DataFrame, scorer: Callable[[np.ndarray], np.ndarray], mean: list[float], channels: int = 9, width: int = 1000, batch: int = 32) -> DataFrame:
    """contig, position, score of (contig, win_start, feat) rows, whose feat is an array of (at, values by channel), in batches of dense
    (n, channels, width) windows. Values are divided by their channel's mean, and then a signed logarithm is taken."""
    by = np.where(np.array(mean, float) > 0, np.array(mean, float), 1.0)[None, :, None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                x = np.zeros((len(part), channels, width))
                for k, feat in enumerate(part.feat):
                    x[k][:, [f["at"] for f in feat]] = np.array([f["v"] for f in feat], float).T
                x /= by
                out.append(scorer(np.sign(x) * np.log1p(np.abs(x))))
            yield pd.DataFrame({"contig": rows.contig, "position": rows.win_start, "score": np.concatenate(out) if out else []})

    return windows.select("contig", "win_start", "feat").mapInPandas(run, "contig string, position bigint, score double")


def balanced(df: DataFrame, keys: list[str], label: str, order: Column, without: int = 100) -> DataFrame:
    """As many rows of each label as there are positives in a group; ``without`` of them if there are none."""
    pos = df.groupBy(*keys).agg(F.count_if(F.col(label) == 1).alias("_pos"))
    i = F.row_number().over(Window.partitionBy(*keys, label).orderBy(order))
    return df.join(pos, keys).withColumn("_i", i).filter(F.col("_i") <= F.when(F.col("_pos") == 0, without).otherwise(F.col("_pos"))).drop("_pos", "_i")


def grid_search(df: DataFrame, rates: list[float], decays: list[float], steps: int = 60, bins: int = 64) -> DataFrame:
    """Logistic fits of (x, y) for every pair of parameters, each in its own task, on a histogram of the rows."""
    cells = df.groupBy(F.floor(F.col("x") * bins).alias("cell")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in rates for b in decays], "rate double, decay double")

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cell")
        x, y, n = (rows[c].to_numpy(float) for c in ("x", "y", "n"))
        w = np.zeros(2)
        rate, decay = rows.rate.iloc[0], rows.decay.iloc[0]
        z = np.column_stack([np.ones(len(x)), x])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-z @ w))
            w -= rate * (z.T @ (n * (p - y)) / n.sum() + decay * w)
        p = np.clip(1 / (1 + np.exp(-z @ w)), 1e-9, 1 - 1e-9)
        loss = -float((n * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / n.sum())
        return pd.DataFrame({"rate": [rate], "decay": [decay], "intercept": [round(w[0], 6)], "slope": [round(w[1], 6)], "loss": [round(loss, 6)]})

    return cells.crossJoin(F.broadcast(grid)).groupBy("rate", "decay").applyInPandas(fit, "rate double, decay double, intercept double, slope double, loss double")


def linear_classes(x: np.ndarray) -> np.ndarray:
    """The default for sequences (n, slices): three logits for each slice, from its value alone."""
    return np.stack([np.full_like(x, 0.5), x, 1 - x], axis=-1)


def score_sequences(df: DataFrame, scorer: Callable[[np.ndarray], np.ndarray] = linear_classes, slices: int = 20, batch: int = 8) -> DataFrame:
    """Class probabilities of (key, values) sequences in blocks of ``slices``, the last one filled with 0: key, block, slice, p0,
    p1, p2. A sequence without values is one block of zeros."""

    n = F.greatest(F.ceil(F.size("values") / slices), F.lit(1))
    blocks = df.select("key", F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("block"), "values").withColumn("values", F.slice("values", F.col("block") * slices + 1, F.lit(slices)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for i in range(0, len(rows), batch):
                part = rows.iloc[i : i + batch]
                x = np.zeros((len(part), slices))
                for k, v in enumerate(part["values"]):
                    x[k, : len(v)] = v
                z = scorer(x)
                e = np.exp(z - z.max(axis=-1, keepdims=True))
                p = (e / e.sum(axis=-1, keepdims=True)).reshape(-1, 3)
                yield pd.DataFrame({"key": np.repeat(part.key.to_numpy(), slices), "block": np.repeat(part.block.to_numpy(), slices), "slice": np.tile(np.arange(slices), len(part)), "p0": p[:, 0], "p1": p[:, 1], "p2": p[:, 2]})

    return blocks.select("key", "block", "values").mapInPandas(run, "key bigint, block int, slice int, p0 double, p1 double, p2 double")


def restore(saved: dict, wanted: list[str], prefixes: tuple[str, ...] = ("module.", "model.")) -> tuple[dict, list[str]]:
    """Saved weights under the wanted names, wrappers' prefixes removed, and the names that are missing."""
    plain = {}
    for name, value in saved.items():
        while (p := next((p for p in prefixes if name.startswith(p)), None)) and name not in wanted:
            name = name[len(p) :]
        plain[name] = value
    return {n: plain[n] for n in wanted if n in plain}, [n for n in wanted if n not in plain]
