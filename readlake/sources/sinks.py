"""Sinks: staged tables that are reused, blocks, records, read text, images and job files."""

from __future__ import annotations

import gzip
import io
import json
import shutil
import struct
import subprocess
import tarfile
import tempfile
import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; a temporary one only where none is set and all is one machine."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        root = "file://" + tempfile.mkdtemp(prefix="readlake-")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def done(spark: SparkSession, path: str) -> bool:
    """Whether a table was written there to its end."""
    jvm = spark._jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    return jvm.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jvm)


def stage(spark: SparkSession, path: str, build: Callable[[], DataFrame], again: bool = False) -> DataFrame:
    """The table at ``path``, built only if it was not finished before or ``again`` is set."""
    if again or not done(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def write_blocks(df: DataFrame, path: str, by: str = "contig") -> None:
    """Parquet by contig; a reader of some contigs opens only their folders."""
    df.repartition(by).sortWithinPartitions(by).write.partitionBy(by).mode("overwrite").parquet(path)


def write_batches(df: DataFrame, path: str, by: str, order: str, size: int = 100) -> None:
    """Parquet by ``by``, with ``batch``: rows in order in full batches of ``size`` and a tail."""
    i = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    df.withColumn("batch", F.floor(i / size)).write.partitionBy(by).mode("overwrite").parquet(path)


def write_records(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Text with a header in every file, one file with a header where there are no rows."""
    (df if not df.isEmpty() else df.coalesce(1)).write.mode("overwrite").option("header", True).csv(path)


def csv_round_trip(df: DataFrame, path: str) -> DataFrame:
    """``df`` written as text and read again with its columns and types."""
    write_csv(df, path)
    return df.sparkSession.read.schema(df.schema).option("header", True).option("enforceSchema", False).csv(path)


def write_sorted(df: DataFrame, path: str, order: list[Column]) -> None:
    """Parquet files whose rows, and which by name, are in one order."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)


def merge_sorted(spark: SparkSession, paths: list[str], order: list[str], batch: int = 300) -> str:
    """The path of one sorted set of the rows of many, ``batch`` inputs at a time, then the merged batches again, as long as
    there are several. Sets between are deleted."""
    made: list[str] = []
    while len(paths) > 1:
        after = []
        for i in range(0, len(paths), batch):
            own = paths[i : i + batch]
            after.append(scratch(spark, "merged"))
            write_sorted(spark.read.parquet(*own), after[-1], [F.col(c) for c in order])
        wipe(spark, [p for p in paths if p in made])
        paths, made = after, after
    return paths[0]


def wipe(spark: SparkSession, paths: list[str]) -> None:
    """Delete outputs of an earlier run."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def locate(spark: SparkSession, paths: list[str], columns: set[str]) -> str | None:
    """The first finished text table whose header has the columns."""
    return next((p for p in paths if done(spark, p) and columns <= {c.strip() for c in spark.read.option("header", True).csv(p).columns}), None)


# Names of assembly outputs.
OUTPUTS = (".unitig.fa", ".ctg.fa", ".mag.gz", ".fa", ".fasta", ".pre.gz")


def assembly_outputs(files: DataFrame, keys: list[str], name: str, changed: Column) -> DataFrame:
    """keys, outputs (distinct files of an assembly's kinds), first (by name) and latest (file of any kind, by ``changed``)."""
    own = F.lit(False)
    for end in OUTPUTS:
        own = own | F.col(name).endswith(end)
    kept = F.when(own, F.col(name))
    return files.groupBy(*keys).agg(F.count_distinct(kept).alias("outputs"), F.min(kept).alias("first"), F.max_by(name, changed).alias("latest"))


def missing(spark: SparkSession, wanted: DataFrame, path: str) -> DataFrame:
    """``wanted`` (name) without the names of the folders ``name=...`` under ``path`` that hold a file."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "part-*").load(path).select("path")
    have = files.select(F.url_decode(F.regexp_extract("path", r"/name=([^/]+)/", 1)).alias("name")).distinct()
    return wanted.join(have, "name", "left_anti")


def archives(files: DataFrame) -> DataFrame:
    """One tar.gz for each region of (region, name, content): region, manifest (tab separated name and bytes), data. A region's
    files are held by one task, as its archive is one value; names come in order and carry no time, so reruns agree."""

    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("name")
        out = io.BytesIO()
        with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as zipped, tarfile.open(fileobj=zipped, mode="w") as tar:
            for name, content in zip(rows.name, rows.content, strict=True):
                info = tarfile.TarInfo(name)
                data = content.encode()
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
        manifest = "".join(f"{n}\t{len(c.encode())}\n" for n, c in zip(rows.name, rows.content, strict=True))
        return pd.DataFrame({"region": [rows.region.iloc[0]], "manifest": [manifest], "data": [out.getvalue()]})

    return files.groupBy("region").applyInPandas(pack, "region string, manifest string, data binary")


def archived(packed: DataFrame) -> DataFrame:
    """region, name, bytes of the files in archives."""

    def unpack(batches):
        for rows in batches:
            found = []
            for region, data in zip(rows.region, rows.data, strict=True):
                with tarfile.open(fileobj=io.BytesIO(data), mode="r:gz") as tar:
                    found += [(region, m.name, m.size) for m in tar.getmembers()]
            yield pd.DataFrame(found, columns=["region", "name", "bytes"])

    return packed.select("region", "data").mapInPandas(unpack, "region string, name string, bytes bigint")


def progress_line(current: Column, total: Column, width: int = 20) -> Column:
    """``done n of m [####....] p%``."""
    share = F.coalesce(F.least(F.try_divide(current.cast("double"), total), F.lit(1.0)), F.lit(0.0))
    full = F.floor(share * width).cast("int")
    return F.format_string("done %d of %d [%s%s] %.1f%%", current, total, F.repeat(F.lit("#"), full), F.repeat(F.lit("."), width - full), share * 100)


def fastq(qname, seq, qual) -> Column:
    """A read as four lines of text."""
    return F.concat(F.lit("@"), F.col(qname).cast("string"), F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.col(qual))


def png(levels: np.ndarray) -> bytes:
    """An 8-bit grey image."""
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    height, width = levels.shape
    lines = np.hstack([np.zeros((height, 1), np.uint8), levels.astype(np.uint8)]).tobytes()
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(lines, 6)) + part(b"IEND", b"")


def contact_sheet(slices: np.ndarray, columns: int = 5, side: int = 128) -> bytes:
    """Thumbnails of (n, height, width) slices, every k-th pixel, in rows of ``columns``."""
    n, h, w = slices.shape
    small = slices[:, :: max(1, -(-h // side)), :: max(1, -(-w // side))]
    sheet = np.zeros((-(-n // columns) * side, columns * side), np.uint8)
    for i, one in enumerate(small):
        y, x = i // columns * side, i % columns * side
        sheet[y : y + one.shape[0], x : x + one.shape[1]] = one
    return png(sheet)


def sheets(pixels: DataFrame, keys: str, height: int = 256, width: int = 50, slices: int = 20) -> DataFrame:
    """A ``keys`` struct's contact sheet of (slice, y, x, level) rows as bytes: key columns, png."""
    def draw(rows: pd.DataFrame) -> pd.DataFrame:
        image = np.zeros((slices, height, width), np.uint8)
        image[rows.slice, rows.y, rows.x] = rows.level
        return pd.DataFrame({"key": [rows.key.iloc[0]], "png": [contact_sheet(image)]})

    inside = pixels.filter((F.col("y") < height) & (F.col("x") < width) & (F.col("slice") < slices))
    return inside.withColumn("key", F.expr(keys)).groupBy("key").applyInPandas(draw, "key string, png binary")


def region_status(bases, known, least: int = 10_000, most: int = 256 << 20) -> Column:
    """What to do with a region: reuse what is there, leave out the empty and the oversized, assemble the rest."""
    return F.when(known, "cached").when(bases < least, "empty").when(bases > most, "oversized").otherwise("assemble")


def job_text(prefix, reads, threads: int = 4, k: int = 61, tools: tuple[str, ...] = ("correct", "index", "assemble")) -> Column:
    """A make file of the steps that an assembly of ``reads`` takes, each from the file before."""
    lines, before = [], reads
    for tool in tools:
        after = F.concat(prefix, F.lit(f".{tool}"))
        lines.append(F.concat(after, F.lit(": "), before, F.lit(f"\n\t{tool} -t {threads} -k {k} $< > $@\n")))
        before = after
    return F.concat(F.lit("all: "), before, F.lit("\n"), *lines)


def run_jobs(jobs: DataFrame, tool: str = "make") -> DataFrame:
    """Runs (region, status, job) rows that are to be assembled where ``tool`` exists; status says how it went."""

    def one(status: str, job: str, have: bool) -> str:
        if status != "assemble" or not have:
            return status if status != "assemble" else "no tool"
        with tempfile.NamedTemporaryFile("w", suffix=".mk") as f:
            f.write(job)
            f.flush()
            return "assembled" if subprocess.run([tool, "-f", f.name], capture_output=True, check=False).returncode == 0 else "failed"

    def run(batches):
        have = shutil.which(tool) is not None
        for rows in batches:
            yield rows.assign(status=[one(s, j, have) for s, j in zip(rows.status, rows.job, strict=True)])[["region", "status"]]

    return jobs.select("region", "status", "job").mapInPandas(run, "region string, status string")


def manifest_valid(files: DataFrame, manifest: str) -> DataFrame:
    """``files`` (path, length, content) against a JSON object of name to size and sha256: name, found, valid."""
    wanted = files.sparkSession.createDataFrame([(k, v["size"], v["sha256"]) for k, v in json.loads(manifest).items()], "name string, size bigint, sha string")
    have = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", F.sha2("content", 256).alias("got"))
    both = F.broadcast(wanted).join(have, "name", "left")
    return both.select("name", F.col("got").isNotNull().alias("found"), F.coalesce((F.col("length") == F.col("size")) & (F.col("got") == F.col("sha")), F.lit(False)).alias("valid"))
