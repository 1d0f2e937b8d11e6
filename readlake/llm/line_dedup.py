"""Line deduplication over overlapping three-line windows. DataFrame functions only.

Lines are the parts of a text between ``\\n``. Every window of ``width`` consecutive lines is
hashed to 128 bits (lines are compared without outer blanks; windows of blank lines only do
not count). A window that stands earlier, in the order of (document, place), is a repeat:
all its lines are covered, overlapping covered places merge, and covered lines go.

A document is its doc_id and text: rows that repeat both are one document and get the same
result, so exact copies under one doc_id do not erase each other, while copies under
different doc_ids do. The order of documents is doc_id (null first), then a hash of the text.

Defined results: null text stays null with 0 lines, texts with fewer lines than ``width``
keep all of them, and columns beyond doc_id and text stay as they are.

Scale: first places are found by a partially aggregated minimum, so a window that a third
of the documents hold needs one row for each map task. The join back to the windows is a
plain equi-join on the hash, whose hot keys adaptive execution splits. A bitmap of fixed size
tells most documents without repeats, whose texts are not shuffled; the others meet their list
of repeats in a shuffle. Beyond some ten million such documents the bitmap fills up and lets
more texts pass into the shuffle, with the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from readlake.llm.common import free_names, materialize

#: Lines of a window.
WIDTH = 3
#: Parts of 4 KB of the bitmap of documents with repeats, which is broadcast.
BITMAP = 1024
_BLANK = " \t\r\x0b\x0c"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """_key (document), _pos (first line from 0), _h1, _h2 of each window."""
    lines = documents.select(
        F.struct("doc_id", F.xxhash64("text").alias("h")).alias("_key"),
        F.transform(_lines(F.col("text")), lambda x: F.btrim(x, F.lit(_BLANK))).alias("_lines"),
    ).filter(F.size("_lines") >= width)
    starts = lines.select("_key", "_lines", F.explode(F.sequence(F.lit(0), F.size("_lines") - width)).alias("_pos"))
    part = [F.get("_lines", F.col("_pos") + i) for i in range(width)]
    return starts.filter(F.concat(*part) != "").select("_key", "_pos", F.xxhash64(*part).alias("_h1"), F.xxhash64(F.lit("second"), *reversed(part)).alias("_h2"))


def repeats(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """_key and _starts, the sorted starts of its windows that stand earlier somewhere."""
    found = windows(documents, width)
    first = found.groupBy("_h1", "_h2").agg(F.min(F.struct("_key", "_pos")).alias("_first"), F.max(F.struct("_key", "_pos")).alias("_last")).filter(F.col("_first") != F.col("_last"))
    first = materialize(first.select("_h1", "_h2", "_first"), "line-windows")
    later = found.join(first, ["_h1", "_h2"]).filter(F.struct("_key", "_pos") > F.col("_first"))
    return later.groupBy("_key").agg(F.array_sort(F.collect_set("_pos")).alias("_starts"))


def _bit(h: Column) -> tuple[Column, Column]:
    """The part of the bitmap and the place in it for a hash."""
    return F.pmod(F.shiftright(h, 15), F.lit(BITMAP)), F.pmod(h, F.lit(1 << 15))


def dedup_lines(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """``documents`` with repeated lines gone from text, and n_lines and n_removed, which
    replace columns of these names."""
    h, doc, x, starts, part, bits, lines, gone = free_names([*documents.columns, "n_lines", "n_removed"], "_h", "_doc", "_x", "_starts", "_part", "_bits", "_lines", "_gone")
    later = materialize(repeats(documents, width).select(F.col("_key.doc_id").alias(doc), F.col("_key.h").alias(x), F.col("_starts").alias(starts)), "line-repeats")
    at, place = _bit(F.col(x))
    bitmap = materialize(later.groupBy(at.alias(part)).agg(F.bitmap_construct_agg(place).alias(bits)), "line-bitmap")
    at, place = _bit(F.col(h))
    keyed = documents.withColumn(h, F.xxhash64("text")).join(F.broadcast(bitmap), at == F.col(part), "left")
    byte = F.conv(F.hex(F.substr(F.col(bits), (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    may = F.coalesce(F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1, F.lit(False))
    told = keyed.withColumn(part, may).drop(bits)
    some = told.filter(part).join(later, F.col("doc_id").eqNullSafe(F.col(doc)) & (F.col(h) == F.col(x)), "left")
    # For each line whether it goes: starts rise, so each adds the lines up to it, which stay, and its own beyond the one before.
    past = lambda i: F.coalesce(F.get(F.col(starts), i - 1) + width, F.lit(0))
    flags = F.flatten(F.transform(starts, lambda s, i: F.concat(F.array_repeat(F.lit(False), F.greatest(s - past(i), F.lit(0))), F.array_repeat(F.lit(True), F.least(F.lit(width), s + width - past(i))))))
    split = lambda df: df.withColumn(lines, _lines(F.col("text")))
    cut = split(some).withColumn(gone, flags)
    kept = F.when(F.col(gone).isNull(), F.col("text")).otherwise(F.array_join(F.filter(lines, lambda x, i: ~F.coalesce(F.get(F.col(gone), i), F.lit(False))), "\n"))
    own = [c for c in documents.columns if c not in ("n_lines", "n_removed")]

    def out(df: DataFrame, text: Column, removed: Column) -> DataFrame:
        n = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
        return df.select(*[text.alias(c) if c == "text" else F.col(c) for c in own], n.alias("n_lines"), removed.cast("long").alias("n_removed"))

    removed = F.coalesce(F.size(F.filter(gone, lambda g: g)), F.lit(0))
    return out(split(told.filter(~F.col(part))), F.col("text"), F.lit(0)).unionByName(out(cut, kept, F.when(F.col(gone).isNull(), 0).otherwise(removed)))


def digest(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_chars, kept_sha256."""
    return dedup_lines(documents.select("doc_id", "text"), width).select(
        "doc_id", "n_lines", "n_removed", F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE = r"""
with l as (
  select doc_id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents where text is not null
), t as (select doc_id, pos, line, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) as x from l
), w as (
  select doc_id, pos, x as a, lead(x) over d as b, lead(x, 2) over d as c from t window d as (partition by doc_id order by pos)
), r as (
  select doc_id, pos from (select doc_id, pos, row_number() over (partition by a, b, c order by doc_id, pos) as n from w where c is not null and a || b || c <> '') where n > 1
), g as (select distinct doc_id, pos + i as pos from r, (values (0), (1), (2)) v(i)
), k as (
  select t.doc_id, count(*) as n_lines, count(g.pos) as n_removed, coalesce(string_agg(case when g.pos is null then line end, chr(10) order by t.pos), '') as kept
  from t left join g on t.doc_id = g.doc_id and t.pos = g.pos group by t.doc_id
)
select d.doc_id, coalesce(n_lines, 0)::BIGINT as n_lines, coalesce(n_removed, 0)::BIGINT as n_removed,
       length(coalesce(kept, ''))::BIGINT as kept_chars, sha256(coalesce(kept, '')) as kept_sha256
from documents d left join k on d.doc_id = k.doc_id
"""
