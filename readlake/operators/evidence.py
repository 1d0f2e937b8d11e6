"""Evidence of aligned reads for structural calls: raw support, read pairs, alignments, deletion lengths.

``calls`` have call_id, contig, start_pos, end_pos, svtype (DEL or INS); ``reads`` have contig, qname, flag,
ref_start, ref_end, mapq, tlen, mate_contig, mate_start, cigar, md, nm, query_len. Reads meet calls in the binned
overlap join, so a call costs its neighbourhood only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from readlake.functions import reads as fn
from readlake.operators import decide, intervals as iv, neighbourhood, pileup, stats

# How far around a call reads are looked at, and the least mapping quality.
RAW_PAD, PAIR_PAD, LENGTH_PAD = 370, 670, 200
PAIR_MAPQ, LENGTH_MAPQ = 9, 20
#: Radii around a deletion, looked at one after the other until there are ``ENOUGH`` lengths.
RADII, ENOUGH = (100, 500, 1000), 5


def _near(calls: DataFrame, reads: DataFrame, pad: int) -> DataFrame:
    """Calls with reads within ``pad``; columns of reads get the suffix _b."""
    return iv.overlap_join(calls, reads.withColumnsRenamed({"ref_start": "start_pos", "ref_end": "end_pos"}), pad=pad)


def library_stats(reads: DataFrame) -> DataFrame:
    """One row: insert mean and deviation (mapped pairs of 50 to 6,000 bases) and read length; fixed values under 100 pairs."""
    own = reads.filter(fn.mapped("flag") & ~fn.bit("flag", 1024))
    pair = fn.bit("flag", 1) & ~fn.bit("flag", 8) & (F.abs("tlen") > 50) & (F.abs("tlen") < 6000)
    size = F.when(pair, F.abs("tlen"))
    g = own.agg(F.count(size).alias("n"), F.avg(size).alias("m"), F.stddev_pop(size).alias("s"), F.avg("query_len").alias("l"))
    few = F.col("n") < 100
    return g.select(F.when(few, 557.0).otherwise(F.col("m")).alias("insert_mean"), F.when(few, 154.6).otherwise(F.col("s")).alias("insert_sd"), F.when(few, 148.0).otherwise(F.col("l")).alias("read_len"))


def _above_third(values: Column, n: Column) -> Column:
    """How many of ``n`` values (those of ``values``, sorted, and zeros before them) are above both their 33rd
    percentile and 1."""
    zeros, place = n - F.size(values), (n - 1) * 0.33
    low = F.floor(place)
    at = lambda i: F.when(i < zeros, 0.0).otherwise(F.coalesce(F.get(values, (i - zeros).cast("int")), F.lit(0.0)))
    third = at(low) + (at(F.least(low + 1, n - 1)) - at(low)) * (place - low)
    return F.size(F.filter(values, lambda v: v > F.greatest(third, F.lit(1.0))))


def raw_support(calls: DataFrame, reads: DataFrame) -> DataFrame:
    """call_id, support (positions of the call with a signal that stands out, weighted) and reads near it.

    Every read counts once and the clip channel is that of clips; the known rule reads one read many times
    and takes the longest deletion for clips."""
    used = reads.filter(fn.mapped("flag") & ~fn.bit("flag", 1024) & (F.length("cigar") > 0))
    events = pileup.signals(used.select("contig", "ref_start", "ref_end", "cigar", "md"))
    kind = lambda k: F.col("kind") == k
    sites = events.groupBy("contig", "pos").agg(F.count_if(kind("B")).cast("double").alias("gone"), F.count_if(kind("C")).cast("double").alias("clips"), F.coalesce(F.avg(F.when(kind("I"), F.col("size"))), F.lit(0.0)).alias("more"))
    points = sites.select("contig", F.col("pos").alias("start_pos"), (F.col("pos") + 1).alias("end_pos"), "gone", "clips", "more")
    values = lambda c: F.sort_array(F.collect_list(F.when(F.col(c) > 0, F.col(c)))).alias(c)
    own = iv.overlap_join(calls, points).withColumn("value", F.when(F.col("svtype") == "DEL", F.col("gone_b")).otherwise(F.col("more_b")))
    held = own.groupBy("call_id").agg(values("value"), values("clips_b"))
    count = _near(calls, used.select("contig", "ref_start", "ref_end"), RAW_PAD).groupBy("call_id").agg(F.count("*").alias("reads"))
    n = F.col("end_pos") - F.col("start_pos")
    out = calls.join(held, "call_id", "left").join(count, "call_id", "left").withColumn("own", _above_third(F.col("value"), n)).withColumn("clips", _above_third(F.col("clips_b"), n))
    zero = lambda c: F.when(F.col("value").isNull(), 0).otherwise(F.col(c))
    return out.withColumn("own", zero("own")).withColumn("clips", zero("clips")).select("call_id", decide.weighted("own", "clips").alias("support"), F.coalesce("reads", F.lit(0)).cast("long").alias("reads"))


def pair_support(calls: DataFrame, reads: DataFrame, reach: float = 1.95) -> DataFrame:
    """call_id, abnormal (pairs whose insert is off by ``reach`` deviations, weighted by what the call is) and total."""
    used = reads.filter(fn.usable_pair("flag", "mapq", "tlen", "ref_start", "mate_start", PAIR_MAPQ)).select("contig", "ref_start", "ref_end", "qname", "tlen")
    first = _near(calls, used, PAIR_PAD).groupBy("call_id", "svtype", "qname_b").agg(F.min(F.struct("start_pos_b", "end_pos_b", "tlen_b")).alias("first"))
    size, lib = F.abs("first.tlen_b"), library_stats(reads)
    weigh = lambda kind: F.when(F.col("svtype") == kind, 1.0).otherwise(0.8)
    high, low = F.col("insert_mean") + reach * F.col("insert_sd"), F.col("insert_mean") - reach * F.col("insert_sd")
    weight = F.when(size > high, weigh("DEL")).when(size < low, weigh("INS")).otherwise(0.0)
    found = first.crossJoin(F.broadcast(lib)).groupBy("call_id").agg(F.sum(weight).alias("abnormal"), F.count("*").alias("total"))
    return calls.select("call_id").join(found, "call_id", "left").select("call_id", F.coalesce("abnormal", F.lit(0.0)).alias("abnormal"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def assembly(calls: DataFrame, reads: DataFrame) -> DataFrame:
    """call_id, status (VERIFIED, REF, AMBIGUOUS) and new_start, new_len of the last indel that shows the call."""
    near = _near(calls, reads.filter(F.col("mapq") >= PAIR_MAPQ).select("contig", "ref_start", "ref_end", "qname", "flag", "cigar", "nm"), RAW_PAD).crossJoin(F.broadcast(library_stats(reads).select("read_len")))
    size = F.col("end_pos") - F.col("start_pos")
    least = F.greatest(F.lit(8), F.floor(size * 0.025), F.floor(F.col("read_len") * 0.06))
    slop = F.greatest(F.lit(300), F.floor(size * 0.20))
    near = near.withColumns({"least": least, "slop": slop, "walk": fn.cigar_walk("cigar_b", F.col("start_pos_b"))})
    by = lambda p, c: F.abs(p - F.col(c)) < F.col("slop")
    clip_at = F.when(F.get("walk", F.lit(0))["op"] == "S", F.col("start_pos_b")).otherwise(F.col("end_pos_b"))
    shows = lambda s: (s["n"] >= F.col("least")) & (
        ((F.col("svtype") == "DEL") & (s["op"] == "D") & (by(s["ref_pos"], "start_pos") | by(s["ref_pos"], "end_pos"))) | ((F.col("svtype") == "INS") & (s["op"] == "I") & by(s["ref_pos"], "start_pos"))
        | ((s["op"] == "S") & (by(clip_at, "start_pos") | by(clip_at, "end_pos"))))
    near = near.withColumn("hits", F.filter("walk", shows))
    indel = F.element_at(F.filter("hits", lambda s: s["op"] != "S"), -1)
    aligned = F.aggregate(F.filter("walk", lambda s: s["op"].isin(*"MI=X")), F.lit(0).cast("long"), lambda a, s: a + s["n"])
    clean = (F.size("hits") == 0) & (F.col("nm_b") <= aligned * 0.095) & (F.col("start_pos_b") < F.col("start_pos")) & (F.col("end_pos_b") > F.col("end_pos"))
    last = F.max(F.when(F.exists("hits", lambda s: s["op"] != "S"), F.struct("start_pos_b", "end_pos_b", "qname_b", "flag_b", indel["ref_pos"].alias("at"), indel["n"].alias("n"))))
    found = near.groupBy("call_id").agg(F.bool_or(F.size("hits") > 0).alias("shown"), F.count_if(clean).alias("clean"), F.count("*").alias("total"), last.alias("last"))
    status = F.when(F.col("shown"), "VERIFIED").when(F.col("clean") / F.col("total") > 0.35, "REF").otherwise("AMBIGUOUS")
    return calls.select("call_id").join(found, "call_id", "left").select("call_id", status.alias("status"), F.col("last.at").alias("new_start"), F.col("last.n").alias("new_len"))


def together(calls: DataFrame, reads: DataFrame) -> DataFrame:
    """``calls`` with the columns of ``raw_support``, ``pair_support`` and ``assembly``, from one walk over the blocks of positions.

    Calls that are too long for a block, or end before they start, take the joins."""
    size = F.col("end_pos") - F.col("start_pos")
    odd = F.coalesce((size < 0) | (size > neighbourhood.LONG), F.lit(False))
    calls = calls.filter("call_id is not null").select("call_id", "contig", "start_pos", "end_pos", "svtype")
    known = calls.agg(F.max(F.when(~odd, size)).alias("most"), F.count_if(odd).alias("odd")).first()
    every = neighbourhood.evidence(calls.filter(~odd), reads, library_stats(reads), (RAW_PAD, PAIR_PAD, RAW_PAD), PAIR_MAPQ, 1.95, known.most or 0)
    status = F.when(F.col("shown"), "VERIFIED").when(F.try_divide("clean", "aligned") > 0.35, "REF").otherwise("AMBIGUOUS")
    every = every.select(*calls.columns, decide.weighted("own", "clips").alias("support"), "reads", "abnormal", "total", status.alias("status"), "new_start", "new_len")
    if known.odd:
        own = calls.filter(odd)
        every = every.unionByName(own.join(raw_support(own, reads), "call_id").join(pair_support(own, reads), "call_id").join(assembly(own, reads), "call_id"))
    return every


def validate(calls: DataFrame, reads: DataFrame) -> DataFrame:
    """call_id, keep, start_pos, end_pos: the verdict of all three kinds of evidence, and the refined interval of kept calls."""
    every = together(calls, reads)
    keep = decide.verdict(*[F.col(c) for c in ("status", "support", "reads", "abnormal", "total")])
    at = decide.refined(F.col("start_pos"), F.col("end_pos"), F.col("new_start"), F.col("new_start") + F.col("new_len"))
    moved = F.when(keep & (F.col("status") == "VERIFIED"), at).otherwise(F.struct("start_pos", "end_pos"))
    return every.select("call_id", keep.alias("keep"), moved.alias("at")).select("call_id", "keep", "at.start_pos", "at.end_pos")


def pair_length(calls: DataFrame, reads: DataFrame, reach: float = 3.0, least: int = 3) -> DataFrame:
    """call_id, dp: deletion length from read pairs with too large an insert, where there are ``least`` of them."""
    lib = robust_insert(reads)
    ok = fn.mapped("flag") & ~fn.bit("flag", 1024) & (F.col("mapq") >= LENGTH_MAPQ)
    # The test is a column here too, and rows without it go in Arrow batches.
    cut = lambda batches: (b.filter(b["tlen"].is_valid()) for b in batches)
    used = reads.select("contig", "ref_start", "ref_end", F.when(ok, F.col("tlen")).alias("tlen"))
    used = used.mapInArrow(cut, used.schema)
    at = calls.filter("svtype = 'DEL'").withColumn("end_pos", F.col("start_pos"))
    more = F.abs("tlen") - F.col("mid")
    large = used.crossJoin(F.broadcast(lib)).filter((F.abs("tlen") > F.col("mid") + reach * F.col("sd")) & (more > 50) & (more < 100_000))
    found = _near(at, large.select("contig", "ref_start", "ref_end", more.alias("more")), LENGTH_PAD)
    return found.groupBy("call_id").agg(F.median("more_b").alias("m"), F.count("*").alias("n")).filter(F.col("n") >= least).select("call_id", F.floor("m").cast("long").alias("dp"))


def robust_insert(reads: DataFrame, most: int = 50_000) -> DataFrame:
    """Median and deviation of inserts under 2,000 of the first ``most`` well-mapped proper pairs, by place."""
    own = reads.filter(fn.bit("flag", 2) & (F.col("mapq") > 20) & (F.abs("tlen") < 2000)).select(F.abs("tlen").alias("size"), "contig", "ref_start", "qname", "flag")
    return own.orderBy("contig", "ref_start", "qname", "flag", "size").limit(most).agg(F.median("size").alias("mid"), F.stddev_pop("size").alias("sd"))


def staged(stages: list[Column], enough: int = ENOUGH) -> Column:
    """Lists of widening radii joined until there are ``enough`` members; inner ones are counted again by each wider one."""
    out = stages[0]
    for wider in stages[1:]:
        out = F.when(F.size(out) >= enough, out).otherwise(F.concat(out, wider))
    return out


def staged_count(counts: list[Column], radii: tuple[int, ...] = RADII, enough: int = ENOUGH) -> tuple[Column, Column]:
    """``staged`` for counts only: their number and the last radius that was looked at."""
    n, radius = counts[0], F.lit(radii[0])
    for wider, r in zip(counts[1:], radii[1:], strict=True):
        n, radius = F.when(n >= enough, n).otherwise(n + wider), F.when(n >= enough, radius).otherwise(r)
    return n, radius


#: Longest target of a clip, and positions whose anchors one task aligns.
TARGET, STRETCH = 50_000, 1 << 16


@lru_cache(1 << 15)
def _side(text: str) -> int:
    """1 if CIGAR text ends with a clip, 2 if it begins with one, else 0."""
    ops = re.findall(r"([0-9]+)([MIDNSHP=X])", text)
    clip = lambda x: x[1] == "S" and int(x[0]) >= 5
    return 0 if not ops else 1 if clip(ops[-1]) else 2 if clip(ops[0]) else 0


def _targets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Clipped reads with where their clips are looked for: past a right clip up to its mate, before a left one from its mate on."""
    for b in batches:
        b = b.filter(pc.and_(pc.and_(b["cigar"].is_valid(), b["contig"].is_valid()), pc.and_(b["ref_start"].is_valid(), b["ref_end"].is_valid())))
        d = b["cigar"].dictionary_encode()
        side = np.array([*map(_side, d.dictionary.to_pylist()), 0])[pc.fill_null(d.indices, -1).to_numpy()]
        start, end, mate, right = b["ref_start"].to_numpy(), b["ref_end"].to_numpy(), pc.fill_null(b["mate_start"], -(1 << 40)).to_numpy(), side == 1
        anchor = np.where(right, end, start)
        first = np.where(right, anchor, np.maximum(mate - 100, 0))
        past = np.where(right, mate + pc.fill_null(b["query_len"], 1 << 40).to_numpy() + 100, anchor)
        # Of a target that is too long its first part is looked at.
        past = np.minimum(past, first + TARGET)
        kept = np.flatnonzero((side > 0) & ~(right & (mate < anchor)) & (past > first))
        rows = b.select(["contig", "ref_start", "ref_end", "clip"]).take(pa.array(kept))
        more = [pa.array(np.where(right, "right", "left")[kept].tolist(), pa.string()), *[pa.array(x[kept]) for x in (anchor, first, past)]]
        yield pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, "side", "anchor", "first", "past"])


def _sizes(targets: DataFrame, chunks: DataFrame, width: int, shortest: int) -> DataFrame:
    """contig, ref_start, ref_end, side, anchor, size: how far from their anchors clips go on, if over ``shortest``.

    Targets meet the reference by stretches of positions; a task holds a stretch's text and what of its neighbours targets reach."""
    from readlake.operators import sequential

    lo, hi = F.col("chunk_id") * width, (F.col("chunk_id") + 1) * width
    blocks = F.sequence(F.floor(lo / STRETCH), F.floor((hi - 1) / STRETCH))
    text = chunks.filter("seq is not null").select("contig", F.explode(blocks).alias("_block"), F.col("chunk_id").cast("long").alias("chunk_id"), "seq")
    # A target lies in the stretch where it begins and in the next one.
    text = text.withColumn("_block", F.explode(F.array(F.col("_block") - 1, F.col("_block"))))
    out = ["contig", "ref_start", "ref_end", "side", "anchor"]

    def one(t: pa.Table, c: pa.Table) -> pa.Table:
        size = np.zeros(len(t), np.int64)
        if len(t):
            base = int(t["first"][0].as_py()) // STRETCH * STRETCH
            codes = np.full(2 * STRETCH + 2 * width, ord("n"), np.int64)
            for k, x in zip(c["chunk_id"].to_pylist(), c["seq"].to_pylist(), strict=True):
                a = k * width - base + width
                codes[a : a + width] = np.frombuffer(x[:width].ljust(width, "n").lower()[:width].encode("utf-32-le", "surrogatepass"), np.uint32)
            first, past, anchor = (t[x].to_numpy() for x in ("first", "past", "anchor"))
            score, start, end = sequential.alignments_in(codes, first - base + width, past - base + width, t["clip"].to_pylist()).T
            right = pc.equal(t["side"], "right").to_numpy()
            size = np.where(score > 0, np.where(right, first + start - anchor, anchor - first - end), 0)
        kept = np.flatnonzero((size > shortest) & (score > 0)) if len(t) else np.zeros(0, np.int64)
        return t.select(out).take(pa.array(kept)).append_column("size", pa.array(size[kept]))

    own = targets.withColumn("_block", F.floor(F.col("first") / STRETCH)).select("_block", *out, "first", "past", "clip")
    return own.groupBy("contig", "_block").cogroup(text.groupBy("contig", "_block")).applyInArrow(one, "contig string, ref_start bigint, ref_end bigint, side string, anchor bigint, size bigint")


def split_lengths(calls: DataFrame, reads: DataFrame, chunks: DataFrame, width: int, shortest: int = 30) -> DataFrame:
    """call_id, sr: deletion length from clipped ends aligned where their mates bound the other breakpoint.

    ``reads`` have ``clip_seq`` too. Radii widen until there are enough lengths; their consensus is the median
    of the largest cluster of lengths within 3 of each other."""
    near = RADII[-1]
    ok = fn.usable_split("flag", "mapq", "contig", "mate_contig", LENGTH_MAPQ)
    # The test is a column, as filters would write the reads' columns out again for each of its parts.
    used = reads.select("contig", *[F.when(ok, F.col(c)).cast("long").alias(c) for c in ("ref_start", "ref_end", "mate_start", "query_len")], F.when(ok, F.coalesce(F.lower("clip_seq"), F.lit(""))).alias("clip"), F.when(ok, F.col("cigar")).alias("cigar"))
    at = calls.filter("svtype = 'DEL'").select("call_id", "contig", "start_pos")
    bins = F.sequence(F.floor((F.col("start_pos") - near) / iv.BIN), F.floor((F.col("start_pos") + near) / iv.BIN))
    at = at.withColumn("_bin", F.explode(bins))
    # What counts for a call has its anchor within the largest radius; a read is aligned once, for all of them.
    targets = used.mapInArrow(_targets, "contig string, ref_start bigint, ref_end bigint, clip string, side string, anchor bigint, first bigint, past bigint").withColumn("_bin", F.floor(F.col("anchor") / iv.BIN))
    sized = _sizes(targets.join(at.select("contig", "_bin").distinct(), ["contig", "_bin"], "left_semi"), chunks, width, shortest).withColumn("_bin", F.floor(F.col("anchor") / iv.BIN))
    sized = at.join(sized, ["contig", "_bin"]).filter((F.col("side") == "right") | (F.col("anchor") >= F.col("start_pos")))
    inside = lambda r: (F.col("start_pos") - r < F.col("ref_end")) & (F.col("start_pos") + r > F.col("ref_start")) & ((F.col("side") == "left") | (F.abs(F.col("anchor") - F.col("start_pos")) < r))
    lists = sized.groupBy("call_id").agg(*[F.collect_list(F.when(inside(r), F.col("size"))).alias(f"r{r}") for r in RADII])
    every = lists.select("call_id", F.explode(staged([F.col(f"r{r}") for r in RADII])).alias("size"))
    return stats.largest_cluster(every, ["call_id"], "size").select("call_id", F.floor("mid").cast("long").alias("sr"))
