"""Evidence of the reads around calls, counted by block of positions: no row for a pair of call and read is made.

What ``evidence`` finds by joins is had here from sorted places: reads that meet a call are those that start before its end less
those that end before its start; deleted positions are sums of steps; the last indel that shows a call is looked for from the
last read backwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from readlake.functions import reads as fn
from readlake.operators.pileup import AT_ONCE, _cigar_signals, _flat, _md_signals

#: Positions of a block, whose reads and calls are one task's; calls that are longer than ``LONG`` are not for it.
BLOCK, LONG = 1 << 14, 1 << 13
#: What a read counts for.
USED, PAIR, GOOD = 1, 2, 4
#: The end of a read without one, which has signals but meets no call.
_NOWHERE = -(1 << 61)
#: Events of a call that are looked at together, from the last one backwards.
_STEP = 64
_RESULT = "own bigint, clips bigint, reads bigint, abnormal double, total bigint, shown boolean, clean bigint, aligned bigint, new_start bigint, new_len bigint"


@lru_cache(1 << 15)
def _reach(text: str) -> int:
    """Positions from a read's start that no event of its text is behind."""
    return sum(map(int, re.findall("[0-9]+", text))) + len(text)


def _reaches(texts: pa.Array) -> np.ndarray:
    d = texts.dictionary_encode()
    return np.array([*map(_reach, d.dictionary.to_pylist()), 0], np.int64)[pc.fill_null(d.indices, -1).to_numpy()]


_signals = lru_cache(1 << 15)(_cigar_signals)


@lru_cache(1 << 15)
def _shapes(text: str) -> list[tuple[int, int, int]]:
    """Of CIGAR text: 0 with the aligned bases; 1 with whether the text begins with a soft clip and the longest one; 2 and 3 with places
    and sizes of deletions and insertions."""
    ops = [(int(n), op) for n, op in re.findall(r"([0-9]+)([MIDNSHP=X])", text)]
    out = [(0, sum(n for n, op in ops if op in "MI=X"), 0)]
    if clips := [n for n, op in ops if op == "S"]:
        out.append((1, int(ops[0][1] == "S"), max(clips)))
    at = 0
    for n, op in ops:
        if op in "DI":
            out.append((2 + (op == "I"), at, n))
        at += n * (op in "MDN=X")
    return out


def _meet(s: np.ndarray, e: np.ndarray, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """How many stretches s to e start before ``past`` and end after ``first``, for each of first to past, first <= past."""
    plain = e >= s
    n = np.searchsorted(np.sort(s[plain]), past, "left") - np.searchsorted(np.sort(e[plain]), first, "right")
    for k in np.flatnonzero(~plain):
        n += (s[k] < past) & (e[k] > first)
    return n


def _above_third(values: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the ``n`` values from each start are above both their 33rd percentile and 1."""
    out = np.zeros(len(start), np.int64)
    order = np.argsort(n, kind="stable")
    cuts = np.flatnonzero(np.diff(n[order])) + 1
    groups = [x for x in np.split(order, cuts) if len(x) and n[x[0]] > 0]
    for own in [x[i : i + max(1, AT_ONCE // n[x[0]])] for x in groups for i in range(0, len(x), max(1, AT_ONCE // n[x[0]]))]:
        size = int(n[own[0]])
        v = values[start[own][:, None] + np.arange(size)]
        place = (size - 1) * 0.33
        low = int(np.floor(place))
        high = min(low + 1, size - 1)
        parts = np.partition(v, sorted({low, high}), axis=1)
        third = parts[:, low] + (parts[:, high] - parts[:, low]) * (place - low)
        out[own] = (v > np.maximum(third, 1.0)[:, None]).sum(axis=1)
    return out


def _last(s, e, at, n, over, first, past, near, far, slop, least) -> np.ndarray:
    """For each call the last of the events (sorted, by reads from s to e) of at least ``least``, with no such event of the same
    read behind it at its place, within ``slop`` of near or far; -1 without."""
    out = np.full(len(first), -1)
    if not len(s):
        return out
    top, low = np.searchsorted(s, past, "left"), np.searchsorted(s, first - (e - s).max(), "right")
    rest = np.flatnonzero(top > low)
    while len(rest):
        todo, rest = rest[: AT_ONCE // _STEP], rest[AT_ONCE // _STEP :]
        i = top[todo][:, None] - 1 - np.arange(_STEP)
        ok = i >= low[todo][:, None]
        i = np.maximum(i, 0)
        c = lambda x: x[todo][:, None]
        ok &= (n[i] >= c(least)) & (over[i] < c(least)) & (e[i] > c(first)) & ((np.abs(at[i] - c(near)) < c(slop)) | (np.abs(at[i] - c(far)) < c(slop)))
        found = ok.any(axis=1)
        out[todo[found]] = i[found, ok.argmax(axis=1)[found]]
        top[todo] -= _STEP
        rest = np.r_[todo[~found & (top[todo] > low[todo])], rest]
    return out


def _numbers(t: pa.Table, name: str, fill=0) -> np.ndarray:
    return pc.fill_null(t[name], fill).to_numpy()


class _Reads:
    """A block's reads in the order of place, name and flag."""

    def __init__(self, t: pa.Table):
        name = pc.rank(t["qname"].combine_chunks(), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
        flag = _numbers(t, "flag", -1)
        order = np.lexsort((flag, name, t["e"].to_numpy(), t["s"].to_numpy()))
        t = t.take(pa.array(order))
        self.name, self.flag = name[order], flag[order]
        self.s, self.e, self.is_ = t["s"].to_numpy(), t["e"].to_numpy(), t["is"].to_numpy()
        self.tlen, self.nm = _numbers(t, "tlen"), t["nm"]
        self.cigar, self.md = t["cigar"].combine_chunks(), t["md"].combine_chunks()


@lru_cache(1 << 15)
def _deleted(text: str) -> list[tuple[int, int, int]]:
    """Deleted bases of MD text as stretches."""
    out: list[tuple[int, int, int]] = []
    for kind, at, _ in _md_signals(text):
        if kind == 1:
            if out and out[-1][1] + out[-1][2] == at:
                out[-1] = (1, out[-1][1], out[-1][2] + 1)
            else:
                out.append((1, at, 1))
    return out


def _raw(r: _Reads, first: int, width: int, start, end, gone, pad: int):
    """Positions of calls whose deletions (``gone``) or insertions, and whose clips, stand out; reads near them."""
    used = np.flatnonzero(r.is_ & USED)
    s, rows = r.s[used], pa.array(used)
    row, kind, offset, size = _flat(r.cigar.take(rows), _signals).T
    at = s[row] + offset - first
    ok = (at >= 0) & (at < width)
    kind, at, size = kind[ok], at[ok], size[ok]
    row, _, offset, n = _flat(r.md.take(rows), _deleted).T
    a = s[row] + offset - first
    step = np.bincount(np.clip(a, 0, width), minlength=width + 1) - np.bincount(np.clip(a + n, 0, width), minlength=width + 1)
    inside = lambda k, w=None: np.bincount(at[kind == k], w, width)
    many = inside(3)
    own = {True: np.cumsum(step[:width]).astype(float), False: inside(3, size[kind == 3]) / np.maximum(many, 1)}
    n = np.maximum(end - start, 0)
    count = np.zeros(len(start), np.int64)
    for k, v in own.items():
        of = gone == k
        count[of] = _above_third(v, start[of] - first, n[of])
    return count, _above_third(inside(2).astype(float), start - first, n), _meet(s, r.e[used], start - pad, end + pad)


def _pairs(r: _Reads, start, end, high, low, pad: int):
    """First reads of each name that meet a call: with too large, too small and any inserts."""
    own = np.flatnonzero(r.is_ & PAIR)
    own = own[np.lexsort((r.tlen[own], r.e[own], r.s[own], r.name[own]))]
    s, e, name, size = r.s[own], r.e[own], r.name[own], np.abs(r.tlen[own])
    first, past = start - pad, end + pad
    new = np.r_[True, name[1:] != name[:-1]] if len(own) else np.zeros(0, bool)
    # Of a later read those calls don't count that meet one before it, that is end after the call's start: it starts no later.
    later = np.flatnonzero(~new)
    reach = e.copy()
    for k in later:
        reach[k] = max(reach[k], reach[k - 1])
    both = np.minimum(reach[later - 1], e[later])
    out = []
    for of in (size > high, size < low, np.ones(len(own), bool)):
        out.append(_meet(s[of], e[of], first, past) - _meet(s[later][of[later]], both[of[later]], first, past))
    return out


def _aligned(r: _Reads, start, end, svtype, read_len, pad: int):
    """Whether alignments show a call, how many clean ones span it (where none shows it), how many there are, and the last indel that shows it."""
    own = np.flatnonzero(r.is_ & GOOD)
    s, e, text = r.s[own], r.e[own], r.cigar.take(pa.array(own))
    first, past, size = start - pad, end + pad, end - start
    least = np.maximum(np.maximum(8, np.floor(size * 0.025)), np.floor(read_len * 0.06))
    slop = np.maximum(300, np.floor(size * 0.20))
    row, kind, x, y = _flat(text, _shapes).T
    shown, place, length = np.zeros(len(start), bool), np.full(len(start), -1), np.full(len(start), -1)
    for op, what in ((2, "DEL"), (3, "INS")):
        of, c = kind == op, np.flatnonzero(svtype == what)
        i, at, n = row[of], s[row[of]] + x[of], y[of]
        # Of indels at one place of one read a later one that is large enough comes first.
        over = np.zeros(len(i), np.int64)
        for k in np.flatnonzero((i[1:] == i[:-1]) & (at[1:] == at[:-1]))[::-1]:
            over[k] = max(over[k + 1], n[k + 1])
        new = np.r_[True, (np.diff(s) != 0) | (np.diff(e) != 0) | (np.diff(r.name[own]) != 0) | (np.diff(r.flag[own]) != 0)] if len(own) else np.zeros(0, bool)
        order = np.lexsort((n, at, np.cumsum(new)[i]))
        i, at, n, over = i[order], at[order], n[order], over[order]
        found = _last(s[i], e[i], at, n, over, first[c], past[c], start[c], (end if op == 2 else start)[c], slop[c], least[c])
        c, found = c[found >= 0], found[found >= 0]
        shown[c], place[c], length[c] = True, at[found], n[found]
    c, of = np.flatnonzero(~shown), kind == 1
    i, n = row[of], y[of]
    found = _last(s[i], e[i], np.where(x[of] == 1, s[i], e[i]), n, np.zeros(len(i), np.int64), first[c], past[c], start[c], end[c], slop[c], least[c])
    shown[c[found >= 0]] = True
    of = kind == 0
    i, nm = row[of], r.nm.take(pa.array(own[row[of]]))
    i = i[pc.fill_null(pc.less_equal(pc.cast(nm, pa.float64()), pa.array(x[of] * 0.095)), False).to_numpy()]
    cs, ce, clean = s[i], e[i], np.zeros(len(start), np.int64)
    wide = (ce - cs).max() if len(i) else 0
    for k, a, z in zip(np.flatnonzero(~shown), np.searchsorted(cs, end[~shown] - wide, "left"), np.searchsorted(cs, start[~shown], "left"), strict=True):
        clean[k] = np.count_nonzero(ce[a:z] > end[k])
    return shown, clean, _meet(s, e, first, past), place, length


def evidence(calls: DataFrame, reads: DataFrame, library: DataFrame, pads: tuple[int, int, int], least: int, reach: float, most: int) -> DataFrame:
    """``calls`` (with ends not before their starts, at most ``most`` long) with what their reads tell: own, clips and reads (raw support), abnormal
    and total (pairs), shown, clean, aligned, new_start, new_len (alignments).

    ``pads`` are those of raw support, pairs and alignments; ``least`` the mapping quality of the latter two. A read is dealt to the blocks
    where calls begin that it can tell about; a task holds a block's reads."""
    raw_pad, pair_pad, near_pad = pads
    pad, width = max(pads), BLOCK + most
    kinds = dict(calls.dtypes)
    at = calls.withColumns({"_block": F.floor(F.col("start_pos") / BLOCK), "start_pos": F.col("start_pos").cast("long"), "end_pos": F.col("end_pos").cast("long")}).crossJoin(F.broadcast(library))
    of = lambda b, c: F.when(c, b).otherwise(0)
    is_ = of(USED, fn.mapped("flag") & ~fn.bit("flag", 1024) & (F.length("cigar") > 0)) + of(PAIR, fn.usable_pair("flag", "mapq", "tlen", "ref_start", "mate_start", least)) + of(GOOD, F.col("mapq") >= least)
    own = reads.filter("contig is not null and ref_start is not null").select(
        "contig", F.col("ref_start").cast("long").alias("s"), F.coalesce(F.col("ref_end").cast("long"), F.lit(_NOWHERE)).alias("e"), "qname", *[F.col(c).cast("long").alias(c) for c in ("flag", "tlen", "nm")], is_.cast("long").alias("is"), "cigar", "md")
    schema = ", ".join(f"`{c}` {t}" for c, t in own.dtypes)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(b["is"].to_numpy() > 0))
            s, e, used = b["s"].to_numpy(), b["e"].to_numpy(), b["is"].to_numpy() & USED > 0
            past = np.maximum(np.maximum(s, e), s + np.where(used, np.maximum(_reaches(b["cigar"]), _reaches(b["md"])), 0))
            first = (np.where(e == _NOWHERE, s, np.minimum(s, e)) - pad - most) // BLOCK
            n = (past + pad) // BLOCK - first + 1
            # MD text tells of deleted bases here.
            md = pc.if_else(pc.and_(pa.array(used), pc.match_substring(b["md"], "^")), b["md"], pa.scalar(None, b["md"].type))
            b = b.set_column(b.schema.get_field_index("md"), "md", md)
            row, block = np.repeat(np.arange(len(n)), n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield b.take(pa.array(row)).append_column("_block", pa.array(block))

    dealt = own.mapInArrow(deal, f"{schema}, _block bigint")
    kept = calls.columns

    def one(c: pa.Table, t: pa.Table) -> pa.Table:
        n, known = len(c), np.flatnonzero((c["start_pos"].is_valid().to_numpy()) & c["end_pos"].is_valid().to_numpy() & c["contig"].is_valid().to_numpy())
        out = [np.zeros(n, np.int64) for _ in range(9)]
        abnormal = np.zeros(n)
        out[7:] = np.full(n, -1), np.full(n, -1)
        if len(known) and len(t):
            own = c.take(pa.array(known))
            start, end, svtype = own["start_pos"].to_numpy(), own["end_pos"].to_numpy(), np.array(own["svtype"].to_pylist(), object)
            r = _Reads(t)
            mean, sd, length = (own[x][0].as_py() for x in ("insert_mean", "insert_sd", "read_len"))
            first = int(start.min()) // BLOCK * BLOCK
            got = _raw(r, first, width, start, end, svtype == "DEL", raw_pad)
            high, low, total = _pairs(r, start, end, mean + reach * sd, mean - reach * sd, pair_pad)
            abnormal[known] = (np.where(svtype == "DEL", 10, 8) * high + np.where(svtype == "INS", 10, 8) * low) / 10
            shown, clean, aligned, place, size = _aligned(r, start, end, svtype, length if length is not None else 0.0, near_pad)
            for k, v in enumerate([*got, total, shown, clean, aligned, place, size]):
                out[k][known] = v
        cols = [*[pa.array(x) for x in out[:3]], pa.array(abnormal), pa.array(out[3]), pa.array(out[4] > 0), pa.array(out[5]), pa.array(out[6]), pa.array(out[7], mask=out[8] < 0), pa.array(out[8], mask=out[8] < 0)]
        names = [x.split()[0] for x in _RESULT.split(", ")]
        return pa.table([*[c[x] for x in kept], *cols], names=[*kept, *names])

    out = ", ".join(f"`{c}` {'bigint' if c in ('start_pos', 'end_pos') else kinds[c]}" for c in kept) + ", " + _RESULT
    return at.groupBy("contig", "_block").cogroup(dealt.groupBy("contig", "_block")).applyInArrow(one, out)
