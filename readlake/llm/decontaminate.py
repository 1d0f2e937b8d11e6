"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

Texts are lower-cased (A-Z) and cut into words of letters, digits and non-ASCII
characters. Every window of ``window`` consecutive words of a benchmark item is hashed;
the sorted hashes go to all executors, which scan the windows of the training texts,
verify each hash hit word by word, and mark the words that a hit covers.

Defined results: null or empty text has no words and no hits. An item with fewer words
than ``window`` is one shorter window; one without words has none. Repeated items count
by their item_id, once; windows of a null item_id mark words but name no item. Repeated
documents are each judged alone, columns beyond doc_id and text are kept as they are, and
an empty benchmark hits nothing.

The broadcast is bounded: the benchmark is measured first, and beyond ``limit`` bytes of
text it is scanned in blocks of about that size (a stated query set against all rows). Blocks
are read, broadcast and scanned one after the other, each leaves only the marks of hit
documents, and merged marks are joined back by doc_id and a hash of the text, so rows that
repeat both have the same marks. A block takes the driver and each Python worker about eight
times its text: hashes, items and word places as arrays beside the words themselves.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from readlake.llm import bytewise
from readlake.llm.common import broadcast_if_small, discard, free_names, map_batches, materialize

#: Words of a window.
WINDOW = 10
#: Benchmark text bytes that are broadcast at once.
LIMIT = 8 << 20


class WindowSet:
    """Distinct windows of a block's items by their length in words: sorted hashes, the first word of
    each in one buffer of all items' words, and its items."""

    def __init__(self, items: pa.Table, window: int):
        """``items``: item_id and text."""
        self.ids = pa.array(pc.cast(items.column("item_id"), pa.string()).to_pylist(), pa.string())
        text = items.column("text").cast(pa.large_string()).combine_chunks()
        bufs, starts, ends, hashes, counts, past = [], [], [], [], [], 0
        for w in bytewise.scan(text, bytewise.ALNUM) if items.num_rows else ():
            bufs.append(w.buf)
            starts.append(w.start + past)
            ends.append(w.end + past)
            hashes.append(w.hashes())
            counts.append(w.counts)
            past += len(w.buf)
        cat = lambda xs, kind: np.concatenate(xs) if xs else np.empty(0, kind)
        self.buf, self.start, self.end, count = cat(bufs, np.uint8), cat(starts, np.int64), cat(ends, np.int64), cat(counts, np.int64)
        h, ptr, k_of = cat(hashes, np.uint64), np.cumsum(count) - count, np.minimum(count, window)
        self.by_size: dict[int, tuple[np.ndarray, ...]] = {}
        for k in np.unique(k_of[k_of > 0]).tolist():
            rows = np.flatnonzero(k_of == k)
            many = count[rows] - k + 1
            at = np.repeat(ptr[rows], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            g = bytewise.gram_hash(h, at, k)
            order = np.argsort(g, kind="stable")
            g, at, item = g[order], at[order], np.repeat(rows, many)[order]
            new = np.ones(len(g), bool)
            for i in (np.flatnonzero(g[1:] == g[:-1]) + 1).tolist():
                new[i] = self._text(int(at[i]), k) != self._text(int(at[i - 1]), k)
            first = np.flatnonzero(new)
            self.by_size[k] = (g[first], at[first], np.append(first, len(g)), item)

    def _text(self, at: int, k: int) -> list[bytes]:
        return [self.buf[self.start[j] : self.end[j]].tobytes() for j in range(at, at + k)]

    def hits(self, w: bytewise.Words):
        """(row, first word, words, item rows) of each verified window of a chunk."""
        h = w.hashes()
        row = w.rows()
        for k, (hashes, places, bounds, items) in self.by_size.items():
            g, at = w.grams(h, k)
            if not len(g):
                continue
            left = np.searchsorted(hashes, g)
            found = np.flatnonzero((left < len(hashes)) & (hashes[np.minimum(left, len(hashes) - 1)] == g))
            for x in found.tolist():
                i, first = int(left[x]), int(at[x])
                words = [w.text(j) for j in range(first, first + k)]
                while i < len(hashes) and hashes[i] == g[x]:
                    if self._text(int(places[i]), k) == words:
                        yield int(row[first]), first, k, items[bounds[i] : bounds[i + 1]]
                    i += 1


def _block(benchmark: DataFrame, part: int, count: int) -> pa.Table:
    """One of ``count`` parts of the items."""
    own = benchmark.select("item_id", "text")
    return (own if count == 1 else own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == part)).toArrow()


def _count(benchmark: DataFrame, limit: int) -> int:
    total = benchmark.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"))).first()[0] or 0
    return max(1, -(-total // limit))


def mark(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = LIMIT, names: tuple[str, str, str] = ("_n_words", "_spans", "_items")) -> DataFrame:
    """``documents`` with the number of words, hit spans (flat [first, past) word bounds, merged) and
    the distinct item ids, sorted as strings, under ``names``."""
    spark, count = documents.sparkSession, _count(benchmark, limit)
    n_words, spans, items = names
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema) + f", `{n_words}` bigint"
    if count == 1:
        shared = spark.sparkContext.broadcast(WindowSet(_block(benchmark, 0, 1), window))
        return map_batches(documents, lambda batch: _mark(batch, shared.value, names), f"{schema}, `{spans}` array<bigint>, `{items}` array<string>", 2000)
    narrow = documents.select("doc_id", "text", F.xxhash64("text").alias("h"))
    kinds = f"doc_id {dict(documents.dtypes)['doc_id']}, h bigint, spans array<bigint>, items array<string>"
    found: list[DataFrame] = []
    for part in range(count):
        shared = spark.sparkContext.broadcast(WindowSet(_block(benchmark, part, count), window))

        def hit(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            out = _mark(batch, shared.value, ("n", "spans", "items"))
            return out.filter(pc.greater(pc.list_value_length(out.column("spans")), 0)).select(["doc_id", "h", "spans", "items"])

        found.append(materialize(map_batches(narrow, hit, kinds, 2000), "block-hits"))
        shared.destroy()
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    d, h, x, s, i = free_names([*documents.columns, *names], "_d", "_h", "_x", "_s", "_i")
    merged_ = every.groupBy(F.col("doc_id").alias(d), F.col("h").alias(h)).agg(F.flatten(F.collect_set("spans")).alias(s), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias(i))
    merged_ = materialize(merged_, "document-hits")
    discard(*found)
    size = F.col("_bytes")
    small = (merged_.select((F.size(s) * 8 + F.size(i) * 24 + 32).alias("_bytes")).agg(F.sum(size)).first()[0] or 0) <= limit
    counted = map_batches(documents, lambda batch: _words(batch, n_words), schema, 2000).withColumn(x, F.xxhash64("text"))
    joined = counted.join(F.broadcast(merged_) if small else merged_, F.col("doc_id").eqNullSafe(F.col(d)) & (F.col(x) == F.col(h)), "left")
    return joined.select(*documents.columns, n_words, F.coalesce(s, F.array().cast("array<bigint>")).alias(spans), F.coalesce(i, F.array().cast("array<string>")).alias(items))


def _words(batch: pa.RecordBatch, name: str) -> pa.RecordBatch:
    counts = [w.counts for w in bytewise.scan(batch.column("text"), bytewise.ALNUM)]
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(counts), pa.int64())], names=[*batch.schema.names, name])


def _mark(batch: pa.RecordBatch, windows: WindowSet, names: tuple[str, str, str]) -> pa.RecordBatch:
    counts, ptr, spans, iptr, items = [], [0], [], [0], []
    for w in bytewise.scan(batch.column("text"), bytewise.ALNUM):
        found: dict[int, tuple[list, set]] = {}
        for row, first, k, ids in windows.hits(w):
            x = found.setdefault(row, ([], set()))
            x[0].append((first - int(w.ptr[row]), first - int(w.ptr[row]) + k))
            x[1].update(ids.tolist())
        counts.append(w.counts)
        for row in range(w.hi - w.lo):
            if row in found:
                spans.extend(merged(found[row][0]))
                items.extend(sorted({x for x in windows.ids.take(pa.array(list(found[row][1]))).to_pylist() if x is not None}))
            ptr.append(len(spans))
            iptr.append(len(items))
    return pa.RecordBatch.from_arrays(
        [*batch.columns, pa.array(np.concatenate(counts), pa.int64()), bytewise.list_array(np.array(spans, np.int64), np.array(ptr), pa.int64()),
         pa.ListArray.from_arrays(pa.array(iptr, pa.int32()), pa.array(items, pa.string()))],
        names=[*batch.schema.names, *names],
    )


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Flat bounds of the union of spans."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


@F.pandas_udf(T.LongType())
def covered(spans):
    """Words under flat bounds, which may overlap where blocks were merged."""

    def count(x):
        m = merged([(int(x[i]), int(x[i + 1])) for i in range(0, len(x), 2)])
        return sum(m[1::2]) - sum(m[::2])

    return spans.map(count)


@F.pandas_udf(T.StringType())
def _without(text, spans):
    def cut(t, x):
        if t is None or not len(x):
            return t
        w = next(bytewise.scan(pa.array([t], pa.large_string()), bytewise.ALNUM))
        raw, out, at = t.encode(), [], 0
        m = merged([(int(x[i]), int(x[i + 1])) for i in range(0, len(x), 2)])
        for a, b in zip(m[::2], m[1::2], strict=True):
            out.append(raw[at : int(w.start[a])])
            at = int(w.end[b - 1])
        return b"".join([*out, raw[at:]]).decode()

    return text.combine(spans, cut)


def decontaminate(documents: DataFrame, benchmark: DataFrame, action: str = "documents", window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """``documents`` without the hit ones (``action="documents"``) or without the hit words
    and what stands between them (``"spans"``); same columns."""
    names = tuple(free_names(documents.columns, "_n_words", "_spans", "_items"))
    found = mark(documents, benchmark, window, limit, names)
    if action == "documents":
        return found.filter(F.size(names[1]) == 0).select(documents.columns)
    if action != "spans":
        raise ValueError(action)
    return found.withColumn("text", _without("text", names[1])).select(documents.columns)


def report(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = mark(documents.select("doc_id", "text"), benchmark, window, limit)
    return found.select(
        "doc_id", F.col("_n_words").alias("n_words"), covered("_spans").alias("n_hit"), F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)


def brute_force(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The contract in plain Python, for tests."""
    import re

    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: rx.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    out = []
    for doc_id, text in docs:
        w = words(text)
        hit, named = set(), set()
        for item, t in items:
            q = words(t)
            k = min(window, len(q))
            grams = {tuple(q[i : i + k]) for i in range(len(q) - k + 1)} if k else set()
            for i in range(len(w) - k + 1) if k else ():
                if tuple(w[i : i + k]) in grams:
                    hit.update(range(i, i + k))
                    named.add(str(item)) if item is not None else None
        ids = sorted(named)
        out.append((doc_id, len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit)))
    return out


_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The report as SQL, over whole tables.
ORACLE = f"""
with d as (select doc_id, row_number() over () as u, {_WORDS} as w from documents),
i as (select distinct item_id, {_WORDS} as w from benchmark),
g as (select distinct item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) as t
      from (select item_id, w, least({WINDOW}, len(w)) as k from i where len(w) > 0)),
x as (select u, k, unnest(range(1, len(w) - k + 2)) as p, unnest(list_transform(range(1, len(w) - k + 2), lambda p: array_to_string(w[p:p + k - 1], ' '))) as t
      from d, (select distinct k from g) where len(w) >= k),
h as (select x.u, x.p, x.k, g.item_id from x join g on g.k = x.k and g.t = x.t),
c as (select u, count(distinct p) as n from (select u, unnest(range(p, p + k)) as p from h) group by u),
n as (select u, count(*) as n, string_agg(item, ',' order by item) as items from (select distinct u, item_id::varchar as item from h where item_id is not null) group by u)
select d.doc_id, len(d.w)::bigint as n_words, coalesce(c.n, 0)::bigint as n_hit, coalesce(n.n, 0)::bigint as n_items, sha256(coalesce(n.items, '')) as items_sha256, c.n is not null as contaminated
from d left join c on c.u = d.u left join n on n.u = d.u
"""
