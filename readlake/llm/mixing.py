"""Mixing sources to target weights by words.

Every document gets a hash-random key. Documents are range-partitioned and sorted by
(source, key), so a hot source spreads over many partitions. Distributed prefix sums (one
subtotal for each source and partition, then a running sum of subtotals) find the
partition, and a window over that partition alone the document, at which a source's budget
is spent. A budget above the source's size repeats the source: whole epochs, then the part.
The decision for a document then follows from its own key and its source's row of the plan,
so texts are never shuffled.

Targets: sources by code point, null last, weigh ``weights`` in turn and share the sum of
all sizes; a target stops at ``most`` times its source's size and the excess is reshared by
weight until none is above. That is min(most * size, level * weight) at the level at which
the targets add up to the whole, which has a closed form over sources ordered by
size / weight.

Defined results: null or blank text has size 0 and is never taken. A null source is a
source, and so is one whose texts are all blank: it has target 0 and its turn of the weights. Rows that
repeat doc_id, source and size are ties: they stand at one place, and where the budget ends
among them each gets an equal part, rounded down. The plan has one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from readlake.llm.common import broadcast_if_small, discard, free_names, materialize

WEIGHTS = (1, 2, 3)
#: A target is at most this many times its source's size.
MOST = 3
SEED = "mix-1"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def key_of(doc_id: Column, seed: str = SEED) -> Column:
    """60 hash-random bits of the doc_id."""
    said = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(said), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target from (source, source_size) rows, one for each source."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    cycle = F.array(*[F.lit(w).cast("long") for w in weights])
    w = sizes.withColumn("weight", F.get(cycle, F.pmod(rank - 1, F.lit(len(weights)))))
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy()
    left = F.sum("source_size").over(every) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    open_ = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    stepped = w.withColumn("left", left).withColumn("open", open_)
    level = F.when(F.col("left") * F.col("weight") <= most * F.col("source_size") * F.col("open"), F.col("left").cast("double") / F.col("open"))
    found = stepped.withColumn("level", F.max(level).over(every))
    return found.select("source", "source_size", F.least(F.col("source_size").cast("double") * most, F.col("level") * F.col("weight")).alias("target"))


def plan(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """One row for each source: source, source_size, target, epochs, and the place
    (cut_key, cut_id, cut_size) at which the last part ends, with cut_part words of it."""
    narrow = documents.select("source", "doc_id", size_of(F.col("text")).alias("size"), key_of(F.col("doc_id"), seed).alias("key")).filter("size > 0")
    order = ["source", "key", "doc_id", "size"]
    placed = materialize(narrow.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()), "mix-order")
    parts = placed.groupBy("source", "part").agg(F.sum("size").alias("subtotal"))
    sums = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = materialize(parts.withColumn("before", F.coalesce(F.sum("subtotal").over(sums), F.lit(0))), "mix-parts")
    # A source without words takes its place in the cycle of weights, too.
    sizes = parts.select("source", "subtotal").union(documents.select("source").distinct().select("source", F.lit(0).cast("long")))
    aims = targets(sizes.groupBy("source").agg(F.sum("subtotal").alias("source_size")), weights, most)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0)
    aims = aims.withColumn("budget", F.floor("target")).withColumn("epochs", epochs).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("source_size"))
    aims = materialize(aims, "mix-targets")
    last = parts.withColumnRenamed("source", "s").join(aims.select(F.col("source").alias("t"), "rest"), F.col("s").eqNullSafe(F.col("t"))).filter((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("subtotal")))
    last = materialize(last.select("s", F.col("part").alias("p"), (F.col("rest") - F.col("before")).alias("rest")), "mix-last")
    here = placed.join(broadcast_if_small(last, 64), F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).select("source", "key", "doc_id", "size", "rest")
    here = here.groupBy("source", "key", "doc_id", "size", "rest").agg(F.count("*").alias("ties"))
    upto = Window.partitionBy("source").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    here = here.withColumn("past", F.sum(F.col("size") * F.col("ties")).over(upto)).withColumn("start", F.col("past") - F.col("size") * F.col("ties"))
    cut = here.filter((F.col("start") <= F.col("rest")) & (F.col("rest") < F.col("past"))).select(
        F.col("source").alias("u"), F.col("key").alias("cut_key"), F.col("doc_id").alias("cut_id"), F.col("size").alias("cut_size"), F.floor((F.col("rest") - F.col("start")) / F.col("ties")).alias("cut_part"))
    out = materialize(aims.join(cut, F.col("source").eqNullSafe(F.col("u")), "left").drop("u", "rest", "budget"), "mix-plan")
    discard(placed, parts, aims, last)
    return out


def allot(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, names: tuple[str, ...] = ("size", "source_size", "target", "taken")) -> DataFrame:
    """``documents`` with size, source_size, target and taken (or other ``names`` for them), which
    replace columns of these names."""
    rows = plan(documents, weights, most, seed)
    size, key, *own = free_names([*documents.columns, *names], "_size", "_key", *["_p_" + c for c in rows.columns])
    col = dict(zip(rows.columns, own, strict=True))
    rows = broadcast_if_small(rows.select(*[F.col(c).alias(n) for c, n in col.items()]), 160)
    sized = documents.withColumn(size, size_of(F.col("text"))).withColumn(key, key_of(F.col("doc_id"), seed))
    joined = sized.join(rows, F.col("source").eqNullSafe(F.col(col["source"])), "left")
    # null doc_ids share one key and come first, as in the sort.
    said = lambda k, d, n: F.struct(F.col(k).alias("k"), F.col(d).alias("d"), F.col(n).alias("n"))
    place, end = said(key, "doc_id", size), said(col["cut_key"], col["cut_id"], col["cut_size"])
    part = F.when(F.col(col["cut_key"]).isNull() | (F.col(size) == 0), 0).when(place < end, F.col(size)).when(place == end, F.col(col["cut_part"])).otherwise(0)
    taken = F.coalesce(F.col(col["epochs"]) * F.col(size) + part, F.lit(0))
    new = (F.col(size), F.coalesce(col["source_size"], F.lit(0).cast("long")), F.coalesce(col["target"], F.lit(0.0)), taken.cast("long"))
    return joined.select(*[c for c in documents.columns if c not in names], *[c.alias(n) for c, n in zip(new, names, strict=True)])


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The mixed documents, with the columns of ``documents``: a document stands once for each
    time it is taken whole; one at which its source's budget ends comes with its first words."""
    size, other, target, taken, whole, rest, copy = free_names(documents.columns, "_size", "_source_size", "_target", "_taken", "_whole", "_rest", "_copy")
    rows = allot(documents, weights, most, seed, (size, other, target, taken)).filter(F.col(taken) > 0).withColumn(whole, F.floor(F.col(taken) / F.col(size))).withColumn(rest, F.col(taken) % F.col(size))
    copies = rows.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), F.col(whole) + F.when(F.col(rest) > 0, 1).otherwise(0))))
    cut = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), 1, F.col(rest).cast("int")), "")
    text = F.when(F.col(copy) <= F.col(whole), F.col("text")).otherwise(cut)
    out = copies.withColumn("text", text)
    if "n_chars" in documents.columns:
        out = out.withColumn("n_chars", F.when(F.col(copy) <= F.col(whole), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(documents.columns)


ORACLE = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT as size,
         ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT as key from documents
), s as (select source, sum(size)::BIGINT as s from d group by source),
w as (select source, s, (1 + (row_number() over (order by source nulls last) - 1) % 3)::BIGINT as w from s),
c as (
  select source, s, w,
         ((sum(s) over ()) - 3 * coalesce(sum(s) over (order by s / w, source nulls last rows between unbounded preceding and 1 preceding), 0))::BIGINT as l,
         ((sum(w) over ()) - coalesce(sum(w) over (order by s / w, source nulls last rows between unbounded preceding and 1 preceding), 0))::BIGINT as o from w
), t as (
  select source, s, least(s::DOUBLE * 3, (max(case when l * w <= 3 * s * o then l::DOUBLE / o end) over ()) * w) as target from c
), b as (select *, floor(target)::BIGINT as budget from t),
e as (select *, coalesce(budget // nullif(s, 0), 0) as epochs, coalesce(budget % nullif(s, 0), 0) as rest from b),
p as (select *, (sum(size) over (partition by source order by key, doc_id, size rows between unbounded preceding and current row) - size)::BIGINT as start from d)
select p.doc_id, p.size, coalesce(e.s, 0)::BIGINT as source_size, coalesce(e.target, 0.0)::DOUBLE as target,
       coalesce(e.epochs * p.size + greatest(0, least(p.size, e.rest - p.start)), 0)::BIGINT as taken
from p left join e on p.source is not distinct from e.source
"""
