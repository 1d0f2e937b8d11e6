"""Exact Jaccard join of word shingle sets, filtered under several global token orders.

1. Every text becomes a set of hashed word shingles. Texts with equal multisets form a class,
   and only classes are compared, so exact copies never make pairs.
2. Prefix filter. If two sets are similar enough they share a token among the first
   ``n - ceil(t n) + 1`` of each, whatever the order of tokens, as long as it is the same for
   both. All orders used here put rare tokens first, by a sketch of the counts of all tokens
   in all documents, and break ties by a different hash each.
3. Classes that share a prefix token under the first order are grouped by it. Instead of all
   pairs of a group, each round compares its members with a few leaders, where sizes and the
   token's place in both sets leave room for enough shared tokens after it. Verified links
   make components; a group whose members are all in one component needs nothing more.
   Groups that are not settled get their missing pairs in later rounds: small ones all
   at once, large ones with more leaders each round, until none is left. So
   no link between different components is missed, and no cap drops a pair.
4. Candidates are filtered before their sets are fetched: by size; by the number of tokens
   that somewhat longer prefixes under the first order must share; and by sharing a prefix
   token under every other order. Prefixes of all orders travel with the classes, 32 bits a
   token. Only pairs that pass every order are verified, on the full sets, which come from
   a second pass over the texts of candidates (a Bloom filter of fixed size keeps others out
   of the shuffle).

The result is the component of each document under the links (100 * intersection >=
``percent`` * union), which all-pairs verification would give as well.

Defined results: null or blank text has an empty set and links with nothing; a text with
fewer words than ``k`` is one shingle. Repeated rows are copies of each other. Sets are
compared by 64-bit shingle hashes. Classes have 128 bits: 64 name a class, and where the other
64 show that one name stands for several, these are named anew from both halves.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from readlake.llm import bytewise
from readlake.llm.common import broadcast_if_small, discard, free_names, map_batches, materialize, reduce_arrays, release, salted_join
from readlake.llm.components import components

#: Cells of the sketch of token counts, which orders tokens; a byte each when it is broadcast.
CELLS = 1 << 22
#: Token orders: one that groups, and the others that candidates must pass.
ORDERS = 3
#: Groups of up to so many classes get all their missing pairs in one round.
SMALL = 24
#: Largest size of a Bloom filter, in bytes. Beyond it more rows pass, all of them right.
BLOOM = 32 << 20

U = np.uint64
_SALTS = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5)]


def shingles(w: bytewise.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of each row, flat in the order of the text, and the rows' bounds."""
    h = w.hashes()
    g, _ = w.grams(h, k)
    size = np.maximum(w.counts - k + 1, 0)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    if len(short):
        whole = np.array([bytewise.gram_hash(h, np.array([w.ptr[i]]), int(w.counts[i]))[0] for i in short], U)
        g = np.insert(g, np.cumsum(size)[short], whole)
        size[short] = 1
    return g, np.concatenate([[0], np.cumsum(size)])


def _classes(g: np.ndarray, ptr: np.ndarray, shared: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's multiset of shingles; names in ``shared`` are replaced by one from both."""
    n = np.diff(ptr).astype(U)
    out = []
    with np.errstate(over="ignore"):
        for s in (_SALTS[2], _SALTS[3]):
            sums = np.zeros(len(g) + 1, U)
            np.cumsum(bytewise.mix(g ^ s), out=sums[1:])
            out.append(bytewise.mix(sums[ptr[1:]] - sums[ptr[:-1]] + n * s))
        cls, check = out[0] & U((1 << bits) - 1), out[1]
        again = np.isin(cls, shared)
        cls[again] = bytewise.mix(cls[again] * _SALTS[0] ^ check[again])
    return cls.view(np.int64), check.view(np.int64)


def core_size(n: int, percent: int) -> int:
    """Tokens of a prefix, of which similar sets share one."""
    return n - -(-percent * n // 100) + 1 if n else 0


def more_shared(n: int) -> int:
    """Similar sets share so many tokens of prefixes that are longer by this less 1."""
    return max(1, n // 16)


class Orders:
    """Rare tokens first, by the logarithm of their count; ties by a hash for each order."""

    def __init__(self, counts: np.ndarray):
        self.level = np.log2(np.maximum(counts, 1)).astype(np.uint8)

    def ranks(self, g: np.ndarray, which: int) -> np.ndarray:
        """Sort keys: 6 bits of frequency, 58 of a hash."""
        with np.errstate(over="ignore"):
            return (self.level[_cell(g)].astype(U) << U(58)) | (bytewise.mix(g + _SALTS[which % 2] * U(which + 1)) >> U(6))


def _cell(g: np.ndarray) -> np.ndarray:
    return (g >> U(64 - (CELLS.bit_length() - 1))).astype(np.int64)


def token_orders(documents: DataFrame, k: int) -> Orders:
    """Counts of all tokens of all documents, added up in a sketch of one count for each cell of
    hashes. Any counts give right results; good ones keep common passages out of prefixes."""

    def fill(counts: np.ndarray, batch: pa.RecordBatch) -> None:
        for w in bytewise.scan(batch.column("text")):
            np.add.at(counts, _cell(shingles(w, k)[0]), np.uint32(1))
        release()

    return Orders(reduce_arrays(documents.select("text"), fill, CELLS, "uint32", np.add))


def _signatures(batch: pa.RecordBatch, orders: Orders, k: int, percent: int, shared: np.ndarray, bits: int) -> pa.RecordBatch:
    n, cls, check, tokens, ptr_out, longer, others = [], [], [], [], [0], [], []
    first: dict[int, int] = {}
    for w in bytewise.scan(batch.column("text")):
        g, ptr = shingles(w, k)
        c, d = _classes(g, ptr, shared, bits)
        ranks = [orders.ranks(g, o) for o in range(ORDERS)]
        for i, x in enumerate(c.tolist()):
            # A class's tokens are needed once in a batch.
            if x in first:
                n.append(first[x])
                longer.append(None)
                others.append(None)
            else:
                a, b = ptr[i], ptr[i + 1]
                _, at = np.unique(ranks[0][a:b], return_index=True)
                own, keys = g[a:b][at], [r[a:b][at] for r in ranks[1:]]
                if len(own) and len(np.unique(g[a:b])) != len(own):
                    # Two tokens have one rank.
                    own = np.unique(g[a:b])
                    own = own[np.argsort(orders.ranks(own, 0), kind="stable")]
                    keys = [orders.ranks(own, o) for o in range(1, ORDERS)]
                first[x] = len(own)
                n.append(len(own))
                size = core_size(len(own), percent)
                tokens.append(own[:size])
                # 32 bits do: equal tokens stay equal, and a filter may let more pass.
                short = own.astype(np.uint32)
                longer.append(np.sort(short[: size + more_shared(len(own)) - 1]).tobytes() if size else None)
                others.append(b"".join(np.sort(short[np.argpartition(r, size - 1)[:size]]).tobytes() for r in keys) if size else None)
                ptr_out.append(ptr_out[-1] + size)
                continue
            ptr_out.append(ptr_out[-1])
        cls.append(c)
        check.append(d)
    flat = np.concatenate(tokens) if tokens else np.empty(0, U)
    return pa.RecordBatch.from_arrays(
        [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(np.concatenate(cls)), pa.array(np.concatenate(check)), bytewise.list_array(flat.view(np.int64), np.array(ptr_out), pa.int64()), pa.array(longer, pa.binary()), pa.array(others, pa.binary())],
        names=["doc_id", "n", "cls", "check", "prefix", "longer", "others"],
    )


class Bloom:
    """Two bits for each id in a table of a given size."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits

    def _at(self, ids: np.ndarray, i: int) -> np.ndarray:
        return (bytewise.mix(ids.view(U) + _SALTS[i]) % U(8 * len(self.bits))).astype(np.int64)

    def add(self, ids: np.ndarray) -> None:
        for i in range(2):
            at = self._at(ids, i)
            np.bitwise_or.at(self.bits, at >> 3, (1 << (at & 7)).astype(np.uint8))

    def has(self, ids: np.ndarray) -> np.ndarray:
        a, b = self._at(ids, 0), self._at(ids, 1)
        return ((self.bits[a >> 3] >> (a & 7)) & (self.bits[b >> 3] >> (b & 7)) & 1).astype(bool)


def _bloom_of(ids: DataFrame) -> Bloom:
    size = -(-min(BLOOM, max(1 << 16, 2 * ids.count())) // 16) * 16
    return Bloom(reduce_arrays(ids, lambda bits, batch: Bloom(bits).add(batch.column(0).to_numpy(zero_copy_only=False)), size, "uint8", np.bitwise_or))


def _sets(batch: pa.RecordBatch, bloom: Bloom, k: int, shared: np.ndarray, bits: int) -> pa.RecordBatch:
    """cls and its sorted set, where the filter has it."""
    found: dict[int, bytes] = {}
    for w in bytewise.scan(batch.column("text")):
        g, ptr = shingles(w, k)
        c, _ = _classes(g, ptr, shared, bits)
        for i in np.flatnonzero(bloom.has(c) & (np.diff(ptr) > 0)).tolist():
            if (x := int(c[i])) not in found:
                found[x] = np.unique(g[ptr[i] : ptr[i + 1]]).tobytes()
    return pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.binary())], names=["cls", "items"])


def _explode(batch: pa.RecordBatch, bloom: Bloom) -> pa.RecordBatch:
    """Prefix tokens one by one, without most that no other class has."""
    prefix = batch.column("prefix")
    token = prefix.flatten().to_numpy(zero_copy_only=False)
    size = prefix.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    keep = bloom.has(token)
    cls, n, first = (np.repeat(x, size)[keep] for x in (batch.column("cls").to_numpy(zero_copy_only=False), batch.column("n").to_numpy(zero_copy_only=False), np.cumsum(size) - size))
    return pa.RecordBatch.from_arrays([pa.array(cls), pa.array(n.astype(np.int32)), pa.array(token[keep]), pa.array((np.flatnonzero(keep) - first).astype(np.int32))], names=["cls", "n", "token", "pos"])


def _both(x: np.ndarray, y: np.ndarray) -> int:
    """Tokens of ``x`` that ``y`` has, both sorted. Those that fall together in 32 bits stand twice, so none is missed."""
    return int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())


def _share(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """Pairs whose longer prefixes under the first order share enough, and whose prefixes under every other order meet."""
    keep = []
    for n, m, p, q, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "p", "q", "x", "y")), strict=True):
        ok = _both(np.frombuffer(p, np.uint32), np.frombuffer(q, np.uint32)) >= min(more_shared(n), more_shared(m))
        a, b = core_size(n, percent), core_size(m, percent)
        x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
        keep.append(ok and all(_both(x[o * a : (o + 1) * a], y[o * b : (o + 1) * b]) for o in range(ORDERS - 1)))
    return batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))


def _verify(batch: pa.RecordBatch, percent: int) -> pa.RecordBatch:
    """The sets themselves."""
    linked = []
    for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
        x, y = np.frombuffer(a, U), np.frombuffer(b, U)
        both = _both(x, y)
        linked.append(100 * both >= percent * (len(x) + len(y) - both))
    return pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array(linked, pa.bool_())], names=["u", "v", "linked"])


def _pair(a: str, b: str):
    return F.least(a, b).alias("u"), F.greatest(a, b).alias("v")


class Classes:
    """What ``classes`` finds: ``rows`` (doc_id, n, cls, ...) of each document, ``comps`` (id, root) of
    each class that links, and how texts are named."""

    def __init__(self, rows: DataFrame, comps: DataFrame, shared: np.ndarray, bits: int):
        self.rows, self.comps, self.shared, self.bits = rows, comps, shared, bits

    def rooted(self) -> DataFrame:
        """cls, root, docs, least doc_id and whether a doc_id is null, of each class with tokens."""
        own = self.rows.filter("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least"), F.max(F.col("doc_id").isNull()).alias("none"), F.count("*").alias("docs"))
        return materialize(own.join(self.comps, F.col("cls") == F.col("id"), "left").select("cls", F.coalesce("root", "cls").alias("root"), "docs", "least", "none"), "class-roots")


def _of_roots(own: DataFrame, first) -> DataFrame:
    """Classes of components of several documents, with what ``first`` finds in each component.
    Classes of a large component are dealt to several tasks."""
    roots = own.groupBy("root").agg(first.alias("first"), F.count("*").alias("members"), F.sum("docs").alias("all"))
    return salted_join(own, materialize(roots.filter("all > 1").withColumn("several", F.lit(True)).drop("all"), "roots"), "root", "members", ["cls"]).filter("several")


def _named(documents: DataFrame, orders, k: int, percent: int, bits: int) -> tuple[DataFrame, np.ndarray]:
    """Signatures of all documents, after names that several classes share have been replaced."""
    shared = np.empty(0, U)
    while True:
        rows = map_batches(documents.select(F.col("doc_id").cast("bigint"), "text"), lambda b, s=shared: _signatures(b, orders.value, k, percent, s, bits),
                           "doc_id bigint, n bigint, cls bigint, check bigint, prefix array<bigint>, longer binary, others binary", 2000)
        rows = materialize(rows, "shingle-classes")
        # Expected: one for each 2^65 pairs of classes.
        more = rows.filter("n > 0").groupBy("cls").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a <> b").select("cls").collect()
        if not more:
            return rows, shared
        discard(rows)
        more = np.array([r.cls for r in more], np.int64).view(U)
        if np.isin(more, shared).any():
            raise RuntimeError("two shingle sets share 128 bits")
        shared = np.concatenate([shared, more])


def classes(documents: DataFrame, k: int, percent: int, bits: int = 64) -> Classes:
    """Classes of equal texts and the components of their links. ``bits``: of a class's first name."""
    spark = documents.sparkSession
    orders = spark.sparkContext.broadcast(token_orders(documents, k))
    rows, named = _named(documents, orders, k, percent, bits)
    prefix = rows.filter(F.size("prefix") > 0).select("cls", "n", F.explode("prefix").alias("token"))
    shared_by = prefix.groupBy("token").agg(F.min("cls").alias("leader"), F.max("cls").alias("last"), F.min("n").cast("int").alias("n_min")).filter("leader <> last").select("token", "n_min")
    # Tables that a hot token's rows meet are written first, so that adaptive execution can split the join.
    shared_by = materialize(shared_by, "shingle-shared")
    several = spark.sparkContext.broadcast(_bloom_of(shared_by.select("token")))
    groups = map_batches(rows.select("cls", "n", "prefix"), lambda b: _explode(b, several.value), "cls bigint, n int, token bigint, pos int", 2000).distinct().join(shared_by, "token")
    groups = materialize(groups, "shingle-groups")
    discard(shared_by)
    tokens = rows.filter("longer is not null").select("cls", "n", "longer", "others").dropDuplicates(["cls"])
    done, comps, sets, leaders = None, None, None, 1
    spent: list[DataFrame] = []
    while True:
        # Groups that hold more than one component, and their missing pairs.
        rooted = groups.withColumn("root", F.col("cls")) if comps is None else groups.join(comps, F.col("cls") == F.col("id"), "left").select(*groups.columns, F.coalesce("root", "cls").alias("root"))
        # A member whose token comes too late for even the smallest partner has none here.
        least = F.greatest(F.ceil(F.col("n") * percent / 100), F.col("n_min"))
        bound = rooted.filter(_room("n", "pos", least, percent)).drop("n_min")
        open_ = bound.groupBy("token").agg(F.count("*").alias("members"), F.min("root").alias("r0"), F.max("root").alias("r1")).filter("r0 <> r1").select("token", "members")
        open_ = materialize(open_, "tokens-open")
        left = materialize(bound.join(open_, "token"), "groups-open")
        spent += [left, open_]
        small = left.filter(F.col("members") <= (SMALL if leaders > 1 else 0))
        large = left.filter(F.col("members") > (SMALL if leaders > 1 else 0))
        other = small.select("token", *[F.col(c).alias(c + "2") for c in ("cls", "n", "pos", "root")])
        more = small.join(other, (small["token"] == other["token"]) & (F.col("cls") < F.col("cls2")) & (F.col("root") != F.col("root2")) & _meet("n", "pos", "n2", "pos2", percent)).select(*_pair("cls", "cls2"))
        some = large.limit(1).count() > 0
        if some:
            # Those with the fewest rarer tokens lead: they are nearest to what a group has in common.
            rank = F.struct("pos", "cls", "n", "root")
            lead = F.array(F.min(rank)) if leaders == 1 else F.slice(F.array_sort(F.collect_list(F.when(_may_lead(leaders), rank))), 1, leaders)
            chosen = materialize(large.groupBy("token").agg(lead.alias("lead"), F.first("members").alias("all")), "leaders")
            spent.append(chosen)
            # A hot group's members are dealt to several tasks; of a member's leaders only those that it may link with become rows.
            fits = lambda x: (F.col("root") != x["root"]) & _meet("n", "pos", x["n"], x["pos"], percent)
            led = salted_join(large, chosen, "token", "all", ["cls"]).select("cls", F.explode(F.filter("lead", fits)).alias("x"))
            more = more.union(led.select("cls", F.col("x.cls").alias("cls2")).select(*_pair("cls", "cls2")))
        more = more.distinct()
        pairs = materialize(more if done is None else more.join(done, ["u", "v"], "left_anti"), "pairs")
        if pairs.limit(1).count():
            side = lambda c, n, p, x: tokens.select(F.col("cls").alias(c), F.col("n").alias(n), F.col("longer").alias(p), F.col("others").alias(x))
            near = map_batches(pairs.join(side("u", "n", "p", "x"), "u").join(side("v", "m", "q", "y"), "v").select("u", "v", "n", "m", "p", "q", "x", "y"), lambda b: _share(b, percent), "u bigint, v bigint", 2000)
            near = materialize(near, "pairs-near")
            done = pairs if done is None else done.union(pairs)
            ids = near.select(F.col("u").alias("cls")).union(near.select("v")).distinct()
            if sets is not None:
                ids = ids.join(sets.select("cls"), "cls", "left_anti")
            ids = materialize(ids, "shingle-ids")
            if ids.limit(1).count():
                seen = spark.sparkContext.broadcast(_bloom_of(ids))
                found = map_batches(documents.select("text"), lambda b, seen=seen: _sets(b, seen.value, k, named, bits), "cls bigint, items binary", 2000)
                found = found.join(ids, "cls", "left_semi").dropDuplicates(["cls"])
                found = materialize(found, "shingle-sets")
                sets = found if sets is None else sets.union(found)
            if sets is not None:
                items = lambda c, x, sets=sets: sets.select(F.col("cls").alias(c), F.col("items").alias(x))
                checked = map_batches(near.join(items("u", "a"), "u").join(items("v", "b"), "v").select("u", "v", "a", "b"), lambda b: _verify(b, percent), "u bigint, v bigint, linked boolean", 500)
                new = materialize(checked.filter("linked").select("u", "v"), "links")
                spent.append(new)
                if new.limit(1).count():
                    comps = _merged(comps, new)
            spent += [near, ids]
        elif leaders > 1 and not (some and _unfinished(large, leaders)):
            break
        leaders *= 32
    discard(groups, *spent)
    return Classes(rows, comps if comps is not None else spark.createDataFrame([], "id bigint, root bigint"), named, bits)


def _merged(comps: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components after more links: these are taken between the roots so far, so that older ones are not walked again."""
    if comps is None:
        return materialize(components(links), "components")
    root = lambda df, c: df.join(comps.select(F.col("id").alias("_id"), F.col("root").alias("_root")), F.col(c) == F.col("_id"), "left").withColumn(c, F.coalesce("_root", c)).drop("_id", "_root")
    new = materialize(components(root(root(links, "u"), "v")), "roots")
    ids = comps.select("id").union(links.select("u")).union(links.select("v")).distinct()
    now = root(ids.withColumn("root", F.col("id")), "root").join(new.select(F.col("id").alias("_new"), F.col("root").alias("_to")), F.col("root") == F.col("_new"), "left")
    out = materialize(now.select("id", F.coalesce("_to", "root").alias("root")), "components")
    discard(comps, new)
    return out


def _room(n, pos, m, percent: int):
    """Whether enough tokens are left from a place on, if this is the first shared one."""
    n, pos, m = (F.col(c) if isinstance(c, str) else c for c in (n, pos, m))
    return (n - pos) * (100 + percent) >= (n + m) * percent


def _meet(n, pos, m, at, percent: int):
    """Whether sets of these sizes can link if this token is the first that they share."""
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & _room(n, pos, m, percent) & _room(m, at, n, percent)


def _may_lead(leaders: int):
    """Members that may lead: about four times as many as wanted, by their hash, so that no
    group collects all of its members."""
    share = F.least(F.lit(1.0), F.lit(4.0 * leaders) / F.col("members"))
    return (F.pmod(F.xxhash64(F.col("cls"), F.lit(7)), F.lit(1 << 20)) < share * (1 << 20))


def _unfinished(large: DataFrame, leaders: int) -> bool:
    """Whether a large group has had fewer leaders than members."""
    return bool(large.filter(F.col("members") > leaders).limit(1).count())


def _apart(cls: str, n: str, doc_id: str = "doc_id"):
    """A class's name; texts without tokens, which all have one, get a hash of their own, whose match says nothing."""
    return F.when(F.col(n) > 0, F.col(cls)).otherwise(F.xxhash64(doc_id))


def cluster(documents: DataFrame, k: int = 4, percent: int = 85, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    found = classes(documents, k, percent, bits)
    least = materialize(_of_roots(found.rooted(), F.min("least")).select("cls", "first", "docs"), "class-first")
    rows = salted_join(found.rows.select("doc_id", "n", _apart("cls", "n").alias("cls")), least, "cls", "docs", ["doc_id"])
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("first", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(documents: DataFrame, k: int = 5, percent: int = 80, limit: int = 0, bits: int = 64) -> DataFrame:
    """``documents`` with one document, of the smallest doc_id (null first), of each component.

    What stays of a class is a list of one row for each class of several documents. Documents are dealt
    by their class, a hot one by doc_id too; a list below ``limit`` bytes is broadcast instead."""
    found = classes(documents, k, percent, bits)
    # Of a component the class stays that has its first doc_id, and of classes with one such the smaller.
    first = F.min(F.struct((~F.col("none")).alias("known"), F.when(~F.col("none"), F.col("least")).alias("least"), "cls"))
    best = F.col("first.cls") == F.col("cls")
    stays = materialize(_of_roots(found.rooted(), first).select("cls", best.alias("best"), F.when(best, F.col("first.least")).alias("keeps"), "docs"), "class-first")
    c, n, d, best, keeps, docs = free_names(documents.columns, "_cls", "_n", "_d", "_best", "_keeps", "_docs")
    kinds, shared = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema), found.shared

    def add(batch: pa.RecordBatch) -> pa.RecordBatch:
        size, cls = [], []
        for w in bytewise.scan(batch.column("text")):
            g, ptr = shingles(w, k)
            cls.append(_classes(g, ptr, shared, bits)[0])
            size.append(np.diff(ptr))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(cls)), pa.array(np.concatenate(size), pa.int64())], names=[*batch.schema.names, c, n])

    keyed = map_batches(documents, add, f"{kinds}, `{c}` bigint, `{n}` bigint", 2000).withColumn(c, _apart(c, n))
    named = stays.select(F.col("cls").alias(d), F.col("best").alias(best), F.col("keeps").alias(keeps), F.col("docs").alias(docs))
    small = broadcast_if_small(named, 32, limit)
    joined = salted_join(keyed, named.withColumnRenamed(d, c), c, docs, ["doc_id"]) if small is named else keyed.join(small, keyed[c] == small[d], "left")
    left = joined.filter(F.col(best).isNull() | (F.col(n) == 0) | (F.col(best) & F.col("doc_id").eqNullSafe(F.col(keeps))))
    # Repeated rows of one doc_id and text: one of them stays.
    again = found.rows.filter("n > 0").groupBy(F.col("doc_id").alias(d), F.col("cls").alias(docs)).agg(F.count("*").alias(best)).filter(f"{best} > 1").drop(best)
    again = materialize(again, "repeated-rows")
    if again.limit(1).count():
        again = broadcast_if_small(again, 32, limit)
        same = (F.col(c) == again[docs]) & F.col("doc_id").eqNullSafe(again[d]) & (F.col(n) > 0)
        left = left.select(*documents.columns, c, n)
        left = left.join(again, same, "left_anti").union(left.join(again, same, "left_semi").dropDuplicates([c, "doc_id"]))
    return left.select(documents.columns)


def brute_force(docs: list[tuple], k: int, percent: int) -> list[tuple]:
    """The contract in plain Python, for tests."""
    rx = re.compile(r"[^\x20\x09-\x0D]+")
    sets = []
    for _, text in docs:
        w = rx.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    parent = list(range(len(docs)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                parent[top(i)] = top(j)
    least: dict[int, int] = {}
    for i, (d, _) in enumerate(docs):
        least[top(i)] = min(least.get(top(i), d), d)
    return [(d, len(sets[i]), least[top(i)]) for i, (d, _) in enumerate(docs)]


#: ``cluster(documents, 4, 85)`` as SQL, over whole tables; all pairs that share a shingle are compared.
ORACLE = r"""
with recursive d as (select doc_id, row_number() over () as u,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct u, unnest(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda p: hash(array_to_string(w[p:p + 3], ' ')))) as t from d where len(w) > 0),
n as (select u, count(*) as n from s group by u),
l as (select p.a, p.b from (select x.u as a, y.u as b, count(*) as c from s x join s y on y.t = x.t and y.u <> x.u group by 1, 2) p
  join n na on na.u = p.a join n nb on nb.u = p.b where 100 * p.c >= 85 * (na.n + nb.n - p.c)),
r(u, c) as (select u, u from d union select r.u, l.b from r join l on l.a = r.c)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.doc_id as component_id
from d left join n on n.u = d.u join (select r.u, min(e.doc_id) as doc_id from r join d e on e.u = r.c group by r.u) m on m.u = d.u
"""
