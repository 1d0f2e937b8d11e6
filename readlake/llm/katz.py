"""Katz backoff language model over word bigrams, trained and evaluated in Spark.

Tokens are lower-cased words, then one end token; a text's first token follows a start mark.
With r the training count of a pair, c of a word and d the discounts,

    P(w | h) = d2(r) r / c(h)          if the pair (h, w) was seen
             = alpha(h) P(w)           if h was seen, but not with w
             = P(w)                    if h was not seen
    P(w)     = d1(c) c / N, and what is left of 1 for the one type of unseen words.

d is Good-Turing for counts up to ``GT`` (from the counts of counts), and (r - ``ABOVE``) / r
beyond, or where Good-Turing gives nothing in (0, 1); so every history keeps some mass.
alpha(h) = (1 - sum of P over seen followers) / (1 - sum of their P(w)) makes each history's
distribution add up to 1 exactly.

How it runs. The texts are read once into blocks of about ``BLOCK`` tokens: distinct word
hashes, and each token's index among them. Blocks ask for counts by bucket of the hash:
a block's distinct n-grams and their training counts go to the bucket, which sums them over all
blocks, keeps them (the model's tables, one part for each bucket), and answers every
block. So an n-gram costs a bucket one entry for each block that holds it, however often
it stands there, and no key can overload a task; the number of buckets grows with the
corpus. What a block and a bucket exchange is one row while there are keys for it, so rows never
outnumber the distinct n-grams of blocks. Of the blocks that hold a pair, the first adds it to its history's tallies, which
go to the buckets again and come back as backoff weights. Tallies are whole numbers, from
which the bucket gets the sums of discounted counts; they pack to a fraction of the sums' bytes.
Everything that is learnt is shuffled by n-gram, nothing is broadcast but a few totals.

On disk, shuffle files go with the stage that read them, and blocks when all are scored; the
tables of words, pairs and weights, which are the model, stay.

Defined results: null text is empty (one token, the end). Rows with repeated or null doc_id
are scored each; without training texts c and N are 0 and both scores use uniform P.
Words are told apart by 64-bit hashes, pairs by their bucket and 48 bits.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from readlake.llm import bytewise
from readlake.llm.common import discard, map_batches, materialize

#: Tokens of a block, about.
BLOCK = 1_000_000
#: Tokens of the corpus for each bucket.
BUCKET = 2_000_000
#: Counts up to this are discounted by Good-Turing, larger ones by ABOVE.
GT, ABOVE = 5, 0.5
#: Rows of crc32(doc_id) mod FOLDS = HELD are held out.
FOLDS, HELD = 7, 2

U = np.uint64
END = bytewise.mix(np.array([0xE0D], U))[0]
START = bytewise.mix(np.array([0x57A27], U))[0]
_KEY48 = U((1 << 48) - 1)


def pack(x: np.ndarray, width: int, delta: bool = False) -> bytes:
    """Unsigned numbers by byte planes, compressed; sorted ones as differences."""
    x = x.astype(U)
    if delta and len(x):
        x = np.diff(x, prepend=U(0))
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()
    return len(x).to_bytes(8, "little") + bytes([width, delta]) + pa.Codec("zstd", 3).compress(raw, asbytes=True)


def unpack(data: bytes) -> np.ndarray:
    n, width, delta = int.from_bytes(data[:8], "little"), data[8], data[9]
    raw = np.frombuffer(pa.Codec("zstd").decompress(data[10:], n * width, asbytes=True), np.uint8)
    x = np.zeros((n, 8), np.uint8)
    x[:, :width] = raw.reshape(width, n).T
    x = x.view(U).ravel()
    return np.cumsum(x, dtype=U) if delta else x


def _floats(x: np.ndarray) -> bytes:
    return pack(np.ascontiguousarray(x, float).view(U), 8)


def _buckets(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> U(32)) % U(buckets)).astype(np.int64)


def _pairs(h: np.ndarray, idx: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of a block: history and word index (the start mark is len(h)), hash, and each token's pair."""
    before = np.empty(len(idx), np.int64)
    before[1:] = idx[:-1]
    before[ptr[:-1]] = len(h)
    code, inverse = np.unique(before * (len(h) + 1) + idx, return_inverse=True)
    first, second = code // (len(h) + 1), code % (len(h) + 1)
    with np.errstate(over="ignore"):
        mixed = bytewise.mix(np.append(h, START)[first] * U(0x9E3779B97F4A7C15) + h[second] * U(0xC2B2AE3D27D4EB4F))
    return first, second, mixed, inverse


def _blocks(documents: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, made = TaskContext.get().partitionId(), 0
        ids, held, counts, hashes, n = [], [], [], [], 0

        def block() -> pa.RecordBatch:
            nonlocal made, n
            sizes = np.concatenate(counts)
            uniq, idx = np.unique(np.concatenate(hashes), return_inverse=True)
            train = np.repeat(~np.array(held), sizes)
            tf = np.bincount(idx[train], minlength=len(uniq))
            # Frequent words get small numbers, which compress better.
            order = np.argsort(-np.bincount(idx), kind="stable")
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            out = pa.RecordBatch.from_arrays(
                [pa.array([part << 24 | made]), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())), pa.array([n]), pa.array([int(train.sum())]), pa.array([len(held) - sum(held)]),
                 *(pa.array([x], pa.binary()) for x in (pack(sizes, 5), pack(uniq, 8, True), pack(tf, 5), pack(order, 4), pack(place[idx], 4)))],
                names=["block", "ids", "held", "tokens", "train", "train_docs", "sizes", "words", "tf", "order", "index"])
            made, n = made + 1, 0
            for x in (ids, held, counts, hashes):
                x.clear()
            return out

        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for w in bytewise.scan(batch.column("text")):
                own = doc_ids[w.lo : w.hi]
                ids += own
                held += [zlib.crc32(b"" if d is None else str(d).encode()) % FOLDS == HELD for d in own]
                # The end token stands after each text's words.
                hashes.append(np.insert(w.hashes(), w.ptr[1:], END))
                counts.append(w.counts + 1)
                n += len(hashes[-1])
                if n >= BLOCK:
                    yield block()
        if ids:
            yield block()

    return documents.select("doc_id", "text").mapInArrow(
        run, "block bigint, ids array<bigint>, held array<boolean>, tokens bigint, train bigint, train_docs bigint, sizes binary, words binary, tf binary, order binary, index binary")


def _open(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, each token's word, and the bounds of texts."""
    order = unpack(row["order"]).astype(np.int64)
    idx = order[unpack(row["index"]).astype(np.int64)]
    return unpack(row["words"]), idx, np.concatenate([[0], np.cumsum(unpack(row["sizes"]).astype(np.int64))])


def _asked(keys: np.ndarray, tf: np.ndarray, bucket: np.ndarray, block: int, width: int) -> pa.RecordBatch:
    """A block's keys and training counts by bucket, keys sorted in each."""
    order = np.lexsort((keys, bucket))
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    bounds = [*cuts.tolist(), len(order)]
    rows = [(int(bucket[order[a]]), pack(keys[order[a:b]], width, True), pack(tf[order[a:b]], 5)) for a, b in zip(bounds, bounds[1:], strict=False)]
    cols = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array([block] * len(rows), pa.int64()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.binary())], names=["bucket", "block", "keys", "tf"])


_ASKED = "bucket bigint, block bigint, keys binary, tf binary"
_ANSWER = "bucket bigint, block bigint, answer binary, keys binary, types bigint, " + ", ".join(f"n{r} bigint" for r in range(1, GT + 2))


def _ask_words(batch: pa.RecordBatch, buckets: int) -> Iterator[pa.RecordBatch]:
    for row in batch.to_pylist():
        h = unpack(row["words"])
        yield _asked(h, unpack(row["tf"]), _buckets(h, buckets), row["block"], 8)


def _ask_pairs(batch: pa.RecordBatch, buckets: int) -> Iterator[pa.RecordBatch]:
    for row in batch.to_pylist():
        h, idx, ptr = _open(row)
        _, _, mixed, inverse = _pairs(h, idx, ptr)
        train = np.repeat(~np.array(row["held"]), np.diff(ptr))
        yield _asked(mixed & _KEY48, np.bincount(inverse[train], minlength=len(mixed)), _buckets(mixed, buckets), row["block"], 6)


def _count(table: pa.Table) -> pa.Table:
    """One bucket: sums over blocks; answers are twice the count, plus 1 for the first block."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    keys = [unpack(r["keys"]) for r in rows]
    every, tf = np.concatenate(keys), np.concatenate([unpack(r["tf"]) for r in rows]).astype(np.int64)
    uniq, first, inverse = np.unique(every, return_index=True, return_inverse=True)
    total = np.bincount(inverse, tf, len(uniq)).astype(np.int64)
    answer = 2 * total[inverse]
    answer[first] += 1
    ends = np.cumsum([len(k) for k in keys])
    parts = np.split(answer, ends[:-1])
    seen = total > 0
    of = np.bincount(np.minimum(total, GT + 2), minlength=GT + 3)
    bucket, width = rows[0]["bucket"], 8 if int(every.max(initial=0)) >> 48 else 6
    out = [{"bucket": bucket, "block": r["block"], "answer": pack(p, 5)} for r, p in zip(rows, parts, strict=True)]
    out.append({"bucket": bucket, "block": -1, "answer": pack(total[seen], 5), "keys": pack(uniq[seen], width, True), "types": int(seen.sum())} | {f"n{r}": int(of[r]) for r in range(1, GT + 2)})
    kinds = [("bucket", pa.int64()), ("block", pa.int64()), ("answer", pa.binary()), ("keys", pa.binary()), ("types", pa.int64()), *((f"n{r}", pa.int64()) for r in range(1, GT + 2))]
    return pa.Table.from_pylist(out, pa.schema(kinds))


class Discounts:
    """Discount factors by count."""

    def __init__(self, n: list[int]):
        """``n``: how many n-grams have the counts 1, 2, ... GT + 1."""
        self.d = [1.0]
        n = [0, *n]
        far = (GT + 1) * n[GT + 1] / n[1] if n[1] else 1.0
        for r in range(1, GT + 1):
            good = ((r + 1) * n[r + 1] / n[r] / r - far) / (1 - far) if n[r] and far < 1 else 0.0
            self.d.append(good if 0 < good < 1 else (r - ABOVE) / r)

    def mass(self, count: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        small = np.array(self.d)[np.minimum(count, GT)] * count
        return np.where(count <= GT, small, count - ABOVE)

    def sums(self, tally: np.ndarray) -> np.ndarray:
        """Discounted counts added up, from columns of ``_tally``."""
        return (np.array(self.d)[1:] * np.arange(1, GT + 1)) @ tally[:GT] + tally[GT + 1] - ABOVE * tally[GT]


def _tally(count: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """A column for each of ``size`` places: how many counts there are 1, 2, ... GT, how many are larger, and what those add up to."""
    far = count > GT
    kind = np.bincount(np.minimum(count - 1, GT) * size + at, minlength=(GT + 1) * size).reshape(GT + 1, size)
    return np.vstack([kind, np.bincount(at[far], count[far], size).astype(np.int64)])


def _totals(table: DataFrame) -> tuple[int, Discounts]:
    r = table.filter("block < 0").agg(F.sum("types"), *[F.sum(f"n{i}") for i in range(1, GT + 2)]).first()
    return int(r[0] or 0), Discounts([int(x or 0) for x in tuple(r)[1:]])


def _answers(table: DataFrame, name: str, what: str = "answer") -> DataFrame:
    """A row for each block, with its answers by bucket."""
    return table.filter("block >= 0").groupBy("block").agg(F.array_sort(F.collect_list(F.struct("bucket", what))).alias(name))


def _told(answers: list[dict] | None, what: str = "answer") -> np.ndarray:
    return np.concatenate([unpack(a[what]) for a in answers]) if answers else np.empty(0, U)


def _score(batch: pa.RecordBatch, buckets: int, n: int, types: int, docs: int, uni: Discounts, bi: Discounts, unseen: float) -> Iterator[pa.RecordBatch]:
    """Scores without backoff weights, what they wait for, and the block's part of histories' tallies."""
    for row in batch.to_pylist():
        h, idx, ptr = _open(row)
        c = np.empty(len(h), np.int64)
        c[np.lexsort((h, _buckets(h, buckets)))] = _told(row["uni"]).astype(np.int64) >> 1
        first, second, mixed, inverse = _pairs(h, idx, ptr)
        told = np.empty(len(mixed), np.int64)
        told[np.lexsort((mixed & _KEY48, _buckets(mixed, buckets)))] = _told(row["bi"]).astype(np.int64)
        r, own = told >> 1, (told & 1).astype(bool)
        p1 = np.where(c > 0, uni.mass(c) / max(n, 1), unseen)
        before = np.append(c, docs)[first]
        mass = bi.mass(r)
        wait = (r == 0) & (before > 0)
        logp = np.where(r > 0, np.log10(np.where(r > 0, mass, 1) / np.maximum(before, 1)), np.log10(p1[second]))
        size = np.diff(ptr)
        doc = np.repeat(np.arange(len(size)), size)
        count = lambda x: np.bincount(doc, x, len(size))  # noqa: B023, E731
        base = np.log10((c + 1) / (n + types + 1))
        hist = np.append(h, START)
        # Histories whose weight is needed, in the order in which answers come.
        need = np.unique(first[wait])
        need = need[np.lexsort((hist[need], _buckets(hist[need], buckets)))]
        place = np.full(len(hist), -1, np.int64)
        place[need] = np.arange(len(need))
        tokens = np.flatnonzero(wait[inverse])
        waiting = np.unique(doc[tokens] * (len(need) + 1) + place[first[inverse[tokens]]], return_counts=True)
        own &= r > 0
        # A word that follows in training has a count, so its share of P(w) comes from a tally too. (One without a
        # count stands here only where its pair shares bucket and 48 bits with a seen one; it counts as seen once.)
        pair, word = (_tally(x[own], first[own], len(hist)) for x in (r, np.maximum(c, 1)[second]))
        some = np.flatnonzero(np.bincount(first[own], minlength=len(hist)))
        bucket = _buckets(hist, buckets)
        docs_row = {
            "block": row["block"], "bucket": -1, "ids": row["ids"], "held": row["held"], "n_tokens": size.tolist(), "n_known": count(c[idx] > 0).astype(np.int64).tolist(),
            "base": count(base[idx]).tolist(), "score": count(logp[inverse]).tolist(),
            "a": pack(waiting[0], 8, True), "b": pack(waiting[1], 5), "n_need": len(need)}
        out = [docs_row]
        some = some[np.lexsort((hist[some], bucket[some]))]
        for b in np.unique(np.concatenate([bucket[some], bucket[need]])).tolist():
            s, q = some[bucket[some] == b], need[bucket[need] == b]
            out.append({"block": row["block"], "bucket": b, "a": pack(hist[s], 8, True), "b": pack(pair[:, s].ravel(), 6), "c": pack(word[:, s].ravel(), 6), "need": pack(hist[q], 8, True)})
        yield pa.RecordBatch.from_pylist(out, _PARTIAL_ARROW)


_PARTIAL = ("block bigint, bucket bigint, ids array<bigint>, held array<boolean>, n_tokens array<bigint>, n_known array<bigint>, base array<double>, score array<double>, "
            "a binary, b binary, c binary, need binary, n_need bigint")
_ARROW = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<boolean>": pa.list_(pa.bool_()), "array<double>": pa.list_(pa.float64())}
_PARTIAL_ARROW = pa.schema([(x.split()[0], _ARROW[x.split()[1]]) for x in _PARTIAL.split(", ")])


def _weigh(table: pa.Table, n: int, uni: Discounts, bi: Discounts) -> pa.Table:
    """One bucket of histories: their backoff weights, and the answers to blocks."""
    rows = sorted(table.select(["bucket", "block", "a", "b", "c", "need"]).to_pylist(), key=lambda r: r["block"])
    keys, inverse = np.unique(np.concatenate([unpack(r["a"]) for r in rows]), return_inverse=True)
    pair, word = (np.stack([np.bincount(inverse, x, len(keys)) for x in np.hstack([unpack(r[c]).reshape(GT + 2, -1) for r in rows])]) for c in "bc")
    # A history's pairs add up to its count.
    total = np.arange(1, GT + 1) @ pair[:GT] + pair[GT + 1]
    alpha = np.maximum(1 - bi.sums(pair) / np.maximum(total, 1), 1e-300) / np.maximum(1 - uni.sums(word) / max(n, 1), 1e-12)
    out = [{"bucket": rows[0]["bucket"], "block": r["block"], "answer": _floats(np.log10(alpha[np.searchsorted(keys, unpack(r["need"]))]))} for r in rows]
    out.append({"bucket": rows[0]["bucket"], "block": -1, "answer": _floats(alpha), "keys": pack(keys, 8, True)})
    return pa.Table.from_pylist(out, pa.schema([("bucket", pa.int64()), ("block", pa.int64()), ("answer", pa.binary()), ("keys", pa.binary())]))


def _finish(batch: pa.RecordBatch, n: int) -> Iterator[pa.RecordBatch]:
    for row in batch.to_pylist():
        score = np.array(row["score"])
        code, many = unpack(row["a"]).astype(np.int64), unpack(row["b"]).astype(float)
        if len(code):
            alpha = _told(row["alpha"]).view(float)
            score += np.bincount(code // (row["n_need"] + 1), many * alpha[code % (row["n_need"] + 1)], len(score))
        yield pa.RecordBatch.from_arrays(
            [pa.array(row["ids"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(row["n_tokens"], pa.int64()), pa.array(row["n_known"], pa.int64()), pa.array([n] * len(score), pa.int64()), pa.array(row["base"], pa.float64()), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])


def score(documents: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    blocks = materialize(_blocks(documents), "lm-blocks", tidy=True)
    tokens, n, docs = (int(x or 0) for x in blocks.agg(F.sum("tokens"), F.sum("train"), F.sum("train_docs")).first())
    buckets = max(1, -(-tokens // BUCKET))
    spread = lambda df: df.repartition(buckets, "bucket").groupBy("bucket")
    words = materialize(spread(map_batches(blocks.select("block", "words", "tf"), lambda b: _ask_words(b, buckets), _ASKED)).applyInArrow(_count, _ANSWER), "lm-words", tidy=True)
    types, uni = _totals(words)
    pairs = materialize(spread(map_batches(blocks, lambda b: _ask_pairs(b, buckets), _ASKED)).applyInArrow(_count, _ANSWER), "lm-pairs", tidy=True)
    _, bi = _totals(pairs)
    # What Good-Turing leaves for unseen words, from the counts of counts.
    mass = words.filter("block < 0").select("answer").mapInArrow(
        lambda batches: (pa.RecordBatch.from_arrays([pa.array([float(uni.mass(unpack(x).astype(np.int64)).sum()) for x in b.column(0).to_pylist()], pa.float64())], names=["m"]) for b in batches), "m double")
    seen = mass.agg(F.sum(F.col("m").cast("decimal(38,9)")).cast("double")).first()[0] or 0.0
    unseen = max(1 - seen / n, 1 / (n + types + 1)) if n else 1 / (n + types + 1)
    asked = blocks.select("block", "ids", "held", "sizes", "words", "order", "index").join(_answers(words, "uni"), "block").join(_answers(pairs, "bi"), "block")
    partial = materialize(map_batches(asked, lambda b: _score(b, buckets, n, types, docs, uni, bi, unseen), _PARTIAL), "lm-partial", tidy=True)
    discard(blocks)
    weights = materialize(spread(partial.filter("bucket >= 0").select("bucket", "block", "a", "b", "c", "need")).applyInArrow(lambda t: _weigh(t, n, uni, bi), "bucket bigint, block bigint, answer binary, keys binary"), "lm-weights", tidy=True)
    done = partial.filter("bucket < 0").select("block", "ids", "held", "n_tokens", "n_known", "base", "score", "a", "b", "n_need").join(_answers(weights, "alpha"), "block", "left")
    return map_batches(done, lambda b: _finish(b, n), "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def brute_force(docs: list[tuple]) -> list[tuple]:
    """The model in plain Python, for tests."""
    import math
    import re
    from collections import Counter

    rx = re.compile(r"[^\x20\x09-\x0D]+")
    rows = []
    for d, text in docs:
        words = rx.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        rows.append((d, zlib.crc32(b"" if d is None else str(d).encode()) % FOLDS == HELD, [*words, None]))
    c, pair, hist = Counter(), Counter(), Counter()
    for _, held, t in rows:
        if not held:
            c.update(t)
            pair.update(zip(["", *t], t, strict=False))
            hist.update(["", *t[:-1]])
    n, types = sum(c.values()), len(c)
    uni, bi = (Discounts([sum(v == r for v in x.values()) for r in range(1, GT + 2)]) for x in (c, pair))
    mass = lambda d, r: float(d.mass(np.array([r]))[0])
    unseen = max(1 - sum(mass(uni, v) for v in c.values()) / n, 1 / (n + types + 1)) if n else 1 / (types + 1)
    p1 = lambda w: mass(uni, c[w]) / n if c[w] else unseen
    seen, lower = Counter(), Counter()
    for (a, w), r in pair.items():
        seen[a] += mass(bi, r) / hist[a]
        lower[a] += p1(w)

    def p(a, w):
        if pair[a, w]:
            return mass(bi, pair[a, w]) / hist[a]
        return (1 - seen[a]) / max(1 - lower[a], 1e-12) * p1(w) if hist[a] else p1(w)

    return [(d, held, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 1) / (n + types + 1)) for w in t), sum(math.log10(p(a, w)) for a, w in zip(["", *t], t, strict=False))) for d, held, t in rows]
