"""Token-ID output in training order.

Texts become token ids of a public byte-level BPE vocabulary (its file is a parameter, read
by the driver and broadcast). Documents, each followed by an end token, form one stream that
is cut into sequences of ``seq_len`` tokens; prefix sums of token counts (a running sum in
each partition, then one of the partitions' totals) give every document its place in the
stream, which follows the order of the input's partitions and rows. A keyed Feistel
permutation with cycle-walking maps a sequence's number to its
slot, a bijection on 0 .. n - 1 that any task computes alone. Slots are dealt to shards by
range, and each shard is a file of fixed-stride records (little-endian uint16), so a reader
finds slot s in shard s // shard_rows at byte (s % shard_rows) * stride and can resume there.

Files are written under a temporary name and renamed, so a retried or duplicate task leaves
one whole file. The call writes all shards before it returns; ``manifest.json``, which names
all that a reader needs, is written after the last of them, so a folder with a manifest is whole.

Defined results: null or empty text has no tokens and no end token; the last sequence is
filled with end tokens; repeated rows stand in the stream each; an empty table gives a
manifest and no shards. Columns beyond doc_id and text are not used.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from readlake.llm import bytewise
from readlake.llm.common import broadcast_if_small, discard, map_batches, materialize, release, scratch_path, small_batches

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public pre-tokenisation pattern of that vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Id after each document; ids fit uint16.
END = 50256
SEQ_LEN = 1024
#: Records of a shard: 16 MB at 1024 tokens.
SHARD_ROWS = 8192
#: Documents that are packed in one row, and its compression.
ROWS, LEVEL = 1000, 9
#: Beyond so many shards a task writes several, of so many bytes in all.
TASKS, TASK_BYTES = 2000, 512 << 20
KEY = 0x5EED
ROUNDS = 6

U = np.uint64
_made: dict[str, object] = {}


def tokenizer(data: bytes):
    """An encoder from the bytes of a rank file, made once in a process."""
    import tiktoken

    name = hashlib.sha256(data).hexdigest()
    if name not in _made:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        if max(ranks.values()) >= END:
            raise ValueError("ids must be below the end token")
        _made[name] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[name]


def permute(x: np.ndarray, n: int, key: int = KEY, inverse: bool = False) -> np.ndarray:
    """Slots of sequence numbers (or back): a Feistel network over the next even power of
    two, walked until the value is below ``n``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = U((1 << half) - 1), U(half)
    keys = bytewise.mix(np.arange(1, ROUNDS + 1, dtype=U) + U(key))

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v >> shift, v & mask
        for k in keys[::-1] if inverse else keys:
            if inverse:
                left, right = right ^ (bytewise.mix(left ^ k) & mask), left
            else:
                left, right = right, left ^ (bytewise.mix(right ^ k) & mask)
        return (left << shift) | right

    out = once(np.asarray(x).astype(U))
    while len(out) and (far := np.flatnonzero(out >= U(n))).size:
        out[far] = once(out[far])
    return out.astype(np.int64)


_TOKENS = "part bigint, batch bigint, before bigint, total bigint, doc_ids array<bigint>, sizes array<bigint>, tokens binary"


def tokenize(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each batch of documents: its place (part, batch), the tokens before it in its
    part, doc_ids, sizes (in tokens, with the end token; texts without tokens are left out) and the
    tokens (compressed uint16)."""
    spark = documents.sparkSession
    small_batches(spark)
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before, made = tokenizer(shared.value).encode_to_numpy, TaskContext.get().partitionId(), 0, 0
        end, codec = np.array([END], "<u2"), pa.Codec("zstd", LEVEL)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                cut = batch.slice(at, ROWS)
                cut = cut.filter(pc.greater(pc.fill_null(pc.binary_length(cut.column("text")), 0), 0))
                tokens = [x for t in cut.column("text") for x in (encode(t.as_py(), disallowed_special=()).astype("<u2"), end)]
                sizes = np.array([len(t) + 1 for t in tokens[::2]], np.int64)
                total = int(sizes.sum())
                if total:
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([x], pa.int64()) for x in (part, made, before, total)), pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), cut.column("doc_id")),
                         bytewise.list_array(sizes, np.array([0, len(sizes)]), pa.int64()), pa.array([codec.compress(np.concatenate(tokens).tobytes(), asbytes=True)], pa.binary())],
                        names=["part", "batch", "before", "total", "doc_ids", "sizes", "tokens"])
                before, made = before + total, made + 1
                del tokens, cut
            release()

    return documents.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, _TOKENS)


def _cut(batch: pa.RecordBatch, n: int, seq_len: int, shard_rows: int, key: int) -> Iterator[pa.RecordBatch]:
    """What each batch of documents has for each shard: one compressed row of pieces, by slot."""
    codec, packed = pa.Codec("zstd"), pa.Codec("zstd", LEVEL)
    for i in range(batch.num_rows):
        ids, count, total = batch.column("doc_ids")[i].values, batch.column("sizes")[i].values.to_numpy(), batch.column("total")[i].as_py()
        data = np.frombuffer(codec.decompress(batch.column("tokens")[i].as_py(), 2 * total, asbytes=True), "<u2")
        own = np.cumsum(count) - count
        start = own + batch.column("start")[i].as_py()
        first, last = start // seq_len, (start + count - 1) // seq_len
        many = last - first + 1
        row = np.repeat(np.arange(len(many)), many)
        seq = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        lo, hi = np.maximum(seq * seq_len, start[row]), np.minimum((seq + 1) * seq_len, (start + count)[row])
        slot = permute(seq, n, key)
        order = np.lexsort((lo, slot))
        slot, seq, row, lo, hi = (x[order] for x in (slot, seq, row, lo, hi))
        shard, begin = slot // shard_rows, lo - start[row] + own[row]
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)], strict=True):
            body = np.concatenate([data[x : x + size] for x, size in zip(begin[a:b].tolist(), (hi - lo)[a:b].tolist(), strict=True)]).tobytes()
            lists = [pa.array([v], pa.list_(pa.int64())) for v in (slot[a:b], seq[a:b], lo[a:b] - seq[a:b] * seq_len, hi[a:b] - lo[a:b])]
            docs = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), ids.take(pa.array(row[a:b])))
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard[a]], pa.int64()), *lists, docs, pa.array([packed.compress(body, asbytes=True)], pa.binary())],
                names=["shard", "slot", "sequence", "at", "size", "doc_id", "data"])


_PIECES = "shard bigint, slot array<bigint>, sequence array<bigint>, at array<bigint>, size array<bigint>, doc_id array<bigint>, data binary"
_INDEX = "slot bigint, sequence bigint, shard bigint, byte_offset bigint, n_tokens bigint, doc_ids array<bigint>, sha256 string"


class _Shard:
    """One shard's records while they are filled, and what is known of its pieces."""

    def __init__(self, shard: int, n: int, seq_len: int, shard_rows: int):
        self.shard, self.first = shard, shard * shard_rows
        self.records = np.full((min(shard_rows, n - self.first), seq_len), END, "<u2")
        self.known: list[tuple[np.ndarray, ...]] = []
        self.docs: list[pa.Array] = []

    def add(self, row: pa.RecordBatch) -> None:
        """Copies the pieces of a row of one."""
        slot, seq, at, size = (row.column(c)[0].values.to_numpy() for c in ("slot", "sequence", "at", "size"))
        data, past = np.frombuffer(pa.Codec("zstd").decompress(row.column("data")[0].as_py(), 2 * int(size.sum()), asbytes=True), "<u2"), 0
        for s, a, m in zip((slot - self.first).tolist(), at.tolist(), size.tolist(), strict=True):
            self.records[s, a : a + m] = data[past : past + m]
            past += m
        self.known.append((slot, seq, at, size))
        self.docs.append(row.column("doc_id")[0].values)

    def write(self, where: fs.FileSystem, root: str) -> pa.RecordBatch:
        """The file, and its rows of the index."""
        name = f"{root}/.shard-{self.shard:06d}-{TaskContext.get().taskAttemptId()}"
        with where.open_output_stream(name) as stream:
            stream.write(memoryview(self.records).cast("B"))
        where.move(name, f"{root}/shard-{self.shard:06d}.bin")
        slot, seq, at, size = (np.concatenate(x) for x in zip(*self.known, strict=True))
        order = np.lexsort((at, slot))
        slot, seq, size, docs = slot[order], seq[order], size[order], pa.concat_arrays(self.docs).take(pa.array(order))
        cuts = np.flatnonzero(np.diff(slot, prepend=-1))
        bounds = pa.array(np.append(cuts, len(slot)).astype(np.int32))
        local = slot[cuts] - self.first
        said = [hashlib.sha256(self.records[i].tobytes()).hexdigest() for i in local.tolist()]
        cols = [slot[cuts], seq[cuts], np.full(len(cuts), self.shard), local * self.records.shape[1] * 2, np.add.reduceat(size, cuts)]
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.ListArray.from_arrays(bounds, docs), pa.array(said)], names=["slot", "sequence", "shard", "byte_offset", "n_tokens", "doc_ids", "sha256"])


def write_shards(documents: DataFrame, out_dir: str, vocabulary: str = VOCABULARY, seq_len: int = SEQ_LEN, shard_rows: int = SHARD_ROWS, key: int = KEY) -> DataFrame:
    """Writes the shards to ``out_dir`` (a URI), then the manifest, and returns the index.

    One row per sequence: slot, sequence, shard, byte_offset, n_tokens (without filling),
    doc_ids (in order), sha256 (of the record).
    """
    spark = documents.sparkSession
    rows = materialize(tokenize(documents, vocabulary), "tokens")
    parts = rows.groupBy("part").agg(F.sum("total").alias("n"))
    # One row for each task of the tokenising stage.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialize(parts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), "n"), "token-offsets")
    total = offsets.agg(F.sum("n")).first()[0] or 0
    n = -(-total // seq_len)
    shards = max(1, -(-n // shard_rows))
    # Some shards for each task, so that their number does not set the number of tasks.
    each = max(1, TASK_BYTES // (2 * seq_len * shard_rows)) if shards > TASKS else 1
    where, root = fs.FileSystem.from_uri(out_dir)
    where.create_dir(root, recursive=True)

    def cut(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        return _cut(batch, n, seq_len, shard_rows, key)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = fs.FileSystem.from_uri(out_dir)
        now: _Shard | None = None
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column("shard")[i].as_py()
                if now is None or now.shard != shard:
                    # Rows come sorted by shard, so the one before is whole.
                    if now is not None:
                        yield now.write(where, root)
                    now = _Shard(shard, n, seq_len, shard_rows)
                now.add(batch.slice(i, 1))
        if now is not None:
            yield now.write(where, root)
        del now
        release()

    placed = rows.join(broadcast_if_small(offsets.select("part", "base"), 16), "part").withColumn("start", F.col("base") + F.col("before")).drop("part", "batch", "base", "before")
    pieces = map_batches(placed, cut, _PIECES, 1)
    dealt = pieces.repartitionById(-(-shards // each), F.floor(F.col("shard") / each).cast("int")).sortWithinPartitions("shard")
    index = materialize(dealt.mapInArrow(write, _INDEX), "token-index")
    with where.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps({"sequences": n, "tokens": total, "seq_len": seq_len, "stride": 2 * seq_len, "shard_rows": shard_rows, "dtype": "<u2", "end": END, "key": key, "rounds": ROUNDS}).encode())
    discard(rows, offsets)
    return index


def read_slots(out_dir: str, first: int = 0, count: int | None = None) -> Iterator[np.ndarray]:
    """Sequences in training order from slot ``first`` on."""
    where, root = fs.FileSystem.from_uri(out_dir)
    with where.open_input_stream(f"{root}/manifest.json") as f:
        m = json.loads(f.read())
    last = m["sequences"] if count is None else min(m["sequences"], first + count)
    while first < last:
        shard = first // m["shard_rows"]
        upto = min(last, (shard + 1) * m["shard_rows"])
        with where.open_input_file(f"{root}/shard-{shard:06d}.bin") as f:
            f.seek(first % m["shard_rows"] * m["stride"])
            for _ in range(first, upto):
                yield np.frombuffer(f.read(m["stride"]), m["dtype"])
        first = upto


def materialise_order(documents: DataFrame) -> DataFrame:
    """``write_shards`` with production parameters, into the shared folder."""
    return write_shards(documents, scratch_path(documents.sparkSession, "token-shards"))
