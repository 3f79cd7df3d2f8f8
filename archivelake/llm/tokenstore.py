"""Token-id shards with a minimal perfect hash index over document keys.

File format.  A store is a Parquet table of shards, so that any file system that
Spark reaches can hold it; a shard is one binary value:

    "TKS1"  keys:u32  buckets:u32  records:u32  nulls:u32  width:u32
    displacement  i32[buckets]      slot or seed of each bucket of the hash
    fingerprint   u32[keys]         of the key that owns the slot
    first         u32[keys]         its first record
    count         u32[keys]         its number of records (repeated keys)
    key           i64[records]      in ascending order, null keys first
    offset        u64[records + 1]  into the ids
    ids           u16 or u32[offset[records]], by width (2 where all ids fit)

All integers are little-endian.  A key is looked up by hashing it to a bucket,
that bucket's displacement to a slot, and comparing the stored fingerprint and then the
key of the slot's first record: constant time, with no search.  The columns beside the shard say which keys and
how many ids it holds and where its ids begin in its partition.

Nulls: a null text counts as empty; null keys come first in a shard and are read
by ``Shard.nulls``.  Rows that repeat a key are records of their own, found
together, in the order of a hash of their texts.  A very long text is encoded whole and
ends its shard.  An empty table gives an empty store.  Other columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick
from .textkernel import mix
from .tokenizing import encoder, runs

_SALT = np.uint64(0xD6E8FEB86659FD93)
SHARDS = "part int, part_start long, n_docs long, n_tokens long, first_key long, last_key long, shard binary"
_ARROW = pa.schema([("part", pa.int32()), *[(n, pa.int64()) for n in ("part_start", "n_docs", "n_tokens", "first_key", "last_key")], ("shard", pa.binary())])


def _hashes(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys.astype(np.int64).view(np.uint64) + _SALT)


def _prints(hashes: np.ndarray) -> np.ndarray:
    return (mix(hashes ^ _SALT) >> np.uint64(32)).astype(np.uint32)


def _slots(hashes: np.ndarray, seed, size: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(hashes + np.asarray(seed, np.uint64) * _SALT) % np.uint64(size)).astype(np.int64)


def perfect_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(displacements, slot of each hash) of a minimal perfect hash of distinct hashes.

    Buckets of about four are placed from the largest: the first seed that sends
    all of a bucket to free slots is its displacement; a bucket of one takes any
    free slot, written as -1 - slot.
    """
    n = len(hashes)
    buckets = max(1, (n + 3) // 4)
    at = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(at, kind="stable")
    sizes = np.bincount(at, minlength=buckets)
    begin = np.concatenate([[0], np.cumsum(sizes)])
    displacement, slot, free = np.zeros(buckets, np.int32), np.zeros(n, np.int64), np.ones(n, bool)
    by_size = np.argsort(-sizes, kind="stable")
    for b in by_size[sizes[by_size] > 1]:
        own = order[begin[b] : begin[b + 1]]
        low = 0
        while True:
            seeds = np.arange(low, low + 64, dtype=np.uint64)
            to = _slots(hashes[own][:, None], seeds[None, :], n)
            fits = free[to].all(0)
            for k in np.flatnonzero(fits):
                if len(np.unique(to[:, k])) == len(own):
                    break
            else:
                low += 64
                continue
            break
        displacement[b], slot[own] = low + k, to[:, k]
        free[to[:, k]] = False
    left = iter(np.flatnonzero(free))
    for b in by_size[sizes[by_size] == 1]:
        s = next(left)
        displacement[b], slot[order[begin[b]]] = -1 - s, s
    return displacement, slot


def build_shard(keys: list[int | None], ids: list[bytes]) -> bytes:
    """The shard of records in key order, null keys first; ids as little-endian unsigned 32-bit integers."""
    nulls = sum(k is None for k in keys)
    own = np.array([k or 0 for k in keys], np.int64)
    distinct, first, count = np.unique(own[nulls:], return_index=True, return_counts=True)
    hashes = _hashes(distinct)
    displacement, slot = perfect_hash(hashes)
    prints, firsts, counts = (np.zeros(len(distinct), "<u4") for _ in range(3))
    prints[slot], firsts[slot], counts[slot] = _prints(hashes), first + nulls, count
    offset = np.concatenate([[0], np.cumsum([len(x) // 4 for x in ids])]).astype("<u8")
    payload = np.frombuffer(b"".join(ids), "<u4")
    width = 2 if not len(payload) or payload.max() < 1 << 16 else 4
    head = struct.pack("<4s5I", b"TKS1", len(distinct), len(displacement), len(keys), nulls, width)
    return b"".join([head, displacement.astype("<i4").tobytes(), prints.tobytes(), firsts.tobytes(), counts.tobytes(), own.astype("<i8").tobytes(), offset.tobytes(), payload.astype(f"<u{width}").tobytes()])


class Shard:
    """Reads a shard; ``get`` takes keys to their records in constant time each."""

    def __init__(self, data: bytes) -> None:
        magic, n, buckets, self.records, self.null_records, width = struct.unpack_from("<4s5I", data)
        if magic != b"TKS1":
            raise ValueError("not a shard of token ids")
        at = 24
        parts = []
        for kind, size in (("<i4", buckets), ("<u4", n), ("<u4", n), ("<u4", n), ("<i8", self.records), ("<u8", self.records + 1)):
            parts.append(np.frombuffer(data, kind, size, at))
            at += parts[-1].nbytes
        self.displacement, self.prints, self.first, self.count, self.keys, self.offset = parts
        self.ids = np.frombuffer(data, f"<u{width}", int(self.offset[-1]), at)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 where the shard doesn't hold it."""
        if not len(self.prints):
            return np.full(len(keys), -1)
        hashes = _hashes(keys)
        d = self.displacement[(hashes % np.uint64(len(self.displacement))).astype(np.int64)].astype(np.int64)
        slot = np.where(d < 0, -1 - d, _slots(hashes, np.maximum(d, 0), len(self.prints)))
        return np.where(self.prints[slot] == _prints(hashes), slot, -1)

    def get(self, key: int) -> list[bytes]:
        """The ids of each record of ``key``; none if the shard doesn't hold it."""
        slot = int(self.slots(np.array([key]))[0])
        # Another key may have the same fingerprint.
        if slot < 0 or self.keys[self.first[slot]] != key:
            return []
        return [self.record(r) for r in range(self.first[slot], self.first[slot] + self.count[slot])]

    def record(self, r: int) -> bytes:
        return self.ids[int(self.offset[r]) : int(self.offset[r + 1])].astype("<u4").tobytes()

    def nulls(self) -> list[bytes]:
        return [self.record(r) for r in range(self.null_records)]


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int, keep_space: bool = False, shard_bytes: int = 1 << 20) -> None:
    """Encodes ``docs(doc_id, text)`` and writes the store to ``path``.

    The texts are dealt by range of doc_id before they are encoded, so that each
    is encoded once, in key order; a hash of the text splits a repeated key.
    """

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, keep_space).encode
        end, part = np.array([end_id], "<u4").tobytes(), TaskContext.get().partitionId()
        keys: list[int | None] = []
        ids: list[bytes] = []
        start = size = 0

        def row() -> pa.RecordBatch:
            known = [k for k in keys if k is not None]
            values = (part, start, len(keys), size // 4, known[0] if known else None, known[-1] if known else None, build_shard(keys, ids))
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, _ARROW, strict=True)], schema=_ARROW)

        for batch in batches:
            doc_ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in runs(texts, 1 << 22):
                for doc_id, encoded in zip(doc_ids[a:b], encode([t or "" for t in texts[a:b]]), strict=True):
                    keys.append(doc_id)
                    ids.append(encoded + end)
                    size += len(encoded) + 4
                    if size >= shard_bytes:
                        yield row()
                        start += size // 4
                        size = 0
                        keys.clear()
                        ids.clear()
        if keys:
            yield row()

    tie = F.xxhash64("text")
    (
        pick(docs, "doc_id", "text")
        .repartitionByRange("doc_id", tie)
        .sortWithinPartitions("doc_id", tie)
        .mapInArrow(shards, SHARDS)
        .write.parquet(path)
    )


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The shards of a store, with ``start``: the number of ids before each in the whole store.

    Only one total per partition comes to the driver and goes back to be joined.
    """
    shards = spark.read.schema(SHARDS).parquet(path)
    before, bases = 0, []
    for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect():
        bases.append((r.part, before))
        before += r.n
    starts = spark.createDataFrame(bases, "part int, base long")
    # One row of two integers per written partition.
    return shards.join(F.broadcast(starts), "part").withColumn("start", F.col("base") + F.col("part_start")).drop("base")


def read_records(shards: DataFrame, measure) -> DataFrame:
    """doc_id, start, n_tokens and ``measure(ids)`` as ids_crc32 of every record, each found by its key."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                shard = Shard(data.as_buffer())
                rows = [(None, r) for r in range(shard.null_records)]
                keys = np.unique(shard.keys[shard.null_records :])
                slots = shard.slots(keys)
                if (slots < 0).any():
                    raise ValueError("a key of the shard isn't found by its index")
                rows += [(int(k), r) for k, s in zip(keys, slots, strict=True) for r in range(shard.first[s], shard.first[s] + shard.count[s])]
                at = [r for _, r in rows]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([k for k, _ in rows], pa.int64()),
                    "start": pa.array(start + shard.offset[at].astype(np.int64), pa.int64()),
                    "n_tokens": pa.array((shard.offset[np.array(at, int) + 1] - shard.offset[at]).astype(np.int64), pa.int64()),
                    "ids_crc32": pa.array([measure(shard.record(r)) for r in at], pa.int64()),
                })

    return shards.select("start", "shard").mapInArrow(records, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(shards: DataFrame, keys: list[int]) -> DataFrame:
    """doc_id and ids (array) of the records of ``keys``, a short list: only
    shards whose key range holds one of them are read."""
    wanted = sorted(set(keys))
    near = F.lit(False)
    for k in wanted:
        near = near | F.lit(k).between(F.col("first_key"), F.col("last_key"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                shard = Shard(data.as_py())
                rows = [(k, np.frombuffer(x, "<u4").astype(np.int64)) for k in wanted for x in shard.get(k)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array([k for k, _ in rows], pa.int64()), "ids": pa.array([x for _, x in rows], pa.list_(pa.int64()))})

    return shards.where(near).select("shard").mapInArrow(found, "doc_id long, ids array<long>")
