"""Byte-level BPE encoding and decoding of distinct words with Spark higher-order functions.

1. One pass splits the texts into words (matches of the pattern).  A block, some
   ``BLOCK_BYTES`` of consecutive texts, becomes a row: its distinct words, in order of
   their hashes, and each text as a sequence of numbers of these.  The rows are a table,
   bucketed by block, in the session's warehouse.
2. The words of all blocks are dealt by ranges of their hash into parts of about
   ``PART_WORDS``, compressed, a row for each block and part.  A part lists its distinct
   words; each of them is folded once, by higher-order functions: bytes are handled as
   ISO 8859-1 characters, and as long as two neighbouring pieces make a ranked one, the
   pair of the lowest rank (the first on ties) is joined.  The ranks are one literal, an
   array of small maps, in which a piece is found in the map at its CRC-32 modulo the
   array's length.  Ids go back as a row for each part and block.
3. A block's ids meet its sequences, which the bucketed table needn't move: ids of
   texts are looked up by number, and decoding concatenates the pieces of ids.

A word that is in many blocks takes a place in each of their rows, so no word is a hot
key.  A fold takes time that grows with the square of a word's length: words of more than
``LONG_WORD`` bytes are joined with a heap in Python, to the same ids.

Nulls: a null text counts as empty, a null doc_id is kept.  An empty text has no
ids.  Repeated rows are encoded each by itself.  A very long text is a block of its own,
handled whole in memory.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import zlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_table, pick, release
from .textkernel import ranges, same_ranges, slices

RANK_BUCKETS = 1 << 16
LONG_WORD = 256
_SPAN = 1 << 12  # more than LONG_WORD
BLOCK_BYTES = 16 << 20
PART_WORDS = 1 << 18
#: The pattern whose matches ``class_words`` finds by classes of characters (fixed value).
CLASS_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def load_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a vocabulary file: base64 of a piece and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def _literal(value, kind: str) -> Column:
    return F.from_json(F.lit(json.dumps(value, separators=(",", ":"))), kind)


def _buckets(entries: dict[str, object], size: int) -> list[dict]:
    out: list[dict] = [{} for _ in range(size)]
    for k, v in entries.items():
        out[zlib.crc32(k.encode()) % size][k] = v
    return out


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


class Codec:
    """Column expressions for one vocabulary."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self._ranks = _literal(_buckets({k.decode("latin-1"): v for k, v in ranks.items()}, RANK_BUCKETS), "array<map<string,int>>")

    def rank(self, piece: Column) -> Column:
        """The rank of a piece, null if it has none."""
        slot = F.element_at(self._ranks, (F.crc32(piece) % RANK_BUCKETS + 1).cast("int"))
        return F.try_element_at(slot, piece)

    def fold(self, word: Column) -> Column:
        """The ids of a word (a string of bytes) as an array."""
        n = F.length(word)

        def step(parts: Column, _: Column) -> Column:
            def join(least: Column) -> Column:
                at = (least % _SPAN).cast("int")
                joined = F.transform(parts, lambda x, i: F.when(i == at, F.concat(x, F.get(parts, at + 1))).otherwise(x))
                return F.when(least.isNull(), parts).otherwise(F.filter(joined, lambda x, i: i != at + 1))

            # The rank and the position of each pair as one number, so that the least is the first of the lowest rank.
            pairs = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: self.rank(F.concat(F.get(parts, i - 1), F.get(parts, i))).cast("long") * _SPAN + i - 1)
            return F.when(F.size(parts) > 1, _let(F.array_min(pairs), join)).otherwise(parts)

        start = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(word, i, F.lit(1)))
        return F.transform(F.aggregate(F.sequence(F.lit(1), n), start, step), self.rank)

    def encode(self, word: Column) -> Column:
        """The ids of a word: its own id if it is a piece, else the fold."""
        return _let(self.rank(word), lambda own: F.when(own.isNotNull(), F.array(own)).otherwise(self.fold(word)))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a word of any length: pairs of the lowest rank, the first on ties, come off a heap."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, after, before, live = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if live[i] else n
        if j >= n or end[j] != stop:
            continue  # one of the pair has been joined meanwhile
        live[j], end[i], after[i] = False, stop, after[j]
        if after[i] < n:
            before[after[i]] = i
        for a in (before[i], i):
            if a >= 0 and after[a] < n and (r := ranks.get(word[a : end[after[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[after[a]]))
    return [ranks[word[i : end[i]]] for i in range(n) if live[i]]


_OTHER, _LETTER, _NUMBER, _SPACE = range(4)


@cache
def _classes() -> np.ndarray:
    """The class of every code point."""
    import regex

    every = "".join(map(chr, range(0xD800))) + "?" * 0x800 + "".join(map(chr, range(0xE000, 0x110000)))
    out = np.zeros(0x110000, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (_SPACE, r"\s")):
        out[[m.start() for m in regex.finditer(pattern, every)]] = kind
    return out


def class_words(text: str, begin: np.ndarray) -> np.ndarray:
    """Where words begin in texts joined to one, of which each begins at one of ``begin``:
    the matches of ``CLASS_PATTERN``, which leave no character out."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    n = len(points)
    kind = _classes()[points]
    edge = np.zeros(n + 1, bool)  # texts begin (or all end) here
    edge[begin] = True
    edge[n] = True
    new = edge.copy()
    new[1:n] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(new[:n])
    # The last of a run of white space goes with what follows if it is a blank, else it is
    # a word of its own; at the end of a text, the run is one word.
    follows = np.append(run[1:], n)
    space = (kind[run] == _SPACE) & ~edge[follows]
    last = follows[space] - 1
    new[last] = True
    blank = last[points[last] == 32]
    new[blank + 1] = False
    # An apostrophe alone and no blank before it, then s, t, m, d, re, ve or ll.
    lone = run[(points[run] == 39) & (follows - run == 1) & new[run] & ~edge[follows]]
    padded = np.concatenate([points, np.zeros(2, np.uint32)])
    one, two = padded[lone + 1], np.where(edge[np.minimum(lone + 2, n)], 0, padded[lone + 2])
    single = np.isin(one, [ord(c) for c in "stmd"])
    double = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
    new[lone[single | double] + 1] = False
    after = np.concatenate([lone[single] + 2, lone[double] + 3])
    after = after[after < n]
    new[after] = True
    return np.flatnonzero(new[:n])


def _word_ranges(texts: list[str], pattern: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, end, number of words of each text) of the matches in texts."""
    if pattern == CLASS_PATTERN:
        text = "".join(texts)
        raw = np.frombuffer(text.encode(), np.uint8)
        begin = np.cumsum([0, *map(len, texts)])
        first = class_words(text, begin[:-1][np.diff(begin) > 0]) if text else np.zeros(0, np.int64)
        count = np.diff(np.searchsorted(first, begin))
        if len(raw) > len(text):
            first = np.flatnonzero((raw & 0xC0) != 0x80)[first]
        return raw, first, np.append(first[1:], len(raw)), count
    import regex

    find = regex.compile(pattern).findall
    words = [[w.encode() for w in find(t)] for t in texts]
    at = np.cumsum([0, *map(len, chain.from_iterable(words))])
    raw = np.frombuffer(b"".join(chain.from_iterable(words)), np.uint8)
    return raw, at[:-1], at[1:], np.array([len(w) for w in words], np.int64)


def _copied(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of ranges, one after the other."""
    ends = np.cumsum(size)
    return raw[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Words:
    """Distinct words by a 64-bit hash: ``hashes`` in order, ``sizes`` and ``raw``, their bytes one after the other."""

    def __init__(self, hashes: np.ndarray, sizes: np.ndarray, raw: np.ndarray) -> None:
        self.hashes, self.sizes, self.raw = hashes, sizes, raw

    @classmethod
    def distinct(cls, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, raw: np.ndarray) -> tuple[Words, np.ndarray]:
        """The distinct ones of words at byte ranges, and the number of each word among them.
        Words of one hash are compared; should two differ, ValueError says so."""
        order = np.argsort(hashes)
        ranked = hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = ranked[1:] != ranked[:-1]
        at = order[new]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        of = at[number]
        if not same_ranges(raw, start, end, start[of], end[of]).all():
            raise ValueError("two words have one hash")
        size = (end - start)[at]
        return cls(hashes[at], size, _copied(raw, start[at], size)), number

    @classmethod
    def united(cls, many: list[Words]) -> tuple[Words, list[np.ndarray]]:
        """The distinct words of all of ``many``, and for each the numbers of its words among them."""
        sizes = np.concatenate([w.sizes for w in many])
        end = np.cumsum(sizes)
        out, number = cls.distinct(np.concatenate([w.hashes for w in many]), end - sizes, end, np.concatenate([w.raw for w in many]))
        return out, np.split(number, np.cumsum([len(w.sizes) for w in many])[:-1])

    def part(self, a: int, b: int) -> Words:
        ends = np.concatenate([[0], np.cumsum(self.sizes)])
        return Words(self.hashes[a:b], self.sizes[a:b], self.raw[ends[a] : ends[b]])

    def bytes(self) -> list[bytes]:
        raw, ends = self.raw.tobytes(), np.cumsum(self.sizes).tolist()
        return [raw[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def packed(self) -> bytes:
        return _packed(self.sizes.astype("<u4"), self.raw)

    @classmethod
    def unpacked(cls, data: bytes) -> Words:
        sizes, raw = _unpacked(data, "<u4", "u1")
        end = np.cumsum(sizes, dtype=np.int64)
        return cls(ranges(raw, end - sizes, end), sizes.astype(np.int64), raw)


def _packed(*arrays: np.ndarray) -> bytes:
    """Arrays as one compressed value, the bytes of their numbers apart by significance."""
    import zstandard

    compress = zstandard.ZstdCompressor(3).compress
    out = [compress(np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes()) for a in arrays]
    return np.array([x for a, o in zip(arrays, out, strict=True) for x in (len(a), len(o))], "<u8").tobytes() + b"".join(out)


def _unpacked(data: bytes, *kinds: str) -> list[np.ndarray]:
    import zstandard

    head = np.frombuffer(data, "<u8", 2 * len(kinds)).tolist()
    at, out = 16 * len(kinds), []
    for kind, n, size in zip(kinds, head[::2], head[1::2], strict=True):
        width = np.dtype(kind).itemsize
        raw = zstandard.ZstdDecompressor().decompress(data[at : at + size], max_output_size=n * width) if n else b""
        out.append(np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(width, n).T).reshape(-1).view(kind))
        at += size
    return out


def blocks(docs: DataFrame, pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """block, n_words, words (distinct, packed), doc_ids and texts (packed sequences of
    word numbers) of each block of ``docs``."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block = TaskContext.get().partitionId() << 32
        ids: list = []
        counts: list[np.ndarray] = []
        found: list[tuple[Words, np.ndarray]] = []
        size = 0

        def row() -> pa.RecordBatch:
            words, numbers = Words.united([w for w, _ in found])
            # Frequent words get small numbers: what is written is smaller for it.
            sequence = np.concatenate([of[own] for of, (_, own) in zip(numbers, found, strict=True)])
            often = np.argsort(-np.bincount(sequence, minlength=len(words.sizes)), kind="stable")
            rank = np.empty(len(often), np.uint32)
            rank[often] = np.arange(len(often), dtype=np.uint32)
            texts = _packed(np.concatenate(counts).astype("<u8"), rank[sequence].astype("<u4"), often.astype("<u4"))
            values = (block, len(words.sizes), words.packed(), ids, texts)
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["block", "n_words", "words", "doc_ids", "texts"])

        for batch in batches:
            for part in slices(batch, "text"):
                raw, start, end, count = _word_ranges([t or "" for t in part.column(1).to_pylist()], pattern)
                found.append(Words.distinct(ranges(raw, start, end), start, end, raw))
                counts.append(count)
                ids += part.column(0).to_pylist()
                size += len(raw)
                if size >= block_bytes:
                    yield row()
                    block, size, ids, counts, found = block + 1, 0, [], [], []
        if ids:
            yield row()
            ids, counts, found = [], [], []
        release()

    return pick(docs, "doc_id", "text").mapInArrow(split, "block long, n_words long, words binary, doc_ids array<long>, texts binary")


def _parts(table: DataFrame, parts: int) -> DataFrame:
    """block, part, words of each range of hashes: the words of blocks cut into ``parts``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.array([(i << 64) // parts for i in range(1, parts)], np.uint64)
        for batch in batches:
            for block, data in zip(batch.column(0), batch.column(1), strict=True):
                words = Words.unpacked(data.as_py())
                at = [0, *np.searchsorted(words.hashes, bounds).tolist(), len(words.hashes)]
                rows = [(i, words.part(a, b).packed()) for i, (a, b) in enumerate(zip(at, at[1:], strict=False)) if a < b]
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block.as_py()] * len(rows), pa.int64()),
                    "part": pa.array([i for i, _ in rows], pa.int64()),
                    "words": pa.array([w for _, w in rows], pa.binary()),
                })

    return table.select("block", "words").mapInArrow(cut, "block long, part long, words binary")


def _listed(group: pa.Table) -> pa.Table:
    """The distinct words of a part, a row each, then a row for each of its blocks: the numbers of its words."""
    many = [Words.unpacked(x.as_py()) for x in group.column("words")]
    words, numbers = Words.united(many)
    n, m = len(words.sizes), len(many)
    return pa.table({
        "part": pa.concat_arrays([pa.nulls(n, pa.int64()), group.column("part").combine_chunks()]),
        "block": pa.concat_arrays([pa.nulls(n, pa.int64()), group.column("block").combine_chunks()]),
        "word": pa.concat_arrays([pa.array(words.bytes(), pa.binary()), pa.nulls(m, pa.binary())]),
        "numbers": pa.concat_arrays([pa.nulls(n, pa.binary()), pa.array([_packed(x.astype("<u4")) for x in numbers], pa.binary())]),
    })


def _concatenated(values: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lengths, values) of the lists ``at`` among lists that end at ``ends``."""
    start = np.concatenate([[0], ends[:-1]])[at]
    size = ends[at] - start
    return size, _copied(values, start, size)


def _folded(listed: DataFrame, vocabulary: str) -> DataFrame:
    """block, part and ids (packed, in the order of the block's words) for ``_listed`` rows."""
    latin = F.decode("word", "ISO-8859-1")
    # By the fold in place; null for a long word and for rows without one.
    ids = F.when(F.octet_length("word") <= LONG_WORD, _let(latin, Codec(load_ranks(vocabulary)).encode))

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = None
        lists: list[pa.Array] = []
        values = ends = None
        for whole in batches:
            # Words, then the blocks of their part, then words of the next part.
            plain = np.asarray(whole.column(2).is_valid())
            cuts = [0, *(np.flatnonzero(plain[1:] != plain[:-1]) + 1).tolist(), len(plain)]
            for batch in (whole.slice(x, y - x) for x, y in zip(cuts, cuts[1:], strict=False) if x < y):
                if batch.column(2)[0].is_valid:
                    if values is not None:
                        lists, values = [], None
                    own = batch.column(4)
                    if own.null_count:
                        ranks = ranks or load_ranks(vocabulary)
                        own = pa.array([merge(w.as_py(), ranks) if x is None else x for w, x in zip(batch.column(2), own.to_pylist(), strict=True)], pa.list_(pa.int32()))
                    lists.append(own)
                    continue
                if values is None:
                    ends = np.cumsum(np.concatenate([np.asarray(x.value_lengths()) for x in lists]), dtype=np.int64)
                    values = np.concatenate([np.asarray(x.flatten()) for x in lists])
                rows = []
                for numbers in batch.column(3):
                    count, found = _concatenated(values, ends, _unpacked(numbers.as_py(), "<u4")[0])
                    rows.append(_packed(count.astype("<u4"), found.astype("<u4")))
                yield pa.RecordBatch.from_pydict({"block": batch.column(1), "part": batch.column(0), "ids": pa.array(rows, pa.binary())})
        lists, values, ends = [], None, None
        release()

    return listed.withColumn("ids", ids).mapInArrow(looked_up, "block long, part long, ids binary")


@cache
def _pieces(vocabulary: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all pieces, by id, and where each ends."""
    ranks = load_ranks(vocabulary)
    pieces = [b""] * (max(ranks.values(), default=0) + 1)
    for k, v in ranks.items():
        pieces[v] = k
    return np.frombuffer(b"".join(pieces), np.uint8), np.cumsum([len(p) for p in pieces])


def _coded(vocabulary: str, with_ids: bool):
    """Function of a block's row and its rows of ids: the result of ``encode`` for its texts."""

    def coded(left: pa.Table, right: pa.Table) -> pa.Table:
        raw, ends = _pieces(vocabulary)
        counts, sequence, often = _unpacked(left.column("texts")[0].as_py(), "<u8", "<u4", "<u4")
        order = np.argsort(np.asarray(right.column("part")))
        lists = [_unpacked(right.column("ids")[int(i)].as_py(), "<u4", "<u4") for i in order]
        word_ends = np.cumsum(np.concatenate([n for n, _ in lists]) if lists else np.zeros(0, np.int64), dtype=np.int64)
        word_ids = np.concatenate([x for _, x in lists]) if lists else np.zeros(0, "<u4")
        doc_ids, rows, at = left.column("doc_ids")[0].as_py(), [], 0
        for doc_id, n in zip(doc_ids, counts.tolist(), strict=True):
            _, ids = _concatenated(word_ids, word_ends, often[sequence[at : at + n]])
            _, text = _concatenated(raw, ends, ids)
            at += n
            rows.append((doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(text.tobytes()).hexdigest(), ids.tobytes())[: 4 + with_ids])
        kinds = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()} | ({"ids": pa.binary()} if with_ids else {})
        out = pa.table({name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(kinds.items())})
        del rows, lists, word_ids, word_ends, sequence
        release()
        return out

    return coded


def encode(docs: DataFrame, vocabulary: str, pattern: str, block_bytes: int = BLOCK_BYTES, part_words: int = PART_WORDS, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, with ``with_ids``, ids of every document.

    ids are little-endian unsigned 32-bit integers, ids_sha256 is over them and
    decoded_sha256 over the bytes that decoding them gives.  The table of blocks stays in
    the warehouse, since the result reads it: ``common.clean`` drops it.
    """
    spark = docs.sparkSession
    name = fresh_table("bpe")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks(docs, pattern, block_bytes).write.option("compression", "zstd").bucketBy(buckets, "block").saveAsTable(name)
    table = spark.table(name)
    parts = max(1, -(-(table.agg(F.sum("n_words")).first()[0] or 0) // part_words))
    listed = _parts(table, parts).repartition(parts, "part").groupBy("part").applyInArrow(_listed, "part long, block long, word binary, numbers binary")
    ids = _folded(listed, vocabulary)
    kinds = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids binary" * with_ids
    return table.select("block", "doc_ids", "texts").groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(_coded(vocabulary, with_ids), kinds)
