"""Substring dedup with a log-structured index of window fingerprints.

A window is ``window`` consecutive words of a document; a word goes if a window
that covers it has a word sequence that starts at any other place too.  Windows
are judged on the input.

A window's fingerprint is the least hash of the ``GRAM``-word sequences in it, so
that equal windows have equal fingerprints and neighbours mostly share one: a
document needs an index entry only where the fingerprint changes.  The index is a
list of immutable runs, tables bucketed and sorted by fingerprint.  A batch of
documents becomes a new run, which is merge-joined with every older run and itself
without moving them; what they share are hits.  ``FANOUT`` runs of a level are
compacted into one of the next.

Hits are then verified: documents that hold one hash each window whose fingerprint
is a hit with 128 bits that are independent of the fingerprint's.  Windows that meet
inside a batch of rows are combined there, so that a passage of very many documents
moves a row per batch; the others meet by hash.  Words covered by windows that were
found twice or more are removed.

Nulls: a null text has no words, a null doc_id is kept.  Texts of fewer than
``window`` words stay whole.  Rows that repeat doc_id and text are two places, so
their windows go.  A very long text is hashed and cut whole, in memory that grows with it.
An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick, written
from .textkernel import Words, covered, mix, slices, window_hashes

WINDOW = 35
GRAM = 8
FANOUT = 3
_MOST = np.uint64((1 << 64) - 1)


def _sliding(values: np.ndarray, width: int, worse, pick_of) -> np.ndarray:
    """``pick_of`` (minimum or maximum) of ``width`` values from each place on; beyond the end is ``worse``."""
    n = len(values)
    padded = np.concatenate([values, np.full(width, worse, values.dtype)])
    span = 1
    while 2 * span <= width:
        padded[: n + width - span] = pick_of(padded[: n + width - span], padded[span:])
        span *= 2
    return pick_of(padded[:n], padded[width - span : width - span + n]) if width > span else padded[:n]


def _fingerprints(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, gram hash at each word, starts of windows, fingerprint of each window)."""
    hashes = words.hashes()
    grams = np.full(len(words), _MOST)
    at = words.windows(GRAM)
    grams[at] = np.minimum(window_hashes(hashes, at, GRAM), _MOST - np.uint64(1))
    starts = words.windows(window)
    least = _sliding(grams, window - GRAM + 1, _MOST, np.minimum)
    return hashes, grams, starts, least[starts]


def _entries(column: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, fingerprint) of each text's index entries: one for each distinct fingerprint, two if it occurs at several places."""
    words = Words(column)
    _, grams, starts, prints = _fingerprints(words, window)
    width = window - GRAM + 1
    of_window = np.zeros(len(words), np.uint64)
    of_window[starts] = prints
    most = _sliding(of_window[::-1], width, np.uint64(0), np.maximum)[::-1]
    chosen = np.flatnonzero((grams == most) & (grams != _MOST))
    doc, found = words.doc[chosen], grams[chosen]
    order = np.lexsort((found, doc))
    doc, found = doc[order], found[order]
    same = np.zeros(len(doc), bool)
    same[1:] = (doc[1:] == doc[:-1]) & (found[1:] == found[:-1])
    third = same.copy()
    third[1:] &= same[:-1]
    return doc[~third], found[~third]


def fingerprints(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """fp and key of the index entries of ``docs(doc_id, text)``; key stands for the document."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                doc, prints = _entries(part.column(1), window)
                yield pa.RecordBatch.from_pydict({"fp": pa.array(prints.view(np.int64)), "key": part.column(0).take(pa.array(doc))})

    texts = pick(docs, "doc_id", "text")
    return texts.select(_key(), "text").mapInArrow(found, "fp long, key long")


def _key():
    return F.xxhash64("doc_id", "text").alias("key")


class FingerprintIndex:
    """Sorted immutable runs of entries (fp, key), in levels, and the hits of each batch.

    All are tables of the warehouse whose names begin with ``name`` and say their level, so
    that another session opens the index by its name and adds the next batch to it."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, name: str | None = None) -> None:
        self.spark, self.fanout = spark, fanout
        self.name = name or f"fingerprints_{uuid.uuid4().hex}"
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.hits: list[str] = []
        self.written = 0
        held = [r.tableName for r in spark.sql(f"SHOW TABLES LIKE '{self.name}_*'").collect()] if name else []
        for table in sorted(held, key=lambda t: int(t.rsplit("_", 1)[1])):
            what, number = table.removeprefix(f"{self.name}_").split("_")
            self.written = max(self.written, int(number))
            if what == "hits":
                self.hits.append(table)
            else:
                self._level(int(what)).append(table)

    def _level(self, level: int) -> list[str]:
        while len(self.levels) <= level:
            self.levels.append([])
        return self.levels[level]

    def _name(self, what: str | int) -> str:
        self.written += 1
        return f"{self.name}_{what}_{self.written}"

    def _run(self, entries: DataFrame, level: int) -> str:
        name = self._name(level)
        dealt = entries.repartition(self.buckets, "fp").sortWithinPartitions("fp")
        dealt.write.bucketBy(self.buckets, "fp").sortBy("fp").saveAsTable(name)
        self._level(level).append(name)
        return name

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def add(self, entries: DataFrame) -> DataFrame:
        """Adds a batch as a run; returns the fingerprints (fp) that it shares with older runs or holds twice."""
        older = self.runs()
        new = self.spark.table(self._run(entries, 0))
        shared = new.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp")
        for run in older:
            shared = shared.union(new.select("fp").join(run.select("fp"), "fp", "left_semi"))
        self.hits.append(self._name("hits"))
        shared.distinct().write.saveAsTable(self.hits[-1])
        hits = self.spark.table(self.hits[-1])
        self._compact()
        return hits

    def _compact(self) -> None:
        level = 0
        while level < len(self.levels):
            if len(old := self.levels[level]) >= self.fanout:
                merged = self.spark.table(old[0])
                for name in old[1:]:
                    merged = merged.union(self.spark.table(name))
                self.levels[level] = []
                self._run(merged, level + 1)
                for name in old:
                    self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def flagged(self) -> DataFrame:
        """key and fps, the set of its hits, of every document that holds one."""
        hits = self.spark.table(self.hits[0])
        for name in self.hits[1:]:
            hits = hits.union(self.spark.table(name))
        hits = hits.distinct()
        found = None
        for run in self.runs():
            part = run.join(hits, "fp", "left_semi")
            found = part if found is None else found.union(part)
        return found.groupBy("key").agg(F.collect_set("fp").alias("fps"))

    def drop(self) -> None:
        for name in [*(n for level in self.levels for n in level), *self.hits]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


_ROWS = "d1 long, d2 long, n long, doc_id long, key long, start int, starts array<int>"


def _suspect_windows(part: pa.RecordBatch, window: int) -> tuple[np.ndarray, ...]:
    """(row, start, two hashes) of the windows of rows (doc_id, key, text, fps) whose fingerprint is a hit."""
    words = Words(part.column(2))
    hashes, _, starts, prints = _fingerprints(words, window)
    lists = part.column(3)
    owner = np.repeat(np.arange(part.num_rows), np.asarray(lists.value_lengths().fill_null(0)))
    hits = np.asarray(lists.flatten()).view(np.uint64)
    doc = words.doc[starts]
    with np.errstate(over="ignore"):
        salt = mix(np.arange(1, part.num_rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        hot = np.isin(prints + salt[doc], hits + salt[owner])
    starts, doc = starts[hot], doc[hot]
    return doc, starts - words.first[doc], window_hashes(hashes, starts, window), window_hashes(words.hashes(1), starts, window, 1)


def _suspects(rows: DataFrame, window: int) -> DataFrame:
    """Hashed windows of ``rows(doc_id, key, text, fps)`` as ``_ROWS``: those that occur once in a
    batch of rows with their place; for others one row without, and their places by document."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, base = [], 0
            for part in slices(batch, "text"):
                doc, start, d1, d2 = _suspect_windows(part, window)
                parts.append((doc + base, start, d1, d2))
                base += part.num_rows
            doc, start, d1, d2 = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((d2, d1))
            a, b = d1[order], d2[order]
            same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
            many = np.zeros(len(doc), bool)
            many[order[1:]] |= same
            many[order[:-1]] |= same
            first = np.ones(len(doc), bool)
            first[order[1:]] = ~same
            one, lead = np.flatnonzero(~many), np.flatnonzero(many & first)
            ids, keys = batch.column(0), batch.column(1)

            def column(values, kind):
                return pa.array(values, kind)

            yield pa.RecordBatch.from_pydict({
                "d1": column(d1[one].view(np.int64), pa.int64()),
                "d2": column(d2[one].view(np.int64), pa.int64()),
                "n": column(np.ones(len(one), np.int64), pa.int64()),
                "doc_id": ids.take(pa.array(doc[one])),
                "key": keys.take(pa.array(doc[one])),
                "start": column(start[one], pa.int32()),
                "starts": pa.nulls(len(one), pa.list_(pa.int32())),
            })
            yield pa.RecordBatch.from_pydict({
                "d1": column(d1[lead].view(np.int64), pa.int64()),
                "d2": column(d2[lead].view(np.int64), pa.int64()),
                "n": column(np.full(len(lead), 2), pa.int64()),
                "doc_id": pa.nulls(len(lead), pa.int64()),
                "key": pa.nulls(len(lead), pa.int64()),
                "start": pa.nulls(len(lead), pa.int32()),
                "starts": pa.nulls(len(lead), pa.list_(pa.int32())),
            })
            at = np.flatnonzero(many)
            at = at[np.argsort(doc[at], kind="stable")]
            owners, begin = np.unique(doc[at], return_index=True)
            lists = pa.ListArray.from_arrays(pa.array(np.append(begin, len(at)), pa.int32()), column(start[at], pa.int32()))
            yield pa.RecordBatch.from_pydict({
                "d1": keys.take(pa.array(owners)),  # spreads these rows; their hashes aren't windows'
                "d2": pa.array(owners, pa.int64()),
                "n": column(np.zeros(len(owners), np.int64), pa.int64()),
                "doc_id": ids.take(pa.array(owners)),
                "key": keys.take(pa.array(owners)),
                "start": pa.nulls(len(owners), pa.int32()),
                "starts": lists,
            })

    return rows.select("doc_id", "key", "text", "fps").mapInArrow(hashed, _ROWS)


def _without(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept of ``texts(doc_id, text, starts, more)``."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, *lists in zip(*batch.columns, strict=True):
                words = (text.as_py() or "").encode().split()
                at = np.array([s for x in lists for s in x.as_py() or ()], np.int64)
                gone = covered(len(words), at, window) if len(at) else np.zeros(len(words), bool)
                kept = b" ".join(compress(words, ~gone) if len(at) else words)
                rows.append((doc_id.as_py(), len(words), int(gone.sum()), hashlib.sha256(kept).hexdigest(), kept.decode()))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return texts.mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


def dedup(batches: Iterable[DataFrame], window: int = WINDOW, index: FingerprintIndex | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and kept of the documents of all ``batches(doc_id, text)``.

    Each batch goes into the index in turn.  Both joins with the texts use one and
    the same exchange of them.  An index that is passed stays, with all its runs: batches
    whose entries it already holds are to be passed to ``history`` of the next call's
    ``dedup_next`` alone.
    """
    batches = list(batches)
    own = index is None
    index = index or FingerprintIndex(batches[0].sparkSession)
    for batch in batches:
        index.add(fingerprints(batch, window))
    flagged = written(index.flagged(), "flagged")
    if own:
        index.drop()
    return _removed(batches, flagged, window)


def dedup_next(batch: DataFrame, history: DataFrame, index: FingerprintIndex, window: int = WINDOW) -> DataFrame:
    """``dedup`` of a new batch and of ``history``, all documents that ``index`` holds: only the
    batch's entries are made, merged with the runs and added; only documents with a hit are
    looked into."""
    index.add(fingerprints(batch, window))
    return _removed([history, batch], written(index.flagged(), "flagged"), window)


def _removed(batches: list[DataFrame], flagged: DataFrame, window: int) -> DataFrame:
    """The documents of ``batches`` without the windows that are found twice or more."""

    texts = pick(batches[0], "doc_id", "text")
    for batch in batches[1:]:
        texts = texts.union(pick(batch, "doc_id", "text"))
    texts = texts.select("doc_id", "text", _key())
    rows = _suspects(texts.join(flagged, "key"), window)
    total = F.expr("sum(n) OVER (PARTITION BY d1, d2)")
    found = rows.withColumn("total", total).where("starts is not null or (total > 1 and start is not null)")
    starts = found.groupBy("key").agg(F.collect_list("start").alias("starts"), F.flatten(F.collect_list("starts")).alias("more"))
    return _without(texts.join(starts, "key", "left").select("doc_id", "text", "starts", "more"), window)


def file_batches(table: DataFrame, most: int = 4) -> list[DataFrame]:
    """A table of files as up to ``most`` batches of whole files, in order of their names; of
    one file, its rows in ``most`` ranges of their hash."""
    files = sorted(table.inputFiles())
    if len(files) < 2:
        mark = F.xxhash64(*table.columns)
        ends = [(i << 64) // most - (1 << 63) for i in range(most + 1)]
        return [table.where(mark.between(a, b - 1)) for a, b in zip(ends, ends[1:], strict=False)]
    size = -(-len(files) // most)
    reader = table.sparkSession.read.schema(table.schema)
    return [reader.parquet(*files[i : i + size]) for i in range(0, len(files), size)]
