"""``spark.read.format("pgarchive")``: the relations of an archive, read where they lie.

Options: ``relation`` is one of RELATIONS, ``dump_ids`` restricts payloads to some
entries (a comma-separated list), ``cores`` is how many splits a payload should have at
least if it is large enough, ``marks`` where the blocks of a large table of contents lie,
which else are looked for anew; a task reads a block.  Equality and IN filters on dump_id are pushed down
too where the session allows filters on Python sources.  Payloads are relations of
their own, so that a query that needs none reads none.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.types import StructType

from ..errors import ArchiveError, DataIntegrity
from ..functions.wire import Entries, Entry, Toc
from .containers import BlobRef, Split, blob_block, lines, open_container, raw

RELATIONS = {
    "archive": "version string, major int, minor int, rev int, int_size int, off_size int, format string, compression string, "
    "timestamp struct<sec:int,min:int,hour:int,day:int,month:int,year:int,is_dst:int>, dbname string, server_version string, dump_version string, n_entries int",
    "toc": "toc_pos int, dump_id int, had_dumper boolean, table_oid string, oid string, tag string, desc string, section string, defn string, drop_stmt string, "
    "copy_stmt string, namespace string, tablespace string, tableam string, relkind string, owner string, with_oids boolean, dependencies array<int>, "
    "data_state string, offset long, filename string",
    "table_lines": "dump_id int, split int, pos long, line string",
    "entry_chunks": "dump_id int, split int, pos long, data binary",
    "blobs": "dump_id int, blob_pos int, oid long, data binary",
}

_TOC_FIELDS = [x.split()[0] for x in RELATIONS["toc"].split(", ")][1:]
_BATCH_BYTES = 4 << 20
_OBJECT_BYTES = 16 << 20


def archive_row(toc: Toc) -> tuple:
    h = toc.header
    return (
        ".".join(map(str, h.version)), *h.version, h.int_size, h.off_size, h.format, h.compression, tuple(toc.timestamp.values()),
        toc.dbname, toc.server_version, toc.dump_version, len(toc.entries),
    )


_KINDS = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}


def _arrow(relation: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (x.split() for x in RELATIONS[relation].split(", "))])


def toc_batch(at: int, part: Sequence[Entry]) -> pa.RecordBatch:
    """Entries that follow each other from place ``at`` on."""
    schema = _arrow("toc")
    columns = [range(at, at + len(part)), *([getattr(e, f) for e in part] for f in _TOC_FIELDS)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _blob_batches(found: Iterator[tuple[int, int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    schema = _arrow("blobs")
    held, size = [], 0
    for row in found:
        held.append(row)
        size += len(row[3])
        if size >= _BATCH_BYTES or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


class _Part(InputPartition):
    def __init__(self, value) -> None:
        self.value = value


def _batches(split: Split, values: Iterator[list[bytes]], as_text: bool) -> Iterator[pa.RecordBatch]:
    pos, held, size = 0, [], 0

    def batch() -> pa.RecordBatch:
        data = pa.array(held, pa.binary())
        if as_text:
            try:
                data = data.cast(pa.string())
            except pa.ArrowInvalid as e:
                raise DataIntegrity(f"entry {split.dump_id} isn't UTF-8: {e}") from e
        n = len(held)
        columns = [pa.array([split.dump_id] * n, pa.int32()), pa.array([split.number] * n, pa.int32()), pa.array(range(pos, pos + n), pa.int64()), data]
        return pa.RecordBatch.from_arrays(columns, names=["dump_id", "split", "pos", "line" if as_text else "data"])

    for group in values:
        held += group
        size += sum(map(len, group))
        if size >= _BATCH_BYTES:
            yield batch()
            pos, held, size = pos + len(held), [], 0
    if held:
        yield batch()


def _grouped(found: list[Split | BlobRef]) -> list[Split | list[BlobRef]]:
    """Blocks as they are, single objects in groups of some megabytes."""
    out: list = []
    size = 0
    for x in found:
        if isinstance(x, Split):
            out.append(x)
            continue
        if not out or isinstance(out[-1], Split) or size > _OBJECT_BYTES:
            out.append([])
            size = 0
        out[-1].append(x)
        size += x.split.end - x.split.start + 4096
    return out


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str, relation: str, dump_ids: set[int] | None, cores: int = 1, marks: tuple[int, ...] | None = None) -> None:
        self.path, self.relation, self.dump_ids, self.cores, self.marks = path, relation, dump_ids, cores, marks

    def pushFilters(self, filters: list[Filter]):  # noqa: N802
        for f in filters:
            wanted = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if wanted is not None and f.attribute == ("dump_id",) and self.relation not in ("archive", "toc"):
                self.dump_ids = wanted if self.dump_ids is None else self.dump_ids & wanted
            yield f  # rows are filtered again: an entry is what can be skipped

    def partitions(self) -> list[InputPartition]:
        container = open_container(self.path, self.cores, self.marks)
        if self.relation == "archive":
            return [_Part([archive_row(container.toc)])]
        if self.relation == "toc":
            found = container.toc.entries
            if isinstance(found, Entries):
                return [_Part((at, x)) for at, x in found.blocks()]
            return [_Part(toc_batch(0, found))] if found else [_Part(None)]
        entries = [e for e in container.toc.entries if self.dump_ids is None or e.dump_id in self.dump_ids]
        found = _grouped(container.blobs(entries)) if self.relation == "blobs" else container.data(entries)
        return [_Part(x) for x in found] or [_Part(None)]

    def read(self, partition: _Part):
        value = partition.value
        if value is None:
            return
        if self.relation == "archive":
            yield from value
        elif self.relation == "toc":
            yield toc_batch(value[0], list(value[1])) if isinstance(value, tuple) else value
        elif self.relation == "blobs":
            if isinstance(value, Split):
                yield from _blob_batches((value.dump_id, pos, oid, data) for pos, (oid, data) in enumerate(blob_block(value)))
            else:
                yield from _blob_batches((ref.dump_id, ref.pos, ref.oid, b"".join(raw(ref.split))) for ref in value)
        elif self.relation == "table_lines":
            yield from _batches(value, lines(value), True)
        else:
            yield from _batches(value, ([x] for x in raw(value)), False)


class ArchiveSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pgarchive"

    def schema(self) -> str:
        relation = self.options.get("relation", "toc")
        if relation not in RELATIONS:
            raise ArchiveError(f"no relation {relation!r}; there are {', '.join(RELATIONS)}")
        return RELATIONS[relation]

    def reader(self, schema: StructType) -> DataSourceReader:
        ids = self.options.get("dump_ids")
        wanted = None if ids is None else {int(x) for x in ids.split(",") if x}
        return ArchiveReader(self.options["path"], self.options.get("relation", "toc"), wanted, int(self.options.get("cores", "1")), tuple(int(x) for x in self.options.get("marks", "").split(",") if x) or None)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session and lets filters reach Python sources."""
    spark.dataSource.register(ArchiveSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
