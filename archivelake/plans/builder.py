"""Building, changing and writing archives.

A builder is immutable; each change gives a new one.  A payload is a DataFrame that
is encoded where its partitions are: each task stages its part of the stream, and the
driver sees only sizes and checksums.  It plans files whose offsets it then knows; tasks
put the parts together, each a file, and the driver renames the result into place.

Entries can also be the rows of a DataFrame, as many as one likes: they are numbered,
changed, sorted and encoded by tasks.  One that gets a payload joins those of the driver.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field, replace

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import DataIntegrity, InvalidDumpId, UnsupportedCompression
from ..functions import dates, objecttypes, versions
from ..functions.copytext import to_lines
from ..functions.wire import Entry, Header, Toc, put_entry, put_int, put_preamble
from ..operators.ordering import numbered, ordered, ranks, sort_columns
from ..sources import codecs, containers, storage
from ..sources.datasource import RELATIONS
from .archive import Archive, entry_of

#: Bytes of a chunk of a payload in a custom archive.
CHUNK = 1 << 20
#: Columns of entries that are rows, and the values of those that aren't given.
_FIELDS = [tuple(x.split()) for x in RELATIONS["toc"].split(", ")]
_DEFAULTS = {n: v for n, v in vars(Entry(0, "")).items() if n not in ("dump_id", "desc", "dependencies")} | {"dependencies": []}
_STAGED = "part int, file string, stored long, size long, adler long, crc long"


def new(dbname: str, encoding: str = "UTF8", appear_as: str = "17.0") -> ArchiveBuilder:
    """An empty archive as a server of version ``appear_as`` would write it."""
    server = versions.parse_server(appear_as) or (17, 0)
    version = versions.from_server(*server) or (1, 14, 0)
    toc = Toc(Header(version), dates.now(), dbname, appear_as, f"pg_dump (PostgreSQL) {appear_as}")
    builder = ArchiveBuilder(toc)
    # What every dump begins with.
    for desc, defn in (
        ("ENCODING", f"SET client_encoding = '{encoding}';\n"),
        ("STDSTRINGS", "SET standard_conforming_strings = 'on';\n"),
        ("SEARCHPATH", "SELECT pg_catalog.set_config('search_path', '', false);\n"),
    ):
        builder = builder.add_entry(desc, defn=defn)
    return builder


@dataclass(frozen=True)
class ArchiveBuilder:
    toc: Toc
    data: dict[int, DataFrame | bytes] = field(default_factory=dict)
    objects: dict[int, tuple[DataFrame, ...]] = field(default_factory=dict)
    #: Further entries, with the columns of the relation toc, none of which has a payload; how many there
    #: are, and the highest id that one has had.
    rows: DataFrame | None = None
    n_rows: int = 0
    last_row: int = 0

    @staticmethod
    def of(archive: Archive) -> ArchiveBuilder:
        """A builder that starts from an archive; its payloads are read when the result is saved."""
        entries = archive.entries
        held = {s.dump_id for s in archive.container.data(entries)}
        data = {i: archive.entry_chunks(i).select("data") for i in held}
        blobs = {b.dump_id for b in archive.container.blobs(entries)}
        objects = {i: (archive.relation("blobs", [i]).select("oid", "data"),) for i in blobs}
        return ArchiveBuilder(archive.contents, data, objects)

    @property
    def entries(self) -> tuple[Entry, ...]:
        """The entries that the driver holds: all but ``rows``."""
        return self.toc.entries

    @property
    def last_id(self) -> int:
        """The id of the entry that was added last, the highest."""
        ids = [e.dump_id for e in self.entries] + [self.last_row] * (self.rows is not None)
        return max(ids, default=0)

    def _with(self, **changes) -> ArchiveBuilder:
        return replace(self, toc=replace(self.toc, **changes))

    def add_entry(self, desc: str, namespace=None, tag=None, owner=None, defn=None, drop_stmt=None, copy_stmt=None, dependencies=()) -> ArchiveBuilder:
        """One more entry, with the next id (``last_id`` of the result)."""
        values = {"namespace": namespace, "tag": tag, "owner": owner, "defn": defn, "drop_stmt": drop_stmt, "copy_stmt": copy_stmt}
        return self.add_entries([{"desc": desc, "dependencies": tuple(dependencies)} | values])

    def add_entries(self, values: Iterable[dict]) -> ArchiveBuilder:
        """More entries, of the values of their fields, with the next ids in turn."""
        first = self.last_id + 1
        new_ones = [Entry(first + i, section=objecttypes.section(v["desc"]), **v) for i, v in enumerate(values)]
        return self._with(entries=(*self.entries, *new_ones))

    def add_rows(self, rows: DataFrame, *order: str, path: str) -> ArchiveBuilder:
        """More entries, one for each row, with the next ids in the order of the columns ``order``.
        Columns with the names of an entry's fields (``desc`` at least) are its values, others go.
        The numbered rows are written to ``path``, which must stay until ``save``."""
        first = self.last_id + 1
        found = numbered(rows, [F.col(c) for c in order], path)
        values = {f: F.lit(v) for f, v in _DEFAULTS.items()} | {"section": objecttypes.section_of(F.col("desc"))}
        values |= {c: F.col(c) for c in rows.columns if c in _DEFAULTS or c == "desc"}
        values |= {"dump_id": F.col("nth") + first, "toc_pos": F.col("nth")}
        found = found.select(*(values[n].cast(kind).alias(n) for n, kind in _FIELDS))
        count = found.count()
        return replace(self, rows=self.rows.union(found) if self.rows else found, n_rows=self.n_rows + count, last_row=first + count - 1)

    def _held(self, dump_id: int) -> ArchiveBuilder:
        """A builder whose driver holds the entry of that id, if it is one of ``rows``."""
        if self.rows is None or any(e.dump_id == dump_id for e in self.entries):
            return self
        found = self.rows.where(F.col("dump_id") == dump_id).first()
        if found is None:
            return self
        at = sum(e.dump_id < dump_id for e in self.entries)
        out = self._with(entries=(*self.entries[:at], entry_of(found), *self.entries[at:]))
        return replace(out, rows=self.rows.where(F.col("dump_id") != dump_id), n_rows=self.n_rows - 1)

    def update(self, dump_id: int, **changes) -> ArchiveBuilder:
        """The first entry of that id with other values; unchanged if there is none."""
        if self.rows is not None and all(e.dump_id != dump_id for e in self.entries):
            # Lazily: no row is looked for.
            kinds = dict(_FIELDS)
            values = {n: F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v) for n, v in changes.items()}
            changed = {n: F.when(F.col("dump_id") == dump_id, v.cast(kinds[n])).otherwise(F.col(n)) for n, v in values.items()}
            return replace(self, rows=self.rows.select(*(changed.get(n, F.col(n)).alias(n) for n, _ in _FIELDS)))
        out, done = [], False
        for e in self.entries:
            out.append(e.updated(**changes) if e.dump_id == dump_id and not done else e)
            done |= e.dump_id == dump_id
        return self._with(entries=tuple(out))

    def _payload(self, dump_id: int, payload: DataFrame | bytes) -> ArchiveBuilder:
        self = self._held(dump_id)  # noqa: PLW0642
        if all(e.dump_id != dump_id for e in self.entries):
            raise InvalidDumpId(str(dump_id))
        out = self.update(dump_id, had_dumper=True, data_state="NotSet")
        return replace(out, data=out.data | {dump_id: payload})

    def set_bytes(self, dump_id: int, data: bytes) -> ArchiveBuilder:
        return self._payload(dump_id, data)

    def set_lines(self, dump_id: int, lines: DataFrame) -> ArchiveBuilder:
        """The rows of ``lines(line)``, in their order, as lines of the payload."""
        return self._payload(dump_id, lines.select(F.encode(F.concat("line", F.lit("\n")), "UTF-8").alias("data")))

    def set_table(self, dump_id: int, table: DataFrame) -> ArchiveBuilder:
        """The rows of a table, in their order, as COPY text."""
        return self.set_lines(dump_id, to_lines(table))

    def add_blobs(self, objects: DataFrame) -> ArchiveBuilder:
        """Large objects of ``objects(oid, data)``, under the first BLOBS entry or a new one."""
        builder = self
        found = next((e for e in self.entries if e.desc == "BLOBS" and e.had_dumper), None)
        if found is None:
            builder = self.add_entry("BLOBS")
            builder = builder.update(builder.last_id, had_dumper=True, data_state="NotSet")
        dump_id = found.dump_id if found else builder.last_id
        rows = objects.select(F.col("oid").cast("long").alias("oid"), "data")
        return replace(builder, objects=builder.objects | {dump_id: (*builder.objects.get(dump_id, ()), rows)})

    def sorted(self) -> ArchiveBuilder:
        """Entries in the order in which ``save`` writes them; ``rows`` are put among them only there."""
        return self._with(entries=tuple(ordered(self.entries)))

    def with_format(self, name: str) -> ArchiveBuilder:
        """"Custom", "Directory" or "Tar"; a tar has no compression."""
        header = replace(self.toc.header, format=name)
        return self._with(header=replace(header, compression="none") if name == "Tar" else header)

    def with_compression(self, codec: str) -> ArchiveBuilder:
        return self._with(header=replace(self.toc.header, compression=codec))

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the archive; what was at ``path`` is replaced once all is written."""
        h = self.toc.header
        if h.compression not in codecs.EXTENSIONS or (h.format == "Tar" and h.compression != "none"):
            raise UnsupportedCompression(f"{h.compression} in {h.format}")
        self = self.sorted()  # noqa: PLW0642
        staging = f"{path.rstrip('/')}.staging-{uuid.uuid4().hex}"
        try:
            {"Directory": _save_directory, "Tar": _save_tar}.get(h.format, _save_custom)(spark, self, path, staging)
        finally:
            storage.remove(staging)


def _framed(parts: Iterator[bytes], int_size: int, chunk: int) -> Iterator[bytes]:
    """Chunks, each behind its length."""
    for part in parts:
        for at in range(0, len(part), chunk):
            piece = part[at : at + chunk]
            yield put_int(len(piece), int_size) + piece


def _regrouped(parts: Iterator[bytes], chunk: int) -> Iterator[bytes]:
    """The same bytes in pieces of about a chunk."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part)
        if size >= chunk:
            yield b"".join(held)
            held, size = [], 0
    if size:
        yield b"".join(held)


@dataclass(frozen=True)
class _Staged:
    """A payload in staged parts, in order."""

    files: list[str]
    stored: int
    sums: codecs.Checksums


def _stage(spark: SparkSession, payload: DataFrame | bytes, staging: str, name: str, codec: str, int_size: int | None) -> _Staged:
    """Encodes a payload by its partitions; int_size: of chunk lengths in a custom archive."""
    if isinstance(payload, bytes):
        payload = spark.createDataFrame([(bytearray(payload),)], "data binary").coalesce(1)
    chunk = CHUNK

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, stored = codecs.Checksums(), 0

        def plain() -> Iterator[bytes]:
            for batch in batches:
                for x in batch.column(0):
                    if data := x.as_py():
                        sums.add(data)
                        yield data

        part = TaskContext.get().partitionId()
        file = storage.join(staging, f"{name}-{part}-{uuid.uuid4().hex}")  # an attempt's own
        encoded = codecs.encode_part(_regrouped(plain(), chunk), codec)
        with storage.create(file) as out:
            for piece in encoded if int_size is None else _framed(encoded, int_size, chunk):
                out.write(piece)
                stored += len(piece)
        values = [part, file, stored, sums.size, sums.adler, sums.crc]
        kinds = [pa.int32(), pa.string(), *[pa.int64()] * 4]
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["part", "file", "stored", "size", "adler", "crc"])

    rows = sorted(payload.select("data").mapInArrow(stage, _STAGED).collect(), key=lambda r: r.part)
    sums = codecs.Checksums()
    for r in rows:
        sums = sums.then(codecs.Checksums(r.size, r.adler, r.crc))
    rows = [r for r in rows if r.size]  # parts of nothing would still hold a block
    return _Staged([r.file for r in rows], sum(r.stored for r in rows), sums)


def _stage_blocks(objects: tuple[DataFrame, ...], staging: str, name: str, codec: str, int_size: int) -> list[str]:
    """Large objects as they lie in a custom archive, in staged files, with their sizes."""
    chunk = CHUNK

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stored = TaskContext.get().partitionId(), 0
        file = storage.join(staging, f"{name}-{part}-{uuid.uuid4().hex}")
        with storage.create(file) as out:
            for batch in batches:
                for oid, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    _check(oid)
                    piece = b"".join([put_int(oid, int_size), *_framed(_whole(data or b"", codec, False), int_size, chunk), put_int(0, int_size)])
                    stored += out.write(piece) or len(piece)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file]), pa.array([stored], pa.int64())], names=["part", "file", "stored"])

    out = []
    for df in objects:
        rows = df.select("oid", "data").mapInArrow(stage, "part int, file string, stored long").collect()
        out += [(r.file, r.stored) for r in sorted(rows, key=lambda r: r.part)]
    return out


def _check(oid: int | None) -> None:
    if oid is None or not 0 < oid < 1 << 32:
        raise DataIntegrity(f"object id {oid}")


def _whole(data: bytes, codec: str, gzip_file: bool) -> Iterator[bytes]:
    """A payload of one part as one stream; nothing if it is empty."""
    if data:
        sums = codecs.Checksums()
        sums.add(data)
        yield b"".join([codecs.head(codec, gzip_file), *codecs.encode_part([data], codec), codecs.tail(codec, gzip_file, sums)])


_PLAN = "target string, parts array<struct<data:binary,file:string>>"


def _assemble(spark: SparkSession, plan: dict[str, list[bytes | str]]) -> None:
    """Puts files together from bytes and staged files, each file in one task."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for target, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                attempt = f"{target}.{uuid.uuid4().hex}"  # an attempt's own, until it is whole
                with storage.create(attempt) as out:
                    for part in parts:
                        if part["file"] is None:
                            out.write(part["data"])
                            continue
                        file, _ = storage.open_file(part["file"])
                        with file:
                            while piece := file.read(8 << 20):
                                out.write(piece)
                storage.move(attempt, target)
                yield pa.RecordBatch.from_pydict({"target": [target]})

    if plan:
        rows = [(target, [(bytearray(x), None) if isinstance(x, bytes) else (None, x) for x in parts]) for target, parts in plan.items()]
        spark.createDataFrame(rows, _PLAN).repartition(min(len(rows), 1024)).mapInArrow(assemble, "target string").count()


def _save_custom(spark: SparkSession, b: ArchiveBuilder, path: str, staging: str) -> None:
    h = replace(b.toc.header, format="Custom")
    n = h.int_size
    blocks: dict[int, tuple[bytes, list[str], bytes, int]] = {}
    for e in b.entries:
        if e.dump_id in blocks:
            continue
        if e.dump_id in b.objects:
            staged = _stage_blocks(b.objects[e.dump_id], staging, f"blobs{e.dump_id}", h.compression, n)
            head, tail = bytes([containers.BLOBS_BLOCK]) + put_int(e.dump_id, n), put_int(0, n)
            blocks[e.dump_id] = head, [f for f, _ in staged], tail, len(head) + sum(s for _, s in staged) + len(tail)
        elif e.dump_id in b.data:
            staged = _stage(spark, b.data[e.dump_id], staging, f"data{e.dump_id}", h.compression, n)
            head, tail = bytes([containers.DATA_BLOCK]) + put_int(e.dump_id, n), put_int(0, n)
            if staged.files:
                head += b"".join(_framed(iter([codecs.head(h.compression, False)]), n, CHUNK))
                tail = b"".join(_framed(iter([codecs.tail(h.compression, False, staged.sums)]), n, CHUNK)) + tail
            blocks[e.dump_id] = head, staged.files, tail, len(head) + staged.stored + len(tail)
    entries = [_settled(e, e.dump_id in blocks).updated(filename=None) for e in b.entries]
    preamble = put_preamble(replace(b.toc, header=h, entries=tuple(entries)), b.n_rows)
    listed, size = ([], sum(len(put_entry(e, h, False)) for e in entries)) if b.rows is None else _stage_entries(spark, b, entries, h, False, staging)
    at = len(preamble) + size
    offsets = {}
    for dump_id, block in blocks.items():
        offsets[dump_id] = at
        at += block[3]
    whole = storage.join(staging, "archive")
    if b.rows is None:
        head = [preamble + b"".join(put_entry(e.updated(offset=offsets.get(e.dump_id, 0)), h, False) for e in entries)]
    else:
        head = [preamble, *(x if isinstance(x, str) else offsets.get(x, 0).to_bytes(h.off_size, "little") for x in listed)]
    _assemble(spark, {whole: [*head, *(x for first, files, last, _ in blocks.values() for x in (first, *files, last))]})
    storage.put_in_place(whole, path)


def _stage_entries(spark: SparkSession, b: ArchiveBuilder, entries: list[Entry], h: Header, with_file: bool, staging: str) -> tuple[list[str | int], int]:
    """The entries of a builder with rows, in order: staged files and, between them, ids of those of the
    driver's entries whose offset is due there; and the size of all."""
    # Ties come in the order in which the driver holds its entries, or else of ids.
    held, most = [], 0
    for i, e in enumerate(entries):
        most = max(most, e.dump_id)
        held.append((*(i if n == "toc_pos" else list(v) if isinstance(v := getattr(e, n), tuple) else v for n, _ in _FIELDS), most, True))
    all_rows = spark.createDataFrame(held, f"{RELATIONS['toc']}, place long, held boolean") if held else None
    rows = b.rows.withColumns({"place": F.col("dump_id").cast("long"), "held": F.lit(False)})
    rows = all_rows.union(rows) if held else rows
    rows, order = ranks(rows, [*sort_columns()[:-1], F.col("place"), F.col("toc_pos")], storage.join(staging, "order"))
    names = [n for n, _ in _FIELDS if n != "toc_pos"]
    cut = h.off_size

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, out, found = TaskContext.get().partitionId(), None, []
        try:
            for batch in batches:
                for *values, is_held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    e = Entry(**dict(zip(names, values, strict=True)))
                    if out is None:
                        file, stored = storage.join(staging, f"entries-{part}-{uuid.uuid4().hex}"), 0
                        out = storage.create(file)
                    piece = put_entry(e, h, with_file)
                    due = is_held and not with_file
                    out.write(piece[:-cut] if due else piece)
                    stored += len(piece)
                    if due:
                        out.close()
                        out = None
                        found.append((part, len(found), file, stored, e.dump_id))
        finally:
            if out is not None:
                out.close()
        if out is not None:
            found.append((part, len(found), file, stored, None))
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int32()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["part", "n", "file", "stored", "due"])

    staged = rows.orderBy(*order).select(*names, "held").mapInArrow(stage, "part int, n int, file string, stored long, due int").collect()
    out: list[str | int] = []
    for r in sorted(staged, key=lambda r: (r.part, r.n)):
        out += [r.file] if r.due is None else [r.file, r.due]
    return out, sum(r.stored for r in staged)


def _settled(e: Entry, has_payload: bool) -> Entry:
    """An entry whose state says whether it has a payload."""
    if has_payload:
        return e.updated(data_state="Set", had_dumper=True)
    return e.updated(data_state="NoData" if e.data_state == "Set" else e.data_state)


def _members(spark: SparkSession, b: ArchiveBuilder, staging: str, objects: bool = True) -> dict[str, list[str | bytes]]:
    """The files of a directory by name: what they are put together from, staged files and bytes;
    objects: with those of large objects, not only their lists."""
    h = b.toc.header
    extension = codecs.EXTENSIONS[h.compression]
    out: dict[str, list[str | bytes]] = {}
    entries = []
    for e in b.entries:
        name = None
        if e.dump_id in b.objects and e.desc == "BLOBS":
            name = f"blobs_{e.dump_id}.toc"
            if objects:
                listed, files = _stage_objects(b.objects[e.dump_id], staging, f"blobs{e.dump_id}", h.compression)
                out |= {posixpath.basename(f): [f] for f in files}
            else:
                listed = _stage_lists(b.objects[e.dump_id], staging, f"blobs{e.dump_id}")
            out[name] = listed
        elif e.dump_id in b.data:
            name = f"{e.dump_id}.dat"
            staged = _stage(spark, b.data[e.dump_id], staging, f"data{e.dump_id}", h.compression, None)
            head, tail = codecs.head(h.compression, True), codecs.tail(h.compression, True, staged.sums)
            out[name + extension] = [head, *staged.files, tail]
        entries.append(_settled(e, name is not None).updated(filename=name))
    # A table of contents beside its files says "Tar".
    toc = replace(b.toc, header=replace(h, format="Tar"), entries=tuple(entries))
    if b.rows is None:
        data = [put_preamble(toc) + b"".join(put_entry(e, toc.header, True) for e in entries)]
    else:
        data = [put_preamble(toc, b.n_rows), *_stage_entries(spark, b, entries, toc.header, True, staging)[0]]
    return {"toc.dat": data} | dict(sorted(out.items()))


def _stage_objects(objects: tuple[DataFrame, ...], staging: str, name: str, codec: str) -> tuple[list[str], list[str]]:
    """Large objects as files of their own; (staged parts of their list, files)."""
    folder, extension = storage.join(staging, "objects"), codecs.EXTENSIONS[codec]

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, files = TaskContext.get().partitionId(), []
        attempt = uuid.uuid4().hex
        listed = storage.join(staging, f"{name}-{part}-{attempt}")
        with storage.create(listed) as out:
            for batch in batches:
                for oid, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    _check(oid)
                    base = f"blob_{oid}.dat"
                    files.append(storage.join(folder, f"{attempt}/{base}{extension}"))
                    with storage.create(files[-1]) as file:
                        for piece in _whole(data or b"", codec, True):
                            file.write(piece)
                    out.write(f"{oid} {base}\n".encode())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([listed]), pa.array([files], pa.list_(pa.string()))], names=["part", "listed", "files"])

    lists, files = [], []
    for df in objects:
        rows = df.select("oid", "data").mapInArrow(stage, "part int, listed string, files array<string>").collect()
        for r in sorted(rows, key=lambda r: r.part):
            lists.append(r.listed)
            files += r.files
    return lists, files


def _stage_lists(objects: tuple[DataFrame, ...], staging: str, name: str) -> list[str]:
    """The staged parts of a list of large objects."""

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        listed = storage.join(staging, f"{name}-{part}-{uuid.uuid4().hex}")
        with storage.create(listed) as out:
            for batch in batches:
                for oid in batch.column(0).to_pylist():
                    _check(oid)
                    out.write(f"{oid} blob_{oid}.dat\n".encode())
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([listed])], names=["part", "listed"])

    out = []
    for df in objects:
        rows = df.select("oid").mapInArrow(stage, "part int, listed string").collect()
        out += [r.listed for r in sorted(rows, key=lambda r: r.part)]
    return out


def _stage_tar_members(objects: list[DataFrame], staging: str) -> list[str]:
    """Large objects as members of a tar, headers and all, in the order of their names: staged files
    with many members each.  Of objects of one name, the last one counts."""
    rows = None
    for i, df in enumerate(objects):
        # Where a row stands in its DataFrame, which is as it was listed.
        df = df.select("oid", "data", F.lit(i).alias("which"), F.monotonically_increasing_id().alias("nth"))
        rows = df if rows is None else rows.union(df)
    name = F.concat(F.lit("blob_"), F.col("oid"), F.lit(".dat"))

    def stage(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held = TaskContext.get().partitionId(), None
        file = storage.join(staging, f"members-{part}-{uuid.uuid4().hex}")
        with storage.create(file) as out:

            def put(name: str, data: bytes) -> None:
                out.write(containers.tar_header(name, len(data)))
                out.write(data)
                out.write(b"\0" * (-len(data) % containers.TAR_BLOCK))

            for batch in batches:
                for name, data in zip(*batch.columns, strict=True):
                    name, data = name.as_py(), data.as_py() or b""
                    if held and held[0] != name:
                        put(*held)
                    held = name, data
            if held:
                put(*held)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([file])], names=["part", "file"])

    # All rows of a name are in one partition.
    sorted_rows = rows.withColumn("name", name).repartitionByRange("name").sortWithinPartitions("name", "which", "nth")
    staged = sorted_rows.select("name", "data").mapInArrow(stage, "part int, file string").collect()
    return [r.file for r in sorted(staged, key=lambda r: r.part)]


def _save_directory(spark: SparkSession, b: ArchiveBuilder, path: str, staging: str) -> None:
    folder = storage.join(staging, "archive")
    _assemble(spark, {storage.join(folder, name): parts for name, parts in _members(spark, b, staging).items()})
    storage.put_in_place(folder, path)  # nothing of an older archive stays beside the new files


def _save_tar(spark: SparkSession, b: ArchiveBuilder, path: str, staging: str) -> None:
    whole = storage.join(staging, "archive")
    plan: list[bytes | str] = []
    named = _members(spark, b, staging, objects=False) | {"restore.sql": [containers.RESTORE]}
    held = [df for e in b.entries if e.desc == "BLOBS" for df in b.objects.get(e.dump_id, ())]
    members = _stage_tar_members(held, staging) if held else []
    for name, parts in named.items():
        if name != "toc.dat" and name > "blob_":
            # Lists and the script come behind the objects, payloads (by number) before.
            plan += members
            members = []
        size = sum(len(x) if isinstance(x, bytes) else storage.open_file(x)[1] for x in parts)
        plan += [containers.tar_header(name, size), *parts, b"\0" * (-size % containers.TAR_BLOCK)]
    _assemble(spark, {whole: [*plan, b"\0" * 2 * containers.TAR_BLOCK]})
    storage.put_in_place(whole, path)
