"""The bytes of headers and tables of contents: one reader and one writer for all containers."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ArchiveIOError, DataIntegrity, InvalidHeader, InvalidUtf8, UnsupportedCompression, UnsupportedFormat, UnsupportedVersion
from . import versions
from .dates import PARTS
from .objecttypes import CODECS, FORMATS, OFFSET_STATES, SECTIONS

# Fixed values of the archive format.
MAGIC = b"PGDMP"
LEVEL_WRITTEN = 6
CODEC_BYTE_FROM = (1, 15, 0)
TABLEAM_FROM = (1, 14, 0)
RELKIND_FROM = (1, 16, 0)

_INT_MIN, _INT_MAX = -(2**31), 2**31 - 1

#: Entries of a block; a table of contents of more entries is read anew, by blocks, whenever it is wanted.
BLOCK = 10_000


@dataclass(frozen=True)
class Header:
    version: versions.Version = versions.NEWEST
    int_size: int = 4
    off_size: int = 8
    format: str = "Custom"
    compression: str = "none"


@dataclass(frozen=True)
class Entry:
    """One row of a table of contents."""

    dump_id: int
    desc: str
    had_dumper: bool = False
    table_oid: str = "0"
    oid: str = "0"
    tag: str | None = None
    section: str = "None"
    defn: str | None = None
    drop_stmt: str | None = None
    copy_stmt: str | None = None
    namespace: str | None = None
    tablespace: str | None = None
    tableam: str | None = None
    relkind: str | None = None
    owner: str | None = None
    with_oids: bool = False
    dependencies: tuple[int, ...] = ()
    data_state: str = "NoData"
    offset: int = 0
    filename: str | None = None

    def updated(self, **changes) -> Entry:
        return replace(self, **changes)


@dataclass(frozen=True)
class Toc:
    """All that an archive says about itself."""

    header: Header
    timestamp: dict[str, int]
    dbname: str
    server_version: str
    dump_version: str
    entries: Sequence[Entry] = field(default=())


class Reader:
    """Reads wire values from a seekable file of a known size."""

    def __init__(self, file, size: int, int_size: int = 4, off_size: int = 8) -> None:
        self.file, self.size, self.int_size, self.off_size = file, size, int_size, off_size

    def take(self, n: int) -> bytes:
        if n > self.size - self.file.tell():
            raise ArchiveIOError(f"{n} bytes wanted at {self.file.tell()} of {self.size}")
        data = self.file.read(n)
        if len(data) != n:
            raise ArchiveIOError("the file ends too early")
        return data

    def byte(self) -> int:
        return self.take(1)[0]

    def int(self) -> int:
        """A sign byte and a little-endian magnitude."""
        raw = self.take(1 + self.int_size)
        value = int.from_bytes(raw[1:], "little")
        value = -value if raw[0] else value
        if not _INT_MIN <= value <= _INT_MAX:
            raise DataIntegrity(f"integer out of range: {value}")
        return value

    def oid(self) -> int:
        """An integer that may take all of its magnitude: object ids have no sign."""
        raw = self.take(1 + self.int_size)
        value = int.from_bytes(raw[1:], "little")
        if raw[0] or value >= 1 << 32:
            raise DataIntegrity(f"object id out of range: {value}")
        return value

    def string(self) -> str | None:
        """A length and UTF-8 bytes; null and empty are both null."""
        n = self.int()
        if n <= 0:
            return None
        try:
            return self.take(n).decode()
        except UnicodeDecodeError as e:
            raise InvalidUtf8(str(e)) from e

    def offset(self) -> tuple[str, int]:
        state = OFFSET_STATES.get(self.byte())
        value = int.from_bytes(self.take(self.off_size), "little")
        if state is None:
            raise DataIntegrity("unknown offset state")
        if value >= 1 << 63:
            raise DataIntegrity(f"offset out of range: {value}")
        return state, value


def put_int(value: int, size: int) -> bytes:
    return bytes([value < 0]) + abs(value).to_bytes(size, "little")


def put_string(value: str | None, size: int) -> bytes:
    if value is None:
        return put_int(-1, size)
    raw = value.encode()
    return put_int(len(raw), size) + raw


def put_offset(state: str, value: int, size: int) -> bytes:
    return bytes([next(k for k, v in OFFSET_STATES.items() if v == state)]) + value.to_bytes(size, "little")


def read_header(r: Reader) -> Header:
    if r.size < len(MAGIC) or r.take(len(MAGIC)) != MAGIC:
        raise InvalidHeader("no dump archive: its magic bytes are missing")
    major, minor = r.byte(), r.byte()
    version = (major, minor, r.byte() if (major, minor) > (1, 0) else 0)
    if not versions.supported(version):
        raise UnsupportedVersion(versions.text(version))
    r.int_size, r.off_size = r.byte(), r.byte()
    for what, n in (("integer", r.int_size), ("offset", r.off_size)):
        if not 1 <= n <= 8:
            raise InvalidHeader(f"{what} size {n}")
    if (code := r.byte()) not in FORMATS:
        raise UnsupportedFormat(str(code))
    if version >= CODEC_BYTE_FROM:
        if (codec := r.byte()) not in CODECS:
            raise UnsupportedCompression(str(codec))
        compression = CODECS[codec]
    else:
        compression = "gzip" if r.int() else "none"  # a level
    return Header(version, r.int_size, r.off_size, FORMATS[code], compression)


def put_header(h: Header) -> bytes:
    if h.version >= CODEC_BYTE_FROM:
        codec = bytes([next(k for k, v in CODECS.items() if v == h.compression)])
    elif h.compression in ("none", "gzip"):
        codec = put_int(LEVEL_WRITTEN if h.compression == "gzip" else 0, h.int_size)
    else:
        raise UnsupportedCompression(f"{h.compression} needs archive version {versions.text(CODEC_BYTE_FROM)}")
    code = next(k for k, v in FORMATS.items() if v == h.format)
    return MAGIC + bytes([*h.version, h.int_size, h.off_size, code]) + codec


def read_entry(r: Reader, version: versions.Version, with_file: bool) -> Entry:
    """with_file: whether a file name follows, as in directories and tars, or an offset."""
    dump_id, had_dumper = r.int(), r.int() != 0
    table_oid, oid, tag, desc = r.string() or "0", r.string() or "0", r.string(), r.string()
    if desc is None:
        raise DataIntegrity(f"entry {dump_id} has no description")
    number = r.int()
    section = SECTIONS[number - 1] if 1 <= number <= len(SECTIONS) else "None"
    defn, drop_stmt, copy_stmt, namespace, tablespace = (r.string() for _ in range(5))
    tableam = r.string() if version >= TABLEAM_FROM else None
    relkind = None
    if version >= RELKIND_FROM:
        code = r.int()
        if 0 < code < 0x110000 and not 0xD800 <= code < 0xE000:
            relkind = chr(code)
    owner, with_oids = r.string(), r.string() == "true"
    dependencies = []
    while (word := r.string()) is not None:
        digits = word[1:] if word[:1] in "+-" else word
        if digits.isascii() and digits.isdigit() and _INT_MIN <= int(word) <= _INT_MAX:
            dependencies.append(int(word))
    filename, offset = None, 0
    if with_file:
        filename = r.string()
        state = "NotSet" if filename else "NoData"
    else:
        state, offset = r.offset()
    return Entry(
        dump_id, desc, had_dumper, table_oid, oid, tag, section, defn, drop_stmt, copy_stmt, namespace, tablespace,
        tableam, relkind, owner, with_oids, tuple(dependencies), state, offset, filename,
    )


def put_entry(e: Entry, h: Header, with_file: bool) -> bytes:
    """All of an entry; an offset is its last ``1 + off_size`` bytes."""
    n = h.int_size
    strings = [e.table_oid, e.oid, e.tag, e.desc]
    out = [put_int(e.dump_id, n), put_int(int(e.had_dumper), n), *(put_string(s, n) for s in strings)]
    out.append(put_int(SECTIONS.index(e.section) + 1, n))
    out += [put_string(s, n) for s in (e.defn, e.drop_stmt, e.copy_stmt, e.namespace, e.tablespace)]
    if h.version >= TABLEAM_FROM:
        out.append(put_string(e.tableam, n))
    if h.version >= RELKIND_FROM:
        out.append(put_int(ord(e.relkind) if e.relkind else 0, n))
    out += [put_string(e.owner, n), put_string("true" if e.with_oids else "false", n)]
    out += [put_string(str(d), n) for d in e.dependencies]
    out.append(put_string(None, n))
    out.append(put_string(e.filename, n) if with_file else put_offset(e.data_state, e.offset, h.off_size))
    return b"".join(out)


@dataclass(frozen=True)
class Entries(Sequence):
    """The entries of a large table of contents: only where its blocks begin, and the last one ends, is held.

    ``opened`` gives the file and the size of what ``marks`` are places in."""

    opened: Callable[[], tuple]
    header: Header
    with_file: bool
    number: int
    marks: tuple[int, ...]

    def __len__(self) -> int:
        return self.number

    def blocks(self) -> Iterator[tuple[int, Entries]]:
        """Each block as entries of its own, behind the place of its first entry."""
        for k in range(len(self.marks) - 1):
            yield k * BLOCK, replace(self, number=min(BLOCK, self.number - k * BLOCK), marks=self.marks[k : k + 2])

    def block(self, k: int) -> list[Entry]:
        file, _ = self.opened()
        with file:
            file.seek(self.marks[k])
            data = file.read(self.marks[k + 1] - self.marks[k])
        r = Reader(io.BytesIO(data), len(data), self.header.int_size, self.header.off_size)
        return [read_entry(r, self.header.version, self.with_file) for _ in range(min(BLOCK, self.number - k * BLOCK))]

    def __iter__(self) -> Iterator[Entry]:
        for k in range(len(self.marks) - 1):
            yield from self.block(k)

    def __getitem__(self, i):
        if isinstance(i, slice):
            return tuple(self[j] for j in range(*i.indices(self.number)))
        i = i + self.number if i < 0 else i
        if not 0 <= i < self.number:
            raise IndexError(i)
        return self.block(i // BLOCK)[i % BLOCK]


def _skip(buf: bytes, at: int, n: int, layout: str, last: int) -> int:
    """Where the next entry begins; IndexError if the buffer ends before."""
    for kind in layout:
        while True:
            head = buf[at : at + n + 1]
            if len(head) <= n:
                raise IndexError
            at += n + 1
            length = 0 if head[0] else int.from_bytes(head[1:], "little")
            if kind == "s":
                at += length
            elif kind == "d" and length:
                at += length
                continue  # dependencies go on to the first empty one
            break
    at += last
    if at > len(buf):
        raise IndexError
    return at


def toc_marks(file, start: int, size: int, header: Header, count: int, with_file: bool, ahead: int = 4 << 20) -> tuple[int, ...]:
    """Where every BLOCK-th entry begins and where the last one ends; only lengths are looked at."""
    layout = "iissss" + "i" + "sssss" + "s" * (header.version >= TABLEAM_FROM) + "i" * (header.version >= RELKIND_FROM) + "ss" + "d" + "s" * with_file
    last = 0 if with_file else 1 + header.off_size
    file.seek(start)
    buf, at, marks, n = b"", 0, [], header.int_size
    for k in range(count):
        if k % BLOCK == 0:
            marks.append(start + at)
        while True:
            try:
                at = _skip(buf, at, n, layout, last)
                break
            except IndexError:
                more = file.read(max(ahead, len(buf) - at))
                if not more:
                    raise ArchiveIOError("the file ends too early") from None
                buf, start, at = buf[at:] + more, start + at, 0
    return (*marks, start + at)


def read_toc(file, size: int, with_file: bool, opened: Callable[[], tuple] | None = None, marks: tuple[int, ...] | None = None) -> Toc:
    """opened: gives a (seekable file, size) of the same bytes, for a table of contents of more than BLOCK
    entries, of which then no entry is held; marks: of its blocks, if they are known."""
    r = Reader(file, size)
    header = read_header(r)
    timestamp = {p: r.int() for p in PARTS}
    dbname, server_version, dump_version = (r.string() or "" for _ in range(3))
    count = r.int()
    if count < 0:
        raise DataIntegrity(f"{count} entries")
    if opened and count > BLOCK:
        if marks is None:
            again, _ = opened()
            with again:
                marks = toc_marks(again, file.tell(), size, header, count, with_file)
        return Toc(header, timestamp, dbname, server_version, dump_version, Entries(opened, header, with_file, count, tuple(marks)))
    entries = []
    for _ in range(count):  # each is read before the next is believed in
        entries.append(read_entry(r, header.version, with_file))
    return Toc(header, timestamp, dbname, server_version, dump_version, tuple(entries))


def put_preamble(toc: Toc, more: int = 0) -> bytes:
    """Header, timestamp, names and the number of entries, with ``more`` that the toc doesn't hold."""
    n = toc.header.int_size
    out = [put_header(toc.header), *(put_int(toc.timestamp[p], n) for p in PARTS)]
    out += [put_string(s, n) for s in (toc.dbname, toc.server_version, toc.dump_version)]
    return b"".join([*out, put_int(len(toc.entries) + more, n)])


def int_hex(value: Column, size: int = 4) -> Column:
    """The wire bytes of an integer column, in lower-case hexadecimal."""
    magnitude = F.abs(value.cast("long"))
    sign = F.when(value < 0, "01").otherwise("00")
    return F.lower(F.concat(sign, *[F.lpad(F.hex(F.shiftright(magnitude, 8 * i).bitwiseAND(F.lit(255))), 2, "0") for i in range(size)]))


def string_read(value: Column) -> Column:
    """A string as it is read back once written: empty is null."""
    return F.nullif(value, F.lit(""))
