"""The three containers: where the table of contents and each payload lie.

A container is opened on the driver, which reads only the table of contents and
the places of payloads.  A payload is cut into splits; a split is read by one task,
which seeks to it.
"""

from __future__ import annotations

import io
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

from ..errors import ArchiveIOError, DataIntegrity, InvalidHeader
from ..functions.wire import Entry, Reader, Toc, read_toc
from . import codecs, storage

# Fixed values of the formats.
TAR_BLOCK = 512
DATA_BLOCK, BLOBS_BLOCK = 1, 3
TAR_MAGICS = (b"ustar\0", b"ustar  \0")

#: A script has its place in a tar; nothing reads it.
RESTORE = b"-- Restore this archive with pg_restore.\n"
#: Bytes of an uncompressed payload that one task reads: as many as there are for each
#: core, within these bounds.
SPLIT_BYTES = 64 << 20
LEAST_SPLIT = 4 << 20


@dataclass(frozen=True)
class Split:
    """A run of bytes of one payload in one file.

    framed: the bytes are chunks with lengths, as in custom archives, from ``start``
    to a chunk of length 0 or ``end``; else they are plain from ``start`` to ``end``.
    lines: whether it may begin inside a line, which then belongs to the split before,
    and the line that runs over its end belongs to it; ``stop`` is where the payload ends.
    """

    dump_id: int
    number: int
    path: str
    start: int
    end: int
    stop: int
    codec: str = "none"
    framed: bool = False
    gzip_file: bool = False
    int_size: int = 4


@dataclass(frozen=True)
class BlobRef:
    """One large object that is a file or a member of its own."""

    dump_id: int
    pos: int
    oid: int
    split: Split


def detect(path: str) -> str:
    """"Directory", "Custom" or "Tar"; a file that is neither counts as custom, and fails there."""
    what = storage.kind(path)
    if what is None:
        raise ArchiveIOError(f"no such file: {path}")
    if what == "directory":
        return "Directory"
    file, _ = storage.open_file(path)
    with file:
        start = file.read(265)
    if start[:5] == b"PGDMP":
        return "Custom"
    return "Tar" if start[257:].startswith(TAR_MAGICS) else "Custom"


def chunks(file, size: int, int_size: int, end: int | None = None) -> Iterator[bytes]:
    """The chunks of a block from where ``file`` stands, to the one of length 0 or to ``end``."""
    r = Reader(file, size, int_size)
    while end is None or file.tell() < end:
        n = r.int()
        if n < 0:
            raise DataIntegrity(f"chunk of length {n}")
        if not n:
            return
        yield r.take(n)


def _plain(file, start: int, end: int) -> Iterator[bytes]:
    file.seek(start)
    while start < end:
        data = file.read(min(1 << 20, end - start))
        if not data:
            raise ArchiveIOError("the file ends too early")
        start += len(data)
        yield data


def raw(split: Split) -> Iterator[bytes]:
    """The decoded bytes of a split."""
    file, size = storage.open_file(split.path)
    with file:
        file.seek(split.start)
        source = chunks(file, size, split.int_size, split.end if split.end < split.stop else None) if split.framed else _plain(file, split.start, split.end)
        yield from codecs.decode(source, split.codec, split.gzip_file)


def _after(split: Split) -> Iterator[bytes]:
    """The bytes of the payload behind an uncompressed split."""
    if split.end < split.stop:
        yield from raw(replace(split, start=split.end, end=split.stop))


def lines(split: Split) -> Iterator[list[bytes]]:
    """The lines of a split in groups, without their ends: cut at "\\n", less one "\\r" before it."""
    held: list[bytes] = []  # the pieces of a line that isn't whole yet
    skipping = split.number > 0
    for data in raw(split):
        if skipping:
            cut = data.find(b"\n")
            if cut < 0:
                continue
            data, skipping = data[cut + 1 :], False
        if b"\n" not in data:
            held.append(data)
            continue
        *whole, rest = b"".join([*held, data]).split(b"\n")
        held = [rest]
        yield [x.removesuffix(b"\r") for x in whole] if b"\r" in data or whole[0][-1:] == b"\r" else whole
    if skipping:
        return  # a line that began before runs through all of it
    if split.end < split.stop:
        # The line that begins here, or right behind the end, is this split's.
        for data in _after(split):
            cut = data.find(b"\n")
            if cut >= 0:
                yield [b"".join([*held, data[:cut]]).removesuffix(b"\r")]
                return
            held.append(data)
    if rest := b"".join(held):
        yield [rest]


def blob_block(split: Split) -> Iterator[tuple[int, bytes]]:
    """(oid, bytes) of the large objects of a blobs block of a custom archive."""
    file, size = storage.open_file(split.path)
    with file:
        file.seek(split.start)
        r = Reader(file, size, split.int_size)
        while oid := r.oid():
            yield oid, b"".join(codecs.decode(chunks(file, size, split.int_size), split.codec))


class Container:
    """An opened archive: its table of contents, splits of payloads, and large objects."""

    format = "Custom"

    def __init__(self, path: str, cores: int = 1, marks: tuple[int, ...] | None = None) -> None:
        self.path, self.cores, self.marks = path, cores, marks
        self.toc = self._toc()

    def _read_toc(self, path: str, start: int, size: int, with_file: bool) -> Toc:
        opened = storage.Place(path, start, size)
        file, _ = opened()
        with file:
            return read_toc(storage.Ahead(file), size, with_file, opened, self.marks)

    def split_bytes(self, size: int) -> int:
        return min(SPLIT_BYTES, max(LEAST_SPLIT, -(-size // self.cores)))

    def _toc(self) -> Toc:
        raise NotImplementedError

    def data(self, entries: Iterable[Entry]) -> list[Split]:
        """Splits of the table payloads of ``entries``."""
        raise NotImplementedError

    def has_data(self, entry: Entry) -> bool:
        """Whether an entry has a table payload; the payload isn't looked into."""
        return bool(self.data([entry]))

    def blobs(self, entries: Iterable[Entry]) -> list[Split | BlobRef]:
        """Blocks, or single objects, of the large objects of ``entries``."""
        raise NotImplementedError


class Custom(Container):
    """One file: table of contents, then a block for each payload."""

    def _toc(self) -> Toc:
        file, size = storage.open_file(self.path)
        file.close()
        return self._read_toc(self.path, 0, size, with_file=False)

    def _blocks(self, entries: Iterable[Entry], kind: int) -> Iterator[tuple[Entry, int]]:
        """Entries with a block of that kind, and where its content begins."""
        file, size = storage.open_file(self.path)
        with file:
            r = Reader(file, size, self.toc.header.int_size)
            for e in entries:
                if e.data_state != "Set" or not e.had_dumper:
                    continue
                file.seek(e.offset)
                found = r.byte()
                if found not in (DATA_BLOCK, BLOBS_BLOCK):
                    raise DataIntegrity(f"unknown block type {found}")
                if (own := r.int()) != e.dump_id:
                    raise DataIntegrity(f"the block of entry {e.dump_id} says {own}")
                if found == kind:
                    yield e, file.tell()

    def data(self, entries: Iterable[Entry]) -> list[Split]:
        h, out = self.toc.header, []
        for e, start in self._blocks(entries, DATA_BLOCK):
            whole = Split(e.dump_id, 0, self.path, start, start, start, h.compression, True, int_size=h.int_size)
            out += self._cut(whole) if h.compression == "none" else [whole]
        return out

    def has_data(self, entry: Entry) -> bool:
        return next(self._blocks([entry], DATA_BLOCK), None) is not None

    def _cut(self, whole: Split) -> list[Split]:
        """Splits at chunk boundaries; only the chunks' lengths are read."""
        file, size = storage.open_file(self.path)
        with file:
            file.seek(whole.start)
            r = Reader(file, size, whole.int_size)
            fine, begin = [whole.start], whole.start
            while n := r.int():
                if n < 0 or n > size - file.tell():
                    raise DataIntegrity(f"chunk of length {n}")
                file.seek(n, io.SEEK_CUR)
                if file.tell() - begin >= min(LEAST_SPLIT, SPLIT_BYTES):
                    fine.append(begin := file.tell())
            stop = file.tell()
        wanted = self.split_bytes(stop - whole.start)
        marks = fine[:1]
        for at in fine[1:]:
            if at - marks[-1] >= wanted:
                marks.append(at)
        ends = [*marks[1:], stop]
        return [replace(whole, number=i, start=a, end=b, stop=stop) for i, (a, b) in enumerate(zip(marks, ends, strict=True))]

    def blobs(self, entries: Iterable[Entry]) -> list[Split | BlobRef]:
        h = self.toc.header
        return [Split(e.dump_id, 0, self.path, at, at, at, h.compression, True, int_size=h.int_size) for e, at in self._blocks(entries, BLOBS_BLOCK)]


class Directory(Container):
    """A folder of files; what a file's name ends in says how it is compressed."""

    format = "Directory"

    def _open(self, name: str):
        """(file, offset, size) of a member, None if there is none."""
        if storage.kind(path := storage.join(self.path, name)) != "file":
            return None
        return path, 0, storage.open_file(path)[1]

    def _toc(self) -> Toc:
        found = self._open("toc.dat")
        if found is None:
            raise InvalidHeader(f"no toc.dat in {self.path}")
        toc = self._read_toc(*found, with_file=True)
        return replace(toc, header=replace(toc.header, format=self.format))

    def _bytes(self, found) -> bytes:
        file, _ = storage.open_file(found[0])
        with file:
            file.seek(found[1])
            return file.read(found[2])

    def _member(self, dump_id: int, name: str) -> Split | None:
        if "/" in name or "\\" in name or name in ("", ".", ".."):
            raise DataIntegrity(f"not a plain file name: {name!r}")
        for codec, extension in codecs.EXTENSIONS.items():
            if found := self._open(name + extension):
                path, start, size = found
                return Split(dump_id, 0, path, start, start + size, start + size, codec, gzip_file=codec == "gzip")
        return None

    def data(self, entries: Iterable[Entry]) -> list[Split]:
        out = []
        for e in entries:
            if e.filename and e.desc != "BLOBS" and (whole := self._member(e.dump_id, e.filename)):
                if whole.codec == "none" and whole.end > whole.start:
                    step = self.split_bytes(whole.end - whole.start)
                    marks = list(range(whole.start, whole.end, step))
                    out += [replace(whole, number=i, start=a, end=min(a + step, whole.stop)) for i, a in enumerate(marks)]
                else:
                    out.append(whole)
        return out

    def blobs(self, entries: Iterable[Entry]) -> list[Split | BlobRef]:
        out: list[Split | BlobRef] = []
        for e in entries:
            if not e.filename or e.desc != "BLOBS":
                continue
            if "/" in e.filename or "\\" in e.filename or e.filename in (".", ".."):
                raise DataIntegrity(f"not a plain file name: {e.filename!r}")
            found = self._open(e.filename)
            listed = self._bytes(found).decode().split("\n") if found else []
            for pos, line in enumerate(x.strip() for x in listed if x.strip()):
                oid, _, name = line.partition(" ")
                if not oid.lstrip("+-").isdigit() or not name:
                    raise DataIntegrity(f"not an object and a file: {line!r}")
                split = self._member(e.dump_id, name)
                if split is None:
                    raise DataIntegrity(f"no file of large object {oid}: {name}")
                out.append(BlobRef(e.dump_id, pos, int(oid), split))
        return out


class Tar(Directory):
    """The files of a directory in one tar; tasks seek inside it."""

    format = "Tar"

    def __init__(self, path: str, cores: int = 1, marks: tuple[int, ...] | None = None) -> None:
        self.members = members(path)
        super().__init__(path, cores, marks)

    def _open(self, name: str):
        return (self.path, *self.members[name]) if name in self.members else None


def members(path: str) -> dict[str, tuple[int, int]]:
    """(offset, size) of the members of a tar by name, up to its first empty block."""
    file, size = storage.open_file(path)
    out = {}
    with file:
        at = 0
        while at + TAR_BLOCK <= size:
            file.seek(at)
            block = file.read(TAR_BLOCK)
            name = block[:100].split(b"\0")[0].decode("utf-8", "replace")
            if not any(block) or not name:
                break
            digits = block[124:136].strip(b"\0 ")
            try:
                length = int(digits or b"0", 8)
            except ValueError as e:
                raise DataIntegrity(f"size of {name}: {digits!r}") from e
            at += TAR_BLOCK
            if length < 0 or at + length > size:
                raise DataIntegrity(f"{name} runs over the end of the file")
            if name != "restore.sql":
                if "/" in name or "\\" in name or name in (".", ".."):
                    raise DataIntegrity(f"not a plain member name: {name!r}")
                out[name] = (at, length)
            at += -(-length // TAR_BLOCK) * TAR_BLOCK
    return out


def tar_header(name: str, size: int) -> bytes:
    """The header block of a plain file."""

    def octal(value: int, width: int) -> bytes:
        digits = f"{value:0{width - 1}o}"
        if len(digits) >= width:
            raise DataIntegrity(f"{value} is too large for a tar")
        return digits.encode() + b"\0"

    block = bytearray(TAR_BLOCK)
    block[: len(raw_name)] = (raw_name := name.encode()[:99])
    for at, value, width in ((100, 0o600, 8), (108, 0, 8), (116, 0, 8), (124, size, 12), (136, 0, 12)):
        block[at : at + width] = octal(value, width)
    block[148:156] = b" " * 8
    block[156:157], block[257:265] = b"0", b"ustar\x0000"
    block[148:156] = f"{sum(block):06o}".encode() + b"\0 "
    return bytes(block)


def open_container(path: str, cores: int = 1, marks: tuple[int, ...] | None = None) -> Container:
    """marks: of the blocks of a large table of contents, where they are known."""
    return {"Custom": Custom, "Directory": Directory, "Tar": Tar}[detect(path)](path, cores, marks)

