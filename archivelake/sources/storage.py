"""Files of archives, on local disks or any file system that pyarrow reaches by its scheme."""

from __future__ import annotations

import posixpath
import re
import uuid
from dataclasses import dataclass

from pyarrow import fs

from ..errors import ArchiveIOError


def resolve(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path there."""
    if re.match(r"[A-Za-z][A-Za-z0-9+.-]*:/", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), posixpath.abspath(path)


def join(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def kind(path: str) -> str | None:
    """"file", "directory" or None."""
    system, at = resolve(path)
    found = system.get_file_info(at).type
    return {fs.FileType.File: "file", fs.FileType.Directory: "directory"}.get(found)


def open_file(path: str):
    """(seekable file, size)."""
    system, at = resolve(path)
    try:
        file = system.open_input_file(at)
        return file, file.size()
    except OSError as e:
        raise ArchiveIOError(f"{path}: {e}") from e


@dataclass(frozen=True)
class Place:
    """A run of bytes of a file; a call opens it: (seekable file, size)."""

    path: str
    start: int
    size: int

    def __call__(self) -> tuple[Part, int]:
        return Part(self), self.size


class Part:
    """A run of bytes of a file as a file of its own."""

    def __init__(self, place: Place) -> None:
        self.file, self.start, self.size, self.at = open_file(place.path)[0], place.start, place.size, 0

    def __enter__(self) -> Part:
        return self

    def __exit__(self, *error) -> None:
        self.file.close()

    def seek(self, at: int) -> None:
        self.at = at

    def read(self, n: int) -> bytes:
        self.file.seek(self.start + self.at)
        data = self.file.read(max(0, min(n, self.size - self.at)))
        self.at += len(data)
        return data


class Ahead:
    """A file that is read in order, by blocks."""

    def __init__(self, file, block: int = 1 << 20) -> None:
        self.file, self.block, self.held, self.at, self.passed = file, block, b"", 0, 0

    def tell(self) -> int:
        return self.passed + self.at

    def read(self, n: int) -> bytes:
        if self.at + n > len(self.held):
            rest = self.held[self.at :]
            self.passed += self.at
            self.held, self.at = rest + self.file.read(max(n - len(rest), self.block)), 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out


def create(path: str):
    """A new file for writing; its folder is made."""
    system, at = resolve(path)
    system.create_dir(posixpath.dirname(at), recursive=True)
    return system.open_output_stream(at, compression=None)


def move(source: str, target: str) -> None:
    system, a = resolve(source)
    system.move(a, resolve(target)[1])


def put_in_place(source: str, target: str) -> None:
    """Moves a file or folder to where another may be, which goes only when the new one is there."""
    if kind(target) is None or kind(source) == kind(target) == "file":
        move(source, target)
        return
    aside = f"{target.rstrip('/')}.old-{uuid.uuid4().hex}"
    move(target, aside)
    try:
        move(source, target)
    except Exception:
        move(aside, target)
        raise
    remove(aside)


def remove(path: str) -> None:
    system, at = resolve(path)
    found = system.get_file_info(at).type
    if found == fs.FileType.Directory:
        system.delete_dir(at)
    elif found == fs.FileType.File:
        system.delete_file(at)
