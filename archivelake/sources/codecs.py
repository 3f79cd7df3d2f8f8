"""Streaming codecs of payloads.

A payload is compressed in parts by many tasks and still becomes one stream:

* gzip: a part is deflate blocks that end at a byte boundary and look at nothing
  before it; the whole is a header, all parts, an empty last block and a checksum,
  combined from those of the parts.
* lz4: a part is a frame; the whole is one frame header, the blocks of all parts
  and one end mark.
* zstd: a part is a frame, and frames may follow each other.

Inside a custom archive, gzip means zlib framing; files of a directory have gzip framing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa

from ..errors import DecompressionError, UnsupportedCompression

#: File name extensions in the order in which they are looked for.
EXTENSIONS = {"none": "", "gzip": ".gz", "lz4": ".lz4", "zstd": ".zst"}

_LZ4_MAGIC = b"\x04\x22\x4d\x18"
_ADLER = 65521


def _deflated(chunks: Iterable[bytes]) -> Iterator[bytes]:
    tool = zlib.compressobj(wbits=-15)
    for chunk in chunks:
        if out := tool.compress(chunk):
            yield out
    yield tool.flush(zlib.Z_FULL_FLUSH)


def _arrow(chunks: Iterable[bytes], codec: str) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.CompressedOutputStream(sink, codec) as out:
        for chunk in chunks:
            out.write(chunk)
    return sink.getvalue().to_pybytes()


def _lz4_header(data: bytes) -> int:
    """The length of a frame's header."""
    if data[:4] != _LZ4_MAGIC:
        raise DecompressionError("not an LZ4 frame")
    return 7 + 8 * bool(data[4] & 0x08) + 4 * bool(data[4] & 0x01)


def encode_part(chunks: Iterable[bytes], codec: str) -> Iterator[bytes]:
    """A part of a payload, ready to be put between others."""
    if codec == "none":
        yield from chunks
    elif codec == "gzip":
        yield from _deflated(chunks)
    elif codec == "zstd":
        yield _arrow(chunks, "zstd")
    elif codec == "lz4":
        frame = _arrow(chunks, "lz4")
        checksum = 4 * bool(frame[4] & 0x04)
        yield frame[_lz4_header(frame) : len(frame) - 4 - checksum]
    else:
        raise UnsupportedCompression(codec)


def head(codec: str, gzip_file: bool) -> bytes:
    """What comes before all parts."""
    if codec == "gzip":
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" if gzip_file else b"\x78\x9c"
    if codec == "lz4":
        frame = _arrow([], "lz4")
        return frame[: _lz4_header(frame)]
    return b""


def tail(codec: str, gzip_file: bool, sums: Checksums) -> bytes:
    """What comes after all parts."""
    if codec == "gzip":
        end = b"\x03\x00"  # an empty last block
        if gzip_file:
            return end + sums.crc.to_bytes(4, "little") + (sums.size & 0xFFFFFFFF).to_bytes(4, "little")
        return end + sums.adler.to_bytes(4, "big")
    return b"\0\0\0\0" if codec == "lz4" else b""


class Checksums:
    """Size, Adler-32 and CRC-32 of bytes; ``then`` gives those of two runs of bytes in a row."""

    def __init__(self, size: int = 0, adler: int = 1, crc: int = 0) -> None:
        self.size, self.adler, self.crc = size, adler, crc

    def add(self, data: bytes) -> None:
        self.size += len(data)
        self.adler, self.crc = zlib.adler32(data, self.adler), zlib.crc32(data, self.crc)

    def then(self, other: Checksums) -> Checksums:
        a1, b1, a2, b2 = self.adler & 0xFFFF, self.adler >> 16, other.adler & 0xFFFF, other.adler >> 16
        a = (a1 + a2 - 1) % _ADLER
        b = (b1 + b2 + other.size * (a1 - 1)) % _ADLER
        return Checksums(self.size + other.size, b << 16 | a, _shifted(self.crc, other.size) ^ other.crc)


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


def _shifted(crc: int, zeros: int) -> int:
    """A CRC-32 after ``zeros`` more zero bytes, without their own effect: a power of the one-bit step as a bit matrix."""
    step = [0xEDB88320, *(1 << i for i in range(31))]
    for _ in range(3):
        step = [_times(step, row) for row in step]
    while zeros:
        if zeros & 1:
            crc = _times(step, crc)
        step = [_times(step, row) for row in step]
        zeros >>= 1
    return crc


def decode(chunks: Iterable[bytes], codec: str, gzip_file: bool = False) -> Iterator[bytes]:
    """The plain bytes of a stream, in pieces; no bytes at all are an empty payload.

    A gzip file is read to the end of its first member.
    """
    if codec == "none":
        yield from chunks
        return
    started = False
    try:
        if codec == "gzip":
            tool = zlib.decompressobj(31 if gzip_file else 15)
            for chunk in chunks:
                started = True
                while chunk and not tool.eof:
                    if out := tool.decompress(chunk, 1 << 20):
                        yield out
                    chunk = tool.unconsumed_tail
            if started and not tool.eof:
                raise DecompressionError("the stream ends too early")
        elif codec in ("lz4", "zstd"):
            source = _Joined(chunks)
            if not source.more():
                return
            if codec == "zstd":
                import zstandard

                with zstandard.ZstdDecompressor().stream_reader(source, read_across_frames=True) as stream:
                    while out := stream.read(1 << 20):
                        yield out
            else:
                with pa.CompressedInputStream(pa.PythonFile(source, "r"), "lz4") as stream:
                    while out := stream.read(1 << 20):
                        yield out
        else:
            raise UnsupportedCompression(codec)
    except (zlib.error, OSError, ValueError) as e:
        raise DecompressionError(str(e)) from e
    except Exception as e:
        if type(e).__module__.startswith(("zstd", "zstandard")):
            raise DecompressionError(str(e)) from e
        raise


class _Joined:
    """Chunks as a readable file."""

    closed = False

    def __init__(self, chunks: Iterable[bytes]) -> None:
        self.chunks, self.left = iter(chunks), b""

    def more(self) -> bool:
        while not self.left:
            try:
                self.left = next(self.chunks)
            except StopIteration:
                return False
        return True

    def read(self, n: int = -1) -> bytes:
        if n < 0:
            out = self.left + b"".join(self.chunks)
            self.left = b""
            return out
        parts = []
        while n and self.more():
            parts.append(self.left[:n])
            self.left = self.left[len(parts[-1]) :]
            n -= len(parts[-1])
        return b"".join(parts)

    def readable(self) -> bool:
        return True

    def writable(self) -> bool:
        return False

    def seekable(self) -> bool:
        return False

    def close(self) -> None:
        self.closed = True
