"""Interleaved document sequences: text and media references from HTML, payloads by digest.

``sequences`` parses HTML into an ordered array of structs; a struct is a run of
text or a reference to media, with its caption.  ``store`` turns payloads into
stored media, keyed by the digest of the stored form, so that equal payloads are
one medium.  ``resolve`` joins references to media by digest: positions and
captions stay as they are, and a reference without a medium keeps nulls.

The stored form is an 8-bit greyscale PNG, 192 samples to a row: payloads are
padded with blanks to a positive multiple of 192 bytes.

Nulls: null HTML has no elements, a null payload counts as empty.  Repeated rows
are parsed each by itself.  A very long payload or text is handled whole, in a few times
its size of memory.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

ROW = 192
_MAGIC = b"\x89PNG\r\n\x1a\n"
ELEMENTS = "array<struct<position:int,kind:string,text:string,media:string,caption:string>>"
_ELEMENT = pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("media", pa.string()), ("caption", pa.string())])
_SKIPPED = {"script", "style", "head", "template", "noscript"}
_BLOCKS = {"p", "div", "article", "section", "figure", "figcaption", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "br", "tr", "td", "th", "table", "nav", "header", "footer", "main", "blockquote", "pre"}
_MEDIA = {"img": "src", "video": "src", "audio": "src", "source": "src", "object": "data", "embed": "src"}


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    """``data`` and blanks up to a positive multiple of ROW."""
    return data + b" " * (max(ROW, -(-len(data) // ROW) * ROW) - len(data))


def png(payload: bytes) -> bytes:
    """A greyscale PNG whose samples are ``payload``, a positive multiple of ROW bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    filtered = np.zeros((len(rows), ROW + 1), np.uint8)  # filter 0 before each row
    filtered[:, 1:] = rows
    head = struct.pack(">IIBBBBB", ROW, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filtered.tobytes(), 6)) + _chunk(b"IEND", b"")


def samples(image: bytes) -> np.ndarray:
    """The samples of a PNG as ``png`` writes it, checked against its sums and sizes."""
    if image[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, parts, size = 8, [], (0, 0)
    while at < len(image):
        (length,) = struct.unpack_from(">I", image, at)
        kind, data = image[at + 4 : at + 8], image[at + 8 : at + 8 + length]
        if struct.unpack_from(">I", image, at + 8 + length)[0] != zlib.crc32(kind + data):
            raise ValueError("a chunk of the PNG is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", data[:8])
            if data[8:] != bytes([8, 0, 0, 0, 0]):
                raise ValueError("not an 8-bit greyscale PNG")
        elif kind == b"IDAT":
            parts.append(data)
        at += length + 12
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(size[1], size[0] + 1)
    if rows[:, 0].any():
        raise ValueError("the PNG has filtered rows")
    return rows[:, 1:]


def feature(image: np.ndarray) -> str:
    """Size, mean and mean square of the samples in thousandths, and 64 bits that say
    which cells of an 8 x 8 grid are brighter than the mean; integers only."""
    rows, width = image.shape
    n, counts, values = image.size, np.zeros(256, np.int64), np.arange(256, dtype=np.int64)
    for at in range(0, rows, 4096):
        counts += np.bincount(image[at : at + 4096].ravel(), minlength=256)
    total, square = int(counts @ values), int(counts @ values**2)
    edges = [rows * i // 8 for i in range(9)]
    bits = 0
    for a, b in zip(edges, edges[1:], strict=False):
        a, b = min(a, rows - 1), min(max(b, a + 1), rows)
        cells = image[a:b].sum(0, dtype=np.int64).reshape(8, width // 8).sum(1)
        for c in cells:
            bits = bits << 1 | int(int(c) * n > total * (b - a) * (width // 8))
    return f"{width}x{rows};mean={1000 * total // n};square={1000 * square // n};grid={bits:016x}"


def store(payloads: DataFrame) -> DataFrame:
    """digest and n_bytes (of the payload before padding) and media (the stored PNG) of each
    row of ``payloads(payload binary)``; rows with equal payloads give equal rows."""

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                data = [x.as_py() or b"" for x in batch.column(0).slice(at, 256)]
                yield pa.RecordBatch.from_pydict({
                    "digest": pa.array([hashlib.sha256(d).hexdigest() for d in data], pa.string()),
                    "n_bytes": pa.array([len(d) for d in data], pa.int64()),
                    "media": pa.array([png(pad(d)) for d in data], pa.binary()),
                })

    return pick(payloads, "payload").mapInArrow(stored, "digest string, n_bytes long, media binary")


def measured(media: DataFrame) -> DataFrame:
    """digest, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256 and
    feature of each distinct stored medium, taken from the samples that its bytes decode to."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for digest, n_bytes, data in zip(*batch.columns, strict=True):
                image = samples(stored := data.as_py())
                payload = image.tobytes()
                rows.append((digest.as_py(), n_bytes.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(image)))
            names = ["digest", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    kinds = "digest string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    # Equal media are measured where they lie; only the narrow results meet by digest.
    return pick(media, "digest", "n_bytes", "media").mapInArrow(read, kinds).dropDuplicates(["digest"])


class _Sequence(HTMLParser):
    """Collects the elements of one document in order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[dict] = []
        self.text: list[str] = []
        self.skipped: list[str] = []  # open elements without text of the document
        self.figure: list[dict] | None = None  # the media of the open figure
        self.caption: list[str] | None = None

    def add(self, **element) -> dict:
        element = {"position": len(self.elements), "kind": None, "text": None, "media": None, "caption": None} | element
        self.elements.append(element)
        return element

    def end_text(self) -> None:
        if run := " ".join("".join(self.text).split()):
            self.add(kind="text", text=run)
        self.text = []

    def end_caption(self) -> None:
        caption, self.caption = " ".join("".join(self.caption or []).split()), None
        for found in self.figure or []:
            found["caption"] = caption

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if "head" in self.skipped and (tag == "body" or tag in _BLOCKS or tag in _MEDIA):
            self.skipped.remove("head")  # its end tag may be left out
        if tag in _SKIPPED:
            self.skipped.append(tag)
        if tag in _BLOCKS and self.caption is None:
            self.end_text()
        if tag == "figure":
            self.figure = []
        elif tag == "figcaption" and self.figure is not None:
            self.caption = []
        values = dict(attrs)
        if tag in _MEDIA and values.get(_MEDIA[tag]) and not self.skipped:
            self.end_text()
            found = self.add(kind=tag, media=values[_MEDIA[tag]], caption=values.get("alt"))
            if self.figure is not None:
                self.figure.append(found)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        if tag not in _SKIPPED:
            self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.skipped:
            self.skipped.remove(tag)
        if tag in ("figcaption", "figure") and self.caption is not None:
            self.end_caption()
        elif tag in _BLOCKS and self.caption is None:
            self.end_text()
        if tag == "figure":
            self.figure = None

    def handle_data(self, data: str) -> None:
        if self.caption is not None:
            self.caption.append(data)
        elif not self.skipped:
            self.text.append(data)


def parse(html: str | None) -> list[dict]:
    """The elements of an HTML document in order."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    if parser.caption is not None:
        parser.end_caption()
    parser.end_text()
    return parser.elements


def sequences(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key and elements (see ELEMENTS) of every row of ``pages``."""

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_pydict({key: part.column(0), "elements": pa.array([parse(x.as_py()) for x in part.column(1)], pa.list_(_ELEMENT))})

    rows = pick(pages, key, html)
    return rows.mapInArrow(parsed, f"{key} {rows.schema[key].dataType.simpleString()}, elements {ELEMENTS}")


def escaped(text: Column) -> Column:
    """A text as HTML that shows it."""
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(sign), F.lit(name))
    return text


def reference(digest: Column, caption: Column) -> Column:
    """HTML of a figure that refers to the medium of ``digest``."""
    return F.concat(F.lit('<figure><img src="sha256:'), digest, F.lit('"><figcaption>'), escaped(caption), F.lit("</figcaption></figure>"))


def page(text: Column, figure: Column) -> Column:
    """HTML of a text, a paragraph for each line, with ``figure`` behind the first one."""
    first = F.substring_index(text, "\n", 1)
    rest = F.replace(escaped(F.substring(text, F.length(first) + 2, F.length(text))), F.lit("\n"), F.lit("</p>\n<p>"))
    return F.concat(F.lit("<p>"), escaped(first), F.lit("</p>\n"), figure, F.lit("\n<p>"), rest, F.lit("</p>"))


def resolve(sequence: DataFrame, key: str, media: DataFrame) -> DataFrame:
    """One row per media reference: key, position, caption, n_elements (of the document), before and
    after (the last text in front of it and the first behind it, null if there is none), digest
    and the columns of ``media(digest, ...)``, whose digests are distinct; null where no medium
    has the digest."""
    refs = sequence.select(key, "elements", F.explode("elements").alias("e")).where("e.media is not null")

    def beside(step: int) -> Column:
        return F.get(F.col("elements"), F.col("e.position") + step)["text"]

    refs = refs.select(
        key,
        F.col("e.position").alias("position"),
        F.col("e.caption").alias("caption"),
        F.size("elements").cast("long").alias("n_elements"),
        beside(-1).alias("before"),
        beside(1).alias("after"),
        F.regexp_replace("e.media", "^sha256:", "").alias("digest"),
    )
    return refs.join(media, "digest", "left")
