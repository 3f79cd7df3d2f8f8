"""Secret scan with a worklist of decoded layers.

The text of a document is the first layer.  Each layer is searched for secrets
and for encoded segments: percent escapes, Unicode escapes, base64 runs, and
compressed bytes at any place inside those.  A base64 run goes on over line breaks
and is decoded from each of its first four characters, so what is glued to its front
does no harm; bytes that aren't UTF-8 are searched as Latin-1.  Compressed bytes are
read to their end, all members of a stream, however often they are compressed.  Every
segment that decodes becomes a layer of its own on the worklist, until no layer is left;
a layer whose content equals one that it came from is a cycle and is dropped.  Each
character of a layer carries the span of the document that it came from, so that findings
in any layer are reported as spans of the document.

A numpy pass over whole batches first sets aside the texts that hold none of the
marks without which nothing can be found; the others go through the worklist.

Nulls: a null text counts as empty, a null doc_id is kept.  An empty text has no
spans.  Repeated rows are scanned each by itself.  An empty table gives an empty
result.  Other columns are ignored by ``scan`` and kept by ``redact``.

A very long text is searched whole, as is what compressed bytes hold: beyond ``MOST_LAYER``
bytes that comes in windows of this size, which overlap by ``OVERLAP``, so that memory is
bounded; all of them stand for the whole segment, which is reported with kind "bomb" too.
Only an encoded segment that is itself longer than the overlap and inside such a layer is
decoded window by window.
"""

from __future__ import annotations

import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, place, releasing
from .textkernel import LOWER, slices, texts_of

MOST_LAYER = 16 << 20
OVERLAP = 1 << 20
_FEED = 1 << 16
LEAST_BASE64 = 16
KINDS = ["assign", "access", "hex"]

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_HEX_BYTES = re.compile(_HEX.pattern.encode())
_KEYWORDS = [b"passw", b"secret", b"token", b"apikey", b"api_key"]

_RUN = re.compile(r"\S+")
_PERCENT_UNIT = re.compile(r"((?:%[0-9A-Fa-f]{2})+)")
_ESCAPE = r"\\u[dD][89abAB][0-9A-Fa-f]{2}\\u[dD][c-fC-F][0-9A-Fa-f]{2}|\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};"
_ESCAPE_UNIT = re.compile(f"({_ESCAPE})")
_DIGITS = r"[A-Za-z0-9+/_-]"
_BREAK = r"[\x20\t]*\r?\n[\x20\t]*"
#: Digits over several lines, or LEAST_BASE64 of them on one.
_BASE64 = re.compile(rf"(?<!{_DIGITS})(?:{_DIGITS}++(?:{_BREAK}{_DIGITS}++)++|{_DIGITS}{{{LEAST_BASE64},}}+)={{0,2}}")
_BASE64_BYTES = re.compile(_BASE64.pattern.encode())
_BASE64_LINE = re.compile(rf"{_DIGITS}+={{0,2}}")
_STANDARD = bytes.maketrans(b"-_", b"+/")
#: How compressed streams begin.
_STREAM = re.compile(rb"\x1f\x8b|\x78[\x01\x5e\x9c\xda]|BZh|\xfd7zXZ\x00|\x28\xb5\x2f\xfd")
_LONGEST_SIGN = 6
#: Without one of these, bytes hold no secret and no segment that decodes.
_MARKS = re.compile(rb"(?i:passw|secret|token|api_?key)|AKIA|%[0-9A-Fa-f]{2}|\\|&#|[A-Za-z0-9+/_-]{16}|[A-Za-z0-9+/_-][\x20\t]*\r?\n[\x20\t]*[A-Za-z0-9+/_-]|" + _STREAM.pattern)
_SHORT = {"n": 10, "t": 9, "r": 13, "0": 0, "a": 7, "b": 8, "f": 12, "v": 11, "\\": 92, "'": 39, '"': 34}
_BYTE_UNITS = {"url": _PERCENT_UNIT, "esc": re.compile(rf"({_ESCAPE}|\\[ntr0abfv\\'\"])")}

Spans = list[tuple[str, int, int]]


def base_spans(text: str) -> Spans:
    """Secrets in plain sight, by start and then kind."""
    found = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class _Source:
    """Bytes that are read once, in pieces, from an iterator; ``taken`` counts them."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held, self.taken = pieces, b"", 0

    def peek(self, n: int) -> bytes:
        if len(self.held) < n:
            parts, size = [self.held], len(self.held)
            while size < n and (more := next(self.pieces, None)) is not None:
                parts.append(more)
                size += len(more)
            self.held = b"".join(parts)
        return self.held[:n]

    def piece(self) -> bytes:
        """Some bytes; none at the end."""
        out = self.held or next(self.pieces, b"")
        self.held = b""
        self.taken += len(out)
        return out

    def back(self, data: bytes) -> None:
        self.held = data + self.held
        self.taken -= len(data)

    def read(self, n: int) -> bytes:
        """``n`` bytes, fewer at the end."""
        out = self.peek(n)
        self.held = self.held[len(out) :]
        self.taken += len(out)
        return out


def _tool(sign: bytes):
    """A decompressor for a stream that begins with ``sign``; None if it isn't one's."""
    if sign[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if _STREAM.match(sign) is None:
        return None
    if sign[0] == 0x78:
        return zlib.decompressobj()
    if sign[:1] == b"B":
        return bz2.BZ2Decompressor()
    if sign[:1] == b"\xfd":
        return lzma.LZMADecompressor()
    import zstandard

    return zstandard.ZstdDecompressor().decompressobj()


def _inflated(source: _Source, whole: list[bool]) -> Iterator[bytes]:
    """What the compressed members hold with which ``source`` begins, in pieces; ends where
    they do or are damaged, and appends whether that was the end of a member."""
    while (tool := _tool(source.peek(_LONGEST_SIGN))) is not None:
        done = False
        most = () if source.peek(1) == b"\x28" else (_FEED,)  # a zstd block is small in any case
        try:
            while not done and (data := source.piece()):
                for at in range(0, len(data), _FEED):
                    left = data[at : at + _FEED]
                    while True:  # a little input may hold very much
                        out = tool.decompress(left, *most)
                        if out:
                            yield out
                        left = getattr(tool, "unconsumed_tail", b"") if most else b""
                        if tool.eof or not most or not left and getattr(tool, "needs_input", len(out) < _FEED):
                            break
                    if tool.eof:
                        done = True
                        source.back(tool.unused_data + data[at + _FEED :])
                        break
        except Exception:
            done = False
        if not done:
            whole.append(False)
            return
        # Zeros may fill up what lies between members.
        while source.peek(1) == b"\0" and _tool(source.peek(512).lstrip(b"\0")[:_LONGEST_SIGN]):
            source.read(1)
    whole.append(True)


class _Same:
    """The place of characters that all stand for one segment."""

    def __init__(self, place: int) -> None:
        self.place = place

    def __getitem__(self, at: int | slice) -> int | list[int]:
        return [self.place] if isinstance(at, slice) else self.place


def _text(data: bytes) -> str:
    """Bytes as UTF-8 if they are that, else as Latin-1."""
    try:
        return data.decode()
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _windows(head: bytes, source: _Source) -> Iterator[bytes]:
    """``head`` and all that follows it in windows that overlap."""
    while True:
        yield head
        more = source.read(MOST_LAYER)
        if not more:
            return
        head = head[-OVERLAP:] + more


def _streams(data: bytes) -> Iterator[tuple[str, str, int, int]]:
    """(names of the layers, text, start, end) of the compressed streams in bytes, each
    compressed any number of times; of one that holds very much, "bomb" and no text, and
    then its windows, which are to be read before the next stream."""
    end = 0
    for m in _STREAM.finditer(data):
        at = m.start()
        if at < end:
            continue
        outer = source = _Source(data[i : i + _FEED] for i in range(at, len(data), _FEED))
        names, seen, whole = "", set(), []
        while True:
            ends: list[bool] = []
            inner = _Source(_inflated(source, ends))
            head = inner.read(MOST_LAYER + 1)
            digest = hashlib.sha256(head).digest()
            if not head or digest in seen:  # nothing there, or a cycle
                names = names if not head else ""
                break
            seen.add(digest)
            names += "zip/"
            whole = whole or ends
            source, last = inner, head
            source.back(head)
            if _tool(head[:_LONGEST_SIGN]) is None:
                break
        if not names:
            continue
        # A layer within that begins like a stream but isn't one is searched as it is.
        if len(last) <= MOST_LAYER:
            yield names.rstrip("/"), _text(last), at, at + outer.taken
        else:
            yield "bomb", "", at, len(data)
            if not source.taken:
                source.read(len(last))
            for window in _windows(last, source):
                if _MARKS.search(window):
                    yield names.rstrip("/"), _text(window), at, len(data)
        if whole and whole[0]:
            end = at + outer.taken  # what isn't whole may be no stream at all


def _from_base64(run: bytes) -> Iterator[tuple[int, bytes]]:
    """What base64 digits decode to from each of the first four, where that holds any mark."""
    body = run.translate(_STANDARD)
    for at in range(min(4, len(body))):
        part = body[at:]
        if len(part) % 4 == 1:
            part = part[:-1]
        data = binascii.a2b_base64(part + b"=" * (-len(part) % 4))
        if _MARKS.search(data):
            yield at, data


def _digits(run: bytes) -> bytes:
    return run.translate(None, b" \t\r\n=")


def _units(unit: re.Pattern, segment: str, decode) -> list[tuple[str, int, int]]:
    """(text, start, end) of the parts of a segment, each escape decoded."""
    out, at = [], 0
    for part in unit.split(segment):
        if part:
            escaped = unit.fullmatch(part)
            if escaped:
                out.append((decode(part), at, at + len(part)))
            else:
                out += [(c, at + i, at + i + 1) for i, c in enumerate(part)]
        at += len(part)
    return out


def _percent(part: str) -> str:
    return bytes.fromhex(part.replace("%", "")).decode("utf-8", "replace")


def _escape(part: str) -> str:
    if len(part) == 12:  # a surrogate pair
        high, low = int(part[2:6], 16), int(part[8:], 16)
        return chr(0x10000 + ((high & 0x3FF) << 10) + (low & 0x3FF))
    digits = part.strip("\\uUx{}&#X;")
    code = int(digits or "0", 10 if part[:2] == "&#" and part[2] not in "xX" else 16)
    return chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else "\ufffd"


def _unescaped(kind: str, text: str) -> tuple[bytes, list[int], list[int]]:
    """A layer as bytes with its escapes undone, and where in the layer each byte begins and ends."""
    out, starts, ends, at = bytearray(), [], [], 0

    def put(data: bytes, a: int, b: int) -> None:
        out.extend(data)
        starts.extend([a] * len(data))
        ends.extend([b] * len(data))

    def plain(a: int, b: int) -> None:
        if text[a:b].isascii():
            out.extend(text[a:b].encode())
            starts.extend(range(a, b))
            ends.extend(range(a + 1, b + 1))
        else:
            for i in range(a, b):
                put(text[i].encode("utf-8", "replace"), i, i + 1)

    for m in _BYTE_UNITS[kind].finditer(text):
        plain(at, m.start())
        at = m.end()
        if kind == "url":
            for i in range(m.start(), at, 3):
                put(bytes.fromhex(text[i + 1 : i + 3]), i, i + 3)
        elif len(m[0]) == 2:
            put(bytes([_SHORT[m[0][1]]]), m.start(), at)
        else:
            c = _escape(m[0])
            put(c.encode("latin-1") if c < "\u0100" else c.encode(), m.start(), at)
    plain(at, len(text))
    return bytes(out), starts, ends


def _layers(text: str) -> Iterator[tuple[str, str, list[int] | _Same, list[int] | _Same]]:
    """(name, text, starts, ends) of what the segments of a layer decode to; spans are positions in the layer."""
    for name, unit, decode in (("url", _PERCENT_UNIT, _percent), ("esc", _ESCAPE_UNIT, _escape)):
        if unit.search(text) is None:
            continue
        for m in _RUN.finditer(text):
            if unit.search(m[0]) is None:
                continue
            chars, starts, ends = [], [], []
            for part, a, b in _units(unit, m[0], decode):
                chars.append(part)
                starts += [m.start() + a] * len(part)
                ends += [m.start() + b] * len(part)
            yield name, "".join(chars), starts, ends
        data, starts, ends = _unescaped(name, text)
        for names, inner, a, b in _streams(data):
            yield "bomb" if names == "bomb" else f"{name}/{names}", inner, _Same(starts[a]), _Same(ends[b - 1])
    for m in _BASE64.finditer(text):
        lines = [(m.start() + x.start(), m.start() + x.end()) for x in _BASE64_LINE.finditer(m[0])]
        run = _digits(m[0].encode())
        if len(run) < LEAST_BASE64:
            continue
        # The line of each digit, where there are several: a span covers the whole lines that it touches.
        of = None if len(lines) == 1 else [i for i, (a, b) in enumerate(lines) for _ in text[a:b].rstrip("=")]

        def place(first: int, last: int, at: int) -> tuple[int, int]:
            """The span of the bytes from ``first`` to ``last`` of what is decoded from digit ``at`` on."""
            if of is None:
                return lines[0]
            return lines[of[at + first * 4 // 3]][0], lines[of[min(at + last * 4 // 3 + 1, len(of) - 1)]][1]

        for at, data in _from_base64(run):
            for names, inner, a, b in _streams(data):
                span = place(a, b - 1, at)
                yield "bomb" if names == "bomb" else f"b64/{names}", inner, _Same(span[0]), _Same(span[1])
            inner = _text(data)
            if of is None:
                yield "b64", inner, [lines[0][0]] * len(inner), [lines[0][1]] * len(inner)
                continue
            sizes = [1] * len(inner) if len(inner) == len(data) else [len(c.encode()) for c in inner]
            spans, i = [], 0
            for size in sizes:
                spans.append(place(i, i + size - 1, at))
                i += size
            yield "b64", inner, [x for x, _ in spans], [x for _, x in spans]


def _digest(text: str) -> bytes:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).digest()


class _Reach:
    """Spans of a text; how far those reach that begin up to a place, by a tree of maxima."""

    def __init__(self, size: int) -> None:
        self.size, self.most = size + 1, {}

    def add(self, a: int, b: int) -> None:
        a += 1
        while a <= self.size:
            self.most[a] = max(self.most.get(a, 0), b)
            a += a & -a

    def covers(self, a: int, b: int) -> bool:
        """Whether one of the spans holds all from ``a`` to ``b``."""
        a += 1
        while a > 0:
            if self.most.get(a, -1) >= b:
                return True
            a -= a & -a
        return False


def all_spans(text: str) -> tuple[Spans, Spans]:
    """(base spans, base and added spans) of a text, each by start and then kind.

    An added span's kind is the names of its layers and the kind of the secret,
    as in "b64/url/assign".  What lies inside a span of the same kind that a
    shallower layer gave isn't added again.
    """
    base = base_spans(text)
    spans = list(base)
    found = {kind: _Reach(len(text)) for kind in KINDS}
    for k, a, b in base:
        found[k].add(a, b)
    work: deque = deque([("", text, None, None, (_digest(text),))])
    while work:
        names, layer, starts, ends, path = work.popleft()
        if names:
            for kind, a, b in base_spans(layer):
                a, b = starts[a], max(ends[a:b])
                if not found[kind].covers(a, b):
                    found[kind].add(a, b)
                    spans.append((f"{names}/{kind}", a, b))
        for name, inner, a, b in _layers(layer):
            if starts is not None:
                a = _Same(starts[a.place]) if isinstance(a, _Same) else [starts[i] for i in a]
                b = _Same(ends[b.place - 1]) if isinstance(b, _Same) else [ends[j - 1] for j in b]
            if name == "bomb":
                spans.append((f"{names}/bomb".strip("/"), a[0], b[0]))
            elif (own := _digest(inner)) not in path:
                work.append((f"{names}/{name}".strip("/"), inner, a, b, (*path, own)))

    def rank(s: tuple[str, int, int]) -> tuple:
        return s[1], KINDS.index(s[0]) if s[0] in KINDS else len(KINDS), s[0], s[2]

    return base, sorted(spans, key=rank)


def joined(spans: Spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _hidden(text: bytes) -> bool:
    """Whether a text holds a hex secret or a base64 run that decodes to anything with a mark."""
    for m in _BASE64_BYTES.finditer(text):
        run = _digits(m[0])
        if len(run) >= LEAST_BASE64 and (_HEX_BYTES.search(m[0]) or next(_from_base64(run), None)):
            return True
    return False


def suspects(column: pa.Array) -> np.ndarray:
    """Which texts of a column may hold secrets; no other text has any span."""
    raw, offsets = texts_of(column)
    out = np.zeros(len(offsets) - 1, bool)
    plain, low = raw.tobytes(), LOWER[raw].tobytes()

    def mark(at: list[int]) -> None:
        out[np.searchsorted(offsets, at, "right") - 1] = True

    for data, signs in ((low, _KEYWORDS), (plain, [b"AKIA", b"%", b"\\", b"&#"])):
        for sign in signs:
            at, places = data.find(sign), []
            while at >= 0:
                places.append(at)
                at = data.find(sign, at + 1)
            mark(places)
    for d in np.flatnonzero(~out).tolist():
        out[d] = _hidden(plain[offsets[d] : offsets[d + 1]])
    return out


def _scan_column(column: pa.Array) -> Iterator[tuple[Spans, Spans]]:
    nothing: tuple[Spans, Spans] = ([], [])
    for i, hot in enumerate(suspects(column)):
        yield all_spans(column[i].as_py() or "") if hot else nothing


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every document, in one pass without a shuffle."""

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                rows = list(_scan_column(part.column(1)))
                counts = [[sum(k == kind for k, _, _ in base) for base, _ in rows] for kind in KINDS]
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column(0)}
                    | {f"n_{kind}": pa.array(c, pa.int64()) for kind, c in zip(KINDS, counts, strict=True)}
                    | {"base_sha256": pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b, _ in rows], pa.string())}
                    | {"spans": pa.array([joined(s) for _, s in rows], pa.string())}
                )

    return pick(docs, "doc_id", "text").mapInArrow(scanned, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def without(text: str, spans: Spans, mark: str = "[SECRET]") -> str:
    """``text`` with each union of overlapping spans replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in sorted(spans, key=lambda s: s[1]):
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """All documents and columns, with every span of a secret replaced in ``text`` and
    ``n_chars``, if there is one, counted anew where that is so; a null text stays null."""
    at = place(docs.columns, "text")
    count_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def redacted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = pa.RecordBatch.from_arrays(batch.columns, names=[f"c{i}" for i in range(batch.num_columns)])
            for part in slices(flat, f"c{at}"):
                column = part.column(at)
                found = {i: s for i, (_, s) in enumerate(_scan_column(column)) if s}
                columns = list(part.columns)
                if found:
                    new = {i: without(column[i].as_py(), s) for i, s in found.items()}
                    columns[at] = pa.array([new.get(i, x) for i, x in enumerate(column.to_pylist())], column.type)
                    if count_at is not None:
                        counts = columns[count_at]
                        columns[count_at] = pa.array([len(new[i]) if i in new else n for i, n in enumerate(counts.to_pylist())], counts.type)
                yield pa.RecordBatch.from_arrays(columns, names=part.schema.names)

    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return flat.mapInArrow(releasing(redacted), flat.schema).toDF(*docs.columns)
