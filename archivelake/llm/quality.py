"""Repetition rules: how much of a text lies in repeated n-grams and lines.

Words are runs without ASCII white space; rolling hashes of all windows of
several lengths are computed in numpy for a run of texts at once, windows whose
hash occurs twice or more in their text are marked, and the characters of the
words they cover are summed.  Lines are hashed as a whole.  Windows and lines of one
hash are compared byte by byte; a text in which two differ is measured plainly.

A text fails if

* it has fewer than ``least_words`` words, or more than ``repeat_percent`` % of
  its words lie in repeated 5-word windows (the base rule), or
* for an n-gram length n of ``GRAM_PERCENT``, more than that share of its word
  characters lies in words covered by n-grams found twice or more, or
* more than ``LINE_PERCENT`` % of its word characters lie in lines equal to an
  earlier line, or
* it has more than ``SYMBOL_PERCENT`` symbols for each hundred word characters.

Nulls: a null text has no words and fails; a null doc_id is kept.  An empty text
fails.  Repeated rows are judged each by itself.  A very long text is measured whole,
in some fifty times its size of memory.  An empty table gives an empty
result.  Other columns are ignored by ``score`` and kept by ``keep``.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, place, releasing
from .textkernel import Rolling, Words, covered, ranges, same_ranges, same_words, slices, twins

LEAST_WORDS = 10
REPEAT_PERCENT = 20
REPEAT_WINDOW = 5
#: Highest allowed percentage of word characters in repeated n-grams, by n.
GRAM_PERCENT = {6: 25, 8: 22, 10: 20}
LINE_PERCENT = 35
SYMBOL_PERCENT = 5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MEASURES = [*COLUMNS, *[f"gram{n}_chars" for n in GRAM_PERCENT], "dup_line_chars"]


def _per_text(words: Words, values: np.ndarray) -> np.ndarray:
    """Sums of a value per word, by text."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[words.first[1:]] - total[words.first[:-1]]


def _lines(words: Words) -> tuple[np.ndarray, ...]:
    """(begin, end, first word, end word) of the lines with a word."""
    feeds = np.flatnonzero(words.raw == 10)
    begin = np.sort(np.concatenate([words.offsets[:-1], feeds + 1]), kind="stable")
    stop = np.sort(np.concatenate([words.offsets[1:], feeds]), kind="stable")
    full = begin < stop
    begin, stop = begin[full], stop[full]
    a, b = np.searchsorted(words.start, begin), np.searchsorted(words.start, stop)
    real = a < b
    return begin[real], stop[real], a[real], b[real]


def measure(texts: pa.Array) -> dict[str, np.ndarray]:
    """MEASURES of each text of a string column."""
    words = Words(texts)
    n = len(words.first) - 1
    chars = words.chars()
    rolling = Rolling(words.hashes())
    wrong = np.zeros(n, bool)  # texts in which equal hashes stand for different bytes
    out = {"n_words": np.diff(words.first), "word_chars": _per_text(words, chars)}
    marks = np.concatenate([[0], np.cumsum(_SYMBOL[words.raw])])
    out["n_symbols"] = marks[words.offsets[1:]] - marks[words.offsets[:-1]]

    begin, stop, a, b = _lines(words)
    doc = words.doc[a]
    one, two = twins(doc, ranges(words.raw, begin, stop))
    wrong[doc[one[~same_ranges(words.raw, begin[one], stop[one], begin[two], stop[two])]]] = True
    out["n_dup_lines"] = np.bincount(doc[two], minlength=n).astype(np.int64)
    heads = np.concatenate([[0], np.cumsum(chars)])
    line_chars = np.bincount(doc[two], (heads[b] - heads[a])[two], minlength=n).astype(np.int64)

    def inside(size: int) -> np.ndarray:
        at = words.windows(size)
        one, two = twins(words.doc[at], rolling.windows(at, size))
        wrong[words.doc[at[one[~same_words(words, at[one], at[two], size)]]]] = True
        return covered(len(words), at[np.union1d(one, two)], size)

    out["n_repeat_words"] = _per_text(words, inside(REPEAT_WINDOW))
    for size in GRAM_PERCENT:
        out[f"gram{size}_chars"] = _per_text(words, np.where(inside(size), chars, 0))
    out["dup_line_chars"] = line_chars
    for i in np.flatnonzero(wrong).tolist():
        for name, value in plainly(texts[i].as_py()).items():
            out[name][i] = value
    return out


def plainly(text: str) -> dict[str, int]:
    """MEASURES of one text without hashes of ours, for texts in which hashes collide."""
    words = [w for line in text.split("\n") for w in line.encode().split()]
    sizes = [len(w.decode()) for w in words]

    def inside(size: int) -> list[bool]:
        grams = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
        count = Counter(grams)
        hit = np.zeros(len(words), bool)
        for i, g in enumerate(grams):
            if count[g] > 1:
                hit[i : i + size] = True
        return hit.tolist()

    seen: set[str] = set()
    dups = dup_chars = 0
    for line in text.split("\n"):
        own = line.encode().split()
        if own and line in seen:
            dups += 1
            dup_chars += sum(len(w.decode()) for w in own)
        seen.add(line)
    out = {"n_words": len(words), "word_chars": sum(sizes), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": dups, "n_repeat_words": sum(inside(REPEAT_WINDOW))}
    out |= {f"gram{size}_chars": sum(n for n, hit in zip(sizes, inside(size), strict=True) if hit) for size in GRAM_PERCENT}
    return out | {"dup_line_chars": dup_chars}


def verdicts(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(base_failed, kept) of measured texts."""
    failed = (m["n_words"] < LEAST_WORDS) | (100 * m["n_repeat_words"] > REPEAT_PERCENT * m["n_words"])
    bad = 100 * m["dup_line_chars"] > LINE_PERCENT * m["word_chars"]
    bad |= 100 * m["n_symbols"] > SYMBOL_PERCENT * m["word_chars"]
    for size, percent in GRAM_PERCENT.items():
        bad |= 100 * m[f"gram{size}_chars"] > percent * m["word_chars"]
    return failed, ~(failed | bad)


def score(docs: DataFrame) -> DataFrame:
    """doc_id, MEASURES, base_failed and kept of every document, in one pass without a shuffle."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                m = measure(part.column(1))
                failed, kept = verdicts(m)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": part.column(0)} | {k: pa.array(m[k], pa.int64()) for k in MEASURES} | {"base_failed": pa.array(failed), "kept": pa.array(kept)}
                )

    kinds = ", ".join(f"{k} long" for k in MEASURES)
    return pick(docs, "doc_id", "text").mapInArrow(scored, f"doc_id long, {kinds}, base_failed boolean, kept boolean")


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns, in one pass without a shuffle."""
    at = place(docs.columns, "text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"c{i}" for i in range(batch.num_columns)]
            flat = pa.RecordBatch.from_arrays(batch.columns, names=names)
            for part in slices(flat, f"c{at}"):
                ok = pa.array(verdicts(measure(part.column(at)))[1])
                yield part.filter(ok)

    flat = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    return flat.mapInArrow(releasing(kept), flat.schema).toDF(*docs.columns)
