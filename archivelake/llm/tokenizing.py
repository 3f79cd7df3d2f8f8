"""Encoding with the tokenizers library, with a bounded memory of pieces already encoded."""

from __future__ import annotations

import gc
import os
import re
import string
from itertools import takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces kept in memory by each Python worker, unless its operator says how many; beyond it the memory
#: starts anew.  A piece takes some 150 bytes.
MEMORY_PIECES = 1_400_000

#: Words whose ids are put together at once.
BLOCK_WORDS = 1 << 17

_MARKS = string.punctuation
_LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
_ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
_ODD_ASCII = [c for c in _ODD if c.isascii()]

# Where white space is kept, a text is written as words with a blank between any two: a word stands for
# a blank and itself, unless it begins with MARK and a letter, which says what it is.
MARK = "\x01"
_BARE, _LINE, _RUN = (MARK + c for c in "bnr")  # a word without a blank, a line end, a run of white space
_TO_RUN, _FROM_RUN = str.maketrans(" \n", "bn"), str.maketrans("bn", " \n")
_RUNS = re.compile(r"[ \n]{2,}(?=[ \n][^ \n])|[ \n]{2,}\Z").sub  # the white space of a piece of its own, of two or more
_ENDS = np.isin(np.arange(256), [*map(ord, string.ascii_letters + string.digits)])
_ENDS_2 = np.isin(np.arange(256), [b for b in range(0x80, 0xC0) if b not in b"\x97\xb7"])  # À to ÿ without × and ÷, after C3


class PieceEncoder:
    """Encodes texts piece by piece; equal to encoding each text at once.

    A piece is a word, with the blank before it, if any; other white space is a piece of its
    own, as is the punctuation behind a Latin letter.  A word of such letters is learnt in lower case where
    the vocabulary's normalizer lowers it.  Both vocabularies split a text at these
    places before merging, so that pieces don't influence each other, as long as a
    text has no white space but blanks and line ends and no literal of an added token,
    which the library takes for that token.  Any other text is encoded as a whole.  New words of letters are encoded many at a time, one after the other in
    one text: the first token of a word, or the last, is marked in the vocabulary.

    keep_space: whether white space is part of the tokens that follow it (a word's
    first token then begins with a blank; otherwise its last one has a word end).
    """

    def __init__(self, path: str, keep_space: bool) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts with the literal of an added token, or what may become one, are encoded as a whole.
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.sign = "".join(takewhile(lambda c: c.lower() == c.upper(), os.path.commonprefix(added))) if added else None
        self.keep_space = keep_space
        normalizer = self.tokenizer.normalizer
        self.lowers = normalizer is not None and normalizer.normalize_str("AZÀÖØÞ") == "azàöøþ"
        self.plain = self._plain() if self.lowers and not keep_space else None
        self.lined = self._lined() if keep_space else None
        self.most = MEMORY_PIECES
        self.known: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.marked = np.zeros(max(vocabulary.values()) + 1, bool)
        self.marked[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if keep_space else t.endswith("</w>"))]] = True

    def _plain(self):
        """A tokenizer with the same model for small letters of Latin-1 between blanks, which need neither
        normalizer nor patterns; None if this vocabulary doesn't split such words as it does."""
        from tokenizers import Tokenizer, pre_tokenizers

        plain = Tokenizer(self.tokenizer.model)
        plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        text = " ".join([string.ascii_lowercase, "zßàöøÿ", "ª", "µ", "º", "s", "t", "re", "ve", "m", "ll", "d", "straße"])
        alike = plain.pre_tokenizer.pre_tokenize_str(text) == self.tokenizer.pre_tokenizer.pre_tokenize_str(text)
        return plain if alike and plain.encode(text).ids == self.tokenizer.encode(text, add_special_tokens=False).ids else None

    def _lined(self):
        """A tokenizer with the same model for words of Latin-1's letters, each with a blank before it and on a line
        of its own, which need no patterns; None if this vocabulary doesn't split such words as it does."""
        from tokenizers import Tokenizer, pre_tokenizers

        lined = Tokenizer(self.tokenizer.model)
        lined.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.CharDelimiterSplit("\n"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        words = [f" {c}{d}{c}" for c in map(chr, range(256)) if c.isalpha() for d in "aßZ"]
        return lined if lined.encode("\n".join(words)).ids == self.tokenizer.encode("".join(words), add_special_tokens=False).ids else None

    def odd(self, text: str) -> bool:
        """Whether a text has white space but blanks and line ends, or may hold an added token or this module's mark."""
        return any(c in text for c in (_ODD_ASCII if text.isascii() else _ODD)) or self.sign is not None and self.sign in text or self.keep_space and MARK in text

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters, with a blank before each if white space is kept."""
        text = ("" if self.keep_space else " ").join(words)
        tokenizer = self.tokenizer
        if self.plain and text.islower() and (text.isascii() or max(text) <= "ÿ"):
            tokenizer = self.plain
        elif self.lined and (text.isascii() or max(text) <= "ÿ"):
            text, tokenizer = "\n".join(words), self.lined
        ids = np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(self.marked[ids])
        if len(at) != len(words):
            return self._ids(words)
        cuts = (4 * (np.append(at, len(ids)) if self.keep_space else np.concatenate([[0], at + 1]))).tolist()
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _lines(self, words: list[str]) -> list[bytes]:
        """The ids of words without white space but a blank before them."""
        line = self._ids(["\n"])[0]
        ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(words)], add_special_tokens=False)[0].ids, "<u4")
        at = np.flatnonzero(ids == np.frombuffer(line, "<u4")[0])
        if len(line) != 4 or len(at) != len(words) - 1:
            return self._ids(words)
        raw = ids.tobytes()
        return [raw[4 * a : 4 * b] for a, b in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)], strict=True)]

    def _learn(self, new: set[str]) -> None:
        gc.disable()  # nothing here makes cycles, and many short-lived objects would set off searches for them
        try:
            self._learn_all(new)
        finally:
            gc.enable()

    def _learn_all(self, new: set[str]) -> None:
        if self.keep_space:
            words, solid, space = [], [], []
            for key in new:
                if key.isalpha():
                    words.append((key, f" {key}"))
                    continue
                text = "\n" if key == _LINE else key[2:].translate(_FROM_RUN) if key.startswith(_RUN) else key[2:] if key.startswith(_BARE) else f" {key}"
                (solid if text.strip(" \n") else space).append((key, text))
            for kind, f in ((words, self._words), (solid, self._lines), (space, self._ids)):
                for at in range(0, len(kind), 512):
                    keys, texts = zip(*kind[at : at + 512], strict=True)
                    self.known.update(zip(keys, f(list(texts)), strict=True))
            return
        made = []
        found, rest = set(), set()
        for p in new:
            word = p if p.isalpha() else p.rstrip(_MARKS)
            if (word == p and (word.islower() or not self.lowers)) or not _LETTERS(word):
                (found if p.isalpha() else rest).add(p)
            else:
                base, end = word.lower() if self.lowers else word, p[len(word) :]
                found.add(base)
                rest.add(end)
                if p != base:
                    made.append((p, base, end))
        words, new = list(found.difference(self.known)), rest.difference(self.known)
        for at in range(0, len(words), 512):
            part = words[at : at + 512]
            self.known.update(zip(part, self._words(part), strict=True))
        rest = list(new.difference(words))
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            self.known.update(zip(part, self._ids(part), strict=True))
        for piece, word, end in made:
            self.known[piece] = self.known[word] + self.known[end]

    def _find(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, one after the other, and how many each has."""
        found = list(map(self.known.get, pieces))
        new = [i for i, x in enumerate(found) if x is None]
        if new:
            self._learn({pieces[i] for i in new})
            for i in new:
                found[i] = self.known[pieces[i]]
        return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4

    def _dealt(self, texts: list[str]) -> list[bytes]:
        """The ids of texts that aren't odd; a word that they share is looked up once for all of them."""
        if self.keep_space:
            words = pc.split_pattern(pa.array(map(_marked, texts), pa.large_string()), " ")
        else:
            words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        codes = words.values.dictionary_encode()
        at = codes.indices.to_numpy()
        if self.keep_space:
            parts = pa.concat_arrays(_trimmed(codes.dictionary)).dictionary_encode()
            ids, sizes = self._find(parts.dictionary.to_numpy(zero_copy_only=False).tolist())
            pairs = parts.indices.to_numpy().reshape(2, -1).T
            ids, sizes = _slices(ids, (np.cumsum(sizes) - sizes)[pairs.ravel()], sizes[pairs.ravel()]), sizes[pairs].sum(1)
        else:
            ids, sizes = self._find(codes.dictionary.to_numpy(zero_copy_only=False).tolist())
        first = np.cumsum(sizes) - sizes
        raw = []
        for a in range(0, len(at), BLOCK_WORDS):
            part = at[a : a + BLOCK_WORDS]
            raw.append(_slices(ids, first[part], sizes[part]).tobytes())
        joined = b"".join(raw)
        cuts = (4 * np.concatenate([[0], np.cumsum(sizes[at])])[words.offsets.to_numpy()]).tolist()
        return [joined[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > self.most:
            self.known = {}
        odd = [self.odd(t) for t in texts]
        whole, split = ([t for t, o in zip(texts, odd, strict=True) if o is kind] for kind in (True, False))
        sides = {True: iter(self._ids(whole)), False: iter(self._dealt(split))}
        return [next(sides[o]) for o in odd]


def _slices(values: np.ndarray, first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Slices of values, one after the other."""
    ends = np.cumsum(sizes)
    return values[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def _marked(text: str) -> str:
    """A text as words with a blank between any two; see MARK."""
    if text.endswith((" ", "\n")) or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
        text = _RUNS(lambda run: f" {_RUN}{run[0].translate(_TO_RUN)}", text)
    return _BARE + text.replace("\n", f" {_LINE} {_BARE}")


def _trimmed(words: pa.LargeStringArray) -> tuple[pa.LargeStringArray, pa.LargeStringArray]:
    """Words without the ASCII punctuation behind a Latin letter or digit, and that punctuation, as words without a blank."""
    bare = pc.ascii_rtrim(words, characters=_MARKS)
    offsets, data = np.frombuffer(words.buffers()[1], np.int64)[words.offset :][: len(words) + 1], np.frombuffer(words.buffers()[2] or b"", np.uint8)
    kept, sizes = pc.binary_length(bare).to_numpy().astype(np.int64), np.diff(offsets)
    cut = np.flatnonzero((kept > 0) & (kept < sizes))
    ends = offsets[cut] + kept[cut]
    cut = cut[_ENDS[data[ends - 1]] | (_ENDS_2[data[ends - 1]] & (data[np.maximum(ends - 2, 0)] == 0xC3))]
    marks = np.zeros(len(words), np.int64)
    marks[cut] = sizes[cut] - kept[cut]
    tails = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(np.concatenate([[0], np.cumsum(marks)])), pa.py_buffer(_slices(data, offsets[1:] - marks, marks)))
    return pc.if_else(pa.array(marks > 0), bare, words), pc.binary_join_element_wise(pa.scalar(_BARE, pa.large_string()), tails, pa.scalar("", pa.large_string()))


_ENCODERS: dict[tuple[str, bool], PieceEncoder] = {}


def encoder(path: str, keep_space: bool, most: int = MEMORY_PIECES) -> PieceEncoder:
    """This worker's encoder for a vocabulary file, which from now on keeps ``most`` pieces and those of
    one call; workers are reused from task to task."""
    if (path, keep_space) not in _ENCODERS:
        _ENCODERS[path, keep_space] = PieceEncoder(path, keep_space)
    _ENCODERS[path, keep_space].most = most
    return _ENCODERS[path, keep_space]


def runs(texts: list[str | None], most: int = 1 << 20):
    """Index ranges of about ``most`` characters each, one text at least."""
    begin = size = 0
    for i, t in enumerate(texts):
        if i > begin and size + len(t or "") > most:
            yield begin, i
            begin, size = i, 0
        size += len(t or "")
    if begin < len(texts):
        yield begin, len(texts)
