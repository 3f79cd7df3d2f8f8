"""Byte-level BPE against the tiktoken library."""

import hashlib
import random
import struct

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken

from archivelake.llm import bpe, queries

PATH = P.path("byte_bpe_multi_50k.tiktoken")
ODD = ["", None, " ", "a  b\t\n\nc  ", "it's we'll I'd 'S", "é 日本語 ½ ² ١٢٣", "x" * 3000, "!" * 2500 + " a", " " * 600, "é" * 700 + " ok", "  \x85 \x1c\x1d x", "😀😀👍🏽 ok <|endoftext|>", "\0\x01 zß", "naïve\r\n\r\nfin "]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def want(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    return doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_query(spark, sf_dir, texts, library):
    got = {tuple(r) for r in queries.op1_byte_bpe(spark, sf_dir).collect()}
    assert got == {want(library, k, t) for k, t in texts.items()}


@pytest.mark.parametrize("sizes", [(), (1, 3)])
def test_odd_texts_nulls_and_ties(make_docs, library, sizes):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null key"), (3, "again"), (3, "again")]
    got = bpe.encode(make_docs(rows, extra=True), PATH, P.PATTERN, *sizes).collect()
    assert sorted((r.n_tokens, r.ids_sha256, r.decoded_sha256, str(r.doc_id)) for r in got) == sorted((n, a, b, str(k)) for k, n, a, b in (want(library, k, t) for k, t in rows))
    for r in got:
        if r.doc_id is not None and r.doc_id != 3:
            assert list(struct.unpack(f"<{r.n_tokens}I", r.ids)) == library.encode_ordinary(ODD[r.doc_id] or "")


def test_empty_table(make_docs):
    assert bpe.encode(make_docs([]), PATH, P.PATTERN).count() == 0


def test_heap_equals_the_library(library):
    ranks = bpe.load_ranks(PATH)
    for word in ["a" * 999, "ab" * 600, "thereinthething" * 50, "x", "ß" * 333, "abcab" * 41]:
        assert bpe.merge(word.encode(), ranks) == library.encode_ordinary(word)


def split(texts, pattern=P.PATTERN):
    raw, start, end, count = bpe._word_ranges(texts, pattern)
    words = iter([bytes(raw[a:b]).decode() for a, b in zip(start, end, strict=True)])
    return [[next(words) for _ in range(n)] for n in count.tolist()]


def test_words_are_the_matches_of_the_pattern():
    find, rng = regex.compile(P.PATTERN).findall, random.Random(4)
    letters = "  '''strvemld \n\t\xa0aé1٣!?#日 ½\x85\x1c"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(9))) for _ in range(20_000)]
    texts += [f"a{c}b{c}{c} {c}'s{c}" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and (ord(c) < 0x3100 or ord(c) % 53 == 0)]
    assert split(texts) == [find(t) for t in texts]
    assert split(["ab  c", "", "d"], r"\S+|\s+") == [["ab", "  ", "c"], [], ["d"]]


def test_words_of_one_hash_are_an_error_not_a_mistake():
    raw = np.frombuffer(b"onetwo", np.uint8)
    with pytest.raises(ValueError, match="one hash"):
        bpe.Words.distinct(np.array([7, 7], np.uint64), np.array([0, 3]), np.array([3, 6]), raw)
