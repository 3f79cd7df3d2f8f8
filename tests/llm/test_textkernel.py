"""Hashes of words, lines and windows against plain Python, with strings that collide modulo powers of two."""

import random

import numpy as np
import pyarrow as pa
import pytest

from archivelake.llm import quality, textkernel


def thue_morse(n):
    s = "a"
    while len(s) < n:
        s += s.translate(str.maketrans("ab", "ba"))
    return s


SWAP = str.maketrans("ab", "ba")
PAIRS = [(thue_morse(n), thue_morse(n).translate(SWAP)) for n in (1024, 2048)]


def test_products_and_windows():
    rng = np.random.default_rng(5)
    a, b = (rng.integers(0, textkernel.PRIME, 500).astype(np.uint64) for _ in range(2))
    assert textkernel._times(a, b).tolist() == [int(x) * int(y) % textkernel.PRIME for x, y in zip(a, b, strict=True)]
    h = rng.integers(0, 1 << 63, 4000).astype(np.uint64)
    h[3000:3040] = h[50:90]
    got = textkernel.window_hashes(h, np.arange(3966), 35)
    assert [i for i in range(50, 56) if got[i] == got[i + 2950]] == list(range(50, 56)) and len(np.unique(got)) == 3960


@pytest.mark.parametrize("a, b", PAIRS)
def test_colliding_words_lines_and_windows(a, b):
    for text in (f"{a}\n{b}", f"x y {a} z w x y {b} z w", f"{a} q\n{a} q\n{b} q", f"{a} {b} " * 6):
        got = quality.measure(pa.array([text]))
        assert {k: int(v[0]) for k, v in got.items()} == quality.plainly(text)
    words = textkernel.Words(pa.array([f"{a} {b} {a}"]))
    for salt in (0, 1):
        one, two, three = words.hashes(salt).tolist()
        assert one == three != two


def test_windows_of_colliding_words():
    """A window of 32 words in the order of ``thue_morse`` and its complement."""
    one = [("left", "right")[c == "b"] for c in thue_morse(32)]
    words = textkernel.Words(pa.array([" ".join(one), " ".join(("left", "right")[w == "left"] for w in one)]))
    for salt in (0, 1):
        a, b = textkernel.window_hashes(words.hashes(salt), words.first[:2], 32, salt)
        assert a != b


def test_texts_with_equal_hashes_of_different_bytes_are_measured_plainly(monkeypatch):
    rng = random.Random(3)
    texts = [None, "", " \n\n ", *["".join(rng.choice(["a ", "b ", "cc\n", "dd ", "* "]) for _ in range(rng.randrange(90))) for _ in range(60)]]
    monkeypatch.setattr(textkernel, "mix", lambda x: np.asarray(x) & np.uint64(3))
    got = quality.measure(pa.array(texts))
    assert [{k: int(v[i]) for k, v in got.items()} for i in range(len(texts))] == [quality.plainly(t or "") for t in texts]


def test_byte_comparison():
    raw = np.frombuffer(b"abcdefghij abcdefghij abcdefghiX ", np.uint8)
    start, end = np.array([0, 0, 0, 0]), np.array([10, 10, 8, 0])
    other, stop = np.array([11, 22, 22, 5]), np.array([21, 32, 30, 5])
    assert textkernel.same_ranges(raw, start, end, other, stop).tolist() == [True, False, True, True]
