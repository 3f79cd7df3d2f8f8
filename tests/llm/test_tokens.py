"""Token shards and packing against plain encoding of whole texts."""

import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from archivelake.llm import packing, queries, tokenizing, tokenstore
from archivelake.llm.tokenizing import PieceEncoder

ODD = ["", None, " ", "\n\n", "a  b\t\n\nc", "it's  we'll\u00a0x", "e\u0301 ΣΑΣ Σ", "<|endoftext|> x", "a<|startoftext|>b hello <|endoftext|> world", "A <|ENDOFTEXT|> <| b", "日本語 ½ ²", "x" * 5000, " \n x \n\n y  ", "\x1c a\x85b", "😀😀 ok"]


def plain(name):
    t = Tokenizer.from_file(P.path(name))
    return lambda texts: [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


@pytest.mark.parametrize("name,keep_space", [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)])
def test_pieces_equal_whole_texts(name, keep_space, texts):
    some = [t or "" for t in ODD] + list(texts.values())
    got = PieceEncoder(P.path(name), keep_space).encode(some)
    for text, ids, want in zip(some, got, plain(name)(some), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text[:60])


def test_store_query(spark, sf_dir, texts):
    keys = sorted(texts)
    start, want = 0, set()
    for k, ids in zip(keys, plain("word_bpe_49k.json")([texts[k] for k in keys]), strict=True):
        raw = np.array([*ids, 2], "<u4").tobytes()
        want.add((k, start, len(ids) + 1, zlib.crc32(raw)))
        start += len(ids) + 1
    assert {tuple(r) for r in queries.op4_token_store(spark, sf_dir).collect()} == want


def test_store_of_ties_nulls_and_odd_texts(spark, make_docs, tmp_path):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, "null key"), (None, None), (3, "again"), (3, "again"), (-(2**63), "least"), (2**63 - 1, "most")]
    encode = plain("word_bpe_49k.json")
    tokenstore.write_store(make_docs(rows, extra=True), path := str(tmp_path / "s"), P.path("word_bpe_49k.json"), 2, shard_bytes=64)
    shards = tokenstore.read_store(spark, path)
    got = [tuple(r) for r in tokenstore.read_records(shards, zlib.crc32).collect()]
    want = sorted((k is not None, k or 0, zlib.crc32(np.array([*encode([t])[0], 2], "<u4").tobytes())) for k, t in rows)
    assert sorted((k is not None, k or 0, c) for k, _, _, c in got) == want
    at = 0
    for _, start, n, _ in sorted(got, key=lambda r: r[1]):
        assert start == at
        at += n
    found = tokenstore.lookup(shards, [3, -(2**63), 12345]).collect()
    assert sorted((r.doc_id, len(r.ids)) for r in found) == sorted((k, len(encode([t])[0]) + 1) for k, t in rows if k in (3, -(2**63)))


def test_empty_store(spark, make_docs, tmp_path):
    tokenstore.write_store(make_docs([]), path := str(tmp_path / "s"), P.path("word_bpe_49k.json"), 2)
    assert tokenstore.read_records(tokenstore.read_store(spark, path), zlib.crc32).count() == 0


def test_perfect_hash_is_minimal_and_rejects_others():
    keys = np.arange(0, 7001, 7)
    displacement, slot = tokenstore.perfect_hash(tokenstore._hashes(keys))
    assert sorted(slot) == list(range(len(keys))) and len(displacement) <= len(keys) // 4 + 1
    shard = tokenstore.Shard(tokenstore.build_shard(keys.tolist(), [b"\0\0\0\0"] * len(keys)))
    assert (shard.slots(np.arange(1, 7000, 7)) >= 0).sum() <= 1


def test_wide_and_narrow_ids():
    for most in (65_535, 65_536, 2**32 - 1):
        ids = [np.array([0, most], "<u4").tobytes(), b"", np.array([7], "<u4").tobytes()]
        data = tokenstore.build_shard([None, 1, 5], ids)
        shard = tokenstore.Shard(data)
        assert [*shard.nulls(), *shard.get(1), *shard.get(5)] == ids and shard.get(6) == []
        assert shard.ids.itemsize == (2 if most < 65_536 else 4)
    with pytest.raises(ValueError, match="shard"):
        tokenstore.Shard(b"x" * 100)


def check_packing(rows, encoded, end_id):
    """Every id lies in one piece; sequences are gapless and need little padding."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert by_doc.keys() == encoded.keys()
    for k, pieces in by_doc.items():
        ids, at = [*encoded[k], end_id], 0
        for p in sorted(pieces, key=lambda p: p.start):
            part = ids[p.start : p.start + p.length]
            assert p.start == at and p.length == len(part) > 0 and p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
            at += p.length
        assert at == len(ids)
    padding = total = 0
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
        total += at
        padding += 1024 - at if at & (at - 1) else 0
    return padding / max(1, total)


def test_packing_query(spark, sf_dir, texts):
    encoded = dict(zip(texts, plain("byte_bpe_50k.json")(list(texts.values())), strict=True))
    assert check_packing(queries.op8_packing(spark, sf_dir).collect(), encoded, 0) < 0.01


def test_packing_of_odd_texts(make_docs):
    encoded = dict(enumerate(plain("byte_bpe_50k.json")(ODD)))
    rows = packing.pack(make_docs(ODD, extra=True), P.path("byte_bpe_50k.json")).collect()
    assert check_packing(rows, encoded, 0) < 0.1
    rows = packing.pack(make_docs([(None, "a b"), (None, None), (1, "x"), (1, "x")]), P.path("byte_bpe_50k.json")).collect()
    assert sorted((r.doc_id or 0, r.doc_tokens, r.length) for r in rows if r.start == 0)[:2] == [(0, 1, 1), (0, 3, 3)] or {(r.doc_id or 0, r.doc_tokens) for r in rows} == {(0, 1), (0, 3), (1, 2)}
    assert sum(r.length for r in rows) == 8
    assert packing.pack(make_docs([]), P.path("byte_bpe_50k.json")).count() == 0


def test_second_round_and_what_put_has_placed(make_docs, monkeypatch):
    """Many small partitions: open windows meet in few packers, and little is cut anew."""
    random = np.random.default_rng(2)
    texts = [" a" * int(random.integers(1, 1400)) for _ in range(1200)]
    rows = packing.pack(make_docs(texts).repartition(16), P.path("byte_bpe_50k.json"), with_ids=False, packer_pieces=2000).collect()
    assert check_packing(rows, dict(enumerate(plain("byte_bpe_50k.json")(texts))), 0) < 0.01
    remainders = defaultdict(int)
    for r in rows:
        if r.start >= r.doc_tokens // 1024 * 1024:
            remainders[r.doc_id] += 1
    assert sum(n > 1 for n in remainders.values()) < 0.2 * len(remainders)


def test_key_with_the_fingerprint_of_another(monkeypatch):
    monkeypatch.setattr(tokenstore, "_prints", lambda hashes: np.zeros(len(hashes), np.uint32))
    shard = tokenstore.Shard(tokenstore.build_shard([10, 20, 30], [b"\1\0\0\0"] * 3))
    assert len(shard.get(20)) == 1 and shard.get(21) == shard.get(-5) == []


def test_level_is_the_least_sum_of_squares():
    random = np.random.default_rng(1)
    packer = packing.SumOfSquares(32)
    for _ in range(600):
        size = int(random.integers(1, 32))
        counts = packer.counts.copy()
        costs = []
        for level in [0, *np.flatnonzero(counts)]:
            if level + size <= 32:
                after = counts.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 32
                costs.append(((after**2).sum(), -level))
        got = packer.level(size)
        assert (min(costs)[0], -got) in costs
        packer.put((0, 0, size))


def test_a_word_is_encoded_once_whatever_its_case_and_marks(monkeypatch):
    encoder = PieceEncoder(P.path("word_bpe_49k.json"), False)
    seen, words, ids = [], encoder._words, encoder._ids
    monkeypatch.setattr(encoder, "_words", lambda part: seen.extend(part) or words(part))
    monkeypatch.setattr(encoder, "_ids", lambda part: seen.extend(part) or ids(part))
    texts = ["Qzxv qzxv, QZXV!", "qzxv*** Qzxv*** qzxv?! Éqzö ÉQZÖ."]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == plain("word_bpe_49k.json")(texts)
    assert seen.count("qzxv") == 1 and len(seen) == len(set(seen)) and all(w == w.lower() for w in seen)
    assert not {w for w in seen if len(w) > 4}


LETTERS = [*"abzAZsSdDmM", "ß", "é", "É", "Þ", "ÿ", "µ", "ª", "Ÿ", "İ", "ı", "ſ", "Σ", "ς", "Ł", "ǅ", "ﬁ", "e\u0301", "\u0301", "日", "K", "Å"]
MARKS = [*"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", "'s", "'RE", "\u0338", "¡", "»", "²", "½", "…", "7", "٣"]


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_pieces_of_any_letters_and_marks(block, monkeypatch):
    monkeypatch.setattr(tokenizing, "BLOCK_WORDS", block)
    random = np.random.default_rng(7)
    texts = ["".join(random.choice([*LETTERS, *MARKS, *" " * 14, *"\n" * 4], int(random.integers(0, 90)))) for _ in range(1500)]
    texts += ["".join(random.choice([*"abzAZéÉßÞÿ" * 3, *MARKS[:32], *" " * 25], int(random.integers(0, 90)))) for _ in range(1500)]
    got = [np.frombuffer(x, "<u4").tolist() for x in PieceEncoder(P.path("word_bpe_49k.json"), False).encode(texts)]
    for text, ids, want in zip(texts, got, plain("word_bpe_49k.json")(texts), strict=True):
        assert ids == want, repr(text)


def test_nothing_to_encode():
    encoder = PieceEncoder(P.path("word_bpe_49k.json"), False)
    assert encoder.encode([]) == [] and encoder.encode(["", " \n "]) == [b"", b""] and encoder.encode(["\u00a0", ""]) == [b"", b""]


def test_every_small_letter_without_normalizer_and_patterns():
    """Words of any small letters of Latin-1, alone and in a run with letters beyond it."""
    encoder = PieceEncoder(P.path("word_bpe_49k.json"), False)
    assert encoder.plain and not PieceEncoder(P.path("byte_bpe_50k.json"), True).plain
    letters = [c for c in map(chr, range(256)) if c.isalpha() and c == c.lower()]
    random = np.random.default_rng(3)
    words = letters + ["".join(random.choice(letters, int(random.integers(1, 12)))) for _ in range(3000)]
    for more in ([], ["ł", "Ÿz", "日本", "ς"]):
        got = PieceEncoder(P.path("word_bpe_49k.json"), False).encode([" ".join(words + more)])[0]
        assert np.frombuffer(got, "<u4").tolist() == plain("word_bpe_49k.json")([" ".join(words + more)])[0]


def test_a_word_behind_a_blank_is_encoded_once_whatever_its_marks(monkeypatch):
    """The byte-level vocabulary: a word is learnt once with a blank before it and once without, on any line."""
    encoder = PieceEncoder(P.path("byte_bpe_50k.json"), True)
    seen, kinds = [], {k: getattr(encoder, k) for k in ("_words", "_lines", "_ids") if hasattr(encoder, k)}
    for kind, f in kinds.items():
        monkeypatch.setattr(encoder, kind, lambda part, f=f: seen.extend(part) or f(part))
    texts = ["Qzxv qzxv, Qzxv!\nQzxv qzxv)", "Qzxv*** Qzxv*** qzxv?! qzxv7... Éqzö ÉQZÖ\n\nQzxv, Éqzö;"]
    assert [np.frombuffer(x, "<u4").tolist() for x in encoder.encode(texts)] == plain("byte_bpe_50k.json")(texts)
    words = [w for w in seen if "z" in w.lower()]
    assert sorted(words) == sorted([" qzxv", " Qzxv", "Qzxv", " qzxv7", " Éqzö", " ÉQZÖ"])


@pytest.mark.parametrize("block", [3, 1 << 20])
def test_kept_space_of_any_letters_and_marks(block, monkeypatch):
    monkeypatch.setattr(tokenizing, "BLOCK_WORDS", block)
    random = np.random.default_rng(11)
    sets = [[*LETTERS, *MARKS, *" " * 14, *"\n" * 4], [*"abzAZéÉßÞÿ×÷" * 3, *MARKS, *" " * 25, "\n"], [*"ab.é", " ", "\n"], [*"ab", *MARKS[:32], "\x01", "\x01b", "\x01n ", *" " * 9], [" ", "\n", "\n", "bn", "r", "\t"]]
    texts = ["".join(random.choice(some, int(random.integers(0, 60)))) for some in sets for _ in range(1200)]
    texts += ["    if x:\n        return  1\n\n\n", "   ", "\n", " \n\n a", "a \n \nb  ", " " * 700 + "x", "\n" * 700]
    got = [np.frombuffer(x, "<u4").tolist() for x in PieceEncoder(P.path("byte_bpe_50k.json"), True).encode(texts)]
    for text, ids, want in zip(texts, got, plain("byte_bpe_50k.json")(texts), strict=True):
        assert ids == want, repr(text)


def test_nothing_to_encode_with_space():
    encoder = PieceEncoder(P.path("byte_bpe_50k.json"), True)
    assert encoder.lined and encoder.encode([]) == [] and encoder.encode(["", ""]) == [b"", b""]
    for letters in ([c for c in map(chr, range(256)) if c.isalpha()], ["ł", "Ÿz", "日本", "ς", "\u0301", "ª"]):
        text = " ".join([*letters, *(a + b for a in letters for b in letters)])
        assert np.frombuffer(PieceEncoder(P.path("byte_bpe_50k.json"), True).encode([text])[0], "<u4").tolist() == plain("byte_bpe_50k.json")([text])[0]
