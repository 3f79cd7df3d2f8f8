"""The corpus pipeline, stage by stage, against plain Python."""

import itertools
import string

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from tokenizers import Tokenizer

import corpus_pipeline
from archivelake.llm import quality, secret_scan
from tests.llm import test_line_dedup, test_near_dup, test_tokens


def lines_left(rows):
    """rows by doc_id without lines that an earlier one holds up to one edit; emptied ones go."""
    seen, out = set(), {}
    for k, t in sorted(rows.items()):
        kept = []
        for x in (t or "").split("\n"):
            if x.split():
                known = x in seen or len(x) >= 20 and any(test_line_dedup.one_edit(x, y) for y in seen if len(y) >= 20)
                seen.add(x)
                if known:
                    continue
            kept.append(x)
        left = "\n".join(kept)
        if left == t or left.split():
            out[k] = left
    return out


def test_stages_and_run(spark, sf_dir, documents, texts):
    rows = {k: t for k, t in texts.items() if quality.verdicts(quality.measure(pa.array([t])))[1][0]}
    got = corpus_pipeline.STAGES[0][1](spark, documents, sf_dir)
    assert got.columns == documents.columns and {r.doc_id: r.text for r in got.collect()} == rows

    rows = lines_left(rows)
    got = corpus_pipeline.STAGES[1][1](spark, got, sf_dir)
    assert got.dtypes == documents.dtypes and {r.doc_id: r.text for r in got.collect()} == rows

    keep = {k for k, _, _, kept in test_near_dup.brute(rows, 5, 80) if kept}
    got = corpus_pipeline.STAGES[2][1](spark, got, sf_dir)
    assert got.columns == documents.columns and {r.doc_id for r in got.collect()} == keep

    rows = {k: secret_scan.without(rows[k], secret_scan.all_spans(rows[k])[1]) for k in keep}
    got = corpus_pipeline.STAGES[3][1](spark, got, sf_dir)
    assert got.dtypes == documents.dtypes and {r.doc_id: (r.text, r.n_chars) for r in got.collect()} == {k: (t, len(t)) for k, t in rows.items()}

    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encoded = {k: tokenizer.encode(t, add_special_tokens=False).ids for k, t in rows.items()}
    pieces = corpus_pipeline.run(spark, sf_dir).collect()
    assert test_tokens.check_packing(pieces, encoded, 0) < 0.01
    for p in pieces:
        assert np.frombuffer(p.ids, "<u4").tolist() == [*encoded[p.doc_id], 0][p.start : p.start + p.length]


def test_empty_table(spark, make_docs, sf_dir):
    docs = make_docs([])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        assert docs.count() == 0


def test_nulls_ties_and_clashing_columns(spark, make_docs, sf_dir):
    good = "\n".join(" ".join(f"w{i}x{j}" for j in range(12)) for i in range(6))
    rows = [(1, good), (1, good), (2, good + " more"), (None, "password=hunter2hunter2 " + good.replace("w", "v")), (None, None), (3, ""), (4, None), (5, " ".join(f"u{i}" for i in range(30000)))]
    docs = make_docs(rows)
    more = spark.createDataFrame([("x",) * 6], "`TEXT` string, `N_CHARS` string, gone string, c1 string, kept string, `Doc_Id` string")
    docs = docs.crossJoin(more)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        docs = out
    kept = docs.toDF(*[f"x{i}" for i in range(len(docs.columns))]).select("x0", "x1", "x4").collect()
    assert sorted((str(r.x0), r.x1[:8]) for r in kept) == [("1", "w0x0 w0x"), ("2", "w5x0 w5x"), ("5", "u0 u1 u2"), ("None", "[SECRET]")]
    assert all(r.x4 == len(r.x1) for r in kept if r.x0 is None)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() >= 4


def test_memory_is_given_back_when_a_task_ends(monkeypatch):
    from archivelake.llm import common

    seen = []
    monkeypatch.setattr(common, "release", lambda: seen.append("released"))
    for x in common.releasing(lambda batches: (seen.append(b) or b for b in batches))(iter([1, 2])):
        assert seen == list(range(1, x + 1))
    assert seen == [1, 2, "released"]


def test_a_worker_that_has_packed_remembers_few_pieces(spark, make_docs, sf_dir):
    """Workers stay, beside a full heap: 500,000 words that differ must not stay with them."""
    words = map("".join, itertools.product(string.ascii_lowercase, repeat=5))
    texts = [" ".join(itertools.islice(words, 1000)) for _ in range(500)]
    pieces = corpus_pipeline.pack_tokens(spark, make_docs(texts).coalesce(1), sf_dir).collect()

    def kept(batches):
        import time

        from archivelake.llm import tokenizing

        for _ in batches:
            time.sleep(0.1)
            yield pa.RecordBatch.from_pydict({"n": [len(e.known) for e in tokenizing._ENCODERS.values() if e.keep_space]}, schema=pa.schema([("n", pa.int64())]))

    most = max(r.n for r in spark.range(0, 40, 1, 40).mapInArrow(kept, "n long").collect())
    assert 0 < most < 450_000  # 250,000 and those of a run of a million characters
    tokenizer = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    encoded = {k: e.ids for k, e in enumerate(tokenizer.encode_batch(texts, add_special_tokens=False))}
    assert test_tokens.check_packing(pieces, encoded, 0) < 0.01
