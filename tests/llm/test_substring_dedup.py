"""Substring dedup against counting all windows."""

import hashlib
import random
import re
from collections import Counter

from archivelake.llm import queries, substring_dedup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((str(k), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in df.collect())


def test_query(spark, sf_dir, texts):
    assert result(queries.op2_substring_dedup(spark, sf_dir)) == brute(list(texts.items()), 35)


def test_passages_at_all_offsets_in_several_batches(spark, make_docs):
    rng = random.Random(2)
    passages = [[f"p{k}w{i}é" for i in range(n)] for k, n in enumerate((34, 35, 36, 60, 200))]
    rows = []
    for i in range(60):
        words = [f"u{i}x{j}" for j in range(rng.randrange(80))]
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(words) + 1)
            passage = rng.choice(passages)
            words[at:at] = passage[rng.randrange(3) : len(passage) - rng.randrange(3)]
        rows.append((i, rng.choice([" ", "\n", "\t \x0b"]).join(words)))
    rows += [(100, "same " * 200), (101, "a b " * 90), (102, None), (103, ""), (None, rows[0][1]), (7, rows[1][1]), (7, rows[1][1]), (104, "z z \x1c " * 50)]
    size = -(-len(rows) // 7)
    batches = [make_docs(rows[i : i + size], extra=True) for i in range(0, len(rows), size)]
    assert result(substring_dedup.dedup(batches)) == brute(rows, 35)
    assert result(substring_dedup.dedup(batches, 12)) == brute(rows, 12)


def test_runs_are_compacted(spark, make_docs):
    index = substring_dedup.FingerprintIndex(spark, fanout=2)
    text = " ".join(f"w{i}" for i in range(100))
    hits = [index.add(substring_dedup.fingerprints(make_docs([(i, text if i in (1, 4) else f"{i} " + text.replace("w", f"v{i}"))]))).count() for i in range(5)]
    assert hits[:4] == [0, 0, 0, 0] and hits[4] > 0
    assert [len(x) for x in index.levels] == [1, 0, 1]
    assert {len(r.fps) for r in index.flagged().collect()} == {hits[4]}
    index.drop()


def test_empty_table(make_docs):
    assert substring_dedup.dedup([make_docs([])]).count() == 0


def test_index_is_reopened_for_the_next_batch(spark, make_docs):
    passage = " ".join(f"p{i}" for i in range(50))
    old = [(i, f"{i} " + (passage if i == 1 else " ".join(f"o{i}x{j}" for j in range(60)))) for i in range(4)]
    new = [(10, "front " + passage + " end"), (11, " ".join(f"n{j}" for j in range(60)))]
    first = substring_dedup.FingerprintIndex(spark, fanout=2)
    assert result(substring_dedup.dedup([make_docs(old[:2]), make_docs(old[2:])], index=first)) == brute(old, 35)
    again = substring_dedup.FingerprintIndex(spark, fanout=2, name=first.name)
    assert again.levels == [x for x in first.levels] and again.hits == first.hits
    got = substring_dedup.dedup_next(make_docs(new), make_docs(old), again)
    assert result(got) == brute(old + new, 35)
    again.drop()
    assert spark.sql(f"SHOW TABLES LIKE '{first.name}_*'").count() == 0


def test_a_table_of_one_file_is_several_batches(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/documents.parquet")
    batches = substring_dedup.file_batches(table)
    assert len(batches) == 4 and [b.count() > 0 for b in batches] == [True] * 4
    assert sum(b.count() for b in batches) == table.count()
