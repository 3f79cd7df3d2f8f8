"""Near-duplicates against comparing all pairs of shingle sets."""

import random
import re

from archivelake.llm import common, near_dup, queries
from archivelake.llm.components import connected

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if 0 < len(words) < n:
        return {tuple(words)}
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)}


def brute(texts, n, percent):
    """texts: dict of doc_id to text."""
    sets = {k: shingles(t, n) for k, t in texts.items()}
    keys = sorted(sets)
    root = {k: k for k in keys}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    owners = {}
    for k in keys:
        for s in sets[k]:
            owners.setdefault(s, []).append(k)
    for k in keys:
        for o in {o for s in sets[k] for o in owners[s] if o < k}:
            both = len(sets[k] & sets[o])
            if 100 * both >= percent * len(sets[k] | sets[o]):
                a, b = sorted((find(k), find(o)))
                root[b] = a
    return {(k, len(sets[k]), find(k), find(k) == k) for k in keys}


def test_query(spark, sf_dir, texts):
    assert {tuple(r) for r in queries.op3_near_duplicates(spark, sf_dir).collect()} == brute(texts, 3, 85)


def family(rng, words, size, edits):
    out = []
    for _ in range(size):
        copy = list(words)
        for _ in range(rng.randrange(edits)):
            copy[rng.randrange(len(copy))] = f"w{rng.randrange(10**6)}"
        out.append(" ".join(copy))
    return out


def test_large_groups_chains_and_blocks(make_docs, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 16)
    rng = random.Random(3)
    rows = []
    for length, size, edits in ((150, 90, 9), (40, 40, 4), (12, 30, 2), (400, 30, 25)):
        rows += family(rng, [f"b{rng.randrange(10**6)}" for _ in range(length)], size, edits)
    shared = " ".join(f"s{i}" for i in range(60))
    rows += [shared + " " + " ".join(f"u{i}-{j}" for j in range(80)) for i in range(60)]
    rows += [shared] * 20 + ["one two", "ONE\ttwo", "one", "", None, " \n "]
    rng.shuffle(rows)
    texts = dict(enumerate(rows))
    docs = make_docs(rows, extra=True)
    for n, percent in ((3, 85), (5, 80)):
        assert {tuple(r) for r in near_dup.components(docs, n, percent).collect()} == brute(texts, n, percent)
    kept = near_dup.dedup(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, _, _, keep in brute(texts, 5, 80) if keep}


def test_null_and_repeated_ids(make_docs):
    text = " ".join(f"w{i}" for i in range(30))
    docs = make_docs([(None, text), (4, text), (4, text), (2, "x y z a b"), (None, "p q r s t"), (3, None)])
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_dup.components(docs, 3, 85).collect())
    assert got == [("2", "2", True), ("3", "3", True), ("4", "4", True), ("4", "4", True), ("None", "4", False), ("None", "None", True)]
    assert near_dup.components(make_docs([]), 3, 85).count() == 0 == near_dup.dedup(make_docs([])).count()


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(i, 7) for i in range(8, 30)] + [(7, 7)]
    got = {(r.node, r.root) for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 100) for i in range(101, 161)} | {(i, 7) for i in range(8, 30)}


def test_dedup_decides_by_row(make_docs):
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(None, a), (None, a), (None, a + " more"), (None, "p q r s t u"), (None, None), (None, None)]  # a group without ids
    rows += [(4, b), (None, b), (5, b), (5, "an unrelated text of an id that goes once")]  # linked with ids
    rows += [(7, c), (7, c + " more"), (7, "x y z"), (8, d), (8, d)]

    left = sorted((str(r.doc_id), (r.text or "")[:12]) for r in near_dup.dedup(make_docs(rows, extra=True)).collect())
    one = [("4", b[:12]), ("5", "an unrelated"), ("7", c[:12]), ("7", "x y z"), ("8", d[:12]), ("None", ""), ("None", ""), ("None", a[:12]), ("None", "p q r s t u")]
    assert left == sorted(one)


def test_very_many_null_ids_are_no_square(make_docs):
    rng = random.Random(8)
    rows = [(None, " ".join(f"w{rng.randrange(10**7)}" for _ in range(12))) for _ in range(2500)]
    rows += [(None, t + " more") for _, t in rows]
    got = near_dup.components(make_docs(rows), 3, 85).collect()
    assert len(got) == 5000 and all(r.component_id is None and r.kept for r in got)
    assert near_dup.dedup(make_docs(rows)).count() == 2500


def test_tables_on_the_way_go_when_they_are_read(spark):
    texts = [" ".join(f"w{(i * 7 + k) % 97}" for k in range(60)) + f" {i % 3}" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    before = len(common._LEFT)
    assert near_dup.components(docs).count() == 40
    left = [path.rsplit("/", 1)[1].split("-")[0] for _, path in common._LEFT[before:]]
    assert "classes" in left and not {"postings", "survivors", "sets", "lists", "members"} & set(left)


def test_small_tables_take_few_files(spark, monkeypatch):
    """Of 100 partitions of a few rows each, some share a task and a file: of a local folder, each costs processes."""
    rng = random.Random(9)
    texts = [" ".join(f"w{rng.randrange(10**7)}" for _ in range(40)) for _ in range(150)]
    texts = dict(enumerate(texts + [t + " more" for t in texts]))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").coalesce(1)
    files = {}
    first = len(common._LEFT)
    monkeypatch.setattr(near_dup, "discard", lambda *_: None)
    change = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in change}
    try:
        for k, v in change.items():
            spark.conf.set(k, v)
        got = {tuple(r) for r in near_dup.components(docs, 5, 80).select("doc_id", "n_shingles", "component_id", "kept").collect()}
        for _, path in common._LEFT[first:]:
            files.setdefault(path.rsplit("/", 1)[1].rsplit("-", 1)[0], []).append(len(spark.read.parquet(path).inputFiles()))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert got == brute(texts, 5, 80) and sum(r[3] for r in got) == 150
    assert {"classes", "postings", "survivors", "sets", "links", "edges"} <= set(files)
    assert max(map(max, files.values())) <= 24, files
