"""Line dedup against comparing all pairs of lines."""

import hashlib
import random
import re
import time

from archivelake.llm import line_dedup, queries


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    return a[p + (len(a) == len(b)) :] == b[p + 1 :]


def brute(rows, least):
    """rows: (doc_id, text) with distinct doc_ids."""
    lines = [(k, i, x) for k, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])) for i, x in enumerate((t or "").split("\n"))]
    gone, seen = set(), {}
    for k, i, x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            if x in seen or len(x) >= least and any(one_edit(x, y) for y in seen if len(y) >= least):
                gone.add((k, i))
            seen.setdefault(x, (k, i))
    out = {}
    for k, t in rows:
        kept = "\n".join(x for i, x in enumerate((t or "").split("\n")) if (k, i) not in gone)
        out[k] = (0 if t is None else t.count("\n") + 1, sum(g[0] == k for g in gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def judged(docs, least=20):
    return {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in line_dedup.judge(docs, least).collect()}


def edited(rng, line):
    i = rng.randrange(len(line) + 1)
    kind = rng.randrange(3)
    return line[:i] + (rng.choice("abé😀") if kind else "") + line[i + (kind < 2) :]


def test_lines_of_all_lengths_with_edits_everywhere(make_docs):
    rng = random.Random(5)
    texts = []
    for n in [1, 2, 3, 20, 63, 64, 65, 66, 127, 128, 129, 130, 200, 5000, 9000]:
        line = "".join(rng.choice("ab é😀") for _ in range(n))
        family = [line, *[edited(rng, line) for _ in range(6)]]
        family += [edited(rng, x) for x in family]
        family += [line + "a", "a" + line, line[1:], line[:-1], line[:63] + "é" + line[63:], line[:64] + line[65:]]
        rng.shuffle(family)
        texts += family
    rng.shuffle(texts)
    rows = [(i, "\n".join(texts[a : a + 5])) for i, a in enumerate(range(0, len(texts), 5))]
    rows += [(None, texts[3]), (900, None), (901, ""), (902, "\n\n")]
    assert judged(make_docs(rows, extra=True), 1) == brute(rows, 1)


def test_many_lines_that_differ_at_one_place(make_docs):
    rows = [(i, f"page {chr(65 + i)} of the very long book\nsame line in every document, again") for i in range(40)]
    assert judged(make_docs(rows)) == brute(rows, 20)


def test_query(spark, sf_dir, texts):
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in queries.op9_line_dedup(spark, sf_dir).collect()}
    assert got == brute(list(texts.items()), 20)


def test_dedup_keeps_columns_and_drops_what_is_left_empty(make_docs):
    long, other = "a line that is long enough", "another line that is long enough"
    docs = make_docs([(1, f"{long}\nshort"), (2, long + "!"), (3, f"{long}\n{other}"), (4, None), (5, ""), (5, ""), (2, long + "!")], extra=True)
    got = line_dedup.dedup(docs)
    assert got.columns == docs.columns and got.dtypes == docs.dtypes
    rows = sorted((r.doc_id, r.text or "", r.n_chars) for r in got.collect())
    assert rows == [(1, f"{long}\nshort", 0), (3, other, len(other)), (4, "", 0), (5, "", 0), (5, "", 0)]


def test_empty_table(make_docs):
    assert line_dedup.judge(make_docs([])).count() == 0 == line_dedup.dedup(make_docs([])).count()


def test_copies_of_short_lines(make_docs):
    long = "a line that is long enough"
    docs = make_docs([(1, f"Read more\n{long}\n\n ok"), (2, f"Read more\nRead mores\n{long}!\n\n\t\n ok"), (3, "Read more"), (None, "ok\n\t")])
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept) for r in line_dedup.judge(docs).collect()}
    assert got == {1: (4, 0, f"Read more\n{long}\n\n ok"), 2: (6, 3, "Read mores\n\n\t"), 3: (1, 1, ""), None: (2, 0, "ok\n\t")}
    assert {r.doc_id for r in line_dedup.dedup(docs).collect()} == {1, 2, None}


def test_document_of_very_many_like_lines(make_docs):
    """Time grows with the lines, not with their square."""
    text = "\n".join(f"entry number {i:05d} of the long list" for i in range(32_000))
    docs = make_docs([(1, text), (2, "entry number 00007 of the long list")])
    began = time.time()
    got = {r.doc_id: (r.n_lines, r.n_removed) for r in line_dedup.judge(docs).collect()}
    # Of ten lines that differ in the last digit, the first has no earlier one at one edit only if all its digits are 0.
    assert got == {1: (32_000, 31_999), 2: (1, 1)} and time.time() - began < 30
