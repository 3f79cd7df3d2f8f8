"""Near-duplicate documents by bottom-k sketches.

A document's set is its distinct n-word shingles, with A-Z in lower case, or its
whole word sequence if it has fewer words; each is a 64-bit hash.  Documents are
linked if 100 * intersection >= percent * union.  The steps:

1. One pass sketches every document: the ``SKETCH`` smallest hashes of its set,
   under one hash function, and a 128-bit digest of the set.  Documents of equal
   sets are one class from here on, whatever their number.
2. Inverted lists of retained values: a class stays only if so many of its values
   are retained by other classes as a link needs (six standard deviations below
   what is expected at the threshold; exactly, where a sketch is the whole set).
3. Classes that stay meet in the lists of their ``HEADS`` smallest values; two
   linked classes share none of these with a chance of (1 - percent / 100) **
   HEADS, 6e-9 at 85.  A pair is looked at in the list of its smallest common value
   only; so lists of equal members count once, and a list whose members all have one
   smaller value in common as their smallest is left out.  A list is cut into blocks of
   about ``BLOCK``; inside a block, the estimate from the sketch of the union
   filters pairs, exact Jaccard on full sets confirms them, and pairs that are
   already connected are passed over.  Only confirmed links leave a block.
4. If a list has several blocks, components are formed, its members are sorted by
   their smallest value and component, and those pairs of blocks meet which are neither
   of one component nor of one smaller value.  So a large group costs rows for its
   blocks, never for its pairs.

Nulls: null or wordless texts have an empty set and are linked with nothing.  Null
doc_ids take part; a component's id is its smallest doc_id that isn't null, null if
there is none, and ``kept`` then holds.  Rows that repeat a doc_id are judged alike
if their texts are equal.  An empty table gives an empty result.  Other columns are
ignored by ``components`` and kept by ``dedup``, which decides by row: see there.
A very long text's set is held whole in memory, eight bytes a shingle; blocks are cut
so that they hold ``BLOCK_VALUES`` values, or two sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, pick, place, releasing, written
from .components import connected
from .textkernel import Words, mix, slices, window_hashes

SKETCH = 64
HEADS = 10
BLOCK = 512
#: Values of all sets that meet in a block, about: eight bytes each.
BLOCK_VALUES = 4 << 20
#: Rows of six numbers that may be broadcast: some 64 bytes each.
MOST_BROADCAST = 250_000


def shingle_sets(column: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted hashes of the shingle set of each text of a column."""
    words = Words(column, lower=True)
    hashes = words.hashes()
    at = words.windows(n)
    found, doc = window_hashes(hashes, at, n), words.doc[at]
    order = np.lexsort((found, doc))
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    found, doc = found[new], doc[new]
    cuts = np.searchsorted(doc, np.arange(len(words.first)))
    for i, size in enumerate(np.diff(words.first)):
        if 0 < size < n:
            yield window_hashes(hashes, words.first[i : i + 1], int(size))
        else:
            yield found[cuts[i] : cuts[i + 1]]


def _digest(values: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums of scrambled values: equal for equal sets."""
    with np.errstate(over="ignore"):
        return tuple(int(mix(values ^ np.uint64(salt)).sum(dtype=np.uint64).astype(np.int64)) for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, tag (hash of the text), n (set size), hi, lo (its digest) and sketch of every document."""

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column(1), n))
                digests = [_digest(s) for s in sets]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": part.column(0),
                    "tag": part.column(2),
                    "n": pa.array([len(s) for s in sets], pa.int64()),
                    "hi": pa.array([d[0] for d in digests], pa.int64()),
                    "lo": pa.array([d[1] for d in digests], pa.int64()),
                    "sketch": pa.array([s[:SKETCH].view(np.int64) for s in sets], pa.list_(pa.int64())),
                })

    texts = pick(docs, "doc_id", "text")
    return texts.withColumn("tag", F.xxhash64("text")).mapInArrow(releasing(signed), "doc_id long, tag long, n long, hi long, lo long, sketch array<long>")


def least_shared(n: Column, percent: int) -> Column:
    """How many of a class's retained values a linked class retains too, at least."""
    p = percent / 100
    expected = int(np.ceil(SKETCH * p - 6 * (SKETCH * p * (1 - p)) ** 0.5))
    # Of a small set, all are retained; of its partner, what lies beyond the sketch isn't.
    beyond = F.greatest(F.floor(n * 100 / percent) - SKETCH, F.lit(0))
    return F.when(n >= SKETCH, expected).otherwise(F.greatest(F.least(F.ceil(n * percent / 100) - beyond, F.lit(SKETCH)), F.lit(1)))


def _survivors(classes: DataFrame, percent: int, count: int | None) -> DataFrame:
    """The classes whose retained values are shared often enough, after two rounds."""
    spark, before = classes.sparkSession, None
    postings = classes.select("cid", "n", F.explode("sketch").alias("v"))
    for _ in range(2):
        shared = postings.groupBy("v").agg(F.count("*").alias("c")).where("c > 1").select("v")
        postings = postings.join(shared, "v", "left_semi")
        alive = postings.groupBy("cid").agg(F.count("*").alias("c"), F.first("n").alias("n")).where(F.col("c") >= least_shared(F.col("n"), percent))
        postings = written(postings.join(alive.select("cid"), "cid", "left_semi"), "postings", count)
        if before is not None:
            discard(spark, before)
        before = postings
    alive = written(classes.join(postings.select("cid").distinct(), "cid", "left_semi"), "survivors", count)
    discard(spark, postings)
    return alive


def _sets(docs: DataFrame, classes: DataFrame, n: int) -> DataFrame:
    """cid and values (the full set as bytes) of ``classes(cid, rep, hi, lo)``, from one document of each."""
    texts = pick(docs, "doc_id", "text")
    wanted = classes.select("cid", "rep", "hi", "lo")
    wanted = F.broadcast(wanted) if wanted.count() <= MOST_BROADCAST else wanted
    # By doc_id and hash of the text: null doc_ids don't meet each other for that alone.
    same = F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.xxhash64("text") == F.col("rep.tag"))
    # Rows that repeat both are combined where they lie, before any set is made.
    found = texts.join(wanted, same).groupBy("cid", "hi", "lo").agg(F.first("text").alias("text"))

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                sets = list(shingle_sets(part.column(3), n))
                own = [i for i, s in enumerate(sets) if _digest(s) == (part.column(1)[i].as_py(), part.column(2)[i].as_py())]
                yield pa.RecordBatch.from_pydict({"cid": part.column(0).take(pa.array(own, pa.int64())), "values": pa.array([sets[i].tobytes() for i in own], pa.binary())})

    return found.mapInArrow(releasing(full), "cid long, values binary")


class _Block:
    """The classes that meet in a block of the list of value ``head``."""

    def __init__(self, rows: pd.DataFrame, percent: int, head: int) -> None:
        self.percent, self.head = percent, np.uint64(head % (1 << 64))
        self.ids = rows["cid"].to_numpy()
        self.sets = [np.frombuffer(x, np.uint64) for x in rows["values"]]
        self.sizes = np.array([len(s) for s in self.sets])
        last = np.uint64((1 << 64) - 1)
        self.sketches = np.full((len(rows), SKETCH), last)
        self.valid = np.zeros((len(rows), SKETCH), bool)
        for i, s in enumerate(self.sets):
            self.sketches[i, : len(s[:SKETCH])] = s[:SKETCH]
            self.valid[i, : len(s[:SKETCH])] = True
        self.group = np.arange(len(rows)) if "comp" not in rows else np.unique(rows["comp"].to_numpy(), return_inverse=True)[1]

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of ``others`` are linked with ``i`` and not yet connected with it."""
        small, large = np.minimum(self.sizes[i], self.sizes[others]), np.maximum(self.sizes[i], self.sizes[others])
        others = others[(100 * small >= self.percent * large) & (self.group[others] != self.group[i])]
        if not len(others):
            return others
        own, many, valid = self.sets[i][:SKETCH], self.sketches[others], self.valid[others]
        place = np.searchsorted(own, many)
        both = valid & (own[np.minimum(place, len(own) - 1)] == many)
        # Only in the list of the smallest value that both have among their heads.
        earlier = (both & (place < HEADS))[:, :HEADS] & (many[:, :HEADS] < self.head)
        # The sketch of the union: a common value's rank there is its rank in either less those counted twice.
        rank = np.arange(SKETCH) + place - (np.cumsum(both, 1) - both)
        common = (both & (rank < SKETCH)).sum(1)
        union = np.minimum(SKETCH, len(own) + valid.sum(1) - both.sum(1))
        share = self.percent / 100
        least = union * share - 6 * np.sqrt(union * share * (1 - share))
        others = others[(common >= least) & ~earlier.any(1)]
        if not len(others):
            return others
        sizes = self.sizes[others]
        values = np.concatenate([self.sets[j] for j in others])
        mine = self.sets[i]
        place = np.minimum(np.searchsorted(mine, values), len(mine) - 1)
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        common = np.add.reduceat((mine[place] == values).astype(np.int64), starts)
        return others[100 * common >= self.percent * (len(mine) + sizes - common)]

    def links(self, one: np.ndarray, two: np.ndarray | None) -> pd.DataFrame:
        """Confirmed links within ``one``, or between ``one`` and ``two``, that connect what wasn't."""
        out = []
        for k, i in enumerate(one):
            for j in self.linked(i, one[k + 1 :] if two is None else two):
                if self.group[i] != self.group[j]:
                    out.append((self.ids[i], self.ids[j]))
                    self.group[self.group == self.group[j]] = self.group[i]
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _block_links(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links of ``rows(v, *keys, side, cid, values[, comp])`` grouped by v and keys."""

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["side", "cid"], ignore_index=True)
        block = _Block(pdf, percent, int(pdf["v"].iloc[0]))
        side = pdf["side"].to_numpy()
        one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        return block.links(one, two if len(two) else None)

    return rows.groupBy("v", *keys).applyInPandas(links, "a long, b long")


def links(docs: DataFrame, classes: DataFrame, n: int, percent: int, count: int | None = None) -> DataFrame:
    """Confirmed links (a, b) between cids of ``classes(cid, n, rep, hi, lo, sketch)`` that connect all that are connected.
    ``count``: of documents."""
    alive = _survivors(classes, percent, count)
    sets = written(_sets(docs, alive.select("cid", "rep", "hi", "lo"), n), "sets", count)
    heads = alive.select("cid", "n", F.get("sketch", F.lit(0)).alias("head"), F.explode(F.slice("sketch", 1, HEADS)).alias("v"))
    sign = F.xxhash64("cid")
    stats = heads.groupBy("v").agg(
        F.count("*").alias("c"), F.sum("n").alias("size"), F.bit_xor(sign).alias("x"), F.sum(F.col("cid").cast("decimal(38,0)")).alias("s"), F.min("head").alias("low"), F.max("head").alias("high")
    )
    stats = stats.where("c > 1 and not (low = high and low <> v)")
    # Of lists with equal members, that of the smallest value, in the order of the sketches.
    order = F.struct((F.col("v") < 0).alias("upper"), "v")
    kept = written(stats.groupBy("c", "size", "x", "s").agg(F.min(order).alias("o")).select(F.col("o.v").alias("v"), F.greatest(F.ceil(F.col("c") / BLOCK), F.when(F.col("c") > 2, F.ceil(F.col("size") / BLOCK_VALUES)).otherwise(1)).cast("int").alias("blocks")), "lists", count)
    members = written(heads.join(kept, "v"), "members", count)
    first = members.select("v", "cid", F.pmod(F.xxhash64("cid"), F.col("blocks")).alias("block"), F.lit(0).alias("side"))
    found = written(_block_links(first.join(sets, "cid"), ["block"], percent), "links", count)
    large = members.where("blocks > 1").select("v", "cid", "n", "head")
    spark = docs.sparkSession
    if large.isEmpty():
        discard(spark, alive, sets, kept, members)
        return found

    roots = connected(found, count)
    placed = large.join(roots, F.col("cid") == F.col("node"), "left").select("v", "cid", "n", "head", F.coalesce("root", "cid").alias("comp"))
    # Members of one smallest value and component keep together, in blocks of their own if they
    # fill one; the others are dealt by these.  Sizes are counted before the shuffle.
    fill = F.greatest(F.lit(1 / BLOCK), F.least(F.col("n") / BLOCK_VALUES, F.lit(1.0)))
    units = placed.groupBy("v", "head", "comp").agg(F.sum(fill).alias("fill"))
    small = units.where("fill < 0.5").groupBy("v").agg(F.ceil(F.sum("fill")).cast("long").alias("small"))
    units = units.join(small, "v", "left")
    own = F.xxhash64("head", "comp", F.pmod(F.xxhash64("cid"), F.ceil("fill").cast("long")))
    block = F.when(F.col("fill") < 0.5, F.pmod(F.xxhash64("head", "comp"), F.col("small"))).otherwise(own.bitwiseOR(F.lit(1 << 32)))
    placed = written(placed.join(units, ["v", "head", "comp"]).select("v", "cid", "head", "comp", block.alias("block")), "blocks", count)
    ends = placed.groupBy("v", "block").agg(F.min("comp").alias("c1"), F.max("comp").alias("c2"), F.min("head").alias("h1"), F.max("head").alias("h2"))
    other = ends.select("v", F.col("block").alias("j"), F.col("c1").alias("d1"), F.col("c2").alias("d2"), F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    one_component = F.expr("c1 = c2 and d1 = d2 and c1 = d1")
    one_head = F.expr("h1 = h2 and g1 = g2 and h1 = g1 and h1 <> v")
    pairs = ends.withColumnRenamed("block", "i").join(other, "v").where(F.expr("i <= j") & ~one_component & ~one_head).select("v", "i", "j")
    left = placed.withColumnRenamed("block", "i").join(pairs, ["v", "i"]).select("v", "i", "j", "cid", "comp", F.lit(0).alias("side"))
    right = placed.withColumnRenamed("block", "j").join(pairs.where("i < j"), ["v", "j"]).select("v", "i", "j", "cid", "comp", F.lit(1).alias("side"))
    rest = _block_links(left.union(right).join(sets, "cid"), ["i", "j"], percent)
    rest = written(rest, "links", count)
    discard(spark, alive, sets, kept, members, placed)
    return found.union(rest)


def _components(docs: DataFrame, n: int, percent: int) -> tuple[DataFrame, int]:
    """doc_id, tag, n, root (null for an empty set) and component of every document, and their number."""
    signed = written(signatures(docs, n), "signatures")
    count = signed.count()
    grouped = signed.where("n > 0").groupBy("hi", "lo").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")).alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
    classes = written(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes", count)
    roots = connected(links(docs, classes, n, percent, count), count)
    rooted = classes.join(roots, F.col("cid") == F.col("node"), "left").select("hi", "lo", "rep", F.coalesce("root", "cid").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep.doc_id").alias("component"))
    known = rooted.join(least, "root").select("hi", "lo", "root", "component")
    # An empty set has digest (0, 0) and no class.
    return signed.drop("sketch").join(known, ["hi", "lo"], "left").select("doc_id", "tag", "n", "root", "component"), count


def components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document."""
    joined, _ = _components(docs, n, percent)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component"))
    out = joined.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def dedup(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """The documents with all their columns, one row of each component: that of the smallest
    doc_id, null last, then of the smallest hash of its text; of rows that repeat both, that
    of the smallest hash of all its columns.  Rows with empty sets all stay."""
    judged, count = _components(docs, n, percent)
    rows = written(judged.where("root is not null").groupBy("root", "doc_id", "tag").agg(F.count("*").alias("copies")), "rows", count)
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tag")
    best = rows.groupBy("root").agg(F.min(order).alias("best"))
    judged = rows.join(best, "root").withColumn("one", order == F.col("best"))
    # Rows that go, and those of which one is put back.
    out = judged.where(~F.col("one") | (F.col("copies") > 1))
    out = written(out.select(F.col("doc_id").alias("gone"), F.col("tag").alias("gone_tag"), F.col("one").alias("back")), "gone", count)
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    doc, tag = F.col(f"c{place(names, 'doc_id')}"), F.xxhash64(f"c{place(names, 'text')}")
    same = doc.eqNullSafe(F.col("gone")) & (tag == F.col("gone_tag"))
    left = flat.join(out, same, "left_anti")
    back = out.where("back")
    if not back.isEmpty():
        # Copies are combined before the shuffle, so a document of very many is no burden.
        hashed = F.xxhash64(*[f.name for f in flat.schema.fields if "map<" not in f.dataType.simpleString()])
        copies = flat.join(back, same).select("gone", "gone_tag", hashed.alias("hash"), F.struct(*flat.columns).alias("row"))
        left = left.union(copies.groupBy("gone", "gone_tag").agg(F.min_by("row", "hash").alias("row")).select("row.*"))
    return left.toDF(*names)
