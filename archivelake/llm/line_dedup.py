"""Line dedup by a deletion-neighbourhood join, in DataFrame functions only.

A line (between "\\n"s) that holds more than white space is removed if one that comes
earlier, in order of doc_id, a hash of the text, and position, equals it, or, where
both have ``edit_chars`` code points or more, differs from it by one edit: a code point
put in, taken out or replaced.  (Of a shorter line, one edit leaves too little: "1." is
no copy of "2.".)  Lines are judged on the input, not on what is left.

Equal lines meet by digest.  For lines one edit apart, let m be the longer
length.  Cut at multiples of a width w(m), the edit lies in one block; all before
the block, counted from the front, and all after it, counted from the back, is
equal.  So a line emits, for each block, hashed keys of (m, block, what is before,
what is after, variant of the block): the variants with one code point deleted,
taking itself for the longer one, and the block whole, taking itself for the
shorter.  A line of at most 64 code points is one block and emits its plain
deletion neighbourhood; blocks keep the work on a long line from being the square
of its length.  Lines with equal variants deleted at the same place are all one
replacement apart, so each is compared with the earliest of them only; a whole
block is compared with the longer lines that meet it.  Pairs are therefore no more
than keys.  Edit distance is then verified on the lines.

Before that, a line of ``edit_chars`` or more must share one of four keys with another line: its first or
its last floor((m - 1) / 2) code points, with m its length or one more.  Two lines
one edit apart always do, so this loses nothing, and few other lines do.

Nulls: a null text has no lines and stays null; null doc_ids come first.  An empty
text has one line, which is kept.  Rows that repeat doc_id and text are treated
alike.  A text is split into lines once for each step that reads it, however long it is.  An empty table gives an empty result.  Other columns are ignored by
``judge`` and kept by ``dedup``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, place, written

EDIT_CHARS = 20
LEAST_WIDTH = 64
#: Bytes of a hash table that may be broadcast, as estimated from its rows.
MOST_BROADCAST = 32 << 20
_NOT_BLANK = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, not for each element that a lambda sees."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _occurrences(texts: DataFrame) -> DataFrame:
    """Every line to be judged of ``texts(doc, tag, text)``: doc, tag, pos, line, id (its digest)."""
    lines = texts.select("doc", "tag", F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    return lines.where(F.col("line").rlike(_NOT_BLANK)).withColumn("id", F.unhex(F.md5("line")))


def _meeting_keys(line: Column) -> Column:
    """The four keys of which lines one edit apart share one."""
    n = F.length(line)
    keys = []
    for more in (0, 1):
        m = n + more
        half = F.floor((m - 1) / 2).cast("int")
        keys += [F.xxhash64(F.lit(0), m, F.substring(line, F.lit(1), half)), F.xxhash64(F.lit(1), m, F.right(line, half))]
    return F.array(*keys)


def _width(m: Column) -> Column:
    return F.greatest(F.lit(LEAST_WIDTH), F.pow(F.lit(2.0), F.ceil(F.log2(m) / 2)).cast("int"))


def variants(lines: DataFrame) -> DataFrame:
    """The hashed keys of ``lines(id, first, line)``: id, first, key and place, which
    is 0 for a whole block and else the deleted code point's place in the block."""
    n = F.length("line")
    blocks = lines.select("id", "first", "line", F.explode(F.array(n, n + 1)).alias("m"))
    blocks = blocks.withColumn("w", _width(F.col("m")))
    blocks = blocks.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("m") - 1) / F.col("w")).cast("int"))).alias("b"))
    before, after = F.col("b") * F.col("w"), F.greatest(F.col("m") - (F.col("b") + 1) * F.col("w"), F.lit(0))
    size = n - before - after
    blocks = blocks.select(
        "id",
        "first",
        (F.col("m") == n).alias("longer"),
        F.xxhash64("m", "b", F.substring("line", F.lit(1), before), F.right("line", after)).alias("around"),
        F.substring("line", before + 1, size).alias("block"),
        size.alias("size"),
    ).where((F.col("size") > 0) | ~F.col("longer"))
    places = blocks.select("*", F.explode(F.when(F.col("longer"), F.sequence(F.lit(1), F.greatest("size", F.lit(1)))).otherwise(F.array(F.lit(0)))).alias("place"))
    kept = F.when(F.col("place") == 0, F.col("block")).otherwise(F.concat(F.substring("block", F.lit(1), F.col("place") - 1), F.substring("block", F.col("place") + 1, F.col("size"))))
    return places.select("id", "first", "place", F.xxhash64("around", kept).alias("key"))


def near_pairs(lines: DataFrame) -> DataFrame:
    """(id, earlier) of ``lines(id, first, line)``, distinct lines with the place where
    each first occurs: for every line that has an earlier one at one edit, at least
    one such pair, verified."""
    # One exchange by key serves both windows.  Distinct lines with the same variant differ in
    # what was deleted, so a group holds no more lines than code points times places of a block.
    keyed = variants(lines).withColumn("at", F.struct("first", "id"))
    whole = F.max(F.when(F.col("place") == 0, F.col("at"))).over(Window.partitionBy("key"))
    least = F.min("at").over(Window.partitionBy("key", "place"))
    met = keyed.select("id", "place", "at", whole.alias("whole"), least.alias("least")).where("place > 0")
    # greatest and least pass over a whole block that isn't there.
    replaced = F.struct("id", F.col("least.id").alias("earlier"))
    put_in = F.struct(F.greatest("at", "whole")["id"].alias("id"), F.least("at", "whole")["id"].alias("earlier"))
    pairs = met.where("least.id <> id or whole is not null").select(F.explode(F.array(replaced, put_in)).alias("p"))
    pairs = pairs.select("p.id", "p.earlier").where("id <> earlier").distinct()
    texts = lines.select("id", "line")
    both = pairs.join(texts, "id").join(texts.select(F.col("id").alias("earlier"), F.col("line").alias("other")), "earlier")
    return both.where(F.levenshtein("line", "other", 1) == 1).select("id", "earlier")


def _removed(texts: DataFrame, edit_chars: int) -> DataFrame:
    """doc, tag and the set ``gone`` of the positions of removed lines, where there are any."""
    found = _occurrences(texts)
    place = F.struct("doc", "tag", "pos")
    keys = F.when(F.length("line") >= edit_chars, _meeting_keys(F.col("line")))
    # One row for each distinct line, without its text; equal lines are combined before the shuffle.
    keyed = found.select("id", place.alias("place"), keys.alias("keys"))
    distinct = written(keyed.groupBy("id").agg(F.min("place").alias("first"), F.first("keys").alias("keys")), "lines")
    keys = distinct.select("id", F.explode("keys").alias("key"))
    shared = keys.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b").select("key")
    meeting = keys.join(shared, "key", "left_semi").select("id").distinct()
    firsts = distinct.select("id", "first").join(meeting, "id", "left_semi")
    # Lines are taken from the documents in which they come first, each split once.
    wanted = written(firsts.groupBy(F.col("first.doc").alias("fdoc"), F.col("first.tag").alias("ftag")).agg(F.collect_list(F.struct("id", "first")).alias("wanted")), "meeting")
    size = wanted.agg(F.sum(128 + 96 * F.size("wanted"))).first()[0] or 0
    source = texts.join(F.broadcast(wanted) if size <= MOST_BROADCAST else wanted, F.col("doc").eqNullSafe(F.col("fdoc")) & (F.col("tag") == F.col("ftag")))
    taken = _let(_lines(F.col("text")), lambda lines: F.transform("wanted", lambda w: F.struct(w["id"].alias("id"), w["first"].alias("first"), F.get(lines, w["first"]["pos"]).alias("line"))))
    lines = source.select(F.explode(taken).alias("l")).select("l.*").dropDuplicates(["id"])
    near = written(near_pairs(written(lines, "meeting-lines")).select("id").distinct(), "near-lines").withColumn("near", F.lit(True))
    known = distinct.select("id", "first").join(near, "id", "left")
    same = (F.col("first.doc").eqNullSafe(F.col("doc"))) & (F.col("first.tag") == F.col("tag")) & (F.col("first.pos") == F.col("pos"))
    gone = found.select("id", "doc", "tag", "pos").join(known, "id").where(F.col("near") | ~same)
    return gone.groupBy("doc", "tag").agg(F.collect_set("pos").alias("gone"))


def _kept(text: Column, gone: Column) -> Column:
    """``text`` without the lines at the positions ``gone``; itself if that is null."""

    def left(lines: Column) -> Column:
        places = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone)
        return F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")

    return F.when(gone.isNull(), text).otherwise(_let(_lines(text), left))


def _judged(flat: DataFrame, doc: str, text: str, edit_chars: int) -> DataFrame:
    """``flat`` with ``kept`` (its text without removed lines) and ``gone``."""
    tag = F.xxhash64(text)
    texts = flat.select(F.col(doc).alias("doc"), tag.alias("tag"), F.col(text).alias("text"))
    # By hash, so that the texts needn't be sorted: a partition's removed positions are few.
    removed = _removed(texts, edit_chars).hint("shuffle_hash")
    joined = flat.withColumn("own", tag).join(removed, F.col(doc).eqNullSafe(F.col("doc")) & (F.col("own") == F.col("tag")), "left")
    return joined.withColumn("kept", _kept(F.col(text), F.col("gone")))


def judge(docs: DataFrame, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_sha256 and ``kept`` (the text that is left) of every document."""
    flat = pick(docs, "doc_id", "text").toDF("c0", "c1")
    out = _judged(flat, "c0", "c1", edit_chars)
    n = F.when(F.col("c1").isNull(), 0).otherwise(F.size(_lines(F.col("c1"))))
    return out.select(
        F.col("c0").alias("doc_id"),
        n.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.sha2(F.encode(F.coalesce("kept", F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
        "kept",
    )


def dedup(docs: DataFrame, edit_chars: int = EDIT_CHARS) -> DataFrame:
    """The documents with all their columns, ``text`` without removed lines and
    ``n_chars``, if there is one, counted anew.  A document that loses lines and has
    no word left is dropped; nothing of it isn't in an earlier one."""
    names = docs.columns
    flat = docs.toDF(*[f"c{i}" for i in range(len(names))])
    out = _judged(flat, f"c{place(names, 'doc_id')}", f"c{place(names, 'text')}", edit_chars)
    out = out.where(F.col("gone").isNull() | F.col("kept").rlike(_NOT_BLANK))
    text = place(names, "text")
    columns = [F.col("kept") if i == text else F.when(F.col("gone").isNull(), F.col(f"c{i}")).otherwise(F.length("kept")) if n == "n_chars" else F.col(f"c{i}") for i, n in enumerate(names)]
    return out.select(*[c.cast(docs.schema.fields[i].dataType).alias(f"c{i}") for i, c in enumerate(columns)]).toDF(*names)
