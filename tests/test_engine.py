"""The archive engine: wire values, codecs, containers, lookups, order and mutation."""

import gzip
import io
import random
import tarfile
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import archivelake as A
from archivelake import errors
from archivelake.functions import objecttypes, versions, wire
from archivelake.functions.copytext import to_lines, typed
from archivelake.operators import ordering
from archivelake.plans import builder
from archivelake.sources import codecs, containers, storage

FORMS = [("Custom", c) for c in codecs.EXTENSIONS] + [("Directory", c) for c in codecs.EXTENSIONS] + [("Tar", "none")]


# Wire values.


@given(st.integers(-(2**31), 2**31 - 1), st.integers(4, 8))
def test_int(value, size):
    raw = wire.put_int(value, size)
    assert len(raw) == size + 1 and wire.Reader(io.BytesIO(raw), len(raw), size).int() == value


@given(st.one_of(st.none(), st.text(st.characters(exclude_categories=["Cs"]))))
def test_string(value):
    raw = wire.put_string(value, 4)
    assert wire.Reader(io.BytesIO(raw), len(raw)).string() == (value or None)


@given(st.sampled_from(["NotSet", "Set", "NoData"]), st.integers(0, 2**56 - 1))
def test_offset(state, value):
    raw = wire.put_offset(state, value, 8)
    assert wire.Reader(io.BytesIO(raw), len(raw)).offset() == (state, value)


def reader(raw):
    return wire.Reader(io.BytesIO(raw), len(raw))


@pytest.mark.parametrize(
    "raw,error",
    [
        (b"", errors.InvalidHeader),
        (b"PGDMX\1\x0e\0\4\x08\1\0\0\0\0\0", errors.InvalidHeader),
        (b"PGDMP\1\x0b\0\4\x08\1\0\0\0\0\0", errors.UnsupportedVersion),
        (b"PGDMP\1\x11\0\4\x08\1\0", errors.UnsupportedVersion),
        (b"PGDMP\1\x10\0\0\x08\1\0", errors.InvalidHeader),
        (b"PGDMP\1\x10\0\4\x09\1\0", errors.InvalidHeader),
        (b"PGDMP\1\x10\0\4\x08\6\0", errors.UnsupportedFormat),
        (b"PGDMP\1\x10\0\4\x08\1\4", errors.UnsupportedCompression),
        (b"PGDMP\1\x10\0\4", errors.ArchiveIOError),
    ],
)
def test_bad_headers(raw, error):
    with pytest.raises(error):
        wire.read_header(reader(raw))


def test_header_levels_before_codec_bytes():
    for level, codec in ((0, "none"), (6, "gzip"), (-1, "gzip")):
        assert wire.read_header(reader(b"PGDMP\1\x0e\0\4\x08\1" + wire.put_int(level, 4))).compression == codec
    with pytest.raises(errors.UnsupportedCompression):
        wire.put_header(wire.Header((1, 14, 0), compression="zstd"))


def test_bad_values():
    with pytest.raises(errors.DataIntegrity):
        reader(b"\0" + b"\xff" * 4).int()
    with pytest.raises(errors.ArchiveIOError):
        reader(wire.put_int(1 << 30, 4) + b"x").string()
    with pytest.raises(errors.InvalidUtf8):
        reader(wire.put_int(1, 4) + b"\xff").string()
    with pytest.raises(errors.DataIntegrity):
        reader(b"\7" + b"\0" * 8).offset()


@pytest.mark.parametrize("minor", range(12, 17))
@pytest.mark.parametrize("with_file", [False, True])
def test_toc_round_trip(minor, with_file):
    header = wire.Header((1, minor, 0))
    full = wire.Entry(7, "TABLE DATA", True, "1", "2", "tág", "Data", "def", "drop", "copy", "ns", "ts", "heap", "r", "me", True, (1, 2, -3), "NotSet" if with_file else "Set", 0 if with_file else 99, "7.dat" if with_file else None)
    entries = (full, wire.Entry(8, "NEW KIND", dependencies=(7,)))
    toc = wire.Toc(header, dict(zip(("sec", "min", "hour", "day", "month", "year", "is_dst"), (1, 2, 3, 4, 5, 125, 0), strict=True)), "db", "17.0", "v", entries)
    raw = wire.put_preamble(toc) + b"".join(wire.put_entry(e, header, with_file) for e in entries)
    got = wire.read_toc(io.BytesIO(raw), len(raw), with_file)
    lost = {} if minor >= 16 else {"relkind": None} | ({} if minor >= 14 else {"tableam": None})
    assert got == wire.Toc(header, toc.timestamp, "db", "17.0", "v", (full.updated(**lost), entries[1]))


def test_entry_quirks():
    header = wire.Header()
    raw = wire.put_entry(wire.Entry(1, "X", relkind=None), header, False)
    assert wire.read_entry(reader(raw), header.version, False).section == "None"
    words = b"".join(wire.put_string(s, 4) for s in ("5", "x", "-2", "+3", "99999999999")) + wire.put_string(None, 4)
    start = raw[: raw.rindex(wire.put_string("false", 4)) + 10]
    got = wire.read_entry(reader(start + words + wire.put_offset("Set", 1 << 40, 8)), header.version, False)
    assert got.dependencies == (5, -2, 3) and got.offset == 1 << 40


def test_versions():
    assert versions.parse_server("17.0") == (17, 0) and versions.parse_server("9.6.24") == (9, 6)
    assert versions.parse_server("18beta1") is None and versions.parse_server("16.x") == (16, 0) and versions.parse_server("11") == (11, 0)
    cases = {(8, 4): None, (9, 0): 12, (10, 2): 12, (10, 3): 13, (11, 99): 13, (12, 0): 14, (15, 9): 14, (16, 0): 15, (17, 0): 16, (99, 0): 16}
    for server, minor in cases.items():
        assert versions.from_server(*server) == (minor and (1, minor, 0))


def test_object_types():
    known = [x.split("|") for x in objecttypes.OBJECT_TYPES.split("\n") if x]
    assert len(known) == 72 == len({k for k, _, _ in known})
    assert [sum(s == n for _, s, _ in known) for n in objecttypes.SECTIONS] == [8, 41, 3, 20]
    assert (objecttypes.section("nothing"), objecttypes.priority("nothing")) == ("None", 0)


# Codecs.


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=3000), max_size=5), st.sampled_from(list(codecs.EXTENSIONS)), st.booleans())
def test_parts_make_one_stream(parts, codec, gzip_file):
    sums = codecs.Checksums()
    for p in parts:
        own = codecs.Checksums()
        own.add(p)
        sums = sums.then(own)
    plain = b"".join(parts)
    assert (sums.size, sums.adler, sums.crc) == (len(plain), zlib.adler32(plain), zlib.crc32(plain))
    encoded = [b"".join(codecs.encode_part([p], codec)) for p in parts if p]
    whole = b"".join([codecs.head(codec, gzip_file), *encoded, codecs.tail(codec, gzip_file, sums)]) if encoded else b""
    cut = [whole[i : i + 700] for i in range(0, len(whole), 700)]
    assert b"".join(codecs.decode(cut, codec, gzip_file)) == plain
    if encoded:
        if codec == "gzip":
            assert (gzip.decompress if gzip_file else zlib.decompress)(whole) == plain
        elif codec == "lz4":
            assert pa.CompressedInputStream(pa.BufferReader(whole), "lz4").read() == plain


@pytest.mark.parametrize("codec", ["gzip", "lz4", "zstd"])
def test_damaged_streams(codec):
    with pytest.raises(errors.DecompressionError):
        list(codecs.decode([b"not a stream at all, certainly"], codec))


# Containers.


def sample(spark, lines="1\tAlice\n2\tBob\n3\tCharlie\n"):
    b = A.new("testdb").add_entry("TABLE", "public", "users", defn="CREATE TABLE;\n")
    b = b.add_entry("TABLE DATA", "public", "users", copy_stmt="COPY;\n", dependencies=[b.last_id])
    b = b.set_bytes(b.last_id, lines.encode())
    return b.add_blobs(spark.createDataFrame([(16601, bytearray(b"hello")), (16602, bytearray([0, 1, 2, 3, 255, 254, 253])), (4_000_000_000, bytearray())], "oid long, data binary"))


def lines_of(archive):
    return [r.line for r in archive.table_data("public", "users").collect()]


@pytest.mark.parametrize("form,codec", FORMS)
def test_round_trip(spark, tmp_path, form, codec):
    path = str(tmp_path / "a")
    built = sample(spark).with_format(form).with_compression(codec)
    built.save(spark, path)
    a = A.load(spark, path)
    assert (a.format, a.compression, a.dbname, a.server_version, a.version) == (form, codec, "testdb", "17.0", (1, 16, 0))
    assert lines_of(a) == ["1\tAlice", "2\tBob", "3\tCharlie"]
    got = sorted((r.blob_pos, r.oid, bytes(r.data)) for r in a.blobs().collect())
    assert got == [(0, 16601, b"hello"), (1, 16602, bytes([0, 1, 2, 3, 255, 254, 253])), (2, 4_000_000_000, b"")]
    data = a.lookup("TABLE DATA", "public", "users")
    assert data.section == "Data" and data.dependencies == (a.lookup("TABLE", "public", "users").dump_id,)
    assert bytes(a.entry_data(data.dump_id).first().data) == b"1\tAlice\n2\tBob\n3\tCharlie\n"
    assert [e.desc for e in a.entries] == [e.desc for e in built.sorted().entries]
    # Again, through a builder, into another container; the old files go.
    A.ArchiveBuilder.of(a).with_format("Directory").with_compression("gzip").save(spark, str(tmp_path / "b"))
    A.ArchiveBuilder.of(a).with_format("Directory").with_compression("none").save(spark, str(tmp_path / "b"))
    b = A.load(spark, str(tmp_path / "b"))
    assert lines_of(b) == lines_of(a) and b.blobs().count() == 3 and b.compression == "none"
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]


def test_standard_tools_read_the_files(spark, tmp_path):
    sample(spark).with_format("Tar").save(spark, str(tmp_path / "t"))
    with tarfile.open(tmp_path / "t") as t:
        names = t.getnames()
        assert names[0] == "toc.dat" and names[-1] == "restore.sql" and names[1:-1] == sorted(names[1:-1])
        assert t.extractfile("5.dat").read() == b"1\tAlice\n2\tBob\n3\tCharlie\n"
    sample(spark).with_format("Directory").with_compression("gzip").save(spark, str(tmp_path / "d"))
    assert gzip.decompress((tmp_path / "d" / "5.dat.gz").read_bytes()) == b"1\tAlice\n2\tBob\n3\tCharlie\n"
    assert (tmp_path / "d" / "blobs_6.toc").read_text().split("\n")[0] == "16601 blob_16601.dat"


@pytest.mark.parametrize("form", ["Custom", "Directory", "Tar"])
def test_lines_do_not_depend_on_splits(spark, tmp_path, monkeypatch, form):
    rng = random.Random(4)
    monkeypatch.setattr("archivelake.plans.builder.CHUNK", 7)
    for end in ("", "\n", "\r", "\r\n"):
        text = "".join(rng.choice(["a", "é", "\n", "\r", "\r\n", "long line " * 3, "\\.", "\n\n"]) for _ in range(200)) + "x" + end
        sample(spark, text).with_format(form).save(spark, path := str(tmp_path / f"{len(end)}{ord((end or 'x')[0])}"))
        cut = [x.removesuffix("\r") for x in text.split("\n")[:-1]] + [x for x in text.split("\n")[-1:] if x]
        want = [x for x in cut if x and x != "\\."]
        for size in (1, 5, 40, 1 << 20):
            monkeypatch.setattr(containers, "SPLIT_BYTES", size)
            c = containers.open_container(path)
            entries = [e for e in c.toc.entries if e.desc == "TABLE DATA"]
            got = [x.decode() for s in c.data(entries) for group in containers.lines(s) for x in group]
            assert [x for x in got if x and x != "\\."] == want, (form, end, size)


def test_numbered_lines_over_splits(spark, tmp_path, monkeypatch):
    text = "".join(f"{i}\n" + "\n" * (i % 3) for i in range(500))
    sample(spark, text).with_format("Directory").save(spark, path := str(tmp_path / "a"))
    monkeypatch.setattr(containers, "SPLIT_BYTES", 1 << 30)
    assert {(r.line_no, r.line) for r in A.load(spark, path).numbered("public", "users").collect()} == {(i + 1, str(i)) for i in range(500)}


def test_errors(spark, tmp_path):
    path = str(tmp_path / "a")
    b = sample(spark).add_entry("TABLE DATA", "public", "bare").add_entry("TABLE DATA", None, "nowhere")
    b.save(spark, path)
    a = A.load(spark, path)
    with pytest.raises(errors.EntityNotFound):
        a.table_data("public", "missing")
    with pytest.raises(errors.NoData):
        a.table_data("public", "bare")
    with pytest.raises(errors.InvalidDumpId):
        a.entry_data(999)
    with pytest.raises(errors.InvalidDumpId):
        b.set_bytes(999, b"")
    assert a.lookup("TABLE DATA", None, "nowhere") is not None or a.lookup_rows("TABLE DATA", None, "nowhere").count() == 0
    assert a.get_entry(999) is None and b.update(999, tag="x") == b
    assert a.entry_data(a.lookup("TABLE", "public", "users").dump_id).count() == 0
    with pytest.raises(errors.ArchiveIOError):
        A.load(spark, str(tmp_path / "nothing"))
    (tmp_path / "junk").write_bytes(b"junk")
    with pytest.raises(errors.InvalidHeader):
        A.load(spark, str(tmp_path / "junk"))
    (tmp_path / "folder").mkdir()
    with pytest.raises(errors.InvalidHeader):
        A.load(spark, str(tmp_path / "folder"))
    with pytest.raises(errors.UnsupportedCompression):
        sample(spark).with_format("Tar").with_compression("gzip").save(spark, str(tmp_path / "t"))
    assert sample(spark).with_compression("gzip").with_format("Tar").toc.header.compression == "none"
    with pytest.raises(errors.UnsupportedCompression):
        A.new("x", appear_as="15.0").with_compression("lz4").save(spark, str(tmp_path / "t"))
    bad = A.new("x").add_blobs(spark.createDataFrame([(0, bytearray(b"x"))], "oid long, data binary"))
    with pytest.raises(Exception, match="object id 0"):
        bad.save(spark, str(tmp_path / "t"))
    assert not [p for p in tmp_path.iterdir() if "staging" in p.name]


def test_damaged_files(spark, tmp_path):
    path = tmp_path / "a"
    sample(spark).save(spark, str(path))
    raw = path.read_bytes()
    data = A.load(spark, str(path)).lookup("TABLE DATA", "public", "users")
    for at, byte, error in ((data.offset, 9, errors.DataIntegrity), (data.offset + 2, 77, errors.DataIntegrity), (data.offset + 6, 1, errors.DataIntegrity)):
        path.write_bytes(raw[:at] + bytes([byte]) + raw[at + 1 :])
        c = containers.open_container(str(path))
        with pytest.raises(error):
            [list(containers.raw(s)) for s in c.data(c.toc.entries)]
    path.write_bytes(raw[: len(raw) // 4])
    with pytest.raises(errors.ArchiveError):
        containers.open_container(str(path))
    sample(spark).with_format("Directory").save(spark, str(tmp_path / "d"))
    (tmp_path / "d" / "5.dat").unlink()
    with pytest.raises(errors.NoData):
        A.load(spark, str(tmp_path / "d")).table_data("public", "users")
    (tmp_path / "d" / "blob_16601.dat").unlink()
    c = containers.open_container(str(tmp_path / "d"))
    with pytest.raises(errors.DataIntegrity):
        c.blobs(c.toc.entries)
    (tmp_path / "d" / "blobs_6.toc").write_text("nonsense\n")
    with pytest.raises(errors.DataIntegrity):
        c.blobs(c.toc.entries)
    (tmp_path / "d" / "blobs_6.toc").unlink()
    assert c.blobs(c.toc.entries) == []
    evil = c.toc.entries[4].updated(filename="../x")
    with pytest.raises(errors.DataIntegrity):
        c.data([evil])


def test_only_what_has_a_payload_is_read(spark, tmp_path):
    sample(spark).save(spark, path := str(tmp_path / "a"))
    c = containers.open_container(path)
    e = next(e for e in c.toc.entries if e.desc == "TABLE DATA")
    assert len(c.data([e])) == 1 and c.blobs([e]) == []
    assert c.data([e.updated(had_dumper=False)]) == [] == c.data([e.updated(data_state="NotSet")])


def test_tar_reading_rules(tmp_path):
    path = tmp_path / "t"
    good = containers.tar_header("toc.dat", 3) + b"abc".ljust(512, b"\0")
    path.write_bytes(good + b"\0" * 512 + containers.tar_header("late", 0))
    assert containers.members(str(path)) == {"toc.dat": (512, 3)} and containers.detect(str(path)) == "Tar"
    path.write_bytes(good + containers.tar_header("restore.sql", 0) + containers.tar_header("a/b", 0))
    with pytest.raises(errors.DataIntegrity):
        containers.members(str(path))
    path.write_bytes(containers.tar_header("x", 5000))
    with pytest.raises(errors.DataIntegrity):
        containers.members(str(path))
    with pytest.raises(errors.DataIntegrity):
        containers.tar_header("x", 8**11)


# Order.


def entry(i, desc="TABLE", ns=None, tag=None, deps=()):
    return wire.Entry(i, desc, namespace=ns, tag=tag, dependencies=tuple(deps))


def simulated(entries):
    """The last free entry goes to the end, by looking at all of them each time."""
    left, out = list(enumerate(entries)), []
    ids = {e.dump_id for e in entries if e.dump_id > 0}
    while True:
        needed = [d for _, e in left for d in e.dependencies if d in ids]
        free = [(i, e) for i, e in left if e.dump_id > 0 and e.dump_id not in needed]
        if not free:
            break
        out.append(free[-1][1])
        left.remove(free[-1])
    return [e for _, e in reversed(left)] + out[::-1]


@settings(max_examples=200, deadline=None)
@given(st.data())
def test_order_equals_a_simulation(data):
    n = data.draw(st.integers(0, 12))
    ids = data.draw(st.permutations(range(1, n + 1)))
    entries = [entry(i, deps=data.draw(st.lists(st.integers(-1, n + 2), max_size=3))) for i in ids]
    if n > 1:
        assert ordering.by_dependencies(entries) == simulated(entries)


def test_order_rules():
    assert [e.tag for e in ordering.by_dependencies([entry(1, "SCHEMA", tag="s"), entry(2, tag="a", deps=(3, 1)), entry(3, tag="b", deps=(2,))])] == ["b", "a", "s"]
    entries = [entry(4, "NEW KIND"), entry(1, "TABLE", "b", "x"), entry(2, "TABLE", None, "x"), entry(3, "TABLE", "a", None), entry(5, "SCHEMA"), entry(6, "TABLE", "a", "z")]
    assert [e.dump_id for e in ordering.ordered(entries)] == [4, 5, 6, 3, 1, 2]
    assert ordering.ordered([]) == [] and ordering.ordered(entries[:1]) == entries[:1]


# COPY text.


def test_copy_text(spark):
    rows = [(1, "a\tb\nc\\d\r\b\f\v", None, True, 1.5, bytearray(b"\x00\xff")), (2, "\\N", "", None, None, None), (3, "\\\\n\\t", "é😀", False, -0.0, bytearray())]
    df = spark.createDataFrame(rows, "a int, b string, c string, d boolean, e double, f binary")
    lines = to_lines(df)
    assert not [r for r in lines.collect() if "\n" in r.line]
    assert lines.select(*typed(lines.line, df.schema)).collect() == df.collect()


def test_source_pushes_filters(spark, tmp_path):
    sample(spark).add_entry("X").save(spark, path := str(tmp_path / "a"))
    a = A.load(spark, path)
    found = spark.read.format("pgarchive").option("relation", "table_lines").load(path)
    assert found.where("dump_id = 5").count() == 3 and found.where("dump_id = 4").count() == 0
    with pytest.raises(Exception, match="no relation"):
        spark.read.format("pgarchive").option("relation", "nothing").load(path).count()
    assert storage.kind(path) == "file" and a.toc().where("computed_section = 'Data'").count() == 2


def test_splits_follow_the_cores(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(containers, "LEAST_SPLIT", 100)
    monkeypatch.setattr("archivelake.plans.builder.CHUNK", 50)
    text = "".join(f"{i:09}\n" for i in range(1000))
    for form in ("Custom", "Directory", "Tar"):
        sample(spark, text).with_format(form).save(spark, path := str(tmp_path / form))
        for cores, most in ((1, 1), (4, 4), (1000, 100)):
            c = containers.open_container(path, cores)
            splits = c.data([e for e in c.toc.entries if e.desc == "TABLE DATA"])
            assert most // 2 <= len(splits) <= most + 1
            assert b"".join(x + b"\n" for s in splits for g in containers.lines(s) for x in g).decode() == text


@pytest.mark.parametrize("form", ["Custom", "Directory", "Tar"])
def test_a_save_that_fails_leaves_the_old_archive(spark, tmp_path, form, monkeypatch):
    path = str(tmp_path / "a")
    sample(spark).with_format(form).save(spark, path)
    before = A.load(spark, path).blobs().count()
    bad = A.new("x").add_blobs(spark.createDataFrame([(0, bytearray(b"x"))], "oid long, data binary")).with_format(form)
    with pytest.raises(Exception, match="object id 0"):
        bad.save(spark, path)
    assert A.load(spark, path).blobs().count() == before
    move = storage.move

    def stuck(source, target):
        if source.endswith("/archive"):
            raise OSError("no room")
        move(source, target)

    monkeypatch.setattr(storage, "move", stuck)
    with pytest.raises(OSError, match="no room"):
        A.new("x").with_format(form).save(spark, path)
    monkeypatch.undo()
    assert A.load(spark, path).blobs().count() == before
    A.new("other").with_format(form).save(spark, path)
    assert A.load(spark, path).dbname == "other" and [p.name for p in tmp_path.iterdir()] == ["a"]


def test_a_line_of_many_chunks_and_a_toc_of_many_blocks(spark, tmp_path):
    line = "x" * (3 << 20)
    b = A.new("x").add_entry("TABLE DATA", "public", "t")
    b = b.set_lines(b.last_id, spark.createDataFrame([("a",), (line,), ("b",)], "line string").coalesce(1))
    b = b.add_entries({"desc": "TABLE", "tag": f"t{i}", "defn": "-- " + "y" * 90} for i in range(12_000))
    b.save(spark, path := str(tmp_path / "a"))
    a = A.load(spark, path)
    assert [r.line for r in a.table_data("public", "t").collect()] == ["a", line, "b"]
    assert a.toc().count() == 12_004 and a.toc().where("toc_pos >= 10000").count() == 2_004


def test_reading_ahead():
    raw = bytes(range(256)) * 40
    ahead = storage.Ahead(io.BytesIO(raw), block=100)
    got = b"".join(ahead.read(n) for n in [0, 1, 99, 100, 101, 5000, 3, 10**6])
    assert got == raw and ahead.tell() == len(raw) and ahead.read(5) == b""


# Tables of contents that no driver holds.


@pytest.mark.parametrize("form", ["Custom", "Directory", "Tar"])
def test_entries_that_are_rows_equal_entries(spark, tmp_path, monkeypatch, form):
    rng = random.Random(5)
    values = []
    for i in range(60):
        deps = rng.sample(range(1, 70), rng.choice([0, 0, 0, 1, 2]))
        values.append({"desc": rng.choice(["TABLE", "VIEW", "NOT KNOWN", "ACL"]), "namespace": rng.choice([None, "a", "b"]), "tag": rng.choice([None, "", "é", f"t{i}"]), "defn": "x" * i, "dependencies": tuple(deps)})
    rows = spark.createDataFrame([(i, *(list(x) if isinstance(x, tuple) else x for x in v.values())) for i, v in enumerate(values)], "i int, desc string, namespace string, tag string, defn string, dependencies array<int>")
    for with_deps in (True, False):
        few = A.new("x").add_entries(v | {} if with_deps else v | {"dependencies": ()} for v in values)
        many = A.new("x").add_rows((rows if with_deps else rows.drop("dependencies")).repartition(7), "i", path=str(tmp_path / f"numbered{with_deps}"))
        assert many.last_id == few.last_id == 63 and [e.dump_id for e in many.entries] == [1, 2, 3]
        both = []
        for k, b in enumerate((few, many)):
            b = b.update(10, tag="renamed", dependencies=(4, 5)).update(999, tag="nobody").add_entry("TABLE DATA", "public", "t", dependencies=(7,))
            b = b.set_bytes(b.last_id, b"a\nb\n").set_bytes(9, b"c\n")
            with pytest.raises(errors.InvalidDumpId):
                b.set_bytes(999, b"")
            b.with_format(form).save(spark, path := str(tmp_path / f"{with_deps}{k}"))
            both.append(A.load(spark, path))
        assert both[0].entries and [e.updated(offset=0) for e in both[0].entries] == [e.updated(offset=0) for e in both[1].entries]
        assert all([r.line for r in a.table_data("public", "t").collect()] == ["a", "b"] and bytes(a.entry_data(9).first().data) == b"c\n" for a in both)
        held, told = both[0].entries, [r.asDict() for r in both[0].toc().collect()]
        monkeypatch.setattr(wire, "BLOCK", 7)
        large = A.load(spark, both[0].path)
        assert isinstance(large.entries, wire.Entries) and tuple(large.entries) == held and large.entries[-1] == held[-1] and large.entries[5:9] == held[5:9]
        assert len(large.entries.marks) == len(range(0, len(held), 7)) + 1
        assert large.get_entries([9, 10, 999]) == {9: both[0].get_entry(9), 10: both[0].get_entry(10)} and large.get_entry(-1) is None
        assert large.lookup("TABLE DATA", "public", "t") == both[0].lookup("TABLE DATA", "public", "t")
        assert sorted((r.asDict() for r in large.toc().collect()), key=lambda r: r["toc_pos"]) == told
        monkeypatch.undo()


def test_a_large_toc_that_is_cut_short(spark, tmp_path, monkeypatch):
    sample(spark).save(spark, str(path := tmp_path / "a"))
    raw = path.read_bytes()
    monkeypatch.setattr(wire, "BLOCK", 2)
    assert lines_of(A.load(spark, str(path))) == ["1\tAlice", "2\tBob", "3\tCharlie"] and A.load(spark, str(path)).blobs().count() == 3
    path.write_bytes(raw[:250])
    with pytest.raises(errors.ArchiveIOError):
        A.load(spark, str(path))


def test_a_tar_of_many_objects_is_put_together_from_few_parts(spark, tmp_path, monkeypatch):
    plans = []
    put = builder._assemble
    monkeypatch.setattr(builder, "_assemble", lambda s, plan: (plans.append(plan), put(s, plan))[1])
    objects = spark.range(1, 2001, numPartitions=5).selectExpr("id AS oid", "encode(repeat('x', cast(id % 700 AS int)), 'UTF-8') AS data")
    again = spark.createDataFrame([(7, bytearray(b"last"))], "oid long, data binary")
    b = sample(spark).add_blobs(objects).add_blobs(again).with_format("Tar")
    b.save(spark, path := str(tmp_path / "t"))
    assert all(len(parts) < 100 for plan in plans for parts in plan.values())
    with tarfile.open(path) as t:
        names = t.getnames()
        assert names[0] == "toc.dat" and names[-1] == "restore.sql" and names[1:-1] == sorted(names[1:-1]) and len(set(names)) == len(names) == 2003 + 4
        assert t.extractfile("blob_7.dat").read() == b"last" and t.extractfile("blob_701.dat").read() == b"x"
    got = sorted((r.blob_pos, r.oid, len(r.data)) for r in A.load(spark, path).blobs().collect())
    assert got == [(0, 16601, 5), (1, 16602, 7), (2, 4_000_000_000, 0), *((i + 2, i, i % 700 if i != 7 else 4) for i in range(1, 2001)), (2003, 7, 4)]
