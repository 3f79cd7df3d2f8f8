"""Archives that arrive in a folder."""

import archivelake as A
from archivelake.streaming.folder import arriving


def test_each_archive_is_listed_once(spark, tmp_path):
    inbox = tmp_path / "inbox"
    inbox.mkdir()
    for i in range(3):
        b = A.new(f"db{i}").add_entry("TABLE", "public", f"t{i}")
        b.save(spark, str(tmp_path / f"a{i}"))
        (tmp_path / f"a{i}").rename(inbox / f"a{i}.dump")
    (inbox / "junk.dump").write_bytes(b"junk")
    query = arriving(spark, str(inbox), "*.dump").writeStream.format("memory").queryName("arrived").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.table("arrived").collect()
    assert sorted((r.dbname, r.tag) for r in rows if r.desc == "TABLE") == [(f"db{i}", f"t{i}") for i in range(3)]
    assert [r.path.rsplit("/", 1)[1] for r in rows if r.error] == ["junk.dump"] and len(rows) == 13
