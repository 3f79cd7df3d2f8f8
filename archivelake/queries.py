"""Queries that exercise every operator, with the SQL that says what they give."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import ArchiveError
from .functions import dates, objecttypes, versions, wire
from .operators.ordering import by_dependencies, phase1
from .plans.archive import Archive
from .plans.builder import ArchiveBuilder, new
from .plans.workspace import folder, saved, with_table
from .sources import storage
from .sources.containers import members

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str, name: str | None = None):
    def register(f):
        key = name or f.__name__
        QUERIES[key], ORACLE_SQL[key] = f, sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _table(spark: SparkSession, sf_dir: str, name: str, form: str, codec: str) -> Archive:
    return saved(spark, (sf_dir, name), lambda: with_table(name, _read(spark, sf_dir, name)), form, codec)


def _round_trip(table: str, form: str, codec: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _table(spark, sf_dir, table, form, codec).table("public", table, _read(spark, sf_dir, table).schema)

    return run


for _form, _short, _name in (("Custom", "custom", "orders"), ("Directory", "dir", "customer")):
    for _codec in ("none", "gzip", "lz4", "zstd"):
        query(f"SELECT * FROM {_name}", f"q_rt_{_short}_{_codec}")(_round_trip(_name, _form, _codec))
query("SELECT * FROM part", "q_rt_tar")(_round_trip("part", "Tar", "none"))


# Every text as it is, and beside it one with every character that COPY escapes, or null.
_ODD_TEXT = "CASE WHEN doc_id % 7 > 0 THEN concat(text, {tab}, {cr}, {bs}, 'N', {bs}, 't', {vt}) END"


@query(f"SELECT doc_id, text, {_ODD_TEXT.format(tab='chr(9)', cr='chr(13)', bs='chr(92)', vt='chr(11)')} AS odd FROM documents")
def q_rt_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = F.expr(_ODD_TEXT.format(tab="char(9)", cr="char(13)", bs="char(92)", vt="char(11)"))
    rows = _read(spark, sf_dir, "documents").select("doc_id", "text", odd.alias("odd"))
    return saved(spark, (sf_dir, "text"), lambda: with_table("texts", rows), "Custom", "zstd").table("public", "texts", "doc_id long, text string, odd string")


@query("SELECT concat_ws(chr(9), n_nationkey, n_name, n_regionkey) AS line FROM nation")
def q_lines_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "nation", "Custom", "gzip").table_data("public", "nation")


def _lines(spark: SparkSession, sf_dir: str) -> ArchiveBuilder:
    line = F.when(F.col("c_mktsegment") == "BUILDING", "").when(F.col("c_mktsegment") == "FURNITURE", "\\.").otherwise(F.col("c_name"))
    b = new("testdb").add_entry("TABLE DATA", "public", "lines")
    return b.set_lines(b.last_id, _read(spark, sf_dir, "customer").orderBy("c_custkey").select(line.alias("line")))


@query("SELECT c_name AS line FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'FURNITURE')")
def q_lines_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(spark, (sf_dir, "lines"), lambda: _lines(spark, sf_dir)).table_data("public", "lines")


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS line_no, c_name AS line FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'FURNITURE')")
def q_lines_numbered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(spark, (sf_dir, "lines"), lambda: _lines(spark, sf_dir), "Directory").numbered("public", "lines")


def _objects(form: str, codec: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        objects = _read(spark, sf_dir, "pages").select((F.col("page_id") + 1).alias("oid"), F.encode("html", "UTF-8").alias("data"))
        archive = saved(spark, (sf_dir, "objects"), lambda: new("testdb").add_blobs(objects.orderBy("oid")), form, codec)
        return archive.blobs().select("oid", F.col("blob_pos").cast("long").alias("blob_pos"), F.md5("data").alias("digest"))

    return run


_OBJECT_SQL = "SELECT page_id + 1 AS oid, row_number() OVER (ORDER BY page_id) - 1 AS blob_pos, md5(html) AS digest FROM pages"
query(_OBJECT_SQL, "q_blobs")(_objects("Custom", "gzip"))
query(_OBJECT_SQL, "q_blobs_dir")(_objects("Directory", "lz4"))
query(_OBJECT_SQL, "q_blobs_tar")(_objects("Tar", "none"))


@query("SELECT md5(string_agg(concat(concat_ws(chr(9), c_custkey, c_name, c_nationkey, c_mktsegment), chr(10)), '' ORDER BY c_custkey)) AS digest, sum(strlen(concat(concat_ws(chr(9), c_custkey, c_name, c_nationkey, c_mktsegment), chr(10))))::BIGINT AS size FROM customer")
def q_entry_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").orderBy("c_custkey")
    archive = saved(spark, (sf_dir, "sorted"), lambda: with_table("customer", rows), "Custom", "zstd")
    data = archive.entry_data(archive.lookup("TABLE DATA", "public", "customer").dump_id)
    return data.select(F.md5("data").alias("digest"), F.octet_length("data").cast("long").alias("size"))


# A table of contents made from the rows of ``part``: types by p_size, a dangling or a real dependency.
_KINDS = ["TABLE", "VIEW", "INDEX", "FUNCTION", "NOT KNOWN", "ACL", "SEQUENCE SET"]
_PART_SQL = f"""SELECT 3 + row_number() OVER (ORDER BY p_partkey) AS dump_id, [{", ".join(f"'{k}'" for k in _KINDS)}][p_size % 7 + 1] AS kind,
  CASE WHEN p_partkey % 4 <> 0 THEN lower(p_brand) END AS namespace, CASE WHEN p_partkey % 11 <> 0 THEN p_name END AS tag FROM part"""


def _part_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in _KINDS])
    rows = _read(spark, sf_dir, "part").select(
        "p_partkey", F.get(kinds, F.col("p_size") % 7).alias("desc"), F.when(F.col("p_partkey") % 4 != 0, F.lower("p_brand")).alias("namespace"), F.when(F.col("p_partkey") % 11 != 0, F.col("p_name")).alias("tag")
    )
    return rows.withColumns({"owner": F.lit("postgres"), "defn": F.concat(F.lit("-- "), F.coalesce("tag", F.lit("None")))})


def _part_builder(spark: SparkSession, sf_dir: str) -> ArchiveBuilder:
    return new("testdb").add_rows(_part_rows(spark, sf_dir), "p_partkey", path=f"{folder(spark)}/{uuid.uuid4().hex}")


def _part_toc(spark: SparkSession, sf_dir: str, form: str = "Custom") -> Archive:
    return saved(spark, (sf_dir, "part-toc"), lambda: _part_builder(spark, sf_dir), form)


_TYPES_SQL = "(VALUES " + ", ".join(f"('{k}', '{s}', {p})" for k, s, p in (x.split("|") for x in objecttypes.OBJECT_TYPES.split("\n") if x)) + ") t(kind, section, priority)"
_START_SQL = "(VALUES (1, 'ENCODING', NULL, NULL), (2, 'STDSTRINGS', NULL, NULL), (3, 'SEARCHPATH', NULL, NULL)) s(dump_id, kind, namespace, tag)"
_ALL_SQL = f"(SELECT * FROM ({_PART_SQL}) UNION ALL SELECT * FROM {_START_SQL})"


@query(f"SELECT CAST(dump_id AS INTEGER) AS dump_id, a.kind AS desc_, a.namespace, a.tag, coalesce(section, 'None') AS section, CASE WHEN dump_id > 3 THEN 'postgres' END AS owner, 'NoData' AS data_state FROM {_ALL_SQL} a LEFT JOIN {_TYPES_SQL} ON t.kind = a.kind")
def q_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _part_toc(spark, sf_dir).toc().select("dump_id", F.col("desc").alias("desc_"), "namespace", "tag", "section", "owner", "data_state")


@query(f"SELECT a.kind AS desc_, coalesce(section, 'None') AS section, count(*) AS n, count(tag) AS n_tags FROM {_ALL_SQL} a LEFT JOIN {_TYPES_SQL} ON t.kind = a.kind GROUP BY ALL")
def q_toc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    toc = _part_toc(spark, sf_dir, "Directory").toc()
    return toc.groupBy(F.col("desc").alias("desc_"), F.col("computed_section").alias("section")).agg(F.count("*").alias("n"), F.count("tag").alias("n_tags"))


_PRIORITY = f"coalesce((SELECT priority FROM {_TYPES_SQL} WHERE t.kind = a.kind), 0)"


@query(f"SELECT CAST(dump_id AS INTEGER) AS dump_id, row_number() OVER (ORDER BY {_PRIORITY}, namespace NULLS LAST, tag NULLS LAST, kind, dump_id) - 1 AS sort_pos FROM {_ALL_SQL} a")
def q_toc_phase1(spark: SparkSession, sf_dir: str) -> DataFrame:
    # From a file in the order of ids: the rows of the archive before sorting.
    toc = _part_toc(spark, sf_dir).toc().withColumn("toc_pos", F.col("dump_id"))
    return phase1(toc, f"{folder(spark)}/{uuid.uuid4().hex}").select("dump_id", "sort_pos")


_FK = {"nation": ["region"], "customer": ["nation"], "supplier": ["nation"], "orders": ["customer"], "lineitem": ["orders", "part", "supplier"]}
_TABLES = ["lineitem", "orders", "customer", "supplier", "part", "nation", "region"]


def _order_entries() -> list[tuple[int, str, str, list[int]]]:
    """(id, type, tag, dependencies) of tables, their data and foreign keys."""
    out, ids = [], {}
    for kind in ("TABLE", "TABLE DATA", "FK CONSTRAINT"):
        for t in _TABLES:
            ids[kind, t] = i = len(out) + 4
            if kind == "TABLE":
                needs = []
            elif kind == "TABLE DATA":
                needs = [ids["TABLE", t], *[ids["TABLE DATA", p] for p in _FK.get(t, []) if ("TABLE DATA", p) in ids], 999]
            else:
                needs = [ids["TABLE DATA", t], *[ids["TABLE DATA", p] for p in _FK.get(t, [])]]
            out.append((i, kind, t, needs))
    # Views on top of each other, against the order of their names.
    for k in range(6):
        out.append((len(out) + 4, "VIEW", f"v{k}", [len(out) + 5] if k < 5 else [ids["TABLE", "region"]]))
    return out


def _order_sql() -> str:
    rows = [(i, k, t, d) for i, k, t, d in _order_entries()] + [(1, "ENCODING", None, []), (2, "STDSTRINGS", None, []), (3, "SEARCHPATH", None, [])]
    values = ", ".join(f"({i}, '{k}', {'NULL' if t is None else repr(t)}, {d or '[]::INTEGER[]'})" for i, k, t, d in rows)
    return f"""
WITH RECURSIVE e(id, kind, tag, needs) AS (VALUES {values}),
p AS (SELECT id, needs, row_number() OVER (ORDER BY (SELECT priority FROM {_TYPES_SQL} WHERE t.kind = e.kind), tag NULLS LAST, kind, id) AS i FROM e),
d AS (SELECT a.i AS before, b.i AS after FROM p a JOIN p b ON list_contains(b.needs, a.id)),
steps(n, done) AS (
  SELECT 0, []::BIGINT[]
  UNION ALL
  SELECT n + 1, list_append(done, (SELECT max(i) FROM p WHERE NOT list_contains(done, i) AND NOT EXISTS (SELECT 1 FROM d WHERE d.before = p.i AND NOT list_contains(done, d.after))))
  FROM steps WHERE n < (SELECT count(*) FROM p)),
final AS (SELECT list_reverse(done) AS o FROM steps ORDER BY n DESC LIMIT 1)
SELECT list_position(o, i) - 1 AS toc_pos, id AS dump_id FROM p, final"""


@query(_order_sql())
def q_toc_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> ArchiveBuilder:
        b = new("testdb")
        for _, kind, tag, needs in _order_entries():
            b = b.add_entry(kind, "public", tag, dependencies=needs)
        return b

    return saved(spark, ("order",), build).toc().select("toc_pos", "dump_id")


@query("SELECT * FROM (VALUES ('b'), ('a'), ('s')) t(tag) WHERE true", "q_toc_cycle")
def q_toc_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, a, b = wire.Entry(1, "SCHEMA", tag="s"), wire.Entry(2, "TABLE", tag="a", dependencies=(3, 1)), wire.Entry(3, "TABLE", tag="b", dependencies=(2,))
    return spark.createDataFrame([(e.tag,) for e in by_dependencies([s, a, b])], "tag string")


@query(f"""SELECT CAST(min(dump_id) AS INTEGER) AS dump_id, kind AS desc_, namespace, tag FROM {_ALL_SQL} a
WHERE kind = 'TABLE' AND (namespace, tag) = (SELECT (namespace, tag) FROM {_ALL_SQL} WHERE kind = 'TABLE' AND namespace IS NOT NULL AND tag IS NOT NULL ORDER BY dump_id LIMIT 1) GROUP BY ALL""")
def q_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = _part_toc(spark, sf_dir)
    tables = archive.toc().where("desc = 'TABLE' and namespace <> '' and tag <> ''")
    first = tables.orderBy("dump_id").first()
    return archive.lookup_rows("TABLE", first.namespace, first.tag).select("dump_id", F.col("desc").alias("desc_"), "namespace", "tag")


@query(f"SELECT CAST(dump_id AS INTEGER) AS dump_id, CASE WHEN dump_id = 10 THEN 'renamed' ELSE tag END AS tag, CASE WHEN dump_id = 10 THEN 'x' WHEN dump_id > 3 THEN 'postgres' END AS owner FROM {_ALL_SQL}")
def q_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> ArchiveBuilder:
        b = _part_builder(spark, sf_dir).update(10, tag="renamed", owner="x")
        return b.update(b.last_id + 1, tag="nobody")

    return saved(spark, (sf_dir, "update"), build, "Tar").toc().select("dump_id", "tag", "owner")


@query("SELECT * FROM customer")
def q_resave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive that is read, converted to another container and codec, and read again."""
    first = _table(spark, sf_dir, "customer", "Directory", "gzip")
    schema = _read(spark, sf_dir, "customer").schema
    return saved(spark, (sf_dir, "customer", "again"), lambda: ArchiveBuilder.of(first), "Custom", "lz4").table("public", "customer", schema)


@query("""SELECT * FROM (VALUES (0, 1, 'ENCODING', 'SET client_encoding = ''UTF8'';' || chr(10), 'PreData'), (1, 3, 'SEARCHPATH', 'SELECT pg_catalog.set_config(''search_path'', '''', false);' || chr(10), 'PreData'),
(2, 2, 'STDSTRINGS', 'SET standard_conforming_strings = ''on'';' || chr(10), 'PreData')) t(toc_pos, dump_id, desc_, defn, section)""")
def q_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return saved(spark, ("new",), lambda: new("testdb")).toc().select("toc_pos", "dump_id", F.col("desc").alias("desc_"), "defn", "section")


_CODECS_SQL = "SELECT x.form AS format, x.codec AS compression, x.version, 4 AS int_size, 8 AS off_size, 'testdb' AS dbname, x.server AS server_version, 'pg_dump (PostgreSQL) ' || x.server AS dump_version, 3 AS n_entries, TIMESTAMP '2025-03-04 05:06:07' AS created_at FROM (VALUES ('Custom', 'gzip', '1.14.0', '12.4'), ('Directory', 'zstd', '1.16.0', '17.0'), ('Tar', 'none', '1.12.0', '9.6'), ('Custom', 'lz4', '1.15.0', '16.2'), ('Custom', 'none', '1.16.0', '18beta1'), ('Custom', 'none', '1.13.0', '11')) x(form, codec, version, server)"


@query(_CODECS_SQL)
def q_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    made = {"sec": 7, "min": 6, "hour": 5, "day": 4, "month": 2, "year": 125, "is_dst": 0}
    for form, codec, server in (("Custom", "gzip", "12.4"), ("Directory", "zstd", "17.0"), ("Tar", "none", "9.6"), ("Custom", "lz4", "16.2"), ("Custom", "none", "18beta1"), ("Custom", "none", "11")):
        info = saved(spark, ("archive", server), lambda server=server: new("testdb", appear_as=server)._with(timestamp=made), form, codec).info()
        info = info.select("format", "compression", "version", "int_size", "off_size", "dbname", "server_version", "dump_version", "n_entries", "created_at")
        out = info if out is None else out.union(info)
    return out


@query("SELECT * FROM (VALUES ('Custom', 'Custom', 'zstd'), ('Directory', 'Directory', 'gzip'), ('Tar', 'Tar', 'none')) t(wanted, format, compression)")
def q_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = []
    for form, codec in (("Custom", "zstd"), ("Directory", "gzip"), ("Tar", "none")):
        archive = _table(spark, sf_dir, "region", form, codec)
        rows.append((form, archive.format, archive.compression))
    return spark.createDataFrame(rows, "wanted string, format string, compression string")


@query(f"SELECT kind AS desc_, section, CAST(priority AS INTEGER) AS priority, true AS known FROM {_TYPES_SQL} UNION ALL SELECT p_name, 'None', 0, false FROM part")
def q_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = objecttypes.table(spark).select("desc").union(_read(spark, sf_dir, "part").select("p_name"))
    d = F.col("desc")
    return names.select(d.alias("desc_"), objecttypes.section_of(d).alias("section"), objecttypes.priority_of(d).alias("priority"), objecttypes.is_known(d).alias("known"))


@query("""SELECT p_partkey, CASE p_size % 7 WHEN 2 THEN 'PreData' WHEN 3 THEN 'Data' WHEN 4 THEN 'PostData' ELSE 'None' END AS section,
CASE p_size % 7 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 4 THEN 4 ELSE 1 END AS back, CASE p_size % 7 WHEN 2 THEN 'Pre-Data' WHEN 3 THEN 'DATA' WHEN 4 THEN 'Post-Data' ELSE 'None' END AS shown FROM part""")
def q_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "part").select("p_partkey", objecttypes.section_from_int(F.col("p_size") % 7).alias("section"))
    return rows.select("*", objecttypes.section_to_int(F.col("section")).alias("back"), objecttypes.section_name(F.col("section")).alias("shown"))


@query("""SELECT p_partkey, ['Unknown', 'Custom', 'Files', 'Tar', 'Null', 'Directory'][p_size % 8 + 1] AS format, ['none', 'gzip', 'lz4', 'zstd'][p_size % 8 + 1] AS codec,
CASE p_size % 8 WHEN 1 THEN 'data' WHEN 3 THEN 'blobs' END AS block, CASE p_size % 8 WHEN 1 THEN 'NotSet' WHEN 2 THEN 'Set' WHEN 3 THEN 'NoData' END AS state FROM part""")
def q_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    byte, of = F.col("p_size") % 8, objecttypes.from_byte
    return _read(spark, sf_dir, "part").select(
        "p_partkey", of(byte, objecttypes.FORMATS).alias("format"), of(byte, objecttypes.CODECS).alias("codec"), of(byte, objecttypes.BLOCK_TYPES).alias("block"), of(byte, objecttypes.OFFSET_STATES).alias("state")
    )


_VERSION_SQL = "CASE WHEN n >= 1700 THEN 16 WHEN n >= 1600 THEN 15 WHEN n >= 1200 THEN 14 WHEN n >= 1003 THEN 13 WHEN n >= 900 THEN 12 END"


@query(f"""SELECT s_suppkey, server, coalesce(major, -1) AS major, coalesce(minor, -1) AS minor, coalesce({_VERSION_SQL}, -1) AS archive_minor, '1.' || {_VERSION_SQL} || '.0' AS version, s_suppkey % 20 BETWEEN 12 AND 16 AND NOT (s_suppkey % 20 = 16 AND s_suppkey % 3 > 0) AS supported
FROM (SELECT *, 100 * major + minor AS n FROM (SELECT s_suppkey, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey % 20 || 'beta1' WHEN 1 THEN s_suppkey % 20 || '.x' WHEN 2 THEN s_suppkey % 20 || '' ELSE s_suppkey % 20 || '.' || s_suppkey % 7 || '.1' END AS server,
CAST(CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 20 END AS INTEGER) AS major, CAST(CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 3 THEN s_suppkey % 7 ELSE 0 END AS INTEGER) AS minor FROM supplier))""")
def q_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    server = F.when(k % 4 == 0, F.concat(k % 20, F.lit("beta1"))).when(k % 4 == 1, F.concat(k % 20, F.lit(".x"))).when(k % 4 == 2, (k % 20).cast("string")).otherwise(F.concat(k % 20, F.lit("."), k % 7, F.lit(".1")))
    rows = _read(spark, sf_dir, "supplier").select(k, server.alias("server"))
    rows = rows.select("*", versions.server_major(F.col("server")).alias("major"), versions.server_minor(F.col("server")).alias("minor"))
    rows = rows.withColumn("archive_minor", versions.archive_minor(F.col("major"), F.col("minor")))
    version = F.when(F.col("archive_minor").isNotNull(), versions.text_of(F.lit(1), F.col("archive_minor"), F.lit(0)))
    rows = rows.select("*", version.alias("version"), versions.supported_of(F.lit(1), k % 20, k % 3).alias("supported"))
    return rows.fillna(-1, ["major", "minor", "archive_minor"])


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d FROM orders")
def q_civil(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "orders").select("o_orderkey", F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")).alias("n"))
    return rows.select("o_orderkey", dates.civil_from_days(F.col("n")).alias("c")).select("o_orderkey", F.col("c.year").alias("y"), F.col("c.month").alias("m"), F.col("c.day").alias("d"))


def _int_sql(n: str) -> str:
    return f"CASE WHEN {n} < 0 THEN '01' ELSE '00' END || " + " || ".join(f"printf('%02x', (abs({n}) >> {8 * i}) & 255)" for i in range(4))


_NUMBER = "(c_custkey * 104729 - 78000000)"


@query(f"SELECT c_custkey, {_NUMBER} AS n, {_int_sql(_NUMBER)} AS wire FROM customer")
def q_int_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.expr(_NUMBER)
    return _read(spark, sf_dir, "customer").select("c_custkey", n.alias("n"), wire.int_hex(n).alias("wire"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN p_name END AS back FROM part")
def q_str_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    written = F.when(F.col("p_partkey") % 3 == 0, "").otherwise(F.col("p_name"))
    return _read(spark, sf_dir, "part").select("p_partkey", wire.string_read(written).alias("back"))


@query("""SELECT n_name, c_mktsegment, count(*) AS n_orders, CAST(round(sum(CAST(o_totalprice AS DECIMAL(18, 2))), 2) AS DOUBLE) AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def q_ext_join_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spark's own joins and aggregates over three archives."""

    def table(name: str, form: str, codec: str) -> DataFrame:
        return _table(spark, sf_dir, name, form, codec).table("public", name, _read(spark, sf_dir, name).schema)

    orders, customer, nation = table("orders", "Custom", "none"), table("customer", "Directory", "zstd"), table("nation", "Custom", "gzip")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    revenue = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    return joined.groupBy("n_name", "c_mktsegment").agg(F.count("*").alias("n_orders"), revenue.alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity, max(l_shipdate) AS latest FROM lineitem GROUP BY ALL")
def q_scan_agg(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem", "Custom", "none").table("public", "lineitem", _read(spark, sf_dir, "lineitem").schema)
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.max("l_shipdate").alias("latest"))


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL")
def q_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: a table goes into an archive and comes back as typed rows."""
    rows = _table(spark, sf_dir, "nation", "Custom", "none").table("public", "nation", _read(spark, sf_dir, "nation").schema)
    return rows.groupBy("n_regionkey").agg(F.count("*").alias("n"))


@query(f"SELECT CAST(w AS INTEGER) AS wanted, kind AS desc_, tag FROM (VALUES (1), (4), (10), (14), (1000000), (-1)) v(w) LEFT JOIN {_ALL_SQL} a ON dump_id = w")
def q_get_entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids, rows = (1, 4, 10, 14, 10**6, -1), []
    found = _part_toc(spark, sf_dir).get_entries(ids)
    for wanted in ids:
        e = found.get(wanted)
        rows.append((wanted, e and e.desc, e and e.tag))
    return spark.createDataFrame(rows, "wanted int, desc_ string, tag string")


@query("SELECT 3 AS n_entries, true AS made_now")
def q_now(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{folder(spark)}/{uuid.uuid4().hex}"
    new("testdb").save(spark, path)
    info = Archive(spark, path).info()
    age = F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("created_at"))
    return info.select("n_entries", (age < 3600).alias("made_now"))


@query("""SELECT row_number() OVER (ORDER BY name <> 'toc.dat', name) - 1 AS pos, name FROM
(SELECT 'blob_' || (page_id + 1) || '.dat' AS name FROM pages UNION ALL VALUES ('toc.dat'), ('blobs_4.toc'))""")
def q_tar_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order of the files in a tar: the table of contents, then the others by name."""
    _objects("Tar", "none")(spark, sf_dir)
    archive = saved(spark, (sf_dir, "objects"), lambda: None, "Tar")
    return spark.createDataFrame([(i, name) for i, name in enumerate(members(archive.path))], "pos long, name string")


_ERRORS = {
    "no file": "ArchiveIOError",
    "junk": "InvalidHeader",
    "folder without toc.dat": "InvalidHeader",
    "cut short": "ArchiveIOError",
    "version": "UnsupportedVersion",
    "format": "UnsupportedFormat",
    "codec": "UnsupportedCompression",
    "block type": "DataIntegrity",
    "block of another entry": "DataIntegrity",
    "no entry": "EntityNotFound",
    "no payload": "NoData",
    "no such id": "InvalidDumpId",
    "payload for no such id": "InvalidDumpId",
    "compressed tar": "UnsupportedCompression",
    "codec of a later version": "UnsupportedCompression",
    "name that isn't UTF-8": "InvalidUtf8",
}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k.replace(chr(39), chr(39) * 2)}', '{v}')" for k, v in _ERRORS.items()) + ") t(what, error)")
def q_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What goes wrong with damaged archives and with questions that have no answer."""
    place = f"{folder(spark)}/{uuid.uuid4().hex}"
    b = with_table("t", spark.range(3)).add_entry("TABLE DATA", "public", "bare")
    b.save(spark, f"{place}/whole")
    archive = Archive(spark, f"{place}/whole")
    data = archive.lookup("TABLE DATA", "public", "t")
    file, _ = storage.open_file(archive.path)
    with file:
        raw = file.read()

    def damaged(at: int, *values: int):
        def attempt() -> None:
            path = f"{place}/{uuid.uuid4().hex}"
            with storage.create(path) as out:
                out.write(raw[:at] + bytes(values) + raw[at + len(values) :] if values else raw[:at])
            Archive(spark, path).table_data("public", "t")

        return attempt

    def folder_without() -> None:
        with storage.create(f"{place}/folder/other"):
            pass
        Archive(spark, f"{place}/folder")

    name = raw.index(b"testdb")
    attempts = [
        lambda: Archive(spark, f"{place}/nothing"), damaged(0, *b"junk!"), folder_without, damaged(200), damaged(6, 17), damaged(10, 9), damaged(11, 9),
        damaged(data.offset, 9), damaged(data.offset + 2, 77), lambda: archive.table_data("public", "x"), lambda: archive.table_data("public", "bare"),
        lambda: archive.entry_data(999), lambda: b.set_bytes(999, b""), lambda: b.with_format("Tar").with_compression("gzip").save(spark, f"{place}/t"),
        lambda: new("x", appear_as="15.0").with_compression("lz4").save(spark, f"{place}/t"), damaged(name, 0xFF),
    ]
    rows = []
    for what, attempt in zip(_ERRORS, attempts, strict=True):
        try:
            attempt()
            rows.append((what, None))
        except ArchiveError as e:
            rows.append((what, type(e).__name__))
    return spark.createDataFrame(rows, "what string, error string")
