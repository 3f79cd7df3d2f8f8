"""An archive as a handle on lazy DataFrames."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..errors import EntityNotFound, InvalidDumpId, NoData
from ..functions.copytext import typed
from ..functions.dates import created_at
from ..functions.objecttypes import section_of
from ..functions.wire import Entries, Entry, Toc
from ..sources import containers
from ..sources.datasource import register


def entry_of(row: Row) -> Entry:
    """An entry from a row of the relation toc."""
    values = row.asDict()
    values.pop("toc_pos")
    return Entry(**values | {"dependencies": tuple(values["dependencies"])})


def load(spark: SparkSession, path: str) -> Archive:
    """Opens an archive in any container; payloads are read when a query needs them."""
    return Archive(spark, path)


class Archive:
    """Relations of one archive.  Only its table of contents is read at once; of one of very many
    entries (``wire.BLOCK``), which tasks then read by blocks, only the places of the blocks."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        register(spark)
        self.spark, self.path = spark, path
        self.cores = spark.sparkContext.defaultParallelism
        self.container = containers.open_container(path, self.cores)

    # What the archive says about itself.

    @property
    def contents(self) -> Toc:
        return self.container.toc

    @property
    def entries(self) -> tuple[Entry, ...]:
        return self.contents.entries

    @property
    def version(self) -> tuple[int, int, int]:
        return self.contents.header.version

    @property
    def format(self) -> str:
        return self.contents.header.format

    @property
    def compression(self) -> str:
        return self.contents.header.compression

    @property
    def dbname(self) -> str:
        return self.contents.dbname

    @property
    def server_version(self) -> str:
        return self.contents.server_version

    @property
    def dump_version(self) -> str:
        return self.contents.dump_version

    @property
    def timestamp(self) -> dict[str, int]:
        return self.contents.timestamp

    def relation(self, name: str, dump_ids: list[int] | None = None) -> DataFrame:
        reader = self.spark.read.format("pgarchive").option("relation", name).option("cores", self.cores)
        if isinstance(self.entries, Entries):
            reader = reader.option("marks", ",".join(map(str, self.entries.marks)))
        if dump_ids is not None:
            reader = reader.option("dump_ids", ",".join(map(str, dump_ids)))
        return reader.load(self.path)

    def info(self) -> DataFrame:
        """One row: versions, sizes, codec, names, and when it was made."""
        return self.relation("archive").withColumn("created_at", created_at(F.col("timestamp")))

    def toc(self) -> DataFrame:
        """A row for each entry, in the order of the file, with the section its type implies."""
        return self.relation("toc").withColumn("computed_section", section_of(F.col("desc")))

    # Lookups.  Null namespaces and tags are never found.

    def lookup(self, desc: str, namespace: str, tag: str) -> Entry | None:
        """The first entry of that type, namespace and tag."""
        if isinstance(self.entries, Entries):
            same = [F.col(c).eqNullSafe(F.lit(v)) for c, v in (("desc", desc), ("namespace", namespace), ("tag", tag))]
            row = self.relation("toc").where(same[0] & same[1] & same[2]).orderBy("toc_pos").first()
            return row and entry_of(row)
        return next((e for e in self.entries if (e.desc, e.namespace, e.tag) == (desc, namespace, tag)), None)

    def get_entries(self, dump_ids: Iterable[int]) -> dict[int, Entry]:
        """The first entry of each of these ids that there is."""
        wanted = set(dump_ids)
        if isinstance(self.entries, Entries):
            rows = self.relation("toc").where(F.col("dump_id").isin(*wanted))
            firsts = rows.groupBy("dump_id").agg(F.min_by(F.struct(*rows.columns), "toc_pos").alias("row")).collect()
            return {r.dump_id: entry_of(r.row) for r in firsts}
        return {e.dump_id: e for e in reversed(self.entries) if e.dump_id in wanted}

    def get_entry(self, dump_id: int) -> Entry | None:
        return self.get_entries([dump_id]).get(dump_id)

    def lookup_rows(self, desc: str, namespace: str, tag: str) -> DataFrame:
        """``lookup`` as a DataFrame of no or one row."""
        found = self.toc().where((F.col("desc") == desc) & (F.col("namespace") == namespace) & (F.col("tag") == tag))
        return found.orderBy("toc_pos").limit(1)

    # Payloads.

    def _payload(self, namespace: str, table: str) -> Entry:
        found = self.lookup("TABLE DATA", namespace, table)
        if found is None:
            raise EntityNotFound(f"TABLE DATA {namespace}.{table}")
        if not self.container.has_data(found):
            raise NoData(f"TABLE DATA {namespace}.{table}")
        return found

    def table_data(self, namespace: str, table: str) -> DataFrame:
        """The lines of a table's payload as ``line``, but for empty ones and the end mark."""
        found = self._payload(namespace, table)
        return self.relation("table_lines", [found.dump_id]).where("line <> '' and line <> '\\\\.'").select("line")

    def numbered(self, namespace: str, table: str) -> DataFrame:
        """``table_data`` with ``line_no``, from 1 over the whole payload.

        A payload of several splits is counted first; only a count per split is moved.
        """
        found = self._payload(namespace, table)
        lines = self.relation("table_lines", [found.dump_id]).where("line <> '' and line <> '\\\\.'")
        if len(self.container.data([found])) == 1:
            return lines.select(F.row_number().over(Window.partitionBy("split").orderBy("pos")).cast("long").alias("line_no"), "line")
        counts = lines.groupBy("split").count()
        before = counts.select("split", (F.sum("count").over(Window.orderBy("split")) - F.col("count")).alias("before"))
        nth = F.row_number().over(Window.partitionBy("split").orderBy("pos"))
        # One row per split.
        return lines.withColumn("nth", nth).join(F.broadcast(before), "split").select((F.col("before") + F.col("nth")).alias("line_no"), "line")

    def table(self, namespace: str, table: str, schema: StructType | str) -> DataFrame:
        """A table's rows with the columns of ``schema``; empty lines are rows here."""
        found = self._payload(namespace, table)
        if isinstance(schema, str):
            schema = StructType.fromDDL(schema)
        lines = self.relation("table_lines", [found.dump_id]).where("line <> '\\\\.'")
        return lines.select(*typed(F.col("line"), schema))

    def entry_chunks(self, dump_id: int) -> DataFrame:
        """An entry's plain bytes in pieces: split, pos, data.  Every codec streams."""
        if self.get_entry(dump_id) is None:
            raise InvalidDumpId(str(dump_id))
        return self.relation("entry_chunks", [dump_id]).select("split", "pos", "data")

    def entry_data(self, dump_id: int) -> DataFrame:
        """An entry's plain bytes as one value ``data``, for payloads that fit in a row; no row without a payload."""
        chunks = self.entry_chunks(dump_id)
        found = F.expr("listagg(data, X'') WITHIN GROUP (ORDER BY split, pos)")
        has = self.container.has_data(self.get_entry(dump_id))
        return chunks.agg(F.coalesce(found, F.lit(b"")).alias("data")).where(F.lit(has))

    def blobs(self) -> DataFrame:
        """dump_id, blob_pos, oid and data of all large objects of entries that hold such, with the entry's place."""
        kinds = ("BLOBS", "BLOB")
        if isinstance(self.entries, Entries):
            held = [(r.toc_pos, r.dump_id) for r in self.relation("toc").where(F.col("desc").isin(*kinds)).select("toc_pos", "dump_id").orderBy("toc_pos").collect()]
        else:
            held = [(i, e.dump_id) for i, e in enumerate(self.entries) if e.desc in kinds]
        if not held:
            return self.relation("blobs", []).withColumn("toc_pos", F.lit(0))
        places = self.spark.createDataFrame(held, "toc_pos int, dump_id int").dropDuplicates(["dump_id"])
        return self.relation("blobs", [d for _, d in held]).join(F.broadcast(places), "dump_id")
