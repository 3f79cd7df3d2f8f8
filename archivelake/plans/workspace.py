"""Where queries put the archives that they write and read again."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .archive import Archive
from .builder import ArchiveBuilder, new

_BASE: dict[str, str] = {}
_SAVED: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """A folder of this process, below the shared one that the session names, or a temporary one where it names none."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if (key := shared or "") not in _BASE:
        if shared:
            _BASE[key] = f"{shared.rstrip('/')}/archives-{uuid.uuid4().hex}"
        else:
            _BASE[key] = tempfile.mkdtemp(prefix="archives-")
            atexit.register(shutil.rmtree, _BASE[key], ignore_errors=True)
    return _BASE[key]


def saved(spark: SparkSession, key: tuple, build, form: str = "Custom", codec: str = "none") -> Archive:
    """The archive that ``build()`` gives, written once for each key, format and codec."""
    place = (folder(spark), *key, form, codec)
    if place not in _SAVED:
        path = f"{place[0]}/{uuid.uuid4().hex}"
        build().with_format(form).with_compression(codec).save(spark, path)
        _SAVED[place] = path
    return Archive(spark, _SAVED[place])


def with_table(name: str, rows: DataFrame, builder: ArchiveBuilder | None = None) -> ArchiveBuilder:
    """A builder with a table, its definition and its rows."""
    columns = ", ".join(f'"{f.name}" {f.dataType.simpleString()}' for f in rows.schema.fields)
    b = (builder or new("testdb")).add_entry("TABLE", "public", name, "postgres", f"CREATE TABLE public.{name} ({columns});\n", f"DROP TABLE public.{name};\n")
    table_id = b.last_id
    names = ", ".join(rows.columns)
    b = b.add_entry("TABLE DATA", "public", name, "postgres", copy_stmt=f"COPY public.{name} ({names}) FROM stdin;\n", dependencies=[table_id])
    return b.set_table(b.last_id, rows)
