"""Tables of contents of archives as they arrive in a folder.

A stream sees each file once; only the table of contents of a custom archive is
decoded, from the start of the file.  A file that isn't an archive gives one row
with its error, so that the stream goes on.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArchiveError
from ..functions.wire import read_toc

COLUMNS = "path string, modified timestamp, dbname string, dump_id int, desc string, namespace string, tag string, error string"


def arriving(spark: SparkSession, folder: str, pattern: str = "*", most: int = 64) -> DataFrame:
    """A stream of the entries of custom archives of ``folder``, ``most`` new files at a time."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).option("maxFilesPerTrigger", most).load(folder)

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, modified, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                try:
                    toc = read_toc(io.BytesIO(content), len(content), with_file=False)
                    rows += [(path, modified, toc.dbname, e.dump_id, e.desc, e.namespace, e.tag, None) for e in toc.entries]
                except ArchiveError as e:
                    rows.append((path, modified, None, None, None, None, None, f"{type(e).__name__}: {e}"))
            kinds = [pa.string(), batch.schema.field(1).type, pa.string(), pa.int32(), *[pa.string()] * 4]
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return files.select(F.col("path"), F.col("modificationTime"), "content").mapInArrow(listed, COLUMNS)
