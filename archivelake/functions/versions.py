"""Archive versions: as tuples on the driver, as expressions on columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

Version = tuple[int, int, int]

# Fixed values of the archive format: the versions that are read and written, and
# the archive version of server versions from (100 * major + minor) on.
OLDEST: Version = (1, 12, 0)
NEWEST: Version = (1, 16, 0)
FROM_SERVER = [(900, 12), (1003, 13), (1200, 14), (1600, 15), (1700, 16)]


def text(version: Version) -> str:
    return ".".join(map(str, version))


def supported(version: Version) -> bool:
    return OLDEST <= version <= NEWEST


def parse_server(version: str) -> tuple[int, int] | None:
    """(major, minor) of a server version; None unless its first part is a number, minor 0 unless the second is."""
    parts = version.split(".")
    if not re.fullmatch(r"\+?[0-9]+", parts[0]):
        return None
    return int(parts[0]), int(parts[1]) if len(parts) > 1 and re.fullmatch(r"\+?[0-9]+", parts[1]) else 0


def from_server(major: int, minor: int) -> Version | None:
    """The archive version that a server version writes; None before 9.0."""
    found = [m for least, m in FROM_SERVER if 100 * major + minor >= least]
    return (1, found[-1], 0) if found else None


def text_of(major: Column, minor: Column, rev: Column) -> Column:
    return F.concat_ws(".", major, minor, rev)


def supported_of(major: Column, minor: Column, rev: Column) -> Column:
    version = F.struct(major.cast("int").alias("a"), minor.cast("int").alias("b"), rev.cast("int").alias("c"))

    def at(v: Version) -> Column:
        return F.struct(*[F.lit(x).alias(n) for x, n in zip(v, "abc", strict=True)])

    return (version >= at(OLDEST)) & (version <= at(NEWEST))


def server_major(version: Column) -> Column:
    """The first part as a number, null if it isn't one."""
    return F.get(F.split(version, "[.]"), F.lit(0)).try_cast("int")


def server_minor(version: Column) -> Column:
    """The second part as a number; 0 if it isn't one, null if the first isn't."""
    minor = F.coalesce(F.get(F.split(version, "[.]"), F.lit(1)).try_cast("int"), F.lit(0))
    return F.when(server_major(version).isNotNull(), minor)


def archive_minor(major: Column, minor: Column) -> Column:
    """The minor number of the archive version of a server version, null before 9.0."""
    number, out = 100 * major + minor, F.lit(None).cast("int")
    for least, archive in FROM_SERVER:
        out = F.when(number >= least, archive).otherwise(out)
    return out
