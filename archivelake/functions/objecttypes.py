"""Object types of a table of contents: restore section and sort priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the archive format: type, section, priority.
OBJECT_TYPES = """
ENCODING|PreData|1
SEARCHPATH|PreData|1
STDSTRINGS|PreData|1
DATABASE|PreData|2
DATABASE PROPERTIES|PreData|2
SCHEMA|PreData|3
PROCEDURAL LANGUAGE|PreData|4
COLLATION|PreData|5
TRANSFORM|PreData|6
EXTENSION|PreData|7
DOMAIN|PreData|8
SHELL TYPE|PreData|8
TYPE|PreData|8
CAST|PreData|9
FUNCTION|PreData|10
PROCEDURE|PreData|10
AGGREGATE|PreData|11
ACCESS METHOD|PreData|12
OPERATOR|PreData|13
OPERATOR CLASS|PreData|14
OPERATOR FAMILY|PreData|14
CONVERSION|PreData|15
TEXT SEARCH PARSER|PreData|16
TEXT SEARCH TEMPLATE|PreData|17
TEXT SEARCH DICTIONARY|PreData|18
TEXT SEARCH CONFIGURATION|PreData|19
FOREIGN DATA WRAPPER|PreData|20
FOREIGN SERVER|None|21
SERVER|PreData|21
FOREIGN TABLE|PreData|22
SEQUENCE|PreData|22
TABLE|PreData|22
VIEW|PreData|22
TABLE ATTACH|PostData|23
DEFAULT|PreData|24
SEQUENCE OWNED BY|PreData|24
TABLE DATA|Data|25
SEQUENCE SET|Data|26
BLOB|PreData|27
BLOB METADATA|PreData|27
LARGE OBJECT|None|27
pg_largeobject_metadata|PreData|27
BLOBS|Data|28
pg_largeobject|PreData|28
STATISTICS DATA|PostData|29
CHECK CONSTRAINT|PostData|30
CONSTRAINT|PostData|30
INDEX|PostData|31
INDEX ATTACH|PostData|32
STATISTICS|PostData|33
RULE|PostData|34
TRIGGER|PostData|35
FK CONSTRAINT|PostData|36
POLICY|PostData|37
ROW SECURITY|PostData|37
PUBLICATION|PostData|38
PUBLICATION TABLE|PostData|39
PUBLICATION TABLES IN SCHEMA|PostData|40
SUBSCRIPTION|PreData|41
SUBSCRIPTION TABLE|PostData|42
DEFAULT ACL|PostData|43
MATERIALIZED VIEW|PostData|44
MATERIALIZED VIEW DATA|PostData|45
EVENT TRIGGER|PostData|46
ACL|None|47
COMMENT|None|47
SECURITY LABEL|None|47
GROUP|None|48
ROLE|None|48
TABLESPACE|PreData|48
USER|None|48
USER MAPPING|PreData|48
"""

# How sections are shown; their numbers on the wire are 1 to 4 in this order.
SECTION_NAMES = {"None": "None", "PreData": "Pre-Data", "Data": "DATA", "PostData": "Post-Data"}
SECTIONS = list(SECTION_NAMES)

_KNOWN = {name: (section, int(priority)) for name, section, priority in (line.split("|") for line in OBJECT_TYPES.split("\n") if line)}


def section(desc: str) -> str:
    """The section of a type; None for one that isn't known."""
    return _KNOWN.get(desc, ("None", 0))[0]


def priority(desc: str) -> int:
    """The sort priority of a type; 0, hence first, for one that isn't known."""
    return _KNOWN.get(desc, ("None", 0))[1]


def table(spark: SparkSession) -> DataFrame:
    """All known types: desc, section, priority."""
    return spark.createDataFrame([(k, *v) for k, v in _KNOWN.items()], "desc string, section string, priority int")


def _lookup(desc: Column, values: dict) -> Column:
    pairs = [F.lit(x) for item in values.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), desc)


def section_of(desc: Column) -> Column:
    return F.coalesce(_lookup(desc, {k: s for k, (s, _) in _KNOWN.items()}), F.lit("None"))


def priority_of(desc: Column) -> Column:
    return F.coalesce(_lookup(desc, {k: p for k, (_, p) in _KNOWN.items()}), F.lit(0))


def is_known(desc: Column) -> Column:
    return F.coalesce(desc.isin(*_KNOWN), F.lit(False))


def section_name(name: Column) -> Column:
    """How a section is shown."""
    return _lookup(name, SECTION_NAMES)


def section_from_int(number: Column) -> Column:
    """1 to 4 by name, None for any other number."""
    return F.coalesce(_lookup(number, {i + 1: s for i, s in enumerate(SECTIONS)}), F.lit("None"))


def section_to_int(name: Column) -> Column:
    return _lookup(name, {s: i + 1 for i, s in enumerate(SECTIONS)})


# Bytes of the wire format and how they are shown.
FORMATS = {0: "Unknown", 1: "Custom", 2: "Files", 3: "Tar", 4: "Null", 5: "Directory"}
CODECS = {0: "none", 1: "gzip", 2: "lz4", 3: "zstd"}
BLOCK_TYPES = {1: "data", 3: "blobs"}
OFFSET_STATES = {1: "NotSet", 2: "Set", 3: "NoData"}


def from_byte(number: Column, values: dict[int, str]) -> Column:
    """The name of a wire byte, null if it is none of ``values``."""
    return _lookup(number, values)
