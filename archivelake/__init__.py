"""PostgreSQL dump archives as lazy Spark DataFrames, and DataFrames as dump archives."""

from .errors import ArchiveError
from .plans.archive import Archive, load
from .plans.builder import ArchiveBuilder, new

__all__ = ["Archive", "ArchiveBuilder", "ArchiveError", "load", "new"]
