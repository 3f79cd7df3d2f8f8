"""What can go wrong with an archive."""


class ArchiveError(Exception):
    """Any failure of this package."""


class ArchiveIOError(ArchiveError, OSError):
    """A file can't be read or written, or ends too early."""


class InvalidHeader(ArchiveError):
    """The file isn't a dump archive."""


class UnsupportedVersion(ArchiveError):
    """The archive version lies outside 1.12.0 to 1.16.0."""


class UnsupportedFormat(ArchiveError):
    """The format byte is unknown."""


class UnsupportedCompression(ArchiveError):
    """The codec is unknown, or the container or version can't hold it."""


class EntityNotFound(ArchiveError):
    """No entry of that description, namespace and tag."""


class NoData(ArchiveError):
    """The entry exists but has no payload."""


class InvalidDumpId(ArchiveError):
    """No entry has that dump id."""


class DataIntegrity(ArchiveError):
    """The content contradicts itself."""


class StreamingNotSupported(ArchiveError):
    """Kept for callers that expect it; every codec is streamed here."""


class DecompressionError(ArchiveError):
    """A payload doesn't decompress."""


class InvalidUtf8(ArchiveError):
    """A string isn't UTF-8."""
