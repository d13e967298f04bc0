"""Exceptions of this library."""


class TidemarkError(Exception):
    """Any failure that this library raises itself."""


class ConflictError(TidemarkError):
    """Another writer has published the version first."""


class MetadataError(TidemarkError):
    """A snapshot or version pointer can't be read."""


class SchemaError(TidemarkError):
    """A schema or projection isn't valid."""


class TimeError(TidemarkError):
    """A text isn't an RFC 3339 instant."""


class VersionClauseError(TidemarkError):
    """A version clause of a statement isn't supported."""
