"""What is raised on the driver before a job starts."""

from __future__ import annotations


class TidefoldError(Exception):
    """Any of the below."""


class ConfigError(TidefoldError, ValueError):
    """A setting that no model takes, or out of its range."""


class FormatError(TidefoldError, ValueError):
    """A file or blob that is not what it should be."""


class NotFitted(TidefoldError, RuntimeError):
    """A model is asked before it has learned."""
