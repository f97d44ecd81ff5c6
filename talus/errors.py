"""Deliberate errors; anything else that is raised is a defect."""


class TalusError(Exception):
    """Base of the errors that the command line reports without a traceback."""


class ConfigError(TalusError, ValueError):
    """A setting is unknown, missing or out of range."""


class InputDataError(TalusError, ValueError):
    """An input can't be used: missing, unreadable, empty or without a coordinate system."""


class MissingDependencyError(TalusError):
    """An optional package or codec is not installed."""


class DownloadError(TalusError):
    """A remote catalogue or file could not be fetched safely."""
