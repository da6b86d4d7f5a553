"""What can go wrong, by kind."""


class TesseraError(Exception):
    """Any error of this package's own."""


class ConfigError(TesseraError, ValueError):
    """Settings that can't be used."""


class SourceError(TesseraError, OSError):
    """A source that can't be read."""


class RemoteError(TesseraError, RuntimeError):
    """A service that doesn't answer as it should."""
