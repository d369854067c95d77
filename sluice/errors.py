"""Errors that the engine raises; Spark's own analysis errors pass through unchanged."""


class EngineError(Exception):
    """Any error of the engine."""


class TableNotFound(EngineError):
    pass


class TableExists(EngineError):
    pass


class ColumnNotFound(EngineError):
    pass


class ColumnExists(EngineError):
    pass


class IndexNotFound(EngineError):
    pass


class IndexExists(EngineError):
    pass


class SqlSyntax(EngineError):
    """A statement that the facade handles itself and cannot read."""


class ParameterError(EngineError):
    pass


class NoRows(EngineError):
    pass


class TooManyRows(EngineError):
    pass


class TypeMismatch(EngineError):
    pass


class DuplicateName(EngineError):
    """A function, trigger or job of that name exists."""


class NotRegistered(EngineError):
    pass


class ArgumentError(EngineError):
    pass


class TransactionClosed(EngineError):
    pass


class VersionNotFound(EngineError):
    pass


class ManifestConflict(EngineError):
    """Another writer committed in between."""
