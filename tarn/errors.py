"""Errors that the engine raises itself."""


class EngineError(Exception):
    """Anything the engine refuses to do at run time."""


class ParseError(EngineError):
    """SQL text outside the accepted grammar."""


class AnalysisError(EngineError):
    """Names or types that do not fit the schema."""


class TransactionAborted(EngineError):
    """A transaction that conflicts with one committed since it began."""
