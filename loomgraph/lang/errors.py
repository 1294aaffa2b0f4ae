"""Errors of the query language."""


class QueryError(Exception):
    """Any error that a query's text or data causes."""


class ParseError(QueryError):
    """The text is not a query; line and column count from 1."""

    def __init__(self, message: str, line: int, column: int):
        super().__init__(f"{message} at {line}:{column}")
        self.line, self.column = line, column


class SemanticError(QueryError):
    """The query names or combines things that don't fit together."""


class TypeMismatch(SemanticError):
    """An operator got operands of types it does not compare or compute."""


class ExecutionError(QueryError):
    """The data does not allow what the query asks for."""
