"""Errors of queries."""


class CypherError(ValueError):
    """A query that cannot be run as written."""


class CypherSyntaxError(CypherError):
    """Text that is no query."""


class CypherTypeError(CypherError):
    """Operands of kinds that an operator doesn't take."""
