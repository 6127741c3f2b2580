class QueryError(Exception):
    """Any failure of a query that is the query's own."""


class ParseError(QueryError):
    pass


class UnsupportedError(QueryError):
    pass


class QueryTimeout(QueryError):
    pass


class Busy(Exception):
    """No room for a query within the time that it may wait."""
