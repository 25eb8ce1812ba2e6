"""Error taxonomy: parse errors are ValueErrors, storage errors IOErrors, execution errors RuntimeErrors."""


class QueryParseError(ValueError):
    """The query text is not valid; ``position`` is a character offset into it."""

    def __init__(self, message: str, position: int):
        super().__init__(f"{message} at position {position}")
        self.message = message
        self.position = position


class UnexpectedToken(QueryParseError):
    """A token that the grammar does not allow here."""


class UnexpectedEnd(QueryParseError):
    """The query text ended too early."""


class StoreError(IOError):
    """The segment store cannot satisfy the request."""


class SymbolNotFound(StoreError):
    """No tick of that symbol was ever stored."""

    def __init__(self, symbol: str):
        super().__init__(f"symbol not found: {symbol}")
        self.symbol = symbol


class ReplicationError(RuntimeError):
    """The node's role forbids the operation."""
