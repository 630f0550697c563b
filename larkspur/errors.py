"""Errors raised by the SQL front end and the catalog."""


class EngineError(Exception):
    """Base class of every error that a statement can raise."""


class ParseError(EngineError):
    """The text is not a statement of the grammar."""


class UnsupportedError(EngineError):
    """The text is SQL, but asks for something that this engine would not honour."""


class ColumnNotFoundError(EngineError):
    def __init__(self, name: str):
        super().__init__(f"column not found: {name}")
        self.name = name


class MissingColumnError(EngineError):
    """An INSERT column list leaves out a column of the table."""

    def __init__(self, name: str):
        super().__init__(f"missing column: {name}")
        self.name = name


class TypeMismatchError(EngineError):
    """Operand or value types do not fit; there are no implicit casts."""


class ColumnCountMismatchError(EngineError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"expected {expected} values, got {actual}")
        self.expected, self.actual = expected, actual


class TableNotFoundError(EngineError):
    def __init__(self, name: str):
        super().__init__(f"table not found: {name}")
        self.name = name


class TableAlreadyExistsError(EngineError):
    """Raised for an existing table, and for an existing index of that name."""

    def __init__(self, name: str):
        super().__init__(f"already exists: {name}")
        self.name = name


class ConcurrentChangeError(EngineError):
    """Another engine has changed the data folder since this one read it; nothing of the statement took effect."""
