"""What can go wrong before any job runs."""


class SqlCompileError(ValueError):
    """A statement or plan outside the subset, or that doesn't fit the catalog."""

    def __init__(self, message: str, position: int | None = None):
        super().__init__(message if position is None else f"{message} (at position {position})")
        self.position = position


class CatalogError(ValueError):
    """A name or id that is taken or unknown, or rows that don't fit their table."""


class FormatError(ValueError):
    """Bytes or documents that aren't in the expected format."""
