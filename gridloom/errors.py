"""What can go wrong, as exceptions whose messages users see."""

from __future__ import annotations


class SheetError(Exception):
    """Base of all errors of the engine."""


class ParseError(SheetError):
    """The input breaks the grammar at byte ``offset``."""

    def __init__(self, message: str, offset: int = 0):
        super().__init__(message)
        self.offset = offset

    def __reduce__(self):
        return type(self), (*self._args(), self.offset)

    def _args(self):
        return ()


class InvalidDelimiter(ParseError):
    def __init__(self, offset: int = 0):
        super().__init__("invalid delimiter", offset)


class FieldLimitExceeded(ParseError):
    def __init__(self, limit: int, offset: int = 0):
        super().__init__(f"record exceeds the configured {limit}-field limit", offset)
        self.limit = limit

    def _args(self):
        return (self.limit,)


class UnexpectedQuote(ParseError):
    def __init__(self, offset: int = 0):
        super().__init__(f"unexpected quote at byte {offset}", offset)


class UnexpectedAfterQuote(ParseError):
    def __init__(self, byte: int, offset: int = 0):
        super().__init__(f"unexpected byte 0x{byte:02x} after closing quote at byte {offset}", offset)
        self.byte = byte

    def _args(self):
        return (self.byte,)


class UnterminatedQuote(ParseError):
    def __init__(self, offset: int = 0):
        super().__init__(f"unterminated quoted field at byte {offset}", offset)


class ExpectedLfAfterCr(ParseError):
    def __init__(self, offset: int = 0):
        super().__init__(f"expected LF after CR at byte {offset}", offset)


class BootstrapLimitExceeded(SheetError):
    def __init__(self, limit: int, rows_found: int):
        super().__init__(f"found only {rows_found} rows within the {limit}-byte bootstrap limit")
        self.limit, self.rows_found = limit, rows_found


class RecordTooLarge(SheetError):
    def __init__(self, limit: int):
        super().__init__(f"record exceeds the configured {limit}-byte limit")
        self.limit = limit

    def __reduce__(self):
        return type(self), (self.limit,)


class RowNotIndexed(SheetError):
    def __init__(self, requested: int, available: int):
        super().__init__(f"row {requested} is not indexed yet ({available} rows available)")
        self.requested, self.available = requested, available


class MatchNotIndexed(SheetError):
    def __init__(self, requested: int, available: int):
        super().__init__(f"match {requested} is not indexed yet ({available} matches available)")
        self.requested, self.available = requested, available


class InvalidOption(SheetError):
    def __init__(self, what: str):
        super().__init__(f"invalid option: {what}")


class DestinationIsSource(SheetError):
    def __init__(self):
        super().__init__("export destination must differ from the source file")


class DestinationExists(SheetError):
    def __init__(self):
        super().__init__("export destination already exists")


class SourceChanged(SheetError):
    def __init__(self):
        super().__init__("source file changed since it was opened")


class InvalidData(SheetError):
    """An output that fails its verification."""


class OperationRefused(SheetError):
    """The operation would lose or ignore pending changes."""
