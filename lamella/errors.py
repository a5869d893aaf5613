"""What can go wrong with schemas and blobs. Errors in tasks carry the class name in their message."""

from __future__ import annotations


class LamellaError(Exception):
    """Base of all errors of this library."""


class Untraceable(LamellaError):
    """No schema can be inferred from this type."""


class DepthLimitExceeded(LamellaError):
    def __init__(self) -> None:
        super().__init__("schemas nest at most 256 deep; recursive types have none")


class SchemaMismatch(LamellaError):
    """A value or a schema is not what the other side calls for."""

    def __init__(self, expected: str, found: str, path: str = ""):
        self.expected, self.found, self.path = expected, found, path
        super().__init__(f"{path + ': ' if path else ''}expected {expected}, found {found}")


class UnexpectedEof(LamellaError):
    def __init__(self) -> None:
        super().__init__("UnexpectedEof: the input ends before its value does")


class TrailingBytes(LamellaError):
    def __init__(self) -> None:
        super().__init__("TrailingBytes: the input goes on after its value")


class InvalidUtf8(LamellaError):
    def __init__(self) -> None:
        super().__init__("InvalidUtf8: a string column holds other bytes")


class InvalidVarint(LamellaError):
    def __init__(self) -> None:
        super().__init__("InvalidVarint: a number is cut off, not in its shortest form, or beyond 64 bits")


class LimitExceeded(LamellaError):
    """A count claims more than the bytes at hand can hold."""

    def __init__(self, what: str, claimed: int, limit: int):
        self.what, self.claimed, self.limit = what, claimed, limit
        super().__init__(f"LimitExceeded: {what} of {claimed}, where at most {limit} can follow")


class UnsupportedVersion(LamellaError):
    def __init__(self, what: str, found: int, supported: int):
        self.what, self.found, self.supported = what, found, supported
        super().__init__(f"UnsupportedVersion: {what} version {found}; versions up to {supported} are known")


class InvalidTag(LamellaError):
    def __init__(self, what: str, value: int):
        self.what, self.value = what, value
        super().__init__(f"InvalidTag: {what} {value}")


class IncompleteRow(LamellaError):
    """A row lacks a value that its schema requires."""


class Unsupported(LamellaError):
    """A type or option that the format has no place for."""


class Malformed(LamellaError):
    """The input is not built as its format says."""
