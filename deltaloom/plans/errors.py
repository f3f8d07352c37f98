"""Errors of the dialect. Their texts are part of its behaviour."""

from __future__ import annotations


class DialectError(ValueError):
    """typed: stands by itself, without the prefix of parse errors."""

    typed = True


class UnsupportedSQL(DialectError):
    def __init__(self, text: str, typed: bool = False):
        super().__init__(text if typed else f"unsupported SQL: {text}")
        self.typed = typed


class UnexpectedType(DialectError):
    def __init__(self, expected: str, inferred: str):
        super().__init__(f"Unexpected type: (expected) {expected} != {inferred} (inferred)")


class InvalidLiteral(DialectError):
    def __init__(self, literal: str, kind: str):
        super().__init__(f"The literal expression `{literal}` cannot be parsed as type `{kind}`")


class DuplicateName(DialectError):
    def __init__(self, name: str):
        super().__init__(f"Duplicate name `{name}`")


class Unresolved(DialectError):
    def __init__(self, name: str):
        super().__init__(f"`{name}` is not in scope")


class InvalidOperator(DialectError):
    def __init__(self, op: str, kind: str):
        super().__init__(f"Invalid binary operator `{op}` for type `{kind}`")


class UnsupportedSelect(DialectError):
    def __init__(self, sql: str, subscribing: bool = False):
        super().__init__(f"Unsupported{' SELECT' if subscribing else ''}: {sql}")


class UnsupportedFeature(DialectError):
    def __init__(self, sql: str):
        super().__init__(f"Unsupported: {sql}")


class UnqualifiedNames(DialectError):
    def __init__(self):
        super().__init__("Names must be qualified when using joins")


class UnsupportedJoin(DialectError):
    def __init__(self):
        super().__init__("Non-inner joins are not supported")


class NoSuchTable(DialectError):
    def __init__(self, name: str):
        super().__init__(f"no such table: `{name}`. If the table exists, it may be marked private.")


class PlanError(DialectError):
    """A shape that parses but has no meaning."""


class LimitExceeded(RuntimeError):
    """A result or the work for it is over a host's limit; results are never cut to fit."""


class KindError(ValueError):
    """A value that its column's kind does not have."""


class ConstraintError(ValueError):
    """A row that a table's constraints refuse."""


def explain_error_text(error: Exception, sql: str, subscribing: bool = False) -> str:
    """The text a caller sees."""
    text = str(error) if getattr(error, "typed", False) else f"parse: {error}"
    return f"{text}, executing: `{sql}`" if subscribing else text
