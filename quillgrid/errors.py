"""Errors raised on the driver before a job starts, with a short code and a reason."""

from __future__ import annotations


class QueryError(ValueError):
    def __init__(self, error: str, reason: str = "", status: int = 400):
        super().__init__(f"{error}: {reason}" if reason else error)
        self.error, self.reason, self.status = error, reason, status


class SelectorError(QueryError):
    """A selector that can't be compiled."""


class Conflict(QueryError):
    def __init__(self, reason: str = "Document update conflict."):
        super().__init__("conflict", reason, 409)


class NotFound(QueryError):
    def __init__(self, reason: str = "missing"):
        super().__init__("not_found", reason, 404)
