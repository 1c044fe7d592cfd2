"""Typed failures, raised by single-file helpers and carried as a status column by tables."""

from __future__ import annotations


class PdfError(Exception):
    """Root of all failures. ``fields`` are what the class adds (limit, object, argument)."""

    kind = "error"

    def __init__(self, message: str, **fields):
        super().__init__(message)
        self.fields = fields


class InvalidArgument(PdfError):
    kind = "invalid_argument"


class ParseError(PdfError):
    kind = "parse_error"


class PasswordError(PdfError):
    kind = "password_error"


class LimitError(PdfError):
    kind = "limit_error"

    def __init__(self, limit: str, value: float, cycle: bool = False):
        super().__init__(f"more than {value:g} allowed by {limit}" + (" (a cycle)" if cycle else ""), limit=limit, limit_value=float(value), cycle=cycle)


class UnsupportedInput(PdfError):
    kind = "unsupported_input"


class WriteError(PdfError):
    kind = "write_error"


class FontError(PdfError):
    kind = "font_error"


class IoError(PdfError):
    kind = "io_error"


class PdfWarning(UserWarning):
    """One a call, with the number of warnings and the first one's text."""


STATUS = "struct<status:string,class:string,message:string,nwarning:int,warning:string,limit:string,limit_value:double>"


def status(error: Exception | None = None, warnings: list[str] | tuple = ()) -> dict:
    fields = getattr(error, "fields", {})
    return {"status": "error" if error else "warning" if warnings else "ok", "class": getattr(error, "kind", "parse_error") if error else None, "message": str(error) if error else None, "nwarning": len(warnings), "warning": warnings[0] if warnings else None, "limit": fields.get("limit"), "limit_value": fields.get("limit_value")}
