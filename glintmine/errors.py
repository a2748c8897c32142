"""Errors that a caller can act on: a code, an exit status, a next step, candidates and whether to try again."""

from __future__ import annotations

import json

# Codes and the exit statuses that scripts rely on.
EXIT = {"USAGE_ERROR": 64, "INTERNAL": 70, "CANT_CREAT": 73, "IO_ERROR": 74, "TEMP_FAILURE": 75, "UNKNOWN": 104}


class EngineError(Exception):
    code, next_step, retryable = "UNKNOWN", None, False

    def __init__(self, message: str, next_step: str | None = None, candidates: list[str] | None = None):
        super().__init__(message)
        self.next_step = next_step or type(self).next_step
        self.candidates = candidates or []

    @property
    def exit_code(self) -> int:
        return EXIT[self.code]

    def envelope(self) -> str:
        """One line of JSON; what is not there is left out."""
        told = {"code": self.code, "message": str(self)}
        if self.next_step:
            told["next_step"] = self.next_step
        if self.candidates:
            told["candidates"] = self.candidates
        return json.dumps({"error": {**told, "retryable": self.retryable}}, ensure_ascii=False, separators=(",", ":"))


class InvalidInput(EngineError, ValueError):
    code = "USAGE_ERROR"


class InternalError(EngineError):
    code, next_step = "INTERNAL", "report the command that failed, with its output"


class StoreError(EngineError):
    code, next_step = "CANT_CREAT", "check the index folder's permissions and disk space"


class SchemaMismatch(StoreError):
    next_step = "rebuild the index"


class IndexFailure(EngineError):
    code, next_step = "CANT_CREAT", "rebuild the index"


class InputOutput(EngineError):
    code = "IO_ERROR"


class EmbedderUnavailable(EngineError):
    code, next_step, retryable = "TEMP_FAILURE", "install the embedding model", True
