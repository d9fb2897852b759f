"""The one error type: a stable code and a message."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, code: str, message: str = ""):
        super().__init__(f"{code}: {message}" if message else code)
        self.code = code
        self.message = message
