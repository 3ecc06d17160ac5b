"""The one error type; its code is part of the interface."""

from __future__ import annotations

from typing import Any

PREFIX = "ROWLOOM_"


class EngineError(Exception):
    """``code`` is PREFIX and a suffix such as INVALID_LIMIT; ``details`` is a dict or None."""

    name = "EngineError"

    def __init__(self, suffix: str, message: str, details: dict[str, Any] | None = None) -> None:
        super().__init__(message)
        self.code, self.message, self.details = PREFIX + suffix, message, details
