"""Messages of the engine. They go to one backend, a function of a message; as long as none is set they are dropped."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime

#: How levels are shown (fixed values).
LEVELS = {"debug": "[DBG]", "info": "[INF]", "warning": "[WRN]"}


@dataclass(frozen=True)
class Message:
    time: datetime
    level: str
    text: str

    def __str__(self) -> str:
        return f"{self.time:%H:%M:%S}.{self.time.microsecond // 1000:03d} {LEVELS[self.level]} {self.text}"


_backend: Callable[[Message], None] | None = None


def use(backend: Callable[[Message], None] | None) -> None:
    global _backend
    _backend = backend


def _log(level: str, text: str) -> None:
    if _backend is not None:
        _backend(Message(datetime.now(), level, text))


def debug(text: str) -> None:
    _log("debug", text)


def info(text: str) -> None:
    _log("info", text)


def warning(text: str) -> None:
    _log("warning", text)
