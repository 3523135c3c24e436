"""The library's log: one handler, which Python's warnings may share."""

from __future__ import annotations

import logging
import warnings
from typing import IO

NAME = "cavitas"
FORMAT = "CAVITAS %(levelname)s | %(message)s"


def level_of(level: int | str) -> int:
    """A level from its number or name, in either case; of an unknown name, that of warnings."""
    return level if isinstance(level, int) else logging.getLevelNamesMapping().get(str(level).upper(), logging.WARNING)


def start_log(level: int | str = "WARNING", stream: IO | None = None, capture_warnings: bool = True, short_warnings: bool = True) -> logging.Logger:
    """Sets the level of the library's log and gives it; a second call changes the level and adds no handler.

    ``stream`` (standard error) holds from the first call on. Warnings go the same way if captured; short ones have
    their kind and text only, without file and line.
    """
    log = logging.getLogger(NAME)
    log.setLevel(level_of(level))
    log.propagate = False
    handler = next((h for h in log.handlers if isinstance(h, logging.StreamHandler)), None)
    if handler is None:
        handler = logging.StreamHandler(stream)
        handler.setFormatter(logging.Formatter(FORMAT))
        log.addHandler(handler)
    if capture_warnings:
        if short_warnings:
            warnings.formatwarning = lambda message, category, *_, **__: f"{category.__name__}: {message}"
        logging.captureWarnings(True)
        other = logging.getLogger("py.warnings")
        other.setLevel(log.level)
        other.handlers[:] = [handler]
        other.propagate = False
    return log
