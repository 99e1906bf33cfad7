"""Runs of bytes in texts of any length, some at a time."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of a text that are looked through at a time.
STEP = 1 << 20

_lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def lower(text: bytes) -> bytes:
    """``text`` (UTF-8) with A-Z as a-z and nothing else changed."""
    return text.translate(_lower)


def runs(text: bytes, pattern: re.Pattern[bytes], border: re.Pattern[bytes], step: int = STEP) -> Iterator[list[bytes]]:
    """What ``pattern`` finds in ``text``, in lists of those from about ``step`` bytes each.

    ``border`` matches single bytes that no run holds; the text is cut behind them, so no run is.
    """
    at = 0
    while at < len(text):
        cut = border.search(text, at + step) if at + step < len(text) else None
        end = cut.end() if cut else len(text)
        yield pattern.findall(text, at, end)
        at = end
