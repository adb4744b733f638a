"""Cutting text at places where the byte-level pre-tokeniser always starts a new match.

A space or newline directly before a non-space character always starts a match of the public pattern: letters, digits and
marks never hold white space, and `\\s+(?!\\S)` gives back the last white-space character of a run. So what lies between
such places can be tokenised separately. Python counts a few more characters as white space than the pattern does, which only
makes fewer cuts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

CUT = re.compile(r"(?=[ \n]\S)")


def pieces(text: str) -> list[str]:
    """The text between all such places."""
    return CUT.split(text) if text else []


def segments(text: str | None, size: int = 1 << 20) -> Iterator[str]:
    """The text in segments of about `size` characters, which end at such places; one longer where there is none."""
    at, n = 0, len(text or "")
    while at < n:
        found = CUT.search(text, at + size) if n - at > size else None
        end = found.start() if found else n
        yield text[at:end]
        at = end
