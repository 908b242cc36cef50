"""SQL identifier guard."""

from __future__ import annotations

import re

from strata.contracts import IDENTIFIER_PATTERN


class BadIdentifier(ValueError):
    pass


_WHOLE = re.compile(IDENTIFIER_PATTERN.rstrip("$"))


def plain_identifier(text: str, role: str = "identifier") -> str:
    """``text`` itself when all of it, a trailing newline included, may stand
    unquoted in SQL."""
    if text and _WHOLE.fullmatch(text):
        return text
    raise BadIdentifier(f"not usable unquoted as {role}: {text!r}")
