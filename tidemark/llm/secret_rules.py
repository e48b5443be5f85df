"""The fixed secret patterns and the spans they give, in code points."""

from __future__ import annotations

import re

# Fixed patterns: kind, pattern, the group whose length counts, and the least length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# A run that is too short holds no longer one, so the least length may stand in the pattern.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
ASSIGN_LEAST = 12
KINDS = ("assign", "access", "hex")
_TRIGGERS = ("passw", "secret", "token", "api")

Span = tuple[int, int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind's number, end, start of the secret itself), by start and kind."""
    found = []
    folded = text.lower()
    if any(trigger in folded for trigger in _TRIGGERS):
        found += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(found)


def shown(spans: list[tuple[int, int, int]], kinds: tuple[str, ...]) -> str:
    return ",".join(f"{kinds[kind]}:{start}:{end}" for start, kind, end in spans)
