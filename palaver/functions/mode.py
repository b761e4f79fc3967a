"""How a search runs: by words, by meaning, by both, or by the quoted text alone."""

from __future__ import annotations

from palaver.functions.query import parse

MODES = ("lexical", "semantic", "hybrid", "exact")


def effective(text: str, asked: str | None = None, configured: str | None = None, semantic: bool | None = None) -> str:
    """Nothing but quoted text is exact; else what was asked for, then what is configured, then the older switch, then lexical."""
    q = parse(text)
    if q.literals and not q.words:
        return "exact"
    older = None if semantic is None else ("semantic" if semantic else "lexical")
    mode = asked or configured or older or MODES[0]
    if mode not in MODES:
        raise ValueError(f"no search mode {mode!r}")
    return mode
