"""Problems found in pattern text, with their place in it."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Span:
    start: int
    end: int

    def line_col(self, source: str) -> tuple[int, int]:
        """1-based line and column, in characters."""
        before = source[: self.start]
        return before.count("\n") + 1, len(before) - (before.rfind("\n") + 1) + 1


@dataclass(frozen=True)
class Diagnostic:
    severity: str  # "error" or "warning"
    span: Span
    construct: str
    reason: str
    suggestion: str | None = None

    def render(self, source: str) -> str:
        line, col = self.span.line_col(source)
        hint = f"\n  help: {self.suggestion}" if self.suggestion else ""
        return f"{line}:{col}: {self.severity}: {self.construct}: {self.reason}{hint}"


class PatternError(ValueError):
    """A pattern that cannot be used; `diagnostics` says why."""

    def __init__(self, diagnostics: list[Diagnostic], source: str = ""):
        self.diagnostics, self.source = diagnostics, source
        super().__init__("\n".join(d.render(source) for d in diagnostics))


def has_errors(diagnostics: list[Diagnostic]) -> bool:
    return any(d.severity == "error" for d in diagnostics)
