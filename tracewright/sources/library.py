"""Pattern files, and the patterns that come with the engine."""

from __future__ import annotations

from pathlib import Path

from ..plans.compiler import Pattern, load_pattern_file

SUFFIX = ".rcdsl"
SHIPPED = Path(__file__).resolve().parent.parent / "patterns"
EXAMPLES = SHIPPED / "examples"


class UsageError(ValueError):
    """Something that the user gave cannot be used."""


def pattern_files(path: str | Path) -> list[Path]:
    """A file itself, or a folder's pattern files by path (folders inside are not searched)."""
    path = Path(path)
    if path.is_dir():
        found = sorted(p for p in path.iterdir() if p.suffix == SUFFIX and p.is_file())
        if not found:
            raise UsageError(f"{path} holds no {SUFFIX} files")
        return found
    if not path.is_file():
        raise UsageError(f"{path} is neither a file nor a folder")
    return [path]


def load_patterns(path: str | Path = SHIPPED) -> list[Pattern]:
    return [load_pattern_file(p) for p in pattern_files(path)]
