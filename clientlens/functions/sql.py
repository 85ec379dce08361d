"""Values and names as SQL text, for the few expressions that are written as such."""

from __future__ import annotations

from collections.abc import Iterable


def ids(values: Iterable[int]) -> str:
    """A list of numbers; anything that is not a number is refused."""
    return ", ".join(str(int(v)) for v in values)


def text(value: str) -> str:
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def name(column: str) -> str:
    escaped = column.replace("`", "``")
    return f"`{escaped}`"
