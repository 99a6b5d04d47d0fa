"""A readable report of a profile."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import Path


def number(x: object) -> str:
    if x is None:
        return "–"
    if isinstance(x, bool):
        return "yes" if x else "no"
    if isinstance(x, int):
        return f"{x:,}"
    return f"{x:,.4f}".rstrip("0").rstrip(".") if isinstance(x, float) else str(x)


def table(rows: Sequence[Mapping[str, object]]) -> str:
    """Rows of a small result as a Markdown table."""
    if not rows:
        return "(no rows)"
    names = list(rows[0])
    lines = [names, ["---"] * len(names), *([number(r[n]).replace("|", "\\|").replace("\n", " ") for n in names] for r in rows)]
    return "\n".join("| " + " | ".join(line) + " |" for line in lines)


def markdown(title: str, parts: Mapping[str, Sequence[Mapping[str, object]]], source: str = "") -> str:
    """Title, source and a table per part."""
    head = f"# {title}\n" + (f"\nSource: `{source}`\n" if source else "")
    return head + "".join(f"\n## {name.replace('_', ' ').capitalize()}\n\n{table(rows)}\n" for name, rows in parts.items())


def write_report(path: str | Path, *arguments: object) -> None:
    target = Path(path)
    target.parent.mkdir(parents=True, exist_ok=True)
    target.write_text(markdown(*arguments), encoding="utf-8")
