"""Report sinks: one JSON document with stable keys, and Markdown tables. Reports are aggregates, small by nature."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable, Sequence
from pathlib import Path

from pyspark.sql import DataFrame

MOST_ROWS = 100_000


def plain(value):
    """Rows, maps and arrays as plain JSON values; numbers that aren't finite are null."""
    if hasattr(value, "asDict"):
        value = value.asDict()
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    return value if isinstance(value, (str, int, float, bool, type(None))) else str(value)


def rows_of(df: DataFrame, order: Sequence[str], most: int = MOST_ROWS) -> list[dict]:
    """The rows of a report in a stated order; a table that isn't small is an error."""
    got = df.orderBy(*order).limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"a report of more than {most} rows: write it as a table")
    return [plain(r) for r in got]


def nested(rows: Iterable[dict], keys: Sequence[str]) -> dict:
    """Rows as maps inside maps by keys."""
    out: dict = {}
    for row in rows:
        at = out
        for k in keys[:-1]:
            at = at.setdefault(str(row[k]), {})
        at[str(row[keys[-1]])] = {c: v for c, v in row.items() if c not in keys}
    return out


def write_json(report: dict, path: str) -> None:
    """Sorted keys, signs as they are, a line end at the end."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(plain(report), ensure_ascii=False, indent=2, sort_keys=True) + "\n", encoding="utf-8")


def shown(value) -> str:
    """Six decimals for reals, a dash for nothing."""
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return "—"
    return f"{value:.6f}" if isinstance(value, float) else str(value)


def markdown(rows: Sequence[dict], columns: Sequence[str], titles: Sequence[str] | None = None) -> str:
    head = [list(titles or columns), ["---"] * len(columns)]
    body = [[shown(r.get(c)) for c in columns] for r in rows]
    return "\n".join("| " + " | ".join(cells) + " |" for cells in [*head, *body]) + "\n"


def write_markdown(sections: Sequence[tuple[str, str]], path: str) -> None:
    """(heading, body) one after the other."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text("\n".join(f"## {h}\n\n{b.rstrip()}\n" for h, b in sections), encoding="utf-8")
