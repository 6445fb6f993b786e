"""Result envelopes, follow-ups, Markdown views and the registry of analyzers."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame

MARKDOWN_LINES = 200
ANALYZERS: dict[str, Callable[[DataFrame], tuple[DataFrame, DataFrame]]] = {}


def analyzer(name: str):
    """Registers a function from a table of sources to (nodes, edges)."""

    def add(f):
        ANALYZERS[name] = f
        return f

    return add


def next_depth(depth: int, most: int = 20) -> int:
    return min(most, max(depth + 1, 2 * depth))


def follow_ups(command: str, page: dict | None = None, depth: int | None = None, depth_truncated: bool = False) -> list[str]:
    out = []
    if page and page["truncated"]:
        out.append(f"{command} --offset {page['next_offset']}")
    if depth_truncated and depth is not None and next_depth(depth) > depth:
        out.append(f"{command} --depth {next_depth(depth)}")
    return out


def envelope(query: dict, rows: DataFrame, stats: dict, evidence: dict, next_queries: list[str] | None = None) -> str:
    """The answer as JSON with sorted keys. Rows are one page, so what is gathered is bounded."""
    return json.dumps({"query": query, "results": [r.asDict(recursive=True) for r in rows.collect()], "stats": stats, "evidence": evidence, "next_queries": next_queries or []}, sort_keys=True, default=str)


def markdown(title: str, sections: dict[str, DataFrame], limit: int = 30) -> str:
    """Tables of the first rows of each section, within MARKDOWN_LINES lines."""
    lines = [f"# {title}", ""]
    for name, df in sections.items():
        rows = df.limit(limit + 1).collect()
        lines += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        lines += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows[:limit]]
        lines += ["", "(more rows left out)", ""] if len(rows) > limit else [""]
    return "\n".join(lines[:MARKDOWN_LINES] + ["(cut)"] * (len(lines) > MARKDOWN_LINES))
