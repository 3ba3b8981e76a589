"""Text for readers, rendered on the driver from bounded results."""

from __future__ import annotations

import json
import textwrap

from pyspark.sql import Row

WIDTH = 88  # fixed value: the width of wrapped passages
LIMIT = 1000  # rows rendered at most; larger results belong in a table


def wrapped(text: str, width: int = WIDTH) -> str:
    """A text wrapped line by line; blank lines stay."""
    return "\n".join("\n".join(textwrap.wrap(line, width)) if line.strip() else "" for line in text.split("\n"))


def clean(text: str) -> str:
    """Control characters but tab and newline as U+FFFD."""
    return "".join("�" if (ord(c) < 32 and c not in "\t\n") or 127 <= ord(c) < 160 else c for c in text)


def citation_lines(citations: list[Row]) -> list[str]:
    """One line a paper, in the order of best rank: its title, pages and passages."""
    return [f"[{n}] {clean(c['title'])} (pages {c['pages']}; passages {', '.join(map(str, c['ranks']))})" for n, c in enumerate(citations, 1)]


def chat_text(row: Row, citations: list[Row]) -> str:
    said = {
        "empty_library": "The library is empty.",
        "no_matches": "No passage matches the question.",
        "abstained": "The model abstained.",
        "withheld": "The answer was withheld: no claim is grounded in what it cites.",
        "error": "The answer broke its contract.",
    }
    if row["outcome"] != "answered":
        return said[row["outcome"]]
    return "\n".join([wrapped(clean(row["answer_text"])), "", "Sources:", *citation_lines(citations)])


def evidence_text(row: Row) -> str:
    """One piece of evidence in full."""
    return f"{row['citation_id']}  rank {row['rank']}  score {row['score']:.12g}\n{clean(row['title'])}, page {row['pages']}\n\n{wrapped(clean(row['text']))}"


def batch_text(summary: Row, rows: list[Row]) -> str:
    counts = ", ".join(f"{k} {v}" for k, v in summary.asDict().items())
    return "\n".join([counts, *[f"{r['status']:<10} {r['path']}" + (f": {r['error']}" if r["error"] else "") for r in rows[:LIMIT]]])


def status_text(status: dict) -> str:
    lines = [f"library: {status['state']}"]
    if "version" in status:
        lines.append(f"version {status['version']}, schema {status['schema_version']}")
    return "\n".join([*lines, *[f"  {name}: {rows}" for name, rows in status.get("rows", {}).items()]])


def json_report(**parts: object) -> str:
    """A report as JSON with sorted keys; rows become objects."""

    def plain(value: object) -> object:
        return value.asDict(recursive=True) if isinstance(value, Row) else [plain(v) for v in value] if isinstance(value, list) else value

    return json.dumps({k: plain(v) for k, v in parts.items()}, sort_keys=True, indent=2, ensure_ascii=False)
