"""Named common table expressions and the statements built from them."""

from __future__ import annotations

import re

CTES: dict[str, str] = {}
STATEMENTS: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def _needed(text: str, seen: set[str]) -> set[str]:
    for name in CTES:
        if name not in seen and re.search(rf"\b{name}\b", text):
            seen.add(name)
            _needed(CTES[name], seen)
    return seen


def compose(select: str) -> str:
    needed = _needed(select, set())
    parts = [f"{name} AS MATERIALIZED (\n{CTES[name]}\n)" for name in CTES if name in needed]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select.strip()


def statement(key: str, select: str) -> None:
    STATEMENTS[key] = compose(_nudged(select))


def r6(columns: str) -> str:
    """``round(c, 6) AS c`` for blank-separated column names."""
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns.split())


def _nudged(text: str) -> str:
    """``round(x, 6)`` -> ``round((x) + 2e-10, 6)``, see ``scalars.NUDGE``."""
    out, at = [], 0
    for match in re.finditer(r"\bround\(", text):
        depth, i, comma = 1, match.end(), None
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            if text[i] == "," and depth == 1:
                comma = i
            i += 1
        if comma and text[comma + 1:i - 1].strip() == "6" and match.start() >= at:
            out += [text[at:match.end()], "(", text[match.end():comma], ") + 2e-10", text[comma:i]]
            at = i
    return "".join(out) + text[at:]


def num(expr: str, digits: int) -> str:
    return f"CAST(CAST(round(CAST(round({expr}, 9) AS DECIMAL(28,9)), {digits}) AS DECIMAL(20,{digits})) AS VARCHAR)"
