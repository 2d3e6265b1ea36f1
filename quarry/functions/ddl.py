"""Reading CREATE TABLE text: items at the top level, columns, keys."""

from __future__ import annotations

import re
from dataclasses import dataclass, field


@dataclass
class ParsedTable:
    name: str
    columns: list[tuple[str, str]] = field(default_factory=list)
    primary: list[str] = field(default_factory=list)
    foreign: list[tuple[str, str, str]] = field(default_factory=list)
    unique: list[list[str]] = field(default_factory=list)


_NAME = r'(?:`[^`]+`|"[^"]+"|\[[^\]]+\]|[A-Za-z_]\w*)'


def bare(name: str) -> str:
    return name.strip().strip('`"[]')


def top_level_items(body: str) -> list[str]:
    """The parts of a list between commas that stand in no parentheses and no quotes."""
    out, depth, quote, start = [], 0, "", 0
    for i, c in enumerate(body):
        if quote:
            quote = "" if c == quote else quote
        elif c in "'\"`":
            quote = c
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "," and not depth:
            out.append(body[start:i].strip())
            start = i + 1
    out.append(body[start:].strip())
    return [x for x in out if x]


def _names(text: str) -> list[str]:
    return [bare(x) for x in top_level_items(text)]


def parse_table(ddl: str) -> ParsedTable:
    """The table that a CREATE TABLE statement describes; comments are left out."""
    text = re.sub(r"--[^\n]*|/\*.*?\*/", " ", ddl, flags=re.S)
    m = re.search(rf"CREATE\s+TABLE\s+(?:IF\s+NOT\s+EXISTS\s+)?({_NAME}(?:\.{_NAME})?)\s*\((.*)\)", text, re.S | re.I)
    if not m:
        raise ValueError("not a CREATE TABLE statement")
    out = ParsedTable(bare(re.split(r"\.(?=[^.]*$)", m[1])[-1]))
    for item in top_level_items(m[2]):
        plain = re.sub(rf"^CONSTRAINT\s+{_NAME}\s+", "", item, flags=re.I)
        if k := re.match(r"PRIMARY\s+KEY\s*\((.*?)\)", plain, re.S | re.I):
            out.primary += _names(k[1])
        elif k := re.match(rf"FOREIGN\s+KEY\s*\((.*?)\)\s*REFERENCES\s+({_NAME})\s*(?:\((.*?)\))?", plain, re.S | re.I):
            targets = _names(k[3]) if k[3] else [""] * len(_names(k[1]))
            out.foreign += [(c, bare(k[2]), t) for c, t in zip(_names(k[1]), targets, strict=False)]
        elif k := re.match(r"UNIQUE\s*\((.*?)\)", plain, re.S | re.I):
            out.unique.append(_names(k[1]))
        elif k := re.match(rf"({_NAME})\s*([A-Za-z]\w*(?:\s*\([^)]*\))?)?(.*)", plain, re.S):
            if bare(k[1]).upper() in ("CHECK", "EXCLUDE"):
                continue
            name, rest = bare(k[1]), k[3] or ""
            out.columns.append((name, (k[2] or "").upper()))
            if re.search(r"PRIMARY\s+KEY", rest, re.I):
                out.primary.append(name)
            if re.search(r"\bUNIQUE\b", rest, re.I):
                out.unique.append([name])
            if r := re.search(rf"REFERENCES\s+({_NAME})\s*(?:\((.*?)\))?", rest, re.I):
                out.foreign.append((name, bare(r[1]), bare(r[2] or "")))
    return out
