"""Parsers of model output, by name. They read text only: nothing is evaluated."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class ParseError(ValueError):
    pass


def _block(text: str, language: str) -> str:
    found = re.findall(rf"```\s*{language}\s*(.*?)```", text, re.S | re.I)
    return found[-1].strip() if found else text.strip()


def python_list(text: str) -> list:
    """A list literal, fenced or bare, or the first one inside a longer text."""
    body = _block(text, "python")
    if not (body.startswith("[") and body.endswith("]")):
        m = re.search(r"\[.*\]", body, re.S)
        if not m:
            raise ParseError("no list")
        body = m[0]
    try:
        got = ast.literal_eval(body)
    except (ValueError, SyntaxError) as e:
        raise ParseError(str(e)) from e
    if not isinstance(got, list):
        raise ParseError("not a list")
    return got


def json_object(text: str) -> Any:
    try:
        return json.loads(_block(text, "json"))
    except ValueError as e:
        raise ParseError(str(e)) from e


def _tag(text: str, name: str) -> str | None:
    m = re.search(rf"<{name}>(.*?)(?:</{name}>|\Z)", text, re.S | re.I)
    return m[1].strip() if m else None


def plain_sql(text: str) -> str:
    """A query with whatever fence is around it taken off, on one line."""
    return re.sub(r"\s+", " ", _block(text, "(?:sql|sqlite)?")).strip()


def sql_with_plan(text: str) -> dict[str, str]:
    """The query of <FINAL_ANSWER>, and what comes before it as plan."""
    answer = _tag(text, "FINAL_ANSWER")
    if answer is None:
        raise ParseError("no <FINAL_ANSWER>")
    return {"SQL": plain_sql(answer), "plan": text[: text.lower().find("<final_answer>")].strip()}


def final_answer_is(text: str) -> dict[str, str]:
    """The query after the last "My final answer is:"."""
    head, mark, tail = text.rpartition("My final answer is:")
    if not mark:
        raise ParseError("no final answer")
    return {"SQL": plain_sql(tail), "plan": head.strip()}


def revised_sql(text: str) -> dict[str, str]:
    answer = _tag(text, "FINAL_ANSWER")
    return {"refined_sql_query": plain_sql(answer if answer is not None else text)}


def verdicts(text: str) -> list[int]:
    """1 for each line of <Answer> that says passed, 0 for each other line with a colon."""
    body = _tag(text, "Answer")
    if body is None:
        raise ParseError("no <Answer>")
    return [int("passed" in line.lower()) for line in body.splitlines() if ":" in line]


def answer_list(text: str) -> list:
    body = _tag(text, "Answer")
    if body is None:
        raise ParseError("no <Answer>")
    return python_list(body)


PARSERS: dict[str, Callable[[str], Any]] = {
    "python_list": python_list, "json": json_object, "sql": plain_sql, "sql_with_plan": sql_with_plan, "final_answer_is": final_answer_is,
    "revised_sql": revised_sql, "verdicts": verdicts, "answer_list": answer_list,
}


def get_parser(name: str) -> Callable[[str], Any]:
    if name not in PARSERS:
        raise ValueError(f"no parser {name!r}; there are {sorted(PARSERS)}")
    return PARSERS[name]


def verdict_column(c: Column) -> Column:
    """``verdicts`` as a column function, for whole tables of answers."""
    body = F.regexp_extract(c, r"(?is)<answer>(.*?)(?:</answer>|\z)", 1)
    return F.transform(F.filter(F.split(body, r"\r?\n"), lambda line: F.contains(line, F.lit(":"))), lambda line: F.contains(F.lower(line), F.lit("passed")).cast("int"))


def final_sql_column(c: Column) -> Column:
    """The query of <FINAL_ANSWER> as a column function."""
    body = F.regexp_extract(c, r"(?is)<final_answer>(.*?)(?:</final_answer>|\z)", 1)
    return F.nullif(F.trim(F.regexp_replace(F.regexp_replace(body, r"(?i)```\s*(?:sqlite|sql)?", " "), r"\s+", " ")), F.lit(""))
