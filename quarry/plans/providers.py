"""Model providers: where a workflow asks a language model, it asks one of these. The defaults are rules, offline and deterministic."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace
from typing import Any, Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.functions.parsers import ParseError, get_parser


class Provider(Protocol):
    """Answers a prompt; picklable, as calls run on executors."""

    def complete(self, prompt: str, temperature: float = 0.0) -> str: ...


@dataclass(frozen=True)
class Engine:
    """An immutable configuration; each call gets its own copy."""

    name: str
    provider: Any
    temperature: float = 0.0

    def at(self, temperature: float | None) -> Engine:
        return self if temperature is None else replace(self, temperature=temperature)


class Engines:
    def __init__(self) -> None:
        self._made: dict[str, Callable[[], Engine]] = {}

    def register(self, name: str, make: Callable[[], Engine]) -> None:
        self._made[name] = make

    def get(self, name: str, temperature: float | None = None) -> Engine:
        if name not in self._made:
            raise ValueError(f"no engine {name!r}; there are {sorted(self._made)}")
        return self._made[name]().at(temperature)


@dataclass(frozen=True)
class Scripted:
    """Answers by the first pattern that a prompt contains; for tests and fixtures."""

    answers: tuple[tuple[str, str], ...]
    default: str = ""

    def complete(self, prompt: str, temperature: float = 0.0) -> str:
        return next((a for p, a in self.answers if p in prompt), self.default)


@dataclass(frozen=True)
class KeywordRules:
    """Keywords of a question: quoted texts, capitalised runs, numbers, and words that are not common ones."""

    # Words that say nothing about data.
    common: frozenset[str] = frozenset("a an and any are as at by do does each for from had has have how in is it its list many me much of on or please show that the their them there these this to was were what when where which who whose with".split())

    def __call__(self, question: str, hint: str = "") -> list[str]:
        text = f"{question} {hint}".strip()
        found = [m for pair in re.findall(r"'([^']+)'|\"([^\"]+)\"", text) for m in pair if m]
        found += [m for m in re.findall(r"\b[A-Z][\w#-]*(?:\s+[A-Z][\w#-]*)+", text)]
        found += [w for w in re.findall(r"[\w#][\w#.-]*", text) if w.lower() not in self.common and len(w) > 1]
        return list(dict.fromkeys(x.strip(" .?") for x in found if x.strip(" .?")))


def call(engine: Engine, prompt: str, parser: str | None = None, attempts: int = 12, spare: Engine | None = None) -> Any:
    """One answer, parsed. Answers that do not parse are asked for again, empty ones from the spare engine, a bounded number of times."""
    error: Exception | None = None
    for _ in range(attempts):
        answer = engine.provider.complete(prompt, engine.temperature)
        if not answer and spare is not None:
            engine = spare
            continue
        if parser is None:
            return answer
        try:
            return get_parser(parser)(answer)
        except ParseError as e:
            error = e
    raise error or ParseError("no answer")


def call_all(engine: Engine, prompts: list[str], parser: str | None = None, attempts: int = 12, spare: Engine | None = None, threads: int = 8) -> list[Any]:
    """The parsed answers in order of the prompts, several calls at a time; a call that fails gives its exception, the others stand."""

    def one(prompt: str) -> Any:
        try:
            return call(engine, prompt, parser, attempts, spare)
        except Exception as e:  # noqa: BLE001  the caller sees which calls failed
            return e

    if len(prompts) < 2:
        return [one(p) for p in prompts]
    with ThreadPoolExecutor(min(threads, len(prompts))) as pool:
        return list(pool.map(one, prompts))


def ask(requests: DataFrame, engine: Engine, attempts: int = 3, samples: int | None = None) -> DataFrame:
    """``requests``: request_id long, prompt string. Adds answer; a failed call gives null. Calls run where the rows lie.

    With ``samples``, each request is asked so many times; a column sample (from 0) tells its answers apart.
    """
    asked = requests.select("request_id", "prompt")
    kept, schema = ["request_id", "prompt", "answer"], "request_id long, prompt string, answer string"
    if samples is not None:
        asked = asked.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1)) if samples > 0 else F.array().cast("array<int>")))
        kept, schema = ["request_id", "sample", "prompt", "answer"], "request_id long, sample int, prompt string, answer string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = []
            for prompt in batch["prompt"]:
                got = None
                for _ in range(attempts):
                    try:
                        got = engine.provider.complete(prompt, engine.temperature)
                        break
                    except Exception:  # noqa: BLE001  a remote call may fail; the row says so by its null
                        continue
                answers.append(got)
            yield batch.assign(answer=answers)[kept]

    return asked.mapInPandas(run, schema)
