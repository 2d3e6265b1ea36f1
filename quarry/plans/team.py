"""Teams of agents from a configuration, agents that choose their next tool, and the interface of a retrieval backend."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any, Protocol

from pyspark.sql import DataFrame

from quarry.plans import workflow as W
from quarry.plans.providers import Engine


class Backend(Protocol):
    """What a retriever needs of a database, for callers with indexes of their own."""

    def columns(self) -> DataFrame: ...

    def find_values(self, keywords: DataFrame, top: int) -> DataFrame: ...

    def find_columns(self, queries: DataFrame, top: int) -> DataFrame: ...


@dataclass
class ModelCheck(W.Stage):
    """Asks whether each candidate answers the question; rejected ones are corrected, a bounded number of times."""

    check: Callable[[W.Task, str], str | None]
    fix: Callable[[W.Task, str, str], str]
    rounds: int = 3

    def run(self, db, state):
        checked, n = [], 0
        for c in state.latest:
            sql = c.sql
            for _ in range(self.rounds):
                reason = self.check(state.task, sql)
                if reason is None:
                    break
                sql, n = self.fix(state.task, sql, reason), n + 1
            checked.append(W.Candidate(sql, c.plan))
        state.candidates[state.next_key(self.name)] = checked
        return {"fixes": n}


STAGES: dict[str, type[W.Stage]] = {
    "extract_keywords": W.ExtractKeywords, "retrieve_entity": W.RetrieveEntity, "retrieve_context": W.RetrieveContext, "filter_column": W.FilterColumn, "select_tables": W.SelectTables,
    "select_columns": W.SelectColumns, "generate_candidate": W.GenerateCandidate, "revise": W.Revise, "generate_unit_test": W.GenerateUnitTest, "evaluate": W.Evaluate,
}
DONE = "DONE"


@dataclass
class Agent(W.Stage):
    """Tools in their fixed order or, with an engine, in the order a model names them until it says DONE."""

    title: str
    tools: list[W.Stage] = field(default_factory=list)
    engine: Engine | None = None
    turns: int = 10

    @property
    def name(self) -> str:
        return self.title

    def __call__(self, db, state):
        if self.engine is None:
            for tool in self.tools:
                tool(db, state)
            return
        by_name = {t.name: t for t in self.tools}
        done: list[str] = []
        for _ in range(self.turns):
            prompt = f"You are the {self.title}. Question: {state.task.question}\nTools: {', '.join(by_name)}\nUsed: {', '.join(done) or 'none'}\nName the next tool, or {DONE}."
            reply = self.engine.provider.complete(prompt, self.engine.temperature)
            if DONE in reply:
                return
            named = [n for n in by_name if n in reply]
            if not named:
                state.errors[self.title] = f"no tool in {reply!r}"
                return
            by_name[named[-1]](db, state)
            done.append(named[-1])


def read_config(path: str) -> dict[str, Any]:
    """A JSON file, or a YAML file where a YAML reader is installed."""
    text = Path(path).read_text()
    if path.endswith((".yaml", ".yml")):
        try:
            import yaml
        except ImportError as e:
            raise ValueError("YAML needs the yaml package; use JSON") from e
        return yaml.safe_load(text)
    return json.loads(text)


def build(config: dict[str, Any], engine: Engine | None = None) -> list[W.Stage]:
    """The stages of ``{"team_agents": {agent: {"tools": {tool: {setting: value}}, "choose": bool}}}``, in the order given."""
    out: list[W.Stage] = []
    for title, own in config["team_agents"].items():
        tools = []
        for name, settings in own.get("tools", {}).items():
            if name not in STAGES:
                raise ValueError(f"no tool {name!r}; there are {sorted(STAGES)}")
            tools.append(STAGES[name](**(settings or {})))
        out.append(Agent(title, tools, engine if own.get("choose") else None, own.get("turns", 10)))
    return out


def load_prompts(directory: str) -> dict[str, str]:
    """Prompts by file name (template_<name>.txt or <name>.txt), to lay over the defaults."""
    return {p.stem.removeprefix("template_"): p.read_text() for p in sorted(Path(directory).glob("*.txt"))}
