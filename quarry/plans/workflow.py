"""The question workflow: stages in a fixed order over one question's state, with history, and evaluation at the end.

Model calls go through providers; everything else is frames and SQL. A stage that fails is recorded and the next one runs.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quarry.functions.text import fill, snake_case
from quarry.operators import results as R
from quarry.operators import retrieval, schema_ops
from quarry.operators import vectors as V
from quarry.operators.values import unique_values
from quarry.plans import sqlrun
from quarry.plans.lineage import lineage, lineage_of
from quarry.plans.providers import Engine, KeywordRules, call, call_all
from quarry.sources.catalog import Catalog

# Short prompts of our own; a caller may give others with the same variables.
PROMPTS = {
    "select_tables": "Which of these tables does the question need? Give a JSON object with table_names.\n{SCHEMA}\nQuestion: {QUESTION}\nHint: {HINT}",
    "select_columns": "Which columns of these tables does the question need? Give a JSON object from table to list of columns.\n{SCHEMA}\nQuestion: {QUESTION}\nHint: {HINT}",
    "filter_column": "Is this column relevant to the question? Give a JSON object with is_column_information_relevant: Yes or No.\n{PROFILE}\nQuestion: {QUESTION}\nHint: {HINT}",
    "candidate": "Write one SQLite query that answers the question, inside <FINAL_ANSWER> tags.\n{SCHEMA}\nQuestion: {QUESTION}\nHint: {HINT}",
    "revise": "The query failed or gave a doubtful result. Correct it, inside <FINAL_ANSWER> tags.\n{SCHEMA}\nQuestion: {QUESTION}\nHint: {HINT}\nQuery: {SQL}\nResult: {RESULT}",
    "unit_tests": "Write {COUNT} unit tests that tell these results apart, as a list inside <Answer> tags.\n{SCHEMA}\nQuestion: {QUESTION}\nHint: {HINT}\n{CANDIDATES}",
    "evaluate": "For each candidate say whether it passes the test, a line each like 'Candidate #1: Passed', inside <Answer> tags.\n{SCHEMA}\nQuestion: {QUESTION}\nTest: {TEST}\n{CANDIDATES}",
}
CLOSING_TEST = "Only a candidate that answers the question best, given the schema and the hint, passes."


@dataclass
class Task:
    question_id: int
    db_id: str
    question: str
    evidence: str = ""
    SQL: str | None = None
    difficulty: str | None = None


@dataclass
class Candidate:
    sql: str
    plan: str = ""
    status: str | None = None
    error: str | None = None
    evaluations: list[int] = field(default_factory=list)


@dataclass
class State:
    task: Task
    working: dict[str, list[str]]
    keywords: list[str] = field(default_factory=list)
    similar_columns: DataFrame | None = None
    examples: DataFrame | None = None
    descriptions: DataFrame | None = None
    candidates: dict[str, list[Candidate]] = field(default_factory=dict)
    unit_tests: list[str] = field(default_factory=list)
    errors: dict[str, str] = field(default_factory=dict)
    history: list[dict[str, Any]] = field(default_factory=list)

    @property
    def latest(self) -> list[Candidate]:
        return list(self.candidates.values())[-1] if self.candidates else []

    def next_key(self, name: str) -> str:
        n = sum(k == name or k.startswith(f"{name}_") for k in self.candidates)
        return f"{name}_{n + 1}"


class Engineered:
    """A database with its indexes, built lazily and kept: what every stage works with."""

    def __init__(self, catalog: Catalog, engine: Engine | None = None, descriptions: DataFrame | None = None, prompts: dict[str, str] | None = None, value_columns: list[tuple[str, str]] | None = None):
        self.catalog, self.engine, self.prompts = catalog.register(), engine, PROMPTS | (prompts or {})
        self.spark: SparkSession = catalog.spark
        self.descriptions = descriptions
        self._value_columns = value_columns
        self._values: DataFrame | None = None
        self._documents: DataFrame | None = None
        self._making = threading.RLock()
        #: Outcomes of candidate queries by their text: stages and questions that meet a text again do not run it again.
        self.executed: dict[str, tuple] = {}
        #: (prompt's name, prompt, answer or error) of all calls.
        self.conversations: list[tuple[str, str, str]] = []

    @property
    def values(self) -> DataFrame:
        with self._making:
            if self._values is None:
                self._values = unique_values(self.catalog, self._value_columns).cache()
        return self._values

    @property
    def documents(self) -> DataFrame | None:
        with self._making:
            if self._documents is None and self.descriptions is not None:
                self._documents = V.embedded(V.catalog_documents(self.descriptions)).cache()
        return self._documents

    def schema_text(self, state: State) -> str:
        schema = schema_ops.assembled(self.catalog, schema_ops.from_map(self.spark, state.working), state.examples, state.descriptions)
        return schema_ops.schema_string(schema_ops.render_tables(schema, self.catalog.edges())).first()[0]

    def ask(self, prompt: str, parser: str, **values: object) -> Any:
        got = self.ask_all(prompt, parser, [values])[0]
        if isinstance(got, Exception):
            raise got
        return got

    def ask_all(self, prompt: str, parser: str, values: list[dict[str, object]], engine: Engine | None = None) -> list[Any]:
        """Parsed answers to a prompt filled in several ways, asked at once; a failed call's place holds its exception."""
        engine = engine or self.engine
        if engine is None:
            raise ValueError("this stage asks a model: give an engine")
        filled = [fill(self.prompts[prompt], **v) for v in values]
        answers = call_all(engine, filled, parser)
        self.conversations += [(prompt, asked, str(got)) for asked, got in zip(filled, answers, strict=True)]
        return answers

    def execute(self, question_id: int, candidates: list[Candidate]) -> DataFrame:
        return sqlrun.execute_all(self.spark, [(question_id, i, c.sql) for i, c in enumerate(candidates)], known=self.executed)


class Stage:
    """A named step: ``run`` changes the state and returns what goes into the history."""

    @property
    def name(self) -> str:
        return snake_case(type(self).__name__)

    def __call__(self, db: Engineered, state: State) -> None:
        began = time.time()
        entry: dict[str, Any] = {"tool_name": self.name}
        try:
            entry |= self.run(db, state) or {}
            entry["status"] = "success"
        except Exception as e:  # noqa: BLE001  a failing stage is recorded; the workflow goes on
            state.errors[self.name] = entry["error"] = f"{type(e).__name__}: {e}"
            entry["status"] = "error"
        state.history.append(entry | {"execution_time": round(time.time() - began, 1)})

    def run(self, db: Engineered, state: State) -> dict[str, Any] | None:
        raise NotImplementedError


@dataclass
class ExtractKeywords(Stage):
    extractor: Callable[[str, str], list[str]] = field(default_factory=KeywordRules)

    def run(self, db, state):
        state.keywords = self.extractor(state.task.question, state.task.evidence)
        return {"keywords": state.keywords}


class RetrieveEntity(Stage):
    def run(self, db, state):
        keywords = db.spark.createDataFrame([(k,) for k in state.keywords], "keyword string")
        state.similar_columns = retrieval.similar_columns(keywords, db.catalog.columns(), state.task.question, state.task.evidence)
        state.examples = retrieval.entity_examples(retrieval.similar_entities(keywords, db.values))
        return {"similar_columns": [tuple(r) for r in state.similar_columns.select("table", "column").collect()]}


@dataclass
class RetrieveContext(Stage):
    top_k: int = 5

    def run(self, db, state):
        if db.documents is None:
            return {"schema_with_descriptions": 0}
        keywords = db.spark.createDataFrame([(k,) for k in state.keywords], "keyword string")
        state.descriptions = retrieval.column_context(keywords, db.documents, state.task.question, state.task.evidence, self.top_k)
        return {"schema_with_descriptions": state.descriptions.count()}


class FilterColumn(Stage):
    def run(self, db, state):
        schema = schema_ops.assembled(db.catalog, schema_ops.from_map(db.spark, state.working), state.examples, state.descriptions)
        kept: dict[str, list[str]] = {t: [] for t in state.working}
        profiles = schema_ops.column_profiles(schema, db.catalog.edges()).orderBy("table", "column").collect()  # metadata
        answers = db.ask_all("filter_column", "json", [{"PROFILE": r["profile"], "QUESTION": state.task.question, "HINT": state.task.evidence} for r in profiles])
        failed = [a for a in answers if isinstance(a, Exception)]
        if failed and len(failed) == len(answers):
            raise failed[0]
        for r, got in zip(profiles, answers, strict=True):  # a column nobody could judge stays
            if isinstance(got, Exception) or str(got.get("is_column_information_relevant", "")).lower() == "yes":
                kept[r["table"]].append(r["column"])
        closed = schema_ops.closure(db.catalog.columns(), db.catalog.edges(), schema_ops.from_tables(db.spark, list(kept)).selectExpr("table", "cast(null as string) as column").unionByName(schema_ops.from_map(db.spark, kept)) if any(kept.values()) else schema_ops.from_map(db.spark, state.working))
        state.working = {t: sorted(set(kept[t]) | set(schema_ops.to_map(closed).get(t, []))) for t in kept}
        return {"tentative_schema": state.working}


@dataclass
class SelectTables(Stage):
    """``mode``: "ask" a model, or "oracle" to read the gold query (for upper bounds; never the default)."""

    mode: str = "ask"

    def run(self, db, state):
        if self.mode == "oracle":
            chosen = lineage(db.spark, sqlrun.bridge(state.task.SQL)).tables
        else:
            chosen = db.ask("select_tables", "json", SCHEMA=db.schema_text(state), QUESTION=state.task.question, HINT=state.task.evidence)["table_names"]
        names = {t.lower() for t in chosen}
        state.working = {t: c for t, c in state.working.items() if t.lower() in names} or state.working
        return {"selected_tables": sorted(state.working)}


@dataclass
class SelectColumns(Stage):
    mode: str = "ask"

    def run(self, db, state):
        if self.mode == "oracle":
            chosen = lineage(db.spark, sqlrun.bridge(state.task.SQL)).columns
        else:
            chosen = db.ask("select_columns", "json", SCHEMA=db.schema_text(state), QUESTION=state.task.question, HINT=state.task.evidence)
        selected = schema_ops.from_map(db.spark, {t: c for t, c in chosen.items() if isinstance(c, list)})
        closed = schema_ops.to_map(schema_ops.closure(db.catalog.columns(), db.catalog.edges(), selected))
        state.working = closed or state.working
        return {"selected_schema": state.working}


@dataclass
class GenerateCandidate(Stage):
    """``engines``: generators that each give ``samples`` candidates; the database's own engine if none. A sample that fails is
    left out; the stage fails only if all do."""

    samples: int = 1
    propose: Callable[[Task], list[str]] | None = None
    engines: tuple[Engine, ...] = ()

    def run(self, db, state):
        if self.propose is not None:
            made = [Candidate(s) for s in self.propose(state.task)]
        else:
            filled = {"SCHEMA": db.schema_text(state), "QUESTION": state.task.question, "HINT": state.task.evidence}
            answers = [a for engine in self.engines or (None,) for a in db.ask_all("candidate", "sql_with_plan", [filled] * self.samples, engine)]
            failed = [a for a in answers if isinstance(a, Exception)]
            if failed and len(failed) == len(answers):
                raise failed[0]
            made = [Candidate(a["SQL"], a["plan"]) for a in answers if not isinstance(a, Exception)]
            state.candidates[self.name] = made
            return {"candidates": [c.sql for c in made]} | ({"failed_samples": [f"{type(a).__name__}: {a}" for a in failed]} if failed else {})
        state.candidates[self.name] = made
        return {"candidates": [c.sql for c in made]}


class Revise(Stage):
    def run(self, db, state):
        revised = []
        for c in state.latest:
            c.status = sqlrun.execution_status(db.spark, c.sql)
            if c.status == R.CORRECT:
                revised.append(Candidate(c.sql, c.plan, c.status))
                continue
            shown = sqlrun.validate_sql(db.spark, c.sql, 5)["RESULT"]
            got = db.ask("revise", "revised_sql", SCHEMA=db.schema_text(state), QUESTION=state.task.question, HINT=state.task.evidence, SQL=c.sql, RESULT=shown)["refined_sql_query"]
            revised.append(Candidate(got if "SELECT" in got.upper() else c.sql, c.plan))
        key = state.next_key(self.name)
        state.candidates[key] = revised
        return {"candidates": [c.sql for c in revised]}


def _listed(db: Engineered, candidates: list[Candidate]) -> str:
    return "\n".join(f"Candidate #{i + 1}: {c.sql}\nResult: {sqlrun.validate_sql(db.spark, c.sql, 20)['RESULT']}" for i, c in enumerate(candidates))


@dataclass
class GenerateUnitTest(Stage):
    count: int = 5

    def run(self, db, state):
        executed = db.execute(state.task.question_id, state.latest)
        if len(state.latest) <= 1 or R.clusters(executed, False).select("cluster").distinct().count() <= 1:
            return {"unit_tests": []}
        got = db.ask("unit_tests", "answer_list", COUNT=self.count, SCHEMA=db.schema_text(state), QUESTION=state.task.question, HINT=state.task.evidence, CANDIDATES=_listed(db, state.latest))
        state.unit_tests = [str(t) for t in got] + [CLOSING_TEST]
        return {"unit_tests": state.unit_tests}


class Evaluate(Stage):
    def run(self, db, state):
        candidates = state.latest
        executed = db.execute(state.task.question_id, candidates)
        if not state.unit_tests or len(candidates) <= 1:
            best = candidates[0].sql if len(candidates) == 1 else R.majority_vote(executed).first()["sql"]
        else:
            rows = []
            filled = {"SCHEMA": db.schema_text(state), "QUESTION": state.task.question, "CANDIDATES": _listed(db, candidates)}
            for k, verdicts in enumerate(db.ask_all("evaluate", "verdicts", [filled | {"TEST": t} for t in state.unit_tests])):
                if isinstance(verdicts, Exception):
                    raise verdicts
                verdicts = (verdicts + [0] * len(candidates))[: len(candidates)]
                for i, v in enumerate(verdicts):
                    candidates[i].evaluations.append(v)
                    rows.append((state.task.question_id, k, i, v))
            scores = db.spark.createDataFrame(rows, "question_id long, test int, ord int, passed int")
            best = R.pick_by_scores(scores, executed).first()["sql"]
        state.candidates[state.next_key(self.name)] = [Candidate(best)]
        return {"selected": best}


def evaluate_stages(db: Engineered, state: State, timeout: float = 30) -> list[tuple]:
    """Each stage's first candidate against the gold query, and the final query: (question_id, db_id, stage_ord, stage, sql, exec_res, exec_err)."""
    rows = []
    for k, (stage, own) in enumerate(state.candidates.items()):
        v = sqlrun.compare_sql(db.spark, own[0].sql, state.task.SQL, timeout) if own else sqlrun.Verdict(0, "no candidate")
        rows.append((state.task.question_id, state.task.db_id, k, stage, own[0].sql if own else None, v.exec_res, v.exec_err))
    if rows:
        good = [r for r in rows if r[6] in ("--", "incorrect answer")]
        rows.append((*(good or rows)[-1][:2], len(rows), "final_SQL", *(good or rows)[-1][4:]))
    return rows


EVALUATED = "question_id long, db_id string, stage_ord int, stage string, sql string, exec_res int, exec_err string"


def run_tasks(db: Engineered, tasks: list[Task], stages: list[Stage], threads: int = 4, finished: set[tuple[str, int]] = frozenset(), on_done: Callable[[State, list[tuple]], None] | None = None) -> tuple[DataFrame, list[State]]:
    """Runs the stages over every task; returns the evaluation of all stages as a frame, and the states, in order of the tasks.

    ``threads`` questions run at a time: their stages wait for models and small jobs, which the session runs side by side.
    ``finished``: (db_id, question_id) of tasks that an earlier run has done and that are passed over. ``on_done`` gets each
    task's state and evaluation as soon as it ends, one call at a time, so a run that breaks off has kept what it did.
    """
    told = threading.Lock()

    def one(task: Task) -> tuple[State, list[tuple]]:
        state = State(task, db.catalog.schema_map())
        for stage in stages:
            stage(db, state)
        rows = evaluate_stages(db, state) if task.SQL else []
        if on_done is not None:
            with told:
                on_done(state, rows)
        return state, rows

    left = [t for t in tasks if (t.db_id, t.question_id) not in finished]
    if threads > 1 and len(left) > 1:
        with ThreadPoolExecutor(min(threads, len(left))) as pool:
            done = list(pool.map(one, left))
    else:
        done = [one(t) for t in left]
    return db.spark.createDataFrame([r for _, rows in done for r in rows], EVALUATED), [s for s, _ in done]


def history_frame(spark: SparkSession, states: list[State]) -> DataFrame:
    """question_id, db_id, step, tool_name, status, seconds, payload (JSON) of all stage runs."""
    import json

    made = [(s.task.question_id, s.task.db_id, i, h["tool_name"], h["status"], float(h["execution_time"]), json.dumps({k: v for k, v in h.items() if k not in ("tool_name", "status", "execution_time")}, default=str)) for s in states for i, h in enumerate(s.history)]
    return spark.createDataFrame(made, "question_id long, db_id string, step int, tool_name string, status string, seconds double, payload string")


def conversation_frame(db: Engineered) -> DataFrame:
    """template, prompt, answer of all calls so far, as parsed."""
    return db.spark.createDataFrame(db.conversations, "template string, prompt string, answer string")


def schema_for_queries(db: Engineered, queries: list[str]) -> dict[str, list[str]]:
    """The canonical schema that a set of queries reads."""
    own = lineage_of(db.spark, [sqlrun.bridge(q) for q in queries])
    return schema_ops.to_map(schema_ops.canonical_union(db.catalog.columns(), schema_ops.from_map(db.spark, own))) if own else {}


def preprocess(catalog: Catalog, path: str, descriptions: DataFrame | None = None, postings: bool = False) -> None:
    """Builds and stores a database's indexes: values with signatures (``postings``: as an inverted index too, to which another call adds what
    is new) and, with descriptions, embedded catalog documents."""
    from quarry.operators.postings import PostingIndex
    from quarry.operators.values import write_index

    found = unique_values(catalog)
    write_index(found, f"{path}/values")
    if postings:
        PostingIndex(catalog.spark, f"{path}/postings").append(found)
    if descriptions is not None:
        V.embedded(V.catalog_documents(descriptions)).write.mode("overwrite").parquet(f"{path}/documents")


def open_documents(spark: SparkSession, path: str) -> DataFrame:
    """The embedded catalog documents that ``preprocess`` stored, for ``retrieval.column_context`` and ``vectors.nearest_columns``."""
    return spark.read.parquet(f"{path}/documents")


def preprocess_all(catalogs: dict[str, Catalog], root: str, descriptions: dict[str, DataFrame] | None = None, postings: bool = False) -> dict[str, Exception]:
    """Preprocesses databases by name, each under ``root``; one that fails does not stop the others. Returns what failed."""
    failed: dict[str, Exception] = {}
    for name, catalog in catalogs.items():
        try:
            preprocess(catalog, f"{root.rstrip('/')}/{name}", (descriptions or {}).get(name), postings)
        except Exception as e:  # noqa: BLE001  said in the result
            failed[name] = e
    return failed
