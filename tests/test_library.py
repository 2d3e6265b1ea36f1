"""Semantics that SQL does not tell: parsers, dialect, similarity, lineage, files, workflow, streams."""

import json

import pytest
from pyspark.sql import functions as F

from quarry.functions import ddl
from quarry.functions import parsers as P
from quarry.functions import text as T
from quarry.operators import datasets, profile, results, retrieval, schema_ops, values, vectors
from quarry.plans import dialect, lineage, providers, sqlrun, team, workflow
from quarry.sources import files
from quarry.sources.catalog import Catalog
from quarry.streaming import tables as streams


@pytest.fixture(scope="module")
def catalog(spark, sf_dir):
    return Catalog(spark, sf_dir).register()


def one(spark, expression, **values):
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return frame.select(expression).first()[0]


@pytest.mark.parametrize(("text", "grams"), [("abcd", ["abc", "bcd"]), ("abc", ["abc"]), ("ab", ["ab"]), ("", []), ("aaaa", ["aaa"])])
def test_ngrams(spark, text, grams):
    assert one(spark, T.ngrams(F.col("c")), c=text) == grams


def test_signature_is_near_jaccard(spark):
    rows = spark.createDataFrame([("the quick brown fox jumps", "the quick brown fox jumped"), ("abc", "xyz")], "a string, b string")
    a, b = T.ngrams(F.col("a")), T.ngrams(F.col("b"))
    got = rows.select(T.jaccard(a, b), T.estimated_jaccard(T.signature(a, 200), T.signature(b, 200))).collect()
    assert abs(got[0][0] - got[0][1]) < 0.15 and got[1][0] == 0 and got[1][1] < 0.05


def test_empty_signatures_do_not_match(spark):
    empty = T.signature(T.ngrams(F.col("c")))
    assert one(spark, T.estimated_jaccard(empty, empty), c="") == 0


@pytest.mark.parametrize(("text", "inner"), [("MAX(COUNT(x))", ["COUNT(x)", "x"]), ("a(b)c(d)", ["b", "d"]), ("((", []), (")(", []), (None, [])])
def test_nested_parentheses(text, inner):
    assert T.nested_parentheses(text) == inner


def test_ratio_depends_on_order():
    assert T.similarity_ratio("tide", "diet") == 0.25 and T.similarity_ratio("diet", "tide") == 0.5


def test_names_and_templates():
    assert T.snake_case("RetrieveEntity") == "retrieve_entity" and T.snake_case("SQLRun") == "sql_run"
    assert T.template_variables("{A} {{no}} {B} {A}") == ["A", "B"] and T.fill("{A}-{B}", A=1, B="{A}") == "1-{A}"
    with pytest.raises(KeyError):
        T.fill("{A}")


@pytest.mark.parametrize(
    ("name", "text", "got"),
    [
        ("python_list", "```python\n['a', 'b']\n```", ["a", "b"]), ("python_list", "so: [1, 2]", [1, 2]), ("json", '```json\n{"a": "Yes"}\n```', {"a": "Yes"}),
        ("sql_with_plan", "why <FINAL_ANSWER>SELECT\n 1</FINAL_ANSWER>", {"SQL": "SELECT 1", "plan": "why"}), ("final_answer_is", "x My final answer is: ```sql\nSELECT 2\n```", {"SQL": "SELECT 2", "plan": "x"}),
        ("verdicts", "<Answer>\nCandidate #1: Passed\nCandidate #2: Failed\n</Answer>", [1, 0]), ("answer_list", "<Answer>['t1', 't2']</Answer>", ["t1", "t2"]), ("revised_sql", "```sql\nSELECT 3\n```", {"refined_sql_query": "SELECT 3"}),
    ],
)
def test_parsers(name, text, got):
    assert P.get_parser(name)(text) == got


@pytest.mark.parametrize(("name", "text"), [("python_list", "__import__('os')"), ("json", "{no"), ("verdicts", "none"), ("sql_with_plan", "none")])
def test_parsers_refuse(name, text):
    with pytest.raises(P.ParseError):
        P.get_parser(name)(text)


@pytest.mark.parametrize(
    ("sqlite", "value"),
    [
        ("SELECT 7/2", 3), ("SELECT -7/2", -3), ("SELECT 7.0/2", 3.5), ("SELECT 1/0", None), ("SELECT 2*7/4", 3), ("SELECT (1+6)/(1+1)", 3), ("SELECT 'ABC' LIKE 'abc'", True), ("SELECT 'a/b'", "a/b"),
        ("SELECT CAST('12abc' AS INTEGER)", 12), ("SELECT CAST('x' AS REAL)", 0.0), ("SELECT CAST(NULL AS REAL)", None), ("SELECT STRFTIME('%Y-%m', '2024-02-29')", "2024-02"), ("SELECT STRFTIME('%Y', 'no date')", None),
        ("SELECT date('2024-02-29', '-1 years')", "2023-03-01"), ("SELECT date('2024-01-31', '+1 month')", "2024-03-02"), ("SELECT date('2024-03-01', '-1 day')", "2024-02-29"), ("SELECT date('2024-05-17', 'start of month')", "2024-05-01"),
        ("SELECT datetime('2024-01-31 10:00:00', '+1 month')", "2024-03-02 10:00:00"), ("SELECT date('2024-05-15', 'weekday 0')", "2024-05-19"), ("SELECT strftime('it''s %Y-%q', '2024-01-01')", None), ("SELECT strftime('it''s %Y', '2024-01-01')", "it's 2024"),
        ("SELECT printf('%d items %s', 3.7, NULL)", "3 items "), ("SELECT CAST('9007199254740993' AS INTEGER)", 9007199254740993), ("SELECT CAST('1e3' AS INTEGER)", 1), ("SELECT json_extract('{\"a\": [1, 2]}', '$.a[1]')", "2"),
        ('SELECT "text"', "text"), ("SELECT max(1, 3, 2)", 3), ("SELECT IIF(1 < 2, 'a', 'b')", "a"), ("SELECT 1 -- a / b\n + 1", 2), ("SELECT SUM(x > 1) FROM (SELECT 1 AS x UNION ALL SELECT 2)", 1), ("SELECT 'it''s'", "it's"),
    ],
)
def test_dialect(spark, sqlite, value):
    assert sqlrun.run_sql(spark, sqlite, "one")[0] == value


def test_clean_sql():
    assert dialect.clean('`SELECT "a"\nFROM t.`') == "SELECT 'a' FROM t"


def test_run_sql_fetch_modes(spark, catalog):
    assert len(sqlrun.run_sql(spark, "SELECT n_name FROM nation")) == 25
    assert len(sqlrun.run_sql(spark, "SELECT n_name FROM nation", 3)) == 3
    assert sqlrun.run_sql(spark, "SELECT n_name FROM nation WHERE n_nationkey < 0", "one") is None
    assert len(sqlrun.run_sql(spark, "SELECT n_name FROM nation", "random")) == 1
    with pytest.raises(ValueError):
        sqlrun.run_sql(spark, "SELECT 1", "some")


def test_timeout_cancels(spark):
    with pytest.raises(TimeoutError):
        sqlrun.run_sql(spark, "SELECT count(*) FROM range(100000000) a CROSS JOIN range(100000) b WHERE a.id * b.id % 7 = 3", timeout=2)
    assert sqlrun.run_sql(spark, "SELECT 1", "one") == (1,)


@pytest.mark.parametrize(
    ("a", "b", "same"),
    [
        ("SELECT 1 AS x UNION ALL SELECT 1", "SELECT 1.0D AS y", True), ("SELECT 1", "SELECT '1'", False), ("SELECT NULL", "SELECT NULL", True), ("SELECT 1, 2", "SELECT 1", False),
        ("SELECT 1 WHERE 1 = 0", "SELECT 1, 2 WHERE 1 = 0", True), ("SELECT 1", "SELECT 1 WHERE 1 = 0", False),
    ],
)
def test_same_result(spark, a, b, same):
    x, y = spark.sql(a), spark.sql(b)
    assert results.same_result(x, y) is same and results.same_result(y, x) is same and results.same_result(x, x)
    if len(x.columns) == len(y.columns) and x.count() and y.count():
        assert (results.result_digest(x).first()["digest"] == results.result_digest(y).first()["digest"]) is same


def test_digest_of_multisets(spark):
    twice, once = spark.sql("SELECT 1 UNION ALL SELECT 1"), spark.sql("SELECT 1")
    d = lambda f, m: results.result_digest(f, m).first()["digest"]
    assert d(twice, False) == d(once, False) and d(twice, True) != d(once, True)


def test_votes(spark, catalog):
    assert sqlrun.aggregate_sqls(spark, ["SELECT nothing", "SELECT 2", "SELECT 1 + 1", "SELECT 3"]) == "SELECT 2"
    assert sqlrun.aggregate_sqls(spark, ["SELECT nothing", "SELECT none"]) == "SELECT nothing"


def test_lineage_of_failing_queries(spark, catalog):
    assert lineage.lineage_of(spark, ["SELECT n_name FROM nation", "SELECT broken FROM"]) == {"nation": ["n_name"]}


def test_lookup_equals_signatures_at_full_likeness(spark, catalog):
    own = values.unique_values(catalog, [("nation", "n_name"), ("region", "r_name")])
    keywords = spark.createDataFrame([("EUROPE",), ("NATION_7",)], "keyword string")
    exact = {(r.keyword, r.value) for r in values.jaccard_top(own, keywords).where("rank = 1").collect()}
    estimated = {(r.keyword, r.value) for r in values.signature_top(values.signatures(own), keywords).where("rank = 1").collect()}
    assert exact == {("EUROPE", "EUROPE"), ("NATION_7", "NATION_7")} == estimated
    assert [r["values"][0] for r in values.by_column(values.jaccard_top(own, keywords)).where("keyword = 'EUROPE' and column = 'r_name'").collect()] == ["EUROPE"]
    assert values.value_exists(catalog.table("region"), "r_name", "uRo") and not values.value_exists(catalog.table("region"), "r_name", "zzz")


def test_index_round_trip(spark, catalog, tmp_path):
    own = values.unique_values(catalog, [("region", "r_name")])
    values.write_index(own, f"{tmp_path}/index")
    back = values.read_index(spark, f"{tmp_path}/index")
    assert back.count() == 5 and {"grams", "signature"} <= set(back.columns)


def test_retrieval_in_one_call(spark, catalog):
    from quarry.queries import _descriptions

    keywords = spark.createDataFrame([("EUROPE",), ("account balance",), ("c_mktsegment = BUILDING",)], "keyword string")
    own = values.unique_values(catalog, [("region", "r_name"), ("customer", "c_mktsegment")])
    documents = vectors.embedded(vectors.catalog_documents(_descriptions(spark)))
    got = retrieval.retrieve(keywords, catalog.columns(), own, documents, "Which account balance?", "EUROPE")
    assert ("customer", "c_mktsegment") in {(r[0], r[1]) for r in got.columns.collect()}
    assert {"EUROPE", "BUILDING"} <= {r["value"] for r in got.entities.collect()}
    assert "c_acctbal" in {r["column"] for r in got.context.collect()}


def test_closure_is_idempotent(spark, catalog):
    working = schema_ops.from_map(spark, {"orders": ["o_totalprice"], "customer": ["c_name"]})
    once = schema_ops.closure(catalog.columns(), catalog.edges(), working)
    twice = schema_ops.closure(catalog.columns(), catalog.edges(), once)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def test_rendering(spark, catalog):
    working = schema_ops.from_map(spark, {"customer": ["c_custkey", "c_name"], "orders": ["o_custkey"]})
    schema = schema_ops.assembled(catalog, working, schema_ops.with_examples(spark, {"customer": {"c_name": ["x" * 300, "Ann"]}}), schema_ops.with_descriptions(spark, {"customer": {"c_name": {"column_name": "full name"}}}))
    text = schema_ops.schema_string(schema_ops.render_tables(schema, catalog.edges())).first()[0]
    assert "CREATE TABLE `customer`" in text and "`c_name` STRING, -- Example Values: `null`, `Ann` | Column Name Meaning: full name" in text
    assert "PRIMARY KEY (`c_custkey`)" in text and "FOREIGN KEY (`o_custkey`) REFERENCES `customer` (`c_custkey`)" in text
    shuffled = schema_ops.schema_string(schema_ops.render_tables(schema, catalog.edges(), seed=1), seed=2).first()[0]
    assert sorted(shuffled.split()) == sorted(text.split())
    with pytest.raises(ValueError):
        schema_ops.add_info(schema, schema, ["nothing"])
    profiles = {(r[0], r[1]): r[2] for r in schema_ops.column_profiles(schema, catalog.edges()).collect()}
    assert set(profiles) == {("customer", "c_name")}
    assert schema_ops.to_map(schema_ops.primary_keys(schema, "CUSTOMER").withColumn("table", F.lit("t"))) == {"t": ["c_custkey"]}
    assert schema_ops.structured(schema, catalog.edges()).count() == 2


def test_example_ladder(spark):
    cols = "table string, column string, examples array<string>"
    found, cats, firsts = (spark.createDataFrame(x, cols) for x in ([("t", "a", ["f"]), ("t", "a_date", ["f"])], [("t", "b", list("123456"))], [("t", "a", ["x"]), ("t", "a_date", ["x"]), ("t", "c", ["x"])]))
    got = {r["column"]: r["examples"] for r in schema_ops.example_ladder(found, cats, firsts).collect()}
    assert got == {"a": ["f"], "a_date": ["x"], "b": list("12345"), "c": ["x"]}


def test_sample_is_exact_and_repeatable(catalog, tmp_path):
    a, b = (sorted(map(tuple, catalog.sample("lineitem", 100).collect())) for _ in range(2))
    assert len(a) == 100 and a == b


def test_descriptions_and_tasks(spark, tmp_path):
    d = tmp_path / "database_description"
    d.mkdir()
    (d / "People.csv").write_bytes("﻿original_column_name,column_name,column_description,value_description\n age , years,\"how\nold\",not useful the age\nname,,commonsense evidence: who,\n".encode())
    (d / "old.csv").write_bytes("original_column_name,column_description\nville,où\n".encode("cp1252"))
    got = {(r["table"], r["original_column_name"]): r for r in files.read_descriptions(spark, str(d)).collect()}
    assert got["people", "age"]["column_name"] == "years" and got["people", "age"]["column_description"] == "how old" and got["people", "age"]["value_description"] == "the age"
    assert got["people", "name"]["column_description"] == "who" and got["old", "ville"]["column_description"] == "où"
    (tmp_path / "tasks.json").write_text(json.dumps([{"db_id": "d", "question": "q0"}, {"question_id": 7, "db_id": "d", "question": "q1", "SQL": "SELECT 1"}]))
    tasks = files.read_tasks(spark, str(tmp_path / "tasks.json")).orderBy("question").collect()
    assert [t["question_id"] for t in tasks] == [0, 7] and tasks[1]["SQL"] == "SELECT 1"


def test_sinks(spark, tmp_path):
    finals = spark.createDataFrame([(2, "db", "SELECT\n 2"), (10, "db", None)], "question_id long, db_id string, sql string")
    files.write_predictions(finals, f"{tmp_path}/p")
    back = files.read_json_lines(spark, f"{tmp_path}/p")
    assert {r["question_id"]: r["prediction"] for r in back.collect()} == {"2": "SELECT\n 2\t----- bird -----\tdb", "10": "0"}
    files.write_sql_text(back, f"{tmp_path}/s")
    assert sorted(r[0] for r in spark.read.text(f"{tmp_path}/s").collect()) == ["0", "SELECT 2"]
    assert files.run_directory("/r/", "dev", "/s/", "d", "t") == "/r/dev/s/d/t"


def test_question_sets(spark):
    rows = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (3, 2, "c")], "id long, line int, v string")
    assert sorted(map(tuple, datasets.first_occurrence(rows, "id", ["line"]).select("id", "v").collect())) == [(1, "a"), (3, "c")]
    assert [r[0] for r in datasets.missing_ids(spark, rows, "id", 0, 4).orderBy("id").collect()] == [0, 2, 4]
    assert datasets.random_pick(rows).count() == 1


def test_final_by_stage(spark):
    rows = [(0, 0, "a", "s0", "--"), (0, 1, "b", "s1", "timeout"), (1, 0, "a", "s0", "timeout"), (1, 1, "b", "s1", "some error")]
    got = results.final_by_stage(spark.createDataFrame(rows, "question_id int, stage_ord int, stage string, sql string, exec_err string")).orderBy("question_id").collect()
    assert [r["stage"] for r in got] == ["a", "b"]


def test_revisions(spark):
    rows = spark.createDataFrame([("SELECT 1", "select 2"), ("SELECT 1", "sorry")], "sql string, revision string")
    assert sorted(r[0] for r in results.keep_valid_revisions(rows).collect()) == ["SELECT 1", "select 2"]


def test_skip_rule(spark):
    rows = spark.createDataFrame([("t", "long", 60_000, 30.0), ("t", "a_name", 60_000, 30.0)], "table string, column string, sum_length long, avg_length double")
    assert {r[1]: r[2] for r in profile.skipped(rows).collect()} == {"long": True, "a_name": False}


GOLD = [
    workflow.Task(0, "star", "How many customers are in the BUILDING segment?", "", "SELECT COUNT(*) FROM customer WHERE c_mktsegment = 'BUILDING'"),
    workflow.Task(1, "star", "Which nations are in EUROPE?", "", "SELECT n_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE'"),
    workflow.Task(2, "star", "How many orders have status F?", "", "SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F'"),
]


def test_workflow_with_gold_candidates(spark, catalog):
    db = workflow.Engineered(catalog, value_columns=[("customer", "c_mktsegment"), ("region", "r_name")])
    wrong = {0: ["SELECT COUNT(*) FROM customer"], 1: [GOLD[1].SQL, "SELECT broken"], 2: [GOLD[2].SQL, "SELECT COUNT(o_orderkey) FROM orders WHERE o_orderstatus LIKE 'f'", "SELECT 1"]}
    stages = [workflow.ExtractKeywords(), workflow.SelectTables("oracle"), workflow.SelectColumns("oracle"), workflow.GenerateCandidate(propose=lambda t: wrong[t.question_id]), workflow.Evaluate()]
    evaluated, states = workflow.run_tasks(db, GOLD, stages)
    got = {(r["question_id"], r["stage"]): r["exec_res"] for r in evaluated.collect()}
    assert got[0, "final_SQL"] == 0 and got[1, "final_SQL"] == 1 and got[2, "final_SQL"] == 1
    assert not any(s.errors for s in states) and "BUILDING" in states[0].keywords
    assert set(states[1].working["region"]) == {"r_name", "r_regionkey"}
    stats = {r["stage"]: r for r in results.statistics(evaluated).collect()}
    assert stats["final_SQL"]["n_correct"] == 2 and stats["final_SQL"]["n_incorrect"] == 1
    assert workflow.history_frame(spark, states).where("status = 'success'").count() == 15
    assert workflow.schema_for_queries(db, [GOLD[2].SQL, "SELECT broken"]) == {"orders": ["o_orderstatus"]}


def test_workflow_with_a_scripted_model(spark, catalog):
    answers = (
        ("Give a JSON object with table_names", '{"table_names": ["ORDERS"]}'), ("Give a JSON object from table", '{"orders": ["o_orderstatus"]}'), ("Is this column relevant", '{"is_column_information_relevant": "Yes"}'),
        ("Write one SQLite query", "<FINAL_ANSWER>SELECT COUNT(*) FROM order</FINAL_ANSWER>"), ("Correct it", "<FINAL_ANSWER>SELECT COUNT(*) FROM orders WHERE o_orderstatus = 'F'</FINAL_ANSWER>"),
    )
    engine = providers.Engine("scripted", providers.Scripted(answers))
    db = workflow.Engineered(catalog, engine, value_columns=[("orders", "o_orderstatus")])
    stages = [workflow.ExtractKeywords(), workflow.RetrieveEntity(), workflow.RetrieveContext(), workflow.SelectTables(), workflow.SelectColumns(), workflow.GenerateCandidate(), workflow.Revise(), workflow.GenerateUnitTest(), workflow.Evaluate()]
    evaluated, states = workflow.run_tasks(db, GOLD[2:], stages)
    assert not states[0].errors, states[0].errors
    assert set(states[0].working) == {"orders"} and list(states[0].candidates) == ["generate_candidate", "revise_1", "evaluate_1"]
    assert {r["stage"]: r["exec_res"] for r in evaluated.collect()} == {"generate_candidate": 0, "revise_1": 1, "evaluate_1": 1, "final_SQL": 1}


def test_failing_stage_is_recorded(spark, catalog):
    _, states = workflow.run_tasks(workflow.Engineered(catalog), GOLD[:1], [workflow.SelectTables(), workflow.ExtractKeywords()])
    assert "select_tables" in states[0].errors and states[0].keywords


def test_provider_retries(spark):
    class Flaky:
        def __init__(self):
            self.n = 0

        def complete(self, prompt, temperature=0.0):
            self.n += 1
            return "no list" if self.n < 3 else "[1]"

    assert providers.call(providers.Engine("f", Flaky()), "p", "python_list") == [1]
    with pytest.raises(P.ParseError):
        providers.call(providers.Engine("s", providers.Scripted(())), "p", "python_list", attempts=2)
    requests = spark.createDataFrame([(1, "a cat"), (2, "a dog")], "request_id long, prompt string")
    got = providers.ask(requests, providers.Engine("s", providers.Scripted((("cat", "meow"),), "woof")))
    assert {r["request_id"]: r["answer"] for r in got.collect()} == {1: "meow", 2: "woof"}
    engines = providers.Engines()
    engines.register("s", lambda: providers.Engine("s", providers.Scripted(()), 0.5))
    assert engines.get("s", 0.0).temperature == 0.0 and engines.get("s").temperature == 0.5


def test_streams(spark, sf_dir, tmp_path):
    stream = streams.read_stream(spark, sf_dir, "events")
    streams.run_once(streams.event_windows(stream), f"{tmp_path}/out", f"{tmp_path}/check")
    got = spark.read.parquet(f"{tmp_path}/out")
    batch = streams.event_windows(spark.read.parquet(f"{sf_dir}/events.parquet"))
    assert 0 < got.count() <= batch.count() and got.exceptAll(batch.select(*got.columns)).select("window_start", "event_type", "n_events").count() <= got.count()
    new = streams.read_stream(spark, sf_dir, "region")
    for _ in range(2):
        streams.index_new_values(new, "region", ["r_name"], f"{tmp_path}/index", f"{tmp_path}/check2")
    assert spark.read.parquet(f"{tmp_path}/index").count() == 5


def test_ddl(catalog):
    assert "PRIMARY KEY (`n_nationkey`)" in catalog.ddl("nation") and "FOREIGN KEY (`n_regionkey`) REFERENCES `region` (`r_regionkey`)" in catalog.ddl("nation")
    assert catalog.schema_map()["region"] == ["r_regionkey", "r_name"]


def test_parse_table():
    text = """CREATE TABLE IF NOT EXISTS `a b` ( -- note, with comma
      id INTEGER PRIMARY KEY, "full, name" VARCHAR(10, 2) DEFAULT 'x,y' UNIQUE, other DECIMAL(10,2) REFERENCES t2 (k),
      CONSTRAINT c1 FOREIGN KEY (other, id) REFERENCES t3(x, y), UNIQUE (id, other), CHECK (id > 0))"""
    got = ddl.parse_table(text)
    assert got.name == "a b" and [c for c, _ in got.columns] == ["id", "full, name", "other"] and got.columns[2][1] == "DECIMAL(10,2)"
    assert got.primary == ["id"] and got.unique == [["full, name"], ["id", "other"]]
    assert got.foreign == [("other", "t2", "k"), ("other", "t3", "x"), ("id", "t3", "y")]
    with pytest.raises(ValueError):
        ddl.parse_table("SELECT 1")


def test_generated_ddl_parses_back(catalog):
    got = ddl.parse_table(catalog.ddl("nation"))
    assert got.primary == ["n_nationkey"] and got.foreign == [("n_regionkey", "region", "r_regionkey")] and [c for c, _ in got.columns] == catalog.schema_map()["nation"]


def test_team(spark, catalog, tmp_path):
    (tmp_path / "config.json").write_text(json.dumps({"team_agents": {"retriever": {"tools": {"extract_keywords": None}}, "selector": {"tools": {"select_tables": {"mode": "oracle"}, "select_columns": {"mode": "oracle"}}, "choose": True}}}))
    replies = iter(["use select_tables", "select_columns please", "DONE"])

    class Replies:
        def complete(self, prompt, temperature=0.0):
            return next(replies)

    stages = team.build(team.read_config(str(tmp_path / "config.json")), providers.Engine("r", Replies()))
    fix = team.ModelCheck(lambda task, sql: None if "BUILDING" in sql else "no filter", lambda task, sql, reason: sql + " WHERE c_mktsegment = 'BUILDING'")
    stages += [workflow.GenerateCandidate(propose=lambda t: ["SELECT COUNT(*) FROM customer"]), fix]
    evaluated, states = workflow.run_tasks(workflow.Engineered(catalog), GOLD[:1], stages)
    assert not states[0].errors and [h["tool_name"] for h in states[0].history] == ["extract_keywords", "select_tables", "select_columns", "generate_candidate", "model_check"]
    assert {r["stage"]: r["exec_res"] for r in evaluated.collect()} == {"generate_candidate": 0, "model_check_1": 1, "final_SQL": 1}
    with pytest.raises(ValueError):
        team.build({"team_agents": {"a": {"tools": {"nothing": None}}}})
    (tmp_path / "template_revise.txt").write_text("Fix {SQL}")
    assert team.load_prompts(str(tmp_path)) == {"revise": "Fix {SQL}"}


def test_block_joins_find_the_same(spark, monkeypatch):
    from quarry.operators import bounds

    left, right = spark.range(40).withColumnRenamed("id", "a"), spark.range(30).withColumnRenamed("id", "b")
    want = sorted(map(tuple, bounds.blocks_joined(left, right, F.col("a") > F.col("b")).collect()))
    monkeypatch.setattr(bounds, "MOST_SMALL", 5)
    assert sorted(map(tuple, bounds.blocks_joined(left, right, F.col("a") > F.col("b"), blocks=4).collect())) == want
    assert bounds.blocks_joined(left, right).count() == 1200


class Moody:
    """Fails, answers nonsense or a query, by turns and by question."""

    def __init__(self):
        self.n = 0

    def complete(self, prompt, temperature=0.0):
        self.n += 1
        if "question 13" in prompt:
            raise ConnectionError("no line")
        return "nothing" if self.n % 2 else "<FINAL_ANSWER>SELECT COUNT(*) FROM nation</FINAL_ANSWER>"


def test_twenty_tasks_at_a_time(spark, catalog):
    db = workflow.Engineered(catalog, providers.Engine("m", Moody()))
    tasks = [workflow.Task(i, "star", f"question {i}?", "", "SELECT COUNT(*) FROM nation") for i in range(20)]
    kept = []
    stages = [workflow.SelectTables("oracle"), workflow.GenerateCandidate(samples=3, engines=(db.engine, providers.Engine("s", providers.Scripted((), "<FINAL_ANSWER>SELECT 25</FINAL_ANSWER>")))), workflow.Evaluate()]
    evaluated, states = workflow.run_tasks(db, tasks, stages, threads=8, finished={("star", 3)}, on_done=lambda s, rows: kept.append((s.task.question_id, len(rows))))
    assert [s.task.question_id for s in states] == [i for i in range(20) if i != 3] and sorted(kept) == [(i, 3) for i in range(20) if i != 3]
    lost = next(s for s in states if s.task.question_id == 13)
    assert [c.sql for c in lost.candidates["generate_candidate"]] == ["SELECT 25"] * 3 and len(lost.history[1]["failed_samples"]) == 3
    assert not any(s.errors for s in states)
    assert evaluated.where("stage = 'final_SQL' and exec_res = 1").count() == 19
    assert set(db.executed) <= {"SELECT 25", "SELECT COUNT(*) FROM nation"}
    assert workflow.conversation_frame(db).where("template = 'candidate'").count() == 19 * 6


def test_a_query_runs_once(spark, catalog, monkeypatch):
    ran, known = [], {}
    monkeypatch.setattr(sqlrun, "frame", lambda spark, sql, sqlite=True: ran.append(sql) or spark.sql(sql))
    first = sqlrun.execute_all(spark, [(0, 0, "SELECT 1"), (0, 1, "SELECT 1"), (0, 2, "SELECT broken")], known=known).collect()
    again = sqlrun.execute_all(spark, [(1, 0, "SELECT broken"), (1, 1, "SELECT 1")], known=known).collect()
    assert ran == ["SELECT 1", "SELECT broken"] and first[0]["digest"] == first[1]["digest"] == again[1]["digest"] and again[0]["error"]


def test_calls_at_once_and_samples(spark):
    engine = providers.Engine("s", providers.Scripted((("two", "[2]"), ("bad", "no list")), "[1]"))
    got = providers.call_all(engine, ["one", "bad", "two"], "python_list", attempts=2)
    assert got[0] == [1] and isinstance(got[1], Exception) and got[2] == [2] and providers.call_all(engine, []) == []
    asked = providers.ask(spark.createDataFrame([(7, "two")], "request_id long, prompt string"), engine, samples=3)
    assert sorted((r["request_id"], r["sample"], r["answer"]) for r in asked.collect()) == [(7, i, "[2]") for i in range(3)]
    assert providers.ask(spark.createDataFrame([(7, "two")], "request_id long, prompt string"), engine, samples=0).isEmpty()


def test_upsert_and_other_sinks(spark, tmp_path):
    kind = "question_id long, db_id string, sql string"
    assert files.finished(spark, f"{tmp_path}/u") is None
    files.upsert_predictions(spark, spark.createDataFrame([(1, "db", "SELECT 1"), (2, "db", "SELECT 2")], kind), f"{tmp_path}/u")
    files.upsert_predictions(spark, spark.createDataFrame([(2, "db", "SELECT 22"), (3, "db", None)], kind), f"{tmp_path}/u")
    got = {r["question_id"]: files_sql for r in spark.read.json(f"{tmp_path}/u").collect() if (files_sql := r["prediction"].split("\t")[0])}
    assert got == {"1": "SELECT 1", "2": "SELECT 22", "3": "0"} and sorted(r[0] for r in files.finished(spark, f"{tmp_path}/u").collect()) == [1, 2, 3]
    files.write_json_array(spark.createDataFrame([(2, None), (1, "x")], "id int, v string"), f"{tmp_path}/a", ["id"])
    assert json.loads("\n".join(r[0] for r in spark.read.option("wholetext", True).text(f"{tmp_path}/a").collect())) == [{"id": 1, "v": "x"}, {"id": 2, "v": None}]
    files.write_arguments(spark, {"b": 1, "a": None}, f"{tmp_path}/args")
    assert json.loads(spark.read.text(f"{tmp_path}/args").first()[0]) == {"a": None, "b": 1}


def test_unique_keys_are_rendered(spark, sf_dir):
    from quarry.sources.catalog import Constraints

    own = Catalog(spark, sf_dir, ("nation",), Constraints({"nation": ("n_nationkey",)}, (), (("nation", ("n_name", "n_regionkey")), ("nation", ("n_name",)))))
    assert "UNIQUE (`n_name`)" in own.ddl("nation")
    shown = schema_ops.render_tables(schema_ops.subselect(own.columns(), schema_ops.from_map(spark, {"nation": ["n_name"]})), own.edges(), unique=own.unique_keys()).first()["ddl"]
    assert "UNIQUE (`n_name`)," in shown and "n_regionkey" not in shown


def test_near_the_best_has_null_groups(spark):
    rows = spark.createDataFrame([(None, 10.0), (None, 9.5), (None, 1.0), ("a", None), ("a", 2.0)], "g string, v double")
    for small in (True, False):
        assert sorted(retrieval.near_the_best(rows, "v", ["g"], small=small).collect(), key=str) == sorted([(None, 10.0), (None, 9.5), ("a", 2.0)], key=str)
