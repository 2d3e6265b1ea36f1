"""What preprocessing stores can be opened again; schemas are exported with their questions; many description files."""

import json

from pyspark.sql import functions as F

from quarry.operators import retrieval, schema_ops, values, vectors
from quarry.operators.postings import PostingIndex
from quarry.plans import workflow
from quarry.sources import files
from quarry.sources.catalog import Catalog


def test_preprocess_and_open(spark, sf_dir, tmp_path):
    small = Catalog(spark, sf_dir, ("region", "nation"))
    raw = spark.createDataFrame([("region", "r_name", "region name", "part of the world", "capitals"), ("nation", "n_name", "nation name", "", "")], "table string, original_column_name string, column_name string, column_description string, value_description string")
    broken = Catalog(spark, f"{sf_dir}/nowhere", ("region",))
    failed = workflow.preprocess_all({"one": small, "broken": broken, "two": Catalog(spark, sf_dir, ("nation",))}, f"file://{tmp_path}", {"one": raw}, postings=True)
    assert list(failed) == ["broken"]
    opened = workflow.open_documents(spark, f"file://{tmp_path}/one")
    made = vectors.embedded(vectors.catalog_documents(raw))
    asked = spark.createDataFrame([("region",)], "keyword string")
    got, want = (sorted(map(tuple, retrieval.column_context(asked, d, "which region", "a name").collect())) for d in (opened, made))
    assert got == want
    keywords = spark.createDataFrame([("EUROPE",), ("NATION_7",)], "keyword string")
    index = PostingIndex(spark, f"file://{tmp_path}/one/postings")
    expect = values.signature_top(values.signatures(values.unique_values(small)), keywords)
    assert sorted(map(tuple, index.top(keywords).collect())) == sorted(map(tuple, expect.collect()))
    workflow.preprocess(small, f"file://{tmp_path}/one", raw, postings=True)  # again: nothing is counted twice
    assert sorted(map(tuple, index.top(keywords).collect())) == sorted(map(tuple, expect.collect()))


def test_structured_export(spark, sf_dir, tmp_path):
    c = Catalog(spark, sf_dir)
    asked = spark.createDataFrame([(1, "who", "hint"), (2, "what", None), (3, "none", "")], "question_id long, question string, evidence string")
    chosen = spark.createDataFrame([(1, "Customer", "C_NATIONKEY"), (1, "nation", "n_nationkey"), (1, "nation", "nothing"), (2, "customer", "c_nationkey")], "question_id long, table string, column string")
    made = schema_ops.structured_questions(c.columns(), c.edges(), asked, chosen)
    assert {(r["question_id"], r["table"], tuple(r["columns"]), tuple(r["primary_keys"]), len(r["foreign_keys"] or [])) for r in made.collect()} == {
        (1, "customer", ("c_nationkey",), (), 1), (1, "nation", ("n_nationkey",), ("n_nationkey",), 0), (2, "customer", ("c_nationkey",), (), 0),
    }
    files.write_structured_schemas(made, f"{tmp_path}/schemas")
    rows = {o["question_id"]: o for o in map(json.loads, (r[0] for r in spark.read.text(f"{tmp_path}/schemas").collect()))}
    assert [t["table"] for t in rows[1]["schema"]] == ["customer", "nation"]
    assert rows[1]["evidence"] == "hint"
    assert "evidence" not in rows[2]


def test_many_description_files(spark, tmp_path):
    folder = tmp_path / "many files"
    folder.mkdir()
    for i in range(1000):
        (folder / f"T{i} x.csv").write_bytes((b"\xef\xbb\xbf" if i % 2 and i % 5 else b"") + f"original_column_name,column_name,column_description\nc{i},name {i},\"not useful caf{'é' if i % 3 else 'e'}\ntwo\"\n".encode("utf-8" if i % 5 else "cp1252"))
    (folder / "other.csv").write_text("a,b\n1,2\n")
    (folder / "empty.csv").write_text("")
    found = files.read_descriptions(spark, str(folder))
    assert found.count() == 1000
    one = found.where("original_column_name = 'c7'").first()
    assert (one["table"], one["column_name"], one["column_description"], one["value_description"]) == ("t7 x", "name 7", "café two", "")
    assert found.where(F.col("column_description").contains("caf")).count() == 1000
