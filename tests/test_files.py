"""DOCX with tracked changes, model replies, made-up agreements, the run log, and streams with state."""

import json
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from clauseloom.functions.patterns import LIBRARY_B, PLAIN
from clauseloom.operators import edits, route, spans, vault
from clauseloom.sources import docx, readers, replies, synthetic, writers
from clauseloom.streaming import redaction, routing
from tests.conftest import DATA, ROOT


def test_docx_written_and_read_back(spark, tmp_path):
    rows = [("a.docx", 1, 1, "kept", "Plain <text> & \"quotes\" ", None, None), ("a.docx", 1, 2, "deleted", "old\x01 words", "Me & Co", "2024-01-05T00:00:00Z"), ("a.docx", 1, 3, "inserted", "new  words", "Me & Co", "2024-01-05T00:00:00Z"), ("a.docx", 3, 1, "kept", "Ünïcode 中文", None, None), ("b.docx", 1, 1, "kept", None, None, None), (None, 1, 1, "kept", "no name", None, None)]
    df = spark.createDataFrame(rows, "name string, para_no int, seq int, kind string, text string, author string, made_at string")
    where = str(tmp_path / "out")
    docx.write_files(docx.docx_files(df), where)
    docx.write_files(docx.docx_files(df), where)  # again: the same files
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["a.docx", "b.docx"]
    (tmp_path / "out/broken.docx").write_bytes(b"no zip")
    files = docx.below(spark, where)
    got = sorted((r.path[-6:], r.para_no or 0, r.seq or 0, r.kind, r.text, r.revision, r.author, r.error is None) for r in docx.docx_revisions(files).collect())
    assert got == [("a.docx", 1, 1, "kept", "Plain <text> & \"quotes\" ", None, None, True), ("a.docx", 1, 2, "deleted", "old words", 1, "Me & Co", True), ("a.docx", 1, 3, "inserted", "new  words", 2, "Me & Co", True), ("a.docx", 2, 1, "kept", "Ünïcode 中文", None, None, True), ("b.docx", 1, 1, "kept", "", None, None, True), ("n.docx", 0, 0, None, None, None, None, False)]
    paragraphs = {(r.path[-6:], r.para_no): r.text for r in readers.docx_paragraphs(spark, where).filter("error is null").collect()}
    assert paragraphs["a.docx", 1] == 'Plain <text> & "quotes" new  words' and paragraphs["a.docx", 2] == "Ünïcode 中文"
    nodes = {r.path[-6:]: r.text for r in docx.docx_nodes(files).collect()}
    assert nodes["a.docx"] == 'Plain <text> & "quotes"  new  words Ünïcode 中文' and nodes["n.docx"] is None
    with pytest.raises(Exception, match="no file name"):
        docx.write_files(spark.createDataFrame([("../x", b"1")], "name string, content binary"), where)


def test_markup_keeps_what_is_between(spark):
    lines = ["a [INSERT: b] c [INSERT:d]", "x [DELETE: y]", "[INSERT: i] [DELETE: d]", "plain", "  ", None]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(lines)], "k int, t string").select("k", edits.markup_runs(F.col("t")).alias("r")).collect()
    got = {r.k: [tuple(x) for x in r.r] for r in rows}
    assert got == {0: [("kept", "a "), ("inserted", "b"), ("kept", " c "), ("inserted", "d")], 1: [("kept", "x "), ("deleted", "y")], 2: [("inserted", "i"), ("kept", " [DELETE: d]")], 3: [("kept", "plain")], 4: [], 5: []}


def test_replies(spark):
    whole = '[{"line_number": 007, "find": "a\tb", "note": "keep: 007, [x] {y} \\" "}, {"line_number": 10}]'
    cases = {
        1: f"Sure [see below]:\n```json\n{whole}\n```\nDone.", 2: f"```json\n```json\n{whole}\n```", 3: f"Notes [1], [2].\n{whole}\nand [more]", 4: whole[:-22],
        5: "```json\n[]\n```\ntext\n```\n" + whole + "\n```", 6: "```\nprose [with brackets]\n```\nnothing", 7: None, 8: "", 9: '[{"line_number": 0, "find": "z"}, {broken}, {"line_number": -03}]', 10: "[[1, 2], [" + '{"line_number": 5}' + "]]", 11: "[" * 2000,
    }
    out = replies.recommendations(spark.createDataFrame(list(cases.items()), "doc_id int, text string"), "line_number:int,find:string,note:string").collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.doc_id, r.seq)):
        got.setdefault(r.doc_id, []).append((r.line_number, r.find, r.note))
    two = [(7, "a b", 'keep: 007, [x] {y} " '), (10, None, None)]
    assert got == {1: two, 2: two, 3: two, 4: two[:1], 5: two, 9: [(0, "z", None), (-3, None, None)], 10: [(5, None, None)]}
    assert replies.array_of(json.dumps([{"a": "]"}, {"b": [1, {"c": 2}]}])) == ['{"a": "]"}', '{"b": [1, {"c": 2}]}']


def test_made_up_rows_are_the_same_at_any_parallelism(spark):
    few, many = (sorted(map(tuple, synthetic.contracts(spark, 50).repartition(n).collect())) for n in (1, 7))
    assert few == many and len(set(t for _, t in few)) > 40 and few != sorted(map(tuple, synthetic.contracts(spark, 50, seed=8).collect()))
    docs = spark.createDataFrame([(k, "Some text.") for k in range(40)] + [(99, None)], "doc_id bigint, text string")
    truth = synthetic.planted(docs.select("doc_id"))
    assert sorted(map(tuple, truth.collect())) == sorted(map(tuple, synthetic.planted(docs.select("doc_id").repartition(5)).collect()))
    full = synthetic.with_planted(docs, truth)
    values = {}
    for r in truth.collect():
        values.setdefault(r.doc_id, []).append((r.label, r.value))
    # Each planted number is found at its place; the vault hides mail addresses and phone numbers and gives them back.
    found = {}
    for r in spans.located(full, PLAIN).collect():
        found.setdefault(r.doc_id, set()).add(r.found)
    assert all(v in found[i] for i, vs in values.items() for label, v in vs if label in ("SSN", "TAX_ID", "CREDIT_CARD", "EMAIL", "AMOUNT", "PHONE"))
    kept = vault.vault(full)
    for r in kept.select("doc_id", "text", "redacted", vault.restored(F.col("redacted"), F.col("found")).alias("back")).collect():
        hidden = [v for label, v in values[r.doc_id] if label in ("EMAIL", "PHONE")]
        assert r.back == r.text and not any(v in r.redacted for v in hidden)
    assert "[LAST]" in synthetic.clean_agreement(spark).first().text


def test_vault_with_an_allow_list_table(spark):
    docs = spark.createDataFrame([(1, "Material Adverse and John Smith met."), (None, "Material Adverse only"), (1, "Material Adverse and John Smith met.")], "doc_id bigint, text string")
    allow = spark.createDataFrame([("material",), ("adverse",), ("john",), ("john",)], "term string")
    rows = vault.vault(docs, allow).collect()
    assert [[x.original for x in r.found] for r in sorted(rows, key=lambda r: r.doc_id or 0)] == [[], ["John Smith"], ["John Smith"]]
    plain = vault.vault(docs, frozenset({"material", "adverse", "john"})).collect()
    assert sorted(r.redacted for r in plain) == sorted(r.redacted for r in rows)
    assert "PERSON" in dict(LIBRARY_B)


def test_run_log_counts_while_writing(spark, tmp_path):
    df = spark.range(1000).withColumn("x", F.col("id") * 2)
    out = writers.logged(df, "first", str(tmp_path))
    assert out.count() == 1000 and writers.logged(df.filter("id < 10"), "second", str(tmp_path)).count() == 10
    log = {r.step: r.rows for r in spark.read.parquet(str(tmp_path / "run_log")).collect()}
    assert log == {"first": 1000, "second": 10}


def test_processed_files_are_archived(spark, tmp_path):
    schema = "doc_id bigint, text string"
    for k in range(2):
        spark.createDataFrame([(k, f"mail a{k}@b.co")], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        redaction.redact_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "done")).awaitTermination()
    assert sorted(r.content for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["mail [REDACTED]"] * 2
    assert list((tmp_path / "done").rglob("*.parquet"))


def test_routing_stream_as_the_batch_query(spark, tmp_path):
    """Files one by one, with a new start of the stream each time; then all at once; then a late document."""
    rows = duckdb.execute(f"select doc_id, text from '{DATA}/documents.parquet' order by doc_id limit 60").fetchall()
    schema = "doc_id bigint, text string"
    docs = spark.createDataFrame(rows, schema)
    pages = docs.select("doc_id", F.posexplode(F.filter(F.split("text", "[^A-Za-z]+"), lambda w: w != "")).alias("at", "word")).withColumn("page", F.floor(F.col("at") / 500) + 1)
    want = {(r.doc_id, r.page): r.to_review for r in route.route_across(pages.select("doc_id", "page", "word")).collect()}
    for name, cuts in (("one", [0, 20, 40, 60]), ("all", [0, 60])):
        where = tmp_path / name
        for a, b in zip(cuts, cuts[1:], strict=False):
            spark.createDataFrame(rows[a:b], schema).repartition(3).write.mode("append").parquet(str(where / "in"))
            routing.route_stream(spark, str(where / "in"), schema, str(where / "out"), str(where / "cp")).awaitTermination()
        got = routing.routed(pages.select("doc_id", "page").distinct(), spark.read.parquet(str(where / "out"))).collect()
        assert {(r.doc_id, r.page): r.to_review for r in got} == want
    late = [(-5, rows[0][1]), (-4, "zzqqx " + rows[0][1][:200]), (None, "xxyyzz")]
    spark.createDataFrame(late, schema).write.mode("append").parquet(str(tmp_path / "one/in"))
    routing.route_stream(spark, str(tmp_path / "one/in"), schema, str(tmp_path / "one/out"), str(tmp_path / "one/cp")).awaitTermination()
    assert {r.doc_id for r in spark.read.parquet(str(tmp_path / "one/out")).filter("doc_id < 0").collect()} == {-4}


def test_entry_is_imported_without_a_session():
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"], cwd=ROOT, capture_output=True, text=True, timeout=100)
    n, with_sql = map(int, out.stdout.split())
    assert n > with_sql > 100
