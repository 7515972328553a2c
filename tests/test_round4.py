"""What the third round's findings showed: decimal shares, borders beside accents, and steps whose work grew with a group."""

import duckdb
from pyspark.sql import functions as F

from clauseloom.functions.patterns import LIBRARY_A, spelled
from clauseloom.operators import route, spans, text


def test_a_share_of_terms_is_a_decimal(spark):
    """231 of 330 is 0.7 and no more; a binary 0.7 makes it more."""
    by_page = spark.createDataFrame([(1, 1, 231, 0), (1, 2, 99, 46), (2, 1, 232, 0), (2, 2, 98, 0)], "doc_id int, page int, new_terms long, repeated_terms long")
    assert [(r.doc_id, r.is_early) for r in route.early_introduction(by_page).orderBy("doc_id").collect()] == [(1, False), (2, True)]


def test_borders_beside_accents_are_those_of_sql(spark):
    """Accented letters are no word characters, neither for `\\w` nor for borders: findings, offsets, redaction, counts and page flags."""
    texts = ["5433 städtisch", "über5433 straße é123-45-6789ü", "éa@b.co a@b.coé", "éDr Smith", "12 Oak St.é 12 Oak St.x", "né NY 12345é", "plain", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    con = duckdb.connect()
    con.execute("create table documents (doc_id int, text varchar)")
    con.executemany("insert into documents values (?, ?)", list(enumerate(texts)))
    want, redacted = [], "text"
    for k, (_, p) in enumerate(LIBRARY_A):
        sql = "(?i)" + spelled(p).replace("'", "''")
        want += con.execute(f"select doc_id, {k}, unnest(regexp_extract_all(text, '{sql}')) from documents").fetchall()
        redacted = f"regexp_replace({redacted}, '{sql}', '[REDACTED]', 'g')"
    assert (0, 7, "5433 st") in want
    for found in (text.findings(docs), spans.located(docs)):
        assert sorted((r.doc_id, r.pattern_no, r.found) for r in found.collect()) == sorted(want)
    t = F.col("text")
    got = docs.select("doc_id", text.redacted(t, LIBRARY_A), text.pattern_count(t, LIBRARY_A), text.any_pattern(t, LIBRARY_A)).orderBy("doc_id").collect()
    counts = [sum(i == k for i, _, _ in want) for k in range(len(texts))]
    assert [tuple(r) for r in got] == [(*r, n, n > 0) for r, n in zip(con.execute(f"select doc_id, {redacted} from documents order by 1").fetchall(), counts, strict=True)]


def test_vault_query_runs_its_kernel_once(spark):
    """The vault with its allow-list is one pass of Python over the texts, not one for each part of the answer."""
    from clauseloom.plans import matches
    from tests.conftest import SMALL

    plan = matches.vault_with_allow_list(spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
