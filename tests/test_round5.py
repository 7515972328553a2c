"""What the third round's projections showed: steps whose shuffles or time were many times their input."""

import inspect
import random
import re

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clauseloom.functions import batches
from clauseloom.operators import edits, rare, rules, terms, worddiff
from clauseloom.plans import extra, registry  # noqa: F401  extra adds its queries to the registry
from clauseloom.sources import docx, pdf


def drawn(seed: int = 5, n: int = 60) -> list[tuple]:
    """Documents of few and many words, repeated texts, markers, words in several cases, empty and null texts and ids."""
    r = random.Random(seed)
    word = lambda: r.choice(["the", "The", "of", "to", f"w{chr(97 + r.randrange(26))}{chr(97 + r.randrange(3))}", f"Xq{chr(97 + r.randrange(26))}", "[NAME]", "[XQA]", "xqa", "straße", "K", "1,5"])
    rows = [(k, "".join(word() + r.choice([" ", " ", ". ", "\n", "! ", "-"]) for _ in range(r.randrange(0, 90)))) for k in range(n)]
    return [*rows, (n, rows[3][1]), (n + 1, rows[4][1]), (n + 2, ""), (n + 3, None), (None, "alone Xqz the zebra"), (None, rows[5][1])]


def held(rows: list[tuple]):
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", rows)
    return con


def saved(spark, rows: list[tuple], path) -> str:
    spark.createDataFrame([(i, "s", t) for i, t in rows], "doc_id bigint, source string, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    return str(path)


@pytest.mark.parametrize("most", [rare.MOST_TERMS, 3])
def test_rare_words_are_those_off_the_list(spark, monkeypatch, most):
    """Against the list itself, with memory for all terms and for three."""
    rows = drawn()
    monkeypatch.setattr(rare, "MOST_TERMS", most)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    ids: dict[str, set] = {}
    for i, t in rows:
        for w in re.findall("[A-Za-z]+", t or ""):
            ids.setdefault(w.lower(), set()).update([] if i is None else [i])
    assert {r.term for r in rare.common_terms(docs).collect()} == {w for w, own in ids.items() if len(own) >= 5}
    for markers in (True, False):
        off = [sorted({w for w in re.findall("[A-Za-z]+", re.sub(r"\[[A-Z_]+\]", " ", t or "") if markers else t or "") if len(w) > 2 and len(ids[w.lower()]) < 5}) for _, t in rows]
        got = sorted(((r.doc_id is None, r.doc_id or 0, r.text or ""), r.flagged) for r in terms.with_rare(docs, 5, markers=markers).collect())
        assert got == sorted(((i is None, i or 0, t or ""), own) for (i, t), own in zip(rows, off, strict=True))
    if most == 3:
        return
    frequent = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("the same five words").alias("text")).coalesce(2)
    assert rare.occurrences(frequent).groupBy("term").count().filter("count > 10").count() == 0  # five rows a task


@pytest.mark.parametrize("name", ["allow_list_redaction", "flagged_sentences", "risk_bin_packing", "selective_content", "learned_terms_applied"])
def test_words_are_not_shuffled_for_each_place(spark, tmp_path, name):
    """The same rows as the SQL's; the plan has neither the list nor words by sentence, which were shuffled before."""
    rows = [r for r in drawn() if r[0] is not None and r[1] is not None]
    out = registry.QUERIES[name](spark, saved(spark, rows, tmp_path))
    want = held(rows).execute(registry.ORACLE[name]).fetchall()
    assert sorted(map(tuple, out.collect())) == sorted(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "count(distinct" not in plan and "LeftAnti" not in plan


def test_an_edit_lowers_a_text_once(spark):
    """A text's lower case and a hit's place were computed again by each branch; the last search was made over every text."""
    docs = spark.createDataFrame([(1, "Sign\t a  SEPARATE Straße"), (2, "sign nothing"), (3, "ΟΔΟΣ  x straSSE"), (4, ""), (5, None), (6, "By: me, sign a separate")], "doc_id int, text string")
    found = docs.select("doc_id", *(edits.laddered(F.col("text"), F.lit(p)).alias(p) for p in ("sign a separate", "straße", "ΟΔΟΣ x", "", " "))).orderBy("doc_id").collect()
    assert [tuple(r)[1:] for r in found] == [("Sign\t a  SEPARATE", "Straße", None, None, " "), (None, None, None, None, " "), (None, None, "ΟΔΟΣ  x", None, " "), (None,) * 5, (None,) * 5, ("sign a separate", None, None, None, " ")]
    made = [rules.edit("swap_phrase", "x", find="sign a separate", replace="S"), rules.edit("insert_after", "x", find="s", content="+"), rules.edit("append_sentence", "x", content="END")]
    own = docs.select("doc_id", F.posexplode(F.array(*made)).alias("edit_seq", "e")).select("doc_id", "edit_seq", "e.*")
    out = edits.apply_edits(docs, own)
    assert {r.doc_id: (r.text, r.applied) for r in out.collect()} == {1: ("S+ Straße\nEND", 3), 2: ("s+ign nothing\nEND", 2), 3: ("ΟΔΟΣ  x s+traSSE\nEND", 2), 4: ("\nEND", 1), 5: (None, 0), 6: ("END\nBy: me, S+", 3)}
    plan = out._jdf.queryExecution().analyzed().toString()
    assert plan.count("lower(") < 40


@pytest.mark.parametrize("name", ["new_vs_repeated_terms", "new_term_share", "learn_then_apply_within_doc", "approach_comparison", "early_introduction"])
def test_terms_by_page_do_not_shuffle_words(spark, tmp_path, name):
    """Rows that share an id or have none are one document, as in the SQL; words were shuffled twice before."""
    r = random.Random(3)
    word = lambda: r.choice("aZ") + r.choice("bcdefghijK") + r.choice("lmnopqrst")
    rows = [(i, " ".join(word() for _ in range(n))) for i, n in ((1, 1700), (2, 500), (3, 501), (3, 1200), (4, 0), (None, 30), (None, 700), (5, 1))]
    out = registry.QUERIES[name](spark, saved(spark, rows, tmp_path))
    want = held(rows).execute(registry.ORACLE[name]).fetchall()
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, want))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan.lower()


def test_kernels_take_batches_in_pieces():
    """A whole batch of 10,000 documents' runs became Python objects at once."""
    batch = pa.RecordBatch.from_pydict({"x": list(range(1000))})
    parts = list(batches.pieces([batch, batch.slice(0, 0), batch.slice(0, 5)]))
    assert max(p.num_rows for p in parts) == 64 and [x for p in parts for x in p.column(0).to_pylist()] == [*range(1000), *range(5)]
    for kernel in (worddiff.word_diff, docx.docx_files, docx._read, pdf.pdf_files, pdf.pdf_pages):
        assert "pieces(batches)" in inspect.getsource(kernel)


def test_a_words_width_is_counted_once():
    units = pdf.units_of(pdf.CONTRACT)
    text = "Ünder \x7f the (AGREEMENT) ~"
    assert units[text] == sum(pdf.TIMES[ord(c) - 32] if 32 <= ord(c) < 127 else 500 for c in text) and dict.__contains__(units, text)
    assert pdf.width_of(text, pdf.CONTRACT, 9, True) == units[text] * 9 / 1000 * pdf.BOLDER
