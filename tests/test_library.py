"""The library's queries against their SQL, and operators on literal fixtures."""

import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from clauseloom.functions.patterns import LIBRARY_A, LIBRARY_B0, LIBRARY_C, LIBRARY_T, PLAIN, STOP_TERMS_C
from clauseloom.operators import edits, formats, review, route, rules, score, split, terms, text, variants, vault
from clauseloom.plans import extra, matches, registry  # noqa: F401  matches adds its queries
from clauseloom.sources import readers, replies, writers
from tests.conftest import DATA, SMALL

TABLES = ("documents", "pages", "benchmark", "conversations", "labels")


def rows_of(values):
    return sorted((tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in values), key=repr)


@pytest.mark.parametrize("name", list(registry.ORACLE))
def test_as_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as from '{DATA}/{t}.parquet'")
    df = registry.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    want = con.execute(f"select {', '.join(cols)} from ({registry.ORACLE[name]})").fetchall()
    assert rows_of(df.select(cols).collect()) == rows_of(want)


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE])
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_full_library_on_a_fixture(spark):
    t = "Dr. Smith met Vice President Jones at 12 Long Oak Street. SSN 123-45-6789, EIN 12-3456789, Acct. # 99, $1,000.00, a@b.co, this 3rd day of May, 2024"
    found = {r.label for r in text.findings(spark.createDataFrame([(1, t)], "doc_id int, text string"), LIBRARY_A).collect()}
    assert {"TITLE_NAME", "VP_NAME", "ADDRESS", "SSN", "TAX_ID", "ACCOUNT", "AMOUNT", "EMAIL", "DATE"} <= found
    assert one(spark, text.redacted(F.col("t"), PLAIN, "[LABEL]"), t="ssn 123-45-6789 and a@b.co") == "ssn [SSN] and [EMAIL]"
    assert text.findings(spark.createDataFrame([(1, "9 " + "word " * 6000)], "doc_id int, text string"), LIBRARY_A).count() >= 0


def test_fees_and_allow_list(spark):
    assert one(spark, text.with_reasonable(F.col("t")), t="attorneys' fees, reasonable attorney's fees") == "reasonable attorneys' fees, reasonable attorney's fees"
    none = spark.createDataFrame([], "term string")
    with pytest.raises(Exception, match="allow-list is empty"):
        text.not_allowed(text.tokens(spark.createDataFrame([(1, "Some words")], "doc_id int, text string")), none).collect()


def test_chunk_edges(spark):
    docs = spark.createDataFrame([(1, ""), (2, "a" * 1000), (3, "a" * 1001), (4, None)], "doc_id bigint, text string")
    got = [(r.doc_id, r.chunk_order, r.start_char, r.end_char) for r in split.char_chunks(docs).orderBy("doc_id", "chunk_order").collect()]
    assert got == [(2, 1, 1, 1000), (3, 1, 1, 1000), (3, 2, 1001, 1001)]


def test_bins_and_clauses(spark):
    sections = spark.createDataFrame([(1, 0, "w " * 200), (1, 1, "w " * 100), (1, 2, "w " * 301), (1, 3, "w")], "doc_id bigint, sent_idx int, sentence string")
    assert [r.word_count for r in split.pack_sections(sections).orderBy("chunk_no").collect()] == [300, 301, 1]
    docs = spark.createDataFrame([(1, "1. First clause of it\nmore\n2. Second\na\nb\nc\nd\n\nGENERAL PROVISIONS\nx")], "doc_id bigint, text string")
    assert [(r.clause_number, r.title) for r in split.clauses(split.lines(docs)).orderBy("clause_number").collect()] == [(1, "First clause of it"), (2, "Second"), (3, "d"), (4, "GENERAL PROVISIONS")]


def test_routing_with_a_known_answer(spark):
    pages = {2: "a b", 3: "c", 12: "d", 15: "e a", 46: "a c"}
    words = spark.createDataFrame([(1, p, w) for p, ws in pages.items() for w in ws.split()], "doc_id bigint, page int, word string")
    assert {r.page: r.to_review for r in route.route_within(words).collect()} == {2: True, 3: True, 12: True, 15: True, 46: False}


def test_vault_protects_placeholders_and_restores(spark):
    t = "This is between Acme Company, LLC and John Smith of Acme Company. Call (555) 123-4567, Company, [COMPANY] acme company."
    r = vault.vault(spark.createDataFrame([(1, t)], "doc_id bigint, text string")).withColumn("back", vault.restored(F.col("redacted"), F.col("found"))).first()
    assert r.back == t and "John" not in r.redacted and "4567" not in r.redacted and "Acme" not in r.redacted
    assert "Acme Company, LLC" in vault.entities(t)


def test_edits(spark):
    docs = spark.createDataFrame([(1, "Pay attorney's fees.\nThe Buyer shall RETURN THE papers.\nNo contact with clients.\nBy: ____")], "doc_id bigint, text string")

    def made(k, *e, **f):
        return docs.select("doc_id", F.lit(k).alias("edit_seq"), rules.edit(*e, **f).alias("e")).select("doc_id", "edit_seq", "e.*")

    all_ = made(1, "add_qualifier", "c2", find="attorney's fees", qualifier="reasonable ").union(made(2, "add_qualifier", "c2", find="attorney's fees", qualifier="reasonable ")).union(made(3, "insert_after", "4", find="return the", content=" or destroy the"))
    all_ = all_.union(made(4, "delete_block", "5", quoted="No contact with")).union(made(5, "append_sentence", "c4", content="No duty.")).union(made(6, "swap_phrase", "x", find="absent", replace="y")).union(made(7, "insert_block", "6", anchor_quote="The Buyer shall", content="Costs $5."))
    r = edits.apply_edits(docs, all_).first()
    assert r.text == "Pay reasonable attorney's fees.\nThe Buyer shall RETURN THE or destroy the papers.\nCosts $5.\nNo duty.\nBy: ____"
    assert r.applied == 5 and [x.applied for x in r.log] == [True, False, True, True, True, False, True]


def test_rules_and_thresholds(spark):
    made = rules.generate(registry.facts(spark, SMALL), "January 05, 2024")
    assert {"insert_block", "swap_phrase", "insert_after", "delete_block"} <= {r.type for r in made.select("type").distinct().collect()}
    scores = spark.createDataFrame([(1, "a", 8), (1, "b", 5), (1, "c", 1), (2, "a", 7), (2, "b", 7), (3, "a", 4)], "doc_id bigint, category string, final_score int")
    assert sorted((r.doc_id, r.category) for r in score.apply_thresholds(scores).collect()) == [(1, "a"), (1, "b")]


def test_review_isolates_failures(spark):
    def bad(t):
        if "x" in t:
            raise ValueError("no")
        return "Found it"

    chunks = spark.createDataFrame([(1, 1, "x"), (1, 2, "y")], "doc_id bigint, chunk_order int, content string")
    assert [(r.has_pii, r.error) for r in review.review(chunks, bad).orderBy("chunk_order").collect()] == [(False, "no"), (True, None)]


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok\xff there")
    assert readers.text_files(spark, str(tmp_path), "*.txt").first().text == "ok there"
    (tmp_path / "terms").write_text("# note\n Alpha \n\nbeta\nALPHA\n")
    assert sorted(r.term for r in readers.term_list(spark, str(tmp_path / "terms")).collect()) == ["alpha", "beta"]
    reply = 'Here:\n```json\n[{"line_number": 007, "a": "x"}]\n```\nbye'
    assert one(spark, readers.reply_json(F.col("t"), "array<struct<line_number:int,a:string>>"), t=reply)[0].line_number == 7


def test_term_and_line_readers(spark, tmp_path):
    (tmp_path / "counties").write_text("Name: header\nEss County: x\nno colon\nEss County: y\nAlt Parish:z\n")
    assert sorted(r.term for r in readers.county_terms(spark, str(tmp_path / "counties")).collect()) == ["alt parish", "ess county"]
    docs = spark.createDataFrame([(1, "x\nMARK\n----\nfirst\n\nlast"), (2, "LINE 007: a b\nnone\nLINE 8: c"), (3, "Non-whitelisted words: A, b ,A\nz"), (4, None), (5, "")], "doc_id bigint, text string")
    assert [(r.line_no, r.line) for r in readers.section_lines(docs, "MARK").orderBy("line_no").collect()] == [(4, "first"), (6, "last")]
    assert [(r.line_no, r.line) for r in readers.numbered_lines(docs).orderBy("line_no").collect()] == [(7, "a b"), (8, "c")]
    assert sorted(r.term for r in readers.summary_terms(docs).collect()) == ["A", "b"]


def test_reply_statuses(spark):
    assert [tuple(r) for r in one(spark, score.reply_patterns(F.col("t")), t="Pattern 1: FOUND - a\nPattern 12: NOT FOUND - b")] == [(1, True), (12, False)]
    assert [tuple(r) for r in one(spark, score.reply_intents(F.col("t")), t="INTENT 1 x\nINTENT 2: y\nStatus: MISSING\nINTENT 3\nStatus: FULLY")] == [(2, "MISSING"), (3, "FULLY")]


def test_search_ladder(spark):
    def hit(t, p):
        return one(spark, edits.laddered(F.col("t"), F.lit(p)), t=t)

    assert hit("Any Text", "any text") == "Any Text" and hit("a b.c d", "b.c\t\td") == "b.c d"
    assert hit("one\n  TWO (x) three", "one two (x)") == "one\n  TWO (x)" and hit("abc", "a.c") is None and hit("abc", "") is None

    def flexible(t, p):
        return one(spark, edits.flexible_hit(F.col("t"), F.lit(p)), t=t)

    assert flexible("the receiving party shall not disclose", "[NAME_1] receiving party shall never") == "receiving party shall"
    assert flexible("only disclosure here", "with that disclosure") == "disclosure" and flexible("none", "with that") is None


def test_nearest_paragraphs(spark):
    paras = spark.createDataFrame([(1, k, t) for k, t in enumerate(["x", "find me", "y", "find me", "z", "w", "v", "far off"], 1)], "doc_id bigint, para_no int, text string")
    asked = spark.createDataFrame([(1, 1, 4, "find me"), (1, 2, 3, "find me"), (1, 3, 1, "far off"), (1, 4, 1, "absent"), (1, 5, 1, None), (1, 6, 1, "")], "doc_id bigint, edit_seq int, line_number int, find string")
    assert [r.para_no for r in edits.nearest_paragraphs(asked, paras).orderBy("edit_seq").collect()] == [4, 2, 8, None, None, None]


def test_line_edits(spark):
    lines = spark.createDataFrame([(1, 1, "a a"), (1, 2, "b" * 50 + "!"), (1, 3, None)], "doc_id bigint, line_no int, text string")
    rows = [(1, 1, "replace_text_on_line", 1, "a", "c", None), (1, 2, "replace_text_on_line", 2, "b" * 60, "whole", None), (1, 3, "insert_after_line", 1, None, None, "p"), (1, 4, "insert_after_line", 1, None, None, "q"), (1, 5, "insert_at_end", None, None, None, "e"), (1, 6, "insert_after_line", 9, None, None, "lost")]
    changes = spark.createDataFrame(rows, "doc_id bigint, seq int, change_type string, line_number int, find string, replace string, content string")
    out = edits.apply_line_edits(lines, changes).orderBy("position").collect()
    assert [(r.line_no, r.text, r.modified) for r in out] == [(1, "c c", True), (None, "q", True), (None, "p", True), (2, "whole", True), (3, "", False), (None, "e", True)]


def test_more_libraries(spark):
    t = "Ann Lee, 12 Oak Street, Reno, NV 12345, of ACME TRADING LLC wrote on May 5, 2020 to a@b.co; This Party"
    assert one(spark, text.redacted(F.col("t"), LIBRARY_B0, "[LABEL]", ""), t=t).startswith("[PERSON], [ADDRESS], of [COMPANY]")
    found = text.unguarded(text.findings(spark.createDataFrame([(1, t)], "doc_id bigint, text string"), LIBRARY_C, flags=""), STOP_TERMS_C)
    assert {"COMPANY", "ADDRESS", "DATE", "NAME"} == {r.label for r in found.collect()} and "This Party" not in {r.found for r in found.collect()}
    assert "[EMAIL]" in one(spark, text.redacted(F.col("t"), LIBRARY_T, "[LABEL]", ""), t=t)


def test_followup_over_the_whole_text(spark, tmp_path):
    t = "x" * 400 + " 123-45-6789 title of 123-45-6789 Company and 123-45-6789 name"
    spark.createDataFrame([(1, "s", t)], "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    want = "x" * 400 + " [REDACT] [REDACT] of [REDACT] [REDACT] and [REDACT] name"
    assert [tuple(r) for r in registry.redaction_followup(spark, str(tmp_path)).select("redacted_sha", "n").collect()] == [(hashlib.sha256(want.encode()).hexdigest(), len(want))]


def test_full_library_in_queries(spark, tmp_path):
    lead = " ".join(["plain"] * 500)
    flagged = ["Dr. Smith", "Reno, NV 12345", "Routing # 123456789", "Alpha Beta Gamma", "Alpha Beta Beta", "plain"]
    docs = [(k, "s", f"{lead} {x} {' '.join(['plain'] * (500 - len(x.split())))} plain") for k, x in enumerate(flagged)]
    spark.createDataFrame([*docs, (8, "s", "plain"), (9, "s", "plain")], "doc_id bigint, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.doc_id, r.chunk_order): r.flagged for r in registry.pii_page_selection_full(spark, str(tmp_path)).collect()}
    assert {d for (d, c), f in got.items() if c == 2 and f} == {0, 1, 2, 3}
    assert all((k, 1) in got and (k, 3) in got for k in range(6)) and (4, 2) not in got and (5, 2) not in got
    assert {"TITLE_NAME", "CITY_STATE_ZIP", "ROUTING"} <= {r.label for r in registry.pattern_counts_full_library(spark, str(tmp_path)).collect()}
    want = {}
    for i, _, t in docs:
        for _, p in LIBRARY_A:
            t = re.sub(p, "[REDACTED]", t, flags=re.IGNORECASE | re.ASCII)
        want[i] = hashlib.sha256(t.encode()).hexdigest()
    out = {r.doc_id: r.redacted_sha for r in registry.sequential_redaction_full_library(spark, str(tmp_path)).collect()}
    assert {i: out[i] for i in want} == want and out[0] != hashlib.sha256(docs[0][2].encode()).hexdigest()


def plain_mhtml(content):
    """The reference's rules, line by line."""
    kept, skip = [], False
    for line in content.split("\n"):
        if text.BINARY in line:
            skip = True
        elif line.startswith("------") and "Boundary" in line:
            skip = False
        elif not skip:
            skip = any(m in line.lower() for m in text.BINARY_MARKERS)
            if not skip:
                kept.append(line)
    parts = "\n".join(kept)
    t = re.sub("=([0-9A-F]{2})", lambda m: chr(int(m[1], 16)), re.sub("=\r?\n", "", parts))
    return parts, re.sub(r"\s+", " ", re.sub("&[a-zA-Z0-9#]+;", " ", re.sub("<[^>]+>", " ", t)))


def test_saved_pages(spark):
    lines = ["keep =3D=93=e9 <b>x</b>&amp;y", "Content-Transfer-Encoding: base64", "AAAA", "------MultipartBoundary--x", "------Boundary " + text.BINARY, "content-type: IMAGE/png", "soft=", "=A0=1Cb=0", "a=3D3D", "", "------other", "WebKit-x"]
    rng = random.Random(5)
    made = ["", "\n", "a=\n", "=3D", "\n".join(lines), *("\n".join(rng.choices(lines, k=rng.randint(1, 14))) for _ in range(300))]
    df = spark.createDataFrame(list(enumerate(made)), "k int, t string")
    got = {r.k: (r.parts, r.out) for r in df.select("k", text.text_parts(F.col("t")).alias("parts"), text.mhtml_to_text(F.col("t")).alias("out")).collect()}
    assert got == {k: plain_mhtml(t) for k, t in enumerate(made)}


def test_binary_parts_go(spark, tmp_path):
    html = "keep one\nContent-Transfer-Encoding: base64\nAAAA\n------MultipartBoundary--x\nkeep two\ncontent-type: IMAGE/png\ndropped"
    spark.createDataFrame([(1, html), (2, "keep three"), (3, None)], "page_id bigint, html string").write.parquet(str(tmp_path / "pages.parquet"))
    md5 = {hashlib.md5(line.encode()).hexdigest(): line for line in html.split("\n") + ["keep three"]}
    got = {(r.page_id, r.line_no, md5[r.line_md5]) for r in registry.mime_part_skip(spark, str(tmp_path)).collect()}
    assert got == {(1, 1, "keep one"), (1, 5, "keep two"), (2, 1, "keep three")}


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() >= 0 and set(e.oracle_sql()) <= set(e.queries())


def test_libraries_as_pythons_expressions(spark):
    """The libraries without SQL, on all documents: the same matches in Python, whose word borders know accented letters too."""
    docs = dict(duckdb.execute(f"select doc_id, text from '{DATA}/documents.parquet'").fetchall())

    def trial(t):
        for label, p in LIBRARY_T:
            t = re.sub(p, f"[{label}]", t)
        return t

    def counted(t):
        out, n = t, 0
        for label, p in LIBRARY_C:
            for m in re.finditer(p, t):
                if not any(s in m[0].lower() for s in STOP_TERMS_C):
                    n += 1
                    out = out.replace(m[0], f"[{label}_{n}]", 1)
        return out, n

    got = {r.doc_id: r.redacted_sha for r in extra.trial_library_redaction(spark, DATA).collect()}
    want = {i: hashlib.sha256(trial(t).encode()).hexdigest() for i, t in docs.items()}
    assert [i for i in want if got[i] != want[i]] == []
    made = {r.doc_id: (r.redacted_sha, r.found) for r in extra.counted_placeholders(spark, DATA).collect()}
    want = {i: counted(t) for i, t in docs.items()}
    assert [i for i, (t, n) in want.items() if made[i] != (hashlib.sha256(t.encode()).hexdigest(), n)] == []


def test_counted_placeholders_on_a_fixture(spark):
    x = terms.counted_placeholders(F.col("t"), LIBRARY_C, STOP_TERMS_C)
    t = "John Smith met Jane Doe on March 3, 2024; John Smith of the Other Party left."
    r = one(spark, x, t=t)
    assert r.text == "[NAME_2] met [NAME_3] on [DATE_1]; [NAME_4] of the Other Party left." and len(r.found) == 4


def test_text_formats(spark):
    assert one(spark, formats.rejoined(F.col("t")), t="a protective order\r\n\n or other remedy b") == "a protective order or other remedy b"
    assert one(spark, formats.cleaned(F.col("t")), t='junk<html><p class="x">A =93b=94&nbsp;c</p><br>d<i>e</i>') == 'A "b" c\nde'
    assert one(spark, formats.emboldened(F.col("t")), t="x (the Seller) y") == "x <b>(the Seller)</b> y"
    assert one(spark, formats.reply_body(F.col("t")), t="Here it is\n\n  one \ntwo") == "one\ntwo" and one(spark, formats.reply_body(F.col("t")), t="Here") == "Here"
    assert one(spark, formats.reply_names(F.col("t")), t="The names:\n- Acme LLC\n* ab\nLongname") == ["Acme LLC", "Longname"]
    assert one(spark, formats.prompt_head(F.col("t"), 3), t="abcdef") == "abc" and one(spark, formats.blank_line_paragraphs(F.col("t"), 2), t="a\n\nb\n\nc") == ["a", "b"]


def test_edit_variants(spark):
    assert one(spark, variants.surgical(F.col("a"), F.lit("alpha beta gamma delta eps zeta"), F.lit("X")), a="one two three four alpha beta gamma delta eps ZETA y z w") == "one X w"
    assert one(spark, variants.surgical(F.col("a"), F.lit("nowhere"), F.lit("X")), a="text") is None
    assert one(spark, variants.four_steps(F.col("a"), F.lit("b\tc  d"), F.lit("X")), a="a B c d e") == "a X e"
    assert one(spark, variants.inserted_by_name(F.col("a"), F.lit("Exclusions"), F.lit("new")), a="It shall not include that.") == "It shall not include new that."
    runs = one(spark, variants.redline(F.col("a"), F.lit("old"), F.lit("new")), a="an old hat, old")
    assert [(r.kind, r.text) for r in runs] == [("before", "an "), ("deleted", "old"), ("inserted", "new"), ("after", " hat, old")]
    found = vault.vault(spark.createDataFrame([(1, "Call (555) 123-4567 now.")], "doc_id bigint, text string"))
    x = variants.four_outputs(F.col("redacted"), F.replace("redacted", F.lit("now"), F.lit("later")), lambda t: vault.restored(t, F.col("found")))
    r = found.select(x.alias("x")).first().x
    assert r.restored_before == "Call (555) 123-4567 now." and r.restored_after == "Call (555) 123-4567 later." and "555" not in r.redacted_after


def test_vault_rows_and_odd_names(spark):
    """Expected rows, not only a round trip: separators and names in any case, broken lines, accents, literal marks in the text."""
    t = "made BY AND BETWEEN Acme Widget\nCompany and O\u2019Brien Holdings. Later, acme widget company, [ZIP:00000000.0] and [ZIP:0011aabb.1]."
    r = vault.vault(spark.createDataFrame([(1, t)], "doc_id bigint, text string")).withColumn("back", vault.restored(F.col("redacted"), F.col("found"))).first()
    assert r.back == t and [(f.type, f.original) for f in r.found] == [("COMPANY", "Acme Widget\nCompany"), ("COMPANY", "O\u2019Brien Holdings."), ("COMPANY", "acme widget company")]
    assert all(f.placeholder in r.redacted for f in r.found)


def test_switches_and_templates(spark):
    facts = registry.facts(spark, SMALL).filter("doc_id < 40")
    every = rules.generate(facts, "d").groupBy("category").count().collect()
    off = spark.createDataFrame([("6_term", False), ("c1", True)], "category string, enabled boolean")
    some = {r.category for r in rules.generate(facts, "d", off).collect()}
    assert some == {r.category for r in every} - {"6_term"}
    words = rules.generate(facts, "d", texts={"no_obligation": "{receiver} may walk."}, circumvention="for one year")
    assert {r.content for r in words.filter("category = 'c4'").collect()} == {"Buyer may walk."}
    assert {(r.type, r.content) for r in words.filter("category = '5_non_circumvention'").collect()} == {("insert_words", "for one year")}


def test_sources_and_sinks(spark, tmp_path):
    import io
    import json
    import zipfile

    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>One</w:t><w:t> two</w:t></w:p><w:p/><w:p><w:t>Three</w:t></w:p></w:document>'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", xml)
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.docx").write_bytes(raw.getvalue())
    (tmp_path / "in/b.docx").write_bytes(b"broken")
    (tmp_path / "in/c_REDACTED.docx").write_bytes(raw.getvalue())
    where = str(tmp_path / "in")
    got = {r.path[-6:]: (r.text, r.error is None) for r in readers.unprocessed(readers.docx_text(spark, where)).collect()}
    assert got == {"a.docx": ("One two Three", True), "b.docx": ("", False)}
    (tmp_path / "c.json").write_text(json.dumps({"rules": {"6_term": {"enabled": False}, "c1": True}}))
    config = readers.configuration(spark, str(tmp_path / "c.json"))
    assert {(r.category, r.enabled) for r in readers.rule_switches(spark, config).collect()} == {("6_term", False), ("c1", True)}
    (tmp_path / "m.json").write_text(json.dumps({"original_file": "x", "chunks": [{"order": 1, "filename": "f1"}, {"order": 2, "filename": "f2"}]}))
    assert [tuple(r) for r in readers.mapping_entries(spark, str(tmp_path / "m.json")).select("original_file", "order").orderBy("order").collect()] == [("x", 1), ("x", 2)]
    reply = spark.createDataFrame([(1, 'Sure:\n```json\n[{"find": "a", "new": "b"}, {"find": "c", "new": "d"}]\n```\nDone [1]'), (2, "none")], "doc_id int, text string")
    assert [tuple(r) for r in replies.recommendations(reply, "find:string,new:string").orderBy("seq").collect()] == [(1, 1, "a", "b"), (1, 2, "c", "d")]
    chunks = split.char_chunks(spark.createDataFrame([(1, "x" * 1500)], "doc_id bigint, text string"))
    writers.write_chunks(chunks, str(tmp_path / "out"), "doc_id")
    assert "doc_id=1" in {p.name for p in (tmp_path / "out/chunks").iterdir()} and '"total_chunks":2' in spark.read.parquet(str(tmp_path / "out/mapping")).first().mapping
    applied = spark.createDataFrame([(1, "6_term", 9, 1, 12), (1, "c1", 3, 3, 12)], "doc_id bigint, category string, final_score int, band int, total bigint")
    assert json.loads(writers.analysis_json(applied).first().analysis) == {"total": 12, "categories": [{"band": 1, "category": "6_term", "final_score": 9}, {"band": 3, "category": "c1", "final_score": 3}]}
    assert "| 6_term | 9 | 1 |" in writers.score_report(applied).first().report
    assert one(spark, writers.redaction_summary(F.col("t"), F.array(F.lit(1), F.lit(2))), t="x").endswith("Total redactions: 2\n")
    writers.write_final(chunks, str(tmp_path / "final"))
    assert writers.logged(chunks, "chunks", str(tmp_path / "run")).count() == 2 and spark.read.parquet(str(tmp_path / "run/run_log")).first().rows == 2
