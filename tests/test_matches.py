"""Offsets, term lists, runs, word differences, and the splitters on very long texts."""

import random
import re
import time

import duckdb
import pytest
from pyspark.sql import functions as F

from clauseloom.functions.patterns import FIRST_WORD_ONLY, LIBRARY_A, in_java
from clauseloom.operators import edits, rules, runs, spans, split, terms, text, worddiff
from tests.conftest import DATA


def test_offsets_as_python_finds_them(spark):
    """The whole library over texts of ASCII letters, where all dialects agree; null and repeated ids keep their own rows."""
    texts = [t for (t,) in duckdb.execute(f"select text from '{DATA}/documents.parquet'").fetchall() if t.isascii()][:150]
    rows = [(k % 100 if k % 7 else None, t) for k, t in enumerate(texts)] + [(1, None), (1, "")]
    rows.append((500, "SSN 123-45-6789,123-45-6789 and a@b.co; a@b.co 😀 Dr. Smith $5 at 12 Oak Street"))
    out = spans.located(spark.createDataFrame(rows, "doc_id bigint, text string"))
    got = sorted(((r.doc_id, r.pattern_no, r.start, r.end, r.found) for r in out.collect()), key=repr)
    want = [(i, k, m.start(), m.end(), m[0]) for i, t in rows for k, (_, p) in enumerate(LIBRARY_A) for m in re.finditer(p, t or "", re.IGNORECASE | re.ASCII)]
    assert got == sorted(want, key=repr) and len(got) > 15


def test_first_word_forms_match_alike(spark):
    """The quicker forms find and replace what the library's own patterns do, on texts made of all that could tell them apart."""
    draw = random.Random(3)
    parts = ["a", "Bc", "NY", "x" * 30, "y" * 31, "Limited Partnership", "limited  partnership", "Partnership", " ", " ", " ", "    ", "     ", "\n", ",", ", ", "&", " & ", "1", "12345", " ny 12345", ", Ny 12345-6789", "_", "é", "e\u0301", "-", "[REDACTED]"] + [" ny 12345", ", Ny 12345-6789", " Limited Partnership"] * 2
    rows = [(k, "".join(draw.choices(parts, k=draw.randint(2, 24)))) for k in range(40_000)]
    docs = spark.createDataFrame(rows, "id int, t string")
    assert len(FIRST_WORD_ONLY) == 3
    for own, quick in FIRST_WORD_ONLY.items():
        assert in_java(own, "(?i)") == "(?i)" + quick and in_java(own, "") == own
        found = [F.regexp_extract_all("t", F.lit("(?i)" + p), F.lit(0)) for p in (own, quick)]
        put = [F.regexp_replace("t", "(?i)" + p, "[R]") for p in (own, quick)]
        n, unlike = docs.agg(F.count_if(F.size(found[0]) > 0), F.count_if((found[0] != found[1]) | (put[0] != put[1]))).first()
        assert n > 1000 and unlike == 0


def test_redacting_long_runs_of_words(spark):
    """A million characters without a stop: the time of a pattern doesn't grow with the square of a run."""
    one = spark.range(1).select(F.concat(F.repeat(F.lit("lorem ipsum dolor "), 56_000), F.lit("Springfield IL 62701, Acme Limited Partnership")).alias("text"))
    library = [(label, p) for label, p in LIBRARY_A if label in ("CITY_STATE_ZIP", "LIMITED_PARTNERSHIP")]
    begun = time.time()
    assert one.select(text.redacted(F.col("text"), library)).first()[0] == "[REDACTED], [REDACTED]"
    assert time.time() - begun < 30


def brute_terms(text, listed):
    pattern = r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, listed), key=lambda t: -len(t))) + r")(?!\w)"
    return re.sub(pattern, "[REDACTED]", text, flags=re.IGNORECASE)


@pytest.mark.parametrize("part_bytes", [spans.PART_BYTES, 40])
def test_listed_terms_against_one_expression(spark, part_bytes):
    """One part and many; phrases, terms within others, cases, other scripts, borders; null and empty texts."""
    listed = ["Acme", "acme holdings", "Acme Holdings LLC", "été", "Straße", "a-b", "x_1", "ßx", "Long Name Of A Firm", "q"]
    r = random.Random(1)
    words = ["ACME", "Holdings", "LLC", "ÉTÉ", "straße", "a-b", "a-bc", "x_1", "x_12", "İq", "q", "long name of a firm", "Acmes", "the"]
    rows = [(k, " ".join(r.choice(words) for _ in range(r.randint(1, 30)))) for k in range(200)] + [(None, "acme"), (7, None), (7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    table = spark.createDataFrame([(t,) for t in [*listed, "acme", None, ""]], "term string")
    out = spans.listed_redacted(df, table, 1, part_bytes=part_bytes).collect()
    assert len(out) == len(rows)
    for x in out:
        assert x.redacted == (None if x.text is None else brute_terms(x.text, listed))
        assert all(x.text[s.start : s.end].lower() == s.term for s in x.spans)
    assert [x.redacted for x in spans.listed_redacted(df, table.limit(0)).collect()] == [x.text for x in out]


def test_a_hundred_thousand_terms(spark):
    table = spark.range(100_000).select(F.concat(F.lit("Firm "), F.col("id").cast("string"), F.lit(" Ltd")).alias("term"))
    df = spark.range(300).select(F.concat(F.lit("with firm "), (F.col("id") * 997).cast("string"), F.lit(" LTD, firm 12")).alias("text"))
    out = spans.listed_redacted(df, table, part_bytes=400_000).collect()
    assert sum(len(x.spans) for x in out) == sum(k * 997 < 100_000 for k in range(300)) and out[3].redacted == "with [REDACTED], firm 12"


def test_runs_keep_their_style(spark):
    own = [(1, 1, 1, "Call Ann ", "b"), (1, 1, 2, "Lee or An", "i"), (1, 1, 3, "n Lee, AnnLee", "u"), (1, 2, 1, "none", "b"), (1, 3, 1, "", "b"), (1, 3, 2, None, "i"), (1, 3, 3, "aaaa", "i"), (None, 1, 1, "Ann Lee", "b"), (2, 1, 1, "Ann Lee", "b"), (1, 4, 1, "x", "1"), (1, 4, 2, "Ann ", "2"), (1, 4, 3, "Le", "3"), (1, 4, 4, "e", "4"), (1, 4, 5, "y", "5")]
    changes = [(1, 2, "Lee", "[L]"), (1, 1, "Ann Lee", "[P]"), (1, 3, "aa", "[A]"), (1, 4, "", "[never]"), (None, 1, "Ann", "[N]"), (9, 1, "Ann", "[X]")]
    out = runs.apply_to_runs(spark.createDataFrame(own, "doc_id int, para_no int, run_no int, text string, style string"), spark.createDataFrame(changes, "doc_id int, seq int, original string, placeholder string"))
    got = {(r.doc_id, r.para_no, r.run_no): (r.text, r["style"]) for r in out.collect()}
    assert got[1, 1, 1] == ("Call [P]", "b") and got[1, 1, 2] == (" or [P]", "i") and got[1, 1, 3] == (", Ann[L]", "u")
    assert got[1, 2, 1] == ("none", "b") and got[1, 3, 1] == ("", "b") and got[1, 3, 3] == ("[A][A]", "i")
    assert got[None, 1, 1] == ("[N] Lee", "b") and got[2, 1, 1] == ("Ann Lee", "b")
    assert [got[1, 4, k] for k in range(1, 6)] == [("x", "1"), ("[P]", "2"), ("", "3"), ("", "4"), ("y", "5")]
    assert len(got) == len(own)


def test_runs_joined_equal_the_paragraph_replaced():
    r = random.Random(2)
    for _ in range(500):
        text = "".join(r.choice("abAB ") for _ in range(r.randint(0, 60)))
        new = {"ab": "[1]", "ba ": "[2]", "aab": "", "B": "[4]"}
        cuts = sorted(r.randint(0, len(text)) for _ in range(r.randint(0, 12)))
        parts = [text[a:b] for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True)]
        turn = {x: i for i, x in enumerate(new)}
        found = runs.chosen(text, runs.Exact(list(new)).find(text), turn)
        want, at = "", 0
        for a, b, x in found:
            want += text[at:a] + new[x]
            at = b
        assert "".join(runs.rewritten(parts, found, new)) == want + text[at:]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0, *(0 for _ in b)] if not row else row
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_word_diff_is_a_least_script():
    r = random.Random(3)
    for _ in range(400):
        a, b = ([r.choice("abcdef"[: r.randint(1, 6)]) for _ in range(r.randint(0, 14))] for _ in "ab")
        s = worddiff.script(a, b)
        assert [w for k, ws in s if k in " -" for w in ws] == a and [w for k, ws in s if k in " +" for w in ws] == b
        assert sum(len(ws) for k, ws in s if k == " ") == lcs(a, b)
        assert all(x[0] != y[0] for x, y in zip(s, s[1:], strict=False))


def test_word_diff_of_long_texts():
    """Two far changes stay apart; a hundred thousand words with many changes, most of them of the same few words."""
    r = random.Random(4)
    a = [f"w{r.randrange(500)}" for _ in range(100_000)]
    b = list(a)
    b[10] = "new"
    del b[99_000]
    assert [(k, len(ws)) for k, ws in worddiff.script(a, b)][:4] == [(" ", 10), ("-", 1), ("+", 1), (" ", 98_989)]
    for _ in range(3000):
        b[r.randrange(len(b))] = f"w{r.randrange(500)}"
    start = time.monotonic()
    s = worddiff.script(a, b)
    assert time.monotonic() - start < 60 and [w for k, ws in s if k in " +" for w in ws] == b
    assert sum(len(ws) for k, ws in s if k == " ") >= 97_000 - 2


def test_unified_view(spark):
    rows = [(1, "a b c d e f g h i j k", "a b c d X f g h i j k"), (2, "same words", "same words"), (3, None, "new"), (4, "old", None), (5, "", None)]
    out = worddiff.word_diff(spark.createDataFrame(rows, "id int, old_text string, new_text string")).select("id", worddiff.unified(F.col("runs"), 2).alias("u"))
    got = {r.id: r.u for r in out.collect()}
    assert got[1] == ["...", " c", " d", "-e", "+X", " f", " g", "..."] and got[2] == [] and got[3] == ["+new"] and got[4] == ["-old"] and got[5] == []


def test_allow_list_redaction_fails_closed(spark):
    """Rows with null and repeated ids are redacted as any other; so are pages of learned terms and flagged sentences."""
    allow = spark.createDataFrame([("and",), ("the",), ("cat",)], "term string")
    rows = [(None, "Zebra and the cat"), (1, "Zebra and the cat"), (1, "Horse and the cat"), (2, None), (2, ""), (None, "the [REDACT] cat")]
    out = terms.allow_list_redacted(spark.createDataFrame(rows, "doc_id bigint, text string"), allow)
    got = sorted(((r.doc_id, r.redacted, tuple(r.flagged)) for r in out.collect()), key=repr)
    both = [(None, "[REDACTED] and the cat", ("Zebra",)), (1, "[REDACTED] and the cat", ("Zebra",)), (1, "[REDACTED] and the cat", ("Horse",)), (2, None, ()), (2, "", ()), (None, "the [REDACT] cat", ())]
    assert got == sorted(both, key=repr)
    pages = spark.createDataFrame([(None, 1, "Zebra and"), (3, 1, "Zebra and"), (3, 2, "Zebra")], "doc_id bigint, page int, content string")
    routed = spark.createDataFrame([(3, 2, True), (None, 1, False)], "doc_id bigint, page int, to_review boolean")
    assert sorted((r.doc_id or 0, r.page, r.redacted) for r in terms.learned_terms_applied(pages, allow, routed).collect()) == [(0, 1, "[REDACTED] and"), (3, 1, "[REDACTED] and"), (3, 2, "Zebra")]
    long = "the cat and the cat and the cat. " * 30 + "A Zebra stood there with the cat. " + "the cat and the cat and the cat. " * 30
    kept = split.flagged_sentences(spark.createDataFrame([(None, long), (4, long)], "doc_id bigint, text string"), allow)
    assert [r.doc_id for r in kept.filter(F.contains("sentence", F.lit("Zebra"))).orderBy("doc_id").collect()] == [None, 4]


def test_words_redacted_with_many_flagged_words(spark):
    ws = [f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(3000)]
    df = spark.createDataFrame([(" ".join(ws), sorted(ws[::2]))], "t string, flagged array<string>")
    assert df.select(terms.words_redacted(F.col("t"), F.col("flagged"), "#").alias("x")).first().x == " ".join("#" if k % 2 == 0 else w for k, w in enumerate(ws))


def test_splitters_on_a_text_of_ten_million_characters(spark):
    """Each splitter within a minute; a pass for each piece over the whole text would take hours."""
    text = "Some words of a sentence that is long enough. " * 220_000
    lines = "1. first line\nsecond line\nthird\n\nFOURTH LINE OF CAPITALS\nmore\n" * 20_000
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string").coalesce(1)
    start = time.monotonic()
    chunks = split.char_chunks(df).agg(F.count("*"), F.sum("char_count"), F.max("end_char")).first()
    assert tuple(chunks) == (-(-len(text) // 1000), len(text), len(text))
    assert spans.located(df, [("NUMBER", r"\d+")]).count() == 0
    sentences = split.risk_sentences(df, F.lit(True))
    packed = split.pack_sections(sentences).agg(F.count("*"), F.sum("word_count"), F.max("word_count")).first()
    assert packed[1] == 9 * 220_000 and packed[2] <= 300 and packed[0] == -(-220_000 // 33)
    clauses = split.clauses(split.lines(spark.createDataFrame([(1, lines)], "doc_id bigint, text string"))).agg(F.count("*")).first()[0]
    assert clauses == 2 * 20_000
    assert time.monotonic() - start < 180


def test_clauses_as_a_fold(spark):
    r = random.Random(5)
    rows = [(k, "\n".join(r.choice(["1. One", "plain", "", "A HEADING OF CAPITALS", "  22.x", "more text"]) for _ in range(r.randint(0, 40)))) for k in range(60)]

    def fold(text):
        done, now = [], []
        for line in (x.strip(" ") for x in text.split("\n")):
            if line:
                if now and (re.match(r"\d+\.", line) or re.match(r"[A-Z][A-Z\s]{10,}", line) or len(now) > 3):
                    done.append(now)
                    now = []
                now.append(line)
        return ["\n".join(c) for c in [*done, *([now] if now else [])]]

    got = split.clauses(split.lines(spark.createDataFrame(rows, "doc_id bigint, text string"))).collect()
    assert sorted((c.doc_id, c.clause_number, c.text) for c in got) == [(i, n, c) for i, t in rows for n, c in enumerate(fold(t), 1)]



def test_flexible_edits(spark):
    """A phrase that is not in the text as such is sought by runs of its words, if asked for."""
    docs = spark.createDataFrame([(1, "The receiving party shall keep all materials confidential.")], "doc_id bigint, text string")
    made = rules.edit("swap_phrase", "x", find="[COMPANY_1] party shall keep all the papers", replace="#")
    own = docs.select("doc_id", F.lit(1).alias("edit_seq"), made.alias("e")).select("doc_id", "edit_seq", "e.*")
    plain, flexible = (edits.apply_edits(docs, own, flexible=x).first() for x in (False, True))
    assert plain.applied == 0 and (flexible.text, flexible.applied) == ("The receiving # materials confidential.", 1)
    none = docs.select("doc_id", F.lit(1).alias("edit_seq"), rules.edit("delete_block", "x", quoted="NOT FOUND").alias("e")).select("doc_id", "edit_seq", "e.*")
    text = spark.createDataFrame([(1, "one\nthe text NOT FOUND here\ntwo")], "doc_id bigint, text string")
    assert edits.apply_edits(text, none).first().applied == 0


def test_texts_without_what_a_match_holds_are_not_searched(spark):
    """Redaction, counts and findings are those of the plain patterns, whether a text holds what they need or not."""
    draw = random.Random(4)
    parts = ["Boston", " ", ", ", "MA 02101", "ma  02101-1234", "12 ", "Oak Street", "a@b.co", "@", "Two Hundred dollars ($200)", "($", "$5", "Acme", " & Co", " Limited Partnership", "limited partnership", "\n", "é", "[REDACTED]"]
    rows = [(k, "".join(draw.choices(parts, k=draw.randint(0, 10)))) for k in range(5_000)] + [(5_000, None), (5_001, "")]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(8)
    t = F.col("text")
    for marker in ("[REDACT]", "Limited Partnership 12 @ MA 02101"):
        want = t
        for _, p in LIBRARY_A:
            want = F.regexp_replace(want, "(?i)" + p, marker.replace("$", r"\$"))
        assert docs.filter(~text.redacted(t, LIBRARY_A, marker).eqNullSafe(want)).count() == 0
    counts = sum(F.regexp_count(t, F.lit("(?i)" + p)) for _, p in LIBRARY_A)
    assert docs.filter(~text.pattern_count(t, LIBRARY_A).eqNullSafe(counts.cast("bigint"))).count() == 0
    assert text.findings(docs).count() == docs.agg(F.sum(counts)).first()[0] > 5_000
