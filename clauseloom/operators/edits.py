"""Edit application: a fold over a document's edits in order, with a log of what was found. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.operators.text import let

# Where a signature block starts, in order of preference.
SIGNATURE_MARKERS = ["IN WITNESS WHEREOF", "By:", "SIGNATURE", "ACCEPTED", "AGREED", "Sincerely", "Very truly yours"]

# Words that a flexible search does not look for alone.
STOP_WORDS = ["line", "that", "this", "with", "from", "they", "have", "will", "been"]


def found_in(low: Column, phrase: Column) -> Column:
    """found_at in a text of which the lower case is there. Places are counted in characters, so only what is held by its bytes is placed."""
    return F.when(F.coalesce(phrase, F.lit("")) == "", 0).when(~F.contains(low, F.lower(phrase)), 0).otherwise(F.instr(low, F.lower(phrase)))


def found_at(text: Column, phrase: Column) -> Column:
    """Where the phrase is first, whatever its case (0: nowhere; an empty phrase is nowhere)."""
    return found_in(F.lower(text), phrase)


def laddered(text: Column, phrase: Column, low: Column | None = None) -> Column:
    """The phrase as it stands in the text: in any case, then with tabs as spaces, then with any white space for white space; null if nowhere.

    low: the text's lower case, where it is there already. The last search, an expression over the whole text, is made only
    if the text holds each of the phrase's words (of ASCII signs, whose case does not depend on what is around them).
    """
    low = F.lower(text) if low is None else low
    spaced = F.trim(F.regexp_replace(phrase, r"\t+", " "))
    loose = F.concat(F.lit(r"(?i)\Q"), F.regexp_replace(F.replace(spaced, F.lit(r"\E"), F.lit(r"\E\\E\Q")), r"\s+", r"\\E\\s+\\Q"), F.lit(r"\E"))

    def as_is(p: Column) -> Column:
        return let(found_in(low, p), lambda n: F.when(n > 0, F.substr(text, n, F.length(p))))

    held = spaced.rlike(r"[^\x00-\x7F]") | F.forall(F.split(F.lower(spaced), r"\s+"), lambda w: F.contains(low, w))
    return F.coalesce(as_is(phrase), F.when(spaced != phrase, as_is(spaced)), F.when((spaced != "") & held, F.get(F.regexp_extract_all(text, loose, F.lit(0)), F.lit(0))))


def flexible_phrases(target: Column) -> Column:
    """What a flexible search tries, in order: the target without placeholders, its runs of 6 to 3 words of over 10 characters, its telling words."""
    clean = F.trim(F.regexp_replace(target, r"\[(?:NAME|COMPANY|ADDRESS|DATE)_\d+\]", ""))
    ws = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    n = F.size(ws)

    def runs_of(size: int) -> Column:
        return F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), lambda i: F.array_join(F.slice(ws, i, size), " "))).otherwise(F.array().cast("array<string>"))

    runs = [runs_of(size) for size in (6, 5, 4, 3)]
    telling = F.filter(ws, lambda w: (F.length(w) > 4) & ~F.lower(w).isin(STOP_WORDS))
    return F.filter(F.concat(F.array(clean), F.filter(F.concat(*runs), lambda p: F.length(p) > 10), telling), lambda p: p != "")


def flexible_hit(text: Column, target: Column) -> Column:
    """The first flexible phrase that the text holds, in any case; null if none."""
    return F.try_element_at(F.filter(flexible_phrases(target), lambda p: found_at(text, p) > 0), F.lit(1))


def nearest_paragraphs(edits: DataFrame, paragraphs: DataFrame) -> DataFrame:
    """edits (doc_id, edit_seq, line_number, find) with the para_no of their paragraph, null if none holds the text.

    The named paragraph wins, then the first within three of it (both by the first 50 characters of `find`), then the
    first of all (by 30). Paragraphs meet only the edits of their own document, and one struct a group is kept, so no
    group is collected.
    """
    p = paragraphs.select("doc_id", "para_no", F.col("text").alias("para"))
    near, far = F.contains("para", F.left("find", F.lit(50))), F.contains("para", F.left("find", F.lit(30)))
    away = F.abs(F.col("para_no") - F.col("line_number"))
    rank = F.when(near & (away == 0), 0).when(near & (away <= 3), 1).when(far, 2)
    best = edits.join(p, "doc_id").withColumn("rank", rank).filter(F.col("rank").isNotNull() & (F.col("find") != "")).groupBy("doc_id", "edit_seq").agg(F.min(F.struct("rank", "para_no")).alias("best"))
    return edits.join(best, ["doc_id", "edit_seq"], "left").withColumn("para_no", F.col("best.para_no")).drop("best")


def apply_line_edits(lines: DataFrame, changes: DataFrame) -> DataFrame:
    """lines (doc_id, line_no, text) after changes (doc_id, seq, change_type, line_number, find, replace, content).

    `replace_text_on_line` replaces every exact hit, or the whole line where only the first 50 characters hit; changes
    of one line fold in order. Later insertions after a line come first, as each goes right after it; those after a line
    that is not there are left out. Returns doc_id, position (from 1), line_no (null: inserted), text, modified.
    """
    swaps = changes.filter("change_type = 'replace_text_on_line' and find <> ''")
    listed = swaps.groupBy("doc_id", F.col("line_number").alias("line_no")).agg(F.array_sort(F.collect_list(F.struct("seq", "find", F.coalesce("replace", F.lit("")).alias("new")))).alias("swaps"))

    def step(s, c):
        new = F.when(F.contains(s["text"], c["find"]), F.replace(s["text"], c["find"], c["new"])).when(F.contains(s["text"], F.left(c["find"], F.lit(50))), c["new"])
        return F.struct(F.coalesce(new, s["text"]).alias("text"), (s["modified"] | new.isNotNull()).alias("modified"))

    start = F.struct(F.coalesce("text", F.lit("")).alias("text"), F.lit(False).alias("modified"))
    swaps_of = F.coalesce("swaps", F.array())
    base = lines.join(listed, ["doc_id", "line_no"], "left").withColumn("s", F.aggregate(swaps_of, start, step))
    kept = base.select("doc_id", F.col("line_no").cast("bigint").alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("turn"), "line_no", "s.text", "s.modified")
    none, new = F.lit(None).cast(lines.schema["line_no"].dataType).alias("line_no"), [F.coalesce("content", F.lit("")).alias("text"), F.lit(True).alias("modified")]
    after = changes.filter("change_type = 'insert_after_line'").join(lines.select("doc_id", F.col("line_no").alias("line_number")).distinct(), ["doc_id", "line_number"], "left_semi")
    after = after.select("doc_id", F.col("line_number").cast("bigint").alias("at"), F.lit(1).alias("kind"), (-F.col("seq")).cast("bigint").alias("turn"), none, *new)
    last = changes.filter("change_type = 'insert_at_end'").select("doc_id", F.lit(2**62).alias("at"), F.lit(2).alias("kind"), F.col("seq").cast("bigint").alias("turn"), none, *new)
    order = Window.partitionBy("doc_id").orderBy("at", "kind", "turn")
    return kept.unionByName(after).unionByName(last).withColumn("position", F.row_number().over(order)).select("doc_id", "position", "line_no", "text", "modified")


def put(text: Column, at: Column, new: Column, size: Column) -> Column:
    """text with `size` characters from `at` replaced."""
    return F.overlay(text, new, at, size)


def apply_one(text: Column, e: Column, flexible: bool = False, low: Column | None = None) -> Column:
    """text after one edit, null if nothing was found. flexible: where no candidate is in the text, runs of its words are sought.

    low: the text's lower case, where it is there already. What several branches need, the hit and its place, is computed
    once, and only for kinds that need it.
    """
    low = F.lower(text) if low is None else low

    def first(found: Column) -> Column:
        return F.try_element_at(F.filter(found, lambda p: p.isNotNull()), F.lit(1))

    def at_hit(hit: Column) -> Column:
        def changed(at: Column) -> Column:
            size = F.length(hit)
            before = F.lower(F.substr(text, F.greatest(at - F.length(e["qualifier"]), F.lit(1)), F.least(F.length(e["qualifier"]), at - 1)))
            return (
                F.when(e["type"].isin("swap_phrase", "swap_word"), F.when(at > 0, put(text, at, e["replace"], size)))
                .when(e["type"] == "delete_phrase", F.when(at > 0, put(text, at, F.lit(""), size)))
                .when(e["type"] == "insert_after", F.when(at > 0, put(text, at + size, e["content"], F.lit(0))))
                .when(e["type"] == "add_qualifier", F.when((at > 0) & (before != F.lower(e["qualifier"])), put(text, at, e["qualifier"], F.lit(0))))
            )

        return let(found_in(low, hit), changed)

    def by_phrase() -> Column:
        options = F.coalesce(e["candidates"], F.array(e["find"]))
        hit = first(F.transform(options, lambda p: laddered(text, p, low)))
        if flexible:
            hit = F.coalesce(hit, first(F.transform(options, lambda p: flexible_hit(text, p))))
        return let(hit, at_hit)

    def without(block: Column) -> Column:
        return F.when(block > 0, F.concat(F.regexp_replace(F.left(text, block - 1), r"[^\n]*\z", ""), F.regexp_replace(F.substr(text, block), r"^[^\n]*\n?", "")))

    def after(at: Column) -> Column:
        own = F.concat(F.left(text, at - 1), F.regexp_replace(F.substr(text, at), r"^([^\n]*)", F.concat(F.lit("$1\n"), F.regexp_replace(e["content"], r"([\\$])", r"\\$1"))))
        return F.when(at > 0, own).otherwise(appended)

    def place() -> Column:
        return F.coalesce(first(F.transform(F.array(F.lit(60), F.lit(40), F.lit(25)), lambda n: F.nullif(found_in(low, F.left(e["anchor_quote"], n)), F.lit(0)))), F.lit(0))

    signature = F.coalesce(*(F.when(F.contains(text, F.lit(m)), F.instr(text, m)) for m in SIGNATURE_MARKERS))
    appended = let(signature, lambda at: F.when(at.isNotNull(), put(text, at, F.concat(e["content"], F.lit("\n")), F.lit(0))).otherwise(F.concat(text, F.lit("\n"), e["content"])))
    return (
        F.when(e["type"].isin("swap_phrase", "swap_word", "delete_phrase", "insert_after", "add_qualifier"), by_phrase())
        .when(e["type"] == "delete_block", let(F.when(e["quoted"] == "NOT FOUND", 0).otherwise(found_in(low, F.left(e["quoted"], F.lit(80)))), without))
        .when(e["type"] == "insert_block", let(place(), after))
        .when(e["type"].isin("append_sentence", "insert_before_signature"), appended)
    )


def apply_edits(docs: DataFrame, edits: DataFrame, flexible: bool = False) -> DataFrame:
    """(doc_id, text, applied, log): edits (edit_seq, fields) in order over each document; `insert_words` is left to people.

    A document's edits are as many as its rules give, so the collected list is small.
    """
    fields = [c for c in edits.columns if c not in ("doc_id", "edit_seq")]
    listed = edits.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("edit_seq", *fields))).alias("edits"))
    start = F.struct(F.col("text").alias("text"), F.lower("text").alias("low"), F.array().cast("array<struct<edit_seq:int,applied:boolean>>").alias("log"))

    def step(s, e):
        logged = lambda new: F.concat(s["log"], F.array(F.struct(e["edit_seq"].alias("edit_seq"), new.isNotNull().alias("applied"))))
        changed = lambda new: F.struct(F.coalesce(new, s["text"]).alias("text"), F.coalesce(F.lower(new), s["low"]).alias("low"), logged(new).alias("log"))
        return let(apply_one(s["text"], e, flexible, s["low"]), changed)

    joined = docs.select("doc_id", "text").join(listed, "doc_id", "left").withColumn("edits", F.coalesce("edits", F.array()))
    out = joined.withColumn("s", F.aggregate("edits", start, step))
    return out.select("doc_id", F.col("s.text").alias("text"), F.size(F.filter("s.log", lambda x: x["applied"])).alias("applied"), F.col("s.log").alias("log"))


def markup_runs(line: Column) -> Column:
    """A line with `[INSERT: x]` or `[DELETE: x]` as structs of kind (kept, inserted, deleted) and text, in order.

    What stands between the marks is kept, but for blanks alone. A line with marks of both kinds is read for its inserts only.
    """

    def runs(mark: str, kind: str) -> Column:
        pattern = F.lit(rf"\[{mark}:\s*([^\]]+)\]")
        marks = F.transform(F.regexp_extract_all(line, pattern, F.lit(1)), lambda m: F.struct(F.lit(kind).alias("kind"), m.alias("text")))
        between = F.transform(F.split(line, pattern), lambda t: F.struct(F.lit("kept").alias("kind"), t.alias("text")))
        both = F.zip_with(between, marks, lambda t, m: F.array(t, m))
        return F.filter(F.flatten(both), lambda r: r.isNotNull() & ((r["kind"] != "kept") | (F.trim(r["text"]) != "")))

    plain = F.array(F.struct(F.lit("kept").alias("kind"), line.alias("text")))
    return F.when(F.contains(line, F.lit("[INSERT:")), runs("INSERT", "inserted")).when(F.contains(line, F.lit("[DELETE:")), runs("DELETE", "deleted")).when(F.trim(line) != "", plain).otherwise(F.array().cast("array<struct<kind:string,text:string>>"))
