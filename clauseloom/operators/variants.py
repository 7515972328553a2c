"""Other ways to apply edits: by paragraph, in passes, by pattern names, with visible marks, and as revision rows. All native."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.operators.edits import found_at, laddered

# Where the insertions of named patterns go, by a word of the name.
ANCHORS_BY_NAME = {
    "exclusion": ["shall not include", "does not include", "confidential information"],
    "recipient": ["representatives", "directors, officers", "employees"],
    "business": ["purpose", "evaluating", "transaction"],
    "defined": ["means", "shall mean", "defined"],
    "confidential": ["confidential", "non-disclosure"],
}


def surgical(paragraph: Column, find: Column, new: Column) -> Column:
    """find once as it stands; else the words about its first five, three more on each side at most, where they stand; null if nowhere."""
    ws = F.filter(F.split(find, r"\s+"), lambda w: w != "")
    key = F.array_join(F.slice(ws, 1, 5), " ")
    at, near = F.instr(paragraph, find), F.instr(paragraph, key)
    before = F.regexp_extract(F.left(paragraph, near - 1), r"((?:\S+\s+){0,3})\z", 1)
    after = F.regexp_extract(F.substr(paragraph, near + F.length(key)), r"\A((?:\s+\S+){0,3})", 1)
    span = F.overlay(paragraph, new, near - F.length(before), F.length(before) + F.length(key) + F.length(after))
    return F.when((find != "") & (at > 0), F.overlay(paragraph, new, at, F.length(find))).when((key != "") & (near > 0), span)


def paragraph_edits(paragraphs: DataFrame, changes: DataFrame, first_only: bool = True) -> DataFrame:
    """paragraphs (doc_id, para_no, text) after changes (doc_id, edit_seq, type, find, text as new), in order, as doc_id, position, text.

    replace_term and replace work on the first paragraph that holds `find` (all, unless first_only); delete empties it of `find`;
    insert_sentence and strengthen_language add to it; insert_clause, insert_definition_section and insert put a paragraph after it
    (definitions after the title, the first paragraph). What is found nowhere changes nothing.
    """
    new = changes.select("doc_id", "edit_seq", "type", "find", F.coalesce("new", F.lit("")).alias("new"))
    title = F.col("type") == "insert_definition_section"
    met = paragraphs.join(new, "doc_id").filter(F.when(title, F.col("para_no") == 1).otherwise((F.col("find") != "") & F.contains("text", "find")))
    if first_only:
        met = met.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "edit_seq").orderBy("para_no"))).filter("k = 1")
    listed = met.groupBy("doc_id", "para_no").agg(F.array_sort(F.collect_list(F.struct("edit_seq", "type", "find", "new"))).alias("own"))
    own = paragraphs.join(listed, ["doc_id", "para_no"], "left").withColumn("own", F.coalesce("own", F.array()))

    def step(t: Column, e: Column) -> Column:
        return (
            F.when(e["type"].isin("replace_term", "replace", "simplify"), F.replace(t, e["find"], e["new"])).when(e["type"] == "delete", F.replace(t, e["find"], F.lit("")))
            .when(e["type"].isin("insert_sentence", "strengthen_language"), F.concat_ws(" ", t, e["new"])).otherwise(t)
        )

    after = F.transform(F.filter("own", lambda e: e["type"].isin("insert", "insert_clause", "insert_definition_section")), lambda e: e["new"])
    texts = own.select("doc_id", "para_no", F.posexplode(F.concat(F.array(F.aggregate("own", F.col("text"), step)), after)).alias("k", "text"))
    return texts.select("doc_id", F.row_number().over(Window.partitionBy("doc_id").orderBy("para_no", "k")).alias("position"), "text")


def in_passes(paragraphs: DataFrame, changes: DataFrame, focus: list[str]) -> DataFrame:
    """One pass for each focus, over the text that the pass before left. changes: as paragraph_edits, with `focus`."""
    out = paragraphs
    for name in focus:
        out = paragraph_edits(out, changes.filter(F.col("focus") == name)).withColumnRenamed("position", "para_no")
    return out


def replaced_everywhere(text: Column, changes: Column) -> Column:
    """A struct of text and applied: each change (find, new) replaces all its hits and counts as one; changes with no find go to the end."""
    start = F.struct(text.alias("text"), F.lit(0).alias("applied"))

    def step(s: Column, c: Column) -> Column:
        hit = (c["find"] != "") & F.contains(s["text"], c["find"])
        new = F.when(c["find"] == "", F.concat(s["text"], F.lit("\n"), c["new"])).when(hit, F.replace(s["text"], c["find"], c["new"])).otherwise(s["text"])
        return F.struct(new.alias("text"), (s["applied"] + F.when((c["find"] == "") | hit, 1).otherwise(0)).alias("applied"))

    return F.aggregate(changes, start, step)


def visible_change(n: Column, kind: Column, old: Column, new: Column) -> Column:
    """A block that shows one change in plain text."""
    return F.format_string("=== AI CHANGE #%d: %s ===\n[REPLACED BY AI: %s] → %s", n, F.upper(kind), old, new)


def inserted_by_name(text: Column, name: Column, content: Column) -> Column:
    """content after the first of the named pattern's search terms that the text holds, else at the end."""
    terms = F.array().cast("array<string>")
    for word, listed in reversed(ANCHORS_BY_NAME.items()):
        terms = F.when(F.contains(F.lower(name), F.lit(word)), F.array(*map(F.lit, listed))).otherwise(terms)
    hit = F.try_element_at(F.filter(terms, lambda t: found_at(text, t) > 0), F.lit(1))
    return F.when(hit.isNotNull(), F.overlay(text, F.concat(F.lit(" "), content), found_at(text, hit) + F.length(hit), F.lit(0))).otherwise(F.concat(text, F.lit("\n"), content))


def four_steps(text: Column, find: Column, new: Column) -> Column:
    """find replaced once: in any case, with tabs as blanks, with any white space, else from its first eight words on, for its length; null if nowhere."""
    hit = laddered(text, find)
    head = F.array_join(F.slice(F.filter(F.split(find, r"\s+"), lambda w: w != ""), 1, 8), " ")
    near = laddered(text, head)
    return F.when(hit.isNotNull(), F.overlay(text, new, found_at(text, hit), F.length(hit))).when(near.isNotNull(), F.overlay(text, new, found_at(text, near), F.length(find)))


def redline(text: Column, find: Column, new: Column) -> Column:
    """Runs of one change at its first hit: before, deleted, inserted, after. Joined without the deleted run they are the new text."""
    at = F.instr(text, find)
    runs = F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("text")) for k, v in (("before", F.left(text, at - 1)), ("deleted", find), ("inserted", new), ("after", F.substr(text, at + F.length(find))))))
    whole = F.array(F.struct(F.lit("before").alias("kind"), text.alias("text")))
    return F.when((find != "") & (at > 0), F.filter(runs, lambda r: r["text"] != "")).otherwise(whole)


def revisions(docs: DataFrame, author: str, at: str, find: Column, new: Column) -> DataFrame:
    """(doc_id, seq, kind, text, author, made_at): the redline as rows of a revision table, from which any format can be rendered."""
    return docs.select("doc_id", F.posexplode(redline(F.col("text"), find, new)).alias("k", "r")).select("doc_id", (F.col("k") + 1).alias("seq"), "r.kind", "r.text", F.lit(author).alias("author"), F.lit(at).alias("made_at"))


def four_outputs(redacted: Column, edited: Column, restore) -> Column:
    """Texts before and after edits, each with placeholders and restored. restore: a column to a column."""
    return F.struct(redacted.alias("redacted_before"), edited.alias("redacted_after"), restore(redacted).alias("restored_before"), restore(edited).alias("restored_after"))
