"""All queries of the library's own operators, and the DuckDB SQL of those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.functions.patterns import GARBAGE_MARKERS, LIBRARY_A, LIBRARY_B0, LIBRARY_C, LIBRARY_T, PLAIN, STOP_TERMS_C, spelled
from clauseloom.operators import diff, edits, review, route, rules, score, split, text, vault
from clauseloom.plans import rule_sql

QUERIES: dict = {}
ORACLE: dict = {}
WORDS = "list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: w <> '')"
PLAIN_WORDS = r"list_filter(regexp_split_to_array(text, '[\s\x{00A0}\x{0085}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{1680}\x0B]+'), lambda w: w <> '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def q(p: str) -> str:
    return spelled(p).replace("'", "''")


def docs_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")


COUNTS = " union all ".join(f"select source, {k} as pattern_no, '{label}' as label, sum(len(regexp_extract_all(text, '(?i){q(p)}')))::bigint as n from documents group by source" for k, (label, p) in enumerate(PLAIN))


@query(f"select * from ({COUNTS}) where n > 0")
def pattern_counts_by_label(spark, sf_dir):
    found = text.findings(docs_of(spark, sf_dir), PLAIN, ("source",))
    return found.groupBy("source", "pattern_no", "label").agg(F.count("*").alias("n"))


@query(" union all ".join(f"select doc_id, {k} as pattern_no, '{label}' as label, unnest(regexp_extract_all(text, '(?i){q(p)}')) as found from documents" for k, (label, p) in enumerate(PLAIN)))
def pattern_findings_rows(spark, sf_dir):
    return text.findings(docs_of(spark, sf_dir), PLAIN)


@query()
def pattern_findings_full_library(spark, sf_dir):
    return text.findings(docs_of(spark, sf_dir), LIBRARY_A)


@query()
def pattern_counts_full_library(spark, sf_dir):
    found = text.findings(docs_of(spark, sf_dir), LIBRARY_A, ("source",))
    return found.groupBy("source", "pattern_no", "label").agg(F.count("*").alias("n"))


def nested(library, marker="[REDACTED]", what="text"):
    for _, p in library:
        what = f"regexp_replace({what}, '(?i){q(p)}', '{marker}', 'g')"
    return what


@query(f"select doc_id, sha256({nested(PLAIN)}) as redacted_sha, length({nested(PLAIN)})::bigint as n from documents")
def sequential_redaction(spark, sf_dir):
    out = docs_of(spark, sf_dir).select("doc_id", text.redacted(F.col("text"), PLAIN).alias("r"))
    return out.select("doc_id", F.sha2(F.encode("r", "UTF-8"), 256).alias("redacted_sha"), F.length("r").cast("bigint").alias("n"))


FOLLOWED = f"regexp_replace({nested(PLAIN, '[REDACT]')}, '(?i)\\[REDACT\\] (Title|Insurance|Company)', '[REDACT] [REDACT]', 'g')"


def digest(docs: DataFrame, r) -> DataFrame:
    return docs.select("doc_id", r.alias("r")).select("doc_id", F.sha2(F.encode("r", "UTF-8"), 256).alias("redacted_sha"), F.length("r").cast("bigint").alias("n"))


@query(f"select doc_id, sha256({FOLLOWED}) as redacted_sha, length({FOLLOWED})::bigint as n from documents")
def redaction_followup(spark, sf_dir):
    return digest(docs_of(spark, sf_dir), text.followed_up(text.redacted(F.col("text"), PLAIN, "[REDACT]")))


@query(f"select doc_id, sha256({nested(LIBRARY_A)}) as redacted_sha, length({nested(LIBRARY_A)})::bigint as n from documents")
def sequential_redaction_full_library(spark, sf_dir):
    return digest(docs_of(spark, sf_dir), text.redacted(F.col("text"), LIBRARY_A))


TOKENS = f"tokens as (select doc_id, unnest({WORDS}) as word from documents)"
ALLOW = "allow as (select lower(word) as term from tokens group by 1 having count(distinct doc_id) >= 5)"


#: A word is on the allow-list that so many documents have.
LEAST = 5


def allow_list(tokens: DataFrame, least: int = LEAST) -> DataFrame:
    return tokens.groupBy(F.lower("word").alias("term")).agg(F.count_distinct("doc_id").alias("n")).filter(F.col("n") >= least).select("term")


@query(f"with {TOKENS}, {ALLOW} select doc_id, word, count(*) as n from tokens where length(word) > 2 and lower(word) not in (select term from allow) group by all")
def tokens_not_in_allowlist(spark, sf_dir):
    t = text.tokens(docs_of(spark, sf_dir))
    return text.not_allowed(t, allow_list(t)).groupBy("doc_id", "word").agg(F.count("*").alias("n"))


@query(f"with {TOKENS}, {ALLOW}, b as (select distinct lower(unnest({WORDS})) as term from benchmark) select term, true as allowed from b where term in (select term from allow) union all select term, false from b where term not in (select term from allow)")
def allowlist_semi_join(spark, sf_dir):
    allow = allow_list(text.tokens(docs_of(spark, sf_dir)))
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(text.words(F.col("text"))).alias("w")).select(F.lower("w").alias("term")).distinct()
    return b.join(allow, "term", "left_semi").withColumn("allowed", F.lit(True)).union(b.join(allow, "term", "left_anti").withColumn("allowed", F.lit(False)))


@query(f"with {TOKENS}, d as (select distinct lower(word) as term from tokens), b as (select distinct lower(unnest({WORDS})) as term from benchmark) select 'union' as op, count(*) as n from (select * from d union select * from b) union all select 'intersect', count(*) from (select * from d intersect select * from b) union all select 'except', count(*) from (select * from d except select * from b)")
def term_set_ops(spark, sf_dir):
    d = text.tokens(docs_of(spark, sf_dir)).select(F.lower("word").alias("term")).distinct()
    b = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.explode(text.words(F.col("text"))).alias("w")).select(F.lower("w").alias("term")).distinct()
    rows = [("union", d.union(b).distinct()), ("intersect", d.intersect(b)), ("except", d.subtract(b))]
    out = [x.agg(F.count("*").alias("n")).select(F.lit(k).alias("op"), "n") for k, x in rows]
    return out[0].union(out[1]).union(out[2])


CHUNKS = "(select doc_id, (g // 1000 + 1)::int as chunk_order, substring(text, (g + 1)::bigint, 1000) as content, (g + 1)::int as start_char from documents, lateral (select unnest(range(0, length(text), 1000)) as g))"


@query(f"select doc_id, chunk_order, substring(md5(doc_id || '|' || chunk_order), 1, 12) as hash_id, md5(content) as content_md5, length(content)::int as char_count, start_char, (start_char + length(content) - 1)::int as end_char from {CHUNKS}")
def char_chunks(spark, sf_dir):
    return split.char_chunks(docs_of(spark, sf_dir)).select("doc_id", "chunk_order", "hash_id", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), "char_count", "start_char", "end_char")


def word_chunk_sql(size):
    return f"select doc_id, (g // {size} + 1)::int as chunk_order, array_to_string(ws[g + 1 : g + {size}], ' ') as content, least({size}, len(ws) - g)::int as word_count, (g + 1)::int as start_word, least(len(ws), g + {size})::int as end_word from (select doc_id, {PLAIN_WORDS} as ws from documents), lateral (select unnest(range(0, len(ws), {size})) as g)"


@query(f"select doc_id, chunk_order, md5(content) as content_md5, word_count, start_word, end_word from ({word_chunk_sql(1000)})")
def word_chunks(spark, sf_dir):
    return split.word_chunks(docs_of(spark, sf_dir)).withColumn("content_md5", F.md5(F.encode("content", "UTF-8"))).drop("content")


@query(f"select doc_id, chunk_order, md5(content) as content_md5, word_count, start_word, end_word from ({word_chunk_sql(500)})")
def pages_500(spark, sf_dir):
    return split.word_chunks(docs_of(spark, sf_dir), 500).withColumn("content_md5", F.md5(F.encode("content", "UTF-8"))).drop("content")


@query("select doc_id, md5(text) as text_md5 from documents where length(text) > 0")
def reassemble_chunks(spark, sf_dir):
    return split.reassemble(split.char_chunks(docs_of(spark, sf_dir))).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query("select doc_id, ((length(text) + 999) // 1000)::bigint as total_chunks, length(text)::bigint as total_chars, length(text)::bigint as last_char from documents where length(text) > 0")
def chunk_mapping(spark, sf_dir):
    return split.mapping(split.char_chunks(docs_of(spark, sf_dir)))


GARBAGE = "(regexp_matches({0}, '[A-Za-z0-9+/]{{50,}}')" + "".join(f" or contains(lower({{0}}), '{m}')" for m in GARBAGE_MARKERS) + ")"


@query(f"select page_id, {GARBAGE.format('html')} as garbage from pages")
def garbage_pages(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.garbage(F.col("html")).alias("garbage"))


ANY = " or ".join(f"regexp_matches(content, '(?i){q(p)}')" for _, p in PLAIN)


@query(f"select doc_id, chunk_order, flagged from (select doc_id, chunk_order, (({ANY}) and not {GARBAGE.format('content')}) as flagged, max(chunk_order) over (partition by doc_id) as last from ({word_chunk_sql(500)})) where flagged or chunk_order = 1 or chunk_order = last")
def pii_page_selection(spark, sf_dir):
    flagged = text.pattern_count(F.col("content"), PLAIN) > 0
    return split.select_pages(split.word_chunks(docs_of(spark, sf_dir), 500), flagged).select("doc_id", "chunk_order", "flagged")


@query()
def pii_page_selection_full(spark, sf_dir):
    """Pages with a match of any pattern of the whole library, or three distinct words off the allow-list."""
    docs = docs_of(spark, sf_dir)
    return route.select_pii_pages(docs, allow_list(text.tokens(docs)), LIBRARY_A).select("doc_id", "chunk_order", "flagged")


RISK = "(select doc_id, len(ps) as n, unnest(ps) as raw, unnest(range(0, len(ps))) as i from (select doc_id, regexp_split_to_array(text, '[.!?]+') as ps from documents))"


@query(f"select doc_id, i::int as sent_idx, md5(trim(raw, ' ')) as sentence_md5 from {RISK} where length(trim(raw, ' ')) >= 20 and (i < 10 or i >= n - 5 or regexp_matches(raw, '[0-9]{{3}}'))")
def high_risk_sentences(spark, sf_dir):
    return split.risk_sentences(docs_of(spark, sf_dir), F.col("sentence").rlike("[0-9]{3}")).select("doc_id", "sent_idx", F.md5(F.encode("sentence", "UTF-8")).alias("sentence_md5"))


FLAGGED = (
    f"{TOKENS}, {ALLOW}, s as (select doc_id, n, i, trim(raw, ' ') as sentence from {RISK}), sw as (select doc_id, i, unnest(regexp_split_to_array(sentence, '[^A-Za-z]+')) as w from s), "
    "off as (select distinct doc_id, i from sw where length(w) > 2 and lower(w) not in (select term from allow)), k as (select s.doc_id, s.i, sentence from s left join off on off.doc_id = s.doc_id and off.i = s.i where length(sentence) >= 20 and (s.i < 10 or s.i >= n - 5 or off.i is not null))"
)


@query(f"with {FLAGGED} select doc_id, i::int as sent_idx, md5(sentence) as sentence_md5 from k")
def flagged_sentences(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return split.flagged_sentences(docs, LEAST).select("doc_id", "sent_idx", F.md5(F.encode("sentence", "UTF-8")).alias("sentence_md5"))


PACKED_WORDS = PLAIN_WORDS.replace("text,", "sentence,")


@query(
    f"with recursive {FLAGGED}, w as (select doc_id, row_number() over (partition by doc_id order by i) as k, sentence, len({PACKED_WORDS}) as n from k), "
    "f as (select doc_id, k, sentence, n, 1 as chunk_no, n as load from w where k = 1 union all select w.doc_id, w.k, w.sentence, w.n, case when f.load > 0 and f.load + w.n > 300 then f.chunk_no + 1 else f.chunk_no end, case when f.load > 0 and f.load + w.n > 300 then w.n else f.load + w.n end from f join w on w.doc_id = f.doc_id and w.k = f.k + 1) "
    "select doc_id, chunk_no::int as chunk_no, md5(string_agg(sentence, ' ' order by k)) as content_md5, sum(n)::int as word_count from f group by doc_id, chunk_no"
)
def risk_bin_packing(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    return split.pack_sections(split.flagged_sentences(docs, LEAST)).select("doc_id", "chunk_no", F.md5(F.encode("content", "UTF-8")).alias("content_md5"), "word_count")


DISTINCT = f"w as (select distinct unnest({WORDS}) as word from documents)"
V = "length(regexp_replace(lower(word), '[^aeiou]', '', 'g'))"


@query(f"""with {DISTINCT} select word from w where length(word) < 3 or length(word) > 15 or regexp_matches(word, '^[A-Z]{{2,4}}[a-z]{{1,4}}[A-Z]*$|^[A-Z]{{2,}}[a-z]{{1,2}}$|^[a-z]+[A-Z]+[a-z]*$|^[A-Z]+[a-z]+[A-Z]+|[0-9]|^[a-z]{{1,3}}[A-Z]{{1,3}}[a-z]*$|^[bcdfghjklmnpqrstvwxyz]{{4,}}$')
    or (regexp_matches(word, '^[A-Z]{{4,}}$') and length(word) <= 6) or (length(word) > 4 and {V} = 0) or (length(word) > 6 and (length(word) - {V}) / length(word)::double > 0.8)""")
def random_artifacts(spark, sf_dir):
    return text.tokens(docs_of(spark, sf_dir)).select("word").distinct().filter(text.random_artifact(F.col("word")))


@query(f"with {DISTINCT} select word from w where length(word) between 3 and 20 and not regexp_matches(word, '[0-9]') and not (word = upper(word) and length(word) > 3) and not regexp_matches(lower(word), '[qxz]{{2,}}|[bcdfghjklmnpqrstvwxyz]{{5,}}') and len(list_distinct(string_split(lower(word), ''))) >= 3 and regexp_matches(lower(word), '[aeiou]') and not regexp_matches(lower(word), '^(css|mhtml|http|www)')")
def regular_words(spark, sf_dir):
    return text.tokens(docs_of(spark, sf_dir)).select("word").distinct().filter(text.regular_word(F.col("word")))


@query(f"with {DISTINCT} select word, case when regexp_matches(word, '^[A-Z][a-z]+$') and length(word) > 3 then 'proper_noun' when regexp_matches(word, '^[A-Z]{{2,}}$') then 'abbreviation' when regexp_matches(word, '^[a-z]+[A-Z]') or contains(word, 'Co') or contains(word, 'LLC') then 'technical' else 'possible_pii' end as category from w")
def word_categories(spark, sf_dir):
    return text.tokens(docs_of(spark, sf_dir)).select("word").distinct().withColumn("category", text.word_category(F.col("word")))


PAGE_WORDS = f"pw as (select distinct doc_id, (i // 500 + 1)::bigint as page, lower(word) as term from (select doc_id, unnest({WORDS}) as word, unnest(range(0, len({WORDS}))) as i from documents))"


def page_words(spark, sf_dir, size=500):
    return text.tokens(docs_of(spark, sf_dir)).withColumn("page", (F.floor(F.col("pos") / size) + 1).cast("bigint"))


NEW = f"{PAGE_WORDS}, n as (select doc_id, page, page = min(page) over (partition by doc_id, term) as new from pw), byp as (select doc_id, page, count(*) filter (new) as new_terms, count(*) filter (not new) as repeated_terms from n group by all)"


@query(f"with {NEW} select * from byp")
def new_vs_repeated_terms(spark, sf_dir):
    return route.new_terms_of(docs_of(spark, sf_dir))


@query(f"with {NEW}, h as (select *, row_number() over (partition by doc_id order by page) <= count(*) over (partition by doc_id) // 2 as early from byp) select doc_id, sum(new_terms)::bigint as new_terms, sum(case when early then new_terms else 0 end)::bigint as early_terms, sum(new_terms + repeated_terms)::bigint as all_terms, sum(case when early then new_terms else 0 end) > 0.7 * sum(new_terms) as is_early from h group by doc_id")
def early_introduction(spark, sf_dir):
    return route.early_introduction(route.new_terms_of(docs_of(spark, sf_dir)))


ACROSS = f"{PAGE_WORDS}, f as (select term, min(doc_id) as first_doc from pw group by 1), r as (select doc_id, page, bool_or(doc_id = first_doc) as to_review from pw join f using (term) group by all)"


@query(f"with {ACROSS} select * from r")
def learn_then_apply_route(spark, sf_dir):
    return route.route_across(page_words(spark, sf_dir))


@query(f"with {PAGE_WORDS}, n as (select doc_id, page, page = min(page) over (partition by doc_id, term) as new from pw) select doc_id, page, bool_or(new) as to_review from n group by all")
def learn_then_apply_within_doc(spark, sf_dir):
    return route.routed_within(route.new_terms_of(docs_of(spark, sf_dir)))


@query(f"with {ACROSS} select count(*) as pages, count(*) filter (to_review) as review_pages, round(100.0 * count(*) filter (to_review) / count(*), 4)::double as review_percent from r")
def learn_then_apply_stats(spark, sf_dir):
    return route.route_statistics(route.route_across(page_words(spark, sf_dir))).withColumn("review_percent", F.col("review_percent").cast("double"))


@query(f"with {TOKENS}, {ALLOW} select word, count(*) as n from tokens where length(word) > 2 and lower(word) not in (select term from allow) group by 1 order by n desc, word limit 10")
def top_redacted_words(spark, sf_dir):
    t = text.tokens(docs_of(spark, sf_dir))
    return text.not_allowed(t, allow_list(t)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(10)


LINES = "ls as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as line_no from documents)"


@query(f"with {LINES}, i as (select *, sum(case when trim(line, ' ') = '' then 1 else 0 end) over (partition by doc_id order by line_no) as island from ls), g as (select doc_id, island, string_agg(trim(line, ' '), ' ' order by line_no) as paragraph, min(line_no) as f from i where trim(line, ' ') <> '' group by all) select doc_id, row_number() over (partition by doc_id order by f)::int as paragraph_number, md5(paragraph) as paragraph_md5 from g")
def paragraphs(spark, sf_dir):
    return split.paragraphs(split.lines(docs_of(spark, sf_dir))).select("doc_id", "paragraph_number", F.md5(F.encode("paragraph", "UTF-8")).alias("paragraph_md5"))


@query(f"with {LINES} select doc_id, line_no::int as line_no, md5(format('LINE {{:03d}}: {{}}', line_no, line)) as tagged_md5 from ls where trim(line, ' ') <> ''")
def numbered_lines(spark, sf_dir):
    return split.numbered(split.lines(docs_of(spark, sf_dir))).select("doc_id", "line_no", F.md5(F.encode("tagged", "UTF-8")).alias("tagged_md5"))


FIRST_WORDS = PLAIN_WORDS.replace("text,", r"regexp_replace(ls[1], '^\d+\.?\s*', ''),")


@query(
    rf"with {LINES}, k as (select doc_id, line_no, trim(line, ' ') as l from ls where trim(line, ' ') <> ''), p as (select *, sum(case when regexp_matches(l, '^\d+\.') or regexp_matches(l, '^[A-Z][A-Z\s]{{10,}}') then 1 else 0 end) over (partition by doc_id order by line_no) as part from k), "
    "o as (select *, row_number() over (partition by doc_id, part order by line_no) as place from p), c as (select *, sum(case when (place - 1) % 4 = 0 then 1 else 0 end) over (partition by doc_id order by line_no) as clause_number from o), "
    f"g as (select doc_id, clause_number, list(l order by line_no) as ls from c group by all) select doc_id, clause_number::int as clause_number, coalesce(nullif(array_to_string(({FIRST_WORDS})[1:4], ' '), ''), 'Untitled Clause') as title, md5(array_to_string(ls, chr(10))) as text_md5 from g"
)
def clauses(spark, sf_dir):
    return split.clauses(split.lines(docs_of(spark, sf_dir))).select("doc_id", "clause_number", "title", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query(f"with {LINES} select doc_id, line_no::int as position, (case when trim(line, ' ') <> '' then sum(case when trim(line, ' ') <> '' then 1 else 0 end) over (partition by doc_id order by line_no) end)::int as line_number, md5(line) as line_md5 from ls")
def line_objects(spark, sf_dir):
    return split.line_objects(split.lines(docs_of(spark, sf_dir))).select("doc_id", "position", "line_number", F.md5(F.encode("line", "UTF-8")).alias("line_md5"))


@query(r"select page_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '=\r?\n', '', 'g'), '<[^>]+>', ' ', 'g'), '&[a-zA-Z0-9#]+;', ' ', 'g'), '[\s\x0B]+', ' ', 'g')) as text_md5 from pages")
def html_to_text(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.md5(F.encode(text.html_to_text(F.col("html")), "UTF-8")).alias("text_md5"))


PAGE_LINES = "ls as (select page_id, unnest(string_split(html, chr(10))) as line, unnest(range(1, len(string_split(html, chr(10))) + 1))::int as line_no from pages)"
BINARY_LINE = " or ".join(f"contains(lower(line), '{m}')" for m in text.BINARY_MARKERS)


@query(
    f"with {PAGE_LINES}, e as (select *, case when contains(line, '{text.BINARY}') then 'skip' when starts_with(line, '------') and contains(line, 'Boundary') then 'keep' when {BINARY_LINE} then 'skip' end as event from ls), "
    "s as (select *, last_value(event ignore nulls) over (partition by page_id order by line_no rows between unbounded preceding and current row) as state from e) select page_id, line_no, md5(line) as line_md5 from s where event is null and coalesce(state, 'keep') <> 'skip'"
)
def mime_part_skip(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", F.posexplode(F.split("html", "\n")).alias("k", "line")).withColumn("line_no", F.col("k") + 1)
    return text.mime_lines(lines, "page_id").select("page_id", "line_no", F.md5(F.encode("line", "UTF-8")).alias("line_md5"))


DECODED = "array_to_string(list_transform(regexp_extract_all(regexp_replace(t, '=\\r?\\n', '', 'g'), '=[0-9A-F]{2}|[^=]+|='), lambda x: case when regexp_matches(x, '^=[0-9A-F]{2}$') then chr(('0x' || substr(x, 2))::int) else x end), '')"
BLANKS = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(
    f"with {PAGE_LINES}, e as (select *, case when contains(line, '{text.BINARY}') then 'skip' when starts_with(line, '------') and contains(line, 'Boundary') then 'keep' when {BINARY_LINE} then 'skip' end as event from ls), "
    "s as (select *, last_value(event ignore nulls) over (partition by page_id order by line_no rows between unbounded preceding and current row) as state from e), k as (select page_id, string_agg(line, chr(10) order by line_no) as t from s where event is null and coalesce(state, 'keep') <> 'skip' group by 1), "
    f"p as (select page_id, coalesce(t, '') as t from (select distinct page_id from pages) left join k using (page_id)), r as (select page_id, regexp_replace(regexp_replace(regexp_replace({DECODED}, '<[^>]+>', ' ', 'g'), '&[a-zA-Z0-9#]+;', ' ', 'g'), '{BLANKS}', ' ', 'g') as t from p) select page_id, md5(t) as text_md5, length(t)::bigint as n from r"
)
def mhtml_to_text(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", text.mhtml_to_text(F.col("html")).alias("t"))
    return pages.select("page_id", F.md5(F.encode("t", "UTF-8")).alias("text_md5"), F.length("t").cast("bigint").alias("n"))


# Facts for scoring: the reference data has no analyses, so they follow from document ids by arithmetic.
FACTS = """select doc_id,
 list_slice(['public','prior_possession','independent_dev'], 1, (doc_id % 4)::int) as concepts_found, list_slice(['affiliates','Directors','officers','employees','members','partners','investors','agents','attorneys','accountants','brokers','consultants','advisors'], 1, (doc_id % 14)::int) as roles_found,
 case when doc_id % 11 = 0 then 'NOT FOUND' else 'its affiliates and directors ' || doc_id end as roles_quote, ['sign','bound','directed','informed','none'][(doc_id % 5 + 1)::int] as requirement_type,
 ['automatic','both','upon_request','none'][(doc_id % 4 + 1)::int] as trigger, doc_id % 3 = 0 as has_destroy_option, ['none','broad','moderate','narrow'][((doc_id // 3) % 4 + 1)::int] as scope,
 case when doc_id % 5 < 2 then null else (doc_id % 5 - 2)::double end as time_limit_years, case when doc_id % 7 = 0 then null else (doc_id % 7)::double end as duration_years, doc_id % 6 = 0 as preamble_date_blank,
 case when doc_id % 13 = 0 then 'NOT FOUND' else 'dated as of _____ day of _____ ' || doc_id end as date_quote, doc_id % 2 = 0 as has_effective_date_label, doc_id % 10 = 4 as signature_page_date_only,
 case when doc_id % 8 = 0 then 'NOT FOUND' else 'if required by law ' || doc_id end as compelled_quote, doc_id % 3 <> 1 as has_notice_requirement, doc_id % 5 <> 2 as has_cooperation_provision,
 doc_id % 2 = 1 as has_punitive_language, doc_id % 3 = 1 as has_injunctive_relief, doc_id % 5 = 1 as has_bond_waiver from documents"""


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")

    def pick(values, k):
        return F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))

    roles = F.array(*(F.lit(r.title() if r == "directors" else r) for r in score.REQUIRED_ROLES))
    concepts = F.array(*map(F.lit, ("public", "prior_possession", "independent_dev")))
    return docs_of(spark, sf_dir).select(
        "doc_id", F.slice(concepts, F.lit(1), (d % 4).cast("int")).alias("concepts_found"), F.slice(roles, F.lit(1), (d % 14).cast("int")).alias("roles_found"),
        F.when(d % 11 == 0, "NOT FOUND").otherwise(F.concat(F.lit("its affiliates and directors "), d.cast("string"))).alias("roles_quote"), pick(("sign", "bound", "directed", "informed", "none"), d % 5).alias("requirement_type"),
        pick(("automatic", "both", "upon_request", "none"), d % 4).alias("trigger"), (d % 3 == 0).alias("has_destroy_option"), pick(("none", "broad", "moderate", "narrow"), F.floor(d / 3) % 4).alias("scope"),
        F.when(d % 5 >= 2, (d % 5 - 2).cast("double")).alias("time_limit_years"), F.when(d % 7 != 0, (d % 7).cast("double")).alias("duration_years"), (d % 6 == 0).alias("preamble_date_blank"),
        F.when(d % 13 == 0, "NOT FOUND").otherwise(F.concat(F.lit("dated as of _____ day of _____ "), d.cast("string"))).alias("date_quote"), (d % 2 == 0).alias("has_effective_date_label"), (d % 10 == 4).alias("signature_page_date_only"),
        F.when(d % 8 == 0, "NOT FOUND").otherwise(F.concat(F.lit("if required by law "), d.cast("string"))).alias("compelled_quote"), (d % 3 != 1).alias("has_notice_requirement"), (d % 5 != 2).alias("has_cooperation_provision"),
        (d % 2 == 1).alias("has_punitive_language"), (d % 3 == 1).alias("has_injunctive_relief"), (d % 5 == 1).alias("has_bond_waiver"),
        F.when(d % 4 == 0, "NOT FOUND").otherwise(F.concat(F.lit("the term shall not include information that is public "), d.cast("string"))).alias("carveout_quote"), F.lit("such persons sign").alias("sub_quote"), F.lit("return the materials").alias("return_quote"), F.lit("shall not contact").alias("circumvention_quote"), F.lit("five years").alias("term_quote"),
        F.lit(None).cast("string").alias("conf_info_term"), F.lit("Buyer").alias("receiver_term"), F.lit(None).cast("string").alias("provider_term"), F.when(d % 2 == 0, "Agents").alias("reps_term"),
        F.filter(F.array(*(F.lit(f"c{k}") for k in range(1, 10))), lambda c: F.substring(c, 2, 1).cast("int") % 3 == d % 3).alias("found"),
    )


SCORES = f"""facts as ({FACTS}), r as (select *, len(list_distinct(list_transform(roles_found, lambda x: lower(x)))) as nr, coalesce(time_limit_years, 0) as lim from facts), code as (
 select doc_id, '1_carveouts' as category, case len(concepts_found) when 0 then 10 when 1 then 8 when 2 then 6 else 0 end as code_score from r
 union all select doc_id, '2_representatives', case when roles_quote = 'NOT FOUND' or nr = 0 then 10 when nr <= 3 then 8 when 13 - nr > 4 then 7 when 13 - nr >= 2 then 5 when 13 - nr = 1 then 3 else 0 end from r
 union all select doc_id, '3_sub_agreement', case requirement_type when 'sign' then 9 when 'bound' then 7 when 'directed' then 3 else 0 end from r
 union all select doc_id, '4_return_destroy', case when trigger = 'automatic' then 8 when trigger = 'both' then 6 when trigger = 'upon_request' and not has_destroy_option then 4 else 0 end from r
 union all select doc_id, '5_non_circumvention', case when scope = 'none' then 0 when lim = 0 and scope = 'broad' then 9 when lim = 0 and scope = 'moderate' then 6 when lim > 2 then 5 else 2 end from r
 union all select doc_id, '6_term', case when duration_years is null then 9 when duration_years > 2 then 7 else 0 end from r
 union all select doc_id, '7_effective_date', case when preamble_date_blank then 8 when date_quote = 'NOT FOUND' then 7 when not has_effective_date_label then 4 when signature_page_date_only then 2 else 0 end from r
 union all select doc_id, '8_compelled_disclosure', case when compelled_quote = 'NOT FOUND' then 8 when not has_notice_requirement then 6 when not has_cooperation_provision then 3 else 0 end from r
 union all select doc_id, '9_remedies', case when has_punitive_language and not has_injunctive_relief then case when has_bond_waiver then 7 else 9 end when has_injunctive_relief and not has_bond_waiver then 5 when has_injunctive_relief and has_bond_waiver and has_punitive_language then 2 else 0 end from r)"""
FINAL = f"{SCORES}, ai as (select doc_id, ['1_carveouts','3_sub_agreement','6_term','c1_electronic_sig'][(doc_id % 4 + 1)::int] as category, (doc_id % 11)::int as ai_score from documents), final as (select coalesce(code.doc_id, ai.doc_id) as doc_id, coalesce(code.category, ai.category) as category, greatest(coalesce(ai_score, 0), coalesce(code_score, 0))::int as final_score from ai full join code using (doc_id, category))"


@query(f"with {SCORES} select doc_id, category, code_score::int as code_score from code")
def rubric_scores(spark, sf_dir):
    return score.code_scores(facts(spark, sf_dir))


def final_scores(spark, sf_dir):
    names = F.array(*map(F.lit, ("1_carveouts", "3_sub_agreement", "6_term", "c1_electronic_sig")))
    ai = docs_of(spark, sf_dir).select("doc_id", F.element_at(names, (F.col("doc_id") % 4 + 1).cast("int")).alias("category"), (F.col("doc_id") % 11).cast("int").alias("ai_score"))
    return score.resolve(ai, score.code_scores(facts(spark, sf_dir)))


@query(f"with {FINAL} select * from final")
def score_resolve(spark, sf_dir):
    return final_scores(spark, sf_dir)


@query(f"with {FINAL}, t as (select *, sum(final_score) over w as total, count(*) filter (final_score >= 8) over w as high, count(*) filter (final_score between 5 and 7) over w as middle from final window w as (partition by doc_id)), b as (select *, case when final_score >= 8 then 1 when final_score between 5 and 7 and (total >= 15 or middle >= 3 or high > 0) then 2 when final_score between 1 and 4 and (total >= 20 or high >= 2) then 3 end as band from t) select doc_id, category, final_score, band::int as band, total::bigint as total from b where band is not null")
def threshold_apply(spark, sf_dir):
    return score.apply_thresholds(final_scores(spark, sf_dir))


@query(rule_sql.edits_sql(FACTS))
def rule_edits(spark, sf_dir):
    """All fields of all rules' edits, in order."""
    made = rules.generate(facts(spark, sf_dir), "January 05, 2024")
    fields = [F.coalesce(F.array_join(c, "|") if c == "candidates" else c, F.lit("-")) for c in rule_sql.FIELDS]
    return made.select("doc_id", "edit_seq", "category", "type", F.md5(F.encode(F.concat_ws("|", *fields), "UTF-8")).alias("edit_md5"))


@query("select doc_id, true as restored from documents")
def vault_roundtrip(spark, sf_dir):
    kept = vault.vault(docs_of(spark, sf_dir))
    return kept.select("doc_id", (vault.restored(F.col("redacted"), F.col("found")) == F.col("text")).alias("restored"))


@query("select doc_id, md5(case when contains(lower(text), 'the') then substring(text, 1, strpos(lower(text), 'the') - 1) || 'a' || substring(text, strpos(lower(text), 'the') + 3) else text end) as text_md5, (case when contains(lower(text), 'the') then 1 else 0 end)::int as applied from documents")
def apply_edits_swap(spark, sf_dir):
    docs = docs_of(spark, sf_dir)
    own = docs.select("doc_id", F.lit(1).alias("edit_seq"), rules.edit("swap_phrase", "x", find="the", replace="a").alias("e")).select("doc_id", "edit_seq", "e.*")
    return edits.apply_edits(docs, own).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), "applied")


@query()
def apply_rule_edits(spark, sf_dir):
    return edits.apply_edits(docs_of(spark, sf_dir), rules.generate(facts(spark, sf_dir), "January 05, 2024")).select("doc_id", "text", "applied")


TURNS = "o as (select conv_id, turn // 2 as pair, text from conversations where turn % 2 = 0), n as (select conv_id, turn // 2 as pair, text from conversations where turn % 2 = 1)"
CHANGE = "case when o.text is null then 'ADDED' when n.text is null then 'DELETED' when o.text = n.text then 'SAME' when contains(n.text, 'XXXX') and not contains(o.text, 'XXXX') then 'REDACTION' when length(n.text) < length(o.text) * 0.8 then 'MAJOR_DELETION' when length(n.text) > length(o.text) * 1.2 then 'MAJOR_ADDITION' when lower(o.text) <> lower(n.text) then 'TEXT_MODIFICATION' else 'FORMATTING_CHANGE' end"


def turns(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").withColumn("pair", F.floor(F.col("turn") / 2).cast("bigint"))
    return tuple(c.filter(F.col("turn") % 2 == k).select("conv_id", "pair", "text") for k in (0, 1))


@query(f"with {TURNS} select coalesce(o.conv_id, n.conv_id) as conv_id, coalesce(o.pair, n.pair) as pair, {CHANGE} as change, case when length(coalesce(n.text, '')) < length(coalesce(o.text, '')) then 'SHORTENED' when length(coalesce(n.text, '')) > length(coalesce(o.text, '')) then 'LENGTHENED' else 'SAME' end as length_change from o full join n on o.conv_id = n.conv_id and o.pair = n.pair")
def paragraph_diff(spark, sf_dir):
    return diff.compare(*turns(spark, sf_dir), ["conv_id", "pair"]).select("conv_id", "pair", "change", "length_change")


@query(f"with {TURNS}, d as (select {CHANGE} as change from o full join n on o.conv_id = n.conv_id and o.pair = n.pair) select change, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 4)::double as percent from d group by change")
def change_distribution(spark, sf_dir):
    return diff.distribution(diff.compare(*turns(spark, sf_dir), ["conv_id", "pair"])).withColumn("percent", F.col("percent").cast("double"))


PHRASES = ["license", "the that", "idiot", "and for", "version 3", "of the", "en la"]


@query("select doc_id, phrase, contains(lower(text), phrase) as present from documents, (select unnest([" + ", ".join(f"'{p}'" for p in PHRASES) + "]) as phrase)")
def phrase_matrix(spark, sf_dir):
    return diff.phrase_matrix(docs_of(spark, sf_dir), PHRASES, "doc_id")


@query()
def review_flags(spark, sf_dir):
    return review.review(split.char_chunks(docs_of(spark, sf_dir)))


def lines_of(spark, sf_dir):
    lines = docs_of(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n")).alias("k", "text"))
    return lines.select("doc_id", (F.col("k") + 1).alias("para_no"), "text")


LINES = "select doc_id, unnest(string_split(text, chr(10))) as para, unnest(range(1, len(string_split(text, chr(10))) + 1))::int as para_no from documents"
OWN = "select doc_id, 1 as edit_seq, 1 as line_number, arg_max(para, para_no) as find from lines where para <> '' group by doc_id"


@query(
    f"with lines as ({LINES}), own as ({OWN}), ranked as (select doc_id, edit_seq, para_no, case when contains(para, substr(find, 1, 50)) and para_no = line_number then 0 "
    "when contains(para, substr(find, 1, 50)) and abs(para_no - line_number) <= 3 then 1 when contains(para, substr(find, 1, 30)) then 2 end as rank from own join lines using (doc_id)) "
    "select doc_id, edit_seq, para_no from ranked where rank is not null qualify row_number() over (partition by doc_id, edit_seq order by rank, para_no) = 1"
)
def nearest_paragraphs(spark, sf_dir):
    lines = lines_of(spark, sf_dir)
    last = lines.filter("text <> ''").groupBy("doc_id").agg(F.max_by("text", "para_no").alias("find"))
    own = last.select("doc_id", F.lit(1).alias("edit_seq"), F.lit(1).alias("line_number"), "find")
    return edits.nearest_paragraphs(own, lines).select("doc_id", "edit_seq", "para_no")


@query(
    f"with lines as ({LINES}), merged as (select doc_id, para_no::bigint * 2 as o, para_no as line_no, replace(para, 'the', 'THE') as text, para_no = 1 and contains(para, 'the') as modified from lines where para_no = 1 "
    "union all select doc_id, para_no::bigint * 2, para_no, para, false from lines where para_no > 1 union all select distinct doc_id, 3, null::int, 'after', true from lines) "
    "select doc_id, row_number() over (partition by doc_id order by o)::int as position, line_no, md5(text) as text_md5, modified from merged"
)
def line_edits(spark, sf_dir):
    lines = lines_of(spark, sf_dir).withColumnRenamed("para_no", "line_no")
    own = lines.filter("line_no = 1").select("doc_id", F.explode(F.expr("array(named_struct('seq', 1, 'change_type', 'replace_text_on_line', 'find', 'the', 'replace', 'THE', 'content', ''), named_struct('seq', 2, 'change_type', 'insert_after_line', 'find', '', 'replace', '', 'content', 'after'))")).alias("c"))
    changes = own.select("doc_id", F.lit(1).alias("line_number"), "c.*")
    return edits.apply_line_edits(lines, changes).withColumn("text_md5", F.md5(F.encode("text", "UTF-8"))).drop("text")


@query()
def redact_earlier_library(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", text.redacted(F.col("text"), LIBRARY_B0, "[LABEL]", "").alias("redacted"))


@query()
def redact_trial_library(spark, sf_dir):
    return docs_of(spark, sf_dir).select("doc_id", text.redacted(F.col("text"), LIBRARY_T, "[LABEL]", "").alias("redacted"))


@query()
def guarded_findings(spark, sf_dir):
    return text.unguarded(text.findings(docs_of(spark, sf_dir), LIBRARY_C, flags=""), STOP_TERMS_C)
