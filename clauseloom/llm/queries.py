"""The registered queries of the training-data operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clauseloom.llm import ann, bpe, fst_tokens, hamerly, jpeg, langid, ordermin, packing, substring, sweep, toxicity, urlfilter, winnowing
from clauseloom.llm.common import fold_of, table

#: The rules of operator 5's contract.
URL_RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def held_out(parts: int, fold: int):
    return F.coalesce(fold_of("doc_id", parts) == fold, F.lit(False))


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"))


def language_model(docs: DataFrame) -> langid.LanguageModel:
    return langid.train(docs.filter(fold_of("doc_id", 3) != 1))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = langid.identify(docs, language_model(docs))
    return out.select("doc_id", held_out(3, 1).alias("held_out"), "lang_pred", "score")


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel:
    known = labels.filter(fold_of("doc_id", 4) != 2).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return toxicity.train(docs, known)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity_model(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fst_tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.rule_table(spark, URL_RULES))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = jpeg.store_texts(table(spark, sf_dir, "documents"))
    read = jpeg.read_media(stored)
    size = F.octet_length("thumbnail")
    return read.select(
        "doc_id", "n_bytes", size.cast("bigint").alias("payload_bytes"), F.sha2("thumbnail", 256).alias("payload_sha256"), F.crc32(F.substr(F.col("thumbnail"), size - 31, F.lit(32))).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), F.concat_ws(":", F.format_string("%dx%s", "n_images", "sizes"), "thumb_hash").alias("feature"),
    )


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordermin.near_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "proved")


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = winnowing.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, centroids = hamerly.clusters(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.transform("centroid", lambda x: x.cast("string")), ","), 256)
    of = centroids.select("cluster", F.col("inertia").alias("cluster_inertia"), F.sum("inertia").over(Window.partitionBy()).alias("inertia"), digest.alias("centroid_sha256"))
    return vectors.withColumnRenamed("id", "vec_id").join(F.broadcast(of), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


#: The times of operator 13's contract, in seconds.
TIMES, EARLY, ARRIVES_WITHIN, EXPIRES_WITHIN, STALE_AFTER = 20000, 60, 300, 900, 60


def op13_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an id's rows name several sources, its labels ask about the least of them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    a, b, c, d = (F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), at, 8), 16, 10).cast("bigint") for at in (1, 9, 17, 25))
    event = a % TIMES
    versions = docs.select(F.col("source").alias("key"), event.alias("event"), (event - EARLY + b % ARRIVES_WITHIN).alias("arrival"), (event + c % EXPIRES_WITHIN).alias("expiry"), F.col("doc_id").alias("id"), "n_chars", "lang")
    sources = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.min("source").alias("key"))
    queries = labels.select("doc_id", (d % TIMES).alias("at")).join(sources.hint("merge"), "doc_id", "left")
    out = sweep.point_in_time(queries, versions, ["n_chars", "lang"])
    age = F.col("at") - F.col("event")
    status = F.when(age.isNull(), "none").when(age > STALE_AFTER, "stale").otherwise("fresh")
    return out.select("doc_id", F.col("at").alias("t"), "version_id", age.alias("age"), status.alias("status"), *(F.when(status == "fresh", F.col(x)).alias(x) for x in ("n_chars", "lang")))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_language, op3_toxicity, op4_token_counts, op5_url_filters, op6_media, op7_nearest, op8_repeats, op9_near_duplicates, op10_packing, op11_decontamination, op12_clusters, op13_point_in_time)}

LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ITEM_WORDS = f"coalesce(regexp_extract_all({LOWERED.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), [])"


def cluster_sql(k: int = 40, rounds: int = 5, dim: int = 64) -> str:
    """All distances of each round, from the centroids of the one before."""
    steps = [f"""kept as materialized (select vec_id, row_number() over () as n, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
      from embeddings where len(embedding) = {dim} and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = {dim}),
x as materialized (select n, unnest(range(1, {dim + 1})) as i, unnest(v) as v from kept),
first as (select n, row_number() over (order by sha256('2:' || vec_id::varchar)) - 1 as c from kept qualify c < {k}),
c0 as materialized (select c, i, v from first join x using (n))"""]  # fmt: skip
    for r in range(rounds + 1):
        steps.append(f"""a{r} as materialized (select n, c, d from (select x.n, k.c, sum((x.v - k.v) * (x.v - k.v)) as d from x join c{r} k using (i) group by all) qualify row_number() over (partition by n order by d, c) = 1)""")
        if r < rounds:
            steps.append(f"""m{r} as (select c, i, sum(v) as s, count(*) as k from a{r} join x using (n) group by all),
c{r + 1} as materialized (select o.c, o.i, coalesce((s - ((s % k) + k) % k) // k, o.v)::bigint as v from c{r} o left join m{r} m using (c, i))""")
    return f"""with {", ".join(steps)}
select vec_id, a.c::int as cluster, d::bigint as distance, (sum(d) over (partition by a.c))::bigint as cluster_inertia, (sum(d) over ())::bigint as inertia, h as centroid_sha256
from a{rounds} a join kept using (n) join (select c, sha256(string_agg(v::varchar, ',' order by i)) as h from c{rounds} group by c) using (c)"""


ORACLE = {
    "op5_url_filters": """
with rules(rule_host, rule_path, v) as (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
cut as (select page_id, row_number() over () as n, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, n, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
fits as (select p.n, r.rule_host || r.rule_path as rule, r.v, row_number() over (partition by p.n order by length(r.rule_host || r.rule_path) desc, length(r.rule_host) desc, r.v desc) as k
         from parts p join rules r on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host)) and starts_with(p.path, r.rule_path))
select p.page_id, p.host, p.path, f.rule, coalesce(f.v, 'allow') as verdict from parts p left join fits f on f.n = p.n and f.k = 1
""",
    "op11_decontamination": f"""
with d as (select doc_id, row_number() over () as n, {ITEM_WORDS} as ws from documents),
i as (select item_id, ws, least(len(ws), 10) as span from (select item_id, {ITEM_WORDS} as ws from benchmark) where len(ws) > 0),
iw as materialized (select distinct item_id, span, array_to_string(ws[s:s + span - 1], ' ') as w from (select *, unnest(range(1, len(ws) - span + 2)) as s from i)),
dw as (select n, s, span, array_to_string(ws[s:s + span - 1], ' ') as w from (select n, ws, span, unnest(range(1, len(ws) - span + 2)) as s from d, (select distinct span from iw) where len(ws) >= span)),
hit as materialized (select dw.n, dw.s, dw.span, iw.item_id from dw join iw using (span, w)),
covered as (select n, count(*) as k from (select distinct n, unnest(range(s, s + span)) as p from hit) group by n),
named as (select n, count(*) as k, string_agg(item, ',' order by item) as items from (select distinct n, item_id::varchar as item from hit where item_id is not null) group by n)
select doc_id, len(ws)::bigint as n_words, coalesce(c.k, 0)::bigint as n_hit, coalesce(m.k, 0)::bigint as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(c.k, 0) > 0 as contaminated
from d left join covered c using (n) left join named m using (n)
""",
    "op12_clusters": cluster_sql(),
    "op13_point_in_time": """
with h as (select doc_id, source, n_chars, lang, sha256(doc_id::varchar) as x from documents),
v as (select doc_id, source, n_chars, lang, ('0x' || substr(x, 1, 8))::bigint % 20000 as event, ('0x' || substr(x, 9, 8))::bigint % 300 as late, ('0x' || substr(x, 17, 8))::bigint % 900 as life from h),
l as (select row_number() over () as n, doc_id, ('0x' || substr(sha256(doc_id::varchar), 25, 8))::bigint % 20000 as t from labels),
q as (select l.n, l.doc_id, l.t, s.source from l left join (select doc_id, min(source) as source from documents group by doc_id) s using (doc_id)),
w as (select q.n, v.doc_id as version_id, q.t - v.event as age, v.n_chars, v.lang from q join v on v.source = q.source and v.event <= q.t and v.event - 60 + v.late <= q.t and q.t < v.event + v.life
      qualify row_number() over (partition by q.n order by v.event desc, v.late, v.doc_id desc, v.n_chars desc nulls last, v.lang desc nulls last) = 1)
select q.doc_id, q.t, w.version_id, w.age, case when w.age is null then 'none' when w.age > 60 then 'stale' else 'fresh' end as status,
       case when w.age <= 60 then w.n_chars end as n_chars, case when w.age <= 60 then w.lang end as lang
from q left join w using (n)
""",
}
