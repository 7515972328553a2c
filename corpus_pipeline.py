"""A corpus pipeline of five stages over `documents`; each works on all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauseloom.llm import langid, ordermin, packing, substring, toxicity
from clauseloom.llm.common import discard, stored, table
from clauseloom.llm.queries import language_model, toxicity_model
from clauseloom.llm.substring import row_ids

#: A text is toxic from this score on; its language is unknown below that posterior.
TOXIC, KNOWN = 0.3, 0.5


def _scored(docs: DataFrame, score) -> DataFrame:
    """Each whole row as the struct `row` (so its columns may have any names) with the score of its text, in one pass."""
    return score(docs.select(F.struct(*docs.columns).alias("row"), F.col("text")), id_column="row")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents with a toxicity score of TOXIC or more go.

    Null and empty texts stay (there is no evidence in them), repeated rows are scored alike, and all columns come through.
    """
    model = toxicity_model(docs, table(spark, sf_dir, "labels"))
    out = _scored(docs, lambda df, id_column: toxicity.score(df, model, id_column))
    return out.filter(F.col("score") < TOXIC).select("row.*")


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents without letters (null and empty ones too), or of no language known with KNOWN posterior, go.

    Repeated rows are judged alike and all columns come through.
    """
    model = language_model(docs)
    out = _scored(docs, lambda df, id_column: langid.identify(df, model, id_column))
    return out.filter((F.col("lang_pred") != "und") & (F.col("score") >= KNOWN)).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 9: one row of each class of near-duplicates stays, of the least doc_id (nulls last).

    Null texts and texts without a word are classes of their own. Of rows that repeat id and text one stays.
    """
    kept = ordermin.near_classes(docs).filter("kept").select("rid", "rid2").distinct()
    own = docs.select(*row_ids("doc_id", "text"), F.struct(*docs.columns).alias("row"))
    return own.join(kept.hint("merge"), ["rid", "rid2"]).dropDuplicates(["rid", "rid2"]).select("row.*")


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: words in windows that an earlier document has go; a document of which nothing is left goes too.

    Texts that lose nothing stay as they are, null and empty ones too; n_chars, where there is one, follows the text.
    """
    cut = substring.remove_repeats(docs, carry=True).filter("n_removed = 0 or n_removed < n_words")
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("row.text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept").cast("bigint")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {"text": text}
    return cut.select([new[c].alias(c) if c in new else F.col(f"row.{c}") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: all documents' pieces and their places in sequences of at most 2048 tokens; null texts are empty."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("toxicity", drop_toxic), ("language", keep_known_language), ("near_duplicates", drop_near_duplicates), ("substrings", drop_repeats), ("packing", pack)]

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
