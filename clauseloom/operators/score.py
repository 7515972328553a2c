"""The rubric: facts to scores, resolution of two scorers, thresholds. Total decision tables as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The roles that a representatives clause should name.
REQUIRED_ROLES = ["affiliates", "directors", "officers", "employees", "members", "partners", "investors", "agents", "attorneys", "accountants", "brokers", "consultants", "advisors"]
# The order of categories.
CATEGORIES = ["1_carveouts", "2_representatives", "3_sub_agreement", "4_return_destroy", "5_non_circumvention", "6_term", "7_effective_date", "8_compelled_disclosure", "9_remedies"]


def core_scores(required: list[str] = REQUIRED_ROLES) -> dict[str, Column]:
    """The score of each core category, from columns of facts (see tests for their names)."""
    roles = F.array_distinct(F.transform("roles_found", lambda r: F.lower(r)))
    missing = F.size(F.array_except(F.array(*(F.lit(r.lower()) for r in required)), roles))
    concepts, limit = F.size("concepts_found"), F.coalesce("time_limit_years", F.lit(0.0))
    punitive, injunctive, bond = (F.coalesce(F.col(c), F.lit(False)) for c in ("has_punitive_language", "has_injunctive_relief", "has_bond_waiver"))

    def yes(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(False))

    return {
        "1_carveouts": F.when(concepts <= 0, 10).when(concepts == 1, 8).when(concepts == 2, 6).otherwise(0),
        "2_representatives": F.when((F.col("roles_quote") == "NOT FOUND") | (F.size(roles) <= 0), 10).when(F.size(roles) <= 3, 8).when(missing > 4, 7).when(missing >= 2, 5).when(missing == 1, 3).otherwise(0),
        "3_sub_agreement": F.when(F.col("requirement_type") == "sign", 9).when(F.col("requirement_type") == "bound", 7).when(F.col("requirement_type") == "directed", 3).otherwise(0),
        "4_return_destroy": F.when(F.col("trigger") == "automatic", 8).when(F.col("trigger") == "both", 6).when((F.col("trigger") == "upon_request") & ~yes("has_destroy_option"), 4).otherwise(0),
        "5_non_circumvention": F.when(F.coalesce("scope", F.lit("none")) == "none", 0).when((limit == 0) & (F.col("scope") == "broad"), 9).when((limit == 0) & (F.col("scope") == "moderate"), 6).when(limit > 2, 5).otherwise(2),
        "6_term": F.when(F.col("duration_years").isNull(), 9).when(F.col("duration_years") > 2, 7).otherwise(0),
        "7_effective_date": F.when(yes("preamble_date_blank"), 8).when(F.col("date_quote") == "NOT FOUND", 7).when(~yes("has_effective_date_label"), 4).when(yes("signature_page_date_only"), 2).otherwise(0),
        "8_compelled_disclosure": F.when(F.col("compelled_quote") == "NOT FOUND", 8).when(~yes("has_notice_requirement"), 6).when(~yes("has_cooperation_provision"), 3).otherwise(0),
        "9_remedies": F.when(punitive & ~injunctive & ~bond, 9).when(punitive & ~injunctive, 7).when(injunctive & ~bond, 5).when(injunctive & bond & punitive, 2).otherwise(0),
    }


def code_scores(facts: DataFrame) -> DataFrame:
    """(doc_id, category, code_score) in long form."""
    rows = F.array(*(F.struct(F.lit(k).alias("category"), v.cast("int").alias("code_score")) for k, v in core_scores().items()))
    return facts.select("doc_id", F.explode(rows).alias("x")).select("doc_id", "x.category", "x.code_score")


def resolve(ai: DataFrame, code: DataFrame) -> DataFrame:
    """The larger of two scores over the union of their categories; a missing one is 0."""
    both = ai.join(code, ["doc_id", "category"], "full_outer")
    return both.select("doc_id", "category", F.greatest(F.coalesce("ai_score", F.lit(0)), F.coalesce("code_score", F.lit(0))).alias("final_score"))


def apply_thresholds(scores: DataFrame, auto: int = 8, total: int = 15, count: int = 3, nice_total: int = 20, nice_high: int = 2) -> DataFrame:
    """The categories to act on, with band (1: from `auto`, 2: 5 to 7, 3: 1 to 4) and the document's total."""
    w, s = Window.partitionBy("doc_id"), F.col("final_score")
    out = scores.withColumns({"total": F.sum(s).over(w), "high": F.count_if(s >= auto).over(w), "middle": F.count_if(s.between(5, 7)).over(w)})
    band = F.when(s >= auto, 1).when(s.between(5, 7) & ((F.col("total") >= total) | (F.col("middle") >= count) | (F.col("high") > 0)), 2)
    band = band.when(s.between(1, 4) & ((F.col("total") >= nice_total) | (F.col("high") >= nice_high)), 3)
    return out.withColumn("band", band).filter("band is not null").select("doc_id", "category", "final_score", "band", "total")


def reply_patterns(reply: Column) -> Column:
    """A reviewer's `Pattern 3: NOT FOUND - why` lines as structs of pattern_no and found."""
    lines = F.regexp_extract_all(reply, F.lit(r"Pattern \d{1,9}: (?:NOT FOUND|FOUND)"), F.lit(0))
    return F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"(\d+)", 1).cast("int").alias("pattern_no"), (~F.contains(x, F.lit("NOT"))).alias("found")))


def reply_intents(reply: Column) -> Column:
    """A reviewer's `INTENT 2 ... Status: MISSING` parts as structs of intent_no and status; a status never comes from the next part."""
    parts = F.regexp_extract_all(reply, F.lit(r"(?s)INTENT \d{1,9}(?:(?!INTENT \d).)*?Status: \w+"), F.lit(0))
    return F.transform(parts, lambda x: F.struct(F.regexp_extract(x, r"INTENT (\d+)", 1).cast("int").alias("intent_no"), F.regexp_extract(x, r"Status: (\w+)\z", 1).alias("status")))
