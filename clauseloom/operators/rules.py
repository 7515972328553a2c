"""Edit generation: each rule is a column of edit structs; one document's edits are their concatenation in rule order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.operators.score import REQUIRED_ROLES

FIELDS = ("type", "find", "replace", "content", "qualifier", "anchor_quote", "anchor_description", "quoted", "category")
EDIT = "array<struct<type:string,find:string,replace:string,content:string,qualifier:string,anchor_quote:string,anchor_description:string,quoted:string,category:string,candidates:array<string>>>"

#: Short texts of our own that edits insert where a client's template file (readers.configuration) has no other. Placeholders are filled from the document's terms.
TEMPLATES = {
    "carveout_block": "{conf} does not cover what (a) {receiver} or its {reps} already hold or lawfully receive from others, (b) is or becomes public without fault of {receiver} or its {reps}, or (c) they develop on their own.",
    "prior_possession": "; ({letter}) what {receiver} or its {reps} already hold or lawfully receive from others",
    "independent_dev": "; ({letter}) what {receiver} or its {reps} develop without use of {conf}",
    "public": "; ({letter}) what is public, or becomes so without fault of {receiver} or its {reps}",
    "term_clause": "This Agreement ends {duration} after its date.",
    "compelled_disclosure_block": "If a court or authority so orders, {receiver} may disclose {conf}; where it lawfully can, it first tells {provider} and helps it to seek protection.",
    "no_obligation": "Signing this Agreement does not oblige {receiver} to proceed.",
    "signature_notation": "[Signature page follows]",
}
# Phrases that are swapped or deleted.
SIGN_PHRASES = ["sign a copy of this Agreement", "sign a confidentiality agreement", "obtain the written agreement of", "sign a separate"]
BOUND_PHRASES = ["agree to be bound by", "bound by its terms", "bound by the provisions", "bound by the terms"]
RETURN_PHRASES = ["upon termination", "upon expiration", "upon completion", "upon the termination", "upon the expiration"]
DATE_BLANKS = ["_____ day of _____", "________________,", "____day of ____", "_____ day of _______________,", "______ day of", "_________,", "_____________, ___", "_____________,  ___"]
PUNITIVE_PHRASES = ["any and all forms and types of remuneration", "all expenses incurred in enforcing", "consequential and incidental damages"]
FEE_PHRASES = ["attorney's fees", "attorneys' fees", "attorneys fees"]
COMMERCIAL_SWAPS = [("take all steps", "take all commercially reasonable steps"), ("shall ensure", "shall use commercially reasonable efforts to ensure"), ("best efforts", "commercially reasonable efforts")]


def fill(template: str, texts: dict[str, str] = TEMPLATES, **more: Column) -> Column:
    """A template with the document's own terms, or their defaults."""
    names = {"conf": ("conf_info_term", "Confidential Information"), "receiver": ("receiver_term", "Recipient"), "provider": ("provider_term", "Discloser"), "reps": ("reps_term", "Representatives")}
    out = F.lit(texts.get(template, TEMPLATES[template]))
    for k, v in {**{k: F.coalesce(F.col(c), F.lit(d)) for k, (c, d) in names.items()}, **more}.items():
        out = F.replace(out, F.lit(f"{{{k}}}"), v)
    return out


def edit(type_: str, category: str, candidates: Column | None = None, **fields) -> Column:
    values = {"type": type_, "category": category, **fields}
    parts = [(v if isinstance(v := values.get(f), Column) else F.lit(v)).cast("string").alias(f) for f in FIELDS]
    return F.struct(*parts, (candidates if candidates is not None else F.lit(None)).cast("array<string>").alias("candidates"))


def some(condition: Column, *edits: Column) -> Column:
    return F.when(F.coalesce(condition, F.lit(False)), F.array(*edits)).otherwise(F.array().cast(EDIT))


def quote_of(*columns: str) -> Column:
    """The first of the quotes that is there."""
    return F.coalesce(*(F.when((F.col(c) != "") & (F.col(c) != "NOT FOUND"), F.col(c)) for c in columns), F.lit(""))


def rule_edits(as_of: str, texts: dict[str, str] = TEMPLATES, circumvention: str = "delete") -> dict[str, Column]:
    """One column of edits for each rule. as_of: the date that blanks are filled with, such as `January 05, 2024`.

    texts: templates that replace the default ones. circumvention: what becomes of such a clause, `delete` or a limit in words.
    """
    conf = F.coalesce("conf_info_term", F.lit("Confidential Information"))
    receiver, provider = F.coalesce("receiver_term", F.lit("Recipient")), F.coalesce("provider_term", F.lit("Discloser"))
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, ("public", "prior_possession", "independent_dev"))), "concepts_found"))
    tail = F.trim(F.rtrim(F.col("carveout_quote"), F.lit(".")))
    tails = F.array(*(F.right(tail, F.lit(n)) for n in (50, 40, 30, 20)))
    none_left = (F.size(missing) == 3) | (F.col("carveout_quote") == "NOT FOUND")

    def missing_concept(concept: Column, i: Column) -> Column:
        letter = F.char(F.lit(97) + F.size("concepts_found") + i)
        content = F.when(concept == "public", fill("public", texts, letter=letter)).when(concept == "prior_possession", fill("prior_possession", texts, letter=letter)).otherwise(fill("independent_dev", texts, letter=letter))
        return edit("insert_after", "1_carveouts", tails, content=content)

    required = [r.lower() for r in REQUIRED_ROLES]
    absent = F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.transform("roles_found", lambda r: F.lower(r))))
    has_clause = (F.coalesce("roles_quote", F.lit("")) != "") & (F.col("roles_quote") != "NOT FOUND")
    last_role = F.try_element_at("roles_found", F.lit(-1))
    years = F.col("duration_years")
    no_term = years.isNull() | F.coalesce(F.col("term_quote") == "NOT FOUND", F.lit(False))
    blank = F.coalesce("preamble_date_blank", F.lit(False))
    date_there = (F.coalesce("date_quote", F.lit("")) != "") & (F.col("date_quote") != "NOT FOUND")
    found = {c: F.array_contains("found", c) for c in ("c1", "c2", "c3", "c4", "c5", "c6", "c7", "c9")}
    return {
        "1_carveouts": F.when(none_left, F.array(edit("insert_block", "1_carveouts", anchor_quote=quote_of("carveout_quote", "roles_quote", "sub_quote", "return_quote"), anchor_description="after confidential info definition", content=fill("carveout_block", texts))))
        .when(F.length("carveout_quote") > 20, F.transform(missing, missing_concept)).otherwise(F.array().cast(EDIT)),
        "2_representatives": F.concat(
            some((F.size(absent) > 0) & has_clause & (F.size("roles_found") > 0), edit("insert_after", "2_representatives", find=last_role, content=F.concat(F.lit(", "), F.array_join(absent, ", "), F.lit(",")))),
            some((F.size(absent) > 0) & ~has_clause, edit("insert_block", "2_representatives", anchor_description="after confidentiality obligation", content=F.concat(receiver, F.lit(" may share the "), conf, F.lit(" with its " + ", ".join(REQUIRED_ROLES) + ' ("Representatives").')))),
            some(F.coalesce("reps_term", F.lit("null")).isin("", "null"), edit("insert_after", "2_representatives", find=F.coalesce(last_role, F.lit("")), content=' ("Representatives")')),
        ),
        "3_sub_agreement": F.concat(
            some(F.col("requirement_type") == "sign", *(edit("swap_phrase", "3_sub_agreement", find=p, replace=F.concat(F.lit("are informed of the confidential nature of the "), conf)) for p in SIGN_PHRASES)),
            some(F.col("requirement_type") == "bound", *(edit("swap_phrase", "3_sub_agreement", find=p, replace=F.concat(F.lit("informed of the confidential nature of the "), conf)) for p in BOUND_PHRASES)),
        ),
        "4_return_destroy": F.concat(
            some(F.col("trigger") == "automatic", *(edit("swap_phrase", "4_return_destroy", find=p, replace=F.concat(F.lit("Upon "), provider, F.lit("'s request"))) for p in RETURN_PHRASES)),
            some(~F.coalesce("has_destroy_option", F.lit(False)), edit("insert_after", "4_return_destroy", find="return the", content=" or destroy/delete the")),
        ),
        "5_non_circumvention": some(
            F.coalesce("scope", F.lit("none")) != "none",
            edit("delete_block", "5_non_circumvention", anchor_description="non-circumvention paragraph", quoted=F.col("circumvention_quote"))
            if circumvention == "delete" else edit("insert_words", "5_non_circumvention", anchor_description="non-circumvention paragraph", quoted=F.col("circumvention_quote"), content=circumvention),
        ),
        "6_term": F.when(no_term, F.array(edit("insert_block", "6_term", anchor_quote=quote_of("compelled_quote", "return_quote", "circumvention_quote", "sub_quote", "roles_quote", "carveout_quote"), anchor_description="after last clause", content=fill("term_clause", texts, duration=F.lit("1 year")))))
        .when(years >= 5, F.array(edit("swap_phrase", "6_term", F.array(*map(F.lit, ("five (5) years", "5 years", "five years"))), replace="three (3) years")))
        .when(years >= 3, F.array(*(edit("swap_phrase", "6_term", F.array(F.lit(f"{w} ({n}) years"), F.lit(f"{n} years"), F.lit(f"{w} years")), replace="two (2) years") for n, w in ((4, "four"), (3, "three"))))).otherwise(F.array().cast(EDIT)),
        "7_effective_date": F.when(blank, F.when(date_there, F.filter(F.array(*(edit("swap_phrase", "7_effective_date", find=p, replace=f'{as_of} ("Effective Date")') for p in DATE_BLANKS)), lambda _: F.contains("date_quote", F.lit("_")))).otherwise(F.array().cast(EDIT)))
        .otherwise(some(~F.coalesce("signature_page_date_only", F.lit(False)) & ~F.coalesce("has_effective_date_label", F.lit(False)) & date_there & (F.trim(F.left("date_quote", F.lit(40))) != ""), edit("insert_after", "7_effective_date", find=F.trim(F.left("date_quote", F.lit(40))), content=' ("Effective Date")'))),
        "8_compelled_disclosure": some(F.col("compelled_quote") == "NOT FOUND", edit("insert_block", "8_compelled_disclosure", anchor_quote=quote_of("return_quote", "sub_quote", "roles_quote", "carveout_quote"), anchor_description="after confidentiality obligation paragraph", content=fill("compelled_disclosure_block", texts))),
        "9_remedies": F.concat(
            some(F.col("has_punitive_language"), *(edit("delete_phrase", "9_remedies", find=p) for p in PUNITIVE_PHRASES)),
            some(F.col("has_injunctive_relief") & ~F.coalesce("has_bond_waiver", F.lit(False)), edit("insert_after", "9_remedies", find="injunctive relief", content=" without necessity of posting any bond")),
        ),
        "c1": some(found["c1"], edit("insert_after", "c1", find="facsimile", content=" or electronic")),
        "c2": some(found["c2"], *(edit("add_qualifier", "c2", find=p, qualifier="reasonable ") for p in FEE_PHRASES)),
        "c3": some(found["c3"], edit("insert_after", "c3", find="any disclosure", content=" that is in breach of this Agreement")),
        "c4": some(found["c4"], edit("append_sentence", "c4", anchor_description="before signature block", content=fill("no_obligation", texts))),
        "c5": some(found["c5"], edit("swap_word", "c5", find="personal", replace="business")),
        "c6": some(found["c6"], edit("insert_before_signature", "c6", content=fill("signature_notation", texts))),
        "c7": some(found["c7"], *(edit("swap_phrase", "c7", find=a, replace=b) for a, b in COMMERCIAL_SWAPS)),
        "c9": some(found["c9"], edit("insert_words", "c9", anchor_description="in purpose clause", content=", purchasing")),
    }


def generate(facts: DataFrame, as_of: str, enabled: dict[str, bool] | DataFrame | None = None, texts: dict[str, str] = TEMPLATES, circumvention: str = "delete") -> DataFrame:
    """(doc_id, edit_seq, edit fields) of all rules that are enabled, in order.

    enabled: switches by category, as a dict or as a table (category, enabled); a category that it doesn't name is on.
    """
    rules = list(rule_edits(as_of, texts, circumvention).items())
    if isinstance(enabled, dict):
        rules = [(k, v) for k, v in rules if enabled.get(k, True)]
    out = facts.select("doc_id", F.posexplode(F.concat(*(v for _, v in rules))).alias("i", "e")).select("doc_id", "i", "e.*")
    if isinstance(enabled, DataFrame):  # a row for each category: a dozen or two
        out = out.join(F.broadcast(enabled.select("category", F.col("enabled").alias("on")).dropDuplicates(["category"])), "category", "left").filter(F.coalesce("on", F.lit(True))).drop("on")
    seq = F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    return out.withColumn("edit_seq", seq).select("doc_id", "edit_seq", *FIELDS, "candidates")
