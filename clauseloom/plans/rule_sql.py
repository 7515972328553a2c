"""DuckDB SQL of the edit rules over the facts that the queries make from document ids."""

from __future__ import annotations

from clauseloom.operators import rules, score

FIELDS = ("find", "replace", "content", "qualifier", "anchor_quote", "anchor_description", "quoted", "candidates")
NAMES = {"conf": "'Confidential Information'", "receiver": "'Buyer'", "provider": "'Discloser'", "reps": "coalesce(reps_term, 'Representatives')"}


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def made(kind: str, category: str, **fields: str) -> str:
    """An edit as a struct; fields are SQL, texts that stand as they are come through text()."""
    return "{'category': " + text(category) + ", 'type': " + text(kind) + "".join(f", '{f}': ({fields.get(f, 'null')})::varchar" for f in FIELDS) + "}"


def some(condition: str, *edits: str) -> str:
    return f"case when {condition} then [{', '.join(edits)}] else [] end"


def filled(template: str, **more: str) -> str:
    out = text(rules.TEMPLATES[template])
    for k, v in (NAMES | more).items():
        out = f"replace({out}, '{{{k}}}', {v})"
    return out


def joined(*parts: str) -> str:
    return "array_to_string([" + ", ".join(parts) + "], '|')"


def first_quote(*columns: str) -> str:
    return "coalesce(" + ", ".join(f"case when {c} <> '' and {c} <> 'NOT FOUND' then {c} end" for c in columns) + ", '')"


def concept(x: str) -> str:
    letter = "chr((97 + len(concepts_found) + list_position(missing, x) - 1)::int)"
    tails = joined(*(f"right(tail, {n})" for n in (50, 40, 30, 20)))
    content = "case x when 'public' then {} when 'prior_possession' then {} else {} end".format(*(filled(t, letter=letter) for t in ("public", "prior_possession", "independent_dev")))
    return f"list_transform({x}, lambda x: {made('insert_after', '1_carveouts', content=content, candidates=tails)})"


ROLES = ", ".join(score.REQUIRED_ROLES)
NO_BLOCK = "(len(missing) = 3 or carveout_quote = 'NOT FOUND')"
HAS_ROLES = "(roles_quote <> '' and roles_quote <> 'NOT FOUND')"
HAS_DATE = "(date_quote <> '' and date_quote <> 'NOT FOUND')"
BLANKED = text('January 05, 2024 ("Effective Date")')
RULES = [
    f"case when {NO_BLOCK} then [{made('insert_block', '1_carveouts', anchor_quote=first_quote('carveout_quote', 'roles_quote', 'sub_quote', 'return_quote'), anchor_description=text('after confidential info definition'), content=filled('carveout_block'))}] when length(carveout_quote) > 20 then {concept('missing')} else [] end",
    some(f"len(absent) > 0 and {HAS_ROLES} and len(roles_found) > 0", made("insert_after", "2_representatives", find="roles_found[-1]", content="', ' || array_to_string(absent, ', ') || ','")),
    some(f"len(absent) > 0 and not {HAS_ROLES}", made("insert_block", "2_representatives", anchor_description=text("after confidentiality obligation"), content="'Buyer may share the Confidential Information with its ' || " + text(ROLES + ' ("Representatives").'))),
    some("reps_term is null", made("insert_after", "2_representatives", find="coalesce(roles_found[-1], '')", content=text(' ("Representatives")'))),
    some("requirement_type = 'sign'", *(made("swap_phrase", "3_sub_agreement", find=text(p), replace=text("are informed of the confidential nature of the Confidential Information")) for p in rules.SIGN_PHRASES)),
    some("requirement_type = 'bound'", *(made("swap_phrase", "3_sub_agreement", find=text(p), replace=text("informed of the confidential nature of the Confidential Information")) for p in rules.BOUND_PHRASES)),
    some("trigger = 'automatic'", *(made("swap_phrase", "4_return_destroy", find=text(p), replace=text("Upon Discloser's request")) for p in rules.RETURN_PHRASES)),
    some("not has_destroy_option", made("insert_after", "4_return_destroy", find=text("return the"), content=text(" or destroy/delete the"))),
    some("scope <> 'none'", made("delete_block", "5_non_circumvention", anchor_description=text("non-circumvention paragraph"), quoted="circumvention_quote")),
    some("duration_years is null", made("insert_block", "6_term", anchor_quote=first_quote("compelled_quote", "return_quote"), anchor_description=text("after last clause"), content=filled("term_clause", duration="'1 year'"))),
    some("duration_years >= 5", made("swap_phrase", "6_term", candidates=text("five (5) years|5 years|five years"), replace=text("three (3) years"))),
    some("duration_years >= 3 and duration_years < 5", *(made("swap_phrase", "6_term", candidates=text(f"{w} ({n}) years|{n} years|{w} years"), replace=text("two (2) years")) for n, w in ((4, "four"), (3, "three")))),
    some(f"preamble_date_blank and {HAS_DATE} and contains(date_quote, '_')", *(made("swap_phrase", "7_effective_date", find=text(p), replace=BLANKED) for p in rules.DATE_BLANKS)),
    some(f"not preamble_date_blank and not signature_page_date_only and not has_effective_date_label and {HAS_DATE}", made("insert_after", "7_effective_date", find="trim(left(date_quote, 40))", content=text(' ("Effective Date")'))),
    some("compelled_quote = 'NOT FOUND'", made("insert_block", "8_compelled_disclosure", anchor_quote="return_quote", anchor_description=text("after confidentiality obligation paragraph"), content=filled("compelled_disclosure_block"))),
    some("has_punitive_language", *(made("delete_phrase", "9_remedies", find=text(p)) for p in rules.PUNITIVE_PHRASES)),
    some("has_injunctive_relief and not has_bond_waiver", made("insert_after", "9_remedies", find=text("injunctive relief"), content=text(" without necessity of posting any bond"))),
    some("doc_id % 3 = 1", made("insert_after", "c1", find=text("facsimile"), content=text(" or electronic"))),
    some("doc_id % 3 = 2", *(made("add_qualifier", "c2", find=text(p), qualifier="'reasonable '") for p in rules.FEE_PHRASES)),
    some("doc_id % 3 = 0", made("insert_after", "c3", find=text("any disclosure"), content=text(" that is in breach of this Agreement"))),
    some("doc_id % 3 = 1", made("append_sentence", "c4", anchor_description=text("before signature block"), content=filled("no_obligation"))),
    some("doc_id % 3 = 2", made("swap_word", "c5", find=text("personal"), replace=text("business"))),
    some("doc_id % 3 = 0", made("insert_before_signature", "c6", content=filled("signature_notation"))),
    some("doc_id % 3 = 1", *(made("swap_phrase", "c7", find=text(a), replace=text(b)) for a, b in rules.COMMERCIAL_SWAPS)),
    some("doc_id % 3 = 0", made("insert_words", "c9", anchor_description=text("in purpose clause"), content=text(", purchasing"))),
]
SHOWN = "concat_ws('|', " + ", ".join(f"coalesce(e.{f}, '-')" for f in FIELDS) + ")"


def edits_sql(facts: str) -> str:
    """doc_id, edit_seq, category, type and a digest of all other fields of each edit."""
    required = "[" + ", ".join(text(r.lower()) for r in score.REQUIRED_ROLES) + "]"
    more = (
        "case when doc_id % 4 = 0 then 'NOT FOUND' else 'the term shall not include information that is public ' || doc_id end as carveout_quote, 'such persons sign' as sub_quote, 'return the materials' as return_quote, 'shall not contact' as circumvention_quote, "
        "case when doc_id % 2 = 0 then 'Agents' end as reps_term"
    )
    lists = f"list_sort(list_filter(['public', 'prior_possession', 'independent_dev'], lambda x: not list_contains(concepts_found, x))) as missing, trim(rtrim(carveout_quote, '.')) as tail, list_sort(list_filter({required}, lambda x: not list_contains(list_transform(roles_found, lambda r: lower(r)), x))) as absent"
    return (
        f"with f as ({facts}), g as (select *, {more} from f), h as (select *, {lists} from g), a as (select doc_id, list_concat({', '.join(RULES)}) as es from h), u as (select doc_id, unnest(es) as e, unnest(range(1, len(es) + 1)) as edit_seq from a) "
        f"select doc_id, edit_seq::int as edit_seq, e.category as category, e.type as type, md5({SHOWN}) as edit_md5 from u"
    )
