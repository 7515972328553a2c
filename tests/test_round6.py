"""What the fourth round's finding showed: a vault whose shuffles were many times its input."""

import random
import re
import sys

import pytest
from pyspark.sql import functions as F

from clauseloom.operators import vault
from clauseloom.plans import matches, registry
from tests.test_round5 import drawn, held, saved

PARTS = ["Acme", "acme", "ACME", "John Smith", "Ann Lee", "Jo Al", "Jo", "and", "between", "WHEREAS", ",", "Trust", "trusty", "TRUST.", "xAcme", "Inc", "Inc.", "ſtar", "Star", "xStar", "Kelvin", "Kelvin", "Truſt", "lımited", "LİMİTED", "Limited", "Group", "LLC", "Company", "12", "\n1. ", "12/11/2024", "(555) 123-4567", "555-123-4567", "12345", "٣٤٥٦٧", "42 Oak St.", "a@b.co", "O’Brien", "Co.", "L.P.", "&", "since", "help", "Lab", "-", "_", "É", "\t"]


def mixed(n: int, seed: int = 6) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(PARTS) + r.choice([" ", " ", "", "\n", ", "]) for _ in range(r.randrange(1, 14))) for _ in range(n)]


def test_the_vault_by_documents_is_that_over_the_list(spark):
    """Rows without an id or with the same, repeated texts, names met inside of words and by letters beyond a to z: as over a set of the words."""
    # The search for "star trust" in any case meets it spelled with the long s too, inside of a word; "star" is no word of that text.
    texts = ["by Ann, ſtar Trust. xStar Trust", "the star", "Star two", "a star", "star b", "star c", "kelvin", "Kelvin 2", "kelvin 3", "kelvin 4", "kelvin 5", "by, Kelvin Trust and Kelvin", *mixed(150), "", "", "John Smith", "John Smith"]
    rows = [*enumerate(texts), (3, "Zed Star, zed"), (3, "zed Zed"), (None, "zed Zed Quux"), (None, "zed Zed Quux"), (7, None), (None, None)]
    ids: dict[str, set] = {}
    for i, t in rows:
        for w in re.findall("[A-Za-z]+", t or ""):
            ids.setdefault(w.lower(), set()).update([] if i is None else [i])
    listed = {w for w, own in ids.items() if len(own) >= 5 and len(w) > 1}
    assert {"star", "kelvin", "john"} <= listed and not {"zed", "quux"} & listed
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    kept, allow = vault.vault_by_documents(docs, 5)
    assert {r.term for r in allow.collect()} == listed
    plain = vault.vault(docs, frozenset(listed))
    assert sorted(map(str, kept.collect())) == sorted(map(str, plain.collect()))
    assert kept.filter(F.size("found") > 0).count() > 50


def test_a_text_that_lacks_what_a_pattern_needs_is_not_searched(monkeypatch):
    """Against all patterns run over all texts."""
    beyond = {c for c in map(chr, range(128, sys.maxunicode + 1)) if re.fullmatch("[a-z]", c, re.IGNORECASE)}
    assert beyond == set(vault.FOLDED)
    texts, allow = mixed(3000), frozenset(["john", "ann", "acme", "jo", "star"])
    got = [vault.redact("1", t, allow) for t in texts]
    assert vault.entities("nothing to be found here") == []
    monkeypatch.setattr(vault, "FOLDED", ("",))
    monkeypatch.setattr(vault, "PATTERNS", [(label, p, None, False) for label, p, *_ in vault.PATTERNS])
    assert got == [vault.redact("1", t, allow) for t in texts]
    assert {kind for _, found in got for _, _, kind, *_ in found} == {label for label, *_ in vault.PATTERNS}


@pytest.mark.parametrize("seed", [5, 9])
def test_the_vaults_words_are_not_shuffled(spark, tmp_path, seed):
    """The same rows as the SQL's; both the list and the texts' words off it come from one pass over the words."""
    rows = [(i, f"{t} Ann Lee a@b.co Xqa Lee") for i, t in drawn(seed) if i is not None and t is not None]
    sf_dir = saved(spark, rows, tmp_path)
    out = matches.vault_with_allow_list(spark, sf_dir)
    assert sorted(map(tuple, out.collect())) == sorted(held(rows).execute(registry.ORACLE["vault_with_allow_list"]).fetchall())
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = matches.vault_with_allow_list(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert "count(distinct" not in plan and "[^A-Za-z]+" not in plan and plan.count("ArrowEvalPython") == 1 and "ReusedExchange" in plan


def test_texts_without_names_do_not_meet_in_one_task(spark, tmp_path):
    """Their rows had no word, and a null is one key: each text's row went to the same task of the join with the list."""
    sf_dir = saved(spark, [(k, f"no name {k}") for k in range(400)], tmp_path)
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    for k, v in zip(before, ("false", "-1"), strict=True):
        spark.conf.set(k, v)
    try:
        out = matches.vault_with_allow_list(spark, sf_dir)
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert out.count() == 400 and out.filter("mails = 0 and allowed_persons = 0 and restored").count() == 400
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert re.search(r"coalesce\(term#\d+, concat\(#, cast\(row#", plan)
