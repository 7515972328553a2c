"""Agreements and personal data made up for tests, with a table of what was planted: the same rows at any parallelism."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FIRST = ["Ada", "Bruno", "Carla", "Dimitri", "Elena", "Farid", "Greta", "Hugo"]
LAST = ["Abel", "Brandt", "Castro", "Dufour", "Engel", "Fontana", "Graves", "Holm"]
FIRMS = ["Northwind", "Bluebell", "Ironbridge", "Larkspur", "Quarry", "Silverlake", "Tidewater", "Westmark"]
FORMS = ["LLC", "Inc.", "Corp.", "Limited Partnership"]
STREETS = ["Oak Street", "Mill Road", "Harbor Avenue", "Chapel Lane", "Summit Drive"]
TITLES = ["Dr.", "Mr.", "Mrs.", "Attorney", "Director"]
#: What is planted: a label and how its value is made of digits (#, after the first never 0 in front) and lists.
SLOTS = [("SSN", "###-##-####"), ("TAX_ID", "##-#######"), ("PHONE", "###-###-####"), ("CREDIT_CARD", "####-####-####-####"), ("AMOUNT", "$#,###.##"), ("EMAIL", "user####@mail##.example.com"), ("TITLE_NAME", "{title} {last}"), ("ADDRESS", "### {street}")]
LISTS = {"title": TITLES, "last": LAST, "first": FIRST, "street": STREETS, "firm": FIRMS, "form": FORMS}
#: Our own agreement; other templates are a parameter.
AGREEMENT = ["MUTUAL NON-DISCLOSURE AGREEMENT", "This agreement is made by and between {firm} {form}, and {firm} {form}.", "1. Use. The parties shall use the materials for the project only.", "2. Return. On request the receiver shall return the materials to {title} {last} at ### {street}.", "3. Term. The obligations end after three years.", "4. Notices. Notices go to user####@mail##.example.com or ###-###-####."]


def keyed(key: Column, *more, seed: int) -> Column:
    """A number from 0 to 2**32 - 1 that depends on seed, key and more only."""
    parts = F.concat_ws("|", F.lit(str(seed)), key.cast("string"), *(m if isinstance(m, Column) else F.lit(str(m)) for m in more))
    return F.conv(F.substring(F.md5(parts), 1, 8), 16, 10).cast("bigint")


def pieces_of(pattern: str) -> list[str]:
    """A pattern's single signs and its `{list}` names."""
    out, at = [], 0
    while at < len(pattern):
        end = pattern.index("}", at) + 1 if pattern[at] == "{" else at + 1
        out.append(pattern[at:end])
        at = end
    return out


def filled(pattern: str, key: Column, slot, seed: int) -> Column:
    """pattern with a digit (1 to 9) for each # and an entry for each {list}."""
    out = []
    for k, piece in enumerate(pieces_of(pattern)):
        n = keyed(key, slot, k, seed=seed)
        if piece == "#":
            out.append((n % 9 + 1).cast("string"))
        elif piece.startswith("{"):
            listed = LISTS[piece[1:-1]]
            out.append(F.element_at(F.array(*map(F.lit, listed)), (n % len(listed) + 1).cast("int")))
        else:
            out.append(F.lit(piece))
    return F.concat(*out)


def planted(ids: DataFrame, slots: list[tuple[str, str]] = SLOTS, seed: int = 7, id_column: str = "doc_id") -> DataFrame:
    """(id, slot, label, value): one value of each slot for each id."""
    rows = F.array(*(F.struct(F.lit(s).alias("slot"), F.lit(label).alias("label"), filled(p, F.col(id_column), s, seed).alias("value")) for s, (label, p) in enumerate(slots)))
    return ids.select(id_column, F.explode(rows).alias("p")).select(id_column, "p.*")


def with_planted(docs: DataFrame, truth: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the values of truth (doc_id, slot, label, value) as lines at their end."""
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("slot", "value"))), lambda x: F.concat(F.lit("Ref "), x["value"], F.lit(";"))), "\n")
    listed = truth.groupBy("doc_id").agg(lines.alias("lines"))
    return docs.join(listed, "doc_id", "left").select("doc_id", F.concat_ws("\n", "text", "lines").alias("text"))


def contracts(spark: SparkSession, n: int, seed: int = 7, template: list[str] = AGREEMENT) -> DataFrame:
    """n agreements: doc_id (from 1), text. Each row depends on seed and doc_id only."""
    ids = spark.range(1, n + 1).select(F.col("id").alias("doc_id"))
    return ids.select("doc_id", F.concat_ws("\n\n", *(filled(line, F.col("doc_id"), f"line{k}", seed) for k, line in enumerate(template))).alias("text"))


def clean_agreement(spark: SparkSession) -> DataFrame:
    """One agreement with placeholders in place of names and numbers."""
    text = "\n\n".join("".join("[" + p[1:-1].upper() + "]" if p.startswith("{") else p for p in pieces_of(line)).replace("#", "0") for line in AGREEMENT)
    return spark.createDataFrame([(1, text)], "doc_id bigint, text string")


def planted_sql(ids: str, slots: list[tuple[str, str]] = SLOTS, seed: int = 7) -> str:
    """planted() as DuckDB SQL over a query of doc_id."""

    def number(s: int, k: int) -> str:
        return f"('0x' || substr(md5('{seed}|' || doc_id || '|{s}|{k}'), 1, 8))::bigint"

    def value(s: int, p: str) -> str:
        out = []
        for k, piece in enumerate(pieces_of(p)):
            n = number(s, k)
            out.append(f"({n} % 9 + 1)::varchar" if piece == "#" else f"{LISTS[piece[1:-1]]!r}[{n} % {len(LISTS[piece[1:-1]])} + 1]" if piece.startswith("{") else f"'{piece}'")
        return " || ".join(out)

    return " union all ".join(f"select doc_id, {s} as slot, '{label}' as label, {value(s, p)} as value from ({ids})" for s, (label, p) in enumerate(slots))
