"""Queries of the subpackage, each over its whole tables, with SQL where it exists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm import bpe, canonical_list, charforms, components, mixing, name_links, pii, scan_repair
from vellum.session import materialize, settled
from vellum.sources.tables import table

#: The states of a candidate that confirm it.
CONFIRMING = ["confirmed", "confirmed_tenure", "confirmed_wikidata"]


def p1_mapped(spark: SparkSession, folder: str) -> DataFrame:
    """Every typed title with its work or ``none``, and the score of the match."""
    typed = table(spark, folder, "same_title_works", "same_title_id", "verbatim_title", "work_key")
    return canonical_list.map_titles(typed, table(spark, folder, "research_work"))


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The work meant by each typed title, or the string none."""
    return p1_mapped(spark, folder).select("same_title_id", "work_id")


@settled
def p1_exact(spark: SparkSession, folder: str) -> DataFrame:
    """What p1_found gives for titles typed exactly as the one entry has it, without a key."""
    listed = table(spark, folder, "research_work", "work_id", "canonical_title", "title_note").where("canonical_title is not null")
    billed = listed.select(F.regexp_extract("title_note", canonical_list.BILLED, 1).alias("verbatim_title")).where("verbatim_title <> ''").distinct()
    sole = listed.groupBy(F.col("canonical_title").alias("verbatim_title")).agg(F.count("*").alias("n")).where("n = 1")
    typed = table(spark, folder, "same_title_works", "same_title_id", "verbatim_title", "work_key").where("work_key is null").distinct()
    exact = typed.join(sole, "verbatim_title", "left_semi").join(billed, "verbatim_title", "left_anti").select("same_title_id")
    return p1_found(spark, folder).join(exact, "same_title_id", "left_semi")


def _passage_noise(spark: SparkSession, folder: str) -> scan_repair.Repairs:
    passages = table(spark, folder, "review_passage", "block_id", "block_type", "text", "caption_text")
    fields = passages.select(
        "block_id",
        (F.col("block_type") == "heading").alias("heading"),
        F.explode(
            F.array(
                F.struct(F.lit("text").alias("field_name"), F.col("text").alias("value")),
                F.struct(F.lit("caption_text").alias("field_name"), F.col("caption_text").alias("value")),
            )
        ).alias("f"),
    ).select("block_id", "heading", "f.*")
    names = table(spark, folder, "production_entry_credit", "name_printed").select(F.col("name_printed").alias("name")).unionByName(
        table(spark, folder, "review_credit", "name_surface").select(F.col("name_surface").alias("name"))
    )
    return scan_repair.find_noise(fields, ["block_id", "field_name"], "value", "heading", names)


@settled
def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Kinds of noise that each field of a passage holds."""
    return scan_repair.noise_kinds(_passage_noise(spark, folder))


@settled
def p2_repaired(spark: SparkSession, folder: str) -> DataFrame:
    """Every text and caption as a continuous, corrected paragraph."""
    return scan_repair.repaired(_passage_noise(spark, folder))


def p3_persons(spark: SparkSession, folder: str) -> DataFrame:
    """Every spelling of the three fields with the person it is attributed to."""
    parts = [
        table(spark, folder, "production_entry_credit", "credit_id", "name_printed").distinct().select(F.col("name_printed").alias("name")),
        table(spark, folder, "review_credit", "credit_id", "name_surface").distinct().select(F.col("name_surface").alias("name")),
        table(spark, folder, "person_candidate", "person_id_1", "display_1").distinct().select(F.col("display_1").alias("name")),
    ]
    return name_links.attribute_names(parts[0].unionByName(parts[1]).unionByName(parts[2]), "name")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of different spellings that name the same person."""
    return name_links.spelling_pairs(p3_persons(spark, folder))


@settled
def p3_confirmed(spark: SparkSession, folder: str) -> DataFrame:
    """Confirmed candidate pairs of which both displays are among the three fields, and
    whether they came to one person."""
    pairs = table(spark, folder, "person_candidate", "display_1", "display_2", "status").where(F.col("status").isin(CONFIRMING)).where("display_1 < display_2").select("display_1", "display_2").distinct()
    told = p3_persons(spark, folder)
    one, two = told.toDF("display_1", "p1"), told.toDF("display_2", "p2")
    return pairs.join(one, "display_1").join(two, "display_2").select("display_1", "display_2", (F.col("p1") == F.col("p2")).alias("linked"))


#: Table, key and field of the values that problem 4 compares.
P4_FIELDS = [
    ("production_entry_credit", "credit_id", "name_printed"),
    ("production_entry", "production_entry_id", "title"),
    ("review_mention", "mention_id", "surface"),
]


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of the three fields with its consistent form."""
    parts = [
        table(spark, folder, name, key, field).select(
            F.lit(name).alias("table_name"), F.col(key).cast("string").alias("record_id"), F.col(field).alias("value")
        )
        for name, key, field in P4_FIELDS
    ]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("value is not null and record_id is not null")
    return rows.withColumn("form", charforms.consistent(F.col("value")))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Records whose value isn't in the consistent form."""
    return p4_forms(spark, folder).where("form <> value").select("table_name", "record_id").distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Every person in a group of two or more, with the group's smallest id."""
    pairs = table(spark, folder, "person_candidate", "person_id_1", "person_id_2", "status")
    links = pairs.where(F.col("status").isin(CONFIRMING))
    found = components.connected_components(links, "person_id_1", "person_id_2")
    return found.select(F.col("vertex").alias("person_id"), F.col("component").alias("group_id"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and token ids of every document."""
    return bpe.encode_corpus(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def _document_sizes(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "source", "text").where("source is not null and text is not null")
    return materialize(bpe.token_counts(docs, ["doc_id", "source"], "text"))


def p8_mixture(spark: SparkSession, folder: str) -> DataFrame:
    """One row per used copy of a document, in the mixture's order."""
    return mixing.poisson_mixture(_document_sizes(spark, folder), table(spark, folder, "mix_target"))


@settled
def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares wanted and reached of every source."""
    return mixing.mixture_report(materialize(p8_mixture(spark, folder)), table(spark, folder, "mix_target"))


@settled
def p8_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Whether every source came within two of its largest documents of its share of the
    tokens, and kept its cap."""
    mix, targets = materialize(p8_mixture(spark, folder)), table(spark, folder, "mix_target")
    largest = mix.groupBy("source").agg(F.max("n_tokens").alias("largest"))
    total = F.sum("n_tokens").over(Window.partitionBy(F.lit(1)))  # one row a source
    r = mixing.mixture_report(mix, targets).join(largest, "source", "left").withColumn("total", total)
    near = F.abs(F.col("n_tokens") - F.col("target_share") * F.col("total")) <= 2 * F.coalesce("largest", F.lit(0))
    return r.select("source", "target_share", near.alias("near_target"), (F.col("most_repeats") <= F.col("max_repeats")).alias("within_cap"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Spans of personal information in every document."""
    return pii.find_personal(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


def p9_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with typed placeholders."""
    return pii.redact(table(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_mapped, p1_exact, p2_found, p2_repaired, p3_found, p3_persons, p3_confirmed, p4_found, p4_forms,
        p5_found, p7_ids, p8_mixture, p8_shares, p8_checks, p9_found, p9_redacted,
    )
}

_STATES = ", ".join(f"'{s}'" for s in CONFIRMING)

ORACLE = {
    "p5_found": f"""
WITH RECURSIVE links AS (
  SELECT person_id_1 AS a, person_id_2 AS b FROM person_candidate
  WHERE status IN ({_STATES}) AND person_id_1 <> person_id_2
  UNION
  SELECT person_id_2, person_id_1 FROM person_candidate
  WHERE status IN ({_STATES}) AND person_id_1 <> person_id_2),
reach(person_id, other) AS (
  SELECT a, a FROM links
  UNION
  SELECT r.person_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT person_id, min(other) AS group_id FROM reach GROUP BY person_id""",
    "p1_exact": """
WITH sole AS (SELECT canonical_title AS t, min(work_id) AS work_id FROM research_work WHERE canonical_title IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
billed AS (SELECT DISTINCT regexp_extract(title_note, 'also billed as «([^»]+)»', 1) AS t FROM research_work WHERE title_note IS NOT NULL)
SELECT DISTINCT same_title_id, work_id FROM same_title_works JOIN sole ON verbatim_title = t WHERE work_key IS NULL AND verbatim_title NOT IN (SELECT t FROM billed)""",
    "p3_confirmed": f"""
WITH names AS (SELECT display_1 AS n FROM person_candidate UNION SELECT name_printed FROM production_entry_credit UNION SELECT name_surface FROM review_credit)
SELECT DISTINCT display_1, display_2, true AS linked FROM person_candidate WHERE status IN ({_STATES}) AND display_1 < display_2 AND display_2 IN (SELECT n FROM names WHERE n IS NOT NULL)""",
    "p8_checks": "SELECT source, target_share, true AS near_target, true AS within_cap FROM mix_target WHERE source IS NOT NULL",
}
