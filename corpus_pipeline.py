"""From ``documents`` to packed training sequences in five stages.

Every stage takes what its predecessor kept, written and read again; all but the last
return the columns of ``documents``. Rows are judged each by its own text: ``doc_id`` may be
null or repeated, and only tells which row of a group stays or which passage is earlier.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gainsieve.llm.common import others, table
from gainsieve.llm.packing import pack_documents
from gainsieve.llm.quality import clean_documents
from gainsieve.llm.queries import TOXIC_FROM, toxicity_model
from gainsieve.llm.simhash import near_duplicates
from gainsieve.llm.suffixes import remove_repeats
from gainsieve.llm.toxicity import with_scores
from gainsieve.session import materialise


def _fresh(docs: DataFrame, name: str) -> str:
    """``name``, with blanks behind it until no column of ``docs`` has it."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def _with_text(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with column ``text`` as the new text and its length in characters."""
    replaced = {"text": F.col(text), "n_chars": F.length(text).cast("long")}
    return docs.select(*(replaced[c].alias(c) if c in replaced else F.col(f"`{c}`") for c in docs.columns if c != text))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without their failed lines."""
    row, clean = F.struct(*(F.col(f"`{c}`") for c in docs.columns)), "clean_text"
    judged = clean_documents(docs.select(row.alias("docs"), "text"), clean_text=clean).where("kept")
    new = _fresh(docs, "_new_text")
    return _with_text(judged.select("docs.*", F.col(clean).alias(new)), new)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    score = _fresh(docs, "_score")
    return with_scores(docs, toxicity_model(spark, sf_dir), score=score).where(F.col(score) < TOXIC_FROM).drop(score)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every near-duplicate component: that with the smallest id, a null id being the last choice.

    Shingles and bits are those of the operator's contract. Rows are told apart by 128 bits of hash of
    all their columns; of rows equal in all of them one stays.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    row = F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *columns).alias("b"))
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), F.coalesce("doc_id", F.lit(0)).alias("id"), row.alias("row"))
    found = near_duplicates(docs.select(key.alias("_key"), "text"), "_key")
    kept = found.where("_key = component_id").select(F.col("_key.row").alias("row")).distinct()
    rows = docs.select(row.alias("row"), F.struct(*columns).alias("docs"))
    return rows.join(kept, "row").dropDuplicates(["row"]).select("docs.*")


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents without passages that occur earlier; a character cut apart is dropped as well."""
    null, new = _fresh(docs, "_null"), _fresh(docs, "_new_text")
    carry = [*others(docs, "doc_id", "text"), F.col("text").isNull().alias(null)]
    left = remove_repeats(docs, "doc_id", as_text=True, carry=carry)
    columns = {"doc_id": F.col("doc_id"), "text": F.when(~F.col(f"carried.`{null}`"), F.col("kept"))}
    left = left.select(*(columns.get(c, F.col(f"carried.`{c}`")).alias(c) for c in docs.columns), columns["text"].alias(new))
    return _with_text(left, new)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return pack_documents(docs, "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity),
    ("simhash_near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", packing),
]

#: Models, fingerprints and token ids have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
