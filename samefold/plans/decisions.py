"""The append-only log of decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samefold.schemas import DECISION

HUMAN = ("accepted", "rejected")
SOURCES = ("api_check", "create_hook", "proposal", "lookup_eval")


def from_check(checked: DataFrame, source: str = "api_check", user_id: int | None = None) -> DataFrame:
    """One log row for each candidate a check returned. `query`, where there is one, is the parsed query as JSON."""
    if source not in SOURCES:
        raise ValueError(f"unknown source {source!r}")
    return checked.select(
        "query_id", F.col("query") if "query" in checked.columns else F.lit(None).cast("string").alias("query"), F.lit("").alias("subject_ref"), F.col("kind").alias("candidate_kind"), F.col("ref").alias("candidate_ref"), "score",
        F.col("reasons").alias("features"), F.col("decision").alias("decision_auto"), F.lit("").alias("decision_human"),
        F.lit(user_id).cast("long").alias("user_id"), F.lit(source).alias("source"), F.current_timestamp().alias("created_at"),
    )


def from_verdicts(verdicts: DataFrame) -> DataFrame:
    """Log rows of human answers (subject_ref, candidate_kind, candidate_ref, decision_human,
    decision_auto, score, user_id). An unknown answer is an error when the rows are written."""
    known = F.when(F.col("decision_human").isin(*HUMAN), F.col("decision_human")).otherwise(F.raise_error(F.concat(F.lit("unknown human decision "), F.coalesce("decision_human", F.lit("null")))))
    return verdicts.select(
        F.lit(None).cast("long").alias("query_id"), F.lit(None).cast("string").alias("query"), "subject_ref", "candidate_kind", "candidate_ref", F.col("score").cast("int").alias("score"),
        F.array().cast("array<struct<code:string,label:string,score:int,observed:struct<query:string,candidate:string>>>").alias("features"), "decision_auto",
        known.alias("decision_human"), F.col("user_id").cast("long").alias("user_id"), F.lit("proposal").alias("source"), F.current_timestamp().alias("created_at"),
    )


def from_outcomes(outcomes: DataFrame) -> DataFrame:
    """Log rows of an evaluation's retrieved pairs."""
    return outcomes.where("retrieved").select(
        F.col("pair_id").alias("query_id"), F.lit(None).cast("string").alias("query"), F.col("query_ref").alias("subject_ref"), "candidate_kind", "candidate_ref", "score",
        F.array().cast("array<struct<code:string,label:string,score:int,observed:struct<query:string,candidate:string>>>").alias("features"), F.col("decision").alias("decision_auto"),
        F.lit("").alias("decision_human"), F.lit(None).cast("long").alias("user_id"), F.lit("lookup_eval").alias("source"), F.current_timestamp().alias("created_at"),
    )


def append(rows: DataFrame, path: str) -> None:
    rows.select(*(part.split()[0] for part in DECISION.split(", "))).write.mode("append").parquet(path)


def rejected_pairs(log: DataFrame, subjects: DataFrame) -> DataFrame:
    """Distinct (subject_ref, candidate_ref) that a human rejected, for the given subjects."""
    return log.where(F.col("decision_human") == "rejected").join(subjects.select("subject_ref").distinct(), "subject_ref", "left_semi").select("subject_ref", "candidate_ref").distinct()
