"""The two questions: search (how well does each row fit?) and check (is it the same product?)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samefold.config import MATCH, NO_MATCH, REVIEW, EngineConfig
from samefold.functions.similarity import name_similarity
from samefold.operators import blocking, scoring

_Q = ["gtin14", "gtin_trusted", "brand_norm", "mpn_norm", "sku", "name_norm", "name_tokens", "pack_qty", "color", "size", "weight", "width", "height", "deep", "phash", "image_vec", "model_id"]
_C = ["gtin14", "gtin_trusted", "brand_norm", "mpn_norm", "name_norm", "pack_qty", "color", "size", "weight", "width", "height", "deep", "phash", "image_vec", "vec_model"]


def with_sides(pairs: DataFrame, queries: DataFrame, fps: DataFrame) -> DataFrame:
    """pairs (query_id, kind, ref) with the query's columns as q_* and the row's as c_*."""
    q = queries.select("query_id", *(F.col(x).alias(f"q_{x}") for x in _Q))
    f = fps.select("kind", "ref", *(F.col(x).alias(f"c_{x}") for x in _C), F.col("ref").alias("c_ref"))
    return pairs.join(q, "query_id").join(f, ["kind", "ref"])


def scored(queries: DataFrame, fps: DataFrame, config: EngineConfig | None = None, limit: int | None = None) -> DataFrame:
    """The pool of each query, scored."""
    config = config or EngineConfig()
    return scored_pairs(blocking.candidates(queries, fps, config, limit), queries, fps, config)


def scored_pairs(pairs: DataFrame, queries: DataFrame, fps: DataFrame, config: EngineConfig) -> DataFrame:
    """Pairs (query_id, kind, ref) scored."""
    pairs = with_sides(pairs, queries, fps)
    similar = name_similarity(F.col("q_name_norm"), F.col("c_name_norm"), F.col("c_brand_norm"))
    return scoring.score(pairs.withColumn("name_similarity", similar), config)


def _cut(df: DataFrame, queries: DataFrame, order: list) -> DataFrame:
    """The first `limit` rows of each query; the pool's order settles ties."""
    w = Window.partitionBy("query_id").orderBy(*order, F.desc("name_similarity"), "pool_rank")
    ranked = df.withColumn("rank", F.row_number().over(w))
    return ranked.join(queries.select("query_id", "limit"), "query_id").where(F.col("rank") <= F.col("limit"))


def shown(hits: DataFrame, display: DataFrame | None) -> DataFrame:
    """Hits with display data; those that their catalog no longer serves go, after the limit."""
    return hits if display is None else hits.join(display, ["kind", "ref"])


def search(queries: DataFrame, fps: DataFrame, config: EngineConfig | None = None, display: DataFrame | None = None) -> DataFrame:
    """query_id, rank, kind, ref, similarity, match_kind, reasons: no score and no verdict."""
    hits = _cut(scored(queries, fps, config), queries, [F.desc("relevance"), F.desc("score")])
    out = shown(hits, display)
    more = [] if display is None else [c for c in display.columns if c not in ("kind", "ref")]
    return out.select("query_id", "rank", "kind", "ref", F.col("relevance").alias("similarity"), "match_kind", "reasons", *more)


def check(queries: DataFrame, fps: DataFrame, config: EngineConfig | None = None, display: DataFrame | None = None) -> DataFrame:
    """As search, ranked by the additive score, with score, decision and flags."""
    hits = _cut(scored(queries, fps, config), queries, [F.desc("score")])
    out = shown(hits, display)
    more = [] if display is None else [c for c in display.columns if c not in ("kind", "ref")]
    return out.select("query_id", "rank", "kind", "ref", F.col("relevance").alias("similarity"), "match_kind", "score", "decision", "flags", "reasons", *more)


PARSED = ["gtin14", "brand_norm", "mpn_norm", "sku", "name_norm", "name_tokens", "weight", "width", "height", "deep", "color", "size", "pack_qty"]


def answers(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, parsed (what was understood), hits in order of rank (empty if there are none), warnings:
    one row for each query. Queries need `warnings`."""
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *(c for c in hits.columns if c not in ("query_id", "rank"))))).alias("hits"))
    out = queries.select("query_id", F.struct(*PARSED).alias("parsed"), "warnings").join(listed, "query_id", "left")
    empty = F.array().cast(listed.schema["hits"].dataType)
    return out.select("query_id", "parsed", F.coalesce("hits", empty).alias("hits"), "warnings")


_RANK = {NO_MATCH: 0, REVIEW: 1, MATCH: 2}


def overall(queries: DataFrame, checked: DataFrame) -> DataFrame:
    """query_id, decision: the best decision among the rows a query got; no_match without any."""
    rank = F.create_map(*(F.lit(x) for kv in _RANK.items() for x in kv))
    best = checked.groupBy("query_id").agg(F.max(rank[F.col("decision")]).alias("r"))
    names = F.array(*(F.lit(k) for k in _RANK))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.get(names, F.coalesce("r", F.lit(0))).alias("decision"))
