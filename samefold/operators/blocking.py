"""Candidate generation: five legs for a whole batch of queries, each a join on keys.

Legs run in the order of their worth: exact keys, perceptual hash, trigrams, image vectors, words.
Each gives (query_id, kind, ref, leg, place); a pair counts where it comes first, and a query keeps
its first `candidate_limit` pairs.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from samefold.config import EngineConfig
from samefold.functions.similarity import hamming, name_similarity
from samefold.operators import scans

TRIGRAM_FLOOR = 0.35
RAW_FLOOR = 0.3
WORD_FLOOR = 0.6
PAIR = ["query_id", "kind", "ref"]
EXACT, HASH, TRIGRAM, VECTOR, WORD = range(1, 6)


def _in_scope(df: DataFrame) -> DataFrame:
    return df.where(F.array_contains("scope", F.col("kind")))


def _ranked(df: DataFrame, leg: int, order: list, limit) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(*order, "kind", "ref")
    out = df.withColumn("place", F.row_number().over(w))
    return out.where(F.col("place") <= limit).select(*PAIR, F.lit(leg).alias("leg"), "place")


def keyed(queries: DataFrame, fps: DataFrame) -> DataFrame:
    """query_id, kind, ref, rank, and the names of both: every pair that shares a key, by three equi-joins (GTIN,
    brand and part number, reference)."""
    q = queries.select("query_id", "scope", *(F.col(c).alias(f"q_{c}") for c in ("gtin14", "brand_norm", "mpn_norm", "sku", "name_norm")))
    keys = fps.select("kind", "ref", "gtin14", "brand_norm", "mpn_norm", "name_norm")
    legs = [
        q.where("q_gtin14 <> ''").join(keys.where("gtin14 <> ''"), F.col("q_gtin14") == F.col("gtin14")),
        q.where("q_brand_norm <> '' AND q_mpn_norm <> ''").join(keys.where("mpn_norm <> ''"), (F.col("q_mpn_norm") == F.col("mpn_norm")) & (F.col("q_brand_norm") == F.col("brand_norm"))),
        q.where("q_sku <> ''").join(keys, F.col("q_sku") == F.col("ref")),
    ]
    rank = F.when((F.col("q_gtin14") != "") & (F.col("q_gtin14") == F.col("gtin14")), 0).when((F.col("q_mpn_norm") != "") & (F.col("q_mpn_norm") == F.col("mpn_norm")), 1).otherwise(2)
    found = None
    for leg in legs:
        one = _in_scope(leg).select(*PAIR, rank.alias("rank"), "q_name_norm", "name_norm", "brand_norm")
        found = one if found is None else found.unionByName(one)
    return found.groupBy(*PAIR).agg(F.min("rank").alias("rank"), *(F.first(c).alias(c) for c in ("q_name_norm", "name_norm", "brand_norm")))


def exact(queries: DataFrame, fps: DataFrame, config: EngineConfig) -> DataFrame:
    """The first `candidate_limit` pairs of each query that share a key."""
    found = keyed(queries, fps)
    found = found.withColumn("name_similarity", name_similarity(F.col("q_name_norm"), F.col("name_norm"), F.col("brand_norm")))
    return _ranked(found, EXACT, ["rank", F.desc("name_similarity")], config.candidate_limit)


#: Keys that a query's hash may be looked up under.
MOST_PROBES = 1024


def _banding(most: int) -> tuple[int, int]:
    """Into how many bands to cut 64 bits, and within how many bits of a query's band to look: of two
    hashes that differ in `most` bits, one of n bands differs in most // n at most. Of the choices with
    at most MOST_PROBES keys for a query, the one that meets the smallest share of chance pairs."""
    probes = lambda n: n * sum(comb(-(-64 // n), r) for r in range(most // n + 1))
    fits = [n for n in range(1, 33) if probes(n) <= MOST_PROBES] or [32]
    n = min(fits, key=lambda n: (probes(n) / 2.0 ** (64 // n), n))
    return n, most // n


def _bands(c, n: int):
    """The bands' numbers and bits, as one key each."""
    edges, wide = [64 * k // n for k in range(n + 1)], -(-64 // n)
    width = lambda a, b: F.lit(-1 if b - a == 64 else (1 << (b - a)) - 1).cast("long")
    number = lambda k: F.lit(k << wide if k else 0).cast("long")
    return F.array(*(F.shiftrightunsigned(c, a).bitwiseAND(width(a, b)).bitwiseOR(number(k)) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))))


def near_hash(queries: DataFrame, fps: DataFrame, config: EngineConfig) -> DataFrame:
    """Rows are keyed by their bands as they are; a query probes each band's near values. So the large
    side has few keys a row, and each is as wide as the distance allows. Spark takes the probes for as
    small as the queries are, so the join says that it sorts both sides: neither may be broadcast."""
    n, radius = _banding(config.phash_max_distance)
    width = -(-64 // n)
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    probes = F.flatten(F.transform(_bands(F.col("phash"), n), lambda b: F.transform(F.array(*(F.lit(m).cast("long") for m in signed)), lambda m: b.bitwiseXOR(m))))
    q = queries.where("phash IS NOT NULL").select("query_id", "scope", F.col("phash").alias("q_phash"), F.explode(probes).alias("b"))
    f = fps.where("phash IS NOT NULL").select("kind", "ref", "phash", F.explode(_bands(F.col("phash"), n)).alias("b"))
    found = _in_scope(q.join(f.hint("merge"), "b")).withColumn("distance", hamming(F.col("q_phash"), F.col("phash"))).where(F.col("distance") <= config.phash_max_distance)
    return _ranked(found.groupBy(*PAIR).agg(F.min("distance").alias("distance")), HASH, ["distance"], config.image_top_k)


def by_text(queries: DataFrame, fps: DataFrame, config: EngineConfig) -> DataFrame:
    """The trigram leg and the word leg, from one scan of the names."""
    found = scans.by_name(queries, fps, (TRIGRAM, WORD), (RAW_FLOOR, TRIGRAM_FLOOR, WORD_FLOOR), (config.trigram_limit, config.word_limit))
    return found.select(*PAIR, "leg", "place")


def near_vector(queries: DataFrame, fps: DataFrame, config: EngineConfig) -> DataFrame:
    return _ranked(scans.by_vector(queries, fps, VECTOR, config.image_top_k), VECTOR, ["measure"], config.image_top_k)


def candidates(queries: DataFrame, fps: DataFrame, config: EngineConfig | None = None, limit: int | None = None, image: bool = True, text: DataFrame | None = None) -> DataFrame:
    """query_id, kind, ref, leg, place, pool_rank: the pool of each query. text: what by_text() gave for them, if it is there."""
    config = config or EngineConfig()
    legs = [exact(queries, fps, config), by_text(queries, fps, config) if text is None else text]
    if image and config.image_enabled:
        legs += [near_hash(queries, fps, config), near_vector(queries, fps, config)]
    pool = legs[0]
    for leg in legs[1:]:
        pool = pool.unionByName(leg)
    first = pool.groupBy(*PAIR).agg(F.min(F.struct("leg", "place")).alias("f")).select(*PAIR, "f.leg", "f.place")
    w = Window.partitionBy("query_id").orderBy("leg", "place")
    return first.withColumn("pool_rank", F.row_number().over(w)).where(F.col("pool_rank") <= (limit or config.candidate_limit))
