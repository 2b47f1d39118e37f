"""Evidence for each pair: levels with signed points, a clamped sum, a verdict, and a relevance.

Input rows hold the query's columns with prefix q_ and the candidate's with prefix c_, and
name_similarity. Reasons are array<struct<code, label, score, observed<query, candidate>>>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from samefold.config import MATCH, NO_MATCH, REVIEW, EngineConfig
from samefold.functions.similarity import cosine, hamming, token_set_ratio

# Points of each kind of evidence.
WEIGHTS = {
    "gtin_exact": 60, "gtin_exact_untrusted": 15, "brand_mpn_exact": 45, "mpn_exact": 20, "mpn_exact_brand_conflict": -30, "sku_exact": 30,
    "name_trigram": 25, "name_tokens_strong": 20, "name_tokens_weak": 10, "brand_equal": 10, "brand_conflict": -25,
    "weight_match": 5, "weight_conflict": -15, "dimensions_match": 5, "dimensions_conflict": -15,
    "color_equal": 5, "color_conflict": -40, "size_equal": 5, "size_conflict": -40, "pack_equal": 5, "pack_conflict": -40,
    "image_near_exact": 10, "image_near": 6, "image_similar_strong": 10, "image_similar": 5,
}
# Relevance of an identifier.
IDENTIFIERS = {"gtin_exact": 100, "brand_mpn_exact": 100, "mpn_exact": 80, "sku_exact": 80, "gtin_exact_untrusted": 60}
TRIGRAM_FLOOR, TRIGRAM_CEILING = 0.35, 0.9
TOKENS_STRONG, TOKENS_WEAK = 0.85, 0.6
SAME_BITS, NEAR_BITS = 5, 10
COSINE_STRONG, COSINE_SIMILAR, COSINE_SAME_FILE = 0.9, 0.8, 0.95
REASON = "struct<code:string,label:string,score:int,observed:struct<query:string,candidate:string>>"
AXES = ["width", "height", "deep"]

q = lambda c: F.col(f"q_{c}")
c = lambda c: F.col(f"c_{c}")


def _filled(x: Column) -> Column:
    return F.coalesce(x.cast("string"), F.lit("")) != ""


def _reason(code: str, query: Column, candidate: Column, score: Column | None = None) -> Column:
    points = F.lit(WEIGHTS[code]) if score is None else score
    seen = F.struct(query.cast("string").alias("query"), candidate.cast("string").alias("candidate"))
    shown = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    label = F.concat(F.lit(code.replace("_", " ") + ": "), shown(query), F.lit(" / "), shown(candidate))
    return F.struct(F.lit(code).alias("code"), label.alias("label"), points.cast("int").alias("score"), seen.alias("observed"))


def _within(a: Column, b: Column, share: str, least: str) -> Column:
    """Relative to the query, so the test isn't symmetric."""
    return F.abs(a - b) <= F.greatest(F.abs(a) * F.lit(share).cast("decimal(6,4)"), F.lit(least).cast("decimal(6,4)"))


def _linear(x: Column, floor: float, ceiling: float, top: int) -> Column:
    """0 up to floor, top from ceiling on, between them in a line, rounded half to even."""
    return F.when(x <= floor, 0).otherwise(F.bround(F.lit(float(top)) * (F.least(x, F.lit(ceiling)) - F.lit(floor)) / F.lit(ceiling - floor))).cast("int")


def levels() -> list[Column]:
    """One nullable reason each, in the order that settles ties."""
    same_gtin = _filled(q("gtin14")) & (q("gtin14") == c("gtin14"))
    gtin = F.when(same_gtin & q("gtin_trusted") & c("gtin_trusted"), _reason("gtin_exact", q("gtin14"), c("gtin14"))).when(
        same_gtin, _reason("gtin_exact_untrusted", q("gtin14"), c("gtin14")))
    same_mpn = _filled(q("mpn_norm")) & (q("mpn_norm") == c("mpn_norm"))
    brands = _filled(q("brand_norm")) & _filled(c("brand_norm"))
    same_brand = q("brand_norm") == c("brand_norm")
    mpn = (
        F.when(same_mpn & ~brands, _reason("mpn_exact", q("mpn_norm"), c("mpn_norm")))
        .when(same_mpn & same_brand, _reason("brand_mpn_exact", q("mpn_norm"), c("mpn_norm")))
        .when(same_mpn, _reason("mpn_exact_brand_conflict", q("brand_norm"), c("brand_norm")))
    )
    sku = F.when(_filled(q("sku")) & (q("sku") == c("ref")), _reason("sku_exact", q("sku"), c("ref")))
    names = _filled(q("name_norm")) & _filled(c("name_norm"))
    sim = F.coalesce("name_similarity", F.lit(0.0))
    points = F.bround(F.lit(25.0) * (F.least(sim, F.lit(TRIGRAM_CEILING)) - TRIGRAM_FLOOR) / F.lit(TRIGRAM_CEILING - TRIGRAM_FLOOR)).cast("int")
    trigram = F.when(names & (sim >= TRIGRAM_FLOOR) & (points != 0), _reason("name_trigram", q("name_norm"), c("name_norm"), points))
    ratio = F.col("token_ratio") / 100
    tokens = F.when(names & (ratio >= TOKENS_STRONG), _reason("name_tokens_strong", q("name_norm"), c("name_norm"))).when(
        names & (ratio >= TOKENS_WEAK), _reason("name_tokens_weak", q("name_norm"), c("name_norm")))
    brand = F.when(brands & same_brand, _reason("brand_equal", q("brand_norm"), c("brand_norm"))).when(brands, _reason("brand_conflict", q("brand_norm"), c("brand_norm")))
    weights = q("weight").isNotNull() & c("weight").isNotNull()
    near = _within(q("weight"), c("weight"), "0.05", "0.01")
    weight = F.when(weights & near, _reason("weight_match", q("weight"), c("weight"))).when(weights, _reason("weight_conflict", q("weight"), c("weight")))
    box = lambda side: F.array_sort(F.array(*(side(a).cast("decimal(38,10)") for a in AXES)))
    all_axes = F.lit(True)
    for a in AXES:
        all_axes = all_axes & q(a).isNotNull() & c(a).isNotNull()
    fits = F.lit(True)
    for k in range(3):
        fits = fits & _within(box(q)[k], box(c)[k], "0.03", "0")
    seen = lambda side: F.array_join(box(side).cast("array<string>"), ", ")
    dims = F.when(all_axes & fits, _reason("dimensions_match", seen(q), seen(c))).when(all_axes, _reason("dimensions_conflict", seen(q), seen(c)))
    out = [gtin, mpn, sku, trigram, tokens, brand, weight, dims]
    for attr, name in (("color", "color"), ("size", "size"), ("pack_qty", "pack")):
        x, y = q(attr).cast("string"), c(attr).cast("string")
        both = _filled(x) & _filled(y) & (x != "0") & (y != "0") if attr == "pack_qty" else _filled(x) & _filled(y)
        out.append(F.when(both & (x == y), _reason(f"{name}_equal", x, y)).when(both, _reason(f"{name}_conflict", x, y)))
    return out


def image_levels() -> list[Column]:
    bits, cos = F.col("phash_distance"), F.col("cosine")
    return [
        F.when(bits <= SAME_BITS, _reason("image_near_exact", q("phash"), c("phash"))).when(bits <= NEAR_BITS, _reason("image_near", q("phash"), c("phash"))),
        F.when(cos >= COSINE_STRONG, _reason("image_similar_strong", q("model_id"), F.round(cos, 4))).when(cos >= COSINE_SIMILAR, _reason("image_similar", q("model_id"), F.round(cos, 4))),
    ]


def _has(codes: list[str], reasons: str = "reasons") -> Column:
    return F.exists(reasons, lambda r: r["code"].isin(codes))


def decide(score: Column, flags: Column, config: EngineConfig) -> Column:
    identified = F.array_contains(flags, "identifier_exact")
    capped = F.arrays_overlap(flags, F.array(*map(F.lit, ("brand_conflict", "variant_conflict", "image_only"))))
    return F.when(~capped & ((score >= config.match_threshold) | identified), MATCH).when((score >= config.review_threshold) | identified, REVIEW).otherwise(NO_MATCH)


def score(pairs: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """pairs with reasons, flags, score, decision, relevance, match_kind."""
    config = config or EngineConfig()
    image = (q("phash").isNotNull() | q("image_vec").isNotNull()) & F.lit(config.image_enabled)
    same_model = q("model_id") == c("vec_model")
    comparable = image & q("image_vec").isNotNull() & c("image_vec").isNotNull() & same_model
    both_names = _filled(q("name_norm")) & _filled(c("name_norm"))
    df = pairs.withColumns({
        "token_ratio": F.when(both_names, token_set_ratio(q("name_norm"), c("name_norm"))).otherwise(0.0),
        "phash_distance": F.when(image, hamming(q("phash"), c("phash"))),
        "cosine": F.when(comparable, cosine(q("image_vec"), c("image_vec"))),
        "has_image": image,
    })
    df = df.withColumns({"__text": F.array_compact(F.array(*levels())), "__image": F.array_compact(F.array(*image_levels()))})
    df = df.withColumn("reasons", F.array_sort(F.concat("__text", "__image"), lambda a, b: F.abs(b["score"]) - F.abs(a["score"])))
    conflict = _has(["brand_conflict"])
    variant = _has(["color_conflict", "size_conflict", "pack_conflict"])
    strong = F.exists("reasons", lambda r: (r["code"] == "name_tokens_strong") | ((r["code"] == "name_trigram") & (r["score"] >= 20)))
    dirty = conflict & ~variant & ~_has(["weight_conflict", "dimensions_conflict"]) & _has(["gtin_exact"]) & strong
    only_image = (F.size("__image") > 0) & ~F.exists("__text", lambda r: r["score"] > 0)
    flags = [("identifier_exact", _has(["gtin_exact", "brand_mpn_exact"])), ("brand_conflict", conflict & ~dirty), ("brand_dirty_data", dirty), ("variant_conflict", variant), ("image_only", only_image)]
    df = df.withColumn("flags", F.array_compact(F.array(*(F.when(t, F.lit(n)) for n, t in flags))))
    total = F.aggregate("reasons", F.lit(0), lambda s, r: s + r["score"])
    df = df.withColumn("score", F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int"))
    df = df.withColumn("decision", decide(F.col("score"), F.col("flags"), config))
    return relevance(df).drop("__text", "__image")


def relevance(df: DataFrame) -> DataFrame:
    """Adds relevance (0 to 100, on the scale that the query's kind of evidence sets) and match_kind."""
    points = F.create_map(*(F.lit(x) for kv in IDENTIFIERS.items() for x in kv))
    identifier = F.coalesce(F.array_max(F.transform("reasons", lambda r: F.coalesce(F.try_element_at(points, r["code"]), F.lit(0)))), F.lit(0))
    names = _filled(q("name_norm")) & _filled(c("name_norm"))
    text = F.when(names, F.greatest(_linear(F.coalesce("name_similarity", F.lit(0.0)), TRIGRAM_FLOOR, TRIGRAM_CEILING, 100), _linear(F.col("token_ratio") / 100, TOKENS_WEAK, 1.0, 100))).otherwise(0)
    cos, bits = F.col("cosine"), F.col("phash_distance")
    same = F.coalesce(bits <= SAME_BITS, F.lit(False)) & (cos.isNull() | (cos >= COSINE_SAME_FILE))
    by_cosine = _linear(F.coalesce(cos, F.lit(0.0)), COSINE_SIMILAR, 1.0, 100)
    picture = F.when(same, 100).when(bits <= NEAR_BITS, F.greatest(F.lit(85), by_cosine)).otherwise(by_cosine)
    has_text = _filled(q("gtin14")) | _filled(q("mpn_norm")) | _filled(q("sku")) | _filled(q("name_norm")) | _filled(q("brand_norm"))
    df = df.withColumns({"__id": identifier, "__txt": text, "__pic": F.when(F.col("has_image"), picture).otherwise(0), "__same": same & F.col("has_image")})
    best = F.greatest("__id", "__txt")
    value = (
        F.when(~F.col("has_image"), best).when(~has_text, F.col("__pic")).when(F.col("__id") == 100, 100)
        .otherwise(F.bround(F.col("__pic") * 0.5 + best * 0.5).cast("int"))
    )
    df = df.withColumn("relevance", value.cast("int"))
    kind = F.when((F.col("__id") == 100) | F.col("__same"), "exact").when(F.col("relevance") > 0, "similar").otherwise("none")
    return df.withColumn("match_kind", kind).drop("__id", "__txt", "__pic", "__same")


def best_signal(reasons: Column) -> Column:
    """The largest positive points, or 0."""
    return F.greatest(F.lit(0), F.coalesce(F.array_max(F.transform(reasons, lambda r: r["score"])), F.lit(0)))
