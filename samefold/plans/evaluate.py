"""Labelled pairs to precision, recall, F1, confusion and blocking recall."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samefold.config import KINDS, NO_MATCH, EngineConfig
from samefold.operators import blocking
from samefold.plans import lookup, parse
from samefold.sources.catalog import pick_name
from samefold.storage import persisted

LABELS = ("match", "variant", "no")


def outcomes(pairs: DataFrame, items: DataFrame, fps: DataFrame, config: EngineConfig | None = None, image_only: bool = False) -> DataFrame:
    """pairs with pair_id, skip_reason, score, decision, retrieved, name_blocked, image_blocked.

    Each usable row becomes a query made of its own catalog item, limited to the candidate's kind."""
    config = config or EngineConfig()
    pairs = persisted(pairs.withColumn("pair_id", F.monotonically_increasing_id()), "pairs")
    config = replace(config, default_limit=config.candidate_limit)
    item = items.select(F.col("kind").alias("query_kind"), F.col("ref").alias("query_ref"), "gtin", "brand", "mpn", pick_name(F.col("name_by_lang")).alias("name"), "attrs", F.lit(True).alias("__served"))
    kinds = items.select("kind").distinct().select(F.col("kind").alias("query_kind"), F.lit(True).alias("__kind"))
    df = pairs.join(kinds, "query_kind", "left").join(item, ["query_kind", "query_ref"], "left")
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    signal = filled("gtin") | filled("mpn") | filled("name")
    reason = (
        F.when(~F.col("label").isin(*LABELS), "bad label").when(~F.col("query_kind").isin(*KINDS) | ~F.col("candidate_kind").isin(*KINDS), "unknown kind")
        .when(F.col("__kind").isNull(), "unknown kind").when(F.col("__served").isNull() | ~signal, "stale ref")
    )
    df = persisted(df.withColumn("skip_reason", reason), "pairs")
    attr = lambda a: F.try_element_at("attrs", F.lit(a))
    own = fps.select(F.col("kind").alias("query_kind"), F.col("ref").alias("query_ref"), "phash", "image_vec", F.col("vec_model").alias("model_id")).where("phash IS NOT NULL AND image_vec IS NOT NULL")
    raw = df.where("skip_reason IS NULL").join(own, ["query_kind", "query_ref"], "left").select(
        F.col("pair_id").alias("query_id"), F.lit(None).cast("string").alias("q"), F.col("gtin").alias("ean"), "brand", "mpn", F.lit(None).cast("string").alias("sku"), "name",
        F.struct(*(attr(a).try_cast("decimal(38,10)").alias(a) for a in parse.AXES), attr("color").alias("color"), attr("size").alias("size"), attr("pack_qty").try_cast("int").alias("pack_qty")).alias("attrs"),
        F.array("candidate_kind").alias("scope"), F.lit(config.candidate_limit).alias("limit"), "phash", "image_vec", "model_id",
    )
    queries = persisted(parse.parse(raw, config), "queries")
    bare = queries.withColumns({"phash": F.lit(None).cast("long"), "image_vec": F.lit(None).cast("array<float>")})
    blank = {c: F.lit("") for c in ("gtin14", "mpn_norm", "sku")}
    want = pairs.select("pair_id", F.col("candidate_kind").alias("kind"), F.col("candidate_ref").alias("ref"))

    def hit(found: DataFrame, name: str) -> DataFrame:
        return found.select(F.col("query_id").alias("pair_id"), "kind", "ref").join(want, ["pair_id", "kind", "ref"], "left_semi").select("pair_id", F.lit(True).alias(name)).distinct()

    pictured = queries.where("phash IS NOT NULL").withColumns(blank | {"name_norm": F.lit(""), "name_tokens": F.array().cast("array<string>")})
    by_image = hit(blocking.candidates(pictured, fps, config, limit=20), "__image")
    out = df.join(by_image, "pair_id", "left").join(pictured.select(F.col("query_id").alias("pair_id"), F.lit(True).alias("__pictured")), "pair_id", "left")
    if image_only:
        out = out.withColumns({"__score": F.lit(None).cast("int"), "__decision": F.lit(None).cast("string"), "__name": F.lit(False)})
    else:
        # a check's limit is the pool's here, so a pair is among its hits if it is in the pool, and only those asked for are scored
        text = persisted(blocking.by_text(bare, fps, config), "by-text")
        pool = blocking.candidates(bare, fps, config, image=False, text=text).withColumnRenamed("query_id", "pair_id").join(want, ["pair_id", "kind", "ref"], "left_semi")
        checked = lookup.scored_pairs(pool.withColumnRenamed("pair_id", "query_id"), bare, fps, config)
        found = checked.select(F.col("query_id").alias("pair_id"), F.col("score").alias("__score"), F.col("decision").alias("__decision"))
        by_name = hit(blocking.candidates(bare.withColumns(blank), fps, config, limit=50, image=False, text=text), "__name")
        out = out.join(found, "pair_id", "left").join(by_name, "pair_id", "left")
    return out.select(
        "pair_id", "query_kind", "query_ref", "candidate_kind", "candidate_ref", "label", "skip_reason", F.coalesce("__score", F.lit(0)).alias("score"),
        F.coalesce("__decision", F.lit(NO_MATCH)).alias("decision"), F.col("__score").isNotNull().alias("retrieved"),
        F.coalesce("__name", F.lit(False)).alias("name_blocked"), F.when(F.col("__pictured"), F.coalesce("__image", F.lit(False))).alias("image_blocked"),
    )


def usable(found: DataFrame) -> DataFrame:
    return found.where("skip_reason IS NULL")


def sweep(found: DataFrame, thresholds: list[int]) -> DataFrame:
    """positives, threshold, tp, fp, fn, tn, precision, recall, f1; 0 where a denominator is."""
    grid = F.explode(F.array(*(F.struct(F.lit(p).alias("positives"), F.lit(t).alias("threshold")) for p in ("match", "match+variant") for t in thresholds)))
    df = found.select("label", "score", grid.alias("g")).select("label", "score", "g.*")
    actual = (F.col("label") == "match") | ((F.col("label") == "variant") & (F.col("positives") == "match+variant"))
    said = F.col("score") >= F.col("threshold")
    n = lambda t: F.count_if(t)
    out = df.groupBy("positives", "threshold").agg(n(said & actual).alias("tp"), n(said & ~actual).alias("fp"), n(~said & actual).alias("fn"), n(~said & ~actual).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    out = out.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def confusion(found: DataFrame) -> DataFrame:
    return found.groupBy("label", "decision").agg(F.count(F.lit(1)).alias("n_pairs"))


def recalls(found: DataFrame) -> DataFrame:
    """recall_at_50_name, recall_at_20_image over matches and variants; null without any."""
    positive = found.where(F.col("label").isin("match", "variant"))
    return positive.agg(F.avg(F.col("name_blocked").cast("int")).alias("recall_at_50_name"), F.avg(F.col("image_blocked").cast("int")).alias("recall_at_20_image"))


def decision_view(found: DataFrame) -> DataFrame:
    """Matches linked, reviewed and missed; others linked wrongly."""
    n = lambda label, decision: F.count_if((F.col("label") == label) & (F.col("decision") == decision))
    return found.agg(n("match", "match").alias("linked"), n("match", "review").alias("reviewed"), n("match", "no_match").alias("missed"), n("no", "match").alias("linked_wrongly"))


def summary(found: DataFrame) -> DataFrame:
    """Rows by skip_reason (null: used) and how many weren't retrieved."""
    return found.groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(~F.col("retrieved")).alias("n_not_retrieved"))


def report(found: DataFrame, thresholds: list[int]) -> str:
    """The evaluation as text. What is collected is a row for each threshold, label or reason."""
    used = usable(found)
    counts = {r.skip_reason: r for r in summary(found).collect()}
    skipped = {k: r.n_pairs for k, r in counts.items() if k}
    lines = [f"pairs: {sum(r.n_pairs for r in counts.values())}, skipped: {sum(skipped.values())}" + "".join(f", {k}: {n}" for k, n in sorted(skipped.items()))]
    lines.append(f"not retrieved: {counts[None].n_not_retrieved if None in counts else 0}")
    for r in sorted(sweep(used, thresholds).collect(), key=lambda r: (r.positives, r.threshold)):
        lines.append(f"{r.positives} >= {r.threshold}: precision {r.precision:.3f}, recall {r.recall:.3f}, F1 {r.f1:.3f} ({r.tp} right, {r.fp} wrong, {r.fn} missed)")
    lines += [f"{r.label} -> {r.decision}: {r.n_pairs}" for r in sorted(confusion(used).collect())]
    view, r = decision_view(used).first(), recalls(used).first()
    lines.append(f"linked {view.linked}, for review {view.reviewed}, missed {view.missed}, linked wrongly {view.linked_wrongly}")
    share = lambda x: "no pairs" if x is None else f"{x:.3f}"
    lines.append(f"name recall at 50: {share(r.recall_at_50_name)}; picture recall at 20: {share(r.recall_at_20_image)}")
    return "\n".join(lines)


def parse_thresholds(text: str) -> list[int]:
    """'45,75' to numbers; a bad list is the default."""
    try:
        return [int(x) for x in text.split(",") if x.strip()] or [45, 75]
    except ValueError:
        return [45, 75]
