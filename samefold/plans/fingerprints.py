"""Catalog items to fingerprints, and snapshots kept equal to their catalogs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from samefold.config import KINDS
from samefold.functions import identifiers, names
from samefold.plans.parse import AXES
from samefold.schemas import IMAGE_COLUMNS
from samefold.sources.catalog import pick_name

KEYS = ["kind", "ref"]


def build(items: DataFrame) -> DataFrame:
    """One fingerprint for each item of a known kind; image columns are empty."""
    attr = lambda a: F.try_element_at(F.col("attrs"), F.lit(a)).try_cast("decimal(12,4)").alias(a)
    df = items.where(F.col("kind").isin(*KINDS)).withColumns({"__pick": pick_name(F.col("name_by_lang")), "__brand": names.brand(F.col("brand")), "__gtin": identifiers.gtin(F.col("gtin"))})
    df = names.normalize_names(df, "__pick", "__brand")
    return df.select(
        *KEYS, F.col("__gtin.gtin14").alias("gtin14"), F.col("__gtin.trusted").alias("gtin_trusted"),
        F.when(F.col("__brand") != "", F.col("__brand")).otherwise(F.col("name_brand")).alias("brand_norm"),
        identifiers.mpn(F.col("mpn"))["strict"].alias("mpn_norm"), "name_norm", "name_tokens", F.col("name_pack").alias("pack_qty"),
        F.col("name_color").alias("color"), F.col("name_size").alias("size"), *map(attr, AXES),
        F.lit(None).cast("long").alias("phash"), F.lit(None).cast("array<float>").alias("image_vec"), F.lit("").alias("vec_model"), F.lit("").alias("image_sha1"),
        F.col("updated_at").alias("source_updated_at"),
    )


def upsert(old: DataFrame, new: DataFrame) -> DataFrame:
    """The snapshot after new rows: theirs replace all but the image columns of old ones."""
    images = old.select(*KEYS, *IMAGE_COLUMNS)
    written = new.drop(*IMAGE_COLUMNS).join(images, KEYS, "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("vec_model", "image_sha1")})
    return written.select(*old.columns).unionByName(old.join(new.select(*KEYS), KEYS, "left_anti").select(*old.columns))


def set_images(old: DataFrame, images: DataFrame) -> DataFrame:
    """The snapshot after new pictures (kind, ref, phash, image_sha1, image_vec, vec_model): hash and
    digest always, vector and model only where there is a vector."""
    new = images.select(*KEYS, *(F.col(c).alias(f"__{c}") for c in IMAGE_COLUMNS), F.lit(True).alias("__new"))
    seen, vec = F.coalesce("__new", F.lit(False)), F.col("__image_vec").isNotNull()
    out = old.join(new, KEYS, "left")
    put = {c: F.when(seen, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("phash", "image_sha1")}
    put |= {c: F.when(seen & vec, F.col(f"__{c}")).otherwise(F.col(c)) for c in ("image_vec", "vec_model")}
    return out.withColumns(put).select(*old.columns)


def backfill(old: DataFrame, items: DataFrame, since=None) -> tuple[DataFrame, DataFrame]:
    """The snapshot with all items (or those updated since) written, and rows written by kind."""
    items = items if since is None else items.where(F.col("updated_at") >= F.lit(since))
    new = build(items)
    return upsert(old, new), new.groupBy("kind").agg(F.count(F.lit(1)).alias("n_written"))


def reconcile(old: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot with missing rows made and stale rows gone; and both counts by kind. Rows that
    exist aren't refreshed. A second run changes nothing."""
    missing = items.join(old.select(*KEYS), KEYS, "left_anti")
    stale = old.select(*KEYS).join(items.select(*KEYS), KEYS, "left_anti")
    made = build(missing)
    after = old.join(items.select(*KEYS).distinct(), KEYS, "left_semi").select(*old.columns).unionByName(made.select(*old.columns))
    counts = made.select("kind", F.lit(1).alias("c"), F.lit(0).alias("d")).unionByName(stale.select("kind", F.lit(0).alias("c"), F.lit(1).alias("d")))
    return after, counts.groupBy("kind").agg(F.sum("c").alias("n_created"), F.sum("d").alias("n_deleted"))


def refresh(old: DataFrame, refs: DataFrame, items: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The snapshot after the refs (kind, ref) were read again, and each one's outcome: refreshed,
    deleted (no longer served) or absent (neither served nor known)."""
    refs = refs.select(*KEYS).distinct()
    served = items.join(refs, KEYS, "left_semi")
    state = refs.join(served.select(*KEYS, F.lit(True).alias("s")), KEYS, "left").join(old.select(*KEYS, F.lit(True).alias("o")), KEYS, "left")
    outcome = state.select(*KEYS, F.when(F.col("s"), "refreshed").when(F.col("o"), "deleted").otherwise("absent").alias("outcome"))
    gone = outcome.where("outcome = 'deleted'")
    return upsert(old.join(gone, KEYS, "left_anti").select(*old.columns), build(served)), outcome


def coverage(fps: DataFrame) -> DataFrame:
    """By kind: rows, and rows that have each key."""
    has = lambda c: F.count_if(F.col(c) != "").alias(f"n_{c}")
    return fps.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_rows"), has("gtin14"), has("mpn_norm"), has("brand_norm"), has("name_norm"),
        F.count_if(F.col("phash").isNotNull()).alias("n_phash"), F.count_if(F.col("image_vec").isNotNull()).alias("n_image_vec"),
    )
