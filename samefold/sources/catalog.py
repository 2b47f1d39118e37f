"""Catalogs, their registry, and labelled pairs."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from samefold.functions.identifiers import stripped
from samefold.storage import spread

log = logging.getLogger(__name__)

#: Fields of a display() and what they are called in a hit.
DISPLAY = {"name": "name", "brand": "brand", "gtin": "ean", "image_url": "main_image_url", "detail_url": "detail_url"}


def pick_name(by_lang: Column) -> Column:
    """The Polish, English or German name, else the first that isn't empty."""
    filled = lambda c: F.when(c != "", c)
    others = F.get(F.filter(F.map_values(by_lang), lambda v: v != ""), F.lit(0))
    return F.coalesce(*(filled(F.try_element_at(by_lang, F.lit(k))) for k in ("pl", "en", "de")), others, F.lit(""))


@dataclass(frozen=True)
class CatalogSource:
    """A catalog: read() gives its items (schemas.ITEM without kind); display(), if there is one,
    gives ref and what it knows of name, brand, gtin, image_url, detail_url."""

    kind: str
    read: Callable[[SparkSession], DataFrame]
    display: Callable[[SparkSession], DataFrame] | None = None
    #: A stream of what changed (ref, ts and, where `watch` names fields, these).
    changes: Callable[[SparkSession], DataFrame] | None = None
    watch: tuple[str, ...] = ()

    def items(self, spark: SparkSession, since=None) -> DataFrame:
        """All items, or those updated since; items without a time are never recent."""
        df = self.read(spark).withColumn("kind", F.lit(self.kind))
        return df if since is None else df.where(F.col("updated_at") >= F.lit(since))

    def shown(self, spark: SparkSession) -> DataFrame:
        """kind, ref and the six fields of a hit. What display() doesn't give is ''; a catalog without
        display(), or whose display() finds nothing to look up in, shows its items."""
        given = None
        if self.display:
            try:
                given = self.display(spark)
            except LookupError:
                log.warning("display of %s isn't available; its items are shown", self.kind)
        if given is None:
            given = self.items(spark).select("ref", pick_name(F.col("name_by_lang")).alias("name"), "brand", "gtin", F.col("image_path_or_url").alias("image_url"))
        text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in given.columns else F.lit("")
        return given.select(F.lit(self.kind).alias("kind"), "ref", F.col("ref").alias("sku"), *(text(c).alias(name) for c, name in DISPLAY.items()))

    def get(self, spark: SparkSession, refs: DataFrame) -> DataFrame:
        """The items of refs (ref); those that aren't served are absent."""
        return self.items(spark).join(refs.select("ref").distinct(), "ref", "left_semi")


class Registry:
    """Catalogs by kind. A source may be given as a function, which is called at its first use."""

    def __init__(self, sources: dict[str, CatalogSource | Callable[[], CatalogSource]]):
        self._given, self._made = dict(sources), {}

    def __contains__(self, kind: str) -> bool:
        return kind in self._given

    @property
    def kinds(self) -> list[str]:
        return list(self._given)

    def get(self, kind: str) -> CatalogSource:
        if kind not in self._given:
            raise ValueError(f"no catalog for kind {kind!r}; known: {', '.join(self._given)}")
        if kind not in self._made:
            given = self._given[kind]
            self._made[kind] = given if isinstance(given, CatalogSource) else given()
        return self._made[kind]

    def clear(self) -> None:
        self._made.clear()

    def items(self, spark: SparkSession, kind: str | None = None, since=None) -> DataFrame:
        """Items of one catalog or of all."""
        out = None
        for k in [kind] if kind else self.kinds:
            one = self.get(k).items(spark, since)
            out = one if out is None else out.unionByName(one)
        if out is None:
            raise ValueError("no catalog is registered")
        return out

    def scoped(self, queries: DataFrame) -> DataFrame:
        """Queries with kinds that have no catalog taken out of scope and named in `warnings`."""
        known = F.array(*map(F.lit, self.kinds)) if self._given else F.array().cast("array<string>")
        warnings = F.transform(F.array_except("scope", known), lambda k: F.concat(F.lit("kind_unavailable:"), k))
        if "image_warnings" in queries.columns:
            warnings = F.concat(warnings, F.col("image_warnings"))
        return queries.withColumns({
            "warnings": warnings,
            "scope": F.array_intersect("scope", known),
        })


PAIR_FIELDS = ["query_kind", "query_ref", "candidate_kind", "candidate_ref", "label", "why"]


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    """A labelled CSV: all values stripped of white space, labels in lower case, rows without query_ref
    dropped. A quoted value may go over lines, so a file is one task: such files are written by hand."""
    raw = spark.read.csv(path, header=True, encoding="UTF-8", multiLine=True, escape='"')
    have = {c.lstrip("﻿").strip(): c for c in raw.columns}
    text = lambda f: stripped(F.col(f"`{have[f]}`")) if f in have else F.lit("")
    df = raw.select(*(text(f).alias(f) for f in PAIR_FIELDS))
    return df.withColumn("label", F.lower("label")).where(F.col("query_ref") != "")


def part_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The part table as a catalog. GTIN and part number are derived from the key, weight from price."""
    part = spread(spark.read.parquet(f"{sf_dir}/part.parquet"))
    body = F.concat(F.lit("590"), F.lpad(F.col("p_partkey").cast("string"), 9, "0"))
    total = F.lit(0)
    for k in range(12):
        total = total + F.substring(body, k + 1, 1).cast("int") * (1 if k % 2 == 0 else 3)
    gtin = F.concat(body, F.pmod(10 - total % 10, F.lit(10)).cast("string"))
    text = lambda x: x.cast("string")
    return part.select(
        text(F.col("p_partkey")).alias("ref"), gtin.alias("gtin"), F.col("p_brand").alias("brand"),
        F.concat(F.lit("MP-"), F.lpad(text(F.col("p_partkey") % 997), 5, "0")).alias("mpn"),
        F.create_map(F.lit("en"), F.concat_ws(" ", "p_name", "p_type", text(F.col("p_size")))).alias("name_by_lang"),
        F.create_map(F.lit("weight"), F.concat(text(F.col("p_size")), F.lit(".25")), F.lit("width"), text(F.col("p_size"))).alias("attrs"),
        F.lit(None).cast("string").alias("image_path_or_url"), F.timestamp_seconds(F.col("p_partkey") * 3600).alias("updated_at"),
    )


