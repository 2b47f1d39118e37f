"""Requests to normalised queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from samefold.config import KINDS, EngineConfig
from samefold.functions import identifiers, names
from samefold.schemas import QUERY

#: Longest value of each text field.
LENGTHS = {"q": 500, "ean": 32, "brand": 255, "mpn": 255, "sku": 255, "name": 500}
AXES = ["weight", "width", "height", "deep"]


def validate(raw: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """raw with `error`: null for a good request, else what is wrong. Brand or attributes alone are
    no signal."""
    config = config or EngineConfig()
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    tests = [(F.length(k) > n, f"{k} is longer than {n}") for k, n in LENGTHS.items()]
    tests += [(F.col(f"attrs.{a}") < 0, f"attrs.{a} is negative") for a in AXES]
    tests += [(F.length(f"attrs.{a}") > 64, f"attrs.{a} is longer than 64") for a in ("color", "size")]
    tests += [((F.col("attrs.pack_qty") < 1) | (F.col("attrs.pack_qty") > 9999), "attrs.pack_qty is out of range")]
    tests += [((F.col("limit") < 1) | (F.col("limit") > config.max_limit), "limit is out of range")]
    tests += [(F.size(F.array_except("scope", F.array(*map(F.lit, KINDS)))) > 0, "scope holds an unknown kind")]
    picture = F.col("image").isNotNull() if "image" in raw.columns else F.lit(False)
    signal = picture | filled("q") | filled("ean") | filled("name") | filled("mpn") | filled("sku") | filled("image_url") | F.col("phash").isNotNull()
    tests += [(~signal, "no signal: one of q, ean, name, mpn, sku or an image is needed")]
    return raw.withColumn("error", F.coalesce(*(F.when(t, F.lit(m)) for t, m in tests)))


def from_json(bodies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests of (query_id, body), a JSON object each, and query_id and error of the others. A scope
    may be one kind or a list; fields that a request doesn't know are passed over."""
    fields = ", ".join(f for f in QUERY.split(", ") if not f.startswith("query_id"))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}
    text = F.trim("body")
    scope = F.get_json_object("body", "$.scope")
    one = F.when(scope.isNotNull() & ~scope.startswith("["), F.array(scope))
    df = bodies.withColumn("__r", F.from_json("body", f"{fields}, __bad string", options))
    good = F.coalesce(text.startswith("{") & (F.col("__r").isNotNull()) & (F.col("__r.__bad").isNull() | one.isNotNull()), F.lit(False))
    names = [f.split()[0] for f in QUERY.split(", ") if not f.startswith("query_id")]
    # a scope that is no list spoils the whole record, so it is read again without it
    rest = F.from_json(F.when(one.isNotNull(), F.regexp_replace("body", r'"scope"\s*:\s*"[^"]*"', '"scope":null')).otherwise(F.col("body")), fields)
    read = df.where(good).withColumn("__r", rest).select("query_id", *(F.coalesce(one, F.col("__r.scope")).alias("scope") if n == "scope" else F.col(f"__r.{n}").alias(n) for n in names))
    return read, df.where(~good).select("query_id", F.lit("the body isn't a JSON object").alias("error"))


def throttled(requests: DataFrame, rates: dict[str, str] | None = None) -> DataFrame:
    """Requests (user_id, ts, has_image) with `allowed`: at most so many for each user, kind and minute. A
    rate that can't be read falls back to the default; it never switches the limit off."""
    def rate(kind: str) -> int:
        n, _, unit = str((rates or {}).get(kind, "")).partition("/")
        seconds = {"s": 1, "m": 60, "h": 3600, "d": 86400}.get(unit[:1])
        return max(1, int(n) * 60 // seconds) if n.isdigit() and int(n) and seconds else RATES[kind]

    kind = F.coalesce("has_image", F.lit(False))
    place = F.row_number().over(Window.partitionBy("user_id", kind, F.date_trunc("minute", "ts")).orderBy("ts"))
    return requests.withColumn("allowed", place <= F.when(kind, rate("image")).otherwise(rate("text")))


#: Requests a minute for a user.
RATES = {"text": 60, "image": 30}

_RUN = r"(?U)(?<!\d)(\d{8,14})(?!\d)"


def mined(q: Column) -> tuple[Column, Column]:
    """The first run of 8 to 14 digits in q that is a GTIN (null if none), and q without it."""
    q = F.coalesce(q, F.lit(""))
    run = F.get(F.filter(F.regexp_extract_all(q, F.lit(_RUN), 1), lambda r: identifiers.gtin_valid(r)), F.lit(0))
    rest = identifiers.stripped(F.regexp_replace(q, F.concat(F.lit(r"(?Us)^(.*?)(?<!\d)"), run, F.lit(r"(?!\d)")), F.lit("$1 ")))
    return run, F.when(run.isNull(), q).otherwise(rest)


def parse(raw: DataFrame, config: EngineConfig | None = None) -> DataFrame:
    """Good requests with the columns of a fingerprint. Given fields win over what q yields: an ean
    that isn't valid doesn't fall back to a GTIN in q."""
    config = config or EngineConfig()
    run, text = mined(F.col("q"))
    df = raw.withColumns({"__run": run, "__text": text, "__brand": names.brand(F.col("brand"))})
    given = F.coalesce(F.col("ean"), F.lit("")) != ""
    df = df.withColumns({
        "__gtin": identifiers.gtin(F.when(given, F.col("ean")).otherwise(F.col("__run"))),
        "__name": F.when(F.coalesce(F.col("name"), F.lit("")) != "", F.col("name")).otherwise(F.col("__text")),
    })
    df = names.normalize_names(df, "__name", "__brand")
    first = lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(b)
    pack = F.col("attrs.pack_qty")
    return df.select(
        "query_id", F.col("__gtin.gtin14").alias("gtin14"), F.col("__gtin.trusted").alias("gtin_trusted"),
        first(F.col("__brand"), F.col("name_brand")).alias("brand_norm"), identifiers.mpn(F.col("mpn"))["strict"].alias("mpn_norm"),
        identifiers.stripped(F.col("sku")).alias("sku"), "name_norm", "name_tokens",
        F.when(pack > 0, pack).otherwise(F.col("name_pack")).alias("pack_qty"),
        first(names.color(F.col("attrs.color")), F.col("name_color")).alias("color"),
        first(F.lower(identifiers.stripped(F.col("attrs.size"))), F.col("name_size")).alias("size"),
        *(F.col(f"attrs.{a}").cast("decimal(38,10)").alias(a) for a in AXES),
        F.coalesce("scope", F.array(*map(F.lit, KINDS))).alias("scope"), F.coalesce("limit", F.lit(config.default_limit)).alias("limit"),
        "phash", "image_vec", "model_id", *(["image_warnings"] if "image_warnings" in raw.columns else []),
    )
