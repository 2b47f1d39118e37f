"""Scoring situations, blocking against brute force, and the engine end to end."""

import datetime
import itertools
import json
import random
import struct
import zlib
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from samefold.config import KINDS, EngineConfig
from samefold.engine import Engine
from samefold.functions import similarity
from samefold.operators import blocking, images, scans, scoring
from samefold.plans import decisions, evaluate, fingerprints, oracles, parse
from samefold.plans import queries as engine_queries
from samefold.schemas import FINGERPRINT, ITEM, QUERY
from samefold.sources.catalog import CatalogSource, Registry, read_pairs
from samefold.sources.embedding import EmbeddingError, NoProvider, ProviderInfo, check_url, embed, make_provider
from samefold.sources.hosted import HostedProvider, fetch_picture
from samefold.streaming.refresh import SnapshotStore, latest, refresh_stream, watched

PIM, ATLAS = KINDS
BASE = dict(gtin14="", gtin_trusted=False, brand_norm="", mpn_norm="", name_norm="", pack_qty=None, color="", size="", weight=None, width=None, height=None, deep=None, phash=None, image_vec=None)
TYPES = dict(gtin14="string", gtin_trusted="boolean", brand_norm="string", mpn_norm="string", name_norm="string", pack_qty="int", color="string", size="string", phash="long", image_vec="array<float>")


def pair(spark, cases):
    """Scores of (query, candidate, name similarity)."""
    cols, rows = [], []
    for side, more in (("q", {"sku": "", "model_id": None}), ("c", {"ref": "x", "vec_model": ""})):
        for k in {**BASE, **more}:
            kind = TYPES.get(k, "string" if k in more else "decimal(38,10)" if side == "q" else "decimal(12,4)")
            cols.append((side, k, f"{side}_{k} {kind}", {**BASE, **more}[k]))
    from decimal import Decimal

    for n, (q, c, s) in enumerate(cases):
        value = lambda side, k, default: (q if side == "q" else c).get(k, default)  # noqa: B023, E731
        fix = lambda k, v: Decimal(str(v)) if v is not None and k in ("weight", "width", "height", "deep") else v
        rows.append((n, *(fix(k, value(side, k, d)) for side, k, _, d in cols), float(s)))
    df = spark.createDataFrame(rows, "n long, " + ", ".join(x[2] for x in cols) + ", name_similarity double")
    return scoring.score(df).orderBy("n").collect()


G = dict(gtin14="05901234123457", gtin_trusted=True)
V = [1.0, 0.0]
SITUATIONS = [
    # query, candidate, similarity, score, decision, flags
    ({**G}, {**G}, 0, 60, "match", {"identifier_exact"}),
    ({**G}, {**G, "gtin_trusted": False}, 0, 15, "no_match", set()),
    ({"mpn_norm": "A1", "brand_norm": "b"}, {"mpn_norm": "A1", "brand_norm": "b"}, 0, 55, "match", {"identifier_exact"}),
    ({"mpn_norm": "A1"}, {"mpn_norm": "A1", "brand_norm": "b"}, 0, 20, "no_match", set()),
    ({"mpn_norm": "A1", "brand_norm": "c"}, {"mpn_norm": "A1", "brand_norm": "b"}, 0, 0, "no_match", {"brand_conflict"}),
    ({"sku": "x"}, {}, 0, 30, "no_match", set()),
    # a dirty brand beside the same GTIN and name; a recycled barcode with another name
    ({**G, "brand_norm": "boreal", "name_norm": "kettle"}, {**G, "brand_norm": "cindra", "name_norm": "kettle"}, 1.0, 80, "match", {"identifier_exact", "brand_dirty_data"}),
    ({**G, "brand_norm": "boreal", "name_norm": "kettle"}, {**G, "brand_norm": "cindra", "name_norm": "blender"}, 0.0, 35, "review", {"identifier_exact", "brand_conflict"}),
    # a multipack; a name alone; another colour
    ({"name_norm": "desk lamp", "brand_norm": "b", "weight": 0.4}, {"name_norm": "desk lamp", "brand_norm": "b", "pack_qty": 3, "weight": 1.2}, 1.0, 40, "no_match", set()),
    ({"name_norm": "office chair", "brand_norm": "s", "weight": 0.3}, {"name_norm": "office chair", "brand_norm": "s", "weight": 0.309}, 1.0, 60, "review", set()),
    ({"mpn_norm": "T", "brand_norm": "b", "name_norm": "koszulka", "color": "white"}, {"mpn_norm": "T", "brand_norm": "b", "name_norm": "koszulka", "color": "black"}, 1.0, 60, "review", {"identifier_exact", "variant_conflict"}),
    # dimensions in any order; pack 0 is silent
    ({"width": 10, "height": 20, "deep": 30}, {"width": 30, "height": 10.2, "deep": 20}, 0, 5, "no_match", set()),
    ({"pack_qty": 0, "width": 1}, {"pack_qty": 2}, 0, 0, "no_match", set()),
    # pictures
    ({"phash": 0, "image_vec": V, "model_id": "m"}, {"phash": 31, "image_vec": V, "vec_model": "m"}, 0, 20, "no_match", {"image_only"}),
    ({"phash": 0}, {"phash": 1023}, 0, 6, "no_match", {"image_only"}),
    ({"phash": 0}, {"phash": 2047}, 0, 0, "no_match", set()),
    ({"phash": 0, "image_vec": V, "model_id": "m"}, {"image_vec": V, "vec_model": "other"}, 0, 0, "no_match", set()),
    # half to even: 25 * (0.46 - 0.35) / 0.55 = 5
    ({"name_norm": "aaaa"}, {"name_norm": "zzzz"}, 0.46, 5, "no_match", set()),
    ({"name_norm": "aaaa"}, {"name_norm": "zzzz"}, 0.34, 0, "no_match", set()),
]


def test_scoring(spark):
    for r, (q, c, s, score, decision, flags) in zip(pair(spark, [x[:3] for x in SITUATIONS]), SITUATIONS, strict=True):
        assert (r.score, r.decision, set(r.flags)) == (score, decision, flags), (q, c, r.reasons)
        points = [x.score for x in r.reasons]
        assert r.score == min(100, max(0, sum(points))) and points == sorted(points, key=lambda p: -abs(p))


def test_relevance(spark):
    same, other = [1.0, 0.0], [0.9, 0.435889894]
    cases = [
        ({**G}, {**G}, 0, 100, "exact"),
        ({"sku": "x"}, {}, 0, 80, "similar"),
        ({"name_norm": "aaaa"}, {"name_norm": "bbbb"}, 0.35, 0, "none"),
        ({"name_norm": "aaaa bb"}, {"name_norm": "bb aaaa cc"}, 0.1, 100, "similar"),
        ({"name_norm": "aaaa"}, {"name_norm": "bbbb"}, 0.95, 100, "similar"),
        ({"phash": 0}, {"phash": 31}, 0, 100, "exact"),
        ({"phash": 0}, {"phash": 1023}, 0, 85, "similar"),
        ({"phash": 0, "image_vec": same, "model_id": "m"}, {"phash": 1, "image_vec": other, "vec_model": "m"}, 0, 85, "similar"),
        ({"phash": 0, "image_vec": same, "model_id": "m"}, {"image_vec": other, "vec_model": "m"}, 0, 50, "similar"),
        ({"phash": 0, **G}, {"phash": -1, **G}, 0, 100, "exact"),
        ({"phash": 0, "sku": "x"}, {"phash": 1023}, 0, 82, "similar"),
    ]
    for r, (q, c, _, value, kind) in zip(pair(spark, [x[:3] for x in cases]), cases, strict=True):
        assert (r.relevance, r.match_kind) == (value, kind), (q, c)


def fp_rows(spark, rows):
    names = [p.split()[0] for p in FINGERPRINT.replace("decimal(12,4)", "decimal").split(", ")]
    base = {**dict.fromkeys(names), "kind": PIM, "gtin14": "", "gtin_trusted": False, "brand_norm": "", "mpn_norm": "", "name_norm": "", "name_tokens": [], "color": "", "size": "", "vec_model": "", "image_sha1": ""}
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], FINGERPRINT)


def raw_queries(spark, rows):
    names = ["query_id", "q", "ean", "brand", "mpn", "sku", "name", "attrs", "scope", "limit", "image_url", "phash", "image_vec", "model_id"]
    return spark.createDataFrame([tuple({**dict.fromkeys(names), "query_id": k, **r}[n] for n in names) for k, r in enumerate(rows)], QUERY)


def test_name_leg_finds_its_row(spark):
    words = ["drill", "lamp", "chair", "kettle", "mixer", "shoes", "shirt", "cover"]
    rows = [{"ref": f"SKU-{i:04d}", "name_norm": f"{words[i % 8]} zx{i:04d} seria qr{i % 1000:03d}", "brand_norm": ("acme", "globex")[i % 2]} for i in range(400)]
    fps = fp_rows(spark, rows)
    ids = list(range(0, 400, 47))
    q = parse.parse(raw_queries(spark, [{"query_id": i, "q": f"zx{i:04d} {words[i % 8]} seria"} for i in ids]))
    q = spark.createDataFrame(q.collect(), q.schema)
    got = {(r.query_id, r.ref) for r in blocking.by_text(q, fps, EngineConfig()).where("leg = 3").collect()}
    assert {(i, f"SKU-{i:04d}") for i in ids} <= got
    # brute force over all pairs
    t = similarity.trigrams
    every = q.crossJoin(fps.select("ref", F.col("name_norm").alias("n"))).select("query_id", "ref", similarity.set_similarity(t(F.col("n")), t(F.col("name_norm"))).alias("s"))
    want = {}
    for r in every.where("s >= 0.35").collect():
        want.setdefault(r.query_id, []).append((-r.s, r.ref))
    assert got == {(k, ref) for k, v in want.items() for _, ref in sorted(v)[:50]}


@pytest.mark.parametrize("spread_out", [True, False])
def test_text_legs_with_many_rows_of_one_name(spark, monkeypatch, spread_out):
    """Names that many rows have, brands within queries, scopes and small limits, against all pairs; each name is
    an entry once for a kind, however many rows have it."""
    if spread_out:
        monkeypatch.setattr(scans, "ENTRIES", 7)
        monkeypatch.setattr(scans, "ASKS", 1)
    rng = random.Random(5)
    words = ["kettle", "kettles", "lamp", "desk", "blue9", "pro", "c2", "acme"]
    names = sorted({" ".join(rng.sample(words, rng.randint(1, 4))) for _ in range(60)})
    rows = [{"kind": KINDS[k % 2], "ref": f"r{rng.random():.9f}", "name_norm": rng.choice(names[:8] if k % 3 else names), "brand_norm": rng.choice(["", "acme", "desk lamp", "zeta"])} for k in range(400)]
    fps = fp_rows(spark, rows)
    asked = [(i, n, [[PIM], [ATLAS], list(KINDS)][i % 3]) for i, n in enumerate([*names[::3], "acme desk lamp pro", "desk lamp", "pro acme", "pro acme", "kettle desk lamp c2"])]
    q = spark.createDataFrame([(i, n, sorted(set(n.split())), s) for i, n, s in asked], "query_id long, name_norm string, name_tokens array<string>, scope array<string>")
    got = {}
    for r in scans.by_name(q, fps, (3, 5), (0.3, 0.35, 0.6), (6, 4)).collect():
        got.setdefault((r.query_id, r.leg), []).append((r.place, r.kind, r.ref))
    gram = lambda t: frozenset(similarity.padded_trigrams(t))
    share = lambda a, b: float(np.float32(len(a & b) / len(a | b)))
    want = {}
    for i, n, scope in asked:
        tri, wordy = [], []
        for r in rows:
            if r["kind"] in scope:
                own, brand = gram(r["name_norm"]), r["brand_norm"]
                raw = share(gram(n), own)
                named = brand and f" {brand} " in f" {n} "
                sim = max(raw, share(gram(f" {n} ".replace(f" {brand} ", " ")), own)) if named else raw
                if raw >= np.float32(0.3) and sim >= 0.35:
                    tri.append((-sim, r["kind"], r["ref"]))
                w = similarity.word_similarity_of(n, r["name_norm"])
                if len(n.split()) > 1 and w >= np.float32(0.6):
                    wordy.append((-w, r["kind"], r["ref"]))
        for leg, found, k in ((3, tri, 6), (5, wordy, 4)):
            if found:
                want[i, leg] = [(p, kind, ref) for p, (_, kind, ref) in enumerate(sorted(found)[:k], 1)]
    assert {k: sorted(v) for k, v in got.items()} == want
    entries = scans._entries(q, fps, 6).collect()
    named = lambda r: r["brand_norm"] if r["brand_norm"] in ("acme", "desk lamp") else ""
    assert len(entries) == len({(r["kind"], r["name_norm"], named(r)) for r in rows}) and max(len(e.refs) for e in entries) <= 6


def test_word_leg(spark):
    fps = fp_rows(spark, [{"ref": "long", "name_norm": "kickscooter c2 pro kids 10.6mi range adjustable handlebar height refurbished"}, {"ref": "no", "name_norm": "garden hose"}])
    q = parse.parse(raw_queries(spark, [{"name": "kickscooter c2"}, {"name": "kickscoter c2 pro"}, {"name": "kickscooter"}]))
    q = spark.createDataFrame(q.collect(), q.schema)
    found = blocking.by_text(q, fps, EngineConfig())
    assert {(r.leg, r.query_id, r.ref) for r in found.collect()} == {(5, 0, "long"), (5, 1, "long")}


def test_hash_leg_is_exact(spark):
    rng = random.Random(1)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    hashes = [rng.getrandbits(64) for _ in range(300)]
    probes = [h ^ sum(1 << b for b in rng.sample(range(64), k % 14)) for k, h in enumerate(hashes[:40])]
    fps = fp_rows(spark, [{"ref": f"{k:03d}", "phash": sign(h)} for k, h in enumerate(hashes)])
    q = spark.createDataFrame([(k, [PIM], sign(p)) for k, p in enumerate(probes)], "query_id long, scope array<string>, phash long")
    got = {(r.query_id, int(r.ref)) for r in blocking.near_hash(q, fps, EngineConfig()).collect()}
    assert got == {(i, j) for (i, p), (j, h) in itertools.product(enumerate(probes), enumerate(hashes)) if (p ^ h).bit_count() <= 10}


def test_exact_pairs_are_all_there(spark):
    """A key that more rows share than a pool holds: the join gives all of them, the pool its limit."""
    fps = fp_rows(spark, [{"ref": f"r{k:03d}", "brand_norm": "b", "mpn_norm": "M1"} for k in range(130)])
    q = parse.parse(raw_queries(spark, [{"brand": "b", "mpn": "m1"}, {"sku": "r007"}]))
    q = spark.createDataFrame(q.collect(), q.schema)
    every = blocking.keyed(q, fps).select("query_id", "ref").collect()
    assert sorted(r.ref for r in every if r.query_id == 0) == [f"r{k:03d}" for k in range(130)]
    assert [r.ref for r in every if r.query_id == 1] == ["r007"]
    assert blocking.exact(q, fps, EngineConfig()).where("query_id = 0").count() == EngineConfig().candidate_limit


def test_block_exact_matches_its_sql_past_a_pool(spark, tmp_path):
    """130 parts of one brand whose keys agree modulo 997, so that they share brand and part number."""
    duckdb = pytest.importorskip("duckdb")
    keys = [150 + 997 * 50 * k for k in range(130)]
    spark.createDataFrame([(k, f"ring {k}", "Brand#1", "LARGE", 1, 1.0) for k in keys], "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(0, [1.0] * 64, 0)], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    base = duckdb.connect()
    for t in ("part", "embeddings"):
        base.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = sorted(base.execute(oracles.SQL["block_exact"]).fetchall())
    assert max(len(list(g)) for _, g in itertools.groupby(want, lambda r: r[0])) > EngineConfig().candidate_limit
    assert sorted(map(tuple, engine_queries.block_exact(spark, str(tmp_path)).collect())) == want


def test_probes_are_not_broadcast(spark):
    """Probes are hundreds of rows for a query, which Spark's estimate doesn't know."""
    fps = fp_rows(spark, [{"ref": "a", "phash": 1}])
    q = spark.createDataFrame([(0, [PIM], 3)], "query_id long, scope array<string>, phash long")
    plan = blocking.near_hash(q, fps, EngineConfig())._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def items(spark, rows):
    names = [p.split()[0] for p in ITEM.replace("map<string,string>", "map").split(", ")]
    base = {**dict.fromkeys(names), "kind": PIM, "name_by_lang": {}, "attrs": {}}
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], ITEM)


CATALOG = [
    dict(ref="42", gtin="5901234123457", brand="Robert Bosch GmbH", mpn="GSR 12V-35", name_by_lang={"en": "Bosch GSR 12V-35 drill blue 2x", "pl": "Bosch GSR 12V-35 wiertarka niebieska 2x"}, attrs={"weight": "1.2", "deep": "bad"}, updated_at=datetime.datetime(2026, 8, 22)),
    dict(ref="43", brand="Boreal", name_by_lang={"xx": "", "fr": "Boreal Desk Lamp"}, attrs={"weight": "0.4"}, updated_at=datetime.datetime(2026, 1, 1)),
    dict(ref="44"),
]


def test_fingerprints(spark):
    got = {r.ref: r for r in fingerprints.build(items(spark, CATALOG)).collect()}
    r = got["42"]
    assert (r.gtin14, r.gtin_trusted, r.brand_norm, r.mpn_norm, r.name_norm, r.pack_qty, r.color) == ("05901234123457", True, "bosch", "GSR12V35", "gsr 12v 35 wiertarka", 2, "blue")
    assert r.name_tokens == ["12v", "35", "gsr", "wiertarka"] and float(r.weight) == 1.2 and r.deep is None
    assert got["43"].name_norm == "desk lamp" and (got["44"].gtin14, got["44"].name_norm, got["44"].name_tokens, got["44"].weight) == ("", "", [], None)


def test_snapshot_maintenance(spark):
    first = items(spark, CATALOG)
    empty = spark.createDataFrame([], FINGERPRINT)
    snap, counts = fingerprints.backfill(empty, first)
    assert counts.first().n_written == 3
    snap = fp_rows(spark, [r.asDict() for r in snap.collect()])
    pics = spark.createDataFrame([(PIM, "42", 7, [1.0], "m", "abc")], "kind string, ref string, phash long, image_vec array<float>, vec_model string, image_sha1 string")
    pictured = fingerprints.set_images(snap, pics)
    kept = {r.ref: r for r in fingerprints.upsert(pictured, fingerprints.build(first)).collect()}
    assert kept["42"].phash == 7 and kept["42"].vec_model == "m" and kept["43"].phash is None and len(kept) == 3
    later = items(spark, [CATALOG[0], dict(ref="50", name_by_lang={"en": "kettle"})])
    after, n = fingerprints.reconcile(snap, later)
    assert [tuple(r) for r in n.collect()] == [(PIM, 1, 2)] and {r.ref for r in after.collect()} == {"42", "50"}
    assert fingerprints.reconcile(fp_rows(spark, [r.asDict() for r in after.collect()]), later)[1].count() == 0
    refs = spark.createDataFrame([(PIM, "42"), (PIM, "43"), (PIM, "99")], "kind string, ref string")
    _, out = fingerprints.refresh(snap, refs, later)
    assert {r.ref: r.outcome for r in out.collect()} == {"42": "refreshed", "43": "deleted", "99": "absent"}
    since = datetime.datetime(2026, 5, 1)
    assert fingerprints.backfill(empty, first, since)[1].first().n_written == 1


def test_parse_and_validate(spark):
    rows = [
        {"q": "bosch 5901234123457 GSR drill"}, {"q": "x 5901234123457", "ean": "123"}, {"q": "lamp", "name": "kettle blue"}, {"brand": "acme"}, {"q": "a", "limit": 21}, {"q": "a", "scope": ["moon"]},
        {"mpn": "a-1", "attrs": (None, None, None, None, "Czarna", " XL ", 3)}, {"q": "x" * 501}, {"sku": " s1 "},
    ]
    raw = raw_queries(spark, rows)
    bad = {r.query_id: r.error for r in parse.validate(raw).collect() if r.error}
    assert set(bad) == {3, 4, 5, 7}
    got = {r.query_id: r for r in parse.parse(raw.where("query_id IN (0, 1, 2, 6, 8)")).collect()}
    assert (got[0].gtin14, got[0].brand_norm, got[0].name_norm) == ("05901234123457", "bosch", "gsr drill")
    assert (got[1].gtin14, got[1].name_norm) == ("", "x")
    assert (got[2].name_norm, got[2].color) == ("kettle", "blue")
    assert (got[6].mpn_norm, got[6].color, got[6].size, got[6].pack_qty) == ("A1", "black", "xl", 3)
    assert got[8].sku == "s1" and got[8].limit == 10 and got[8].scope == list(KINDS)


def test_engine(spark, tmp_path):
    source = CatalogSource(PIM, lambda s: items(s, CATALOG).drop("kind"), lambda s: s.createDataFrame([("42", "drill"), ("44", "-")], "ref string, name string"))
    engine = Engine(spark, Registry({PIM: lambda: source}), SnapshotStore(spark, str(tmp_path / "snap")))
    assert engine.fingerprints.count() == 0
    assert engine.backfill().first().n_written == 3 and engine.reconcile().count() == 0
    raw = raw_queries(spark, [{"ean": "5901234123457"}, {"name": "Boreal Desk Lamp"}, {"name": "zzzz qqqq", "image_url": "http://a/x.png"}, {"brand": "x"}])
    hits = engine.search(raw).collect()
    assert [(r.query_id, r.ref, r.similarity, r.match_kind, r.sku, r.name, r.brand, r.detail_url) for r in hits] == [(0, "42", 100, "exact", "42", "drill", "", "")] and "score" not in hits[0].asDict()
    log = str(tmp_path / "log")
    assert [r.decision for r in engine.check(raw, log, user_id=7).collect()] == ["match"]
    assert {r.query_id: r.decision for r in engine.overall(raw).collect()} == {0: "match", 1: "no_match", 2: "no_match"}
    assert [r.query_id for r in engine.rejected(raw).collect()] == [3]
    row = spark.read.parquet(log).first()
    assert row.decision_auto == "match" and row.user_id == 7 and json.loads(row.query)["gtin14"] == "05901234123457"
    found = {r.query_id: r for r in engine.check_answers(raw).collect()}
    unknown = f"kind_unavailable:{ATLAS}"
    assert found[0].decision == "match" and [h.ref for h in found[0].hits] == ["42"] and found[0].parsed.gtin14 == "05901234123457" and found[0].warnings == [unknown]
    assert found[2].hits == [] and found[2].warnings == [unknown, images.UNAVAILABLE] and found[2].parsed.name_norm == "zzzz qqqq"
    assert engine.doctor().where("name = 'snapshot'").first().ok and not engine.doctor().where("name = 'settings'").first().ok
    with pytest.raises(ValueError):
        engine.registry.get("moon")
    assert engine.registry.scoped(parse.parse(raw)).first().warnings == [unknown]
    assert "not retrieved: 0" in engine.report(engine.evaluate(spark.createDataFrame([(PIM, "42", PIM, "42", "match", "")], "query_kind string, query_ref string, candidate_kind string, candidate_ref string, label string, why string"), log_path=log))
    assert spark.read.parquet(log).where("source = 'lookup_eval'").count() == 1


def test_kinds_without_display_show_their_items(spark, tmp_path):
    def broken(s):
        raise LookupError("no such thing")

    own = [dict(ref="a1", name_by_lang={"en": "Boreal Desk Lamp"}, image_path_or_url="/x.png", gtin="5901234123457")]
    for display in (None, broken):
        registry = Registry({
            PIM: CatalogSource(PIM, lambda s: items(s, CATALOG).drop("kind"), lambda s: s.createDataFrame([("43", "lamp", "u")], "ref string, name string, detail_url string")),
            ATLAS: CatalogSource(ATLAS, lambda s: items(s, own).drop("kind"), display),
        })
        engine = Engine(spark, registry, SnapshotStore(spark, str(tmp_path / f"snap{display is None}")))
        engine.backfill()
        hits = {r.ref: r for r in engine.search(raw_queries(spark, [{"name": "boreal desk lamp"}])).collect()}
        assert set(hits) == {"43", "a1"} and hits["43"].detail_url == "u"
        assert (hits["a1"].name, hits["a1"].ean, hits["a1"].main_image_url, hits["a1"].sku) == ("Boreal Desk Lamp", "5901234123457", "/x.png", "a1")


def test_decisions(spark):
    v = spark.createDataFrame([("s1", PIM, "a", "rejected", "review", 50, 1), ("s1", PIM, "b", "accepted", "review", 50, 1), ("s2", PIM, "c", "rejected", "match", 80, None)], "subject_ref string, candidate_kind string, candidate_ref string, decision_human string, decision_auto string, score int, user_id long")
    log = decisions.from_verdicts(v)
    subjects = spark.createDataFrame([("s1",)], "subject_ref string")
    assert [tuple(r) for r in decisions.rejected_pairs(log, subjects).collect()] == [("s1", "a")]
    assert decisions.rejected_pairs(log, subjects.where("false")).count() == 0
    with pytest.raises(Exception, match="unknown human decision"):
        decisions.from_verdicts(v.withColumn("decision_human", F.lit("maybe"))).collect()


def test_pairs_and_evaluation(spark, tmp_path):
    path = tmp_path / "pairs.csv"
    path.write_text(f"﻿query_kind,query_ref,candidate_kind,candidate_ref,label,why\n{PIM}, 42 ,{PIM},42,Match,\n{PIM},43,{PIM},42,no,\n,,,,,\n{PIM},77,{PIM},42,match,x\nmoon,42,{PIM},42,match,\n{PIM},42,{PIM},43,perhaps,\n", encoding="utf-8")
    pairs = read_pairs(spark, str(path))
    assert pairs.count() == 5
    its = items(spark, CATALOG)
    out = evaluate.outcomes(pairs, its, fp_rows(spark, [r.asDict() for r in fingerprints.build(its).collect()])).collect()
    got = {(r.query_kind, r.query_ref, r.label): r for r in out}
    hit = got[(PIM, "42", "match")]
    assert hit.retrieved and hit.decision == "match" and hit.name_blocked and hit.image_blocked is None
    assert not got[(PIM, "43", "no")].retrieved
    assert {k: r.skip_reason for k, r in got.items() if r.skip_reason} == {(PIM, "77", "match"): "stale ref", ("moon", "42", "match"): "unknown kind", (PIM, "42", "perhaps"): "bad label"}
    assert evaluate.parse_thresholds("45,x") == [45, 75] and evaluate.parse_thresholds("10, 20") == [10, 20]


def test_stream_refresh(spark, tmp_path):
    schema = "kind string, ref string, ts long"
    store = SnapshotStore(spark, str(tmp_path / "snap"))
    spark.createDataFrame([(PIM, "43", 1), (PIM, "43", 2), (PIM, "42", 1)], schema).write.parquet(str(tmp_path / "changes"))
    later = [CATALOG[0] | {"mpn": "NEW1"}, CATALOG[2]]
    done = []

    def run(at="cp"):
        changes = spark.readStream.schema(schema).parquet(str(tmp_path / "changes"))
        stream = refresh_stream(changes, lambda s: items(s, later), store, str(tmp_path / at), after=lambda refs: done.append(refs.count()))
        return stream.trigger(availableNow=True)

    run("cp0").start().awaitTermination()  # an empty store
    assert {r.ref for r in store.read().collect()} == {"42"} and store.versions() == [0]
    store.write(fingerprints.build(items(spark, CATALOG)))
    waiting = run()
    store.write(store.read())  # a backfill between the stream's making and its first batch
    waiting.start().awaitTermination()
    assert {r.ref: r.mpn_norm for r in store.read().collect()} == {"42": "NEW1", "44": ""} and store.versions() == [0, 1, 2, 3] and done == [2, 2]
    later[1] = CATALOG[2] | {"mpn": "NEW2"}
    spark.createDataFrame([(PIM, "44", 9)], schema).write.mode("append").parquet(str(tmp_path / "changes"))
    run().start().awaitTermination()  # after a restart the next batch goes on
    assert {r.ref: r.mpn_norm for r in store.read().collect()} == {"42": "NEW1", "44": "NEW2"} and store.done(str(tmp_path / "cp")) == 1
    assert {r.ref for r in store.read(1).collect()} == {"42", "43", "44"}
    old = spark.createDataFrame([(PIM, "1", "a"), (PIM, "2", "b")], "kind string, ref string, f string")
    new = spark.createDataFrame([(PIM, "1", "a"), (PIM, "2", "c"), (PIM, "3", "d")], "kind string, ref string, f string")
    assert sorted(r.ref for r in watched(new, old, ["f"]).collect()) == ["2", "3"] and watched(new, old, []).count() == 3
    tied = spark.createDataFrame([(PIM, "1", 5, "a"), (PIM, "1", 5, "b"), (PIM, "1", 4, "c")], "kind string, ref string, ts long, f string")
    assert [r.f for r in latest(tied).collect()] == ["b"]


class Unlike:
    """A backend whose vectors tell pictures by their mean colour."""

    def __init__(self, settings):
        self.dim = settings["dim"]

    def embed_images(self, pictures):
        return [[*(images.decode(p).mean(axis=(0, 1)) / 255 - 0.5).tolist(), *[0.01] * (self.dim - 3)] for p in pictures]

    def info(self):
        return ProviderInfo("u", self.dim)


def test_pictures_from_bytes(spark, tmp_path):
    import numpy as np

    rng = np.random.default_rng(2)
    grid = lambda: np.kron(rng.integers(0, 240, (12, 12, 3)), np.ones((9, 9, 1))).astype(np.uint8)
    red, blue = grid(), grid()
    red[..., 0] //= 4
    blue[..., 2] //= 4
    assert (images.decode(images.encode(red)) == red).all() and images.format_of(b"GIF89a") == ""
    for filtered in (1, 3, 4):  # PNG with other line filters
        assert (images.decode(png(red, filtered)) == red).all()
    for bad in (b"", b"GIF89a", images.encode(red)[:60]):
        with pytest.raises(ValueError):
            images.decode(bad)
    config = EngineConfig(embedding={"provider": "tests.test_engine.Unlike", "model": "u", "dim": 8})
    rows = [dict(ref="1", name_by_lang={"en": "lamp"}, image_path_or_url="/p/1.png"), dict(ref="2", name_by_lang={"en": "kettle"}, image_path_or_url="http://a/2.png"), dict(ref="3", image_path_or_url="/p/3.png")]
    source = CatalogSource(PIM, lambda s: items(s, rows).drop("kind"))
    sent = {"http://a/q.png": images.encode(blue)}
    engine = Engine(spark, Registry({PIM: source}), SnapshotStore(spark, str(tmp_path / "snap")), config, fetch=sent.__getitem__)
    engine.backfill()
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "1.png").write_bytes(images.encode(red))
    (tmp_path / "p" / "3.png").write_bytes(b"no picture")
    paths = engine.registry.items(spark)
    contents = images.stored_contents(spark, str(tmp_path / "p"), paths).unionByName(images.fetched_contents(paths, lambda url: images.encode(blue)))
    contents = spark.createDataFrame(contents.collect(), contents.schema)
    assert engine.refresh_images(contents).first().n_written == 2
    assert engine.refresh_images(contents).count() == 0  # unchanged pictures are passed over
    got = {r.ref: r for r in engine.fingerprints.collect()}
    assert got["1"].phash == images.phash(red) and got["2"].vec_model == "u" and len(got["2"].image_vec) == 8 and got["3"].phash is None
    raw = raw_queries(spark, [{"image_url": "http://a/q.png"}, {"name": "lamp"}]).withColumn("image", F.when(F.col("query_id") == 1, F.lit(images.encode(red))))
    hits = {(r.query_id, r.rank): r for r in engine.search(raw).collect()}
    assert hits[0, 1].ref == "2" and hits[0, 1].match_kind == "exact" and hits[1, 1].ref == "1" and hits[1, 1].match_kind == "exact"
    checks = {r.name: r for r in engine.doctor(probe=(images.encode(red), images.encode(blue))).collect()}
    assert all(checks[n].ok for n in ("settings", "provider", "discrimination", "worker", "dimension")), checks
    assert not {r.name: r.ok for r in engine.doctor(probe=(images.encode(red), images.encode(red))).collect()}["discrimination"]
    off = Engine(spark, engine.registry, engine.store, replace(config, image_enabled=False))
    assert {r.query_id: r.warnings[-1] for r in off.search_answers(raw).collect()} == dict.fromkeys((0, 1), images.UNAVAILABLE)


def made_engine(spark):
    """For the command line: the catalog of these tests in the session's shared folder."""
    source = CatalogSource(PIM, lambda s: items(s, CATALOG).drop("kind"))
    return Engine(spark, Registry({PIM: source}), SnapshotStore(spark, spark.conf.get("spark.test.snapshots")))


def test_commands(spark, tmp_path, capsys):
    from samefold.__main__ import main

    spark.conf.set("spark.test.snapshots", str(tmp_path / "snap"))
    path = tmp_path / "pairs.csv"
    path.write_text(f"query_kind,query_ref,candidate_kind,candidate_ref,label\n{PIM},42,{PIM},42,match\n", encoding="utf-8")
    at = ["--engine", "tests.test_engine:made_engine"]
    assert main(["backfill", *at], spark) == 0 and main(["reconcile", *at], spark) == 0 and main(["doctor", *at], spark) == 1
    assert main(["evaluate", *at, "--pairs", str(path), "--thresholds", "50"], spark) == 0
    said = capsys.readouterr().out
    assert "n_written 3" in said and "[FAIL] settings" in said and "match >= 50: precision 1.000, recall 1.000" in said


def test_wired_changes(spark, tmp_path):
    schema = "ref string, ts long, name string, stock int"
    feed = str(tmp_path / "feed")
    spark.createDataFrame([("43", 1, "lamp", 5), ("42", 1, "drill", 9)], schema).write.parquet(feed)
    wired = CatalogSource(PIM, lambda s: items(s, CATALOG).drop("kind"), changes=lambda s: s.readStream.schema(schema).parquet(feed), watch=("name",))
    lost = CatalogSource(ATLAS, lambda s: items(s, []).drop("kind"), changes=lambda s: s.readStream.schema(schema).format("no-such-source").load())
    engine = Engine(spark, Registry({PIM: wired, ATLAS: lost}), SnapshotStore(spark, str(tmp_path / "snap")))
    seen = []

    def run():
        for stream in list(engine.connect(str(tmp_path / "cp"), lambda refs: seen.append(sorted(r.ref for r in refs.collect())), availableNow=True)):
            stream.awaitTermination()
        engine.disconnect()

    run()
    assert {r.ref for r in engine.fingerprints.collect()} == {"42", "43"}
    spark.createDataFrame([("43", 2, "lamp", 6), ("42", 2, "better drill", 9)], schema).write.mode("append").parquet(feed)
    run()  # only the watched name counts
    assert seen == [["42", "43"], ["42"]]


def test_requests_from_json_and_rates(spark):
    bodies = ['{"q": "lamp", "scope": "pim_product", "attrs": {"weight": 1.5}}', '{"ean": "123", "scope": ["pim_product", "moon"], "other": 1}', "[1]", "nope", None]
    good, bad = parse.from_json(spark.createDataFrame(list(enumerate(bodies)), "query_id long, body string"))
    got = {r.query_id: r for r in good.collect()}
    assert set(got) == {0, 1} and sorted(r.query_id for r in bad.collect()) == [2, 3, 4]
    assert got[0].q == "lamp" and got[0].scope == [PIM] and float(got[0].attrs.weight) == 1.5 and got[1].scope == [PIM, "moon"]
    assert parse.validate(good).where("error IS NOT NULL").first().query_id == 1
    t = datetime.datetime(2026, 1, 1)
    calls = spark.createDataFrame([(1, t + datetime.timedelta(milliseconds=k), k % 2 == 0) for k in range(100)] + [(2, t, None)], "user_id long, ts timestamp, has_image boolean")
    n = lambda **rates: parse.throttled(calls, rates).where("allowed").groupBy("user_id").count().orderBy("user_id").collect()
    assert [r["count"] for r in n()] == [80, 1] and [r["count"] for r in n(text="600/h", image="off")] == [40, 1]


def png(rgb, how):
    import numpy as np

    h, w, _ = rgb.shape
    x = rgb.reshape(h, -1).astype(int)
    left, up = np.pad(x, ((0, 0), (3, 0)))[:, :-3], np.pad(x, ((1, 0), (0, 0)))[:-1]
    corner = np.pad(up, ((0, 0), (3, 0)))[:, :-3]
    p = left + up - corner
    near = np.stack([abs(p - left), abs(p - up), abs(p - corner)]).argmin(axis=0)
    guess = {1: left, 3: (left + up) // 2, 4: np.choose(near, [left, up, corner])}[how]
    body = zlib.compress(np.concatenate((np.full((h, 1), how), (x - guess) & 255), axis=1).astype(np.uint8).tobytes())
    chunk = lambda n, b: struct.pack(">I", len(b)) + n + b + struct.pack(">I", zlib.crc32(n + b))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", body) + chunk(b"IEND", b"")


def test_hosted_backend():
    asked, replies = [], []

    def opened(url, timeout, data=None, headers=None):
        asked.append((url, json.loads(data) if data else None))
        status, head, body = replies.pop(0)
        return status, head, lambda n=-1: body if n < 0 else body[:n]

    settings = {"url": "http://inside/v", "model": "m", "dim": 2, "allowed_hosts": ["inside"], "api_key": "k"}
    provider = HostedProvider(settings, opened, sleep=lambda s: None)
    answer = lambda *v: (200, {}, json.dumps({"data": [{"index": i, "embedding": x} for i, x in v], "model": "m"}).encode())
    replies += [(503, {}, b""), answer((1, [3, 4]), (0, [1, 2]))]
    assert provider.embed_images([b"a", b"b"]) == [[1, 2], [3, 4]] and len(asked) == 2
    replies += [answer(*((i, [i, 0]) for i in range(64))), answer((0, [9, 9]))]
    assert len(HostedProvider(settings | {"concurrency": 1}, opened).embed_images([b"x"] * 65)) == 65
    for bad in ([(503, {}, b"")] * 3, [(400, {}, b"")], [answer((0, [1]))], [(200, {}, b"{}")], [(200, {}, b"nope")]):
        replies[:] = bad
        with pytest.raises(EmbeddingError):
            provider.embed_images([b"a"])
    replies[:] = [answer((0, [1, 2]))]
    assert provider.info() == ProviderInfo("m", 2) and provider.embed_images([]) == []
    public = lambda url, allowed: check_url(url, allowed, lambda h: ["10.0.0.1"] if h == "inside" else ["8.8.8.8"])
    get = lambda *r: (replies.__setitem__(slice(None), r), fetch_picture("http://a/x", opened=opened, checked=public, cap=10))[1]
    assert get((302, {"Location": "/y"}, b""), (200, {"Content-Type": "image/png"}, b"123")) == b"123" and asked[-1][0] == "http://a/y"
    for bad in ([(302, {"Location": "http://inside/"}, b"")], [(200, {"Content-Type": "text/html"}, b"")], [(200, {"Content-Type": "image/png"}, b"1" * 11)], [(404, {}, b"")], [(302, {"Location": "/y"}, b"")] * 9):
        with pytest.raises(ValueError):
            get(*bad)


def test_images():
    import numpy as np

    rng = np.random.default_rng(1)
    small = rng.integers(0, 240, (40, 60, 3)).astype(np.uint8)
    framed = np.full((100, 120, 3), 255, np.uint8)
    framed[20:60, 30:90] = small
    assert images.crop(framed).shape == small.shape and images.crop(np.full((5, 5, 3), 255, np.uint8)).shape == (5, 5, 3)
    assert images.phash(images.crop(framed)) == images.phash(small)
    big = np.kron(small[:, :, :], np.ones((4, 4, 1), np.uint8))
    assert ((images.phash(big) ^ images.phash(small)) & (1 << 64) - 1).bit_count() <= 5
    assert images.shrink(np.zeros((3000, 1500, 3), np.uint8)).shape == (1024, 512, 3) and -(1 << 63) <= images.phash(small) < 1 << 63


def test_embedding_surface(spark):
    assert isinstance(make_provider({}), NoProvider)
    with pytest.raises(ValueError):
        make_provider({"provider": "no.such.Thing"})
    df = spark.createDataFrame([(PIM, "1", b"x")], "kind string, ref string, content binary")
    assert embed(df, NoProvider, "none", 4).first().image_vec is None
    public = lambda h: ["8.8.8.8"]
    assert check_url("https://a.example/x", resolve=public)
    for url, to in (("ftp://a/x", public), ("http://", public), ("http://a/x", lambda h: ["10.0.0.1"])):
        with pytest.raises(ValueError):
            check_url(url, resolve=to)
    assert check_url("http://inside/x", ("inside",), lambda h: ["10.0.0.1"])


def test_queries_have_twins():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.oracle_sql()) >= 20


def test_top_hits(spark):
    from samefold.plans import queries

    out = queries.search_topk(spark, "/root/testdata/sf0.001").collect()
    assert out and all(0 <= r.similarity <= 100 and r.rank <= 10 for r in out)
    assert {r.query_id for r in queries.check_overall(spark, "/root/testdata/sf0.001").collect()} == {r.query_id for r in lookup_queries(spark)}


def lookup_queries(spark):
    from samefold.plans import queries

    return queries.requests(spark, "/root/testdata/sf0.001").select("query_id").collect()


def test_parse_query_takes_every_part(spark):
    from samefold.plans import queries

    sf = "/root/testdata/sf0.001"
    parts = [r.p_partkey for r in queries.table(spark, sf, "part").select("p_partkey").collect()]
    assert sorted(r.query_id for r in queries.parse_query(spark, sf).collect()) == sorted(parts)
