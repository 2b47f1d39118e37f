"""A stated set of queries against all rows: names and vectors, exactly.

The queries of a pass (at most `PASS_BYTES` of them, so what goes to every task is bounded) meet each
row (a vector where it lies, names once for all rows that have them). A task keeps the best k rows of
each query and returns those. Passes end in tables, so one pass is held at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from heapq import nsmallest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from samefold.functions.similarity import padded_trigrams, run_similarity
from samefold.storage import persisted

PASS_BYTES = 32 << 20
FOUND = "query_id long, kind string, ref string, leg int, measure double"
#: Queries whose vectors are multiplied with a batch at once.
VECTOR_BLOCK = 1024


def _passes(queries: DataFrame, size: Callable[[Row], int], most: int = PASS_BYTES) -> Iterator[list[Row]]:
    """At least one part, empty or not; the driver holds one at a time."""
    part, held = [], 0
    for r in queries.toLocalIterator(prefetchPartitions=False):
        if part and held + size(r) > most:
            yield part
            part, held = [], 0
        part.append(r)
        held += size(r)
    yield part


def _scanned(rows: DataFrame, parts: Iterator[list[Row]], run: Callable, name: str) -> DataFrame:
    spark, found = rows.sparkSession, None
    for part in parts:
        sent = spark.sparkContext.broadcast(part)
        one = persisted(rows.mapInArrow(lambda batches, sent=sent: run(sent.value, batches), FOUND), name)
        sent.destroy()
        found = one if found is None else found.unionByName(one)
    return found


def _table(best: list["_Best"], leg: int, ids: list[int]) -> pa.RecordBatch | None:
    rows = [(ids[j], kind, ref, leg, measure) for j, b in enumerate(best) for measure, kind, ref in b.cut()]
    if not rows:
        return None
    types = (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.float64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["query_id", "kind", "ref", "leg", "measure"])


class _Best:
    """The k rows with the least (measure, kind, ref)."""

    __slots__ = ("k", "rows", "worst")

    def __init__(self, k: int):
        self.k, self.rows, self.worst = k, [], float("inf")

    def put(self, measure: float, rows: list[tuple[str, str]]) -> None:
        self.rows += [(measure, kind, ref) for kind, ref in rows]
        if len(self.rows) >= 4 * self.k:
            self.cut()

    def cut(self) -> list[tuple[float, str, str]]:
        self.rows = nsmallest(self.k, self.rows)
        if len(self.rows) == self.k:
            self.worst = self.rows[-1][0]
        return self.rows


def _float4(x):
    return np.float32(x).astype(np.float64)


class _Entries:
    """Entries (a kind's rows of one name) by trigram."""

    def __init__(self, eid: list[int], kind: list[str], name: list[str], brand: list[str], n: list[int], least: list[str]):
        self.eid, self.kind, self.name, self.least = eid, kind, name, least
        self.n, self.known = np.array(n, np.int64), {}
        holders: dict[str, list[int]] = {}
        sizes, self.of_brand, self.of_kind = [], {}, {}
        for i, x in enumerate(name):
            grams = set(padded_trigrams(x))
            sizes.append(len(grams))
            for g in grams:
                holders.setdefault(g, []).append(i)
            if brand[i]:
                self.of_brand.setdefault(brand[i], []).append(i)
            self.of_kind.setdefault(kind[i], []).append(i)
        self.sizes = np.array(sizes, np.int64)
        self.holders = {g: np.array(x, np.int64) for g, x in holders.items()}
        self.scopes: dict[tuple, np.ndarray] = {}

    def common(self, grams: frozenset[str]) -> np.ndarray:
        found = [self.holders[g] for g in grams if g in self.holders]
        return np.bincount(np.concatenate(found), minlength=len(self.eid)) if found else np.zeros(len(self.eid), np.int64)

    def within(self, scope: tuple[str, ...]) -> np.ndarray:
        if scope not in self.scopes:
            mask = np.zeros(len(self.eid), bool)
            for k in scope:
                mask[self.of_kind.get(k, [])] = True
            self.scopes[scope] = mask
        return self.scopes[scope]

    def sequence(self, i: int) -> list[str]:
        if i not in self.known:
            if len(self.known) > 50_000:
                self.known.clear()
            self.known[i] = padded_trigrams(self.name[i])
        return self.known[i]

    def front(self, at: np.ndarray, value: np.ndarray, k: int) -> np.ndarray:
        """Places in `at` of the entries that hold the first k rows by value (large ones first), kind and ref. Of
        entries with the k-th row's value those count whose least rows are among the first k."""
        if self.n[at].sum() <= k:
            return np.arange(len(at))
        order = np.argsort(-value, kind="stable")
        last = value[order[np.searchsorted(np.cumsum(self.n[at][order]), k)]]
        tied = np.flatnonzero(value == last)
        if len(tied) > k:
            tied = np.array(nsmallest(k, tied.tolist(), key=lambda p: (self.kind[at[p]], self.least[at[p]])))
        return np.concatenate((np.flatnonzero(value > last), tied))

    def by_trigrams(self, name: str, grams: frozenset[str], c: np.ndarray, raw_floor: float, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Entries with a raw similarity and a name similarity of the floors at least, and the latter."""
        at = np.flatnonzero(c)
        raw = _float4(c[at] / (len(grams) + self.sizes[at] - c[at]))
        sim, padded = raw.copy(), f" {name} "
        for brand, own in self.of_brand.items():
            if f" {brand} " in padded:
                bare = frozenset(padded_trigrams(padded.replace(f" {brand} ", " ")))
                mine = np.flatnonzero(np.isin(at, own))
                both = self.common(bare)[at[mine]]
                sim[mine] = np.maximum(raw[mine], _float4(both / (len(bare) + self.sizes[at[mine]] - both)))
        good = (raw >= raw_floor) & (sim >= floor)
        return at[good], sim[good]

    def by_words(self, grams: frozenset[str], c: np.ndarray, floor: float, k: int, scopes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Entries with a word similarity of the floor at least, and that; all that may be among the first k rows of
        a scope. |Q & E| / |Q | E| can't be over |Q & all| / |Q|, so entries are tried in that order."""
        at = np.flatnonzero(c >= floor * len(grams) - 1e-6)
        at = at[np.any([s[at] for s in scopes], axis=0)] if len(at) else at
        at = at[np.argsort(-c[at], kind="stable")]
        found, values = [], []
        for part in np.split(at, np.flatnonzero(np.diff(c[at])) + 1) if len(at) else ():
            bound = c[part[0]] / len(grams) + 1e-6
            sure = [i for i, v in zip(found, values, strict=True) if v > bound]
            if all(self.n[[i for i in sure if s[i]]].sum() >= k for s in scopes):
                break
            for i in part.tolist():
                v = run_similarity(grams, self.sequence(i))
                if v >= floor:
                    found.append(i)
                    values.append(v)
        return np.array(found, np.int64), np.array(values, np.float64)


#: Entries that a task holds, and the least number of names asked for which entries are copied to a further task.
ENTRIES, ASKS = 20_000, 64
#: Rows of a name that was asked for, by number: (scope, two words or more) of an ask, leg, entry.
_MET = "number long, ask int, leg int, measure double, eid long"


def _entries(asked: DataFrame, fps: DataFrame, most: int) -> DataFrame:
    """eid, kind, name_norm, brand, refs: rows of a kind with one name have one similarity to a query, save
    where the query names their brand. So brands that no query names are left out here, and of the rows
    of an entry the first `most` by ref are all that can be among a query's first `most`."""
    w = F.split("name_norm", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(i, F.size(w)), lambda j: F.array_join(F.slice(w, i, j - i + 1), " "))))
    rows = fps.where("name_norm <> ''").select("kind", "ref", "name_norm", "brand_norm")
    spelled = asked.select("name_norm").distinct().select(F.explode(runs).alias("brand_norm")).distinct()
    named = persisted(rows.select("brand_norm").where("brand_norm <> ''").distinct().join(spelled, "brand_norm", "left_semi").withColumn("brand", F.col("brand_norm")), "named-brands")
    key = ["kind", "name_norm", "brand"]
    rows = rows.join(named, "brand_norm", "left").select("kind", "ref", "name_norm", F.coalesce("brand", F.lit("")).alias("brand"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("ref"))).where(F.col("place") <= most)
    return persisted(first.groupBy(*key).agg(F.array_sort(F.collect_list("ref")).alias("refs")).withColumn("eid", F.monotonically_increasing_id()), "entries")


def by_name(queries: DataFrame, fps: DataFrame, legs: tuple[int, int], floors: tuple[float, float, float], limits: tuple[int, int]) -> DataFrame:
    """query_id, kind, ref, leg, place: each query's first rows by trigrams (raw similarity of floors[0] and
    name similarity of floors[1] at least) and by words (word similarity of floors[2] at least, for
    queries of two words or more), by similarity, kind and ref.

    Each name that is asked for meets each name that rows have once. Names that are asked for go to every
    task, in passes; entries are dealt out over tasks, and where they fill few tasks, these share the names."""
    raw_floor, name_floor, word_floor = _float4(floors[0]), floors[1], _float4(floors[2])
    spark = fps.sparkSession
    asked = queries.where("length(name_norm) >= 3").select("query_id", "name_norm", "scope", (F.size("name_tokens") >= 2).alias("wordy"))
    entries = _entries(asked, fps, max(limits))
    names = persisted(asked.groupBy("name_norm").agg(F.collect_set(F.struct("scope", "wordy")).alias("asks")).withColumn("number", F.monotonically_increasing_id()), "names-asked")
    parts = max(1, -(-entries.count() // ENTRIES))

    def run(block: list[Row], slices: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tiles: dict[int, list[list]] = {}
        for batch in batches:
            for tile, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held = tiles.setdefault(tile, [[] for _ in row])
                for column, x in zip(held, row, strict=True):
                    column.append(x)
        for tile, columns in tiles.items():
            own, out = _Entries(*columns), []
            for q in block[tile // parts :: slices]:
                grams = frozenset(padded_trigrams(q.name_norm))
                c = own.common(grams)
                if not c.any():
                    continue
                asks = [(k, own.within(tuple(sorted(a.scope or ()))), a.wordy) for k, a in enumerate(q.asks)]
                met = [(legs[0], limits[0], *own.by_trigrams(q.name_norm, grams, c, raw_floor, name_floor), asks)]
                if wordy := [x for x in asks if x[2]]:
                    met.append((legs[1], limits[1], *own.by_words(grams, c, word_floor, limits[1], [x[1] for x in wordy]), wordy))
                for leg, k, at, value, whose in met:
                    for ask, mask, _ in whose:
                        mine = np.flatnonzero(mask[at])
                        if len(mine):
                            mine = mine[own.front(at[mine], value[mine], k)]
                            out += [(q.number, ask, leg, -v, own.eid[i]) for i, v in zip(at[mine].tolist(), value[mine].tolist(), strict=True)]
                if len(out) > 20_000:
                    yield _met(out)
                    out = []
            if out:
                yield _met(out)

    found = None
    for block in _passes(names, lambda r: 64 * len(r.name_norm) + 256):
        slices = max(1, min(-(-spark.sparkContext.defaultParallelism // parts), -(-len(block) // ASKS)))
        tile = (F.col("slice") * parts + F.pmod(F.xxhash64("name_norm"), F.lit(parts))).cast("int")
        dealt = entries.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)))).select(tile.alias("tile"), "eid", "kind", "name_norm", "brand", F.size("refs").alias("n"), F.get("refs", F.lit(0)).alias("least"))
        sent = spark.sparkContext.broadcast(block)
        one = persisted(dealt.repartitionById(parts * slices, "tile").mapInArrow(lambda batches, sent=sent, slices=slices: run(sent.value, slices, batches), _MET), "by-name")
        sent.destroy()
        found = one if found is None else found.unionByName(one)
    rows = found.join(entries.select("eid", "kind", "refs"), "eid").select("number", "ask", "leg", "measure", "kind", F.explode("refs").alias("ref"))
    w = Window.partitionBy("number", "ask", "leg").orderBy("measure", "kind", "ref")
    most = F.when(F.col("leg") == legs[0], limits[0]).otherwise(limits[1])
    best = rows.withColumn("place", F.row_number().over(w)).where(F.col("place") <= max(limits)).where(F.col("place") <= most).drop("measure")
    whose = names.select("number", "name_norm", F.posexplode("asks").alias("ask", "a")).select("number", "ask", "name_norm", "a.scope", "a.wordy").join(asked, ["name_norm", "scope", "wordy"]).select("number", "ask", "query_id")
    return best.join(whose, ["number", "ask"]).select("query_id", "kind", "ref", "leg", "place")


def _met(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], ["number", "ask", "leg", "measure", "eid"])


def _matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Places and unit vectors of a list column, by length of vector."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    sizes, out = np.diff(ends), []
    for dim in np.unique(sizes[sizes > 0]).tolist():
        at = np.flatnonzero(sizes == dim)
        m = flat[(ends[at][:, None] + np.arange(dim)).ravel()].reshape(-1, dim).astype(np.float64)
        out.append((at, m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-30)))
    return out


def by_vector(queries: DataFrame, fps: DataFrame, leg: int, k: int) -> DataFrame:
    """query_id, kind, ref, leg, measure (cosine distance): for each task and query the k nearest rows
    of the query's model, ties by kind and ref."""
    asked = queries.where("image_vec IS NOT NULL").select("query_id", "model_id", "scope", "image_vec")

    def run(block: list[Row], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [_Best(k) for _ in block]
        alike: dict[tuple, list[int]] = {}  # queries of one model, scope and length of vector
        for j, q in enumerate(block):
            alike.setdefault((q.model_id, tuple(sorted(q.scope)), len(q.image_vec)), []).append(j)
        blocks = []
        for (model, scope, dim), js in alike.items():
            for at in range(0, len(js), VECTOR_BLOCK):
                part = js[at : at + VECTOR_BLOCK]
                v = np.array([block[j].image_vec for j in part], np.float64)
                blocks.append((model, set(scope), dim, np.array(part), (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-30)).T))
        worst = np.full(len(block), np.inf)
        for batch in batches if block else ():
            kinds, refs, models = (batch.column(c).to_pylist() for c in range(3))
            for at, unit in _matrix(batch.column(3)):
                for model, scope, dim, js, vectors in blocks:
                    if dim != unit.shape[1]:
                        continue
                    own = np.array([p for p, i in enumerate(at.tolist()) if models[i] == model and kinds[i] in scope], np.int64)
                    if not len(own):
                        continue
                    far = 1 - unit[own] @ vectors
                    if len(own) > k:  # all rows up to the k-th distance, ties included
                        near = far <= np.minimum(np.partition(far, k - 1, axis=0)[k - 1], worst[js])
                    else:
                        near = far <= worst[js]
                    for c in np.flatnonzero(near.any(axis=0)).tolist():
                        j = int(js[c])
                        for p in np.flatnonzero(near[:, c]).tolist():
                            i = int(at[own[p]])
                            best[j].put(float(far[p, c]), [(kinds[i], refs[i])])
                        best[j].cut()
                        worst[j] = best[j].worst
        if (out := _table(best, leg, [q.query_id for q in block])) is not None:
            yield out

    rows = fps.where("image_vec IS NOT NULL").select("kind", "ref", "vec_model", "image_vec")
    return _scanned(rows, _passes(asked, lambda r: 8 * len(r.image_vec) + 256), run, "by-vector")
