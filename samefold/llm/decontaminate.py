"""Benchmark decontamination with a generalised suffix automaton over words.

All items are added to one automaton. A text's words stream through it, which keeps, at each word,
the length of the longest suffix read that occurs in any item. Where that length is at least
`window` words (or a whole item that is shorter), those words are hit and the items that hold the
window are known from the state. Runs of words too short to hold any window, because they contain
words no item has, are stepped over.

Normalised words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. Items go to the tasks in
shards of at most `SHARD_WORDS` words, so an automaton's size is bounded however large the benchmark
is; with several shards, the texts stream past each shard and the hits are united.

Null texts have no words. Null or empty items have no windows. Items with one id count once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from samefold.llm.common import _FOLD, arrow_map, documents, fields, folded_words, packed, staged, table, unpacked, utf8

WINDOW = 8
SHARD_WORDS = 200_000


class Automaton:
    """A generalised suffix automaton of word sequences that knows its windows."""

    def __init__(self, items: list[tuple[object, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.vocab: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocab.setdefault(w, len(self.vocab)) for w in ws]) for i, ws in items if ws]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        #: state -> items of the window that ends there (of `window` words)
        self.items: dict[int, set] = {}
        short: dict[int, dict[int, set]] = {}  # state -> length -> items shorter than a window
        self.least = min([min(len(c), window) for _, c in coded], default=window)
        for i, codes in coded:
            state, size = 0, 0
            for c in codes:
                state, size = self.step(state, size, c)
                if size > window:
                    while self.length[self.link[state]] >= window:
                        state = self.link[state]
                    size = min(size, window)
                if size == window:
                    self.items.setdefault(state, set()).add(i)
            if len(codes) < window:
                short.setdefault(state, {}).setdefault(len(codes), set()).add(i)
        #: state -> [(length, items)] of the short items that end there, its suffixes' included
        self.short: dict[int, list[tuple[int, set]]] = {}
        if short:
            for s in sorted(range(1, len(self.length)), key=self.length.__getitem__):
                own = [*self.short.get(self.link[s], []), *short.get(s, {}).items()]
                if own:
                    self.short[s] = own

    def _extend(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if c in nxt[last]:
            q = nxt[last][c]
            if length[q] == length[last] + 1:
                return q
            return self._clone(last, c, q)
        new = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = new
            p = link[p]
        if p != -1:
            q = nxt[p][c]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
        return new

    def _clone(self, p: int, c: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        k = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        link[q] = k
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = k
            p = link[p]
        return k

    def step(self, state: int, size: int, c: int) -> tuple[int, int]:
        """The state and the longest match after one more word."""
        nxt, link = self.next, self.link
        while state and c not in nxt[state]:
            state = link[state]
            size = self.length[state]
        to = nxt[state].get(c)
        return (0, 0) if to is None else (to, size + 1)

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """Hit spans of words (end exclusive, joined), items with occurring windows, longest match."""
        n = len(words)
        if n < self.least or not self.vocab:
            return [], set(), 0
        ids = np.fromiter(map(self.vocab.get, words, repeat(-1)), np.int32, n)
        cut = np.flatnonzero(ids < 0)
        edges = np.concatenate(([-1], cut, [n]))
        runs = np.flatnonzero(np.diff(edges) > self.least)
        spans: list[list[int]] = []
        found: set = set()
        top = 0
        window, length, link, items, short = self.window, self.length, self.link, self.items, self.short
        for r in runs.tolist():
            a, b = int(edges[r]) + 1, int(edges[r + 1])
            state = size = 0
            for i, c in enumerate(ids[a:b].tolist(), a):
                state, size = self.step(state, size, c)
                reach = 0
                if size >= window:
                    s = state
                    while length[link[s]] >= window:
                        s = link[s]
                    found |= items[s]
                    reach = window
                if short and state in short:
                    for m, who in short[state]:
                        if m <= size:
                            found |= who
                            reach = max(reach, m)
                if reach:
                    top = max(top, size)
                    start = i + 1 - reach
                    if spans and start <= spans[-1][1]:
                        spans[-1][0] = min(spans[-1][0], start)
                        spans[-1][1] = i + 1
                    else:
                        spans.append([start, i + 1])
        return _united(spans), found, top


def _united(spans) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def word_places(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each normalised word in UTF-8 bytes."""
    on = np.frombuffer(data.translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([False], on, [False])).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without spans of words (and the blanks before them)."""
    data = utf8(text)
    starts, ends = word_places(data)
    out, at = [], 0
    for a, b in spans:
        out.append(data[at : starts[a]].rstrip(b" "))
        at = int(ends[b - 1])
    out.append(data[at:])
    return b"".join(out).decode()


def shards(bench: DataFrame, most: int = SHARD_WORDS) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items' words, in parts of at most `most` words (a longer item is a part of its own), at least
    one part. Rows come in one partition at a time; a part is handed on as soon as it is full."""
    part: list = []
    size = 0
    for r in bench.select("item_id", "text").where(F.col("text").isNotNull()).toLocalIterator():
        words = folded_words(r.text)
        if part and size + len(words) > most:
            yield part
            part, size = [], 0
        part.append((r.item_id, words))
        size += len(words)
    yield part


_COLUMNS = {"doc_id": pa.int64(), "n_words": pa.int64(), "spans": pa.list_(pa.int64()), "items": pa.list_(pa.string()), "longest": pa.int64(), "text": pa.string()}
_MATCHES = "doc_id long, n_words long, spans array<bigint>, items array<string>, longest long"


def _match(docs: DataFrame, items, window: int, keep_text: bool, extra: list[str], then: Callable | None = None, into: StructType | None = None) -> DataFrame:
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(items)  # at most SHARD_WORDS words
    state: dict[str, Automaton] = {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        machine = state.get("it") or state.setdefault("it", Automaton(sent.value, window))
        rows = []
        for text in batch.column(1).to_pylist():
            words = folded_words(text)
            spans, found, top = machine.hits(words)
            rows.append((len(words), [x for s in spans for x in s], sorted({str(i) for i in found if i is not None}), top))
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), list(_COLUMNS.values())[1:5], strict=True)]
        more = [batch.column(k) for k in range(1 if keep_text else 2, batch.num_columns)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols, *more], [*list(_COLUMNS)[:5], *(["text"] if keep_text else []), *extra])

    schema = fields(_MATCHES + (", text string" if keep_text else ""), docs, *extra)
    if then:  # in the same call: a second map would keep a second Python worker for each core
        return arrow_map(docs.select("doc_id", "text", *extra), into, lambda batch: then(one(batch)))
    return arrow_map(docs.select("doc_id", "text", *extra), schema, one)


def match(docs: DataFrame, bench: DataFrame, window: int = WINDOW, keep_text: bool = False, extra: tuple[str, ...] = (), shard_words: int = SHARD_WORDS, then: Callable | None = None, into: StructType | None = None) -> DataFrame:
    """doc_id, n_words, spans (of hit words: start, end, start, ...), items, longest match, and
    the text if asked for. One row for each row of docs; no shuffle with a benchmark of one shard.
    With `then`, what that function makes of batches of these columns (None: nothing), of schema `into`.
    With several, rows that agree in doc_id and text are told apart by nothing and come out alike."""
    parts = shards(bench, shard_words)
    first, second = next(parts), next(parts, None)
    if second is None:
        return _match(docs, first, window, keep_text, list(extra), then, into)
    key = ["doc_id", "__text"]
    found = None
    for items in chain((first, second), parts):  # one after another, so the driver holds a part or two
        one = _match(docs.withColumn("__text", F.xxhash64("text")), items, window, False, ["__text"]).where(F.size("spans") > 0)
        one = staged(one, "decontaminate")
        found = one if found is None else found.unionByName(one)
    pairs = F.expr("transform(sequence(0, size(spans) - 1, 2), i -> struct(spans[i] AS a, spans[i + 1] AS b))")
    hit = found.groupBy(*key).agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(pairs)))).alias("p"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"), F.max("longest").alias("longest"),
    )
    grow = """flatten(transform(aggregate(p, cast(array() as array<struct<a:bigint,b:bigint>>), (s, x) ->
        CASE WHEN size(s) > 0 AND x.a <= s[size(s) - 1].b
             THEN concat(slice(s, 1, size(s) - 1), array(struct(s[size(s) - 1].a AS a, greatest(s[size(s) - 1].b, x.b) AS b)))
             ELSE concat(s, array(x)) END), x -> array(x.a, x.b)))"""
    hit = hit.select(F.col("doc_id").alias("__id"), F.col("__text").alias("__t"), F.expr(grow).alias("spans"), "items", "longest")
    base = _match(docs.withColumn("__text", F.xxhash64("text")), [], window, keep_text, ["__text", *extra]).drop("spans", "items", "longest")
    out = base.join(hit, F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("__text").eqNullSafe(F.col("__t")), "left")
    out = out.select(
        "doc_id", "n_words", F.coalesce("spans", F.array().cast("array<bigint>")).alias("spans"), F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("longest", F.lit(0)).cast("long").alias("longest"), *(["text"] if keep_text else []), *extra,
    )
    return arrow_map(out, into, then) if then else out


def n_hit():
    return F.expr("aggregate(sequence(0, size(spans) - 2, 2), 0L, (n, i) -> n + spans[i + 1] - spans[i])")


def with_hits(found: DataFrame) -> DataFrame:
    return found.withColumn("n_hit", F.when(F.size("spans") > 1, n_hit()).otherwise(F.lit(0)).cast("long"))


def clean(docs: DataFrame, bench: DataFrame, max_coverage: float = 0.5, max_items: int = 1, window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """docs without what they share with the benchmark: a text with windows of over `max_items`
    items, or hit in over `max_coverage` of its words, goes; from others the hit spans are cut out."""
    columns, docs = docs.columns, packed(docs)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        n_words, spans, items, texts = (batch.column(k).to_pylist() for k in (1, 2, 3, 5))
        kept, cut = [], []
        for k, s in enumerate(spans):
            if len(items[k]) <= max_items and sum(s[1::2]) - sum(s[::2]) <= max_coverage * n_words[k]:
                kept.append(k)
                cut.append(without(texts[k], list(zip(s[::2], s[1::2], strict=True))) if s else texts[k])
        at = pa.array(kept, pa.int64())
        return pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(cut, pa.string()), batch.column(6).take(at)], ["doc_id", "text", "__x"]) if kept else None

    into = fields("doc_id long, text string", docs, "__x")
    return unpacked(match(docs, bench, window, keep_text=True, extra=("__x",), shard_words=shard_words, then=one, into=into), columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_hits(match(documents(spark, sf_dir), table(spark, sf_dir, "benchmark")))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.size("items") >= 2).alias("contaminated"),
    )



SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
sizes AS (SELECT DISTINCT least(len(ws), 8)::BIGINT AS m FROM b WHERE len(ws) > 0),
bw AS (SELECT DISTINCT item_id, m, list_slice(ws, i, i + m - 1) AS w FROM (
  SELECT item_id, ws, least(len(ws), 8)::BIGINT AS m, unnest(range(1, greatest(len(ws) - 6, 2)::BIGINT)) AS i FROM b WHERE len(ws) > 0)),
dw AS (SELECT r, i, m, list_slice(ws, i, i + m - 1) AS w FROM (
  SELECT r, ws, m, unnest(range(1, greatest(len(ws) - m + 2, 1)::BIGINT)) AS i FROM d, sizes)),
hit AS (SELECT DISTINCT r, i, dw.m, item_id FROM dw JOIN bw USING (w)),
n AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN its USING (r)
"""
