"""Line dedup: hashes in range partitions, each streamed in order, keep bitmaps out.

Each document sends, for each of its distinct line keys, a 128-bit hash, its id and the line
numbers. These rows are range-partitioned by (hash, id descending) and sorted so within the
partitions; a stream over a partition meets a key's documents from the largest id down, so the first
one keeps its lines and, once a third one is met, all later ones lose theirs. The id belongs to the
range, so a line that stands in a third of all documents spreads over many partitions. Only the
first and last key of a partition can go on in a neighbour: their counts, two rows for a partition,
are added up apart and settle the rows held back for them.

What returns is one compressed bitmap of kept lines for each document that loses some; texts aren't
sorted or grouped. `apply_bitmaps` joins them with the texts.

A line's key is the line without `[\\x20\\x09-\\x0D]` at both ends, A-Z lower-cased; keys of under
`min_chars` code points are kept. Null texts count as one empty line. A null doc_id counts as smaller
than any other. Rows with one doc_id count as one document; equal rows come out alike.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samefold.llm.common import arrow_map, documents, fields, packed, small_batches, staged, unpacked, utf8

MIN_CHARS = 20
MIN_DOCS = 3
_BLANKS = " \t\n\x0b\x0c\r"
_LOWEST = -(1 << 63)


def lines_of(text: str | None) -> list[str]:
    return (text or "").split("\n")


def keyed(docs: DataFrame) -> DataFrame:
    """docs with __ord (doc_id, null as the lowest) and __th (a hash of the text), which together
    name a document's row."""
    return docs.withColumns({"__ord": F.coalesce(F.col("doc_id").cast("long"), F.lit(_LOWEST)), "__th": F.xxhash64("text")})


def hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """h1, h2, ord, th, lines: one row for each document and distinct key."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        digests, owner, numbers, ends = [], [], [], [0]
        for k, text in enumerate(batch.column(2).to_pylist()):
            own: dict[bytes, list[int]] = {}
            for i, line in enumerate(lines_of(text)):
                if len(line) >= min_chars and len(key := line.strip(_BLANKS)) >= min_chars:
                    own.setdefault(xxhash.xxh3_128_digest(utf8(key).lower()), []).append(i)
            digests += own
            owner += [k] * len(own)
            for v in own.values():
                numbers += v
                ends.append(len(numbers))
        if not digests:
            return None
        h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
        at = pa.array(owner, pa.int32())
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(numbers, pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(0).take(at), batch.column(1).take(at), lists], ["h1", "h2", "ord", "th", "lines"])

    return arrow_map(keyed(docs).select("__ord", "__th", "text"), "h1 long, h2 long, ord long, th long, lines array<int>", one)


#: What a stream over a partition says: lines to drop, lines that wait for a neighbour, and counts.
DROP, WAIT, COUNT = 0, 1, 2
_SAID = "kind int, h1 long, h2 long, ord long, th long, lines array<int>, n long"


def stream(batches: Iterator[pa.RecordBatch], min_docs: int) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (h1, h2, ord descending)."""
    key, first, n, top, last, held = None, True, 0, 0, 0, []
    out: list[tuple] = []

    def shut(final: bool) -> None:
        """The key that was open has no more rows here."""
        if first or final:
            out.append((COUNT, *key, top, 0, [], n))
            out.extend((WAIT, *key, o, t, x, 0) for o, t, x in held)

    for batch in batches:
        h1, h2, order = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        size = len(h1)
        new = np.ones(size + 1, bool)
        new[1:size] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        if key is not None:
            new[0] = (int(h1[0]), int(h2[0])) != key
        alone = new[:-1] & new[1:]
        alone[-1] = False  # may go on in the next batch
        rows = np.flatnonzero(~alone)
        th, lines = batch.column(3), batch.column(4)
        if key is None and alone[0]:  # the partition's first key is told in any case
            rows = np.concatenate(([0], rows))
        elif key is not None and alone[0]:
            shut(False)
            key, held, first = None, [], False
        takes = pa.array(rows)
        for i, t, x in zip(rows.tolist(), th.take(takes).to_pylist(), lines.take(takes).to_pylist(), strict=True):
            k, o = (int(h1[i]), int(h2[i])), int(order[i])
            if k != key:
                if key is not None:
                    shut(False)
                    first = False
                key, n, top, last, held = k, 1, o, o, []
            elif o != last:
                n, last = n + 1, o
            if first:
                out.append((WAIT, *k, o, t, x, 0))
            elif n >= min_docs:
                out += [(DROP, 0, 0, *h, 0) for h in held if h[0] != top]
                held = []
                if o != top:
                    out.append((DROP, 0, 0, o, t, x, 0))
            else:
                held.append((o, t, x))
        if len(out) > 4096:
            yield _said(out)
            out.clear()
    if key is not None:
        shut(True)
    if out:
        yield _said(out)


def _said(out: list[tuple]) -> pa.RecordBatch:
    types = [pa.int32(), *[pa.int64()] * 4, pa.list_(pa.int32()), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], [c.split()[0] for c in _SAID.split(", ")])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """ord, th, n_dropped, bitmap: one row for each document that loses lines. bitmap: zlib of packed
    bits, 1 for a line to drop; lines after its last bit stay."""
    small_batches(docs.sparkSession)
    rows = staged(hashes(docs, min_chars), "line-hashes")
    order = ["h1", "h2", F.desc("ord")]
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order, "th")
    said = staged(placed.mapInArrow(lambda b: stream(b, min_docs), _SAID), "line-stream")
    counts = said.where(F.col("kind") == COUNT).groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("ord").alias("top")).where(F.col("n") >= min_docs)
    # at most two keys for each partition of `placed`, so this side may be broadcast
    late = said.where(F.col("kind") == WAIT).drop("n").join(F.broadcast(counts), ["h1", "h2"]).where(F.col("ord") != F.col("top"))
    lost = said.where(F.col("kind") == DROP).select("ord", "th", "lines").unionByName(late.select("ord", "th", "lines"))
    listed = lost.groupBy("ord", "th").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        drops = [np.array(x, np.int64) for x in batch.column(2).to_pylist()]
        maps = []
        for x in drops:
            bits = np.zeros(int(x.max()) + 1, bool)
            bits[x] = True
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 9))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in drops], pa.int64()), pa.array(maps, pa.binary())], ["ord", "th", "n_dropped", "bitmap"])

    return arrow_map(listed, "ord long, th long, n_dropped long, bitmap binary", one)


def kept_text(text: str | None, bitmap: bytes | None) -> str | None:
    if bitmap is None:
        return text
    drop = np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8))
    return "\n".join(x for i, x in enumerate(lines_of(text)) if i >= len(drop) or not drop[i])


def with_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with n_dropped and __bitmap (null: all lines stay)."""
    maps = keep_bitmaps(docs, min_chars, min_docs)
    right = maps.select(F.col("ord").alias("__ord"), F.col("th").alias("__th"), F.col("n_dropped").alias("__n"), F.col("bitmap").alias("__bitmap"))
    return keyed(docs).join(right.hint("shuffle_hash"), ["__ord", "__th"], "left").drop("__ord", "__th")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with the repeated lines taken out of text; all other columns as they were."""
    columns, docs = docs.columns, packed(docs)
    found = with_bitmaps(docs, min_chars, min_docs)

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [kept_text(t, m) for t, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), batch.column(2), batch.column(3)], ["text", "doc_id", "__x"])

    return unpacked(arrow_map(found.select("text", "__bitmap", "doc_id", "__x"), fields("text string", docs, "doc_id", "__x"), one), columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_bitmaps(documents(spark, sf_dir).select("doc_id", "text"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, maps = batch.column(1).to_pylist(), batch.column(3).to_pylist()
        lines = pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64())
        sums = [hashlib.sha256(utf8(kept_text(t, m))).hexdigest() for t, m in zip(texts, maps, strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), lines, batch.column(2), pa.array(sums)], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    dropped = F.coalesce("__n", F.lit(0)).cast("long").alias("n")
    return arrow_map(found.select("doc_id", "text", dropped, "__bitmap"), "doc_id long, n_lines long, n_dropped long, kept_sha256 string", one)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
many AS (SELECT key, max(doc_id) AS top FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, many.key IS NOT NULL AND doc_id <> top AS gone FROM k LEFT JOIN many USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""
