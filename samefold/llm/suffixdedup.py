"""Suffix-array dedup: bytes covered by a WINDOW-byte string that also starts earlier are removed.

Sorting every suffix of a corpus in one place would move each byte WINDOW times. So suffixes are dealt
out first: each window (string of WINDOW bytes) belongs to its leftmost smallest k-gram by hash, its
anchor, which depends on the window's bytes alone. Equal windows have equal anchors, so windows whose
anchor nothing else has need no sorting. A run of windows with one anchor is an instance; its context
is the bytes that its windows cover. Hashes only deal out and group; what is removed was found equal
by the sorter, byte for byte.

1. Instances (anchor, hash of the context, document, place) are range-partitioned and sorted. In a
   stream, instances with an anchor of their own go; the others ask for their bytes. The range
   includes document and place, so a passage of a third of all documents spreads out; what a
   partition's edge hides asks in any case. A context that is met very often in a partition sends all
   instances but the first in chunks, each with a copy of that one.
2. Tasks sort the contexts of whole anchors, and then the suffixes of those that differ, by
   deep-shallow sorting: multikey quicksort on words of eight bytes to SHALLOW bytes, then blind tries
   for the groups whose common prefix is longer. In the suffix array that results, a suffix that
   agrees with its neighbour in WINDOW bytes is a repeat; of each run of such the first by document
   and place stays.
3. An anchor with very many instances (the edge of a passage that is everywhere) is split by context;
   its parts name the first of each window, and these meet again by a hash of the window.

Null texts are empty. Windows never cross documents. A null doc_id counts as smaller than any other;
of rows with one doc_id, the text with the smaller hash comes first, and equal rows come out alike.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samefold.llm.common import arrow_map, documents, small_batches, staged, utf8
from samefold.llm.linededup import keyed
from samefold.storage import discard

WINDOW = 100
GRAM = 32
SHALLOW = 64
SPREAD = WINDOW - GRAM + 1
#: Contexts that are sorted at once, at least; of one anchor and part, at most about HOT. Instances of
#: one context and partition beyond this go in chunks of this size.
BLOCK, HOT, CHUNKED = 4_096, 8_192, 1_024
#: Documents for each range whose anchors give the bounds of ranges, and the largest number of those.
SAMPLE, MOST_PARTS = 20, 200_000
#: Hot anchors (two numbers each) that may be broadcast.
MOST_HOT = 200_000
#: Contexts of split anchors for each bucket in which their windows meet.
BUCKET = 1 << 15
#: Bytes of a text that are hashed at once.
CHUNK = 1 << 22

_rng = np.random.default_rng(77_007)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ODD = _rng.integers(1, 1 << 63, 5, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the anchor, first and last window of each instance."""
    x = _BYTE[np.frombuffer(data, np.uint8)]
    step = 1
    for odd in _ODD:  # hashes of 2, 4, ..., GRAM bytes
        x = x[:-step] * odd + x[step:]
        step *= 2
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    least, width = x, 1
    while 2 * width <= SPREAD:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if SPREAD > width:
        least = np.minimum(least[: width - SPREAD], least[SPREAD - width :])
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    last = np.concatenate((first[1:] - 1, [len(least) - 1]))
    view = np.lib.stride_tricks.sliding_window_view(x, SPREAD)
    out = []
    while len(first):  # again only where one hash stands at several places of a window
        at = np.concatenate([first[k : k + 8192] + view[first[k : k + 8192]].argmin(axis=1) for k in range(0, len(first), 8192)])
        out.append((x[at], first, np.minimum(last, at)))
        more = last > at
        first, last = at[more] + 1, last[more]
    return tuple(np.concatenate(p) for p in zip(*out, strict=True))


def instances(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, hash of the context, first window, windows less one, of each instance of a text."""
    parts = []
    for at in range(0, len(data) - WINDOW + 1, CHUNK):
        piece = data[at : at + CHUNK + WINDOW - 1]
        a, first, last = _anchors(piece)
        digest = xxhash.xxh3_64_intdigest
        c = np.array([digest(piece[i : j + WINDOW]) for i, j in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
        parts.append((a, c, first + at, last - first))
    if not parts:
        return (np.empty(0, np.uint64), np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64))
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


#: place: 15 bits of the text's hash, first window (40 bits), windows less one (8 bits).
def _place(tag: int, first, more):
    return (tag << 48) | (first << 8) | more


def _first(place):
    return (place >> 8) & ((1 << 40) - 1)


_INSTANCE = "a long, c long, ord long, place long"


def instance_rows(docs: DataFrame) -> DataFrame:
    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        cols = [[], [], [], []]
        for o, th, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            a, c, first, more = instances(utf8(text))
            if len(a):
                for col, x in zip(cols, (a.view(np.int64), c.view(np.int64), np.full(len(a), o, np.int64), _place(th & 0x7FFF, first, more)), strict=True):
                    col.append(x)
        if not cols[0]:
            return None
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], ["a", "c", "ord", "place"])

    return arrow_map(keyed(docs).select("__ord", "__th", "text"), _INSTANCE, one)


_ASKED = _INSTANCE + ", chunk long"


def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over instances sorted by (a, c, ord, place): those that share their anchor, or may at the
    partition's edges. chunk: 0, or the number of the chunk that the instance goes to."""
    edge = None  # the partition's first anchor
    held = None  # rows of the last anchor, which may go on in the next batch
    run, base = 0, TaskContext.get().partitionId() << 42
    spent = (None, 0)  # the last context of rows sent already, and how many of them it has had
    for batch in batches:
        rows = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(4)], axis=1)
        if edge is None:
            edge = rows[0, 0]
        if held is not None:
            rows = np.concatenate((held, rows))
        cut = int(np.searchsorted(rows[:, 0], rows[-1, 0], "left"))
        if cut == 0 and len(rows) >= 4 * CHUNKED:
            cut = len(rows) - 2  # an anchor with very many instances: all but the last two go on
        done, held = rows[:cut], rows[cut:]
        if len(done):
            out, run, spent = _shared(done, edge, held[0], run, base, spent)
            if out is not None:
                yield out
    if held is not None:
        out, _, _ = _shared(held, edge, held[0], run, base, spent)  # the partition's last anchor
        if out is not None:
            yield out


def _shared(rows: np.ndarray, edge: int, following: np.ndarray, run: int, base: int, spent: tuple):
    first_of = np.ones(len(rows), bool)
    first_of[1:] = rows[1:, 0] != rows[:-1, 0]
    size = np.diff(np.append(np.flatnonzero(first_of), len(rows)))[np.cumsum(first_of) - 1]
    keep = (size > 1) | (rows[:, 0] == edge) | (rows[:, 0] == following[0])
    if spent[0] is not None:
        keep |= rows[:, 0] == spent[0][0]
    rows = rows[keep]
    if not len(rows):
        return None, run, spent
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(axis=1)
    had = 0
    if spent[0] is not None and (rows[0, :2] == spent[0][:2]).all():
        new[0], had = False, spent[1]
    starts = np.flatnonzero(new)
    of = np.cumsum(new) - 1  # each row's context; -1: that of the batch before
    at = np.arange(len(rows)) - np.where(of >= 0, starts[np.maximum(of, 0)] if len(starts) else 0, -had)
    lead = rows[starts[np.maximum(of, 0)]] if len(starts) else np.repeat(spent[0][None, :], len(rows), axis=0)
    if had:
        lead[of < 0] = spent[0]
    number = run + of + 1
    count = np.diff(np.append(starts, len(rows)))
    size = np.where(of >= 0, count[np.maximum(of, 0)] if len(starts) else 0, had + (int(starts[0]) if len(starts) else len(rows)))
    chunk = np.where((size > CHUNKED) & (at > 0), base | number << 20 | 1 + at // CHUNKED, 0)
    opens = chunk[1:] != chunk[:-1]
    opens = np.flatnonzero((chunk != 0) & np.concatenate(([True], opens)))
    copies, copied = lead[opens], chunk[opens]
    out = np.concatenate((rows, copies))
    cols = [pa.array(np.ascontiguousarray(out[:, k])) for k in range(4)]
    last = starts[-1] if len(starts) else None
    spent = (rows[last].copy(), len(rows) - int(last)) if last is not None else (spent[0], had + len(rows))
    return pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate((chunk, copied)))], ["a", "c", "ord", "place", "chunk"]), run + len(starts), spent


# ---- deep-shallow sorting


class BlindTrie:
    """Orders strings of one length that share a prefix: nodes know a depth and a branch for each
    byte there; the bytes between are looked up in one leaf when a string is put in."""

    def __init__(self, size: int):
        self.size, self.root = size, None

    def put(self, text: bytes, who: int) -> None:
        if self.root is None:
            self.root = [self.size, {}, [who], text]
            return
        node, path = self.root, []
        while node[0] < self.size:  # down blindly
            path.append(node)
            node = node[1].get(text[node[0]]) or next(iter(node[1].values()))
        other = node[3]
        if other == text:
            node[2].append(who)
            return
        lcp = 0
        while text[lcp] == other[lcp]:
            lcp += 1
        leaf = [self.size, {}, [who], text]
        above = None
        for p in path:  # up to where it parts
            if p[0] >= lcp:
                break
            above = p
        below = self.root if above is None else above[1][text[above[0]]]
        if below[0] == lcp:
            below[1][text[lcp]] = leaf
            return
        split = [lcp, {other[lcp]: below, text[lcp]: leaf}, None, None]
        if above is None:
            self.root = split
        else:
            above[1][text[above[0]]] = split

    def leaves(self) -> Iterator[list[int]]:
        """In the order of the strings."""
        todo = [self.root] if self.root else []
        while todo:
            node = todo.pop()
            if node[0] == self.size:
                yield node[2]
            else:
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]


def multikey_quicksort(words: np.ndarray, starts: np.ndarray, group: np.ndarray, shallow: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """The strings at `starts` in the order of (group, first `shallow` bytes), and the segments of that
    order that agree in all of them. words: the eight bytes from each place on, as a number.

    Each round takes every unfinished segment, a pivot word for each (the median of three), and
    parts the segment into smaller, equal and larger ones; equal ones go on eight bytes deeper."""
    order = np.argsort(group, kind="stable")
    dealt = group[order]
    lo = np.concatenate(([0], np.flatnonzero(dealt[1:] != dealt[:-1]) + 1)) if len(order) else np.empty(0, np.int64)
    size = np.diff(np.append(lo, len(order)))
    depth = np.zeros(len(lo), np.int64)
    live = size > 1
    lo, size, depth = lo[live], size[live], depth[live]
    deep: list[tuple[int, int]] = []
    while len(lo):
        off = np.cumsum(size) - size
        of = np.repeat(np.arange(len(lo)), size)
        place = np.arange(len(of)) + (lo - off)[of]
        who = order[place]
        key = words[starts[who] + depth[of]].astype(np.uint64)
        a, b, c = key[off], key[off + size // 2], key[off + size - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[of]
        less, equal = key < pivot, key == pivot
        more = ~(less | equal)
        n_less, n_equal = np.add.reduceat(less, off, dtype=np.int64), np.add.reduceat(equal, off, dtype=np.int64)

        def rank(part: np.ndarray, off=off, of=of) -> np.ndarray:
            before = np.cumsum(part) - part
            return before - before[off][of]

        to = lo[of] + np.where(less, rank(less), np.where(equal, n_less[of] + rank(equal), (n_less + n_equal)[of] + rank(more)))
        order[to] = who
        finished = depth + 8 >= shallow
        tied = finished & (n_equal > 1)
        deep += zip((lo + n_less)[tied].tolist(), n_equal[tied].tolist(), strict=True)
        n_more = size - n_less - n_equal
        lo, size, depth = (
            np.concatenate((lo, (lo + n_less)[~finished], lo + n_less + n_equal)),
            np.concatenate((n_less, n_equal[~finished], n_more)),
            np.concatenate((depth, depth[~finished] + 8, depth)),
        )
        live = size > 1
        lo, size, depth = lo[live], size[live], depth[live]
    return order, deep


def deep_shallow(buffer: bytes, starts: np.ndarray, sizes: np.ndarray, group: np.ndarray, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """The strings in order within their groups, and whether each equals the one before it. Strings of a
    group have one size, `shallow` at least."""
    padded = np.frombuffer(buffer + b"\0" * 8, np.uint8)
    words = np.ndarray((len(padded) - 7,), ">u8", padded.data, 0, (1,))
    order, deep = multikey_quicksort(words, starts, group, shallow)
    same = np.zeros(len(order), bool)
    for lo, n in deep:
        who = order[lo : lo + n].tolist()
        size = int(sizes[who[0]])
        trie = BlindTrie(size - shallow)
        for k in who:
            at = int(starts[k])
            trie.put(buffer[at + shallow : at + size], k)
        at = lo
        for leaf in trie.leaves():
            order[at : at + len(leaf)] = leaf
            same[at + 1 : at + len(leaf)] = True
            at += len(leaf)
    return order, same


def repeats(order: np.ndarray, same: np.ndarray, *rank: np.ndarray) -> np.ndarray:
    """Of each run of equal strings all but the least by rank (the last array counts most)."""
    run = np.cumsum(~same)
    tied = same.copy()
    tied[:-1] |= same[1:]
    who, run = order[tied], run[tied]
    by = np.lexsort((*(r[who] for r in rank), run))
    who, run = who[by], run[by]
    return who[np.concatenate(([False], run[1:] == run[:-1]))] if len(who) else who


_CUT = "ord long, tag int, start long, stop long, bucket long, packed binary"


_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())


def _cuts(ords, tags, starts, stops, buckets=None, packs=None) -> pa.RecordBatch:
    none = [None] * len(ords)
    cols = (ords, np.asarray(tags, np.int32), starts, stops, none if buckets is None else buckets, none if packs is None else packs)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES, strict=True)], [c.split()[0] for c in _CUT.split(", ")])


def sort_block(keys: np.ndarray, base: np.ndarray, size: np.ndarray, buffer: bytes, buckets: int) -> Iterator[pa.RecordBatch]:
    """Of contexts (a, salt, salts, ord, place), whole groups (a, salt), whose bytes lie in the buffer: what
    to cut, and for split anchors the first of each window, packed by bucket. A chunk (salt under 0) has
    its first instance with it; the windows of a context that differs from that one stay."""
    new = np.concatenate(([True], (keys[1:, :2] != keys[:-1, :2]).any(axis=1)))
    group = np.cumsum(new)
    ords, places = keys[:, 3], keys[:, 4]
    tags, low = places >> 48, _first(places)
    order, same = deep_shallow(buffer, base, size, group * 512 + size)  # a context has under 512 bytes
    whole = np.zeros(len(keys), bool)
    whole[repeats(order, same, low, tags, ords)] = True
    # a copy of one instance (of a chunk's first one, or of a repeated row) isn't a repeat of it
    copy = ~new
    copy[1:] &= (keys[1:, 3:] == keys[:-1, 3:]).all(axis=1)
    if len(cut := np.flatnonzero(whole & ~copy)):
        yield _cuts(ords[cut], tags[cut], low[cut], low[cut] + size[cut])
    kept = np.flatnonzero(~whole & (keys[:, 1] >= 0))
    if not len(kept):
        return
    n = size[kept] - WINDOW + 1
    owner = np.repeat(kept, n)
    shift = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    starts, at = base[owner] + shift, low[owner] + shift
    order, same = deep_shallow(buffer, starts, np.full(len(starts), WINDOW), group[owner])
    gone = np.zeros(len(starts), bool)
    gone[repeats(order, same, at, tags[owner], ords[owner])] = True
    edge = np.flatnonzero(np.concatenate(([True], (gone[1:] != gone[:-1]) | (shift[1:] == 0), [True])))
    runs = gone[edge[:-1]]
    if runs.any():
        first, last = edge[:-1][runs], edge[1:][runs] - 1
        k = owner[first]
        yield _cuts(ords[k], tags[k], at[first], at[last] + WINDOW)
    named = np.flatnonzero(~gone & (keys[owner, 2] > 1))
    if len(named):
        h = np.frombuffer(b"".join(xxhash.xxh3_128_digest(buffer[x : x + WINDOW]) for x in starts[named].tolist()), np.uint64).reshape(-1, 2)
        o = owner[named]
        table = np.stack([h[:, 0].view(np.int64), h[:, 1].view(np.int64), ords[o], tags[o], at[named]], axis=1)
        bucket = (h[:, 0] % np.uint64(buckets)).astype(np.int64)
        by = np.argsort(bucket, kind="stable")
        bucket, table = bucket[by], table[by]
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
        packs = [table[x:y].tobytes() for x, y in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        zero = np.zeros(len(packs), np.int64)
        yield _cuts(zero, zero, zero, zero, bucket[edge[:-1]], packs)


def sort_blocks(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Over contexts sorted by (a, salt, ord, place): blocks end between groups (a, salt)."""
    keys, size, parts = np.empty((0, 5), np.int64), np.empty(0, np.int64), []
    for batch in batches:
        text = batch.column(5)
        ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
        keys = np.concatenate((keys, np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(5)], axis=1)))
        size = np.concatenate((size, np.diff(ends)))
        parts.append(text.buffers()[2].slice(int(ends[0]), int(ends[-1] - ends[0])).to_pybytes())
        if len(keys) >= BLOCK:
            shut = np.flatnonzero((keys[1:, :2] != keys[:-1, :2]).any(axis=1))
            if len(shut):
                cut = int(shut[-1]) + 1
                buffer, base = b"".join(parts), np.cumsum(size) - size
                yield from sort_block(keys[:cut], base[:cut], size[:cut], buffer, buckets)
                parts, keys, size = [buffer[int(base[cut]) :]], keys[cut:], size[cut:]
    if len(keys):
        yield from sort_block(keys, np.cumsum(size) - size, size, b"".join(parts), buckets)


def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over packed first windows sorted by bucket: all but the first of equal ones are cut."""

    def shut(parts: list[bytes]) -> pa.RecordBatch | None:
        t = np.concatenate([np.frombuffer(p, np.int64).reshape(-1, 5) for p in parts])
        t = t[np.lexsort((t[:, 4], t[:, 3], t[:, 2], t[:, 1], t[:, 0]))]
        again = np.concatenate(([False], (t[1:, :2] == t[:-1, :2]).all(axis=1)))
        t = t[again]
        return _cuts(t[:, 2], t[:, 3], t[:, 4], t[:, 4] + WINDOW) if len(t) else None

    bucket, parts = None, []
    for batch in batches:
        for b, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if b != bucket and parts:
                if (out := shut(parts)) is not None:
                    yield out
                parts = []
            bucket = b
            parts.append(p)
    if parts and (out := shut(parts)) is not None:
        yield out


def dealt(docs: DataFrame, order: list[str]) -> DataFrame:
    """The instances of docs in ranges of `order`, whose bounds a bounded sample of documents gives.
    repartitionByRange() would make all rows a second time for its own sample. Where the bounds lie
    changes only the sizes of partitions."""
    spark, rows = docs.sparkSession, instance_rows(docs)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_PARTS, 2 * rows.rdd.getNumPartitions()))
    n = docs.count()
    sample = rows if n <= SAMPLE * parts else instance_rows(docs.sample(SAMPLE * parts / n, seed=1))
    tiles = [c for c in sample.select(*order).repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct(*order)).alias("m")).orderBy("p").collect()]
    edges = np.array([list(t.m) for t in tiles[1:]], np.int64).reshape(-1, len(order))  # a bound for each partition
    sent = spark.sparkContext.broadcast(edges)  # MOST_PARTS rows at most
    state: dict[str, list[tuple]] = {}

    def number(batch: pa.RecordBatch) -> pa.RecordBatch:
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(len(order))]
        bounds = sent.value
        whole = state.get("whole") or state.setdefault("whole", list(map(tuple, bounds.tolist())))
        lo = np.searchsorted(bounds[:, 0], cols[0], "left")
        p = np.searchsorted(bounds[:, 0], cols[0], "right")
        for i in np.flatnonzero(lo < p).tolist():  # an anchor that is a bound itself: by the whole key
            p[i] = bisect_right(whole, tuple(int(c[i]) for c in cols), int(lo[i]), int(p[i]))
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(p.astype(np.int32))], [*order, "p"])

    numbered = arrow_map(rows, _INSTANCE + ", p int", number)
    return numbered.repartitionById(parts, "p").drop("p")


def cuts(docs: DataFrame) -> DataFrame:
    """ord, tag, start, stop: byte ranges to remove, overlapping ones too."""
    small_batches(docs.sparkSession)
    order = ["a", "c", "ord", "place"]
    rows = dealt(docs, order).sortWithinPartitions(*order)
    step = staged(rows.mapInArrow(sift, _ASKED), "instances")
    single = step.where("chunk = 0")
    hot = single.groupBy("a").count().where(F.col("count") > HOT).select("a", F.ceil(F.col("count") / HOT).cast("long").alias("salts"))
    hot = staged(hot, "hot-anchors")
    n, salts = hot.agg(F.count(F.lit(1)), F.coalesce(F.sum("salts"), F.lit(0))).first()
    buckets = max(1, -(-salts * HOT // BUCKET))
    salt = F.when(F.col("salts") > 1, F.pmod(F.xxhash64("c"), "salts")).otherwise(F.lit(0).cast("long"))
    # an anchor is hot from HOT rows on, so these are few; beyond MOST_HOT they are joined by a shuffle
    asked = single.join(F.broadcast(hot) if n <= MOST_HOT else hot.hint("shuffle_hash"), "a", "left").withColumn("salts", F.coalesce("salts", F.lit(1).cast("long"))).select("a", salt.alias("salt"), "salts", "ord", "place")
    asked = asked.unionByName(step.where("chunk <> 0").select("a", (-F.col("chunk")).alias("salt"), F.lit(1).cast("long").alias("salts"), "ord", "place"))
    asked = asked.groupBy("ord", F.shiftright("place", 48).cast("int").alias("tag")).agg(F.collect_list(F.struct("a", "salt", "salts", "place")).alias("asked"))

    def fetch(batch: pa.RecordBatch) -> pa.RecordBatch:
        lists = batch.column(1)
        n = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        a, salt, salts, place = (flat.field(k) for k in range(4))
        at = place.to_numpy(zero_copy_only=False)
        lo, hi = _first(at), _first(at) + (at & 255) + WINDOW
        parts, k = [], 0
        for text, m in zip(batch.column(2).to_pylist(), n.tolist(), strict=True):
            data = utf8(text)
            parts += [data[x:y] for x, y in zip(lo[k : k + m].tolist(), hi[k : k + m].tolist(), strict=True)]
            k += m
        ords = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), n)
        return pa.RecordBatch.from_arrays([a, salt, salts, pa.array(ords), place, pa.array(parts, pa.binary())], ["a", "salt", "salts", "ord", "place", "bytes"])

    with_text = tagged(docs).join(asked.hint("shuffle_hash"), ["ord", "tag"]).select("ord", "asked", "text")
    contexts = arrow_map(with_text, "a long, salt long, salts long, ord long, place long, bytes binary", fetch)
    placed = contexts.repartition("a", "salt").sortWithinPartitions("a", "salt", "ord", "place")
    found = staged(placed.mapInArrow(lambda b: sort_blocks(b, buckets), _CUT), "sorted")
    discard(step)
    discard(hot)
    packed = found.where(F.col("packed").isNotNull()).select("bucket", "packed").repartition("bucket").sortWithinPartitions("bucket")
    settled = packed.mapInArrow(settle, _CUT)
    pick = ["ord", "tag", "start", "stop"]
    return found.where(F.col("packed").isNull()).select(*pick).unionByName(settled.select(*pick))


def tagged(docs: DataFrame) -> DataFrame:
    return keyed(docs).withColumn("tag", F.col("__th").bitwiseAND(F.lit(0x7FFF).cast("long")).cast("int")).withColumnRenamed("__ord", "ord").drop("__th")


def united(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    ranges = cuts(docs).groupBy("ord", "tag").agg(F.collect_list("start").alias("starts"), F.collect_list("stop").alias("stops"))
    found = tagged(docs).join(ranges.hint("shuffle_hash"), ["ord", "tag"], "left").select("doc_id", "text", "starts", "stops")

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, starts, stops in zip(*(batch.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
            data, spans = utf8(text), united(list(zip(starts or [], stops or [], strict=True)))
            kept, at = hashlib.sha256(), 0
            for a, b in spans:
                kept.update(data[at:a])
                at = b
            kept.update(data[at:])
            rows.append((len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest()))
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return arrow_map(found, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", one)


SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS t FROM documents),
w AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_slice(t, i + 1, i + 100) ORDER BY doc_id, i) AS k FROM (
  SELECT doc_id, t, unnest(range(0, greatest(octet_length(t) - 99, 0))) AS i FROM d)),
g AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100, true) AS fresh FROM w WHERE k > 1),
n AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
r AS (SELECT doc_id, run, min(i) AS a, max(i) + 100 AS b FROM n GROUP BY ALL),
e AS (SELECT doc_id, b AS a, lead(a, 1) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM r UNION ALL SELECT doc_id, 0, min(a) FROM r GROUP BY doc_id),
k AS (SELECT doc_id, string_agg(hex(array_slice(t, a + 1, coalesce(b, octet_length(t)))), '' ORDER BY a) AS h FROM e JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT doc_id, octet_length(t)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans,
  sha256(CASE WHEN h IS NULL THEN t ELSE unhex(h) END) AS kept_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""
