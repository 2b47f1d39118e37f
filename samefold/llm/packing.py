"""Best-fit packing by bin completion.

Pieces of one length are interchangeable, so packing needs only how many pieces have each length:
at most `size` numbers, whatever the corpus. The driver packs that histogram. Around the largest
length left, bin completion enumerates fillings of the rest of the bin, drops those that another one
dominates (its lengths hold the other's lengths, each in one of them), and takes the rest with the
least waste first, as often as the counts allow and then once. Branch and bound backs up to other
fillings while the bins used and the waste bound of what is left don't rule them out. The
best-fit-decreasing packing is the first incumbent. The result is a list of patterns, each with a
number of copies.

The pieces never meet in one place: each has a number among its length's pieces of its task, tasks'
counts give it a rank among all pieces of its length, and the rank alone tells its pattern, copy and
offset. The search effort bounds the driver's time, never the input: `NODES` nodes and `PER_LENGTH`
more for each length that occurs, so that many dives end; at a node, `WIDTH` fillings out of `STEPS`
steps. A search that ends early keeps the best packing met; the columns n_sequences and
least_sequences (no packing has fewer) tell how far from proven it is.

Null and empty texts are one piece that holds the closing id. With no rows there are no sequences.
Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from samefold.llm.common import arrow_map, documents, small_batches, staged
from samefold.llm.tokens import Coder

SIZE = 2048
#: Nodes of the search: so many, and so many more for each length that occurs.
NODES, PER_LENGTH = 4_000, 6
#: Fillings tried at a node, and steps of the search for them.
WIDTH, STEPS = 4, 800


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


# ---- the packing of a histogram


def lower_bound(counts: np.ndarray, size: int) -> int:
    """No packing has fewer bins: for each a, what is over half must be apart, and lengths from a to
    half a bin only get what room those leave that pair with lengths of a and more; and for each k,
    with k + 1 lengths of over 1 / (k + 1) of a bin never together, a length x weighs
    floor((k + 1) x / size) / k, or x / size where that division leaves nothing."""
    n = np.arange(len(counts))
    best = -(-int((counts * n).sum()) // size)
    cum_n, cum_s = np.concatenate(([0], np.cumsum(counts))), np.concatenate(([0], np.cumsum(counts * n)))
    half = size // 2
    for a in range(1, half + 1):
        top = int(cum_n[-1] - cum_n[size - a + 1])
        mid_n, mid_s = int(cum_n[size - a + 1] - cum_n[half + 1]), int(cum_s[size - a + 1] - cum_s[half + 1])
        small = int(cum_s[half + 1] - cum_s[a])
        best = max(best, top + mid_n + max(0, -(-(small - (mid_n * size - mid_s)) // size)))
    for k in range(1, 33):
        whole, rest = np.divmod((k + 1) * n, size)
        weight = np.where(rest == 0, n * k, whole * size)  # times k * size
        best = max(best, -(-int((counts * weight).sum()) // (k * size)))
    return best


def dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether b's lengths fit into a's lengths, each whole in one of them."""
    if sum(b) > sum(a) or not b:
        return not b
    room, todo = sorted(a, reverse=True), sorted(b, reverse=True)
    if todo[0] > room[0]:
        return False

    def put(k: int) -> bool:
        if k == len(todo):
            return True
        tried = set()
        for j, r in enumerate(room):
            if todo[k] <= r and r not in tried:
                tried.add(r)
                room[j] -= todo[k]
                if put(k + 1):
                    return True
                room[j] += todo[k]
        return False

    return put(0) if len(todo) <= 8 else tuple(a) == tuple(b)  # a long filling counts as undominated


def best_fit(counts: np.ndarray, size: int) -> list[tuple[int, tuple[int, ...]]]:
    """Best-fit decreasing on the histogram: patterns (copies, lengths)."""
    room: dict[int, dict[tuple[int, ...], int]] = {}  # room left -> patterns open with it
    rooms: list[int] = []

    def put(space: int, pattern: tuple[int, ...], copies: int) -> None:
        if space not in room:
            rooms.insert(bisect_right(rooms, space), space)
            room[space] = {}
        room[space][pattern] = room[space].get(pattern, 0) + copies

    for length in range(len(counts) - 1, 0, -1):
        left = int(counts[length])
        while left:
            k = bisect_right(rooms, length - 1)
            if k == len(rooms):  # new bins, filled with as many as they hold
                per = size // length
                full, more = divmod(left, per)
                if full:
                    put(size - per * length, (length,) * per, full)
                if more:
                    put(size - more * length, (length,) * more, 1)
                break
            space = rooms[k]
            pattern, open_ = next(iter(room[space].items()))
            use = min(open_, left)
            room[space].pop(pattern)
            if open_ > use:
                room[space][pattern] = open_ - use
            if not room[space]:
                del room[space]
                rooms.pop(k)
            put(space - length, (*pattern, length), use)
            left -= use
    return [(n, p) for ps in room.values() for p, n in ps.items()]


def fillings(rest: int, counts: np.ndarray, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated fillings of `rest` among those the search meets, least waste first. Lengths fall
    within a filling, and larger lengths come first."""
    found: list[tuple[int, tuple[int, ...]]] = []
    if rest > 0 and rest < len(counts) and counts[rest]:
        found.append((0, (rest,)))
    lengths = np.flatnonzero(counts[: rest + 1])[::-1]
    if len(found) < width and len(lengths):
        other = rest - lengths
        ok = (other > 0) & (other <= lengths) & (counts[other] > (other == lengths))
        found += [(0, (int(a), rest - int(a))) for a in lengths[ok][: width - len(found)]]
    if len(found) < width:
        avail = [int(x) for x in lengths]
        steps, used, best = 0, Counter(), [rest + 1]

        def search(left: int, at: int, chosen: tuple[int, ...]) -> bool:
            """True once enough perfect fillings are known or the effort is spent."""
            nonlocal steps
            grew = False
            while at < len(avail):
                a = avail[at]
                if a <= left and used[a] < counts[a]:
                    steps += 1
                    if steps > STEPS:
                        break
                    used[a] += 1
                    grew = True
                    stop = search(left - a, at, (*chosen, a))
                    used[a] -= 1
                    if stop:
                        return True
                at += 1
            if not grew and left < best[0] or not left and all(c != chosen for _, c in found):
                best[0] = min(best[0], left)
                found.append((left, chosen))
            return steps > STEPS or sum(w == 0 for w, _ in found) >= width

        search(rest, 0, ())
    found.sort(key=lambda f: f[0])
    kept: list[tuple[int, ...]] = []
    for c in dict.fromkeys(c for _, c in found):
        if not any(dominates(k, c) for k in kept):
            kept.append(c)
            if len(kept) == width:
                break
    return kept


def pack(histogram: dict[int, int], size: int = SIZE, nodes: int | None = None) -> list[tuple[int, tuple[int, ...]]]:
    """Patterns (copies, lengths) that hold every piece, in as few bins as the search can prove or find."""
    nodes = NODES + PER_LENGTH * len(histogram) if nodes is None else nodes
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    full = int(counts[size])
    counts[size] = 0
    done = [(full, (size,))] if full else []
    if not counts.any():
        return done
    floor = lower_bound(counts, size)
    incumbent = best_fit(counts, size)
    most = sum(n for n, _ in incumbent)
    weight = np.arange(size + 1)

    def grow(left: np.ndarray):
        """Children of a node: (copies, pattern), most promising first."""
        top = int(np.flatnonzero(left)[-1])
        left[top] -= 1
        fills, once = fillings(size - top, left), []
        left[top] += 1
        for fill in fills or [()]:
            pattern = (top, *fill)
            times = Counter(pattern)
            most_copies = min(int(left[a]) // k for a, k in times.items())
            yield most_copies, pattern
            if most_copies > 1:
                once.append(pattern)
        yield from ((1, pattern) for pattern in once)

    stack = [(counts.copy(), 0, grow(counts.copy()), None)]
    spent = 0
    while stack and most > floor and spent < nodes:
        left, used, children, _ = stack[-1]
        step = next(children, None)
        if step is None:
            stack.pop()
            continue
        spent += 1
        copies, pattern = step
        after = left.copy()
        for a in pattern:
            after[a] -= copies
        total = used + copies
        if total + -(-int((after * weight).sum()) // size) >= most:  # the waste bound
            continue
        if not after.any():
            most = total
            incumbent = [*(s[3] for s in stack[1:]), (copies, pattern)]
            continue
        stack.append((after, total, grow(after.copy()), (copies, pattern)))
    return [*done, *incumbent]


# ---- the pieces


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, seq long"


def pieces(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's number (part, seq) among those of its
    length. Only documents over `size` ids are cut; their first piece takes the remainder."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, part, seen = None, TaskContext.get().partitionId(), Counter()
        for batch in batches:
            coder = coder or Coder(path)
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = coder.encode(text) + b"\0\0\0\0"
                n, start, k = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - start) % size or size
                    rows.append((doc, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length]))
                    seen[length] += 1
                    start, k = start + length, k + 1
            if rows:
                cols = zip(*rows, strict=True)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], [c.split()[0] for c in _PIECES.split(", ")])

    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _PIECES)


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> dict[int, np.ndarray]:
    """For each length: rows (first rank, first sequence, pieces a sequence, first offset)."""
    taken, base = Counter(), 0
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    for copies, pattern in patterns:
        offset = 0
        for length, times in sorted(Counter(pattern).items(), reverse=True):
            out.setdefault(length, []).append((taken[length], base, times, offset))
            taken[length] += copies * times
            offset += length * times
        base += copies
    return {k: np.array(v, np.int64) for k, v in out.items()}


def least_bins(histogram: dict[int, int], size: int = SIZE) -> int:
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] += n
    full, counts[size] = int(counts[size]), 0
    return full + lower_bound(counts, size)


def pack_documents(docs: DataFrame, path: str | None = None, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset, n_sequences, least_sequences: one
    row for each piece; the last two are the same in all rows."""
    cut = staged(pieces(docs, path, size), "pieces")
    counts = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))  # counted twice from two columns, not written
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # <= size rows
    patterns = pack(histogram, size)
    place, used = slots(patterns), sum(n for n, _ in patterns)
    least = least_bins(histogram, size)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    # counts by (length, part) grow with the tasks, so neither side is broadcast
    ranked = cut.join(first.hint("shuffle_hash"), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("seq")).alias("rank"))

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        length, rank = (batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 5))
        sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            table, r = place[n], rank[at]
            row = table[np.searchsorted(table[:, 0], r, side="right") - 1]
            k = r - row[:, 0]
            sequence[at], offset[at] = row[:, 1] + k // row[:, 2], row[:, 3] + k % row[:, 2] * n
        return pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    out = arrow_map(ranked, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long", one)
    return out.withColumns({"n_sequences": F.lit(used).cast("long"), "least_sequences": F.lit(least).cast("long")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir))
