"""N-gram Jaccard join by a MinHash LSH forest.

1. Each text becomes the set of its five-word shingles, a fingerprint of the set, and a signature of
   `TREES` paths of `DEPTH` min-hashes. Texts with one set are copies: one of them goes on.
2. Each path is a leaf of its tree. Rows are range-partitioned and sorted by path, so a tree is a
   sorted array and a subtree is a run of rows with a common prefix. Matched prefixes start at the full
   depth and are shortened: for every row until a pair at the threshold meets in some tree with the
   chance RECALL (depth 4 of 5: 0.9998), and further where there are signs of pairs near the threshold.
   A subtree in which a similarity between NEAR[0] and NEAR[1] was estimated has its prefix shortened
   until that chance is NEAR_RECALL (depth 3: 0.99999); elsewhere pairs are far above the threshold,
   and surer to have met already, or below it.
3. A stream over a subtree keeps a few leaders. A row is linked to each leader whose signature isn't
   clearly too far for a partner of the row to be close to it, and becomes a leader if none is
   close. Of the near leaders, one of each component is linked, so a subtree of n rows gives fewer
   than n links, however many pairs it has. Where a prefix is shortened, the leaders of the subtrees
   below it meet in the same way. Subtrees that a partition's edge cuts are joined through their leaders.
4. Components of these links are verified exactly: all pairs within a component are compared by
   their shingle sets, in tiles of at most about two thousand texts, of which each task holds one.
   A tile returns each text's number of links and a spanning forest of them, never the pairs.
5. Components of the verified links are the classes.

Words: A-Z lower-cased, `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`. A text of one to four words has one
shingle, all its words. Null texts and texts without words have no shingles and are classes of
their own. A null doc_id counts as smaller than any other. Equal rows come out alike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from samefold.llm.common import arrow_map, documents, folded_words, packed, small_batches, staged, unpacked
from samefold.llm.graph import components
from samefold.llm.linededup import _LOWEST, keyed

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 16, 5
RECALL = 0.999
#: Estimated similarities (a threshold of 0.8, errors of 3 sigma below and 1 above) that shorten a prefix,
#: and the chance it is shortened to.
NEAR, NEAR_RECALL = (0.65, 0.85), 0.9999
#: A row with an estimate of TIGHT to a leader is no leader; it is linked to those of LOOSE and more.
#: With J(x, y) >= 0.8 and x at TIGHT to a leader, y is at 0.35 at least, errors of 3 sigma included.
TIGHT, LOOSE = 0.8, 0.35
#: Times that links are drawn in to a smaller leader before components are sought.
STAR_ROUNDS = 2
#: Texts and shingles in a block; a tile is two blocks.
BLOCK_TEXTS, BLOCK_SHINGLES = 1024, 2_000_000

_rng = np.random.default_rng(20_240_501)
_ODD = _rng.integers(1, 1 << 63, SHINGLE + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MUL = _rng.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word, 7)
        return h


_HASH = _WordHash()


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles."""
    words = folded_words(text)
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_HASH.__getitem__, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    m = len(words) - n + 1
    x = np.full(m, int(_ODD[SHINGLE]) * n & (1 << 64) - 1, np.uint64)
    for k in range(n):
        x += h[k : k + m] * _ODD[k]
    x ^= x >> np.uint64(31)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    return np.unique(x)


def signature(x: np.ndarray) -> np.ndarray:
    """Low 16 bits of TREES * DEPTH min-hashes of 32 bits."""
    best = np.full(TREES * DEPTH, 1 << 32, np.uint64)
    for at in range(0, len(x), 2048):
        h = (x[at : at + 2048, None] * _MUL + _ADD) >> np.uint64(32)
        best = np.minimum(best, h.min(axis=0))
    return (best & np.uint64(0xFFFF)).astype(np.uint16)


def prefix_depth(trees: int = TREES, depth: int = DEPTH, threshold: float = THRESHOLD, recall: float = RECALL, longest: int | None = None) -> int:
    """The longest prefix, shortened from `depth`, with which a pair at the threshold is found."""
    for k in range(min(depth, longest or depth), 0, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    raise ValueError(f"{trees} trees can't reach a recall of {recall} at {threshold}")


def signatures(docs: DataFrame) -> DataFrame:
    """ord, th, fp, n, sig for each text with shingles. fp names the set of shingles."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        rows, at = [], []
        for k, text in enumerate(batch.column(2).to_pylist()):
            x = shingles(text)
            if len(x):
                at.append(k)
                rows.append((hashlib.blake2b(x.tobytes(), digest_size=16).digest(), len(x), signature(x).tobytes()))
        if not rows:
            return None
        fp, n, sig = zip(*rows, strict=True)
        keep = pa.array(at, pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(fp, pa.binary()), pa.array(n, pa.int64()), pa.array(sig, pa.binary())], ["ord", "th", "fp", "n", "sig"])

    return arrow_map(keyed(docs).select("__ord", "__th", "text"), "ord long, th long, fp binary, n long, sig binary", one)


def leaves(reps: DataFrame, short: int, depth: int) -> DataFrame:
    """tree, path (the shortest prefix), child (the rest of the usual prefix), deep (the rest of the path),
    fp, bits (4 bits of each min-hash)."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, TREES, DEPTH)
        low = (sig.reshape(n, -1) & 15).astype(np.uint8)
        bits = (low[:, ::2] << 4 | low[:, 1::2]).tobytes()
        width = TREES * DEPTH // 2
        paths = sig[:, :, :short].astype(">u2").tobytes()
        child, deep = np.zeros((n, TREES), np.int64), np.zeros((n, TREES), np.int64)
        for k in range(short, depth):
            child = child << 16 | sig[:, :, k]
        for k in range(depth, DEPTH):
            deep = deep << 16 | sig[:, :, k]
        who = np.repeat(np.arange(n), TREES)
        fps = batch.column(0).take(pa.array(who))
        return pa.RecordBatch.from_arrays(
            [pa.array(np.tile(np.arange(TREES, dtype=np.int32), n)), pa.array([paths[2 * short * i : 2 * short * (i + 1)] for i in range(n * TREES)], pa.binary()),
             pa.array(child.ravel()), pa.array(deep.ravel()), fps, pa.array([bits[width * i : width * (i + 1)] for i in who.tolist()], pa.binary())],
            ["tree", "path", "child", "deep", "fp", "bits"],
        )

    return arrow_map(reps.select("fp", "sig"), "tree int, path binary, child long, deep long, fp binary, bits binary", one)


def _nibbles(bits: bytes) -> np.ndarray:
    b = np.frombuffer(bits, np.uint8)
    return np.concatenate((b >> 4, b & 15))


def _bits(sig: np.ndarray) -> bytes:
    half = len(sig) // 2
    return (sig[:half] << 4 | sig[half:]).tobytes()


class Leaders:
    """Of one subtree."""

    def __init__(self):
        self.fps: list[bytes] = []
        self.near: list[bool] = []  # of each leader: whether it, or a row close to it, may have partners near the threshold
        self.part: list[int] = []  # of each leader: a leader nearer the root of its component
        self.sigs = np.empty((8, TREES * DEPTH), np.uint8)

    def _root(self, k: int) -> int:
        while self.part[k] != k:
            self.part[k] = k = self.part[self.part[k]]
        return k

    def _estimates(self, sig: np.ndarray) -> np.ndarray:
        # a share of 1/16 of four-bit values agree by chance
        return ((self.sigs[: len(self.fps)] == sig).mean(axis=1) - 1 / 16) * (16 / 15)

    def _joined(self, ks: list[int]) -> list[int]:
        """One of each component of the given leaders, which are one component from now on."""
        roots = sorted({self._root(k) for k in ks})
        for k in roots[1:]:
            self.part[k] = roots[0]
        return roots

    def _lead(self, fp: bytes, sig: np.ndarray, near: bool, root: int | None) -> None:
        n = len(self.fps)
        if n == len(self.sigs):
            self.sigs = np.concatenate((self.sigs, np.empty_like(self.sigs)))
        self.sigs[n] = sig
        self.fps.append(fp)
        self.near.append(near)
        self.part.append(n if root is None else root)

    def meet(self, fp: bytes, sig: np.ndarray, tight: float, loose: float, near: bool = False) -> list[bytes]:
        """Leaders to link a row with, which may become one: of those near enough, one of each
        component, so the links of a subtree are a forest."""
        if not self.fps:
            self._lead(fp, sig, near, None)
            return []
        est = self._estimates(sig)
        between = np.flatnonzero((est >= NEAR[0]) & (est < NEAR[1])).tolist()
        for k in between:
            self.near[k] = True
        near = near or bool(between)
        roots = self._joined(np.flatnonzero(est >= loose).tolist())
        linked = [self.fps[k] for k in roots]
        if est.max() >= tight:
            self.near[int(est.argmax())] |= near
        else:
            self._lead(fp, sig, near, roots[0] if roots else None)
        return linked

    def gather(self, fp: bytes, sig: np.ndarray, near: bool, tight: float) -> list[bytes]:
        """A leader of a subtree below: linked with one that is close, else kept for shortened()."""
        est = self._estimates(sig) if self.fps else np.empty(0)
        if len(est) and est.max() >= tight:
            k = int(est.argmax())
            self.near[k] |= near
            return [self.fps[k]]
        self._lead(fp, sig, near, None)
        return []

    def shortened(self, loose: float) -> list[tuple[bytes, bytes]]:
        """Links of the gathered leaders that may have partners near the threshold with all that aren't
        clearly too far."""
        out = []
        for k in [k for k, near in enumerate(self.near) if near]:
            est = self._estimates(self.sigs[k])
            est[k] = 0
            own = self._root(k)
            others = [r for r in sorted({self._root(x) for x in np.flatnonzero(est >= loose).tolist()}) if r != own]
            out += [(self.fps[r], self.fps[k]) for r in others]
            self._joined([k, *others])
        return out


_LINKS = "a binary, b binary, tree int, path binary, child long, bits binary, near boolean"
_LEAVES = ["tree", "path", "child", "fp", "bits", "near"]


def _links(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.binary(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], [c.split()[0] for c in _LINKS.split(", ")])


def subtree_links(batches: Iterator[pa.RecordBatch], tight: float, loose: float, edges: bool) -> Iterator[pa.RecordBatch]:
    """Links (a, b) within the subtrees of sorted rows (tree, path, child, fp, bits, near). With edges,
    also, as rows without b, the leaders of the partition's first and last subtree of the usual prefix
    and (child -1) of the shortened one."""
    key = child = leaders = waiting = above = below = None
    first_child = first_key = True
    out: list[tuple] = []

    def told(group: Leaders, of: int) -> None:
        out.extend((fp, None, *key, of, _bits(sig), near) for fp, sig, near in zip(group.fps, group.sigs, group.near, strict=False))

    def link(pairs) -> None:
        out.extend((a, b, key[0], None, None, None, None) for a, b in pairs if a != b)

    def shut_child(final: bool) -> None:
        """The child's leaders go to the subtree above, once that has a second child."""
        nonlocal above, below, first_child
        group = leaders
        if group is None:
            group = Leaders()
            group.meet(waiting[0], _nibbles(waiting[1]), tight, loose, waiting[2])
        if edges and (first_child or final):
            told(group, child)
        first_child = False
        if below is None:
            below = group
            return
        if above is None:
            above = Leaders()
            for fp, sig, near in zip(below.fps, below.sigs, below.near, strict=False):
                link((x, fp) for x in above.gather(fp, sig, near, tight))
        for fp, sig, near in zip(group.fps, group.sigs, group.near, strict=False):
            link((x, fp) for x in above.gather(fp, sig, near, tight))

    def shut_key(final: bool) -> None:
        nonlocal above, below, first_key
        if above is not None:
            link(above.shortened(loose))
        if edges and (first_key or final):
            told(above or below, -1)
        above = below = None
        first_key = False

    for batch in batches:
        for tree, path, c, fp, bits, near in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            if (tree, path) != key or c != child:
                if key is not None and (tree, path) != key and below is None and leaders is None and not first_child:
                    above = below = None  # a row alone in its subtree, as most are
                elif key is not None:
                    shut_child(False)
                    if (tree, path) != key:
                        shut_key(False)
                key, child, leaders, waiting = (tree, path), c, None, (fp, bits, near)
                continue
            if leaders is None:  # most subtrees have one row, and then none is made
                leaders = Leaders()
                leaders.meet(waiting[0], _nibbles(waiting[1]), tight, loose, waiting[2])
                waiting = None
            link((x, fp) for x in leaders.meet(fp, _nibbles(bits), tight, loose, near))
        if len(out) > 4096:
            yield _links(out)
            out.clear()
    if key is not None:
        shut_child(True)
        shut_key(True)
    if out:
        yield _links(out)


def candidate_links(reps: DataFrame) -> DataFrame:
    """a, b: links whose components hold every pair that meets in a tree and may be close enough."""
    order = ["tree", "path", "child", "deep", "fp"]
    depth = prefix_depth()
    short = min(depth, prefix_depth(recall=NEAR_RECALL, longest=depth - 1))
    rows = leaves(reps, short, depth).withColumn("near", F.lit(False))
    sorted_rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*_LEAVES)
    found = staged(sorted_rows.mapInArrow(lambda b: subtree_links(b, TIGHT, LOOSE, True), _LINKS), "links")
    # leaders of subtrees at partition edges: few for each partition; x ~ leader ~ leader ~ y may be further apart
    ends = found.where("b IS NULL").select("tree", "path", "child", F.col("a").alias("fp"), "bits", "near")
    ends = ends.repartition("tree", "path").sortWithinPartitions("tree", "path", "child", "fp").select(*_LEAVES)
    across = ends.mapInArrow(lambda b: subtree_links(b, TIGHT, LOOSE / 2, False), _LINKS)
    links = found.where("b IS NOT NULL").select("a", "b").unionByName(across.select("a", "b"))
    # a row has a few leaders in each tree; it keeps its smallest one, which takes over its other links.
    # These lie between leaders and are drawn in the same way, so that leaves about one link for each row.
    kept = None
    for _ in range(STAR_ROUNDS):
        stars = staged(links.groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("leaders")), "stars")
        least = F.get("leaders", F.lit(0)).alias("a")
        one = stars.select(least, "b")
        kept = one if kept is None else kept.unionByName(one)
        links = stars.where(F.size("leaders") > 1).select(least, F.explode(F.slice("leaders", F.lit(2), F.size("leaders"))).alias("b")).distinct()
    return kept.unionByName(links)


# ---- exact verification


def intersections(xs: list[np.ndarray], ys: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of all intersections of sorted sets, without listing pairs of sets; ys None: xs again."""
    same = ys is None
    ys = xs if same else ys
    out = np.zeros((len(xs), len(ys)), np.float32)

    def flat(sets):
        values = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        return values[order], owner[order]

    (xv, xo), (yv, yo) = flat(xs), flat(ys)
    values, xa, xn = np.unique(xv, return_index=True, return_counts=True)
    ya, yb = np.searchsorted(yv, values, "left"), np.searchsorted(yv, values, "right")
    yn = yb - ya
    some = (yn > 0) & ((xn > 1) | (not same))
    rare = some & (xn * yn <= 256)
    at = np.flatnonzero(rare)
    step = max(1, 1_000_000 // 256)
    for k in range(0, len(at), step):  # a few places each: list the cells
        part = at[k : k + step]
        cells = xn[part] * yn[part]
        of = np.repeat(np.arange(len(part)), cells)
        place = np.arange(cells.sum()) - np.repeat(np.cumsum(cells) - cells, cells)
        i = xo[xa[part][of] + place // yn[part][of]]
        j = yo[ya[part][of] + place % yn[part][of]]
        out += np.bincount(i * len(ys) + j, minlength=out.size).reshape(out.shape)
    at = np.flatnonzero(some & ~rare)
    for k in range(0, len(at), 2048):  # many places each: a product of 0/1 matrices
        part = at[k : k + 2048]
        mats = []
        for start, n, owner, size in ((xa, xn, xo, len(xs)), (ya, yn, yo, len(ys))):
            m = np.zeros((size, len(part)), np.float32)
            count = n[part]
            col = np.repeat(np.arange(len(part)), count)
            m[owner[np.repeat(start[part], count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)], col] = 1
            mats.append(m)
        out += mats[0] @ mats[1].T
    return out


def close_pairs(xs: list[np.ndarray], ys: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    inter = intersections(xs, ys)
    nx, ny = np.array([len(x) for x in xs], np.float32), np.array([len(y) for y in (xs if ys is None else ys)], np.float32)
    close = inter >= threshold * (nx[:, None] + ny[None, :] - inter) - 1e-3
    # float32 holds these counts exactly; the last step is repeated in whole numbers where it is tight
    i, j = np.nonzero(close)
    k = inter[i, j].astype(np.int64)
    ok = k >= threshold * (nx[i].astype(np.int64) + ny[j].astype(np.int64) - k) - 1e-9
    close[i[~ok], j[~ok]] = False
    if ys is None:
        np.fill_diagonal(close, False)
    return close


def verified(fps: list[bytes], sets: list[np.ndarray], blocks: list[int], threshold: float) -> tuple[np.ndarray, list[int]]:
    """Of a tile of one or two blocks: each text's links, and a root for each text."""
    n = len(fps)
    first = [k for k in range(n) if blocks[k] == blocks[0]]
    second = [k for k in range(n) if blocks[k] != blocks[0]]
    close = close_pairs([sets[k] for k in first], [sets[k] for k in second] if second else None, threshold)
    links, root = np.zeros(n, np.int64), list(range(n))
    other = second or first
    links[first] += close.sum(axis=1)
    if second:
        links[second] += close.sum(axis=0)
    todo, unseen = [], np.ones(n, bool)  # breadth-first over the matrix's rows and columns
    row = {k: i for i, k in enumerate(first)}
    col = {k: i for i, k in enumerate(other)}
    first_a, other_a = np.array(first), np.array(other)
    for start in range(n):
        if not unseen[start]:
            continue
        todo, unseen[start] = [start], False
        while todo:
            k = todo.pop()
            root[k] = start
            near = other_a[close[row[k]]] if k in row else first_a[close[:, col[k]]]
            fresh = near[unseen[near]]
            unseen[fresh] = False
            todo += fresh.tolist()
    return links, root


_TILE = "fp binary, root binary, n_links long, n_blocks int"


def tiles(members: DataFrame, threshold: float) -> DataFrame:
    """fp, root, n_links, n_blocks from members (label, block, n_blocks, fp, text)."""
    spread = members.select(
        "label", "n_blocks", "block", "fp", "text", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("o"),
    ).select("label", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "fp", "n_blocks", "text")
    order = ["label", "i", "j"]
    placed = spread.repartition(*order).sortWithinPartitions(*order, "block", "fp")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for b in batches:
            yield from zip(*(c.to_pylist() for c in b.columns), strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (_, i, j), tile in groupby(rows(batches), key=lambda r: r[:3]):
            fps, sets, blocks, parts = [], [], [], 1
            for *_, block, fp, parts, text in tile:
                if not fps or fp != fps[-1]:  # a repeated row
                    fps.append(fp)
                    sets.append(shingles(text))
                    blocks.append(block)
            if i != j and len(set(blocks)) < 2:
                continue
            links, root = verified(fps, sets, blocks, threshold)
            out += [(fp, fps[r], n, parts) for fp, r, n in zip(fps, root, links.tolist(), strict=True)]
            if len(out) > 2048:
                yield _tile(out)
                out = []
        if out:
            yield _tile(out)

    small_batches(members.sparkSession)
    return placed.mapInArrow(run, _TILE)


def _tile(out: list[tuple]) -> pa.RecordBatch:
    types = (pa.binary(), pa.binary(), pa.int64(), pa.int32())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], ["fp", "root", "n_links", "n_blocks"])


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """ord, th, fp, rep, n_copies, n_links, class_ord, class_th: one row for each distinct text and
    id with shingles. rep: the smallest id with the same set of shingles; n_links: other sets at the
    threshold or over; class_ord, class_th: the first row of the class."""
    docs = docs.select("doc_id", "text")
    small_batches(docs.sparkSession)
    sigs = staged(signatures(docs), "signatures")
    reps = staged(
        sigs.groupBy("fp").agg(F.min(F.struct("ord", "th")).alias("r"), F.count(F.lit(1)).alias("n_copies"), F.max("n").alias("n"), F.max("sig").alias("sig"))
        .select("fp", F.col("r.ord").alias("r_ord"), F.col("r.th").alias("r_th"), "n_copies", "n", "sig"), "representatives",
    )
    links = staged(candidate_links(reps), "candidates")
    comp = components(links)
    inside = comp.join(reps.select("fp", "r_ord", "r_th", "n"), comp.node == F.col("fp"))
    sizes = inside.groupBy("label").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("s"))
    sizes = sizes.select("label", F.ceil(F.greatest(F.col("k") / BLOCK_TEXTS, F.col("s") / BLOCK_SHINGLES)).cast("int").alias("n_blocks"))
    placed = inside.join(sizes, "label").select("label", "n_blocks", F.pmod(F.xxhash64("fp"), "n_blocks").cast("int").alias("block"), "fp", F.col("r_ord").alias("__ord"), F.col("r_th").alias("__th"))
    members = keyed(docs).select("__ord", "__th", "text").join(placed.hint("shuffle_hash"), ["__ord", "__th"]).drop("__ord", "__th")
    checked = staged(tiles(members, threshold), "tiles")
    n_links = checked.groupBy("fp").agg(F.sum("n_links").alias("n_links"))
    whole = checked.where("n_blocks = 1").select(F.col("fp").alias("node"), F.col("root").alias("label"))
    cut = checked.where("n_blocks > 1").select(F.col("fp").alias("a"), F.col("root").alias("b"))
    if not cut.isEmpty():
        over = components(cut)
        alone = cut.select(F.col("a").alias("node")).distinct().join(over, "node", "left_anti").select("node", F.col("node").alias("label"))
        whole = whole.unionByName(over).unionByName(alone)
    labelled = reps.join(whole.withColumnRenamed("node", "fp"), "fp", "left").join(n_links, "fp", "left")
    labelled = labelled.select("fp", "r_ord", "r_th", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("label", "fp").alias("label"))
    labelled = staged(labelled, "labelled")
    heads = labelled.groupBy("label").agg(F.min(F.struct("r_ord", "r_th")).alias("h")).select("label", F.col("h.r_ord").alias("class_ord"), F.col("h.r_th").alias("class_th"))
    table = labelled.join(heads, "label").select("fp", F.col("r_ord").alias("rep"), "n_copies", "n_links", "class_ord", "class_th")
    return sigs.select("ord", "th", "fp").join(table, "fp")


def _id(column: str):
    return F.when(F.col(column) != _LOWEST, F.col(column))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, copy_id, n_copies, n_links: one row for each row of docs."""
    found = classes(docs, threshold).drop("fp")
    out = keyed(docs).select(F.col("__ord").alias("ord"), F.col("__th").alias("th")).join(found.dropDuplicates(["ord", "th"]), ["ord", "th"], "left")
    none = F.col("rep").isNull()
    return out.select(
        _id("ord").alias("doc_id"), F.when(none, _id("ord")).otherwise(_id("class_ord")).alias("class_id"), F.when(none, _id("ord")).otherwise(_id("rep")).alias("copy_id"),
        F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one document of each class: that with the smallest id. Texts without shingles stay."""
    found = classes(docs, threshold)
    gone = found.where((F.col("ord") != F.col("class_ord")) | (F.col("th") != F.col("class_th"))).select(F.col("ord").alias("__ord"), F.col("th").alias("__th"), F.lit(True).alias("__gone")).distinct()
    kept = keyed(packed(docs)).join(gone.hint("shuffle_hash"), ["__ord", "__th"], "left").where("__gone IS NULL").drop("__gone")
    return unpacked(kept.dropDuplicates(["__ord", "__th"]), docs.columns)  # partitioned so already


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, list_slice(ws, i, i + least(len(ws), 5)::BIGINT - 1) AS g FROM (
  SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2)::BIGINT)) AS i FROM w WHERE len(ws) > 0)),
keys AS (SELECT doc_id, sha256(string_agg(array_to_string(g, ' '), chr(10) ORDER BY array_to_string(g, ' '))) AS k, count(*) AS n FROM s GROUP BY doc_id),
reps AS (SELECT k, min(doc_id) AS rep, count(*) AS copies, any_value(n) AS n FROM keys GROUP BY k),
rs AS (SELECT doc_id AS rep, g FROM s WHERE doc_id IN (SELECT rep FROM reps)),
common AS (SELECT a.rep AS a, b.rep AS b, count(*) AS c FROM rs a JOIN rs b ON a.g = b.g AND a.rep <> b.rep GROUP BY ALL),
links AS (SELECT common.a, common.b FROM common JOIN reps x ON x.rep = common.a JOIN reps y ON y.rep = common.b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach AS (SELECT rep AS a, rep AS b FROM reps UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
class AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
nl AS (SELECT a AS rep, count(*) AS n FROM links GROUP BY a)
SELECT d.doc_id, coalesce(class_id, d.doc_id)::BIGINT AS class_id, coalesce(r.rep, d.doc_id)::BIGINT AS copy_id, coalesce(copies, 1)::BIGINT AS n_copies, coalesce(nl.n, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN keys USING (doc_id) LEFT JOIN reps r USING (k) LEFT JOIN class c ON c.rep = r.rep LEFT JOIN nl ON nl.rep = r.rep
"""
