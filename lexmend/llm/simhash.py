"""SimHash near-duplicates: 64-bit fingerprints, linked at a small Hamming distance.

The search follows the generalised pigeonhole principle. Correlated bits share a part, because a
part of correlated bits takes few values and is a poor filter, which is better known to the
allocator than spread over all parts. If thresholds t_1..t_m of m parts add up to t - m + 1, two
fingerprints within distance t agree to within t_i on some part i (t_i = -1 leaves the part out).
A dynamic program chooses the thresholds with the fewest estimated candidates and probes, from
statistics over all distinct fingerprints; every candidate is verified on all 64 bits.

Equal fingerprints are one class before the search. Inside a bucket the search gives a spanning
forest of its links rather than all pairs, so a dense group of n texts makes n - 1 edges; buckets
above ``BLOCK`` are split into pairs of blocks. Components come from alternating large-star and
small-star rounds over edge tables in the shared folder.

Defined cases: a text without words (null too) has fingerprint zero, linked like any other.
Texts shorter than a shingle are one shingle; long ones are read whole, in blocks of words. Repeated
rows and null ids each get their row; the component id is the smallest id that isn't null, and null
where there is none. Bits that are set in exactly half of the hashes are 0. Empty tables give empty
results. Other columns, of any name, are not read; :func:`drop_near_copies` passes them on.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexmend.llm.arrow import slices
from lexmend.llm.common import drop_staged, staged, text_marks

BITS = 64
#: Bytes of a text whose words are held at once, and what ends them.
BLOCK_BYTES, BLANK = 1 << 20, re.compile(rb"[\x09-\x0D\x20]")
SEED = 42
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Most fingerprints of a bucket that are searched at once.
BLOCK = 4096
#: Cost of one probe (a row written, shuffled and sorted: 4 microseconds) in units of one verified candidate (2 nanoseconds).
PROBE_COST = 2000.0


def shingle_blocks(text: str | None, n: int) -> Iterator[np.ndarray]:
    """Hashes of the word shingles in their order, a block of a long text at a time; a text shorter than a shingle is one itself."""
    data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    at, held, some = 0, [], False
    digest = xxhash.xxh64_intdigest
    while at < len(data):
        cut = BLANK.search(data, at + BLOCK_BYTES)
        end = cut.start() if cut else len(data)
        found = held + data[at:end].split()
        at = end
        if len(found) >= n:
            some = True
            whole = b" ".join(found)
            last = np.cumsum([len(w) + 1 for w in found]) - 1
            first = np.concatenate(([0], last[:-1] + 1)).tolist()
            yield np.array([digest(whole[a:b], SEED) for a, b in zip(first, last.tolist()[n - 1 :], strict=False)], dtype="<u8")
        # The next block's first shingles begin with the last words of this one.
        held = found[-(n - 1) :] if n > 1 else []
    if held and not some:
        yield np.array([digest(b" ".join(held), SEED)], dtype="<u8")


def shingle_hashes(text: str | None, n: int) -> np.ndarray:
    parts = list(shingle_blocks(text, n))
    return np.concatenate(parts) if parts else np.zeros(0, "<u8")


def majority(blocks: Iterable[np.ndarray]) -> int:
    """The bits that more than half of the hashes have."""
    half, total = 0, np.zeros(BITS, dtype=np.int64)
    for block in blocks:
        half += len(block)
        for at in range(0, len(block), 8192):
            total += np.unpackbits(block[at : at + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > half, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, n: int = 3) -> int:
    """SimHash of the word shingles of one text, as an unsigned number."""
    return majority(shingle_blocks(text, n))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """One row for each row of ``df``: id and fp, the fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([fingerprint(x.as_py(), n) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made.view(np.int64))], names=["id", "fp"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(each, f"id {kind}, fp long")


@dataclass(frozen=True)
class Part:
    bits: tuple[int, ...]
    threshold: int = 0

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    @property
    def signed(self) -> int:
        return self.mask - (1 << 64) if self.mask >> 63 else self.mask


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set: 64 x 64 sums over all."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            x = np.unpackbits(batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (x.T @ x).astype(np.float64)
            n += len(x)
        flat = np.concatenate(([n], total.ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "x"])

    sums = fps.select("fp").mapInArrow(each, "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    flat = np.zeros(1 + BITS * BITS)
    for r in sums.collect():  # 4,097 rows at any size
        flat[r["at"]] = r["x"]
    return int(flat[0]), flat[1:].reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, m: int) -> list[Part]:
    """Greedy groups of equal width: each starts at the free bit with the strongest ties and takes the bits most correlated with it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(np.outer(p * (1 - p), p * (1 - p)), 1e-12))
    tie = np.abs(both / max(n, 1) - np.outer(p, p)) / spread
    np.fill_diagonal(tie, 0)
    free, parts = list(range(BITS)), []
    for i in range(m):
        width = BITS * (i + 1) // m - BITS * i // m
        own = [max(free, key=lambda b: (tie[b, free].sum(), -b))]
        while len(own) < width:
            own.append(max((b for b in free if b not in own), key=lambda b: (tie[b, own].mean(), -b)))
        free = [b for b in free if b not in own]
        parts.append(Part(tuple(sorted(own))))
    return parts


def allocate(cost: list[dict[int, float]], total: int) -> tuple[float, list[int]]:
    """Thresholds of least cost that add up to ``total``; cost[i] maps a threshold of part i to its cost."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for choices in cost:
        step: dict[int, tuple[float, list[int]]] = {}
        for used, (c, chosen) in best.items():
            for t, more in choices.items():
                if used + t not in step or c + more < step[used + t][0]:
                    step[used + t] = (c + more, [*chosen, t])
        best = step
    return best[total]


def plan_parts(fps: DataFrame, distance: int, choices: tuple[int, ...] = (2, 3, 4, 5)) -> list[Part]:
    """The parts and thresholds of the search.

    Pairs that agree on a part are counted over all fingerprints. Pairs at distance t in it are
    estimated from that count and the odds that each of its bits differs.
    """
    n, both = bit_counts(fps)
    if n < 2:
        return []
    p = np.diag(both) / n
    differ = np.clip(2 * p * (1 - p), 1e-6, 1 - 1e-6)
    odds = differ / (1 - differ)
    layouts = {m: group_bits(n, both, m) for m in choices if m <= distance + 1 or m == 2}
    every = list(dict.fromkeys(part for parts in layouts.values() for part in parts))
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col("fp").bitwiseAND(F.lit(x.signed)).alias("key")) for i, x in enumerate(every)])).alias("k")
    agree = fps.select(keys).groupBy("k.part", "k.key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").groupBy("part").agg(F.sum(F.col("c").cast("double") * (F.col("c") - 1) / 2).alias("pairs"))
    exact = {r["part"]: r["pairs"] for r in agree.collect()}  # a row for each part
    best = None
    for m, parts in layouts.items():
        cost = []
        for part in parts:
            base = max(exact.get(every.index(part), 0.0), 0.5 * n * n * float(np.prod(1 - differ[list(part.bits)])))
            shells = np.poly(-odds[list(part.bits)])  # elementary symmetric sums: pairs by distance inside the part
            row = {-1: 0.0}
            for t in range(min(distance, len(part.bits) // 2) + 1):  # half of a part's bits stay in its keys
                probes = comb(len(part.bits), t)
                row[t] = base * float(shells[: t + 1].sum()) + PROBE_COST * n * probes
            cost.append(row)
        c, chosen = allocate(cost, distance - m + 1)
        if best is None or c < best[0]:
            best = (c, [Part(part.bits, t) for part, t in zip(parts, chosen, strict=True) if t >= 0])
    return best[1]


def probe_masks(parts: list[Part]) -> list[int]:
    """Masks so that two fingerprints within a part's threshold agree under one of the part's masks: any ``threshold`` of its bits are left out."""
    masks = [part.mask & ~sum(1 << b for b in out) for part in parts for out in itertools.combinations(part.bits, part.threshold)]
    return [x - (1 << 64) if x >> 63 else x for x in masks]


def forest(fps: np.ndarray, distance: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """A spanning forest of the links among the fingerprints of one bucket, by breadth first search; each node leaves the open list once."""
    edges, open_ = [], fps
    while len(open_) > 1:
        queue, open_ = [open_[0]], open_[1:]
        while queue and len(open_):
            x = queue.pop()
            near = np.bitwise_count(open_ ^ x) <= distance
            if near.any():
                hit = open_[near]
                open_ = open_[~near]
                edges.append((np.full(len(hit), x), hit))
                queue.extend(hit)
    return edges


def nearest_forest(fps: np.ndarray, more: np.ndarray, group: np.ndarray, distance: int, slack: int, both: int = 2 * BITS) -> tuple[np.ndarray, np.ndarray]:
    """The spanning forest of least total distance of the candidates of one bucket whose groups differ, as pairs of places: likelier than others to be made of true links. ``both`` bounds the total."""
    far = 255
    best, parent = np.full(len(fps), far, np.uint8), np.zeros(len(fps), np.int64)
    open_, x, edges = np.arange(1, len(fps)), 0, []
    while len(open_):
        one, two = np.bitwise_count(fps[open_] ^ fps[x]), np.bitwise_count(more[open_] ^ more[x])
        now = np.where((one <= distance) & (two <= slack) & (one + two <= both) & (group[open_] != group[x]), one + two, far)
        closer = now < best[open_]
        best[open_[closer]], parent[open_[closer]] = now[closer], x
        j = int(np.argmin(best[open_]))
        x = int(open_[j])
        if best[x] < far:
            edges.append((parent[x], x))
        open_[j] = open_[-1]
        open_ = open_[:-1]
    return tuple(np.array(edges, np.int64).reshape(-1, 2).T)


SMALL = 12


def bucket_edges(keys: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges inside runs of equal keys: all links of small runs, a spanning forest of larger ones."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    out = []
    for d in range(1, SMALL):
        if d >= len(keys):
            break
        at = np.flatnonzero(small[:-d] & (keys[:-d] == keys[d:]))
        at = at[np.bitwise_count(fps[at] ^ fps[at + d]) <= distance]
        if len(at):
            out.append((fps[at], fps[at + d]))
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        out += forest(np.unique(fps[s : s + n]), distance)
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def dealt(rows: DataFrame, block: int, salt: str, sizes: DataFrame | None = None) -> DataFrame:
    """``rows`` (key and others) by key, sorted by it; keys of more than ``block`` rows are dealt out as pairs of blocks, by a hash of ``salt``. ``sizes`` (key, count) may be estimates: every pair of a key meets at any number of blocks."""
    hot = staged((rows.groupBy("key").count() if sizes is None else sizes).filter(F.col("count") > block).select(F.col("key").alias("hot_key"), F.ceil(F.col("count") / block).cast("int").alias("blocks")), "simhash-hot")
    own = F.pmod(F.xxhash64(salt, F.lit(SEED)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("blocks"), F.lit(1)) - 1))
    rest = [c for c in rows.columns if c != "key"]
    paired = (
        rows.join(hot, F.col("key") == F.col("hot_key"), "left")
        .select("key", *rest, F.coalesce(own, F.lit(0)).alias("own"), other.alias("other"))
        .select(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("key"), *rest)
    )
    return paired.repartition("key").sortWithinPartitions("key")


def dealt_probes(fps: DataFrame, masks: list[int], *more: str) -> DataFrame:
    """Rows (key, fp, *more) of every mask, sorted by key; keys above ``BLOCK`` are dealt out as pairs of blocks."""
    # The mask's number is part of the key: equal values under two masks are different buckets.
    key = F.explode(F.array(*[F.xxhash64(F.lit(i), F.col("fp").bitwiseAND(F.lit(m))) for i, m in enumerate(masks)]))
    return dealt(fps.select(key.alias("key"), "fp", *more), BLOCK, more[-1] if more else "fp")


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """The columns of the batches, cut where the first (int64, sorted) changes, so that no run of it is parted."""
    held: tuple[np.ndarray, ...] | None = None
    for batch in batches:
        own = tuple(c.to_numpy(zero_copy_only=False) for c in batch.columns)
        held = own if held is None else tuple(np.concatenate(x) for x in zip(held, own, strict=True))
        if not len(held[0]):
            continue
        cut = int(np.searchsorted(held[0], held[0][-1]))  # the last run may go on in the next batch
        if cut:
            yield tuple(x[:cut] for x in held)
            held = tuple(x[cut:] for x in held)
    if held is not None and len(held[0]):
        yield held


def links(fps: DataFrame, distance: int = 3, parts: list[Part] | None = None) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of all links among the distinct ``fps`` (column fp)."""
    spark = fps.sparkSession
    masks = probe_masks(plan_parts(fps, distance) if parts is None else parts)
    if not masks:
        return spark.createDataFrame([], "a long, b long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, f in whole_runs(batches):
            a, b = bucket_edges(k, f.view(np.uint64), distance)
            a, b = a.view(np.int64), b.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return dealt_probes(fps, masks).mapInArrow(search, "a long, b long").filter("a <> b").distinct()


def bucket_forest(keys: np.ndarray, fps: np.ndarray, more: np.ndarray, group: np.ndarray, distance: int, slack: int, both: int = 2 * BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of pairs inside runs of equal keys, within ``distance`` in ``fps``, ``slack`` in ``more`` and ``both`` in their sum, of different groups: all of small runs, a spanning forest of larger ones."""
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    sizes = np.diff(np.r_[starts, len(keys)])
    small = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
    for d in range(1, min(SMALL, len(keys))):
        at = np.flatnonzero(small[:-d] & (keys[:-d] == keys[d:]))
        at = at[group[at] != group[at + d]]
        one, two = np.bitwise_count(fps[at] ^ fps[at + d]), np.bitwise_count(more[at] ^ more[at + d])
        at = at[(one <= distance) & (two <= slack) & (one + two <= both)]
        yield at, at + d
    for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist(), strict=True):
        # Two rows of the largest group are no pair: its rows come last and are compared with the others only.
        groups, sizes_ = np.unique(group[s : s + n], return_counts=True)
        if len(groups) == 1:
            continue
        largest = group[s : s + n] == groups[np.argmax(sizes_)]
        order = s + np.argsort(largest, kind="stable")
        # Rows without a candidate are left out of the forest's steps.
        some = np.zeros(n, bool)
        own, other, part = fps[order], more[order], group[order]
        for i in range(0, n - int(largest.sum()), 256):
            one = np.bitwise_count(own[i : i + 256, None] ^ own[None, i:])
            near = one <= distance
            if both < 2 * BITS:
                near &= one + np.bitwise_count(other[i : i + 256, None] ^ other[None, i:]) <= both
            a, b = np.nonzero(near)
            fits = (b > a) & (part[i + a] != part[i + b])
            a, b = i + a[fits], i + b[fits]
            fits = np.bitwise_count(other[a] ^ other[b]) <= slack
            some[a[fits]] = some[b[fits]] = True
        place = np.flatnonzero(some)
        if len(place):
            a, b = nearest_forest(own[place], other[place], part[place], distance, slack, both)
            yield order[place[a]], order[place[b]]


def near_forest(classes: DataFrame, distance: int, slack: int, parts: list[Part]) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of different groups within ``distance`` in fp and ``slack`` in more: as many as join in every bucket what all such pairs join. ``classes`` has node, fp, more, root (the group)."""
    spark = classes.sparkSession
    masks = probe_masks(parts)
    if not masks:
        return spark.createDataFrame([], "a long, b long")

    return bucket_pairs(dealt_probes(classes.select("fp", "more", "root", "node"), masks, "more", "root", "node"), distance, slack)


def bucket_pairs(probes: DataFrame, distance: int, slack: int, both: int = 2 * BITS) -> DataFrame:
    """The distinct pairs (a, b), a < b, of :func:`bucket_forest` among ``probes`` (key, fp, more, root, node), sorted by key."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for k, f, m, group, node in whole_runs(batches):
            for at, to in bucket_forest(k, f.view(np.uint64), m.view(np.uint64), group, distance, slack, both):
                a, b = node[at], node[to]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return probes.mapInArrow(search, "a long, b long").filter("a <> b").distinct()


#: Bits of both fingerprints, 128 together, in which sets that share a rare shingle may differ. At a similarity of 0.8 each bit differs
#: with odds of 0.15 (19 of 128 on average, deviation 4), of 0.19 in the smallest sets (24 and 4.4). Unrelated sets are so close with
#: odds of 4 in 10^7; twelve bits more would chain many of them to one component.
WIDE = 36
#: One of so many sets shows which shingles have more than ``BLOCK`` rows.
SHOWN = 16


def shared_forest(classes: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of different groups that share a shingle of their ``prefixes`` (node, prefix) and are within ``WIDE``: as many as join in every bucket what all such pairs join.

    Sets of the similarity that the prefixes are made for do share one (see :func:`prefix`), so their number grows with the
    texts' length and not with the corpus, other than the buckets of masked fingerprints.
    """
    own = classes.select(F.col("node").alias("x"), "fp", "more", "root")

    def keyed(rows: DataFrame) -> DataFrame:
        return rows.join(own, F.col("node") == F.col("x")).select(F.explode("prefix").alias("key"), "fp", "more", "root", "node")

    shown = prefixes.filter(F.pmod(F.xxhash64("node", F.lit(SEED)), F.lit(SHOWN)) == 0).select(F.explode("prefix").alias("key"))
    sizes = shown.groupBy("key").agg((F.count(F.lit(1)) * SHOWN).alias("count"))
    return bucket_pairs(dealt(keyed(prefixes), BLOCK, "node", sizes), BITS, BITS, WIDE)


def similar_forest(nodes: np.ndarray, groups: np.ndarray, sets: list[np.ndarray], least_similarity: float) -> list[tuple[int, int]]:
    """Pairs of nodes with that Jaccard similarity which join what isn't joined yet; nodes of one group are."""
    root = {g: g for g in groups.tolist()}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, number = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(number, kind="stable")
    ends = np.searchsorted(number[order], np.arange(number.max() + 2))
    held, first, out = owner[order], np.concatenate(([0], np.cumsum(sizes))), []
    for i in range(len(sets)):
        own = number[first[i] : first[i + 1]]
        # Owners of all shingles of this set, once for each.
        spans = ends[own + 1] - ends[own]
        at = np.repeat(ends[own] - np.concatenate(([0], np.cumsum(spans)[:-1])), spans) + np.arange(spans.sum())
        shared = np.bincount(held[at], minlength=len(sets))
        for j in np.flatnonzero(shared >= least_similarity * (sizes + sizes[i] - shared)).tolist():
            a, b = find(int(groups[i])), find(int(groups[j]))
            if a != b:
                root[a] = b
                out.append((int(nodes[i]), int(nodes[j])))
    return out


#: Most sets that are compared at once.
SET_BLOCK = 1024


def verified(members: DataFrame, least_similarity: float) -> DataFrame:
    """Edges (a, b) that join the groups of ``members`` (key, node, root, shingles) of one key as all pairs with that similarity do."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def edges(rows: list[tuple[int, int, int, np.ndarray]]) -> pa.RecordBatch:
            found = similar_forest(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), [r[3] for r in rows], least_similarity) if len(rows) > 1 else []
            a, b = np.array(found, np.int64).reshape(-1, 2).T
            return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        held: list[tuple[int, int, int, np.ndarray]] = []
        for batch in batches:
            for key, node, root, own in zip(*(batch.column(i).to_pylist() for i in range(3)), batch.column(3), strict=True):
                if held and held[0][0] != key:
                    yield edges(held)
                    held = []
                held.append((key, node, root, own.values.to_numpy()))
        if held:
            yield edges(held)

    return dealt(members.select("key", "node", "root", "shingles"), SET_BLOCK, "node").mapInArrow(each, "a long, b long")


def joined_at_once(edges: DataFrame) -> DataFrame:
    """:func:`components` of few distinct edges (u, v), in one task."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := root.setdefault(x, x)) != x:
                root[x] = x = root[up]
            return x

        for batch in batches:
            for u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                low, high = sorted((find(u), find(v)))
                root[high] = low
        found = [(x, r) for x in list(root) if (r := find(x)) != x]
        node, least = np.array(found, np.int64).reshape(-1, 2).T
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(least)], names=["node", "root"])

    return edges.coalesce(1).mapInArrow(each, "node long, root long")


#: Most edges that one task joins: some 4 MB.
AT_ONCE = 1 << 18


def components(edges: DataFrame, most_rounds: int = 60, at_once: int = 0) -> DataFrame:
    """Connected components of edges (a, b): rows (node, root), root the smallest node; nodes that are roots have no row.

    Up to ``at_once`` distinct edges are joined in one task: rounds ask for many jobs, each of which costs the driver memory.

    Alternating rounds: large-star hangs a node's larger neighbours on its smallest neighbour,
    small-star does so with the smaller ones. Smallest neighbours are aggregated, never gathered,
    so a node with a third of all edges is one row for each task.
    """
    e = staged(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "components")
    if at_once and e.count() <= at_once:
        found = staged(joined_at_once(e), "components")
        drop_staged(e)
        return found
    mark = lambda t: t.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).collect()[0]
    was = mark(e)
    for _ in range(most_rounds):
        if not was[0]:
            break
        ways = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).withColumnRenamed("u", "x")
        large = ways.filter(F.col("v") > F.col("u")).join(least, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = staged(large, "components")
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        small = large.join(least, F.col("u") == F.col("x"))
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        new = staged(small, "components")
        now = mark(new)
        drop_staged(large)
        drop_staged(e)
        e = new
        if now == was:
            break
        was = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, n: int = 3) -> DataFrame:
    """One row for each row of ``df``: id, fp, component_id (the smallest id reachable)."""
    rows = staged(fingerprints(df, id_col, text_col, n), "simhash")
    classes = staged(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("size")), "simhash-classes")
    joined = classes.join(components(links(classes.select("fp"), distance)), F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    joined = staged(joined, "simhash-roots")
    ids = joined.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "r")
    owner = staged(joined.join(ids, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id"), "simhash-owners")
    drop_staged(classes)
    drop_staged(joined)
    return rows.join(owner, F.col("fp") == F.col("f")).select(F.col("id").alias(id_col), "fp", "component_id")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


#: Mixes a shingle's hash into the one of the second fingerprint.
SECOND = np.uint64(0xBF58476D1CE4E5B9)


def sketch(text: str | None, n: int) -> tuple[int, int, np.ndarray]:
    """Two fingerprints of the set of word shingles, by independent hashes, and the set's sorted hashes."""
    own = np.unique(shingle_hashes(text, n))
    mixed = (own ^ (own >> np.uint64(30))) * SECOND
    return majority([own]), majority([mixed ^ (mixed >> np.uint64(31))]), own


def prefix(own: np.ndarray, common: np.ndarray, least_similarity: float) -> np.ndarray:
    """The first hashes of a sorted set, ``common`` ones behind all others: so many that two sets of that Jaccard similarity have one of them in common.

    What a set of s shares with a similar one is ``least_similarity`` * s or more, so the first hash
    that both have, in an order that holds for all sets, has at least that many of its own from there on.
    """
    late = np.isin(own, common)
    ordered = np.concatenate((own[~late], own[late]))
    return ordered[: len(own) - ceil(least_similarity * len(own) - 1e-9) + 1]


#: The shingles that so many texts of a sample of ``SAMPLE`` have come last in the order of prefixes. Any order finds the same pairs; this one makes small buckets.
SAMPLE, COMMON_TEXTS, MOST_COMMON = 4000, 8, 4096


def common_shingles(texts: DataFrame, n: int) -> np.ndarray:
    """Hashes of the shingles that many of the ``texts`` (r1, r2, text) have, by a sample."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [np.unique(shingle_hashes(x.as_py(), n)) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, "<u8"), *made]).view(np.int64))], names=["key"])

    step = max(1, texts.count() // SAMPLE)
    drawn = texts.filter(F.pmod("r2", F.lit(step)) == 0).select("text").limit(2 * SAMPLE)
    counts = drawn.mapInArrow(each, "key long").groupBy("key").count().filter(F.col("count") >= COMMON_TEXTS)
    found = counts.orderBy(F.desc("count"), "key").limit(MOST_COMMON).collect()
    return np.sort(np.array([r["key"] for r in found], np.int64).view(np.uint64))


def sketches(rows: DataFrame, n: int, common: np.ndarray, least_similarity: float) -> DataFrame:
    """One row for each row of ``rows`` (id, r1, r2, text): id, r1, r2, fp, more, node, the hash of the shingle set, and its prefix."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made, first = np.zeros((3, batch.num_rows), dtype=np.uint64), []
            for i, x in enumerate(batch.column(3)):
                one, two, own = sketch(x.as_py(), n)
                made[:, i] = one, two, xxhash.xxh64_intdigest(own.tobytes(), SEED)
                first.append(prefix(own, common, least_similarity).view(np.int64))
            columns = [*batch.columns[:3], *[pa.array(x.view(np.int64)) for x in made], pa.array(first, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "r1", "r2", "fp", "more", "node", "prefix"])

    return rows.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, r1 long, r2 long, fp long, more long, node long, prefix array<long>")


def shingle_sets(rows: DataFrame, n: int) -> DataFrame:
    """The shingle hashes of each of ``rows`` (node, text): node, shingles."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = [sketch(x.as_py(), n)[2].view(np.int64) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int64()))], names=["node", "shingles"])

    return rows.mapInArrow(each, "node long, shingles array<long>")


def similar(pairs: DataFrame, sets: DataFrame, least_similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least that Jaccard similarity."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("_a"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("_b"))
    shared = F.size(F.array_intersect("_a", "_b"))
    joined = pairs.join(left, "a").join(right, "b")
    return joined.filter(shared >= F.lit(least_similarity) * (F.size("_a") + F.size("_b") - shared)).select("a", "b")


def similar_components(classes: DataFrame, texts: DataFrame, prefixes: DataFrame, n: int, distance: int, slack: int, least_similarity: float) -> DataFrame:
    """Components (node, root) of the links of that similarity among ``classes`` (node, fp, more, least), whose texts are in ``texts`` (r1, r2, text) and whose ``prefixes`` (node, prefix) are given.

    First, a spanning forest of the candidates in each bucket of a search for half the distance is verified: it joins most of what
    belongs together, groups of copies above all, by as many pairs as they have members. Then all candidates between what is
    still apart are looked for among the sets that share a rare shingle: those whose two fingerprints differ by ``WIDE`` bits at most.
    Of these, too, a forest is kept, whose components hold every candidate pair; the sets of each are compared in one place,
    in pairs of blocks above ``SET_BLOCK``. So nothing is paired off but in memory.
    """
    # Wide distances ask for more parts than narrow ones; the allocator compares them. Parts of fewer than eight bits filter too little.
    within = distance // 2
    parts = plan_parts(classes.select("fp"), within, tuple(range(2, min(within + 1, 8) + 1)))

    def shingled(wanted: DataFrame) -> DataFrame:
        holders = wanted.join(classes, "node").select("node", F.col("least.r1").alias("h1"), F.col("least.r2").alias("h2"))
        return shingle_sets(texts.join(holders, (F.col("r1") == F.col("h1")) & (F.col("r2") == F.col("h2"))).select("node", "text"), n).dropDuplicates(["node"])

    single = classes.select("node", "fp", "more", F.col("node").alias("root"))
    pairs = staged(near_forest(single, distance, slack, parts), "simhash-pairs")
    sets = staged(shingled(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()), "simhash-sets")
    near = staged(similar(pairs, sets, least_similarity), "simhash-similar")
    joined = components(near, at_once=AT_ONCE)
    grouped = classes.join(joined.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("node", "fp", "more", F.coalesce("root", "node").alias("root"))
    grouped = staged(grouped, "simhash-grouped")
    places = components(shared_forest(grouped, prefixes), at_once=AT_ONCE)
    # A component's root has no row of its own.
    keys = places.select("node", F.col("root").alias("key")).union(places.select(F.col("root").alias("node"), F.col("root").alias("key")).distinct())
    keys = staged(keys, "simhash-keys")
    members = shingled(keys.select("node")).join(keys, "node").join(grouped.select("node", "root"), "node")
    more = staged(verified(staged(members, "simhash-members"), least_similarity), "simhash-more")
    found = components(near.union(more), at_once=AT_ONCE)
    for table in (pairs, sets, near, joined, grouped, places, keys, more):
        drop_staged(table)
    return found


def drop_near_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 3, n: int = 3, least_similarity: float | None = None, slack: int = 20) -> DataFrame:
    """One row of ``df`` for each component, with all its columns: that with the smallest id, null ids last.

    Rows are told apart by id and text; of rows that repeat both, one stays. Without
    ``least_similarity`` components are those of links within ``distance``. With it, links are the
    pairs whose sets of ``n``-word shingles have that Jaccard similarity: first among those within half
    of ``distance``, and ``slack`` by a second fingerprint, then among all (:func:`similar_components`).
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).select("id", *text_marks(), "text")
    if least_similarity is None:
        marked = fingerprints(texts.select(F.struct("id", "r1", "r2").alias("k"), "text"), "k", "text", n)
        rows = staged(marked.select("id.*", "fp", F.col("fp").alias("more"), F.col("fp").alias("node")), "simhash")
    else:
        rows = staged(sketches(texts, n, common_shingles(texts, n), least_similarity), "simhash")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "r1", "r2"))
    classes = staged(rows.groupBy("node").agg(F.first("fp").alias("fp"), F.first("more").alias("more"), first.alias("least")), "simhash-classes")
    held = [rows, classes]
    if least_similarity is None:
        found = components(links(classes.select("fp"), distance))
    else:
        found = similar_components(classes, texts, rows.select("node", "prefix"), n, distance, slack, least_similarity)
    roots = classes.join(found.withColumnRenamed("node", "x"), F.col("node") == F.col("x"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    kept = roots.groupBy("root").agg(F.min("least").alias("least")).select(F.col("least.r1").alias("k1"), F.col("least.r2").alias("k2"))
    # A row of each id and text, and whether there are more of it.
    marks = rows.groupBy("r1", "r2").agg(F.count(F.lit(1)).alias("n")).join(kept, (F.col("r1") == F.col("k1")) & (F.col("r2") == F.col("k2")), "left")
    gone = staged(marks.select(F.col("r1").alias("g1"), F.col("r2").alias("g2"), F.col("k1").isNotNull().alias("stays"), "n").filter("not stays or n > 1"), "simhash-gone")
    for table in (*held, found):
        drop_staged(table)
    names = [f"_c{i}" for i in range(len(df.columns))]
    at = dict(zip(df.columns, names, strict=True))
    back = [F.col(x).alias(c) for c, x in at.items()]
    marked = df.toDF(*names).withColumn("id", F.col(at[id_col])).withColumn("text", F.col(at[text_col]).cast("string")).select(*names, *text_marks())
    same = (F.col("r1") == F.col("g1")) & (F.col("r2") == F.col("g2"))
    single = marked.join(gone, same, "left_anti").select(*back)
    if gone.filter("stays").isEmpty():
        return single
    again = marked.join(gone.filter("stays"), same).dropDuplicates(["g1", "g2"]).select(*back)
    return single.union(again)
