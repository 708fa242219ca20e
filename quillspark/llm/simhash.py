"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, components.

A fingerprint's 64 bits are cut into ``d + spare`` blocks. Two fingerprints that differ in at most
d bits differ in at most d blocks, so they agree on some set of ``spare`` blocks; every such set
is a join key. Work runs on different fingerprints only, so exact copies cost one row. Within a
key's rows the Hamming distance is tested exactly, and what is emitted is a star per connected
group rather than its pairs: a bucket of m near copies gives at most m - 1 links, which join the
same documents.

A bucket of more than ``BUCKET`` rows goes on instead of being compared in one task: its members agree
on the key's bits, so the rest of their bits is cut into d + 1 blocks, of which two close ones share
one, and each of these choices, with the bits before, is the key of a smaller bucket. That ends at
the latest when all bits are keys.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate, combinations
from math import acos, ceil, comb, log, log1p, pi, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from quillspark.llm.components import components
from quillspark.llm.shared import drop_written, row_hash, written

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: Costs, in comparisons, of a key row and of a comparison; they set the number of spare blocks.
ROW_COST, MOST_SPARE = 2000, 4
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Shingle hashes turned into bits at a time.
CHUNK = 1 << 16
#: Members of the largest bucket whose pairs are tested as one matrix, and of the largest one tested in one task.
MATRIX, BUCKET = 1024, 4096
ALL_BITS = (1 << 64) - 1


def shingle_hashes(text: str | None, size: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """XXH64 of every run of ``size`` words (all words, if fewer), A-Z lower-cased, joined by spaces."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    joined, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([h(joined, seed)], np.uint64)
    ends = [e - 1 for e in accumulate(len(w) + 1 for w in words)]
    starts = [0, *[e + 1 for e in ends[: len(words) - size]]]
    return np.array([h(joined[s:e], seed) for s, e in zip(starts, ends[size - 1 :], strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; 0 if there are none."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def second_hashes(hashes: np.ndarray) -> np.ndarray:
    """Other 64 bits for each shingle hash (splitmix64)."""
    with np.errstate(over="ignore"):
        x = hashes + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """doc_id and fp (64 bits, as a signed long) of every row of ``docs``; no shuffle."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(shingle_hashes(text.as_py(), shingle, seed)) for text in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, f"doc_id {kind}, fp bigint")


def spare_blocks(distance: int, count: int) -> int:
    """The number of agreeing blocks that costs least for so many fingerprints; any finds every link."""
    cost = lambda spare: comb(distance + spare, spare) * (ROW_COST + count / 2 ** (64 * spare / (distance + spare)))
    return min(range(1, MOST_SPARE + 1), key=cost)


def block_masks(distance: int, spare: int) -> list[int]:
    """Masks of the keys: every choice of ``spare`` of distance + spare blocks."""
    n = distance + spare
    edges = [round(64 * k / n) for k in range(n + 1)]
    blocks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:], strict=False)]
    return [sum(pick) for pick in combinations(blocks, spare)]


def finer_masks(mask: int, distance: int) -> list[int]:
    """Masks that add to ``mask`` one of distance + 1 blocks of its other bits; none where too few are left.

    A bucket with so few bits left holds at most 2 ** (2 * distance + 1) fingerprints.
    """
    rest = [b for b in range(64) if not mask >> b & 1]
    if len(rest) <= 2 * distance + 1:
        return []
    edges = [round(len(rest) * k / (distance + 1)) for k in range(distance + 2)]
    return [mask | sum(1 << b for b in rest[lo:hi]) for lo, hi in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def star_links(fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(members, centres) of ``fps`` that connect what links in one bucket connect.

    Breadth first: reached fingerprints are compared with those not yet reached, so a dense
    bucket costs about one comparison a member and memory stays in proportion to the bucket.
    """
    near = lambda a, b: np.bitwise_count(a ^ b) <= distance
    rest, members, centres = np.unique(fps), [], []
    if 1 < len(rest) <= MATRIX:
        rest = rest[near(rest[:, None], rest[None, :]).sum(axis=1) > 1]
    while len(rest) > 1:
        centre, rest = rest[0], rest[1:]
        front = centre[None]
        while len(front) and len(rest):
            reached = np.zeros(len(rest), bool)
            for f in front:
                reached |= near(rest, f)
            front, rest = rest[reached], rest[~reached]
            members.append(front)
            centres.append(np.repeat(centre, len(front)))
    none = np.empty(0, np.uint64)
    return (np.concatenate(members), np.concatenate(centres)) if members else (none, none)


def _bucket_links(distance: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (mask, part, fp) sorted by (mask, part) to links (u, v), or, of buckets over ``most``, to their rows (fp, fp) under finer masks."""
        held: list[np.ndarray] = []
        held_key, size, finer = None, 0, []

        def out(u: np.ndarray, v: np.ndarray, mask: int | None) -> Iterator[pa.RecordBatch]:
            if len(u):
                masks = pa.nulls(len(u), pa.int64()) if mask is None else pa.array(np.full(len(u), _signed(mask), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64)), masks], ["u", "v", "mask"])

        def finished() -> Iterator[pa.RecordBatch]:
            if held:
                yield from out(*star_links(np.concatenate(held), distance), None)

        for batch in batches:
            if not batch.num_rows:
                continue
            mask, part, fp = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
            fps = fp.view(np.uint64)
            cuts = np.flatnonzero((mask[1:] != mask[:-1]) | (part[1:] != part[:-1])) + 1
            bounds = np.concatenate([[0], cuts, [len(fps)]])
            whole = np.diff(bounds)[1:-1]
            # buckets that begin and end in this batch: pairs together, then the larger ones
            two = np.flatnonzero(whole == 2) + 1
            if len(two):
                a, b = fps[bounds[two]], fps[bounds[two] + 1]
                close = np.bitwise_count(a ^ b) <= distance
                yield from out(a[close], b[close], None)
            for k in [0, *(np.flatnonzero(whole > 2) + 1).tolist(), *([len(bounds) - 2] if len(bounds) > 2 else [])]:
                some, key = fps[bounds[k] : bounds[k + 1]], (mask[bounds[k]], part[bounds[k]])
                if key != held_key:
                    yield from finished()
                    held, held_key, size, finer = [], key, 0, []
                held.append(some.copy())
                if size <= most < size + len(some):
                    finer = finer_masks(int(key[0]) & ALL_BITS, distance)
                size += len(some)
                if finer:
                    for rows in held:
                        for mask_of in finer:
                            yield from out(rows, rows, mask_of)
                    held = []
        yield from finished()

    return run


def near_components(prints: DataFrame, distance: int = DISTANCE, most: int = BUCKET) -> DataFrame:
    """(fp, root): the different fingerprints of ``prints`` (fp) and the smallest one they are linked to.

    Only fingerprints that link to another and aren't the smallest of their component appear.
    ``most`` sets the members above which a bucket is split; the result doesn't depend on it.
    """
    spark = prints.sparkSession
    fps = prints.select("fp").distinct()
    masks = block_masks(distance, spare_blocks(distance, fps.count()))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = fps.select(F.explode(F.array(*[F.lit(_signed(m)) for m in masks])).alias("mask"), "fp")
    tables = []
    while True:
        parted = keyed.withColumn("part", F.col("fp").bitwiseAND(F.col("mask"))).select("mask", "part", "fp")
        dealt = parted.repartition(n, "mask", "part").sortWithinPartitions("mask", "part")
        tables.append(written(dealt.mapInArrow(_bucket_links(distance, most), "u bigint, v bigint, mask bigint"), "simhash-links"))
        keyed = tables[-1].where("mask is not null").select("mask", F.col("u").alias("fp")).distinct()
        if keyed.isEmpty():
            break
    links = tables[0].where("mask is null").select("u", "v")
    for table in tables[1:]:
        links = links.unionByName(table.where("mask is null").select("u", "v"))
    roots = components(links).select(F.col("node").alias("fp"), "root")
    for table in tables:
        drop_written(table)
    return roots


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED, most: int = BUCKET) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): its fingerprint and near-duplicate component.

    Returns doc_id, fp (signed long), fingerprint (16 hex digits) and component_id, the smallest
    doc_id reachable over links of at most ``distance`` differing bits. A null or wordless text has
    fingerprint 0, which links like any other; a text of any length is read whole; repeated rows
    stay, each with the same result; a null doc_id is never a component's name unless nothing else
    is in it; an empty table gives an empty result. Other columns play no role.
    """
    prints = written(fingerprints(docs, shingle, seed), "fingerprints")
    roots = near_components(prints, distance, most)
    firsts = prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # both sides of the join on a root are written tables, whose large partitions Spark can split
    named = written(firsts.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    least = written(named.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("size")).where("size > 1"), "least")
    names = written(named.join(least, "root").select("fp", "component_id"), "components")
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return prints.join(names, "fp", "left").select("doc_id", "fp", digits, F.coalesce("component_id", "doc_id").alias("component_id"))


#: The stage on whole documents: a Jaccard similarity of five-word shingles of at least 0.8, decided
#: exactly. Its SimHash fingerprint has 64 * WORDS bits; a Hamming check reads 64 * CHECKED of them.
STAGE_SHINGLE, STAGE_LEAST = 5, 0.8
WORDS, CHECKED = 16, 4
#: The probability that a pair at the least similarity agrees on no block, the deviations from the
#: expected distance that a candidate may have, and the blocks (at least) and rows whose keys are on
#: disk at a time.
MISS, DEVIATIONS, ROUND, ROUND_ROWS = 1e-7, 6, 16, 8_000_000
#: Sets of up to SHORT shingles and larger ones are compared apart; TIES is the share of bits in which
#: ties make such sets differ at most beyond their angle, counted exactly for all sizes at 0.8.
SHORT, TIES = 64, (0.04, 0.0065)
#: Bits of a block at least (small tables get keys enough to be spread) and at most.
LEAST_BITS, MOST_BITS = 6, 32
#: Texts of a group that are compared in one task.
GROUP = 512
#: What is added to a hash for each of its WORDS further words.
STEPS = np.arange(WORDS, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)


def long_fingerprint(hashes: np.ndarray) -> bytes:
    """64 * WORDS bits, each set if it is set for over half of the sorted ``hashes``; of a tie the first hash's bit."""
    ones, first = np.zeros(64 * WORDS, np.int64), np.zeros(64 * WORDS, np.uint8)
    for at in range(0, len(hashes), 255):
        with np.errstate(over="ignore"):
            words = second_hashes(hashes[at : at + 255, None] + STEPS)
        bits = np.unpackbits(words.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.uint8)
        if not at:
            first = bits[0]
    return np.packbits(2 * ones + first > len(hashes), bitorder="little").tobytes()


def differing(least: float, short: bool) -> float:
    """The share of bits in which fingerprints of two sets of Jaccard similarity ``least`` differ at most: their angle over pi, and ties.

    Sets of one size have the widest angle.
    """
    return acos(min(2 * least / (1 + least), 1)) / pi + TIES[0 if short else 1]


def blocks_needed(share: float, bits: int) -> int:
    """Blocks of ``bits`` bits until a pair that differs in such a share agrees on one but for a probability of MISS."""
    return ceil(log(MISS) / log1p(-((1 - share) ** bits)))


def block_plan(share: float, count: int, seed: int) -> np.ndarray:
    """The bits of every block, a row each, that cost least for so many fingerprints.

    Blocks have no bit in common as long as there are bits; then all bits are dealt again.
    """
    cost = lambda bits: blocks_needed(share, bits) * (ROW_COST + count / 2**bits)
    bits = min(range(LEAST_BITS, MOST_BITS + 1), key=cost)
    blocks, rng = blocks_needed(share, bits), np.random.default_rng(seed)
    dealt = [rng.permutation(64 * WORDS) for _ in range(ceil(bits * blocks / (64 * WORDS)))]
    return np.concatenate(dealt)[: bits * blocks].reshape(blocks, bits)


def shingle_sets(docs: DataFrame, shingle: int, seed: int) -> DataFrame:
    """doc_id, text, id (128 bits over the set of shingles), n (its size) and its long fingerprint, of every row of ``docs``; no shuffle."""
    fields = docs.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, prints = [], [], []
            for text in batch.column(1):
                hashes = np.unique(shingle_hashes(text.as_py(), shingle, seed))
                ids.append(xxhash.xxh3_128_digest(hashes.tobytes(), seed))
                sizes.append(len(hashes))
                prints.append(long_fingerprint(hashes))
            cols = [pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(prints, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], ["doc_id", "text", "id", "n", "print"])

    return fields.mapInArrow(run, f"doc_id {fields.schema['doc_id'].dataType.simpleString()}, text string, id binary, n bigint, print binary")


def linked_sets(sets: list[np.ndarray], least: float) -> np.ndarray:
    """For every set of hashes the first set that it is connected with by Jaccard similarities of at least ``least``.

    Breadth first, as ``star_links``: a reached set is compared with those not yet reached, so
    memory stays in proportion to the sets.
    """
    sizes = np.array([len(s) for s in sets])
    words, flat = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(sizes)
    own = lambda k: flat[ends[k] - sizes[k] : ends[k]]
    root, rest, mark = np.arange(len(sets)), np.arange(len(sets)), np.zeros(len(words), bool)
    held = flat
    while len(rest) > 1:
        centre, front = rest[0], [rest[0]]
        rest, held = rest[1:], held[sizes[rest[0]] :]
        while front and len(rest):
            f = front.pop()
            mark[own(f)] = True
            both = np.add.reduceat(mark[held], np.cumsum(sizes[rest]) - sizes[rest], dtype=np.int64)
            mark[own(f)] = False
            near = both / (sizes[f] + sizes[rest] - both) >= least
            if near.any():
                front += rest[near].tolist()
                root[rest[near]] = centre
                held, rest = held[np.repeat(~near, sizes[rest])], rest[~near]
    return root


@dataclass(frozen=True)
class ByShingles:
    """Texts, compared by the Jaccard similarity of their sets of shingles."""

    shingle: int
    least: float
    seed: int

    def load(self, text: str) -> np.ndarray:
        return np.unique(shingle_hashes(text, self.shingle, self.seed))

    def roots(self, sets: list[np.ndarray]) -> np.ndarray:
        return linked_sets(sets, self.least)

    def finder(self, sets: list[np.ndarray]):
        """A function from a set to the numbers of those ``sets`` that are similar to it."""
        sizes = np.array([len(s) for s in sets])
        words, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.cumsum(sizes) - sizes

        def near(own: np.ndarray) -> np.ndarray:
            at = np.searchsorted(words, own)
            mark = np.zeros(len(words), bool)
            mark[at[(at < len(words)) & (words[np.minimum(at, len(words) - 1)] == own)]] = True
            both = np.add.reduceat(mark[flat], starts, dtype=np.int64)
            return np.flatnonzero(both / (sizes + len(own) - both) >= self.least)

        return near


@dataclass(frozen=True)
class ByBits:
    """Fingerprints, compared by their Hamming distance, which is at most ``far``."""

    far: int

    @classmethod
    def at(cls, share: float) -> ByBits:
        """The distance of a pair that differs in such a share of bits, and DEVIATIONS standard deviations."""
        n = 64 * CHECKED
        return cls(int(share * n + DEVIATIONS * sqrt(share * (1 - share) * n)))

    def load(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, "<u8")

    def pairs(self, some: np.ndarray, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The numbers (i, j) of close rows of ``some`` and ``others``."""
        apart = np.zeros((len(some), len(others)), np.uint16)
        for word in range(CHECKED):
            apart += np.bitwise_count(some[:, word, None] ^ np.ascontiguousarray(others[:, word]))
        return np.nonzero(apart <= self.far)

    def roots(self, prints: list[np.ndarray]) -> np.ndarray:
        """For every fingerprint the first one that it is connected with. Breadth first, as ``star_links``, among those that link at all."""
        fps = np.array(prints)
        linked = np.zeros(len(fps), bool)
        for at in range(0, len(fps), 128):
            i, j = self.pairs(fps[at : at + 128], fps[at:])
            linked[at + i[i != j]] = linked[at + j[i != j]] = True
        root, rest = np.arange(len(fps)), np.flatnonzero(linked)
        while len(rest) > 1:
            centre, front, rest = rest[0], [rest[0]], rest[1:]
            while front and len(rest):
                reached = self.pairs(fps[front.pop()][None], fps[rest])[1]
                if len(reached):
                    front += rest[reached].tolist()
                    root[rest[reached]] = centre
                    rest = np.delete(rest, reached)
        return root

    def finder(self, prints: list[np.ndarray]):
        fps = np.array(prints)
        return lambda own: self.pairs(own[None], fps)[1]


Compared = ByShingles | ByBits


def _block_links(by: Compared, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, block, id, item) sorted so to links (key, u, v) within each block, v being the first of its component there."""
        ids, items, now = [], [], None

        def out() -> Iterator[pa.RecordBatch]:
            if len(ids) > 1:
                root = by.roots(items)
                linked = np.flatnonzero(root != np.arange(len(root)))
                ends = [pa.array([ids[k] for k in some], pa.binary()) for some in (linked, root[linked])]
                yield pa.RecordBatch.from_arrays([pa.array([now[0]] * len(linked), kind), *ends], ["key", "u", "v"])

        for batch in batches:
            for key, block, one, item in zip(*(batch.column(k) for k in range(4)), strict=True):
                if (key.as_py(), block.as_py()) != now:
                    yield from out()
                    ids, items, now = [], [], (key.as_py(), block.as_py())
                ids.append(one.as_py())
                items.append(by.load(item.as_py()))
        yield from out()

    return run


def _guest_links(by: Compared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, block, kind, id, label, item) sorted so: a block's own members, then guests one by one.

        A guest is linked to one member of each of the block's components that holds a similar one.
        """
        now, labels, items, near = None, [], [], None
        for batch in batches:
            pairs = []
            for key, block, kind, one, label, item in zip(*(batch.column(k) for k in range(6)), strict=True):
                if (key.as_py(), block.as_py()) != now:
                    now, labels, items, near = (key.as_py(), block.as_py()), [], [], None
                own = by.load(item.as_py())
                if kind.as_py() == 0:
                    labels.append(label.as_py())
                    items.append(own)
                    continue
                if not items:
                    continue
                near = near or by.finder(items)
                pairs += [(one.as_py(), v) for v in {labels[k] for k in near(own)}]
            if pairs:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["u", "v"])

    return run


def group_links(groups: DataFrame, items: DataFrame | None, by: Compared, most: int, tables: list[DataFrame]) -> DataFrame:
    """Links (u, v) that connect what links within each group of ``groups`` (key, id), all different rows.

    ``items`` (id, item) holds what is compared; without it that is the id. A group of more than
    ``most`` members is dealt to blocks, each with the group's smallest id as a common centre.
    What isn't linked to the centre within its block then visits the other blocks, so no link is
    lost, no task holds more than a block, and near copies of one member stay where they are.
    Adds the tables that it writes to ``tables``.
    """
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    kind = groups.schema["key"].dataType
    whole = lambda rows: rows.withColumn("item", F.col("id")) if items is None else rows.join(items, "id")
    every = lambda: F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("centre")).where("n > 1")
    blocks = written(sizes.select("key", "centre", F.ceil(F.col("n") / most).cast("int").alias("blocks")), "group-blocks")
    placed = written(groups.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "group-places")
    centres = blocks.where("blocks > 1").select("key", every(), F.col("centre").alias("id"))
    dealt = whole(placed.select("key", "block", "id").unionByName(centres).distinct()).select("key", "block", "id", "item")
    dealt = dealt.repartition(n, "key", "block").sortWithinPartitions("key", "block", "id")
    links = written(dealt.mapInArrow(_block_links(by, to_arrow_type(kind)), f"key {kind.simpleString()}, u binary, v binary"), "group-links")
    tables += [blocks, placed, links]
    found, hot = links.select("u", "v"), placed.where("blocks > 1")
    if not hot.isEmpty():
        labels = links.select("key", F.col("u").alias("id"), F.col("v").alias("label"))
        labelled = hot.join(labels, ["key", "id"], "left").withColumn("label", F.coalesce("label", "id"))
        guests = labelled.where("label <> centre").select("key", every(), F.lit(1).alias("kind"), "id", F.col("id").alias("label"), F.col("block").alias("home")).where("block <> home").drop("home")
        hosts = labelled.select("key", "block", F.lit(0).alias("kind"), "id", "label")
        visits = whole(hosts.unionByName(guests)).select("key", "block", "kind", "id", "label", "item")
        visits = visits.repartition(n, "key", "block").sortWithinPartitions("key", "block", "kind")
        tables.append(written(visits.mapInArrow(_guest_links(by), "u binary, v binary"), "guest-links"))
        found = found.unionByName(tables[-1])
    return found


def _matrix(col: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u8").reshape(-1, words)


def _binary(rows: np.ndarray) -> pa.Array:
    data = np.ascontiguousarray(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(8 * data.shape[1]), len(data), [None, pa.py_buffer(data)]).cast(pa.binary())


def _block_keys(plan: np.ndarray, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (print) to rows (key, fp) for the blocks of ``plan``, which begin at number ``first``: number and bits of the block, and what the Hamming check reads."""
        places = np.int64(1) << np.arange(plan.shape[1], dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                prints = _matrix(batch.column(0), WORDS)
                bits, fps = np.unpackbits(prints.view(np.uint8), axis=1, bitorder="little"), _binary(prints[:, :CHECKED])
                for k, block in enumerate(plan):
                    keys = bits[:, block].astype(np.int64) @ places + (first + k << MOST_BITS)
                    yield pa.RecordBatch.from_arrays([pa.array(keys), fps], ["key", "fp"])

    return run


def _hamming_links(by: ByBits, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (key, fp) sorted by key to links (null, u, v) within each key's bucket, or, of buckets over ``most``, to their rows (key, fp, fp)."""
        held: list[np.ndarray] = []
        now, size = None, 0

        def out(u: np.ndarray, v: np.ndarray, key: int | None) -> Iterator[pa.RecordBatch]:
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(u), pa.int64()), _binary(u), _binary(v)], ["key", "u", "v"])

        def finished() -> Iterator[pa.RecordBatch]:
            if 1 < size <= most:
                fps = np.concatenate(held)
                root = by.roots(fps)
                linked = np.flatnonzero(root != np.arange(size))
                yield from out(fps[linked], fps[root[linked]], None)

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, fps = batch.column(0).to_numpy(), _matrix(batch.column(1), CHECKED)
            bounds = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                if int(keys[lo]) != now:
                    yield from finished()
                    held, now, size = [], int(keys[lo]), 0
                held.append(fps[lo:hi])
                size += hi - lo
                if size > most:
                    for rows in held:
                        yield from out(rows, rows, now)
                    held = []
        yield from finished()

    return run


def fingerprint_links(prints: DataFrame, share: float, seed: int, most: int, tables: list[DataFrame]) -> DataFrame:
    """Links (u, v) between the checked words of the different long fingerprints of ``prints`` (print).

    Fingerprints that agree on a block of bits meet in a bucket, and those there within the
    distance of pairs that differ in such a ``share`` of bits are linked, by a star per connected
    group. ``most`` sets the members above which a bucket is dealt to several tasks, as a group is;
    the components of the links don't depend on it. Adds the tables that it writes to ``tables``.
    """
    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    prints = written(prints.distinct(), "prints")
    tables.append(prints)
    count, by, found = prints.count(), ByBits.at(share), []
    plan, step = block_plan(share, count, seed), max(ROUND, ROUND_ROWS // max(count, 1))
    for first in range(0, len(plan), step):
        keyed = prints.mapInArrow(_block_keys(plan[first : first + step], first), "key bigint, fp binary")
        dealt = keyed.repartition(n, "key").sortWithinPartitions("key")
        found.append(written(dealt.mapInArrow(_hamming_links(by, most), "key bigint, u binary, v binary"), "print-links"))
    tables += found
    every = reduce(DataFrame.unionByName, found)
    links, hot = every.where("key is null").select("u", "v"), every.where("key is not null")
    if not hot.isEmpty():
        links = links.unionByName(group_links(hot.select("key", F.col("u").alias("id")).distinct(), None, by, most, tables))
    return links


def similar_components(sets: DataFrame, shingle: int, least: float, seed: int, most: int = GROUP, bucket: int = BUCKET) -> DataFrame:
    """(id, root) of the different ids of ``sets`` that link to another and aren't the smallest of their component.

    Texts whose fingerprints are linked, directly or over others, form a group; each text goes to
    its group once, and all texts of a group are compared there by their shingles until they are
    connected. ``most`` and ``bucket`` set the texts of a group and the fingerprints of a bucket
    that one task compares; the result doesn't depend on them.
    """
    tables: list[DataFrame] = []
    some = sets.where("n > 0")
    # sizes of a similar pair differ by a factor of ``least`` at most: a pair is in one of the parts
    short, long = some.where(F.col("n") <= SHORT / least).select("print"), some.where(F.col("n") > SHORT).select("print")
    links = [fingerprint_links(part, differing(least, part is short), seed, bucket, tables) for part in (short, long)]
    near = components(links[0].unionByName(links[1])).select(F.col("node").alias("fp"), "root")
    prints = some.select("id", F.substring("print", 1, 8 * CHECKED).alias("fp")).distinct()
    groups = written(prints.join(near, "fp", "left").select(F.coalesce("root", "fp").alias("key"), "id"), "groups")
    texts = sets.dropDuplicates(["id"]).select("id", F.col("text").alias("item"))
    links = group_links(groups, texts, ByShingles(shingle, least, seed), most, tables)
    roots = components(links).select(F.col("node").alias("id"), "root")
    for table in [groups, *tables]:
        drop_written(table)
    return roots


def one_of_each(docs: DataFrame, shingle: int = STAGE_SHINGLE, least: float = STAGE_LEAST, seed: int = SEED, most: int = GROUP) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest doc_id.

    Two texts are linked if their sets of ``shingle``-word runs have a Jaccard similarity of at
    least ``least``. Of rows that share that doc_id the one with the smallest row hash stays, of
    wholly equal rows one. Documents without words are all alike. All columns are kept, whatever
    their names.
    """
    keyed = docs.select(F.struct("doc_id", row_hash(docs).alias("tie")).alias("doc_id"), "text")
    sets = written(shingle_sets(keyed, shingle, seed), "sets")
    roots = similar_components(sets, shingle, least, seed, most)
    firsts = sets.groupBy("id").agg(F.min("doc_id").alias("first")).join(roots, "id", "left")
    kept = written(firsts.groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("first").alias("first")).select("first.doc_id", "first.tie").distinct(), "kept")
    drop_written(sets)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("own_id"), row_hash(docs).alias("own_tie"))
    same = F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_tie") == F.col("tie"))
    return rows.join(kept, same).dropDuplicates(["own_id", "own_tie"]).select("row.*")
