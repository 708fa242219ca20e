"""Suffix-array removal of repeated passages: bytes covered by a string that occurs twice.

A byte goes if a string of ``LENGTH`` bytes covers it that starts anywhere else in the corpus.
Suffixes are sorted in many independent pieces:

* Anchors. Of every LENGTH-byte window the position of its smallest ``GRAM``-byte hash (the first
  of equal ones) is an anchor. Equal windows have their anchor at the same offset, so every
  repeated window shows as two anchors with equal grams. One in about 70 bytes is an anchor.
* Groups. Anchors with equal grams, with the bytes around them that a window can reach (LENGTH -
  GRAM to the left, LENGTH to the right), form a group; a gram that occurs once is dropped before
  any bytes are gathered.
* Leaves. Anchors of one gram whose whole surroundings agree are one leaf of the group's tree,
  with their number; a leaf of several is a repeat by itself. Leaves are told apart by 128 bits
  (the gram's hash and the surroundings'): among 10**12 anchors two different ones agree with a
  probability of about 10**-15. So are texts, and the members of a hot group.
* Enhanced suffix array: the suffixes of a batch of groups (from the anchor on) in order, with the
  lengths of common prefixes, none across groups. One stack scan yields the common-prefix intervals
  of all groups; an interval's members ordered by what precedes them give how far each extends to
  the left together with another one (left-extension diversity). Left and right together of at
  least LENGTH bytes make a maximal repeat: ``repeats`` marks its occurrences, ``repeat_groups``
  returns it with all of them.
* Hot groups (more leaves than a task's fair share, within ``SHARE_MEMBERS``) are split, not cut:
  windows that reach between lo and hi bytes to the left share the bytes from lo to the left up to
  LENGTH - hi to the right, so halving the range (lo, hi) splits the group by those bytes, in
  aggregations with partial sums, until groups are small or uniform, which they are at the latest
  when lo = hi. Members that agree over all that a range can reach become one leaf again.

Equal texts are treated once, with their number.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.llm.licenses import _mixed, _powers
from quillspark.llm.shared import tables_dropped, written

LENGTH, GRAM = 200, 64
#: Least and most members of a group that count as a task's fair share (at most 3 MB, a quarter of a second).
SHARE_MEMBERS = (1024, 8192)
#: Window starts treated at a time, and rows of adjacent suffixes compared at a time.
CHUNK, ROWS = 1 << 18, 1 << 14


def anchors(data: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, gram hashes and context hashes (signed) of the anchors of all windows of a text.

    The context is all that a window around the anchor can reach, with where the text ends.
    """
    places, grams, contexts = [], [], []
    width, before = length - gram + 1, length - gram
    up, down = _powers(1 << 19)
    for at in range(0, len(data) - length + 1, CHUNK):
        base = max(0, at - before)
        part = np.frombuffer(data[base : at + CHUNK + 2 * length], np.uint8)
        stop = min(at + CHUNK, len(data) - length + 1) + width - 1
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[: len(part)], dtype=np.uint64)])
            first = np.arange(at - base, stop - base)
            hashes = _mixed((sums[first + gram] - sums[first]) * down[first])
            least = (hashes & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(hashes), dtype=np.uint64)
            reach = 1
            while 2 * reach <= width:
                least = np.minimum(least[:-reach], least[reach:])
                reach *= 2
            if width > reach:
                least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
            picked = (least & np.uint64(0xFFFFFF)).astype(np.int64)
            picked = picked[np.concatenate([[True], picked[1:] != picked[:-1]])]
            place = picked + at
            a, b = np.maximum(place - before, 0), np.minimum(place + length, len(data))
            around = (sums[b - base] - sums[a - base]) * down[a - base]
            ends = ((place - a) * (length + 1) + (b - place)).astype(np.uint64)
            contexts.append(_mixed(around + _mixed(ends * np.uint64(0x9E3779B97F4A7C15))).view(np.int64))
        places.append(place)
        grams.append(hashes[picked].view(np.int64))
    if not places:
        return (np.empty(0, np.int64),) * 3
    place, first = np.unique(np.concatenate(places), return_index=True)
    return place, np.concatenate(grams)[first], np.concatenate(contexts)[first]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each row of two byte matrices."""
    out = np.empty(len(a), np.int64)
    for at in range(0, len(a), ROWS):
        other = a[at : at + ROWS] != b[at : at + ROWS]
        out[at : at + ROWS] = np.where(other.any(axis=1), other.argmax(axis=1), a.shape[1])
    return out


def _ordered(group: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The order of rows of bytes (padded; ``sizes`` are real) within groups, groups in turn."""
    m = len(group)
    keys = np.concatenate([group.astype(">u4").view(np.uint8).reshape(m, 4), rows, sizes.astype(">u2").view(np.uint8).reshape(m, 2)], axis=1)
    return np.argsort(np.ascontiguousarray(keys).view(f"S{keys.shape[1]}").ravel(), kind="stable")


def intervals(common: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of a suffix array, by a stack scan.

    ``common[k]`` is the length of the common prefix of suffixes k and k + 1.
    """
    stack = [(0, 0)]
    for k, length in enumerate([*common.tolist(), -1]):
        first = k
        while stack and stack[-1][0] > length:
            top, first = stack.pop()
            if top > 0:
                yield top, first, k
        if length >= 0 and (not stack or stack[-1][0] < length):
            stack.append((length, first))


class SuffixTree:
    """Enhanced suffix array of a batch of groups: leaves in suffix order, common prefixes, left contexts.

    ``left`` holds the preceding bytes from the anchor backwards, ``right`` those from it on, both
    padded; ``ll`` and ``rl`` are how many are real. ``lo`` and ``hi`` are how far to the left
    a group's windows reach at least and at most; ``group`` ascends.
    """

    def __init__(self, left, right, ll, rl, lo, hi, group, length: int):
        self.left, self.ll, self.lo, self.hi, self.length = left, ll, lo, hi, length
        self.order = _ordered(group, right, rl)
        here, there = self.order[:-1], self.order[1:]
        common = np.minimum(_common(right[here], right[there]), np.minimum(rl[here], rl[there]))
        self.common = np.where(group[here] == group[there], common, 0)
        self.by_left = np.empty(len(group), np.int64)
        self.by_left[_ordered(group, left, ll)] = np.arange(len(group))

    def maximal(self) -> Iterator[tuple[int, int, int, int, np.ndarray, np.ndarray]]:
        """(common, right reach, first, last, members by left context, common left of neighbours) of the intervals
        whose windows can be long enough. Intervals of two come as one array each, with common -1."""
        found = [x for x in intervals(self.common)]
        if not found:
            return
        common, first, last = (np.array(x) for x in zip(*found, strict=True))
        one = self.order[first]
        right = np.minimum(common, self.length - self.lo[one])
        able = right >= self.length - self.hi[one]
        two = np.flatnonzero(able & (last == first + 1))
        if len(two):
            i, j = self.order[first[two]], self.order[last[two]]
            near = np.minimum(np.minimum(_common(self.left[i], self.left[j]), np.minimum(self.ll[i], self.ll[j])), self.hi[i])
            yield -1, right[two], first[two], last[two], np.stack([i, j]), near
        for k in np.flatnonzero(able & (last > first + 1)):
            members = self.order[first[k] : last[k] + 1]
            members = members[np.argsort(self.by_left[members])]
            a, b = members[:-1], members[1:]
            near = np.minimum(np.minimum(_common(self.left[a], self.left[b]), np.minimum(self.ll[a], self.ll[b])), self.hi[members[0]])
            yield int(common[k]), int(right[k]), int(first[k]), int(last[k]), members, near

    def reach(self) -> tuple[np.ndarray, np.ndarray]:
        """How far left and right of the anchor each leaf's repeats reach (-1: none)."""
        best_l, best_r = np.full(len(self.order), -1), np.full(len(self.order), -1)
        for common, right, _, _, members, near in self.maximal():
            if common < 0:
                good = near + right >= self.length
                for side in members:
                    np.maximum.at(best_l, side[good], near[good])
                    np.maximum.at(best_r, side[good], right[good])
                continue
            l = np.maximum(np.concatenate([near, [-1]]), np.concatenate([[-1], near]))
            good = l + right >= self.length
            some = members[good]
            best_l[some], best_r[some] = np.maximum(best_l[some], l[good]), np.maximum(best_r[some], right)
        return best_l, best_r

    def groups(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(left reach, right reach, leaves) of every maximal repeat of several leaves, all of its leaves together."""
        place = np.empty(len(self.order), np.int64)
        place[self.order] = np.arange(len(self.order))
        for common, right, _, _, members, near in self.maximal():
            if common < 0:
                for k in np.flatnonzero(near + right >= self.length):
                    yield int(near[k]), int(right[k]), members[:, k]
                continue
            for l, a, b in intervals(near):
                if l + right >= self.length:
                    some = members[a : b + 1]
                    at = place[some]
                    if self.common[at.min() : at.max()].min() == common:  # else a smaller interval holds them all
                        yield l, right, some


def _tree(rows: pa.Table, length: int, gram: int) -> tuple[dict, np.ndarray, SuffixTree]:
    before = length - gram
    col = {n: rows.column(n).to_numpy() for n in ("key", "lo", "hi", "t1", "t2", "place", "ll", "rl", "class")}
    around = np.frombuffer(rows.column("around").combine_chunks().cast(pa.binary(before + length)).buffers()[1], np.uint8)
    around = around.reshape(-1, before + length)[: len(rows)]
    new = np.concatenate([[True], (col["key"][1:] != col["key"][:-1]) | (col["lo"][1:] != col["lo"][:-1]) | (col["hi"][1:] != col["hi"][:-1])])
    ll, rl = col["ll"].astype(np.int64), col["rl"].astype(np.int64)
    tree = SuffixTree(around[:, :before][:, ::-1], around[:, before:], ll, rl, col["lo"].astype(np.int64), col["hi"].astype(np.int64), np.cumsum(new) - 1, length)
    return col, around, tree


MARKS = "t1 bigint, t2 bigint, a bigint, b bigint"
GROUPS = "g1 bigint, g2 bigint, length int, before int, class bigint"


def _marks(rows: pa.Table, length: int, gram: int) -> pa.RecordBatch:
    """Runs of bytes to remove: ``MARKS`` of every leaf that some repeat holds."""
    col, _, tree = _tree(rows, length, gram)
    best_l, best_r = tree.reach()
    k = np.flatnonzero(best_l >= 0)
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (col["t1"][k], col["t2"][k], col["place"][k] - best_l[k], col["place"][k] + best_r[k])], ["t1", "t2", "a", "b"])


def _groups(rows: pa.Table, length: int, gram: int) -> pa.RecordBatch:
    """Maximal repeats: ``GROUPS`` of every leaf of each, (g1, g2) being 128 bits over its bytes.

    A leaf of several anchors is one too, whether or not others share it.
    """
    col, around, tree = _tree(rows, length, gram)
    before, out = length - gram, [[] for _ in range(5)]

    def add(l: int, r: int, leaves: np.ndarray) -> None:
        text = around[leaves[0], before - l : before + r].tobytes()
        if l not in anchors(text, length, gram)[0]:
            return  # its windows have other anchors, which show it wherever it occurs
        g1, g2 = np.frombuffer(xxhash.xxh3_128_digest(text), "<i8")
        for k in leaves:
            for values, x in zip(out, (g1, g2, l + r, l, col["class"][k]), strict=True):
                values.append(int(x))

    for l, r, leaves in tree.groups():
        add(l, r, leaves)
    several = rows.column("several").to_numpy(zero_copy_only=False)
    for k in np.flatnonzero(several):
        l, r = int(min(col["ll"][k], col["hi"][k])), int(min(col["rl"][k], length - col["lo"][k]))
        if l + r >= length:
            add(l, r, np.array([k]))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()), strict=True)], ["g1", "g2", "length", "before", "class"])


def _by_groups(treat, length: int, gram: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by key, lo and hi; the last group of one waits for the next."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(batch.schema.get_field_index(n)).to_numpy() for n in ("key", "lo", "hi")), strict=True))
            cut = len(keys) - 1
            while cut and keys[cut - 1] == keys[-1]:
                cut -= 1
            if held and (cut or tuple(held[-1].slice(held[-1].num_rows - 1).to_pylist()[0][n] for n in ("key", "lo", "hi")) != keys[0]):
                yield treat(pa.Table.from_batches([*held, batch.slice(0, cut)]), length, gram)
                held = []
            elif cut:
                yield treat(pa.Table.from_batches([batch.slice(0, cut)]), length, gram)
            held.append(batch.slice(cut))
        if held:
            yield treat(pa.Table.from_batches(held), length, gram)

    return run


MEMBER = "key bigint, lo int, hi int, t1 bigint, t2 bigint, place bigint, ll int, rl int, class bigint, several boolean, around binary"


def _members(texts: DataFrame, picked: DataFrame, length: int, gram: int) -> DataFrame:
    """Leaves of ``picked`` (t1, t2, place, gram, class, several) with the bytes around them."""
    before = length - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(3)
            sizes = np.diff(own.offsets.to_numpy())
            flat = own.flatten()
            place, grams, classes = (flat.field(k).to_numpy() for k in (0, 1, 2))
            several = flat.field(3).to_numpy(zero_copy_only=False)
            t1, t2 = (np.repeat(batch.column(k).to_numpy(), sizes) for k in (0, 1))
            of = np.repeat(np.arange(len(sizes)), sizes)
            for at in range(0, len(place), 8192):
                s = slice(at, at + 8192)
                around, ll, rl, held, data = [], [], [], -1, b""
                for k, p in zip(of[s].tolist(), place[s].tolist(), strict=True):
                    if k != held:
                        held, data = k, batch.column(2)[k].as_buffer().to_pybytes()
                    l, r = min(p, before), min(len(data) - p, length)
                    around.append(bytes(before - l) + data[p - l : p + r] + bytes(length - r))
                    ll.append(l)
                    rl.append(r)
                n = len(ll)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(grams[s]), pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, before, np.int32)), pa.array(t1[s]), pa.array(t2[s]), pa.array(place[s].astype(np.int64)), pa.array(ll, pa.int32()), pa.array(rl, pa.int32()), pa.array(classes[s]), pa.array(several[s], pa.bool_()), pa.array(around, pa.binary())],
                    [f.split()[0] for f in MEMBER.split(", ")],
                )

    own = picked.groupBy("t1", "t2").agg(F.collect_list(F.struct("place", "gram", "class", "several")).alias("own"))
    return texts.join(own, ["t1", "t2"]).select("t1", "t2", "data", "own").mapInArrow(run, MEMBER)


def _split_hot(members: DataFrame, length: int, gram: int, most: int, tables: list[DataFrame]) -> tuple[list[DataFrame], list[DataFrame], list[DataFrame]]:
    """Splits groups until each has at most ``most`` leaves: (members, marks, classes).

    Members whose bytes are equal over all that a range of windows can reach repeat there wholly;
    one of them stands for all in the next round, as the class (parent) of their classes (child).
    """

    def kept(df: DataFrame, kind: str) -> DataFrame:
        tables.append(written(df, kind))
        return tables[-1]

    before = length - gram
    small, marks, classes, now = [], [], [], kept(members, "hot")
    names = [f.split()[0] for f in MEMBER.split(", ")]
    while True:
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        halves = F.explode(F.array(F.struct(F.col("lo").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("hi").alias("b"))))
        rows = now.withColumn("half", halves).where("half.a <= half.b").withColumn("lo", F.col("half.a")).withColumn("hi", F.col("half.b")).drop("half")
        rows = rows.where(f"ll >= lo and rl >= {length} - hi")
        core = F.expr(f"substring(around, {before + 1} - lo, {length} - hi + lo)")
        whole = F.expr(f"substring(around, {before + 1} - hi, {length} - lo + hi)")
        rows = rows.withColumn("key", F.xxhash64("lo", "hi", core)).withColumn("whole", F.xxhash64(F.least("ll", "hi"), F.least("rl", F.lit(length) - F.col("lo")), whole))
        rows = kept(rows, "hot-halves")
        equal = rows.groupBy("key", "lo", "hi", "whole").agg(F.count(F.lit(1)).alias("n"), F.max("several").alias("any_several"), F.min(F.struct("t1", "t2", "place")).alias("one"))
        equal = kept(equal.withColumn("parent", F.xxhash64("key", "lo", "hi", "whole", F.lit("class"))), "hot-equal")
        groups = kept(equal.groupBy("key", "lo", "hi").agg(F.count(F.lit(1)).alias("different")), "hot-sizes")
        known = kept(equal.join(groups, ["key", "lo", "hi"]).where("n > 1 or different > 1 or any_several"), "hot-groups")
        rows = kept(rows.join(known, ["key", "lo", "hi", "whole"]).drop("whole"), "hot-split")
        l, r = F.least("ll", "hi"), F.least("rl", F.lit(length) - F.col("lo"))
        marks.append(rows.where("n > 1 or any_several").where(l + r >= length).select("t1", "t2", (F.col("place") - l).alias("a"), (F.col("place") + r).alias("b")))
        classes.append(rows.select("parent", F.col("class").alias("child")))
        left = rows.where(F.struct("t1", "t2", "place") == F.col("one")).withColumn("class", F.col("parent")).withColumn("several", F.col("any_several") | (F.col("n") > 1))
        small.append(left.where(f"different <= {most}").select(*names))
        now = left.where(f"different > {most}").select(*names)
        if now.isEmpty():
            return small, marks, classes


def _merged(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """The maximal runs that intervals [a, b) cover."""
    if not len(a):
        return []
    order = np.argsort(a, kind="stable")
    a, reach = a[order], np.maximum.accumulate(b[order])
    new = np.flatnonzero(a[1:] > reach[:-1]) + 1
    firsts, lasts = np.concatenate([[0], new]), np.concatenate([new, [len(a)]]) - 1
    return list(zip(a[firsts].tolist(), reach[lasts].tolist(), strict=True))


def _digest(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))]
        for batch in batches:
            marks = batch.column(4)
            ends = marks.offsets.to_numpy()
            flat = marks.values
            starts_of, ends_of = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            out = []
            for k, n in enumerate(batch.column(2).to_pylist()):
                data = memoryview(batch.column(3)[k].as_buffer())
                own = slice(ends[k], ends[k + 1])
                spans = [(0, len(data))] if n > 1 and len(data) >= length else _merged(starts_of[own], ends_of[own])
                kept, at = hashlib.sha256(), 0
                for a, b in spans:
                    kept.update(data[at:a])
                    at = b
                kept.update(data[at:])
                out.append((len(data), sum(b - a for a, b in spans), len(spans), kept.hexdigest(), [{"a": a, "b": b} for a, b in spans]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["t1", "t2", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return run


def _keys() -> list:
    data = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return [F.xxhash64(data).alias("t1"), F.xxhash64(F.lit(7), data).alias("t2")]


def _texts(docs: DataFrame, n: int) -> DataFrame:
    """Different texts (t1, t2, data) with their number n, dealt by (t1, t2)."""
    data = F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")
    rows = docs.select(*_keys(), data.alias("data")).groupBy("t1", "t2").agg(F.first("data").alias("data"), F.count(F.lit(1)).alias("n"))
    return written(rows, "texts")


def _leaves(texts: DataFrame, length: int, gram: int, tables: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(anchors whose gram occurs twice, leaves of their groups): both with ``class``, the leaf's 64 bits."""
    before = length - gram

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple]) -> pa.RecordBatch:
            counts = [len(r[2]) for r in rows]
            t1, t2, size = (np.repeat(np.array([r[k] for r in rows], np.int64), counts) for k in (0, 1, 5))
            place, grams, contexts = (np.concatenate([r[k] for r in rows]) for k in (2, 3, 4))
            cols = [t1, t2, place, grams, contexts, np.minimum(place, before).astype(np.int16), np.minimum(size - place, length).astype(np.int16)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["t1", "t2", "place", "gram", "context", "ll", "rl"])

        for batch in batches:
            rows, size = [], 0
            for t1, t2, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = x.as_buffer().to_pybytes()
                rows.append((t1, t2, *anchors(data, length, gram), len(data)))
                size += len(data)
                if size >= CHUNK:
                    yield out(rows)
                    rows, size = [], 0
            if rows:
                yield out(rows)

    kind = "t1 bigint, t2 bigint, place bigint, gram bigint, context bigint, ll smallint, rl smallint"
    every = written(texts.where(F.octet_length("data") >= length).select("t1", "t2", "data").mapInArrow(found, kind), "anchors")
    tables.append(every)
    twice = written(every.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    tables.append(twice)
    picked = written(every.join(twice, "gram"), "picked")
    tables.append(picked)
    leaves = written(picked.groupBy("gram", "context").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("t1", "t2", "place")).alias("one")), "leaves")
    tables.append(leaves)
    sizes = written(leaves.groupBy("gram").agg(F.count(F.lit(1)).alias("members")), "sizes")
    tables.append(sizes)
    leaves = leaves.join(sizes, "gram").select("gram", "context", "one.*", "members", (F.col("n") > 1).alias("several"), _class())
    return picked, leaves


def _class() -> Column:
    return F.xxhash64("gram", "context").alias("class")


def _members_of_all(texts: DataFrame, leaves: DataFrame, length: int, gram: int, most: int | None, n: int, tables: list[DataFrame]) -> tuple[DataFrame, list[DataFrame], list[DataFrame]]:
    """(members of groups small enough for a task, dealt and sorted; marks; classes) of all leaves."""
    picked = written(leaves, "members")
    tables.append(picked)
    if most is None:
        most = min(max(picked.count() // n, SHARE_MEMBERS[0]), SHARE_MEMBERS[1])
    groups, marks, classes = [_members(texts, picked.where(F.col("members") <= most), length, gram)], [], []
    hot = picked.where(F.col("members") > most)
    if not hot.isEmpty():
        small, marks, classes = _split_hot(_members(texts, hot, length, gram), length, gram, most, tables)
        groups += small
    members = groups[0]
    for g in groups[1:]:
        members = members.unionByName(g)
    return members.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi"), marks, classes


def repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int | None = None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): what goes because a string of ``length`` bytes repeats.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 (of the bytes
    that stay) and spans (start and end byte of each run). Texts are UTF-8 bytes, null is empty;
    matches don't cross documents; equal rows are occurrences of each other; texts shorter than
    ``length`` keep all; a text of any length is read whole, in chunks; an empty table gives an empty
    result. Strings are judged on the input. ``most`` sets the leaves above which a group is split;
    the result doesn't depend on it. Tables between are deleted when the result is there, or fails.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with tables_dropped([]) as tables:
        texts = _texts(docs, n)
        tables.append(texts)
        picked, leaves = _leaves(texts, length, gram, tables)
        # a leaf of several anchors is a repeat by itself: all of them are marked as far as it reaches
        same = leaves.where("several").select("gram", "context")
        equal = picked.where(F.col("ll") + F.col("rl") >= length).join(same, ["gram", "context"], "left_semi")
        members, marks, _ = _members_of_all(texts, leaves.where("members > 1"), length, gram, most, n, tables)
        found = members.mapInArrow(_by_groups(_marks, length, gram), MARKS)
        for m in [equal.select("t1", "t2", (F.col("place") - F.col("ll")).alias("a"), (F.col("place") + F.col("rl")).alias("b")), *marks]:
            found = found.unionByName(m)
        tables.append(written(found, "marks"))
        per_text = tables[-1].groupBy("t1", "t2").agg(F.collect_list(F.struct("a", "b")).alias("marks"))
        kinds = "t1 bigint, t2 bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<struct<a:bigint,b:bigint>>"
        result = written(texts.join(per_text, ["t1", "t2"], "left").select("t1", "t2", "n", "data", "marks").mapInArrow(_digest(length), kinds), "removed")
    rows = docs.select("doc_id", *_keys())
    return rows.join(result, ["t1", "t2"]).drop("t1", "t2")


def repeat_groups(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int | None = None) -> DataFrame:
    """Maximal repeats of ``length`` bytes or more around anchors, each with all its occurrences.

    Returns group_id (hex, 128 bits over the bytes), length, doc_id and start (byte), a row for each
    occurrence. A repeat is maximal if its occurrences extend alike neither to the left nor to the
    right, or only beyond what a window around the anchor reaches (``length - gram`` bytes to its
    left, ``length`` to its right; in a hot group, what its range of windows reaches); a longer
    passage shows as one group for each of its anchors. Equal texts are occurrences each; what doesn't
    repeat doesn't appear, so an empty table gives no rows.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    with tables_dropped([]) as tables:
        texts = _texts(docs, n)
        tables.append(texts)
        picked, leaves = _leaves(texts, length, gram, tables)
        # equal texts are one text here, so a leaf of a text that occurs several times is of several too
        again = texts.where("n > 1").select("t1", "t2")
        alone = written(texts.where(F.octet_length("data") >= 0).join(again, ["t1", "t2"], "left_semi").select("t1", "t2"), "again")
        tables.append(alone)
        more = picked.join(alone, ["t1", "t2"], "left_semi").select("gram", "context").distinct().withColumn("more", F.lit(True))
        leaves = leaves.join(more, ["gram", "context"], "left").withColumn("several", F.col("several") | F.coalesce("more", F.lit(False))).drop("more")
        members, _, classes = _members_of_all(texts, leaves.where("members > 1 or several"), length, gram, most, n, tables)
        found = written(members.mapInArrow(_by_groups(_groups, length, gram), GROUPS).distinct(), "groups")
        tables.append(found)
        for step in reversed(classes):
            step = step.where("parent <> child").distinct()
            found = found.join(step, F.col("class") == F.col("parent"), "left").withColumn("class", F.coalesce("child", "class")).drop("parent", "child").distinct()
        places = picked.select(_class(), "t1", "t2", "place")
        spots = found.join(places, "class").select("g1", "g2", "length", "t1", "t2", (F.col("place") - F.col("before")).alias("start")).distinct()
        result = written(spots, "repeat-groups")
    rows = docs.select("doc_id", *_keys())
    ident = F.concat(F.lpad(F.lower(F.hex("g1")), 16, "0"), F.lpad(F.lower(F.hex("g2")), 16, "0")).alias("group_id")
    return rows.join(result, ["t1", "t2"]).select(ident, "length", "doc_id", "start")
