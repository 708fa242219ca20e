"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are integer-quantised. Queries are sparse rows of (term, weight); candidates are packed in
blocks of at most ``BLOCK`` rows, each with a postings list per term. For a query and a block,
every term of the query scatters its weight times the postings into a dense array of the block's
scores; partition selection keeps the block's best, and the blocks' lists are merged by rank.
All candidates are scored: nothing is pruned, capped or approximate.

Query rows are packed in blocks too. A candidate block goes to Python once, as the first row of its
group; the query blocks stream after it, so a task holds one block of each kind at a time, whatever
the number of either. Components travel in as few bytes as a block's largest needs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import written

SCALE = 256
TOP = 5
BLOCK, QUERIES = 32_768, 512


def quantised(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id and q, the components as floor(scale * x); vectors that are null or hold null or
    non-finite components are left out, rows without an id too, and repeated rows stay."""
    x = F.col("embedding")
    good = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    q = F.transform(x, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))
    return vectors.where(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


PACKED = "part int, kind int, width int, rows binary, ids binary, sizes binary, values binary"
CANDIDATES, ASKED = 0, 1


def _packed(rows: DataFrame, parts: int, kind: int, name: str) -> DataFrame:
    """Rows (row, vec_id, q) dealt evenly to ``parts`` blocks, a row of ``PACKED`` each (empty ones are left out)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = [b for b in batches if b.num_rows]
        if not held:
            return
        some = pa.Table.from_batches(held).combine_chunks()
        row, ids, q = some.column(0).to_numpy(), some.column(1).to_numpy(), some.column(2).chunk(0)
        sizes = np.diff(q.offsets.to_numpy(zero_copy_only=False))
        values = q.flatten().to_numpy(zero_copy_only=False)
        low, high = (int(values.min()), int(values.max())) if len(values) else (0, 0)
        width = next(w for w in (1, 2, 4, 8) if -(1 << (8 * w - 1)) <= low and high < 1 << (8 * w - 1))
        packed = [pa.array([a.astype(t).tobytes()], pa.binary()) for a, t in ((row, "<i8"), (ids, "<i8"), (sizes, "<i4"), (values, f"<i{width}"))]
        yield pa.RecordBatch.from_arrays([*[pa.array([x], pa.int32()) for x in (TaskContext.get().partitionId(), kind, width)], *packed], [f.split()[0] for f in PACKED.split(", ")])

    packed = rows.select("row", "vec_id", "q").repartition(parts).mapInArrow(run, PACKED)
    return written(packed, name)


def _rows(sizes: bytes, values: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and weight of every non-zero component."""
    n = np.frombuffer(sizes, "<i4")
    weights = np.frombuffer(values, f"<i{width}").astype(np.int64)
    row = np.repeat(np.arange(len(n)), n)
    term = np.arange(len(weights)) - np.repeat(np.cumsum(n) - n, n)
    some = weights != 0
    return row[some], term[some], weights[some]


def best_of_block(query: tuple[np.ndarray, np.ndarray], postings: dict[int, tuple[np.ndarray, np.ndarray]], rows: np.ndarray, ids: np.ndarray, own: int, top: int, scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the ``top`` best of one block, ties to smaller ids, the query's own row left out."""
    scores[:] = 0
    for term, weight in zip(*query, strict=True):
        if (found := postings.get(int(term))) is not None:
            at, weights = found
            if len(at) == len(scores):
                scores += weight * weights
            else:
                scores[at] += weight * weights
    allowed = np.flatnonzero(rows != own)
    values = scores[allowed]
    if len(values) > top:
        least = np.partition(values, len(values) - top)[len(values) - top]
        near = np.flatnonzero(values >= least)
        allowed, values = allowed[near], values[near]
    order = np.lexsort((ids[allowed], -values))[:top]
    return ids[allowed][order], values[order]


def top_k(vectors: DataFrame, is_query: Column, top: int = TOP, scale: int = SCALE, block: int = BLOCK, queries: int = QUERIES) -> DataFrame:
    """For every vector of ``vectors`` (vec_id, embedding) that ``is_query`` (of vec_id) picks: its best others.

    Returns query_id, rank (from 1), vec_id and score (integer inner product of the quantised
    vectors; components that only one of two vectors has count as 0): the ``top`` highest scores,
    or all if there are fewer, ties to the smaller vec_id. Vectors that are null, or hold null or
    non-finite components, and rows without an id take no part. Rows that repeat an id, with the
    same components or others, are queries and candidates of their own: only a query's own row is
    left out. No query or no other vector: no rows.
    """
    spark = vectors.sparkSession
    rows = written(quantised(vectors, scale).select(F.monotonically_increasing_id().alias("row"), "vec_id", "q"), "vectors")
    count, asking = rows.count(), rows.where(is_query).count()
    parts = max(1, -(-count // block), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // 1024)))
    candidates = _packed(rows, parts, CANDIDATES, "candidates")
    asked = _packed(rows.where(is_query), max(1, -(-asking // queries)), ASKED, "queries")
    everywhere = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    dealt = candidates.unionByName(asked.drop("part").select("*", everywhere)).repartition(parts, "part").sortWithinPartitions("part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, postings, own_rows, ids, scores = None, {}, None, None, None
        for batch in batches:
            for at in range(batch.num_rows):
                c = {n: batch.column(k)[at] for k, n in enumerate(batch.schema.names)}
                part, width = c["part"].as_py(), c["width"].as_py()
                of, term, weight = _rows(c["sizes"].as_buffer(), c["values"].as_buffer(), width)
                some_rows, some_ids = (np.frombuffer(c[n].as_buffer(), "<i8") for n in ("rows", "ids"))
                if c["kind"].as_py() == CANDIDATES:
                    order = np.argsort(term, kind="stable")
                    terms, firsts = np.unique(term[order], return_index=True)
                    cuts = [*firsts, len(order)]
                    postings = {int(t): (of[order[a:b]], weight[order[a:b]]) for t, a, b in zip(terms, cuts, cuts[1:], strict=False)}
                    held, own_rows, ids, scores = part, some_rows.copy(), some_ids.copy(), np.zeros(len(some_ids), np.int64)
                    continue
                if held != part:
                    continue  # a block that got no vectors
                cuts = np.searchsorted(of, np.arange(len(some_ids) + 1))
                found = []
                for k, own in enumerate(some_rows):
                    mine = slice(cuts[k], cuts[k + 1])
                    best, values = best_of_block((term[mine], weight[mine]), postings, own_rows, ids, own, top, scores)
                    found.append((np.full(len(best), some_ids[k]), np.full(len(best), own), best, values))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[j] for f in found]).astype(np.int64)) for j in range(4)], ["query_id", "row", "vec_id", "score"])

    found = dealt.mapInArrow(run, "query_id bigint, row bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id", "row").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")
