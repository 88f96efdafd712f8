"""Largest inner products by an adaptive scan over dimensions within probed lists.

Index: centroids are fitted on a bounded sample (``SAMPLE_ROWS`` vectors, those with the least
hashes of the row's number); every vector goes to the list of its nearest centroid, and lists are stored in
blocks of at most about ``BLOCK_ROWS`` vectors, so a crowded list is many blocks. Search:
a query probes its nearest lists. A block's vectors are rotated by one random rotation
and laid out in blocks of ``COLUMNS`` columns. After each of these the distance so far,
scaled up to all dimensions, is tested against the distance that the query's 20th best
allows, for many queries at once; a candidate for which the hypothesis "it is near enough" is rejected at the
bound ``1 + strictness / sqrt(d)`` is abandoned. What survives is scored on the original
vectors in double precision. The nearest list is searched first, and the other lists
start from the bound found there, so they send on little more than what is better.

Inner products become distances by the norms: ``d2 = |q|^2 + |x|^2 - 2 q.x``.

The vectors of a block come to a task before its queries, which pass by one after the other;
a block is copied only where more than ``QUERY_ROWS`` queries have to be dealt over tasks.

Vectors that are null, zero, or hold null or non-finite components take no part, and
neither do those whose number of components is not the most frequent one: they have no
inner product with the others. Ids are whole numbers; rows without one take no part. A
query's own row is told by a number of its own, so other rows with its id are candidates,
and each row with a repeated query id is searched for itself. An empty table gives no rows.
Only the id and the vector are used.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkgauge.llm.common import add_columns, column, stored

SAMPLE_ROWS = 16_384
LIST_ROWS = 500
MOST_LISTS = 4_096
BLOCK_ROWS = 4_096
QUERY_ROWS = 1 << 17
#: Pairs of a query and a vector that are tested at once.
PAIRS = 1 << 18
COLUMNS = 16
SEED = 7


def valid_vectors(df: DataFrame, vec_id: str, embedding: str, keep: dict[str, Column]) -> DataFrame:
    """(vec_id, vector) of the rows that take part, and the columns ``keep``."""
    v = F.col("vector")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = df.select(column(vec_id).alias("vec_id"), column(embedding).cast("array<double>").alias("vector"), *[c.alias(n) for n, c in keep.items()])
    rows = rows.filter(F.col("vec_id").isNotNull() & v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0))
    usual = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    return rows.join(F.broadcast(usual.select("n")), F.size("vector") == F.col("n"), "left_semi")


def matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else np.zeros((0, 0))


def fit_centroids(sample: np.ndarray, lists: int, rounds: int = 10) -> np.ndarray:
    """k-means; an empty cluster keeps its centre."""
    random = np.random.default_rng(SEED)
    centres = sample[random.choice(len(sample), lists, replace=False)]
    for _ in range(rounds):
        near = nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        count = np.bincount(near, minlength=lists)
        centres = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centres)
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres**2).sum(axis=1) - 2 * rows @ centres.T).argmin(axis=1)


def rotation(size: int) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((size, size)))[0]


class Block:
    """Vectors of one block of a list, rotated and laid out in column blocks."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, strictness: float):
        self.rows, self.ids, self.vectors = rows, ids, vectors
        self.size = vectors.shape[1]
        self.turn = rotation(self.size)
        turned = vectors @ self.turn
        self.norms = (vectors**2).sum(axis=1)
        self.parts = [np.ascontiguousarray(turned[:, a:a + COLUMNS]) for a in range(0, self.size, COLUMNS)]
        self.part_norms = [(p**2).sum(axis=1) for p in self.parts]
        ends = np.minimum(np.arange(1, len(self.parts) + 1) * COLUMNS, self.size)
        self.bounds = ends / self.size * (1 + strictness / np.sqrt(ends)) ** 2

    def search(self, own: int, query: np.ndarray, k: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of up to k best with a score of at least ``floor`` (-inf: no bound yet)."""
        turned, norm = query @ self.turn, float(query @ query)
        live = np.flatnonzero(self.rows != own)
        if math.isinf(floor) and len(live) > k:  # a first bound from part of the block
            first = live[:4 * k]
            floor = float(np.partition((self.vectors[first] * query).sum(axis=1), -k)[-k]) - 1e-9
        far = np.zeros(len(live))
        for at, (part, norms, bound) in enumerate(zip(self.parts, self.part_norms, self.bounds)):
            q = turned[at * COLUMNS:at * COLUMNS + part.shape[1]]
            far = far + norms[live] + float(q @ q) - 2 * (part @ q if len(live) == len(part) else part[live] @ q)
            if at + 1 < len(self.parts) and not math.isinf(floor):
                near = far <= bound * np.maximum(norm + self.norms[live] - 2 * floor, 0) + 1e-9
                live, far = live[near], far[near]
        if not math.isinf(floor):
            live = live[(norm + self.norms[live] - far) / 2 >= floor - 1e-9]
        scores = (self.vectors[live] * query).sum(axis=1)
        if not math.isinf(floor):
            live, scores = live[scores >= floor], scores[scores >= floor]
        best = np.lexsort((self.ids[live], -scores))[:k]
        return self.ids[live[best]], scores[best]

    def search_many(self, owns: np.ndarray, queries: np.ndarray, k: int, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for queries that all have a bound: (place of the query, id, score), each query's best first.

        The tests are the same; what a test rejects is marked instead of left out, so that matrix products take the place of a call for each query.
        """
        turned, norms, floor = queries @ self.turn, (queries**2).sum(axis=1)[:, None], floors[:, None]
        live = self.rows[None, :] != owns[:, None]
        far, near = np.zeros(live.shape), np.maximum(norms + self.norms[None, :] - 2 * floor, 0)
        for at, (part, part_norms, bound) in enumerate(zip(self.parts, self.part_norms, self.bounds)):
            q = turned[:, at * COLUMNS:at * COLUMNS + part.shape[1]]
            far += q @ (-2 * part.T)
            far += part_norms[None, :]
            far += (q**2).sum(axis=1)[:, None]
            if at + 1 < len(self.parts):
                live &= far <= bound * near + 1e-9
        live &= (norms + self.norms[None, :] - far) / 2 >= floor - 1e-9
        place, at = np.nonzero(live)
        scores = (self.vectors[at] * queries[place]).sum(axis=1)
        enough = scores >= floors[place]
        place, ids, scores = place[enough], self.ids[at[enough]], scores[enough]
        order = np.lexsort((ids, -scores, place))
        order = order[np.arange(len(order)) - np.searchsorted(place[order], place[order], "left") < k]
        return place[order], ids[order], scores[order]


def _scan(blocks: DataFrame, probes: DataFrame, k: int, strictness: float) -> DataFrame:
    """Best of each probed block: (query, query_id, vec_id, score)."""
    keys = ["list", "block", "share"]
    none = F.lit(None).cast("double")
    met = blocks.select(*keys, F.lit(0).alias("asks"), "row", "vec_id", "vector", none.alias("floor")).unionByName(
        probes.select(*keys, F.lit(1).alias("asks"), F.col("query").alias("row"), F.col("query_id").alias("vec_id"), "vector", "floor"))

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, block = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(i).to_numpy() for i in range(4)])
            edges = [0, *(np.flatnonzero((place[:, 1:] != place[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            found: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(edges, edges[1:]):
                part, asks = batch.slice(a, b - a), place[3, a]
                if (here := tuple(place[:3, a])) != at:
                    at, held, block = here, [], None
                if not asks:
                    held.append((part.column(4).to_numpy(), part.column(5).to_numpy(), matrix(part.column(6))))
                    continue
                if block is None and held:
                    block = Block(*[np.concatenate(x) for x in zip(*held)], strictness)
                if block is not None:
                    rows, owns, queries = part.column(4).to_numpy(), part.column(5).to_numpy(), matrix(part.column(6))
                    floors = part.column(7).to_numpy(zero_copy_only=False).astype(np.float64)
                    for i in np.flatnonzero(np.isnan(floors)):
                        ids, scores = block.search(rows[i], queries[i], k, -math.inf)
                        found.append((np.full(len(ids), rows[i]), np.full(len(ids), owns[i]), ids, scores))
                    bounded, step = np.flatnonzero(~np.isnan(floors)), max(1, PAIRS // max(1, len(block.rows)))
                    for some in (bounded[i:i + step] for i in range(0, len(bounded), step)):
                        at_query, ids, scores = block.search_many(rows[some], queries[some], k, floors[some])
                        found.append((rows[some][at_query], owns[some][at_query], ids, scores))
            none_yet = [(np.zeros(0, np.int64),) * 3 + (np.zeros(0),)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*(none_yet + found))], ["query", "query_id", "vec_id", "score"])

    return met.repartition(*keys).sortWithinPartitions(*keys, "asks").mapInArrow(pass_by, "query long, query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(df: DataFrame, asks: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20,
           probe_share: float = 0.9, strictness: float = 1.5, list_rows: int = LIST_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``asks`` the k best among all other rows.

    ``probe_share`` is the share of lists that a query probes, at least one. Vectors
    with clusters need few; on vectors without any, recall follows the share.
    """
    spark = df.sparkSession
    rows = stored(valid_vectors(df, vec_id, embedding, {"asks": F.coalesce(asks, F.lit(False)), "row": F.monotonically_increasing_id()}), "vectors")
    asked = rows.filter("asks")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = max(1, min(MOST_LISTS, total // list_rows))
    drawn = F.pmod(F.xxhash64("row"), F.lit(total))
    sample = matrix(rows.filter(drawn < 1.1 * SAMPLE_ROWS + 50).orderBy(drawn, "row").limit(SAMPLE_ROWS).select("vector").toArrow()["vector"].combine_chunks())
    lists = min(lists, len(sample))
    shared = spark.sparkContext.broadcast(fit_centroids(sample, lists))
    probed = max(1, math.ceil(probe_share * lists))

    def to_list():
        return lambda vectors: [pa.array(nearest(matrix(vectors), shared.value).astype(np.int32))]

    def to_probes():
        def rank(vectors: pa.Array):
            centres, given = shared.value, matrix(vectors)
            order = np.argsort((centres**2).sum(axis=1) - 2 * given @ centres.T, axis=1, kind="stable")[:, :probed]
            return [pa.array(list(order.astype(np.int32)), pa.list_(pa.int32()))]

        return rank

    listed = stored(add_columns(rows.drop("asks"), ["vector"], [("list", "int")], to_list), "lists")
    # One row for each list: at most MOST_LISTS rows.
    sizes = listed.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    asked = stored(add_columns(asked.drop("asks"), ["vector"], [("probes", "array<int>")], to_probes), "probes")
    shares = max(1, math.ceil(asked.count() / QUERY_ROWS))
    blocks = listed.join(F.broadcast(sizes), "list").withColumn("block", F.pmod(F.xxhash64("row"), "blocks").cast("int"))
    blocks = blocks.select("list", "block", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), "row", "vec_id", "vector")
    spread = asked.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"), "vector", F.pmod(F.xxhash64("row"), F.lit(shares)).cast("int").alias("share"),
                          F.posexplode("probes").alias("nth", "list"))
    probes = spread.join(F.broadcast(sizes), "list").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    first = stored(_best(_scan(blocks, probes.filter("nth = 0").withColumn("floor", F.lit(None).cast("double")), k, strictness), k), "nearest-list")
    floors = first.filter(F.col("rank") == k).select("query", F.col("score").alias("floor"))
    rest = _scan(blocks, probes.filter("nth > 0").join(floors, "query", "left"), k, strictness)
    return _best(first.drop("rank").unionByName(rest), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
