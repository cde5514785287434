"""Exact top-k by inner product with M-trees, best first.

Vectors are dealt to blocks of bounded size; each block becomes an M-tree of
paged nodes.  An entry of a node holds a centre, the radius that covers its
subtree and its distance to the centre of the node.  Largest inner products are
turned into smallest distances: with one more coordinate that lifts all vectors
of the block to the same length, ``distance**2 = |q|**2 + M**2 - 2 * score``.

A query visits nodes in the order of the best score they could hold.  With the
distance of the query to the parent's centre, the stored parent distances bound
the distance to an entry by the triangle inequality; entries that cannot beat
the k-th score are passed over without computing their own distance, as are
nodes behind their covering radius.  Bounds are loosened by a little more than
rounding can be, and a node that can only tie is passed over only if all its
ids are larger, so results are exact, ties included.

A task builds the tree of one block and searches it for batches of queries at
once: a page is visited for the queries of the batch that it could still serve,
with one matrix product for the entries that the bounds leave.  The rows of a
block come first in their task and the queries behind them, in Arrow batches, so
memory is that of a block and a batch.  All queries go to all blocks; where they
are more than ``CHUNK_ROWS``, they are dealt to groups and a block's rows go to every
group.  Each block returns ``k`` rows a query.

Vectors without structure (independent random directions) leave the bounds
little to prune; then the work is that of the plain matrix products.

Vectors that are null, empty or hold null or non-finite components, and rows
without an id, take no part.  Vectors of another length than the query's are no
candidates.  Rows with the query's id are its own, and no candidates; repeated
rows of other ids are candidates each.  Rows of one id are one query for each
of their vectors.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilwork.llm.shared import table, written

PAGE = 192  # entries of a leaf
FANOUT = 16  # entries of an inner node
BLOCK_ROWS = 8192
CHUNK_ROWS = 50_000  # queries of a group
BATCH = 1024  # queries that are searched for together
EXACT = 2**52  # scores below are exact in doubles


@dataclass
class Node:
    """One page: centres or vectors, with what is stored about them."""

    center: np.ndarray | None
    vectors: np.ndarray  # one row per entry, without the added coordinate
    radius: np.ndarray | None  # covering radii; None in a leaf
    to_center: np.ndarray  # distance of each entry to this node's centre
    least_id: np.ndarray  # of a leaf: the ids
    children: list | None


class MTree:
    """Bulk-loaded top-down: entries go to the nearest of some centres that lie far apart."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], vectors[order]
        norms = (self.x.astype(float) ** 2).sum(1)
        self.longest = float(norms.max())
        self.lifted = np.c_[self.x.astype(float), np.sqrt(np.maximum(self.longest - norms, 0))]
        self.root = self._node(np.arange(len(ids)), self.lifted[0])
        self.asked = 0  # scores computed so far

    def _distances(self, rows: np.ndarray, center: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.lifted[rows] - center) ** 2).sum(1))

    def _node(self, rows: np.ndarray, center: np.ndarray) -> Node:
        if len(rows) <= PAGE:
            return Node(center, self.x[rows], None, self._distances(rows, center), self.ids[rows], None)
        groups = self._parts(rows)
        centers = np.array([self.lifted[g[0]] for g in groups])
        radius = np.array([self._distances(g, c).max() for g, c in zip(groups, centers, strict=True)])
        return Node(
            center, self.x[[g[0] for g in groups]], radius, np.sqrt(((centers - center) ** 2).sum(1)),
            np.array([self.ids[g].min() for g in groups]), [self._node(g, c) for g, c in zip(groups, centers, strict=True)],
        )

    def _parts(self, rows: np.ndarray) -> list[np.ndarray]:
        """Groups around centres chosen farthest first; pages in the order of ids where that can't part them."""
        centers = [rows[0]]
        near = self._distances(rows, self.lifted[rows[0]])
        owner = np.zeros(len(rows), int)
        for k in range(1, FANOUT):
            far = int(near.argmax())
            if near[far] == 0:
                break
            centers.append(rows[far])
            d = self._distances(rows, self.lifted[rows[far]])
            closer = d < near
            owner[closer], near = k, np.minimum(near, d)
        groups = []
        for k, c in enumerate(centers):
            own = rows[owner == k]
            groups.append(np.r_[c, own[own != c]])
        if max(map(len, groups)) > 0.9 * len(rows):
            return np.array_split(rows, min(FANOUT, -(-len(rows) // PAGE)))
        return groups

    def search_many(self, own: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``(query number, score, id)`` of the best ``k`` entries for each of some queries; scores must be exact in doubles."""
        n, q = len(queries), queries.astype(float)
        x_total = (q * q).sum(1) + self.longest
        slack = 1e-9 * x_total + 1e-6
        worst, worst_id = np.full(n, -np.inf), np.full(n, np.iinfo(np.int64).max)
        tops = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))  # query, score, id
        first = np.sqrt(np.maximum(x_total - 2 * (q @ self.root.center[:-1]), 0))
        heap, count = [(-np.inf, 0, self.root, first, np.full(n, np.inf), np.iinfo(np.int64).min)], 1
        while heap:
            _, _, node, to_query, bound, least = heapq.heappop(heap)
            active = np.flatnonzero((bound > worst) | (bound == worst) & (least < worst_id))
            if not len(active):
                continue
            total, near, beat = x_total[active, None], slack[active, None], worst[active, None]
            reach = np.abs(to_query[active, None] - node.to_center)
            if node.radius is not None:
                reach = np.maximum(reach - node.radius, 0)
            possible = (total - reach * reach) / 2 + near >= beat
            columns = np.flatnonzero(possible.any(0))
            possible = possible[:, columns]
            scores = q[active] @ node.vectors[columns].T.astype(float)
            self.asked += scores.size
            if node.children is not None:
                distance = np.sqrt(np.maximum(total - 2 * scores, 0))
                nearest = np.maximum(distance - node.radius[columns], 0)
                best = np.where(possible, np.floor((total - nearest * nearest) / 2 + near), -np.inf)
                for j, e in enumerate(columns.tolist()):
                    far, hope = np.zeros(n), np.full(n, -np.inf)
                    far[active], hope[active] = distance[:, j], best[:, j]
                    heapq.heappush(heap, (-best[:, j].max(), count, node.children[e], far, hope, int(node.least_id[e])))
                    count += 1
                continue
            ids = node.least_id[columns]
            better = (scores > beat) | (scores == beat) & (ids < worst_id[active, None])
            at, e = np.nonzero(better & (ids != own[active, None]))
            if len(at):
                tops = _best(tops, (active[at], scores[at, e], ids[e]), k)
                full = np.flatnonzero(tops[0][k - 1 :] == tops[0][: max(len(tops[0]) - k + 1, 0)])  # where the k of a query begin
                worst[tops[0][full]], worst_id[tops[0][full]] = tops[1][full + k - 1], tops[2][full + k - 1]
        return tops

    def search(self, own: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """``(score, id)`` of the best ``k`` entries of other ids, ties to smaller ids."""
        q = query.astype(float)
        total = float(q @ q) + self.longest
        slack = 1e-9 * total + 1e-6
        exact = float(np.abs(q).max()) * float(np.abs(self.x).max()) * len(q) < EXACT
        top_s, top_i = np.zeros(0, object if not exact else np.int64), np.zeros(0, np.int64)
        worst = -np.inf  # score to beat once there are k

        def scores(vectors):
            if exact:
                return vectors @ query if vectors.dtype != np.float64 else (vectors @ q)
            return np.array([int(sum(int(a) * int(b) for a, b in zip(v, query, strict=True))) for v in vectors], object)

        def distance(s):
            return np.sqrt(np.maximum(total - 2 * np.asarray(s, float), 0))

        first = float(np.sqrt(((self.root.center - np.r_[q, 0.0]) ** 2).sum()))
        heap, count = [(-np.inf, 0, 0, self.root, first)], 1
        while heap:
            bound, least, _, node, to_query = heapq.heappop(heap)
            if len(top_s) == k and (-bound < worst or (-bound == worst and least > top_i[-1])):
                if -bound < worst:
                    break
                continue
            reach = np.abs(to_query - node.to_center)
            if node.radius is not None:
                reach = np.maximum(reach - node.radius, 0)
            possible = np.arange(len(reach))
            if len(top_s) == k:
                possible = np.flatnonzero((total - reach * reach) / 2 + slack >= float(worst))
                if not len(possible):
                    continue
            s = scores(node.vectors[possible] if len(possible) < len(reach) else node.vectors)
            if node.children is None:
                ids = node.least_id[possible]
                s = s.astype(np.int64) if exact else s
                take = ids != own
                if len(top_s) == k:
                    take &= (s > worst) | ((s == worst) & (ids < top_i[-1]))
                if take.any():
                    all_s, all_i = np.concatenate([top_s, s[take]]), np.concatenate([top_i, ids[take]])
                    best = np.lexsort((all_i, -all_s))[:k]
                    top_s, top_i = all_s[best], all_i[best]
                    if len(top_s) == k:
                        worst = top_s[-1]
            else:
                d = distance(s)
                nearest = np.maximum(d - node.radius[possible], 0)
                best = np.floor((total - nearest * nearest) / 2 + slack)
                for b, e, c in zip(best.tolist(), possible.tolist(), d.tolist(), strict=True):
                    if len(top_s) < k or b >= worst:
                        heapq.heappush(heap, (-b, int(node.least_id[e]), count, node.children[e], c))
                        count += 1
        limit = 2**63 - 1
        return [(max(-limit, min(limit, int(a))), int(b)) for a, b in zip(top_s, top_i, strict=True)]


def _best(tops: tuple, more: tuple, k: int) -> tuple:
    """The first ``k`` of every query by score and id, sorted by query."""
    query, score, ids = (np.concatenate([a, b]) for a, b in zip(tops, more, strict=True))
    order = np.lexsort((ids, -score, query))
    query, score, ids = query[order], score[order], ids[order]
    starts = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
    place = np.arange(len(query)) - np.repeat(starts, np.diff(np.append(starts, len(query))))
    return query[place < k], score[place < k], ids[place < k]


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """``(vec_id, v, dims)`` of the rows that take part; ``v`` holds ``floor(64 * x)`` as doubles."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    doubles = F.transform(column, lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), doubles.alias("x"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", fine))
    floor = lambda x: F.when(F.abs(x) < 2.0**46, F.floor(x * 64).cast("double")).otherwise(x * 64)
    return rows.select("vec_id", F.transform("x", floor).alias("v"), F.size("x").alias("dims"))


def _array(rows: pa.ListArray) -> np.ndarray:
    """The vectors of a column as rows; whole numbers of Python where doubles don't hold them."""
    found = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
    return found if np.abs(found).max() < 2**53 else np.array([[int(v) for v in r] for r in found], object)


def _searched(tree: MTree, ids: np.ndarray, queries: np.ndarray, forms: np.ndarray, k: int) -> pa.RecordBatch:
    """The best entries of one tree for some queries."""
    names = ["query_id", "form", "vec_id", "score"]
    if tree.x.dtype != object and queries.dtype != object:
        if float(np.abs(queries).max()) * float(np.abs(tree.x).max()) * queries.shape[1] < EXACT:
            at, scores, found = tree.search_many(ids, queries, k)
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[at], forms[at], found, scores.astype(np.int64))], names=names)
    rows = [(int(o), int(f), i, s) for o, f, q in zip(ids, forms, queries, strict=True) for s, i in tree.search(int(o), q, k)]
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(4)], names=names)


def search_blocks(rows: DataFrame, k: int) -> DataFrame:
    """``(query_id, form, vec_id, score)`` from rows sorted by block, the block's own before its queries."""

    def run(batches):
        key, ids, parts, tree = None, [], [], None
        for batch in filter(len, batches):
            dims, block, lot, asking = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            seam = np.flatnonzero((dims[1:] != dims[:-1]) | (block[1:] != block[:-1]) | (lot[1:] != lot[:-1]) | (asking[1:] != asking[:-1])) + 1
            for start, end in zip(np.append(0, seam), np.append(seam, batch.num_rows), strict=True):
                piece = batch.slice(start, end - start)
                here = (dims[start], block[start], lot[start])
                if here != key:
                    key, ids, parts, tree = here, [], [], None
                if not asking[start]:
                    ids.append(piece.column(4).to_numpy())
                    parts.append(piece.column(5))
                    continue
                if tree is None:
                    tree = MTree(np.concatenate(ids), _array(pa.concat_arrays(parts)))
                    ids, parts = [], []
                for first in range(0, piece.num_rows, BATCH):
                    asked = piece.slice(first, BATCH)
                    ids_, forms = asked.column(4).to_numpy(), asked.column(6).to_numpy()
                    yield _searched(tree, ids_, _array(asked.column(5)), forms, k)

    return rows.mapInArrow(run, "query_id long, form long, vec_id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, block_rows: int = BLOCK_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)``; ``is_query`` is a condition on ``vec_id``."""
    rows = written(usable(vectors).withColumn("query", is_query))
    counts = rows.groupBy("dims").agg(F.count("*").alias("n"), F.sum(F.col("query").cast("long")).alias("q"))
    # numbers of blocks and groups follow the rows
    counts = counts.where("q > 0").select(
        "dims", F.ceil(F.col("n") / block_rows).cast("int").alias("blocks"), F.ceil(F.col("q") / chunk_rows).cast("int").alias("lots")
    )
    dealt = rows.join(counts, "dims")
    # the row's place keeps equal rows from meeting in one block
    place = F.xxhash64("vec_id", "v", F.monotonically_increasing_id())
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = dealt.select("dims", F.pmod(place, F.col("blocks")).cast("int").alias("block"), every("lots").alias("lot"), F.lit(False).alias("asking"), "vec_id", "v", F.lit(0).cast("long").alias("form"))
    asked = dealt.where("query").select("dims", "blocks", F.pmod(F.xxhash64("vec_id", "v"), F.col("lots")).cast("int").alias("lot"), "vec_id", "v").distinct()
    asked = asked.select("dims", every("blocks").alias("block"), "lot", F.lit(True).alias("asking"), "vec_id", "v", F.xxhash64("v").alias("form"))
    both = held.unionByName(asked).repartition("dims", "block", "lot").sortWithinPartitions("dims", "block", "lot", "asking")
    found = search_blocks(both, k)
    order = W.partitionBy("query_id", "form").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark, sf_dir: str) -> DataFrame:
    """The 20 best matches among all embeddings of every twentieth one."""
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


OP2_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 20
"""
