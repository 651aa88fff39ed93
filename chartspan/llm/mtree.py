"""Exact nearest vectors by inner product through paged M-trees.

Vectors are integer. One more coordinate, ``sqrt(M - |x|^2)`` with ``M`` the largest squared
norm (zero for queries), makes all of them equally long, so that the largest inner product is
the least Euclidean distance and a metric tree applies.

Distinct vectors are dealt out to pages by their nearest pivot, large pivots to several pages.
Each page becomes an M-tree whose nodes are rows: a routing vector, the covering radius, the
distance to the parent's routing vector, and for leaves the entries with their distances to
the leaf's. Every query first searches the page it lives in, which gives it a score to beat,
then all pages best-first: a node is opened in the order of the score it could still hold, and
the stored distances rule nodes and entries out before anything is computed for them. Scores
are exact integers; the bounds carry a margin for rounding.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartspan.llm.common import by_value, checkpointed

by_value(__name__)

#: Vectors to a page, entries to a leaf, children to a node, pivots at most, queries to a block.
PAGE, LEAF, FANOUT, PIVOTS, BLOCK = 4096, 512, 8, 256, 512

_NODES = ("page int, node int, parent int, radius double, to_parent double, center array<long>, "
          "vectors array<array<long>>, dists array<double>, ids array<array<long>>, times array<array<long>>")
_FOUND = "query_id long, vec_id long, score long, times long"


def quantised(vectors: DataFrame) -> DataFrame:
    """``vec_id, v`` with every component as floor(256 x); rows with nothing to compare are left out."""
    inf = float("inf")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (x < inf) & (x > -inf))
    good = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return good.select(F.col("vec_id").cast("long").alias("vec_id"),
                       F.transform("embedding", lambda x: F.floor(x.cast("double") * 256)).alias("v"))


def _classes(vectors: DataFrame, k: int) -> DataFrame:
    """Distinct vectors with their ``k + 1`` least ids; repeated rows of an id count ``times``."""
    rows = vectors.groupBy("v", "vec_id").agg(F.least(F.count(F.lit(1)), F.lit(k)).alias("times"))
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy("v").orderBy("vec_id")))
    kept = first.where(F.col("rank") <= k + 1).groupBy("v").agg(
        F.array_sort(F.collect_list(F.struct("vec_id", "times"))).alias("own"))
    return kept.select("v", F.col("own.vec_id").alias("ids"), F.col("own.times").alias("times"))


def _lifted(v: np.ndarray, largest: float) -> np.ndarray:
    x = v.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(0.0, largest - (x * x).sum(axis=1)))])


def _nearest(v: Column, pivots: np.ndarray, largest: float) -> Column:
    points = _lifted(pivots, largest)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        if not len(vectors):
            return pd.Series([], dtype="int32")
        x = _lifted(np.stack(vectors.to_numpy()), largest)
        far = (x * x).sum(axis=1)[:, None] - 2 * x @ points.T + (points * points).sum(axis=1)
        return pd.Series(far.argmin(axis=1).astype(np.int32))

    return nearest(v)


def _builder(largest: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Bulk load of one page: split by nearest of evenly spaced members, by halves where that fails."""

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("h", kind="stable").reset_index(drop=True)
        v = np.stack(rows["v"].to_numpy())
        x = _lifted(v, largest)
        nodes: list[tuple] = []
        todo = [(np.arange(len(v)), 0, -1)]
        while todo:
            members, center, parent = todo.pop()
            dist = np.sqrt(((x[members] - x[center]) ** 2).sum(axis=1))
            above = 0.0 if parent < 0 else float(np.sqrt(((x[center] - x[nodes[parent][-1]]) ** 2).sum()))
            leaf = len(members) <= LEAF
            nodes.append((parent, float(dist.max()), above, members if leaf else members[:0], dist if leaf else dist[:0], center))
            if leaf:
                continue
            here = len(nodes) - 1
            picks = members[np.linspace(0, len(members) - 1, FANOUT).astype(int)]
            far = ((x[members][:, None, :] - x[picks][None, :, :]) ** 2).sum(axis=2)
            side = far.argmin(axis=1)
            parts = [members[side == i] for i in range(len(picks))]
            if max(map(len, parts)) > 0.95 * len(members):
                parts = np.array_split(members[np.argsort(dist, kind="stable")], FANOUT)
            for part in parts:
                if len(part):
                    middle = x[part].mean(axis=0)
                    todo.append((part, part[((x[part] - middle) ** 2).sum(axis=1).argmin()], here))
        out = [(int(rows["page"][0]), i, parent, radius, above, v[center].tolist(), [v[m].tolist() for m in members],
                dist.tolist(), [list(rows["ids"][m]) for m in members], [list(rows["times"][m]) for m in members])
               for i, (parent, radius, above, members, dist, center) in enumerate(nodes)]
        return pd.DataFrame(out, columns=["page", "node", "parent", "radius", "to_parent", "center",
                                          "vectors", "dists", "ids", "times"])

    return build


def _scores(whole: np.ndarray, quick: np.ndarray, open_: np.ndarray, q: np.ndarray, top: float) -> np.ndarray:
    """Exact inner products of the open entries of a leaf."""
    if top >= 2.0 ** 52:
        return whole[open_] @ q
    point = q.astype(np.float64)
    return quick @ point if len(open_) == len(quick) else (quick @ point)[open_] if 2 * len(open_) > len(quick) else quick[open_] @ point


def _searcher(largest: float, k: int):
    """Best-first search of one page's tree for the queries of one block."""

    def search(nodes: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "vec_id", "score", "times"]
        if not len(nodes) or not len(queries):
            return pd.DataFrame({c: pd.Series([], dtype="int64") for c in columns})
        nodes = nodes.sort_values("node").reset_index(drop=True)
        radius, above = nodes["radius"].to_numpy(), nodes["to_parent"].to_numpy()
        centers = _lifted(np.stack(nodes["center"].to_numpy()), largest)
        children: list[list[int]] = [[] for _ in range(len(nodes))]
        for i, parent in enumerate(nodes["parent"]):
            if parent >= 0:
                children[parent].append(i)
        kids = [np.array(c, dtype=int) for c in children]
        leaves = [np.stack(v) if len(v) else None for v in nodes["vectors"]]
        # sums of products below 2**52 are exact in floating point, which multiplies faster
        quick = [None if x is None else x.astype(np.float64) for x in leaves]
        dists = [np.asarray(d, float) for d in nodes["dists"]]
        ids, times = nodes["ids"], nodes["times"]
        out = []
        for query_id, v, beat in zip(queries["query_id"], queries["v"], queries["beat"]):
            q = np.asarray(v)
            point = np.append(q.astype(np.float64), 0.0)
            top = float((point * point).sum()) + largest
            margin = 1 + 1e-9 * top
            floor = -math.inf if beat is None or beat != beat else float(beat)
            best: list[tuple[int, int, int]] = []

            def reach(low, top=top):
                """Largest score at a distance of ``low`` or more."""
                return (top - np.maximum(low, 0.0) ** 2) / 2

            first = math.sqrt(((point - centers[0]) ** 2).sum())
            heap = [(-float(reach(first - radius[0])), 0, first)]
            while heap:
                bound, node, dist = heapq.heappop(heap)
                if -bound + margin < floor:
                    break
                if leaves[node] is not None:
                    open_ = np.flatnonzero(reach(np.abs(dist - dists[node])) + margin >= floor)
                    if not len(open_):
                        continue
                    scores = _scores(leaves[node], quick[node], open_, q, top)
                    if len(scores) > k:  # an entry below k others is no candidate; k of them may be the query's own
                        floor = max(floor, np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1])
                    for at in np.flatnonzero(scores >= floor).tolist():
                        score, entry = int(scores[at]), open_[at]
                        best += [(-score, i, n) for i, n in zip(ids[node][entry], times[node][entry]) if i != query_id]
                    best.sort()
                    have, keep = 0, []
                    for entry in best:
                        if have >= k:
                            break
                        keep.append(entry)
                        have += entry[2]
                    best = keep
                    if have >= k:
                        floor = max(floor, -best[-1][0])
                    continue
                below = kids[node]
                below = below[reach(np.abs(dist - above[below]) - radius[below]) + margin >= floor]
                if len(below):
                    near = np.sqrt(((centers[below] - point) ** 2).sum(axis=1))
                    holds = reach(near - radius[below])
                    for child, d, b in zip(below.tolist(), near.tolist(), holds.tolist()):
                        if b + margin >= floor:
                            heapq.heappush(heap, (-b, child, d))
            out += [(query_id, i, -s, n) for s, i, n in best]
        return pd.DataFrame(out, columns=columns).astype("int64")

    return lambda key, nodes, queries: search(nodes, queries)


def _best(found: DataFrame, k: int) -> DataFrame:
    each = found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", "copy")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _top_k_of_length(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    classes = checkpointed(_classes(vectors, k).withColumn("h", F.xxhash64("v")))
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    n, largest = classes.agg(F.count(F.lit(1)), F.max(norm)).first()
    largest = float(largest or 0.0)
    n_pivots = max(1, min(PIVOTS, math.ceil(n / PAGE)))
    pivots = np.array([list(r[0]) for r in classes.orderBy("h", "v").limit(n_pivots).select("v").collect()])
    placed = checkpointed(classes.withColumn("pivot", _nearest(F.col("v"), pivots.reshape(len(pivots), -1), largest)))
    sizes = dict(placed.groupBy("pivot").count().collect())
    shares = [max(1, math.ceil(sizes.get(p, 0) / PAGE)) for p in range(n_pivots)]
    starts = np.cumsum([0, *shares]).tolist()
    at = F.col("pivot") + 1
    page = (F.element_at(F.array(*[F.lit(int(s)) for s in starts[:-1]]), at)
            + F.pmod(F.xxhash64("v", F.lit(1)), F.element_at(F.array(*[F.lit(s) for s in shares]), at)).cast("int"))
    paged = placed.withColumn("page", page)
    nodes = checkpointed(paged.select("page", "v", "ids", "times", "h").groupBy("page")
                         .applyInPandas(_builder(largest), _NODES))
    asked = queries.select(F.col("vec_id").alias("query_id"), "v").distinct()
    blocks = max(1, math.ceil(asked.count() / BLOCK))
    homes = (asked.join(paged.select("v", "page"), "v")
             .withColumn("block", F.pmod(F.xxhash64("query_id", F.lit(2)), F.lit(blocks)).cast("int")))
    homes = checkpointed(homes)
    all_blocks = nodes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    search = _searcher(largest, k)

    def searched(asked: DataFrame) -> DataFrame:
        return all_blocks.groupBy("page", "block").cogroup(asked.groupBy("page", "block")).applyInPandas(search, _FOUND)

    home = checkpointed(searched(homes.withColumn("beat", F.lit(None).cast("double"))))
    beat = (_best(home, k).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").cast("double").alias("beat"))
            .where(F.col("n") == k).select("query_id", "beat"))
    others = (homes.withColumnRenamed("page", "home").join(beat, "query_id", "left")
              .withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(int(starts[-1]) - 1)))).where("page <> home"))
    return _best(home.unionByName(searched(others)), k)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query.

    Both frames have ``vec_id, v`` as ``quantised`` returns them; queries are rows of
    ``vectors``. A query's own id is no candidate; equal scores go to the smaller id; repeated
    rows of an id are candidates of their own, repeated queries are one. Vectors of different
    lengths are not compared. Fewer candidates than ``k`` give fewer rows, none no rows. Sums
    must fit 64 bits.
    """
    vectors = checkpointed(vectors.withColumn("n", F.size("v")))
    queries = checkpointed(queries.withColumn("n", F.size("v")))
    parts = [_top_k_of_length(vectors.where(F.col("n") == n).drop("n"), queries.where(F.col("n") == n).drop("n"), k)
             for (n,) in queries.select("n").distinct().orderBy("n").collect()]
    out = parts[0] if parts else vectors.sparkSession.createDataFrame([], _FOUND + ", rank int")
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("query_id", "rank", "vec_id", "score")
