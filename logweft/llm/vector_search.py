"""Approximate nearest neighbours by learned partitions.

A neighbour graph of a bounded sample (the vectors with the smallest hash of id and vector, copies of a row once) is
halved again and again, each time by the slowest mode of its random walk and then by swaps that cut fewer edges, into
parts of equal size. A small network learns which parts hold the neighbours of a vector. The sample grows with the
square root of the rows, from LEAST_SAMPLE to MOST_SAMPLE, and the number of parts with the sample.

Every row is indexed in its most probable part. A query goes to its most probable parts until their probability reaches
a bound and they hold rows enough for an answer; all rows there are ranked by the exact measure. The bound is measured:
a fifth of the sample is kept from training, and the bound is the least one at which the parts hold RECALL of the true
neighbours of those vectors. So clustered vectors are found in few parts, and vectors without any structure in many.

Neighbouring parts lie together in bundles of about BLOCK rows. Rows and queries of a bundle are dealt out in blocks, so
a part with a third of all rows is many tasks, each with a bounded number of rows; a block keeps each query's best, and
the best of those are the answer.

Defined cases: vectors that are null, zero, of another length than most of the sample's, or hold null or non-finite
components take no part, nor do null ids; rows with the query's id are its own; an id whose rows are queries is one
query (by its smallest vector); repeated rows are found each; with fewer candidates than asked for, all are returned;
ties go to the smaller id; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, cut, drop, table, tidy

#: Vectors to learn from, and of them a part; neighbours in the graph, hidden units and rounds of training.
LEAST_SAMPLE, MOST_SAMPLE, PART, NEIGHBOURS, HIDDEN, ROUNDS = 8192, 65_536, 32, 16, 96, 15
#: Share of the true neighbours that the searched parts hold; the least probability of those; one of so many sampled rows
#: measures the share.
RECALL, LEAST_MASS, KEPT = 0.94, 0.9, 5
#: Rows of a block, and queries.
BLOCK, QUERY_BLOCK = 8192, 1024


def usable(vector: Column) -> Column:
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def neighbour_graph(x: np.ndarray, k: int) -> np.ndarray:
    """Of each row the k others of largest inner product, by blocks."""
    k = min(k, len(x) - 1)
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 512):
        s = x[a : a + 512] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + 512] = np.argpartition(-s, k - 1, axis=1)[:, :k] if k else out[a : a + 512]
    return out


def halve(near: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Splits a graph (neighbours as places, -1 for none) in equal halves; True for the second."""
    n = len(near)
    inside, at = near >= 0, np.maximum(near, 0)
    degree = np.maximum(1, inside.sum(axis=1) + np.bincount(near[inside], minlength=n))
    src = np.repeat(np.arange(n), near.shape[1])[inside.ravel()]
    v = rng.standard_normal(n)
    for _ in range(60):
        v -= (v * degree).sum() / degree.sum()
        pulled = (v[at] * inside).sum(axis=1) + np.bincount(near[inside], weights=v[src], minlength=n)
        v = 0.5 * v + 0.5 * pulled / degree
        v /= np.linalg.norm(v) + 1e-30
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(10):
        other = (side[at] != side[:, None]) & inside
        gain = other.sum(axis=1) + np.bincount(near[inside], weights=other[inside], minlength=n)
        gain = 2 * gain - degree
        a, b = np.flatnonzero(~side), np.flatnonzero(side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b))
        swap = np.flatnonzero(gain[a[:m]] + gain[b[:m]] > 2)[: max(1, n // 50)]
        if not len(swap):
            break
        side[a[swap]], side[b[swap]] = True, False
    return side


def partition(near: np.ndarray, depth: int, seed: int = 7) -> np.ndarray:
    """Parts 0 to 2^depth - 1 of the graph's rows, equal in size up to one a level."""
    rng = np.random.default_rng(seed)
    part = np.zeros(len(near), np.int64)
    for _ in range(depth):
        new = part * 2
        for p in np.unique(part):
            rows = np.flatnonzero(part == p)
            place = np.full(len(near), -1)
            place[rows] = np.arange(len(rows))
            if len(rows) > 1:
                new[rows] += halve(place[near[rows]], rng)
        part = new
    return part


class Router:
    """A network of one hidden layer: probabilities of the parts."""

    def __init__(self, x: np.ndarray, target: np.ndarray, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        self.scale = 1 / (np.linalg.norm(x, axis=1).mean() + 1e-30)
        sizes = (x.shape[1], HIDDEN, target.shape[1])
        self.w = [self.rng.standard_normal((a, b)) * np.sqrt(2 / a) for a, b in zip(sizes, sizes[1:], strict=False)]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.train(x, target)

    def train(self, x: np.ndarray, target: np.ndarray) -> None:
        """ROUNDS times over the rows."""
        moments = [[np.zeros_like(p), np.zeros_like(p)] for p in (*self.w, *self.b)]
        x, step = x * self.scale * np.sqrt(x.shape[1]), 0
        for _ in range(ROUNDS):
            order = self.rng.permutation(len(x))
            for i in range(0, len(x), 128):
                rows, step = order[i : i + 128], step + 1
                hidden = np.maximum(0, x[rows] @ self.w[0] + self.b[0])
                d = (_softmax(hidden @ self.w[1] + self.b[1]) - target[rows]) / len(rows)
                back = (d @ self.w[1].T) * (hidden > 0)
                grads = [x[rows].T @ back, hidden.T @ d, back.sum(0), d.sum(0)]
                for p, g, m in zip((*self.w, *self.b), grads, moments, strict=True):
                    m[0] += 0.1 * (g - m[0])
                    m[1] += 0.01 * (g * g - m[1])
                    p -= 0.004 * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        x = x * self.scale * np.sqrt(x.shape[1])
        return _softmax(np.maximum(0, x @ self.w[0] + self.b[0]) @ self.w[1] + self.b[1])


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


@dataclass
class Index:
    router: Router
    width: int
    parts: int
    mass: float  # probability that a query's parts reach

    def probed(self, p: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> list[np.ndarray]:
        """For each row of probabilities its parts: enough for the probability, and for so many rows."""
        order = np.argsort(-p, axis=1, kind="stable")
        before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
        held = np.cumsum(sizes[order], axis=1) - sizes[order]
        n = ((before <= self.mass) | (held < rows[:, None])).sum(axis=1)
        return [o[:k] for o, k in zip(order, n, strict=True)]


def learn(vectors: DataFrame) -> Index | None:
    """From a bounded sample of vectors (id, v)."""
    hashed = vectors.select("id", "v", F.xxhash64("id", "v").alias("h"))
    size = min(MOST_SAMPLE, max(LEAST_SAMPLE, 16 * math.isqrt(vectors.count())))
    last = hashed.select("h").distinct().orderBy("h").limit(size).agg(F.max("h")).first()[0]
    if last is None:
        return None
    rows = hashed.filter(F.col("h") <= last).groupBy("h").agg(F.first("id").alias("id"), F.first("v").alias("v")).orderBy("h").toArrow()
    v = rows["v"].combine_chunks()
    sizes = pc.list_value_length(v).to_numpy()
    width = int(np.bincount(sizes).argmax())
    x = _matrix(v.filter(pa.array(sizes == width)), width)
    trained = np.arange(len(x)) % KEPT > 0 if len(x) >= KEPT * PART else np.ones(len(x), bool)
    known, test = x[trained], x[~trained]
    near = neighbour_graph(known.astype(np.float32), NEIGHBOURS)
    depth = max(0, int(np.log2(max(1, len(x) / PART))))
    part = partition(near, depth)
    router = Router(known, _shares(part, near, 1 << depth))
    # Rows are indexed where the router sends them, so that is what it has to find in the end.
    router.train(known, _shares(router(known).argmax(axis=1), near, 1 << depth))
    return Index(router, width, 1 << depth, max(LEAST_MASS, _mass(router, known, test), _mass(router, known, known[: len(test)], own=True)))


def _shares(part: np.ndarray, near: np.ndarray, parts: int) -> np.ndarray:
    """Of each row the shares of the parts that it and its neighbours lie in."""
    out = np.zeros((len(part), parts))
    np.add.at(out, (np.repeat(np.arange(len(part)), near.shape[1]), part[near].ravel()), 1.0)
    out[np.arange(len(part)), part] += 1.0
    return out / out.sum(axis=1, keepdims=True)


def _mass(router: Router, known: np.ndarray, test: np.ndarray, own: bool = False) -> float:
    """The least probability by which the parts that come first hold RECALL of the neighbours of test rows (own: which
    are the first known ones, and no neighbours of themselves)."""
    if not len(test):
        return 1.0
    home, needed = router(known).argmax(axis=1), []
    for a in range(0, len(test), 512):
        some = test[a : a + 512]
        score = some @ known.T
        if own:
            score[np.arange(len(some)), np.arange(a, a + len(some))] = -np.inf
        near = np.argpartition(-score, NEIGHBOURS - 1, axis=1)[:, :NEIGHBOURS]
        p = router(some)
        order = np.argsort(-p, axis=1, kind="stable")
        sorted_ = np.take_along_axis(p, order, axis=1)
        before = np.empty_like(p)
        np.put_along_axis(before, order, np.cumsum(sorted_, axis=1) - sorted_, axis=1)
        needed.append(np.take_along_axis(before, home[near], axis=1).ravel())
    return float(np.quantile(np.concatenate(needed), RECALL))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def search(rows: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each id with a row where is_query holds its k nearest other rows: query_id, rank, <id_column>, score."""
    spark = rows.sparkSession
    bounded_batches(spark)
    out = f"query_id long, rank int, `{id_column}` long, score double"
    vectors = rows.filter(F.col(id_column).isNotNull() & usable(F.col(vector))).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    index = learn(vectors.select("id", "v"))
    if index is None:
        return spark.createDataFrame([], out)
    width, parts = index.width, index.parts

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(index.router(_matrix(batch.column(1), width)).argmax(axis=1).astype(np.int32))], ["id", "v", "q", "part"])

    routed, routed_path = cut(vectors.filter(F.size("v") == width).mapInArrow(tidy(route), "id long, v array<double>, q boolean, part int"), "ann-routed")
    # A row a part: at most MOST_SAMPLE / PART.
    sizes = np.zeros(parts, np.int64)
    for p, n in routed.groupBy("part").count().collect():
        sizes[p] = n
    # Neighbouring parts in bundles: the parts are numbered by their halvings.
    bundles = min(parts, max(8, -(-int(sizes.sum()) // BLOCK)))
    bundle_of = np.arange(parts) * bundles // parts
    held = np.bincount(bundle_of, weights=sizes, minlength=bundles)

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, bundle, lists = [], [], []
            found = index.probed(index.router(_matrix(batch.column(1), width)), sizes, k + batch.column(2).to_numpy()) if len(batch) else []
            for i, ps in enumerate(found):
                ps = np.sort(ps)
                which, at = np.unique(bundle_of[ps], return_index=True)
                ids.extend([i] * len(which))
                bundle.extend(which.tolist())
                lists.extend(np.split(ps, at[1:]))
            at = pa.array(ids, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(bundle, pa.int32()), pa.array(lists, pa.list_(pa.int32()))], ["id", "v", "bundle", "parts"])

    # Its own rows are no candidates: a query needs as many rows more.
    own = routed.filter("q").groupBy("id").agg(F.min("v").alias("v"))
    own = own.join(routed.join(own.select("id"), "id", "left_semi").groupBy("id").agg(F.count("*").alias("n")), "id").select("id", "v", "n")
    asked, asked_path = cut(own.mapInArrow(tidy(ask), "id long, v array<double>, bundle int, parts array<int>"), "ann-asked")
    wanted = dict(asked.groupBy("bundle").count().collect())
    blocks = spark.createDataFrame([(b, max(1, -(-int(held[b]) // BLOCK)), max(1, -(-wanted.get(b, 0) // QUERY_BLOCK))) for b in range(bundles)], "bundle int, row_blocks int, query_blocks int")
    bundled = spark.createDataFrame([(p, int(b)) for p, b in enumerate(bundle_of)], "part int, bundle int")
    block = lambda n, *by: F.pmod(F.xxhash64("id", *by), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    rows_ = routed.join(F.broadcast(bundled.join(blocks, "bundle")), "part").select("id", "v", "part", "bundle", block("row_blocks", F.monotonically_increasing_id()).alias("rb"), each("query_blocks").alias("qb"))
    queries = asked.join(F.broadcast(blocks), "bundle").select("id", "v", "parts", "bundle", block("query_blocks").alias("qb"), each("row_blocks").alias("rb"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        found_q, found_id, found_s = [], [], []
        if len(left) and len(right):
            part, ids, x = left.column("part").to_numpy(), left.column("id").to_numpy(), _matrix(left.column("v"), width)
            order = np.argsort(part, kind="stable")
            part, ids, x = part[order], ids[order], x[order]
            query_ids, y, lists = right.column("id").to_numpy(), _matrix(right.column("v"), width), right.column("parts").to_pylist()
            which, start = np.unique(part, return_index=True)
            spans = dict(zip(which.tolist(), zip(start.tolist(), [*start[1:].tolist(), len(part)], strict=True), strict=True))
            for a in range(0, len(y), 256):
                some_lists = lists[a : a + 256]
                scores = np.full((len(some_lists), len(x)), -np.inf)
                askers: dict[int, list[int]] = {}
                for i, ps in enumerate(some_lists):
                    for p in ps:
                        if p in spans:
                            askers.setdefault(p, []).append(i)
                for p, at in askers.items():
                    lo, hi = spans[p]
                    scores[at, lo:hi] = y[a + np.array(at)] @ x[lo:hi].T
                for q, s in zip(query_ids[a : a + 256], scores, strict=True):
                    s[ids == q] = -np.inf
                    some = np.flatnonzero(s >= np.partition(s, len(s) - k)[len(s) - k]) if len(s) > k else np.arange(len(s))
                    some = some[s[some] > -np.inf]
                    some = some[np.lexsort((ids[some], -s[some]))][:k]
                    found_q.append(np.full(len(some), q))
                    found_id.append(ids[some])
                    found_s.append(s[some])
        join = lambda xs, kind: pa.array(np.concatenate(xs) if xs else [], kind)
        return pa.table({"query_id": join(found_q, pa.int64()), id_column: join(found_id, pa.int64()), "score": join(found_s, pa.float64())})

    keys = ["bundle", "rb", "qb"]
    found = rows_.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(best, f"query_id long, `{id_column}` long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_column))
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", id_column, "score")
    found, _ = cut(found, "ann-found")
    drop(spark, routed_path, asked_path)
    return found


def searched_share(rows: DataFrame, is_query: Column, id_column: str = "vec_id", vector: str = "embedding") -> float:
    """The mean share of all rows that a query's parts hold: what the index saves."""
    vectors = rows.filter(F.col(id_column).isNotNull() & usable(F.col(vector))).select(F.col(id_column).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    index = learn(vectors.select("id", "v"))
    if index is None:
        return 0.0
    width = index.width

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(index.router(_matrix(batch.column(1), width)).argmax(axis=1).astype(np.int32))], ["part"])

    vectors = vectors.filter(F.size("v") == width)
    sizes = np.zeros(index.parts, np.int64)
    for p, n in vectors.mapInArrow(homes, "part int").groupBy("part").count().collect():
        sizes[p] = n

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                found = index.probed(index.router(_matrix(batch.column(1), width)), sizes, np.ones(len(batch), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([float(sizes[ps].sum() / sizes.sum()) for ps in found])], ["share"])

    return vectors.filter("q").mapInArrow(shares, "share double").agg(F.avg("share")).first()[0] or 0.0


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20."""
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)
