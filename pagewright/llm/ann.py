"""Approximate nearest neighbours by an inverted multi-index."""

from __future__ import annotations

import functools
import heapq
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagewright.llm.common import materialize, mix64

#: Vectors of a bucket (about), buckets at least, queries worked on at once, scores held at once.
BUCKET, MIN_BUCKETS, QUERY_BLOCK, HELD = 16_384, 16, 2048, 1 << 22
#: Vectors of a cell on average, and centroids of a half at most.
CELL, MAX_CENTROIDS = 64, 256


def k_means(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm from distinct sampled rows; an empty centroid stays where it is."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        n = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * x @ centres.T, axis=1)


def valid(vectors):
    """Arrays of finite components that aren't all zero."""
    finite = F.forall(vectors, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(finite & F.exists(vectors, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


def tail(z: np.ndarray) -> np.ndarray:
    """About the share of a normal distribution above z."""
    z = np.clip(z, -8, 8)
    return 1 / (1 + np.exp(1.5976 * z + 0.07056 * z**3))


def traverse(first: np.ndarray, second: np.ndarray, weights: np.ndarray, wanted: float) -> list[int]:
    """Multi-sequence traversal: cells (i, j) by falling first[i] + second[j], until their weights reach `wanted`; cells without weight are left out.

    A heap has the pairs next in line: a pair is entered once both its neighbours with a better rank are out.
    """
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    va, vb, k = first[a].tolist(), second[b].tolist(), len(b)
    table = weights[a][:, b].tolist()
    number = (a[:, None] * k + b[None]).tolist()
    reached, cells, held = [0] * len(a), [], 0  # reached[i]: pairs (i, 0..) that have been out
    heap = [(-(va[0] + vb[0]), 0, 0)]
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        reached[i] = j + 1
        if table[i][j]:
            cells.append(number[i][j])
            held += table[i][j]
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (-(va[i + 1] + vb[j]), i + 1, j))
        if j + 1 < k and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (-(va[i] + vb[j + 1]), i, j + 1))
    return cells


class Index:
    """Codebooks of both halves with the spread inside their cells, and the sample they were fitted on; about 10 MB for 20,000 vectors of 64."""

    def __init__(self, ids: np.ndarray, sample: np.ndarray, centroids: int, rounds: int, seed: int):
        self.ids, self.sample, self.half = ids, sample, (sample.shape[1] + 1) // 2
        self.books, self.spread = [], []
        for i, x in enumerate((sample[:, : self.half], sample[:, self.half :])):
            book = k_means(x, centroids, rounds, seed + i) if x.shape[1] else np.zeros((1, 0))
            near = nearest(x, book)
            n = np.bincount(near, minlength=len(book))
            own = np.bincount(near, ((x - book[near]) ** 2).sum(axis=1), minlength=len(book)) / max(1, x.shape[1])
            self.books.append(book)
            self.spread.append((own + own.sum() / n.sum()) / (n + 1))

    def cells(self, x: np.ndarray) -> np.ndarray:
        one, two = self.books
        return nearest(x[:, : self.half], one) * len(two) + nearest(x[:, self.half :], two)

    def floors(self, names: np.ndarray, q: np.ndarray, k: int) -> np.ndarray:
        """The k-th best score of each query in the sample (-inf, if it has fewer): what the k nearest of all vectors reach, too."""
        scores = q @ self.sample.T
        scores[names[:, None] == self.ids[None]] = -np.inf
        return np.partition(scores, len(self.ids) - k, axis=1)[:, -k] if len(self.ids) >= k else np.full(len(q), -np.inf)

    def walks(self, names: np.ndarray, q: np.ndarray, counts: np.ndarray, k: int, miss: float):
        """For each query its floor, the cells of its walk, and how many of them hold more than k vectors.

        A vector of a cell scores about the sum of the centroids' products, with the cell's spread as deviation; that gives how many
        vectors of each cell are expected above the floor. The walk ends once all but the share `miss` of them are behind it.
        """
        first, second = q[:, : self.half] @ self.books[0].T, q[:, self.half :] @ self.books[1].T
        floors = self.floors(names, q, k)
        one, two = (q[:, : self.half] ** 2).sum(axis=1), (q[:, self.half :] ** 2).sum(axis=1)
        for i in range(len(q)):
            deviation = np.sqrt(one[i] * self.spread[0][:, None] + two[i] * self.spread[1][None]) + 1e-300
            expected = counts * (tail((floors[i] - first[i][:, None] - second[i][None]) / deviation) if np.isfinite(floors[i]) else 1.0)
            cells = np.array(traverse(first[i], second[i], expected, expected.sum() * (1 - miss)), np.int64)
            sure = int(np.searchsorted(np.cumsum(counts.ravel()[cells]), k + 1)) + 1
            if sure > len(cells):  # fewer than k vectors so far: further cells, in order
                cells = np.array(traverse(first[i], second[i], counts, max(k + 1, counts.ravel()[cells].sum() + 1)), np.int64)
            yield floors[i], cells, sure


def search(vectors: DataFrame, queries: DataFrame, *, k: int = 20, miss: float = 0.04, centroids: int | None = None, max_train: int = 20_000, seed: int = 3) -> DataFrame:
    """The k vectors with the largest inner product found for each query: query_id, rank (from 1), vec_id, score.

    vectors, queries: vec_id, embedding (array of any number type); other columns are ignored. Each half of the vectors is quantised by
    its own centroids (k-means on at most max_train vectors, chosen by a hash of vec_id; their number grows with the table up to
    MAX_CENTROIDS, if not given), and each vector is indexed under its pair of centroids. A query walks the pairs by falling sum of inner
    products (a heap) until all but the share `miss` of the vectors are behind it that are expected to be as near as its k-th nearest of
    the sample. Their entries are ranked by the inner product of the original vectors in double precision. Ties go to the smaller
    vec_id; a vector with the query's own vec_id is not its candidate. Fewer than k candidates are all returned. Rows whose embedding is
    null, empty, zero, or has null or non-finite components, or whose vec_id is null, take no part; vectors of different lengths are
    searched apart, each length with its own index. A vec_id given twice, with the same vector or another, is two candidates.

    miss is the knob for recall. How far a walk goes is up to the data: few cells where vectors are clustered, half of them where they
    have no structure. Cells go to buckets of about BUCKET vectors in their order, so neighbours stay together; larger cells are split.
    A bucket ranks its queries in blocks, drops what is below a query's floor, and sends at most k rows a query on. The sample and the
    counts by cell (at most MAX_CENTROIDS squared) pass through the driver.
    """
    spark = vectors.sparkSession
    kind = dict(vectors.dtypes)["embedding"]
    kind = kind if kind in ("array<float>", "array<double>") else "array<double>"
    chosen = lambda df: df.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding")).filter(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    base, asked = chosen(vectors), chosen(queries)
    found = []
    for r in base.groupBy(F.size("embedding").alias("d")).count().orderBy("d").collect():
        own = F.size("embedding") == r["d"]
        found.append(of_length(base.filter(own), asked.filter(own), r["d"], r["count"], kind, k, miss, centroids, max_train, seed))
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = functools.reduce(DataFrame.unionByName, found)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def of_length(base: DataFrame, asked: DataFrame, size: int, total: int, kind: str, k: int, miss: float, centroids: int | None, max_train: int, seed: int) -> DataFrame:
    """query_id, vec_id, score: k rows at most of each query and bucket, for vectors of one length."""
    spark = base.sparkSession
    mark = F.xxhash64("vec_id", F.lit(seed))
    some = base.filter(F.pmod(mark, F.lit(1 << 30)) < min(1.0, 2 * max_train / total) * (1 << 30)).orderBy(mark, "vec_id").limit(max_train).toArrow().combine_chunks()
    if not len(some):
        some = base.limit(max_train).toArrow().combine_chunks()
    centroids = centroids or max(1, min(MAX_CENTROIDS, round((total / CELL) ** 0.5)))
    ids, sample = some.column("vec_id").to_numpy(), np.concatenate([matrix(c, size) for c in some.column("embedding").chunks])
    sent_index = spark.sparkContext.broadcast(Index(ids, sample, centroids, 10, seed))
    shape = tuple(len(b) for b in sent_index.value.books)

    def index(batches):
        for batch in batches:
            if len(batch):
                cell = sent_index.value.cells(matrix(batch.column(1), size))
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *batch.columns], names=["cell", "vec_id", "embedding"])

    entries = materialize(base.mapInArrow(index, f"cell int, vec_id long, embedding {kind}"), "index")
    counts = np.zeros(shape[0] * shape[1], np.int64)
    for r in entries.groupBy("cell").count().collect():  # one row a cell at most
        counts[r["cell"]] = r["count"]
    width = max(1, min(BUCKET, -(-total // MIN_BUCKETS)))
    parts = np.maximum(1, -(-counts // width))
    # Small cells share a bucket with their neighbours; a cell of several parts has buckets of its own.
    start, held = np.zeros(len(counts), np.int64), 0
    number = 0
    for c, (n, p) in enumerate(zip(counts.tolist(), parts.tolist(), strict=True)):
        if held and (p > 1 or held + n > width):
            number, held = number + 1, 0
        start[c] = number
        held += n
        if p > 1:
            number, held = number + p, 0
    sent = spark.sparkContext.broadcast((counts, start, parts))

    def deal(batches):
        _, start, parts = sent.value
        for batch in batches:
            cell, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            part = (mix64(ids.view(np.uint64)) % parts[cell].astype(np.uint64)).astype(np.int64)
            n = len(batch)
            yield pa.RecordBatch.from_arrays([pa.array((start[cell] + part).astype(np.int32)), pa.array(np.zeros(n, np.int32)), *batch.columns[1:], pa.array(np.zeros(n)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32)), batch.column(0))], names=names)

    def probes(batches):
        """A row for each query and bucket that its walk enters, with the cells."""
        counts, start, parts = sent.value
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                x = matrix(batch.column(1), size)
                buckets, rows, floors, lists = [], [], [], []
                for i, (floor, cells, sure) in enumerate(sent_index.value.walks(batch.column(0).to_numpy(), x, counts.reshape(shape), k, miss)):
                    n = parts[cells]
                    bucket = np.repeat(start[cells], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    known, cells = np.repeat(np.arange(len(cells)) < sure, n), np.repeat(cells, n)
                    order = np.argsort(bucket, kind="stable")
                    bucket, cells, known = bucket[order], cells[order].astype(np.int32), known[order]
                    edges = [0, *(np.flatnonzero(np.diff(bucket)) + 1).tolist(), len(bucket)]
                    buckets += bucket[edges[:-1]].tolist()
                    rows += [i] * (len(edges) - 1)
                    # Where the first k vectors of the walk are, all count; elsewhere only what reaches the floor.
                    floors += [-np.inf if known[a:b].any() else floor for a, b in itertools.pairwise(edges)]
                    lists += [cells[a:b] for a, b in itertools.pairwise(edges)]
                own = batch.take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(np.ones(len(rows), np.int32)), *own.columns, pa.array(floors, pa.float64()), pa.array(lists, pa.list_(pa.int32()))], names=names)

    names = ["bucket", "kind", "vec_id", "embedding", "floor", "cells"]
    schema = f"bucket int, kind int, vec_id long, embedding {kind}, floor double, cells array<int>"
    rows = entries.mapInArrow(deal, schema).unionByName(asked.mapInArrow(probes, schema)).repartition("bucket").sortWithinPartitions("bucket", "kind", "vec_id")
    return rows.mapInArrow(ranker(size, k), "query_id long, vec_id long, score double")


def ranker(size: int, k: int):
    def run(batches):
        state = None
        for batch in batches:
            number, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(number) != 0) | (np.diff(kind) != 0)) + 1
            for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)], strict=True):
                if start == end:
                    continue
                own = batch.slice(start, end - start)
                b = int(number[start])
                if state is None or state.number != b:
                    state = Bucket(b, size, k)
                if kind[start] == 0:
                    state.add(own)
                else:
                    for at in range(0, len(own), QUERY_BLOCK):
                        yield from state.rank(own.slice(at, QUERY_BLOCK))

    return run


def lowered(floor: np.ndarray) -> np.ndarray:
    """Floors less what products of matrices may be off; exact scores are taken of what passes."""
    return np.where(np.isfinite(floor), floor - 1e-9 * (1 + np.abs(floor)), -np.inf)


class Bucket:
    """Vectors of a bucket by cell; of equal vectors the k + 1 smallest ids are kept, as no rank needs more."""

    def __init__(self, number: int, size: int, k: int):
        self.number, self.size, self.k = number, size, k
        self.held: list | None = []
        self.cells: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def add(self, batch) -> None:
        self.held.append((batch.column(5).flatten().to_numpy(), batch.column(2).to_numpy(), matrix(batch.column(3), self.size)))

    def build(self) -> None:
        cells, ids, x = (np.concatenate([h[i] for h in self.held]) for i in range(3))
        self.held = None
        order = np.lexsort((ids, cells))
        cells, ids, x = cells[order], ids[order], x[order]
        edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        for start, end in itertools.pairwise(edges):
            seen: dict[bytes, int] = {}
            keep = []
            for i in range(start, end):
                n = seen[v] = seen.get(v := x[i].tobytes(), 0) + 1
                if n <= self.k + 1:
                    keep.append(i)
            self.cells[int(cells[start])] = (ids[keep], x[keep])

    def rank(self, batch):
        if self.held:
            self.build()
        names, q, floor = batch.column(2).to_numpy(), matrix(batch.column(3), self.size), batch.column(4).to_numpy().copy()
        asked = batch.column(5)
        who = np.repeat(np.arange(len(batch)), np.diff(asked.offsets.to_numpy()))
        cells = asked.flatten().to_numpy()
        order = np.argsort(cells, kind="stable")
        who, cells = who[order], cells[order]
        edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)]
        found, held = [], 0
        slack = lowered(floor)
        for start, end in itertools.pairwise(edges):
            if int(cells[start]) not in self.cells:
                continue
            ids, x = self.cells[int(cells[start])]
            step = max(1, HELD // len(ids))
            for at in range(start, end, step):
                own = who[at : min(end, at + step)]
                scores = q[own] @ x.T
                near = scores >= slack[own][:, None]
                i, j = np.nonzero(near & (ids[None] != names[own][:, None]))
                found.append((own[i], ids[j], (q[own[i]] * x[j]).sum(axis=1)))
                held += len(i)
                if held > HELD // 8:
                    found, floor = self.best(found, floor)
                    held, slack = len(found[0][0]), lowered(floor)
        if found:
            (who, ids, scores), = self.best(found, floor)[0]
            yield pa.RecordBatch.from_arrays([pa.array(names[who]), pa.array(ids), pa.array(scores)], names=["query_id", "vec_id", "score"])

    def best(self, found, floor):
        """The k best of each query so far, and the scores that later ones have to reach."""
        who, ids, scores = (np.concatenate([f[i] for f in found]) for i in range(3))
        order = np.lexsort((ids, -scores, who))
        who, ids, scores = who[order], ids[order], scores[order]
        start = np.searchsorted(who, np.arange(len(floor)))
        rank = np.arange(len(who)) - start[who]
        last = rank == self.k - 1
        floor = floor.copy()
        floor[who[last]] = np.maximum(floor[who[last]], scores[last])
        keep = rank < self.k
        return [(who[keep], ids[keep], scores[keep])], floor


def op1_ann_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


QUERIES = {"op1_ann_search": op1_ann_search}
ORACLES: dict[str, str] = {}
