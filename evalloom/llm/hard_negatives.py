"""Hard-negative mining over vantage-point trees of norm-augmented vectors.

A vector x gets one more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, and an anchor q gets
zero there. Then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x: larger scores are smaller distances, and a window of
scores is an annulus round the anchor. All scores that decide anything are exact integers; distances
only say which subtrees need no look, with a margin for rounding.

The tree has two levels. Its top is built on the driver from a sample of about ``SAMPLE`` rows and deals
*all* rows to at most ``LEAVES`` leaves; every leaf's exact distance range to each vantage point is known,
and an anchor is sent only to leaves that its annulus can meet. A leaf is split by a hash of its rows into
blocks of bounded size; a task builds the lower tree over its block and searches it nearest first. The
same rows meet all anchors block by block, and neither side of a block grows with the table.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalloom.session import checkpoint, forget, ship_package

#: Integers beyond this size count as not finite: their products would not fit a long.
MAX_COMPONENT = 1 << 26
MAX_DIMS = 2047
#: Rows from which the top of the tree is built; it steers the search and decides no result.
SAMPLE = 2048
LEAVES = 64
#: Rows of a tree's leaf: enough for one vectorised product.
BUCKET = 512

ROWS = "id long, label long, x binary"
POSITIVES = "anchor long, key long, id long, score long"
NEGATIVES = "anchor long, key long, positive_score long, id long, score long"


def vectors_of(binary: pa.Array, dims: int) -> np.ndarray:
    """Packed 32-bit vectors as float64 rows; shorter ones end in zeros."""
    packed = binary.to_pylist()
    if all(len(b) == 4 * dims for b in packed):
        return np.frombuffer(b"".join(packed), np.int32).reshape(-1, dims).astype(np.float64)
    out = np.zeros((len(packed), dims))
    for row, b in zip(out, packed, strict=True):
        row[: len(b) // 4] = np.frombuffer(b, np.int32)
    return out


def _dot(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer inner products; by floats where every partial sum is below 2**53."""
    return a @ b if exact else a.astype(np.int64) @ b.astype(np.int64)


@dataclass
class Node:
    """A vantage point, and of each part below it the distance range to that point."""

    vantage: int
    parts: list[tuple[float, float, int]] = field(default_factory=list)


class Tree:
    """A vantage-point tree over the rows of one block; children are nodes, or buckets as ``~k``."""

    def __init__(self, points: np.ndarray, lift: np.ndarray, bucket: int):
        self.points, self.lift = points, lift
        self.nodes: list[Node] = []
        self.buckets: list[np.ndarray] = []
        self.root = self._build(np.arange(len(points)), bucket)

    def _build(self, rows: np.ndarray, bucket: int, hint: int | None = None) -> int:
        if len(rows) <= bucket:
            self.buckets.append(rows)
            return ~(len(self.buckets) - 1)
        vantage = int(rows[0]) if hint is None else hint
        gap = self.points[rows] - self.points[vantage]
        far = np.sqrt(np.einsum("ij,ij->i", gap, gap) + (self.lift[rows] - self.lift[vantage]) ** 2)
        order = np.argpartition(far, len(rows) // 2)
        node = len(self.nodes)
        self.nodes.append(Node(vantage))
        for half in (order[: len(rows) // 2], order[len(rows) // 2 :]):
            d = far[half]
            # The farthest row of a part is a corner of it: a good next vantage point.
            child = self._build(rows[half], bucket, int(rows[half[d.argmax()]]))
            self.nodes[node].parts.append((float(d.min()), float(d.max()), child))
        return node


def _bounds(near: float, far: float, to_vantage: float, low: float, high: float) -> tuple[float, float]:
    """Tighten the distances at which a part's rows can lie, by the triangle inequality."""
    return max(near, to_vantage - high, low - to_vantage), min(far, to_vantage + high)


class Searcher:
    """The rows of a block, searched for one anchor after another."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, points: np.ndarray, norm2: int, copies: int, bucket: int):
        keep = self._distinct(ids, labels, points, copies)
        self.ids, self.labels, self.points = ids[keep], labels[keep], points[keep]
        size2 = np.einsum("ij,ij->i", self.points, self.points)
        self.norm2 = norm2
        self.exact = norm2 < 1 << 52
        self.tree = Tree(self.points, np.sqrt(np.maximum(norm2 - size2, 0.0)), bucket)
        at = [n.vantage for n in self.tree.nodes]
        self.vantages, self.lift = self.points[at], self.tree.lift[at]
        # Rows of a bucket side by side: a bucket is a slice, and its product copies nothing.
        order = np.concatenate(self.tree.buckets)
        self.ids, self.labels, self.points = self.ids[order], self.labels[order], self.points[order]
        ends = np.cumsum([len(b) for b in self.tree.buckets]).tolist()
        self.slices = [slice(end - len(b), end) for end, b in zip(ends, self.tree.buckets, strict=True)]

    @staticmethod
    def _distinct(ids: np.ndarray, labels: np.ndarray, points: np.ndarray, copies: int) -> np.ndarray:
        """Of rows equal in label and vector only the ``copies`` smallest ids can come out."""
        order = np.lexsort((ids, labels))
        full = np.ascontiguousarray(np.column_stack([labels, points.astype(np.int64)])[order])
        _, group = np.unique(full.view(np.dtype((np.void, full.shape[1] * 8))).ravel(), return_inverse=True)
        by = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(group[by]) != 0])
        place = np.arange(len(by)) - np.repeat(starts, np.diff(np.r_[starts, len(by)]))
        return order[by[place < copies]]

    def search(self, anchor: np.ndarray, distances: np.ndarray, query: Query) -> None:
        """Open parts nearest first, as long as one may hold a score that ``query`` still wants."""
        room = float(anchor @ anchor) + self.norm2
        margin = 1e-6 * room + 1.0
        nodes = self.tree.nodes
        parts = [(-math.inf, 0, self.tree.root, 0.0, math.inf)]
        serial = 1
        while parts:
            bound, _, child, near, far = heapq.heappop(parts)
            if -bound < query.floor:
                return
            if child < 0:
                rows = self.slices[~child]
                query.take(self.ids[rows], self.labels[rows], _dot(self.points[rows], anchor, self.exact).astype(np.int64))
                continue
            for low, high, below in nodes[child].parts:
                a, b = _bounds(near, far, float(distances[child]), low, high)
                best = (room - a * a) / 2 + margin
                if best >= query.floor and (room - b * b) / 2 - margin <= query.top:
                    heapq.heappush(parts, (-best, serial, below, a, b))
                    serial += 1

    def to_vantages(self, anchors: np.ndarray) -> np.ndarray:
        """Distances of anchors to every node's vantage point."""
        return distances(anchors, self.vantages, self.lift)


def distances(anchors: np.ndarray, points: np.ndarray, lift: np.ndarray) -> np.ndarray:
    size2 = np.einsum("ij,ij->i", anchors, anchors)[:, None]
    own = np.einsum("ij,ij->i", points, points) + lift**2
    return np.sqrt(np.maximum(size2 + own - 2 * (anchors @ points.T), 0.0))


# The top of the tree ------------------------------------------------------------------------------


@dataclass
class Top:
    """The tree over the sample, with a cut radius for each node; every row falls into one leaf."""

    points: np.ndarray
    lift: np.ndarray
    cuts: list[tuple[float, int, int]]
    leaves: int
    norm2: int

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Leaf of each row and its distances to the vantage points."""
        size2 = np.einsum("ij,ij->i", x, x)
        lift = np.sqrt(np.maximum(self.norm2 - size2, 0.0))
        own = np.einsum("ij,ij->i", self.points, self.points) + self.lift**2
        far = np.sqrt(np.maximum(self.norm2 + own - 2 * (x @ self.points.T + np.outer(lift, self.lift)), 0.0))
        return self._leaf(far), far

    def _leaf(self, far: np.ndarray) -> np.ndarray:
        at = np.zeros(len(far), np.int64) if self.cuts else np.full(len(far), -1)
        while (inner := np.flatnonzero(at >= 0)).size:
            for node in np.unique(at[inner]).tolist():
                rows = np.flatnonzero(at == node)
                radius, inside, outside = self.cuts[node]
                at[rows] = np.where(far[rows, node] <= radius, inside, outside)
        return ~at

    def homes(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = distances(anchors, self.points, self.lift)
        return self._leaf(far), far


def build_top(sample: np.ndarray, norm2: int, leaves: int) -> Top:
    """Halve the sample by its median distance to a vantage point until there are enough leaves."""
    lift = np.sqrt(np.maximum(norm2 - np.einsum("ij,ij->i", sample, sample), 0.0))
    depth = max(0, math.ceil(math.log2(leaves))) if len(sample) > 1 else 0
    at: list[int] = []
    cuts: list[tuple[float, int, int]] = []
    count = 0

    def split(rows: np.ndarray, vantage: int, left: int) -> int:
        nonlocal count
        if not left or len(rows) < 2:
            count += 1
            return ~(count - 1)
        gap = sample[rows] - sample[vantage]
        far = np.sqrt(np.einsum("ij,ij->i", gap, gap) + (lift[rows] - lift[vantage]) ** 2)
        radius = float(np.median(far))
        node = len(cuts)
        at.append(vantage)
        cuts.append((radius, 0, 0))
        inner, outer = rows[far <= radius], rows[far > radius]
        children = [split(part, int(part[far[kind].argmax()]) if len(part) else vantage, left - 1) for part, kind in ((inner, far <= radius), (outer, far > radius))]
        cuts[node] = (radius, *children)
        return node

    split(np.arange(len(sample)), 0, depth)
    return Top(sample[at], lift[at], cuts, count, norm2)


# The operator -------------------------------------------------------------------------------------


def integer_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """``id, label, x`` of the rows that take part, ``x`` the entries as integers; equal rows once."""
    v = F.col(vector_col)
    good = F.forall(v, lambda c: F.coalesce(F.abs(F.floor(c.cast("double") * scale)) < MAX_COMPONENT, F.lit(False)) & ~F.isnan(c))
    keyed = vectors.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & v.isNotNull() & good)
    return keyed.select(
        F.col(id_col).cast("long").alias("id"),
        F.col(label_col).cast("long").alias("label"),
        F.transform(v, lambda c: F.floor(c.cast("double") * scale).cast("int")).alias("x"),
    ).dropDuplicates()


def _packed(rows: DataFrame) -> DataFrame:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat = b["x"].flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            ends = np.cumsum(b["x"].value_lengths().to_numpy(zero_copy_only=False))
            x = [p.tobytes() for p in np.split(flat, ends[:-1])] if b.num_rows else []
            yield pa.RecordBatch.from_arrays([b["id"], b["label"], pa.array(x, pa.binary())], ["id", "label", "x"])

    return rows.mapInArrow(pack, ROWS)


class _Index:
    """Rows dealt to the blocks of the leaves, checkpointed, and what routes anchors to them."""

    def __init__(self, rows: DataFrame, block_rows: int | None):
        spark = rows.sparkSession
        size2 = F.aggregate("x", F.lit(0).cast("long"), lambda a, c: a + c.cast("long") * c)
        self.n, self.norm2, self.dims = rows.agg(F.count("*"), F.max(size2), F.max(F.size("x"))).first()
        if self.dims and self.dims > MAX_DIMS:
            raise ValueError(f"{self.dims} dimensions; scores of more than {MAX_DIMS} may not fit a long")
        self.spark = spark
        if not self.n:
            return
        dims, norm2 = self.dims, self.norm2
        per_block = block_rows or min(1 << 17, max(1 << 12, 16 * math.isqrt(self.n)))
        packed = _packed(rows)
        share = max(1, math.ceil((1 << 30) * min(1.0, SAMPLE / self.n)))
        drawn = packed.where(F.pmod(F.xxhash64("id", "label", "x"), F.lit(1 << 30)) < share).orderBy("id", "label", "x").toArrow()
        sample = vectors_of(drawn["x"].combine_chunks(), dims) if drawn.num_rows else np.zeros((1, dims))
        self.top = top = build_top(sample, norm2, max(1, min(LEAVES, math.ceil(self.n / per_block))))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 4096):
                    b = whole.slice(start, 4096)
                    leaf = top.place(vectors_of(b["x"], dims))[0]
                    yield pa.RecordBatch.from_arrays([b["id"], b["label"], b["x"], pa.array(leaf)], ["id", "label", "x", "leaf"])

        self.rows = checkpoint(packed.mapInArrow(place, ROWS + ", leaf long"))

        def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low = np.full((top.leaves, len(top.points)), np.inf)
            high, count = -low, np.zeros(top.leaves, np.int64)
            for whole in batches:
                for start in range(0, whole.num_rows, 4096):
                    b = whole.slice(start, 4096)
                    leaf = b["leaf"].to_numpy()
                    far = top.place(vectors_of(b["x"], dims))[1]
                    np.minimum.at(low, leaf, far)
                    np.maximum.at(high, leaf, far)
                    count += np.bincount(leaf, minlength=top.leaves)
            for i in np.flatnonzero(count).tolist():
                yield pa.RecordBatch.from_pylist([{"leaf": i, "n": int(count[i]), "low": low[i].tolist(), "high": high[i].tolist()}], RANGES)

        RANGES = pa.schema([("leaf", pa.int64()), ("n", pa.int64()), ("low", pa.list_(pa.float64())), ("high", pa.list_(pa.float64()))])
        at = range(len(top.points))
        found = (
            self.rows.mapInArrow(ranges, "leaf long, n long, low array<double>, high array<double>")
            .groupBy("leaf")
            .agg(F.sum("n").alias("n"), F.array(*[F.min(F.col("low")[i]) for i in at]).alias("low"), F.array(*[F.max(F.col("high")[i]) for i in at]).alias("high"))
            .collect()
        )
        self.low, self.high = np.full((top.leaves, len(top.points)), np.inf), np.full((top.leaves, len(top.points)), -np.inf)
        self.splits = np.zeros(top.leaves, np.int64)
        for r in found:
            self.low[r["leaf"]], self.high[r["leaf"]] = r["low"], r["high"]
            self.splits[r["leaf"]] = math.ceil(r["n"] / per_block)
        self.first = np.cumsum(self.splits) - self.splits

    def score_bounds(self, anchors: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest score that each anchor can have with the rows of each leaf."""
        room = np.einsum("ij,ij->i", anchors, anchors)[:, None] + float(self.norm2)
        margin = 1e-6 * room + 1.0
        near, beyond = np.zeros((len(anchors), len(self.splits))), np.full((len(anchors), len(self.splits)), np.inf)
        for v in range(far.shape[1]):
            d = far[:, v : v + 1]
            near = np.maximum(near, np.maximum(d - self.high[:, v], self.low[:, v] - d))
            beyond = np.minimum(beyond, d + self.high[:, v])
        return (room - beyond**2) / 2 - margin, (room - near**2) / 2 + margin

    def searched(self, anchors: DataFrame, parts: int, route, search, schema: str) -> DataFrame:
        """``search(searcher, table, distances)`` for each block and the anchors that ``route`` sends to it."""
        dims, norm2, splits, first = self.dims, self.norm2, self.splits, self.first

        def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 1024):
                    b = whole.slice(start, 1024)
                    row, leaf = np.nonzero(route(b) & (splits > 0))
                    times = splits[leaf]
                    row = np.repeat(row, times)
                    block = np.repeat(first[leaf], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                    taken = b.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(block)], [*taken.schema.names, "block"])

        kinds = ", ".join(f"{k} {t}" for k, t in anchors.dtypes)
        sent = anchors.mapInArrow(send, kinds + ", block long").withColumn("part", F.pmod(F.xxhash64("key"), F.lit(parts).cast("long")))
        leaf_first = F.array(*[F.lit(int(i)) for i in first])
        leaf_splits = F.array(*[F.lit(int(max(1, i))) for i in splits])
        block = F.get(leaf_first, F.col("leaf").cast("int")) + F.pmod(F.xxhash64("id", "label", "x"), F.get(leaf_splits, F.col("leaf").cast("int")))
        dealt = self.rows.select(block.cast("long").alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "id", "label", "x")

        def meet(key, rows: pa.Table, asked: pa.Table) -> pa.Table:
            out = []
            if rows.num_rows and asked.num_rows:
                searcher = Searcher(
                    rows["id"].to_numpy(), rows["label"].to_numpy(), vectors_of(rows["x"].combine_chunks(), dims), norm2, search.copies, BUCKET
                )
                for batch in asked.combine_chunks().to_batches(max_chunksize=1024):
                    anchors = vectors_of(batch["x"], dims)
                    out += search(searcher, batch, anchors, searcher.to_vantages(anchors))
            return pa.Table.from_pylist(out, search.schema)

        return dealt.groupBy("block", "part").cogroup(sent.groupBy("block", "part")).applyInArrow(meet, schema)


class Best:
    """The first ``count`` rows by falling score, then rising id, of those offered between two scores."""

    def __init__(self, count: int, low: float, high: float):
        self.count, self.floor, self.high = count, low, high
        self.found: list[tuple[int, int]] = []

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        at = np.flatnonzero((scores >= self.floor) & (scores <= self.high))
        if len(at) > self.count:
            at = at[np.lexsort((ids[at], -scores[at]))[: self.count]]
        if len(at):
            self.found = sorted([*self.found, *zip((-scores[at]).tolist(), ids[at].tolist(), strict=True)])[: self.count]
            if len(self.found) == self.count:
                self.floor = max(self.floor, -self.found[-1][0])


class Query:
    """What one anchor looks for: ``floor`` is the least score still wanted, ``top`` the largest."""

    floor: float
    top: float = math.inf

    def take(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        raise NotImplementedError


class PositiveQuery(Query):
    """The first rows of the anchor's label, without the anchor, that score at least ``known``."""

    def __init__(self, key: int, label: int, known: int | None, count: int):
        self.key, self.label = key, label
        self.best = Best(count, -math.inf if known is None else known, math.inf)
        self.floor = self.best.floor

    def take(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        mine = (labels == self.label) & (ids != self.key)
        self.best.offer(ids[mine], scores[mine])
        self.floor = self.best.floor


class NegativeQuery(Query):
    """For each window of scores the first rows of another label inside it."""

    def __init__(self, label: int, windows: dict[int, tuple[int, int]], count: int):
        self.label = label
        self.best = {s: Best(count, *w) for s, w in windows.items()}
        self.top = max(b.high for b in self.best.values())
        self.floor = min(b.floor for b in self.best.values())

    def take(self, ids: np.ndarray, labels: np.ndarray, scores: np.ndarray) -> None:
        near = np.flatnonzero((labels != self.label) & (scores >= self.floor) & (scores <= self.top))
        if len(near):
            ids, scores = ids[near], scores[near]
            for b in self.best.values():
                b.offer(ids, scores)
            self.floor = min(b.floor for b in self.best.values())


@dataclass
class _Positives:
    count: int
    copies: int
    schema: pa.Schema

    def __call__(self, searcher: Searcher, batch: pa.RecordBatch, anchors: np.ndarray, far: np.ndarray) -> list[dict]:
        out = []
        for i, row in enumerate(batch.select(["id", "label", "key", "known"]).to_pylist()):
            query = PositiveQuery(row["id"], row["label"], row["known"], self.count)
            searcher.search(anchors[i], far[i], query)
            out += [{"anchor": row["id"], "key": row["key"], "id": key, "score": -score} for score, key in query.best.found]
        return out


@dataclass
class _Negatives:
    count: int
    low: int
    high: int
    copies: int
    schema: pa.Schema

    def window(self, score: int) -> tuple[int, int]:
        """Least and largest integer score between the two percentages of a positive's score."""
        return -(-self.low * score // 100), self.high * score // 100

    def __call__(self, searcher: Searcher, batch: pa.RecordBatch, anchors: np.ndarray, far: np.ndarray) -> list[dict]:
        out = []
        for i, row in enumerate(batch.select(["id", "label", "key", "scores"]).to_pylist()):
            windows = {s: w for s in row["scores"] if (w := self.window(s))[0] <= w[1]}
            if windows:
                query = NegativeQuery(row["label"], windows, self.count)
                searcher.search(anchors[i], far[i], query)
                out += [
                    {"anchor": row["id"], "key": row["key"], "positive_score": s, "id": key, "score": -score}
                    for s, best in query.best.items()
                    for score, key in best.found
                ]
        return out


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.int64()) for c in ddl.split(", ")])


def _first(df: DataFrame, keys: list[str], count: int, rank: str = "rank") -> DataFrame:
    """The first rows of each key by falling score, then rising id; partial ranks come before the shuffle."""
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), "id")
    return df.withColumn(rank, F.row_number().over(order)).where(F.col(rank) <= count)


def hard_negatives(
    vectors: DataFrame,
    anchors: Column,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    scale: int = 256,
    positives: int = 5,
    negatives: int = 3,
    low_percent: int = 50,
    high_percent: int = 95,
    block_rows: int | None = None,
    anchors_per_part: int = 1 << 16,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``.

    ``anchors`` is a condition over ``id`` (and ``label``). An anchor's positives are its first rows of
    the same label with another id; of each, its first rows of another label with
    ``low * positive <= 100 * negative <= high * positive``. Scores are inner products of the integers
    ``floor(scale * c)``; higher ones come first, ties by smaller id.

    Rows with a null id, label or vector, or with an entry that is null, not finite or beyond
    ``MAX_COMPONENT`` once scaled, take no part. Rows equal in id, label and vector count once; an id with
    several labels or vectors is several rows (and several anchors), none of which is a positive of
    another. Shorter vectors count as ending in zeros. Negative positive scores have empty windows. An
    empty table gives no row; other columns are ignored.

    The search is exact: nothing is approximate but which parts are opened first. Anchors meet first the
    leaf they fall into, which gives a bound for the others; then the leaves that can beat it; then, with
    their positives known, the leaves their annuli meet.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    out_schema = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    index = _Index(integer_vectors(vectors, id_col, vector_col, label_col, scale), block_rows)
    if not index.n:
        return spark.createDataFrame([], out_schema)
    dims, top = index.dims, index.top
    asked = index.rows.where(anchors).select("id", "label", "x", F.xxhash64("id", "label", "x").alias("key"))
    parts = max(1, math.ceil(asked.count() / anchors_per_part))

    def home(batch: pa.RecordBatch) -> np.ndarray:
        leaf, _ = top.homes(vectors_of(batch["x"], dims))
        return leaf[:, None] == np.arange(top.leaves)

    found_positives = _Positives(positives, max(positives, negatives) + 1, _schema(POSITIVES))
    seen = index.searched(asked.withColumn("known", F.lit(None).cast("long")), parts, home, found_positives, POSITIVES)
    near = checkpoint(_first(seen, ["anchor", "key"], positives).drop("rank"))
    bound = near.groupBy("anchor", "key").agg(F.when(F.count("*") >= positives, F.min("score")).alias("known"))
    bounded = asked.join(bound.withColumnRenamed("anchor", "id"), ["id", "key"], "left").select("id", "label", "x", "key", "known")

    def others(batch: pa.RecordBatch) -> np.ndarray:
        x = vectors_of(batch["x"], dims)
        leaf, far = top.homes(x)
        known = batch["known"].to_numpy(zero_copy_only=False).astype(np.float64)
        best = index_bounds(x, far)[1]
        return (leaf[:, None] != np.arange(top.leaves)) & (np.isnan(known)[:, None] | (best >= known[:, None]))

    index_bounds = _Bounds(index).score_bounds
    more = index.searched(bounded, parts, others, found_positives, POSITIVES)
    chosen = checkpoint(_first(near.unionByName(more), ["anchor", "key"], positives).drop("rank"))
    wanted = chosen.groupBy("anchor", "key").agg(F.collect_set("score").alias("scores"))
    windows = asked.join(wanted.withColumnRenamed("anchor", "id"), ["id", "key"]).select("id", "label", "x", "key", "scores")
    found_negatives = _Negatives(negatives, low_percent, high_percent, max(positives, negatives) + 1, _schema(NEGATIVES))

    def annuli(batch: pa.RecordBatch) -> np.ndarray:
        x = vectors_of(batch["x"], dims)
        least, best = index_bounds(x, top.homes(x)[1])
        out = np.zeros(least.shape, bool)
        for i, scores in enumerate(batch["scores"].to_pylist()):
            for a, b in map(found_negatives.window, scores):
                if a <= b:
                    out[i] |= (best[i] >= a) & (least[i] <= b)
        return out

    harder = _first(index.searched(windows, parts, annuli, found_negatives, NEGATIVES), ["anchor", "key", "positive_score"], negatives)
    pairs = chosen.select("anchor", "key", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    result = pairs.join(harder, ["anchor", "key", "positive_score"]).select(
        F.col("anchor").alias("anchor_id"),
        "positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
    result = checkpoint(result)
    for done in (near, chosen, index.rows):
        forget(done)
    return result


class _Bounds:
    """What ``_Index.score_bounds`` needs, without its DataFrames: tasks get this only."""

    def __init__(self, index: _Index):
        self.norm2, self.splits, self.low, self.high = index.norm2, index.splits, index.low, index.high

    score_bounds = _Index.score_bounds
