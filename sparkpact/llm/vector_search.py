"""Exact top-k search by inner product with a pivot-distance index.

Vectors are scaled to whole numbers. One more coordinate lifts them all to one length (the
longest's), so that a larger inner product is a shorter distance, and the triangle inequality
holds. Each vector is kept under its nearest pivot, in order of its distance from it. Runs of that
order are annuli; some annuli that follow each other are a group, which is one stretch of a file
in the shared folder. A directory names each group's pivot, distances and place.

A task takes a block of queries that lie close together. It starts at the groups around their own
distances and expands outward: |d(q, p) - d(x, p)| bounds d(q, x) from below, so groups follow in
the order of that bound, and the walk stops where it is over the distance of every query's k-th
best. Groups are read from the files by range, only by the tasks that want them; nothing of the
index is shuffled or sent around. Inner products are whole numbers and exact; bounds are widened by
what rounding could take.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkpact.llm.common import fresh_path, saved

SCALE = 1024
#: Rows that pivots are chosen from: those with the smallest hash of their id.
SAMPLE_ROWS = 4_096
PIVOTS = 32
ANNULUS_ROWS = 512
#: Vectors of a group, in bytes, about; a group has one annulus at least.
GROUP_BYTES = 4_000_000
#: Queries of a task, at most and (where tasks are few) at least.
QUERY_BLOCK = 4_096
QUERY_LEAST = 64
#: Groups that are dealt to a part, at least: a part that starts anew finds its own bound.
LEAST_GROUPS = 16
#: Inner products up to here are exact in floating point; up to the second, in whole numbers of 64 bits.
EXACT_FLOAT, EXACT_WHOLE = 2.0**53, 2.0**62
NONE = np.iinfo(np.int64).min


def whole_vectors(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """id and x array<double>: floor(scale * component). Vectors that are null or hold null or
    non-finite components are left out."""
    ok = F.col(vector_col).isNotNull() & F.forall(vector_col, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    scaled = F.transform(vector_col, lambda c: F.floor(c.cast("double") * scale).cast("double"))
    return vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.when(ok, scaled).alias("x")).where("x is not null and size(x) > 0")


def lifted(x: np.ndarray, longest: float) -> np.ndarray:
    """x with the coordinate that makes its length sqrt(longest)."""
    rest = np.sqrt(np.maximum(0.0, longest - (x * x).sum(axis=1)))
    return np.column_stack([x, rest])


def pivots_of(rows: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first pivots: each new one is the row farthest from those chosen; ties to the first."""
    chosen = [0]
    far = np.linalg.norm(rows - rows[0], axis=1)
    while len(chosen) < min(count, len(rows)):
        k = int(far.argmax())
        if far[k] == 0:
            break
        chosen.append(k)
        far = np.minimum(far, np.linalg.norm(rows - rows[k], axis=1))
    return rows[chosen]


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x * x).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1) - 2 * x @ pivots.T
    return np.sqrt(np.maximum(0.0, square))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


class PivotIndex:
    """Where the groups and their directory are, the pivots, and what all vectors have in common."""

    def __init__(self, directory: str, groups: int, pivots: np.ndarray, longest: float, width: int) -> None:
        self.directory, self.groups, self.pivots, self.longest, self.width = directory, groups, pivots, longest, width
        side = np.sqrt(longest)
        #: Components as stored: the narrowest whole numbers that hold them.
        self.kind = np.dtype(np.int16 if side < 2**15 else np.int32 if side < 2**31 else np.int64)
        self.exact_kind = np.dtype(float if longest < EXACT_FLOAT else np.int64)

    def upper(self, square: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The largest inner product at a distance of bound or more, of queries of squared length square."""
        slack = 1e-6 * (np.sqrt(self.longest) + np.sqrt(square))
        return (square + self.longest - np.maximum(0.0, bound - slack) ** 2) / 2 + 1e-12 * (square + self.longest) + 0.5

    def far(self, x: np.ndarray) -> np.ndarray:
        """Distances of queries from the pivots: a query's own lifting coordinate is 0."""
        return distances(np.column_stack([x, np.zeros(len(x))]), self.pivots)

    def pack(self, ids: np.ndarray, rows: np.ndarray, far: np.ndarray, x: np.ndarray) -> bytes:
        return ids.tobytes() + rows.tobytes() + far.tobytes() + x.astype(self.kind).tobytes()

    def unpack(self, raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids, rows, far = (np.frombuffer(raw, kind, n, 8 * n * k) for k, kind in enumerate((np.int64, np.int64, float)))
        return ids, rows, far, np.frombuffer(raw, self.kind, n * self.width, 24 * n).reshape(n, self.width).astype(self.exact_kind)


def build(whole: DataFrame, width: int, longest: float, sample_rows: int = SAMPLE_ROWS, count: int = PIVOTS, annulus_rows: int = ANNULUS_ROWS, group_bytes: int = GROUP_BYTES) -> PivotIndex:
    """Index every vector of whole (row, id, x); pivots come from a sample of bounded size, fixed by the ids' hashes."""
    sample = whole.orderBy(F.xxhash64("id"), "id", "row").limit(sample_rows).toPandas()
    pivots = pivots_of(lifted(np.array(sample["x"].tolist(), float).reshape(-1, width), longest), count) if len(sample) else np.zeros((1, width + 1))
    folder = fresh_path(whole.sparkSession, "annuli")
    directory = f"{folder}/directory"
    index = PivotIndex(directory, 0, pivots, longest, width)
    group_rows = max(1, group_bytes // (index.kind.itemsize * width) // annulus_rows) * annulus_rows

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = distances(lifted(matrix(b.column(2)), longest), pivots)
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["row", "id", "x", "pivot", "distance"])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Groups in order of pivot and distance, one after the other in a file of this task's own."""
        name, at, stream = f"{folder}/groups-{uuid.uuid4().hex}", 0, None
        held: list[tuple[np.ndarray, ...]] = []
        size, places = 0, []

        def flush(last: bool) -> None:
            nonlocal held, size, at, stream
            rows, ids, x, pivot, far = (np.concatenate(c) for c in zip(*held, strict=True))
            held, size = [], 0
            ends = [0, *(np.flatnonzero(pivot[1:] != pivot[:-1]) + 1), len(ids)]
            for s, e in zip(ends, ends[1:], strict=False):
                if e == len(ids) and not last:  # this pivot may go on
                    keep = s + (e - s) // group_rows * group_rows
                    held, size = [tuple(c[keep:] for c in (rows, ids, x, pivot, far))], e - keep
                    e = keep
                for k in range(s, e, group_rows):
                    to = min(e, k + group_rows)
                    if stream is None:
                        store, path = pafs.FileSystem.from_uri(name)
                        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                        stream = store.open_output_stream(path, compression=None)
                    raw = index.pack(ids[k:to], rows[k:to], far[k:to], x[k:to])
                    stream.write(raw)
                    places.append((name, at, len(raw), to - k, int(pivot[k]), float(far[k]), float(far[to - 1])))
                    at += len(raw)

        for b in batches:
            if b.num_rows:
                held.append((b.column(0).to_numpy(), b.column(1).to_numpy(), matrix(b.column(2)), b.column(3).to_numpy(), b.column(4).to_numpy()))
                size += b.num_rows
                if size >= 2 * group_rows:
                    flush(False)
        if held:
            flush(True)
        if stream is not None:
            stream.close()
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64())
        columns = list(zip(*places, strict=True)) or [[]] * 7
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["file", "offset", "bytes", "n", "pivot", "low", "high"])

    placed = whole.select("row", "id", "x").mapInArrow(place, "row long, id long, x array<double>, pivot int, distance double")
    # the row breaks ties, so that one very common vector is spread over many ranges
    in_order = placed.repartitionByRange("pivot", "distance", "row").sortWithinPartitions("pivot", "distance", "row")
    in_order.mapInArrow(write, "file string, offset long, bytes long, n long, pivot int, low double, high double").write.parquet(directory)
    index.groups = whole.sparkSession.read.parquet(directory).count()
    return index


class GroupReader:
    """The directory of an index, and groups by range."""

    def __init__(self, index: PivotIndex) -> None:
        store, path = pafs.FileSystem.from_uri(index.directory)
        table = pads.dataset(path, filesystem=store, format="parquet").to_table().sort_by([("pivot", "ascending"), ("low", "ascending"), ("file", "ascending"), ("offset", "ascending")])
        self.index = index
        self.files, (self.offset, self.bytes, self.n) = table["file"].to_pylist(), (table[c].to_numpy() for c in ("offset", "bytes", "n"))
        self.pivot, self.low, self.high = (table[c].to_numpy() for c in ("pivot", "low", "high"))

    def read(self, g: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        store, path = pafs.FileSystem.from_uri(self.files[g])
        with store.open_input_file(path) as f:
            f.seek(int(self.offset[g]))
            return self.index.unpack(f.read(int(self.bytes[g])), int(self.n[g]))


def searched(reader: GroupReader, own: np.ndarray, x: np.ndarray, k: int, part: int, parts: int, annulus_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best k (score, id, row) for a block of queries among the groups of one part, and how many
    vectors each query was compared with. Groups follow by bound, so the walk stops at the first one
    that no query of the block can want."""
    index = reader.index
    q, exact = len(own), x.astype(index.exact_kind)
    square, far = (x * x).sum(axis=1), index.far(x)
    groups = np.arange(part, len(reader.files), parts)
    pivot, low, high = reader.pivot[groups], reader.low[groups], reader.high[groups]
    # of the block: each pivot's nearest and farthest query, so the directory is looked at once, not once a query
    least, most = far.min(axis=0)[pivot], far.max(axis=0)[pivot]
    reach = index.upper(np.full(len(groups), square.max()), np.maximum(0.0, np.maximum(low - most, least - high)))
    off = np.maximum(0.0, np.maximum(low - far.mean(axis=0)[pivot], far.mean(axis=0)[pivot] - high))
    best = [np.full((q, k), NONE), np.full((q, k), np.iinfo(np.int64).max), np.full((q, k), np.iinfo(np.int64).max)]
    compared = np.zeros(q, np.int64)

    def kth() -> np.ndarray:
        return np.where(best[0][:, -1] == NONE, -np.inf, best[0][:, -1].astype(float))

    floor = kth()
    for o in np.lexsort((least, off, -reach)):  # outward from the queries' own annuli
        if reach[o] < floor.min():
            break
        if not (index.upper(square, np.maximum(0.0, np.maximum(low[o] - far[:, pivot[o]], far[:, pivot[o]] - high[o]))) >= floor).any():
            continue
        ids, rows, at, vectors = reader.read(int(groups[o]))
        for s in range(0, len(ids), annulus_rows):
            e = min(len(ids), s + annulus_rows)
            d = far[:, pivot[o]]
            go = np.flatnonzero(index.upper(square, np.maximum(0.0, np.maximum(at[s] - d, d - at[e - 1]))) >= floor)
            if not len(go):
                continue
            compared[go] += e - s
            scores = (exact[go] @ vectors[s:e].T).astype(np.int64)
            scores[own[go][:, None] == rows[s:e]] = NONE
            found = [np.concatenate([b[go], np.broadcast_to(c, scores.shape)], axis=1) for b, c in zip(best, (scores, ids[s:e], rows[s:e]), strict=True)]
            if found[0].shape[1] > 4 * k:  # all that reach the k-th best, ties included, then in order
                edge = np.partition(found[0], found[0].shape[1] - k, axis=1)[:, found[0].shape[1] - k]
                found[0] = np.where(found[0] >= edge[:, None], found[0], NONE)
            order = np.lexsort((found[2], found[1], -1 - found[0]), axis=1)[:, :k]  # -1 - x turns the order around without overflow
            for b, c in zip(best, found, strict=True):
                b[go] = np.take_along_axis(c, order, 1)
        floor = kth()
    return *best, compared


def search(queries: DataFrame, index: PivotIndex, k: int, annulus_rows: int = ANNULUS_ROWS) -> DataFrame:
    """(query_row, query_id, id, row, score, compared): the k best of each query (row, id, x).

    Queries are dealt in the order of their nearest pivot and distance, so those of a block want
    the same groups. Where queries are too few for all cores, the groups are dealt out too, and each
    part of them gives its own k best.
    """
    spark = queries.sparkSession
    n = queries.count()
    cores = 2 * spark.sparkContext.defaultParallelism
    blocks = max(1, -(-n // QUERY_BLOCK), min(cores, -(-n // QUERY_LEAST)))
    parts = max(1, min(index.groups // LEAST_GROUPS, cores // blocks))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = index.far(matrix(b.column(2)))
                near = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(d)), near])], ["row", "id", "x", "pivot", "distance"])

    names = ["query_row", "query_id", "id", "row", "score", "compared"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = None
        for held in blocks_of(batches, QUERY_BLOCK):
            part, own, asked = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in range(3))
            x = np.concatenate([matrix(b.column(3)) for b in held])
            reader = reader or GroupReader(index)
            for p in np.unique(part):
                mine = part == p
                scores, ids, rows, compared = searched(reader, own[mine], x[mine], k, int(p), parts, annulus_rows)
                r, c = np.nonzero(scores != NONE)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (own[mine][r], asked[mine][r], ids[r, c], rows[r, c], scores[r, c], np.where(c == 0, compared[r], 0))], names)

    near = queries.select("row", "id", "x").mapInArrow(place, "row long, id long, x array<double>, pivot int, distance double")
    dealt = near.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).repartitionByRange(blocks * parts, "part", "pivot", "distance", "row").sortWithinPartitions("part", "pivot", "distance", "row")
    return dealt.select("part", "row", "id", "x").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def blocks_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[list[pa.RecordBatch]]:
    """Batches in runs of so many rows, about."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        for at in range(0, b.num_rows, rows):
            held.append(b.slice(at, rows))
            size += held[-1].num_rows
            if size >= rows:
                yield held
                held, size = [], 0
    if held:
        yield held


def top_k(vectors: DataFrame, query_filter: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE, compared: bool = False) -> DataFrame:
    """For each row that query_filter (over id) picks, the k other rows with the highest inner products.

    Returns query_id long, rank int, id_col long, score long; ties go to the smaller id. With
    compared=True also how many vectors the query was compared with.

    Vectors that are null, empty, or hold null or non-finite components take no part, nor do rows
    without id. Vectors of fewer components than the widest: as if followed by zeros. Fewer than k
    others: all of them. Repeated ids: each row asks for itself, and stands as a candidate to all
    other rows. Empty table: empty result. Vectors so long that an inner product could leave 64 bits
    (a squared length of 2**62 or more, after scaling) raise ValueError.
    """
    spark = vectors.sparkSession
    empty = f"query_id long, rank int, `{id_col}` long, score long" + (", compared long" if compared else "")
    # the row number is written down with the row, so it stays what it is
    whole = saved(whole_vectors(vectors, id_col, vector_col, scale).withColumn("row", F.monotonically_increasing_id()), "vectors")
    square = F.aggregate("x", F.lit(0.0), lambda a, c: a + c * c)
    sizes = whole.agg(F.max(F.size("x")).alias("width"), F.min(F.size("x")).alias("narrow"), F.max(square).alias("longest")).first()
    if sizes["width"] is None:
        return spark.createDataFrame([], empty)
    if not sizes["longest"] < EXACT_WHOLE:
        raise ValueError(f"the longest vector has a squared length of {sizes['longest']:.3g}: inner products might not fit into 64 bits")
    if sizes["narrow"] < sizes["width"]:
        whole = whole.withColumn("x", F.concat("x", F.array_repeat(F.lit(0.0), F.lit(sizes["width"]) - F.size("x"))))
    index = build(whole, sizes["width"], float(sizes["longest"]))
    found = search(whole.where(query_filter), index, k)
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "id", "row")
    ranked = found.withColumn("rank", F.row_number().over(order))
    if compared:
        ranked = ranked.withColumn("compared", F.sum("compared").over(Window.partitionBy("query_row")))
    ranked = ranked.where(F.col("rank") <= k)
    return ranked.select(F.col("query_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score", *(["compared"] if compared else []))
