"""Nearest neighbours by cosine through an inverted file: cells fitted by k-means in Spark rounds, and a merging top-k.

fit() finds cells on a bounded sample; index() puts every vector into the cell of its nearest centre.  search() sends each
query to its nearest cells first.  A cell's vectors are dealt to parts of about PART rows, and its queries to parts of about
ASKED, so that neither a cell that holds a third of the vectors nor one that all queries visit is one task's.  Each pair of
parts keeps the k best of a query; Spark merges these, again keeping k of a query and task before the shuffle.

With `certain`, queries go on to every cell that may still hold one of their k best: a vector x of a cell with centre c and
radius r (an angle) has an angle to q of at least angle(q, c) - r.  The result is then exact, whatever the cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnwright.operators.joins import named
from tarnwright.operators.windows import top_per_group
from tarnwright.sources.scratch import scratch_path

#: Vectors on which cells are fitted, at most; cells at most; rounds of k-means.
SAMPLE, CELLS, ROUNDS = 50_000, 4_096, 6
#: Rows of a part of a cell, and queries of a part, about.
PART, ASKED = 20_000, 2_000
#: Cosines are equal that agree in so many digits, so that ties don't depend on how a product was summed.
DIGITS = 9
#: Parts of an index up to which a row for each is broadcast.
BROADCAST_ROWS = 200_000


class Cells(NamedTuple):
    centers: np.ndarray
    radius: np.ndarray  # largest angle of a cell's vectors to its centre
    parts: np.ndarray  # of each cell


class Index(NamedTuple):
    vectors: DataFrame  # cell, part, key, vector (unit length)
    cells: Cells


def _written(df: DataFrame, name: str) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _lists(rows: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows, np.float64).ravel()))


def units(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """key and vector, of unit length in double precision; vectors that are null, empty, zero or hold null or non-finite components are left out."""
    x = named(vector).cast("array<double>")
    sound = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    largest = F.array_max(F.transform("x", lambda v: F.abs(v)))  # first, so that squares neither vanish nor overflow
    kept = rows.filter(F.coalesce(sound, F.lit(False))).select(named(key).alias("key"), x.alias("x"))
    scaled = kept.select("key", F.transform("x", lambda v: v / largest).alias("x"))
    norm = F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v))
    return scaled.select("key", F.transform("x", lambda v: v / norm).alias("vector"))


def fit(vectors: DataFrame, cells: int, sample: int = SAMPLE, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of cells, by k-means on at most `sample` vectors (those whose keys' hashes are least); at most cells, and
    vectors sampled, at least one.  Each round is a scan that adds up a cell's vectors by task, and a shuffle of these sums."""
    some = _written(vectors.orderBy(F.xxhash64("key", "vector")).limit(sample).select("vector"), "sample")
    centers = _matrix(some.limit(min(cells, CELLS)).toArrow()["vector"].combine_chunks())
    for _ in range(rounds):
        table = some.mapInArrow(_sums(centers), "cell int, sums array<double>").groupBy("cell").agg(
            F.array(*[F.sum(F.col("sums")[i]) for i in range(centers.shape[1])]).alias("sums")
        )
        moved = centers.copy()
        for r in table.collect():  # a row for each cell
            total = np.array(r["sums"])
            norm = np.linalg.norm(total)
            if norm > 0:
                moved[r.cell] = total / norm
        centers = moved
    return centers


def _sums(centers: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, used = np.zeros(centers.shape), np.zeros(len(centers), bool)
        for batch in batches:
            x = _matrix(batch.column(0))
            cell = (x @ centers.T).argmax(1) if len(x) else np.zeros(0, int)
            np.add.at(sums, cell, x)
            used[cell] = True
        at = np.flatnonzero(used)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), _lists(sums[at])], ["cell", "sums"])

    return run


def index(vectors: DataFrame, cells: int | None = None, part: int = PART, sample: int = SAMPLE, rounds: int = ROUNDS) -> Index:
    """The inverted file of units(): all vectors must have the same length.  By default a cell for each square root of their number."""
    kind = vectors.schema["key"].dataType.simpleString()
    if cells is None:
        cells = max(1, min(CELLS, round(vectors.count() ** 0.5)))
    if vectors.isEmpty():
        return Index(vectors.selectExpr("0 AS cell", "0 AS part", "*"), Cells(np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64)))
    centers = fit(vectors, cells, sample, rounds)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("vector"))
            near = x @ centers.T if len(x) else np.zeros((0, len(centers)))
            angle = np.arccos(np.clip(near.max(1, initial=-1.0), -1, 1))
            yield pa.RecordBatch.from_arrays([pa.array(near.argmax(1).astype(np.int32)), pa.array(angle), batch.column("key"), batch.column("vector")], ["cell", "angle", "key", "vector"])

    held = _written(vectors.select("key", "vector").mapInArrow(assign, f"cell int, angle double, key {kind}, vector array<double>"), "cells")
    radius, parts = np.zeros(len(centers)), np.ones(len(centers), np.int64)
    for r in held.groupBy("cell").agg(F.max("angle").alias("angle"), F.count(F.lit(1)).alias("n")).collect():  # a row for each cell
        radius[r.cell], parts[r.cell] = r.angle, -(-r.n // part)
    dealt = F.pmod(F.xxhash64("key", "vector"), F.array(*[F.lit(int(p)) for p in parts])[F.col("cell")]).cast("int") if parts.max() > 1 else F.lit(0)
    return Index(held.select("cell", dealt.alias("part"), "key", "vector"), Cells(centers, radius, parts))


def _visits(at: Cells, probe: int, first: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For each query the cells it goes to: the nearest `probe`, or else those beyond that may hold a vector as near as `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                some = batch.slice(a, 256)
                near = _matrix(some.column("vector")) @ at.centers.T
                place = np.empty(near.shape, np.int64)
                np.put_along_axis(place, np.argsort(-near, axis=1, kind="stable"), np.arange(near.shape[1])[None], axis=1)
                go = place < probe
                if not first:
                    bound = np.cos(np.maximum(0, np.arccos(np.clip(near, -1, 1)) - at.radius))
                    go = ~go & (bound >= some.column("least").to_numpy(zero_copy_only=False)[:, None] - 10.0**-DIGITS)
                row, cell = np.nonzero(go)
                # a cell's queries meet each of its parts
                n = at.parts[cell]
                row, cell, part = np.repeat(row, n), np.repeat(cell, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(part.astype(np.int32)), some.column("key").take(pa.array(row)), some.column("vector").take(pa.array(row))], ["cell", "part", "query", "vector"])

    return run


def _best(k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The k best of each query among the vectors of one part, but for itself; both sides come in bounded numbers."""

    def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
        keys, queries = rows["key"].combine_chunks(), asked["query"].combine_chunks()
        x, q = _matrix(rows["vector"].combine_chunks()), _matrix(asked["vector"].combine_chunks())
        order = pc.sort_indices(keys).to_numpy() if len(keys) else np.zeros(0, np.int64)  # ties: the smaller key
        x, keys = x[order], keys.take(pa.array(order))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a in range(0, len(q), 64):
            near = np.round(q[a : a + 64] @ x.T, DIGITS) if len(x) else np.zeros((len(q[a : a + 64]), 0))
            for i, row in enumerate(near):
                here = np.flatnonzero(row >= np.partition(row, -k - 1)[-k - 1]) if len(row) > k + 1 else np.arange(len(row))
                best = here[np.argsort(-row[here], kind="stable")][: k + 1]  # one more, as the query may be among them
                out.append((np.full(len(best), a + i), best, row[best]))
        which, best, near = (np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3
        return pa.table({"query": queries.take(pa.array(which)), "key": keys.take(pa.array(best)), "cosine": pa.array(near, pa.float64())})

    return run


def _met(at: Index, visits: DataFrame, k: int, asked: int) -> DataFrame:
    """query, key, cosine of the k best of each query in each part it visits."""
    kinds = visits.schema["query"].dataType.simpleString(), at.vectors.schema["key"].dataType.simpleString()
    counts = visits.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / asked).cast("int").alias("deals"))
    shares = F.broadcast(counts) if at.cells.parts.sum() <= BROADCAST_ROWS else counts  # a row for each part of the index
    queries = visits.join(shares, ["cell", "part"]).withColumn("deal", F.pmod(F.xxhash64("query"), F.col("deals")).cast("int"))
    rows = at.vectors.join(shares, ["cell", "part"]).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1)))
    by = ["cell", "part", "deal"]
    met = rows.select(*by, "key", "vector").groupBy(*by).cogroup(queries.select(*by, "query", "vector").groupBy(*by))
    found = met.applyInArrow(_best(k), f"query {kinds[0]}, key {kinds[1]}, cosine double").filter(~F.col("query").eqNullSafe(F.col("key")))
    return top_per_group(found, ["query"], [F.desc("cosine"), F.asc("key")], k)


def search(at: Index, queries: DataFrame, k: int = 10, probe: int = 8, certain: bool = True, asked: int = ASKED) -> DataFrame:
    """query, key, cosine, place: the k vectors of the index nearest to each query (units()), the nearest first, from place 1.

    A query is not its own neighbour: keys equal to its key are left out.  Equal cosines (to DIGITS digits) are in order of
    keys.  Rows of queries with one key are one query if their vectors are equal, else each finds what it finds, and the k
    best stay.  Without `certain`, only the nearest `probe` cells are looked into.  An empty index gives no rows.
    """
    kinds = queries.schema["key"].dataType.simpleString(), at.vectors.schema["key"].dataType.simpleString()
    if not len(at.cells.centers):
        return queries.sparkSession.createDataFrame([], f"query {kinds[0]}, key {kinds[1]}, cosine double, place int")
    ddl = f"cell int, part int, query {kinds[0]}, vector array<double>"
    queries = queries.select("key", "vector").distinct()
    best = _met(at, _written(queries.mapInArrow(_visits(at.cells, probe, True), ddl), "visits"), k, asked)
    if certain and probe < len(at.cells.centers):
        best = _written(best, "first")
        least = best.groupBy("query").agg(F.when(F.count(F.lit(1)) >= k, F.min("cosine")).alias("least"))
        open_ = queries.join(least, F.col("key").eqNullSafe(F.col("query")), "left").select("key", "vector", F.coalesce("least", F.lit(-2.0)).alias("least"))
        more = _met(at, _written(open_.mapInArrow(_visits(at.cells, probe, False), ddl), "visits"), k, asked)
        best = top_per_group(best.unionByName(more), ["query"], [F.desc("cosine"), F.asc("key")], k)
    return best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "key")))
