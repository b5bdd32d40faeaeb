"""Near-duplicate vectors by a forest of random-projection trees.

Each tree splits space by random directions at medians of a bounded sample, level by level; a vector close to a split
goes down both sides (spill).  Below the levels that the sample supports, splits go on: all nodes below one that was
fitted share a split for each level, at the mean of its sample, so a tree is as deep as its vectors are many.  Vectors of
one label that share a leaf are compared, block by block, in double precision.  A pair that shares several leaves counts
in the first of them only, which both vectors' lists of leaves tell, so links are counted without a row for each pair; of
its links a block passes on a spanning forest, and components are united from these.

Equal vectors of a label are compared once and counted as often as they stand.  A leaf too large for one block is dealt
out as pairs of blocks.

How often a pair stays together depends on how dense its label is, so it is measured: pairs at the threshold are made
from the sample, of each large label and of all, and the number of trees and the depth are the cheapest at which a share
of RECALL of each kind, which is all of them, meets in some leaf.  Trees split at every size: they have LEVELS levels at least,
or as many as leave LEAF vectors in a leaf.  Pairs closer than the threshold are missed less.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwright.llm.components import components
from tarnwright.llm.shared import hinted, lean, written

THRESHOLD = 0.93
#: Trees at least and at most.
TREES, MOST_TREES = 8, 96
#: Levels at least, where a leaf would still hold more than LEAF vectors.
LEVELS = 3
#: Share of made pairs at the threshold that must meet, of every kind; a kind has so many.
RECALL, PROBES = 1.0, 1000
#: Cost of a row in a leaf, in comparisons of two vectors.
ROW_COST = 2000
#: Vectors of a label that a leaf should hold, spill aside; where no label has more there is nothing to split.
LEAF = 48
#: Vectors that the splits are fitted on, about, and those of a node below which none is fitted.
SAMPLE, FITTED = 10_000, 16
#: Half width of the spill at a split, in standard deviations of the sample's projections.
SPILL = 0.08
#: Numbers in a block of vectors, and vectors at most; larger leaves are compared as pairs of blocks.
BLOCK_VALUES, BLOCK = 1 << 18, 4096
#: Rows that are compared with all of a block, or two, at a time.
STRIP = 256
#: Codes of a tree's leaves start at its number times this.
STRIDE = 1 << 40


class Forest:
    """directions (tree, level), and split points and spill widths by node; nodes are numbered as in a heap from 1.

    Nodes are fitted down to `fitted` levels; from there to `depth`, a level's splits are those of the fitted node above.
    """

    def __init__(self, sample: np.ndarray, depth: int, trees: int = TREES, seed: int = 17):
        rng = np.random.default_rng(seed)
        dims = sample.shape[1]
        self.depth = depth
        self.fitted = min(depth, max(0, int(math.log2(max(1, len(sample) / FITTED)))))
        self.directions = rng.standard_normal((trees, max(depth, 1), dims))
        self.directions /= np.linalg.norm(self.directions, axis=2, keepdims=True)
        self.at, self.spill = (np.zeros((trees, 1 << self.fitted)) for _ in range(2))
        self.deep_at, self.deep_spill = (np.zeros((trees, depth - self.fitted, 2 << self.fitted)) for _ in range(2))
        for t in range(trees):
            nodes = {1: np.arange(len(sample))}
            for level in range(self.fitted):
                below = {}
                for node, rows in nodes.items():
                    p = sample[rows] @ self.directions[t, level]
                    if len(p):
                        self.at[t, node], self.spill[t, node] = np.median(p), SPILL * p.std()
                    below[2 * node], below[2 * node + 1] = rows[p <= self.at[t, node]], rows[p > self.at[t, node]]
                nodes = below
            for node, rows in nodes.items():
                p = sample[rows] @ self.directions[t, self.fitted : depth].T
                if len(p):
                    self.deep_at[t, :, node], self.deep_spill[t, :, node] = p.mean(axis=0), SPILL * p.std(axis=0)

    def _split(self, t: int, level: int, node: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if level < self.fitted:
            return self.at[t, node], self.spill[t, node]
        above = node >> (level - self.fitted)
        return self.deep_at[t, level - self.fitted, above], self.deep_spill[t, level - self.fitted, above]

    def leaves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers and leaf codes: each row at least once for each tree."""
        rows_out, codes = [], []
        for t in range(len(self.directions)):
            rows, node = np.arange(len(unit)), np.ones(len(unit), np.int64)
            for level in range(self.depth):
                p = unit[rows] @ self.directions[t, level]
                at, spill = self._split(t, level, node)
                left, right = p <= at + spill, p > at - spill
                rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
            rows_out.append(rows)
            codes.append(t * STRIDE + node)
        return np.concatenate(rows_out), np.concatenate(codes)

    def together(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """(level, tree, pair): whether the vectors of a pair share a node of that level."""
        out = np.ones((self.depth + 1, len(self.directions), len(a)), bool)
        for t in range(len(self.directions)):
            rows, node = np.arange(len(a)), np.ones(len(a), np.int64)
            for level in range(self.depth):
                p, q = a[rows] @ self.directions[t, level], b[rows] @ self.directions[t, level]
                at, spill = self._split(t, level, node)
                left, right = np.maximum(p, q) <= at + spill, np.minimum(p, q) > at - spill
                rows, node = np.concatenate([rows[left], rows[right]]), np.concatenate([2 * node[left], 2 * node[right] + 1])
                out[level + 1, t] = False
                out[level + 1, t, rows] = True
        return out

    def cut(self, depth: int, trees: int) -> Forest:
        """The first trees down to a depth."""
        if depth < self.fitted:
            # a node of the level at which the trees now end is never split
            self.fitted = depth
            self.at, self.spill = self.at[:, : 1 << depth], self.spill[:, : 1 << depth]
            self.deep_at = self.deep_spill = np.zeros((trees, 0, 0))
        self.depth = depth
        self.directions = self.directions[:trees, : max(depth, 1)]
        self.at, self.spill = self.at[:trees], self.spill[:trees]
        self.deep_at, self.deep_spill = (x[:trees, : depth - self.fitted] for x in (self.deep_at, self.deep_spill))
        return self


def probes(sample: np.ndarray, labels: np.ndarray, threshold: float, seed: int = 23) -> list[tuple[np.ndarray, np.ndarray]]:
    """Kinds of pairs at the threshold: from all vectors apart in any direction, and for each large label of the sample
    from its vectors, in any direction and in that of another of its vectors."""
    rng = np.random.default_rng(seed)
    out = []

    def pairs(of: np.ndarray, toward: np.ndarray) -> None:
        w = toward - (toward * of).sum(axis=1, keepdims=True) * of
        size = np.linalg.norm(w, axis=1)
        of, w, size = of[size > 1e-9], w[size > 1e-9], size[size > 1e-9]
        if len(of):
            out.append((of, threshold * of + math.sqrt(max(0.0, 1 - threshold**2)) * w / size[:, None]))

    names, counts = np.unique(labels, return_counts=True)
    large = [sample[labels == n] for n in names[np.argsort(-counts)][:16] if (labels == n).sum() >= 20]
    for i, group in enumerate([sample, *large]):
        of = group[rng.integers(0, len(group), PROBES)]
        pairs(of, rng.standard_normal(of.shape))
        if i:
            pairs(of, group[rng.integers(0, len(group), PROBES)])
    return out


def forest(sample: np.ndarray, labels: np.ndarray, depth: int, largest: int, threshold: float, trees: int = TREES) -> Forest:
    """The cheapest forest up to a depth in which made pairs at the threshold meet (see RECALL); `largest` is the largest label's size.

    Where even MOST_TREES miss some at LEVELS levels, trees have the most levels at which none is missed: as many trees at one
    level miss none in practice.
    """
    if not depth or not len(sample):
        return Forest(sample[:0], 0, 1)
    out = Forest(sample, depth, max(trees, MOST_TREES))
    kinds = [np.logical_or.accumulate(out.together(a, b), axis=1).mean(axis=2) for a, b in probes(sample, labels, threshold)]
    met = np.min(kinds, axis=0)  # by level, and by number of trees
    twice = 1 + 2 * SPILL / math.sqrt(2 * math.pi)  # nodes below a node that a vector goes to, about
    fits: list[tuple[float, int, int]] = []
    for level in range(1, depth + 1):
        enough = np.flatnonzero(met[level] >= RECALL)
        if len(enough):
            n, leaf = max(trees, int(enough[0]) + 1), largest * (twice / 2) ** level
            fits.append((n * twice**level * (ROW_COST * max(1.0, leaf / BLOCK) + leaf), level, n))
    # the cheapest of those with levels enough, or else the deepest
    best = min((x for x in fits if x[1] >= min(LEVELS, depth)), default=max(fits, key=lambda x: x[1], default=(0, 1, len(met[1]))))
    return out.cut(*best[1:])


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; none is zero, and none is so large or small that its square isn't a number."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.linalg.norm(scaled, axis=1, keepdims=True)


def _units(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = flat.flatten()
    return unit(flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat) // dims, dims))


def _met_before(leaves: list[np.ndarray], code: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the pairs of rows (a, b) share a leaf of a smaller code."""
    out = np.zeros(len(a), bool)
    flat = np.concatenate(leaves)
    owner = np.repeat(np.arange(len(leaves)), [len(x) for x in leaves])
    for t in range(code // STRIDE + 1):
        mine = (flat // STRIDE == t) & (flat < code)
        if not mine.any():
            continue
        rows, codes = owner[mine], flat[mine]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        table = np.full((len(leaves), place.max() + 1), -1, np.int64)
        table[rows, place] = codes
        left = ~out
        for i in range(table.shape[1]):
            for j in range(table.shape[1]):
                x = table[a[left], i]
                out[np.flatnonzero(left)] |= (x == table[b[left], j]) & (x >= 0)
    return out


def compare(threshold: float):
    """Links within a leaf's block, or across two: each vector's number of first links, and an edge to its part's first vector.

    Strips of rows are held against all others, so memory is bounded by a block's rows times a strip's.
    """
    schema = pa.schema([("cid", pa.int64()), ("links", pa.int64()), ("to", pa.int64())])

    def run(key: tuple, table: pa.Table) -> pa.Table:
        if table.num_rows < 2:
            return schema.empty_table()
        dims, code, one, two = (key[i].as_py() for i in (1, 2, 3, 4))
        u = _units(table["embedding"], dims)
        cid, times = table["cid"].to_numpy(), table["times"].to_numpy()
        second = (table["block"].to_numpy() == two) & (one != two)

        def linked(first: int) -> np.ndarray:
            out = u[first : first + STRIP] @ u.T >= threshold
            out[np.arange(len(out)), first + np.arange(len(out))] = False
            if one != two:
                out &= second[first : first + STRIP, None] != second[None, :]
            return out

        links, label, touched = np.zeros(len(u), np.int64), np.arange(len(u)), np.zeros(len(u), bool)
        for first in range(0, len(u), STRIP):
            a, b = np.nonzero(linked(first))
            if not len(a):
                continue
            touched[a + first] = touched[b] = True
            # a part's first vector: each row takes the least of its neighbours' so far
            np.minimum.at(label, a + first, label[b])
            np.minimum.at(label, b, label[a + first])
            if code > 1:  # there are other leaves
                some, at = np.unique(np.concatenate([a + first, b]), return_inverse=True)
                met = _met_before([np.asarray(x) for x in table["leaves"].take(some).to_pylist()], code, at[: len(a)], at[len(a) :])
                a, b = a[~met], b[~met]
            links += np.bincount(a + first, weights=times[b], minlength=len(u)).astype(np.int64)
        while True:  # until no link joins two labels
            before = label.copy()
            label = label[label]
            for first in range(0, len(u), STRIP):
                if touched[first : first + STRIP].any():
                    a, b = np.nonzero(linked(first))
                    np.minimum.at(label, label[a + first], label[b])
                    np.minimum.at(label, a + first, label[b])
            if (label == before).all():
                break
        i = np.flatnonzero(touched)
        return pa.table([pa.array(cid[i]), pa.array(links[i]), pa.array(cid[label[i]])], schema=schema)

    return run


def usable(vectors: DataFrame) -> Column:
    """Whether a row can link: it has a label, and a vector with no null or non-finite component whose length isn't zero."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col("label").isNotNull() & F.coalesce(finite & F.exists("embedding", lambda x: x != 0), F.lit(False))


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, trees: int = TREES) -> DataFrame:
    """One row for each row of vectors: vec_id, n_links, component_id, kept.

    Vectors link at a cosine of `threshold` or more if their labels are equal; other rows (see usable()) have no links
    and are their own component, as are vectors of another dimension.  Repeated rows are vectors each: they link, and
    all rows with the smallest vec_id of a component are kept.  A null vec_id is never a component's id unless there is
    no other.  Other columns are ignored; an empty table gives an empty result.
    """
    # equal vectors have equal hashes, of 128 bits, which stand for them in all joins
    k1, k2 = (F.when(usable(vectors), F.xxhash64(F.lit(seed), "embedding")).alias(f"k{seed}") for seed in (1, 2))
    own = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.size("embedding").alias("dims"), k1, k2, "embedding")
    good = own.filter("k1 IS NOT NULL")
    classes = good.groupBy("label", "dims", "k1", "k2").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("times"))
    classes = written(classes.select(F.monotonically_increasing_id().alias("cid"), "*"), "classes")
    total = classes.count()
    sizes = classes.groupBy("label", "dims").count().groupBy("dims").agg(F.max("count").alias("largest"), F.sum("count").alias("all")).filter(F.col("largest") > LEAF)
    forests: dict[int, Forest] = {}
    for d, largest, every in sizes.collect():  # a row for each length of vectors of which a label has many
        draw = F.pmod(F.xxhash64("k1", F.lit("forest")), F.lit(1_000_000_000)) / 1e9
        rows = good.filter((F.col("dims") == d) & (draw < SAMPLE / every)).dropDuplicates(["label", "k1", "k2"]).select("label", "embedding").toArrow()
        if rows.num_rows:
            forests[d] = forest(_units(rows["embedding"], d), np.array(rows["label"].to_pylist(), object).astype(str), math.ceil(math.log2(largest / LEAF)), largest, threshold, trees)
    sent = vectors.sparkSession.sparkContext.broadcast(forests)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves: list = [np.ones(1, np.int64)] * batch.num_rows
            of = batch.column("dims").to_numpy()
            for d, known in sent.value.items():
                rows = np.flatnonzero(of == d)
                if len(rows) and known.depth:
                    at, codes = known.leaves(_units(batch.column("embedding").take(pa.array(rows)), d))
                    order = np.lexsort((codes, at))
                    for i, x in zip(rows, np.split(codes[order], np.cumsum(np.bincount(at, minlength=len(rows)))[:-1]), strict=True):
                        leaves[i] = x
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves, pa.list_(pa.int64()))], [*batch.schema.names, "leaves"])

    # one row of each class brings its vector; where the classes are few no vector is shuffled for it
    keys = classes.select("cid", "times", *[F.col(c).alias(f"{c}_c") for c in ("label", "k1", "k2", "least")])
    same = (F.col("label") == F.col("label_c")) & (F.col("k1") == F.col("k1_c")) & (F.col("k2") == F.col("k2_c")) & F.col("vec_id").eqNullSafe(F.col("least_c"))
    found = good.join(hinted(keys, total), same).select("cid", "times", "label", "dims", "embedding")
    rows = written(found.mapInArrow(lean(place), f"cid long, times long, label string, dims int, embedding {found.schema['embedding'].dataType.simpleString()}, leaves array<long>"), "placed")
    if rows.count() > total:  # rows that repeat a vec_id and its vector
        rows = written(rows.dropDuplicates(["cid"]), "placed")
    block = F.least(F.lit(BLOCK), F.greatest(F.lit(2), F.floor(F.lit(BLOCK_VALUES) / F.col("dims"))))
    sizes = rows.select("label", "dims", F.explode("leaves").alias("code")).groupBy("label", "dims", "code").count()
    large = written(sizes.filter(F.col("count") > block).select("label", "dims", "code", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "large")
    rows = rows.withColumn("code", F.explode("leaves")).join(hinted(large, large.count()), ["label", "dims", "code"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("cid", F.lit("block")), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    rows = rows.withColumn("one", F.least("block", "other")).withColumn("two", F.greatest("block", "other")).drop("blocks", "other")
    found = rows.groupBy("label", "dims", "code", "one", "two").applyInArrow(compare(threshold), "cid long, links long, to long")
    found = written(found.groupBy("cid", "to").agg(F.sum("links").alias("links")), "links")
    parts = components(found.select(F.col("cid").alias("a"), F.col("to").alias("b")))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.join(links, "cid", "left").join(parts.withColumnRenamed("node", "cid"), "cid", "left")
    known = written(known.select("label", "k1", "k2", "least", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links"), "root"), "known")
    least = known.filter("root IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id"))
    least = written(least, "least")
    by_class = known.join(hinted(least, least.count()), "root", "left").select("label", "k1", "k2", "n_links", F.coalesce("component_id", "least").alias("component_id"))
    # rows meet their class by its hashes; a class is one row, so only a row's own partition can be large
    out = own.drop("embedding", "dims").join(hinted(by_class, total), ["label", "k1", "k2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, component.isNull()).alias("kept"))
