"""Near-duplicate embeddings by cover-tree dual traversal: all pairs of one label with cosine >= 0.93.

On unit vectors a cosine of at least c is a Euclidean distance of at most sqrt(2 - 2 c). A cover tree
has nested levels of centres whose radii halve; a node covers its members within its covering radius, so
a pair of nodes is pruned if their centres lie farther apart than both radii and the threshold, and all
pairs below it are links if even the farthest members must be near enough. What remains goes down to the
single vectors, whose cosine decides.

1. Equal vectors of a label become one class with a multiplicity (partial aggregates, no pairs).
2. The upper tree comes from a bounded sample (``SAMPLE`` vectors): centres added level by level with
   halving separation. A label uses the first centres of that nested list, one per ``BLOCK`` vectors, so
   each class goes to a nearby centre's block; a larger block is split by hash. The sample decides the
   balance, never the result.
3. Block pairs of a label are joined unless the blocks' covering radii rule out a link. Every block pair
   is one bounded group: it builds both blocks' trees and traverses them. A group returns one row per
   vector with a link: the number of links, and one member of its linked set, not the pairs.

Defined results: null label, null vector, empty or zero vector, null or non-finite component: no links,
own component, kept; vectors of different lengths link with nothing; equal vectors (of equal or
different ids) link with each other; a null vec_id gives a row with null component; other columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, materialize, table

COSINE = 0.93
SAMPLE = 4096
BLOCK = 1024
MOST_CENTRES = 256
DENSE = 32             # from one pair in so many on, all are multiplied at once
_NEAR = 1e-9           # cosines so near the threshold are computed again without rounding of sums


def valid_vectors(table_: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v) of the rows that may have links; v as doubles."""
    v = table_[vector_col].cast("array<double>")
    rows = table_.select(table_[id_col].cast("long").alias("vec_id"), table_[label_col].alias("label"), v.alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & ~bad
                      & F.exists("v", lambda x: x != 0))


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, float) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def upper_centres(sample: np.ndarray, most: int = MOST_CENTRES) -> np.ndarray:
    """Centres of the upper tree, coarse levels first: separation 2, 1, 1/2, ... until there are ``most``."""
    centres = [0]
    nearest = np.sqrt(np.maximum(0, 2 - 2 * sample @ sample[0]))
    radius = 1.0
    while len(centres) < min(most, len(sample)) and nearest.max() > 1e-6:
        far = int(nearest.argmax())
        if nearest[far] <= radius:
            radius /= 2
            continue
        centres.append(far)
        nearest = np.minimum(nearest, np.sqrt(np.maximum(0, 2 - 2 * sample @ sample[far])))
    return sample[centres]


class Tree:
    """The lower tree of one block: per level the nodes' centres, covering radii and parents.

    Every level partitions the block's vectors; a node's members are a stretch of ``order``.
    """

    def __init__(self, x: np.ndarray, least: float):
        n = len(x)
        far = np.sqrt(np.maximum(0.0, 2 - 2 * (x @ x.T)))
        node = np.zeros(n, np.int64)
        radius, levels = 1.0, [node]
        while radius > least:
            below = self._split(far, node, radius)
            if len(np.unique(below)) > len(np.unique(node)):
                levels.append(below)
            node, radius = below, radius / 2
        if len(np.unique(node)) < n:
            levels.append(np.arange(n))                 # single vectors
        self.order = np.lexsort(levels[::-1])
        self.levels = []
        for node in levels:
            sorted_nodes = node[self.order]
            first = np.flatnonzero(np.concatenate([[True], sorted_nodes[1:] != sorted_nodes[:-1]]))
            last = np.append(first[1:], n)
            centre = sorted_nodes[first]                 # a node is named by its centre vector
            reach = np.maximum.reduceat(far[self.order, sorted_nodes], first)
            self.levels.append((centre, reach, first, last))

    def at(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The level, or the last one where the tree is not so deep."""
        return self.levels[min(level, len(self.levels) - 1)]

    @staticmethod
    def _split(far: np.ndarray, parent: np.ndarray, radius: float) -> np.ndarray:
        """Nodes one level down: within each parent, greedy centres farther apart than ``radius``."""
        node = np.full(len(parent), -1, np.int64)
        for p in np.unique(parent):
            mine = np.flatnonzero(parent == p)
            left = mine
            centre = p
            while len(left):
                near = far[centre, left] <= radius
                near |= left == centre
                node[left[near]] = centre
                left = left[~near]
                if len(left):
                    centre = left[0]
        return node


def _exact(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a)) / math.sqrt(math.fsum(b * b))


def dual_traversal(x: np.ndarray, y: np.ndarray | None, raw_x, raw_y, cosine: float) -> tuple[list, list]:
    """Links between the vectors of two blocks (``y`` None: within one block).

    Returns single links as two index arrays, and groups (members of x, members of y) all of whose pairs
    are links; within one block a group's two sides may be the same.
    """
    reach = math.sqrt(2 - 2 * cosine)
    same = y is None
    tx = Tree(x, reach / 2)
    ty = tx if same else Tree(y, reach / 2)
    y = x if same else y
    groups = []
    live = np.ones((1, 1), bool)      # node pairs of a level that are not decided yet
    depth = max(len(tx.levels), len(ty.levels))
    for level in range(depth):
        cx, rx, fx, lx = tx.at(level)
        cy, ry, fy, ly = ty.at(level)
        dots = _products(x[cx], y[cy], live)
        if level == depth - 1:
            hit = live & (dots >= cosine)
            for i, j in zip(*np.nonzero(live & (np.abs(dots - cosine) < _NEAR)), strict=True):
                hit[i, j] = _exact(np.asarray(raw_x[cx[i]], float), np.asarray(raw_y[cy[j]], float)) >= cosine
            i, j = np.nonzero(np.triu(hit, 1) if same else hit)
            return [cx[i], cy[j]], groups
        apart = np.sqrt(np.maximum(0.0, 2 - 2 * dots))
        both = rx[:, None] + ry[None, :]
        whole = live & (apart + both <= reach - _NEAR)
        if same:
            single = np.flatnonzero(lx - fx == 1)
            whole[single, single] = False
        for i, j in zip(*np.nonzero(whole), strict=True):
            groups.append((tx.order[fx[i]:lx[i]], ty.order[fy[j]:ly[j]]))
        go = live & ~whole & (apart <= both + reach + _NEAR)
        # children: the next level's nodes lie within their parents' stretches
        px = np.searchsorted(fx, tx.at(level + 1)[2], "right") - 1
        py = np.searchsorted(fy, ty.at(level + 1)[2], "right") - 1
        live = go[px][:, py]
        if same:
            live = np.triu(live)
    raise AssertionError("a tree has a last level")


def _products(x: np.ndarray, y: np.ndarray, live: np.ndarray) -> np.ndarray:
    """Inner products of the live pairs of x and y (others -2): one matrix product unless few are live."""
    a, b = np.nonzero(live)
    if len(a) * DENSE >= live.size:
        return np.where(live, x @ y.T, -2.0)
    dots = np.full(live.shape, -2.0)
    for s in range(0, len(a), 1 << 16):
        i, j = a[s:s + (1 << 16)], b[s:s + (1 << 16)]
        dots[i, j] = np.einsum("ij,ij->i", x[i], y[j])
    return dots


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component under links a-b."""
    low = np.arange(n)
    while True:
        before = low.copy()
        m = np.minimum(low[a], low[b])
        np.minimum.at(low, a, m)
        np.minimum.at(low, b, m)
        low = low[low]
        if (low == before).all():
            return low


def block_links(ids, many, raw, side, cosine: float) -> pd.DataFrame:
    """Per linked class of one block pair: links added, and a class it is connected with."""
    both = (side == 1).any() and (side == 0).any()
    here = np.flatnonzero(side == (0 if both or (side == 0).any() else 1))
    there = np.flatnonzero(side == 1) if both else here
    x = _unit([raw[i] for i in here])
    y = _unit([raw[i] for i in there]) if both else None
    (p, q), groups = dual_traversal(x, y, [raw[i] for i in here], [raw[i] for i in there], cosine)
    n = len(ids)
    added = np.zeros(n, np.int64)
    p, q = here[p], there[q]
    np.add.at(added, p, many[q])
    np.add.at(added, q, many[p])
    edges_a, edges_b = [p], [q]
    for u, v in groups:
        u, v = here[u], there[v]
        if not both and len(u) == len(v) and (u == v).all():
            added[u] += many[u].sum() - many[u]
            edges_a.append(u[1:])
            edges_b.append(np.full(len(u) - 1, u[0]))
        else:
            added[u] += many[v].sum()
            added[v] += many[u].sum()
            edges_a += [u, v]
            edges_b += [np.full(len(u), v[0]), np.full(len(v), u[0])]
    a, b = np.concatenate(edges_a), np.concatenate(edges_b)
    root = _roots(n, a, b)
    hit = np.flatnonzero(added)
    return pd.DataFrame({"id": ids[hit], "other": ids[root[hit]], "links": added[hit]})


def near_vectors(table_: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding",
                 label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per vector."""
    spark = table_.sparkSession
    rows = valid_vectors(table_, id_col, vector_col, label_col)
    classes = rows.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("many"))
    classes = materialize(classes.withColumn("dim", F.size("v")), "vectors")

    # the upper tree, one per vector length, from a sample of bounded size
    total = classes.groupBy("dim").count().collect()
    reach = math.sqrt(2 - 2 * cosine)
    centres: dict[int, np.ndarray] = {}
    for dim, n in total:
        part = classes.where(F.col("dim") == dim)
        part = part.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, SAMPLE / n) * (1 << 30)))
        got = part.select("id", "v").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).collect()
        centres[dim] = upper_centres(_unit([r.v for r in got])) if got else _unit([[1.0] * dim])
    shared = spark.sparkContext.broadcast(centres)

    sizes = classes.groupBy("label", "dim").agg(F.count("*").alias("size")).withColumn(
        "wanted", F.ceil(F.col("size") / F.lit(BLOCK)).cast("int"))
    placed = classes.join(materialize(sizes, "sizes").drop("size"), ["label", "dim"])

    def assign(batches):
        for batch in batches:
            centre, apart = np.zeros(len(batch), np.int32), np.zeros(len(batch))
            for dim in batch["dim"].unique():
                at = np.flatnonzero((batch["dim"] == dim).to_numpy())
                own = shared.value[dim]
                x = _unit(batch["v"].iloc[at])
                allowed = np.arange(len(own))[None, :] < batch["wanted"].to_numpy()[at][:, None]
                dots = np.where(allowed, x @ own.T, -2.0)
                centre[at] = dots.argmax(axis=1)
                apart[at] = np.sqrt(np.maximum(0.0, 2 - 2 * dots.max(axis=1)))
            yield batch.drop(columns="wanted").assign(centre=centre, apart=apart)

    label_type = classes.schema["label"].dataType.simpleString()
    fields = f"label {label_type}, dim int, v array<double>, id long, many long, centre int, apart double"
    placed = placed.select("label", "dim", "v", "id", "many", "wanted").mapInPandas(assign, fields)
    placed = materialize(placed, "placed")

    # blocks, and the block pairs that the covering radii leave
    nodes = placed.groupBy("label", "dim", "centre").agg(F.max("apart").alias("radius"), F.count("*").alias("size"))
    nodes = materialize(nodes.withColumn("splits", F.ceil(F.col("size") / F.lit(2 * BLOCK)).cast("int")), "nodes")
    far = [(int(d), i, j, float(math.sqrt(max(0.0, 2 - 2 * float(c[i] @ c[j])))))
           for d, c in centres.items() for i in range(len(c)) for j in range(i, len(c))]
    far = spark.createDataFrame(pd.DataFrame(far, columns=["dim", "centre", "centre2", "far"]),
                                "dim int, centre int, centre2 int, far double") if far else None
    if far is None:
        links = spark.createDataFrame([], "id long, other long, links long")
    else:
        second = nodes.select("label", "dim", F.col("centre").alias("centre2"), F.col("radius").alias("radius2"), F.col("splits").alias("splits2"))
        meet = nodes.join(second, ["label", "dim"]).where("centre <= centre2").join(far, ["dim", "centre", "centre2"])
        meet = meet.where(F.col("far") <= F.col("radius") + F.col("radius2") + F.lit(reach + 1e-9))
        meet = meet.withColumn("split", F.explode(F.sequence(F.lit(0), F.col("splits") - 1))).withColumn(
            "split2", F.explode(F.sequence(F.lit(0), F.col("splits2") - 1))).where("centre < centre2 OR split <= split2")
        meet = materialize(meet.select("label", "dim", "centre", "split", "centre2", "split2")
                           .withColumn("pair", F.xxhash64("label", "dim", "centre", "split", "centre2", "split2")), "block-pairs")
        blocks = placed.join(nodes.select("label", "dim", "centre", "splits"), ["label", "dim", "centre"]).withColumn(
            "split", F.pmod(F.xxhash64("id"), F.col("splits").cast("long")).cast("int")).select(
            "label", "dim", "centre", "split", "id", "many", "v")
        left = blocks.join(meet, ["label", "dim", "centre", "split"]).withColumn("side", F.lit(0))
        right = blocks.join(meet.where("centre <> centre2 OR split <> split2").select(
            "label", "dim", F.col("centre").alias("first"), F.col("split").alias("first_split"), F.col("centre2").alias("centre"),
            F.col("split2").alias("split"), "pair"), ["label", "dim", "centre", "split"]).withColumn("side", F.lit(1))
        key = ["label", "dim", "pair"]
        parts = left.select(*key, "side", "id", "many", "v").unionByName(right.select(*key, "side", "id", "many", "v"))

        def traverse(group: pd.DataFrame) -> pd.DataFrame:
            return block_links(group["id"].to_numpy(), group["many"].to_numpy(), list(group["v"]), group["side"].to_numpy(), cosine)

        links = materialize(parts.groupBy(*key).applyInPandas(traverse, "id long, other long, links long"), "block-links")

    comp = components(links.select(F.col("id").alias("a"), F.col("other").alias("b")))
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    per_class = classes.select("label", "v", "id", "many").join(counts, "id", "left").join(comp, "id", "left").select(
        "label", "v", (F.col("many") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
        F.coalesce("component", "id").alias("component_id"))
    per_class = materialize(per_class, "vector-classes")
    found = rows.join(per_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    every = table_.select(table_[id_col].cast("long").alias("vec_id"), table_[label_col].alias("label"),
                          table_[vector_col].cast("array<double>").alias("v"))
    bad = F.coalesce(F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(True))
    none = every.where(F.col("vec_id").isNull() | F.col("label").isNull() | bad
                       | ~F.coalesce(F.exists("v", lambda x: F.coalesce(x, F.lit(0.0)) != 0), F.lit(False)))
    alone = none.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return found.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH RECURSIVE v AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
    WHERE label IS NOT NULL AND len(list_filter(embedding, x -> x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, x -> x <> 0)) > 0
), links AS (
    SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.label = q.label AND p.vec_id <> q.vec_id AND len(p.e) = len(q.e)
    WHERE list_cosine_similarity(p.e, q.e) >= 0.93
), reach AS (
    SELECT vec_id AS a, vec_id AS b FROM embeddings
    UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
), comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT t.vec_id, coalesce(n.n, 0) AS n_links, comp.component_id, t.vec_id = comp.component_id AS kept
FROM embeddings t LEFT JOIN n ON n.a = t.vec_id JOIN comp ON comp.a = t.vec_id
"""
