"""Embedding near-dedup by dual traversal of cover trees.

Equal vectors are one row. A label with many vectors is split by the tree's upper level, centres drawn from the label: a vector
lives in the cell of the nearest one, and visits another cell only where it is no further than the threshold from the
plane midway between the two centres, which a link across would have to cross. What remains are pairs of bounded parts, each its own
group: a group builds a tree over each part, nested levels whose radii halve, and walks both at once. A pair of nodes
is pruned when their centres are further apart than both radii and the threshold together, and counted whole when
nothing in it can be further apart than the threshold; only what is between is compared vector by vector.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from biowave.llm.common import materialize
from biowave.llm.graph import connected_components, forest

PART = 1024  # vectors of a part, about; a group holds two
CELLS = 64  # centres of a label at most
SPLIT_LABELS = 64  # labels that are split into cells at most; parts bound the others too
LEAF = 24
SAFE = 1e-7  # above the rounding errors of distances between unit vectors in double precision


@dataclass
class Node:
    rows: np.ndarray
    centre: np.ndarray
    radius: float
    children: list[Node]
    centres: np.ndarray | None = None
    radii: np.ndarray | None = None


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def cover_tree(x: np.ndarray, rows: np.ndarray, centre: np.ndarray | None = None, radius: float = 2.0) -> Node:
    """A node over rows of x (unit vectors). Each level covers its rows with balls of at most half the radius."""
    centre = x[rows[0]] if centre is None else centre
    away = _apart(x[rows], centre[None])[:, 0]
    node = Node(rows, centre, float(away.max()), [])
    if len(rows) <= LEAF or node.radius < SAFE:
        return node
    half = min(radius, node.radius) / 2
    nearest, owner, picked = away, np.zeros(len(rows), np.int64), [centre]
    while nearest.max() > half:
        picked.append(x[rows[int(nearest.argmax())]])
        d = _apart(x[rows], picked[-1][None])[:, 0]
        closer = d < nearest
        nearest, owner = np.where(closer, d, nearest), np.where(closer, len(picked) - 1, owner)
    order = np.argsort(owner, kind="stable")
    groups = np.split(rows[order], np.flatnonzero(np.diff(owner[order])) + 1)
    node.children = [cover_tree(x, g, None if len(groups) > 1 else x[g[-1]], half) if len(g) > 1 else Node(g, x[g[0]], 0.0, []) for g in groups]
    node.centres = np.stack([c.centre for c in node.children])
    node.radii = np.array([c.radius for c in node.children])
    return node


class Walk:
    """Links between the rows of two trees (or within one), as counts and as a spanning forest."""

    def __init__(self, raw: np.ndarray, unit: np.ndarray, weight: np.ndarray, cosine: float):
        self.raw, self.unit, self.weight, self.cosine = raw, unit, weight, cosine
        self.norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        self.reach = math.sqrt(2 - 2 * cosine)
        self.links = np.zeros(len(raw), np.int64)
        self.parent, self.used = np.arange(len(raw)), []

    def found(self, left: np.ndarray, right: np.ndarray) -> None:
        np.add.at(self.links, left, self.weight[right])
        np.add.at(self.links, right, self.weight[left])
        if len(left):
            self.used += forest(self.parent, left, right)

    def compare(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        cos = (self.raw[a] @ self.raw[b].T) / (self.norm[a][:, None] * self.norm[b][None])
        i, j = np.nonzero(np.triu(cos >= self.cosine, 1) if same else cos >= self.cosine)
        self.found(a[i], b[j])

    def pair(self, a: Node, b: Node) -> None:
        same = a is b
        d = 0.0 if same else float(_apart(a.centre[None], b.centre[None])[0, 0])
        if d > a.radius + b.radius + self.reach + SAFE:
            return
        if not same and d + a.radius + b.radius < self.reach - SAFE:
            self.links[a.rows] += self.weight[b.rows].sum()
            self.links[b.rows] += self.weight[a.rows].sum()
            left = np.concatenate([np.full(len(b.rows), a.rows[0]), a.rows])
            self.used += forest(self.parent, left, np.concatenate([b.rows, np.full(len(a.rows), b.rows[0])]))
            return
        if not a.children and not b.children:
            self.compare(a.rows, b.rows, same)
            return
        # the children of both where both have some, else of the one that has
        left, right = (a.children or [a]), (b.children or [b])
        lc = a.centres if a.children else a.centre[None]
        rc = b.centres if b.children else b.centre[None]
        lr = a.radii if a.children else np.array([a.radius])
        rr = b.radii if b.children else np.array([b.radius])
        near = _apart(lc, rc) <= lr[:, None] + rr[None] + self.reach + SAFE
        if same:
            near = np.triu(near)
        single = (lr[:, None] == 0) & (rr[None] == 0) & near
        if same:
            np.fill_diagonal(single, False)
        one_l, one_r = np.array([len(c.rows) == 1 for c in left]), np.array([len(c.rows) == 1 for c in right])
        single &= one_l[:, None] & one_r[None]
        i, j = np.nonzero(single)
        if len(i):  # vectors of their own: all at once
            p, q = np.array([left[k].rows[0] for k in i]), np.array([right[k].rows[0] for k in j])
            hit = np.einsum("ij,ij->i", self.raw[p], self.raw[q]) / (self.norm[p] * self.norm[q]) >= self.cosine
            self.found(p[hit], q[hit])
        for i, j in zip(*np.nonzero(near & ~single), strict=True):
            if not (same and i == j and len(left[i].rows) == 1):
                self.pair(left[i], right[j])


def _walk(cosine: float):
    def of(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, unit in group.groupby("unit", sort=True):
            unit = unit.sort_values(["side", "rep"], kind="stable")
            raw = _scaled(np.stack(unit["embedding"].to_numpy()).astype(np.float64))
            x = raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]
            side, rep = unit["side"].to_numpy(), unit["rep"].to_numpy(np.int64)
            walk = Walk(raw, x, unit["copies"].to_numpy(np.int64), cosine)
            parts = [np.flatnonzero(side == k) for k in (0, 1)]
            trees = [cover_tree(x, p) for p in parts if len(p)]
            if len(parts[1]) == 0 and not unit["cross"].iloc[0]:
                walk.pair(trees[0], trees[0])
            elif len(trees) == 2:
                walk.pair(*trees)
            some = walk.links > 0
            out.append(pd.DataFrame({"src": rep[some], "links": walk.links[some]}))
            a, b = np.array(walk.used, np.int64).reshape(-1, 2).T
            out.append(pd.DataFrame({"src": rep[a], "dst": rep[b]}))
        both = pd.concat(out) if out else pd.DataFrame({"src": []})
        return both.reindex(columns=["src", "dst", "links"]).astype({"src": "Int64", "dst": "Int64", "links": "Int64"})

    return of


def _scaled(raw: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares neither overflow nor vanish; cosines stay as they are."""
    return np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])


def _units(raw: np.ndarray) -> np.ndarray:
    raw = _scaled(raw)
    return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]


def _cells(distinct: DataFrame, part: int, cosine: float) -> DataFrame:
    """distinct with the cell of each vector and the cells with higher numbers that it visits.

    space is a label and dimension. The largest SPLIT_LABELS spaces with over two parts get up to CELLS centres each; the
    others are one cell.
    """
    sizes = distinct.groupBy("space").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * part)
    large = {r["space"]: r["n"] for r in sizes.orderBy(F.desc("n"), "space").limit(SPLIT_LABELS).collect()}
    if not large:
        return distinct.withColumn("cell", F.lit(0)).withColumn("visits", F.array().cast("array<int>"))
    rate = F.lit(0.0)
    for s, n in large.items():
        rate = F.when(F.col("space") == s, F.lit(min(CELLS, math.ceil(n / part)) / n)).otherwise(rate)
    draw = F.shiftrightunsigned(F.xxhash64("embedding", F.lit("centre")), 11) / F.lit(float(1 << 53))
    drawn: dict[str, list] = {}
    for r in distinct.where(draw < rate).select("space", "embedding").orderBy("space", "embedding").collect():
        drawn.setdefault(r["space"], []).append(r["embedding"])
    # at most SPLIT_LABELS * CELLS vectors, about
    shared = distinct.sparkSession.sparkContext.broadcast({s: _units(np.array(v, float)) for s, v in drawn.items()})
    reach = math.sqrt(2 - 2 * cosine) + SAFE

    def assign(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in parts:
            cell, visits = np.zeros(len(rows), np.int32), [np.zeros(0, np.int32)] * len(rows)
            for s, at in rows.groupby("space").indices.items():
                centres = shared.value.get(s)
                if centres is None or len(centres) < 2:
                    continue
                squares = _apart(_units(np.stack(rows["embedding"].to_numpy()[at]).astype(float)), centres) ** 2
                cell[at] = own = squares.argmin(axis=1)
                across = _apart(centres[own], centres)
                near = squares - squares[np.arange(len(at)), own][:, None] <= 2 * reach * across + SAFE
                near &= np.arange(len(centres))[None] > own[:, None]
                for k, to in zip(at.tolist(), near, strict=True):
                    visits[k] = np.flatnonzero(to).astype(np.int32)
            yield rows.assign(cell=cell, visits=visits)

    kind = dict(distinct.dtypes)["embedding"]
    return materialize(distinct.mapInPandas(assign, f"space string, embedding {kind}, rep bigint, copies bigint, least bigint, cell int, visits array<int>"))


def near_vectors(
    vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", part: int = PART,
) -> DataFrame:
    """One row per vector: id, n_links, component_id, kept.

    Vectors with equal labels and dimensions link when their cosine in double precision is at least `cosine`. A vector links
    with nothing when it or its label is null, when it is empty or zero or holds a null or a non-finite number, or when its
    id is null: then n_links is 0, component_id its id, and it is kept. Rows that repeat an id or a vector are vectors each,
    copies count as links, and an id's vectors may be in several components. Other columns are ignored; an empty input gives an empty result.
    """
    kind = "array<float>" if dict(vectors.dtypes)[vector_col] == "array<float>" else "array<double>"
    rows = vectors.select(
        F.col(id_col).cast("bigint").alias("_id"), F.col(label_col).cast("string").alias("_label"), F.col(vector_col).cast(kind).alias("embedding")
    )
    big = F.lit(float("inf"))
    sound = (
        F.col("_id").isNotNull() & F.col("_label").isNotNull() & F.col("embedding").isNotNull()
        & F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < big))
        & F.exists("embedding", lambda v: v != 0)
    )
    rows = rows.withColumn("space", F.when(F.coalesce(sound, F.lit(False)), F.concat_ws(":", F.size("embedding").cast("string"), "_label")))
    # an id may stand for several vectors, so links are between numbers of distinct vectors
    distinct = materialize(
        rows.where("space IS NOT NULL").groupBy("space", "embedding").agg(F.min("_id").alias("least"), F.count(F.lit(1)).alias("copies"))
        .select("space", "embedding", F.monotonically_increasing_id().alias("rep"), "copies", "least")
    )
    placed = _cells(distinct, part, cosine)
    visiting = placed.select("space", F.explode("visits").alias("cell"), "rep", "copies", "embedding")
    living = placed.groupBy("space", "cell").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts"))
    guests = visiting.groupBy("space", "cell").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("guest_parts"))
    sizes = materialize(living.join(guests, ["space", "cell"], "left").na.fill(0, ["guest_parts"]))

    def mine(parts: str) -> Column:
        return F.pmod(F.xxhash64("rep"), F.col(parts)).cast("int")

    def unit(guest: bool, a: Column, b: Column, side: Column, cross: Column) -> Column:
        return F.struct(F.xxhash64("space", "cell", F.lit(guest), a, b).alias("unit"), cross.alias("cross"), side.cast("int").alias("side"))

    # a part meets each part of its own cell and of the cell's visitors, in a group of the two
    own, none = mine("parts"), F.array().cast("array<int>")
    at_home = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda q: unit(False, F.least(own, q), F.greatest(own, q), own > q, own != q))
    guest_parts = F.when(F.col("guest_parts") > 0, F.sequence(F.lit(0), F.col("guest_parts") - 1)).otherwise(none)
    with_guests = F.transform(guest_parts, lambda q: unit(True, own, q, F.lit(0), F.lit(True)))
    as_guest = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: unit(True, p, mine("guest_parts"), F.lit(1), F.lit(True)))
    hosts = placed.join(sizes, ["space", "cell"]).select(F.explode(F.concat(at_home, with_guests)).alias("_u"), "rep", "copies", "embedding")
    visitors = visiting.join(sizes, ["space", "cell"]).select(F.explode(as_guest).alias("_u"), "rep", "copies", "embedding")
    dealt = hosts.union(visitors).select("_u.*", "rep", "copies", "embedding")
    met = materialize(dealt.groupBy("unit").applyInPandas(_walk(cosine), "src bigint, dst bigint, links bigint"))
    counts = met.where("links IS NOT NULL").groupBy(F.col("src").alias("_of")).agg(F.sum("links").alias("_links"))
    parts = connected_components(met.where("dst IS NOT NULL").select("src", "dst"))
    classes = (
        distinct.join(counts, distinct["rep"] == F.col("_of"), "left")
        .join(parts, distinct["rep"] == F.col("node"), "left")
        .select(
            F.col("space").alias("_space"), F.col("embedding").alias("_embedding"), "least",
            (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("_class"),
        )
    )
    classes = materialize(classes)
    least = materialize(classes.groupBy("_class").agg(F.min("least").alias("component_id")))
    classes = materialize(classes.drop("least").join(least, "_class").drop("_class"))
    out = rows.join(classes, (F.col("space") == F.col("_space")) & (F.col("embedding") == F.col("_embedding")), "left")
    component = F.coalesce("component_id", "_id")
    return out.select(
        F.col("_id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
        F.col("_id").eqNullSafe(component).alias("kept"),
    )
