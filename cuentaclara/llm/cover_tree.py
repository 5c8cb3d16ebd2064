"""Exact cosine neighbours by dual traversal of cover trees, within labels.

Unit vectors have cosine >= t if and only if their distance is at most sqrt(2 - 2 t). Equal vectors are one point with a
weight. The upper levels of a tree are shared: centres chosen from a bounded sample, nested in levels with halving radii, give every
point a home, the centre that a greedy descent finds. Covering radii are then measured over all points. Pairs of homes are
pruned by distance of centres - radii > threshold, and a point is sent to another home only if that home's radius can reach it.
The points of a home are cut into blocks of about ``BLOCK`` points and at most ``BLOCK_BYTES``, so a crowded home is many tasks.

Each pair of blocks is one task: it builds a cover tree of each, nested levels with halving radii down to leaves, and
traverses both at once. Node pairs that cannot hold a link are pruned, node pairs that must all link are counted without
looking at their points, and leaves are compared by one product. Bounds give way by ``SLACK``, more than distances can be
off: one near 0 is the root of a rounded 2 - 2ab. What leaves the task is one row per point: how many links
it found, and one member of its connected part. Dense groups are therefore never written out pair by pair.

Defined results: vectors that are null, empty, zero, hold null or non-finite components, or have no label link with nothing.
Vectors of different length are never equal and never link. Equal vec_ids are separate vectors; a component is named by
its smallest vec_id, nulls last.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuentaclara.llm.common import own_columns, ship, written
from cuentaclara.llm.graph import components

ship(__name__)

BLOCK = 8192
BLOCK_BYTES = 16 << 20
LEAF = 64
SLACK = 1e-6
CENTRES = 2000
PER_HOME = 8192


@dataclass
class Node:
    centre: int
    radius: float
    points: np.ndarray
    children: list[Node] = field(default_factory=list)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * (a @ b.T), 0.0))


def build(x: np.ndarray, points: np.ndarray, centre: int, reach: float, leaf: int = LEAF) -> Node:
    """A cover tree of unit vectors: children lie within ``reach`` of their centre, the next level within half of it."""
    far = distances(x[points], x[centre:centre + 1])[:, 0]
    node = Node(centre, float(far.max()), points)
    if len(points) <= leaf or node.radius <= SLACK:
        return node
    reach = min(reach, node.radius) / 2
    left, first = points, True
    while len(left):
        # The centre of a node is also the centre of one of its children (nesting).
        head = centre if first else int(left[0])
        near = distances(x[left], x[head:head + 1])[:, 0] <= reach
        near |= left == head
        own, left, first = left[near], left[~near], False
        if len(node.children) >= leaf and len(left):  # thin space: the rest is one child, bound by its own radius
            own, left = np.concatenate([own, left]), left[:0]
            node.children.append(Node(head, float(distances(x[own], x[head:head + 1]).max()), own))
            continue
        node.children.append(build(x, own, head, reach, leaf) if len(own) < len(points) else Node(head, node.radius, own))
    return node


class Links:
    """Counts and connected parts while pairs are found."""

    def __init__(self, weights: np.ndarray) -> None:
        self.weights = weights.astype("float64")
        self.count = np.zeros(len(weights))
        self.part = np.arange(len(weights))

    def root(self, i: np.ndarray) -> np.ndarray:
        while True:
            up = self.part[self.part[i]]
            if np.array_equal(up, self.part[i]):
                return self.part[i]
            self.part[i] = up

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Connect a[k] with b[k] for every k."""
        while True:
            ra, rb = self.root(a), self.root(b)
            open_ = ra != rb
            if not open_.any():
                return
            a, b = a[open_], b[open_]
            np.minimum.at(self.part, np.maximum(ra, rb)[open_], np.minimum(ra, rb)[open_])

    def all_of(self, a: np.ndarray, b: np.ndarray) -> None:
        self.count[a] += self.weights[b].sum()
        self.count[b] += self.weights[a].sum()
        self.join(np.concatenate([a, b]), np.full(len(a) + len(b), a[0]))

    def some_of(self, a: np.ndarray, b: np.ndarray, linked: np.ndarray) -> None:
        if not linked.any():
            return
        self.count[a] += linked @ self.weights[b]
        self.count[b] += self.weights[a] @ linked
        while True:  # each step takes one open pair per row, so dense blocks need few steps
            ra, rb = self.root(a), self.root(b)
            open_ = linked & (ra[:, None] != rb[None, :])
            rows = np.flatnonzero(open_.any(axis=1))
            if not len(rows):
                return
            self.join(a[rows], b[open_[rows].argmax(axis=1)])


def within(node: Node, x: np.ndarray, cosine: float, links: Links) -> None:
    """All pairs inside a node, each once."""
    limit = np.sqrt(2 - 2 * cosine)
    if 2 * node.radius <= limit - SLACK and len(node.points) > 1:
        p = node.points
        links.count[p] += links.weights[p].sum() - links.weights[p]
        links.join(p, np.full(len(p), p[0]))
    elif not node.children:
        p = node.points
        linked = np.triu(x[p] @ x[p].T >= cosine, 1)
        links.some_of(p, p, linked)
    else:
        kids = node.children
        for kid in kids:
            within(kid, x, cosine, links)
        gap = distances(x[[k.centre for k in kids]], x[[k.centre for k in kids]])
        radius = np.array([k.radius for k in kids])
        for i, j in np.argwhere(np.triu(gap - radius[:, None] - radius[None, :] <= limit + SLACK, 1)):
            between(kids[i], kids[j], x, cosine, links)


def between(a: Node, b: Node, x: np.ndarray, cosine: float, links: Links) -> None:
    """All pairs of a point of a and a point of b; the nodes share no point."""
    limit = np.sqrt(2 - 2 * cosine)
    gap = float(distances(x[a.centre:a.centre + 1], x[b.centre:b.centre + 1])[0, 0])
    if gap - a.radius - b.radius > limit + SLACK:
        return
    if gap + a.radius + b.radius <= limit - SLACK:
        links.all_of(a.points, b.points)
        return
    if not a.children and not b.children:
        links.some_of(a.points, b.points, x[a.points] @ x[b.points].T >= cosine)
        return
    if a.children and (not b.children or a.radius >= b.radius):
        split, other = a, b
    else:
        split, other = b, a
    far = distances(x[[k.centre for k in split.children]], x[other.centre:other.centre + 1])[:, 0]
    for kid, d in zip(split.children, far, strict=True):
        if d - kid.radius - other.radius <= limit + SLACK:
            between(kid, other, x, cosine, links)


def pairs_of_cell(x: np.ndarray, weights: np.ndarray, first: np.ndarray, alone: bool, cosine: float) -> Links:
    """Links between the points marked ``first`` and the others; in the cell of one block ``alone``, links among its points."""
    links = Links(weights)
    a, b = np.flatnonzero(first), np.flatnonzero(~first)
    if alone:
        within(build(x, a, int(a[0]), 2.0), x, cosine, links)
    elif len(a) and len(b):
        between(build(x, a, int(a[0]), 2.0), build(x, b, int(b[0]), 2.0), x, cosine, links)
    return links


# --- the shared upper levels ----------------------------------------------------------------


@dataclass
class Upper:
    """Centres of one label and length, in levels; ``parents[l]`` are places in level l + 1 by place in level l."""
    levels: list[np.ndarray]
    below: list[list[np.ndarray]]

    def homes(self, x: np.ndarray) -> np.ndarray:
        """Place of the home centre of each row, by greedy descent."""
        at = distances(x, self.levels[0]).argmin(axis=1)
        for level, below in zip(self.levels[1:], self.below, strict=True):
            new = np.zeros(len(x), dtype="int64")
            for place in np.unique(at):
                rows = np.flatnonzero(at == place)
                kids = below[place]
                new[rows] = kids[distances(x[rows], level[kids]).argmin(axis=1)]
            at = new
        return at


def upper_levels(sample: np.ndarray) -> Upper:
    """Nested levels over the sample, radii 1, 1/2 and 1/4: each level keeps the centres of the one above."""
    chosen, levels = np.array([0]), []
    for radius in (1.0, 0.5, 0.25):
        picked = list(chosen)
        free = distances(sample, sample[picked]).min(axis=1) > radius
        while free.any():
            new = int(np.flatnonzero(free)[0])
            picked.append(new)
            free &= distances(sample, sample[new:new + 1])[:, 0] > radius
        chosen = np.array(picked)
        levels.append(sample[chosen])
    below = []
    for up, down in zip(levels[:-1], levels[1:], strict=True):
        parent = distances(down, up).argmin(axis=1)
        below.append([np.flatnonzero(parent == p) for p in range(len(up))])
    return Upper(levels, below)


def vectors_of(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and the unit vector as bytes of doubles; null where the row links with nothing."""
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            units = []
            labels = batch.column("label").to_pylist()
            for values, label in zip(batch.column("embedding").to_pylist(), labels, strict=True):
                unit = None
                if label is not None and values and None not in values:
                    v = np.array(values, dtype="float64")
                    largest = np.abs(v).max()
                    if np.isfinite(largest) and largest > 0:  # scaled first: squares of large or small numbers leave the range
                        v /= largest
                        unit = (v / np.linalg.norm(v)).tobytes()
                units.append(unit)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("label"), pa.array(units, pa.binary())], names=["vec_id", "label", "unit"])

    rows = own_columns(embeddings, "vec_id", "label", "embedding")
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, unit binary")


def _uppers(points: DataFrame, centres: int, per_home: int) -> dict:
    """Upper levels per (label, length), from one of ``per_home`` points and at most about ``centres``, those with the smallest hash.

    More homes than that would not prune better where vectors lie far apart, and each point may be sent to every home."""
    total = points.count()
    centres = max(1, min(centres, total // per_home))
    pick = F.shiftrightunsigned(F.xxhash64("unit", F.lit(5)), 11) / F.lit(float(1 << 53))
    rows = points.where(pick < min(1.0, centres / max(total, 1))).select("label", "unit").limit(2 * centres + 20).collect()
    groups: dict = {}
    for label, unit in sorted((r["label"], bytes(r["unit"])) for r in rows):
        groups.setdefault((label, len(unit)), []).append(np.frombuffer(unit))
    return {key: upper_levels(np.stack(found)) for key, found in groups.items()}


def homes(points: DataFrame, uppers: dict) -> DataFrame:
    """node, label, width, home, distance to the home's centre, unit. Without centres of its label a point has home 0."""
    shared = points.sparkSession.sparkContext.broadcast({k: (u.levels, u.below) for k, u in uppers.items()})

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known = {k: Upper(*v) for k, v in shared.value.items()}
        for batch in batches:
            labels, units = batch.column("label").to_pylist(), [u.as_py() for u in batch.column("unit")]
            home, far = np.zeros(len(units), dtype="int64"), np.full(len(units), 2.0)
            keys: dict = {}
            for i, key in enumerate(zip(labels, map(len, units), strict=True)):
                keys.setdefault(key, []).append(i)
            for key, rows in keys.items():
                if key in known:
                    x = np.stack([np.frombuffer(units[i]) for i in rows])
                    place = known[key].homes(x)
                    home[rows] = place
                    far[rows] = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", x, known[key].levels[-1][place]), 0))
            width = pa.array([len(u) for u in units], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("label"), width, pa.array(home), pa.array(far), batch.column("weight"), batch.column("unit")],
                names=["node", "label", "width", "home", "far", "weight", "unit"])

    kind = dict(points.dtypes)["label"]
    return points.select("node", "label", "weight", "unit").mapInArrow(
        run, f"node long, label {kind}, width long, home long, far double, weight long, unit binary")


def cells(placed: DataFrame, uppers: dict, cosine: float, block: int) -> DataFrame:
    """Rows (cell, side, node, weight, unit): each point once per pair of blocks in which it may find a link."""
    limit = float(np.sqrt(2 - 2 * cosine)) + SLACK
    # One row per home: its number is bounded by the number of centres.
    stats = placed.groupBy("label", "width", "home").agg(F.max("far").alias("radius"), F.count(F.lit(1)).alias("n")).collect()
    of_label: dict = {}
    for r in stats:
        fits = max(1, min(block, BLOCK_BYTES // r["width"]))
        of_label.setdefault((r["label"], r["width"]), []).append((r["home"], r["radius"], -(-r["n"] // fits)))
    shared = placed.sparkSession.sparkContext.broadcast(
        (of_label, {k: u.levels[-1] for k, u in uppers.items()}))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        known, centres = shared.value
        for batch in batches:
            index, cell, side = [], [], []
            labels, widths = batch.column("label").to_pylist(), batch.column("width").to_pylist()
            nodes, home = batch.column("node").to_numpy(), batch.column("home").to_numpy()
            units = batch.column("unit")
            groups: dict = {}
            for i, key in enumerate(zip(labels, widths, strict=True)):
                groups.setdefault(key, []).append(i)
            for key, rows in groups.items():
                places = known[key]
                x = np.stack([np.frombuffer(units[i].as_py()) for i in rows])
                parts = {h: n for h, _, n in places}
                mine = [(int(home[i]), int((int(nodes[i]) * 0x9E3779B97F4A7C15 >> 32) % parts[int(home[i])])) for i in rows]
                for h, radius, n in places:
                    if key in centres:
                        near = distances(x, centres[key][h:h + 1])[:, 0] - radius <= limit
                    else:
                        near = np.ones(len(rows), dtype=bool)
                    for k in np.flatnonzero(near):
                        own = mine[k]
                        for other in ((h, b) for b in range(n)):
                            pair = (own, other) if own <= other else (other, own)
                            index.append(rows[k])
                            cell.append(f"{key[0]}/{key[1]}/{pair[0][0]}.{pair[0][1]}/{pair[1][0]}.{pair[1][1]}")
                            side.append(own == pair[0])
            take = batch.take(pa.array(index, pa.int64()))
            for at in range(0, len(index), 4096):
                part = take.slice(at, 4096)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell[at: at + 4096], pa.string()), pa.array(side[at: at + 4096], pa.bool_()),
                     part.column("node"), part.column("weight"), part.column("unit")],
                    names=["cell", "side", "node", "weight", "unit"])

    return placed.mapInArrow(run, "cell string, side boolean, node long, weight long, unit binary")


def found_links(sent: DataFrame, cosine: float) -> DataFrame:
    """node, n (links found in the cell) and other (a member of its connected part there)."""
    def run(group):
        import pyarrow as pa

        x = np.stack([np.frombuffer(u.as_py()) for u in group.column("unit")])
        nodes = group.column("node").to_numpy()
        _, one, two = group.column("cell")[0].as_py().rsplit("/", 2)
        side = group.column("side").to_numpy(zero_copy_only=False)
        links = pairs_of_cell(x, group.column("weight").to_numpy(), side, one == two, cosine)
        seen = np.flatnonzero(links.count > 0)
        root = links.root(seen)
        return pa.table({"node": nodes[seen], "n": links.count[seen].astype("int64"), "other": nodes[root]})

    return sent.groupBy("cell").applyInArrow(run, "node long, n long, other long")


def near_duplicates(embeddings: DataFrame, cosine: float = 0.98, block: int = BLOCK, centres: int = CENTRES,
                    per_home: int = PER_HOME) -> DataFrame:
    """vec_id, n_links, component_id and kept for every vector, also for those that link with nothing."""
    rows = written(vectors_of(embeddings), "cover-vectors")
    points = written(rows.where("unit IS NOT NULL").groupBy("label", "unit").agg(
        F.min("vec_id").alias("first_id"), F.count(F.lit(1)).alias("weight")).select(
        F.monotonically_increasing_id().alias("node"), "label", "unit", "first_id", "weight"), "cover-points")
    uppers = _uppers(points, centres, per_home)
    placed = written(homes(points, uppers), "cover-homes")
    found = written(found_links(cells(placed, uppers, cosine, block), cosine), "cover-links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    classes = components(found.select("node", "other"))
    named = points.select("node", "label", "unit", "first_id", "weight").join(counts, "node", "left").join(classes, "node", "left")
    named = written(named.select("label", "unit", "first_id", F.coalesce("component", "node").alias("component"),
                                 (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "cover-named")
    names = written(named.groupBy("component").agg(F.min("first_id").alias("component_id")), "cover-names")
    named = written(named.join(names, "component").select("label", "unit", "n_links", "component_id"), "cover-classes")
    linked = rows.where("unit IS NOT NULL").join(named, ["label", "unit"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("unit IS NULL").select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
