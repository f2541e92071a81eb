"""Embedding near-dedup: exact threshold pairs by a distributed cover tree and dual traversal.

Vectors are compared within a label by cosine in double precision. Equal vectors collapse first, with their
number. The tree's upper levels are built by passes over all vectors: a node with more than `chunk` vectors
picks up to `fan` centres far apart among a sample of its own (bounded by `sample`), and each vector goes home to its
nearest centre's child, until children are small, or so dense that all their pairs are within the distance.
A vector also visits, as a guest, the other children that may hold a partner: those whose side of the bisecting
planes comes within the distance of it, and whose ball, by its covering radius, does. So a leaf has all partners
of its own vectors. Leaves are the tasks' units: home vectors and guests, block by block, get cover trees, of
nested levels with halving radii, and a dual traversal that prunes node pairs by their covering-radius bounds,
takes node pairs that are within the distance as a whole, and tests what is left exactly. Links are counted,
not listed, each at the home of either end; a spanning forest of each unit joins the components.

Cost: near the number of vectors where they lie in groups; vectors without any, in many dimensions, visit a
share of all children, so that work grows with a power between one and two. A leaf that stays large though not
dense (`deepest` levels down) is compared block against block.

Defined results: a null label, a null or empty vector, one with null or non-finite components, and a zero
vector link with nothing, nor do vectors of different lengths. Vectors are scaled by powers of two, which is
exact, so that very large and very small ones neither over- nor underflow. Rows with a null id are left out of
links and have themselves (null) as component. Repeated rows of one id are separate vectors with that id. An
empty table gives an empty result. Only the id, vector and label columns are read, so further columns,
whatever their names, don't matter.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import saved, shuffle_partitions, table
from codeloom.llm.graph import connected_components

LEAF = 64
#: A node whose children at half its radius would have fewer points than this on average stays whole.
LEAST_CHILD = 8
SLACK = 1e-9
MARGIN = 1e-7
#: Distances on the upper levels may err by less than this.
LOOSE = 1e-6


class Node:
    """A ball of points: rows[lo:hi] of the tree's order around its centre."""

    __slots__ = ("center", "radius", "lo", "hi", "children")

    def __init__(self, center: np.ndarray, radius: float, lo: int, hi: int):
        self.center, self.radius, self.lo, self.hi, self.children = center, radius, lo, hi, []


class CoverTree:
    """Nested levels with halving radii over unit vectors."""

    def __init__(self, x: np.ndarray):
        self.x, self.order = x, np.arange(len(x))
        # all distances by one matrix product, where it is small; they may err by less than MARGIN
        self.d = np.sqrt(np.maximum(0.0, 2 - 2 * x @ x.T)) if len(x) <= 4096 else None
        d = self.distances(0, self.order)
        self.root = Node(x[0], float(d.max()) + MARGIN, 0, len(x))
        todo = [(self.root, d)]
        while todo:
            node, d = todo.pop()
            if node.hi - node.lo <= LEAF or node.radius < 5 * MARGIN:
                continue
            reach, rows = node.radius / 2, self.order[node.lo : node.hi].copy()
            left, at = np.ones(len(rows), bool), node.lo
            centre_rows: list[int] = []
            while left.any() and len(centre_rows) * LEAST_CHILD <= len(rows):
                k = 0 if not centre_rows else int(np.flatnonzero(left)[0])
                c = node.center if not centre_rows else self.x[rows[k]]  # nested: the parent's centre is its first child's
                dist = d if not centre_rows else self.distances(int(rows[k]), rows[left])
                near = np.zeros(len(rows), bool)
                near[left] = dist <= reach
                if centre_rows:
                    near[k] = True
                got = dist[near[left]] if centre_rows else d[near]
                centre_rows.append(k)
                n = int(near.sum())
                if n:
                    self.order[at : at + n] = rows[near]
                    child = Node(c, float(got.max()) + MARGIN, at, at + n)
                    node.children.append(child)
                    todo.append((child, got))
                    at += n
                left &= ~near
            if left.any():  # too few lie together at this radius for levels to tell them apart
                self.order[node.lo : node.hi] = rows
                del todo[len(todo) - len(node.children) :]
                node.children = []

    def distances(self, k: int, rows: np.ndarray) -> np.ndarray:
        if self.d is not None:
            return self.d[k, rows]
        return np.sqrt(((self.x[rows] - self.x[k]) ** 2).sum(axis=1))


def traverse(a: CoverTree, b: CoverTree, distance: float, exact, whole, same: bool) -> None:
    """exact(i, j): rows of a and b to test; whole(i, j): rows that all are within the distance."""
    todo = [(a.root, b.root)]
    while todo:
        p, q = todo.pop()
        if same and p is not q and p.lo == q.lo and p.hi == q.hi:
            continue
        gap = float(np.sqrt(((p.center - q.center) ** 2).sum()))
        if gap - p.radius - q.radius > distance + SLACK:
            continue
        if gap + p.radius + q.radius < distance - 1e-6:
            whole(a.order[p.lo : p.hi], b.order[q.lo : q.hi])
            continue
        pc, qc = p.children, q.children
        if not pc and not qc:
            exact(a.order[p.lo : p.hi], b.order[q.lo : q.hi])
            continue
        if same and p is q:
            centers = np.array([c.center for c in pc])
            radii = np.array([c.radius for c in pc])
            far = np.sqrt(np.maximum(0.0, 2 - 2 * centers @ centers.T)) - 1e-7
            x, y = np.nonzero(np.triu(far - radii[:, None] - radii[None, :] <= distance + SLACK))
            todo += [(pc[i], pc[j]) for i, j in zip(x.tolist(), y.tolist())]
            continue
        left, right = (pc, [q]) if pc and (not qc or p.radius >= q.radius) else ([p], qc)
        if len(left) > 1 and qc and p.radius < 2 * q.radius:
            right = qc
        far = np.sqrt(np.maximum(0.0, 2 - 2 * np.array([c.center for c in left]) @ np.array([c.center for c in right]).T)) - 1e-7
        keep = far - np.array([c.radius for c in left])[:, None] - np.array([c.radius for c in right])[None, :] <= distance + SLACK
        x, y = np.nonzero(keep)
        todo += [(left[i], right[j]) for i, j in zip(x.tolist(), y.tolist())]


def links(x: np.ndarray, y: np.ndarray | None, raw_x: np.ndarray, raw_y: np.ndarray | None, weight_x: np.ndarray, weight_y: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray | None, list[tuple[int, int]]]:
    """Weighted link counts of both sides and a spanning forest; y None: x against itself. Rows of y follow x's in the forest."""
    same = y is None
    a = CoverTree(x)
    b = a if same else CoverTree(y)
    if same:
        raw_y, weight_y = raw_x, weight_x
    norm_x, norm_y = np.sqrt((raw_x**2).sum(axis=1)), np.sqrt((raw_y**2).sum(axis=1))
    nx, ny = np.zeros(len(x), np.int64), np.zeros(len(raw_y), np.int64)
    root, forest, shift = list(range(len(x) + (0 if same else len(y)))), [], 0 if same else len(x)

    def join(i: int, j: int) -> None:
        j += shift
        a, b = i, j
        while root[i] != i:
            root[i] = i = root[root[i]]
        while root[j] != j:
            root[j] = j = root[root[j]]
        if i != j:
            root[max(i, j)] = min(i, j)
            forest.append((a, b))

    def add(i: np.ndarray, j: np.ndarray, ok: np.ndarray) -> None:
        if same and i.size == j.size and (i == j).all():
            ok = ok & ~np.eye(i.size, dtype=bool)
            nx[i] += ok @ weight_y[j]
            ok = np.triu(ok)
        else:
            nx[i] += ok @ weight_y[j]
            (nx if same else ny)[j] += ok.T @ weight_x[i]
        if ok.all():  # a path joins them all
            for k in i.tolist():
                join(k, int(j[0]))
            for k in j.tolist():
                join(int(i[0]), k)
            return
        for s, t in zip(*(v.tolist() for v in np.nonzero(ok))):
            join(int(i[s]), int(j[t]))

    def exact(i, j):
        cos = (raw_x[i] @ raw_y[j].T) / (norm_x[i][:, None] * norm_y[j][None, :])
        ok = cos >= least
        for p, q in zip(*np.nonzero(np.abs(cos - least) < 1e-12)):  # alike from either side, whatever the order of sums
            ok[p, q] = cosine(raw_x[i[p]], raw_y[j[q]]) >= least
        add(i, j, ok)

    def whole(i, j):
        for s in range(0, i.size, 1024):
            if same and i.size == j.size and (i == j).all():
                for t in range(s, i.size, 1024):
                    add(i[s : s + 1024], j[t : t + 1024], np.ones((i[s : s + 1024].size, j[t : t + 1024].size), bool))
            else:
                add(i[s : s + 1024], j, np.ones((i[s : s + 1024].size, j.size), bool))

    traverse(a, b, math.sqrt(max(0.0, 2 - 2 * least)), exact, whole, same)
    return nx, None if same else ny, forest


def cosine(a: np.ndarray, b: np.ndarray) -> float:
    return math.fsum(a * b) / math.sqrt(math.fsum(a * a) * math.fsum(b * b))


def scaled(v: np.ndarray) -> np.ndarray:
    """v times the power of two that brings its largest component near 1."""
    return np.ldexp(v, -np.frexp(np.abs(v).max(axis=-1, keepdims=True))[1])


def unit(v: np.ndarray) -> np.ndarray:
    return v / np.sqrt((v**2).sum(axis=-1, keepdims=True))


def spread(x: np.ndarray, n: int) -> np.ndarray:
    """At most n of the points, each the furthest from those before."""
    at, d = [0], np.sqrt(((x - x[0]) ** 2).sum(axis=1))
    while len(at) < min(n, len(x)) and d.max() > 1e-6:
        at.append(int(d.argmax()))
        d = np.minimum(d, np.sqrt(((x - x[at[-1]]) ** 2).sum(axis=1)))
    return x[at]


def visits(x: np.ndarray, centres: np.ndarray, distance: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For unit vectors x: each one's nearest centre, which children may hold a partner, and all distances."""
    square = np.maximum(0.0, 2 - 2 * x @ centres.T)
    home = square.argmin(axis=1)
    apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(axis=2))
    np.fill_diagonal(apart, 1.0)
    # a partner in child c is nearer to c than to any centre j: beyond the plane between them
    beyond = ((square[:, :, None] - square[:, None, :]) / (2 * apart)[None]).max(axis=2)
    may = beyond <= distance + LOOSE
    may[np.arange(len(x)), home] = True
    return home, may, np.sqrt(square)


def _valid(vectors: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """(id, label, v, fine) of every row; fine: the row can link."""
    v = F.col(vector).cast("array<double>")
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(label).cast("string").alias("label"), v.alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return rows.withColumn("fine", F.coalesce(fine & F.col("id").isNotNull() & F.col("label").isNotNull(), F.lit(False)))


ROW = "node string, home boolean, sid long, mult long, v binary, dist double"


def _started(sets: DataFrame) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for b in batches:
            raw = [scaled(np.array(x)).tobytes() for x in b.column(3).to_pylist()]
            n = b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([True] * n), b.column(1), b.column(2), pa.array(raw, pa.binary()), pa.array([2.0] * n)], names=[x.split()[0] for x in ROW.split(", ")])

    return sets.select(F.concat("grp", F.lit("/")), "sid", "mult", "v").mapInArrow(run, ROW)


def _children(large: DataFrame, distance: float, chunk: int, fan: int, sample: int) -> DataFrame:
    """The rows of large nodes as home rows and guests of their children. large: also homes, members."""
    import pyarrow as pa

    def pick(key, t):
        t = t.sort_by("sid")
        x = np.array([np.frombuffer(v) for v in t.column("v").to_pylist()])
        few = min(fan, max(4, 2 * -(-t.column("homes")[0].as_py() // chunk)))
        return pa.table({"node": pa.array([key[0].as_py()]), "v": pa.array([spread(unit(x), few).tobytes()], pa.binary()), "size": pa.array([x.shape[1]], pa.int64()), "members": pa.array([t.column("members")[0].as_py()], pa.int64())})

    def run(batches):
        at = centres = None
        for b in batches:
            node, part, row, home, sid, mult, v = (c.to_pylist() for c in b.columns)
            start = 0
            while start < b.num_rows:
                if row[start] == 0:  # a node's centres come before its rows
                    at, centres, start = (node[start], part[start]), np.frombuffer(v[start]).reshape(-1, sid[start]), start + 1
                    continue
                end = start
                while end < min(b.num_rows, start + 2048) and row[end] and (node[end], part[end]) == at:
                    end += 1
                x = unit(np.array([np.frombuffer(t) for t in v[start:end]]))
                near, may, dist = visits(x, centres, distance)
                i, c = np.nonzero(may)
                first = [f"{at[0]}{k:x}." for k in range(len(centres))]
                take = pa.array(i + start)
                yield pa.RecordBatch.from_arrays([pa.array([first[k] for k in c.tolist()], pa.string()), pa.array([home[start + p] and bool(near[p] == q) for p, q in zip(i.tolist(), c.tolist())], pa.bool_()), b.column(4).take(take), b.column(5).take(take), b.column(6).take(take), pa.array(dist[i, c])], names=[x.split()[0] for x in ROW.split(", ")])
                start = end

    draw = F.pmod(F.xxhash64("sid", "node"), F.lit(1 << 30)) / float(1 << 30)
    some = large.where(F.col("home") & (draw * F.col("homes") < sample)).select("node", "sid", "v", "members", "homes")
    centres = saved(some.groupBy("node").applyInArrow(pick, "node string, v binary, size long, members long"), "centres")
    # a node of many rows is dealt in parts, each with the centres before its rows
    parts = F.ceil(F.col("members") / 16_384).cast("int")
    heads = centres.select("node", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("row"), F.lit(False).alias("home"), F.col("size").alias("sid"), F.lit(0).cast("long").alias("mult"), "v")
    rows = large.join(centres.select("node"), "node", "left_semi")
    rows = rows.select("node", F.pmod(F.xxhash64("sid"), parts).cast("int").alias("part"), F.lit(1).alias("row"), "home", "sid", "mult", "v")
    dealt = heads.union(rows).repartition(shuffle_partitions(large.sparkSession), "node", "part").sortWithinPartitions("node", "part", "row", "sid")
    return dealt.mapInArrow(run, ROW)


def leaves(rows: DataFrame, distance: float, chunk: int, fan: int = 16, sample: int = 256, deepest: int = 10) -> DataFrame:
    """(node, home, sid, mult, v, dist, homes, radius, dense): the rows of the tree's leaves, guests with them."""
    found, todo = None, saved(rows, "level")
    for depth in range(deepest + 1):
        size = todo.groupBy("node").agg(F.sum(F.col("home").cast("long")).alias("homes"), F.count("*").alias("members"), F.max(F.when(F.col("home"), F.col("dist"))).alias("radius"))
        size = saved(size.where("homes > 0").withColumn("dense", (F.col("homes") > chunk) & (2 * F.col("radius") < distance - 2 * LOOSE)), "sizes")
        here = todo.join(size, "node").where(F.col("home") | (F.col("dist") <= F.col("radius") + distance + LOOSE))
        large = (F.col("homes") > chunk) & ~F.col("dense") & F.lit(depth < deepest)
        done = saved(here.where(~large).drop("members"), "leaves")
        found = done if found is None else found.union(done)
        if size.where(large).isEmpty():
            break
        # a sample can miss a node: it then stays a leaf, compared block against block
        whole = saved(here.where(large), "large")
        todo = saved(_children(whole, distance, chunk, fan, sample), "level")
        missed = whole.join(todo.select(F.regexp_replace("node", "[0-9a-f]+\\.$", "").alias("node")).distinct(), "node", "left_anti")
        found = found.union(saved(missed.drop("members"), "missed"))
    return found


def near_duplicates(vectors: DataFrame, least: float = 0.98, key: str = "vec_id", vector: str = "embedding", label: str = "label", chunk: int = 1024) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row."""
    import pyarrow as pa

    spark, distance = vectors.sparkSession, math.sqrt(max(0.0, 2 - 2 * least))
    every = _valid(vectors, key, vector, label)
    valid = every.where("fine").withColumn("grp", F.concat_ws(":", F.size("v").cast("string"), "label"))
    valid = saved(valid.withColumn("fp", F.sha2(F.concat_ws(",", "grp", F.concat_ws(",", F.col("v").cast("array<string>"))), 256)), "vectors")
    # a set's id is its own, no member's: two vectors may have one id
    sets = saved(valid.groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.first("grp").alias("grp"), F.first("v").alias("v")).withColumn("sid", F.monotonically_increasing_id()), "distinct")
    tree = leaves(_started(sets), distance, chunk)

    # dense leaves: all home rows link with each other, and with the guests that are near enough for certain
    sure = F.col("home") | (F.col("dist") + F.col("radius") < distance - 2 * LOOSE)
    dense = tree.where("dense")
    total = saved(dense.where(sure).groupBy("node").agg(F.sum("mult").alias("total"), F.min(F.when(F.col("home"), F.col("sid"))).alias("anchor")), "dense")
    easy = dense.where(sure).join(total, "node").select(F.col("sid").alias("a"), F.col("anchor").alias("b"), F.when(F.col("home"), F.col("total") - F.col("mult")).otherwise(F.lit(0)).cast("long").alias("n"))

    # units: each block of a leaf's home rows, with all other rows of the leaf as guests
    blocks = F.ceil(F.col("homes") / chunk).cast("int")
    own = F.pmod(F.xxhash64("sid", "node"), blocks).cast("int")
    rows = tree.where(~F.col("dense") | F.col("home") | ~sure).withColumn("block", F.explode(F.when(F.col("home") & F.col("dense"), F.array(own)).otherwise(F.sequence(F.lit(0), blocks - 1))))
    rows = rows.select("node", "block", (~(F.col("home") & (own == F.col("block")))).cast("int").alias("side"), "sid", "mult", "v", "dense")
    dealt = rows.repartition(shuffle_partitions(spark), "node", "block").sortWithinPartitions("node", "block", "side", "sid")

    def work(batches):
        """Homes and, piece by piece, guests of a unit; it holds two blocks of vectors."""
        at, home, guests = None, [], []

        def against(y) -> pa.RecordBatch | None:
            """Links of the home rows with each other (y None) or with guests."""
            if not home or (y is not None and not y):
                return None
            raw, w = np.array([np.frombuffer(r[2]) for r in home]), np.array([r[1] for r in home], np.int64)
            if y is None:
                counts, _, forest = links(unit(raw), None, raw, None, w, None, least)
                sids = [r[0] for r in home]
            else:
                raw_y = np.array([np.frombuffer(r[2]) for r in y])
                counts, _, forest = links(unit(raw), unit(raw_y), raw, raw_y, w, np.array([r[1] for r in y], np.int64), least)
                sids = [r[0] for r in home + y]
            some = np.flatnonzero(counts)
            a = [sids[i] for i in some] + [sids[i] for i, _ in forest]
            b = [None] * some.size + [sids[j] for _, j in forest]
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*counts[some].tolist(), *[0] * len(forest)], pa.int64())], names=["a", "b", "n"])

        def own_links():
            return None if dense_unit else against(None)

        met = dense_unit = True
        for batch in batches:
            for node, block, side, sid, mult, v, is_dense in zip(*(c.to_pylist() for c in batch.columns)):
                if (node, block) != at:
                    yield from filter(None, (own_links() if not met else None, against(guests)))
                    at, home, guests, met, dense_unit = (node, block), [], [], False, is_dense
                if side == 0:
                    home.append((sid, mult, v))
                    continue
                if not met:  # all home rows are here
                    met = True
                    yield from filter(None, (own_links(),))
                guests.append((sid, mult, v))
                if len(guests) >= 2 * chunk:
                    yield from filter(None, (against(guests),))
                    guests = []
        yield from filter(None, (own_links() if not met else None, against(guests)))

    found = saved(dealt.mapInArrow(work, "a long, b long, n long").union(easy), "found")
    counts = found.where("n > 0").groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("n"))
    classes = connected_components(found.where("b is not null and a != b").select("a", "b")).withColumnRenamed("id", "sid")
    per_set = sets.select("fp", "sid", "rep", "mult").join(counts, "sid", "left").join(classes, "sid", "left")
    per_set = saved(per_set.select("fp", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "sid").alias("component"), "rep"), "sets")
    least_id = per_set.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = valid.select("id", "fp").join(per_set.join(least_id, "component").select("fp", "n_links", "component_id"), "fp").select("id", "n_links", "component_id")
    out = linked.union(every.where("not fine").select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(F.col("id").alias("vec_id"), F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op3_embedding_near_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "embeddings"))


OP3_SQL = """
with recursive vectors as (
  select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x != 0)) > 0
), normed as (
  select *, list_dot_product(v, v) as s from vectors
), links as (
  select a.vec_id as l, b.vec_id as r from normed a join normed b on a.label = b.label and a.vec_id != b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / sqrt(a.s * b.s) >= 0.98
), reached as (
  select vec_id as l, vec_id as r from embeddings union select reached.l, links.r from reached join links on reached.r = links.l
)
select e.vec_id, coalesce(n.n, 0) as n_links, c.component_id, e.vec_id = c.component_id as kept
from embeddings e left join (select l, count(*) as n from links group by l) n on n.l = e.vec_id
left join (select l, min(r) as component_id from reached group by l) c on c.l = e.vec_id
"""
