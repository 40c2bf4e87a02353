"""Parent-child links to full hierarchies.

Every record names at most one parent, so each connected component is one tree or one circle with trees hanging from it.
The plan has three steps:

1. ``components``: tasks contract the links inside blocks of rows (a block is any bounded set of rows, best one that keeps
   most links inside, such as a claim's events; a hot claim may be spread over many blocks). What is left is a small graph of
   links between blocks, which is contracted again, by pointer doubling if it is too large for one block. Every record so
   gets the label of its component.
2. Components are co-located by label, and each is walked depth first with node colouring (white, grey, black): a link to a
   grey node closes a circle.
3. Components of more than ``max_component`` records never enter one task: they are walked by pointer doubling, in joins; their
   paths and descendants come from rows (id, ancestor, distance), which are doubled too.

Defined cases: records without id are dropped; of several records with one id the first to arrive counts; a parent that no
record has makes its child a root; a record that is its own parent is a circle of one. Empty input gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut, parallelism

#: Records of one block, and of the link graph that still goes to one task; about 150 bytes each.
BLOCK_ROWS = 1_000_000
#: Records of a component that one task may hold.
MAX_COMPONENT = 1_000_000
#: Descendants that one row may list, and entries of paths and descendants that a walk holds at a time besides one record's.
MAX_LIST = 1_000_000


def local_walk(par: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For parents by position (-1: none): root or first circle member reached, steps to it, and whether it is on a circle.

    Doubling ends as soon as a round resolves no further node; what is unresolved then leads into circles.
    """
    n = len(par)
    node = np.arange(n)
    if not n:
        return node, node, np.zeros(0, bool)

    def double(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        root = parent < 0
        ptr, dist = np.where(root, node, parent), (~root).astype(np.int64)
        left = -1
        while (now := int((~root[ptr]).sum())) and now != left:
            left, dist, ptr = now, dist + dist[ptr], ptr[ptr]
        return ptr, dist, ~root[ptr]

    top, dist, rest = double(par)
    circle = np.zeros(n, bool)
    if rest.any():
        ptr = np.where(rest, par, node)
        for _ in range(max(1, math.ceil(math.log2(rest.sum() + 1)))):
            ptr = ptr[ptr]
        circle[ptr[rest]] = True
        top, dist, _ = double(np.where(circle, -1, par))
    return top, dist, circle


def _positions(ids: pa.Array, parents: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.index_in(parents, value_set=ids), -1).to_numpy(zero_copy_only=False).astype(np.int64)


def _joined(tables: list[pa.RecordBatch]) -> pa.Table:
    return pa.Table.from_batches(tables).combine_chunks()


def _chunks(batches, rows: int):
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield _joined(held)
            held, n = [], 0
    if n:
        yield _joined(held)


def _column(t: pa.Table, name: str) -> pa.Array:
    c = t.column(name)
    return c.chunk(0) if c.num_chunks == 1 else pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type)


def _contract(batches):
    """Adds to each record the top that it reaches inside its block, and the parent outside where the top has one."""
    for t in _chunks(batches, BLOCK_ROWS):
        ids, parents = _column(t, "id"), _column(t, "parent")
        par = _positions(ids, parents)
        top, _, circle = local_walk(par)
        if circle.any():  # one label for a whole circle: its first member in the block
            label, at = np.arange(len(par)), np.where(circle, par, np.arange(len(par)))
            for _ in range(math.ceil(math.log2(circle.sum() + 1))):
                label, at = np.minimum(label, label[at]), at[at]
            closed = circle[top]
            top = label[top]
        else:
            closed = circle
        outer = pc.if_else(pa.array(closed), pa.scalar(None, parents.type), parents.take(pa.array(top)))
        out = t.append_column("top", ids.take(pa.array(top))).append_column("outer", outer)
        yield from out.to_batches()


def nodes(df: DataFrame, id_col: str = "id", parent_col: str = "parent", block_col: str = "block", arrival: str | None = None) -> DataFrame:
    """One record (id, parent, block) per id, the first to arrive; ties go to the smallest parent and block, nulls last."""
    first = F.min(F.struct(F.col(arrival) if arrival else F.lit(0), F.col(parent_col).isNull(), F.col(parent_col), F.col(block_col).isNull(), F.col(block_col)))
    rows = df.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(first.alias("r"))
    return rows.select("id", F.col(f"r.{parent_col}").alias("parent"), F.col(f"r.{block_col}").alias("block"))


def double_walk(links: DataFrame) -> DataFrame:
    """(id, top, depth, on_circle, circle_min) of links (id, parent), each parent null or present, by distributed doubling.

    top is the root, or the first circle member reached; circle_min the smallest id of that circle, null for trees. Rounds
    grow with the logarithm of the depth; no group of records is ever held by one task.
    """

    def run(start: DataFrame) -> tuple[DataFrame, int]:
        state = start.select("id", F.coalesce("parent", "id").alias("ptr"), F.col("parent").isNotNull().cast("long").alias("d"), F.col("id").alias("m"), F.col("parent").isNull().alias("at_root"))
        roots = state.filter("at_root").select(F.col("id").alias("ptr"), F.lit(True).alias("hit"))
        state = cut(state.drop("at_root").join(roots, "ptr", "left").select("id", "ptr", "d", "m", F.coalesce("hit", F.lit(False)).alias("done")))
        left = -1
        while (now := state.filter("NOT done").count()) and now != left:
            left = now
            state = step(state)
        return state, now

    def step(state: DataFrame) -> DataFrame:
        b = state.select(F.col("id").alias("ptr"), F.col("ptr").alias("p2"), F.col("d").alias("d2"), F.col("m").alias("m2"), F.col("done").alias("done2"))
        todo = state.filter("NOT done").drop("done").join(b, "ptr")
        return cut(state.filter("done").unionByName(todo.select("id", F.col("p2").alias("ptr"), (F.col("d") + F.col("d2")).alias("d"), F.least("m", "m2").alias("m"), F.col("done2").alias("done"))).coalesce(parts))

    parts = parallelism(links.sparkSession)  # a union has the partitions of both sides, which would double each round
    state, left = run(links)
    trees = state.filter("done").select("id", F.col("ptr").alias("top"), F.col("d").alias("depth"), F.lit(False).alias("on_circle"), F.lit(None).cast("binary").alias("circle_min"))
    if not left:
        return trees
    state = cut(state.filter("NOT done"))
    for _ in range(max(1, math.ceil(math.log2(left + 1)))):
        state = step(state)
    members = cut(state.select(F.col("ptr").alias("id")).distinct().join(state.select("id", F.col("m").alias("circle_min")), "id"))
    hanging = state.select("id").join(links, "id").join(members.select("id", F.lit(True).alias("on_circle")), "id", "left")
    tails, _ = run(hanging.select("id", F.when(F.col("on_circle").isNull(), F.col("parent")).alias("parent")))
    tails = tails.join(members.withColumnRenamed("id", "ptr"), "ptr")
    return trees.unionByName(tails.select("id", F.col("ptr").alias("top"), F.col("d").alias("depth"), (F.col("id") == F.col("ptr")).alias("on_circle"), "circle_min"))


def components(records: DataFrame) -> DataFrame:
    """(id, parent, block, component) of records as ``nodes`` gives them. The label is the id of some record of the component."""
    kind = "id binary, parent binary, block binary, top binary, outer binary"
    blocks = cut(records.hint("rebalance", "block").mapInArrow(_contract, kind))
    tops = blocks.filter("top = id AND outer IS NOT NULL").select("id", "outer")
    links = cut(tops.join(blocks.select(F.col("id").alias("outer"), F.col("top").alias("parent")), "outer").select("id", "parent"))
    n = links.count()
    if not n:
        return blocks.select("id", "parent", "block", F.col("top").alias("component"))
    # parents that have no outer link themselves are the roots of the link graph
    graph = links.unionByName(links.select(F.col("parent").alias("id")).distinct().join(links, "id", "left_anti").select("id", F.lit(None).cast("binary").alias("parent")))
    if n <= BLOCK_ROWS // 2:
        one = graph.select("id", "parent", F.lit(None).cast("binary").alias("block")).coalesce(1).mapInArrow(_contract, kind)
        labels = one.select(F.col("id").alias("top"), F.col("top").alias("label"))
    else:
        labels = double_walk(graph).select(F.col("id").alias("top"), F.coalesce("circle_min", "top").alias("label"))
    labels = cut(labels.filter("label <> top"))
    return blocks.join(labels, "top", "left").select("id", "parent", "block", F.coalesce("label", "top").alias("component"))


WALKED = "id binary, block binary, root binary, depth int, on_circle boolean, in_circle boolean, root_block binary"
FULL = WALKED + ", path array<binary>, descendants array<binary>, n_descendants bigint, back_to binary"


def _dfs(starts: list[int], colour: list[int], children: list[list[int]], pre: list[int], end: list[int], order: list[int], back: dict[int, int]) -> None:
    """Iterative depth-first walk; colours 0 white, 1 grey, 2 black. back gets links to grey nodes, by the node they leave."""
    for s in starts:
        if colour[s]:
            continue
        colour[s], pre[s] = 1, len(order)
        order.append(s)
        stack = [(s, iter(children[s]))]
        while stack:
            node, todo = stack[-1]
            for c in todo:
                if colour[c] == 0:
                    colour[c], pre[c] = 1, len(order)
                    order.append(c)
                    stack.append((c, iter(children[c])))
                    break
                if colour[c] == 1:
                    back[node] = c
            else:
                colour[node], end[node] = 2, len(order)
                stack.pop()


def _walker(full: bool):
    def walk(t: pa.Table):
        ids, parents, blocks = _column(t, "id"), _column(t, "parent"), _column(t, "block")
        n = len(ids)
        par = _positions(ids, parents)
        text = ids.to_pylist()
        parent = par.tolist()
        children: list[list[int]] = [[] for _ in range(n)]
        for i, p in enumerate(parent):
            if p >= 0:
                children[p].append(i)
        colour, pre, end, order, back = [0] * n, [0] * n, [0] * n, [], {}
        roots = [i for i, p in enumerate(parent) if p < 0]
        _dfs(roots, colour, children, pre, end, order, back)
        # what is white now hangs from circles: climb, greying, until a grey node closes the circle
        on = [False] * n
        in_circle = [False] * n
        starts = []
        for i in range(n):
            if colour[i] or in_circle[i]:
                continue
            trail, x = [], i
            while not in_circle[x]:
                in_circle[x] = True
                trail.append(x)
                x = parent[x]
            if x in (seen := {y: k for k, y in enumerate(trail)}):
                ring = trail[seen[x] :]
                for y in ring:
                    on[y] = True
                starts.append(min(ring, key=text.__getitem__))
        _dfs(starts, colour, children, pre, end, order, back)
        root, depth, level, first = [0] * n, [0] * n, [0] * n, [False] * n
        for x in starts:
            first[x] = True
        for x in order:
            p = parent[x]
            if p < 0 or first[x]:
                root[x] = x
            else:
                root[x], level[x] = root[p], level[p] + 1
            depth[x] = 0 if on[x] or p < 0 else depth[p] + 1
        arr_root = pa.array(root)
        cols = [ids, blocks, ids.take(arr_root), pa.array(depth, pa.int32()), pa.array(on), pa.array(in_circle), blocks.take(arr_root)]
        names = ["id", "block", "root", "depth", "on_circle", "in_circle", "root_block"]
        if not full:
            yield pa.RecordBatch.from_arrays(cols, names)
            return
        names += ["path", "descendants", "n_descendants", "back_to"]
        trail: list[bytes] = []
        at: list[int] = []
        paths: list[list[bytes]] = []
        below: list[list[bytes]] = []
        held = 0
        for k, x in enumerate(order):
            del trail[level[x] :]
            trail.append(text[x])
            at.append(x)
            paths.append(trail.copy())
            below.append([text[y] for y in order[pre[x] + 1 : end[x]]])
            held += len(paths[-1]) + len(below[-1])
            if held >= MAX_LIST or k == n - 1:
                mine = pa.array(at)
                lists = [pa.array(paths, pa.list_(pa.binary())), pa.array(below, pa.list_(pa.binary())), pa.array([len(y) for y in below], pa.int64())]
                edge = pa.array([text[back[y]] if y in back else None for y in at], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.take(mine) for c in cols), *lists, edge], names)
                at, paths, below, held = [], [], [], 0

    def run(batches):
        # batches arrive sorted by component; only whole components are walked
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            if rows + b.num_rows > 200_000 and b.num_rows:
                c = b.column("component")
                cutoff = int(pc.index(pc.not_equal(c, c[0]), True).as_py()) if b.num_rows > 1 else -1
                if cutoff > 0:
                    held.append(b.slice(0, cutoff))
                    yield from walk(_joined(held))
                    held, rows, b = [], 0, b.slice(cutoff)
            held.append(b)
            rows += b.num_rows
        if rows:
            yield from walk(_joined(held))

    return run


def closure(links: DataFrame) -> DataFrame:
    """(id, ancestor, distance) for every ancestor of every record of links (id, parent), each parent null or present, no circles.

    Distances double each round, in joins; no group of records is ever held by one task.
    """
    parts = parallelism(links.sparkSession)
    jump, step = cut(links.filter("parent IS NOT NULL").select("id", F.col("parent").alias("ancestor")).repartition(parts, "id")), 1
    known = jump.withColumn("distance", F.lit(1).cast("long"))
    while True:
        onward = known.select(F.col("id").alias("via"), "ancestor", (F.col("distance") + step).alias("distance"))
        new = cut(jump.select("id", F.col("ancestor").alias("via")).join(onward, "via").select("id", "ancestor", "distance").repartition(parts, "id"))
        if new.isEmpty():
            return known
        step *= 2
        known, jump = known.unionByName(new), new.filter(F.col("distance") == step).select("id", "ancestor")


def _lists(links: DataFrame, walked: DataFrame) -> DataFrame:
    """(id, path, descendants, n_descendants, back_to) of walked records, one row for every MAX_LIST descendants."""
    smallest = walked.filter("circle_min = id").select("id", F.lit(True).alias("smallest"))
    marked = cut(links.join(smallest, "id", "left"))
    pairs = closure(marked.select("id", F.when(F.col("smallest").isNull(), F.col("parent")).alias("parent")))
    upward = pairs.unionByName(links.select("id", F.col("id").alias("ancestor"), F.lit(0).cast("long").alias("distance")))
    paths = upward.groupBy("id").agg(F.transform(F.sort_array(F.collect_list(F.struct("distance", "ancestor")), asc=False), lambda x: x["ancestor"]).alias("path"))
    totals = cut(pairs.groupBy("ancestor").agg(F.count("*").alias("n_descendants")))
    shares = totals.filter(F.col("n_descendants") > MAX_LIST).select("ancestor", F.ceil(F.col("n_descendants") / MAX_LIST).alias("shares"))
    share = F.coalesce(F.pmod(F.xxhash64("id"), F.col("shares")), F.lit(0))
    below = pairs.join(shares, "ancestor", "left").groupBy(F.col("ancestor"), share.alias("share")).agg(F.transform(F.sort_array(F.collect_list(F.struct("distance", "id"))), lambda x: x["id"]).alias("descendants"))
    below = cut(below.drop("share")).join(totals, "ancestor").withColumnRenamed("ancestor", "id")
    edges = marked.filter("smallest").select(F.col("parent").alias("id"), F.col("id").alias("back_to"))
    out = cut(paths).join(below, "id", "left").join(edges, "id", "left")
    return out.withColumns({"descendants": F.coalesce("descendants", F.array().cast("array<binary>")), "n_descendants": F.coalesce("n_descendants", F.lit(0))})


def hierarchy(records: DataFrame, full: bool = False, max_component: int = MAX_COMPONENT) -> DataFrame:
    """Walks the hierarchies of records (id, parent, block).

    Gives id, block, root (the smallest id of the circle where the walk enters one), depth (steps to the root, or to the
    first circle member), on_circle, in_circle (on a circle or hanging from one) and root_block. With ``full`` also path (from
    the root, or the smallest circle member, down to the record), descendants (in depth-first order, siblings by id; on a circle the link back
    to its smallest member is cut), n_descendants and back_to (the record that a back edge leads to). In components beyond
    ``max_component`` descendants come by distance, and a record with more than ``MAX_LIST`` of them has several rows, which
    share them out. Paths and descendants have as many entries as there are pairs of ancestor and record.
    """
    labelled = components(records)
    sizes = labelled.groupBy("component").count()
    big = cut(sizes.filter(F.col("count") > max_component).select("component"))
    n_big = big.count()
    small = labelled
    if n_big:
        small = labelled.join(big, "component", "left_anti")
    placed = small.repartition(parallelism(records.sparkSession), "component").sortWithinPartitions("component", "id")
    out = placed.select("id", "parent", "block", "component").mapInArrow(_walker(full), FULL if full else WALKED)
    if n_big:
        mine = labelled.join(big, "component", "left_semi")
        known = mine.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
        links = mine.join(known, "parent", "left").select("id", F.when(F.col("known"), F.col("parent")).alias("parent"))
        links = cut(links)
        walked = double_walk(links).withColumn("root", F.coalesce("circle_min", "top"))
        if full:
            walked = cut(walked.coalesce(parallelism(records.sparkSession)))
        lists = _lists(links, walked) if full else None
        blocks = mine.select("id", "block")
        walked = walked.join(blocks, "id").join(blocks.select(F.col("id").alias("root"), F.col("block").alias("root_block")), "root", "left")
        far = walked.select("id", "block", "root", F.col("depth").cast("int").alias("depth"), "on_circle", F.col("circle_min").isNotNull().alias("in_circle"), "root_block")
        if full:
            far = cut(far).join(cut(lists), "id")
        out = out.unionByName(far)
    return out
