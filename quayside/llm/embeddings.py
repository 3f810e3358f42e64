"""Embedding near-duplicates by NN-descent: a neighbour graph refined through neighbours of neighbours."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quayside.llm.common import bounded_batches, components
from quayside.session import pin

THRESHOLD = 0.93
LIST = 16
TREES = 8
BLOCK = 128
# Neighbours less similar than this do not lead to near-duplicates and are not kept.
FLOOR = 0.5
BITS = 48


def _usable(vector: str) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def classes(rows: DataFrame) -> DataFrame:
    """(node, label, unit, n, first), pinned: distinct vectors of a label, as unit vectors of doubles.

    ``n`` rows have the vector, ``first`` is their smallest vec_id. A node is the 64-bit hash of
    label and vector.
    """
    sound = rows.where(F.col("label").isNotNull() & _usable("embedding")).select("vec_id", "label", _plain().alias("v"))
    sound = sound.withColumn("node", F.xxhash64("label", "v")).groupBy("node").agg(
        F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.count("*").alias("n"), F.min("vec_id").alias("first"))
    # Scaled first, so that squares neither overflow nor vanish.
    top = F.array_max(F.transform("v", lambda x: F.abs(x)))
    scaled = sound.withColumn("v", F.transform("v", lambda x: x / top))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return pin(scaled.select("node", "label", F.transform("v", lambda x: x / norm).alias("unit"), "n", "first"))


def _plain() -> Column:
    return F.transform("embedding", lambda x: x.cast("double") + 0.0)


def _planes(size: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, size]).standard_normal((size, BITS))


def tree_neighbours(nodes: DataFrame, trees: range, block: int = BLOCK, keep: int = LIST, floor: float = FLOOR, apart: bool = False) -> DataFrame:
    """(a, b, cos): first neighbours. Every tree orders the vectors of a label by the signs of random projections.

    Sorting by sign bits is a binary tree as deep as the data are dense; its leaves are runs of
    ``block`` vectors in that order, overlapping by half. Within a leaf every vector keeps its
    ``keep`` nearest. Leaves never grow, however many vectors are alike.

    With ``apart`` the nodes have a ``component``, and neighbours are of other components only. Of a stretch of one component
    in a tree's order a leaf then takes the first ``keep``, so that a leaf inside a large group reaches what lies around it.
    """
    bounded_batches(nodes.sparkSession)
    extra = ["component"] if apart else []

    def codes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out: list = [None] * len(frame)
            sizes = frame["unit"].map(len).to_numpy()
            for size in np.unique(sizes):
                at = np.flatnonzero(sizes == size)
                units = np.stack(frame["unit"].to_numpy()[at])
                powers = 1 << np.arange(BITS, dtype=np.int64)
                signs = np.stack([(units @ _planes(size, t) > 0) @ powers for t in trees], axis=1)
                for i, s in zip(at, signs):
                    out[i] = s
            yield pd.DataFrame({"node": frame["node"], "label": frame["label"], "unit": frame["unit"], **{c: frame[c] for c in extra}, "codes": out})

    kind = nodes.schema["label"].dataType.simpleString()
    coded = nodes.select("node", "label", "unit", *extra).mapInPandas(
        codes, f"node long, label {kind}, unit array<double>, {'component long, ' if apart else ''}codes array<long>")
    rows = coded.select("node", "label", "unit", *extra, F.size("unit").alias("dims"), F.posexplode("codes").alias("tree", "code"))
    order = ["label", "dims", "tree", "code", "node"]

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in _first_of_stretches(frames, keep, 4 * block) if apart else frames:
            a, b, c = [], [], []
            groups = frame.groupby(["label", "dims", "tree"], sort=False).indices
            for at in groups.values():
                for lo in range(0, max(1, len(at) - block // 2), block // 2):
                    leaf = at[lo:lo + block]
                    units = np.stack(frame["unit"].to_numpy()[leaf])
                    near = units @ units.T
                    np.fill_diagonal(near, -2)
                    if apart:
                        own = frame["component"].to_numpy()[leaf]
                        near[own[:, None] == own] = -2
                    best = np.argsort(-near, axis=1)[:, :keep]
                    value = np.take_along_axis(near, best, 1)
                    row, col = np.nonzero(value >= floor)
                    ids = frame["node"].to_numpy()[leaf]
                    a.append(ids[row])
                    b.append(ids[best[row, col]])
                    c.append(value[row, col])
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b), "cos": np.concatenate(c)})

    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select("node", "label", "dims", "tree", "unit", *extra).mapInPandas(search, "a long, b long, cos double")


def _first_of_stretches(frames: Iterator[pd.DataFrame], keep: int, rows: int) -> Iterator[pd.DataFrame]:
    """The first ``keep`` rows of every stretch of one component, in frames of about ``rows`` that overlap by a quarter."""
    held, last, place = [], None, 0
    for frame in frames:
        key = frame[["label", "dims", "tree", "component"]].to_numpy()
        changed = np.ones(len(key), bool)
        changed[1:] = (key[1:] != key[:-1]).any(axis=1)
        changed[0] = last is None or (key[0] != last).any()
        index = np.arange(len(key))
        begun = np.maximum.accumulate(np.where(changed, index, -1))
        places = np.where(begun >= 0, index - begun, place + 1 + index)
        last, place = key[-1], places[-1]
        held.append(frame[places < keep])
        if sum(map(len, held)) >= rows:
            whole = pd.concat(held, ignore_index=True)
            yield whole
            held = [whole.iloc[-(rows // 4):]]
    if held:
        yield pd.concat(held, ignore_index=True)


def best_lists(edges: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` nearest of every node, pinned. ``edges`` has a bounded number of rows per node."""
    merged = edges.groupBy("a", "b").agg(F.max("cos").alias("cos"))
    place = F.row_number().over(W.partitionBy("a").orderBy(F.desc("cos"), "b"))
    return pin(merged.withColumn("place", place).where(F.col("place") <= keep).select("a", "b", "cos"))


def refined(lists: DataFrame, nodes: DataFrame, threshold: float, keep: int, rounds: int = 8) -> DataFrame:
    """Neighbour lists after joins with neighbours' neighbours, until a round finds no new link.

    A node whose list is full of links (saturated) needs no better neighbours here; every other
    node that has neighbours meets the lists of its neighbours, and of the nodes that list it.
    """
    vectors = nodes.select("node", "unit")
    for _ in range(rounds):
        full = lists.where(F.col("cos") >= threshold).groupBy("a").count().where(F.col("count") >= keep).select("a")
        both = lists.select("a", "b").union(lists.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
        start = both.join(full, "a", "left_anti").select("a", F.col("b").alias("via"))
        step = lists.select(F.col("a").alias("via"), "b")
        new = start.join(step, "via").where("a <> b").select("a", "b").distinct().join(both, ["a", "b"], "left_anti")
        met = new.join(vectors.select(F.col("node").alias("a"), F.col("unit").alias("u")), "a").join(
            vectors.select(F.col("node").alias("b"), F.col("unit").alias("w")), "b")
        cos = F.aggregate(F.zip_with("u", "w", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        found = pin(met.select("a", "b", cos.alias("cos")).where(F.col("cos") >= FLOOR))
        more = found.where(F.col("cos") >= threshold).count()
        if found.isEmpty():
            break
        lists = best_lists(lists.union(found).union(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos")), keep)
        if not more:
            break
    return lists


def bridged(nodes: DataFrame, links: DataFrame, threshold: float, keep: int, first_tree: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(links, components), both pinned, after saturated lists were enlarged by what lies outside their components.

    A list full of links says nothing of what lies beyond it. While there are such lists, all nodes of their labels look
    for neighbours in other components, in new trees; a link found joins two components, and the search goes
    on until a round finds none. Inside a component nothing more need be listed: its links are counted exactly.
    """
    member = pin(components(links))
    full = links.groupBy("a").count().where(F.col("count") >= keep).select(F.col("a").alias("node"))
    labels = pin(nodes.join(full, "node", "left_semi").select("label").distinct())
    if labels.isEmpty():
        return links, member
    some = nodes.join(labels, "label", "left_semi").select("node", "label", "unit")
    while True:
        placed = some.join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
        found = tree_neighbours(placed, range(first_tree, first_tree + TREES), keep=keep, floor=threshold, apart=True)
        new = pin(found.select("a", "b").distinct())
        if new.isEmpty():
            return links, member
        links = pin(links.union(new).distinct())
        member = pin(components(links))
        first_tree += TREES


def _counts_in_blocks(members: DataFrame, threshold: float, block: int = 4096) -> DataFrame:
    """(node, linked): rows linked to every node among the members of its component (component, node, unit, n).

    The exact way for saturated lists: a component's members are dealt into blocks, and every pair
    of blocks is a matrix product, taken in strips, that gives counts, not pairs. A member is sent once per block of
    its component, so what is sent is a ``block``th part of what is compared.
    """
    sizes = members.groupBy("component").count().select("component", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = members.join(pin(sizes), "component").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "unit", "n")

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        own, i, j = frame["own"].to_numpy(), frame["i"].iloc[0], frame["j"].iloc[0]
        units, n, node = np.stack(frame["unit"].to_numpy()), frame["n"].to_numpy(), frame["node"].to_numpy()
        left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
        rows, columns = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        for lo in range(0, len(left), 256):
            strip = left[lo:lo + 256]
            near = units[strip] @ units[right].T >= threshold
            if i == j:
                near[np.arange(len(strip)), lo + np.arange(len(strip))] = False
            rows[lo:lo + 256] = near @ n[right]
            columns += n[strip] @ near
        if i == j:
            return pd.DataFrame({"node": node[left], "linked": rows})
        return pd.DataFrame({"node": np.r_[node[left], node[right]], "linked": np.r_[rows, columns]})

    return dealt.groupBy("component", "i", "j").applyInPandas(count, "node long, linked long").groupBy("node").agg(F.sum("linked").alias("linked"))


def recall(
    nodes: DataFrame, lists: DataFrame, threshold: float, keep: int, links: DataFrame | None = None, member: DataFrame | None = None,
    least_links: int = 200, most_queries: int = 8192,
) -> float | None:
    """Share of the true links of some nodes, compared with all, that are found; null where no link was met.

    A link is found if it is listed (in ``links``, or else in ``lists``), or if both its ends are in one component (``member``) that
    holds a full list, as its links are counted exactly. Nodes of
    smallest hash are asked, 256 at first and more until ``least_links`` true links were seen, all nodes or ``most_queries`` asked: the
    vectors asked are a broadcast of that size, and an audit costs one scan a step.
    """
    asked, seen = 256, None
    while True:
        queries = [(r.node, r.label, r.unit) for r in nodes.orderBy(F.xxhash64("node"), "node").select("node", "label", "unit").limit(asked).collect()]
        seen = pin(_true_links(nodes, queries, threshold))
        if len(queries) < asked or asked >= most_queries or seen.count() >= least_links:
            break
        asked *= 4
    near = lists.where(F.col("cos") >= threshold).select("a", "b")
    links = near if links is None else links
    member = pin(components(links)) if member is None else member
    dense = _dense(near, member, keep)
    both = links.select("a", "b").union(links.select("b", "a")).distinct().withColumn("hit", F.lit(True))
    inside = member.join(dense, "component", "left_semi")
    ends = [inside.select(F.col("node").alias(end), F.col("component").alias(f"{end}_component")) for end in ("a", "b")]
    held = seen.join(both, ["a", "b"], "left").join(ends[0], "a", "left").join(ends[1], "b", "left")
    one = F.coalesce(F.col("a_component") == F.col("b_component"), F.lit(False))
    found = held.agg(F.count("*").alias("all"), F.sum((F.coalesce("hit", F.lit(False)) | one).cast("long")).alias("hit")).first()
    return found["hit"] / found["all"] if found["all"] else None


def _dense(near: DataFrame, member: DataFrame, keep: int) -> DataFrame:
    """Components with a list full of links."""
    full = near.groupBy("a").count().where(F.col("count") >= keep).select(F.col("a").alias("node"))
    return pin(member.join(full, "node").select("component").distinct())


def _true_links(nodes: DataFrame, queries: list[tuple], threshold: float) -> DataFrame:
    by: dict = {}
    for node, label, unit in queries:
        by.setdefault((label, len(unit)), []).append((node, unit))
    by = {k: (np.array([n for n, _ in q]), np.array([u for _, u in q])) for k, q in by.items()}

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for (label, size), (ids, units) in by.items():
                at = np.flatnonzero((frame["label"].to_numpy() == label) & (frame["unit"].map(len).to_numpy() == size))
                if len(at):
                    own = frame["node"].to_numpy()[at]
                    r, c = np.nonzero(np.stack(frame["unit"].to_numpy()[at]) @ units.T >= threshold)
                    rows.append(np.stack([ids[c], own[r]], axis=1)[ids[c] != own[r]])
            yield pd.DataFrame(np.concatenate(rows) if rows else np.zeros((0, 2)), columns=["a", "b"], dtype="int64")

    return nodes.select("node", "label", "unit").mapInPandas(compare, "a long, b long")


def near_duplicates(rows: DataFrame, threshold: float = THRESHOLD, keep: int = LIST, trees: int = TREES, least: float = 0.97, most_trees: int = 64) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``rows`` (vec_id, embedding, label).

    Rows of one label with a cosine of ``threshold`` or more, in doubles, are linked. Vectors
    that are null, empty or zero, or hold null or non-finite components, and rows without a label, link with
    nothing; vectors of different lengths neither. Equal vectors are one node with a count. Neighbour lists come from
    random trees and are refined; where lists are full of links, neighbours are looked for outside their components
    (``bridged``), and such a component is compared in blocks, so no list length caps n_links or parts a component. The audit compares nodes
    with all others until it has met enough links; below a recall of ``least`` the trees are doubled, with other projections, up to
    ``most_trees``; a lower recall after that is a warning that names it. Null vec_ids never name a component. Repeated rows count as rows.
    """
    bounded_batches(rows.sparkSession)
    nodes = classes(rows)
    lists, grown = None, 0
    while True:
        more = range(grown, max(trees, 2 * grown))
        found = tree_neighbours(nodes, more, keep=keep)
        lists = best_lists(found if lists is None else lists.union(found), keep)
        lists = refined(lists, nodes, threshold, keep)
        grown = more.stop
        near = pin(lists.where(F.col("cos") >= threshold).select("a", "b"))
        links, member = bridged(nodes, near, threshold, keep)
        share = recall(nodes, lists, threshold, keep, links, member)
        if share is None or share >= least:
            break
        if grown >= most_trees:
            warnings.warn(f"{grown} trees find {share:.3f} of the links, {least} are wanted", stacklevel=2)
            break
    dense = _dense(near, member, keep)
    both = pin(links.union(links.select("b", "a")).distinct())
    inside = member.join(dense, "component", "left_semi").join(nodes.select("node", "unit", "n"), "node")
    counted = _counts_in_blocks(pin(inside), threshold)
    sparse = member.join(dense, "component", "left_anti").select(F.col("node").alias("a")).join(both, "a").join(
        nodes.select(F.col("node").alias("b"), "n"), "b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("linked"))
    named = nodes.select("node", "n", "first").join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = pin(named.groupBy("component").agg(F.min("first").alias("component_id")))
    told = named.join(lowest, "component").join(counted.union(sparse), "node", "left").select(
        "node", (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    sound = F.col("label").isNotNull() & _usable("embedding")
    keyed = rows.select("vec_id", F.when(sound, F.xxhash64("label", _plain())).alias("node"))
    out = keyed.join(pin(told), "node", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
