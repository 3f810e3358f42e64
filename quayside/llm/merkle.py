"""A Merkle manifest of a dataset: one tree a source, one above them, and a path-copied version for every changed leaf."""

from __future__ import annotations

from collections.abc import Callable
from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import bounded_batches
from quayside.operators.numbering import number_rows
from quayside.session import pin

FAN = 16
# An aligned block holds FAN^DEPTH neighbouring nodes and the levels above them: what one task works on at a time.
DEPTH = 2
BLOCK = FAN ** DEPTH
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
HEX = 64
PATHS = "tree long, place long, subroot string, places array<int>, runs array<string>"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """Hex SHA-256 of the fields, each as its UTF-8 byte count, a colon and its value; ``-`` for null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class Block:
    """The base tree of one aligned block; versions share its nodes and copy only the way up from their leaf."""

    def __init__(self, nodes: list[str], tree_size: int):
        """``tree_size``: nodes of the whole tree on this level. A tree that fits the block ends where one node remains."""
        self.levels = [nodes]
        while len(self.levels) <= DEPTH and (tree_size > BLOCK or len(self.levels[-1]) > 1):
            below = self.levels[-1]
            self.levels.append([digest("".join(below[i:i + FAN])) for i in range(0, len(below), FAN)])
        self.root = self.levels[-1][0]

    def path(self, at: int) -> tuple[list[int], list[str]]:
        """Level by level up to the block's root: place within the run, and the run's digests as one text."""
        places, runs = [], []
        for level in self.levels[:-1]:
            start = at - at % FAN
            places.append(at % FAN)
            runs.append("".join(level[start:start + FAN]))
            at //= FAN
        return places, runs


def copied_path(node: str, places: list[int], runs: list[str]) -> list[str]:
    """The nodes on the way up from ``node``, folded with the path's siblings: what a version with ``node`` at its start has of its own."""
    out = [node]
    for at, run in zip(places, runs):
        out.append(digest(run[:HEX * at] + out[-1] + run[HEX * (at + 1):]))
    return out


def siblings(places: list[int], runs: list[str]) -> str:
    return "".join(run[:HEX * at] + run[HEX * (at + 1):] for at, run in zip(places, runs))


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"place div {BLOCK}"))


def tiers(nodes: DataFrame) -> list[DataFrame]:
    """``nodes`` (tree, place from 0, n, node), then the roots of its blocks, and theirs, until each tree has one node left.

    ``n`` is the tree's number of nodes on that tier. Each tier is a table DEPTH levels above the one before, smaller by BLOCK.
    """
    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        n = int(frame["n"].iloc[0])
        return pd.DataFrame({"tree": frame["tree"].iloc[:1], "place": frame["block"].iloc[:1], "n": [-(-n // BLOCK)], "node": [Block(frame["node"].tolist(), n).root]})

    out = [nodes]
    while len(out) == 1 or (out[-1].agg(F.max("n")).first()[0] or 1) > 1:
        rows = _blocks(out[-1].select("tree", "place", "n", "node"))
        out.append(pin(rows.groupBy("tree", "block").applyInPandas(reduce, "tree long, place long, n long, node string")))
    return out


def _downward(nodes: DataFrame, paths: DataFrame, then: Callable, schema: str) -> DataFrame:
    """Each block of ``nodes`` with the path of its root: ``then(frame, base tree, row of the path)``."""
    def one(frame: pd.DataFrame, path: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("place")
        return then(frame, Block(frame["node"].tolist(), int(frame["n"].iloc[0])), path.iloc[0])

    above = paths.withColumnRenamed("place", "block")
    return _blocks(nodes).groupBy("tree", "block").cogroup(above.groupBy("tree", "block")).applyInPandas(one, schema)


def paths_to_root(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """(tree, place, subroot, places, runs) for the nodes of the first of ``levels``, from those of the trees' last nodes (``top``)."""
    def lengthen(frame: pd.DataFrame, base: Block, path) -> pd.DataFrame:
        own = [base.path(i) for i in range(len(frame))]
        return pd.DataFrame({
            "tree": frame["tree"], "place": frame["place"], "subroot": path["subroot"],
            "places": [p + list(path["places"]) for p, _ in own], "runs": [r + list(path["runs"]) for _, r in own]})

    paths = top
    for nodes in reversed(levels[:-1]):
        paths = pin(_downward(nodes, paths, lengthen, PATHS))
    return paths


def manifest(docs: DataFrame, changed: Column, proofs: bool = False) -> DataFrame:
    """(doc_id, source, place, leaf, subroot, root, proof_sha256, copied, folded_root, verified) for every row of ``docs``.

    Every row is a leaf, a digest of its fields. A source's leaves ascend by doc_id (null first, equal ids by digest); every FAN
    neighbours become one node, level by level, until one remains, the subroot; subroots, ordered by source (null first,
    by UTF-8 bytes), become the root in the same way. ``proof_sha256`` is the digest of the siblings on the way to the
    root (of nothing: of the empty text); with ``proofs`` they are returned too, as ``proof``.

    Where ``changed`` holds, the text's A-Z are lower-cased: the changed leaf starts a version. A version shares all base
    nodes but those on its leaf's path: ``copied`` holds its new nodes from leaf to root, null where nothing is changed.
    ``folded_root`` is recomputed for every row, from its leaf (the changed one, if any) and the siblings on its way up;
    ``verified`` says whether it equals the root. A changed row without capitals has an equal leaf, a version of equal digests, and is verified.

    Null fields count as ``-``; repeated rows are leaves side by side; other columns are ignored; an empty table gives an empty one.

    Leaves get their place by a range sort, so a source may hold any share of the rows. A task holds one aligned block
    of BLOCK nodes at a time. Block roots are the next tier's nodes; paths come down the tiers again, once a block, and every version
    continues above its block along that path, in its own block's task: no upper block gathers versions.
    """
    spark = bounded_batches(docs.sparkSession)
    fields = [F.col(c) for c in FIELDS]
    lower = [*fields[:-1], F.translate("text", UPPER, LOWER)]
    kind = docs.schema["doc_id"].dataType.simpleString()
    leaves = pin(docs.select("doc_id", "source", leaf_digest(fields).alias("node"), F.when(changed, leaf_digest(lower)).alias("other")))
    trees = leaves.groupBy("source").agg(F.count("*").alias("n")).withColumn("all", F.lit(0))
    trees = pin(number_rows(trees, ["all"], [F.col("source")], name="number").select(F.col("source").alias("of"), "n", (F.col("number") - 1).alias("tree")))
    placed = number_rows(leaves, ["source"], [F.col("doc_id"), F.col("node"), F.col("other")], name="number")
    placed = pin(placed.join(trees, F.col("source").eqNullSafe(F.col("of"))).select(
        "tree", (F.col("number") - 1).alias("place"), "n", "node", F.col("doc_id").cast("string").alias("doc_id"), "source", "other"))

    below = tiers(placed)
    number = trees.count()
    subroots = pin(below[-1].select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.lit(number).cast("long").alias("n"), "node"))
    above = tiers(subroots)
    root = (above[-1].first() or {"node": None})["node"]
    ends = spark.createDataFrame([(0, 0, None, [], [])][:number], PATHS)
    top = paths_to_root(above, ends).select(F.col("place").alias("tree"), "places", "runs")
    top = pin(top.join(subroots.select(F.col("place").alias("tree"), F.col("node").alias("subroot")), "tree").select(
        "tree", F.lit(0).cast("long").alias("place"), "subroot", "places", "runs"))
    paths = paths_to_root(below[1:], top)

    def finish(frame: pd.DataFrame, base: Block, path) -> pd.DataFrame:
        upper = list(path["places"]), list(path["runs"])
        rest = siblings(*upper)
        proof, copied, folded = [], [], []
        for i, other in enumerate(frame["other"]):
            places, runs = base.path(i)
            proof.append(siblings(places, runs) + rest)
            changed = isinstance(other, str)
            way = copied_path(other if changed else frame["node"].iloc[i], places + upper[0], runs + upper[1])
            copied.append(way if changed else None)
            folded.append(way[-1])
        return pd.DataFrame({
            "doc_id": frame["doc_id"], "source": frame["source"], "place": frame["place"], "leaf": frame["node"], "subroot": path["subroot"],
            "root": root, "proof_sha256": [digest(p) for p in proof], "copied": copied, "folded_root": folded, "verified": [f == root for f in folded],
            **({"proof": proof} if proofs else {})})

    schema = (f"doc_id string, source string, place long, leaf string, subroot string, root string, proof_sha256 string, copied array<string>, "
              f"folded_root string, verified boolean{', proof string' if proofs else ''}")
    # A number column with nulls would reach pandas as floats: ids travel as text.
    return _downward(placed, paths, finish, schema).withColumn("doc_id", F.col("doc_id").cast(kind))
