"""Near-duplicates: SimHash fingerprints with blocks that close pairs must share; shingle sets with blocks of minima and sketches; components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quayside.llm.common import bounded_batches, bytes_of, components
from quayside.session import pin, recorded_paths, remove

BITS = 64
SEED = 42
# A block with more fingerprints than this is split by midpoints instead of compared pair by pair.
LARGE_BLOCK = 64
_CHUNK = 1 << 15


def fingerprint(text: bytes, words: int = 3) -> int:
    """Signed 64-bit fingerprint: a bit is set if it is set in over half of the shingles' hashes."""
    found = text.lower().split()
    if not found:
        return 0
    spans = zip(*(found[i:] for i in range(words))) if len(found) >= words else [tuple(found)]
    shingles = [b" ".join(s) for s in spans]
    hashes = (np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[at:at + _CHUNK]], np.uint64) for at in range(0, len(shingles), _CHUNK))
    return _majority(hashes, len(shingles))


def _majority(chunks: Iterable[np.ndarray], number: int) -> int:
    """Signed 64 bits, each set if it is set in over half of ``number`` hashes."""
    counts = np.zeros(BITS, np.int64)
    for hashes in chunks:
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > number, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fingerprint long) for every row of ``docs`` (doc_id, text); map-only.

    Null and empty texts, and texts without words, have fingerprint 0. Repeated rows stay.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(t.as_py(), words) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], ["doc_id", "fingerprint"])

    return docs.select("doc_id", bytes_of("text").alias("text")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint long")


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def block_masks(distance: int, blocks: int) -> list[int]:
    """Masks of which every pair within ``distance`` agrees on at least one.

    ``distance`` differing bits touch at most that many blocks, so the pair agrees on the
    other ``blocks - distance`` whole blocks.
    """
    width = BITS // blocks
    parts = [((1 << width) - 1) << (i * width) for i in range(blocks)]
    parts[-1] |= ((1 << BITS) - 1) ^ sum(parts)
    return [sum(chosen) for chosen in combinations(parts, blocks - distance)]


def close_pairs(prints: DataFrame, distance: int = 2, blocks: int = 4) -> DataFrame:
    """Links (a, b) between distinct fingerprints that differ in 1 to ``distance`` bits.

    ``prints``: one column ``fingerprint``, distinct. Rows meet on (mask, masked bits) and are
    verified in the join's condition. A block with more than LARGE_BLOCK members is not
    compared pair by pair: two fingerprints within the distance have a midpoint that half of
    the differing bits lead to, so its members are keyed by all points within half the
    distance, and a point has no more members than it has neighbours. All links are found
    either way. With 4 blocks and distance 2 a key holds 32 bits, enough for 10^9 fingerprints.
    """
    masks = block_masks(distance, blocks)
    keyed = pin(prints.select("fingerprint", F.posexplode(F.array(*[
        F.col("fingerprint").bitwiseAND(F.lit(_signed(m))) for m in masks])).alias("mask", "block")))
    large = pin(keyed.groupBy("mask", "block").count().where(F.col("count") > LARGE_BLOCK).select("mask", "block", F.lit(True).alias("large")))
    keyed = keyed.join(large, ["mask", "block"], "left")

    def flips(mask: int) -> Column:
        outside = [1 << i for i in range(BITS) if not mask >> i & 1]
        ways = [sum(c) for n in range((distance + 1) // 2 + 1) for c in combinations(outside, n)]
        return F.array(*[F.lit(_signed(w)) for w in ways])

    case = F.when(F.lit(False), F.array(F.lit(0).cast("long")))
    for i, mask in enumerate(masks):
        case = case.when(F.col("mask") == i, flips(mask))
    split = keyed.where("large").select("fingerprint", "mask", F.explode(case).alias("flip")).select(
        "fingerprint", "mask", F.col("fingerprint").bitwiseXOR(F.col("flip")).alias("block"))
    rows = keyed.where("large is null").select("fingerprint", F.col("mask"), "block").union(
        split.select("fingerprint", F.col("mask") + len(masks), "block"))
    left, right = rows.withColumnRenamed("fingerprint", "a"), rows.withColumnRenamed("fingerprint", "b")
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return left.hint("merge").join(right, ["mask", "block"]).where(near).select("a", "b").distinct()


def close_fingerprints(docs: DataFrame, distance: int = 2, words: int = 3, blocks: int = 4) -> DataFrame:
    """(doc_id, fingerprint long, component_id) for every row of ``docs`` (doc_id, text).

    component_id is the smallest doc_id whose fingerprint is reachable over links of at most
    ``distance`` differing bits, the row's own fingerprint included. Exact copies share one
    fingerprint and are one node. Null doc_ids take part but never name a component; a
    component of null ids alone has a null id. Texts without words have fingerprint 0 and
    are linked like any other. Extra columns are ignored; an empty table gives an empty one.
    """
    prints = pin(fingerprints(docs, words))
    nodes = pin(prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first")))
    linked = pin(components(close_pairs(nodes.select("fingerprint"), distance, blocks)))
    firsts = nodes.join(linked, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component"))
    lowest = pin(firsts.groupBy("component").agg(F.min("first").alias("component_id")))
    named = pin(firsts.join(lowest, "component").select("fingerprint", "component_id"))
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def shingle_hashes(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's runs of ``words`` lower-case words; a shorter text is one run."""
    found = text.lower().split()
    size = min(words, len(found))
    if not size:
        return np.zeros(0, np.uint64)
    codes = {w: xxhash.xxh64_intdigest(w, SEED) for w in set(found)}
    codes = np.array([codes[w] for w in found], np.uint64)
    runs = np.full(len(found) - size + 1, size, np.uint64)
    for i in range(size):
        runs = _mixed(runs * np.uint64(0x9E3779B97F4A7C15) + codes[i:i + len(runs)])
    return np.unique(runs)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return x ^ (x >> np.uint64(33))


def _minima(hashes: np.ndarray, number: int) -> np.ndarray:
    """The smallest value of each of ``number`` permuted hashes; none for an empty set."""
    if not len(hashes):
        return np.zeros(0, np.uint64)
    factors, added = np.random.default_rng(SEED).integers(0, 1 << 63, (2, number), dtype=np.uint64)
    factors |= np.uint64(1)
    lowest = np.full(number, ~np.uint64(0))
    for at in range(0, len(hashes), 1024):
        lowest = np.minimum(lowest, (hashes[at:at + 1024, None] * factors + added).min(axis=0))
    return lowest


def _band_keys(lowest: np.ndarray, bands: int, rows: int) -> list[int]:
    """One signed key a band, of ``rows`` minima each."""
    if not len(lowest):
        return []
    keys = np.arange(bands, dtype=np.uint64)
    for column in lowest.reshape(bands, rows).T:
        keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
    return keys.view(np.int64).tolist()


def _node(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes(), SEED) - (1 << 63)


SKETCH = 12  # numbers of 16 lanes of 4 bits, one lane a minimum
_LANES = 0x1111111111111111
# A pair at the wanted similarity differs in more lanes than its sketch is allowed with a probability of about 3e-5.
DEVIATIONS = 4.0
# Members that one task holds of a family too large for pairs of rows.
SLICE = 1024


def _sketch(lowest: np.ndarray) -> list[int]:
    """The last 4 bits of every minimum, as SKETCH numbers."""
    lanes = _mixed(lowest[:SKETCH * 16]).reshape(SKETCH, 16) & np.uint64(15)
    return np.bitwise_or.reduce(lanes << (np.arange(16, dtype=np.uint64) * np.uint64(4)), axis=1).view(np.int64).tolist()


def _allowed(similarity: float) -> int:
    """Lanes in which the sketches of a pair of this similarity may differ."""
    n, p = SKETCH * 16, (1 - similarity) * 15 / 16
    return int(n * p + DEVIATIONS * (n * p * (1 - p)) ** 0.5) + 1


def _lanes_apart(left: str, right: str) -> Column:
    """In how many lanes two sketches differ; ``left`` and ``right`` are prefixes of their columns."""
    total = F.lit(0)
    for i in range(SKETCH):
        x = F.col(f"{left}{i}").bitwiseXOR(F.col(f"{right}{i}"))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        total = total + F.bit_count(x.bitwiseAND(F.lit(_LANES)))
    return total


class _Nodes:
    """Distinct shingle sets of a table: their sketches and, where a pair needs them, the sets themselves."""

    def __init__(self, signed: DataFrame, nodes: DataFrame, similarity: float):
        self.signed, self.nodes, self.similarity = signed, nodes, similarity

    def sketched(self, rows: DataFrame, end: str) -> DataFrame:
        """``rows`` with the sketch of the node in column ``end``, in columns ``end``0, ``end``1, ..."""
        own = self.nodes.select(F.col("node").alias(end), *[F.col("sketch")[i].alias(f"{end}{i}") for i in range(SKETCH)])
        return rows.join(own, end)

    def sets(self, wanted: DataFrame) -> DataFrame:
        """(node, shingles) of the nodes in ``wanted``, pinned: every set is written once, by the row that stands for it."""
        rows = pin(self.nodes.join(wanted, "node", "left_semi").select("row"))
        return pin(self.signed.select("row", "node", "shingles").join(rows, "row", "left_semi").select("node", "shingles"))

    def close(self) -> Column:
        return _lanes_apart("a", "b") <= _allowed(self.similarity)

    def near(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) of ``pairs`` whose sketches are near."""
        return self.sketched(self.sketched(pairs, "a"), "b").where(self.close()).select("a", "b")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The (a, b) of ``pairs`` whose sets are similar enough, pinned. Pairs should be near by their sketches."""
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                u, v = ([np.frombuffer(x, np.uint32) for x in batch.column(i).to_pylist()] for i in (2, 3))
                found = pa.array([_jaccard(x, y) >= similarity for x, y in zip(u, v)], pa.bool_())
                yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(found)

        similarity = self.similarity
        pairs = pin(pairs)
        sets = self.sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct())
        met = pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("u")), "a").join(
            sets.select(F.col("node").alias("b"), F.col("shingles").alias("v")), "b")
        return pin(met.select("a", "b", "u", "v").mapInArrow(run, "a long, b long"))

    def print_links(self, distance: int) -> DataFrame:
        """Links (a, b) found by SimHash: nodes with one fingerprint, and the first ones of fingerprints that share blocks and differ in up to ``distance`` bits."""
        def ends(a: str, b: str) -> list[Column]:
            return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]

        with recorded_paths() as made:
            heads = pin(self.nodes.groupBy("fingerprint").agg(F.min("node").alias("head")))
            equal = self.nodes.select("node", "fingerprint").join(heads, "fingerprint").where("node <> head").select(*ends("node", "head"))
            of = [heads.select(F.col("fingerprint").alias(c), F.col("head").alias(f"head_{c}")) for c in "ab"]
            apart = close_pairs(heads.select("fingerprint"), distance).join(of[0], "a").join(of[1], "b").select(*ends("head_a", "head_b"))
            found = self.links(self.near(equal.union(apart).distinct()))
        # The last table holds the links.
        for path in made[:-1]:
            remove(self.nodes.sparkSession, path)
        return found

    def family_links(self, members: DataFrame) -> DataFrame:
        """Links (a, b) between members (hub, node, component, n) of one hub that are in different components, pinned.

        For families of any size ``n``: members are dealt into slices, and every two slices of a family are one task
        that compares sketches as matrices and sets where those are near. What leaves a task is links, not pairs.
        """
        similarity, most = self.similarity, _allowed(self.similarity)

        def compare(frame: pd.DataFrame) -> pd.DataFrame:
            own, i, j = frame["own"].to_numpy(), frame["i"].iloc[0], frame["j"].iloc[0]
            node, component = frame["node"].to_numpy(), frame["component"].to_numpy()
            sketch = np.stack(frame["sketch"].to_numpy()).astype(np.int64).view(np.uint64)
            sets = [np.frombuffer(x, np.uint32) for x in frame["shingles"]]
            left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
            found = []
            for x in left:
                others = right[right > x] if i == j else right
                others = others[component[others] != component[x]]
                apart = sketch[others] ^ sketch[x]
                apart |= apart >> np.uint64(1)
                apart |= apart >> np.uint64(2)
                near = others[np.bitwise_count(apart & np.uint64(_LANES)).sum(axis=1) <= most]
                found += [(node[x], node[y]) for y in near if _jaccard(sets[x], sets[y]) >= similarity]
            return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

        members = pin(members)
        dealt = members.join(self.nodes.select("node", "sketch"), "node").join(self.sets(members.select("node")), "node")
        dealt = dealt.withColumn("slices", F.ceil(F.col("n") / SLICE).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), "slices").cast("int"))
        dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        dealt = dealt.select("hub", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "component", "sketch", "shingles")
        return pin(dealt.groupBy("hub", "i", "j").applyInPandas(compare, "a long, b long").distinct())


def _jaccard(u: np.ndarray, v: np.ndarray) -> float:
    both = len(np.intersect1d(u, v, assume_unique=True))
    return both / max(1, len(u) + len(v) - both)


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8, bands: int = 32, rows: int = 6, distance: int = 2) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs`` (doc_id, text): groups of near-copies.

    Texts are linked whose sets of ``words``-word shingles (as 32-bit hashes) have a Jaccard similarity of ``similarity`` or
    more. Equal sets are one node; texts without words are one node too, linked with nothing else.

    First comes SimHash: a node's fingerprint has the bits that are set in over half of its shingles' hashes. Fingerprints that differ in up to
    ``distance`` bits meet by blocks (``close_pairs``), and those whose sets are similar are linked. Sets at a similarity of 0.8 mostly differ in more bits than any
    blocks of 64 can be asked for, so what is not yet connected is looked for by minima: nodes that share all minima of a band are a block, and may be linked; at a similarity of 0.8, 32 bands of 6 miss a link with a probability of 6e-5.

    A block's leader is the member that shares most blocks with others: of edited copies, the original. Every member meets
    the leaders of its blocks that are in other components, and links make components. A node's hub is the foremost of its leaders. Then members of one hub in
    different components are compared, and members of a block with different hubs and components; pairs inside a
    component need no comparison. Candidates pass if the sketches of their minima are near, and are linked if the sets are similar.
    So the number of pairs of rows follows the number of nodes, not the square of a group; a hub with more than LARGE_BLOCK
    members in several components is compared slice by slice, with the same result, where only the arithmetic is quadratic.
    component_id is the smallest doc_id of the component, as in ``close_fingerprints``.
    """
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t.as_py(), words) for t in batch.column(1)]
            lowest = [_minima(f, bands * rows) for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([_node(f) for f in found], pa.int64()), pa.array([_majority([f], len(f)) for f in found], pa.int64()), pa.array([_band_keys(x, bands, rows) for x in lowest], pa.list_(pa.int64())),
                 pa.array([_sketch(x) if len(x) else [0] * SKETCH for x in lowest], pa.list_(pa.int64())),
                 pa.array([np.unique((f >> np.uint64(32)).astype(np.uint32)).tobytes() for f in found], pa.binary())], ["doc_id", "node", "fingerprint", "keys", "sketch", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = pin(docs.select("doc_id", bytes_of("text").alias("text")).mapInArrow(
        run, f"doc_id {kind}, node long, fingerprint long, keys array<long>, sketch array<long>, shingles binary").withColumn("row", F.monotonically_increasing_id()))
    nodes = pin(signed.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("row").alias("row"), F.any_value("fingerprint").alias("fingerprint"), F.any_value("keys").alias("keys"), F.any_value("sketch").alias("sketch")))
    every = _Nodes(signed, nodes, similarity)
    printed = every.print_links(distance)
    first = pin(components(printed))

    def component(end: str) -> Column:
        return F.coalesce(f"component_{end}", end)

    keyed = nodes.select("node", F.explode("keys").alias("key"))
    blocks = pin(keyed.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    keyed = pin(keyed.join(blocks, "key"))
    shared = pin(keyed.groupBy("node").agg(F.sum("members").alias("shared")))
    leaders = pin(keyed.join(shared, "node").groupBy("key").agg(F.max(F.struct("shared", "node")).alias("leader")))
    led = keyed.join(leaders, "key").select("key", "node", "leader").withColumn("to", F.col("leader")["node"])
    met = pin(led.groupBy("node", "to").agg(F.first("leader").alias("leader")))
    hubs = pin(met.groupBy("node").agg(F.max("leader")["node"].alias("hub")))

    pairs = met.where("node <> to").select(F.greatest("node", "to").alias("a"), F.least("node", "to").alias("b")).distinct()
    for end in "ab":
        pairs = pairs.join(first.select(F.col("node").alias(end), F.col("component").alias(f"component_{end}")), end, "left")
    links = printed.union(every.links(every.near(pairs.where(component("a") != component("b")).select("a", "b"))))

    linked = pin(components(links))
    placed = pin(hubs.join(linked, "node", "left").select("node", "hub", F.coalesce("component", "node").alias("component")))
    several = F.min("component") < F.max("component")
    families = pin(placed.groupBy("hub").agg(F.count("*").alias("n"), several.alias("several")).where("several"))
    members = placed.join(families.select("hub", "n"), "hub")
    mixed = keyed.select("key", "node").join(placed, "node")
    crossed = pin(mixed.groupBy("key").agg((several & (F.min("hub") < F.max("hub"))).alias("crossed")).where("crossed").select("key"))
    mixed = pin(every.sketched(mixed.join(crossed, "key").withColumnRenamed("node", "a"), "a"))
    small = pin(every.sketched(members.where(F.col("n") <= LARGE_BLOCK).withColumnRenamed("node", "a"), "a"))

    def pairs_of(rows: DataFrame, on: str, *different: str) -> DataFrame:
        other = rows.select(on, F.col("a").alias("b"), *[F.col(c).alias(f"b_{c}") for c in different], *[F.col(f"a{i}").alias(f"b{i}") for i in range(SKETCH)])
        found = (F.col("a") > F.col("b")) & every.close()
        for c in different:
            found = found & (F.col(c) != F.col(f"b_{c}"))
        return rows.hint("merge").join(other, on).where(found).select("a", "b")

    rest = pairs_of(small.drop("n"), "hub", "component").union(pairs_of(mixed, "key", "hub", "component")).distinct()
    linked = pin(components(links.union(every.links(rest)).union(every.family_links(members.where(F.col("n") > LARGE_BLOCK)))))

    firsts = nodes.join(linked, "node", "left").select("node", "first", F.coalesce("component", "node").alias("component"))
    lowest = pin(firsts.groupBy("component").agg(F.min("first").alias("component_id")))
    named = pin(firsts.join(lowest, "component").select("node", "component_id"))
    return signed.select("doc_id", "node").join(named, "node").select("doc_id", "component_id")


def distinct_documents(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of every component: that with the smallest doc_id.

    Of repeated rows with one id and text one stays; documents without an id stay, as no id can name
    them. Only ids and shingle hashes meet the links; the texts are joined once to the ids that go.
    """
    with recorded_paths() as made:
        found = near_duplicates(docs, words, similarity)
    found = pin(found)
    # Sets, sketches and blocks have done their work; what stays is a row of ids per document.
    for path in made:
        remove(docs.sparkSession, path)
    copies = found.where("doc_id <> component_id").select("doc_id")
    stay = docs.join(pin(copies.distinct()), "doc_id", "left_anti")
    again = pin(found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    once = stay.join(again, "doc_id", "left_anti")
    return once.select(*docs.columns).unionByName(stay.join(again, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id", "text"]))


def hex_digits(fingerprint: str) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))
