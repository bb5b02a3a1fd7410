"""SimHash near duplicates: fingerprints, linked by a self-join of their binary trie.

A fingerprint has a bit set where more than half of the text's shingle hashes have it.
Two fingerprints link at ``budget`` (3) or fewer differing bits.  The distinct fingerprints
are the leaves of a binary trie.  Pairs of nodes are traversed together from the root: the
children of a pair are the pairs of their children, a pair that takes different branches
has one more differing bit, and a pair over the budget is dropped with all below it.

To deal the traversal out, the 64 bits are cut into five blocks: with at most three
differing bits, two blocks at least are equal.  So for each of the ten pairs of blocks the
fingerprints that agree there form one group with a trie of its own, and every link lies in
one of these groups.  Fingerprints are 8 bytes; no text is shuffled.  Where a group is dense, what is
already connected is not compared again, and a group gives a spanning forest, so a group of
``m`` copies gives ``m - 1`` links and loses none of the connections.  A group of more than
``CHUNK_ROWS`` fingerprints is cut into chunks, and each pair of chunks is a task with a trie
of its own, so that a task's memory has a bound and every two members still meet.

Edge cases: null and empty texts have fingerprint zero, which links like any other; fewer
words than a shingle has count as one shingle; repeated rows share a fingerprint; a null
doc_id is part of its group but is no one's smallest doc_id (a group of such rows only has
a null component_id).
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from venuelens.llm.common import whole_groups
from venuelens.session import broadcast_if_small, written

BUDGET = 3
SEED = 42
#: Members of a group that meet in one task, at most about twice this number.
CHUNK_ROWS = 1 << 16
#: Keys of larger groups that are broadcast, at most; more of them are joined by a shuffle.
HOT_KEYS = 100_000
_CHUNK = 1 << 15
#: First bit and width of the five blocks.
_BLOCKS = [(0, 13), (13, 13), (26, 13), (39, 13), (52, 12)]


def shingle_hashes(words: list[bytes], width: int, start: int, stop: int) -> np.ndarray:
    digest, join = xxhash.xxh64_intdigest, b" ".join
    return np.fromiter((digest(join(words[i : i + width]), SEED) for i in range(start, stop)), np.uint64, stop - start)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit."""
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, n: int) -> int:
    return int(sum(1 << int(b) for b in np.flatnonzero(2 * ones > n)))


def fingerprint_of(text: str | None, width: int = 3) -> int:
    """The fingerprint of one whole text, as an unsigned number."""
    words = _words(text)
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, _CHUNK):
        ones += _ones(shingle_hashes(words, width, at, min(n, at + _CHUNK)))
    return _majority(ones, n)


def fingerprints(text: Column, width: int = 3) -> Column:
    """Column with the fingerprint of a text as a signed bigint with the same 64 bits."""

    @F.pandas_udf("bigint")
    def of(texts: pd.Series) -> pd.Series:
        found = np.array([fingerprint_of(x, width) for x in texts], np.uint64)
        return pd.Series(found.view(np.int64))

    return of(text)


class _Forest:
    """Which leaves are connected so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.links: list[tuple[np.ndarray, np.ndarray]] = []

    def connect(self, a: np.ndarray, b: np.ndarray) -> None:
        """Add the links that connect something new; roots are smallest leaves."""
        if not len(a):
            return
        a_root, b_root = self.root[a], self.root[b]
        new = a_root != b_root
        if not new.any():
            return
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        kept = []
        for i, x, y in zip(np.flatnonzero(new), a_root[new].tolist(), b_root[new].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                kept.append(i)
        self.links.append((a[kept], b[kept]))
        moved = np.array(list(parent), np.int64)
        lead = np.arange(len(self.root))
        lead[moved] = [find(int(x)) for x in moved]
        self.root = lead[self.root]


def trie_links(values: np.ndarray, starts: np.ndarray, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect all values of a group within ``budget`` bits, as places in ``values``.

    ``values``: unsigned, in groups that begin at ``starts``, sorted in each.
    A node of a group's trie is a range of the sorted values with a common prefix; pairs of
    nodes that wait are kept in parts of bounded size, the deepest first.
    """
    n = len(values)
    forest = _Forest(n)
    group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
    near = np.flatnonzero(group[1:] == group[:-1])
    _link(values, near, near + 1, forest, budget)
    ends = np.append(starts[1:], n)
    # A pair of nodes: ranges [a0, a1) and [b0, b1), differing bits so far.
    pairs = np.stack([starts, ends, starts, ends, np.zeros_like(starts)])[:, ends - starts > 1]
    waiting = [(63, pairs)]
    while waiting:
        bit, pairs = waiting.pop()
        pairs = pairs[:, ~_connected(forest.root, pairs)]
        small = ((pairs[1] - pairs[0]) * (pairs[3] - pairs[2]) <= 64) | (bit < 0)
        _compare(values, pairs[:, small], forest, budget)
        below = _children(values, bit, pairs[:, ~small], budget)
        for at in range(0, below.shape[1], _CHUNK):
            waiting.append((bit - 1, below[:, at : at + _CHUNK]))
    if not forest.links:
        none = np.zeros(0, np.int64)
        return none, none
    return tuple(np.concatenate(x) for x in zip(*forest.links, strict=True))


def _children(values: np.ndarray, bit: int, pairs: np.ndarray, budget: int) -> np.ndarray:
    """The pairs of children of pairs of nodes, without those over the budget."""
    a0, a1, b0, b1, err = pairs
    if not len(a0):
        return pairs
    zeros = np.concatenate([[0], np.cumsum((values & np.uint64(1 << bit)) == 0)])
    a_mid, b_mid = a0 + zeros[a1] - zeros[a0], b0 + zeros[b1] - zeros[b0]
    twins = (a0 == b0) & (a1 == b1)
    below = [
        np.stack([a0, a_mid, b0, b_mid, err]),
        np.stack([a_mid, a1, b_mid, b1, err]),
        np.stack([a0, a_mid, b_mid, b1, err + 1]),
        np.stack([a_mid, a1, b0, b_mid, err + 1])[:, ~twins],
    ]
    a0, a1, b0, b1, err = pairs = np.concatenate(below, axis=1)
    lone = (a0 == b0) & (a1 == b1) & (a1 - a0 == 1)
    return pairs[:, (a1 > a0) & (b1 > b0) & (err <= budget) & ~lone]


def _connected(root: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """Pairs of nodes whose leaves are all in one component already."""
    a0, a1, b0, b1, _ = pairs
    change = np.concatenate([[0], np.cumsum(root[1:] != root[:-1])])
    return (change[a0] == change[a1 - 1]) & (change[b0] == change[b1 - 1]) & (root[a0] == root[b0])


def _link(values: np.ndarray, a: np.ndarray, b: np.ndarray, forest: _Forest, budget: int) -> None:
    hit = (np.bitwise_count(values[a] ^ values[b]) <= budget) & (forest.root[a] != forest.root[b])
    forest.connect(a[hit], b[hit])


def _compare(values: np.ndarray, pairs: np.ndarray, forest: _Forest, budget: int) -> None:
    """Compare the leaves of small pairs of nodes."""
    for at in range(0, pairs.shape[1], _CHUNK // 4):
        a0, a1, b0, b1, _ = pairs[:, at : at + _CHUNK // 4]
        size = (a1 - a0) * (b1 - b0)
        which = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)
        width = (b1 - b0)[which]
        a = a0[which] + place // width
        b = b0[which] + place % width
        _link(values, a[a < b], b[a < b], forest, budget)


def dealt_groups(rows: DataFrame, keys: list[str], chunk_rows: int) -> DataFrame:
    """``rows`` (with ``fp``) dealt out and sorted by group, with the chunks ``low`` and ``high`` of large groups.

    A group of at most ``chunk_rows`` rows has the pair (0, 0).  In a larger one each row
    goes to every pair that its chunk is part of, so any two rows meet in some pair.
    """
    sizes = rows.groupBy(*keys).agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks")).where("chunks > 1")
    hot = broadcast_if_small(written(sizes, "hot-groups"), HOT_KEYS)
    chunks = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("chunks") - 1), lambda j: (j != own) | (F.col("chunks") == 1))
    pairs = F.transform(others, lambda j: F.struct(F.least(own, j).alias("low"), F.greatest(own, j).alias("high")))
    dealt = rows.join(hot, keys, "left").withColumn("chunks", chunks).select(*rows.columns, F.explode(pairs).alias("pair"))
    dealt = dealt.select(*rows.columns, "pair.low", "pair.high")
    return dealt.repartition(*keys, "low", "high").sortWithinPartitions(*keys, "low", "high")


_COMBO_KEYS = ["combo", "block"]


def _group_links(batches):
    for frame in whole_groups(batches, [*_COMBO_KEYS, "low", "high"]):
        values = frame["fp"].to_numpy(np.int64).view(np.uint64)
        keys = frame[[*_COMBO_KEYS, "low", "high"]].to_numpy(np.int64)
        starts = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)]))
        order = np.lexsort([values, np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(values))))])
        values = values[order]
        a, b = trie_links(values, starts)
        signed = values.view(np.int64)
        yield pd.DataFrame({"a": signed[a], "b": signed[b]})


def fingerprint_links(prints: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Links (a, b) that connect the distinct fingerprints ``fp`` within the budget."""
    blocks = [F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1)) for low, width in _BLOCKS]
    keyed = [
        F.struct(F.lit(k).alias("combo"), (blocks[i] * F.lit(1 << 13) + blocks[j]).alias("block"))
        for k, (i, j) in enumerate(combinations(range(len(blocks)), 2))
    ]
    rows = prints.select("fp", F.explode(F.array(*keyed)).alias("g")).select("fp", "g.combo", "g.block")
    groups = dealt_groups(rows, _COMBO_KEYS, chunk_rows)
    return groups.mapInPandas(_group_links, "a bigint, b bigint").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, root): for each node of ``links`` (a, b) the smallest node reachable.

    Nodes point to the smallest neighbour, larger neighbours first, then smaller ones, until
    nothing moves; a chain of any length shortens fast.  Each round is written, which cuts
    the lineage.  A node with many links only takes part in joins against one row per node.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    edges = written(links.where("a <> b").select(high.alias("u"), low.alias("v")).distinct(), "links")
    while True:
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        following = written(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        if following.exceptAll(edges).isEmpty() and edges.exceptAll(following).isEmpty():
            break
        edges = following
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return nodes.union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs`` (doc_id, text)."""
    prints = docs.select(F.col("doc_id"), fingerprints(F.col("text"), width).alias("fp"))
    prints = written(prints, "fingerprints")
    classes = written(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "classes")
    return _named(prints, classes, fingerprint_links(classes.select("fp"), chunk_rows))


def _named(prints: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """Each row of ``prints`` (doc_id, fp) with the smallest doc_id of its component."""
    roots = components(links).withColumnRenamed("node", "fp")
    placed = classes.join(roots, "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_print = placed.join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def first_of_each_group(docs: DataFrame, width: int = 3, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """The rows of ``docs`` with the smallest doc_id of each group of near duplicates, all columns kept.

    Repeated rows of one doc_id leave one; rows without doc_id can't be told apart and stay.
    """
    found = near_duplicates(docs, width, chunk_rows)
    first = found.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.where(F.col("doc_id").isNotNull()).join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.union(docs.where(F.col("doc_id").isNull()))
