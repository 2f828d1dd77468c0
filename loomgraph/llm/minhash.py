"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard checks.

Signatures. Every shingle has a place in a universe of 2^22 by a first permutation
(of the 64-bit hashes, truncated); coordinate k of a document is the smallest value that a
second permutation, shifted circularly by k, gives its shingles. The second is a
table, so a shingle's values for all coordinates are one slice of it. Bands of
`ROWS` coordinates give bucket keys; there are as many bands as make the chance to
miss a pair at the threshold less than 1e-7.

Candidates. Documents with equal sets are one class from the start; classes that
share a bucket are candidates.

Verification is on full shingle sets, in two steps, and never makes all pairs of a
group. (1) Stars: in a bucket each class is compared with one of them, the hub.
Components of the pairs that hold give labels; mere candidates never join anything.
Buckets whose classes still have different labels get another hub, for the classes
of other labels than its own, `ROUNDS` times in all. (2) What is left: in buckets that
are mixed even then, an inverted index over each set's rarest shingles (a prefix long
enough to meet any partner) finds the pairs with different labels, and exact
intersections confirm them. A bucket of more than `BLOCK_SETS` classes is first cut up
by those rare shingles, so that classes which share no more than a common passage do
not meet; should a shingle that is rare for its sets still be in more, its classes are
compared block by block. So all that shares a bucket is compared or already joined,
and links are at most one for each class and step.

Labels spread by joins, and nothing but counts comes to the driver.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomgraph.llm import vectext
from loomgraph.llm.common import Scratch, giving_back, lookup

ROWS, MISS = 5, 1e-7
UNIVERSE = 1 << 22
#: Sets that are compared in one task, and shingles in them.
BLOCK_SETS, BLOCK_SHINGLES = 4096, 2_000_000
#: Classes that are compared with one hub in a task.
STAR = 256
#: Rounds of stars: the first settles nearly all that stars can.
ROUNDS = 1
_table: dict[int, np.ndarray] = {}


def bands_for(threshold: float) -> int:
    return math.ceil(math.log(MISS) / math.log(1 - threshold**ROWS))


def _windows(k: int) -> np.ndarray:
    if k not in _table:
        second = np.random.default_rng(11).permutation(UNIVERSE).astype(np.uint32)
        _table[k] = np.lib.stride_tricks.sliding_window_view(np.concatenate([second, second[:k]]), k)
    return _table[k]


def signature(shingles: np.ndarray, k: int) -> np.ndarray:
    at = (vectext.mix64(shingles + np.uint64(0x51ED270B7F4A7C15)) >> np.uint64(42)).astype(np.int64)
    out = np.full(k, UNIVERSE, np.uint32)
    for i in range(0, len(at), 4096):
        out = np.minimum(out, _windows(k)[at[i : i + 4096]].min(axis=0))
    return out


def _signer(width: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            data, offsets = vectext.packed(batch.column("text"))
            sizes, keys, buckets = [], [], []
            for a, b in vectext.blocks(offsets):
                words, bounds = vectext.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                for found in vectext.shingle_sets(words, bounds, width):
                    sizes.append(len(found))
                    if not len(found):
                        keys.append(None)
                        buckets.append(None)
                        continue
                    keys.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                    rows = signature(found, ROWS * bands).reshape(bands, ROWS).astype(np.uint64)
                    buckets.append(vectext.combine([salt, *rows.T]).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))],
                ["doc_id", "text_key", "n_shingles", "set_key", "buckets"],
            )

    return run


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """node, label (the component's smallest node) of each node of edges(u, v).

    In each round every node with a smaller neighbour hooks to the smallest, hooks are
    followed to their ends, and only the edges between different ends remain, each
    once; so the work shrinks from round to round. Every step is a written table.
    """
    ends = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    left = scratch.table(ends, f"{name}-left-0")
    out = left.toDF("node", "label").where("false")
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        i = len(rounds)
        hooks = scratch.table(left.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("label")), f"{name}-hooks-{i}-0")
        moving, j = True, 0
        while moving:  # each step doubles how far a hook reaches
            j += 1
            far = hooks.select(F.col("node").alias("label"), F.col("label").alias("far"))
            step = hooks.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label"), F.col("far").isNotNull().alias("moved"))
            step = scratch.table(step, f"{name}-hooks-{i}-{j}")
            moving, hooks = not step.where("moved").isEmpty(), step.drop("moved")
        rounds.append(hooks)
        tops = hooks.select(F.col("node").alias("u"), F.col("label").alias("a")), hooks.select(F.col("node").alias("v"), F.col("label").alias("b"))
        across = left.join(tops[0], "u").join(tops[1], "v", "left").select("a", F.coalesce("b", "v").alias("b")).where("a <> b")
        left = scratch.table(across.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-left-{i + 1}")
    for hooks in reversed(rounds):  # a node hooks once; what it hooked to may have hooked later
        far = out.select(F.col("node").alias("label"), F.col("label").alias("far"))
        out = hooks.join(far, "label", "left").select("node", F.coalesce("far", "label").alias("label")).union(out)
    out = scratch.table(out, f"{name}-hooked")
    return scratch.table(out.union(out.select("label", "label").distinct()), f"{name}-labels")


def similar(x: np.ndarray, y: np.ndarray, threshold: int) -> bool:
    """Whether 100 * intersection >= threshold * union, of two sorted sets."""
    if 100 * min(len(x), len(y)) < threshold * max(len(x), len(y)):
        return False
    common = int(np.count_nonzero(y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x))
    return 100 * common >= threshold * (len(x) + len(y) - common)


def linked(sets: list[np.ndarray], threshold: int, side: list[int] | None = None, labels: list[int] | None = None) -> list[tuple[int, int]]:
    """Pairs of sets with 100 * intersection >= threshold * union that join all
    that any such pairs join: a spanning forest, at most one pair for each set.
    side: only pairs from different sides count. labels: sets with equal labels are
    joined from the start."""
    n = len(sets)
    first: dict[int, int] = {}
    parent = [first.setdefault(label, i) for i, label in enumerate(labels)] if labels else list(range(n))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    flat, ids = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(ids, minlength=len(flat))
    rank = np.empty(len(flat), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(flat))
    ends = np.cumsum([len(s) for s in sets])
    ranked = [np.sort(rank[ids[e - len(s) : e]]) for s, e in zip(sets, ends, strict=True)]
    once = np.sort(often, kind="stable") == 1  # by rank
    index: dict[int, list[int]] = defaultdict(list)
    mark = np.zeros(len(flat), bool)
    links = []
    for y in sorted(range(n), key=lambda i: (len(sets[i]), i)):
        size = len(sets[y])
        prefix = ranked[y][: prefix_length(size, threshold)]
        prefix = prefix[~once[prefix]].tolist()
        near = set().union(*[index[t] for t in prefix])
        if near:
            mark[ranked[y]] = True
            tried = root(y)
            for x in sorted(near, reverse=True):
                other = len(sets[x])
                if 100 * other < threshold * size or (side is not None and side[x] == side[y]) or root(x) == tried:
                    continue
                common = int(np.count_nonzero(mark[ranked[x]]))
                if 100 * common >= threshold * (size + other - common):
                    parent[root(x)] = tried
                    tried = root(y)
                    links.append((x, y))
            mark[ranked[y]] = False
        for t in prefix:
            index[t].append(y)
    return links


def prefix_length(size: int, threshold: int) -> int:
    """How many of a set's shingles, in one order of all, have one in common with every
    similar set's."""
    return size + threshold * -size // 100 + 1


LINKS = "u long, v long"


def _pairs(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else ([], []))], ["u", "v"])


def _starring(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by hub and part, the hub's own set first."""
        hub, own = None, None
        for batch in batches:
            found = []
            for at, kind, cid, raw in zip(*(batch.column(c).to_pylist() for c in ("hub", "kind", "cid", "shingles")), strict=True):
                if kind == 0:
                    hub, own = at, np.frombuffer(raw, np.uint64)
                elif at == hub and similar(np.frombuffer(raw, np.uint64), own, threshold):
                    found.append((cid, hub))
            yield _pairs(found)

    return run


def _verifier(threshold: int):
    def links_of(rows: list[tuple]) -> list[tuple[int, int]]:
        if len(rows) < 2:
            return []
        sets = [np.frombuffer(r[5], np.uint64) for r in rows]
        side = [r[4] for r in rows] if rows[0][2] != rows[0][3] else None
        return [(rows[x][6], rows[y][6]) for x, y in linked(sets, threshold, side, [r[7] for r in rows])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group (bucket, shingle), block i, block j."""
        group: list[tuple] = []
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("bucket", "shingle", "i", "j", "block", "shingles", "cid", "label")), strict=True):
                if group and row[:4] != group[0][:4]:
                    found += links_of(group)
                    group = []
                group.append(row)
            yield _pairs(found)
        yield _pairs(links_of(group))

    return run


def _exploding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, cid, label, size and each of a set's shingles."""
    for batch in batches:
        for i, raw in enumerate(batch.column("shingles")):
            own = np.frombuffer(raw.as_buffer(), np.int64)
            at = pa.array(np.full(len(own), i), pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c).take(at) for c in ("bucket", "cid", "label")], pa.array(np.full(len(own), len(own)), pa.int64()), pa.array(own)], ["bucket", "cid", "label", "size", "shingle"])


def _setter(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Full sets of the texts; a row whose text is not that of its class (an id
        that several rows carry) is left out."""
        for batch in batches:
            data, offsets = vectext.packed(batch.column("text"))
            cids, want = batch.column("cid"), batch.column("set_key").to_pylist()
            for a, b in vectext.blocks(offsets):
                words, bounds = vectext.word_hashes(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                sets = [s.tobytes() for s in vectext.shingle_sets(words, bounds, width)]
                keep = [i for i, s in enumerate(sets) if hashlib.blake2b(s, digest_size=16).digest() == want[a + i]]
                yield pa.RecordBatch.from_arrays([cids.take(pa.array([a + i for i in keep], pa.int64())), pa.array([sets[i] for i in keep], pa.binary())], ["cid", "shingles"])

    return run


def near_groups(docs: DataFrame, width: int = 3, threshold: int = 85) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z) runs between ASCII white space; a document's set is
    its distinct runs of `width` words, of fewer words the whole. Documents with
    100 * |intersection| >= threshold * |union| are linked; component_id is the
    smallest doc_id reachable. Null, empty and blank texts have no set and stand
    alone. Equal sets are linked, so repeated rows fall together. A null doc_id
    stands alone unless its set is shared. Very long texts count whole, a set at a
    time. Extra columns are ignored; no rows in, no rows out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit(None).cast("binary").alias("text_key"))
    return _grouped(rows, width, threshold).select("doc_id", "n_shingles", "component_id", "kept")


def _full_sets(rows: DataFrame, classes: DataFrame, held: DataFrame, width: int) -> DataFrame:
    """cid, shingles of the classes that share a bucket, from the texts. These classes
    grow with the input, so they are dealt, never broadcast."""
    active = classes.select("cid", "doc_id", "set_key").join(held.select("cid").distinct(), "cid", "left_semi")
    same_id = F.col("d.doc_id").eqNullSafe(F.col("a.doc_id"))
    texts = rows.alias("d").join(active.alias("a").hint("merge"), same_id).select("cid", "set_key", "text")
    return texts.mapInArrow(giving_back(_setter(width)), "cid long, shingles binary").dropDuplicates(["cid"])


def _stars(held: DataFrame, sets: DataFrame, threshold: int, turn: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Of classes in buckets (bucket, cid, label): those of buckets with several labels,
    and u, v of the pairs (class, hub) that hold. The hub is the class of least hash by
    `turn`; its set goes to as many tasks as its classes fill."""
    hubs = held.groupBy("bucket").agg(F.min_by(F.struct("cid", "label"), F.xxhash64("cid", F.lit(turn))).alias("hub"), F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b")
    hubs = scratch.table(hubs.select("bucket", "hub", "n"), f"hubs-{turn}")
    held = scratch.table(lookup(held, hubs, "bucket", "n", ["cid"]).where("n is not null").select("bucket", "cid", "label", "hub"), f"mixed-{turn}")
    ties = scratch.table(held.where("label <> hub.label").select("cid", F.col("hub.cid").alias("hub")).distinct(), f"ties-{turn}")
    shares = scratch.table(ties.groupBy("hub").agg(F.count(F.lit(1)).alias("members")), f"shares-{turn}")
    parts = F.ceil(F.col("members") / STAR).cast("int")
    members = lookup(ties, shares, "hub", "members", ["cid"]).select("hub", "cid", F.pmod(F.xxhash64("cid"), parts).cast("int").alias("part"), F.lit(1).alias("kind"))
    own = shares.select("hub", F.col("hub").alias("cid"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.lit(0).alias("kind"))
    both = members.unionByName(own).join(sets, "cid")
    both = both.repartition("hub", "part").sortWithinPartitions("hub", "part", "kind", "cid")
    return held, scratch.table(both.mapInArrow(giving_back(_starring(threshold)), LINKS), f"stars-{turn}")


def _rest(held: DataFrame, sets: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """u, v that join what similar pairs of different labels in one bucket join."""
    same = [F.sum(F.xxhash64("cid", F.lit(k)).cast("decimal(20,0)")).alias(f"h{k}") for k in (1, 2)]
    mixed = held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b"), *same).where("a <> b")
    # the two classes of a bucket have met; buckets of the same classes are compared once
    mixed = mixed.where("n > 2")
    mixed = scratch.table(mixed.groupBy("n", "a", "b", "h1", "h2").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "mixed")
    left = lookup(held, mixed, "bucket", "n", ["cid"]).where("n is not null").drop("__j")
    left = scratch.table(left, "left")
    none = F.lit(None).cast("long")
    groups = left.where(F.col("n") <= BLOCK_SETS).select("bucket", none.alias("shingle"), "cid", "label")
    large = left.where(F.col("n") > BLOCK_SETS)
    if not large.isEmpty():
        groups = groups.unionByName(_cut_up(large, sets, threshold, scratch))
    groups = scratch.table(groups, "groups")
    key = F.concat(F.hex("bucket"), F.lit(":"), F.coalesce(F.hex("shingle"), F.lit("")))
    sized = groups.join(sets.select("cid", (F.octet_length("shingles") / 8).alias("size")), "cid").withColumn("group", key)
    shares = sized.groupBy("group").agg(F.count(F.lit(1)).alias("members"), F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_SETS, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    sized = lookup(sized, scratch.table(shares, "shares"), "group", "members", ["cid"]).withColumn("block", F.pmod(F.xxhash64("cid"), "parts").cast("int"))
    pairs = sized.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pairs = pairs.select("bucket", "shingle", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "cid", "label").join(sets, "cid")
    pairs = pairs.repartition("bucket", "shingle", "i", "j").sortWithinPartitions("bucket", "shingle", "i", "j", "cid")
    return pairs.mapInArrow(giving_back(_verifier(threshold)), LINKS)


def _cut_up(large: DataFrame, sets: DataFrame, threshold: int, scratch: Scratch) -> DataFrame:
    """Classes (bucket, cid, label) of large buckets by the shingles of their prefixes,
    the rarest of the bucket first: bucket, shingle, cid, label. Similar ones meet under
    one of them; a shingle that one label alone has is left out."""
    each = large.select("bucket", "cid", "label").join(sets, "cid").mapInArrow(giving_back(_exploding), "bucket long, cid long, label long, size long, shingle long")
    each = scratch.table(each.withColumn("key", F.concat(F.hex("bucket"), F.lit(":"), F.hex("shingle"))), "each")
    often = scratch.table(each.groupBy("key").agg(F.count(F.lit(1)).alias("often")), "often")
    each = lookup(each, often, "key", "often", ["cid"])
    order = Window.partitionBy("bucket", "cid").orderBy("often", "shingle")
    room = F.col("size") - F.ceil(F.col("size") * threshold / 100) + 1
    each = each.withColumn("place", F.row_number().over(order)).where((F.col("place") <= room) & (F.col("often") > 1))
    each = scratch.table(each.select("key", "bucket", "shingle", "cid", "label"), "prefixes")
    mixed = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("a"), F.max("label").alias("b")).where("a <> b").select("key", "n")
    return lookup(each, scratch.table(mixed, "several"), "key", "n", ["cid"]).where("n is not null").select("bucket", "shingle", "cid", "label")


def _grouped(rows: DataFrame, width: int, threshold: int) -> DataFrame:
    """near_groups of rows with a text_key, and that key; lead has the smallest id of a
    group (none comes last) and the smallest text_key that goes with it."""
    bands = bands_for(threshold / 100)
    scratch = Scratch(rows.sparkSession, "minhash")
    signs = scratch.table(rows.mapInArrow(giving_back(_signer(width, bands)), "doc_id long, text_key binary, n_shingles long, set_key binary, buckets array<long>"), "signs")

    classes = signs.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("size"), F.first("n_shingles").alias("n"), F.first("buckets").alias("buckets"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")).alias("lead"))
    classes = scratch.table(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")
    held = classes.select("cid", F.explode("buckets").alias("bucket"))
    shared = scratch.table(held.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")
    held = scratch.table(lookup(held, shared, "bucket", "n", ["cid"]).where("n is not null").select("bucket", "cid", F.col("cid").alias("label")), "held")
    sets = scratch.table(_full_sets(rows, classes, held, width), "sets")
    links: DataFrame = sets.select(F.col("cid").alias("u"), F.col("cid").alias("v")).where("false")
    for i in range(ROUNDS):
        held, stars = _stars(held, sets, threshold, i, scratch)
        links = links.union(stars)
        joined = components(links, scratch, f"stars-{i}")
        held = held.select("bucket", "cid").join(joined.withColumnRenamed("node", "cid"), "cid", "left").select("bucket", "cid", F.coalesce("label", "cid").alias("label"))
        held = scratch.table(held, f"labelled-{i}")
    rest = scratch.table(_rest(held, sets, threshold, scratch), "rest")
    joined = joined if rest.isEmpty() else components(links.union(rest), scratch, "links")

    named = classes.select("cid", "set_key", "doc_id", "size", "lead").join(joined.withColumnRenamed("node", "cid"), "cid", "left").withColumn("label", F.coalesce("label", "cid"))
    first = named.groupBy("label").agg(F.min("doc_id").alias("component_id"), F.sum("size").alias("total"), F.min("lead").alias("lead"))
    first = scratch.table(first.where("total > 1"), "first")
    named = lookup(named.select("cid", "set_key", "size", "label"), first, "label", "total", ["cid"]).where("total is not null")
    named = scratch.table(named.select("set_key", "size", "component_id", "lead"), "named")
    out = lookup(signs.select("doc_id", "text_key", "n_shingles", "set_key"), named, "set_key", "size", ["doc_id"])
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "lead")


def keep_first(docs: DataFrame, width: int = 5, threshold: int = 80) -> DataFrame:
    """docs without all but the smallest doc_id of each near-duplicate group. Ids may
    repeat or be null: rows go by id and text, a null id comes after all others, and of
    several texts with the smallest id one stays. Rows equal in both stay together."""
    key = F.unhex(F.sha2(F.col("text").cast("binary"), 256))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", key.alias("text_key"))
    first = F.col("doc_id").eqNullSafe(F.col("lead.doc_id")) & (F.col("text_key") == F.col("lead.text_key"))
    dropped = _grouped(rows, width, threshold).where(F.col("lead").isNotNull() & ~first).select(F.col("doc_id").alias("__gone"), F.col("text_key").alias("__text")).distinct()
    # as many as the input has near copies: dealt at every size, never broadcast
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("__gone")) & (F.unhex(F.sha2(docs["text"].cast("binary"), 256)) == F.col("__text"))
    return docs.join(dropped.hint("merge"), same, "left_anti")
