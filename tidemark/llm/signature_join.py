"""Jaccard self-join of word-shingle sets with signature trees, and its connected components.

Equal sets are one class, so copies never meet in pairs. The top of the forest deals classes to trees by
keys of three smallest tokens under random orders; two classes that share no key of any band can't
have the overlap that the threshold asks for, save with a probability below ``shingles.MISS`` a pair.
Each tree's leaves are a class's size and token bitmap; an inner node has the OR of the bitmaps below,
the range of sizes, and the largest excess of a size over its bitmap's ones. Two nodes' sets can share
no more tokens than their bitmaps share ones, plus the smaller excess, and no more than the smaller
size: a dual traversal drops a node pair whose bound is below what its smallest sizes need. What is
left is compared exactly, whole text against whole text.

Only connectivity is asked for, so the forest is walked twice. The first walk, over few bands, emits
just enough of the surviving pairs to connect what may be connected: no more than one for each class
and tree. Links among these are contracted; the second walk takes all bands, but only trees that still
hold several components, and emits every surviving pair between different components. Trees larger
than ``block_rows`` are cut in blocks: the first walk adds a common member to each block, the second
visits every pair of blocks.

Bitmaps and whole texts move only for classes that share a tree with another: a Bloom filter of bounded
size, built by an aggregate, keeps the others at the scan.

Defined results: an empty or null text has no shingles and is a component of its own, as is a text
without words; equal texts are linked, repeated ids count as one document; a null id has the smallest id of its
component, or null where there is none. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shingles import BandKeys, bitmap, bitmap_width, linked, set_digest, shingle_set
from .store import lean, small_batches, written

MAX_BLOOM_BITS = 1 << 25
FAN_OUT = 8


class Node:
    """A leaf has one member; an inner node has children, the OR of their bitmaps and their ranges."""

    __slots__ = ("bits", "children", "component", "excess", "high", "low", "member")

    def __init__(self, children: list[Node] | None = None, member=None, size: int = 0, bits: int = 0, component=None):
        self.children, self.member = children, member
        if children is None:
            self.bits, self.low, self.high, self.excess, self.component = bits, size, size, size - bits.bit_count(), component
            return
        self.bits = 0
        for c in children:
            self.bits |= c.bits
        self.low, self.high = min(c.low for c in children), max(c.high for c in children)
        self.excess = max(c.excess for c in children)
        own = {c.component for c in children}
        self.component = own.pop() if len(own) == 1 else None


def build(leaves: list[Node]) -> Node | None:
    """Leaves in order of component, size and bitmap become neighbours."""
    level = sorted(leaves, key=lambda x: (x.component, x.low, x.bits))
    while len(level) > 1:
        level = [Node(level[i : i + FAN_OUT]) for i in range(0, len(level), FAN_OUT)]
    return level[0] if level else None


def may_link(x: Node, y: Node, percent: int) -> bool:
    """Whether sets below x and y can share as many tokens as their smallest sizes need."""
    needed = -(-percent * (x.low + y.low) // (100 + percent))
    return min(x.high, y.high) >= needed and (x.bits & y.bits).bit_count() + min(x.excess, y.excess) >= needed


def pairs_of(x: Node | None, y: Node | None, percent: int) -> Iterator[tuple]:
    """Members of x and y that may be linked and are of different components; each pair once if x is y."""
    stack = [(x, y)] if x and y else []
    while stack:
        x, y = stack.pop()
        if x.component is not None and x.component == y.component:
            continue
        if x is not y and not may_link(x, y, percent):
            continue
        if x is y:
            if x.children:
                kids = x.children
                stack += [(kids[i], kids[j]) for i in range(len(kids)) for j in range(i + 1, len(kids))]
                stack += [(k, k) for k in kids]
        elif x.children is None and y.children is None:
            yield x.member, y.member
        elif y.children is None or (x.children is not None and len(x.children) >= len(y.children)):
            stack += [(k, y) for k in x.children]
        else:
            stack += [(x, k) for k in y.children]


def group_pairs(members: list[tuple], percent: int) -> Iterator[tuple]:
    """Pairs of members (digest, size, bitmap, component, side); with two sides, only pairs across.

    Linked sizes differ by a factor below 2, and so do their bitmaps' widths: for each width, there are
    trees of the members of that width and of those of twice the width, folded.
    """
    widths: dict[int, list] = {}
    for m in members:
        widths.setdefault(bitmap_width(m[1]), []).append(m)
    for width, own in widths.items():
        leaves = [[Node(member=m[0], size=m[1], bits=int.from_bytes(m[2], "little"), component=m[3]) for m in own if m[4] == s] for s in (0, 1)]
        trees = [build(x) for x in leaves]
        wide = widths.get(2 * width, [])
        fold = lambda b: (b | b >> width) & ((1 << width) - 1)  # noqa: E731, B023
        folded = [build([Node(member=m[0], size=m[1], bits=fold(int.from_bytes(m[2], "little")), component=m[3]) for m in wide if m[4] == s]) for s in (0, 1)]
        if any(m[4] for m in members):
            yield from pairs_of(trees[0], trees[1], percent)
            yield from pairs_of(trees[0], folded[1], percent)
            yield from pairs_of(folded[0], trees[1], percent)
        else:
            yield from pairs_of(trees[0], trees[0], percent)
            yield from pairs_of(trees[0], folded[0], percent)


def spanning(members: list[tuple], percent: int, root: dict) -> Iterator[tuple]:
    """Enough of the pairs to connect all that they connect, beyond what ``root``, a union-find, holds already."""

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = x = root[root[x]]
        return x

    left = len({find(m[0]) for m in members}) - 1
    if left:
        for a, b in group_pairs(members, percent):
            if (ra := find(a)) != (rb := find(b)):
                root[ra] = rb
                left -= 1
                yield a, b
                if not left:
                    return


def _candidates(rows: DataFrame, percent: int, only_spanning: bool) -> DataFrame:
    """Distinct pairs (a, b), a < b, from rows (hub, part, key, digest, n, bits, component, side).

    Copies of one family meet in trees of many bands, and most of these trees have the same smallest
    member, the hub. Trees with the same hub are walked one after the other, so that a pair, or in the
    first walk a connection, comes out once.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, root, tree, at = set(), {}, [], (None, None, None)

        def close() -> None:
            if len(tree) > 1:
                pairs = spanning(tree, percent, root) if only_spanning else group_pairs(tree, percent)
                found.update((a, b) if a < b else (b, a) for a, b in pairs)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.binary()) for i in (0, 1)], ["a", "b"])

        for batch in batches:
            for *place, digest, n, bits, component, side in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if tuple(place) != at:
                    close()
                    if place[:2] != list(at[:2]):
                        root.clear()
                        if len(found) > 20_000:
                            yield out()
                            found.clear()
                    tree, at = [], tuple(place)
                tree.append((digest, n, bits, component, side))
        close()
        yield out()

    names = ("hub", "part", "key")
    dealt = rows.select(*names, "digest", "n", "bits", "component", "side").repartition("hub", "part").sortWithinPartitions(*names)
    return written(dealt.mapInArrow(lean(walk), "a binary, b binary").distinct(), "join-candidates")


def _trees(sketched: DataFrame) -> DataFrame:
    """(band, key, cid) of the keys that several classes have. Only numbers move."""
    keys = sketched.filter("cid is not null").select("cid", "keys").dropDuplicates(["cid"])
    keyed = keys.select("cid", F.posexplode("keys").alias("band", "key"))
    several = keyed.groupBy("key").agg(F.min("cid").alias("_lo"), F.max("cid").alias("_hi")).filter("_lo <> _hi").select("key")
    return written(keyed.join(several, "key"), "join-trees")


def _tree_rows(trees: DataFrame, members: DataFrame, block_rows: int, only_spanning: bool) -> DataFrame:
    """The members of each block of each tree that holds several components."""
    known = members.select("cid", F.xxhash64("component").alias("_component"))
    x = trees.join(known, "cid")
    sizes = x.groupBy("key").agg(F.count("*").alias("_n"), F.min("cid").alias("hub"), F.min("_component").alias("_lo"), F.max("_component").alias("_hi"))
    sizes = sizes.filter("_lo <> _hi").select("key", "hub", F.ceil(F.col("_n") / F.lit(block_rows)).cast("long").alias("_blocks"))
    rows = trees.join(sizes, "key").withColumn("_own", F.pmod(F.xxhash64("cid"), F.col("_blocks")))
    every = F.sequence(F.lit(0).cast("long"), F.col("_blocks") - 1)
    if only_spanning:
        rows = rows.withColumn("part", F.explode(F.when(F.col("cid") == F.col("hub"), every).otherwise(F.array("_own")))).withColumn("side", F.lit(0))
    else:
        rows = rows.withColumn("_other", F.explode(every))
        rows = rows.withColumn("part", F.least("_own", "_other") * F.col("_blocks") + F.greatest("_own", "_other"))
        rows = rows.withColumn("side", (F.col("_own") > F.col("_other")).cast("int"))
    return rows.select("hub", "part", "key", "side", "cid").join(members.select("cid", "digest", "component", "n", "bits"), "cid")


def bloom_filtered(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """The rows whose long ``column`` may be among those of ``wanted`` (one long column): a Bloom filter, built by an
    aggregate, drops most others where they are read. It has 8 to 16 bits for each of wanted, but at most MAX_BLOOM_BITS;
    with more than these are for, it drops fewer."""
    h = wanted.columns[0]
    mask = max(1 << 16, min(MAX_BLOOM_BITS, 1 << (8 * wanted.count()).bit_length())) - 1
    spots = F.array(F.col(h).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(h, 30).bitwiseAND(F.lit(mask)))
    spots = wanted.select(F.explode(spots).alias("spot"))
    words = spots.groupBy(F.shiftright("spot", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 31 as int))")).alias("bits")).toPandas()
    bloom = np.zeros((mask + 1) // 32, np.uint32)
    bloom[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    place = df.columns.index(column)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column(place).to_numpy(zero_copy_only=False).view(np.uint64)
            hit = np.ones(len(h), bool)
            for spot in (h, h >> np.uint64(30)):
                spot = (spot & np.uint64(mask)).astype(np.int64)
                hit &= (bloom[spot >> 5] >> (spot & 31).astype(np.uint32)) & 1 == 1
            if hit.any():
                yield batch.filter(pa.array(hit))

    return df.mapInArrow(lean(keep), df.schema)


def _texts(docs: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(digest, text) of the classes in wanted (digest, h)."""
    x = docs.select(F.xxhash64(docs[text_col]).alias("h"), docs[text_col].alias("text")).filter("text is not null")
    x = bloom_filtered(x, "h", wanted.select("h")).groupBy("h").agg(F.first("text").alias("text"))
    return x.join(wanted, "h").select("digest", "text")


def _verified(texts: DataFrame, pairs: DataFrame, percent: int, fan: int = 256) -> DataFrame:
    """The pairs that are links. A text meets its partners in groups of about ``fan``."""
    salts = pairs.groupBy("a").agg(F.ceil(F.count("*") / F.lit(fan)).cast("long").alias("_salts"))
    hubs = salts.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)).alias("salt"))
    hubs = hubs.join(texts, F.col("a") == F.col("digest")).select("a", "salt", F.lit(None).cast("binary").alias("b"), "text")
    rows = pairs.join(salts, "a").withColumn("salt", F.pmod(F.xxhash64("b"), F.col("_salts")))
    rows = rows.join(texts, F.col("b") == F.col("digest")).select("a", "salt", "b", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, at = None, None
        for batch in batches:
            out = []
            for a, salt, b, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = shingle_set(text)
                if b is None:
                    hub, at = own, (a, salt)
                elif at == (a, salt) and linked(len(hub), len(own), len(np.intersect1d(hub, own, assume_unique=True)), percent):
                    out.append((a, b))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.binary()) for i in (0, 1)], ["a", "b"])

    dealt = hubs.unionByName(rows).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
    return written(dealt.mapInArrow(lean(compare), "a binary, b binary"), "join-links")


def sketches(docs: DataFrame, percent: int, id_col: str, text_col: str) -> DataFrame:
    """(id, h, n, digest, cid, keys, bits) of every row; a text without words has n = 0 and nulls.

    ``cid``, the digest's first eight bytes, stands for a class where only trees are found: should two
    classes share it, both are members and are told apart by digest.
    """
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)])
    for name, kind in (("h", T.LongType()), ("n", T.IntegerType()), ("digest", T.BinaryType()), ("cid", T.LongType()), ("keys", T.ArrayType(T.LongType())), ("bits", T.BinaryType())):
        schema = schema.add(name, kind)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        band_keys = BandKeys(percent / 100)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sets = [shingle_set(t) for t in part.column(2).to_pylist()]
                digests = [set_digest(s) if len(s) else None for s in sets]
                new = [
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(digests, pa.binary()),
                    pa.array([d and int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64()),
                    pa.array([band_keys(s) if len(s) else None for s in sets], pa.list_(pa.int64())),
                    pa.array([bitmap(s) if len(s) else None for s in sets], pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *new], names)

    return docs.select(docs[id_col].alias("id"), F.xxhash64(docs[text_col]).alias("h"), docs[text_col]).mapInArrow(lean(run), schema)


def _components(docs: DataFrame, percent: int, id_col: str, text_col: str, first_bands: int, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """The sketches of all rows, and (digest, component) of the classes that are linked with another."""
    small_batches(docs.sparkSession)
    rows = written(sketches(docs, percent, id_col, text_col), "join-sketches")
    trees = _trees(rows)
    cids = written(trees.select("cid").distinct(), "join-cids")
    members = bloom_filtered(rows.filter("cid is not null").select("cid", "digest", "h", "n", "bits"), "cid", cids).dropDuplicates(["digest"])
    members = written(members.join(cids, "cid"), "join-members")
    texts = written(_texts(docs, text_col, members.select("digest", "h")), "join-texts")

    alone = members.withColumn("component", F.col("digest"))
    pairs = _candidates(_tree_rows(trees.filter(F.col("band") < first_bands), alone, block_rows, True), percent, True)
    stars = connected_components(_verified(texts, pairs, percent))

    grouped = members.join(stars.withColumnRenamed("node", "digest"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))
    pairs = _candidates(_tree_rows(trees, written(grouped, "join-grouped"), block_rows, False), percent, False)
    joined = stars.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(_verified(texts, pairs, percent))
    return rows, connected_components(joined).withColumnRenamed("node", "digest")


def near_duplicates(
    docs: DataFrame,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    first_bands: int = 8,
    block_rows: int = 512,
) -> DataFrame:
    """One row per row of docs: id, n_shingles, component_id."""
    rows, stars = _components(docs, percent, id_col, text_col, first_bands, block_rows)
    classes = rows.filter("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    several = classes.join(stars, "digest")
    least = several.groupBy("component").agg(F.min("rep").alias("component_id"))
    several = several.join(least, "component").select("digest", "component_id")
    named = classes.join(several, "digest", "left").select(F.col("digest").alias("_digest"), F.coalesce("component_id", "rep").alias("component_id"))
    out = rows.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "digest").join(named, F.col("digest") == F.col("_digest"), "left")
    return out.select(id_col, "n_shingles", F.when(F.col("digest").isNull(), F.col(id_col)).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(
    docs: DataFrame,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
    first_bands: int = 8,
    block_rows: int = 512,
) -> DataFrame:
    """The rows of docs without near duplicates: of each component the row with the smallest id, and of equal ids the
    one with the smallest hash of its text.

    Rows, not ids, are grouped, so different texts under one id stay where they aren't linked. A row without id
    stays if its component has none with one. Of rows with equal id and text, which are one document, that with the
    least other columns (as JSON) stays. Rows without words are linked with nothing and all stay.
    """
    rows, stars = _components(docs, percent, id_col, text_col, first_bands, block_rows)
    classes = rows.filter("digest is not null").groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("_none"), "id", "h")).alias("rep"))
    grouped = classes.join(stars, "digest", "left").groupBy(F.coalesce("component", "digest").alias("component")).agg(F.min("rep").alias("rep"))
    names = grouped.select(F.col("rep.id").alias("_rep_id"), F.col("rep.h").alias("_rep_h"))
    worded = F.coalesce(docs[text_col].rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    x = docs.filter(worded).select(F.struct(*docs.columns).alias("_row"), docs[id_col].alias("_id"), F.xxhash64(docs[text_col]).alias("_h"))
    x = x.join(names, x["_id"].eqNullSafe(names["_rep_id"]) & (x["_h"] == names["_rep_h"]), "left_semi")
    others = [F.col("_row")[c].alias(c) for c in docs.columns if c not in (id_col, text_col)]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    one = x.groupBy("_id", "_h").agg(F.min_by("_row", order).alias("_row"))
    return one.select("_row.*").unionByName(docs.filter(~worded))
