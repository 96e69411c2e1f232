"""A Merkle manifest of a dataset and proofs for every row, found by pointer jumping.

Rows are leaves of a tree per source; the roots of the sources are leaves of one more tree. A proof is a path of
segments, one per level: the digests before and after the own one in its run. Everything is DataFrame operations.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stash

ARITY = 16
DIGITS = 64  # of a digest
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# Rows that one sorting task should hold.
SLICE_ROWS = 100_000
# Nodes that may meet at one ancestor in one task.
MEETING = 256
TOP = -1  # the tree over the sources
# monotonically_increasing_id: the partition is above this bit, the row in it below
_SPOT_BITS = 33
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def record(**changed: Column) -> Column:
    """The text that a row's leaf hashes: each field as byte count, colon and value, ``-`` if null."""

    def part(name: str) -> Column:
        value = changed.get(name, F.col(name)).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.concat(*map(part, FIELDS))


def digest(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that follows from a leaf and its path."""
    return F.aggregate(path, leaf, lambda own, s: digest(F.concat(s["before"], own, s["after"])))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, left to right."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def _positions(rows: DataFrame, group: str, order: list[str], total: int, kind: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` sorted by group and ``order`` with their ``spot``, and the spans (group, part, first, earlier, members).

    The rows are sorted once, in ranges, whatever share one group has; a row's place in its group is its spot
    less the ``first`` of its span, plus ``earlier``.
    """
    keys = [group, *order]
    ranges = max(1, -(-total // SLICE_ROWS))
    sorted_rows = rows.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys).withColumn("spot", F.monotonically_increasing_id())
    placed = stash(sorted_rows.withColumn("part", F.shiftright("spot", _SPOT_BITS)), kind)
    spans = placed.groupBy(group, "part").agg(F.min("spot").alias("first"), F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy(group)
    upto = F.sum("n").over(whole.orderBy("part"))
    return placed, spans.select(group, "part", "first", (upto - F.col("n")).alias("earlier"), F.sum("n").over(whole).alias("members"))


def _place() -> Column:
    return F.col("spot") - F.col("first") + F.col("earlier")


def _key(tree, level, pos) -> Column:
    return F.struct(tree.cast("bigint").alias("tree"), level.cast("int").alias("level"), pos.cast("bigint").alias("pos"))


def _levels(nodes: DataFrame, members: int) -> list[DataFrame]:
    """The inner levels over ``nodes`` (tree, pos, members, height, digest), each a written table. Runs of ``ARITY``
    nodes are all a group ever holds, so a large tree is no large group."""
    found, level = [], 0
    while members > 1:
        level += 1
        run = F.struct((F.col("pos") % ARITY).alias("slot"), "digest")
        above = nodes.filter("members > 1").groupBy("tree", F.expr(f"pos div {ARITY}").alias("pos")).agg(
            F.array_sort(F.collect_list(run)).alias("run"), F.max("members").alias("below"), (F.max("height") + 1).alias("height")
        )
        above = above.select("tree", "pos", F.array_join("run.digest", "").alias("kids"), F.expr(f"(below + {ARITY - 1}) div {ARITY}").alias("members"), "height")
        nodes = stash(above.withColumn("digest", digest(F.col("kids"))).withColumn("level", F.lit(level)), "level")
        found.append(nodes)
        members = -(-members // ARITY)
    return found


@dataclass
class Manifest:
    """``leaves``: the rows of the dataset with leaf, tree, pos, members and the other columns given; ``nodes``: the inner
    nodes with their digests and those of their ``kids``; ``sources``: a subroot per tree; ``root``."""

    leaves: DataFrame
    nodes: DataFrame
    sources: DataFrame
    root: str | None
    trees: int
    inner: int


def build(docs: DataFrame, **extra: Column) -> Manifest:
    """The manifest of ``docs``; ``extra`` are columns to carry along with the leaves, worked out in the same scan.

    Leaves of a source ascend by id, nulls first; rows that share an id ascend by leaf. Null sources are one source,
    the first.
    """
    source = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))  # '' sorts before all others
    plain = docs.select(*FIELDS)
    leaves = plain.select(F.col("doc_id").cast("bigint").alias("doc_id"), source.alias("stratum"), digest(record()).alias("leaf"), *[c.alias(n) for n, c in extra.items()])
    # equal rows are interchangeable, but need not meet in one range
    leaves = stash(leaves.withColumn("tie", F.monotonically_increasing_id()), "leaves")
    total = leaves.count()
    placed, spans = _positions(leaves, "stratum", ["doc_id", "leaf", "tie"], total, "placed")
    strata = stash(spans.groupBy("stratum").agg(F.max("members").alias("members")).withColumn("all", F.lit(0)), "strata")
    trees, most = strata.agg(F.count(F.lit(1)), F.max("members")).first()
    ordered, ends = _positions(strata.select("all", "stratum"), "all", ["stratum"], trees, "sources")
    numbered = ordered.join(ends, ["all", "part"]).select("stratum", _place().alias("tree"))
    spans = spans.join(numbered, "stratum")
    carried = ["doc_id", "leaf", *extra]
    leaves = stash(placed.join(spans, ["stratum", "part"]).select(*carried, "tree", _place().alias("pos"), "members"), "ranked")

    base = leaves.select("tree", "pos", "members", F.lit(0).alias("height"), F.col("leaf").alias("digest"))
    levels = _levels(base, most or 0)
    tops = base.filter("members = 1")
    for level in levels:
        tops = tops.unionByName(level.filter("members = 1").select(*tops.columns))
    tops = stash(tops.select(F.lit(TOP).cast("bigint").alias("tree"), F.col("tree").alias("pos"), F.lit(trees).cast("bigint").alias("members"), "height", "digest"), "subroots")
    above = _levels(tops, trees)
    columns = ["tree", "level", "pos", "members", "height", "digest", "kids"]
    empty = leaves.select("tree", F.lit(0).alias("level"), "pos", "members", F.lit(0).alias("height"), F.col("leaf").alias("digest"), F.lit("").alias("kids")).limit(0)
    nodes = empty
    for level in [*levels, *above]:
        nodes = nodes.unionByName(level.select(*columns))
    last = (above[-1] if above else tops).select("digest").first()
    inner = sum(level.count() for level in [*levels, *above])
    return Manifest(leaves, nodes, tops.select(F.col("pos").alias("tree"), F.col("digest").alias("subroot")), last and last[0], trees, inner)


def _parent(trees: int) -> tuple[Column, Column]:
    """(key of the parent, slot in its run) of a node with tree, level, pos and members; no parent for the root."""
    inside = F.col("members") > 1
    subroot = (F.col("tree") != TOP) & F.lit(trees > 1)
    key = F.when(inside, _key(F.col("tree"), F.col("level") + 1, F.expr(f"pos div {ARITY}"))).when(subroot, _key(F.lit(TOP), F.lit(1), F.expr(f"tree div {ARITY}")))
    return key, F.when(inside, F.col("pos") % ARITY).otherwise(F.col("tree") % ARITY).cast("int")


def _segment(kids: str, slot: str) -> Column:
    """A run's digests before and after the one in ``slot``."""
    at = F.col(slot) * DIGITS
    return F.struct(F.substr(F.col(kids), F.lit(1), at).alias("before"), F.substr(F.col(kids), at + DIGITS + 1).alias("after"))


def proofs(manifest: Manifest) -> DataFrame:
    """The leaves with ``subroot`` and ``path``, the segments from the leaf's own run up to the root.

    Inner nodes start with the segment towards their parent. Each round joins them with the node they point at, appends
    its segments and takes over its pointer, so that the distance doubles; leaves take the last jump, to a parent that has
    reached the root. Rounds are written tables. Many nodes point at one ancestor, so pointers are salted and the few
    ancestors repeated.
    """
    parent, slot = _parent(manifest.trees)
    key = _key(F.col("tree"), F.col("level"), F.col("pos"))
    nodes = manifest.nodes.select(key.alias("key"), parent.alias("anc"), slot.alias("slot"), "height", "kids")
    runs = nodes.select(F.col("key").alias("anc"), F.col("kids").alias("run"))
    none = F.array().cast("array<struct<before:string,after:string>>")
    path = F.when(F.col("run").isNotNull(), F.array(_segment("run", "slot"))).otherwise(none)
    # the pointer table keeps what jumps need; the kids stay where they are
    paths = stash(nodes.drop("kids").join(runs, "anc", "left").select("key", "anc", "height", path.alias("path")), "jump")
    distance = 1
    while not paths.filter("anc is not null").isEmpty():
        # an ancestor at this distance from an inner node is higher than that
        salts = max(1, min(ARITY ** min(distance, 12), manifest.inner) // MEETING)
        salt = F.pmod(F.xxhash64("key"), F.lit(salts))
        upper = paths.filter(F.col("height") > distance).select(
            F.col("key").alias("anc"), F.col("anc").alias("next"), F.col("path").alias("upper"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(salts - 1).cast("bigint"))).alias("salt")
        )
        going = paths.filter("anc is not null").withColumn("salt", salt).join(upper, ["anc", "salt"])
        going = going.select("key", F.col("next").alias("anc"), "height", F.concat("path", "upper").alias("path"))
        paths = stash(going.unionByName(paths.filter("anc is null")), "jump")
        distance *= 2

    ends = manifest.nodes.select(key.alias("anc"), "tree", "kids").join(paths.select(F.col("key").alias("anc"), F.col("path").alias("upper")), "anc")
    ends = ends.join(manifest.sources, "tree", "left").select("anc", "kids", "upper", F.col("subroot").alias("of_source"))
    leaves = manifest.leaves.withColumn("level", F.lit(0)).withColumn("anc", parent).withColumn("slot", slot)
    whole = F.when(F.col("kids").isNotNull(), F.concat(F.array(_segment("kids", "slot")), F.col("upper"))).otherwise(none)
    joined = leaves.join(ends, "anc", "left")
    return joined.select(*manifest.leaves.columns, F.when(F.col("members") > 1, F.col("of_source")).otherwise(F.col("leaf")).alias("subroot"), whole.alias("path"))


def audit(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (the digest of its siblings), and
    ``folded_root`` and ``verified``, which tell whether the row as claimed still folds to the root. Claimed rows are the
    rows themselves, but for those whose id, as text, has a checksum that 5 divides: their text is lower-cased (A-Z).

    Defined cases: null values hash as ``-``; an empty text is a text of no bytes; null ids come first and are never
    changed; repeated rows are leaves of their own; a single row is its own leaf, subroot and root, with an empty
    proof; an empty table gives no row. Other columns are not read, so their names cannot clash.
    """
    chosen = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    claim = F.when(chosen, digest(record(text=F.translate("text", _UPPER, _LOWER))))
    manifest = build(docs, claim=claim)
    root = F.lit(manifest.root).cast("string")
    folded = fold(F.coalesce("claim", "leaf"), F.col("path"))
    found = proofs(manifest).select("doc_id", "leaf", "subroot", root.alias("root"), digest(siblings(F.col("path"))).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
