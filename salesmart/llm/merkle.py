"""Merkle manifest of a table, with a proof for every row, made by pointer jumping.

Each row is a leaf: the sha256 of its columns, each with its length before it. The leaves of a
group (a language), in the order of doc_id, are the leaves of a binary tree; the groups' subroots,
in the order of the groups, are those of the tree on top. Digests are hashed as hex text and kept
as 32 bytes.

Leaves are numbered by ranges: Spark cuts the sorted rows into ranges of equal size (equal rows
are told apart by a number, so a group of copies is cut as well), rows are numbered within a range,
and the ranges' sizes give where each begins. A tree is built in blocks of ``1 << HEIGHT`` nodes,
each aggregated from its own rows; the blocks' roots are the leaves of the next pass.

Proofs: every node holds the digests of its siblings on the way to an ancestor, its parent at
first. A self-join of the nodes (a node with the node that its ancestor is) doubles the distance
and joins the two segments; the leaves follow the same steps, until all have reached the root.
Only nodes at multiples of a round's distance are needed in it, so from the third join on the side
joined to is a small part of the leaves. Nodes that have reached the root leave the joins, so no
key near the root is hot.

Defined cases: nulls are ``-`` in a leaf, a null or missing group is one of its own before all
others, a null doc_id comes before all others; rows equal in doc_id go by their leaves, fully equal
rows are interchangeable and have a proof each; an empty table gives no rows. Values that are no
text are taken as Spark writes them as text. Columns other than those named are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from salesmart.llm.common import stored

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that are built of one block of rows at once.
HEIGHT = 10
#: Tree numbers: groups are 0, 1, 2, ..; the tree on top; where a node points to that has reached the root.
TOP, DONE = -1, -2
NODE = ("tree", "level", "idx")


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def as_hex(value: Column) -> Column:
    return F.lower(F.hex(value))


def leaf_digest(*columns: Column) -> Column:
    """Of each column its length in bytes, ``:`` and its text; ``-`` if it is null."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return digest(F.concat(*parts))


def height(n: Column) -> Column:
    """Levels above ``n`` leaves until one node remains: the binary digits of n - 1."""
    return F.when(n > 1, F.length(F.bin(n - 1))).otherwise(0).cast("int")


def numbered(rows: DataFrame, group: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """(rows with ``tree``, the number of their group, and ``idx``, their place in it; a table of
    the groups: tree, group, n). No task and no window holds more than a range of the rows."""
    keys = [F.col(group).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("__tie").asc()]
    rows = stored(rows.withColumn("__tie", F.monotonically_increasing_id()), f"{name}-rows")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = stored(rows.repartitionByRange(parts, *keys).withColumn("__part", F.spark_partition_id()), f"{name}-ranges")
    sizes = cut.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__range")).agg(F.count(F.lit(1)).alias("__size"))
    # a group and a range meet in one row; ranges are few and most groups lie in one
    sizes = stored(sizes, f"{name}-sizes")
    before = Window.partitionBy("__group").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("__group")
    starts = sizes.select("__group", "__range", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__start"), F.sum("__size").over(whole).alias("n"))
    # groups are numbered range by range: those that begin in a range, after all that begin before it
    first = sizes.groupBy("__group").agg(F.min("__range").alias("__first"), F.sum("__size").alias("n"))
    begin = first.groupBy(F.col("__first").alias("__range")).agg(F.count(F.lit(1)).alias("__new"))
    begin = begin.select(F.col("__range").alias("__first"), F.coalesce(F.sum("__new").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__seen"))
    within = F.row_number().over(Window.partitionBy("__first").orderBy(F.col("__group").asc_nulls_first())) - 1
    groups = first.withColumn("__at", within).join(begin, "__first").select((F.col("__seen") + F.col("__at")).alias("tree"), F.col("__group").alias(group), "n")
    groups = stored(groups, f"{name}-groups")
    starts = starts.join(groups.select("tree", F.col(group).alias("__own")), F.col("__group").eqNullSafe(F.col("__own"))).select("__group", "__range", "__start", "n", "tree")
    place = F.row_number().over(Window.partitionBy(group, "__part").orderBy(*keys)) - 1
    placed = cut.withColumn("__place", place).join(starts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("__part") == F.col("__range")))
    return placed.withColumn("idx", F.col("__start") + F.col("__place")).drop("__tie", "__part", "__place", "__start", "__group", "__range"), groups


def runs(below: Column) -> Column:
    """The level above: each two digests, the last alone if their number is odd, hashed to one."""
    firsts = F.sequence(F.lit(0), F.size(below) - 1, F.lit(2))
    return F.transform(firsts, lambda i: digest(F.concat(as_hex(F.get(below, i)), F.coalesce(as_hex(F.get(below, i + 1)), F.lit("")))))


def block_levels(nodes: DataFrame, carried: list[str]) -> DataFrame:
    """From ``nodes`` (tree, n, idx, hash, carried columns) one row per block: tree, n (nodes of the
    tree on this level), block, items (the nodes in order), up_0 (their digests), up_1 .. up_HEIGHT (those of the levels above)."""
    item = F.struct("idx", "hash", *carried)
    out = nodes.groupBy("tree", "n", F.shiftright("idx", HEIGHT).alias("block")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    out = out.withColumn("up_0", F.transform("items", lambda x: x["hash"]))
    for k in range(HEIGHT):
        out = out.withColumn(f"up_{k + 1}", F.when(F.lit(k) < height(F.col("n")), runs(F.col(f"up_{k}"))).otherwise(F.array().cast("array<binary>")))
    return out


def pointer(tree: Column, level: Column, idx: Column, top: Column, lone: bool) -> list[Column]:
    """The node above as three columns: where a tree ends, its subroot is a leaf of the tree on top,
    or, if there is one group only, the root."""
    ends = level >= top
    in_top = tree == TOP
    out = F.when(in_top | F.lit(lone), F.lit(DONE)).otherwise(F.lit(TOP))
    return [
        F.when(ends, out).otherwise(tree).cast("long").alias("to_tree"),
        F.when(ends, 0).otherwise(level).cast("int").alias("to_level"),
        F.when(ends, F.when(in_top | F.lit(lone), idx).otherwise(tree)).otherwise(idx).cast("long").alias("to_idx"),
    ]


def built(leaves: DataFrame, carried: list[str], name: str) -> tuple[list[DataFrame], DataFrame]:
    """(blocks of each pass, (tree, hash): the node that remains of each tree). The passes' blocks
    have the columns of ``block_levels`` and ``base``, the level of their items, and ``top``, the tree's height."""
    passes, nodes, ends, k = [], leaves.withColumn("top", height(F.col("n"))).select("tree", "n", "idx", "hash", "top", *carried), [], 0
    while True:
        keep = [*carried, "top"] if k == 0 else ["top"]
        blocks = stored(block_levels(nodes, keep), f"{name}-blocks-{k}").withColumn("base", F.lit(k * HEIGHT)).withColumn("top", F.col("items")[0]["top"])
        passes.append(blocks)
        done = F.col("n") <= 1 << HEIGHT
        last = [F.when(height(F.col("n")) == i, F.get(F.col(f"up_{i}"), F.lit(0))) for i in range(HEIGHT + 1)]
        ends.append(blocks.where(done).select("tree", F.coalesce(*last).alias("hash")))
        rest = blocks.where(~done)
        if rest.isEmpty():
            return passes, reduce(DataFrame.unionByName, ends)
        n = F.shiftright(F.col("n") + ((1 << HEIGHT) - 1), HEIGHT)
        nodes = rest.select("tree", n.alias("n"), F.col("block").alias("idx"), F.col(f"up_{HEIGHT}")[0].alias("hash"), "top")
        k += 1


def inner_nodes(blocks: DataFrame, lone: bool, own: bool) -> DataFrame:
    """The nodes of blocks that have a parent in their tree: tree, level, idx, seg (the sibling's digest,
    empty if there is none) and the pointer to the parent. ``own``: the blocks' items as well."""

    def level(k: int) -> Column:
        up = F.col(f"up_{k}")
        return F.transform(up, lambda h, i: F.struct(F.lit(k).alias("k"), i.alias("at"), F.coalesce(F.get(up, i.bitwiseXOR(F.lit(1))), F.lit(b"")).alias("seg")))

    rows = blocks.select("tree", "top", "base", "block", F.inline(F.flatten(F.array(*[level(k) for k in range(0 if own else 1, HEIGHT)]))))
    idx = F.call_function("shiftright", F.shiftleft("block", HEIGHT), F.col("k")) + F.col("at")
    rows = rows.select("tree", (F.col("base") + F.col("k")).cast("int").alias("level"), idx.alias("idx"), "seg", "top").where(F.col("level") < F.col("top"))
    return rows.select(*NODE, "seg", *pointer(F.col("tree"), F.col("level") + 1, F.shiftright("idx", 1), F.col("top"), lone))


def jump(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rows`` pointed on: each takes over the segment and the pointer of the node it points to."""
    far = nodes.select(*[F.col(c).alias(f"__{c}") for c in NODE], F.col("seg").alias("__seg"), *[F.col(f"to_{c}").alias(f"__to_{c}") for c in NODE])
    meet = [F.col(f"to_{c}") == F.col(f"__{c}") for c in NODE]
    joined = rows.join(far, reduce(Column.__and__, meet), "left")
    kept = [c for c in rows.columns if c != "seg" and not c.startswith("to_")]
    tree = F.coalesce("__to_tree", "to_tree")
    return joined.select(
        *kept, F.concat("seg", F.coalesce("__seg", F.lit(b""))).alias("seg"), tree.alias("to_tree"), F.coalesce("__to_level", "to_level").alias("to_level"),
        # at the root: a key of its own for each row, that no later join finds
        F.when(tree == DONE, F.col("idx")).otherwise(F.coalesce("__to_idx", "to_idx")).alias("to_idx"),
    )


def folded(leaf: Column, seg: Column, idx: Column, n: Column, tree: Column, trees: Column) -> Column:
    """The root that a leaf's digest and its siblings give: level by level, a sibling exists where the
    other place of the run lies inside the level, and stands to the left of odd places."""
    steps = height(n) + height(trees)
    start = F.struct(leaf.alias("h"), F.lit(0).alias("used"))

    def climb(acc: Column, k: Column) -> Column:
        low = k < height(n)
        up = F.when(low, k).otherwise(k - height(n)).cast("int")
        place = F.call_function("shiftright", F.when(low, idx).otherwise(tree), up)
        last = F.call_function("shiftright", F.when(low, n).otherwise(trees) - 1, up)
        other = place.bitwiseXOR(F.lit(1).cast("long"))
        own, sib = as_hex(acc["h"]), as_hex(F.substring(seg, acc["used"] * 32 + 1, F.lit(32)))
        both = F.when(other > last, own).when(other < place, F.concat(sib, own)).otherwise(F.concat(own, sib))
        return F.struct(digest(both).alias("h"), (acc["used"] + F.when(other > last, 0).otherwise(1)).alias("used"))

    return F.when(steps == 0, leaf).otherwise(F.aggregate(F.sequence(F.lit(0), F.greatest(steps, F.lit(1)) - 1), start, climb)["h"])


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256 (of the siblings' digests
    in order), folded_root (of the tampered leaf, else the leaf, and the siblings), verified, and
    lang, idx, siblings (their digests one after the other). ``tampered`` tells in which rows n_chars is raised by 1."""
    names = [F.col(c) for c in COLUMNS]
    changed = [F.col(c) + 1 if c == "n_chars" else F.col(c) for c in COLUMNS]
    tampered = F.lit(False) if tampered is None else F.coalesce(tampered, F.lit(False))
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), leaf_digest(*names).alias("hash"),
        F.when(tampered & F.col("n_chars").isNotNull(), leaf_digest(*changed)).alias("changed"),
    )
    placed, groups = numbered(leaves, "lang", ["doc_id", "hash"], "manifest")
    passes, subroots = built(placed, ["doc_id", "changed"], "manifest")
    subroots = stored(subroots.select("tree", "hash"), "manifest-subroots")
    trees = subroots.count()
    if not trees:
        none = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, lang string, idx long, siblings binary"
        return docs.sparkSession.createDataFrame([], none)
    lone = trees == 1
    over, root = built(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.lit(trees).cast("long").alias("n"), F.col("tree").alias("idx"), "hash"), [], "manifest-top")
    root = root.first()["hash"]

    # the leaves themselves are not among the nodes that others point to
    upper = [inner_nodes(b, lone, own=k > 0) for k, b in enumerate(passes)] + [inner_nodes(b, lone, own=True) for b in over]
    nodes = stored(reduce(DataFrame.unionByName, upper), "manifest-nodes-0")

    up = F.col("up_0")
    sibling = F.transform("items", lambda x, i: F.struct(*[x[c].alias(c) for c in ("idx", "hash", "doc_id", "changed")], F.coalesce(F.get(up, i.bitwiseXOR(F.lit(1))), F.lit(b"")).alias("seg")))
    rows = passes[0].select("tree", "n", "top", F.inline(sibling))
    alone = F.col("top") == 0
    rows = rows.select(
        "tree", "n", "idx", "hash", "doc_id", "changed", "seg",
        *pointer(F.col("tree"), F.when(alone, 0).otherwise(1), F.when(alone, F.col("idx")).otherwise(F.shiftright("idx", 1)), F.col("top"), lone),
    )
    deepest = groups.agg(F.max(height(F.col("n")))).first()[0] + (trees - 1).bit_length()
    distance = 1
    while True:
        in_top = F.col("tree") == TOP
        # the leaves stand `distance` below the nodes they point to, the other rows at twice its multiples
        far = stored(nodes.where(in_top | (F.col("level") % (2 * distance) == distance)), f"manifest-far-{distance}")
        rows = jump(rows, far)
        if 2 * distance > deepest:
            break
        near = nodes.where(in_top | (F.col("level") % (2 * distance) == 0))
        distance *= 2
        nodes = stored(jump(near, far), f"manifest-nodes-{distance}")
    # written, so that Spark knows how small it is: few groups are broadcast, of many a hot one is split
    ends = stored(groups.join(subroots.withColumnRenamed("hash", "subroot"), "tree").select("tree", "lang", "subroot"), "manifest-ends")
    rows = rows.join(ends, "tree")
    again = folded(F.coalesce("changed", "hash"), F.col("seg"), F.col("idx"), F.col("n"), F.col("tree"), F.lit(trees).cast("long"))
    rows = rows.withColumn("again", again)
    return rows.select(
        "doc_id", as_hex(F.col("hash")).alias("leaf"), as_hex(F.col("subroot")).alias("subroot"), F.lit(bytes(root).hex()).alias("root"),
        F.sha2(as_hex(F.col("seg")), 256).alias("proof_sha256"), as_hex(F.col("again")).alias("folded_root"), (F.col("again") == F.lit(bytes(root))).alias("verified"),
        "lang", "idx", F.col("seg").alias("siblings"),
    )
