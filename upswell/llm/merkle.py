"""A Merkle manifest of a table: one root that vouches for every row, and proofs per row."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from upswell.llm.common import running_total
from upswell.operators.ranking import global_rank
from upswell.session import materialize

#: Consecutive nodes that have one parent.
RUN = 3


def encoded(column: Column | str) -> Column:
    """A value as text that cannot be taken for two: ``-`` if NULL, else its bytes counted, ``:``, itself."""
    text = (F.col(column) if isinstance(column, str) else column).cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(columns: Iterable[Column | str]) -> Column:
    """The digest of a row: SHA-256 of its encoded columns, one after the other, as bytes."""
    return F.unhex(F.sha2(F.concat(*map(encoded, columns)), 256))


def hexed(digest: Column | str) -> Column:
    return F.lower(F.hex(digest))


def _parent(parts: Column) -> Column:
    """The digest over an array of digests, which count as lower-case hex text."""
    return F.unhex(F.sha2(F.array_join(F.transform(parts, hexed), ""), 256))


def folded(start: Column, proof: Column) -> Column:
    """What a leaf and the siblings of its way up come to: the root, if both are right."""
    return F.aggregate(
        proof,
        start,
        lambda at, step: F.unhex(F.sha2(F.concat(hexed(step["left"]), hexed(at), hexed(step["right"])), 256)),
    )


def proof_digest(proof: Column) -> Column:
    """SHA-256 over the siblings of a proof, level by level, left to right, as hex text."""
    return F.sha2(F.array_join(F.transform(proof, lambda s: F.concat(hexed(s["left"]), hexed(s["right"]))), ""), 256)


def _levels(size: Column) -> Column:
    """How often ``size`` nodes are folded until one remains, in whole numbers."""
    powers = F.array(*[F.lit(RUN**i) for i in range(39)])
    return F.size(F.filter(powers, lambda p: p < size))


def _siblings(levels: Column, height: Column, at: Column) -> Column:
    """The proof of node ``at`` (from 0) of a block: per level, the run's others left and right of its own way up."""
    nothing = F.lit(b"")
    width = F.array(*[F.lit(RUN**i) for i in range(20)])

    def step(level: Column) -> Column:
        place = F.floor(at / F.get(width, level)).cast("int")
        turn, start = place % RUN, place - place % RUN
        node = lambda k: F.coalesce(F.get(F.get(levels, level), start + k), nothing)
        left = F.concat(*[F.when(turn > k, node(k)).otherwise(nothing) for k in range(RUN - 1)])
        right = F.concat(*[F.when(turn < k, node(k)).otherwise(nothing) for k in range(1, RUN)])
        return F.struct(left.alias("left"), right.alias("right"))

    steps = F.when(height > 0, F.sequence(F.lit(0), height - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, step)


def _storey(nodes: DataFrame, stride: int, level: int) -> DataFrame:
    """``stride`` levels over the nodes of ``level``, as parent-linked rows that are written once.

    Takes (tree, size, pos, digest, row): ``size`` nodes at the foot of a tree, of which
    RUN ** ``stride`` neighbours at most meet in one value. Gives each node its parent at the
    top of the storey (up_level, up_pos; NULL if that is the top of its tree), the parent's
    digest and the siblings on the way there.
    """
    width = RUN**stride
    left = _levels(F.col("size")) - level
    blocks = nodes.groupBy("tree", "size", F.floor(F.col("pos") / width).alias("block")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "digest", "row")), _by_pos).alias("nodes")
    )
    blocks = blocks.withColumn("height", F.least(left, F.lit(stride)).cast("int")).withColumn("last", left <= stride)
    folded_up = lambda level: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(level) - 1) / RUN).cast("int")),
        lambda run: _parent(F.slice(level, run * RUN + 1, F.lit(RUN))),
    )
    steps = F.when(F.col("height") > 0, F.sequence(F.lit(1), "height")).otherwise(F.array().cast("array<int>"))
    # Every level of the block once; a run that has one node only is folded all the same.
    levels = F.aggregate(
        steps, F.array(F.col("nodes.digest")), lambda built, _: F.array_append(built, folded_up(F.element_at(built, -1)))
    )
    # Lateral views would copy the levels for each node; one value with all of them does not.
    proven = blocks.withColumn("levels", levels).select(
        "tree",
        "size",
        F.when(~F.col("last"), F.lit(level + stride)).alias("up_level"),
        F.when(~F.col("last"), F.col("block")).alias("up_pos"),
        F.get(F.element_at("levels", -1), F.lit(0)).alias("up_digest"),
        F.explode(
            F.transform(
                "nodes",
                lambda node, at: F.struct(
                    node["pos"].alias("pos"),
                    node["digest"].alias("digest"),
                    node["row"].alias("row"),
                    _siblings(F.col("levels"), F.col("height"), at).alias("proof"),
                ),
            )
        ).alias("node"),
    )
    return materialize(proven.select("tree", "size", F.lit(level).alias("level"), "node.*", "up_level", "up_pos", "up_digest"))


def _by_pos(a: Column, b: Column) -> Column:
    return (a["pos"] - b["pos"]).cast("int")


def _tree(feet: DataFrame, stride: int) -> list[DataFrame]:
    """All storeys over the foot nodes of one or many trees, lowest first."""
    storeys = [_storey(feet, stride, 0)]
    while True:
        tops = storeys[-1].where(F.col("up_pos").isNotNull() & (F.col("pos") % RUN**stride == 0))
        if tops.isEmpty():
            return storeys
        nodes = tops.select("tree", "size", F.col("up_pos").alias("pos"), F.col("up_digest").alias("digest"), F.lit(None).cast("int").alias("row"))
        storeys.append(_storey(nodes, stride, stride * len(storeys)))


def manifest(rows: DataFrame, by: str, order: str, stride: int = 6) -> tuple[DataFrame, DataFrame]:
    """(leaves, nodes): the built levels of the Merkle tree over ``rows``, as parent-linked rows.

    ``rows`` has a binary ``leaf``, a column ``by`` with one tree per value, an ``order`` in
    it, and what else is to stay with a leaf. In a tree leaves ascend by ``order`` (NULL
    first, equal ones by digest); while more than one node remains, every ``RUN``
    consecutive ones (the last run may be shorter) give their parent. What remains is the
    tree's subroot; the subroots, by ascending ``by`` (NULL first, by bytes), are folded in
    the same way and give the root.

    A node is (tree, level, pos): trees count from 1, tree 0 is that of the subroots. Its row
    links it to its ancestor ``stride`` levels up, or to the top of the tree if that is
    nearer, with that ancestor's digest and the siblings on the way (``stride`` 1: its
    parent and the other nodes of its run). The top of tree ``t`` is linked to node
    (0, 0, t - 1); the links of the last storey of tree 0 are NULL.

    Leaves are numbered by a range sort of narrow rows; a tree may have any share of them.
    Building takes one shuffle per storey, each ``RUN ** stride`` times smaller than the one
    before. ``leaves`` has the columns of ``rows`` (in ``row``); ``nodes`` has all other levels.

    An empty table gives no leaves and no nodes. Rows that repeat all columns are leaves of
    their own.
    """
    by_key = F.when(F.col(by).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(by).cast("string")))
    # The number makes the order total, also where a third of all rows are equal.
    numbered = materialize(
        rows.select(
            by_key.alias("_by"),
            F.col(order).alias("_order"),
            F.col("leaf").alias("digest"),
            F.struct(*rows.columns).alias("row"),
            F.lit(1).cast("long").alias("_one"),
            F.monotonically_increasing_id().alias("_number"),
        )
    )
    placed = running_total(numbered, ["_by"], ["_order", "digest", "_number"], "_one", "_place")
    sizes = global_rank(numbered.groupBy("_by").agg(F.count(F.lit(1)).alias("size")), F.col("_by"), rank="tree")
    feet = placed.join(materialize(sizes), "_by").select("tree", "size", (F.col("_place") - 1).alias("pos"), "digest", "row")
    storeys = [s.withColumn("up_tree", F.when(F.col("up_pos").isNull(), F.lit(0).cast("long")).otherwise(F.col("tree"))) for s in _tree(feet, stride)]
    # Each tree's top, taken from the first node of its last storey.
    last = (F.col("up_tree") == 0) & (F.col("pos") == 0)
    subroots = [s.where(last).select("tree", F.col("up_digest").alias("digest")) for s in storeys]
    tops = materialize(_union(subroots))
    trees = tops.count()
    top_feet = tops.select(
        F.lit(0).cast("long").alias("tree"), F.lit(trees).cast("long").alias("size"), (F.col("tree") - 1).alias("pos"), "digest", F.lit(None).cast("int").alias("row")
    )
    above = [s.withColumn("up_tree", F.when(F.col("up_pos").isNotNull(), F.col("tree"))) for s in _tree(top_feet, stride)]
    leaves, *lower = storeys
    linked = [
        s.select(
            *("tree", "level", "pos", "digest", "proof", "up_tree"),
            F.when(F.col("up_tree") == F.col("tree"), F.col("up_level")).when(F.col("up_tree") == 0, F.lit(0)).alias("up_level"),
            F.when(F.col("up_tree") == F.col("tree"), F.col("up_pos")).when(F.col("up_tree") == 0, F.col("tree") - 1).alias("up_pos"),
            "up_digest",
            *(["row"] if s is leaves else []),
        )
        for s in [leaves, *lower, *above]
    ]
    return linked[0], _union(linked[1:])


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


_CLIMB = """
with recursive climb as (
    select row, digest, proof, {fold_leaf} as folded, up_tree, up_level, up_pos,
           cast(null as binary) as subroot, cast(null as binary) as root
    from {leaves}
    union all
    select c.row, c.digest, concat(c.proof, n.proof), {fold_up}, n.up_tree, n.up_level, n.up_pos,
           coalesce(c.subroot, case when n.tree = 0 and n.level = 0 then n.digest end),
           case when n.up_tree is null then n.up_digest end
    from climb c join {nodes} n on c.up_tree = n.tree and c.up_level = n.level and c.up_pos = n.pos)
select row, digest as leaf, proof, folded, subroot, root from climb where up_tree is null"""
_FOLD = "aggregate({proof}, {start}, (at, s) -> unhex(sha2(concat(lower(hex(s.left)), lower(hex(at)), lower(hex(s.right))), 256)))"


def climb(leaves: DataFrame, nodes: DataFrame, claimed: str = "row.leaf") -> DataFrame:
    """(row, leaf, proof, folded, subroot, root) of every leaf: the way up from it, by a recursive query.

    Each round takes all leaves one storey up: it looks the linked node up, appends its
    siblings to the proof, and folds them into the digest that started as ``claimed`` (the
    leaf itself, or what somebody claims it to be). The rows arrive at the root together
    with the true subroot and root; ``folded`` equals ``root`` if and only if the claim is
    that of the leaf.

    There are about log(rows) / (``stride`` log RUN) rounds. A round's join has one node for
    many leaves: the nodes are ``RUN ** stride`` times fewer than the leaves, the optimizer
    broadcasts them if they are small, and adaptive execution splits a node with many
    leaves if not. Spark's limit on the rows of a recursion is lifted for the session.
    """
    spark = leaves.sparkSession
    spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    query = _CLIMB.replace("{fold_leaf}", _FOLD.format(proof="proof", start=claimed)).replace(
        "{fold_up}", _FOLD.format(proof="n.proof", start="c.folded")
    )
    return spark.sql(query, leaves=leaves, nodes=nodes)
