"""A Merkle manifest of a dataset: a tree of digests for each group of rows, and one over the groups.

Leaves are numbered within their group. A tree grows by events: a node's digest
is an event for its parent, and a parent that has gathered as many as the size
of its tree says (``arity``, or what is left for the last one) is complete: it
is stored with its children's digests and becomes an event itself. Leaves lie in
runs of neighbours, so a task completes most of its part of the trees while it
reads them, holding only the parents it has begun. Those still incomplete at its
end are the frontier, a few for each task and level. ``combineByKey`` gathers
them by parent, dealt out by ever longer runs of leaves, until every root is known.

Stored nodes are links from a child to its parent and siblings. Followed in
reverse, from the roots down, they give every node its proof.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelake.durable import durable, unpartitioned_text
from quirelake.llm.columns import quoted
from quirelake.operators.ranking import running_total
from quirelake.session import table
from quirelake.shipping import ship_package

ARITY = 16
#: a round deals the frontier out by runs of leaves so many levels longer than the round before
LEVELS = 3

#: a parent: tree, number of the tree's leaves, level, number within the level
Key = tuple[str, int, int, int]
#: digests of a parent's children by their place below it
Held = dict[int, str]

NODE = "tree string, size long, level int, number long, digest string, children array<string>, is_root boolean"
PROOF = "array<struct<before:string,after:string>>"


def width(size: int, level: int, arity: int) -> int:
    """Nodes on a level of a tree with ``size`` leaves."""
    for _ in range(level):
        size = -(-size // arity)
    return size


def _merged(held: Held, more: Held) -> Held:
    return {**held, **more}


def _dealt_by(arity: int, reach: int) -> Callable[[Key], int]:
    """Partition function: all parents over one run of ``arity ** reach`` leaves meet in one task."""

    def of(key: Key) -> int:
        tree, _, level, number = key
        run = number * arity**level // arity**reach
        return int.from_bytes(hashlib.blake2b(f"{run}:{tree}".encode(), digest_size=7).digest(), "big")

    return of


def _growing(arity: int) -> Callable[[Iterable[tuple[Key, Held]]], Iterator[tuple]]:
    """Turns events into complete nodes, and at the end of the task into what is left incomplete (last column)."""

    def run(events: Iterable[tuple[Key, Held]]) -> Iterator[tuple]:
        begun: dict[Key, Held] = {}
        for key, held in events:
            while True:
                held = _merged(begun.pop(key, {}), held)
                tree, size, level, number = key
                if len(held) < min(arity, width(size, level - 1, arity) - number * arity):
                    begun[key] = held
                    break
                children = [held[k] for k in range(len(held))]
                digest = hashlib.sha256("".join(children).encode()).hexdigest()
                is_root = width(size, level, arity) == 1
                yield (*key, digest, children, is_root, None)
                if is_root:
                    break
                key, held = (tree, size, level + 1, number // arity), {number % arity: digest}
        for key, held in begun.items():
            yield (*key, None, None, False, held)

    return run


def grown(leaves: DataFrame, arity: int = ARITY) -> DataFrame:
    """All inner nodes (tree, size, level, number, digest, children, is_root) of the trees over ``leaves`` (tree, size, place, digest).

    Places run from 0 to size - 1 in each tree; others are an error. A tree of
    one leaf has no inner node. Every round is stored in the checkpoint folder.
    """
    if arity < 2:
        raise ValueError("a parent needs two children or more")
    spark = leaves.sparkSession
    ship_package(spark)
    largest = leaves.agg(F.max("size")).head()[0] or 0
    events = leaves.filter("size > 1").select("tree", "size", F.lit(1).alias("level"), F.expr(f"place div {arity}").alias("number"), F.create_map((F.col("place") % arity).cast("int"), "digest").alias("held"))
    nodes, reach = None, 0
    while True:
        pairs = events.rdd.map(lambda r: ((r[0], r[1], r[2], r[3]), r[4]))
        if reach:
            tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
            pairs = pairs.combineByKey(dict, _merged, _merged, tasks, _dealt_by(arity, reach))
        made = durable(spark.createDataFrame(pairs.mapPartitions(_growing(arity)), NODE + ", held map<int,string>", verifySchema=False))
        done = made.filter("digest is not null").drop("held")
        nodes = done if nodes is None else nodes.union(done)
        events = made.filter("held is not null").select("tree", "size", "level", "number", "held")
        if not events.head(1):
            return nodes
        if reach and arity**reach >= largest:
            raise ValueError("the places of a tree's leaves are not 0 to size - 1")
        reach += LEVELS


def _beside(children: str, place: Column) -> Column:
    """The digests beside the child at ``place``, before and after it."""
    rest = F.greatest(F.size(children) - place - 1, F.lit(0))
    return F.struct(F.array_join(F.slice(children, F.lit(1), place), "").alias("before"), F.array_join(F.slice(children, place + 2, rest), "").alias("after"))


def proven(leaves: DataFrame, nodes: DataFrame, above: DataFrame, arity: int = ARITY) -> DataFrame:
    """``leaves`` with ``proof``: what stands beside their node on each level, from the leaf up, then what ``above`` (tree, up) has for the tree's root.

    Level by level from the top, each node hands its own proof to its children.
    A node meets its parent by (tree, number), at most ``arity`` of them one parent.
    """

    def under(lower: DataFrame, place: str, parents: DataFrame) -> DataFrame:
        parents = parents.select(F.col("tree").alias("__tree"), F.col("number").alias("__number"), F.col("children").alias("__children"), F.col("up").alias("__up"))
        met = lower.join(parents, (F.col("tree") == F.col("__tree")) & (F.expr(f"{place} div {arity}") == F.col("__number")))
        up = F.concat(F.array(_beside("__children", (F.col(place) % arity).cast("int"))), "__up")
        return met.select(*lower.columns, up.alias("up"))

    tops = above.select(unpartitioned_text("tree").alias("tree"), "up")
    parents = None
    for level in range(nodes.agg(F.max("level")).head()[0] or 0, 0, -1):
        here = nodes.filter(F.col("level") == level)
        known = here.filter("is_root").select("tree", "number", "children").join(tops, "tree")
        if parents is not None:
            known = known.unionByName(under(here.filter("not is_root").select("tree", "number", "children"), "number", parents))
        parents = durable(known)
    lone = leaves.filter("size = 1").join(tops, "tree").select(*leaves.columns, F.col("up").alias("proof"))
    if parents is None:
        return lone
    return under(leaves.filter("size > 1"), "place", parents).withColumnRenamed("up", "proof").union(lone)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""
    return F.aggregate(proof, leaf, lambda digest, side: F.sha2(F.concat(side["before"], digest, side["after"]), 256))


def row_digest(columns: list[Column]) -> Column:
    """sha256 over the columns: ``-`` for null, else the value's length in UTF-8 bytes, ``:`` and the value as text."""
    parts = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in columns]
    return F.sha2(F.concat(*parts), 256)


def numbered_leaves(rows: DataFrame) -> DataFrame:
    """``rows`` (tree, sort_key, leaf and others) with ``place`` in its tree from 0 and ``size`` of the tree, in the order of sort_key, then leaf.

    The place comes from the whole table's order less the tree's own start, so
    that a tree with a third of all rows is in no one task.
    """
    order = ["tree", "sort_key", *[c for c in rows.columns if c not in ("tree", "sort_key")]]
    placed = running_total(rows, order, name="__place")
    trees = placed.groupBy("tree").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("size")).select(unpartitioned_text("tree").alias("__tree"), "__first", "size")
    return placed.join(trees, F.col("tree") == F.col("__tree")).select(*rows.columns, (F.col("__place") - F.col("__first")).alias("place"), "size")


def manifest(docs: DataFrame, columns: list[str], group: str = "source", order: str = "doc_id", arity: int = ARITY, carry: dict[str, Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(leaves, nodes) of the dataset.

    leaves: ``order``, ``group``, leaf, place, subroot, root, proof (array of
    before and after) and the columns of ``carry``. A leaf is the digest of the
    row's ``columns``; leaves of a group ascend by ``order``, null first, rows
    equal in it by their leaf. Groups ascend by UTF-8 bytes, null first. A row
    alone in its group is the group's subroot, a single group's subroot the
    root. Repeated rows are leaves of their own. An empty table has no leaf and
    no node. Other columns of ``docs`` are not read.

    nodes: (tree, size, level, number, digest, children, is_root); tree is empty
    for the tree over groups, ``=`` for the null group, else ``=+`` and the group.
    """
    carried = carry or {}
    tree = F.concat(F.lit("="), F.coalesce(F.concat(F.lit("+"), quoted(group).cast("string")), F.lit("")))
    read = docs.select(tree.alias("tree"), quoted(order).alias("sort_key"), row_digest([quoted(c) for c in columns]).alias("leaf"), *[c.alias(f"carried_{k}") for k, c in carried.items()])
    leaves = durable(numbered_leaves(durable(read)))
    nodes = grown(leaves.select("tree", "size", "place", F.col("leaf").alias("digest")), arity)
    subroots = nodes.filter("is_root").select("tree", "digest").union(leaves.filter("size = 1").select("tree", F.col("leaf").alias("digest")))
    groups = durable(running_total(durable(subroots), ["tree"], name="nth"))
    spark, count = docs.sparkSession, groups.count()
    tops = groups.select(F.lit("").alias("tree"), F.lit(count).cast("long").alias("size"), (F.col("nth") - 1).alias("place"), "digest", F.col("tree").alias("group_tree"))
    upper = grown(tops, arity)
    none = spark.range(1).select(F.lit("").alias("tree"), F.array().cast(PROOF).alias("up"))
    shown = proven(tops, upper, none, arity).select(F.col("group_tree").alias("tree"), F.col("proof").alias("up"), F.col("digest").alias("subroot"))
    above = durable(shown.select("tree", "up", "subroot", folded(F.col("subroot"), F.col("up")).alias("root")))
    named = proven(leaves, nodes, above.select("tree", "up"), arity).join(above.select(unpartitioned_text("tree").alias("tree"), "subroot", "root"), "tree")
    of_group = F.when(F.col("tree") != "=", F.expr("substring(tree, 3)")).alias(group)
    out = named.select(F.col("sort_key").alias(order), of_group, "leaf", "place", "subroot", "root", "proof", *[F.col(f"carried_{k}").alias(k) for k in carried])
    return out, nodes.union(upper)


COLUMNS = ["doc_id", "source", "lang", "n_chars", "text"]


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, subroot, root and proof of every document; and where its proof leads from the text as tampered with."""
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    leaves, _ = manifest(docs, COLUMNS, carry={"seen": row_digest([tampered if c == "text" else F.col(c) for c in COLUMNS])})
    beside = F.array_join(F.transform("proof", lambda side: F.concat(side["before"], side["after"])), "")
    out = leaves.select("doc_id", "leaf", "subroot", "root", F.sha2(beside, 256).alias("proof_sha256"), folded(F.col("seen"), F.col("proof")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


#: whole trees as lists, each level made from the one below, and proofs by walking up the lists
OP13_SQL = r"""
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, b: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END)) AS t),
e AS (SELECT doc_id, source, text, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
    || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') AS head,
  xor(4294967295, list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)), lambda a, b: xor(t[(xor(a, b) & 255) + 1], a >> 8))) AS sum FROM documents, crc),
l AS (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
  CASE WHEN sum % 5 = 0 THEN sha256(head || coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-')) ELSE sha256(head || coalesce(strlen(text) || ':' || text, '-')) END AS seen,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i FROM e),
t AS (SELECT source, 0 AS lvl, list(leaf ORDER BY i) AS d FROM l GROUP BY source
  UNION ALL SELECT source, lvl + 1, list_transform(range(0, len(d), 16), lambda k: sha256(array_to_string(d[k + 1:k + 16], ''))) FROM t WHERE len(d) > 1),
sub AS (SELECT source, d[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i FROM t WHERE len(d) = 1),
top AS (SELECT 0 AS lvl, list(subroot ORDER BY i) AS d FROM sub
  UNION ALL SELECT lvl + 1, list_transform(range(0, len(d), 16), lambda k: sha256(array_to_string(d[k + 1:k + 16], ''))) FROM top WHERE len(d) > 1),
w AS (SELECT doc_id, source, leaf, i, 0 AS lvl, '' AS proof, seen AS fold FROM l
  UNION ALL SELECT doc_id, source, leaf, i // 16, lvl + 1, proof || before || after, sha256(before || fold || after) FROM (SELECT w.*, array_to_string(d[i // 16 * 16 + 1:i], '') AS before, array_to_string(d[i + 2:i // 16 * 16 + 16], '') AS after
    FROM w JOIN t ON t.lvl = w.lvl AND t.source IS NOT DISTINCT FROM w.source WHERE len(d) > 1)),
s AS (SELECT w.doc_id, w.leaf, sub.subroot, sub.i, w.proof, w.fold FROM w JOIN t ON t.lvl = w.lvl AND t.source IS NOT DISTINCT FROM w.source AND len(d) = 1 JOIN sub ON sub.source IS NOT DISTINCT FROM w.source),
v AS (SELECT doc_id, leaf, subroot, i, 0 AS lvl, proof, fold FROM s
  UNION ALL SELECT doc_id, leaf, subroot, i // 16, lvl + 1, proof || before || after, sha256(before || fold || after) FROM (SELECT v.*, array_to_string(d[i // 16 * 16 + 1:i], '') AS before, array_to_string(d[i + 2:i // 16 * 16 + 16], '') AS after
    FROM v JOIN top ON top.lvl = v.lvl WHERE len(d) > 1))
SELECT doc_id, leaf, subroot, d[1] AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = d[1] AS verified FROM v JOIN top ON top.lvl = v.lvl AND len(d) = 1
"""
