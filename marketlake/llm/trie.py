"""The prefix trie of conversations, its subtree sums by heavy-path decomposition.

A node is a distinct sequence of first turns; its name is two 64-bit hashes of the turns and their places, joined by xor,
so a window over each conversation names all its prefixes and a node's parent is known without a look-up.

Each node's heavy child is the one that most conversations share (of equals the one with the smallest member). A child by
a light edge has at most half the conversations of its parent, so no way from the root has more light edges than the
logarithm of the number of conversations. Nodes joined by heavy edges are a path, kept as rows of (path, depth). A
conversation owns the nodes of which it is the smallest member, a run of depths; a window over these finds where paths
begin, and paths that run on through several owners are followed by doubling pointers, each of which leads to one row.

Sums over subtrees: every node brings points of its own to its path. In each round the points of all light paths are
summed by the parent that they hang on, and become points of that parent. After as many rounds as there are light edges
on any way no point is left over, and the suffix sums of all points along each path are the sums over subtrees. Long
paths are summed in chunks, so no task holds one.

Joins meet on keys that are unique on both sides; look-ups of a parent's smallest member are salted where it has many
children. The ids of conversations that end at one node are gathered in sorted pieces by many tasks, and only these pieces
stream through the digest, in constant memory.

Defined results: rows without a conv_id belong to no conversation and are left out; turns are ordered by turn (null
first), then role and text; repeated rows are turns like others; null role and text are empty; a conversation of no turn
of its own after rebuilding is a member of the root alone; other columns may have any name; an empty table has no node.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marketlake.llm.common import drop_shared, table, write_shared

#: Conversations of so many neighbouring ids begin alike.
FAMILY = 20
#: First turns taken from the family's first conversation: the remainder of a checksum by this.
HEADS = 4
#: Depths of a path that are summed in one group.
CHUNK = 4096
#: Children of a parent from which look-ups are salted, and the number of salts.
HOT, SALTS = 4096, 64
#: Ids in one piece of a node's list.
PIECE = 4096

WORD = r"[^\x20\x09-\x0D]+"
NODE, PARENT = ("a", "b"), ("pa", "pb")


class _Steps:
    """Tables written on the way; the last keeps what the result reads."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        self.paths[name] = write_shared(df, name)
        return self.spark.read.parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        for name in names:
            drop_shared(self.spark, self.paths.pop(name))


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, pos: turns by number from 1."""
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return rows.select("conv_id", "role", "text", F.row_number().over(W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")).alias("pos"))


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, role, text, pos of every rebuilt conversation; one without turns has one row of pos null."""
    own = turns(conversations)
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEADS)).cast("int")
    first = own.where(F.col("pos") < HEADS)
    heads = first.where(F.col("conv_id") % FAMILY == 0).select(F.col("conv_id").alias("base"), F.struct("pos", "role", "text").alias("t"))
    heads = heads.groupBy("base").agg(F.array_sort(F.collect_list("t")).alias("heads"))  # three turns at most
    convs = own.where("pos = 1").select("conv_id").withColumn("h", h).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    convs = convs.join(heads, "base", "left").select("conv_id", F.slice(F.coalesce("heads", F.array().cast(heads.schema["heads"].dataType)), 1, F.col("h")).alias("heads"))
    # heads first, then what a conversation has after its own first h turns
    taken = convs.select("conv_id", F.explode("heads").alias("t")).select("conv_id", F.lit(0).alias("part"), "t.pos", "t.role", "t.text")
    rest = own.where(F.col("pos") > h).select("conv_id", F.lit(1).alias("part"), "pos", "role", "text")
    none = convs.select("conv_id", F.lit(2).alias("part"), F.lit(None).cast("int").alias("pos"), F.lit("").alias("role"), F.lit("").alias("text"))
    every = taken.unionByName(rest).unionByName(none)
    w = W.partitionBy("conv_id").orderBy("part", "pos")
    every = every.withColumn("nth", F.row_number().over(w))
    return every.where("part < 2 or nth = 1").select("conv_id", "role", "text", F.when(F.col("part") < 2, F.col("nth")).alias("pos"))


def prefixes(rows: DataFrame) -> DataFrame:
    """conv_id, depth, a, b (the node), pa, pb (its parent), n_words (of the last text); depth 0 for no turns."""
    named = [F.when(F.col("pos").isNotNull(), F.xxhash64(F.lit(seed), "pos", "role", "text")).otherwise(F.lit(0)).alias(f"_{c}") for seed, c in ((1, "a"), (7_919, "b"))]
    w = W.partitionBy("conv_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.select("conv_id", F.coalesce("pos", F.lit(0)).alias("depth"), "pos", *named, F.when(F.col("pos").isNotNull(), F.regexp_count("text", F.lit(WORD))).otherwise(0).cast("long").alias("n_words"))
    for c in NODE:
        rows = rows.withColumn(c, F.expr(f"bit_xor(_{c})").over(w))
    return rows.select("conv_id", "depth", *NODE, *[F.when(F.col("depth") > 0, F.col(c).bitwiseXOR(F.col(f"_{c}"))).alias(f"p{c}") for c in NODE], "n_words", (F.col("pos") == F.max("pos").over(W.partitionBy("conv_id"))).alias("ends"))


def trie(rows: DataFrame) -> DataFrame:
    """The nodes: depth, a, b, pa, pb, conv_id (smallest member), n_convs, n_words. rows are prefixes()."""
    root = rows.agg(F.min("conv_id").alias("conv_id"), F.count_distinct("conv_id").alias("n_convs")).where("conv_id is not null")
    root = root.select(F.lit(0).alias("depth"), *[F.lit(0).cast("long").alias(c) for c in NODE], *[F.lit(None).cast("long").alias(c) for c in PARENT], "conv_id", "n_convs", F.lit(0).cast("long").alias("n_words"))
    inner = rows.where("depth > 0").groupBy("depth", *NODE, *PARENT).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.first("n_words").alias("n_words"))
    return root.unionByName(inner)


def on(left: str, left_cols: tuple[str, str], right: str, right_cols: tuple[str, str]) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{x}") == F.col(f"{right}.{y}") for x, y in zip(left_cols, right_cols, strict=True)])


def with_heavy(nodes: DataFrame) -> DataFrame:
    """nodes with n_children and heavy: whether the node is its parent's heavy child. Both joins meet on unique keys."""
    below = nodes.where("pa is not null").groupBy(*PARENT).agg(F.count("*").alias("n_children"), F.max(F.struct("n_convs", -F.col("conv_id"), *NODE)).alias("best"))
    children = below.select(F.col("pa").alias("_a"), F.col("pb").alias("_b"), "n_children")
    heavy = below.select(F.col("best.a").alias("_a"), F.col("best.b").alias("_b"), F.lit(True).alias("heavy"))
    out = nodes
    for side in (children, heavy):
        out = out.alias("n").join(side.alias("s"), on("n", NODE, "s", ("_a", "_b")), "left").drop("_a", "_b")
    return out.withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "heavy": F.coalesce("heavy", F.lit(False))})


def with_paths(nodes: DataFrame, steps: _Steps) -> DataFrame:
    """nodes with ha, hb (the node where the heavy path begins) and hpa, hpb (that node's parent)."""
    head = F.struct(F.col("a").alias("ha"), F.col("b").alias("hb"), F.col("pa").alias("hpa"), F.col("pb").alias("hpb"))
    w = W.partitionBy("conv_id").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    local = nodes.withColumn("head", F.last(F.when(~F.col("heavy"), head), ignorenulls=True).over(w))
    local = steps.keep(local, "trie-local")
    # An owner whose first node is a heavy child goes on with the path of that node's parent, which no other owner does.
    top = local.where("heavy and head is null").groupBy("conv_id").agg(F.min_by(F.struct(*PARENT), "depth").alias("up")).select("conv_id", "up.pa", "up.pb")
    above = local.select(*[F.col(c).alias(f"_{c}") for c in NODE], F.col("conv_id").alias("next"), F.col("head").alias("found"))
    links = top.alias("t").join(above.alias("u"), on("t", PARENT, "u", ("_a", "_b"))).select("conv_id", "next", "found")
    links, n = steps.keep(links, "trie-links-0"), 0
    while not links.where("found is null").isEmpty():
        ahead = links.select(F.col("conv_id").alias("next"), F.col("next").alias("_next"), F.col("found").alias("_found"))
        links = links.join(ahead, "next", "left").select("conv_id", F.coalesce("_next", "next").alias("next"), F.coalesce("found", "_found").alias("found"))
        links, n = steps.keep(links, f"trie-links-{n + 1}"), n + 1
        steps.drop(f"trie-links-{n - 1}")
    done = local.where("head is not null").unionByName(local.where("head is null").drop("head").join(links.select("conv_id", F.col("found").alias("head")), "conv_id"))
    out = steps.keep(done.select("*", "head.*").drop("head", "heavy"), "trie-paths")
    steps.drop("trie-local", f"trie-links-{n}")
    return out


def subtree_sums(nodes: DataFrame, values: dict[str, Column], steps: _Steps) -> DataFrame:
    """nodes of with_paths() with the sum of each value over the node's subtree."""
    names, key = list(values), ["ha", "hb", "hpa", "hpb", "depth"]
    points = nodes.select(*key, *[v.alias(c) for c, v in values.items()])
    rounds, last = [points], points
    while True:
        up = last.where("hpa is not null").groupBy("hpa", "hpb").agg(*[F.sum(c).alias(c) for c in names])
        up = up.alias("u").join(nodes.select(*NODE, *[F.col(c).alias(f"n_{c}") for c in key]).alias("n"), on("u", ("hpa", "hpb"), "n", NODE))
        last = steps.keep(up.select(*[F.col(f"n_{c}").alias(c) for c in key], *names), f"trie-round-{len(rounds)}")
        if last.isEmpty():
            break
        rounds.append(last)
    path, chunk = ["ha", "hb"], F.floor(F.col("depth") / CHUNK).cast("int")
    own = reduce(DataFrame.unionByName, rounds).groupBy(*path, "depth").agg(*[F.sum(c).alias(c) for c in names]).withColumn("chunk", chunk)
    whole = own.groupBy(*path, "chunk").agg(*[F.sum(c).alias(c) for c in names])
    after = W.partitionBy(*path).orderBy(F.desc("chunk")).rowsBetween(W.unboundedPreceding, -1)
    whole = whole.select(*path, "chunk", *[F.coalesce(F.sum(c).over(after), F.lit(0)).alias(f"_{c}") for c in names])
    within = W.partitionBy(*path, "chunk").orderBy(F.desc("depth")).rowsBetween(W.unboundedPreceding, 0)
    sums = own.join(whole, [*path, "chunk"]).select(*path, "depth", *[(F.sum(c).over(within) + F.col(f"_{c}")).alias(c) for c in names])
    return nodes.join(sums, [*path, "depth"])


def with_parents(nodes: DataFrame) -> DataFrame:
    """nodes with parent_conv_id. Parents of many children meet them over SALTS parts, the others in one."""
    side = nodes.select(*[F.col(c).alias(f"_{c}") for c in NODE], F.col("conv_id").alias("_conv"), "n_children")
    hot = side.where(F.col("n_children") > HOT).select("_a", "_b", F.col("_conv").alias("_hot"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    cold = side.where(F.col("n_children").between(1, HOT)).select("_a", "_b", F.col("_conv").alias("_cold"))
    salted = nodes.withColumn("salt", F.pmod(F.xxhash64("conv_id"), F.lit(SALTS)).cast("int"))
    out = salted.alias("n").join(hot.alias("h"), on("n", PARENT, "h", ("_a", "_b")) & (F.col("salt") == F.col("_salt")), "left").drop("_a", "_b", "salt", "_salt")
    # children of hot parents have theirs; a null key sends them around the second join
    out = out.withColumns({f"c{c}": F.when(F.col("_hot").isNull(), F.col(f"p{c}")) for c in NODE})
    out = out.alias("n").join(cold.alias("c"), on("n", ("ca", "cb"), "c", ("_a", "_b")), "left")
    return out.withColumn("parent_conv_id", F.coalesce("_hot", "_cold")).drop("_a", "_b", "ca", "cb", "_hot", "_cold")


def ends(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """a, b, ends_sha256: of nodes at which conversations end, the digest of their ids in order. rows are prefixes()."""

    def gather(batches):
        """Sorted (a, b, conv_id) to pieces of ids of one node."""
        key, ids, first = None, [], 0
        for batch in batches:
            out = []
            for a, b, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (a, b) != key or len(ids) >= piece:
                    if ids:
                        out.append((*key, first, ",".join(ids)))
                    key, ids, first = (a, b), [], c
                ids.append(str(c))
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "first", "ids"), r, strict=True)) for r in out])
        if ids:
            yield pa.RecordBatch.from_pylist([{"a": key[0], "b": key[1], "first": first, "ids": ",".join(ids)}])

    def digest(batches):
        """Sorted pieces to one digest for each node, one state at a time."""
        key, state = None, None
        for batch in batches:
            out = []
            for a, b, ids in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3)), strict=True):
                if (a, b) == key:
                    state.update(b",")
                else:
                    if key:
                        out.append((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                state.update(ids.encode())
            if out:
                yield pa.RecordBatch.from_pylist([dict(zip(("a", "b", "ends_sha256"), r, strict=True)) for r in out])
        if key:
            yield pa.RecordBatch.from_pylist([{"a": key[0], "b": key[1], "ends_sha256": state.hexdigest()}])

    last = rows.where("depth = 0 or ends").select("a", "b", "conv_id")
    parts = last.repartitionByRange("a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id").mapInArrow(gather, "a bigint, b bigint, first bigint, ids string")
    return parts.repartition("a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, "a bigint, b bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    steps = _Steps(conversations.sparkSession)
    rows = steps.keep(prefixes(rebuilt(conversations)), "trie-prefixes")
    nodes = with_paths(with_heavy(trie(rows)), steps)
    values = {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_words")}
    out = with_parents(subtree_sums(nodes, values, steps))
    digests = ends(rows).select(F.col("a").alias("_a"), F.col("b").alias("_b"), "ends_sha256")
    out = out.alias("n").join(digests.alias("d"), on("n", NODE, "d", ("_a", "_b")), "left")
    return out.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


#: Nodes as lists of digests of turns; subtrees by comparing each node with every longer one.
ORACLE = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list(struct_pack(k := md5(role || ':' || text), w := CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT)) ORDER BY pos) AS ts FROM t GROUP BY conv_id),
c AS (SELECT conv_id, ts, xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::UBIGINT)),
  lambda r, x: list_reduce(list_concat([xor(r, x)], [0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT, 0::UBIGINT]),
    lambda v, z: xor(v >> 1, 3988292384::UBIGINT * (v & 1::UBIGINT)))), 4294967295::UBIGINT) % 4 AS h FROM o),
r AS (SELECT c.conv_id, list_concat(coalesce(b.ts[1:CAST(c.h AS BIGINT)], []), c.ts[CAST(c.h AS BIGINT) + 1:]) AS ts FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, d, list_transform(ts[1:d], lambda x: x.k) AS key, CASE WHEN d > 0 THEN ts[d].w ELSE 0 END AS w, d = len(ts) AS ends FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM r)),
n AS (SELECT d, key, min(conv_id) AS conv_id, count(*) AS n_convs, min(w) AS w, coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ends FROM p GROUP BY d, key),
k AS (SELECT a.d, a.key, count(b.d) AS n_children FROM n a LEFT JOIN n b ON b.d = a.d + 1 AND b.key[1:a.d] = a.key GROUP BY a.d, a.key),
s AS (SELECT a.d, a.key, count(*) FILTER (WHERE b.below = 0) AS n_leaves, CAST(sum((b.n_convs - 1) * b.w) AS BIGINT) AS saved_tokens
  FROM k a JOIN (SELECT n.*, k.n_children AS below FROM n JOIN k USING (d, key)) b ON b.d >= a.d AND b.key[1:a.d] = a.key GROUP BY a.d, a.key)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, k.n_children, s.n_leaves, s.saved_tokens, sha256(n.ends) AS ends_sha256
FROM n JOIN k USING (d, key) JOIN s USING (d, key) LEFT JOIN n u ON u.d = n.d - 1 AND u.key = n.key[1:n.d - 1]
"""
