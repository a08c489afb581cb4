"""SimHash near-dedup: pigeonhole blocks find fingerprints that differ in few bits; components name the groups.

Fingerprints are computed in a map over the documents. From there on only distinct fingerprints are joined, so copies
of a text cost one row. A fingerprint is split into blocks; two that differ in at most `most` bits agree on at least
blocks - most of them, so each choice of that many blocks is a key, and every close pair meets under some key. Inside a
key the task verifies Hamming distances tile by tile and passes on a spanning forest of the links, not the pairs. A key
with more fingerprints than a tile is dealt over tiles, and each pair of tiles is a group of its own, so that no task
holds more than two tiles.

Defined results: a null or wordless text has fingerprint zero, linked like any other; fewer words than a shingle make
one shingle of them all; texts of any length are read whole; repeated rows keep their own rows and share a component; a
null doc_id stays and its component is the smallest other doc_id of the group (null if there is none); columns of any
name stay in keep_one() and keep_distinct(), and near_copies() reads the two it is told; empty tables give no rows.

keep_distinct() is the rule of the pipeline's stage: SimHash prints find candidates, and documents whose sets of
five-word shingles have a Jaccard similarity of 0.8 or more are near copies. At 0.8 two prints differ in up to 15 % of
their bits, more than pigeonhole blocks of a useful length allow; so this print has 512 bits, over the distinct words and
word pairs of a text, and lies under 96 keys of bits drawn from anywhere in it. Prints that share a key and differ in a
quarter of the bits or less are candidates, whose similarity is then counted on the whole sets. Prints find most links, not
all: the links that they miss are found by unmet(), a prefix filter over all texts, so no near copy is left. A key has 6 bits more than
the documents' number has (30 at most), so that unlike texts seldom share one. A replaced word costs five shingles but at
most a word and two pairs, so prints of texts with scattered edits are near. Where a share p of the bits is unlike, two
texts meet with probability 1 - (1 - (1 - p) ** bits) ** 96: for p = 0.08, 0.10 and 0.15 that is 1.000, 1.000 and 0.936 with
22 bits (under 65,536 texts) and 1.000, 0.984 and 0.521 with 30 (over 8 million).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marketlake.llm.common import drop_shared, fresh, numbered, pieces, release, scratch, table, utf8, write_shared

SHINGLE = 3
MOST_BITS = 3
#: 64 bits in 6 blocks: 20 keys of about 32 bits.
BLOCKS = 6
#: Fingerprints of one key that a task compares at once.
TILE = 4096
SEED = 42
#: The pipeline's rule: shingles of so many words, and a Jaccard similarity of LIKE[0] / LIKE[1] or more.
LIKE_SHINGLE = 5
LIKE = (4, 5)
#: The print of that rule: 64-bit words, keys, the bits that a key has beyond the number's, the most, unlike bits of a candidate.
PRINT_WORDS = 8
PRINT_KEYS = 96
KEY_SPARE = 6
KEY_MOST = 30
PRINT_MOST = 128
#: Candidates among the firsts of its keys that a text is compared with one by one, the nearest print first; unmet() sees to the others.
LEADERS = 4
#: Rows of one shingle that unmet() compares with each other, and the part of a set by which its head is longer than one shared shingle takes.
HEAD_ROWS = 32
HEAD_SPARE = 16
#: Rows of one shingle that make a tile, and comparisons that a pair of tiles makes, at most.
LIKE_TILE = 512
LIKE_VALUES = 1 << 21

_FOLD = bytes(32 if 9 <= c <= 13 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of all word shingles, repeats included; of all words where they are fewer; empty without a word."""
    import xxhash

    words = text.translate(_FOLD).split(b" ")
    words = [w for w in words if w]
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.r_[0, ends[:-1] + 1]
    n, digest = len(words) - shingle + 1, xxhash.xxh64_intdigest
    return np.fromiter((digest(line[b:e], SEED) for b, e in zip(begins[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority over the bits of the hashes of all word shingles, repeats included."""
    hashes = shingle_hashes(text, shingle)
    n = len(hashes)
    if n < 2:
        return int(hashes[0]) if n else 0
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, text: str, out: str, shingle: int = SHINGLE) -> DataFrame:
    """docs with a long column `out` (another of that name goes) that holds the 64 bits."""

    def scan(batches):
        for batch in pieces(batches, text, 2 << 20):
            prints = np.array([fingerprint(t, shingle) for t in utf8(batch, text)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(prints)], schema=batch.schema)

    docs = docs.drop(out).withColumn(out, F.lit(None).cast("long"))
    return docs.mapInArrow(scan, docs.schema)


def block_masks(blocks: int, most: int) -> list[int]:
    """For each choice of blocks - most blocks, the bits they hold."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    bits = [(1 << edges[i + 1]) - (1 << edges[i]) for i in range(blocks)]
    return [sum(chosen) for chosen in combinations(bits, blocks - most)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def forest(a: np.ndarray, b: np.ndarray | None, most: int) -> list[tuple[int, int]]:
    """A spanning forest of the links inside a (b None) or between a and b, both holding distinct fingerprints."""
    values = a if b is None else np.r_[a, b]
    label = np.arange(len(values))
    offset = 0 if b is None else len(a)
    other = a if b is None else b
    left, right = [], []
    step = max(1, (1 << 22) // max(1, len(other)))
    for at in range(0, len(a), step):
        close = np.bitwise_count(a[at : at + step, None] ^ other[None, :]) <= most
        i, j = np.nonzero(close)
        i, j = i + at, j + offset
        new = i < j
        i, j = i[new], j[new]
        # hook the links of this strip, then keep only those that joined two components
        while len(i):
            li, lj = label[i], label[j]
            apart = li != lj
            i, j, li, lj = i[apart], j[apart], li[apart], lj[apart]
            if not len(i):
                break
            hi, lo = np.maximum(li, lj), np.minimum(li, lj)
            by = np.lexsort((lo, hi))
            first = by[np.r_[True, hi[by][1:] != hi[by][:-1]]]
            left.append(i[first])
            right.append(j[first])
            parent = np.arange(len(values))
            parent[hi[first]] = lo[first]
            while True:
                up = parent[parent]
                if np.array_equal(up, parent):
                    break
                parent = up
            label = parent[label]
    if not left:
        return []
    u, v = values[np.concatenate(left)], values[np.concatenate(right)]
    return list(zip(u.view(np.int64).tolist(), v.view(np.int64).tolist(), strict=True))


def links(prints: DataFrame, most: int = MOST_BITS, blocks: int = BLOCKS, tile: int = TILE) -> DataFrame:
    """(u, v): links between distinct fingerprints (column f) that hold together every group within `most` bits.

    Every fingerprint lies under each of the C(blocks, most) keys. Keys with one fingerprint go; a key's fingerprints
    are dealt over tiles, and each pair of tiles is a group, so that no task holds more than two tiles.
    """
    masks = block_masks(blocks, most)
    keys = F.array(*[F.struct(F.lit(k).alias("k"), F.col("f").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)])
    keyed = prints.select("f", F.explode(keys).alias("b")).select("f", "b.k", "b.key")
    sizes = keyed.groupBy("k", "key").agg(F.count("*").alias("n")).where("n > 1")
    # keys grow with the documents, so neither side is broadcast, at any size
    many = keyed.join(sizes.hint("merge"), ["k", "key"]).select("k", "key", "f", F.expr(f"cast(ceil(n / {tile}D) as int)").alias("tiles"))
    small = many.where("tiles = 1").select("k", "key", F.lit(0).alias("i"), F.lit(0).alias("j"), "f", F.lit(0).alias("t"))
    hot = many.where("tiles > 1").withColumn("t", F.expr(f"cast(pmod(xxhash64(f, {SEED}), tiles) as int)"))
    pair = F.expr("transform(sequence(0, tiles - 1), x -> struct(least(x, t) as i, greatest(x, t) as j))")
    hot = hot.withColumn("p", F.explode(pair)).select("k", "key", "p.i", "p.j", "f", "t")

    def compare(key, group):
        f, t = group["f"].to_numpy().view(np.uint64), group["t"].to_numpy()
        i, j = key[2].as_py(), key[3].as_py()
        found = forest(f, None, most) if i == j else forest(f[t == i], f[t == j], most)
        return pa.table({"u": pa.array([x for x, _ in found], pa.int64()), "v": pa.array([x for _, x in found], pa.int64())})

    def compare_small(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            u, v = [], []
            for fs in batch.column(0):
                for a, b in forest(fs.values.to_numpy().view(np.uint64), None, most):
                    u.append(a)
                    v.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    # Keys of up to one tile are bounded lists; pairs of fingerprints, the usual case, need no Python at all.
    lists = small.groupBy("k", "key").agg(F.collect_list("f").alias("fs")).select("fs")
    two = lists.where("size(fs) = 2").select(F.col("fs")[0].alias("u"), F.col("fs")[1].alias("v"))
    two = two.where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most)
    more = lists.where("size(fs) > 2").mapInArrow(compare_small, "u long, v long")
    dense = hot.groupBy("k", "key", "i", "j").applyInArrow(compare, "u long, v long")
    return two.unionByName(more).unionByName(dense)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node of the edges (u, v). Alternating large and small stars.

    Each round is written to the shared folder, so no lineage grows and a lost executor costs one round at most.
    """
    spark = edges.sparkSession
    edges = edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    path = write_shared(edges, "links")
    while True:
        now = spark.read.parquet(path)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: every larger neighbour of a node links to the node's smallest neighbour or itself
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u != v").distinct()
        # small star: a node and its smaller neighbours link to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        small = small.where("u != v").distinct()
        then = write_shared(small, "links")
        sums = [
            spark.read.parquet(p).agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)"))).first()
            for p in (path, then)
        ]
        drop_shared(spark, path)
        path = then
        if sums[0] == sums[1]:
            break
    stars = spark.read.parquet(path)
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _classes(prints: DataFrame, most: int, blocks: int) -> DataFrame:
    """prints (uid, doc_id, f) as classes (f, root, first): first is the struct (no_id, doc_id, uid) of the class's first document."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
    classes = prints.groupBy("f").agg(first.alias("first"))
    roots = components(links(classes.select("f"), most, blocks))
    return classes.join(roots.withColumnRenamed("node", "f").hint("merge"), "f", "left").withColumn("root", F.coalesce("root", "f"))


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, most: int = MOST_BITS, blocks: int = BLOCKS) -> DataFrame:
    """One row per document: doc_id, fingerprint (long) and component_id, the smallest doc_id reachable over links."""
    docs = docs.select(F.lit(0).cast("long").alias("uid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    prints = spark.read.parquet(write_shared(fingerprints(docs, "text", "f", shingle).drop("text"), "fingerprints"))
    with scratch(spark) as stay:
        classes = _classes(prints, most, blocks)
        groups = classes.groupBy("root").agg(F.min("first")["doc_id"].alias("component_id"))
        of_class = classes.select("f", "root").join(groups.hint("merge"), "root").select("f", "component_id")
        stay.append(write_shared(of_class, "components"))
    of_class = spark.read.parquet(stay[0])
    return prints.join(of_class.hint("merge"), "f").select("doc_id", F.col("f").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, most: int = MOST_BITS, blocks: int = BLOCKS) -> DataFrame:
    """docs with one document of each group: that of the smallest doc_id; of rows that share it, the first read."""
    spark = docs.sparkSession
    uid = fresh("uid", docs.columns)
    docs = numbered(docs, uid)
    with scratch(spark) as stay:
        prints = fingerprints(docs.select(F.col(uid).alias("uid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "f", shingle).drop("text")
        classes = _classes(spark.read.parquet(write_shared(prints, "fingerprints")), most, blocks)
        stay.append(write_shared(classes.groupBy("root").agg(F.min("first")["uid"].alias(uid)).select(uid), "kept"))
    # the kept rows grow with the documents, so they are never broadcast, at any size
    return docs.join(spark.read.parquet(stay[0]).hint("merge"), uid, "left_semi").drop(uid)


_SALT = np.arange(PRINT_WORDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def wide_print(text: bytes) -> np.ndarray:
    """The words of the print that keep_distinct() compares: of each bit the majority over the distinct words and word pairs,
    whose hashes are mixed anew for each word of the print."""
    hashes = np.unique(np.concatenate([shingle_hashes(text, 1), shingle_hashes(text, 2)]))
    ones, n = np.zeros(64 * PRINT_WORDS, np.int64), len(hashes)
    for at in range(0, n, 255):  # a sum of 255 bits fits a byte
        h = (hashes[at : at + 255, None] ^ _SALT) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(29)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > n, bitorder="little").view(np.uint64)


def key_bits(texts: int) -> int:
    """How many bits a key of prints has."""
    return min(KEY_MOST, max(texts, 1).bit_length() + KEY_SPARE)


def key_masks(bits: int) -> list[list[int]]:
    """For each key of a wide print, the signed words of the bits that it holds."""
    rng, masks = np.random.default_rng(SEED), []
    for _ in range(PRINT_KEYS):
        held = rng.choice(64 * PRINT_WORDS, bits, replace=False).tolist()
        masks.append([_signed(sum(1 << (b % 64) for b in held if b // 64 == w)) for w in range(PRINT_WORDS)])
    return masks


def print_keys(classes: DataFrame, bits: int) -> DataFrame:
    """(rep, key): each print of classes (rep, print) under its keys; a text without a word has no print and no key."""
    masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in words]) for words in key_masks(bits)])
    every = classes.where("print is not null").select("rep", "print", F.posexplode(masks).alias("k", "mask"))
    return every.select("rep", F.xxhash64("k", *[F.col("print")[w].bitwiseAND(F.col("mask")[w]) for w in range(PRINT_WORDS)]).alias("key"))


def differing(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v, bits): the pairs (u, v) of rep, with the number of bits in which their prints differ."""
    both = pairs
    for side in ("u", "v"):
        both = both.join(classes.select(F.col("rep").alias(side), F.col("print").alias(f"print_{side}")).hint("merge"), side)
    unlike = sum((F.bit_count(F.col("print_u")[w].bitwiseXOR(F.col("print_v")[w])) for w in range(1, PRINT_WORDS)), F.bit_count(F.col("print_u")[0].bitwiseXOR(F.col("print_v")[0])))
    return both.select("u", "v", unlike.alias("bits"))


def candidates(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (u, v) of rep, those whose prints differ in PRINT_MOST bits or fewer."""
    return differing(pairs, classes).where(f"bits <= {PRINT_MOST}").select("u", "v")


def nearest_first(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(u, v, nth): the candidates of the pairs (u, v), each with its place among those of its v, the nearest print first."""
    near = differing(pairs, classes).where(f"bits <= {PRINT_MOST}")
    return near.withColumn("nth", F.row_number().over(W.partitionBy("v").orderBy("bits", "u"))).select("u", "v", "nth")


def alike(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs (uid, doc_id, text) as classes (rep, first) of equal shingle sets, and links (u, v) between their rep.

    rep is the uid of a class's first document. First every class is compared with the first one under each of its keys, up to
    LEADERS of them, since a member of a large group has another first under almost every key; then unmet() finds what links
    these leave, whatever the prints say. The links hold every group together; they are not all of its pairs.
    """
    spark = docs.sparkSession

    def scan(batches):
        for batch in pieces(batches, "text", 2 << 20):
            sets = [np.unique(shingle_hashes(t, LIKE_SHINGLE).view(np.int64)) for t in utf8(batch, "text")]
            import xxhash

            digest = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
            prints = pa.array([wide_print(t).view(np.int64) if len(s) else None for t, s in zip(utf8(batch, "text"), sets, strict=True)], pa.list_(pa.int64()))
            heads = pa.array([s[: head_size(len(s))] for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], digest, prints, pa.array([len(s) for s in sets], pa.int64()), heads], names=["uid", "doc_id", "digest", "print", "n", "head"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = docs.select("uid", "doc_id", "text").mapInArrow(scan, f"uid bigint, doc_id {kind}, digest binary, print array<bigint>, n bigint, head array<bigint>")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid"))
    same = [F.any_value(c).alias(c) for c in ("print", "n", "head")]  # equal sets: n and head are equal, and any print will do
    classes = signed.groupBy("digest").agg(first.alias("first"), *same).select(F.col("first.uid").alias("rep"), "first", "print", "n", "head")
    classes = spark.read.parquet(write_shared(classes, "classes"))
    by = W.partitionBy("key")
    keyed = print_keys(classes, key_bits(classes.count())).withColumns({"u": F.min("rep").over(by), "n": F.count("*").over(by)})
    met = spark.read.parquet(write_shared(keyed.where("n > 1").drop("n"), "met"))
    pairs = nearest_first(met.where("rep != u").select("u", F.col("rep").alias("v")).distinct(), classes)
    pairs = spark.read.parquet(write_shared(pairs, "pairs"))
    near = pairs.where(f"nth <= {LEADERS}").select("u", "v")
    sets = shingle_sets(docs, near.select(F.explode(F.array("u", "v")).alias("uid")).distinct()).withColumnRenamed("uid", "rep")
    linked = spark.read.parquet(write_shared(similar(sets, near), "alike"))
    roots = components(linked).withColumnRenamed("node", "rep")
    release(spark)
    return classes.select("rep", "first"), linked.unionByName(unmet(docs, classes, roots))


def head_size(n: int) -> int:
    """How many of the n shingles of a set, in an order that all sets share, make its head: of two similar sets, the heads share
    one shingle more than the lesser of both n has in HEAD_SPARE parts.

    A set has part / whole of its shingles or more in common with a similar one. Up to the lesser of both heads' last shingles
    that head is whole, and all but n - ceil(part / whole * n) of it are shared, so the other head has them too.
    """
    part, whole = LIKE
    return n and n - -(-part * n // whole) + 1 + n // HEAD_SPARE


def unmet(docs: DataFrame, classes: DataFrame, roots: DataFrame, most: int = HEAD_ROWS) -> DataFrame:
    """(u, v): links between classes (rep, n, head) of unlike root, roots (rep, root); they hold every group together.

    All pairs that share a shingle which up to `most` heads have are compared. A pair that shares none of these shares only
    frequent ones, and by head_size() so many that either set has more than ceil(part / whole * n) / HEAD_SPARE frequent ones
    in its head. Such sets are members of apart(), which compares all its members by their scarcest shingles.
    """
    spark, (part, whole) = docs.sparkSession, LIKE
    rows = spark.read.parquet(write_shared(shared_heads(classes, roots), "heads"))
    split = rows.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("c")).where("a != b")
    rows = spark.read.parquet(write_shared(rows.join(split.select("h", "c").hint("merge"), "h"), "split-heads"))
    few = rows.where(f"c <= {most}")
    side = lambda k: few.select("h", *[F.col(c).alias(f"{c}_{k}") for c in ("rep", "root", "n")])
    pairs = side("u").join(side("v").hint("merge"), "h").where(f"rep_u < rep_v and root_u != root_v and {part} * n_u <= {whole} * n_v and {part} * n_v <= {whole} * n_u")
    pairs = spark.read.parquet(write_shared(possible(pairs.select(F.col("rep_u").alias("u"), F.col("rep_v").alias("v")).distinct(), classes), "possible"))
    often = rows.where(f"c > {most}").groupBy("rep", "root", "n").agg(F.count("*").alias("c"))
    members = often.where(f"c > (({part} * n + {whole - 1}) div {whole}) div {HEAD_SPARE}").select("rep", "root")
    members = spark.read.parquet(write_shared(members, "open"))
    release(spark)
    wanted = pairs.select(F.explode(F.array("u", "v")).alias("uid")).unionByName(members.select(F.col("rep").alias("uid"))).distinct()
    sets = shingle_sets(docs, wanted).withColumnRenamed("uid", "rep")
    return similar(sets, pairs).unionByName(apart(docs, members, sets=sets))


def shared_heads(classes: DataFrame, roots: DataFrame) -> DataFrame:
    """(h, rep, root, n): the shingles h that the heads of two or more classes (rep, n, head) have."""
    rows = classes.select("rep", "n", F.explode("head").alias("h"))
    rows = rows.withColumn("c", F.count("*").over(W.partitionBy("h"))).where("c > 1")
    return rows.join(roots.hint("merge"), "rep", "left").select("h", "rep", F.coalesce("root", "rep").alias("root"), "n")


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Of the pairs (u, v) of rep, those that can be similar by their heads; no similar pair goes.

    Up to the lesser of both heads' last shingles the heads hold all of either set, so what one has there and the other has
    not is in no intersection.
    """
    part, whole = LIKE
    both = pairs
    for k in ("u", "v"):
        both = both.join(classes.select(F.col("rep").alias(k), F.col("n").alias(f"n_{k}"), F.col("head").alias(f"head_{k}")).hint("merge"), k)
    both = both.withColumns({"last": F.expr("least(element_at(head_u, -1), element_at(head_v, -1))"), "shared": F.expr("size(array_intersect(head_u, head_v))")})
    can = [f"{part + whole} * (n_{k} - size(filter(head_{k}, x -> x <= last)) + shared) >= {part} * (n_u + n_v)" for k in ("u", "v")]
    return both.where(" and ".join(can)).select("u", "v")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(uid, s): the whole shingle sets of the documents of `wanted` (uid), written once."""

    def scan(batches):
        for batch in pieces(batches, "text", 2 << 20):
            sets = [np.unique(shingle_hashes(t, LIKE_SHINGLE)).view(np.int64) for t in utf8(batch, "text")]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["uid", "s"])

    texts = docs.select("uid", "text").join(wanted.hint("merge"), "uid", "left_semi")
    return docs.sparkSession.read.parquet(write_shared(texts.mapInArrow(scan, "uid bigint, s array<bigint>"), "sets"))


def scarce(sets: DataFrame, members: DataFrame) -> DataFrame:
    """(h, rep, root, n, at, cap): where the sets (rep, s) of members (rep, root) look for each other, a prefix filter.

    Each set is put in one order, the shingles that fewest sets hold first. Two sets that reach the similarity share one of
    the first n - ceil(part / whole * n) + 1 shingles of either; those that no other set holds are left out, as they are in no
    intersection. At the first shingle shared, the `at` before it are in no intersection either, so the other set has at most
    `cap` shingles; two rows of one h can be such a pair if the n of each is within the cap of the other.
    """
    part, whole = LIKE
    each = sets.select("rep", F.size("s").alias("n"), F.explode("s").alias("h"))
    shared = each.groupBy("h").agg(F.count("*").alias("c")).where("c > 1")
    held = each.join(shared.hint("merge"), "h").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("c", "h"))).alias("shared"))
    held = held.withColumn("lone", F.expr("n - size(shared)"))
    first = F.expr(f"slice(shared, 1, cast(greatest(n - ({part} * n + {whole - 1}) div {whole} + 1 - lone, 0) as int))")
    rows = held.select("rep", "n", "lone", F.posexplode(first).alias("i", "e")).select("e.h", "rep", "n", F.expr("lone + i").alias("at"))
    rows = rows.withColumn("cap", F.expr(f"({part + whole} * (n - at) - {part} * n) div {part}"))
    return rows.join(members.hint("merge"), "rep").select("h", "rep", "root", "n", "at", "cap")


def with_leaders(rows: DataFrame) -> DataFrame:
    """(u, v): the pairs of rows of scarce() of unlike root in which one is the row of its h with the fewest shingles before it."""
    lead = F.min(F.struct("at", (-F.col("n")).alias("less"), "rep", "root", "n", "cap")).alias("l")
    lead = rows.groupBy("h").agg(lead, F.min("root").alias("a"), F.max("root").alias("b")).where("a != b")
    pairs = rows.join(lead.select("h", "l").hint("merge"), "h").where("root != l.root and n <= l.cap and l.n <= cap")
    return pairs.select(F.least("rep", "l.rep").alias("u"), F.greatest("rep", "l.rep").alias("v")).distinct()


def tiled(rows: DataFrame, width: int) -> DataFrame:
    """The rows of scarce() whose h has two roots or more, with t: tiles of `width` rows of one h, alike in n and cap."""
    split = rows.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a != b").select("h")
    nth = F.row_number().over(W.partitionBy("h").orderBy("n", "cap", "rep"))
    return rows.join(split.hint("merge"), "h").withColumn("t", ((nth - 1) / width).cast("int"))


def tile_pairs(tiles: DataFrame) -> DataFrame:
    """(h, i, j): the pairs of tiles of tiled(), i <= j, that can hold a pair: of unlike root, and within the caps."""
    said = tiles.groupBy("h", "t").agg(F.min("n").alias("lo"), F.max("cap").alias("cap"), F.min("root").alias("a"), F.max("root").alias("b"))
    one, two = (said.select("h", *[F.col(c).alias(f"{side}_{c}") for c in ("t", "lo", "cap", "a", "b")]) for side in "ij")
    can = "i_t <= j_t and i_lo <= j_cap and j_lo <= i_cap and least(i_a, j_a) != greatest(i_b, j_b)"
    return one.join(two.hint("merge"), "h").where(can).select("h", F.col("i_t").alias("i"), F.col("j_t").alias("j"))


def in_tiles(tiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(u, v): the pairs of rows of unlike root and within each other's cap that the pairs (h, i, j) of tiles hold."""
    side = lambda k, t: tiles.select("h", F.col("t").alias(t), *[F.col(c).alias(f"{c}_{k}") for c in ("rep", "root", "n", "cap")])
    both = pairs.join(side("u", "i").hint("merge"), ["h", "i"]).join(side("v", "j").hint("merge"), ["h", "j"])
    both = both.where("root_u != root_v and n_u <= cap_v and n_v <= cap_u and (i < j or rep_u < rep_v)")
    return both.select(F.least("rep_u", "rep_v").alias("u"), F.greatest("rep_u", "rep_v").alias("v")).distinct()


def apart(docs: DataFrame, members: DataFrame, most: int = LIKE_TILE, values: int = LIKE_VALUES, sets: DataFrame | None = None) -> DataFrame:
    """(u, v): links of the similarity between members (rep, root) that are of unlike root; they hold every group together.
    sets: the shingle sets (rep, s) of the members, and maybe of others, where they are written already.

    All pairs are found, by their scarce shingles, and compared on the whole sets. First each shingle's rows meet the leader,
    which makes one root of most of a large group of near copies; what is left of unlike root is compared by tiles of up to
    `most` rows, of which a pair makes up to `values` comparisons. Tiles of one root, or of sizes too far apart, do not meet.
    """
    spark = docs.sparkSession
    members = members.select("rep", "root").distinct()
    if sets is None:
        sets = shingle_sets(docs, members.select(F.col("rep").alias("uid"))).withColumnRenamed("uid", "rep")
    else:
        sets = sets.join(members.select("rep").hint("merge"), "rep", "left_semi")
    rows = spark.read.parquet(write_shared(scarce(sets, members), "scarce"))
    led = spark.read.parquet(write_shared(similar(sets, with_leaders(rows)), "led"))
    roots = components(led.unionByName(members.select(F.col("rep").alias("u"), F.col("root").alias("v")))).withColumnRenamed("node", "rep")
    rows = rows.drop("root").join(roots.hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
    tiles = spark.read.parquet(write_shared(tiled(rows, min(most, isqrt(values))), "tiles"))
    return led.unionByName(similar(sets, in_tiles(tiles, tile_pairs(tiles))))


def similar(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of the pairs (u, v) of rep, those whose whole shingle sets (rep, s) reach the similarity."""
    both = pairs.join(sets.select(F.col("rep").alias("u"), F.col("s").alias("a")).hint("merge"), "u")
    both = both.join(sets.select(F.col("rep").alias("v"), F.col("s").alias("b")).hint("merge"), "v")
    # sizes that differ too much cannot reach it; else shared / (all) >= part / whole, in whole numbers
    part, whole = LIKE
    near = F.expr(f"{whole} * least(size(a), size(b)) >= {part} * greatest(size(a), size(b))")
    shared = F.size(F.array_intersect("a", "b"))
    enough = shared * (part + whole) >= part * (F.size("a") + F.size("b"))
    return both.where(F.when(near, enough).otherwise(False)).select("u", "v")


def keep_distinct(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group that links of five-word similarity hold together, chosen as by keep_one()."""
    spark = docs.sparkSession
    uid = fresh("uid", docs.columns)
    docs = numbered(docs, uid)
    with scratch(spark) as stay:
        classes, edges = alike(docs.select(F.col(uid).alias("uid"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
        roots = components(edges).withColumnRenamed("node", "rep")
        grouped = classes.join(roots.hint("merge"), "rep", "left").withColumn("root", F.coalesce("root", "rep"))
        stay.append(write_shared(grouped.groupBy("root").agg(F.min("first")["uid"].alias(uid)).select(uid), "kept"))
    return docs.join(spark.read.parquet(stay[0]).hint("merge"), uid, "left_semi").drop(uid)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
