"""Mixing sources to target weights, natively: blocks of words, shards of slots, and permuted indices joined by block.

The words of a source, its documents in a fixed order, form one stream cut into blocks of a fixed length. The mix has
slots of one block each, dealt over output shards. A pseudorandom permutation of all slots against the cumulated slot
counts of the sources says which source a slot takes; shard_counts() gives the counts of each shard.

These counts are the multinomial draw of the method, conditioned on the totals. Let each of N slots draw a source k with
probability p_k = s_k / N on its own: a shard of n slots then has the counts c with probability n! prod p_k^c_k / c_k!,
a multinomial law, and the shards are independent. Given that the totals come out as s_k, every order of the N draws is
equally likely, since each has the probability prod p_k^s_k. A permutation drawn evenly gives just that, so a shard has
the counts c with probability prod C(s_k, c_k) / C(N, n), whose mean is n p_k, as before, and whose variance is that of
the multinomial times (N - n) / (N - 1). Without the condition a source of s blocks would miss its target by the root of s.

A slot's number inside its source, permuted anew for each pass over the source, is the block it takes. The last slot of
a source takes the first words of its block only, as many as its target still lacks, so that a source of any size takes
its target to the word. Permutations are swap-or-not networks over any domain, computed inside expressions.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at
`most_repeats` times its source's size and the excess is reshared by weight until none is above.

Defined results: null or wordless texts have size 0 and nothing taken; a null source is a source; rows that repeat a
doc_id each have their own row and their own words; a text of any length counts whole, over as many blocks as it fills;
mixed_documents() keeps columns of any name, mix() reads the three it is told; an empty table gives no rows. Nothing depends on partitions: reruns
agree up to an exchange between rows that are equal in id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marketlake.llm.common import fresh, numbered, table, write_shared

WORD = r"[^\x20\x09-\x0D]+"
BLOCK_WORDS = 64
SHARD_SLOTS = 4096
MOST_REPEATS = 3
WEIGHTS = (1, 2, 3)
SEED = 20240229
#: Rounds of the swap-or-not network.
ROUNDS = 32
#: Slots that one task draws.
TASK_SLOTS = 200_000
#: Documents of a source that share one running sum.
CHUNK_DOCS = 10_000


def permuted(index: Column, size: Column, *key: Column | int, inverse: bool = False) -> Column:
    """A pseudorandom permutation of 0 .. size - 1, or its inverse, applied to index; key picks the permutation."""
    return swapped(index, size, round_keys(size, *key), inverse)


def round_keys(size: Column, *key: Column | int) -> Column:
    """For each round what its pairs sum up to, modulo size, and what its coins are mixed with."""
    fixed = [F.lit(k) if isinstance(k, int) else k for k in key]
    return F.array(*[F.struct(F.pmod(F.xxhash64(F.lit("k"), F.lit(r), *fixed), size).alias("sum"), F.xxhash64(F.lit("b"), F.lit(r), *fixed).alias("coin")) for r in range(ROUNDS)])


def swapped(index: Column, size: Column, keys: Column, inverse: bool = False) -> Column:
    """permuted() by round_keys(), which many rows may share: a round costs a row one hash of one number."""

    def swap(x: Column, r: Column) -> Column:
        partner = r["sum"] - x
        partner = F.when(partner < 0, partner + size).otherwise(partner)
        coin = F.xxhash64(F.greatest(x, partner).bitwiseXOR(r["coin"])).bitwiseAND(F.lit(1))
        return F.when(coin == 1, partner).otherwise(x)

    # each round swaps pairs and undoes itself, so the rounds in reverse are the inverse
    return F.aggregate(F.reverse(keys) if inverse else keys, index.cast("long"), swap)


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """sources (source, source_size) with weight and target. One row per source, so one window over all of them."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    out = sources.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n + 1).cast("int")))
    # Sources reach their limits in the order of limit / weight; with the first k at theirs, the others share the rest.
    by = W.orderBy((F.lit(float(most)) * F.col("source_size") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    rest = F.sum("source_size").over(W.partitionBy()) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))
    level = rest.cast("double") / F.sum("weight").over(after)
    out = out.withColumn("_level", level).withColumn("_n", F.row_number().over(by))
    out = out.withColumn("_open", F.col("_level") * F.col("weight") < most * F.col("source_size"))
    first = F.min_by("_level", F.when(F.col("_open"), F.col("_n"))).over(W.partitionBy())
    first_n = F.min(F.when(F.col("_open"), F.col("_n"))).over(W.partitionBy())
    at_limit = (most * F.col("source_size")).cast("double")
    target = F.when((F.col("_n") < first_n) | first_n.isNull(), at_limit).otherwise(first * F.col("weight"))
    return out.withColumn("target", target).drop("_level", "_n", "_open")


def plan(sizes: DataFrame, block: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: int = SEED) -> DataFrame:
    """Sources with targets, blocks and slots: one row per source with the slots' place [first_slot, first_slot + slots).

    sizes has source and size. A source takes whole passes over its blocks while its target holds them, then so many
    blocks of one more pass as the rest needs; last_words is what its last slot takes of its block (null: all of it).
    """
    per = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    size = F.greatest("source_size", F.lit(1))
    per = per.withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long")).withColumn("_want", F.round("target").cast("long"))
    per = per.withColumn("_full", F.least(F.floor(F.col("_want") / size).cast("long"), F.lit(most).cast("long")))
    per = per.withColumn("_rest", F.greatest(F.col("_want") - F.col("_full") * F.col("source_size"), F.lit(0)))
    # all blocks are of the fixed length but the last one, which `lacks` some words and is at place `_at` of the pass
    lacks = F.col("blocks") * block - F.col("source_size")
    per = per.withColumn("_at", permuted(F.col("blocks") - 1, F.greatest("blocks", F.lit(1)), F.xxhash64("source"), F.col("_full"), seed + 1, inverse=True))
    even = F.ceil(F.col("_rest") / block).cast("long")
    per = per.withColumn("_more", F.when(even <= F.col("_at"), even).when(F.col("_rest") > 0, F.ceil((F.col("_rest") + lacks) / block).cast("long")).otherwise(0))
    before_last = (F.col("_more") - 1) * block - F.when(F.col("_more") - 1 > F.col("_at"), lacks).otherwise(0)
    per = per.withColumn("slots", F.col("_full") * F.col("blocks") + F.col("_more")).withColumn("last_words", F.when(F.col("_more") > 0, F.col("_rest") - before_last))
    order = W.orderBy(F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    return per.withColumn("first_slot", F.coalesce(F.sum("slots").over(order), F.lit(0).cast("long"))).drop("_want", "_full", "_rest", "_at", "_more")


def draw(spark: SparkSession, planned: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED, bins: int = 1024) -> DataFrame:
    """One row per slot of the mix: shard, slot, source, the block it takes and the words it takes of it (null: all).

    planned has source, blocks, slots and first_slot, and last_words where a last slot takes part of its block. Slots meet their source by a join on coarse bins of the permuted number, so no slot is compared with every source.
    """
    if "last_words" not in planned.columns:
        planned = planned.withColumn("last_words", F.lit(None).cast("long"))
    total = planned.agg(F.coalesce(F.sum("slots"), F.lit(0))).first()[0]
    if not total:
        return planned.select(F.lit(0).cast("long").alias("shard"), F.lit(0).cast("long").alias("slot"), "source", F.lit(0).cast("long").alias("block"), "last_words").limit(0)
    width = -(-total // bins)
    slots = spark.range(0, total, 1, -(-total // TASK_SLOTS)).select(
        F.floor(F.col("id") / shard_slots).alias("shard"), F.col("id").alias("slot"), permuted(F.col("id"), F.lit(total), seed).alias("at")
    )
    slots = slots.withColumn("bin", F.floor(F.col("at") / width))
    last = F.col("first_slot") + F.col("slots") - 1
    # keys of a permutation are made once for each pass over a source, not for each slot
    turns = F.sequence(F.lit(0).cast("long"), F.floor((F.col("slots") - 1) / F.greatest("blocks", F.lit(1))))
    keyed = F.transform(turns, lambda turn: round_keys(F.greatest("blocks", F.lit(1)), F.xxhash64("source"), turn, seed + 1))
    of_bin = planned.where("slots > 0").withColumn("keys", keyed)
    of_bin = of_bin.withColumn("bin", F.explode(F.sequence(F.floor(F.col("first_slot") / width), F.floor(last / width))))
    mixed = slots.join(of_bin, (slots["bin"] == of_bin["bin"]) & (slots["at"] >= of_bin["first_slot"]) & (slots["at"] <= last))
    number = F.col("at") - F.col("first_slot")
    turn, within = F.floor(number / F.col("blocks")), F.pmod(number, F.col("blocks"))
    taken = swapped(within, F.col("blocks"), F.get("keys", turn.cast("int")))
    return mixed.select("shard", "slot", "source", taken.alias("block"), F.when(number == F.col("slots") - 1, F.col("last_words")).alias("last_words"))


def shard_counts(slots: DataFrame) -> DataFrame:
    """(shard, source, n): how many blocks of each source a shard holds."""
    return slots.groupBy("shard", "source").agg(F.count("*").alias("n"))


def streams(sizes: DataFrame, chunk_docs: int = CHUNK_DOCS) -> DataFrame:
    """sizes (key, source, size) with `offset`, the words of the same source before the row.

    The order inside a source is by a hash of the key, in chunks of about chunk_docs rows: chunk totals are summed over
    few rows, rows are summed inside their chunk, and no source has to pass through one task. A key of more rows than
    that (copies of one row) is salted by row into chunks of its own.
    """
    chunks = F.greatest(F.ceil(F.col("n") / chunk_docs), F.lit(1))
    counts = sizes.groupBy("source").agg(F.count("*").alias("n")).withColumnRenamed("source", "_source")
    placed = sizes.join(counts, sizes["source"].eqNullSafe(counts["_source"])).withColumn("chunk", F.pmod(F.xxhash64(F.lit("c"), "key"), chunks)).drop("n", "_source")
    hot = sizes.groupBy("key").agg(F.count("*").alias("copies")).where(F.col("copies") > chunk_docs)
    salt = F.coalesce(F.pmod(F.xxhash64("row"), F.ceil(F.col("copies") / chunk_docs)), F.lit(0))
    placed = placed.join(hot, "key", "left").withColumns({"hot": F.when(F.col("copies").isNull(), 0).otherwise(F.col("key")), "salt": salt}).drop("copies")
    part = ["chunk", "hot", "salt"]
    totals = placed.groupBy("source", *part).agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("source").orderBy(*part).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select(F.col("source").alias("_source"), *[F.col(c).alias(f"_{c}") for c in part], before.alias("_before"))
    inner = W.partitionBy("source", *part).orderBy("key", "row").rowsBetween(W.unboundedPreceding, -1)
    placed = placed.withColumn("_inner", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    same = [placed["source"].eqNullSafe(totals["_source"]), *[placed[c] == totals[f"_{c}"] for c in part]]
    placed = placed.join(totals, same)
    return placed.withColumn("offset", F.col("_before") + F.col("_inner")).drop("_source", "_before", "_inner", *part, *[f"_{c}" for c in part])


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", block: int = BLOCK_WORDS, seed: int = SEED,
        weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, shard_slots: int = SHARD_SLOTS, row: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents, parts, slots) of a mix.

    documents: row (a number for the row, or the column that `row` names), doc_id, source, size, source_size, target, taken. parts: the pieces of
    documents in the mix, with row, block, first (the piece's first word in the document), words, uses, and extra, how many
    of its first words are used once more. slots: draw().
    """
    spark = docs.sparkSession
    sizes = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(doc_id).alias("doc_id"), F.col(source).alias("source"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64(doc_id, text).alias("key"),
    )
    sizes = spark.read.parquet(write_shared(sizes, "sizes"))
    planned = spark.read.parquet(write_shared(plan(sizes, block, weights, most, seed).coalesce(1), "plan"))
    slots = draw(spark, planned, shard_slots, seed)
    uses = slots.groupBy(F.col("source").alias("_source"), F.col("block").alias("_block"))
    uses = uses.agg(F.count_if(F.col("last_words").isNull()).alias("uses"), F.coalesce(F.max("last_words"), F.lit(0)).alias("_part"))
    placed = streams(sizes).where("size > 0")
    end = F.col("offset") + F.col("size")
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("offset") / block), F.floor((end - 1) / block))))
    first = F.greatest(F.col("block") * block, F.col("offset"))
    cut = cut.select(
        "row", "source", "block", (first - F.col("offset")).alias("first"), (F.least((F.col("block") + 1) * block, end) - first).alias("words"),
        (first - F.col("block") * block).alias("_place"),
    )
    extra = F.greatest(F.least(F.col("words"), F.col("_part") - F.col("_place")), F.lit(0))
    parts = cut.join(uses, cut["source"].eqNullSafe(uses["_source"]) & (cut["block"] == uses["_block"]))
    parts = parts.select("row", "block", "first", "words", "uses", extra.alias("extra")).where("uses > 0 or extra > 0")
    taken = parts.groupBy("row").agg(F.sum(F.col("words") * F.col("uses") + F.col("extra")).alias("taken"))
    plans = planned.select(F.col("source").alias("_source"), "source_size", "target")
    out = sizes.join(plans, sizes["source"].eqNullSafe(plans["_source"])).join(taken, "row", "left")
    return out.select("row", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), parts, slots


def mixed_documents(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars", **how) -> DataFrame:
    """docs with the same columns, each text replaced by the words of it that the mix takes, a block's words as often
    as its block is drawn, with the white space between them; documents of which nothing is taken go."""
    spark = docs.sparkSession
    name, held = fresh("row", docs.columns), fresh("_parts", docs.columns)
    rows = numbered(docs, name)
    _, parts, _ = mix(rows, text=text, row=name, **how)
    parts = spark.read.parquet(write_shared(parts, "parts"))
    of_row = parts.groupBy(F.col("row").alias(name)).agg(F.array_sort(F.collect_list(F.struct("first", "words", "uses", "extra"))).alias(held))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))

    def piece(p: Column, w: Column, n: str) -> Column:
        return F.regexp_replace(F.array_join(F.slice(w, (p["first"] + 1).cast("int"), p[n].cast("int")), ""), r"^[\x20\x09-\x0D]+", "")

    def drawn(p: Column, w: Column) -> Column:
        return F.concat(F.array_repeat(piece(p, w, "words"), p["uses"].cast("int")), F.array_repeat(piece(p, w, "extra"), F.least(p["extra"], F.lit(1)).cast("int")))

    # the words are bound to a lambda variable, else each part would split the text anew
    joined = F.transform(F.array(words), lambda w: F.array_join(F.flatten(F.transform(held, lambda p: drawn(p, w))), " "))[0]
    out = rows.join(of_row, name).withColumn(text, joined)
    if n_chars in docs.columns:
        out = out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType))
    return out.select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _, _ = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return documents.select("doc_id", "size", "source_size", "target", "taken")
