"""Ranked lexical search over a two-level quantised index.

The index is a table with one row for each shard of some megabytes of text. Its first level has, for each term of the
shard, the documents that hold it and one byte each: the impact of the term in that document, rounded up to steps of
STEP. The second level has the exact counts and the documents' lengths; Parquet reads it only when it is asked for.

A search takes three passes over the index and none over the texts. The first counts in how many documents each query
term occurs, which gives the weights. The second sums the weighted bytes of each document: an upper bound of its score,
and, one step less a term, a lower bound; the k-th largest lower bound of an item is its threshold. The third scores in
whole numbers every document whose upper bound reaches the threshold, and the best k of these are the best of all.

Queries go to the executors in blocks of bounded bytes, each with passes of its own; a pass hands on k rows a shard and
item at most. Nothing that is broadcast or collected grows with the documents.

Defined results: null and empty texts have no term, so they are found by no query and find nothing; each row of the
documents is a document and each row of the queries a query of its own, repeated ids too; equal scores are ordered by
doc_id, null first; only the named columns are read, so others may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlake.llm.common import pieces, table, trim, utf8, write_shared

K = 20
#: Fixed values of the score: a term's impact is below ONE, length counts a quarter.
ONE, TF, LENGTH = 1_000_000_000, 1000, 12
BASE, SHARE = 75, 25
#: Impacts lie in 0..1,000,000; a byte holds them in steps, rounded up.
STEP = -(-(ONE // TF) // 255)
SHARD_BYTES = 8 << 20
BLOCK_BYTES = 8 << 20

#: Term characters lower-cased, all others to a space.
_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))

_SHARD = "terms array<binary>, counts array<int>, docs binary, impacts binary, tfs binary, lengths binary, doc_ids array<bigint>"


def terms(text: bytes) -> list[bytes]:
    return text.translate(_TERM).split()


@dataclass(frozen=True)
class Index:
    """rows: the shards; n_docs: documents with a term; n_terms: all their terms."""

    rows: DataFrame
    n_docs: int
    n_terms: int


def sizes(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(documents with a term, terms in all): places where a term begins are counted in the bytes, no term is built."""
    inside = np.frombuffer(_TERM, np.uint8) != 32

    def count(batches):
        n = total = 0
        for batch in pieces(batches, text):
            bodies = utf8(batch, text)
            within = inside[np.frombuffer(b"\n".join([b"", *bodies]), np.uint8)]
            begins = np.flatnonzero(within[1:] & ~within[:-1]) + 1
            ends = np.cumsum([len(b) + 1 for b in bodies])
            each = np.diff(np.searchsorted(begins, np.r_[0, ends + 1]))
            n, total = n + int((each > 0).sum()), total + int(each.sum())
        yield pa.RecordBatch.from_pydict({"n": [n], "total": [total]})

    found = docs.select(text).mapInArrow(count, "n bigint, total bigint").agg(F.sum("n"), F.sum("total")).first()
    return found[0] or 0, found[1] or 0


def impact(tf: np.ndarray, length: np.ndarray) -> np.ndarray:
    return (ONE * tf) // (TF * tf + LENGTH * length)


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """The index of all documents, written to the shared folder."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n_docs, n_terms = sizes(docs)

    def shards(batches):
        for batch in pieces(batches, "text", shard_bytes):
            vocabulary: dict[bytes, int] = {}
            which, counts, each, length = [], [], [], []
            for body in utf8(batch, "text"):
                words = terms(body)
                found = Counter(words)
                which += [vocabulary.setdefault(w, len(vocabulary)) for w in found]
                counts += found.values()
                each.append(len(found))
                length.append(BASE + SHARE * len(words) * n_docs // max(n_terms, 1))
            which, tf, length = np.array(which, np.int32), np.array(counts, np.int64), np.array(length, np.int64)
            order = np.argsort(which, kind="stable")
            doc = np.repeat(np.arange(len(each), dtype=np.int32), each)[order]
            tf = tf[order]
            bounds = -(-impact(tf, length[doc]) // STEP)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([list(vocabulary)], pa.list_(pa.binary())), pa.array([np.bincount(which, minlength=len(vocabulary)).astype(np.int32)]), pa.array([doc.tobytes()]),
                    pa.array([bounds.astype(np.uint8).tobytes()]), pa.array([tf.astype(np.int32).tobytes()]), pa.array([length.tobytes()]), pa.array([batch.column(0).to_pylist()], pa.list_(pa.int64())),
                ],
                names=["terms", "counts", "docs", "impacts", "tfs", "lengths", "doc_ids"],
            )
        trim()

    # a row group for each shard, so that a task that writes or reads shards holds one at a time
    path = write_shared(docs.mapInArrow(shards, _SHARD), "lexical-index", group_rows=1)
    return Index(docs.sparkSession.read.parquet(path), n_docs, n_terms)


def weight(df: int, n_docs: int) -> int:
    """Larger for rarer terms; at least 0."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


@dataclass
class Block:
    """Queries: their ids, and for each the places of its terms among `words` and how often it has them."""

    ids: list
    words: list[bytes]
    items: list[tuple[np.ndarray, np.ndarray]]
    threshold: np.ndarray | None = None

    @staticmethod
    def of(rows: list[tuple]) -> Block:
        known: dict[bytes, int] = {}
        items = []
        for _, body in rows:
            found = Counter(terms((body or "").encode()))
            items.append((np.array([known.setdefault(w, len(known)) for w in found], np.int64), np.array(list(found.values()), np.int64)))
        return Block([r[0] for r in rows], list(known), items)

    def weighted(self, weights: dict[int, int]) -> Block:
        """Counts times weights; terms that no document holds go."""
        items = []
        for places, counts in self.items:
            w = np.array([weights.get(int(p), 0) for p in places], np.int64)
            items.append((places[w > 0], (counts * w)[w > 0]))
        return Block(self.ids, self.words, items)


def _blocks(queries: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[Block]:
    """Queries in blocks of about block_bytes; the driver holds one at a time."""
    rows, held = [], 0
    for row in queries.select(item_id, text).toLocalIterator():
        size = len((row[1] or "").encode())
        if rows and held + size > block_bytes:
            yield Block.of(rows)
            rows, held = [], 0
        rows.append(tuple(row))
        held += size
    if rows:
        yield Block.of(rows)


def _postings(row: dict, words: list[bytes]) -> dict[int, slice]:
    """Where the postings of the block's terms lie in a shard's arrays."""
    at = pc.index_in(pa.array(words, pa.binary()), value_set=row["terms"]).to_pylist()
    ends = np.cumsum(row["counts"])
    return {n: slice(int(ends[i - 1]) if i else 0, int(ends[i])) for n, i in enumerate(at) if i is not None}


def _shards(batches) -> Iterator[dict]:
    for batch in batches:
        for n in range(batch.num_rows):
            row = {}
            for name, column in zip(batch.schema.names, batch.columns, strict=True):
                value = column[n]
                if name == "terms":
                    row[name] = value.values
                elif name in ("counts", "doc_ids"):
                    row[name] = value.values.to_numpy() if name == "counts" else value.values
                else:
                    row[name] = np.frombuffer(value.as_buffer(), {"docs": np.int32, "impacts": np.uint8, "tfs": np.int32, "lengths": np.int64}[name])
            yield row
    trim()


def _document_counts(index: Index, block: Block) -> dict[int, int]:
    """In how many documents each term of the block occurs."""
    sent = index.rows.sparkSession.sparkContext.broadcast(block.words)

    def count(batches):
        for row in _shards(batches):
            found = _postings(row, sent.value)
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([s.stop - s.start for s in found.values()], pa.int64())], names=["place", "n"])

    rows = index.rows.select("terms", "counts").mapInArrow(count, "place bigint, n bigint")
    return {r[0]: r[1] for r in rows.groupBy("place").agg(F.sum("n").alias("n")).collect()}


def _bounds(row: dict, block: Block, n_docs: int, lower: bool) -> Iterator[tuple[int, dict[int, slice], np.ndarray, np.ndarray | None]]:
    """For each item with a term in the shard: its number, the postings, upper and (if asked) lower bounds of all documents."""
    found = _postings(row, block.words)
    docs, steps = row["docs"], row["impacts"].astype(np.int64)
    for n, (places, weights) in enumerate(block.items):
        here = [(found[p], w) for p, w in zip(places.tolist(), weights.tolist(), strict=True) if p in found]
        if not here:
            continue
        upper, less = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64) if lower else None
        for at, w in here:
            upper[docs[at]] += w * steps[at]
            if lower:
                less[docs[at]] += w * (steps[at] > 0)
        yield n, found, upper * STEP, (upper - less) * STEP if lower else None


def _thresholds(index: Index, block: Block, k: int) -> np.ndarray:
    """For each item the k-th largest lower bound; 0 where fewer documents hold a term of it."""
    sent = index.rows.sparkSession.sparkContext.broadcast(block)

    def scan(batches):
        for row in _shards(batches):
            items, bounds = [], []
            for n, _, upper, lower in _bounds(row, sent.value, len(row["doc_ids"]), True):
                lower = lower[upper > 0]
                best = lower if len(lower) <= k else np.partition(lower, len(lower) - k)[-k:]
                items.append(np.full(len(best), n))
                bounds.append(best)
            if items:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(items), pa.int64()), pa.array(np.concatenate(bounds), pa.int64())], names=["item", "bound"])

    rows = index.rows.select("terms", "counts", "docs", "impacts", "doc_ids").mapInArrow(scan, "item bigint, bound bigint")
    nth = rows.withColumn("nth", F.row_number().over(W.partitionBy("item").orderBy(F.desc("bound")))).where(F.col("nth") <= k)
    out = np.zeros(len(block.items), np.int64)
    for r in nth.where(F.col("nth") == k).collect():  # one row an item of the block at most
        out[r["item"]] = r["bound"]
    return out


def search(index: Index, queries: DataFrame, k: int = K, item_id: str = "item_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item_id, rank (from 1), doc_id and score of each query's k best documents; fewer where fewer score above 0."""
    spark = index.rows.sparkSession
    schema = T.StructType([T.StructField("item", T.LongType()), T.StructField("item_id", queries.schema[item_id].dataType), T.StructField("doc_id", T.LongType()), T.StructField("score", T.LongType())])
    found = spark.createDataFrame([], schema)
    first = 0
    for block in _blocks(queries, item_id, text, block_bytes):
        block = block.weighted({p: weight(n, index.n_docs) for p, n in _document_counts(index, block).items()})
        sent = spark.sparkContext.broadcast(Block(block.ids, block.words, block.items, _thresholds(index, block, k)))

        def score(batches, sent=sent, first=first):
            block = sent.value
            for row in _shards(batches):
                out = []
                ids = np.array([-(1 << 63) if d is None else d for d in row["doc_ids"].to_pylist()], np.int64)  # for the order alone
                for n, found, upper, _ in _bounds(row, block, len(ids), False):
                    reach = (upper > 0) & (upper >= block.threshold[n])
                    total = np.zeros(len(ids), np.int64)
                    for p, w in zip(*(x.tolist() for x in block.items[n]), strict=True):
                        if p in found:
                            docs = row["docs"][found[p]]
                            kept = reach[docs]
                            docs, tf = docs[kept], row["tfs"][found[p]][kept].astype(np.int64)
                            total[docs] += w * impact(tf, row["lengths"][docs])
                    best = np.flatnonzero(total > 0)
                    best = best[np.lexsort((ids[best], -total[best]))[:k]]
                    out.append((n, best, total[best]))
                if out:
                    at, items = pa.array(np.concatenate([b for _, b, _ in out])), np.concatenate([np.full(len(b), n) for n, b, _ in out])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(items + first), pa.array([block.ids[i] for i in items], schema_type), row["doc_ids"].take(at), pa.array(np.concatenate([s for _, _, s in out]))],
                        names=["item", "item_id", "doc_id", "score"],
                    )

        schema_type = pa.schema(_arrow(schema))[1].type
        found = found.unionByName(index.rows.mapInArrow(score, schema))
        first += len(block.items)
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_first("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))


#: Every document is scored exactly; no bounds.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
n AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n FROM d WHERE len(ws) > 0),
s AS (SELECT count(*) AS nn, CAST(sum(n) AS BIGINT) AS ll FROM n),
m AS (SELECT doc_id, 75 + (25 * n * nn) // ll AS m FROM n, s),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(ws) AS term FROM d) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), s),
q AS (SELECT item_id, term, count(*) AS q FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
r AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score FROM q JOIN w USING (term) JOIN p USING (term) JOIN m USING (doc_id) GROUP BY ALL),
k AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM r WHERE score > 0)
SELECT * FROM k WHERE rank <= 20
"""
