"""Suffix-array dedup: every byte covered by a 100-byte string that also starts earlier is removed.

Sorting all suffixes of a corpus would shuffle every position. Only depth `length` matters, so the text is first put
into q-gram buckets at sampled places that any two equal strings share: a string of `length` bytes has one anchor, the
leftmost of its q-grams with the least hash. Buckets with one anchor in the whole corpus are settled: no string around
it occurs twice. The others are refined. An anchor's record holds the bytes of all strings that have it as anchor; the
records of a bucket come together, and inside a task all places of their strings get buckets of 8 bytes, which are refined
by sorting on two identifiers, that of the place and that of a later one: those of 8 bytes give those of 16, these those
of 32, and so on to `length`, with settled places left out. Equal identifiers mean equal bytes; hashes only choose anchors
and deal them out. A record that equals an earlier one repeats each of its strings, and is not refined.

Buckets with more records than `hot` are not brought together: their copies are found as a table. Then each is refined as
one: the offsets d are halved, and a record goes to the bucket of the bytes that all its strings of one half share,
`length` less the width of the half. A new bucket is refined in its turn, inside a task where it is small enough, else by
halving again, down to single offsets, where equal bytes are equal strings and only the earliest stays.

Defined results: a null or empty text has no bytes and nothing removed; a text shorter than `length` keeps all; a long
text is hashed in stretches that overlap, whole; order is by doc_id (null first), then, for rows that repeat one, by a
hash of the text; of rows equal in both one counts as the first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marketlake.llm.common import KEY, drop_shared, keyed, nth, pieces, release, table, trim, utf8, write_shared

LENGTH = 100
GRAM = 32
HOT = 10_000
#: Bytes of text that are hashed at once, so that the arrays stay in a core's cache.
STRETCH = 1 << 18
#: Records that a task refines at once, but for the last bucket of them.
GROUP_ROWS = 10_000
#: Least number of parts over which equal records of a hot bucket are dealt; more, so that none has over `hot` of them.
SALTS = 64

_P = 0x9E3779B97F4A7C15
_PLACE_BITS = np.uint64(20)
assert STRETCH + 4096 < 1 << 20


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64."""

    def __init__(self, n: int):
        ups, downs = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 1 << 64), np.uint64)
        ups[0] = downs[0] = 1
        self.up, self.down = np.cumprod(ups, dtype=np.uint64), np.cumprod(downs, dtype=np.uint64)


def gram_hashes(data: np.ndarray, gram: int, powers: Powers) -> np.ndarray:
    """A hash of the `gram` bytes at each place; the same bytes have the same hash anywhere."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(data * powers.up[:n], out=sums[1:])
    h = (sums[gram:] - sums[:-gram]) * powers.down[: n - gram + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def anchors(data: np.ndarray, ends: np.ndarray, powers: Powers, length: int = LENGTH, gram: int = GRAM):
    """(place, first, last, hash) of each anchor: the strings that start at first .. last inside one text have it.

    data holds texts one after the other, ends where each ends. A string's anchor is the leftmost of its grams with the
    least hash, up to the bits that hold the place; equal strings agree on it, wherever they lie.
    """
    n = len(data)
    if n < length:
        return tuple(np.empty(0, np.int64) for _ in range(3)) + (np.empty(0, np.uint64),)
    h = gram_hashes(data, gram, powers)
    least = (h >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    window, have = length - gram + 1, 1
    while 2 * have <= window:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < window:
        least = np.minimum(least[: len(least) - (window - have)], least[window - have :])
    at = (least & ((np.uint64(1) << _PLACE_BITS) - np.uint64(1))).astype(np.int64)
    inside = np.zeros(n + 1, bool)
    begins = np.r_[0, ends[:-1]]
    whole = np.maximum(ends - length + 1, begins)
    edge = np.zeros(n + 2, np.int32)
    np.add.at(edge, begins, 1)
    np.add.at(edge, whole, -1)
    inside = np.cumsum(edge)[: len(at)] > 0
    new = np.r_[True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])]
    new[begins[begins < len(at)]] = True
    first = np.flatnonzero(new)
    last = np.r_[first[1:], len(at)] - 1
    ok = inside[first]
    first, last = first[ok], last[ok]
    return at[first], first, last, h[at[first]]


def stretches(texts: list[bytes], length: int, most: int = STRETCH) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """(bytes, ends, [(text, offset)]): texts put together up to `most` bytes; a longer one in parts that overlap."""
    parts: list[bytes] = []
    whose: list[tuple[int, int]] = []
    held = 0
    for t, text in enumerate(texts):
        for begin in range(0, max(1, len(text) - length + 1), most):
            part = text if len(text) <= most + length - 1 else text[begin : begin + most + length - 1]
            if len(part) >= length:
                if held and held + len(part) > most:
                    yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), whose
                    parts, whose, held = [], [], 0
                parts.append(part)
                whose.append((t, begin))
                held += len(part)
            if len(text) <= most + length - 1:
                break
    if parts:
        yield np.frombuffer(b"".join(parts), np.uint8), np.cumsum([len(p) for p in parts]), whose


def all_anchors(texts: list[bytes], powers: Powers, length: int, gram: int):
    """(text, place, first, last, hash) arrays of every text, places inside the text."""
    out = []
    for data, ends, whose in stretches(texts, length):
        at, first, last, h = anchors(data, ends, powers, length, gram)
        part = np.searchsorted(ends, at, side="right")
        shift = np.array([o for _, o in whose]) - np.r_[0, ends[:-1]]
        out.append((np.array([t for t, _ in whose])[part], at + shift[part], first + shift[part], last + shift[part], h))
    if not out:
        return tuple(np.empty(0, np.int64) for _ in range(4)) + (np.empty(0, np.uint64),)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


# --- refinement of buckets ------------------------------------------------------------------------------------------


def grams(flat: np.ndarray, q: int) -> np.ndarray:
    """The q <= 8 bytes at each place as one number."""
    out = np.zeros(len(flat) - q + 1, np.uint64)
    for i in range(q):
        out = out << np.uint64(8) | flat[i : i + len(out)]
    return out


def bucketed(places: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> None:
    """Write each place's bucket to ids: the least of the places that have the same key."""
    if not len(places):
        return
    order = np.argsort(keys)
    keys, by = keys[order], places[order]
    heads = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    ids[by] = np.repeat(np.minimum.reduceat(by, heads), np.diff(np.r_[heads, len(by)]))


def refined(flat: np.ndarray, strings: np.ndarray, length: int) -> np.ndarray:
    """For each place, where a string of `length` bytes starts, the least place in `strings` whose string is equal.

    Bucket-pointer refinement. q-grams give the first buckets. A bucket of depth k is refined to depth k + step by sorting
    its places on two identifiers, its own and that of the place `step` bytes later, both of depth k; the identifiers of
    the finer buckets take their stead in the next round, which so reaches twice as deep. Buckets of one place are settled:
    their place is their identifier at every depth, and they are not sorted again.
    """
    depths = [min(8, length)]
    while depths[-1] < length:
        depths.append(min(2 * depths[-1], length))
    # which places a depth needs: those of the depth after it, and the ones that these point to
    needs = [np.zeros(len(flat), bool)]
    needs[0][strings] = True
    for low, high in zip(depths[-2::-1], depths[:0:-1], strict=True):
        need = needs[-1].copy()
        need[high - low :] |= needs[-1][: len(flat) - (high - low)]
        needs.append(need)
    needs.reverse()
    places = np.flatnonzero(needs[0])
    ids = np.arange(len(flat))
    bucketed(places, grams(flat, depths[0])[places], ids)
    for need, low, high in zip(needs[1:], depths, depths[1:], strict=False):
        n_in = np.bincount(ids[places], minlength=len(flat))
        places = np.flatnonzero(need)
        open_ = places[n_in[ids[places]] > 1]
        finer = np.arange(len(flat))
        bucketed(open_, ids[open_] * len(flat) + ids[open_ + high - low], finer)
        ids = finer
    return ids[strings]


def later_strings(flat: np.ndarray, start: np.ndarray, left: np.ndarray, last: np.ndarray, length: int) -> np.ndarray:
    """For records in the order of the corpus, a matrix [record, d]: the string that starts d bytes before the anchor
    is one of the record's and occurs in an earlier record.

    A record's bytes begin at flat[start] with its first string; its anchor is `left` bytes on and its last string
    starts `last` bytes before the anchor. Equal strings have the same anchor, so no two of one record are equal.
    """
    many = left - last + 1
    record = np.repeat(np.arange(len(start)), many)
    at = np.arange(len(record)) - np.repeat(np.cumsum(many) - many, many)
    strings = start[record] + at
    later = np.zeros((len(start), int(left.max(initial=0)) + 1), bool)
    later[record, left[record] - at] = refined(flat, strings, length) != strings
    return later


# --- Spark jobs -----------------------------------------------------------------------------------------------------

_RECORD = "h bigint, doc_id bigint, uid bigint, first int, lead int, tail int, body binary"


def refine(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Records sorted by bucket and order in the corpus to (doc_id, uid, begin, end) of their strings that occur earlier too."""
    held: list[pa.Table] = []
    rows = 0

    def settle(part: pa.Table) -> pa.RecordBatch:
        h, uid, first = (part[c].to_numpy() for c in ("h", "uid", "first"))
        again = np.r_[False, (h[1:] == h[:-1]) & (uid[1:] == uid[:-1]) & (first[1:] == first[:-1])]
        if again.any():  # of rows equal in id and text one speaks for all
            part = part.filter(pa.array(~again))
            h, uid, first = h[~again], uid[~again], first[~again]
        part = part.combine_chunks()
        bodies = part["body"].combine_chunks()
        bodies = bodies.chunk(0) if isinstance(bodies, pa.ChunkedArray) else bodies
        offsets = np.frombuffer(bodies.buffers()[1], np.int32)[bodies.offset : bodies.offset + len(bodies) + 1].astype(np.int64)
        flat = np.frombuffer(bodies.buffers()[2] or b"\0", np.uint8)
        lead, tail = part["lead"].to_numpy().astype(np.int64), part["tail"].to_numpy().astype(np.int64)
        # a record that equals an earlier one repeats each of its strings; the others are refined
        kind = bodies.dictionary_encode().indices.to_numpy().astype(np.int64) * (lead.max() + 1) + lead
        fresh = np.zeros(len(kind), bool)
        fresh[np.unique(kind, return_index=True)[1]] = True
        d = np.arange(lead.max() + 1)
        later = ~fresh[:, None] & (tail[:, None] <= d) & (d <= lead[:, None])
        found = later_strings(flat, offsets[:-1][fresh], lead[fresh], tail[fresh], length)
        later[np.flatnonzero(fresh), : found.shape[1]] = found
        # runs of starts, from the largest d (the earliest start) down
        edge = np.diff(np.pad(later, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, low = np.nonzero(edge == 1)
        _, high = np.nonzero(edge == -1)
        anchor = first.astype(np.int64)[row] + lead[row]
        return pa.RecordBatch.from_arrays([part["doc_id"].combine_chunks().take(pa.array(row)), pa.array(uid[row], pa.int64()), pa.array(anchor - (high - 1)), pa.array(anchor - low + length)], names=["doc_id", "uid", "begin", "end"])

    for batch in batches:
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows >= GROUP_ROWS:
            now = pa.concat_tables(held)
            h = now["h"].to_numpy()
            cut = int(np.searchsorted(h, h[-1]))  # the last bucket may go on
            if cut:
                yield settle(now.slice(0, cut))
            held, rows = [now.slice(cut)], now.num_rows - cut
    if rows:
        yield settle(pa.concat_tables(held))
    trim()


def halved(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Records over the offsets low .. high as records over each half, in the bucket of the bytes that a half's strings share."""
    import xxhash

    for batch in pieces(batches, "body", 1 << 20):
        out = []
        for r in batch.to_pylist():
            lead, tail, body, middle = r["lead"], r["tail"], r["body"], (r["low"] + r["high"]) // 2
            for low, high in ((r["low"], middle), (middle + 1, r["high"])):
                far, near = min(lead, high), max(tail, low)
                if low <= high and near <= far:
                    shared = body[lead - low : lead - high + length]
                    h = xxhash.xxh64_intdigest(shared, low * length + high)
                    out.append((h - (1 << 63), r["doc_id"], r["uid"], r["first"] + lead - far, far, near, body[lead - far : lead - near + length], low, high))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32())
        columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["h", "doc_id", "uid", "first", "lead", "tail", "body", "low", "high"])


def _later(rows: DataFrame, same: list[str], length: int, salts: int) -> tuple[DataFrame, DataFrame]:
    """(the earliest of each group of records equal in `same`; spans of all strings of the other ones).

    A group is dealt over `salts` parts. What is not the first of its part is a later one; only the first ones are joined.
    """
    place = F.struct("doc_id", "uid", "first")
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("uid", "first"), F.lit(salts)))
    salted = salted.withColumn("turn", F.row_number().over(W.partitionBy(*same, "salt").orderBy(F.col("doc_id").asc_nulls_first(), "uid", "first")))
    firsts = salted.where("turn = 1")
    earliest = firsts.groupBy(*same).agg(F.min(place).alias("place"))
    others = salted.where("turn > 1").select("doc_id", "uid", "first", "lead", "tail")
    others = others.unionByName(firsts.join(earliest, same).where("uid != place.uid or first != place.first").select("doc_id", "uid", "first", "lead", "tail"))
    spans = others.select("doc_id", "uid", F.col("first").cast("long").alias("begin"), (F.col("first") + F.col("lead") - F.col("tail") + length).cast("long").alias("end"))
    return earliest.select(*same, "place.*"), spans


def repeated_spans(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, uid, begin, end): bytes of documents of keyed() covered by strings that start earlier too; unmerged."""
    spark = docs.sparkSession
    powers = spark.sparkContext.broadcast(Powers(STRETCH + 2 * length))

    def find(batches):
        for batch in pieces(batches, "text", 2 << 20):
            text, at, _, _, h = all_anchors(utf8(batch, "text"), powers.value, length, gram)
            uid = batch.column(0).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(uid[text], pa.int64()), pa.array(at.astype(np.int32))], names=["h", "uid", "at"])

    found = docs.select("uid", "text").mapInArrow(find, "h bigint, uid bigint, at int")
    buckets = found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
    open_ = found.join(buckets, "h").withColumn("hot", F.col("n") > hot).groupBy("uid", "hot").agg(F.collect_set("at").alias("open"))
    # written, so that the shuffles of all anchors are done with before texts move
    open_at = write_shared(open_, "open-anchors")
    open_ = spark.read.parquet(open_at)
    release(spark)

    def records(batches):
        for batch in pieces(batches, "text", 2 << 20):
            texts = utf8(batch, "text")
            text, at, first, last, h = all_anchors(texts, powers.value, length, gram)
            marks = batch.column(3)
            owner = np.repeat(np.arange(len(marks)), np.diff(marks.offsets.to_numpy()))
            place = marks.flatten().to_numpy().astype(np.int64)
            wide = np.int64(1) << 40
            kept = np.isin(text * wide + at, owner * wide + place)
            t, a, f, l = text[kept], at[kept], first[kept], last[kept]
            body = [texts[i][b : e + length] for i, b, e in zip(t.tolist(), f.tolist(), l.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([
                pa.array(h[kept].view(np.int64)), batch.column(1).take(pa.array(t)), batch.column(0).take(pa.array(t)), pa.array(f.astype(np.int32)),
                pa.array((a - f).astype(np.int32)), pa.array((a - l).astype(np.int32)), pa.array(body, pa.binary()),
            ], names=["h", "doc_id", "uid", "first", "lead", "tail", "body"])

    def made(marks: DataFrame) -> DataFrame:
        return docs.join(marks, "uid").select("uid", "doc_id", "text", "open").mapInArrow(records, _RECORD)

    def inside(rows: DataFrame) -> DataFrame:
        """Buckets that a task refines."""
        rows = rows.select("h", "doc_id", "uid", "first", "lead", "tail", "body").repartition(F.col("h"))
        rows = rows.sortWithinPartitions("h", F.col("doc_id").asc_nulls_first(), "uid", "first")
        return rows.mapInArrow(lambda b: refine(b, length), "doc_id bigint, uid bigint, begin bigint, end bigint")

    spans, tables = [inside(made(open_.where("not hot")))], [open_at]
    if not open_.where("hot").isEmpty():
        tables.append(write_shared(made(open_.where("hot")), "hot-records"))
        # of rows equal in id and text one speaks for all
        hot_records = spark.read.parquet(tables[-1]).dropDuplicates(["h", "doc_id", "uid", "first"])
        salts = max(SALTS, spark.read.parquet(tables[-1]).count() // hot)
        rows, again = _later(hot_records, ["h", "lead", "tail", "body"], length, salts)
        spans.append(again)
        rows = rows.withColumns({"low": F.lit(0), "high": F.lit(length - gram)})
        kind = f"{_RECORD}, low int, high int"
        while True:
            tables.append(write_shared(rows.mapInArrow(lambda b: halved(b, length), kind), "halved"))
            rows = spark.read.parquet(tables[-1])
            sizes = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
            rows = rows.join(sizes, "h")
            spans.append(inside(rows.where(F.col("n") <= hot)))
            rows = rows.where(F.col("n") > hot).drop("n")
            spans.append(_later(rows.where("low = high"), ["body", "low"], length, salts)[1])
            rows = rows.where("low < high")
            if rows.isEmpty():
                break
    out = spark.read.parquet(write_shared(reduce(DataFrame.unionByName, spans).groupBy("doc_id", "uid").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans"))
    for path in tables:
        drop_shared(spark, path)
    release(spark)
    return out


def merged_spans(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Touching or overlapping spans joined."""
    by = np.argsort(begin, kind="stable")
    begin, end = begin[by], np.maximum.accumulate(end[by]) if len(end) else end
    new = np.r_[True, begin[1:] > end[:-1]] if len(begin) else np.empty(0, bool)
    first = np.flatnonzero(new)
    return begin[first], end[np.r_[first[1:] - 1, len(end) - 1]] if len(first) else end


def cut_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, spans (array<struct<begin, end>> of removed bytes) and kept (the bytes left) of every document."""
    docs = keyed(docs, doc_id, text)
    spans = repeated_spans(docs, length, gram, hot)
    spans = spans.select("uid", F.coalesce("doc_id", F.lit(0)).alias("id0"), F.col("doc_id").isNull().alias("no_id"), "spans")
    span = pa.struct([("begin", pa.int64()), ("end", pa.int64())])

    def cut(batches):
        for batch in pieces(batches, "text", 2 << 20):
            texts, marks, times = utf8(batch, "text"), batch.column(2), batch.column(3).to_pylist()
            rows, kept = [], []
            for body, found, time in zip(texts, marks, times, strict=True):
                if time > 1 and len(body) >= length:  # the same row again: each of its strings has been there
                    rows.append([{"begin": 0, "end": len(body)}])
                    kept.append(b"")
                    continue
                if not found.is_valid or not len(found):
                    rows.append([])
                    kept.append(body)
                    continue
                fields = found.values
                begin, end = merged_spans(fields.field(0).to_numpy(), fields.field(1).to_numpy())
                rows.append([{"begin": b, "end": e} for b, e in zip(begin.tolist(), end.tolist(), strict=True)])
                at = np.r_[0, end].tolist()
                kept.append(b"".join(body[b:e] for b, e in zip(at, np.r_[begin, len(body)].tolist(), strict=True)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(rows, pa.list_(span)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])

    both = nth(docs.join(spans, KEY, "left")).select("doc_id", "text", "spans", "nth")
    return both.mapInArrow(cut, "doc_id bigint, n_bytes bigint, spans array<struct<begin: bigint, end: bigint>>, kept binary")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["begin"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
