"""Benchmark decontamination: an FM-index for each shard of the corpus, searched for the windows of test phrases.

A shard is the text of a few thousand documents inside one Spark task. Its index holds the words of the benchmark's
vocabulary as symbols; every other word is a separator, since no phrase spans it, and runs too short for the shortest
phrase are left out. Neither changes an answer. The index is a suffix array turned into a Burrows-Wheeler transform
held in a wavelet tree; phrases are found by backward search over its ranks and located by walking back to sampled
suffix positions. Overlapping occurrences merge into removal spans.

Defined results: a null or wordless text has no hits and empty spans; a null or wordless item has no windows; repeated
item ids count once; an item without an id goes by the name null; repeated documents each get their own row; a text
longer than a shard makes one alone, whole; a column that has the name of the result goes; empty tables give no rows or
no hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.common import fresh, pieces, table, utf8

WINDOW = 10
#: Bytes of benchmark text that one pass over the corpus carries to the executors; more text means more passes.
BLOCK_BYTES = 8 << 20
#: Bytes of corpus text in one FM-index.
SHARD_BYTES = 16 << 20
#: Windows that are searched at once.
PATTERNS = 1 << 16
#: Every SAMPLE-th suffix position is kept for locating.
SAMPLE = 4

_WORD_BYTES = bytes(
    (c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: bytes) -> list[bytes]:
    """Maximal runs of digits, letters a-z (A-Z lower-cased) and non-ASCII characters, in UTF-8."""
    return text.translate(_WORD_BYTES).split()


def word_spans(text: bytes) -> list[tuple[int, int]]:
    """Byte start and end of each word of words_of()."""
    spans, at, flat = [], 0, text.translate(_WORD_BYTES)
    for w in flat.split():
        at = flat.index(w, at)
        spans.append((at, at + len(w)))
        at += len(w)
    return spans


def suffix_array(keys: np.ndarray) -> np.ndarray:
    """Suffix array of distinct-ended integer symbols by prefix doubling; only unsettled suffixes are sorted again."""
    n = len(keys)
    _, rank = np.unique(keys, return_inverse=True)
    rank = rank.astype(np.int64)
    order = np.argsort(rank, kind="stable")
    settle = rank[order]
    start = np.flatnonzero(np.r_[True, settle[1:] != settle[:-1]]) if n else np.empty(0, np.int64)
    rank[order] = np.repeat(start, np.diff(np.r_[start, n]))  # a rank is the first place of its bucket
    step = 1
    while n and step < n:
        counts = np.bincount(rank, minlength=n)
        open_ = np.flatnonzero(counts[rank] > 1)
        if not len(open_):
            break
        later = np.where(open_ + step < n, rank[np.minimum(open_ + step, n - 1)] + 1, 0)
        by = np.lexsort((later, rank[open_]))
        pos, head, tail = open_[by], rank[open_][by], later[by]
        new_bucket = np.r_[True, head[1:] != head[:-1]]
        new_part = new_bucket | np.r_[True, tail[1:] != tail[:-1]]
        at = np.arange(len(pos))
        bucket_at = np.maximum.accumulate(np.where(new_bucket, at, 0))
        part_at = np.maximum.accumulate(np.where(new_part, at, 0))
        rank[pos] = head + (part_at - bucket_at)
        step *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class WaveletTree:
    """Rank queries over integer symbols, level by level from the top bit, with all nodes of a level side by side."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels = []
        seq = symbols.astype(np.int64)
        for bit in range(max(1, int(n_symbols - 1).bit_length()) - 1, -1, -1):
            ones = (seq >> bit) & 1
            packed = np.packbits(ones.astype(np.uint8), bitorder="little")
            packed = np.r_[packed, np.zeros(-len(packed) % 8 + 8, np.uint8)].view(np.uint64)
            before = np.r_[0, np.cumsum(np.bitwise_count(packed))[:-1]].astype(np.int64)
            zeros = int(len(seq) - ones.sum())
            self.levels.append((bit, packed, before, zeros))
            seq = np.r_[seq[ones == 0], seq[ones == 1]]

    @staticmethod
    def _ones(level, at: np.ndarray) -> np.ndarray:
        _, packed, before, _ = level
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return before[word] + np.bitwise_count(packed[word] & mask)

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        begin, end = np.zeros(len(at), np.int64), at.astype(np.int64)
        for level in self.levels:
            bit, _, _, zeros = level
            one = (symbols >> bit) & 1
            b1, e1 = self._ones(level, begin), self._ones(level, end)
            begin = np.where(one == 1, zeros + b1, begin - b1)
            end = np.where(one == 1, zeros + e1, end - e1)
        return end - begin

    def access(self, at: np.ndarray) -> np.ndarray:
        """The symbol at each place."""
        at, out = at.astype(np.int64), np.zeros(len(at), np.int64)
        for level in self.levels:
            bit, packed, _, zeros = level
            one = ((packed[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(np.int64)
            ones = self._ones(level, at)
            out |= one << bit
            at = np.where(one == 1, zeros + ones, at - ones)
        return out


class FMIndex:
    """Over symbols from 1; zeros separate runs and end the text. Each zero sorts as a symbol of its own."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        is_end = symbols == 0
        n_ends = int(is_end.sum())
        keys = np.where(is_end, np.cumsum(is_end) - 1, symbols + n_ends)
        sa = suffix_array(keys)
        before = symbols[sa - 1]  # the text ends in 0, which stands before its first symbol
        self.tree = WaveletTree(before, n_symbols)
        self.first = np.r_[0, np.cumsum(np.bincount(symbols, minlength=n_symbols))]
        kept = (sa % SAMPLE == 0) | (symbols[sa - 1] == 0)  # run starts too: no walk leaves its run
        self.kept_at = np.full(len(sa), -1, np.int64)
        self.kept_at[kept] = sa[kept]

    def find(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix-array ranges of patterns of one length, given as rows."""
        lo = np.zeros(len(patterns), np.int64)
        hi = np.full(len(patterns), self.first[-1], np.int64)
        for j in range(patterns.shape[1] - 1, -1, -1):
            c, live = patterns[:, j], np.flatnonzero(lo < hi)
            if not len(live):
                break
            lo[live] = self.first[c[live]] + self.tree.rank(c[live], lo[live])
            hi[live] = self.first[c[live]] + self.tree.rank(c[live], hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.arange(len(rows))
        while len(todo):
            known = self.kept_at[at[todo]]
            done = known >= 0
            out[todo[done]] = known[done] + steps[todo[done]]
            todo = todo[~done]
            c = self.tree.access(at[todo])
            at[todo] = self.first[c] + self.tree.rank(c, at[todo])
            steps[todo] += 1
        return out


def _named(rows: np.ndarray) -> np.ndarray:
    """Numbers for the windows of a sequence: equal pairs get equal numbers."""
    return np.unique(rows, return_inverse=True)[1].astype(np.int64)


def window_names(ids: np.ndarray, window: int) -> np.ndarray:
    """A number for the `window` ids at each place, equal for equal windows: by pairs of names of half the length."""
    name, length, power, size = None, 0, ids.astype(np.int64), 1
    while size <= window:
        if window & size:
            if name is None:
                name = power
            else:
                n = len(ids) - length - size + 1
                name = _named(name[:n] * (len(ids) + 1) + power[length : length + n])
            length += size
        if 2 * size <= window:
            power = _named(power[:-size] * (max(len(ids), int(power.max(initial=0))) + 1) + power[size:])
        size *= 2
    return name


class Phrases:
    """The windows of some benchmark items: vocabulary, windows by length, and the items of each window.

    Windows are places in one array of word numbers, so they cost a few numbers each, not a tuple of words.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.names = sorted({name for name, _ in items})
        number = {name: i for i, name in enumerate(self.names)}
        ids = [np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)), np.int32) for _, text in items]
        sizes, owner = np.array([len(x) for x in ids], np.int64), np.array([number[name] for name, _ in items], np.int64)
        self.flat = np.concatenate([*ids, np.empty(0, np.int32)])
        begin = np.cumsum(sizes) - sizes
        # (length, a place of each distinct window, where its items begin, items)
        self.by_length: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(np.minimum(sizes[sizes > 0], window)).tolist():
            of = np.flatnonzero(np.minimum(sizes, window) == n)
            count = sizes[of] - n + 1
            at = np.repeat(begin[of] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
            name, item = window_names(self.flat, n)[at], np.repeat(owner[of], count)
            by = np.lexsort((item, name))
            name, item, at = name[by], item[by], at[by]
            new = np.r_[True, (name[1:] != name[:-1]) | (item[1:] != item[:-1])]
            name, item, at = name[new], item[new], at[new]
            first = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
            self.by_length.append((n, at[first], np.r_[first, len(item)], item.astype(np.int32)))
        self.shortest = min((n for n, *_ in self.by_length), default=0)


def search(texts: list[bytes], phrases: Phrases) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
    """For each text: its number of words, merged spans of hit words [first, end), and the items found."""
    get = phrases.vocabulary.get
    counts, runs, where = [], [], []  # symbols of kept runs; document and first word of each
    for d, text in enumerate(texts):
        ids = np.fromiter((get(w, 0) for w in words_of(text)), np.int64)
        counts.append(len(ids))
        edge = np.diff(np.r_[0, ids > 0, 0])
        begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        for b, e in zip(begins, ends, strict=True):
            if e - b >= phrases.shortest > 0:
                runs += [ids[b:e], np.zeros(1, np.int64)]
                where.append((d, b, e - b + 1))
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    found: list[list[np.ndarray]] = [[] for _ in texts]
    if runs:
        doc, first, length = np.array(where, np.int64).T
        at = np.r_[0, np.cumsum(length)[:-1]]
        index = FMIndex(np.concatenate(runs), len(phrases.vocabulary) + 1)
        for width, place, starts, items in phrases.by_length:
            for part in range(0, len(place), PATTERNS):
                lo, hi = index.find(phrases.flat[place[part : part + PATTERNS, None] + np.arange(width)].astype(np.int64))
                hit = np.flatnonzero(lo < hi)
                n = hi[hit] - lo[hit]
                rows = np.repeat(lo[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                pos, which = index.locate(rows), np.repeat(hit + part, n)
                run = np.searchsorted(at, pos, side="right") - 1
                begin = first[run] + pos - at[run]
                for d, b in zip(doc[run].tolist(), begin.tolist(), strict=True):
                    spans[d].append((b, b + width))
                # each window of a document counts once, however often it occurs there
                seen = np.unique(np.stack([doc[run], which]), axis=1)
                for d, w in seen.T.tolist():
                    found[d].append(items[starts[w] : starts[w + 1]])
    names = [np.unique(np.concatenate(f)).tolist() if f else [] for f in found]
    return [(n, merge(s), [phrases.names[i] for i in f]) for n, s, f in zip(counts, spans, names, strict=True)]


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined."""
    out: list[list[int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([b, e])
    return [(b, e) for b, e in out]


def cut(text: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the words of the spans, nor what stands between them."""
    at, kept, words = 0, [], word_spans(text)
    for b, e in spans:
        kept.append(text[at : words[b][0]])
        at = words[e - 1][1]
    return b"".join([*kept, text[at:]]).decode()


def _item_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The items in blocks of about block_bytes; the driver holds one at a time."""
    block, held = [], 0
    rows = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")), F.coalesce(text, F.lit("")))
    for name, body in rows.toLocalIterator():
        body = body.encode()
        if block and held + len(body) > block_bytes:
            yield block
            block, held = [], 0
        block.append((name, body))
        held += len(body)
    yield block


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, out: str = "contamination", block_bytes: int = BLOCK_BYTES, shard_bytes: int = SHARD_BYTES, clean: bool = False,
) -> DataFrame:
    """docs with a struct column `out` (another of that name goes): n_words, spans (merged [first, end) word numbers) and item_ids (sorted strings).

    One map over the documents without a shuffle, whatever the size of the benchmark. It goes to the executors in blocks of
    bounded bytes; for each shard of text a task takes up one block after the other and lets go of it before the next, so
    it holds one at a time. With `clean` the spans are cut out of the texts too.
    """
    kind = "struct<n_words: bigint, spans: array<struct<first: int, end: int>>, item_ids: array<string>>"
    docs = docs.drop(out)
    at = docs.columns.index(text)
    docs = docs.withColumn(out, F.expr(f"cast(null as {kind})"))
    sent = docs.sparkSession.sparkContext.broadcast
    blocks = [sent(Phrases(items, window)) for items in _item_blocks(benchmark, item_id, item_text, block_bytes)]

    def scan(batches):
        for batch in pieces(batches, text, shard_bytes):
            bodies, cols = utf8(batch, text), batch.columns
            found = None
            for block in blocks:
                here = search(bodies, block.value)
                if len(blocks) > 1:
                    block.__dict__.pop("_value", None)  # read again from the executor's copy when its turn comes
                found = here if found is None else [(n, merge(a + b), sorted({*x, *y})) for (n, a, x), (_, b, y) in zip(found, here, strict=True)]
            rows = [{"n_words": n, "spans": [{"first": b, "end": e} for b, e in spans], "item_ids": names} for n, spans, names in found]
            cols[-1] = pa.array(rows, cols[-1].type)
            if clean:
                texts = [cut(t, spans) if spans else old.as_py() for t, (_, spans, _), old in zip(bodies, found, cols[at], strict=True)]
                cols[at] = pa.array(texts, cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(scan, docs.schema)


def remove_contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", n_chars: str = "n_chars", window: int = WINDOW) -> DataFrame:
    """docs with the same columns and rows, every benchmark window cut out of the text; a column n_chars follows it."""
    out = fresh("contamination", docs.columns)
    clean = find_contamination(docs, benchmark, text, window=window, out=out, clean=True)
    if n_chars in docs.columns:
        hit = F.size(F.col(out)["spans"]) > 0
        clean = clean.withColumn(n_chars, F.when(hit, F.length(text).cast(docs.schema[n_chars].dataType)).otherwise(F.col(n_chars)))
    return clean.drop(out)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    c = F.col("contamination")
    n_hit = F.aggregate(c["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["first"])
    return found.select(
        "doc_id", c["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(c["item_ids"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort(c["item_ids"]), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


#: Window joins in SQL; the words come from one pass over each table.
ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
g AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS n, array_to_string(ws[i:i + least(len(ws), 10) - 1], ' ') AS gram
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM g),
h AS (
  SELECT doc_id, item_id, i, n FROM (
    SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram
    FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, sizes WHERE len(ws) >= n)) d
  JOIN g USING (n, gram)),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
