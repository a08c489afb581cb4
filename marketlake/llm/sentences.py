"""Substring dedup by sliding sentence spans: hash runs of consecutive sentences, join globally, cut later copies.

A sentence is a stretch without line breaks up to and with its closing marks. One of more than WINDOW words is cut where
its content says: of every WINDOW consecutive words the least one (in byte order, the first of equals) begins a piece,
so that two texts that share a passage cut it alike, wherever it stands in their sentences. A run is RUN sentences or
pieces and those that follow until it has LEAST_WORDS words or LEAST_BYTES bytes or the text ends, so the last RUN
sentences of a text are a run however short they are. Any passage of 51 words that two
texts share holds pieces of 29 words at least that both cut alike, so it holds a run. Of all places in the corpus with
the same run, in the order of doc_id and place, every one but the first has its sentences removed. Sentences compare
with A-Z lower-cased and white space as single spaces.

Runs are hashed to 128 bits. Places whose first 64 bits occur once are settled by a count; of the others the earliest place
of a run comes from an aggregate that combines before the shuffle; the
join back to the places is a plain equi-join that Spark may split where one run is very common.

Defined results: a null or wordless text has no sentences; a text of fewer than RUN sentences keeps all; a long
text is cut and hashed whole; order is by doc_id (null first), then, for rows that repeat one, by a hash of the text;
of rows equal in both one counts as the first; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.common import KEY, drop_shared, keyed, nth, pieces, release, table, utf8, write_shared

RUN = 2
WINDOW = 12
LEAST_WORDS = 18
#: A run of so many bytes counts with fewer words too: scripts without spaces have a line for a word.
LEAST_BYTES = 150

#: Marks that close a sentence. In bytes the longer ones are first overwritten with a byte that no text holds.
_ENDS = ".!?。！？؟।"
_LONG_ENDS = [(m.encode(), b"\xff" * len(m.encode())) for m in _ENDS if not m.isascii()]
_SENTENCE = re.compile(rb"[^.!?\xff\n]+[.!?\xff]*")
_SPACE = b" \t\n\x0b\x0c\r"
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def piece_starts(words: list[bytes], window: int = WINDOW) -> list[int]:
    """Where the pieces of a sentence begin: at its first word and at the least word of each window."""
    starts, least = [0], -1
    for i in range(len(words) - window + 1):
        if least < i:
            least = words.index(min(words[i : i + window]), i)
        elif words[i + window - 1] < words[least]:
            least = i + window - 1
        else:
            continue
        if least:
            starts.append(least)
    return starts


def sentences(text: bytes, window: int = WINDOW) -> list[tuple[int, int, int, bytes]]:
    """(begin, end, words, folded text) of each sentence or piece, in bytes of the text."""
    out = []
    low = marked = text.translate(_FOLD)
    if not text.isascii():
        for mark, instead in _LONG_ENDS:
            marked = marked.replace(mark, instead)
    for s in _SENTENCE.finditer(marked):
        at, end = s.span()
        part = low[at:end]
        words = part.split()  # at the six spaces
        if not words:
            continue
        at, part = at + len(part) - len(part.lstrip(_SPACE)), part.strip(_SPACE)
        folded = b" ".join(words)
        if len(words) <= window:
            out.append((at, at + len(part), len(words), folded))
            continue
        starts = piece_starts(words, window)
        ends = list(accumulate(map(len, words)))  # of words without spaces
        plain = len(folded) == len(part)
        for b, e in zip(starts, [*starts[1:], len(words)], strict=True):
            begin, stop = (ends[b - 1] + b if b else 0), ends[e - 1] + e - 1
            if plain:
                out.append((at + begin, at + stop, e - b, folded[begin:stop]))
            else:
                out.append((0, 0, e - b, folded[begin:stop]))
        if not plain:  # wide spaces: look the words up in the text
            place, spots = 0, []
            for w in words:
                place = part.index(w, place)
                spots.append((at + place, at + place + len(w)))
                place += len(w)
            for k, (b, e) in enumerate(zip(starts, [*starts[1:], len(words)], strict=True), len(out) - len(starts)):
                out[k] = (spots[b][0], spots[e - 1][1], *out[k][2:])
    return out


def runs(found: list[tuple[int, int, int, bytes]], run: int = RUN, least_words: int = LEAST_WORDS, least_bytes: int = LEAST_BYTES) -> list[tuple[int, int]]:
    """(first sentence, number of sentences) of every run."""
    out = []
    end = words = size = 0
    for i in range(len(found)):
        while end < len(found) and (end < i + run or (words < least_words and size < least_bytes)):
            words, size, end = words + found[end][2], size + len(found[end][3]), end + 1
        if end < i + run:
            break  # a single sentence is left
        out.append((i, end - i))
        words, size = words - found[i][2], size - len(found[i][3])
    return out


def repeated_sentences(docs: DataFrame, run: int = RUN, least_words: int = LEAST_WORDS, window: int = WINDOW) -> DataFrame:
    """(uid, id0, no_id, later): for documents of keyed(), place and length of the runs that occur earlier too."""
    spark = docs.sparkSession

    def hashed(batches):
        import xxhash

        digest_of = xxhash.xxh3_128_digest
        for batch in pieces(batches, "text", 1 << 20):
            at, n, digest, each = [], [], [], []
            for t in utf8(batch, "text"):
                found = sentences(t, window)
                folded, places = [s[3] for s in found], runs(found, run, least_words)
                each.append(len(places))
                for i, k in places:
                    at.append(i)
                    n.append(k)
                    digest.append(digest_of(b"\n".join(folded[i : i + k])))
            halves = np.frombuffer(b"".join(digest), np.int64).reshape(-1, 2)
            owner = pa.array(np.repeat(np.arange(len(each)), each))
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), batch.column(1).take(owner), batch.column(0).take(owner), pa.array(at, pa.int32()), pa.array(n, pa.int32())], names=["h", "rest", "doc_id", "uid", "at", "length"])

    # Written, so that texts are read and hashed once. Half a digest tells first which runs may repeat; few places stay.
    tables = [write_shared(docs.select("uid", "doc_id", "text").mapInArrow(hashed, "h bigint, rest bigint, doc_id bigint, uid bigint, at int, length int"), "places")]
    places = spark.read.parquet(tables[0])
    repeated = places.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    tables.append(write_shared(places.join(repeated.hint("merge"), "h", "left_semi"), "repeated-places"))
    release(spark)
    places = spark.read.parquet(tables[1])
    earliest = places.groupBy("h", "rest").agg(F.min(F.struct("doc_id", "uid", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    later = places.join(earliest, ["h", "rest"]).where("uid != first.uid or at != first.at")
    later = later.groupBy("uid", F.coalesce("doc_id", F.lit(0)).alias("id0"), F.col("doc_id").isNull().alias("no_id")).agg(F.collect_list(F.struct("at", "length")).alias("later"))
    marks = spark.read.parquet(write_shared(later, "later-runs"))
    for path in tables:
        drop_shared(spark, path)
    release(spark)
    return marks


def cut_sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", run: int = RUN, least_words: int = LEAST_WORDS, window: int = WINDOW) -> DataFrame:
    """doc_id, n_sentences, removed (numbers of removed sentences), kept_text and folded (the kept sentences, one a line)."""
    docs = keyed(docs, doc_id, text)
    marks = repeated_sentences(docs, run, least_words, window)

    def cut(batches):
        for batch in pieces(batches, "text", 1 << 20):
            n, removed, kept, folded = [], [], [], []
            for t, later, time in zip(utf8(batch, "text"), *(batch.column(c).to_pylist() for c in (2, 3)), strict=True):
                found = sentences(t, window)
                if time > 1:  # the same row again: each of its runs has been there
                    places = runs(found, run, least_words)
                else:
                    places = [(r["at"], r["length"]) for r in later or ()]
                gone = sorted({i + k for i, length in places for k in range(length)})
                n.append(len(found))
                removed.append(gone)
                at, parts = 0, []
                for i in gone:
                    parts.append(t[at : found[i][0]])
                    at = found[i][1]
                kept.append(b"".join([*parts, t[at:]]))
                drop = set(gone)
                folded.append(b"\n".join([s[3] for i, s in enumerate(found) if i not in drop]))
            # cuts lie between characters, so the bytes are text
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.list_(pa.int32())), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(folded, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_sentences", "removed", "kept_text", "folded"],
            )

    both = nth(docs.join(marks, KEY, "left")).select("doc_id", "text", "later", "nth")
    return both.mapInArrow(cut, "doc_id bigint, n_sentences bigint, removed array<int>, kept_text string, folded string")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = cut_sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", F.size("removed").cast("long").alias("n_removed"), F.sha2("folded", 256).alias("kept_sha256"))


#: The same rule in SQL: windows for the least words, cumulated words and bytes for the ends of runs.
ORACLE = f"""
WITH s AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^{_ENDS}\\n]+[{_ENDS}]*') AS ss FROM documents),
u AS (SELECT doc_id, i, regexp_extract_all(translate(ss[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM (SELECT doc_id, ss, unnest(range(1, len(ss) + 1)) AS i FROM s)),
w AS (SELECT doc_id, i, len(ws) AS n, p, ws[p] AS w FROM (SELECT doc_id, i, ws, unnest(range(1, len(ws) + 1)) AS p FROM u)),
m AS (SELECT doc_id, i, p, n, w, min(struct_pack(w := w, p := p)) OVER (PARTITION BY doc_id, i ORDER BY p ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING) AS least FROM w),
c AS (SELECT DISTINCT doc_id, i, least.p AS p FROM m WHERE n > {WINDOW} AND p <= n - {WINDOW - 1}),
b AS (SELECT w.doc_id, w.i, w.p, w.w, sum(CASE WHEN w.p = 1 OR c.p IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id, w.i ORDER BY w.p) AS piece
  FROM w LEFT JOIN c ON w.doc_id = c.doc_id AND w.i = c.i AND w.p = c.p),
f AS (SELECT doc_id, i, piece, count(*) AS words, string_agg(w, ' ' ORDER BY p) AS f FROM b GROUP BY doc_id, i, piece),
k AS (SELECT doc_id, row_number() OVER o AS k, f, sum(words) OVER o AS cw, sum(strlen(f)) OVER o AS cb FROM f WINDOW o AS (PARTITION BY doc_id ORDER BY i, piece)),
a AS (SELECT doc_id, count(*) AS n, list(f ORDER BY k) AS fs, list_prepend(0, list(cw ORDER BY k)) AS cw, list_prepend(0, list(cb ORDER BY k)) AS cb FROM k GROUP BY doc_id),
e AS (SELECT doc_id, k, fs, coalesce(list_filter(range(k + {RUN - 1}, least(k + {LEAST_WORDS + RUN}, n) + 1), lambda e: cw[e + 1] - cw[k] >= {LEAST_WORDS} OR cb[e + 1] - cb[k] >= {LEAST_BYTES})[1], CASE WHEN k + {RUN - 1} <= n THEN n END) AS e
  FROM (SELECT *, unnest(range(1, n + 1)) AS k FROM a)),
t AS (SELECT doc_id, k, e, row_number() OVER (PARTITION BY array_to_string(fs[k:e], chr(10)) ORDER BY doc_id, k) AS nth FROM e WHERE e IS NOT NULL),
g AS (SELECT DISTINCT doc_id, unnest(range(k, e + 1)) AS k FROM t WHERE nth > 1),
j AS (SELECT k.doc_id, count(*) AS n_sentences, count(g.k) AS n_removed, string_agg(f, chr(10) ORDER BY k.k) FILTER (WHERE g.k IS NULL) AS kept
  FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.k = g.k GROUP BY k.doc_id)
SELECT d.doc_id, CAST(coalesce(n_sentences, 0) AS BIGINT) AS n_sentences, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN j ON d.doc_id = j.doc_id
"""
