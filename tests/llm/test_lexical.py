"""The two-level index against a search that scores every document."""

import collections
import math
import random
import re

import numpy as np
import pyarrow.parquet as pq
import pytest

from marketlake.llm import lexical


def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=20):
    parsed = [(d, collections.Counter(words(t)), len(words(t))) for d, t in docs]
    sizes = [n for _, _, n in parsed if n]
    total = sum(sizes)
    df = collections.Counter(w for _, c, _ in parsed for w in c)
    out = []
    for item, body in items:
        rows = []
        for d, c, n in parsed:
            if n:
                m = 75 + (25 * n * len(sizes)) // total
                score = sum(math.floor(1000 * math.log((2 * len(sizes) + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m)) for w in words(body) if c[w])
                if score > 0:
                    rows.append((-score, -1 if d is None else d))
        out += [(item, n + 1, d, -s) for n, (s, d) in enumerate(sorted(rows)[:k])]
    return sorted(out, key=repr)


def rows_of(df):
    return sorted(((r["item_id"], r["rank"], -1 if r["doc_id"] is None else r["doc_id"], r["score"]) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    vocabulary = [f"w{int(rng.paretovariate(0.7))}" for _ in range(300)] + ["Éa", "é", "中文", "X", "x9"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "-", "\n", "\x00", "@", "`", "~ "]) for _ in range(n))
    docs = [(n, text(rng.choice([1, 5, 20, 60]))) for n in range(400)]
    docs += [(1000 + n, docs[5][1]) for n in range(150)]  # ties
    docs += [(2000, None), (2001, ""), (2002, "?! @"), (2003, text(30_000)), (2004, "w1 " * 5000), (None, docs[7][1]), (3, docs[5][1]), (3, docs[5][1])]
    items = [(n, text(rng.randint(1, 25))) for n in range(30)] + [(40, None), (41, ""), (42, "nowhere at all"), (43, "w1 w1 W1 w1"), (44, docs[5][1]), (45, text(3000))]
    return docs, items


@pytest.mark.parametrize("shard_bytes,block_bytes,k", [(1 << 23, 1 << 23, 20), (3000, 400, 20), (500, 1 << 20, 3), (1 << 23, 1 << 23, 1000)])
def test_search(spark, corpus, shard_bytes, block_bytes, k):
    docs, items = corpus
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, text string, terms string, rank int").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    index = lexical.build_index(d, shard_bytes=shard_bytes)
    assert rows_of(lexical.search(index, q, k, block_bytes=block_bytes)) == brute(docs, items, k)


def test_empty(spark, corpus):
    docs, items = corpus
    d = spark.createDataFrame(docs, "doc_id long, text string")
    q = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(lexical.build_index(d.where("false")), q).count() == 0
    assert lexical.search(lexical.build_index(d.where("doc_id between 2000 and 2002")), q).count() == 0
    assert lexical.search(lexical.build_index(d), q.where("false")).columns == ["item_id", "rank", "doc_id", "score"]


def test_bytes_bound_impacts():
    tf = np.array([1, 1, 2, 7, 100, 10**6, 1])
    length = np.array([75, 100, 90, 75, 10**9, 75, 10**12])
    exact = lexical.impact(tf, length)
    up = -(-exact // lexical.STEP)
    assert (up * lexical.STEP >= exact).all() and ((up - 1) * lexical.STEP < exact)[exact > 0].all() and up.max() <= 255
    assert 255 * lexical.STEP >= 1_000_000


def test_string_ids(spark):
    d = spark.createDataFrame([(1, "a b"), (2, "b c")], "doc_id long, text string")
    q = spark.createDataFrame([("x", "a"), (None, "c")], "item_id string, text string")
    got = lexical.search(lexical.build_index(d), q).collect()
    assert sorted((str(r["item_id"]), r["doc_id"]) for r in got) == [("None", 2), ("x", 1)]


def test_few_documents_are_scored_exactly(spark):
    """Bounds do their work: of thousands of documents that hold a term only some are scored."""
    rng = random.Random(2)
    docs = [(n, " ".join(f"w{int(rng.expovariate(0.02))}" for _ in range(rng.randint(20, 200)))) for n in range(4000)]
    index = lexical.build_index(spark.createDataFrame(docs, "doc_id long, text string"))
    block = lexical.Block.of([(1, docs[9][1][:150])])
    block = block.weighted({p: lexical.weight(n, index.n_docs) for p, n in lexical._document_counts(index, block).items()})
    threshold = lexical._thresholds(index, block, 20)[0]
    reached = held = 0
    for batch in index.rows.toArrow().to_batches():
        for row in lexical._shards([batch]):
            for _, _, upper, _ in lexical._bounds(row, block, len(row["doc_ids"]), False):
                reached, held = reached + int((upper >= threshold).sum()), held + int((upper > 0).sum())
    assert 20 <= reached < 100 < 1000 < held


def test_a_row_group_holds_one_shard(spark, corpus):
    """Spark reads a row group of big rows at once, so one with all shards of a task would stand in memory whole."""
    d = spark.createDataFrame(corpus[0], "doc_id long, text string").coalesce(1)
    index = lexical.build_index(d, shard_bytes=3000)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in index.rows.inputFiles()]
    assert max(m.num_rows for m in files) > 5 and all(m.num_row_groups == m.num_rows for m in files)
