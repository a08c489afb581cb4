"""Tree concatenation against the tokenizers library itself."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from marketlake.llm import bpe
from tests.oracle import SF


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(bpe.vocabulary_file("word_bpe_49k.json"))
    found.no_truncation()
    found.no_padding()
    return found


def odd_texts():
    rng = random.Random(8)
    letters = "etaoinshrdlu" * 3 + "éñüßøçİΣσςжяשת中文字ﬁﬃÅΩK"
    marks = "'\"!?.,;:-_()<|>/\\#*`~^€…«»́̈​‍﻿\x00\x1c\x1f\x7f\x85  　 0123456789½²٣"
    out = [None, "", " \n\t\x0b\x0c\r", " ", "it's 's 'S ''s 'll'd", "<|endoftext|>", "a<|endoftext|><|startoftext|>B<|END|>", "<|startoftext|", "x\x0by\x1cz\x85q", "İSTANBUL ΣΑΣ ﬁ", "é ́e Å Å", "\U0001f600" * 9 + "👩‍👩‍👧"]
    for n in range(300):
        out.append("".join(rng.choice(letters if rng.random() < 0.7 else marks + " ") for _ in range(rng.randint(1, 60))))
    return out


@pytest.mark.parametrize("leaf", [1, 2, 7, bpe.LEAF])
def test_words_by_any_leaf(library, leaf):
    enc = bpe.Encoder(bpe.vocabulary_file("word_bpe_49k.json"), leaf)
    for t in odd_texts():
        ids, decoded = enc((t or "").encode())
        want = library.encode(t or "", add_special_tokens=False).ids
        assert list(memoryview(ids).cast("i")) == want if ids else not want, t
        assert decoded.decode() == library.decode(want, skip_special_tokens=False), t


def long_words():
    rng = random.Random(9)
    return ["a" * 5000, "ab" * 3000 + "a", "the" * 2000, "é" * 3000, "-=" * 2500, "".join(rng.choice("etaoinshr") for _ in range(9000)), "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9000)), "mississippi" * 700, "中文字" * 900]


@pytest.mark.parametrize("leaf", [1, 5, 16, 1000])
def test_unsplit_words(library, leaf):
    """Runs that repeat move every token after a change, so windows grow to the whole piece; others stop at once."""
    enc = bpe.Encoder(bpe.vocabulary_file("word_bpe_49k.json"), leaf)
    for w in long_words():
        assert [i for p in enc.parts(w.encode()) for i in enc.tree(p)] == library.encode(w, add_special_tokens=False).ids, w[:20]


def test_windows_stay_small():
    """A join of ordinary text looks at a few tokens, not at the halves."""
    enc = bpe.Encoder(bpe.vocabulary_file("word_bpe_49k.json"))
    rng = random.Random(3)
    s = "".join(rng.choice("etaoinshrdlucmfwypvbgkjqxz") for _ in range(20_000))
    seen, merge = [], enc.merge
    enc.merge = lambda x, ends: seen.append(len(x)) or merge(x, ends)
    enc.tree(s)
    assert max(seen) < 200


def test_texts(spark, library):
    """Giant pieces are cut, encoded in other tasks and joined; nulls, repeats and clashing columns stay rows."""
    texts = [*odd_texts()[:80], *long_words(), "Say " + "mississippi" * 700 + " or\n" + "ab" * 3000 + "<|endoftext|>" + "x1" * 2000 + " end"]
    rows = [(n, t, "x", n) for n, t in enumerate(texts)] + [(1, texts[-1], "y", 0), (None, "mississippi" * 700, None, None), (1, texts[-1], "y", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string, row int").repartition(3)
    got = bpe.encode_texts(docs, spread=2000, spread_leaf=600)
    want = sorted((d if d is not None else -1, tuple(library.encode(t or "", add_special_tokens=False).ids)) for d, t, _, _ in rows)
    found = got.collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, tuple(r["ids"])) for r in found) == want
    assert all(r["decoded"] == library.decode(r["ids"], skip_special_tokens=False) for r in found)
    assert bpe.encode_texts(docs.where("false")).count() == 0


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for d, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    got = bpe.op12(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_other_kinds_are_errors():
    with pytest.raises(ValueError):
        bpe.Encoder(bpe.vocabulary_file("byte_bpe_50k.json"))
