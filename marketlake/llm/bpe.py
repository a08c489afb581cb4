"""Byte-pair encoding and decoding by tree concatenation, equal to the tokenizers library to the last id.

A tokenizer with word ends drops white space and merges inside pieces only, so the ids of a text are those of its words
in turn, and words are cut into pieces by the tokenizer's own normaliser and splitter. A piece longer than `leaf` symbols,
which nothing splits, is halved again and again; the halves are encoded apart, the left ones without a word end, and
joined: a window of tokens on both sides of the join is encoded anew, and grows on a side until its outermost token there
is the token that the side had (or the side ends).

Why that is exact: merging takes the pair of least rank, leftmost first. A row of tokens is the encoding of its text if
and only if each two neighbours, encoded as a text of their own, come out as they are: as long as no merge crosses a
border between tokens, what happens inside two neighbours is what happens when they stand alone, so the first merge that
crosses a border would cross it there too. Neighbours inside a kept part stood together before, those inside the window
were encoded together, and at a seam the window begins (ends) with the very token that the kept part was followed
(preceded) by.

Pieces over `spread` bytes are cut into leaves that are encoded in tasks of their own and joined as a tree per document;
what meets in a task is never more than the ids of one document.

Defined results: null and empty texts, and texts of white space, have no ids and decode to the empty string; repeated
rows and doc_ids each give a row; only doc_id and text are read, so other columns may have any name; an empty table gives
no rows. Tokenizers of another kind are an error.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.common import per_worker, pieces, table, utf8, write_shared
from marketlake.llm.tokenbin import byte_letters, vocabulary_file

#: Symbols (bytes) of a piece that is merged without halving.
LEAF = 16
#: Bytes of an unsplit piece from which its leaves are spread over tasks, and symbols of such a leaf.
SPREAD, SPREAD_LEAF = 1 << 16, 1 << 14
#: Bytes of words and ids that a worker remembers.
REMEMBER = 96 << 20

KINDS = "doc_id bigint, ids array<int>, decoded string"
PLAIN, INNER, LAST = 0, 1, 2


class _Memo(dict):
    def __init__(self, learn):
        super().__init__()
        self.learn, self.held = learn, 0

    def __missing__(self, key):
        found = self[key] = self.learn(key)
        self.held += 200 + len(key) + len(found[0]) + len(found[1])
        return found


class Encoder:
    """Ids and decoded text of whole texts; a word met before is looked up."""

    def __init__(self, path: str, leaf: int = LEAF, remember: int = REMEMBER):
        import regex
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.library = Tokenizer.from_file(path)
        said = json.loads(self.library.to_str())
        model = said["model"]
        self.check(said)
        self.leaf, self.remember = leaf, remember
        self.closed, self.open = self.library.model, BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]])
        for m in (self.closed, self.open):
            m._resize_cache(0)
        end = model["end_of_word_suffix"]
        self.tokens, self.length = {}, {}
        for token, n in model["vocab"].items():
            self.tokens[n], self.length[n] = token.encode(), len(token) - (len(end) if token.endswith(end) else 0)
        added = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.tokens |= {n: token.encode() for token, n in added.items()}
        self.added = added
        self.find_added = re.compile("(" + "|".join(re.escape(a) for a in sorted(added, key=len, reverse=True)) + ")").split if added else (lambda s: [s])
        self.letters = byte_letters()
        self.id_bytes = {n: n.to_bytes(4, "little") for n in self.tokens}
        # letters that normalising only lower-cases and that make one piece
        self.plain = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
        # on lower-cased ASCII text without white space this is the tokenizer's own splitter
        self.cut = regex.compile(said["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]).findall
        self.words, self.pieces = _Memo(self.word), _Memo(self.piece)

    @staticmethod
    def check(said: dict) -> None:
        """White space separates and goes, pieces are bytes, a piece's last symbol has a word end; added tokens are plain."""
        model, cut = said["model"], (said.get("pre_tokenizer") or {}).get("pretokenizers", [])
        plain = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
        fits = (
            model["type"] == "BPE" and model.get("end_of_word_suffix") and not any(model.get(k) for k in ("continuing_subword_prefix", "dropout", "ignore_merges", "byte_fallback"))
            and said["normalizer"] == plain and [c["type"] for c in cut] == ["Split", "ByteLevel"] and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
            and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"] and said.get("decoder") is None
            and not any(t[k] for t in said["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        )
        if not fits:
            raise ValueError("this tokenizer is not byte-level BPE with word ends that drops white space")

    # --- pieces: halves and joins ---------------------------------------------------------------------------------

    def merge(self, symbols: str, ends: bool) -> list[int]:
        return [t.id for t in (self.closed if ends else self.open).tokenize(symbols)]

    def tree(self, symbols: str, ends: bool = True) -> list[int]:
        """The ids of a piece; `ends` says whether its last symbol ends a word."""
        if len(symbols) <= self.leaf:
            return self.merge(symbols, ends)
        half = len(symbols) // 2
        left, right = symbols[:half], symbols[half:]
        return self.join(left, self.tree(left, False), right, self.tree(right, ends), ends)

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int], ends: bool) -> list[int]:
        """The ids of left + right from the ids of both."""
        length, i, j, begin, stop = self.length, 0, 0, len(left), 0
        want_i = want_j = 1
        while True:
            while i < min(want_i, len(left_ids)):
                i += 1
                begin -= length[left_ids[-i]]
            while j < min(want_j, len(right_ids)):
                stop += length[right_ids[j]]
                j += 1
            window = self.merge(left[begin:] + right[:stop], ends and j == len(right_ids))
            agrees = i == len(left_ids) or window[0] == left_ids[-i], j == len(right_ids) or window[-1] == right_ids[j - 1]
            if all(agrees):
                return [*left_ids[: len(left_ids) - i], *window, *right_ids[j:]]
            want_i, want_j = want_i * (1 if agrees[0] else 2), want_j * (1 if agrees[1] else 2)

    def join_all(self, leaves: list[tuple[str, list[int]]], ends: bool = True) -> list[int]:
        """The ids of a piece from those of its leaves: neighbours first, then pairs of pairs."""
        while len(leaves) > 1:
            joined = []
            for n in range(0, len(leaves) - 1, 2):
                (a, x), (b, y) = leaves[n : n + 2]
                joined.append((a + b, self.join(a, x, b, y, ends and n + 2 >= len(leaves))))
            leaves = joined + leaves[len(joined) * 2 :]
        return leaves[0][1] if leaves else []

    # --- words and texts ------------------------------------------------------------------------------------------

    def split(self, text: str) -> list[str]:
        """The pieces of text without added tokens, in the letters that stand for bytes."""
        if text.isascii():
            found = self.cut(text.lower())
            return found if text.isprintable() else [p.translate(self.letters) for p in found]
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def parts(self, word: bytes) -> list[int | str]:
        """Added tokens as ids, and pieces, in turn."""
        out = []
        for part in self.find_added(word.decode()):
            if part in self.added:
                out.append(self.added[part])
            elif part:
                out += self.split(part)
        return out

    def both(self, ids: list[int]) -> tuple[bytes, bytes]:
        return b"".join([self.id_bytes[i] for i in ids]), b" ".join([self.tokens[i] for i in ids])

    def piece(self, symbols: str) -> tuple[bytes, bytes]:
        return self.both(self.tree(symbols))

    def word(self, word: bytes) -> tuple[bytes, bytes]:
        text = word.decode()
        body, mark = (text[:-1], text[-1]) if text[-1] in ",.;:!?" else (text, "")
        if self.plain(body):
            low = body.lower()
            found = self.pieces[low if low.isascii() else low.encode().decode("latin-1").translate(self.letters)]
            return (found[0] + self.pieces[mark][0], found[1] + b" " + self.pieces[mark][1]) if mark else found
        found = [self.both([p]) if isinstance(p, int) else self.pieces[p] for p in self.parts(word)]
        return found[0] if len(found) == 1 else (b"".join([f[0] for f in found]), b" ".join([f[1] for f in found]))

    def __call__(self, text: bytes) -> tuple[bytes, bytes]:
        """(ids as little-endian integers, decoded text)."""
        for memo in (self.words, self.pieces):
            if memo.held > self.remember:
                memo.clear()
                memo.held = 0
        words = self.words
        found = [words[w] for w in text.split()]  # at ASCII white space, which no piece and no added token holds
        return b"".join([f[0] for f in found]), b" ".join([f[1] for f in found if f[0]])


def _rows(doc_ids: pa.Array, found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    size = np.array([len(f[0]) // 4 for f in found], np.int64)
    ids = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(np.frombuffer(b"".join([f[0] for f in found]), "<i4")))
    return pa.RecordBatch.from_arrays([doc_ids, ids, pa.array([f[1] for f in found], pa.binary()).cast(pa.string())], names=["doc_id", "ids", "decoded"])


def encode_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None, leaf: int = LEAF, spread: int = SPREAD, spread_leaf: int = SPREAD_LEAF) -> DataFrame:
    """doc_id, ids and decoded (the library's decode() of these ids) of each document, in no order."""
    path = tokenizer or vocabulary_file("word_bpe_49k.json")
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    encoder = lambda: per_worker(("bpe", path, leaf), lambda: Encoder(path, leaf))

    def encode(batches):
        enc = encoder()
        for batch in pieces(batches, "text"):
            yield _rows(batch.column(0), [enc(t) for t in utf8(batch, "text")])

    # From the row itself, so that both branches agree however often a plan is evaluated.
    long = F.coalesce((F.octet_length("text") > spread) & F.exists(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: F.octet_length(w) > spread), F.lit(False))
    plain = docs.where(~long).mapInArrow(encode, KINDS)

    def cut(batches):
        enc = encoder()
        for batch in pieces(batches, "text"):
            for n, body in enumerate(utf8(batch, "text")):
                kinds, ids, symbols, held = [], [], [], []
                for word in body.split():
                    for p in enc.parts(word):
                        if isinstance(p, int):
                            held.append(enc.id_bytes[p])
                        elif len(p) <= spread:
                            held.append(enc.pieces[p][0])
                        else:
                            leaves = [p[at : at + spread_leaf] for at in range(0, len(p), spread_leaf)]
                            kinds += [PLAIN, *[INNER] * (len(leaves) - 1), LAST]
                            ids += [b"".join(held), *[b""] * len(leaves)]
                            symbols += ["", *leaves]
                            held = []
                kinds, ids, symbols = [*kinds, PLAIN], [*ids, b"".join(held)], [*symbols, ""]
                at = pa.array(np.full(len(kinds), n))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(2).take(at), pa.array(range(len(kinds)), pa.int32()), pa.array(kinds, pa.int32()), pa.array([np.frombuffer(x, "<i4") for x in ids], pa.list_(pa.int32())), pa.array(symbols)],
                    names=["doc_id", "row", "part", "kind", "ids", "symbols"],
                )

    def encode_leaves(batches):
        enc = encoder()
        for batch in batches:
            kinds, symbols = batch.column(3).to_pylist(), batch.column(5).to_pylist()
            ids = [enc.tree(s, k == LAST) for k, s in zip(kinds, symbols, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(ids, pa.list_(pa.int32())), batch.column(5)], schema=batch.schema)

    def join_leaves(rows: pa.Table) -> pa.Table:
        enc = encoder()
        rows = rows.sort_by("part")
        ids, leaves = [], []
        for kind, own, symbols in zip(*(rows[c].to_pylist() for c in ("kind", "ids", "symbols")), strict=True):
            if kind == PLAIN:
                ids += own
                continue
            leaves.append((symbols, own))
            if kind == LAST:
                ids += enc.join_all(leaves)
                leaves = []
        return pa.Table.from_batches([_rows(rows["doc_id"].slice(0, 1).combine_chunks(), [enc.both(ids)])])

    parts_kind = "doc_id bigint, row bigint, part int, kind int, ids array<int>, symbols string"
    apart = docs.where(long)
    if apart.isEmpty():
        return plain
    parts = docs.sparkSession.read.parquet(write_shared(apart.withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, parts_kind), "unsplit"))
    leaves = parts.where(F.col("kind") != PLAIN).repartition("row", "part").mapInArrow(encode_leaves, parts_kind)
    joined = parts.where(F.col("kind") == PLAIN).unionByName(leaves).groupBy("row").applyInArrow(join_leaves, KINDS)
    return plain.unionByName(joined)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_texts(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
