"""Token ids in a binary file format: range asymmetric numeral systems (rANS) with one static table for the corpus.

A token file is a Parquet table of blocks. A block holds whole consecutive documents in ascending doc_id order, its
own coder state and a checksum, so blocks decode in any order and place. Inside a block LANES coders are interleaved:
token i belongs to lane i mod LANES, all lanes share one stream of 32-bit words, and numpy steps them together.
Every CHECKPOINT steps the lane states and the place in the stream are stored, so one block decodes in parallel too.
The frequency table is counted over every token of the corpus and quantised to 2**SCALE_BITS.

Defined results: a null or empty text has only the end id; repeated rows and repeated doc_ids are kept, ordered by
doc_id (null first), then a hash of the text; a text of any length is encoded whole and lies in one block; only doc_id
and text are read, so other columns may have any name; an empty table gives no rows.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.common import drop_shared, per_worker, pieces, release, shuffle_partitions, table, write_shared

END_ID = 2
SCALE_BITS = 20
LANES = 2048
#: Steps of all lanes between checkpoints.
CHECKPOINT = 256
#: Tokens after which a block ends with the document that reached them.
BLOCK_TOKENS = 1 << 20
#: Words that a worker remembers the ids of.
REMEMBER = 400_000

LOW = np.uint64(1 << 31)


def vocabulary_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# --- text to ids ---------------------------------------------------------------------------------------------------


def byte_letters() -> dict[int, str]:
    """The visible character that byte-level tokenizers write for each byte: itself if printable, else from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}


class Encoder:
    """Ids of whole texts by the tokenizers library; each distinct word goes through the library once.

    The byte-level tokenizer cuts a text into pieces by its published pattern and merges inside a piece only, so the
    ids of a text are those of its pieces in turn. A space between two characters that are not white space always
    starts a piece; texts are first split there, and only words not seen before are cut and merged. Texts in which a
    space touches other white space are cut whole; texts that hold an added token's string go to the library whole. So
    do all texts of a tokenizer that is not of this kind.
    """

    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str, remember: int = REMEMBER):
        import regex
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.known_kind = self.is_byte_level(json.loads(self.library.to_str()))
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.merge = self.library.model  # pieces are cut already, and each seen once: no cache of the library's own
        if self.known_kind:
            self.merge._resize_cache(0)
        self.letters = byte_letters()
        self.id_bytes = [n.to_bytes(4, "little") for n in range(self.library.get_vocab_size())]
        self.cut = regex.compile(self.PIECES).findall
        # words met so far (without the space before them), where their ids lie in `flat`, and when each was last met
        self.known = pa.array([], pa.string())
        self.flat, self.start, self.size, self.met = np.empty(0, np.uint32), np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)
        self.round = 0
        self.short: dict[str, bytes] = {}  # pieces of one or two characters
        self.remember = remember

    @staticmethod
    def is_byte_level(said: dict) -> bool:
        """Whether a tokenizer's definition is byte-level BPE that cuts by PIECES and changes no text before or after."""
        cut, model = said.get("pre_tokenizer") or {}, said.get("model") or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space", True)
        marks = ("continuing_subword_prefix", "end_of_word_suffix", "dropout")
        return plain and said.get("normalizer") is None and model.get("type") == "BPE" and not any(model.get(m) for m in marks) and not model.get("ignore_merges", False)

    def piece(self, piece: str) -> bytes:
        found = self.short.get(piece)
        if found is None:
            found = self.merged([piece])[0]
            if len(piece) <= 2:
                self.short[piece] = found
        return found

    def merged(self, pieces: list[str]) -> list[bytes]:
        """The ids of pieces that hold no line break (or of a single piece)."""
        if not pieces:
            return []
        tokenize, id_bytes, join = self.merge.tokenize, self.id_bytes, b"".join
        shown = "\n".join(pieces).encode().decode("latin-1").translate(self.letters)
        shown = [shown] if len(pieces) == 1 else shown.split(self.letters[10])
        return [join([id_bytes[t.id] for t in tokenize(s)]) for s in shown]

    def learn(self, words: list[str]) -> list[bytes]:
        """The ids of a space and each of these distinct words. Letters are one piece; so is a mark after them."""
        plain, marked, rest = [], [], []
        for w in words:
            if w.isalpha():
                plain.append(w)
            elif w[-1] in ",.;:!?" and w[:-1].isalpha():
                marked.append(w)
            else:
                rest.append(w)
        plain += {w[:-1] for w in marked}.difference(plain)
        known = dict(zip(plain, self.merged([" " + w for w in plain]), strict=True))
        for w in marked:
            known[w] = known[w[:-1]] + self.piece(w[-1])
        cut = [self.cut(" " + w) for w in rest]
        longer = [p for p in set().union(*cut) if len(p) > 2 and "\n" not in p]
        ids_of = dict(zip(longer, self.merged(longer), strict=True))
        for w, c in zip(rest, cut, strict=True):
            known[w] = b"".join([ids_of[p] if p in ids_of else self.piece(p) for p in c])
        return list(map(known.__getitem__, words))

    def whole(self, text: str) -> bytes:
        if any(a in text for a in self.added):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.piece, self.cut(text)))

    def rows_of(self, distinct: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows among the known words, which of these words stand beside other white space); new words are learnt."""
        self.round += 1
        if len(self.known) > self.remember:  # the half met longest ago goes
            kept = np.flatnonzero(self.met > np.median(self.met))
            size = self.size[kept]
            at = np.cumsum(size) - size
            self.flat = self.flat[np.repeat(self.start[kept] - at, size) + np.arange(int(size.sum()))]
            self.known, self.start, self.size, self.met = self.known.take(pa.array(kept)), at.astype(np.int32), size, self.met[kept]
        rows = pc.fill_null(pc.index_in(distinct, value_set=self.known), -1).to_numpy().copy()
        missing = np.flatnonzero(rows < 0)
        words = distinct.take(pa.array(missing)).to_pylist()
        touching = np.array([not w or w[0].isspace() or w[-1].isspace() for w in words], bool)
        beside, fresh = missing[touching], missing[~touching]
        made = self.learn([w for w, t in zip(words, touching.tolist(), strict=True) if not t])
        size = np.fromiter(map(len, made), np.int32, len(made)) // 4
        rows[fresh] = len(self.known) + np.arange(len(made))
        rows[beside] = 0
        self.start = np.r_[self.start, (len(self.flat) + np.cumsum(size) - size).astype(np.int32)]
        self.size, self.flat = np.r_[self.size, size], np.r_[self.flat, np.frombuffer(b"".join(made), "<u4")]
        self.known = pa.concat_arrays([self.known, distinct.take(pa.array(fresh))])
        self.met = np.r_[self.met, np.zeros(len(made), np.int32)]
        self.met[rows[rows < len(self.met)]] = self.round
        return rows, beside

    def __call__(self, texts: pa.Array, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in turn, each with the end id; how many each text has)."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        texts = pc.fill_null(texts, "")
        if not self.known_kind:
            found = [[*x.ids, end_id] for x in self.library.encode_batch(texts.to_pylist(), add_special_tokens=False)]
            return np.concatenate([np.array(x, np.uint32) for x in found]), np.array([len(x) for x in found], np.int64)
        split = pc.split_pattern(texts, " ")
        begin = split.offsets.to_numpy().astype(np.int64)
        begin, count = begin[:-1] - begin[0], np.diff(begin)
        coded = pc.dictionary_encode(split.flatten())
        index, distinct = coded.indices.to_numpy(), coded.dictionary
        first_words = distinct.take(pa.array(index[begin])).to_pylist()
        rows, beside = self.rows_of(distinct)
        odd = np.zeros(len(texts), bool)  # texts to encode whole
        if len(beside):
            bad = np.zeros(len(distinct), bool)
            bad[beside] = True
            odd |= np.add.reduceat(bad[index], begin) > 0
        for a in self.added:
            odd |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        # each text's first word has no space before it; a whole text stands in its first word's place
        firsts = [self.whole(texts[i].as_py() if odd[i] else w) for i, w in enumerate(first_words)]
        more = [*firsts, int(end_id).to_bytes(4, "little")]
        more_size = np.fromiter(map(len, more), np.int32, len(more)) // 4
        flat = np.r_[self.flat, np.frombuffer(b"".join(more), "<u4")]
        size, start = np.r_[self.size, more_size], np.r_[self.start, (len(self.flat) + np.cumsum(more_size) - more_size).astype(np.int32)]
        place = rows[index]
        place[begin] = len(self.size) + np.arange(len(texts))
        kept = ~np.repeat(odd, count)
        kept[begin] = True
        kept_count = np.add.reduceat(kept.astype(np.int64), begin)
        place = np.insert(place[kept], np.cumsum(kept_count), len(size) - 1)
        n = size[place]
        at = np.cumsum(n, dtype=np.int64) - n
        ids = flat[np.repeat(start[place] - at, n) + np.arange(int(n.sum()))]
        return ids, np.add.reduceat(n.astype(np.int64), np.cumsum(kept_count + 1) - kept_count - 1)


# --- the coder ------------------------------------------------------------------------------------------------------


def quantise(ids: np.ndarray, counts: np.ndarray, bits: int = SCALE_BITS) -> np.ndarray:
    """Frequencies of at least 1 that sum to 2**bits, in proportion to counts (any order of rows gives the same)."""
    total, room = int(counts.sum()), (1 << bits) - len(ids)
    if room < 0:
        raise ValueError(f"{len(ids)} symbols do not fit a scale of {bits} bits")
    if not total:
        return np.empty(0, np.uint64)
    exact = counts.astype(np.float64) * (room / total)
    freq = np.floor(exact).astype(np.int64)
    rest = room - int(freq.sum())
    by = np.lexsort((ids, -(exact - freq)))
    freq[by[:rest]] += 1
    return (freq + 1).astype(np.uint64)


class Model:
    """The shared table: symbols in ascending order with frequencies and their cumulative sums."""

    def __init__(self, symbols: np.ndarray, freq: np.ndarray, bits: int = SCALE_BITS):
        self.symbols, self.bits, self.freq = symbols.astype(np.uint32), bits, freq.astype(np.uint64)
        self.start = np.r_[np.uint64(0), np.cumsum(self.freq)[:-1].astype(np.uint64)].astype(np.uint64)[: len(self.freq)]
        self.index = np.zeros(int(self.symbols.max(initial=0)) + 1, np.uint32)  # of a symbol in the table
        self.index[self.symbols] = np.arange(len(self.symbols))

    @classmethod
    def of_counts(cls, rows: list[tuple[int, int]]) -> Model:
        rows = sorted(rows)
        ids, n = np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)
        return cls(ids, quantise(ids, n))

    def slots(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.freq), dtype=np.uint16 if len(self.freq) <= 1 << 16 else np.uint32), self.freq.astype(np.int64))


def encode_block(ids: np.ndarray, model: Model) -> bytes:
    """Header, checkpoints and words of one block. Coding runs backwards; the decoder reads forwards."""
    n = len(ids)
    steps = -(-n // LANES)
    index = model.index[ids]
    freq, start = model.freq[index], model.start[index]
    state = np.full(LANES, LOW, np.uint64)
    limit_shift, bits = np.uint64(63 - model.bits), np.uint64(model.bits)
    words: list[np.ndarray] = []
    written = 0
    marks: list[tuple[int, np.ndarray]] = []
    for step in range(steps - 1, -1, -1):
        f, c = freq[step * LANES : (step + 1) * LANES], start[step * LANES : (step + 1) * LANES]
        x = state[: len(f)]
        full = x >= (f << limit_shift)
        if full.any():
            out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")
            words.append(out)
            written += len(out)
            x[full] >>= np.uint64(32)
        q = x // f
        state[: len(f)] = (q << bits) + (x - q * f) + c
        if step % CHECKPOINT == 0:
            marks.append((written, state.copy()))
    stream = np.concatenate(words[::-1]) if words else np.empty(0, "<u4")
    marks = marks[::-1]
    head = np.array([n, LANES, CHECKPOINT, len(marks), len(stream)], "<u4").tobytes()
    places = np.array([len(stream) - w for w, _ in marks], "<u4").tobytes()
    states = b"".join(s.astype("<u8").tobytes() for _, s in marks)
    body = head + places + states + stream.tobytes()
    return zlib.crc32(body).to_bytes(4, "little") + body


def decode_block(data: bytes, model: Model, slots: np.ndarray, part: int | None = None) -> np.ndarray:
    """The ids of a block, or of the stretch that follows its part-th checkpoint. ValueError where the checksum fails."""
    if zlib.crc32(data[4:]) != int.from_bytes(data[:4], "little"):
        raise ValueError("a block of token ids does not match its checksum")
    n, lanes, every, n_marks, n_words = np.frombuffer(data, "<u4", 5, 4).tolist()
    places = np.frombuffer(data, "<u4", n_marks, 24)
    states = np.frombuffer(data, "<u8", n_marks * lanes, 24 + 4 * n_marks).reshape(n_marks, lanes)
    stream = np.frombuffer(data, "<u4", n_words, 24 + 4 * n_marks + 8 * n_marks * lanes)
    steps = -(-n // lanes)
    first, last = (0, steps) if part is None else (part * every, min(steps, (part + 1) * every))
    if not n:
        return np.empty(0, np.uint32)
    x = states[first // every].astype(np.uint64)
    at = int(places[first // every])
    mask, bits = np.uint64((1 << model.bits) - 1), np.uint64(model.bits)
    out = np.empty(min(n, last * lanes) - first * lanes, np.uint32)
    for step in range(first, last):
        live = min(lanes, n - step * lanes)
        y = x[:live]
        low = y & mask
        s = slots[low]
        out[(step - first) * lanes : (step - first) * lanes + live] = s
        y = model.freq[s] * (y >> bits) + low - model.start[s]
        need = np.flatnonzero(y < LOW)
        if len(need):
            y[need] = (y[need] << np.uint64(32)) | stream[at : at + len(need)]
            at += len(need)
        x[:live] = y
    return model.symbols[out]


# --- Spark jobs -----------------------------------------------------------------------------------------------------

_STAGED = "part int, seq int, before bigint, doc_ids array<bigint>, lengths array<int>, width int, ids binary, n bigint"
_FILE = "part int, seq int, start bigint, doc_ids array<bigint>, lengths array<int>, block binary"


def _stage(docs: DataFrame, encoder: Callable[[], Encoder], end_id: int) -> DataFrame:
    """Documents in ascending order, tokenized, in chunks that later become blocks."""
    order = ["doc_id", F.xxhash64("text")]
    docs = docs.repartitionByRange(shuffle_partitions(docs.sparkSession), *order).sortWithinPartitions(*order)

    def chunks(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext

        encode, part, seq = encoder(), TaskContext.get().partitionId(), 0
        doc_ids: list = []
        made: list[np.ndarray] = []
        held = before = 0  # tokens in the chunk, and in this partition before it

        def chunk():
            ids = np.concatenate(made)
            narrow = ids.astype("<u2") if not len(ids) or ids.max() < 1 << 16 else ids.astype("<u4")
            row = {"part": part, "seq": seq, "before": before, "doc_ids": doc_ids, "lengths": lengths, "width": narrow.itemsize, "ids": narrow.tobytes(), "n": len(ids)}
            return pa.RecordBatch.from_pylist([row], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("before", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("width", pa.int32()), ("ids", pa.binary()), ("n", pa.int64())])
        lengths: list[int] = []
        for batch in pieces(batches, "text", 6 << 20):
            ids, n = encode(batch.column(1), end_id)
            ends, names = np.cumsum(n), batch.column(0).to_pylist()
            at = done = 0
            while done < len(n):
                # documents up to the one that fills the block
                to = min(len(n), int(np.searchsorted(ends, ends[done] - n[done] + BLOCK_TOKENS - held)) + 1)
                doc_ids += names[done:to]
                lengths += n[done:to].tolist()
                made.append(ids[at : ends[to - 1]])
                held += int(ends[to - 1]) - at
                at, done = int(ends[to - 1]), to
                if held >= BLOCK_TOKENS:
                    yield chunk()
                    before += held
                    doc_ids, lengths, made, held, seq = [], [], [], 0, seq + 1
        if made:
            yield chunk()

    return docs.mapInArrow(chunks, _STAGED)


def _one_by_one(batch: pa.RecordBatch) -> Iterator[dict]:
    """Rows as dicts, one in Python at a time: each holds megabytes."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _ids(raw: bytes, width: int) -> np.ndarray:
    return np.frombuffer(raw, f"<u{width}")


def _count(batches: Iterator[pa.RecordBatch]):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw, width in zip(*batch.columns, strict=True):
            n = np.bincount(_ids(raw.as_py(), width.as_py()), minlength=len(total))
            n[: len(total)] += total
            total = n
    ids = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "n": pa.array(total[ids], pa.int64())})


def write_tokens(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID) -> tuple[str, str]:
    """Encode documents (doc_id, text) into token files; returns the paths of the block table and of the model table.

    The driver holds the frequency table (at most one row for each id of the vocabulary) and one total per partition.
    """
    spark = docs.sparkSession
    path = tokenizer or vocabulary_file()
    staged_at = write_shared(_stage(docs.select("doc_id", "text"), lambda: per_worker(("encoder", path), lambda: Encoder(path)), end_id), "ids")
    release(spark)
    staged = spark.read.parquet(staged_at)
    counts = staged.select("ids", "width").mapInArrow(_count, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    model = Model.of_counts([(r["id"], r["n"]) for r in counts.collect()])
    rows = pa.table({"id": pa.array(model.symbols, pa.int64()), "freq": pa.array(model.freq.astype(np.int64))})
    model_at = write_shared(spark.createDataFrame(rows.to_pandas(), "id bigint, freq bigint").coalesce(1), "model")
    total, starts = 0, {}
    for r in sorted(staged.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        starts[r["part"]] = total
        total += r["n"]
    shared = spark.sparkContext.broadcast((model, starts))

    def encode(batches):
        model, starts = shared.value
        for batch in batches:
            for r in _one_by_one(batch):
                row = {"part": r["part"], "seq": r["seq"], "start": starts[r["part"]] + r["before"], "doc_ids": r["doc_ids"], "lengths": r["lengths"], "block": encode_block(_ids(r["ids"], r["width"]), model)}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("start", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("block", pa.binary())])
    blocks = staged.mapInArrow(encode, _FILE)
    blocks_at = write_shared(blocks, "tokens", "none")
    drop_shared(spark, staged_at)
    return blocks_at, model_at


def read_tokens(spark: SparkSession, paths: tuple[str, str], with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, its ids."""
    rows = spark.read.parquet(paths[1]).collect()
    rows.sort()
    model = spark.sparkContext.broadcast(Model(np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.int64)))
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)

    def decode(batches):
        slots = None
        for batch in batches:
            for r in _one_by_one(batch):
                slots = model.value.slots() if slots is None else slots
                ids = decode_block(r["block"], model.value, slots).astype("<u4")
                at, raw = 0, memoryview(ids.tobytes())
                docs = []
                for doc_id, n in zip(r["doc_ids"], r["lengths"], strict=True):
                    docs.append((doc_id, r["start"] + at, n, zlib.crc32(raw[4 * at : 4 * (at + n)])) + ((ids[at : at + n].tolist(),) if with_ids else ()))
                    at += n
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*docs, strict=True), schema, strict=True)], schema=schema)

    kinds = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    return spark.read.parquet(paths[0]).select("start", "doc_ids", "lengths", "block").mapInArrow(decode, kinds)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents").select("doc_id", "text")))
