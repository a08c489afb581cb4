"""Language ID: a bidirectional gated recurrent network over bytes labels every position; documents pool the labels.

The network is trained here, in numpy, by backpropagation through time over stretches of labelled documents: a bounded
sample, at most TRAIN_DOCS documents, of each language an even share of them or all that it has. Prediction covers the
whole of every text: it is cut into stretches of STRETCH bytes, each read forwards and backwards from a zero state, all
stretches of a batch side by side; the logarithms of the position probabilities are averaged over the text's letters
(bytes outside of ASCII, and ASCII letters), and their softmax, sharpened by evidence of up to SHARPEN positions, gives
the document's probabilities.

Defined results: a null text, or one without a letter, is `und` with score 0; documents with a null language are not
learnt from but predicted; with no labelled document at all everything is `und`; a text of any length is labelled
whole; repeated rows keep their own rows; columns that have the names of the results go, others stay. More languages
than TRAIN_DOCS are an error, since none may be left out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from marketlake.llm.common import fresh, pieces, table, utf8

HIDDEN = 12
#: Bytes that the network reads in one go.
STRETCH = 128
#: Documents in the training sample at most, and the characters of each, from any place, from which stretches are drawn.
TRAIN_DOCS = 2000
TRAIN_BYTES = 4096
TRAIN_STEPS = 400
TRAIN_LANES = 256
TRAIN_STRETCH = 48
RATE = 0.02
SHARPEN = 30.0
SEED = 7
UNKNOWN = "und"

_LETTER = np.array([65 <= (c & ~32) <= 90 or c >= 128 for c in range(256)])


@dataclass
class Network:
    """Weights of both directions: byte table (256, 3H), recurrent (3H, H), its bias (3H), and the head (K, 2H), (K)."""

    table: list[np.ndarray]
    recur: list[np.ndarray]
    bias: list[np.ndarray]
    head: np.ndarray
    head_bias: np.ndarray
    labels: list[str]

    @classmethod
    def start(cls, labels: list[str], hidden: int = HIDDEN, seed: int = SEED) -> Network:
        r = np.random.default_rng(seed)
        f = np.float32
        return cls(
            [(r.standard_normal((256, 3 * hidden)) * 0.3).astype(f) for _ in range(2)],
            [(r.standard_normal((3 * hidden, hidden)) / np.sqrt(hidden)).astype(f) for _ in range(2)],
            [np.zeros((3 * hidden, 1), f) for _ in range(2)],
            (r.standard_normal((len(labels), 2 * hidden)) * 0.1).astype(f),
            np.zeros((len(labels), 1), f),
            labels,
        )

    def weights(self) -> list[np.ndarray]:
        return [*self.table, *self.recur, *self.bias, self.head, self.head_bias]


def run(net: Network, way: int, steps: np.ndarray, keep: bool = False):
    """States (T, H, B) of one direction over bytes (T, B), in the order of reading; with what training needs.

    Gates are halved sigmoids: update z and reset r from tanh, candidate n; h' = n + z (h - n).
    """
    t_max, lanes = steps.shape
    hidden = net.recur[way].shape[1]
    states = np.empty((t_max, hidden, lanes), np.float32)
    kept = []
    h = np.zeros((hidden, lanes), np.float32)
    table, u, b = net.table[way], net.recur[way], net.bias[way]
    for t in range(t_max):
        x = table[steps[t]].T
        y = u @ h
        y += b
        gates = x[: 2 * hidden] + y[: 2 * hidden]
        gates *= 0.5
        np.tanh(gates, out=gates)
        gates += 1
        gates *= 0.5
        z, r = gates[:hidden], gates[hidden:]
        n = r * y[2 * hidden :]
        n += x[2 * hidden :]
        np.tanh(n, out=n)
        if keep:
            kept.append((h, z, r, n, y[2 * hidden :].copy()))
        h = h - n
        h *= z
        h += n
        states[t] = h
    return states, kept


def backward(net: Network, way: int, steps: np.ndarray, kept: list, d_states: np.ndarray):
    """Gradients of the byte table, the recurrent weights and their bias, through all steps."""
    u, hidden = net.recur[way], net.recur[way].shape[1]
    d_table, d_u, d_b = np.zeros_like(net.table[way]), np.zeros_like(u), np.zeros_like(net.bias[way])
    carry = np.zeros_like(d_states[0])
    for t in range(len(kept) - 1, -1, -1):
        h, z, r, n, y_n = kept[t]
        d = d_states[t] + carry
        d_n = d * (1 - z) * (1 - n * n)
        d_z = d * (h - n) * z * (1 - z)
        d_r = d_n * y_n * r * (1 - r)
        d_x = np.concatenate([d_z, d_r, d_n])
        d_y = np.concatenate([d_z, d_r, d_n * r])
        np.add.at(d_table, steps[t], d_x.T)
        d_u += d_y @ h.T
        d_b += d_y.sum(1, keepdims=True)
        carry = d * z + u.T @ d_y
    return d_table, d_u, d_b


def log_softmax(x: np.ndarray, axis: int) -> np.ndarray:
    x = x - x.max(axis, keepdims=True)
    return x - np.log(np.exp(x).sum(axis, keepdims=True))


def train(texts: list[bytes], langs: list[str], hidden: int = HIDDEN, steps: int = TRAIN_STEPS, lanes: int = TRAIN_LANES, stretch: int = TRAIN_STRETCH, seed: int = SEED) -> Network:
    """Adam on the mean cross-entropy of position labels; each step draws stretches of random texts, languages evenly."""
    labels = sorted(set(langs))
    net = Network.start(labels, hidden, seed)
    rng = np.random.default_rng(seed)
    by_lang = [[t for t, x in zip(texts, langs, strict=True) if x == name and t] for name in labels]
    have = [k for k, ts in enumerate(by_lang) if ts]
    if len(labels) < 2 or not have:
        return net
    weights = net.weights()
    m, v = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for step in range(steps):
        target = rng.choice(have, lanes)
        data = np.full((stretch, lanes), 32, np.uint8)
        for i, k in enumerate(target):
            text = by_lang[k][rng.integers(len(by_lang[k]))]
            at = int(rng.integers(max(1, len(text) - stretch + 1)))
            if i % 4 == 0:  # openings of a few words, as short documents are
                part = np.frombuffer(text[: int(rng.integers(6, stretch))], np.uint8)
            else:
                part = np.frombuffer(text[at : at + stretch], np.uint8)
            data[: len(part), i] = part
        ways = [data, data[::-1]]
        runs = [run(net, w, ways[w], keep=True) for w in range(2)]
        both = np.concatenate([runs[0][0], runs[1][0][::-1]], axis=1)
        logits = np.matmul(net.head, both) + net.head_bias
        p = np.exp(log_softmax(logits, 1))
        p[:, target, np.arange(lanes)] -= 1
        p /= stretch * lanes
        d_head = np.einsum("tkb,thb->kh", p, both, optimize=True)
        d_both = np.matmul(net.head.T, p)
        grads: list[list[np.ndarray]] = []
        for w in range(2):
            d = d_both[:, :hidden] if w == 0 else d_both[::-1, hidden:]
            grads.append(list(backward(net, w, ways[w], runs[w][1], d)))
        flat = [grads[0][0], grads[1][0], grads[0][1], grads[1][1], grads[0][2], grads[1][2], d_head, p.sum((0, 2))[:, None]]
        norm = np.sqrt(sum(float((g * g).sum()) for g in flat))
        rate = RATE * min(1.0, (step + 1) / 10) * (1 - step / steps) / (1 if norm < 1 else norm)
        for w, g, a, s in zip(weights, flat, m, v, strict=True):
            a += 0.1 * (g - a)
            s += 0.01 * (g * g - s)
            w -= rate * (1 if norm < 1 else norm) * (a / (1 - 0.9 ** (step + 1))) / (np.sqrt(s / (1 - 0.99 ** (step + 1))) + 1e-7)
    return net


def label_positions(net: Network, steps: np.ndarray) -> np.ndarray:
    """Log probabilities (T, K, B) of every position of stretches (T, B)."""
    forward, _ = run(net, 0, steps)
    back, _ = run(net, 1, steps[::-1])
    hidden = forward.shape[1]
    logits = np.matmul(net.head[:, :hidden], forward)
    logits += np.matmul(net.head[:, hidden:], back[::-1])
    logits += net.head_bias
    logits -= logits.max(1, keepdims=True)
    logits -= np.log(np.exp(logits).sum(1, keepdims=True))
    return logits


def predict(net: Network, texts: list[bytes], stretch: int = STRETCH, lanes: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(sums (N, K) of log probabilities over each text's letter bytes, their number (N))."""
    sums, count = np.zeros((len(texts), len(net.labels))), np.zeros(len(texts), np.int64)
    sizes = np.array([len(t) for t in texts], np.int64)
    parts = -(-sizes // stretch)
    total = int(parts.sum())
    if not total:
        return sums, count
    flat = np.frombuffer(b"".join(texts) + b" " * stretch, np.uint8)
    owner = np.repeat(np.arange(len(texts)), parts)
    within = np.arange(total) - np.repeat(np.cumsum(parts) - parts, parts)
    begin = np.repeat(np.cumsum(sizes) - sizes, parts) + within * stretch
    length = np.minimum(stretch, np.repeat(sizes, parts) - within * stretch)
    by = np.argsort(length, kind="stable")  # stretches of like length run together; only the last of a text are short
    for at in range(0, total, lanes):
        some = by[at : at + lanes]
        longest = int(length[some].max())
        steps = flat[begin[some][None, :] + np.arange(longest)[:, None]]
        inside = np.arange(longest)[:, None] < length[some][None, :]
        steps = np.where(inside, steps, 32).astype(np.uint8)
        letters = _LETTER[steps] & inside
        logs = label_positions(net, steps)
        np.add.at(sums, owner[some], np.einsum("tkb,tb->bk", logs, letters.astype(np.float32)))
        np.add.at(count, owner[some], letters.sum(0))
    return sums, count


def training_sample(docs: DataFrame, lang: str, key: Column, most: int = TRAIN_DOCS) -> list[tuple[bytes, str]]:
    """At most `most` labelled (stretch of text, language) rows: of each language an even part of them, or all it has, by hash.

    A stretch of TRAIN_BYTES begins anywhere in its text. What a language gets depends on no other language's size.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col("text").isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(lang).agg(F.count("*")).limit(most + 1).collect()}
    if not counts:
        return []
    if len(counts) > most:
        raise ValueError(f"more than {most} languages: no sample of {most} documents shows all")
    each = max(1, most // len(counts))
    # more rows than needed, by ten standard deviations: the window then ranks a few rows of each language, not all
    enough = each + 10 * each**0.5 + 50
    share = F.element_at(F.create_map(*[x for k, n in counts.items() for x in (F.lit(k), F.lit(min(1.0, enough / n)))]), F.col(lang))
    drawn = known.withColumn("_h", F.pmod(F.xxhash64(F.lit(SEED), key), F.lit(1 << 30))).where(F.col("_h") / float(1 << 30) < share)
    start = F.pmod(F.xxhash64(F.lit(SEED + 1), key), F.greatest(F.length("text") - TRAIN_BYTES + 1, F.lit(1))) + 1
    drawn = drawn.select(lang, "_h", F.col("text").substr(start.cast("int"), F.lit(TRAIN_BYTES)).alias("text"))
    drawn = drawn.withColumn("_n", F.row_number().over(W.partitionBy(lang).orderBy("_h", "text"))).where(F.col("_n") <= each)
    return [(r[0].encode(), r[1]) for r in drawn.orderBy("_h", "text", lang).select("text", lang).collect()]


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most: int = TRAIN_DOCS) -> Network | None:
    """A network trained on a sample of labelled documents; None without any."""
    renamed = docs.select(F.col(doc_id).alias("_key"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = training_sample(renamed, "lang", F.col("_key"), most)
    return train([r[0] for r in rows], [r[1] for r in rows]) if rows else None


def classify(docs: DataFrame, net: Network | None, text: str = "text", pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """docs with the columns `pred` and `score` (others of these names go); looks at nothing but the text."""
    docs = docs.drop(pred, score)
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    made = docs.withColumn(pred, F.lit(None).cast("string")).withColumn(score, F.lit(0.0))
    if net is None:
        return made.withColumn(pred, F.lit(UNKNOWN))
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def scan(batches):
        net = shared.value
        names = np.array(net.labels, object)
        for batch in pieces(batches, text, 1 << 20):
            sums, count = predict(net, utf8(batch, text))
            mean = sums / np.maximum(count, 1)[:, None]
            logs = log_softmax(mean * np.minimum(count, SHARPEN)[:, None], 1)
            best = logs.argmax(1)
            cols = [*batch.columns[:-2], pa.array(names[best], pa.string()), pa.array(np.exp(logs[np.arange(len(best)), best]), pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    out = made.mapInArrow(scan, made.schema)
    return out.withColumn(score, F.when(letters, F.col(score)).otherwise(0.0)).withColumn(pred, F.when(letters, F.col(pred)).otherwise(UNKNOWN))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def keep_known(docs: DataFrame, least: float = 0.5, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """docs without the rows whose language is unknown or whose score is under `least`; the columns stay as they are."""
    net = fit(docs.where(~held_out(F.col(doc_id))), doc_id, text, lang)
    pred, score = fresh("lang_pred", docs.columns), fresh("score", docs.columns)
    return classify(docs, net, text, pred, score).where((F.col(pred) != UNKNOWN) & (F.col(score) >= least)).drop(pred, score)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = fit(docs.where(~held_out(F.col("doc_id"))))
    found = classify(docs.select("doc_id", "text"), net)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
