"""Quality rules by weak supervision: rules vote or abstain, EM estimates their accuracies, a posterior decides.

Each rule votes good (+1), bad (-1) or abstains (0) on a document's statistics. The model: a document is good with an
unknown share; a rule that votes is right on good documents with one accuracy and on bad ones with another, and its
abstaining says nothing. EM runs over the counts of vote patterns, at most 3**rules rows, which cover every document;
the posterior of a document is a sum of rule weights.

Each estimate has a beta prior, stated below, whose weight is a share of the documents, so it means the same at any size
and no estimate reaches 0 or 1.

Defined results: a null or wordless text has zero counts, fails the base rule and is not kept; a text of any length is
read whole; repeated rows keep their own rows; only the two columns named are read; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.common import pieces, table, write_shared

SPACE = " \t\n\x0b\x0c\r"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = b"#*$%&|<>"
_DIGITS = b"0123456789"
_ENDS = (".", "!", "?", '"', "'", ":", ";", "…", "”", "»")

STATS = {
    "n_words": "words", "word_chars": "code points in words", "n_symbols": "characters of #*$%&|<>",
    "n_dup_lines": "lines with a word that equal an earlier line", "n_repeat_words": "words in 3-word windows found twice or more",
    "n_lines": "lines with a word", "n_end_lines": "of these, lines that end like a sentence", "n_digits": "ASCII digits",
    "n_distinct": "distinct words",
}


def repeated_words(words: list[str], window: int = 3) -> tuple[int, int]:
    """(words covered by windows that occur twice or more, distinct words)."""
    first: dict[str, int] = {}
    ids = np.fromiter(map(first.setdefault, words, range(len(words))), np.int64, len(words))
    n = len(words) - window + 1
    if n < 2:
        return 0, len(first)
    key = np.unique(ids, return_inverse=True)[1]
    for k in range(1, window):  # pairs, then triples, renumbered so that keys stay small
        key = np.unique(key[:-1] * (len(words) + 1) + np.unique(ids, return_inverse=True)[1][k:], return_inverse=True)[1]
    twice = np.bincount(key)[key] > 1
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum()), len(first)


def statistics(text: str) -> tuple[int, ...]:
    """The values of STATS for one text."""
    words = _WORDS.findall(text)
    raw = text.encode()
    lines = [x for x in text.split("\n") if x.strip(SPACE)]
    repeat, distinct = repeated_words(words)
    return (
        len(words), sum(map(len, words)), len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat,
        len(lines), sum(x.rstrip(SPACE).endswith(_ENDS) for x in lines), len(raw) - len(raw.translate(None, _DIGITS)), distinct,
    )


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs (doc_id, text) with the long columns of STATS in place of the text."""

    def scan(batches):
        for batch in pieces(batches, text, 2 << 20):
            rows = [statistics(t or "") for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] if rows else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", *STATS])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", text).mapInArrow(scan, f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in STATS))


@dataclass(frozen=True)
class Rule:
    """SQL conditions on STATS; a document that meets neither gets no vote."""

    name: str
    good: str
    bad: str


RULES = (
    Rule("length", "n_words >= 80", "n_words < 50"),
    Rule("word_length", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 12 * n_words"),
    Rule("symbols", "100 * n_symbols <= n_words", "10 * n_symbols > n_words"),
    Rule("symbol_flood", "2 * n_symbols <= n_words", "n_symbols > n_words"),
    Rule("dup_lines", "n_lines >= 2 and n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repeats", "100 * n_repeat_words <= 10 * n_words and n_words >= 20", "100 * n_repeat_words > 30 * n_words"),
    Rule("endings", "10 * n_end_lines >= 7 * n_lines and n_lines > 0", "10 * n_end_lines < 3 * n_lines"),
    Rule("digits", "50 * n_digits <= word_chars and n_words > 0", "10 * n_digits > 2 * word_chars"),
    Rule("variety", "n_words >= 50 and 100 * n_distinct >= 35 * n_words", "n_words >= 50 and 100 * n_distinct < 15 * n_words"),
)

@dataclass(frozen=True)
class Prior:
    """A beta prior: its mean, and its weight in votes (or documents) for each document of the corpus, besides one."""

    mean: float
    weight: float


#: Rules are written to fire on next to no good document; one that fires on many documents alone outweighs this belief.
ON_GOOD = Prior(0.998, 0.25)
#: Of bad documents a rule finds some; the data say how many.
ON_BAD = Prior(0.3, 0.005)
#: Most documents are good. EM starts at the means.
SHARE = Prior(0.8, 0.05)
ROUNDS = 200


def vote(rule: Rule) -> Column:
    return F.expr(f"case when {rule.bad} then -1 when {rule.good} then 1 else 0 end")


@dataclass(frozen=True)
class VoteModel:
    """on_good and on_bad: the share of a rule's votes that are right on good and on bad documents."""

    share: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def weights(self) -> list[tuple[float, float]]:
        """For each rule what a bad and a good vote add to the log odds of a good document."""
        return [(math.log((1 - g) / b), math.log(g / (1 - b))) for g, b in zip(self.on_good, self.on_bad, strict=True)]

    def log_odds(self, votes: Column) -> Column:
        out = F.lit(math.log(self.share / (1 - self.share)))
        for n, (bad, good) in enumerate(self.weights()):
            out = out + F.when(votes[n] == 1, good).when(votes[n] == -1, bad).otherwise(0.0)
        return out


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> VoteModel:
    """Accuracies and share of good documents from vote patterns (rows of -1, 0, 1) and how often each occurs.

    A rule is never taken for its opposite: a good vote is held at least as likely on good documents as on bad ones. The
    prior of accuracies on good documents keeps EM from taking the few documents that trip all rules for the bad ones, and
    the rest for good.
    """
    n = patterns.shape[1]
    on_good, on_bad, share = np.full(n, ON_GOOD.mean), np.full(n, ON_BAD.mean), SHARE.mean
    plus, minus, total = patterns == 1, patterns == -1, counts.sum()

    def posterior(prior: Prior, hits, tries):
        weight = 1 + prior.weight * total
        return (hits + prior.mean * weight) / (tries + weight)

    for _ in range(rounds if total else 0):
        odds = math.log(share / (1 - share)) + plus @ np.log(on_good / (1 - on_bad)) + minus @ np.log((1 - on_good) / on_bad)
        good = 1 / (1 + np.exp(-odds))
        w_good, w_bad = (good * counts)[:, None], ((1 - good) * counts)[:, None]
        new_good = posterior(ON_GOOD, (plus * w_good).sum(0), ((plus | minus) * w_good).sum(0))
        new_bad = np.maximum(posterior(ON_BAD, (minus * w_bad).sum(0), ((plus | minus) * w_bad).sum(0)), 1 - new_good)
        new_share = float(posterior(SHARE, (good * counts).sum(), total))
        moved = max(np.abs(new_good - on_good).max(initial=0), np.abs(new_bad - on_bad).max(initial=0), abs(new_share - share))
        on_good, on_bad, share = new_good, new_bad, new_share
        if moved < 1e-9:
            break
    return VoteModel(share, tuple(on_good.tolist()), tuple(on_bad.tolist()))


def judge(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, least: float = 0.5) -> DataFrame:
    """doc_id, the statistics, votes (array in the order of rules), posterior, base_failed and kept."""
    spark = docs.sparkSession
    measured = measure(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")))
    measured = spark.read.parquet(write_shared(measured.withColumn("votes", F.array(*map(vote, rules))), "quality"))
    rows = sorted((tuple(r["votes"]), r["n"]) for r in measured.groupBy("votes").agg(F.count("*").alias("n")).collect())
    model = expectation_maximisation(np.array([r[0] for r in rows], np.int64).reshape(-1, len(rules)), np.array([r[1] for r in rows], np.float64))
    posterior = 1 / (1 + F.exp(-model.log_odds(F.col("votes"))))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return measured.withColumn("posterior", posterior).withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("posterior") >= least))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
