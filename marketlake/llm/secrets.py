"""Secret scans, natively: Boolean trigram queries from each rule, posting lists, and verification of candidates.

Each rule's regex gives a Boolean query over lower-cased trigrams that every match must hold: a literal needs all its
trigrams, alternatives need one of their queries. Postings (trigram, document) are built for the trigrams of all rules,
intersected and united as the queries say, and only the candidate documents of a rule are scanned with its regex. A
rule whose regex has no mandatory trigram scans every document. Everything is SQL functions.

Base kinds: assign, access and hex. The method adds rules for further key formats; their spans join the base ones.

Defined results: a null or empty text has no spans; documents that repeat an id are told apart by their text, and equal
rows get equal results, each its own; an empty table gives no rows; a text of any length is scanned whole, and the work
grows little faster than its matches; other columns are not read. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_
from re import _constants as c
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marketlake.llm.common import table, write_shared


@dataclass(frozen=True)
class Rule:
    """pattern: in the syntax that Java, RE2 and Python share. A match counts if group `of` has at least `least` characters."""

    kind: str
    pattern: str
    of: int = 0
    least: int = 1


# The base kinds of the contract. A run of 20 or 24 characters is asked for inside the pattern where the
# runs are maximal, so a failing match never hides another one.
BASE = (
    Rule("assign", r"(?i:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?)([A-Za-z0-9+/_.=-]+)", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
)

# Published formats of further credentials.
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
)


# --- Boolean trigram queries ------------------------------------------------------------------------------------------

# A query is True (no condition), a trigram, ("and", queries) or ("or", queries).


def _all(parts: list) -> object:
    flat = [x for p in parts if p is not True for x in (p[1] if isinstance(p, tuple) and p[0] == "and" else [p])]
    flat = tuple(dict.fromkeys(flat))
    return True if not flat else flat[0] if len(flat) == 1 else ("and", flat)


def _terms(query: object) -> set:
    return {query} if isinstance(query, str) or query[0] == "or" else set(query[1])


def _any(parts: list) -> object:
    if any(p is True for p in parts):
        return True
    parts = list(dict.fromkeys(parts))
    # a condition that holds whenever a longer one does makes that one needless
    parts = [p for p in parts if not any(_terms(o) < _terms(p) for o in parts)]
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_literal(text: str) -> object:
    return _all([text[i : i + 3] for i in range(len(text) - 2)])


#: Most exact strings that a part of a regex is followed through.
MOST_STRINGS = 64


def _strings(node) -> set[str] | None:
    """All strings that a parsed part can match, lower-cased; None if they are many or unbounded."""
    op, arg = node
    if op is c.LITERAL:
        return {chr(arg).lower()}
    if op is c.IN:
        out: set[str] = set()
        for kind, value in arg:
            if kind is c.LITERAL:
                out.add(chr(value).lower())
            elif kind is c.RANGE and value[1] - value[0] < 8:
                out |= {chr(x).lower() for x in range(value[0], value[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is c.SUBPATTERN:
        return _sequence_strings(arg[-1])
    if op is c.BRANCH:
        parts = [_sequence_strings(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is c.MAX_REPEAT and arg[1] <= 2:
        one = _sequence_strings(arg[2])
        if one is None:
            return None
        out, now = set(), {""}
        for n in range(arg[1] + 1):
            out |= now if n >= arg[0] else set()
            now = {a + b for a in now for b in one}
        return out if len(out) <= MOST_STRINGS else None
    return None


def _sequence_strings(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        part = _strings(node)
        if part is None or len(out) * len(part) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in part}
    return out


def _query(nodes) -> object:
    """The condition of a parsed sequence: of its stretches of exact strings, and of the other parts in themselves."""
    parts, held = [], {""}

    def close() -> None:
        nonlocal held
        parts.append(_any([_of_literal(x) for x in sorted(held)]))
        held = {""}

    for node in nodes:
        some = _strings(node)
        if some is not None and len(held) * len(some) <= MOST_STRINGS:
            held = {a + b for a in held for b in some}
            continue
        close()
        op, arg = node
        if some is not None:
            held = some
        elif op is c.SUBPATTERN:
            parts.append(_query(arg[-1]))
        elif op is c.BRANCH:
            parts.append(_any([_query(x) for x in arg[1]]))
        elif op is c.MAX_REPEAT and arg[0] >= 1:
            parts.append(_query(arg[2]))
    close()
    return _all(parts)


def trigram_query(pattern: str) -> object:
    """Over lower-cased text, so it holds for letters in either case."""
    return _query(_parser.parse(pattern))


def trigrams(query: object) -> set[str]:
    return set() if query is True else {query} if isinstance(query, str) else set().union(*map(trigrams, query[1]))


def _holds(query: object, have: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(have, query)
    parts = [_holds(q, have) for q in query[1]]
    out = parts[0]
    for p in parts[1:]:
        out = out & p if query[0] == "and" else out | p
    return out


# --- index and scan ---------------------------------------------------------------------------------------------------


def postings(docs: DataFrame, wanted: set[str], key: list[str], text: str) -> DataFrame:
    """The inverted index over the wanted trigrams: (trigram, *key), a row for each document that holds the trigram."""
    present = F.array(*[F.when(F.contains(F.col("_low"), F.lit(t)), F.lit(t)) for t in sorted(wanted)])
    low = docs.select(*key, F.lower(text).alias("_low"))
    return low.select(F.explode(F.array_compact(present)).alias("trigram"), *key)


def candidates(index: DataFrame, queries: dict[str, object], key: list[str]) -> DataFrame:
    """(*key, kinds): the rules whose queries hold, from posting lists united by document."""
    have = index.groupBy(*key).agg(F.collect_set("trigram").alias("_have"))
    kinds = F.array_compact(F.array(*[F.when(_holds(q, F.col("_have")), F.lit(k)) for k, q in queries.items()]))
    return have.select(*key, kinds.alias("_kinds")).where(F.size("_kinds") > 0)


def cover(query: object, sizes: dict[str, int]) -> frozenset[str]:
    """Trigrams of which every document that meets the query holds one: those with the shortest posting lists."""
    if isinstance(query, str):
        return frozenset([query])
    parts = [cover(q, sizes) for q in query[1]]
    if query[0] == "or":
        return frozenset().union(*parts)
    return min(parts, key=lambda c: (sum(sizes.get(t, 0) for t in c), sorted(c)))


def spans_of(text: Column, rule: Rule) -> Column:
    """array<struct<start, end, kind>> of a rule's leftmost non-overlapping matches that count.

    The pieces between matches and the matches alternate, so a match starts after the lengths of all before it. Lengths
    are summed in chunks of about the root of their number: an array that grows match by match would be copied each time.
    """
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = (lambda m: F.length(F.regexp_extract(m, rule.pattern, rule.of))) if rule.of else F.length
    both = F.arrays_zip(F.transform(found, F.length).alias("n"), F.transform(found, counted).alias("g"), F.transform(F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found)), F.length).alias("b"))

    def chunked(rows: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(rows))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.size(rows) - 1, width), lambda i: F.slice(rows, i + 1, width))
        start = F.expr("cast(array() as array<int>)")

        def place(acc: Column, x: Column) -> Column:
            return F.struct((acc["at"] + x["b"] + x["n"]).alias("at"), F.array_append(acc["out"], acc["at"] + x["b"]).alias("out"))

        # starts inside each chunk, and its length; then where each chunk begins
        inner = F.transform(chunks, lambda c: F.struct(c.alias("rows"), F.aggregate(c, F.struct(F.lit(0).alias("at"), start.alias("out")), place).alias("sums")))

        def begin(acc: Column, c: Column) -> Column:
            return F.struct((acc["at"] + c["sums"]["at"]).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out"))

        def spans(chunks: Column) -> Column:
            begins = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), start.alias("out")), begin, lambda acc: acc["out"])

            def of_chunk(c: Column, at: Column) -> Column:
                return F.zip_with(c["rows"], c["sums"]["out"], lambda x, b: F.struct((at + b).alias("start"), (at + b + x["n"]).alias("end"), (x["g"] >= rule.least).alias("ok")))

            flat = F.flatten(F.zip_with(chunks, begins, of_chunk))
            return F.transform(F.filter(flat, lambda x: x["ok"]), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), F.lit(rule.kind).alias("kind")))

        return _bound(inner, spans)

    none = F.expr("cast(array() as array<struct<start: int, end: int, kind: string>>)")
    return F.when(F.size(found) > 0, _bound(both, chunked)).otherwise(none)


def _bound(value: Column, use) -> Column:
    """use(value), with value worked out once."""
    return F.transform(F.array(value), use)[0]


def find_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and spans (array<struct<start, end, kind>>, by start, then in the order of the rules) of every document.

    The index is keyed by id and a hash of the text; candidates come back to the texts by a join on that key.
    """
    spark = docs.sparkSession
    key = ["doc_id", "_hash"]
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("_hash", F.xxhash64("text"))
    queries = {r.kind: trigram_query(r.pattern) for r in rules}
    indexed = {k: q for k, q in queries.items() if q is not True}
    rank = F.create_map(*[x for n, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(n))])
    none = F.expr("cast(array() as array<struct<start: int, end: int, kind: string>>)")

    def spans(each: list[Column]) -> Column:
        ranked = F.transform(F.flatten(F.array(*each)), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("n"), s["end"].alias("end"), s["kind"].alias("kind")))
        return F.transform(F.array_sort(ranked), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))

    everywhere = [spans_of(F.col("text"), r) for r in rules if r.kind not in indexed]
    if not indexed:
        return docs.select("doc_id", spans(everywhere).alias("spans"))
    index = spark.read.parquet(write_shared(postings(docs, set().union(*map(trigrams, indexed.values())), key, "text"), "postings"))
    sizes = {r["trigram"]: r["n"] for r in index.groupBy("trigram").agg(F.count("*").alias("n")).collect()}  # a row for each of the rules' trigrams at most
    # a trigram without postings is in no document, so it needs no search
    needed = sorted(t for t in frozenset().union(*(cover(q, sizes) for q in indexed.values())) if t in sizes)
    maybe = _bound(F.lower("text"), lambda low: reduce(or_, [F.contains(low, F.lit(t)) for t in needed], F.lit(False)))
    found = candidates(index, indexed, key).select(F.col("doc_id").alias("_id"), F.col("_hash").alias("_h"), "_kinds")
    near = docs.where(maybe).join(found, docs["doc_id"].eqNullSafe(found["_id"]) & (docs["_hash"] == found["_h"]), "left")
    each = [F.when(F.array_contains("_kinds", r.kind), spans_of(F.col("text"), r)).otherwise(none) for r in rules if r.kind in indexed]
    near = near.select("doc_id", spans([*each, *everywhere]).alias("spans"))
    around = docs.where(~maybe).select("doc_id", (spans(everywhere) if everywhere else none).alias("spans"))
    return near.unionByName(around)


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.col("spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    counts = [F.size(F.filter(spans, lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}") for kind in (r.kind for r in BASE)]
    found = find_secrets(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"))


def _oracle() -> str:
    """Each rule over every text, without an index: pieces between matches and matches alternate."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    each = [
        f"SELECT k, {n} AS rank, {quote(r.kind)} AS kind, {r.least} AS least, regexp_extract_all(t, {quote(r.pattern)}, 0) AS m, "
        f"regexp_extract_all(t, {quote(r.pattern)}, {r.of}) AS g, string_split_regex(t, {quote(r.pattern)}) AS b FROM d"
        for n, r in enumerate(BASE + MORE)
    ]
    counts = ", ".join(f"CAST(count(*) FILTER (WHERE kind = {quote(r.kind)}) AS BIGINT) AS n_{r.kind}" for r in BASE)
    base = ", ".join(quote(r.kind) for r in BASE)
    return f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
e AS ({" UNION ALL ".join(each)}),
u AS (SELECT k, rank, kind, least, m, g, b, unnest(range(1, len(m) + 1)) AS i FROM e WHERE len(m) > 0),
s AS (SELECT k, rank, kind, list_sum(list_transform(b[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start, length(m[i]) AS n FROM u WHERE length(g[i]) >= least),
j AS (SELECT k, {counts},
  string_agg(kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + n AS BIGINT) AS VARCHAR), ',' ORDER BY start, rank) FILTER (WHERE kind IN ({base})) AS base,
  string_agg(kind || ':' || CAST(CAST(start AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(start + n AS BIGINT) AS VARCHAR), ',' ORDER BY start, rank) AS spans
  FROM s GROUP BY k)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j USING (k)
"""


ORACLE = _oracle()
