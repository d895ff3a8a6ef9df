"""Secret scans over a trigram inverted index (operator 9, DataFrame functions only).

Each rule's regex gives a Boolean trigram query: every run of literals that all
its matches hold must be there, in one of its spellings, and so must all
trigrams of that spelling.  One pass over a text gives its trigrams among those
asked for.  The index holds, for each block of documents and trigram, the list
of documents that have it; a rule's query intersects and unites these posting
lists block by block, so no list grows with the corpus.  Only documents that are
left are searched with the rule's regex.  Rules without mandatory trigrams
search all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import row_key, small_or_shuffled, written

MOST_SPELLINGS = 64
#: Documents of one block of the index, about.
BLOCK_DOCUMENTS = 4096
#: Running sums add up whole chunks of so many numbers, and the rest one by one.
CHUNK = 64


@dataclass(frozen=True)
class Rule:
    """``pattern`` holds in Java, RE2 and Python alike; matches whose ``group`` is shorter than ``least`` are dropped."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
)


def trigram_query(pattern: str) -> list[list[frozenset[str]]]:
    """All of these runs must be there, each as any of its spellings, with all its trigrams; lower case."""
    parser = re._parser
    runs: list[set[str]] = []

    def spellings(items) -> set[str] | None:
        """What the items match if that is a small set of strings, else None."""
        found = {""}
        for op, value in items:
            name = str(op)
            if name == "LITERAL":
                new = {chr(value).lower()}
            elif name == "SUBPATTERN":
                new = spellings(value[3])
            elif name == "BRANCH":
                each = [spellings(b) for b in value[1]]
                new = None if None in each else set().union(*each)
            elif name == "MAX_REPEAT" and value[1] == 1 and value[0] == 0 and (one := spellings(value[2])):
                new = one | {""}
            elif name == "IN" and len(value) <= 6 and all(str(o) == "LITERAL" for o, _ in value):
                new = {chr(v).lower() for _, v in value}
            else:
                new = None
            if new is None or len(found) * len(new) > MOST_SPELLINGS:
                return None
            found = {a + b for a, b in product(found, new)}
        return found

    now = {""}
    for item in parser.parse(pattern):
        new = spellings([item])
        if new is None or len(now) * len(new) > MOST_SPELLINGS:
            runs.append(now)
            now = {""}
        else:
            now = {a + b for a, b in product(now, new)}
    runs.append(now)
    query = []
    for run in runs:
        if min(map(len, run)) >= 3:
            grams = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in run}
            query.append(sorted((g for g in grams if not any(other < g for other in grams)), key=sorted))
    return query


def any_of(trigrams: list[str]) -> str:
    """A regex whose zero-width matches stand before each of the trigrams, which are its first group; branches by first letter."""
    by: dict[str, list[str]] = {}
    for t in sorted(trigrams):
        by.setdefault(t[0], []).append(t[1:])
    first = "".join(map(re.escape, by))
    return f"(?=[{first}])(?=(" + "|".join(re.escape(c) + "(?:" + "|".join(map(re.escape, rest)) + ")" for c, rest in by.items()) + "))"


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The index (block, trigram, documents: row keys that hold it in either case) of a table of row_key and text."""
    blocks = docs.count() // BLOCK_DOCUMENTS + 1
    held = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(any_of(trigrams)), F.lit(1)))
    block = F.pmod(F.xxhash64("row_key"), F.lit(blocks)).alias("block")
    return docs.select(block, "row_key", F.explode(held).alias("trigram")).groupBy("block", "trigram").agg(F.collect_set("row_key").alias("documents"))


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(row_key, kinds): the rules whose trigram query the document satisfies, by intersection of posting lists."""
    lists = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "documents"))).alias("lists"))
    none = F.expr("cast(array() as array<binary>)")

    def of(trigram: str) -> Column:
        return F.coalesce(F.element_at("lists", F.lit(trigram)), none)

    hits = []
    for rule in rules:
        runs = []
        for run in trigram_query(rule.pattern):
            spellings = [reduce(F.array_intersect, map(of, sorted(grams))) for grams in run]
            runs.append(reduce(F.array_union, spellings))
        if runs:
            kind = F.lit(rule.kind).alias("kind")
            hits.append(F.transform(reduce(F.array_intersect, runs), lambda k: F.struct(k.alias("row_key"), kind)))  # noqa: B023 (called at once)
    found = lists.select(F.explode(F.concat(*hits)).alias("x")).select("x.*")
    return found.groupBy("row_key").agg(F.collect_set("kind").alias("kinds"))


def _let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def _running(numbers: Column) -> Column:
    """Sums of the first 0, 1, 2 ... of the numbers: chunks first, then the rest of each chunk."""

    def add(array: Column, start: Column, n: Column) -> Column:
        return F.aggregate(F.slice(array, start, n), F.lit(0), lambda a, b: a + b)

    chunks = F.transform(F.sequence(F.lit(0), F.floor(F.size(numbers) / CHUNK).cast("int")), lambda c: add(numbers, c * CHUNK + 1, F.lit(CHUNK)))
    upto = lambda sums: F.transform(F.sequence(F.lit(0), F.size(numbers)), lambda i: add(sums, F.lit(1), F.floor(i / CHUNK).cast("int")) + add(numbers, i - i % CHUNK + 1, i % CHUNK))
    return _let(chunks, upto)


def _spans(rule: Rule, place: int, text: Column) -> Column:
    """Array of (start, place, kind, end) of the rule's matches, in code points."""
    regex = F.lit(rule.pattern)
    between = F.transform(F.split(text, rule.pattern, -1), F.length)
    whole = F.transform(F.regexp_extract_all(text, regex, F.lit(0)), F.length)
    value = F.transform(F.regexp_extract_all(text, regex, F.lit(rule.group)), F.length) if rule.group else whole

    def make(x: Column, i: Column) -> Column:
        start = x["upto_between"][i + 1] + x["upto_whole"][i]
        return F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), (start + x["whole"][i]).alias("end"), x["value"][i].alias("n"))

    def sums(x: Column) -> Column:
        return F.struct(x["whole"].alias("whole"), x["value"].alias("value"), _running(x["between"]).alias("upto_between"), _running(x["whole"]).alias("upto_whole"))

    # bound step by step, so that each regex runs once a text
    parts = F.struct(between.alias("between"), whole.alias("whole"), value.alias("value"))
    spans = _let(parts, lambda x: _let(sums(x), lambda y: F.transform(y["whole"], lambda _, i: make(y, i))))
    return F.transform(F.filter(spans, lambda s: s["n"] >= rule.least), lambda s: s.dropFields("n"))


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + MORE_RULES) -> DataFrame:
    """Spans of secrets in each text.

    Returns doc_id and spans, an array of (start, place, kind, end) in code
    points, end exclusive, by start and the order of the rules.  Matches of a
    rule are leftmost and do not overlap; those of different rules may.  One
    row per input row; a null text is empty; a null doc_id stays; equal rows
    have equal spans; an empty table gives an empty result; other columns are
    ignored.  Work grows with a text's length and CHUNK times its matches.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_key", row_key())
    asked = sorted({t for r in rules for run in trigram_query(r.pattern) for grams in run for t in grams})
    empty = F.expr("cast(array() as array<struct<start:int,place:int,kind:string,end:int>>)")
    kinds = F.lit(None).cast("array<string>")
    if asked:
        found = written(candidates(postings(keyed.select("row_key", "text"), asked), rules))
        keyed = keyed.join(small_or_shuffled(found), "row_key", "left")
        kinds = F.col("kinds")
    spans = []
    for place, rule in enumerate(rules):
        own = _spans(rule, place, F.col("text"))
        spans.append(F.when(F.array_contains(kinds, rule.kind), own).otherwise(empty) if trigram_query(rule.pattern) else own)
    return keyed.select("doc_id", F.sort_array(F.concat(*spans)).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = secret_spans(docs)
    base = F.filter("spans", lambda s: s["place"] < len(BASE_RULES))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(r.kind) for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def oracle() -> str:
    """The same rows by list functions."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    lists = []
    for place, r in enumerate(BASE_RULES + MORE_RULES):
        p = quote(r.pattern)
        lists.append(
            f"list_transform(list_filter(range(1, len(regexp_extract_all(t, {p})) + 1), lambda i: length(regexp_extract_all(t, {p}, {r.group})[i]) >= {r.least}), "
            f"lambda i: {{'s': list_sum(list_transform(string_split_regex(t, {p})[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(regexp_extract_all(t, {p})[1:i - 1], lambda x: length(x))), 0), "
            f"'p': {place}, 'k': {quote(r.kind)}, 'n': length(regexp_extract_all(t, {p})[i])}})"
        )
    joined = "coalesce(list_aggregate(list_transform({0}, lambda s: s.k || ':' || cast(cast(s.s as bigint) as varchar) || ':' || cast(cast(s.s + s.n as bigint) as varchar)), 'string_agg', ','), '')"
    counts = ", ".join(f"len(list_filter(v, lambda s: s.k = '{r.kind}')) as n_{r.kind}" for r in BASE_RULES)
    base = joined.format(f"list_filter(v, lambda s: s.p < {len(BASE_RULES)})")
    return f"""
with docs as (select doc_id, coalesce(text, '') as t from documents),
found as (select doc_id, list_sort(list_concat({", ".join(lists)})) as v from docs)
select doc_id, {counts}, sha256({base}) as base_sha256, {joined.format("v")} as spans from found
"""
