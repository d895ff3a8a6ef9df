"""Repair of conversation structure by generalised LR parsing (operator 12).

The roles of a repaired conversation follow the grammar

    C -> (empty) | s P | P        P -> u a | P u a

so a system turn may come first and user and assistant turns alternate.  Rows
are read in order by an LR automaton over a graph-structured stack: each row is
kept, deleted or given another role, rows may be inserted between, and parses
whose stack tops are equal merge into the one of least (cost, audit).  Of two
parses of the same rows and cost neither audit begins with the other, so the
merged one stays the least however the audit goes on.

Rows are sorted by range over all conversations, so a very long conversation
lies in many tasks.  It is parsed in runs of at most RUN_ROWS rows, each from
every stack top, as one letter a row; one pass in order then chains the runs
of a conversation and holds no more than its audit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import parts, written

SPACES = " \t\n\x0b\x0c\r"
ENDS = ".!?"
RUN_BITS = 12
#: A conversation is parsed in runs of at most so many rows.
RUN_ROWS = 1 << RUN_BITS

# The automaton: states after shifts, lengths of the rules that states reduce by, and states after a reduction to P.
SHIFT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 4, (3, "u"): 5, (5, "a"): 6}
REDUCE = {4: 2, 6: 3}
GOTO = {0: 3, 1: 3}
ACCEPT = (0, 3)
#: Stack tops between rows, each with a stack that has it.
START = (0, None)
TOPS = {0: START, 1: (1, START), 2: (2, START), 3: (3, START), 5: (5, (3, START))}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
NAMES = {"u": "user", "a": "assistant"}
#: One letter a row: role initial (o for any other) by clean, truncated, and to be deleted.
CODES = {"s": "sS1", "u": "uU2", "a": "aA3", "o": "oO4"}
_READ = {c: (initial, kind) for initial, codes in CODES.items() for kind, c in enumerate(codes)}
LEGAL = {"su", "ua", "au"}

Stack = tuple[int, "Stack | None"]
Parses = dict[int, tuple[int, str, Stack]]


def shifted(stack: Stack, token: str) -> Stack | None:
    """The stack after a role and the reductions that follow it, or None."""
    state = SHIFT.get((stack[0], token))
    if state is None:
        return None
    stack = (state, stack)
    while stack[0] in REDUCE:
        for _ in range(REDUCE[stack[0]]):
            stack = stack[1]
        stack = (GOTO[stack[0]], stack)
    return stack


def _merge(parses: Parses, cost: int, audit: str, stack: Stack | None) -> bool:
    """Adds a parse where its top is new or it is less than the one there.

    Stacks below equal tops may differ (with or without a system turn), but
    every reduction leads both to one top, so the links of the least are enough.
    """
    if stack is None or (stack[0] in parses and parses[stack[0]][:2] <= (cost, audit)):
        return False
    parses[stack[0]] = cost, audit, stack
    return True


def inserted(parses: Parses) -> Parses:
    """The parses and those that rows inserted here lead to."""
    todo = list(parses.values())
    while todo:
        cost, audit, stack = todo.pop()
        for role in "ua":
            after = shifted(stack, role)
            if _merge(parses, cost + INSERT, audit + "I", after):
                todo.append(parses[after[0]])
    return parses


def step(parses: Parses, code: str) -> Parses:
    """The parses after one more row."""
    initial, kind = _READ[code]
    out: Parses = {}
    for cost, audit, stack in parses.values():
        _merge(out, cost + DELETE, audit + "D", stack)
        if kind == 2:
            continue
        _merge(out, cost + kind * TRUNCATED, audit + "K", shifted(stack, initial))
        for role in "ua":
            _merge(out, cost + kind * TRUNCATED + REROLE, audit + "R", shifted(stack, role))
    return inserted(out)


@lru_cache(maxsize=20_000)
def transfer(codes: str) -> list[tuple[int, int, int, str]]:
    """(top before, top after, cost, audit) of the rows from every top."""
    out = []
    for top, stack in TOPS.items():
        parses: Parses = {top: (0, "", stack)}
        for code in codes:
            parses = step(parses, code)
        out += [(top, after, cost, audit) for after, (cost, audit, _) in sorted(parses.items())]
    return out


def illegal(codes: str) -> int:
    """Adjacent role initials that may not follow each other."""
    initials = "".join(_READ[c][0] for c in codes)
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


class Chain:
    """Chains the runs of one conversation; audits that all parses share are put aside."""

    def __init__(self) -> None:
        self.best = {top: (cost, audit) for top, (cost, audit, _) in inserted({0: (0, "", START)}).items()}
        self.shared: list[str] = []
        self.ways: list[dict[int, tuple[int, int]]] = []
        self.illegal, self.last = 0, ""

    def add(self, codes: str, table: list[tuple[int, int, int, str]]) -> None:
        best: dict[int, tuple[int, str]] = {}
        way: dict[int, tuple[int, int]] = {}
        for before, after, cost, audit in table:
            if before in self.best:
                have = self.best[before]
                now = have[0] + cost, have[1] + audit
                if after not in best or now < best[after]:
                    best[after], way[after] = now, (before, len(audit))
        same = commonprefix([a for _, a in best.values()])
        self.shared.append(same)
        self.best = {top: (cost, audit[len(same) :]) for top, (cost, audit) in best.items()}
        self.ways.append(way)
        self.illegal += illegal(self.last + codes)
        self.last = codes[-1:]

    def done(self) -> tuple[int, str, list[tuple[int, str]]]:
        """Cost, audit, and of each run its top before and its part of the audit; inserts before the first row go to the first run."""
        cost, rest, top = min((*self.best[t], t) for t in ACCEPT if t in self.best)
        audit = "".join(self.shared) + rest
        cuts, end, at = [], len(audit), top
        for way in reversed(self.ways):
            at, length = way[at]
            cuts.append((at, end - length, end))
            end -= length
        runs = [(t, audit[a:b]) for t, a, b in reversed(cuts)]
        if runs and end:
            runs[0] = 0, audit[:end] + runs[0][1]
        return cost, audit, runs


def edits(top: int, audit: str, codes: str) -> list[tuple[str, str, str, str]]:
    """Of each row: action, its new role initial, and the initials of rows inserted before it and, after the last, behind it."""
    stack: Stack = TOPS[top]
    out: list[tuple[str, str, str, str]] = []
    before = ""
    row = iter(codes)
    for action in audit:
        token = "u" if shifted(stack, "u") else "a"
        if action == "I":
            before += token
        else:
            code = next(row)
            role = {"K": _READ[code][0], "R": token, "D": ""}[action]
            out.append((action, role, before, ""))
            token, before = role, ""
        stack = shifted(stack, token) if token and action != "D" else stack
    if before and out:
        out[-1] = (*out[-1][:3], before)
    return out


def damaged(rows: DataFrame) -> DataFrame:
    """Planted faults by crc32(``conv_id:turn``) modulo 20, nulls as one space: 0 drops a row, 1 empties its text, 2 takes its ``.!?``, 3 repeats it, 4 makes it a user's."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    x = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20).alias("h"))
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return x.where("h <> 0").select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")).drop("copy")


def ordered(rows: DataFrame) -> DataFrame:
    """Rows with ``at``, which grows in the order of each conversation: turn (nulls first), role, text; nulls in role and text are one space.

    Sorted by range, so that a long conversation is in many tasks.  The range
    is by short keys only, as samples of them go to the driver; rows alike in
    the first characters of role and text follow their digest.
    """
    x = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    x = x.withColumns({"_r": F.left("role", F.lit(16)), "_t": F.left("text", F.lit(32)), "_d": F.md5(F.concat_ws("\n", "role", "text")), "_n": F.monotonically_increasing_id()})
    keys = ["conv_id", "turn", "_r", "_t", "_d", "_n"]
    x = x.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return written(x.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("at")))


def faults(rows: DataFrame) -> DataFrame:
    """conv_id, turn, at, fault (blank, duplicate, truncated or null) and code of ordered rows."""
    bare = F.rtrim("text", F.lit(SPACES))
    slim = rows.select("conv_id", "turn", "at", F.left("role", F.lit(1)).alias("initial"), "role", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.right(bare, F.lit(1)).alias("last"))
    # the first of equal rows; a text that many rows share is combined on the map side
    first = slim.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("first"))
    fault = F.when(F.col("last") == "", "blank").when(F.col("first").isNull(), "duplicate").when(~F.col("last").isin(*ENDS), "truncated")
    codes = F.lit(CODES["o"])
    for initial in "sua":
        codes = F.when(F.col("initial") == initial, CODES[initial]).otherwise(codes)
    x = slim.join(first, "at", "left").withColumn("fault", fault)
    kind = F.when(F.col("fault").isNull(), 1).when(F.col("fault") == "truncated", 2).otherwise(3)
    return x.select("conv_id", "turn", "at", "fault", F.substr(codes, kind, F.lit(1)).alias("code"))


def plans(found: DataFrame) -> DataFrame:
    """One row a run: conv_id, first (its least ``at``), top, piece (of the audit), codes, and in a conversation's first run cost, illegal and audit."""
    runs = found.groupBy("conv_id", F.shiftright("at", RUN_BITS).alias("run")).agg(F.sort_array(F.collect_list(F.struct("at", "code"))).alias("rows"))
    runs = runs.select("conv_id", F.col("rows")[0]["at"].alias("first"), F.array_join(F.col("rows.code"), "").alias("codes"))
    entry = pa.list_(pa.struct([("before", pa.int32()), ("after", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            tables = [[dict(zip(("before", "after", "cost", "audit"), x, strict=True)) for x in transfer(c)] for c in batch.column("codes").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(tables, entry)], [*batch.schema.names, "parses"])

    kind = dict(found.dtypes)["conv_id"]
    parsed = runs.mapInArrow(parse, f"conv_id {kind}, first long, codes string, parses array<struct<before: int, after: int, cost: long, audit: string>>")
    names = ["conv_id", "first", "top", "piece", "codes", "cost", "illegal", "audit"]

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, now, held = Chain(), None, []

        def out() -> list[tuple]:
            cost, audit, pieces = chain.done()
            head = (cost, chain.illegal, audit)
            return [(now, first, top, piece, codes, *(head if i == 0 else (None, None, None))) for i, ((first, codes), (top, piece)) in enumerate(zip(held, pieces, strict=True))]

        schema = None
        for batch in parts(batches):
            schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("first", pa.int64()), ("top", pa.int32()), ("piece", pa.string()), ("codes", pa.string()), ("cost", pa.int64()), ("illegal", pa.int64()), ("audit", pa.string())])
            done = []
            for conv, first, codes, table in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "first", "codes", "parses")), strict=True):
                if held and conv != now:
                    done += out()
                    chain, held = Chain(), []
                now = conv
                held.append((first, codes))
                chain.add(codes, [(x["before"], x["after"], x["cost"], x["audit"]) for x in table])
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), schema.types, strict=True)], schema=schema)
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out(), strict=True), schema.types, strict=True)], schema=schema)

    together = parsed.repartition("conv_id").sortWithinPartitions("conv_id", "first")
    return together.mapInArrow(chained, f"conv_id {kind}, first long, top int, piece string, codes string, cost long, illegal long, audit string").select(*names)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repaired rows, and what was found in each conversation.

    Rows: conv_id, place, action (keep, rerole, delete, insert), fault, role and
    text; place orders the rows of a conversation, and text is empty where
    inserted.  Conversations: conv_id, gaps, blank, duplicate, truncated,
    illegal, cost and audit.

    Each row's first fault counts: blank (nothing but white space), duplicate
    (role and text seen earlier in the conversation), truncated (the last
    character other than white space is not one of ``.!?``).  Keeping is free,
    another role costs 2, an insert 2, a deletion, which blank and duplicate
    rows must have, 3, and truncated rows that stay 1.  Null roles and texts
    are one space, null conv_ids are one conversation, null turns come first and
    count in no gap; rows alike in turn follow role and text; other roles than
    those of the grammar are given another or deleted.  An empty table gives
    empty results; other columns are ignored.
    """
    lines = ordered(rows)
    found = written(faults(lines))
    plan = written(plans(found))
    count = lambda name: F.count_if(F.col("fault") == name).alias(name)
    names = ("blank", "duplicate", "truncated")
    # turns are counted once each without gathering them
    by_turn = found.groupBy("conv_id", "turn").agg(*(count(n) for n in names))
    gaps = F.coalesce(F.max("turn").cast("long") - F.min("turn").cast("long") + 1 - F.count("turn"), F.lit(0)).alias("gaps")
    totals = by_turn.groupBy("conv_id").agg(gaps, *(F.sum(n).alias(n) for n in names))
    heads = plan.where("audit is not null").select(F.col("conv_id").alias("_c"), "illegal", "cost", "audit")
    summary = totals.join(heads, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "gaps", *names, "illegal", "cost", "audit")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            at, columns = [], []
            for first, top, piece, codes in zip(*(batch.column(c).to_pylist() for c in ("first", "top", "piece", "codes")), strict=True):
                changed = edits(top, piece, codes)
                at += range(first, first + len(changed))
                columns += changed
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), *(pa.array([c[i] for c in columns], pa.string()) for i in range(4))], ["at", "action", "initial", "before", "after"])

    changes = plan.select("first", "top", "piece", "codes").mapInArrow(apply, "at long, action string, initial string, before string, after string")
    new = lambda side: F.transform(F.filter(F.split(side, ""), lambda c: c != ""), lambda c: F.struct(F.lit("insert").alias("action"), F.lit(None).cast("string").alias("fault"), _name(c).alias("role"), F.lit("").alias("text")))
    action = F.create_map(*(F.lit(x) for pair in (("K", "keep"), ("R", "rerole"), ("D", "delete")) for x in pair))[F.col("action")]
    own = F.struct(action.alias("action"), "fault", F.when(F.col("action") == "R", _name(F.col("initial"))).otherwise(F.col("role")).alias("role"), "text")
    joined = lines.join(found.select("at", "fault"), "at").join(changes, "at")
    rows_out = joined.select("conv_id", "at", F.posexplode(F.concat(new("before"), F.array(own), new("after"))).alias("i", "x"))
    return rows_out.select("conv_id", F.struct("at", "i").alias("place"), "x.*"), summary


def _name(initial: Column) -> Column:
    return F.when(initial == "u", NAMES["u"]).otherwise(NAMES["a"])


def digests(rows: DataFrame) -> DataFrame:
    """conv_id and repaired_sha256 of the lines ``role:text`` of repaired rows, deleted ones left out.

    The digest of a conversation is one pass over its lines in order; they are
    read as a stream and not gathered.
    """
    kind = dict(rows.dtypes)["conv_id"]
    lines = rows.where("action <> 'delete'").select("conv_id", "place", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, now, kind_of = None, None, None
        for batch in parts(batches):
            kind_of = batch.schema.field("conv_id").type
            done = []
            for conv, line in zip(batch.column("conv_id").to_pylist(), batch.column("line"), strict=True):
                if state is not None and conv == now:
                    state.update(b"\n")
                else:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    state, now = hashlib.sha256(), conv
                state.update(line.as_buffer())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], kind_of), pa.array([d for _, d in done])], ["conv_id", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], kind_of), pa.array([state.hexdigest()])], ["conv_id", "repaired_sha256"])

    together = lines.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return together.select("conv_id", "line").mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


def query(conversations: DataFrame) -> DataFrame:
    """Each conv_id of the damaged rows with its faults, cost, audit and the digest of its repaired lines."""
    rows, summary = repair(damaged(conversations))
    names = conversations.select("conv_id").distinct()
    x = names.join(summary.alias("s"), names["conv_id"].eqNullSafe(F.col("s.conv_id")), "left").join(digests(rows).alias("d"), names["conv_id"].eqNullSafe(F.col("d.conv_id")), "left")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return x.select(names["conv_id"], *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


_CRC = "list_reduce(range(8), lambda c, i: case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, {0})"
_NONE = "{'c': 1000000000000, 'a': ''}"
_PLUS = "{{'c': {0}.c + {1}, 'a': {0}.a || '{2}'}}"


def _least(*options: str) -> str:
    return f"list_sort([{', '.join(options)}])[1]"


def oracle() -> str:
    """The same as a recursive query over the rows of each conversation: the least parse of each stack top (z start, s, u, a)."""
    before_u = _least("w.z", "w.s", "w.a")
    when = lambda test, value: f"case when {test} then {value} else {_NONE} end"
    plus = lambda state, cost, letter: _PLUS.format(state, cost, letter)
    steps = f"""select r.k, r.i, {plus('w.z', 3, 'D')} as z,
 {_least(plus('w.s', 3, 'D'), when("r.x = 's' and not r.forced", plus('w.z', 'r.t', 'K')))} as s,
 {_least(plus('w.u', 3, 'D'), when("r.x = 'u' and not r.forced", plus('w.b', 'r.t', 'K')), when('not r.forced', plus('w.b', '2 + r.t', 'R')))} as u,
 {_least(plus('w.a', 3, 'D'), when("r.x = 'a' and not r.forced", plus('w.u', 'r.t', 'K')), when('not r.forced', plus('w.u', '2 + r.t', 'R')))} as a
 from (select *, {before_u} as b from walk w) w join rows r on r.k = w.k and r.i = w.i + 1"""
    first = f"select k, 0::bigint as i, {{'c': 0::bigint, 'a': ''}} as z, {_NONE} as s, {_NONE} as u, {_NONE} as a from convs"

    def closed(inner: str) -> str:
        with_u = f"select k, i, z, s, {_least('u', plus('z', 2, 'I'), plus('s', 2, 'I'), plus('a', 2, 'I'))} as u, a from ({inner})"
        return f"select k, i, z, s, u, {_least('a', plus('u', 2, 'I'))} as a from ({with_u})"

    space = "[\\x20\\x09-\\x0D]"
    return f"""with recursive crc_table as (select list({_CRC.format('b::bigint')} order by b) as crcs from range(256) as bytes(b)),
named as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') as k, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name from conversations),
convs as (select k, any_value(conv_id) as conv_id from named group by 1),
hashed as (select n.*, xor(list_reduce(list_transform(range(0, length(hex(encode(name))) // 2), lambda i: ('0x' || substr(hex(encode(name)), cast(2 * i + 1 as integer), 2))::bigint), lambda s, x: xor(s >> 8, crcs[xor(s & 255, x) + 1]), 4294967295), 4294967295) % 20 as h from named n, crc_table),
damaged as (select k, turn, case when h = 4 then 'user' else role end as role, case when h = 1 then '' when h = 2 then translate(text, '.!?', '') else text end as text, unnest(range(case when h = 3 then 2 else 1 end)) as copy from hashed where h <> 0),
placed as (select *, row_number() over (partition by k order by turn nulls first, role, text) as i from damaged),
seen as (select *, not regexp_matches(text, '[^\\x20\\x09-\\x0D]') as blank, row_number() over (partition by k, role, text order by i) > 1 as again, not regexp_matches(text, '[.!?]{space}*$') as cut from placed),
rows as (select *, case when left(role, 1) in ('s', 'u', 'a') then left(role, 1) else 'o' end as x, blank or again as forced, case when cut and not blank and not again then 1 else 0 end as t from seen),
walk as ({closed(first)} union all {closed(steps)}),
ends as (select w.k, list_sort([w.z, w.a])[1] as best from walk w join (select k, max(i) as i from walk group by 1) m on m.k = w.k and m.i = w.i),
letters as (select k, best.a as audit, unnest(range(1, length(best.a) + 1)) as p from ends),
acts as (select k, p, substr(audit, cast(p as integer), 1) as act, length(replace(left(audit, cast(p as integer)), 'I', '')) as i from letters),
numbered as (select a.*, row_number() over (partition by a.k order by p) as m, r.role, r.text, r.x from acts a left join rows r on r.k = a.k and r.i = a.i and a.act <> 'I' where act <> 'D'),
topped as (select *, max(case when m = 1 and act = 'K' and x = 's' then 1 else 0 end) over (partition by k) as system from numbered),
lines as (select k, string_agg(case when act = 'K' then role when (m - system) % 2 = 1 then 'user' else 'assistant' end || ':' || case when act = 'I' then '' else text end, chr(10) order by p) as whole from topped group by 1),
pairs as (select k, count(*) filter (pair not in ('su', 'ua', 'au')) as illegal from (select k, lag(x) over (partition by k order by i) || x as pair from rows) group by 1),
counted as (select k, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (blank) as blank, count(*) filter (again and not blank) as duplicate, count(*) filter (t = 1) as truncated from rows group by 1)
select c.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate, coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, (best.c)::bigint as cost, best.a as audit, sha256(coalesce(whole, '')) as repaired_sha256
 from convs c join ends e on e.k = c.k left join counted n on n.k = c.k left join pairs p on p.k = c.k left join lines l on l.k = c.k"""
