"""Exact copies, spelling variants and conversation repair against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import product

import duckdb
import pytest
from pyspark.sql import functions as F

from marketloom.llm import conversations, exact_dedup, queries, spelling

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, word string, n long, row string, digest string, first string"
TURNS = "conv_id long, turn long, role string, text string, at string, fault string, code string"


@pytest.mark.parametrize("name", ["op11_spelling", "op12_conversation_repair", "op13_exact_dedup"])
def test_queries_match_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    found = con.execute(queries.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(names) == sorted(got.columns)
    want = Counter(found.fetchall())
    assert Counter(tuple(r[c] for c in names) for r in got.collect()) == want and want


# ---- exact copies ----
def copies(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    out = []
    for t, (k, _) in zip(norm, rows, strict=True):
        ids = [i for u, (i, _) in zip(norm, rows, strict=True) if u == t]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((k, keep, len(ids), hashlib.sha256(t.encode()).hexdigest()))
    return Counter(out), len(set(norm))


@pytest.mark.parametrize("digest", [F.md5, lambda c: F.md5(F.left(c, F.lit(1))), lambda c: F.md5(F.lit("all"))])
def test_exact_duplicates_survive_collisions(spark, digest):
    rng = random.Random(8)
    texts = [None, "", " ", "\t\n", "a b", "a  b", "a\nb", " a b", "a b ", "A b", "é", "é", "x" * 300_000, "x" * 299_999 + "y", "a b"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts)) for _ in range(300)]
    frame = spark.createDataFrame([(k, t, "w", 1, "r", "d", "f") for k, t in rows], DOCS)
    want, groups = copies(rows)
    got = exact_dedup.exact_duplicates(frame, digest).collect()
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == groups == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)
    left = exact_dedup.without_copies(frame, digest)
    assert left.columns == frame.columns and left.count() == groups


def test_exact_duplicates_of_no_rows(spark):
    empty = spark.createDataFrame([], DOCS)
    assert exact_dedup.query(empty).count() == 0 and exact_dedup.without_copies(empty).count() == 0


# ---- spelling variants ----
def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def variants(words):
    near = {a: [b for b in words if one_edit(a, b)] for a in words}
    form = {}
    for a, bs in near.items():
        best = min(bs, key=lambda b: (-words[b], b), default=None)
        form[a] = best if best and words[best] >= spelling.FACTOR * words[a] else None
    out = set()
    for a, n in words.items():
        root = a
        while form[root]:
            root = form[root]
        out.add((a, form[a], root, n, len(near[a]), words[form[a]] if form[a] else None))
    return out


@pytest.mark.parametrize("block", [2, 512])
def test_variant_groups_match_brute_force(spark, block):
    rng = random.Random(21)
    base = ["abcabc", "banana", "éééààà", "aaaaaa", "z" * 5000, "z" * 5001, "z" * 2500 + "y" + "z" * 2500]
    words = {w: rng.choice([1, 5, 25, 130]) for w in base}
    for _ in range(350):
        w = rng.choice(base[:4])
        for _ in range(rng.randint(1, 3)):
            i = rng.randrange(len(w) + 1)
            w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice("abcé") + w[i:], w[:i] + rng.choice("abcé") + w[i + 1 :]])
        words.setdefault(w or "a", rng.choice([1, 2, 5, 11, 26, 131, 700]))
    rows = [(w, n, "clash") for w, n in words.items()] + [(None, 3, "x")]
    got = spelling.variant_groups(spark.createDataFrame(rows, "word string, n long, form string"), block_words=block).collect()
    assert {tuple(r) for r in got} == variants(words) and len(got) == len(words)


def test_vocabulary_counts_whole_texts_and_plants_deletions(spark):
    rng = random.Random(3)
    pool = ["Abcdef", "abcdef", "straße", "naïveté", "ÀBCDEF", "shorty", "short", "over×cross", "x" * 2000, "dot.less", "1234567"]
    rows = [(i if i % 50 else None, None if i % 41 == 0 else " ".join(rng.choices(pool, k=400)), "w", 1, "r", "d", "f") for i in range(300)]
    count = Counter()
    for k, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    want = {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}
    frame = spark.createDataFrame(rows, DOCS)
    assert {r["word"]: r["n"] for r in spelling.vocabulary(frame, deleted_every=199).collect()} == want and len(want) == 8
    assert {tuple(r) for r in spelling.query(frame).select("word", "form", "root", "n", "n_near", "form_n").collect()} == variants(want)
    assert spelling.query(frame.limit(0)).count() == 0


# ---- conversations ----
def least_repair(rows):
    """(cost, audit, repaired) of rows (role, text, fault), by trying every edit of every row."""
    best = {("", 0): (0, "", ())}  # (roles so far that matter, rows read)
    states = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    full = {"u": "user", "a": "assistant"}
    for i in range(len(rows) + 1):
        for _ in range(3):
            for state, after in product(list(states), "ua"):
                if (state, i) in best and after in states[state]:
                    cost, audit, out = best[state, i]
                    new = cost + 2, audit + "I", (*out, full[after] + ":")
                    key = states[state][after], i
                    best[key] = min(best.get(key, new), new)
        if i == len(rows):
            break
        role, text, fault = rows[i]
        for state in states:
            if (state, i) not in best:
                continue
            cost, audit, out = best[state, i]
            options = [(state, (cost + 3, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if role[:1] in states[state]:
                    options.append((states[state][role[:1]], (cost + more, audit + "K", (*out, f"{role}:{text}"))))
                options += [(states[state][x], (cost + more + 2, audit + "R", (*out, f"{full[x]}:{text}"))) for x in "ua" if x in states[state]]
            for after, new in options:
                best[after, i + 1] = min(best.get((after, i + 1), new), new)
    return min(best[s, len(rows)] for s in ("", "a") if (s, len(rows)) in best)


def judged(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)}"""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows if c == conv))
        seen, judged_rows, count = set(), [], Counter()
        for _, _, role, text in mine:
            bare = text.strip(conversations.SPACES)
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            count[fault] += 1
            judged_rows.append((role, text, fault))
        turns = [t for known, t, *_ in mine if known]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        bad = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(judged_rows, judged_rows[1:], strict=False))
        cost, audit, lines = least_repair(judged_rows)
        out[conv] = (gaps, count["blank"], count["duplicate"], count["truncated"], bad, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_turns(seed, convs, longest):
    rng = random.Random(seed)
    rows = []
    for c in [None, *range(convs)]:
        for t in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, "", "sage", "User"])
            text = rng.choice(["yes.", "no", "", " \n", None, "why? ", "a\nb!", "role:x.", f"own {rng.random()}.", f"cut {rng.random()}"])
            rows.append((c, rng.choice([t, t, t, t + 2, None]), role, text))
    return rows


@pytest.mark.parametrize("bits", [1, 12])
def test_repair_matches_brute_force(spark, monkeypatch, bits):
    monkeypatch.setattr(conversations, "RUN_BITS", bits)
    rows = random_turns(5, 60, 9) + [(99, i, "user" if i % 3 else "assistant", f"line {i}" + "." * (i % 4 > 0)) for i in range(40)]
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], TURNS)
    fixed, summary = conversations.repair(frame)
    sha = {r["conv_id"]: r["repaired_sha256"] for r in conversations.digests(fixed).collect()}
    none = hashlib.sha256(b"").hexdigest()
    got = {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], sha.get(r["conv_id"], none)) for r in summary.collect()}
    assert got == judged(rows)
    roles = {}
    for r in fixed.where("action <> 'delete'").orderBy("place").collect():
        roles[r["conv_id"]] = roles.get(r["conv_id"], "") + r["role"][0]
    assert all(re.fullmatch("(s?(ua)+)?", x) for x in roles.values())


def test_repair_query_matches_brute_force(spark):
    rows = random_turns(12, 120, 6)
    want = {}
    damaged = []
    for c, t, r, x in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if h == 1 else re.sub("[.!?]", "", x) if h == 2 else x
        damaged += [(c, t, "user" if h == 4 else r, x)] * (0 if h == 0 else 2 if h == 3 else 1)
    want = judged(damaged)
    none = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    frame = spark.createDataFrame([(*r, "a", "b", "c") for r in rows], TURNS)
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    got = {r["conv_id"]: tuple(r[c] for c in names) for r in conversations.query(frame).collect()}
    assert got == {c: want.get(c, none) for c in {r[0] for r in rows}}
    assert conversations.query(frame.limit(0)).count() == 0


def test_one_conversation_over_many_runs_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "RUN_BITS", 4)
    rng = random.Random(2)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["same.", f"text {t}.", f"cut {t}", ""])) for t in range(1500)]
    rows.append((7, 1500, "user", "word " * 200_000 + "."))
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    fixed, summary = conversations.repair(frame)
    sha = conversations.digests(fixed).first()["repaired_sha256"]
    r = summary.first()
    assert (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], sha) == judged(rows)[7]
