import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import pytest
from helpers import LONG, write_tables

from emberline.llm import repair as R

SHAPE = "conv_id long, turn long, role string, text string"
ORDER = re.compile(r"(s?(ua)+)?")
WHITE = "\x20\x09\x0a\x0b\x0c\x0d"


def faults_of(rows):
    """First fault of each (role, text) of a conversation."""
    out, seen = [], set()
    for role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def all_repairs(rows, kinds):
    """The least (cost, audit) by trying all edits, with up to two inserted turns in each place."""
    inserts = [()] + [(x,) for x in "ua"] + list(itertools.product("ua", repeat=2))
    best = None
    for edits in itertools.product(("K", "Ru", "Ra", "D"), repeat=len(rows)):
        cost, ok = 0, True
        for e, kind in zip(edits, kinds):
            ok &= e == "D" or kind not in ("blank", "duplicate")
            cost += {"K": 0, "R": 1, "D": 2}[e[0]] + (5 if kind == "truncated" and e != "D" else 0)
        if not ok or best and cost > best[0]:
            continue
        for places in itertools.product(inserts, repeat=len(rows) + 1):
            total = cost + 5 * sum(map(len, places))
            if best and total > best[0]:
                continue
            audit, roles = "I" * len(places[0]), "".join(places[0])
            for (role, _), e, more in zip(rows, edits, places[1:]):
                audit += e[0] + "I" * len(more)
                roles += {"K": role[:1] or "-", "R": e[-1], "D": ""}[e[0]] + "".join(more)
            if ORDER.fullmatch(roles):
                best = min(best or (total, audit), (total, audit))
    return best


def least_repair(rows, kinds):
    """The same for long conversations: over rows and the initials that may come next."""
    follow = {"": "su", "s": "u", "u": "a", "a": "u"}

    @cache
    def rest(k, last):
        found = []
        if k == len(rows):
            if last in ("", "a"):
                return 0, ""
            c, a = rest(k, "ua"["ua".index(last) - 1] if last in "ua" else "u")
            return c + 5, "I" + a
        role, kind = rows[k][0][:1], kinds[k]
        extra = 5 if kind == "truncated" else 0
        turn = "a" if last == "u" else "u"
        found.append((2, "D", rest(k + 1, last)))
        if kind not in ("blank", "duplicate"):
            found.append((1 + extra, "R", rest(k + 1, turn)))
            if role and role in follow[last]:
                found.append((extra, "K", rest(k + 1, role)))
        # one inserted turn and then an edit of this row, or two of them
        for n, then in ((1, turn), (2, "a" if turn == "u" else "u")):
            found.append((5 * n + 2, "I" * n + "D", rest(k + 1, then)))
            if kind not in ("blank", "duplicate"):
                found.append((5 * n + 1 + extra, "I" * n + "R", rest(k + 1, "a" if then == "u" else "u")))
                if role and role in follow[then]:
                    found.append((5 * n + extra, "I" * n + "K", rest(k + 1, role)))
        return min((c + more[0], e + more[1]) for c, e, more in found)

    return rest(0, "")


def repaired(rows, audit):
    out, it = [], iter(rows)
    for e in audit:
        role, text = ("", "") if e == "I" else next(it)
        if e == "D":
            continue
        if e != "K":
            role = "assistant" if out and out[-1][0][:1] == "u" else "user"
        out.append((role, text))
    assert next(it, None) is None
    return out


def expected(conv, rows):
    """rows: (turn, role, text) in order, after damage."""
    pairs = [(r, t) for _, r, t in rows]
    kinds = faults_of(pairs)
    cost, audit = least_repair(tuple(pairs), tuple(kinds))
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in repaired(pairs, audit))
    return (conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damage(rows):
    out, show = [], lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        how = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if how == 1:
            text = ""
        if how == 2:
            text = re.sub("[.!?]", "", text)
        if how == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


TEXTS = ["Yes.", "No", "", " \t", "Why? \n", "è!", "one. two", "end."]


def test_distances_and_walks_find_the_cheapest_repair():
    rng = random.Random(1)
    for trial in range(150):
        rows = [(rng.choice(["system", "user", "assistant", "tool", ""]), rng.choice(TEXTS)) for _ in range(rng.randrange(3) if trial < 120 else 3)]
        kinds = faults_of(rows)
        codes = "".join("x" if k in ("blank", "duplicate") else (r[:1].upper() if k else r[:1]) if r[:1] in ("s", "u", "a") else "=" if k else "-" for (r, _), k in zip(rows, kinds))
        far = R.distances(codes, R.TAIL)
        edits, end = R.walk(codes, far, R.NONE)
        got = (far[0], edits + "I" * (R.TAIL[end] // 5))
        assert got == all_repairs(rows, kinds) == least_repair(tuple(rows), tuple(kinds)), rows


def conversations(seed, n=150):
    rng, rows = random.Random(seed), []
    for conv in range(n):
        for turn in range(rng.choice([1, 2, 5, 9])):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "user", "assistant", "tool", None]), rng.choice([*TEXTS, None, f"t{turn}."])))
    return rows


def in_order(rows, conv):
    return [r[1:] for r in sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))]


def test_query_equals_brute_force(spark, tmp_path):
    rows = conversations(5) + [(500, k, "user" if k % 2 else "assistant", f"w{k % 7}.") for k in range(60)] + [(501, 0, "user", LONG), (501, 9, "assistant", LONG)]
    sf = write_tables(spark, tmp_path, conversations=spark.createDataFrame(rows, SHAPE).repartition(3))
    got = {r.conv_id: tuple(r) for r in R.op12_dial_repair(spark, sf).collect()}
    after = damage(rows)
    for conv in {r[0] for r in rows}:
        own = in_order(after, conv)
        want = expected(conv, own) if own else (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
        assert got.pop(conv) == want
    assert not got


def test_a_conversation_over_many_ranges(spark):
    """Without adaptive execution, 400 rows of one conversation lie in several ranges; the others lie around it."""
    rng = random.Random(8)
    big = [(7, k, rng.choice(["user", "assistant", "system", "x"]), rng.choice(["a.", "b", "c?", f"d{k}.", f"e{k}"])) for k in range(400)]
    rows = big + [(c, k, "user", f"{k}.") for c in (1, 2, 9) for k in range(20)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        docs = spark.createDataFrame(rows, SHAPE).repartition(3)
        ordered = R.ordered_rows(docs, "conv_id", "turn", "role", "text")
        assert ordered.where("conv = 7").select("part").distinct().count() >= 3
        got = {r.conv: tuple(r) for r in R.repair(docs).collect()}
        turns = R.repaired_turns(docs).where("conv = 7").orderBy("turn").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    for conv in (1, 2, 7, 9):
        assert got[conv] == expected(conv, in_order(rows, conv))
    pairs = [(r, t) for _, r, t in in_order(rows, 7)]
    assert [(t.role, t.text) for t in turns] == repaired(pairs, got[7][7]) and [t.turn for t in turns] == list(range(len(turns)))


def test_null_ids_turns_and_repeated_rows(spark, tmp_path):
    rows = [(None, None, "user", "a."), (None, 3, "assistant", "b.")] + [(1, 2, "user", "same.")] * 30 + [(2, None, None, None)] * 3
    got = {r.conv: r for r in R.repair(spark.createDataFrame(rows, SHAPE)).collect()}
    assert set(got) == {None, 1, 2}
    assert (got[None].audit, got[None].cost, got[None].gaps) == ("KK", 0, 0)
    assert (got[1].duplicate, got[1].audit, got[1].cost, got[1].illegal) == (29, "D" * 30, 60, 29)
    assert (got[2].blank, got[2].gaps, got[2].audit) == (3, 0, "DDD")
    clash = spark.createDataFrame([(1, 0, "user", "x.", 1, 2)], SHAPE + ", part int, pos int")
    assert R.repair(clash).first().audit == "D"


@pytest.mark.parametrize("rows", [[], [(1, 0, "user", "x")]])
def test_empty_tables(spark, tmp_path, rows):
    sf = write_tables(spark, tmp_path, conversations=spark.createDataFrame(rows, SHAPE))
    assert R.op12_dial_repair(spark, sf).count() == len(rows)
