"""Conversation repair against a brute-force version that keeps whole strings and works backwards."""

import hashlib
import itertools
import random
import sys
import zlib
from functools import lru_cache

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from leadlens.llm import conversation_repair as C
from leadlens.llm import queries as Q

SCHEMA = "conv_id long, turn long, role string, text string"
sys.setrecursionlimit(20_000)  # the brute-force version recurses row by row
BLANK = " \t\n\x0b\x0c\r"


def damage(rows):
    """rows: (conv, turn, role, text) -> {conv: rows (turn, role, text) in order}; ties as the operator orders them."""
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        drawn = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(drawn.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if kind == 0:
            continue
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    for conv, held in out.items():
        key = "n" if conv is None else f"c{conv}"
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, hashlib.sha256(
            "\0".join([key, str(len(r[1])), r[1], r[2]]).encode()).hexdigest()))
    return out


def row_faults(rows):
    out, seen = [], set()
    for _, role, text in rows:
        shown = [c for c in text if c not in BLANK]
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else
                   "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(initials, faults):
    """(cost, audit) by trying every edit from every row and prefix of the pattern, later rows first."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @lru_cache(None)
    def best(at, last, inserted):
        offers = [(0, "")] if at == len(initials) and last in ("", "a") else []
        tries = []
        if inserted < 3:
            tries += [(3, "I", at, step[last, r], inserted + 1) for r in "ua" if (last, r) in step]
        if at < len(initials):
            tries.append((4, "D", at + 1, last, 0))
            if faults[at] not in ("blank", "duplicate"):
                more = 3 * (faults[at] == "truncated")
                if (last, initials[at]) in step:
                    tries.append((more, "K", at + 1, step[last, initials[at]], 0))
                tries += [(3 + more, "R", at + 1, step[last, r], 0) for r in "ua" if (last, r) in step]
        for cost, letter, *then in tries:
            rest = best(*then)
            if rest:
                offers.append((cost + rest[0], letter + rest[1]))
        return min(offers, default=None)

    return best(0, "", 0)


def brute(rows):
    out = {}
    for conv, held in damage(rows).items():
        found = row_faults(held)
        initials = [r[1][:1] for r in held]
        turns = [r[0] for r in held if r[0] is not None]
        cost, audit = cheapest(tuple(initials), tuple(found))
        left, at = [], 0
        for letter in audit:
            last = left[-1][:1] if left else ""
            put = "assistant" if last == "u" else "user"
            if letter in "KR":
                left.append(f"{held[at][1] if letter == 'K' else put}:{held[at][2]}")
            elif letter == "I":
                left.append(f"{put}:")
            at += letter != "I"
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
                     *(found.count(f) for f in ("blank", "duplicate", "truncated")),
                     sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)), cost, audit,
                     hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def table(result):
    rows = result.collect()
    out = {r.conv_id: tuple(r[c] for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                                           "repaired_sha256")) for r in rows}
    assert len(out) == len(rows)
    return out


def conversations(seed, n, longest, roles=("user", "assistant", "system", "tool", "", None)):
    draw = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(draw.randrange(1, longest)):
            text = draw.choice(["Yes.", "No!", "Why?", "so", "", " \t", "Long text. And", None, "é.", f"t{turn}."])
            usual = ("user", "assistant")[turn % 2]
            rows.append((conv, draw.choice([turn, turn, turn, None, turn + 3]), draw.choice([usual, usual, usual, *roles]), text))
    return rows


@given(st.lists(st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans()), max_size=9), st.sampled_from([7, 101, C.HASH_PRIME]))
@settings(max_examples=300, deadline=None)
def test_audit_is_cheapest_and_least(rows, prime):
    """A tiny modulus makes most hashes collide, so this also tries the verification."""
    faults = ["blank" if gone else "truncated" if cut else None for _, gone, cut in rows]
    cost, audit, _ = C.finished(C.transfer(rows, 0, prime))
    assert (cost, audit) == cheapest(tuple(r[0] for r in rows), tuple(faults))


def test_prefixes_compare_as_strings():
    tree, strings = C.Prefixes(prime=5), {0: ""}
    draw = random.Random(1)
    for _ in range(300):
        parent = draw.choice(list(strings))
        letter = draw.choice("DIKR")
        strings[tree.add(parent, letter)] = strings[parent] + letter
    for _ in range(3000):
        a, b = draw.choice(list(strings)), draw.choice(list(strings))
        assert tree.less(a, b) == (strings[a] < strings[b])
        assert tree.text(a) == strings[a]


@pytest.mark.parametrize("segment", [C.SEGMENT, 3])
def test_matches_brute_force(spark, segment):
    """Segments of three rows divide most conversations, over segments and over partitions."""
    rows = conversations(7, 60, 14) + [(None, 1, "user", "Hi."), (None, None, "assistant", "Oh."), (10**12, None, None, None)]
    got = table(C.repair(spark.createDataFrame(rows, SCHEMA), segment).conversations)
    assert got == brute(rows)


def test_one_conversation_over_many_partitions_and_steps(spark, monkeypatch):
    monkeypatch.setattr(C, "FAN", 4)
    rows = conversations(3, 1, 2) + [(5, t, ("user", "assistant", "user")[t % 3], f"w{t}" + "."[: t % 4]) for t in range(300)]
    result = C.repair(spark.createDataFrame(rows, SCHEMA).repartition(5), 7)
    assert table(result.conversations) == brute(rows)
    left = [r.body for r in result.bodies.where("key = 'c5' and rows_left > 0").orderBy("seq").collect()]
    assert hashlib.sha256("\n".join(left).encode()).hexdigest() == brute(rows)[5][-1]


def test_empty_table_and_clashing_columns(spark):
    assert C.repair(spark.createDataFrame([], SCHEMA)).conversations.count() == 0
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    more = spark.createDataFrame([(*r, "x", 3) for r in rows], SCHEMA + ", key string, audit int")
    assert table(C.repair(more).conversations) == brute(rows)


def test_registered_query_on_the_given_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert table(Q.QUERIES["op13_conversation_repair"](spark, sf)) == brute(rows)
