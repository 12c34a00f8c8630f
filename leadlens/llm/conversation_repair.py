"""Conversation structure repair with a persistent audit of the edits.

A conversation is well formed when the initials of its roles read ``(s?(ua)+)?``. Each row is kept (K, free), gets the
role user or assistant (R, 3) or is deleted (D, 4); blank and duplicate rows must be deleted, truncated rows that stay
cost 3 more, and empty-text rows are inserted anywhere (I, 3). The cheapest edits are found by a DP over rows and four
states of the pattern; ties go to the audit, the string of edit letters, that is least in ASCII.

The DP keeps its audits as prefixes in a persistent tree: a node holds one letter, its ancestors 1, 2, 4, ... letters
back and a rolling hash of its whole prefix, so extending an audit is one node and all audits share their beginnings. Two
audits of equal cost are compared by the longest common prefix, found by lifting both by powers of two while the hashes
differ; equal hashes of different nodes are verified letter by letter. No audit is a proper prefix of another of equal
cost over the same rows, as the rest would be inserts, which cost; so the least prefix stays least with any continuation.

Scale: rows are range partitioned on (conversation, turn), so one that holds a third of all rows lies in many partitions.
A partition is read as a stream and cut at conversations and at ``segment`` rows or SEGMENT_CHARS characters. A segment
that is not a whole conversation reports the best audit from each state to each state; those are joined in a tree of FAN
segments a step, and each segment then gets its part of the chosen audit. The SHA-256 of a conversation is sequential by
definition: the segments of a divided conversation pass one task in order, as a stream with one hash held.

Order: by turn, nulls first; rows of one turn by a SHA-256 of conversation, role and text (the contract leaves them open),
then as the table has them. Edge cases: null roles and texts are one space, as are null ids and turns in the text that
damage is drawn from; a null conversation id is a conversation of its own; a role without characters has no initial and
can't be kept; rows that repeat are duplicates of the first; a conversation without rows has zeros, an empty audit and the
hash of the empty string; an empty table gives an empty result; gaps beyond a long are null; other columns are ignored, so
their names can't clash.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
#: Rows and characters of a segment; segments joined at once.
SEGMENT, SEGMENT_CHARS, FAN = 2048, 8_000_000, 64
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"

#: States: nothing yet, after s, after u, after a. What a kept initial, or a user or assistant row put there, leads to.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
PUT = (2, 2, 3, 2)
LEGAL = {"su", "ua", "au"}

HASH_BASE, HASH_PRIME = 1_000_003, (1 << 61) - 1


class Prefixes:
    """Strings of edit letters as nodes that share their beginnings. Node 0 is the empty string."""

    def __init__(self, prime: int = HASH_PRIME):
        self.prime = prime
        self.letter, self.depth, self.hash, self.ups = [""], [0], [0], [()]

    def add(self, parent: int, letter: str) -> int:
        ups, k = [parent], 0
        while len(above := self.ups[ups[k]]) > k:  # 2^(k+1) letters back: twice 2^k
            ups.append(above[k])
            k += 1
        self.letter.append(letter)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * HASH_BASE + ord(letter)) % self.prime)
        self.ups.append(tuple(ups))
        return len(self.letter) - 1

    def lift(self, node: int, depth: int) -> int:
        while (up := self.depth[node] - depth) > 0:
            node = self.ups[node][up.bit_length() - 1]
        return node

    def same(self, a: int, b: int) -> bool:
        """Equal strings of equal length; equal hashes are verified down to the node that both share."""
        if a != b and self.hash[a] != self.hash[b]:
            return False
        while a != b:
            if self.letter[a] != self.letter[b]:
                return False
            a, b = self.ups[a][0], self.ups[b][0]
        return True

    def less(self, a: int, b: int) -> bool:
        depth = min(self.depth[a], self.depth[b])
        x, y = self.lift(a, depth), self.lift(b, depth)
        if self.same(x, y):
            return self.depth[a] < self.depth[b]
        for k in reversed(range(len(self.ups[x]))):
            if k < len(self.ups[x]) and not self.same(self.ups[x][k], self.ups[y][k]):
                x, y = self.ups[x][k], self.ups[y][k]
        return self.letter[x] < self.letter[y]

    def text(self, node: int) -> str:
        letters = []
        while node:
            letters.append(self.letter[node])
            node = self.ups[node][0]
        return "".join(reversed(letters))


@dataclass
class Best:
    """The best audit into each state: cost and node, or None."""

    tree: Prefixes
    held: list[tuple[int, int] | None]

    def offer(self, state: int, cost: int, parent: int, letter: str) -> None:
        now = self.held[state]
        if now is None or cost < now[0]:
            self.held[state] = (cost, self.tree.add(parent, letter))
        elif cost == now[0]:
            node = self.tree.add(parent, letter)
            if self.tree.less(node, now[1]):
                self.held[state] = (cost, node)

    def insert(self) -> None:
        """Inserts at a gap: into state 2 from 0, 1 and 3, then from 2 into 3; more would only go round."""
        for state in (0, 1, 3, 2):
            if self.held[state] is not None:
                cost, node = self.held[state]
                self.offer(PUT[state], cost + INSERT_COST, node, INSERT)


def transfer(rows: list[tuple[str, bool, bool]], start: int, prime: int = HASH_PRIME) -> dict[int, tuple[int, str]]:
    """Best (cost, audit) from ``start`` into each state over rows of (initial, must go, truncated).

    Inserts come before rows; those after the last row belong to what follows.
    """
    tree = Prefixes(prime)
    best = Best(tree, [None] * 4)
    best.held[start] = (0, 0)
    for initial, must_go, truncated in rows:
        best.insert()
        after = Best(tree, [None] * 4)
        for state, found in enumerate(best.held):
            if found is None:
                continue
            cost, node = found
            after.offer(state, cost + DELETE_COST, node, DELETE)
            if must_go:
                continue
            cost += TRUNCATED_COST * truncated
            if initial in KEPT[state]:
                after.offer(KEPT[state][initial], cost, node, KEEP)
            after.offer(PUT[state], cost + REROLE_COST, node, REROLE)
        best = after
    return {state: (found[0], tree.text(found[1])) for state, found in enumerate(best.held) if found is not None}


def finished(ends: dict[int, tuple[int, str]]) -> tuple[int, str, int]:
    """(cost, audit, state before the last inserts) of the best accepted end: nothing, or after an assistant."""
    offers = [(cost + INSERT_COST * more, audit + INSERT * more, state) for state, (cost, audit) in ends.items()
              for more, end in ((0, state), (1, PUT[state]), (2, PUT[PUT[state]])) if end in (0, 3)]
    return min(offers)


def applied(rows: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str]]:
    """The rows (role, text) that the edits leave, from a state of the pattern."""
    out, at = [], 0
    for letter in audit:
        if letter == KEEP:
            out.append(rows[at])
            state = KEPT[state][rows[at][0][:1]]
        elif letter != DELETE:
            out.append(("user" if PUT[state] == 2 else "assistant", rows[at][1] if letter == REROLE else ""))
            state = PUT[state]
        at += letter != INSERT
    return out


def conversation_key(conv: str) -> Column:
    """The id as text that keeps null apart from every id."""
    return F.coalesce(F.concat(F.lit("c"), F.col(conv).cast("string")), F.lit("n"))


def damaged(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
            text_col: str = "text") -> DataFrame:
    """(key, turn, role, text, rid, again) after the damage drawn for each row by its conversation and turn."""
    space = F.lit(" ")
    drawn = F.concat(F.coalesce(F.col(conv_col).cast("string"), space), F.lit(":"),
                     F.coalesce(F.col(turn_col).cast("string"), space))
    text = F.coalesce(F.col(text_col), space)
    rows = conversations.select(
        conversation_key(conv_col).alias("key"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), space).alias("role"), text.alias("text"),
        F.monotonically_increasing_id().alias("rid"), F.pmod(F.crc32(drawn.cast("binary")), F.lit(20)).alias("kind"))
    kind = F.col("kind")
    return rows.where(kind != 0).select(
        "key", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate("text", ENDS, "")).otherwise(F.col("text")).alias("text"), "rid",
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("again"))


def faults(rows: DataFrame) -> DataFrame:
    """Adds digest and the first fault of each row: blank, duplicate, truncated or null."""
    visible = F.translate("text", BLANKS, "")
    digest = F.sha2(F.concat_ws("\0", "key", F.length("role").cast("string"), "role", "text"), 256)
    rows = rows.withColumn("digest", digest)
    place = F.struct("turn", "rid", "again")
    # Only texts that repeat in their conversation can be duplicates, so the table of firsts holds no others.
    firsts = (rows.groupBy("digest").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("rows"))
              .where("rows > 1").select("digest", "first"))
    later = ~F.col("turn").eqNullSafe(F.col("first.turn")) | (F.col("rid") != F.col("first.rid")) | (
        F.col("again") != F.col("first.again"))
    fault = (F.when(visible == "", "blank").when(F.coalesce(F.col("first").isNotNull() & later, F.lit(False)), "duplicate")
             .when(~F.substring(visible, -1, 1).isin(*ENDS), "truncated"))
    return rows.join(firsts, "digest", "left").withColumn("fault", fault).drop("first")


FAULTS = ("blank", "duplicate", "truncated")
SEGMENT_FIELDS = ("key string, pid int, k long, blank long, duplicate long, truncated long, illegal long, cost long, "
                  "audit string, state string, roles array<string>, texts array<string>")
SEGMENT_TYPES = [pa.string(), pa.int32(), pa.int64(), *[pa.int64()] * 5, pa.string(), pa.string(), pa.list_(pa.string()),
                 pa.list_(pa.string())]


def _segment(key: str, pid: int, k: int, rows: list[tuple], starts: bool, ends: bool) -> list:
    """One row of segments: audit and cost of a whole conversation, else ``state``, the tables to be joined."""
    codes = [(role[:1], fault in ("blank", "duplicate"), fault == "truncated") for role, _, fault in rows]
    initials = [c[0] for c in codes]
    illegal = sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))
    cost = audit = state = None
    if starts and ends:
        cost, audit, _ = finished(transfer(codes, 0))
    else:
        best = [[p, q, c, a, [[p, len(a)]]] for p in ((0,) if starts else range(4)) for q, (c, a) in transfer(codes, p).items()]
        state = json.dumps({"best": best, "first": initials[0], "last": initials[-1], "illegal": illegal})
    return [key, pid, k, *(sum(r[2] == f for r in rows) for f in FAULTS), illegal, cost, audit, state,
            [r[0] for r in rows], [r[1] for r in rows]]


def segments(rows: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Rows in order, cut into segments; k numbers those of a partition that are no whole conversation, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SEGMENT_FIELDS.split(", ")]

        def out(row: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, SEGMENT_TYPES, strict=True)], names=names)

        key, held, size, pid, k = None, [], 0, 0, 0
        starts = False  # whether the segment surely begins its conversation: not in the first of a partition
        for b in batches:
            for own, role, text, fault, pid in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (own != key or len(held) == segment or size >= SEGMENT_CHARS):
                    yield out(_segment(key, pid, k, held, starts, own != key))
                    k += not (starts and own != key)
                    starts, held, size = own != key, [], 0
                key = own
                held.append((role, text, fault))
                size += len(text)
        if held:  # the next partition may go on with it
            yield out(_segment(key, pid, k, held, starts, False))

    order = ["key", "turn", "digest", "rid", "again"]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).select(
        "key", "role", "text", "fault", F.spark_partition_id().alias("pid"))
    return written(laid.mapInArrow(run, SEGMENT_FIELDS), "segments")


def joined(left: dict, right: dict) -> dict:
    """The table of two neighbouring segments: best audits from each state to each state, and where they divide."""
    best: dict[tuple[int, int], list] = {}
    for p, q, cost, audit, cuts in left["best"]:
        for p2, q2, cost2, audit2, cuts2 in right["best"]:
            if q == p2:
                offer = [p, q2, cost + cost2, audit + audit2, cuts + cuts2]
                if (p, q2) not in best or offer[2:4] < best[p, q2][2:4]:
                    best[p, q2] = offer
    between = left["last"] + right["first"] not in LEGAL
    return {"best": list(best.values()), "first": left["first"], "last": right["last"],
            "illegal": left["illegal"] + right["illegal"] + between}


def _joined_open(parts: DataFrame) -> DataFrame:
    """(key, state, seqs) of each divided conversation, joining FAN neighbours a step. parts: key, seq, state."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("seq")
        states = [json.loads(s) for s in group["state"]]
        now = states[0]
        for s in states[1:]:
            now = joined(now, s)
        seqs = [int(v) for vs in group["seqs"] for v in vs]
        return pd.DataFrame({"key": [group["key"].iloc[0]], "seq": [group["step"].iloc[0]], "state": [json.dumps(now)],
                             "seqs": [seqs]})

    now = parts.select("key", "seq", "state", F.array("seq").alias("seqs"))
    most = parts.agg(F.max("seq")).first()[0] or 0
    while True:
        now = now.withColumn("step", F.expr(f"seq div {FAN}")).groupBy("key", "step").applyInPandas(
            run, "key string, seq long, state string, seqs array<long>")
        most //= FAN
        if not most:
            return now
        now = written(now, "joined-segments")


def _chosen(joined_rows: DataFrame) -> DataFrame:
    """(key, cost, audit, illegal, pieces array<struct<seq, start, piece>>) of each divided conversation."""
    schema = ("key string, cost long, audit string, illegal long, "
              "pieces array<struct<seq: long, start: int, piece: string>>")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, state, seqs in zip(frame["key"], frame["state"], frame["seqs"], strict=True):
                state = json.loads(state)
                ends = {q: (cost, audit) for p, q, cost, audit, _ in state["best"] if p == 0}
                cost, audit, end = finished(ends)
                cuts = next(c for p, q, _, _, c in state["best"] if (p, q) == (0, end))
                pieces, at = [], 0
                for number, (seq, (start, size)) in enumerate(zip(seqs, cuts, strict=True)):
                    stop = len(audit) if number == len(cuts) - 1 else at + size
                    pieces.append({"seq": int(seq), "start": start, "piece": audit[at:stop]})
                    at = stop
                out.append((key, cost, audit, state["illegal"], pieces))
            yield pd.DataFrame(out, columns=["key", "cost", "audit", "illegal", "pieces"])

    return joined_rows.mapInPandas(run, schema)


REPAIRED = "key string, seq long, rows_left long, body string"


def _bodies(parts: DataFrame) -> DataFrame:
    """(key, seq, rows_left, body): ``role:text`` lines of each segment. parts: key, seq, roles, texts, audit, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left, bodies = [], []
            for roles, texts, audit, start in zip(*(b.column(c).to_pylist() for c in range(2, 6)), strict=True):
                rows = applied(list(zip(roles, texts, strict=True)), audit, start)
                left.append(len(rows))
                bodies.append("\n".join(f"{role}:{text}" for role, text in rows))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(left, pa.int64()), pa.array(bodies, pa.string())],
                                             names=["key", "seq", "rows_left", "body"])

    return parts.select("key", "seq", "roles", "texts", "audit", "start").mapInArrow(run, REPAIRED)


def _stream_hashes(bodies: DataFrame) -> DataFrame:
    """(key, sha) of divided conversations, whose segments pass in order; one hash is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(key: str, sha) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([sha.hexdigest()])], names=["key", "sha"])

        key, sha, any_left = None, None, False
        for b in batches:
            for own, left, body in zip(*(b.column(c).to_pylist() for c in (0, 2, 3)), strict=True):
                if own != key:
                    if key is not None:
                        yield out(key, sha)
                    key, sha, any_left = own, hashlib.sha256(), False
                if left:
                    sha.update((("\n" if any_left else "") + body).encode("utf-8", "surrogatepass"))
                    any_left = True
        if key is not None:
            yield out(key, sha)

    ordered = bodies.repartition("key").sortWithinPartitions("key", "seq")
    return ordered.mapInArrow(run, "key string, sha string")


@dataclass
class Repair:
    """conversations: one row per id with faults, cost, audit and hash. bodies: the repaired rows, by segment in order."""

    conversations: DataFrame
    bodies: DataFrame


def _numbered_open(parts: DataFrame) -> DataFrame:
    """seq numbers divided segments over all partitions without gaps; one count per partition reaches the driver."""
    before, starts = 0, []
    for r in parts.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).orderBy("pid").collect():
        starts.append((r.pid, before))
        before += r.n
    starts = F.broadcast(parts.sparkSession.createDataFrame(starts, "pid int, start_seq long"))
    return parts.join(starts, "pid").withColumn("seq", F.col("start_seq") + F.col("k")).drop("pid", "k", "start_seq")


def repair(conversations: DataFrame, segment: int = SEGMENT, conv_col: str = "conv_id", turn_col: str = "turn",
           role_col: str = "role", text_col: str = "text") -> Repair:
    """Damage, faults and the cheapest repair of every conversation."""
    rows = written(damaged(conversations, conv_col, turn_col, role_col, text_col), "damaged-rows")
    cut = segments(faults(rows), segment)
    whole = cut.where("audit is not null")
    open_parts = written(_numbered_open(cut.where("audit is null")), "divided-segments")
    chosen = written(_chosen(_joined_open(open_parts.select("key", "seq", "state"))), "chosen-audits")
    pieces = chosen.select(F.explode("pieces").alias("p")).select("p.seq", F.col("p.start").alias("start"), F.col("p.piece").alias("audit"))
    whole_bodies = _bodies(whole.select("key", F.lit(0).cast("long").alias("seq"), "roles", "texts", "audit", F.lit(0).alias("start")))
    open_bodies = written(_bodies(open_parts.drop("audit").join(pieces, "seq")), "divided-bodies")
    shas = whole_bodies.select("key", F.sha2("body", 256).alias("sha")).unionByName(_stream_hashes(open_bodies))
    audits = whole.select("key", "cost", "audit", "illegal").unionByName(chosen.select("key", "cost", "audit", "illegal"))
    counts = cut.groupBy("key").agg(*(F.sum(f).alias(f) for f in FAULTS))
    wide = "cast(max(turn) as decimal(38,0)) - min(turn) + 1 - count(distinct turn)"
    gaps = rows.groupBy("key").agg(F.expr(f"coalesce({wide}, 0)").alias("gaps")).withColumn("gaps", F.expr("try_cast(gaps as bigint)"))
    per_key = gaps.join(counts, "key").join(audits, "key").join(shas, "key")
    ids = conversations.select(F.col(conv_col).alias("conv_id")).distinct().withColumn("key", conversation_key("conv_id"))
    zero = {c: 0 for c in (*FAULTS, "illegal", "cost")}
    found = ids.join(per_key, "key", "left")
    out = found.select(
        "conv_id", F.when(F.col("audit").isNull(), F.lit(0)).otherwise(F.col("gaps")).cast("long").alias("gaps"),
        *(F.coalesce(c, F.lit(v)).cast("long").alias(c) for c, v in zero.items()),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
    return Repair(out, whole_bodies.unionByName(open_bodies))
