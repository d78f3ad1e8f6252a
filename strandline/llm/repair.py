"""Conversation structure repair by a forward Viterbi search (operator 12).

A well-formed conversation has role initials ``(s?(ua)+)?``. Four grammar states say what stands so far: nothing,
a system turn, a user turn last, an assistant turn last. Turn by turn each state carries the least (cost, audit
string) that reaches it; a turn is kept, given another role or deleted, and each turn's layer is closed by at most
two inserted turns.

An audit string is carried as a rank and a link. The strings of one layer, without the inserts that close it, end
in the edit of one turn and hold equally many such edits, so none begins another; their order is all that later
comparisons need. The links are four bytes a turn, from which the cheapest string is read at the end. A running
hash goes with each state, so no text is held.

Defined cases: null roles and texts are one space; null turns come first; turns of one number are ordered by role,
then text, so ties and repeated rows rerun alike; rows without conversation id form one conversation; an empty
table gives no rows. A role's initial is its first character as it stands.

One conversation's turns go through one task, sorted on disk where memory is short: its audit string and the hash of
its whole text need them in order. The task holds one batch of turns and four bytes for each turn before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
#: From each state: role initials that may follow, and the state that each leads to.
FOLLOWS = ((("s", SYSTEM), ("u", USER)), (("u", USER),), (("a", ASSISTANT),), (("u", USER),))
ROLES = {"u": "user", "a": "assistant"}
RELABEL, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: What a link can add to the audit string: inserts that closed the layer before, then the edit of a turn.
STEPS = tuple("I" * inserts + edit for inserts in range(3) for edit in "DKR")
_CODE = {step: k for k, step in enumerate(STEPS)}


class Text:
    """A hash of turns as ``role:text`` lines."""

    def __init__(self):
        self.hash, self.lines = hashlib.sha256(), 0

    def copy(self) -> Text:
        other = Text()
        other.hash, other.lines = self.hash.copy(), self.lines
        return other

    def add(self, role: str, text: str) -> None:
        self.hash.update(f"{'\n' if self.lines else ''}{role}:{text}".encode())
        self.lines += 1


def _given_role(state: int) -> str:
    return "a" if state == USER else "u"


class Repair:
    """The search over one conversation."""

    def __init__(self):
        self.links = bytearray()
        self.texts = [Text(), None, None, None]
        # of each state: cost, rank of its string among those of the layer, inserts after it, state of that string
        self.best: list[tuple[int, int, str, int] | None] = [(0, 0, "", NOTHING), None, None, None]
        self._close()

    def _close(self) -> None:
        """Inserted turns: a user turn after anything but itself, then an assistant turn."""
        best = self.best
        for after, froms in ((USER, (NOTHING, SYSTEM, ASSISTANT)), (ASSISTANT, (USER,))):
            offers = [(best[k][0] + INSERT, best[k][1], best[k][2] + "I", best[k][3]) for k in froms if best[k]]
            best[after] = min(filter(None, (best[after], *offers)), default=None)

    def turn(self, role: str, text: str, fault: str | None) -> None:
        offers: list[list[tuple[int, int, str, int]]] = [[], [], [], []]
        for state, held in enumerate(self.best):
            if held is None:
                continue
            cost, rank, step, origin = held
            offers[state].append((cost + DELETE, rank, step + "D", origin))
            if fault in ("blank", "duplicate"):
                continue
            cost += CUT_OFF * (fault == "truncated")
            for initial, after in FOLLOWS[state]:
                if role[:1] == initial:
                    offers[after].append((cost, rank, step + "K", origin))
                if initial in ROLES:
                    offers[after].append((cost + RELABEL, rank, step + "R", origin))
        chosen = [min(o, default=None) for o in offers]
        # an assistant turn last reaches all that nothing so far does for 2 more, and all that a system turn does for none
        reached = [c[0] for c in (chosen[ASSISTANT],) if c] + [c[0] + INSERT for c in (chosen[USER],) if c]
        if reached and chosen[NOTHING] and chosen[NOTHING][0] > min(reached) + DELETE:
            chosen[NOTHING] = None
        if reached and chosen[SYSTEM] and chosen[SYSTEM][0] > min(reached):
            chosen[SYSTEM] = None
        ranks = {c[1:3]: k for k, c in enumerate(sorted(filter(None, chosen), key=lambda c: c[1:3]))}
        self.links += bytes(255 if c is None else c[3] * len(STEPS) + _CODE[c[2]] for c in chosen)
        self.texts = [c and self._extended(c[3], c[2], role, text) for c in chosen]
        self.best = [c and (c[0], ranks[c[1:3]], "", state) for state, c in enumerate(chosen)]
        self._close()

    def _extended(self, state: int, step: str, role: str = "", text: str = "") -> Text:
        out = self.texts[state].copy()
        for edit in step:
            if edit != "D":
                initial = role[:1] if edit == "K" else _given_role(state)
                out.add(role if edit == "K" else ROLES[initial], "" if edit == "I" else text)
                state = dict(FOLLOWS[state])[initial]
        return out

    def end(self) -> tuple[int, str, list[str]]:
        """Cost, hash of the repaired text, and the cheapest edits: a step for each turn and the inserts at the end."""
        cost, _, step, state = min(filter(None, (self.best[NOTHING], self.best[ASSISTANT])))
        digest = self._extended(state, step).hash.hexdigest()
        steps = [step]
        for at in range(len(self.links) - 4, -1, -4):
            state, code = divmod(self.links[at + state], len(STEPS))
            steps.append(STEPS[code])
        return cost, digest, steps[::-1]


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


class _Summary:
    """Counts of a conversation's faults, its cheapest repair and a hash of the repaired text."""

    def __init__(self, conv: object):
        self.conv, self.counts, self.repair = conv, dict.fromkeys(_COUNTS, 0), Repair()
        self.rows, self.role = 0, ""
        self.first = self.last = None
        self.distinct = 0

    def turn(self, row: tuple) -> None:
        _, _, turn, role, text, fault, gone = row
        if gone:
            return
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.distinct += turn != self.last
            self.last = turn
        if fault:
            self.counts[fault] += 1
        if self.rows:
            self.counts["illegal"] += self.role + role[:1] not in ("su", "ua", "au")
        self.role, self.rows = role[:1], self.rows + 1
        self.repair.turn(role, text, fault)

    def end(self) -> Iterator[tuple]:
        self.counts["cost"], digest, steps = self.repair.end()
        if self.first is not None:
            self.counts["gaps"] = self.last - self.first + 1 - self.distinct
        yield (self.conv, *self.counts.values(), "".join(steps), digest)


class _Edits:
    """The turns of a repaired conversation: which one stands where, and its new role if it has one."""

    def __init__(self, conv: object):
        self.conv, self.system, self.repair = conv, bytearray(), Repair()

    def turn(self, row: tuple) -> None:
        self.system.append(row[3][:1] == "s")
        self.repair.turn(*row[3:6])

    def end(self) -> Iterator[tuple]:
        state, position = NOTHING, 0
        for place, step in enumerate(self.repair.end()[2], 1):
            for edit in step:
                if edit != "D":
                    initial = "s" if edit == "K" and self.system[place - 1] else _given_role(state)
                    yield self.conv, position, None if edit == "I" else place, None if edit == "K" else ROLES[initial], edit
                    state, position = dict(FOLLOWS[state])[initial], position + 1


def _each(handler: type, kinds: dict[str, pa.DataType], size: int = 4096):
    """A function for mapInArrow on rows sorted by conversation."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        held = current = None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if held is None or row[0] != current:
                    if held is not None:
                        yield from held.end()
                    held, current = handler(row[0]), row[0]
                held.turn(row)
        if held is not None:
            yield from held.end()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = found(batches)
        while part := list(islice(rows, size)):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), kinds.values())], list(kinds))

    return run


def judged(turns: DataFrame) -> DataFrame:
    """Adds ``fault`` (blank, duplicate, truncated or null) to rows as ``_given`` deals them, and sorts them.

    ``gone`` rows count for nothing; they only keep a conversation of which no row is left.
    """
    order = ("gone", F.col("turn").asc_nulls_first(), "given", "copy")
    placed = turns.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)))
    earlier = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("place")) > 1
    fault = F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), "blank").when(earlier, "duplicate").when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), "truncated")
    return placed.withColumn("fault", fault).sortWithinPartitions("conv_id", "place").select("conv_id", "place", "turn", "role", "text", "fault", "gone")


def _given(messages: DataFrame, conv_id: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns dealt out by conversation. Turns of one number are ordered by ``given``, then ``copy``."""
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role, "role"), (text, "text"))]
    rows = messages.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), *spaced)
    parts = min(common.buckets_for(rows, common.text_bytes(rows, "role", "text")), common.MOST_TASKS)
    return rows.repartition(parts, "conv_id").withColumns({"given": F.struct("role", "text"), "copy": F.lit(0), "gone": F.lit(False)})


def _searched(turns: DataFrame, handler: type, kinds: dict[str, pa.DataType]) -> DataFrame:
    names = {pa.int64(): "long", pa.string(): "string"}
    common.bounded_batches(turns)
    return judged(turns).mapInArrow(_each(handler, kinds), ", ".join(f"{n} {names[k]}" for n, k in kinds.items()))


def _summarised(turns: DataFrame) -> DataFrame:
    return _searched(turns, _Summary, {"conv_id": pa.int64(), **dict.fromkeys(_COUNTS, pa.int64()), "audit": pa.string(), "repaired_sha256": pa.string()})


def repair_summary(messages: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each conversation: ``conv_id``, counts of faults, cost, audit string, hash of the repaired text."""
    return _summarised(_given(messages, conv_id, turn, role, text))


def repaired_turns(messages: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The repaired conversations, one row for each turn: ``conv_id, position, role, text, edit`` (K, R or I)."""
    turns = _given(messages, conv_id, turn, role, text)
    kinds = {"conv_id": pa.int64(), "position": pa.int64(), "place": pa.int64(), "new_role": pa.string(), "edit": pa.string()}
    edits, rows = _searched(turns, _Edits, kinds), judged(turns).select(F.col("conv_id").alias("c"), F.col("place").alias("p"), "role", "text")
    joined = edits.join(rows, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("place") == F.col("p")), "left")
    return joined.select("conv_id", "position", F.coalesce("new_role", "role").alias("role"), F.coalesce("text", F.lit("")).alias("text"), "edit")


def _damaged(turns: DataFrame) -> DataFrame:
    """The contract's damage, by crc32 of conversation and turn: drop, empty, unpunctuate, repeat, call it a user's."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    harm = turns.withColumn("harm", (F.crc32(F.concat_ws(":", *name).cast("binary")) % 20).cast("int"))
    harm = harm.withColumns(
        {
            "gone": F.col("harm") == 0,
            "text": F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")),
            "role": F.when(F.col("harm") == 4, "user").otherwise(F.col("role")),
            "copy": F.explode(F.when(F.col("harm") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))),
        }
    )
    return harm.drop("harm")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damages ``conversations`` as the contract says and repairs them."""
    return _summarised(_damaged(_given(common.table(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")))


def _offers(state: int) -> str:
    """SQL: the candidates of a state after a row, from states before it, as (cost, audit, repaired text)."""
    add = "CASE WHEN s{0}.r IS NULL THEN {1} ELSE s{0}.r || chr(10) || {1} END"
    given = "w.role || ':' || w.text"
    out = [f"CASE WHEN s{state} IS NOT NULL THEN {{'c': s{state}.c + 2, 'a': s{state}.a || 'D', 'r': s{state}.r}} END"]
    for before, follows in enumerate(FOLLOWS):
        for initial, after in follows:
            if after != state:
                continue
            live = f"s{before} IS NOT NULL AND w.fault NOT IN ('blank', 'duplicate')"
            late = f"s{before}.c + CASE WHEN w.fault = 'truncated' THEN 5 ELSE 0 END"
            out.append(f"CASE WHEN {live} AND w.role[1] = '{initial}' THEN {{'c': {late}, 'a': s{before}.a || 'K', 'r': {add.format(before, given)}}} END")
            if initial in ROLES:
                told = f"'{ROLES[initial]}:' || w.text"
                out.append(f"CASE WHEN {live} THEN {{'c': {late} + 1, 'a': s{before}.a || 'R', 'r': {add.format(before, told)}}} END")
    return f"list_min(list_filter([{', '.join(out)}], lambda x: x IS NOT NULL))"


def _inserted(before: str, role: str) -> str:
    return f"CASE WHEN {before} IS NOT NULL THEN {{'c': {before}.c + 5, 'a': {before}.a || 'I', 'r': CASE WHEN {before}.r IS NULL THEN '{role}:' ELSE {before}.r || chr(10) || '{role}:' END}} END"


_STATE = "STRUCT(c BIGINT, a VARCHAR, r VARCHAR)"
_FIRST = "{'c': %d::BIGINT, 'a': '%s', 'r': %s}"
OP12_SQL = rf"""
WITH RECURSIVE
code AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, x: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) ORDER BY i) AS t FROM range(256) AS b(i)),
given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role0, coalesce(text, ' ') AS text0,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) % 20 AS harm
  FROM conversations, code),
damaged AS (
  SELECT conv_id, turn, CASE WHEN harm = 4 THEN 'user' ELSE role0 END AS role,
    CASE harm WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text0, '[.!?]', '', 'g') ELSE text0 END AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role0, text0, n) AS k
  FROM given, range(2) AS copies(n) WHERE harm <> 0 AND (n = 0 OR harm = 3)),
w AS (
  SELECT *, coalesce((lag(role) OVER (PARTITION BY conv_id ORDER BY k))[1] || role[1] NOT IN ('su', 'ua', 'au'), false) AS clash,
    CASE WHEN NOT regexp_matches(text, '[^ 	-
]') THEN 'blank'
      WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][ 	-
]*\z') THEN 'truncated' ELSE '' END AS fault
  FROM damaged),
path AS (
  SELECT conv_id, 0::BIGINT AS k, {_FIRST % (0, "", "NULL::VARCHAR")}::{_STATE} AS s0, NULL::{_STATE} AS s1,
    {_FIRST % (5, "I", "'user:'")}::{_STATE} AS s2, {_FIRST % (10, "II", "'user:' || chr(10) || 'assistant:'")}::{_STATE} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, k, s0, s1, s2, list_min(list_filter([s3, {_inserted("s2", "assistant")}], lambda x: x IS NOT NULL)) AS s3 FROM (
    SELECT conv_id, k, s0, s1, list_min(list_filter([s2, {_inserted("s0", "user")}, {_inserted("s1", "user")}, {_inserted("s3", "user")}], lambda x: x IS NOT NULL)) AS s2, s3 FROM (
      SELECT w.conv_id, w.k, {_offers(0)} AS s0, {_offers(1)} AS s1, {_offers(2)} AS s2, {_offers(3)} AS s3
      FROM path JOIN w ON w.conv_id IS NOT DISTINCT FROM path.conv_id AND w.k = path.k + 1))),
best AS (SELECT conv_id, list_min([s0, s3]) AS s FROM path QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1)
SELECT b.conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
  count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate, count(*) FILTER (WHERE fault = 'truncated') AS truncated,
  count(*) FILTER (WHERE clash) AS illegal, any_value(s.c) AS cost, any_value(s.a) AS audit, sha256(coalesce(any_value(s.r), '')) AS repaired_sha256
FROM best b LEFT JOIN w ON w.conv_id IS NOT DISTINCT FROM b.conv_id GROUP BY b.conv_id"""
