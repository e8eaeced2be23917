"""Conversation repair as lightest derivations of a weighted hypergraph, by Knuth's agenda.

The roles of a repaired conversation read ``(s?(ua)+)?``, by their initials.  Items are
``(from state, rows consumed, state)``; an item and an edit of the next row (keep, change the
role, delete), or an item and an insertion, derive the next item.  A weight is (cost, rows,
audit): costs and rows add up and audits join, so a conclusion is never lighter than a
premise, and the lightest weight on the agenda is final.  Rows are equal for all derivations of an item,
so among these the cheapest counts and then the audit that is least in ASCII.

Long conversations are cut into chunks.  A chunk derives its items from every state; the
chunks are premises of the same kind of deduction along the conversation.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import partial
from itertools import groupby

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.common import Scratch
from sessionscope.llm.turns import fold_conversations, place_turns

# The grammar of role initials and the costs of edits.
START = 0
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
ACCEPTING = (0, 3)
CHANGE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
LEGAL_PAIRS = ("su", "ua", "au")
FULL_ROLE = {"u": "user", "a": "assistant"}

BLANKS = " \t\n\x0b\x0c\r"
NO_SIGN = "\x00"  # stands for the initial of an empty role

Weight = tuple[int, int, str]
Row = tuple[str, bool, bool]  # role initial, must go, truncated


def edits(row: Row) -> list[tuple[Weight, str]]:
    """What may become of a row: the weight of the edit, and the initials it can leave ("" for none)."""
    initial, must_go, truncated = row
    found = [((DELETE, 1, "D"), "")]
    if not must_go:
        extra = TRUNCATED if truncated else 0
        found.append(((extra, 1, "K"), initial))
        found += [((extra + CHANGE, 1, "R"), role) for role in FULL_ROLE]
    return found


def joined(first: Weight, second: Weight) -> Weight:
    return first[0] + second[0], first[1] + second[1], first[2] + second[2]


def lightest(start: int, rows: list[Row], goals: Iterable[int] | None, lead: bool) -> dict[int, Weight]:
    """Lightest weights by which all ``rows`` lead from a state to others.

    With ``goals`` the search ends at the first state of these that becomes final, and only that one is returned.
    ``lead`` allows insertions before the first row.
    """
    options = [edits(row) for row in rows]
    insertions = [((INSERT, 0, "I"), role, 0) for role in FULL_ROLE]
    agenda: list[tuple[Weight, int, int]] = [((0, 0, ""), 0, start)]
    final: set[tuple[int, int]] = set()
    ends: dict[int, Weight] = {}
    while agenda:
        weight, at, state = heapq.heappop(agenda)
        if (at, state) in final:
            continue
        final.add((at, state))
        if at == len(rows):
            if goals is None:
                ends[state] = weight
            elif state in goals:
                return {state: weight}
        steps = insertions if lead or at else []
        if at < len(rows):
            steps = steps + [(edit, role, 1) for edit, role in options[at]]
        for edit, role, further in steps:
            conclusion = at + further, NEXT[state].get(role) if role else state
            if conclusion[1] is not None and conclusion not in final:
                heapq.heappush(agenda, (joined(weight, edit), *conclusion))
    return ends


def combined(before: dict[int, tuple], spans: dict[int, dict[int, Weight]]) -> dict[int, tuple]:
    """One more chunk: the lightest (cost, path) to each state; a path links (earlier path, start state, audit)."""
    found: dict[int, tuple] = {}
    for start, (cost, path) in before.items():
        for state, (extra, _, audit) in spans.get(start, {}).items():
            candidate = (cost + extra, (path, start, audit))
            if state not in found or _lighter(candidate, found[state]):
                found[state] = candidate
    return found


def _lighter(one: tuple, other: tuple) -> bool:
    """Compares costs, then audits from the place on where the two paths parted."""
    if one[0] != other[0]:
        return one[0] < other[0]
    left, right, tails = one[1], other[1], ([], [])
    while left is not right:
        tails[0].append(left[2])
        tails[1].append(right[2])
        left, right = left[0], right[0]
    return "".join(reversed(tails[0])) < "".join(reversed(tails[1]))


def unrolled(path: tuple | None) -> list[tuple[int, str]]:
    found = []
    while path is not None:
        path, start, audit = path
        found.append((start, audit))
    return found[::-1]


def applied(state: int, audit: str, initials: str) -> Iterator[tuple[int, str, str | None]]:
    """Row number, edit and new role of every edit in turn; an insertion has the number of the row before it."""
    at = 0
    for edit in audit:
        role = None
        if edit == "K":
            state = NEXT[state][initials[at]]
        elif edit in "RI":
            initial = next(x for x in NEXT[state] if x in FULL_ROLE)
            state, role = NEXT[state][initial], FULL_ROLE[initial]
        yield at - (edit == "I"), edit, role
        at += edit != "I"


def mark_faults(placed: DataFrame) -> DataFrame:
    """``placed`` turns with their first fault: blank, duplicate (role and text seen before), truncated, or null."""
    said = F.sha2(F.concat_ws("\x00", F.length("role").cast("string"), "role", "text"), 256)
    solid = F.rtrim("text", F.lit(BLANKS))
    rows = placed.select(
        "conv_id",
        "position",
        "turn",
        "role",
        said.alias("said"),
        (solid == "").alias("blank"),
        (~F.substring(solid, -1, 1).isin(".", "!", "?")).alias("truncated"),
    )
    known = rows.where(~F.col("blank"))
    firsts = known.groupBy("conv_id", "said").agg(F.min("position").alias("first"), F.count("*").alias("n"))
    repeated = firsts.where(F.col("n") > 1).select(F.col("conv_id").alias("of"), F.col("said").alias("said_"), "first")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("said") == F.col("said_"))
    fault = (
        F.when(F.col("blank"), "blank")
        .when(F.col("position") > F.col("first"), "duplicate")
        .when(F.col("truncated"), "truncated")
    )
    return rows.join(repeated, same, "left").select("conv_id", "position", "turn", "role", fault.alias("fault"))


SPANS = "array<struct<start:int,state:int,cost:bigint,audit:string>>"
COUNTS = ("blank", "duplicate", "truncated", "illegal")
CHUNKS = (
    "part long, initials string, n long, blank long, duplicate long, truncated long, illegal long, "
    f"first_turn long, last_turn long, turns long, spans {SPANS}"
)


def _chunked(size: int, conversation, rows: Iterator[dict]) -> Iterator[dict]:
    """Faults and spans of the chunks of a conversation that came to this task."""
    for part, turns in groupby(rows, key=lambda row: row["part"]):
        yield _derived(size, conversation, part, list(turns))


def _derived(size: int, conversation, part: int, rows: list[dict]) -> dict:
    initials = [row["role"][:1] for row in rows]
    items = [(initial or NO_SIGN, row["fault"] in ("blank", "duplicate"), row["fault"] == "truncated") for initial, row in zip(initials, rows)]
    if part == 0 and len(rows) < size:  # a whole conversation
        spans = {START: lightest(START, items, ACCEPTING, True)}
    else:  # what could be inserted before a later chunk is inserted after the earlier one
        spans = {start: lightest(start, items, None, part == 0) for start in ([START] if part == 0 else NEXT)}
    turns = [row["turn"] for row in rows if row["turn"] is not None]
    return {
        "conv_id": conversation,
        "part": part,
        "initials": "".join(x or NO_SIGN for x in initials),
        "n": len(rows),
        **{name: sum(row["fault"] == name for row in rows) for name in COUNTS[:3]},
        "illegal": sum(a + b not in LEGAL_PAIRS for a, b in zip(initials, initials[1:])),
        "first_turn": turns[0] if turns else None,
        "last_turn": turns[-1] if turns else None,
        "turns": len(set(turns)),
        "spans": [
            {"start": start, "state": state, "cost": cost, "audit": audit}
            for start, ends in spans.items()
            for state, (cost, _, audit) in ends.items()
        ],
    }


PLANS = "part long, start int, audit string, initials string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long"


def _along(conversation, chunks: Iterator[dict]) -> Iterator[dict]:
    """Joins the chunks of a conversation: each one's part of the audit, and the totals beside the first."""
    reached: dict[int, tuple] = {START: (0, None)}
    totals = dict.fromkeys(COUNTS, 0)
    first_turn = last_turn = last_initial = None
    turns, initials = 0, []
    for chunk in chunks:
        spans: dict[int, dict[int, Weight]] = {}
        for span in chunk["spans"]:
            spans.setdefault(span["start"], {})[span["state"]] = (span["cost"], chunk["n"], span["audit"])
        reached = combined(reached, spans)
        for name in COUNTS:
            totals[name] += chunk[name]
        own = chunk["initials"]
        if last_initial is not None:
            totals["illegal"] += (last_initial + own[0]) not in LEGAL_PAIRS
        last_initial = own[-1]
        turns += chunk["turns"] - (last_turn is not None and last_turn == chunk["first_turn"])
        first_turn = chunk["first_turn"] if first_turn is None else first_turn
        last_turn = chunk["last_turn"] if chunk["last_turn"] is not None else last_turn
        initials.append(own)
    state = None
    for goal in ACCEPTING:
        if goal in reached and (state is None or _lighter(reached[goal], reached[state])):
            state = goal
    gaps = 0 if first_turn is None else last_turn - first_turn + 1 - turns
    totals |= {"gaps": gaps, "cost": reached[state][0]}
    for part, (start, audit) in enumerate(unrolled(reached[state][1])):
        yield {"conv_id": conversation, "part": part, "start": start, "audit": audit, "initials": initials[part], **(totals if part == 0 else {})}


class Repair:
    """Placed turns and the plan of their repair, both written; ``summary`` and ``rows`` read them."""

    def __init__(self, placed: DataFrame, plans: DataFrame, chunk: int):
        self.placed, self.plans, self.chunk = placed, plans, chunk

    def summary(self) -> DataFrame:
        """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit``, a row per conversation."""
        kind = dict(self.plans.dtypes)["conv_id"]
        totals = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
        return fold_conversations(self.plans.drop("initials"), ["part"], _summed, f"conv_id {kind}, {totals}, audit string")

    def rows(self) -> DataFrame:
        """The repaired turns: ``conv_id, position, place, edit, role, text``, in the order of (position, place).

        ``position`` is that of the turn before repair and ``place`` is 0; what is inserted has the position of the turn
        before it (-1 at the start) and places from 1.
        """
        kind = dict(self.plans.dtypes)["conv_id"]
        planned = self.plans.select("conv_id", "part", "start", "audit", "initials").mapInArrow(partial(_explode, self.chunk), f"conv_id {kind}, position long, place int, edit string, new_role string")
        kept, inserted = planned.where("edit <> 'I'"), planned.where("edit = 'I'")
        turn = self.placed.select(F.col("conv_id").alias("of"), F.col("position").alias("at"), "role", "text")
        same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("position") == F.col("at"))
        # Plans are stored small and grow when read, so their stored size must not decide for a broadcast.
        texts = kept.where("edit <> 'D'").hint("merge").join(turn, same).select(
            "conv_id", "position", "place", "edit", F.coalesce("new_role", "role").alias("role"), "text"
        )
        return texts.unionByName(inserted.select("conv_id", "position", "place", "edit", F.col("new_role").alias("role"), F.lit("").alias("text")))


def _explode(size: int, batches):
    import pyarrow as pa

    kinds = {"position": pa.int64(), "place": pa.int32(), "edit": pa.string(), "new_role": pa.string()}
    for batch in batches:
        for start in range(0, batch.num_rows, 64):  # few chunks at a time, each of bounded length
            chunks = batch.slice(start, 64)
            owner, out, place = [], {name: [] for name in kinds}, 0
            for row, chunk in enumerate(chunks.drop_columns(["conv_id"]).to_pylist()):
                before = len(out["edit"])
                for at, edit, role in applied(chunk["start"], chunk["audit"], chunk["initials"]):
                    place = place + 1 if edit == "I" else 0
                    for name, value in zip(kinds, (chunk["part"] * size + at, place, edit, role)):
                        out[name].append(value)
                owner += [row] * (len(out["edit"]) - before)
            conv = chunks.column("conv_id").take(pa.array(owner, pa.int64()))
            columns = [pa.array(out[name], kind) for name, kind in kinds.items()]
            yield pa.RecordBatch.from_arrays([conv, *columns], names=["conv_id", *kinds])


def _summed(conversation, plans: Iterator[dict]) -> Iterator[dict]:
    first = next(plans)
    audit = first["audit"] + "".join(plan["audit"] for plan in plans)
    yield {"conv_id": conversation, **{name: first[name] for name in (*COUNTS, "gaps", "cost")}, "audit": audit}


def repair_conversations(conversations: DataFrame, chunk: int = 256) -> Repair:
    """The cheapest edits by which every conversation's roles follow the grammar.

    Blank turns (no sign but space) and duplicates (role and text seen earlier) must be deleted; turns that do not end
    in ``.``, ``!`` or ``?`` cost extra unless deleted.  Turns are ordered by ``turn``, null first, ties by role and digest
    of the text.  Null roles and texts are one space.  Rows without ``conv_id`` are one conversation.  An
    empty table has no plans; further columns are ignored.
    """
    scratch = Scratch(conversations.sparkSession, "repair")
    placed = scratch.write(place_turns(conversations, scratch, blank=" "), "placed")
    marked = mark_faults(placed).withColumn("part", F.floor(F.col("position") / chunk))
    kind = dict(placed.dtypes)["conv_id"]
    chunks = fold_conversations(marked, ["part", "position"], partial(_chunked, chunk), f"conv_id {kind}, {CHUNKS}", by=("conv_id", "part"))
    plans = fold_conversations(chunks, ["part"], _along, f"conv_id {kind}, {PLANS}")
    return Repair(placed, scratch.write(plans, "plans"), chunk)


# --- the registered query -------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns damaged by the checksum of ``conv_id:turn``: one in twenty each is dropped, emptied, robbed of its
    full stops, repeated, or said by the user.  Nulls are one space."""
    name = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    kind = F.crc32(F.concat(name[0], F.lit(":"), name[1]).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return (
        conversations.where(kind != 0)
        .withColumn("copies", F.explode(F.array_repeat(F.lit(1), F.when(kind == 3, 2).otherwise(1))))
        .select(
            "conv_id",
            "turn",
            F.when(kind == 4, "user").otherwise(role).alias("role"),
            F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        )
    )


def _hashed(conversation, rows: Iterator[dict]) -> Iterator[dict]:
    digest, first = hashlib.sha256(), True
    for row in rows:
        digest.update((("" if first else "\n") + f"{row['role']}:{row['text']}").encode())
        first = False
    yield {"conv_id": conversation, "repaired_sha256": digest.hexdigest()}


def repair_digests(conversations: DataFrame, repair: Repair) -> DataFrame:
    """Counts, audit and checksum of the repaired turns, for every ``conv_id`` of ``conversations``.

    A checksum of a whole conversation has to see it in order, so a conversation passes through one task, as a stream.
    """
    ids = conversations.select("conv_id").distinct()
    kind = dict(ids.dtypes)["conv_id"]
    hashed = fold_conversations(repair.rows(), ["position", "place"], _hashed, f"conv_id {kind}, repaired_sha256 string")
    found = ids
    for frame, key in ((repair.summary(), "of_summary"), (hashed, "of_hash")):
        named = frame.withColumnRenamed("conv_id", key)
        found = found.join(named, F.col("conv_id").eqNullSafe(F.col(key)), "left")
    counts = [F.coalesce(name, F.lit(0)).cast("long").alias(name) for name in ("gaps", *COUNTS, "cost")]
    nothing = hashlib.sha256().hexdigest()
    return found.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")
    )


def _plus(weight: str, cost: str, edit: str) -> str:
    """A weight as text, eight digits of cost before the audit, with one more edit."""
    return f"(lpad(CAST(CAST(left({weight}, 8) AS INTEGER) + {cost} AS VARCHAR), 8, '0') || substr({weight}, 9) || '{edit}')"


def _inserted(source: str) -> str:
    """States after one more possible insertion, as a query over states."""
    two = ", ".join(_plus(w, str(INSERT), "I") for w in ("w0", "w1", "w3"))
    return f"SELECT conv_id, i, w0, w1, least(w2, {two}) AS w2, least(w3, {_plus('w2', str(INSERT), 'I')}) AS w3 FROM ({source})"


def _all_inserted(source: str) -> str:
    return _inserted(_inserted(_inserted(source)))


def _sql() -> str:
    """Weights of the four states, turn by turn: a table of costs instead of an agenda."""
    late = "CASE WHEN truncated THEN 5 ELSE 0 END"

    def kept(weight: str, initial: str) -> str:
        return f"CASE WHEN NOT gone AND initial = '{initial}' THEN {_plus(weight, late, 'K')} END"

    def changed(weight: str) -> str:
        return f"CASE WHEN NOT gone THEN {_plus(weight, late + ' + 1', 'R')} END"

    def deleted(weight: str) -> str:
        return _plus(weight, "2", "D")

    to_user = ", ".join(f"{kept(w, 'u')}, {changed(w)}" for w in ("w0", "w1", "w3"))
    step = f"""
    SELECT s.conv_id, s.i + 1 AS i, {deleted('w0')} AS w0, least({deleted('w1')}, {kept('w0', 's')}) AS w1,
           least({deleted('w2')}, {to_user}) AS w2, least({deleted('w3')}, {kept('w2', 'a')}, {changed('w2')}) AS w3
    FROM states s JOIN faults f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.i = s.i + 1"""
    start = "SELECT conv_id, CAST(0 AS BIGINT) AS i, '00000000' AS w0, CAST(NULL AS VARCHAR) AS w1, CAST(NULL AS VARCHAR) AS w2, CAST(NULL AS VARCHAR) AS w3 FROM ids"
    return f"""
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id FROM conversations),
named AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name
  FROM conversations
),
numbered AS (
  SELECT *, xor(list_reduce(
    list_prepend(CAST(4294967295 AS BIGINT), flatten(list_transform(range(1, length(name) + 1),
      lambda p: list_transform(range(8), lambda b: CAST((ascii(name[p]) >> CAST(b AS INTEGER)) & 1 AS BIGINT))))),
    lambda c, b: xor(c >> 1, CAST(3988292384 AS BIGINT) * (xor(c, b) & 1))), CAST(4294967295 AS BIGINT)) % 20 AS kind
  FROM named
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM numbered, range(2) AS copies(c) WHERE kind <> 0 AND (c = 0 OR kind = 3)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS i,
         rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS solid
  FROM damaged
),
judged AS (
  SELECT conv_id, i, turn, role, text, left(role, 1) AS initial, solid = '' AS blank, solid <> '' AND seen > 1 AS duplicate,
         solid <> '' AND seen = 1 AND right(solid, 1) NOT IN ('.', '!', '?') AS truncated
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed)
),
faults AS (
  SELECT *, blank OR duplicate AS gone,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS illegal
  FROM judged
),
counts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
         count(*) FILTER (truncated) AS truncated, count(*) FILTER (illegal) AS illegal
  FROM faults GROUP BY conv_id
),
states AS (
  SELECT * FROM ({_all_inserted(start)})
  UNION ALL
  SELECT * FROM ({_all_inserted(step)})
),
solved AS (
  SELECT c.*, least(w0, w3) AS weight FROM counts c
  JOIN states s ON s.conv_id IS NOT DISTINCT FROM c.conv_id AND s.i = c.n
),
signs AS (
  SELECT conv_id, substr(weight, 9) AS audit, unnest(range(1, length(weight) - 7)) AS p FROM solved
),
edited AS (
  SELECT conv_id, p, audit[p] AS edit, length(replace(left(audit, p), 'I', '')) AS i FROM signs
),
said AS (
  SELECT e.conv_id, e.p, e.edit, f.role, f.initial, CASE WHEN e.edit = 'I' THEN '' ELSE f.text END AS text,
         row_number() OVER (PARTITION BY e.conv_id ORDER BY e.p) AS m
  FROM edited e LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM e.conv_id AND f.i = e.i
  WHERE e.edit <> 'D'
),
openings AS (SELECT conv_id, CAST(edit = 'K' AND initial = 's' AS INTEGER) AS system FROM said WHERE m = 1),
repaired AS (
  SELECT s.conv_id, sha256(string_agg(
    CASE WHEN edit = 'K' THEN s.role WHEN (m - system) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || s.text, chr(10) ORDER BY p)) AS digest
  FROM said s JOIN openings o ON o.conv_id IS NOT DISTINCT FROM s.conv_id GROUP BY s.conv_id
)
SELECT i.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(left(weight, 8) AS BIGINT), 0) AS cost, coalesce(substr(weight, 9), '') AS audit,
       coalesce(digest, sha256('')) AS repaired_sha256
FROM ids i LEFT JOIN solved s ON s.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN repaired r ON r.conv_id IS NOT DISTINCT FROM i.conv_id
"""


SQL = _sql()
