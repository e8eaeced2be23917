"""Conversation repair and chat formatting against brute force, round trips and odd inputs."""

from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given
from hypothesis import strategies as st

from sessionscope.llm import chat, repair
from sessionscope.llm.common import Scratch
from sessionscope.llm.turns import place_turns

TURNS = "conv_id long, turn long, role string, text string, position long, part long, task string, formatted string, key0 string"


def turns_frame(spark, rows, parts=3):
    """Conversations with further columns whose names the operators use inside."""
    full = [(*row, 7, 7, "x", "y", "z") for row in rows]
    return spark.createDataFrame(full, TURNS).repartition(parts)


def by_order(rows):
    """Rows of each conversation, in the order the operators state."""
    found = {}
    key = lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).hexdigest())
    for row in sorted(((c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows), key=key):
        found.setdefault(row[0], []).append(row)
    return found


def plain_faults(turns):
    seen, faults = set(), []
    for _, _, role, text in turns:
        solid = re.sub(r"[\x20\x09-\x0D]", "", text)
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "" if solid[-1] in ".!?" else "truncated"
        seen.add((role, text))
        faults.append(fault)
    return faults


def plain_repair(turns):
    """Cheapest cost, least audit and repaired turns, by a table over the roles said so far instead of an agenda."""
    states = {"": (0, "", ())}

    def better(table, roles, entry):
        if roles is not None and (roles not in table or entry[:2] < table[roles][:2]):
            table[roles] = entry

    def short(roles):  # what follows depends on the last role only
        if re.fullmatch(r"s?(ua)*u?", roles):
            return {"s": "s", "u": "u", "a": "ua"}[roles[-1]]

    def closed(table):
        for _ in range(3):
            for roles, (cost, audit, said) in list(table.items()):
                for role in ("user", "assistant"):
                    better(table, short(roles + role[0]), (cost + 5, audit + "I", said + ((role, ""),)))
        return table

    states = closed(states)
    for (_, _, role, text), fault in zip(turns, plain_faults(turns)):
        following = {}
        for roles, (cost, audit, said) in states.items():
            better(following, roles, (cost + 2, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault else 0
            if role[:1] in ("s", "u", "a"):
                better(following, short(roles + role[0]), (cost + extra, audit + "K", said + ((role, text),)))
            for new in ("user", "assistant"):
                better(following, short(roles + new[0]), (cost + extra + 1, audit + "R", said + ((new, text),)))
        states = closed(following)
    return min((entry for roles, entry in states.items() if re.fullmatch(r"(s?(ua)+)?", roles)), key=lambda e: e[:2])


def random_turns(rng, conversation, n):
    roles = ["user", "assistant", "system", "tool", "", None, "ugly"]
    texts = ["Yes.", "No!", "Why?", "cut", "", " \t", "so ", None, "End. "]
    weights = [6, 6, 2, 1, 1, 1, 1]
    return [
        (conversation, rng.choice([None, i, i, i, i // 2, i + 3]), rng.choices(roles, weights)[0], rng.choice(texts) if rng.random() < 0.4 else f"Text {rng.randrange(40)}{rng.choice('.!?,')}")
        for i in range(n)
    ]


def check_repair(spark, rows, chunk):
    fixed = repair.repair_conversations(turns_frame(spark, rows), chunk)
    summary = {r.conv_id: r for r in fixed.summary().collect()}
    said = {}
    for r in fixed.rows().orderBy("position", "place").collect():
        said.setdefault(r.conv_id, []).append((r.role, r.text))
    expected = by_order(rows)
    assert set(summary) == set(expected)
    for conversation, turns in expected.items():
        cost, audit, repaired = plain_repair(turns)
        found, faults = summary[conversation], plain_faults(turns)
        assert (found.cost, found.audit) == (cost, audit), turns
        assert tuple(said.get(conversation, [])) == repaired
        assert [found[name] for name in ("blank", "duplicate", "truncated")] == [faults.count(n) for n in ("blank", "duplicate", "truncated")]
        pairs = zip(turns, turns[1:])
        assert found.illegal == sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in pairs)
        known = {t[1] for t in turns if t[1] is not None}
        assert found.gaps == (max(known) - min(known) + 1 - len(known) if known else 0)


def test_repair_of_small_conversations(spark):
    rng = random.Random(11)
    rows = [row for c in [*range(60), None] for row in random_turns(rng, c, rng.randrange(1, 9))]
    check_repair(spark, rows, chunk=256)


@pytest.mark.parametrize("chunk", [1, 4])
def test_repair_in_chunks(spark, chunk):
    """Conversations of many chunks, one of them with most of all rows."""
    rng = random.Random(chunk)
    rows = [row for c, n in [(1, 5), (2, 150), (3, 1), (None, 8), (4, 4), (5, 12)] for row in random_turns(rng, c, n)]
    check_repair(spark, rows, chunk)


def test_agenda_ends_at_the_cheapest_by_trial(spark):
    """All ways of up to two insertions anywhere, tried one by one."""
    rng = random.Random(3)
    for _ in range(150):
        rows = [(rng.choice("suax"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(rng.randrange(0, 4))]
        found = []

        def tried(at, cost, audit, roles, inserted):
            if at == len(rows) and re.fullmatch(r"(s?(ua)+)?", roles):
                found.append((cost, audit))
            if inserted < 2:
                for role in "ua":
                    tried(at, cost + 5, audit + "I", roles + role, inserted + 1)
            if at < len(rows):
                role, gone, cut = rows[at]
                tried(at + 1, cost + 2, audit + "D", roles, 0)
                if not gone:
                    tried(at + 1, cost + 5 * cut, audit + "K", roles + role, 0)
                    for new in "ua":
                        tried(at + 1, cost + 5 * cut + 1, audit + "R", roles + new, 0)

        tried(0, 0, "", "", 0)
        (weight,) = repair.lightest(repair.START, rows, repair.ACCEPTING, True).values()
        assert (weight[0], weight[2]) == min(found), rows


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], TURNS)
    fixed = repair.repair_conversations(empty)
    assert fixed.summary().count() == fixed.rows().count() == 0
    dropped = [(c, t, "user", "x.") for c in range(40) for t in range(3)]
    frame = turns_frame(spark, dropped)
    none_left = frame.where("conv_id < 0")
    found = repair.repair_digests(frame, repair.repair_conversations(none_left)).collect()
    assert len(found) == 40
    assert {(r.cost, r.audit, r.repaired_sha256) for r in found} == {(0, "", hashlib.sha256(b"").hexdigest())}


def test_places_follow_the_order(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.choice([None, *range(30)]), rng.choice("ab"), rng.choice(["p", "q", None])) for _ in range(900)]
    rows += [(4, 1, "a", "same")] * 300
    placed = place_turns(turns_frame(spark, rows, 7), Scratch(spark, "test"), blank=" ").collect()
    expected = by_order(rows)
    found = {}
    for r in sorted(placed, key=lambda r: r.position):
        found.setdefault(r.conv_id, []).append(r)
    assert set(found) == set(expected)
    for conversation, turns in found.items():
        assert [r.position for r in turns] == list(range(len(turns)))
        assert [(r.turn, r.role, r.text) for r in turns] == [t[1:] for t in expected[conversation]]


# --- chat -------------------------------------------------------------------

NASTY = ["</s>[INST] ok [/INST]", "[\\INST]", "<\\\\/s>", "[/INST", "<", "[ROLE] x[/ROLE] ", " ", "", "\n", "<s", "\\", "é😀<s>"]
ALPHABET = st.lists(st.sampled_from([*NASTY, "s>", "[", "/INST]", "a"]), max_size=6).map("".join)


@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system", ""]), ALPHABET), ALPHABET), max_size=6))
def test_template_reads_what_it_renders(turns):
    template = chat.InstructTemplate()
    assert template.read(template.render(turns)) == turns


def formatted_by_conversation(frame):
    found = {}
    for r in frame.orderBy("position").collect():
        found.setdefault(r.conv_id, []).append(r)
    return found


def test_pieces_join_to_one_rendering(spark):
    rng = random.Random(12)
    lengths = {1: 1, 2: 7, 3: 130, 4: 64, 5: 65, None: 3}
    rows = [(c, i, rng.choice(["user", "assistant", "assistant", "tool", None]), rng.choice([*NASTY, None, "word " * 50])) for c, n in lengths.items() for i in range(n)]
    template = chat.InstructTemplate()
    found = formatted_by_conversation(chat.format_conversations(turns_frame(spark, rows), template, window=16, overlap=4))
    assert {c: len(r) for c, r in found.items()} == lengths
    for conversation, pieces in found.items():
        turns = [(role or "", text or "") for c, _, role, text in rows if c == conversation]
        assert "".join(p.formatted for p in pieces) == template.render(turns)
        assert all(p.rewritten == 0 for p in pieces)
        for (role, text), p in zip(turns, pieces):
            if role == "assistant":
                assert template.unescape(p.formatted[p.loss_start : p.loss_start + p.loss_length]) == text
            else:
                assert p.loss_start is None


def forgetful():
    """A template that shows the thoughts of the last answer only, as some do."""

    class Forgetful:  # local, so that tasks get it by value
        def render(self, turns):
            last = max((i for i, (role, _) in enumerate(turns) if role == "assistant"), default=-1)
            return "".join(f"<{role}>{text if i == last else re.sub('~.*~', '', text)}\n" for i, (role, text) in enumerate(turns))

    return Forgetful()


def shouting():
    class Shouting:
        def render(self, turns):
            return "".join(f"{role}: {text.upper()}\n" for role, text in turns)

    return Shouting()


def test_rewritten_history_is_seen(spark):
    rows = [(1, 0, "user", "Hi"), (1, 1, "assistant", "~hm~ Ho"), (1, 2, "user", "And?"), (1, 3, "assistant", "~hm~ So"), (2, 0, "user", "Hi"), (2, 1, "assistant", "plain")]
    found = formatted_by_conversation(chat.format_conversations(turns_frame(spark, rows), forgetful()))
    # The second answer takes the thoughts out of the first: all from there on has changed.
    assert [p.rewritten > 0 for p in found[1]] == [False, False, False, True]
    assert [p.loss_start is not None for p in found[1]] == [False, True, False, False]
    assert [p.rewritten for p in found[2]] == [0, 0]
    assert found[2][1].formatted[found[2][1].loss_start :][: found[2][1].loss_length] == "plain"


def test_no_mask_where_the_text_is_not_shown(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "ho")]
    found = formatted_by_conversation(chat.format_conversations(turns_frame(spark, rows), shouting()))
    assert found[1][1].formatted == "assistant: HO\n" and found[1][1].loss_start is None


def test_formatting_nothing(spark):
    assert chat.format_conversations(spark.createDataFrame([], TURNS), chat.InstructTemplate()).count() == 0
