"""Conversation repair against an enumeration of all edits."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from loanlens.llm import dialogue, queries

CONVERSATION = "conv_id long, turn long, role string, text string, fault string, key string, pos long"
GOOD = re.compile(r"(s?(ua)+)?")


def conversations(spark, rows):
    """Rows with extra columns whose names clash."""
    return spark.createDataFrame([(*r, "x", "y", 7) for r in rows], CONVERSATION)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(":".join(" " if x is None else str(x) for x in (conv, turn)).encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        out += [(conv, turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return out


def plain_faults(rows):
    """(role, text, fault) of one conversation's ordered rows."""
    seen, out = set(), []
    for role, text in rows:
        solid = [c for c in text if c not in " \t\n\x0b\x0c\r"]
        fault = "blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def cheapest(rows, insert=5):
    """The least (cost, audit) and its repaired rows, by trying all edits with up to two inserts in a gap."""
    gaps = ["", "u", "a", "ua", "au"]  # no other can give alternating roles
    choices = [gaps]
    for role, _, fault in rows:
        own = ["D"] if fault in ("blank", "duplicate") else ["D", "K", "Ru", "Ra"]
        choices += [own, gaps]
    best = None
    for pick in product(*choices):
        cost, audit, out = 0, "", []
        for k, p in enumerate(pick):
            if k % 2 == 0:
                cost, audit = cost + insert * len(p), audit + "I" * len(p)
                out += [(dialogue.ROLES[c], "") for c in p]
                continue
            role, text, fault = rows[k // 2]
            cost += {"D": 2, "K": 0, "R": 1}[p[0]] + (5 if fault == "truncated" and p != "D" else 0)
            audit += p[0]
            if p != "D":
                out.append((role if p == "K" else dialogue.ROLES[p[1]], text))
        if GOOD.fullmatch("".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, out)
    return best


def plain_report(conv, rows):
    """rows: (turn, role, text), ordered."""
    told = plain_faults([r[1:] for r in rows])
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    cost, audit, out = cheapest(told)
    return (
        conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *[sum(f == name for _, _, f in told) for name in ("blank", "duplicate", "truncated")],
        sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
        hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest(),
    )


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, role, text))
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    return {conv: sorted(own, key=key) for conv, own in out.items()}


def some_conversations(n, rows, seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "What?", "", " \n", "Fine!  ", "so.so", "é…"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", ""]
    return [(c, t, rng.choice(roles), rng.choice(texts)) for c in range(n) for t in range(rng.randint(1, rows))]


def reported(spark, rows, original=None):
    given = None if original is None else conversations(spark, original)
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return {r[0]: tuple(r) for r in dialogue.repair_report(conversations(spark, rows), given).select(*names).collect()}


def test_all_edits_tried(spark):
    rows = some_conversations(60, 3, 1)
    got = reported(spark, rows)
    assert got == {conv: plain_report(conv, own) for conv, own in by_conversation(rows).items()}


@pytest.mark.parametrize("costs", [{}, {"insert": 1}, {"insert": 2, "delete": 3}, {"insert": 0, "rerole": 0}, {"delete": 9, "truncated": 1}])
def test_segments_join_to_the_whole(costs):
    """Any cut of the rows gives the path of the whole, also where inserts are cheap."""
    costs = dialogue.COSTS | costs
    rng = random.Random(7)
    for _ in range(60):
        kinds = [(rng.choice("suax"), rng.choice(["", "", "t", "b", "d"])) for _ in range(rng.randint(1, 12))]
        whole = dialogue.best(*dialogue.row_paths(kinds, costs), costs)
        cuts = sorted(rng.sample(range(1, len(kinds)), min(len(kinds) - 1, rng.randint(0, 4))))
        parts = [dialogue.narrowed(*dialogue.row_paths(kinds[a:b], costs)) for a, b in zip([0, *cuts], [*cuts, len(kinds)], strict=True)]
        while len(parts) > 1:
            k = rng.randrange(len(parts) - 1)
            parts[k : k + 2] = [dialogue.joined(parts[k], parts[k + 1])]
        assert dialogue.best(*parts[0], costs) == whole


def test_cheap_inserts_against_all_edits():
    costs = dialogue.COSTS | {"insert": 1}
    rng = random.Random(3)
    fault = {"": "", "t": "truncated", "b": "blank", "d": "duplicate"}
    for _ in range(40):
        kinds = [(rng.choice("suax"), rng.choice(["", "", "t", "b", "d"])) for _ in range(rng.randint(1, 2))]
        want = cheapest([(i, "", fault[f]) for i, f in kinds], insert=1)
        assert dialogue.best(*dialogue.row_paths(kinds, costs), costs) == want[:2]


def test_query_on_the_table(spark, sf_dir):
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    after = by_conversation(plain_damage(given))
    got = {r[0]: tuple(r) for r in queries.QUERIES["op13_dialogue"](spark, sf_dir).collect()}
    assert set(got) == {r[0] for r in given}
    nothing = hashlib.sha256(b"").hexdigest()
    for conv, row in got.items():
        own = after.get(conv, [])
        if not own:
            assert row == (conv, 0, 0, 0, 0, 0, 0, "", nothing)
        elif len(own) <= 2:
            assert row == plain_report(conv, own)
        else:  # too many rows to try all: numbers, and that the audit is what it says
            told = plain_faults([r[1:] for r in own])
            assert row[2:5] == tuple(sum(f == name for _, _, f in told) for name in ("blank", "duplicate", "truncated"))
            assert row[6] == sum({"D": 2, "K": 0, "R": 1}[e] + 5 * (e != "D" and f == "truncated") for e, (_, _, f) in zip(row[7], told, strict=True))


def test_long_conversation_over_many_ranges(spark):
    """One conversation with most rows: parts in many tasks, one path; equal rows are told apart."""
    rng = random.Random(5)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"{rng.randint(0, 900)}" + rng.choice([".", "!", ""])) for t in range(600)]
    rows += [(1, None, "user", "again.")] * 200 + [(c, 0, "user", "x") for c in range(2, 300)]
    got = reported(spark, rows)
    own = by_conversation(rows)[1]
    told = plain_faults([r[1:] for r in own])
    kinds = [(r[:1], {"blank": "b", "duplicate": "d", "truncated": "t", "": ""}[f]) for r, _, f in told]
    cost, audit = dialogue.best(*dialogue.row_paths(kinds))
    assert got[1][1:8] == (0, 0, sum(f == "d" for _, f in kinds), sum(f == "t" for _, f in kinds),
                           sum(a[0] + b[0] not in dialogue.FOLLOWS for a, b in zip(kinds, kinds[1:], strict=False)), cost, audit)
    assert got[2][7] == "D" and len(got) == 299


def test_repaired_rows(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "user", "Well?"), (1, 3, "assistant", "Yes."),
            (1, 4, "assistant", "Yes."), (1, 5, "user", "cut"), (2, 0, "tool", "Odd."), (2, 1, "bot", "Odder.")]
    ordered = dialogue.ordered(conversations(spark, rows))
    found = dialogue.verdicts(ordered)
    got = sorted((r.key, r.place, r.edit, r.role, r.text) for r in dialogue.repaired(ordered, found).collect())
    assert [g[1:] for g in got if g[0] == "1"] == [
        (0, "K", "system", "Be kind."), (1, "K", "user", "Well?"), (2, "K", "assistant", "Yes.")]
    assert [g[1:] for g in got if g[0] == "2"] == [(0, "R", "user", "Odd."), (1, "R", "assistant", "Odder.")]


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "A."), (2**60 + 1, 2**60 + 3, "user", "Big."), (2**60 + 1, 2**60, "assistant", "Bigger."),
            (3, 0, "user", "w" * 100_000 + "."), (3, 0, "user", "w" * 100_000 + "."), (4, -5, "", ""), (5, 1, "üser", " .")]
    got = reported(spark, rows, [*rows, (9, 1, "user", "dropped")])
    want = {conv: plain_report(conv, own) for conv, own in by_conversation([(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in rows]).items()}
    want[9] = (9, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == want
    assert reported(spark, []) == {}
