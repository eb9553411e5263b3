"""Repair of conversation structure by cheapest edits.

A repaired conversation's roles read `(s?(ua)+)?`.  Every row is kept, given another role or deleted,
and empty rows may be inserted.  A path of edits weighs one integer: its high digits are the cost, its
low digits spell the edits' letters, the first letter highest, with zeros after the last.  So the least
integer is the cheapest path and, among equally cheap ones, the one whose letters come first.  The
shortest path through the graph of (row, letters so far, state of the pattern) decides everything.

Rows are ordered by ranges, so that a long conversation spans tasks.  Segments of it are solved between
all states by themselves; two neighbours' integers add up to those of both.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanlens.llm.common import partitions, stage

SPACE = " \t\n\x0b\x0c\r"
SEGMENT = 128  # rows that are solved in one go
DIGIT = 3  # bits of a letter; 0 stands after the last one
LETTERS = ["", "D", "I", "K", "R"]  # in the order of their codes
DELETE, INSERT, KEEP, CHANGE = 1, 2, 3, 4
STEP = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}  # states: nothing, s, u, ua
ENDS = (0, 3)
FOLLOWS = ("su", "ua", "au")
COSTS = {"keep": 0, "rerole": 1, "delete": 2, "insert": 5, "truncated": 5}
ROLES = {"u": "user", "a": "assistant"}

Paths = dict[tuple[int, int, int], int]  # from state, to state, letters: the least integer


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of the rows that a fixed hash of `conv_id:turn` damages; nulls are one space."""
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    harm = F.crc32(F.concat(null("conv_id"), F.lit(":"), null("turn"))) % 20
    text, role = null("text"), null("role")
    return conversations.where(harm != 0).select(
        "conv_id", "turn",
        F.when(harm == 4, "user").otherwise(role).alias("role"),
        F.when(harm == 1, "").when(harm == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        F.explode(F.when(harm == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def ordered(conversations: DataFrame) -> DataFrame:
    """key (conv_id as text), pos, turn, role, text and faults of each row, staged; pos counts up in order.

    Rows of one conversation go by turn, nulls first; those of one turn by role, then by the text's first
    64 characters, then by its SHA-256.  Ranges end anywhere, also between equal rows.
    """
    null = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("string").alias("key"), F.col("turn").cast("long").alias("turn"),
                                null("role").alias("role"), null("text").alias("text"))
    # the length of the role keeps role and text apart
    same = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256))
    last = F.rtrim("text", F.lit(SPACE))
    fault = F.when(last == "", "b").when(~F.right(last, F.lit(1)).isin(".", "!", "?"), "t").otherwise("")
    rows = rows.withColumns({"initial": F.substring("role", 1, 1), "same": same, "fault": fault,
                             "head": F.substring("text", 1, 64), "nth": F.monotonically_increasing_id()})
    order = ["key", "turn", "role", "head", "same", "nth"]
    rows = rows.repartitionByRange(partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    return stage(rows.select(F.monotonically_increasing_id().alias("pos"), "key", "turn", "role", "text", "initial", "fault", "same"))


def verdicts(rows: DataFrame) -> DataFrame:
    """key, gaps, blank, duplicate, truncated, illegal, cost, audit of the conversations in `ordered` rows."""
    narrow = rows.select("pos", "key", "turn", "initial", "fault", "same")
    firsts = narrow.groupBy("key", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when((F.col("fault") != "b") & F.col("first").isNull(), "d").otherwise(F.col("fault"))
    flagged = narrow.join(firsts, "pos", "left").select("pos", "key", F.col("turn").cast("string").alias("turn"), "initial", fault.alias("fault"))
    flagged = flagged.repartitionByRange(partitions(rows.sparkSession), "pos").sortWithinPartitions("pos")
    parts = flagged.mapInPandas(_segments, "key string, pos long, part string")
    dealt = parts.repartition("key").sortWithinPartitions("key", "pos")
    return stage(dealt.mapInPandas(
        _judge, "key string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """key, place, edit, role, text: the rows after repair, each conversation's together and in order.

    Deleted rows are left out; inserted ones have an empty text.  Rows pass by one at a time, so a
    conversation needs no more memory than its letters.
    """
    return _with_audit(rows, found).mapInPandas(_repair, "key string, place long, edit string, role string, text string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """key, repaired_sha256: the hash of the repaired rows' `role:text`, joined by line ends."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = (), None
        for b in _repair(batches, ends=True):
            out = []
            for k, place, role, text in zip(b["key"], b["place"], b["role"], b["text"], strict=True):
                if (k,) != key:
                    key, state = (k,), hashlib.sha256()
                if place < 0:
                    out.append((k, state.hexdigest()))
                else:
                    state.update(("\n" * (place > 0) + role + ":" + text).encode("utf-8", "surrogatepass"))
            yield pd.DataFrame(out, columns=["key", "repaired_sha256"])

    return _with_audit(rows, found).mapInPandas(run, "key string, repaired_sha256 string")


def repair_report(conversations: DataFrame, original: DataFrame | None = None) -> DataFrame:
    """One row per conv_id: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    `conversations` has conv_id, turn, role, text; other columns are not looked at.  A null role or text
    is one space; rows without a conv_id are one conversation, whose conv_id is null.  Repeated rows
    count one by one, the later ones as duplicates.  Conversations that only `original` has get zeros,
    an empty audit and the hash of nothing; empty tables give no rows.
    """
    rows = ordered(conversations)
    found = verdicts(rows)
    ids = (conversations if original is None else original).select("conv_id").distinct().withColumn("id_key", F.col("conv_id").cast("string"))
    told = found.join(digests(rows, found).withColumnRenamed("key", "key2"), F.col("key").eqNullSafe(F.col("key2"))).drop("key2")
    told = ids.join(told, F.col("id_key").eqNullSafe(F.col("key")), "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return told.select(
        "conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in numbers], F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def row_paths(kinds: list[tuple[str, str]], costs: dict[str, int] = COSTS) -> tuple[Paths, int]:
    """The least integers of all ways through some rows (initial, fault), and how many letters they are wide.

    Between rows two letters may be inserted at most: three would bring back a state at a cost.  A way
    that costs more than another one between the same states is left out: what follows costs both alike.
    """
    width = 3 * len(kinds)
    cost = lambda name: costs[name] << (DIGIT * width)
    keep, change, delete, more = cost("keep"), cost("rerole"), cost("delete"), cost("truncated")
    out: Paths = {}
    for begin in range(4):
        now = {(begin, 0): 0}  # (state, letters): integer
        for initial, fault in kinds:
            now = _insert(now, width, cost("insert"))
            after: dict[tuple[int, int], int] = {}
            for (state, letters), value in now.items():
                at = DIGIT * (width - 1 - letters)
                ways = [(state, value + delete + (DELETE << at))]
                if fault not in ("b", "d"):
                    value += more if fault == "t" else 0
                    if (initial, state) in STEP:
                        ways.append((STEP[initial, state], value + keep + (KEEP << at)))
                    for role in ROLES:
                        if (role, state) in STEP:
                            ways.append((STEP[role, state], value + change + (CHANGE << at)))
                for state2, value2 in ways:
                    node = (state2, letters + 1)
                    if node not in after or value2 < after[node]:
                        after[node] = value2
            now = _cheapest(after, DIGIT * width, lambda n: n[0])
        out |= {(begin, state, letters): value for (state, letters), value in now.items()}
    return out, width


def _insert(now: dict, width: int, weight: int) -> dict:
    now = dict(now)
    front = now
    for _ in range(2):
        more = {}
        for (state, letters), value in front.items():
            for role in ROLES:
                if (role, state) in STEP and letters < width:
                    node = (STEP[role, state], letters + 1)
                    value2 = value + weight + (INSERT << (DIGIT * (width - 1 - letters)))
                    if node not in more or value2 < more[node]:
                        more[node] = value2
        for node, value in more.items():
            if node not in now or value < now[node]:
                now[node] = value
        front = more
    return _cheapest(now, DIGIT * width, lambda n: n[0])


def _cheapest(values: dict, low: int, group) -> dict:
    """Of the values of each group those with the least cost."""
    least: dict = {}
    for key, value in values.items():
        g, c = group(key), value >> low
        if g not in least or c < least[g]:
            least[g] = c
    return {key: value for key, value in values.items() if value >> low == least[group(key)]}


def joined(a: tuple[Paths, int], b: tuple[Paths, int]) -> tuple[Paths, int]:
    """The ways through two neighbours, one after the other; unused digits of width go."""
    (ways1, width1), (ways2, width2) = a, b
    width, out = width1 + width2, {}
    for (begin, middle, n1), v1 in ways1.items():
        # the cost of the second way comes above all letters, its letters right after the first way's
        v1 <<= DIGIT * width2
        for (middle2, end, n2), v2 in ways2.items():
            if middle2 != middle:
                continue
            letters = v2 & ((1 << (DIGIT * width2)) - 1)
            value = v1 + ((v2 >> (DIGIT * width2)) << (DIGIT * width)) + (letters << (DIGIT * (width1 - n1)))
            node = (begin, end, n1 + n2)
            if node not in out or value < out[node]:
                out[node] = value
    return narrowed(_cheapest(out, DIGIT * width, lambda n: n[:2]), width)


def narrowed(ways: Paths, width: int) -> tuple[Paths, int]:
    most = max((n for _, _, n in ways), default=0)
    return {key: value >> (DIGIT * (width - most)) for key, value in ways.items()}, most


def best(ways: Paths, width: int, costs: dict[str, int] = COSTS) -> tuple[int, str]:
    """Cost and letters of the least integer that starts with nothing and ends well."""
    end = {(state, state, 0): 0 for state in range(4)}
    for state in range(4):
        tail = _insert({(state, 0): 0}, 2, costs["insert"] << (DIGIT * 2))
        end |= {(state, to, n): v for (to, n), v in tail.items()}
    ways, width = joined(({k: v for k, v in ways.items() if k[0] == 0}, width), (end, 2))
    value = min(v for (_, to, _), v in ways.items() if to in ENDS)
    letters = []
    digits = value & ((1 << (DIGIT * width)) - 1)
    text = f"{digits:0{width}o}" if width else ""  # an octal digit is a letter
    letters = "".join(LETTERS[int(d)] for d in text)
    return value >> (DIGIT * width), letters


def _summary(turns: list, kinds: list[tuple[str, str]], ways: tuple[Paths, int]) -> dict:
    seen = [t for t in turns if t is not None]
    faults = [f for _, f in kinds]
    return {
        "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a + b not in FOLLOWS for (a, _), (b, _) in zip(kinds, kinds[1:], strict=False)),
        "first": kinds[0][0], "last": kinds[-1][0], "low": seen[0] if seen else None, "high": seen[-1] if seen else None,
        "turns": len(set(seen)), "width": ways[1], "ways": [[*key, f"{value:x}"] for key, value in ways[0].items()],
    }


def merged(a: dict, b: dict) -> dict:
    """The summary of two neighbouring parts of a conversation."""
    out = {c: a[c] + b[c] for c in ("blank", "duplicate", "truncated")}
    out["illegal"] = a["illegal"] + b["illegal"] + (a["last"] + b["first"] not in FOLLOWS)
    out["first"], out["last"] = a["first"], b["last"]
    out["low"] = b["low"] if a["low"] is None else a["low"]
    out["high"] = a["high"] if b["high"] is None else b["high"]
    out["turns"] = a["turns"] + b["turns"] - (a["high"] is not None and a["high"] == b["low"])
    out["ways"], out["width"] = joined((a["ways"], a["width"]), (b["ways"], b["width"]))
    return out


def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per SEGMENT rows of a conversation; rows come in order."""
    known: dict = {}
    key, start, turns, kinds = (), 0, [], []

    def close() -> tuple:
        pattern = "".join((i if i in ("s", "u", "a") else "x") + (f or "k") for i, f in kinds)
        if pattern not in known:
            if len(known) > 20_000:
                known.clear()
            known[pattern] = narrowed(*row_paths(kinds))
        return key[0], start, json.dumps(_summary(turns, kinds, known[pattern]))

    for b in batches:
        out = []
        for k, pos, turn, initial, fault in zip(b["key"], b["pos"], b["turn"], b["initial"], b["fault"], strict=True):
            if (k,) != key or len(kinds) == SEGMENT:
                if kinds:
                    out.append(close())
                key, start, turns, kinds = (k,), pos, [], []
            turns.append(None if turn is None else int(turn))
            kinds.append((initial, fault))
        yield pd.DataFrame(out, columns=["key", "pos", "part"])
    if kinds:
        yield pd.DataFrame([close()], columns=["key", "pos", "part"])


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Join each conversation's parts, neighbours first: the parts held have doubling sizes."""
    names = ["key", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]
    key, held = (), []

    def close() -> tuple:
        while len(held) > 1:
            (_, b), (_, a) = held.pop(), held.pop()
            held.append((0, merged(a, b)))
        s = held[0][1]
        cost, audit = best(s["ways"], s["width"])
        gaps = 0 if s["low"] is None else s["high"] - s["low"] + 1 - s["turns"]
        return key[0], gaps, s["blank"], s["duplicate"], s["truncated"], s["illegal"], cost, audit

    for b in batches:
        out = []
        for k, part in zip(b["key"], b["part"], strict=True):
            if (k,) != key:
                if held:
                    out.append(close())
                key, held = (k,), []
            s = json.loads(part)
            s["ways"] = {tuple(w[:3]): int(w[3], 16) for w in s["ways"]}
            held.append((0, s))
            while len(held) > 1 and held[-1][0] == held[-2][0]:
                (size, b2), (_, a2) = held.pop(), held.pop()
                held.append((size + 1, merged(a2, b2)))
        yield pd.DataFrame(out, columns=names)
    if held:
        yield pd.DataFrame([close()], columns=names)


def _with_audit(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of each conversation together and in order, after one row with its audit."""
    none = F.lit(None).cast("string")
    heads = found.select("key", F.lit(-1).cast("long").alias("pos"), none.alias("role"), none.alias("text"), "audit")
    return heads.unionByName(rows.select("key", "pos", "role", "text", none.alias("audit"))).repartition("key").sortWithinPartitions("key", "pos")


def _repair(batches: Iterator[pd.DataFrame], ends: bool = False) -> Iterator[pd.DataFrame]:
    """Apply the audit's letters to the rows that follow it; `ends` adds a row with place -1 after each conversation."""
    key, audit, at, place, state = (), "", 0, 0, 0
    out: list[tuple] = []

    def emit(edit: str, role: str, text: str) -> None:
        nonlocal place, state
        state = STEP[role[0], state]
        out.append((key[0], place, edit, role, text))
        place += 1

    def wanted() -> str:
        return ROLES["a" if state == 2 else "u"]

    def insert() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            emit("I", wanted(), "")
            at += 1

    for b in batches:
        for k, pos, role, text, letters in zip(b["key"], b["pos"], b["role"], b["text"], b["audit"], strict=True):
            if pos < 0:
                if key and ends:
                    out.append((key[0], -1, "", "", ""))
                key, audit, at, place, state = (k,), letters, 0, 0, 0
                insert()
                continue
            edit = audit[at]
            at += 1
            if edit != "D":
                emit(edit, role if edit == "K" else wanted(), text)
            insert()
        yield pd.DataFrame(out, columns=["key", "place", "edit", "role", "text"])
        out = []
    if key and ends:
        yield pd.DataFrame([(key[0], -1, "", "", "")], columns=["key", "place", "edit", "role", "text"])
