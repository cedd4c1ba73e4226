"""Conversation structure repair: error-correcting Earley parsing over a weighted grammar of roles.

A conversation is a system turn, if any, and then pairs of a user's and an assistant's turn, or
nothing at all.  Error productions let the parser keep, rerole, delete or insert turns at a price;
every chart item retains the least (cost, audit), the audit being the edits' letters in order, and
the completed chart's audit is the repair.

The grammar is left-recursive, so that every item begins at the conversation's first row: a chart
column holds a dozen items whatever the length, and a column is all that the rows after it need.
That is what lets a long conversation be parsed in pieces.  Rows are laid out by ranges of
(conversation, turn); each task parses the pieces that it holds, those at its edges from every item
that may come in, and pieces of one conversation are put together by their items.  Texts take no
part in parsing; they are shuffled once, to meet their edits in order.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .sharding import _crc_table
from .spark_io import small_or_not, table, written

RULES: tuple[tuple[str, tuple[str, ...]], ...] = (
    ("Talk", ()), ("Talk", ("Body",)),
    ("Head", ()), ("Head", ("s",)),
    ("Body", ("Head", "u", "a")), ("Body", ("Body", "u", "a")),
)
TERMINALS = "sua"
#: The error productions: an expected role may also be a reroled turn or an inserted one, and any turn may be deleted.
KEEP, REROLE, DELETE, INSERT = ("K", 0), ("R", 2), ("D", 3), ("I", 2)
MADE = "ua"  # roles that may be inserted or given
TRUNCATED_COST = 1

#: A row's code: 4 x initial (s, u, a or another) + fault.
FINE, BLANK, DUPLICATE, TRUNCATED = 0, 1, 2, 3
OTHER = len(TERMINALS)

BLOCK = 256  # rows of one chart
PIECE = 4 << 20  # bytes of messages held before they are handed on

Item = tuple[int, int]  # rule, dot
Value = tuple[int, str]  # cost, audit
START: Item = (-1, 0)

_WAITING = {name: [(r, 0) for r, (_, right) in enumerate(RULES) if right[:1] == (name,)] for name, _ in RULES}
_DONE = [(r, len(right)) for r, (left, right) in enumerate(RULES) if left == "Talk"]


def _next(item: Item) -> str | None:
    right = RULES[item[0]][1]
    return right[item[1]] if item[1] < len(right) else None


#: What a column hands to the next: items before a role, and whole talks.
_CARRIED = [(r, d) for r, (_, right) in enumerate(RULES) for d in range(len(right)) if right[d] in TERMINALS] + _DONE


def _closed(column: dict[Item, Value]) -> dict[Item, Value]:
    """The column with what its items complete, and what insertions make of them; the least value of an item is taken first."""
    out: dict[Item, Value] = {}
    agenda = [(value, item) for item, value in column.items()]
    heapq.heapify(agenda)
    while agenda:
        value, item = heapq.heappop(agenda)
        if item in out:
            continue
        out[item] = value
        expected = _next(item)
        if expected is None:
            for rule, dot in _WAITING[RULES[item[0]][0]]:
                heapq.heappush(agenda, (value, (rule, dot + 1)))
        elif expected in MADE:
            heapq.heappush(agenda, ((value[0] + INSERT[1], value[1] + INSERT[0]), (item[0], item[1] + 1)))
    return out


def _scanned(column: dict[Item, Value], code: int) -> dict[Item, Value]:
    initial, fault = code >> 2, code & 3
    out: dict[Item, Value] = {}

    def offer(item: Item, value: Value) -> None:
        if item not in out or value < out[item]:
            out[item] = value

    more = TRUNCATED_COST if fault == TRUNCATED else 0
    for item in _CARRIED:
        if item not in column:
            continue
        cost, audit = column[item]
        offer(item, (cost + DELETE[1], audit + DELETE[0]))
        expected = _next(item)
        if expected is None or fault in (BLANK, DUPLICATE):
            continue
        after = (item[0], item[1] + 1)
        if initial < OTHER and TERMINALS[initial] == expected:
            offer(after, (cost + KEEP[1] + more, audit + KEEP[0]))
        elif expected in MADE:
            offer(after, (cost + REROLE[1] + more, audit + REROLE[0]))
    return out


@lru_cache(maxsize=8192)
def chart(codes: bytes, seed: Item = START) -> dict[Item, Value]:
    """The last column of the chart of some rows, from the beginning (START) or from one item with nothing spent."""
    column = _closed({(r, 0): (0, "") for r in range(len(RULES))}) if seed == START else {seed: (0, "")}
    for code in codes:
        column = _closed(_scanned(column, code))
    return {item: column[item] for item in _CARRIED if item in column}


def joined(column: dict[Item, Value], moves: dict[Item, dict[Item, Value]]) -> dict[Item, Value]:
    """The column after a piece, from the column before it and the piece's own charts by item."""
    out: dict[Item, Value] = {}
    for seed, (cost, audit) in column.items():
        for item, (more, letters) in moves.get(seed, {}).items():
            value = (cost + more, audit + letters)
            if item not in out or value < out[item]:
                out[item] = value
    return out


def moves(codes: bytes, seeds: list[Item]) -> dict[Item, dict[Item, Value]]:
    """What a piece of any length makes of each of ``seeds``, a chart of at most BLOCK rows at a time."""
    out = {}
    for seed in seeds:
        column = chart(codes[:BLOCK], seed)
        for lo in range(BLOCK, len(codes), BLOCK):
            block = codes[lo : lo + BLOCK]
            column = joined(column, {item: chart(block, item) for item in column})
        out[seed] = column
    return out


def repair(codes: bytes) -> Value:
    """(cost, audit) of a whole conversation's codes."""
    column = moves(codes, [START])[START]
    return min(column[item] for item in _DONE if item in column)


# -- rows


@dataclass(frozen=True)
class Repaired:
    """``conversations``: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, one row each;
    ``messages``: conv_id, place, nth, edit, role, text, which place and nth (of one place) put in order."""

    conversations: DataFrame
    messages: DataFrame


_LEGAL = np.zeros((4, 4), bool)
_LEGAL[0, 1] = _LEGAL[1, 2] = _LEGAL[2, 1] = True

_MOVE = pa.struct([("seed", pa.int8()), ("item", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())])
_STATES = [START, *_CARRIED]


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of rows of one conversation in one range: what its rows count and what they make of the chart."""
    held: list[pa.RecordBatch] = []

    def finish(rows: pa.Table, last: bool) -> tuple[list[dict], pa.Table]:
        keys = rows.column("conv_id").to_pylist()
        place = rows.column("place").to_numpy()
        part = place >> 33  # as monotonically_increasing_id numbers rows
        codes = rows.column("code").to_numpy().astype(np.int64)
        turn = rows.column("turn")
        known = ~turn.is_null().to_numpy()
        turns = turn.fill_null(0).to_numpy()
        starts = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1] or part[i] != part[i - 1]]
        ends = starts[1:] + [len(keys)]
        done = len(starts) if last else len(starts) - 1
        out = []
        for k in range(done):
            lo, hi = starts[k], ends[k]
            own, faults = codes[lo:hi] >> 2, codes[lo:hi] & 3
            at = turns[lo:hi][known[lo:hi]]
            edge = place[lo] & ((1 << 33) - 1) == 0 or hi == len(keys) or part[hi] != part[lo]
            made = moves(codes[lo:hi].astype(np.uint8).tobytes(), _STATES if edge else [START])
            out.append(
                {
                    "conv_id": keys[lo], "first": int(place[lo]), "n": hi - lo,
                    "low": int(at[0]) if len(at) else None, "high": int(at[-1]) if len(at) else None, "turns": int((np.diff(at) != 0).sum() + 1) if len(at) else 0,
                    "blank": int((faults == BLANK).sum()), "duplicate": int((faults == DUPLICATE).sum()), "truncated": int((faults == TRUNCATED).sum()),
                    "illegal": int((~_LEGAL[own[:-1], own[1:]]).sum()), "head": int(own[0]), "tail": int(own[-1]),
                    "moves": [{"seed": _STATES.index(s), "item": _STATES.index(i), "cost": c, "audit": a} for s, column in made.items() for i, (c, a) in column.items()],
                }
            )
        return out, rows.slice(starts[-1]) if done < len(starts) else rows.slice(len(keys))

    schema = None
    for batch in batches:
        if not batch.num_rows:
            continue
        schema = schema or pa.schema([
            ("conv_id", batch.schema.field("conv_id").type), ("first", pa.int64()), ("n", pa.int64()), ("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()),
            ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("head", pa.int8()), ("tail", pa.int8()), ("moves", pa.list_(_MOVE)),
        ])
        rows, rest = finish(pa.Table.from_batches([*held, batch]).combine_chunks(), False)
        held = rest.to_batches()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)
    if held:
        rows, _ = finish(pa.Table.from_batches(held).combine_chunks(), True)
        yield pa.RecordBatch.from_pylist(rows, schema)


_SUMS = ("blank", "duplicate", "truncated", "illegal")
_SLICE = pa.struct([("first", pa.int64()), ("before", pa.int64()), ("headed", pa.bool_()), ("audit", pa.string())])


def _sliced(audit: str, pieces: list[tuple[int, int]]) -> list[dict]:
    """The audit by piece; ``before`` counts the turns that the repaired conversation has earlier, ``headed`` says if it has a system turn."""
    emitted = len(audit) - audit.count("D")
    out, at, before = [], 0, 0
    for k, (first, n) in enumerate(pieces):
        end, rows = at, 0
        while rows < n:
            rows += audit[end] != "I"
            end += 1
        if k == len(pieces) - 1:
            end = len(audit)
        own = audit[at:end]
        out.append({"first": first, "before": before, "headed": emitted % 2 == 1, "audit": own})
        before += len(own) - own.count("D")
        at = end
    return out


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a conversation, of its pieces in order."""
    state: dict | None = None
    schema = None

    def result(s: dict) -> dict:
        cost, audit = min(s["column"][item] for item in _DONE if item in s["column"])
        gaps = s["high"] - s["low"] + 1 - s["turns"] if s["low"] is not None else 0
        return {"conv_id": s["conv_id"], "gaps": gaps, **{c: s[c] for c in _SUMS}, "cost": cost, "slices": _sliced(audit, s["pieces"])}

    for batch in batches:
        schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("gaps", pa.int64()), *[(c, pa.int64()) for c in _SUMS], ("cost", pa.int64()), ("slices", pa.list_(_SLICE))])
        out = []
        for row in batch.to_pylist():
            made: dict[Item, dict[Item, Value]] = {}
            for m in row["moves"]:
                made.setdefault(_STATES[m["seed"]], {})[_STATES[m["item"]]] = (m["cost"], m["audit"])
            if state is None or state["conv_id"] != row["conv_id"]:
                if state is not None:
                    out.append(result(state))
                state = {"conv_id": row["conv_id"], "column": made[START], "pieces": [], "low": None, "high": None, "turns": 0, "tail": None, **{c: 0 for c in _SUMS}}
            else:
                state["column"] = joined(state["column"], made)
                state["illegal"] += not _LEGAL[state["tail"], row["head"]]
            for c in _SUMS:
                state[c] += row[c]
            state["tail"] = row["tail"]
            state["pieces"].append((row["first"], row["n"]))
            if row["low"] is not None:
                state["turns"] += row["turns"] - (state["high"] == row["low"])
                state["low"] = row["low"] if state["low"] is None else state["low"]
                state["high"] = row["high"]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if state is not None:
        yield pa.RecordBatch.from_pylist([result(state)], schema)


_EDIT = pa.schema([("place", pa.int64()), ("before", pa.string()), ("edit", pa.string()), ("role", pa.string()), ("after", pa.string())])
_NAMES = {"u": "user", "a": "assistant"}


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each row that stays or has turns inserted beside it: roles to insert before and after, the edit, the new role if any."""
    for batch in batches:
        out: list[dict] = []
        for row in batch.to_pylist():
            place, at, headed = row["first"], row["before"], row["headed"]
            waiting = ""
            for letter in row["audit"]:
                role = "ua"[(at - headed) % 2]
                at += letter != "D"
                if letter == "I":
                    waiting += role
                    continue
                if letter != "D" or waiting:
                    out.append({"place": place, "before": waiting, "edit": letter, "role": _NAMES[role] if letter == "R" else None, "after": ""})
                place, waiting = place + 1, ""
                if len(out) >= 1 << 16:
                    yield pa.RecordBatch.from_pylist(out[:-1], _EDIT)
                    out = out[-1:]
            if waiting:  # the conversation ends with turns that it never had
                if out and out[-1]["place"] == place - 1:
                    out[-1]["after"] = waiting
                else:
                    out.append({"place": place - 1, "before": "", "edit": "D", "role": None, "after": waiting})
        if out:
            yield pa.RecordBatch.from_pylist(out, _EDIT)


def _messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts come before the edits of their rows; equal rows share one text."""
    text = ""
    for batch in batches:
        schema = pa.schema([("conv_id", batch.schema.field("conv_id").type), ("place", pa.int64()), ("nth", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        out = []
        for row in batch.to_pylist():
            if row["kind"] == 0:
                text = row["text"]
                continue
            turns = [("I", _NAMES[r], "") for r in row["before"]]
            if row["edit"] != "D":
                turns.append((row["edit"], row["new_role"] or row["role"], text))
            turns += [("I", _NAMES[r], "") for r in row["after"]]
            out += [{"conv_id": row["conv_id"], "place": row["place"], "nth": i, "edit": e, "role": r, "text": t} for i, (e, r, t) in enumerate(turns)]
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)


def _same(left: str, right: str, *columns: str) -> Column:
    tests = [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns]
    out = tests[0]
    for t in tests[1:]:
        out &= t
    return out


_KEY = ("conv_id", "turn", "role", "digest")


def repair_conversations(rows: DataFrame) -> Repaired:
    """Faults, cheapest edits and repaired turns of conversations given as rows of conv_id, turn, role, text.

    A conversation's rows are taken by turn, null turns first; rows of one turn go by role and then by
    the MD5 of their texts.  A null role or text is one space.  A row's first fault counts: blank (no
    character but white space), duplicate (an earlier row has its role and text), truncated (its last
    character but white space is none of ``.!?``).  A role counts by its first letter, and an empty
    one as no known role.  Of equally cheap edits the letters least in ASCII are taken, and inserted
    turns are empty.  A null conv_id is a conversation like others; rows that repeat are rows;
    other columns are ignored; an empty table gives empty results.
    """
    conv = rows.schema["conv_id"].dataType.simpleString()
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    given = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text")).withColumn("digest", F.md5(F.col("text").cast("binary")))
    bare = F.regexp_replace("text", r"[\x20\x09-\x0D]+$", "")
    initial = F.substring("role", 1, 1)
    known = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(OTHER)
    fault = F.when(F.octet_length(bare) == 0, BLANK).when(~F.substring(bare, -1, 1).isin(".", "!", "?"), TRUNCATED).otherwise(FINE)
    keys = given.select(*_KEY, (known * 4 + fault).cast("tinyint").alias("code"))
    # the rows' own numbers part equal rows, so that no range need hold them all
    order = [*_KEY, "_n"]
    laid = keys.withColumn("_n", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("_n")
    laid = written(laid.withColumn("place", F.monotonically_increasing_id()))

    # the first of equal turns, where there are several; hot ones are combined before the shuffle
    solid = laid.where(F.col("code") % 4 != BLANK)
    firsts = solid.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    marked = laid.alias("l").join(small_or_not(written(firsts)).alias("f"), _same("l", "f", "conv_id", "role", "digest"), "left")
    again = (F.col("code") % 4 != BLANK) & (F.col("place") > F.col("first"))
    code = F.when(again, F.col("code") - F.col("code") % 4 + DUPLICATE).otherwise(F.col("code")).cast("tinyint")
    ranged = marked.select("l.conv_id", "turn", "place", code.alias("code")).repartition(F.shiftright("place", 33)).sortWithinPartitions("place")
    sums = ", ".join(f"{c} long" for c in _SUMS)
    pieces = ranged.mapInArrow(
        _pieces, f"conv_id {conv}, first long, n long, low long, high long, turns long, {sums}, head tinyint, tail tinyint, moves array<struct<seed: tinyint, item: tinyint, cost: long, audit: string>>"
    )
    whole = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "first").mapInArrow(_put_together, f"conv_id {conv}, gaps long, {sums}, cost long, slices array<struct<first: long, before: long, headed: boolean, audit: string>>")
    whole = written(whole)

    edits = whole.select(F.explode("slices").alias("s")).select("s.*").mapInArrow(_edits, "place long, before string, edit string, role string, after string")
    at_rows = laid.join(edits.withColumnRenamed("role", "new_role"), "place").select(*_KEY, F.lit(1).alias("kind"), "place", "before", "edit", "new_role", "after", F.lit(None).cast("string").alias("text"))
    texts = given.select(*_KEY, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("place"), *[F.lit(None).cast("string").alias(c) for c in ("before", "edit", "new_role", "after")], "text")
    met = texts.unionByName(at_rows).repartitionByRange(*_KEY).sortWithinPartitions(*_KEY, "kind", "place")
    messages = met.mapInArrow(_messages, f"conv_id {conv}, place long, nth int, edit string, role string, text string")
    audit = F.array_join(F.transform("slices", lambda s: s["audit"]), "")
    return Repaired(whole.select("conv_id", "gaps", *_SUMS, "cost", audit.alias("audit")), messages)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of conversations that lie within the task; those at its edges, and very long ones, go on as pieces of their bytes."""
    state: dict | None = None
    schema = None

    def end(s: dict) -> list[dict]:
        if s["edge"]:
            return [{"conv_id": s["conv_id"], "place": s["place"], "sha": None, "piece": s["bytes"]}]
        return [{"conv_id": s["conv_id"], "place": s["place"], "sha": hashlib.sha256(s["bytes"]).hexdigest(), "piece": None}]

    for batch in batches:
        schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("place", pa.int64()), ("sha", pa.string()), ("piece", pa.binary())])
        out = []
        for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
            line = f"{role}:{text}".encode()
            if state is None or state["conv_id"] != conv:
                if state is not None:
                    out += end(state)
                state = {"conv_id": conv, "place": place, "edge": state is None, "bytes": bytearray(line)}
            elif len(state["bytes"]) > PIECE and place > state["place"]:
                state["edge"] = True
                out += end(state)
                state |= {"place": place, "bytes": bytearray(line)}
            else:
                state["bytes"] += b"\n" + line
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if state is not None:
        state["edge"] = True
        yield pa.RecordBatch.from_pylist(end(state), schema)


def _digests_of_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, digest, schema = None, None, None
    for batch in batches:
        schema = schema or pa.schema([("conv_id", batch.schema.field("conv_id").type), ("sha", pa.string())])
        out = []
        for key, piece in zip(batch.column("conv_id").to_pylist(), batch.column("piece").to_pylist(), strict=True):
            if digest is not None and key == conv:
                digest.update(b"\n" + piece)
                continue
            if digest is not None:
                out.append({"conv_id": conv, "sha": digest.hexdigest()})
            conv, digest = key, hashlib.sha256(piece)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)
    if digest is not None:
        yield pa.RecordBatch.from_pylist([{"conv_id": conv, "sha": digest.hexdigest()}], schema)


def message_digests(messages: DataFrame) -> DataFrame:
    """conv_id, sha: SHA-256 of each conversation's ``role:text`` lines, for ``messages`` in their own order.

    SHA-256 has no parallel form, so a conversation beyond one task's range is read by one task, as a stream.
    """
    conv = messages.schema["conv_id"].dataType.simpleString()
    found = written(messages.mapInArrow(_digests, f"conv_id {conv}, place long, sha string, piece binary"))
    pieces = found.where("sha is null").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return found.where("sha is not null").select("conv_id", "sha").unionByName(pieces.mapInArrow(_digests_of_pieces, f"conv_id {conv}, sha string"))


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of rows that a checksum of conversation and turn damages: dropped, emptied, unpunctuated, repeated, or made a user's."""
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    key = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    kind = F.crc32(key.cast("binary")) % 20
    hurt = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("_kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hurt.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


def op11_earley_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conv_id of ``conversations``, nulls together; one whose rows are all dropped has zeros, no audit and the digest of nothing.

    Edge cases are ``repair_conversations``'s.
    """
    rows = table(spark, sf_dir, "conversations")
    fixed = repair_conversations(damaged(rows))
    found, shas = fixed.conversations, message_digests(fixed.messages)
    out = rows.select("conv_id").distinct().alias("i").join(found.alias("c"), _same("i", "c", "conv_id"), "left").join(shas.alias("s"), _same("i", "s", "conv_id"), "left")
    zero = [F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in ("gaps", *_SUMS, "cost")]
    return out.select("i.conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def _least(*values: str) -> str:
    """The least (cost, audit), as lists that DuckDB orders."""
    return f"list_min([{', '.join(values)}])"


def _spend(state: str, cost: str, letter: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"


def _insertions(p: str) -> str:
    """States n (nothing yet), s, u, a of columns ``p``n ... with inserted turns."""
    made_u = _least(f"{p}u", *[_spend(f"{p}{x}", "2", "I") for x in "nsa"])
    made_a = _least(f"{p}a", _spend(f"{p}u", "2", "I"), *[_spend(f"{p}{x}", "4", "II") for x in "ns"])
    return f"{p}n AS n, {p}s AS s, {made_u} AS u, {made_a} AS a"


_INF = "{'c': CAST(1000000000000 AS BIGINT), 'a': ''}"


def _take(letter: str, state: str, role: str) -> str:
    """A row kept or reroled as ``role`` after ``state``; infinitely dear if it can't be."""
    keep, rerole = _spend(state, "cut", "K"), _spend(state, "2 + cut", "R") if role in MADE else _INF
    return f"CASE WHEN bad THEN {_INF} WHEN initial = '{role}' THEN {keep} ELSE {rerole} END"


# the same repair by a machine of four states, a row at a time: what is cheapest to have after each row
ORACLE_SQL = f"""
WITH RECURSIVE g AS (SELECT *, hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS x FROM conversations),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, length(x) // 2), lambda i: CAST('0x' || x[2 * i + 1:2 * i + 2] AS BIGINT))),
                 lambda h, y: xor(h >> 8, {_crc_table()}[1 + (xor(h, y) & 255)]))) % 20 AS kind FROM g),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
             CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM k, (SELECT unnest([0, 1]) AS copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS pos FROM d),
f AS (SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'x' END AS initial, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank,
             row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS seen, NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open FROM o),
r AS (SELECT *, blank OR seen AS bad, CAST(NOT blank AND NOT seen AND open AS BIGINT) AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial AS pair FROM f),
t AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate,
             sum(cut)::BIGINT AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS last FROM r GROUP BY conv_id),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, {_insertions("z")} FROM t, (SELECT {{'c': CAST(0 AS BIGINT), 'a': ''}} AS zn, {_INF} AS zs, {_INF} AS zu, {_INF} AS za)
      UNION ALL
      SELECT conv_id, pos, {_insertions("z")} FROM (
        SELECT w.conv_id, r.pos, {_spend("n", "3", "D")} AS zn, {_least(_spend("s", "3", "D"), _take("K", "n", "s"))} AS zs,
               {_least(_spend("u", "3", "D"), *[_take("K", x, "u") for x in "nsa"])} AS zu, {_least(_spend("a", "3", "D"), _take("K", "u", "a"))} AS za
        FROM w JOIN r ON r.conv_id IS NOT DISTINCT FROM w.conv_id AND r.pos = w.pos + 1)),
e AS (SELECT t.*, {_least("n", "a")} AS best FROM t JOIN w ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND w.pos = t.last),
l AS (SELECT conv_id, unnest(string_split(best.a, '')) AS letter, generate_subscripts(string_split(best.a, ''), 1) AS i FROM e WHERE best.a <> ''),
m AS (SELECT *, CAST(sum(CAST(letter <> 'I' AS INT)) OVER (PARTITION BY conv_id ORDER BY i) AS BIGINT) AS pos,
             sum(CAST(letter <> 'D' AS INT)) OVER (PARTITION BY conv_id ORDER BY i) - 1 AS nth, sum(CAST(letter <> 'D' AS INT)) OVER (PARTITION BY conv_id) % 2 AS headed FROM l),
h AS (SELECT m.conv_id, sha256(string_agg(CASE letter WHEN 'K' THEN r.role ELSE CASE WHEN (nth - headed) % 2 = 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE r.text END, chr(10) ORDER BY i)) AS sha
      FROM m LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM m.conv_id AND r.pos = m.pos WHERE letter <> 'D' GROUP BY m.conv_id)
SELECT i.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.c, 0) AS cost, coalesce(best.a, '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN e ON e.conv_id IS NOT DISTINCT FROM i.conv_id LEFT JOIN h ON h.conv_id IS NOT DISTINCT FROM i.conv_id
"""
