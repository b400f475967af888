"""Repair of conversation structure: cheapest edits by iterative-deepening A*, cut into segments for long conversations."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import crc32_sql, in_order, query, ranked, table, written

#: Rows of a segment that is searched as a whole, and segments that are joined at a time.
SEGMENT = 64
BLOCK = 64
#: Cost of each edit, and of a truncated row that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

#: What the roles so far allow: nothing yet, after a system role, after a user, after an assistant; END is the goal of a
#: whole conversation, which may insert after its last row.
START, SYSTEM, USER, ASSISTANT, END = range(5)
_KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_CLOSING = {START: (0, ""), SYSTEM: (2 * INSERT, "II"), USER: (INSERT, "I"), ASSISTANT: (0, "")}

#: Letters of a shape: x must go, s u a have that initial, o any other; capitals are truncated. The least cost of a row
#: once a system role can't be kept any more.
_SHAPE_COST = {"x": DELETE, "o": REROLE, "s": REROLE, "O": DELETE, "S": DELETE, "U": TRUNCATED, "A": TRUNCATED}


def estimates(shape: str, goal: int) -> list[list[int]]:
    """What the rows from each place on cost at least, by state.

    Every row has a least cost of its own. Of two user or two assistant rows with only deleted rows between, one is edited
    or a row is inserted between them, beyond that cost; such pairs count if they share no row. From START one system
    role may yet be kept. START as a goal leaves nothing but deletions, SYSTEM all but one.
    """
    n = len(shape)
    never = 4 * DELETE * (n + 2)
    if goal in (START, SYSTEM):
        gone = [DELETE * (n - i) for i in range(n + 1)]
        start = gone if goal == START else [max(0, g - DELETE) for g in gone[:-1]] + [never]
        return [[start[i], gone[i] if goal == SYSTEM else never, never, never] for i in range(n + 1)]
    out, own, after, saved = [[0] * 4], 0, None, 0
    pairs = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        c = shape[i]
        own += _SHAPE_COST.get(c, 0)
        pairs[i] = pairs[i + 1]
        if c.lower() in "ua":
            if after is not None and shape[after].lower() == c.lower():
                edit = 1 if c.isupper() or shape[after].isupper() else 3
                pairs[i] = max(pairs[i], edit + pairs[after + 1])
            after = i
        elif c != "x":
            after = None
        saved = max(saved, {"s": REROLE, "S": 1}.get(c, 0))
        out.append([own + pairs[i] - saved, *[own + pairs[i]] * 3])
    return out[::-1]


def cheapest_edits(shape: str, entry: int = START, goal: int = END) -> tuple[int, str] | None:
    """Cost and audit of the cheapest edits that lead from `entry` to `goal`; of equal cost the ASCII-least audit.

    Iterative-deepening A*: a depth-first search in the order D, I, K, R under a bound that rises to the least cost
    that exceeded it. `estimates` says what is left at least; the table of failed states raises that for each (row, state)
    to what the failed search below it needs. The first accepting path under the least bound that has
    one is the answer. Without END, insertions stand before a row of this shape only. None if the goal can't be reached.
    """
    n = len(shape)
    least = estimates(shape, goal)

    def moves(i: int, state: int):
        if i == n:
            return [("I", INSERT, i, _NEXT[state])] if goal == END else []
        letter, extra = shape[i].lower(), TRUNCATED if shape[i].isupper() else 0
        out = [("D", DELETE, i + 1, state), ("I", INSERT, i, _NEXT[state])]
        if state in _KEEP.get(letter, ()):
            out.append(("K", extra, i + 1, _KEEP[letter][state]))
        if letter != "x":
            out.append(("R", REROLE + extra, i + 1, _NEXT[state]))
        return out

    def search(i: int, state: int, budget: int) -> str | None:
        if least[i][state] > budget:
            return None
        if i == n and (state == goal or goal == END and state in (START, ASSISTANT)):
            return ""
        needs = 4 * DELETE * (n + 2)
        for edit, cost, row, after in moves(i, state):
            rest = search(row, after, budget - cost)
            if rest is not None:
                return edit + rest
            needs = min(needs, cost + least[row][after])
        least[i][state] = max(least[i][state], needs)
        return None

    bound, most = least[0][entry], DELETE * n + 3 * INSERT + TRUNCATED
    while bound <= most:
        audit = search(0, entry, bound)
        if audit is not None:
            return bound, audit
        bound = least[0][entry]
    return None


def cells_of(shape: str, whole: bool) -> list[tuple[int, int, int, str]]:
    """Entry, goal, cost and audit of a whole conversation, or of every way through a segment."""
    ways = [(START, END)] if whole else [(a, b) for a in range(END) for b in range(END)]
    found = ((a, b, cheapest_edits(shape, a, b)) for a, b in ways)
    return [(a, b, *best) for a, b, best in found if best is not None]


def joined_cells(first: list, second: list) -> list[tuple[int, int, int, str]]:
    """Every way through two segments, the cheapest, then the ASCII-least.

    Each row of a segment has one letter besides the I before it, so no audit of a segment begins another one, and the
    least audit of two segments is the least of the first followed by the least of the second.
    """
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for a, middle, cost, audit in first:
        for other, b, more, rest in second:
            if middle == other:
                way = cost + more, audit + rest
                if (a, b) not in best or way < best[a, b]:
                    best[a, b] = way
    return [(a, b, *way) for (a, b), way in best.items()]


@dataclass
class Repair:
    """ordered: the rows in order (key, at, role, text). facts: one row a conversation with rows: key, conv, gaps, blank,
    duplicate, truncated, illegal, cost, audit."""
    ordered: DataFrame
    facts: DataFrame


_CELLS = "array<struct<entry:int,goal:int,cost:bigint,audit:string>>"


def _plain_cells(cells) -> list[tuple[int, int, int, str]]:
    return [(c["entry"], c["goal"], c["cost"], c["audit"]) for c in cells]


def _cells_array(values: list[list[tuple[int, int, int, str]]]) -> pa.Array:
    names = ("entry", "goal", "cost", "audit")
    kind = pa.list_(pa.struct([("entry", pa.int32()), ("goal", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))
    return pa.array([[dict(zip(names, c)) for c in cells] for cells in values], kind)


def _searched(batches):
    for batch in batches:
        cells = [cells_of(s.as_py(), w.as_py()) for s, w in zip(batch.column("shape"), batch.column("whole"))]
        yield pa.RecordBatch.from_arrays([batch.column("shape"), batch.column("whole"), _cells_array(cells)],
                                         ["shape", "whole", "cells"])


def _joined_block(group: pa.Table) -> pa.Table:
    group = group.sort_by([("seg", "ascending")])
    cells = None
    for part in group["cells"]:
        own = _plain_cells(part.as_py())
        cells = own if cells is None else joined_cells(cells, own)
    return pa.table({"key": group["key"].slice(0, 1).combine_chunks(),
                     "seg": pa.array([group["seg"][0].as_py() // BLOCK], pa.int64()), "cells": _cells_array([cells])})


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text", segment: int = SEGMENT) -> Repair:
    """Faults and cheapest edits of each conversation, so that its role initials read `(s?(ua)+)?`.

    Rows of a conversation are taken by turn, nulls first, then by a digest of role and text; rows that repeat stand
    side by side. Null roles and texts are one space; null is a conversation of its own. A row is blank without a
    character outside ASCII white space, else duplicate if role and text were seen earlier, else truncated if the last
    such character is none of `.!?`. Blank and duplicate rows are deleted (4); others are kept, get the role user or
    assistant (3) or go, a truncated row that stays adds 3, and an empty user or assistant may be inserted anywhere (3).
    An empty role fits nowhere. Other columns are ignored; an empty table has no conversations.

    Only shapes, one letter a row, are searched, each distinct one once. A conversation of more than `segment` rows is cut:
    every segment is searched from each state to each state, and the segments are joined by cost and audit in blocks, which
    gives the same edits as one search. No task holds a conversation's rows: order and repeats come from range
    partitions and aggregates.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role_col, text_col))
    key = F.when(F.col(conv_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(conv_col).cast("string")))
    named = rows.select(key.alias("key"), F.col(conv_col).alias("conv"), F.col(turn_col).cast("bigint").alias("turn"),
                        role.alias("role"), text.alias("text"))
    content = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    ordered = in_order(named.withColumn("content", content), "key", ["turn", "content"])

    # no texts from here on
    last = F.regexp_extract("text", r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)
    facts = ordered.select("key", "conv", "at", "turn", "content", F.substring("role", 1, 1).alias("initial"),
                           last.alias("last"))
    repeated = (facts.where("last <> ''").groupBy("key", "content").agg(F.min("at").alias("first"), F.count("*").alias("copies"))
                .where("copies > 1").drop("copies"))
    facts = facts.join(repeated, ["key", "content"], "left").drop("content")
    blank = F.col("last") == ""
    duplicate = ~blank & F.coalesce(F.col("at") > F.col("first"), F.lit(False))
    truncated = ~blank & ~duplicate & ~F.col("last").isin(".", "!", "?")
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    letter = F.when(blank | duplicate, "x").when(truncated, F.upper(letter)).otherwise(letter)
    facts = ranked(facts.select("key", "conv", "at", "turn", "initial", letter.alias("letter"), blank.alias("blank"),
                                duplicate.alias("duplicate"), truncated.alias("truncated")))

    # one row a segment; its lists have at most `segment` entries
    listed = F.sort_array(F.collect_list(F.struct("rank", "letter", "initial", "turn")))
    segs = facts.groupBy("key", F.floor(F.col("rank") / segment).alias("seg")).agg(
        listed.alias("rows"), F.min("conv").alias("conv"), (F.max("n") <= segment).alias("whole"),
        *[F.sum(F.col(c).cast("bigint")).alias(c) for c in ("blank", "duplicate", "truncated")])
    pairs = F.transform(F.sequence(F.lit(1), F.size("rows") - 1), lambda i: F.concat(
        F.col("rows")[i - 1]["initial"], F.col("rows")[i]["initial"]))
    illegal = F.when(F.size("rows") > 1, F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au")))).otherwise(0)
    turns = F.array_distinct(F.filter(F.col("rows")["turn"], lambda t: t.isNotNull()))
    edge = F.struct(F.col("rows")[0]["initial"].alias("initial"), F.col("rows")[0]["turn"].alias("turn"))
    end = F.struct(F.element_at("rows", -1)["initial"].alias("initial"), F.element_at("rows", -1)["turn"].alias("turn"))
    segs = written(segs.select(
        "key", "conv", "seg", "whole", "blank", "duplicate", "truncated", F.array_join(F.col("rows")["letter"], "").alias("shape"),
        illegal.cast("bigint").alias("illegal"), F.size(turns).cast("bigint").alias("turns"),
        F.array_min(turns).alias("low"), F.array_max(turns).alias("high"), edge.alias("edge"), end.alias("end")))

    # where two segments of a conversation meet
    later = segs.where("seg > 0").select("key", (F.col("seg") - 1).alias("seg"), F.col("edge").alias("next"))
    meets = segs.where("not whole").select("key", "seg", "end").join(later, ["key", "seg"])
    pair = F.concat("end.initial", "next.initial")
    meets = meets.groupBy("key").agg(
        F.sum((~pair.isin("su", "ua", "au")).cast("bigint")).alias("more_illegal"),
        F.sum(F.coalesce(F.col("end.turn") == F.col("next.turn"), F.lit(False)).cast("bigint")).alias("shared_turns"))
    sums = segs.groupBy("key").agg(
        F.min("conv").alias("conv"), F.min("low").alias("low"), F.max("high").alias("high"),
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "turns")]).join(meets, "key", "left")
    gaps = F.col("high") - F.col("low") + 1 - F.col("turns") + F.coalesce("shared_turns", F.lit(0))
    sums = sums.select("key", "conv", F.coalesce(gaps, F.lit(0)).alias("gaps"), "blank", "duplicate", "truncated",
                       (F.col("illegal") + F.coalesce("more_illegal", F.lit(0))).alias("illegal"))

    # the search; tiny rows of heavy work, so they are dealt by number (and by a hash of their own: Spark drops a deal by
    # the columns of the distinct itself) and not joined to fewer tasks by size
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shapes = segs.select("shape", "whole").distinct().repartition(tasks, F.xxhash64("shape"))
    cells = written(shapes.mapInArrow(_searched, f"shape string, whole boolean, cells {_CELLS}"))
    found = segs.select("key", "seg", "shape", "whole").join(cells, ["shape", "whole"])
    done = found.where("whole").select("key", "cells")
    parts = written(found.where("not whole").select("key", "seg", "cells"))
    while not parts.where("seg > 0").isEmpty():
        parts = written(parts.groupBy("key", F.floor(F.col("seg") / BLOCK).alias("block")).applyInArrow(
            _joined_block, f"key string, seg bigint, cells {_CELLS}"))
    closed = F.array_min(F.transform(F.filter("cells", lambda c: c["entry"] == START), _closed))
    audits = done.unionByName(parts.select("key", "cells")).select("key", closed.alias("best"))
    facts = written(sums.join(audits, "key").select("*", "best.cost", "best.audit").drop("best"))
    return Repair(ordered.select("key", "at", "role", "text"), facts)


def _closed(cell: Column) -> Column:
    cost, audit = F.lit(0), F.lit("")
    for state, (more, letters) in _CLOSING.items():
        cost = F.when(cell["goal"] == state, F.lit(more)).otherwise(cost)
        audit = F.when(cell["goal"] == state, F.lit(letters)).otherwise(audit)
    return F.struct((cell["cost"] + cost).alias("cost"), F.concat(cell["audit"], audit).alias("audit"))


def _replayed(batches) -> Iterator[tuple[str, str | None, str | None]]:
    """(key, None, None) where a conversation begins, then (key, role, text) of each line that the edits leave or add."""
    key, audit, at, state = None, "", 0, START

    def inserted():
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            at, state = at + 1, _NEXT[state]
            yield key, "user" if state == USER else "assistant", ""

    for batch in batches:
        for k, place, role, text in zip(*(batch.column(c) for c in ("key", "at", "role", "text"))):
            if place.as_py() < 0:
                yield from inserted()
                key, audit, at, state = k.as_py(), text.as_py(), 0, START
                yield key, None, None
                continue
            yield from inserted()
            edit, at = audit[at], at + 1
            if edit == "K":
                name = role.as_py()
                state = _KEEP[name[0]][state]
                yield key, name, text.as_py()
            elif edit == "R":
                state = _NEXT[state]
                yield key, "user" if state == USER else "assistant", text.as_py()
    yield from inserted()


def _in_turn(found: Repair, run: Callable, schema: str) -> DataFrame:
    """`run` over the rows of each conversation in order, its audit first, as a stream: no conversation is held whole."""
    audits = found.facts.select("key", F.lit(-1).cast("bigint").alias("at"), F.lit(None).cast("string").alias("role"),
                                F.col("audit").alias("text"))
    return (found.ordered.unionByName(audits).repartition("key").sortWithinPartitions("key", "at")
            .mapInArrow(run, schema))


def repaired_rows(found: Repair) -> DataFrame:
    """key, place (from 0), role, text of the repaired conversations."""

    def run(batches):
        rows, place = [], 0
        for key, role, text in _replayed(batches):
            if role is None:
                place = 0
                continue
            rows.append((key, place, role, text))
            place += 1
            if len(rows) >= 1000:
                yield out(rows)
                rows = []
        yield out(rows)

    def out(rows):
        columns = list(zip(*rows)) or [[]] * 4
        kinds = (pa.string(), pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["key", "place", "role", "text"])

    return _in_turn(found, run, "key string, place bigint, role string, text string")


def repaired_digests(found: Repair) -> DataFrame:
    """key and the SHA-256 in hex of the repaired `role:text` lines, joined by line feeds."""

    def run(batches):
        keys, sums, key, state, first = [], [], None, None, True
        for k, role, text in _replayed(batches):
            if role is None:
                if state is not None:
                    keys.append(key)
                    sums.append(state.hexdigest())
                key, state, first = k, hashlib.sha256(), True
                if len(keys) >= 10_000:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.string())], ["key", "sum"])
                    keys, sums = [], []
                continue
            state.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
            first = False
        if state is not None:
            keys.append(key)
            sums.append(state.hexdigest())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(sums, pa.string())], ["key", "sum"])

    return _in_turn(found, run, "key string, sum string")


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with the faults that crc32 of `conv_id:turn` (null: one space) gives them."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(name.cast("binary")) % 20
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    role = F.when(fault == 4, "user").otherwise(F.coalesce(F.col("role").cast("string"), F.lit(" ")))
    out = rows.where(fault != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"),
                                        F.when(fault == 3, 2).otherwise(1).alias("copies"))
    return out.withColumn("copies", F.explode(F.sequence(F.lit(1), F.col("copies")))).drop("copies")


def repaired_summary(rows: DataFrame) -> DataFrame:
    """One row for every conv_id of `rows`, null included, about its conversation after damage; see `repair`."""
    found = repair(damaged(rows))
    sums = found.facts.join(repaired_digests(found), "key")
    key = F.when(F.col("conv_id").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("conv_id").cast("string")))
    every = rows.select("conv_id").distinct().withColumn("key", key).join(sums, "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in (
        "gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce(
        "sum", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))


def _way_sql(ways: list[tuple[str, str, str, str]]) -> str:
    """The least of (condition, state, cost, letters) as `cost:audit` with a cost of nine digits."""
    each = [f"CASE WHEN {when} THEN lpad((substr({state}, 1, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) "
            f"|| '{letters}' END" for when, state, cost, letters in ways]
    return f"least({', '.join(each)})" if len(each) > 1 else each[0]


_OPEN2 = _way_sql([("true", "v2", "0", ""), *[("true", v, "3", "I") for v in ("v0", "v1", "v3")]])
_OPEN3 = _way_sql([("true", "v3", "0", ""), ("true", "v2", "3", "I"), ("true", "v0", "6", "II"), ("true", "v1", "6", "II")])
_EXTRA = "(CASE WHEN c = upper(c) THEN 3 ELSE 0 END)"


def _steps_sql(state: int, keep: str, sources: list[str]) -> str:
    ways = [("true", f"w{state}", "4", "D")]
    if keep:
        ways += [(f"lower(c) = '{keep}'", w, _EXTRA, "K") for w in sources]
    if state in (USER, ASSISTANT):
        ways += [("c <> 'x'", w, f"3 + {_EXTRA}", "R") for w in sources]
    return _way_sql(ways)


SQL = f"""
WITH RECURSIVE marked AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fault FROM conversations),
d AS (
  SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
         CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
  FROM marked WHERE fault <> 0),
o AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
             sha256(strlen(role)::VARCHAR || ':' || role || text), copy) AS i,
         right(regexp_replace(text, '[\\x20\\x09-\\x0D]+$', ''), 1) AS last, left(role, 1) AS initial FROM d),
f AS (
  SELECT *, last = '' AS blank, last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM o),
g AS (
  SELECT *, NOT blank AND NOT dup AND last NOT IN ('.', '!', '?') AS cut,
         CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE 'o' END AS letter FROM f),
conv AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
         count(*) FILTER (dup) AS duplicate, count(*) FILTER (cut) AS truncated,
         count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
         string_agg(CASE WHEN blank OR dup THEN 'x' WHEN cut THEN upper(letter) ELSE letter END, '' ORDER BY i) AS shape
  FROM g GROUP BY conv_id),
ways AS (
  SELECT DISTINCT shape, 0 AS i, '000000000:' AS v0, NULL::VARCHAR AS v1, NULL::VARCHAR AS v2, NULL::VARCHAR AS v3 FROM conv
  UNION ALL
  SELECT shape, i + 1, {_steps_sql(0, "", [])}, {_steps_sql(1, "s", ["w0"])},
         {_steps_sql(2, "u", ["w0", "w1", "w3"])}, {_steps_sql(3, "a", ["w2"])}
  FROM (SELECT shape, i, substr(shape, i + 1, 1) AS c, v0 AS w0, v1 AS w1, {_OPEN2} AS w2, {_OPEN3} AS w3 FROM ways
        WHERE i < length(shape))),
best AS (
  SELECT shape, {_way_sql([("true", "v0", "0", ""), ("true", "v3", "0", ""), ("true", "v2", "3", "I"), ("true", "v1", "6", "II")])}
         AS way FROM ways WHERE i = length(shape)),
audits AS (SELECT conv.*, substr(way, 1, 9)::BIGINT AS cost, substr(way, 11) AS audit FROM conv JOIN best USING (shape)),
edits AS (
  SELECT conv_id, unnest(range(1, length(audit) + 1)) AS p, substr(audit, p, 1) AS edit,
         p - length(replace(substr(audit, 1, p), 'I', '')) AS inserts FROM audits),
lines AS (
  SELECT e.conv_id, edit, p, g.role, coalesce(CASE WHEN edit <> 'I' THEN g.text END, '') AS text,
         row_number() OVER (PARTITION BY e.conv_id ORDER BY p) AS j FROM edits e
  LEFT JOIN g ON e.conv_id IS NOT DISTINCT FROM g.conv_id AND edit <> 'I' AND g.i = p - inserts WHERE edit <> 'D'),
system AS (SELECT conv_id, count(*) FILTER (j = 1 AND edit = 'K' AND left(role, 1) = 's') AS s FROM lines GROUP BY conv_id),
told AS (
  SELECT lines.conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - s) % 2 = 1 THEN 'user' ELSE 'assistant' END
         || ':' || text, chr(10) ORDER BY p)) AS digest
  FROM lines JOIN system ON lines.conv_id IS NOT DISTINCT FROM system.conv_id GROUP BY lines.conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(audit, '') AS audit, coalesce(digest, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN audits ON ids.conv_id IS NOT DISTINCT FROM audits.conv_id
LEFT JOIN told ON ids.conv_id IS NOT DISTINCT FROM told.conv_id
"""


@query("op12_repair", SQL)
def op12_repair(spark, sf_dir):
    return repaired_summary(table(spark, sf_dir, "conversations"))
