"""Conversation repair against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

from versionlake.llm import conversations as C

ROWS = "conv_id bigint, turn int, role string, text string, key string, at int, rank int, cost int"
SPACE = " \t\n\x0b\x0c\r"
VALID = re.compile(r"(s?(ua)+)?\Z")


def every_audit(shape):
    """All audits with up to two insertions before each row and at the end, with their cost and role initials."""
    gaps = ["", "I", "II"]
    for letters in itertools.product(*["D" if c == "x" else "DKR" for c in shape]):
        for inserts in itertools.product(gaps, repeat=len(shape) + 1):
            yield "".join(g + e for g, e in zip(inserts, [*letters, ""]))


def judged(shape, audit):
    """Cost and whether some choice of new roles gives a valid order."""
    cost, i, forms = 0, 0, [""]
    for e in audit:
        if e == "I":
            cost += 3
            forms = [f + r for f in forms for r in "ua"]
            continue
        c, i = shape[i], i + 1
        cost += 4 if e == "D" else (3 if c.isupper() else 0) + (3 if e == "R" else 0)
        if e == "K":
            forms = [f + c.lower() for f in forms]
        elif e == "R":
            forms = [f + r for f in forms for r in "ua"]
    return cost, any(VALID.match(f) for f in forms)


def brute(shape):
    found = ((cost, audit) for audit in every_audit(shape) for cost, ok in [judged(shape, audit)] if ok)
    return min(found)


def table_search(shape):
    """Cost and audit from a forward table over rows and states."""
    keep = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}
    after = {0: 2, 1: 2, 2: 3, 3: 2}
    best = {0: (0, "")}

    def add(into, state, way):
        if state not in into or way < into[state]:
            into[state] = way

    def with_inserts(ways):
        out = dict(ways)
        for _ in range(3):
            for s, (cost, audit) in list(out.items()):
                add(out, after[s], (cost + 3, audit + "I"))
        return out

    for c in shape:
        new = {}
        for s, (cost, audit) in with_inserts(best).items():
            add(new, s, (cost + 4, audit + "D"))
            extra = 3 if c.isupper() else 0
            if c != "x":
                add(new, after[s], (cost + 3 + extra, audit + "R"))
                if (c.lower(), s) in keep:
                    add(new, keep[c.lower(), s], (cost + extra, audit + "K"))
        best = new
    return min(w for s, w in with_inserts(best).items() if s in (0, 3))


def test_search_equals_brute_force():
    for n in range(4):
        for shape in itertools.product("suaoxUSA", repeat=n) if n < 3 else random.Random(1).sample(
                list(itertools.product("suaoxUSA", repeat=3)), 40):
            assert C.cheapest_edits("".join(shape)) == brute("".join(shape)) == table_search("".join(shape)), shape


def test_search_of_long_shapes():
    rng = random.Random(2)
    for _ in range(2000):
        shape = "".join(rng.choice(rng.choice(["uaUA", "suaoxSUAO", "uax", "us"])) for _ in range(rng.randint(3, 14)))
        assert C.cheapest_edits(shape) == table_search(shape), shape
    for n in (8, 20, 64, 64, 64):
        shape = "".join(rng.choice("suaoxUSAO" if n % 3 else "uaUAx") for _ in range(n))
        assert C.cheapest_edits(shape) == table_search(shape), shape
        cells = [(0, 0, 0, "")]
        for i in range(0, n, 5):
            cells = C.joined_cells(cells, C.cells_of(shape[i:i + 5], False))
        closed = min((cost + C._CLOSING[b][0], audit + C._CLOSING[b][1]) for a, b, cost, audit in cells if a == 0)
        assert closed == table_search(shape), shape


def plain(rows):
    """The summary of every conversation, row by row."""
    out = []
    for conv in {r[0] for r in rows}:
        kept = []
        for _, turn, role, text in (r for r in rows if r[0] == conv):
            name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            fault = zlib.crc32(name.encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            text = "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text
            kept += [(turn, "user" if fault == 4 else role, text)] * (0 if fault == 0 else 2 if fault == 3 else 1)
        kept.sort(key=lambda r: (r[0] is not None, r[0] or 0,
                                 hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, shape, counts = set(), "", [0, 0, 0]
        for turn, role, text in kept:
            last = text.strip(SPACE)[-1:]
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            if not last:
                counts[0], letter = counts[0] + 1, "x"
            elif (role, text) in seen:
                counts[1], letter = counts[1] + 1, "x"
            elif last not in ".!?":
                counts[2], letter = counts[2] + 1, letter.upper()
            seen.add((role, text))
            shape += letter
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(kept, kept[1:]))
        turns = {r[0] for r in kept} - {None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        cost, audit = table_search(shape)
        lines, i = [], 0
        for e in audit:
            expected = "assistant" if lines and lines[-1][0][0] == "u" else "user"
            if e == "I":
                lines.append((expected, ""))
                continue
            _, role, text = kept[i]
            i += 1
            if e != "D":
                lines.append((role if e == "K" else expected, text))
        digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
        out.append((conv, gaps, *counts, illegal, cost, audit, digest))
    return sorted(out, key=repr)


def rows_of():
    rng = random.Random(4)
    texts = ["Fine.", "Fine.", "cut off", "", None, " \t\n", "Ends here! \n", "ünder 中?", "x" * 100_000 + ".", " a b"]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "User"]
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, None, -turn]), rng.choice(roles), rng.choice(texts) and rng.choice(texts)))
    rows += [(None, t, rng.choice(["user", "assistant"]), f"Turn {t % 40}.") for t in range(200)]      # a long one
    rows += [(99, None, "user", None), (99, None, None, "."), (99, None, "user", None)]
    rows += [rows[3], rows[3], rows[8]]
    # a conversation that loses its only row
    lost = next(i for i in range(1000, 2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    return rows + [(lost, 0, "user", "Gone.")]


NAMES = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def collected(df):
    return sorted((tuple(r[c] for c in NAMES) for r in df.collect()), key=repr)


def test_registered_query(spark, tmp_path):
    rows = rows_of()
    spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], ROWS).repartition(5).write.parquet(f"{tmp_path}/conversations.parquet")
    assert collected(C.op12_repair(spark, str(tmp_path))) == plain(rows)


def test_segments_give_the_same_and_rows_are_repaired(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK", 2)
    rows = [r for r in rows_of() if r[3] is None or len(r[3]) < 1000]
    docs = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], ROWS)
    whole, cut = C.repair(docs), C.repair(docs, segment=3)
    facts = [sorted((tuple(r) for r in f.facts.collect()), key=repr) for f in (whole, cut)]
    assert facts[0] == facts[1]
    lines = {}
    for r in sorted(C.repaired_rows(cut).collect(), key=lambda r: (r["key"], r["place"])):
        lines.setdefault(r["key"], []).append((r["role"], r["text"]))
    sums = {r["key"]: r["sum"] for r in C.repaired_digests(cut).collect()}
    assert len(sums) == cut.facts.count() and lines.keys() <= sums.keys()
    for key, value in sums.items():
        own = lines.get(key, [])
        assert VALID.match("".join(role[0] for role, _ in own))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for r, t in own).encode()).hexdigest() == value


def test_empty_table(spark):
    none = spark.createDataFrame([], ROWS)
    assert C.repaired_summary(none).count() == 0 and C.repair(none).facts.count() == 0
