"""Conversation repair against a plain search over all edits, and its SQL twin."""

import hashlib
import random
import re
import zlib

from fleetpulse.llm import conversation_blocks as blocks

SPACE = " \t\n\x0b\x0c\r"


def damage(rows):
    made = []
    for conv_id, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = ":".join(" " if v is None else str(v) for v in (conv_id, turn))
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        made += [(conv_id, turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return made


def cheapest(rows):
    """Edits and repaired rows by a plain search from the end: no tables, no blocks."""
    # state -> (cost, edits, lines), each the least; states are the initials so far.
    following = {"": "u", "s": "u", "u": "a", "a": "u"}
    names = {"u": "user", "a": "assistant"}

    def inserted(best):
        for _ in range(3):
            for state, role in following.items():
                cost, edits, lines = best[role]
                best[state] = min(best[state], (cost + 3, "I" + edits, [f"{names[role]}:", *lines]))
        return best

    far = (10**9, "", [])
    best = inserted({"": (0, "", []), "a": (0, "", []), "s": far, "u": far})
    for role, text, fault in reversed(rows):
        before = {}
        for state in following:
            options = [(best[state][0] + 4, "D" + best[state][1], best[state][2])]
            if fault not in ("blank", "duplicate"):
                more = 3 * (fault == "truncated")
                if (state, role[:1]) in (("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")):
                    cost, edits, lines = best[role[:1]]
                    options.append((cost + more, "K" + edits, [f"{role}:{text}", *lines]))
                new = following[state]
                cost, edits, lines = best[new]
                options.append((cost + more + 3, "R" + edits, [f"{names[new]}:{text}", *lines]))
            before[state] = min(options)
        best = inserted(before)
    return best[""]


def expected(rows):
    found = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in damage(rows):
        found[conv].append((turn, role, text))
    made = []
    for conv, held in found.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in held:
            said = text.strip(SPACE)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else ""
            fault = fault or ("" if said[-1] in ".!?" else "truncated")
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, *_ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = zip(marked, marked[1:], strict=False)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in pairs)
        cost, audit, lines = cheapest(marked)
        counts = [sum(m[2] == name for m in marked) for name in ("blank", "duplicate", "truncated")]
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        made.append((conv, gaps, *counts, illegal, cost, audit, sha))
    return sorted(made, key=repr)


def table(spark, rows):
    wide = [(*row, "x", 1) for row in rows]
    schema = "conv_id long, turn long, role string, text string, marks string, part int"
    return spark.createDataFrame(wide, schema).repartition(3)


def conversations(seed, n):
    pick = random.Random(seed)
    texts = ["Yes.", "No", " ", "", "Why?", "More…", "A much longer line of text!", None, "x\n", "ok. \t"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "ux"]
    rows = []
    for conv in range(n):
        length = pick.choice([1, 2, 3, 5, 8, 13, 30])
        for turn in range(length):
            shown = pick.choice([turn, turn, turn, turn + 3, None, turn // 2])
            rows.append((conv if conv else None, shown, pick.choice(roles), pick.choice(texts)))
    return rows


def report(spark, rows, **sizes):
    df = blocks.repair_report(blocks.damaged(table(spark, rows)), **sizes)
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_random_conversations_equal_a_plain_search(spark):
    rows = conversations(1, 120)
    assert report(spark, rows) == expected(rows)


def test_pieces_of_two_rows_give_the_same(spark):
    rows = conversations(2, 40) + [(1000, t, "user" if t % 2 else "assistant", f"t{t % 7}.") for t in range(400)]
    assert report(spark, rows, most_rows=2) == expected(rows)


def test_only_dropped_empty_and_extreme_rows(spark):
    dropped = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "gone."), (5, None, None, None), (6, 2**63 - 1, "user", "a."),
            (6, -(2**63), "user", "b."), (7, 1, "system", "word " * 200_000)]
    assert report(spark, rows)[0][0] in (5, 6, 7, dropped)
    found = {row[0]: row for row in report(spark, rows)}
    wanted = {row[0]: row for row in expected(rows)}
    assert found[dropped] == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert found[6][1] == 2**63 - 1 and found[6][2:] == wanted[6][2:]
    assert found[7] == wanted[7] and found[5] == wanted[5]
    assert report(spark, []) == []


def test_repaired_turns_follow_the_grammar(spark):
    rows = conversations(3, 30)
    turns = blocks.repaired_turns(blocks.damaged(table(spark, rows))).collect()
    found = {}
    for row in sorted(turns, key=lambda r: (r.part, r.no, r.place)):
        found[row.conv_id] = found.get(row.conv_id, "") + row.role[:1]
    assert found and all(re.fullmatch("(s?(ua)+)?", line) for line in found.values())


def test_tables_are_small_and_blocks_agree_with_single_steps():
    made = blocks.Tables()
    assert len(made.vectors) < 100
    for code in [(0, 1, 2, 8), (4, 5, 6, 7), (3, 3, 3, 3), (8, 8, 1, 2)]:
        for vector in range(len(made.vectors)):
            single = vector
            for symbol in reversed(code):
                single = made.one[single, symbol]
            assert made.step(vector, code) == single


def test_sql_twin_on_random_conversations(spark):
    import duckdb
    import pyarrow as pa

    rows = conversations(4, 60)
    columns = [list(c) for c in zip(*rows, strict=True)]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
    names = ["conv_id", "turn", "role", "text"]
    held = pa.table([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)
    engine = duckdb.connect()
    engine.register("conversations", held)
    found = sorted((tuple(r) for r in engine.sql(blocks.sql()).fetchall()), key=repr)
    assert found == expected(rows)
