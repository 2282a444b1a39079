import hashlib
import random
import zlib

import pytest

from lexigrain.llm import turn_repair as tr

WHITE = " \t\n\x0b\x0c\r"
PROBE = [None, "", " ", "user", "assistant", "system", "tool", "under", "User"]


def cheapest(symbols):
    """(cost, audit) by dynamic programming backwards, equal costs by their strings."""
    best = {tr.START: (0, ""), tr.SYSTEM: (6, "II"), tr.USER: (3, "I"), tr.ASSISTANT: (0, "")}
    for symbol in reversed(symbols):
        options = {s: [] for s in range(4)}
        for s in range(4):
            expected = "uuau"[s]
            options[s].append((4 + best[s][0], "D" + best[s][1]))
            if symbol == "x":
                continue
            extra, kind = 3 * symbol.isupper(), symbol.lower()
            after = tr.ASSISTANT if expected == "a" else tr.USER
            options[s].append((3 + extra + best[after][0], "R" + best[after][1]))
            if kind == expected:
                options[s].append((extra + best[after][0], "K" + best[after][1]))
            if kind == "s" and s == tr.START:
                options[s].append((extra + best[tr.SYSTEM][0], "K" + best[tr.SYSTEM][1]))
        now = {s: min(options[s]) for s in range(4)}
        for _ in range(6):  # insertions before the row
            for s in range(4):
                after = tr.ASSISTANT if "uuau"[s] == "a" else tr.USER
                now[s] = min(now[s], (3 + now[after][0], "I" + now[after][1]))
        best = now
    return best[tr.START]


def expected_row(rows):
    """The digest row of one conversation's damaged rows, in order."""
    seen, faults = set(), []
    for _, role, text in rows:
        if not text.strip(WHITE):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("duplicate")
        elif text.rstrip(WHITE)[-1] not in ".!?":
            faults.append("truncated")
        else:
            faults.append(None)
        seen.add((role, text))
    symbols = ""
    for (_, role, _), wrong in zip(rows, faults, strict=True):
        kind = role[:1] if role[:1] in ("s", "u", "a") else "o"
        symbols += "x" if wrong in ("blank", "duplicate") else (
            kind.upper() if wrong else kind)
    cost, audit = cheapest(symbols)
    lines, state, at = [], "start", 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K" and state == "start" and rows[at][1][:1] == "s":
            state = "s"
        else:
            state = "a" if state == "u" else "u"
        role = rows[at][1] if edit == "K" else {"u": "user", "a": "assistant"}[state]
        lines.append(f"{role}:{'' if edit == 'I' else rows[at][2]}")
        at += edit != "I"
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def expected_table(rows):
    """Damage and repair of (conv_id, turn, role, text) by plain loops."""
    convs = {}
    for conv, turn, role, text in rows:
        out = convs.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
                          .encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else text
        text = "".join(c for c in text if c not in ".!?") if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return {c: expected_row(sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])))
            for c, out in convs.items()}


def assert_repaired(spark, rows, chunk=tr.CHUNK, partitions=8):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(
            [(*r, "clash", "clash", 7) for r in rows],
            "conv_id long, turn long, role string, text string, edits string, range string, "
            "copies long").repartition(partitions)
        pieces = tr.repair(tr.damage(df), copies="copies", chunk=chunk)
        got = {r.conv_id: tuple(r)[1:] for r in tr.summarise(pieces).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == expected_table(rows)


def test_search_is_the_cheapest_and_least_path():
    rng = random.Random(2)
    for size in [0, 1, 2, 3, 4, 5, 8, 13, 40]:
        for _ in range(120):
            symbols = "".join(rng.choice(tr.SYMBOLS + "uaua") for _ in range(size))
            cost, path, state = tr.search(symbols)
            assert (cost, path + tr.TAILS[state]) == cheapest(symbols), symbols


@pytest.mark.parametrize("symbols", ["u" * 256, "U" * 256, "uaa" * 85, "sS" * 128, "o" * 256,
                                     "x" * 256, "ua" * 128, "UuAaoxs" * 36])
def test_search_of_whole_chunks(symbols):
    cost, path, state = tr.search(symbols)
    assert (cost, path + tr.TAILS[state]) == cheapest(symbols)


def conversation(rng, conv, turns):
    rows = []
    for turn in range(turns):
        role = rng.choice(PROBE) if rng.random() < .3 else ("user", "assistant")[turn % 2]
        said = rng.choice(["", " \t", "so.", "yes!", "why? ", "no", None, "é漢🙂.", "x\x0b."])
        number = None if rng.random() < .1 else turn + rng.randint(0, 1)
        rows.append((conv, number, role, said if rng.random() < .5 else f"{turn} words."))
    return rows


def test_repair_of_damaged_conversations(spark):
    rng = random.Random(4)
    rows = [r for conv in [None, *range(-20, 120)]
            for r in conversation(rng, conv, rng.choice([1, 1, 2, 5, 8, 30]))]
    rows += rows[::7]
    assert_repaired(spark, rows)


def test_long_conversations_go_over_chunks_and_ranges(spark):
    rng = random.Random(5)
    rows = conversation(rng, 7, 900) + conversation(rng, 3, 40) + conversation(rng, None, 300)
    rows += [(9, 4, "user", "the same.")] * 600 + [(9, t, "user", "again.") for t in range(300)]
    for chunk in (1, 7, 256):
        assert_repaired(spark, rows, chunk=chunk)


def test_conversations_that_lose_all_rows_and_empty_tables(spark):
    gone = [c for c in range(400) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    assert len(gone) > 5
    rows = [(c, 0, "user", "hello.") for c in gone] + [(-1, 0, "user", "x" * 3_000_000 + ".")]
    assert_repaired(spark, rows)
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tr.summarise(tr.repair(empty)).count() == 0


def test_repaired_turns_alternate(spark):
    df = spark.createDataFrame([(1, 0, "system", "be brief."), (1, 1, "assistant", "so."),
                                (1, 2, "assistant", "cut off"), (2, 0, "user", "hm?")],
                               "conv_id string, turn int, role string, text string")
    rows = {r.conv_id: r for r in tr.repair(df).collect()}
    assert (rows["1"].roles, rows["1"].texts, rows["1"].edits) == (
        ["system", "user", "assistant"], ["be brief.", "so.", "cut off"], "KRK")
    assert (rows["2"].roles, rows["2"].texts) == (["user", "assistant"], ["hm?", ""])
