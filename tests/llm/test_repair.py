"""Conversation repair against brute force over all edits."""

import hashlib
import random
import re
import zlib

import pytest

from tableslice.llm import repair

COLUMNS = "conv_id long, turn long, role string, text string"


def cheapest(rows):
    """Least (cost, letters, repaired lines) by trying every edit; rows are role, text, fault."""
    give = {"": "user", "s": "user", "u": "assistant", "a": "user"}
    after = {"user": "u", "assistant": "a"}
    known = {}

    def best(i, last, inserts):
        key = (i, last, inserts)
        if key in known:
            return known[key]
        ways = []
        if i == len(rows):
            if last in ("", "a"):
                ways.append((0, "", []))
        else:
            role, text, fault = rows[i]
            more = fault == "truncated"
            ways += [(3 + c, "D" + e, lines) for c, e, lines in best(i + 1, last, 0)]
            if fault not in ("blank", "duplicate"):
                x = role[:1]
                if x and re.fullmatch("s|u|su|au|ua", last + x):
                    ways += [(more + c, "K" + e, [f"{role}:{text}", *rest]) for c, e, rest in best(i + 1, x, 0)]
                new = give[last]
                ways += [(2 + more + c, "R" + e, [f"{new}:{text}", *rest]) for c, e, rest in best(i + 1, after[new], 0)]
        if inserts < 3:
            new = give[last]
            ways += [(2 + c, "I" + e, [f"{new}:", *rest]) for c, e, rest in best(i, after[new], inserts + 1)]
        known[key] = [min(ways)] if ways else []
        return known[key]

    return best(0, "", 0)[0]


def expected(table):
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in (r for r in table if r[0] == conv):
            role, text = role if role is not None else " ", text if text is not None else " "
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            kind = zlib.crc32(key.encode()) % 20
            if kind == 1:
                text = ""
            if kind == 2:
                text = re.sub("[.!?]", "", text)
            if kind == 4:
                role = "user"
            rows += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, marked = set(), []
        for _, role, text in rows:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = ("blank" if not said else "duplicate" if (role, text) in seen
                     else "truncated" if said[-1] not in ".!?" else "")
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = {t for t, _, _ in rows if t is not None}
        cost, audit, lines = cheapest(marked)
        x = [r[0][:1] for r in marked]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(turns) if turns else 0,
            *(sum(f == k for _, _, f in marked) for k in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(x, x[1:])),
            cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return out


def found(df):
    names = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    rows = df.collect()
    assert len({r["conv_id"] for r in rows}) == len(rows)
    return {r["conv_id"]: tuple(r[n] for n in names) for r in rows}


def conversations(seed, convs, length):
    pick = random.Random(seed)
    texts = ["Yes.", "No!", "So?", "well", "", " \t", "Then.\n", "a b c", "ünd.", None, "Why? because"]
    roles = ["user", "assistant", "system", "tool", "user", "assistant", None, "", "a", "u2"]
    return [
        (c if c % 7 else None, pick.choice([t, t, t, t + 3, None]), pick.choice(roles), pick.choice(texts))
        for c in range(convs) for t in range(pick.randrange(length))
    ]


@pytest.mark.parametrize("chunk", [10_000, 7])
def test_repairs_like_brute_force(spark, spread, monkeypatch, chunk):
    """Also where conversations go on over many chunks."""
    monkeypatch.setattr(repair, "CHUNK", chunk)
    table = conversations(1, 60, 14) + conversations(2, 1, 90) + [(500, t, "user", f"{t % 5}.") for t in range(60)]
    df = spark.createDataFrame(table, COLUMNS).repartition(3)
    assert found(repair.repair_digests(df)) == expected(table)


def test_blocks_agree_with_single_symbols():
    pick = random.Random(3)
    one, three = repair.BlockTables(1), repair.BlockTables(3)
    for _ in range(300):
        symbols = [pick.randrange(repair.SYMBOLS) for _ in range(pick.randrange(20))]
        for q in range(5):
            assert one.in_front(symbols, q) == three.in_front(symbols, q)
        assert one.edits(symbols, one.end, [0, 2]) == three.edits(symbols, three.end, [0, 2])


def test_edges(spark):
    assert repair.repair_digests(spark.createDataFrame([], COLUMNS)).count() == 0
    # Every row of conversation 7 is dropped; one of 8 is a megabyte and ends in blanks.
    gone = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    kept = [t for t in range(1000) if zlib.crc32(f"8:{t}".encode()) % 20 > 4]
    table = [(7, gone, "user", "Hi."), (8, kept[0], "user", "x " * 500_000 + "." + " " * 9), (8, kept[1], "assistant", "Yes.")]
    df = spark.createDataFrame(table, COLUMNS).selectExpr(
        "*", "1 AS row", "'x' AS fault", "'y' AS edits", "0 AS chunk", "turn AS kind", "2 AS __tie")
    got = found(repair.repair_digests(df))
    assert got == expected(table)
    assert got[7] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got[8][6] == "KK"
