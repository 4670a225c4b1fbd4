import hashlib
import itertools
import random

import duckdb
import pytest

from linewell.llm import conversation_repair as cr
from linewell.llm.common import session

SCHEMA = "conv_id long, turn long, role string, text string, start int, conv map<string,string>"


def brute(symbols):
    """Least (cost, audit) by trying row after row on all places, insertions one at a time."""
    def grow(found):
        out = dict(found)
        for _ in range(4):
            for place, (cost, audit) in list(out.items()):
                for (p, role), q in cr.STEPS.items():
                    if p == place and role in "ua":
                        new = (cost + 2, audit + "I")
                        out[q] = min(out.get(q, new), new)
        return out

    state = grow({0: (0, "")})
    for s in symbols:
        nxt = {}
        for place, (cost, audit) in state.items():
            ways = [(place, cost + 3, audit + "D")]
            if s.isalpha():
                for (p, role), q in cr.STEPS.items():
                    if p == place:
                        if role == s.lower():
                            ways.append((q, cost + s.isupper(), audit + "K"))
                        if role in "ua":
                            ways.append((q, cost + 2 + s.isupper(), audit + "R"))
            for q, c, a in ways:
                nxt[q] = min(nxt.get(q, (c, a)), (c, a))
        state = grow(nxt)
    return min(v for p, v in state.items() if p in (0, 3))


def every_cut(symbols):
    """The cells of all spans from all of their cuts."""
    n = len(symbols)
    cells = {(i, i + 1): cr.leaf(s) for i, s in enumerate(symbols)}
    for size in range(2, n + 1):
        for i in range(n - size + 1):
            best = [None] * len(cr.PAIRS)
            for k in range(i + 1, i + size):
                for at, c in enumerate(cr.combine(cells[i, k], cells[k, i + size])):
                    if c is not None and (best[at] is None or c < best[at]):
                        best[at] = c
            cells[i, i + size] = tuple(best)
    return cells[0, n]


def test_all_short_sequences_equal_the_row_by_row_search():
    for n in range(1, 4):
        for symbols in itertools.product("suaoSUAO0", repeat=n):
            assert cr.verdict(cr.parse("".join(symbols))) == brute("".join(symbols))


def test_one_cut_per_span_equals_all_cuts():
    rng = random.Random(3)
    for _ in range(60):
        symbols = "".join(rng.choice("suaoSUA0123uaua") for _ in range(rng.randrange(1, 14)))
        assert cr.parse(symbols) == every_cut(symbols)
        assert cr.verdict(cr.parse(symbols)) == brute(symbols)


def test_repaired_roles_are_sentences():
    rng = random.Random(5)
    for _ in range(200):
        symbols = "".join(rng.choice("suaoSUA01uaua") for _ in range(rng.randrange(1, 30)))
        roles = ""
        for (before, edit, role, after), s in zip(cr.edits_of(cr.verdict(cr.parse(symbols))[1]), symbols):
            roles += before + {"K": s.lower(), "R": (role or "")[:1], "D": ""}[edit] + after
        tail = roles.removeprefix("s")
        assert tail == "ua" * (len(tail) // 2) and (roles == "" or tail), (symbols, roles)


def frame(spark, rows):
    return session(spark).createDataFrame([(*r, 7, {"a": "b"}) for r in rows], SCHEMA)


def oracle(rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    cur = con.execute(cr.ORACLE_SQL)
    names = [d[0] for d in cur.description]
    return sorted([tuple(r[names.index(c)] for c in COLUMNS) for r in cur.fetchall()], key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def got(df):
    return sorted([tuple(r) for r in df.select(*COLUMNS).collect()], key=repr)


def test_damage_with_nulls_ties_and_odd_roles(spark):
    rng = random.Random(11)
    texts = ["Yes.", "no", "", " \t", None, "What?", "Ünïcode!", "Yes. ", "a.b", "x" * 200_000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    rows = [(c if c else None, None if t == 5 else t, rng.choice(roles[:2] * 3 + roles), rng.choice(texts)) for c in range(40) for t in rng.sample(range(12), rng.randrange(1, 10))]
    assert got(cr.repair_damaged(frame(spark, rows))) == oracle(rows)


def test_conversation_without_rows_and_empty_table(spark):
    gone = next(c for c in range(1000) if __import__("zlib").crc32(f"{c}:0".encode()) % 20 == 0)
    assert got(cr.repair_damaged(frame(spark, [(gone, 0, "user", "Hi.")]))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert got(cr.repair_damaged(frame(spark, []))) == []


@pytest.mark.parametrize("span,fan", [(256, 64), (4, 2)])
def test_a_long_conversation_in_blocks(spark, span, fan):
    """One conversation with most rows, many of them equal; blocks of four rows need several rounds."""
    rng = random.Random(17)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "assistant", "system"]), rng.choice(["Same.", "Same.", f"Own {t}.", f"open {t}"])) for t in range(300)]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}.") for c in range(2, 40) for t in range(4)]
    conv = frame(spark, rows)
    assert got(cr.repair(cr.damaged(conv), conv.select("conv_id"), span, fan)) == oracle(rows)
