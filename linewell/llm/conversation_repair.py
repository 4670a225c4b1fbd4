"""Conversation structure repair: weighted interval parsing in the manner of CYK.

The grammar's sentences are the role sequences ``(s?(ua)+)?``. In Chomsky normal form it has a nonterminal for each pair of places
of that expression: (p, q) derives whatever leads from place p to place q, by the rules (p, q) -> (p, r) (r, q) over two
neighbouring spans, and over a single row by one edit of it, with insertions before and after it (the insertion closure).
A cell holds the least (cost, audit) of one nonterminal over one span. Cells are combined bottom-up by span length: one row,
2, 4, ... rows inside a block, then blocks of blocks in Spark. As the grammar has a nonterminal for every pair of places, each
derivation passes some place at every cut, so one cut per span finds the same least cells as all cuts would.

Audits of the same rows and the same cost never are proper prefixes of each other (the longer one would hold dearer insertions), so the
ASCII-least whole is put together from ASCII-least parts.
"""
from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.functions.joins import lookup, materialise
from linewell.llm.common import bucket_of, slices
from linewell.operators.order import with_positions

SPAN = 256  # rows of a block that one task parses at once
FAN = 64    # spans that one task joins to the next longer one
KEEP, REROLE, DELETE, INSERT = "KRDI"
COST = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}
TRUNCATED = 1  # on top, for a truncated row that stays

# places in (s?(ua)+)?: 0 nothing yet, 1 after s, 2 after u, 3 after a; a sentence ends at 0 or 3
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
PAIRS = ((0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3))
RULES = tuple((PAIRS.index((p, q)), PAIRS.index((p, r)), PAIRS.index((r2, q))) for p, q in PAIRS for p2, r in PAIRS for r2, q2 in PAIRS if p2 == p and r2 == r and q2 == q)

Cell = tuple[int, str]
Cells = tuple[Cell | None, ...]


def least(found: list[tuple[int, int, str]]) -> Cells:
    best: list[Cell | None] = [None] * len(PAIRS)
    for at, cost, audit in found:
        if best[at] is None or (cost, audit) < best[at]:
            best[at] = (cost, audit)
    return tuple(best)


def combine(left: Cells, right: Cells) -> Cells:
    """Cells of two neighbouring spans joined by the binary rules."""
    best: list[Cell | None] = [None] * len(PAIRS)
    for at, l, r in RULES:
        a, b = left[l], right[r]
        if a is None or b is None:
            continue
        cost, old = a[0] + b[0], best[at]
        if old is None or cost < old[0]:
            best[at] = (cost, a[1] + b[1])
        elif cost == old[0] and (audit := a[1] + b[1]) < old[1]:
            best[at] = (cost, audit)
    return tuple(best)


def closure() -> Cells:
    """What insertions alone derive between rows: every number of them up to the places of the grammar."""
    none = [(PAIRS.index((p, p)), 0, "") for p in range(4)]
    one = [(PAIRS.index((p, q)), COST[INSERT], INSERT) for (p, role), q in STEPS.items() if role in "ua"]
    cells = least(none + one)
    for _ in PAIRS:
        cells = combine(cells, cells)
    return cells


INSERTIONS = closure()


@lru_cache(maxsize=64)
def leaf(symbol: str) -> Cells:
    """Cells of one row. A symbol is the role's initial (s, u, a, else o) in lower case for a sound row, in upper case for
    a truncated one, and as the digit of its place in "suao" for a row that has to go."""
    found = [(PAIRS.index((p, p)), COST[DELETE], DELETE) for p in range(4)]
    if symbol.isalpha():
        extra = TRUNCATED if symbol.isupper() else 0
        for (p, role), q in STEPS.items():
            if role == symbol.lower():
                found.append((PAIRS.index((p, q)), COST[KEEP] + extra, KEEP))
            if role in "ua":
                found.append((PAIRS.index((p, q)), COST[REROLE] + extra, REROLE))
    return combine(combine(INSERTIONS, least(found)), INSERTIONS)


def upward(level: list[Cells]) -> Cells:
    """Joins neighbours, spans of one length after the other, until one span is left."""
    if not level:
        return INSERTIONS
    while len(level) > 1:
        level = [combine(*level[i:i + 2]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def parse(symbols: str) -> Cells:
    return upward([leaf(s) for s in symbols])


def verdict(cells: Cells) -> Cell:
    """The least cell of a whole conversation."""
    return min(c for p, c in zip(PAIRS, cells) if p[0] == 0 and p[1] in ENDS and c is not None)


def edits_of(audit: str) -> Iterator[tuple[str, str, str | None, str]]:
    """Per row: roles inserted before it, its own edit, its new role where it is reroled, roles inserted after the last row.

    The number of rows that a sentence keeps tells its roles: an odd number starts with s, which is always kept.
    """
    length = len(audit) - audit.count(DELETE)
    place, before, row = -(length % 2), "", None
    for e in audit:
        role = "user" if place % 2 == 0 else "assistant"
        if e == INSERT:
            before += role[0]
        else:
            if row is not None:
                yield row
            row, before = (before, e, role if e == REROLE else None, ""), ""
        if e != DELETE:
            place += 1
    if row is not None:
        yield (*row[:3], before)


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows (conv_id, turn, role, text) after planted faults; nulls count as one space, in the hashed key too.

    crc32 of ``conv:turn`` modulo 20: 0 drops the row, 1 empties its text, 2 takes its ``.!?`` out, 3 repeats it, 4 makes
    its role user. An empty table gives no rows; other columns aren't read.
    """
    key = F.concat(F.coalesce(F.col(conv_col).cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col(turn_col).cast("string"), F.lit(" ")))
    base = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                       F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), key.alias("key")).select("*", bucket_of("key", 20).alias("fault")).filter("fault <> 0")
    text = F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))
    return base.select("conv_id", "turn", F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("n")).drop("n")


SOLID = r"[^\x20\x09-\x0D]"


def ordered(rows: DataFrame) -> DataFrame:
    """The rows with ``at``, their position over all conversations, and what the parse needs to know of their texts."""
    facts = rows.select(
        "*", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256).alias("digest"),
        (~F.col("text").rlike(SOLID)).alias("is_blank"), (~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("is_open"),
        F.coalesce(F.nullif(F.instr(F.lit("sua"), F.substring("role", 1, 1)) * F.length(F.substring("role", 1, 1)), F.lit(0)), F.lit(4)).alias("initial"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.substring("role", 1, 16).asc(), F.substring("text", 1, 64).asc(), F.col("digest").asc()]
    return with_positions(facts, order, "at")


def marked(placed: DataFrame) -> DataFrame:
    """(conv, start, rows, at, rank, fault, symbol) of each row: its conversation with the first position and the rows of that, its
    rank there, its first fault or null, and its symbol for the parse.

    A conversation is never brought together: the first of equal rows comes from an aggregate with map-side combine and is joined by
    position, and the positions that a conversation spans come from another. ``conv`` holds the id in a struct, so that null ids meet too.
    """
    firsts = placed.filter("NOT is_blank").groupBy("conv_id", "digest").agg(F.min("at").alias("at")).select("at", F.lit(True).alias("is_first"))
    convs = placed.groupBy(F.struct("conv_id").alias("conv")).agg(F.min("at").alias("start"), F.count(F.lit(1)).alias("rows"))
    fault = F.when(F.col("is_blank"), "blank").when(F.col("is_first").isNull(), "duplicate").when(F.col("is_open"), "truncated")
    rows = placed.select(F.struct("conv_id").alias("conv"), "at", "is_blank", "is_open", "initial").join(firsts, "at", "left").select("conv", "at", "initial", fault.alias("fault"))
    alphabet = F.when(F.col("fault").isin("blank", "duplicate"), "0123").when(F.col("fault") == "truncated", "SUAO").otherwise("suao")
    return lookup(rows, convs, ["conv"], "inner").select("conv", "start", "rows", "at", (F.col("at") - F.col("start")).alias("rank"), "fault", F.substr(alphabet, F.col("initial"), F.lit(1)).alias("symbol"))


CELLS = "array<struct<cost:bigint,audit:string>>"
SPAN_FIELDS = ("first", "last", "illegal", "cells")
SPAN_TYPE = f"first string, last string, illegal bigint, cells {CELLS}"
LEGAL = {"su", "ua", "au"}


def initials(symbols: str) -> str:
    return symbols.lower().translate(str.maketrans("0123", "suao"))


def encode(cells: Cells) -> list[dict | None]:
    return [None if c is None else {"cost": c[0], "audit": c[1]} for c in cells]


def decode(cells: list[dict | None]) -> Cells:
    return tuple(None if c is None else (c["cost"], c["audit"]) for c in cells)


@lru_cache(maxsize=4096)
def span_of(symbols: str) -> dict:
    """First and last initial, illegal neighbours and cells of a block."""
    roles = initials(symbols)
    return {"first": roles[0], "last": roles[-1], "illegal": sum(a + b not in LEGAL for a, b in zip(roles, roles[1:])), "cells": encode(parse(symbols))}


def span_over(parts: list[dict]) -> dict:
    """The same of neighbouring spans, in order."""
    seams = sum(a["last"] + b["first"] not in LEGAL for a, b in zip(parts, parts[1:]))
    return {"first": parts[0]["first"], "last": parts[-1]["last"], "illegal": seams + sum(p["illegal"] for p in parts),
            "cells": encode(upward([decode(p["cells"]) for p in parts]))}


def spans(level: DataFrame, of) -> DataFrame:
    """Replaces the last column, what lies in a span, by the span's fields."""
    kept = level.schema[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [of(x) for x in batch.column(len(kept)).to_pylist()]
            types = (pa.string(), pa.string(), pa.int64(), pa.list_(pa.struct([("cost", pa.int64()), ("audit", pa.string())])))
            columns = [pa.array([m[f] for m in made], t) for f, t in zip(SPAN_FIELDS, types)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*kept.names, *SPAN_FIELDS])

    return level.mapInArrow(run, ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + [SPAN_TYPE]))


def parsed(rows: DataFrame, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """(conv, start, blank, duplicate, truncated, illegal, cost, audit) per conversation of ``marked`` rows.

    Blocks of ``span`` rows are parsed first, then ``fan`` neighbouring spans are joined to one; only conversations that are longer than
    a span go on, so the number of rounds is a logarithm of the longest one.
    """
    keys = ["conv", "start", "rows"]
    faults = ["blank", "duplicate", "truncated"]
    blocks = rows.groupBy(*keys, F.floor(F.col("rank") / span).alias("block")).agg(
        *[F.count_if(F.col("fault") == f).alias(f) for f in faults],
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "symbol"))), lambda x: x["symbol"]), "").alias("symbols"))
    level, out = materialise(spans(blocks, span_of), "spans"), []
    longest = level.agg(F.max("rows")).first()[0] or 0
    while True:
        out.append(level.filter(F.col("rows") <= span))
        if longest <= span:
            break
        span *= fan
        wider = level.filter(F.col("rows") > span // fan).groupBy(*keys, F.floor(F.col("block") / fan).alias("block")).agg(
            *[F.sum(f).alias(f) for f in faults],
            F.transform(F.array_sort(F.collect_list(F.struct("block", *SPAN_FIELDS))), lambda x: F.struct(*[x[f].alias(f) for f in SPAN_FIELDS])).alias("parts"))
        level = materialise(spans(wider, span_over), "spans")
    roots = out[0]
    for one in out[1:]:
        roots = roots.unionByName(one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best = [verdict(decode(c)) for c in batch.column(6).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array([b[0] for b in best], pa.int64()), pa.array([b[1] for b in best], pa.string())],
                                             ["conv", "start", *faults, "illegal", "cost", "audit"])

    roots = roots.select("conv", "start", *faults, "illegal", "cells")
    return roots.mapInArrow(run, f"conv {roots.schema['conv'].dataType.simpleString()}, start bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string")


BATCH = 1 << 16


def edits(roots: DataFrame) -> DataFrame:
    """(start, at, before, edit, role, after) of each row, from the audits."""
    names = ["start", "at", "before", "edit", "role", "after"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for start, audit in zip(*(c.to_pylist() for c in batch.columns)):
                for k, edit in enumerate(edits_of(audit)):
                    rows.append((start, start + k, *edit))
                    if len(rows) >= BATCH:
                        yield as_batch(rows)
                        rows = []
            if rows:
                yield as_batch(rows)

    def as_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 2 + [pa.string()] * 4)], names)

    return roots.select("start", "audit").mapInArrow(run, "start bigint, at bigint, before string, edit string, role string, after string")


def repaired(placed: DataFrame, roots: DataFrame) -> DataFrame:
    """(conv_id, start, at, n, role, text, edit) of each row of the repaired conversations, in order of (start, at, n)."""
    def added(roles: str) -> Column:
        return F.transform(F.regexp_extract_all(roles, F.lit("."), F.lit(0)), lambda c: F.struct(
            F.when(c == "u", "user").otherwise("assistant").alias("role"), F.lit("").alias("text"), F.lit(INSERT).alias("edit")))

    own = F.filter(F.array(F.struct(F.coalesce("new_role", "role").alias("role"), "text", "edit")), lambda x: x["edit"] != DELETE)
    rows = placed.select("conv_id", "at", "role", "text").join(edits(roots).withColumnRenamed("role", "new_role"), "at")
    return rows.select("conv_id", "start", "at", F.posexplode(F.concat(added("before"), own, added("after"))).alias("n", "row")).select("conv_id", "start", "at", "n", "row.*")


def hashes(rows: DataFrame) -> DataFrame:
    """(start, repaired_sha256): SHA-256 of a repaired conversation's ``role:text`` lines. It reads them one after the other by its nature: a
    conversation streams through one task in batches of bounded bytes, and none is held."""
    lines = rows.select("start", "at", "n", F.concat("role", F.lit(":"), "text").alias("line")).repartition("start").sortWithinPartitions("start", "at", "n").select("start", "line")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for part in slices(batches):
            done: list[tuple[int, str]] = []
            for start, line in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if start != now:
                    if state is not None:
                        done.append((now, state.hexdigest()))
                    now, state = start, hashlib.sha256(line.encode())
                else:
                    state.update(b"\n")
                    state.update(line.encode())
            if done:
                yield of(done)
        if state is not None:
            yield of([(now, state.hexdigest())])

    def of(done: list[tuple[int, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], ["start", "repaired_sha256"])

    return lines.mapInArrow(run, "start bigint, repaired_sha256 string")


def turn_gaps(rows: DataFrame) -> DataFrame:
    """(conv, gaps): turns missing between the least and the largest one; null turns don't count."""
    return (rows.select(F.struct("conv_id").alias("conv"), "turn").distinct().groupBy("conv")
            .agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps")))


EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def repair(rows: DataFrame, ids: DataFrame, span: int = SPAN, fan: int = FAN) -> DataFrame:
    """One row per conversation of ``ids`` (conv_id): gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    ``rows`` (conv_id, turn, role, text; role and text not null) are taken by turn, nulls first; rows of one turn by role and text,
    compared on their first 16 and 64 characters and then by a digest, so that repeated rows lie side by side. A null id is a
    conversation of its own. Without rows a conversation has zeros, an empty audit and the hash of nothing. A role other
    than system, user or assistant by its initial, the empty one too, can only be reroled or deleted. Very long texts are read whole
    but only shuffled and hashed; a very long conversation is parsed in blocks. Empty ``ids``: no rows.
    """
    placed = ordered(rows)
    roots = materialise(parsed(marked(placed), span, fan), "roots")
    found = roots.join(hashes(repaired(placed, roots)), "start", "left").drop("start").join(turn_gaps(placed), "conv")
    zero = F.lit(0).cast("long")
    return (ids.select(F.struct("conv_id").alias("conv")).distinct().join(found, "conv", "left")
            .select(F.col("conv.conv_id").alias("conv_id"), *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
                    F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256")))


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` after planted faults, for every conversation of the table; see ``damaged``."""
    return repair(damaged(conversations), conversations.select("conv_id"))


# Fixed values of the automaton: insertions between places (p, q, cost, audit) and edits of a row by its symbol.
_INS = ", ".join(f"({p}, {q}, {c[0]}, '{c[1]}')" for (p, q), c in zip(PAIRS, INSERTIONS) if c is not None)


def _edit_rows() -> str:
    rows = []
    for symbol in "suaoSUAO0123":
        rows += [(symbol, p, p, COST[DELETE], DELETE) for p in range(4)]
        if symbol.isalpha():
            extra = TRUNCATED if symbol.isupper() else 0
            for (p, role), q in STEPS.items():
                if role == symbol.lower():
                    rows.append((symbol, p, q, COST[KEEP] + extra, KEEP))
                if role in "ua":
                    rows.append((symbol, p, q, COST[REROLE] + extra, REROLE))
    return ", ".join(map(str, rows))


ORACLE_SQL = rf"""
WITH RECURSIVE ins(p, q, cost, audit) AS (VALUES {_INS}),
edits(symbol, p, q, cost, letter) AS (VALUES {_edit_rows()}),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS k FROM conversations),
coded AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(k)), lambda i: ('0x' || substr(hex(k), (2 * i + 1)::BIGINT, 2))::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v >> 1, (v & 1) * 3988292384))), 4294967295::BIGINT) % 20 AS fault FROM keyed),
hurt AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
  CASE fault WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS n FROM coded WHERE fault <> 0),
r0 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, n) AS i FROM hurt),
r1 AS (SELECT *, NOT regexp_matches(text, '[^ 	-]') AS is_blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth,
  CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 4 END AS initial FROM r0),
r2 AS (SELECT *, CASE WHEN is_blank THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' END AS fault,
  left(role, 1) AS c, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM r1),
r AS (SELECT *, substr(CASE WHEN fault IN ('blank', 'duplicate') THEN '0123' WHEN fault = 'truncated' THEN 'SUAO' ELSE 'suao' END, initial, 1) AS symbol FROM r2),
dp AS (
  SELECT conv_id, 0::BIGINT AS i, q AS place, cost, audit FROM (SELECT DISTINCT conv_id FROM r), ins WHERE p = 0
  UNION ALL
  SELECT conv_id, i, place, cost, audit FROM (
    SELECT d.conv_id, d.i + 1 AS i, n.q AS place, d.cost + e.cost + n.cost AS cost, d.audit || e.letter || n.audit AS audit
    FROM dp d JOIN r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1 JOIN edits e ON e.symbol = r.symbol AND e.p = d.place JOIN ins n ON n.p = e.q)
  QUALIFY row_number() OVER (PARTITION BY conv_id, place ORDER BY cost, audit) = 1),
facts AS (SELECT conv_id, max(i) AS last, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
  count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || c NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY conv_id),
best AS (SELECT dp.conv_id, cost, audit FROM dp JOIN facts f ON f.conv_id IS NOT DISTINCT FROM dp.conv_id AND f.last = dp.i WHERE place IN (0, 3)
  QUALIFY row_number() OVER (PARTITION BY dp.conv_id ORDER BY cost, audit) = 1),
letters AS (SELECT conv_id, length(replace(audit, 'D', '')) % 2 AS odd, unnest(string_split(audit, '')) AS letter, unnest(range(length(audit))) AS j FROM best WHERE audit <> ''),
placed AS (SELECT *, count(*) FILTER (letter <> 'I') OVER w AS i, count(*) FILTER (letter <> 'D') OVER w - 1 - odd AS place FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY j)),
lines AS (SELECT p.conv_id, j, CASE letter WHEN 'K' THEN r.role ELSE CASE place % 2 WHEN 0 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE r.text END AS line
  FROM placed p LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.i = p.i WHERE letter <> 'D'),
joined AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY j)) AS repaired_sha256 FROM lines GROUP BY conv_id),
ids AS (SELECT DISTINCT conv_id FROM conversations)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, coalesce(repaired_sha256, sha256('')) AS repaired_sha256
FROM ids LEFT JOIN facts f ON f.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM ids.conv_id
LEFT JOIN joined h ON h.conv_id IS NOT DISTINCT FROM ids.conv_id
"""
