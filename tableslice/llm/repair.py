"""Repair of conversation structure: least edits to alternating turns, by Four-Russians block tables.

A repaired conversation's role initials are ``(s?(ua)+)?``.  Rows are read as
symbols (role initial, truncated or not, or "must go"), and the cost of the
best repair of what follows a row, one number for each of the four states the
output so far can be in, is a vector whose differences are bounded.  So there
are few vectors once their smallest number is taken off.  For every such vector
and every block of ``BLOCK`` symbols a table holds the vector in front of the
block and the cost it adds; a conversation is read from its end, block by
block, by lookup.  A block is then expanded from its right border, and the
edits follow forwards, the least letter first among those that cost least.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.rowindex import row_index
from ..session import cut

#: Symbols a table step covers.
BLOCK = 3
#: Rows handed to Python at once; a longer conversation goes on in the next chunk.
CHUNK = 10_000

DELETE, INSERT, REROLE, UNFINISHED = 3, 2, 2, 1
BLANK = r"\x20\x09-\x0D"

# What has been put out: nothing, a system turn, an open user turn, whole pairs.
START, SYSTEM, USER, PAIR = range(4)
_NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": PAIR}, {"u": USER})
#: The initial a rerole or an insert gives in each state; there is one choice.
_GIVES = ("u", "u", "a", "u")
ROLES = {"u": "user", "a": "assistant"}
_FAR = 1 << 40  # no way

# Symbols: 0 must go; then initial s, u, a, other, each finished and truncated.
_INITIALS = ("s", "u", "a", "")
SYMBOLS = 1 + 2 * len(_INITIALS)

Vector = tuple[int, int, int, int]


def _with_inserts(f: list[int]) -> Vector:
    """Costs once rows may also be inserted at this place."""
    user = min(f[USER], INSERT + f[PAIR])
    pair = min(f[PAIR], INSERT + f[USER])
    out = (min(f[START], INSERT + user), min(f[SYSTEM], INSERT + user), user, pair)
    return tuple(min(x, _FAR) for x in out)


END = _with_inserts([0, _FAR, _FAR, 0])


def _choices(symbol: int, state: int) -> list[tuple[str, int, int]]:
    """Edits of a row in a state: letter, cost, state after it."""
    out = [("D", DELETE, state)]
    if symbol:
        initial, more = _INITIALS[(symbol - 1) // 2], UNFINISHED * ((symbol - 1) % 2)
        if initial in _NEXT[state]:
            out.append(("K", more, _NEXT[state][initial]))
        out.append(("R", REROLE + more, _NEXT[state][_GIVES[state]]))
    return out


def _before(symbol: int, behind: Vector) -> Vector:
    return _with_inserts([min(c + behind[to] for _, c, to in _choices(symbol, q)) for q in range(4)])


class BlockTables:
    """All cost vectors that can come up, and what a block of symbols does to each.

    The vectors are those reached from the end of a conversation and, for
    conversations in several chunks, from "must be in this state here".
    """

    def __init__(self, block: int = BLOCK):
        self.block = block
        self.vectors: list[Vector] = []
        self.index: dict[Vector, int] = {}
        for q in range(4):
            self._known(_with_inserts([0 if p == q else _FAR for p in range(4)]))
        self.end, self.end_cost = self._known(END)
        step, cost, at = [], [], 0
        while at < len(self.vectors):
            found = [self._known(_before(s, self.vectors[at])) for s in range(SYMBOLS)]
            step.append([v for v, _ in found])
            cost.append([c for _, c in found])
            at += 1
        step, cost = np.array(step), np.array(cost)
        # One symbol more in front: its code counts most.
        to, add = step, cost
        for _ in range(block - 1):
            more = cost[to] + add[:, :, None]
            to = step[to].transpose(0, 2, 1).reshape(len(step), -1)
            add = more.transpose(0, 2, 1).reshape(len(step), -1)
        self.step, self.cost = step.tolist(), cost.tolist()
        self.block_to, self.block_cost = to.tolist(), add.tolist()
        self._traced: dict[tuple[int, int, int], tuple[str, int]] = {}

    def _known(self, f: Vector) -> tuple[int, int]:
        low = min(f)
        f = tuple(_FAR if x >= _FAR else x - low for x in f)
        if f not in self.index:
            self.index[f] = len(self.vectors)
            self.vectors.append(f)
        return self.index[f], low

    def place(self, f: Vector) -> tuple[int, int]:
        """A vector's number and the cost taken off it."""
        low = min(f)
        return self.index[tuple(_FAR if x >= _FAR else x - low for x in f)], low

    def borders(self, symbols: list[int], vector: int) -> tuple[list[int], int]:
        """Vectors in front of every block, the last block first, and the cost taken off the first one."""
        at, cost, out, n = len(symbols), 0, [vector], self.block
        to, add = self.block_to, self.block_cost
        while at >= n:
            code = 0
            for s in symbols[at - n:at]:
                code = code * SYMBOLS + s
            cost += add[vector][code]
            vector = to[vector][code]
            out.append(vector)
            at -= n
        for s in reversed(symbols[:at]):
            cost += self.cost[vector][s]
            vector = self.step[vector][s]
        out.append(vector)
        return out, cost

    def in_front(self, symbols: list[int], vector: int) -> Vector:
        """Costs in front of the symbols, given the vector behind them."""
        borders, cost = self.borders(symbols, vector)
        return tuple(min(x + cost, _FAR) for x in self.vectors[borders[-1]])

    def _edit(self, behind: int, symbol: int, state: int) -> tuple[str, int]:
        """Least cheapest edits of one row and what is inserted before it; the state after it."""
        key = (behind, symbol, state)
        found = self._traced.get(key)
        if found is None:
            f, g, q, letters = _before(symbol, self.vectors[behind]), self.vectors[behind], state, ""
            while True:
                ways = [(e, c + g[to], to, True) for e, c, to in _choices(symbol, q)]
                onto = _NEXT[q][_GIVES[q]]
                ways.append(("I", INSERT + f[onto], onto, False))
                letter, _, q, done = min(w for w in ways if w[1] == f[q])
                letters += letter
                if done:
                    break
            found = self._traced[key] = (letters, q)
        return found

    def edits(self, symbols: list[int], vector: int, states: list[int]) -> tuple[list[list[str]], list[int]]:
        """Letters for every symbol from each of the starting ``states``, and where each ends."""
        borders, _ = self.borders(symbols, vector)
        states, out = list(states), [[] for _ in states]
        first = len(symbols) % self.block
        starts = [*range(first, len(symbols), self.block)]
        if first:
            starts.insert(0, 0)
        for k, start in enumerate(starts):
            stop = starts[k + 1] if k + 1 < len(starts) else len(symbols)
            v = borders[(len(symbols) - stop) // self.block]
            behind = [v]  # the block, expanded from its right border
            for s in reversed(symbols[start + 1:stop]):
                v = self.step[v][s]
                behind.append(v)
            behind.reverse()
            for i, b in enumerate(behind):
                s = symbols[start + i]
                for w, q in enumerate(states):
                    letters, states[w] = self._edit(b, s, q)
                    out[w].append(letters)
        return out, states


#: Rows inserted after the last row, by state.
CLOSING = ("", "II", "I", "")

_TABLES: dict[int, BlockTables] = {}


def tables(block: int = BLOCK) -> BlockTables:
    if block not in _TABLES:
        _TABLES[block] = BlockTables(block)
    return _TABLES[block]


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage, by CRC-32 of ``conv_id:turn`` modulo 20; a null is one space.

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` out of
    it, 3 repeats the row, 4 makes it the user's.  ``conv_id`` and ``turn``
    themselves stay null.
    """
    def said(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))

    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % 20
    return (
        rows.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("kind"))
        .filter("kind != 0")
        .withColumn("times", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
        .select(
            "conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", ""))
            .otherwise(F.col("text")).alias("text"),
        )
    )


def _symbol(initial: Column, must_go: Column, truncated: Column) -> Column:
    place = F.lit(2 * len(_INITIALS) - 1)
    for i, x in enumerate(_INITIALS[:-1]):
        place = F.when(initial == x, F.lit(2 * i + 1)).otherwise(place)
    return F.when(must_go, F.lit(0)).otherwise(place + truncated.cast("int"))


def _marked(rows: DataFrame) -> DataFrame:
    """Each row without its text: ``row, chunk, conv_id, fault, symbol``.

    A row's content is known by SHA-256; the first row of each content is found
    by a minimum that is combined before the shuffle, and only contents that
    repeat are joined back.
    """
    blank = ~F.col("text").rlike(f"[^{BLANK}]")
    thin = rows.select(
        "row", "conv_id", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"),
        (~F.col("text").rlike(rf"[.!?][{BLANK}]*\z")).alias("truncated"),
        F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)).alias("content"),
    )
    repeated = (
        thin.filter("NOT blank").groupBy("conv_id", "content").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
        .filter("n > 1").select(F.col("conv_id").alias("c"), F.col("content").alias("x"), "first")
    )
    joined = thin.join(repeated, thin.conv_id.eqNullSafe(F.col("c")) & (thin.content == F.col("x")), "left")
    fault = (
        F.when(F.col("blank"), F.lit("blank")).when(F.col("row") > F.col("first"), F.lit("duplicate"))
        .when(F.col("truncated"), F.lit("truncated")).otherwise(F.lit(""))
    )
    return joined.withColumn("fault", fault).select(
        "row", F.floor(F.col("row") / CHUNK).cast("long").alias("chunk"), "conv_id", "fault",
        _symbol(F.col("initial"), F.col("fault").isin("blank", "duplicate"), F.col("fault") == "truncated").alias("symbol"),
    )


def _pieces(group: pa.Table) -> list[tuple[int, int]]:
    """From and to of each conversation's rows within a chunk in row order."""
    ids = group["conv_id"].to_pylist()
    cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
    return list(zip(cuts, cuts[1:]))


def _border_costs(group: pa.Table) -> pa.Table:
    """The first and last conversation of a chunk: what each costs from every state to every state."""
    group = group.sort_by("row")
    symbols, t = group["symbol"].to_pylist(), tables()
    pieces = _pieces(group)
    out = []
    for a, b in dict.fromkeys((pieces[0], pieces[-1])):
        costs = [t.in_front(symbols[a:b], q) for q in range(4)]
        out.append({"chunk": group["chunk"][0], "conv_id": group["conv_id"][a], "head": a == 0,
                    "costs": [costs[q][p] for p in range(4) for q in range(4)]})
    return _table(out, group.schema, {"head": pa.bool_(), "costs": pa.list_(pa.int64())})


def _table(rows: list[dict], like: pa.Schema, more: dict[str, pa.DataType], keys=("chunk", "conv_id")) -> pa.Table:
    fields = [like.field(k) for k in keys] + [pa.field(n, t) for n, t in more.items()]
    values = {f.name: [r[f.name].as_py() if isinstance(r[f.name], pa.Scalar) else r[f.name] for r in rows] for f in fields}
    return pa.table([pa.array(values[f.name], f.type) for f in fields], schema=pa.schema(fields))


def _behind(group: pa.Table) -> pa.Table:
    """For each chunk of one conversation the cost vector behind the chunk, composed from its end."""
    rows = sorted(group.to_pylist(), key=lambda r: -r["chunk"])
    f = END
    for r in rows:
        r["behind"] = list(f)
        c = r["costs"]
        f = tuple(min(c[4 * p + q] + f[q] for q in range(4)) for p in range(4))
    return _table(rows, group.schema, {"head": pa.bool_(), "behind": pa.list_(pa.int64())})


def _edits(rows: pa.Table, borders: pa.Table) -> pa.Table:
    """Letters for each row of a chunk; four sets of them where the state before the chunk is open."""
    rows = rows.sort_by("row")
    symbols, t = rows["symbol"].to_pylist(), tables()
    behind = {b["head"]: tuple(b["behind"]) for b in borders.to_pylist()}
    pieces = _pieces(rows)
    edits, exits = [], [None] * len(symbols)
    for k, (a, b) in enumerate(pieces):
        head, last = a == 0, k == len(pieces) - 1
        vector = t.place(behind[head])[0] if head or last else t.end
        found, ends = t.edits(symbols[a:b], vector, [*range(4)] if head else [START])
        edits.extend(map(list, zip(*found)))
        if head or last:
            exits[b - 1] = ends
    heads = np.arange(len(symbols)) < pieces[0][1]
    fields = [rows.schema.field(n) for n in ("row", "chunk", "conv_id", "fault")]
    schema = pa.schema([*fields, ("head", pa.bool_()), ("edits", pa.list_(pa.string())), ("exits", pa.list_(pa.int64()))])
    columns = [rows[f.name].combine_chunks() for f in fields]
    return pa.table([*columns, pa.array(heads), pa.array(edits, schema.field("edits").type),
                     pa.array(exits, schema.field("exits").type)], schema=schema)


def _entries(group: pa.Table) -> pa.Table:
    """The state in which each chunk's first conversation goes on."""
    state, out = START, []
    for r in sorted(group.to_pylist(), key=lambda r: (r["chunk"], not r["head"])):
        if r["head"]:
            out.append(r | {"entry": state})
        state = r["exits"][state] if r["head"] else r["exits"][0]
    return _table(out, group.schema, {"entry": pa.int64()}, ("chunk",))


def repair(rows: DataFrame) -> DataFrame:
    """The cheapest edits of every row: ``conv_id, row, fault, edits``, in no order.

    ``rows`` has ``conv_id, row, role, text``; ``row`` numbers all rows 0, 1, ...,
    conversation by conversation.  ``edits`` are letters: inserts before the row
    (I), then what becomes of it, kept (K), reroled (R) or deleted (D).  Inserts
    after a conversation's last row are not among them, see ``CLOSING``.
    Chunks of rows are worked on apart, however long a conversation is: chunks
    at which one goes on are joined by what they cost from every state to every
    state, and by the state each of their traces ends in.
    """
    conv = rows.schema["conv_id"].dataType
    marked = cut(_marked(rows))
    key = [T.StructField("chunk", T.LongType()), T.StructField("conv_id", conv)]
    longs = T.ArrayType(T.LongType())
    costs = T.StructType([*key, T.StructField("head", T.BooleanType()), T.StructField("costs", longs)])
    behind = T.StructType([*key, T.StructField("head", T.BooleanType()), T.StructField("behind", longs)])
    borders = marked.groupBy("chunk").applyInArrow(_border_costs, costs).groupBy("conv_id").applyInArrow(_behind, behind)
    traced = T.StructType([
        T.StructField("row", T.LongType()), *key, T.StructField("fault", T.StringType()),
        T.StructField("head", T.BooleanType()), T.StructField("edits", T.ArrayType(T.StringType())), T.StructField("exits", longs),
    ])
    edits = cut(marked.groupBy("chunk").cogroup(borders.groupBy("chunk")).applyInArrow(_edits, traced))
    entry = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("entry", T.LongType())])
    entries = edits.filter("exits IS NOT NULL").select("chunk", "conv_id", "head", "exits").groupBy("conv_id").applyInArrow(_entries, entry)
    at = F.when(F.col("head"), F.col("entry")).otherwise(F.lit(0)).cast("int")
    return edits.join(entries, "chunk").select("conv_id", "row", "fault", F.get("edits", at).alias("edits"))


_FAULTS = ("blank", "duplicate", "truncated")
_LEGAL = {"su", "ua", "au"}


class _Open:
    """A conversation whose rows are coming in."""

    def __init__(self):
        self.turns = self.cost = self.illegal = 0
        self.low = self.high = self.turn = self.last = None
        self.faults = dict.fromkeys(_FAULTS, 0)
        self.audit: list[str] = []
        self.state, self.sha, self.any = START, hashlib.sha256(), False

    def _put(self, line: str) -> None:
        self.sha.update(("\n" + line if self.any else line).encode())
        self.any = True

    def _insert(self) -> None:
        self._put(f"{ROLES[_GIVES[self.state]]}:")
        self.state = _NEXT[self.state][_GIVES[self.state]]
        self.cost += INSERT

    def add(self, turn, role: str, text: str, fault: str, edits: str) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low, self.high, self.turn = turn if self.low is None else self.low, turn, turn
        initial = role[:1]
        self.illegal += self.last is not None and self.last + initial not in _LEGAL
        self.last = initial
        if fault:
            self.faults[fault] += 1
        self.audit.append(edits)
        for _ in edits[:-1]:
            self._insert()
        if edits[-1] == "D":
            self.cost += DELETE
            return
        if edits[-1] == "R":
            role, initial = ROLES[_GIVES[self.state]], _GIVES[self.state]
            self.cost += REROLE
        self.cost += UNFINISHED * (fault == "truncated")
        self._put(f"{role}:{text}")
        self.state = _NEXT[self.state][initial]

    def close(self) -> tuple:
        closing = CLOSING[self.state]
        self.audit.append(closing)
        for _ in closing:
            self._insert()
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (gaps, *self.faults.values(), self.illegal, self.cost, "".join(self.audit), self.sha.hexdigest())


_RESULT = (
    "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


def _digests(batches: Iterator[pa.RecordBatch], conv: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = [f.split()[0] for f in _RESULT.split(", ")]
    types = [pa.string() if n in ("audit", "repaired_sha256") else pa.int64() for n in names]
    schema = pa.schema([("conv_id", conv), *zip(names, types)])

    def batch(done):
        columns = list(zip(*done))
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    now, state, held, done = None, None, None, []
    for b in batches:
        for conv_id, row, turn, role, text, fault, edits in zip(*[c.to_pylist() for c in b.columns]):
            if fault is None:  # the text comes first, then what becomes of it
                held = (turn, role, text)
                continue
            if state is None or conv_id != now:
                if state is not None:
                    done.append((now, *state.close()))
                now, state = conv_id, _Open()
            state.add(*held, fault, edits)
            held = None
        if len(done) >= 1000:
            yield batch(done)
            done = []
    if state is not None:
        done.append((now, *state.close()))
    if done:
        yield batch(done)


def repair_digests(conversations: DataFrame) -> DataFrame:
    """Damages ``conversations`` as the contract says, repairs them and reports on each ``conv_id``.

    Rows are taken by turn, nulls first, then by role and text.  A null
    ``conv_id`` is a conversation of its own; a null role or text is one space,
    so such a text is blank and such a role fits nowhere.  Equal rows of one
    turn are duplicates but the first.  A conversation all of whose rows are
    dropped has zeros, an empty audit and the hash of an empty string; an empty
    table has no rows.  Other columns are not read.

    Faults and edits are found chunk by chunk, so a conversation of a third of
    all rows is spread.  Only its SHA-256 and its audit, which the contract wants
    as one value each, are put together by one task, which reads its rows as a
    stream and holds none of them.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    broken = damaged(rows).withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text"), F.col("__tie")]
    numbered = row_index(broken, order, "row", unique=True).drop("__tie").withColumn("row", F.col("row") - 1)
    edits = repair(numbered)
    none = F.lit(None)
    turn = rows.schema["turn"].dataType
    both = numbered.select(
        "conv_id", "row", "turn", "role", "text", none.cast("string").alias("fault"), none.cast("string").alias("edits"),
    ).unionByName(edits.select(
        "conv_id", "row", none.cast(turn).alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"),
        "fault", "edits",
    ))
    conv = T.StructField("conv_id", rows.schema["conv_id"].dataType)
    from pyspark.sql.pandas.types import to_arrow_type

    conv_type = to_arrow_type(conv.dataType)
    result = T.StructType([conv, *T._parse_datatype_string(_RESULT).fields])
    found = (
        both.repartition("conv_id").sortWithinPartitions("conv_id", "row", F.col("fault").isNotNull())
        .mapInArrow(lambda batches: _digests(batches, conv_type), result)
    )
    every = rows.select(F.col("conv_id").alias("c")).distinct()
    joined = every.join(found, F.col("c").eqNullSafe(F.col("conv_id")), "left")
    empty = hashlib.sha256().hexdigest()
    missing = {"audit": F.lit(""), "repaired_sha256": F.lit(empty)}
    return joined.select(F.col("c").alias("conv_id"), *[
        F.coalesce(F.col(f.name), missing.get(f.name, F.lit(0).cast("long"))).alias(f.name) for f in result.fields[1:]
    ])


def repair_sql() -> str:
    """The same in SQL: a recursive table of least ``(cost, letters)`` per state, from the end."""
    steps = ", ".join(["-1"] * 8)

    def least(*ways: str) -> str:
        return f"list_min([{', '.join(ways)}])"

    def way(cost: str, letter: str, f: str) -> str:
        return f"{{'cost': {cost} + {f}.cost, 'a': '{letter}' || {f}.a}}"

    def choice(state: int, kept: dict[str, int], given: int) -> str:
        keep = [f"CASE WHEN NOT gone AND initial = '{x}' THEN {way('t', 'K', f'f{to}')} END" for x, to in kept.items()]
        return least(way("3", "D", f"f{state}"), *keep, f"CASE WHEN NOT gone THEN {way('2 + t', 'R', f'f{given}')} END")

    state = "CASE WHEN q = 2 THEN 3 ELSE 2 END"
    role = "CASE WHEN q = 2 THEN 'assistant:' ELSE 'user:' END"
    return f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
           string_split(k, ''), lambda c: [unicode(c)::BIGINT, {steps}]))),
           lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, (c & 1) * 3988292384) END)) % 20 AS kind FROM src),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
         unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
  FROM kinds WHERE kind <> 0),
numbered AS (
  SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
faults AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 'truncated' ELSE '' END AS fault,
         substr(role, 1, 1) AS initial, lag(substr(role, 1, 1)) OVER (PARTITION BY c ORDER BY i) AS earlier
  FROM numbered),
marked AS MATERIALIZED (
  SELECT *, fault IN ('blank', 'duplicate') AS gone, (fault = 'truncated')::INTEGER AS t FROM faults),
counts AS (
  SELECT c, any_value(conv_id) AS conv_id, count(*) AS n,
         coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (earlier || initial NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY c),
best AS (
  SELECT c, n + 1 AS i, {{'cost': 0, 'a': ''}} AS f0, {{'cost': 4, 'a': 'II'}} AS f1, {{'cost': 2, 'a': 'I'}} AS f2,
         {{'cost': 0, 'a': ''}} AS f3 FROM counts
  UNION ALL
  SELECT c, i, {least('h0', way('2', 'I', 'e2'))}, {least('h1', way('2', 'I', 'e2'))}, e2, {least('h3', way('2', 'I', 'h2'))}
  FROM (SELECT *, {least('h2', way('2', 'I', 'h3'))} AS e2 FROM (
    SELECT c, m.i, {choice(0, {'s': 1, 'u': 2}, 2)} AS h0, {choice(1, {'u': 2}, 2)} AS h1,
           {choice(2, {'a': 3}, 3)} AS h2, {choice(3, {'u': 2}, 2)} AS h3
    FROM best JOIN marked m USING (c) WHERE m.i = best.i - 1))),
audits AS (SELECT c, f0.cost::BIGINT AS cost, f0.a AS audit FROM best WHERE i = 1),
walk AS (
  SELECT c, audit, 0 AS p, 0 AS r, 0 AS q, []::VARCHAR[] AS lines FROM audits
  UNION ALL
  SELECT c, audit, p + 1, r + (e <> 'I')::INTEGER,
         CASE WHEN e = 'D' THEN q WHEN e = 'K' AND initial = 's' THEN 1 ELSE {state} END,
         CASE e WHEN 'D' THEN lines WHEN 'I' THEN list_append(lines, {role})
                WHEN 'K' THEN list_append(lines, role || ':' || text) ELSE list_append(lines, {role} || text) END
  FROM (SELECT w.*, substr(audit, p + 1, 1) AS e, m.role, m.text, m.initial
        FROM walk w LEFT JOIN marked m ON m.c = w.c AND m.i = r + 1 WHERE p < length(audit)))
SELECT d.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost,
       coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) d LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM d.conv_id
LEFT JOIN audits USING (c) LEFT JOIN walk w ON w.c = counts.c AND w.p = length(w.audit)
"""
