"""Repair of conversation structure by a dynamic program with square-root checkpoints.

A conversation is repaired to roles ``(system? (user assistant)+)?`` by the cheapest edits: keep a turn (0), give it the
role user or assistant (3), delete it (4), insert an empty turn of user or assistant (3); a truncated turn that isn't
deleted costs 3 more, and blank and repeated turns must go. Of the cheapest audits (the edits' initials) the ASCII-least is
taken.

A conversation's rows are numbered over range partitions and cut into blocks of about the square root of their number (at
least LEAST rows). A block is folded to a matrix of least costs from each of the four grammar states to each. Backward
over a conversation's blocks, the matrices give the vector of costs-to-go at the end of every block, and only these
checkpoints are stored. Then each block is computed again from its checkpoint and walked forward from every state it may
begin in, always by the ASCII-least tight edit; a fold over the blocks says which of these walks is the one. So neither a
task nor a row of the dynamic program holds more than a square root of a conversation. What the contract itself makes
whole, the audit and the digest of the repaired turns, is put together in the end: the audit is one string of a row, and the
digest is updated turn by turn from rows in order, a batch in memory.

Roles are told by their first character. Equal rows of one turn are counted before anything is sorted: one item with a
number; all of them but the first are repeated turns.

Defined results: null role and text are one space; a null conversation is one of its own, null turns come first; rows
of one turn come by role and digest of their text; roles of another first character must be renamed or go; a conversation without
rows left has zeros, an empty audit and the digest of nothing; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelspark.operators.staging import spread_in_order

from .common import materialise, table

WHITE = " \t\n\x0b\x0c\r"
#: Least rows of a block.
LEAST = 64
RENAME, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: States: nothing yet, after system, after user, after assistant. What an inserted or renamed turn leads to, and its role.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = ("user", "user", "assistant", "user")
#: Where a kept turn leads to, by state and by role (system, user, assistant, other).
KEEP = ((SYSTEM, USER, None, None), (None, USER, None, None), (None, None, ASSISTANT, None), (None, USER, None, None))
#: Edits that end a conversation: inserts from each state, and their cost.
TAIL = ("", "II", "I", "")
END = np.array([INSERT * len(t) for t in TAIL], dtype=np.int64)
NEVER = 1 << 40
FINE, MUST_GO, CUT_OFF = range(3)
MOST_INSERTS, EDITS = 3, "DKR"


def _table() -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """For each symbol (role + 4 * fault) and state: costs, next states and codes of its edits in ASCII order; and the code's edits.

    An edit is some inserts, then D, K or R; its code is (state * 4 + inserts) * 3 + the place in DKR. Symbol 12 is no row.
    """
    n = (MOST_INSERTS + 1) * len(EDITS)
    names = ["I" * (c // 3 % 4) + EDITS[c % 3] for c in range(4 * 4 * 3)]
    cost, to, code = np.full((13, 4, n), NEVER, np.int64), np.zeros((13, 4, n), np.int64), np.zeros((13, 4, n), np.int64)
    for symbol in range(12):
        role, fault = symbol % 4, symbol // 4
        for start in range(4):
            found, state = [], start
            for j in range(MOST_INSERTS + 1):
                at, more = (start * 4 + j) * 3, TRUNCATED * (fault == CUT_OFF)
                found.append((names[at], j * INSERT + DELETE, state, at))
                if fault != MUST_GO:
                    if KEEP[state][role] is not None:
                        found.append((names[at + 1], j * INSERT + more, KEEP[state][role], at + 1))
                    found.append((names[at + 2], j * INSERT + RENAME + more, NEXT[state], at + 2))
                state = NEXT[state]
            for i, (_, c, s, k) in enumerate(sorted(found)):
                cost[symbol, start, i], to[symbol, start, i], code[symbol, start, i] = c, s, k
    cost[12, :, 0], to[12, :, 0] = 0, np.arange(4)
    return cost, to, code, names


COST, TO, CODE, NAMES = _table()
#: Least cost from state to state over one row.
STEP = np.full((13, 4, 4), NEVER, np.int64)
for _s in range(4):
    for _i in range(COST.shape[2]):
        np.minimum.at(STEP, (np.arange(13), _s, TO[:, _s, _i]), COST[:, _s, _i])


def _padded(rows: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of symbols as one array, longest first: (symbols, lengths, order)."""
    lengths = np.diff(rows.offsets.to_numpy())
    order = np.argsort(-lengths, kind="stable")
    out = np.full((len(lengths), max(1, lengths.max(initial=0))), 12, np.int64)
    flat = rows.flatten().to_numpy()
    out[np.arange(out.shape[1]) < lengths[:, None]] = flat
    return out[order], lengths[order], order


def matrices(rows: pa.Array) -> np.ndarray:
    """Least costs of each list of symbols from state to state."""
    symbols, lengths, order = _padded(rows)
    m = np.broadcast_to(np.where(np.eye(4, dtype=bool), 0, NEVER), (len(order), 4, 4)).copy()
    for t in range(symbols.shape[1] - 1, -1, -1):
        k = int(np.searchsorted(-lengths, -t))  # lists longer than t
        m[:k] = (STEP[symbols[:k, t]][:, :, :, None] + m[:k, None, :, :]).min(2)
    out = np.empty_like(m)
    out[order] = np.minimum(m, NEVER)
    return out


def walks(rows: pa.Array, after: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """From the costs-to-go after each list: the state that it ends in from each state, and the codes of its edits (state, row)."""
    symbols, lengths, order = _padded(rows)
    b, n = after[order], symbols.shape[1]
    picks = np.zeros((len(order), n, 4), np.int64)
    for t in range(n - 1, -1, -1):
        k = int(np.searchsorted(-lengths, -t))
        s = symbols[:k, t]
        total = COST[s] + np.take_along_axis(b[:k], TO[s].reshape(k, -1), 1).reshape(k, 4, -1)
        picks[:k, t] = total.argmin(2)  # the first of the least: edits are in ASCII order
        b[:k] = total.min(2)
    state, codes = np.tile(np.arange(4), (len(order), 1)), np.zeros((len(order), 4, n), np.int64)
    for t in range(n):
        k = int(np.searchsorted(-lengths, -t))
        s = symbols[:k, t, None]
        pick = np.take_along_axis(picks[:k, t], state[:k], 1)
        codes[:k, :, t] = CODE[s, state[:k], pick]
        state[:k] = TO[s, state[:k], pick]
    ends, out = np.empty_like(state), [None] * len(order)
    ends[order] = state
    for i, at in enumerate(order.tolist()):
        out[at] = codes[i, :, : lengths[i]]
    return ends, out


def _longs(a: np.ndarray) -> pa.Array:
    """Rows of a two-dimensional array as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1) * a.shape[1], pa.int32()), pa.array(a.reshape(-1), pa.int64()))


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _longs(matrices(b.column(2)).reshape(-1, 16))], ["key", "block", "matrix"])


def _checkpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From a conversation's matrices in order: the costs-to-go after each of its blocks, and the least cost of all."""
    for b in batches:
        after, least = [], []
        for blocks in b.column(1):
            v, own = END, []
            for m in reversed(blocks.as_py()):
                own.append(v.tolist())
                v = (np.array(m["matrix"], np.int64).reshape(4, 4) + v).min(1)
            after.append(own[::-1])
            least.append(int(v[NOTHING]))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(after, pa.list_(pa.list_(pa.int64()))), pa.array(least, pa.int64())], ["key", "after", "least"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each block's ends, and for each state that it may begin in the codes of its edits and its audit (extra rows of an item are deleted)."""
    for b in batches:
        after = np.array(b.column(4).to_pylist(), np.int64).reshape(-1, 4)
        ends, codes = walks(b.column(2), after)
        edits, audits = [], []
        for block, extra, own in zip(b.column(1).to_pylist(), b.column(3).to_pylist(), codes, strict=True):
            begins = range(1) if block == 0 else range(4)
            edits.append([own[s].tolist() for s in begins])
            audits.append(["".join(NAMES[c] + "D" * x for c, x in zip(own[s].tolist(), extra, strict=True)) for s in begins])
        lists = [_longs(ends), pa.array(edits, pa.list_(pa.list_(pa.int64()))), pa.array(audits, pa.list_(pa.string()))]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *lists], ["key", "block", "ends", "edits", "audits"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's lines; rows come in the order of key and place."""

    def row(key, h) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], kind), pa.array([h.hexdigest()])], ["key", "sha"])

    now, h, kind = None, None, None
    for b in batches:
        kind = b.column(0).type
        for key, line in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            if h is None or key != now:
                if h is not None:
                    yield row(now, h)
                now, h = key, hashlib.sha256()
            else:
                h.update(b"\n")
            h.update(line.as_py().encode())
    if h is not None:
        yield row(now, h)


def damage(conversations: DataFrame) -> DataFrame:
    """Rows with faults put in by the hash of conversation and turn: dropped, emptied, without sentence ends, repeated or given to the user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn")).cast("binary")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    rows = conversations.where(kind != 0).select("conv_id", "turn", F.when(kind == 4, "user").otherwise(told("role")).alias("role"), text.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("_copies"))
    return rows.withColumn("_copies", F.explode(F.sequence(F.lit(1), "_copies"))).drop("_copies")


def _items(conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """key (the conversation, null being one), item (turn, role, digest of the text), text."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    item = F.struct(F.col(turn_col).alias("turn"), told(role_col).alias("role"), F.unhex(F.sha2(told(text_col), 256)).alias("digest"))
    return conversations.select(F.struct(F.col(conv_col).alias("conv")).alias("key"), item.alias("item"), told(text_col).alias("text"))


def _numbered(rows: DataFrame, least: int) -> DataFrame:
    """Each item once with its number of rows n, its block and its place in it."""
    bare = F.rtrim(F.col("text"), F.lit(WHITE))
    fault = F.when(bare == "", MUST_GO).when(F.substring(bare, -1, 1).isin(".", "!", "?"), FINE).otherwise(CUT_OFF)
    items = rows.groupBy("key", "item", fault.alias("fault")).agg(F.count("*").alias("n"))
    order = [F.col("item.turn").asc_nulls_first(), F.col("item.role"), F.col("item.digest")]
    spread = spread_in_order(items, ["key"], order)
    parts, whole = Window.partitionBy("key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("key")
    starts = spread.groupBy("key", "_part").agg(F.count("*").alias("_c")).select("key", "_part", F.coalesce(F.sum("_c").over(parts), F.lit(0)).alias("_start"), F.sum("_c").over(whole).alias("_total"))
    inside = F.row_number().over(Window.partitionBy("key", "_part").orderBy(*order)) - 1
    placed = spread.withColumn("_in", inside).join(starts, ["key", "_part"])
    pos, size = F.col("_start") + F.col("_in"), F.greatest(F.lit(least), F.ceil(F.sqrt("_total")))
    return placed.select("key", "item", "fault", "n", pos.alias("pos"), F.floor(pos / size).alias("block"), (pos % size).alias("at"))


def _blocks(numbered: DataFrame) -> DataFrame:
    """One row for each block: its items in order with their symbols, and what its report needs."""
    first = numbered.where(F.col("fault") != MUST_GO).groupBy("key", F.col("item.role").alias("role"), F.col("item.digest").alias("digest")).agg(F.min("pos").alias("pos")).select("key", "pos", F.lit(True).alias("first"))
    rows = numbered.join(first, ["key", "pos"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    blank = F.col("fault") == MUST_GO
    again = ~blank & ~F.col("first")
    initial = F.substring("item.role", 1, 1)
    role = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    symbol = (role + 4 * F.when(again, MUST_GO).otherwise(F.col("fault"))).cast("long")
    one = F.struct("at", symbol.alias("symbol"), (F.col("n") - 1).alias("extra"), role.alias("role"), "item", "pos")
    count = lambda test, n: F.coalesce(F.sum(F.when(test, n)), F.lit(0)).alias
    out = rows.groupBy("key", "block").agg(
        F.sort_array(F.collect_list(one)).alias("rows"), count(blank, F.col("n"))("blank"), count(~blank, F.col("n") - F.col("first").cast("int"))("duplicate"),
        count(F.col("first") & (F.col("fault") == CUT_OFF), F.lit(1))("truncated"), F.sum(F.col("n") - 1).alias("extra"), F.min("item.turn").alias("least_turn"), F.max("item.turn").alias("most_turn"),
    )
    return materialise(out, "repair-blocks")


def _illegal(a: Column, b: Column) -> Column:
    """Whether turns of these roles may not stand side by side."""
    return ~((a.isin(0, 2) & (b == 1)) | ((a == 1) & (b == 2)))


def _report(blocks: DataFrame) -> DataFrame:
    """Counts of each conversation, from what its blocks hold and from where they meet."""
    roles, turns = F.transform("rows", lambda r: r["role"]), F.transform("rows", lambda r: r["item"]["turn"])
    n = F.size("rows")
    inside = F.size(F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i > 0) & _illegal(F.get(roles, i - 1), F.get(roles, i))))
    distinct = F.size(F.array_distinct(F.filter(turns, lambda t: t.isNotNull())))
    own = F.struct("block", (inside + F.col("extra")).alias("illegal"), distinct.alias("turns"), F.get(roles, F.lit(0)).alias("r0"), F.get(roles, n - 1).alias("r1"), F.get(turns, F.lit(0)).alias("t0"), F.get(turns, n - 1).alias("t1"))
    sums = [F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "extra")]
    got = blocks.select("*", own.alias("own")).groupBy("key").agg(*sums, F.min("least_turn").alias("lo"), F.max("most_turn").alias("hi"), F.sort_array(F.collect_list("own")).alias("own"))
    pair = lambda f: F.aggregate(F.filter(F.sequence(F.lit(0), F.size("own") - 1), lambda i: i > 0), F.lit(0), lambda a, i: a + f(F.get("own", i - 1), F.get("own", i)).cast("int"))
    total = lambda c: F.aggregate("own", F.lit(0).cast("long"), lambda a, o: a + o[c])
    distinct_turns = total("turns") - pair(lambda a, b: F.coalesce(a["t1"] == b["t0"], F.lit(False)))
    gaps = F.coalesce(F.col("hi") - F.col("lo") + 1 - distinct_turns, F.lit(0))
    illegal = total("illegal") + pair(lambda a, b: _illegal(a["r1"], b["r0"]))
    return got.select("key", gaps.alias("gaps"), "blank", "duplicate", "truncated", illegal.alias("illegal"), "extra")


def repair(conversations: DataFrame, all_rows: DataFrame | None = None, least: int = LEAST, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(report, turns). report: a row for each conversation of ``all_rows`` (default: of ``conversations``) with conv_col, gaps, blank,
    duplicate, truncated, illegal, cost, audit and repaired_sha256. turns: key, pos and line, the repaired turns
    ``role:text`` in their order (a turn's line may have inserted ones before it, each on a line of its own).
    """
    rows = _items(conversations, conv_col, turn_col, role_col, text_col)
    blocks = _blocks(materialise(_numbered(rows, least), "repair-items"))
    key = blocks.schema["key"].dataType.simpleString()
    symbols = F.transform("rows", lambda r: r["symbol"])
    folded = blocks.select("key", "block", symbols.alias("symbols")).mapInArrow(_fold, f"key {key}, block long, matrix array<long>")
    whole = folded.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "matrix"))).alias("blocks"))  # as many as a block has rows
    marks = materialise(whole.mapInArrow(_checkpoints, f"key {key}, after array<array<long>>, least long"), "repair-checkpoints")
    after = marks.select("key", F.posexplode("after").alias("block", "after")).withColumn("block", F.col("block").cast("long"))
    again = blocks.select("key", "block", symbols.alias("symbols"), F.transform("rows", lambda r: r["extra"]).alias("extra")).join(after, ["key", "block"])
    walked = materialise(again.mapInArrow(_walk, f"key {key}, block long, ends array<long>, edits array<array<long>>, audits array<string>"), "repair-walks")
    # which state each block begins in
    start = F.struct(F.lit(0).cast("long").alias("state"), F.array().cast("array<long>").alias("begins"))
    move = lambda a, b: F.struct(F.get(b["ends"], a["state"].cast("int")).alias("state"), F.concat(a["begins"], F.array(a["state"])).alias("begins"))
    chain = walked.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("block", "ends"))).alias("b")).select("key", F.aggregate("b", start, move).alias("c"))
    chain = materialise(chain.select("key", "c.begins", F.get(F.array(*map(F.lit, TAIL)), F.col("c.state").cast("int")).alias("tail")), "repair-chain")
    begins = chain.select("key", F.posexplode("begins").alias("block", "begin")).withColumn("block", F.col("block").cast("long"))
    nth = lambda c: F.get(c, F.col("begin").cast("int"))
    done = materialise(walked.join(begins, ["key", "block"]).select("key", "block", nth("edits").alias("edits"), nth("audits").alias("audit")), "repair-done")
    audits = done.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    # turns that stay, with what is inserted before them
    edits = done.join(blocks.select("key", "block", "rows"), ["key", "block"]).select("key", F.inline(F.arrays_zip("rows", "edits"))).where(F.col("edits") % 3 > 0)
    edits = edits.select("key", "rows.item", "rows.pos", F.col("edits").cast("int").alias("edit"))
    texts = rows.groupBy("key", "item").agg(F.first("text").alias("text"))
    lead, role = [], []
    for c in range(4 * 4 * 3):
        state, before = c // 12, ""
        for _ in range(c // 3 % 4):
            before, state = f"{before}{ROLE[state]}:\n", NEXT[state]
        lead.append(before)
        role.append(ROLE[state])
    at = lambda values: F.get(F.array(*map(F.lit, values)), F.col("edit"))
    line = F.concat(at(lead), F.when(F.col("edit") % 3 == 1, F.col("item.role")).otherwise(at(role)), F.lit(":"), F.col("text"))
    kept = edits.join(texts, ["key", "item"]).select("key", "pos", line.alias("line"))
    last = chain.where("tail <> ''").select("key", F.lit(2**62).alias("pos"), F.when(F.col("tail") == "I", "assistant:").otherwise("user:\nassistant:").alias("line"))
    turns = kept.unionByName(last)
    digests = turns.repartition("key").sortWithinPartitions("key", "pos").select("key", "line").mapInArrow(_digest, f"key {key}, sha string")
    keys = (all_rows if all_rows is not None else conversations).select(F.struct(F.col(conv_col).alias("conv")).alias("key")).distinct()
    out = keys.join(_report(blocks), "key", "left").join(marks.select("key", "least"), "key", "left").join(audits.join(chain.select("key", "tail"), "key"), "key", "left").join(digests, "key", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    report = out.select(
        F.col("key.conv").alias(conv_col), *[zero(F.col(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal")], zero(F.col("least") + DELETE * F.col("extra")).alias("cost"),
        F.coalesce(F.concat("audit", "tail"), F.lit("")).alias("audit"), F.coalesce("sha", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
    return report, turns


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return repair(damage(rows), rows)[0]


#: The same program forward: of the ways to a state the cheapest, then the ASCII-least audit (none is the start of another of its cost).
OP12_SQL = r"""
WITH RECURSIVE raw AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') AS c, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(range(1, len(k) + 1), lambda i: [ascii(k[i])::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) % 20 AS kind FROM raw),
hurt AS (SELECT c, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM kinds, range(2) t(copy) WHERE kind <> 0 AND (copy = 0 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(text)) AS i, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM hurt),
turns AS (SELECT *, left(role, 1) AS r1, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 'd' WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM placed),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (p IS NOT NULL AND p || r1 NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS last FROM (SELECT *, lag(r1) OVER (PARTITION BY c ORDER BY i) AS p FROM turns) GROUP BY c),
ins(state, more, to_, put) AS (VALUES ('E', '', 'E', []), ('E', 'I', 'U', ['user:']), ('E', 'II', 'A', ['user:', 'assistant:']), ('S', '', 'S', []), ('S', 'I', 'U', ['user:']), ('S', 'II', 'A', ['user:', 'assistant:']),
  ('U', '', 'U', []), ('U', 'I', 'A', ['assistant:']), ('U', 'II', 'U', ['assistant:', 'user:']), ('A', '', 'A', []), ('A', 'I', 'U', ['user:']), ('A', 'II', 'A', ['user:', 'assistant:'])),
ops(state, op, r1, to_, cost, name) AS (VALUES ('E', 'D', '', 'E', 4, ''), ('S', 'D', '', 'S', 4, ''), ('U', 'D', '', 'U', 4, ''), ('A', 'D', '', 'A', 4, ''), ('E', 'K', 's', 'S', 0, ''), ('E', 'K', 'u', 'U', 0, ''), ('S', 'K', 'u', 'U', 0, ''),
  ('U', 'K', 'a', 'A', 0, ''), ('A', 'K', 'u', 'U', 0, ''), ('E', 'R', '', 'U', 3, 'user'), ('S', 'R', '', 'U', 3, 'user'), ('U', 'R', '', 'A', 3, 'assistant'), ('A', 'R', '', 'U', 3, 'user')),
walk(c, i, state, w) AS (SELECT c, 0::BIGINT, 'E', {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} FROM counts
  UNION ALL SELECT walk.c, turns.i, ops.to_, min({'cost': w.cost + 3 * len(more) + ops.cost + CASE WHEN op <> 'D' AND fault = 't' THEN 3 ELSE 0 END, 'audit': w.audit || more || op,
    'lines': list_concat(list_concat(w.lines, put), CASE op WHEN 'D' THEN []::VARCHAR[] WHEN 'K' THEN [turns.role || ':' || turns.text] ELSE [name || ':' || turns.text] END)})
  FROM walk JOIN turns ON turns.c = walk.c AND turns.i = walk.i + 1 JOIN ins ON ins.state = walk.state JOIN ops ON ops.state = ins.to_ AND (op = 'D' OR fault NOT IN ('b', 'd') AND (op = 'R' OR ops.r1 = turns.r1)) GROUP BY walk.c, turns.i, ops.to_),
ends AS (SELECT walk.c, min({'cost': w.cost + 3 * len(more), 'audit': w.audit || more, 'lines': list_concat(w.lines, put)}) AS w FROM walk JOIN counts ON counts.c = walk.c AND i = last JOIN ins ON ins.state = walk.state AND to_ IN ('E', 'A') GROUP BY walk.c),
alls AS (SELECT DISTINCT conv_id, c FROM raw)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  coalesce(w.cost, 0)::BIGINT AS cost, coalesce(w.audit, '') AS audit, sha256(coalesce(array_to_string(w.lines, chr(10)), '')) AS repaired_sha256
FROM alls LEFT JOIN counts USING (c) LEFT JOIN ends USING (c)"""
