"""SentencePiece encoding and decoding by a relational lattice.

Texts are cut into units that no piece can cross (a run of spaces with the word after it). Each distinct unit of
the corpus gets its lattice once: substrings up to the longest piece are exploded, joined to the piece table by
equality, grouped by unit, and folded by Spark's higher-order ``aggregate``. For a unigram table the fold is
Viterbi's (best sum of scores). For a BPE table, such as piece_bpe_32k, the highest sum of scores is not what
SentencePiece returns, so the fold over the same lattice merges the best-scored neighbours step by step, which is.
Characters without a piece become bytes.

The lattice and its fold are made for the units that occur most (at most HOT of them, a checked bound; over nine in
ten of all occurrences), whose ids are then sent to the tasks. A unit beyond those, or longer than LONG code points,
is merged where it is met, by the same rule. ``join_rare`` sends every unit through the lattice instead and joins the
rare ones by shuffle; it gives the same ids, for several times the work (figures in the README).

Defined results: null and empty texts have no ids and decode to the empty text; a space and U+2581 are the same
to SentencePiece, so decoding gives the text with U+2581 as spaces; text that holds the name of a control or byte
piece is ordinary text; repeated rows are repeated; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import heapq
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hash_buckets, materialise, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
HOT, LONG, HELD, COUNTED, FAR = 150_000, 48, 200_000, 400_000, 1 << 30
BPE, UNIGRAM = "bpe", "unigram"
UNITS_A_TASK = 2000


@dataclass(frozen=True)
class Pieces:
    """A piece table: ordinary pieces with ids and scores, the ids of bytes, and how to fold."""

    names: tuple[str, ...]
    scores: tuple[float, ...]
    ordinary: tuple[bool, ...]
    kind: str = BPE

    @staticmethod
    def load(path: str, kind: str = BPE) -> Pieces:
        p = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(p.get_piece_size())
        plain = lambda i: not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))
        return Pieces(tuple(map(p.id_to_piece, ids)), tuple(map(p.get_score, ids)), tuple(map(plain, ids)), kind)

    @cached_property
    def rank(self) -> dict[str, tuple[int, int]]:
        """Each ordinary piece's (place by score, id); pieces of one score share a place."""
        order = {s: i for i, s in enumerate(sorted({self.scores[i] for i, o in enumerate(self.ordinary) if o}, reverse=True))}
        return {n: (order[self.scores[i]], i) for i, n in enumerate(self.names) if self.ordinary[i]}

    @cached_property
    def place(self) -> dict[str, int]:
        return {n: p for n, (p, _) in self.rank.items()}

    @cached_property
    def id(self) -> dict[str, int]:
        return {n: i for n, (_, i) in self.rank.items()}

    @cached_property
    def byte_ids(self) -> list[int]:
        at = {n: i for i, n in enumerate(self.names)}
        return [at.get(f"<0x{b:02X}>", at.get("<unk>", 0)) for b in range(256)]

    @cached_property
    def shown(self) -> list[bytes]:
        """What each id stands for in UTF-8: a piece's text, a byte, or nothing."""
        byte = {i: bytes([b]) for b, i in enumerate(self.byte_ids)}
        return [n.replace(SPACE, " ").encode() if o else byte.get(i, b"") for i, (n, o) in enumerate(zip(self.names, self.ordinary))]

    @cached_property
    def longest(self) -> int:
        return max(len(n) for n in self.rank)

    @cached_property
    def unit(self) -> re.Pattern:
        """Units: spaces with the run of characters after them that pieces can join.

        Characters that stand side by side in a piece are of one class, and so are those that these stand beside;
        no piece crosses from one class to another (or to a character that no longer piece holds).
        """
        root: dict[str, str] = {}

        def find(c: str) -> str:
            while root.setdefault(c, c) != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for name in self.rank:
            inner = name.lstrip(SPACE)
            for a, b in zip(inner, inner[1:]):
                root[find(a)] = find(b)
            if name[:1] == SPACE and inner:
                find(inner[0])
        classes: dict[str, list[str]] = {}
        for c in sorted(root):
            classes.setdefault(find(c), []).append(c)
        order = sorted(classes.values(), key=len, reverse=True)
        many = [f"[{re.escape(''.join(c))}]+" for c in order if len(c) > 1]
        alone = "".join(c[0] for c in order if len(c) == 1)
        if alone:
            many.append(f"[{re.escape(alone)}]")
        every = re.escape("".join(sorted(root)))
        return re.compile(f"{SPACE}*(?:{'|'.join(many)})|{SPACE}+|[^{every}{SPACE}]+" if many else f"{SPACE}+|[^{SPACE}]+")

    def chunks(self, text: str | None) -> list[str]:
        """The text cut before each run of spaces; of the run all but the first space stay, as SPACE."""
        if not text:
            return []
        parts = (text.replace(SPACE, " ") if SPACE in text else text).split(" ")
        if "" not in parts:
            return parts
        out, spaces = [], 0
        for x in parts[:-1]:
            if x:
                out.append(SPACE * spaces + x)
            spaces = 0 if x else spaces + 1
        out.append(SPACE * spaces + parts[-1])
        return out

    def units_of(self, chunk: str) -> list[str]:
        return self.unit.findall(SPACE + chunk)

    def units(self, text: str | None) -> list[str]:
        return [u for c in self.chunks(text) for u in self.units_of(c)]

    def merge(self, unit: str) -> list[int]:
        """The ids of one unit by BPE: the best-scored neighbours join, the leftmost of equals, until none do."""
        return self._merge_long(unit) if len(unit) > LONG else self._merge_short(unit)

    def _ids_of(self, parts) -> list[int]:
        ids, out = self.id, []
        for x in parts:
            if (i := ids.get(x)) is not None:
                out.append(i)
            else:
                out += [self.byte_ids[b] for b in x.encode("utf-8", "surrogatepass")]
        return out

    def _merge_short(self, unit: str) -> list[int]:
        """Scans all neighbours for the best at each step, which is fastest for a few dozen characters."""
        parts, place = list(unit), self.place
        made = [place.get(a + b, FAR) for a, b in zip(parts, parts[1:])]
        while made and (best := min(made)) < FAR:
            i = made.index(best)
            parts[i] += parts.pop(i + 1)
            del made[i]
            if i < len(made):
                made[i] = place.get(parts[i] + parts[i + 1], FAR)
            if i:
                made[i - 1] = place.get(parts[i - 1] + parts[i], FAR)
        return self._ids_of(parts)

    def _merge_long(self, unit: str) -> list[int]:
        """Keeps a queue of pairs, so that a unit of any length takes little more than linear time."""
        parts, nxt, prev = list(unit), list(range(1, len(unit) + 1)), list(range(-1, len(unit) - 1))
        queue: list = []

        def offer(a: int) -> None:
            b = nxt[a]
            if b < len(parts) and (r := self.rank.get(parts[a] + parts[b])):
                heapq.heappush(queue, (r[0], a, parts[a] + parts[b]))

        for a in range(len(parts)):
            offer(a)
        while queue:
            _, a, whole = heapq.heappop(queue)
            if not parts[a] or nxt[a] >= len(parts) or parts[a] + parts[nxt[a]] != whole:
                continue
            b = nxt[a]
            parts[a], parts[b], nxt[a] = whole, "", nxt[b]
            if nxt[a] < len(parts):
                prev[nxt[a]] = a
            offer(a)
            if prev[a] >= 0:
                offer(prev[a])
        return self._ids_of(filter(None, parts))

    @cached_property
    def symbols(self) -> np.ndarray:
        """The number of each code point: a piece's id, a number after the ids, or the last number for all others."""
        chars = {c for n in self.rank for c in n}
        more = {c: len(self.names) + i for i, c in enumerate(sorted(chars - self.id.keys()))}
        number = np.full(0x110000, len(self.names) + len(more), np.int64)
        for c in chars:
            number[ord(c)] = more.get(c, self.id.get(c))
        return number

    @cached_property
    def none(self) -> int:
        """The number of what no piece holds."""
        return int(self.symbols[0x10FFFF])

    @cached_property
    def joins(self) -> tuple[np.ndarray, np.ndarray]:
        """Sorted keys of the pairs of symbols that make a piece; place * 2^32 + id of that piece."""
        of = lambda x: self.id[x] if x in self.id else int(self.symbols[ord(x)]) if len(x) == 1 else -1
        pairs = [(of(n[:k]), of(n[k:]), p << 32 | i) for n, (p, i) in self.rank.items() for k in range(1, len(n))]
        found = np.array(sorted((a * (self.none + 1) + b, v) for a, b, v in pairs if a >= 0 and b >= 0) or [(-1, FAR << 32)], np.int64)
        return found[:, 0].copy(), found[:, 1].copy()

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """place * 2^32 + id of what these symbols make together."""
        keys, values = self.joins
        asked = left * (self.none + 1) + right
        at = np.minimum(np.searchsorted(keys, asked), len(keys) - 1)
        return np.where(keys[at] == asked, values[at], FAR << 32)

    def _merge_rows(self, units: list[str]) -> list[bytes]:
        """``merge`` for many units at once: a row of symbols each, one step of all rows after the other."""
        left = np.fromiter(map(len, units), np.int64, len(units))
        inside = np.arange(int(left.max()) + 1) < left[:, None]
        rows = np.full(inside.shape, self.none, np.int64)
        rows[inside] = self.symbols[np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32)]
        out, active, made = rows.copy(), np.arange(len(units)), self._made(rows[:, :-1], rows[:, 1:])
        while len(active):
            # equal places: id must not decide, the leftmost does
            best = (made >> 32).argmin(axis=1)
            value = made[np.arange(len(active)), best]
            go = value >> 32 < FAR
            if not go.all():
                out[active[~go]] = rows[~go]
                active, rows, made, best, value = active[go], rows[go], made[go], best[go], value[go]
            each, after = np.arange(len(active)), np.arange(rows.shape[1]) > best[:, None]
            rows[:, :-1] = np.where(after[:, :-1], rows[:, 1:], rows[:, :-1])
            rows[:, -1] = self.none
            rows[each, best] = value & 0xFFFFFFFF
            made[:, :-1] = np.where(after[:, 1:-1], made[:, 1:], made[:, :-1])
            made[:, -1] = FAR << 32
            made[each, best] = self._made(rows[each, best], rows[each, best + 1])
            before = np.maximum(best - 1, 0)
            made[each, before] = self._made(rows[each, before], rows[each, before + 1])
            left[active] -= 1
        filled = np.arange(out.shape[1]) < left[:, None]
        plain = ((out < len(self.names)) | ~filled).all(axis=1)
        data, ends = out[filled].astype(np.int32).tobytes(), (np.cumsum(left) * 4).tolist()
        return [data[a:b] if p else array("i", self.merge(u)).tobytes() for a, b, p, u in zip([0, *ends], ends, plain.tolist(), units)]

    def packed(self, units: list[str]) -> list[bytes]:
        """The ids of each unit as 32-bit integers; units of like lengths are merged together."""
        order = sorted(range(len(units)), key=lambda i: len(units[i]))
        out: list[bytes] = [b""] * len(units)
        for most in (8, 12, 20, LONG, None):
            cut = len(order) if most is None else bisect.bisect_right(order, most, key=lambda i: len(units[i]))
            now, order = order[:cut], order[cut:]
            for a in range(0, len(now), 1 << 13):
                at = now[a : a + (1 << 13)]
                part = [units[i] for i in at]
                alone = most is None or self.kind != BPE
                for i, x in zip(at, [array("i", self.ids(u)).tobytes() for u in part] if alone else self._merge_rows(part)):
                    out[i] = x
        return out

    def viterbi(self, unit: str) -> list[int]:
        """The ids of one unit with the best sum of scores (for long units, and to test the fold)."""
        best: list = [(0.0, [])]
        for end in range(1, len(unit) + 1):
            ways = [(best[s][0] + self.scores[r[1]], best[s][1], [r[1]]) for s in range(max(0, end - self.longest), end) if (r := self.rank.get(unit[s:end]))]
            if unit[end - 1] not in self.rank:
                ways.append((best[end - 1][0] + self.unknown, best[end - 1][1], [self.byte_ids[b] for b in unit[end - 1].encode("utf-8", "surrogatepass")]))
            top = max(ways, key=lambda w: w[0])  # the longest of equals: starts are tried in order
            best.append((top[0], top[1] + top[2]))
        return best[-1][1]

    @cached_property
    def unknown(self) -> float:
        """A score below every piece's, for a character without a piece."""
        return min(s for s, o in zip(self.scores, self.ordinary) if o) - 10.0

    def ids(self, unit: str) -> list[int]:
        return self.merge(unit) if self.kind == BPE else self.viterbi(unit)

    def decode(self, ids) -> str:
        """The text of these ids; the space that encoding puts first is taken away."""
        text = b"".join(map(self.shown.__getitem__, ids)).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text


def piece_table(spark: SparkSession, pieces: Pieces) -> DataFrame:
    """piece, place, id, score; the empty piece stands for a unit's own row."""
    rows = [(n, p, i, float(pieces.scores[i])) for n, (p, i) in pieces.rank.items()]
    return spark.createDataFrame([*rows, ("", -1, -1, 0.0)], "piece string, place int, id int, score double")


def lattice(units: DataFrame, pieces: Pieces) -> DataFrame:
    """unit, n and edges: array of (at = start * 64 + length, place, id, score) over the pieces in the unit."""
    start = F.explode(F.sequence(F.lit(0), F.char_length("unit") - 1)).alias("start")
    longest = F.least(F.lit(pieces.longest), F.char_length("unit") - F.col("start"))
    length = F.explode(F.sequence(F.when(F.col("start") == 0, 0).otherwise(1), longest)).alias("length")
    parts = units.select("unit", "n", start).select("unit", "n", "start", length).withColumn("piece", F.substring("unit", F.col("start") + 1, F.col("length")))
    met = parts.join(F.broadcast(piece_table(units.sparkSession, pieces)), "piece")
    edge = F.struct((F.col("start") * 64 + F.col("length")).alias("at"), "place", "id", "score")
    return met.groupBy("unit").agg(F.first("n").alias("n"), F.collect_list(edge).alias("edges"))


def _bytes(char: Column, byte_ids: list[int]) -> Column:
    """The ids of a character's bytes."""
    code = F.hex(F.encode(char, "utf-8"))
    table_ = F.array(*[F.lit(i) for i in byte_ids])
    return F.transform(F.sequence(F.lit(0), F.octet_length(char) - 1), lambda k: F.element_at(table_, F.conv(F.substring(code, k * 2 + 1, F.lit(2)), 16, 10).cast("int") + 1))


def _let(value: Column, then) -> Column:
    """``then`` of ``value``, which is evaluated once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def fold(edges: Column, unit: Column, pieces: Pieces) -> Column:
    """The ids of a unit from its lattice, by ``aggregate``."""
    return _bpe(edges, unit, pieces) if pieces.kind == BPE else _viterbi(edges, unit, pieces)


def _bpe(edges: Column, unit: Column, pieces: Pieces) -> Column:
    """Merge the neighbours that make the best-scored piece, the leftmost of equals, until none do."""
    size, far = F.char_length(unit), FAR
    state = lambda cuts, done: F.struct(cuts.alias("cuts"), F.lit(done).alias("done"))

    def cuts_of(places: Column) -> Column:
        def made(cuts, i):  # the place of what the i-th and the next segment make
            start = F.get(cuts, i - 1)
            return F.coalesce(places[start * 64 + F.get(cuts, i + 1) - start], F.lit(far))

        def merged(cuts, scores):
            joined = lambda at: F.concat(F.slice(cuts, F.lit(1), at), F.slice(cuts, at + 2, F.size(cuts)))
            return _let(F.array_min(scores), lambda best: F.when(best == far, state(cuts, True)).otherwise(_let(F.array_position(scores, best).cast("int"), lambda at: state(joined(at), False))))

        def step(acc, _):
            cuts = acc["cuts"]
            scores = F.transform(F.sequence(F.lit(1), F.size(cuts) - 2), lambda i: made(cuts, i))
            return F.when(acc["done"] | (F.size(cuts) <= 2), state(cuts, True)).otherwise(_let(scores, lambda x: merged(cuts, x)))

        return F.aggregate(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), state(F.sequence(F.lit(0), size), False), step, lambda acc: acc["cuts"])

    def ids_of(cuts: Column, ids: Column) -> Column:
        def segment(i):
            start, end = F.get(cuts, i), F.get(cuts, i + 1)
            whole = ids[start * 64 + end - start]
            return F.when(whole.isNotNull(), F.array(whole)).otherwise(_bytes(F.substring(unit, start + 1, end - start), pieces.byte_ids))

        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(cuts) - 2), segment))

    by = lambda name: F.map_from_entries(F.transform(edges, lambda e: F.struct(e["at"], e[name])))
    return _let(_let(by("place"), cuts_of), lambda cuts: _let(by("id"), lambda ids: ids_of(cuts, ids)))


def _viterbi(edges: Column, unit: Column, pieces: Pieces) -> Column:
    """For each end in order the best way to it: ways[k] = (score, ids) of the first k characters."""
    size = F.char_length(unit)
    none = F.struct(F.lit(0.0).alias("score"), F.array().cast("array<int>").alias("ids"))
    way = "array<struct<score:double,length:int,ids:array<int>>>"

    def reach(ways, end):
        into = F.filter(edges, lambda e: (e["at"] % 64 > 0) & (F.floor(e["at"] / 64) + e["at"] % 64 == end))

        def step(e):
            before = F.get(ways, F.floor(e["at"] / 64).cast("int"))
            return F.struct((before["score"] + e["score"]).alias("score"), (e["at"] % 64).alias("length"), F.concat(before["ids"], F.array(e["id"])).alias("ids"))

        last, char = F.get(ways, end - 1), F.substring(unit, end, F.lit(1))
        by_bytes = F.struct((last["score"] + F.lit(pieces.unknown)).alias("score"), F.lit(0).alias("length"), F.concat(last["ids"], _bytes(char, pieces.byte_ids)).alias("ids"))
        every = lambda into: F.concat(F.transform(into, step), F.when(F.exists(into, lambda e: e["at"] % 64 == 1), F.array().cast(way)).otherwise(F.array(by_bytes)))
        top = _let(into, lambda x: F.array_max(every(x)))
        return _let(top, lambda t: F.array_append(ways, F.struct(t["score"].alias("score"), t["ids"].alias("ids"))))

    return F.aggregate(F.sequence(F.lit(1), size), F.array(none), reach, lambda ways: F.element_at(ways, -1)["ids"])


def distinct_units(docs: DataFrame, pieces: Pieces, text_col: str = "text") -> DataFrame:
    """unit, n: every unit of at most LONG code points, with its number over all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out():
            units: Counter = Counter()
            for chunk, n in held.items():
                for u in pieces.units_of(chunk):
                    units[u] += n
            held.clear()
            names, n = list(units), list(units.values())
            for i in range(0, len(names), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(names[i : i + (1 << 16)], pa.string()), pa.array(n[i : i + (1 << 16)], pa.int64())], names=["unit", "n"])

        for b in batches:
            for t in b.column(0):
                held.update(pieces.chunks(t.as_py()))
                if len(held) > COUNTED:
                    yield from out()
        yield from out()

    units = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "unit string, n long")
    return units.where(F.char_length("unit") <= LONG).groupBy("unit").agg(F.sum("n").alias("n"))


def dictionary(units: DataFrame, pieces: Pieces) -> DataFrame:
    """unit, n, ids: the encoding of each of these units."""
    return lattice(units, pieces).select("unit", "n", fold(F.col("edges"), F.col("unit"), pieces).alias("ids"))


def _often(words: DataFrame, most: int) -> int:
    """The least count such that at most ``most`` units occur more often (counts above 65,535 as one)."""
    total, at = 0, 1 << 16
    for r in sorted(words.groupBy(F.least("n", F.lit(1 << 16)).alias("n")).agg(F.count("*").alias("u")).collect(), reverse=True):
        total += r["u"]
        if total > most:
            return r["n"]
        at = r["n"]
    return at - 1


class Encoded(dict):
    """The packed ids of each chunk of common units met so far; of chunks with rarer units, those of the texts at hand."""

    def __init__(self, pieces: Pieces, common: dict[str, bytes]):
        super().__init__()
        self.pieces, self.common, self.now = pieces, common, {}

    def __missing__(self, chunk: str) -> bytes:
        return self.now[chunk]

    def learn(self, texts: list[list[str]], joined: Iterable[tuple[str, list[int]]] = ()) -> None:
        """Take in the chunks of these texts; ``joined``: units whose ids are known."""
        if len(self) > HELD:
            self.clear()
        common, rare = self.common, {u: array("i", ids).tobytes() for u, ids in joined}
        left = {}
        for chunk in {c for chunks in texts for c in chunks if c not in self}:
            units = self.pieces.units_of(chunk)
            try:
                self[chunk] = b"".join([common[u] for u in units])
            except KeyError:
                left[chunk] = units
        unmet = list({u for units in left.values() for u in units if u not in common and u not in rare})
        rare.update(zip(unmet, self.pieces.packed(unmet)))
        self.now = {chunk: b"".join([common.get(u) or rare[u] for u in units]) for chunk, units in left.items()}


def encode(docs: DataFrame, pieces: Pieces, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT, join_rare: bool = False, compare: bool = False) -> DataFrame:
    """id, text, ids of every whole text. ``join_rare``: rare units too go through the lattice and are joined.

    ``compare`` decodes the ids again where they were made and gives id, n_tokens, ids and round_trip (whether the
    decoded text is the text) instead, so that texts enter one Python worker a task and don't leave it.
    """
    spark = docs.sparkSession
    counts = materialise(distinct_units(docs, pieces, text_col), "piece-units")
    least = _often(counts, hot)
    often, seldom = counts.where(F.col("n") > least), counts.where(F.col("n") <= least)
    # the folds are far more work than bytes, so their partitions are numbered and stay as many
    dealt = lambda units: units.repartition(hash_buckets(units.count(), UNITS_A_TASK, 1), "unit")
    few = dictionary(dealt(often), pieces).select("unit", "ids").toPandas()  # at most ``hot`` short units
    words = materialise(dictionary(dealt(seldom), pieces), "piece-words") if join_rare else None
    known = spark.sparkContext.broadcast({u: np.asarray(i, np.int32).tobytes() for u, i in zip(few["unit"], few["ids"])})
    del few
    key = F.xxhash64(F.col(id_col), F.col(text_col).cast("string"))
    rows = docs.select(key.alias("key"), F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("text"))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common, seen = known.value, {}
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part, keys, units = b.slice(i, 500), [], []
                for k, t in zip(part.column(0).to_pylist(), part.column(1)):
                    own: set[str] = set()
                    for c in set(pieces.chunks(t.as_py())):
                        if (u := seen.get(c)) is None:
                            u = seen[c] = tuple(x for x in pieces.units_of(c) if x not in common and len(x) <= LONG)
                        own.update(u)
                    keys += [k] * len(own)
                    units += own
                    if len(seen) > HELD:
                        seen.clear()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(units, pa.string())], names=["key", "unit"])

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Encoded(pieces, known.value)
        for b in batches:
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                joined = [(k, v) for u, x in zip(part.column(3), part.column(4)) for k, v in zip(u.as_py() or (), x.as_py() or ())]
                texts = [pieces.chunks(t.as_py()) for t in part.column(2)]
                seen.learn(texts, joined)
                ids = [np.frombuffer(b"".join(map(seen.__getitem__, chunks)), np.int32) for chunks in texts]
                ends = np.cumsum([0, *map(len, ids)], dtype=np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32), pa.int32()))
                if not compare:
                    yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), lists], names=[id_col, "text", "ids"])
                    continue
                same = [pieces.decode(x.tolist()) == (t.as_py() or "").replace(SPACE, " ") for x, t in zip(ids, part.column(2))]
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(np.diff(ends), pa.int64()), lists, pa.array(same, pa.bool_())], names=[id_col, "n_tokens", "ids", "round_trip"])

    kind = docs.schema[id_col].dataType.simpleString()
    if words is None:
        both = rows.withColumns({"units": F.lit(None).cast("array<string>"), "found": F.lit(None).cast("array<array<int>>")})
    else:
        asked = rows.select("key", "text").mapInArrow(rare, "key long, unit string").join(words.select("unit", "ids"), "unit")
        both = rows.join(asked.groupBy("key").agg(F.collect_list("unit").alias("units"), F.collect_list("ids").alias("found")), "key", "left")
    return both.mapInArrow(put, f"`{id_col}` {kind}, " + ("n_tokens long, ids array<int>, round_trip boolean" if compare else "text string, ids array<int>"))


def decode(encoded: DataFrame, pieces: Pieces, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with decoded: the text of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(ids_col)
            for i in range(0, b.num_rows, 200):
                part = b.slice(i, 200)
                texts = [pieces.decode(x.values.to_numpy().tolist() if x.is_valid else ()) for x in part.column(at)]
                yield part.append_column("decoded", pa.array(texts, pa.string()))

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(run, f"{columns}, decoded string")


def encoded_documents(docs: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id, n_tokens, ids, and whether decoding gives the text back."""
    return encode(docs.select("doc_id", "text"), Pieces.load(model), compare=True)


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_documents(table(spark, sf_dir, "documents"))
