"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols (insult, threat, target, negation, report, other) and clauses strings of symbols that end
in an end symbol. Four small transducers read them: one tracks the scope of a negation (three words), one
reported speech (to the end of the clause), one whether a target is named, one passes insults and threats on.
``compose`` multiplies them into one machine, and ``clause_scores`` runs it: each matched insult or threat adds
its weight to the cell (negated?, reported?, targeted?) of its clause. A document's score is a logistic function
of these clause sums, their maximum and their density; nothing depends on isolated words outside the grammar.

Insult terminals (stems and whole words, any language) and their weights are learned from labelled rows: the log
odds of documents that hold them. Threats, targets, negations and reports are fixed lists of common words. Terms
are learned on one half of the labelled sample and the logistic weights on the other. Bounds: SAMPLE labelled
rows, TERMS terminals; what tasks receive is bounded by these. Scores cover every whole text.

Defined results: null and empty texts score as texts without a match; rows with a null label or null text teach
nothing; without labels of both kinds every text scores the base rate (0 with no labels at all); equal texts
score equally; labels, language, source and id are never inputs of a score.
"""

from __future__ import annotations

import itertools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table

SAMPLE, TERMS = 40_000, 400
SHORTEST, LONGEST = 4, 7
LEAST_DOCS, LEAST_SHARE, LEAST_GAIN, LEAST_ODDS = 3, 0.01, 20.0, math.log(4.0)

# Common words of the four languages.
THREATS = frozenset("kill hurt destroy punish burn hang beat töten vernichten umbringen tuer détruire frapper matar destruir golpear".split())
TARGETS = frozenset("you your yours he she they them him her du dein ihr euch sie er tu toi vous votre ils elle elles tú tu usted ustedes él ellos ellas".split())
NEGATIONS = frozenset("not never no isn aren wasn don doesn nicht kein keine nie pas jamais aucun no nunca jamás ningún".split())
REPORTS = frozenset("said says called calls wrote claimed quoted sagte sagt nannte schrieb dit disait appelé écrit dijo dice llamó escribió".split())

INSULT, THREAT, TARGET, NEGATION, REPORT, OTHER, END = range(7)
CLAUSE, WORD = re.compile(r"[.!?;:\n]+"), re.compile(r"[^\W\d_]+")


@dataclass
class Transducer:
    """arcs[state][symbol] = (next state, output); outputs of a composition are tuples."""

    arcs: list[list[tuple[int, tuple]]]


def compose(*machines: Transducer) -> Transducer:
    """The product machine, which reads one symbol with all of them and puts their outputs side by side."""
    states = list(itertools.product(*(range(len(m.arcs)) for m in machines)))
    number = {s: i for i, s in enumerate(states)}
    arcs = []
    for s in states:
        row = []
        for symbol in range(7):
            steps = [m.arcs[q][symbol] for m, q in zip(machines, s)]
            row.append((number[tuple(q for q, _ in steps)], tuple(itertools.chain.from_iterable(o for _, o in steps))))
        arcs.append(row)
    return Transducer(arcs)


def _machine(states: int, step) -> Transducer:
    return Transducer([[step(q, s) for s in range(7)] for q in range(states)])


HIT = _machine(1, lambda q, s: (0, (s in (INSULT, THREAT),)))
NEGATED = _machine(4, lambda q, s: (0 if s == END else 3 if s == NEGATION else max(0, q - 1), (q > 0,)))
REPORTED = _machine(2, lambda q, s: (0 if s == END else int(q or s == REPORT), (bool(q),)))
TARGETED = _machine(2, lambda q, s: (0 if s == END else int(q or s == TARGET), (bool(q or s == TARGET),)))
GRAMMAR = compose(HIT, NEGATED, REPORTED, TARGETED)


@dataclass
class Model:
    terms: dict[str, float] = field(default_factory=dict)
    weights: np.ndarray | None = None
    base: float = 0.0

    def __post_init__(self):
        self.heads = frozenset(t.rstrip("$")[:SHORTEST] for t in self.terms) | frozenset(t[:SHORTEST] for t in THREATS)

    def symbol(self, word: str) -> tuple[int, float]:
        if word[:SHORTEST] in self.heads:
            w = self.terms.get(f"{word}$")
            for n in range(LONGEST, SHORTEST - 1, -1):
                if w is not None:
                    break
                if len(word) >= n:
                    w = self.terms.get(word[:n])
            if w is not None:
                return INSULT, w
            if word in THREATS:
                return THREAT, 1.0
        if word in TARGETS:
            return TARGET, 0.0
        if word in NEGATIONS:
            return NEGATION, 0.0
        return (REPORT, 0.0) if word in REPORTS else (OTHER, 0.0)

    def clause_scores(self, text: str) -> Iterator[np.ndarray]:
        """For each clause with a match, the sums [negated, reported, targeted]."""
        for clause in CLAUSE.split(text):
            words = WORD.findall(clause)
            if not any(w[:SHORTEST] in self.heads for w in words):
                continue
            state, hits = 0, []
            for w in words:
                symbol, weight = self.symbol(w)
                state, (hit, negated, reported, _) = GRAMMAR.arcs[state][symbol]
                if hit:
                    hits.append((negated, reported, weight))
            if hits:
                targeted = GRAMMAR.arcs[state][END][1][3]
                out = np.zeros((2, 2, 2))
                for negated, reported, weight in hits:
                    out[int(negated), int(reported), int(targeted)] += weight
                yield out

    def features(self, text: str | None) -> np.ndarray:
        low = (text or "").lower()
        words = WORD.findall(low)
        x = np.zeros(8)
        x[0] = 1.0
        if not any(w[:SHORTEST] in self.heads for w in set(words)):
            return x
        clauses = list(self.clause_scores(low))
        if clauses:
            total = np.sum(clauses, axis=0)
            plain, peak = total[0, 0].sum(), max(c.sum() for c in clauses)
            x[1:] = np.log1p(plain), np.log1p(total[:, :, 1].sum()), np.log1p(total[1].sum()), np.log1p(total[:, 1].sum()), np.log1p(peak), np.log1p(100 * total.sum() / len(words)), np.log1p(len(clauses))
        return x

    def score(self, text: str | None) -> float:
        if self.weights is None:
            return self.base
        return float(1 / (1 + np.exp(-np.clip(self.features(text) @ self.weights, -30, 30))))


def _terms_of(text: str) -> set[str]:
    words = set(WORD.findall(text.lower()))
    out = {f"{w}$" for w in words if len(w) <= 24}
    for n in range(SHORTEST, LONGEST + 1):
        out.update(w[:n] for w in words if len(w) >= n)
    return out


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a small ridge."""
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3] + [0.05] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(rows: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", sample: int = SAMPLE, terms: int = TERMS) -> Model:
    """Learns terminals and weights from at most about ``sample`` of the labelled rows, chosen by a hash of the id."""
    known = rows.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("int").alias("y"), F.xxhash64(F.col(id_col), F.lit(5)).alias("h")).dropna().where("y in (0, 1)")
    n = known.count()
    unit = F.shiftrightunsigned("h", 11) / float(2**53)
    known = known.where(unit <= min(1.0, sample / max(1, n)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (Counter(), Counter())
        for b in batches:
            for y, text in zip(b.column(1).to_pylist(), b.column(0)):
                held[y].update(_terms_of(text.as_py()))
        names = [t for t in held[1] | held[0]]
        for i in range(0, len(names), 1 << 16):
            part = names[i : i + (1 << 16)]
            yield pa.RecordBatch.from_pydict({"term": part, "bad": [held[1][t] for t in part], "good": [held[0][t] for t in part]}, schema=pa.schema([("term", pa.string()), ("bad", pa.int64()), ("good", pa.int64())]))

    first, second = known.where("pmod(h, 2) = 0").select("text", "y"), known.where("pmod(h, 2) = 1").select("text", "y")
    sums = {r["y"]: r["n"] for r in first.groupBy("y").agg(F.count("*").alias("n")).collect()}
    bad, good = sums.get(1, 0), sums.get(0, 0)
    if not bad or not good:
        return Model(base=bad / (bad + good) if bad + good else 0.0)
    # log-likelihood gain of knowing the term
    part = lambda k, of: F.when(k > 0, k * F.ln(k / of)).otherwise(0.0)
    a, c, all_ = F.col("bad").cast("double"), F.col("good").cast("double"), float(bad + good)
    expected = lambda total: (a + c) * (total / all_)
    gain = 2 * (part(a, expected(bad)) + part(c, expected(good)) + part(bad - a, bad - expected(bad)) + part(good - c, good - expected(good)))
    odds = F.ln((a + 0.5) / (bad + 1.0)) - F.ln((c + 0.5) / (good + 1.0))
    found = first.mapInArrow(count, "term string, bad long, good long").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = found.where(F.col("bad") >= max(LEAST_DOCS, LEAST_SHARE * bad)).select("term", odds.alias("odds"), gain.alias("gain")).where((F.col("odds") >= LEAST_ODDS) & (F.col("gain") >= LEAST_GAIN))
    learned = Model({r["term"]: r["odds"] for r in found.orderBy(F.desc("gain"), "term").limit(terms).collect()})

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([learned.features(t.as_py()).tolist() for t in b.column(0)], pa.list_(pa.float64())), b.column(1)], names=["x", "y"])

    got = second.mapInArrow(measure, "x array<double>, y int").collect()  # eight numbers for each row of the bounded sample
    if len({r["y"] for r in got}) == 2:
        learned.weights = _fit(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float))
    else:
        learned.base = bad / (bad + good)
    return learned


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t.as_py()) for t in b.column(1)], pa.float64())], names=[id_col, "score"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, score double")


def drop_toxic(docs: DataFrame, model: Model, bound: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that score below ``bound``, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(text_col)
            yield b.filter(pa.array([model.score(t.as_py()) < bound for t in b.column(at)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def held_out():
    """Which ids the contract holds out of training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, text, toxic of about ``sample`` labelled documents that aren't held out, chosen by a hash of the id.

    The ids are chosen before texts are read, so only the sample's texts move; the ids are broadcast, as they
    are at most twice ``sample`` (else, with labels repeated beyond that, joined by shuffle).
    """
    known = labels.select("doc_id", "toxic").dropna().where(~held_out()).where("toxic in (0, 1)")
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(6)), 11) / float(2**53)
    chosen = known.where(unit <= min(1.0, sample / max(1, known.count())))
    few = chosen.count() <= 2 * sample
    return materialise(docs.select("doc_id", "text").join(F.broadcast(chosen) if few else chosen, "doc_id"), "toxic-sample")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(labelled(docs, table(spark, sf_dir, "labels")))
    out = score(docs, model).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
