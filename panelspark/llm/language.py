"""Language identification by interpolated Kneser-Ney character models.

Per language, counts of character 4-grams over all training texts are summed by Spark, and lower orders are continuation
counts of all the 4-gram types. Discounts and context totals come from these full counts. The model then keeps the n-grams
that make up at least the share ``LEAST_SHARE`` of a language's counts of their order (so at most 1 / LEAST_SHARE of them,
however large the corpus is); what a context gives to n-grams that aren't kept goes to its lower order, so probabilities
still sum to one. The models are one set of sorted arrays of n-gram hashes with a row of log-probabilities (one column a
language); a text's score under each language is its cross-entropy per character, the lowest wins. The temperature that
turns entropies into a probability, and the entropy above which a language's own texts are rarely found, are calibrated on
all training rows, whole texts; texts beyond either bound are marked ``rejected`` (the best language is
still named).

Bounds: at most MOST_LANGUAGES languages (an error beyond). Counts and calibration cover every training row; of the calibration
one row of sums and one quantile a language come to the driver.

Defined results: null texts and texts without a letter (emoji and digits have none) are ``und`` with score 0; rows with a
null language or null text teach nothing; with no training rows every text is ``und``; ties go to the language that sorts
first; letters are compared in lower case, everything else counts as one space; letters beyond the basic plane share
4,096 numbers.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.operators.ranks import quantiles

from .common import materialise, table

LEAST_SHARE, MOST_LANGUAGES = 1e-7, 200
#: Of these the temperature with the least loss over all training rows is taken; a language with fewer rows than ROWS_FOR_USUAL has no bound.
TEMPERATURES, ROWS_FOR_USUAL = (0.01, 0.02, 0.05, 0.1, 0.2, 0.5, 1.0), 20
STRIDE = 1 << 21  # code units in memory at once
_PAD = np.array([1, 1, 1], np.uint16)
_M16 = np.uint64(0xFFFF)


@cache
def _letters() -> np.ndarray:
    """The number of each code point: itself for a letter of the basic plane, one of 4,096 for other letters, 32 for all else."""
    cps = np.arange(0x110000, dtype=np.uint32)
    letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return np.where(letter, np.where(cps < 0x10000, cps, 0xE000 + (cps & 0xFFF)), 32).astype(np.uint16)


def units(text: str) -> np.ndarray:
    """The text as 16-bit units: padding, lower-case letters, one space for anything between."""
    x = _letters()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)]
    space = x == 32
    keep = np.ones(len(x), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    return np.concatenate([_PAD, x[keep], np.array([32], np.uint16)])


def has_letter(own: np.ndarray) -> bool:
    return bool((own[3:] != 32).any())


def grams(x: np.ndarray) -> np.ndarray:
    """The 4-gram ending at each unit after the padding, as 64-bit numbers."""
    y = x.astype(np.uint64)
    return y[:-3] << np.uint64(48) | y[1:-2] << np.uint64(32) | y[2:-1] << np.uint64(16) | y[3:]


def count_grams(train: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """lang, gram (as a signed long), n over every training row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def out():
            for lang, parts in held.items():
                g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(at, np.concatenate([p[1] for p in parts])).astype(np.int64)
                yield lang, g, n

        for b in batches:
            waiting: dict[str, list] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
                w = waiting.setdefault(lang, [])
                w.append(grams(units(text.as_py())))
                if sum(map(len, w[-1:])) and sum(map(len, w)) > STRIDE:
                    held.setdefault(lang, []).append(np.unique(np.concatenate(w), return_counts=True))
                    waiting[lang] = []
            for lang, w in waiting.items():
                if w:
                    held.setdefault(lang, []).append(np.unique(np.concatenate(w), return_counts=True))
            size = sum(len(p[0]) for parts in held.values() for p in parts)
            if size > 4 * STRIDE:
                held = {lang: [(g, n)] for lang, g, n in out()}
        for lang, g, n in out():
            for i in range(0, len(g), 1 << 16):
                part = slice(i, i + (1 << 16))
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g[part]), pa.string()), pa.array(g[part].view(np.int64)), pa.array(n[part])], names=["lang", "gram", "n"])

    rows = train.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def shares(counts: DataFrame, least_share: float = LEAST_SHARE) -> DataFrame:
    """lang, level (4 to 1), gram, top (its discounted share of its context), held (what the context gives to lower orders, grams that
    aren't kept included) of the n-grams that the model keeps. All sums are over all counts."""
    # the 4-gram types' endings are the continuation counts of the orders below
    orders, types = {4: counts}, counts.select("lang", "gram")
    for level in (3, 2, 1):
        types = types.select("lang", F.col("gram").bitwiseAND(F.lit((1 << 16 * level) - 1)).alias("gram"))
        orders[level] = types.groupBy("lang", "gram").agg(F.count("*").alias("n"))
        types = orders[level].select("lang", "gram")
    out = None
    for level, c in orders.items():
        one, two = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
        d = F.when((one > 0) & (two > 0), one / (one + 2 * two)).otherwise(0.5)
        sums = c.groupBy("lang").agg(d.alias("d"), (F.sum("n") * least_share).alias("least"))  # a row for each language
        each = c.join(F.broadcast(sums), "lang").withColumn("context", F.shiftrightunsigned("gram", 16) if level > 1 else F.lit(0).cast("long"))
        kept = F.when(F.col("n") >= F.col("least"), F.greatest(F.col("n") - F.col("d"), F.lit(0.0)))
        totals = each.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum(kept).alias("given")).where("given IS NOT NULL")
        met = each.where(kept.isNotNull()).join(totals, ["lang", "context"])
        rows = met.select("lang", F.lit(level).alias("level"), "gram", (kept / F.col("total")).alias("top"), (1 - F.col("given") / F.col("total")).alias("held"))
        out = rows if out is None else out.unionByName(rows)
    return out


class Models:
    """Kneser-Ney models of several languages over shared sorted hash arrays."""

    def __init__(self, langs: list[str], built: list[dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]]):
        """``built``: per language and order the n-grams, their discounted shares, and what their contexts hold back."""
        self.langs = langs
        # per order, the n-grams that any language has, and what each language gives them
        lower = None
        for order in (1, 2, 3, 4):
            grams_ = np.unique(np.concatenate([b[order][0] for b in built]))
            mask = np.uint64((1 << 16 * (order - 1)) - 1)
            contexts = np.unique(grams_ >> np.uint64(16)) if order > 1 else np.zeros(1, np.uint64)
            p = np.zeros((len(grams_), len(built)))
            back = np.ones((len(contexts), len(built)))
            for i, b in enumerate(built):
                g, top, held = b[order]
                p[np.searchsorted(grams_, g), i] = top
                if order > 1:
                    back[np.searchsorted(contexts, g >> np.uint64(16)), i] = np.maximum(held, 1e-12)
                elif len(g):
                    back[0, i] = max(held[0], 1e-12)
            if order == 1:
                p += back[0] / (1 << 12)  # an unseen unit gets a share of what is held back
            else:
                at = np.searchsorted(contexts, grams_ >> np.uint64(16))
                p += back[at] * self._low(lower, grams_ & mask, order - 1)
            lower = (grams_, p, contexts, back, lower)
        self.levels = []
        while lower:
            g, p, c, b, lower = lower
            order_by = np.argsort(self._hash(g))
            self.levels.append((self._hash(g)[order_by], np.log(p[order_by]).astype(np.float32), *self._sorted(c, np.log(b).astype(np.float32))))

    @staticmethod
    def _hash(g: np.ndarray) -> np.ndarray:
        x = g * np.uint64(0x9E3779B97F4A7C15)
        return x ^ (x >> np.uint64(32))

    def _sorted(self, c, b):
        o = np.argsort(self._hash(c))
        return self._hash(c)[o], b[o]

    @staticmethod
    def _low(level, g, order):
        """Full probabilities at a lower order (before hashing)."""
        keys, p, contexts, back, under = level
        at = np.minimum(np.searchsorted(keys, g), len(keys) - 1)
        hit = keys[at] == g
        out = p[at].copy()
        miss = ~hit
        if miss.any():
            if order == 1:
                out[miss] = back[0] / (1 << 12)
            else:
                c = np.minimum(np.searchsorted(contexts, g[miss] >> np.uint64(16)), len(contexts) - 1)
                lam = np.where((contexts[c] == g[miss] >> np.uint64(16))[:, None], back[c], 1.0)
                out[miss] = lam * Models._low(under, g[miss] & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
        return out

    def entropies(self, parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy per unit for each text (as units) and language, and how many units each text has."""
        lengths = np.array([len(p) - 3 for p in parts], np.int64)
        total = np.zeros((len(parts), len(self.langs)))
        for start, stop, some in self._strides(parts):
            # a long text comes in pieces of its own; pieces add up
            g = np.concatenate([grams(p) for p in some])
            logs = self._log(g, 0)
            ends = np.cumsum([len(p) - 3 for p in some])
            sums = np.add.reduceat(logs, np.concatenate([[0], ends[:-1]]), axis=0, dtype=np.float64)
            np.add.at(total, np.arange(start, stop), sums)
        return -total / lengths[:, None], lengths

    @staticmethod
    def _strides(parts):
        some, start, size = [], 0, 0
        for i, p in enumerate(parts):
            if len(p) > STRIDE:
                if some:
                    yield start, i, some
                for a in range(0, len(p) - 3, STRIDE):
                    yield i, i + 1, [p[a : a + STRIDE + 3]]
                some, start, size = [], i + 1, 0
                continue
            some.append(p)
            size += len(p)
            if size > STRIDE:
                yield start, i + 1, some
                some, start, size = [], i + 1, 0
        if some:
            yield start, len(parts), some

    def _log(self, g: np.ndarray, level: int) -> np.ndarray:
        """Each n-gram's log-probability in each language: looked up, or backed off and looked up below."""
        keys, logs, contexts, backs = self.levels[level]
        h = self._hash(g)
        at = np.searchsorted(keys, h)
        at[at == len(keys)] = 0
        out = logs[at]
        miss = np.flatnonzero(keys[at] != h)
        if len(miss):
            if level == 3:
                out[miss] = backs[0] - np.float32(np.log(1 << 12))
            else:
                below = g[miss] & np.uint64((1 << 16 * (3 - level)) - 1)
                c = np.searchsorted(contexts, self._hash(g[miss] >> np.uint64(16)))
                c[c == len(contexts)] = 0
                known = contexts[c] == self._hash(g[miss] >> np.uint64(16))
                out[miss] = np.where(known[:, None], backs[c], np.float32(0)) + self._log(below, level + 1)
        return out


class Identifier:
    """Models with their calibration: temperature, and the highest entropy usual in each language."""

    def __init__(self, models: Models | None, temperature: float = 1.0, usual: np.ndarray | None = None, least: float = 0.5):
        self.models, self.temperature, self.usual, self.least = models, temperature, usual, least

    @staticmethod
    def probability(h: np.ndarray, n: np.ndarray, temperature: float) -> np.ndarray:
        x = -(h - h.min(axis=1, keepdims=True)) * np.minimum(n, 200)[:, None] * temperature
        p = np.exp(x)
        return p / p.sum(axis=1, keepdims=True)

    def identify(self, texts: list[str | None]) -> list[tuple[str, float, float | None, bool]]:
        """(language or und, score, cross-entropy, rejected) of each text."""
        out: list = [("und", 0.0, None, True)] * len(texts)
        parts = {i: x for i, t in enumerate(texts) if t and has_letter(x := units(t))}
        if not parts or self.models is None:
            return out
        h, n = self.models.entropies(list(parts.values()))
        p, best = self.probability(h, n, self.temperature), h.argmin(axis=1)
        for k, i in enumerate(parts):
            b, score, e = best[k], float(p[k, best[k]]), float(h[k, best[k]])
            out[i] = (self.models.langs[b], score, e, bool(score < self.least or (self.usual is not None and e > self.usual[b])))
        return out


def from_counts(counts: DataFrame, least_share: float = LEAST_SHARE) -> Models | None:
    """The models of counts (lang, gram, n); None without any."""
    langs = [r[0] for r in counts.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect()]
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    if not langs:
        return None
    langs.sort()
    kept = shares(counts, least_share).toPandas()  # at most 1 / least_share n-grams of a language and order
    built = []
    for lang in langs:
        own = kept[kept["lang"] == lang]
        levels = {}
        for level in (1, 2, 3, 4):
            x = own[own["level"] == level]
            g = x["gram"].to_numpy(np.int64).view(np.uint64)
            o = np.argsort(g)
            levels[level] = (g[o], x["top"].to_numpy(float)[o], x["held"].to_numpy(float)[o])
        built.append(levels)
    return Models(langs, built)


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", least_share: float = LEAST_SHARE) -> Identifier:
    models = from_counts(materialise(count_grams(rows, text_col, lang_col), "lang-counts"), least_share)
    if models is None:
        return Identifier(None)
    return Identifier(models, *calibrated(rows, models, text_col, lang_col))


def calibrated(rows: DataFrame, models: Models, text_col: str = "text", lang_col: str = "lang") -> tuple[float, np.ndarray]:
    """The temperature of the least mean loss, and 1.25 times the 0.99 quantile of each language's entropies of its own texts.

    Every row with a language and a letter counts; losses are summed and quantiles counted by Spark.
    """
    shared = rows.sparkSession.sparkContext.broadcast(models)
    losses = [f"l{i}" for i in range(len(TEMPERATURES))]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {x: i for i, x in enumerate(shared.value.langs)}
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = [(number[x], u) for x, t in zip(part.column(0).to_pylist(), part.column(1)) if has_letter(u := units(t.as_py()))]
                if texts:
                    h, n = shared.value.entropies([u for _, u in texts])
                    at, own = np.arange(len(texts)), np.array([x for x, _ in texts], np.int32)
                    loss = [-np.log(np.maximum(Identifier.probability(h, n, t)[at, own], 1e-9)) for t in TEMPERATURES]
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(h[at, own]), *map(pa.array, loss)], names=["own", "h", *losses])

    known = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).dropna()
    found = materialise(known.mapInArrow(measure, ", ".join(["own int", "h double", *[f"{c} double" for c in losses]])), "lang-entropies")
    sums = found.agg(*[F.sum(c).alias(c) for c in losses]).head()
    usual = np.full(len(models.langs), np.inf)
    if sums[0] is None:  # no text with a letter
        return 1.0, usual
    # a row for each language
    sizes = {r["own"]: r["count"] for r in found.groupBy("own").count().collect()}
    for r in quantiles(found.select("own", "h"), "h", ["own"], {"q": 0.99}).collect():
        if sizes[r["own"]] >= ROWS_FOR_USUAL:
            usual[r["own"]] = r["q"] * 1.25
    return min(zip(sums, TEMPERATURES))[1], usual


def identify(docs: DataFrame, model: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, lang_pred, score, entropy, rejected for every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                part = b.slice(i, 1000)
                lang, score, entropy, rejected = zip(*shared.value.identify(part.column(1).to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(entropy, pa.float64()), pa.array(rejected, pa.bool_())], names=[id_col, "lang_pred", "score", "entropy", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` long, lang_pred string, score double, entropy double, rejected boolean")


def held_out():
    """Which ids the contract holds out of training."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out()))
    return identify(docs, model).withColumn("held_out", held_out()).select("doc_id", "held_out", "lang_pred", "score", "entropy", "rejected")
