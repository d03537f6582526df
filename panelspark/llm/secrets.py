"""Secret scans with a trigram index, in Spark SQL functions only.

From every rule's regular expression a Boolean query over trigrams is derived: which trigrams any match must
hold (lower-cased). Texts are indexed by those trigrams (posting = trigram, text key), postings are intersected
per alternative and clause of each query, and only candidate texts are verified with the rule itself. A rule
without mandatory trigrams (the hexadecimal one) scans every text. Candidates are keyed by a hash of the text; a
collision only costs a verification. They are broadcast while few (a checked count), else joined by shuffle.

Positions come from the pieces between matches (``split``) and the matches themselves (``regexp_extract_all``);
they count code points.

Defined results: null text is the empty text and has no spans; matches of one rule don't overlap and are the
leftmost; those that fail a rule's length are dropped after they were taken; rows repeat as they come; null ids
are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from re import _constants as sre  # the tokens of Python's own pattern parser
from re import _parser

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, table


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules, then public formats of tokens.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
RULES = (
    *BASE,
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[sr]k_live_[0-9A-Za-z]{16,}"),
    Rule("login", r"(?<![a-z0-9+.-])[a-z][a-z0-9+.-]+://[^\s/:@]+:[^\s/:@]+@"),
)
#: Candidate texts up to this many are broadcast (a long and the names of a few rules each).
FEW_CANDIDATES = 1_000_000
MASK = "[SECRET]"
MOST_STRINGS = 64

Query = list[frozenset[frozenset[str]]]  # all clauses; of a clause any alternative; of an alternative all trigrams


def _strings(node) -> set[str] | None:
    """The strings that a part of a pattern can be, lower-cased, if they are few; else None."""
    op, arg = node
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN:
        chars: set[str] = set()
        for kind, value in arg:
            if kind is sre.LITERAL:
                chars.add(chr(value).lower())
            elif kind is sre.RANGE and value[1] - value[0] < 8:
                chars |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
            else:
                return None
        return chars if len(chars) <= 8 else None
    if op is sre.MAX_REPEAT and arg[1] <= 2:
        inner = _sequence(arg[2])
        if inner is None:
            return None
        out, longer = ({""} if arg[0] == 0 else set()), {""}
        for n in range(1, arg[1] + 1):
            longer = {a + b for a in longer for b in inner}
            if n >= arg[0]:
                out |= longer
        return out if len(out) <= MOST_STRINGS else None
    if op is sre.SUBPATTERN:
        return _sequence(arg[3])
    if op is sre.BRANCH:
        parts = [_sequence(p) for p in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    return None


def _sequence(nodes) -> set[str] | None:
    out = {""}
    for node in nodes:
        s = _strings(node)
        if s is None or len(out) * len(s) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in s}
    return out


def trigram_query(pattern: str) -> Query:
    """What any match of ``pattern`` must hold; no clauses: nothing is mandatory."""
    clauses: Query = []

    def close(run: set[str]) -> None:
        grams = [frozenset(x[i : i + 3] for i in range(len(x) - 2)) for x in run]
        if run and all(grams):
            clauses.append(frozenset(grams))

    def walk(nodes) -> None:
        run = {""}
        for node in nodes:
            s = _strings(node)
            if s is not None and len(run) * len(s) <= MOST_STRINGS:
                run = {a + b for a in run for b in s}
                continue
            close(run)
            run = s if s is not None else {""}
            if s is None and node[0] is sre.SUBPATTERN:
                walk(node[1][3])
            elif s is None and node[0] is sre.MAX_REPEAT and node[1][0] > 0:
                walk(node[1][2])
        close(run)

    walk(_parser.parse(pattern))
    return clauses


#: Letters of running text from the most common on; a trigram of rarer characters screens better.
COMMON = "etaoinsrhldcumfpgwybvkxjqz"


def screen_grams(rules: tuple[Rule, ...]) -> list[str]:
    """One trigram of each alternative that rules hold to: a text with none of them is no candidate of any indexed rule."""
    rarity = lambda g: sum(COMMON.find(c) if c in COMMON else len(COMMON) for c in g)
    chosen = set()
    for r in rules:
        clauses = trigram_query(r.pattern)
        if clauses:
            # any clause will do, as all must hold: the one with the rarest trigrams
            best = [{max(alt, key=lambda g: (rarity(g), g)) for alt in clause} for clause in clauses]
            chosen |= max(best, key=lambda grams: (min(map(rarity, grams)), -len(grams)))
    return sorted(chosen)


def candidates(texts: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """key, kinds: which indexed rules may match the texts of this key. ``texts`` has key and text.

    Only texts that hold a screening trigram are indexed by all trigrams of the queries.
    """
    spark = texts.sparkSession
    terms = [(g, r.kind, c, a, len(alt), len(q)) for r in rules if (q := trigram_query(r.pattern)) for c, clause in enumerate(q) for a, alt in enumerate(sorted(clause, key=sorted)) for g in sorted(alt)]
    grams = sorted({t[0] for t in terms})
    any_ = F.lit(False)
    for g in screen_grams(rules):
        any_ = any_ | F.contains("low", F.lit(g))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in grams]))
    found = texts.select("key", F.lower("text").alias("low")).select("key", F.when(any_, held).alias("grams"))
    postings = found.select("key", F.explode("grams").alias("gram")).distinct()
    query = spark.createDataFrame(terms, "gram string, kind string, clause int, alt int, grams int, clauses int")
    met = postings.join(F.broadcast(query), "gram").groupBy("key", "kind", "clause", "alt", "grams", "clauses").count().where("count = grams")
    whole = met.groupBy("key", "kind", "clauses").agg(F.count_distinct("clause").alias("n")).where("n = clauses")
    return whole.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, place: int) -> Column:
    """The rule's matches that pass, as an array of (start, place, kind, end)."""
    pattern = F.lit(rule.pattern)
    parts = F.arrays_zip(
        F.slice(F.split(text, rule.pattern, -1), 1, F.size(F.regexp_extract_all(text, pattern, F.lit(0)))).alias("p"),
        F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"),
        F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("g"),
    )
    zipped = F.transform(parts, lambda x: F.struct(F.length(x["p"]).alias("p"), F.length(x["m"]).alias("m"), F.length(x["g"]).alias("g")))
    none = F.array().cast(SPANS)

    def step(acc, x):
        start = acc["at"] + x["p"]
        span = F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), (start + x["m"]).alias("end"))
        return F.struct((start + x["m"]).alias("at"), F.when(x["g"] >= rule.least, F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(zipped, F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"])


SPANS = "array<struct<start:int,place:int,kind:string,end:int>>"


def _screen(rule: Rule) -> str:
    """A pattern that every passing match satisfies; a run of one class can ask for its length at once."""
    return f"{rule.pattern[:-1]}{{{rule.least},}}" if re.fullmatch(r"\[[^\]]+\]\+", rule.pattern) else rule.pattern


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", few: int = FEW_CANDIDATES) -> DataFrame:
    """row (a struct of all columns of ``docs``, whatever their names) and spans: what the rules found, by start, then by the rules' order."""
    text = F.coalesce(F.col(f"row.`{text_col}`").cast("string"), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).select("row", text.alias("text")).withColumn("key", F.xxhash64("text"))
    found = materialise(candidates(keyed.select("key", "text"), rules), "secret-candidates")
    joined = keyed.join(F.broadcast(found) if found.count() <= few else found, "key", "left")
    none, each = F.array().cast(SPANS), []
    for place, rule in enumerate(rules):
        worth = F.col("text").rlike(_screen(rule))
        if trigram_query(rule.pattern):
            worth = F.array_contains(F.coalesce("kinds", F.array().cast("array<string>")), rule.kind) & worth
        each.append(F.when(worth, _spans(F.col("text"), rule, place)).otherwise(none))
    # a run of one class needs no second look at the rest of the text: its screen asks for the length
    return joined.select("row", F.array_sort(F.flatten(F.array(*each))).alias("spans"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text")).select("row.doc_id", "spans")
    base = F.filter("spans", lambda s: s["place"] < len(BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(digest(base).cast("binary"), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by a mark (overlapping spans by one); n_chars follows.

    A text without a span, null included, stays as it is; rows repeat as they come; columns may have any names, as rows are
    carried whole; an empty table stays empty.
    """
    text = F.col("row.text").cast("string")

    def step(acc, s):
        before = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        out = F.concat(acc["out"], before, F.when(s["start"] >= acc["at"], F.lit(MASK)).otherwise(F.lit("")))
        return F.when(s["end"] <= acc["at"], acc).otherwise(F.struct(s["end"].alias("at"), out.alias("out")))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    masked = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1)))
    found = scan(docs).select("row", "spans", F.when(F.size("spans") > 0, masked).otherwise(text).alias("masked"))
    changed = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.size("spans") > 0, F.length("masked").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return found.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
