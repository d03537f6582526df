"""SimHash near-duplicates with covering locality-sensitive hashing.

``fingerprints``: bit i of a text's 64-bit fingerprint is the majority of bit i over the XXH64 hashes of its
word shingles. ``link_within`` finds, among distinct fingerprints, links of every pair at most ``radius`` bits
apart: each bit position gets a random vector of radius + 1 bits, and each of the 2^(radius+1) - 1 masks keeps
the positions whose vector has an odd dot product with the mask's own number. Two fingerprints that differ in at
most ``radius`` positions agree on some mask, always. Buckets up to ``most_pairs_in`` members compare their
pairs. Larger ones take an exact route that is linear in their members: at radius 2 two fingerprints are within
reach just if the balls of radius 1 around them share a point, a point lies in at most 65 balls, and members of
a point's ball are linked to the smallest of them after a check. Links become classes by ``components``.

``near_duplicates``, which the pipeline uses, takes five-word shingles and the same steps: fingerprints, and buckets of the
covering masks, in which every two texts meet whose fingerprints differ in at most ``RADIUS`` bits. For similarity 0.8 64 bits
are too noisy and a covering family of that radius would need thousands of tables, so MinHash signatures add buckets:
texts that agree on all of ``band_rows`` minima of one of ``bands`` bands meet too (0.998 of the
pairs of similarity 0.8 do). An exact check follows. Pairs whose signatures agree in far fewer minima than 0.8 (four standard errors)
go no further. What is left is compared by the sets of 64-bit shingle hashes, and a pair links just if the Jaccard
similarity of these sets reaches the bound. Within a bucket every member is compared with a few leaders. The members of
buckets that still hold several classes are then compared where they share rare shingles (``prefix_pairs``), which misses
no pair of that similarity.

Defined results: words are runs of characters other than ASCII white space, A-Z lower-cased; fewer words than a
shingle make one shingle; null and empty texts have fingerprint zero, which links like any other (in
``near_duplicates`` they are one text, the empty one); equal texts share fingerprints; null ids take part, and the
smallest non-null id names the class; an empty table gives no rows.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import components, materialise, table

SHINGLE, RADIUS, MOST_PAIRS_IN = 3, 2, 48
SIMILARITY, NEAR_SHINGLE, BANDS, BAND_ROWS, LEADERS = 0.8, 5, 20, 6, 3
#: Texts that a task remembers to have sketched (copies that it meets later are sketched again).
MOST_SEEN = 1 << 20


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of the text, repeats included."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return np.zeros(0, np.uint64)
    joined, h = b" ".join(found), xxhash.xxh64_intdigest
    if len(found) <= words:
        return np.array([h(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[:-words].tolist()]
    return np.fromiter((h(joined[a:b], 42) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())), np.uint64, len(starts))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The 64-bit fingerprint of these hashes: bits that are set in over half of them."""
    if not len(hashes):
        return 0
    by_byte = hashes.astype("<u8").view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(by_byte[:, i], minlength=256) @ _BITS for i in range(8)])
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """The upper halves of the minima of ``size`` linear functions over these hashes, as signed ints."""
    rng = np.random.default_rng(11)
    by, plus = rng.integers(0, 2**64, (2, size), np.uint64)
    by, least = by | np.uint64(1), np.full(size, 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), 1024):
        least = np.minimum(least, (hashes[i : i + 1024, None] * by + plus).min(axis=0))
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def fingerprints(docs: DataFrame, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and fp, the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(majority(shingle_hashes(t.as_py(), words))) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], names=[id_col, "fp"])

    kept = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return kept.mapInArrow(run, f"`{id_col}` long, fp long")


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    rng = random.Random(seed)
    vectors = [rng.randrange(1 << (radius + 1)) for _ in range(64)]
    return [sum(1 << i for i, v in enumerate(vectors) if (v & a).bit_count() % 2) for a in range(1, 1 << (radius + 1))]


def link_within(fps: DataFrame, most_pairs_in: int = MOST_PAIRS_IN) -> DataFrame:
    """Links (a, b) between distinct values of fp such that those within RADIUS bits are connected."""
    masks = [_signed(m) for m in covering_masks(RADIUS)]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("table", "key"))
    sized = keyed.groupBy("table", "key").count()
    near = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= RADIUS
    full = materialise(sized.where("count > 1"), "simhash-buckets")
    small = keyed.join(full.where(F.col("count") <= most_pairs_in).select("table", "key"), ["table", "key"])
    met = small.groupBy("table", "key").agg(F.collect_list("fp").alias("m"))
    pairs = met.select(F.explode("m").alias("a"), "m").select("a", F.explode("m").alias("b")).where((F.col("a") < F.col("b")) & near("a", "b"))
    # members of larger buckets: centres of the balls that they lie in; a ball holds 65 values at most
    hot = keyed.join(full.where(F.col("count") > most_pairs_in).select("table", "key"), ["table", "key"]).select("fp").distinct()
    around = F.array(F.lit(0), *[F.lit(_signed(1 << i)).cast("long") for i in range(64)])
    balls = hot.select("fp", F.explode(around).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("centre"))
    shared = balls.groupBy("centre").agg(F.collect_set("fp").alias("m")).where(F.size("m") > 1)
    stars = shared.select(F.array_min("m").alias("a"), F.explode("m").alias("b")).where((F.col("a") < F.col("b")) & near("a", "b"))
    return pairs.unionByName(stars)


def near_classes(docs: DataFrame, words: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, fp, component_id: the smallest id reachable over links of at most two differing bits."""
    own = materialise(fingerprints(docs, words, id_col, text_col), "simhash-fp")
    values = materialise(own.groupBy("fp").agg(F.min(id_col).alias("least")), "simhash-values")
    roots = components(link_within(values.select("fp")), "simhash")
    rooted = values.join(roots, values["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return own.join(rooted.join(smallest, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def least_agreeing(size: int, similarity: float) -> int:
    """The number of agreeing minima, of ``size``, that a pair of this similarity reaches but for four standard errors."""
    return int(size * similarity - 4 * math.sqrt(size * similarity * (1 - similarity)))


def _with_both(pairs: DataFrame, of: DataFrame, name: str) -> DataFrame:
    left, right = (of.select(F.col("node").alias(c), F.col(name).alias(f"{name}_{c}")) for c in "ab")
    return pairs.join(left, "a").join(right, "b")


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose sets of shingles are similar enough."""
    shared = F.size(F.array_intersect("shingles_a", "shingles_b"))
    either = F.size("shingles_a") + F.size("shingles_b") - shared
    return _with_both(pairs, sets, "shingles").where(shared + 1e-9 >= F.lit(float(similarity)) * either).select("a", "b")


def prefix_pairs(sets: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of nodes of different roots, every pair of that similarity among them, by their rarest shingles.

    ``sets``: node, root, shingles. Shingles are put in one order for all sets, rarest first. Sets that reach the bound
    share a shingle among the first ones of both: the larger set's first (1 - s) share and the smaller one's first
    (1 - 2s / (1 + s)) share, each and one more. Only these few are joined. Roots that share such a shingle meet first,
    once each, and then their members: members of one root never meet, however many there are.
    """
    s = float(similarity)
    each = sets.select("node", "root", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
    often = each.groupBy("shingle").agg(F.count("*").alias("n"))
    met = each.join(often, "shingle").withColumn("place", F.row_number().over(Window.partitionBy("node").orderBy("n", "shingle")))
    probe = met.where(F.col("place") <= F.col("size") - F.ceil(F.lit(s) * F.col("size") - 1e-9) + 1)
    probe = materialise(probe.select("node", "root", "size", "shingle", "place"), "near-prefixes")
    kept = probe.where(F.col("place") <= F.col("size") - F.ceil(F.lit(2 * s / (1 + s)) * F.col("size") - 1e-9) + 1)
    roots = lambda d, n: d.select("shingle", F.col("root").alias(f"root_{n}")).distinct()
    classes = materialise(roots(probe, "x").join(roots(kept, "y"), "shingle").where("root_x <> root_y"), "near-roots")
    x, y = (d.select(*[F.col(c).alias(f"{c}_{n}") for c in ("node", "root", "size", "place")], "shingle") for d, n in ((probe, "x"), (kept, "y")))
    longer = (F.col("size_x") > F.col("size_y")) | ((F.col("size_x") == F.col("size_y")) & (F.col("node_x") > F.col("node_y")))
    needed = F.ceil(F.lit(s / (1 + s)) * (F.col("size_x") + F.col("size_y")) - 1e-9)
    # a pair is found by its first shared shingle, after which at most ``left`` - 1 more can be shared
    left = F.least(F.col("size_x") - F.col("place_x"), F.col("size_y") - F.col("place_y")) + 1
    pairs = classes.join(x, ["shingle", "root_x"]).join(y, ["shingle", "root_y"]).where(longer & (F.col("size_y") + 1e-9 >= s * F.col("size_x")) & (left >= needed))
    return pairs.select(F.col("node_x").alias("a"), F.col("node_y").alias("b")).distinct()


def near_duplicates(docs: DataFrame, similarity: float = SIMILARITY, words: int = NEAR_SHINGLE, bands: int = BANDS, band_rows: int = BAND_ROWS, leaders: int = LEADERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """digest (of the text), class_id, kept, least (its smallest id): one row per distinct text; of each class one text is kept.

    kept is the text of the class's smallest id, the digest breaking ties.
    """
    minima = bands * band_rows
    lists = lambda x, ends, kind: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, kind))

    def sketched(sketch, name: str, kind, fingerprint: bool = False):
        """A function over batches of (node, text) that gives each node met in a task once, with a list from its distinct shingle
        hashes and, if asked, the fingerprint of all of them."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for b in batches:
                for i in range(0, b.num_rows, 256):
                    part, nodes, found, fps = b.slice(i, 256), [], [], []
                    for node, t in zip(part.column(0).to_pylist(), part.column(1)):
                        if node not in seen:
                            seen.add(node)
                            nodes.append(node)
                            hashes = shingle_hashes(t.as_py(), words)
                            found.append(sketch(np.unique(hashes)))
                            if fingerprint:
                                fps.append(_signed(majority(hashes)))
                    if len(seen) > MOST_SEEN:
                        seen.clear()
                    if nodes:
                        columns = {"node": pa.array(nodes, pa.int64()), name: lists(np.concatenate(found), np.cumsum([0, *map(len, found)]), kind)}
                        yield pa.RecordBatch.from_pydict(columns | ({"fp": pa.array(fps, pa.int64())} if fingerprint else {}))

        return run

    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    digest = F.md5(text.cast("binary"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), digest.alias("digest"), F.xxhash64(digest).alias("node"), text.alias("text"))
    firsts = materialise(texts.groupBy("digest", "node").agg(F.min("id").alias("least")), "near-texts")
    full = texts.where(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "") != "").select("node", "text")
    signed = sketched(lambda h: signature(h, minima), "sig", pa.int32(), fingerprint=True)
    sigs = materialise(full.mapInArrow(signed, "node long, sig array<int>, fp long").dropDuplicates(["node"]), "near-signatures")
    # buckets: the fingerprint under each covering mask, and each band of minima
    masked = [F.xxhash64(F.lit(f"mask {i}"), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(covering_masks(RADIUS))]
    band = [F.xxhash64(F.lit(i), F.slice("sig", i * band_rows + 1, band_rows)) for i in range(bands)]
    keyed = sigs.select("node", F.explode(F.array(*masked, *band)).alias("key"))
    # a bucket's leaders are the members that a hash for each of them ranks first, alike in all buckets
    first = [F.min(F.struct(F.xxhash64("node", F.lit(t)).alias("h"), F.col("node").alias("b")))["b"] for t in range(leaders)]
    buckets = keyed.groupBy("key").agg(F.count("*").alias("n"), F.array_distinct(F.array(*first)).alias("leaders")).where("n > 1").select("key", "leaders")
    members = materialise(keyed.join(buckets, "key"), "near-members")
    shingled = sketched(lambda h: h.view(np.int64), "shingles", pa.int64())
    sets = materialise(full.join(members.select("node").distinct(), "node", "leftsemi").mapInArrow(shingled, "node long, shingles array<long>").dropDuplicates(["node"]), "near-sets")

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
        agreeing = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        likely = _with_both(pairs, sigs, "sig").where(agreeing >= least_agreeing(minima, similarity)).select("a", "b")
        return materialise(_similar(likely, sets, similarity), "near-links")

    links = verified(members.select(F.col("node").alias("a"), F.explode("leaders").alias("b")))
    roots = components(links, "near-classes")
    # members of buckets that still hold several classes are compared where they share rare shingles
    rooted = materialise(members.select("key", "node").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root")), "near-rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("r1"), F.max("root").alias("r2")).where("r1 <> r2").select("key")
    rest = materialise(rooted.join(mixed, "key", "leftsemi").select("node", "root").distinct().join(sets, "node"), "near-rest")
    if not rest.isEmpty():
        more = materialise(_similar(prefix_pairs(rest, similarity), sets, similarity), "near-links")
        if not more.isEmpty():
            roots = components(links.unionByName(more), "near-classes")
    classed = firsts.join(roots, "node", "left").select("digest", "least", F.coalesce("root", "node").alias("class_id"))
    best = classed.groupBy("class_id").agg(F.min(F.struct("least", "digest")).alias("best"))
    return classed.join(best, "class_id").select("digest", "class_id", (F.col("digest") == F.col("best.digest")).alias("kept"), "least")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each class of near-duplicates, with all columns; of equal texts the smallest id stays.

    Null counts as the empty text; texts of white space only have no near-duplicates but their copies. Of rows that share text and id one stays;
    columns may have any names, as rows are carried whole; an empty table stays empty.
    """
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = packed.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("row.text").cast("string"), F.lit("")).alias("text"))
    kept = near_duplicates(rows, **options).where("kept").select("digest", "least")
    keyed = rows.select("row", "doc_id", F.md5(F.col("text").cast("binary")).alias("digest"))
    one = keyed.join(materialise(kept, "near-kept"), "digest").where(F.col("doc_id").eqNullSafe(F.col("least")))
    # which of several rows of one text and id stays doesn't depend on their order
    chosen = one.groupBy("digest").agg(F.min_by("row", F.to_json(F.col("row").dropFields("text"))).alias("row"))
    return chosen.select("row.*")
