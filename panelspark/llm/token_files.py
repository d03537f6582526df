"""Token ids in files of directly addressable codes, and their reader.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every id and a bitmap that says which ids go
on; level 1 holds the next chunk of just those, with a bitmap of its own, and so on. A directory holds the number of set
bits before every block of 512, so the place of an id's next chunk is one look-up and at most eight population counts:
any token is read without decoding others. Levels that nothing reaches aren't stored, and ids may have up to 32 bits.

A file is a segment of whole documents: magic, counts, document ids with a flag for null, the first position of each
document, then the levels; all numbers are little-endian. Documents are dealt out by range of id, so that the files in the
order of their names hold the documents in ascending order, and a range is cut into segments of about ``segment_ids`` ids.
Files appear under their final name by a rename, so a task that is run again replaces its own.

Texts are encoded with the tokenizers library. They are cut into units at single spaces between characters that aren't
white space: places that no word of the byte-level model's splitter crosses and on which its look-ahead doesn't depend.
Each distinct unit, less a punctuation mark at its end, is encoded once as long as a worker's bounded store holds it, many of
them in one call.

Defined results: null and empty texts have only the end id; null document ids come first and are kept as null; rows with
one id follow each other by a hash of their text, and repeated rows are repeated; texts of any length are one document; the
name of a special token in a text is read as the library reads it; an empty table writes no file and gives no rows.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, shared_folder, table

MAGIC = b"dactok1\n"
END_ID = 2
SEGMENT_IDS = 1 << 22
#: Units in each of a worker's two generations, but for those of one batch; characters that it encodes at once.
KEPT_UNITS, CHARS_AT_ONCE = 600_000, 1 << 20
#: A space that no pre-token crosses: nothing white on either side (U+180E was white in older versions of Unicode).
CUT = re.compile(r" (?![\s\u180e])(?<![\s\u180e] )")
#: A mark at a unit's end after a Latin letter or a digit is a pre-token of its own.
MARKS = ".,;:!?"
LATIN = frozenset(c for c in map(chr, range(0x30, 0x250)) if c.isascii() and c.isalnum() or c >= "\u00c0" and c not in "\u00d7\u00f7")
UNITS_AT_ONCE = 2000
BLOCK = 512


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Store:
    """What a worker has encoded: a dictionary and the one before it, from which entries that are met again move over."""

    def __init__(self, kept: int):
        self.kept, self.held, self._before = kept, {}, {}

    def known(self, key: str) -> bytes | None:
        return self.held.get(key) or self._before.get(key)

    def fill(self, keys: set[str], make: Callable[[list[str]], list[bytes]]) -> None:
        """Sees to it that ``held`` has all these keys."""
        if len(self.held) > self.kept:
            self.held, self._before = {}, self.held
        held, before, new = self.held, self._before, []
        for k in keys.difference(held):
            if k in before:
                held[k] = before[k]
            else:
                new.append(k)
        held.update(zip(new, make(new), strict=True))


class Encoder:
    """Texts to ids (as bytes, four for each id). Units are stored without the space that stands before each but a text's first."""

    def __init__(self, path: str, kept: int = KEPT_UNITS):
        from tokenizers import Tokenizer

        self.tokenizer, self.units, self.firsts = Tokenizer.from_file(path), Store(kept), Store(kept // 8)
        added, names = self.tokenizer.get_added_tokens_decoder(), self.tokenizer.get_vocab()
        self.width = np.zeros(max(names.values()) + 1, dtype=np.int64)
        for name, i in names.items():
            # a byte-level piece has a character for each byte; an added token stands for its own text
            self.width[i] = len(name.encode()) if i in added else len(name)

        self.marks = dict(zip(MARKS, self._alone(list(MARKS)), strict=True))

    def _alone(self, units: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(units, add_special_tokens=False)]

    def _together(self, units: list[str]) -> list[bytes]:
        """Units after a space, encoded as lines of one text; tokens are told apart by their bytes."""
        sizes = np.array([len(u.encode()) for u in units], dtype=np.int64) + 1
        text = " " + "\n ".join(units)
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")
        ends, first = np.cumsum(self.width[ids]), np.cumsum(sizes + 1) - sizes - 1
        lo, hi = np.searchsorted(ends, first, side="right") * 4, np.searchsorted(ends, first + sizes, side="right") * 4
        data = ids.tobytes()
        return [data[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]

    def _spaced(self, units: list[str]) -> list[bytes]:
        odd, rest, tailed = [], {}, []
        for u in units:
            if not u or u[-1].isspace() or u[-1] == "\u180e":  # where a text ends
                odd.append(u)
            elif u[-1] in self.marks and u[-2:-1] in LATIN:
                tailed.append(u)
            else:
                rest[u] = None
        # a mark after a letter is a token of its own: what stands before it is often known
        known = self.units.known
        rest |= {u[:-1]: None for u in tailed if u[:-1] not in rest and known(u[:-1]) is None}
        found, new = dict(zip(odd, self._alone([f" {u}" for u in odd]), strict=True)), list(rest)
        for lo in range(0, len(new), UNITS_AT_ONCE):
            some = new[lo : lo + UNITS_AT_ONCE]
            found.update(zip(some, self._together(some), strict=True))
        for u in tailed:
            stem = u[:-1]
            found[u] = (found[stem] if stem in found else known(stem)) + self.marks[u[-1]]
        return [found[u] for u in units]

    def __call__(self, texts: list[str]) -> list[bytes]:
        units = [CUT.split(t) for t in texts]
        firsts = [u[0] for u in units]
        for u in units:
            u[0] = ""
        self.firsts.fill(set(firsts), self._alone)
        self.units.fill(set(chain.from_iterable(units)) | {""}, self._spaced)
        held, out = self.units.held, []
        for first, u in zip(firsts, units, strict=True):
            del u[0]
            out.append(self.firsts.held[first] + b"".join(map(held.__getitem__, u)))
        return out


@lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """A worker's encoder: its store serves all tasks that the worker runs."""
    return Encoder(path)


def _rank_directory(bits: np.ndarray) -> np.ndarray:
    """Set bits before each block; ``bits`` are whole words of 64."""
    ones = np.bitwise_count(bits).astype("<u8")
    starts = np.zeros(-(-len(bits) // (BLOCK // 64)) + 1, dtype="<u8")
    if len(bits):
        starts[1:] = np.cumsum(np.add.reduceat(ones, np.arange(0, len(bits), BLOCK // 64)))
    return starts


def pack(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    """The bytes of one segment."""
    first = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    known = np.array([d is not None for d in doc_ids], dtype="u1")
    out, rest, levels = [], ids.astype("<u4"), 0
    while len(rest):
        more = rest > 0xFF
        bits = np.zeros(-(-len(rest) // 64) * 8, dtype="u1")
        packed = np.packbits(more, bitorder="little")
        bits[: len(packed)] = packed
        words = bits.view("<u8")
        out += [struct.pack("<Q", len(rest)), (rest & 0xFF).astype("u1").tobytes(), words.tobytes(), _rank_directory(words).tobytes()]
        rest, levels = rest[more] >> 8, levels + 1
    head = MAGIC + struct.pack("<IIQ", levels, len(doc_ids), len(ids))
    return b"".join([head, np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(), known.tobytes(), first.tobytes(), *out])


class Segment:
    """A segment's bytes, read in place."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("no token file")
        levels, docs, self.n_ids = struct.unpack_from("<IIQ", data, 8)
        self._data, self._at = data, 24
        ids, known = self._take("<i8", docs), self._take("u1", docs)
        self.doc_ids = [int(i) if k else None for i, k in zip(ids, known, strict=True)]
        self.first = self._take("<u8", docs + 1).astype(np.int64)
        self.levels = []
        for _ in range(levels):
            n = int(self._take("<u8", 1)[0])
            words = -(-n // 64)
            self.levels.append((self._take("u1", n), self._take("<u8", words), self._take("<u8", -(-words // (BLOCK // 64)) + 1)))

    def _take(self, kind: str, n: int) -> np.ndarray:
        out = np.frombuffer(self._data, kind, n, self._at)
        self._at += out.nbytes
        return out

    def _rank(self, level: int, at: int) -> int:
        """Set bits of a level before a place."""
        _, words, starts = self.levels[level]
        block, word = at // BLOCK, at // 64
        out = int(starts[block]) + int(np.bitwise_count(words[block * (BLOCK // 64) : word]).sum())
        return out + (int(words[word]) & ((1 << int(at % 64)) - 1)).bit_count() if at % 64 else out

    def token(self, at: int) -> int:
        """The id at a position of the segment."""
        if not 0 <= at < self.n_ids:
            raise IndexError(at)
        out = 0
        for level, (chunks, words, _) in enumerate(self.levels):
            out |= int(chunks[at]) << (8 * level)
            if not int(words[at // 64]) >> (at % 64) & 1:
                break
            at = self._rank(level, at)
        return out

    def tokens(self, lo: int, hi: int, level: int = 0) -> np.ndarray:
        """The ids at positions lo to hi, end exclusive: their part of each level alone is read."""
        if hi <= lo:
            return np.zeros(0, dtype="<u4")
        chunks, words, _ = self.levels[level]
        out = chunks[lo:hi].astype("<u4")
        bits = np.unpackbits(words[lo // 64 : -(-hi // 64)].view("u1"), bitorder="little")[lo % 64 :][: hi - lo].astype(bool)
        if bits.any():
            out[bits] |= self.tokens(self._rank(level, lo), self._rank(level, hi), level + 1) << 8
        return out

    def document(self, i: int) -> np.ndarray:
        return self.tokens(int(self.first[i]), int(self.first[i + 1]))


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int | None = END_ID, segment_ids: int = SEGMENT_IDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the token files of ``docs`` to ``folder`` (which all tasks reach) and returns what was written: part, segment, documents, ids."""
    path = path or tokenizer_path()
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, (store, base) = encoder(path), fs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        part, segment, doc_ids, coded, size = task.partitionId(), 0, [], [], 0

        def flush():
            nonlocal segment, doc_ids, coded, size
            data = pack(doc_ids, [len(c) // 4 for c in coded], np.frombuffer(b"".join(coded), "<u4"))
            name = f"part-{part:08d}-{segment:06d}.dac"
            own = f"{base}/_{name}.{task.taskAttemptId()}"
            with store.open_output_stream(own) as f:
                f.write(data)
            if store.get_file_info(f"{base}/{name}").type == fs.FileType.File:
                store.delete_file(f"{base}/{name}")
            store.move(own, f"{base}/{name}")
            row = pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "segment": pa.array([segment], pa.int32()), "documents": pa.array([len(doc_ids)], pa.int64()), "ids": pa.array([size], pa.int64())})
            segment, doc_ids, coded, size = segment + 1, [], [], 0
            return row

        for b in batches:
            at = 0
            while at < b.num_rows:
                # as many texts as are encoded at once, at least one
                some, texts, chars = at, [], 0
                while at < b.num_rows and (at == some or chars < CHARS_AT_ONCE):
                    texts.append(b.column(1)[at].as_py() or "")
                    chars += len(texts[-1])
                    at += 1
                for doc_id, ids in zip(b.column(0).slice(some, at - some).to_pylist(), encode(texts), strict=True):
                    doc_ids.append(doc_id)
                    coded.append(ids + end)
                    size += len(coded[-1]) // 4
                    if size >= segment_ids:
                        yield flush()
        if doc_ids:
            yield flush()

    store, base = fs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    # rows of one id spread over ranges, too; their order is by text, and equal rows may come in any
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = [F.col("id").asc_nulls_first(), F.col("h"), F.col("row")]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")
    return materialise(spread.mapInArrow(run, "part int, segment int, documents long, ids long"), "token-segments")


def read_tokens(spark: SparkSession, folder: str, id_col: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """Per document of the files: part, segment, place (in its segment), id, first (position in the segment), n_tokens, ids_crc32 and, if asked, ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                part, segment = map(int, re.search(r"part-(\d+)-(\d+)\.dac$", name).groups())
                s = Segment(data.as_buffer().to_pybytes())
                n = len(s.doc_ids)
                for lo in range(0, n, 4096):
                    span = range(lo, min(n, lo + 4096))
                    ids = [s.document(i) for i in span]
                    columns = {
                        "part": pa.array([part] * len(span), pa.int32()), "segment": pa.array([segment] * len(span), pa.int32()), "place": pa.array(span, pa.int64()),
                        id_col: pa.array(s.doc_ids[lo : span.stop], pa.int64()), "first": pa.array(s.first[lo : span.stop], pa.int64()),
                        "n_tokens": pa.array([len(x) for x in ids], pa.int64()), "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                    }
                    if with_ids:
                        columns["ids"] = pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_pydict(columns)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.dac").load(folder).select("path", "content")
    return files.mapInArrow(run, f"part int, segment int, place long, `{id_col}` long, first long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else ""))


def with_starts(read: DataFrame) -> DataFrame:
    """Adds start: ids of all documents before; one sum for each segment goes through a window."""
    before = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    sums = read.groupBy("part", "segment").agg(F.sum("n_tokens").alias("_n"))
    starts = sums.select("part", "segment", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return read.join(starts, ["part", "segment"]).withColumn("start", F.col("_start") + F.col("first")).drop("_start")


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    write_tokens(table(spark, sf_dir, "documents"), folder)
    read = materialise(read_tokens(spark, folder), "tokens-read")
    return with_starts(read).select("doc_id", "start", "n_tokens", "ids_crc32")
