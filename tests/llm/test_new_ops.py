"""Token files, conversation repair and ranked search against brute force, and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from panelspark.llm import conversations, ranked_search, token_files

LONG = "A long story about nothing at all. " * 5000
EXTRA = "id h row part segment key item pos block at n terms tfs term score rank _start first fault".split()


def odd_documents(spark, rows):
    """Documents with columns that are named like those that the operators make."""
    schema = "doc_id long, text string, " + ", ".join(f"{c} int" for c in EXTRA)
    return spark.createDataFrame([(i, t, *[7] * len(EXTRA)) for i, t in rows], schema)


# 11 ---------------------------------------------------------------------------------------------------------------

ODD = [" ", "  ", "\n", "\t", "a", "b", "'s", "'", "\u00e9", "\u65e5", "1", "!", "\u00a0", "\u001c", "\u0085", "\u200b", "\u180e", "\u3000", "\u0301", "<|endoftext|>", " don't", "\r\n", "\U0001f600", "ing", ".", "a, "]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(token_files.tokenizer_path())


def test_units_give_the_librarys_ids(tokenizer):
    """White space of all kinds, contractions, names of special tokens: cutting texts into units changes no id."""
    rng = random.Random(3)
    texts = ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    encode = token_files.Encoder(token_files.tokenizer_path(), kept=500)  # so small that the store is emptied on the way
    for lo in range(0, len(texts), 1000):
        some = texts[lo : lo + 1000]
        for text, got, want in zip(some, encode(some), tokenizer.encode_batch(some, add_special_tokens=False), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == want.ids, text


@pytest.mark.parametrize("top", [1, 200, 256, 60_000, 2**32])
def test_segments_round_trip_and_random_access(top):
    rng = np.random.default_rng(top)
    lengths = [0, 1, 511, 512, 513, 0, 3000, 64]
    ids = rng.integers(0, top, sum(lengths), dtype="u8").astype("<u4")
    s = token_files.Segment(token_files.pack([None, 5, 5, -7, 2**62, 0, 1, 2], lengths, ids))
    assert s.doc_ids == [None, 5, 5, -7, 2**62, 0, 1, 2] and s.n_ids == len(ids)
    at = np.cumsum([0, *lengths])
    for i in range(len(lengths)):
        assert (s.document(i) == ids[at[i] : at[i + 1]]).all()
    assert [s.token(i) for i in range(len(ids))] == ids.tolist()
    for lo, hi in rng.integers(0, len(ids), (200, 2)):
        assert (s.tokens(lo, hi) == ids[lo:hi]).all()
    for at in (-1, len(ids)):
        with pytest.raises(IndexError):
            s.token(at)
    with pytest.raises(ValueError, match="no token file"):
        token_files.Segment(b"something else, but no token file")


def brute_tokens(rows, tokenizer):
    out, at = [], 0
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    return out


def test_token_query(spark, sf, tokenizer):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect())
    got = token_files.op11_token_files(spark, sf)
    assert got.dtypes == [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(brute_tokens(rows, tokenizer))


def test_token_files_of_odd_rows(spark, tmp_path, tokenizer):
    """Null ids and texts, one id with several texts, repeated rows and a long text, in segments of few ids."""
    docs = odd_documents(spark, [(3, "three"), (None, "no id"), (2, None), (2, ""), (5, LONG), (7, "same"), (7, "same"), (7, "other  text\n"), (-1, "<|endoftext|>")])
    folder = f"{tmp_path}/files"
    written = token_files.write_tokens(docs, folder, segment_ids=5).collect()
    got = token_files.with_starts(token_files.read_tokens(spark, folder, with_ids=True)).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, -1, 2, 2, 3, 5, 7, 7, 7]
    assert [r.n_tokens for r in got[2:4]] == [1, 1] and got[2].ids == [2]
    texts = sorted(tokenizer.decode(r.ids[:-1], skip_special_tokens=False) for r in got[6:])
    assert texts == ["other  text\n", "same", "same"] and tokenizer.decode(got[5].ids[:-1]) == LONG
    assert got[1].ids == [*tokenizer.encode("<|endoftext|>", add_special_tokens=False).ids, 2]
    at = 0
    for r in got:
        assert (r.start, r.n_tokens) == (at, len(r.ids))
        at += r.n_tokens
    assert sum(w.ids for w in written) == at and sum(w.documents for w in written) == len(got)
    # a task that is run again replaces its files
    again = token_files.write_tokens(docs, folder, segment_ids=5).collect()
    assert sorted(again) == sorted(written) and token_files.read_tokens(spark, folder).count() == len(got)


def test_token_files_of_an_empty_table(spark, tmp_path):
    docs = odd_documents(spark, [])
    folder = f"{tmp_path}/files"
    assert token_files.write_tokens(docs, folder).count() == 0
    assert token_files.with_starts(token_files.read_tokens(spark, folder)).count() == 0


# 12 ---------------------------------------------------------------------------------------------------------------

THEN = {"E": "U", "S": "U", "U": "A", "A": "U"}


def damaged(rows):
    out = defaultdict(list)
    for c, t, r, x in rows:
        own = out[c]
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x
        own += [(t, "user" if kind == 4 else r, x)] * {0: 0, 3: 2}.get(kind, 1)
    return out


def brute_repair(rows):
    """All ways forward at once: for each state the cheapest, then least audit with its lines."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    seen, count, best = set(), dict.fromkeys("bdt", 0), {"E": (0, "", ())}

    def put(into, state, way):
        if state not in into or way[:2] < into[state][:2]:
            into[state] = way

    def inserted(states):
        for _ in range(4):
            for q, (c, a, o) in list(states.items()):
                put(states, THEN[q], (c + 3, a + "I", (*o, "user:" if THEN[q] == "U" else "assistant:")))

    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else ""
        seen.add((role, text))
        if fault:
            count[fault] += 1
        inserted(best)
        then = {}
        for q, (c, a, o) in best.items():
            put(then, q, (c + 4, a + "D", o))
            if fault in ("b", "d"):
                continue
            more = 3 * (fault == "t")
            to = {"Es": "S", "Eu": "U", "Su": "U", "Ua": "A", "Au": "U"}.get(q + role[:1])
            if to:
                put(then, to, (c + more, a + "K", (*o, f"{role}:{text}")))
            put(then, THEN[q], (c + more + 3, a + "R", (*o, f"{'user' if THEN[q] == 'U' else 'assistant'}:{text}")))
        best = then
    inserted(best)
    cost, audit, lines = min(best[q] for q in "EA" if q in best)
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    return gaps, count["b"], count["d"], count["t"], illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


ROLES = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sysadmin", "User"]
TEXTS = ["Hi there.", "ok", "", "  ", "what?", None, "x.y ! \n", "Line.\nLine", "long " * 3000 + "!"]


def random_turns(convs, turns, n):
    rng = random.Random(n)
    return [(rng.choice(convs), rng.choice([None, *range(turns)]), rng.choice(ROLES), rng.choice(TEXTS)) for _ in range(n)]


@pytest.mark.parametrize(("rows", "least"), [(random_turns([None, *range(80)], 9, 500), 64), (random_turns([None, *range(8)], 200, 900), 3), (random_turns([7], 5000, 700), 1), ([(1, 1, "user", "Hi.")] * 90, 2), ([], 64)], ids=["many", "blocks", "one", "repeated", "empty"])
def test_repair_against_brute_force(spark, rows, least):
    extra = ["key", "item", "fault", "n", "pos", "block", "at", "_copies"]
    df = spark.createDataFrame([(*r, *[7] * len(extra)) for r in rows], "conv_id long, turn long, role string, text string, " + ", ".join(f"{c} int" for c in extra))
    report, turns = conversations.repair(conversations.damage(df), df, least)
    got = {r[0]: tuple(r)[1:] for r in report.collect()}
    want = {c: brute_repair(own) for c, own in damaged(rows).items()}
    assert got == want
    # the repaired turns themselves
    lines = defaultdict(list)
    for r in turns.orderBy("pos").collect():
        lines[r.key.conv].append(r.line)
    for c, own in lines.items():
        text = "\n".join(own)
        assert hashlib.sha256(text.encode()).hexdigest() == want[c][-1]


def test_audits_are_cheapest_and_least_of_all_edits():
    """Short conversations against every sequence of edits."""
    rng = random.Random(9)

    def ways(symbols, state):
        """(cost, audit) of all edits with at most two inserts in a row."""
        for more, then, n in (("", state, 0), ("I", conversations.NEXT[state], 1), ("II", conversations.NEXT[conversations.NEXT[state]], 2)):
            if not symbols:
                if then in (conversations.NOTHING, conversations.ASSISTANT):
                    yield 3 * n, more
                continue
            role, fault = symbols[0] % 4, symbols[0] // 4
            edits = [("D", 4, then)]
            if fault != conversations.MUST_GO:
                cut = 3 * (fault == conversations.CUT_OFF)
                edits += [("R", 3 + cut, conversations.NEXT[then])]
                if conversations.KEEP[then][role] is not None:
                    edits += [("K", cut, conversations.KEEP[then][role])]
            for name, c, to in edits:
                for rest, audit in ways(symbols[1:], to):
                    yield 3 * n + c + rest, more + name + audit

    lists = [[rng.randrange(12) for _ in range(rng.randint(1, 4))] for _ in range(60)]
    ends, codes = conversations.walks(pa.array(lists, pa.list_(pa.int64())), np.tile(conversations.END, (len(lists), 1)))
    for symbols, end, own in zip(lists, ends, codes, strict=True):
        audit = "".join(conversations.NAMES[c] for c in own[0]) + conversations.TAIL[end[0]]
        assert audit == min(ways(symbols, conversations.NOTHING))[1], symbols


def duck(sql, sf, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.execute(sql).fetchall()


def test_repair_query_and_its_sql(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in conversations.op12_conversation_repair(spark, sf).collect()}
    assert got == {c: brute_repair(own) for c, own in damaged(rows).items()} == {r[0]: r[1:] for r in duck(conversations.OP12_SQL, sf, "conversations")}


# 13 ---------------------------------------------------------------------------------------------------------------

PATTERN = re.compile(ranked_search.TERM)


def words_of(text):
    return PATTERN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k=50):
    held = [(i, w) for i, t in docs if (w := words_of(t))]
    n_docs, total = len(held), sum(len(w) for _, w in held)
    df = defaultdict(int)
    for _, w in held:
        for t in set(w):
            df[t] += 1
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(words_of(t))
    out = []
    for item, terms in asked.items():
        scores = []
        for i, w in held:
            m, s = 50 + 50 * len(w) * n_docs // total, 0
            for t in terms:
                if tf := w.count(t):
                    s += int(np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df[t] + 1)))) * (1_000_000_000 * tf // (1000 * tf + 20 * m))
            if s > 0:
                scores.append((-s, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


def random_documents(n, words, seed):
    rng = random.Random(seed)
    names = [f"w{int(words * rng.random() ** 3)}" for _ in range(4000)]
    return [(rng.randrange(n), " ".join(rng.choice(names) for _ in range(rng.randint(0, 40)))) for _ in range(n)]


@pytest.mark.parametrize(("k", "terms_at_once", "block_docs"), [(50, 50_000, 16_384), (3, 50_000, 20), (1, 10, 7)])
def test_search_against_brute_force(spark, k, terms_at_once, block_docs):
    """Copies, equal scores, several rows of one id, nulls, items without terms; several passes, small blocks."""
    docs = [*random_documents(300, 60, 1), (None, "w1 w2 W3"), (None, None), (4, ""), (5, "!!! ... ¿?"), (6, "Été ÉTÉ été w1"), *[(900 + i, "w1 w2 w3 w4") for i in range(70)], (8, LONG + "w7")]
    items = [(1, "w1 w2 W3!"), (2, "w5,w5 w50"), (3, "nothing here w59"), (None, "w7 Été"), (None, "w8"), (4, ""), (5, None), (6, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9"), (1, "w11"), (7, "absent"), (8, "story w2 nothing")]
    frame = spark.createDataFrame([(*r, 7, 7) for r in items], "item_id long, text string, item int, term int")
    got = ranked_search.search(odd_documents(spark, docs), frame, k, terms_at_once, block_docs)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(brute_search(docs, items, k), key=str)


def test_search_stops_making_accumulators():
    """Documents that hold only the common terms get no accumulator; the best are the same."""
    rng = np.random.default_rng(5)
    share = np.array([0.02, 0.9, 0.05, 0.95, 0.8])
    n_docs, n_terms = 8000, len(share)
    has = rng.random((n_docs, n_terms)) < share
    tfs = rng.integers(1, 4, has.shape) * has
    sizes, terms = has.sum(1), np.nonzero(has)[1]
    df = has.sum(0)
    weights = np.floor(1000 * np.log((2.0 * n_docs + 2) / (2.0 * df + 1))).astype(np.int64)
    block = ranked_search.Block(tfs.sum(1).astype(np.int64) + 5, sizes, terms, tfs[has], weights, n_docs, int(tfs.sum()) + 5 * n_docs)
    order = np.argsort(df, kind="stable")
    at, score = block.search(order, 10, 0)
    m = 50 + (50 * (tfs.sum(1) + 5) * n_docs) // (int(tfs.sum()) + 5 * n_docs)
    whole = (weights * ((1_000_000_000 * tfs) // np.maximum(1, 1000 * tfs + 20 * m[:, None]))).sum(1)
    assert (whole[at] == score).all()
    assert sorted(score)[-10:] == sorted(whole)[-10:]
    assert has[:, 0].sum() <= block.made <= has[:, [0, 2]].any(1).sum() < 0.1 * (sizes > 0).sum()
    # a floor from elsewhere lets no more in than could reach it
    block.made = 0
    at, score = block.search(order, 10, int(max(whole)))
    assert block.made <= has[:, [0, 2]].any(1).sum() and max(whole) in score
    assert len(block.search(order, 10, int(max(whole)) * 10)[0]) == 0


def test_search_query_and_its_sql(spark, sf):
    got = ranked_search.op13_ranked_search(spark, sf)
    assert got.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    assert sorted(map(tuple, got.collect())) == sorted(duck(ranked_search.OP13_SQL, sf, "documents", "benchmark"))


def test_search_of_empty_tables(spark):
    none, some = odd_documents(spark, []), odd_documents(spark, [(1, "a b")])
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(none, items).count() == 0
    assert ranked_search.search(some, items.limit(0)).count() == 0
