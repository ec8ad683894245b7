"""The ten operators against brute force, round trips and held-out rows, with odd tables."""

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plumbline.llm import bpe, chat, jaccard_join, media, packing, quality, queries, suffix_dedup, token_store, tokens, topk, toxicity
from plumbline.llm._text import string_bytes
from plumbline.storage import shared_dir

SF = "/root/testdata/sf0.001"
TOK = queries.TOKENIZER
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, predicted string, piece string, n_bytes string, node string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "a", "b", "c", "d", "e") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def odd_rows():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage = text(60)
    long = text(60_000)
    rows = [(1, text(200)), (2, None), (3, ""), (4, "   \n\t "), (5, passage + " " + text(80)), (6, text(40) + " " + passage), (7, "a" * 5000), (8, "x" * 99), (9, "x" * 100), (10, "x" * 101), (11, long), (12, long), (13, "👍 世界 ½ <|endoftext|> ΑΣ don't 12'34"), (14, "one"), (15, "one")]
    rows += [(16, text(30))] * 2 + [(17, text(25)), (17, text(25)), (None, text(30)), (-5, passage)]
    near = text(300).split()
    for k in range(6):
        w = list(near)
        w[40 * k + 3] = f"changed{k}"
        rows.append((100 + k, " ".join(w)))
    return rows


@pytest.fixture(scope="module")
def odd(spark, odd_rows):
    return frame(spark, odd_rows).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def key(v):
    return -(1 << 63) if v is None else v


# ---- token ids, BPE, packing, store


def test_ids_equal_the_library(odd_rows):
    texts = [t for _, t in odd_rows] + ["aaaaaaaaaa hahahahaha !!!!!!!!!!!!", "<|startoftext|>a<|endoftext|>", "İstanbul ŉ ß ǅ", "é ́x", "a b c\x1cd\x85e", "it's they'll I'd x'S"]
    data, offsets = string_bytes(pa.array(texts, pa.string()))
    want = tokens.reference_ids(TOK, texts)
    for table in (tokens.library_table(TOK), bpe.pair_table(TOK)):
        ids, counts = table.encode(data, offsets)
        at = np.r_[0, np.cumsum(counts)]
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == want
    for w in want:
        assert bpe.decode(TOK, np.array(w, dtype=np.int64)) == tokens.load(TOK).decode(w, skip_special_tokens=False)


def twisted(k):
    """Two words of the letters a and b, each other's complement, that sums of powers can't tell apart."""
    x, y = "a", "b"
    for _ in range(k):
        x, y = x + y, y + x
    return x, y


#: Long words of the same blocks in another order.
LIKE = ["ab" * 2048 + "cd" * 2048, "cd" * 2048 + "ab" * 2048, *twisted(10), *twisted(12), "x" * 512, "x" * 513]


@pytest.mark.parametrize("hashes", [tokens.hash_words, lambda data, starts, ends: np.zeros(len(starts), np.uint64)])
def test_words_of_like_hash(hashes):
    texts = [*LIKE, "a bb ccc", "ccc a bb", "".join(LIKE)]
    want = tokens.reference_ids(TOK, texts)
    for made in (tokens.library_table(TOK), bpe.pair_table(TOK)):
        table = tokens.WordTable(made.encode_new, hashes=hashes)
        for some in (texts, texts[::-1]):
            ids, counts = table.encode(*string_bytes(pa.array(some, pa.string())))
            at = np.r_[0, np.cumsum(counts)]
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == (want if some is texts else want[::-1])


def test_words_of_like_blocks(spark):
    rows = list(enumerate(LIKE))
    docs = frame(spark, rows)
    want = [ids + [1] for ids in tokens.reference_ids(TOK, LIKE)]
    crc = {i: zlib.crc32(np.array(w, "<u4").tobytes()) for i, w in enumerate(want)}
    got = bpe.encode_decode_digests(docs, TOK).collect()
    assert {r["doc_id"]: r["ids_sha256"] for r in got} == {i: hashlib.sha256(" ".join(map(str, w[:-1])).encode()).hexdigest() for i, w in enumerate(want)}
    assert {r["doc_id"]: r["ids_crc32"] for r in packing.pack(docs, TOK, capacity=8192).collect()} == crc
    folder = shared_dir(spark, "t")
    token_store.write(docs, folder, TOK)
    assert {r["doc_id"]: r["ids_crc32"] for r in token_store.read(spark, folder, TOK).collect()} == crc
    assert classes(docs) == [(i, i, 0) for i in range(len(rows))]
    out = suffix_dedup.deduplicate(docs, with_text=False).collect()
    assert sorted((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in out) == brute_dedup(rows)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=700), min_size=1, max_size=6))
def test_hashes_and_bytes(runs):
    runs = [*runs, runs[0]]
    lens = np.array([len(r) for r in runs])
    data, ends = np.frombuffer(b"".join(runs), np.uint8), np.cumsum(lens)
    hashes = tokens.hash_words(data, ends - lens, ends).tolist()
    for a in range(len(runs)):
        for b in range(len(runs)):
            assert (hashes[a] == hashes[b]) == (runs[a] == runs[b])
            if lens[a] == lens[b]:
                assert tokens.same_runs(data, ends[[a]] - lens[[a]], lens[[a]], data, ends[[b]] - lens[[b]])[0] == (runs[a] == runs[b])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_pair_index_on_any_text(text):
    data, offsets = string_bytes(pa.array([text], pa.string()))
    assert bpe.pair_table(TOK).encode(data, offsets)[0].tolist() == tokens.reference_ids(TOK, [text])[0]


def test_word_table_forgets_and_goes_on():
    calls = []

    def encode(joined):
        words = joined.split("\n")
        calls.append(len(words))
        return np.array([len(w) for w in words], np.uint32), np.ones(len(words), np.int64)

    t = tokens.WordTable(encode, limit=3)
    for text in ("a bb ccc", "dddd a", "bb a"):
        ids, counts = t.encode(*string_bytes(pa.array([text])))
        assert ids.tolist() == [len(w) for w in text.split()] and counts.tolist() == [len(ids)]


def test_bpe_query(spark, odd, odd_rows, empty):
    got = bpe.encode_decode_digests(odd, TOK).toPandas()
    want = []
    for (i, t), ids in zip(odd_rows, tokens.reference_ids(TOK, [t for _, t in odd_rows]), strict=True):
        text = tokens.load(TOK).decode(ids, skip_special_tokens=False)
        want.append((key(i), len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    rows = [(-(1 << 63) if i != i else int(i), n, a, b) for i, n, a, b in got.itertuples(index=False)]
    assert sorted(rows) == sorted(want)
    assert bpe.encode_decode(empty, TOK).count() == 0
    one = bpe.encode_decode(frame(spark, [(1, "Hello")]), TOK).collect()[0]
    assert one["decoded"] == "hello</w>" and np.frombuffer(one["ids"], "<u4").tolist() == tokens.reference_ids(TOK, ["Hello"])[0]


def brute_best_fit(lengths, capacity):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - n)
        else:
            bins.append(capacity - n)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_plan_is_best_fit_decreasing(lengths):
    rows = packing.plan({n: lengths.count(n) for n in set(lengths)}, 20)
    room, used = {}, {}
    for length, lo, hi, first, each, offset in rows.tolist():
        for rank in range(lo, hi):
            s, o = first + (rank - lo) // each, offset + (rank - lo) % each * length
            assert used.setdefault(s, 0) == o
            used[s] += length
            assert used[s] <= 20
    room = sorted(20 - u for u in used.values())
    assert room == brute_best_fit(lengths, 20)


def test_room_tree():
    t = packing.RoomTree(10)
    assert t.tightest(0) is None
    t.push(4, 0, 1)
    t.push(9, 1, 2)
    assert (t.tightest(3), t.tightest(5), t.tightest(10)) == (4, 9, None)
    t.pop(4)
    assert t.tightest(1) == 9


@pytest.mark.parametrize("capacity", [64, 4096])
def test_packing(odd, odd_rows, empty, capacity):
    got = packing.pack(odd, TOK, capacity).toPandas()
    want = []
    for (i, _), ids in zip(odd_rows, tokens.reference_ids(TOK, [t for _, t in odd_rows]), strict=True):
        ids = ids + [1]
        for p, at in enumerate(range(0, len(ids), capacity)):
            cut = ids[at : at + capacity]
            want.append((key(i), p, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    rows = [(-(1 << 63) if r[0] != r[0] else int(r[0]), *r[1:5]) for r in got.itertuples(index=False)]
    assert sorted(rows) == sorted(want)
    bins = []
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["offset"].tolist() == [0, *g["length"].cumsum().tolist()[:-1]]
        bins.append(capacity - int(g["length"].sum()))
    assert sorted(bins) == brute_best_fit([w[3] for w in want], capacity)
    assert packing.pack(empty, TOK).count() == 0


@pytest.mark.parametrize("cuts", [1000, 0])
def test_token_store(spark, odd, odd_rows, empty, cuts, monkeypatch):
    monkeypatch.setattr(token_store, "MAX_CUTS", cuts)
    folder = shared_dir(spark, "t")
    token_store.write(odd, folder, TOK, sample_docs=50)
    got = token_store.read(spark, folder, TOK, with_ids=True).toPandas()
    order = sorted(odd_rows, key=lambda r: (key(r[0]), r[1] or "") if r[1] is not None else (key(r[0]), ""))
    want, start = [], 0
    for (i, _), ids in zip(order, tokens.reference_ids(TOK, [t for _, t in order]), strict=True):
        raw = np.array(ids + [1], "<u4").tobytes()
        want.append((key(i), start, len(ids) + 1, zlib.crc32(raw), raw))
        start += len(ids) + 1
    rows = sorted(((-(1 << 63) if r[0] != r[0] else int(r[0]), *r[1:]) for r in got.itertuples(index=False)), key=lambda r: r[1])
    assert [r[1:4] for r in rows] == [w[1:4] for w in want] and [r[0] for r in rows] == [w[0] for w in want]
    hit = {r["doc_id"]: r["ids"] for r in token_store.lookup(spark, folder, TOK, [5, 14]).collect()}
    assert hit[14] == tokens.reference_ids(TOK, ["one"])[0] + [1] and set(hit) == {5, 14}
    nothing = shared_dir(spark, "t")
    token_store.write(empty, nothing, TOK)
    assert token_store.read(spark, nothing, TOK).count() == 0


# ---- search


@pytest.mark.parametrize("blocks", [(16_384, 4_096), (40, 3)])
def test_top_k(spark, blocks):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).tolist()) for i in range(150)] + [(200 + i, [0.5] * 12) for i in range(80)]
    rows += [(300, None), (301, [1.0, None] + [0.0] * 10), (302, [float("nan")] * 12), (303, [float("inf")] * 12), (None, [1.0] * 12), (304, []), (350, [0.1] * 3), (351, [0.3] * 3)]
    rows += [(50, rows[50][1]), (50, rows[51][1]), (7, rows[7][1]), (7, rows[100][1])] + [(9, rows[9][1])] * 7
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "vec_id long, embedding array<float>, score string, cell string")
    got = topk.top_k(df, F.col("vec_id") % 50 == 0, k=5, candidate_rows=blocks[0], query_rows=blocks[1]).toPandas()
    vecs = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in vecs if i % 50 == 0}):
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), c) for i, v in vecs for c, w in vecs if i == q != c and len(v) == len(w))
        want += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scored[:5])]
    assert sorted(map(tuple, got[["query_id", "rank", "vec_id", "score"]].to_numpy().tolist())) == sorted(want)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_pairs_are_pruned():
    """Of smooth vectors in clusters most pairs never reach their exact product; of noise none may be lost."""
    rng = np.random.default_rng(4)
    centres = np.repeat(rng.normal(scale=200, size=(40, 8)), 8, axis=1)
    smooth = np.floor(centres[rng.integers(0, 40, 3000)] + rng.normal(scale=5, size=(3000, 64)))
    noise = np.floor(rng.normal(scale=100, size=(3000, 64)))
    for x, most in ((smooth, 0.2), (noise, 1.0)):
        ids, tally = np.arange(3000), {}
        row, col, score = topk.best_of_block(ids[:200], x[:200], ids, x, 5, tally)
        assert tally["pairs"] == 200 * 3000 and tally["exact"] <= most * tally["pairs"]
        full = x[:200] @ x.T
        full[ids[:200], ids[:200]] = -np.inf
        for q in range(200):
            want = sorted((-v, c) for c, v in enumerate(full[q]))[:5]
            assert sorted((-int(v), int(c)) for c, v in zip(col[row == q], score[row == q], strict=True)) == want


@settings(max_examples=50, deadline=None)
@given(st.integers(1, 20), st.integers(0, 2**31))
def test_bounds_hold(d, seed):
    rng = np.random.default_rng(seed)
    x = np.floor(rng.normal(scale=100, size=(20, d)))
    exact = x @ x.T
    for s in (1, 2, 4, 8):
        b = topk.segment_statistics(x, s)
        assert (b @ b.T >= exact - 1e-6 * (1 + np.abs(exact))).all()


def test_large_components():
    q = np.array([[1e18, 1e18]])
    ids, x = np.array([1, 2]), np.array([[1e18, -1e18], [1e19, 1e19]])
    got = topk.best_of_block(np.array([0]), q, ids, x, 2)
    assert dict(zip(got[1].tolist(), got[2].tolist(), strict=True)) == {1: (1 << 63) - 1, 0: 0}


# ---- suffix dedup


def brute_dedup(rows, length=100):
    seen, out = set(), []
    for i, t in sorted(rows, key=lambda r: key(r[0])):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            w = b[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            else:
                seen.add(w)
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((key(i), len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return sorted(out)


@pytest.fixture(scope="module")
def repeats(odd_rows):
    rng = random.Random(5)
    line = "The same line stands in very many texts and is a good deal longer than one hundred bytes, as such lines are, you know."
    rows = [r for r in odd_rows if r[0] not in (16, 17)] + [(1000 + i, " ".join(str(rng.random()) for _ in range(8)) + "\n" + line + "\n" + " ".join(str(rng.random()) for _ in range(8))) for i in range(60)]
    return rows + [(2000 + i, "ab" * 150) for i in range(3)]


@pytest.mark.parametrize("common,held", [(suffix_dedup.COMMON, suffix_dedup.HELD_RUNS), (1, suffix_dedup.HELD_RUNS), (suffix_dedup.COMMON, 100)])
def test_suffix_dedup(spark, repeats, common, held):
    got = suffix_dedup.deduplicate(frame(spark, repeats).repartition(3), with_text=False, common=common, held=held).toPandas()
    rows = [(-(1 << 63) if r[0] != r[0] else int(r[0]), *r[1:]) for r in got.itertuples(index=False)]
    assert sorted(rows) == brute_dedup(repeats)


def test_suffix_dedup_keeps_columns(spark, repeats, empty):
    out = suffix_dedup.deduplicate(frame(spark, repeats), prefix="__x_")
    assert out.columns[: len(empty.columns)] == empty.columns
    rows = {key(r["doc_id"]): r for r in out.collect()}
    assert rows[2]["text"] is None and rows[1]["n_bytes"] == "d" and rows[12]["text"] == ""
    assert rows[1]["text"] == dict((key(i), t) for i, t in repeats)[1]
    assert suffix_dedup.deduplicate(empty).count() == 0


def test_rows_listed_twice(spark):
    text = "".join(chr(97 + i % 26) for i in range(40)) + " and then " + "0123456789" * 9
    rows = [(1, text), (1, text), (2, text), (3, "short"), (3, "other")]
    got = suffix_dedup.deduplicate(frame(spark, rows), with_text=False).toPandas().sort_values("doc_id")
    assert got[got["doc_id"] == 1]["n_removed"].tolist()[0] == got[got["doc_id"] == 1]["n_removed"].tolist()[1]
    assert got[got["doc_id"] == 2]["n_removed"].tolist() == [len(text)] and got[got["doc_id"] == 3]["n_removed"].tolist() == [0, 0]


@pytest.mark.parametrize("common,held", [(suffix_dedup.COMMON, suffix_dedup.HELD_RUNS), (1, suffix_dedup.HELD_RUNS), (suffix_dedup.COMMON, 1)])
def test_rows_listed_twice_keep_the_first_copy(spark, common, held):
    rng = random.Random(11)
    text = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    passage, a, b, c, d = text(150), text(300), text(200), text(250), text(90)
    rows = [(1, a)] * 3 + [(2, passage + b)] * 2 + [(3, "x" + a + "y")] * 2 + [(4, c + passage)] * 2 + [(5, d)] * 2 + [(None, text(400))] * 2 + [(6, passage), (7, a), (7, a)]
    want = [(i, "xy" if i == 3 else c if i == 4 else "" if i in (6, 7) else t) for i, t in rows]
    for df in (frame(spark, rows).repartition(6), frame(spark, rows).coalesce(1)):
        out = suffix_dedup.deduplicate(df, common=common, held=held).collect()
        assert sorted((key(r["doc_id"]), r["text"]) for r in out) == sorted((key(i), t) for i, t in want)


def test_parts_without_copies():
    data = np.frombuffer(b"abcdefghij", np.uint8)
    parts = {k: np.array([v]) for k, v in (("doc", 1), ("tie", 0), ("slot", 0), ("pos", 0), ("size", 10), ("at", 0))}
    assert suffix_dedup.size(suffix_dedup.later_copies(data, parts, 4)) == 0
    none = {k: v[:0] for k, v in parts.items()} | {k: np.zeros(0, np.int64) for k in ("sdoc", "stie", "sslot", "spos", "sat")}
    assert suffix_dedup.size(suffix_dedup.confirmed(data, none, 4)) == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5), min_size=1, max_size=12), st.integers(0, 2**31), st.sampled_from([(1 << 20, 1 << 18), (40, 8), (1, 1)]))
def test_stretches_in_lots_and_pieces(picks, seed, sizes):
    """Proposals of any window's first copy, merged to stretches and cut to lots, give the brute-force spans."""
    rng, length = random.Random(seed), 6
    blocks = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 30))) for _ in range(6)]
    texts = ["".join(blocks[(p + k) % 6] for k in range(rng.randint(1, 4))) for p in picks]
    data, offsets = string_bytes(pa.array(texts))
    raw, first, rows = data.tobytes(), {}, []
    for d in range(len(texts)):
        for p in range(len(texts[d]) - length + 1):
            w = texts[d][p : p + length]
            if w in first:
                rows.append((d, p, *first[w]))
            else:
                first[w] = (d, p)
    doc, pos, sdoc, spos = (np.array(c, np.int64) for c in (zip(*rows) if rows else [[]] * 4))
    t = {"doc": doc, "tie": doc * 0, "slot": doc * 0, "pos": pos, "size": doc * 0 + length, "at": offsets[doc] + pos}
    t |= {"sdoc": sdoc, "stie": doc * 0, "sslot": doc * 0, "spos": spos, "sat": offsets[sdoc] + spos}
    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffix_dedup, "LOT", sizes[0])
        m.setattr(suffix_dedup, "PIECE", sizes[1])
        spans = suffix_dedup.confirmed(data, t, length)
    got = [bytearray(len(x)) for x in texts]
    for d, p, n, at in zip(*(spans[k].tolist() for k in ("doc", "pos", "size", "at")), strict=True):
        got[d][p : p + n] = b"x" * n
        assert raw[at : at + n] == texts[d][p : p + n].encode()
    assert [sum(map(bool, g)) for g in got] == [want[2] for want in brute_dedup(list(enumerate(texts)), length)]


def test_long_text_in_segments(spark, monkeypatch):
    rng = np.random.default_rng(0)
    text = bytes(rng.integers(97, 123, 30_000, dtype=np.uint8)).decode()
    rows = [(1, text), (2, "zz" + text[100:29_000] + "yy")]
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 7_000)
    got = []
    for batch in [pa.RecordBatch.from_pydict({"text": pa.array([t for _, t in rows]), "__doc": pa.array([1, 2]), "__tie": pa.array([0, 0], pa.int32()), "__slot": pa.array([0, 0], pa.int32())})]:
        for data, offsets, doc, _, _, base in suffix_dedup.segments([batch], 100):
            row, lo, hi, _, _ = suffix_dedup.runs(data, offsets, 100, 32)
            for r, a, b in zip(row, lo - offsets[row] + base[row], hi - offsets[row] + base[row], strict=True):
                got += [(int(doc[r]), int(p)) for p in range(a, b + 1)]
    assert sorted(got) == [(d, p) for d, t in rows for p in range(len(t) - 99)]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=40).map(lambda b: bytes(c % 3 for c in b)))
def test_longest_previous_factor(data):
    n = len(data)
    want = [max((next((m for m in range(n - p, 0, -1) if data[j : j + m] == data[p : p + m]), 0) for j in range(p)), default=0) for p in range(n)]
    assert suffix_dedup.longest_previous_factor(data).tolist() == want
    for length in (1, 3, 8, 9, 16):
        if n >= length:
            starts = np.arange(n - length + 1)
            assert suffix_dedup.previous_factors(np.frombuffer(data, np.uint8), starts, length).tolist() == [min(length, w) for w in want[: n - length + 1]]


@given(st.lists(st.integers(0, 1000), unique=True, max_size=40))
def test_nearest_smaller(a):
    before, after = suffix_dedup.nearest_smaller(np.array(a, dtype=np.int64))
    for i, v in enumerate(a):
        assert before[i] == next((j for j in range(i - 1, -1, -1) if a[j] < v), -1)
        assert after[i] == next((j for j in range(i + 1, len(a)) if a[j] < v), len(a))


# ---- near duplicates


def brute_classes(rows):
    import re

    sets = []
    for _, t in rows:
        w = re.findall(r"[0-9a-z_\x80-\U0010ffff]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    n = len(rows)
    parent, links = list(range(n)), [0] * n

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for i in range(n):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                links[i] += 1
                links[j] += 1
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((key(d), key(least.get(find(i))), links[i]) for i, (d, _) in enumerate(rows))


def classes(df):
    out = jaccard_join.near_duplicates(df).collect()
    return sorted((key(r["doc_id"]), key(r["class_id"]), r["n_links"]) for r in out)


def test_near_duplicates(odd, odd_rows, empty):
    assert classes(odd) == brute_classes(odd_rows)
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_recall_on_a_whole_table(spark):
    """Every class and every link of the 0.01 table, sets compared by brute force over their common shingles."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text").collect()]
    want = {d: (c, n) for d, c, n in brute_classes(rows)}
    got = {d: (c, n) for d, c, n in classes(frame(spark, rows).repartition(4))}
    links = sum(n for _, n in want.values())
    assert links > 100 and sum(n for _, n in got.values()) >= 0.999 * links
    assert sum(got[d] == want[d] for d in want) >= 0.999 * len(want)


def test_large_groups_as_grids(spark, monkeypatch):
    rng = random.Random(2)
    base = [f"w{rng.random()}" for _ in range(120)]
    rows = []
    for i in range(70):
        w = list(base)
        for _ in range(3):
            w[rng.randrange(120)] = f"v{rng.random()}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(base)) for i in range(5)] + [(200 + i, f"other text number {i} of its own kind here") for i in range(20)]
    monkeypatch.setattr(jaccard_join, "BLOCK", 4)
    monkeypatch.setattr(jaccard_join, "MAX_DEPTH", 3)
    assert classes(frame(spark, rows)) == brute_classes(rows)


def test_recall_of_runs():
    rng = np.random.default_rng(0)
    n = jaccard_join.runs_for(0.9999, 0.8, 2)
    met = 0
    for _ in range(400):
        shared, own = rng.integers(1, 1 << 62, 160, dtype=np.uint64), rng.integers(1, 1 << 62, (2, 20), dtype=np.uint64)
        sets = [np.sort(np.r_[shared, o]) for o in own]
        sketch = jaccard_join.sketches(np.concatenate(sets), np.array([180, 180]))
        hit = False
        for r in range(n):
            keys, rows = jaccard_join.mix(np.array([r + 1] * 2, np.uint64)), np.arange(2)
            for _ in range(2):
                at, keys = jaccard_join.children(keys, sketch[rows], 0.8)
                rows = rows[at]
            hit |= bool(set(keys[rows == 0]) & set(keys[rows == 1]))
        met += hit
    assert met >= 398


def test_recall_in_large_parts(spark, monkeypatch):
    """Pairs at the threshold, each of whose parts is split down to MAX_DEPTH, are all found."""
    rows = []
    for i in range(600):
        shared, own = [f"p{i}w{k}" for k in range(84)], [[f"p{i}{x}{k}" for k in range(10)] for x in "ab"]
        rows += [(2 * i + x, " ".join(shared + o)) for x, o in enumerate(own)]
    monkeypatch.setattr(jaccard_join, "BLOCK", 0.25)
    assert classes(frame(spark, rows).repartition(4)) == sorted((d, d - d % 2, 1) for d, _ in rows)


def test_runs_grow_with_depth():
    runs = [jaccard_join.runs_at(0.9999, 0.8, d) for d in range(jaccard_join.DEPTH, jaccard_join.MAX_DEPTH + 1)]
    assert runs == sorted(set(runs)) and all(jaccard_join.runs_for(0.9999, 0.8, d) <= r for d, r in enumerate(runs, jaccard_join.DEPTH))


# ---- classifiers


@pytest.mark.parametrize("op", [quality, toxicity])
def test_scores_of_odd_tables(spark, odd, empty, op):
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 16)] + [(1, 0, 0), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    out = op.score(odd, labels).toPandas()
    assert len(out) == odd.count() and out["score"].between(0, 1).all()
    assert (out["predicted"] == (out["score"] >= op.THRESHOLD)).all()
    assert op.score(empty, labels).count() == 0 and op.score(odd, labels.limit(0)).count() == odd.count()
    kept = op.score(odd, labels, prefix="__x_")
    assert kept.columns == [*odd.columns, "__x_score", "__x_predicted"]


@pytest.mark.parametrize("op,target,least", [(quality, "quality", 0.9), (toxicity, "toxic", 0.85)])
def test_held_out_accuracy(spark, op, target, least):
    sf = SF.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.digest(op.score(docs, labels, keep=["doc_id"])).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(scored) > 50 and (scored["predicted"] == scored[target]).mean() >= least


@pytest.mark.parametrize("scale", ["0.01", "0.1"])
def test_held_out_toxic_texts_are_found(spark, scale):
    """Of the toxic texts and of the alarms: a score that is the same for all texts has no recall."""
    sf = SF.replace("0.001", scale)
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    s = quality.digest(toxicity.score(docs, labels, keep=["doc_id"])).join(labels, "doc_id").filter("held_out").toPandas()
    found = ((s["predicted"] == 1) & (s["toxic"] == 1)).sum()
    assert found >= 0.85 * (s["toxic"] == 1).sum() > 0 and found >= 0.85 * (s["predicted"] == 1).sum()


def test_held_out_labels_are_not_read(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    from plumbline.llm.labelled import held_out

    turned = labels.withColumns({c: F.when(held_out(), 1 - F.col(c)).otherwise(F.col(c)) for c in ("quality", "toxic")})
    for op in (quality, toxicity):
        a, b = (op.score(docs, x, keep=["doc_id"]).toPandas().sort_values("doc_id")["score"].to_numpy() for x in (labels, turned))
        assert (a == b).all()


def edits(a, b):
    """Least number of insertions, deletions, substitutions and swaps of neighbours."""
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", min_size=1, max_size=8))
def test_automaton_is_edit_distance(word):
    terms = ["abcab", "cabba", "bca", "aabbccab", "bbca"]
    lex = toxicity.Lexicon(terms, ["ccc"])
    letters = np.frombuffer(toxicity.fold(word), np.uint8)
    kind = int(lex.match(letters, np.array([0]), np.array([len(letters)]))[0])
    if word in terms:
        assert kind == lex.EXACT
    elif word.startswith("ccc"):
        assert kind == lex.STEM
    else:
        mild = {word[:i] + word[i + 1 :] for i in range(len(word))} | {word[:i] + word[i + 1] + word[i] + word[i + 2 :] for i in range(len(word) - 1)}
        near = [t for t in terms if (len(t) >= 5 and edits(word, t) == 1) or (len(t) == 4 and t in mild)]
        assert (kind in (lex.FUZZY, lex.LONG_FUZZY)) == bool(near)
        assert (kind == lex.LONG_FUZZY) == any(len(t) >= toxicity.LONG_TERM for t in near)


def test_letters_apart_and_short_terms():
    lex = toxicity.Lexicon(["idiot", "scum"], [])

    def kinds(text):
        return toxicity.hits(lex, *string_bytes(pa.array([text])))[1].tolist()

    assert kinds("an i d i o t here") == kinds("an I-D-I-O-T here") == kinds("i d i o t") == [lex.EXACT]
    assert kinds("scumm sucm sccum") == [lex.FUZZY] * 3 and kinds("scam slum cum scu") == []
    rows, kind, _, words = toxicity.hits(lex, *string_bytes(pa.array(["a b c", "s c", "u m", "x y z i d i o t", "s c u m"])))
    assert rows.tolist() == [4] and words.tolist() == [3, 2, 2, 1, 1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["idiot", "idoit", "scum", "said", "you", '"', "plain", "word", "x", "zitronex", "other"]), max_size=30), min_size=1, max_size=4))
def test_hits_and_windows(texts):
    """Hits, their context weights and word counts against a word-by-word version."""
    lex = toxicity.Lexicon(["idiot", "scum"], ["zitr"])
    kinds = {"idiot": lex.EXACT, "scum": lex.EXACT, "idoit": lex.FUZZY, "zitronex": lex.STEM}
    want, counts = [], []
    for r, text in enumerate(texts):
        words, marks, total = [], [], text.count('"')
        apart = []
        for i, w in enumerate(text):
            if w != '"':
                apart.append(w == "x")
                words.append(w)
                marks.append(text[:i].count('"'))
        at = 0
        while at < len(words):  # letters apart, read as one word
            n = 0
            while at + n < len(words) and apart[at + n]:
                n += 1
            if n >= toxicity.SPACED:
                words[at : at + n], marks[at : at + n], apart[at : at + n] = ["x" * n], [marks[at]], [False]
            at += 1
        counts.append(len(words))
        for i, w in enumerate(words):
            if w not in kinds:
                continue
            lo, hi = max(0, i - toxicity.WINDOW), min(len(words), i + toxicity.WINDOW + 1)
            opened = marks[i] - (0 if lo == 0 else marks[lo])
            closed = (total if hi == len(words) else marks[hi - 1]) - marks[i]
            quoted = marks[i] % 2 == 1 and opened > 0 and closed > 0
            near = words[lo:hi]
            weight = (0.4 if quoted else 1.0) * ((0.5 if quoted else 0.8) if {"said", "word"} & set(near) else 1.0)
            weight *= 1 + 0.2 * ("you" in near) + 0.1 * min(5, sum(x in kinds for x in near) - 1)
            want.append((r, kinds[w], round(weight, 9)))
    rows, kind, weight, words = toxicity.hits(lex, *string_bytes(pa.array([" ".join(t) for t in texts])))
    assert list(zip(rows.tolist(), kind.tolist(), weight.round(9).tolist(), strict=True)) == want and words.tolist() == counts


def test_cues_are_learned():
    """Words that stand near hits in harmless texts alone lower a hit, whatever the language."""
    texts = [f"la palabra idiot aparece citada aqui n{i}" for i in range(20)] + [f"sois todos idiot m{i}" for i in range(20)]
    y = [0] * 20 + [1] * 20
    lex = toxicity.Lexicon(["idiot"], [])
    lex.cues = toxicity.learn_cues(lex, [(*string_bytes(pa.array(texts)), np.array(y))])
    weight = toxicity.hits(lex, *string_bytes(pa.array(["palabra idiot", "todos idiot", "nada idiot"])))[2]
    assert weight[0] < weight[2] < weight[1]


def test_ftrl_updates():
    """Against updates written out one coordinate at a time, with numbers alone."""
    import math

    rng = random.Random(9)
    model, z, n = quality.Ftrl(12, alpha=0.2, beta=0.7, l1=0.05, l2=0.3), {}, {}

    def weight(i):
        v = z.get(i, 0.0)
        return 0.0 if abs(v) <= 0.05 else -(v - math.copysign(0.05, v)) / ((0.7 + math.sqrt(n.get(i, 0.0))) / 0.2 + 0.3)

    for _ in range(300):
        at = sorted(rng.sample(range(12), rng.randint(1, 5)))
        x, y = [rng.uniform(0, 2) for _ in at], float(rng.random() < 0.4)
        p = 1 / (1 + math.exp(-sum(weight(i) * v for i, v in zip(at, x, strict=True))))
        assert abs(model.update(np.array(at), np.array(x), y) - p) < 1e-12
        for i, v in zip(at, x, strict=True):
            g = (p - y) * v
            z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / 0.2 * weight(i)
            n[i] = n.get(i, 0.0) + g * g
    assert np.allclose(model.weights(), [weight(i) for i in range(12)], atol=1e-12)


def test_quality_scores_are_sparse_dot_products():
    rng = np.random.default_rng(6)
    weights = rng.normal(size=(1 << quality.BITS) + 1)
    texts = ["one two THREE two", None, "", "one", "Two two! two, 4x4 çé", "one two THREE two"]
    got = quality.scores(weights, 0.25, *string_bytes(pa.array(texts, pa.string())))
    for i, t in enumerate(texts):
        f, _, words = quality.features(*string_bytes(pa.array([t], pa.string())))
        dot = sum(weights[j] for j in f.ravel().tolist()) * quality.SCALE / max(1, int(words[0])) + weights[int(quality._length_feature(words)[0])] + weights[-1] + 0.25
        assert abs(got[i] - 1 / (1 + np.exp(-dot))) < 1e-9
    assert got[0] == got[5] and got[1] == got[2]


def test_word_grams_are_hashed():
    """Words that follow one another in another order have the same 1-grams and other 2- and 3-grams; texts don't run into each other."""
    f, rows, words = quality.features(*string_bytes(pa.array(["a b c d", "b a d c", "A B c d", "a b", "c d"])))
    f = [f[rows == r] for r in range(5)]
    assert words.tolist() == [4, 4, 4, 2, 2]
    assert sorted(f[0][:, 0]) == sorted(f[1][:, 0]) and not set(f[0][1:, 1]) & set(f[1][1:, 1]) and not set(f[0][2:, 2]) & set(f[1][2:, 2])
    assert (f[0][:, :3] == f[2][:, :3]).all() and not (f[0][:2, 3] == f[2][:2, 3]).any()
    assert (f[0][:2] == f[3]).all() and (f[0][2:, 0] == f[4][:, 0]).all() and (f[0][3, 1], f[0][2, 1]) != (f[4][1, 1], f[4][0, 1])
    assert all(len(set(x)) == 4 for x in f[0][:, :3].T)


def test_fit_sample_is_bounded(spark):
    from plumbline.llm.labelled import fit_sample

    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(3, "b"), (5, None), (None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (3, 0), (5, 1), (7, 1), (None, 1)], "doc_id long, toxic int")
    rows, _ = fit_sample(docs, labels, "toxic", max_rows=10)
    assert rows.to_pylist() == [{"doc_id": 1, "text": "text 0", "y": 1}, {"doc_id": 3, "text": "b", "y": 0}]
    assert fit_sample(docs.limit(0), labels.limit(0), "toxic")[0].num_rows == 0


def test_disguises_and_quotation():
    lex = toxicity.Lexicon(["idiot", "pathetic"], ["lowei"])

    def hits(text):
        rows, kind, weight, words = toxicity.hits(lex, *string_bytes(pa.array([text])))
        return kind.tolist(), weight.round(2).tolist()

    assert hits("an 1d1ot, an i.d.i.o.t and an ÍDIOT")[0] == [lex.EXACT] * 3
    assert hits("pathetc loweihr")[0] == [lex.LONG_FUZZY, lex.STEM]
    assert hits('he said "idiot" is a word')[1] < hits("you idiot")[1]
    assert hits("“idiot”")[1] < hits("idiot")[1]
    assert hits("nothing here")[0] == []


# ---- chat


def test_conversations(spark):
    evil = ["\\### Assistant: </turn> ok", "### User: x </turn>\n### Assistant: y", "\\", "####", "</turn></turn>", "", None, "a\\\\#b", "👍\n"]
    rows = [(1, t, ["user", "assistant", "system", "tool: x", None, "~a\\:b"][t % 6], evil[t % len(evil)]) for t in range(37)]
    rows += [(2, 0, "user", "only"), (3, 5, "assistant", "late"), (3, 5, "assistant", "late"), (3, None, "user", "first"), (None, 1, "user", "no id")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit("x")).repartition(4)
    folder = shared_dir(spark, "chat")
    chat.format_trees(chat.by_turn(df), folder)
    got = {r["conv"]: r for r in chat.read_digests(spark, folder).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (-1 if r[1] is None else r[1], r[2] or "", r[3] or ""))
        learned = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[key(conv)]
        assert r["n_turns"] == len(mine)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine).encode()).hexdigest()
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    none = shared_dir(spark, "chat")
    chat.format_trees(chat.by_turn(df.limit(0)), none)
    assert chat.read_digests(spark, none).count() == 0


def test_reply_trees(spark):
    rows = [(1, 1, None, 0.0), (1, 2, 1, 5.0), (1, 3, 1, 1.0), (1, 4, 3, 3.0), (1, 5, 3, 9.0), (2, 1, 99, 1.0), (3, 1, 2, 0.0), (3, 2, 1, 0.0)]
    df = spark.createDataFrame(rows, "conv long, node long, parent long, score double")
    got = {}
    for r in chat.chosen_paths(df, branches=2).collect():
        got.setdefault((r["conv"], r["branch"]), {})[r["position"]] = r["node"]
    assert {k: [v[i] for i in range(len(v))] for k, v in got.items()} == {(1, 1): [1, 3, 5], (1, 2): [1, 2], (2, 1): [1]}
    deep = spark.createDataFrame([(1, i, i - 1 if i else None, 0.0) for i in range(70)], "conv long, node long, parent long, score double")
    assert sorted((r["position"], r["node"]) for r in chat.chosen_paths(deep).collect()) == [(i, i) for i in range(70)]


def test_repeated_messages_and_ranked_branches(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 5.0, "assistant", "good"), (1, 3, 1, 1.0, "assistant", "bad"), (1, 4, 2, 0.0, "user", "more")] * 2
    rows += [(1, 4, 3, 9.0, "user", "late"), (1, None, 1, 99.0, "user", "no node"), (None, 1, None, 1.0, "user", "no conv"), (2, 7, None, None, None, None)]
    df = spark.createDataFrame(rows, "conv long, node long, parent long, score double, role string, text string")
    got = sorted(map(tuple, chat.chosen_paths(df, branches=2).collect()))
    assert got == [(1, 1, 0, 1), (1, 1, 1, 2), (1, 1, 2, 4), (1, 2, 0, 1), (1, 2, 1, 3), (2, 1, 0, 7)]
    folder = shared_dir(spark, "chat")
    chat.format_trees(df, folder, branches=2)
    texts = {}
    for r in spark.read.parquet(f"{folder}/formatted").orderBy("conv", "branch", "position").collect():
        texts.setdefault((r["conv"], r["branch"]), []).append(chat.parse(r["piece"]))
    assert texts == {(1, 1): [("user", "q"), ("assistant", "good"), ("user", "more")], (1, 2): [("user", "q"), ("assistant", "bad")], (2, 1): [("", "")]}


# ---- media


def test_media_query(odd, odd_rows, empty):
    got = media.media_features(media.text_media(odd)).toPandas()
    want = []
    for i, t in odd_rows:
        b = (t or "").encode()
        payload = b + bytes(-len(b) % 64 if b else 64)
        want.append((key(i), len(b), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    rows = [(-(1 << 63) if r[0] != r[0] else int(r[0]), *r[1:5]) for r in got.itertuples(index=False)]
    assert sorted(rows) == sorted(want)
    assert got.groupby("payload_sha256")["feature"].nunique().max() == 1
    assert media.text_media(empty).count() == 0 and media.media_features(media.text_media(empty)).count() == 0


def test_media_is_stored_and_read_back(spark, odd, odd_rows):
    folder = shared_dir(spark, "media")
    media.store_texts(odd, folder)
    stored = {(r["doc_id"], r["n_bytes"]): bytes(r["media"]) for r in spark.read.parquet(f"{folder}/media").collect()}
    assert {m[:2] for m in stored.values()} == {b"P5", b"BM"}
    rows = spark.read.parquet(f"{folder}/features").collect()
    assert len(rows) == len(odd_rows)
    for r in rows:
        raw = stored[r["doc_id"], r["n_bytes"]]
        if r["doc_id"] not in (16, 17):
            assert (r["media_bytes"], r["media_sha256"]) == (len(raw), hashlib.sha256(raw).hexdigest())
            small = np.concatenate([np.load(io.BytesIO(t["npy"])) for t in r["tiles"]], axis=1)
            assert (small == np.round(media.area_resize(media.decode(raw), 16, 32))).all()


def test_media_without_pixels(spark):
    whole = media.encode_bmp(np.zeros((3, 5), np.uint8))
    broken = [None, b"", b"GIF89a", b"P5\n", b"P5\n9 9\n255\nabc", b"P5\n99999999999 99999999999\n255\n", b"P4\n9999999999 99999999999\n", b"P5\n0 0\n255\n", b"P5\n1 1\n99999\nab", b"P2\n2 2\n255\n1 2 3", b"P2\n1 1\n255\nx", b"P6\n1 1\n255\nab", b"BM", whole[:40], whole[:-1], whole[:18] + b"\xff\xff\xff\x7f" * 2 + whole[26:]]
    df = spark.createDataFrame([(i, 0, b) for i, b in enumerate(broken)] + [(99, 0, whole)], "doc_id long, n_bytes long, media binary")
    rows = {r["doc_id"]: r for r in media.media_features(df).collect()}
    for i, b in enumerate(broken):
        r = rows[i]
        assert (r["payload_bytes"], r["payload_sha256"], r["tail_crc32"], r["feature"], r["tiles"]) == (None, None, None, None, []), (i, b)
        assert r["media_bytes"] == (None if b is None else len(b))
    assert rows[99]["payload_bytes"] == 15 and len(rows) == len(broken) + 1


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 9), st.integers(1, 9), st.booleans(), st.integers(0, 2**31))
def test_images_round_trip(h, w, color, seed):
    x = np.random.default_rng(seed).integers(0, 256, (h, w, 3) if color else (h, w), dtype=np.uint8)
    for make in (media.encode_netpbm, media.encode_bmp):
        assert (media.decode(make(x)) == x).all()


def test_other_images():
    assert media.decode(b"P1\n# note\n2 2\n1 0\n0 1\n").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P4\n2 2\n\x80\x40").tolist() == [[0, 255], [255, 0]]
    assert media.decode(b"P2\n2 1\n255\n3 200\n").tolist() == [[3, 200]]
    assert media.decode(b"P5\n1 1\n65535\n\x01\x02").tolist() == [[258]]
    with pytest.raises(ValueError):
        media.decode(b"GIF89a")


def test_area_resize():
    x = np.arange(12.0).reshape(3, 4)
    assert np.allclose(media.area_resize(x, 3, 4), x)
    assert np.allclose(media.area_resize(x, 1, 1), x.mean())
    assert np.allclose(media.area_resize(x, 1, 2), [[x[:, :2].mean(), x[:, 2:].mean()]])
    assert np.allclose(media.area_resize(np.array([[0.0, 3.0, 6.0]]), 1, 2), [[1.0, 5.0]])


def test_tiles(spark):
    x = np.random.default_rng(0).integers(0, 256, (80, 50), dtype=np.uint8)
    df = spark.createDataFrame([(1, media.encode_netpbm(x)), (2, b"no image"), (3, None)], "doc_id long, media binary")
    rows = media.tiles(media.media_features(df, keep=("doc_id",), height=40, width=40, tile=32)).collect()
    assert sorted((r["doc_id"], r["tile_y"], r["tile_x"], np.load(io.BytesIO(r["npy"])).shape) for r in rows) == [(1, 0, 0, (32, 32)), (1, 0, 1, (32, 8)), (1, 1, 0, (8, 32)), (1, 1, 1, (8, 8))]
    assert {r["dhash"] for r in rows} == {media.difference_hash(x)}
