"""Exact copies, spelling variants and alignment against brute force, with odd tables and hostile keys."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from plumbline.llm import align, exact_dedup, queries, spelling
from plumbline.storage import shared_dir

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, id string, key long, word string, n int, link string, part int, n_a string, Text_sha256 string"


def frame(spark, rows):
    """Documents with further columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "a", 1, "b", 2, "c", 3, "d", "e") for i, t in rows], DOCS)


def order(v):
    return tuple("" if x is None else str(x) for x in v)


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(5)
    signs = list("ab .,'1") + ["  ", "\n", "\t", "\xa0", "é", "ñ ", "漢", "👍", " ", "　", "<|endoftext|>", "<s>", "▁", "don't ", "ﬁ", "é", "\x00", "\x85", "Ж ", "<0x41>", "\x0b", "\x0c", "\r"]
    made = [(1000 + k, "".join(rng.choice(signs) for _ in range(rng.randint(0, 40)))) for k in range(300)]
    stems = ["".join(rng.choice("abcdeéÀ") for _ in range(rng.randint(6, 11))) for _ in range(12)]
    made += [(2000 + k, " ".join(rng.choice(stems).replace("a", rng.choice("aaaaaAxé"), 1) for _ in range(60))) for k in range(60)]
    given = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    copies = [(500 + k, " ".join(given[3][1].split()) + "\n" * (k % 3)) for k in range(40)] + [(None, given[3][1]), (None, given[4][1] + "  ")]
    return given + made + copies + [(None, None), (7, ""), (7, ""), (8, " \n\t"), (9, "x" * 30_000), (10, "word " * 8000), (11, given[5][1]), (11, given[5][1]), (12, "-"), (-5, "\x0b\x0c\r ")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# ---- exact copies


def brute_copies(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for text, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        out += [(i, keep, len(members), hashlib.sha256(text.encode()).hexdigest()) for i, _ in members]
    return sorted(out, key=order), len(groups)


def spread(text: bytes) -> int:
    """A key of few values, spread over all bits."""
    return ((len(text) % 13 * 0x9E3779B97F4A7C15) % (1 << 64)) - (1 << 63)


@pytest.mark.parametrize("options", [{}, {"key": lambda t: 7, "held": 1}, {"key": spread, "bucket": 2, "page": 2, "held": 20_000}], ids=["real", "one key", "chains by pages"])
def test_copies_against_brute_force(docs, rows, options):
    got = exact_dedup.deduplicate(docs, **options).collect()
    want, n = brute_copies(rows)
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=order) == want
    kept = [r for r in got if r["kept"]]
    assert len(kept) == n == len({r["text_sha256"] for r in kept}) and all(r["doc_id"] == r["keep_id"] for r in kept)


def test_a_repeated_text_is_few_entries(spark):
    many = frame(spark, [(k, "same text " * 50) for k in range(4000)] + [(9000 + k, f"other {k}") for k in range(50)]).repartition(3)
    assert exact_dedup.entries(many, held=4000).filter("n > 1").count() <= 3
    got = exact_dedup.deduplicate(many, page=2, held=4000)
    assert {(r[0], r[1]) for r in got.groupBy("group_size").count().collect()} == {(4000, 4000), (1, 50)}


def test_empty_table_of_copies(empty):
    out = exact_dedup.deduplicate(empty)
    assert out.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"] and out.count() == 0


def test_ids_may_be_strings(spark):
    got = exact_dedup.deduplicate(spark.createDataFrame([("b", "x y"), ("a", "xy "), (None, "x  y"), ("c", None)], "name string, body string"), "name", "body").collect()
    assert {(r["name"], r["keep_id"], r["kept"]) for r in got} == {("b", None, False), ("a", None, False), (None, None, True), ("c", "c", True)}


def test_directory_doubles(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64)
    found = exact_dedup.grow(spark.createDataFrame([(int(k),) for k in keys], "key long"), bucket=20, step=3)
    at = found.find(keys.view(np.uint64))
    sizes = np.bincount(at, minlength=len(found.local))
    assert sizes.tolist() == found.counts and sizes.max() <= 20 and len(found.slots) == 1 << found.depth
    for b in range(len(found.local)):  # all keys of a bucket, and no others, begin with its prefix
        begins = (keys.view(np.uint64) >> np.uint64(64 - found.local[b])).astype(np.int64) == found.prefix(b)
        assert (begins == (at == b)).all()


def test_index_is_written(spark, docs):
    folder = shared_dir(spark, "index")
    found = exact_dedup.build(docs, folder, bucket=8)
    read = spark.read.parquet(f"{folder}/directory")
    assert read.count() == len(found.slots) and read.select("bucket").distinct().count() == len(found.local) > 1
    buckets = spark.read.parquet(f"{folder}/buckets")
    assert buckets.count() == spark.read.parquet(f"{folder}/entries").count()
    assert max(r["count"] for r in buckets.select("bucket", "key").distinct().groupBy("bucket").count().collect()) <= 8


# ---- spelling variants


def brute_counts(rows, one_in):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if one_in and h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            counts[w] += 1
    return {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}


def distance_one(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    k = next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def brute_forms(words, ratio=10):
    near = {w: [v for v in words if distance_one(w, v)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: b for w, b in best.items() if words[b] >= ratio * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted(((w, form.get(w), root(w), n, len(near[w]), words[form[w]] if w in form else None) for w, n in words.items()), key=order)


@pytest.mark.parametrize("one_in", [None, 3, 31])
def test_variants_against_brute_force(docs, rows, one_in):
    want = brute_forms(brute_counts(rows, one_in))
    got = sorted((tuple(r) for r in spelling.variants(docs, one_in=one_in).collect()), key=order)
    assert got == want and (one_in != 3 or any(w[1] for w in want))


def test_chains_of_forms(spark):
    counts = {"a" * 7 + "b" * k: 10 ** (18 - k) for k in range(18)} | {"tied-xaaaaa": 1, "tied-yaaaaa": 90, "tied-zaaaaa": 90, "ééééééé": 5, "éééééé": 60}
    got = sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in spelling.forms(spark.createDataFrame(list(counts.items()), "word string, n long")).collect())
    assert sorted(got, key=order) == brute_forms(counts)
    assert {r[0]: r[2] for r in got}["a" * 7 + "b" * 17] == "a" * 7


@settings(max_examples=12, deadline=None)
@given(st.sets(st.text("abé", min_size=4, max_size=8), min_size=2, max_size=60))
def test_pairs_against_brute_force(spark, words):
    got = {frozenset(r) for r in spelling.near_pairs(spark.createDataFrame([(w,) for w in sorted(words)], "word string")).collect()}
    assert got == {frozenset((a, b)) for a in words for b in words if distance_one(a, b)}


def test_empty_table_of_variants(spark, empty):
    assert spelling.variants(empty).columns == ["word", "form", "root", "n", "n_near", "form_n"] and spelling.variants(empty).count() == 0
    assert spelling.variants(frame(spark, [(1, None), (2, ""), (3, "short words"), (4, "onlyonce")])).count() == 0


# ---- alignment


def brute_align(rows):
    a_tok = Tokenizer.from_file(queries.BYTES_TOKENIZER)
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=queries.PIECES_TOKENIZER)
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    value = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
    made, pairs = [], Counter()
    for i, t in rows:
        a = a_tok.encode(" " + t, add_special_tokens=False).ids if t else []
        b = b_tok.encode(t) if t else []
        a_bytes = [bytes(value[c] for c in a_tok.id_to_token(k)) for k in a]
        b_bytes = [bytes([k - 3]) if b_tok.is_byte(k) else b_tok.id_to_piece(k).replace("▁", " ").encode() for k in b]
        if not t or b"".join(a_bytes) != (" " + t).encode() or b"".join(b_bytes) != (" " + t).encode():
            made.append((i, [], [], [], []))
            continue
        a_end, b_end = np.cumsum([len(x) for x in a_bytes]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
        groups, links, p, q = [], [], 0, 0
        for end in sorted({*a_end} & {*b_end}):
            p2, q2 = a_end.index(end) + 1, b_end.index(end) + 1
            groups.append((a[p:p2], b[q:q2]))
            for x in range(p, p2):
                for y in range(q, q2):
                    if max(a_end[x] - len(a_bytes[x]), b_end[y] - len(b_bytes[y])) < min(a_end[x], b_end[y]):
                        links.append((a[x], b[y]))
            p, q = p2, q2
        made.append((i, a, b, groups, links))
        pairs.update(set(links))
    top = defaultdict(int)
    for (a, _), n in pairs.items():
        top[a] = max(top[a], n)
    shown = lambda g: ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in g)
    return sorted(((i, len(a), len(b), len(g), len(ls), sum(pairs[x] == top[x[0]] for x in ls), sum(pairs[x] for x in ls), shown(g)) for i, a, b, g, ls in made), key=order)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


@pytest.mark.parametrize("block", [1_000_000, 500])
def test_alignment_against_brute_force(docs, rows, block):
    mine = [r for r in rows if r[0] != 10]  # 8000 words at once are beyond the brute force here
    got = align.align(docs.filter("doc_id is null or doc_id <> 10"), queries.BYTES_TOKENIZER, queries.PIECES_TOKENIZER, block=block)
    want = brute_align(mine)
    assert sorted((tuple(r) for r in got.select(*COLUMNS, "groups").collect()), key=order) == want
    assert any(w[1] == 0 for w in want) and any(w[3] > w[1] > 0 or w[1] > w[3] > 0 for w in want)


def test_digests_are_those_of_groups(docs):
    args = (docs.filter("doc_id < 10"), queries.BYTES_TOKENIZER, queries.PIECES_TOKENIZER)
    a = align.align(*args).withColumn("d", F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)))
    b = align.align(*args, with_groups=False)
    assert sorted((tuple(r) for r in a.select(*COLUMNS, "d").collect()), key=order) == sorted((tuple(r) for r in b.select(*COLUMNS, "groups_sha256").collect()), key=order)


def test_units_forget(rows):
    """A worker that may remember nothing gives the same alignments."""
    from plumbline.llm._text import string_bytes
    import pyarrow as pa

    texts = [t for _, t in rows[:250]]
    whole = align.Units(queries.BYTES_TOKENIZER, queries.PIECES_TOKENIZER)
    sums, groups, codes, at = whole.align(*string_bytes(pa.array(texts, pa.string())))
    again = align.Units(queries.BYTES_TOKENIZER, queries.PIECES_TOKENIZER)
    for k, t in enumerate(texts):
        again.clear()
        s, g, c, _ = again.align(*string_bytes(pa.array([t], pa.string())))
        assert s[0].tolist() == sums[k].tolist() and g[0] == groups[k] and c.tolist() == codes[at == k].tolist()


def test_empty_table_of_alignments(empty):
    assert align.align(empty, queries.BYTES_TOKENIZER, queries.PIECES_TOKENIZER).count() == 0
