"""Token-id output: one zstandard frame per document, with a shared dictionary.

The store is a folder of Parquet tables that Spark itself writes and reads, so
it may be in any store that Spark reaches:

* `dictionary`: one row, the SHA-256 of the dictionary and its bytes.
* `blocks`: rows of some hundred documents in doc_id order.  `payload` holds
  their frames one after the other; `doc_ids`, `offsets` and `n_tokens` are
  the index by which a single document is found and decompressed alone.
* `totals`: ids per partition, from which global positions follow.

The dictionary is trained on the id arrays of a bounded sample, as its size is
fixed: `sample_docs` documents of at most `sample_chars` characters, chosen by
hash of their id.  All documents are written whole.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm._text import partitions, slices, string_bytes
from plumbline.llm.tokens import library_table, vocabulary, with_end

BLOCK_DOCS, BLOCK_BYTES = 512, 1 << 20
#: Ranges up to this number are found by an expression; beyond it Spark samples the rows for them.
MAX_CUTS = 1000
BLOCKS = "part int, block int, dict_sha256 string, doc_ids array<bigint>, offsets array<bigint>, n_tokens array<bigint>, payload binary"


def _width(path: str) -> str:
    return "<u2" if len(vocabulary(path)) <= 1 << 16 else "<u4"


@functools.lru_cache(maxsize=4)
def _compressor(dictionary: bytes, level: int):
    import zstandard as zstd

    return zstd.ZstdCompressor(level=level, dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None)


@functools.lru_cache(maxsize=4)
def _decompressor(dictionary: bytes):
    import zstandard as zstd

    return zstd.ZstdDecompressor(dict_data=zstd.ZstdCompressionDict(dictionary) if dictionary else None)


def train_dictionary(docs: DataFrame, path: str, end_id: int, n_docs: int, size: int, sample_docs: int, sample_chars: int) -> bytes:
    """A zstandard dictionary of about `size` bytes from the id arrays of a bounded sample; empty where the sample is too small."""
    import zstandard as zstd

    share = min(1.0, 2 * sample_docs / max(1, n_docs))
    hashed = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    rows = docs.filter((hashed < int(share * (1 << 20))) & (F.length("text") <= sample_chars)).select("text").limit(sample_docs).toArrow()
    data, offsets = string_bytes(rows.column("text"))
    ids, counts = with_end(*library_table(path).encode(data, offsets), end_id)
    at = np.r_[0, np.cumsum(counts)]
    samples = [ids[a:b].astype(_width(path)).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
    try:
        return zstd.train_dictionary(size, samples, level=3).as_bytes()
    except zstd.ZstdError:  # too few samples
        return b""


def write(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = 1, level: int = 1, dict_size: int = 32 << 10, sample_docs: int = 1000, sample_chars: int = 20_000) -> None:
    """Write the ids of every whole text in ascending doc_id order.

    A null text counts as empty (the end id alone); a null doc_id sorts first.
    Rows that repeat a doc_id are kept, ordered by their text.  An empty table
    gives an empty store.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = partitions(spark)
    bounds = docs.agg(F.count(F.lit(1)), F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()
    n_docs, cuts = bounds[0], sorted(set(bounds[1] or []))
    dictionary = train_dictionary(docs, tokenizer_path, end_id, n_docs, dict_size, sample_docs, sample_chars)
    digest = sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "dict_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    if len(cuts) <= MAX_CUTS:
        # The range of a row by binary search in the sorted cuts; no pass over the texts is needed for it.
        placed = docs.withColumn("part", _range_of(F.col("doc_id"), cuts)).repartitionById(len(cuts) + 1, "part")
    else:
        placed = docs.repartitionByRange(n, "doc_id").withColumn("part", F.spark_partition_id())
    placed = placed.sortWithinPartitions("doc_id", "text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, width = library_table(tokenizer_path), _width(tokenizer_path)
        pack = _compressor(dictionary, level).compress
        block, rows, size = 0, [], 0

        def flush() -> pa.RecordBatch:
            frames = [r[2] for r in rows]
            offsets = np.r_[0, np.cumsum([len(f) for f in frames])]
            row = (at_part, block, digest, [r[0] for r in rows], offsets.tolist(), [r[1] for r in rows], b"".join(frames))
            return pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("dict_sha256", pa.string()), ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("payload", pa.binary())])
        at_part = None
        for piece in slices(batches):
            data, offsets = string_bytes(piece.column(1))
            ids, counts = with_end(*table.encode(data, offsets), end_id)
            ids, at = ids.astype(width), np.r_[0, np.cumsum(counts)].tolist()
            for i, (doc, p) in enumerate(zip(piece.column(0).to_pylist(), piece.column(2).to_pylist(), strict=True)):
                if rows and (p != at_part or len(rows) >= BLOCK_DOCS or size >= BLOCK_BYTES):
                    yield flush()
                    block, rows, size = block + 1, [], 0
                at_part = p
                frame = pack(ids[at[i] : at[i + 1]].tobytes())
                rows.append((doc, at[i + 1] - at[i], frame))
                size += len(frame)
        if rows:
            yield flush()

    blocks = placed.select("doc_id", "text", "part").mapInArrow(run, BLOCKS)
    blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    spark.read.parquet(f"{folder}/blocks").groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("ids")).coalesce(1).write.parquet(f"{folder}/totals")


def _range_of(value, cuts: list[int]):
    """Number of cuts below `value` (0 for null), as a balanced tree of comparisons."""

    def tree(lo: int, hi: int):
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(cuts[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return F.when(value.isNull(), 0).otherwise(tree(0, len(cuts))).cast("int")


def _opened(spark, folder: str) -> DataFrame:
    """Blocks with their dictionary and the number of ids before their partition.

    Both small sides have one row, or one row per partition of the writing
    job; neither grows with the texts.
    """
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = spark.read.parquet(f"{folder}/totals").select("part", before.alias("part_start"))
    return spark.read.parquet(f"{folder}/blocks").join(F.broadcast(totals), "part")


def _dictionary(spark, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    if sha256(bytes(row[1])).hexdigest() != row[0]:
        raise ValueError(f"{folder}: the dictionary doesn't match its hash")
    return row[0], bytes(row[1])


def read(spark, folder: str, tokenizer_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each stored document (and its ids, little-endian unsigned 32-bit), from the frames."""
    digest, dictionary = _dictionary(spark, folder)
    width = _width(tokenizer_path)
    # Blocks of a partition follow each other; what precedes a block within it is a sum over few, small rows.
    sizes = _opened(spark, folder).select("part", "block", "part_start", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("ids"))
    inside = F.coalesce(F.sum("ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("part", "block", (F.col("part_start") + inside).alias("block_start"))
    blocks = spark.read.parquet(f"{folder}/blocks").join(starts, ["part", "block"])
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _decompressor(dictionary).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != digest:
                    raise ValueError("block written with another dictionary")
                ids = [np.frombuffer(unpack(row["payload"][a:b]), dtype=width).astype("<u4").tobytes() for a, b in zip(row["offsets"][:-1], row["offsets"][1:], strict=True)]
                n = np.array([len(i) // 4 for i in ids], dtype=np.int64)
                start = row["block_start"] + np.cumsum(n) - n
                columns = [pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(n), pa.array([zlib.crc32(i) for i in ids], pa.int64())]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(ids, pa.binary())] if with_ids else [])], names=names)

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def lookup(spark, folder: str, tokenizer_path: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids (array) of a few documents: only their own frames are decompressed, found by the offset index."""
    digest, dictionary = _dictionary(spark, folder)
    width, wanted = _width(tokenizer_path), set(doc_ids)
    blocks = spark.read.parquet(f"{folder}/blocks").filter(F.arrays_overlap("doc_ids", F.array(*[F.lit(int(d)) for d in wanted])) if wanted else F.lit(False))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _decompressor(dictionary).decompress
        for batch in batches:
            for row in batch.to_pylist():
                if row["dict_sha256"] != digest:
                    raise ValueError("block written with another dictionary")
                hits = [i for i, d in enumerate(row["doc_ids"]) if d in wanted]
                ids = [np.frombuffer(unpack(row["payload"][row["offsets"][i] : row["offsets"][i + 1]]), dtype=width).astype(np.int64).tolist() for i in hits]
                yield pa.RecordBatch.from_arrays([pa.array([row["doc_ids"][i] for i in hits], pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    return blocks.mapInArrow(run, "doc_id long, ids array<bigint>")
