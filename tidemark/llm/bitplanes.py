"""Token-id files: bit or byte planes of fixed-size id blocks, each compressed by zstandard, behind a chunk index.

A chunk is a run of whole documents in ascending id order. Its ids are cut into blocks of `block` ids. Bit plane p of a
block holds bit p of every id, so the upper planes of small ids are runs of zeros. A chunk row holds its documents'
ids and lengths, the compressed size of every plane of every block (the index) and the planes themselves, one after
the other. Chunks are rows of a Parquet table, so any file system Spark writes to will do and a lost task leaves nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import crc32, rows_out, strings
from tidemark.llm.tokens import TOKENIZER, encoder

CHUNK = pa.schema([
    ("part", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64()), ("planes", pa.int32()), ("kind", pa.string()),
    ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("plane_bytes", pa.list_(pa.int32())),
    ("payload", pa.binary()),
])
CHUNK_DDL = (
    "part int, chunk int, first long, n_ids long, planes int, kind string, block int, doc_ids array<long>, lengths array<long>, "
    "plane_bytes array<int>, payload binary"
)


def pack_planes(ids: np.ndarray, block: int, kind: str = "bit", level: int = 3) -> tuple[int, list[int], bytes]:
    """(planes, compressed size of every plane by block, all planes) of unsigned 32-bit ids."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=level).compress
    bits = max(1, int(ids.max()).bit_length() if ids.size else 1)
    planes = bits if kind == "bit" else (bits + 7) // 8
    packed = []
    for lo in range(0, ids.size, block):
        part = ids[lo : lo + block]
        for p in range(planes):
            plane = np.packbits((part >> p & 1).astype(np.uint8)) if kind == "bit" else (part >> 8 * p & 255).astype(np.uint8)
            packed.append(compress(plane.tobytes()))
    return planes, [len(p) for p in packed], b"".join(packed)


def unpack_planes(payload: bytes, sizes: list[int], n_ids: int, planes: int, block: int, kind: str) -> np.ndarray:
    """The inverse of `pack_planes`."""
    import zstandard

    decompress = zstandard.ZstdDecompressor().decompress
    out, at, size = np.zeros(n_ids, "<u4"), 0, iter(sizes)
    for lo in range(0, n_ids, block):
        part = out[lo : lo + block]
        for p in range(planes):
            n = next(size)
            plane = np.frombuffer(decompress(payload[at : at + n]), np.uint8)
            at += n
            if kind == "bit":
                part |= np.unpackbits(plane, count=part.size).astype("<u4") << p
            else:
                part |= plane.astype("<u4") << 8 * p
    return out


def write_tokens(docs: DataFrame, folder: str, tokenizer: str = TOKENIZER, end_id: int = 0, block: int = 65_536, chunk_ids: int = 1_000_000,
                 kind: str = "bit", level: int = 3, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every whole text (null: empty), append `end_id` and write the ids by ascending document id to `folder`.

    Documents are dealt by ranges of their id; a range is sorted, encoded and cut into chunks of about `chunk_ids` ids
    by one task. Null document ids come first; rows of one id are ordered by text. `folder/chunks` holds the chunks,
    `folder/index` one row per chunk with its global start, `folder/parts` the start of every range. An empty table
    gives empty tables.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part = TaskContext.get().partitionId()
        state = {"chunk": 0, "first": 0}

        def flush(ids: list, lengths: list[int], buffers: list[bytes]) -> pa.RecordBatch:
            values = np.frombuffer(b"".join(buffers), "<u4")
            planes, sizes, payload = pack_planes(values, block, kind, level)
            row = [part, state["chunk"], state["first"], values.size, planes, kind, block, ids, lengths, sizes, payload]
            state["chunk"] += 1
            state["first"] += values.size
            return rows_out(CHUNK, [[x] for x in row])

        ids, lengths, buffers, size = [], [], [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), strings(batch, "text"), strict=True):
                data = enc.encode(text) + end
                ids.append(doc_id)
                lengths.append(len(data) // 4)
                buffers.append(data)
                size += lengths[-1]
                if size >= chunk_ids:
                    yield flush(ids, lengths, buffers)
                    ids, lengths, buffers, size = [], [], [], 0
        if ids:
            yield flush(ids, lengths, buffers)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(encode, CHUNK_DDL)
    chunks.write.parquet(f"{folder}/chunks")
    spark = docs.sparkSession
    index = spark.read.schema(CHUNK_DDL).parquet(f"{folder}/chunks").drop("payload")
    totals = index.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    # one row per range of the write: its number is the number of tasks, so the running sum stays on the driver
    base, starts = 0, []
    for row in sorted(totals.collect()):
        starts.append((row["part"], base))
        base += row["n_ids"]
    spark.createDataFrame(starts, "part int, base long").coalesce(1).write.parquet(f"{folder}/parts")
    parts = spark.read.schema("part int, base long").parquet(f"{folder}/parts")
    (index.join(F.broadcast(parts), "part").select("part", "chunk", (F.col("base") + F.col("first")).alias("start"), "n_ids", "plane_bytes")
     .write.parquet(f"{folder}/index"))


READ = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def read_tokens(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document from the files alone: doc_id, start, n_tokens, ids_crc32 and, if wanted, the ids as bytes."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                values = unpack_planes(row["payload"], row["plane_bytes"], row["n_ids"], row["planes"], row["block"], row["kind"])
                lengths = np.array(row["lengths"], np.int64)
                ends = np.cumsum(lengths)
                data = [values[e - n : e].tobytes() for e, n in zip(ends, lengths, strict=True)]
                yield rows_out(READ, [[row["part"]] * len(data), row["doc_ids"], row["first"] + ends - lengths, lengths, [crc32(d) for d in data],
                                      data if with_ids else [None] * len(data)])

    chunks = spark.read.schema(CHUNK_DDL).parquet(f"{folder}/chunks")
    parts = spark.read.schema("part int, base long").parquet(f"{folder}/parts")
    rows = chunks.mapInArrow(decode, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long, ids binary")
    out = rows.join(F.broadcast(parts), "part")
    columns = ["doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"]
    return out.select(*columns, *(["ids"] if with_ids else []))
