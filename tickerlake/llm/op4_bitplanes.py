"""Token ids in a bit-plane file format.

Ids of all documents in ascending doc_id are cut into blocks of BLOCK ids.  A block's ids are turned into planes,
one for each bit (or byte) of the widest id, and each plane is compressed with zstandard.  A dataset holds one row
for each block: its place (shard, block, ids of the shard before it), the planes, and an index of the documents'
stretches in it.  Shards are contiguous ranges of doc_id that tasks write apart.

Block bytes: "BPL1", count of ids (4 bytes), kind of planes (1 or 8 bits), count of planes, the planes' sizes
(4 bytes each), the planes.  Numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickerlake import session
from tickerlake.llm import common, ordered
from tickerlake.llm.wordtokens import END, vocabulary_path, worker_chunks

BLOCK = 1 << 16
LEVEL = 3
SLICE_BYTES = 2_000_000
MAGIC = b"BPL1"
STRETCH = "struct<doc_id: long, row: long, begin: long, place: int, length: int>"
DATASET = f"shard int, block long, first long, n_ids int, planes binary, stretches array<{STRETCH}>"


def to_planes(ids: np.ndarray, bits: int = 1, level: int = LEVEL) -> bytes:
    """A block's bytes; ids are non-negative and below 2**32."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    width = -(-width // bits)
    ids = ids.astype("<u2" if width * bits <= 16 else "<u4")
    pack = zstandard.ZstdCompressor(level=level).compress
    planes = [pack((np.packbits((ids & ids.dtype.type(1 << k)) != 0) if bits == 1 else ids.view(np.uint8)[k :: ids.itemsize]).tobytes()) for k in range(width)]
    return MAGIC + struct.pack(f"<IBB{width}I", len(ids), bits, width, *map(len, planes)) + b"".join(planes)


def from_planes(data: bytes) -> np.ndarray:
    """The ids (uint32) of a block's bytes."""
    if data[:4] != MAGIC:
        raise ValueError("not a block of bit planes")
    n, bits, width = struct.unpack_from("<IBB", data, 4)
    sizes = struct.unpack_from(f"<{width}I", data, 10)
    at, unpack = 10 + 4 * width, zstandard.ZstdDecompressor().decompress
    ids = np.zeros(n, dtype="<u2" if width * bits <= 16 else "<u4")
    for k, size in enumerate(sizes):
        plane = np.frombuffer(unpack(data[at : at + size]), dtype=np.uint8)
        ids |= (np.unpackbits(plane, count=n) if bits == 1 else plane).astype(ids.dtype) << ids.dtype.type(k * bits)
        at += size
    if at != len(data):
        raise ValueError("a block's size does not fit its header")
    return ids.astype(np.uint32)


def narrow(ids: np.ndarray) -> bytes:
    """Ids as bytes for the way to the writer: two bytes each behind a 2 if all of them fit, else four behind a 4."""
    return b"\x02" + ids.astype("<u2").tobytes() if not len(ids) or int(ids.max()) < 1 << 16 else b"\x04" + ids.astype("<u4").tobytes()


def wide(data: pa.Buffer) -> np.ndarray:
    return np.frombuffer(data, dtype="<u2" if memoryview(data)[0] == 2 else "<u4", offset=1)


def encoder(path: str | None = None, form=lambda ids: ids.astype("<u4").tobytes()):
    """A function that turns batches of (doc_id, text) into batches of (doc_id, ids); form makes bytes of ids."""
    path = path or vocabulary_path()

    def run(batches):
        chunks = worker_chunks(path)
        for batch in common.slices(batches, "text", SLICE_BYTES):
            ids = [form(np.append(x, END)) for x in chunks.ids(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids binary): the library's ids of every whole text and END, as little-endian unsigned 32-bit numbers.

    A null text is empty and has END alone.
    """
    return common.documents(docs).mapInArrow(encoder(path), "doc_id long, ids binary")


def write_documents(docs: DataFrame, path: str, vocabulary: str | None = None, bits: int = 1) -> None:
    """Writes the ids of (doc_id, text) in ascending doc_id as a dataset of blocks.

    Documents without a doc_id come first, those with one doc_id in the order of the bytes of ``narrow``; an empty
    table writes no block.
    """
    docs = common.documents(docs)
    firsts, nulls = ordered.bounds(docs)

    def run(batches):
        shard, row, block, first = None, 0, 0, 0
        held, size, stretches = [], 0, []

        def close():
            nonlocal held, size, stretches, block, first
            ids = np.concatenate(held)
            out = pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int64()), pa.array([first], pa.int64()), pa.array([size], pa.int32()), pa.array([to_planes(ids, bits)], pa.binary()), pa.array([stretches], pa.list_(pa.struct([("doc_id", pa.int64()), ("row", pa.int64()), ("begin", pa.int64()), ("place", pa.int32()), ("length", pa.int32())])))],
                ["shard", "block", "first", "n_ids", "planes", "stretches"],
            )
            block, first = block + 1, first + size
            held, size, stretches = [], 0, []
            return out

        for batch in batches:
            for number, doc_id, data in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3)):
                if number != shard:
                    if size:
                        yield close()
                    shard, row, block, first = number, 0, 0, 0
                ids, begin = wide(data.as_buffer()), 0
                while begin < len(ids):
                    part = ids[begin : begin + BLOCK - size]
                    stretches.append({"doc_id": doc_id, "row": row, "begin": begin, "place": size, "length": len(part)})
                    held.append(part)
                    size, begin = size + len(part), begin + len(part)
                    if size == BLOCK:
                        yield close()
                row += 1
        if size:
            yield close()

    dealt = ordered.deal(docs, firsts, nulls, with_next=False, prepare=encoder(vocabulary, narrow), made="ids binary")
    dealt.mapInArrow(run, DATASET).write.option("compression", "none").parquet(path)


def join_crc(first: int, second: int, bytes_of_second: int) -> int:
    """CRC-32 of two pieces together from those of each: the first times x**(8 n), modulo the polynomial."""

    def times(a: int, b: int) -> int:
        out = 0
        for bit in range(31, -1, -1):
            if a >> bit & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, square, n = 1 << 31, 1 << 30, 8 * bytes_of_second
    while n:
        if n & 1:
            power = times(power, square)
        square, n = times(square, square), n >> 1
    return times(first, power) ^ second


def decoded(batches):
    """(shard, ids of the shard before the block, stretches, ids, where each stretch begins and ends in them) of every block."""
    for batch in batches:
        for number, first, planes, stretches in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(4), batch.column(5)):
            own = {k: stretches.values.field(k).to_numpy() for k in ("row", "begin", "place", "length")}
            own |= {"doc_id": stretches.values.field("doc_id"), "place": own["place"] + first}
            yield number, own, from_planes(planes.as_py()), np.concatenate([[0], np.cumsum(own["length"])])


def stretch_columns(number: int, own: dict) -> list[pa.Array]:
    """shard, row, doc_id, begin, place of a block's stretches."""
    return [pa.array(np.full(len(own["row"]), number, dtype=np.int32)), pa.array(own["row"]), own["doc_id"], pa.array(own["begin"]), pa.array(own["place"].astype(np.int64))]


PLACED = "shard int, row long, doc_id long, begin long, place long"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Every document's stretches, decoded: (shard, row, doc_id, begin, place, ids array<int>).

    place: ids of the shard before the stretch.
    """

    def run(batches):
        for number, own, ids, cuts in decoded(batches):
            lists = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*stretch_columns(number, own), lists], ["shard", "row", "doc_id", "begin", "place", "ids"])

    return spark.read.schema(DATASET).parquet(path).mapInArrow(run, f"{PLACED}, ids array<int>")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every written document, from the files.

    Blocks are decoded and their stretches checksummed where they are read; ids go nowhere else.  Checksums of a
    document's stretches are joined in order, so that no document has to be gathered whole.
    """

    def checked(batches):
        for number, own, ids, cuts in decoded(batches):
            data = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*stretch_columns(number, own), pa.array(own["length"].astype(np.int64)), pa.array(crc, pa.int64())], ["shard", "row", "doc_id", "begin", "place", "length", "crc"])

    def joined(batches):
        for batch in batches:
            out = []
            for parts in batch.column(3).to_pylist():
                crc = parts[0]["crc"]
                for p in parts[1:]:
                    crc = join_crc(crc, p["crc"], 4 * p["length"])
                out.append(crc)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(out, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    shards = spark.read.schema(DATASET).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a shard, MOST_BLOCKS at most
    stretches = spark.read.schema(DATASET).parquet(path).mapInArrow(checked, f"{PLACED}, length long, crc long")
    docs = stretches.groupBy("shard", "row").agg(
        F.first("doc_id").alias("doc_id"), F.min("place").alias("place"), F.sum("length").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("begin", "length", "crc"))).alias("parts")
    )
    placed = docs.join(shards.select("shard", before.alias("before")), "shard").select("doc_id", (F.col("before") + F.col("place")).alias("start"), "n_tokens", "parts")
    return placed.mapInArrow(joined, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = session.work_dir(spark, "bitplanes")
    write_documents(common.table(spark, sf_dir, "documents"), path)
    return summary(spark, path)
