"""Token files: frequency-ranked ids in a byte-aligned variable-length code with separate control bytes.

A file set is a folder of Parquet files whose rows are blocks of whole documents (about a million tokens each), so that writes are
committed per task and a lost executor costs only its tasks. Columns of a block:

- part, start: the file's place in the ascending id order, and the tokens of that part before the block
- doc_ids, n_tokens: the block's documents and their token counts
- ranked: the block's distinct ids, most frequent first (ties: lower id first), little-endian unsigned 32-bit
- control: two bits a rank, four to a byte, low bits first: the number of its bytes less one
- data: the ranks' bytes, little-endian, without leading zero bytes
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_id, sized_slices, slices
from .tokens import encoder

BLOCK_TOKENS = 1 << 20
RANGE_BYTES = 256 << 20
SCHEMA = "part int, start long, tokens long, doc_ids array<{}>, n_tokens array<int>, ranked binary, control binary, data binary"


def compress(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranked, control, data) of ids."""
    counts = np.bincount(ids, minlength=1)
    distinct = np.flatnonzero(counts)
    order = np.argsort(-counts[distinct], kind="stable")
    rank_of = np.zeros(len(counts), np.uint32)
    rank_of[distinct[order]] = np.arange(len(order), dtype=np.uint32)
    ranks = rank_of[ids]
    size = (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    padded = np.zeros(-(-len(size) // 4) * 4, np.uint8)
    padded[: len(size)] = size
    a, b, c, d = padded.reshape(-1, 4).T
    control = a | b << 2 | c << 4 | d << 6
    split = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)
    return distinct[order].astype("<u4").tobytes(), control.astype(np.uint8).tobytes(), split[np.arange(4) <= size[:, None]].tobytes()


def expand(ranked: bytes, control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ids that compress() was given, by table lookup."""
    sizes = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.int64) + 1  # of the four values under a control byte
    size = sizes[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(size) - size
    raw = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    ranks = raw[at].astype(np.uint32)
    for k in range(1, int(size.max(initial=1))):
        ranks |= np.where(size > k, raw[at + k], 0).astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked, "<u4")[ranks]


def input_bytes(rows: DataFrame) -> int:
    """The sizes of the files that the frame reads, as Spark's planner has them; nothing is read. Inputs without a size (2 ** 63 - 1 in Spark) count as 0."""
    leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(k).stats().sizeInBytes()) for k in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text (null: empty), appends end_id and writes the blocks in ascending id order (null ids first, rows of one id in any order). Ids are integers or strings.

    Rows are range-partitioned by id, so file order is id order; any number of partitions gives the same ids and starts. There are as many ranges as
    the files that the rows come from have RANGE_BYTES, and as many as shuffle partitions at least. A very long text is a block of its own."""
    rows = docs.select(as_id(docs, id_col).alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        encode, part = encoder(tokenizer), TaskContext.get().partitionId()
        start, ids, names, held = 0, [], [], 0

        def block():
            nonlocal start, ids, names, held
            n = [len(x) for x in ids]
            row = [part, start, held, names, n, *compress(np.concatenate(ids))]
            start, ids, names, held = start + held, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], fields)

        fields = ["part", "start", "tokens", "doc_ids", "n_tokens", "ranked", "control", "data"]
        types = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.string() if kind == "string" else pa.int64()), pa.list_(pa.int32()), *[pa.binary()] * 3]
        for batch in (b for whole in batches for b in sized_slices(whole, 1)):
            for name, found in zip(batch.column(0).to_pylist(), encode(batch.column(1)), strict=True):
                ids.append(np.append(found, encode.dtype.type(end_id)))
                names.append(name)
                held += len(ids[-1])
                if held >= BLOCK_TOKENS:
                    yield block()
        if ids:
            yield block()

    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(rows) // RANGE_BYTES))
    rows.repartitionByRange(n, "id").sortWithinPartitions("id").mapInArrow(run, SCHEMA.format(kind)).write.parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of each document, from the files: ids as little-endian unsigned 32-bit integers, start counts the ids of all documents before."""
    blocks = spark.read.parquet(path)
    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    ids_of = pa.string() if kind == "string" else pa.int64()

    def run(batches):
        for batch in batches:
            for row in (r for one in slices(batch, 1) for r in one.to_pylist()):
                counts = np.array(row["n_tokens"], np.int64)
                ids = expand(row["ranked"], row["control"], row["data"], int(counts.sum())).astype("<u4")
                ends = np.cumsum(counts)
                for k in range(0, len(counts), 256):
                    some = slice(k, k + 256)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(row["doc_ids"][some], ids_of), pa.array(row["before"] + row["start"] + ends[some] - counts[some]), pa.array(counts[some]),
                            pa.array([ids[e - n : e].tobytes() for e, n in zip(ends[some], counts[some], strict=True)], pa.binary()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    totals = blocks.groupBy("part").agg(F.max(F.col("start") + F.col("tokens")).alias("total"))
    # One row for each file: as many as partitions, not as documents.
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    return blocks.join(before, "part").mapInArrow(run, f"doc_id {kind}, start long, n_tokens long, ids binary")
