"""Token ids as directly addressable binary output.

``write_tokens`` puts the documents in ascending order of their id (one range shuffle of the texts), encodes every whole
text with a given tokenizer, appends the end id, and writes segments: rows of a Parquet container with the shard (range
partition), the number of the segment in it, the tokens of the shard before it, the ids of its documents, where each ends, and the token ids as directly
addressable codes (``dac``). ``locate`` gives the global place of every segment and document from the segment headers
alone. ``read_documents`` and ``read_tokens`` read ids back without decoding what lies before them.

A text is encoded piece by piece between ASCII white space, where this family of tokenizers always separates words;
pieces are remembered, so that the library sees a distinct piece once in a worker while it is in use (at most 2 x CACHE pieces are kept).

Defined cases: null and empty texts give the end id alone; a null document id sorts first; documents with equal ids
stand side by side; a text of any length is one run in one segment; an empty table writes an empty container and other
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stackmill.llm import dac
from stackmill.llm.common import shared_dir, small_batches, table

END_ID = 2
#: Token ids and documents after which a segment is closed.
SEGMENT_TOKENS, SEGMENT_DOCS = 1 << 18, 4096
#: Pieces in each of the two generations that a worker remembers.
CACHE = 700_000
SEGMENTS = "shard int, segment int, before bigint, doc_ids array<bigint>, ends array<bigint>, n_tokens bigint, codes binary"


class PieceEncoder(dict):
    """piece (UTF-8 bytes without ASCII white space) -> its token ids as little-endian uint32 bytes.

    Two generations are remembered: when the young one is full it becomes the old one, from which pieces in use come back.
    """

    def __init__(self, path: str, pieces: int = 0):
        from tokenizers import Tokenizer

        super().__init__()
        self.pieces = pieces or CACHE
        self.tokenizer = Tokenizer.from_file(path)
        self.old: dict[bytes, bytes] = {}

    def __missing__(self, piece: bytes) -> bytes:
        # a full stop or comma after a letter is a word of its own to the tokenizer: such pieces are put together from two
        if len(piece) > 1 and piece[-1] in b".," and 0x61 <= piece[-2] <= 0x7A and b"<|" not in piece:
            return self[piece[:-1]] + self[piece[-1:]]
        out = self.old.get(piece)
        if out is None:
            out = np.array(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        if len(self) >= self.pieces:
            self.old = dict(self)
            self.clear()
        self[piece] = out
        return out

    def encode(self, data: bytes) -> bytes:
        # the tokenizer lower-cases ASCII capitals itself; a text that may hold a special token is left as it is
        return b"".join(map(self.__getitem__, (data if b"<|" in data else data.lower()).split()))


_encoders: dict[tuple[str, int], PieceEncoder] = {}


def encoder(path: str, pieces: int) -> PieceEncoder:
    """One for each worker process and tokenizer."""
    if (path, pieces) not in _encoders:
        _encoders[path, pieces] = PieceEncoder(path, pieces)
    return _encoders[path, pieces]


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, pieces: int = CACHE) -> None:
    """Write the container to path. tokenizer: a file that the tokenizers library reads, present on every worker. pieces: how
    many a worker remembers in a generation; fewer need less memory and more time."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from stackmill.llm import token_output

        shard, number, encode = TaskContext.get().partitionId(), 0, token_output.encoder(tokenizer, pieces).encode
        ids, ends, parts, total, before = [], [], [], 0, 0

        def close() -> pa.RecordBatch:
            codes = dac.encode(np.frombuffer(b"".join(parts), "<u4"))
            row = {"shard": [shard], "segment": [number], "before": [before], "doc_ids": [list(ids)], "ends": [list(ends)], "n_tokens": [total], "codes": [codes]}
            types = {"shard": pa.int32(), "segment": pa.int32(), "before": pa.int64(), "doc_ids": pa.list_(pa.int64()), "ends": pa.list_(pa.int64()), "n_tokens": pa.int64(), "codes": pa.binary()}
            return pa.RecordBatch.from_arrays([pa.array(row[k], t) for k, t in types.items()], list(types))

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                tokens = (encode(text.as_buffer().to_pybytes()) if text.is_valid else b"") + end
                if ids and (total + len(tokens) // 4 > SEGMENT_TOKENS or len(ids) >= SEGMENT_DOCS):
                    yield close()
                    number, before = number + 1, before + total
                    ids, ends, parts, total = [], [], [], 0
                total += len(tokens) // 4
                ids.append(doc)
                ends.append(total)
                parts.append(tokens)
        if ids:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sorted_rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    with small_batches(docs.sparkSession):
        sorted_rows.mapInArrow(run, SEGMENTS).write.parquet(path)


def locate(spark: SparkSession, path: str) -> DataFrame:
    """The container with first, the global place of every segment's first token. Only the totals of the shards, one row for
    each partition of the sort, are put in order and broadcast; the codes are not shuffled."""
    segments = spark.read.schema(SEGMENTS).parquet(path)
    totals = segments.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_base"))
    return segments.join(F.broadcast(base), segments["shard"] == base["_shard"]).withColumn("first", F.col("_base") + F.col("before")).drop("_shard", "_base", "before")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the container alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                codes = dac.Codes(batch.column("codes")[row].as_buffer())
                first, at, out = batch.column("first")[row].as_py(), 0, ([], [], [], [])
                for doc, end in zip(batch.column("doc_ids")[row].as_py(), batch.column("ends")[row].as_py()):
                    ids = codes.slice(at, end).astype("<u4")
                    for k, v in enumerate((doc, first + at, end - at, zlib.crc32(ids.tobytes()))):
                        out[k].append(v)
                    at = end
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return locate(spark, path).select("doc_ids", "ends", "first", "codes").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_tokens(spark: SparkSession, path: str, places: DataFrame) -> DataFrame:
    """place, id for a table of global places (column place): each place is joined to its segment's range and read alone."""
    spans = locate(spark, path).select("first", "n_tokens", "codes", "shard", "segment")
    # places meet segments in blocks of places: a segment covers the blocks that its range touches
    block = lambda c: F.floor(c / SEGMENT_TOKENS)
    covered = spans.drop("codes").withColumn("block", F.explode(F.sequence(block(F.col("first")), block(F.col("first") + F.col("n_tokens") - 1))))
    hit = places.select("place", block(F.col("place")).alias("block")).join(covered, "block").filter("place >= first and place < first + n_tokens")
    grouped = hit.groupBy("shard", "segment").agg(F.collect_list("place").alias("places"))
    rows = spans.join(grouped, ["shard", "segment"]).select("first", "codes", "places")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                want = np.array(batch.column("places")[row].as_py(), np.int64)
                ids = dac.Codes(batch.column("codes")[row].as_buffer()).take(want - batch.column("first")[row].as_py())
                yield pa.RecordBatch.from_arrays([pa.array(want), pa.array(ids.astype(np.int64))], ["place", "id"])

    return rows.mapInArrow(run, "place long, id long")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_table(spark: SparkSession, docs: DataFrame, tokenizer: str | None = None, pieces: int = CACHE) -> DataFrame:
    """Write docs to a new container in the shared folder and read every document's digest back."""
    import uuid

    path = f"{shared_dir(spark)}/stackmill/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, tokenizer or default_tokenizer(), path, pieces=pieces)
    return read_documents(spark, path)


def op6_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_table(spark, table(spark, sf_dir, "documents"))


QUERIES = {"op6_token_output": op6_token_output}
