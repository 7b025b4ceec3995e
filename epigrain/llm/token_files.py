"""Token-id files: independent zstandard frames, then a document index and a seek table with a checksum per frame.

A file holds documents in ascending doc_id order. Each frame is a complete zstandard frame over at most ``frame_tokens`` ids
(one longer document has a frame of its own):

    frame    := zstd(count u32, doc_id i64[count], n_tokens u32[count], ids u32[sum])
    index    := skippable frame 0x184D2A50: (first doc_id i64, last doc_id i64, tokens before u64) per frame
    seek     := skippable frame 0x184D2A5E in the public seekable layout: (compressed u32, plain u32, checksum u32) per frame,
                then frames u32, descriptor u8 (0x80: checksums), magic 0x8F92EAB1. The checksum is the low half of XXH64.

A reader takes the tail of a file, then fetches and decompresses only the frames that can hold the documents it wants.
Edge cases: a null text is an empty one (its end id alone), a null doc_id sorts first and reads back as null, rows that repeat
a doc_id are separate documents ordered by text hash, an empty table gives no file and no row, other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import new_folder, open_filesystem, tidy, write_whole, written
from .token_ids import CACHE, encoder, slices

FRAME_TOKENS = 1 << 18
INDEX_MAGIC, SEEK_MAGIC, END_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
NULL_ID = -(1 << 63)

MANIFEST = "part int, file string, documents long, tokens long, first_id long, last_id long"
DIGEST = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(c, T.LongType(), False) for c in ("start", "n_tokens", "ids_crc32")]
)


def _checksum(plain: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class FrameWriter:
    """Gathers documents into frames and writes them to a stream."""

    def __init__(self, out, frame_tokens: int = FRAME_TOKENS):
        import zstandard

        self.out, self.frame_tokens = out, frame_tokens
        self.compressor = zstandard.ZstdCompressor(level=1, write_checksum=True)
        self.ids: list[int] = []
        self.bodies: list[bytes] = []
        self.held = self.documents = self.tokens = 0
        self.index: list[tuple[int, int, int]] = []
        self.table: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, body: bytes) -> None:
        n = len(body) // 4
        if self.ids and self.held + n > self.frame_tokens:
            self.flush()
        self.ids.append(NULL_ID if doc_id is None else doc_id)
        self.bodies.append(body)
        self.held += n

    def flush(self) -> None:
        if not self.ids:
            return
        lengths = np.array([len(b) // 4 for b in self.bodies], dtype="<u4")
        plain = b"".join(
            [struct.pack("<I", len(self.ids)), np.array(self.ids, "<i8").tobytes(), lengths.tobytes(), *self.bodies]
        )
        packed = self.compressor.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain), _checksum(plain)))
        self.index.append((self.ids[0], self.ids[-1], self.tokens))
        self.documents += len(self.ids)
        self.tokens += self.held
        self.ids, self.bodies, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        self.out.write(_skippable(INDEX_MAGIC, b"".join(struct.pack("<qqQ", *x) for x in self.index)))
        table = b"".join(struct.pack("<III", *x) for x in self.table)
        self.out.write(_skippable(SEEK_MAGIC, table + struct.pack("<IBI", len(self.table), 0x80, END_MAGIC)))


class FrameReader:
    """Random access to one file through its seek table."""

    def __init__(self, uri: str):
        import zstandard

        system, path = open_filesystem(uri)
        self.name, self.file = uri, system.open_input_file(path)
        self.decompressor = zstandard.ZstdDecompressor()
        size = self.file.size()
        frames, descriptor, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != END_MAGIC or not descriptor & 0x80:
            raise ValueError(f"{uri}: no seek table with checksums")
        begin = size - 9 - 12 * frames
        self.table = np.frombuffer(self.file.read_at(12 * frames, begin), "<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate(([0], np.cumsum(self.table[:, 0])))
        index = self.file.read_at(24 * frames, int(self.at[-1]) + 8)
        self.index = [struct.unpack_from("<qqQ", index, 24 * i) for i in range(frames)]
        self.frames_read = 0

    def frame(self, i: int) -> Iterator[tuple[int | None, int, bytes]]:
        """(doc_id, ids before it in the file, ids) of each document of a frame, after its checksum has been compared."""
        packed, size, checksum = self.table[i]
        plain = self.decompressor.decompress(self.file.read_at(int(packed), int(self.at[i])), max_output_size=int(size))
        if len(plain) != size or _checksum(plain) != checksum:
            raise ValueError(f"{self.name}: frame {i} does not match its checksum")
        self.frames_read += 1
        (n,) = struct.unpack_from("<I", plain)
        ids = np.frombuffer(plain, "<i8", n, 4).tolist()
        lengths = np.frombuffer(plain, "<u4", n, 4 + 8 * n).tolist()
        where, before = 4 + 12 * n, self.index[i][2]
        for doc_id, length in zip(ids, lengths, strict=True):
            yield (None if doc_id == NULL_ID else doc_id), before, plain[where : where + 4 * length]
            where, before = where + 4 * length, before + length

    def all(self) -> Iterator[tuple[int | None, int, bytes]]:
        for i in range(len(self.table)):
            yield from self.frame(i)

    def only(self, wanted: Iterable[int]) -> Iterator[tuple[int | None, int, bytes]]:
        """The wanted documents; frames whose doc_id range holds none of them are not read."""
        wanted = np.array(sorted(set(wanted)), dtype=np.int64)
        chosen = set(wanted.tolist())
        for i, (first, last, _) in enumerate(self.index):
            if np.searchsorted(wanted, first) < np.searchsorted(wanted, last, side="right"):
                yield from (d for d in self.frame(i) if d[0] in chosen)

    def close(self) -> None:
        self.file.close()


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, end_id: int, keeps_space: bool = True, frame_tokens: int = FRAME_TOKENS
) -> DataFrame:
    """Encode documents and write them in ascending doc_id order, one file per partition; returns the table of files.

    Rows are range-partitioned by (doc_id, text hash), so neither a frequent doc_id nor a frequent text fills one task alone.
    Files are a function of their partition's rows: a repeated task writes the same bytes under the same name.
    """
    tail = np.array([end_id], "<u4").tobytes()

    def write(batches):
        context = TaskContext.get()
        part = context.partitionId()
        first = next(batches, None)
        while first is not None and not first.num_rows:
            first = next(batches, None)
        if first is None:
            return
        state = {}

        def fill(out):
            encode = encoder(tokenizer, keeps_space).encode
            writer = FrameWriter(out, frame_tokens)
            batch = first
            while batch is not None:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for a, b in slices(texts):
                    for doc_id, body in zip(ids[a:b], encode(texts[a:b]), strict=True):
                        writer.add(doc_id, body + tail)
                batch = next(batches, None)
            writer.close()
            state["writer"] = writer

        name = f"ids-{part:06d}.zst"
        write_whole(f"{folder}/{name}", f"{context.taskAttemptId()}", fill)
        w = state["writer"]
        ends = [None if x == NULL_ID else x for x in (w.index[0][0], w.index[-1][1])]
        columns = [[part], [name], [w.documents], [w.tokens], [ends[0]], [ends[1]]]
        types = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        names = ["part", "file", "documents", "tokens", "first_id", "last_id"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return written(spread.mapInArrow(tidy(write, CACHE), MANIFEST), "token-manifest")


def with_starts(files: DataFrame) -> DataFrame:
    """Adds the ids of all files before each one. The table has one row per file, never one per document."""
    return files.selectExpr("*", "sum(tokens) OVER (ORDER BY part) - tokens AS before")


def read_digests(files: DataFrame, folder: str) -> DataFrame:
    """Read every document back: (doc_id, start, n_tokens, ids_crc32), one task per file."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader = FrameReader(f"{folder}/{row['file']}")
                for i in range(len(reader.table)):
                    found = [(d, row["before"] + s, len(b) // 4, zlib.crc32(b)) for d, s, b in reader.frame(i)]
                    columns = [pa.array(c, pa.int64()) for c in zip(*found, strict=True)]
                    yield pa.RecordBatch.from_arrays(columns, DIGEST.names)
                reader.close()

    count = max(1, files.count())
    placed = with_starts(files).select("part", "file", "before").repartition(count)
    return placed.mapInArrow(read, DIGEST)


def read_documents(files: DataFrame, folder: str, wanted: list[int]) -> DataFrame:
    """The ids of a stated list of documents: (doc_id, start, ids). Only files and frames that can hold them are read."""
    schema = "doc_id long, start long, ids array<int>"

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                reader = FrameReader(f"{folder}/{row['file']}")
                found = [(d, row["before"] + s, np.frombuffer(b, "<u4").astype(np.int32)) for d, s, b in reader.only(wanted)]
                reader.close()
                if found:
                    d, s, ids = zip(*found, strict=True)
                    types = (pa.int64(), pa.int64(), pa.list_(pa.int32()))
                    arrays = [pa.array(list(c), t) for c, t in zip((d, s, ids), types, strict=True)]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "ids"])

    low, high = (min(wanted), max(wanted)) if wanted else (1, 0)
    near = with_starts(files).where(F.col("last_id").between(low, 2**63 - 1) & (F.coalesce("first_id", F.lit(NULL_ID)) <= high))
    return near.select("file", "before").repartition(F.col("file")).mapInArrow(read, schema)


def token_digests(docs: DataFrame, tokenizer: str, end_id: int, keeps_space: bool = True) -> DataFrame:
    """Write token files below the shared folder and return what reading them back gives."""
    spark: SparkSession = docs.sparkSession
    folder = new_folder(spark, "token-ids")
    return read_digests(write_token_files(docs, folder, tokenizer, end_id, keeps_space), folder)
