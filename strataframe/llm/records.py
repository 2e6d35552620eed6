"""Length-delimited binary records of token ids, with an offset index.

A record file is a row of frames::

    length   8 bytes, unsigned, of the payload
    check    4 bytes, masked CRC-32 of the 8 length bytes
    payload  doc_id (8 bytes, signed), bytes per id (1 byte, 128 added if the
             doc_id is null), ids
    check    4 bytes, masked CRC-32 of the payload

All numbers are little-endian.  The mask rotates a CRC right by 15 bits and adds
0xA282EAD8, so that a CRC stored inside checked data does no harm.  Beside each
file ``x.records`` lies ``x.index``: for every frame its doc_id, byte offset
and number of ids, 24 bytes each, so that any order of documents can be read
without a scan.  Files hold ascending doc_ids and are cut at ``FILE_BYTES``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import limit_batches, new_folder, written
from .tokens import encoder, text_slices

FILE_BYTES = 64 << 20
INDEX_ROW = np.dtype([("doc_id", "<i8"), ("offset", "<u8"), ("n_tokens", "<u8")])
#: Stored in place of a null id, and what marks it as one.
NULL_ID, NULL_FLAG = -(1 << 63), 128
_HEAD = "<QI"
_DOC = "<qB"
_DOC_BYTES = struct.calcsize(_DOC)
_FILES = "path string, part int, file int, n_docs long, n_tokens long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked_crc(size)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: memoryview, offset: int) -> tuple[memoryview, int]:
    """The payload at ``offset`` and where the next frame begins; ValueError if damaged."""
    if offset + 12 > len(data):
        raise ValueError(f"record cut short at byte {offset}")
    size, check = struct.unpack_from(_HEAD, data, offset)
    if masked_crc(bytes(data[offset : offset + 8])) != check:
        raise ValueError(f"damaged length at byte {offset}")
    end = offset + 12 + size
    if end + 4 > len(data):
        raise ValueError(f"record cut short at byte {offset}")
    payload = data[offset + 12 : end]
    if masked_crc(payload) != struct.unpack_from("<I", data, end)[0]:
        raise ValueError(f"damaged payload at byte {offset}")
    return payload, end + 4


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")


class _Shard:
    """A record file and its index being written by one task attempt."""

    def __init__(self, folder: str, part: int, attempt: int, number: int):
        self.path, self.part, self.number = f"{folder}/part-{part:06d}-{number:04d}-{attempt}", part, number
        self.system, self.place = _open(self.path)
        self.system.create_dir(self.place.rpartition("/")[0], recursive=True)
        self.out = self.system.open_output_stream(self.place + ".records")
        self.size, self.n_tokens, self.rows = 0, 0, []

    def add(self, doc_id: int | None, ids: bytes, width: int) -> None:
        flag = 0 if doc_id is not None else NULL_FLAG
        doc_id = NULL_ID if doc_id is None else doc_id
        data = frame(struct.pack(_DOC, doc_id, width | flag) + ids)
        self.out.write(data)
        self.rows.append((doc_id, self.size, len(ids) // width))
        self.size += len(data)
        self.n_tokens += len(ids) // width

    def close(self) -> tuple:
        self.out.close()
        with self.system.open_output_stream(self.place + ".index") as out:
            out.write(np.array(self.rows, INDEX_ROW).tobytes())
        return self.path, self.part, self.number, len(self.rows), self.n_tokens


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, doc: str = "doc_id", text: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes every text, appends ``end_id`` and writes files in ascending ``doc`` order.

    Returns the list of files (path, part, file, n_docs, n_tokens), already
    written.  Ids are integers.  A null text is encoded as empty; rows that share an
    id all stay, next to each other in the order of their texts' hashes; a null id
    comes first and is read back as null.  An empty table writes no file.  A very long
    text is one record.  Other columns, whatever their names, are not read.  A task that runs again writes files of its own; only those of
    the attempt that ended well are listed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, context = encoder(tokenizer), TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        end, shard, done = encode.dtype.type(end_id).tobytes(), None, []
        for batch in batches:
            for rows, texts in text_slices(batch, text):
                for doc_id, ids in zip(rows.column(doc).to_pylist(), encode.encode(texts), strict=True):
                    if shard is None or shard.size >= file_bytes:
                        if shard is not None:
                            done.append(shard.close())
                        shard = _Shard(folder, part, attempt, len(done))
                    shard.add(doc_id, ids + end, encode.width)
        if shard is not None:
            done.append(shard.close())
        columns = [list(x) for x in zip(*done, strict=True)] or [[] for _ in range(5)]
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "part", "file", "n_docs", "n_tokens"])

    limit_batches(docs.sparkSession)
    ordered = docs.select(doc, text).repartitionByRange(doc, F.xxhash64(text)).sortWithinPartitions(doc, F.xxhash64(text))
    return written(ordered.mapInArrow(run, _FILES), "record-files")


def _starts(files: DataFrame) -> DataFrame:
    """Adds ``base``: ids in all files before; one row per file, so one task is enough."""
    before = Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_records(files: DataFrame, digest: bool = False) -> DataFrame:
    """Every record, from the files: doc_id, start, n_tokens, ids (binary), width.

    ``digest`` gives ``ids_crc32`` in place of the last two.  Checks both
    checksums of each frame and that the index says the same.
    """
    schema = "doc_id long, start long, n_tokens long, " + ("ids_crc32 long" if digest else "ids binary, width int")
    kinds = [pa.int64(), pa.int64(), pa.int64(), *([pa.int64()] if digest else [pa.binary(), pa.int32()])]
    names = [x.split()[0] for x in schema.split(", ")]

    def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = [list(x) for x in zip(*rows, strict=True)] or [[] for _ in kinds]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                system, place = _open(row["path"])
                with system.open_input_file(place + ".index") as f:
                    index = np.frombuffer(f.read(), INDEX_ROW)
                with system.open_input_file(place + ".records") as f:
                    data = memoryview(f.read())
                at, start, out = 0, row["base"], []
                for entry in index:
                    if entry["offset"] != at:
                        raise ValueError(f"the index of {row['path']} doesn't fit its records")
                    payload, at = unframe(data, at)
                    doc_id, width = struct.unpack_from(_DOC, payload)
                    doc_id, width = (None if width & NULL_FLAG else doc_id), width & ~NULL_FLAG
                    ids = bytes(payload[_DOC_BYTES :])
                    n_tokens = len(ids) // width
                    out.append((doc_id, start, n_tokens, *((ids_crc32(ids, width),) if digest else (ids, width))))
                    start += n_tokens
                    if len(out) >= 2000:
                        yield rows_batch(out)
                        out = []
                if at != len(data):
                    raise ValueError(f"{row['path']} holds more than its index")
                yield rows_batch(out)

    # A number of its own, which isn't merged into fewer: one file a task.
    spread = _starts(files).select("path", "base").repartition(max(1, files.count()))
    return spread.mapInArrow(run, schema)


def read_one(path: str, doc_id: int) -> np.ndarray:
    """Ids of the first record of a document in one file, by its index alone."""
    system, place = _open(path)
    with system.open_input_file(place + ".index") as f:
        index = np.frombuffer(f.read(), INDEX_ROW)
    k = int(np.searchsorted(index["doc_id"], doc_id))
    if k == len(index) or index["doc_id"][k] != doc_id:
        raise KeyError(doc_id)
    with system.open_input_file(place + ".records") as f:
        f.seek(int(index["offset"][k]))
        head = f.read(12)
        data = memoryview(head + f.read(struct.unpack(_HEAD, head)[0] + 4))
    payload, _ = unframe(data, 0)
    return np.frombuffer(payload[_DOC_BYTES :], f"<u{struct.unpack_from(_DOC, payload)[1] & ~NULL_FLAG}")


def ids_crc32(ids: bytes, width: int) -> int:
    """crc32 of ids as unsigned little-endian 32-bit numbers."""
    return zlib.crc32(ids if width == 4 else np.frombuffer(ids, f"<u{width}").astype("<u4"))


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int, digest: bool = False) -> DataFrame:
    """Writes all documents to a new folder and returns what its files hold."""
    return read_records(write_records(docs, new_folder(spark, "records"), tokenizer, end_id), digest)
