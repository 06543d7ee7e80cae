"""Token ids in length-delimited binary record files with an offset index.

A record file is a run of frames, one per document in ascending id order:

    length    8 bytes, little endian, of the payload
    masked    4 bytes, checksum of the length
    payload   1 byte flags (1: the id is NULL, 2: ids take 4 bytes, else 2),
              8 bytes signed id, then the token ids, little endian
    masked    4 bytes, checksum of the payload

A checksum is CRC-32 rotated right by 15 bits plus a constant, so that a
checksum of data that holds checksums stays sound. Beside each ``.rec`` file
lies an ``.idx`` file: 16 bytes a record, its offset and its payload length;
a reader can fetch records in any order with it.

Scale: documents are range-partitioned by id once (whole texts, one
shuffle) and tokenized by the task that writes their file. A task writes to
a name of its own; the manifest lists the files of the attempts that
succeeded, so a lost executor or a repeated task leaves no half file in the
result. Files go through Arrow's file systems (local, HDFS, S3, GCS).

Defined results: NULL text is empty (the end id alone); NULL ids come first;
rows with equal ids are ordered by text; an empty table gives no files and
no rows; other input columns are ignored.
"""

from __future__ import annotations

import random
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.llm import word_bpe
from tillroll.llm.common import renamed, with_package, written

MASK_DELTA = 0xA282EAD8  # fixed value of the record format
MANIFEST = "file_no long, name string, n_records long, n_ids long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return b"".join((head, struct.pack("<I", masked(head)), payload, struct.pack("<I", masked(payload))))


def unframe(blob, at: int) -> bytes:
    """The payload of the frame at ``at``; ValueError if a checksum is wrong."""
    head = bytes(blob[at:at + 8])
    (length,) = struct.unpack("<Q", head)
    if struct.unpack_from("<I", blob, at + 8)[0] != masked(head):
        raise ValueError(f"damaged length at {at}")
    payload = bytes(blob[at + 12:at + 12 + length])
    if len(payload) != length or struct.unpack_from("<I", blob, at + 12 + length)[0] != masked(payload):
        raise ValueError(f"damaged record at {at}")
    return payload


def payload(doc_id: int | None, ids: bytes) -> bytes:
    """``ids``: 4 bytes each."""
    wide = np.frombuffer(ids, "<u4")
    small = not wide.size or int(wide.max()) < 1 << 16
    return struct.pack("<Bq", (doc_id is None) | (0 if small else 2), doc_id or 0) + (wide.astype("<u2").tobytes() if small else ids)


def parse(data: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", data)
    ids = np.frombuffer(data, "<u4" if flags & 2 else "<u2", offset=9).astype("<u4")
    return (None if flags & 1 else doc_id), ids


def _file_system(folder: str):
    from pyarrow import fs
    system, path = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    return system, path


def _write(folder: str, tokenizer: str, end_id: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        from pyspark import TaskContext
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return
        number = TaskContext.get().partitionId()
        name = f"part-{number:06d}-{uuid.uuid4().hex}"
        system, path = _file_system(folder)
        system.create_dir(path, recursive=True)
        vocab = word_bpe.load(tokenizer)
        index, at, total = [], 0, 0
        with system.open_output_stream(f"{path}/{name}.rec") as out:
            b = first
            while b is not None:
                for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    ids = vocab.ids(text.as_py() or "") + end
                    data = payload(doc, ids)
                    index.append((at, len(data)))
                    at += len(data) + 16
                    total += len(ids) // 4
                    out.write(frame(data))
                b = next(batches, None)
        with system.open_output_stream(f"{path}/{name}.idx") as out:
            out.write(np.array(index, "<u8").tobytes())
        yield pa.RecordBatch.from_pylist([{"file_no": number, "name": name, "n_records": len(index), "n_ids": total}],
                                         schema=pa.schema([("file_no", pa.int64()), ("name", pa.string()),
                                                           ("n_records", pa.int64()), ("n_ids", pa.int64())]))
    return run


def write_records(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                  end_id: int = 2) -> DataFrame:
    """Write the record files; returns the manifest (one row per file, in
    ascending id order by file_no)."""
    source = with_package(renamed(docs, doc_id=id_col, text=text_col)).select(F.col("doc_id").cast("long"), "text")
    ordered = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return written(ordered.mapInArrow(_write(folder, tokenizer, end_id), MANIFEST), "records-manifest")


def read_records(spark: SparkSession, folder: str, manifest: DataFrame, seed: int | None = None,
                 with_ids: bool = True) -> DataFrame:
    """Records read back through the index, checksums verified: doc_id,
    start (ids of all records before it), n_tokens, ids_crc32 and, if asked
    for, ids. With ``seed`` files and the records of each file come in a
    random order."""
    files = sorted(tuple(r) for r in manifest.collect())  # one row per file
    base, todo = 0, []
    for _, name, _, n_ids in files:
        todo.append((name, base))
        base += n_ids
    if seed is not None:
        random.Random(seed).shuffle(todo)
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")

    def run(batches):
        system, path = _file_system(folder)
        for b in batches:
            for k in b.column(0).to_pylist():
                name, start = todo[k]
                with system.open_input_stream(f"{path}/{name}.idx") as f:
                    index = np.frombuffer(f.read(), "<u8").reshape(-1, 2)
                order = list(range(len(index)))
                if seed is not None:
                    random.Random(seed * 1_000_003 + k).shuffle(order)
                widths = []
                with system.open_input_file(f"{path}/{name}.rec") as f:
                    if seed is not None:  # starts need every record's width: 2 or 4 bytes an id
                        widths = [4 if f.read_at(1, int(at) + 12)[0] & 2 else 2 for at, _ in index]
                        lengths = np.array([(int(n) - 9) // w for (_, n), w in zip(index, widths, strict=True)], np.int64)
                        starts = start + np.concatenate(([0], np.cumsum(lengths)))[:-1] if len(lengths) else []
                    rows = []
                    for i in order:
                        at, n = map(int, index[i])
                        doc, ids = parse(unframe(f.read_at(n + 16, at), 0))
                        row = {"doc_id": doc, "start": int(starts[i]) if seed is not None else start,
                               "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
                        start += len(ids)
                        if with_ids:
                            row["ids"] = ids.astype(np.int32)
                        rows.append(row)
                        if len(rows) == 2000:
                            yield _batch(rows, with_ids)
                            rows = []
                    if rows:
                        yield _batch(rows, with_ids)
    n = max(1, len(todo))
    return spark.range(0, len(todo), 1, n).mapInArrow(run, schema)


def _batch(rows: list[dict], with_ids: bool) -> pa.RecordBatch:
    fields = [(k, pa.int64()) for k in ("doc_id", "start", "n_tokens", "ids_crc32")]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else [])))
