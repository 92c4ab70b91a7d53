"""Operator 10: token ids in length-delimited binary files, with an index for shuffled reads.

A record file is a run of frames: length (8 bytes), masked checksum of the length (4), payload,
masked checksum of the payload (4), all little-endian; the checksum is CRC-32, rotated right by 15
bits plus a constant, so that a checksum stored in a payload is no valid frame.  A payload is the
document id (8 bytes), a byte that is 1 for a null id, the width of an id in bytes (2 where the
vocabulary allows, else 4), and the ids.  The index file beside it has 16 bytes per record: its
offset and the number of ids before it in the file; any record is found with one seek.

Each task writes one range of ascending document ids to files of its own with a unique name; only
files named in the manifest count, so a task that runs twice after a lost executor does no harm.
Files are opened by URI (local, HDFS or object store) below the shared folder.

Defined results: null text counts as empty, so its record is the end id alone; rows with equal ids
stay side by side, ordered by a hash of their texts; a null id comes first; ids that are no
integers are refused (TypeError); an empty table writes no file and reads back empty; other columns are
ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import new_folder, table, written
from .ordered import id_ranges
from .wordbpe import WordEncoder, vocabulary_path

END_ID = 1
#: Bytes that are read at a time where records are read in the order of the file.
BLOCK = 8 << 20
_HEAD, _ID = "<QI", "<qBB"
_encoders: dict[tuple, WordEncoder] = {}


def masked(data: bytes) -> int:
    """Masked CRC-32."""
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the frame at ``at`` and where the next one starts; ValueError if it is damaged."""
    n, check = struct.unpack_from(_HEAD, data, at)
    payload = data[at + 12 : at + 12 + n]
    if masked(data[at : at + 8]) != check or len(payload) != n or struct.unpack_from("<I", data, at + 12 + n)[0] != masked(payload):
        raise ValueError(f"damaged record at byte {at}")
    return payload, at + n + 16


def parse(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, null, width = struct.unpack_from(_ID, payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=struct.calcsize(_ID)).astype("<u4")


def library_encoder(path: str, width: int) -> WordEncoder:
    """The tokenizers library behind a memory of words: one call for each new word."""
    key = (path, width)
    if key not in _encoders:
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        tokenize = library.model.tokenize
        words = lambda spelled: [[t.id for t in tokenize(w)] for w in spelled]
        chunks = lambda texts: [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        _encoders[key] = WordEncoder(words, chunks, f"<u{width}")
    return _encoders[key]


def _open(uri: str, how: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    return getattr(system, how)(path)


def write_records(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encode and write all ``docs`` below ``folder``; the manifest: part, file, n_records, n_ids."""
    path = vocabulary_path(path)
    from tokenizers import Tokenizer

    width = 2 if max(Tokenizer.from_file(path).get_vocab_size() - 1, end_id) < 1 << 16 else 4
    rows, borders = id_ranges(docs, id_col, text_col)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, end = library_encoder(path, width), np.array([end_id], f"<u{width}").tobytes()
        out, name, index, at, ids, part = None, f"{folder}/{uuid.uuid4().hex}", [], 0, 0, -1
        from pyarrow import fs

        for batch in batches:
            for a in range(0, len(batch), 500):
                piece = batch.iloc[a : a + 500]
                if out is None:
                    system, below = fs.FileSystem.from_uri(folder)
                    system.create_dir(below, recursive=True)
                    out, part = _open(f"{name}.records", "open_output_stream"), int(piece["part"].iloc[0])
                for key, null, data in zip(piece["key"].tolist(), piece["is_null"].tolist(), encode(piece["text"].tolist())):
                    framed = frame(struct.pack(_ID, key, null, width) + data + end)
                    out.write(framed)
                    index.append((at, ids))
                    at += len(framed)
                    ids += (len(data) + len(end)) // width
        if out is not None:
            out.close()
            with _open(f"{name}.index", "open_output_stream") as where:
                where.write(np.array(index, "<u8").tobytes())
            yield pd.DataFrame({"part": [part], "file": [name], "n_records": [len(index)], "n_ids": [ids]})

    dealt = rows.select("key", F.col("id").isNull().alias("is_null"), "text", "part", F.xxhash64("text").alias("tie")).repartitionById(len(borders), F.col("part")).sortWithinPartitions("key", "tie")
    return written(dealt.select("key", "is_null", "text", "part").mapInPandas(run, "part int, file string, n_records long, n_ids long"), "manifest")


def read_records(manifest: DataFrame, shuffle_seed: int | None = None) -> DataFrame:
    """All records of a manifest: doc_id, start (ids before it in all files), ids (unsigned 32-bit).

    With a seed each file's records come in a random order, found through the index one by one; without, a
    file is read in blocks of some megabytes.
    """
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row a file
    files = manifest.withColumn("first", F.coalesce(before, F.lit(0))).select("part", "file", "first")
    parts = (manifest.agg(F.max("part")).first()[0] or 0) + 1

    def frame_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "start": [r[1] for r in rows], "ids": [r[2] for r in rows]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part, name, first in zip(batch["part"], batch["file"], batch["first"]):
                with _open(f"{name}.index", "open_input_file") as where:
                    index = np.frombuffer(where.read(), "<u8").reshape(-1, 2).astype(np.int64)
                with _open(f"{name}.records", "open_input_file") as records:
                    size = records.size()
                    ends = np.append(index[1:, 0], size)
                    starts = index[:, 0]
                    if shuffle_seed is None:
                        numbers = np.unique(starts // BLOCK, return_index=True)[1]
                        runs = [np.arange(a, b) for a, b in zip(numbers, [*numbers[1:], len(index)])]
                    else:
                        runs = [[i] for i in np.random.default_rng([shuffle_seed, part]).permutation(len(index))]
                    rows = []
                    for run_ in runs:
                        at = int(starts[run_[0]])
                        records.seek(at)
                        data = records.read(int(ends[run_[-1]]) - at)
                        for i in run_:
                            doc_id, ids = parse(unframe(data, int(starts[i]) - at)[0])
                            rows.append((doc_id, int(first) + int(index[i, 1]), ids.tobytes()))
                            if len(rows) == 500:
                                yield frame_of(rows)
                                rows = []
                    if rows:
                        yield frame_of(rows)

    return files.repartitionById(parts, F.col("part")).mapInPandas(run, "doc_id long, start long, ids binary")


def op10_record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written to record files, and what the files hold."""
    manifest = write_records(table(spark, sf_dir, "documents"), new_folder(spark, "records"))
    return read_records(manifest).select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
