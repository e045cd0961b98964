"""Token-id files: one compressed frame per document under a shared zstandard dictionary.

Documents are range-partitioned by id; each task encodes its range and writes one file
to the shared folder. A file holds, in order:

    magic "TKZ1", u32 header length, header (JSON: id width, dictionary hash, counts)
    one zstandard frame per document, ids as little-endian integers of that width
    index: u64 frame offset, u32 frame length, u32 ids, for each document
    document ids as an Arrow stream, then u64 index offset, u64 ids offset, magic

The dictionary lies beside the files and is named by its hash; a reader refuses another
one. A short document is read by its index entry alone, without its neighbours.

The dictionary is trained on the serialized ids of at most ``sample`` documents of at
most ``sample_chars`` characters, those with the smallest hash of their id. Everything
else covers all rows and whole texts. Files carry the name of the task attempt that
wrote them and only those of successful attempts are listed, so a repeated task leaves
an unlisted file and nothing else.

Null texts count as empty: a document of the end id alone. Null ids sort first. Rows
that share an id are kept, ordered by text.
"""

from __future__ import annotations

import hashlib
import io
import json
import struct
import uuid
import zlib
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from tidemark.llm.piece_encoder import PieceEncoder
from tidemark.llm.rows import stored, texts, worker_cache
from tidemark.session import scratch_path

MAGIC = b"TKZ1"
ENTRY = np.dtype([("at", "<u8"), ("length", "<u4"), ("ids", "<u4")])


@dataclass(frozen=True)
class Settings:
    tokenizer: str
    end_id: int = 0
    level: int = 3
    dictionary_bytes: int = 64 * 1024
    sample: int = 500
    sample_chars: int = 20_000


def encoder(path: str) -> PieceEncoder:
    """One encoder, with what it remembers, for each Python process."""
    cache = worker_cache("encoders")
    if path not in cache:
        cache[path] = PieceEncoder(path)
    return cache[path]


def open_folder(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder, wherever it lies."""
    return pafs.FileSystem.from_uri(folder if ":/" in folder else f"file://{folder}")


def train_dictionary(docs: DataFrame, settings: Settings, folder: str) -> str:
    """Train on the bounded sample, write the dictionary and return its hash ("" if the sample is too small)."""
    small = docs.select("doc_id", "text").where(F.length("text") <= settings.sample_chars)
    keys = small.select("doc_id").where("doc_id is not null").orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.sample)
    chosen = [r[0] for r in keys.collect()]

    def serialize(batches):
        own = encoder(settings.tokenizer)
        for batch in batches:
            ids = [i.tobytes() for i in own.encode(texts(batch.column(1)))]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary())], ["ids"])

    rows = small.where(F.col("doc_id").isin(chosen)).mapInArrow(serialize, "ids binary").limit(settings.sample).collect()
    samples = sorted(bytes(r["ids"]) for r in rows)
    try:
        data = zstandard.train_dictionary(settings.dictionary_bytes, samples, level=settings.level).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return ""
    name = hashlib.sha256(data).hexdigest()
    fs, path = open_folder(folder)
    fs.create_dir(path, recursive=True)
    with fs.open_output_stream(f"{path}/{name}.dict") as out:
        out.write(data)
    return name


def load_dictionary(fs: pafs.FileSystem, path: str, name: str) -> zstandard.ZstdCompressionDict | None:
    if not name:
        return None
    with fs.open_input_file(f"{path}/{name}.dict") as file:
        data = file.read()
    if hashlib.sha256(data).hexdigest() != name:
        raise ValueError("the dictionary does not have the hash that the file names")
    return zstandard.ZstdCompressionDict(data)


class _Writer:
    """One file, written front to back."""

    def __init__(self, fs: pafs.FileSystem, path: str, header: dict, compressor: zstandard.ZstdCompressor):
        self.out, self.at, self.compressor = fs.open_output_stream(path), 0, compressor
        text = json.dumps(header, sort_keys=True).encode()
        self.put(MAGIC + struct.pack("<I", len(text)) + text)
        self.entries: list[tuple[int, int, int]] = []
        self.keys: list[pa.Array] = []

    def put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, ids: bytes, width: int) -> None:
        frame = self.compressor.compress(ids)
        self.entries.append((self.at, len(frame), len(ids) // width))
        self.put(frame)

    def close(self) -> None:
        index_at = self.at
        self.put(np.array(self.entries, ENTRY).tobytes())
        keys_at = self.at
        sink = io.BytesIO()
        data = pa.table({"doc_id": pa.chunked_array(self.keys)})
        with pa.ipc.new_stream(sink, data.schema) as stream:
            stream.write_table(data)
        self.put(sink.getvalue())
        self.put(struct.pack("<QQ", index_at, keys_at) + MAGIC)
        self.out.close()


def write_token_files(docs: DataFrame, folder: str, settings: Settings, parts: int | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """Write files below ``folder``; returns their list: part (ascending ranges), file, docs, ids.

    Documents stand in the order of ``order`` and then of their ids.
    """
    spark = docs.sparkSession
    places = [f"place_{i}" for i in range(len(order))]
    placed = [c.alias(n) for c, n in zip(order, places)]
    source = docs.select(F.col("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *placed)
    dictionary = train_dictionary(source, settings, folder)

    def write(batches):
        from pyspark import TaskContext

        own, part = encoder(settings.tokenizer), TaskContext.get().partitionId()
        fs, path = open_folder(folder)
        fs.create_dir(path, recursive=True)
        shared = load_dictionary(fs, path, dictionary)
        compressor = zstandard.ZstdCompressor(level=settings.level, dict_data=shared, write_content_size=True)
        width, end = own.dtype.itemsize, np.array([settings.end_id], own.dtype).tobytes()
        writer, name, total = None, f"part-{part:06d}-{uuid.uuid4().hex}.tkz", 0
        for batch in batches:
            if not batch.num_rows:
                continue
            writer = writer or _Writer(fs, f"{path}/{name}", {"width": width, "dictionary": dictionary, "end_id": settings.end_id}, compressor)
            for ids in own.encode(texts(batch.column(1))):
                writer.add(ids.tobytes() + end, width)
                total += len(ids) + 1
            writer.keys.append(batch.column(0))
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": [name], "docs": pa.array([len(writer.entries)], pa.int64()), "ids": pa.array([total], pa.int64())}
            )

    ranged = source.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *places, "doc_id")
    ordered = ranged.sortWithinPartitions(*places, "doc_id", "text").select("doc_id", "text")
    return stored(ordered.mapInArrow(write, "part int, file string, docs long, ids long"), "token-files")


class TokenFile:
    """One file opened for reading, whole or by document."""

    def __init__(self, folder: str, name: str):
        fs, path = open_folder(folder)
        self.file = fs.open_input_file(f"{path}/{name}")
        magic, n = struct.unpack("<4sI", self.file.read_at(8, 0))
        index_at, keys_at, tail = struct.unpack("<QQ4s", self.file.read_at(20, self.file.size() - 20))
        if magic != MAGIC or tail != MAGIC:
            raise ValueError("not a token file, or not a whole one")
        self.header = json.loads(self.file.read_at(n, 8))
        self.dtype = np.dtype(f"<u{self.header['width']}")
        self.index = np.frombuffer(self.file.read_at(keys_at - index_at, index_at), ENTRY)
        self.keys = pa.ipc.open_stream(self.file.read_at(self.file.size() - 20 - keys_at, keys_at)).read_all()["doc_id"]
        self.decompressor = zstandard.ZstdDecompressor(dict_data=load_dictionary(fs, path, self.header["dictionary"]))

    def ids(self, row: int) -> np.ndarray:
        """The ids of one document, by its own frame alone."""
        at, length, n = (int(x) for x in self.index[row])
        frame = self.file.read_at(length, at)
        return np.frombuffer(self.decompressor.decompress(frame, max_output_size=n * self.dtype.itemsize), self.dtype)


def read_token_files(
    files: DataFrame, folder: str, key: StructType, columns: str, make: Callable[[np.ndarray], dict]
) -> DataFrame:
    """One row per document of the listed files: its id, ``start`` (ids before it) and what ``make`` gives for its ids.

    ``columns`` is the schema of ``make``'s values. The list has a row per file, so the
    running totals of files are one small window.
    """
    spark: SparkSession = files.sparkSession
    listed = files.select("part", "file", "ids").orderBy("part").collect()
    firsts, total = [], 0
    for row in listed:
        firsts.append((row["file"], total))
        total += row["ids"]
    out = f"doc_id {key['doc_id'].dataType.simpleString()}, start long, n_tokens long, {columns}"
    names = [c.split()[0] for c in columns.split(", ")]
    schema = StructType.fromDDL(out)

    def read(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        target = to_arrow_schema(schema)
        for batch in batches:
            for name, first in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file = TokenFile(folder, name)
                sizes = file.index["ids"].astype(np.int64)
                starts = first + np.cumsum(sizes) - sizes
                for at in range(0, len(sizes), 4096):
                    stop = min(len(sizes), at + 4096)
                    made = [make(file.ids(i)) for i in range(at, stop)]
                    keys = file.keys.slice(at, stop - at).combine_chunks()
                    columns = [keys, pa.array(starts[at:stop]), pa.array(sizes[at:stop])]
                    columns += [pa.array([m[n] for m in made]).cast(target.field(n).type) for n in names]
                    yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, target)], schema=target)

    list_of = spark.createDataFrame(firsts, "file string, first long")
    return list_of.repartition(max(1, len(firsts)), "file").mapInArrow(read, out)


def crc_of(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}


def token_digest(docs: DataFrame, settings: Settings, folder: str | None = None, order: Sequence[Column] = ()) -> DataFrame:
    """Write the files, read them back: doc_id, start, n_tokens and the checksum of each document's ids."""
    folder = folder or scratch_path(docs.sparkSession, "tokens")
    files = write_token_files(docs, folder, settings, order=order)
    return read_token_files(files, folder, docs.select("doc_id").schema, "ids_crc32 long", crc_of)
