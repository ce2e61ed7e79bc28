"""Token ids in files of independent zstandard frames.

A file holds one frame per document (its ids as little-endian unsigned 32-bit integers), a skippable
frame with the documents' ids, and a trailing seek table: size, unpacked size and checksum of every
frame. A reader loads the tail, then only the frames of the documents asked for.

Files are written by tasks straight to the shared folder under names that no other attempt uses. The
manifest, a Parquet table that Spark commits, names the files that count; what a lost or repeated attempt
left behind is never read.
"""

from __future__ import annotations

import os
import posixpath
import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docengine.llm.common import gather, id_and_text, kept_in_worker, slices
from docengine.session import work_dir

END_ID = 2
FILE_BYTES = 64_000_000
KEPT, CUT = 1_000_000, "\x01"
# Fixed values of the seekable zstandard format.
SKIPPABLE_INDEX, SKIPPABLE_SEEK, SEEK_MAGIC, CHECKSUM_FLAG = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
OTHER = "[\t\x0b-\r\x85\xa0  -     　]"
MANIFEST = "file string, first_id long, last_id long, n_docs long, n_ids long, n_bytes long"


class Encoder:
    """A tokenizer of the byte-level kind, applied to the distinct pieces of many texts.

    A pre-token never runs on over a blank between two other characters, over a line end or from a letter
    into a mark, so texts are cut there and every distinct piece is encoded once. That holds only where white space of different
    kinds doesn't meet: texts in which a blank or a line end touches other white space, or a blank another blank, are encoded
    whole, as are those with the cutting character. Pieces are kept up to ``KEPT`` of them.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallel units
        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes_of = np.array([len(self.tokenizer.id_to_token(i) or "") for i in range(size)], np.int64)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and the number of each text's ids."""
        odd = pc.match_substring_regex(texts, f"[ \n]{OTHER}|{OTHER}[ \n]|  | \n|\n |{CUT}").to_numpy(zero_copy_only=False)
        odd |= pc.equal(texts, "").to_numpy(zero_copy_only=False)
        even = pc.replace_substring(texts.filter(pa.array(~odd)), " ", f"{CUT} ")
        even = pc.replace_substring_regex(even, "(\n*)\n([^\n])", f"{CUT}\\1{CUT}\n{CUT}\\2")
        even = pc.replace_substring_regex(even, "([A-Za-z])([.,;:!?])", f"\\1{CUT}\\2")
        lists = pc.split_pattern(even, CUT)
        coded = lists.values.dictionary_encode()
        codes = self._numbers(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        whole = self._alone(texts.filter(pa.array(odd)).to_pylist())
        flat = np.concatenate([self.flat, *whole])
        starts = np.concatenate([self.starts, len(self.flat) + np.cumsum([0] + [len(x) for x in whole])[:-1]]).astype(np.int64)
        sizes = np.concatenate([self.sizes, np.array([len(x) for x in whole], np.int64)])
        # One list of codes over all texts: an odd text is a single code.
        count = np.ones(len(texts), np.int64)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        count[~odd] = np.diff(offsets)
        begins = np.concatenate([[0], np.cumsum(count)])
        order = np.empty(begins[-1], np.int64)
        order[np.repeat(begins[:-1][~odd] - offsets[:-1], np.diff(offsets)) + np.arange(len(codes))] = codes
        order[begins[:-1][odd]] = len(self.sizes) + np.arange(len(whole))
        ids, each = gather(flat, starts, sizes, order)
        total = np.concatenate([[0], np.cumsum(each)])
        return ids, total[begins[1:]] - total[begins[:-1]]

    def _numbers(self, pieces: list[str]) -> np.ndarray:
        """Number of each piece among the known ones, after encoding those that are new."""
        if len(self.known) + len(pieces) > KEPT:
            self._forget()
        new = [x for x in pieces if x not in self.known]
        if new:
            flat, sizes = self._pieces(new)
            self.known |= zip(new, range(len(self.known), len(self.known) + len(new)), strict=True)
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def _alone(self, texts: list[str]) -> list[np.ndarray]:
        found = []
        for start in range(0, len(texts), 256):
            done = self.tokenizer.encode_batch_fast(texts[start : start + 256], add_special_tokens=False)
            found += [np.array(x.ids, np.uint32) for x in done]
        return found

    def _pieces(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, one after another, and their number.

        Pieces are joined to longer texts where the joint is a place to cut: before a blank, or at a line end put
        between two of them. Ids go back to pieces by their bytes.
        """
        blank, bare, single = [], [], []
        for i, x in enumerate(pieces):
            if not x or x[-1].isspace() or (x[0].isspace() and x[0] != " "):
                single.append(i)
            else:
                (blank if x[0] == " " else bare).append(i)
        parts, owners, sizes = [], [], np.zeros(len(pieces), np.int64)
        for group, between in ((blank, ""), (bare, "\n")):
            for start in range(0, len(group), 20_000):
                block = group[start : start + 20_000]
                texts = [between.join(pieces[i] for i in block[k : k + 500]) + between for k in range(0, len(block), 500)]
                found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
                ids = np.concatenate([np.array(x.ids, np.uint32) for x in found])
                ends = np.cumsum([len(pieces[i].encode()) + len(between) for i in block])
                last = np.searchsorted(np.cumsum(self.bytes_of[ids]), ends)
                if between:
                    ids = np.delete(ids, last)
                    last = last - np.arange(1, len(last) + 1)
                sizes[block] = np.diff(last, prepend=-1)
                parts.append(ids)
                owners += block
        for i, ids in zip(single, self._alone([pieces[i] for i in single]), strict=True):
            sizes[i] = len(ids)
            parts.append(ids)
            owners.append(i)
        if not parts:
            return np.zeros(0, np.uint32), sizes
        flat, owners = np.concatenate(parts), np.array(owners)
        stored = sizes[owners]
        starts = np.empty(len(pieces), np.int64)
        starts[owners] = np.cumsum(stored) - stored
        return gather(flat, starts, sizes, np.arange(len(pieces)))[0], sizes


def frame_checksum(data: bytes) -> int:
    return xxhash.xxh64_intdigest(data) & 0xFFFFFFFF


class FrameFile:
    """Builds one file in memory-bounded pieces on an output stream."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.packer = stream, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int | None] = []
        self.n_ids = self.n_bytes = 0

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.n_bytes += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        data = ids.astype("<u4", copy=False).tobytes()
        packed = self.packer.compress(data)
        self.entries.append((len(packed), len(data), frame_checksum(data)))
        self.ids.append(doc_id)
        self.n_ids += len(ids)
        self._put(packed)

    def close(self) -> None:
        known = np.array([x or 0 for x in self.ids], "<i8").tobytes()
        absent = np.packbits([x is None for x in self.ids], bitorder="little").tobytes()
        body = self.packer.compress(struct.pack("<Q", len(self.ids)) + known + absent)
        self._put(struct.pack("<II", SKIPPABLE_INDEX, len(body)) + body)
        table = self.entries + [(len(body) + 8, 0, frame_checksum(body))]
        seek = b"".join(struct.pack("<III", *x) for x in table)
        foot = struct.pack("<IBI", len(table), CHECKSUM_FLAG, SEEK_MAGIC)
        self._put(struct.pack("<II", SKIPPABLE_SEEK, len(seek) + len(foot)) + seek + foot)


def read_tail(handle, size: int) -> tuple[np.ndarray, list[int | None]]:
    """Seek-table entries of the document frames, and the documents' ids."""
    handle.seek(size - 9)
    frames, flags, magic = struct.unpack("<IBI", handle.read(9))
    if magic != SEEK_MAGIC or flags != CHECKSUM_FLAG:
        raise ValueError("no seek table with checksums at the end of the file")
    handle.seek(size - 9 - 12 * frames)
    entries = np.frombuffer(handle.read(12 * frames), "<u4").reshape(-1, 3).astype(np.int64)
    index_size = int(entries[-1, 0]) - 8
    handle.seek(int(entries[:-1, 0].sum()) + 8)
    body = handle.read(index_size)
    if frame_checksum(body) != entries[-1, 2]:
        raise ValueError("the document index does not match its checksum")
    data = zstandard.ZstdDecompressor().decompress(body)
    (n,) = struct.unpack_from("<Q", data)
    known = np.frombuffer(data, "<i8", n, 8).tolist()
    absent = np.unpackbits(np.frombuffer(data, np.uint8, offset=8 + 8 * n), count=n, bitorder="little") if n else []
    return entries[:-1], [None if gone else x for x, gone in zip(known, absent, strict=True)]


def read_frames(handle, entries: np.ndarray, wanted: Iterable[int]) -> Iterator[tuple[int, bytes]]:
    """Checked contents of the frames asked for; the others are neither read nor unpacked."""
    at = np.concatenate([[0], np.cumsum(entries[:, 0])])
    unpacker = zstandard.ZstdDecompressor()
    for k in wanted:
        handle.seek(int(at[k]))
        size = int(entries[k, 1])
        data = unpacker.decompress(handle.read(int(entries[k, 0])), max_output_size=max(size, 1))
        if len(data) != size or frame_checksum(data) != entries[k, 2]:
            raise ValueError(f"frame {k} does not match its checksum")
        yield k, data


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = END_ID, id_col: str = "doc_id",
                 text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encode all texts and write them in ascending order of id; returns the manifest.

    Null text is empty; a null id comes first; rows repeated under one id are all written, ordered by
    text. An empty table gives an empty manifest. A text of any length is one frame.
    """
    folder = path.rstrip("/") + "/files"

    def write(batches):
        fs, base = open_folder(folder)
        fs.create_dir(base, recursive=True)
        encoder, out = kept_in_worker(("encoder", tokenizer), lambda: Encoder(tokenizer)), None
        for batch in batches:
            for part in slices(batch):
                ids, sizes = encoder.texts(part.column(1))
                ends = np.cumsum(sizes)
                for doc, start, end in zip(part.column(0).to_pylist(), ends - sizes, ends, strict=True):
                    if out is None:
                        name = f"{uuid.uuid4().hex}.zst"
                        out = FrameFile(fs.open_output_stream(posixpath.join(base, name), compression=None))
                    each = ids[start:end]
                    out.add(doc, each if end_id is None else np.append(each, np.uint32(end_id)))
                    if out.n_bytes >= file_bytes:
                        yield finish(out, name)
                        out = None
            pa.default_memory_pool().release_unused()
        if out is not None:
            yield finish(out, name)

    def finish(out, name):
        out.close()
        out.stream.close()
        known = [x for x in out.ids if x is not None] or [None]
        row = [name, None if out.ids[0] is None else known[0], known[-1], len(out.ids), out.n_ids, out.n_bytes]
        return pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True))], schema=types)

    names = [x.split()[0] for x in MANIFEST.split(", ")]
    types = pa.schema([(n, pa.string() if n == "file" else pa.int64()) for n in names])
    ordered = id_and_text(docs, id_col, text_col).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    spark = docs.sparkSession
    ordered.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files that count, with the number of ids before each. One row per file, so the window stays small."""
    rows = spark.read.schema(T._parse_datatype_string(MANIFEST)).parquet(f"{path}/manifest")
    before = Window.orderBy(F.col("first_id").asc_nulls_first(), F.col("last_id").asc_nulls_first(), "file")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(spark: SparkSession, path: str, wanted: list[int] | None = None, tasks: int | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit integers, packed).

    ``wanted`` is a short list of ids: only their files are opened and only their frames unpacked.
    """
    folder = path.rstrip("/") + "/files"
    chosen = None if wanted is None else set(wanted)
    files = manifest(spark, path)
    if chosen is not None:
        hit = [F.lit(x).between(F.coalesce("first_id", F.lit(-(2**63))), F.col("last_id")) for x in sorted(chosen)]
        files = files.filter(F.exists(F.array(*hit), lambda x: x)) if hit else files.limit(0)

    def read(batches):
        fs, base = open_folder(folder)
        for batch in batches:
            for row in batch.to_pylist():
                where = posixpath.join(base, row["file"])
                with fs.open_input_file(where) as handle:
                    entries, docs = read_tail(handle, handle.size())
                    starts = row["base"] + (np.cumsum(entries[:, 1]) - entries[:, 1]) // 4
                    keep = [k for k, x in enumerate(docs) if chosen is None or x in chosen]
                    held, size = [], 0
                    for k, data in read_frames(handle, entries, keep):
                        held.append((docs[k], int(starts[k]), data))
                        size += len(data)
                        if size > 8_000_000:
                            yield packed(held)
                            held, size = [], 0
                    if held:
                        yield packed(held)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    names, types = ["doc_id", "start", "ids"], [pa.int64(), pa.int64(), pa.binary()]
    dealt = files.select("file", "base").repartition(tasks or spark.sparkContext.defaultParallelism * 4)
    return dealt.mapInArrow(read, "doc_id long, start long, ids binary")


def token_files(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write to a fresh shared folder and read everything back."""
    path = work_dir(docs.sparkSession, "tokens")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
