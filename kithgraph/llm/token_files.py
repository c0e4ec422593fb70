"""Token-id files: independent zstandard frames, a trailing seek table, a checksum per frame.

A shard holds the ids of a range of documents as little-endian unsigned 32-bit numbers,
ended by an end id. Layout:

    frame 0 | frame 1 | ... | document index | seek table

Frames are whole zstandard frames of about `FRAME_IDS` ids that begin and end with a
document. The seek table is the skippable frame of the seekable format: compressed size,
size and low half of the xxh64 of each frame, then a footer with the number of frames.
The document index, a skippable frame before it, has per document its id, whether it has
one, and its number of ids, and per frame its number of documents. A reader takes footer,
table and index, then only the frames of the documents it wants, and checks them.

Shards are ranges of doc_id in ascending order (null first, ties by a hash of the text), one per
range partition, written to a temporary name and then renamed, so a task that runs twice
leaves one file. They lie in the shared folder and are opened by URI.

Defined cases: a null or empty text has the end id only; rows with equal doc_id stand next
to each other; an empty table makes no file and no rows.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kithgraph.llm import textbytes as B
from kithgraph.session import scratch_path

FRAME_IDS = 1 << 18
INDEX_MAGIC, TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1  # fixed by the format
END_ID = 1
CACHE_WORDS = 690_000  # per worker process, just below where the dict grows fourfold


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# How the given vocabulary prepares words: the rest of this module's short cut holds for it only.
NORMAL = ["NFC", "Replace", "Lowercase"]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
# The same split in Python for words of printable ASCII and letters U+00C0 to U+024F; U+0130 lower-cases to two.
_LATIN = (
    rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f]"
)
PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|(?:[a-z]|" + _LATIN + rb")+|[0-9]|[!-/:-`{-~]+")
WHOLE = re.compile(rb"(?:[!-~]|" + _LATIN + rb")+")


def _byte_level() -> dict[int, str]:
    """Byte-level's character for each byte: printable ones stay, the others follow from U+0100."""
    stay = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in stay]
    return {b: chr(b) for b in stay} | {b: chr(0x100 + n) for n, b in enumerate(rest)}


BYTE_LEVEL = _byte_level()


class _Words(dict):
    """ids of a word as bytes; `more` has those of the texts in hand that the cache has no room for."""

    def __init__(self):
        self.more: dict[bytes, bytes] = {}

    def __missing__(self, word: bytes) -> bytes:
        return self.more[word]

    def put(self, word: bytes, ids: bytes) -> None:
        (self if len(self) < CACHE_WORDS else self.more)[word] = ids


class Encoder:
    """A tokenizer that drops white space, lower-cases and never joins words.

    For such a one a text's ids are those of its words in turn, which are looked up. Where it
    prepares words as the given vocabulary does, unseen words are cut into their pieces here
    and only unseen pieces go to the tokenizer's model; others go through the whole tokenizer.
    """

    def __init__(self, vocabulary: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = _Words()
        given = json.loads(self.tokenizer.to_str())
        normal = [n["type"] for n in (given["normalizer"] or {}).get("normalizers", [])]
        split = (given["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.cuts = (
            normal == NORMAL
            and [p.get("pattern") for p in split] == [{"Regex": SPLIT}, None]
            and split[0]["behavior"] == "Removed"
            and split[0]["invert"]
            and split[1] == BYTES
            and given["post_processor"] is None
        )
        self.model = self.tokenizer.model

    def _whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, dtype="<u4").tobytes()

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode()
        if not piece.isascii():
            text = text.lower().encode().decode("latin-1").translate(BYTE_LEVEL)
        ids = [t.id for t in self.model.tokenize(text)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _learn(self, words: set[bytes]) -> None:
        known, cut = self.words, {}
        for word in words:
            if self.cuts and WHOLE.fullmatch(word):
                cut[word] = PIECES.findall(word)
            else:
                known.put(word, self._whole(word))
        for piece in {p for own in cut.values() for p in own}:
            if piece not in known:
                known.put(piece, self._piece(piece))
        for word, own in cut.items():
            if len(own) > 1:
                known.put(word, b"".join(map(known.__getitem__, own)))

    def encode_all(self, texts: list[bytes]) -> list[bytes]:
        split = [None if any(s in t for s in self.special) else t.lower().split() for t in texts]
        known = self.words
        known.more.clear()
        self._learn({w for words in split if words for w in words if w not in known})
        return [
            self._whole(t) if words is None else b"".join(map(known.__getitem__, words))
            for t, words in zip(texts, split, strict=True)
        ]

    def encode(self, text: bytes) -> bytes:
        return self.encode_all([text])[0]


_ENCODERS: dict[str, Encoder] = {}


def encoder(vocabulary: str) -> Encoder:
    """One encoder, with its looked-up words, per worker process."""
    if vocabulary not in _ENCODERS:
        _ENCODERS[vocabulary] = Encoder(vocabulary)
    return _ENCODERS[vocabulary]


class ShardWriter:
    def __init__(self, stream, frame_ids: int = FRAME_IDS):
        self.stream, self.frame_bytes = stream, 4 * frame_ids
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=False)
        self.held: list[bytes] = []
        self.held_bytes = 0
        self.frames: list[tuple[int, int, int, int]] = []  # packed, size, checksum, documents
        self.ids, self.known, self.counts = [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        if self.held and self.held_bytes + len(ids) > self.frame_bytes:
            self.flush()
        self.held.append(ids)
        self.held_bytes += len(ids)
        self.ids.append(doc_id or 0)
        self.known.append(doc_id is not None)
        self.counts.append(len(ids) // 4)

    def flush(self) -> None:
        raw = b"".join(self.held)
        packed = self.packer.compress(raw)
        self.stream.write(packed)
        self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF, len(self.held)))
        self.held, self.held_bytes = [], 0

    def close(self) -> None:
        if self.held:
            self.flush()
        index = struct.pack("<QQ", len(self.ids), len(self.frames))
        index += np.array(self.ids, "<i8").tobytes() + np.array(self.known, "u1").tobytes()
        index += np.array(self.counts, "<u8").tobytes() + np.array([f[3] for f in self.frames], "<u4").tobytes()
        index = self.packer.compress(index)
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = b"".join(struct.pack("<III", *f[:3]) for f in self.frames)
        table += struct.pack("<IBI", len(self.frames), 0x80, FOOTER_MAGIC)
        self.stream.write(struct.pack("<II", TABLE_MAGIC, len(table)) + table)


class ShardReader:
    """Random access to the documents of one shard."""

    def __init__(self, source):
        """source: a pyarrow random-access file."""
        self.source, size = source, source.size()
        n, kind, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != FOOTER_MAGIC or not kind & 0x80:
            raise ValueError("not a token shard: no seek table with checksums at its end")
        table = size - 9 - 12 * n - 8
        self.frames = np.frombuffer(self._at(table + 8, 12 * n), "<u4").reshape(n, 3).astype(np.int64)
        self.begin = np.concatenate([[0], np.cumsum(self.frames[:, 0])])
        head = self._at(int(self.begin[-1]), 8)
        magic, length = struct.unpack("<II", head)
        if magic != INDEX_MAGIC:
            raise ValueError("not a token shard: no document index")
        index = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[-1]) + 8, length))
        docs, _ = struct.unpack_from("<QQ", index)
        self.ids = np.frombuffer(index, "<i8", docs, 16)
        self.known = np.frombuffer(index, "u1", docs, 16 + 8 * docs).astype(bool)
        self.counts = np.frombuffer(index, "<u8", docs, 16 + 9 * docs).astype(np.int64)
        per_frame = np.frombuffer(index, "<u4", n, 16 + 17 * docs)
        self.first = np.concatenate([[0], np.cumsum(per_frame)]).astype(np.int64)

    def _at(self, offset: int, length: int) -> bytes:
        return self.source.read_at(length, offset)

    def frame(self, k: int) -> bytes:
        packed, size, checksum = self.frames[k].tolist()
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.begin[k]), packed), max_output_size=size)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {k} does not match its checksum")
        return raw

    def documents(self) -> Iterator[tuple[int | None, bytes]]:
        for k in range(len(self.frames)):
            raw, at = self.frame(k), 0
            for d in range(int(self.first[k]), int(self.first[k + 1])):
                end = at + 4 * int(self.counts[d])
                yield (int(self.ids[d]) if self.known[d] else None), raw[at:end]
                at = end

    def document(self, d: int) -> bytes:
        """The ids of the d-th document; reads one frame."""
        k = int(np.searchsorted(self.first, d, side="right")) - 1
        at = 4 * int(self.counts[self.first[k] : d].sum())
        return self.frame(k)[at : at + 4 * int(self.counts[d])]

    def find(self, doc_id: int) -> list[int]:
        return np.flatnonzero((self.ids == doc_id) & self.known).tolist()


def open_shard(uri: str) -> ShardReader:
    fs, path = pafs.FileSystem.from_uri(uri)
    return ShardReader(fs.open_input_file(path))


def write_shards(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, frame_ids: int = FRAME_IDS) -> DataFrame:
    """Write `docs` (doc_id, text); a row (shard, uri, n_docs, n_ids) for each file, as a stored table."""

    def run(batches):
        writer = name = stream = fs = None
        docs_in = ids_in = 0
        shard = TaskContext.get().partitionId()
        end = struct.pack("<I", end_id)
        pa.default_memory_pool().release_unused()  # a reused worker may hold an earlier stage's buffers
        for batch in batches:
            for part in B.slices(batch, "text"):
                if writer is None:
                    fs, base = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(base, recursive=True)
                    name = f"{base}/shard-{shard:06d}"
                    held = f"{base}/.shard-{shard:06d}-{uuid.uuid4().hex}"
                    stream = fs.open_output_stream(held)
                    writer = ShardWriter(stream, frame_ids)
                data, offsets = B.flat(part.column("text"))
                raw, edges = data.tobytes(), offsets.tolist()
                encoded = encoder(vocabulary).encode_all([raw[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)])
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    ids += end
                    writer.add(doc_id, ids)
                    docs_in += 1
                    ids_in += len(ids) // 4
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(held, name)
            row = {"shard": [shard], "uri": [f"{folder}/shard-{shard:06d}"], "n_docs": [docs_in], "n_ids": [ids_in]}
            yield pa.RecordBatch.from_pydict(row, schema=schema)

    schema = pa.schema([("shard", pa.int32()), ("uri", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("_t"))
    order = [F.col("doc_id").asc_nulls_first(), "_t"]
    ordered = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    shards = ordered.select("doc_id", "text").mapInArrow(run, "shard int, uri string, n_docs long, n_ids long")
    table = scratch_path(spark, "shards")
    shards.write.parquet(table)
    return spark.read.parquet(table)


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files themselves."""

    def run(batches):
        for batch in batches:
            for uri, start in zip(batch.column("uri").to_pylist(), batch.column("start").to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc_id, ids in open_shard(uri).documents():
                    rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids)))
                    start += len(ids) // 4
                    if len(rows) == 4096:
                        yield made(rows)
                        rows = []
                if rows:
                    yield made(rows)

    def made(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names)

    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    # One row per shard: the window's one task reads as many rows as there are files.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = shards.select("shard", "uri", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("start"))
    parts = int(shards.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return placed.repartition(parts, "shard").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, vocabulary: str | None = None, end_id: int = END_ID) -> DataFrame:
    folder = scratch_path(docs.sparkSession, "tokens")
    shards = write_shards(docs.select("doc_id", "text"), folder, vocabulary or default_vocabulary(), end_id)
    return read_shards(shards)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"))
