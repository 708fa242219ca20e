"""Token-ID output: shard files of zstandard frames, one frame a document, with a shared dictionary.

A shard file holds, in this order:

* header: 8 bytes ``QTOK0001``, 32 bytes SHA-256 of the dictionary, 4 bytes id width (4);
* frames: one zstandard frame for each document, its ids as little-endian unsigned 32-bit integers;
* index: for each document little-endian u64 frame offset, u32 frame length, u32 number of ids,
  then the doc_ids as one zstandard-compressed Arrow stream;
* footer: u64 offset of the index, u64 number of documents, 8 bytes ``QTOK0001``.

A document is read by one index lookup and one small frame; the dictionary (``<hash>.zdict``, next
to the shards) keeps short frames small. Shards are ranges of doc_id of about ``SHARD_BYTES`` of
text at most, so shard order and order in a shard are ascending doc_id. A task writes under a name of its own; only files that the manifest
names count, so a repeated or lost task leaves no trace in the output.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import regex
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm.shared import row_hash, shared_path, written

MAGIC = b"QTOK0001"
HEADER, FOOTER, ENTRY = "<8s32sI", "<QQ8s", np.dtype([("at", "<u8"), ("length", "<u4"), ("ids", "<u4")])
END_ID = 2
#: The dictionary is trained on so many documents at most (smallest row hashes), from each a passage of
#: so many characters at a place that its hash picks; bytes of the dictionary.
DICTIONARY_DOCS, DICTIONARY_SAMPLE, DICTIONARY_BYTES = 2000, 4096, 65536
#: Bytes of text in a shard (64 are added for each row), and bytes of frames that a reader asks for at once.
SHARD_BYTES, READ_BYTES = 128 << 20, 8 << 20
LEVEL = 3
#: Words whose ids a worker remembers, and bytes of the longest remembered one.
CACHE_WORDS, CACHE_LENGTH = 700_000, 64
#: Bytes of compressed frames that a writer holds before it passes them on.
BUFFER = 4 << 20


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# White space of the tokenizer's pattern, and its pattern for texts without other letters.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
LATIN = "a-z\xdf-\xf6\xf8-\xff"
LATIN_PIECES = re.compile(f"{ENDINGS}|[{LATIN}]+|[0-9]|[^\t-\r {LATIN}0-9]+")
NOT_LATIN = re.compile("[^\x00-\x7f\xc0-\xd6\xd8-\xf6\xf8-\xff]")
PIECES = regex.compile(f"{ENDINGS}|\\p{{L}}+|\\p{{N}}|[^{SPACES}\\p{{L}}\\p{{N}}]+")
# The same tokenizer's normaliser and splitter, as its file states them.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": f"{ENDINGS}|[\\p{{L}}]+|[\\p{{N}}]|[^\\s\\p{{L}}\\p{{N}}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: First character from which texts always go through the tokenizer, and those below it that Python's
#: tables don't know: another version of Unicode may call them letters.
PLAIN_END = 0x3000
UNASSIGNED = re.compile("[" + "".join(f"\\u{c:04x}" for c in range(PLAIN_END) if unicodedata.category(chr(c)) == "Cn") + "]")


class WordEncoder:
    """Encodes texts piece by piece, as the tokenizer does whole texts, and remembers pieces.

    The tokenizer normalises a text, cuts it into pieces by a pattern and encodes each on its own,
    so a text's ids are those of its pieces in order. Pieces are cut here; texts whose
    normalisation is more than lower-casing (or that hold a special token's string, or characters
    that Python's Unicode tables don't know) go through the tokenizer as a whole. So do all texts
    under a tokenizer whose file states another normaliser, splitter or model than this one's.
    """

    def __init__(self, path: str, words: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        model = stated["model"]
        plain = model["type"] == "BPE" and model.get("dropout") is None and not model.get("ignore_merges") and not stated.get("truncation") and not stated.get("padding")
        self._by_pieces = plain and stated["normalizer"] == NORMALIZER and stated["pre_tokenizer"] == SPLITTER
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._words, self._known = words, {}
        # byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self._bytes = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in plain)}

    def _pieces(self, text: str) -> list[str] | None:
        if not self._by_pieces or any(t in text for t in self._special):
            return None
        if text.isascii() or not NOT_LATIN.search(text):
            return LATIN_PIECES.findall(text.lower())
        if max(text) < chr(PLAIN_END) and "\u03a3" not in text and not UNASSIGNED.search(text) and unicodedata.is_normalized("NFC", text):
            return PIECES.findall(text.lower())
        return None

    def _learn(self, piece: str) -> bytes:
        shown = piece.encode("utf-8", "surrogatepass").decode("latin-1").translate(self._bytes)
        ids = np.array([t.id for t in self._model.tokenize(shown)], "<u4").tobytes()
        if len(piece) <= CACHE_LENGTH:
            self._known[piece] = ids
        return ids

    def encode(self, texts: Iterable[str]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        for text in texts:
            pieces = self._pieces(text)
            if pieces is None:
                yield np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
                continue
            new = set(pieces).difference(self._known)
            if len(self._known) + len(new) > self._words:
                self._known, new = {}, set(pieces)
            own = {p: self._learn(p) for p in new}
            if any(len(p) > CACHE_LENGTH for p in new):
                yield b"".join([self._known[p] if p in self._known else own[p] for p in pieces])
            else:
                yield b"".join(map(self._known.__getitem__, pieces))


_encoders: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder for that tokenizer, kept from task to task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def store_uri(uri: str) -> str:
    """A folder's address as Spark has it, in the form that pyarrow's file systems take."""
    if uri.startswith("file:"):
        return re.sub("^file:/+", "file:///", uri)
    if found := re.match(r"s3[an]://(.*)$", uri):
        return f"s3://{found[1]}"
    if found := re.match(r"dbfs:/+(.*)$", uri):
        return f"file:///dbfs/{found[1]}"
    if found := re.match(r"wasbs?://([^@/]+)@([^./]+)\.blob\.(.*)$", uri):
        return f"abfss://{found[1]}@{found[2]}.dfs.{found[3]}"
    return uri


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of an address; what pyarrow doesn't know goes to fsspec, if that is there."""
    uri = store_uri(uri)
    try:
        return pafs.FileSystem.from_uri(uri)
    except (pa.ArrowInvalid, NotImplementedError, ValueError) as fault:
        try:
            import fsspec
        except ModuleNotFoundError:
            raise ValueError(f"token files can't be written to {uri}: neither pyarrow nor fsspec opens it") from fault
        fs, path = fsspec.core.url_to_fs(uri)
        return pafs.PyFileSystem(pafs.FSSpecHandler(fs)), path


def _strings(batch: pa.RecordBatch, k: int) -> Iterator[str]:
    return (t.as_py() or "" for t in batch.column(k))


def trained_dictionary(docs: DataFrame, encoder: str, end_id: int = END_ID) -> bytes:
    """A zstandard dictionary trained on serialized ids of a bounded sample (``DICTIONARY_DOCS``).

    Where the sample is too small for the trainer, the sample itself is the dictionary; only a table
    without any id has none.
    """
    keyed = docs.select(F.col("text").cast("string").alias("text"), row_hash(docs).alias("key"))
    keys = keyed.select("key").orderBy("key").limit(DICTIONARY_DOCS).agg(F.max("key")).first()[0]
    if keys is None:
        return b""
    place = F.pmod(F.xxhash64("key"), F.greatest(F.length("text") - DICTIONARY_SAMPLE, F.lit(0)) + 1) + 1
    picked = keyed.where((F.col("key") <= keys) & F.col("text").isNotNull()).select(F.substring("text", place.cast("int"), F.lit(DICTIONARY_SAMPLE)).alias("text")).limit(DICTIONARY_DOCS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = encoder_of(encoder)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(list(words.encode(_strings(batch, 0))), pa.binary())], ["ids"])

    samples = sorted(bytes(r["ids"]) for r in picked.mapInArrow(run, "ids binary").collect())
    samples = [s + struct.pack("<I", end_id) for s in samples if s]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    if len(samples) >= 8 and size >= 1024:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-DICTIONARY_BYTES:]


def _codec(dictionary: bytes, make: Callable):
    if not dictionary:
        return make()
    trained = dictionary.startswith(b"\x37\xa4\x30\xec")
    loaded = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    if make is zstandard.ZstdCompressor:
        loaded.precompute_compress(level=LEVEL)  # else each document would load the dictionary anew
    return make(dict_data=loaded)


def shard_count(docs: DataFrame) -> int:
    """Shards for about ``SHARD_BYTES`` of text each, and at least as many as there are shuffle partitions."""
    size = docs.select(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long") + 64).alias("size")).first()["size"]
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // SHARD_BYTES), 1)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into shard files under ``folder``; returns the manifest.

    The manifest has a row per shard: shard, file, n_docs, n_ids, n_bytes. A null text is empty; a
    document without ids holds only ``end_id``; rows with the same doc_id are documents of their
    own, in the order of a hash of the row; a null doc_id comes first; an empty table gives no
    shard. Ids are those of the tokenizers library without special tokens, then ``end_id``. A text
    of any length is encoded whole, as one frame.
    """
    path = tokenizer or tokenizer_path()
    dictionary = trained_dictionary(docs, path, end_id)
    digest = hashlib.sha256(dictionary).digest()
    fs, at = _open(folder)
    fs.create_dir(at, recursive=True)
    with fs.open_output_stream(f"{at}/{digest.hex()}.zdict") as f:
        f.write(dictionary)
    # wholly equal rows give equal frames, so their order is free and they can be dealt to several shards
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie"), F.col("copy")]
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"), row_hash(docs).alias("tie"), F.monotonically_increasing_id().alias("copy"))
    rows = rows.repartitionByRange(shards or shard_count(docs), *order).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, end = encoder_of(path), _codec(dictionary, zstandard.ZstdCompressor), struct.pack("<I", end_id)
        shard = TaskContext.get().partitionId()
        name = f"shard-{shard:06d}-{uuid.uuid4().hex}.qtok"
        index, keys, offset, n_ids, n_docs, out = [], [], struct.calcsize(HEADER), 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                fs, at = _open(folder)
                out = fs.open_output_stream(f"{at}/{name}", buffer_size=BUFFER)
                out.write(struct.pack(HEADER, MAGIC, digest, 4))
            entries = np.zeros(batch.num_rows, ENTRY)
            for k, ids in enumerate(words.encode(_strings(batch, 1))):
                frame = packer.compress(ids + end)
                out.write(frame)
                entries[k] = (offset, len(frame), len(ids) // 4 + 1)
                offset += len(frame)
            n_ids += int(entries["ids"].sum(dtype=np.int64))
            n_docs += batch.num_rows
            index.append(entries.tobytes())
            keys.append(batch.column(0))
        if out is None:
            return
        sink = pa.BufferOutputStream()
        table = pa.table({"doc_id": pa.chunked_array(keys)})
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        out.write(b"".join(index))
        out.write(zstandard.ZstdCompressor().compress(sink.getvalue().to_pybytes()))
        out.write(struct.pack(FOOTER, offset, n_docs, MAGIC))
        size = out.tell()
        out.close()
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{folder}/{name}"]), *[pa.array([x], pa.int64()) for x in (n_docs, n_ids, size)]], ["shard", "file", "n_docs", "n_ids", "n_bytes"])

    manifest = rows.mapInArrow(run, "shard int, file string, n_docs bigint, n_ids bigint, n_bytes bigint")
    return written(manifest, "token-manifest")


class Shard:
    """Random access to one shard file."""

    def __init__(self, uri: str):
        fs, at = _open(uri)
        self._file = fs.open_input_file(at)
        size = self._file.size()
        magic, digest, _ = struct.unpack(HEADER, self._file.read_at(struct.calcsize(HEADER), 0))
        index_at, count, again = struct.unpack(FOOTER, self._file.read_at(struct.calcsize(FOOTER), size - struct.calcsize(FOOTER)))
        if magic != MAGIC or again != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        with fs.open_input_stream(f"{at.rsplit('/', 1)[0]}/{digest.hex()}.zdict") as f:
            dictionary = f.read()
        if hashlib.sha256(dictionary).digest() != digest:
            raise ValueError(f"{uri} was written with another dictionary")
        self._unpack = _codec(dictionary, zstandard.ZstdDecompressor)
        rest = self._file.read_at(size - struct.calcsize(FOOTER) - index_at, index_at)
        self.index = np.frombuffer(rest[: count * ENTRY.itemsize], ENTRY)
        with pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(rest[count * ENTRY.itemsize :])) as reader:
            self.doc_ids = reader.read_all().column(0)

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, row: int) -> np.ndarray:
        """The ids of the document in that row, read and decompressed alone."""
        entry = self.index[row]
        frame = self._file.read_at(int(entry["length"]), int(entry["at"]))
        ids = np.frombuffer(self._unpack.decompress(frame), "<u4")
        if len(ids) != entry["ids"]:
            raise ValueError("a frame's length differs from the index")
        return ids

    def ranges(self, most: int = READ_BYTES, rows: int = 4096) -> Iterator[tuple[range, list[np.ndarray]]]:
        """All documents in turn: rows of the index and their ids, ``most`` bytes of frames (one at least) per read."""
        ends = (self.index["at"] + self.index["length"]).astype(np.int64)
        at = 0
        while at < len(self):
            first = int(self.index["at"][at])
            last = max(at + 1, min(int(np.searchsorted(ends, first + most, side="right")), at + rows))
            data = memoryview(self._file.read_at(int(ends[last - 1]) - first, first))
            found = []
            for entry in self.index[at:last]:
                begin = int(entry["at"]) - first
                found.append(np.frombuffer(self._unpack.decompress(data[begin : begin + int(entry["length"])]), "<u4"))
                if len(found[-1]) != entry["ids"]:
                    raise ValueError("a frame's length differs from the index")
            yield range(at, last), found
            at = last

    def close(self) -> None:
        self._file.close()


def read_tokens(manifest: DataFrame, doc_id_type: str, with_ids: bool = False) -> DataFrame:
    """Reads the shards of a manifest back: doc_id, start, n_tokens, ids_crc32 (and the ids).

    ``start`` is the number of ids of all documents before it in ascending doc_id order, from a
    running sum over the manifest's rows. Each shard is read by one task, in ranges of frames.
    """
    first = F.sum("n_ids").over(Window.orderBy("shard")) - F.col("n_ids")
    shards = manifest.select("file", first.alias("first"))
    n = max(1, manifest.count())
    shards = shards.repartition(n, "file")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = Shard(uri)
                for rows, ids in shard.ranges():
                    counts = np.array([len(x) for x in ids], np.int64)
                    starts = start + np.cumsum(counts) - counts
                    start += int(counts.sum())
                    keys = shard.doc_ids.slice(rows.start, len(rows)).combine_chunks()
                    columns = [keys, pa.array(starts), pa.array(counts), pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64())]
                    if with_ids:
                        columns.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])
                shard.close()

    return shards.mapInArrow(run, f"doc_id {doc_id_type}, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def token_digests(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, shards: int | None = None) -> DataFrame:
    """Writes ``docs`` as token shards in the shared folder and reads every document back."""
    spark: SparkSession = docs.sparkSession
    folder = shared_path(spark, "tokens")
    manifest = write_tokens(docs, folder, tokenizer, end_id, shards)
    return read_tokens(manifest, docs.schema["doc_id"].dataType.simpleString())
