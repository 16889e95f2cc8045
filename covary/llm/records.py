"""Token ids in length-delimited binary record files with an offset index."""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from covary.llm._common import col, saved, scratch_path, ship
from covary.llm.bpe import LONG_UNIT, PUNCTUATION, blocks, byte_characters, forget, texts_of

# The Castagnoli polynomial (reflected) and the mask that keeps
# a stored checksum from being taken for data.
CASTAGNOLI = 0x82F63B78
MASK = 0xA282EAD8

#: Bytes of a chunk in the side-by-side checksum.
CHUNK = 1024
CACHE_UNITS = 500_000
#: Header of a payload: 1 if the id is null, then the id.
HEAD = struct.Struct("<Bq")

_LIBRARY: dict = {}


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The checksum of each byte, and for each byte of a checksum what CHUNK
    zero bytes make of it."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(CASTAGNOLI), t >> 1).astype(np.uint32)
    shift = np.array([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    for _ in range(CHUNK):
        shift = t[shift & 0xFF] ^ (shift >> np.uint32(8))
    return t, shift


CRC, SHIFT = _tables()
CRC_LIST = CRC.tolist()


def masked_crcs(items: list[bytes]) -> np.ndarray:
    """Masked CRC-32C of each item (of four bytes or more). The items are cut
    into chunks that advance side by side; leading zeros do not change a
    checksum that starts at zero, so the first chunk of an item is padded."""
    if not items:
        return np.empty(0, np.uint32)
    size = np.array([len(x) for x in items])
    parts = -(-size // CHUNK)
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    buf = np.zeros(int(parts.sum()) * CHUNK, dtype=np.uint8)
    for x, n, k, f in zip(items, size.tolist(), parts.tolist(), first.tolist()):
        at = (f + k) * CHUNK - n
        buf[at:at + n] = np.frombuffer(x, np.uint8)
        buf[at:at + 4] ^= 0xFF  # the checksum starts with all bits set
    lanes = np.ascontiguousarray(buf.reshape(-1, CHUNK).T[-int(size.max()):])  # short items: no empty rounds
    crc = np.zeros(lanes.shape[1], dtype=np.uint32)
    for row in lanes:
        crc = CRC[(crc ^ row) & 0xFF] ^ (crc >> np.uint32(8))
    out = crc[first]
    for k in range(1, int(parts.max())):
        on = np.flatnonzero(parts > k)
        c = out[on]
        out[on] = (SHIFT[0][c & 0xFF] ^ SHIFT[1][(c >> 8) & 0xFF] ^ SHIFT[2][(c >> 16) & 0xFF]
                   ^ SHIFT[3][c >> 24] ^ crc[first[on] + k])
    out = ~out
    return ((out >> np.uint32(15)) | (out << np.uint32(17))) + np.uint32(MASK)


def masked_crc(item: bytes) -> int:
    """The same for one short item."""
    crc = 0xFFFFFFFF
    for b in item:
        crc = CRC_LIST[(crc ^ b) & 0xFF] ^ (crc >> 8)
    crc ^= 0xFFFFFFFF
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payloads: list[bytes]) -> list[bytes]:
    """Records: length (8 bytes), masked checksum of the length, payload,
    masked checksum of the payload; all little-endian."""
    heads = [struct.pack("<Q", len(p)) for p in payloads]
    return [b"".join((h, struct.pack("<I", a), p, struct.pack("<I", b)))
            for h, a, p, b in zip(heads, masked_crcs(heads).tolist(), payloads, masked_crcs(payloads).tolist())]


class DamagedRecord(ValueError):
    """A record whose length or payload does not match its checksum."""


def unframe(stream, most: int = 8_000_000) -> Iterator[list[bytes]]:
    """The payloads of a record file in lists of about ``most`` bytes."""
    payloads, sums, held = [], [], 0

    def checked():
        if (masked_crcs(payloads) != sums).any():
            raise DamagedRecord("checksum mismatch")
        return payloads

    while True:
        head = stream.read(12)
        if head:
            if len(head) < 12:
                raise DamagedRecord("cut-off length")
            n, a = struct.unpack("<QI", head)
            if masked_crc(head[:8]) != a:
                raise DamagedRecord("length mismatch")
            body = stream.read(n + 4)
            if len(body) < n + 4:
                raise DamagedRecord("cut-off payload")
            payloads.append(body[:n])
            sums.append(struct.unpack("<I", body[n:])[0])
            held += n
        if payloads and (held >= most or not head):
            yield checked()
            payloads, sums, held = [], [], 0
        if not head:
            return


# Pre-tokens of lower-case ASCII text: a fixed pattern of the vocabulary file.
ASCII_WORDS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\t\n\x0b\x0c\r a-z0-9]+")


LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch


class Known(dict):
    """What a function gave for each key; a key that is new is asked for when
    it is looked up, and listed in ``fresh``."""

    def __init__(self, ask):
        super().__init__()
        self.ask, self.fresh = ask, []

    def __missing__(self, key):
        got = self[key] = self.ask(key)
        self.fresh.append(key)
        return got


class LibraryIds:
    """Ids of whole texts by the ``tokenizers`` library. Texts are cut at
    single spaces, at which this vocabulary's pre-tokenizer always cuts and
    which it drops; the library's model sees each distinct word once."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.type = "<u2" if self.library.get_vocab_size() <= 65536 else "<u4"
        self.code = "H" if self.type == "<u2" else "I"
        self.stand_in = {b: c for c, b in byte_characters().items() if ord(c) != b}
        self.memo = Known(self.piece_ids)
        self.words: dict[str, bytes] = {}
        self.latin: dict[str, bytes] = {}

    def pack(self, ids) -> bytes:
        a = array(self.code, ids)
        if sys.byteorder == "big":
            a.byteswap()
        return a.tobytes()

    def word_ids(self, word: str) -> bytes:
        """The ids of a pre-token, given in the stand-in characters."""
        ids = self.words.get(word)
        if ids is None:
            if len(self.words) >= CACHE_UNITS:
                self.words.clear()
            ids = self.pack([t.id for t in self.model.tokenize(word)])
            if len(word) <= LONG_UNIT:
                self.words[word] = ids
        return ids

    def piece_ids(self, piece: str) -> bytes:
        word = piece.rstrip(PUNCTUATION)
        ids = self.latin.get(word)
        if ids is None and LATIN(word):  # letters, and punctuation that ends them
            low = word.lower()
            if not low.isascii():
                low = low.encode().decode("latin-1").translate(self.stand_in)
            ids = self.pack([t.id for t in self.model.tokenize(low)])
            if len(self.latin) < CACHE_UNITS and len(word) <= LONG_UNIT:
                self.latin[word] = ids
        if ids is not None:
            return ids + self.word_ids(piece[len(word):]) if len(word) < len(piece) else ids
        if any(s in piece for s in self.special):
            return self.pack(self.library.encode(piece, add_special_tokens=False).ids)
        if piece.isascii():
            words = ASCII_WORDS.findall(piece.lower())
            if not piece.isprintable():
                words = [w.translate(self.stand_in) for w in words]
        else:
            words = [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(
                self.library.normalizer.normalize_str(piece))]
        return b"".join(map(self.word_ids, words))

    def __call__(self, texts: list[str]) -> list[bytes]:
        spaced = [s for s in self.special if " " in s]
        memo = self.memo
        known, out = memo.__getitem__, []
        for t in texts:
            out.append(b"".join(map(known, [t] if spaced and any(s in t for s in spaced) else t.split(" "))))
        new, memo.fresh = memo.fresh, []
        forget(memo, new, CACHE_UNITS)
        return out


def library(path: str) -> LibraryIds:
    if path not in _LIBRARY:
        _LIBRARY[path] = LibraryIds(path)
    return _LIBRARY[path]


def _open(path: str, write: bool):
    from pyarrow import fs
    # Hadoop writes local paths with one slash
    store, at = fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", path))
    if write:
        store.create_dir(at.rsplit("/", 1)[0])
        return store.open_output_stream(at)
    return store.open_input_file(at)


def write_records(docs: DataFrame, folder: str, path: str, id_col: str = "doc_id", text_col: str = "text",
                  end_id: int = 2, shards: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id`` and write the sequences to record
    files under ``folder`` in ascending order of id (null ids first). Returns
    the offset index, a saved table: ``shard, file, offset, length, id,
    n_tokens``.

    The ids are cut into ``shards`` ranges (default: the session's shuffle
    partitions); shard k holds smaller ids than shard k + 1. Each attempt of a
    task writes a file of its own, and the index names the files of the
    attempts that succeeded, so a lost or repeated task leaves no wrong row.
    Null and empty texts give the end id alone; rows that repeat an id are all
    written; an empty table gives an empty index. ``folder`` must be a shared
    store that pyarrow knows (``file:``, ``hdfs:``, ``s3:``, ``gs:``).
    """
    spark = docs.sparkSession
    ship(spark)
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = (docs.select(col(id_col).cast("long").alias("id"), col(text_col).cast("string").alias("text"))
            .repartitionByRange(shards, F.col("id").asc_nulls_first())
            .sortWithinPartitions(F.col("id").asc_nulls_first()))

    def run(batches):
        lib = library(path)
        end = np.array([end_id], dtype=lib.type).tobytes()
        width, shard, out, file, offset = len(end), TaskContext.get().partitionId(), None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if out is None:
                file = f"{folder.rstrip('/')}/shard-{shard:06d}-{uuid.uuid4().hex[:8]}.rec"
                out = _open(file, True)
            ids, codes = batch.column(0).to_pylist(), []
            for some in blocks(texts_of(batch, 1)):
                codes += lib(some)
            index, step = [], 2048
            for lo in range(0, len(ids), step):
                got = list(zip(ids[lo:lo + step], codes[lo:lo + step]))
                for (i, code), rec in zip(got, frame([payload(i, c + end) for i, c in got])):
                    out.write(rec)
                    index.append((shard, file, offset, len(rec), i, len(code) // width + 1))
                    offset += len(rec)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, type=t) for v, t in zip(zip(*index), kinds)], names=names)
        if out is not None:
            out.close()

    names = ["shard", "file", "offset", "length", "id", "n_tokens"]
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return saved(rows.mapInArrow(
        run, "shard int, file string, offset long, length long, id long, n_tokens long"), "record-index")


def payload(i: int | None, code: bytes) -> bytes:
    return HEAD.pack(i is None, i or 0) + code


def parse(payload: bytes, kind: str) -> tuple[int | None, np.ndarray]:
    null, i = HEAD.unpack_from(payload)
    return (None if null else i), np.frombuffer(payload, kind, offset=HEAD.size)


def id_type(path: str) -> str:
    """How the ids of this vocabulary are stored."""
    return library(path).type


def read_records(index: DataFrame, path: str) -> DataFrame:
    """Read all record files of an index in order: ``id, start, n_tokens,
    ids_crc32``, where ``start`` is the number of ids before the document.

    A task reads whole shards front to back, verifying both checksums of every
    record. The only global step is a running sum over one row per shard. Ids
    come back as they were written, null and repeated ones too; an empty index
    gives no rows, and a damaged or cut file raises :class:`DamagedRecord`.
    """
    files = index.groupBy("shard", "file").agg(F.sum("n_tokens").alias("n"))
    first = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("shard", "file", F.coalesce(first, F.lit(0)).alias("start"))  # one row per shard
    shards = max(1, int(index.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kind = id_type(path)

    def run(batches):
        for batch in batches:
            for file, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                with _open(file, False) as stream:
                    for payloads in unframe(stream):
                        out = []
                        for p in payloads:
                            i, ids = parse(p, kind)
                            out.append((i, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(v, type=pa.int64()) for v in zip(*out)],
                                                         names=["id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(shards, "shard").mapInArrow(
        run, "id long, start long, n_tokens long, ids_crc32 long")


def read_at(index: DataFrame, path: str) -> DataFrame:
    """Random access: the ``id`` and ``ids`` of any rows of an index, in any
    order, each by its own offset (for shuffled reads). A row of the index
    that is asked twice is read twice; null and repeated ids come back as they
    were written; no rows asked, none read."""
    kind = id_type(path)

    def run(batches):
        for batch in batches:
            got = batch.to_pydict()
            out, open_files = [], {}
            for file, offset, length in zip(got["file"], got["offset"], got["length"]):
                stream = open_files.get(file) or open_files.setdefault(file, _open(file, False))
                stream.seek(offset)
                payload, = next(unframe(pa.BufferReader(stream.read(length))))
                i, ids = parse(payload, kind)
                out.append((i, ids.tolist()))
            for stream in open_files.values():
                stream.close()
            ids, seqs = zip(*out) if out else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()),
                                              pa.array(seqs, type=pa.list_(pa.int32()))], names=["id", "ids"])

    return index.select("file", "offset", "length").mapInArrow(run, "id long, ids array<int>")


def record_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = 2) -> DataFrame:
    """Write the record files of ``docs`` to the shared folder and read them
    back: ``id_col, start, n_tokens, ids_crc32`` (see :func:`write_records`)."""
    folder = scratch_path(docs.sparkSession, "records")
    index = write_records(docs, folder, path, id_col, text_col, end_id)
    return read_records(index, path).select(F.col("id").alias(id_col), "start", "n_tokens", "ids_crc32")
