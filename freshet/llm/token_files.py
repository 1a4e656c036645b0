"""Token ids as binary files: fixed-size blocks of ids, transposed into planes, each plane compressed.

A file is a sequence of records, every one followed by ``MARK``, so that Spark's text source finds them wherever it splits a file and
Spark's text sink can write them to any store. A block record holds ``block_ids`` ids (the last one of a file fewer) as byte or bit planes, and
identifiers and places of the documents that begin in it. The last record of a file is its chunk index: place, length, ids and
documents of every block. ``write_tokens`` collects these indexes next to the files, so that readers can go to a block without a scan.
"""

from __future__ import annotations

import json
import os
import re
import struct
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from freshet.llm.bpe import byte_alphabet
from freshet.llm.common import NO_ID, doc_key, slices
from freshet.llm.packed import bundle, unbundle
from freshet.session import settled

BLOCK_IDS = 1 << 16
# ids of a file, about, once there is enough for every core of the cluster; no file is planned below LEAST_IDS
FILE_IDS, LEAST_IDS = 1 << 24, 1 << 19
LEVEL = 3
MARK = "\n:end-of-token-record:\n"
_MARK = MARK.encode()
_BLOCK, _INDEX = b"TB1", b"TI1"
# kind, planes, mask; file, block, first id of the file, ids, first document of the file, documents, length of the document part
_HEAD = struct.Struct("<3sBB7q")
_MASKED_FROM = 5
# words that a worker remembers, about, and the longest of them
KNOWN_WORDS, KNOWN_LENGTH = 1_000_000, 64
# Fixed value: how the tokenizer that WordEncoder knows best cuts a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# letters of ASCII and the Latin-1 block, which normalisation leaves alone but for their case, and marks behind them
LATIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([.,;:!?()]*)")
SLICE_BYTES = 1 << 20
# ids that fetch_ids returns at most: it is for a look at some, not for reading a corpus
FETCH_IDS = 1 << 22


class WordEncoder:
    """A tokenizer of the ``tokenizers`` library that drops white space: every distinct word is encoded once and remembered.

    A word of Latin letters, perhaps with marks behind it, is one or two pieces for a tokenizer that lower-cases and parts letters
    from marks; these go straight to its model. All other words take the library's whole way.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # blanks around and between words must neither leave a trace nor join what they part
        if self._whole(["a\n b\tc "])[0] != b"".join(self._whole(["a", "b", "c"])):
            raise ValueError("not a tokenizer that drops white space")
        self.direct = self._is_direct(path)
        self.bytes = {b: c for b, c in enumerate(byte_alphabet())}
        self.known: dict[bytes, bytes] = {}

    @staticmethod
    def _is_direct(path: str) -> bool:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = [[x["type"] for x in (spec.get(k) or {}).get(v, [])] for k, v in (("normalizer", "normalizers"), ("pre_tokenizer", "pretokenizers"))]
        pattern = (spec["pre_tokenizer"]["pretokenizers"][0].get("pattern") or {}).get("Regex") if steps[1] else None
        return steps == [["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]] and pattern == PIECES and spec["model"].get("dropout") is None

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        texts, out, rest = [w.decode() for w in words], {}, []
        tokens = self.tokenizer.model.tokenize
        for word, text in zip(words, texts):
            found = LATIN.fullmatch(text) if self.direct and len(word) <= KNOWN_LENGTH else None
            if found is None:
                rest.append((word, text))
                continue
            letters, marks = found.group(1).lower(), found.group(2)
            if not letters.isascii():
                letters = letters.encode().decode("latin-1").translate(self.bytes)
            ids = [x.id for x in tokens(letters)]
            if marks:
                ids += [x.id for x in tokens(marks)]
            out[word] = array("I", ids).tobytes()
        out.update(zip([w for w, _ in rest], self._whole([x for _, x in rest])))
        self.known.update((w, i) for w, i in out.items() if len(w) <= KNOWN_LENGTH)
        return out

    def encode(self, texts: Iterable[str]) -> list[bytes]:
        """The ids of every text as little-endian unsigned 32-bit integers."""
        if len(self.known) > KNOWN_WORDS:
            self.known.clear()
        known, out = self.known, []
        for text in texts:
            # white space of ASCII parts words in every such tokenizer; all else is left to the library
            words = text.encode().split()
            ids = list(map(known.get, words))
            if None in ids:
                fresh = self._learn(list({w for w, i in zip(words, ids) if i is None}))
                ids = [fresh[w] if i is None else i for w, i in zip(words, ids)]
            out.append(b"".join(ids))
        return out


@lru_cache(maxsize=2)
def load(path: str) -> WordEncoder:
    return WordEncoder(path)


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """Ids transposed: 4 planes of one byte of every id, or 32 of one bit; a plane of zeros is empty."""
    parts = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "bits":
        rows = np.packbits(np.unpackbits(parts, axis=1, bitorder="little").T, axis=1)
    else:
        rows = parts.T
    return [np.ascontiguousarray(p).tobytes() if p.any() else b"" for p in rows]


def from_planes(rows: list[bytes], n: int, planes: str) -> np.ndarray:
    size = (n + 7) // 8 if planes == "bits" else n
    out = np.zeros((len(rows), size), np.uint8)
    for at, p in enumerate(rows):
        if p:
            out[at] = np.frombuffer(p, np.uint8)
    if planes == "bits":
        out = np.packbits(np.unpackbits(out, axis=1, count=n).T, axis=1, bitorder="little")
    else:
        out = out.T
    return np.ascontiguousarray(out).view("<u4").ravel()


def _sealed(head: tuple, body: bytes) -> bytes:
    """A record; its bytes after the mask are masked so that ``MARK`` does not occur in it."""
    for mask in range(256):
        record = bytearray(_HEAD.pack(head[0], head[1], mask, *head[2:]) + body)
        if mask:
            record[_MASKED_FROM:] = (np.frombuffer(record, np.uint8)[_MASKED_FROM:] ^ mask).tobytes()
        # the mark's first bytes could also be completed by the mark that follows
        if (bytes(record) + _MARK).find(_MARK) == len(record):
            return bytes(record)
    raise ValueError("no mask hides the mark")


def _opened(record: bytes) -> tuple[tuple, bytes]:
    mask = record[4]
    if mask:
        record = record[:_MASKED_FROM] + (np.frombuffer(record, np.uint8)[_MASKED_FROM:] ^ mask).tobytes()
    head = _HEAD.unpack_from(record)
    return head, record[_HEAD.size :]


def block_record(file: int, block: int, first: int, ids: np.ndarray, first_doc: int, docs: np.ndarray, places: np.ndarray, planes: str) -> bytes:
    pack = zstandard.ZstdCompressor(level=LEVEL).compress
    rows = [pack(p) if p else b"" for p in to_planes(ids, planes)]
    about = bundle(docs=docs, places=places)
    body = struct.pack(f"<{len(rows)}q", *map(len, rows)) + about + b"".join(rows)
    return _sealed((_BLOCK, len(rows), file, block, first, len(ids), first_doc, len(docs), len(about)), body)


def open_block(record: bytes) -> tuple[tuple[int, ...], np.ndarray, np.ndarray, np.ndarray]:
    """(file, block, first id, ids, first document), the ids, and identifiers and places of the documents that begin here."""
    head, body = _opened(record)
    if head[0] != _BLOCK or len(body) < 8 * head[1]:
        raise ValueError("not a block of token ids")
    _, n_planes, _, file, block, first, n, first_doc, n_docs, about = head
    sizes = struct.unpack_from(f"<{n_planes}q", body)
    at = 8 * n_planes + about
    if len(body) != at + sum(sizes):
        raise ValueError(f"block {block} of file {file} is damaged")
    docs, places = unbundle(body[8 * n_planes : at], 2)
    unpack = zstandard.ZstdDecompressor().decompress
    rows = []
    for size in sizes:
        rows.append(unpack(body[at : at + size]) if size else b"")
        at += size
    return (file, block, first, n, first_doc), from_planes(rows, n, "bits" if n_planes == 32 else "bytes"), docs, places


def _encode(batches: Iterator[pa.RecordBatch], path: str, end: int | None) -> Iterator[pa.RecordBatch]:
    encoder, pack = load(path), zstandard.ZstdCompressor(level=1).compress
    last = b"" if end is None else struct.pack("<I", end)
    for batch in batches:
        for part in slices(batch, "text", SLICE_BYTES):
            ids = [x + last for x in encoder.encode([x.as_py() or "" for x in part.column("text")])]
            arrays = [part.column("k"), part.column("t"), pa.array([len(x) // 4 for x in ids], pa.int64())]
            # two planes of bytes are zeros for most vocabularies and cost nothing
            z = [pack(np.frombuffer(x, np.uint8).reshape(-1, 4).T.tobytes()) for x in ids]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(z, pa.binary())], ["k", "t", "n", "z"])


def _pack(batches: Iterator[pa.RecordBatch], block_ids: int, planes: str) -> Iterator[pa.RecordBatch]:
    """The records of one file, from its documents in order; never more than a block and an Arrow batch is held."""
    file, unpack = TaskContext.get().partitionId(), zstandard.ZstdDecompressor().decompress
    held, docs, places = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    block = first = first_doc = offset = 0
    index: list[tuple[int, int, int, int, int, int]] = []

    def record(n: int, end: bool = False) -> pa.RecordBatch:
        nonlocal held, docs, places, block, first, first_doc, offset
        here = len(docs) if end else int(np.searchsorted(places, n))
        value = block_record(file, block, first, held[:n], first_doc, docs[:here], places[:here], planes)
        index.append((offset, len(value), first, n, first_doc, here))
        held, docs, places = held[n:], docs[here:], places[here:] - n
        block, first, first_doc, offset = block + 1, first + n, first_doc + here, offset + len(value) + len(_MARK)
        return pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])

    for batch in batches:
        for part in slices(batch, "z", SLICE_BYTES):
            some = [np.frombuffer(unpack(z.as_py()), np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() if n else held[:0]
                    for z, n in zip(part.column("z"), part.column("n").to_pylist())]
            size = part.column("n").to_numpy()
            docs = np.concatenate([docs, part.column("k").to_numpy()])
            places = np.concatenate([places, len(held) + np.cumsum(size) - size])
            held = np.concatenate([held, *some])
            while len(held) > block_ids:
                yield record(block_ids)
    if len(docs) or len(held):
        yield record(len(held), end=True)
    if index:
        columns = dict(zip(("offset", "length", "first", "n_ids", "first_doc", "n_docs"), np.array(index, np.int64).T))
        value = _sealed((_INDEX, 0, file, block, 0, first, 0, first_doc, 0), bundle(**columns))
        yield pa.RecordBatch.from_arrays([pa.array([value], pa.binary())], ["value"])


INDEX = "file long, block long, offset long, length long, first_id long, n_ids long, first_doc long, n_docs long"


def _index_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for value in batch.column("value"):
            head, body = _opened(value.as_py())
            columns = unbundle(body, 6)
            n = len(columns[0])
            if n != head[4]:
                raise ValueError(f"chunk index of file {head[3]} is damaged")
            arrays = [np.full(n, head[3]), np.arange(n), *columns]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()) for a in arrays], [c.split()[0] for c in INDEX.split(", ")])


def _records(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", MARK).text(f"{path.rstrip('/')}/data")


def _whole(df: DataFrame, kind: bytes) -> DataFrame:
    return df.where(F.col("value").startswith(kind.decode())).select(F.col("value").cast("binary").alias("value"))


def files_for(spark: SparkSession, ids: int, file_ids: int = FILE_IDS, least_ids: int = LEAST_IDS) -> int:
    """Files of about ``file_ids`` ids, or smaller ones as long as the cluster has more cores than there are files."""
    return max(1, -(-ids // file_ids), min(3 * spark.sparkContext.defaultParallelism, ids // least_ids))


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end: int | None = 1,
    block_ids: int = BLOCK_IDS,
    planes: str = "bytes",
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Encode every text, append ``end`` to it, and write the ids below ``path`` in ascending order of identifiers; returns the chunk index.

    ``tokenizer`` names the tokenizer's file on every executor. A null text is empty: its document has the end id only (nothing
    if ``end`` is None). Null identifiers come last; rows that repeat an identifier are documents of their own, ordered by a hash of
    their texts. Other columns are left out. An empty table gives no files and an empty index. ``path`` must not exist.
    """
    if planes not in ("bytes", "bits"):
        raise ValueError(f"planes are bytes or bits, not {planes!r}")
    spark = docs.sparkSession
    k, t = doc_key(id_col, text_col)
    read = docs.select(k.alias("k"), t.alias("t"), F.col(text_col).alias("text"))
    encoded = read.mapInArrow(lambda part: _encode(part, tokenizer, end), "k long, t long, n long, z binary")
    # stored before it is sampled for ranges, so that texts are encoded once; r parts rows that are equal otherwise
    encoded = settled(encoded.withColumn("r", F.monotonically_increasing_id()), "token-ids")
    total = encoded.agg(F.sum("n")).first()[0] or 0
    order = ["k", "t", "r"]
    ranged = encoded.repartitionByRange(files_for(spark, total, file_ids), *order).sortWithinPartitions(*order)
    records = ranged.mapInArrow(lambda part: _pack(part, block_ids, planes), "value binary")
    records.select(F.col("value").cast("string").alias("value")).write.option("lineSep", MARK).text(f"{path.rstrip('/')}/data")
    index = _whole(_records(spark, path), _INDEX).mapInArrow(_index_rows, INDEX)
    index.write.parquet(f"{path.rstrip('/')}/index")
    return read_index(spark, path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per block; ``first_id`` and ``first_doc`` count from the start of its file, ``base`` is the file's place among all ids."""
    index = spark.read.schema(INDEX).parquet(f"{path.rstrip('/')}/index")
    return index.join(_bases(index), "file", "left")


def _bases(index: DataFrame) -> DataFrame:
    """file, base: ids of all files before. One row per file goes through one task: a row for FILE_IDS ids."""
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return index.groupBy("file").agg(F.sum("n_ids").alias("_n")).select("file", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("base"))


PIECE = "file long, doc long, id long, start long, block long, whole boolean, ids binary"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per document and block; one that surely lies in this block alone is whole."""
    names = [c.split()[0] for c in PIECE.split(", ")]
    for batch in batches:
        for value in batch.column("value"):
            (file, block, first, n, first_doc), ids, docs, places = open_block(value.as_py())
            open_start = not len(places) or places[0] > 0
            starts = np.concatenate([[0], places]) if open_start else places
            ends = np.append(starts[1:], n)
            doc = first_doc + np.arange(len(starts)) - open_start
            ident = np.concatenate([[0], docs]) if open_start else docs
            missing = np.arange(len(starts)) < open_start
            # the block's last document may go on in the next block
            whole = ~missing & (np.arange(len(starts)) < len(starts) - 1)
            data = np.ascontiguousarray(ids, "<u4")
            offsets = pa.array(np.append(starts, n) * 4, pa.int64())
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, offsets.buffers()[1], pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(starts), file)), pa.array(doc), pa.array(ident, mask=missing), pa.array(first + starts), pa.array(np.full(len(starts), block)), pa.array(whole), packed],
                names,
            )


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: id, start (ids of all documents before it), n_tokens and ids (little-endian unsigned 32-bit integers).

    Blocks are read one by one wherever they lie; only documents at the edges of blocks, two per block, are shuffled and put together.
    A damaged block is an error. Files without documents have no blocks.
    """
    pieces = _whole(_records(spark, path), _BLOCK).mapInArrow(_pieces, PIECE)
    parts = F.transform(F.array_sort(F.collect_list(F.struct("block", "ids"))), lambda p: p["ids"])
    joined = F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b))
    cut = pieces.where("NOT whole").groupBy("file", "doc").agg(F.max("id").alias("id"), F.min("start").alias("start"), joined.alias("ids"))
    rows = pieces.where("whole").select("file", "id", "start", "ids").union(cut.select("file", "id", "start", "ids"))
    bases = _bases(spark.read.schema(INDEX).parquet(f"{path.rstrip('/')}/index"))
    ident = F.when(F.col("id") != NO_ID, F.col("id"))
    return rows.join(bases, "file").select(ident.alias("id"), (F.col("base") + F.col("start")).alias("start"), (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids")


def fetch_ids(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of all, by seeking the blocks that the chunk index names; for a few blocks at a time."""
    if not 0 <= start <= stop or stop - start > FETCH_IDS:
        raise ValueError(f"at most {FETCH_IDS} ids, from 0 on")
    at = F.col("base") + F.col("first_id")
    wanted = read_index(spark, path).where((at < stop) & (at + F.col("n_ids") > start)).select("file", "offset", "length", at.alias("at")).orderBy("at").collect()
    jvm, out = spark._jvm, [np.zeros(0, np.uint32)]
    for row in wanted:
        pattern = jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/data/part-{row['file']:05d}-*")
        fs = pattern.getFileSystem(spark._jsc.hadoopConfiguration())
        stream = fs.open(fs.globStatus(pattern)[0].getPath())
        try:
            stream.seek(row["offset"])
            ids = open_block(bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, int(row["length"]))))[1]
        finally:
            stream.close()
        out.append(ids[max(start - row["at"], 0) : stop - row["at"]])
    return np.concatenate(out)
