"""Operator 6: token ids as frequency-ranked, byte-aligned variable-length blocks.

An id is stored as its rank by corpus frequency (0 is the most frequent), in one to four bytes. A separate control byte
holds the lengths of four ranks, two bits each, so decoding looks up lengths in a table of 256 rows and gathers bytes:
no branch and no Python loop. A block is a self-contained byte string:

    b"VXT1" | documents u32 | tokens u64 | null doc_id flags u8[documents] | doc_ids i64[documents]
    | lengths: control bytes, data bytes | ranks: control bytes, data bytes         (numbers little-endian)

Blocks are the rows of a Parquet table (shard, block, before, data) beside a rank table; ``shard`` follows doc_id order,
``before`` counts the tokens before the block in its shard. Any file system that Spark writes to can hold it.

Edge cases: a null or empty text is the end id alone; documents with equal doc_id keep an order by their ids' bytes; null
doc_ids come first; a special token that is written out in a text (``<|endoftext|>``) is that token, as in the library's
plain settings; texts of any length are encoded whole, at a cost in proportion to their length.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import Shared, discard, map_arrow, shared_dir, slices, small_batches, stage, to_batch

END = 0
#: Ids in one block, about.
BLOCK_TOKENS = 1 << 20
MAGIC = b"VXT1"

_LENGTHS = (((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3) + 1).astype(np.uint8)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, "<u4")
    size = 1 + (values > 0xFF) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = size - 1
    control = (code.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    cells = values.view(np.uint8).reshape(-1, 4)
    return control.tobytes(), cells[np.arange(4) < size[:, None]].tobytes()


def unpack(buffer: np.ndarray, at: int, count: int) -> tuple[np.ndarray, int]:
    """``count`` values from place ``at`` of a byte array, and the place after them."""
    controls = -(-count // 4)
    size = _LENGTHS[buffer[at : at + controls]].ravel()[:count].astype(np.int64)
    at += controls
    end = np.cumsum(size)
    data = np.concatenate([buffer[at : at + (int(end[-1]) if count else 0)], np.zeros(3, np.uint8)])
    start = end - size
    out = data[start].astype(np.uint32)
    for k in range(1, 4):
        longer = np.flatnonzero(size > k)
        out[longer] |= data[start[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return out, at + len(data) - 3


def write_block(doc_ids: list[int | None], lengths: np.ndarray, ranks: np.ndarray) -> bytes:
    head = MAGIC + np.array([len(doc_ids)], "<u4").tobytes() + np.array([len(ranks)], "<u8").tobytes()
    null = np.array([d is None for d in doc_ids], np.uint8)
    keys = np.array([d or 0 for d in doc_ids], "<i8")
    return b"".join([head, null.tobytes(), keys.tobytes(), *pack(lengths), *pack(ranks)])


def read_block(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, ids a document has, ranks."""
    if data[:4] != MAGIC:
        raise ValueError("not a token block")
    docs, tokens = int(np.frombuffer(data, "<u4", 1, 4)[0]), int(np.frombuffer(data, "<u8", 1, 8)[0])
    buffer = np.frombuffer(data, np.uint8)
    null = buffer[16 : 16 + docs]
    keys = np.frombuffer(data, "<i8", docs, 16 + docs).tolist()
    lengths, at = unpack(buffer, 16 + 9 * docs, docs)
    ranks, _ = unpack(buffer, at, tokens)
    return [None if n else k for n, k in zip(null, keys, strict=True)], lengths, ranks


#: Texts with other characters, whose classes differ between Unicode versions, take the long way through the library.
_OTHER = re.compile(r"[^\t-\r\x20-\x7e\xa0-ɏ‐-‧€]").search
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The printable stand-ins of a byte-level vocabulary: printable Latin-1 is itself, other bytes follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Ids:
    """Ids of texts exactly as the tokenizers library gives them for this file.

    In a byte-level vocabulary whose ids ascend in the order of its merges, the merges can run in tiktoken's core, at a
    quarter of the time; that order and the plain settings are checked, and files without them go through the library.
    """

    def __init__(self, tokenizer_file: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs as many workers as there are cores
        self.library = Tokenizer.from_file(tokenizer_file)
        self.size = self.library.get_vocab_size(with_added_tokens=True)
        self.kind = "<u2" if self.size <= 1 << 16 else "<u4"
        spec = json.loads(self.library.to_str())
        self.core = self._core(spec)
        self.added = re.compile("|".join(re.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)").search

    @staticmethod
    def _core(spec: dict) -> tiktoken.Encoding | None:
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if not plain or spec["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex"):
            return None
        special = {t["content"] for t in spec["added_tokens"]}
        letters, vocab = _byte_letters(), {k: v for k, v in model["vocab"].items() if k not in special}
        merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        if merged != sorted(merged) or len(vocab) != 256 + len(merged):
            return None
        ranks = {bytes(letters[c] for c in piece): i for piece, i in vocab.items()}
        return tiktoken.Encoding("core", pat_str=_RULE, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, self.kind)
        if self.core is None or _OTHER(text) or self.added(text):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, self.kind)
        return np.array(self.core.encode_ordinary(text), self.kind)


_IDS: dict[str, Ids] = {}


def _ids(tokenizer_file: str) -> Ids:
    if tokenizer_file not in _IDS:
        _IDS[tokenizer_file] = Ids(tokenizer_file)
    return _IDS[tokenizer_file]


def tokenise(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """(doc_id, ids binary): little-endian ids of two bytes, or four for vocabularies over 65,536, with END after them."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = _ids(tokenizer_file)
        end = np.array([END], ids.kind).tobytes()
        for batch in batches:
            for part in slices(batch):
                yield to_batch({"doc_id": part.column(0), "ids": [ids.encode(t).tobytes() + end for t in part.column(1).to_pylist()]}, schema)

    return map_arrow(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, ids binary")


def ranks(tokens: DataFrame, tokenizer_file: str) -> np.ndarray:
    """The vocabulary's ids by falling frequency over all documents, ties by id. As long as the vocabulary: bounded."""
    kind, size = _ids(tokenizer_file).kind, _ids(tokenizer_file).size
    schema = pa.schema([("id", pa.int32()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            held = b"".join(batch.column(0).to_pylist())
            total += np.bincount(np.frombuffer(held, kind), minlength=size)
        used = np.flatnonzero(total)
        yield to_batch({"id": used, "n": total[used]}, schema)

    found = map_arrow(tokens.select("ids"), count, "id int, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    total = np.zeros(size, np.int64)
    for row in found.collect():  # a row for each id of the vocabulary at most
        total[row.id] = row.n
    return np.lexsort((np.arange(size), -total)).astype(np.uint32)


def write(docs: DataFrame, tokenizer_file: str, path: str, block_tokens: int = BLOCK_TOKENS) -> None:
    """Write the blocks of all documents in ascending doc_id order to ``path``, and the ranks beside them."""
    spark = docs.sparkSession
    tokens = stage(tokenise(docs, tokenizer_file), "tokens")
    order = ranks(tokens, tokenizer_file)
    rank_of = np.empty(len(order), np.uint32)
    rank_of[order] = np.arange(len(order), dtype=np.uint32)
    shared, kind = Shared(spark, rank_of), _ids(tokenizer_file).kind
    schema = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("before", pa.int64()), ("tokens", pa.int64()), ("data", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_docs: list[int | None] = []
        held: list[bytes] = []
        shard = block = before = size = 0

        def flush() -> pa.RecordBatch:
            values = shared.value[np.frombuffer(b"".join(held), kind)]
            lengths = np.array([len(h) for h in held]) // np.dtype(kind).itemsize
            row = {"shard": [shard], "block": [block], "before": [before], "tokens": [len(values)], "data": [write_block(held_docs, lengths, values)]}
            return to_batch(row, schema)

        for batch in batches:
            for part, doc, ids in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                shard = part
                held_docs.append(doc)
                held.append(ids)
                size += len(ids) // np.dtype(kind).itemsize
                if size >= block_tokens:
                    yield flush()
                    block, before, size, held_docs, held = block + 1, before + size, 0, [], []
        if held:
            yield flush()

    ranged = tokens.repartitionByRange("doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "ids").select(F.spark_partition_id().alias("shard"), "doc_id", "ids")
    with small_batches(spark):
        map_arrow(ranged, run, "shard int, block int, before bigint, tokens bigint, data binary").write.option("compression", "none").parquet(f"{path}/blocks")
    spark.createDataFrame([(order.tobytes(),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of little-endian u32) of each document, from the written files."""
    blocks = spark.read.parquet(f"{path}/blocks")
    order = np.frombuffer(spark.read.parquet(f"{path}/ranks").first().ids, np.uint32)
    start, at = {}, 0
    for row in blocks.groupBy("shard").agg(F.sum("tokens").alias("n")).orderBy("shard").collect():  # a row for each shard
        start[row.shard], at = at, at + row.n
    shared = Shared(spark, (order, start))
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, start = shared.value
        for batch in batches:
            for shard, before, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                docs, lengths, values = read_block(data)
                ids = order[values].astype("<u4")
                end = np.cumsum(lengths, dtype=np.int64)
                first = end - lengths
                yield to_batch({"doc_id": docs, "start": first + start[shard] + before, "n_tokens": lengths.astype(np.int64), "ids": [ids[a:b].tobytes() for a, b in zip(first, end)]}, schema)

    return map_arrow(blocks.select("shard", "before", "data"), run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def report(docs: DataFrame, tokenizer_file: str, path: str | None = None) -> DataFrame:
    """Write, read back, and return per document: doc_id, start, n_tokens, ids_crc32 (unsigned, of the ids' bytes)."""
    spark = docs.sparkSession
    if path is None:  # nobody asked for the files: they go when the process ends
        path = f"{shared_dir(spark)}/veridex/ids-{uuid.uuid4().hex}"
        discard(spark, path)
    write(docs, tokenizer_file, path)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(i) for i in batch.column("ids").to_pylist()]
            yield to_batch({"doc_id": batch.column("doc_id"), "start": batch.column("start"), "n_tokens": batch.column("n_tokens"), "ids_crc32": crc}, schema)

    return map_arrow(read(spark, path), run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
