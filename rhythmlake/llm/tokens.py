"""Encoding of a corpus with a public byte-level tokenizer by a shuffle of its distinct words."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rhythmlake.session import written

#: The folder of the vocabulary files and the file used; both are parameters of every operator here.
FOLDER = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters of a block: the documents whose words are made distinct together before any row is sent.
BLOCK_CHARS = 1 << 20


@lru_cache(maxsize=4)
def encoding(path: str):
    """The encoding of a rank file, once a process."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=1)
def _splitter():
    import regex

    return regex.compile(PATTERN)


def vocabulary_path(folder: str = FOLDER, name: str = VOCABULARY) -> str:
    return os.path.join(folder, name)


def _sent(spark: SparkSession, folder: str, name: str) -> str:
    """Send a rank file to the executors, once a session; tasks find it by its name."""
    spark.sparkContext.addFile(vocabulary_path(folder, name))
    return name


def _blocks(limit: int):
    """Documents (doc_id, text) to one row a block: its documents, their words as numbers in order, and its distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        split, part, serial = _splitter(), TaskContext.get().partitionId(), 0
        docs: list = []
        sizes: list[int] = []
        codes: list[np.ndarray] = []
        number: dict[str, int] = {}
        chars = 0

        def block() -> pa.RecordBatch:
            flat = np.concatenate(codes) if codes else np.zeros(0, np.int32)
            cols = [
                pa.array([(part << 32) + serial], pa.int64()),
                pa.array([docs], pa.list_(pa.int64())),
                pa.array([sizes], pa.list_(pa.int32())),
                pa.ListArray.from_arrays(pa.array([0, len(flat)], pa.int32()), pa.array(flat, pa.int32())),
                pa.array([list(number)], pa.list_(pa.string())),
            ]
            return pa.RecordBatch.from_arrays(cols, ["block", "docs", "sizes", "codes", "words"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = split.findall(text) if text else []
                for w in words:
                    if w not in number:
                        number[w] = len(number)
                docs.append(doc)
                sizes.append(len(words))
                codes.append(np.fromiter(map(number.__getitem__, words), np.int32, len(words)))
                chars += len(text or "") + 16
                if chars >= limit:
                    yield block()
                    serial += 1
                    docs, sizes, codes, number, chars = [], [], [], {}, 0
        if docs:
            yield block()

    return run


def _encode_words(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoding(SparkFiles.get(name)).encode_ordinary  # a word by itself is split no further
        for batch in batches:
            words = batch.column(0)
            yield pa.RecordBatch.from_arrays([words, pa.array([one(w) for w in words.to_pylist()], pa.list_(pa.int32()))], ["word", "ids"])

    return run


def _reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the ids of their words to one row a document, ids in the order of its words."""
    for batch in batches:
        for i in range(batch.num_rows):
            docs = batch.column(0)[i].values  # stays in Arrow: an id may be null
            sizes, codes = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2))
            found = batch.column(3)[i].values  # null: a block without words
            if found is None or not len(found):
                yield pa.RecordBatch.from_arrays([docs, pa.array([[]] * len(docs), pa.list_(pa.int32()))], ["doc_id", "ids"])
                continue
            at = found.field("code").to_numpy()
            ids = found.field("ids")
            flat, offsets = ids.values.to_numpy(), ids.offsets.to_numpy().astype(np.int64)
            start, length = np.empty(len(at), np.int64), np.empty(len(at), np.int64)
            start[at], length[at] = offsets[:-1], np.diff(offsets)
            n = length[codes]
            ends = np.cumsum(n)
            total = int(ends[-1]) if len(ends) else 0
            out = flat[np.arange(total) + np.repeat(start[codes] - (ends - n), n)]
            bounds = np.concatenate(([0], np.cumsum(sizes)))
            cuts = np.concatenate(([0], ends))[bounds]
            step = max(1, len(docs) // 8)  # a few batches a block
            for lo in range(0, len(docs), step):
                hi = min(len(docs), lo + step)
                values = pa.array(out[cuts[lo] : cuts[hi]], pa.int32())
                yield pa.RecordBatch.from_arrays([docs.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(cuts[lo : hi + 1] - cuts[lo], pa.int32()), values)], ["doc_id", "ids"])


def encode_corpus(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, ids: the ids of each document's whole text, without special tokens (their names in a text are ordinary text).

    An empty list for an empty and for a null text. A row with a null doc_id keeps it. Rows that repeat are encoded each; an empty table gives
    no rows; other columns are ignored.

    Each block of documents is cut into words in place; a document is kept as the positions of its words in the block's list of
    distinct words. Only (word, block, number) is sent: every distinct word meets once in the cluster, is encoded once, and its ids
    join back; then the ids come together by block and are put in the order of positions. A word in every document is so
    sent once a block, not once an occurrence, and one that fills a third of the corpus weighs no more than another.
    """
    name = _sent(docs.sparkSession, folder, vocabulary)
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    blocks = written(rows.mapInArrow(_blocks(block_chars), "block bigint, docs array<bigint>, sizes array<int>, codes array<int>, words array<string>"), "word-blocks")
    words = blocks.select("block", F.posexplode("words").alias("code", "word"))
    table = words.select("word").distinct().mapInArrow(_encode_words(name), "word string, ids array<int>")
    # a very frequent word has one row a block: adaptive execution splits it if that is still much
    known = words.join(table, "word").groupBy("block").agg(F.collect_list(F.struct("code", "ids")).alias("found"))
    whole = blocks.select("block", "docs", "sizes", "codes").join(known, "block", "left").select("docs", "sizes", "codes", "found")
    return whole.mapInArrow(_reassemble, "doc_id bigint, ids array<int>")


def token_bytes(spark: SparkSession, folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """The table of tokens: id, bytes. Its size is that of the vocabulary, about 50,000 rows."""
    with open(vocabulary_path(folder, vocabulary), "rb") as f:
        rows = [(int(b), bytearray(base64.b64decode(a))) for a, b in map(bytes.split, f)]
    return spark.createDataFrame(rows, "id int, bytes binary")


def decode_corpus(encoded: DataFrame, table: DataFrame) -> DataFrame:
    """doc_id, text: the inverse of `encode_corpus`, by a join with the token-byte table (of the vocabulary's size, so broadcast).

    An empty list gives an empty text. A document's tokens are put together by position.
    """
    marked = encoded.withColumn("row", F.monotonically_increasing_id())
    each = marked.select("doc_id", "row", F.posexplode_outer("ids").alias("at", "id"))
    parts = each.join(F.broadcast(table), "id", "left").groupBy("doc_id", "row").agg(F.array_sort(F.collect_list(F.struct("at", F.hex("bytes").alias("hex")))).alias("parts"))
    joined = F.array_join(F.transform("parts", lambda p: F.coalesce(p["hex"], F.lit(""))), "")
    return parts.select("doc_id", F.decode(F.unhex(joined), "UTF-8").alias("text"))


def _sizes(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoding(SparkFiles.get(name)).encode_ordinary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", folder: str = FOLDER, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens of each document's whole text; 0 for an empty and for a null text. No shuffle."""
    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(_sizes(_sent(docs.sparkSession, folder, vocabulary)), "doc_id bigint, n_tokens bigint")
