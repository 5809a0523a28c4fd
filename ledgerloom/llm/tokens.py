"""Whole-corpus encoding with a public byte-level BPE (problem 8).

The corpus is cut into blocks of a few megabytes of text.  In a block the
pre-tokens are found with array arithmetic on the code points (no regex per
match), numbered by first-class Arrow dictionary encoding, and the text becomes
a list of positions into the block's word list.  Only the distinct (block, word)
pairs travel: their words are made distinct over the whole corpus, each word is
encoded once, the ids are joined back to the pairs and then to the blocks, where
the documents are put together by position.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.session import small_batches, written

BLOCK_BYTES = 4 << 20
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
#: Fixed values of the public pattern: what may follow an apostrophe.
CONTRACTIONS = ("s", "t", "m", "d", "re", "ve", "ll")


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken", folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` overrides the installed one."""
    if folder:
        return f"{folder}/{name}"
    import public_tokenizers

    return str(public_tokenizers.path(name))


@functools.lru_cache(maxsize=4)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def bpe(path: str):
    """The byte-pair encoder of one pre-token (no pattern, no special tokens)."""
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=r"(?s:.+)", mergeable_ranks=ranks(path), special_tokens={})._core_bpe


@functools.lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """Class of each code point as the public pattern sees it.

    Letters and numbers are those of the ``regex`` library.  Code points that
    Python does not know yet are put to the tokenizer itself, whose Unicode
    version decides.
    """
    import regex

    points = np.arange(0x110000, dtype="<u4")
    points[0xD800:0xE000] = 0
    every = points.tobytes().decode("utf-32-le")
    kinds = np.full(0x110000, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            kinds[m.start() : m.end()] = kind
    new = [c for c in np.flatnonzero((kinds == LETTER) | (kinds == NUMBER)) if unicodedata.category(chr(c)) == "Cn"]
    if new:
        try:
            from tokenizers import Tokenizer

            split = Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json")).pre_tokenizer.pre_tokenize_str
            for c in new:
                if split(("a" if kinds[c] == LETTER else "1") + chr(c))[0][1][1] != 2:
                    kinds[c] = OTHER
        except (ImportError, OSError):
            kinds[new] = OTHER
    return kinds


def pretoken_starts(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Start of every pre-token in ``points``, several texts one after another.

    ``doc_starts`` holds the first code point of each non-empty text.
    """
    n = len(points)
    if n == 0:
        return np.empty(0, np.int64)
    kind = class_table()[points]
    first = np.zeros(n + 1, bool)  # first code point of a text, and the end
    first[doc_starts] = True
    first[n] = True
    start = np.empty(n, bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= first[:n]
    white = kind == SPACE
    # The last white space before a word stands alone, or opens the word if it is a blank.
    lead = np.zeros(n, bool)
    lead[:-1] = white[:-1] & ~white[1:] & ~first[1:n]
    blank = lead & (points == 32)
    start |= lead
    after = np.flatnonzero(blank) + 1
    start[after] = False
    # 's 't 're 've 'm 'll 'd where the apostrophe opens a pre-token of its own.
    at = np.flatnonzero((points == 39) & start)
    at = at[at + 1 < n]
    at = at[(kind[at + 1] == LETTER) & ~first[at + 1]]
    if len(at):
        one = points[at + 1]
        has_two = (at + 2 < n) & ~first[np.minimum(at + 2, n)]
        two = np.where(has_two, points[np.minimum(at + 2, n - 1)], 0)
        single = np.isin(one, [ord(c) for c in CONTRACTIONS if len(c) == 1])
        double = np.zeros(len(at), bool)
        for c in CONTRACTIONS:
            if len(c) == 2:
                double |= (one == ord(c[0])) & (two == ord(c[1]))
        size = np.where(single, 2, np.where(double, 3, 0))
        at, size = at[size > 0], size[size > 0]
        start[at + 1] = False
        end = at + size
        end = end[end < n]
        # what follows the contraction opens the next pre-token, unless a blank already did
        start[end] |= kind[end] == LETTER
    return np.flatnonzero(start)


class Block:
    """Some texts as word list and positions."""

    def __init__(self, texts: pa.Array):
        encoded = [x.encode() if x else b"" for x in texts.to_pylist()]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in encoded])]).astype(np.int64)
        raw = b"".join(encoded)
        data = np.frombuffer(raw, np.uint8)
        lead_bytes = np.flatnonzero((data & 0xC0) != 0x80)  # byte where each code point begins
        self.points = np.frombuffer(raw.decode().encode("utf-32-le"), "<u4")
        self.char_bounds = np.searchsorted(lead_bytes, bounds)
        self.starts = pretoken_starts(self.points, self.char_bounds[:-1][np.diff(self.char_bounds) > 0])
        offsets = np.append(lead_bytes[self.starts], len(raw)).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.starts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)])
        coded = words.dictionary_encode()
        self.words = coded.dictionary.to_pylist()
        self.slots = np.asarray(coded.indices, dtype=np.int32)
        #: First position of each text in ``slots``, and the end.
        self.first = np.searchsorted(self.starts, self.char_bounds)


def blocks_of(batches: Iterator[pa.RecordBatch], text: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.Table, Block]]:
    """The rows of a partition in runs of about ``limit`` bytes of text, however they are batched."""
    held: list[pa.RecordBatch] = []
    bytes_held = 0

    def block() -> tuple[pa.Table, Block]:
        rows = pa.Table.from_batches(held)
        column = rows.column(text)
        return rows, Block(pa.concat_arrays(column.chunks))

    for batch in batches:
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0), dtype=np.int64))
        at = 0
        while at < batch.num_rows:
            base = size[at - 1] if at else 0
            to = max(at + (not held), int(np.searchsorted(size, base + limit - bytes_held, side="right")))
            if to > at:
                held.append(batch.slice(at, to - at))
                bytes_held += int(size[to - 1] - base)
                at = to
            if at < batch.num_rows:
                yield block()
                held, bytes_held = [], 0
    if held:
        yield block()


def _packed(slots: np.ndarray) -> bytes:
    """Positions as byte planes; the upper planes are almost all zero."""
    width = 2 if not len(slots) or slots.max() < 1 << 16 else 4
    planes = np.ascontiguousarray(slots.astype("<u2" if width == 2 else "<u4").view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + planes.tobytes()


def _unpacked(packed: bytes) -> np.ndarray:
    width = packed[0]
    planes = np.frombuffer(packed, np.uint8, offset=1).reshape(width, -1)
    return np.ascontiguousarray(planes.T).view("<u2" if width == 2 else "<u4").ravel().astype(np.int32)


BLOCK_SCHEMA = "block long, doc_ids array<long>, first array<int>, slots binary, words array<binary>"


def _to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("first", pa.list_(pa.int32())), ("slots", pa.binary()), ("words", pa.list_(pa.binary()))])
    key = TaskContext.get().partitionId() << 32
    for n, (rows, block) in enumerate(blocks_of(batches, "text")):
        # words in order of how often they come: small numbers for most positions
        order = np.argsort(-np.bincount(block.slots, minlength=len(block.words)), kind="stable")
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        yield pa.RecordBatch.from_pydict({"block": [key + n], "doc_ids": [rows.column("doc_id").to_pylist()], "first": [block.first.tolist()], "slots": [_packed(rank[block.slots])], "words": [[block.words[i] for i in order]]}, schema=schema)


def corpus_blocks(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` as blocks, written: doc ids, positions and word list."""
    with small_batches(docs.sparkSession):
        return written(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_to_blocks, BLOCK_SCHEMA), "token-blocks")


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """``words(word)``, distinct, with the ids of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for b in batches:
            words = b.column(0)
            ids = [coder.encode_single_piece(w) for w in words.to_pylist()]
            yield pa.RecordBatch.from_arrays([words, pa.array(ids, pa.list_(pa.int32()))], names=["word", "ids"])

    return words.select("word").mapInArrow(run, "word binary, ids array<int>")


def _assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        column = {name: b.column(i) for i, name in enumerate(b.schema.names)}
        for i in range(b.num_rows):
            at, size, values = (np.asarray(column[c][i].values, np.int64 if c != "flat" else np.int32) for c in ("at", "sizes", "flat"))
            order = np.empty(len(at), np.int64)
            order[at] = np.arange(len(at))
            begin = np.concatenate([[0], np.cumsum(size)])[:-1]
            where = order[_unpacked(column["slots"][i].as_py())]
            lens = size[where]
            ends = np.concatenate([[0], np.cumsum(lens)])
            take = np.arange(ends[-1]) - np.repeat(ends[:-1], lens) + np.repeat(begin[where], lens)
            ids = pa.ListArray.from_arrays(pa.array(ends[np.asarray(column["first"][i].values)], pa.int32()), pa.array(values[take], pa.int32()))
            yield pa.RecordBatch.from_arrays([column["doc_ids"][i].values, ids], names=["doc_id", "ids"])


def encode_corpus(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, ids)`` of ``docs(doc_id, text, ...)``; other columns are ignored.

    Null and empty texts give an empty list; a repeated doc_id gives a row each
    time; strings that look like special tokens are ordinary text; a table
    without rows gives none.  A null doc_id is kept.
    """
    path = vocabulary or vocabulary_path()
    blocks = corpus_blocks(docs)
    pairs = blocks.select("block", F.posexplode("words").alias("at", "word"))
    ids = encode_words(pairs.select("word").distinct(), path)
    per_block = (
        pairs.join(ids, "word")
        .groupBy("block")
        .agg(F.collect_list(F.struct("at", "ids")).alias("coded"))
        .select("block", F.col("coded.at").alias("at"), F.flatten("coded.ids").alias("flat"), F.transform("coded.ids", F.size).alias("sizes"))
    )
    empty = F.array().cast("array<int>")
    joined = blocks.select("block", "doc_ids", "first", "slots").join(per_block, "block", "left").select("doc_ids", "first", "slots", *(F.coalesce(c, empty).alias(c) for c in ("at", "flat", "sizes")))
    return joined.mapInArrow(_assemble, "doc_id long, ids array<int>")


def token_bytes(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """The token-byte table: about 50,000 rows, fixed by the vocabulary."""
    known = ranks(vocabulary or vocabulary_path())
    return spark.createDataFrame(pa.table({"id": pa.array(list(known.values()), pa.int32()), "bytes": pa.array(list(known), pa.binary())}).to_pandas(), "id int, bytes binary")


def decode_corpus(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``(doc_id, text)`` of ``(doc_id, ids)``, by a join with the token-byte table.

    The table's size is that of the vocabulary, so it is broadcast.  Unknown ids
    fail the row's text to null; doc_id must be unique.
    """
    table = F.broadcast(token_bytes(encoded.sparkSession, vocabulary))
    parts = encoded.select("doc_id", F.posexplode_outer("ids").alias("at", "id")).join(table, "id", "left")
    whole: Column = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", F.hex("bytes").alias("h"))))), lambda x: x["h"]), "")
    return parts.groupBy("doc_id").agg(F.count(F.when(F.col("at").isNotNull() & F.col("bytes").isNull(), 1)).alias("bad"), whole.alias("h")).select("doc_id", F.when(F.col("bad") == 0, F.decode(F.unhex("h"), "UTF-8")).alias("text"))


def count_tokens(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """``docs`` with ``n_tokens``; a null or empty text has 0.

    Needs no shuffle: the distinct words of a block are encoded where it is.  Run
    it within :func:`ledgerloom.session.small_batches` where texts are long.
    """
    path = vocabulary or vocabulary_path()
    keep = [c for c in docs.columns if c not in ("text", "n_tokens")]
    schema = docs.select(*keep).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = bpe(path)
        for rows, block in blocks_of(batches, "text"):
            size = np.fromiter((len(coder.encode_single_piece(w)) for w in block.words), np.int64, len(block.words))
            ends = np.concatenate([[0], np.cumsum(size[block.slots])]) if len(block.slots) else np.zeros(1, np.int64)
            total = np.diff(ends[block.first])
            out = rows.drop_columns(["text"]).append_column("n_tokens", pa.array(total, pa.int64()))
            yield from out.combine_chunks().to_batches()

    return docs.select(*keep, F.col("text").cast("string").alias("text")).mapInArrow(run, schema.add("n_tokens", "long"))
