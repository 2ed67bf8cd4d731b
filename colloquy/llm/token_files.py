"""Token ids as Parquet list columns that allow selective reads.

A token table is a folder of Parquet files in ascending ``doc_id`` order (nulls first, then by a hash of
the text and the text itself): part numbers ascend, and so do the rows of a file. Columns are ``doc_id``,
``n_tokens`` and ``ids``. Row groups and pages are small and carry Parquet's column and offset indexes, so a
range of documents reads only its pages of ids, and lengths read no ids at all. Ids are dictionary encoded
(the dictionary of a vocabulary fits a page) or delta encoded.

Nulls: a null text is an empty one and holds the end id only; a null ``doc_id`` sorts first. Repeated rows
are written each. A text of any length is one row. An empty table gives one empty file. Columns of the
documents other than ``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from colloquy.llm.words import split, text_slices

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
END_ID = 1
SCHEMA = "doc_id bigint, n_tokens bigint, ids array<int>"
#: Distinct words that a worker remembers between batches; beyond half of it, only those used since are taken along.
REMEMBERED = 700_000
SLICE = 4 << 20
#: Where lower-casing or cutting words beforehand could change ids: marks that compose, and special tokens.
AS_IT_IS = r"<\||\pM"

# Writer settings of the file format.
LAYOUT = {
    "compression": "zstd",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "1000",
}
ENCODINGS = {
    "dictionary": {"parquet.enable.dictionary": "true"},
    "delta": {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"},
}


class WordEncoder:
    """Ids of whole texts by a vocabulary that splits at white space and drops it.

    The ids of a text are those of its white-space separated chunks, one after the other, so each
    distinct chunk of a batch is encoded once. The vocabulary also lower-cases, and ends a token between a
    letter and a following punctuation mark; so letters A-Z are lower-cased and chunks cut there beforehand, which leaves fewer
    distinct ones. Batches that hold combining marks or the start of a special token are cut at commas and full stops only.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Ids of a word as packed integers, two bytes each where the vocabulary allows.
        self.kind = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Offsets and ids of the texts, each closed by ``end_id``."""
        if pc.any(pc.match_substring_regex(texts, AS_IT_IS)).as_py():
            texts = pc.replace_substring_regex(texts, r"([A-Za-z])([,.])", r"\1 \2")
        else:
            letters = r"([a-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}])"
            texts = pc.replace_substring_regex(pc.ascii_lower(texts), letters + r"([!-&(-/:-@\[-`{-~])", r"\1 \2")
        offsets, codes, distinct = split(texts)
        each = self._of_words(distinct.to_pylist())
        kind = np.dtype(self.kind)
        lengths = np.fromiter(map(len, each), np.int64, len(each)) // kind.itemsize
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(each), kind)
        sizes = lengths[codes]
        until = np.concatenate(([0], np.cumsum(sizes)))
        ends = until[offsets[1:]]
        from_ = np.repeat((starts[codes] - until[:-1]).astype(np.int32), sizes)
        ids = flat[from_ + np.arange(until[-1], dtype=np.int32)].astype(np.int32)
        return np.concatenate(([0], ends + np.arange(1, len(ends) + 1))), np.insert(ids, ends, end_id)

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of distinct words."""
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        known, older, new = self.known, self.older, []
        for word in words:
            if word not in known:
                if (ids := older.get(word)) is None:
                    new.append(word)
                else:
                    known[word] = ids
        # Words in order of their letters take the same paths through the merges one after the other.
        new.sort()
        for start in range(0, len(new), 10_000):
            some = new[start : start + 10_000]
            for word, coded in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False)):
                known[word] = array(self.kind, coded.ids).tobytes()
        return list(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encode(docs: DataFrame, path: str = VOCABULARY, end_id: int = END_ID) -> DataFrame:
    """``doc_id``, ``n_tokens`` and ``ids`` of each whole text, in the order of the input's partitions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        for batch in text_slices(batches, limit=SLICE):
            offsets, ids = own.encode(batch.column("text"), end_id)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.diff(offsets), pa.int64()), lists], names=["doc_id", "n_tokens", "ids"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def write_tokens(
    docs: DataFrame, folder: str, path: str = VOCABULARY, end_id: int = END_ID, encoding: str = "dictionary"
) -> None:
    """Encode all documents and write them as a token table, texts being shuffled once into document order."""
    ordered = (
        docs.select("doc_id", "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    )
    encode(ordered, path, end_id).write.options(**LAYOUT, **ENCODINGS[encoding]).parquet(folder)


def read_tokens(spark: SparkSession, folder: str, where: Column | None = None) -> DataFrame:
    """Rows of a token table; select what is needed, and give ``where`` to read only some documents' pages."""
    table = spark.read.schema(SCHEMA).parquet(folder)
    return table if where is None else table.filter(where)


def _place() -> tuple[Column, Column]:
    """Order number of a file in its table, and of a row in its file."""
    name = F.col("_metadata.file_name")
    part = F.regexp_extract(name, r"part-(\d+)", 1).cast("bigint")
    return F.struct(part.alias("part"), name.alias("name")), F.col("_metadata.row_index")


def with_starts(rows: DataFrame) -> DataFrame:
    """Add ``start``, the ids before each document. ``rows`` has ``file``, ``row`` and ``n_tokens`` of the whole table.

    A file holds a bounded number of rows, and only one row a file is summed over all files.
    """
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_tokens"))
    bases = files.select("file", F.coalesce(F.sum("_tokens").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("file").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("_inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
        .join(bases, "file")
        .withColumn("start", F.col("_base") + F.col("_inside"))
        .drop("_base", "_inside")
    )


def read_starts(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start`` and ``n_tokens`` of each document, read without the ids."""
    file, row = _place()
    rows = read_tokens(spark, folder).select("doc_id", "n_tokens", file.alias("file"), row.alias("row"))
    return with_starts(rows).select("doc_id", "start", "n_tokens")


def read_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and ``ids_crc32`` (of little-endian 32-bit ids), all from the files."""
    file, row = _place()
    rows = read_tokens(spark, folder).select("doc_id", file.alias("file"), row.alias("row"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            sums = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds.tolist(), bounds[1:].tolist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in ("doc_id", "file", "row")] + [pa.array(np.diff(bounds), pa.int64()), pa.array(sums, pa.int64())],
                names=["doc_id", "file", "row", "n_tokens", "ids_crc32"],
            )

    schema = "doc_id bigint, file struct<part: bigint, name: string>, row bigint, n_tokens bigint, ids_crc32 bigint"
    return with_starts(rows.mapInArrow(run, schema)).select("doc_id", "start", "n_tokens", "ids_crc32")
