"""Encoding of a corpus with a public byte-level BPE by a distinct-word table.

1. *Words.* Texts are split in the JVM with the vocabulary's own pattern; BPE never
   merges across words, so a text's ids are its words' ids in order.
2. *Pages.* Some hundred texts form a page, which holds its distinct words once and
   its texts as positions in that list. Pages are written, so that their numbers
   outlive a lost executor.
3. *Distinct words.* The words of all pages are made distinct with map-side
   aggregation, and each is encoded once.
4. *Join by position.* (page, position, word) meets (word, ids); each page takes its
   words' ids back in the order of positions, and its texts look theirs up.

Nothing is broadcast or collected but the vocabulary, which has a fixed size. A word
that all pages have is as many rows as there are pages, which adaptive execution
splits. Decoding is a join of the positions with the id-to-piece table.

Defined ids: null and empty texts have no ids (an empty list). Strings of special
tokens are ordinary text."""

from __future__ import annotations

import base64
import importlib.util
import os
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

VOCABULARY = "byte_bpe_50k.tiktoken"
#: A page is full with so many texts, or with the text that reaches so many words.
PAGE_TEXTS, PAGE_WORDS = 512, 200_000

# Fixed value: the splitting pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern in Java, with white space as Unicode has it.
JAVA_PATTERN = "(?U)" + PATTERN


def vocabulary_folder() -> str:
    """Where the public vocabularies lie: a setting, or the installed package."""
    if folder := os.environ.get("TOKENIZERS_DIR"):
        return folder
    spec = importlib.util.find_spec("public_tokenizers")
    return str(Path(spec.origin).parent) if spec and spec.origin else "/opt/tokenizers"


@lru_cache(maxsize=2)
def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks(path), special_tokens={})


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(JAVA_PATTERN), F.lit(0))


# ---------------------------------------------------------------- encoding

def encode_words(words: DataFrame, path: str) -> DataFrame:
    """(word, ids): each of the distinct words encoded once."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = encoding(path)
        for batch in batches:
            yield pd.DataFrame({"word": batch["word"], "ids": [coder.encode_ordinary(w) for w in batch["word"]]})

    return words.select("word").mapInPandas(encode, "word STRING, ids ARRAY<INT>")


def _lengths(column: pa.Array) -> np.ndarray:
    return np.nan_to_num(column.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _paged(keep: tuple[str, ...], texts: int, words: int):
    """Texts as words to pages: the texts' keys and numbers of words, all their words
    as positions in the page's list, and that list."""

    def paged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = TaskContext.get().partitionId() << 33
        for batch in batches:
            lens = _lengths(batch.column("words"))
            upto, low = np.cumsum(lens), 0
            while low < len(lens):
                before = int(upto[low] - lens[low])
                high = min(low + texts, len(lens), int(np.searchsorted(upto, before + words)) + 1)
                column = batch.column("words").slice(low, high - low)
                coded = column.flatten().dictionary_encode()
                row = {
                    "page": pa.array([page], pa.int64()), "doc_ids": _one_list(batch.column("doc_id").slice(low, high - low)), "lens": _one_list(pa.array(lens[low:high].astype(np.int32))),
                    "codes": _one_list(coded.indices.cast(pa.int32())), "words": _one_list(coded.dictionary.cast(pa.string())),
                }
                yield pa.record_batch(row | {c: _one_list(batch.column(c).slice(low, high - low)) for c in keep})
                low, page = high, page + 1

    return paged


def _looked_up(keep: tuple[str, ...]):
    """Each page's texts with the ids of their words, from the page's ids by position."""

    def looked_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                part = {c: batch.column(c)[k].values for c in ("doc_ids", "lens", "codes", *keep)}
                held = batch.column("ids")[k].values
                width = _lengths(held) if held is not None else np.zeros(0, dtype=np.int64)
                flat = held.flatten().to_numpy() if held is not None else np.zeros(0, dtype=np.int32)
                begin, codes = np.cumsum(width) - width, part["codes"].to_numpy()
                sizes = width[codes]
                ends = np.concatenate(([0], np.cumsum(sizes)))
                ids = flat[np.repeat(begin[codes] - ends[:-1], sizes) + np.arange(ends[-1])]
                offsets = ends[np.concatenate(([0], np.cumsum(part["lens"].to_numpy())))]
                yield pa.record_batch(
                    {"doc_id": part["doc_ids"], "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids.astype(np.int32)))} | {c: part[c] for c in keep}
                )

    return looked_up


def token_ids(documents: DataFrame, vocabulary: str | None = None, keep: tuple[str, ...] = (), page_texts: int = PAGE_TEXTS, page_words: int = PAGE_WORDS) -> DataFrame:
    """(doc_id, ids) of ``documents(doc_id, text)``, one row a document, with the
    string columns ``keep`` carried along."""
    path = vocabulary or f"{vocabulary_folder()}/{VOCABULARY}"
    split = documents.select("doc_id", *keep, F.coalesce(words_of(F.col("text")), F.array().cast("array<string>")).alias("words"))
    lists = "".join(f", {c} ARRAY<STRING>" for c in keep)
    pages = written(split.mapInArrow(_paged(keep, page_texts, page_words), "page BIGINT, doc_ids ARRAY<BIGINT>, lens ARRAY<INT>, codes ARRAY<INT>, words ARRAY<STRING>" + lists))
    places = pages.select("page", F.posexplode("words").alias("pos", "word"))
    encoded = encode_words(pages.select(F.explode("words").alias("word")).distinct(), path)
    back = places.join(encoded, "word").groupBy("page").agg(F.array_sort(F.collect_list(F.struct("pos", "ids"))).alias("o"))
    joined = pages.drop("words").join(back.select("page", F.col("o.ids").alias("ids")), "page", "left")
    return joined.mapInArrow(_looked_up(keep), "doc_id BIGINT, ids ARRAY<INT>" + "".join(f", {c} STRING" for c in keep))


# ---------------------------------------------------------------- decoding

def pieces(spark: SparkSession, vocabulary: str | None = None) -> DataFrame:
    """(id, piece): the vocabulary as a table."""
    path = vocabulary or f"{vocabulary_folder()}/{VOCABULARY}"
    return spark.createDataFrame([(i, bytearray(p)) for p, i in ranks(path).items()], "id INT, piece BINARY")


def decoded(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, text) of (doc_id, ids): positions joined with the id-to-piece
    table. The vocabulary has a fixed size, so it is the side that is broadcast.
    A document without ids is the empty text."""
    table = pieces(encoded.sparkSession, vocabulary)
    parts = encoded.select("doc_id", F.posexplode("ids").alias("pos", "id")).join(F.broadcast(table), "id")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    texts = parts.groupBy("doc_id").agg(F.decode(F.unhex(F.array_join(F.transform(ordered, lambda s: F.hex(s["piece"])), "")), "UTF-8").alias("text"))
    return encoded.select("doc_id").join(texts, "doc_id", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
