"""Oversized texts in pieces, cut at natural boundaries.

Texts of a table and files of a shared folder go the same way, by ranges, so that
no worker needs a whole one:

1. *Ranges with halos.* A text is cut into ranges of ``RANGE`` characters, a file
   into byte ranges; each is read with a halo on both sides, and a worker finds
   the boundaries in its range: where a paragraph, a line, a sentence or a word
   ends.
2. *Stitching.* Lengths of ranges in characters become offsets by prefix sums over
   one number a range. Boundary tables are folded by segments of ``SEGMENT``
   characters, never by whole texts.
3. *Cuts.* The greedy cut follows a text from its begin, so it would need all of
   it in one place. At each multiple of the segment's length it therefore has an
   anchor: the best boundary of the last ``limit`` characters before it. A piece
   ends at every anchor, so segments are cut at once and apart; texts up to
   ``SEGMENT`` characters have no anchor. Within a segment each piece ends at the
   best boundary in reach (of the highest rank in the second half of the limit,
   else the last of any rank), or at the limit where there is none, and the next
   one begins ``overlap`` characters before that end.
4. *Emission by offset.* Pieces meet the ranges they touch by (text, range), take
   their part of each, and are put together. So do the surroundings of forced cuts,
   from which it is told whether a run is longer than the limit (``oversized``).

Defined cases: all lengths are in code points; null and empty texts have no
piece; a text within its limit is one piece; an overlap of the limit or more counts
as the limit less one; rows repeated with the same key count once; only space, tab,
CR and LF are breaks between words; a run of breaks is cut by force alone."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import shared_folder, written

RANGE, HALO, SEGMENT = 4096, 64, 1 << 20
BREAK = re.compile(r"[ \t\r\n]+")
SENTENCE = re.compile(r"[.!?。！？…;:][\"'»”’)\]]*$")
FOUND = "item STRING, low BIGINT, start BIGINT, chars BIGINT, at ARRAY<BIGINT>, rank ARRAY<TINYINT>"


def boundaries(text: str, low: int, high: int) -> tuple[list[int], list[int]]:
    """Ends of runs of breaks within text[low:high], with their ranks: 4 for a
    paragraph, 3 a line, 2 a sentence, 1 a word. What lies outside is the halo."""
    at, rank = [], []
    for m in BREAK.finditer(text):
        if not low < m.end() <= high:
            continue
        lines = m[0].replace("\r\n", "\n").replace("\r", "\n").count("\n")
        if lines:
            kind = 4 if lines > 1 else 3
        else:
            kind = 2 if SENTENCE.search(text[max(0, m.start() - 4) : m.start()]) else 1
        at.append(m.end())
        rank.append(kind)
    return at, rank


def open_ends(text: str, low: int, high: int) -> tuple[int | None, int | None, int]:
    """What a range leaves open: the place of its first break, unless breaks reach
    into it, the end of its last one, unless breaks reach out of it; and the longest
    run between two of its breaks. Places count from ``low``."""
    first = last = None
    end, longest, fresh = None, 0, True
    for m in BREAK.finditer(text):
        if low <= m.start() < high:
            if end is not None:
                longest = max(longest, m.start() - end)
            elif fresh:
                first = m.start() - low
            end, last = None, None
        if low < m.end() <= high:
            end, last = m.end(), m.end() - low
        fresh = fresh and not (low <= m.start() < high or low < m.end() <= high)
    return first, last, longest


def cuts(at: np.ndarray, rank: np.ndarray, begin: int, length: int, limit: int, overlap: int) -> list[tuple[int, int, bool]]:
    """(begin, end, forced) of the pieces of [begin, length), from the boundaries there."""
    pieces = []
    while length - begin > limit:
        reach = begin + limit
        lo, hi = np.searchsorted(at, begin + overlap + 1), np.searchsorted(at, reach, side="right")
        if lo < hi:
            half = max(lo, np.searchsorted(at, begin + limit // 2))
            pick = hi - 1
            if half < hi:
                pick = half + np.flatnonzero(rank[half:hi] == rank[half:hi].max())[-1]
            end, forced = int(at[pick]), False
        else:
            end, forced = reach, True
        pieces.append((begin, end, forced))
        begin = end - overlap
    return [*pieces, (begin, length, False)]


def anchor(at: np.ndarray, rank: np.ndarray, place: int, limit: int) -> tuple[int, bool]:
    """(end, forced) of the piece before the multiple ``place`` of a segment."""
    lo, hi = np.searchsorted(at, place - limit, side="right"), np.searchsorted(at, place, side="right")
    if lo == hi:
        return place, True
    return int(at[lo + np.flatnonzero(rank[lo:hi] == rank[lo:hi].max())[-1]]), False


# ---------------------------------------------------------------- stitching

def _segments(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The boundaries of each range by segment, with those before a segment that its
    first anchor may be one of."""
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            at, rank, size = np.asarray(row.at, dtype=np.int64) + row.start, np.asarray(row.rank, dtype=np.int8), row.segment_chars
            for s in range(row.start // size, min((row.start + row.chars + row.chunk_chars) // size, (row.length - 1) // size) + 1):
                own = (at > s * size - row.chunk_chars) & (at <= (s + 1) * size)
                out.append((row.item, s, row.start, at[own], rank[own]))
        yield pd.DataFrame(out, columns=["item", "segment", "start", "at", "rank"])


def _fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for row in batch.itertuples(index=False):
            parts = sorted(row.parts, key=lambda p: p["start"])
            at = np.concatenate([np.asarray(p["at"], dtype=np.int64) for p in parts])
            rank = np.concatenate([np.asarray(p["rank"], dtype=np.int8) for p in parts])
            low, high = row.segment * row.segment_chars, (row.segment + 1) * row.segment_chars
            begin = anchor(at, rank, low, row.chunk_chars)[0] - row.overlap if low else 0
            end, forced = anchor(at, rank, high, row.chunk_chars) if high < row.length else (row.length, False)
            pieces = cuts(at, rank, begin, end, row.chunk_chars, row.overlap)
            pieces[-1] = (*pieces[-1][:2], forced)
            out += [(row.item, row.segment, k, *p) for k, p in enumerate(pieces)]
        yield pd.DataFrame(out, columns=["item", "segment", "turn", "begin", "end", "forced"])


def piece_table(found: DataFrame, items: DataFrame) -> DataFrame:
    """(item, piece, begin, end, forced) of ``items(item, length, chunk_chars, overlap)``
    from the boundaries of their ranges. What meets in one task is a segment."""
    overlap = F.greatest(F.lit(0), F.least("overlap", F.col("chunk_chars") - 1))
    sized = items.select("item", "length", "chunk_chars", overlap.cast("bigint").alias("overlap"), F.greatest(F.lit(SEGMENT), F.col("chunk_chars") * 8).cast("bigint").alias("segment_chars"))
    ranges = found.select("item", "start", "chars", "at", "rank").join(sized, "item")
    parts = ranges.mapInPandas(_segments, "item STRING, segment BIGINT, start BIGINT, at ARRAY<BIGINT>, rank ARRAY<TINYINT>")
    stitched = parts.groupBy("item", "segment").agg(F.collect_list(F.struct("start", "at", "rank")).alias("parts")).join(sized, "item")
    pieces = written(stitched.mapInPandas(_fold, "item STRING, segment BIGINT, turn INT, begin BIGINT, end BIGINT, forced BOOLEAN"))
    counts = pieces.groupBy("item", "segment").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("item").orderBy("segment").rowsBetween(Window.unboundedPreceding, -1))
    ahead = counts.select("item", "segment", F.coalesce(before, F.lit(0)).alias("ahead"))
    return pieces.join(ahead, ["item", "segment"]).select("item", (F.col("ahead") + F.col("turn")).cast("int").alias("piece"), "begin", "end", "forced")


def _joined(parts: DataFrame, *keys: str) -> DataFrame:
    """Pieces from their parts(..., start, text)."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "text"))), lambda p: p["text"]), "")
    return parts.groupBy(*keys).agg(text.alias("text"))


# ---------------------------------------------------------------- tables

def limited(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(item, section, text, length, chunk_chars, overlap), each chunk once, item
    being its chunk_id. The limits are one row for each subpart, a fixed table."""
    known = limits.where(F.col("subpart") != "*").select("subpart", F.col("chunk_chars").alias("own_chars"), F.col("overlap").alias("own_overlap"))
    rest = limits.where(F.col("subpart") == "*").agg(F.min("chunk_chars").alias("any_chars"), F.min("overlap").alias("any_overlap"))
    texts = chunks.where(F.col("chunk_id").isNotNull() & (F.length("text") > 0)).select("chunk_id", "section", "subpart", "text").dropDuplicates(["chunk_id"])
    any_chars, any_overlap = rest.select("any_chars").scalar(), rest.select("any_overlap").scalar()
    joined = texts.join(F.broadcast(known), "subpart", "left")
    return joined.select(
        F.col("chunk_id").alias("item"), "section", "text", F.length("text").cast("bigint").alias("length"),
        F.coalesce("own_chars", any_chars).alias("chunk_chars"), F.coalesce("own_overlap", any_overlap).alias("overlap"),
    ).where(F.col("chunk_chars") > 0)


def _find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The boundaries of each range."""
    for batch in batches:
        out = []
        for item, start, ahead, part, chars in zip(batch["item"], batch["start"], batch["ahead"], batch["part"], batch["chars"]):
            low, high = int(ahead), int(ahead) + int(chars)
            at, rank = boundaries(part, low, high)
            out.append((item, start, start, chars, [a - low for a in at], rank))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FOUND.split(", ")])


def ranges_of(texts: DataFrame) -> DataFrame:
    """(item, start, chars, ahead, part): the ranges of texts, with their halos."""
    rows = texts.select("item", "text", "length", F.explode(F.sequence(F.lit(0), F.col("length") - 1, F.lit(RANGE))).alias("start"))
    ahead = F.least("start", F.lit(HALO))
    part = F.substring("text", (F.col("start") - ahead + 1).cast("int"), (ahead + RANGE + HALO).cast("int"))
    return rows.select("item", "start", F.least(F.lit(RANGE), F.col("length") - F.col("start")).alias("chars"), ahead.alias("ahead"), part.alias("part"))


def cut_out(spans: DataFrame, ranges: DataFrame) -> DataFrame:
    """``spans(item, begin, end, ...)`` with ``start`` and ``text``: the part that each
    range a span touches has of it, by offset."""
    wanted = spans.withColumn("start", F.explode(F.transform(F.sequence(F.floor(F.col("begin") / RANGE), F.floor((F.col("end") - 1) / RANGE)), lambda k: k * RANGE)))
    bare = ranges.select("item", "start", F.substring("part", (F.col("ahead") + 1).cast("int"), F.lit(RANGE)).alias("part"))
    low, high = F.greatest(F.col("begin") - F.col("start"), F.lit(0)), F.least(F.col("end") - F.col("start"), F.lit(RANGE))
    return wanted.join(bare, ["item", "start"]).withColumn("text", F.substring("part", (low + 1).cast("int"), (high - low).cast("int"))).drop("part")


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(chunk_id, cut) of the chunks over their limit, from their pieces.

    A run longer than the limit has a forced cut in it, as no piece reaches over it.
    So the kind hangs on the surroundings of the forced cuts, a limit on either side,
    which are emitted by offset. The first and the last forced cut in each ``limit``
    characters do: a run that has one between them has one of them, too."""
    texts = written(limited(chunks, limits).where(F.col("length") > F.col("chunk_chars")).drop("section"))
    items, ranges = texts.drop("text"), ranges_of(texts)
    pieces = piece_table(ranges.mapInPandas(_find, FOUND), items)
    forced = pieces.where("forced").join(items.select("item", "length", "chunk_chars"), "item")
    ends = forced.groupBy("item", "length", "chunk_chars", F.floor(F.col("end") / F.col("chunk_chars")).alias("cell")).agg(F.min("end").alias("first"), F.max("end").alias("last"))
    places = ends.withColumn("place", F.explode(F.array_distinct(F.array("first", "last"))))
    around = places.select("item", "chunk_chars", "place", F.greatest(F.col("place") - F.col("chunk_chars"), F.lit(0)).alias("begin"), F.least(F.col("place") + F.col("chunk_chars"), "length").alias("end"))
    seen = _joined(cut_out(around, ranges), "item", "chunk_chars", "place")
    long_run = F.exists(F.split("text", "[ \\t\\r\\n]"), lambda run: F.length(run) > F.col("chunk_chars"))
    kinds = seen.groupBy("item").agg(F.bool_or(long_run).alias("long"))
    return items.join(kinds, "item", "left").select(F.col("item").alias("chunk_id"), F.when(F.coalesce("long", F.lit(False)), "forced").otherwise("natural").alias("cut"))


def split(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(section, chunk_index, chunk_id, piece, begin, end, forced, text): all
    pieces; chunk_index counts the pieces of a section from 0, in the order of its
    chunk_ids. The window over a section runs over counts, not over texts."""
    texts = written(limited(chunks, limits))
    items = texts.drop("text")
    ranges = ranges_of(texts)
    pieces = piece_table(ranges.mapInPandas(_find, FOUND), items)
    counts = pieces.groupBy("item").agg(F.count("*").alias("n")).join(items.select("item", "section"), "item")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("section").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = pieces.join(counts.select("item", "section", before.alias("first")), "item")
    parts = cut_out(placed, ranges)
    out = _joined(parts, "item", "section", "first", "piece", "begin", "end", "forced")
    return out.select("section", (F.col("first") + F.col("piece")).cast("int").alias("chunk_index"), F.col("item").alias("chunk_id"), "piece", F.col("begin").cast("int").alias("begin"), F.col("end").cast("int").alias("end"), "forced", "text")


# ---------------------------------------------------------------- files

def _read(path: str, low: int, high: int) -> tuple[str, str, str]:
    """The characters that begin in bytes [low, high), with the halos around."""
    first = max(0, low - 4 * HALO)
    if "://" in path:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(path)
        opened = system.open_input_file(inner)
    else:
        opened = open(path.removeprefix("file:"), "rb")  # noqa: SIM115
    with opened as file:
        file.seek(first)
        data = file.read(high + 4 * HALO - first)
    a, b = low - first, high - first
    while a < len(data) and data[a] & 0xC0 == 0x80:
        a += 1
    while b < len(data) and data[b] & 0xC0 == 0x80:
        b += 1
    text = lambda part: part.decode("utf-8", "replace")
    return text(data[:a])[-HALO:], text(data[a:b]), text(data[b:])[:HALO]


def split_files(spark: SparkSession, files: list[tuple[str, int]], limit: int, overlap: int, range_bytes: int = 4 << 20) -> DataFrame:
    """(path, piece, begin, end, text) of UTF-8 files of a folder that all workers
    reach, given with their sizes. No worker reads more than one range, and no
    text travels but as the parts of pieces."""
    ranges = spark.createDataFrame([(p, int(n)) for p, n in files], "item STRING, bytes BIGINT").where("bytes > 0")
    ranges = ranges.select("item", "bytes", F.explode(F.sequence(F.lit(0), F.col("bytes") - 1, F.lit(range_bytes))).alias("low"))
    count = sum(-(-int(n) // range_bytes) for _, n in files)
    tasks = max(1, min(count, 20_000))
    ranges = ranges.select("item", "low", F.least(F.col("low") + range_bytes, "bytes").alias("high")).repartition(tasks, "item", "low")

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for item, low, high in zip(batch["item"], batch["low"], batch["high"]):
                head, body, tail = _read(item, low, high)
                text, a, b = head + body + tail, len(head), len(head) + len(body)
                at, rank = boundaries(text, a, b)
                yield pd.DataFrame([(item, low, 0, len(body), [x - a for x in at], rank)], columns=[c.split()[0] for c in FOUND.split(", ")])

    found = written(ranges.mapInPandas(find, FOUND)).drop("start")
    sizes = found.select("item", "low", "chars")
    start = F.coalesce(F.sum("chars").over(Window.partitionBy("item").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = written(sizes.select("item", "low", start.alias("start"), "chars"))
    items = sizes.groupBy("item").agg(F.sum("chars").alias("length")).where("length > 0").select("item", "length", F.lit(limit).alias("chunk_chars"), F.lit(overlap).alias("overlap"))
    pieces = piece_table(found.join(starts.drop("chars"), ["item", "low"]), items)
    # Ranges differ in characters, so pieces and ranges meet in cells of a fixed width.
    cell = max(1, range_bytes // 4)
    cells = lambda low, high: F.explode(F.sequence(F.floor(low / cell), F.floor((high - 1) / cell)))
    spans = starts.where("chars > 0").select("item", "low", "start", (F.col("start") + F.col("chars")).alias("stop"))
    touched = pieces.withColumn("cell", cells(F.col("begin"), F.col("end"))).join(spans.withColumn("cell", cells(F.col("start"), F.col("stop"))), ["item", "cell"])
    touched = touched.where((F.col("begin") < F.col("stop")) & (F.col("end") > F.col("start"))).drop("cell").distinct()
    wanted = touched.groupBy("item", "low", "start").agg(F.collect_list(F.struct("piece", "begin", "end")).alias("wanted"))
    wanted = wanted.join(ranges.select("item", "low", "high"), ["item", "low"])

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                body = _read(row.item, row.low, row.high)[1]
                cut = [(row.item, w["piece"], w["begin"], w["end"], row.start, body[max(0, w["begin"] - row.start) : w["end"] - row.start]) for w in row.wanted]
                yield pd.DataFrame(cut, columns=["item", "piece", "begin", "end", "start", "text"])

    parts = wanted.mapInPandas(emit, "item STRING, piece INT, begin BIGINT, end BIGINT, start BIGINT, text STRING")
    return _joined(parts, "item", "piece", "begin", "end").withColumnRenamed("item", "path")


def split_corpus(texts: DataFrame, limit: int, overlap: int, range_bytes: int = 4 << 20) -> DataFrame:
    """(file, piece, begin, end, text): the non-null ``texts(text)`` written as UTF-8
    files to the shared folder, and these in pieces; ``file`` numbers them by name."""
    spark = texts.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    texts.where("text is not null").select("text").write.text(folder)
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.deleteOnExit(place)
    found = sorted((f.getPath().toString(), f.getLen()) for f in system.listStatus(place) if f.getPath().getName().startswith("part-"))
    names = spark.createDataFrame([(p, i) for i, (p, _) in enumerate(found)], "path STRING, file INT")
    return split_files(spark, found, limit, overlap, range_bytes).join(F.broadcast(names), "path").select("file", "piece", "begin", "end", "text")
