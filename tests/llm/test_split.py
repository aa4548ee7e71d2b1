import random

import pytest

from ontoloom.llm import split

LIMITS = [("A", 50, 10), ("B", 20, 0), ("*", 30, 5), ("Z", 10, 30)]


def text(rng, n):
    return "".join(rng.choice(["word", "é🏛", " ", "\t", ". ", "\r\n", "\n\n", "longwordwithoutanybreak", "; "]) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(3)
    rows = [(f"c{i:02}", f"s{i // 2}", rng.choice(["A", "B", None, "Q", "Z"]), text(rng, rng.randint(1, 60))) for i in range(30)]
    rows += [("null", "s", "A", None), ("empty", "s", "A", ""), rows[0], (None, "s", "A", "x" * 99), ("blank", "t", "B", " " * 200), ("solid", "t", "B", "x" * 200)]
    chunks = spark.createDataFrame([(*r, 1, 2) for r in rows], "chunk_id STRING, section STRING, subpart STRING, text STRING, chars INT, piece INT")
    return {r[0]: r for r in rows if r[0]}, chunks, spark.createDataFrame(LIMITS, "subpart STRING, chunk_chars INT, overlap INT")


@pytest.mark.parametrize("size, segment", [(65_536, 1 << 20), (7, 1 << 20), (64, 100)])
def test_pieces_rebuild_the_text(tables, monkeypatch, size, segment):
    rows, chunks, limits = tables
    monkeypatch.setattr(split, "RANGE", size)
    monkeypatch.setattr(split, "SEGMENT", segment)
    found = {}
    for p in split.split(chunks, limits).collect():
        found.setdefault(p.chunk_id, []).append(p)
    assert set(found) == {k for k, r in rows.items() if r[3]}
    bounds = {s: (n, o) for s, n, o in LIMITS}
    for key, pieces in found.items():
        limit, overlap = bounds.get(rows[key][2], bounds["*"])
        overlap = min(overlap, limit - 1)
        pieces.sort(key=lambda p: p.piece)
        assert all(len(p.text) <= limit for p in pieces) and [p.piece for p in pieces] == list(range(len(pieces)))
        assert all(a.end - b.begin == overlap for a, b in zip(pieces, pieces[1:]))
        assert pieces[0].text + "".join(p.text[overlap:] for p in pieces[1:]) == rows[key][3]
    by_section = {}
    for pieces in found.values():
        by_section.setdefault(pieces[0].section, []).extend(p.chunk_index for p in pieces)
    assert all(sorted(v) == list(range(len(v))) for v in by_section.values())


@pytest.mark.parametrize("size", [65_536, 7])
def test_cut_kinds(tables, monkeypatch, size):
    import re

    rows, chunks, limits = tables
    monkeypatch.setattr(split, "RANGE", size)
    bounds = {s: n for s, n, _ in LIMITS}
    want = {}
    for key, (_, _, subpart, body) in rows.items():
        limit = bounds.get(subpart, bounds["*"])
        if body and len(body) > limit:
            want[key] = "forced" if max(map(len, re.split("[ \t\r\n]", body))) > limit else "natural"
    assert {r.chunk_id: r.cut for r in split.oversized(chunks, limits).collect()} == want
    assert split.oversized(chunks.limit(0), limits).count() == 0


def test_natural_boundaries_are_preferred():
    body = "One sentence here. " * 3 + "\n\n" + "Another paragraph. " * 5
    at, rank = split.boundaries(body, 0, len(body))
    import numpy as np

    first = split.cuts(np.array(at), np.array(rank), 0, len(body), 80, 10)[0]
    assert body[: first[1]].endswith("\n\n") and not first[2]


def test_files_by_byte_ranges(spark, tmp_path):
    rng = random.Random(9)
    body = text(rng, 900)
    path = tmp_path / "a.txt"
    path.write_bytes(body.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    for size in (13, 500, 10**6):
        files = [(str(path), path.stat().st_size), (str(tmp_path / "empty.txt"), 0)]
        pieces = sorted(split.split_files(spark, files, 60, 12, size).collect(), key=lambda p: p.piece)
        assert pieces[0].text + "".join(p.text[12:] for p in pieces[1:]) == body
        assert all(len(p.text) <= 60 for p in pieces)


def test_ranges_do_not_change_the_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(split, "SEGMENT", 700)
    body = text(random.Random(11), 1500)
    path = tmp_path / "a.txt"
    path.write_bytes(body.encode())
    files = [(str(path), path.stat().st_size)]
    cut = [sorted((p.piece, p.begin, p.end, p.text) for p in split.split_files(spark, files, 60, 12, size).collect()) for size in (31, 10**6)]
    assert cut[0] == cut[1]
    chunks = spark.createDataFrame([("c", "s", "A", body)], "chunk_id STRING, section STRING, subpart STRING, text STRING")
    limits = spark.createDataFrame([("*", 60, 12)], "subpart STRING, chunk_chars INT, overlap INT")
    assert sorted((p.piece, p.begin, p.end, p.text) for p in split.split(chunks, limits).collect()) == cut[0]


def test_open_ends_across_ranges():
    import re

    for body in ("", "abc", " a", "ab  cd e", "  ", "a\r\nbb ccc"):
        for size in (1, 2, 3, 50):
            last, longest = 0, 0
            for low in range(0, len(body), size):
                first, end, inner = split.open_ends(body, low, min(low + size, len(body)))
                longest = max(longest, inner, low + first - last if first is not None else 0)
                last = low + end if end is not None else last
            assert max(longest, len(body) - last) == max(map(len, re.split("[ \t\r\n]", body)))


def test_corpus(spark):
    texts = [("one line. " * 50,), (None,), ("",), ("zwei 🏛 " * 90,)]
    out = split.split_corpus(spark.createDataFrame(texts, "text STRING").coalesce(1), 100, 0, 64).collect()
    assert "".join(p.text for p in sorted(out, key=lambda p: p.piece)) == "".join(f"{t}\n" for t, in texts if t is not None) and all(len(p.text) <= 100 for p in out)


def test_cut_kinds_come_from_the_pieces(spark, monkeypatch):
    """Without forced pieces there is no forced kind; a forced cut in a run within the limit
    (by the overlap) or in blanks is none either."""
    limits = spark.createDataFrame([("*", 20, 12)], "subpart STRING, chunk_chars INT, overlap INT")
    rows = [("long", "ab " * 9 + "x" * 21 + " cd" * 9), ("solid", "x" * 300), ("overlap", ("y" * 19 + " ") * 8), ("blank", " " * 90), ("words", "ab cd " * 20), ("last", "ab " * 30 + "z" * 21)]
    chunks = spark.createDataFrame([(k, "s", "A", t) for k, t in rows], "chunk_id STRING, section STRING, subpart STRING, text STRING")
    kinds = lambda: {r.chunk_id: r.cut for r in split.oversized(chunks, limits).collect()}
    want = {k: "forced" if k in ("long", "solid", "last") else "natural" for k, _ in rows}
    assert kinds() == want
    monkeypatch.setattr(split, "RANGE", 16)
    monkeypatch.setattr(split, "SEGMENT", 40)
    assert kinds() == want
    table = split.piece_table
    monkeypatch.setattr(split, "piece_table", lambda found, items: table(found, items).withColumn("forced", split.F.lit(False)))
    assert set(kinds().values()) == {"natural"}
