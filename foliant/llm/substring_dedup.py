"""Removal of word sequences that an earlier document has, by difference-cover anchors.

Windows of ``ANCHOR`` words are hashed only where the position modulo ``PERIOD`` is in ``COVER``. As every residue is a difference
of two of the cover, two equal windows of ``WINDOW = ANCHOR + PERIOD - 1`` words share an anchor at the same place within them,
wherever they stand. So only windows around an anchor that another document has are extended to full windows and
compared; of equal ones, those in any but the smallest document are removed.

Hashes travel as packed arrays, one for each bucket of hash values. Before they leave a task, equal hashes
are reduced to one; what a task can decide alone it decides. So a passage in a third of all documents makes one entry a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import WordHashes, as_bytes, map_arrow, materialize, partitions, split_words, windows

PERIOD, COVER, ANCHOR = 7, (0, 1, 3), 7
WINDOW = ANCHOR + PERIOD - 1
#: Hashes that a task holds before it sends them.
FLUSH = 1_000_000
#: Entries of a bucket, about.
BUCKET = 2_000_000
_PACKED = "bucket int, sure boolean, n int, hashes binary, more binary, docs binary, places binary"
#: An anchor's hash has so many bits more than the number of anchors, so that few meet by chance; those that do are told apart when extended to windows.
#: A window's hash has 64 bits and ``MORE`` bytes of a second one: with a million million windows, the odds that any two differ and agree are about one in a hundred thousand.
SPARE_BITS, MORE = 10, 4


class Widths:
    """How many buckets hashes go to, and how many lower bytes of an anchor's hash travel besides its bucket, which its upper bits give: both from the number of words."""

    def __init__(self, n_words: int, parts: int):
        self.buckets = max(4 * parts, -(-n_words // BUCKET))
        bits = max(n_words, 1).bit_length() + SPARE_BITS - (self.buckets.bit_length() - 1)
        self.anchor = min(8, max(1, -(-bits // 8)))


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and hashes of a document's anchors, from its word hashes."""
    n = len(h) - ANCHOR + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    at = np.arange(n)
    at = at[np.isin(at % PERIOD, COVER)]
    return at, windows(h, ANCHOR)[at]


def _planes(x: np.ndarray, kind: str, width: int) -> bytes:
    """Differences of neighbours, lowest bytes of all first: what changes little then compresses well."""
    d = np.diff(x.astype(kind), prepend=np.zeros(1, kind))
    return d.view(np.uint8).reshape(-1, np.dtype(kind).itemsize)[:, :width].T.tobytes()


def _unplane(data: bytes, kind: str, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.cumsum(np.frombuffer(data, np.uint8).reshape(size, n).T.copy().view(kind).ravel(), dtype=kind)


def _low_bytes(h: np.ndarray, width: int) -> bytes:
    return h.view(np.uint8).reshape(-1, 8)[:, :width].tobytes()


def _from_low_bytes(data: bytes, width: int) -> np.ndarray:
    own = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(own), 8), np.uint8)
    out[:, :width] = own
    return out.view(np.uint64).ravel()


def _starts(runs: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
    new = runs[1:] != runs[:-1]
    return np.flatnonzero(np.concatenate(([True], new if more is None else new | (more[1:] != more[:-1]))))


def _send(h: np.ndarray, more: np.ndarray, doc: np.ndarray, place: np.ndarray, widths: Widths, both: bool) -> Iterator[pa.RecordBatch]:
    """What a task sends of its entries: those it can decide alone (``sure``), and of each hash the smallest document's.

    Decided are entries whose hash a smaller document has or, with ``both``, any other document.
    """
    order = np.lexsort((place, doc, more, h)) if MORE and not both else np.lexsort((place, doc, h))
    h, more, doc, place = h[order], more[order], doc[order], place[order]
    first = _starts(h, more)
    run = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(h))))
    least = doc[first][run]
    later = doc != least
    most = doc[np.append(first[1:], len(h)) - 1][run]
    bucket = (((h >> np.uint64(32)) * np.uint64(widths.buckets)) >> np.uint64(32)).astype(np.int64)
    rows: list[list] = [[], [], [], [], [], [], []]
    for kind in (False, True):
        chosen = ((most != least) if both else later) if kind else ~later
        b, hs, ms, ds, ps = (x[chosen] for x in (bucket, h, more, doc, place))
        if not len(b):
            continue
        order = np.lexsort((ps, ds, b))
        b, hs, ms, ds, ps = b[order], hs[order], ms[order], ds[order], ps[order]
        edges = np.append(_starts(b), len(b))
        for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            # of decided anchors only the place matters; a decided window's hash tells rows of one id apart
            hashes = (b"" if kind else _low_bytes(hs[s:e], widths.anchor)) if both else _low_bytes(hs[s:e], 8)
            values = (int(b[s]), kind, e - s, hashes, b"" if both or kind else _low_bytes(ms[s:e], MORE), _planes(ds[s:e], "<i8", 8), _planes(ps[s:e], "<i4", 4))
            for column, value in zip(rows, values, strict=True):
                column.append(value)
    types = (pa.int32(), pa.bool_(), pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=["bucket", "sure", "n", "hashes", "more", "docs", "places"])


class _Entries:
    """Entries of a task, sent when there are many."""

    def __init__(self, widths: Widths, both: bool):
        self.widths, self.both, self.held, self.n = widths, both, [], 0

    def add(self, h: np.ndarray, more: np.ndarray, doc: int, place: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((h, more, np.full(len(h), doc, np.int64), place))
        self.n += len(h)
        if self.n >= FLUSH:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.n:
            yield from _send(*(np.concatenate([x[k] for x in self.held]) for k in range(4)), self.widths, self.both)
        self.held, self.n = [], 0


def _meet(packed: DataFrame, widths: Widths, both: bool) -> DataFrame:
    """``doc_id, place`` of entries whose hash any other document has or, without ``both``, ``doc_id, place, hash`` of those whose hash a smaller document has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        now = None

        def settle() -> Iterator[pa.RecordBatch]:
            if held:
                h, more, doc, place = (np.concatenate([x[k] for x in held]) for k in range(4))
                held.clear()
                order = np.lexsort((doc, h)) if both else np.lexsort((doc, more, h))
                h, more, doc, place = h[order], more[order], doc[order], place[order]
                first = _starts(h, more)
                sizes = np.diff(np.append(first, len(h)))
                least, most = np.repeat(doc[first], sizes), np.repeat(doc[np.append(first[1:], len(h)) - 1], sizes)
                keep = (most != least) if both else (doc != least)
                yield from out(doc[keep], place[keep], h[keep])

        def out(*columns: np.ndarray) -> Iterator[pa.RecordBatch]:
            names = ["doc_id", "place"] if both else ["doc_id", "place", "hash"]
            for k in range(0, len(columns[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[k : k + 200_000].view(np.int64) if c.dtype == np.uint64 else c[k : k + 200_000]) for c, _ in zip(columns, names, strict=False)], names=names)

        for batch in batches:
            for bucket, sure, n, h, more, doc, place in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                if bucket != now:
                    yield from settle()
                    now = bucket
                d, p = _unplane(doc, "<i8", n), _unplane(place, "<i4", n)
                if sure:
                    yield from out(d, p, *(() if both else (_from_low_bytes(h, 8),)))
                else:
                    held.append((_from_low_bytes(h, widths.anchor if both else 8), np.zeros(n, np.uint64) if both else _from_low_bytes(more, MORE), d, p))
        yield from settle()

    buckets = packed.repartition(partitions(packed.sparkSession), "bucket").sortWithinPartitions("bucket")
    return map_arrow(buckets, run, "doc_id long, place int" if both else "doc_id long, place int, hash long")


def _squeeze(text: bytes | None) -> bytes | None:
    """Text as it waits in tables for its next look: its length, and zstd."""
    return None if text is None else len(text).to_bytes(8, "little") + pa.compress(text, "zstd", asbytes=True)


def _expand(data: bytes | None) -> bytes | None:
    return None if data is None else pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _digest(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", texts: bool = True) -> DataFrame:
    """Each row's ``doc_id, n_words, n_removed, spans, kept_sha256`` and, with ``texts``, the kept words joined by one space.

    A word is removed if a window of 13 words covers it whose word sequence also starts in a document with a smaller id; windows are
    judged on the input. ``spans`` holds the removed words' ranges ``[start, end)``. Null and blank texts have no words. Rows that repeat an id
    are one document with several texts: they don't remove each other's words, and each loses its own. Rows with a null id lose and remove nothing. Other columns
    aren't read; an empty table gives no rows. Ids are numbers. A document's places are held at once, so memory grows with the longest text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # most words that so many bytes hold
    widths = Widths((rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 2, partitions(docs.sparkSession))

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, entries = WordHashes(), _Entries(widths, both=True)
        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                if doc is not None:
                    at, h = anchors(hashes.of(split_words(text)))
                    yield from entries.add(h, np.zeros(len(h), np.uint64), doc, at)
        yield from entries.flush()

    # of all rows of an id: places only say where to look closer
    shared = _meet(map_arrow(rows, send_anchors, _PACKED), widths, both=True).groupBy("doc_id").agg(F.collect_set("place").alias("places"))

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(_squeeze, as_bytes(batch.column(1))), pa.binary())], names=["doc_id", "text"])

    def near_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents' starts of windows to compare, as runs; those without any are done."""
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text, places in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                w = split_words(_expand(text))
                runs = np.empty((0, 2), np.int32)
                if places and len(w) >= WINDOW:
                    mark = np.zeros(len(w) + 2, np.int32)
                    p = np.array(places, np.int64)
                    p = p[p <= len(w) - ANCHOR]
                    np.add.at(mark, np.maximum(p - PERIOD + 1, 0), 1)
                    np.add.at(mark, np.minimum(p + 1, len(w) - WINDOW + 1), -1)
                    edges = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(mark) > 0).view(np.int8), [0]))))
                    runs = edges.reshape(-1, 2).astype(np.int32)
                done = not len(runs)
                for column, value in zip(out, (doc, len(w), None if done and not texts else text, runs.tobytes(), _digest(w) if done else None), strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "n_words", "text", "runs", "sha"])

    judged = materialize(map_arrow(map_arrow(rows, squeeze, "doc_id long, text binary").join(shared, "doc_id", "left"), near_anchors, "doc_id long, n_words long, text binary, runs binary, sha string"), "judged")

    def send_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, entries = WordHashes(), _Entries(widths, both=False)
        for batch in batches:
            for doc, text, runs in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                h = hashes.of(split_words(_expand(text)))
                at = np.concatenate([np.arange(s, e) for s, e in np.frombuffer(runs, np.int32).reshape(-1, 2)])
                yield from entries.add(windows(h, WINDOW)[at], windows(h, WINDOW, 1)[at] >> np.uint64(64 - 8 * MORE), doc, at)
        yield from entries.flush()

    found = _meet(map_arrow(judged.where("sha is null and doc_id is not null").select("doc_id", "text", "runs"), send_windows, _PACKED), widths, both=False)
    repeats = found.groupBy("doc_id").agg(F.collect_set(F.struct("place", "hash")).alias("places"))

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            out: list[list] = [[], [], [], [], [], []]
            lists = batch.column(4)
            ends, flat = lists.offsets.to_numpy(), lists.values
            every, told = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            for k, (doc, n, text, sha) in enumerate(zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True)):
                w, spans, n_removed = None, [], 0
                if ends[k + 1] > ends[k] and sha is None:
                    w = split_words(_expand(text))
                    # an id's places are those of all its rows: a row's own have the hashes of its own windows
                    p, own = every[ends[k] : ends[k + 1]].astype(np.int64), windows(hashes.of(w), WINDOW).view(np.int64)
                    inside = p < len(own)
                    p = p[inside][own[p[inside]] == told[ends[k] : ends[k + 1]][inside]]
                    mark = np.zeros(n + 1, np.int32)
                    np.add.at(mark, p, 1)
                    np.add.at(mark, p + WINDOW, -1)
                    gone = np.cumsum(mark[:-1]) > 0
                    spans = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0])))).reshape(-1, 2).tolist()
                    n_removed = int(gone.sum())
                    w = [x for x, g in zip(w, gone.tolist(), strict=True) if not g]
                elif sha is None or texts:
                    w = split_words(_expand(text))
                row = (doc, n, n_removed, [{"start": s, "end": e} for s, e in spans], sha or _digest(w), b" ".join(w).decode() if texts else None)
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "n_words", "n_removed", "spans", "kept_sha256", "text"])

    last = judged.select("doc_id", "n_words", "text", "sha").join(repeats, "doc_id", "left")
    out = map_arrow(last, remove, "doc_id long, n_words long, n_removed long, spans array<struct<start:int,end:int>>, kept_sha256 string, text string")
    return out if texts else out.drop("text")
