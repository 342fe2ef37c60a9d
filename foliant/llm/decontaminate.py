"""Benchmark decontamination by an FM-index of each shard of the training texts.

A shard's index is the Burrows-Wheeler transform of all its words with wavelet-matrix ranks and sampled suffix positions. Indexes are built once, whatever the
benchmark, and kept as a table. Windows of the benchmark are searched backwards in each of them, all at once; their occurrences are
located by walking to the next sample; the words they cover are merged into spans. A benchmark of any size is searched block by block.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import WordHashes, as_bytes, map_arrow, materialize, sort_order
from foliant.llm.lm_score import planes, unplane

WIDTH = 10
#: Bytes of text in a shard, about; bytes of benchmark items searched at once, at most.
SHARD_BYTES, BLOCK_BYTES = 4_000_000, 16_000_000
SAMPLE = 8
_SEPARATORS = bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
_TO_SPACE = bytes(0x20 if i in _SEPARATORS else i for i in range(256))
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text: bytes | None) -> list[bytes]:
    """Lower-cased words of ASCII letters, digits and anything beyond ASCII."""
    return text.lower().translate(_TO_SPACE).split() if text else []


class FMIndex:
    """Full-text index of an array of symbols 0..top; 0 separates and isn't searched for."""

    def __init__(self, last: np.ndarray, top: int, sampled: np.ndarray, samples: np.ndarray):
        """``last``: the symbol before each suffix, in their order; ``sampled``: which suffixes' positions are in ``samples``."""
        self.n, self.top, self.last = len(last), top, last
        self.before = np.concatenate(([0], np.cumsum(np.bincount(last, minlength=top + 1))))[: top + 1].astype(np.int64)
        self.levels, self.bits = [], max(1, int(top).bit_length())
        current = last
        for level in reversed(range(self.bits)):
            bit = (current >> level) & 1
            self.levels.append((level, np.concatenate(([0], np.cumsum(bit, dtype=np.int32))), int(self.n - bit.sum())))
            current = np.concatenate((current[bit == 0], current[bit == 1]))
        self.sampled, self.sample_rank, self.samples = sampled, np.cumsum(sampled, dtype=np.int32) - 1, samples

    @classmethod
    def of(cls, text: np.ndarray, top: int) -> FMIndex:
        """Index of a text that ends with 0."""
        order = cls._suffixes(text, top)
        last = text[order - 1]  # the first suffix wraps to the final separator
        # starts of stretches too: no walk crosses a separator, whose rows the wrap would misplace
        sampled = (order % SAMPLE == 0) | (last == 0)
        return cls(last, top, sampled, order[sampled])

    def to_bytes(self) -> bytes:
        """What the index is made of; ranks are computed anew."""
        return pickle.dumps((self.n, self.top, planes(self.last.astype("<u4")), np.packbits(self.sampled).tobytes(), len(self.samples), planes(self.samples.astype("<u4"))))

    @classmethod
    def from_bytes(cls, data: bytes) -> FMIndex:
        n, top, last, sampled, m, samples = pickle.loads(data)
        return cls(unplane(last, "<u4", n).astype(np.int64), top, np.unpackbits(np.frombuffer(sampled, np.uint8), count=n).astype(bool), unplane(samples, "<u4", m).astype(np.int64))

    @staticmethod
    def _suffixes(text: np.ndarray, top: int) -> np.ndarray:
        """Suffix array by doubling; each round sorts only suffixes that aren't told apart yet.

        A suffix' rank is the place of the first that is equal to it so far.
        """
        n, bits = len(text), max(1, int(top + 1).bit_length())
        width = max(1, 63 // bits)
        padded = np.concatenate((text.astype(np.uint64) + np.uint64(1), np.zeros(width, np.uint64)))
        key = np.zeros(n, np.uint64)
        for k in range(width):
            key = (key << np.uint64(bits)) | padded[k : k + n]
        rank, active, k = np.zeros(n, np.int64), np.arange(n), 0
        shift = np.uint64(max(0, 64 - 2 * (n + 1).bit_length()))
        while len(active):
            if k:
                after = np.zeros(len(active), np.int64)
                inside = active + k < n
                after[inside] = rank[active[inside] + k] + 1
                key = (rank[active] * (n + 1) + after).astype(np.uint64) << shift
            order = sort_order(key)
            active, key = active[order], key[order]
            old = rank[active]
            new = np.concatenate(([True], key[1:] != key[:-1]))
            group = np.concatenate(([True], old[1:] != old[:-1]))
            at = np.arange(len(active))
            first, start = np.maximum.accumulate(np.where(new, at, 0)), np.maximum.accumulate(np.where(group, at, 0))
            rank[active] = old + first - start
            alone = new & np.append(new[1:], True)
            active = active[~alone]
            k = 2 * k or width
        out = np.empty(n, np.int64)
        out[rank] = np.arange(n)
        return out

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often a symbol comes before a place of the transform."""
        start, end = np.zeros_like(at), at
        for level, ones, zeros in self.levels:
            bit = ((symbol >> level) & 1).astype(bool)
            start = np.where(bit, zeros + ones[start], start - ones[start])
            end = np.where(bit, zeros + ones[end], end - ones[end])
        return end - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Patterns (rows) that occur: their numbers, and first and past-last rows of the suffix array."""
        alive = np.arange(len(patterns))
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for k in reversed(range(patterns.shape[1])):
            symbol = patterns[alive, k]
            lo, hi = self.before[symbol] + self.rank(symbol, lo), self.before[symbol] + self.rank(symbol, hi)
            found = lo < hi
            alive, lo, hi = alive[found], lo[found], hi[found]
        return alive, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix array rows: steps back to a sampled one."""
        out, steps, todo = np.empty(len(rows), np.int64), 0, np.arange(len(rows))
        rows = rows.copy()
        while len(todo):
            ready = self.sampled[rows]
            out[todo[ready]] = self.samples[self.sample_rank[rows[ready]]] + steps
            todo, rows, steps = todo[~ready], rows[~ready], steps + 1
            symbol = self.last[rows]
            rows = self.before[symbol] + self.rank(symbol, rows)
        return out


class Patterns:
    """Distinct windows of benchmark items, by width, as places in a sorted table of words' hashes, and the items each belongs to."""

    def __init__(self, items: list[tuple[str, bytes]], width: int):
        hashes, by, all_ = WordHashes(), {}, set()
        for item, text in items:
            w = hashes.of(words(text)).tolist()
            all_.update(w)
            for k in range(max(1, len(w) - width + 1) if w else 0):
                by.setdefault(tuple(w[k : k + width]), set()).add(item)
        self.words = np.array(sorted(all_), np.uint64)
        self.groups = []
        for m in sorted({len(x) for x in by}):
            keys = [x for x in by if len(x) == m]
            self.groups.append((m, np.searchsorted(self.words, np.array(keys, np.uint64)), [sorted(by[x]) for x in keys]))

    def scan(self, index: FMIndex, vocabulary: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which words of a shard are covered, and the items found in each document; ``doc`` is the document of each place."""
        at = np.minimum(np.searchsorted(vocabulary, self.words), max(len(vocabulary) - 1, 0))
        symbol = np.where(vocabulary[at] == self.words, at + 1, 0) if len(vocabulary) else np.zeros(len(self.words), np.int64)
        cover, found = np.zeros(index.n + 1, np.int64), {}
        for m, windows, items in self.groups:
            here = symbol[windows]
            alive = np.flatnonzero((here > 0).all(axis=1))
            which, lo, hi = index.search(here[alive])
            n = hi - lo
            places = index.locate(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum()))
            pattern = np.repeat(alive[which], n)
            np.add.at(cover, places, 1)
            np.add.at(cover, places + m, -1)
            for d, p in np.unique(np.stack((doc[places], pattern)), axis=1).T.tolist():
                found.setdefault(d, set()).update(items[p])
        return np.cumsum(cover[:-1]) > 0, found


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans without overlaps; touching ones become one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """Text without the characters from the first to the last word of each span."""
    places = [m.span() for m in _WORD.finditer(text.lower())]
    out, last = [], 0
    for s, e in spans:
        out.append(text[last : places[s][0]])
        last = places[e - 1][1]
    return b"".join([*out, text[last:]])


_ADDED = {"n_words": "long", "spans": "array<struct<start:int,end:int>>", "items": "array<string>"}
_SHARDS = "shard long, lengths binary, vocabulary binary, index binary, rows binary"
_FOUND = "shard long, spans array<struct<doc:int,start:int,end:int>>, items array<struct<doc:int,item:string>>"


def index_shards(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """A table of shards: the FM-index of their words, its vocabulary, the texts' numbers of words, and the rows' ``keep`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, shard = WordHashes(), TaskContext.get().partitionId() << 33

        def emit(held: list[pa.RecordBatch], texts: list[np.ndarray]) -> pa.RecordBatch:
            lengths = np.array([len(t) for t in texts], np.int64)
            # each text ends with a separator
            vocabulary, ids = np.unique(np.concatenate(texts), return_inverse=True)
            symbols = np.zeros(len(ids) + len(texts), np.int64)
            symbols[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), lengths)] = ids + 1
            index = FMIndex.of(symbols, len(vocabulary)).to_bytes()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for batch in held:
                    out.write_batch(batch)
            values = ((shard, pa.int64()), (lengths.tobytes(), pa.binary()), (vocabulary.tobytes(), pa.binary()), (index, pa.binary()), (sink.getvalue().to_pybytes(), pa.binary()))
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in values], names=["shard", "lengths", "vocabulary", "index", "rows"])

        held, texts, size, first = [], [], 0, 0
        for batch in batches:
            first, carried = 0, batch.select(list(keep))
            for k, text in enumerate(as_bytes(batch.column(batch.num_columns - 1))):
                texts.append(hashes.of(words(text)))
                size += len(text or b"")
                if size >= SHARD_BYTES:
                    held.append(carried.slice(first, k + 1 - first))
                    yield emit(held, texts)
                    held, texts, size, first, shard = [], [], 0, k + 1, shard + 1
            if first < batch.num_rows:
                held.append(carried.slice(first))
        if held:
            yield emit(held, texts)

    return materialize(map_arrow(docs.select(*keep, F.col(text_col).cast("string").alias("__text")), run, _SHARDS), "shards")


def _blocks(items: DataFrame, width: int) -> Iterator[list[tuple[str, bytes]]]:
    """Items in blocks of at most ``BLOCK_BYTES``; a longer item comes in parts that share all but one word of a window."""
    held, size = [], 0
    for row in items.toLocalIterator():
        text = row["text"].encode()
        parts = [text]
        if len(text) > BLOCK_BYTES:
            w, per = words(text), max(width, BLOCK_BYTES // (2 * max(1, max(map(len, words(text)), default=1) + 1)))
            parts = [b" ".join(w[k : k + per + width - 1]) for k in range(0, max(1, len(w) - width + 1), per)]
        for part in parts:
            if held and size + len(part) > BLOCK_BYTES:
                yield held
                held, size = [], 0
            held.append((row["item"], part))
            size += len(part)
    yield held


def _search(shards: DataFrame, block: list[tuple[str, bytes]], width: int) -> DataFrame:
    """Covered spans and found items of each shard, by the document's number in it."""
    shared = shards.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(shared.value, width)
        for batch in batches:
            for shard, lengths, vocabulary, index in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                lengths = np.frombuffer(lengths, np.int64)
                doc = np.repeat(np.arange(len(lengths)), lengths + 1)
                hit, items = patterns.scan(FMIndex.from_bytes(index), np.frombuffer(vocabulary, np.uint64), doc)
                starts = np.cumsum(lengths + 1) - lengths - 1
                edges = np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))
                spans = [{"doc": int(d), "start": int(s - starts[d]), "end": int(e - starts[d])} for s, e in edges.reshape(-1, 2) for d in (doc[s],)]
                found = [{"doc": d, "item": x} for d, xs in items.items() for x in sorted(xs)]
                if spans:
                    kinds = (pa.int64(), pa.list_(pa.struct([("doc", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("doc", pa.int32()), ("item", pa.string())])))
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, spans, found), kinds, strict=True)], names=["shard", "spans", "items"])

    return materialize(map_arrow(shards.select("shard", "lengths", "vocabulary", "index"), run, _FOUND), "found")


def find_contamination(docs: DataFrame, benchmark: DataFrame, keep: tuple[str, ...] = ("doc_id",), width: int = WIDTH, text_col: str = "text", item_col: str = "item_id", cut: bool = False) -> DataFrame:
    """``keep`` columns of each row of ``docs``, with ``n_words``, merged ``spans`` of covered words and the ``items`` found, sorted.

    A window is ``width`` consecutive words of an item, or a shorter item whole. With ``cut``, ``text`` (which ``keep`` must name)
    loses the spans. Null and blank texts have no words; null items are ignored; rows that repeat are each judged. An empty table gives no rows, an empty benchmark no
    spans. Columns of the added names are replaced. The texts are indexed once, in shards that hold whole texts (memory grows with the longest). The benchmark reaches the driver and
    every worker in blocks of at most ``BLOCK_BYTES``, one search of all indexes each, so it may be of any size; only what is found is shuffled, by shard.
    """
    keep = tuple(dict.fromkeys(k for k in keep if k not in _ADDED))
    items = benchmark.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    shards = index_shards(docs, keep, text_col)
    found = None
    for block in _blocks(items, width):
        more = _search(shards, block, width)
        found = more if found is None else found.unionAll(more)
    # what one shard's documents hold, of all blocks
    by_shard = found.groupBy("shard").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))
    fields = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lengths, data, spans, named in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                lengths, table = np.frombuffer(lengths, np.int64), pa.ipc.open_stream(data).read_all().combine_chunks()
                by: list[list[tuple[int, int]]] = [[] for _ in lengths]
                got: list[set[str]] = [set() for _ in lengths]
                for x in spans or ():
                    by[x["doc"]].append((x["start"], x["end"]))
                for x in named or ():
                    got[x["doc"]].add(x["item"])
                by = [merge_spans(x) if x else x for x in by]
                columns = {c: table[c] for c in keep}
                if cut:
                    columns[text_col] = pa.array([cut_words(t.encode(), x).decode() if x else t for t, x in zip(table[text_col].to_pylist(), by, strict=True)], pa.string())
                added = (pa.array(lengths), pa.array([[{"start": s, "end": e} for s, e in x] for x in by], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array([sorted(x) for x in got], pa.list_(pa.string())))
                yield from pa.table([*columns.values(), *added], names=[*keep, *_ADDED]).to_batches()

    schema = ", ".join([*(f"`{c}` {fields[c]}" for c in keep), *(f"{k} {v}" for k, v in _ADDED.items())])
    # what is found may be about as much as the texts: joined by shuffle where it isn't small
    return map_arrow(shards.join(by_shard, "shard", "left").select("lengths", "rows", "spans", "items"), rows, schema)
