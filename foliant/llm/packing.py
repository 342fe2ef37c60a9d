"""Packing of token sequences by bin completion.

Only lengths decide where pieces go, and there are at most ``capacity`` different ones: tasks tokenize and count,
the driver packs the histogram of lengths (bounded by the capacity, whatever the corpus), and pieces
find their place by length and rank.

Best-fit solutions are the incumbents. Where one has more bins than the lower bound, a branch-and-bound over fillings of the largest length left
looks for a packing of one bin less: fillings that no other dominates, in order of their waste, pruned by the waste that such a packing may have.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliant.llm.common import as_bytes, map_arrow, materialize, mix

CAPACITY, END = 4096, 1
#: Steps of a search for a packing of one bin less.
NODES = 2_000
#: Distinct parts of texts whose ids a worker remembers, about 200 bytes each; bytes of texts it encodes at once.
CACHE_PARTS, BATCH_BYTES = 500_000, 1_000_000


class Tokens:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    Tokenizers that drop white space and never merge across it give a text the ids of its parts between ASCII white space, one part after the
    other. Parts are told by a 64-bit hash, computed for a whole batch of texts at once; those not met before are encoded together and their ids
    remembered, up to a bound. Any other tokenizer encodes texts whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.suffix = spec["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.whole.get_vocab_size(with_added_tokens=True), bool)
        if self.suffix:
            self.ends[[i for t, i in self.whole.get_vocab(with_added_tokens=True).items() if t.endswith(self.suffix)]] = True
        normal = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.by_part = (
            normal == ["NFC", "Replace", "Lowercase"] and steps[0].get("type") == "Split" and steps[0].get("invert") and steps[0].get("behavior") == "Removed" and steps[0]["pattern"].get("Regex") == _PATTERN
            and not spec["model"].get("dropout") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] or re.search(r"\s", t["content"]) for t in spec.get("added_tokens", []))
        )
        self._forget()

    def _forget(self) -> None:
        """Parts by hash: sorted hashes, and where each one's ids stand in one array."""
        self.hashes, self.first, self.count = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.ids, self.filled = np.empty(1 << 16, "<u4"), 0

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_parts(self, parts: list[bytes]) -> list[bytes]:
        """Ids of distinct parts. Words of plain letters are one piece each, whose last token says so: they are encoded as one text and told apart."""
        plain = [k for k, x in enumerate(parts) if _LETTERS.fullmatch(x.decode())] if self.suffix else []
        out: list[bytes] = [b""] * len(parts)
        ids = np.array(self.whole.encode_batch_fast([b" ".join([parts[k] for k in plain]).decode()], add_special_tokens=False)[0].ids, "<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        rest = list(range(len(parts)))
        if len(cuts) == len(plain):
            data, edges = ids.tobytes(), (4 * np.concatenate(([0], cuts))).tolist()
            for k, a, b in zip(plain, edges, edges[1:], strict=False):
                out[k] = data[a:b]
            done = set(plain)
            rest = [k for k in rest if k not in done]
        for k, x in zip(rest, self._ids([parts[k].decode() for k in rest]), strict=True):
            out[k] = x
        return out

    def _learn(self, hashes: np.ndarray, parts: list[bytes]) -> None:
        if len(self.hashes) + len(hashes) > CACHE_PARTS:
            self._forget()
        encoded = self._encode_parts(parts)
        count = np.fromiter(map(len, encoded), np.int64, len(encoded)) // 4
        new = np.frombuffer(b"".join(encoded), "<u4")
        while self.filled + len(new) > len(self.ids):
            self.ids = np.concatenate((self.ids, np.empty(len(self.ids), "<u4")))
        self.ids[self.filled : self.filled + len(new)] = new
        first = self.filled + np.cumsum(count) - count
        self.filled += len(new)
        every = np.concatenate((self.hashes, hashes))
        order = np.argsort(every, kind="stable")
        self.hashes, self.first, self.count = every[order], np.concatenate((self.first, first))[order], np.concatenate((self.count, count))[order]

    def _find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each hash stands among the known ones, and whether it does."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_part:
            return self._ids([t.decode() for t in texts])
        joined = b"\n".join(texts) + b"\n"
        if b"<|" not in joined and b"\xcc" not in joined and b"\xcd" not in joined:
            joined = joined.lower()  # no special tokens, no marks that join a letter of either case differently
        starts, lengths = cut_parts(joined)
        hashes = hash_parts(joined, starts, lengths)
        distinct, where, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        at, known = self._find(distinct)
        if not known.all():
            lost = len(self.hashes) + int((~known).sum()) > CACHE_PARTS
            new = np.arange(len(distinct)) if lost else np.flatnonzero(~known)
            self._learn(distinct[new], [joined[s : s + n] for s, n in zip(starts[where[new]].tolist(), lengths[where[new]].tolist(), strict=True)])
            at, _ = self._find(distinct)
        first, count = (x[at][inverse] if len(at) else x for x in (self.first, self.count))
        past = np.cumsum(count)
        ids = self.ids[np.repeat(first - (past - count), count) + np.arange(int(past[-1]) if len(past) else 0)]
        # a text's parts are those that start before its end
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
        upto = np.concatenate(([0], past))[np.searchsorted(starts, ends)]
        data, edges = ids.tobytes(), (4 * np.concatenate(([0], upto))).tolist()
        return [data[a:b] for a, b in zip(edges, edges[1:], strict=False)]


def cut_parts(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the parts of a text that ends with white space.

    A letter and a sign after it are always split, and signs without a letter after them are one piece: so signs between an ASCII letter and white space are a
    part of their own (but for those that end special tokens).
    """
    kind = _KIND[np.frombuffer(data, np.uint8)]
    space = kind == 0
    after_space = np.concatenate(([True], space[:-1]))
    begins = ~space & after_space
    sign_after_letter = np.flatnonzero((kind[1:] == 2) & (kind[:-1] == 1)) + 1
    other = np.flatnonzero(kind != 2)
    stop = other[np.searchsorted(other, sign_after_letter)]
    begins[sign_after_letter[space[stop]]] = True
    starts = np.flatnonzero(begins)
    # a part ends at the next white space or the next start
    spaces = np.flatnonzero(space & ~after_space)
    ends = spaces[np.searchsorted(spaces, starts)]
    ends[:-1] = np.minimum(ends[:-1], starts[1:])
    return starts, ends - starts


def hash_parts(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of parts of a text, eight bytes at a time."""
    padded = np.frombuffer(data + bytes(8), np.uint8)
    eight = np.lib.stride_tricks.as_strided(padded, (len(data), 8), (1, 1))
    out = mix(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    left, at, open_ = lengths, starts, np.arange(len(starts))
    while len(open_):
        block = np.ascontiguousarray(eight[at]).view("<u8").ravel() & _MASKS[np.minimum(left, 8)]
        out[open_] = mix((out[open_] ^ block) * np.uint64(0x9FB21C651E98DF25) + np.uint64(1))
        keep = left > 8
        open_, at, left = open_[keep], at[keep] + 8, left[keep] - 8
    return out


_SIGNS = b".,;:!?#*$%&|)]}\"'-/@+=~^_`"
#: 0 white space, 1 ASCII letters, 2 signs, 3 anything else.
_KIND = np.full(256, 3, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = 1
_KIND[list(_SIGNS)] = 2
_MASKS = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
#: Letters that are one code point in every normal form and in lower case.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-įı-ňŊ-ſ]+")
#: Fixed value: a pattern whose pieces hold no white space.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_TOKENS: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """The worker's own tokenizer, kept from task to task."""
    if path not in _TOKENS:
        _TOKENS[path] = Tokens(path)
    return _TOKENS[path]


Fillings = list[tuple[tuple[int, ...], int]]


def _fullest(lengths: list[int], left: dict[int, int], room: int) -> list[int]:
    """The parts, of those left, that come nearest to ``room`` from below: an exact subset sum over all lengths and as many parts as fit.

    Bit t of ``sums`` is set if some parts make t; parts of one length go in by powers of two. The sums before each step are kept
    to go back from the best one. The first exact sum ends the search.
    """
    sums, steps, within = 1, [], (1 << (room + 1)) - 1
    for x in lengths:
        n, times = min(left[x], room // x), 1
        while n > 0:
            k = min(times, n)
            steps.append((x, k, sums))
            sums |= (sums << (k * x)) & within
            n -= k
            times *= 2
        if sums >> room:
            break
    at, out = sums.bit_length() - 1, []
    for x, k, before in reversed(steps):
        if not before >> at & 1:
            out += [x] * k
            at -= k * x
    return out


def _tables(histogram: Counter, capacity: int, large_first: bool = True) -> Fillings:
    """Fillings of bins, each with how many bins are filled so; all lengths of the histogram are used up.

    Bin completion: the largest remaining length is filled up with the others that leave the least waste, however many they are; of
    equal ones those with large parts, or with small ones. Equal bins are filled at once, as often as the counts allow: each filling uses up a length.
    """
    left = {k: v for k, v in histogram.items() if v > 0}
    lengths = sorted(left)
    used: Fillings = []
    while lengths:
        top = lengths[-1]
        left[top] -= 1
        filling = (top, *_fullest(lengths[::-1] if large_first else lengths, left, capacity - top))
        left[top] += 1
        need = Counter(filling)
        times = min(left[k] // v for k, v in need.items())
        used.append((filling, times))
        for k, v in need.items():
            left[k] -= times * v
            if not left[k]:
                del left[k], lengths[bisect.bisect_left(lengths, k)]
    return used


def _bins(found: Fillings) -> int:
    return sum(times for _, times in found)


def _opened(found: Fillings, capacity: int, share: int) -> tuple[Fillings, Counter]:
    """All bins with waste, and ``share`` times as many of the full ones (the last filled first), emptied: the bins that stay, and the parts to fill anew."""
    wasteful = [f for f in found if sum(f[0]) < capacity]
    budget, kept, again = share * _bins(wasteful), [], Counter()
    for filling, times in reversed([f for f in found if sum(f[0]) == capacity]):
        n = min(times, budget)
        budget -= n
        if times > n:
            kept.append((filling, times - n))
        if n:
            wasteful.append((filling, n))
    for filling, times in wasteful:
        for x in filling:
            again[x] += times
    return kept[::-1], again


def _completions(left: dict[int, int], room: int, slack: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Undominated ways to fill ``room`` up to ``slack`` waste with parts of ``left``, with their waste, least first.

    A filling is dominated if a part left over could be added, or put in place of a smaller one.
    """
    lengths = sorted((x for x in left if left[x] and x <= room), reverse=True)
    reach, within = [1], (1 << (room + 1)) - 1  # sums that the lengths from each one on can make, however often
    for x in reversed(lengths):
        sums, n, times = reach[0], min(left[x], room // x), 1
        while n > 0:
            k = min(times, n)
            sums |= (sums << (k * x)) & within
            n, times = n - k, 2 * times
        reach.insert(0, sums)

    def exact(at: int, target: int) -> Iterator[tuple[int, ...]]:
        if not target:
            yield ()
        elif at < len(lengths) and reach[at] >> target & 1:
            x = lengths[at]
            for n in range(min(left[x], target // x), -1, -1):
                for rest in exact(at + 1, target - n * x):
                    yield (x,) * n + rest

    for waste in range(min(slack, room) + 1):
        if reach[0] >> (room - waste) & 1:
            for parts in exact(0, room - waste):
                used = Counter(parts)
                over = [x for x in lengths if left[x] > used[x]]
                if not any(x <= waste for x in over) and not any(y < x <= y + waste for y in used for x in over):
                    yield parts, waste


def search(histogram: Counter, capacity: int, bins: int, nodes: int) -> Fillings | None:
    """A packing into at most ``bins``, by branch-and-bound over fillings of the largest length left; none if there is none, or none was found in ``nodes`` steps."""
    left = {k: v for k, v in histogram.items() if v > 0}
    slack = bins * capacity - sum(k * v for k, v in left.items())
    if slack < 0:
        return None
    lengths = sorted(left, reverse=True)
    chosen: list[tuple[int, ...]] = []
    dead: set[tuple] = set()
    stack: list[tuple[tuple, Iterator, int]] = []

    def open_node(slack: int) -> None:
        top = next(x for x in lengths if left[x])
        left[top] -= 1
        stack.append(((slack, tuple(left[x] for x in lengths), top), _completions(left, capacity - top, slack), slack))

    if not any(left.values()):
        return []
    open_node(slack)
    while stack and nodes:
        nodes -= 1
        (_, _, top), options, slack = stack[-1]
        if len(chosen) == len(stack):  # undo this node's last choice
            for x in chosen.pop():
                left[x] += 1
        parts, waste = next(options, (None, 0))
        if parts is None:
            stack.pop()
            left[top] += 1
            dead.add((slack, tuple(left[x] for x in lengths)))
            continue
        for x in parts:
            left[x] -= 1
        chosen.append(parts)
        if not any(left.values()):
            return [((node[2], *parts), 1) for (node, _, _), parts in zip(stack, chosen, strict=True)]
        if (slack - waste, tuple(left[x] for x in lengths)) not in dead:
            open_node(slack - waste)
    return None


def fillings(histogram: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> Fillings:
    """The fewest bins found for a histogram of lengths, as (lengths in a bin, number of such bins).

    Bins are completed exactly, with large and with small parts. Where that doesn't end at the lower bound, bins are reopened and filled anew, and searched for a packing of
    one bin less in ``nodes`` steps for each share of full bins that is reopened, until nothing saves any. The problem is NP-hard: ``nodes`` bounds the search, not the input;
    what still lies above the bound need not be the least, nor need the bound be reached by any packing.
    """
    if any(k > capacity or k <= 0 for k in histogram):
        raise ValueError("lengths must be from 1 to the capacity")
    low = lower_bound({k: v for k, v in histogram.items() if v > 0}, capacity)
    best = _tables(Counter(histogram), capacity)
    if _bins(best) > low:
        best = min(best, _tables(Counter(histogram), capacity, False), key=_bins)
    better = True
    while better and _bins(best) > low:
        better = False
        for share in (0, 1, 4):
            kept, again = _opened(best, capacity, share)
            for tried in (_tables(again, capacity), _tables(again, capacity, False), search(again, capacity, _bins(best) - _bins(kept) - 1, nodes)):
                if tried is not None and _bins(kept) + _bins(tried) < _bins(best):
                    best, better = kept + tried, True
                    break
            if better:
                break
    return best


def lower_bound(histogram: dict[int, int], capacity: int = CAPACITY, steps: int = 12) -> int:
    """No packing has fewer bins: bounds by dual feasible functions (Martello and Toth; Fekete and Schepers).

    A length counts as its share of the capacity, or rounded to a whole number of k-ths, for k up to ``steps``; with each cut, lengths below it count as
    nothing and those over the capacity less the cut as a whole bin.
    """
    sizes = sorted((k, v) for k, v in histogram.items() if v > 0)
    if not sizes:
        return 0
    x, v = (np.array(c, object) for c in zip(*sizes, strict=True))  # whole numbers of any size
    cuts = np.array([0, *(k for k, _ in sizes if 2 * k <= capacity)], object)
    first, past = (np.searchsorted(x.astype(int), c) for c in (cuts.astype(int), (capacity - cuts).astype(int) + 1))
    number = np.concatenate(([0], np.cumsum(v)))
    best = 0
    for k in range(steps + 1):
        # shares in units of 1 / (k * (k + 1) * capacity); k = 0: 1 / capacity
        unit = k * (k + 1) * capacity if k else capacity
        share = np.array([a if not k else a * k * (k + 1) if (k + 1) * a % capacity == 0 else (k + 1) * a // capacity * (k + 1) * capacity for a in x], object)
        total = np.concatenate(([0], np.cumsum(share * v)))
        bins = number[-1] - number[past] + -(-(total[past] - total[first]) // unit)
        best = max(best, int(bins.max()))
    return best


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: str = "ids", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``doc_id, piece, start, length, ids | ids_crc32, task, rank``.

    A document is its token ids and then the id 1. ``rank`` counts a task's pieces of equal length. ``ids``: "ids" keeps
    the ids (little-endian unsigned 32-bit), "crc32" their checksum only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, ranks = tokens_of(tokenizer), Counter()
        task = TaskContext.get().partitionId()
        end = END.to_bytes(4, "little")
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary() if ids == "ids" else pa.int64(), pa.int64()]
        names = ["doc_id", "piece", "start", "length", "data", "rank", "task"]

        def emit(docs: list[int | None], texts: list[bytes]) -> pa.RecordBatch:
            rows: list[list] = [[], [], [], [], [], []]
            for doc, data in zip(docs, tokens.encode(texts), strict=True):
                data += end
                for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    n = len(part) // 4
                    for column, value in zip(rows, (doc, piece, at // 4, n, part if ids == "ids" else zlib.crc32(part), ranks[n]), strict=True):
                        column.append(value)
                    ranks[n] += 1
            return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(rows, types, strict=True)), pa.array([task] * len(rows[0]), pa.int32())], names=names)

        for batch in batches:
            held_docs, held_texts, size = [], [], 0
            for doc, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)), strict=True):
                held_docs.append(doc)
                held_texts.append(text or b"")
                size += len(held_texts[-1])
                if size >= BATCH_BYTES:
                    yield emit(held_docs, held_texts)
                    held_docs, held_texts, size = [], [], 0
            if held_docs:
                yield emit(held_docs, held_texts)

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    kind = "binary" if ids == "ids" else "long"
    out = map_arrow(rows, run, f"doc_id long, piece int, start long, length long, data {kind}, rank long, task int")
    return out.withColumnRenamed("data", "ids" if ids == "ids" else "ids_crc32")


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, ids: str = "ids", id_col: str = "doc_id", text_col: str = "text", nodes: int = NODES) -> DataFrame:
    """Every token of ``docs`` in sequences of at most ``capacity``: ``doc_id, piece, start, length, ids | ids_crc32, sequence_id, offset``.

    Only documents longer than the capacity are cut. Null texts are empty and still have their end token. Rows that repeat
    are packed each; null ids stay null; other columns aren't read. An empty table gives no rows. A text is encoded whole, so memory grows with the longest one.
    ``nodes`` bounds the search for fewer sequences (``fillings``).
    """
    pieces = materialize(tokenize_pieces(docs, tokenizer, capacity, ids, id_col, text_col), "pieces")
    counts = materialize(pieces.groupBy("task", "length").agg(F.count("*").alias("n")), "counts")
    order = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, 0)
    before = counts.select("task", "length", (F.sum("n").over(order) - F.col("n")).alias("before"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most ``capacity`` rows
    runs, taken, sequence = [], Counter(), 0
    for filling, times in fillings(histogram, capacity, nodes):
        offset = 0
        for length, n in Counter(filling).items():
            # ranks taken[length] .. are dealt n to a bin
            runs.append((length, taken[length], taken[length] + n * times, n, sequence, offset))
            taken[length] += n * times
            offset += n * length
        sequence += times
    spark = docs.sparkSession
    table = spark.createDataFrame(pa.table([pa.array(c, pa.int64()) for c in (zip(*runs, strict=True) if runs else [[]] * 6)], names=["length", "lo", "hi", "per", "first", "at"]))
    # a run for each length in a filling: a few times the capacity, whatever the corpus
    # counts grow with the number of tasks: never broadcast
    placed = pieces.join(before.hint("merge"), ["task", "length"]).withColumn("__r", F.col("rank") + F.col("before"))
    runs_of = F.broadcast(table.withColumnRenamed("length", "__length"))
    placed = placed.join(runs_of, (F.col("length") == F.col("__length")) & (F.col("__r") >= F.col("lo")) & (F.col("__r") < F.col("hi")))
    within = F.col("__r") - F.col("lo")
    return placed.select(
        "doc_id", "piece", "start", "length", "ids" if ids == "ids" else "ids_crc32",
        (F.col("first") + F.floor(within / F.col("per"))).cast("long").alias("sequence_id"),
        (F.col("at") + (within % F.col("per")) * F.col("length")).cast("long").alias("offset"),
    )
