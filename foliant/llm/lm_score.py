"""Scores of texts under a probabilistic suffix tree over words.

Contexts are of variable length, up to ``DEPTH`` words. A word sequence is an entry if the training texts have it ``MIN_COUNT`` times, at every size of
the corpus. A context becomes a state if the distribution of its next symbols diverges from that of its longest shorter state by more than its entries
cost (BIC). A state gives symbols it has no entry for its parent's probabilities, scaled to the mass left. The root is the smoothed
distribution of single words. A symbol is scored under the longest state that its context ends with.

The tree is held whole nowhere. Texts stand in blocks of about ``BLOCK`` words, a row of a table each. In each round blocks ask
buckets of a hash about their distinct sequences, and buckets add up and answer in the order of the questions:

* counts of sequences of d words, asked only where both sequences of d - 1 words within are entries (no other can be one);
* the divergence test of contexts: each entry's share in its context's sums is told by one block, its owner, and added up by the context's bucket.

A bucket's key is the hash of a whole sequence, and a block asks once about each, however often it stands there, so no word or pair makes a bucket large.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import WordHashes, as_bytes, discard, map_arrow, materialize, mix, partitions, sort_order, split_words

#: Least count of an entry, words of the longest context.
MIN_COUNT, DEPTH = 2, 3
#: Counts too small for an entry; so many numbers of words stand for all words of these counts.
RARE = MIN_COUNT
DISCOUNT = 0.5
#: Words of a block of texts, and questions of a bucket, about.
BLOCK, BUCKET = 1_500_000, 3_000_000
#: A sequence is told by so many bits more than the corpus' number of words has, up to 64.
SPARE_BITS = 26
#: Scales of states (log10) are whole numbers of such parts.
STEPS = 1 << 16
END = b"\n"
HELD_OUT, FOLDS = 1, 5
_BLOCKS = "block long, size long, train long, payload binary"
_ASKED = "bucket long, block long, kind int, n int, keys binary, vals binary"
_ANSWERED = "bucket long, block long, round int, kind int, n int, data binary"


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased words and the end token."""
    return [*split_words(text.lower() if text else text), END]


def join_keys(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Key of a sequence from those of its parts without the last and without the first word."""
    return mix(left * np.uint64(0x9E3779B97F4A7C15) + mix(right + np.uint64(0xD1B54A32D192ED03)))


def planes(x: np.ndarray) -> bytes:
    """Numbers by place of their bytes, compressed; of whole numbers (none is negative) only the places that any has."""
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8)) if x.dtype.kind in "iu" else x.dtype.itemsize
    own = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)[:, :width]
    return bytes([width]) + pa.compress(np.ascontiguousarray(own.T), "zstd", asbytes=True)


def unplane(data: bytes, kind: str, n: int) -> np.ndarray:
    width = data[0]
    out = np.zeros((n, np.dtype(kind).itemsize), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(memoryview(data)[1:], n * width, "zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.view(kind).ravel()


class Plan:
    """What all rounds share: words in all and in training, distinct training words, depth, rounds done, and how questions are dealt."""

    def __init__(self, total: int, train: int, depth: int, parts: int):
        self.total, self.train, self.depth, self.vocabulary, self.done = total, train, depth, 0, 0
        self.buckets = max(parts, -(-total // BUCKET))
        self.edges = (np.arange(self.buckets, dtype=object) * (1 << 64) // self.buckets).astype(np.uint64)
        self.shift = np.uint64(max(0, 64 - SPARE_BITS - max(1, total).bit_length()))

    @property
    def floor(self) -> float:
        return self.train + 0.5 * (self.vocabulary + 1)

    def deal(self, block: int, kind: int, keys: np.ndarray, columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """Sorted keys and what is told about them, in one row for each bucket; a bucket is a range of keys."""
        edges = [*np.searchsorted(keys, self.edges).tolist(), len(keys)]
        keys = keys >> self.shift
        rows = []
        for bucket, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
            if e > s:
                told = pickle.dumps([planes(c[s:e]) for c in columns])
                rows.append((bucket, block, kind, e - s, planes(np.diff(keys[s:e], prepend=np.zeros(1, np.uint64))), told))
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["bucket", "block", "kind", "n", "keys", "vals"])


class Replay:
    """A block's texts, one after the other, with all that is known of them after the rounds so far.

    Arrays are indexed by the place of a sequence's last word. ``counts[d]``: training count of the sequence of d words there, 0 if it is no entry
    (words: always). ``log_p``: log10 probability of the word under the states found so far.
    """

    def __init__(self, rows: list, plan: Plan):
        """``rows`` of one block: its texts (round 0) and the answers it got."""
        (payload,) = (r[5] for r in rows if r[2] == 0)
        self.docs, self.held, lengths, words, ids, known = pickle.loads(payload)
        self.plan, self.lengths = plan, np.frombuffer(lengths, np.int64)
        words = np.frombuffer(words, np.uint64)
        n = int(self.lengths.sum())
        ids = unplane(ids, "<u4", n).astype(np.int64)
        order = np.argsort(words[RARE:]) + RARE
        place = np.full(len(words), -1, np.int32)
        place[order] = np.arange(len(order))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.place = np.arange(n) - np.repeat(self.starts, self.lengths)
        self.learned = ~np.repeat(np.array(self.held, bool), self.lengths)
        # keys of the sequences asked about last; by number of words: distinct keys, and which of them each place has (-1: none)
        self.key, self.asked, self.which = words[ids], {1: words[order]}, {1: place[ids]}
        self.first: dict[int, np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {}
        self.owned: dict[int, np.ndarray] = {}
        self.log_p = np.zeros(n)
        got: dict[tuple[int, int], list] = {}
        for _, _, round_, kind, m, data in sorted((r for r in rows if r[2] > 0), key=lambda r: r[0]):
            got.setdefault((round_, kind), []).append((m, data))
        if known is not None:
            self.counts[1] = unplane(known, "<i8", len(words))[ids]
            self.log_p = np.log10((self.counts[1] + 0.5) / plan.floor)
        for round_ in range(1 if known is None else 2, plan.done + 1):
            self._learn(round_, got.get((round_, 0), []), got.get((round_, 1), []))

    def compact(self) -> bytes:
        """Payload after the first round: words that are no entries lose their keys, as nothing is asked about them again."""
        c = np.zeros(len(self.asked[1]), np.int64)
        c[self.which[1]] = self.counts[1]
        kept = np.flatnonzero(c >= MIN_COUNT)
        # the first numbers are those of all rare words, by their counts
        number = np.minimum(c, RARE - 1).astype("<u4")
        number[kept] = RARE + np.arange(len(kept))
        used = np.bincount(number[self.which[1]], minlength=RARE + len(kept))
        often = np.argsort(-used[RARE:])
        again = np.arange(RARE + len(kept), dtype="<u4")
        again[RARE + often] = RARE + np.arange(len(kept))
        words = np.concatenate((np.zeros(RARE, np.uint64), self.asked[1][kept][often]))
        counts = np.concatenate((np.arange(RARE), c[kept][often]))
        return pickle.dumps((self.docs, self.held, self.lengths.tobytes(), words.tobytes(), planes(again[number][self.which[1]]), planes(counts)))

    def _learn(self, round_: int, counts: list[tuple[int, bytes]], scales: list[tuple[int, bytes]]) -> None:
        if round_ <= self.plan.depth + 1:
            if round_ > 1:
                self._sequences(round_)
            got = np.concatenate([np.zeros(0, np.int64), *(unplane(data, "<i8", n) for n, data in counts)])
            self.counts[round_], self.owned[round_] = np.append(got >> 1, 0)[self.which[round_]], (got & 1).astype(bool)
        if round_ >= 3:
            self._states(round_ - 2, scales)

    def _sequences(self, d: int) -> None:
        """Keys of d words, and which of them are asked about: those whose two parts are entries."""
        entry = self.counts[d - 1] >= MIN_COUNT
        at = np.flatnonzero(entry[1:] & entry[:-1] & (self.place[1:] >= d - 1)) + 1
        key = join_keys(self.key[at - 1], self.key[at])
        self.key = np.zeros(len(self.place), np.uint64)
        self.key[at] = key
        order = sort_order(key)
        in_order, at = key[order], at[order]
        new = np.concatenate((np.ones(min(1, len(at)), bool), in_order[1:] != in_order[:-1]))
        self.asked[d], self.first[d] = in_order[new], at[new]
        self.which[d] = np.full(len(self.place), -1, np.int32)
        self.which[d][at] = np.cumsum(new, dtype=np.int32) - 1

    def _contexts(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        """Places whose d words before are an entry, and which of the distinct keys of d words are such contexts."""
        at = np.flatnonzero((self.counts[d][:-1] >= MIN_COUNT) & (self.place[1:] >= d)) + 1
        used = np.zeros(len(self.asked[d]), bool)
        used[self.which[d][at - 1]] = True
        return at, used

    def _states(self, d: int, answers: list[tuple[int, bytes]]) -> None:
        """Score places under contexts of d words that are states."""
        at, used = self._contexts(d)
        scale = np.full(len(used), np.nan)
        scale[used] = decoded(np.concatenate([np.zeros(0, np.int64), *(unplane(data, "<i8", n) for n, data in answers)]))
        scale = scale[self.which[d][at - 1]]
        at, scale = at[~np.isnan(scale)], scale[~np.isnan(scale)]
        c, n = self.counts[d + 1][at], self.counts[d][at - 1]
        self.log_p[at] = np.where(c >= MIN_COUNT, np.log10(np.maximum(c - DISCOUNT, DISCOUNT) / n), self.log_p[at] + scale)

    def questions(self, round_: int) -> Iterator[tuple[int, np.ndarray, list[np.ndarray]]]:
        """Kind 0: keys of ``round_`` words and how often this block's training texts have each. Kind 1: contexts of two words less and this block's share in their sums."""
        if round_ <= self.plan.depth + 1:
            if round_ > 1:
                self._sequences(round_)
            which = self.which[round_]
            yield 0, self.asked[round_], [np.bincount(which[(which >= 0) & self.learned], minlength=len(self.asked[round_]))]
        if round_ >= 3:
            d = round_ - 2
            _, used = self._contexts(d)
            number = np.cumsum(used) - 1
            entries = self.first[d + 1]
            c = self.counts[d + 1][entries]
            own = self.owned[d + 1] & (c >= MIN_COUNT)
            entries, c = entries[own], c[own]
            n, context = self.counts[d][entries - 1], number[self.which[d][entries - 1]]
            p = 10.0 ** self.log_p[entries]
            m = int(used.sum())
            add = lambda w: np.bincount(context, w, minlength=m)
            total = np.zeros(m, np.int64)
            total[context] = n
            yield 1, self.asked[d][used], [total, add(c).astype(np.int64), add(None), add(p), add(c * np.log(c / n / p))]


def settle(packed: list, plan: Plan) -> Iterator[tuple[int, int, int, bytes]]:
    """Answers of a bucket as (block, kind, n, data), in the order of each question; kind 2 (block -1): how many distinct training keys of kind 0."""
    for kind in (0, 1):
        own = [r for r in packed if r[2] == kind]
        if not own:
            continue
        keys = np.concatenate([np.cumsum(unplane(r[4], "<u8", r[3]), dtype=np.uint64) for r in own])
        columns = [np.concatenate(c) for c in zip(*([unplane(data, k, r[3]) for data, k in zip(pickle.loads(r[5]), ("<i8", "<i8", "<i8", "<f8", "<f8"), strict=False)] for r in own), strict=True)]
        order = sort_order(keys << plan.shift)
        in_order = keys[order]
        del keys
        first = np.flatnonzero(np.concatenate(([True], in_order[1:] != in_order[:-1])))
        run = np.empty(len(order), np.int64)
        run[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(order))))
        del in_order
        if kind == 0:
            c = np.add.reduceat(columns[0][order], first)
            answer = c[run] << 1
            answer[order[first]] |= 1  # the first block that asks is the entry's owner
            yield -1, 2, 0, int((c > 0).sum()).to_bytes(8, "little")
        else:
            n = np.maximum.reduceat(columns[0][order], first)
            seen, size, theirs, gain = (np.add.reduceat(c[order], first) for c in columns[1:])
            answer = coded(states(n, seen, size, theirs, gain))[run]
        edges = np.cumsum([0, *(r[3] for r in own)]).tolist()
        for r, s, e in zip(own, edges, edges[1:], strict=False):
            yield r[1], kind, r[3], planes(answer[s:e])


def states(n: np.ndarray, seen: np.ndarray, size: np.ndarray, theirs: np.ndarray, gain: np.ndarray) -> np.ndarray:
    """Divergence test of contexts: the log10 scale of their parent's probabilities for symbols without an entry, nan where a context is no state.

    ``n``: a context's count, ``seen`` and ``size``: its entries' counts and number, ``theirs``: the entries' probability under the parent, ``gain``: their share
    of the log likelihood ratio.
    """
    with np.errstate(divide="ignore", invalid="ignore"):
        rest, rest_parent = 1 - (seen - DISCOUNT * size) / n, 1 - np.minimum(theirs, 1 - 1e-9)
        left = n - seen
        gain = gain + np.where(left > 0, left * np.log(np.maximum(left, 1) / n / rest_parent), 0.0)
        kept = (size > 0) & (gain > size * (1 + np.log(n)) / 2 + 4)
        return np.where(kept, np.log10(rest / rest_parent), np.nan)


def coded(scale: np.ndarray) -> np.ndarray:
    """Scales as whole numbers of three bytes: ``STEPS`` to one, from -16 to 16, 0 where there is none."""
    return np.where(np.isnan(scale), 0, np.rint(np.nan_to_num(scale) * STEPS) + 16 * STEPS).astype(np.int64)


def decoded(x: np.ndarray) -> np.ndarray:
    return np.where(x == 0, np.nan, x / STEPS - 16)


def _grouped(rows: DataFrame, by: str, parts: int, fn: Callable, schema: str) -> DataFrame:
    """Apply ``fn`` to all rows of each bucket or block at once."""
    place = rows.columns.index(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(batch.num_columns)), strict=True):
                if row[place] != now and held:
                    yield from fn(held)
                    held = []
                now = row[place]
                held.append(row)
        if held:
            yield from fn(held)

    return map_arrow(rows.repartition(parts, by).sortWithinPartitions(by), run, schema)


def _blocks(rows: DataFrame) -> DataFrame:
    """Texts as blocks of whole documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, block = WordHashes(), [], 0, TaskContext.get().partitionId() << 33

        def flush() -> pa.RecordBatch:
            lengths = np.array([len(h) for _, _, h in held], np.int64)
            words, ids, count = np.unique(np.concatenate([h for _, _, h in held]), return_inverse=True, return_counts=True)
            often = np.argsort(-count)  # small numbers for frequent words
            number = np.empty(len(words), "<u4")
            number[often] = RARE + np.arange(len(words))
            words = np.concatenate((np.zeros(RARE, np.uint64), words[often]))
            payload = pickle.dumps(([d for d, _, _ in held], [o for _, o, _ in held], lengths.tobytes(), words.tobytes(), planes(number[ids]), None))
            train = int(lengths[~np.array([o for _, o, _ in held], bool)].sum())
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((block, pa.int64()), (int(lengths.sum()), pa.int64()), (train, pa.int64()), (payload, pa.binary()))], names=["block", "size", "train", "payload"])

        for batch in batches:
            for doc, out, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), strict=True):
                held.append((doc, out, hashes.of(tokens(text))))
                size += len(held[-1][2])
                if size >= BLOCK:
                    yield flush()
                    held, size, block = [], 0, block + 1
        if held:
            yield flush()

    return map_arrow(rows.select("doc_id", "held_out", "text"), run, _BLOCKS)


def _compact(rows: list, plan: Plan) -> Iterator[pa.RecordBatch]:
    block = Replay(rows, plan)
    values = ((rows[0][1], pa.int64()), (0, pa.int64()), (0, pa.int64()), (block.compact(), pa.binary()))
    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in values], names=["block", "size", "train", "payload"])


def _known(blocks: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """All that is known of blocks: their texts as round 0, and the answers so far."""
    none = F.lit(0)
    out = blocks.select(none.cast("long").alias("bucket"), "block", none.alias("round"), none.alias("kind"), none.alias("n"), F.col("payload").alias("data"))
    for table in answers:
        out = out.unionAll(table.where("kind < 2"))
    return out


def _round(blocks: DataFrame, answers: list[DataFrame], round_: int, plan: Plan, parts: int) -> DataFrame:
    """Answers to one round's questions."""

    def ask(rows: list) -> Iterator[pa.RecordBatch]:
        for kind, keys, columns in Replay(rows, plan).questions(round_):
            yield from plan.deal(rows[0][1], kind, keys, columns)

    def answer(packed: list) -> Iterator[pa.RecordBatch]:
        for block, kind, n, data in settle(packed, plan):
            columns = ((packed[0][0], pa.int64()), (block, pa.int64()), (round_, pa.int32()), (kind, pa.int32()), (n, pa.int32()), (data, pa.binary()))
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in columns], names=["bucket", "block", "round", "kind", "n", "data"])

    asked = _grouped(_known(blocks, answers), "block", parts, ask, _ASKED)
    return materialize(_grouped(asked, "bucket", parts, answer, _ANSWERED), "answers")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = DEPTH) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of each row.

    The model learns from rows that aren't held out: those whose crc32 of the id as text, modulo 5, isn't 1. ``score`` is the log10
    probability of the whole text with its end under the suffix tree with contexts of up to ``depth`` words, ``base_score`` that under the root alone. Null texts are
    empty (the end token only), null ids count as the empty text and are learned from, rows that repeat count as often as they stand. Other columns aren't
    read. An empty table gives no rows; a table of held-out rows only is scored by an empty model. Ids are numbers.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS)) == HELD_OUT
    blocks = materialize(_blocks(rows.withColumn("held_out", fold)), "blocks")
    total, train = blocks.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.sum("train"), F.lit(0))).first()
    parts = partitions(spark)
    plan = Plan(total, train, depth, parts)
    answers: list[DataFrame] = []
    for round_ in range(1, depth + 3 if depth else 2):
        answers.append(_round(blocks, answers, round_, plan, parts))
        plan.done = round_
        if round_ == 1:  # a number for each bucket
            plan.vocabulary = sum(int.from_bytes(r[0], "little") for r in answers[0].where("kind = 2").select("data").toLocalIterator())
            whole = blocks
            blocks = materialize(_grouped(_known(whole, answers), "block", parts, lambda rows: _compact(rows, plan), _BLOCKS), "blocks")
            discard(whole, *answers)
            answers = []

    def judge(rows: list) -> Iterator[pa.RecordBatch]:
        block = Replay(rows, plan)
        known, base = block.counts[1] > 0, np.log10((block.counts[1] + 0.5) / plan.floor)
        sums = [np.add.reduceat(x, block.starts) for x in (known.astype(np.int64), base, block.log_p)]
        yield pa.RecordBatch.from_arrays([pa.array(block.docs, pa.int64()), pa.array(block.held, pa.bool_()), pa.array(block.lengths), *(pa.array(x) for x in sums)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    out = _grouped(_known(blocks, answers), "block", parts, judge, "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train).cast("long").alias("train_tokens"), "base_score", "score")
