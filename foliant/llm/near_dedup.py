"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct word shingles. Its sketch holds, for each of ``REGISTERS`` hash
functions, the least exponentially distributed hash of the set on an exponentially spaced scale,
truncated to one byte (base ``BASE``). Sketches of parts merge by the maximum, and equal registers are as likely as
the sets are similar, so bands of register values find candidates; registers of a pair, with both set
sizes, give a joint likelihood of the similarity, which drops candidates that are out of the question;
what remains is verified on the full sets.

Equal sets are one class from the start. In each bucket every class is verified against the bucket's smallest
one. Where a bucket then still holds several components, plausible ties between them gather groups, and each group's
components are compared on full sets, block by block: a task holds two blocks of bounded size, computes all intersections
at once, and returns as many links as join components. So no group is gathered in one task and no list of pairs is ever made.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import WordHashes, as_bytes, discard, map_arrow, materialize, mix, partitions, split_words, windows
from foliant.llm.components import connected_components

REGISTERS, ROWS = 128, 4
BASE, RATE, TOP = 1.1, 20.0, 255
#: Classes a block of a large bucket holds on average, and shingles a block of a group.
BLOCK, BLOCK_SHINGLES = 512, 250_000
#: Candidates are dropped when their likelihood at any similarity of the threshold or more is below the best one by this factor's logarithm.
IMPLAUSIBLE = 16.0


def least_equal(percent: int) -> int:
    """Equal registers without which a pair is implausible: eight deviations below what the least similarity gives."""
    j = percent / 100
    return max(0, int(REGISTERS * j - 8 * (REGISTERS * j * (1 - j)) ** 0.5))


_MULT = (mix(np.arange(1001, 1001 + REGISTERS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_SEED = (mix(np.arange(5001, 5001 + REGISTERS, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def shingle_set(text: bytes | None, hashes: WordHashes, width: int) -> np.ndarray:
    """Sorted distinct shingle hashes; a text with fewer words is one shingle, a text without words has none."""
    words = split_words(text.lower() if text else text)
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(hashes.of(words), min(width, len(words)), 0 if len(words) >= width else len(words)))


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes, one byte each."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    top = np.zeros(REGISTERS, np.uint32)
    for k in range(0, len(x), 2048):
        v = (x[None, k : k + 2048] ^ _SEED[:, None]) * _MULT[:, None]
        np.maximum(top, v.max(axis=1), out=top)
    least = -np.log((top.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(least) / np.log(BASE)), 0, TOP).astype(np.uint8)


def plausible(ru: np.ndarray, rv: np.ndarray, nu: np.ndarray, nv: np.ndarray, percent: int) -> np.ndarray:
    """Whether each pair may reach the similarity: sizes allow it, and the registers don't rule it out."""
    low, high = np.minimum(nu, nv).astype(float), np.maximum(nu, nv).astype(float)
    fits = 100 * low >= percent * high
    more, less = (ru > rv).sum(axis=1), (ru < rv).sum(axis=1)
    u, v = nu / (nu + nv), nv / (nu + nv)
    most = low / high
    grid = np.linspace(0.0, 1.0, 41)

    def part(x: np.ndarray) -> np.ndarray:
        return np.clip(-np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE), 1e-12, 1)

    best, best_at = np.full(len(u), -np.inf), np.full(len(u), -np.inf)
    for j in grid:
        at = np.minimum(j, most)
        p, q = part(u - v * at), part(v - u * at)
        like = more * np.log(p) + less * np.log(q) + (ru.shape[1] - more - less) * np.log(np.clip(1 - p - q, 1e-12, 1))
        best = np.maximum(best, like)
        best_at = np.where((100 * at >= percent - 1e-9) | (j == 1.0), np.maximum(best_at, like), best_at)
    return fits & (best_at >= best - IMPLAUSIBLE)


def sketch(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5) -> DataFrame:
    """``doc_id, text_hash, n_shingles, digest, registers`` of each row; digests are equal when the sets are. ``text_hash`` tells rows of one id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            n, digests, regs = [], [], []
            for text in as_bytes(batch.column(2)):
                s = shingle_set(text, hashes, width)
                n.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                regs.append(registers(s).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(regs, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "digest", "registers"])

    return map_arrow(_rows(docs, id_col, text_col), run, "doc_id long, text_hash long, n_shingles long, digest binary, registers binary")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("string")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _plausible_pairs(pairs: DataFrame, percent: int) -> DataFrame:
    """Of ``a, b, na, nb, ra, rb``, the ``a, b`` worth verifying."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b, na, nb = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
                ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, REGISTERS) for k in (4, 5))
                keep = plausible(ra, rb, na, nb, percent)
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])

    return map_arrow(pairs, run, "a long, b long")


class _Sets:
    """Disjoint sets of labels within one task."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = x = self.up.get(y, y)
        return x

    def join(self, x: int, y: int) -> bool:
        """Whether the two were apart."""
        x, y = self.root(x), self.root(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


def _block_ties(blocks: DataFrame, percent: int) -> DataFrame:
    """Of ``lo, hi, members``, ties of components by plausible pairs, as few as span what hangs together in a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list] = ([], [])
            lists, every = batch.column(2), batch.column(2).flatten()
            fields = [every.field(k).to_numpy() for k in ("node", "n", "comp", "blk")]
            edges, own = lists.offsets.to_numpy() - lists.offsets[0].as_py(), every.field("r")
            for k, (lo, hi) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                start, end = int(edges[k]), int(edges[k + 1])
                ids, n, comp, blk = (f[start:end] for f in fields)
                regs = np.frombuffer(b"".join(own.slice(start, end - start).to_pylist()), np.uint8).reshape(-1, REGISTERS)
                place = comp.copy()
                for i in np.flatnonzero(blk == lo).tolist():
                    j = np.flatnonzero((place != place[i]) & ((blk == hi) if lo != hi else (ids > ids[i])))
                    j = j[(regs[j] == regs[i]).sum(axis=1) >= least_equal(percent)]
                    if len(j):
                        j = j[plausible(np.broadcast_to(regs[i], (len(j), REGISTERS)), regs[j], np.full(len(j), n[i]), n[j], percent)]
                    if len(j):
                        met = np.union1d(place[j], place[i : i + 1])
                        out[0].extend(met[1:].tolist())
                        out[1].extend([int(met[0])] * (len(met) - 1))
                        place[np.isin(place, met)] = met[0]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return map_arrow(blocks, run, "a long, b long")


def common_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, by products of their incidence matrices in bands of columns."""
    sets = [*left, *right]
    doc = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = seen[column] > 1
    doc, column = doc[shared], column[shared]
    order = np.argsort(column, kind="stable")
    doc, column = doc[order], column[order]
    number = np.cumsum(np.concatenate(([0], column[1:] != column[:-1]))) if len(column) else column
    out = np.zeros((len(left), len(right)), np.float32)
    for start in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
        a, b = np.searchsorted(number, (start, start + 4096))
        x = np.zeros((len(sets), 4096), np.float32)
        x[doc[a:b], number[a:b] - start] = 1
        out += x[: len(left)] @ x[len(left) :].T
    return out.astype(np.int64)


def _exact_links(groups: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Links between components of a group (``node, n, comp, grp``), found on full sets: blocks of a group meet in pairs.

    A block holds about ``BLOCK_SHINGLES``, however long its texts. Of the links of a block, as many are returned as
    join its components, as pairs of components.
    """
    open_ = groups.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n").alias("total")).where("lo <> hi")
    rows = groups.join(open_.select("grp", F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("nb")), "grp").withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rows = rows.join(texts, "node").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rows = rows.select("grp", F.least("blk", "other").alias("b_lo"), F.greatest("blk", "other").alias("b_hi"), "node", "comp", "blk", "text")

    def run(table: pa.Table) -> pa.Table:
        hashes, tied, out = WordHashes(), _Sets(), ([], [])
        node, comp, blk = (table[c].to_numpy() for c in ("node", "comp", "blk"))
        lo, hi = (table[c][0].as_py() for c in ("b_lo", "b_hi"))
        sets = [shingle_set(t, hashes, width) for t in as_bytes(table["text"].combine_chunks())]
        left, right = np.flatnonzero(blk == lo), np.flatnonzero(blk == hi)
        if len(left) and len(right):
            both = common_counts([sets[i] for i in left], [sets[i] for i in right])
            n = np.array([len(x) for x in sets])
            linked = (both > 0) & (100 * both >= percent * (n[left][:, None] + n[right][None, :] - both)) & (comp[left][:, None] != comp[right][None, :])
            for i, j in zip(*(x.tolist() for x in np.nonzero(linked)), strict=True):
                if tied.join(int(comp[left[i]]), int(comp[right[j]])):
                    out[0].append(int(comp[left[i]]))
                    out[1].append(int(comp[right[j]]))
        return pa.table([pa.array(c, pa.int64()) for c in out], names=["a", "b"])

    return materialize(rows.groupBy("grp", "b_lo", "b_hi").applyInArrow(run, "a long, b long"), "links")


def _texts(rows: DataFrame, first: DataFrame) -> DataFrame:
    """``node, text`` of classes, from the row that is each class's first: rows that have its id and hash have its text."""
    found = rows.join(first.select("node", "first.doc_id", "first.text_hash"), ["doc_id", "text_hash"])
    # grouped as they are joined: texts travel once
    return materialize(found.groupBy("doc_id", "text_hash").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text"), "texts")


def _own_links(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``a, b``: classes that rows of one id belong to."""
    ids = rows.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id", "lo")
    pairs = rows.join(ids, "doc_id").where("digest <> lo").select("lo", F.col("digest").alias("hi")).distinct()
    node = classes.select("digest", "node")
    return pairs.join(node.toDF("lo", "a"), "lo").join(node.toDF("hi", "b"), "hi").select("a", "b")


def _verify(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Of ``a, b``, those whose full sets are similar enough."""
    joined = pairs.join(texts.toDF("b", "tb"), "b").join(texts.toDF("a", "ta"), "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, known = WordHashes(), OrderedDict()

        def full(key: int, text: bytes) -> np.ndarray:
            if key not in known:
                known[key] = shingle_set(text, hashes, width)
                if len(known) > 64:
                    known.popitem(last=False)
            return known[key]

        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for x, tx, ty in zip(a, as_bytes(batch.column(2)), as_bytes(batch.column(3)), strict=True):
                # rows of one leader stand together, so its set is made once
                s, t = shingle_set(ty, hashes, width), full(x, tx)
                both = len(np.intersect1d(s, t, assume_unique=True))
                keep.append(bool(both) and 100 * both >= percent * (len(s) + len(t) - both))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialize(map_arrow(joined, run, "a long, b long"), "links")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, one_document: bool = True) -> DataFrame:
    """Groups of documents linked by shingle similarity: ``doc_id, n_shingles, component_id, kept, text_hash, chosen``, one row per row of ``docs``.

    Documents are linked when ``100 * |A & B| >= percent * |A | B|``. ``component_id`` is the smallest id
    reachable over links, ``kept`` marks the rows that have it. Null and blank texts have no shingles and no links. Rows that repeat an id are
    one document with several texts, and so linked, unless ``one_document`` is false: then each text is linked by its own likeness only.
    ``chosen`` marks the rows of one text of each component, the smallest by (id, ``text_hash``, the text's xxhash64): rows equal in both are all marked.
    Rows with a null id are linked with nothing, keep a null ``component_id``, and are kept and chosen. An empty table gives no rows. Other columns of ``docs`` are not
    read. Ids are numbers. ``percent`` must be 60 or more: below it, 32 bands of 4 registers would miss links.
    """
    if percent < 60:
        raise ValueError("bands are chosen for similarities of 0.6 and more")
    rows = materialize(sketch(docs, id_col, text_col, width), "sketch")
    some = rows.where("n_shingles > 0 and doc_id is not null")
    classes = some.groupBy("digest", "n_shingles", "registers").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
    # numbers of classes are given once, as the table is written
    classes = materialize(classes.select("digest", "first", F.col("n_shingles").alias("n"), F.col("registers").alias("r"), F.monotonically_increasing_id().alias("node")), "classes")
    bands = F.array(*[F.xxhash64(F.lit(k), F.substring("r", ROWS * k + 1, ROWS)) for k in range(REGISTERS // ROWS)])
    buckets = classes.select("node", F.explode(bands).alias("band"))
    leaders = buckets.groupBy("band").agg(F.min("node").alias("leader"), F.max("node").alias("last"), F.count("*").alias("size")).where("leader <> last")
    members = materialize(buckets.join(leaders.select("band", "leader", "size"), "band"), "members")
    nodes = classes.select("node", "n", "r")
    stars = members.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(nodes.toDF("b", "nb", "rb"), "b").join(nodes.toDF("a", "na", "ra"), "a").select("a", "b", "na", "nb", "ra", "rb")
    texts = _texts(_rows(docs, id_col, text_col), classes.join(members.select("node").distinct(), "node", "left_semi"))
    pairs = materialize(_plausible_pairs(stars, percent), "stars")
    links = _verify(pairs, texts, width, percent)
    discard(pairs)
    components = connected_components(links.unionAll(_own_links(some.select("doc_id", "digest"), classes)) if one_document else links)

    # buckets that still hold several components: tie what may be similar into groups, then compare each group's components on full sets
    named = members.where("size > 2").join(components, "node", "left").select("band", "node", "size", F.coalesce("component", "node").alias("comp"))
    named = materialize(named, "named")
    open_bands = named.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("band")
    n_blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    rest = named.join(open_bands, "band", "left_semi").join(nodes, "node").withColumn("nb", n_blocks).withColumn("blk", F.pmod(F.xxhash64("node"), F.col("nb")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    rest = rest.select("band", F.least("blk", "other").alias("lo"), F.greatest("blk", "other").alias("hi"), "node", "n", "r", "comp", "blk")
    # the rows are few and the work on them much: by number, so that it isn't drawn together
    blocks = rest.repartition(2 * partitions(docs.sparkSession), "band", "lo", "hi").groupBy("band", "lo", "hi").agg(F.collect_list(F.struct("node", "n", "r", "comp", "blk")).alias("members"))
    ties = materialize(_block_ties(blocks.where(F.size("members") > 1).select("lo", "hi", "members"), percent).distinct(), "ties")
    if not ties.isEmpty():
        groups = connected_components(ties).toDF("comp", "grp")
        placed = nodes.join(components, "node", "left").select("node", "n", F.coalesce("component", "node").alias("comp")).join(groups, "comp")
        joined = connected_components(_exact_links(placed, texts, width, percent)).toDF("component", "joined")
        alone = joined.select(F.col("component").alias("node"), "component").join(components, "node", "left_anti")
        components = components.unionByName(alone).join(joined, "component", "left").select("node", F.coalesce("joined", "component").alias("component"))

    linked = classes.select("node", "digest", "first").join(components, "node")
    least = linked.groupBy("component").agg(F.min("first").alias("least"))
    by_class = materialize(linked.join(least, "component").select("digest", "least"), "linked").withColumnRenamed("digest", "__digest")
    discard(members, named, texts, ties)
    alone = classes.select(F.col("digest").alias("__digest"), F.col("first").alias("least")).join(by_class, "__digest", "left_anti")
    out = rows.join(by_class.unionByName(alone), (F.col("digest") == F.col("__digest")) & (F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), "left")
    own = F.struct("doc_id", "text_hash")
    least = F.coalesce("least", own)
    return out.select("doc_id", "n_shingles", least["doc_id"].alias("component_id"), F.col("doc_id").eqNullSafe(least["doc_id"]).alias("kept"), "text_hash", (F.col("doc_id").isNull() | (own == least)).alias("chosen"))
