"""Similarity join on word n-gram sets by vertical partitioning of the n-gram order.

Documents with equal sets form a class (a 128-bit key), and only one document of
each class takes part. N-grams have one global order, rare before frequent (a
class of frequency, then the hash). Two sets that are similar enough share an
n-gram within a prefix of each, so the owners of each prefix n-gram are gathered,
and n-grams with the same owners are taken together as one group.

Overlaps of candidate pairs are counted vertically: the global order is cut at
fixed places into fragments, a task of (cell, fragment) counts the common n-grams
of the pairs of its cell in its fragment alone, and the partial counts are summed
per pair. A cell is a set with a bounded number of its partners.

Components don't need all links, so pairs come in rounds: first each set with a
few centres of each of its groups (a star, never all pairs of a group); once the
components of these links are known, only groups whose owners are in several
components are left, and pairs between different components. In the last round
they are all compared, in blocks of a bounded number of owners, and those that
can be similar are counted. A pair can't be if the n-grams behind the shared one
are too few in either order, or if the parities of n-grams in cells (512, then
more for larger sets) differ more often than the sets may differ. No link between different components is lost.

N-grams are 64-bit hashes. Owners meet by fewer bits of them, which can only add
candidates; a pair is a link only if its overlap counts enough equal hashes.

Defined cases: null and empty texts have the empty set and are linked with
nothing (component_id is their own doc_id); rows that repeat a doc_id get the
same component; rows with a null doc_id are linked only by a set equal to that
of another row; an empty table gives no rows; columns other than doc_id and
text are not read; a very long text is cut into words in parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volspark.llm.common import by_size, byte_texts, cut, drop, ngram_hashes, slices, word_hashes
from volspark.llm.components import components

WORDS = 5
PERCENT = 75
#: Copies of a class are dealt over so many keys.
SALTS = 64
#: Fragments of the order in which a pair's overlaps are counted.
FRAGMENTS = 4
#: Bytes of text whose prefixes go to one task, and the bits of an n-gram that are left within a task.
TASK_BYTES, LOW_BITS = 24 << 20, 40
#: Times that an n-gram is in about 8 MB of texts before it counts as frequent there, and frequent n-grams that are ordered (it changes costs, not results).
SEEN, FREQUENT = 3, 200_000
#: Cells of the parities of a set that go with its groups. Larger sets also have as many as a power of two over twice their n-grams.
PARITIES = 512
#: Partners of a set in one cell.
PARTNERS = 128
#: Owners of a block when all remaining pairs are compared.
BLOCK = 256
#: Centres of each group in the rounds of stars (it changes costs, not results).
STARS = (1, 8)

Sets = list[np.ndarray]


def shingle_sets(texts: list[bytes], words: int = WORDS) -> Sets:
    """Sorted distinct hashes of each text's n-grams; shorter texts have their whole sequence as one."""
    h, counts = word_hashes([x.lower() for x in texts])
    out, at = [], 0
    for n in counts.tolist():
        out.append(np.unique(ngram_hashes(h[at : at + n], min(n, words))) if n else np.zeros(0, np.uint64))
        at += n
    return out


def set_key(s: np.ndarray) -> bytes:
    """128-bit key of a set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def parities(s: np.ndarray, cells: int) -> np.ndarray:
    """For each of the cells, a power of two, whether an odd number of the set's n-grams falls into it."""
    odd = np.bincount((s % np.uint64(cells)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8))


def folded(odd: np.ndarray, cells: int) -> np.ndarray:
    """The parities in fewer cells."""
    while len(odd) * 8 > cells:
        odd = odd[: len(odd) // 2] ^ odd[len(odd) // 2 :]
    return odd


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("parity", pa.list_(pa.int64())), ("wide", pa.binary()), ("seen", pa.binary()), ("times", pa.binary())])


def _digests(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    """Size, key and parities of each set; a last row of each batch has the n-grams that are frequent in it."""
    for batch in slices(batches, "text"):
        sets = shingle_sets(byte_texts(batch.column(1)), words)
        keys = [set_key(s) for s in sets]
        v, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *dict(zip(keys, sets, strict=True)).values()]), return_counts=True)
        often, rows = n >= SEEN, len(sets)
        wide = [parities(s, max(PARITIES, 1 << (2 * len(s) - 1).bit_length())) if len(s) else np.zeros(PARITIES // 8, np.uint8) for s in sets]
        small = np.concatenate([np.zeros(0, np.uint8), *[folded(x, PARITIES) for x in wide]]).view(np.int64)
        parity = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * (PARITIES // 64)), pa.array(small))
        wide = pa.array([x.tobytes() if len(x) > PARITIES // 8 else None for x in wide], pa.binary())
        none = pa.nulls(rows, pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64(), size=rows), pa.array(keys, pa.binary()), parity, wide, none, none], schema=_DIGEST)
        yield pa.RecordBatch.from_pylist([{"seen": v[often].tobytes(), "times": n[often].astype(np.int32).tobytes()}], schema=_DIGEST)


_SEEN = pa.schema([("token", pa.int64()), ("times", pa.int64())])


def _unpack_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for v, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(v, np.int64)), pa.array(np.frombuffer(n, np.int32).astype(np.int64))], schema=_SEEN)


class Order:
    """The global order of n-grams: unknown ones first, then by powers of two of the times seen, then by hash."""

    def __init__(self, tokens: np.ndarray, times: np.ndarray) -> None:
        at = np.argsort(tokens)
        self.tokens, self.level = tokens[at], (1 + np.log2(np.maximum(times[at], 1))).astype(np.int8)

    def levels(self, s: np.ndarray) -> np.ndarray:
        if not len(self.tokens):
            return np.zeros(len(s), np.int8)
        at = np.minimum(np.searchsorted(self.tokens, s), len(self.tokens) - 1)
        return np.where(self.tokens[at] == s, self.level[at], 0)

    def prefix(self, s: np.ndarray, percent: int) -> np.ndarray:
        """The first len - needed + 1 n-grams, where a similar set shares ``needed`` at least."""
        n = len(s) - -(-len(s) * percent // 100) + 1
        return s[np.argsort(self.levels(s), kind="stable")[:n]]

    def fragments(self, s: np.ndarray, fragments: int) -> list[np.ndarray]:
        """The set cut where the order is cut: unknown n-grams at fixed hashes, and all that have been seen often as the last fragment."""
        often = self.levels(s) > 0
        first = s[~often] if fragments > 1 else s
        bounds = (np.arange(1, fragments - 1, dtype=np.uint64) * np.uint64((1 << 64) // max(1, fragments - 1))).astype(np.uint64)
        return [*np.split(first, np.searchsorted(first, bounds)), *([s[often]] if fragments > 1 else [])]


_SENT = pa.schema([("task", pa.int64()), ("tokens", pa.binary()), ("owners", pa.binary()), ("nodes", pa.binary()), ("sizes", pa.binary()), ("places", pa.binary())])


def _prefixes(batches: Iterator[pa.RecordBatch], order: Order, words: int, percent: int, tasks: int) -> Iterator[pa.RecordBatch]:
    """Prefix n-grams by task, with their low bits and the place of their owner.

    An n-gram with several owners in the batch goes to its task once, and
    its owners go as they are to any task, so a task has an entry a
    batch for a frequent n-gram.
    """
    width = LOW_BITS // 8
    for batch in slices(batches, "text"):
        sets = shingle_sets(byte_texts(batch.column(0)), words)
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        nodes = batch.column(2).to_numpy()
        prefixes = [order.prefix(s, percent) if len(s) and set_key(s) == key else s[:0] for s, key in zip(sets, batch.column(1).to_pylist(), strict=True)]
        tokens = np.concatenate([np.zeros(0, np.uint64), *prefixes])
        owner = np.repeat(np.arange(len(sets), dtype=np.uint16), [len(p) for p in prefixes])
        # A place beyond 16 bits counts as the last one of them, which only weakens the filter by places.
        place = np.concatenate([np.zeros(0, np.int64), *[np.arange(len(p)) for p in prefixes]]).clip(max=65535).astype(np.uint16)
        task = (tokens >> np.uint64(LOW_BITS)) % np.uint64(tasks)
        key = (task << np.uint64(LOW_BITS)) | (tokens & np.uint64((1 << LOW_BITS) - 1))
        at = np.argsort(key, kind="stable")
        key, owner, place = key[at], owner[at], place[at]
        new = np.concatenate(([True], key[1:] != key[:-1])) if len(key) else np.zeros(0, bool)
        several = ~new | np.concatenate((~new[1:], [False])) if len(key) else new
        rows = []
        if several.any():
            o = owner[several]
            rows.append((-1 - int(key[several][0] % np.uint64(tasks)), key[several].tobytes(), b"", nodes[o].tobytes(), sizes[o].tobytes(), place[several].tobytes()))
        key, owner, place = key[new], owner[new], place[new]
        edges = np.searchsorted(key, np.arange(tasks + 1, dtype=np.uint64) << np.uint64(LOW_BITS))
        for f in np.flatnonzero(edges[1:] > edges[:-1]).tolist():
            lo, hi = edges[f], edges[f + 1]
            used, index = np.unique(owner[lo:hi], return_inverse=True)
            low = np.ascontiguousarray(key[lo:hi].view(np.uint8).reshape(-1, 8)[:, :width])
            rows.append((f, low.tobytes(), index.astype(np.uint16).tobytes(), nodes[used].tobytes(), sizes[used].tobytes(), place[lo:hi].tobytes()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SENT.types, strict=True)], schema=_SENT)


_SHARED = pa.schema([("token", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("place", pa.int32())])


def _shared(table: pa.Table) -> pa.Table:
    """Owners of the n-grams of a task that have several, with the n-gram's place in the owner's order."""
    parts: list[tuple[np.ndarray, ...]] = []
    task = table.column("task")[0].as_py()
    for t, o, d, s, p in zip(*(table.column(c).to_pylist() for c in ("tokens", "owners", "nodes", "sizes", "places")), strict=True):
        d, s, p = np.frombuffer(d, np.int64), np.frombuffer(s, np.int64).astype(np.int32), np.frombuffer(p, np.uint16).astype(np.int32)
        if task >= 0:
            owner = np.frombuffer(o, np.uint16)
            wide = np.zeros((len(owner), 8), np.uint8)
            wide[:, : LOW_BITS // 8] = np.frombuffer(t, np.uint8).reshape(-1, LOW_BITS // 8)
            parts.append((wide.view(np.int64).ravel() | (task << LOW_BITS), d[owner], s[owner], p))
        else:
            parts.append((np.frombuffer(t, np.int64), d, s, p))
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    if task >= 0:
        at = np.argsort(columns[0], kind="stable")
        t = columns[0][at]
        same = t[1:] == t[:-1]
        found = np.zeros(len(t), bool)
        found[1:] |= same
        found[:-1] |= same
        columns = [x[at][found] for x in columns]
    return pa.Table.from_arrays([pa.array(x) for x in columns], schema=_SHARED)


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("na", pa.int64()), ("nb", pa.int64())])


def _alike(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose sets can be similar by their parities in many cells."""
    for batch in batches:
        keep = []
        for na, nb, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
            if x is None or y is None:
                keep.append(True)
                continue
            cells = 8 * min(len(x), len(y))
            differ = np.bitwise_count(folded(np.frombuffer(x, np.uint8), cells) ^ folded(np.frombuffer(y, np.uint8), cells)).sum()
            keep.append(int(differ) * (100 + percent) <= (na + nb) * (100 - percent))
        yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(keep, pa.bool_())) for i in range(4)], schema=_PAIR)


_SEGMENT = pa.schema([("node", pa.int64()), ("fragment", pa.int32()), ("segment", pa.binary())])


def _segments(batches: Iterator[pa.RecordBatch], order: Order, words: int, fragments: int) -> Iterator[pa.RecordBatch]:
    """Each set's fragments of the order."""
    for batch in slices(batches, "text", 2 << 20):
        rows = []
        sets = shingle_sets(byte_texts(batch.column(0)), words)
        for s, key, node in zip(sets, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if set_key(s) == key:
                rows += [(node, f, p.tobytes()) for f, p in enumerate(order.fragments(s, fragments)) if len(p)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _SEGMENT.types, strict=True)], schema=_SEGMENT)


_OVERLAP = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("common", pa.int64())])


def _overlaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Common n-grams of each pair of a cell in one fragment.

    Rows come sorted by (cell, fragment): first the pairs (a, b), then the sets' parts (a, segment).
    """
    at, pairs, parts = None, [], {}

    def counted() -> list[tuple[int, int, int]]:
        rows = []
        for a, b in pairs:
            if a in parts and b in parts:
                x, y = sorted((parts[a], parts[b]), key=len)
                found = np.searchsorted(y, x)
                found[found == len(y)] = 0
                if n := int((y[found] == x).sum()):
                    rows.append((a, b, n))
        pairs.clear()
        parts.clear()
        return rows

    def batch_of(rows: list[tuple[int, int, int]]) -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), _OVERLAP.types, strict=True)], schema=_OVERLAP)

    for batch in batches:
        rows = []
        for cell, fragment, a, b, raw in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            if at != (cell, fragment):
                rows += counted()
                at = (cell, fragment)
            if raw is None:
                pairs.append((a, b))
            else:
                parts[a] = np.frombuffer(raw, np.uint64)
        yield from batch_of(rows)
    yield from batch_of(counted())


class _Join:
    def __init__(self, docs: DataFrame, words: int, percent: int, fragments: int) -> None:
        self.docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        self.words, self.percent, self.fragments = words, percent, fragments
        found = self.docs.mapInArrow(partial(_digests, words=words), "doc_id long, n long, key binary, parity array<long>, wide binary, seen binary, times binary")
        # The salt is kept with the table, as rows without an id, or that share one, are dealt by their number.
        self.digests = cut(found.withColumn("salt", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), F.lit(SALTS))))
        self.members = self.digests.filter("key IS NOT NULL").select("doc_id", "n", "key", "parity", "salt")
        self.salted = self.members.filter("n > 0").groupBy("key", "salt").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.count("*").alias("rows"))
        classes = self.salted.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("parity").alias("parity"), F.sum("rows").alias("rows"))
        # The number of a class is kept with the written table.
        self.classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
        seen = self.digests.filter("seen IS NOT NULL").select("seen", "times").mapInArrow(_unpack_seen, "token long, times long")
        often = seen.groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(FREQUENT).toPandas()
        order = Order(often["token"].to_numpy(np.int64).view(np.uint64), often["times"].to_numpy(np.int64))
        self.order = docs.sparkSession.sparkContext.broadcast(order)

    def _texts(self, nodes: DataFrame) -> DataFrame:
        """(text, key, node) of one document at least for each of nodes (doc_id, key, node)."""
        return self.docs.join(by_size(nodes, 32), "doc_id").select("text", "key", "node")

    def groups(self) -> DataFrame:
        """(g, node, n, place, doc_id, parity): sets of owners of prefix n-grams, with the first place of one in each owner's order."""
        size = self.docs.select(F.sum(F.octet_length("text")).alias("s")).first()["s"] or 0
        tasks = min(size // TASK_BYTES + 1, 1 << (62 - LOW_BITS))
        order, words, percent = self.order, self.words, self.percent

        def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _prefixes(batches, order.value, words, percent, tasks)

        rows = self._texts(self.classes.filter("doc_id IS NOT NULL").select("doc_id", "key", "node"))
        sent = rows.mapInArrow(prefixes, "task long, tokens binary, owners binary, nodes binary, sizes binary, places binary")
        shared = cut(sent.groupBy("task").applyInArrow(_shared, "token long, node long, n int, place int"))
        # Owners are known by their extremes in two orders: sets of owners that agree in them are one group, which only adds candidates.
        ids = [F.xxhash64(F.lit(i), "node") for i in range(2)]
        extremes = shared.groupBy("token").agg(*[f(h).alias(f"{n}{i}") for i, h in enumerate(ids) for n, f in (("lo", F.min), ("hi", F.max))])
        owned = extremes.filter("lo0 <> hi0").select("token", F.xxhash64("lo0", "hi0", "lo1", "hi1").alias("g"))
        groups = shared.join(owned, "token").groupBy("g", "node").agg(F.first("n").alias("n"), F.min("place").alias("place"))
        out = cut(groups.join(self.classes.select("node", "doc_id", "parity"), "node"))
        drop(shared)
        return out

    def _enough(self, common: Column, na: Column, nb: Column) -> Column:
        return common * (100 + self.percent) >= (na + nb) * self.percent

    def _possible(self) -> Column:
        """Whether rows x and y of a group can be similar and are in different components."""
        na, nb = F.col("x.n").cast("long"), F.col("y.n").cast("long")
        behind = F.least(na - F.col("x.place"), nb - F.col("y.place"))
        differ = sum((F.bit_count(F.col("x.parity")[i].bitwiseXOR(F.col("y.parity")[i])) for i in range(PARITIES // 64)), F.lit(0))
        return (F.col("x.label") != F.col("y.label")) & self._enough(behind, na, nb) & (differ * (100 + self.percent) <= (na + nb) * (100 - self.percent))

    def _pairs(self, joined: DataFrame, tried: DataFrame | None) -> DataFrame:
        """Distinct pairs (a, b, na, nb) of joined rows x and y that can be similar, without those tried."""
        least = lambda c: F.when(F.col("x.node") < F.col("y.node"), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))
        most = lambda c: F.when(F.col("x.node") < F.col("y.node"), F.col(f"y.{c}")).otherwise(F.col(f"x.{c}"))
        found = joined.select(least("node").alias("a"), most("node").alias("b"), least("n").alias("na"), most("n").alias("nb"))
        found = found.groupBy("a", "b").agg(F.first("na").cast("long").alias("na"), F.first("nb").cast("long").alias("nb"))
        found = cut(found if tried is None else found.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
        nodes = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).distinct()
        ids = self.classes.select("doc_id", "key", "node").join(nodes, "node", "left_semi")
        wide = self.digests.filter("wide IS NOT NULL").select("doc_id", "key", "wide").join(by_size(ids, 32), ["doc_id", "key"]).select("node", "wide").dropDuplicates(["node"])
        rows = found.join(wide.withColumnsRenamed({"node": "a", "wide": "x"}), "a", "left").join(wide.withColumnsRenamed({"node": "b", "wide": "y"}), "b", "left")
        out = cut(rows.select("a", "b", "na", "nb", "x", "y").mapInArrow(partial(_alike, percent=self.percent), "a long, b long, na long, nb long"))
        drop(found)
        return out

    def _stars(self, rows: DataFrame, few: int, tried: DataFrame | None) -> DataFrame:
        """Pairs of the owners of each group with its centres, which are those with the least hashes."""
        h = [F.xxhash64(F.lit(few + i), "node") for i in range(few)]
        least = rows.groupBy("g").agg(*[F.min(x).alias(f"m{i}") for i, x in enumerate(h)])
        centre = F.lit(False)
        for i, x in enumerate(h):
            centre = centre | (x == F.col(f"m{i}"))
        centres = rows.join(least, "g").filter(centre).select(rows.columns)
        return self._pairs(rows.alias("x").join(centres.alias("y"), (F.col("x.g") == F.col("y.g")) & self._possible()), tried)

    def _rest(self, rows: DataFrame, tried: DataFrame | None) -> DataFrame:
        """All pairs that are left, from blocks of BLOCK owners or so on both sides."""
        blocks = rows.groupBy("g").agg((F.floor(F.count("*") / BLOCK) + 1).cast("int").alias("blocks"))
        dealt = rows.join(blocks, "g").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
        every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
        x, y = dealt.withColumn("other", every), dealt.withColumn("other", every)
        same = (F.col("x.g") == F.col("y.g")) & (F.col("x.own") == F.col("y.other")) & (F.col("x.other") == F.col("y.own"))
        return self._pairs(x.alias("x").join(y.alias("y"), same & (F.col("x.node") < F.col("y.node")) & self._possible()), tried)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Links (a, b) among pairs (a, b, na, nb).

        A cell is a set with PARTNERS of its partners or so. Sets go once to each
        cell and fragment, where their overlaps are counted; the sums are per pair.
        """
        ends = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
        degree = ends.groupBy("node").agg(F.count("*").alias("d"))
        both = pairs.join(degree.withColumnsRenamed({"node": "a", "d": "da"}), "a").join(degree.withColumnsRenamed({"node": "b", "d": "db"}), "b")
        hub, other = (F.when(F.col("da") >= F.col("db"), F.col(c)).otherwise(F.col(d)) for c, d in (("a", "b"), ("b", "a")))
        chunk = F.pmod(F.xxhash64(other), F.floor(F.greatest("da", "db") / PARTNERS) + 1)
        asked = cut(both.select("a", "b", "na", "nb", F.xxhash64(hub, chunk).alias("cell")))
        members = cut(asked.select("cell", F.col("a").alias("node")).unionByName(asked.select("cell", F.col("b").alias("node"))).distinct())
        nodes = self.classes.select("doc_id", "key", "node").join(members.select("node").distinct(), "node", "left_semi")
        order, words, fragments = self.order, self.words, self.fragments

        def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _segments(batches, order.value, words, fragments)

        parts = self._texts(nodes).mapInArrow(segments, "node long, fragment int, segment binary").join(by_size(members), "node")
        parts = parts.select("cell", "fragment", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "segment")
        each = F.explode(F.array(*[F.lit(f) for f in range(fragments)])).alias("fragment")
        wanted = asked.select("cell", each, "a", "b", F.lit(None).cast("binary").alias("segment"))
        dealt = parts.unionByName(wanted).repartition("cell", "fragment").sortWithinPartitions("cell", "fragment", F.col("segment").isNotNull())
        summed = dealt.mapInArrow(_overlaps, "a long, b long, common long").groupBy("a", "b").agg(F.sum("common").alias("common"))
        links = cut(summed.join(asked, ["a", "b"]).filter(self._enough(F.col("common"), F.col("na"), F.col("nb"))).select("a", "b"))
        drop(asked, members)
        return links

    def labels(self, links: DataFrame) -> DataFrame:
        """(node, label): the smallest doc_id that links reach from a class; only of classes with links."""
        ids = self.classes.select("node", "doc_id")
        x = links.join(ids.select(F.col("node").alias("a"), F.col("doc_id").alias("ia")), "a").join(ids.select(F.col("node").alias("b"), F.col("doc_id").alias("ib")), "b")
        found = components(x, "ia", "ib").select(F.col("node").alias("doc_id"), "label")
        return cut(ids.join(found, "doc_id").select("node", "label"))

    def _mixed(self, groups: DataFrame, labelled: DataFrame | None) -> DataFrame:
        """Rows, with labels, of groups whose owners have several labels."""
        if labelled is None:
            return groups.withColumnRenamed("doc_id", "label")
        rows = groups.join(labelled, "node", "left").withColumn("label", F.coalesce("label", "doc_id")).drop("doc_id")
        several = rows.groupBy("g").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("g")
        return rows.join(several, "g", "left_semi")

    def run(self) -> DataFrame:
        groups = self.groups()
        labelled, links, tried = None, None, None
        for few in (*STARS, None):
            mixed = cut(self._mixed(groups, labelled))
            pairs = self._rest(mixed, tried) if few is None else self._stars(mixed, few, tried)
            drop(mixed)
            if not pairs.isEmpty():
                tried = pairs if tried is None else tried.unionByName(pairs)
                new = self.verified(pairs)
                links = new if links is None else links.unionByName(new)
                last, labelled = labelled, self.labels(links)
                drop(last)
        drop(groups)
        own = self.classes.select("key", "node", "doc_id", "rows")
        own = own.join(labelled, "node", "left") if labelled is not None else own.withColumn("label", F.lit(None).cast("long"))
        own = own.filter("rows > 1 OR label IS NOT NULL").select("key", F.coalesce("label", "doc_id").alias("component"))
        dealt = self.salted.select("key", "salt").join(own, "key")
        out = self.members.select("doc_id", "n", "key", "salt").join(dealt, ["key", "salt"], "left")
        return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def ngram_join(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs."""
    return _Join(docs, words, percent, fragments).run()


ORACLE = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT DISTINCT doc_id, s FROM (
    SELECT doc_id, CASE WHEN len(w) < 5 THEN array_to_string(w, ' ') ELSE array_to_string(list_slice(w, i, i + 4), ' ') END AS s
    FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0))),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT doc_id AS node, doc_id AS reach FROM d UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.reach)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(reach) AS component_id FROM r GROUP BY node) k USING (doc_id)
"""
