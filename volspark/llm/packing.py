"""Best-fit packing of tokenised documents into sequences by bin completion.

Documents are tokenised in Arrow batches into pieces of at most ``capacity``
tokens. Packing needs only how many pieces each length has, a table of at most
``capacity`` rows whatever the corpus holds. The driver completes one bin after
another around the largest remaining length: it enumerates undominated
fillings, fullest first, prunes those whose waste can't beat the incumbent, and
applies the chosen filling as often as the counts allow, so the work doesn't
grow with the rows. If that doesn't meet the waste bound, it backtracks over
(filling, times) at every size; the best solution so far is the incumbent and
the waste bound prunes. Each piece
then finds its place by its rank among the pieces of its length.

Defined cases: null text counts as empty and gives one piece of the end token;
empty tables give no rows; rows that repeat a doc_id (null too) are packed one
by one; columns other than doc_id and text are not read, and a very long text is
cut into pieces. Ranks among equal lengths follow a hash of (doc_id, piece, ids).
"""

from __future__ import annotations

import base64
import binascii
import logging
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volspark.llm.common import bucket_bits, cut, prefix_sums, slices

CAPACITY = 2048
END_ID = 0
#: Fillings that are looked at for each bin, and for each bin of the search.
FILLINGS, SEARCHED = 4000, 400
#: Bins that backtracking may complete in all.
NODES = 300

_encoders: dict = {}


def encoder(json_path: str, ranks_path: str | None, pattern: str | None):
    """A function from text to ids, built once in each worker.

    Where the same vocabulary is there as ranks, the faster encoder takes the
    texts without the strings of special tokens; both give the same ids.
    """
    key = (json_path, ranks_path)
    if key not in _encoders:
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(json_path)
        special = [t.content for t in whole.get_added_tokens_decoder().values()]
        encode = lambda s: whole.encode(s, add_special_tokens=False).ids
        if ranks_path and pattern:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            _encoders[key] = lambda s: encode(s) if any(x in s for x in special) else fast.encode_ordinary(s)
        else:
            _encoders[key] = encode
    return _encoders[key]


_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


def _pieces(batches: Iterator[pa.RecordBatch], paths: tuple, capacity: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    encode = encoder(*paths)
    for batch in slices(batches, "text", 2 << 20):
        out: list[tuple] = []
        seen: dict[str, np.ndarray] = {}
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            text = text or ""
            if (ids := seen.get(text)) is None:
                ids = seen[text] = np.append(np.array(encode(text), dtype="<u4"), np.uint32(END_ID)).astype("<u4")
            first = len(ids) % capacity if len(ids) > capacity else len(ids)
            cuts = [0, *([first] if first else []), *range(first + capacity, len(ids) + 1, capacity)]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                raw = ids[a:b].tobytes()
                out.append((doc_id, k, a, b - a, binascii.crc32(raw), *([raw] if keep_ids else [])))
        schema = _PIECE.append(pa.field("ids", pa.binary())) if keep_ids else _PIECE
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut at capacity; the first piece may be shorter. With ``keep_ids``, also the ids as little-endian uint32."""
    paths = (json_path, ranks_path, pattern)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lambda it: _pieces(it, paths, capacity, keep_ids), schema)


def fillings(counts: Counter, room: int, most: int = FILLINGS) -> Iterator[tuple[int, tuple[int, ...]]]:
    """(waste, lengths, descending) of undominated fillings of the room, best incumbents only.

    Lengths are tried in descending order, so the first is the best-fit
    decreasing one. A filling is passed on only if it wastes less than all
    before; one that leaves room for a remaining length is dominated by the
    filling with that length, and no branch ends so. Stops at no waste.
    """
    sizes = sorted((s for s, c in counts.items() if c > 0 and s <= room), reverse=True)
    if not sizes:
        yield room, ()
        return
    best, looked = room + 1, 0
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack and looked < most and best:
        at, left, taken = stack.pop()
        looked += 1
        k = at
        while k < len(sizes) and (sizes[k] > left or taken.count(sizes[k]) >= counts[sizes[k]]):
            k += 1
        if k == len(sizes):
            if left < best:
                best = left
                yield left, taken
            continue
        stack.append((k + 1, left, taken))
        stack.append((k, left - sizes[k], (*taken, sizes[k])))


def _descend(counts: Counter, capacity: int, choose) -> list[tuple[tuple[int, ...], int]]:
    """Complete bins around the largest length until no piece is left; (filling, times)."""
    counts, plan = Counter(counts), []
    while counts:
        big = max(counts)
        counts[big] -= 1
        rest = choose(counts, capacity - big)
        counts[big] += 1
        used = Counter((big, *rest))
        times = min(counts[s] // c for s, c in used.items())
        for s, c in used.items():
            counts[s] -= c * times
            if not counts[s]:
                del counts[s]
        plan.append(((big, *rest), times))
    return plan


def _bins(plan: list) -> int:
    return sum(times for _, times in plan)


def waste_bound(counts: Counter, capacity: int) -> int:
    """Bins needed at least: for each k, pieces over capacity - k are alone, and those from k up share what others over half leave."""
    sizes = np.array(sorted(counts), dtype=np.int64)
    if not len(sizes):
        return 0
    numbers = np.array([counts[int(s)] for s in sizes], dtype=np.int64)
    n, total = np.concatenate(([0], np.cumsum(numbers))), np.concatenate(([0], np.cumsum(numbers * sizes)))
    half = int(np.searchsorted(sizes, capacity // 2, side="right"))
    k = np.concatenate(([0], sizes[:half]))
    low, high = np.searchsorted(sizes, k), np.searchsorted(sizes, capacity - k, side="right")
    room = (n[high] - n[half]) * capacity - (total[high] - total[half])
    need = np.maximum(0, -(-(total[half] - total[low] - room) // capacity))
    return int((n[-1] - n[half] + need).max())


def solve(counts: dict[int, int], capacity: int = CAPACITY, nodes: int = NODES) -> list[tuple[tuple[int, ...], int]]:
    """Fillings and how often each is used, so that every piece is placed once.

    Optimal if it meets the waste bound or if backtracking ends within ``nodes``
    and SEARCHED; otherwise the best of the solutions seen, with a warning that
    names its bins and the bound.
    """
    counts = Counter({int(s): int(c) for s, c in counts.items() if c > 0})
    bound = waste_bound(counts, capacity)
    first_fit = lambda c, room: next(iter(fillings(c, room)))[1]
    full = lambda c, room: min(fillings(c, room), key=lambda x: x[0])[1]
    best = min((_descend(counts, capacity, f) for f in (full, first_fit)), key=_bins)
    if _bins(best) > bound:
        best, whole = _backtrack(counts, capacity, best, bound, nodes)
        if not whole:
            logging.getLogger(__name__).warning("packing: %d bins, at least %d are needed; the search was stopped", _bins(best), bound)
    return best


def _completions(counts: Counter, room: int, waste: int) -> tuple[list[tuple[int, ...]], bool]:
    """Maximal fillings of the room with at most that waste, least waste first, without those that swapping in one larger piece dominates; False if SEARCHED cut the list."""
    sizes = sorted((s for s, c in counts.items() if c > 0 and s <= room), reverse=True)
    negative = [-s for s in sizes]
    rest = [0]
    for s in reversed(sizes):
        rest.append(rest[-1] + s * counts[s])
    rest.reverse()

    def dominated(taken: tuple[int, ...], left: int) -> bool:
        used = Counter(taken)
        spare = lambda s: used[s] < counts[s]
        if next((s <= left for s in reversed(sizes) if spare(s)), False):
            return True
        for t in used:
            larger = next((s for s in sizes[bisect_left(negative, -t) - 1 :: -1] if spare(s)), None) if t != sizes[0] else None
            if larger is not None and larger <= t + left:
                return True
        return False

    found: list[tuple[int, tuple[int, ...]]] = []
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    looked = 0
    while stack and looked < SEARCHED:
        at, left, taken = stack.pop()
        looked += 1
        k = max(at, bisect_left(negative, -left))
        while k < len(sizes) and taken.count(sizes[k]) >= counts[sizes[k]]:
            k += 1
        if k == len(sizes):
            if left <= waste and not dominated(taken, left):
                found.append((left, taken))
            continue
        if left - rest[k + 1] <= waste:
            stack.append((k + 1, left, taken))
        stack.append((k, left - sizes[k], (*taken, sizes[k])))
    return [t for _, t in sorted(found, key=lambda x: x[0])], not stack


def _backtrack(counts: Counter, capacity: int, best: list, bound: int, nodes: int) -> tuple[list, bool]:
    """Search for the bound, then by halves for numbers of bins between it and the best; False if a search was cut."""
    low, target, whole = bound, bound, True
    while low < _bins(best):
        found, ended = _search(counts, capacity, target, nodes if target == bound else nodes // 4)
        if found:
            best = found
        else:
            low, whole = target + 1, whole and ended
        target = (low + _bins(best) - 1) // 2
    return best, whole or _bins(best) == bound


def _search(counts: Counter, capacity: int, most: int, nodes: int) -> tuple[list | None, bool]:
    """Depth-first over (filling, times) for the largest length left, for a solution of ``most`` bins; False if it was cut.

    The waste that so many bins allow prunes. Every filling is tried as often as
    it goes and then every smaller number of times, so the steps reach all
    solutions; their number depends on the lengths, not on the pieces.
    """
    whole, looked, tried = True, 0, 0
    total = sum(s * c for s, c in counts.items())

    def steps(counts: Counter, bins: int) -> Iterator[tuple[tuple[int, ...], int]]:
        nonlocal whole
        big = max(counts)
        used = bins * capacity - (total - sum(s * c for s, c in counts.items()))
        found, ended = _completions(counts - Counter([big]), capacity - big, most * capacity - total - used)
        whole &= ended
        fits = [((big, *f), min(counts[s] // c for s, c in Counter((big, *f)).items())) for f in found]
        yield from fits
        for filling, n in fits:
            for times in range(n - 1, 0, -1):
                yield filling, times

    stack: list[tuple[Counter, int, Iterator]] = [(counts, 0, steps(counts, 0))]
    done: list[tuple[tuple[int, ...], int]] = []
    while stack:
        if looked > nodes or tried > 10 * nodes:
            return None, False
        counts, bins, options = stack[-1]
        step = next(options, None)
        if step is None:
            stack.pop()
            if done:
                done.pop()
            continue
        tried += 1
        filling, times = step
        left = Counter(counts)
        for s, c in Counter(filling).items():
            left[s] -= c * times
            if not left[s]:
                del left[s]
        if bins + times + waste_bound(left, capacity) > most:
            continue
        if not left:
            return [*done, step], True
        looked += 1
        done.append(step)
        stack.append((left, bins + times, steps(left, bins + times)))
    return None, whole


def places(plan: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, first sequence, pieces of the length in one sequence, first offset); at most capacity * 64 rows."""
    out, taken, sequence = [], Counter(), 0
    for filling, times in plan:
        offset = 0
        for s, c in sorted(Counter(filling).items(), reverse=True):
            out.append((s, taken[s], c * times, sequence, c, offset))
            taken[s] += c * times
            offset += s * c
        sequence += times
    return out


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, length, ...)."""
    spark: SparkSession = parts.sparkSession
    # A number for each row, so that equal rows are dealt over buckets as well.
    parts = cut(parts.withColumn("_row", F.monotonically_increasing_id()))
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.count("*").alias("n")).collect()}
    rows = places(solve(histogram, capacity))
    plan = spark.createDataFrame(rows or [(0, 0, 0, 0, 1, 0)], "length long, first long, ranks long, sequence long, each long, base long")
    bits = bucket_bits(sum(histogram.values()))
    h = F.xxhash64("doc_id", "piece", "start", "ids_crc32", "_row")
    keyed = parts.withColumn("_h", h).withColumn("_bucket", F.shiftrightunsigned("_h", 64 - bits) if bits else F.lit(0).cast("long"))
    sums = prefix_sums(keyed.groupBy("length", "_bucket").agg(F.count("*").alias("_n")), ["length"], "_bucket", "_n", "_before")
    rank = F.row_number().over(W.partitionBy("length", "_bucket").orderBy("_h", "doc_id", "piece")) - 1 + F.col("_before")
    ranked = keyed.join(sums, ["length", "_bucket"]).withColumn("_rank", rank)
    # The plan has a bounded number of rows, whatever the corpus holds.
    steps = plan.groupBy("length").agg(F.array_sort(F.collect_list(F.struct("first", "ranks", "sequence", "each", "base"))).alias("_steps"))
    step = F.expr("_steps[int(aggregate(_steps, 0, (n, s) -> n + int(s.first <= _rank))) - 1]")
    slot = F.col("_rank") - F.col("_s.first")
    return (
        ranked.join(F.broadcast(steps), "length")
        .withColumn("_s", step)
        .select(
            *[c for c in parts.columns if c != "_row"],
            (F.col("_s.sequence") + F.floor(slot / F.col("_s.each"))).cast("long").alias("sequence_id"),
            (F.col("_s.base") + slot % F.col("_s.each") * F.col("length")).cast("long").alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, pattern: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places; see pieces() and pack()."""
    return pack(pieces(docs, json_path, ranks_path, pattern, capacity, keep_ids), capacity)
