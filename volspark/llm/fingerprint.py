"""Fingerprints of documents as invertible Bloom lookup sketches, in DataFrame functions only.

A text is cut at line feeds into paragraphs, longer paragraphs into parts that
end where certain characters stand, so the cuts move with the text, by one rule
for all lengths: parts are short in the first HEAD characters and longer after
them, so beginnings weigh more in long texts, and a text of one paragraph has
several digests. Each part is hashed, its repeats with their number, to 32 bits;
the sketch of a text adds the set of these digests up in cells (count, xor of
digests, xor of checks), three cells a digest. The sketches of
two versions are subtracted cell by cell, which leaves the digests that only
one version has, and peeling takes them out: a cell that holds one digest
alone, as its check tells, gives it away, and it is then taken from its other
cells. Where peeling gets stuck, both versions are sketched again with more
cells and other hashes, until it ends.

The fingerprint is the smallest of these sketches as a string. The likeness of
two versions is the share of their digests that both have.

Defined cases: null text counts as empty; two texts without a digest have
likeness 1; a single document is its own next one; rows that repeat a doc_id
stand in the order of a hash of the text, and rows that repeat the text as well
get the same results; a null doc_id comes last; an empty table gives no rows;
columns other than doc_id and text are not read. A very long text has as many
digests as its paragraphs and parts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from volspark.llm.common import cut, drop

#: Cells of each of the three tables of a fingerprint.
BASE_CELLS = 4
#: Cells of each table of the first larger sketch, for each digest of the two versions together; empty cells are no rows.
SHARE = 4.0
#: Characters of the texts whose cells a task adds up in memory; a task with more would spill, as those of more than MOST_TASKS tasks do.
TASK_CHARS, MOST_TASKS = 4 << 20, 100_000
#: Steps of peeling, one table each, before it counts as stuck.
STEPS = 4
#: Columns that tell a version apart: whether doc_id is null (those come last), doc_id and a hash of the text.
KEY = ("none", "id", "h")


#: Characters that may end a part, about one in ten of a text in any of these scripts.
ENDS = "dhlrDHLRáäçéñöÁÄÇÉÑÖ,;0-1а-вд-жА-ВД-Ж一-勿最-櫿가-꿿ァ-ソぁ-そ"
#: Characters at the beginning of a text with short parts, so that short texts have many, too.
HEAD = 640


def part_pattern(least: int) -> str:
    """Parts of ``least`` characters, but at the end of a paragraph, up to the next that may end one, of four times as many at most."""
    return rf"[^\n]{{{least - 1},{4 * least - 1}}}?[{ENDS}]|[^\n]{{1,{4 * least}}}"


#: Patterns of parts in the beginning, and after it.
PARTS = (part_pattern(24), part_pattern(256))


def _short(h: Column) -> Column:
    """The upper half of a hash."""
    return F.shiftright(h, 32).cast("int")


def _let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _numbered(s: Column) -> Column:
    """Sorted hashes with the repeats of each replaced by hashes of it and their number."""

    def runs(heads: Column) -> Column:
        repeat = lambda h: lambda j: F.when(j == 0, F.get(s, h)).otherwise(_short(F.xxhash64(F.get(s, h), j)))
        return F.flatten(F.transform(heads, lambda h, r: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(heads, r + 1), F.size(s)) - h - 1), repeat(h))))

    heads = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))
    return F.array_distinct(_let(heads, runs))


def digests(text: Column) -> Column:
    """Distinct hashes of the parts of a text, array<int>; a part that occurs m times gives m."""
    zones = (F.left(text, F.lit(HEAD)), F.substr(text, F.lit(HEAD + 1)))
    parts = F.concat(*[F.regexp_extract_all(z, F.lit(p), F.lit(0)) for z, p in zip(zones, PARTS, strict=True)])
    return _let(F.transform(parts, lambda p: _short(F.xxhash64(p))), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), h).otherwise(_let(F.sort_array(h), _numbered)))


def _place(k: Column, table: int, cells: Column, level: int) -> Column:
    """The digest's cell in one of the three tables."""
    return (F.pmod(F.xxhash64(k.cast("long"), F.lit(3 * level + table)), cells) + cells * table).cast("int")


def _check(k: Column) -> Column:
    return F.xxhash64(k, F.lit("check"))


def _entries(keys: Column, of: int, sign: int, cells: Column, level: int) -> Column:
    """(of, cell, c, k) for each digest and each of its cells, and an entry of cell -1, so that no sketch is without rows."""
    one = lambda k: F.array(*[F.struct(F.lit(of).alias("of"), _place(k, j, cells, level).alias("cell"), F.lit(sign).alias("c"), k.cast("long").alias("k")) for j in range(3)])
    start = F.array(F.struct(F.lit(of).alias("of"), F.lit(-1).alias("cell"), F.lit(0).alias("c"), F.lit(0).cast("long").alias("k")))
    return F.concat(F.flatten(F.transform(keys, one)), start)


#: ``t`` is a digest that was taken out, in cell -1, or 0.
SKETCH = (*KEY, "of", "m", "cell", "t")


def _sums(rows: DataFrame) -> DataFrame:
    """Cells (c, k, x) of entries (none, id, h, of, m, cell, c, k)."""
    check = F.when(F.col("cell") >= 0, _check(F.col("k"))).otherwise(F.lit(0).cast("long"))
    return rows.withColumn("t", F.lit(0).cast("long")).groupBy(*SKETCH).agg(F.sum("c").cast("int").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor(check).alias("x"))


def _merged(rows: DataFrame) -> DataFrame:
    """Cells of parts of cells, without empty ones."""
    sums = rows.groupBy(*SKETCH).agg(F.sum("c").cast("int").alias("c"), F.bit_xor("k").alias("k"), F.bit_xor("x").alias("x"))
    return sums.filter("cell < 0 OR c <> 0 OR k <> 0 OR x <> 0")


def _peel(cells: DataFrame, level: int) -> DataFrame:
    """(none, id, h, of, here, there): the digests that only the first or only the second version has; null if cells are left.

    One step takes out the digests that stand alone in a cell of one of the
    tables, each of which has a digest once, from the other two tables. A step
    is an explode and a sum by cell, both within the task of the row.
    """
    m, k, c = F.col("m"), F.col("k"), F.col("c")
    zero = F.lit(0).cast("long")
    for step in range(STEPS):
        j = step % 3
        pure = (F.col("cell") >= m * j) & (F.col("cell") < m * (j + 1)) & (F.abs(c) == 1) & (F.col("x") == _check(k))
        part = lambda cell, t, c, k, x: F.struct(cell.alias("cell"), t.alias("t"), c.alias("c"), k.alias("k"), x.alias("x"))
        out = [part(_place(k, t, m, level), zero, -c, k, F.col("x")) for t in range(3) if t != j]
        parts = F.when(pure, F.array(part(F.lit(-1), k, c, zero, zero), *out)).otherwise(F.array(part(F.col("cell"), F.col("t"), c, k, F.col("x"))))
        cells = _merged(cells.select(*KEY, "of", "m", F.explode(parts).alias("e")).select(*KEY, "of", "m", "e.*"))
    left = F.max(F.when(F.col("cell") >= 0, 1).otherwise(0))
    taken = lambda sign: F.when(left == 0, F.collect_list(F.when((F.col("cell") < 0) & (c == sign), F.col("t"))))
    return cells.groupBy(*KEY, "of").agg(taken(1).alias("here"), taken(-1).alias("there"))


def _text_of(cells: Column) -> Column:
    return F.array_join(F.transform(cells, lambda s: F.concat_ws(":", s["cell"].cast("string"), s["c"].cast("string"), F.lower(F.hex(s["k"])), F.lower(F.hex(F.shiftrightunsigned(s["x"], 32))))), " ")


def following(keys: DataFrame) -> DataFrame:
    """Adds (next_none, next_id, next_h): the following row in ascending order, the first one after the last.

    The rows are range partitioned; each partition orders its own, and its last
    row gets the first of the next partition from a table of one row a partition.
    """
    dealt = cut(keys.repartitionByRange(*KEY).withColumn("part", F.spark_partition_id()))
    first = dealt.groupBy("part").agg(F.min(F.struct(*KEY)).alias("first"))
    start = F.min("first").over(W.partitionBy(F.lit(1)))
    first = first.select("part", F.coalesce(F.lead("first").over(W.orderBy("part")), start).alias("after"))
    own = F.lead(F.struct(*KEY)).over(W.partitionBy("part").orderBy(*KEY))
    rows = dealt.withColumn("own", own).join(first, "part").withColumn("next", F.coalesce("own", "after"))
    return rows.select(*keys.columns, *[F.col(f"next.{c}").alias(f"next_{c}") for c in KEY])


def _likeness(a: Column, b: Column, differ: Column) -> Column:
    common = (a + b - differ) / 2
    return F.when(a + b == 0, F.lit(1.0)).otherwise(common / (common + differ))


class _Fingerprints:
    def __init__(self, docs: DataFrame) -> None:
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        doc_id = F.col("doc_id").cast("long")
        rows = docs.select(doc_id.isNull().alias("none"), F.coalesce(doc_id, F.lit(0).cast("long")).alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
        keys = rows.groupBy(*KEY).agg(F.count("*").alias("copies"), F.first(F.char_length("text")).alias("n"))
        self.rows = rows
        self.next = cut(following(keys))
        most, chars = self.next.agg(F.max("copies"), F.sum("n")).first()
        self.single = (most or 1) == 1
        self.tasks = min(MOST_TASKS, (chars or 0) // TASK_CHARS + 1)

    def _once(self, df: DataFrame) -> DataFrame:
        return df if self.single else df.dropDuplicates(list(KEY))

    def versions(self) -> DataFrame:
        """(none, id, h, copies, n, edited_sha256, a, ae, an): digests of the text, the edited text and the next text.

        The texts are shuffled once, for both joins; what goes on from a text to
        the one before it are its digests and as much of its head as that needs.
        """
        quarter = F.floor(F.col("n") / 4).cast("int")
        texts = self.rows.withColumnsRenamed({c: f"next_{c}" for c in KEY})
        heads = self.next.join(texts, [f"next_{c}" for c in KEY]).select(*KEY, "n", "copies", F.left("text", quarter).alias("head"), digests(F.col("text")).alias("an"))
        both = self._once(self._once(heads).join(self.rows, list(KEY)))
        edited = F.concat(F.left("text", F.col("n") - quarter), "head")
        both = both.withColumn("edited", edited)
        return both.select(*KEY, "copies", F.col("n").cast("long").alias("n"), F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("ae"), "an")

    def base(self, versions: DataFrame) -> DataFrame:
        """Versions with both fingerprints and the differing digests that they tell; null where peeling got stuck.

        Versions are dealt by their key, so all sums stay in the same tasks.
        """
        m = F.lit(BASE_CELLS)
        entries = F.concat(*[_entries(F.col(c), i, 1, m, 0) for i, c in enumerate(("a", "ae", "an"))])
        sums = _sums(versions.select(*KEY, m.alias("m"), F.explode(entries).alias("e")).select(*KEY, "m", "e.*"))
        texts = sums.groupBy(*KEY).agg(*[F.array_sort(F.collect_list(F.when((F.col("of") == i) & (F.col("cell") >= 0), F.struct("cell", "c", "k", "x")))).alias(f"s{i}") for i in range(2)])
        # The cells of the text less those of the edited text (1) and of the next text (2).
        sign = F.when(F.col("of") == 0, F.array(F.struct(F.lit(1).alias("of"), F.lit(1).alias("s")), F.struct(F.lit(2).alias("of"), F.lit(1).alias("s")))).otherwise(F.array(F.struct(F.col("of").alias("of"), F.lit(-1).alias("s"))))
        less = sums.select(*KEY, "m", "cell", "t", "c", "k", "x", F.explode(sign).alias("v")).select(*KEY, "v.of", "m", "cell", "t", (F.col("c") * F.col("v.s")).alias("c"), "k", "x")
        found = _peel(_merged(less), 0).groupBy(*KEY).agg(*[F.max(F.when(F.col("of") == i, F.col(d))).alias(f"{d}{i}") for i in (1, 2) for d in ("here", "there")])
        kept = [*KEY, "copies", "n", "edited_sha256"]
        sizes = [F.size(c).alias(n) for c, n in (("a", "na"), ("ae", "ne"), ("an", "nn"))]
        rows = versions.select(*kept, *sizes).join(texts, list(KEY)).join(found, list(KEY))
        return rows.select(*kept, "na", "ne", "nn", _text_of(F.col("s0")).alias("fingerprint"), _text_of(F.col("s1")).alias("edited_fingerprint"), "here1", "there1", "here2", "there2")

    def larger(self, versions: DataFrame, failed: DataFrame, level: int) -> DataFrame:
        """(none, id, h, of, here, there) for failed (none, id, h, of), by sketches of more cells; null where peeling got stuck again."""
        which = failed.groupBy(*KEY).agg(F.collect_set("of").alias("which"))
        pair = F.explode(F.array(*[F.struct(F.lit(i).alias("of"), F.col("a").alias("a"), F.col(c).alias("b")) for i, c in ((1, "ae"), (2, "an"))])).alias("v")
        rows = versions.join(which, list(KEY)).select(*KEY, "which", pair).filter(F.array_contains("which", F.col("v.of"))).select(*KEY, "v.*")
        m = (F.ceil((F.size("a") + F.size("b")) * SHARE * 2 ** (level - 1)) + 3).cast("int")
        rows = rows.withColumn("m", m)
        entries = F.concat(_entries(F.col("a"), 0, 1, F.col("m"), level), _entries(F.col("b"), 0, -1, F.col("m"), level))
        flat = rows.select(*KEY, "of", "m", F.explode(entries).alias("e")).select(*KEY, "of", "m", "e.cell", "e.c", "e.k")
        return _peel(_sums(flat).filter("cell < 0 OR c <> 0 OR k <> 0 OR x <> 0"), level)

    def run(self, keep_digests: bool) -> DataFrame:
        written = cut(self.versions())
        versions = written.repartition(self.tasks, *KEY)
        base = cut(self.base(versions))
        both = F.explode(F.array(*[F.struct(F.lit(i).alias("of"), F.col(f"here{i}").alias("here")) for i in (1, 2)])).alias("v")
        done, failed, level = None, base.select(*KEY, both).select(*KEY, "v.*").filter("here IS NULL"), 1
        while not failed.isEmpty():
            tried = cut(self.larger(versions, failed, level))
            solved = tried.filter("here IS NOT NULL")
            done = solved if done is None else done.unionByName(solved)
            failed, level = tried.filter("here IS NULL"), level + 1
        drop(written)
        out = base
        found = [f"{d}{i}" for i in (1, 2) for d in ("here", "there")]
        if done is not None:
            wide = done.groupBy(*KEY).agg(*[F.max(F.when(F.col("of") == i, F.col(d))).alias(f"_{d}{i}") for i in (1, 2) for d in ("here", "there")])
            out = base.join(wide, list(KEY), "left").withColumns({c: F.coalesce(c, f"_{c}") for c in found})
        if not self.single:
            out = out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
        differ = [F.size(f"here{i}") + F.size(f"there{i}") for i in (1, 2)]
        return out.select(
            F.when(~F.col("none"), F.col("id")).alias("doc_id"), F.col("n").alias("n_chars"), "edited_sha256", "fingerprint", "edited_fingerprint",
            _likeness(F.col("na"), F.col("ne"), differ[0]).alias("near_edited"), _likeness(F.col("na"), F.col("nn"), differ[1]).alias("near_next"),
            *([F.col(c).alias(name) for c, name in zip(found, ("only_before_edit", "only_edited", "only_here", "only_next"), strict=True)] if keep_digests else []),
        )


def fingerprints(docs: DataFrame, keep_digests: bool = False) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for each row of docs.

    With ``keep_digests``, also the recovered digests of 32 bits, array<long>: those that only
    the text or only the edited text has, and only the text or only the next one.
    """
    return _Fingerprints(docs).run(keep_digests)
