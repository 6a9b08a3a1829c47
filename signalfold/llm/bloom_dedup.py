"""Exact dedup by two Bloom passes over a bit space counted up to two.

Pass 1 sets two bits a row from its text's SHA-256 and keeps the bits that at least two rows set, as
64-bit words of a sparse bit table. Pass 2 looks both bits of each row up: rows with an unrepeated bit
are alone for certain and pass straight through; the rest ("possibly repeated") are the only rows that
shuffle, as digests. They are grouped by the full digest, so a false positive costs a shuffled digest and nothing else.

Texts never shuffle, at any size: a row is known by its place (file and row number), and `deduplicate` reads the rows
again without those at the places to drop, which are broadcast; where there are more places than a broadcast
may hold, for one group of files after another, and within a group that still has too many for one set of row ranges after
another: each part's places are counted before they are broadcast. A table that is not read straight from files is written once for that.

Defined cases: a null text equals the empty one; a null doc_id ranks after every other; doc_id may be of any type
with an order; rows that repeat a doc_id with equal texts count in group_size and are all marked kept in `classify` (the
identifier stays), while `deduplicate` returns one of them; among ties in length the least doc_id stays; an empty table
gives an empty result; other columns pass through `deduplicate` unchanged, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalfold.llm.store import BROADCAST_ROWS, SPACES, broadcast_if_small, materialize, place, read_from_files, scratch_path

BITS_PER_ROW = 16
#: Groups of so many rows are heavy; the second figure bounds how many heavy groups there can be.
HEAVY_ROWS, HEAVY_GROUPS = 1024, 20_000


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def _bits(sha: Column, m: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(k), sha), F.lit(m)) for k in (1, 2)]


def _repeated_bits(digests: DataFrame, m: int) -> DataFrame:
    """word (bit number / 64) and mask of the bits set by at least two rows."""
    bit = F.col("bit")
    hit = (
        digests.select(F.explode(F.array(*_bits(F.col("sha"), m))).alias("bit"))
        .groupBy("bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    )
    mask = F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))"))
    return hit.groupBy(F.shiftright(bit, 6).alias("word")).agg(mask.alias("mask"))


def _probe(df: DataFrame, words: DataFrame, n_words: int, m: int, bound: int) -> DataFrame:
    """df and `__maybe`: whether both bits of its `sha` are repeated."""
    for k, pos in enumerate(_bits(F.col("sha"), m)):
        side = words.select(F.col("word").alias(f"__w{k}"), F.col("mask").alias(f"__m{k}"))
        df = df.withColumn(f"__p{k}", pos).join(broadcast_if_small(side, n_words, bound), F.shiftright(F.col(f"__p{k}"), 6) == F.col(f"__w{k}"), "left")
    both = [F.coalesce(F.expr(f"getbit(__m{k}, cast(__p{k} % 64 as int))"), F.lit(0)) == 1 for k in (0, 1)]
    return df.withColumn("__maybe", both[0] & both[1]).drop(*(f"__{c}{k}" for c in "wmp" for k in (0, 1)))


class BloomDedup:
    """The filter over one table, and what it decides. bound: rows of a broadcast."""

    def __init__(self, docs: DataFrame, text: str = "text", doc_id: str = "doc_id", bound: int = BROADCAST_ROWS):
        self.docs, self.bound = docs if read_from_files(docs) else materialize(docs, "rows"), bound
        own, file_row = F.col(f"`{text}`"), place(self.docs)
        narrow = self.docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"), _digest(own).alias("sha"), F.char_length(F.coalesce(own, F.lit(""))).cast("long").alias("n_cp"),
            file_row[0].alias("file"), file_row[1].alias("row"))
        self.digests = materialize(narrow, "digests")
        self.rows = self.digests.count()
        self.m = 1 << max(16, (BITS_PER_ROW * self.rows).bit_length())
        self.words = materialize(_repeated_bits(self.digests, self.m), "bits")
        self.probed = _probe(self.digests, self.words, self.words.count(), self.m, bound)
        maybe = self.probed.where("__maybe")
        best = F.min(F.struct((-F.col("n_cp")).alias("shorter"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "file", "row"))
        groups = maybe.groupBy("sha").agg(best.alias("best"), F.count(F.lit(1)).alias("group_size"))
        self.groups = materialize(groups.select("sha", "group_size", *(F.col(f"best.{c}").alias(f"keep_{c}") for c in ("file", "row")), F.col("best.doc_id").alias("keep_id")), "groups")

    def _resolve(self, maybe: DataFrame) -> DataFrame:
        """Join rows that hold `sha` with their group: heavy groups, few by construction, by broadcast."""
        least = max(HEAVY_ROWS, self.rows // HEAVY_GROUPS)
        heavy = self.groups.where(F.col("group_size") >= least)
        light = self.groups.where(F.col("group_size") < least)
        marks = F.broadcast(heavy.select("sha", F.lit(True).alias("__heavy")))
        rest = maybe.join(marks, "sha", "left").where(F.col("__heavy").isNull()).drop("__heavy")
        return maybe.join(F.broadcast(heavy), "sha").unionByName(rest.join(light, "sha"))

    def classify(self) -> DataFrame:
        """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
        alone = self.probed.where(~F.col("__maybe")).select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "sha")
        found = self._resolve(self.probed.where("__maybe")).select("doc_id", "keep_id", "group_size", "sha")
        return alone.unionByName(found).select(
            "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"))

    def dropped(self) -> DataFrame:
        """Places (file, row) of the rows that go."""
        return self._resolve(self.probed.where("__maybe")).where("file <> keep_file or row <> keep_row").select("file", "row")

    def without(self, gone: DataFrame, files: tuple[int, int] = (0, 1), ranges: tuple[int, int] = (0, 1)) -> DataFrame:
        """The rows of a part (one of so many groups of files, and of sets of row ranges in these), but for those at the places `gone`,
        of which the part's own are broadcast."""
        file, row = place(self.docs)
        rows = self.docs.select(F.struct("*").alias("__row"), file.alias("file"), row.alias("row"))
        mine = self._part(files, ranges)
        return rows.where(mine).join(F.broadcast(gone.where(mine)), ["file", "row"], "left_anti").select("__row.*")

    def _part(self, files: tuple[int, int], ranges: tuple[int, int]) -> Column:
        part = F.lit(True)
        if files[1] > 1:
            part = part & (F.pmod("file", F.lit(files[1])) == files[0])
        return part if ranges[1] == 1 else part & (self._range(ranges[1]) == ranges[0])

    def _range(self, n: int) -> Column:
        """The set, of n, of a row's range; a range has a sixteenth of the bound, so that enough sets always keep within it."""
        return F.pmod(F.xxhash64("file", F.floor(F.col("row") / max(1, self.bound // 16))), F.lit(n))

    def _parts(self, gone: DataFrame) -> list[tuple[tuple[int, int], tuple[int, int], int]]:
        """Parts of the table and how many places each drops, none over the bound."""
        n = max(1, -(-gone.count() // max(1, self.bound)))
        out = []
        for group in range(n):
            mine = gone.where(self._part((group, n), (0, 1)))
            total = mine.count()
            sets = max(1, -(-total // max(1, self.bound)))
            while True:
                # As many rows as there are sets.
                counts = {0: total} if sets == 1 else {r.k: r.n for r in mine.groupBy(self._range(sets).alias("k")).agg(F.count(F.lit(1)).alias("n")).collect()}
                if max(counts.values(), default=0) <= self.bound:
                    break
                sets *= 2
            out += [((group, n), (k, sets), counts.get(k, 0)) for k in range(sets)]
        return out

    def deduplicate(self) -> DataFrame:
        """The input rows that stay, with all their columns."""
        gone = materialize(self.dropped(), "dropped")
        parts = self._parts(gone)
        if len(parts) == 1:
            return self.without(gone)
        out = scratch_path(self.docs.sparkSession, "kept")
        for files, ranges, _ in parts:
            self.without(gone, files, ranges).write.mode("append").parquet(out)
        return self.docs.sparkSession.read.schema(self.docs.schema).parquet(out)
