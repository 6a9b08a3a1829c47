"""Near-duplicates by a signature-coordinate inverted join.

1. Each text gets its shingle set's size, a 128-bit fingerprint of the set and COORDINATES MinHash values.
   Texts with equal sets form a class; only its representative (least doc_id) goes on.
2. Representatives are posted under each coordinate-value pair. A pair of similar sets agrees on at least T
   coordinates (the probability of fewer, at the threshold itself, is below MISS), so with its pairs ordered from rare to
   frequent each text posts under the first COORDINATES - T + 1 alone: two texts that agree T times share one
   of these. Texts with fewer than T pairs that anyone shares post nothing (prefix merging).
3. A short posting list (SHORT texts at most) gives its pairs; those that agree on T coordinates and whose sizes allow it
   are compared. A longer list never becomes pairs. Its texts are compared with one text, its pivot, and those that are
   not linked to it with another pivot among those that are, PIVOTS times in all: work in proportion to the list, after
   which what its texts are copies of is connected. Texts connected by pivots need no comparison with each other; those
   still apart meet the others of the list. A list with many of them is split by the same rule as before: a pair whose
   rarest common number is the list's agrees T - 1 times more among what follows it, so its texts post under the
   rarest of those numbers (as counted in the list), and texts with too few that anyone shares go (skipping). Numbers that
   more than half of the list holds do not split it: who holds enough of them stays in a list of its own.
   Chunks of bounded size then count collisions on signatures alone and keep the pairs that reach T, each in the first
   of the lists that both texts are in; these are compared. Where that keeps more than DENSE pairs a text, the chunk's texts are compared as one matrix product of
   common shingles instead, which returns a spanning forest of the links, at most one row for each text.
4. Comparisons are exact on the full shingle sets; components come from contraction (see components.py).

Defined cases: texts without words (or null) have no set and link with nothing; texts with fewer words than a shingle
are one shingle; rows that repeat a doc_id are one document; a null doc_id gets a null component and stays; doc_id may
be of any type with an order, and integers of any width count as long; an empty table gives an empty result; other
columns are ignored by `near_duplicates` and pass through `deduplicate`, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalfold.llm.components import components
from signalfold.llm.shingles import mix, sets_of, shingle_sets
from signalfold.llm.store import broadcast_if_small, heavy_light_join, materialize, ship, slices

COORDINATES, MISS, SHORT, PIVOTS = 24, 2e-7, 32, 2
#: Bytes of pivots' texts up to which they are broadcast.
PIVOT_BYTES = 32 << 20
#: Texts and shingles of a chunk of a long list, and columns of a block of the matrix product.
CHUNK_TEXTS, CHUNK_SHINGLES, COLUMNS = 1024, 1 << 20, 4096
#: Pairs for each text in them up to which a chunk gives them one by one (each takes two texts along), and texts apart from which a list is split: more chunks than its signatures have numbers.
DENSE, WIDE = 0.5, COORDINATES * CHUNK_TEXTS
_SEEDS = np.random.default_rng(77).integers(1, 1 << 63, (COORDINATES, 2), dtype=np.uint64) | np.uint64(1)


def least_matches(percent: int) -> int:
    """T: sets of that similarity agree on fewer coordinates with a probability of at most MISS."""
    p, tail = percent / 100, 0.0
    for t in range(COORDINATES + 1):
        tail += comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if tail > MISS:
            return max(1, t)
    return COORDINATES


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n, fp1, fp2, sig (tokens: coordinate number above 32 bits of the value)."""
    ship(docs.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (b for whole in it for b in slices(whole, 1)):
            at = 0
            for h, bounds, n in shingle_sets(b.column(1).to_pylist(), k):
                size = np.diff(bounds)
                some = np.flatnonzero(size)
                begin = bounds[:-1][some]
                fp, sig = np.zeros((2, n), np.uint64), np.zeros((n, COORDINATES), np.int64)
                if len(some):
                    for j in range(2):
                        fp[j, some] = np.add.reduceat(mix(h + _SEEDS[j, 1]), begin)
                    for c, (a, s) in enumerate(_SEEDS):
                        v = ((h ^ s) * a) >> np.uint64(32)
                        sig[some, c] = np.minimum.reduceat(v, begin).astype(np.int64) + (c << 32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(size > 0, COORDINATES, 0))]).astype(np.int32)), pa.array(sig[some].ravel()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, n), pa.array(size.astype(np.int64)), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), lists],
                    names=["doc_id", "n", "fp1", "fp2", "sig"])
                at += n

    return docs.select(_id(docs).alias("doc_id"), "text").mapInArrow(batches, f"doc_id {_type(docs)}, n long, fp1 long, fp2 long, sig array<long>")


def _type(docs: DataFrame) -> str:
    """The type of document numbers: long for integers, else their own."""
    kind = docs.schema["doc_id"].dataType
    return "long" if isinstance(kind, T.IntegralType) else kind.simpleString()


def _id(docs: DataFrame) -> Column:
    return F.col("doc_id").cast(_type(docs))


def linked_pairs(sets: list[np.ndarray], right: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of the linked texts of two chunks; `right` marks the second one."""
    size = np.array([len(s) for s in sets])
    column = np.unique(np.concatenate(sets), return_inverse=True)[1] if len(sets) else np.empty(0, int)
    times = np.bincount(column)
    shared = np.cumsum(times > 1) - 1
    row = np.repeat(np.arange(len(sets)), size)
    keep = times[column] > 1
    row, column = row[keep], shared[column[keep]]
    left, other = np.flatnonzero(~right), np.flatnonzero(right)
    common = np.zeros((len(left), len(other)), np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        lo, hi = np.searchsorted(column, [start, start + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[row[lo:hi], column[lo:hi] - start] = 1
        common += (m[left] @ m[other].T).astype(np.int64)  # each product is at most COLUMNS, exact in float32
    a, b = np.nonzero(100 * common >= percent * (size[left][:, None] + size[other][None, :] - common))
    return left[a], other[b]


def agreeing_pairs(sig: np.ndarray, size: np.ndarray, right: np.ndarray, t: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of texts of two chunks whose signatures agree t times and whose sizes allow a link; `right` marks the second chunk."""
    left, other = np.flatnonzero(~right), np.flatnonzero(right)
    theirs, found = np.ascontiguousarray(sig[other].T), []
    for at in range(0, len(left), 128):
        own = left[at:at + 128]
        same = np.zeros((len(own), len(other)), np.uint8)
        for c in range(sig.shape[1]):
            same += sig[own, c][:, None] == theirs[c][None, :]
        small, large = np.minimum(size[own][:, None], size[other][None, :]), np.maximum(size[own][:, None], size[other][None, :])
        a, b = np.nonzero((same >= t) & (100 * small >= percent * large))
        found.append((own[a], other[b]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (left, other[:0])


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least one that the pairs connect it with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


class Linker:
    def __init__(self, docs: DataFrame, k: int, percent: int):
        self.docs, self.k, self.percent, self.t, self.type = docs, k, percent, least_matches(percent), _type(docs)
        self.rows = materialize(signatures(docs, k), "signatures")

    # -- postings ----------------------------------------------------------------------------------
    def _classes(self) -> DataFrame:
        some = self.rows.where("n > 0 and doc_id is not null")
        best = F.min(F.struct("doc_id", "sig"))
        groups = some.groupBy("n", "fp1", "fp2").agg(best.alias("best"), F.count(F.lit(1)).alias("size"))
        return materialize(groups.select("n", "fp1", "fp2", "size", F.col("best.doc_id").alias("node"), F.col("best.sig").alias("sig")), "classes")

    def _postings(self, classes: DataFrame) -> DataFrame:
        """node, n, sig, toks (those that anyone shares, from rare to frequent) and take (how many of them are posted) of every text that can have a partner."""
        tokens = classes.select("node", "n", "fp1", F.explode("sig").alias("tok"))
        shared = materialize(tokens.groupBy("tok").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "shared")
        held = tokens.join(broadcast_if_small(shared), "tok")
        lists = held.groupBy("node", "fp1").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("toks"))
        # The COORDINATES - size rarest are the text's own; of the prefix they leave this many.
        lists = lists.select("node", "fp1", F.transform("toks", lambda x: x["tok"]).alias("toks"), (F.size("toks") - (self.t - 1)).alias("take")).where("take > 0")
        return materialize(lists.join(classes.select("node", "fp1", "n", "sig"), ["node", "fp1"]).drop("fp1"), "postings")

    # -- comparing ---------------------------------------------------------------------------------
    def _compare(self, pairs: DataFrame) -> DataFrame:
        """The links among pairs (a, b), by their full sets."""
        sides = {c: self.signed.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sig").alias(f"s_{c}")) for c in "ab"}
        agree = "size(filter(zip_with(s_a, s_b, (x, y) -> x = y), x -> x))"
        close = pairs.join(sides["a"], "a").join(sides["b"], "b").where(f"100 * least(n_a, n_b) >= {self.percent} * greatest(n_a, n_b)").where(f"{agree} >= {self.t}")
        close = materialize(close.select("a", "b").distinct(), "pairs")
        if close.isEmpty():
            return close
        ids = close.select(F.col("a").alias("node")).unionByName(close.select(F.col("b").alias("node"))).distinct()
        texts = self.texts.join(broadcast_if_small(materialize(ids, "compared")), "node", "left_semi")
        full = close.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t_b")), "b")
        return self._confirm(full.join(texts.select(F.col("node").alias("a"), F.col("text").alias("t_a")), "a"))

    def _confirm(self, full: DataFrame) -> DataFrame:
        """The pairs (a, b) whose texts (t_a, t_b) have sets as similar as is asked for."""
        k, percent = self.k, self.percent

        def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in it:
                for at in range(0, whole.num_rows, 512):
                    b = whole.slice(at, 512)
                    x, y = b.column(2).to_pylist(), b.column(3).to_pylist()
                    distinct = list(dict.fromkeys(x + y))
                    sets = dict(zip(distinct, sets_of(distinct, k), strict=True))
                    keep = []
                    for s, t in zip(x, y, strict=True):
                        both = len(np.intersect1d(sets[s], sets[t], assume_unique=True))
                        keep.append(100 * both >= percent * (len(sets[s]) + len(sets[t]) - both))
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

        return materialize(full.select("a", "b", "t_a", "t_b").mapInArrow(batches, f"a {self.type}, b {self.type}").distinct(), "links")

    def _pivoted(self, held: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
        """(links between the lists' pivots and the texts that stay apart, held with fewer of these).

        A pivot is one of the texts that are not apart: all of them are connected through earlier pivots.
        """
        own = F.when(~F.col("apart"), F.struct(F.xxhash64(F.lit(turn), "node"), "node"))
        main = held.groupBy("tok").agg(F.min(own)["node"].alias("pivot"), F.count(F.lit(1)).alias("size"), F.count_if("apart").alias("few")).where("few > 0")
        main = materialize(main.select("tok", "pivot", "size"), "pivots")
        rows = materialize(heavy_light_join(held.where("apart"), main, ["tok"], "size").select("tok", "node", "pivot"), "apart")
        few = main.select("pivot").distinct()
        pivots = self.signed.join(broadcast_if_small(few.withColumnRenamed("pivot", "node")), "node", "left_semi").select(F.col("node").alias("pivot"), F.col("n").alias("n_b"), F.col("sig").alias("s_b"))
        pivots = materialize(pivots.join(self.texts.select(F.col("node").alias("pivot"), F.col("text").alias("t_b")), "pivot"), "pivot-texts")
        size = pivots.agg(F.sum(F.octet_length("t_b"))).first()[0] or 0
        pivots = F.broadcast(pivots) if size <= PIVOT_BYTES else pivots
        agree = "size(filter(zip_with(sig, s_b, (x, y) -> x = y), x -> x))"
        sides = rows.select("node", "pivot").distinct().join(self.signed.select("node", "n", "sig"), "node").join(pivots, "pivot")
        close = sides.where(f"100 * least(n, n_b) >= {self.percent} * greatest(n, n_b)").where(f"{agree} >= {self.t}").select("node", "pivot", "t_b")
        links = self._confirm(close.join(self.texts.withColumnRenamed("text", "t_a"), "node").select(F.col("node").alias("a"), F.col("pivot").alias("b"), "t_a", "t_b"))
        met = rows.join(links.select(F.col("a").alias("node"), F.col("b").alias("pivot")), ["node", "pivot"]).select("tok", "node", F.lit(True).alias("met"))
        left = held.join(met, ["tok", "node"], "left").select("tok", "node", "n", (F.col("apart") & F.col("met").isNull()).alias("apart"))
        return links, materialize(left, "long")

    def _long_lists(self, lists: DataFrame, long: DataFrame, links: DataFrame) -> DataFrame:
        """links and those within the long lists; lists: tok, node, n; long: tok."""
        rows = lists.join(broadcast_if_small(long), "tok")
        first = rows.groupBy("tok").agg(F.min(F.struct(F.xxhash64("node"), "node"))["node"].alias("first"), F.count(F.lit(1)).alias("size"))
        rows = materialize(heavy_light_join(rows, materialize(first, "first"), ["tok"], "size").select("tok", "node", "n", (F.col("node") != F.col("first")).alias("apart")), "long")
        for turn in range(PIVOTS):
            found, rows = self._pivoted(rows, turn)
            links = links.unionByName(found)
        few = materialize(rows.groupBy("tok").agg(F.count_if("apart").alias("few"), F.count(F.lit(1)).alias("size")).where("few > 0"), "unmet")
        if few.isEmpty():
            return links
        held = heavy_light_join(rows.select("tok", "node", "apart"), few, ["tok"], "size")
        own = held.select(F.col("tok").alias("g"), "node", "apart", F.shiftright("tok", 32).cast("int").alias("c"), "few")
        groups, wide = own.where(F.col("few") <= WIDE).drop("few"), own.where(F.col("few") > WIDE)
        if few.where(F.col("few") > WIDE).isEmpty():
            return links.unionByName(self._meet(groups))
        after = F.expr("slice(toks, cast(array_position(toks, g) as int) + 1, size(toks))")
        wide = wide.join(self.posted.select("node", "toks"), "node").select("g", "node", "apart", after.alias("rest"))
        wide, need = materialize(wide, "wide"), self.t - 1
        while need > 0 and not wide.isEmpty():
            ready, wide = self._split(wide, need)
            groups, need = groups.unionByName(ready.withColumn("c", F.lit(None).cast("int"))), need - 1
        return links.unionByName(self._meet(groups.unionByName(wide.select("g", "node", "apart", F.lit(None).cast("int").alias("c")))))

    @staticmethod
    def _split(groups: DataFrame, need: int) -> tuple[DataFrame, DataFrame]:
        """Groups (g, node, apart, rest) whose pairs must agree `need` times in `rest`, split by the rarest number they agree on:
        (those that are ready to be compared: g, node, apart; those that still hold many texts apart, with their rest).

        A group is split only where its parts are less work than its chunks.
        """
        work = F.sum(F.col("size") + F.col("few") * F.col("size") / CHUNK_TEXTS)
        cells = groups.select("g", "node", "apart", F.explode("rest").alias("r"))
        sizes = materialize(groups.groupBy("g").agg(F.count(F.lit(1)).alias("size"), F.count_if("apart").alias("few")), "split-sizes")
        counts = cells.groupBy("g", "r").agg(F.count(F.lit(1)).alias("n"), F.count_if("apart").alias("met")).where("n > 1 and met > 0")
        counts = materialize(counts.join(broadcast_if_small(sizes), "g").select("g", "r", "n", (2 * F.col("n") > F.col("size")).alias("common")), "split-counts")
        held = heavy_light_join(cells, counts, ["g", "r"], "n")
        own = held.groupBy("g", "node").agg(F.bool_or("apart").alias("apart"), F.sort_array(F.collect_list(F.struct("common", "n", "r"))).alias("toks"), F.count_if("common").alias("n_common"))
        own = materialize(own.where(F.size("toks") >= need), "split-own")
        nothing = F.array().cast("array<bigint>")
        core = own.where(F.col("n_common") >= need).select("g", F.xxhash64(F.lit("core"), "g").alias("part"), "node", "apart", nothing.alias("rest"))
        posted = own.select("g", "node", "apart", "toks", F.posexplode(F.slice("toks", 1, F.size("toks") - (need - 1))).alias("at", "tok")).where(~F.col("tok.common"))
        rest = F.transform(F.expr("slice(toks, at + 2, size(toks))"), lambda x: x["r"])
        parts = core.unionByName(posted.select("g", F.xxhash64("g", "tok.r").alias("part"), "node", "apart", rest.alias("rest")))
        left = materialize(parts.groupBy("g", "part").agg(F.count(F.lit(1)).alias("size"), F.count_if("apart").alias("few")).where("size > 1 and few > 0"), "split-left")
        after = left.groupBy("g").agg(work.alias("after"))
        better = F.coalesce(F.col("after"), F.lit(0.0)) < F.col("few") * F.col("size") / CHUNK_TEXTS
        judged = materialize(sizes.join(broadcast_if_small(materialize(after, "split-work")), "g", "left").select("g", "size", better.alias("better")), "split-judged")
        whole = heavy_light_join(groups.select("g", "node", "apart"), judged.where("not better"), ["g"], "size")
        kept = materialize(left.join(broadcast_if_small(judged.where("better").select("g")), "g", "left_semi"), "split-kept")
        sized = materialize(heavy_light_join(parts, kept, ["g", "part"], "size").select(F.col("part").alias("g"), "node", "apart", "rest", "few"), "split-parts")
        done = (F.col("few") <= WIDE) | (F.size("rest") == 0)
        ready = whole.select("g", "node", "apart").unionByName(sized.where(done).select("g", "node", "apart"))
        return materialize(ready, "split-ready"), materialize(sized.where(~done).select("g", "node", "apart", "rest"), "wide")

    def _meet(self, groups: DataFrame) -> DataFrame:
        """The links (a, b) of the texts apart in each group (g, node, apart) with the group's others, up to connectedness.
        c: the place in the signature that all of the group agree on, if the group is a whole list."""
        lists = groups.groupBy("node").agg(F.coalesce(F.bit_or(F.expr("shiftleft(1, c)")), F.lit(0)).alias("lists"))
        rows = materialize(groups.distinct().join(lists.join(self.signed, "node"), "node"), "meeting")
        apart = F.col("apart")
        sums = rows.groupBy("g").agg(F.count_if(apart).alias("few"), F.sum(F.when(apart, F.col("n")).otherwise(0)).alias("few_shingles"), F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"))

        def chunks(texts: str, shingles: str) -> Column:
            return F.greatest(F.ceil(F.col(texts) / CHUNK_TEXTS), F.ceil(F.col(shingles) / CHUNK_SHINGLES)).cast("bigint")

        sums = materialize(sums.where("few > 0 and size > 1").select("g", "size", chunks("few", "few_shingles").alias("left"), chunks("size", "shingles").alias("right")), "chunks")
        dealt = heavy_light_join(rows, sums, ["g"], "size")
        place = F.xxhash64("node", "g")

        def each(n: str) -> Column:
            return F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))

        lefts = dealt.where("apart").select("g", "c", "node", "apart", "n", "sig", "lists", F.pmod(place, F.col("left")).alias("i"), each("right").alias("j"), F.lit(False).alias("right"))
        rights = dealt.select("g", "c", "node", "apart", "n", "sig", "lists", each("left").alias("i"), F.pmod(place, F.col("right")).alias("j"), F.lit(True).alias("right"))
        k, percent, t = self.k, self.percent, self.t

        def close(rows: pd.DataFrame) -> pd.DataFrame:
            nodes, right, apart = (rows[c].to_numpy() for c in ("node", "right", "apart"))
            sig, lists, c = np.stack(rows["sig"].to_list()), rows["lists"].to_numpy(), rows["c"].iloc[0]
            a, b = agreeing_pairs(sig, rows["n"].to_numpy(), right, t, percent)
            once = (nodes[a] != nodes[b]) & ~(apart[b] & (nodes[a] > nodes[b]))
            if not pd.isna(c):  # earlier lists that both are in have the pair
                for k in range(int(c)):
                    once &= (lists[a] & lists[b] & (1 << k) == 0) | (sig[a, k] != sig[b, k])
            a, b = a[once], b[once]
            own = np.concatenate([np.unique(a), np.unique(b)])
            if len(a) <= DENSE * len(own):
                return pd.DataFrame({"a": nodes[a], "b": nodes[b], "g": None, "i": None, "j": None, "right": None})
            return pd.DataFrame({"a": nodes[own], "b": None, "right": right[own]}).assign(**{c: rows[c].iloc[0] for c in "gij"})[["a", "b", "g", "i", "j", "right"]]

        cells = lefts.unionByName(rights).groupBy("g", "i", "j")
        met = materialize(cells.applyInPandas(close, f"a {self.type}, b {self.type}, g long, i long, j long, right boolean"), "agreeing")
        pairs = materialize(met.where("g is null").select("a", "b").distinct(), "long-pairs")
        texts = self.texts.select(F.col("node"), "text")
        full = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("t_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("t_a")), "a")
        links = self._confirm(full)

        def found(rows: pd.DataFrame) -> pd.DataFrame:
            nodes, right = rows["node"].to_numpy(), rows["right"].to_numpy()
            a, b = linked_pairs(sets_of(rows["text"].tolist(), k), right, percent)
            same = nodes[a] == nodes[b]
            root = forest(len(nodes), a[~same], b[~same])
            moved = np.flatnonzero(root != np.arange(len(nodes)))
            return pd.DataFrame({"a": nodes[root[moved]], "b": nodes[moved]})

        dense = met.where("g is not null").select("g", "i", "j", F.col("a").alias("node"), "right")
        if dense.isEmpty():
            return links
        return links.unionByName(materialize(dense.join(texts, "node").groupBy("g", "i", "j").applyInPandas(found, f"a {self.type}, b {self.type}").distinct(), "long-links"))

    def link(self) -> tuple[DataFrame, DataFrame]:
        """(classes, components of those linked with others)."""
        classes = self._classes()
        self.posted = posted = self._postings(classes)
        self.signed = posted.select("node", "n", "sig")
        ids = posted.select(F.col("node").alias("doc_id")).distinct()
        self.texts = materialize(self.docs.select(_id(self.docs).alias("doc_id"), "text").join(broadcast_if_small(ids), "doc_id", "left_semi").select(F.col("doc_id").alias("node"), "text"), "texts")
        plain = materialize(posted.select("node", "n", F.explode(F.slice("toks", 1, F.col("take"))).alias("tok")), "lists")
        sized = plain.groupBy("tok").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1")
        sized = materialize(sized, "sizes")
        short = broadcast_if_small(sized.where(F.col("texts") <= SHORT).select("tok"))
        few = plain.join(short, "tok", "left_semi")
        x, y = few.alias("x"), few.alias("y")
        pairs = x.join(y, (F.col("x.tok") == F.col("y.tok")) & (F.col("x.node") < F.col("y.node")))
        links = self._compare(pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct())
        long = sized.where(F.col("texts") > SHORT).select("tok")
        if not long.isEmpty():
            links = self._long_lists(plain, long, links)
        return classes, components(links)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (least doc_id reachable by links), kept."""
    linker = Linker(docs, k, percent)
    classes, comps = linker.link()
    named = classes.join(comps, "node", "left").select("n", "fp1", "fp2", "size", F.coalesce("comp", "node").alias("comp"))
    # A doc_id that repeats with other texts belongs to one component: its links are shared through the node.
    rows = linker.rows.select("doc_id", "n", "fp1", "fp2")
    some = rows.where("n > 0 and doc_id is not null")
    joined = heavy_light_join(some, materialize(named, "named"), ["n", "fp1", "fp2"], "size")
    alone = rows.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("comp"))
    return joined.select("doc_id", "n", "comp").unionByName(alone).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("comp")).alias("kept"))


def deduplicate(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs that are the first of their component, with all their columns."""
    gone = materialize(near_duplicates(docs, k, percent).where(~F.col("kept")).select("doc_id").distinct(), "dropped")
    rows = docs.select(F.struct("*").alias("__row"), _id(docs).alias("doc_id"))
    return rows.join(broadcast_if_small(gone), "doc_id", "left_anti").select("__row.*")
