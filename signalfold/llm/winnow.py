"""Benchmark decontamination by winnowing.

Texts become ASCII-folded words; a document keeps the least hash of each run of W consecutive K-word
grams. A shared span of W + K - 1 = 10 words holds one whole run, whose least gram both sides keep, so no
shared 10-word window is missed. Documents whose fingerprints meet a benchmark fingerprint are read
again and their hits extended: each 10-word window is matched on its fingerprint and on two hashes of
its words, and hit words are the union of the matching windows. Items of fewer than 10 words are one
window of their own length, for which documents post every gram of that length.

Defined cases: null and wordless texts have no words and are clean; wordless items match nothing; null
item_ids are ignored; repeated items count once by item_id; rows that repeat a doc_id are told apart by
their text, equal rows each get their row; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from signalfold.llm.store import broadcast_if_small, fold_ascii, materialize

WINDOW, K = 10, 5
W = WINDOW - K + 1
#: Contaminated documents, whose rows hold their spans, up to which these are broadcast.
SPAN_ROWS = 50_000
_KEY = ["size", "fp", "a", "b"]
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _words(text: Column) -> Column:
    return F.regexp_extract_all(fold_ascii(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _run(name: str, n: int) -> list[str]:
    """What a lambda over array `name` sees at index i and the n - 1 places after it, as SQL."""
    return [f"get({name}, i + {j})" for j in range(n)]


def _upto(name: str, n: str, size: int, body: str) -> Column:
    """body for each i with a whole run of `size` in an array of n."""
    return F.expr(f"transform(slice({name}, 1, greatest({n} - {size - 1}, 0)), (x, i) -> {body})")


def _hashed(df: DataFrame, text: str) -> DataFrame:
    """Adds h (word hashes), n and g (gram hashes)."""
    df = df.withColumn("words", _words(F.col(text)))
    df = df.withColumn("h", F.expr("transform(words, w -> xxhash64(w))")).drop("words")
    df = df.withColumn("n", F.size("h"))
    return df.withColumn("g", _upto("h", "n", K, f"xxhash64({', '.join(_run('h', K))})"))


def _fingerprints(df: DataFrame, short: list[int]) -> Column:
    """Winnowed hashes of each row, and all grams of the lengths in `short`."""
    kept = F.array_distinct(_upto("g", "size(g)", W, f"least({', '.join(_run('g', W))})"))
    for n in short:
        kept = F.concat(kept, F.array_distinct(_upto("h", "n", n, f"xxhash64({n}, {', '.join(_run('h', n))})")))
    return kept


def _windows(short: list[int], whole: bool) -> Column:
    """(start, size, fp, a, b) of each window; `whole`: of an item shorter than WINDOW, its only one."""
    def of(n: int, fp: str) -> Column:
        run = ", ".join(_run("h", n))
        guard = f"if(n = {n}, h, array())" if whole and n < WINDOW else "h"
        body = f"named_struct('start', i, 'size', {n}, 'fp', {fp}, 'a', xxhash64(1, {run}), 'b', xxhash64(2, {run}))"
        return F.expr(f"transform(slice({guard}, 1, greatest(n - {n - 1}, 0)), (x, i) -> {body})")

    parts = [of(WINDOW, f"least({', '.join(_run('g', W))})")]
    parts += [of(n, f"xxhash64({n}, {', '.join(_run('h', n))})") for n in short]
    return F.concat(*parts)


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, th, n_words, n_hit, items (sorted item_ids as strings).

    th is a hash of the text, by which rows that share a doc_id are told apart.
    """
    items = _hashed(benchmark.where("item_id is not null").select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("t")), "t")
    items = materialize(items.where("n > 0").drop("t"), "items")
    short = sorted(r.n for r in items.where(F.col("n") < WINDOW).select("n").distinct().collect())
    bench = materialize(items.select("item_id", F.explode(_windows(short, True)).alias("x")).select("item_id", "x.size", "x.fp", "x.a", "x.b").distinct(), "item-windows")
    # Windows that the same items hold share a set of items, known by its size and two hashes, so that a passage of many
    # items meets a document as one row and not as one for each item.
    own = F.struct(F.count(F.lit(1)).alias("n"), *(F.bit_xor(F.xxhash64(F.lit(k), "item_id")).alias(f"h{k}") for k in (1, 2)))
    windows = materialize(bench.groupBy(*_KEY).agg(own.alias("items")), "windows")
    members = materialize(bench.join(windows, _KEY).select("items", "item_id").distinct(), "members")
    n_bench = windows.count()

    key = docs.select(F.col("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("text").alias("t"))
    first = _hashed(key, "t")
    base = materialize(first.select("doc_id", "th", F.col("n").cast("long").alias("n_words"), _fingerprints(first, short).alias("fps")), "fingerprints")

    marks = broadcast_if_small(windows.select("fp").distinct(), n_bench)
    found = base.select("doc_id", "th", F.explode("fps").alias("fp")).join(marks, "fp", "left_semi").select("doc_id", "th").distinct()
    found = materialize(found, "candidates")
    n_found = found.count()

    same = (F.col("k.doc_id").eqNullSafe(F.col("c.doc_id"))) & (F.col("k.th") == F.col("c.th"))
    again = key.alias("k").join(broadcast_if_small(found, n_found).alias("c"), same, "left_semi")
    again = _hashed(again, "t")
    starts = again.select("doc_id", "th", F.explode(_windows(short, False)).alias("x")).select("doc_id", "th", "x.*")
    hits = starts.join(broadcast_if_small(windows, n_bench), _KEY)
    # Both lists are bounded by the document's own windows.
    spans = F.array_sort(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("end"))))
    per = materialize(hits.groupBy("doc_id", "th").agg(spans.alias("spans"), F.collect_set("items").alias("sets")), "spans")
    named = per.select("doc_id", "th", F.explode("sets").alias("items")).join(broadcast_if_small(members), "items")
    named = named.groupBy("doc_id", "th").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    same = (F.col("s.doc_id").eqNullSafe(F.col("n.doc_id"))) & (F.col("s.th") == F.col("n.th"))
    per = per.alias("s").join(named.alias("n"), same).select("s.doc_id", "s.th", "spans", "items")
    covered = """aggregate(spans, named_struct('n', 0L, 'upto', 0),
        (s, x) -> named_struct('n', s.n + greatest(x.end - greatest(x.start, s.upto), 0), 'upto', greatest(s.upto, x.end)), s -> s.n)"""
    per = per.select("doc_id", "th", F.expr(covered).alias("n_hit"), "spans", "items")
    per = materialize(per, "hits")
    same = (F.col("b.doc_id").eqNullSafe(F.col("p.doc_id"))) & (F.col("b.th") == F.col("p.th"))
    return base.drop("fps").alias("b").join(broadcast_if_small(per, bound=SPAN_ROWS).alias("p"), same, "left").select(
        "b.doc_id", "b.th", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"), "spans")


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that hold no benchmark window, with all their columns."""
    found = contamination(docs, benchmark).where("n_hit > 0").select("doc_id", "th").distinct()
    found = materialize(found, "contaminated")
    rows = docs.select(F.struct("*").alias("__row"), F.col("doc_id").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"))
    same = (F.col("r.doc_id").eqNullSafe(F.col("f.doc_id"))) & (F.col("r.th") == F.col("f.th"))
    return rows.alias("r").join(broadcast_if_small(found).alias("f"), same, "left_anti").select("__row.*")
