"""Exact quantiles of any number of values, with bounded memory in every task: radix selection.

A double's order is that of a whole number made of its exponent and fraction (negative values mirrored), its image. A pass counts the values
by the next DIGITS bits of their images, among those that share the bits known so far; the digit whose counts cover
the wanted rank is known from then on. 64 bits are five passes, whatever the values are; where few values are left they are sorted
instead. All questions share each pass, and a pass returns one row for each rank it narrows down.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a pass, what is left to shift out after each, and how many values are sorted rather than counted.
DIGITS = 14
SHIFTS = (50, 36, 22, 8, 0)
FEW = 50_000
#: Images of infinity and of NaN, which is the greatest value (the format's fixed values).
_INFINITY, _NAN = 0x7FF0 << 48, 0x7FF8 << 48
_LEAST_NORMAL = 2.2250738585072014e-308


def image(v: Column) -> Column:
    """A long that sorts as the double does; both zeros are 0. Every step is exact, as it scales by powers of two."""
    a = F.abs(v)
    power = F.greatest(F.lit(-1022.0), F.least(F.lit(1023.0), F.floor(F.log2(a)).cast("double")))
    near = a / F.pow(F.lit(2.0), power)  # the logarithm may be off by one at powers of two
    exponent = F.when(near >= 2, power + 1).when(near < 1, power - 1).otherwise(power)
    fraction = F.when(near >= 2, near / 2).when(near < 1, near * 2).otherwise(near)
    normal = (exponent.cast("bigint") + 1023) * F.lit(1 << 52) + ((fraction - 1) * F.lit(float(1 << 52))).cast("bigint")
    small = (a * F.lit(2.0**600) * F.lit(2.0**474)).cast("bigint")
    size = F.when(F.isnan(v), F.lit(_NAN)).when(a == F.lit(math.inf), F.lit(_INFINITY)).when(a < F.lit(_LEAST_NORMAL), small).otherwise(normal)
    return F.when((v < 0) & ~F.isnan(v), -size).otherwise(size)


def value(x: int) -> float:
    """The double of an image."""
    return math.nan if x >= _NAN else math.copysign(struct.unpack("<d", struct.pack("<q", abs(x)))[0], x)


@dataclass
class _Rank:
    """A wanted rank of a question: `rank` (from 0) among the `n` values whose image begins with `known`."""

    no: int
    rank: int = 0
    n: int = 0
    known: int | None = None
    found: float | None = None


def exact_quantiles(df: DataFrame, questions: Mapping[str, tuple[Column, float]], few: int = FEW, passes: list[str] | None = None) -> dict[str, float | None]:
    """name -> quantile q of a column's values, linear between neighbours; null values are left out, and None stands for no values.

    questions: name -> (a column that is null where a row does not count, q). passes: gets what each pass did.
    """
    names = list(questions)
    cells = df.select(F.posexplode(F.array(*(questions[n][0].cast("double") for n in names))).alias("no", "v")).where("v is not null")
    rows = cells.select("no", image(F.col("v")).alias("x"))
    log = passes if passes is not None else []
    place: dict[int, float] = {}
    ranks: dict[tuple[int, bool], _Rank] = {}
    for no, total, low, high in _first(rows, [questions[n][1] for n in names]):
        place[no] = questions[names[no]][1] * (total - 1)
        ranks[no, False], ranks[no, True] = (_Rank(no, math.floor(place[no]) - low[1], low[2], low[0]), _Rank(no, math.ceil(place[no]) - high[1], high[2], high[0]))
    log.append("count")
    for before, shift in zip(SHIFTS, SHIFTS[1:], strict=False):
        if not ranks:
            break
        if all(r.n <= few for r in ranks.values()):
            _sort(rows, list(ranks.values()), before)
            log.append("sort")
            break
        _narrow(rows, list(ranks.values()), before, shift)
        log.append("count")
    out: dict[str, float | None] = dict.fromkeys(names)
    for no in place:
        low, high = (ranks[no, up].found if ranks[no, up].found is not None else value(ranks[no, up].known) for up in (False, True))
        part = place[no] - math.floor(place[no])
        out[names[no]] = low if part == 0 else (1 - part) * low + part * high
    return out


def _counts(rows: DataFrame, shift: int, within: Column) -> DataFrame:
    """no, known (the image's first bits), n, and `before`: values of the same `within` with lower bits."""
    per = rows.groupBy("no", F.shiftright("x", shift).alias("known")).agg(F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy("no", within).orderBy("known").rowsBetween(Window.unboundedPreceding, -1)
    return per.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))


def _first(rows: DataFrame, wanted: list[float]) -> list[tuple]:
    """(question, its number of values, and for the ranks below and above its place: first bits, values before, values with them)."""
    q = F.get(F.array(*(F.lit(float(x)) for x in wanted)), F.col("no"))
    counts = _counts(rows, SHIFTS[0], F.lit(0)).withColumn("total", F.sum("n").over(Window.partitionBy("no")))
    at = q * (F.col("total") - 1)
    hits = counts.select("*", *(((F.col("before") <= r) & (F.col("before") + F.col("n") > r)).alias(c) for c, r in (("low", F.floor(at)), ("high", F.ceil(at)))))
    found: dict[int, dict] = {}
    for r in hits.where("low or high").collect():
        own = found.setdefault(r["no"], {"total": r["total"]})
        own |= {k: (r["known"], r["before"], r["n"]) for k in ("low", "high") if r[k]}
    return [(no, x["total"], x["low"], x["high"]) for no, x in found.items()]


def _among(ranks: list[_Rank], shift: int) -> Column:
    """Rows that share the known bits of one of the ranks."""
    cond = F.lit(False)
    for no, known in sorted({(r.no, r.known) for r in ranks}):
        cond = cond | ((F.col("no") == no) & (F.shiftright("x", shift) == known))
    return cond


def _narrow(rows: DataFrame, ranks: list[_Rank], before: int, shift: int) -> None:
    """The ranks learn their next bits."""
    outer = F.shiftright("known", before - shift)
    counts = _counts(rows.where(_among(ranks, before)), shift, outer)
    cond = F.lit(False)
    for no, known, rank in sorted({(r.no, r.known, r.rank) for r in ranks}):
        cond = cond | ((F.col("no") == no) & (outer == known) & (F.col("before") <= rank) & (F.col("before") + F.col("n") > rank))
    hits = counts.where(cond).collect()
    for r in ranks:
        x = next(h for h in hits if h["no"] == r.no and h["known"] >> (before - shift) == r.known and h["before"] <= r.rank < h["before"] + h["n"])
        r.known, r.rank, r.n = x["known"], r.rank - x["before"], x["n"]


def _sort(rows: DataFrame, ranks: list[_Rank], shift: int) -> None:
    """The answers of ranks with few values beside them."""
    wanted = rows.where(_among(ranks, shift)).groupBy("no", F.shiftright("x", shift).alias("known")).agg(F.sort_array(F.collect_list("x")).alias("xs"))
    places = F.array(*(F.struct(F.lit(r.no).alias("no"), F.lit(r.known).cast("bigint").alias("known"), F.lit(r.rank).cast("int").alias("rank")) for r in ranks))
    picked = wanted.withColumn("p", F.explode(F.filter(places, lambda p: (p["no"] == F.col("no")) & (p["known"] == F.col("known"))))).select("no", "known", "p.rank", F.get("xs", F.col("p.rank")).alias("x"))
    found = {(r["no"], r["known"], r["rank"]): r["x"] for r in picked.collect()}
    for r in ranks:
        r.found = value(found[r.no, r.known, r.rank])
