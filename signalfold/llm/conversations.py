"""Repair of conversations: the cheapest edits that give turns in a legal order, by Dial's shortest paths.

A legal conversation has the role initials (s?(ua)+)?. A node is (rows read, what may follow); keeping, deleting or
reroling a row and inserting a turn are its arcs. All costs are whole numbers up to MOST, so distances to the end come from a
circular queue of buckets (Dial) without a heap; the audit is then walked from the start along tight arcs, of which the
letter that is least in ASCII goes first, which gives the least audit of the cheapest ones. A letter stands for one arc
at most, as only one of user and assistant may follow any node.

Spark sorts rows by conversation and turn, and a task streams over them; it holds one conversation. One with more than
LONG_ROWS rows or LONG_BYTES of text (any share of the table may be one) is cut into segments of bounded size that lie
in several range partitions: each segment gives the distances between its ends for all four states, these are
composed along the conversation (one small row a segment), each segment then walks its own arcs, and only the
repaired text streams through one task, piece by piece, as a digest of the whole must.

Defined cases: a null text or role counts as one blank; a null conv_id is a conversation of its own; null turns come first; rows
of equal turn are ordered by role, then text; of rows that repeat role and text all but the first are duplicates; a role
whose initial is not s, u or a (the empty one has none) can't be kept as it is; a conversation all of whose rows are marked as gone
gives zeros, an empty audit and the digest of nothing; an empty table gives an empty result; long texts are read whole;
conv_id may be of any type with an order; turn is read as a whole number; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, partial

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalfold.llm.store import SPACES, broadcast_if_small, heavy_light_join, materialize, ship

#: Costs of edits, and of a truncated row that stays (fixed values).
DELETE, INSERT, REROLE, CUT = 4, 3, 3, 3
MOST = REROLE + CUT
#: What may follow: anything, the user after a system turn, the assistant, or the user after a pair.
START, SYSTEM, USER, PAIR = range(4)
STATES, GOALS = 4, (START, PAIR)
#: The state after the one turn that an insertion or a new role can give, and after a kept row.
NEXT = (USER, USER, PAIR, USER)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
NAMES = {USER: "user", PAIR: "assistant"}
LEGAL = {"su", "ua", "au"}
FAR = 1 << 60

#: Rows and bytes of text of a conversation that one task holds, and of a segment of a longer one.
LONG_ROWS, LONG_BYTES = 20_000, 16 << 20
SEGMENT_ROWS, SEGMENT_BYTES = 8192, 4 << 20
RESULT = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


# -- shortest paths ------------------------------------------------------------------------------------
def _arcs(kind: str) -> list[list[tuple[str, int, int]]]:
    """For each state the arcs over a row of this kind: (letter, state after it, cost), in the order of the letters.

    Kinds: `-` must go; else the initial (x: neither s, u nor a), as a capital where the row is truncated.
    """
    out = []
    for state in range(STATES):
        arcs = [("D", state, DELETE)]
        if kind != "-":
            extra = CUT if kind.isupper() else 0
            if (to := KEPT.get((state, kind.lower()))) is not None:
                arcs.append(("K", to, extra))
            arcs.append(("R", NEXT[state], REROLE + extra))
        out.append(arcs)
    return out


ARCS = {k: _arcs(k) for k in "-suaxSUAX"}
#: The same from their ends: (state before, cost).
BACK = {k: [[(s, c) for s in range(STATES) for _, t, c in arcs[s] if t == to] for to in range(STATES)] for k, arcs in ARCS.items()}
BEFORE = [[s for s in range(STATES) if NEXT[s] == to] for to in range(STATES)]


def distances(kinds: str, ends: dict[int, int]) -> list[int]:
    """Distance of each node (STATES * rows read + state) to the end, where a state costs what `ends` says."""
    n = len(kinds)
    out = [FAR] * (STATES * (n + 1))
    least = min(ends.values())
    size = max(MOST, max(ends.values()) - least) + 1
    buckets: list[list[int]] = [[] for _ in range(size)]
    for state, d in ends.items():
        out[STATES * n + state] = d
        buckets[(d - least) % size].append(STATES * n + state)
    waiting, d = len(ends), least
    while waiting:
        bucket = buckets[(d - least) % size]
        while bucket:
            node = bucket.pop()
            waiting -= 1
            if out[node] != d:
                continue  # reached on a shorter way since
            row, state = divmod(node, STATES)
            found = [(STATES * row + s, INSERT) for s in BEFORE[state]]
            if row:
                found += [(STATES * (row - 1) + s, c) for s, c in BACK[kinds[row - 1]][state]]
            for before, c in found:
                if d + c < out[before]:
                    out[before] = d + c
                    buckets[(d + c - least) % size].append(before)
                    waiting += 1
        d += 1
    return out


def walk(kinds: str, far: list[int], state: int, last: bool = True) -> tuple[str, int]:
    """(letters of the least tight path from the first row, state after it); where more rows follow (last is False) it ends with the rows."""
    audit, row, n = [], 0, len(kinds)
    while row < n or (last and far[STATES * row + state]):
        d = far[STATES * row + state]
        arcs = ARCS[kinds[row]][state] if row < n else []
        for letter, to, c, step in sorted([(x, to, c, 1) for x, to, c in arcs] + [("I", NEXT[state], INSERT, 0)]):
            if far[STATES * (row + step) + to] + c == d:
                audit.append(letter)
                row, state = row + step, to
                break
    return "".join(audit), state


def solve(kinds: str) -> tuple[int, str]:
    """(cost, audit) of a whole conversation."""
    far = distances(kinds, dict.fromkeys(GOALS, 0))
    return far[START], walk(kinds, far, START)[0]


_remembered = lru_cache(1 << 14)(solve)


def apply(audit: str, roles: list[str], texts: list[str], state: int = START) -> list[str]:
    """The repaired `role:text` of each turn that the audit leaves or makes."""
    out, row = [], 0
    for letter in audit:
        if letter == "K":
            state = KEPT[state, roles[row][:1]]
            out.append(f"{roles[row]}:{texts[row]}")
        elif letter in "IR":
            state = NEXT[state]
            out.append(f"{NAMES[state]}:{texts[row] if letter == 'R' else ''}")
        row += letter != "I"
    return out


# -- rows ----------------------------------------------------------------------------------------------
class _Faults:
    """The faults of consecutive rows, and their kinds."""

    def __init__(self):
        self.kinds: list[str] = []
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.before = None  # initials
        self.turns: list[int] = []  # distinct ones, ascending as the rows are

    def add(self, role: str, turn: int | None, end: str, seen: bool) -> None:
        """end: the text's last character that is no white space, empty if there is none."""
        initial = role[:1]
        if self.before is not None:
            self.illegal += self.before + initial not in LEGAL
        else:
            self.first = initial
        self.before = initial
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)
        kind = initial if initial and initial in "sua" else "x"
        if not end:
            self.blank += 1
            kind = "-"
        elif seen:
            self.duplicate += 1
            kind = "-"
        elif end not in ".!?":
            self.truncated += 1
            kind = kind.upper()
        self.kinds.append(kind)

    def gaps(self) -> int:
        return self.turns[-1] - self.turns[0] + 1 - len(self.turns) if self.turns else 0


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


_TYPES = {"long": pa.int64(), "string": pa.string()}


def _result(kind: pa.DataType) -> pa.Schema:
    return pa.schema([("conv_id", kind), *((n, _TYPES[t]) for n, t in (x.split() for x in RESULT.split(", ")))])


def _whole(conv_id, rows: list[tuple]) -> tuple:
    """The result of one conversation; rows: (turn, role, text, end) in order."""
    faults, seen = _Faults(), set()
    for turn, role, text, end in rows:
        faults.add(role, turn, end, (role, text) in seen)
        seen.add((role, text))
    kinds = "".join(faults.kinds)
    cost, audit = (_remembered if len(kinds) <= 64 else solve)(kinds)
    repaired = "\n".join(apply(audit, [r[1] for r in rows], [r[2] for r in rows]))
    return conv_id, faults.gaps(), faults.blank, faults.duplicate, faults.truncated, faults.illegal, cost, audit, hashlib.sha256(repaired.encode()).hexdigest()


def _stream(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (conv_id, turn, role, text, end, gone) to a result for each conversation."""
    held, own, out, schema, begun = [], None, [], None, False
    for b in it:
        schema = schema or _result(b.column(0).type)
        for conv_id, turn, role, text, end, gone in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if begun and conv_id != own:
                out.append(_whole(own, held))
                held = []
            own, begun = conv_id, True
            if not gone:
                held.append((turn, role, text, end))
        if out:
            yield _batch(out, schema)
            out = []
    if begun:
        yield _batch([_whole(own, held)], schema)


# -- conversations in segments -------------------------------------------------------------------------
_SEGMENT = "key string, seg long, kinds string, roles array<string>, texts array<string>, costs array<long>, counts array<long>, first string, last string, low long, high long"


def _segments(it: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted rows (key, turn, role, text, end, later) to segments with the distances between their ends."""
    number = TaskContext.get().partitionId() << 32
    own, before, faults, roles, texts, size = None, None, _Faults(), [], [], 0
    names = [x.split()[0] for x in _SEGMENT.split(", ")]
    lists = {"roles": pa.list_(pa.string()), "texts": pa.list_(pa.string()), "costs": pa.list_(pa.int64()), "counts": pa.list_(pa.int64())}
    schema = pa.schema([(n, lists.get(n, pa.int64() if n in ("seg", "low", "high") else pa.string())) for n in names])

    def flush() -> pa.RecordBatch:
        kinds = "".join(faults.kinds)
        to = [distances(kinds, {t: 0}) for t in range(STATES)]
        turns = faults.turns
        counts = [faults.blank, faults.duplicate, faults.truncated, faults.illegal, len(turns)]
        return _batch([(own, number, kinds, roles, texts, [to[t][s] for s in range(STATES) for t in range(STATES)], counts, faults.first, faults.before,
                        turns[0] if turns else None, turns[-1] if turns else None)], schema)

    for b in it:
        for key, turn, role, text, end, later in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if texts and (key != own or len(texts) >= most or size >= SEGMENT_BYTES):
                yield flush()
                number, faults, roles, texts, size = number + 1, _Faults(), [], [], 0
            same = (key, turn, role, text)
            faults.add(role, turn, end, later or same == before)
            own, before = key, same
            roles.append(role)
            texts.append(text)
            size += len(text)
    if texts:
        yield flush()


def _ends(rows: pd.DataFrame) -> pd.DataFrame:
    """key, seg, `ends`: what each state after a segment costs to the end of its conversation."""
    rows = rows.sort_values("seg")
    far = [0 if s in GOALS else FAR for s in range(STATES)]
    far = [min(far[s], INSERT + far[NEXT[s]], 2 * INSERT + far[NEXT[NEXT[s]]]) for s in range(STATES)]
    out = []
    for costs in reversed(rows["costs"].tolist()):
        out.append(far)
        far = [min(int(costs[STATES * s + t]) + far[t] for t in range(STATES)) for s in range(STATES)]
    return pd.DataFrame({"key": rows["key"].tolist(), "seg": rows["seg"].tolist(), "ends": out[::-1], "cost": [far[START]] * len(rows)})


def _walks(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seg, kinds, ends, last) to the audit and the state after it for each state before."""
    for b in it:
        for key, seg, kinds, ends, last in zip(*(c.to_pylist() for c in b.columns), strict=True):
            far = distances(kinds, dict.fromkeys(GOALS, 0) if last else dict(enumerate(ends)))
            audits, after = zip(*(walk(kinds, far, s, last) for s in range(STATES)), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([seg]), pa.array([list(audits)]), pa.array([list(after)], pa.list_(pa.int64()))], names=["key", "seg", "audits", "after"])


def _starts(rows: pd.DataFrame) -> pd.DataFrame:
    """key, seg and the state that each segment begins in."""
    rows = rows.sort_values("seg")
    state, out = START, []
    for after in rows["after"].tolist():
        out.append(state)
        state = int(after[state])
    return pd.DataFrame({"key": rows["key"].tolist(), "seg": rows["seg"].tolist(), "start": out})


def _pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, seg, start, audits, roles, texts) to the segment's part of the audit and of the repaired text."""
    for b in it:
        for i in range(b.num_rows):
            key, seg, start, audits, roles, texts = (c[i].as_py() for c in b.columns)
            lines = apply(audits[start], roles, texts, start)
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([seg]), pa.array([audits[start]]), pa.array(["\n".join(lines)]), pa.array([bool(lines)])], names=["key", "seg", "audit", "piece", "some"])


def _joined(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces of conversations to their results; a piece at a time is held, beside the audit."""
    own = kind = None

    def flush() -> pa.RecordBatch:
        gaps = high - low + 1 - distinct if low is not None else 0
        return _batch([(conv_id, gaps, *sums, illegal, cost, "".join(audits), digest.hexdigest())], _result(kind))

    for b in it:
        kind = b.column(1).type
        for i in range(b.num_rows):
            key, name, audit, piece, some, total, counts, begin, end, least, most = (c[i].as_py() for c in b.columns)
            if key != own:
                if own is not None:
                    yield flush()
                own, conv_id, cost, audits, digest = key, name, total, [], hashlib.sha256()
                sums, illegal, distinct, low, high, before, any_ = [0, 0, 0], 0, 0, None, None, None, False
            audits.append(audit)
            if some:
                digest.update(("\n" * any_ + piece).encode())
                any_ = True
            sums = [x + y for x, y in zip(sums, counts[:3], strict=True)]
            illegal += counts[3] + (before is not None and before + begin not in LEGAL)
            before = end
            distinct += counts[4] - (least is not None and least == high)
            low, high = least if low is None else low, high if most is None else most
    if own is not None:
        yield flush()


class Repairer:
    def __init__(self, rows: DataFrame, gone: str | None = None, long_rows: int = LONG_ROWS, long_bytes: int = LONG_BYTES, segment_rows: int = SEGMENT_ROWS):
        """rows: conv_id, turn, role, text; gone: a column that is true for rows which only say that their conversation exists."""
        ship(rows.sparkSession)
        blank = F.lit(" ")
        text = F.coalesce(F.col("text").cast("string"), blank)
        end = F.right(F.rtrim(text, F.lit(SPACES)), F.lit(1))
        self.rows = rows.select(
            "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), blank).alias("role"), text.alias("text"),
            end.alias("end"), (F.coalesce(F.col(f"`{gone}`"), F.lit(False)) if gone else F.lit(False)).alias("gone"))
        self.long_rows, self.long_bytes, self.segment_rows = long_rows, long_bytes, segment_rows
        self.kind = rows.schema["conv_id"].dataType

    def _key(self):
        return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))

    def repair(self) -> DataFrame:
        """One row for each conversation: conv_id and the columns of RESULT."""
        made = f"conv_id {self.kind.simpleString()}, {RESULT}"
        keyed = self.rows.withColumn("key", self._key())
        live = F.when(~F.col("gone"), F.lit(1))
        sizes = keyed.groupBy("key").agg(F.count(live).alias("n"), F.sum(F.octet_length("text")).alias("bytes"), F.first("conv_id").alias("name"))
        long = materialize(sizes.where((F.col("n") > self.long_rows) | ((F.col("bytes") > self.long_bytes) & (F.col("n") > 1))), "long")
        n_long = long.count()
        short = keyed if not n_long else keyed.join(broadcast_if_small(long.select("key"), n_long), "key", "left_anti")
        sorted_ = short.select("conv_id", "turn", "role", "text", "end", "gone").repartition("conv_id").sortWithinPartitions("conv_id", F.asc_nulls_first("turn"), "role", "text")
        out = sorted_.mapInArrow(_stream, made)
        return out if not n_long else out.unionByName(self._in_segments(keyed.where(~F.col("gone")), long, n_long, made))

    def _in_segments(self, keyed: DataFrame, long: DataFrame, n_long: int, made: str) -> DataFrame:
        rows = keyed.join(broadcast_if_small(long.select("key"), n_long), "key", "left_semi").withColumn("sha", F.unhex(F.sha2("text", 256)))
        at = F.struct(F.col("turn").isNotNull().alias("some"), "turn")
        firsts = rows.groupBy("key", "role", "sha").agg(F.min(at).alias("first"), F.count(F.lit(1)).alias("copies"))
        marked = heavy_light_join(rows, materialize(firsts, "firsts"), ["key", "role", "sha"], "copies")
        # Equal rows share a range: what they are dealt by ends where a long role or text goes on.
        brief = F.char_length("role") <= 16
        ranges = [F.asc_nulls_first("key"), F.asc_nulls_first("turn"), F.left("role", F.lit(16)), ~brief, F.when(brief, F.left("text", F.lit(64)))]
        dealt = marked.select("key", "turn", "role", "text", "end", (at > F.col("first")).alias("later"))
        parts = max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        dealt = dealt.repartitionByRange(parts, *ranges).sortWithinPartitions("key", F.asc_nulls_first("turn"), "role", "text")
        segments = materialize(dealt.mapInArrow(partial(_segments, most=self.segment_rows), _SEGMENT), "segments")
        ends = materialize(segments.select("key", "seg", "costs").groupBy("key").applyInPandas(_ends, "key string, seg long, ends array<long>, cost long"), "ends")
        last = segments.groupBy("key").agg(F.max("seg").alias("last"))
        narrow = segments.select("key", "seg", "kinds").join(ends, ["key", "seg"]).join(broadcast_if_small(last, n_long), "key")
        walks = materialize(narrow.select("key", "seg", "kinds", "ends", (F.col("seg") == F.col("last")).alias("last")).mapInArrow(_walks, "key string, seg long, audits array<string>, after array<long>"), "walks")
        starts = walks.select("key", "seg", "after").groupBy("key").applyInPandas(_starts, "key string, seg long, start int")
        chosen = segments.select("key", "seg", "roles", "texts").join(walks, ["key", "seg"]).join(starts, ["key", "seg"])
        pieces = chosen.select("key", "seg", "start", "audits", "roles", "texts").mapInArrow(_pieces, "key string, seg long, audit string, piece string, some boolean")
        facts = segments.select("key", "seg", "counts", "first", "last", "low", "high").join(ends.select("key", "seg", "cost"), ["key", "seg"])
        whole = pieces.join(facts, ["key", "seg"]).join(broadcast_if_small(long.select("key", "name"), n_long), "key")
        ordered = whole.repartition("key").sortWithinPartitions("key", "seg").select("key", "name", "audit", "piece", "some", "cost", "counts", "first", "last", "low", "high")
        return ordered.mapInArrow(_joined, made)


def damage(rows: DataFrame) -> DataFrame:
    """The contract's faults, by crc32(conv_id:turn) modulo 20; a dropped row stays, marked in `gone`."""
    blank = F.lit(" ")
    fate = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))) % 20
    text = F.coalesce("text", blank)
    return rows.select("conv_id", "turn", "role", "text", fate.alias("fate")).select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.coalesce("role", blank)).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (F.col("fate") == 0).alias("gone"), F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")).drop("copy")
