"""Best-fit packing of token sequences by the configuration linear program.

Texts are encoded, closed with an end id, and cut where longer than a sequence: full pieces from the
end, so that the first piece may be shorter.  The histogram of piece lengths (one count per length,
`capacity` at most) goes to the driver.  There the linear program

    as few sequences as possible, each filled by one configuration (a multiset of lengths that fits),
    so that every length is covered as often as it occurs

is solved by multiplicative weights: each length has a price, which grows the less of it is covered;
a knapsack dynamic program over the capacity finds the configurations of greatest price, and a share of
what they can cover is added to their amounts, until every length is covered.  Amounts are rounded up as
far as pieces are left; what their rounding leaves over is packed best-fit: the longest piece first, then
what fills the rest exactly, or else the longest that fits.

The result is a plan of configurations with multiplicities, whose size doesn't depend on the number of
pieces.  The r-th piece of a length finds its sequence and offset in the plan by a binary search; r
comes from a count per (length, partition) and its running sum, so no task needs all pieces of one
length.

A null or empty text is the end id alone.  Equal rows are packed as often as they stand there.

An empty table gives no rows.  Columns other than doc_id and text are not read.  A text of any length is encoded by one task;
one of more than the capacity becomes whole sequences and one shorter piece.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialise, small_batches
from .tokens import Vocabulary

Plan = list[tuple[Counter, int]]
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long"


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids; only the first may be shorter than capacity."""
    head = n % capacity or min(n, capacity)
    return [(0, head), *((s, capacity) for s in range(head, n, capacity))]


def pieces(docs: DataFrame, vocabulary: Vocabulary, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """PIECES of every text, written to the shared folder; part and nth count pieces of a length."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4")
    names = [x.split()[0] for x in PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, encoder, seen = TaskContext.get().partitionId(), vocabulary.encoder(), Counter()
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for b in batches:
            rows = []
            for doc_id, got in zip(b.column(0).to_pylist(), encoder.each(b.column(1)), strict=True):
                data = np.concatenate([got, end]).astype("<u4").tobytes()
                for k, (s, n) in enumerate(cut(len(got) + 1, capacity)):
                    ids = data[4 * s : 4 * (s + n)]
                    rows.append((doc_id, k, s, n, zlib.crc32(ids), part, seen[n], *([ids] * with_ids)))
                    seen[n] += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types)], names=names)

    return materialise(docs.select("doc_id", "text").mapInArrow(run, PIECES + ", ids binary" * with_ids), "pieces")


def _knapsack(price: np.ndarray, lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Unbounded knapsack: for each room the greatest total price that fits, and a length it ends with (0: none)."""
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    ends = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        n = ends[c]
        best[c], last[c] = best[c - 1], 0
        if n:
            value = price[:n] + best[c - lengths[:n]]
            k = int(value.argmax())
            if value[k] > best[c]:
                best[c], last[c] = value[k], lengths[k]
    return best, last


def _configuration(last: np.ndarray, c: int) -> Counter:
    """The multiset of lengths that fills a room of c at the greatest price."""
    out = Counter()
    while c > 0:
        if last[c]:
            out[int(last[c])] += 1
            c -= int(last[c])
        else:
            c -= 1
    return out


def program(histogram: dict[int, int], capacity: int, share: float = 0.5, rate: float = 0.3, slack: float = 0.1) -> tuple[Plan, dict[int, int]]:
    """The linear program's plan, and what its rounding leaves over of each length.

    A turn takes the best configuration, and those that come within `slack` of its price and have no
    length in common with one already taken.  Each step covers `share` of what some length needs, or
    all that it lacks; covered lengths leave.  So (1 / share + 1) turns a length are enough for all.
    """
    plan: Plan = [(Counter({capacity: 1}), histogram[capacity])] if histogram.get(capacity) else []
    lengths = np.array(sorted(n for n in histogram if n < capacity and histogram[n]), np.int64)
    need = np.array([histogram[int(n)] for n in lengths], float)
    place = {int(n): i for i, n in enumerate(lengths)}
    covered, amounts = np.zeros(len(lengths)), {}
    while len(lack := np.flatnonzero(covered < need)):
        price = lengths[lack] * np.exp(-rate * covered[lack] / need[lack])
        best, last = _knapsack(price, lengths[lack], capacity)
        value = price + best[capacity - lengths[lack]]
        taken: set[int] = set()
        for k in np.argsort(-value, kind="stable"):
            n = int(lengths[lack[k]])
            if taken and value[k] < (1 - slack) * best[capacity]:
                break
            if n in taken:
                continue
            c = _configuration(last, capacity - n)
            c[n] += 1
            if not taken.isdisjoint(c):
                continue
            taken.update(c)
            at = np.array([place[x] for x in c])
            times = np.array(list(c.values()), float)
            step = float((np.minimum(share * need[at], need[at] - covered[at]) / times).min())
            covered[at] += step * times
            full = at[covered[at] >= need[at] * (1 - 1e-9)]
            covered[full] = need[full]
            key = tuple(sorted(c.items()))
            amounts[key] = amounts.get(key, 0.0) + step
    left = {int(n): int(histogram[int(n)]) for n in lengths}
    for key, x in sorted(amounts.items(), key=lambda kv: (-kv[1], kv[0])):
        m = min([int(np.ceil(x - 1e-6)), *(left[n] // k for n, k in key)])
        if m > 0:
            plan.append((Counter(dict(key)), m))
            for n, k in key:
                left[n] -= k * m
    return plan, left


def solve(histogram: dict[int, int], capacity: int) -> Plan:
    """Configurations and how often each is used; together they hold exactly the histogram's pieces."""
    plan, left = program(histogram, capacity)
    return plan + best_fit(left, capacity)


def best_fit(left: dict[int, int], capacity: int) -> Plan:
    """Pack what is left; a configuration is repeated until one of its lengths runs out."""
    count, plan = np.zeros(capacity + 1, np.int64), []
    for n, k in left.items():
        count[n] = k
    while count.any():
        c, room, have = Counter(), capacity, count.copy()
        while room and len(some := np.flatnonzero(have[: room + 1])):
            pick = int(some[-1])
            if c and not have[room]:
                both = some[(have[room - some] > 0) & ((room - some != some) | (have[some] > 1))]
                if len(both):
                    pick = int(both[-1])
            c[pick] += 1
            have[pick] -= 1
            room -= pick
        m = min(int(count[n]) // k for n, k in c.items())
        plan.append((c, m))
        for n, k in c.items():
            count[n] -= k * m
    return plan


def intervals(plan: Plan) -> dict[str, np.ndarray]:
    """For each length in each configuration: first rank, first sequence, how often per sequence, offset."""
    rows, used, sequence = [], Counter(), 0
    for c, m in plan:
        offset = 0
        for n, k in sorted(c.items(), reverse=True):
            rows.append(((n << 44) + used[n], sequence, k, offset, n))
            used[n] += k * m
            offset += k * n
        sequence += m
    a = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return dict(zip(("key", "sequence", "times", "offset", "length"), a.T, strict=True))


def pack(table: DataFrame, capacity: int = 2048) -> DataFrame:
    """table (from `pieces`) with sequence_id and offset."""
    spark = table.sparkSession
    counts = materialise(table.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = intervals(solve(histogram, capacity))
    shared = spark.sparkContext.broadcast(plan)
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row per length and partition: no proven bound, so no broadcast.
    ranked = table.join(bases.hint("merge"), ["length", "part"]).withColumn("rank", F.col("base") + F.col("nth"))
    keep = [c for c in table.columns if c not in ("part", "nth")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        for b in batches:
            n, r = b.column(keep.index("length")).to_numpy(), b.column(len(keep)).to_numpy()
            i = np.searchsorted(p["key"], (n << 44) + r, "right") - 1
            r = r - (p["key"][i] - (n << 44))
            cols = [pa.array(p["sequence"][i] + r // p["times"][i]), pa.array(p["offset"][i] + r % p["times"][i] * n)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names=[*keep, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.select(*keep).schema.fields)
    return ranked.select(*keep, "rank").mapInArrow(place, f"{fields}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from pieces made with ids: (sequence_id, ids binary).

    A group holds one sequence, `capacity` ids at most.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))


def pack_documents(docs: DataFrame, vocabulary: Vocabulary, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    return pack(pieces(docs, vocabulary, capacity, end_id), capacity)
