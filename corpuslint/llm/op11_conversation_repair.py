"""Conversation structure repair by a run-length dynamic programme over min-plus transitions.

A row is one of nine symbols: it must go (blank or duplicate), or it has a role initial
(s, u, a or another) and is truncated or not. The states are those of the acceptor of
`(s?(ua)+)?` over the initials put out so far. Consuming a symbol is a 4 x 4 matrix of
costs (insertions before the row included) in the min-plus semiring. Equal consecutive
symbols are one run, and a run of length n is crossed with the binary powers of its
symbol's matrix, which are cached for all conversations of a task. With the costs to the
end known at every run's end, the audit is unrolled forwards, at each step by the least
letter that still leads to the least cost: D < I < K < R. The letters fix the roles, as
from any state only one of user and assistant can follow.

Two passes: the first shuffles no texts, only symbols (equal rows of one turn counted
together) and gives the audit; the second sends each conversation's audit ahead of its
rows, which are hashed as they stream by. A conversation's hash is sequential, so its
rows pass through one task; that task holds its runs and its audit (a byte an edit),
never its texts. Which rows are duplicates comes from an aggregate over the digests of
role and text.

Defined cases: nulls in any column read as one space (so a null text is blank), except
that null turns come first and do not count for gaps, and a null conversation id is a
conversation of its own; an empty table gives no rows; rows of one turn stand in the
order of role and text digest, repeated rows side by side (all but the first are
duplicates); a role with another initial can only be given a new role or deleted; very
long texts are hashed whole; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpuslint.llm.common import Scratch, table

WHITE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
FAR = 1 << 60
#: After nothing, after s, after u, after a: the state that each initial leads to.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
TURN = ("u", "u", "a", "u")
ENDS = (0, FAR, FAR, 0)
ROLE = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
GONE = ("", "x")  # the symbol of a row that must go
PIECE = 4096  # rows of a run whose costs are held at once while it is unrolled


def _inserted(costs: list[int]) -> list[int]:
    """Least costs to the end when rows may be inserted first."""
    out = list(costs)
    for _ in range(3):
        out = [min(c, INSERT + out[NEXT[q][TURN[q]]]) for q, c in enumerate(out)]
    return out


def _row_options(symbol: tuple[str, str], q: int) -> list[tuple[str, int, int]]:
    """(letter, cost, next state) of consuming a row in state q, by letter."""
    initial, fault = symbol
    out = [("D", DELETE, q)]
    if fault != "x":
        more = TRUNCATED if fault == "t" else 0
        if initial in NEXT[q]:
            out.append(("K", KEEP + more, NEXT[q][initial]))
        out.append(("R", REROLE + more, NEXT[q][TURN[q]]))
    return out


class Powers:
    """Binary powers of the symbols' min-plus matrices, made once and kept."""

    def __init__(self):
        self.known: dict[tuple[str, str], list[list[list[int]]]] = {}

    def _of(self, symbol: tuple[str, str], k: int) -> list[list[int]]:
        powers = self.known.get(symbol)
        if powers is None:
            step = [[FAR] * 4 for _ in range(4)]
            for q in range(4):
                for _, cost, to in _row_options(symbol, q):
                    step[q][to] = min(step[q][to], cost)
            columns = [_inserted([step[q][to] for q in range(4)]) for to in range(4)]
            powers = self.known[symbol] = [[[columns[to][q] for to in range(4)] for q in range(4)]]
        while len(powers) <= k:
            m = powers[-1]
            powers.append([[min(FAR, min(m[q][x] + m[x][to] for x in range(4))) for to in range(4)] for q in range(4)])
        return powers[k]

    def before(self, symbol: tuple[str, str], n: int, costs: list[int]) -> list[int]:
        """Costs to the end before n rows of the symbol, from those after them."""
        k = 0
        while n >> k:
            if n >> k & 1:
                m = self._of(symbol, k)
                costs = [min(FAR, min(m[q][to] + costs[to] for to in range(4))) for q in range(4)]
            k += 1
        return costs


def repair(runs: list[tuple[tuple[str, str], int]], powers: Powers) -> tuple[int, str]:
    """(cost, audit) of a conversation given as runs of symbols."""
    after = [_inserted(list(ENDS))]
    for symbol, n in reversed(runs):
        after.append(powers.before(symbol, n, after[-1]))
    cost, audit, q = after[-1][0], [], 0
    for k, (symbol, n) in enumerate(runs):
        end = after[len(runs) - 1 - k]
        while n:
            rows = min(n, PIECE)
            n -= rows
            costs = [powers.before(symbol, n, end)]  # after the piece, then before each of its rows
            for _ in range(rows):
                costs.append(powers.before(symbol, 1, costs[-1]))
            while rows:
                now, then = costs[rows][q], costs[rows - 1]
                options = _row_options(symbol, q)
                options.insert(1, ("I", INSERT, -1))
                for letter, price, to in options:
                    if letter == "I":
                        to = NEXT[q][TURN[q]]
                        if price + costs[rows][to] == now:
                            break
                    elif price + then[to] == now:
                        break
                audit.append(letter)
                q = to
                rows -= letter != "I"
    while after[0][q]:
        audit.append("I")
        q = NEXT[q][TURN[q]]
    return cost, "".join(audit)


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times): the rows after damage; a dropped row stands 0 times, a repeated one twice."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20
    read = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), told("role").alias("role"), told("text").alias("text"), kind.alias("kind"))
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 0, 0).when(F.col("kind") == 3, 2).otherwise(1)
    return read.select("conv_id", "turn", F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), times.cast("long").alias("times"))


def _digest(role: str, text: str) -> Column:
    return F.unhex(F.sha2(F.concat_ws(":", F.sha2(role, 256), F.sha2(text, 256)), 256))


_PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation, from its rows in order."""
    names = [c.split()[0] for c in _PLAN.split(", ")]
    powers, out = Powers(), []
    key, runs = None, []
    low = high = turn = before = None
    distinct = blank = duplicate = truncated = illegal = 0

    def done() -> tuple:
        cost, audit = repair(runs, powers)
        return (key[0], 0 if low is None else high - low + 1 - distinct, blank, duplicate, truncated, illegal, cost, audit)

    def handed() -> pa.RecordBatch:
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    columns = ("conv_id", "turn", "initial", "bare", "cut", "earlier", "times")
    for batch in batches:
        for conv, at, initial, bare, cut, earlier, times in zip(*[batch.column(c).to_pylist() for c in columns]):
            if key is None or key[0] != conv:
                if key is not None:
                    out.append(done())
                key, runs = (conv,), []
                low = high = turn = before = None
                distinct = blank = duplicate = truncated = illegal = 0
            if not times:
                continue
            if at is not None:
                if at != turn or low is None:
                    distinct += 1
                low, high, turn = at if low is None else low, at, at
            illegal += (before is not None and before + initial not in LEGAL) + times - 1
            before = initial
            if bare:
                blank += times
                symbols = [(GONE, times)]
            else:
                gone = times if earlier else times - 1
                duplicate += gone
                truncated += cut and not earlier
                symbols = [] if earlier else [((initial, "t" if cut else "o"), 1)]
                symbols += [(GONE, gone)] if gone else []
            for symbol, n in symbols:
                if runs and runs[-1][0] == symbol:
                    runs[-1] = (symbol, runs[-1][1] + n)
                else:
                    runs.append((symbol, n))
        if len(out) >= 1000:
            yield handed()
            out = []
    if key is not None:
        out.append(done())
    if out:
        yield handed()


_HASHED = "conv_id long, repaired_sha256 string"


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """The repaired rows: the audit's letters applied to a conversation's (role, text) rows in order."""
    q = 0
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(rows)
        if letter == "D":
            continue
        if letter != "K":
            role = ROLE[TURN[q]]
        q = NEXT[q][role[:1]]
        yield role, text


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digest of every conversation's repaired rows; its audit comes first, then its rows in order."""
    def rows_of(stream) -> Iterator[tuple]:
        for batch in stream:
            yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "times")])

    out, stream = [], rows_of(batches)
    row = next(stream, None)
    while row is not None:
        conv, audit = row[0], row[1]
        ahead = [None]

        def own(conv=conv, ahead=ahead) -> Iterator[tuple[str, str]]:
            for r in stream:
                if r[1] is not None:
                    ahead[0] = r
                    return
                for _ in range(r[4]):
                    yield r[2], r[3]

        rows, sha, first = own(), hashlib.sha256(), True
        for role, text in edited(audit, rows):
            sha.update((role + ":" + text if first else "\n" + role + ":" + text).encode("utf-8"))
            first = False
        for _ in rows:  # rows that stand no times
            pass
        out.append((conv, sha.hexdigest()))
        row = ahead[0]
        if len(out) >= 5000 or row is None:
            yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], pa.int64()), pa.array([h for _, h in out], pa.string())], ["conv_id", "repaired_sha256"])
            out = []


def repaired_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, n, role, text): every conversation as repaired, its rows numbered from 0."""
    plans, texts, _ = _planned(rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows_of() -> Iterator[tuple]:
            for batch in batches:
                yield from zip(*[batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "times")])

        conv = audit = None
        place = n = q = 0
        for c, a, role, text, times in rows_of():
            out = []
            if a is not None:
                conv, audit, place, n, q = c, a, 0, 0, 0
                times = 0
            while place < len(audit) and (audit[place] == "I" or times):
                letter = audit[place]
                place += 1
                r, x = ("", "") if letter == "I" else (role, text)
                times -= letter != "I"
                if letter != "D":
                    r = r if letter == "K" else ROLE[TURN[q]]
                    q = NEXT[q][r[:1]]
                    out.append((conv, n, r, x))
                    n += 1
            if out:
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], ["conv_id", "n", "role", "text"])

    return _with_audits(plans, texts).mapInArrow(work, "conv_id long, n long, role string, text string")


def _planned(rows: DataFrame) -> tuple[DataFrame, DataFrame, Scratch]:
    """Plans by conversation, the damaged rows with their digest, and their scratch tables."""
    scratch = Scratch(rows.sparkSession, "conversations")
    texts = damaged(rows).withColumn("dig", _digest("role", "text"))
    shown = F.rtrim("text", F.lit(WHITE))
    bare = shown == ""
    cut = ~F.right(shown, F.lit(1)).isin(".", "!", "?")
    symbols = scratch.keep(texts.groupBy("conv_id", "turn", "role", "dig").agg(F.sum("times").alias("times"), F.first(bare).alias("bare"), F.first(cut).alias("cut")))
    # null turns come first: a turn is later than another if it is not null and larger, or the other is null
    first = symbols.where("times > 0").groupBy("conv_id", "dig").agg(F.min(F.struct(F.col("turn").isNotNull().alias("set"), "turn")).alias("first"), F.count(F.lit(1)).alias("turns")).where("turns > 1")
    other = first.select(F.col("conv_id").alias("conv2"), F.col("dig").alias("dig2"), "first")
    joined = symbols.join(other, F.col("conv_id").eqNullSafe(F.col("conv2")) & (F.col("dig") == F.col("dig2")), "left")
    earlier = F.col("first").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first.turn"))
    ordered = (joined.select("conv_id", "turn", "role", "dig", F.substring("role", 1, 1).alias("initial"), "bare", "cut", earlier.alias("earlier"), "times")
               .repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "dig"))
    plans = scratch.keep(ordered.mapInArrow(_plans, _PLAN))
    return plans, texts, scratch


def _with_audits(plans: DataFrame, texts: DataFrame) -> DataFrame:
    """Each conversation's audit and after it its rows in order, in one task."""
    none = F.lit(None)
    heads = plans.select("conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("binary").alias("dig"),
                         none.cast("string").alias("text"), F.lit(0).cast("long").alias("times"), "audit")
    rows = texts.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "dig", "text", "times", none.cast("string").alias("audit"))
    return heads.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "dig")


def conversation_repair(rows: DataFrame) -> DataFrame:
    """One row for each conversation: gaps, faults, cost, audit and the digest of its repaired rows."""
    plans, texts, _ = _planned(rows)
    hashes = _with_audits(plans, texts).select("conv_id", "audit", "role", "text", "times").mapInArrow(_hashes, _HASHED)
    other = hashes.withColumnRenamed("conv_id", "conv2")
    return plans.join(other, F.col("conv_id").eqNullSafe(F.col("conv2"))).drop("conv2")


def query(spark, sf_dir):
    return conversation_repair(table(spark, sf_dir, "conversations"))
