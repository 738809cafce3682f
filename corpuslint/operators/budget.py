"""The greedy count/byte budget (A8) of all overflowing repositories at once, without a fold over a repository.

Files are taken in path order; one that would overflow the bytes is skipped and a later,
smaller one may still fit. What makes this parallel is that the bytes left only shrink.
With R bytes left and T the largest power of two up to R, a file under T fits as long as
at least T bytes are left, and of the files from T on at most one is taken before less
than T is left. So a *phase* takes every small file and skips every large one that does
not fit, until the file after which less than T is left (or the count is full). Each
phase at least halves what is left, so there are no more phases than the byte cap has
binary digits, whatever the number of files.

Positions are the rows of one range-sorted table, so a repository spreads over tasks. It
is cut into buckets of at most 2 ** BUCKET_BITS files, and an index holds, for each
bucket and each power of two, the number, sum and least size of its files. From the
index alone follows the first bucket in which a repository's phase can end; only that
bucket's rows are looked at, in order, by one bounded array fold, which ends as many
phases as end there. A round does so for all repositories together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpuslint.functions.columns import path_key
from corpuslint.session import delete_tables, write_table

ANY = 1 << 62  # more than any byte count or number of files
BUCKET_BITS = 14

_PHASES = "array<struct<start:bigint,end:bigint,small:bigint>>"


def _power(left: str) -> str:
    """The largest power of two up to `left`, at least 1."""
    return f"(case when {left} >= 1 then shiftleft(1L, cast(length(bin({left})) - 1 as int)) else 1L end)"


def _after(rows: str, cap: int) -> str:
    """State after a bucket's rows (pos, size): a taken file that leaves less than `small`, or fills the count, ends a phase."""
    rest = "(s.bytes - r.size)"
    same = f"named_struct('bytes', {rest}, 'taken', s.taken + 1, 'small', s.small, 'start', s.start, 'phases', s.phases)"
    ended = (f"named_struct('bytes', {rest}, 'taken', s.taken + 1, 'small', {_power(rest)}, 'start', r.pos, "
             "'phases', concat(s.phases, array(named_struct('start', s.start, 'end', r.pos, 'small', s.small))))")
    goes_on = f"({rest} >= s.small or s.bytes < s.small) and s.taken + 1 < {cap}L"
    return (f"aggregate({rows}, named_struct('bytes', bytes, 'taken', taken, 'small', small, 'start', start, 'phases', phases), "
            f"(s, r) -> case when s.taken >= {cap}L or r.size > s.bytes then s when {goes_on} then {same} else {ended} end)")


def positions(files: DataFrame, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """The files with `pos`, rising by (repo, path order), and the `bucket` of neighbours they lie in."""
    ranged = files.repartitionByRange("repo", path_key("path")).sortWithinPartitions("repo", path_key("path"))
    return ranged.withColumn("pos", F.monotonically_increasing_id()).withColumn("bucket", F.shiftright("pos", bucket_bits))


def budget_phases(placed: DataFrame, max_files: int | None, max_bytes: int | None) -> DataFrame:
    """(repo, taken, small, start, phases): the ended phases (start, end, small) in order and the one that goes on to the end.

    A phase decides the positions after `start` up to `end`: files under `small` are
    taken and so is the file at `end`; no other is. `taken` files are taken in all.
    """
    cap_n, cap_b = (ANY if c is None else c for c in (max_files, max_bytes))
    paths = []

    def kept(df: DataFrame) -> DataFrame:
        out, path = write_table(df)
        paths.append(path)
        return out

    size = F.col("size_bytes")
    digits = F.when(size > 0, F.length(F.bin(size))).otherwise(0)
    index = kept(placed.groupBy("repo", "bucket", digits.alias("digits")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"), F.min(size).alias("least")))
    zero = F.lit(0).cast("bigint")
    state = kept(index.groupBy("repo").agg(F.max("bucket").alias("last")).select(
        "repo", "last", zero.alias("at"), F.lit(cap_b).cast("bigint").alias("bytes"), zero.alias("taken"), F.expr(_power(f"{cap_b}L")).alias("small"),
        (zero - 1).alias("start"), F.expr(f"cast(array() as {_PHASES})").alias("phases"), F.lit(cap_n > 0).alias("moved")))
    while True:
        now = state.filter("moved").drop("moved", "last")
        power = F.length(F.bin("small")) - 1
        counted = index.join(now.drop("phases"), "repo").filter(F.col("bucket") >= F.col("at"))
        is_small = F.col("digits") <= power
        buckets = counted.groupBy("repo", "bucket", "bytes", "taken", "small").agg(
            F.sum(F.when(is_small, F.col("b")).otherwise(0)).alias("b"), F.sum(F.when(is_small, F.col("n")).otherwise(0)).alias("n"),
            F.min(F.when(F.col("digits") == power + 1, F.col("least"))).alias("least"))
        upto = Window.partitionBy("repo").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
        summed = buckets.withColumn("sum_b", F.sum("b").over(upto)).withColumn("sum_n", F.sum("n").over(upto))
        left = F.col("bytes") - F.col("sum_b")
        may_end = (((left < F.col("small")) & (F.col("bytes") >= F.col("small"))) | (F.col("taken") + F.col("sum_n") >= cap_n)
                   | F.coalesce(F.col("least") <= left + F.col("b"), F.lit(False)))
        first = summed.filter(may_end).groupBy("repo").agg(F.min(F.struct(
            "bucket", (left + F.col("b")).alias("bytes"), (F.col("taken") + F.col("sum_n") - F.col("n")).alias("taken"))).alias("f"))
        entered = (now.drop("bytes", "taken").join(first, "repo")
                   .select("repo", "at", "small", "start", "phases", "f.bucket", "f.bytes", "f.taken"))
        rows = (placed.join(entered.select("repo", "bucket", "at"), ["repo", "bucket"]).groupBy("repo")
                .agg(F.array_sort(F.collect_list(F.struct("pos", F.col("size_bytes").alias("size")))).alias("rows")))
        folded = entered.join(rows, "repo").withColumn("s", F.expr(_after("rows", cap_n)))
        went = folded.select("repo", F.struct((F.col("bucket") + 1).alias("at"), "s.bytes", "s.taken", "s.small", "s.start", "s.phases").alias("w"))
        own = [F.coalesce(f"w.{c}", c).alias(c) for c in ("at", "bytes", "taken", "small", "start", "phases")]
        more = F.coalesce((F.col("w.at") <= F.col("last")) & (F.col("w.taken") < cap_n), F.lit(False))
        state = kept(state.join(went, "repo", "left").select("repo", "last", *own, more.alias("moved")))
        if state.filter("moved").isEmpty():
            break
    out = write_table(state.select("repo", "taken", "small", "start", "phases"))[0]
    delete_tables(placed.sparkSession, paths)
    return out


def budget_decisions(candidates: DataFrame, max_files: int | None, max_bytes: int | None, bucket_bits: int = BUCKET_BITS) -> DataFrame:
    """(repo, path, size_bytes, skip_rule) of the files of overflowing repositories."""
    placed = write_table(positions(candidates, bucket_bits))[0]
    phases = budget_phases(placed, max_files, max_bytes)
    cap_n = ANY if max_files is None else max_files
    pos, size = F.col("pos"), F.col("size_bytes")
    own = F.get(F.filter("phases", lambda p: (p["start"] < pos) & (pos <= p["end"])), F.lit(0))
    decided = placed.join(phases, "repo").withColumn("own", own)
    full = F.col("own").isNull() & (F.col("taken") >= cap_n)
    taken = (size < F.coalesce("own.small", "small")) | F.coalesce(pos == F.col("own.end"), F.lit(False))
    rule = F.when(full, F.lit("max_files")).when(~taken, F.lit("max_total_bytes"))
    return decided.select("repo", "path", "size_bytes", rule.alias("skip_rule"))
