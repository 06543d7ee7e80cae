"""Exact selection of the k largest values without sorting the table.

Values are first collapsed to (value, count), map-side. An order-preserving
64-bit code of the value is then read digit by digit, 12 bits a round: a
histogram of at most 4,096 digits tells which digit holds rank k, and the
next round looks only at the values that share it. Six rounds leave one
value and how many of its rows still belong to the first k. Everything is
one lazy plan: building it starts no job, nothing is sorted or checkpointed,
and the rounds read the same exchange of (value, count).

Ties at the cut are broken by a unique id in the same way, among the tied
rows only.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGIT_BITS = 12
_SHIFTS = [52, 40, 28, 16, 4, 0]
_NONE = -2049  # first digit of NULL: below every value
_DIGITS = [f"_d{j}" for j in range(len(_SHIFTS))]


def order_code(df: DataFrame, col: str) -> Column:
    """A long that orders like the column: integers as they are, decimals by
    their unscaled value, which must fit 64 bits."""
    kind = df.schema[col].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(col).cast("long")
    if isinstance(kind, T.DecimalType):
        unscaled = (F.col(col).cast(f"decimal(38,{kind.scale})") * F.lit(Decimal(10) ** kind.scale)).cast("decimal(38,0)")
        if kind.precision <= 18:
            return unscaled.cast("long")
        fits = unscaled.isNull() | (F.abs(unscaled) < F.lit(Decimal(1 << 63)))
        return F.when(fits, unscaled.try_cast("long")).otherwise(F.raise_error(F.lit(f"{col}: a value of more than 64 bits")).cast("long"))
    raise TypeError(f"{col}: no exact order code for {kind.simpleString()}; cast it to a decimal")


def _with_digits(df: DataFrame, code: Column) -> DataFrame:
    df = df.withColumn("_x", code)
    out = {"_d0": F.coalesce(F.shiftright("_x", _SHIFTS[0]), F.lit(_NONE)).cast("long")}
    for name, shift, above in zip(_DIGITS[1:], _SHIFTS[1:], _SHIFTS, strict=False):
        part = F.shiftright("_x", shift).bitwiseAND(F.lit((1 << (above - shift)) - 1))
        out[name] = F.coalesce(part, F.lit(0)).cast("long")
    return df.withColumns(out).drop("_x")


def _code_of_digits() -> Column:
    x = F.lit(0).cast("long")
    for name, shift in zip(_DIGITS, _SHIFTS, strict=True):
        x = x + F.shiftleft(F.col(name), shift)
    return F.when(F.col("_d0") != _NONE, x)


def cut(counted: DataFrame, code: Column, rank) -> DataFrame:
    """``counted`` has a row per value with ``n`` rows of it (and any sum
    ``s`` of them). One row (none for an empty table): _cut, the code of the
    value at the given rank from the top (NULL ranks last); take, how many
    of its rows are among the first; want, the rank; n_total, s_total of all
    rows, n_known of those with a value, n_above, s_above of those above the
    cut. ``rank`` gives the rank as a column, from the total."""
    base = _with_digits(counted, code)
    picked = None
    for j, digit in enumerate(_DIGITS):
        prefix = _DIGITS[:j]
        rows = base if picked is None else base.join(F.broadcast(picked), prefix)
        carried = ["want", "n_total", "n_known", "s_total", "n_above", "s_above"] if picked is not None else []
        g = rows.groupBy(*prefix, digit).agg(F.sum("n").alias("c"), F.sum("s").alias("z"),
                                             *[F.max(x).alias(x) for x in [*carried, *(["left"] if carried else [])]])
        # at most 4,096 rows: the digits below one prefix
        down = Window.orderBy(F.desc(digit)).rowsBetween(Window.unboundedPreceding, -1)
        g = g.withColumns({"c_before": F.coalesce(F.sum("c").over(down), F.lit(0)), "z_before": F.sum("z").over(down)})
        if picked is None:
            whole = Window.partitionBy()
            known = F.sum(F.when(F.col(digit) != _NONE, F.col("c")).otherwise(0)).over(whole)
            g = g.withColumns({"n_total": F.sum("c").over(whole), "n_known": known, "s_total": F.sum("z").over(whole)})
            g = g.withColumn("want", rank(F.col("n_total")).cast("long")).withColumns(
                {"left": F.col("want"), "n_above": F.lit(0).cast("long"), "s_above": F.lit(None).cast(g.schema["z"].dataType)})
        hit = (F.col("c_before") < F.col("left")) & (F.col("left") <= F.col("c_before") + F.col("c"))
        first = (F.col("left") <= 0) & (F.col("c_before") == 0)  # rank 0: nothing is taken
        g = g.filter(hit | first)
        picked = g.select(*prefix, digit, "want", "n_total", "n_known", "s_total", (F.col("left") - F.col("c_before")).alias("left"),
                          (F.col("n_above") + F.col("c_before")).alias("n_above"),
                          F.coalesce(F.col("s_above") + F.col("z_before"), "s_above", "z_before").cast("decimal(38,4)").alias("s_above"))
    return picked.select(_code_of_digits().alias("_cut"), F.col("left").alias("take"), "want", "n_total", "n_known", "s_total", "n_above", "s_above")


def share_rank(share: float):
    """ROUND(n * share), exact in decimal."""
    return lambda n: F.round(n * F.lit(Decimal(str(share)))).cast("long")


def split_top(df: DataFrame, value: str, unique_id: str, share: float, name: str = "in_top") -> DataFrame:
    """The rows with a flag: among the ROUND(n * share) largest by
    ``value``. Ties go to smaller ids; ids that are no integers tie by their
    hash."""
    code = order_code(df, value)
    counted = df.groupBy(code.alias("_v")).agg(F.count(F.lit(1)).alias("n")).withColumn("s", F.lit(None).cast("decimal(38,4)"))
    at = cut(counted, F.col("_v"), share_rank(share))
    integral = isinstance(df.schema[unique_id].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    # ascending ids: the largest of the complements
    tie = F.bitwise_not(F.col(unique_id).cast("long") if integral else F.xxhash64(unique_id))
    edge = at.select(F.struct("_cut", "take").alias("e"))
    tagged = df.withColumns({"_code": code, "_tie": tie}).withColumn("_edge", edge.scalar())
    ties = (tagged.filter(F.col("_code").eqNullSafe(F.col("_edge")["_cut"])).groupBy("_tie")
            .agg(F.count(F.lit(1)).alias("n"), F.max(F.col("_edge")["take"]).alias("take")).withColumn("s", F.lit(None).cast("decimal(38,4)")))
    last = cut(ties.select("_tie", "n", "s"), F.col("_tie"), lambda n: F.least(n, at.select("take").scalar()))
    tagged = tagged.withColumn("_last", last.select(F.struct("_cut", "want").alias("e")).scalar())
    above = F.coalesce(F.col("_code") > F.col("_edge")["_cut"], F.col("_code").isNotNull() & F.col("_edge")["_cut"].isNull())
    tied = (F.col("_code").eqNullSafe(F.col("_edge")["_cut"]) & (F.col("_last")["want"] > 0)
            & (F.col("_tie") >= F.col("_last")["_cut"]))
    return tagged.withColumn(name, F.coalesce(above, F.lit(False)) | F.coalesce(tied, F.lit(False))).drop("_code", "_tie", "_edge", "_last")
