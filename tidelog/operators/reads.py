"""Reads: latest and as-of views, point, multi-key, range, prefix and paged reads, history, differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import natural_order, nkey
from ..scratch import stored


def newest(kv: DataFrame, as_of: int | None = None) -> DataFrame:
    """One row per key: its newest version (at most ``as_of``), tombstones included.

    A max over structs combines in each task before the shuffle, so a hot key costs one row a task.
    """
    if as_of is not None:
        kv = kv.where(F.col("version") <= as_of)
    m = F.max(F.struct("version", "value", "deleted")).alias("m")
    return kv.groupBy("key").agg(m).select("key", "m.version", "m.value", "m.deleted")


def latest(kv: DataFrame, as_of: int | None = None) -> DataFrame:
    """The visible rows; a tombstone hides every older version."""
    return newest(kv, as_of).where(~F.col("deleted")).select("key", "version", "value")


def get(kv: DataFrame, key: str, as_of: int | None = None) -> DataFrame:
    return latest(kv.where(F.col("key") == key), as_of)


def multi_get(kv: DataFrame, wanted: DataFrame, as_of: int | None = None) -> DataFrame:
    """One row per requested (ordinal, key), in request order, with a found flag."""
    keys = wanted.select("key").distinct()
    seen = latest(kv.join(keys, "key", "left_semi"), as_of)
    return wanted.join(seen, "key", "left").select("ordinal", "key", "value", "version", F.col("version").isNotNull().alias("found"))


def between(kv: DataFrame, start: str, end: str, key: str = "key") -> DataFrame:
    """Natural-order range, both ends included. Reads a materialised ``nkey`` where there is one, so files can be skipped."""
    k = F.col("nkey") if "nkey" in kv.columns else nkey(key)
    return kv.where(k.between(nkey(F.lit(start)), nkey(F.lit(end))))


def range_scan(kv: DataFrame, start: str, end: str, as_of: int | None = None) -> DataFrame:
    """Visible rows of the range, in natural order."""
    return latest(between(kv, start, end), as_of).orderBy(*natural_order())


def prefix_scan(kv: DataFrame, prefix: str, as_of: int | None = None) -> DataFrame:
    """R6 as intended: keys that start with the prefix."""
    return latest(kv.where(F.col("key").startswith(prefix)), as_of).orderBy(*natural_order())


def prefix_range_literal(kv: DataFrame, prefix: str, as_of: int | None = None) -> DataFrame:
    """R6 to the letter (D6): the inclusive range up to the prefix with its last byte raised."""
    end = prefix[:-1] + chr(ord(prefix[-1]) + 1) if prefix else ""
    return range_scan(kv, prefix, end, as_of)


def pages(kv: DataFrame, start: str, end: str, size: int, as_of: int | None = None) -> DataFrame:
    """R8 over the whole range: page number of each row."""
    rows = ranked(latest(between(kv, start, end), as_of), natural_order(), "_n")
    return rows.withColumn("page", F.floor((F.col("_n") - 1) / size).cast("long")).drop("_n")


def page(kv: DataFrame, start: str, end: str, size: int, token: str | None = None, as_of: int | None = None) -> DataFrame:
    """R8, one page: at most size + 1 rows, of which the last one tells the next token."""
    rows = latest(between(kv, start if token is None else token, end), as_of)
    return rows.orderBy(*natural_order()).limit(size + 1)


def history(kv: DataFrame, key: str) -> DataFrame:
    """Every version of a key, newest first."""
    return kv.where(F.col("key") == key).orderBy(F.desc("version"))


def chains(kv: DataFrame) -> DataFrame:
    """Version chains, newest first, as one array per key."""
    chain = F.sort_array(F.collect_list(F.struct("version", "value", "deleted")), asc=False)
    return kv.groupBy("key").agg(chain.alias("chain"))


def validity(kv: DataFrame) -> DataFrame:
    """[version, next_version) per version; null where it is the newest."""
    w = Window.partitionBy("key").orderBy("version")
    return kv.withColumn("next_version", F.lead("version").over(w))


def as_of_join(readers: DataFrame, kv: DataFrame, at: str = "snapshot") -> DataFrame:
    """For each reader (key, ``at``, more) the newest version at most ``at``.

    Readers and versions are merged and carried forward per key: one shuffle, no range join.
    """
    extra = [c for c in readers.columns if c != "key"]
    v = F.struct("version", "value", "deleted")
    left = readers.select("key", F.col(at).alias("_at"), F.lit(1).alias("_side"), F.struct(*extra).alias("_r"), F.lit(None).cast(kv.select(v).schema[0].dataType).alias("_v"))
    right = kv.select("key", F.col("version").alias("_at"), F.lit(0).alias("_side"), F.lit(None).cast(left.schema["_r"].dataType).alias("_r"), v.alias("_v"))
    w = Window.partitionBy("key").orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
    found = left.unionByName(right).withColumn("_v", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    live = ~F.coalesce(F.col("_v.deleted"), F.lit(True))
    return found.select("key", "_r.*", F.when(live, F.col("_v.version")).alias("version"), F.when(live, F.col("_v.value")).alias("value"))


def snapshot_diff(kv: DataFrame, a: int, b: int) -> DataFrame:
    """Keys added, removed or changed from snapshot ``a`` to ``b``; one pass, one shuffle."""
    side = lambda at, c: F.max(F.when(F.col("version") <= at, F.struct("version", "value", "deleted")))[c]
    g = kv.where(F.col("version") <= max(a, b)).groupBy("key").agg(
        F.when(~side(a, "deleted"), F.struct(side(a, "version").alias("version"), side(a, "value").alias("value"))).alias("x"),
        F.when(~side(b, "deleted"), F.struct(side(b, "version").alias("version"), side(b, "value").alias("value"))).alias("y"),
    )
    change = F.when(F.col("x").isNull(), "added").when(F.col("y").isNull(), "removed").when(F.col("x.value") != F.col("y.value"), "changed").otherwise("same")
    return g.where("x is not null or y is not null").select("key", F.col("x.value").alias("old_value"), F.col("y.value").alias("new_value"), change.alias("change"))


def ranked(rows: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Consecutive numbers from 1 in any order, without one task holding all rows.

    The sorted rows are written with their place in their range; the ranges' counts, one row each,
    are added up. Ties of ``order`` are numbered as the sort leaves them.
    """
    at, _ = stored(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()), "ranked")
    at = at.withColumn("_p", F.shiftrightunsigned("_at", 33))
    sizes = at.groupBy("_p").count()
    before = sizes.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    place = F.col("_at") - F.shiftleft("_p", 33) + F.col("_b") + 1
    return at.join(before, "_p").withColumn(name, place.cast("long")).drop("_at", "_p", "_b")


def neighbors(rows: DataFrame, width: int = 65_536) -> DataFrame:
    """Previous and next key in natural order.

    Ranks are dealt to ranges of ``width``; a range's first and last row go to the next range as well.
    """
    n = ranked(rows, natural_order(), "_n")
    own = F.floor(F.col("_n") / width)
    more = F.when(F.pmod("_n", F.lit(width)) == 0, F.array(own, own - 1)).when(F.pmod("_n", F.lit(width)) == width - 1, F.array(own, own + 1)).otherwise(F.array(own))
    w = Window.partitionBy("_g").orderBy("_n")
    out = n.withColumn("_g", F.explode(more)).withColumns({"prev_key": F.lag("key").over(w), "next_key": F.lead("key").over(w)})
    return out.where(own == F.col("_g")).drop("_n", "_g")


def seek(rows: DataFrame, target: str) -> DataFrame:
    """The first row at or after the target."""
    return rows.where(nkey("key") >= nkey(F.lit(target))).orderBy(*natural_order()).limit(1)


def numbered(rows: DataFrame, by: str, name: str, width: int = 1_000_000) -> DataFrame:
    """Consecutive numbers from 1 in order of the long column ``by``, without one task holding all rows.

    Rows are numbered within ranges of ``width`` and shifted by the counts of the ranges before.
    """
    rng = F.floor(F.col(by) / width)
    sizes = rows.groupBy(rng.alias("_g")).count()
    before = sizes.select("_g", F.coalesce(F.sum("count").over(Window.orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    inner = F.row_number().over(Window.partitionBy("_g").orderBy(by))
    return rows.withColumn("_g", rng).join(before, "_g").withColumn(name, (inner + F.col("_b")).cast("long")).drop("_g", "_b")
