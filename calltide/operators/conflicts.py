"""Overlapping accesses of different ranks, at least one of them a write."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from calltide.operators.sequence import scan
from calltide.runtime import BROADCAST_ROWS, cut


SALTS = 32


def _tiles(first, last, size) -> F.Column:  # noqa: ANN001
    return F.sequence(F.floor(first / size), F.floor(last / size))


def conflict_pairs(ranges: DataFrame, smallest: int | None = 4096, carried: Sequence[str] = (), also: Callable[[str, str], dict[str, Column]] | None = None) -> DataFrame:
    """filename and the two accesses (rank, seq, rw, fh, offset) of every conflicting pair, each pair once.

    ``ranges`` has filename, rank, seq_id, offset, count, is_read and mpifh. Two accesses conflict if their ranks differ,
    one of them isn't a read, and each begins before the other ends; one of no bytes conflicts only strictly inside another. Nulls in
    rank, offset or count never conflict, a null is_read counts as a write, a negative count as none; repeated rows repeat their pairs.

    Ranges are tiled by size class: a range lies in at most two tiles of the smallest power of two that is no less than
    its length, and asks at most two tiles in each larger class that occurs. So neither a hot file nor a very long range
    is compared with all others, and every pair is met in just one tile. With ``smallest`` None, a file's smallest class is
    that of its median length. ``also`` makes further columns of a pair from the names of its two sides, which have the
    columns ``carried``; it has to give the same for the sides swapped.
    """
    rows = ranges.filter("filename is not null and rank is not null and `offset` is not null and `count` >= 0").select(
        "filename", "rank", F.col("seq_id").alias("seq"), F.coalesce("is_read", F.lit(False)).alias("is_read"), F.col("offset").alias("a"),
        (F.col("offset") + F.col("count")).alias("z"), F.coalesce("mpifh", F.lit("-")).alias("fh"), *carried,
    )
    length = F.greatest(F.col("z") - F.col("a"), F.lit(smallest or 1))
    rows = rows.withColumn("cls", F.ceil(F.log2(length)).cast("int"))
    rows = rows.withColumn("last", F.greatest(F.col("a"), F.col("z") - 1))
    rows = rows.withColumn("id", F.xxhash64("rank", "seq", "a", "z", "is_read", "fh"))
    sizes = rows.groupBy(F.col("filename").alias("_f"), "cls").agg(F.count("*").alias("n"))  # at most 63 a file
    if smallest is None:
        upto = F.sum("n").over(Window.partitionBy("_f").orderBy("cls"))
        all_ = F.sum("n").over(Window.partitionBy("_f"))
        sizes = sizes.withColumn("_upto", upto).withColumn("_all", all_)
        sizes = sizes.withColumn("least", F.min(F.when(F.col("_upto") * 2 >= F.col("_all"), F.col("cls"))).over(Window.partitionBy("_f")))
        sizes = sizes.select("_f", "least", F.greatest("cls", "least").alias("cls"))
    else:
        sizes = sizes.withColumn("least", F.lit(0))
    classes = cut(sizes.groupBy("_f").agg(F.collect_set("cls").alias("classes"), F.max("least").alias("least")), "size-classes")
    if classes.count() <= BROADCAST_ROWS:
        asking = rows.join(F.broadcast(classes), F.col("filename") == F.col("_f")).drop("_f")
    else:  # one file may hold a large part of all ranges
        salts = F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))
        asking = rows.withColumn("_salt", F.pmod("id", F.lit(SALTS))).join(classes.withColumn("_s", F.explode(salts)), (F.col("filename") == F.col("_f")) & (F.col("_salt") == F.col("_s"))).drop("_f", "_s", "_salt")
    sized = asking.withColumn("cls", F.greatest("cls", "least")).drop("least")
    tile = F.pow(F.lit(2.0), F.col("cls")).cast("bigint")
    home = sized.drop("classes").withColumn("tile", F.explode(_tiles(F.col("a"), F.col("last"), tile)))
    asking = sized.withColumn("ask", F.explode(F.filter("classes", lambda c: c >= F.col("cls")))).drop("classes")
    size = F.pow(F.lit(2.0), F.col("ask")).cast("bigint")
    asking = asking.withColumn("tile", F.explode(_tiles(F.col("a"), F.col("last"), size)))
    l, r = asking.alias("l"), home.alias("r")
    first = F.greatest(F.floor(F.col("l.a") / F.pow(F.lit(2.0), F.col("l.ask"))), F.floor(F.col("r.a") / F.pow(F.lit(2.0), F.col("l.ask"))))
    met = (
        (F.col("l.filename") == F.col("r.filename"))
        & (F.col("l.ask") == F.col("r.cls"))
        & (F.col("l.tile") == F.col("r.tile"))
        & (F.col("l.rank") != F.col("r.rank"))
        & ~(F.col("l.is_read") & F.col("r.is_read"))
        & (F.col("l.z") > F.col("r.a"))
        & (F.col("r.z") > F.col("l.a"))
        & (F.col("l.tile") == first)
        & ((F.col("l.cls") < F.col("r.cls")) | (F.col("l.rank") < F.col("r.rank")))
    )
    joined = l.join(r, met)
    # ranks of a pair differ
    swap = (F.col("l.a") > F.col("r.a")) | ((F.col("l.a") == F.col("r.a")) & (F.col("l.rank") > F.col("r.rank")))
    rw = lambda s: F.when(F.col(f"{s}.is_read"), "read").otherwise("write")
    fields = {"rank": lambda s: F.col(f"{s}.rank"), "seq": lambda s: F.col(f"{s}.seq"), "rw": rw, "fh": lambda s: F.col(f"{s}.fh"), "offset": lambda s: F.col(f"{s}.a")}
    sides = [F.when(swap, c(x)).otherwise(c(y)).alias(f"{f}{i}") for i, x, y in ((1, "r", "l"), (2, "l", "r")) for f, c in fields.items()]
    return joined.select(F.col("l.filename").alias("filename"), *sides, *[c.alias(f) for f, c in (also("l", "r") if also else {}).items()])


def conflicts_per_access(pairs: DataFrame) -> DataFrame:
    """How many conflicts the first access of each pair has."""
    return pairs.groupBy("filename", "rank1", "seq1").agg(F.count("*").alias("n_conflicts"))


def conflict_lines(pairs: DataFrame) -> DataFrame:
    """The text form: per file a number, dense and without meaning, and one line for each first access with all its partners."""
    files = pairs.select("filename").distinct().withColumn("_crc", F.crc32("filename")).withColumn("_all", F.lit(0))
    files = scan(files, ["_all"], ["_crc", "filename"], {"file_idx": ("sum", F.lit(1), False)}, 1 << 20).select("filename", "file_idx")
    op = lambda i: F.concat_ws(",", f"rank{i}", f"seq{i}", f"rw{i}", f"fh{i}")
    partners = F.concat_ws(" ", F.transform(F.sort_array(F.collect_set(F.struct("rank2", "seq2", op(2).alias("t")))), lambda x: x["t"]))
    lines = pairs.groupBy("filename", "rank1", "seq1", op(1).alias("op")).agg(partners.alias("partners"))
    return lines.join(files, "filename").select("file_idx", "filename", "rank1", "seq1", F.concat_ws(":", "op", "partners").alias("line"))
