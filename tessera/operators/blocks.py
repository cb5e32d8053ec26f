"""Random-sample blocks: make, list, pick, sample and split them.

A *blocked table* is any DataFrame with an ``INT block_id`` column.  Block
membership is a pure function of ``(seed, key, n)`` (md5 based), so it is
repeatable, independent of physical partitioning, survives executor loss
and can be written in plain SQL.  Block *choices* (which ids to take) are a
pure function of ``(seed, n, k)`` too; they are computed from the parameters
alone (never from collected data) and applied as ``block_id IN (...)``
filters, which prune ``partitionBy('block_id')`` directories at the scan.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.exprs import block_hash, hash_rank_key
from tessera.session import ensure_checkpoint_dir

BLOCK = "block_id"


# ---------------------------------------------------------------- S7, B10, B16
def assign_blocks(df: DataFrame, key: str, n_blocks: int, seed, col: str = BLOCK) -> DataFrame:
    """Tag every row with its random-sample block ``0 <= block_id < n``.

    ``n_blocks=1`` merges everything into one block (B16); calling it again
    with another ``n`` re-blocks the table (B10).  Narrow: no shuffle.
    """
    return df.withColumn(col, block_hash(F.col(key), n_blocks, seed))


def write_blocked(df: DataFrame, path: str, mode: str = "overwrite", col: str = BLOCK,
                  key: str | None = None, tasks_per_block: int | None = None,
                  rebalance: bool = False) -> None:
    """Blocked table on disk: one directory per block, so block picks prune.

    * default: every task writes its own rows into the block directories
      (no shuffle; many small files);
    * ``rebalance``: Spark's REBALANCE hint on ``block_id``: one shuffle,
      AQE merges small partitions and splits a hot block's partition;
    * ``key`` + ``tasks_per_block``: a salted shuffle with a fixed partition
      count (never coalesced), spreading every block over up to
      ``tasks_per_block`` tasks.
    """
    if key is not None and tasks_per_block:
        salt = F.pmod(F.xxhash64(F.col(key)), F.lit(int(tasks_per_block)))
        n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(tasks_per_block))
        df = df.repartition(n, F.col(col), salt)
    elif rebalance:
        df = df.hint("rebalance", col)
    df.write.mode(mode).partitionBy(col).parquet(path)


# ---------------------------------------------------------------------- B1
def block_inventory(df: DataFrame, col: str = BLOCK) -> DataFrame:
    """B1: ``block_id, n_rows`` (partial aggregation, one row per block)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n_rows"))


# ---------------------------------------------------------------------- B2, B3
def first_blocks(df: DataFrame, n: int, col: str = BLOCK) -> DataFrame:
    """B2: the first ``n`` blocks (``block_id < n``), pushed to the scan."""
    return df.filter(F.col(col) < F.lit(int(n)))


def blocks_by_ids(df: DataFrame, ids: Sequence[int], col: str = BLOCK) -> DataFrame:
    """The blocks whose ids are listed; schema unchanged."""
    ids = sorted({int(i) for i in ids})
    if not ids:
        return df.limit(0)
    return df.filter(F.col(col).isin(ids))


# ---------------------------------------------------------------------- B4, B5
def _rank_value(seed, block_id: int) -> int:
    h = hashlib.md5(f"{seed}:{block_id}".encode()).hexdigest()
    return int(h[:8], 16)


def shuffled_block_ids(n_total: int, seed) -> list[int]:
    """A seeded permutation of ``range(n_total)``.

    Order: ``md5('<seed>:<id>')`` (first 32 bits), ties by id.  SQL twin:
    ``ORDER BY ('0x'||substr(md5('<seed>:'||id),1,8))::BIGINT, id``.
    """
    return sorted(range(int(n_total)), key=lambda b: (_rank_value(seed, b), b))


def random_block_ids(n_total: int, k: int, seed) -> list[int]:
    """``k`` distinct block ids out of ``n_total``, without replacement."""
    return shuffled_block_ids(n_total, seed)[: max(0, int(k))]


def random_blocks(df: DataFrame, n_total: int, k: int, seed, col: str = BLOCK) -> DataFrame:
    """B4 applied: rows of ``k`` randomly chosen blocks."""
    return blocks_by_ids(df, random_block_ids(n_total, k, seed), col)


def train_test_block_ids(n_total: int, n_train: int, n_test: int, seed,
                         strict: bool = True) -> tuple[list[int], list[int]]:
    """Disjoint train ids ``perm[0:t]`` and test ids ``perm[t:t+p]``.

    ``strict`` raises when there are fewer than ``t + p`` blocks (the
    unchecked form silently clamps the lists).
    """
    if strict and n_train + n_test > n_total:
        raise ValueError(f"need {n_train}+{n_test} blocks, have {n_total}")
    perm = shuffled_block_ids(n_total, seed)
    return perm[:n_train], perm[n_train:n_train + n_test]


def split_blocks(df: DataFrame, n_total: int, n_train: int, n_test: int, seed,
                 col: str = BLOCK, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """B5 applied: (train rows, test rows) from disjoint block sets."""
    tr, te = train_test_block_ids(n_total, n_train, n_test, seed, strict)
    return blocks_by_ids(df, tr, col), blocks_by_ids(df, te, col)


def tag_train_test(df: DataFrame, n_total: int, n_train: int, n_test: int, seed,
                   col: str = BLOCK, strict: bool = True) -> DataFrame:
    """B5 as one frame: rows of the chosen blocks with ``role`` train/test."""
    tr, te = train_test_block_ids(n_total, n_train, n_test, seed, strict)
    role = (F.when(F.col(col).isin(tr), F.lit("train"))
            .when(F.col(col).isin(te), F.lit("test")) if tr or te else F.lit(None))
    return blocks_by_ids(df, tr + te, col).withColumn("role", role)


# ---------------------------------------------------------------------- B6
def blocks_by_plan(df: DataFrame, plan: DataFrame, sizes: Sequence[int], extra: int = 0,
                   col: str = BLOCK) -> DataFrame:
    """Size -> block ids through a plan table ``size INT, block_ids ARRAY<INT>``.

    A size that the plan does not list takes ``range(0, size + extra)``
    (``extra`` = number of test blocks in the block arm).  Size 0 that the plan
    does not list, and an empty list in the plan, mean the whole table.
    Returns the rows of every requested size, tagged with ``size``; the size x
    block table is tiny (bounded by the parameters) and is broadcast into a join.
    """
    if not sizes:
        raise ValueError("sizes must not be empty (use the whole table instead)")
    spark = df.sparkSession
    wanted = spark.createDataFrame([(int(s),) for s in set(sizes)], "size INT")
    listed = F.when(F.col("block_ids").isNull() & (F.col("size") > 0),
                    F.sequence(F.lit(0), F.greatest(F.col("size") + F.lit(int(extra) - 1), F.lit(0)))
                    ).otherwise(F.coalesce("block_ids", F.array().cast("array<int>")))
    chosen = wanted.join(plan.select(F.col("size").cast("int").alias("size"), F.col("block_ids")),
                         "size", "left").select("size", listed.alias("ids"))
    whole = [r[0] for r in chosen.filter(F.size("ids") == 0).select("size").distinct().collect()]  # of the asked sizes
    # true of every id: it lets the scan of a partitioned table take the ids from the broadcast and skip the other blocks
    ids = chosen.select("size", F.explode("ids").alias(col)).distinct().filter(F.col(col) >= -2**31)
    out = df.join(F.broadcast(ids), col, "inner")
    for s in sorted(whole):
        out = out.unionByName(df.withColumn("size", F.lit(s)))
    return out


# ---------------------------------------------------------------------- B7-B9
def blocks_for_unit(size: int, unit: float) -> int:
    """``(size * unit)`` truncated to an int."""
    return int(size * unit)


def train_block_count(n_blocks: int, subs: float) -> int:
    """``max(1, int(n_blocks * subs))``."""
    return max(1, int(n_blocks * subs))


def fraction_block_count(n_blocks: int, fraction: float = 0.05) -> int:
    """``ceil(n_blocks * fraction)`` blocks."""
    return int(math.ceil(n_blocks * fraction))


def fraction_of_blocks(df: DataFrame, n_total: int, fraction: float, seed, col: str = BLOCK) -> DataFrame:
    """B9 applied: a seeded random ``fraction`` of the blocks (at least one)."""
    return random_blocks(df, n_total, max(1, fraction_block_count(n_total, fraction)), seed, col)


# ---------------------------------------------------------------------- B11
def sub_blocks(df: DataFrame, key: str, factor: int = 8, seed=0, col: str = BLOCK,
               out: str = "sub_block_id") -> DataFrame:
    """Split every block ``factor`` ways: ``block_id * factor + h``."""
    return df.withColumn(out, F.col(col) * F.lit(int(factor)) + block_hash(F.col(key), factor, f"{seed}:sub"))


# ---------------------------------------------------------------------- B12-B14
def hash_split(df: DataFrame, key: str, fraction: float, seed, out: str = "role") -> DataFrame:
    """B12, reproducible form: a row is ``train`` when its md5 bucket in
    ``[0, 10000)`` is below ``fraction * 10000``, else ``test``.  The seed
    is salted (``<seed>:split``) so the split never lines up with the block
    assignment of the same seed."""
    cut = int(round(fraction * 10000))
    bucket = F.pmod(hash_rank_key(f"{seed}:split", F.col(key)), F.lit(10000))
    return df.withColumn(out, F.when(bucket < F.lit(cut), F.lit("train")).otherwise(F.lit("test")))


def random_split(df: DataFrame, fraction: float, seed: int) -> tuple[DataFrame, DataFrame | None]:
    """``randomSplit([f, 1-f], seed)``; ``f < 0`` keeps every row
    for training and gives no test frame (B13); ``f == 0`` is an error."""
    if fraction == 0:
        raise ValueError("fraction must not be 0")
    if fraction < 0 or fraction >= 1:
        return df, None
    train, test = df.randomSplit([fraction, 1.0 - fraction], seed=seed)
    return train, test


def bernoulli_sample(df: DataFrame, fraction: float, seed: int) -> DataFrame:
    """Bernoulli row sample without replacement."""
    return df.sample(withReplacement=False, fraction=fraction, seed=seed)


def _draw(key, seed) -> Column:
    """60 bits of ``md5('<seed>:draw:<key>')``: a row's place in a random order that
    is the same at every partitioning."""
    text = F.concat(F.lit(f"{seed}:draw:"), F.col(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def hash_sample(df: DataFrame, key: str, fraction: float, seed) -> DataFrame:
    """B14, reproducible form: each row with probability ``fraction``, by the draw of
    its key.  Narrow; a larger fraction keeps all rows of a smaller one."""
    return df.filter(_draw(key, seed) < F.lit(int(fraction * 2**60)))


def exact_split(df: DataFrame, key: str, fraction: float, seed, out: str = "role") -> DataFrame:
    """B12 of exact size: the ``floor(fraction * n)`` rows of the lowest draws are
    ``train``, the others ``test`` (keys unique); without replacement, by counting
    (``nth_in_group``), so no row is moved.  ``fraction < 0`` keeps all for
    training (B13)."""
    if fraction == 0:
        raise ValueError("fraction must not be 0")
    if fraction < 0 or fraction >= 1:
        return df.withColumn(out, F.lit("train"))
    drawn = df.withColumn("_draw", _draw(key, seed))
    cut = nth_in_group(drawn.withColumn("_all", F.lit(0)), "_all", "_draw", fraction).first()    # one row
    last = cut["nth"] if cut is not None and cut["nth"] is not None else -1
    return drawn.withColumn(out, F.when(F.col("_draw") <= F.lit(last), F.lit("train")).otherwise(F.lit("test"))).drop("_draw")


# ---------------------------------------------------------------------- B15
def rank_within(df: DataFrame, group: str, order: str, out: str = "pos",
                size_out: str | None = None) -> DataFrame:
    """Exact 1-based position of each row by ``order`` inside its ``group``.

    ``order`` must be unique within a group.  Unlike a window partitioned by
    ``group`` (which sorts a whole group in one task), this range-partitions
    on ``(group, order)`` so a big or hot group is spread over many tasks;
    per-(group, partition) counts (at most partitions + groups rows) give
    the offsets.
    """
    # Partition ids and row ids are read twice (counts, then join back);
    # a reliable checkpoint pins them, so AQE coalescing or a lost executor
    # can never give the two reads different numbers.
    ensure_checkpoint_dir(df.sparkSession)
    ordered = (df.repartitionByRange(group, order)
               .sortWithinPartitions(group, order)
               .withColumn("_pid", F.spark_partition_id())
               .withColumn("_mid", F.monotonically_increasing_id())
               .checkpoint(eager=True))
    stats = ordered.groupBy(group, "_pid").agg(F.count(F.lit(1)).alias("_n"),
                                               F.min("_mid").alias("_m0"))
    w = Window.partitionBy(group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    stats = stats.withColumn("_off", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    keep = [group, "_pid", "_off", "_m0"]
    if size_out:       # group sizes come free from the same small table
        stats = stats.withColumn(size_out, F.sum("_n").over(Window.partitionBy(group)))
        keep.append(size_out)
    return (ordered.join(F.broadcast(stats.select(*keep)), [group, "_pid"])
            .withColumn(out, F.col("_off") + (F.col("_mid") - F.col("_m0")) + F.lit(1))
            .drop("_pid", "_mid", "_off", "_m0"))


def nth_in_group(df: DataFrame, group: str, order: str, fraction: float, cells: int = 1 << 20) -> DataFrame:
    """``group, n, nth``: the value of the integer column ``order`` at position
    ``floor(fraction * n)`` of its group (n rows, ascending); null where that is 0.

    Exact selection by counting: a pass counts each group's rows in bins of
    the range that still holds the value and goes on in one bin.  It reads two
    columns and shuffles one row a (group, bin); no row is sorted or moved.  The
    passes are the logarithm of the range to the number of bins (about ``cells`` in
    all groups).  Values must lie within 2^62 of 0.
    """
    return _nth_and_take(df, group, order, fraction, cells).drop("take")


def _nth_and_take(df: DataFrame, group: str, order: str, fraction: float, cells: int = 1 << 20) -> DataFrame:
    """``nth_in_group`` with ``take``: how many of the rows that hold the value itself lie
    among the first ``floor(fraction * n)``."""
    ensure_checkpoint_dir(df.sparkSession)
    rows = materialise(df.select(F.col(group).alias("g"), F.col(order).cast("long").alias("v")).filter("v is not null"))   # 16 bytes a row
    found = (rows.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
             .withColumn("want", F.floor(F.lit(float(fraction)) * F.col("n")).cast("long")).checkpoint(eager=True))
    bins = min(4096, max(16, cells // max(1, found.count())))
    while found.filter("want > 0 and lo < hi").limit(1).count():
        step = F.expr(f"(hi - lo) div {bins} + 1")
        near = rows.join(F.broadcast(found.filter("want > 0 and lo < hi").withColumn("step", step)), "g")   # a row a group
        counts = (near.filter("v between lo and hi").groupBy("g", F.expr("(v - lo) div step").alias("bin"))
                  .agg(F.count(F.lit(1)).alias("m")))
        upto = counts.withColumn("c", F.sum("m").over(Window.partitionBy("g").orderBy("bin"))).alias("x")   # ``bins`` rows a group
        hit = (upto.join(found.select("g", "want"), "g").filter("c >= want")
               .groupBy("g").agg(F.min("bin").alias("bin"), F.min_by(F.col("c") - F.col("m"), "bin").alias("before")))
        moved = found.withColumn("step", step).join(hit, "g", "left")
        found = moved.select("g", "n", F.expr("if(bin is null, lo, lo + bin * step)").alias("lo"),
                             F.expr("if(bin is null, hi, least(hi, lo + (bin + 1) * step - 1))").alias("hi"),
                             F.expr("want - coalesce(before, 0)").alias("want")).checkpoint(eager=True)
    rows.unpersist()
    return found.select(F.col("g").alias(group), "n", F.when(F.col("want") > 0, F.col("lo")).alias("nth"), F.col("want").alias("take"))


def holdout_in_block(df: DataFrame, order: str, fraction: float = 0.9, col: str = BLOCK,
                     out: str = "role") -> DataFrame:
    """The first ``floor(fraction * n_b)`` rows of each block (by
    ``order``) are ``train``, the rest ``validate``.

    For an integer ``order`` the cut of each block is found by counting and meets
    the rows as a broadcast of one row a block: no row is shuffled but those that
    share the id at the cut, which a hash of their columns puts in order.  Other
    orders (unique in a block) take an exact distributed rank.
    """
    if df.schema[order].dataType.typeName() in ("byte", "short", "integer", "long"):
        cut = _nth_and_take(df, col, order, fraction).select(F.col(col).alias("_g"), F.col("nth").alias("_nth"), F.col("take").alias("_take"))
        near = df.join(F.broadcast(cut), F.col(col) == F.col("_g"), "left")
        at_cut = F.coalesce(F.col(order) == F.col("_nth"), F.lit(False))
        role = F.when(F.col(order) <= F.col("_nth"), F.lit("train")).otherwise(F.lit("validate"))
        tagged = near.withColumn(out, role)
        many = near.filter(at_cut).groupBy("_g").agg(F.count(F.lit(1)).alias("n"), F.first("_take").alias("take"))
        if many.filter("n > take").limit(1).count():
            place = F.row_number().over(Window.partitionBy("_g").orderBy(F.xxhash64(*df.columns)))
            ranked = near.filter(at_cut).withColumn(out, F.when(place <= F.col("_take"), F.lit("train")).otherwise(F.lit("validate")))
            tagged = tagged.filter(~at_cut).unionByName(ranked)
        return tagged.drop("_g", "_nth", "_take")
    ranked = rank_within(df, col, order, "_pos", size_out="_n_b")
    cut = F.floor(F.lit(float(fraction)) * F.col("_n_b")).cast("long")
    return (ranked.withColumn(out, F.when(F.col("_pos") <= cut, F.lit("train")).otherwise(F.lit("validate")))
            .drop("_pos", "_n_b"))


# ---------------------------------------------------------------------- B17
def materialise(df: DataFrame, level: StorageLevel = StorageLevel.MEMORY_AND_DISK) -> DataFrame:
    """Persist a frame that several jobs reuse (spills, never OOMs)."""
    return df.persist(level)


def hold(df: DataFrame) -> tuple[DataFrame, bool]:
    """Persist ``df`` for a multi-pass operator unless its plan is already
    cached; returns (frame, owned).  Pair with ``release``."""
    lvl = df.storageLevel
    if lvl.useMemory or lvl.useDisk:
        return df, False
    return materialise(df), True


def release(df: DataFrame, owned: bool) -> None:
    """Drop a cache entry only if ``hold`` created it."""
    if owned:
        df.unpersist()
