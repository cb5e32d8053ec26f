"""Registered block and itemset queries, each with its DuckDB SQL twin.

Inputs: brand baskets (``lineitem`` x ``part``), 8 md5 blocks (seed 42).
Every query reads the whole given tables; SQL twins use the same hash,
threshold and key rules written in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.exprs import itemset_key, itemset_text
from tessera.operators import blocks as B
from tessera.operators import fim
from tessera.plans import fim_runs
from tessera.session import apply_defaults, ensure_checkpoint_dir
from tessera.sources import (baskets, item_dictionary, read_blocked, read_blocked_text, read_blocks, read_centers,
                             read_table, read_text_transactions, stored_inventory, write_blocked_text, write_itemsets_csv,
                             write_manifest, write_text_lines)

# fixed parameters of the registered queries
SEED = 42            # block assignment seed
PICK_SEED = 7        # seed of random block choices
N_BLOCKS = 8
MIN_SUPPORT = 0.02
VOTE = 0.5
FLOOR = 0.01
FIRST_N = 3
IDS = [1, 4, 6]
RANDOM_K = 3
N_TRAIN, N_TEST = 4, 2
PLAN = [(2, [0, 3]), (4, [1, 2, 5, 7])]
PLAN_SIZES = [2, 4, 3]
FRACTION = 0.25
SPLIT = 0.9
SWEEP = [2, 4, 8]
RECOUNT_BLOCKS = 4
K_FRACTION = max(1, B.fraction_block_count(N_BLOCKS, FRACTION))


def blocked_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    apply_defaults(spark)
    return B.materialise(B.assign_blocks(baskets(spark, sf_dir), "tid", N_BLOCKS, SEED))


def write_baskets(spark: SparkSession, sf_dir: str) -> str:
    """The path of the blocked baskets, written as one directory a block in the shared folder."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/blocks-{uuid.uuid4().hex}"
    apply_defaults(spark)
    B.write_blocked(B.assign_blocks(baskets(spark, sf_dir), "tid", N_BLOCKS, SEED), path)
    return path


def stored_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocked baskets as a table of one directory a block in the shared
    folder, so that a block pick reads only its directories."""
    return read_blocked(spark, write_baskets(spark, sf_dir))


def skewed_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two blocks: about a hundredth of the baskets and the rest."""
    tx = B.assign_blocks(baskets(spark, sf_dir), "tid", 101, SEED)
    return B.materialise(tx.withColumn("block_id", (F.col("block_id") > 0).cast("int")))


def _keyed(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(itemset_key("items").alias("itemset"), *cols)


# ------------------------------------------------------------------ queries
def q_baskets(spark, sf):
    tx = baskets(spark, sf)
    return tx.select("tid", itemset_text("items").alias("items_text"),
                     F.size("items").alias("n_items"))


def q_assign_blocks(spark, sf):
    return B.assign_blocks(baskets(spark, sf), "tid", N_BLOCKS, SEED).select("tid", "block_id")


def q_block_inventory(spark, sf):
    return B.block_inventory(blocked_baskets(spark, sf))


def q_block_manifest(spark, sf):
    """B1 from the stored manifest; the table is not scanned."""
    path = write_baskets(spark, sf)
    write_manifest(spark, path)
    return stored_inventory(spark, path)


def q_blocks_listed(spark, sf):
    """B4 through the manifest: only the chosen blocks' directories are listed."""
    path = write_baskets(spark, sf)
    write_manifest(spark, path)
    return read_blocks(spark, path, B.random_block_ids(N_BLOCKS, RANDOM_K, PICK_SEED)).select("tid", "block_id")


def q_blocks_first_n(spark, sf):
    return B.first_blocks(stored_baskets(spark, sf), FIRST_N).select("tid", "block_id")


def q_blocks_by_ids(spark, sf):
    return B.blocks_by_ids(stored_baskets(spark, sf), IDS).select("tid", "block_id")


def q_blocks_random_n(spark, sf):
    return B.random_blocks(stored_baskets(spark, sf), N_BLOCKS, RANDOM_K, PICK_SEED).select("tid", "block_id")


def q_block_train_test(spark, sf):
    return B.tag_train_test(stored_baskets(spark, sf), N_BLOCKS, N_TRAIN, N_TEST,
                            PICK_SEED).select("tid", "block_id", "role")


def q_blocks_by_plan(spark, sf):
    plan = spark.createDataFrame(PLAN, "size INT, block_ids ARRAY<INT>")
    return B.blocks_by_plan(stored_baskets(spark, sf), plan, PLAN_SIZES).select("size", "tid", "block_id")


def q_blocks_fraction(spark, sf):
    return B.fraction_of_blocks(stored_baskets(spark, sf), N_BLOCKS, FRACTION,
                                PICK_SEED).select("tid", "block_id")


def q_row_split(spark, sf):
    return B.hash_split(baskets(spark, sf), "tid", SPLIT, SEED).select("tid", "role")


def q_block_holdout(spark, sf):
    return B.holdout_in_block(blocked_baskets(spark, sf), "tid", SPLIT).select("tid", "block_id", "role")


def q_local_thresholds(spark, sf):
    tx = blocked_baskets(spark, sf)
    own = fim.local_thresholds(tx, MIN_SUPPORT, "own").select(
        "block_id", "n_rows", F.col("threshold").alias("threshold_own"))
    avg = fim.local_thresholds(tx, MIN_SUPPORT, "average").select(
        "block_id", F.col("threshold").alias("threshold_average"))
    return own.join(avg, "block_id")


def q_fim_local(spark, sf):
    loc = fim.local_itemsets(blocked_baskets(spark, sf), MIN_SUPPORT, "own")
    return _keyed(loc, "block_id", "support")


def _sum(spark, sf, floor=FLOOR):
    return fim_runs.sum_arm(blocked_baskets(spark, sf), N_BLOCKS, MIN_SUPPORT, floor)


def q_fim_sum(spark, sf):
    return _keyed(_sum(spark, sf), "support", "frequency")


def q_fim_min_frequency(spark, sf):
    return _keyed(_sum(spark, sf, floor=0.03), "support", "frequency")


def q_fim_drop_singletons(spark, sf):
    return _keyed(fim.drop_singletons(_sum(spark, sf)), "support", "frequency")


def q_fim_vote(spark, sf):
    out = fim_runs.vote_arm(baskets(spark, sf), N_BLOCKS, MIN_SUPPORT, VOTE, SEED)
    return _keyed(out, "support", "votes")


def q_fim_text_lines(spark, sf):
    out = fim_runs.vote_arm(baskets(spark, sf), N_BLOCKS, MIN_SUPPORT, VOTE, SEED)
    return fim.text_lines(out)


def q_fim_vote_sampled(spark, sf):
    """a blocked text source (one directory per block, written to the
    shared folder), a seeded fraction of its blocks, vote, text lines."""
    import uuid
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/text-blocks-{uuid.uuid4().hex}"
    write_blocked_text(blocked_baskets(spark, sf), path)
    return fim_runs.sampled_vote_arm(read_blocked_text(spark, path), N_BLOCKS, FRACTION, MIN_SUPPORT,
                                     VOTE, PICK_SEED)


def q_fim_candidates(spark, sf):
    loc = fim.local_itemsets(blocked_baskets(spark, sf), MIN_SUPPORT, "average")
    return _keyed(fim.candidates(loc))


def q_fim_recount(spark, sf):
    out = fim_runs.recount_arm(blocked_baskets(spark, sf), N_BLOCKS, RECOUNT_BLOCKS,
                               MIN_SUPPORT, PICK_SEED)
    return _keyed(out, "support", "frequency")


def q_fim_exact(spark, sf):
    return _keyed(fim_runs.exact_arm(blocked_baskets(spark, sf), MIN_SUPPORT), "support", "frequency")


def q_itemset_key(spark, sf):
    # exact FP-growth, length > 1, "{a,b}" key with int support
    out = fim.drop_singletons(fim_runs.exact_arm(blocked_baskets(spark, sf), MIN_SUPPORT))
    return _keyed(out, F.col("support").cast("int").alias("support"))


def q_fim_sweep(spark, sf):
    return _keyed(fim_runs.sweep(blocked_baskets(spark, sf), SWEEP, MIN_SUPPORT, FLOOR),
                  "size", "support", "frequency")


def q_scan_text_tx(spark, sf):
    """Write the baskets as a text file into the shared checkpoint
    folder, then scan it back as transactions."""
    import uuid
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/text-tx-{uuid.uuid4().hex}"
    baskets(spark, sf).select(itemset_text("items").alias("value")).write.mode("overwrite").text(path)
    tx = read_text_transactions(spark, path)
    return tx.select(itemset_text("items").alias("items_text"), F.size("items").alias("n_items"))


# other basket shapes: dense (p_type, 6 items, long itemsets), sparse (p_name, 64 items)
DENSE_SUPPORT = 0.1
SPARSE_SUPPORT = 0.005
SPARSE_FLOOR = 0.005


def shaped_baskets(spark: SparkSession, sf_dir: str, attribute: str) -> DataFrame:
    apply_defaults(spark)
    return B.materialise(B.assign_blocks(baskets(spark, sf_dir, attribute), "tid", N_BLOCKS, SEED))


def _named(df: DataFrame, spark: SparkSession, sf_dir: str, attribute: str, *cols: str) -> DataFrame:
    """Itemsets as texts, so that merged items cannot hide."""
    named = fim.with_names(df, item_dictionary(spark, sf_dir, attribute))
    return named.select(F.array_join("names", "|").alias("itemset"), *cols)


def q_fim_vote_dense(spark, sf):
    out = fim_runs.vote_arm(baskets(spark, sf, "p_type"), N_BLOCKS, DENSE_SUPPORT, VOTE, SEED)
    return _named(out, spark, sf, "p_type", "support", "votes")


def q_fim_exact_dense(spark, sf):
    out = fim_runs.exact_arm(shaped_baskets(spark, sf, "p_type"), DENSE_SUPPORT)
    return _named(out, spark, sf, "p_type", "support", "frequency")


def q_fim_exact_sparse(spark, sf):
    out = fim_runs.exact_arm(shaped_baskets(spark, sf, "p_name"), SPARSE_SUPPORT)
    return _named(out, spark, sf, "p_name", "support", "frequency")


def q_fim_sum_sparse(spark, sf):
    out = fim_runs.sum_arm(shaped_baskets(spark, sf, "p_name"), N_BLOCKS, SPARSE_SUPPORT, SPARSE_FLOOR)
    return _named(out, spark, sf, "p_name", "support", "frequency")


SKEWED_SUPPORT = 0.05
SUPPORTS = [0.02, 0.03, 0.05]


def q_fim_sum_skewed(spark, sf):
    """One tiny and one large block, each mined at its own count."""
    return _keyed(fim_runs.sum_arm(skewed_baskets(spark, sf), 2, SKEWED_SUPPORT, None), "support", "frequency")


def q_fim_exact_blocks(spark, sf):
    return _keyed(fim.exact_by_blocks(blocked_baskets(spark, sf), MIN_SUPPORT), "support", "frequency")


def q_fim_sweep_exact(spark, sf):
    return _keyed(fim_runs.sweep_exact(blocked_baskets(spark, sf), SWEEP, MIN_SUPPORT), "size", "support", "frequency")


def q_fim_sweep_vote(spark, sf):
    tx = B.materialise(baskets(spark, sf))
    return _keyed(fim_runs.sweep_vote(tx, SWEEP, MIN_SUPPORT, VOTE, SEED), "size", "support", "votes")


def q_fim_sweep_support(spark, sf):
    return _keyed(fim_runs.sweep_support(blocked_baskets(spark, sf), SUPPORTS), "min_support", "support", "frequency")


def q_fim_sweep_support_vote(spark, sf):
    """the vote arm at several min-supports."""
    return _keyed(fim_runs.sweep_support_vote(baskets(spark, sf), SUPPORTS, N_BLOCKS, VOTE, SEED), "min_support", "support", "votes")


def q_row_sample(spark, sf):
    """10 % row sample by the draw of the row."""
    return B.hash_sample(baskets(spark, sf), "tid", 0.1, SEED).select("tid")


def q_row_random_split(spark, sf):
    """Random split of exact size, 90/10."""
    return B.exact_split(baskets(spark, sf), "tid", SPLIT, SEED).select("tid", "role")


def q_row_all_train(spark, sf):
    """A negative fraction keeps every row for training."""
    return B.exact_split(baskets(spark, sf), "tid", -1.0, SEED).select("tid", "role")


def q_block_merge(spark, sf):
    """All blocks merged into one."""
    return B.assign_blocks(blocked_baskets(spark, sf).drop("block_id"), "tid", 1, SEED).select("tid", "block_id")


def q_fim_csv(spark, sf):
    """The exact itemsets through a single CSV file, every value read back."""
    path = _scratch(spark, "csv")
    write_itemsets_csv(fim.exact_itemsets(baskets(spark, sf), MIN_SUPPORT), path)
    return spark.read.schema("items STRING, support LONG, frequency DOUBLE").csv(path)


def q_fim_lines(spark, sf):
    """The exact itemsets through a single text file, every line read back."""
    path = _scratch(spark, "lines")
    write_text_lines(fim.exact_itemsets(baskets(spark, sf), MIN_SUPPORT), path)
    return spark.read.text(path)


def q_centers_by_name(spark, sf):
    """Centers stored under two names, one of them read by ``path:name``."""
    v = read_table(spark, sf, "lineitem").groupBy("l_linenumber").agg(F.avg("l_quantity").alias("q"))
    for_name = lambda name, shift: v.agg(F.lit(name).alias("name"), F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "q"))),
        lambda x: F.array(x["l_linenumber"].cast("double"), F.round(x["q"] + shift, 6).cast("double"))).alias("centers"))
    path = _scratch(spark, "centers")
    for_name("plain", 0).unionByName(for_name("shifted", 1)).write.parquet(path)
    return read_centers(spark, f"{path}:shifted").select("center_id", F.col("center")[0].alias("x"), F.col("center")[1].alias("y"))


def _scratch(spark, what: str) -> str:
    import uuid
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def q_fim_written(spark, sf):
    """S4 + S5 + P6: the sum arm written as Parquet (1-itemsets dropped) and
    a single-file CSV into the shared checkpoint folder, read back."""
    import uuid
    head = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fim-{uuid.uuid4().hex}"
    fim_runs.write_result(_sum(spark, sf), head, N_BLOCKS, "sum", csv_path=f"{head}.csv")
    back = spark.read.parquet(f"{head}_{N_BLOCKS}Block_sum.parquet")
    return _keyed(back, "support", "frequency")


QUERIES = {
    "baskets": q_baskets,
    "assign_blocks": q_assign_blocks,
    "block_inventory": q_block_inventory,
    "block_manifest": q_block_manifest,
    "blocks_listed": q_blocks_listed,
    "blocks_first_n": q_blocks_first_n,
    "blocks_by_ids": q_blocks_by_ids,
    "blocks_random_n": q_blocks_random_n,
    "block_train_test": q_block_train_test,
    "blocks_by_plan": q_blocks_by_plan,
    "blocks_fraction": q_blocks_fraction,
    "row_split": q_row_split,
    "block_holdout": q_block_holdout,
    "local_thresholds": q_local_thresholds,
    "fim_local": q_fim_local,
    "fim_sum": q_fim_sum,
    "fim_min_frequency": q_fim_min_frequency,
    "fim_drop_singletons": q_fim_drop_singletons,
    "fim_vote": q_fim_vote,
    "fim_text_lines": q_fim_text_lines,
    "fim_vote_sampled": q_fim_vote_sampled,
    "fim_candidates": q_fim_candidates,
    "fim_recount": q_fim_recount,
    "fim_exact": q_fim_exact,
    "itemset_key": q_itemset_key,
    "fim_sweep": q_fim_sweep,
    "scan_text_tx": q_scan_text_tx,
    "fim_vote_dense": q_fim_vote_dense,
    "fim_exact_dense": q_fim_exact_dense,
    "fim_exact_sparse": q_fim_exact_sparse,
    "fim_sum_sparse": q_fim_sum_sparse,
    "row_sample": q_row_sample,
    "row_random_split": q_row_random_split,
    "row_all_train": q_row_all_train,
    "block_merge": q_block_merge,
    "fim_csv": q_fim_csv,
    "fim_lines": q_fim_lines,
    "centers_by_name": q_centers_by_name,
    "fim_written": q_fim_written,
    "fim_sum_skewed": q_fim_sum_skewed,
    "fim_exact_blocks": q_fim_exact_blocks,
    "fim_sweep_exact": q_fim_sweep_exact,
    "fim_sweep_vote": q_fim_sweep_vote,
    "fim_sweep_support": q_fim_sweep_support,
    "fim_sweep_support_vote": q_fim_sweep_support_vote,
}


# ------------------------------------------------------------------ SQL twins
def _draw(expr: str) -> str:
    return f"('0x' || substr(md5('{SEED}:draw:' || CAST({expr} AS VARCHAR)), 1, 15))::BIGINT"


def _hash(seed, expr: str) -> str:
    return f"('0x' || substr(md5('{seed}:' || CAST({expr} AS VARCHAR)), 1, 8))::BIGINT"


def _baskets_sql(attribute: str = "p_brand") -> str:
    """CTEs bi, b0, tx: baskets of one part attribute, md5 blocks."""
    if attribute == "p_brand":
        head = ""
        pairs = """SELECT l_orderkey AS tid, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS item
       FROM lineitem JOIN part ON l_partkey = p_partkey"""
    else:
        head = f"""
names AS (SELECT CAST(row_number() OVER (ORDER BY name) AS INTEGER) AS item, name
          FROM (SELECT DISTINCT CAST({attribute} AS VARCHAR) AS name FROM part) WHERE name IS NOT NULL),"""
        pairs = f"""SELECT l_orderkey AS tid, n.item FROM lineitem JOIN part ON l_partkey = p_partkey
       LEFT JOIN names n ON n.name = CAST({attribute} AS VARCHAR)"""
    return head + f"""
bi AS ({pairs}),
b0 AS (SELECT tid, list_sort(list_distinct(list(item))) AS items FROM bi GROUP BY tid),
tx AS (SELECT tid, items, CAST({_hash(SEED, 'tid')} % {N_BLOCKS} AS INTEGER) AS block_id FROM b0)"""


BASKETS = _baskets_sql()

KEY = "'{' || array_to_string(items, ',') || '}'"


def _pick(k: int, n_total: int = N_BLOCKS, seed=PICK_SEED, offset: int = 0, name: str = "pick") -> str:
    return (f"{name} AS (SELECT range AS block_id FROM range({n_total}) "
            f"ORDER BY {_hash(seed, 'range')}, range LIMIT {k} OFFSET {offset})")


def _local(src: str, p: str, threshold: str, n_blocks: int | None = None,
           min_support: float = MIN_SUPPORT) -> str:
    """CTEs {p}e, {p}th, {p}loc: every frequent itemset per block of ``src``.

    Brute force (oracle only): each basket's subsets over the block's
    frequent single items, enumerated by a recursive CTE, then counted.
    """
    if threshold == "own":
        thr = f"greatest(CAST(floor({min_support}::DOUBLE * count(*)) AS BIGINT), 1)"
    else:
        thr = (f"greatest((SELECT CAST(floor(count(*) * {min_support}::DOUBLE / {n_blocks}) AS BIGINT)"
               f" FROM {src}), 1)")
    return f"""
{p}e AS (SELECT tid, block_id, unnest(items) AS item FROM {src}),
{p}th AS (SELECT block_id, count(*) AS n_rows, {thr} AS threshold FROM {src} GROUP BY block_id),
{p}f1 AS (SELECT e.block_id, e.item FROM {p}e e JOIN {p}th t USING (block_id)
          GROUP BY e.block_id, e.item, t.threshold HAVING count(*) >= t.threshold),
{p}fe AS (SELECT e.tid, e.block_id, e.item FROM {p}e e JOIN {p}f1 f USING (block_id, item)),
{p}sub(tid, block_id, items, last) AS (
  SELECT tid, block_id, [item], item FROM {p}fe
  UNION ALL
  SELECT s.tid, s.block_id, list_append(s.items, e.item), e.item
  FROM {p}sub s JOIN {p}fe e ON e.tid = s.tid AND e.item > s.last),
{p}c AS (SELECT block_id, items, count(*) AS support FROM {p}sub GROUP BY block_id, items),
{p}loc AS (SELECT c.block_id, c.items, c.support FROM {p}c c JOIN {p}th t USING (block_id)
           WHERE c.support >= t.threshold)"""


def _vote_sql(src: str, n_blocks: int, min_support: float = MIN_SUPPORT) -> str:
    return _local(src, "v", "average", n_blocks, min_support) + f""",
vote AS (SELECT items, CAST(sum(support) // count(*) AS BIGINT) AS support, count(*) AS votes
         FROM vloc WHERE len(items) >= 2 GROUP BY items
         HAVING CAST(count(*) AS DOUBLE) >= {float(n_blocks) * VOTE})"""


def _sum_sql(src: str, floor: float, p: str = "s", min_support: float = MIN_SUPPORT) -> str:
    return _local(src, p, "own", min_support=min_support) + f""",
{p}sum AS (SELECT items, CAST(sum(support) AS BIGINT) AS support,
              CAST(sum(support) AS DOUBLE) / (SELECT count(*) FROM {src}) AS frequency
       FROM {p}loc GROUP BY items)"""


def _exact_sql(src: str, min_support: float = MIN_SUPPORT, p: str = "") -> str:
    """CTEs {p}xe, {p}xc, {p}xn, {p}exact: every itemset with support >=
    ceil(s * N) (brute force over basket subsets of frequent items; oracle only)."""
    return f"""
{p}xn AS (SELECT count(*) AS n FROM {src}),
{p}xe AS (SELECT tid, unnest(items) AS item FROM {src}),
{p}xf1 AS (SELECT item FROM {p}xe, {p}xn GROUP BY item, n
           HAVING count(*) >= CAST(ceil({min_support}::DOUBLE * n) AS BIGINT)),
{p}xfe AS (SELECT e.tid, e.item FROM {p}xe e JOIN {p}xf1 f USING (item)),
{p}xsub(tid, items, last) AS (
  SELECT tid, [item], item FROM {p}xfe
  UNION ALL
  SELECT s.tid, list_append(s.items, e.item), e.item
  FROM {p}xsub s JOIN {p}xfe e ON e.tid = s.tid AND e.item > s.last),
{p}xc AS (SELECT items, count(*) AS support FROM {p}xsub GROUP BY items),
{p}exact AS (SELECT items, support, CAST(support AS DOUBLE) / n AS frequency FROM {p}xc, {p}xn
          WHERE support >= CAST(ceil({min_support}::DOUBLE * n) AS BIGINT))"""


def _sweep_sql() -> str:
    parts, ctes = [], []
    for s in SWEEP:
        ctes.append(f"tx{s} AS (SELECT * FROM tx WHERE block_id < {s})")
        ctes.append(_sum_sql(f"tx{s}", FLOOR, p=f"s{s}").lstrip())
        parts.append(f"SELECT {KEY} AS itemset, {s} AS size, support, frequency FROM s{s}sum "
                     f"WHERE frequency >= {FLOOR}::DOUBLE")
    return "WITH RECURSIVE " + BASKETS.strip() + ",\n" + ",\n".join(ctes) + "\n" + "\nUNION ALL\n".join(parts)


def _plan_sql() -> str:
    rows = ", ".join(f"({s}, {list(ids)})" for s, ids in PLAN)
    sizes = ", ".join(f"({s})" for s in PLAN_SIZES)
    return f"""WITH {BASKETS.strip()},
plan(size, block_ids) AS (VALUES {rows}),
wanted(size) AS (VALUES {sizes}),
chosen AS (SELECT DISTINCT w.size, unnest(coalesce(p.block_ids, range(0, w.size))) AS block_id
           FROM wanted w LEFT JOIN plan p USING (size))
SELECT c.size, t.tid, t.block_id FROM tx t JOIN chosen c USING (block_id)"""


def _w(body: str) -> str:
    return "WITH RECURSIVE " + BASKETS.strip() + "," + body


SQL = {
    "baskets": f"WITH {BASKETS.strip()} SELECT tid, array_to_string(items, ' ') AS items_text, "
               f"CAST(len(items) AS INTEGER) AS n_items FROM tx",
    "assign_blocks": f"WITH {BASKETS.strip()} SELECT tid, block_id FROM tx",
    "block_inventory": f"WITH {BASKETS.strip()} SELECT block_id, count(*) AS n_rows FROM tx GROUP BY block_id",
    "block_manifest": f"WITH {BASKETS.strip()} SELECT block_id, count(*) AS n_rows FROM tx GROUP BY block_id",
    "blocks_listed": _w(f"\n{_pick(RANDOM_K)}\nSELECT tid, block_id FROM tx WHERE block_id IN "
                        f"(SELECT block_id FROM pick)"),
    "blocks_first_n": f"WITH {BASKETS.strip()} SELECT tid, block_id FROM tx WHERE block_id < {FIRST_N}",
    "blocks_by_ids": f"WITH {BASKETS.strip()} SELECT tid, block_id FROM tx WHERE block_id IN "
                     f"({', '.join(map(str, IDS))})",
    "blocks_random_n": _w(f"\n{_pick(RANDOM_K)}\nSELECT tid, block_id FROM tx WHERE block_id IN "
                          f"(SELECT block_id FROM pick)"),
    "block_train_test": _w(f"\n{_pick(N_TRAIN, name='tr')},\n{_pick(N_TEST, offset=N_TRAIN, name='te')}\n"
                           "SELECT tid, block_id, CASE WHEN block_id IN (SELECT block_id FROM tr) "
                           "THEN 'train' ELSE 'test' END AS role FROM tx WHERE block_id IN "
                           "(SELECT block_id FROM tr UNION ALL SELECT block_id FROM te)"),
    "blocks_by_plan": _plan_sql(),
    "blocks_fraction": _w(f"\n{_pick(K_FRACTION)}\n"
                          "SELECT tid, block_id FROM tx WHERE block_id IN (SELECT block_id FROM pick)"),
    "row_split": f"WITH {BASKETS.strip()} SELECT tid, CASE WHEN {_hash(f'{SEED}:split', 'tid')} % 10000 < "
                 f"{int(round(SPLIT * 10000))} THEN 'train' ELSE 'test' END AS role FROM tx",
    "row_sample": f"WITH {BASKETS.strip()} SELECT tid FROM tx WHERE {_draw('tid')} < {int(0.1 * 2**60)}",
    "row_random_split": f"""WITH {BASKETS.strip()},
r AS (SELECT tid, row_number() OVER (ORDER BY {_draw('tid')}) AS pos, count(*) OVER () AS n FROM tx)
SELECT tid, CASE WHEN pos <= CAST(floor({SPLIT}::DOUBLE * n) AS BIGINT) THEN 'train' ELSE 'test' END AS role FROM r""",
    "row_all_train": f"WITH {BASKETS.strip()} SELECT tid, 'train' AS role FROM tx",
    "block_merge": f"WITH {BASKETS.strip()} SELECT tid, 0 AS block_id FROM tx",
    "centers_by_name": """SELECT CAST(row_number() OVER (ORDER BY l_linenumber) - 1 AS INTEGER) AS center_id,
CAST(l_linenumber AS DOUBLE) AS x, CAST(round(avg(l_quantity) + 1, 6) AS DOUBLE) AS y FROM lineitem GROUP BY l_linenumber""",
    "block_holdout": _w(f"""
r AS (SELECT tid, block_id, row_number() OVER (PARTITION BY block_id ORDER BY tid) AS pos,
             count(*) OVER (PARTITION BY block_id) AS n FROM tx)
SELECT tid, block_id, CASE WHEN pos <= CAST(floor({SPLIT}::DOUBLE * n) AS BIGINT) THEN 'train'
       ELSE 'validate' END AS role FROM r"""),
    "local_thresholds": _w(f"""
inv AS (SELECT block_id, count(*) AS n_rows FROM tx GROUP BY block_id)
SELECT block_id, n_rows,
       greatest(CAST(floor({MIN_SUPPORT}::DOUBLE * n_rows) AS BIGINT), 1) AS threshold_own,
       greatest((SELECT CAST(floor(count(*) * {MIN_SUPPORT}::DOUBLE / {N_BLOCKS}) AS BIGINT) FROM tx), 1)
         AS threshold_average
FROM inv"""),
    "fim_local": _w(_local("tx", "o", "own") + f"\nSELECT {KEY} AS itemset, block_id, support FROM oloc"),
    "fim_sum": _w(_sum_sql("tx", FLOOR) + f"\nSELECT {KEY} AS itemset, support, frequency FROM ssum "
                  f"WHERE frequency >= {FLOOR}::DOUBLE"),
    "fim_min_frequency": _w(_sum_sql("tx", 0.03) + f"\nSELECT {KEY} AS itemset, support, frequency FROM ssum "
                            f"WHERE frequency >= 0.03::DOUBLE"),
    "fim_drop_singletons": _w(_sum_sql("tx", FLOOR) + f"\nSELECT {KEY} AS itemset, support, frequency FROM ssum "
                              f"WHERE frequency >= {FLOOR}::DOUBLE AND len(items) >= 2"),
    "fim_vote": _w(_vote_sql("tx", N_BLOCKS) + f"\nSELECT {KEY} AS itemset, support, votes FROM vote"),
    "fim_text_lines": _w(_vote_sql("tx", N_BLOCKS) + f"\nSELECT {KEY} || ': ' || CAST(support AS VARCHAR) "
                         "AS value FROM vote"),
    "fim_vote_sampled": _w(
        f"\n{_pick(K_FRACTION)},\n"
        "stx AS (SELECT * FROM tx WHERE block_id IN (SELECT block_id FROM pick)),"
        + _vote_sql("stx", K_FRACTION)
        + f"\nSELECT {KEY} || ': ' || CAST(support AS VARCHAR) AS value FROM vote"),
    "fim_candidates": _w(_local("tx", "v", "average", N_BLOCKS)
                         + f"\nSELECT DISTINCT {KEY} AS itemset FROM vloc WHERE len(items) >= 2"),
    "fim_recount": _w(
        f"\n{_pick(RECOUNT_BLOCKS)},\n"
        "stx AS (SELECT * FROM tx WHERE block_id IN (SELECT block_id FROM pick)),"
        + _local("stx", "v", "average", RECOUNT_BLOCKS) + ",\n" + _exact_sql("stx").strip() + f"""
SELECT {KEY} AS itemset, x.support, CAST(x.support AS DOUBLE) / xn.n AS frequency
FROM (SELECT DISTINCT items FROM vloc WHERE len(items) >= 2) c JOIN xc x USING (items), xn
WHERE CAST(x.support AS DOUBLE) / xn.n >= {MIN_SUPPORT}::DOUBLE"""),
    "fim_exact": _w(_exact_sql("tx") + f"\nSELECT {KEY} AS itemset, support, frequency FROM exact"),
    "itemset_key": _w(_exact_sql("tx") + f"\nSELECT {KEY} AS itemset, CAST(support AS INTEGER) AS support "
                      "FROM exact WHERE len(items) >= 2"),
    "fim_sweep": _sweep_sql(),
    "scan_text_tx": f"WITH {BASKETS.strip()} SELECT array_to_string(items, ' ') AS items_text, "
                    f"CAST(len(items) AS INTEGER) AS n_items FROM tx",
}


def _shape_sql(attribute: str, body: str) -> str:
    return "WITH RECURSIVE " + _baskets_sql(attribute).strip() + "," + body


NAMED = "array_to_string(list_select((SELECT list(name ORDER BY name) FROM names), items), '|')"


def _union(parts: list[tuple[str, str]]) -> str:
    """(CTEs, select) per value, unioned."""
    return _w(",\n".join(c for c, _ in parts) + "\n" + "\nUNION ALL\n".join(q for _, q in parts))


SQL.update({
    "fim_vote_dense": _shape_sql("p_type", _vote_sql("tx", N_BLOCKS, DENSE_SUPPORT)
                                 + f"\nSELECT {NAMED} AS itemset, support, votes FROM vote"),
    "fim_exact_dense": _shape_sql("p_type", _exact_sql("tx", DENSE_SUPPORT)
                                  + f"\nSELECT {NAMED} AS itemset, support, frequency FROM exact"),
    "fim_exact_sparse": _shape_sql("p_name", _exact_sql("tx", SPARSE_SUPPORT)
                                   + f"\nSELECT {NAMED} AS itemset, support, frequency FROM exact"),
    "fim_sum_sparse": _shape_sql("p_name", _sum_sql("tx", SPARSE_FLOOR, min_support=SPARSE_SUPPORT)
                                 + f"\nSELECT {NAMED} AS itemset, support, frequency FROM ssum "
                                   f"WHERE frequency >= {SPARSE_FLOOR}::DOUBLE"),
    "fim_sum_skewed": _w(f"\nkx AS (SELECT tid, items, CAST({_hash(SEED, 'tid')} % 101 > 0 AS INTEGER) AS block_id FROM b0),"
                         + _sum_sql("kx", 0, min_support=SKEWED_SUPPORT)
                         + f"\nSELECT {KEY} AS itemset, support, frequency FROM ssum"),
    "fim_sweep_exact": _union([
        (f"\ntx{n} AS (SELECT * FROM tx WHERE block_id < {n})," + _exact_sql(f"tx{n}", p=f"e{n}"),
         f"SELECT {KEY} AS itemset, {n} AS size, support, frequency FROM e{n}exact") for n in SWEEP]),
    "fim_sweep_vote": _union([
        (f"\ntv{n} AS (SELECT tid, items, CAST({_hash(SEED, 'tid')} % {n} AS INTEGER) AS block_id FROM b0),"
         + _local(f"tv{n}", f"v{n}", "average", n),
         f"SELECT {KEY} AS itemset, {n} AS size, CAST(sum(support) // count(*) AS BIGINT) AS support, count(*) AS votes "
         f"FROM v{n}loc WHERE len(items) >= 2 GROUP BY items HAVING count(*) >= {n * VOTE}") for n in SWEEP]),
    "fim_sweep_support_vote": _union([
        (_local("tx", f"p{i}", "average", N_BLOCKS, s),
         f"SELECT {KEY} AS itemset, {s}::DOUBLE AS min_support, CAST(sum(support) // count(*) AS BIGINT) AS support, count(*) AS votes "
         f"FROM p{i}loc WHERE len(items) >= 2 GROUP BY items HAVING count(*) >= {N_BLOCKS * VOTE}") for i, s in enumerate(SUPPORTS)]),
    "fim_sweep_support": _w(_exact_sql("tx", min(SUPPORTS))
                            + f"\nSELECT {KEY} AS itemset, s AS min_support, support, frequency FROM exact, xn, "
                              f"(SELECT unnest({SUPPORTS}::DOUBLE[]) AS s) WHERE support >= ceil(s * n)"),
})

SQL["fim_exact_blocks"] = SQL["fim_exact"]
SQL["fim_written"] = SQL["fim_drop_singletons"]
SQL["fim_csv"] = f"SELECT '[' || replace(trim(itemset, '{{}}'), ',', ', ') || ']' AS items, support, frequency FROM ({SQL['fim_exact']})"
SQL["fim_lines"] = f"SELECT itemset || ': ' || support AS value FROM ({SQL['fim_exact']})"
