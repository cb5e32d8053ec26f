"""Scalar and higher-order column expressions.

Everything here builds a ``Column`` from built-in Spark SQL functions and runs
in the JVM; lambdas over array elements are interpreted, the rest is generated
code.  The hash rules are chosen so that the same
value can be written in plain SQL (DuckDB) for the oracle checks.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Items are block-tagged as  block_id * 2^32 + (item + 2^31)  so that one
# FP-growth run over all blocks can never join items of two blocks.
BLOCK_SHIFT = 2 ** 32
ITEM_OFFSET = 2 ** 31


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def hash_rank_key(seed, key) -> Column:
    """First 32 bits of ``md5('<seed>:<key>')`` as a non-negative BIGINT.

    SQL twin: ``('0x' || substr(md5('<seed>:' || key), 1, 8))::BIGINT``.
    """
    text = F.concat(F.lit(f"{seed}:"), _c(key).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def block_hash(key, n_blocks: int, seed) -> Column:
    """Random-sample block of a row: ``hash_rank_key(seed, key) mod n``."""
    if n_blocks < 1:
        raise ValueError("n_blocks must be >= 1")
    return F.pmod(hash_rank_key(seed, key), F.lit(int(n_blocks))).cast("int")


def itemset_key(items) -> Column:
    """Canonical ``{a,b}`` key of an (int-sorted) itemset."""
    return F.concat(F.lit("{"), F.array_join(F.array_sort(_c(items)), ","), F.lit("}"))


def itemset_text(items) -> Column:
    """Row -> text line: items joined by one space."""
    return F.array_join(_c(items), " ")


def parse_int_line(line) -> Column:
    """Text line of space-separated ints -> ``array<int>`` (distinct, sorted)."""
    parts = F.filter(F.split(F.trim(_c(line)), " "), lambda s: s != F.lit(""))
    return F.array_sort(F.array_distinct(F.transform(parts, lambda s: s.cast("int"))))


def tag_items(items, block_id) -> Column:
    b = _c(block_id).cast("long") * F.lit(BLOCK_SHIFT)
    return F.transform(_c(items), lambda x: b + (x.cast("long") + F.lit(ITEM_OFFSET)))


def untag_items(tagged) -> Column:
    return F.array_sort(F.transform(
        _c(tagged), lambda t: (F.pmod(t, F.lit(BLOCK_SHIFT)) - F.lit(ITEM_OFFSET)).cast("int")))


def tagged_block(tagged) -> Column:
    # exact integer shift (a double division would round for large block ids)
    return F.shiftright(F.element_at(_c(tagged), 1), 32).cast("int")


def plurality(labels) -> Column:
    """Most frequent value of an int array; a tie goes to the smallest value."""
    arr = _c(labels)
    scored = F.transform(
        F.array_distinct(arr),
        lambda v: F.struct(F.size(F.filter(arr, lambda x: x == v)).alias("n"), (-v).alias("neg")))
    return (-F.array_max(scored)["neg"]).cast("int")


def sq_distance(a, b) -> Column:
    """Squared Euclidean distance of two equally long double arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y)),
                       F.lit(0.0).cast("double"), lambda acc, v: acc + v)
