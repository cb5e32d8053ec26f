"""Column expressions shared by the operators (all JVM-side, no Python UDFs)."""

from tessera.functions.exprs import (  # noqa: F401
    block_hash,
    hash_rank_key,
    itemset_key,
    itemset_text,
    parse_int_line,
    plurality,
    sq_distance,
    tag_items,
    tagged_block,
    untag_items,
)
