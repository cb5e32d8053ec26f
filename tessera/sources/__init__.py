"""Scans and sinks."""

from tessera.sources.tables import (  # noqa: F401
    basket_items,
    baskets,
    item_dictionary,
    labelled_vectors,
    read_blocked,
    read_blocked_text,
    write_blocked_text,
    read_centers,
    read_table,
    read_text_transactions,
    text_lines_to_transactions,
    true_centers,
)
from tessera.sources.manifest import (  # noqa: F401
    manifest_changes,
    read_blocks,
    read_manifest,
    stored_inventory,
    write_manifest,
)
from tessera.sources.sinks import (  # noqa: F401
    save_model,
    write_itemsets_csv,
    write_parquet,
    write_text_lines,
)
