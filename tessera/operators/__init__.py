"""DataFrame -> DataFrame operators: blocks, itemsets, ensemble, clustering."""
