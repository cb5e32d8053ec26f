"""tessera: block-sampled approximate analytics on PySpark.

A table is cut into seeded random-sample blocks (an explicit ``block_id``
column); itemsets, classifiers and clusters are learned per block by
distributed Spark jobs and merged (vote, sum, exact recount, ensemble vote,
second-level clustering), next to the exact whole-table answer.
"""

__version__ = "0.1.0"
