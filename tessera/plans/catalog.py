"""All registered queries and their SQL twins."""

from tessera.plans import catalog_fim, catalog_fit, catalog_ml

QUERIES = {**catalog_fim.QUERIES, **catalog_ml.QUERIES, **catalog_fit.QUERIES}
SQL = {**catalog_fim.SQL, **catalog_ml.SQL, **catalog_fit.SQL}
