"""Every query of the engine by name, and DuckDB SQL for the same rows."""

from . import desk, feeds, folds, market, records, storage

QUERIES = {**market.QUERIES, **records.QUERIES, **desk.QUERIES, **feeds.QUERIES, **storage.QUERIES}
ORACLE = {**market.ORACLE, **records.ORACLE, **folds.ORACLE, **desk.ORACLE, **feeds.ORACLE, **storage.ORACLE}
