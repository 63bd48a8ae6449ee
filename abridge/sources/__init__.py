from abridge.sources.tables import read_table, TABLE_SCHEMAS  # noqa: F401
