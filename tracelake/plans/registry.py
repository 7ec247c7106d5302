"""Registration of queries and their SQL twins."""

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function ``(spark, sf_dir) -> DataFrame`` under its name, with its SQL twin if it has one."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register
