"""Registered queries: each runs one operator on the supplied tables, with its SQL where SQL can say it."""
import importlib

QUERIES = {}
SQL = {}

SECTIONS = (
    "profiles", "roles", "quality", "sources", "relational", "dates", "text", "ordered", "cleaning",
    "statistics", "charts", "insights", "recommendations", "series", "learning", "streaming", "analysis",
)


def table(spark, folder, name):
    return spark.read.parquet(f"{folder}/{name}.parquet")


def query(sql=None):
    """Register a query function under its own name."""
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn
    return register


def load():
    for section in SECTIONS:
        try:
            importlib.import_module(f"{__name__}.{section}")
        except ModuleNotFoundError as e:
            if e.name != f"{__name__}.{section}":
                raise
    return QUERIES, SQL
