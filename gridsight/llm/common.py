"""Shared pieces of the corpus operators: text columns, stored tables, and files in the shared folder."""
import ctypes
import re
import sys
import types
import uuid

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import functions as F

from ..operators.common import col
from ..session import ensure_checkpoint_dir

SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_of(name):
    """A text column with null read as the empty text."""
    return F.coalesce(col(name).cast("string"), F.lit(""))


def ascii_lower(value):
    """Lower-case A-Z only, as every task and database does it alike."""
    return F.translate(value, UPPER, LOWER)


def shared_folder(spark, name):
    """A fresh folder (URI) below the cluster's shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = spark.sparkContext.getCheckpointDir()
    base = re.sub(r"^file:/+|^(?=/)", "file:///", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df, name):
    """Write a table to the shared folder; returns the folder."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return folder


def stored(df, name):
    """Write a table to the shared folder and read it back: computed once, safe against lost executors."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df, name))


def join_counted(left, right, key, count, short=None, share=1000):
    """``left`` with the columns of ``right`` (one row per key, ``count``: its rows in ``left``), null for keys it lacks.

    Keys with more than one in ``share`` of all rows of ``left`` are at most ``share``; those whose row is ``short`` are broadcast and move no row.
    All others are joined by a shuffle. Both sides should be stored tables, as they are read twice.
    """
    hot, short = left.count() // share, F.lit(True) if short is None else short
    often, rest = right.filter((F.col(count) > hot) & short), right.filter((F.col(count) <= hot) | ~short)
    marked = left.join(F.broadcast(often), key, "left")
    return marked.filter(F.col(count).isNotNull()).unionByName(marked.filter(F.col(count).isNull()).select(*left.columns).join(rest, key, "left"))


def in_batches(df, rows=1000):
    """The frame, its session set to Arrow batches of at most ``rows`` rows unless the user chose a size: rows are whole
    documents here, and 10,000 of them (the default) would fill much of a Python worker's memory."""
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if conf.get(name) == "10000":
        conf.set(name, str(rows))
    return df


def write_file(folder, prefix):
    """Open a file of a name no other attempt uses; the caller reports its path, and only reported files count."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    name = f"{prefix}-{uuid.uuid4().hex}"
    return store.open_output_stream(f"{path}/{name}", compression=None), f"{folder}/{name}"


def read_file(path):
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_file(inner)


def byte_texts(column):
    """The UTF-8 bytes of each text of an Arrow column, one at a time; null reads as empty."""
    for value in column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()):
        yield value.as_py() or b""


def tidy(run, keeps=()):
    """A task's generator that first drops what other operators keep in its worker process (all but the kinds in ``keeps``,
    see ``kept_by_process``) and at its end gives freed memory back to the system: worker processes outlive tasks, and what
    one stage holds or has freed would otherwise count against the next."""
    def tidied(batches):
        for kind, shelf in getattr(sys.modules.get("_gridsight_kept"), "__dict__", {}).items():
            if isinstance(shelf, dict) and not kind.startswith("__") and kind not in keeps:
                shelf.clear()
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
            if trim:
                trim(0)

    return tidied


def kept_by_process(name, make, most=2):
    """A value that a worker process makes once and keeps for later tasks, at most ``most`` per kind; ``name`` is (kind, ...).

    It hangs on a module of its own and not on this package, which executors need not have installed.
    """
    shelf = sys.modules.setdefault("_gridsight_kept", types.ModuleType("_gridsight_kept")).__dict__.setdefault(name[0], {})
    if name not in shelf:
        while len(shelf) >= most:
            shelf.pop(next(iter(shelf)))
        shelf[name] = make()
    return shelf[name]


class Memory:
    """A bounded memo in two generations: when the young one is full it becomes the old one, and what is used again moves on."""

    def __init__(self, most):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        value = self.young.get(key)
        if value is None:
            value = self.old.get(key)
            if value is not None:
                self.put(key, value)
        return value

    def put(self, key, value):
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        self.young[key] = value

    def known(self, keys):
        """{key: value or None}; what the old generation knows moves on."""
        out = dict(zip(keys, map(self.young.get, keys)))
        again = {k: value for k in [k for k, v in out.items() if v is None] if (value := self.old.get(k)) is not None}
        self.put_all(again)
        out.update(again)
        return out

    def put_all(self, found, longest=64):
        """Remember many at once, but for long keys; a generation may exceed its size by one such call."""
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        self.young.update({k: v for k, v in found.items() if len(k) < longest})
