"""Readers, writers and table descriptions."""
import re
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.common import col, distinct_table, metric_table
from ..session import ensure_checkpoint_dir

DELIMITERS = [",", ";", "\t", "|"]


def scratch_folder(spark):
    """A new folder beside the shared checkpoints."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def guess_delimiter(lines):
    """The delimiter whose most common column count over all lines (a table with ``value``) is largest; ties go to the earlier one."""
    bare = F.regexp_replace("value", r'"[^"]*"', "")
    widths = [F.struct(F.lit(i).alias("i"), (F.length(bare) - F.length(F.translate(bare, d, "")) + 1).alias("width")) for i, d in enumerate(DELIMITERS)]
    counts = lines.select(F.explode(F.array(*widths)).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    common = counts.groupBy("w.i").agg(F.max(F.struct("n", "w.width")).alias("m"))
    best = common.filter("m.width > 1").orderBy(F.desc("m.width"), "i").first()
    return DELIMITERS[best["i"]] if best else DELIMITERS[0]


def guess_encoding(spark, path):
    """UTF-8 unless some line does not decode; then Latin-1, which accepts every byte."""
    broken = spark.read.text(path).filter(~F.is_valid_utf8("value"))
    return "UTF-8" if broken.isEmpty() else "ISO-8859-1"


def read_csv(spark, path, sep=None, encoding=None, schema=None):
    """Delimited text with a header; malformed lines are skipped. Pass ``schema`` to save the inference pass."""
    encoding = encoding or guess_encoding(spark, path)
    if sep is None:
        sep = guess_delimiter(spark.read.text(path))
    reader = spark.read.options(header=True, sep=sep, encoding=encoding, mode="DROPMALFORMED")
    return (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)


def read_json(spark, path, multiline=None, schema=None):
    """JSON lines, or one array document (recognised by its first character)."""
    if multiline is None:
        first = spark.read.text(path).filter(F.trim("value") != "").head()
        multiline = first is not None and first["value"].lstrip().startswith("[")
    reader = spark.read.option("multiLine", multiline)
    return (reader.schema(schema) if schema else reader).json(path)


def read_parquet(spark, path):
    return spark.read.parquet(path)


def parse_documents(df, c, kind="json"):
    """Expand a column of JSON or CSV strings into typed columns; the schema is inferred over all rows."""
    if kind == "json":
        found = df.agg(F.schema_of_variant_agg(F.try_parse_json(col(c)))).first()[0]
        ddl = found.replace("OBJECT<", "STRUCT<")
        return df.withColumn("_doc", F.from_json(col(c), ddl)).select("*", "_doc.*").drop("_doc")
    parts = F.split(col(c), ",")
    width = df.agg(F.max(F.size(parts))).first()[0] or 0
    field = lambda i: F.trim(F.get(parts, F.lit(i)))
    numeric = df.agg(*[F.coalesce(F.bool_and(field(i).try_cast("double").isNotNull()), F.lit(False)).alias(f"n{i}") for i in range(width)]).first()
    ddl = ", ".join(f"_c{i} {'DOUBLE' if numeric[i] else 'STRING'}" for i in range(width))
    return df.withColumn("_doc", F.from_csv(col(c), ddl, {"ignoreLeadingWhiteSpace": "true"})).select("*", "_doc.*").drop("_doc")


def describe_table(df):
    """Column, type, position, whether it holds nulls, row count, and whether its values are unique."""
    types = dict(df.dtypes)
    at = {c: i for i, c in enumerate(df.columns)}
    t = metric_table(df, df.columns, {
        "position": lambda c: F.any_value(F.lit(at[c])), "type": lambda c: F.any_value(F.lit(types[c])),
        "rows": lambda c: F.count(F.lit(1)), "non_null": lambda c: F.count(col(c))}).join(distinct_table(df, df.columns), "column")
    full = F.col("non_null") == F.col("rows")
    return t.select("column", "position", "type", (~full).alias("has_nulls"), "rows", (full & (F.col("distinct_values") == F.col("rows"))).alias("candidate_key"))


def table_sample(df, key, n=5):
    """The first n rows by key: a stable preview."""
    return df.orderBy(*([key] if isinstance(key, str) else key)).limit(n)


def append(df, path):
    """Add rows to a Parquet table."""
    df.write.mode("append").parquet(path)


def drop_null_fields(rows):
    """Records without their null entries, ready for ``createDataFrame``."""
    return [{k: v for k, v in r.items() if v is not None} for r in rows]


def write_jsonl(df, path, split):
    """JSON lines in one folder per value of the ``split`` column; null fields are left out."""
    df.write.mode("overwrite").partitionBy(split).json(path)


def save_report(parts, path, dataset_id):
    """Write each named table of a report, replacing this dataset's rows and no others."""
    for name, df in parts.items():
        (df.withColumn("dataset_id", F.lit(dataset_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("dataset_id").parquet(f"{path}/{name}"))


def _snake(name):
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def _camel(name):
    return re.sub(r"_([a-z0-9])", lambda m: m.group(1).upper(), name)


def rename_keys(df, style="snake"):
    """Rename columns and nested struct fields between snake_case and camelCase."""
    change = _snake if style == "snake" else _camel

    def renamed(kind):
        if isinstance(kind, T.StructType):
            return T.StructType([T.StructField(change(f.name), renamed(f.dataType), f.nullable) for f in kind])
        if isinstance(kind, T.ArrayType):
            return T.ArrayType(renamed(kind.elementType), kind.containsNull)
        if isinstance(kind, T.MapType):
            return T.MapType(kind.keyType, renamed(kind.valueType), kind.valueContainsNull)
        return kind

    return df.select(*[col(f.name).cast(renamed(f.dataType)).alias(change(f.name)) for f in df.schema])
