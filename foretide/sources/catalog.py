"""Tables with their keys and event times, and readers and writers by suffix."""
from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableDef:
    name: str
    primary_key: str | None = None
    foreign_keys: dict[str, str] = field(default_factory=dict)  # column -> table
    event_time: str | None = None


#: The test tables' keys.
STAR = {t.name: t for t in (
    TableDef("region", "r_regionkey"), TableDef("nation", "n_nationkey", {"n_regionkey": "region"}), TableDef("customer", "c_custkey", {"c_nationkey": "nation"}),
    TableDef("supplier", "s_suppkey", {"s_nationkey": "nation"}), TableDef("part", "p_partkey"), TableDef("orders", "o_orderkey", {"o_custkey": "customer"}, "o_orderdate"),
    TableDef("lineitem", None, {"l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier"}, "l_shipdate"), TableDef("events", "event_id", {"user_id": "customer"}, "ts"),
)}


def read(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """By suffix: .parquet, .pq or .csv.  Only the columns asked for are scanned."""
    if path.endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
    elif path.endswith(".csv"):
        df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    else:
        raise ValueError(f"unsupported_table_format: {path}")
    return df.select(*columns) if columns else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read(spark, f"{sf_dir}/{name}.parquet")


def schema_of(spark: SparkSession, path: str) -> list[str]:
    return spark.read.parquet(path).schema.names


def schema_fingerprint(schema: T.StructType) -> str:
    return hashlib.sha256(";".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema).encode()).hexdigest()


def row_fingerprint(columns: list[str]):
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def pre_split(train: DataFrame, validation: DataFrame) -> tuple[DataFrame, DataFrame]:
    """An official split: raises on an empty side, other columns, or a row in both."""
    if train.schema.names != validation.schema.names:
        raise ValueError("split_schema_mismatch")
    if not train.take(1) or not validation.take(1):
        raise ValueError("empty_split")
    if train.intersect(validation).take(1):
        raise ValueError("split_overlap")
    return train, validation


def publish(df: DataFrame, path: str) -> None:
    """Writes beside the target, under a name of this call alone, and renames, so that readers see all or
    nothing.  An existing target raises before anything is written; of two writers the later one raises."""
    spark = df.sparkSession
    p = spark._jvm.org.apache.hadoop.fs.Path
    fs = p(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(p(path)):
        raise FileExistsError(path)
    staging = f"{path}.staging-{uuid.uuid4().hex}"
    try:
        df.write.parquet(staging)
        if fs.exists(p(path)) or not fs.rename(p(staging), p(path)):
            raise FileExistsError(path)
    finally:
        fs.delete(p(staging), True)
