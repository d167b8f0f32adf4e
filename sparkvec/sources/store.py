"""Saving collections, and the ground-truth file."""

from __future__ import annotations

import io
import json
import re
import tempfile
import uuid
from dataclasses import asdict

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.operators.dataset import VectorDataset
from sparkvec.operators.encoded import ENCODERS, EncodedDataset
from sparkvec.schema import Codec, Layout, Meta, Metric


def shared_folder(spark: SparkSession) -> str:
    """A new folder that all executors share, in spark.checkpoint.dir; a temporary one only where that is unset and everything runs in one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{where}/sparkvec-{uuid.uuid4().hex}")
        system = path.getFileSystem(spark._jsc.hadoopConfiguration())
        system.mkdirs(path)
        system.deleteOnExit(path)
        return re.sub(r"^file:/+", "file:///", system.makeQualified(path).toString())
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"file://{tempfile.mkdtemp(prefix='sparkvec-')}"


def save(data: VectorDataset | EncodedDataset, path: str, mode: str = "errorifexists") -> None:
    """Parquet beside a one-row table of what it is, and one of its encoder's arrays, if it has one."""
    data.df.write.mode(mode).parquet(f"{path}/rows")
    spark = data.df.sparkSession
    about = asdict(data.meta)
    if isinstance(data, EncodedDataset):
        about["encoder"] = {"kind": data.kind}
        arrays = io.BytesIO()
        np.savez(arrays, **data.encoder.state())
        spark.createDataFrame([(bytearray(arrays.getvalue()),)], "arrays binary").coalesce(1).write.mode(mode).parquet(f"{path}/encoder")
    spark.createDataFrame([(json.dumps(about),)], "meta string").coalesce(1).write.mode(mode).json(f"{path}/meta")


def load(spark: SparkSession, path: str) -> VectorDataset | EncodedDataset:
    """What save() wrote; a damaged or missing file raises."""
    rows = spark.read.json(f"{path}/meta", schema="meta string").collect()
    if len(rows) != 1 or not rows[0].meta:
        raise ValueError(f"{path} holds no collection")
    m = json.loads(rows[0].meta)
    kind = m["encoder"].get("kind")
    meta = Meta(Layout(m["layout"]), m["dim"], Codec(m["codec"]), Metric(m["metric"]), {} if kind else m["encoder"])
    df = spark.read.parquet(f"{path}/rows")
    if not kind:
        return VectorDataset(df, meta)
    raw = bytes(spark.read.parquet(f"{path}/encoder").first().arrays)
    with np.load(io.BytesIO(raw), allow_pickle=False) as arrays:
        return EncodedDataset(df, ENCODERS[kind].from_state(dict(arrays)), meta)


def shortest(score: Column) -> Column:
    """The shortest text that reads back as the same 32-bit float."""
    return score.cast("float").cast("string")


def write_ground_truth(result: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """query_id, doc_id, rank, score separated by tabs, without a header, ordered by query and rank over all files."""
    rows = result.select("query_id", "doc_id", "rank", shortest(F.col("score")).alias("score"))
    rows.repartitionByRange("query_id").sortWithinPartitions("query_id", "rank").write.mode(mode).option("sep", "\t").csv(path)


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").csv(path, schema="query_id long, doc_id long, rank int, score float")
