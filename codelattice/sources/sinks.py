"""Writers: passages and mapping, postings in both layouts, metadata, runs and arguments."""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.operators.evaluation import run_lines
from codelattice.operators.indexing import inverted


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file on whatever file system the path names, put in place at once."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p, tmp = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".tmp")
    fs = p.getFileSystem(conf)
    out = fs.create(tmp, True)
    out.write(bytearray(text, "utf-8"))
    out.close()
    fs.delete(p, False)
    fs.rename(tmp, p)


def read_text(spark: SparkSession, path: str) -> str | None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return None
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _mode(overwrite: bool) -> str:
    return "overwrite" if overwrite else "errorifexists"


def write_passages(passages: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """``collection_passages`` and ``mapping`` as tab-separated lines without quoting, and ``passages`` as Parquet."""
    options = {"sep": "\t", "quote": "", "escape": "", "emptyValue": ""}
    passages.write.mode(_mode(overwrite)).parquet(f"{path}/passages")
    kept = passages.sparkSession.read.parquet(f"{path}/passages")
    kept.select("pid", "text").write.mode(_mode(overwrite)).options(**options).csv(f"{path}/collection_passages")
    kept.select("pid", "passage_id").write.mode(_mode(overwrite)).options(**options).csv(f"{path}/mapping")


def write_index(posts: DataFrame, path: str, *, weighted: bool, overwrite: bool = False, files: int | None = None) -> None:
    """The postings twice: clustered by passage and by centroid, so that statistics of row groups prune lookups of either."""
    cols = ["pid", "cid", "w"] if weighted else ["pid", "cid"]
    posts = posts.select(*cols)
    n = [files] if files else []
    posts.repartitionByRange(*n, "pid").sortWithinPartitions("pid", "cid").write.mode(_mode(overwrite)).parquet(f"{path}/forward")
    inverted(posts, files).write.mode(_mode(overwrite)).parquet(f"{path}/inverted")


def write_metadata(spark: SparkSession, path: str, **values) -> None:
    """``metadata.json``; -1 stands for what isn't known at an early stage."""
    base = {"n_centroids": -1, "n_docs": -1, "nnz": -1, "total_shards": -1, "weighted": None, "colbert_checkpoint": None, "centroids": None, "collection": None, "passage_mapping": None}
    held = json.loads(read_text(spark, f"{path}/metadata.json") or "{}")
    write_text(spark, f"{path}/metadata.json", json.dumps(base | held | values, indent=2))


def read_metadata(spark: SparkSession, path: str) -> dict | None:
    text = read_text(spark, f"{path}/metadata.json")
    return json.loads(text) if text else None


def write_run(run: DataFrame, path: str, run_id: str, *, topk: int = 1000, overwrite: bool = False) -> None:
    lines = run_lines(run, run_id, topk).repartitionByRange("qid").sortWithinPartitions("qid", "rank")
    lines.select(F.col("line").alias("value")).write.mode(_mode(overwrite)).text(path)


def write_arguments(spark: SparkSession, path: str, args) -> None:
    write_text(spark, f"{path}/args.json", json.dumps(asdict(args) if is_dataclass(args) else dict(args), indent=2, default=str))
