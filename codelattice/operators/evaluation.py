"""Run files and retrieval metrics."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_METRICS = ("nDCG@10", "nDCG@20", "P@10", "R@1000")


def run_lines(run: DataFrame, run_id: str | None = None, topk: int = 1000) -> DataFrame:
    """(qid, rank, line): the ``topk`` best documents of each query as ``qid 0 docid rank score run_id``; ``run`` has qid, doc_id, score (and run_id).

    Scores are written with all their digits, so that what is read back ranks and ties as the run does."""
    rid = F.lit(run_id) if run_id is not None else F.col("run_id")
    w = Window.partitionBy("qid", *([] if run_id is not None else ["run_id"])).orderBy(F.col("score").desc(), "doc_id")
    ranked = run.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= topk)
    line = F.concat_ws(" ", "qid", F.lit("0"), "doc_id", F.col("rank").cast("string"), F.col("score").cast("double").cast("string"), rid)
    return ranked.select("qid", "rank", line.alias("line"))


def parse_run(lines: DataFrame, column: str = "line") -> DataFrame:
    """(qid, doc_id, score) of lines with exactly six fields."""
    f = F.split(F.trim(F.regexp_replace(column, r"\s+", " ")), " ")
    return lines.select(f.alias("f")).where(F.size("f") == 6).select(F.col("f")[0].alias("qid"), F.col("f")[2].alias("doc_id"), F.col("f")[4].cast("double").alias("score"))


def parse_metric(name: str) -> tuple[str, int | None]:
    m = re.fullmatch(r"(nDCG|P|R|AP|RR|Success)(?:@(\d+))?", name)
    if not m or (m[1] in ("P", "Success") and not m[2]):
        raise ValueError(f"not a metric: {name}")
    return m[1], int(m[2]) if m[2] else None


def judged(run: DataFrame, qrels: DataFrame) -> DataFrame:
    """(qid, doc_id, rank, relevance) of a run (qid, doc_id, score); for evaluation ties go to the greater document id."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), F.col("doc_id").desc())
    return run.withColumn("rank", F.row_number().over(w)).join(qrels, ["qid", "doc_id"], "left").select("qid", "doc_id", "rank", F.coalesce("relevance", F.lit(0)).alias("relevance"))


def per_query(run: DataFrame, qrels: DataFrame, metrics: tuple[str, ...] = DEFAULT_METRICS, relevant: int = 1) -> DataFrame:
    """(qid, metric, value) for every judged query; one that the run lacks counts 0. All metrics come from one pass over the ranked run."""
    ranked = judged(run, qrels)
    gain = lambda rel, rank: rel / (F.log(rank + 1.0) / F.log(F.lit(2.0)))
    ideal = qrels.where("relevance > 0").withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.col("relevance").desc())))
    hit = (F.col("relevance") >= relevant).cast("int")
    got, want, values = [], [F.sum(hit).alias("n_rel")], {}
    before = F.sum(hit).over(Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    ranked = ranked.withColumn("hits", before)
    for i, name in enumerate(metrics):
        kind, k = parse_metric(name)
        at = F.col("rank") <= k if k else F.lit(True)
        if kind == "nDCG":
            got.append(F.sum(F.when(at, gain(F.col("relevance"), F.col("rank")))).alias(f"g{i}"))
            want.append(F.sum(F.when(at, gain(F.col("relevance"), F.col("rank")))).alias(f"i{i}"))
            values[name] = F.when(F.col(f"i{i}") > 0, F.col(f"g{i}") / F.col(f"i{i}"))
        elif kind == "AP":
            got.append(F.sum(F.when(at, hit * F.col("hits") / F.col("rank"))).alias(f"g{i}"))
            values[name] = F.when(F.col("n_rel") > 0, F.col(f"g{i}") / F.col("n_rel"))
        elif kind == "RR":
            got.append(F.max(F.when(at & (hit == 1), 1 / F.col("rank"))).alias(f"g{i}"))
            values[name] = F.col(f"g{i}")
        else:
            got.append(F.sum(F.when(at, hit)).alias(f"g{i}"))
            values[name] = {"P": F.col(f"g{i}") / F.lit(k), "R": F.when(F.col("n_rel") > 0, F.col(f"g{i}") / F.col("n_rel")), "Success": (F.col(f"g{i}") > 0).cast("double")}[kind]
    table = qrels.select("qid").distinct().join(ranked.groupBy("qid").agg(*got), "qid", "left").join(ideal.groupBy("qid").agg(*want), "qid", "left")
    pairs = F.array(*(F.struct(F.lit(n).alias("metric"), F.coalesce(v, F.lit(0.0)).cast("double").alias("value")) for n, v in values.items()))
    return table.select("qid", F.explode(pairs).alias("m")).select("qid", "m.metric", "m.value")


def mean_metrics(run: DataFrame, qrels: DataFrame, metrics: tuple[str, ...] = DEFAULT_METRICS, relevant: int = 1) -> DataFrame:
    return per_query(run, qrels, metrics, relevant).groupBy("metric").agg(F.avg("value").alias("value"))
