"""Readers: documents (JSON lines, registered sources), passages, mappings, queries, runs, judgements and indexes."""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import chain, islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions.text import docid_of
from codelattice.operators.evaluation import parse_run
from codelattice.session import scratch_path

Reader = Callable[[SparkSession, str], DataFrame]
_registered: dict[str, dict[str, Reader]] = {}


def register_source(prefix: str, reader: Reader | None = None, *, queries: Reader | None = None, qrels: Reader | None = None) -> None:
    """Makes ``prefix:...`` readable: documents by :func:`read_documents`, queries (qid, text) and judgements (qid, doc_id, relevance) by theirs."""
    given = {"documents": reader, "queries": queries, "qrels": qrels}
    _registered[prefix] = _registered.get(prefix, {}) | {k: r for k, r in given.items() if r is not None}


def _source(spec: str, kind: str) -> tuple[Reader, str] | None:
    prefix, _, rest = spec.partition(":")
    own = _registered.get(prefix, {})
    return (own[kind], rest) if rest and kind in own else None


def _in_parts(spark: SparkSession, rows: Iterable[dict], schema: str, per: int = 50_000) -> DataFrame:
    """Rows that a library gives one by one, put as JSON lines into the shared folder, some at a time, and read from there."""
    from codelattice.sources.sinks import write_text

    path, rows, n = scratch_path(spark), iter(rows), 0
    while part := list(islice(rows, per)):
        write_text(spark, f"{path}/part-{n:06d}.json", "\n".join(json.dumps(r, default=str) for r in part))
        n += 1
    return spark.read.schema(schema).json(path) if n else spark.createDataFrame([], schema)


def _library(name: str):
    try:
        return importlib.import_module(name)
    except ImportError as e:
        raise ImportError(f"this source needs the package {name}, or a reader given to register_source") from e


def _collection_documents(spark: SparkSession, name: str) -> DataFrame:
    docs = _library("ir_datasets").load(name)
    rows = (d._asdict() for d in docs.docs_iter())
    first = next(rows, None)
    names = list(first) if first else ["doc_id", "text"]
    return _in_parts(spark, chain([first] if first else [], rows), ", ".join(f"`{n}` string" for n in names))


def _collection_queries(spark: SparkSession, name: str) -> DataFrame:
    rows = ({"qid": q.query_id, "text": q.default_text() if hasattr(q, "default_text") else q.text} for q in _library("ir_datasets").load(name).queries_iter())
    return _in_parts(spark, rows, "qid string, text string")


def _collection_qrels(spark: SparkSession, name: str) -> DataFrame:
    rows = ({"qid": q.query_id, "doc_id": q.doc_id, "relevance": q.relevance} for q in _library("ir_datasets").load(name).qrels_iter())
    return _in_parts(spark, rows, "qid string, doc_id string, relevance int")


def _hub_documents(spark: SparkSession, name: str) -> DataFrame:
    """A split of a dataset on a hub; without one in the name the repository must have exactly one."""
    spec, library = parse_hub_spec(name), _library("datasets")
    split = spec.split
    if split is None:
        found = library.get_dataset_split_names(spec.repo, spec.config or None)
        if len(found) != 1:
            raise ValueError(f"{name} has the splits {', '.join(found)}: name one")
        split = found[0]
    rows = iter(library.load_dataset(spec.repo, spec.config or None, split=split, streaming=True))
    first = next(rows, None)
    names = list(first) if first else ["id", "text"]
    return _in_parts(spark, chain([first] if first else [], rows), ", ".join(f"`{n}` string" for n in names))


@dataclass(frozen=True)
class HubSpec:
    repo: str
    config: str
    split: str | None


def parse_hub_spec(spec: str) -> HubSpec:
    """``repo:config/split`` in its forms: one slash (the only split of the repository is used) or two slashes (the last part is the split)."""
    name, _, config = spec.partition(":")
    slashes = spec.count("/")
    if slashes == 1:
        return HubSpec(name, config, None)
    if slashes == 2:
        config, _, split = config.rpartition("/") if ":" in spec else ("", "", name.rpartition("/")[2])
        return HubSpec(name if ":" in spec else name.rpartition("/")[0], config, split)
    raise ValueError(f"one or two slashes are needed: {spec}")


def read_json_lines(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """Rows of JSON lines, plain or gzipped, by globs; lines that aren't JSON are left out (see :func:`malformed_lines`)."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(paths)


def malformed_lines(spark: SparkSession, paths: list[str]) -> int:
    """How many non-empty lines aren't JSON."""
    lines = spark.read.text(paths).where(F.trim("value") != "")
    return lines.where(F.try_parse_json("value").isNull()).count()


def read_documents(spark: SparkSession, corpus: list[str], schema: str) -> DataFrame:
    """The first path decides: a registered prefix (then it must be the only one), else globs of JSON lines."""
    if given := _source(corpus[0], "documents"):
        if len(corpus) != 1:
            raise ValueError("exactly one collection can be read from a registered source")
        return given[0](spark, given[1])
    return read_json_lines(spark, corpus, schema)


def _tsv(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.text(path).select(F.split(F.trim("value"), "\t").alias("f"))


def read_passages(spark: SparkSession, path: str | list[str], *, pid_type: str = "long") -> DataFrame:
    """(pid, text) of lines ``pid TAB text [TAB title]``. Quotes are ordinary characters. A line without a text raises."""
    f = _tsv(spark, path)
    text = F.when(F.size("f") > 1, F.col("f")[1]).otherwise(F.raise_error(F.lit("a passage line has no text")))
    return f.select(F.col("f")[0].cast(pid_type).alias("pid"), text.alias("text"))


def read_collection(spark: SparkSession, paths: list[str], id_field: str = "id", text_fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """(pid, text) of JSON lines without a mapping: texts are joined by one space; a null id or field raises."""
    names = list(dict.fromkeys([id_field, *text_fields]))
    rows = read_json_lines(spark, paths, ", ".join(f"`{n}` string" for n in names))
    def there(n: str) -> Column:
        return F.when(F.col(n).isNotNull(), F.col(n)).otherwise(F.raise_error(F.lit(f"a row has no {n}")))

    return rows.select(there(id_field).alias("pid"), F.concat_ws(" ", *map(there, text_fields)).alias("text"))


def read_queries(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(qid, text) of lines with exactly two fields, or of a registered source; of a repeated qid the last line of the last file (by name) holds."""
    if isinstance(path, str) and (given := _source(path, "queries")):
        return given[0](spark, given[1])
    place = F.struct(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("i"))
    lines = spark.read.text(path).select(place.alias("n"), F.split(F.trim("value"), "\t").alias("f"))
    lines = lines.select("n", F.when(F.size("f") == 2, F.col("f")).otherwise(F.raise_error(F.lit("a query line needs two fields"))).alias("f"))
    return last_wins(lines.select("n", F.col("f")[0].alias("qid"), F.col("f")[1].alias("text")), "qid", "n").drop("n")


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row of the greatest ``order`` for each key: an aggregation, which combines before it shuffles."""
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_r"), F.max(order).alias(order)).select(key, order, *(F.col("_r")[c].alias(c) for c in rest))


def read_mapping(spark: SparkSession, path: str, *, keep_chunk: bool = False, pid_type: str = "long") -> DataFrame:
    """(pid, doc_id) of lines ``pid TAB tag``; the document is the tag without its last part, unless ``keep_chunk``."""
    f = _tsv(spark, path)
    tag = F.coalesce(F.col("f")[1], F.lit(""))
    return f.select(F.col("f")[0].cast(pid_type).alias("pid"), (tag if keep_chunk else docid_of(tag)).alias("doc_id"))


def read_run(spark: SparkSession, path: str) -> DataFrame:
    return parse_run(spark.read.text(path), "value")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """(qid, doc_id, relevance) of lines ``qid 0 docid relevance``, or of a registered source."""
    if given := _source(path, "qrels"):
        return given[0](spark, given[1])
    f = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    return spark.read.text(path).select(f.alias("f")).where(F.size("f") == 4).select(F.col("f")[0].alias("qid"), F.col("f")[2].alias("doc_id"), F.col("f")[3].cast("int").alias("relevance"))


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    """(pid, cid, w); an unweighted index has no column w, and reads as 1."""
    df = spark.read.parquet(path)
    return df if "w" in df.columns else df.withColumn("w", F.lit(1.0))


def read_centroids(spark: SparkSession, path: str) -> DataFrame:
    """A codebook (cid, v)."""
    return spark.read.parquet(path).select("cid", "v")


def read_samples(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Sampled token vectors, in one place or several. Training puts them in an order of its own."""
    return spark.read.parquet(*([paths] if isinstance(paths, str) else paths))


def count_rows(df: DataFrame, known: int | None = None) -> int:
    return known if known is not None else df.count()


register_source("irds", _collection_documents, queries=_collection_queries, qrels=_collection_qrels)
register_source("hfds", _hub_documents)
