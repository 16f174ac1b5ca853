"""The queries of the retrieval engine over the test tables, and their SQL for DuckDB."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.functions.text import assemble, docid_of
from codelattice.operators import codebook, evaluation, indexing, passages, searching
from codelattice.operators.vectors import Codebook, all_scores, best_centroids, matrix
from codelattice.session import scratch_path, ship, table, write_scratch
from codelattice.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# -- text and passages

_WS = r"[\t-\r\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_ASSEMBLED = f"regexp_replace(CASE WHEN coalesce(title, '') <> '' THEN title || ' ' || coalesce(text, '') ELSE coalesce(text, '') END, '{_WS}', ' ', 'g')"
_WINDOWS = """
    WITH t AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, list_filter(string_split_regex({text}, '{ws}'), lambda x: x <> '') AS t FROM documents),
    w AS (SELECT doc_id, t, unnest(range(0, len(t), {stride})) AS s FROM t WHERE len(t) > 0)
"""
_PASSAGES = _WINDOWS + "SELECT doc_id, CAST(s // {stride} AS BIGINT) AS chunk_idx, doc_id || '_' || CAST(s // {stride} AS VARCHAR) AS passage_id, CAST(least({length}, len(t) - s) AS INT) AS n_tokens, array_to_string(list_slice(t, s + 1, s + {length}), ' ') AS text FROM w"


@query(f"SELECT doc_id, {_ASSEMBLED} AS text FROM documents")
def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", assemble(F.col("title"), [F.col("text")]).alias("text"))


@query(_PASSAGES.format(text=_ASSEMBLED, ws=_WS, stride=90, length=180))
def passage_windows_180_90(spark: SparkSession, d: str) -> DataFrame:
    return passages.passages(table(spark, d, "documents"), "doc_id", ["text"], title="title")


@query(_PASSAGES.format(text=_ASSEMBLED.replace("coalesce(title, '') <> ''", "false"), ws=_WS, stride=512, length=512))
def passage_windows_512_512(spark: SparkSession, d: str) -> DataFrame:
    return passages.passages(table(spark, d, "documents"), "doc_id", ["text"], length=512, stride=512)


@query(_WINDOWS.format(text=_ASSEMBLED, ws=_WS, stride=90) + "SELECT CAST(row_number() OVER (ORDER BY doc_id, s) - 1 AS BIGINT) AS pid, doc_id || '_' || CAST(s // 90 AS VARCHAR) AS passage_id FROM w")
def dense_pid(spark: SparkSession, d: str) -> DataFrame:
    cut = passages.passages(table(spark, d, "documents"), "doc_id", ["text"], title="title").drop("text")
    return passages.dense_ids(cut, ["doc_id", "chunk_idx"]).select("pid", "passage_id")


@query("SELECT count(*) AS n FROM collection_passages")
def collection_length(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "collection_passages").agg(F.count("*").alias("n"))


_TAGS = """SELECT pid, arg_max(coalesce(original_docid_chunkidx, chr(1)), written_at) AS t FROM passage_mapping GROUP BY pid"""


@query(f"""SELECT pid, CASE WHEN t = chr(1) THEN NULL ELSE t END AS tag, CASE WHEN t = chr(1) OR NOT contains(t, '_') THEN '' ELSE regexp_extract(t, '(?s)^(.*)_[^_]*$', 1) END AS doc_id FROM ({_TAGS})""")
def passage_mapping_strip(spark: SparkSession, d: str) -> DataFrame:
    held = readers.last_wins(table(spark, d, "passage_mapping"), "pid", "written_at")
    tag = F.col("original_docid_chunkidx")
    return held.select("pid", tag.alias("tag"), F.coalesce(docid_of(tag), F.lit("")).alias("doc_id"))


@query(f"""SELECT doc_id, count(*) AS n_passages FROM (SELECT CASE WHEN t = chr(1) OR NOT contains(t, '_') THEN '' ELSE regexp_extract(t, '(?s)^(.*)_[^_]*$', 1) END AS doc_id FROM ({_TAGS})) GROUP BY doc_id""")
def passages_of_documents(spark: SparkSession, d: str) -> DataFrame:
    return passage_mapping_strip(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_passages"))


@query("""
    SELECT index_id, n_centroids, n_docs, nnz, total_shards, colbert_checkpoint, centroids, collection, passage_mapping FROM
    (SELECT *, row_number() OVER (PARTITION BY index_id ORDER BY written_at DESC) AS r FROM (SELECT DISTINCT * FROM index_metadata)) WHERE r = 1""")
def latest_metadata(spark: SparkSession, d: str) -> DataFrame:
    return readers.last_wins(table(spark, d, "index_metadata"), "index_id", "written_at").drop("written_at")


@query("""
    WITH p AS (SELECT DISTINCT pid FROM collection_passages), n AS (SELECT count(*) AS n FROM p)
    SELECT pid FROM (SELECT pid, row_number() OVER (ORDER BY md5(CAST(pid AS VARCHAR) || ':42'), pid) AS r FROM p)
    WHERE r <= (SELECT least(1 + CAST(floor(16 * sqrt(120.0 * n)) AS BIGINT), n) FROM n)""")
def sample_passages(spark: SparkSession, d: str) -> DataFrame:
    pids = table(spark, d, "collection_passages").select("pid").distinct()
    return indexing.sample_exactly(pids, "pid", indexing.sample_size(pids.count()))


@query("""
    WITH t AS (SELECT item_text AS text, row_number() OVER (ORDER BY item_text) - 1 AS rank FROM eval_items WHERE item_text IS NOT NULL)
    SELECT CAST(rank AS BIGINT) AS rank, text FROM t WHERE rank % greatest(1, (SELECT count(*) FROM t) // 64) = 0""")
def train_query_stride(spark: SparkSession, d: str) -> DataFrame:
    got = indexing.training_queries(table(spark, d, "eval_items"), "item_text", 64)
    return got.select(F.col("rank").cast("long"), "text")


@query("""
    SELECT benchmark AS qid, regexp_replace(item_text, '[\\t\\n\\r\\x0B\\f]+', ' ', 'g') AS text FROM
    (SELECT *, row_number() OVER (PARTITION BY benchmark ORDER BY item_id DESC) AS r FROM eval_items WHERE benchmark IS NOT NULL AND length(trim(item_text)) > 0) WHERE r = 1""")
def queries_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Written as a file of queries with repeated ids, and read."""
    items = table(spark, d, "eval_items").where("benchmark is not null and length(trim(item_text)) > 0")
    path = scratch_path(spark)
    line = F.concat_ws("\t", "benchmark", F.regexp_replace("item_text", r"[\t\n\r\x0B\f]+", " "))
    items.coalesce(1).sortWithinPartitions("item_id").select(line.alias("value")).write.text(path)
    return readers.read_queries(spark, path)


@query("SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(title, '') || ' ' || coalesce(text, '') AS text, (SELECT count(*) FROM documents) AS malformed FROM documents")
def jsonl_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Documents as gzipped JSON lines, one broken line after each, and read as a collection without a mapping."""
    docs, path = table(spark, d, "documents"), scratch_path(spark)
    good = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text")))
    docs.select(F.explode(F.array(good, F.lit('{"id": broken'))).alias("value")).write.option("compression", "gzip").text(path)
    rows = readers.read_collection(spark, [path], "id", ("title", "text"))
    return rows.where("pid is not null").select(F.col("pid").alias("id"), "text", F.lit(readers.malformed_lines(spark, [path])).cast("long").alias("malformed"))


# -- indexing: token vectors of passages and the codebooks of their indexes

_TOKENS = "tk AS (SELECT DISTINCT sample_id, index_id, pid, CAST(v AS DOUBLE[]) AS v FROM training_embedding_samples WHERE pid IS NOT NULL AND len(v) = 96 AND len(list_filter(v, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0)"
_ASSIGNED = f"""
    {_TOKENS},
    sc AS (SELECT t.sample_id, t.index_id, t.pid, c.cid, round(list_dot_product(t.v, CAST(c.v AS DOUBLE[])), 9) AS s, list_dot_product(t.v, t.v) AS vv FROM tk t JOIN centroids c ON t.index_id = c.index_id),
    a AS (SELECT sample_id, index_id, pid, cid, s, vv - s + 1 AS w FROM sc QUALIFY row_number() OVER (PARTITION BY sample_id, pid ORDER BY s DESC, cid) = 1)"""


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "training_embedding_samples").where(F.col("pid").isNotNull() & (F.size("v") == 96))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return df.where(fine).select("sample_id", "index_id", "pid", "v").dropDuplicates(["sample_id", "pid"])


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return indexing.assignments(_tokens(spark, d), table(spark, d, "centroids"), ["sample_id", "index_id", "pid"], by="index_id")


@query(f"WITH {_ASSIGNED} SELECT sample_id, pid, cid, round(s, 6) AS score, round(w, 6) AS w FROM a")
def assign_centroids(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("sample_id", "pid", "cid", F.round("score", 6).alias("score"), F.round("w", 6).alias("w"))


@query(f"WITH {_ASSIGNED} SELECT DISTINCT index_id, pid, cid, CAST(1 AS DOUBLE) AS w FROM a")
def postings_unweighted(spark: SparkSession, d: str) -> DataFrame:
    return indexing.postings(_assigned(spark, d), ["index_id", "pid"])


@query(f"WITH {_ASSIGNED} SELECT index_id, pid, cid, round(max(greatest(w, -1.0)), 6) AS w FROM a GROUP BY index_id, pid, cid")
def postings_weighted(spark: SparkSession, d: str) -> DataFrame:
    return indexing.postings(_assigned(spark, d), ["index_id", "pid"], weighted=True).withColumn("w", F.round("w", 6))


@query(f"WITH {_ASSIGNED} SELECT pid, array_to_string(list(cid ORDER BY cid), ',') AS codes FROM (SELECT DISTINCT pid, cid FROM a) GROUP BY pid")
def forward_index(spark: SparkSession, d: str) -> DataFrame:
    rows = indexing.forward(indexing.postings(_assigned(spark, d)))
    return rows.select("pid", F.array_join(F.col("codes.cid").cast("array<string>"), ",").alias("codes"))


@query(f"WITH {_ASSIGNED} SELECT cid, array_to_string(list(pid ORDER BY pid), ',') AS passages FROM (SELECT DISTINCT pid, cid FROM a) GROUP BY cid")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    rows = indexing.inverted_lists(indexing.postings(_assigned(spark, d)))
    return rows.select("cid", F.array_join(F.col("passages.pid").cast("array<string>"), ",").alias("passages"))


@query(f"WITH {_ASSIGNED} SELECT count(DISTINCT pid) AS n_docs, count(*) AS nnz, (SELECT count(*) FROM centroids) AS n_centroids FROM (SELECT DISTINCT pid, cid FROM a)")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return indexing.stats(indexing.postings(_assigned(spark, d)), table(spark, d, "centroids").count())


@query(f"WITH {_ASSIGNED} SELECT cid FROM centroids WHERE cid NOT IN (SELECT cid FROM a)")
def dead_centroids(spark: SparkSession, d: str) -> DataFrame:
    return indexing.dead_centroids(_assigned(spark, d), table(spark, d, "centroids"))


_ASKED = "SELECT CAST(v AS DOUBLE[]) AS q FROM centroids WHERE cid % 4 = 1"


@query(f"""
    WITH {_ASSIGNED}, x AS (SELECT a.sample_id, a.pid, a.cid, t.v, CAST(c.v AS DOUBLE[]) AS c FROM a JOIN tk t ON a.sample_id = t.sample_id AND a.pid = t.pid JOIN centroids c ON c.cid = a.cid),
    e AS (SELECT sample_id, pid, round(sum(power(list_dot_product(q, c) - list_dot_product(q, v), 2)), 6) AS error2 FROM x CROSS JOIN ({_ASKED}) GROUP BY sample_id, pid),
    r AS (SELECT *, row_number() OVER (ORDER BY error2 DESC, sample_id, pid) AS r FROM e), y AS (SELECT cid, row_number() OVER (ORDER BY cid) AS r FROM centroids WHERE cid NOT IN (SELECT cid FROM a))
    SELECT cid, sample_id, pid, error2 FROM y JOIN r USING (r)""")
def restart_plan(spark: SparkSession, d: str) -> DataFrame:
    """The rule the trainer uses, too: the errors |Q(c - d)| by all queries, which a quarter of the centroids stand for."""
    asked = matrix(table(spark, d, "centroids").where("cid % 4 = 1").select("v").toArrow()["v"])
    return indexing.restart_plan(_tokens(spark, d), table(spark, d, "centroids"), ["sample_id", "pid"], asked, by="index_id")


# -- search: every vector of embeddings is a token of a passage (eight each) and of a query (four each); labels give the codebook

_LABEL_CENTROIDS = "c AS (SELECT cid, list(x ORDER BY i) AS v FROM (SELECT label AS cid, i, round(avg(CAST(embedding[i] AS DOUBLE)), 9) AS x FROM embeddings, range(1, 65) t(i) GROUP BY label, i) GROUP BY cid)"
_SEARCH = f"""
    {_LABEL_CENTROIDS},
    e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
    dt AS (SELECT vec_id // 8 AS pid, vec_id AS tok, v FROM e), q AS (SELECT vec_id // 4 AS qid, vec_id AS tok, v FROM e),
    da AS (SELECT pid, tok, cid, s, list_dot_product(v, v) - s + 1 AS w FROM (SELECT pid, tok, cid, dt.v, round(list_dot_product(dt.v, c.v), 9) AS s FROM dt CROSS JOIN c) QUALIFY row_number() OVER (PARTITION BY tok ORDER BY s DESC, cid) = 1),
    cs AS (SELECT qid, tok, cid, round(list_dot_product(q.v, c.v), 9) AS s FROM q CROSS JOIN c)"""


def _stages(np_: int, weighted: bool = True, topk: int = 20) -> str:
    w = "max(greatest(w, -1.0))" if weighted else "1.0"
    return f"""{_SEARCH},
    fwd AS (SELECT pid, cid, {w} AS w FROM da GROUP BY pid, cid),
    qc AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY tok ORDER BY s DESC, cid) <= {np_}),
    tm AS (SELECT qid, tok, pid, CASE WHEN count(*) = {np_} THEN max(w * s) ELSE greatest(max(w * s), 0.0) END AS m FROM qc JOIN fwd USING (cid) GROUP BY qid, tok, pid),
    st1 AS (SELECT qid, pid, sum(m) AS sc FROM tm GROUP BY qid, pid),
    every AS (SELECT qs.qid, ps.pid, coalesce(sc, 0) AS sc FROM (SELECT DISTINCT qid FROM q) qs CROSS JOIN (SELECT DISTINCT pid FROM dt) ps LEFT JOIN st1 ON st1.qid = qs.qid AND st1.pid = ps.pid),
    top AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, pid) <= {topk}),
    rr AS (SELECT qid, pid, sum(m) AS sc FROM (SELECT qid, pid, tok, max(s) AS m FROM top JOIN fwd USING (pid) JOIN cs USING (qid, cid) GROUP BY qid, pid, tok) GROUP BY qid, pid)"""


def _pooled(source: str, limit: int) -> str:
    return f"""
    mp AS (SELECT qid, CAST(pid // 2 AS VARCHAR) AS doc_id, max(sc) AS score FROM {source} GROUP BY qid, pid // 2),
    run AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM mp QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) <= {limit})"""


class Fixture:
    """Queries, passages, codebook, postings and mapping made from ``embeddings``."""

    def __init__(self, spark: SparkSession, d: str):
        e = table(spark, d, "embeddings")
        self.queries = e.select(F.expr("vec_id div 4").alias("qid"), F.col("vec_id").alias("tok"), F.col("embedding").alias("v"))
        self.tokens = e.select(F.expr("vec_id div 8").alias("pid"), F.col("vec_id").alias("tok"), F.col("embedding").alias("v"))
        means = e.select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.round(F.avg(F.col("x").cast("double")), 9).alias("x"))
        rows = means.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("v"))
        self.centroids = write_scratch(rows.select(F.col("label").cast("int").alias("cid"), "v"))
        self.book = Codebook(self.centroids)
        self.n_docs = self.tokens.select("pid").distinct().count()
        self.mapping = self.tokens.select("pid").distinct().select("pid", F.expr("cast(pid div 2 as string)").alias("doc_id"))
        self.labels = e.select(F.expr("vec_id div 4").alias("qid"), F.expr("vec_id div 8").alias("pid"), "vec_id", "label")

    def postings(self, weighted: bool) -> DataFrame:
        return write_scratch(indexing.postings(indexing.assignments(self.tokens, self.book, ["pid", "tok"]), weighted=weighted))

    def first(self, nprobe: int, weighted: bool = True) -> DataFrame:
        return searching.first_stage(searching.probes(self.queries, self.book, nprobe), self.postings(weighted), nprobe)

    def top(self, nprobe: int, topk: int = 20, weighted: bool = True) -> DataFrame:
        return searching.top_passages(self.first(nprobe, weighted), self.queries, self.n_docs, topk)

    def run(self, **options) -> DataFrame:
        return searching.search(self.queries, self.book, self.postings(True), self.n_docs, self.mapping, **options)

    def qrels(self) -> DataFrame:
        """The label asked for is that of a query's first token; a document's relevance is its number of tokens of that label."""
        asked = self.labels.groupBy("qid").agg(F.min_by("label", "vec_id").alias("label"))
        held = self.labels.groupBy("label", F.expr("cast(pid div 2 as string)").alias("doc_id")).agg(F.count("*").cast("int").alias("relevance"))
        return asked.join(held, "label").select("qid", "doc_id", "relevance")


@query(f"WITH {_SEARCH} SELECT qid, tok, cid, round(s, 6) AS score FROM cs")
def centroid_scores(spark: SparkSession, d: str) -> DataFrame:
    f = Fixture(spark, d)
    return all_scores(f.queries, f.book, ["qid", "tok"]).withColumn("score", F.round("score", 6))


def _probe_sql(n: int) -> str:
    return f"WITH {_stages(n)} SELECT qid, tok, cid, round(s, 6) AS score FROM qc"


def _probe(n: int) -> Query:
    def run(spark: SparkSession, d: str) -> DataFrame:
        f = Fixture(spark, d)
        return searching.probes(f.queries, f.book, n).withColumn("score", F.round("score", 6))

    run.__name__ = f"probe_np{n}"
    return run


for _n in (1, 4):
    query(_probe_sql(_n))(_probe(_n))


@query(f"WITH {_stages(2, False)} SELECT qid, pid, round(sc, 6) AS score FROM st1")
def first_stage_unweighted(spark: SparkSession, d: str) -> DataFrame:
    return Fixture(spark, d).first(2, False).withColumn("score", F.round("score", 6))


@query(f"WITH {_stages(4)} SELECT qid, pid, round(sc, 6) AS score FROM st1")
def first_stage_weighted(spark: SparkSession, d: str) -> DataFrame:
    return Fixture(spark, d).first(4).withColumn("score", F.round("score", 6))


@query(f"WITH {_stages(1, True, 60)} SELECT qid, pid, round(sc, 6) AS score FROM top")
def first_stage_padded(spark: SparkSession, d: str) -> DataFrame:
    return Fixture(spark, d).top(1, 60).select("qid", "pid", F.round("score", 6).alias("score"))


@query(f"WITH {_stages(4)} SELECT qid, pid, round(sc, 6) AS score FROM rr")
def rerank(spark: SparkSession, d: str) -> DataFrame:
    f = Fixture(spark, d)
    return searching.rerank(f.top(4), f.postings(True), f.queries, f.book).withColumn("score", F.round("score", 6))


@query(f"WITH {_stages(4)}, {_pooled('top', 100)} SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM run")
def search_no_forward(spark: SparkSession, d: str) -> DataFrame:
    return Fixture(spark, d).run(nprobe=4, topk=20, use_forward=False).withColumn("score", F.round("score", 6))


@query(f"WITH {_stages(4)}, {_pooled('rr', 100)} SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM run")
def search_documents(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: probe, score, pad, rerank and pool, for all queries in one plan."""
    return Fixture(spark, d).run(nprobe=4, topk=20).withColumn("score", F.round("score", 6))


@query(f"WITH {_stages(4)}, {_pooled('rr', 3)} SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM run")
def maxp_limit(spark: SparkSession, d: str) -> DataFrame:
    return Fixture(spark, d).run(nprobe=4, topk=20, limit=3).withColumn("score", F.round("score", 6))


# -- runs and metrics

_RUN_ROWS = "SELECT run_id, qid, did, max(s) AS s FROM trec_run WHERE run_id IS NOT NULL AND qid IS NOT NULL AND did IS NOT NULL AND s IS NOT NULL AND NOT isnan(s) GROUP BY run_id, qid, did"


def _run_rows(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "trec_run").where("run_id is not null and qid is not null and did is not null and s is not null and not isnan(s)")
    return rows.groupBy("run_id", "qid", F.col("did").alias("doc_id")).agg(F.max("s").alias("score"))


@query(f"""
    SELECT qid, CAST(rank AS INT) AS rank, qid || ' 0 ' || did || ' ' || CAST(rank AS VARCHAR) || ' ' || CAST(s AS VARCHAR) || ' ' || run_id AS line FROM
    (SELECT *, row_number() OVER (PARTITION BY run_id, qid ORDER BY s DESC, did) AS rank FROM ({_RUN_ROWS})) WHERE rank <= 1000""")
def trec_run_lines(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.run_lines(_run_rows(spark, d))


@query(f"""
    SELECT qid, did AS doc_id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY run_id, qid ORDER BY s DESC, did) AS rank FROM ({_RUN_ROWS})) WHERE rank <= 1000 AND NOT regexp_matches(qid || did || run_id, '\\s')""")
def trec_run_parse(spark: SparkSession, d: str) -> DataFrame:
    """Lines written to files and read back."""
    path = scratch_path(spark)
    evaluation.run_lines(_run_rows(spark, d)).select(F.col("line").alias("value")).write.text(path)
    return readers.read_run(spark, path)


_QRELS = """
    asked AS (SELECT vec_id // 4 AS qid, arg_min(label, vec_id) AS label FROM embeddings GROUP BY vec_id // 4),
    qrels AS (SELECT qid, doc_id, n AS relevance FROM asked JOIN (SELECT label, CAST(vec_id // 8 // 2 AS VARCHAR) AS doc_id, count(*) AS n FROM embeddings GROUP BY label, vec_id // 8 // 2) USING (label)),
    jd AS (SELECT r.qid, r.doc_id, row_number() OVER (PARTITION BY r.qid ORDER BY r.score DESC, r.doc_id DESC) AS rank, coalesce(relevance, 0) AS rel FROM (SELECT qid, doc_id, round(score, 6) AS score FROM run) r LEFT JOIN qrels USING (qid, doc_id)),
    id AS (SELECT qid, relevance AS rel, row_number() OVER (PARTITION BY qid ORDER BY relevance DESC) AS rank FROM qrels),
    g AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rank <= 10 AND rel >= 2 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN rank <= 1000 AND rel >= 2 THEN 1 ELSE 0 END) AS r FROM jd GROUP BY qid),
    i AS (SELECT qid, sum(CASE WHEN rank <= 10 THEN rel / log2(rank + 1) ELSE 0 END) AS dcg, sum(CASE WHEN rel >= 2 THEN 1 ELSE 0 END) AS n FROM id GROUP BY qid),
    v AS (SELECT asked.qid, coalesce(g.dcg / nullif(i.dcg, 0), 0) AS ndcg, coalesce(p / 10.0, 0) AS p, coalesce(r / nullif(CAST(n AS DOUBLE), 0), 0) AS r FROM asked LEFT JOIN g USING (qid) LEFT JOIN i USING (qid)),
    l AS (SELECT qid, 'nDCG@10' AS metric, ndcg AS value FROM v UNION ALL SELECT qid, 'P@10', p FROM v UNION ALL SELECT qid, 'R@1000', r FROM v)"""


def _values(spark: SparkSession, d: str) -> DataFrame:
    f = Fixture(spark, d)
    run = write_scratch(f.run(nprobe=4, topk=20).select("qid", "doc_id", F.round("score", 6).alias("score")))
    return evaluation.per_query(run, f.qrels(), ("nDCG@10", "P@10", "R@1000"), relevant=2)


@query(f"WITH {_stages(4)}, {_pooled('rr', 100)}, {_QRELS} SELECT qid, metric, round(CAST(value AS DOUBLE), 6) AS value FROM l")
def metrics_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).withColumn("value", F.round("value", 6))


@query(f"WITH {_stages(4)}, {_pooled('rr', 100)}, {_QRELS} SELECT metric, round(CAST(avg(value) AS DOUBLE), 6) AS value FROM l GROUP BY metric")
def metrics_mean(spark: SparkSession, d: str) -> DataFrame:
    f = Fixture(spark, d)
    run = write_scratch(f.run(nprobe=4, topk=20).select("qid", "doc_id", F.round("score", 6).alias("score")))
    return evaluation.mean_metrics(run, f.qrels(), ("nDCG@10", "P@10", "R@1000"), relevant=2).withColumn("value", F.round("value", 6))


# -- training

@query(f"WITH {_SEARCH}, ex AS (SELECT tok, cid, exp(s / 0.1) AS x FROM cs), tot AS (SELECT tok, sum(x) AS t FROM ex GROUP BY tok) SELECT tok, cid, round(x / t, 6) AS p FROM ex JOIN tot USING (tok)")
def soft_assignment(spark: SparkSession, d: str) -> DataFrame:
    f = Fixture(spark, d)
    rows = f.centroids.orderBy("cid").toArrow()  # a row for each label
    cids, book = rows["cid"].to_numpy(), matrix(rows["v"])

    def soft(batches):
        for b in batches:
            if b.num_rows:
                p = codebook.softmax(np.round(matrix(b.column(1)) @ book.T, 9) / 0.1)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), len(cids))), pa.array(np.tile(cids, b.num_rows)), pa.array(np.round(p.ravel(), 6))], ["tok", "cid", "p"])

    return f.queries.select("tok", "v").mapInArrow(soft, f"tok {f.queries.schema['tok'].dataType.simpleString()}, cid int, p double")


@query(f"""
    WITH {_SEARCH}, b AS (SELECT pid // 16 AS batch, tok, dt.v, c.v AS a FROM da JOIN dt USING (pid, tok) JOIN c USING (cid)),
    n AS (SELECT x.batch, x.tok, sqrt(sum(power(list_dot_product(x.v, y.a) - list_dot_product(x.v, y.v), 2))) AS n FROM b x JOIN b y ON x.batch = y.batch GROUP BY x.batch, x.tok)
    SELECT batch, round(avg(n), 6) AS loss FROM n GROUP BY batch""")
def loss_hard(spark: SparkSession, d: str) -> DataFrame:
    """The main objective of batches of 128 token vectors, which are their own queries."""
    import pandas as pd

    f = Fixture(spark, d)
    c = f.centroids.orderBy("cid").toPandas()  # a row for each label
    book = np.stack(c["v"]).astype(float)

    def loss(b: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(b["v"]).astype(float)
        return pd.DataFrame({"batch": [b["batch"].iloc[0]], "loss": [round(codebook.loss_and_gradient(book, x, x, codebook.Objective())[0], 6)]})

    return f.tokens.select(F.expr("pid div 16").alias("batch"), "v").groupBy("batch").applyInPandas(loss, "batch long, loss double")


@query()
def train_codebook(spark: SparkSession, d: str) -> DataFrame:
    f = Fixture(spark, d)
    return codebook.train_codebook(f.tokens, 32, steps=100, order="tok")


@query()
def second_best_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Best and second-best centroid of each token vector within its codebook, as the max-difference objective needs them."""
    return best_centroids(_tokens(spark, d), table(spark, d, "centroids"), ["sample_id", "pid"], 2, by="index_id").select("sample_id", "pid", "cid", "rank", F.round("score", 6).alias("score"))


SQL["second_best_centroids"] = f"WITH {_ASSIGNED} SELECT sample_id, pid, cid, CAST(r AS INT) AS rank, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY sample_id, pid ORDER BY s DESC, cid) AS r FROM sc) WHERE r <= 2"


def queries() -> dict[str, Query]:
    def shipped(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        run.__name__ = f.__name__
        return run

    return {k: shipped(f) for k, f in QUERIES.items()}


from codelattice import catalogue_io, catalogue_training  # noqa: E402, F401  their queries are added to these
