"""Queries over readers, writers, encoders and the stage planner: what is written to the shared folder is read back."""

from __future__ import annotations

import json
from dataclasses import asdict
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.catalogue import _ASSEMBLED, _ASSIGNED, _QRELS, _RUN_ROWS, _TAGS, _WINDOWS, _WS, Fixture, _assigned, _pooled, _run_rows, _stages, query
from codelattice.functions.encoders import HashEncoder, encode
from codelattice.functions.text import tokens
from codelattice.operators import evaluation, indexing, passages
from codelattice.plans.arguments import Indexing, Searching
from codelattice.plans.planner import Present, plan
from codelattice.session import scratch_path, table, write_scratch
from codelattice.sources import readers, sinks

_BREAKS = r"[\t\n\r\x0B\f]+"


def _one_line(name: str):
    return F.regexp_replace(name, _BREAKS, " ")


def _sql_line(name: str) -> str:
    return f"regexp_replace({name}, '[\\t\\n\\r\\x0B\\f]+', ' ', 'g')"


# -- sources


@query(f"SELECT DISTINCT pid, {_sql_line('passage_text')} AS text FROM collection_passages WHERE passage_text IS NOT NULL")
def passage_lines(spark: SparkSession, d: str) -> DataFrame:
    """Passages as lines of three fields, of which the third isn't read."""
    rows, path = table(spark, d, "collection_passages").where("passage_text is not null").select("pid", "passage_text").distinct(), scratch_path(spark)
    rows.select(F.concat_ws("\t", F.col("pid").cast("string"), _one_line("passage_text"), F.lit("title")).alias("value")).write.text(path)
    return readers.read_passages(spark, path)


@query("SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang FROM documents")
def registered_source(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the prefix of a source that was registered."""
    readers.register_source("table", lambda s, name: s.read.parquet(name))
    return readers.read_documents(spark, [f"table:{d}/documents.parquet"], "").select(F.col("doc_id").cast("string"), "lang")


@query(f"""
    WITH m AS (SELECT pid, trim({_sql_line('t')}) AS tag FROM ({_TAGS}) WHERE t <> chr(1))
    SELECT pid, CASE WHEN contains(tag, '_') THEN regexp_extract(tag, '(?s)^(.*)_[^_]*$', 1) ELSE '' END AS doc_id, tag FROM m""")
def mapping_lines(spark: SparkSession, d: str) -> DataFrame:
    """The latest tag of each pid as lines, read as documents and as tags."""
    held, path = readers.last_wins(table(spark, d, "passage_mapping"), "pid", "written_at").where("original_docid_chunkidx is not null"), scratch_path(spark)
    held.select(F.concat_ws("\t", F.col("pid").cast("string"), F.trim(_one_line("original_docid_chunkidx"))).alias("value")).write.text(path)
    return readers.read_mapping(spark, path).join(readers.read_mapping(spark, path, keep_chunk=True).withColumnRenamed("doc_id", "tag"), "pid")


@query(f"WITH {_stages(4)}, {_pooled('rr', 100)}, {_QRELS} SELECT CAST(qid AS VARCHAR) AS qid, doc_id, CAST(relevance AS INT) AS relevance FROM qrels")
def qrels_lines(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark)
    Fixture(spark, d).qrels().select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("0"), "doc_id", F.col("relevance").cast("string")).alias("value")).write.text(path)
    return readers.read_qrels(spark, path)


@query(f"""
    WITH {_ASSIGNED}, p AS (SELECT pid, cid, round(max(greatest(w, -1.0)), 6) AS w FROM a GROUP BY pid, cid)
    SELECT 'forward' AS layout, pid, cid, w FROM p UNION ALL SELECT 'inverted', pid, cid, w FROM p UNION ALL SELECT 'unweighted', pid, cid, CAST(1 AS DOUBLE) FROM p""")
def index_layouts(spark: SparkSession, d: str) -> DataFrame:
    """Postings written clustered by passage and by centroid, with and without weights, and read from each."""
    posts = write_scratch(indexing.postings(_assigned(spark, d), weighted=True).withColumn("w", F.round("w", 6)))
    indexing.check_range(posts, posts.agg(F.max("cid")).first()[0] + 1)
    paths = scratch_path(spark), scratch_path(spark)
    sinks.write_index(posts, paths[0], weighted=True)
    sinks.write_index(posts, paths[1], weighted=False)
    parts = {"forward": f"{paths[0]}/forward", "inverted": f"{paths[0]}/inverted", "unweighted": f"{paths[1]}/inverted"}
    read = [readers.read_postings(spark, p).select(F.lit(n).alias("layout"), "pid", "cid", "w") for n, p in parts.items()]
    return read[0].union(read[1]).union(read[2])


@query("SELECT cid, len(v) AS dims, CAST(v[1] AS DOUBLE) AS first, CAST(v[len(v)] AS DOUBLE) AS last FROM centroids WHERE len(v) > 0")
def codebook_scan(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark)
    table(spark, d, "centroids").select("cid", "v").write.parquet(path)
    return readers.read_centroids(spark, path).where(F.size("v") > 0).select("cid", F.size("v").cast("long").alias("dims"), F.col("v")[0].cast("double").alias("first"), F.element_at("v", -1).cast("double").alias("last"))


@query("SELECT sample_id, tok, len(v) AS dims FROM training_embedding_samples")
def sample_files(spark: SparkSession, d: str) -> DataFrame:
    """Samples in several places, read as one."""
    rows, paths = table(spark, d, "training_embedding_samples"), [scratch_path(spark), scratch_path(spark)]
    for i, path in enumerate(paths):
        rows.where(F.pmod(F.coalesce("tok", F.lit(0)), F.lit(2)) == i).write.parquet(path)
    return readers.read_samples(spark, paths).select("sample_id", "tok", F.when(F.col("v").isNotNull(), F.size("v")).cast("long").alias("dims"))


@query("SELECT * FROM (VALUES ('org/repo:conf', 'org/repo', 'conf', ''), ('org/repo:conf/train', 'org/repo', 'conf', 'train'), ('org/repo', 'org/repo', '', ''), ('org/repo/test', 'org/repo', '', 'test'), ('repo', 'refused', '', ''), ('a/b/c/d', 'refused', '', '')) t(spec, repo, config, split)")
def hub_specs(spark: SparkSession, d: str) -> DataFrame:
    """What the names of hub datasets say; a name without a split stands for a repository with a single one."""
    found = []
    for spec in ("org/repo:conf", "org/repo:conf/train", "org/repo", "org/repo/test", "repo", "a/b/c/d"):
        try:
            h = readers.parse_hub_spec(spec)
            found.append((spec, h.repo, h.config or "", h.split or ""))
        except ValueError:
            found.append((spec, "refused", "", ""))
    return spark.createDataFrame(found, "spec string, repo string, config string, split string")


@query("""
    WITH n AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents)
    SELECT doc_id, CAST(n % 8 AS INT) AS rank, CAST(n // 8 // 32 AS BIGINT) AS batch FROM n""")
def rank_batches(spark: SparkSession, d: str) -> DataFrame:
    """Documents dealt to eight ranks in turn, in batches of 32."""
    return passages.rank_batches(table(spark, d, "documents").select("doc_id"), ["doc_id"], 8, 32)


@query(_WINDOWS.format(text=_ASSEMBLED.replace("coalesce(title, '') <> ''", "false"), ws=_WS, stride=90) + "SELECT CAST(row_number() OVER (ORDER BY doc_id, s) - 1 AS BIGINT) AS pid, doc_id || '_' || CAST(s // 90 AS VARCHAR) AS passage_id, CAST(least(180, len(t) - s) AS INT) AS n_tokens FROM w")
def streamed_passages(spark: SparkSession, d: str) -> DataFrame:
    """Documents as a stream: passages that arrived in one batch are numbered as those of a table, and their postings are appended."""
    from codelattice.streaming.passages import index_stream

    path, e = scratch_path(spark), HashEncoder()
    book = write_scratch(spark.createDataFrame([(i, [float(x) for x in e.vector(w)]) for i, w in enumerate(("the", "index", "query", "passage"))], "cid int, v array<float>"))
    docs = table(spark, d, "documents").select("doc_id", "text")
    docs.write.parquet(f"{path}/in")
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1_000_000).parquet(f"{path}/in")
    index_stream(stream, "doc_id", ["text"], book, e, f"{path}/ix", checkpoint=f"{path}/cp").awaitTermination()
    posts = spark.read.parquet(f"{path}/ix/postings").select("pid").distinct()
    return spark.read.parquet(f"{path}/ix/passages").join(posts, "pid", "left_semi").select("pid", "passage_id", "n_tokens")


# -- sinks


@query(_WINDOWS.format(text=_ASSEMBLED, ws=_WS, stride=90) + "SELECT CAST(row_number() OVER (ORDER BY doc_id, s) - 1 AS BIGINT) AS pid, doc_id || '_' || CAST(s // 90 AS VARCHAR) AS passage_id, array_to_string(list_slice(t, s + 1, s + 180), ' ') AS text FROM w")
def passage_files(spark: SparkSession, d: str) -> DataFrame:
    """Passages and mapping written in step, and both files read back."""
    cut, path = passages.passages(table(spark, d, "documents"), "doc_id", ["text"], title="title"), scratch_path(spark)
    sinks.write_passages(passages.dense_ids(cut, ["doc_id", "chunk_idx"]), path)
    tags = readers.read_mapping(spark, f"{path}/mapping", keep_chunk=True).withColumnRenamed("doc_id", "passage_id")
    return readers.read_passages(spark, f"{path}/collection_passages").join(tags, "pid").select("pid", "passage_id", "text")


@query("SELECT * FROM (VALUES (1, 'first', 'written'), (2, 'again', 'refused'), (3, 'overwrite', 'written')) t(n, attempt, outcome)")
def overwrite_guard(spark: SparkSession, d: str) -> DataFrame:
    rows, path, found = spark.createDataFrame([(0, 1, 1.0)], "pid long, cid int, w double"), scratch_path(spark), []
    for i, (name, over) in enumerate((("first", False), ("again", False), ("overwrite", True))):
        try:
            sinks.write_index(rows, path, weighted=True, overwrite=over)
            found.append((i + 1, name, "written"))
        except Exception as e:
            if "exists" not in str(e).lower():
                raise
            found.append((i + 1, name, "refused"))
    return spark.createDataFrame(found, "n int, attempt string, outcome string")


@query(f"WITH {_ASSIGNED}, p AS (SELECT DISTINCT pid, cid FROM a) SELECT pid, CASE WHEN pid % 3 = 0 THEN cid + 1 ELSE cid END AS cid, CAST(CASE WHEN pid % 3 = 0 THEN 2 ELSE 1 END AS DOUBLE) AS w FROM p")
def merged_shards(spark: SparkSession, d: str) -> DataFrame:
    """Of a passage in two shards the later shard's rows hold."""
    posts = write_scratch(indexing.postings(_assigned(spark, d)))
    again = posts.where("pid % 3 = 0").select("pid", (F.col("cid") + 1).alias("cid"), F.lit(2.0).alias("w"))
    return indexing.merge([posts, again]).select("pid", "cid", "w")


@query(f"""
    WITH {_ASSIGNED}, n AS (SELECT count(DISTINCT pid) AS docs, count(*) AS nnz FROM (SELECT DISTINCT pid, cid FROM a)), k AS (SELECT count(*) AS k FROM centroids)
    SELECT 1 AS stage, k AS n_centroids, -1 AS n_docs, -1 AS nnz, 'null' AS weighted FROM k UNION ALL SELECT 2, k, docs, -1, 'null' FROM k, n UNION ALL SELECT 3, k, docs, nnz, 'true' FROM k, n""")
def metadata_stages(spark: SparkSession, d: str) -> DataFrame:
    """What metadata.json says after each stage of a build."""
    posts, path, found = indexing.postings(_assigned(spark, d)), scratch_path(spark), []
    n = indexing.stats(posts, table(spark, d, "centroids").count()).first()
    for i, values in enumerate(({"n_centroids": n.n_centroids}, {"n_docs": n.n_docs}, {"nnz": n.nnz, "weighted": True})):
        sinks.write_metadata(spark, path, **values)
        m = sinks.read_metadata(spark, path)
        found.append((i + 1, m["n_centroids"], m["n_docs"], m["nnz"], json.dumps(m["weighted"])))
    return spark.createDataFrame(found, "stage int, n_centroids long, n_docs long, nnz long, weighted string")


@query(f"""
    WITH o AS (SELECT qid, did, max(s) AS s FROM ({_RUN_ROWS}) GROUP BY qid, did)
    SELECT qid, did AS doc_id, s AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY s DESC, did) AS rank FROM o) WHERE rank <= 50 AND NOT regexp_matches(qid || did, '\\s') AND qid <> '' AND did <> ''""")
def run_files(spark: SparkSession, d: str) -> DataFrame:
    """A run written by several tasks into files of its own, and read as one; scores keep all their digits."""
    rows, path = _run_rows(spark, d).groupBy("qid", "doc_id").agg(F.max("score").alias("score")), scratch_path(spark)
    sinks.write_run(rows, path, "made", topk=50)
    return readers.read_run(spark, path)


@query("SELECT * FROM (VALUES ('limit', '100'), ('metrics', '[\"P@5\"]'), ('nprobe', '8'), ('qrels', 'null'), ('topk', '1000'), ('use_forward_index', 'true')) t(name, value)")
def arguments_file(spark: SparkSession, d: str) -> DataFrame:
    """Arguments written as args.json, and read."""
    path = scratch_path(spark)
    sinks.write_arguments(spark, path, Searching(nprobe=8, metrics=["P@5"]))
    held = json.loads(sinks.read_text(spark, f"{path}/args.json"))
    shown = ("limit", "metrics", "nprobe", "qrels", "topk", "use_forward_index")
    return spark.createDataFrame([(n, json.dumps(held[n])) for n in shown], "name string, value string")


@query("SELECT * FROM (VALUES ('centroids', true), ('forward', true), ('inverted', true), ('metadata.json', true), ('args.json', true), ('postings', true), ('samples', false)) t(artifact, there)")
def build_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """An index of the test items from end to end: what a build leaves when it cleans up its samples."""
    from codelattice.plans.pipeline import run_indexing

    items, path = table(spark, d, "eval_items").where("length(trim(item_text)) > 0"), scratch_path(spark)
    rows = passages.dense_ids(items.select("item_id", _one_line("item_text").alias("text")), ["item_id"])
    rows.select(F.concat_ws("\t", F.col("pid").cast("string"), "text").alias("value")).write.text(f"{path}/c")
    rows.select(F.concat("pid", F.lit("\t"), "item_id", F.lit("_0")).alias("value")).write.text(f"{path}/m")
    run_indexing(spark, Indexing(index_dir=f"{path}/ix", collection=f"{path}/c", passage_mapping=f"{path}/m", n_centroids=16, max_steps=3, clean_up_samples=True))
    names = ("centroids", "forward", "inverted", "metadata.json", "args.json", "postings", "samples")
    return spark.createDataFrame([(n, sinks.exists(spark, f"{path}/ix/{n}")) for n in names], "artifact string, there boolean")


# -- encoders, sets of codes, planner, metrics

_VECTORS = "SELECT {key}, tok, list_transform(h, lambda x: CAST(x / sqrt(list_sum(list_transform(h, lambda y: y * y))) AS FLOAT)) AS v FROM (SELECT {key}, tok, list_transform(range(1, 33), lambda j: instr('0123456789abcdef', substr(md5(t), j, 1)) - 8.5) AS h FROM ({tokens}))"
_SHOWN = "SELECT {key}, CAST(tok AS INT) AS tok, round(CAST(v[1] AS DOUBLE), 6) AS v1, round(CAST(v[17] AS DOUBLE), 6) AS v17, round(CAST(v[32] AS DOUBLE), 6) AS v32 FROM ({vectors})"


def _shown(df: DataFrame, key: str) -> DataFrame:
    return df.select(key, "tok", *(F.round(F.col("v")[i - 1].cast("double"), 6).alias(f"v{i}") for i in (1, 17, 32)))


@query(_SHOWN.format(key="doc_id", vectors=_VECTORS.format(key="doc_id", tokens=f"SELECT doc_id, unnest(range(0, len(t))) AS tok, unnest(t) AS t FROM (SELECT doc_id, list_filter(string_split_regex({_ASSEMBLED}, '{_WS}'), lambda x: x <> '') AS t FROM documents)")))
def passage_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The token vectors of whole documents by the encoder that needs no model."""
    from codelattice.functions.text import assemble

    docs = table(spark, d, "documents").select("doc_id", assemble(F.col("title"), [F.col("text")]).alias("text"))
    return _shown(encode(docs, "doc_id", "text", HashEncoder()), "doc_id")


@query("WITH x AS (SELECT item_text AS text, row_number() OVER (ORDER BY item_text) - 1 AS rank FROM eval_items WHERE item_text IS NOT NULL), y AS (SELECT CAST(rank AS BIGINT) AS rank, text FROM x WHERE rank % greatest(1, (SELECT count(*) FROM x) // 64) = 0) "
       + _SHOWN.format(key="rank", vectors=_VECTORS.format(key="rank", tokens=f"SELECT rank, unnest(range(0, len(t))) AS tok, unnest(t) AS t FROM (SELECT rank, list_filter(string_split_regex(text, '{_WS}'), lambda x: x <> '') AS t FROM y)")))
def training_query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The token vectors of the training queries."""
    asked = indexing.training_queries(table(spark, d, "eval_items"), "item_text", 64).select(F.col("rank").cast("long").alias("rank"), "text")
    return _shown(encode(asked, "rank", "text", HashEncoder(), is_query=True), "rank")


@query(f"WITH {_ASSIGNED} SELECT DISTINCT pid, cid, CAST(1 AS DOUBLE) AS w FROM a")
def sets_of_codes(spark: SparkSession, d: str) -> DataFrame:
    """Passages given as sets of centroids become postings of weight 1."""
    return indexing.code_map(_assigned(spark, d).groupBy("pid").agg(F.collect_list("cid").alias("cids")))


_BOOL = "(VALUES (true), (false))"


@query(f"""
    WITH p AS (SELECT * FROM (VALUES ('build'), ('overwrite'), ('sampling_only'), ('merging_only'), ('retrain')) m(mode), {_BOOL} a(samples), {_BOOL} b(centroids), {_BOOL} c(metadata), {_BOOL} d(postings), {_BOOL} e(index)),
    k AS (SELECT *, mode = 'merging_only' AND metadata AS m, mode NOT IN ('sampling_only', 'retrain', 'overwrite') AND NOT (mode = 'merging_only' AND metadata) AND index AND metadata AS done, mode = 'merging_only' AND metadata AND NOT (centroids AND postings) AS bad FROM p)
    SELECT mode, samples, centroids, metadata, postings, index,
        CASE WHEN bad THEN 'refused' WHEN CASE WHEN mode IN ('sampling_only', 'retrain') THEN NOT samples WHEN m OR done THEN false ELSE NOT centroids AND NOT samples END THEN 'run' ELSE 'skip' END AS sampling,
        CASE WHEN bad THEN 'refused' WHEN CASE WHEN mode = 'retrain' THEN true WHEN mode = 'sampling_only' OR m OR done THEN false ELSE NOT centroids END THEN 'run' ELSE 'skip' END AS training,
        CASE WHEN bad THEN 'refused' WHEN CASE WHEN mode = 'retrain' THEN true WHEN mode = 'sampling_only' OR m OR done THEN false ELSE NOT centroids OR NOT postings END THEN 'run' ELSE 'skip' END AS encoding,
        CASE WHEN bad THEN 'refused' WHEN mode = 'sampling_only' OR done THEN 'skip' ELSE 'run' END AS merging FROM k""")
def stage_plans(spark: SparkSession, d: str) -> DataFrame:
    """Which stages run for every mode and everything that may be there already, or that a build is refused."""
    modes = {"build": {}, "overwrite": {"overwrite": True}, "sampling_only": {"do_sampling_only": True}, "merging_only": {"do_merging_only": True}, "retrain": {"retrain_centroids": True}}
    found = []
    for (mode, flags), there in product(modes.items(), product((True, False), repeat=5)):
        try:
            todo = tuple("run" if x else "skip" for x in asdict(plan(Indexing(n_centroids=4, **flags), Present(*there))).values())
        except ValueError:
            todo = ("refused",) * 4
        found.append((mode, *there, *todo))
    return spark.createDataFrame(found, "mode string, samples boolean, centroids boolean, metadata boolean, postings boolean, index boolean, sampling string, training string, encoding string, merging string")


@query("SELECT * FROM (VALUES ('nDCG@10', 'nDCG', 10), ('nDCG', 'nDCG', NULL), ('P@5', 'P', 5), ('R@1000', 'R', 1000), ('AP', 'AP', NULL), ('AP@100', 'AP', 100), ('RR', 'RR', NULL), ('Success@1', 'Success', 1), ('P', 'refused', NULL), ('Judged@10', 'refused', NULL)) t(name, kind, depth)")
def metric_names(spark: SparkSession, d: str) -> DataFrame:
    found = []
    for name in ("nDCG@10", "nDCG", "P@5", "R@1000", "AP", "AP@100", "RR", "Success@1", "P", "Judged@10"):
        try:
            found.append((name, *evaluation.parse_metric(name)))
        except ValueError:
            found.append((name, "refused", None))
    return spark.createDataFrame(found, "name string, kind string, depth int")


_MORE = """
    h AS (SELECT qid, rank, CASE WHEN rel >= 2 THEN 1 ELSE 0 END AS hit, sum(CASE WHEN rel >= 2 THEN 1 ELSE 0 END) OVER (PARTITION BY qid ORDER BY rank) AS hits FROM jd),
    z AS (SELECT asked.qid, coalesce(any_value(i.n), 0) AS n, coalesce(sum(hit * hits / CAST(h.rank AS DOUBLE)), 0) AS ap, coalesce(max(CASE WHEN hit = 1 THEN 1.0 / h.rank END), 0) AS rr, coalesce(max(CASE WHEN h.rank <= 3 THEN hit END), 0) AS success FROM asked LEFT JOIN h USING (qid) LEFT JOIN i USING (qid) GROUP BY asked.qid),
    m AS (SELECT qid, 'AP' AS metric, CASE WHEN n > 0 THEN ap / n ELSE 0 END AS value FROM z UNION ALL SELECT qid, 'RR', rr FROM z UNION ALL SELECT qid, 'Success@3', success FROM z)"""


@query(f"WITH {_stages(4)}, {_pooled('rr', 100)}, {_QRELS}, {_MORE} SELECT qid, metric, round(CAST(value AS DOUBLE), 6) AS value FROM m")
def metrics_of_rank(spark: SparkSession, d: str) -> DataFrame:
    """Average precision, reciprocal rank and success of each query."""
    f = Fixture(spark, d)
    run = write_scratch(f.run(nprobe=4, topk=20).select("qid", "doc_id", F.round("score", 6).alias("score")))
    return evaluation.per_query(run, f.qrels(), ("AP", "RR", "Success@3"), relevant=2).withColumn("value", F.round("value", 6))


# -- the three stages from end to end

_HASHED = "list_transform(range(1, 33), lambda j: instr('0123456789abcdef', substr(md5(t), j, 1)) - 8.5)"


@query(f"""
    WITH i AS (SELECT item_id, list_filter(string_split_regex(item_text, '{_WS}'), lambda x: x <> '') AS t FROM eval_items WHERE item_text IS NOT NULL),
    w AS (SELECT CAST(item_id AS VARCHAR) AS doc_id, t, unnest(range(0, len(t), 10)) AS s FROM i WHERE len(t) > 0),
    ps AS (SELECT row_number() OVER (ORDER BY doc_id, s) - 1 AS pid, doc_id, list_slice(t, s + 1, s + 20) AS t FROM w),
    every_word AS (SELECT DISTINCT unnest(t) AS t FROM i),
    words AS (SELECT row_number() OVER (ORDER BY md5(t), t) - 1 AS cid, t FROM every_word QUALIFY cid < 256),
    h AS (SELECT t, {_HASHED} AS h FROM every_word),
    tv AS MATERIALIZED (SELECT t, list_transform(h, lambda x: CAST(CAST(x / sqrt(list_sum(list_transform(h, lambda y: y * y))) AS FLOAT) AS DOUBLE)) AS v FROM h),
    c AS (SELECT cid, v FROM words JOIN tv USING (t)),
    sc AS MATERIALIZED (SELECT t, cid, round(list_dot_product(tv.v, c.v), 9) AS s, list_dot_product(tv.v, tv.v) AS vv FROM tv CROSS JOIN c),
    best AS (SELECT t, cid, vv - s + 1 AS w FROM sc QUALIFY row_number() OVER (PARTITION BY t ORDER BY s DESC, cid) = 1),
    fwd AS MATERIALIZED (SELECT pid, cid, max(greatest(w, -1.0)) AS w FROM (SELECT pid, unnest(t) AS t FROM ps) JOIN best USING (t) GROUP BY pid, cid),
    q AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS qid, unnest(range(0, len(t))) AS tok, unnest(t) AS t FROM i),
    cs AS MATERIALIZED (SELECT qid, tok, cid, s FROM q JOIN sc USING (t)),
    qc AS (SELECT * FROM cs QUALIFY row_number() OVER (PARTITION BY qid, tok ORDER BY s DESC, cid) <= 2),
    tm AS (SELECT qid, tok, pid, CASE WHEN count(*) = 2 THEN max(w * s) ELSE greatest(max(w * s), 0.0) END AS m FROM qc JOIN fwd USING (cid) GROUP BY qid, tok, pid),
    st1 AS (SELECT qid, pid, sum(m) AS sc FROM tm GROUP BY qid, pid),
    every AS (SELECT qs.qid, ps.pid, coalesce(sc, 0) AS sc FROM (SELECT DISTINCT qid FROM q) qs CROSS JOIN ps LEFT JOIN st1 ON st1.qid = qs.qid AND st1.pid = ps.pid),
    top AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(sc, 9) DESC, pid) <= 15),
    rr AS (SELECT qid, pid, sum(m) AS sc FROM (SELECT qid, pid, tok, max(s) AS m FROM top JOIN fwd USING (pid) JOIN cs USING (qid, cid) GROUP BY qid, pid, tok) GROUP BY qid, pid),
    mp AS (SELECT qid, doc_id, max(sc) AS score FROM rr JOIN ps USING (pid) GROUP BY qid, doc_id)
    SELECT qid, doc_id, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM mp) WHERE rank <= 5""")
def whole_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Test items as JSON lines, cut into passages, indexed with a codebook of the vectors of 256 of their words, and searched for themselves, through the three stages."""
    from codelattice.plans.arguments import Passaging
    from codelattice.plans.pipeline import run_indexing, run_passaging, run_searching

    items, path, e = table(spark, d, "eval_items"), scratch_path(spark), HashEncoder()
    items.select(F.to_json(F.struct(F.col("item_id").cast("string").alias("id"), F.col("item_text").alias("text"))).alias("value")).write.text(f"{path}/docs")
    words = items.select(F.explode(tokens(F.col("item_text"))).alias("t")).distinct().orderBy(F.md5("t"), "t").limit(256).collect()
    spark.createDataFrame([(i, [float(x) for x in e.vector(r.t)]) for i, r in enumerate(words)], "cid int, v array<float>").write.parquet(f"{path}/book")
    asked = items.where(F.trim(_one_line("item_text")) != "").select(F.concat_ws("\t", F.col("item_id").cast("string"), F.trim(_one_line("item_text"))).alias("value"))
    asked.write.text(f"{path}/queries")
    run_passaging(spark, Passaging(corpus=[f"{path}/docs"], output=f"{path}/out", length=20, stride=10))
    run_indexing(spark, Indexing(index_dir=f"{path}/ix", centroids=f"{path}/book", n_centroids=len(words), collection=f"{path}/out/collection_passages", passage_mapping=f"{path}/out/mapping", with_weighted_assignments=True))
    run, _ = run_searching(spark, Searching(index_dir=f"{path}/ix", queries=f"{path}/queries", nprobe=2, topk=15, limit=5))
    return run.select("qid", "doc_id", F.round("score", 6).alias("score"), "rank")
