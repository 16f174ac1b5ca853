"""The three stages end to end: passaging, indexing, searching."""

from __future__ import annotations

import json
import time

from pyspark.sql import DataFrame, SparkSession

from codelattice.functions.encoders import FileTokenizer, HashEncoder, TokenEncoder, encode
from codelattice.operators import codebook, evaluation, indexing, passages, searching
from codelattice.operators.vectors import Codebook, matrix
from codelattice.plans.arguments import Indexing, Passaging, Searching, Sweep
from codelattice.plans.planner import Present, Stages, number_of_centroids, plan
from codelattice.session import write_scratch
from codelattice.sources import readers, sinks


def run_passaging(spark: SparkSession, a: Passaging, tokenizer: passages.Tokenizer | None = None) -> DataFrame:
    schema = ", ".join(f"`{n}` string" for n in dict.fromkeys([a.docid_field, a.title_field, *a.body_fields]))
    docs = readers.read_documents(spark, a.corpus, schema)
    if tokenizer is None and a.tokenizer:
        own = FileTokenizer(a.tokenizer)
        tokenizer = own.encode, own.decode
    cut = passages.passages(docs, a.docid_field, a.body_fields, title=a.title_field, length=a.length, stride=a.stride, lower=a.lower, tokenizer=tokenizer)
    sinks.write_passages(passages.dense_ids(cut, ["doc_id", "chunk_idx"]), a.output, overwrite=a.overwrite)
    return spark.read.parquet(f"{a.output}/passages")


def collection(spark: SparkSession, a) -> DataFrame:
    """(pid, text): tab-separated with a mapping, JSON lines without."""
    if a.passage_mapping:
        return readers.read_passages(spark, a.collection)
    return readers.read_collection(spark, [a.collection], a.id_field, tuple(a.text_fields))


def present(spark: SparkSession, path: str) -> Present:
    done = {n: sinks.exists(spark, f"{path}/{n}/_SUCCESS") for n in ("samples", "centroids", "postings", "forward", "inverted")}
    meta = sinks.read_metadata(spark, path)
    return Present(done["samples"], done["centroids"], meta is not None, done["postings"], done["forward"] and done["inverted"] and bool(meta) and meta["nnz"] >= 0)


def run_indexing(spark: SparkSession, a: Indexing, encoder: TokenEncoder | None = None) -> Stages:
    """Each stage writes one table; what is complete is not made again. Returns which stages ran."""
    encoder, path = encoder or HashEncoder(), a.index_dir
    centroids = a.centroids or f"{path}/centroids"
    there = present(spark, path)
    if a.centroids and sinks.exists(spark, f"{centroids}/_SUCCESS"):
        there = Present(there.samples, True, there.metadata, there.postings, there.index)
    if (there.index or there.postings) and not (a.overwrite or a.resume or a.retrain_centroids or a.do_merging_only):
        raise FileExistsError(f"{path} holds an index: resume or overwrite")
    todo = plan(a, there)
    sinks.write_arguments(spark, path, a)
    docs = collection(spark, a)
    if todo.sampling:
        n = indexing.sample_size(readers.count_rows(docs, a.n_passages), a.assumed_doclen, a.n_sample_embeddings)
        some = indexing.sample_exactly(docs, "pid", n, a.seed)
        encode(some, "pid", "text", encoder).write.mode("overwrite").parquet(f"{path}/samples")
    if todo.training:
        start = spark.read.parquet(a.init_centroids) if a.init_centroids else None
        k = number_of_centroids(a, start.count() if start is not None else None)
        asked = None
        if a.training_queries:
            texts = indexing.training_queries(readers.read_queries(spark, a.training_queries), "text", a.max_n_queries)
            asked = matrix(encode(texts, "rank", "text", encoder, is_query=True).select("v").toArrow()["v"])
        # the weighted loss needs as many queries as vectors: those of the batch
        o = codebook.Objective(a.with_weighted_assignments and asked is None, a.use_soft_assignment, a.max_difference_objective, a.with_kmeans_objective, a.entropy_regularization, a.initial_temperature, a.final_temperature, a.temperature_anneal_steps)
        samples = readers.read_samples(spark, a.training_embedding_samples or f"{path}/samples")
        initial = matrix(start.orderBy("cid").select("v").toArrow()["v"]) if start is not None else None
        book = codebook.train_codebook(
            samples, k, most=a.driver_rows, objective=o, queries=asked, initial=initial, steps=a.max_steps, batch=a.per_device_train_batch_size, rate=a.learning_rate, decay=a.weight_decay, clip=a.max_grad_norm, warmup=a.warmup_steps,
            restart=a.reinit_centroids_at_end_of_epoch, most_queries=a.max_n_queries, seed=a.seed, resume=codebook.load_state(spark, f"{path}/training") if a.resume else None, save=lambda state: codebook.save_state(spark, f"{path}/training", state), save_steps=a.save_steps,
        )
        book.write.mode("overwrite").parquet(centroids)
        sinks.delete(spark, f"{path}/training")
        if a.clean_up_samples:
            sinks.delete(spark, f"{path}/samples")
    if todo.encoding:
        book = Codebook(readers.read_centroids(spark, centroids))
        sinks.write_metadata(spark, path, n_centroids=book.rows, centroids=centroids, collection=a.collection, passage_mapping=a.passage_mapping, colbert_checkpoint=a.colbert_checkpoint)
        assigned = indexing.assignments(encode(docs, "pid", "text", encoder), book, ["pid", "tok"])
        indexing.postings(assigned, weighted=a.with_weighted_assignments).write.mode("overwrite").parquet(f"{path}/postings")
    if todo.merging:
        posts, k = readers.read_postings(spark, f"{path}/postings"), spark.read.parquet(centroids).count()
        indexing.check_range(posts, k)
        sinks.write_index(posts, path, weighted=a.with_weighted_assignments, overwrite=True)
        n_docs = readers.count_rows(docs, a.n_passages)
        sinks.write_metadata(spark, path, n_docs=n_docs, nnz=posts.count(), total_shards=len(spark.read.parquet(f"{path}/forward").inputFiles()), weighted=a.with_weighted_assignments)
    return todo


class Index:
    """An index that was built, opened for searches: the codebook is fetched once, the postings are read in both layouts."""

    def __init__(self, spark: SparkSession, a: Searching | Sweep):
        meta = sinks.read_metadata(spark, a.index_dir)
        if meta is None:
            raise FileNotFoundError(f"no index in {a.index_dir}")
        self.n_docs, self.book = meta["n_docs"], Codebook(readers.read_centroids(spark, a.centroids or meta["centroids"]))
        self.inverted, self.forward = (readers.read_postings(spark, f"{a.index_dir}/{layout}") for layout in ("inverted", "forward"))
        if getattr(a, "load_full_index_to_memory", False):
            self.inverted, self.forward = self.inverted.cache(), self.forward.cache()
        where = a.passage_mapping or meta["passage_mapping"]
        self.mapping = readers.read_mapping(spark, where) if where else None

    def search(self, queries: DataFrame, *, nprobe: int, topk: int, use_forward: bool, limit: int) -> DataFrame:
        return searching.search(queries, self.book, self.inverted, self.n_docs, self.mapping, nprobe=nprobe, topk=topk, use_forward=use_forward, limit=limit, forward_posts=self.forward)


def run_searching(spark: SparkSession, a: Searching, encoder: TokenEncoder | None = None) -> tuple[DataFrame, DataFrame | None]:
    """The run (qid, doc_id, score, rank), and the mean metrics if there are judgements. Passage ids are 0 .. n_docs-1."""
    index = Index(spark, a)
    queries = write_scratch(encode(readers.read_queries(spark, a.queries), "qid", "text", encoder or HashEncoder(), is_query=True))
    run = index.search(queries, nprobe=a.nprobe, topk=a.topk, use_forward=a.use_forward_index, limit=a.limit)
    if a.search_output:
        sinks.write_run(run, a.search_output, a.run_id, topk=a.topk, overwrite=True)
        run = readers.read_run(spark, a.search_output)
    scores = evaluation.mean_metrics(run.select("qid", "doc_id", "score"), readers.read_qrels(spark, a.qrels), tuple(a.metrics)).orderBy("metric") if a.qrels else None
    return run, scores


def run_sweep(spark: SparkSession, a: Sweep, encoder: TokenEncoder | None = None) -> list[dict]:
    """For each number of probes, with and without the rerank: seconds, queries a second, rows, and the mean metrics if there are judgements."""
    index = Index(spark, a)
    queries = write_scratch(encode(readers.read_queries(spark, a.queries), "qid", "text", encoder or HashEncoder(), is_query=True))
    n, found = queries.select("qid").distinct().count(), []
    qrels = readers.read_qrels(spark, a.qrels) if a.qrels else None
    for nprobe in a.nprobes:
        for rerank in (False, True):
            began = time.time()
            run = write_scratch(index.search(queries, nprobe=nprobe, topk=a.topk, use_forward=rerank, limit=a.limit))
            took = time.time() - began
            row = {"nprobe": nprobe, "rerank": rerank, "seconds": round(took, 3), "queries_per_second": round(n / took, 3), "rows": run.count()}
            if qrels is not None:
                row |= {r.metric: r.value for r in evaluation.mean_metrics(run.select("qid", "doc_id", "score"), qrels, tuple(a.metrics)).collect()}  # a row for each metric
            found.append(row)
    if a.output:
        sinks.write_text(spark, a.output, json.dumps(found, indent=2))
    return found
