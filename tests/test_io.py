import gzip
import json
import pickle
import sys

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from codelattice.operators import codebook, evaluation
from codelattice.operators.components import connected_components
from codelattice.plans.arguments import Indexing, Passaging, Searching, Sweep, parse
from codelattice.plans.pipeline import run_indexing, run_passaging, run_searching, run_sweep
from codelattice.plans.planner import Present, Stages, number_of_centroids, plan
from codelattice.session import write_scratch
from codelattice.sources import readers, sinks

from .helpers import rows


def test_json_lines_plain_and_gzipped_with_broken_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "1", "text": "x"}\nbroken\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"id": "2", "text": "y"}\n{"id":\n')
    got = readers.read_documents(spark, [str(tmp_path / "*.jsonl*")], "id string, text string")
    assert rows(got.where("id is not null")) == {("1", "x"), ("2", "y")}
    assert readers.malformed_lines(spark, [str(tmp_path / "*.jsonl*")]) == 2


def test_sources(spark):
    readers.register_source("made", lambda s, name: s.createDataFrame([(name,)], "id string"))
    assert rows(readers.read_documents(spark, ["made:up"], "id string")) == {("up",)}
    with pytest.raises(ValueError, match="exactly one"):
        readers.read_documents(spark, ["made:a", "made:b"], "id string")
    assert readers.parse_hub_spec("org/repo:conf/train") == readers.HubSpec("org/repo", "conf", "train")
    assert readers.parse_hub_spec("org/repo:conf") == readers.HubSpec("org/repo", "conf", None)
    with pytest.raises(ValueError, match="slashes"):
        readers.parse_hub_spec("repo")


class Made:
    """Stands for the libraries of public collections, which aren't here."""

    def __init__(self, **parts):
        self.__dict__ |= parts


def test_collections_of_libraries(spark, monkeypatch):
    from collections import namedtuple

    doc, query, judged = namedtuple("D", "doc_id title text"), namedtuple("Q", "query_id text"), namedtuple("J", "query_id doc_id relevance")
    docs = [doc(f"d{i}", None if i % 2 else "t", f"text {i}") for i in range(7)]
    one = Made(docs_iter=lambda: iter(docs), queries_iter=lambda: iter([query("1", "a b")]), qrels_iter=lambda: iter([judged("1", "d3", 2)]))
    monkeypatch.setitem(sys.modules, "ir_datasets", Made(load=lambda name: one))
    got = readers.read_documents(spark, ["irds:made/up"], "ignored string")
    assert rows(got.select("doc_id", "title", "text")) == {tuple(d) for d in docs}
    assert rows(readers.read_queries(spark, "irds:made/up")) == {("1", "a b")} and rows(readers.read_qrels(spark, "irds:made/up")) == {("1", "d3", 2)}
    asked = []
    splits = {"org/one": ["train"], "org/two": ["train", "test"]}
    library = Made(get_dataset_split_names=lambda repo, config: splits[repo], load_dataset=lambda repo, config, split, streaming: asked.append((repo, config, split)) or iter([{"id": "1", "text": "x"}]))
    monkeypatch.setitem(sys.modules, "datasets", library)
    assert rows(readers.read_documents(spark, ["hfds:org/one:conf"], "")) == {("1", "x")}
    assert rows(readers.read_documents(spark, ["hfds:org/two:conf/test"], "")) == {("1", "x")}
    assert asked == [("org/one", "conf", "train"), ("org/two", "conf", "test")]
    with pytest.raises(ValueError, match="name one"):
        readers.read_documents(spark, ["hfds:org/two:conf"], "")
    monkeypatch.setitem(sys.modules, "datasets", None)
    with pytest.raises(ImportError, match="needs the package"):
        readers.read_documents(spark, ["hfds:org/one:conf"], "")


def test_the_last_line_of_the_last_file_holds(spark, tmp_path):
    for name, text in (("b.tsv", "x\t3\ny\t4\nx\t5\n"), ("a.tsv", "x\t1\nz\t2\n" * 50)):
        (tmp_path / name).write_text(text)
    assert rows(readers.read_queries(spark, str(tmp_path / "*.tsv"))) == {("x", "5"), ("y", "4"), ("z", "2")}


def test_a_row_without_an_id_raises(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"id": "1", "text": "x"}\n{"text": "y"}\n')
    with pytest.raises(Exception, match="has no id"):
        readers.read_collection(spark, [str(tmp_path / "c.jsonl")]).collect()


def test_encoders(spark, monkeypatch):
    from codelattice.functions.encoders import FileTokenizer, OnnxEncoder
    from codelattice.operators.passages import passages

    t = FileTokenizer("/opt/tokenizers/byte_bpe_50k.json")
    docs = spark.createDataFrame([("a", "one two three four five")], "id string, text string")
    got = passages(docs, "id", ["text"], length=3, stride=3, tokenizer=(t.encode, t.decode)).orderBy("chunk_idx").collect()
    assert "".join(r.text for r in got) == "one two three four five" and [r.n_tokens for r in got][0] == 3

    class Session:
        def __init__(self, path):
            self.path = path

        def run(self, _, given):
            ids, mask = given["input_ids"], given["attention_mask"]
            return [np.stack([ids, mask, ids * 0 + 2], -1).astype(np.float32)]

    monkeypatch.setitem(sys.modules, "onnxruntime", Made(InferenceSession=Session))
    e = OnnxEncoder("model.onnx", t.path, length=4, query_length=6, fill=0, normalise=False)
    a, b = e.encode(["one two three four five six", "x"])
    assert a.shape == (4, 3) and b.shape[0] == 1 and (a[:, 0] == t.encode(["one two three four five six"])[0][:4]).all()
    assert e.encode(["x"], is_query=True)[0].shape == (6, 3) and pickle.loads(pickle.dumps(e))._open is None
    assert np.allclose(np.linalg.norm(OnnxEncoder("m", t.path).encode(["a b"])[0], axis=1), 1)


def test_quotes_are_ordinary_and_the_last_query_holds(spark, tmp_path):
    (tmp_path / "p.tsv").write_text('0\t"quoted\ttitle\n1\tit\'s\n')
    assert rows(readers.read_passages(spark, str(tmp_path / "p.tsv"))) == {(0, '"quoted'), (1, "it's")}
    (tmp_path / "q.tsv").write_text("a\tfirst\nb\tother\na\tlast\n")
    assert rows(readers.read_queries(spark, str(tmp_path / "q.tsv"))) == {("a", "last"), ("b", "other")}
    (tmp_path / "m.tsv").write_text("0\td_1_0\n1\tnone\n")
    assert rows(readers.read_mapping(spark, str(tmp_path / "m.tsv"))) == {(0, "d_1"), (1, "")}
    assert rows(readers.read_mapping(spark, str(tmp_path / "m.tsv"), keep_chunk=True)) == {(0, "d_1_0"), (1, "none")}


def test_unweighted_postings_read_as_one(spark, tmp_path):
    p = spark.createDataFrame([(0, 1, 0.5)], "pid long, cid int, w double")
    sinks.write_index(p, str(tmp_path / "i"), weighted=False)
    assert rows(readers.read_postings(spark, str(tmp_path / "i" / "forward"))) == {(0, 1, 1.0)}
    with pytest.raises(Exception, match="exists"):
        sinks.write_index(p, str(tmp_path / "i"), weighted=False)


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.tuples(st.sampled_from("ab"), st.sampled_from(["d1", "d2", "d3"])), st.integers(-5, 5), min_size=1))
def test_runs_survive_their_file(spark, run):
    df = spark.createDataFrame([(q, d, float(s)) for (q, d), s in run.items()], "qid string, doc_id string, score double")
    assert rows(evaluation.parse_run(evaluation.run_lines(df, "r"))) == rows(df)


def test_metrics_by_hand(spark):
    run = spark.createDataFrame([("q", "a", 3.0), ("q", "b", 2.0), ("q", "c", 2.0), ("x", "a", 1.0)], "qid string, doc_id string, score double")
    qrels = spark.createDataFrame([("q", "b", 1), ("q", "z", 1), ("y", "a", 1)], "qid string, doc_id string, relevance int")
    got = {(r.qid, r.metric): round(r.value, 6) for r in evaluation.per_query(run, qrels, ("nDCG@10", "P@1", "P@3", "R@3", "AP", "RR", "Success@3")).collect()}
    # of the equal scores c goes first: b is third
    want = {"nDCG@10": round(0.5 / (1 + 1 / 1.584962500721156), 6), "P@1": 0.0, "P@3": round(1 / 3, 6), "R@3": 0.5, "AP": round(1 / 6, 6), "RR": round(1 / 3, 6), "Success@3": 1.0}
    assert got == {("q", m): v for m, v in want.items()} | {("y", m): 0.0 for m in want}
    with pytest.raises(ValueError, match="metric"):
        evaluation.parse_metric("P")


def test_planner():
    a = Indexing(n_centroids=4)
    assert plan(a, Present()) == Stages(True, True, True, True)
    assert plan(a, Present(samples=True)) == Stages(False, True, True, True)
    assert plan(a, Present(True, True, True, True, True)) == Stages(False, False, False, False)
    assert plan(a, Present(True, True, True, True)) == Stages(False, False, False, True)
    assert plan(Indexing(do_sampling_only=True), Present(samples=True)) == Stages(False, False, False, False)
    assert plan(Indexing(do_sampling_only=True, overwrite_encoded_samples=True), Present(samples=True)) == Stages(True, False, False, False)
    assert plan(Indexing(retrain_centroids=True), Present(True, True, True, True, True)) == Stages(False, True, True, True)
    assert plan(Indexing(do_merging_only=True), Present(True, True, True, True)) == Stages(False, False, False, True)
    with pytest.raises(ValueError, match="needs"):
        plan(Indexing(do_merging_only=True), Present(metadata=True))
    with pytest.raises(ValueError, match="exclude each other"):
        Indexing(resume=True, retrain_centroids=True)
    assert number_of_centroids(Indexing(), 9) == 9
    with pytest.raises(ValueError, match="n_centroids"):
        number_of_centroids(Indexing(), None)


def test_arguments(tmp_path):
    a = parse(Searching, ["--nprobe", "4", "--metrics", "P@1", "AP", "--use_forward_index", "false"])
    assert a.nprobe == 4 and a.metrics == ["P@1", "AP"] and not a.use_forward_index and a.topk == 1000
    (tmp_path / "a.json").write_text(json.dumps({"corpus": ["x"], "stride": 5}))
    assert parse(Passaging, [str(tmp_path / "a.json")]).stride == 5


def test_the_three_stages(spark, tmp_path):
    words = ["alpha beta gamma delta", "beta beta epsilon", "zeta eta theta iota kappa", "alpha zeta"]
    (tmp_path / "docs.jsonl").write_text("".join(json.dumps({"id": f"d_{i}", "title": "", "text": w}) + "\n" for i, w in enumerate(words)))
    out = str(tmp_path / "out")
    got = run_passaging(spark, Passaging(corpus=[str(tmp_path / "docs.jsonl")], output=out, length=3, stride=2))
    assert rows(got.select("pid", "passage_id")) == {(i, p) for i, p in enumerate(["d_0_0", "d_0_1", "d_1_0", "d_1_1", "d_2_0", "d_2_1", "d_2_2", "d_3_0"])}
    index = str(tmp_path / "index")
    a = Indexing(index_dir=index, collection=f"{out}/collection_passages", passage_mapping=f"{out}/mapping", n_centroids=11, max_steps=50, with_weighted_assignments=True)
    assert run_indexing(spark, a) == Stages(True, True, True, True)
    meta = sinks.read_metadata(spark, index)
    assert meta["n_docs"] == 8 and meta["n_centroids"] == 11 and meta["nnz"] > 8 and meta["weighted"]
    assert run_indexing(spark, Indexing(**{**a.__dict__, "resume": True})) == Stages(False, False, False, False)
    with pytest.raises(FileExistsError):
        run_indexing(spark, a)
    (tmp_path / "q.tsv").write_text("q1\tepsilon beta\nq2\tkappa iota\n")
    (tmp_path / "qrels").write_text("q1 0 d_1 1\nq2 0 d_2 1\n")
    run, scores = run_searching(spark, Searching(index_dir=index, queries=str(tmp_path / "q.tsv"), qrels=str(tmp_path / "qrels"), nprobe=2, topk=5, metrics=["Success@1", "nDCG@10"], search_output=str(tmp_path / "run")))
    assert {r.qid for r in run.collect()} == {"q1", "q2"}
    assert {r.metric: r.value for r in scores.collect()}["nDCG@10"] > 0.6
    swept = run_sweep(spark, Sweep(index_dir=index, queries=str(tmp_path / "q.tsv"), qrels=str(tmp_path / "qrels"), nprobes=[1, 2], topk=5, metrics=["nDCG@10"], output=str(tmp_path / "sweep.json")))
    assert [(r["nprobe"], r["rerank"]) for r in swept] == [(1, False), (1, True), (2, False), (2, True)] and json.loads((tmp_path / "sweep.json").read_text()) == swept
    assert swept[3]["nDCG@10"] == {r.metric: r.value for r in scores.collect()}["nDCG@10"]


def test_training_goes_on_from_its_checkpoint(spark, tmp_path):
    (tmp_path / "c.tsv").write_text("".join(f"{i}\tw{i % 7} w{i % 5} w{i % 3}\n" for i in range(60)))
    (tmp_path / "m.tsv").write_text("".join(f"{i}\td{i}_0\n" for i in range(60)))
    a = Indexing(index_dir=str(tmp_path / "a"), collection=str(tmp_path / "c.tsv"), passage_mapping=str(tmp_path / "m.tsv"), n_centroids=5, max_steps=12, save_steps=5, per_device_train_batch_size=32, warmup_steps=2, do_encoding=False, do_merging=False)
    run_indexing(spark, a)
    whole = rows(spark.read.parquet(str(tmp_path / "a" / "centroids")).selectExpr("cid", "cast(v as string)"))
    assert not (tmp_path / "a" / "training" / "checkpoint.txt").exists()
    b = Indexing(**{**a.__dict__, "index_dir": str(tmp_path / "b"), "training_embedding_samples": [str(tmp_path / "a" / "samples")]})
    saved = codebook.save_state

    def stop(*x):
        saved(*x)
        raise InterruptedError

    codebook.save_state = stop
    try:
        with pytest.raises(InterruptedError):
            run_indexing(spark, b)
    finally:
        codebook.save_state = saved
    run_indexing(spark, Indexing(**{**b.__dict__, "resume": True}))
    assert rows(spark.read.parquet(str(tmp_path / "b" / "centroids")).selectExpr("cid", "cast(v as string)")) == whole


def test_stream(spark, tmp_path):
    from codelattice.functions.encoders import HashEncoder
    from codelattice.streaming.passages import index_stream

    (tmp_path / "in").mkdir()
    e = HashEncoder()
    book = write_scratch(spark.createDataFrame([(i, [float(x) for x in e.vector(w)]) for i, w in enumerate(["a", "b", "c"])], "cid int, v array<float>"))

    def arrive(name, docs):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"id": k, "text": t}) + "\n" for k, t in docs))
        stream = spark.readStream.schema("id string, text string").json(str(tmp_path / "in"))
        index_stream(stream, "id", ["text"], book, e, str(tmp_path / "ix"), checkpoint=str(tmp_path / "cp"), length=2, stride=2).awaitTermination()

    arrive("1.json", [("x", "a b c")])
    arrive("2.json", [("y", "c c")])
    got = spark.read.parquet(str(tmp_path / "ix" / "passages"))
    assert rows(got.select("pid", "passage_id")) == {(0, "x_0"), (1, "x_1"), (2, "y_0")}
    posts = spark.read.parquet(str(tmp_path / "ix" / "postings"))
    assert rows(posts.select("pid", "cid")) == {(0, 0), (0, 1), (1, 2), (2, 2)}


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), (None, 1), (9, 10), (10, 11), (11, 12), (12, 13), (13, 9)], "a long, b long")
    assert rows(connected_components(edges, "a", "b")) == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), *((i, 9) for i in range(9, 14))}
    assert rows(connected_components(edges.limit(0), "a", "b")) == set()


class Bounded:
    """Refuses more than it should be given at once."""

    def encode(self, texts, *, is_query=False):
        from codelattice.functions.encoders import CHARACTERS, HashEncoder

        assert len(texts) == 1 or len(texts) <= 256 and sum(map(len, texts)) <= CHARACTERS
        return HashEncoder().encode(texts, is_query=is_query)


def test_texts_are_encoded_in_parts_of_bounded_size(spark):
    from codelattice.functions.encoders import HashEncoder, encode

    data = [(i, " ".join(f"w{(i * j) % 97}" for j in range(i % 60))) for i in range(2_000)] + [(5_000, None), (5_001, "long " * 40_000), (5_002, "")]
    got = encode(spark.createDataFrame(data, "k long, text string").coalesce(1), "k", "text", Bounded())
    assert got.count() == got.select("k", "tok").distinct().count() == sum(len(t.split()) for _, t in data if t)
    e, of = HashEncoder(), dict(data)
    for r in got.where("k % 400 = 59 or (k = 5001 and tok > 39990)").collect():
        assert r.v == [float(x) for x in e.vector(of[r.k].split()[r.tok]).astype("float32")]
