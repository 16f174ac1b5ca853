import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from codelattice.functions.text import docid_of, strip_newlines
from codelattice.operators.passages import dense_ids, passages

from .helpers import rows


def test_white_space_as_python_has_it(spark):
    texts = ["a\x0bb", "a  b", "a\r\n\tb", " a ", "\x1ca\x85b", "", "plain"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", strip_newlines(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == {i: re.sub(r"\s+", " ", t) for i, t in enumerate(texts)}


def test_tags(spark):
    tags = ["a_b_1", "abc", "x_0", "_3", "a__2", "12_x", "a_\n_1"]
    got = spark.createDataFrame([(t,) for t in tags], "t string").select("t", docid_of(F.col("t"))).collect()
    assert {r[0]: r[1] for r in got} == {t: "_".join(t.split("_")[:-1]) for t in tags}


def windows(n, length, stride):
    return [(s, min(s + length, n)) for s in range(0, n, stride)]


@pytest.mark.parametrize(("length", "stride"), [(180, 90), (512, 512), (4, 7)])
def test_windows(spark, length, stride):
    sizes = [0, 1, 89, 90, 91, 179, 180, 181, 400]
    docs = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in sizes], "id int, text string")
    got = {(r.doc_id, r.chunk_idx, r.text) for r in passages(docs, "id", ["text"], length=length, stride=stride).collect()}
    assert got == {(str(n), k, " ".join(f"w{i}" for i in range(a, b))) for n in sizes for k, (a, b) in enumerate(windows(n, length, stride))}


def test_another_tokenizer_gives_the_same_windows(spark):
    docs = spark.createDataFrame([("a", "x y z", "t"), ("b", None, ""), ("c", "u v", None)], "id string, text string, title string")
    split = (lambda texts: [t.split() for t in texts], " ".join)
    cut = [rows(passages(docs, "id", ["text"], title="title", length=2, stride=1, tokenizer=t).select("passage_id", "n_tokens", "text")) for t in (None, split)]
    assert cut[0] == cut[1] and ("a_0", 2, "t x") in cut[0] and not any(p.startswith("b") for p, _, _ in cut[0])


def test_windows_refuse_a_stride_of_zero(spark):
    with pytest.raises(ValueError, match="at least 1"):
        passages(spark.createDataFrame([("a", "x")], "id string, text string"), "id", ["text"], stride=0)


def test_dense_ids_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(5)
    assert rows(dense_ids(df, ["x"])) == {(i, i) for i in range(1000)}
    assert rows(dense_ids(df.limit(0), ["x"])) == set()


@settings(max_examples=30, deadline=None)
@given(st.integers(0, 300), st.integers(1, 50), st.integers(1, 50))
def test_windows_cover_when_stride_is_at_most_length(n, length, stride):
    covered = {i for a, b in windows(n, length, stride) for i in range(a, b)}
    assert stride > length or covered == set(range(n))
