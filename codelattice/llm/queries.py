"""The queries of the training-data operators, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelattice.session import ship, table

Query = Callable[[SparkSession, str], DataFrame]


def _passage_links(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    from codelattice.llm.neardup import near_duplicates

    return near_duplicates(table(spark, d, "collection_passages"), "pid", "passage_text", threshold=(3, 5), width=3)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    from codelattice.llm.neardup import pairs_of_keys

    return pairs_of_keys(*_passage_links(spark, d), "pid")


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    """One row for each pid: its class of equal passages, that class's links, and the group of linked classes."""
    from codelattice.llm.neardup import classes

    return classes(*_passage_links(spark, d), "pid")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    from codelattice.llm.splitter import traced_pieces

    pieces = traced_pieces(table(spark, d, "collection_passages"), table(spark, d, "passage_mapping"), with_text=False)
    return pieces.select("pid", "piece_no", "docid", "first_word", "last_word")


def p2_balanced(spark: SparkSession, d: str) -> DataFrame:
    """The same passages cut so that the sum of cut penalties and size imbalance is least."""
    from codelattice.llm.splitter import split_oversized

    return split_oversized(table(spark, d, "collection_passages"), "pid", "passage_text", penalties=(0.0, 0.2, 1.0))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    from codelattice.llm.knn import nearest

    found = nearest(table(spark, d, "training_embedding_samples"), "sample_id", "v", queries=table(spark, d, "centroids"))
    return found.select("kind", "owner_id", "neighbour_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    from codelattice.llm.topn import top_n

    return top_n(table(spark, d, "trec_run"), "qid", "did", "s", 10).select("qid", "did")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    from codelattice.llm.mixture import clusters

    return clusters(table(spark, d, "training_embedding_samples"), "sample_id", "v").select("cluster_first_id", "sample_id", "typical_id")


def p5_mixture(spark: SparkSession, d: str) -> DataFrame:
    """The vectors of each index in as many groups as the latest row of its metadata says, with sizes and most typical members."""
    from codelattice.llm.mixture import mixture_groups
    from codelattice.sources.readers import last_wins

    held = last_wins(table(spark, d, "index_metadata").where("index_id is not null"), "index_id", "written_at")
    numbers = {r.index_id: r.n_centroids for r in held.select("index_id", "n_centroids").collect() if r.n_centroids}  # a row for each index
    return mixture_groups(table(spark, d, "training_embedding_samples"), "sample_id", "v", by="index_id", numbers=numbers)


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    from codelattice.llm.tokenizer import encode_documents

    return encode_documents(table(spark, d, "documents"), "doc_id", "text", tokenizer_path())


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import os

    return os.path.join(os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers"), name)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    from codelattice.llm.leakage import leaked

    return leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a passage close to an item in the latent space that shares its order of words and its telling words."""
    from codelattice.llm.leakage import paraphrased

    return paraphrased(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    from codelattice.llm.reading import formula_levels

    return formula_levels(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "level")


def p8_unigram_levels(spark: SparkSession, d: str) -> DataFrame:
    from codelattice.llm.reading import unigram_levels

    return unigram_levels(table(spark, d, "documents"), "doc_id", "text")


QUERIES: dict[str, Query] = {f.__name__: f for f in (p1_found, p1_classes, p2_found, p2_balanced, p3_found, p4_found, p5_found, p5_mixture, p6_ids, p7_found, p7_paraphrases, p8_found, p8_unigram_levels)}

_WS = r"[\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_FINE = "v IS NOT NULL AND len(v) = 96 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0"
_UNIT = "list_transform(CAST(v AS DOUBLE[]), lambda x: x / sqrt(list_dot_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[]))))"

#: For small tables: these compare all pairs, or all grams.
SQL: dict[str, str] = {
    "p1_found": r"""
        WITH w AS (SELECT pid, list_transform(regexp_extract_all(passage_text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM (SELECT DISTINCT pid, passage_text FROM collection_passages WHERE passage_text IS NOT NULL)),
        g AS (SELECT DISTINCT pid, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w WHERE len(w) >= 20),
        n AS (SELECT pid, count(*) AS n FROM g GROUP BY pid),
        c AS (SELECT x.pid AS a, y.pid AS b, count(*) AS c FROM g x JOIN g y ON x.g = y.g AND x.pid < y.pid GROUP BY x.pid, y.pid)
        SELECT a AS pid_a, b AS pid_b FROM c JOIN n x ON x.pid = a JOIN n y ON y.pid = b WHERE 5 * c >= 3 * (x.n + y.n - c)""",
    "p1_classes": r"""
        WITH RECURSIVE w AS (SELECT pid, list_transform(regexp_extract_all(passage_text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM (SELECT DISTINCT pid, passage_text FROM collection_passages WHERE passage_text IS NOT NULL)),
        m AS MATERIALIZED (SELECT DISTINCT pid, array_to_string(w, ' ') AS c FROM w WHERE len(w) >= 20),
        k AS (SELECT c, min(pid) AS class_key, count(*) AS copies FROM m GROUP BY c),
        g AS (SELECT DISTINCT c, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM (SELECT c, string_split(c, ' ') AS w FROM k)),
        n AS (SELECT c, count(*) AS n FROM g GROUP BY c),
        b AS (SELECT x.c AS a, y.c AS b, count(*) AS s FROM g x JOIN g y ON x.g = y.g AND x.c <> y.c GROUP BY x.c, y.c),
        e AS MATERIALIZED (SELECT b.a, b.b FROM b JOIN n x ON x.c = b.a JOIN n y ON y.c = b.b WHERE 5 * b.s >= 3 * (x.n + y.n - b.s)),
        r AS (SELECT c AS node, class_key AS seed FROM k UNION SELECT e.b, r.seed FROM r JOIN e ON e.a = r.node),
        o AS (SELECT node, min(seed) AS group_key FROM r GROUP BY node),
        l AS (SELECT a AS c, count(*) AS links FROM e GROUP BY a)
        SELECT pid, class_key, copies, coalesce(links, 0) AS links, group_key FROM m JOIN k USING (c) LEFT JOIN l USING (c) JOIN o ON o.node = m.c""",
    "p2_found": rf"""
        WITH RECURSIVE x AS (SELECT DISTINCT pid, regexp_replace(regexp_replace(passage_text, '^{_WS}+', ''), '{_WS}+$', '') AS t FROM collection_passages WHERE passage_text IS NOT NULL),
        w AS (SELECT pid, regexp_extract_all(t, '[^{_WS[1:]}+') AS w, regexp_extract_all(t, '{_WS}+') AS g FROM x),
        k AS (SELECT pid, len(w) AS n, list_transform(range(1, len(w)), lambda b: CASE WHEN len(g[b]) - len(replace(g[b], chr(10), '')) >= 2 THEN 0 WHEN regexp_matches(w[b], '[.!?…]["''”’»)\]]*$') THEN 1 ELSE 2 END) AS kind FROM w WHERE len(w) > 200),
        r AS (
            SELECT pid, 0 AS piece_no, CAST(0 AS BIGINT) AS a, CAST(n AS BIGINT) AS n, kind FROM k
            UNION ALL
            SELECT pid, piece_no + 1, coalesce(list_max(list_filter(range(a + 101, a + 201), lambda b: kind[b] = 0)), list_max(list_filter(range(a + 101, a + 201), lambda b: kind[b] = 1)), a + 200) - 20, n, kind FROM r WHERE n - a > 200),
        p AS (SELECT pid, piece_no, a, CASE WHEN n - a > 200 THEN lead(a) OVER (PARTITION BY pid ORDER BY piece_no) + 19 ELSE n - 1 END AS b FROM r),
        m AS (SELECT pid, arg_max(coalesce(original_docid_chunkidx, ''), written_at) AS tag FROM passage_mapping GROUP BY pid)
        SELECT pid, CAST(piece_no AS INT) AS piece_no, CASE WHEN contains(tag, '_') THEN regexp_extract(tag, '(?s)^(.*)_[^_]*$', 1) ELSE '' END AS docid, CAST(a AS INT) AS first_word, CAST(b AS INT) AS last_word FROM p LEFT JOIN m USING (pid)""",
    "p2_balanced": rf"""
        WITH RECURSIVE x AS (SELECT DISTINCT pid, regexp_replace(regexp_replace(passage_text, '^{_WS}+', ''), '{_WS}+$', '') AS t FROM collection_passages WHERE passage_text IS NOT NULL),
        w AS (SELECT pid, regexp_extract_all(t, '[^{_WS[1:]}+') AS w, regexp_extract_all(t, '{_WS}+') AS g FROM x),
        k AS MATERIALIZED (SELECT row_number() OVER () AS id, pid, w, g, CAST(len(w) AS BIGINT) AS n, list_transform(range(1, len(w)), lambda b: CASE WHEN len(g[b]) - len(replace(g[b], chr(10), '')) >= 2 THEN 0.0::DOUBLE WHEN regexp_matches(w[b], '[.!?…]["''”’»)\]]*$') THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END) AS price FROM w WHERE len(w) > 200),
        v AS (
            SELECT id, n, price, n AS a, [0.0::DOUBLE] AS least, CAST([] AS BIGINT[]) AS best FROM k
            UNION ALL
            SELECT id, n, price, a - 1, list_slice(list_prepend(list_min(c), least), 1, 200), list_prepend(CASE WHEN n - a + 1 <= 200 THEN 0 ELSE a - 1 + 101 + len(c) - list_position(list_reverse(c), list_min(c)) END, best) FROM
            (SELECT *, CASE WHEN n - a + 1 <= 200 THEN [((200 - (n - a + 1)) / 200.0::DOUBLE) * ((200 - (n - a + 1)) / 200.0::DOUBLE)] ELSE list_transform(range(101, 201), lambda l: price[a - 1 + l] + ((200 - l) / 200.0::DOUBLE) * ((200 - l) / 200.0::DOUBLE) + least[l - 20]) END AS c FROM v WHERE a > 0)),
        r AS (SELECT id, n, best, 0 AS piece_no, CAST(0 AS BIGINT) AS a FROM v WHERE a = 0 UNION ALL SELECT id, n, best, piece_no + 1, best[a + 1] - 20 FROM r WHERE n - a > 200),
        p AS (SELECT id, piece_no, a, CASE WHEN n - a > 200 THEN best[a + 1] - 1 ELSE n - 1 END AS b FROM r)
        SELECT DISTINCT pid, CAST(piece_no AS INT) AS piece_no, CAST(a AS INT) AS first_word, CAST(b AS INT) AS last_word, array_to_string(list_transform(range(a + 1, b + 2), lambda i: w[i] || CASE WHEN i <= b THEN g[i] ELSE '' END), '') AS piece FROM p JOIN k USING (id)""",
    "p3_found": f"""
        WITH t AS MATERIALIZED (SELECT sample_id, any_value({_UNIT}) AS u FROM training_embedding_samples WHERE sample_id IS NOT NULL AND {_FINE} GROUP BY sample_id),
        c AS MATERIALIZED (SELECT cid, {_UNIT} AS u FROM centroids WHERE {_FINE}),
        o AS (SELECT 'sample' AS kind, sample_id AS owner_id, u FROM t UNION ALL SELECT 'centroid', CAST(cid AS BIGINT), u FROM c),
        s AS (SELECT kind, owner_id, sample_id AS neighbour_id, round(list_dot_product(o.u, t.u), 9) AS s FROM o JOIN t ON NOT (kind = 'sample' AND owner_id = sample_id))
        SELECT kind, owner_id, neighbour_id FROM s WHERE s >= 0.8 QUALIFY row_number() OVER (PARTITION BY kind, owner_id ORDER BY s DESC, neighbour_id) <= 5""",
    "p4_found": """
        SELECT qid, did FROM (
            SELECT qid, did, row_number() OVER (PARTITION BY qid ORDER BY s DESC, did) AS r FROM (
                SELECT qid, did, max(s) AS s FROM trec_run WHERE qid IS NOT NULL AND did IS NOT NULL AND s IS NOT NULL AND NOT isnan(s) GROUP BY qid, did))
        WHERE r <= 10""",
    "p5_found": f"""
        WITH RECURSIVE t AS MATERIALIZED (SELECT sample_id, any_value({_UNIT}) AS u FROM training_embedding_samples WHERE sample_id IS NOT NULL AND {_FINE} GROUP BY sample_id),
        e AS MATERIALIZED (SELECT x.sample_id AS a, y.sample_id AS b FROM t x JOIN t y ON x.sample_id <> y.sample_id WHERE list_dot_product(x.u, y.u) >= 0.8),
        f AS (SELECT a FROM e GROUP BY a HAVING min(b) > a),
        r AS (SELECT a AS seed, a AS node FROM f UNION SELECT r.seed, e.b FROM r JOIN e ON e.a = r.node),
        c AS MATERIALIZED (SELECT node, min(seed) AS first FROM r GROUP BY node),
        k AS (SELECT first, count(*) AS n FROM c GROUP BY first HAVING count(*) >= 3),
        m AS (SELECT x.first, x.node, round(sum(list_dot_product(p.u, q.u)) / (any_value(k.n) - 1), 9) AS mean FROM c x JOIN k ON k.first = x.first JOIN c y ON y.first = x.first AND y.node <> x.node JOIN t p ON p.sample_id = x.node JOIN t q ON q.sample_id = y.node GROUP BY x.first, x.node),
        b AS (SELECT first, node AS typical FROM m QUALIFY row_number() OVER (PARTITION BY first ORDER BY mean DESC, node) = 1)
        SELECT c.first AS cluster_first_id, c.node AS sample_id, b.typical AS typical_id FROM c JOIN b ON b.first = c.first""",
    "p7_found": r"""
        WITH i AS (SELECT item_id, list_transform(regexp_extract_all(item_text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM eval_items WHERE item_text IS NOT NULL),
        d AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda x: lower(x)) AS w FROM documents WHERE text IS NOT NULL),
        ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(list_slice(w, k, k + 9), ' '))) AS g FROM i WHERE len(w) >= 10),
        dg AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 8), lambda k: array_to_string(list_slice(w, k, k + 9), ' '))) AS g FROM d WHERE len(w) >= 10)
        SELECT DISTINCT doc_id, item_id FROM dg JOIN ig USING (g)""",
    "p8_found": rf"""
        WITH n AS (SELECT doc_id, CAST(len(regexp_extract_all(text, '\p{{L}}+')) AS BIGINT) AS w, CAST(len(regexp_extract_all(text, '\p{{L}}{{7,}}')) AS BIGINT) AS l,
            greatest(1, CAST(len(regexp_extract_all(text, '[.!?…]+["''”’»)\]]*(?:{_WS}|$)')) AS BIGINT)) AS e FROM documents WHERE text IS NOT NULL)
        SELECT doc_id, CAST(1 + (w * w + 100 * l * e >= 20 * w * e)::INT + (w * w + 100 * l * e >= 35 * w * e)::INT + (w * w + 100 * l * e >= 50 * w * e)::INT + (w * w + 100 * l * e >= 65 * w * e)::INT AS INT) AS level FROM n WHERE w >= 20""",
}


def queries() -> dict[str, Query]:
    def shipped(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        run.__name__ = f.__name__
        return run

    return {k: shipped(f) for k, f in QUERIES.items()}
