"""The queries of this subpackage, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, tuple[Query, str | None]] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        _QUERIES[name] = (fn, sql)
        return fn

    return add


def all_queries() -> dict[str, tuple[Query, str | None]]:
    return dict(_QUERIES)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


from pyspark.sql import functions as F  # noqa: E402

from .bitslice import exact_top  # noqa: E402
from .langid import identify  # noqa: E402
from .mixing import mix, mix_sql  # noqa: E402
from .nndescent import near_duplicates as near_vectors  # noqa: E402
from .packing import pack_digests  # noqa: E402
from .phrases import collocations, collocations_sql  # noqa: E402
from .pii import pseudonymize  # noqa: E402
from .quality import score  # noqa: E402
from .repair import repair_digests, repair_sql  # noqa: E402
from .secret_scan import secret_digests  # noqa: E402
from .simhash import near_duplicates  # noqa: E402
from .suffix import dedup_digests  # noqa: E402
from .tokens import record_digests  # noqa: E402


def tokenizer_file() -> str:
    """The contract's tokenizer: lower case, white space dropped, so words encode alone."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


END_ID = 2


@query("op1_pu_quality")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return score(table(spark, folder, "documents"), table(spark, folder, "labels"))


_LINKS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
          ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT id, b FROM reach JOIN links ON r = a),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT id AS vec_id, coalesce(any_value(n), 0)::BIGINT AS n_links, min(r) AS component_id, id = min(r) AS kept
FROM reach LEFT JOIN n ON id = a GROUP BY id
"""


@query("op2_nn_descent", _LINKS_SQL)
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"))


@query("op3_simhash_trie")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"))


@query("op4_mix_sources", mix_sql())
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return mix(table(spark, folder, "documents"))


_TOP_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS x FROM embeddings
           WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
p AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_inner_product(q.x::DOUBLE[], c.x::DOUBLE[])::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM p)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


_REMOVED_SQL = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
g AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (
        SELECT doc_id, h, unnest(range(0, greatest(0, len(h) // 2 - 49))) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS first FROM g GROUP BY s),
r AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true)::INT AS opens
      FROM g JOIN f USING (s) WHERE first < doc_id),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (
           SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM r) GROUP BY doc_id, k),
parts AS (SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM runs
          UNION ALL SELECT doc_id, max(b), NULL FROM runs GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(substr(h, 2 * x + 1, 2 * (coalesce(y, len(h) // 2) - x)), '' ORDER BY x) AS k
         FROM parts JOIN d USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM runs GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed,
       coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)
"""


@query("op5_suffix_sort", _REMOVED_SQL)
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return dedup_digests(table(spark, folder, "documents"))


@query("op6_bitsliced_top", _TOP_SQL)
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return exact_top(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op7_secret_network")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return secret_digests(table(spark, folder, "documents"))


@query("op8_token_records")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return record_digests(table(spark, folder, "documents"), tokenizer_file(), END_ID, by_words=True)


@query("op9_pack_differencing")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return pack_digests(table(spark, folder, "documents"), tokenizer_file(), END_ID, by_words=True)


@query("op10_feistel_pseudonyms")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return pseudonymize(table(spark, folder, "documents")).select("doc_id", "text")


@query("op11_four_russians_repair", repair_sql())
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return repair_digests(table(spark, folder, "conversations"))


@query("op13_stripe_phrases", collocations_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


@query("op12_script_viterbi")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return identify(table(spark, folder, "documents"))
