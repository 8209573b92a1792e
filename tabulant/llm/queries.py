"""Registered queries of the operators, with SQL twins where SQL can say the same.

Each query is a thin layer over its operator: it reads the whole table and derives the
digest columns from what the operator returns.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulant.llm.bpe import decode, encode
from tabulant.llm.common import work_path
from tabulant.llm.decontaminate import find_contamination
from tabulant.llm.hnsw import nearest
from tabulant.llm.jaccard import similar_components
from tabulant.llm.language import identify, train
from tabulant.llm.lm import score_texts
from tabulant.llm.passages import near_passages
from tabulant.llm.phrases import collocations
from tabulant.llm.quality import grade_texts
from tabulant.llm.quality import train as train_grades
from tabulant.llm.suffixes import repeated_spans
from tabulant.llm.surrogates import replace_entities
from tabulant.llm.tokenfiles import documents_of, write_tokens
from tabulant.llm.trie import rebuilt, trie_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

TOKENIZER = "byte_bpe_50k.json"
SECRET = "surrogates of the registered query"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def token_digests(decoded: DataFrame, *more: str) -> DataFrame:
    return decoded.select(
        "doc_id",
        *more,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op1_quality")
def op1_quality(spark, sf_dir):
    """Grades 0 (toxic), 1 (poor), 2 (good); kept: likely good."""
    docs = table(spark, sf_dir, "documents")
    grade = (
        F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    )
    model = train_grades(docs, table(spark, sf_dir, "labels"), grade, grades=3)
    return grade_texts(docs, model).select(
        "doc_id",
        "expected_grade",
        F.col("tails")[0].alias("p_not_toxic"),
        F.col("tails")[1].alias("p_good"),
        (F.col("tails")[1] >= 0.4).alias("keep"),
    )


@query("op2_bpe")
def op2_bpe(spark, sf_dir):
    path = public_tokenizers.path(TOKENIZER)
    return token_digests(decode(encode(table(spark, sf_dir, "documents"), path), path))


OP7_SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL
), pat AS (
  SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS p
  FROM (SELECT item, w, unnest(range(1, greatest(2, len(w) - 8))) AS i FROM iw WHERE len(w) > 0)
), ks AS (SELECT DISTINCT k FROM pat
), occ AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks WHERE len(w) >= k)
), found AS (SELECT doc_id, item, i, occ.k FROM occ JOIN pat USING (k, p)
), hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS pos FROM found) GROUP BY 1
), its AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1)
SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""


@query("op7_decontaminate", OP7_SQL)
def op7_decontaminate(spark, sf_dir):
    found = find_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10
    )
    words = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]
    )
    return found.select(
        "doc_id",
        "n_words",
        words.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (words > 0).alias("contaminated"),
    )


def held_out(key: str, modulus: int):
    """Whether the id's remainder is 1; a null id is never held out."""
    rest = F.crc32(F.col(key).cast("string").cast("binary")) % modulus
    return F.coalesce(rest == 1, F.lit(False))


@query("op4_language")
def op4_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out("doc_id", 3)))
    return identify(docs, model).select(
        "doc_id",
        held_out("doc_id", 3).alias("held_out"),
        "lang_pred",
        "score",
        "n_words",
    )


@query("op5_lm")
def op5_lm(spark, sf_dir):
    scored = score_texts(table(spark, sf_dir, "documents"), ~held_out("doc_id", 5))
    return scored.select(
        "doc_id",
        (~F.col("train")).alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        "bits_per_byte",
    )


@query("op3_suffix_dedup")
def op3_suffix_dedup(spark, sf_dir):
    found = repeated_spans(table(spark, sf_dir, "documents"), length=50)
    removed = F.aggregate(
        "spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]
    )
    return found.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


OP9_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(2, len(w) - 2))) AS i FROM w WHERE len(w) > 0)
), sz AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1
), ov AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o
  FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM ov JOIN sz x ON x.doc_id = a JOIN sz y ON y.doc_id = b
  WHERE 100 * o >= 85 * (x.n + y.n - o)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
)
SELECT d.doc_id, CAST(coalesce(sz.n, 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM documents d LEFT JOIN sz USING (doc_id) JOIN reach ON reach.a = d.doc_id GROUP BY d.doc_id, sz.n
"""


@query("op9_jaccard", OP9_SQL)
def op9_jaccard(spark, sf_dir):
    return similar_components(table(spark, sf_dir, "documents"), n=4, percent=85)


@query("op10_hnsw")
def op10_hnsw(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return nearest(rows, rows.where(F.col("vec_id") % 20 == 0), k=20)


@query("op6_surrogates")
def op6_surrogates(spark, sf_dir):
    return replace_entities(table(spark, sf_dir, "documents"), key=SECRET)


@query("op8_passages")
def op8_passages(spark, sf_dir):
    found = near_passages(table(spark, sf_dir, "documents"), words=50, similarity=0.8)
    return found.select(
        "doc_id",
        "n_words",
        "n_repeated",
        F.size("passages").cast("long").alias("n_passages"),
        F.array_sort(F.array_distinct(F.transform("passages", lambda p: p["match"]))).alias(
            "matches"
        ),
        "passages",
    )


OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
), ng AS (
  SELECT lang, k, p, count(*) AS f FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p
    FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM pieces, range(1, 5) AS t(k) WHERE len(w) >= k)
  ) GROUP BY ALL
), tot AS (SELECT lang, sum(f) AS n FROM ng WHERE k = 1 GROUP BY lang
), cand AS (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM ng WHERE k > 1 AND f >= 30
), cut AS (
  SELECT lang, p, a, j, array_to_string(w[1:j], ' ') AS p1, array_to_string(w[j + 1:], ' ') AS p2
  FROM (SELECT *, unnest(range(1, k)) AS j FROM cand)
), scored AS (
  SELECT cut.*, x.f AS l, y.f AS r, (2000000::HUGEINT * a) // (x.f + y.f) AS score
  FROM cut JOIN ng x ON x.lang = cut.lang AND x.p = p1 JOIN ng y ON y.lang = cut.lang AND y.p = p2
), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1
), longer AS (
  SELECT lang, s AS p, max(a) AS m FROM (
    SELECT lang, a, k, m, array_to_string(w[i:i + m - 1], ' ') AS s
    FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM cand, range(2, 4) AS t(m) WHERE m < k)
  ) GROUP BY 1, 2
), kept AS (
  SELECT best.* FROM best LEFT JOIN longer USING (lang, p) WHERE longer.m IS NULL OR 100 * longer.m < 80 * a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, p) AS rank, p AS phrase, a, l, r,
  CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM kept JOIN tot USING (lang) QUALIFY rank <= 2000
"""


@query("op12_phrases", OP12_SQL)
def op12_phrases(spark, sf_dir):
    return collocations(table(spark, sf_dir, "documents"), least=30, top=2000)


OP11_SQL = r"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), t AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, left(sha256(length(role) || ':' || role || text), 32)) AS pos
  FROM raw
), bits AS (
  SELECT conv_id AS c, list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)),
    lambda crc, x: list_reduce(list_prepend(xor(crc, x), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
      lambda y, z: CASE WHEN y % 2 = 1 THEN xor(y >> 1, 3988292384::UBIGINT) ELSE y >> 1 END)) AS crc
  FROM (SELECT DISTINCT conv_id FROM raw)
), m AS (SELECT c, c - c % 20 AS base, CAST(xor(crc, 4294967295::UBIGINT) % 4 AS BIGINT) AS h FROM bits
), steps AS (
  SELECT c, 0 AS part, pos, role, text FROM m JOIN t ON t.conv_id = m.base AND pos <= h
  UNION ALL SELECT c, 1, pos, role, text FROM m JOIN t ON t.conv_id = m.c AND pos > h
), seq AS (
  SELECT c, list([role, text] ORDER BY part, pos) AS s FROM steps GROUP BY c
  UNION ALL SELECT c, [] FROM m WHERE c NOT IN (SELECT c FROM steps)
), pre AS (SELECT c, len(s) AS size, d, s[1:d] AS p FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM seq)
), node AS (
  SELECT p, d, min(c) AS conv_id, count(*) AS n,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '') AS ends,
    CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(p[d][2], '[^\x20\x09-\x0D]+')) END AS w
  FROM pre GROUP BY p, d
), kid AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL
), full_ AS (SELECT node.*, coalesce(k, 0) AS k FROM node LEFT JOIN kid USING (p, d)
), below AS (
  SELECT a.p, a.d, sum(CASE WHEN b.k = 0 THEN 1 ELSE 0 END) AS leaves, sum((b.n - 1) * b.w) AS saved
  FROM (SELECT p AS bp, d AS bd, n, k, w, unnest(range(0, d + 1)) AS ad FROM full_) b
  JOIN full_ a ON a.d = b.ad AND a.p = b.bp[1:b.ad] GROUP BY ALL
)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, u.conv_id AS parent_conv_id, CAST(f.n AS BIGINT) AS n_convs,
  CAST(f.k AS BIGINT) AS n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens,
  sha256(f.ends) AS ends_sha256
FROM full_ f JOIN below USING (p, d) LEFT JOIN node u ON f.d > 0 AND u.d = f.d - 1 AND u.p = f.p[1:f.d - 1]
"""


@query("op11_prefix_trie", OP11_SQL)
def op11_prefix_trie(spark, sf_dir):
    steps, members = rebuilt(table(spark, sf_dir, "conversations"), group=20, heads=4)
    return trie_of(steps, ["part", "pos"], members)


@query("op13_token_files")
def op13_token_files(spark, sf_dir):
    docs, path = table(spark, sf_dir, "documents"), work_path(spark)
    write_tokens(docs, path, public_tokenizers.path(TOKENIZER), end_id=0)
    found = documents_of(spark, path, docs, value=F.crc32("ids"))
    return found.withColumnRenamed("ids", "ids_crc32")
