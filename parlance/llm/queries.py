"""Queries of the corpus operators over their whole tables, and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import chat, content_sort, decontaminate, embedding_dedup, hard_negatives, minhash, mixing, ngram_lm, pii, prefix_trie, secrets, suffix_dedup, toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(table(spark, sf_dir, "documents"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.digest(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.digest(table(spark, sf_dir, "embeddings"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(table(spark, sf_dir, "conversations"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(table(spark, sf_dir, "documents"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.digest(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.digest(table(spark, sf_dir, "embeddings"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_sort.digest(table(spark, sf_dir, "documents"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.digest(table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scan, op2_suffix_dedup, op3_minhash_dedup, op4_embedding_dedup, op5_chat_format, op6_toxicity, op7_mix, op8_lm_score,
        op9_decontaminate, op10_pii, op11_hard_negatives, op12_exact_dedup, op13_prefix_trie,
    )
}
_WORDS = "regexp_extract_all(translate(coalesce(text,''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
#: crc32 of conv_id as text, bit by bit.
_CRC = "list_reduce([4294967295::BIGINT] || flatten([[ascii(ch)::BIGINT, 0, 0, 0, 0, 0, 0, 0] for ch in string_split(conv_id::VARCHAR, '')]), lambda z, x: xor(xor(z, x) >> 1, (xor(z, x) & 1) * 3988292384))"
ORACLE_SQL: dict[str, str] = {
    "op9_decontaminate": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark), bn AS (SELECT *, least(len(w),10) AS n FROM b WHERE len(w)>0),
bx AS (SELECT DISTINCT item, n, unnest([array_to_string(w[i:i+n-1],' ') for i in range(1,len(w)-n+2)]) AS k FROM bn), ln AS (SELECT DISTINCT n FROM bx),
dx AS (SELECT doc_id, n, unnest([{{'i': i, 'k': array_to_string(w[i:i+n-1],' ')}} for i in range(1,len(w)-n+2)]) AS x FROM d, ln WHERE len(w)>=n), h AS (SELECT doc_id, x.i AS i, dx.n AS n, item FROM dx JOIN bx ON bx.n=dx.n AND bx.k=x.k),
hp AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i,i+n)) AS p FROM h) GROUP BY ALL), hi AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY ALL)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0)>0 AS contaminated FROM d LEFT JOIN hp USING (doc_id) LEFT JOIN hi USING (doc_id)""",
    "op11_hard_negatives": """WITH e AS (SELECT row_number() OVER () AS r, vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label+1)%10 ELSE label END AS label, [floor(256*x::DOUBLE) for x in embedding] AS v FROM embeddings
 WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.r, a.id AS anchor_id, c.r AS cr, c.id AS cid, a.label = c.label AS same, coalesce(list_sum([a.v[i]*c.v[i] for i in range(1, len(a.v)+1)]), 0)::BIGINT AS score FROM e a JOIN e c ON len(a.v) = len(c.v) AND a.r <> c.r WHERE a.id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, cid, cr) <= 5), n AS (SELECT p.anchor_id, p.cid AS positive_id, s.cid AS negative_id, p.score AS positive_score, s.score AS negative_score,
 row_number() OVER (PARTITION BY p.r, p.cr ORDER BY s.score DESC, s.cid, s.cr) AS rank FROM p JOIN s ON s.r = p.r AND NOT s.same AND 30*p.score <= 100*s.score AND 100*s.score <= 90*p.score)
SELECT anchor_id, positive_id, rank::INT AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10""",
    "op12_exact_dedup": r"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text,''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, row_number() OVER w = 1 AS kept, sha256(t) AS text_sha256 FROM d
WINDOW w AS (PARTITION BY t ORDER BY doc_id NULLS LAST)""",
    "op13_prefix_trie": f"""WITH o AS (SELECT conv_id, list({{'role': coalesce(role,''), 'text': coalesce(text,'')}} ORDER BY turn NULLS FIRST, sha256(strlen(coalesce(role,''))::VARCHAR || ':' || coalesce(role,'') || coalesce(text,''))) AS t FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
c AS (SELECT conv_id, t, (xor({_CRC}, 4294967295) % 4)::INT AS h FROM o), r AS (SELECT c.conv_id, list_concat(coalesce(b.t, [])[1:c.h], c.t[c.h+1:]) AS t FROM c LEFT JOIN o b ON b.conv_id = c.conv_id - c.conv_id % 20),
p AS (SELECT conv_id, len(t) AS size, unnest(range(0, len(t)+1)) AS d, t FROM r), q AS (SELECT conv_id, size, d, t[1:d] AS k FROM p),
n AS (SELECT k, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '') AS ends FROM q GROUP BY k, d),
kids AS (SELECT k[1:d-1] AS k, d-1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL), m AS (SELECT n.*, coalesce(n_children, 0) AS n_children, CASE WHEN n.d > 0 THEN (n_convs-1) * len(regexp_extract_all(n.k[n.d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END AS own FROM n LEFT JOIN kids ON kids.k = n.k AND kids.d = n.d),
up AS (SELECT k[1:a] AS k, a AS d, own, (n_children = 0)::BIGINT AS leaf FROM (SELECT *, unnest(range(0, d+1)) AS a FROM m)), sub AS (SELECT k, d, sum(leaf)::BIGINT AS n_leaves, sum(own)::BIGINT AS saved_tokens FROM up GROUP BY ALL)
SELECT m.conv_id, m.d AS depth, above.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, saved_tokens, sha256(m.ends) AS ends_sha256 FROM m JOIN sub ON sub.k = m.k AND sub.d = m.d LEFT JOIN n above ON above.d = m.d-1 AND above.k = m.k[1:m.d-1] AND m.d > 0""",
}
