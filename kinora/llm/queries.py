"""The registered queries opN_<name> and, where SQL can express one, the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinora.llm import bpe, chat, decontaminate, forest, language, secrets, similar, toxicity, urls, warc
from kinora.llm.batches import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{folder}/{name}.parquet")


def registered(name: str):
    def keep(f):
        QUERIES[name] = f
        return f

    return keep


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@registered("op1_decontaminate")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


ORACLES["op1_decontaminate"] = r"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
s AS (SELECT item, w, least(13, len(w)) size, unnest(range(1, len(w) - least(13, len(w)) + 2)) pos FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, size, array_to_string(w[pos:pos + size - 1], ' ') phrase FROM s),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) w FROM documents),
p AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) pos FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size),
hits AS (SELECT p.doc_id, p.pos, p.size, windows.item FROM p JOIN windows ON windows.size = p.size AND windows.phrase = array_to_string(p.w[p.pos:p.pos + p.size - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT word) n_hit FROM (SELECT doc_id, unnest(range(pos, pos + size)) word FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) n_items, string_agg(item, ',' ORDER BY item) names FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(names, '')) items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@registered("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@registered("op3_jaccard_join")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return similar.similar_groups(table(spark, folder, "documents"), size=4, percent=85)


ORACLES["op3_jaccard_join"] = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 0) + 2)) pos FROM d WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[pos:pos + 3], ' ') shingle FROM p),
n AS (SELECT doc_id, count(*) n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id x, b.doc_id y, count(*) inter FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM common JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * inter >= 85 * (a.n + b.n - inter)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM both_ways UNION SELECT r.x, b.y FROM reach r JOIN both_ways b ON r.y = b.x)
SELECT doc_id, coalesce(n, 0) n_shingles, least(doc_id, coalesce(component, doc_id)) component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x doc_id, min(y) component FROM reach GROUP BY x) USING (doc_id)
"""


@registered("op4_warc")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


ORACLES["op4_warc"] = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) n, sha256(coalesce(html, '')) digest FROM pages),
equal AS (SELECT digest, min(page_id) first FROM p WHERE n >= 100 GROUP BY digest)
SELECT page_id, n payload_bytes, digest payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END record_type,
  CASE WHEN first <> page_id THEN first END refers_to
FROM p LEFT JOIN equal USING (digest)
"""


@registered("op5_language")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.fit(docs))


#: Fixed by the contract of op6: verdict, host, path.
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


@registered("op6_url_filter")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), URL_RULES)


@registered("op7_bpe")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), vocabulary_path()).drop("token_ids")


@registered("op8_embeddings")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return forest.near_duplicates(table(spark, folder, "embeddings"))


ORACLES["op8_embeddings"] = """
WITH RECURSIVE e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) v FROM embeddings),
good AS (SELECT * FROM e WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(v) > 0 AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(v, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id x, b.vec_id y FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
n AS (SELECT x vec_id, count(*) n FROM links GROUP BY x),
c AS (SELECT x vec_id, min(y) component FROM reach GROUP BY x)
SELECT vec_id, coalesce(n, 0) n_links, least(vec_id, coalesce(component, vec_id)) component_id, vec_id = least(vec_id, coalesce(component, vec_id)) kept
FROM e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""


@registered("op9_chat")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return chat.perspectives(table(spark, folder, "conversations"))


ORACLES["op9_chat"] = """
WITH t AS (SELECT conv_id, 0 part, turn, role, text said FROM conversations),
s AS (SELECT DISTINCT conv_id, role speaker FROM t WHERE role <> 'system'),
r AS (SELECT t.*, speaker, coalesce(role = speaker, false) mine,
  '<|im_start|>' || CASE WHEN role = speaker THEN 'assistant' WHEN role = 'system' THEN role WHEN role IS NULL THEN 'user' ELSE 'user name=' || regexp_replace(replace(role, '<|', '< |'), '[\\r\\n]+', ' ', 'g') END || chr(10) head,
  replace(coalesce(said, ''), '<|', '< |') || '<|im_end|>' body FROM t JOIN s ON t.conv_id IS NOT DISTINCT FROM s.conv_id),
o AS (SELECT *, row_number() OVER w place, sum(length(head) + length(body) + 1) OVER w - length(body) - 1 a FROM r
  WINDOW w AS (PARTITION BY conv_id, speaker, part ORDER BY turn NULLS FIRST, role NULLS FIRST, said NULLS FIRST ROWS UNBOUNDED PRECEDING))
SELECT conv_id, speaker, CAST(part AS BIGINT) part, count(*) n_turns, string_agg(head || body || chr(10), '' ORDER BY place) AS text,
  coalesce(string_agg(CAST(a AS BIGINT) || ':' || CAST(a + length(body) AS BIGINT), ',' ORDER BY place) FILTER (WHERE mine), '') mask,
  CAST(coalesce(sum(length(body)) FILTER (WHERE mine), 0) AS BIGINT) n_learned
FROM o GROUP BY conv_id, speaker, part
"""


@registered("op10_secrets")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return secrets.scan(docs, secrets.learn(docs))
