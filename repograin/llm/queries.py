"""The registered queries over the given tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from repograin.llm import licenses

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SQL_WHITE = r"[\x20\x09-\x0D]+"
SQL_WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_license_scan", sql=licenses.scan_sql())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which licenses does each document name?"""
    return licenses.scan(table(spark, sf_dir, "documents"))


@query("op2_chat_repair")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How does each conversation read after its roles are repaired?"""
    from repograin.llm import chat

    return chat.repaired_turns(table(spark, sf_dir, "conversations"))


@query("op3_line_templates", sql=f"""
WITH a AS (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS line_no FROM a),
w AS (
  SELECT doc_id, line_no, list_transform(list_filter(string_split_regex(line, '{SQL_WHITE}'), lambda x: x <> ''),
         lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS words FROM l),
p AS (SELECT *, len(words) AS n, words[1:3] AS head FROM w WHERE len(words) > 0),
s AS (SELECT n, head, words, count(*) AS docs FROM (SELECT DISTINCT doc_id, n, head, words FROM p) GROUP BY ALL),
x AS (SELECT n, head, words, docs, unnest(words) AS word, generate_subscripts(words, 1) AS place FROM s),
k AS (SELECT n, head, place, word FROM x WHERE word <> '<*>' GROUP BY n, head, place, word HAVING sum(docs) >= 3),
t AS (
  SELECT x.n, x.head, x.words, string_agg(CASE WHEN k.word IS NULL THEN '<*>' ELSE k.word END, ' ' ORDER BY x.place) AS template
  FROM x LEFT JOIN k ON x.n = k.n AND x.head = k.head AND x.place = k.place AND x.word = k.word
  GROUP BY x.n, x.head, x.words HAVING count(k.word) >= 0.7 * x.n),
m AS (SELECT p.doc_id, p.line_no, t.template FROM p JOIN t ON p.n = t.n AND p.words = t.words),
c AS (SELECT template, count(*) AS documents FROM (SELECT DISTINCT doc_id, template FROM m) GROUP BY template HAVING count(*) >= 3)
SELECT doc_id, line_no, template, documents FROM m JOIN c USING (template)""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which lines repeat a template that recurs across documents?"""
    from repograin.llm import line_templates

    return line_templates.line_templates(table(spark, sf_dir, "documents"))


@query("op4_simhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are near copies of each other?"""
    from repograin.llm import simhash

    return simhash.classes(table(spark, sf_dir, "documents"))


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which language is each document?"""
    from repograin.llm import language

    return language.learn_and_identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep_text=False).select("doc_id", "held_out", "lang_pred", "score")


@query("op6_warc")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Do the pages come back whole from normalised archives?"""
    from repograin.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op7_exact_dedup", sql=f"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '{SQL_WHITE}', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM t WINDOW w AS (PARTITION BY text_sha256)""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which documents are exact copies, and of which one?"""
    from repograin.llm import exact_dedup

    return exact_dedup.verdicts(table(spark, sf_dir, "documents"))


@query("op8_byte_bpe")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many tokens has each document, and does decoding give it back?"""
    import public_tokenizers

    from repograin.llm import byte_bpe

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = byte_bpe.recode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op9_fingerprints")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How alike are a document, its edited copy and its neighbour, by their fingerprints?"""
    from repograin.llm import minhash

    return minhash.edited_neighbours(table(spark, sf_dir, "documents"))


@query("op10_mixing", sql=f"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{SQL_WORD}'))::BIGINT AS size,
         ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM d GROUP BY source),
o AS (
  SELECT *, (SELECT sum(source_size) FROM s) - coalesce(sum(3 * source_size) OVER b, 0) AS budget,
         (SELECT sum(weight) FROM s) - coalesce(sum(weight) OVER b, 0) AS weights
  FROM s WINDOW b AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, 3 * source_size <= weight * budget::DOUBLE / weights AS capped FROM o),
f AS (SELECT arg_max(budget, weights) AS budget, max(weights) AS weights FROM c WHERE NOT capped),
t AS (
  SELECT source, source_size, CASE WHEN capped THEN (3 * source_size)::DOUBLE
         ELSE (weight * (SELECT budget FROM f))::DOUBLE / (SELECT weights FROM f)::DOUBLE END AS target FROM c),
g AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS rounds FROM t),
h AS (SELECT source, u, sum(size) AS words FROM d GROUP BY source, u),
r AS (SELECT source, u, words, sum(words) OVER (PARTITION BY source ORDER BY u) - words AS before FROM h)
SELECT d.doc_id, d.size, g.source_size, g.target,
       d.size * (g.rounds + CASE WHEN r.before + r.words <= g.target - g.rounds * g.source_size
         OR r.before <= g.target - g.rounds * g.source_size AND 2 * (g.target - g.rounds * g.source_size - r.before) > r.words THEN 1 ELSE 0 END)::BIGINT AS taken
FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.u = r.u""")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document does the mix take?"""
    from repograin.llm import mixing

    mix, rows = mixing.plan(table(spark, sf_dir, "documents"))
    return mix.apply(rows, "key").select(F.col("key").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op11_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which sequence, and where in it, does each piece of each document lie?"""
    import public_tokenizers

    from repograin.llm import packing

    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.with_crc32(packing.pack(table(spark, sf_dir, "documents"), path), path)


def _round(n: int) -> str:
    """SQL of one assignment of all vectors, and of the centroids that follow."""
    return f"""
a{n} AS MATERIALIZED (
  SELECT k.rid, min(struct_pack(d := list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c := c.c)) AS m
  FROM k CROSS JOIN c{n} c GROUP BY k.rid),
s{n} AS (
  SELECT a.m.c AS c, u.p, sum(u.x)::HUGEINT AS s, count(*)::HUGEINT AS n
  FROM a{n} a JOIN (SELECT rid, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM k) u USING (rid) GROUP BY ALL),
n{n} AS (SELECT c, list((((s - ((s % n) + n) % n) // n))::BIGINT ORDER BY p) AS v FROM s{n} GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{n} c LEFT JOIN n{n} n ON n.c = c.c)"""


@query("op12_clusters", sql=f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, sha256('1:' || coalesce(vec_id::VARCHAR, '')) AS h,
         list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY h, rid) - 1)::INT AS c, v FROM k QUALIFY c < 16),
{",".join(_round(n) for n in range(3))},
a AS (
  SELECT k.rid, k.vec_id, min(struct_pack(d := list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, c := c.c)) AS m
  FROM k CROSS JOIN c3 c GROUP BY k.rid, k.vec_id)
SELECT a.vec_id, a.m.c AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia,
       (sum(a.m.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a JOIN c3 c ON c.c = a.m.c""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In which cluster is each vector, and how far from its centre?"""
    from repograin.llm import bit_planes

    return bit_planes.cluster(table(spark, sf_dir, "embeddings"))


@query("op13_filter_audit", sql=f"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, regexp_extract_all(text, '{SQL_WORD}') AS words FROM t),
d AS (
  SELECT part, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic,
    [len(words) < 200, 100 * len(list_distinct(words)) < 50 * len(words), 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text),
     regexp_matches(text, '[#$%&*|]'), doc_id > first] AS fails FROM w),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM d GROUP BY ALL),
f AS (SELECT unnest(range(1, 6)) AS f),
o AS (SELECT [a.f, b.f, c.f, e.f, h.f] AS o FROM f a, f b, f c, f e, f h WHERE len(list_distinct([a.f, b.f, c.f, e.f, h.f])) = 5),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM o),
r AS (
  SELECT part, o, step, o[step] AS own,
    coalesce(sum(n) FILTER (NOT list_bool_or(list_transform(o[1:step], lambda i: fails[i]))), 0) AS kept,
    coalesce(sum(n) FILTER (fails[o[step]] AND list_position(list_transform(o, lambda i: fails[i]), true) = step), 0) AS removed,
    coalesce(sum(n) FILTER (fails[o[step]] AND list_position(list_transform(o, lambda i: fails[i]), true) < step), 0) AS redundant,
    coalesce(sum(n) FILTER (fails[o[step]] AND len(list_filter(fails, lambda x: x)) = 1), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fails[o[step]] AND list_position(list_transform(o, lambda i: fails[i]), true) = step), 0) AS good_lost,
    coalesce(sum(toxic) FILTER (fails[o[step]] AND list_position(list_transform(o, lambda i: fails[i]), true) = step), 0) AS toxic_lost
  FROM g CROSS JOIN s GROUP BY ALL)
SELECT part, array_to_string(list_transform(o, lambda i: 'ABCDE'[i]), '') AS filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed,
  redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM r""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What does each filter remove, at each place of every order?"""
    from repograin.llm import filter_audit

    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
