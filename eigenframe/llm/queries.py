"""The queries of the corpus operators, over whole tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from eigenframe.llm import audit, divergence, fill_middle, langid, main_text, mixing, neighbours, packing, quality, simhash, spans, token_files, warc
from eigenframe.llm.common import remainder, table
from eigenframe.llm.divergence_sql import verdict_sql
from eigenframe.plans.durable import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql.strip()
        return fn

    return add


def tokenizer() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op4_best_fit_packing")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(table(spark, sf, "documents"), tokenizer())


@query("op5_simhash")
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.near_groups(table(spark, sf, "documents"), words=4, bits=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@query("op10_sentence_spans")
def _(spark: SparkSession, sf: str) -> DataFrame:
    cut = spans.remove_repeats(table(spark, sf, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "text", "removed_sentences", "removed_words")


@query("op7_distribution_divergence", verdict_sql())
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    judged = divergence.judge(docs, divergence.learn(docs))
    return judged.select("doc_id", *divergence.BASE, "base_failed", "kept")


@query("op8_language_id")
def _(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = langid.fit(docs, remainder("doc_id", 4) != 2)
    held_out = F.coalesce(remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return langid.identify(docs, model).select("doc_id", held_out, "lang_pred", "score")


@query("op2_quality_classifier")
def _(spark: SparkSession, sf: str) -> DataFrame:
    measured = stored(quality.with_statistics(table(spark, sf, "documents")), "statistics")
    model = quality.fit(measured, table(spark, sf, "labels"), remainder("doc_id", 5) != 0)
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out")
    predicted = (F.col("score") >= 0.3).cast("int").alias("predicted")
    return quality.score_measured(measured, model).select("doc_id", held_out, "score", predicted)


@query("op9_cube_mixing")
def _(spark: SparkSession, sf: str) -> DataFrame:
    decided = mixing.decide(table(spark, sf, "documents"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return decided.select("doc_id", "size", "source_size", "target", taken)


@query(
    "op3_warc",
    """WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
       r AS (SELECT page_id, n, sha1(h) AS d, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS first FROM p)
       SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to FROM r""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    found = warc.round_trip(table(spark, sf, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op6_collision_counting")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op1_huffman_token_files")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return token_files.round_trip(table(spark, sf, "documents"), tokenizer())


@query(
    "op11_fill_in_middle",
    r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
       u AS (SELECT *, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w,
         [('0x' || substr(h, 8 * k + 1, 8))::BIGINT for k in range(4)] AS r FROM d),
       c AS (SELECT *, least(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS a, greatest(r[1] % (len(w) + 1), r[2] % (len(w) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 50 THEN 'plain'
              WHEN r[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM u),
       x AS (SELECT *, array_to_string(w[1:a], '') AS p, array_to_string(w[a + 1:b], '') AS m, array_to_string(w[b + 1:], '') AS s FROM c)
       SELECT doc_id, len(w) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
         CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
         sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END)
           AS output_sha256, sha256(t) AS restored_sha256 FROM x""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    cut = fill_middle.fill_in_middle(table(spark, sf, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    back = digest(fill_middle.restored("output", "form")).alias("restored_sha256")
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), back)


@query(
    "op12_source_divergence",
    r"""WITH d AS (SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
       t AS MATERIALIZED (SELECT lang, source, term, rid, count(*) AS n FROM (SELECT lang, source, rid, unnest(w) AS term FROM d) GROUP BY ALL),
       k AS MATERIALIZED (SELECT lang, term, sum(n)::HUGEINT AS n FROM t GROUP BY ALL HAVING count(*) >= 10),
       v AS (SELECT lang, count(*) AS v, sum(n) AS n FROM k GROUP BY ALL),
       c AS MATERIALIZED (SELECT lang, source, term, sum(t.n)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY ALL),
       g AS MATERIALIZED (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) g
         LEFT JOIN c USING (lang, source) GROUP BY ALL),
       x AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + 1000000000 * (coalesce(c.n, 0) + 2) // (g.n + 2 * v.v) AS p,
         1 + 1000000000 * (k.n + 2) // (v.n + 2 * v.v) AS q FROM g JOIN k USING (lang) JOIN v USING (lang)
         LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
       f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
         FROM x a JOIN x b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
       r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
         LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
         UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM x WHERE n > 0 AND p > q),
       o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r)
       SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM o WHERE part = 'pair' OR rank <= 10""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return audit.audit(table(spark, sf, "documents"))


@query(
    "op13_main_text",
    r"""WITH a AS (SELECT page_id, url, regexp_replace(coalesce(regexp_extract(html, '<article>(.*)</article>', 1, 's'), ''), '\s+', ' ', 'g') AS h FROM pages),
       b AS (SELECT page_id, url, regexp_replace(replace(regexp_replace(h, '</?(p|h1)>', chr(10), 'g'), '<br>', ' '), '<[^>]*>', '', 'g') AS h FROM a),
       c AS (SELECT page_id, url, regexp_replace(replace(regexp_replace(regexp_replace(regexp_replace(h, '&quot;?', '"', 'g'), '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&#x27;', chr(39)), '&amp;?', '&', 'g') AS h FROM b),
       d AS (SELECT page_id, url, array_to_string(list_filter(list_transform(string_split(h, chr(10)),
         lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM c)
       SELECT page_id, url, text, length(text) AS n_chars FROM d""",  # pages of the given tables have one article, of headings and paragraphs
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages")
    return main_text.extract(pages, main_text.fit(pages))


@query("pipeline")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)
