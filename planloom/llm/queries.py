"""Registered queries of the operators, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planloom.llm import (
    chat, decontaminate, exact_topk, fill_middle, licenses, line_dedup, packing, prefix_trie,
    quality, simhash, suffix_dedup, token_files, warc)
from planloom.llm.shared import importable

#: Tokenizer files; where they lie is the environment's choice.
WORD_BPE, WORD_BPE_END = "word_bpe_49k.json", 1
BYTE_BPE, BYTE_BPE_END = "byte_bpe_50k.json", 2

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            importable(spark)
            return fn(spark, sf_dir)

        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return register


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUALITY_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text,
                  regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, t) > 1),
c AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM r) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             length(text) - length(replace(text, '!', '')) AS n_bangs,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
             coalesce(c.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN c ON c.doc_id = w.doc_id),
f AS (SELECT *, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR n_symbols > 0.5 * n_words OR n_bangs > 0.5 * n_words OR word_chars > 30 * n_words
            OR 100 * n_dup_lines > 50 * len(lines)) AS kept
FROM f
"""


@query(QUALITY_SQL)
def op4_quality_rules(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    order = quality.plan_rules(docs)
    measured = quality.measure(docs, order)
    base = F.lit(False)
    for rule in quality.RULES:
        if rule.base:
            base = base | rule.rejects()
    count = lambda name: F.col(f"_q_{name}").cast("long").alias(name)
    return measured.select(
        "doc_id", count("n_words"), count("word_chars"), count("n_symbols"), count("n_dup_lines"),
        count("n_repeat_words"), base.alias("base_failed"), F.col("_q_rejected_by").isNull().alias("kept"))


def _license_sql() -> str:
    rows = ", ".join(f"({t}, '{x.label}', {x.phrase}, {len(x.words) - licenses.K + 1}, {x.words!r})"
                     for t, x in enumerate(licenses.TEMPLATES))
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(
                     translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT * FROM (VALUES {rows}) v(template, label, phrase, windows, words)),
g AS (SELECT doc_id, p, w[p + 1] AS a, w[p + 2] AS b, w[p + 3] AS c
      FROM (SELECT doc_id, w, unnest(range(0, len(w) - 2)) AS p FROM w)),
tg AS (SELECT template, q, words[q + 1] AS a, words[q + 2] AS b, words[q + 3] AS c
       FROM (SELECT template, words, unnest(range(0, windows)) AS q FROM t)),
hits AS (SELECT doc_id, template, p - q AS diagonal, q FROM g JOIN tg USING (a, b, c)),
places AS (SELECT doc_id, label, diagonal FROM hits JOIN t USING (template) WHERE phrase
           GROUP BY doc_id, template, label, windows, diagonal HAVING count(DISTINCT q) = windows),
base AS (SELECT doc_id, count(*) AS n, min(diagonal) AS a, max(diagonal) AS b, list(DISTINCT label) AS labels
         FROM places GROUP BY doc_id),
marked AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER o > {licenses.GAP}, true)::INT AS fresh
           FROM hits JOIN t USING (template) WHERE NOT phrase
           WINDOW o AS (PARTITION BY doc_id, template ORDER BY diagonal, q)),
grouped AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY diagonal, q
                                       ROWS UNBOUNDED PRECEDING) AS run FROM marked),
shares AS (SELECT doc_id, label, count(DISTINCT q) / windows::DOUBLE AS share
           FROM grouped GROUP BY doc_id, template, label, windows, run),
notices AS (SELECT doc_id, max(share) AS share, list(DISTINCT label) FILTER (share >= {licenses.MIN_SHARE}) AS labels
            FROM shares GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word,
       b::BIGINT AS last_word, array_to_string(list_sort(coalesce(base.labels, [])), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(notices.labels, [])))),
                       ',') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(share, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN base ON base.doc_id = w.doc_id LEFT JOIN notices ON notices.doc_id = w.doc_id
"""


@query(_license_sql())
def op3_license_scan(spark, sf_dir):
    found = licenses.find(table(spark, sf_dir, "documents"))
    starts = F.transform("places", lambda x: x["word"])
    base = F.array_distinct(F.transform("places", lambda x: x["label"]))
    more = F.transform(F.filter("shares", lambda x: x["share"] >= licenses.MIN_SHARE), lambda x: x["label"])
    joined = lambda labels: F.array_join(F.sort_array(labels), ",")
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"), F.array_max(starts).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.array_union(base, more)).alias("labels"), "score")


@query()
def op1_simhash_dedup(spark, sf_dir):
    found = simhash.assign(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


@query()
def op2_token_files(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    folder, files = token_files.write(docs, tokenizer_path(WORD_BPE), WORD_BPE_END)
    found = token_files.read(spark, folder, files, token_files.crc32, "long")
    return found.withColumnRenamed("value", "ids_crc32")


@query()
def op6_best_fit_packing(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return packing.pack_documents(docs, tokenizer_path(BYTE_BPE), BYTE_BPE_END)


WARC_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM f
"""


@query(WARC_SQL)
def op10_warc_segments(spark, sf_dir):
    folder, _ = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(spark, folder, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query()
def op8_line_dedup(spark, sf_dir):
    found = line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), short_lines=True)
    text = F.coalesce("text", F.lit(""))
    n_removed = F.coalesce(F.size("_deleted"), F.lit(0))
    return found.select(
        "doc_id", n_removed.cast("long").alias("n_removed_lines"), F.coalesce("_n_partners", F.lit(0)).alias("n_partners"),
        F.sha2(text.cast("binary"), 256).alias("kept_sha256"))


@query()
def op9_decontamination(spark, sf_dir):
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_words", "n_covered", "n_tiles",
                        (F.col("n_covered") / F.col("n_words")).alias("coverage"))


CHAT_SQL = r"""
WITH m AS (SELECT conv_id, coalesce(role, 'unknown') AS speaker, coalesce(text, '') AS said,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown')) - 1 AS n
           FROM conversations),
p AS (SELECT *, n // 64 AS part FROM m),
w AS (SELECT DISTINCT conv_id, speaker AS assistant FROM p WHERE speaker <> 'system'),
t AS (SELECT w.conv_id, p.part, w.assistant, n, speaker = assistant AS own,
             '<|' || CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = assistant THEN 'assistant'
                          ELSE 'user:' || replace(speaker, '<|', '<\|') END || '|>' AS head,
             replace(said, '<|', '<\|') || '<|end|>' AS body
      FROM w JOIN p ON p.conv_id = w.conv_id),
s AS (SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (
                    PARTITION BY conv_id, assistant ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                + length(head) AS start FROM t)
SELECT conv_id, part::BIGINT AS part, assistant, string_agg(head || body || chr(10), '' ORDER BY n) AS text,
       sum(length(head) + length(body) + 1)::INT AS n_chars, count(*)::INT AS n_turns,
       coalesce(string_agg(start::BIGINT || '-' || (start + length(body))::BIGINT, ',' ORDER BY n) FILTER (own), '') AS mask
FROM s GROUP BY conv_id, part, assistant
"""


@query(CHAT_SQL)
def op5_chat_perspectives(spark, sf_dir):
    found = chat.perspectives(table(spark, sf_dir, "conversations"))
    spans = F.transform("mask", lambda x: F.concat(x["start"].cast("string"), F.lit("-"), x["end"].cast("string")))
    return found.withColumn("mask", F.array_join(spans, ","))


@query()
def op7_suffix_dedup(spark, sf_dir):
    found = suffix_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    return found.select(
        "doc_id", n_bytes.alias("n_bytes"), (n_bytes - F.octet_length("_kept")).alias("n_removed"),
        F.coalesce(F.size("_spans"), F.lit(0)).cast("long").alias("n_spans"), F.sha2("_kept", 256).alias("kept_sha256"),
        F.octet_length("_kept").cast("long").alias("kept_bytes"))


FILL_MIDDLE_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id::VARCHAR) AS h,
                  regexp_extract_all(coalesce(text, ''),
                                     '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS w FROM documents),
k AS (SELECT doc_id, text, w, len(w) AS n, ('0x' || h[1:8])::BIGINT % (len(w) + 1) AS a,
             ('0x' || h[9:16])::BIGINT % (len(w) + 1) AS b,
             CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
                       OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                  WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(w[1:least(a, b)], '') AS prefix,
             array_to_string(w[least(a, b) + 1:greatest(a, b)], '') AS middle,
             array_to_string(w[greatest(a, b) + 1:], '') AS suffix FROM k)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix)::BIGINT END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(middle)::BIGINT END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


@query(FILL_MIDDLE_SQL)
def op13_fill_in_middle(spark, sf_dir):
    made = fill_middle.fill_middle(table(spark, sf_dir, "documents"))
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("fim_text")).alias("output_sha256"),
        digest(fill_middle.restored(F.col("fim_text"), F.col("form"))).alias("restored_sha256"))


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
      FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""


@query(TOP_K_SQL)
def op12_exact_top_k(spark, sf_dir):
    return exact_topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


TRIE_SQL = """
WITH RECURSIVE crc AS (  -- bit by bit over the decimal id
    SELECT DISTINCT conv_id, conv_id::VARCHAR AS s, 0 AS i, 4294967295::BIGINT AS c FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL
    SELECT conv_id, s, i + 1, xor(x >> 1, (x & 1) * 3988292384)
    FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, ascii(s[i // 8 + 1])::BIGINT) ELSE c END AS x
          FROM crc WHERE i < 8 * length(s))),
h AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM crc WHERE i = 8 * length(s)),
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS n
      FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id, list(struct_pack(role := role, text := text) ORDER BY n) AS turns FROM t GROUP BY conv_id),
r AS (SELECT l.conv_id, list_concat(coalesce(b.turns, [])[1:h.h], l.turns[h.h + 1:]) AS turns
      FROM l JOIN h ON h.conv_id = l.conv_id LEFT JOIN l b ON b.conv_id = l.conv_id - l.conv_id % 5),
p AS (SELECT conv_id, d, turns[1:d] AS prefix, len(turns) = d AS last
      FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM r)),
n AS (SELECT prefix, d, min(conv_id) AS conv_id, count(*) AS n_convs,
             coalesce(octet_length(encode(prefix[d].text)), 0) AS bytes,
             sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (last), '')) AS ends_sha256
      FROM p GROUP BY prefix, d),
c AS (SELECT prefix[1:d - 1] AS prefix, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY ALL),
u AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c ON c.prefix = n.prefix AND c.d = n.d),
s AS (SELECT prefix[1:e] AS prefix, e AS d, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * bytes) AS saved_tokens
      FROM (SELECT prefix, n_children, n_convs, bytes, unnest(range(0, d + 1)) AS e FROM u) GROUP BY ALL)
SELECT u.conv_id, u.d::BIGINT AS depth, a.conv_id AS parent_conv_id, u.n_convs, u.n_children::BIGINT AS n_children,
       s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, u.ends_sha256
FROM u JOIN s ON s.prefix = u.prefix AND s.d = u.d LEFT JOIN n a ON a.d = u.d - 1 AND a.prefix = u.prefix[1:u.d - 1]
"""


@query(TRIE_SQL)
def op11_prefix_trie(spark, sf_dir):
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))
