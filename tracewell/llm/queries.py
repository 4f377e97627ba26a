"""The registered queries of the corpus operators: thin digests of what the operators return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.llm import align, decontaminate, fertility, fim, html_density, linededup, nbsvm, packing, pii, shards, simhash, unigram, warc
from tracewell.scratch import table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return nbsvm.score(docs, nbsvm.train(docs, table(spark, sf_dir, "labels")))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unigram.digest(table(spark, sf_dir, "documents"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.balanced_shards(table(spark, sf_dir, "documents"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.main_text(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fertility.quality_rules(table(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*first, *(c for c in found.columns if c not in first))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_repeated_chunks(table(spark, sf_dir, "documents"), count_cols=True)
    return kept.select("doc_id", "n_chunks", "n_removed", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    return moved.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash": op1_simhash,
    "op2_quality": op2_quality,
    "op3_pieces": op3_pieces,
    "op4_decontamination": op4_decontamination,
    "op5_sharding": op5_sharding,
    "op6_html": op6_html,
    "op7_warc": op7_warc,
    "op8_rules": op8_rules,
    "op9_lines": op9_lines,
    "op10_pii": op10_pii,
    "op11_packing": op11_packing,
    "op12_fim": op12_fim,
    "op13_align": op13_align,
}

ORACLE: dict[str, str] = {
    "op4_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        bw AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(1, len(w) - 9) + 1), lambda i: array_to_string(w[i : i + 9], ' '))) AS t,
                      least(10, len(w)) AS n FROM b WHERE len(w) > 0),
        dw AS (SELECT doc_id, k.n AS n, unnest(list_transform(range(1, len(w) - k.n + 2), lambda i: {'i': i, 't': array_to_string(w[i : i + k.n - 1], ' ')})) AS s
               FROM d, (SELECT DISTINCT n FROM bw) k WHERE len(w) >= k.n),
        m AS (SELECT DISTINCT doc_id, item_id, s.i AS i, dw.n AS n FROM dw JOIN bw ON dw.s.t = bw.t AND dw.n = bw.n),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
        g AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN g USING (doc_id)""",
    "op7_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS least FROM p)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM least THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id IS DISTINCT FROM least THEN least END AS refers_to
        FROM f""",
    "op9_lines": """
        WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
        h AS (SELECT *, list_transform(ls, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS hs FROM l),
        r AS (SELECT *, list_transform(hs, lambda x, i: (x + 31 * CASE WHEN i > 1 THEN hs[i - 1] ELSE 0 END) % 2) AS rs FROM h),
        e AS (SELECT *, list_filter(range(1, len(ls) + 1), lambda i: i = len(ls) OR (i > 1 AND rs[i] = 0 AND rs[i - 1] <> 0)) AS ends FROM r),
        c AS (SELECT doc_id, text, unnest(list_transform(ends, lambda x, i: {'pos': i, 'n': x - CASE WHEN i > 1 THEN ends[i - 1] ELSE 0 END,
                     't': array_to_string(ls[1 + CASE WHEN i > 1 THEN ends[i - 1] ELSE 0 END : x], chr(10))})) AS s FROM e),
        f AS (SELECT doc_id, text, s.pos AS pos, s.t AS t, s.n > 1 AND row_number() OVER (PARTITION BY s.t, s.n > 1 ORDER BY doc_id, s.pos) > 1 AS gone FROM c),
        g AS (SELECT doc_id, count(*) AS n_chunks, count(*) FILTER (gone) AS n_removed,
                     coalesce(string_agg(t, chr(10) ORDER BY pos) FILTER (NOT gone), '') AS kept FROM f GROUP BY doc_id)
        SELECT doc_id, n_chunks, n_removed, length(kept) AS n_chars, sha256(kept) AS text_sha256 FROM g""",
    "op12_fim": r"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || doc_id) AS h FROM documents),
        u AS (SELECT *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS units FROM t),
        c AS (SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(units) + 1) AS c1, ('0x' || substr(h, 9, 8))::BIGINT % (len(units) + 1) AS c2,
                     CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || substr(h, 17, 8))::BIGINT % 100 >= 90 THEN 'plain'
                          WHEN ('0x' || substr(h, 25, 8))::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
        p AS (SELECT *, array_to_string(units[1 : least(c1, c2)], '') AS prefix, array_to_string(units[least(c1, c2) + 1 : greatest(c1, c2)], '') AS middle,
                     array_to_string(units[greatest(c1, c2) + 1 :], '') AS suffix FROM c)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                           ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256
        FROM p""",
}
