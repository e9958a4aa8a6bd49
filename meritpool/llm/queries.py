"""The registered queries of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meritpool.llm import (
    chain_dedup, chat, decontamination, divergence, language, line_dedup, manifest, pieces, quality, rules, simhash,
    suffix_dedup, toxicity,
)
from meritpool.llm.frames import fold, ship, table


#: The piece vocabulary that texts are encoded with.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


def op1_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    rows = line_dedup.dedup_rows(table(spark, folder, "documents"))
    return rows.select("row.doc_id", "n_lines", "n_removed", F.md5("kept").alias("kept_md5"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = rules.training_labels(table(spark, folder, "labels"), "toxic", modulus=5, held=0)
    scored = toxicity.Toxicity(docs, labels).score(docs)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", "predicted")


def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.encode(spark, table(spark, folder, "documents"), pieces.read_model(PIECES), decoded=True)


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = language.fit(docs.where(fold(4) != 2))
    found = language.identify(docs, model)
    return found.select("doc_id", (fold(4) == 2).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def op5_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chain_dedup.passages(table(spark, folder, "documents"))


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontamination.leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op7_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = quality.fit(docs, table(spark, folder, "labels"), modulus=4, held=2)
    return quality.score(docs, model).select("doc_id", (fold(4) == 2).alias("held_out"), "score", "predicted")


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, max_bits=3)


def op9_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.cut_repeats(table(spark, folder, "documents"), length=400).drop("kept")


def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    labels = rules.training_labels(table(spark, folder, "labels"), "quality")
    return rules.quality_rules(docs, rules.fit(docs, labels))


def op11_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said,
    )
    return chat.digests(chat.conversations(chat.events_of(turns.unionByName(planted))))


def op12_source_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.divergence(table(spark, folder, "documents"))


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    verified = manifest.manifest(manifest.tampered(table(spark, folder, "documents"))).verified()
    return verified.select(
        "doc_id", F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root", "verified"
    )


def _shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @wraps(query)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return query(spark, folder)

    return run


QUERIES = {
    query.__name__: _shipped(query)
    for query in (
        op1_line_dedup, op2_toxicity, op3_sentencepiece, op4_language, op5_substring_dedup,
        op6_decontamination, op7_quality, op8_simhash, op9_suffix_dedup, op10_quality_rules,
        op11_chat_formatting, op12_source_divergence, op13_merkle_manifest,
    )
}

ORACLE = {
    "op1_line_dedup": """
WITH raw AS (
    SELECT doc_id, i, l[i] AS line
    FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL) AS d,
         unnest(range(1, len(l) + 1)) AS u(i)
), solid AS (
    SELECT doc_id, i, trim(line) AS line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS pos
    FROM raw WHERE trim(line) <> ''
), runs AS (
    SELECT doc_id, pos, line || chr(10) || lead(line) OVER w || chr(10) || lead(line, 2) OVER w AS run
    FROM solid WINDOW w AS (PARTITION BY doc_id ORDER BY pos)
), later AS (
    SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS n FROM runs WHERE run IS NOT NULL
), gone AS (
    SELECT DISTINCT s.doc_id, s.i
    FROM later, unnest([0, 1, 2]) AS k(step)
    JOIN solid AS s ON s.doc_id = later.doc_id AND s.pos = later.pos + step
    WHERE n > 1
), cut AS (
    SELECT raw.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY raw.i) FILTER (WHERE gone.i IS NULL), '') AS kept
    FROM raw LEFT JOIN gone ON gone.doc_id = raw.doc_id AND gone.i = raw.i GROUP BY raw.doc_id
)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS INTEGER) AS n_lines, CAST(coalesce(n_removed, 0) AS INTEGER) AS n_removed,
       md5(kept) AS kept_md5
FROM documents AS d LEFT JOIN cut USING (doc_id)
""",
    "op9_suffix_dedup": r"""
WITH texts AS (
    SELECT row_number() OVER () AS row, doc_id, encode(coalesce(text, '')) AS b FROM documents
), windows AS (
    SELECT row, i, md5(b[i + 1 : i + 400]) AS h FROM texts, unnest(range(0, octet_length(b) - 399)) AS u(i)
), twice AS (
    SELECT row, i FROM windows QUALIFY count(*) OVER (PARTITION BY h) > 1
), islands AS (
    SELECT row, i, sum(fresh) OVER (PARTITION BY row ORDER BY i) AS island
    FROM (SELECT row, i, CASE WHEN i - lag(i) OVER (PARTITION BY row ORDER BY i) <= 400 THEN 0 ELSE 1 END AS fresh FROM twice) AS t
), spans AS (
    SELECT row, min(i) AS low, max(i) + 400 AS high FROM islands GROUP BY row, island
), kept AS (
    SELECT t.row, t.doc_id, t.b, list(s.low ORDER BY s.low) FILTER (s.low IS NOT NULL) AS lows,
           list(s.high ORDER BY s.low) FILTER (s.low IS NOT NULL) AS highs
    FROM texts AS t LEFT JOIN spans AS s ON s.row = t.row GROUP BY t.row, t.doc_id, t.b
), cut AS (
    SELECT doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(len(lows), 0)::BIGINT AS n_spans,
           CASE WHEN lows IS NULL THEN b ELSE list_reduce(list_transform(range(0, len(lows) + 1), lambda k:
               b[(CASE WHEN k = 0 THEN 0 ELSE highs[k] END) + 1 : (CASE WHEN k = len(lows) THEN octet_length(b) ELSE lows[k + 1] END)]),
               lambda x, y: x || y) END AS left_over
    FROM kept
)
SELECT doc_id, n_bytes, n_bytes - octet_length(left_over) AS n_removed, n_spans, sha256(left_over) AS kept_sha256,
       n_bytes > octet_length(left_over) AS repeated,
       (n_bytes - octet_length(left_over)) / greatest(1, n_bytes)::DOUBLE AS removed_share
FROM cut
""",
    "op11_chat_formatting": r"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
    -- an escape is one sign before each backslash and each control string; its first sign is replaced
    SELECT *, length(text) + (length(text) - length(replace(text, chr(92), '')))
           + list_sum(list_transform(
               ['<<SYS>>', '<</SYS>>', '[INST]', '[/INST]', '<s>', '</s>', '[ROLE]', '[/ROLE]'],
               lambda m: (length(text) - length(replace(text, m, ''))) // length(m)
           )) + CASE role WHEN 'system' THEN 17 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 15 + length(role) END AS chars
    FROM turns
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op12_source_divergence": r"""
WITH docs AS (
    SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
           regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
    FROM documents
), tokens AS (
    SELECT row, lang, source, translate(term, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
    FROM (SELECT row, lang, source, unnest(found) AS term FROM docs) AS t
), kept AS (
    SELECT lang, term, count(*) AS c FROM tokens GROUP BY lang, term HAVING count(DISTINCT row) >= 30
), langs AS (
    SELECT lang, count(*) AS v, sum(c) AS n FROM kept GROUP BY lang
), sources AS (
    SELECT DISTINCT lang, source FROM docs
), counted AS (
    SELECT lang, source, term, count(*) AS c FROM tokens SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term
), totals AS (
    SELECT s.lang, s.source, coalesce(sum(c), 0) AS n FROM sources AS s LEFT JOIN counted USING (lang, source) GROUP BY s.lang, s.source
), shares AS (
    SELECT t.lang, t.source, k.term, coalesce(counted.c, 0) AS c,
           1 + (1000000000 * (coalesce(counted.c, 0) + 5)::HUGEINT) // (t.n + 5 * v)::HUGEINT AS p,
           1 + (1000000000 * (k.c + 5)::HUGEINT) // (langs.n + 5 * v)::HUGEINT AS q
    FROM totals AS t JOIN kept AS k ON k.lang = t.lang JOIN langs ON langs.lang = t.lang
    LEFT JOIN counted ON counted.lang = t.lang AND counted.source = t.source AND counted.term = k.term
), pairs AS (
    SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value
    FROM sources AS a JOIN sources AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN shares AS x ON x.lang = a.lang AND x.source = a.source
    LEFT JOIN shares AS y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term
    GROUP BY a.lang, a.source, b.source
), valued AS (
    SELECT lang, source, 'pair' AS part, item, value FROM pairs
    UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE c > 0 AND p > q
), ranked AS (
    SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM valued
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
""",
    "op13_merkle_manifest": r"""
WITH RECURSIVE parts AS (
    SELECT row_number() OVER () AS row, doc_id, source, text,
           coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
           || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
           -- the crc32, bit by bit: a byte is put in, and eight times a bit is shifted out
           list_reduce(list_concat([4294967295], flatten(list_transform(
               string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
               lambda crc, step: CASE WHEN step >= 0 THEN xor(crc, step)
                                      ELSE xor(crc >> 1, CASE WHEN crc & 1 = 1 THEN 3988292384 ELSE 0 END) END) & 1 AS bit
    FROM documents
), digests AS (
    SELECT row, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
           sha256(head || coalesce(strlen(said) || ':' || said, '-')) AS claimed
    FROM (SELECT *, CASE WHEN bit = 1 THEN replace(text, chr(10), '') ELSE text END AS said FROM parts) AS p
), leaves AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY source) AS n
    FROM digests
), tree(source, level, i, d, n) AS (
    SELECT source, 0, i, leaf, n FROM leaves
    UNION ALL
    SELECT source, level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3
    FROM tree WHERE n > 1 GROUP BY source, level, i // 3, n
), heads AS (
    SELECT source, d AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1
), top(level, i, d, n) AS (
    SELECT 0, i, subroot, n FROM heads
    UNION ALL
    SELECT level + 1, i // 3, sha256(string_agg(d, '' ORDER BY i)), (n + 2) // 3 FROM top WHERE n > 1 GROUP BY level, i // 3, n
), way(row, source, level, i, n, d, beside) AS (
    SELECT row, source, 0, i, n, claimed, '' FROM leaves
    UNION ALL
    SELECT w.row, w.source, w.level + 1, w.i // 3, (w.n + 2) // 3,
           sha256(string_agg(CASE WHEN t.i = w.i THEN w.d ELSE t.d END, '' ORDER BY t.i)),
           w.beside || coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i <> w.i), '')
    FROM way AS w JOIN tree AS t ON t.source IS NOT DISTINCT FROM w.source AND t.level = w.level AND t.i // 3 = w.i // 3
    WHERE w.n > 1 GROUP BY w.row, w.source, w.level, w.i, w.n, w.d, w.beside
), onward(row, source, level, i, n, d, beside) AS (
    SELECT w.row, w.source, 0, h.i, h.n, w.d, w.beside FROM way AS w JOIN heads AS h ON h.source IS NOT DISTINCT FROM w.source WHERE w.n = 1
    UNION ALL
    SELECT w.row, w.source, w.level + 1, w.i // 3, (w.n + 2) // 3,
           sha256(string_agg(CASE WHEN t.i = w.i THEN w.d ELSE t.d END, '' ORDER BY t.i)),
           w.beside || coalesce(string_agg(t.d, '' ORDER BY t.i) FILTER (t.i <> w.i), '')
    FROM onward AS w JOIN top AS t ON t.level = w.level AND t.i // 3 = w.i // 3
    WHERE w.n > 1 GROUP BY w.row, w.source, w.level, w.i, w.n, w.d, w.beside
)
SELECT l.doc_id, l.leaf, h.subroot, top.d AS root, sha256(o.beside) AS proof_sha256, o.d AS folded_root, o.d = top.d AS verified
FROM onward AS o JOIN leaves AS l ON l.row = o.row JOIN heads AS h ON h.source IS NOT DISTINCT FROM l.source
JOIN top ON top.n = 1 WHERE o.n = 1
""",
}
