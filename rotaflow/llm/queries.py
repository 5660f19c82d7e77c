"""The queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from rotaflow.llm import ann, chat, language, lexical, merge_bpe, minhash, packing, quality, repair, sharding, substring, unigram, warc
from rotaflow.llm.common import tokenizer
from rotaflow.session import fresh_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    path = fresh_path(spark, "llm-archives")
    warc.write_archives(warc.plan_records(_table(spark, folder, "pages")), path)
    return warc.pages_of(warc.read_archives(spark, path)).drop("payload")


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.render(_table(spark, folder, "conversations"))


def op3_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.neighbours(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, 10)


def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    found = sharding.shard(_table(spark, folder, "documents"), 8)
    return found.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")})


def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return unigram.token_counts(_table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


def op6_merge_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return merge_bpe.encode(_table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"), with_ids=False)


def op7_minhash(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    return minhash.near_duplicates(docs).select("doc_id", F.col("_class").alias("class_id"), F.col("_keeper").alias("keeper"))


def op8_packing(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return packing.pack(packing.pieces(docs, tokenizer("byte_bpe_50k.json")), 1024)


def op9_substring(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.deduplicate(_table(spark, folder, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    trees = quality.train(docs, _table(spark, folder, "labels"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(docs, trees).select("doc_id", *[f"quality.{c}" for c in counts])


def op11_language(spark: SparkSession, folder: str) -> DataFrame:
    return language.identify(_table(spark, folder, "documents"))


def op12_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.repair_damaged(_table(spark, folder, "conversations"))


def op13_lexical(spark: SparkSession, folder: str) -> DataFrame:
    return lexical.search(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"), 10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": op1_warc,
    "op2_chat": op2_chat,
    "op3_ann": op3_ann,
    "op4_sharding": op4_sharding,
    "op5_token_counts": op5_token_counts,
    "op6_merge_bpe": op6_merge_bpe,
    "op7_minhash": op7_minhash,
    "op8_packing": op8_packing,
    "op9_substring": op9_substring,
    "op10_quality": op10_quality,
    "op11_language": op11_language,
    "op12_repair": op12_repair,
    "op13_lexical": op13_lexical,
    "pipeline": corpus_pipeline.run,
}

ORACLE: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, COALESCE(html, '') AS body, CAST(strlen(COALESCE(html, '')) AS BIGINT) AS size, sha256(COALESCE(html, '')) AS digest FROM pages
        ), m AS (SELECT *, MIN(page_id) OVER (PARTITION BY digest) AS first FROM p)
        SELECT page_id, size AS payload_bytes, digest AS payload_digest,
               CASE WHEN size >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN size >= 100 AND page_id <> first THEN first END AS refers_to
        FROM m
    """,
    "op2_chat": """
        WITH t AS (
            SELECT conv_id, turn, COALESCE(role, '') AS role, COALESCE(text, '') AS text FROM conversations GROUP BY ALL
        ), n AS (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS position FROM t
        ), c AS (
            SELECT conv_id, LIST(md5(role || chr(1) || text) ORDER BY position) AS turns, COUNT(*) AS n_turns FROM n GROUP BY conv_id
        ), k AS (
            SELECT a.conv_id, a.n_turns FROM c a WHERE NOT EXISTS (
                SELECT 1 FROM c b WHERE b.turns[1] = a.turns[1] AND list_slice(b.turns, 1, a.n_turns) = a.turns
                AND (b.n_turns > a.n_turns OR b.n_turns = a.n_turns AND b.conv_id < a.conv_id))
        ), r AS (
            SELECT n.conv_id, n_turns, position, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS piece FROM n JOIN k USING (conv_id)
        )
        SELECT conv_id, n_turns, position, piece,
               CAST(COALESCE(SUM(LENGTH(piece)) OVER (PARTITION BY conv_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS place
        FROM r
    """,
    # all lists are visited at the size of the comparison, so what is found is exact
    "op3_ann": r"""
        WITH v AS (
            SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
              AND len(list_filter(embedding, lambda e: e <> 0)) > 0
        ), s AS (
            SELECT q.vec_id AS query_id, p.vec_id, list_transform(list_zip(q.x, p.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])) AS squares
            FROM v q JOIN v p ON q.vec_id % 100 = 0 AND p.vec_id <> q.vec_id
        ), t AS (  -- eight running sums, added in pairs
            SELECT query_id, vec_id, list_transform(range(1, 9), lambda j: list_reduce(list_slice(squares, j, len(squares), 8), lambda a, b: a + b)) AS r FROM s
        ), d AS (
            SELECT query_id, vec_id, sqrt(((r[1] + r[2]) + (r[3] + r[4])) + ((r[5] + r[6]) + (r[7] + r[8]))) AS score FROM t
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS rank FROM d) WHERE rank <= 10
    """,
    "op7_minhash": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), s AS (
            SELECT doc_id, array_to_string(list_slice(words, i, i + 4), ' ') AS shingle
            FROM (SELECT doc_id, words, UNNEST(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
        ), b AS (SELECT doc_id, shingle, COUNT(*) AS c FROM s GROUP BY ALL),
        z AS (SELECT doc_id, SUM(c) AS size FROM b GROUP BY doc_id),
        o AS (
            SELECT x.doc_id AS a, y.doc_id AS b, SUM(least(x.c, y.c)) AS common FROM b x JOIN b y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id GROUP BY ALL
        ), e AS (
            SELECT a, b FROM o JOIN z p ON p.doc_id = a JOIN z q ON q.doc_id = b WHERE 100 * common >= 80 * (p.size + q.size - common)
        ), r AS (
            SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a
        )
        SELECT a AS doc_id, MIN(b) AS class_id, a = MIN(b) AS keeper FROM r GROUP BY a
    """,
    "op9_substring": r"""
        WITH w AS (
            SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
        ), win AS (
            SELECT doc_id, i, array_to_string(list_slice(words, i, i + 19), ' ') AS s
            FROM (SELECT doc_id, words, UNNEST(range(1, len(words) - 18)) AS i FROM w)
        ), ranked AS (
            SELECT doc_id, i, ROW_NUMBER() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win
        ), gone AS (
            SELECT doc_id, LIST(DISTINCT p) AS places FROM (SELECT doc_id, UNNEST(range(i, i + 20)) AS p FROM ranked WHERE r > 1) GROUP BY doc_id
        )
        SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(COALESCE(len(places), 0) AS BIGINT) AS n_removed,
               sha256(array_to_string(CASE WHEN places IS NULL THEN words ELSE list_select(words,
                   list_filter(range(1, len(words) + 1), lambda p: NOT list_contains(places, p))) END, ' ')) AS kept_sha256
        FROM w LEFT JOIN gone USING (doc_id)
    """,
    "op12_repair": r"""
        WITH RECURSIVE raw AS (
            SELECT conv_id, turn, COALESCE(role, ' ') AS role, COALESCE(text, ' ') AS text,
                   concat(COALESCE(CAST(conv_id AS VARCHAR), ' '), ':', COALESCE(CAST(turn AS VARCHAR), ' ')) AS name
            FROM conversations
        ), kinds AS (
            SELECT name, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(name, ''), lambda c: CAST(ord(c) AS BIGINT))),
                       lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]),
                           lambda x, zero: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS kind
            FROM (SELECT DISTINCT name FROM raw)
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   UNNEST(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy
            FROM raw JOIN kinds USING (name) WHERE kind <> 0
        ), numbered AS (
            SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, left(role, 1) AS initial,
                   rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS filled
            FROM damaged
        ), faulty AS (
            SELECT *, CASE WHEN filled = '' THEN 'blank' WHEN ROW_NUMBER() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(filled, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                   COALESCE(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), FALSE) AS illegal
            FROM numbered
        ), counts AS (
            SELECT conv_id, COALESCE(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (illegal) AS illegal, max(i) AS n
            FROM faulty GROUP BY conv_id
        ), inserts (state, after, cost, audit, rows) AS (
            VALUES (0, 0, 0, '', []), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 2, 'I', ['user:']), (1, 2, 2, 'I', ['user:']),
                   (2, 3, 2, 'I', ['assistant:']), (3, 2, 2, 'I', ['user:']), (0, 3, 4, 'II', ['user:', 'assistant:']), (1, 3, 4, 'II', ['user:', 'assistant:'])
        ), steps (state, initial, after) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        paths AS (
            SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, {'cost': CAST(0 AS BIGINT), 'audit': '', 'rows': CAST([] AS VARCHAR[])} AS best FROM counts
            UNION ALL
            SELECT conv_id, i, state, min(best) AS best FROM (
                WITH open AS (
                    SELECT p.conv_id, p.i, g.after AS state, p.best.cost + g.cost AS cost, p.best.audit || g.audit AS audit, list_concat(p.best.rows, g.rows) AS rows
                    FROM paths p JOIN inserts g ON p.state = g.state
                ), here AS (
                    SELECT o.*, f.role, f.text, f.initial, f.fault FROM open o JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND f.i = o.i + 1
                )
                SELECT conv_id, i + 1 AS i, state, {'cost': cost + 3, 'audit': audit || 'D', 'rows': rows} AS best FROM here
                UNION ALL
                SELECT conv_id, here.i + 1, s.after, {'cost': cost + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'audit': audit || 'K', 'rows': list_append(rows, role || ':' || text)}
                FROM here JOIN steps s ON s.state = here.state AND s.initial = here.initial WHERE fault IN ('', 'truncated')
                UNION ALL
                SELECT conv_id, here.i + 1, s.after, {'cost': cost + 2 + CASE WHEN fault = 'truncated' THEN 1 ELSE 0 END, 'audit': audit || 'R',
                       'rows': list_append(rows, CASE s.initial WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text)}
                FROM here JOIN steps s ON s.state = here.state AND s.initial <> 's' WHERE fault IN ('', 'truncated')
            ) GROUP BY conv_id, i, state
        ), ended AS (
            SELECT p.conv_id, min({'cost': p.best.cost + g.cost, 'audit': p.best.audit || g.audit, 'rows': list_concat(p.best.rows, g.rows)}) AS best
            FROM paths p JOIN counts c ON c.conv_id IS NOT DISTINCT FROM p.conv_id AND c.n = p.i JOIN inserts g ON g.state = p.state AND g.after IN (0, 3)
            GROUP BY p.conv_id
        )
        SELECT a.conv_id, COALESCE(c.gaps, 0) AS gaps, COALESCE(c.blank, 0) AS blank, COALESCE(c.duplicate, 0) AS duplicate, COALESCE(c.truncated, 0) AS truncated,
               COALESCE(c.illegal, 0) AS illegal, COALESCE(e.best.cost, 0) AS cost, COALESCE(e.best.audit, '') AS audit,
               sha256(COALESCE(array_to_string(e.best.rows, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM a.conv_id
        LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM a.conv_id
    """,
    "op13_lexical": r"""
        WITH d AS (
            SELECT ROW_NUMBER() OVER () AS row, doc_id,
                   regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), q AS (
            SELECT DISTINCT item_id, UNNEST(regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), c AS (SELECT COUNT(*) AS docs, CAST(SUM(len(terms)) AS BIGINT) AS total FROM d WHERE len(terms) > 0),
        f AS (SELECT row, doc_id, n, term, COUNT(*) AS tf FROM (SELECT row, doc_id, len(terms) AS n, UNNEST(terms) AS term FROM d) GROUP BY ALL),
        w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * COUNT(*) + 1))) AS BIGINT) AS weight FROM f, c GROUP BY term),
        s AS (
            SELECT item_id, doc_id, row, CAST(SUM(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score
            FROM q JOIN w USING (term) JOIN f USING (term), c GROUP BY item_id, doc_id, row
        ), r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
        SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 10
    """,
}
