"""The operators as queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from landshift.llm import alignment, chat, divergence, exactdup, images, langid, mixing, neardup, pieces, quality, secrets, substrings, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(_table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exactdup.exact_groups(_table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def _held_out(n: int, at: int):
    """Whether a row was not learned from; one without an id never is."""
    return F.coalesce(_remainder(n) == at, F.lit(True)).alias("held_out")


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.learned(docs.where(_remainder(3) != 1).select("text", "lang"))
    found = langid.predicted(docs.select("doc_id", "text"), model)
    return found.select("doc_id", _held_out(3, 1), "lang_pred", "score")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = _table(spark, sf_dir, "labels").where(_remainder(5) != 0)
    found = quality.scored(docs, quality.learned(docs, labels))
    return found.select("doc_id", _held_out(5, 0), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(_table(spark, sf_dir, "documents"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(_table(spark, sf_dir, "documents"))


def op6_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no images: pictures are drawn from vectors, with edited copies (negative ids) to be found."""
    return images.copy_classes(images.vector_media(_table(spark, sf_dir, "embeddings")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergences(_table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7, whose turns look like control strings."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return chat.chat_report(rows.unionByName(hard))


QUERIES = {
    "op13_chat": op13_chat,
    "op12_alignment": op12_alignment,
    "op11_divergence": op11_divergence,
    "op6_image_copies": op6_image_copies,
    "op3_near_dedup": op3_near_dedup,
    "op10_substring_dedup": op10_substring_dedup,
    "op2_quality": op2_quality,
    "op7_language_id": op7_language_id,
    "op9_sentencepiece": op9_sentencepiece,
    "op8_mixing": op8_mixing,
    "op1_warc": op1_warc,
    "op4_secrets": op4_secrets,
    "op5_exact_dedup": op5_exact_dedup,
}


def _spans_sql(name: str, pattern: str, kind: int, keep: str) -> str:
    """Spans of a pattern's matches in SQL: lengths of the matches and of what lies between them alternate."""
    quoted = pattern.replace("'", "''")
    return f"""
        {name} AS (SELECT doc_id, text, start, start + length(hit) AS finish, {kind} AS kind FROM (
            SELECT doc_id, text, hits[i] AS hit, groups[i] AS value,
                   CAST(list_sum(list_transform(gaps[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1:i-1], lambda h: length(h))), 0) AS BIGINT) AS start
            FROM (SELECT doc_id, text, regexp_extract_all(text, '{quoted}') AS hits, regexp_extract_all(text, '{quoted}', {2 if kind == 0 else 0}) AS groups, string_split_regex(text, '{quoted}') AS gaps FROM doc) a,
                 LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i) b) c WHERE {keep})"""


_OP4_SQL = (
    "WITH doc AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),"
    + ",".join([
        _spans_sql("assign", secrets.ASSIGN, 0, "length(value) >= 6"),
        _spans_sql("access", secrets.ACCESS, 1, "length(hit) >= 20"),
        _spans_sql("hexes", secrets.HEX, 2, "true"),
        _spans_sql("bare", secrets.BARE_KEY, 3, "regexp_matches(hit, '[a-z]') AND regexp_matches(hit, '[A-Z]') AND regexp_matches(hit, '[0-9]')"),
        _spans_sql("endpoint", secrets.ENDPOINT, 4, "true"),
    ])
    + f"""
    , base AS (SELECT * FROM assign UNION ALL SELECT * FROM access UNION ALL SELECT * FROM hexes),
    placed AS (SELECT *, len(string_split_regex(substr(text, 1, start), '\n[\x20\t\r]*\n')) AS scope FROM (SELECT * FROM base UNION ALL SELECT * FROM bare UNION ALL SELECT * FROM endpoint) q),
    beside AS (SELECT * FROM placed p WHERE kind <> 1 AND EXISTS (SELECT 1 FROM placed i WHERE i.kind = 1 AND i.doc_id = p.doc_id AND i.scope = p.scope AND abs(i.start - p.start) <= {secrets.MAX_GAP})),
    linked AS (SELECT * FROM beside b WHERE kind = 3 OR (kind = 4 AND EXISTS (SELECT 1 FROM beside s WHERE s.kind <> 4 AND s.doc_id = b.doc_id AND s.scope = b.scope))),
    named AS (SELECT doc_id, start, kind, concat((['assign', 'access', 'hex', 'key', 'endpoint'])[kind + 1], ':', start, ':', finish) AS line
              FROM (SELECT doc_id, start, finish, kind FROM base UNION ALL SELECT doc_id, start, finish, kind FROM linked) u)
    SELECT d.doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
           sha256(coalesce(string_agg(line, ',' ORDER BY start, kind) FILTER (WHERE kind <= 2), '')) AS base_sha256, coalesce(string_agg(line, ',' ORDER BY start, kind), '') AS spans
    FROM documents d LEFT JOIN named n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""
)

_OP10_SQL = r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ 	-
]+') AS words FROM documents),
    win AS (SELECT doc_id, p, array_to_string(words[p:p+19], ' ') AS k FROM d, LATERAL (SELECT unnest(range(1, len(words) - 18)) AS p) q),
    again AS (SELECT doc_id, p FROM win QUALIFY row_number() OVER (PARTITION BY k ORDER BY doc_id, p) > 1),
    gone AS (SELECT DISTINCT doc_id, p + i AS p FROM again, range(0, 20) r(i)),
    word AS (SELECT doc_id, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS p FROM d),
    kept AS (SELECT w.doc_id, count(*) AS n, string_agg(w.w, ' ' ORDER BY w.p) AS t FROM word w WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = w.doc_id AND g.p = w.p) GROUP BY w.doc_id)
    SELECT d.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept k ON k.doc_id = d.doc_id"""

_OP11_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    kept AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
    g AS (SELECT DISTINCT lang, source FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY ALL),
    dense AS (SELECT lang, source, term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
    gp AS (SELECT lang, source, term, n, 1 + (1000000000 * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS p FROM dense WINDOW w AS (PARTITION BY lang, source)),
    lang_n AS (SELECT lang, term, sum(n) AS n FROM dense GROUP BY ALL),
    lp AS (SELECT lang, term, 1 + (1000000000 * (n + 1)) // (sum(n) OVER w + count(*) OVER w) AS q FROM lang_n WINDOW w AS (PARTITION BY lang)),
    pv AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p) AS value FROM gp a JOIN gp b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
    term AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q)) // q AS value FROM gp JOIN lp USING (lang, term) WHERE n > 0 AND p > q)
    SELECT lang, source, part, item, value::BIGINT AS value, rank FROM (SELECT *, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term)) q
    WHERE part = 'pair' OR rank <= 200"""

_OP13_SQL = r"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
    e AS (SELECT *, 14 + length(regexp_replace(role, '(\\|### |:\n|</turn>)', '\\\1', 'g')) + length(regexp_replace(text, '(\\|### |:\n|</turn>)', '\\\1', 'g')) AS chars FROM t),
    g AS (SELECT conv_id, count(*) AS n_turns, sum(chars)::BIGINT AS formatted_chars,
        string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn NULLS FIRST, role, text) AS said,
        coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss FROM e GROUP BY conv_id)
    SELECT conv_id, n_turns, sha256(said) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g"""

ORACLES = {
    "op13_chat": _OP13_SQL,
    "op11_divergence": _OP11_SQL,
    "op4_secrets": _OP4_SQL,
    "op10_substring_dedup": _OP10_SQL,
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
        t AS (SELECT h AS th, max(page_id) AS top FROM p WHERE n >= 1000 GROUP BY h)
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN top IS NULL OR top = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN top <> page_id THEN top END AS refers_to
        FROM p LEFT JOIN t ON h = th AND n >= 1000
    """,
    "op5_exact_dedup": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)
    """,
}
