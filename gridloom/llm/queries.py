"""The ten operators as queries over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from gridloom.llm import chat, media, mixing, near_dedup, packing, quality, substring, url_filter, warc, winnow

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_byte_convnet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_order_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP4_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages
), d AS (
  SELECT *, translate(upper(concat(
      lpad(to_base(('0x' || s[1:10])::BIGINT, 32), 8, '0'), lpad(to_base(('0x' || s[11:20])::BIGINT, 32), 8, '0'),
      lpad(to_base(('0x' || s[21:30])::BIGINT, 32), 8, '0'), lpad(to_base(('0x' || s[31:40])::BIGINT, 32), 8, '0'))),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
    max(page_id) OVER (PARTITION BY h) AS largest
  FROM p
)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, payload_digest,
       CASE WHEN page_id < largest THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < largest THEN largest END AS refers_to
FROM d
"""


def op7_url_gbdt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's URL holds the number of the document that it shows; that document's label is the URL's."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    model = url_filter.train(pages, table(spark, sf_dir, "labels"), key=url_filter.document_number(F.col("url")))
    return url_filter.judge(pages, model).select("page_id", "host", "path", "rule", "verdict", "score")


def op5_wav_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = media.store(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = media.fingerprint(stored, keep=("doc_id", "n_bytes"))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "times", "codes")


def op6_cube_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.sample(table(spark, sf_dir, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies")


def op8_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.neighbours(table(spark, sf_dir, "documents"))


def op9_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = F.array_join(F.transform("loss_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["length"].cast("string"))), ",")
    return chat.rotate(table(spark, sf_dir, "conversations")).select("conv_id", "speaker", "n_turns", "rendered", spans.alias("loss_spans"))


OP9_SQL = r"""
WITH t AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, role IS NULL AS nameless, coalesce(text, '') AS text FROM conversations
), who AS (
  SELECT DISTINCT conv_id, role AS speaker FROM t WHERE NOT nameless
), e AS (
  SELECT *, replace(replace(text, '<\', '<\\'), '<|', '<\|') || '<|end|>' || chr(10) AS body,
         replace(replace(replace(replace(role, '<\', '<\\'), '<|', '<\|'), '|\', '|\\'), '|>', '|\>') AS name
  FROM t
), p AS (
  SELECT e.*, speaker, NOT nameless AND role = speaker AS own,
         CASE WHEN NOT nameless AND role = speaker THEN '<|assistant|>' || chr(10) ELSE '<|user name=' || name || '|>' || chr(10) END AS head
  FROM e JOIN who ON e.conv_id IS NOT DISTINCT FROM who.conv_id
), q AS (
  SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, speaker ORDER BY turn NULLS FIRST, role, text, nameless) - length(body) AS start
  FROM p
)
SELECT conv_id, speaker, count(*) AS n_turns,
       string_agg(head || body, '' ORDER BY turn NULLS FIRST, role, text, nameless) AS rendered,
       coalesce(string_agg(start::BIGINT || ':' || length(body), ',' ORDER BY turn NULLS FIRST, role, text, nameless) FILTER (own), '') AS loss_spans
FROM q GROUP BY conv_id, speaker
"""


def op10_anchor_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.dedup(table(spark, sf_dir, "documents")))


OP10_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w
), win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS s FROM p WHERE i + 12 <= len(ws)
), least AS (
  SELECT s, min(doc_id) AS d FROM win GROUP BY s
), gone AS (
  SELECT DISTINCT win.doc_id, win.i + k AS i
  FROM win JOIN least USING (s), (SELECT unnest(range(0, 13)) AS k)
  WHERE least.d < win.doc_id
), kept AS (
  SELECT p.doc_id, p.i, p.ws[p.i] AS word FROM p ANTI JOIN gone ON p.doc_id = gone.doc_id AND p.i = gone.i
), joined AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY i) AS t FROM kept GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN joined USING (doc_id)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_retrieval_packing": op1_retrieval_packing,
        "op2_byte_convnet": op2_byte_convnet,
        "op3_order_minhash_dedup": op3_order_minhash_dedup,
        "op4_warc_index": op4_warc_index,
        "op5_wav_media": op5_wav_media,
        "op6_cube_mixing": op6_cube_mixing,
        "op7_url_gbdt": op7_url_gbdt,
        "op8_winnowing": op8_winnowing,
        "op9_perspective_rotation": op9_perspective_rotation,
        "op10_anchor_substring_dedup": op10_anchor_substring_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_warc_index": OP4_SQL,
        "op9_perspective_rotation": OP9_SQL,
        "op10_anchor_substring_dedup": OP10_SQL,
    }
