"""The registered queries of the operators, over whole tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from string import Template

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orbweave.llm import html_layout, jaccard_join, jpeg_media, language_id, length_histogram, packing, prefix_bpe, prefix_trie, quality_rules, sharding, spelling_variants, tensored_minhash, token_files

TOKENIZER = "word_bpe_49k.json"


def tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def held_out(id_column: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves 0 modulo 5."""
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(documents(spark, sf_dir), tokenizer())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = quality_rules.with_policy(quality_rules.ledger(documents(spark, sf_dir)))
    return table.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "bits")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    found = language_id.predict(docs, language_id.fit(docs.where(~held_out())))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = token_files.read_token_files(spark, token_files.write_token_files(documents(spark, sf_dir), tokenizer()))
    return rows.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return length_histogram.with_suffix_sums(length_histogram.histogram(length_histogram.document_lengths(documents(spark, sf_dir), tokenizer())))


def op6_html_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_layout.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(documents(spark, sf_dir), words=4, percent=85)


def op8_jpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jpeg_media.decode_media(jpeg_media.encode_media(documents(spark, sf_dir)))
    return found.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), 8)


def op10_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = prefix_bpe.round_trip(documents(spark, sf_dir), tokenizer())
    return rows.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(documents(spark, sf_dir))


def op12_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tensored_minhash.minhash_components(documents(spark, sf_dir), words=3, percent=85)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_packing, op2_quality_rules, op3_language_id, op4_token_files, op5_length_histogram, op6_html_layout, op7_jaccard_join, op8_jpeg_media, op9_sharding, op10_prefix_bpe, op11_spelling_variants, op12_tensored_minhash, op13_prefix_trie)
    return {f.__name__: f for f in found}


_WORD = r"[^\x20\x09-\x0D]+"

QUALITY_SQL = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows) WHERE c > 1
), gaps AS (
  SELECT doc_id, least(8, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 8)) AS n FROM twice
), repeats AS (
  SELECT doc_id, sum(n) AS n FROM gaps GROUP BY doc_id
), m AS (
  SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
    len(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')))::BIGINT AS n_lines,
    len(list_distinct(list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}'))))::BIGINT AS n_lines_once,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')))::BIGINT AS n_upper,
    (length(t) - length(translate(t, '!', '')))::BIGINT AS n_exclaims
  FROM w LEFT JOIN repeats r ON w.doc_id = r.doc_id
), b AS (
  SELECT *, n_lines - n_lines_once AS n_dup_lines,
    (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 10 * n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 4 AND 100 * (n_lines - n_lines_once) > 30 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 20 * n_words THEN 32 ELSE 0 END
    + CASE WHEN 100 * n_upper > 40 * word_chars THEN 64 ELSE 0 END
    + CASE WHEN 100 * n_exclaims > 30 * n_words THEN 128 ELSE 0 END)::BIGINT AS bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (bits & 3) <> 0 AS base_failed, bits = 0 AS kept, bits FROM b
"""

#: A table of crc32's steps by byte, and crc32 of a string's bytes by it.
_CRC_TABLE = """crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS c FROM range(256) r(i))
)"""


def _crc(text: str) -> str:
    return f"""xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda x: ('0x' || x)::BIGINT)),
      lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))::BIGINT"""


_JUMP = """
  SELECT doc_id, coalesce(max(CASE WHEN j < {n} THEN j END), 0)::INTEGER AS shard FROM walk GROUP BY doc_id
"""

SHARDING_SQL = rf"""
WITH RECURSIVE walk AS (
  SELECT doc_id, (CASE WHEN doc_id < 0 THEN doc_id::HUGEINT + 18446744073709551616 ELSE doc_id::HUGEINT END) AS k, 0::BIGINT AS j FROM documents
  UNION ALL
  SELECT doc_id, k2, floor((j + 1)::DOUBLE * (2147483648.0::DOUBLE / ((k2 // 8589934592) + 1)::DOUBLE))::BIGINT
  FROM (SELECT doc_id, j, (k * 2862933555777941757 + 1) % 18446744073709551616 AS k2 FROM walk WHERE j < 9)
), s8 AS ({_JUMP.format(n=8)}), s9 AS ({_JUMP.format(n=9)}),
{_CRC_TABLE}, sums AS (
  SELECT doc_id, (octet_length(encode(coalesce(text, ''))) + 1)::BIGINT AS size,
    {_crc("coalesce(text, '')")} AS text_crc32
  FROM documents, crc_table
)
SELECT d.doc_id, d.size, d.text_crc32, 'key' AS law, s8.shard, row_number() OVER (PARTITION BY s8.shard ORDER BY d.doc_id) - 1 AS slot, s9.shard AS grown_shard
FROM sums d JOIN s8 ON d.doc_id = s8.doc_id JOIN s9 ON d.doc_id = s9.doc_id
"""

_COMPONENTS_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + $more), ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - $more, 1) + 1)) AS i FROM w WHERE len(ws) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM w
  UNION
  SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a
)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.m AS component_id$kept
FROM w LEFT JOIN n ON w.doc_id = n.doc_id JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) r ON r.a = w.doc_id
"""

JACCARD_SQL = Template(_COMPONENTS_SQL).substitute(more=3, kept="")
MINHASH_SQL = Template(_COMPONENTS_SQL).substitute(more=2, kept=", w.doc_id = r.m AS kept")

SPELLING_SQL = rf"""
WITH RECURSIVE {_CRC_TABLE}, r AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  GROUP BY ALL
), c AS (
  SELECT run, n, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM r, crc_table
), w AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM c)
  GROUP BY word HAVING sum(n) >= 5 AND length(word) >= 6
), less AS (
  SELECT word, n, i, left(word, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS i FROM w)
), near AS (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM less a JOIN w b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM less a JOIN w b ON a.rest = b.word
), best AS (
  SELECT word, n, count(*) AS n_near, first(other ORDER BY other_n DESC, encode(other)) AS other, max(other_n) AS other_n FROM near GROUP BY word, n
), f AS (
  SELECT w.word, CASE WHEN other_n >= 5 * w.n THEN other END AS form, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 5 * w.n THEN other_n END AS form_n
  FROM w LEFT JOIN best ON w.word = best.word
), path AS (
  SELECT word, word AS at FROM f UNION SELECT path.word, f.form FROM path JOIN f ON f.word = path.at WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, p.at AS root, f.n, f.n_near::BIGINT AS n_near, f.form_n
FROM f JOIN path p ON p.word = f.word JOIN f g ON g.word = p.at AND g.form IS NULL
"""

TRIE_SQL = rf"""
WITH {_CRC_TABLE}, own AS (
  SELECT conv_id, coalesce(text, '') AS text, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn_hash,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS place
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_crc("conv_id::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own), crc_table
), turns AS (
  SELECT c.conv_id, o.place, o.text, o.turn_hash FROM convs c JOIN own o ON o.conv_id = c.base AND o.place <= c.h
  UNION ALL SELECT c.conv_id, o.place, o.text, o.turn_hash FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.place > c.h
), prefixes AS (
  SELECT conv_id, row_number() OVER w AS depth, string_agg(turn_hash, '') OVER w AS prefix, length(text) AS chars FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY place)
  UNION ALL SELECT conv_id, 0, '', 0 FROM convs
), ends AS (
  SELECT prefix, lower(sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id))) AS hash FROM (SELECT conv_id, max_by(prefix, depth) AS prefix FROM prefixes GROUP BY conv_id) GROUP BY prefix
), nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars, left(prefix, greatest(length(prefix) - 64, 0)) AS parent FROM prefixes GROUP BY prefix, depth
), kids AS (SELECT parent AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY parent
), below AS (
  SELECT a.prefix, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum((b.n_convs - 1) * b.chars) AS saved
  FROM nodes a JOIN nodes b ON starts_with(b.prefix, a.prefix) LEFT JOIN kids k ON k.prefix = b.prefix GROUP BY a.prefix
)
SELECT a.conv_id, a.depth, CASE WHEN a.depth > 0 THEN p.conv_id END AS parent_conv_id, a.n_convs, coalesce(k.n, 0)::BIGINT AS n_children, b.n_leaves::BIGINT AS n_leaves,
  b.saved::BIGINT AS saved_tokens, coalesce(e.hash, lower(sha256(''))) AS ends_sha256
FROM nodes a JOIN nodes p ON p.prefix = a.parent JOIN below b ON b.prefix = a.prefix LEFT JOIN kids k ON k.prefix = a.prefix LEFT JOIN ends e ON e.prefix = a.prefix
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": QUALITY_SQL, "op9_sharding": SHARDING_SQL, "op7_jaccard_join": JACCARD_SQL, "op11_spelling_variants": SPELLING_SQL, "op12_tensored_minhash": MINHASH_SQL, "op13_prefix_trie": TRIE_SQL}
