"""Registered queries of the training-data operators, with DuckDB SQL where it can say them."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from semsift.llm.chat_format import format_conversations, read_back
from semsift.llm.common import read_table
from semsift.llm.exact_dedup import exact_dedup
from semsift.llm.jaccard_join import jaccard_links
from semsift.llm.line_dedup import line_dedup
from semsift.llm.mixing import label_domains, mix
from semsift.llm.packing import pack
from semsift.llm.phrases import collocations
from semsift.llm.prefix_trie import conversation_paths, prefix_trie
from semsift.llm.quality_rules import MAX_HOST_RATE, quality_verdicts
from semsift.llm.secrets import scan_secrets
from semsift.llm.suffix_tree_lm import suffix_tree_scores
from semsift.llm.token_counts import count_tokens
from semsift.llm.url_filter import derived_log, judge_captures

TOKENIZER = "byte_bpe_50k.json"


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owner: the document's source; repository: its source and language."""
    docs = read_table(spark, sf_dir, "documents").withColumn("repo", F.concat_ws("/", "source", "lang"))
    return scan_secrets(docs, repo_col="repo", owner_col="source")[0]


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP2_SQL = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h
           FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, t.h AS text_sha256
FROM t JOIN g USING (h)
"""


def op3_suffix_tree_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held out: documents whose id, as text, has a CRC-32 of remainder 2 modulo 7.
    The tree is as deep as the texts and its divergence test make it."""
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2
    return suffix_tree_scores(read_table(spark, sf_dir, "documents"), held)


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_links(read_table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = r"\### Assistant: </turn> ok"
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)],
                                 "conv_id long, turn long, role string, text string")
    return read_back(format_conversations(turns.unionByName(more), public_tokenizers.path(TOKENIZER)))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fetch day: a day of 2024 by page id; lists: a log derived from the pages' own hosts."""
    pages = read_table(spark, sf_dir, "pages").select(
        "page_id", "url", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(366)).cast("int"))
        .alias("day"))
    judged = judge_captures(pages, derived_log(pages))
    return judged.select("page_id", F.col("day").cast("string").alias("fetch_day"), F.col("_u_host").alias("host"),
                         F.coalesce(F.array_join("_u_matches", ","), F.lit("")).alias("matches"),
                         F.col("_u_matches").isNotNull().alias("blocked"))


OP6_SQL = r"""
WITH caps AS (
  SELECT page_id, DATE '2024-01-01' + (((page_id % 366) + 366) % 366)::INT AS day,
         nullif(regexp_replace(lower(regexp_extract(url,
           '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1)), '[.]+$', ''), '') AS host
  FROM pages),
parts AS (SELECT DISTINCT host, string_split(host, '.') AS p FROM caps WHERE host IS NOT NULL),
above AS (SELECT host, i, array_to_string(p[i:], '.') AS entry
          FROM (SELECT host, p, unnest(range(1, len(p) + 1)) AS i FROM parts)),
listed AS (SELECT entry, ('0x' || substr(md5(entry), 1, 6))::INT AS n
           FROM (SELECT DISTINCT entry FROM above WHERE i <= 2)),
entries AS (SELECT entry, n, CASE WHEN n % 5 = 0 THEN 'spam' ELSE 'adult' END AS list, (n // 5) % 240 AS d
            FROM listed WHERE n % 5 < 2),
log AS (
  SELECT list, entry, d + 0 AS shift, true AS adds FROM entries
  UNION ALL SELECT list, entry, d + 10, true FROM entries WHERE n % 3 = 1
  UNION ALL SELECT list, entry, d + 40, false FROM entries WHERE n % 3 = 1
  UNION ALL SELECT list, entry, d + 20, false FROM entries WHERE n % 3 = 2
  UNION ALL SELECT list, entry, d + 60, true FROM entries WHERE n % 3 = 2
  UNION ALL SELECT list, entry, d + 60, false FROM entries WHERE n % 3 = 2
  UNION ALL SELECT list, entry, d + 90, true FROM entries WHERE n % 3 = 2),
days AS (SELECT list, entry, DATE '2024-01-01' + shift::INT AS day, bool_and(adds) AS active
         FROM log GROUP BY ALL),
spans AS (SELECT *, lead(day) OVER (PARTITION BY list, entry ORDER BY day) AS to_day FROM days),
hits AS (
  SELECT c.host, c.day, array_to_string(list_sort(list(DISTINCT s.list || ':' || s.entry)), ',') AS matches
  FROM (SELECT DISTINCT host, day FROM caps) c JOIN above a ON c.host = a.host
  JOIN spans s ON s.entry = a.entry AND s.active AND s.day <= c.day AND (s.to_day IS NULL OR c.day < s.to_day)
  GROUP BY c.host, c.day)
SELECT c.page_id, strftime(c.day, '%Y-%m-%d') AS fetch_day, c.host,
       coalesce(h.matches, '') AS matches, h.matches IS NOT NULL AS blocked
FROM caps c LEFT JOIN hits h ON c.host = h.host AND c.day = h.day
"""


#: Target token shares of the domains that the labels tell apart.
MIX_WEIGHTS = {"clean": 0.85, "poor": 0.12, "toxic": 0.03}


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = mix(docs, label_domains(read_table(spark, sf_dir, "labels")), MIX_WEIGHTS, carry=["doc_id"])
    names = sorted(MIX_WEIGHTS)
    return out.select("doc_id", F.col("_m_tokens").alias("n_tokens"),
                      *[F.get("_m_posterior", F.lit(k)).alias(f"p_{d}") for k, d in enumerate(names)],
                      F.col("_m_rate").alias("rate"), F.col("_m_copies").alias("copies"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("_l_lines").alias("n_lines"), F.col("_l_deleted").alias("n_deleted"),
                      F.col("_l_runs").alias("deleted_runs"), F.col("_l_emptied").alias("emptied"), "text")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_verdicts(read_table(spark, sf_dir, "documents"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
total AS (SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang),
grams AS (
  SELECT lang, m, ws[i:i + m - 1] AS gram
  FROM (SELECT lang, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM w, (SELECT unnest(range(1, 6)) AS m))),
f AS (SELECT lang, m, array_to_string(gram, ' ') AS phrase, any_value(gram) AS gram, count(*) AS f
      FROM grams GROUP BY lang, m, array_to_string(gram, ' ') HAVING count(*) >= 100),
inner_ AS (
  SELECT lang, array_to_string(gram[i:i + k - 1], ' ') AS phrase, max(f) AS longer
  FROM (SELECT lang, gram, f, m, k, unnest(range(1, m - k + 2)) AS i
        FROM (SELECT lang, gram, f, m, unnest(range(2, m)) AS k FROM f WHERE m > 2)) GROUP BY ALL),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, k, x.f AS l, y.f AS r, t.n,
         (1000::HUGEINT * c.f * t.n) // (x.f::HUGEINT * y.f) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) c
  JOIN f x ON x.lang = c.lang AND x.phrase = array_to_string(c.gram[1:k], ' ')
  JOIN f y ON y.lang = c.lang AND y.phrase = array_to_string(c.gram[k + 1:], ' ')
  JOIN total t ON t.lang = c.lang
  LEFT JOIN inner_ i ON i.lang = c.lang AND i.phrase = c.phrase
  WHERE i.longer IS NULL OR 100 * i.longer < 100 * c.f),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank,
       phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM best QUALIFY rank <= 2000
"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations open with up to eight turns of the first of their five."""
    turns = read_table(spark, sf_dir, "conversations")
    return prefix_trie(conversation_paths(turns, family=5, openings=9))


#: A turn's digest is chained to the prefix before it; a subtree's sums go over the paths
#: of its nodes' smallest members. CRC-32 is worked out bit by bit.
OP13_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
size AS (SELECT conv_id, count(*) AS n FROM t GROUP BY conv_id),
c AS (
  SELECT conv_id, conv_id - ((conv_id % 5) + 5) % 5 AS base,
         (xor(list_reduce(list_transform(range(length(conv_id::VARCHAR) + 1), lambda i: CASE WHEN i = 0
            THEN 4294967295::UBIGINT ELSE ascii(substr(conv_id::VARCHAR, i::INT, 1))::UBIGINT END),
          lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[],
            lambda x, y: xor(x >> 1, (x & 1::UBIGINT) * 3988292384::UBIGINT))), 4294967295::UBIGINT) % 9)::BIGINT AS h
  FROM size),
r AS (
  SELECT c.conv_id, t.pos AS d, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + t.pos - c.h, t.role, t.text
  FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN size b ON b.conv_id = c.base),
rs AS (SELECT conv_id, max(d) AS last FROM r GROUP BY conv_id),
p AS (
  SELECT conv_id, 0::BIGINT AS d, '' AS key, 0::BIGINT AS bytes FROM c
  UNION ALL
  SELECT r.conv_id, r.d, sha256(p.key || sha256(r.role) || sha256(r.text)), strlen(r.text)::BIGINT
  FROM p JOIN r ON r.conv_id = p.conv_id AND r.d = p.d + 1),
nodes AS (
  SELECT p.d, p.key, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(p.bytes) AS bytes,
         string_agg(CASE WHEN p.d = coalesce(rs.last, 0) THEN p.conv_id END, ',' ORDER BY p.conv_id) AS ends
  FROM p LEFT JOIN rs ON rs.conv_id = p.conv_id GROUP BY p.d, p.key),
up AS (
  SELECT x.*, q.key AS parent_key FROM nodes x LEFT JOIN p q ON q.conv_id = x.conv_id AND q.d = x.d - 1),
kids AS (SELECT d - 1 AS d, parent_key AS key, count(*) AS n FROM up WHERE d > 0 GROUP BY ALL),
sums AS (
  SELECT p.d, p.key, count(*) FILTER (k.n IS NULL) AS n_leaves, sum((x.n_convs - 1) * x.bytes) AS saved
  FROM nodes x LEFT JOIN kids k ON k.d = x.d AND k.key = x.key JOIN p ON p.conv_id = x.conv_id AND p.d <= x.d
  GROUP BY p.d, p.key)
SELECT x.conv_id, x.d AS depth, q.conv_id AS parent_conv_id, x.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves,
       s.saved::BIGINT AS saved_tokens, sha256(coalesce(x.ends, '')) AS ends_sha256
FROM up x JOIN sums s ON s.d = x.d AND s.key = x.key LEFT JOIN kids k ON k.d = x.d AND k.key = x.key
LEFT JOIN nodes q ON q.d = x.d - 1 AND q.key = x.parent_key
"""


QUERIES = {
    "op1_secret_scan": op1_secret_scan,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_suffix_tree_lm": op3_suffix_tree_lm,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_chat_format": op5_chat_format,
    "op6_url_filter": op6_url_filter,
    "op7_mixing": op7_mixing,
    "op8_line_dedup": op8_line_dedup,
    "op9_packing": op9_packing,
    "op10_quality_rules": op10_quality_rules,
    "op11_phrases": op11_phrases,
    "op12_token_counts": op12_token_counts,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE = {
    "op2_exact_dedup": OP2_SQL,
    "op6_url_filter": OP6_SQL,
    "op11_phrases": OP11_SQL,
    "op13_prefix_trie": OP13_SQL,
}
