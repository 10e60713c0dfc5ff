"""The queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression_quality, decontaminate, fingerprints, jaccard_join, language_id, main_text, mixing, quotations, url_filter, warc
from .common import table


def fold(modulus: int) -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(modulus))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of `pages` judged: by the longest rule that fits, else by models of other sites. A null url has empty host and path."""
    return url_filter.filter_urls(table(spark, sf_dir, "pages"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents`, and the same edited with the next one, fingerprinted. A null text is empty."""
    return fingerprints.neighbours(table(spark, sf_dir, "documents"))


def op3_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of `documents` scored, by labels of rows outside the held-out fold. A null text is empty; a null doc_id is not held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    model = compression_quality.train(docs, labels.where(fold(5) != 0))
    scored = compression_quality.score(docs, model, ["doc_id"])
    score = F.col("quality_score")
    return scored.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), score.alias("score"), (score >= compression_quality.KEEP).cast("int").alias("predicted"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws from all of `documents` by source, with the budget of all their words. Texts without words are never drawn."""
    return mixing.mix(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of `pages` archived and read back; sizes and digests come from the payloads read. A null html is empty."""
    read = warc.read_warc(warc.write_warc(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text of `documents`, learned outside the held-out fold. A null doc_id is not held out and teaches."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(docs.where(F.coalesce(fold(4), F.lit(-1)) != 2))
    guessed = language_id.predict(docs.select("doc_id", "text"), model)
    return guessed.select("doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of `documents` linked by three-word shingles at 0.9, with their numbers of links. A null doc_id links nothing."""
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"), k=3, percent=90)


def op8_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every row of `pages`; empty for null html."""
    return main_text.extract_main_text(table(spark, sf_dir, "pages"))


def op9_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`conversations` without quotations, every message with what it replies to and its place in that order."""
    return quotations.link_quotations(table(spark, sf_dir, "conversations"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and item of `benchmark` that overlap, with the best stretch."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_url_filter, op2_fingerprints, op3_compression_quality, op4_mixing, op5_warc, op6_language_id, op7_jaccard_join, op8_main_text,
        op9_quotations, op10_decontaminate,
    )
}

SQL = {
    "op4_mixing": f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS source, len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM documents
), c AS (SELECT * FROM d WHERE n_tokens > 0),
s AS (SELECT source, sum(n_tokens)::DOUBLE AS tokens FROM c GROUP BY source),
b AS (SELECT sum(tokens) AS total, count(*) AS n, min(tokens) AS least FROM s),
e(i, lo, hi) AS (
  SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      (SELECT ln(sum(pow(tokens / total, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(tokens / total, (lo + hi) / 2) * ln(tokens / total)) / sum(pow(tokens / total, (lo + hi) / 2))
         < {mixing.ENTROPY} * ln(max(n)) FROM s, b) AS ok FROM e WHERE i < 45)
), a1 AS (SELECT hi AS alpha FROM e WHERE i = 45),
r(i, lo, hi) AS (
  SELECT 0, alpha, 1.0::DOUBLE FROM a1
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      (SELECT max(total) * pow(max(least) / max(total), (lo + hi) / 2) / sum(pow(tokens / total, (lo + hi) / 2)) / max(least) <= {mixing.EPOCHS} FROM s, b) AS ok FROM r WHERE i < 45)
), a AS (
  SELECT round(CASE WHEN (SELECT n FROM b) < 2 THEN 1.0
    WHEN (SELECT max(total) * pow(max(least) / max(total), (SELECT alpha FROM a1)) / sum(pow(tokens / total, (SELECT alpha FROM a1))) / max(least) FROM s, b) <= {mixing.EPOCHS} THEN (SELECT alpha FROM a1)
    ELSE (SELECT hi FROM r WHERE i = 45) END, 6) AS alpha
), p AS (
  SELECT source, tokens, floor(total * pow(tokens / total, alpha) / round((SELECT sum(pow(tokens / total, (SELECT alpha FROM a))) FROM s, b), 9)) AS part FROM s, b, a
), w AS (SELECT source, floor(part / tokens)::BIGINT AS whole, (part - floor(part / tokens) * tokens)::BIGINT AS rest FROM p),
x AS (
  SELECT doc_id, source, epoch, whole, rest, n_tokens, md5(concat_ws('|', source, coalesce(doc_id::VARCHAR, ''), epoch::VARCHAR, '{mixing.SEED}')) AS order_key
  FROM c JOIN w USING (source), unnest(range(0, whole + 1)) AS u(epoch)
), l AS (
  SELECT *, sum(n_tokens) OVER (PARTITION BY source, epoch, order_key[1:{mixing.DIGITS}] ORDER BY order_key) AS inner_sum,
    sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY order_key[1:{mixing.DIGITS}]) AS upto,
    sum(n_tokens) OVER (PARTITION BY source, epoch, order_key[1:{mixing.DIGITS}]) AS size FROM x
)
SELECT doc_id, source, epoch, order_key[1:{mixing.DIGITS}] AS block, order_key, n_tokens::BIGINT AS n_tokens FROM l
WHERE epoch < whole OR upto <= rest OR (upto - size < rest AND inner_sum <= rest - upto + size)
""",
    "op5_warc": f"""
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
  CASE WHEN big AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN big AND page_id <> last THEN last END AS refers_to
FROM (SELECT page_id, h, strlen(h) >= {warc.SMALL} AS big, max(page_id) OVER (PARTITION BY h) AS last
      FROM (SELECT page_id, coalesce(html, '') AS h FROM pages))
""",
    "op7_jaccard_join": """
WITH RECURSIVE t AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN w ELSE w[i:i + 2] END AS g FROM t, unnest(range(1, greatest(len(w) - 1, 2))) AS u(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM s a JOIN s b USING (g) JOIN n p ON p.doc_id = a.doc_id JOIN n q ON q.doc_id = b.doc_id
  WHERE a.doc_id <> b.doc_id GROUP BY 1, 2, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))
), r(x, y) AS (SELECT doc_id, doc_id FROM t UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x)
SELECT t.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(y) FROM r WHERE r.x = t.doc_id) AS component_id, (SELECT count(*) FROM l WHERE l.x = t.doc_id) AS n_links
FROM t LEFT JOIN n USING (doc_id)
""",
    "op9_quotations": r"""
WITH RECURSIVE m AS (
  SELECT row_number() OVER () AS row, conv_id, turn, role, string_split(regexp_replace(coalesce(text, ''), '\r\n', chr(10), 'g'), chr(10)) AS raw FROM conversations
), x AS (
  SELECT row, conv_id, turn, role, i, regexp_extract(line, '^[ \t]*((?:>[ \t]?)+)', 1) AS marks, regexp_replace(line, '^[ \t]*((?:>[ \t]?)+)', '') AS said
  FROM (SELECT row, conv_id, turn, role, unnest(raw) AS line, generate_subscripts(raw, 1) AS i FROM m)
), l AS (
  SELECT *, length(regexp_replace(marks, '[^>]', '', 'g')) AS level, trim(regexp_replace(lower(said), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS norm FROM x
), k AS (
  SELECT *, lag(level) OVER w AS before, level = 0 AND NOT (regexp_matches(said, '(?i)^\s*(on\b.*\bwrote|.{0,200}\bwrote|.{0,200}\bwrites):\s*$') AND coalesce(lead(level) OVER w, 0) > 0) AS own
  FROM l WINDOW w AS (PARTITION BY row ORDER BY i)
), g AS (SELECT *, sum((before IS NULL OR before <> level)::INT) OVER (PARTITION BY row ORDER BY i) AS run FROM k),
t AS (
  SELECT row, conv_id, turn, role, sum((level > 0)::INT)::BIGINT AS n_quoted, coalesce(string_agg(said, chr(10) ORDER BY i) FILTER (WHERE own), '') AS kept, string_agg(said, chr(10) ORDER BY i) AS whole,
    trim(regexp_replace(lower(coalesce(string_agg(said, ' ' ORDER BY i) FILTER (WHERE own), '')), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS own
  FROM g GROUP BY ALL
), p AS (
  SELECT DISTINCT conv_id, turn, level, norm AS said FROM g WHERE level > 0 AND norm <> '' AND conv_id IS NOT NULL AND turn IS NOT NULL
  UNION
  SELECT conv_id, turn, level, said FROM (
    SELECT conv_id, turn, level, trim(regexp_replace(lower(string_agg(said, ' ' ORDER BY i)), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS said
    FROM g WHERE level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL GROUP BY row, conv_id, turn, level, run) WHERE said <> ''
), o AS (
  SELECT conv_id, said, min(turn) AS origin FROM (
    SELECT g.conv_id, g.norm AS said, g.turn FROM g JOIN t USING (row) WHERE g.own AND t.own <> '' UNION ALL SELECT conv_id, own, turn FROM t WHERE own <> '') GROUP BY 1, 2
), s AS (
  SELECT p.*, CASE WHEN o.origin < p.turn THEN o.origin ELSE (SELECT min(t.turn) FROM t WHERE t.conv_id = p.conv_id AND contains(' ' || t.own || ' ', ' ' || p.said || ' ')) END AS origin
  FROM p LEFT JOIN o USING (conv_id, said)
), v AS (SELECT conv_id, turn, origin, min(level) AS level, count(*) AS n FROM s WHERE origin < turn GROUP BY 1, 2, 3),
e AS (SELECT conv_id, turn, origin AS reply_to FROM v QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY level, n DESC, origin DESC) = 1),
r AS (
  SELECT conv_id, turn, reply_to, reply_to AS root, 1 AS depth FROM e
  UNION ALL SELECT r.conv_id, r.turn, r.reply_to, e.reply_to, r.depth + 1 FROM r JOIN e ON e.conv_id = r.conv_id AND e.turn = r.root
), f AS (SELECT conv_id, turn, reply_to, arg_max(root, depth) AS thread_root, max(depth) AS depth FROM r GROUP BY 1, 2, 3)
SELECT t.conv_id, t.turn, t.role, CASE WHEN n_quoted > 0 THEN regexp_replace(kept, '^\s+|\s+$', '', 'g') ELSE whole END AS text, n_quoted, reply_to, coalesce(thread_root, t.turn) AS thread_root,
  coalesce(depth, 0)::BIGINT AS depth, printf('%016x.%016x', xor(coalesce(thread_root, t.turn), -9223372036854775808), xor(t.turn, -9223372036854775808)) AS order_key
FROM t LEFT JOIN f ON f.conv_id = t.conv_id AND f.turn = t.turn
""",
    "op10_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM documents),
i AS (SELECT item_id, w, len(w)::INT AS size, least(len(w), 20)::INT AS need FROM (SELECT item_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM benchmark) WHERE len(w) > 0),
x AS (SELECT doc_id, unnest(w) AS tok, generate_subscripts(w, 1) AS pos FROM d),
y AS (SELECT item_id, size, need, unnest(w) AS tok, generate_subscripts(w, 1) AS place FROM i),
m AS (SELECT doc_id, item_id, size, need, pos - place AS shift, place FROM x JOIN y USING (tok)),
s AS (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY place RANGE BETWEEN CURRENT ROW AND need - 1 FOLLOWING) AS n FROM m)
SELECT doc_id, item_id, max(n)::INT AS matched, need AS compared, size AS item_tokens FROM s GROUP BY doc_id, item_id, need, size HAVING max(n) * 100 >= need * 80
""",
}
