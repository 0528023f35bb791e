"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACELESS, table
from .decontaminate import find_leaks
from .jaccard import jaccard_classes
from .langid import held_out, identify, train_on
from .licenses import SHINGLE, TEMPLATES, scan_licenses
from .lines import dedup_lines
from .mixing import mix_sources
from .neardup import near_duplicates
from .ngrams import score_texts
from .runs import find_runs
from .sharding import assign_shards
from .spelling import count_words, group_spellings, word_runs
from .tokens import count_tokens, load_vocabulary
from .warc import archive_round_trip


#: Vocabulary of the token counts, a parameter of theirs; read where it is and never copied.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def op1_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = archive_round_trip(table(spark, sf_dir, "pages"))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents"))


def op4_crf_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), train_on(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), load_vocabulary(MODEL_FILE)).select("doc_id", "n_tokens", "score")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op9_extendible_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign_shards(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "shard_depth", "shard_prefix", "shard_page")


def op10_bm25_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = word_runs(table(spark, sf_dir, "documents"))
    # misspellings: one code point is gone from some runs
    h = F.crc32(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("word")))
    at = (h % F.length("word")).cast("int")
    cut = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
    return group_spellings(count_words(runs.select(F.when(h % 31 == 0, cut).otherwise(F.col("word")).alias("word"))))


def op12_word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # some documents repeat a stretch of their words from one of them to the end
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", "[ \\t-\\r]+"), lambda w: w != "")
    docs = docs.withColumn("g", F.floor(h / 10)).withColumn("words", F.when(h % 10 == 0, words)).withColumn("n", F.size("words"))
    docs = docs.withColumn("a", F.expr("if(n > 0, g % n, 0)")).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    docs = docs.select("doc_id", F.when(F.col("n") > 0, F.expr("array_join(transform(words, (w, i) -> if(i < a, w, words[cast(a + (i - a) % p as int)])), ' ')")).otherwise(F.col("text")).alias("text"))
    found = find_runs(docs)
    best = F.expr("aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> if(b is null or r.length * b.period > b.length * r.period, r, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\n')), '')")
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def op13_backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 != 2
    found = score_texts(table(spark, sf_dir, "documents"), learn)
    # sums of logarithms, whose last digits hang on their order
    return found.withColumns({c: F.round(c, 6) for c in ("base_score", "score")})


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            op1_warc_archive, op2_nn_descent, op3_line_dedup, op4_crf_langid, op5_ngram_jaccard, op6_token_counts, op7_license_scan, op8_poisson_mix, op9_extendible_sharding, op10_bm25_decontamination,
            op11_spelling_variants, op12_word_runs, op13_backoff_scores,
        )
    }


OP8_SQL = """
WITH sizes AS (
  SELECT source, CAST(SUM(COALESCE(length(text), 0)) AS DOUBLE) AS size FROM documents GROUP BY source
), shares AS (
  SELECT source, size, CASE WHEN size > 0 THEN pow(size, 0.7) ELSE 0.0 END AS share FROM sizes
), rates AS (
  SELECT source, CASE WHEN size > 0 THEN share / (SELECT SUM(share) FROM shares) * (SELECT SUM(size) FROM shares) * 1.0 / size ELSE 1.0 END AS rate
  FROM shares
), pmf AS (
  SELECT source, k, exp(k * ln(rate) - rate - lgamma(k + 1.0)) AS p FROM rates, range(0, 300) t(k)
), cdf AS (
  SELECT source, k, SUM(p) OVER (PARTITION BY source ORDER BY k) AS c FROM pmf
), draws AS (
  SELECT *, CAST(CAST(concat('0x', substr(md5(concat('17:', COALESCE(CAST(doc_id AS VARCHAR), concat('null:', md5(COALESCE(text, '')))))), 1, 13)) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM documents
), counts AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT COUNT(*) FROM cdf WHERE cdf.source IS NOT DISTINCT FROM d.source AND cdf.c <= d.u) AS n
  FROM draws d
)
SELECT doc_id, text, lang, source, n_chars, CAST(k AS INTEGER) AS copy_no
FROM counts JOIN range(1, 300) t(k) ON k <= n
"""

OP9_SQL = """
WITH h AS (
  SELECT doc_id, COALESCE(octet_length(encode(text)), 0) AS n_bytes,
         CAST(concat('0x', substr(md5(COALESCE(CAST(doc_id AS VARCHAR), 'null')), 1, 15)) AS BIGINT) AS h
  FROM documents
), at_depth AS (
  SELECT doc_id, n_bytes, d, h >> (60 - d) AS prefix,
         SUM(n_bytes) OVER (PARTITION BY d, h >> (60 - d)) AS bytes,
         MIN(h) OVER (PARTITION BY d, h >> (60 - d)) AS low, MAX(h) OVER (PARTITION BY d, h >> (60 - d)) AS high
  FROM h, range(0, 25) t(d)
)
SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(d AS INTEGER) AS shard_depth, CAST(prefix AS BIGINT) AS shard_prefix, CAST(0 AS BIGINT) AS shard_page
FROM at_depth WHERE bytes <= 1048576 OR low = high
QUALIFY ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY d) = 1
"""


OP1_SQL = """
WITH p AS (
  SELECT page_id, COALESCE(html, '') AS html, sha1(COALESCE(html, '')) AS hex FROM pages
), bits AS (
  SELECT page_id, html, hex, array_to_string(list_transform(range(1, 41), lambda i: list_extract(
    ['0000','0001','0010','0011','0100','0101','0110','0111','1000','1001','1010','1011','1100','1101','1110','1111'],
    strpos('0123456789abcdef', substr(hex, i, 1)))), '') AS b FROM p
), coded AS (
  SELECT page_id, html, hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1
    + 16 * CAST(substr(b, 5 * i + 1, 1) AS INTEGER) + 8 * CAST(substr(b, 5 * i + 2, 1) AS INTEGER) + 4 * CAST(substr(b, 5 * i + 3, 1) AS INTEGER)
    + 2 * CAST(substr(b, 5 * i + 4, 1) AS INTEGER) + CAST(substr(b, 5 * i + 5, 1) AS INTEGER), 1)), '') AS digest,
    MIN(page_id) OVER (PARTITION BY hex) AS first FROM bits
)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM coded
"""


OP2_SQL = """
WITH RECURSIVE e AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), good AS (
  SELECT * FROM e WHERE label IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda v: v IS NULL OR NOT isfinite(v))) = 0 AND len(list_filter(x, lambda v: v <> 0)) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.93
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings
  UNION
  SELECT reach.a, l.b FROM reach JOIN l ON reach.b = l.a
), c AS (
  SELECT a AS vec_id, MIN(b) AS component_id FROM reach GROUP BY a
)
SELECT vec_id, (SELECT COUNT(*) FROM l WHERE l.a = c.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM c
"""

OP3_SQL = """
WITH l AS (
  SELECT doc_id, UNNEST(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents
), b AS (
  SELECT doc_id, line_no, trim(regexp_replace(regexp_replace(line, '([SPACELESS])', ' \\1 ', 'g'), '[ \\t\\r\\f\\v\\x{00A0}]+', ' ', 'g')) AS line FROM l
), w AS (
  SELECT doc_id, line_no, line, string_split(line, ' ') AS words, len(string_split(line, ' ')) AS n FROM b
), d AS (
  SELECT line, ANY_VALUE(words) AS words, ANY_VALUE(n) AS n, MIN((doc_id, line_no)) AS pos FROM w WHERE line <> '' GROUP BY line
), pairs AS (
  SELECT x.line AS line, y.pos AS pos, x.words AS a, y.words AS b, x.n AS n, y.n AS m FROM d x JOIN d y ON x.words[1] = y.words[1] AND x.n >= 5 AND y.n >= 5 AND abs(x.n - y.n) <= 1 AND y.pos < x.pos
  UNION
  SELECT x.line, y.pos, x.words, y.words, x.n, y.n FROM d x JOIN d y ON x.words[-1] = y.words[-1] AND x.n >= 5 AND y.n >= 5 AND abs(x.n - y.n) <= 1 AND y.pos < x.pos
), near AS (
  SELECT line, MIN(pos) AS near_pos FROM pairs
  WHERE CASE WHEN n = m THEN len(list_filter(range(1, n + 1), lambda i: a[i] <> b[i])) <= 1
             WHEN n < m THEN len(list_filter(range(0, n + 1), lambda i: a[1:i] = b[1:i] AND a[i + 1:n] = b[i + 2:m])) > 0
             ELSE len(list_filter(range(0, m + 1), lambda i: a[1:i] = b[1:i] AND b[i + 1:m] = a[i + 2:n])) > 0 END
  GROUP BY line
), f AS (
  SELECT d.line, d.pos, CASE WHEN near.near_pos IS NULL OR d.pos < near.near_pos THEN d.pos ELSE near.near_pos END AS first FROM d LEFT JOIN near USING (line)
)
SELECT w.doc_id, CAST(w.line_no AS INTEGER) AS line_no, NOT COALESCE(f.first < (w.doc_id, w.line_no), FALSE) AS kept,
       CASE WHEN f.first < (w.doc_id, w.line_no) THEN f.first[1] END AS first_doc_id,
       CAST(CASE WHEN f.first < (w.doc_id, w.line_no) THEN f.first[2] END AS INTEGER) AS first_line_no,
       CASE WHEN f.first < (w.doc_id, w.line_no) THEN CASE WHEN f.first = f.pos THEN 0 ELSE 1 END END AS edits
FROM w LEFT JOIN f ON w.line = f.line AND w.line <> ''
""".replace("SPACELESS", SPACELESS)


OP5_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
  FROM (SELECT doc_id, w, UNNEST(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), n AS (
  SELECT doc_id, COUNT(*) AS n FROM s GROUP BY doc_id
), p AS (
  SELECT a.doc_id AS x, b.doc_id AS y, COUNT(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS (
  SELECT x, y FROM p JOIN n nx ON p.x = nx.doc_id JOIN n ny ON p.y = ny.doc_id WHERE c >= 0.8 * (nx.n + ny.n - c) - 1e-9
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT reach.a, l.y FROM reach JOIN l ON reach.b = l.x
)
SELECT doc_id, (SELECT MIN(b) FROM reach WHERE a = doc_id) AS class_id, (SELECT COUNT(*) FROM l WHERE x = doc_id) AS n_links FROM documents
"""

OP7_SQL = (
    "WITH t(license_id, variant, text) AS (VALUES "
    + ", ".join("({})".format(", ".join("'" + x.replace("'", "''") + "'" for x in row)) for row in TEMPLATES)
    + f"""), tw AS (
  SELECT license_id, variant, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM t
), tk AS (
  SELECT *, least(len(w), {SHINGLE}) AS k FROM tw
), ts AS (
  SELECT DISTINCT license_id, variant, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM (SELECT *, UNNEST(range(1, len(w) - k + 2)) AS i FROM tk)
), dw AS (
  SELECT doc_id, list_filter(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents
), ds AS (
  SELECT DISTINCT doc_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
  FROM (SELECT doc_id, w, k, UNNEST(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM tk) WHERE len(w) >= k)
), n AS (
  SELECT license_id, variant, COUNT(*) AS n FROM ts GROUP BY ALL
), held AS (
  SELECT doc_id, license_id, variant, COUNT(*) AS c FROM ds JOIN ts USING (k, g) GROUP BY ALL
)
SELECT doc_id, license_id, variant, CAST(n AS INTEGER) AS n_shingles, c / n AS containment
FROM held JOIN n USING (license_id, variant) WHERE c / n >= 0.8 - 1e-12
"""
)


# The polynomial and the mask of CRC-32. crc has the table of the 256 bytes.
CRC = """
bits(k, i, c) AS (
  SELECT k, 0, k FROM range(256) t(k)
  UNION ALL
  SELECT k, i + 1, CASE WHEN c % 2 = 1 THEN xor(3988292384, c // 2) ELSE c // 2 END FROM bits WHERE i < 8
), crc AS (
  SELECT list(c ORDER BY k) AS t FROM bits WHERE i = 8
)"""


def _crc32(blob: str) -> str:
    """SQL of the CRC-32 of a blob, where crc is in FROM."""
    each = f"list_transform(range(1, octet_length({blob}) + 1), lambda i: CAST(concat('0x', substr(hex({blob}), 2 * i - 1, 2)) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, x: xor(t[CAST(xor(c, x) & 255 AS BIGINT) + 1], c >> 8)))"


OP11_SQL = f"""
WITH RECURSIVE {CRC}, runs AS (
  SELECT doc_id, translate(UNNEST(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents
), blobs AS (
  SELECT w, encode(concat(COALESCE(CAST(doc_id AS VARCHAR), ''), ':', w)) AS b FROM runs
), hashed AS (
  SELECT w, {_crc32("b")} AS h FROM blobs, crc
), cut AS (
  SELECT CASE WHEN h % 31 = 0 THEN concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word FROM hashed
), words AS MATERIALIZED (
  SELECT word, COUNT(*) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING COUNT(*) >= 2
), gaps AS MATERIALIZED (
  SELECT word, n, i, concat(word[1:i - 1], word[i + 1:]) AS g FROM (SELECT word, n, UNNEST(range(1, length(word) + 1)) AS i FROM words) UNION ALL SELECT word, n, 0, word FROM words
), near AS MATERIALIZED (
  SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM gaps a JOIN gaps b USING (g) WHERE a.word <> b.word AND (a.i = b.i OR a.i = 0 OR b.i = 0)
), best AS (
  SELECT word, COUNT(*) AS n_near, arg_max(other, (other_n, -rank)) AS other, MAX(other_n) AS other_n FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY encode(other)) AS rank FROM near) GROUP BY word
), forms AS MATERIALIZED (
  SELECT word, n, COALESCE(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * n THEN other END AS form, CASE WHEN other_n >= 10 * n THEN other_n END AS form_n FROM words LEFT JOIN best USING (word)
), chain(word, root, k) AS (
  SELECT word, word, 0 FROM forms UNION ALL SELECT chain.word, forms.form, k + 1 FROM chain JOIN forms ON chain.root = forms.word WHERE forms.form IS NOT NULL
), roots AS (
  SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


OP12_SQL = f"""
WITH RECURSIVE {CRC}, docs AS (
  SELECT doc_id, list_filter(string_split_regex(COALESCE(text, ''), '[ \\t-\\r]+'), lambda x: x <> '') AS w, encode(CAST(doc_id AS VARCHAR)) AS b FROM documents
), hashed AS (
  SELECT doc_id, w, len(w) AS n, {_crc32("b")} AS h FROM docs, crc
), marked AS (
  SELECT *, CASE WHEN n > 0 AND h % 10 = 0 THEN (h // 10) % n END AS a, 3 + (h // 10) % 8 AS parts FROM hashed
), words AS MATERIALIZED (
  SELECT doc_id, n, i, w[CASE WHEN i >= a THEN a + (i - a) % (1 + (n - a) // parts) ELSE i END + 1] AS w FROM (SELECT *, UNNEST(range(n)) AS i FROM marked)
), equal AS (
  SELECT doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y USING (doc_id, w) WHERE y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (
  SELECT doc_id, q, MIN(i) AS start, COUNT(*) + q AS length FROM (SELECT *, i - ROW_NUMBER() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal) GROUP BY doc_id, q, island
), runs AS MATERIALIZED (
  SELECT doc_id, start, length, MIN(q) AS period FROM islands WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length
), gone AS (
  SELECT DISTINCT doc_id, UNNEST(range(start + period, start + length)) AS i FROM runs
), short AS (
  SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), best AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY CAST(length AS DOUBLE) / period DESC, start, period) AS k FROM runs
), listed AS (
  SELECT doc_id, COUNT(*) AS n_runs, string_agg(concat(start, ',', length, ',', period, chr(10)), '' ORDER BY start, period) AS t FROM runs GROUP BY doc_id
)
SELECT doc_id, COALESCE(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(COALESCE(listed.t, '')) AS runs_sha256, sha256(COALESCE(short.t, '')) AS collapsed_sha256
FROM documents LEFT JOIN listed USING (doc_id) LEFT JOIN short USING (doc_id) LEFT JOIN (SELECT * FROM best WHERE k = 1) USING (doc_id)
"""


OP13_SQL = f"""
WITH RECURSIVE {CRC}, docs AS (
  SELECT doc_id, encode(CAST(doc_id AS VARCHAR)) AS b,
         list_append(list_filter(string_split_regex(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \\t-\\r]+'), lambda x: x <> ''), ' end') AS w
  FROM documents
), split AS (
  SELECT doc_id, w, {_crc32("b")} % 7 = 2 AS held_out FROM docs, crc
), tokens AS MATERIALIZED (
  SELECT doc_id, held_out, UNNEST(w) AS w, UNNEST(list_prepend(' start', w[:-2])) AS h FROM split
), counts AS (
  SELECT w, COUNT(*) AS c FROM tokens WHERE NOT held_out GROUP BY w
), whole AS (
  SELECT CAST(SUM(c) AS BIGINT) AS n, COUNT(*) AS v FROM counts
), heads AS (
  SELECT h, COUNT(*) AS c FROM tokens WHERE NOT held_out GROUP BY h
), pairs AS (
  SELECT h, w, COUNT(*) AS c FROM tokens WHERE NOT held_out GROUP BY h, w
), single AS (
  SELECT doc_id, held_out, h, w, COALESCE(counts.c, 0) AS c, n, v, (greatest(COALESCE(counts.c, 0) - 0.75::DOUBLE, 0) + 0.75::DOUBLE * v / (v + 1)) / n AS p FROM tokens CROSS JOIN whole LEFT JOIN counts USING (w)
), scored AS (
  SELECT doc_id, held_out, s.c, n, v, (COALESCE(pairs.c, 0) + 100::DOUBLE * p) / (COALESCE(heads.c, 0) + 100::DOUBLE) AS p
  FROM single s LEFT JOIN heads USING (h) LEFT JOIN pairs USING (h, w)
)
SELECT doc_id, held_out, COUNT(*) AS n_tokens, COUNT(*) FILTER (c > 0) AS n_known, MIN(n) AS train_tokens,
       ROUND(fsum(log10((c + 1) / (n + v + 1))), 6) AS base_score, ROUND(fsum(log10(p)), 6) AS score
FROM scored GROUP BY doc_id, held_out
"""


def oracle_sql() -> dict[str, str]:
    return {"op13_backoff_scores": OP13_SQL, "op12_word_runs": OP12_SQL, "op11_spelling_variants": OP11_SQL, "op2_nn_descent": OP2_SQL, "op5_ngram_jaccard": OP5_SQL, "op7_license_scan": OP7_SQL, "op3_line_dedup": OP3_SQL, "op1_warc_archive": OP1_SQL, "op8_poisson_mix": OP8_SQL, "op9_extendible_sharding": OP9_SQL}
