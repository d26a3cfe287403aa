"""Registered queries of the corpus operators: thin steps that map the given tables to each
operator's own fields and its results back, with the SQL check where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from molq.llm.decontaminate import UNITS, find_leaks
from molq.llm.fertility import fertility_verdicts
from molq.llm.lang_id import fit_language_centroids, predict_language
from molq.llm.manifest import dataset_manifest
from molq.llm.near_dedup import near_duplicate_entities
from molq.llm.phrase_dedup import remove_recurring_runs
from molq.llm.pieces import encode_and_decode
from molq.llm.quality_fm import fit_quality, score_quality
from molq.llm.spelling import feature_words, name_variants
from molq.llm.token_counts import token_counts
from molq.llm.url_filter import filter_urls
from molq.llm.vector_dedup import near_duplicate_profiles
from molq.llm.warc import read_archives, write_archives
from molq.plans.fixtures import table

WORDS = r"[^\x20\x09-\x0D]+"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cell_id"), F.col("text").alias("features"))
    return near_duplicate_entities(entities, percent=85).withColumnRenamed("cell_id", "doc_id")


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
         ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS g
  FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY 1),
shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM shared JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * shared.c >= 85 * (a.c + b.c - shared.c)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, b.y FROM reach r JOIN sym b ON r.y = b.x),
low AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.c, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN low USING (doc_id) LEFT JOIN n USING (doc_id)
"""



def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entities = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("cell_id"), F.col("text").alias("features"))
    return remove_recurring_runs(entities).select(
        F.col("cell_id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept_features", 256).alias("kept_sha256"))


OP2_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
owner AS (SELECT g, min(doc_id) AS low FROM win GROUP BY 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN owner USING (g) WHERE low < doc_id),
words AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS p, unnest(ws) AS word FROM w),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS c FROM gone GROUP BY 1)
SELECT w.doc_id, len(ws) AS n_words, coalesce(c, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""


# The rules of the URL query.
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return filter_urls(table(spark, sf_dir, "pages"), rules, "page_id", "url")


OP3_SQL = r"""
WITH rules AS (SELECT * FROM (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                              ('net', '/es/', 'block'), ('net', '/fr/', 'block')) r(h, p, v)),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages)),
fits AS (
  SELECT page_id, h || p AS rule, v, row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC, length(h) DESC) AS k
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM parts LEFT JOIN (SELECT * FROM fits WHERE k = 1) USING (page_id)
"""


def op4_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    profiles = table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("cell_id"), "embedding", F.col("label").alias("cell_type"))
    return near_duplicate_profiles(profiles, cosine=0.93).withColumnRenamed("cell_id", "vec_id")


OP4_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM links GROUP BY 1),
reach AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
low AS (SELECT x AS vec_id, min(y) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM low LEFT JOIN n USING (vec_id)
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    listing = write_archives(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return read_archives(listing).select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS n FROM pages),
g AS (SELECT html, max(page_id) AS low FROM p WHERE n >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, n AS payload_bytes, sha1(p.html) AS payload_digest,
       CASE WHEN low <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN low <> page_id THEN low END AS refers_to
FROM p LEFT JOIN g USING (html)
"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts as pieces and back: number of pieces, a hash of the id list, and whether the text came back."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("dataset"), F.col("text").alias("provenance"))
    coded = encode_and_decode(docs)
    return coded.select(F.col("dataset").alias("doc_id"), F.size("piece_ids").cast("long").alias("n_pieces"),
                        F.xxhash64("piece_ids").alias("ids_hash"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts read from the prefix table of every whole text, with the characters that 2048 tokens hold."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("dataset"), F.col("text").alias("provenance"))
    return token_counts(docs).withColumnRenamed("dataset", "doc_id")



def _fold(parts: int):
    return F.crc32(F.col("doc_id").cast("string")) % parts


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(_fold(3) != 1), "doc_id", "text", "quality", "n_chars", allow_empty=True)
    return score_quality(docs, model, "doc_id", "text", "n_chars").select(
        "doc_id", (_fold(3) == 1).alias("held_out"), "score", "predicted")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_centroids(docs.where(_fold(4) != 2), "doc_id", "text", "lang", allow_empty=True)
    return predict_language(docs, model, "doc_id", "text").select(
        "doc_id", (_fold(4) == 2).alias("held_out"), "lang_pred", "score")



def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def _marked_sql(source: str) -> str:
    """The canonical line of ``source`` (k, text) in SQL, step by step."""
    return f"""
SELECT k, trim(regexp_replace(lower(CASE WHEN regexp_matches(t3, '[0-9]') THEN regexp_replace(regexp_replace(regexp_replace(
    regexp_replace(t3, '([0-9])[.,]([0-9])', '\\1_\\2', 'g'), '([0-9])[.,]([0-9])', '\\1_\\2', 'g'), '[0-9][0-9_]*', ' ⟦n⟧\\0 ', 'g'),
    '(?i)(⟦n⟧[0-9_]+ +)({'|'.join(UNITS)})( |[.,;:?!)]|$)', '\\1⟦u⟧\\2\\3', 'g') ELSE t3 END), '[^\\p{{L}}\\p{{N}}\\p{{M}}⟦⟧_]+', ' ', 'g')) AS line
FROM (SELECT k, CASE WHEN contains(t2, '⟦a⟧') THEN regexp_replace(regexp_replace(
          t2, '(⟦a⟧\\p{{Lu}}\\p{{Ll}}+) (\\p{{Lu}}\\p{{Ll}}+)', '\\1_\\2', 'g'),
          '(⟦a⟧\\p{{Lu}}\\p{{Ll}}+_\\p{{Ll}}+) ⟦a⟧(\\p{{Lu}}\\p{{Ll}}+)', '\\1_\\2', 'g') ELSE t2 END AS t3
      FROM (SELECT k, regexp_replace(regexp_replace(coalesce(text, ''), '[⟦⟧]', ' ', 'g'),
                   '([^.!?:\\s] )(\\p{{Lu}}\\p{{Ll}}+)', '\\1⟦a⟧\\2', 'g') AS t2 FROM {source}))
""".replace("\\\\", "\\")


def _leaks_sql() -> str:
    docs, items = (_marked_sql(f"(SELECT {k} AS k, text FROM {t})") for k, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    tokens = """SELECT k, list_filter(string_split(line, ' '), lambda w: w <> '') AS words,
      list_filter(string_split(regexp_replace(line, '⟦(.)⟧[^ ]*', '⟦\\1⟧', 'g'), ' '), lambda w: w <> '') AS bare FROM """.replace("\\\\", "\\")
    windows = "SELECT k, i, bare[i:i + 7] AS win FROM (SELECT k, bare, unnest(range(1, len(bare) - 6)) AS i FROM {0} WHERE len(bare) >= 8)"
    return f"""
WITH d AS ({tokens} ({docs})), b AS ({tokens} ({items})),
dw AS ({windows.format('d')}),
bw AS (SELECT * FROM ({windows.format('b')}) WHERE len(list_filter(win, lambda w: NOT starts_with(w, '⟦'))) >= 5),
size AS (SELECT k, count(*) AS item_windows FROM bw GROUP BY 1),
hit AS (SELECT DISTINCT dw.k AS doc, bw.k AS item, dw.i - bw.i AS shift, bw.i AS pos FROM dw JOIN bw USING (win)),
slot AS (SELECT DISTINCT doc, item, shift, b.words[p] AS x, d.words[p + shift] AS y
         FROM (SELECT DISTINCT doc, item, shift, unnest(range(pos, pos + 8)) AS p FROM hit) JOIN b ON b.k = item JOIN d ON d.k = doc
         WHERE starts_with(b.bare[p], '⟦')),
bad AS (SELECT doc, item, shift FROM slot GROUP BY ALL HAVING count(*) > count(DISTINCT x)),
diff AS (SELECT doc, item, shift, max(x <> y) AS differs FROM slot GROUP BY ALL),
good AS (SELECT hit.*, coalesce(differs, false) AS differs FROM hit ANTI JOIN bad USING (doc, item, shift) LEFT JOIN diff USING (doc, item, shift)),
merged AS (SELECT doc, item, count(DISTINCT pos) AS n, min(differs) AS r FROM good GROUP BY ALL)
SELECT doc AS doc_id, item AS item_id, CAST(n AS INTEGER) AS n_windows, CAST(item_windows AS INTEGER) AS item_windows, r AS reparameterised
FROM merged JOIN size ON size.k = item WHERE n >= 0.5 * item_windows
"""


def _crc32_sql(text: str) -> str:
    """Unsigned crc32 of the UTF-8 bytes of ``text`` in SQL: the register takes eight shifts for every byte."""
    octets = f"list_transform(range(1, CAST(length(hex({text})) / 2 AS INTEGER) + 1), lambda i: CAST('0x' || hex({text})[2 * i - 1:2 * i] AS UBIGINT))"
    byte = ("list_reduce(list_concat([xor(c, b)], list_transform(range(8), lambda k: CAST(0 AS UBIGINT))), "
            "lambda x, y: xor(x >> 1, (x & 1) * 3988292384))")
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS UBIGINT)], {octets}), lambda c, b: {byte}), 4294967295)"


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a leaf; where 7 divides the crc32 of doc_id, n_chars is claimed one too high."""
    claimed = F.when(F.crc32(F.col("doc_id").cast("string")) % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return dataset_manifest(table(spark, sf_dir, "documents"), "doc_id", "lang",
                            ["doc_id", "source", "lang", "n_chars", "text"], {"n_chars": claimed})


def _manifest_sql() -> str:
    def field(name: str) -> str:
        return f"coalesce(CAST(strlen(CAST({name} AS VARCHAR)) AS VARCHAR) || ':' || CAST({name} AS VARCHAR), '-')"

    def leaf(n_chars: str) -> str:
        return f"sha256({' || '.join(map(field, ('doc_id', 'source', 'd.lang')))} || {field(n_chars)} || {field('text')})"

    # A tree per k; the upper tree, over the subroots, is the one of k = -1.
    climb = """
  SELECT k, lvl + 1 AS lvl, pos // 2 AS pos, sha256(string_agg(h, '' ORDER BY pos)) AS h, CAST(ceil(any_value(n) / 2.0) AS BIGINT) AS n
  FROM {0} WHERE n > 1 GROUP BY k, lvl, pos // 2"""
    walk = """
  SELECT w.doc_id, w.k, w.lvl + 1, w.pos // 2, w.sibs || coalesce(s.h, ''),
         sha256(CASE WHEN s.h IS NULL THEN w.f WHEN w.pos % 2 = 1 THEN s.h || w.f ELSE w.f || s.h END), w.n
  FROM {0} w JOIN {1} t ON t.k = w.k AND t.lvl = w.lvl AND t.pos = w.pos AND t.n > 1
  LEFT JOIN {1} s ON s.k = w.k AND s.lvl = w.lvl AND s.pos = xor(w.pos, 1)"""
    crc = _crc32_sql("CAST(doc_id AS VARCHAR)")
    return f"""
WITH RECURSIVE groups AS (SELECT lang, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS k, count(*) AS n FROM documents GROUP BY lang),
leaves AS (
  SELECT doc_id, g.k, g.n, row_number() OVER (PARTITION BY g.k ORDER BY doc_id) - 1 AS pos, {leaf('n_chars')} AS leaf,
         {leaf(f'(CASE WHEN {crc} % 7 = 0 THEN n_chars + 1 ELSE n_chars END)')} AS claimed
  FROM documents d JOIN groups g ON d.lang IS NOT DISTINCT FROM g.lang),
low AS (SELECT k, 0 AS lvl, pos, leaf AS h, n FROM leaves UNION ALL {climb.format('low')}),
subroots AS (SELECT k, h FROM low WHERE n = 1),
high AS (SELECT CAST(-1 AS BIGINT) AS k, 0 AS lvl, k AS pos, h, (SELECT count(*) FROM groups) AS n FROM subroots UNION ALL {climb.format('high')}),
top AS (SELECT h FROM high WHERE n = 1),
under AS (SELECT doc_id, k, 0 AS lvl, pos, '' AS sibs, claimed AS f, n FROM leaves UNION ALL {walk.format('under', 'low')}),
ended AS (SELECT * FROM under QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1),
over_ AS (SELECT doc_id, CAST(-1 AS BIGINT) AS k, 0 AS lvl, k AS pos, sibs, f, n FROM ended UNION ALL {walk.format('over_', 'high')}),
last AS (SELECT * FROM over_ QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY lvl DESC) = 1)
SELECT doc_id, leaf, subroots.h AS subroot, top.h AS root, sha256(sibs) AS proof_sha256, f AS folded_root, f = top.h AS verified
FROM leaves JOIN last USING (doc_id) JOIN subroots ON subroots.k = leaves.k CROSS JOIN top
"""


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = feature_words(table(spark, sf_dir, "documents"), "doc_id", "text", min_length=6, min_count=5, slip_one_in=199)
    return name_variants(words, ratio=5).withColumnRenamed("feature_name", "word")


OP12_SQL = f"""
WITH RECURSIVE runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS c
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY 1, 2),
hashed AS (SELECT doc_id, run, c, {_crc32_sql("(CAST(doc_id AS VARCHAR) || ':' || run)")} AS h FROM runs),
slipped AS (SELECT c, CASE WHEN h % 199 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM slipped WHERE length(word) >= 6 GROUP BY 1 HAVING sum(c) >= 5),
cut AS (SELECT word, i, word[:i] || word[i + 2:] AS rest FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT word, rest FROM cut WHERE rest IN (SELECT word FROM words)
  UNION SELECT rest, word FROM cut WHERE rest IN (SELECT word FROM words)),
best AS (SELECT a AS word, count(*) AS n_near, arg_min(b, (-n, b)) AS form, max(n) AS form_n FROM pairs JOIN words ON words.word = b GROUP BY 1),
judged AS (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * n THEN form END AS form, CASE WHEN form_n >= 5 * n THEN form_n END AS form_n
  FROM words LEFT JOIN best USING (word)),
steps AS (SELECT word, word AS here, 0 AS k FROM judged
          UNION ALL SELECT s.word, j.form, k + 1 FROM steps s JOIN judged j ON j.word = s.here AND j.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, k) AS root FROM steps GROUP BY 1)
SELECT word, form, root, n, n_near, form_n FROM judged JOIN roots USING (word)
"""


def op13_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility_verdicts(table(spark, sf_dir, "documents"), "doc_id", "text", "lang").withColumn(
        "outside", F.concat_ws(",", "outside"))


QUERIES = {
    "op1_minhash_near_dedup": op1_minhash_near_dedup,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_embedding_near_dedup": op4_embedding_near_dedup,
    "op5_warc": op5_warc,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_quality": op7_quality,
    "op8_token_counts": op8_token_counts,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_manifest": op11_manifest,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_quality_rules": op13_quality_rules,
}
SQL = {
    "op1_minhash_near_dedup": OP1_SQL,
    "op2_substring_dedup": OP2_SQL,
    "op3_url_filter": OP3_SQL,
    "op4_embedding_near_dedup": OP4_SQL,
    "op5_warc": OP5_SQL,
    "op10_decontamination": _leaks_sql(),
    "op11_manifest": _manifest_sql(),
    "op12_spelling_variants": OP12_SQL,
}
