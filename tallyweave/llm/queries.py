"""Queries of the operators in this folder, by name, and their SQL where SQL can
express them. Each reads its whole table."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import collocations, decontaminate, hardnegatives, language, licenses, maxent, pieces, pii, quality, simhash, toxicity, triejoin, warc
from tallyweave.llm.common import held_out, materialize

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.with_components(docs).select("doc_id", "fingerprint", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 5, 0)
    found = toxicity.score(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~out))
    return found.select("doc_id", out.alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"), "toxic_spans")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return quality.judge(docs).select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and whether decoding gives the text back."""
    model = pieces.Model.read(pieces.MODEL_PATH)
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = pieces.encode(docs, model, check=True)
    return coded.select("doc_id", F.size("piece_ids").cast("bigint").alias("n_pieces"), "piece_ids", "decoded_sha256", "round_trip")


def op5_maxent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model score of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = held_out(F.col("doc_id"), 7, 2)
    scored, lexicon = maxent.fit_and_score(docs, ~out)
    total = F.lit(lexicon.total).cast("bigint").alias("train_tokens")
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", total, "base_score", F.col("lm_score").alias("score"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    made = materialize(pii.with_candidates(docs).drop("text"))
    found = pii.with_spans(made, pii.fit(pii.count_features(made)))
    counts = [pii.count_of("base_spans", k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)]
    return found.select("doc_id", *counts, F.sha2(pii.listed("base_spans"), 256).alias("base_sha256"), pii.listed("pii_spans").alias("spans"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and templates in every document."""
    found = licenses.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = [F.array_join(c, ",").alias(name) for c, name in (("base_labels", "base_labels"), ("license_labels", "labels"))]
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", *listed, F.col("license_score").alias("score"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    hits = decontaminate.n_hit()
    named = F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", hits.alias("n_hit"), "n_items", named, (hits > 0).alias("contaminated"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages, written to archives and read back."""
    path = warc.archive_path(spark)
    warc.write(_table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.pages_of(warc.read(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = held_out(F.col("doc_id"), 5, 0)
    found = language.identify(docs.select("doc_id", "text"), language.fit(docs, ~out))
    return found.select("doc_id", out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_rejected").alias("rejected"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrases of each language, best first."""
    return collocations.collocations(_table(spark, sf_dir, "documents").select("text", "lang"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every anchor and positive."""
    return hardnegatives.hard_negatives(_table(spark, sf_dir, "embeddings"))


def op13_trie_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingle set size and component of every document."""
    return triejoin.with_components(_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS k, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, size, array_to_string(w[p:p + size - 1], ' ') AS win
  FROM (SELECT item_id, w, least(10, len(w)) AS size, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS p
        FROM item WHERE len(w) > 0)),
place AS (
  SELECT k, p, size, array_to_string(w[p:p + size - 1], ' ') AS win
  FROM (SELECT k, w, size, unnest(generate_series(1, len(w) - size + 1)) AS p
        FROM doc, (SELECT DISTINCT size FROM win) WHERE len(w) >= size)),
hit AS (SELECT k, p, win.size, item_id FROM place JOIN win ON place.size = win.size AND place.win = win.win),
word AS (SELECT k, count(DISTINCT q) AS n_hit
         FROM (SELECT k, unnest(generate_series(p, p + size - 1)) AS q FROM hit) GROUP BY k),
named AS (SELECT k, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT k, item_id FROM hit WHERE item_id IS NOT NULL) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (k) LEFT JOIN named USING (k)
"""

QUERIES: dict[str, Query] = {
    "op1_simhash": op1_simhash,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_pieces": op4_pieces,
    "op5_maxent": op5_maxent,
    "op6_pii": op6_pii,
    "op7_licenses": op7_licenses,
    "op8_decontaminate": op8_decontaminate,
    "op9_warc": op9_warc,
    "op10_language": op10_language,
    "op11_collocations": op11_collocations,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_trie_join": op13_trie_join,
}

_SPACE, _OTHER = "[\\x20\\x09-\\x0D]", "[^\\x20\\x09-\\x0D]"
_GAMMA, _GROWTH = math.log((1 + quality.RELATIVE) / (1 - quality.RELATIVE)), (1 + quality.RELATIVE) / (1 - quality.RELATIVE)


_VALUE = f"CASE WHEN bucket <= 0 THEN 0.0::DOUBLE ELSE pow({_GROWTH!r}::DOUBLE, bucket) * {1 - quality.RELATIVE!r}::DOUBLE - 1 END"


def _of_measure(key: str) -> str:
    return "CASE measure " + " ".join(f"WHEN '{m}' THEN {float(v[key])}::DOUBLE" for m, v in quality.MEASURES.items()) + " END"


OP3_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, list_filter(regexp_split_to_array(t, '{_SPACE}+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT k, p, array_to_string(w[p:p + 7], ' ') AS g FROM (SELECT k, w, unnest(generate_series(1, len(w) - 7)) AS p FROM w WHERE len(w) >= 8)),
rep AS (SELECT k, count(DISTINCT q) AS r FROM (SELECT k, unnest(generate_series(p, p + 7)) AS q FROM (SELECT *, count(*) OVER (PARTITION BY k, g) AS n FROM win) WHERE n > 1) GROUP BY k),
ln AS (SELECT k, count(*) - count(DISTINCT l) AS dup FROM (SELECT k, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '{_OTHER}') GROUP BY k),
m AS (SELECT k, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '{_SPACE}+', '', 'g')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    coalesce(dup, 0) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words FROM d JOIN w USING (k) LEFT JOIN rep USING (k) LEFT JOIN ln USING (k)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
x AS (SELECT k, lang, source, base_failed, unnest([{{'m': 'symbol_rate', 'v': n_symbols * 1000 // greatest(n_words, 1)}}, {{'m': 'repeat_rate', 'v': n_repeat_words * 1000 // greatest(n_words, 1)}},
    {{'m': 'dup_line_rate', 'v': n_dup_lines * 10000 // greatest(n_words, 1)}}, {{'m': 'word_length', 'v': word_chars * 1000 // greatest(n_words, 1)}}]) AS u FROM j),
s AS (SELECT lang, source, u.m AS measure, CAST(ceil(ln(u.v + 1.0::DOUBLE) / {_GAMMA!r}::DOUBLE) AS BIGINT) AS bucket, count(*) AS n FROM x WHERE NOT base_failed GROUP BY ALL),
sl AS (SELECT lang, measure, bucket, sum(n) AS n FROM s GROUP BY ALL), sa AS (SELECT measure, bucket, sum(n) AS n FROM s GROUP BY ALL),
ra AS (SELECT measure, bucket, sum(n) OVER (PARTITION BY measure ORDER BY bucket) AS au, sum(n) OVER (PARTITION BY measure) AS an FROM sa),
rl AS (SELECT g.lang, ra.*, coalesce(sum(n) OVER (PARTITION BY g.lang, ra.measure ORDER BY ra.bucket), 0) AS lu, sum(n) OVER (PARTITION BY g.lang, ra.measure) AS lc
    FROM (SELECT DISTINCT lang, measure FROM sl) g JOIN ra ON ra.measure = g.measure LEFT JOIN sl ON sl.lang IS NOT DISTINCT FROM g.lang AND sl.measure = ra.measure AND sl.bucket = ra.bucket),
rg AS (SELECT g.source, rl.*, coalesce(sum(n) OVER (PARTITION BY g.lang, g.source, rl.measure ORDER BY rl.bucket), 0) AS gu, sum(n) OVER (PARTITION BY g.lang, g.source, rl.measure) AS gc
    FROM (SELECT DISTINCT lang, source, measure FROM s) g JOIN rl ON rl.lang IS NOT DISTINCT FROM g.lang AND rl.measure = g.measure
    LEFT JOIN s ON s.lang IS NOT DISTINCT FROM g.lang AND s.source IS NOT DISTINCT FROM g.source AND s.measure = rl.measure AND s.bucket = rl.bucket),
mix AS (SELECT lang, source, measure, bucket, gu + {quality.PRIOR} * ((lu + {quality.PRIOR} * (au / an)) / (lc + {quality.PRIOR})) AS upto, gc + {quality.PRIOR} AS total FROM rg),
q AS (SELECT lang, source, measure, min(CASE WHEN upto >= {_of_measure("low")} * total THEN {_VALUE} END) AS low, min(CASE WHEN upto >= {_of_measure("high")} * total THEN {_VALUE} END) AS high FROM mix GROUP BY ALL),
f AS (SELECT lang, source, measure, round(high + far, 3) AS most, CASE WHEN measure IN ({", ".join(f"'{m}'" for m, v in quality.MEASURES.items() if v["both"])}) THEN round(low - far, 3) END AS fewest
    FROM (SELECT *, greatest({_of_measure("times")} * (high - low), {_of_measure("least")}) AS far FROM q)),
bad AS (SELECT DISTINCT k FROM x JOIN f ON f.lang IS NOT DISTINCT FROM x.lang AND f.source IS NOT DISTINCT FROM x.source AND f.measure = x.u.m WHERE x.u.v > f.most OR x.u.v < f.fewest)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND k NOT IN (SELECT k FROM bad) AS kept FROM j
"""

OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
q AS (SELECT page_id, payload, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
             CASE WHEN strlen(payload) >= 1000 THEN max(page_id) OVER (PARTITION BY payload) END AS target FROM p)
SELECT page_id, payload_bytes, sha1(payload) AS payload_digest,
       CASE WHEN target IS NOT NULL AND (page_id IS NULL OR page_id < target) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id < target THEN target END AS refers_to
FROM q
"""

OP11_SQL = r"""
WITH piece AS (
  SELECT lang, d, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS d,
               unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
        FROM documents)),
total AS (SELECT lang, sum(len(w))::BIGINT AS n FROM piece GROUP BY lang),
f AS (
  SELECT lang, k, g AS words, count(*)::BIGINT AS f
  FROM (SELECT lang, k, w[i:i + k - 1] AS g
        FROM (SELECT lang, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM piece, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k))
  GROUP BY ALL HAVING count(*) >= 30),
cand AS (SELECT lang, k AS size, words, f AS a FROM f WHERE k >= 2),
cut AS (SELECT lang, size, words, a, unnest(generate_series(1, size - 1)) AS k FROM cand),
scored AS (
  SELECT lang, cut.words, a, arg_min({'l': x.f, 'r': y.f, 'score': (2000000::HUGEINT * a // (x.f + y.f))::BIGINT}, (2000000::HUGEINT * a // (x.f + y.f)) * 10 + cut.k) AS c
  FROM cut JOIN f x USING (lang) JOIN f y USING (lang) WHERE x.words = cut.words[1:cut.k] AND y.words = cut.words[cut.k + 1:]
  GROUP BY ALL),
part AS (
  SELECT lang, words[i:i + n - 1] AS words, max(a) AS longer
  FROM (SELECT lang, words, a, n, unnest(generate_series(1, size - n + 1)) AS i FROM (SELECT *, unnest(generate_series(2, size - 1)) AS n FROM cand WHERE size > 2))
  GROUP BY ALL),
kept AS (
  SELECT lang, array_to_string(words, ' ') AS phrase, a, c.l AS l, c.r AS r, c.score AS score
  FROM scored LEFT JOIN part USING (lang, words) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT * FROM (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept JOIN total USING (lang))
WHERE rank <= 2000
"""

OP12_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
anchor AS (SELECT DISTINCT * FROM e WHERE vec_id % 50 = 0),
pair AS (
  SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same, CAST(list_inner_product(a.v, e.v) AS BIGINT) AS score
  FROM anchor a, e WHERE e.vec_id IS DISTINCT FROM a.vec_id),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN pair USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""

OP13_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS g
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
link AS (SELECT x, y FROM pair JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 90 * (nx.n + ny.n - c)),
both_ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.y FROM reach r JOIN both_ways l ON l.x = r.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {
    "op13_trie_join": OP13_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op11_collocations": OP11_SQL,
    "op9_warc": OP9_SQL,
    "op3_quality": OP3_SQL,
    "op8_decontaminate": OP8_SQL,
}
