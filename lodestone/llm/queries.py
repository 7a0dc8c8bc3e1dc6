"""One query for each corpus operator, over its whole table with production parameters, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import alignment, bpe, decontam, hardneg, htmltext, license, linededup, mixing, quality, rules, sharding, simhash, tokencount
from lodestone.llm.common import spread, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = bpe.encode_decode(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), vocabulary("word_bpe_49k.json"))
    return done.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "by_tree")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = quality.classify(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return done.select("doc_id", "held_out", "score", "predicted")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontam.contamination(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = license.scan(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return done.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = tokencount.token_counts(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), vocabulary("byte_bpe_50k.json"))
    return done.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shards_by_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), 8, cut_heavy=False)
    return done.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = htmltext.extract(spread(table(spark, sf_dir, "pages").select("page_id", "url", "html")))
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = rules.apply_rules(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return done.select("doc_id", *rules.COUNTS, "base_failed", "kept")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return alignment.align(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"), keep_groups=False)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), moved.alias("label"), F.col("embedding").alias("vector"))
    return hardneg.mine(rows, F.col("id") % 100 == 0)


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = mixing.mix(spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")))
    return done.select("doc_id", "size", "source_size", "target", "taken")


QUERIES = {
    "op1_bpe_encode_decode": op1_bpe_encode_decode,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_token_counts": op6_token_counts,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_sharding": op8_sharding,
    "op9_html_extraction": op9_html_extraction,
    "op10_quality_rules": op10_quality_rules,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_mixing": op13_mixing,
}

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

TRIMMED = "trim({x}, ' ' || chr(9) || chr(13) || chr(11) || chr(12))"

#: Templates and phrases as SQL rows.
TEMPLATES = ", ".join(f"({t}, '{label}', {license.template_words(text)})" for t, (label, text) in enumerate(license.TEMPLATES))
PHRASES = ", ".join(f"('{label}', '{text}', {len(text.split())})" for label, text in license.PHRASES.items())

ORACLES: dict[str, str] = {
    "op4_line_dedup": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || source, '') AS host, source, text, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
        l AS (SELECT r, host, coalesce(text, '') AS page, unnest(lines) AS line, {TRIMMED.format(x='unnest(lines)')} AS bare, generate_subscripts(lines, 1) AS i FROM d),
        total AS (SELECT host, count(DISTINCT coalesce(text, '')) AS pages FROM d GROUP BY host),
        often AS (SELECT host, bare FROM l JOIN total USING (host) WHERE bare <> '' GROUP BY host, bare, pages HAVING count(DISTINCT page) > 1 AND count(DISTINCT page) - 1 > 5e-2 * (pages - 1)),
        kept AS (SELECT r, string_agg(line, chr(10) ORDER BY i) AS text, count(*) AS n FROM l ANTI JOIN often USING (host, bare) GROUP BY r)
        SELECT doc_id, source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, CASE WHEN d.text IS NULL THEN 0 ELSE len(lines) - coalesce(n, 0) END AS n_lines_dropped
        FROM d LEFT JOIN kept USING (r)""",
    "op3_benchmark_decontamination": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
        b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {WORDS} AS w FROM benchmark),
        win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
                FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
        spot AS (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n),
        hit AS (SELECT r, i, win.n, item_id FROM spot JOIN win ON win.n = spot.n AND array_to_string(w[i:i + spot.n - 1], ' ') = g),
        cover AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
        named AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hit GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM d LEFT JOIN cover USING (r) LEFT JOIN named USING (r)""",
    "op5_license_scan": f"""
        WITH d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
        p AS (SELECT r, w, unnest(range(0, len(w))) AS i FROM d),
        base AS (SELECT r, i, label FROM p, (VALUES {PHRASES}) AS ph(label, phrase, n) WHERE array_to_string(w[i + 1:i + n], ' ') = phrase),
        based AS (SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS names FROM base GROUP BY r),
        tg AS (SELECT t, label, len(tw) - {license.K} + 1 AS grams, off, array_to_string(tw[off + 1:off + {license.K}], ' ') AS g
               FROM (SELECT *, unnest(range(0, len(tw) - {license.K} + 1)) AS off FROM (VALUES {TEMPLATES}) AS tm(t, label, tw))),
        hit AS (SELECT r, t, label, grams, i, off, i - off AS diagonal FROM p JOIN tg ON len(w) >= i + {license.K} AND array_to_string(w[i + 1:i + {license.K}], ' ') = g),
        dia AS (SELECT DISTINCT r, t, diagonal FROM hit),
        step AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, t ORDER BY diagonal) > {license.DRIFT} THEN 1 ELSE 0 END AS new FROM dia),
        run AS (SELECT r, t, diagonal, sum(new) OVER (PARTITION BY r, t ORDER BY diagonal) AS run FROM step),
        sized AS (SELECT *, max(i) OVER (PARTITION BY r, t, run) + {license.K} - min(i) OVER (PARTITION BY r, t, run) > 2 * (grams + {license.K}) AS overlong FROM hit JOIN run USING (r, t, diagonal)),
        span AS (SELECT r, label, count(DISTINCT off) / CAST(grams AS DOUBLE) AS coverage FROM sized GROUP BY r, t, label, grams, run, CASE WHEN overlong THEN diagonal END
                 HAVING count(DISTINCT off) >= {license.SHARE}e0 * grams),
        spanned AS (SELECT r, list(DISTINCT label) AS names, max(coverage) AS best FROM span GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               array_to_string(list_sort(coalesce(based.names, [])), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(based.names, []), coalesce(spanned.names, [])))), ',') AS labels,
               CASE WHEN n_base > 0 THEN 1e0 ELSE coalesce(best, 0e0) END AS score
        FROM d LEFT JOIN based USING (r) LEFT JOIN spanned USING (r)""",
    "op12_hard_negatives": """
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256e0 * CAST(x AS DOUBLE))) AS q FROM embeddings
                   WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        pair AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
        pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pair WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
        FROM pos JOIN pair USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score QUALIFY rank <= 10""",
    "op13_mixing": r"""
        WITH d AS (SELECT doc_id, coalesce('=' || source, '~') AS src, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT src, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY src),
        w AS (SELECT *, [5e0, 2e0, 1e0][(row_number() OVER (ORDER BY src) - 1) % 3 + 1] AS weight FROM s),
        t AS (SELECT sum(weight) AS weights, CAST(sum(source_size) AS DOUBLE) AS words FROM w),
        full_first AS (SELECT w.*, row_number() OVER o AS k, coalesce(sum(weight) OVER b, 0e0) AS full_weight, CAST(coalesce(sum(source_size) OVER b, 0) AS DOUBLE) AS full_size
                       FROM w WINDOW o AS (ORDER BY source_size / weight, src), b AS (ORDER BY source_size / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        levels AS (SELECT k, (15e-1 * words - 2e0 * full_size) / (weights - full_weight) AS level, 2e0 * source_size AS bound, weight FROM full_first, t),
        level AS (SELECT arg_min(level, k) AS level FROM levels WHERE bound >= level * weight),
        target AS (SELECT src, source_size, CASE WHEN level IS NULL THEN 2e0 * source_size ELSE least(2e0 * source_size, level * weight) END AS target FROM w, level),
        e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size * 16777216e0) AS BIGINT) ELSE 0 END AS each, CAST('0x' || substr(md5('mix' || src), 1, 6) AS BIGINT) AS start FROM target),
        spot AS (SELECT doc_id, size, source_size, target, each, start, row_number() OVER (PARTITION BY src ORDER BY size, doc_id NULLS FIRST) AS i FROM d JOIN e USING (src))
        SELECT doc_id, size, source_size, target, size * (((i * each + start) >> 24) - (((i - 1) * each + start) >> 24)) AS taken FROM spot""",
}
