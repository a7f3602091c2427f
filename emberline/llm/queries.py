"""Registered queries of the training-data operators, over whole tables, and their SQL where SQL can say it."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from emberline.llm import decontaminate, exact_dedup, language, language_model, lexical, licenses, near_dedup, packing, preference, quality, secrets, spotsigs, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(folds: int) -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds


def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.coalesce(fold(5), F.lit(0)) == 1
    return language_model.score(table(spark, sf_dir, "documents"), ~held).select("*", held.alias("held_out"))


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings become three grades: toxic 0, of low quality 1, good 2; a fifth of the documents is held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rated = labels.select("doc_id", F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2).alias("grade"))
    model = quality.train(docs, rated.filter(fold(5) != 1), levels=3)
    return quality.grade(docs, model, levels=3, keep=[(F.coalesce(fold(5), F.lit(0)) == 1).alias("held_out")])


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents"))


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.detect(table(spark, sf_dir, "documents"))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counts = language.learn(docs.filter(fold(4) != 2))
    return language.predict(docs, counts, keep=[(F.coalesce(fold(4), F.lit(0)) == 2).alias("held_out")])


def near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(table(spark, sf_dir, "documents"))


def preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return _masks(preference.format_pairs(turns, preference.neighbours(turns)))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masks(preference.replaced_replies(table(spark, sf_dir, "conversations")))


def _masks(out: DataFrame) -> DataFrame:
    return out.withColumns({c: preference.mask_text(F.col(c)) for c in ("chosen_mask", "rejected_mask")})


def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), learn_from=fold(5) != 1)


def ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited_pairs(table(spark, sf_dir, "documents"))


def whitened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_greedy_string_tiling": decontaminated,
    "op2_elias_fano_trie": model_scores,
    "op3_ordinal_quality": graded,
    "op4_configuration_packing": packed,
    "op5_exact_dedup": exact,
    "op6_license_rules": license_scan,
    "op7_language_mixture": languages,
    "op8_bagminhash": near,
    "op9_preference_pairs": preferences,
    "op9_replaced_replies": replies,
    "op10_secret_forest": secret_scan,
    "op11_presence_masks": ranked,
    "op12_spot_signatures": spots,
    "op13_feast_whitening": whitened,
}

SQL = {
    "op5_exact_dedup": """
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, CAST(count(*) OVER w AS BIGINT) AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)""",
    "op9_preference_pairs": """
        WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
        s AS (SELECT conv_id, CAST(floor(conv_id / 2) AS BIGINT) AS p, conv_id % 2 AS side, role, text,
                     row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM t),
        full_pairs AS (SELECT p FROM s GROUP BY p HAVING count(DISTINCT conv_id) = 2),
        a AS (SELECT s.* FROM s JOIN full_pairs USING (p) WHERE side = 0),
        b AS (SELECT s.* FROM s JOIN full_pairs USING (p) WHERE side <> 0),
        j AS (SELECT coalesce(a.p, b.p) AS p, coalesce(a.i, b.i) AS i,
                     coalesce(a.role = b.role AND a.text = b.text, false) AS same FROM a FULL JOIN b ON a.p = b.p AND a.i = b.i),
        n AS (SELECT p, coalesce(min(i) FILTER (WHERE NOT same) - 1, max(i)) AS n FROM j GROUP BY p),
        r AS (SELECT s.p, s.side, s.i, s.role, n.n, '<|' || role || '|>' || chr(10) || text || chr(10) AS part,
                     length(role) + 5 AS head FROM s JOIN n USING (p)),
        o AS (SELECT *, sum(length(part)) OVER (PARTITION BY p, side ORDER BY i) - length(part) AS pos FROM r WHERE i > n),
        c AS (SELECT p, side, string_agg(part, '' ORDER BY i) AS body,
                     coalesce(string_agg(CAST(pos + head AS VARCHAR) || '-' || CAST(pos + length(part) AS VARCHAR), ',' ORDER BY i)
                              FILTER (WHERE role = 'assistant'), '') AS mask FROM o GROUP BY p, side)
        SELECT n.p AS pair_id, n.p * 2 AS chosen_id, n.p * 2 + 1 AS rejected_id, CAST(n.n AS BIGINT) AS n_shared,
               coalesce((SELECT string_agg(part, '' ORDER BY i) FROM r WHERE r.p = n.p AND r.side = 0 AND r.i <= r.n), '') AS prompt,
               coalesce(x.body, '') AS chosen, coalesce(y.body, '') AS rejected, coalesce(x.mask, '') AS chosen_mask,
               coalesce(y.mask, '') AS rejected_mask, coalesce(x.mask, '') <> '' AND coalesce(y.mask, '') <> '' AS usable
        FROM n LEFT JOIN c x ON x.p = n.p AND x.side = 0 LEFT JOIN c y ON y.p = n.p AND y.side <> 0""",
    "op11_presence_masks": """
        WITH d AS (SELECT doc_id, text, row_number() OVER () AS r FROM documents),
        i AS (SELECT item_id, text, row_number() OVER () AS i FROM (SELECT DISTINCT item_id, text FROM benchmark)),
        dt AS (SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM d),
        it AS (SELECT DISTINCT i, item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM i),
        p AS (SELECT r, doc_id, t, count(*) AS tf FROM dt GROUP BY r, doc_id, t),
        l AS (SELECT r, CAST(sum(tf) AS BIGINT) AS n FROM p GROUP BY r),
        c AS (SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS len FROM l),
        w AS (SELECT t, CAST(floor(1000 * ln((2 * max(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p, c GROUP BY t),
        s AS (SELECT i, item_id, doc_id, p.r, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * docs) // len))))) AS BIGINT) AS score
              FROM it JOIN p USING (t) JOIN w USING (t) JOIN l ON l.r = p.r, c GROUP BY i, item_id, doc_id, p.r),
        o AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS place FROM s WHERE score > 0)
        SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM o WHERE place <= 50""",
}
