"""Registered queries of the llm operators and their DuckDB oracles.

Each query applies one operator, with production parameters, to its whole
table and returns the full result. Oracles exist where SQL can state the result
exactly (op5, op8, op10 to op13); the others are tested against brute force, public
libraries or held-out labels in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from offerflow.llm import (
    bpe,
    embedding_dedup,
    exact_dedup,
    jaccard_join,
    lexical_search,
    license_scan,
    line_dedup,
    lm_score,
    merkle,
    mixing,
    quality_rules,
    token_counts,
    toxicity,
)
from offerflow.llm.common import read, small_batches


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return read(spark, sf_dir, "documents")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge_documents(_docs(spark, sf_dir), read(spark, sf_dir, "labels"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(_docs(spark, sf_dir))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score_texts(_docs(spark, sf_dir))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_docs(spark, sf_dir))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(_docs(spark, sf_dir), read(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_report(_docs(spark, sf_dir))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(_docs(spark, sf_dir), read(spark, sf_dir, "labels"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_links(_docs(spark, sf_dir))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_docs(spark, sf_dir))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return embedding_dedup.near_duplicates(read(spark, sf_dir, "embeddings"))


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_docs(spark, sf_dir), read(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.tamper_report(read(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_copies(read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_license_scan": op2_license_scan,
    "op3_lm_score": op3_lm_score,
    "op4_token_counts": op4_token_counts,
    "op5_mixing": op5_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op9_byte_bpe": op9_byte_bpe,
    "op10_embedding_dedup": op10_embedding_dedup,
    "op11_lexical_search": op11_lexical_search,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_exact_dedup": op13_exact_dedup,
}


def _raking_sql() -> str:
    """Iterative proportional fitting, a sweep a round, until the marginals are met or the error no longer falls."""
    words = "len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))"
    ctes = [
        "topics AS (SELECT vec_id AS doc_id, min(label)::VARCHAR AS topic FROM embeddings GROUP BY vec_id)",
        f"rows AS (SELECT d.doc_id, coalesce(source, '{mixing.NONE}') AS source, coalesce(lang, '{mixing.NONE}') AS lang, "
        f"coalesce(topic, '{mixing.NONE}') AS topic, {words}::BIGINT AS tokens FROM documents d LEFT JOIN topics t ON d.doc_id = t.doc_id)",
        "cells AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::BIGINT AS tokens FROM rows GROUP BY ALL)",
    ]
    for d in mixing.DIMENSIONS:
        ctes.append(f"share_{d} AS MATERIALIZED (SELECT {d}, raw / sum(raw) OVER () AS share FROM (SELECT {d}, "
                    f"pow(sum(tokens)::DOUBLE, {mixing.POWER}) AS raw FROM cells GROUP BY {d} HAVING sum(tokens) > 0))")
    dims = mixing.DIMENSIONS
    shares = ", ".join(f"share_{d}.share AS share_{d}" for d in dims)
    ctes.append(f"w0 AS MATERIALIZED (SELECT source, lang, topic, tokens, tokens::DOUBLE AS weight, {shares} FROM cells "
                + " ".join(f"JOIN share_{d} USING ({d})" for d in dims) + " WHERE tokens > 0)")
    keep = "source, lang, topic, tokens, share_source, share_lang, share_topic, errors"
    sweep = (f"SELECT {keep}, weight FROM sweeps WHERE NOT (len(errors) >= {mixing.SWEEPS} AND (errors[-1] <= {mixing.TOLERANCE} "
             f"OR (len(errors) > {mixing.PATIENCE} AND NOT errors[-1] < 0.99 * errors[len(errors) - {mixing.PATIENCE}])))")
    for d in dims:
        sweep = f"SELECT {keep}, weight * share_{d} / sum(weight) OVER (PARTITION BY {d}) AS weight FROM ({sweep})"
    off = ", ".join(f"abs(sum(weight) OVER (PARTITION BY {d}) / share_{d} - 1)" for d in dims)
    sweep = f"SELECT *, greatest({off}) AS off FROM ({sweep})"
    columns = keep.replace(", errors", "")
    ctes.append(f"sweeps AS (SELECT {columns}, []::DOUBLE[] AS errors, weight FROM w0 UNION ALL "
                f"SELECT {columns}, list_append(errors, max(off) OVER ()), weight FROM ({sweep}))")
    n = " WHERE len(errors) = (SELECT max(len(errors)) FROM sweeps)"
    ctes.append(f"rates AS (SELECT source, lang, topic, round((weight / tokens) / max(weight / tokens) OVER (), 9) AS rate FROM sweeps{n})")
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\nSELECT doc_id, r.source, r.lang, r.topic, r.tokens, probability, "
            "('0x' || substr(md5(coalesce(doc_id, -1)::VARCHAR), 1, 8))::BIGINT / 4294967296.0 < probability AS selected "
            "FROM (SELECT r.*, coalesce(a.rate, CASE WHEN c.tokens > 0 THEN 0.0 ELSE 1.0 END) AS probability FROM rows r "
            "JOIN cells c USING (source, lang, topic) LEFT JOIN rates a USING (source, lang, topic)) r")


_JACCARD_SQL = r"""
WITH RECURSIVE
w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\x20\x09-\x0D]+') AS ws FROM documents),
sets AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) >= 5
             THEN [array_to_string(ws[i:i+4], ' ') for i in range(1, len(ws) - 3)]
             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END)) AS s FROM w),
classes AS MATERIALIZED (SELECT min(doc_id) AS rep, count(*) AS copies, s, len(s) AS n FROM sets WHERE len(s) > 0 GROUP BY s),
items AS MATERIALIZED (SELECT rep, n, unnest(s) AS x FROM classes),
inter AS (SELECT a.rep AS a, b.rep AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
          FROM items a JOIN items b ON a.x = b.x AND a.rep < b.rep GROUP BY ALL),
links AS MATERIALIZED (SELECT a, b FROM inter WHERE k * 5 >= (na + nb - k) * 4),
both_ways AS MATERIALIZED (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT rep, rep FROM classes UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
comp AS (SELECT a AS rep, min(b) AS class_id FROM reach GROUP BY a),
deg AS (SELECT l.a AS rep, sum(c.copies) AS links FROM both_ways l JOIN classes c ON l.b = c.rep GROUP BY l.a)
SELECT s.doc_id, len(s.s)::INTEGER AS n_shingles, coalesce(c.copies, 1)::BIGINT AS copies,
       (coalesce(d.links, 0) + coalesce(c.copies, 1) - 1)::BIGINT AS n_links, coalesce(m.class_id, s.doc_id) AS class_id
FROM sets s LEFT JOIN classes c ON s.s = c.s LEFT JOIN comp m ON m.rep = c.rep LEFT JOIN deg d ON d.rep = c.rep
"""

_COSINE_SQL = """
WITH RECURSIVE
good AS MATERIALIZED (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
    WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
      AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id
    AND len(a.v) = len(b.v) AND list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
comp AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN comp c ON c.a = e.vec_id LEFT JOIN deg d ON d.a = e.vec_id
"""

_SEARCH_SQL = r"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
size AS MATERIALIZED (SELECT count(*)::BIGINT AS nn, sum(len(ws))::BIGINT AS ll FROM t WHERE len(ws) > 0),
tf AS MATERIALIZED (SELECT rid, term, count(*)::BIGINT AS tf FROM (SELECT rid, unnest(ws) AS term FROM t) GROUP BY rid, term),
w AS MATERIALIZED (SELECT term, floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY term, nn),
doc AS MATERIALIZED (SELECT rid, doc_id, 25 + (75 * len(ws)::BIGINT * nn) // ll AS m FROM t, size WHERE len(ws) > 0),
item AS MATERIALIZED (SELECT iid, item_id, term, count(*)::BIGINT AS times FROM (
    SELECT row_number() OVER () AS iid, item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL),
score AS (SELECT iid, item_id, doc_id, rid, sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
    FROM item JOIN w USING (term) JOIN tf USING (term) JOIN doc USING (rid) GROUP BY ALL)
SELECT item_id, rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
    FROM score WHERE score > 0) WHERE rank <= 10
"""


def _manifest_sql(levels: int = 18) -> str:
    """The trees level by level (3^18 leaves at most); per leaf and level the siblings left and right."""
    frame = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    row = lambda text: " || ".join(frame(c) for c in ("doc_id", "source", "lang", "n_chars", text))
    # CRC-32 bit by bit over the digits of the id
    crc = ("xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), "
           "lambda z, b: list_reduce(list_concat([xor(z, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), "
           "lambda y, e: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295)")
    ctes = [f"rows AS MATERIALIZED (SELECT *, sha256({row('text')}) AS leaf, CASE WHEN {crc} % 2 = 0 THEN "
            f"sha256({row('cut')}) END AS bad FROM (SELECT *, replace(text, chr(10), '') AS cut FROM documents))",
            "l0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, "
            "count(*) OVER (PARTITION BY source) AS size, leaf AS d FROM rows)"]

    def tower(first: str, name: str, key: str) -> None:
        """Levels above ``first``, and per node of the first level its siblings and position on each."""
        ctes.append(f"{name}0 AS MATERIALIZED (SELECT {key}, pos, size, d FROM {first})")
        for k in range(levels):
            ctes.append(f"{name}{k + 1} AS MATERIALIZED (SELECT {key}, pos // 3 AS pos, (any_value(size) + 2) // 3 AS size, "
                        f"sha256(string_agg(d, '' ORDER BY pos)) AS d FROM {name}{k} WHERE size > 1 GROUP BY {key}, pos // 3)")
        every = " UNION ALL ".join(f"SELECT {k} AS lvl, * FROM {name}{k}" for k in range(levels + 1))
        ctes.append(f"{name} AS MATERIALIZED (SELECT * FROM ({every}))")
        ctes.append(f"{name}_sib AS MATERIALIZED (SELECT lvl, {key}, pos, "
                    f"coalesce(string_agg(d, '') OVER (PARTITION BY {key}, lvl, pos // 3 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l, "
                    f"coalesce(string_agg(d, '') OVER (PARTITION BY {key}, lvl, pos // 3 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r "
                    f"FROM {name} WHERE size > 1)")

    tower("l0", "n", "source")
    ctes.append("sub AS MATERIALIZED (SELECT source, 0 AS one, d, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, "
                "count(*) OVER () AS size FROM n WHERE size = 1)")
    tower("sub", "u", "one")
    ctes.append("f0 AS (SELECT l0.doc_id, l0.leaf, s.d AS subroot, s.pos AS spos, l0.source, l0.pos, coalesce(l0.bad, l0.leaf) AS acc, '' AS proof "
                "FROM l0 JOIN sub s ON s.source IS NOT DISTINCT FROM l0.source)")
    n = 0
    for tree, match, at in (("n", "x.source IS NOT DISTINCT FROM f.source", "pos"), ("u", "true", "spos")):
        for k in range(levels):
            ctes.append(f"f{n + 1} AS MATERIALIZED (SELECT f.doc_id, f.leaf, f.subroot, f.spos, f.source, f.pos, "
                        "CASE WHEN x.lvl IS NULL THEN acc ELSE sha256(x.l || acc || x.r) END AS acc, proof || coalesce(x.l || x.r, '') AS proof "
                        f"FROM f{n} f LEFT JOIN {tree}_sib x ON {match} AND x.lvl = {k} AND x.pos = f.{at} // {3 ** k})")
            n += 1
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\nSELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, acc AS folded_root, "
            f"acc = root AS verified FROM f{n}, (SELECT d AS root FROM u WHERE size = 1)")


_COPIES_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY x ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(x) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS x FROM documents) WINDOW same AS (PARTITION BY x)
"""

ORACLES = {"op5_mixing": _raking_sql(), "op8_ngram_jaccard": _JACCARD_SQL, "op10_embedding_dedup": _COSINE_SQL,
           "op11_lexical_search": _SEARCH_SQL, "op12_merkle_manifest": _manifest_sql(), "op13_exact_dedup": _COPIES_SQL}
