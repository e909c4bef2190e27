"""Registered queries of the operators of this package, with production parameters on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm import bpe, collocations, decontaminate, kneser_ney, mixing, ngram_join, passages, quality, rules, runs, secrets, sharding, toxicity
from trialloom.llm.text import held_out, table, words

SHARDS = 24
TOKENIZER = "word_bpe_49k.json"


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score_documents(docs, quality.fit_neighbours(docs, table(spark, sf_dir, "labels")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated_passages(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit_lexicon(docs, table(spark, sf_dir, "labels")))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return kneser_ney.perplexities(docs, kneser_ney.fit(docs.where(~held_out("doc_id", 10))))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), k=3, percent=90)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.rendezvous(table(spark, sf_dir, "documents"), [1.0] * SHARDS)
    return rows.select("doc_id", "size", "text_crc32", "law", F.col("shard").cast("int"), "slot", F.col("grown_shard").cast("int"))


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    planted = docs.select("doc_id", runs.with_repeated_tail(F.col("doc_id"), F.col("text"), words("text")).alias("text"))
    return runs.digests(runs.periodic_runs(planted))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_quality, op2_decontamination, op3_passages, op4_toxicity, op5_mixing, op6_rules, op7_scoring, op8_jaccard_join, op9_secrets, op10_sharding, op11_runs, op12_collocations, op13_bpe)
}

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

ORACLE: dict[str, str] = {
    "op2_decontamination": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS ws FROM documents),
b AS (SELECT item_id, {_LOWER} AS ws FROM benchmark),
dw AS (SELECT doc_id, len(ws) AS n, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM d),
bw AS (SELECT item_id, len(ws) AS m, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM b),
eq AS (SELECT doc_id, item_id, n, m, dw.pos - bw.pos AS shift, bw.pos AS pos FROM dw JOIN bw ON dw.w = bw.w),
lines AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id, shift) AS total FROM eq)
          WHERE total >= 11 AND least(m, n - shift) - greatest(0, -shift) >= 13),
near AS (SELECT doc_id, item_id, shift, total,
                count(*) OVER (PARTITION BY doc_id, item_id, shift ORDER BY pos RANGE BETWEEN CURRENT ROW AND 12 FOLLOWING) AS inside
         FROM lines),
good AS (SELECT doc_id, item_id, shift, max(total) AS total FROM near WHERE inside >= 11 GROUP BY ALL)
SELECT doc_id, item_id, count(*) AS n_lines, max(total) AS n_matched FROM good GROUP BY doc_id, item_id""",
    "op11_runs": rf"""
WITH h AS (SELECT doc_id, {_WORDS} AS ws, row_number() OVER () AS row_id,
    xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) AS h
    FROM documents),
g AS (SELECT row_id, doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, h // 10 AS g FROM h),
a AS (SELECT *, CASE WHEN planted THEN g % n END AS a FROM g),
p AS (SELECT *, CASE WHEN planted THEN 1 + (n - a) // (3 + g % 8) END AS p FROM a),
d AS (SELECT row_id, doc_id, n, CASE WHEN planted
             THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) ELSE ws END AS ws FROM p),
w AS (SELECT row_id, n, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM d),
eq AS (SELECT x.row_id, x.pos, y.pos - x.pos AS q FROM w x JOIN w y ON x.row_id = y.row_id AND x.w = y.w AND y.pos > x.pos AND 4 * (y.pos - x.pos) <= x.n),
isl AS (SELECT *, pos - row_number() OVER (PARTITION BY row_id, q ORDER BY pos) AS i FROM eq),
st AS (SELECT row_id, q, min(pos) AS s, count(*) + q AS len FROM isl GROUP BY row_id, q, i HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT row_id, s, len, min(q) AS q FROM st GROUP BY row_id, s, len),
per AS (SELECT row_id, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS txt FROM runs GROUP BY row_id),
best AS (SELECT r.row_id, r.s, r.len, r.q FROM runs r WHERE NOT EXISTS (SELECT 1 FROM runs o WHERE o.row_id = r.row_id
         AND (o.len * r.q > r.len * o.q OR (o.len * r.q = r.len * o.q AND (o.s < r.s OR (o.s = r.s AND o.q < r.q)))))),
gone AS (SELECT DISTINCT row_id, unnest(range(s + q, s + len)) AS pos FROM runs),
kept AS (SELECT w.row_id, string_agg(w, ' ' ORDER BY w.pos) AS txt FROM w ANTI JOIN gone ON w.row_id = gone.row_id AND w.pos = gone.pos GROUP BY w.row_id)
SELECT d.doc_id, coalesce(per.n_runs, 0) AS n_runs, best.s AS start, best.len AS length, best.q AS period,
       (1000 * best.len) // best.q AS exponent_milli, sha256(coalesce(per.txt, '')) AS runs_sha256, sha256(coalesce(kept.txt, '')) AS collapsed_sha256
FROM d LEFT JOIN per USING (row_id) LEFT JOIN best USING (row_id) LEFT JOIN kept USING (row_id)""",
    "op12_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, row_number() OVER () AS doc,
                  string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS ps
           FROM documents WHERE text IS NOT NULL),
p AS (SELECT lang, doc, unnest(ps) AS piece, generate_subscripts(ps, 1) AS pc FROM d),
w AS (SELECT lang, doc, pc, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM p),
t AS (SELECT lang, doc, pc, unnest(ws) AS w1, generate_subscripts(ws, 1) AS pos FROM w),
g AS (SELECT lang, w1, lead(w1) OVER x AS w2, lead(w1, 2) OVER x AS w3 FROM t WINDOW x AS (PARTITION BY doc, pc ORDER BY pos)),
n AS (SELECT lang, count(*) AS n FROM g GROUP BY lang),
f1 AS (SELECT lang, w1, count(*) AS f FROM g GROUP BY ALL),
f2 AS (SELECT lang, w1, w2, count(*) AS f FROM g WHERE w2 IS NOT NULL GROUP BY ALL),
f3 AS (SELECT lang, w1, w2, w3, count(*) AS f FROM g WHERE w3 IS NOT NULL GROUP BY ALL),
c3 AS (SELECT c.lang, c.w1, c.w2, c.w3, c.f AS a, x.f AS l1, y.f AS r1, z.f AS l2, u.f AS r2,
              (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS s1, (1000000::HUGEINT * c.f * c.f) // (z.f::HUGEINT * u.f) AS s2
       FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
       JOIN f2 z ON z.lang = c.lang AND z.w1 = c.w1 AND z.w2 = c.w2 JOIN f1 u ON u.lang = c.lang AND u.w1 = c.w3 WHERE c.f >= 10),
o AS (SELECT lang, w1, w2, max(a) AS over FROM (SELECT lang, w1, w2, a FROM c3 UNION ALL SELECT lang, w2, w3, a FROM c3) GROUP BY ALL),
c2 AS (SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, c.f AS a, x.f AS l, y.f AS r, (1000000::HUGEINT * c.f * c.f) // (x.f::HUGEINT * y.f) AS score
       FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
       LEFT JOIN o ON o.lang = c.lang AND o.w1 = c.w1 AND o.w2 = c.w2
       WHERE c.f >= 10 AND NOT coalesce(100 * o.over >= 50 * c.f, false)),
a AS (SELECT * FROM c2 UNION ALL
      SELECT lang, w1 || ' ' || w2 || ' ' || w3, a, CASE WHEN s1 <= s2 THEN l1 ELSE l2 END, CASE WHEN s1 <= s2 THEN r1 ELSE r2 END, least(s1, s2) FROM c3)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM a) JOIN n USING (lang)
WHERE rank <= 2000""",
    "op5_mixing": f"""
WITH d AS (SELECT doc_id, source, len({_WORDS}) AS size,
                  (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null id') || ':0:' || md5(coalesce(text, ''))), 1, 13))::BIGINT + 0.5)
                  / 4503599627370496.0::DOUBLE AS u
           FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS most,
             CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
      FROM d GROUP BY source),
o AS (SELECT *, most::DOUBLE / weight AS ratio, (SELECT sum(size) FROM d)::BIGINT AS wanted,
             coalesce(sum(most) OVER (ORDER BY most::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_size,
             sum(weight) OVER (ORDER BY most::DOUBLE / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest
      FROM s),
lev AS (SELECT (wanted - full_size)::DOUBLE / rest AS lev FROM o WHERE (wanted - full_size)::DOUBLE / rest <= ratio ORDER BY ratio LIMIT 1),
t AS (SELECT source, source_size, least(most::DOUBLE, weight * lev) AS target FROM s, lev),
z AS (SELECT source, size, count(*) AS n FROM d GROUP BY source, size),
lv AS (SELECT z.source, z.size, t.source_size, t.target,
              (t.target - 3 * (t.source_size - sum(n * z.size) OVER upto))
              / nullif(sum(n * z.size * pow(greatest(z.size, 1), 0.5)) OVER upto, 0) AS level
       FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source
       WINDOW upto AS (PARTITION BY z.source ORDER BY z.size)),
le AS (SELECT source, source_size, target,
              CASE WHEN source_size > 0 THEN arg_max(level, size) FILTER (WHERE level * pow(greatest(size, 1), 0.5) <= 3) ELSE 0 END AS level
       FROM lv GROUP BY source, source_size, target),
e AS (SELECT d.*, le.source_size, le.target, coalesce(least(3.0::DOUBLE, le.level * pow(greatest(size, 1), 0.5)), 3.0::DOUBLE) AS copies
      FROM d JOIN le ON d.source IS NOT DISTINCT FROM le.source),
q AS (SELECT *, floor(copies)::BIGINT AS whole, copies - floor(copies) AS p,
             target - sum(floor(copies)::BIGINT * size) OVER (PARTITION BY source) AS extra FROM e),
o2 AS (SELECT *, CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS odds FROM q),
k AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM o2)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (whole + CASE WHEN p > 0 AND extra > 0 AND upto - size / 2.0 <= extra THEN 1 ELSE 0 END) * size AS taken
FROM k""",
}
