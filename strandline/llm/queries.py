"""The queries opN_<name> over the tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, collocations, decontam, exact_dedup, fertility, hard_negatives, html_extract, langid, line_dedup, mixing, ngram_join, pii, toxicity
from .common import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.predict(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "toxic", "p_toxic", "p_low_quality")


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", hard), (-1, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.pack(turns.unionByName(more)))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    models = langid.fit(docs.where(~langid.held_out() & F.col("lang").isNotNull()).select("doc_id", "text", "lang"))
    out = langid.predict(docs, models)
    return out.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(table(spark, sf_dir, "documents")))


def op9_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fertility.verdicts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "band", "chars_per_token", "fallback_share", "token_entropy")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = mixing.assign_positions(table(spark, sf_dir, "documents"))
    rounded = [F.round(c, 6).alias(c) for c in ("target", "first_position", "second_position")]
    out = mix.select("doc_id", "size", "source_size", rounded[0], "taken", rounded[1], rounded[2])
    return out.repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.mark_copies(table(spark, sf_dir, "documents"), keep=["doc_id"])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return hard_negatives.mine(v.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_ngram_join": op2_ngram_join,
    "op3_html_extraction": op3_html_extraction,
    "op4_chat_format": op4_chat_format,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_pii": op7_pii,
    "op9_fertility": op9_fertility,
    "op8_mixing": op8_mixing,
    "op10_decontamination": op10_decontamination,
    "op11_collocations": op11_collocations,
    "op12_exact_dedup": op12_exact_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

_UNITS, _NUMBERS = "|".join(decontam.UNITS), "|".join(decontam.NUMBERS)
_CLOSING = r"""[.,;:!?"''\)\]]"""

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') AS ws FROM documents
),
t AS (SELECT ws, min(doc_id) AS rep, count(*) AS n_copies FROM d WHERE len(ws) > 0 GROUP BY ws),
s AS (
  SELECT DISTINCT rep, n_copies, CASE WHEN len(ws) < 5 THEN ws ELSE [ws[i], ws[i + 1], ws[i + 2], ws[i + 3], ws[i + 4]] END AS g
  FROM (SELECT rep, n_copies, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM t) q
),
z AS (SELECT rep, n_copies, count(*) AS size FROM s GROUP BY rep, n_copies),
p AS (SELECT a.rep AS a, b.rep AS b, count(*) AS both FROM s a JOIN s b ON a.g = b.g AND a.rep < b.rep GROUP BY a.rep, b.rep),
l AS (SELECT p.a, p.b, x.n_copies AS na, y.n_copies AS nb FROM p JOIN z x ON p.a = x.rep JOIN z y ON p.b = y.rep WHERE 5 * p.both >= 4 * (x.size + y.size - p.both)),
e AS (SELECT a, b, nb AS n FROM l UNION ALL SELECT b, a, na FROM l),
reach AS (SELECT rep AS v, rep AS c FROM t UNION SELECT r.v, e.b FROM reach r JOIN e ON r.c = e.a),
cls AS (SELECT v, min(c) AS class_id FROM reach GROUP BY v),
n AS (SELECT a AS v, sum(n) AS links FROM e GROUP BY a)
SELECT d.doc_id, coalesce(cls.class_id, d.doc_id) AS class_id, CAST(coalesce(n.links, 0) + coalesce(t.n_copies, 1) - 1 AS BIGINT) AS n_links, coalesce(t.n_copies, 1) AS n_copies
FROM d LEFT JOIN t ON d.ws = t.ws LEFT JOIN cls ON t.rep = cls.v LEFT JOIN n ON t.rep = n.v
""",
    "op7_pii": r"""
WITH kinds AS (
  SELECT * FROM (VALUES (0, 'email'), (1, 'ip'), (2, 'card'), (3, 'phone')) k(no, kind)
),
m AS (
  SELECT doc_id, text, no, kind,
    CASE no WHEN 0 THEN regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 1 THEN regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')
      WHEN 2 THEN regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9]){11,}') ELSE regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]') END AS ms,
    CASE no WHEN 0 THEN string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') WHEN 1 THEN string_split_regex(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')
      WHEN 2 THEN string_split_regex(text, '[0-9](?:[\x20-]?[0-9]){11,}') ELSE string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') END AS ps
  FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents) d CROSS JOIN kinds
),
x AS (SELECT doc_id, text, no, kind, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS v, unnest(ps[:len(ms)]) AS before, unnest(ps[2:]) AS after FROM m WHERE len(ms) > 0),
y AS (
  SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS digits,
    CAST(sum(length(before) + length(v)) OVER (PARTITION BY doc_id, no ORDER BY i) AS BIGINT) AS e FROM x
),
b AS (
  SELECT doc_id, text, no, kind, e - length(v) AS s, e, kind || ':' || CASE WHEN no < 2 THEN lower(v) ELSE digits END AS entity, before, after FROM y
  WHERE CASE no WHEN 1 THEN len(list_filter(string_split(v, '.'), lambda q: CAST(q AS HUGEINT) > 255)) = 0
    WHEN 2 THEN length(digits) BETWEEN 12 AND 19 AND list_sum(list_transform(range(length(digits)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(digits[length(digits) - i] AS INTEGER)
      ELSE (CAST(digits[length(digits) - i] AS INTEGER) * 2) // 10 + (CAST(digits[length(digits) - i] AS INTEGER) * 2) % 10 END)) % 10 = 0
    WHEN 3 THEN length(digits) BETWEEN 9 AND 15 ELSE true END
),
-- secrets: long strings of high entropy
sm AS (SELECT doc_id, text, regexp_extract_all(text, '[A-Za-z0-9+/_=-]{20,}') AS ms, string_split_regex(text, '[A-Za-z0-9+/_=-]{20,}') AS ps FROM documents WHERE text IS NOT NULL),
sx AS (SELECT doc_id, text, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS v, unnest(ps[:len(ms)]) AS before FROM sm WHERE len(ms) > 0),
sy AS (SELECT *, CAST(sum(length(before) + length(v)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e, list_distinct(string_split(v, '')) AS cs FROM sx),
sb AS (
  SELECT doc_id, text, 4 AS no, 'secret' AS kind, e - length(v) AS s, e, 'secret:' || v AS entity FROM sy
  WHERE regexp_matches(v, '[0-9].*[0-9].*[0-9].*[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '[a-z]{7}')
    AND -list_sum(list_transform(cs, lambda c: (length(v) - length(replace(v, c, ''))) / length(v) * log2((length(v) - length(replace(v, c, ''))) / length(v)))) >= 3.0
),
ab AS (SELECT doc_id, text, no, kind, s, e, entity FROM b UNION ALL SELECT * FROM sb),
-- every word of every text
bag AS (SELECT DISTINCT text, lower(term) AS term FROM (SELECT text, unnest(regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+')) AS term FROM documents) q),
held AS (SELECT DISTINCT text, entity FROM ab),
ent AS (SELECT entity, count(*) AS n FROM held GROUP BY entity HAVING count(*) >= 3),
et AS (SELECT held.entity, bag.term, count(*) AS n FROM held JOIN ent ON held.entity = ent.entity JOIN bag ON held.text = bag.text GROUP BY held.entity, bag.term HAVING count(*) >= 3),
ter AS (SELECT term, count(*) AS n FROM bag WHERE term IN (SELECT term FROM et) GROUP BY term),
told AS (
  SELECT et.entity, et.term FROM et JOIN ent ON et.entity = ent.entity JOIN ter ON et.term = ter.term CROSS JOIN (SELECT CAST(count(DISTINCT coalesce(text, '')) AS DOUBLE) AS n FROM documents) a
  WHERE a.n > ent.n AND log2(et.n * a.n / (ent.n * ter.n)) / log2(a.n / ent.n) >= 0.9
),
-- where they stand, outside the other spans
ht AS (SELECT DISTINCT held.text, told.term FROM held JOIN told ON held.entity = told.entity),
hm AS (SELECT doc_id, text, regexp_extract_all(text, '[\p{L}\p{M}\p{N}]+') AS ms, string_split_regex(text, '[\p{L}\p{M}\p{N}]+') AS ps FROM documents WHERE text IN (SELECT text FROM ht)),
hx AS (SELECT doc_id, text, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS w, unnest(ps[:len(ms)]) AS pre FROM hm),
hy AS (SELECT *, CAST(sum(length(pre) + length(w)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS e FROM hx),
h AS (
  SELECT hy.doc_id, hy.e - length(hy.w) AS s, hy.e FROM hy JOIN ht ON hy.text = ht.text AND lower(hy.w) = ht.term
  WHERE NOT EXISTS (SELECT 1 FROM ab WHERE ab.doc_id = hy.doc_id AND hy.e - length(hy.w) < ab.e AND ab.s < hy.e)
),
u AS (SELECT doc_id, no, kind, s, e FROM ab UNION ALL SELECT doc_id, 5, 'term', s, e FROM h),
line AS (
  SELECT doc_id, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) FILTER (no < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, no) AS spans,
    count(*) FILTER (no = 0) AS n_email, count(*) FILTER (no = 1) AS n_ip, count(*) FILTER (no = 2) AS n_card, count(*) FILTER (no = 3) AS n_phone, count(*) FILTER (no = 4) AS n_secret, count(*) FILTER (no = 5) AS n_term FROM u GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_secret, 0) AS n_secret, coalesce(n_term, 0) AS n_term, coalesce(n_email, 0) + coalesce(n_ip, 0) + coalesce(n_card, 0) + coalesce(n_phone, 0) + coalesce(n_secret, 0) + coalesce(n_term, 0) AS n_spans
FROM documents d LEFT JOIN line ON d.doc_id = line.doc_id
""",
    "op6_line_dedup": r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents),
w AS (
  SELECT doc_id, p, lines[p + 1] AS a, lines[p + 2] AS b, lines[p + 3] AS c
  FROM (SELECT doc_id, lines, unnest(range(len(lines) - 2)) AS p FROM l WHERE len(lines) >= 3)
),
o AS (
  SELECT *, first_value(doc_id) OVER g AS fd, first_value(p) OVER g AS fp, row_number() OVER g AS r
  FROM w WINDOW g AS (PARTITION BY a, b, c ORDER BY doc_id, p ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(CASE WHEN doc_id = fd THEN greatest(p, fp + 3) ELSE p END, p + 3)) AS q
  FROM o WHERE r > 1
),
each AS (SELECT doc_id, len(lines) AS n, unnest(lines) AS line, unnest(range(len(lines))) AS q FROM l),
kept AS (
  SELECT e.doc_id, e.n, count(g.q) AS n_removed, coalesce(string_agg(CASE WHEN g.q IS NULL THEN e.line END, chr(10) ORDER BY e.q), '') AS text
  FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.q = g.q GROUP BY e.doc_id, e.n
)
SELECT d.doc_id, CAST(coalesce(k.n, 0) AS INTEGER) AS n_lines, CAST(coalesce(k.n_removed, 0) AS INTEGER) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
""",
    "op8_mixing": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5(concat_ws(chr(31), CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))) AS o
  FROM documents
),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM d GROUP BY source
),
w AS (SELECT *, CASE (rank - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, 2.0::DOUBLE * source_size AS most, (SELECT 1.5::DOUBLE * sum(size) FROM d) AS total FROM s),
-- water levels: fill what is above its cap, share the rest again, as often as there are sources
level AS (
  SELECT 0 AS step, (SELECT max(total) / sum(w) FROM w)::DOUBLE AS lvl
  UNION ALL
  SELECT step + 1, (SELECT CASE WHEN sum(CASE WHEN w.w * lvl < most THEN w.w ELSE 0 END) > 0
      THEN (max(total) - sum(CASE WHEN w.w * lvl < most THEN 0 ELSE most END)) / sum(CASE WHEN w.w * lvl < most THEN w.w ELSE 0 END) ELSE lvl END FROM w)
  FROM level WHERE step <= (SELECT count(*) FROM s)
),
t AS (SELECT source, rank, source_size, least(most, w * (SELECT lvl FROM level ORDER BY step DESC LIMIT 1)) AS target FROM w),
c AS (
  SELECT d.doc_id, d.size, t.source_size, t.rank, t.target, CAST(round(t.target) AS BIGINT) AS quota,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
),
g AS (
  SELECT *, greatest(0, least(size, quota - start)) AS once, greatest(0, least(size, quota - source_size - start)) AS twice FROM c
),
y AS (
  SELECT *, (start + once / 2) / greatest(1, target) AS y1, (start + source_size + twice / 2) / greatest(1, target) AS y2 FROM g
),
z AS (
  SELECT *,
    CASE (rank - 1) % 3
      WHEN 0 THEN 2 * y1 / (1.5 + sqrt(greatest(0, 2.25 - 2 * y1)))
      WHEN 1 THEN y1
      ELSE CASE WHEN y1 * 0.95 <= 0.18 THEN 2 * (y1 * 0.95) / (0.4 + sqrt(greatest(0, 0.16 + 2 * (0.4 / 0.3) * (y1 * 0.95))))
        ELSE 0.3 + 2 * (y1 * 0.95 - 0.18) / (0.8 + sqrt(greatest(0, 0.64 + 2 * (0.6 / 0.7) * (y1 * 0.95 - 0.18)))) END END AS p1,
    CASE (rank - 1) % 3
      WHEN 0 THEN 2 * y2 / (1.5 + sqrt(greatest(0, 2.25 - 2 * y2)))
      WHEN 1 THEN y2
      ELSE CASE WHEN y2 * 0.95 <= 0.18 THEN 2 * (y2 * 0.95) / (0.4 + sqrt(greatest(0, 0.16 + 2 * (0.4 / 0.3) * (y2 * 0.95))))
        ELSE 0.3 + 2 * (y2 * 0.95 - 0.18) / (0.8 + sqrt(greatest(0, 0.64 + 2 * (0.6 / 0.7) * (y2 * 0.95 - 0.18)))) END END AS p2
  FROM y
)
SELECT doc_id, size, source_size, round(target, 6) AS target, once + twice AS taken,
  CASE WHEN once > 0 THEN round(p1, 6) END AS first_position, CASE WHEN twice > 0 THEN round(p2, 6) END AS second_position
FROM z
""",
    "op10_decontamination": rf"""
WITH src AS (
  SELECT 'd' AS side, doc_id AS id, trim(regexp_replace(coalesce(text, ''), '[\x01-\x07\x20\x09-\x0D]+', ' ', 'g'), ' ') AS s FROM documents
  UNION ALL SELECT 'b', item_id, trim(regexp_replace(coalesce(text, ''), '[\x01-\x07\x20\x09-\x0D]+', ' ', 'g'), ' ') FROM benchmark
),
w AS (SELECT side, id, unnest(string_split(s, ' ')) AS raw, unnest(range(len(string_split(s, ' ')))) AS p FROM src WHERE s <> ''),
k AS (
  SELECT *, regexp_replace(lower(raw), '(.){_CLOSING}+$', '\1') AS lit, regexp_replace(lower(raw), '{_CLOSING}+$', '') AS val,
    CASE WHEN regexp_matches(raw, '^[^\p{{L}}\p{{N}}]*(\p{{N}}|(?i:{_NUMBERS})(-(?i:{_NUMBERS}))*[^\p{{L}}\p{{N}}]*$)') THEN 'n' ELSE '' END AS k1
  FROM w
),
k2 AS (SELECT *, CASE WHEN k1 = '' AND lag(k1) OVER o = 'n' AND regexp_matches(raw, '^(?i:{_UNITS}){_CLOSING}*$') THEN 'u' ELSE k1 END AS k2 FROM k WINDOW o AS (PARTITION BY side, id ORDER BY p)),
-- plain words are those that an item has in lower case; any other is a name
voc AS (SELECT DISTINCT lit FROM k2 WHERE side = 'b' AND k2 = '' AND id IS NOT NULL AND NOT regexp_matches(raw, '^[^\p{{L}}\p{{N}}]*\p{{Lu}}')),
u AS (SELECT k2.*, CASE WHEN k2 = '' AND voc.lit IS NULL THEN 'c' ELSE k2 END AS kind FROM k2 LEFT JOIN voc ON k2.lit = voc.lit),
-- tok: the number of plain words before; run: consecutive slots of a kind
r AS (
  SELECT *, coalesce(sum(CAST(kind = '' AS INT)) OVER (PARTITION BY side, id ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS tok,
    sum(CAST(kind <> prev AS INT)) OVER (PARTITION BY side, id ORDER BY p) AS run
  FROM (SELECT *, coalesce(lag(kind) OVER (PARTITION BY side, id ORDER BY p), '-') AS prev FROM u) q
),
runs AS (SELECT side, id, tok, run, kind, kind || string_agg(val, chr(6) ORDER BY p) AS slot FROM r WHERE kind <> '' GROUP BY side, id, tok, run, kind),
pre AS (SELECT side, id, tok, string_agg(kind, '' ORDER BY run) AS kinds, list(slot ORDER BY run) AS slots FROM runs GROUP BY side, id, tok),
toks AS (
  SELECT r.side, r.id, list(r.lit ORDER BY r.tok) AS own, list(coalesce(pre.kinds, '') || ' ' || r.lit ORDER BY r.tok) AS tpl, list(coalesce(pre.slots, []) ORDER BY r.tok) AS slots
  FROM r LEFT JOIN pre ON r.side = pre.side AND r.id = pre.id AND r.tok = pre.tok WHERE r.kind = '' GROUP BY r.side, r.id
),
lits AS (SELECT side, id, list(lit ORDER BY p) AS lit FROM k GROUP BY side, id),
x AS (SELECT l.side, l.id, l.lit, coalesce(t.own, []) AS own, coalesce(t.tpl, []) AS tpl, coalesce(t.slots, []) AS slots FROM lits l LEFT JOIN toks t ON l.side = t.side AND l.id = t.id),
f AS (SELECT *, CASE WHEN len(own) >= 5 THEN 't' WHEN len(lit) >= 5 THEN 'x' ELSE 'w' END AS form, CASE WHEN len(own) >= 5 THEN least(len(own), 6) ELSE least(len(lit), 8) END AS width FROM x WHERE side = 'b'),
forms AS (SELECT DISTINCT form, CASE WHEN form = 'w' THEN 0 ELSE width END AS width FROM f),
v AS (
  SELECT x.*, forms.form, CASE WHEN forms.form = 'w' THEN len(lit) ELSE forms.width END AS width FROM x CROSS JOIN forms WHERE side = 'd' AND (forms.form <> 'w' OR len(lit) < 5)
  UNION ALL SELECT * FROM f
),
y AS (SELECT *, unnest(range(CASE WHEN form = 't' THEN len(own) ELSE len(lit) END - width + 1)) AS p FROM v),
win AS (
  SELECT side, id, p, form, CASE WHEN form = 't' THEN [own[p + 1]] || tpl[p + 2:p + width] ELSE lit[p + 1:p + width] END AS ws,
    CASE WHEN form = 't' THEN flatten(slots[p + 2:p + width]) ELSE [] END AS slots
  FROM y
),
b AS (SELECT * FROM win WHERE side = 'b'),
hit AS (SELECT d.id AS doc_id, b.id AS item_id, b.p AS bp, d.p AS dp, b.slots AS was, d.slots AS now FROM win d JOIN b ON d.form = b.form AND d.ws = b.ws WHERE d.side = 'd'),
pairs AS (SELECT *, 'all' AS grp FROM hit UNION ALL SELECT *, CAST(dp - bp AS VARCHAR) FROM hit),
slots AS (SELECT DISTINCT * FROM (SELECT doc_id, item_id, grp, bp, dp, unnest(was) AS was, unnest(now) AS now FROM pairs WHERE len(was) > 0) q),
votes AS (SELECT doc_id, item_id, grp, was, now, count(*) AS n FROM slots GROUP BY ALL),
best AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id, grp, was ORDER BY n DESC, now) AS r FROM votes) q WHERE r = 1
),
bad AS (
  SELECT DISTINCT s.doc_id, s.item_id, s.grp, s.bp, s.dp FROM slots s JOIN best m ON s.doc_id = m.doc_id AND s.item_id = m.item_id AND s.grp = m.grp AND s.was = m.was
  WHERE s.now <> m.now
),
hits AS (
  SELECT p.doc_id, p.item_id, p.grp, count(DISTINCT p.bp) AS n FROM pairs p
  LEFT JOIN bad ON p.doc_id = bad.doc_id AND p.item_id = bad.item_id AND p.grp = bad.grp AND p.bp = bad.bp AND p.dp = bad.dp WHERE bad.bp IS NULL GROUP BY p.doc_id, p.item_id, p.grp
),
sl AS (SELECT doc_id, item_id, grp, count(*) AS n_slots, sum(CAST(was <> now AS INT)) AS changed FROM best GROUP BY doc_id, item_id, grp),
tot AS (SELECT id AS item_id, count(DISTINCT p) AS n_windows FROM b GROUP BY id),
g AS (
  SELECT h.doc_id, h.item_id, h.n, coalesce(sl.n_slots, 0) AS n_slots, coalesce(sl.changed, 0) AS changed, t.n_windows
  FROM hits h JOIN tot t ON h.item_id = t.item_id LEFT JOIN sl ON h.doc_id = sl.doc_id AND h.item_id = sl.item_id AND h.grp = sl.grp
  WHERE h.n >= t.n_windows * 0.5
)
SELECT doc_id, item_id, n_windows, n AS n_hits, n_slots, changed = 0 AS exact
FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY n DESC, changed, n_slots DESC) AS r FROM g) q WHERE r = 1
""",
    "op11_collocations": r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text, row_number() OVER () AS row FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(text, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
pos AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, m, array_to_string(ws[i:i + m - 1], ' ') AS phrase FROM pos CROSS JOIN range(1, 6) r(m) WHERE i + m - 1 <= len(ws)),
f AS (SELECT lang, phrase, m, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM f WHERE m = 1 GROUP BY lang),
p AS (SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE f >= 100),
cut AS (SELECT lang, phrase, m, f, array_to_string(ws[:k], ' ') AS first, array_to_string(ws[k + 1:], ' ') AS rest, k FROM (SELECT *, unnest(range(1, m)) AS k FROM p WHERE m > 1) q),
s AS (
  SELECT cut.lang, cut.phrase, cut.f AS a, l.f AS l, r.f AS r, n.n, CAST((1000::HUGEINT * cut.f * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score, k
  FROM cut JOIN p l ON cut.lang = l.lang AND cut.first = l.phrase JOIN p r ON cut.lang = r.lang AND cut.rest = r.phrase JOIN n ON cut.lang = n.lang
),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (SELECT lang, f, array_to_string(ws[i:j], ' ') AS phrase FROM p CROSS JOIN range(1, 6) x(i) CROSS JOIN range(1, 6) y(j) WHERE i <= j AND j <= m AND j - i + 1 < m),
longer AS (SELECT lang, phrase, max(f) AS f FROM inside GROUP BY lang, phrase)
SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, n, score
FROM b LEFT JOIN longer ON b.lang = longer.lang AND b.phrase = longer.phrase WHERE longer.f IS NULL OR 100 * longer.f < 100 * a
QUALIFY rank <= 2000
""",
    "op12_exact_dedup": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER g AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER g = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW g AS (PARTITION BY norm ORDER BY length(t) DESC, doc_id)
""",
    "op13_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.id AS negative_id, positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.id)
QUALIFY row_number() OVER w <= 3
""",
}
