"""Queries that apply the training-data operators to the given tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives as hard
from . import impact_search as search
from . import language_id, prefix_trie
from . import license_scan as licenses
from . import mixing, packing, pii
from . import near_dedup as near
from . import quality_gam as gam
from . import quality_rules as rules
from . import token_files as tokens
from . import toxicity
from .common import held_out, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn=None, *, sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add(fn) if fn else add


def _rules_sql(config: rules.RuleConfig = rules.RuleConfig()) -> str:
    w = r"[^\x20\x09-\x0D]+"
    names = [f.rate for f in config.fences]
    rate = ", ".join(f"coalesce(1000 * {p} // nullif({q}, 0), 0) AS {r}" for r, (p, q) in rules.RATES.items())
    at = "v - v % (1::BIGINT << greatest(length(bin(v)) - 6, 0))"
    tall = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rate, {r} AS v FROM m WHERE NOT base_failed" for r in names)

    def level(name: str, keys: str) -> str:
        by = f"{keys}, " if keys else ""
        limit = ", ".join(
            f"max(CASE WHEN rate = '{f.rate}' THEN " + (f"q1 - {f.spread} * (q3 - q1) - {f.slack}" if f.below else f"q3 + {f.spread} * (q3 - q1) + {f.slack}")
            + f" END) AS {f.rate}" for f in config.fences)
        return (
            f"{name} AS (SELECT {by}max(total) AS total, {limit} FROM (SELECT {by}rate, max(total) AS total, "
            "min(CASE WHEN 4 * upto >= total THEN slot END) AS q1, min(CASE WHEN 4 * upto >= 3 * total THEN slot END) AS q3 FROM ("
            f"SELECT *, sum(n) OVER (PARTITION BY {by}rate ORDER BY slot) AS upto, sum(n) OVER (PARTITION BY {by}rate) AS total "
            f"FROM (SELECT {by}rate, slot, count(*) AS n FROM s GROUP BY ALL)) GROUP BY {by}rate)" + (f" GROUP BY {keys}" if keys else "") + ")")

    pick = lambda f: (f"CASE WHEN g.total >= {config.min_group} THEN g.{f.rate} WHEN l.total >= {config.min_group} THEN l.{f.rate} ELSE a.{f.rate} END")
    verdict = " AND ".join(f"NOT coalesce(m.{f.rate} {'<' if f.below else '>'} {pick(f)}, false)" for f in config.fences)
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '{w}') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{w}')) AS ls FROM d),
p AS (SELECT r, unnest(range(1, len(ws) - 1)) AS i, ws FROM w WHERE len(ws) >= 3),
q AS (SELECT r, i, count(*) OVER (PARTITION BY r, ws[i], ws[i + 1], ws[i + 2]) AS n FROM p),
k AS (SELECT r, count(DISTINCT pos) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS pos FROM q WHERE n > 1) GROUP BY r),
c AS (SELECT r, doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, length(t) - length(replace(t, '!', '')) AS n_shout,
  length(regexp_replace(t, '[^\\p{{Lu}}]+', '', 'g')) AS n_upper, len(list_distinct(ws)) AS n_distinct, len(ls) AS n_lines,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM w LEFT JOIN k USING (r)),
m AS (SELECT *, {rate}, n_words < {config.min_words} OR 100 * n_repeat_words > {config.max_repeat_pct} * n_words AS base_failed FROM c),
s AS (SELECT lang, source, rate, {at} AS slot FROM ({tall})),
{level("g", "lang, source")}, {level("l", "lang")}, {level("a", "")}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {verdict} AS kept
FROM m LEFT JOIN g ON m.lang IS NOT DISTINCT FROM g.lang AND m.source IS NOT DISTINCT FROM g.source
LEFT JOIN l ON m.lang IS NOT DISTINCT FROM l.lang CROSS JOIN a"""


@query(sql=_rules_sql())
def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the quality rules for every document."""
    return rules.apply_rules(table(spark, sf_dir, "documents")).select("doc_id", *rules.COUNTS, "base_failed", "kept")


def _license_sql(stride: int = licenses.STRIDE) -> str:
    values = ", ".join(f"({k}, '{t.label}', '{t.text}', {licenses.required(t)}, {len(licenses.template_words(t))}, {str(t.ordered).lower()})"
                       for k, t in enumerate(licenses.BASE + licenses.NOTICES))
    return f"""
WITH t AS (SELECT k, label, string_split(phrase, ' ') AS ph, need, m, ordered FROM (VALUES {values}) v(k, label, phrase, need, m, ordered)),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT r, ws[o + 1:o + {2 * stride}] AS block FROM (SELECT r, ws, unnest(range(0, len(ws), {stride})) AS o FROM d)),
f AS (SELECT r, label, len(list_intersect(block, ph)) / m AS share FROM b JOIN t ON NOT ordered AND len(list_intersect(block, ph)) >= need),
o AS (SELECT r, label, i - 1 AS start FROM (SELECT r, ws, unnest(range(1, len(ws) + 1)) AS i FROM d) JOIN t ON ordered AND ws[i] = ph[1] AND ws[i:i + len(ph) - 1] = ph),
a AS (SELECT r, label, share, NULL AS start, false AS base FROM f UNION ALL SELECT r, label, 1.0, start, true FROM o)
SELECT any_value(doc_id) AS doc_id, CAST(any_value(len(ws)) AS BIGINT) AS n_words, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word,
  coalesce(string_agg(DISTINCT CASE WHEN base THEN label END, ',' ORDER BY CASE WHEN base THEN label END), '') AS base_labels,
  coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels, CAST(coalesce(max(share), 0) AS DOUBLE) AS score
FROM d LEFT JOIN a USING (r) GROUP BY r"""


@query(sql=_license_sql())
def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices found in every document."""
    return licenses.per_document(licenses.scan(table(spark, sf_dir, "documents")))


@query
def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back."""
    return tokens.read(tokens.write(table(spark, sf_dir, "documents"), end_id=0))


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 1,024 tokens."""
    return packing.pack(table(spark, sf_dir, "documents"), capacity=1024, end_id=2).drop("row")


@query(sql="""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(x::DOUBLE * 64)) AS v FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT * FROM (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s) WHERE rank <= 20""")
def op6_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best partners of every 20th vector by whole-number inner product."""
    return search.top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


#: Weights of the tree; sources of a language weigh the same.
MIX = mixing.Mix(weights={"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 5, "de": 2, "fr": 2, "es": 1}}, epochs=2, budget_pct=100)
DOMAIN = "'d' || CAST(CAST(nullif(regexp_extract(source, '([0-9]+)', 1), '') AS BIGINT) % 4 AS STRING)"


def with_domain(docs: DataFrame) -> DataFrame:
    """Documents with the domain that the tree has above the languages: sources are dealt to four."""
    return docs.withColumn("domain", F.expr(DOMAIN))


def _mix_sql(mix: mixing.Mix = MIX) -> str:
    case = lambda c: f"CASE {' '.join(f'WHEN {c} = {v!r} THEN {w}' for v, w in mix.weights.get(c, {}).items())} ELSE {mix.default_weight} END" if mix.weights.get(c) else str(mix.default_weight)
    steps = [f"b0 AS (SELECT any_value(root) AS root, CAST(sum(size) * {mix.budget_pct} // 100 AS HUGEINT) AS budget FROM leaves)"]
    for i, c in enumerate(mix.levels):
        up = ["root", *mix.levels[:i]]
        keys = ", ".join([*up, c])
        on = " AND ".join(f"n.{k} IS NOT DISTINCT FROM b.{k}" for k in up)
        over = f"PARTITION BY {', '.join(up)} ORDER BY weight = 0, capacity / nullif(weight, 0), {c} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        steps.append(f"""n{i} AS (SELECT n.*, b.budget AS given FROM (SELECT {keys}, {case(c)} AS weight, CAST(sum(size) AS HUGEINT) AS size, CAST(sum(capacity) AS HUGEINT) AS capacity FROM leaves GROUP BY {keys}) n JOIN b{i} b ON {on}),
l{i} AS (SELECT *, given - coalesce(sum(capacity) OVER ({over}), 0) AS rem, sum(weight) OVER (PARTITION BY {', '.join(up)}) - coalesce(sum(weight) OVER ({over}), 0) AS wide FROM n{i}),
s{i} AS (SELECT *, weight > 0 AND rem >= 0 AND capacity * wide <= rem * weight AS short FROM l{i}),
b{i + 1} AS (SELECT *, CASE WHEN weight = 0 THEN 0 WHEN short THEN capacity ELSE max(CASE WHEN NOT short AND weight > 0 THEN rem END) OVER (PARTITION BY {', '.join(up)}) * weight
  // max(CASE WHEN NOT short THEN wide END) OVER (PARTITION BY {', '.join(up)}) END AS budget FROM s{i})""")
    on = " AND ".join(f"d.{k} IS NOT DISTINCT FROM b.{k}" for k in mix.levels)
    live = " AND ".join(f"{case(c)} > 0" for c in mix.levels)
    return f"""
WITH d AS (SELECT doc_id, text, lang, source, {DOMAIN} AS domain, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens FROM documents),
leaves AS (SELECT 0 AS root, {', '.join(mix.levels)}, sum(tokens) AS size, CASE WHEN {live} THEN sum(tokens) * {mix.epochs} ELSE 0 END AS capacity FROM d GROUP BY {', '.join(mix.levels)}),
{", ".join(steps)},
e AS (SELECT d.*, b.budget, b.size, unnest(range({mix.epochs})) AS epoch FROM d JOIN b{len(mix.levels)} b ON {on} WHERE b.budget > 0),
o AS (SELECT *, epoch * size + sum(tokens) OVER (PARTITION BY {', '.join(mix.levels)}, epoch ORDER BY md5('{mix.seed}:' || epoch || ':' || doc_id), doc_id, text ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT doc_id, domain, lang, source, CAST(epoch AS INTEGER) AS epoch, CAST(tokens AS BIGINT) AS tokens FROM o WHERE upto <= budget"""


@query(sql=_mix_sql())
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents taken, with their epoch, when the corpus' tokens are dealt anew by target weights, two epochs at most."""
    taken = mixing.select(with_domain(table(spark, sf_dir, "documents")), MIX)
    return taken.select("doc_id", "domain", "lang", "source", "epoch", "tokens")


def _classified(docs: DataFrame, score, threshold: float) -> DataFrame:
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


@query
def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    docs = table(spark, sf_dir, "documents")
    return _classified(docs, gam.score(gam.train(docs, table(spark, sf_dir, "labels")), F.col("text")), 0.5)


@query
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs = table(spark, sf_dir, "documents")
    return _classified(docs, toxicity.score(toxicity.train(docs, table(spark, sf_dir, "labels")), F.col("text")), 0.7)


@query
def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of personal data in every document."""
    found = pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    return found.select("doc_id", *[F.size(F.filter(kinds, F.lit(kind).__eq__)).cast("bigint").alias(f"n_{kind}") for kind in pii.BASE],
                        F.sha2(pii.digest(base), 256).alias("base_sha256"), pii.digest(F.col("spans")).alias("spans"))


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group of near-equal documents that each document is in; 2-word shingles, similarity 0.8."""
    return near.groups(table(spark, sf_dir, "documents"), near.JoinConfig(words=2))


@query(sql="""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(x::DOUBLE * 256)) AS v
  FROM embeddings WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM v a JOIN v c ON a.vec_id <> c.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT * FROM (SELECT anchor_id, vec_id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS r FROM s WHERE same) WHERE r <= 5)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM (
  SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score) WHERE rank <= 3""")
def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three negatives for each of the five positives of every 50th vector."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard.mine(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, label=label)


@query
def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    docs = table(spark, sf_dir, "documents")
    out = language_id.held_out(F.col("doc_id"))
    return language_id.identify(docs, language_id.train(docs.where(~out)), [F.col("doc_id"), out.alias("held_out")])


@query(sql="""
WITH t AS (SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (SELECT conv_id, own, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h FROM t),
b AS (SELECT h.conv_id, list_concat(coalesce(t.own, [])[1:h], h.own[h + 1:]) AS s FROM h LEFT JOIN t ON t.conv_id = h.conv_id - h.conv_id % 100),
n AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM b),
g AS (SELECT d, s[1:d] AS p, min(conv_id) AS conv_id, count(*) AS n, coalesce(string_agg(CASE WHEN len(s) = d THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '') AS ends FROM n GROUP BY d, s[1:d]),
c AS (SELECT d - 1 AS d, p[1:d - 1] AS p, count(*) AS children FROM g WHERE d > 0 GROUP BY ALL),
m AS (SELECT g.*, coalesce(children, 0) AS children, CASE WHEN d > 0 THEN (n - 1) * length(p[d].text) ELSE 0 END AS own FROM g LEFT JOIN c USING (d, p))
SELECT any_value(a.conv_id) AS conv_id, a.d AS depth, any_value(u.conv_id) AS parent_conv_id, any_value(a.n) AS n_convs, any_value(a.children) AS n_children,
  count(*) FILTER (x.children = 0) AS n_leaves, CAST(sum(x.own) AS BIGINT) AS saved_tokens, sha256(any_value(a.ends)) AS ends_sha256
FROM m a JOIN m x ON x.d >= a.d AND x.p[1:a.d] = a.p LEFT JOIN m u ON u.d = a.d - 1 AND u.p = a.p[1:a.d - 1] GROUP BY a.d, a.p""")
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the prefix trie of the rebuilt conversations."""
    return prefix_trie.nodes(prefix_trie.rebuild(table(spark, sf_dir, "conversations")))
