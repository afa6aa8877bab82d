"""Registered queries: duplicates, stories, joins, claims and summaries."""

from __future__ import annotations



from pyspark.sql import functions as F

from ..functions import text as t
from ..operators import dedupe as dd
from ..operators import merge as mg
from ..operators import select as sel
from ..operators import similarity as sim
from ..operators import stories as st
from ..operators import summaries as sm
from ..config import CORROBORATION_STOPWORDS, STORY_STOPWORDS
from ..operators.scan import previous, running
from .ratio_sql import ratio_ctes
from ..sources import tables
from . import fixtures as fx
from .queries_core import diverse_sql
from .registry import query

_EXC = f"left(coalesce(nullif({fx.sql_story_text('content')}, ''), nullif({fx.sql_story_text('description')}, ''), ''), 280)"


def _tok(x: str, stop=STORY_STOPWORDS) -> str:
    return f"list_distinct(list_filter(regexp_extract_all({x}, '{fx.WD}+'), lambda z: length(z) >= 4 AND z NOT IN ({', '.join(repr(w) for w in stop)})))"


def _jac(x: str, y: str) -> str:
    shared = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE {shared}::DOUBLE / (len({x}) + len({y}) - {shared}) END"


_FEW = (lambda x: f"len(list_filter(string_split({x}.exc, ' '), lambda z: length(z) > 0)) < 6")


def _alike(x: str, y: str) -> str:
    """Similarity of two stories, with their title ratio in ``ratio``."""
    return f"""CASE WHEN length({x}.st) = 0 OR length({y}.st) = 0 THEN 0.0 WHEN {x}.st = {y}.st AND {x}.exc = {y}.exc THEN 1.0
    WHEN ({_FEW(x)} OR {_FEW(y)}) AND ratio < 0.92 THEN 0.0 ELSE CAST(format('{{:.4f}}', ratio * 0.65 + ({_jac(x + '.tok', y + '.tok')}) * 0.35) AS DOUBLE) END"""


# --- duplicates --------------------------------------------------------------
@query("dedup_url", f"""WITH {fx.ARTICLES} SELECT id, url FROM articles QUALIFY row_number() OVER (PARTITION BY coalesce(nullif(url, ''), id::VARCHAR) ORDER BY collected_at, id) = 1""")
def _(spark, sf):
    return dd.dedup_url(fx.articles(spark, sf)).select("id", "url")


def _batched(spark, sf):
    return fx.articles(spark, sf).withColumn("batch", F.to_date("collected_at"))


@query("dedup_title", f"""WITH RECURSIVE {fx.ARTICLES},
ti AS MATERIALIZED (SELECT id, published_at AS pub, collected_at::DATE AS d, {fx.sql_title_key("title")} AS t, row_number() OVER (PARTITION BY collected_at::DATE ORDER BY collected_at, id) AS rn FROM articles),
tp AS (SELECT DISTINCT x.t AS a, y.t AS b FROM ti x JOIN ti y ON x.d = y.d AND y.rn < x.rn AND x.t <> y.t
  AND 2.0 * least(length(x.t), length(y.t)) >= 0.85 * (length(x.t) + length(y.t)) AND len(list_intersect(string_split(x.t, ''), string_split(y.t, ''))) > 0),
{ratio_ctes("tp", "ra")},
sl AS MATERIALIZED (SELECT a, list(b) AS near FROM ra WHERE ratio >= 0.85 GROUP BY a),
tn AS MATERIALIZED (SELECT ti.*, coalesce(near, []::VARCHAR[]) AS near FROM ti LEFT JOIN sl ON sl.a = ti.t),
w(d, rn, st) AS (SELECT d, 0::BIGINT, []::STRUCT(t VARCHAR, id BIGINT, p TIMESTAMP)[] FROM (SELECT DISTINCT d FROM tn) UNION ALL
  SELECT d, rn, CASE WHEN hit IS NULL THEN list_append(st, {{'t': t, 'id': id, 'p': pub}})
    WHEN pub IS NOT NULL AND (st[hit].p IS NULL OR pub > st[hit].p) THEN list_transform(st, lambda x, i: CASE WHEN i = hit THEN {{'t': t, 'id': id, 'p': pub}} ELSE x END) ELSE st END
  FROM (SELECT w.d, tn.rn, st, tn.t, tn.id, tn.pub, list_position(list_transform(st, lambda x: x.t = tn.t OR list_contains(tn.near, x.t)), true) AS hit
    FROM w JOIN tn ON tn.d = w.d AND tn.rn = w.rn + 1))
SELECT unnest(list_transform(arg_max(st, rn), lambda x: x.id)) AS id FROM w GROUP BY d""")
def _(spark, sf):
    return dd.dedup_title(_batched(spark, sf), ["batch"])


_KEYED = f"""{fx.ARTICLES}, k0 AS (SELECT *, coalesce(published_at, collected_at) AS pub, {_EXC} AS exc, {fx.sql_story_text("title")} AS st FROM articles),
tk AS MATERIALIZED (SELECT id, source, is_active, pub, collected_at, st, exc, {_tok("concat_ws(' ', st, exc)")} AS tok FROM k0)"""


@query("story_pairs", f"""WITH RECURSIVE {_KEYED}, pp AS MATERIALIZED (SELECT *, lag(id) OVER (PARTITION BY source ORDER BY collected_at, id) AS previous_id FROM tk),
pq AS (SELECT x.st AS a, y.st AS b FROM pp x JOIN tk y ON y.id = x.previous_id), {ratio_ctes("pq", "ra")}
SELECT x.id, x.previous_id, {_alike("x", "y")} AS similarity FROM pp x JOIN tk y ON y.id = x.previous_id JOIN ra ON ra.a = x.st AND ra.b = y.st""")
def _(spark, sf):
    """Similarity of each article to the one ingested before it from the same source."""
    keys = st.story_keys(fx.articles(spark, sf)).select("id", "source", "collected_at", F.struct(
        F.col("story_title").alias("title"), F.col("story_excerpt").alias("excerpt"),
        t.significant_tokens(F.concat_ws(" ", "story_title", "story_excerpt")).alias("tokens")).alias("a"))
    pairs = running(keys, ["source"], [F.col("collected_at"), F.col("id")], {"p": previous(F.struct("id", "a"))}).where("p IS NOT NULL")
    pairs = pairs.withColumn("b", F.col("p.a"))
    return pairs.select("id", F.col("p.id").alias("previous_id"), sim.story_similarity("a", "b").alias("similarity"))


_EXACT = f"""{fx.ARTICLES}, sk AS (SELECT *, coalesce(published_at, collected_at) AS pub, {_EXC} AS exc,
  {fx.sql_story_text("title")} AS st, {fx.sql_story_text("category")} AS sc, regexp_replace(regexp_replace(url, '[?#].*$', ''), '/+$', '') AS up FROM articles),
ky AS MATERIALIZED (SELECT id, is_active, category, pub, collected_at, sha256(left(concat_ws(' | ', nullif(sc, ''), nullif(st, ''), nullif(exc, '')), 500)) AS fp, st, exc, up FROM sk),
c1 AS (SELECT a.id, b.id AS m, row_number() OVER (PARTITION BY a.id ORDER BY b.pub DESC, b.id) AS rn FROM ky a JOIN ky b ON a.category = b.category AND a.fp = b.fp AND b.is_active
  AND (b.collected_at, b.id) < (a.collected_at, a.id) AND b.pub >= a.pub - INTERVAL 3 DAY),
c2 AS (SELECT a.id, b.id AS m, row_number() OVER (PARTITION BY a.id ORDER BY b.pub DESC, b.collected_at DESC, b.id) AS rn FROM ky a JOIN ky b ON a.up = b.up AND b.is_active
  AND (b.collected_at, b.id) < (a.collected_at, a.id) AND b.pub >= a.pub - INTERVAL 3 DAY),
ex AS (SELECT ky.id, coalesce(x.m, y.m) AS match_id, CASE WHEN x.m IS NOT NULL THEN 'fingerprint' ELSE 'url_normalized' END AS reason
  FROM ky LEFT JOIN c1 x ON x.id = ky.id AND x.rn = 1 LEFT JOIN c2 y ON y.id = ky.id AND y.rn = 1 WHERE coalesce(x.m, y.m) IS NOT NULL)"""


@query("story_match_exact", f"WITH {_EXACT} SELECT id, match_id, reason FROM ex")
def _(spark, sf):
    return st.match_exact(fx.articles(spark, sf))


_MATCH = f"""{_EXACT}, {_KEYED.replace(fx.ARTICLES + ", ", "")},
cp AS MATERIALIZED (SELECT a.id, b.id AS m, a.st AS a, b.st AS b FROM tk a JOIN tk b ON b.is_active AND (b.collected_at, b.id) < (a.collected_at, a.id) AND b.pub >= a.pub - INTERVAL 3 DAY
  WHERE a.id NOT IN (SELECT id FROM ex) AND length(a.st) > 0 AND length(b.st) > 0 AND (a.st = b.st AND a.exc = b.exc OR {_jac("a.tok", "b.tok")} >= 0.57)),
{ratio_ctes("cp", "ra")},
sc AS (SELECT x.id, y.id AS m, y.pub, y.collected_at, ({_alike("x", "y")}) * (1.0::DOUBLE - (1.0::DOUBLE - 0.85::DOUBLE) * least(abs(epoch_us(x.pub) - epoch_us(y.pub)) / 3600000000.0::DOUBLE / 72.0::DOUBLE, 1.0::DOUBLE)) AS score
  FROM cp JOIN tk x ON x.id = cp.id JOIN tk y ON y.id = cp.m JOIN ra ON ra.a = cp.a AND ra.b = cp.b),
fz AS MATERIALIZED (SELECT id, m, score FROM sc WHERE score >= 0.85 QUALIFY row_number() OVER (PARTITION BY id ORDER BY score DESC, pub DESC, collected_at DESC, m) = 1),
fr AS MATERIALIZED (SELECT id FROM ky WHERE id NOT IN (SELECT id FROM ex) AND id NOT IN (SELECT id FROM fz)),
c3 AS (SELECT a.id, b.id AS m, row_number() OVER (PARTITION BY a.id ORDER BY b.id IN (SELECT id FROM fr) DESC, b.pub DESC, b.id) AS rn FROM ky a JOIN ky b ON a.category = b.category AND a.fp = b.fp AND b.is_active
  AND (b.collected_at, b.id) < (a.collected_at, a.id) AND b.pub >= a.pub - INTERVAL 3 DAY),
mt AS MATERIALIZED (SELECT ky.id, coalesce(x.m, y.m) AS match_id, CASE WHEN x.m IS NOT NULL THEN 'fingerprint' ELSE 'url_normalized' END AS reason, 1.0::DOUBLE AS score
  FROM ky LEFT JOIN c3 x ON x.id = ky.id AND x.rn = 1 LEFT JOIN c2 y ON y.id = ky.id AND y.rn = 1 WHERE coalesce(x.m, y.m) IS NOT NULL
  UNION ALL SELECT id, m, CASE WHEN score < 0.96 THEN 'title_similarity' ELSE 'content_similarity' END, score FROM fz)"""


@query("story_match", f"WITH RECURSIVE {_MATCH} SELECT id, match_id, reason, score FROM mt")
def _(spark, sf):
    return st.match_stories(fx.articles(spark, sf))


@query("story_clusters", f"""WITH RECURSIVE {_EXACT}, up(id, root, d) AS (SELECT id, match_id, 1 FROM ex UNION ALL SELECT up.id, ex.match_id, d + 1 FROM up JOIN ex ON ex.id = up.root),
rt AS (SELECT id, arg_max(root, d) AS root FROM up GROUP BY id)
SELECT ky.id, coalesce(r.fp, ky.fp) AS story_cluster_id, ex.match_id AS duplicate_of_article_id FROM ky LEFT JOIN rt ON rt.id = ky.id LEFT JOIN ky r ON r.id = rt.root LEFT JOIN ex ON ex.id = ky.id""")
def _(spark, sf):
    a = fx.articles(spark, sf)
    edges = st.match_exact(a).withColumn("score", F.lit(1.0))
    return st.cluster_ids(a, edges).select("id", "story_cluster_id", "duplicate_of_article_id")


@query("story_clusters_full", f"""WITH RECURSIVE {_MATCH}, up(id, root, d) AS (SELECT id, match_id, 1 FROM mt UNION ALL SELECT up.id, mt.match_id, d + 1 FROM up JOIN mt ON mt.id = up.root),
rt AS (SELECT id, arg_max(root, d) AS root FROM up GROUP BY id)
SELECT ky.id, coalesce(r.fp, ky.fp) AS story_cluster_id, mt.match_id AS duplicate_of_article_id, mt.reason AS duplicate_reason, mt.score AS similarity_score
FROM ky LEFT JOIN rt ON rt.id = ky.id LEFT JOIN ky r ON r.id = rt.root LEFT JOIN mt ON mt.id = ky.id""")
def _(spark, sf):
    a = fx.articles(spark, sf)
    return st.cluster_ids(a, st.match_stories(a)).select("id", "story_cluster_id", "duplicate_of_article_id", "duplicate_reason", "similarity_score")


_CTEXT = fx.sql_fold("concat_ws(' ', coalesce(title, ''), coalesce(description, ''), coalesce(content, ''))")


@query("corroboration", f"""WITH RECURSIVE {fx.ARTICLES},
ci AS MATERIALIZED (SELECT id, collected_at, title, source, collected_at::DATE AS d, lower(trim(coalesce(category, ''))) AS cat, {fx.sql_fold("title")} AS t, {_tok(_CTEXT, CORROBORATION_STOPWORDS)} AS tok,
  row_number() OVER (PARTITION BY collected_at::DATE ORDER BY collected_at, id) AS rn FROM articles),
cq AS MATERIALIZED (SELECT x.d, x.rn, y.rn AS o, x.t AS a, y.t AS b, {_jac("x.tok", "y.tok")} AS j FROM ci x JOIN ci y ON x.d = y.d AND y.rn < x.rn AND (x.cat = '' OR y.cat = '' OR x.cat = y.cat)),
cr AS (SELECT DISTINCT a, b FROM cq WHERE j < 0.55 AND 2.0 * least(length(a), length(b)) >= 0.82 * (length(a) + length(b))),
{ratio_ctes("cr", "ra")},
sm AS MATERIALIZED (SELECT d, rn, list(o) AS near FROM cq WHERE j >= 0.55 OR (a, b) IN (SELECT (a, b) FROM ra WHERE ratio >= 0.82) GROUP BY d, rn),
cn AS MATERIALIZED (SELECT ci.d, ci.rn, coalesce(near, []::BIGINT[]) AS near FROM ci LEFT JOIN sm ON sm.d = ci.d AND sm.rn = ci.rn),
w(d, rn, lead) AS (SELECT d, 0::BIGINT, []::BIGINT[] FROM (SELECT DISTINCT d FROM cn) UNION ALL
  SELECT w.d, cn.rn, list_append(lead, coalesce(list_min(list_transform(near, lambda o: lead[o])), cn.rn)) FROM w JOIN cn ON cn.d = w.d AND cn.rn = w.rn + 1),
ld AS (SELECT d, unnest(range(1, len(lead) + 1)) AS rn, unnest(lead) AS leader FROM (SELECT d, arg_max(lead, rn) AS lead FROM w GROUP BY d)),
cl AS (SELECT ci.*, leader FROM ci JOIN ld ON ld.d = ci.d AND ld.rn = ci.rn),
tl AS (SELECT d, leader, 'story-' || left(sha1(first(t ORDER BY {fx.sql_words("title")} DESC, collected_at, id)), 12) AS cluster_id,
  coalesce(string_agg(DISTINCT source, ',' ORDER BY source) FILTER (WHERE source <> ''), '') AS sources, count(DISTINCT source) FILTER (WHERE source <> '')::INTEGER AS source_count FROM cl GROUP BY d, leader)
SELECT cl.id, tl.cluster_id, tl.sources, tl.source_count FROM cl JOIN tl ON tl.d = cl.d AND tl.leader = cl.leader""")
def _(spark, sf):
    out = st.corroboration(_batched(spark, sf), ["batch"])
    return out.select("id", "cluster_id", F.array_join("corroborating_sources", ",").alias("sources"), "source_count")


# --- stories -----------------------------------------------------------------
@query("stories", f"WITH {fx.STORIES} SELECT story_id, canonical_title, category, country, first_published_at, last_updated_at, current_status, article_count, source_count FROM stories")
def _(spark, sf):
    return fx.stories(spark, sf)


@query("story_articles", f"""WITH {fx.STORED} SELECT story_cluster_id AS story_id, id AS article_id, similarity_score,
CASE WHEN duplicate_of_article_id IS NOT NULL THEN 'duplicate' ELSE 'original_report' END AS relationship_type FROM stored""")
def _(spark, sf):
    return st.story_articles(fx.stored_articles(spark, sf))


@query("story_updates", f"""WITH RECURSIVE {fx.ARTICLES}, sa AS MATERIALIZED (SELECT id, collected_at, title, source || '-' || weekofyear(collected_at) AS story_id, {fx.sql_story_text("title")} AS n FROM articles),
cs AS MATERIALIZED (SELECT sa.*, first(n) OVER (PARTITION BY story_id ORDER BY collected_at, id) AS canon FROM sa),
up AS (SELECT DISTINCT canon AS a, n AS b FROM cs WHERE length(n) > 0 AND length(canon) > 0 AND n <> canon), {ratio_ctes("up", "ra")}
SELECT story_id, 'Actualizacion: ' || arg_max(title, (collected_at, id)) AS last_update_note FROM cs JOIN ra ON ra.a = canon AND ra.b = n WHERE ratio < 0.92 GROUP BY story_id""")
def _(spark, sf):
    # one story per source and week, so that titles inside a story differ
    a = fx.articles(spark, sf)
    return st.story_updates(a.withColumn("story_cluster_id", F.concat_ws("-", "source", F.weekofyear("collected_at").cast("string"))))


_DECIDE = "SELECT o.id AS primary_id, d.id AS duplicate_id FROM stored o JOIN stored d ON d.id = o.id + 1 JOIN labels l ON l.doc_id = o.id WHERE l.quality = 1"


# decided from the last pair to the first, so that a pair can find its duplicate taken as a primary before
@query("merge_singletons", f"""WITH RECURSIVE {fx.STORED}, dc AS ({_DECIDE}), sz AS (SELECT story_cluster_id, count(*) AS n FROM stored GROUP BY 1),
ok AS (SELECT dc.duplicate_id, dc.primary_id FROM dc JOIN stored d ON d.id = dc.duplicate_id JOIN stored p ON p.id = dc.primary_id JOIN sz ON sz.story_cluster_id = d.story_cluster_id WHERE sz.n = 1 AND p.story_cluster_id IS NOT NULL),
mv AS (SELECT duplicate_id, primary_id, true AS moves FROM ok WHERE duplicate_id NOT IN (SELECT primary_id FROM ok)
  UNION ALL SELECT ok.duplicate_id, ok.primary_id, NOT mv.moves FROM mv JOIN ok ON ok.duplicate_id = mv.primary_id),
gone AS (SELECT * FROM mv WHERE moves)
SELECT s.id, coalesce(p.story_cluster_id, s.story_cluster_id) AS story_cluster_id, coalesce(gone.primary_id, s.duplicate_of_article_id) AS duplicate_of_article_id, gone.primary_id IS NOT NULL AS merged
FROM stored s LEFT JOIN gone ON gone.duplicate_id = s.id LEFT JOIN stored p ON p.id = gone.primary_id""")
def _(spark, sf):
    a = fx.stored_articles(spark, sf)
    labels = tables.read_table(spark, sf, "labels").where("quality = 1")
    decisions = labels.select(F.col("doc_id").alias("primary_id"), (F.col("doc_id") + 1).alias("duplicate_id"), (-F.col("doc_id")).alias("ord"))
    return st.merge_singletons(a, decisions).select("id", "story_cluster_id", "duplicate_of_article_id", "merged")


@query("story_siblings", f"""WITH {fx.STORED} SELECT a.id, b.id AS sibling_id, row_number() OVER (PARTITION BY a.id ORDER BY b.published_at NULLS LAST, b.id) AS position
FROM stored a JOIN stored b ON a.story_cluster_id = b.story_cluster_id AND a.id <> b.id AND b.is_active QUALIFY position <= 4""")
def _(spark, sf):
    return st.story_siblings(fx.stored_articles(spark, sf)).select("id", "sibling_id", "position")


@query("related_articles", f"""WITH {fx.STORED}, m AS (SELECT * FROM stored WHERE is_active),
g AS (SELECT story_cluster_id, first(id ORDER BY published_at NULLS LAST, id) FILTER (WHERE duplicate_of_article_id IS NULL) AS ff, count(*) AS n FROM m GROUP BY 1)
SELECT m.id, coalesce(g.ff, m.duplicate_of_article_id, m.id) AS canonical_article_id, g.n AS members FROM m JOIN g USING (story_cluster_id)""")
def _(spark, sf):
    return st.related_articles(fx.stored_articles(spark, sf)).select("id", "canonical_article_id", "members")


_LEVEL = """CASE WHEN s.current_status = 'corrected' THEN 'corrected' WHEN s.current_status = 'contradictory' THEN 'contradictory' WHEN coalesce(o.off, false) THEN 'official_statement'
  WHEN s.source_count >= 2 THEN 'multi_source' WHEN s.article_count <= 1 THEN 'single_source' ELSE 'developing' END"""


@query("story_confidence", f"""WITH {fx.STORIES}, o AS (SELECT story_cluster_id, bool_or(source_type = 'api') AS off FROM stored GROUP BY 1)
SELECT s.story_id, {_LEVEL} AS level FROM stories s LEFT JOIN o ON o.story_cluster_id = s.story_id""")
def _(spark, sf):
    links = fx.stored_articles(spark, sf).select(F.col("story_cluster_id").alias("story_id"), F.when(F.col("source_type") == "api", "official_statement").otherwise("report").alias("relationship_type"))
    return st.story_confidence(fx.stories(spark, sf), links).select("story_id", "level")


_CLAIM_LEVEL = "CASE id % 4 WHEN 0 THEN 'multi_source' WHEN 1 THEN 'official_statement' WHEN 2 THEN 'single_source' ELSE 'rumour' END"


def _claims(spark, sf):
    """Stored claims: two sets per labelled article's story, one per label kind."""
    s = fx.summaries(spark, sf)
    base = s.select(
        F.col("story_cluster_id").alias("story_id"), F.col("id").alias("article_id"), F.expr(_CLAIM_LEVEL).alias("confidence"), F.col("summary").alias("claim"),
        F.to_timestamp_ntz(F.col("summary_date")).alias("created_at"))
    return base


_CLAIMS = f"""{fx.SUMMARIES}, claims AS (SELECT story_cluster_id AS story_id, id AS article_id, {_CLAIM_LEVEL} AS confidence, summary AS claim, summary_date::TIMESTAMP AS created_at FROM summaries)"""


@query("story_coverage", f"""WITH {_CLAIMS}, so AS (SELECT story_cluster_id AS story_id, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, count(DISTINCT source) AS source_count FROM stored GROUP BY 1),
cl AS (SELECT story_id, count(*) FILTER (WHERE confidence = 'multi_source') AS a, count(*) FILTER (WHERE confidence = 'official_statement') AS b,
  count(*) FILTER (WHERE confidence NOT IN ('multi_source', 'official_statement')) AS c FROM claims GROUP BY 1)
SELECT so.story_id, source_count, sources, coalesce(a, 0) AS confirmed_by_multiple_sources, coalesce(b, 0) AS based_on_official_statement, coalesce(c, 0) AS reported_by_single_source FROM so LEFT JOIN cl USING (story_id)""")
def _(spark, sf):
    links = fx.stored_articles(spark, sf).select(F.col("story_cluster_id").alias("story_id"), "source")
    return st.story_coverage(links, _claims(spark, sf)).withColumn("sources", F.array_join("sources", ","))


@query("story_status", f"""WITH {fx.SUMMARIES}, lg AS (SELECT story_cluster_id AS story_id, CASE WHEN quality = 1 THEN 'unpublish' ELSE 'republish' END AS action, created_at AS tm FROM summaries
  UNION ALL SELECT story_cluster_id, 'correct', summary_date::TIMESTAMP FROM summaries WHERE score > 50),
g AS (SELECT story_id, first(action ORDER BY tm DESC, action DESC) AS last_action, bool_or(action = 'correct') AS cor FROM lg GROUP BY 1)
SELECT s.story_id, CASE WHEN last_action = 'unpublish' THEN 'unpublished' WHEN last_action = 'correct' THEN 'corrected' WHEN last_action = 'republish' THEN CASE WHEN cor THEN 'corrected' ELSE 'developing' END
  ELSE s.current_status END AS current_status FROM stories s LEFT JOIN g USING (story_id)""")
def _(spark, sf):
    s = fx.summaries(spark, sf)
    events = s.select(F.col("story_cluster_id").alias("story_id"), F.when(F.col("quality") == 1, "unpublish").otherwise("republish").alias("action"), F.col("created_at").alias("at"))
    corrections = s.where("score > 50").select(F.col("story_cluster_id").alias("story_id"), F.to_timestamp_ntz(F.col("summary_date")).alias("corrected_at"))
    return st.story_status(fx.stories(spark, sf), events, corrections).select("story_id", "current_status")


@query("apply_discards", """WITH b AS (SELECT conv_id AS batch_id, turn AS idx FROM conversations), r AS (SELECT conv_id AS batch_id, min(turn) AS lo, max(turn) AS hi, count(*) AS n FROM conversations GROUP BY 1),
d AS (SELECT batch_id, lo AS idx FROM r WHERE batch_id % 4 <> 3 AND lo < n UNION SELECT batch_id, hi FROM r WHERE batch_id % 4 IN (0, 2) AND hi < n)
SELECT b.batch_id, b.idx FROM b LEFT JOIN d USING (batch_id, idx) WHERE d.batch_id IS NULL""")
def _(spark, sf):
    turns = tables.read_table(spark, sf, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").alias("idx"))
    span = turns.groupBy("batch_id").agg(F.min("idx").cast("string").alias("lo"), F.max("idx").cast("string").alias("hi"), F.count("*").alias("total"))
    text = F.expr("""CASE batch_id % 4 WHEN 0 THEN '```json\n[' || lo || ', ' || hi || ', 99999]```' WHEN 1 THEN 'Descartar [' || lo || '] por repetida 7'
        WHEN 2 THEN 'quitar ' || lo || ' y ' || hi ELSE '' END""")
    return dd.apply_discards(turns, span.select("batch_id", text.alias("response"), "total"))


# --- joins -------------------------------------------------------------------
@query("article_dims", f"""WITH {fx.STORED} SELECT id, title, upper(left(category, 1)) || substr(category, 2) AS display_name, source, CASE WHEN source = 'src1' THEN 'api' ELSE 'scraper' END AS source_type FROM stored WHERE is_active""")
def _(spark, sf):
    a = fx.stored_articles(spark, sf)
    cats = a.select("category").distinct().select(F.xxhash64("category").alias("id"), F.col("category").alias("name"), F.initcap("category").alias("display_name"))
    srcs = a.select("source").distinct().select(F.xxhash64("source").alias("id"), F.col("source").alias("name"), F.when(F.col("source") == "src1", "api").otherwise("scraper").alias("source_type"))
    facts = a.where("is_active").select("id", "title", F.xxhash64("category").alias("category_id"), F.xxhash64("source").alias("source_id"))
    return sel.with_dimensions(facts, cats, srcs).select("id", "title", "display_name", "source", "source_type")


@query("summary_dims", f"""WITH {fx.SUMMARIES} SELECT s.id, s.summary_date, a.url AS article_url, a.source FROM summaries s LEFT JOIN (SELECT * FROM stored WHERE is_active) a ON a.id = s.article_id""")
def _(spark, sf):
    return sel.summary_with_article(fx.summaries(spark, sf), fx.stored_articles(spark, sf).where("is_active")).select("id", "summary_date", "article_url", "source")


@query("not_summarized", f"WITH {fx.SUMMARIES} SELECT id, title FROM stored WHERE id NOT IN (SELECT article_id FROM summaries)")
def _(spark, sf):
    return sel.not_summarized(fx.stored_articles(spark, sf), fx.summaries(spark, sf)).select("id", "title")


@query("published_only", f"WITH {fx.STORIES} SELECT s.id FROM stored s JOIN stories t ON t.story_id = s.story_cluster_id WHERE t.current_status <> 'unpublished'")
def _(spark, sf):
    a = fx.stored_articles(spark, sf)
    return sel.published_only(a, st.story_articles(a), fx.stories(spark, sf)).select("id")


@query("summaries_published", f"""WITH {fx.SUMMARIES}, n AS (SELECT *, CASE WHEN id % 10 <> 0 THEN story_cluster_id END AS sc FROM summaries)
SELECT n.id FROM n LEFT JOIN stories t ON t.story_id = n.sc WHERE t.story_id IS NULL OR t.current_status <> 'unpublished'""")
def _(spark, sf):
    s = fx.summaries(spark, sf).withColumn("story_cluster_id", F.when(F.col("id") % 10 != 0, F.col("story_cluster_id")))
    return sel.summaries_published(s, fx.stories(spark, sf)).select("id")


@query("story_detail", f"""WITH {_CLAIMS}, m AS (SELECT story_cluster_id AS story_id, count(*) AS articles, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, max(published_at) AS latest FROM stored GROUP BY 1),
c AS (SELECT story_id, count(*) AS n FROM claims GROUP BY 1), k AS (SELECT story_cluster_id AS story_id, count(*) AS n FROM summaries WHERE score > 50 GROUP BY 1)
SELECT s.story_id, coalesce(m.articles, 0) AS articles, m.sources, m.latest, coalesce(c.n, 0) AS claims, coalesce(k.n, 0) AS corrections FROM stories s LEFT JOIN m USING (story_id) LEFT JOIN c USING (story_id) LEFT JOIN k USING (story_id)""")
def _(spark, sf):
    a = fx.stored_articles(spark, sf)
    corrections = fx.summaries(spark, sf).where("score > 50").select(F.col("story_cluster_id").alias("story_id"), F.col("created_at").alias("corrected_at"))
    out = st.story_detail(fx.stories(spark, sf), st.story_articles(a), a, _claims(spark, sf), corrections)
    return out.select("story_id", "articles", F.array_join("sources", ",").alias("sources"), "latest", "claims", "corrections")


@query("story_members", f"""WITH {fx.STORED} SELECT story_cluster_id AS story_id, id AS article_id, row_number() OVER (PARTITION BY story_cluster_id ORDER BY published_at NULLS LAST, id) > 1 AS is_update FROM stored""")
def _(spark, sf):
    a = fx.stored_articles(spark, sf)
    return st.story_members(st.story_articles(a), a).select("story_id", "article_id", "is_update")


@query("source_count_badge", f"""WITH {fx.STORIES} SELECT a.id, coalesce(s.source_count, 1) AS source_count FROM stored a LEFT JOIN (SELECT * FROM stories WHERE current_status <> 'contradictory') s ON s.story_id = a.story_cluster_id""")
def _(spark, sf):
    return sel.with_source_count(fx.stored_articles(spark, sf), fx.stories(spark, sf).where("current_status <> 'contradictory'")).select("id", "source_count")


@query("insert_if_absent", """SELECT o_custkey, o_orderdate::DATE AS day FROM orders WHERE o_orderstatus <> 'F' EXCEPT SELECT o_custkey, o_orderdate::DATE FROM orders WHERE o_orderstatus = 'F'""")
def _(spark, sf):
    rows = tables.read_table(spark, sf, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    return mg.insert_if_absent(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus <> 'F'"), ["o_custkey", "day"]).select("o_custkey", "day")


@query("list_stories", f"""WITH {fx.STORIES}, k AS (SELECT * FROM stories WHERE source_count >= 2 AND current_status <> 'unpublished')
SELECT story_id, last_updated_at, source_count, count(*) OVER () AS total FROM k ORDER BY last_updated_at DESC NULLS LAST, story_id LIMIT 20""")
def _(spark, sf):
    return sel.list_stories(fx.stories(spark, sf), min_sources=2).select("story_id", "last_updated_at", "source_count", "total")


@query("brief_preview", f"""WITH {fx.SUMMARIES}, p AS (SELECT s.* FROM summaries s JOIN stories t ON t.story_id = s.story_cluster_id WHERE t.current_status <> 'unpublished' AND s.category IN ('politica', 'economia')),
d AS (SELECT max(summary_date) AS dd FROM p WHERE summary_date <= DATE '2024-01-20'), r AS (SELECT p.*, dd, {fx.sql_title_key_raw("title")} AS tk FROM p, d WHERE summary_date = dd),
x AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY tk ORDER BY created_at DESC, id DESC) = 1)
SELECT id, title, effective_date, created_at FROM (SELECT *, dd AS effective_date FROM x) ORDER BY created_at DESC, id DESC LIMIT 5""")
def _(spark, sf):
    return sel.brief_preview(fx.summaries(spark, sf), fx.stories(spark, sf), ["politica", "economia"], fx.DAY).select("id", "title", "effective_date", "created_at")


# --- summaries and claims ----------------------------------------------------
@query("summary_batches", f"""WITH {fx.STORED}, {diverse_sql("stored")}, w AS (SELECT * FROM p2 WHERE pick <= CASE WHEN category IN ('politica', 'economia') THEN 8 ELSE 5 END),
sb AS (SELECT w.id, least(count(*), 4) AS n FROM w JOIN stored b ON b.story_cluster_id = w.story_cluster_id AND b.id <> w.id AND b.is_active GROUP BY 1)
SELECT category, count(*) AS n_items, coalesce(sum(n), 0)::BIGINT AS n_siblings FROM w LEFT JOIN sb USING (id) GROUP BY 1""")
def _(spark, sf):
    a = fx.stored_articles(spark, sf)
    return sm.summary_batches(sel.diverse_topk(a), a).select("category", "n_items", "n_siblings")


_BATCH = "conv_id || '-' || (turn // 2)"
_CONV = f"""us AS (SELECT {_BATCH} AS batch_id, conv_id, conv_id * 1000 + turn AS id, {fx.sql_squeeze("split_part(text, '.', 1)")} AS title, conv_id % 5 AS s5 FROM conversations WHERE role = 'user'),
an AS (SELECT {_BATCH} AS batch_id, conv_id, conv_id * 1000 + turn AS k, text FROM conversations WHERE role = 'assistant' AND conv_id % 10 <> 9)"""


def _lim(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE coalesce(nullif(trim(regexp_replace(left({x}, {n}), ' [^ ]*$', '')), ''), trim(left({x}, {n}))) END"


_CLEAN = (lambda x: fx.sql_squeeze(f"regexp_replace({x}, '^{fx.SP}*([0-9]+[.)]{fx.SP}*)+', '')"))


@query("summary_rows", f"""WITH {_CONV}, j AS (SELECT a.*, u.id AS uid, u.s5, coalesce(nullif(u.title, ''), {fx.sql_squeeze("split_part(a.text, '.', 1)")}) AS tt FROM an a LEFT JOIN us u ON u.batch_id = a.batch_id),
c AS (SELECT *, {_CLEAN("tt")} AS t2, {_CLEAN("text")} AS f2, {_CLEAN("text")} AS sm FROM j)
SELECT batch_id, {_lim("t2", 100)} AS title, {_lim("f2", 140)} AS fact, CASE WHEN conv_id % 2 = 0 THEN 'politica' WHEN uid IS NULL THEN 'general' ELSE CASE conv_id % 4 WHEN 1 THEN 'politica' ELSE 'general' END END AS category,
  CASE WHEN conv_id % 2 = 0 THEN k - 1 ELSE uid END AS article_id, CASE WHEN uid IS NULL THEN 1 ELSE 2 END AS source_article_count, CASE WHEN uid IS NULL THEN '' ELSE 'src' || s5 END AS source FROM c WHERE t2 <> '' AND sm <> ''""")
def _(spark, sf):
    originals, responses, _ = fx.conversation_batches(spark, sf)
    return sm.summary_rows(responses, originals).select("batch_id", "title", "fact", "category", "article_id", "source_article_count", "source")


@query("claims_evidence", f"""WITH {_CONV}, c AS (SELECT a.*, u.id AS uid, {_CLEAN("'1. ' || a.text")} AS cl, {_CLEAN("a.text")} AS ex, unnest([1, 2, 3]) AS claim_pos FROM an a JOIN us u ON u.batch_id = a.batch_id
  WHERE {_CLEAN("a.text")} <> '')
SELECT batch_id, claim_pos, {_lim("cl", 220)} AS claim, CASE WHEN conv_id % 3 = 0 THEN 'multi_source' ELSE 'single_source' END AS confidence, uid AS article_id, 'https://news.example.com/' || uid AS source_url,
  nullif({_lim("ex", 160)}, '') AS source_excerpt FROM c WHERE cl <> ''""")
def _(spark, sf):
    originals, responses, evidence = fx.conversation_batches(spark, sf)
    out = sm.claims_evidence(sm.summary_rows(responses, originals), evidence)
    return out.select("batch_id", "claim_pos", "claim", "confidence", "article_id", "source_url", "source_excerpt")


@query("current_claims", f"""WITH {_CLAIMS} SELECT story_id, article_id, confidence, created_at FROM claims QUALIFY created_at = max(created_at) OVER (PARTITION BY story_id)""")
def _(spark, sf):
    return sm.current_claims(_claims(spark, sf)).select("story_id", "article_id", "confidence", "created_at")


@query("summary_dedup", f"""WITH {fx.SUMMARIES}, a AS (SELECT *, CASE WHEN id % 5 = 0 THEN NULL ELSE id - id % 2 END AS aid, CASE WHEN id % 3 = 0 THEN NULL ELSE story_cluster_id END AS sc FROM summaries),
b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY coalesce(aid::VARCHAR, 'row-' || id) ORDER BY id) = 1)
SELECT id, category FROM b QUALIFY row_number() OVER (PARTITION BY category, coalesce('cluster:' || sc, 'title:' || {fx.sql_title_key("title")}) ORDER BY id) = 1""")
def _(spark, sf):
    s = fx.summaries(spark, sf).withColumns({
        "article_id": F.expr("CASE WHEN id % 5 = 0 THEN NULL ELSE id - id % 2 END"), "story_cluster_id": F.expr("CASE WHEN id % 3 = 0 THEN NULL ELSE story_cluster_id END")})
    return sm.dedup_summaries(s).select("id", "category")


@query("upsert_summaries", f"""WITH RECURSIVE {fx.SUMMARIES}, base AS (SELECT * FROM summaries WHERE quality = 1),
nw AS (SELECT id + 1000000 AS id, CASE WHEN score > 30 THEN article_id ELSE NULL END AS article_id, category, NULL::VARCHAR AS story_cluster_id, CASE WHEN score > 60 THEN title || ' x' ELSE title END AS title, 'new ' || summary AS summary, fact, summary_date FROM summaries),
cn AS (SELECT * FROM nw WHERE trim(title) <> '' QUALIFY row_number() OVER (PARTITION BY category, summary_date, 'title:' || {fx.sql_title_key_raw("title")} ORDER BY id) = 1),
nx AS (SELECT *, row_number() OVER (PARTITION BY summary_date ORDER BY id) AS rn FROM cn),
w(d, rn, st) AS (SELECT d, 0::BIGINT, coalesce(list({{'id': b.id, 'a': b.article_id, 'c': b.category, 't': b.title, 'o': 'kept'}} ORDER BY b.id) FILTER (WHERE b.id IS NOT NULL), [])
  FROM (SELECT DISTINCT summary_date AS d FROM summaries) LEFT JOIN base b ON b.summary_date = d GROUP BY d
 UNION ALL SELECT d, rn, CASE WHEN hit IS NULL THEN list_append(st, {{'id': id, 'a': article_id, 'c': category, 't': title, 'o': 'inserted'}})
  ELSE list_transform(st, lambda x, i: CASE WHEN i = hit THEN {{'id': x.id, 'a': article_id, 'c': category, 't': title, 'o': CASE WHEN x.o = 'inserted' THEN 'inserted' ELSE 'updated' END}} ELSE x END) END
  FROM (SELECT w.d, nx.rn, st, nx.id, nx.article_id, nx.category, nx.title, coalesce(
    list_position(list_transform(st, lambda x: x.c = nx.category AND x.t = nx.title), true), list_position(list_transform(st, lambda x: x.a = nx.article_id), true)) AS hit
   FROM w JOIN nx ON nx.summary_date = w.d AND nx.rn = w.rn + 1))
SELECT x.id, d AS summary_date, x.a AS article_id, x.t AS title, x.o AS outcome FROM (SELECT d, unnest(st) AS x FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY d ORDER BY rn DESC) = 1))""")
def _(spark, sf):
    s = fx.summaries(spark, sf)
    new = s.withColumns({
        "id": F.col("id") + 1000000, "article_id": F.expr("CASE WHEN score > 30 THEN article_id END"), "story_cluster_id": F.lit(None).cast("string"),
        "title": F.expr("CASE WHEN score > 60 THEN title || ' x' ELSE title END"), "summary": F.concat(F.lit("new "), "summary")})
    return mg.upsert_summaries(s.where("quality = 1"), new).select("id", "summary_date", "article_id", "title", "outcome")


@query("rewrite_merge", f"""WITH tn AS (SELECT conv_id AS batch_id, turn AS pos, count(*) OVER (PARTITION BY conv_id) AS n, text FROM conversations), k AS (SELECT *, CASE WHEN batch_id % 3 = 2 THEN 0 ELSE n - 1 END AS m FROM tn)
SELECT batch_id, pos, pos < m AS rewritten, CASE WHEN pos < m THEN 'texto ' || pos || ' nuevo' ELSE text END AS summary FROM k WHERE m = 0 OR pos < m""")
def _(spark, sf):
    turns = tables.read_table(spark, sf, "conversations").select(F.col("conv_id").alias("batch_id"), F.col("turn").cast("int").alias("pos"), F.col("text").alias("summary"))
    lines = F.transform(F.sequence(F.lit(0), F.col("n") - 2), lambda i: F.concat((i + 1).cast("string"), F.lit(". Titulo | 1. texto "), i.cast("string"), F.lit("  nuevo")))
    n = turns.groupBy("batch_id").agg(F.count("*").cast("int").alias("n"))
    answer = F.when(F.col("batch_id") % 3 == 2, F.lit("sin cambios")).when(F.col("n") >= 2, F.concat(F.lit("Listo:\n"), F.array_join(lines, "\n"))).otherwise("")
    return sm.rewrite_merge(turns, n.select("batch_id", answer.alias("response"))).select("batch_id", "pos", "rewritten", "summary")


# --- upserts -----------------------------------------------------------------
@query("upsert_articles", f"""WITH {fx.ARTICLES}, base AS (SELECT * FROM articles WHERE id % 2 = 0 QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY id) = 1),
m AS (SELECT * REPLACE (published_at + INTERVAL 2 DAY AS published_at, score + 1 AS score, collected_at + INTERVAL 5 DAY AS collected_at) FROM articles WHERE title <> ''),
n AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY collected_at DESC, id DESC) = 1),
t AS (SELECT * FROM m WHERE published_at_from_detail OR published_at_from_listing OR source_type <> 'scraper' QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY collected_at DESC, id DESC) = 1),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY url_hash ORDER BY collected_at, id) = 1)
SELECT url_hash, coalesce(b.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.title ELSE b.title END AS title,
  CASE WHEN t.id IS NOT NULL THEN coalesce(t.published_at, t.collected_at) WHEN f.id IS NOT NULL AND b.published_at IS NULL THEN coalesce(f.published_at, f.collected_at) ELSE b.published_at END AS published_at,
  CASE WHEN t.id IS NOT NULL THEN coalesce(t.score, 0) WHEN f.id IS NOT NULL AND b.published_at IS NULL THEN coalesce(f.score, 0) ELSE b.score END AS score,
  CASE WHEN n.id IS NOT NULL AND b.id IS NOT NULL THEN 'updated' WHEN n.id IS NOT NULL THEN 'inserted' ELSE 'kept' END AS outcome
FROM base b FULL JOIN n USING (url_hash) LEFT JOIN t USING (url_hash) LEFT JOIN f USING (url_hash)""")
def _(spark, sf):
    from ..operators.scan import first_per

    a = fx.articles(spark, sf)
    base = first_per(a.where("id % 2 = 0"), ["url_hash"], [F.col("id")])
    batch = a.withColumns({"published_at": F.col("published_at") + F.expr("INTERVAL 2 DAYS"), "score": F.col("score") + 1, "collected_at": F.col("collected_at") + F.expr("INTERVAL 5 DAYS")})
    return mg.upsert_articles(base, batch).select("url_hash", "id", "title", "published_at", "score", "outcome")


@query("dim_upsert", f"""WITH {fx.ARTICLES}, dim AS (SELECT DISTINCT source AS name, 'old' AS source_type, 'http://old' AS base_url, false AS is_active FROM articles WHERE lang = 'es'),
n AS (SELECT source AS name, arg_max(source_type, id) AS st, arg_max(url, id) FILTER (WHERE lang <> 'en') AS u FROM articles WHERE lang <> 'de' GROUP BY 1)
SELECT name, coalesce(st, source_type) AS source_type, coalesce(u, base_url) AS base_url, CASE WHEN st IS NOT NULL THEN true ELSE is_active END AS is_active, dim.is_active IS NULL AS created FROM dim FULL JOIN n USING (name)""")
def _(spark, sf):
    a = fx.articles(spark, sf)
    dim = a.where("lang = 'es'").select(F.col("source").alias("name")).distinct().select(
        F.xxhash64("name").alias("id"), "name", F.lit("old").alias("source_type"), F.lit("http://old").alias("base_url"), F.lit(False).alias("is_active"))
    new = a.where("lang <> 'de'").select(F.col("source").alias("name"), "source_type", F.when(F.col("lang") != "en", F.col("url")).alias("base_url"), F.col("id").alias("ord"))
    return mg.dim_upsert(dim, new).drop("id")


# every request names the e-mail, some another identifier too; removals name one identifier
@query("subscription_state", """WITH e AS (SELECT user_id, event_type, ts, event_id, event_type = 'error' AS stop FROM events),
s AS (SELECT user_id, min(event_id) AS first_sub FROM e WHERE NOT stop GROUP BY 1),
a AS (SELECT e.* FROM e JOIN s USING (user_id) WHERE event_id >= first_sub)
SELECT CASE WHEN arg_max(event_type, event_id) FILTER (WHERE NOT stop) = 'purchase' THEN '+591' || user_id END AS phone,
 CASE WHEN arg_max(event_type, event_id) FILTER (WHERE NOT stop) = 'click' THEN 't' || user_id END AS telegram_id, 'u' || user_id || '@x.org' AS email,
 arg_max(event_type, event_id) FILTER (WHERE NOT stop) AS channel, NOT arg_max(stop, event_id) AS is_active, max(ts) AS updated_at FROM a GROUP BY user_id""")
def _(spark, sf):
    ev = tables.read_table(spark, sf, "events")
    requests = ev.select(
        F.expr("CASE WHEN event_type = 'purchase' THEN '+591' || user_id END").alias("phone"),
        F.expr("CASE WHEN event_type = 'click' THEN 't' || user_id END").alias("telegram_id"), F.expr("'u' || user_id || '@x.org'").alias("email"),
        F.expr("CASE WHEN event_type = 'error' THEN 'unsubscribe' ELSE 'subscribe' END").alias("action"),
        F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("channel"), F.array(F.lit("general")).alias("categories"), F.lit("diario").alias("frequency"), F.lit(9).alias("preferred_hour"))
    return mg.subscription_state(requests).select("phone", "telegram_id", "email", "channel", "is_active", "updated_at")


@query("daily_selection")
def _(spark, sf):
    """All steps of a daily run up to the articles chosen for summaries."""
    from .daily import select_articles
    from .queries_core import AS_OF

    chosen, _ = select_articles(_batched(spark, sf), fx.rules(spark), fx.summaries(spark, sf), AS_OF, ["batch"])
    return chosen.select("id", "category", "source", "title", "score", "source_count", "pick")
