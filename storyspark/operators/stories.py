"""Stories: matching across sources, clusters, roll-ups and coverage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CONFIDENCE_LABELS, ScoringConfig, StoryConfig
from ..functions import text as t
from ..functions.arrow import title_ratio
from ..functions.urls import url_fingerprint
from ..functions.values import hours_between, micros, temporal_proximity
from ..session import cut
from .graph import forest_roots, smallest_earlier
from .rank import article_text, canonical_source
from .scan import Blocks, greatest_before, previous, running, top_per, total
from .similarity import jaccard_edges, jaccard_pairs, story_similarity, title_edges, token_ids


def story_keys(df: DataFrame, cfg: StoryConfig = StoryConfig()) -> DataFrame:
    """Keys used for matching: normalised title, excerpt, fingerprint, URL fingerprint, node."""
    fields = [F.col(c) for c in ("content", "description", "excerpt", "summary") if c in df.columns]
    excerpt = t.story_excerpt(*fields, chars=cfg.excerpt_chars)
    keyed = df.withColumns({"story_title": t.story_text(F.col("title")), "story_excerpt": excerpt})
    key = t.canonical_key(F.col("category"), F.col("title"), F.col("story_excerpt"))
    return keyed.withColumns({
        "canonical_key": key,
        "content_fingerprint": t.content_fingerprint(key),
        "url_fingerprint": url_fingerprint(F.col("url")),
        "node": F.md5(F.concat_ws("|", "story_title", "story_excerpt")),
    })


def _recent(prior: Column, published: Column, cfg: StoryConfig) -> Column:
    return prior.isNotNull() & (prior["published"] >= published - F.make_dt_interval(F.lit(cfg.lookback_days)))


def _ingest(df: DataFrame, cfg: StoryConfig) -> DataFrame:
    """Matching keys in ingestion order; a missing date counts as the ingestion time."""
    keyed = story_keys(df, cfg)
    return keyed.select(
        "id", "is_active", "category", "collected_at", F.coalesce("published_at", "collected_at").alias("published"),
        "story_title", "story_excerpt", "content_fingerprint", "url_fingerprint", "node")


def exact_matches(rows: DataFrame, cfg: StoryConfig = StoryConfig(), not_duplicates: DataFrame | None = None) -> DataFrame:
    """Adds ``by_fingerprint`` and ``by_url``: the earlier row each row matches exactly.

    Both are running maxima over earlier-ingested rows of one key, so a fingerprint
    shared by a third of all rows costs a scan and no pairs. With ``not_duplicates``
    (ids) the fingerprint match prefers rows that matched nothing themselves.
    """
    order = [F.col("collected_at"), F.col("id")]
    newest = F.struct(F.col("published"), (-F.col("id")).alias("neg"))
    by_url = F.struct(F.col("published"), F.col("collected_at"), (-F.col("id")).alias("neg"))
    active = F.col("is_active")
    wanted, out = {"any_fp": greatest_before(F.when(active, newest))}, rows
    chosen = F.when(_recent(F.col("any_fp"), F.col("published"), cfg), -F.col("any_fp.neg"))
    if not_duplicates is not None:
        out = out.join(not_duplicates.select(F.col("id").alias("nd_id"), F.lit(True).alias("first_seen")),
                       F.col("id") == F.col("nd_id"), "left").drop("nd_id")
        wanted["first_fp"] = greatest_before(F.when(active & F.col("first_seen"), newest))
        chosen = F.when(_recent(F.col("first_fp"), F.col("published"), cfg), -F.col("first_fp.neg")).otherwise(chosen)
    out = Blocks(rows, ["category", "content_fingerprint"], order).add(out, wanted)
    out = Blocks(rows, ["url_fingerprint"], order).add(out, {"any_url": greatest_before(F.when(active & (F.length("url_fingerprint") > 0), by_url))})
    return out.withColumns({
        "by_fingerprint": chosen,
        "by_url": F.when(_recent(F.col("any_url"), F.col("published"), cfg), -F.col("any_url.neg")),
    }).drop("any_fp", "first_fp", "any_url", "first_seen")


def match_exact(df: DataFrame, cfg: StoryConfig = StoryConfig()) -> DataFrame:
    """Exact story matches only: equal fingerprint in the category, else equal URL."""
    narrow = cut(_ingest(df, cfg).select("id", "is_active", "category", "collected_at", "published", "content_fingerprint", "url_fingerprint"))
    rows = exact_matches(narrow, cfg)
    edges = rows.where(F.coalesce("by_fingerprint", "by_url").isNotNull())
    return edges.select(
        "id", F.coalesce("by_fingerprint", "by_url").alias("match_id"),
        F.when(F.col("by_fingerprint").isNotNull(), "fingerprint").otherwise("url_normalized").alias("reason"))


def fuzzy_matches(rows: DataFrame, probes: DataFrame, cfg: StoryConfig = StoryConfig()) -> DataFrame:
    """Best similar earlier row of each probe: (id, match_id, score).

    Score = similarity x closeness in time, at least ``threshold``. Since the title part
    is at most ``title_weight``, the token sets must have a Jaccard of at least
    (threshold - title_weight) / content_weight; that drives the candidate join. Rows
    further apart than the look-back only reach the threshold with equal titles and
    token sets, which is a plain equi join.
    """
    need = (cfg.threshold - 0.00005 - cfg.title_weight) / cfg.content_weight
    width = 86_400 * cfg.lookback_days
    bucket = F.floor(F.unix_seconds(F.col("published").cast("timestamp")) / width)
    rows, probes = rows.withColumn("bucket", bucket), probes.withColumn("bucket", bucket).where(F.length("story_title") > 0)

    nodes = (
        rows.where(F.length("story_title") > 0).select("node", "story_title", "story_excerpt").dropDuplicates(["node"])
        .withColumn("tokens", t.significant_tokens(F.concat_ws(
            " ", F.nullif("story_title", F.lit("")), F.nullif("story_excerpt", F.lit("")))))
        .withColumn("twin", F.md5(F.concat_ws("|", F.col("story_title"), F.array_join(F.array_sort("tokens"), " "))))
    )
    nodes = cut(nodes)
    cand_at = rows.where("is_active").select("node", "bucket").distinct()
    probe_at = probes.select("node", F.explode(F.array(*[F.col("bucket") + d for d in (-1, 0, 1)])).alias("bucket")).distinct()
    pairs = jaccard_pairs(nodes, probe_at, cand_at, ["bucket"], need - 1e-9).select(F.col("left").alias("new"), F.col("right").alias("old"))
    shape = F.struct(F.col("story_title").alias("title"), F.col("story_excerpt").alias("excerpt"), "tokens")
    side = nodes.select("node", "twin", shape.alias("s"))
    sized = (
        pairs.join(side.select(F.col("node").alias("new"), F.col("s").alias("a"), F.col("twin").alias("ta")), "new")
        .join(side.select(F.col("node").alias("old"), F.col("s").alias("b"), F.col("twin").alias("tb")), "old")
        .where((F.col("ta") != F.col("tb")) & (t.jaccard(F.col("a.tokens"), F.col("b.tokens")) >= need - 1e-9))
    )
    similar = cut(
        sized.select("new", "old", story_similarity(
            "a", "b", cfg.title_weight, cfg.content_weight, cfg.short_title_threshold, cfg.min_excerpt_words).alias("sim"))
        .where(F.col("sim") >= cfg.threshold))

    # what a probe asks for: a similar text, or any text with its title and tokens
    twins = nodes.select("node", F.when(F.size("tokens") > 0, F.col("twin")).otherwise(F.col("node")).alias("target"))
    cand = rows.where("is_active").select("node", F.col("id").alias("match_id"), F.col("published").alias("c_published"), F.col("collected_at").alias("c_collected"))
    offers = cand.select(F.col("node").alias("target"), "match_id", "c_published", "c_collected").unionByName(
        cand.join(twins, "node").where("target <> node").select("target", "match_id", "c_published", "c_collected"))
    probe = probes.select("id", "node", "published", "collected_at")
    asks = probe.join(similar.withColumnRenamed("new", "node"), "node").select("id", F.col("old").alias("target"), "sim", "published", "collected_at").unionByName(
        probe.join(twins, "node").select("id", "target", F.lit(1.0).alias("sim"), "published", "collected_at"))
    both = earlier_candidates(asks, offers, cfg)
    score = F.col("sim") * temporal_proximity(hours_between(F.col("published"), F.col("c_published")), cfg.lookback_days * 24)
    scored = both.withColumn("score", score).where(F.col("score") >= cfg.threshold)
    # partial aggregation keeps one best candidate per probe before the shuffle
    best = scored.groupBy("id").agg(F.max(F.struct(
        "score", "c_published", "c_collected", (-F.col("match_id")).alias("neg"))).alias("b"))
    return best.select("id", (-F.col("b.neg")).alias("match_id"), F.col("b.score").alias("score"))


#: A target with more candidates is looked up by its range index; others meet their asks directly.
DIRECT_CANDIDATES = 64


def earlier_candidates(asks: DataFrame, offers: DataFrame, cfg: StoryConfig, direct: int | None = None) -> DataFrame:
    """Candidates ingested before each ask and not older than the look-back, the best of each target among them.

    ``asks(id, target, sim, published, collected_at)``, ``offers(target, match_id, c_published, c_collected)``. The score of
    one target's candidates depends on their distance in time alone, so only the nearest before, the nearest after and, as
    closeness ends at the look-back, the latest can win. Those ingested before an ask are a prefix of the target's candidates
    in ingestion order, and a prefix is a sum of dyadic blocks, one per bit of its length: an ask looks into one block per
    bit, and a candidate lies in one block per level. A text in a third of n rows so costs n log n rows, not n squared.
    """
    floor = F.col("published") - F.make_dt_interval(F.lit(cfg.lookback_days))
    before = (F.struct("c_collected", "match_id") < F.struct(F.col("collected_at").alias("c_collected"), F.col("id").alias("match_id")))
    made = ["id", "sim", "published", "match_id", "c_published", "c_collected"]
    many = cut(offers.groupBy("target").agg(F.count("*").alias("n")).where(F.col("n") > (DIRECT_CANDIDATES if direct is None else direct)).select("target"))
    few = asks.join(many, "target", "left_anti").join(offers, "target").where(before & (F.col("c_published") >= floor)).select(*made)
    if many.isEmpty():
        return few
    # positions: an ask's is the number of its target's candidates ingested before it
    events = offers.join(many, "target", "left_semi").select(
        "target", F.col("c_collected").alias("at"), F.col("match_id").alias("who"), F.lit(False).alias("is_ask"),
        F.struct("match_id", "c_published", "c_collected").alias("offer"), F.lit(None).cast("struct<id:bigint,sim:double,published:timestamp_ntz>").alias("ask")
    ).unionByName(asks.join(many, "target", "left_semi").select(
        "target", F.col("collected_at").alias("at"), F.col("id").alias("who"), F.lit(True).alias("is_ask"),
        F.lit(None).cast("struct<match_id:bigint,c_published:timestamp_ntz,c_collected:timestamp_ntz>").alias("offer"), F.struct("id", "sim", "published").alias("ask")))
    one = F.when(F.col("is_ask"), F.lit(0)).otherwise(F.lit(1)).cast("bigint")
    placed = cut(running(events, ["target"], [F.col("at"), F.col("who"), ~F.col("is_ask")], {"n": total(one)}))
    levels = max(1, int(placed.agg(F.max("n")).first()[0]).bit_length())
    level = F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))
    inside = placed.withColumn("level", level).withColumn("block", F.expr("shiftright(if(is_ask, n, n - 1), level)"))
    # an ask takes the block before its own where its length has the bit; such blocks are even
    inside = inside.where(F.expr("if(is_ask, block % 2 = 1, block % 2 = 0)")).withColumn("block", F.expr("if(is_ask, block - 1, block)"))
    key = ["target", "level", "block"]
    at = micros(F.coalesce("offer.c_published", "ask.published"))
    inside = cut(inside.select(*key, "is_ask", "offer", "ask", at.alias("pos"), micros(F.col("at")).alias("seen"), "who"))
    offer = F.when(~F.col("is_ask"), F.struct(F.col("pos").alias("p"), F.col("seen").alias("s"), (-F.col("who")).alias("neg"), F.col("offer").alias("o")))
    away = F.when(~F.col("is_ask"), F.struct((-F.col("pos")).alias("p"), F.col("seen").alias("s"), (-F.col("who")).alias("neg"), F.col("offer").alias("o")))
    rest = [F.col("seen"), F.col("who")]
    found = running(inside, key, [F.col("pos"), F.col("is_ask"), *rest], {"prior": greatest_before(offer)})
    found = running(found, key, [-F.col("pos"), ~F.col("is_ask"), *rest], {"later": greatest_before(away)}).where("is_ask")
    last = inside.where(~F.col("is_ask")).groupBy(*key).agg(F.max(offer).alias("last"))
    found = found.join(last, key).select("ask.*", F.explode(F.array_compact(F.array("prior.o", "later.o", "last.o"))).alias("o")).select("id", "sim", "published", "o.*")
    return few.unionByName(found.where(F.col("c_published") >= floor).select(*made))


def match_stories(df: DataFrame, cfg: StoryConfig = StoryConfig()) -> DataFrame:
    """One edge from each duplicate to the best earlier-ingested row: id, match_id, reason, score.

    Order of rules: equal fingerprint in the category, equal URL, best similarity. All
    earlier rows in the window are candidates. First pass finds which rows match
    anything, second pass lets fingerprint matches prefer rows that match nothing.
    """
    rows = cut(_ingest(df, cfg))
    first = cut(exact_matches(rows, cfg).select("id", "by_fingerprint", "by_url"))
    open_ids = first.where(F.coalesce("by_fingerprint", "by_url").isNull()).select("id")
    probes = rows.join(open_ids, "id", "left_semi")
    fuzzy = cut(fuzzy_matches(rows, probes, cfg))
    fresh = open_ids.join(fuzzy, "id", "left_anti")
    exact = exact_matches(rows, cfg, fresh).select("id", "by_fingerprint", "by_url").where(
        F.coalesce("by_fingerprint", "by_url").isNotNull())
    exact = exact.select(
        "id", F.coalesce("by_fingerprint", "by_url").alias("match_id"),
        F.when(F.col("by_fingerprint").isNotNull(), "fingerprint").otherwise("url_normalized").alias("reason"),
        F.lit(1.0).alias("score"))
    reason = F.when(F.col("score") < cfg.content_reason_threshold, "title_similarity").otherwise("content_similarity")
    return exact.unionByName(fuzzy.select("id", "match_id", reason.alias("reason"), "score"))


def cluster_ids(df: DataFrame, edges: DataFrame, cfg: StoryConfig = StoryConfig()) -> DataFrame:
    """Article rows with story_cluster_id, duplicate_of_article_id and the match reason.

    A cluster is named by the fingerprint of the row its chain of matches starts from.
    """
    fingerprints = story_keys(df, cfg).select("id", "content_fingerprint")
    roots = forest_roots(edges, "id", "match_id")
    named = roots.join(fingerprints.withColumnRenamed("id", "root"), "root").select(
        F.col("id").alias("__id"), F.col("content_fingerprint").alias("root_fp"))
    match = edges.select(
        F.col("id").alias("__m"), "match_id", F.col("reason").alias("__reason"), F.col("score").alias("__score"))
    own = fingerprints.select(F.col("id").alias("__f"), "content_fingerprint")
    base = df.drop("story_cluster_id", "duplicate_of_article_id", "duplicate_reason", "similarity_score", "content_fingerprint")
    return (
        base.join(own, base["id"] == F.col("__f"))
        .join(named, base["id"] == F.col("__id"), "left")
        .join(match, base["id"] == F.col("__m"), "left")
        .withColumns({
            "story_cluster_id": F.coalesce("root_fp", "content_fingerprint"),
            "duplicate_of_article_id": F.col("match_id"),
            "duplicate_reason": F.col("__reason"),
            "similarity_score": F.col("__score"),
        }).drop("__f", "__id", "__m", "root_fp", "match_id", "__reason", "__score")
    )


#: Rows of a batch that one task passes over in order.
BLOCK_ROWS = 200_000


def corroboration(df: DataFrame, batch: Sequence[str], cfg: ScoringConfig = ScoringConfig()) -> DataFrame:
    """Clusters of one batch: (id, cluster_id, corroborating_sources, source_count).

    In input order a row joins the first cluster holding a similar row, and clusters are
    never merged. That equals the smallest row reachable over edges to earlier similar
    rows, found by passes over blocks of rows in order, and rounds between the blocks of a long batch. Similarity is
    computed between distinct titles and distinct texts, not rows; as labels of a group
    of equal titles only ever fall, a row needs one edge per similar group, to its last
    earlier member.
    """
    rows = df.select(
        *batch, "id", "collected_at", "title", canonical_source(F.col("source"), cfg).alias("source"),
        F.lower(F.trim(F.coalesce("category", F.lit("")))).alias("cat"), t.fold(F.col("title")).alias("ftitle"),
        t.corroboration_tokens(article_text(cfg.story_chars)).alias("tokens"))
    rows = rows.withColumns({
        "title_node": F.md5("ftitle"),
        "text_node": F.md5(F.concat_ws("|", F.col("ftitle"), F.array_join(F.array_sort("tokens"), " "))),
    })
    rows = cut(rows.withColumn("tokens", token_ids("tokens")))
    pos = F.struct(micros(F.col("collected_at")).alias("at"), "id")
    title_nodes = rows.select(F.col("title_node").alias("node"), F.col("ftitle").alias("title")).dropDuplicates(["node"])
    text_nodes = rows.select(F.col("text_node").alias("node"), "tokens").dropDuplicates(["node"])

    asks_offers = None
    for column, nodes, find, threshold in (
        ("title_node", title_nodes, title_edges, cfg.title_similarity),
        ("text_node", text_nodes, jaccard_edges, cfg.token_jaccard),
    ):
        places = cut(rows.select(*batch, F.col(column).alias("node"), "cat").distinct())
        similar = find(nodes, places.select("node", *batch).distinct(), list(batch), threshold).select(*batch, "new", "old")
        # the same text under an empty and a named category
        similar = similar.unionByName(places.select(*batch, F.col("node").alias("new"), F.col("node").alias("old")).distinct())
        compatible = (F.col("n_cat") == "") | (F.col("o_cat") == "") | (F.col("n_cat") == F.col("o_cat"))
        other = (F.col("new") != F.col("old")) | (F.col("n_cat") != F.col("o_cat"))
        adjacent = cut(
            similar.join(places.select(*batch, F.col("node").alias("new"), F.col("cat").alias("n_cat")), [*batch, "new"])
            .join(places.select(*batch, F.col("node").alias("old"), F.col("cat").alias("o_cat")), [*batch, "old"])
            .where(compatible & other))
        light = rows.select(*batch, "id", "collected_at", F.col(column).alias("node"), "cat")
        link = [*batch, "new", "n_cat", "old", "o_cat"]
        asks = light.join(
            adjacent.select(*batch, F.col("new").alias("node"), F.col("n_cat").alias("cat"), "old", "o_cat"), [*batch, "node", "cat"]
        ).select(*batch, F.col("node").alias("new"), F.col("cat").alias("n_cat"), "old", "o_cat", "id", "collected_at", F.lit(True).alias("asks"))
        offers = light.join(
            adjacent.select(*batch, F.col("old").alias("node"), F.col("o_cat").alias("cat"), "new", "n_cat"), [*batch, "node", "cat"]
        ).select(*batch, "new", "n_cat", F.col("node").alias("old"), F.col("cat").alias("o_cat"), "id", "collected_at", F.lit(False).alias("asks"))
        part = asks.unionByName(offers).withColumn("kind", F.lit(column))
        asks_offers = part if asks_offers is None else asks_offers.unionByName(part)

    # row level: last earlier row of every similar group, and of the own title group
    order = [F.col("collected_at"), F.col("id")]
    met = running(
        asks_offers, ["kind", *link], order, {"seen": greatest_before(F.when(~F.col("asks"), pos))}
    ).where(F.col("asks") & F.col("seen").isNotNull())
    own_group = [*batch, "title_node", "cat"]
    own = running(
        rows.select(*own_group, "id", "collected_at"), own_group, order, {"seen": previous(pos)}
    ).where(F.col("seen").isNotNull())
    edges = met.select(F.col("id").alias("src"), F.col("seen.id").alias("dst")).unionByName(
        own.select(F.col("id").alias("src"), F.col("seen.id").alias("dst")))
    # the first row of the own group is reachable as well and shortens the search
    firsts = rows.groupBy(*own_group).agg(F.min(pos).alias("first"))
    placed = running(rows.select(*own_group, "id", "collected_at"), list(batch), order, {"n": total(F.lit(1).cast("bigint"))})
    block = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in batch], F.floor((F.col("n") - 1) / BLOCK_ROWS).cast("string"))
    start = cut(placed.join(firsts, own_group).select(
        F.col("id").alias("node"), micros(F.col("collected_at")).alias("at"), block.alias("block"),
        F.col("first.at").alias("label"), F.col("first.id").alias("label_node")))
    labels = smallest_earlier(start, edges).select(F.col("node").alias("id"), F.col("label_node").alias("leader"))
    return _describe(rows.join(labels, "id"), pos)


def _describe(rows: DataFrame, pos: Column) -> DataFrame:
    words = t.word_count(F.coalesce("title", F.lit("")))
    longest = F.struct(words.alias("w"), (-pos["at"]).alias("a"), (-pos["id"]).alias("i"))
    told = rows.groupBy("leader").agg(
        F.max_by("ftitle", longest).alias("representative"),
        F.array_sort(F.collect_set(F.nullif("source", F.lit("")))).alias("corroborating_sources"))
    told = told.select(
        "leader", F.concat(F.lit("story-"), F.left(F.sha1(F.encode("representative", "UTF-8")), F.lit(12))).alias("cluster_id"),
        "corroborating_sources", F.size("corroborating_sources").alias("source_count"))
    return rows.select("id", "leader").join(told, "leader").drop("leader")


def story_rollup(articles: DataFrame, first_by: str = "published_at") -> DataFrame:
    """One row per cluster: first title/category/country, time span, article and source counts."""
    rank = F.struct(F.coalesce(F.col(first_by), F.lit("9999-01-01").cast("timestamp_ntz")).alias("t"), "id")
    return articles.where(F.col("story_cluster_id").isNotNull()).groupBy(F.col("story_cluster_id").alias("story_id")).agg(
        F.min_by("title", rank).alias("canonical_title"),
        F.min_by("category", rank).alias("category"),
        F.coalesce(F.min_by("country", rank), F.lit("BO")).alias("country"),
        F.min("published_at").alias("first_published_at"),
        F.max("published_at").alias("last_updated_at"),
        F.lit("developing").alias("current_status"),
        F.count("*").alias("article_count"),
        F.countDistinct("source").alias("source_count"),
    )


def story_articles(articles: DataFrame) -> DataFrame:
    """Bridge rows story - article."""
    return articles.where(F.col("story_cluster_id").isNotNull()).select(
        F.col("story_cluster_id").alias("story_id"), F.col("id").alias("article_id"), "similarity_score",
        F.when(F.col("duplicate_of_article_id").isNotNull(), "duplicate").otherwise("original_report").alias("relationship_type"))


def story_updates(articles: DataFrame, cfg: StoryConfig = StoryConfig()) -> DataFrame:
    """Note of the last ingested title that differs enough from the story's first title."""
    order = F.struct("collected_at", "id")
    rows = articles.where(F.col("story_cluster_id").isNotNull()).select(
        "story_cluster_id", "id", "collected_at", "title", t.story_text(F.col("title")).alias("norm"))
    canon = rows.groupBy("story_cluster_id").agg(
        F.min_by("norm", order).alias("canon"), F.min("collected_at").alias("c0"))
    differing = rows.join(canon, "story_cluster_id").where(
        (F.length("norm") > 0) & (F.length("canon") > 0) & (F.col("norm") != F.col("canon")))
    changed = differing.withColumn("ratio", title_ratio("canon", "norm")).where(F.col("ratio") < cfg.update_threshold)
    return changed.groupBy(F.col("story_cluster_id").alias("story_id")).agg(
        F.concat(F.lit("Actualizacion: "), F.max_by("title", order)).alias("last_update_note"))


def merge_singletons(articles: DataFrame, decisions: DataFrame) -> DataFrame:
    """Move decided duplicates into the primary's cluster when they stand alone in theirs, decision by decision.

    ``decisions(primary_id, duplicate_id, ord)``. Only an article's first decision as a duplicate can move it, and it
    does unless an earlier decision has brought another article into its cluster. Decisions are settled in rounds, each
    settling those whose earlier ones are; a round joins decisions only. Returns all articles with new cluster columns
    and ``merged``; ``stories`` on the result recounts both clusters.
    """
    cluster = articles.select("id", "story_cluster_id")
    sizes = cluster.groupBy("story_cluster_id").agg(F.count("*").alias("size"))
    primary = cluster.where(F.col("story_cluster_id").isNotNull()).select(F.col("id").alias("primary_id"))
    alone = cluster.join(sizes.where("size = 1"), "story_cluster_id").select(F.col("id").alias("duplicate_id"))
    first = (decisions.where("primary_id <> duplicate_id").join(primary, "primary_id").join(alone, "duplicate_id")
             .groupBy("duplicate_id").agg(F.min(F.struct("ord", "primary_id")).alias("d")))
    state = cut(first.select(F.col("duplicate_id").alias("d"), F.col("d.primary_id").alias("p"), F.col("d.ord").alias("o"), F.lit(None).cast("boolean").alias("moves")))
    while not state.where("moves IS NULL").isEmpty():
        into = state.select(F.col("p").alias("d"), F.col("o").alias("bo"), F.col("moves").alias("bm"))
        blocked = (state.select("d", "o").join(into, "d").where("bo < o").groupBy("d")
                   .agg(F.bool_or("bm").alias("yes"), F.bool_or(F.col("bm").isNull()).alias("open")))
        state = cut(state.join(blocked, "d", "left").select("d", "p", "o", F.coalesce(
            "moves", F.when(F.coalesce("yes", F.lit(False)), False).when(~F.coalesce("open", F.lit(False)), True)).alias("moves")))
    moves = state.where("moves").select("d", "p")
    # a primary that has moved itself leads on to its new cluster
    roots = forest_roots(moves, "d", "p").join(cluster.select(F.col("id").alias("root"), F.col("story_cluster_id").alias("to")), "root")
    target = roots.join(moves, "d").select(F.col("d").alias("moved_id"), F.struct(F.col("p").alias("primary_id"), "to").alias("m"))
    merged = F.col("m").isNotNull()
    return articles.join(target, articles["id"] == target["moved_id"], "left").withColumns({
        "story_cluster_id": F.coalesce("m.to", "story_cluster_id"),
        "duplicate_of_article_id": F.coalesce("m.primary_id", "duplicate_of_article_id"),
        "duplicate_reason": F.when(merged, "ai_semantic").otherwise(F.col("duplicate_reason")),
        "merged": merged,
    }).drop("moved_id", "m")


def story_siblings(articles: DataFrame, limit: int = 4) -> DataFrame:
    """Up to ``limit`` oldest other active articles of each article's story.

    Only the ``limit + 1`` oldest members of a story can ever be a sibling shown, so the
    join sees that many rows per story whatever the story's size.
    """
    members = articles.where(F.col("is_active") & F.col("story_cluster_id").isNotNull())
    oldest = top_per(
        members.select("story_cluster_id", F.col("id").alias("sibling_id"), F.col("published_at").alias("sibling_at"),
                       F.col("source").alias("sibling_source"), F.col("title").alias("sibling_title"),
                       F.col("url").alias("sibling_url")),
        ["story_cluster_id"], [F.col("sibling_at").asc_nulls_last(), F.col("sibling_id")], limit + 1, "pos")
    asked = articles.where(F.col("story_cluster_id").isNotNull()).select("id", "story_cluster_id")
    own = oldest.select(F.col("sibling_id").alias("id"), F.col("pos").alias("own_pos"))
    joined = asked.join(own, "id", "left").join(oldest, "story_cluster_id").where("sibling_id <> id")
    place = F.when(F.col("own_pos") < F.col("pos"), F.col("pos") - 1).otherwise(F.col("pos"))
    return joined.withColumn("position", place).where(F.col("position") <= limit).drop("own_pos", "pos", "story_cluster_id")


def related_articles(articles: DataFrame) -> DataFrame:
    """Canonical article and member count for every active article's story.

    The canonical member is the first one that is no duplicate, by date and id; without
    one it is the duplicate's own target, else the article itself.
    """
    members = articles.where(F.col("is_active") & F.col("story_cluster_id").isNotNull())
    rank = F.struct(F.coalesce("published_at", F.lit("9999-01-01").cast("timestamp_ntz")).alias("t"), "id")
    free = F.col("duplicate_of_article_id").isNull()
    stories = members.groupBy("story_cluster_id").agg(
        F.min_by("id", F.when(free, rank)).alias("first_free"), F.count("*").alias("members"))
    return articles.where("is_active").select("id", "story_cluster_id", "duplicate_of_article_id").join(
        stories, "story_cluster_id", "left").select(
        "id", "story_cluster_id",
        F.coalesce("first_free", "duplicate_of_article_id", "id").alias("canonical_article_id"),
        F.coalesce("members", F.lit(0)).alias("members"))


_NO_DATE = "9999-01-01"


def _numbered(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """``position`` from 1 within ``story_id``; a running count, so a hot story is numbered in blocks."""
    return running(rows, ["story_id"], order, {"position": total(F.lit(1).cast("bigint"))})


def related_members(articles: DataFrame) -> DataFrame:
    """The listing of every story: (story_id, position, id, is_duplicate), originals before duplicates, then by date and id.

    All articles of a story share its listing, so it is made once per story and not once per article.
    """
    rows = articles.where(F.col("is_active") & F.col("story_cluster_id").isNotNull()).select(
        F.col("story_cluster_id").alias("story_id"), "id", F.col("duplicate_of_article_id").isNotNull().alias("is_duplicate"),
        F.coalesce("published_at", F.lit(_NO_DATE).cast("timestamp_ntz")).alias("listed_at"))
    return _numbered(rows, [F.col("is_duplicate"), F.col("listed_at"), F.col("id")]).select("story_id", "position", "id", "is_duplicate")


def related_listing(articles: DataFrame, article_ids: DataFrame) -> DataFrame:
    """Listings of the stories of some articles: (asked_id, position, id, is_duplicate)."""
    asked = articles.join(article_ids, "id", "left_semi").where("is_active").select(
        F.col("id").alias("asked_id"), F.col("story_cluster_id").alias("story_id"))
    return asked.join(related_members(articles), "story_id").select("asked_id", "position", "id", "is_duplicate")


def confidence_level(status: Column, types: Column, sources: Column, articles: Column) -> Column:
    status = F.lower(F.trim(F.coalesce(status, F.lit(""))))
    return (
        F.when(status == "corrected", "corrected").when(status == "contradictory", "contradictory")
        .when(F.coalesce(F.array_contains(types, "official_statement"), F.lit(False)), "official_statement")
        .when(sources >= 2, "multi_source")
        .when((sources <= 1) & (articles <= 1), "single_source")
        .otherwise("developing")
    )


def confidence_label(level: Column) -> Column:
    pairs = []
    for key, value in CONFIDENCE_LABELS.items():
        pairs += [F.lit(key), F.lit(value)]
    return F.try_element_at(F.create_map(*pairs), level)


def story_confidence(stories: DataFrame, links: DataFrame) -> DataFrame:
    types = links.groupBy("story_id").agg(F.collect_set(F.lower(F.trim("relationship_type"))).alias("types"))
    level = confidence_level(F.col("current_status"), F.col("types"), F.col("source_count"), F.col("article_count"))
    return stories.join(types, "story_id", "left").withColumn("level", level).withColumn(
        "label", confidence_label(F.col("level"))).drop("types")


def story_coverage(links: DataFrame, claims: DataFrame) -> DataFrame:
    """Sources and number of claims per confidence bucket of each story.

    ``links(story_id, source)``, ``claims(story_id, confidence)``. Claim rows stay in the
    claims table; only their counts per bucket are rolled up.
    """
    named = F.nullif(F.trim("source"), F.lit(""))
    sources = links.groupBy("story_id").agg(F.array_sort(F.collect_set(named)).alias("sources"))
    level = F.lower(F.trim(F.coalesce("confidence", F.lit(""))))
    buckets = claims.groupBy("story_id").agg(
        F.count_if(level == "multi_source").alias("confirmed_by_multiple_sources"),
        F.count_if(level == "official_statement").alias("based_on_official_statement"),
        F.count_if(~level.isin("multi_source", "official_statement")).alias("reported_by_single_source"))
    counts = ["confirmed_by_multiple_sources", "based_on_official_statement", "reported_by_single_source"]
    return sources.join(buckets, "story_id", "left").select(
        "story_id", F.size("sources").alias("source_count"), "sources",
        *[F.coalesce(c, F.lit(0)).alias(c) for c in counts])


def bucketed_claims(claims: DataFrame) -> DataFrame:
    """Claims with the coverage bucket they belong to; unknown levels count as one source."""
    level = F.lower(F.trim(F.coalesce("confidence", F.lit(""))))
    return claims.withColumn("bucket", F.when(level.isin("multi_source", "official_statement"), level).otherwise("single_source"))


def story_status(stories: DataFrame, events: DataFrame, corrections: DataFrame) -> DataFrame:
    """Publication status from the latest status event and the correction log.

    ``events(story_id, action, at)`` with ``unpublish``/``republish``; ``corrections(story_id,
    corrected_at)`` act as an event that sets ``corrected``. Republishing gives
    ``corrected`` if any correction was logged before it, else ``developing``.
    """
    log = events.select("story_id", "action", "at").unionByName(
        corrections.select("story_id", F.lit("correct").alias("action"), F.col("corrected_at").alias("at")))
    state = log.groupBy("story_id").agg(
        F.max_by("action", F.struct("at", "action")).alias("last_action"),
        F.bool_or(F.col("action") == "correct").alias("has_correction"))
    status = (
        F.when(F.col("last_action") == "unpublish", "unpublished")
        .when(F.col("last_action") == "correct", "corrected")
        .when(F.col("last_action") == "republish", F.when(F.col("has_correction"), "corrected").otherwise("developing"))
        .otherwise(F.col("current_status"))
    )
    return stories.join(state, "story_id", "left").withColumn("current_status", status).drop("last_action", "has_correction")


def story_detail(stories: DataFrame, links: DataFrame, articles: DataFrame, claims: DataFrame, corrections: DataFrame) -> DataFrame:
    """Story header with counts of its parts; the parts themselves are story_members and the claims."""
    members = links.join(articles.select(F.col("id").alias("article_id"), "source", "published_at"), "article_id").groupBy("story_id").agg(
        F.count("*").alias("articles"), F.array_sort(F.collect_set("source")).alias("sources"), F.max("published_at").alias("latest"))
    claimed = claims.groupBy("story_id").agg(F.count("*").alias("claims"))
    corrected = corrections.groupBy("story_id").agg(F.count("*").alias("corrections"), F.max("corrected_at").alias("last_corrected_at"))
    out = stories.join(members, "story_id", "left").join(claimed, "story_id", "left").join(corrected, "story_id", "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("articles", "claims", "corrections")})


def story_parts(links: DataFrame, articles: DataFrame, claims: DataFrame, evidence: DataFrame, corrections: DataFrame) -> DataFrame:
    """All that a story shows, one row per part: (story_id, part, position, ref_id, text, detail, at).

    Members by date, claims in the order of their ids with every piece of evidence beside them, corrections newest first. Parts
    stay rows, since a story's lists have no bound. ``claims(story_id, claim_id, claim, confidence)``,
    ``evidence(claim_id, article_id, source_url, published_at)``, ``corrections(story_id, reason, corrected_by, corrected_at)``.
    """
    members = story_members(links, articles).select(
        "story_id", F.lit("member").alias("part"), F.col("article_id").alias("ref_id"), F.col("title").alias("text"), F.col("source").alias("detail"),
        F.col("published_at").alias("at"), F.coalesce("published_at", F.lit(_NO_DATE).cast("timestamp_ntz")).alias("rank"))
    shown = claims.join(evidence.withColumnRenamed("claim_id", "e"), F.col("claim_id") == F.col("e"), "left")
    told = shown.select(
        "story_id", F.lit("claim").alias("part"), F.col("claim_id").alias("ref_id"), F.concat_ws(": ", "confidence", "claim").alias("text"),
        F.col("source_url").alias("detail"), F.col("published_at").alias("at"), F.lit(_NO_DATE).cast("timestamp_ntz").alias("rank"))
    mended = corrections.select(
        "story_id", F.lit("correction").alias("part"), F.lit(0).cast("bigint").alias("ref_id"), F.col("reason").alias("text"), F.col("corrected_by").alias("detail"),
        F.col("corrected_at").alias("at"), (F.lit(_NO_DATE).cast("timestamp_ntz") - (F.col("corrected_at") - F.lit("1970-01-01").cast("timestamp_ntz"))).alias("rank"))
    every = members.unionByName(told).unionByName(mended)
    order = [F.col(c) for c in ("rank", "ref_id", "detail", "text")]
    return running(every, ["story_id", "part"], order, {"position": total(F.lit(1).cast("bigint"))}).select(
        "story_id", "part", "position", "ref_id", "text", "detail", "at")


def story_members(links: DataFrame, articles: DataFrame) -> DataFrame:
    """Members of stories in date order; every row after the first is an update."""
    rows = links.join(articles.select(F.col("id").alias("article_id"), "title", "url", "source", "published_at"), "article_id")
    rank = F.struct(F.coalesce("published_at", F.lit("9999-01-01").cast("timestamp_ntz")).alias("t"), F.col("article_id").alias("i"))
    first = rows.groupBy("story_id").agg(F.min_by("article_id", rank).alias("first_id"))
    return rows.join(first, "story_id").withColumn("is_update", F.col("article_id") != F.col("first_id")).drop("first_id")
