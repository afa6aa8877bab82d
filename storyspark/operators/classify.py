"""Rule classification: term matches, category scores, decisions, reviews."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import CATEGORIES, ClassifyConfig
from ..functions import text as t
from ..session import cut
from .scan import computed_once, top_per

RULE_SCHEMA = (
    "category string, cat_ord int, polarity string, ord int, term string, is_regex boolean, "
    "weight double, ambiguous boolean"
)


def rules_from_mapping(spark: SparkSession, categories: dict[str, Any]) -> DataFrame:
    """Rules table from ``{category: {positive: [...], negative: [...]}}``."""
    rows = []
    for cat_ord, (category, spec) in enumerate(categories.items()):
        ord_ = 0
        for polarity in ("positive", "negative"):
            listed = {}
            for rule in spec.get(polarity) or []:
                term = str(rule["term"]).strip()
                # a repeated positive term counts once, with its last weight
                key = term if polarity == "positive" else (term, len(listed))
                listed[key] = (term, bool(rule.get("regex")), float(rule.get("weight", 1.0)), bool(rule.get("ambiguous")))
            for term, is_regex, weight, ambiguous in listed.values():
                rows.append((category, cat_ord, polarity, ord_, term, is_regex, weight, ambiguous))
                ord_ += 1
    return spark.createDataFrame(rows, RULE_SCHEMA)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules from a YAML file with a ``categories`` mapping, or from a Parquet table."""
    if not path.endswith((".yaml", ".yml")):
        return spark.read.schema(RULE_SCHEMA).parquet(path)
    import yaml

    with open(path, encoding="utf-8") as handle:
        return rules_from_mapping(spark, yaml.safe_load(handle)["categories"])


#: Slots of the table of first words, per first word; a lookup then meets one or two terms.
_SPREAD = 4
_RULE = "category:string,cat_ord:int,polarity:string,ord:int,term:string,weight:double,ambiguous:boolean"
_RULE_COLS = ("category", "cat_ord", "polarity", "ord", "term", "weight", "ambiguous")


def _constant(value: Any, ddl: str) -> Column:
    """A nested literal; folded once when the plan is optimised."""
    return F.from_json(F.lit(json.dumps(value)), ddl)


class _Rules:
    """The rule list, which is configuration, as literals: rules by number, and a table of word paths by a hash of the first word."""

    def __init__(self, rules: DataFrame):
        key = F.when(~F.col("is_regex"), t.fold(F.col("term")))
        wordy = key.rlike(f"^{t.WORD}+( {t.WORD}+)*$")
        quoted = F.regexp_replace(key, r"([^\p{L}\p{N}_ ])", r"\\$1")
        pattern = F.when(F.col("is_regex"), F.concat(F.lit("(?iu)"), F.col("term"))).when(
            ~wordy, F.concat(F.lit("(?<!" + t.WORD + ")"), quoted, F.lit("(?!" + t.WORD + ")")))
        first = F.when(wordy, F.substring_index(key, " ", 1))
        rows = rules.select(*_RULE_COLS, F.when(wordy, key).alias("key"), pattern.alias("pattern"), first.alias("first")).collect()
        self.rows = sorted(rows, key=lambda r: (r["cat_ord"], r["ord"], r["category"], r["term"]))
        self.rule = _constant([{c: r[c] for c in _RULE_COLS} for r in self.rows], f"array<struct<{_RULE}>>")
        self.firsts = sorted({r["first"] for r in self.rows if r["first"]})
        self.patterns = [(k, r["pattern"]) for k, r in enumerate(self.rows) if r["pattern"]]
        self.size = max(1, _SPREAD * len(self.firsts))
        slots = rules.sparkSession.createDataFrame([(w,) for w in self.firsts], "w string").select(
            "w", F.pmod(F.xxhash64("w"), F.lit(self.size)).alias("at")).collect()
        table: list[list] = [[] for _ in range(self.size)]
        for s in slots:
            for k, r in enumerate(self.rows):
                if r["first"] == s["w"]:
                    table[s["at"]].append({"first": s["w"], "path": f" {r['key']} ", "rule": k})
        self.table = _constant(table, "array<array<struct<first:string,path:string,rule:int>>>")
        self.categories = sorted({(r["category"], r["cat_ord"]) for r in self.rows}, key=lambda c: (c[1], c[0]))

    def found(self, folded: str, words: str) -> Column:
        """Numbers of the rules that match a folded text and its word string."""
        hits = F.array_intersect(F.split(words, " "), _constant(self.firsts, "array<string>"))
        paths = F.flatten(F.transform(hits, lambda w: F.filter(
            F.get(self.table, F.pmod(F.xxhash64(w), F.lit(self.size)).cast("int")),
            lambda e: (e["first"] == w) & F.contains(F.col(words), e["path"]))))
        numbers = F.transform(paths, lambda e: e["rule"])
        tests = [F.when(F.col(folded).rlike(p), F.lit(k)) for k, p in self.patterns]
        return F.array_union(numbers, F.array_compact(F.array(*tests))) if tests else F.array_distinct(numbers)


def _match(rules: _Rules, field: str, weight: float) -> Callable[[Column], Column]:
    def match(k: Column) -> Column:
        rule = F.get(rules.rule, k)
        return F.struct(*[rule[c].alias(c) for c in _RULE_COLS], F.lit(field).alias("field"), (rule["weight"] * weight).alias("value"))

    return match


def _with_matches(articles: DataFrame, rules: _Rules, cfg: ClassifyConfig) -> DataFrame:
    """Adds ``_matches``: the best field value of every rule that matches the row. Nothing leaves the row."""
    content = F.col("content") if cfg.content_chars is None else F.left("content", F.lit(cfg.content_chars))
    fields = sorted([(cfg.title_weight, "title", F.col("title")), (cfg.description_weight, "description", F.col("description")),
                     (cfg.content_weight, "content", content)], key=lambda f: (-f[0], f[1]))
    df = articles.withColumns({f"_{n}": t.fold(F.coalesce(c, F.lit(""))) for _, n, c in fields})
    df = df.withColumns({f"_{n}_words": t.word_string(F.col(f"_{n}")) for _, n, _ in fields})
    df = df.withColumns({f"_{n}_rules": rules.found(f"_{n}", f"_{n}_words") for _, n, _ in fields})
    parts, known = [], None
    for weight, n, _ in fields:  # a rule counts where it is worth most
        own = F.col(f"_{n}_rules") if known is None else F.array_except(f"_{n}_rules", known)
        known = F.col(f"_{n}_rules") if known is None else F.array_union(known, f"_{n}_rules")

        parts.append(F.transform(own, _match(rules, n, weight)))
    df = df.withColumn("_matches", F.concat(*parts)).drop(*[f"_{n}{x}" for _, n, _ in fields for x in ("", "_words", "_rules")])
    return computed_once(df, "_matches")


def term_matches(articles: DataFrame, rules: DataFrame, cfg: ClassifyConfig = ClassifyConfig()) -> DataFrame:
    """Best field value of every (article, rule) that matches, without a shuffle.

    A text's words are cut down to first words of terms; each is looked up in a table of word
    paths, and a path of several words is then looked up in the text. Regular expressions and
    terms with punctuation, the short part of the rule list, are one expression per pattern.
    """
    found = _with_matches(articles, _Rules(rules), cfg).select("id", F.inline("_matches"))
    return found.select("id", *_RULE_COLS, "field", "value")


def _with_scores(articles: DataFrame, rules: _Rules, cfg: ClassifyConfig) -> DataFrame:
    """Adds ``_scores``: a struct per category with a match or the source's bonus, computed in the row."""
    df = _with_matches(articles, rules, cfg)
    hit = lambda m: F.struct(
        (m["polarity"] == "positive").alias("pos"), m["ambiguous"].alias("ambiguous"), m["value"].alias("value"), m["field"].alias("field"),
        m["term"].alias("term"), m["ord"].alias("ord"))
    bonus = F.array().cast("array<struct<pos:boolean,ambiguous:boolean,value:double,field:string,term:string,ord:int>>")
    own = F.lit(None).cast("string")
    if "source_category" in articles.columns:
        own = F.col("source_category")
        bonus = F.array(F.struct(
            F.lit(True).alias("pos"), F.lit(False).alias("ambiguous"), F.lit(float(cfg.source_category_bonus)).alias("value"),
            F.lit("source_category").alias("field"), F.lit("categoria_fuente").alias("term"), F.lit(2**30).alias("ord")))
    cats = _constant([{"category": c, "cat_ord": o} for c, o in rules.categories], "array<struct<category:string,cat_ord:int>>")
    per = F.transform(cats, lambda c: F.struct(c["category"].alias("category"), c["cat_ord"].alias("cat_ord"), F.concat(
        F.transform(F.filter("_matches", lambda m: m["category"] == c["category"]), hit),
        F.when(own == c["category"], bonus).otherwise(F.slice(bonus, 1, 0))).alias("hits")))

    def scored(c: Column) -> Column:
        hits = c["hits"]
        for_it = F.filter(hits, lambda h: h["pos"])
        signed = F.aggregate(hits, F.lit(0.0), lambda a, h: a + F.when(h["pos"], h["value"]).otherwise(-h["value"]))
        note = lambda h: F.struct(h["ord"].alias("ord"), F.concat(
            h["field"], F.lit(":"), h["term"], F.lit("("), F.when(h["pos"], "+").otherwise("-"), _plain(h["value"]), F.lit(")")).alias("note"))
        return F.struct(
            c["category"].alias("category"), c["cat_ord"].alias("cat_ord"), F.greatest(F.bround(signed, 4), F.lit(0.0)).alias("score"),
            F.array_max(F.transform(for_it, lambda h: h["value"])).alias("top_term"), F.exists(for_it, lambda h: h["ambiguous"]).alias("ambiguous"),
            F.transform(F.slice(F.array_sort(F.transform(hits, note)), 1, 8), lambda x: x["note"]).alias("notes"))

    return df.withColumn("_hits", F.filter(per, lambda c: F.size(c["hits"]) > 0)).withColumn("_scores", F.transform("_hits", scored)).drop("_hits", "_matches").transform(
        computed_once, "_scores")


def category_scores(articles: DataFrame, rules: DataFrame, cfg: ClassifyConfig = ClassifyConfig()) -> DataFrame:
    """Positive minus negative term values per (article, category), floored at 0.

    A repeated positive term counts once. ``source_category`` (a slug, may be absent)
    adds its bonus.
    """
    return _with_scores(articles, _Rules(rules), cfg).select("id", F.inline("_scores")).drop("cat_ord")


def _plain(c: Column) -> Column:
    """Shortest text of a number: no trailing zeros."""
    return F.regexp_replace(F.regexp_replace(c.cast("decimal(18,4)").cast("string"), "0+$", ""), r"\.$", "")


def classify(articles: DataFrame, rules: DataFrame, cfg: ClassifyConfig = ClassifyConfig()) -> DataFrame:
    """Decision per article: category, confidence, method, risk and reason.

    Matches, scores and the two best categories are found inside the row, so the plan
    is one scan without a shuffle.
    """
    df = _with_scores(articles, _Rules(rules), cfg)
    ranked = F.array_sort(F.transform("_scores", lambda s: F.struct(
        (-s["score"]).alias("neg"), s["cat_ord"], s["category"], s["top_term"], s["ambiguous"], s["notes"])))
    df = df.select("id", F.slice(ranked, 1, 2).alias("r"), F.when(F.size("_scores") > 0, F.map_from_entries(F.transform(
        "_scores", lambda s: F.struct(s["category"], s["score"])))).alias("scores"))
    top, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    joined = df.select(
        "id", "scores",
        F.coalesce(-top["neg"], F.lit(0.0)).alias("top"),
        F.coalesce(-second["neg"], F.lit(0.0)).alias("second"),
        top["category"].alias("top_category"), top["top_term"].alias("top_term"),
        F.coalesce(top["ambiguous"], F.lit(False)).alias("ambiguous"), top["notes"].alias("notes"),
    )
    known = F.col("top") >= cfg.min_score
    confidence = F.col("top") / (F.col("top") + F.col("second") + 1)
    margin = F.col("top") - F.col("second")
    ratio = F.coalesce(F.col("top_term") / F.col("top"), F.lit(0.0))
    doubtful = (
        (margin < cfg.accept_margin) | (confidence < cfg.low_confidence)
        | (ratio >= cfg.dominant_ratio) | F.col("ambiguous")
    )
    risk = F.greatest(ratio, 1.0 - confidence)
    risk = F.when(F.col("ambiguous"), F.greatest(risk, F.lit(cfg.ambiguous_risk))).otherwise(risk)
    reason = F.concat(
        F.col("top_category"), F.lit(":score="), _plain(F.col("top")), F.lit(";margin="), _plain(margin),
        F.lit(";"), F.coalesce(F.nullif(F.array_join("notes", ";"), F.lit("")), F.lit("sin_detalle")))
    return joined.select(
        "id",
        F.when(known, F.col("top_category")).otherwise("general").alias("category"),
        F.when(known, F.bround(confidence, 4)).otherwise(0.0).alias("confidence"),
        F.when(known & doubtful, "rules_low_confidence").otherwise("rules").alias("method"),
        F.when(known, F.bround(risk, 4)).otherwise(0.0).alias("risk_score"),
        F.when(known, reason).otherwise("sin_senales_suficientes").alias("reason"),
        "scores",
    )


def review_quota(decisions: DataFrame, batch: Sequence[str], cfg: ClassifyConfig = ClassifyConfig()) -> DataFrame:
    """Mark the riskiest doubtful rows of each batch for a second opinion.

    The quota is found by a top-k per batch and joined back, so a large batch is
    never sorted in one task.
    """
    decisions = cut(decisions)  # looked at twice
    eligible = decisions.where(F.col("method") == "rules_low_confidence")
    chosen = top_per(eligible.select(*batch, "id", "risk_score"), batch,
                     [F.col("risk_score").desc(), F.col("id")], cfg.review_quota)
    picked = chosen.select("id", F.lit(True).alias("__picked"))
    status = (
        F.when(F.col("method") != "rules_low_confidence", "not_eligible")
        .when(F.col("__picked"), "review")
        .otherwise("ai_fallback_batch_limit_reached")
    )
    return decisions.join(picked, "id", "left").withColumn("review_status", status).drop("__picked")


def merge_opinions(
    decisions: DataFrame, opinions: DataFrame, valid: Sequence[str] = tuple(CATEGORIES), cfg: ClassifyConfig = ClassifyConfig()
) -> DataFrame:
    """Accept a second opinion with a valid category and enough confidence.

    ``opinions(id, opinion_category, opinion_confidence, opinion_reason)``.
    """
    category = t.fold(F.col("opinion_category"))
    confidence = F.coalesce(F.col("opinion_confidence"), F.lit(0.0))
    given = F.col("__given").isNotNull()
    bad_category = ~category.isin(*valid)
    error = F.when(given & bad_category, F.concat(
        F.lit("invalid_category:"), F.coalesce(F.nullif(category, F.lit("")), F.lit("empty")))
    ).when(given & (confidence < cfg.opinion_min_confidence), F.concat(F.lit("low_confidence:"), _plain(confidence)))
    accepted = given & error.isNull()
    joined = decisions.join(opinions.withColumn("__given", F.lit(True)), "id", "left")
    return joined.select(
        "id",
        F.when(accepted, category).otherwise(F.col("category")).alias("category"),
        F.when(accepted, F.bround(confidence, 4)).otherwise(F.col("confidence")).alias("confidence"),
        F.when(accepted, "llm_fallback").otherwise(F.col("method")).alias("method"),
        F.when(accepted, F.concat(F.lit("llm:"), F.coalesce(
            F.nullif(F.trim("opinion_reason"), F.lit("")), F.lit("llm_fallback")))).otherwise(F.col("reason")).alias("reason"),
        F.when(accepted, F.col("category")).alias("rule_category"),
        F.when(accepted, F.col("confidence")).alias("rule_confidence"),
        error.alias("opinion_error"),
    )


def apply_corrections(articles: DataFrame, corrections: DataFrame) -> DataFrame:
    """Latest manual correction per article, with an audit struct.

    ``corrections(article_id, new_category, reason, corrected_by, corrected_at)``.
    Review flags are cleared; inactive articles stay as they are.
    """
    latest = corrections.groupBy("article_id").agg(
        F.max_by(F.struct("new_category", "reason", "corrected_by", "corrected_at"),
                 F.struct("corrected_at", "new_category")).alias("c"))
    applied = F.col("is_active") & F.col("c").isNotNull()
    return articles.join(latest, articles["id"] == latest["article_id"], "left").select(
        "id",
        F.when(applied, F.col("c.new_category")).otherwise(F.col("category")).alias("category"),
        F.when(applied, "manual_correction").otherwise(F.get_json_object("raw_payload", "$.category_method")).alias("category_method"),
        F.when(~applied, F.get_json_object("raw_payload", "$.category_llm_error")).alias("review_error"),
        F.when(applied, F.col("category")).alias("previous_category"),
        F.when(applied, F.col("c.reason")).alias("correction_reason"),
        F.when(applied, F.col("c.corrected_by")).alias("corrected_by"),
        F.when(applied, F.col("c.corrected_at")).alias("corrected_at"),
    )


def rule_coverage(rules: DataFrame, categories: DataFrame) -> DataFrame:
    """Categories without rules and rules without a registered category."""
    with_rules = rules.select("category").distinct()
    known = categories.select("category").where(F.col("category") != "general").distinct()
    missing = known.join(with_rules, "category", "left_anti").withColumn("problem", F.lit("category_without_rules"))
    unknown = with_rules.join(known, "category", "left_anti").withColumn("problem", F.lit("rules_without_category"))
    return missing.unionByName(unknown)


def map_source_category(
    df: DataFrame, mappings: DataFrame, source: str = "source", raw: str = "source_category_raw",
    valid: Sequence[str] = tuple(CATEGORIES),
) -> DataFrame:
    """Source-specific mapping, then the global one, then the raw value if it is a slug.

    ``mappings(source, raw, mapped)`` with folded values; ``global`` is the shared source.
    """
    valid_rows = mappings.where(F.col("mapped").isin(*valid))
    own = valid_rows.select(F.col("source").alias("__s"), F.col("raw").alias("__r"), F.col("mapped").alias("__own"))
    shared = valid_rows.where("source = 'global'").select(F.col("raw").alias("__g"), F.col("mapped").alias("__shared"))
    key, src = t.fold(F.col(raw)), t.fold(F.col(source))
    out = df.withColumns({"__key": key, "__src": src})
    out = out.join(own, (F.col("__src") == F.col("__s")) & (F.col("__key") == F.col("__r")), "left")
    out = out.join(shared, F.col("__key") == F.col("__g"), "left")
    mapped = F.coalesce("__own", "__shared", F.when(F.col("__key").isin(*valid), F.col("__key")), F.lit(""))
    return out.withColumn("source_category", mapped).drop("__key", "__src", "__s", "__r", "__own", "__g", "__shared")
