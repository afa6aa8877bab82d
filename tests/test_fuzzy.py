"""Fuzzy joins against plain sequential walks over all pairs."""

import random
from datetime import datetime, timedelta
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from storyspark.config import ScoringConfig, StoryConfig
from storyspark.functions import text as t
from storyspark.operators import dedupe, graph, stories
from storyspark.operators.rank import article_text, canonical_source

WORDS = ("precio subida mercado ciudad escuela lluvia equipo partido hospital camino frontera puente vacuna energia "
         "tarifa votacion alcalde cosecha rio festival carretera policia rescate incendio").split()
SCHEMA = ("id bigint, title string, description string, content string, category string, source string, url string, "
          "published_at timestamp_ntz, collected_at timestamp_ntz, is_active boolean")


def make_rows(seed, n=120):
    """Families of near copies, one title copied into a third of all rows, and short titles."""
    rnd = random.Random(seed)
    stems = [" ".join(rnd.sample(WORDS, 6)) for _ in range(8)]
    bodies = [" ".join(rnd.choice(WORDS) for _ in range(30)) for _ in range(8)]
    rows = []
    for i in range(n):
        k = rnd.randrange(8)
        title, body = stems[k], bodies[k]
        roll = rnd.random()
        if roll < 0.33:
            title, body = stems[0], bodies[0]
        elif roll < 0.7:
            words = title.split()
            words[rnd.randrange(6)] = rnd.choice(WORDS)
            title = " ".join(words)
            if rnd.random() < 0.5:
                parts = body.split()
                parts[rnd.randrange(30)] = rnd.choice(WORDS)
                body = " ".join(parts)
        elif roll < 0.75:
            title = rnd.choice(["a", "ab", "abc", "abcd", "", "gol", "goles"])
        published = None if rnd.random() < 0.05 else datetime(2024, 1, 1) + timedelta(hours=rnd.randrange(24 * 8))
        rows.append((i, title, body[:60], body, rnd.choice(["salud", "mundo", ""]), rnd.choice(["s1", "s2", "s3"]),
                     f"https://x.org/{rnd.randrange(n * 3)}", published,
                     datetime(2024, 1, 1) + timedelta(hours=i * 2 + rnd.randrange(3)), rnd.random() > 0.1))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_title_dedup_equals_the_walk(spark, seed):
    rows = make_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("batch", F.lit("d"))
    keys = {r["id"]: r["k"] for r in df.select("id", t.title_key(F.col("title")).alias("k")).collect()}
    slots = []
    for r in sorted(rows, key=lambda r: (r[8], r[0])):
        for slot in slots:
            if SequenceMatcher(None, keys[r[0]], slot["key"]).ratio() >= 0.85:
                if r[7] is not None and (slot["at"] is None or r[7] > slot["at"]):
                    slot.update(key=keys[r[0]], at=r[7], id=r[0])
                break
        else:
            slots.append({"key": keys[r[0]], "at": r[7], "id": r[0]})
    want = sorted(s["id"] for s in slots)
    assert sorted(r["id"] for r in dedupe.dedup_title(df, ["batch"]).collect()) == want
    # bounded steps hand the slots on without changing the outcome
    assert sorted(r["id"] for r in dedupe.dedup_title(df, ["batch"], block_rows=7).collect()) == want


def test_candidates_of_a_common_text_are_looked_up_not_joined(spark):
    """Each of 600 rows asks for one target with 600 candidates: a few rows per ask, and the best ones among them."""
    rnd = random.Random(4)
    base = datetime(2024, 1, 1)
    rows = [(i, base + timedelta(minutes=rnd.randrange(60 * 24 * 12)), base + timedelta(minutes=rnd.randrange(600))) for i in range(600)]
    df = spark.createDataFrame(rows, "id bigint, published timestamp_ntz, collected_at timestamp_ntz")
    asks = df.select("id", F.lit("t").alias("target"), F.lit(1.0).alias("sim"), "published", "collected_at")
    offers = df.select(F.lit("t").alias("target"), F.col("id").alias("match_id"), F.col("published").alias("c_published"), F.col("collected_at").alias("c_collected"))
    got = stories.earlier_candidates(asks, offers, StoryConfig(), direct=10).collect()
    assert len(got) <= 600 * 3 * 10

    def closeness(a, c):
        return 1 - 0.15 * min(abs((a - c).total_seconds()) / 3600 / 72, 1.0)

    best = {}
    for r in got:
        key = (closeness(r["published"], r["c_published"]), r["c_published"], r["c_collected"], -r["match_id"])
        best[r["id"]] = max(best.get(r["id"], key), key)
    for i, at, seen in rows:
        want = max(((closeness(at, p), p, s, -k) for k, p, s in rows if (s, k) < (seen, i) and p >= at - timedelta(days=3)), default=None)
        assert best.get(i) == want


@pytest.mark.parametrize("seed", [3, 4])
def test_corroboration_equals_the_walk(spark, seed):
    rows = make_rows(seed, 90)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("batch", F.lit("d"))
    cfg = ScoringConfig()
    facts = {r["id"]: r for r in df.select(
        "id", t.fold(F.col("title")).alias("title"), t.corroboration_tokens(article_text(cfg.story_chars)).alias("tokens"),
        canonical_source(F.col("source")).alias("source"), "category").collect()}

    def same(new, old):
        if new["category"] and old["category"] and new["category"] != old["category"]:
            return False
        if SequenceMatcher(None, new["title"], old["title"]).ratio() >= 0.82:
            return True
        a, b = set(new["tokens"]), set(old["tokens"])
        return bool(a and b) and len(a & b) / len(a | b) >= 0.55

    groups = []
    for r in sorted(rows, key=lambda r: (r[8], r[0])):
        fact = facts[r[0]]
        home = next((g for g in groups if any(same(fact, other) for other in g)), None)
        groups.append([fact]) if home is None else home.append(fact)
    want = {frozenset(f["id"] for f in g): sorted({f["source"] for f in g}) for g in groups}
    got_rows = stories.corroboration(df, ["batch"]).collect()
    # rows with one cluster name may still be two clusters with equally long titles
    by_id = {r["id"]: r for r in got_rows}
    for members, sources in want.items():
        names = {by_id[i]["cluster_id"] for i in members}
        assert len(names) == 1
        assert {tuple(by_id[i]["corroborating_sources"]) for i in members} == {tuple(sources)}


@pytest.mark.parametrize(("seed", "direct"), [(5, 64), (6, 64), (5, 2), (7, 0)])
def test_story_match_equals_the_walk(spark, seed, direct, monkeypatch):
    monkeypatch.setattr(stories, "DIRECT_CANDIDATES", direct)
    rows = make_rows(seed)
    df = spark.createDataFrame(rows, SCHEMA)
    cfg = StoryConfig()
    keyed = stories.story_keys(df).select(
        "id", "story_title", "story_excerpt", "content_fingerprint", "url_fingerprint", "category",
        t.significant_tokens(F.concat_ws(" ", "story_title", "story_excerpt")).alias("tokens"))
    k = {r["id"]: r for r in keyed.collect()}
    done, edges = [], {}
    for r in sorted(rows, key=lambda r: (r[8], r[0])):
        me, at = k[r[0]], r[7] or r[8]
        window = [o for o in done if o["active"] and o["at"] >= at - timedelta(days=3)]
        same_fp = [o for o in window if k[o["id"]]["category"] == me["category"] and k[o["id"]]["content_fingerprint"] == me["content_fingerprint"]]
        same_url = [o for o in window if k[o["id"]]["url_fingerprint"] == me["url_fingerprint"]]
        hit = None
        if same_fp:
            pick = sorted(same_fp, key=lambda o: (o["dup"], -o["at"].timestamp(), o["id"]))[0]
            hit = (pick["id"], "fingerprint", 1.0)
        elif same_url:
            pick = sorted(same_url, key=lambda o: (-o["at"].timestamp(), -o["seen"].timestamp(), o["id"]))[0]
            hit = (pick["id"], "url_normalized", 1.0)
        else:
            best = None
            for o in window:
                other = k[o["id"]]
                if not me["story_title"] or not other["story_title"]:
                    continue
                if (me["story_title"], me["story_excerpt"]) == (other["story_title"], other["story_excerpt"]):
                    s = 1.0
                else:
                    ratio = SequenceMatcher(None, me["story_title"], other["story_title"]).ratio()
                    a, b = set(me["tokens"]), set(other["tokens"])
                    j = len(a & b) / len(a | b) if a and b else 0.0
                    s = round(ratio * 0.65 + j * 0.35, 4)
                    if min(len(me["story_excerpt"].split()), len(other["story_excerpt"].split())) < 6 and ratio < 0.92:
                        s = 0.0
                s *= 1.0 - (1.0 - 0.85) * min(abs((at - o["at"]).total_seconds()) / 3600 / 72, 1.0)
                key = (s, o["at"], o["seen"], -o["id"])
                if s >= 0.85 and (best is None or key > best[0]):
                    best = (key, o["id"])
            if best:
                s = best[0][0]
                hit = (best[1], "title_similarity" if s < 0.96 else "content_similarity", s)
        if hit:
            edges[r[0]] = hit
        done.append({"id": r[0], "at": at, "seen": r[8], "active": r[9], "dup": hit is not None})
    got = {r["id"]: r for r in stories.match_stories(df, cfg).collect()}
    assert {i: (e[0], e[1]) for i, e in edges.items()} == {i: (r["match_id"], r["reason"]) for i, r in got.items()}
    for i, e in edges.items():
        assert got[i]["score"] == pytest.approx(e[2])
    # clusters: every row takes the fingerprint its chain starts from
    clusters = {r["id"]: r["story_cluster_id"] for r in stories.cluster_ids(df, stories.match_stories(df)).collect()}
    for i in k:
        root = i
        while root in edges:
            root = edges[root][0]
        assert clusters[i] == k[root]["content_fingerprint"]


def test_bigram_bound_holds():
    rnd = random.Random(11)
    letters = "abcde "
    for _ in range(4000):
        a = "".join(rnd.choice(letters) for _ in range(rnd.randrange(0, 30)))
        b = list(a)
        for _ in range(rnd.randrange(0, 5)):
            if b and rnd.random() < 0.5:
                b.pop(rnd.randrange(len(b)))
            else:
                b.insert(rnd.randrange(len(b) + 1), rnd.choice(letters))
        b = "".join(b)
        if a == b:
            continue
        ratio = SequenceMatcher(None, a, b).ratio()
        for threshold in (0.82, 0.85):
            if ratio >= threshold:
                from collections import Counter

                x, y = (Counter(s[i:i + 2] for i in range(len(s) - 1)) for s in (a, b))
                shared = sum((x & y).values())
                assert shared >= max(1, (1.5 * threshold - 1) * (len(a) + len(b)) - 1 - 1e-9)
                assert min(len(a), len(b)) >= threshold / (2 - threshold) * max(len(a), len(b)) - 1e-9


def test_long_chains_close(spark):
    n = 200
    edges = spark.range(1, n).select(F.col("id"), (F.col("id") - 1).alias("match_id"))
    roots = graph.forest_roots(edges, "id", "match_id").collect()
    assert len(roots) == n - 1 and {r["root"] for r in roots} == {0}


def test_update_notes(spark):
    at = datetime(2024, 1, 1)
    rows = [(1, "c", "Sube el dolar en el pais", at), (2, "c", "Sube el dolar en el país", at + timedelta(hours=1)),
            (3, "c", "Baja el euro por primera vez", at + timedelta(hours=2)), (4, "d", "Solo uno", at)]
    df = spark.createDataFrame(rows, "id bigint, story_cluster_id string, title string, collected_at timestamp_ntz")
    got = {r["story_id"]: r["last_update_note"] for r in stories.story_updates(df).collect()}
    assert got == {"c": "Actualizacion: Baja el euro por primera vez"}


def test_merge_only_singletons(spark):
    rows = [(1, "a"), (2, "b"), (3, "c"), (4, "c")]
    df = spark.createDataFrame(rows, "id bigint, story_cluster_id string").withColumns({
        "duplicate_of_article_id": F.lit(None).cast("bigint"), "duplicate_reason": F.lit(None).cast("string")})
    decisions = spark.createDataFrame([(1, 2, 0), (1, 3, 1), (1, 1, 2)], "primary_id bigint, duplicate_id bigint, ord bigint")
    got = {r["id"]: r["story_cluster_id"] for r in stories.merge_singletons(df, decisions).collect()}
    assert got == {1: "a", 2: "a", 3: "c", 4: "c"}


def merge_walk(clusters, decisions):
    at = dict(clusters)
    for p, d, _ in sorted(decisions, key=lambda x: x[2]):
        if p != d and p in at and d in at and at[p] and at[d] and at[p] != at[d] and list(at.values()).count(at[d]) == 1:
            at[d] = at[p]
    return at


def test_merge_follows_the_order_of_decisions(spark):
    rnd = random.Random(8)
    for _ in range(3):
        clusters = [(i, f"c{i if rnd.random() < 0.8 else i % 3}") for i in range(40)]
        decisions = [(rnd.randrange(42), rnd.randrange(42), k) for k in range(60)] + [(2, 3, -2), (1, 2, -1)]
        df = spark.createDataFrame(clusters, "id bigint, story_cluster_id string").withColumns({
            "duplicate_of_article_id": F.lit(None).cast("bigint"), "duplicate_reason": F.lit(None).cast("string")})
        got = stories.merge_singletons(df, spark.createDataFrame(decisions, "primary_id bigint, duplicate_id bigint, ord bigint")).collect()
        assert {r["id"]: r["story_cluster_id"] for r in got} == merge_walk(clusters, decisions)


def test_tiles_meet_every_pair_once(spark, monkeypatch):
    """Tiles of a few rows: every pair of a key is found once, by any size, and texts of one key alone never meet."""
    from storyspark.operators import similarity as sim

    monkeypatch.setattr(sim, "TILE_ROWS", 3)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)]
    base = [rng.sample(words, rng.randint(2, 30)) for _ in range(8)]
    sets = {f"n{i:02d}": sorted({w for w in base[i % 8] if rng.random() < 0.9} | {rng.choice(words)}) for i in range(40)}
    place = {n: int(n[1:]) % 2 for n in sets}
    nodes = spark.createDataFrame([(n, s, " ".join(s)) for n, s in sets.items()], "node string, tokens array<string>, title string")
    blocks = spark.createDataFrame(list(place.items()), "node string, k int")
    jac = {(k, a, b) for a in sets for b in sets for k in (0, 1) if place[a] == place[b] == k and a != b
           and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.55}
    found = [tuple(r) for r in sim.jaccard_edges(nodes, blocks, ["k"], 0.55).select("k", "new", "old").collect()]
    assert jac and len(found) == len(set(found)) and set(found) == jac
    ones = blocks.where("k = 0").select("node", F.lit(0).alias("k")), blocks.select("node", F.lit(0).alias("k"))
    pairs = {tuple(r) for r in sim.jaccard_pairs(nodes, *ones, ["k"], 0.55).collect()}
    assert pairs == {(a, b) for a in sets if place[a] == 0 for b in sets if a != b
                     and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.55}
    near = {(k, a, b) for a in sets for b in sets for k in (0, 1) if place[a] == place[b] == k and a != b
            and SequenceMatcher(None, " ".join(sets[a]), " ".join(sets[b])).ratio() >= 0.82}
    found = [tuple(r) for r in sim.title_edges(nodes.select("node", "title"), blocks, ["k"], 0.82).select("k", "new", "old").collect()]
    assert near and len(found) == len(set(found)) and set(found) == near


def test_titles_are_ruled_out_before_their_ratio():
    """Titles of common syllables: nearly all pairs that reach the slow ratio are similar, and no similar pair is lost."""
    from storyspark.operators import similarity as sim

    rnd = random.Random(12)
    parts = "th er an in on re he ti es or st en at to nt ha nd ou ea ng".split()

    def title(n):
        return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randrange(1, 4))) for _ in range(n))

    left = [title(rnd.randrange(12, 17)) for _ in range(60)] + [title(180) for _ in range(3)]
    right = [x[:7] + rnd.choice(["", "x", "yz"]) + x[9:] for x in left[:20] + left[-3:]] + [title(rnd.randrange(12, 17)) for _ in range(50)]
    for threshold in (0.82, 0.85):
        i, j = sim._resembling(left, right, threshold)
        found = set(zip(i.tolist(), j.tolist()))
        # popular characters of a long second text are left out of a ratio, so that few of those reach the threshold
        near = {(a, b) for a in range(63) for b in range(73) if max(
            SequenceMatcher(None, left[a], right[b]).ratio(), SequenceMatcher(None, right[b], left[a]).ratio()) >= threshold}
        assert len(near) >= 20 and near <= found and len(found) <= len(near) + 5


def test_common_subsequences_equal_the_table():
    from storyspark.operators import similarity as sim

    def length(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for k, y in enumerate(b):
                row.append(last[k] + 1 if x == y else max(row[-1], last[k + 1]))
        return row[-1]

    rnd = random.Random(13)
    texts = ["".join(rnd.choice("abcd ") for _ in range(n)) for n in (1, 2, 40, 63, 64, 65, 127, 128, 129, 200, 512, 513, 700)]
    codes = [sim.np.array([ord(c) for c in x]) for x in texts]
    pairs = [(a, b) for a in range(13) for b in range(13)]
    got = sim._subsequences(codes, codes[::-1], sim.np.array([a for a, _ in pairs]), sim.np.array([b for _, b in pairs]))
    assert got.tolist() == [length(texts[a], texts[12 - b]) for a, b in pairs]


def test_ladders_settle_in_one_pass_over_each_block(spark, monkeypatch):
    """Every node reaches an early dead end at once and the first node over the whole chain: no round per link."""
    n, rounds = 240, []
    place = [(k, k, f"b{k // 60}", k, k) for k in range(n)]
    nodes = spark.createDataFrame(place, "node bigint, at bigint, block string, label bigint, label_node bigint")
    edges = spark.createDataFrame([(k, 1) for k in range(3, n)] + [(k, k - 1) for k in range(3, n)] + [(2, 0)], "src bigint, dst bigint")
    plain = graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or plain(df))
    got = {r["node"]: r["label_node"] for r in graph.smallest_earlier(nodes, edges).collect()}
    assert got == {k: 1 if k == 1 else 0 for k in range(n)}
    assert len(rounds) <= 12


def test_corroboration_over_blocks_equals_one_block(spark, monkeypatch):
    df = spark.createDataFrame(make_rows(9, 60), SCHEMA).withColumn("batch", F.lit("d"))

    def rows():
        return sorted((r["id"], r["cluster_id"], tuple(r["corroborating_sources"])) for r in stories.corroboration(df, ["batch"]).collect())

    whole = rows()
    monkeypatch.setattr(stories, "BLOCK_ROWS", 13)
    assert rows() == whole


def test_sets_meet_by_their_beginnings():
    """Sets in one tile or two: all similar pairs once, in parts of few hits as well."""
    from storyspark.operators import similarity as sim

    rnd = random.Random(14)
    base = [rnd.sample(range(400), rnd.randrange(1, 60)) for _ in range(12)]
    sets = [sorted({w for w in rnd.choice(base) if rnd.random() < 0.85} | {rnd.randrange(2000)}) for _ in range(150)]
    arrays = [sim.np.array(x, dtype="int64") for x in sets]

    def jaccard(a, b):
        return len(set(a) & set(b)) / len(set(a) | set(b))

    def found(*args):
        out = [(int(a), int(b), float(q)) for i, j, q in sim._sharing(*args) for a, b, q in zip(i, j, q)]
        assert len({(a, b) for a, b, _ in out}) == len(out)
        return out

    for threshold in (0.55, 0.5714, 0.8):
        for hits in (1 << 21, 40):
            sim.HITS, kept = hits, sim.HITS
            try:
                one, two = found(arrays, None, threshold), found(arrays[:70], arrays[70:], threshold)
            finally:
                sim.HITS = kept
            assert {frozenset((a, b)): q for a, b, q in one} == {
                frozenset((a, b)): jaccard(sets[a], sets[b]) for a in range(150) for b in range(a) if jaccard(sets[a], sets[b]) >= threshold}
            assert {(a, b): q for a, b, q in two} == {
                (a, b): jaccard(sets[a], sets[b + 70]) for a in range(70) for b in range(80) if jaccard(sets[a], sets[b + 70]) >= threshold}
