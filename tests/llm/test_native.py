"""License scan, quality rules and personal data against plain Python."""

import hashlib
import random
import re

from storyspark.llm import license_scan as licenses
from storyspark.llm import pii
from storyspark.llm import quality_rules as rules
from pyspark.sql import functions as F


def words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def license_brute(text, templates=licenses.BASE + licenses.NOTICES, stride=licenses.STRIDE):
    w = words(text)
    starts, base, labels, score = [], set(), set(), 0.0
    for t in templates:
        phrase = t.text.split()
        if t.ordered:
            at = [i for i in range(len(w) - len(phrase) + 1) if w[i:i + len(phrase)] == phrase]
            starts += at
            base |= {t.label} if at else set()
            score = max(score, 1.0 if at else 0.0)
        else:
            for k in range(0, len(w), stride):
                n = len(set(w[k:k + 2 * stride]) & set(phrase))
                if n >= licenses.required(t):
                    labels.add(t.label)
                    score = max(score, n / len(set(phrase)))
    return (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score)


def test_license_scan_equals_brute_force(spark):
    rng = random.Random(1)
    pool = sorted({w for t in licenses.BASE + licenses.NOTICES for w in t.text.split()}) + ["é", "x1", "Foo"]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randrange(120))) for _ in range(60)]
    for t in licenses.BASE + licenses.NOTICES:
        for k in range(30):  # notices at every place of a block, with words missing and moved
            own = t.text.split()
            if k % 3 == 1:
                own.pop(rng.randrange(len(own)))
            if k % 3 == 2:
                rng.shuffle(own)
            texts.append(" ".join(["pad"] * k * 2 + own + ["MIT License,\n", "General, PUBLIC license"] * (k % 2)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:] for r in licenses.per_document(licenses.scan(df)).collect()}
    for k, text in enumerate(texts):
        assert got[k] == license_brute(text), text


def test_license_scan_odd_rows(odd, empty):
    got = licenses.per_document(licenses.scan(odd)).collect()
    assert len(got) == 10
    assert {(r["doc_id"], r["labels"], r["n_base"]) for r in got if r["labels"]} == {(1, "mit", 1)}
    assert licenses.per_document(licenses.scan(empty)).count() == 0


def rule_brute(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    runs = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    hit = {p for i, r in enumerate(runs) if runs.count(r) > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit)


def test_rule_counts_equal_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "\n\n", "a a a a", "a b c a b c x", "a b c d a b c", "  lead\ttab\x0bvt nbsp in é#"]
    texts += ["".join(rng.choice(["a", "b", "cc", " ", " ", "\n", "# ", "😀"]) for _ in range(rng.randrange(80))) for _ in range(150)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in rules.measure(df).select("doc_id", *rules.COUNTS).collect():
        assert tuple(r)[1:] == rule_brute(texts[r["doc_id"]]), texts[r["doc_id"]]


def test_fences_follow_group_and_small_groups_follow_the_language(spark):
    rng = random.Random(4)
    text = lambda mark: " ".join(rng.choice(["ab", "cd", "ef"]) + str(rng.randrange(9999)) + mark for _ in range(60))
    rows = [(k, text("#"), "en", "symbols") for k in range(40)] + [(100 + k, text(""), "en", "plain") for k in range(60)]
    rows += [(200, text("#"), "en", "plain"), (201, text("#"), "en", "tiny"), (202, text(""), "en", "tiny"), (203, "word " * 60, "en", "plain"), (204, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in rules.apply_rules(df, rules.RuleConfig(min_group=20)).collect()}
    assert all(got[k]["kept"] for k in range(40)) and all(got[100 + k]["kept"] for k in range(60))
    assert not got[200]["kept"] and got[200]["failed"] == ["symbol_rate"]
    assert got[202]["kept"] and got[203]["base_failed"] and not got[203]["kept"] and got[204]["base_failed"]


def test_grid_keeps_six_leading_bits(spark):
    got = spark.range(0, 5000, 7).select("id", rules.grid(F.col("id")).alias("g")).collect()
    assert all(r["g"] == (r["id"] >> max(0, r["id"].bit_length() - 6)) << max(0, r["id"].bit_length() - 6) for r in got)


def test_rules_odd_rows(odd, empty):
    assert rules.apply_rules(odd).count() == 10
    kept = rules.keep(odd)
    assert kept.columns == odd.columns and [r["doc_id"] for r in kept.collect()] == [4]
    assert kept.first()["n_words"] == 7
    assert rules.apply_rules(empty).count() == 0 and rules.keep(empty).count() == 0


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": all(int(x) <= 255 for x in m.group().split(".")) if kind == "ip" else True,
                    "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data_base_spans_equal_brute_force(spark):
    rng = random.Random(5)
    bits = ["a.b", "@", "x.y", "c@d.e", "_", " ", "1", "22", "255", "256", ".", "4111111111111111", "4242-4242 4242 4242", "+", "(", ")", "-", "é", "😀", "+1 (424) 555-6469",
            "10.0.0.1", "\n", "%", "007"]
    texts = [None, ""] + ["".join(rng.choice(bits) for _ in range(rng.randrange(25))) for _ in range(600)] + ["a@b.c " * 300 + "1.2.3.4 " * 200]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.detect(df).collect():
        want = base_spans(texts[r["doc_id"]])
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == want, texts[r["doc_id"]]


def test_personal_data_mask_and_extra_spans(spark, odd, empty):
    text = 'login: password=79f3040bf02a602472 then call (424) 555-6469 or +1 (424) 555-6469, a@b.com'
    rows = [(k, f"{text} {k}") for k in range(30)] + [(99, None), (100, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.detect(df).select("doc_id", pii.digest(F.col("spans")).alias("s"), pii.mask(F.col("text"), F.col("spans")).alias("m")).orderBy("doc_id").collect()
    assert got[0]["m"] == "login: [SECRET] then call [NATIONAL_PHONE] or [PHONE], [EMAIL] 0"
    assert [x.split(":")[0] for x in got[0]["s"].split(",")] == ["email", "phone", "national_phone", "secret"]
    assert got[30]["m"] is None and got[31]["m"] == ""
    assert pii.detect(odd).count() == 10 and pii.detect(empty).count() == 0
    assert pii.detect(odd).columns == [c for c in odd.columns if c != "spans"] + ["spans"]


def test_expectation_maximisation_finds_reliable_labelers():
    rng = random.Random(6)
    counts = {}
    for _ in range(4000):
        true = rng.random() < 0.4
        vote = tuple((1 if (rng.random() < p) == true else -1) for p in (0.95, 0.9, 0.5, 0.85))
        counts[vote] = counts.get(vote, 0) + 1
    table, chance = pii.estimate([("k", v, n) for v, n in sorted(counts.items())])
    assert table["k"]["format"][1][0] > 0.9 and table["k"]["format"][1][1] < 0.1
    assert abs(table["k"]["context"][1][0] - table["k"]["context"][1][1]) < 0.15
    assert chance["k", (1, 1, 1, 1)] > 0.99 and chance["k", (-1, -1, 1, -1)] < 0.01


def test_digest_form():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442")
