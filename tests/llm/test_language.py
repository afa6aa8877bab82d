"""Language identification: n-grams and naive Bayes against plain Python, and accuracy on held-out documents."""

import math
import random
import zlib
from collections import Counter

import numpy as np

from storyspark.llm import language_id as lid
from storyspark.llm import queries
from pyspark.sql import functions as F

M = 0xFFFFFFFF


def squeezed(text):
    out = []
    for ch in f" {text.lower()} " if text else " ":
        if ch.isalpha():
            out.append(ch)
        elif not out or out[-1] != " ":
            out.append(" ")
    return "".join(out)


def bucket(gram):
    h = ord(gram[0]) * 0x9E3779B1 & M
    for ch in gram[1:]:
        h = ((h ^ (h >> 15)) * 0x85EBCA6B + ord(ch) * 0x9E3779B1) & M
    h = (h ^ (h >> 13)) * 0xC2B2AE35 & M
    return (h ^ (h >> 16)) & (lid.BUCKETS - 1)


def brute_grams(text, longest):
    s = squeezed(text)
    return Counter(bucket(s[i:i + n]) for n in range(1, longest + 1) for i in range(len(s) - n + 1) if not (n == 1 and s[i] == " "))


def brute(rows, texts, longest=4, smooth=0.5):
    count, docs = {}, Counter()
    for text, lang in rows:
        if lang is not None:
            docs[lang] += 1
            count.setdefault(lang, Counter()).update(brute_grams(text, longest))
    out = []
    for text in texts:
        grams, scores = brute_grams(text, longest), {}
        for lang, c in count.items():
            total = sum(c.values()) + smooth * lid.BUCKETS
            scores[lang] = math.log(docs[lang] / sum(docs.values())) + sum(n * math.log((c[b] + smooth) / total) for b, n in grams.items())
        if not scores or not any(ch.isalpha() for ch in text or ""):
            out.append(("und", 0.0))
            continue
        best = max(sorted(scores), key=scores.get)
        out.append((best, 1 / sum(math.exp(s - scores[best]) for s in scores.values())))
    return out


def test_pieces_hold_every_gram_once(monkeypatch):
    rng = random.Random(4)
    texts = ["", None, "a", "É1 ßx", "  12 -- ", *["".join(rng.choice("abÉ ,.\n1中😀") for _ in range(rng.randrange(300))) for _ in range(60)]]
    for size in (1, 2, 3, 7, 50, 10_000):
        monkeypatch.setattr(lid, "PIECE", size)
        got = [Counter() for _ in texts]
        for piece in lid.pieces(texts, 4):
            for found, owner in lid.grams(*piece, 4):
                for b, k in zip(found.tolist(), owner.tolist(), strict=True):
                    got[k][b] += 1
        assert got == [brute_grams(t, 4) for t in texts], size


def test_naive_bayes_equals_brute_force(spark, odd):
    rng = random.Random(6)
    words = {"en": ["the", "and", "house"], "de": ["und", "das", "haus"], "fr": ["le", "maison", "été"]}
    rows = [(" ".join(rng.choices(words[lang] + ["ok", "x1"], k=9)), lang) for lang in words for _ in range(15)]
    rows += [(None, "en"), ("", "de"), ("no language", None), rows[0]]
    model = lid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert model.langs == ("de", "en", "fr")
    texts = [None, "", "123", "the house", "das haus und", "Été", "zzz", "und the le", "x " * 5000]
    got = lid.predict(texts, model)
    for (lang, score), have, sure in zip(brute(rows, texts), *got, strict=True):
        assert have == lang and abs(score - sure) < 1e-2
    wide = lid.identify(odd, model, [F.col("doc_id"), F.col("score").alias("lang_pred0")])
    assert wide.columns == ["doc_id", "lang_pred0", "lang_pred", "score"] and wide.count() == odd.count()
    assert {r["lang_pred"] for r in wide.where("doc_id in (2, 3, 7)").collect()} == {"und"}


def test_nothing_learned_and_many_languages(spark, empty, monkeypatch):
    model = lid.train(empty)
    assert lid.predict(["the"], model)[0] == ["und"]
    assert lid.identify(empty, model, [F.col("doc_id")]).count() == 0
    monkeypatch.setattr(lid, "MATRIX", 1 << 12)
    rows = [(chr(97 + k) * 5 + " " + chr(97 + k) * 3, f"l{k}") for k in range(20)]
    folded = lid.train(spark.createDataFrame(rows, "text string, lang string"))
    assert folded.weights.shape == (128, 20) and folded.weights.size <= 1 << 12
    assert lid.predict([t for t, _ in rows], folded)[0] == [x for _, x in rows]


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.QUERIES["op12_language_id"](spark, folder)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    out = [r for r in rows if r["held_out"] and any(c.isalpha() for c in r["text"] or "")]
    right = np.mean([r["lang"] == r["lang_pred"] for r in out])
    assert right > 0.97, (right, [(r["doc_id"], r["lang"], r["lang_pred"], (r["text"] or "")[:60]) for r in out if r["lang"] != r["lang_pred"]][:9])
