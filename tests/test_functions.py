"""Scalar functions on fresh rows."""

from datetime import date, datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from storyspark.functions import text as t
from storyspark.functions import urls as u
from storyspark.functions import values as v
from storyspark.functions.arrow import repair_text, title_ratio


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)

    def value(column):
        return frame.select(column.alias("x")).first()["x"]

    return value


def lit(x):
    return F.lit(x)


def test_story_text_drops_prefixes_and_accents(one):
    assert one(t.story_text(lit("VIDEO: Última hora: Sube el Dólar"))) == "sube el dolar"
    assert one(t.story_text(lit("Videojuego nuevo"))) == "videojuego nuevo"


def test_title_key_removes_punctuation_without_gap(one):
    assert one(t.title_key(lit(" ¡Gol! x-y "))) == "gol xy"
    assert one(t.title_key_raw(lit("Época, nueva"))) == "época nueva"


def test_fingerprint_ignores_prefix_case_and_source(one):
    def key(title):
        return one(t.content_fingerprint(t.canonical_key(lit("Salud"), lit(title), t.story_excerpt(lit("Texto largo")))))

    assert key("VIDEO Campaña de vacunas") == key("campana de VACUNAS")
    assert key("Campaña") != key("Otra")


def test_tokens_and_jaccard(one):
    tokens = t.significant_tokens(lit("para niños sobre niños casa"))
    assert one(tokens) == ["niños", "casa"]
    assert one(t.jaccard(F.array(lit("a"), lit("b")), F.array(lit("b"), lit("c")))) == pytest.approx(1 / 3)
    assert one(t.jaccard(F.array().cast("array<string>"), F.array(lit("b")))) == 0.0


@pytest.mark.parametrize("text,hit", [("el banco central sube", True), ("banco, central", False), ("elbanco central", False), ("(banco central)", True)])
def test_term_match(one, text, hit):
    assert one(t.contains_term(lit(text), "banco central")) is hit
    assert one(t.has_term(t.word_string(lit(text)), "banco central")) is hit


def test_term_with_punctuation(one):
    assert one(t.contains_term(lit("usa c++ hoy"), "c++"))
    assert one(t.has_term(t.word_string(lit("usa c hoy")), "c")) is True


def test_cut_words(one):
    assert one(t.limit_text(lit("uno dos tres"), 9)) == "uno dos"
    assert one(t.limit_text(lit("abcdefghij"), 4)) == "abcd"
    assert one(t.excerpt(lit("uno  dos tres"), 9)) == "uno dos..."


def test_clean_generated_and_context(one):
    assert one(t.clean_generated(lit(" 1. 2)  Hola   mundo"))) == "Hola mundo"
    out = one(t.summary_with_context(lit("Corto"), lit("Primera frase nueva. Corto. " + "Segunda " * 20 + ". Tercera.")))
    assert out.startswith("Corto. Primera frase nueva. Segunda") and "Tercera" not in out
    assert one(t.summary_with_context(lit(""), lit("Algo de contexto."))) == ""


def test_sentences_keep_digits_that_are_their_position(one):
    assert one(t.sentences(lit("0 uno 0. 1 dos 1. 2 tres 2."))) == ["0 uno 0.", "1 dos 1.", "2 tres 2."]
    assert one(t.summary_with_context(lit("Reouti anatha"), lit("Reouti anatha. 19.37.233.111"))) == "Reouti anatha. 19.37.233.111"


def test_invisible_and_repair(one):
    assert one(t.strip_invisible(lit("a­b​  c"))) == "ab c"
    assert one(repair_text(lit("econom&amp;iacute;a"))) == "economía"
    assert one(repair_text(lit("dÃ­a â€œuno"))) == 'día "uno'
    assert one(repair_text(lit("uno<br/>dos"))).split() == ["uno", "dos"]


def test_url_identity(one):
    base = one(u.normalize_url(lit("http://www.Site.com/a/b/?b=2&utm_source=x&a=1#top")))
    assert base == "https://site.com/a/b?a=1&b=2"
    assert one(u.normalize_url(lit("https://site.com/a/b?a=1&b=2&fbclid=9"))) == base
    assert one(u.normalize_url(lit("site.com/a"))) == "https://site.com/a"
    assert one(u.normalize_url(lit("https://s.com/?x=&y=%C3%B1 z"))) == "https://s.com?x=&y=%C3%B1+z"
    assert one(u.url_fingerprint(lit("  "))) == ""


def test_article_urls(one):
    home = lit("https://site.com/")
    assert one(u.looks_like_article(lit("https://site.com/una-nota-larga"), home))
    assert not one(u.looks_like_article(lit("https://site.com/tag/una-nota"), home))
    assert not one(u.looks_like_article(lit("https://other.com/una-nota-larga"), home))
    assert not one(u.looks_like_article(lit("https://site.com/corta"), home))


def test_images(one):
    assert one(u.public_image(lit("https://x/pixel.gif"))) is None
    assert one(u.article_image(lit("https://x/Logo.png"))) is None
    assert one(u.article_image(lit("https://x/foto.png"))) == "https://x/foto.png"


def test_dates(one):
    assert one(u.date_from_url(lit("https://x/20260510/n"))) == datetime(2026, 5, 10)
    assert one(u.date_from_url(lit("https://x/20261310/n"))) is None
    assert one(u.date_from_url(lit("https://x/n-202605101230"))) == datetime(2026, 5, 10, 12, 30)
    assert one(v.parse_spanish_date(lit("Al 10 de mayo, 2026"))) == date(2026, 5, 10)
    assert one(v.parse_spanish_date(lit("31 de febrero de 2026"))) is None
    assert one(v.numeric_timestamp(lit("1700000000"))) == datetime(2023, 11, 14, 18, 13, 20)
    assert one(v.parse_date_text(lit("7 de septiembre de 2026 08:05"))) == datetime(2026, 9, 7, 8, 5)
    assert one(v.parse_date_text(lit("septiembre 7, 2026"))) == datetime(2026, 9, 7)
    assert one(v.parse_date_text(lit("3/4/2026"))) == datetime(2026, 4, 3)
    assert one(v.parse_date_text(lit("sin fecha"))) is None


@pytest.mark.parametrize("text,value", [("4.269,71", "4269.71"), ("6,96", "6.96"), ("Bs 12.5", "12.5"), ("n/a", None), ("", None)])
def test_decimals(one, text, value):
    assert one(v.parse_decimal(lit(text))) == (Decimal(value) if value else None)


def test_closeness(one):
    assert one(v.temporal_proximity(lit(72.0), 72)) == pytest.approx(0.85)
    assert one(v.temporal_proximity(lit(0.0), 72)) == 1.0
    assert one(v.temporal_proximity(lit(500.0), 72)) == pytest.approx(0.85)


def test_ratio_keeps_argument_order(spark):
    from difflib import SequenceMatcher

    pairs = [("tide", "diet"), ("diet", "tide"), ("", ""), ("a", ""), ("casa roja", "casa rota")]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", title_ratio("a", "b").alias("r")).collect()
    for row in rows:
        assert row["r"] == pytest.approx(SequenceMatcher(None, row["a"], row["b"]).ratio())


def test_mobile(one):
    assert one(t.is_mobile(lit("Mozilla Android"))) == "mobile"
    assert one(t.is_mobile(lit(None).cast("string"))) == "unknown"
