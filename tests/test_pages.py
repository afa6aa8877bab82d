"""Page datasets on fresh markup."""

from datetime import date, datetime

from storyspark.sources import pages

LISTING = """<html><body><article><h2><a href="/nota/20260510/primera">Primera nota del día</a></h2><span class="date">10 de mayo de 2026</span>
<img data-src="/img/foto.jpg"><p class="category">Política</p></article><article><h2><a href="/x">Corta</a></h2></article></body></html>"""
BODY = "Un párrafo largo con muchas palabras para que el cuerpo tenga sentido y llegue al mínimo pedido por la regla."
DETAIL = f"""<html><head><title>Sube el precio del pan en la ciudad</title><meta property="og:description" content="Resumen &amp; más">
<meta property="article:published_time" content="2026-05-10T09:30:00-04:00"></head><body><nav>menu</nav><h1>Sube el precio del pan en la ciudad</h1>
<p>{BODY}</p><p>Te puede interesar</p><p>Esta línea de relleno se salta porque sigue a un anuncio interno</p><p>{BODY}</p><p>{BODY} Y algo más.</p>
<p>Síguenos en Facebook y en todas las demás redes</p><p>Noticias relacionadas</p><p>{BODY} No debe salir nunca.</p></body></html>"""
LD = '<script type="application/ld+json">{"@graph": [{"@type": "NewsArticle", "articleBody": "Cuerpo desde datos", "datePublished": "2026-01-02"}]}</script>'
CARD = """<div class="bcb-kpi2"><h3 class="bcb-kpi2-name">Tipo de cambio Dólar</h3><p class="bcb-kpi2-asof">10 de mayo, 2026</p>
<div class="bcb-row"><span class="bcb-lbl">Compra</span><span class="bcb-val">Bs 6,86</span></div>
<div class="bcb-row"><span class="bcb-lbl">Venta</span><span class="bcb-val">1.234,5</span></div></div>"""


def frame(spark, *markups):
    return spark.createDataFrame([(i, "https://site.com/portada/", m) for i, m in enumerate(markups)], "page_id bigint, url string, html string")


def test_cards(spark):
    rows = pages.page_articles(pages.read_pages(frame(spark, LISTING))).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row["title"], row["url"], row["image"]) == ("Primera nota del día", "https://site.com/nota/20260510/primera", "https://site.com/img/foto.jpg")
    assert row["published_at"] == datetime(2026, 5, 10) and row["source_category_raw"] == "Política"


def test_links_only_without_cards(spark):
    links = '<a href="/una-nota-muy-larga">Un titular con más de veinte letras</a>' * 2 + '<a href="/tag/una-nota">Otro titular con más de veinte</a>'
    rows = pages.page_links(pages.read_pages(frame(spark, links, LISTING))).collect()
    assert [(r["page_id"], r["url"]) for r in rows] == [(0, "https://site.com/una-nota-muy-larga")]


def test_body_rules(spark):
    rows = {r["page_id"]: r for r in pages.page_body(pages.read_pages(frame(spark, DETAIL, DETAIL.replace("<nav>", LD + "<nav>")))).collect()}
    assert rows[0]["method"] == "title_anchor"
    assert rows[0]["body"].split("\n\n") == [BODY, BODY + " Y algo más."]
    assert (rows[1]["method"], rows[1]["body"]) == ("json_ld", "Cuerpo desde datos")


def test_body_starts_at_the_first_long_line_when_no_line_shows_the_title(spark):
    lead = "Una primera línea larga que nada tiene que ver con el titular de arriba"
    page = f"<html><head><title>Zzz qqq</title></head><body><div>{lead}</div><div>{BODY}</div><article><p>{BODY} Y otro texto de selector.</p></article></body></html>"
    row = pages.page_body(pages.read_pages(frame(spark, page))).first()
    assert row["method"] == "title_anchor" and row["body"].split("\n\n")[0] == BODY


def test_meta(spark):
    row = pages.page_meta(pages.read_pages(frame(spark, DETAIL))).first()
    assert (row["description"], row["published_at"]) == ("Resumen & más", datetime(2026, 5, 10, 9, 30))


def test_indicator_cards(spark):
    rows = sorted(pages.indicator_cards(frame(spark, CARD)).collect(), key=lambda r: r["indicator_code"])
    assert [(r["indicator_code"], float(r["value"]), r["side"], r["unit"], r["currency"], r["asset"]) for r in rows] == [
        ("bcb_tipo_de_cambio_dolar_compra", 6.86, "buy", "BOB per USD", "BOB", "USD"),
        ("bcb_tipo_de_cambio_dolar_venta", 1234.5, "sell", "BOB per USD", "BOB", "USD")]
    assert rows[0]["observed_at"] == date(2026, 5, 10)


def test_meta_reads_dates_written_as_numbers(spark):
    """The place of a date among the candidates must not become its time zone."""
    page = '<html><head><meta property="og:published_time" content="1778405400"></head><body></body></html>'
    assert pages.page_meta(pages.read_pages(frame(spark, page))).first()["published_at"] == datetime(2026, 5, 10, 5, 30)


def test_python_workers_get_bounded_batches(spark):
    from storyspark.session import configure

    configure(spark)
    rows = frame(spark, *["<p>" + "x" * 100_000 + "</p>"] * 200).coalesce(1)
    sizes = rows.mapInPandas(lambda parts: (p.assign(n=p["html"].str.len().sum())[["n"]].head(1) for p in parts), "n bigint").collect()
    assert sum(r["n"] for r in sizes) == 200 * 100_007 and max(r["n"] for r in sizes) < 8_000_000
