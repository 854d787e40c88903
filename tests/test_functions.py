from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import urls as U
from tidewell.operators import catalog, docs, graph, history, rows, similarity
from tidewell.sources import feeds, html


def one(spark, column, **values):
    return spark.createDataFrame([values], ", ".join(f"{k} string" for k in values)).select(column.alias("x")).first()["x"]


def test_keywords_are_whole_words_without_accents(spark):
    assert one(spark, T.kw_match(F.col("t"), ["fusión", "perú"]), t="La FUSION y confusión en el Peru") == ["fusión", "perú"]
    assert one(spark, T.kw_match(F.col("t"), ["fusión"]), t="confusión") == []


def test_dates(spark):
    for raw in ("2026-10-07T08:00:00-05:00", "Wed, 07 Oct 2026 08:00:00 -0500", "2026-10-07T13:00:00Z"):
        assert one(spark, T.parse_date(F.col("t")).cast("string"), t=raw) == "2026-10-07 13:00:00"
    assert one(spark, T.parse_date(F.col("t")), t="ayer") is None


def test_cells_and_lists(spark):
    assert one(spark, T.csv_cell(F.col("t"), "string"), t="=1+1") == "'=1+1"
    assert one(spark, T.csv_cell(F.col("t").cast("double"), "double"), t="-3") == "-3.0"
    assert one(spark, T.parse_list(F.col("t")), t=" a, b;;c\n") == ["a", "b", "c"]
    assert one(spark, T.time_hhmm(F.col("t")), t="7:05") == "07:05"
    assert one(spark, T.time_hhmm(F.col("t")), t="24:00") is None


def test_urls(spark):
    assert one(spark, U.valid_url(F.col("t")), t="www.a.pe/x") == "https://www.a.pe/x"
    assert one(spark, U.valid_url(F.col("t")), t="no enlace") is None
    assert one(spark, U.canonical(F.col("t")), t="HTTP://A.pe//x/?utm_source=1&b=2#top") == "http://a.pe/x?b=2"
    assert one(spark, U.resolved(F.col("t"), F.lit("../y#z")), t="http://a.pe/q/x") == "http://a.pe/y"


def test_twins_of_one_outlet_recur_only_without_cross(spark):
    body = "alfa beta gamma delta epsilon zeta theta kappa lambda omega sigma"
    data = [(1, "A", body, "http://a/1", body, None, 0), (2, "A", body, "http://a/2", body, None, 0), (3, "B", "otro texto distinto", "http://b/1", "nada", None, 0)]
    df = spark.createDataFrame(data, "_seq long, medio string, titulo string, url string, contenido string, fecha_iso string, ind_relevante int")
    assert similarity.recurrence(df).where("recurrencia = 'Sí'").count() == 0
    assert similarity.recurrence(df, cross=False).where("recurrencia = 'Sí'").count() == 2


def test_term_search_takes_plurals_and_broken_words(spark):
    df = spark.createDataFrame([(1, 1, "Dos fusiones y una reorga-\nnización societaria"), (2, 1, "confusión")], "doc long, page int, text string")
    hits = docs.term_hits(df, ["fusión", "reorganización societaria"], ["doc", "page"]).select("doc", "termino", "n").collect()
    assert sorted(map(tuple, hits)) == [(1, "fusión", 1), (1, "reorganización societaria", 1)]


def test_graphs(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("x", "y"), ("y", "x")], "source string, target string")
    levels, cyclic = graph.levels(edges)
    assert {tuple(r) for r in levels.collect()} == {("a", 0), ("b", 1), ("c", 2)}
    assert {r[0] for r in cyclic.collect()} == {"x", "y"}
    assert ("c", "a") in {tuple(r) for r in graph.ancestors(edges).collect()}
    empty = spark.createDataFrame([], "a long, b long")
    assert graph.components(empty).count() == 0


def test_next_fire_is_strictly_after(spark):
    at = F.to_timestamp(F.col("t"))
    fired = one(spark, history.next_fire(at, 7, 30, [0, 1, 2, 3, 4]).cast("string"), t="2026-10-09 07:30:00")
    assert fired == "2026-10-12 07:30:00"


def test_names_match_exactly_before_partly(spark):
    known = spark.createDataFrame([("106", "Falabella Perú"), ("107", "Saga Falabella"), ("108", "Falabella")], "id string, nombre string")
    lines = spark.createDataFrame([("falabella",), ("106",), ("NO EXISTE",)], "linea string")
    hits, misses = catalog.name_match(lines, known)
    assert sorted((r.linea, r.id) for r in hits.collect()) == [("106", "106"), ("falabella", "108")]
    assert [r.linea for r in misses.collect()] == ["NO EXISTE"]


def test_pages_and_feeds(spark):
    page = "<html><head><title>Un título</title></head><body><nav><a href='/m'>menú</a></nav><article><h1>Hola</h1><p>" + "texto largo " * 30 + "</p></article></body></html>"
    df = spark.createDataFrame([(1, "http://a.pe", page), (2, "http://b.pe", None)], "page_id long, url string, html string")
    article = {r.page_id: r for r in html.page_articles(df).collect()}
    assert article[1].estrategia == "article" and article[1].titulo == "Un título" and article[2].estrategia == "vacio"
    assert [(r.href, r.texto) for r in html.page_links(df).collect()] == [("/m", "menú")]
    rss = "<rss><channel><item><title>T</title><link>http://a/1</link><pubDate>x</pubDate></item></channel></rss>"
    index = "<sitemapindex><sitemap><loc>http://rss</loc></sitemap></sitemapindex>"
    bodies = spark.createDataFrame([("http://rss", rss), ("http://index", index), ("http://bad", "<rss>")], "feed_url string, body string")
    assert sorted((r.feed_url, r.url) for r in feeds.feed_items(bodies).collect()) == [("http://index", "http://a/1"), ("http://rss", "http://a/1")]


def test_csv_sink(spark, tmp_path):
    df = spark.createDataFrame([("=x", 1.5, True)], "a string, b double, c boolean")
    rows.write_csv(df, str(tmp_path / "out"))
    assert [tuple(r) for r in spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "out")).collect()] == [("'=x", "1.5", "true")]


def test_names_by_their_rarest_letters(spark):
    """Lines and names that all begin alike: equal to all pairs, with few candidates."""
    names = [f"Compañía {a}{b}{c} del Norte" for a in "abcdef" for b in "ghijkl" for c in "mnopqr"] + ["ab", "x", "Cía. Ab"]
    lines = [f"compania {n[9:12]}" for n in names[:216]] + [f"COMPAÑÍA {a}zz" for a in "abc"] + [f"{n[9:12]} del" for n in names[:50]] + ["a", "ab", "x", "qq", "norte", ""]
    known = spark.createDataFrame(list(enumerate(names)), "id int, nombre string")
    asked = spark.createDataFrame([(n,) for n in lines * 2], "linea string")
    hits, misses = catalog.name_match(asked, known)
    fold = {n: text.lower().replace("ñ", "n").replace("í", "i") for n in lines + names for text in [n]}
    want = set()
    for line in filter(None, set(lines)):
        same = [(line, str(i), n) for i, n in enumerate(names) if fold[n] == fold[line]]
        want |= set(same or [(line, str(i), n) for i, n in enumerate(names) if fold[line] in fold[n]])
    assert {tuple(r) for r in hits.collect()} == want
    assert {r.linea for r in misses.collect()} == {"COMPAÑÍA azz", "COMPAÑÍA bzz", "COMPAÑÍA czz", "qq", ""}
    folded = lambda df, c, name: df.select(F.translate(F.lower(c), "ñí", "ni").alias(name)).distinct()
    beginning = folded(asked.where("linea LIKE 'compania%'"), "linea", "line")
    assert catalog.containing(beginning, folded(known, "nombre", "name")).count() <= 40 * 216  # of 216 * 216 that begin alike
