"""Sources, page structure, places, answers and locks on small fixtures."""

import datetime
import random
import re
import sys
from html.parser import HTMLParser

from pyspark.sql import functions as F

from tidewell import catalogue
from tidewell.functions import text as T
from tidewell.functions import urls as U
from tidewell.operators import answers, docs, history, locations, rows
from tidewell.sources import feeds, html, links, structure
from tidewell.streaming import events, locks

LONG = "Un párrafo con bastante texto para contar, con comas, y con más de sesenta letras en total. "


def article(spark, page):
    df = spark.createDataFrame([(1, page)], "page_id long, html string")
    return html.page_articles(df).first()


def test_ways_to_the_main_text(spark):
    body = "".join(f"<p>{LONG}{i}</p>" for i in range(4))
    got = article(spark, f"<div class='articleBody'>{body}<div class='related-news'><p>{LONG}</p></div><p>Lee también: {LONG}</p></div>")
    assert got.estrategia == "pista_de_cuerpo" and got.texto.count("\n") == 3
    assert article(spark, f"<main>{body}</main>").estrategia == "main"
    assert article(spark, f"<div><div>{body}</div></div>").estrategia == "contenedor_denso"
    ld = '<script type="application/ld+json">{"@graph":[{"articleBody":"' + LONG * 3 + '"}]}</script>'
    assert article(spark, ld).estrategia == "json_ld"
    assert article(spark, "<p>Un párrafo corto de más de treinta letras</p>").estrategia == "todos_los_p"
    assert article(spark, None).estrategia == "vacio"
    linked = f"<article>{body}<p>{LONG}3</p><p><a href='/x'>{LONG}</a></p><ul><li>{LONG}</li></ul></article>"
    assert article(spark, linked).texto.count("\n") == 4  # the linked one is out, and a neighbour that repeats


def test_dates_and_titles_of_pages(spark):
    page = '<title>Una noticia con un título bastante largo | Diario</title><meta name="date" content="ayer"><meta name="pubdate" content="2026-10-07"><time datetime="2020-01-01">'
    got = article(spark, page)
    assert (got.titulo, got.fecha) == ("Una noticia con un título bastante largo", "2026-10-07")
    assert article(spark, '{"datePublished": "2025-02-03"}').fecha == "2025-02-03"


def test_block_pages(spark):
    df = spark.createDataFrame([("Página web bloqueada. URL Categoría: Gambling\n",), ("403 Forbidden",), (None,)], "b string")
    assert [r[0] for r in df.select(html.blocked_category(F.col("b"))).collect()] == ["Gambling", None, None]


def test_link_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("Empresa;Web;Notas\nPerú SA;www.a.pe;ñ\nOtra;https://a.pe/;x\nNada;sin enlace;x\n".encode("cp1252"))
    got = links.link_rows(links.files(spark, str(tmp_path))).orderBy("linea").collect()
    assert [(r.linea, r.nombre, r.url, r.motivo) for r in got] == [
        (2, "Perú SA", "https://www.a.pe", None), (3, "Otra", "https://a.pe/", "duplicado"), (4, "Nada", None, "no parece un enlace"),
    ]
    text = spark.createDataFrame([("t", "# c\n\nhttps://b.pe/x\nb.pe/y\n")], "path string, texto string")
    assert [r.nombre for r in links.link_rows(text).orderBy("linea").collect()] == ["b.pe", "b.pe"]


def test_list_in_parts(spark):
    parts = [("a", None, "# c\nNombre;Enlace"), ("a", 7, "z;http://a.pe/1\nz;nada"), ("a", -2, "y;http://a.pe/1/\r\n\r\ny;http://a.pe/2"), ("b", 7, "w;http://a.pe/1")]
    got = links.link_rows(spark.createDataFrame(parts, "path string, parte long, texto string")).orderBy("path", "linea").collect()
    assert [(r.path, r.linea, r.nombre, r.motivo) for r in got] == [
        ("a", 3, "y", None), ("a", 5, "y", None), ("a", 6, "z", "duplicado"), ("a", 7, "z", "no parece un enlace"), ("b", 1, "w", None),
    ]


def test_a_host_is_one_list(spark, tmp_path):
    urls = [(3, "http://www.a.pe/x"), (150, "http://b.pe/"), (170, "https://a.pe/x/"), (2_500, "http://a.pe/y"), (9_001, "http://a.pe/X")]
    spark.createDataFrame([(*u, None) for u in urls], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = catalogue.QUERIES["src_link_list"](spark, str(tmp_path)).orderBy("path", "linea").collect()
    assert [(r.path, r.linea, r.nombre, r.motivo) for r in got] == [
        ("a.pe", 3, "n3", None), ("a.pe", 4, "n170", "duplicado"), ("a.pe", 5, "n2500", None), ("a.pe", 6, "n9001", "duplicado"), ("b.pe", 3, "n150", None),
    ]


def test_document_files(spark):
    df = spark.createDataFrame([("/d/Acme/2020/a.PDF",), ("/d/Acme/b.pdf",), ("/d/Acme/c.txt",), ("/d/Acme/b.pdf",)], "path string")
    assert sorted(map(tuple, links.document_files(df).collect())) == [("/d/Acme/2020/a.PDF", "Acme", "2020"), ("/d/Acme/b.pdf", "Acme", "")]


def test_feed_forms(spark):
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link href="http://a/1"/><updated>2026</updated></entry></feed>'
    rdf = '<rdf:RDF xmlns:rdf="r" xmlns:dc="d"><item><title>B & C</title><guid>http://b</guid><dc:date>2025</dc:date></item></rdf:RDF>'
    assert feeds.read_feed(atom) == [("item", "A", "2026", "http://a/1")]
    assert feeds.read_feed("noise " + rdf) == [("item", "B & C", "2025", "http://b")]
    assert feeds.read_feed("<urlset><url><loc>http://c</loc></url></urlset>") == [("item", "", "", "http://c")]
    assert feeds.read_feed("no feed")[0][0] == "error" and feeds.read_feed(None)[0][0] == "error"


def test_feed_in_pages(spark):
    url = "<url><loc>{}</loc></url>"
    pages = [("f", 12, url.format("c")), ("f", 3, url.format("a") + url.format("b")), ("f", None, url.format("z")), ("g", 0, url.format("a"))]
    bodies = [(u, p, f"<urlset>{b}</urlset>") for u, p, b in pages] + [("f", 5, "<urlset>")]
    index = [("i", p, "<sitemapindex>" + "<sitemap><loc>no</loc></sitemap>" * n + f"<sitemap><loc>{u}</loc></sitemap></sitemapindex>") for p, n, u in ((1, 8, "g"), (2, 0, "g"), (3, 0, "f"))]
    got = feeds.feed_items(spark.createDataFrame(bodies + index, "feed_url string, pagina long, body string")).collect()
    assert sorted((r.feed_url, r.pos, r.url) for r in got) == [("f", 0, "z"), ("f", 1, "a"), ("f", 2, "b"), ("f", 3, "c"), ("g", 0, "a"), ("i", 0, "a"), ("i", 0, "a")]


def test_a_source_is_one_sitemap(spark, tmp_path):
    ids = [(5, "s"), (70, "s"), (2_000, "s"), (3_100, "s"), (60, "t")]
    spark.createDataFrame(ids, "doc_id long, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["feed_sitemap"](spark, str(tmp_path)).collect()
    assert sorted((r.feed_url, r.pos, r.url) for r in got) == [
        ("https://f/s", 0, "https://a/5"), ("https://f/s", 1, "https://a/70"), ("https://f/s", 2, "https://a/2000"), ("https://f/s", 3, "https://a/3100"),
        ("https://f/t", 0, "https://a/60"),
    ]


def test_robots_rules(spark):
    pages = spark.createDataFrame([("http://a.pe/privado/x",), ("http://a.pe/x",), ("http://b.pe/privado/",)], "url string")
    rules = spark.createDataFrame([("a.pe", "*", 1, False, "/privado/"), ("b.pe", "*", 1, False, "/"), ("b.pe", "me", 1, True, "/")], "host string, agent string, rule_no int, allow boolean, prefix string")
    got = {r.url: r.bloqueada for r in U.blocked_by_robots(pages, rules, "me").collect()}
    assert got == {"http://a.pe/privado/x": True, "http://a.pe/x": False, "http://b.pe/privado/": False}


def test_places_of_a_site(spark):
    site = [
        (1, '<h3>Sede Sur</h3><p>Dirección: Av. Sur 123</p><p>Teléfono: 01 555 1234</p><iframe src="https://www.google.com/maps/embed?pb=!2d-77.1!3d-12.1"></iframe>'),
        (2, '<script type="application/ld+json">[{"name":"Norte","address":{"@type":"PostalAddress","streetAddress":"Calle Norte 9","city":"Lima"},"geo":{"latitude":-12,"longitude":-77}},]</script>'),
        (3, "<h2>Este</h2><address>Jr. Este 77</address>"),
        (4, "<p>Nada que ver en esta página, de verdad</p>"),
    ]
    pages = structure.page_structure(spark.createDataFrame([(i, "u", h) for i, h in site], "page_id long, url string, html string"))
    got = {(r.page_id, r.metodo): r for r in locations.all_candidates(pages).collect()}
    assert set(got) == {(1, "texto"), (2, "jsonld"), (3, "address")}
    line = got[1, "texto"]
    assert (line.nombre, line.direccion, line.telefono, line.lat, line.lng) == ("Sede Sur", "Av. Sur 123", "01 555 1234", -12.1, -77.1)
    assert (got[2, "jsonld"].direccion, got[2, "jsonld"].lat) == ("Calle Norte 9, Lima", -12.0)


def test_map_links(spark):
    urls = ["https://maps.google.com/?q=-12.1,-77.2", "https://www.google.com/maps/@-12.1,-77.2,15z", "https://x/maps?pb=!3d-12.1!4d-77.2", "https://waze.com/ul?ll=-12.1,-77.2", "https://maps.google.com/?q=Plaza+Mayor", "https://google.com/maps/place/La+Punta/"]
    df = spark.createDataFrame([(u,) for u in urls], "u string").select(*locations.map_point(F.col("u")))
    got = [tuple(r) for r in df.collect()]
    assert got[:4] == [(-12.1, -77.2, "")] * 4 and got[4:] == [(None, None, "Plaza Mayor"), (None, None, "La Punta")]


def test_merged_places_fill_gaps(spark):
    found = [("s", 1, "Calle Larga 1", "", None, False, "p1"), ("s", 2, "CALLE  larga, 1", "Tienda", 1.0, True, "p2"), ("s", 3, "x", "", None, False, "p3")]
    df = spark.createDataFrame([(s, n, a, name, lat, lat, "texto", "", "", "", loc, p) for s, n, a, name, lat, loc, p in found], "sitio string, orden int, direccion string, nombre string, lat double, lng double, metodo string, contexto string, telefono string, horario string, es_ubicacion boolean, pagina_url string")
    got = locations.merged(df, "sitio", ["orden"]).collect()
    assert len(got) == 1 and (got[0].direccion, got[0].nombre, got[0].lat, got[0].pagina_url, got[0].es_ubicacion) == ("Calle Larga 1", "Tienda", 1.0, "p2", True)


def test_answers(spark):
    fragments = spark.createDataFrame([(1, 0, "Av. Lima 5", "en Av. Lima 5, piso 2"), (1, 1, "Publicidad", ""), (1, 2, "Otra", ""), (2, 0, "Calle 3", "")], "lote long, id int, direccion string, contexto string")
    said = '<think>{"id": 9}</think>```json\n[{"id": "0", "direccion": "Av. Lima 5"}, {"id": 1, "es_local": "no"}, {"id": 2, "direccion": "Jirón Falso"},]\n```'
    given = spark.createDataFrame([(1, said), (2, "no puedo")], "lote long, respuesta string")
    got = {(r.lote, r.id): (r.resultado, r.verificada, r.direccion) for r in answers.applied(answers.responses(fragments, given)).collect()}
    assert got == {(1, 0): ("ia", "sí", "Av. Lima 5"), (1, 1): ("descartada", "", "Publicidad"), (1, 2): ("ia", "no", "Jirón Falso"), (2, 0): ("rastreo", "", "Calle 3")}


def test_long_texts_in_chunks(spark):
    df = spark.createDataFrame([("aa " * 30,), ("x" * 25,), (None,), ("",)], "text string")
    got = [r.c for r in df.select(docs.chunks("text", 2, 10).alias("c")).collect()]
    assert [c.completo for c in got] == [False, False, True, True] and got[0].trozos == ["aa aa aa", "aa aa aa"] and got[1].trozos == ["x" * 10] * 2


def test_typed_columns(spark):
    df = spark.createDataFrame([("1,5", "Y", "a", None), ("x", "quizá", "z", "{"), (None, "", "", '{"k":1}')], "n string, b string, s string, j string")
    fields = [{"key": "n", "type": "number", "min": 2}, {"key": "b", "type": "boolean", "default": "n"}, {"key": "s", "type": "select", "options": ["a"]}, {"key": "j", "type": "json"}, {"key": "q", "type": "string", "required": True}]
    got = rows.coerced(df, fields).select("n", "b", "s", "errores", "avisos").collect()
    assert got[0].n == 1.5 and got[0].b is True and got[0].errores == ["n: menor que 2", "q: falta"]
    assert [e.split(":")[0] for e in got[1].errores] == ["n", "b", "s", "j", "q"] and got[2].b is False


def test_schedules_in_words(spark):
    data = [("daily", "07:30", "0,1,2,3,4", 0), ("daily", "07:30", "", 0), ("daily", "07:30", "0,2", 0), ("interval", "", "", 180), ("interval", "", "", 90), ("interval", "", "", 150)]
    df = spark.createDataFrame(data, "k string, t string, d string, m int")
    got = [r[0] for r in df.select(history.described(F.col("k"), F.col("t"), F.col("d"), F.col("m"))).collect()]
    assert got == ["Lun–Vie a las 07:30", "Todos los días a las 07:30", "Lun, Mié a las 07:30", "Cada 3 h", "Cada 90 min", "Cada 2.5 h"]


def test_locks_refuse_after_failures(spark, tmp_path):
    at = lambda s: datetime.datetime(2026, 1, 1) + datetime.timedelta(seconds=s)
    seen = [("u", at(0), True), ("u", at(1), True), ("u", at(2), False), ("u", at(305), True), ("v", at(0), True), ("v", at(1), False), ("v", at(2), True)]
    spark.createDataFrame(seen, "user string, ts timestamp, bad boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("user string, ts timestamp, bad boolean").parquet(str(tmp_path / "in"))
    events.drained(locks.failure_locks(stream, ["user"], "ts", F.col("bad"), most=2), str(tmp_path / "out"), str(tmp_path / "state"))
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("user", "ts").collect()
    assert [(r.user, r.bloqueado, r.espera) for r in got] == [("u", False, 0), ("u", False, 0), ("u", True, 299), ("u", False, 0), ("v", False, 0), ("v", False, 0), ("v", False, 0)]


def test_text_forms(spark):
    one = lambda c, t: spark.createDataFrame([(t,)], "t string").select(c.alias("x")).first()["x"]
    t = F.col("t")
    assert one(T.clean_text(t), " ﬁn­al​ \n x") == "final x" and one(T.norm_compat(t), "ﬁN ²Á") == "fin 2a"
    assert one(T.unescape_clean(t), "a &amp;\n b") == "a & b" and one(T.sheet_cell(t, "string"), "a\x01b") == "ab"
    assert one(U.listed_urls(t), "[x](https://a/b), <http://c>;https://a/b nada") == ["https://a/b", "http://c"]
    assert one(T.safe_name(t), ' a/b:c*. ') == "a b c" and one(U.site_name(F.lit(" "), t), "http://www.a.pe/x") == "a.pe"


def test_article_links_of_a_page(spark):
    page = "<a href='/a/una-noticia-muy-larga#x'>T</a><a href='/a/una-noticia-muy-larga/'>U</a><a href='/tag/una-noticia-muy-larga'>V</a><a href='mailto:x'>m</a><a href='http://z/a/una-noticia-muy-larga'>W</a>"
    df = spark.createDataFrame([(1, "http://a.pe/q", page)], "page_id long, url string, html string")
    assert [(r.titulo, r.url) for r in html.article_links(df).collect()] == [("T", "http://a.pe/a/una-noticia-muy-larga")]


def plain_article(page):
    """A tree of nodes read by plain recursion: an independent form of the choice of the main text."""
    from tidewell.sources.elements import clean, folded
    from tidewell.sources.tags import ASIDE_NAME, ASIDE_TAGS, ASIDE_TEXT, BODY_NAME, BODY_TAGS, ENDS_PARAGRAPH, INLINE, LENGTHS

    nodes = [{"tag": "#root", "name": "", "up": None, "kids": []}]

    class Tree(HTMLParser):
        at = 0

        def handle_starttag(self, tag, attrs):
            here = nodes[self.at]
            if here["tag"] == tag and tag in ("p", "li") or here["tag"] == "p" and tag in ENDS_PARAGRAPH:
                self.at = here["up"]
            nodes.append({"tag": tag, "name": dict(attrs).get("class") or "", "up": self.at, "kids": []})
            nodes[self.at]["kids"].append(len(nodes) - 1)
            self.at = len(nodes) - 1

        def handle_endtag(self, tag):
            n = self.at
            while n is not None and nodes[n]["tag"] != tag:
                n = nodes[n]["up"]
            if n:
                self.at = nodes[n]["up"]

        def handle_data(self, data):
            if data.strip():
                nodes[self.at]["kids"].append(data)

    reader = Tree()
    reader.feed(page)
    reader.close()

    def text(n, linked=None):
        out = []
        for k in nodes[n]["kids"]:
            if isinstance(k, str):
                out += [k] if linked is None or linked else []
            else:
                out += text(k, linked if linked is None else linked or nodes[k]["tag"] == "a")
        return out

    def inside(n):
        yield n
        for k in nodes[n]["kids"]:
            if not isinstance(k, str):
                yield from inside(k)

    def paragraphs(box, p_least=40):
        out = []
        for n in inside(box):
            node, t = nodes[n], clean(" ".join(text(n)))
            if node["tag"] not in LENGTHS:
                continue
            least, most = LENGTHS[node["tag"]]
            least = p_least if least == 40 else least
            tags = [nodes[k]["tag"] for k in node["kids"] if not isinstance(k, str)]
            up, aside = n, False
            while up != box:
                aside = aside or nodes[up]["tag"] in ASIDE_TAGS and re.search(ASIDE_NAME, nodes[up]["name"])
                up = nodes[up]["up"]
            bad = node["tag"] == "div" and not set(tags) <= set(INLINE) or node["tag"] == "li" and nodes[node["up"]]["tag"] not in ("ul", "ol")
            linked = sum(len(x.strip()) for x in text(n, False))
            if len(t) >= least and not (most and len(t) > most) and not (bad or aside or linked > len(t) / 2 or re.match(ASIDE_TEXT, folded(t))):
                if out[-1:] != [t]:
                    out.append(t)
        return out

    def longest(boxes):
        return max((paragraphs(b) for b in boxes), key=lambda ps: sum(map(len, ps)), default=[])

    scores = {}
    for n in inside(0):
        t = clean(" ".join(text(n)))
        if nodes[n]["tag"] == "p" and len(t) >= 60 and sum(len(x.strip()) for x in text(n, False)) <= len(t) / 2 and not re.match(ASIDE_TEXT, folded(t)):
            up, weight = nodes[n]["up"], 1
            while up is not None and weight > 0.3:
                scores[up] = scores.get(up, 0) + weight * (1 + min(len(t) // 100, 3) + t.count(","))
                up, weight = nodes[up]["up"], weight / 2
    ways = {
        "pista_de_cuerpo": longest([n for n in inside(0) if nodes[n]["tag"] in BODY_TAGS and re.search(BODY_NAME, nodes[n]["name"])]),
        "article": longest([n for n in inside(0) if nodes[n]["tag"] == "article"]),
        "main": longest([n for n in inside(0) if nodes[n]["tag"] == "main"]),
        "contenedor_denso": paragraphs(max(scores, key=scores.get)) if scores else [],
    }
    for way, ps in ways.items():
        if sum(map(len, ps)) > 250:
            return way, "\n".join(ps)
    rest = paragraphs(0, 30)
    return ("todos_los_p", "\n".join(rest)) if rest else ("vacio", "")


def test_main_text_equals_a_plain_tree(spark):
    """Random nested pages, unclosed and wrongly closed tags among them, give the rows of the plain form."""
    rng = random.Random(8)
    tags = ["p", "p", "p", "div", "div", "li", "ul", "blockquote", "section", "article", "main", "span", "b", "a", "h2", "td"]
    names = ["", "", "", "cuerpo", "related", "menu", "x"]
    words = ["uno", "dos,", "tres", "publicidad", "Lee también:", "cuatro cinco seis siete ocho nueve diez once doce", "año"]

    def page():
        out, open_ = [], []
        for _ in range(rng.randint(1, 60)):
            kind = rng.random()
            if kind < 0.4:
                open_.append(rng.choice(tags))
                out.append(f"<{open_[-1]} class='{rng.choice(names)}'>")
            elif kind < 0.65:
                out.append(f"</{open_.pop() if open_ and rng.random() < 0.8 else rng.choice(tags)}>")
            else:
                out.append(" ".join(rng.choices(words, k=rng.choice([1, 3, 9, 9]))))
        return "".join(out)

    pages = {i: page() for i in range(400)}
    df = spark.createDataFrame(list(pages.items()), "page_id long, html string")
    got = {r.page_id: (r.estrategia, r.texto) for r in html.page_articles(df).collect()}
    want = {i: plain_article(p) for i, p in pages.items()}
    assert got == want and len({way for way, _ in want.values()}) >= 5


def test_one_row_for_each_page(spark):
    page = f"<article>{''.join(f'<p>{LONG}{i}</p>' for i in range(4))}</article>"
    df = spark.createDataFrame([(1, page, "u"), (1, page, "u"), (None, page, "u"), (2, None, None)], "page_id long, html string, title string")
    got = html.page_articles(df).collect()
    assert sorted((r.page_id or 0, r.estrategia) for r in got) == [(0, "article"), (1, "article"), (1, "article"), (2, "vacio")]
    assert html.page_articles(df.limit(0)).count() == 0
    assert [r.pos for r in html.page_paragraphs(df.where("page_id IS NULL")).orderBy("pos").collect()] == [0, 1, 2, 3]


def test_elements_in_linear_time():
    """Work grows with the elements, however deep they are nested."""
    from tidewell.sources import elements

    def steps(n):
        counted = 0

        def tick(*_):
            nonlocal counted
            counted += 1

        sys.setprofile(tick)
        elements.read("<div class='cuerpo'><p><span>" * n + "texto " * 20)
        sys.setprofile(None)
        return counted

    assert steps(4000) < 4.4 * steps(1000)
    assert elements.read("<div class='cuerpo'>" * 100_000 + "x" * 300).count == 100_001


def test_results_tables(spark):
    from tidewell.sources import tables

    page = (
        "<table id='menu'><tr><td>a<td>b<tr><td><table id='inner'><tr><td>x</td></tr></table></td></tr></table>"
        "<table><tr><th>Empresa<th>Documentó<th>N<th>Fecha</tr>"
        "<tr><td rowspan=2>Acme<td>Acta<td>1<td>hoy <a href='/d?a=1&amp;b=2' title='T'>v</a></tr>"
        "<tr><td>Hecho<td colspan='2'>2 <a href='e'>v</a></tr>"
        "<tr><td>x<td>y<td>z<td>w <a href='javascript:1'>v</a></tr><tr><td>corta<a href='f'>v</a></tr>"
    )
    df = spark.createDataFrame([(1, "https://v.pe/x/l", page), (None, None, None), (2, "https://v.pe/", "<table id='a_grd'><tr><td>A<td>B<td>C<td>D<a href='g'></a>")], "page_id long, url string, html string")
    got = sorted(map(tuple, tables.result_rows(df, "grd").collect()))
    assert got == [
        (1, 1, "Acme", "Acta", "1", "hoy v", "https://v.pe/d?a=1&b=2", "T"), (1, 2, "Acme", "Hecho", "2 v", "2 v", "https://v.pe/x/e", ""),
        (2, 0, "A", "B", "C", "D", "https://v.pe/g", ""),
    ]
    assert tables.result_rows(df.limit(0), "grd").count() == 0
