"""Registered queries of sources, feeds, pages, filings and schedules, with their SQL; see ``catalogue``."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import HOST, NORM, PATH, drained, query, table
from .functions import text as T
from .functions import urls as U
from .operators import docs, graph, history, rows, similarity
from .sources import feeds, html, links, tables
from .streaming import arrivals, locks
from .streaming import events as streams


def stored(spark, df: DataFrame, write) -> str:
    """The folder to which ``write`` has written ``df``."""
    at = f"{graph.shared_folder(spark)}/sink-{uuid.uuid4().hex}"
    write(df, at)
    return at


# ---------------------------------------------------------------- lists of links


#: Lines of a list, entries of a feed and feeds of an index are bounded, so no source is one group.
LINES, ENTRIES, CHILDREN = 100, 50, 16
#: A host's whole list, and a source's whole feed, comes in parts: what lies in so many ids.
SPAN = 1000


def joined_lines(lines: DataFrame, *keys: str) -> DataFrame:
    """The keys and ``lines``, the text of each group in the order of the ids."""
    each = F.transform(F.array_sort(F.collect_list(F.struct("page_id", "line"))), lambda x: x["line"])
    return lines.groupBy(*keys).agg(F.array_join(each, "\r\n").alias("lines"))


def listed_lines(spark, sf) -> DataFrame:
    """(host, page_id, line): a name and a URL of each page."""
    line = F.concat_ws(";", F.concat(F.lit("n"), F.col("page_id").cast("string")), "url", F.lit("x, y"))
    return table(spark, sf, "pages").select(U.host_key(F.col("url")).alias("host"), "page_id", line.alias("line"))


def link_lists(spark, sf) -> DataFrame:
    """Up to ``LINES`` pages of a host as a text file: a header, then a name and a URL in each line."""
    path = F.concat("host", F.lit("/"), F.expr(f"page_id div {LINES}").cast("string"))
    listed = joined_lines(listed_lines(spark, sf).withColumn("path", path), "path")
    return listed.select("path", F.concat(F.lit("# lista\nNombre;Enlace;Nota\n"), "lines").alias("texto"))


def host_lists(spark, sf) -> DataFrame:
    """All pages of a host as one text file in parts: the header, whose ``parte`` is null, then the lines of ``SPAN`` ids each."""
    lines = listed_lines(spark, sf).withColumnRenamed("host", "path").withColumn("parte", F.expr(f"page_id div {SPAN}"))
    heads = lines.select("path", F.lit(None).cast("long").alias("parte"), F.lit("# lista\nNombre;Enlace;Nota").alias("texto")).distinct()
    return heads.union(joined_lines(lines, "path", "parte").select("path", "parte", F.col("lines").alias("texto")))


HOST_KEY = f"regexp_replace(split_part({HOST}, ':', 1), '^www\\.', '')"
LIST_PATH = f"{HOST_KEY} || '/' || page_id // {LINES}"
LISTED = f"SELECT {HOST_KEY} AS path, page_id, url, row_number() OVER (PARTITION BY {HOST_KEY} ORDER BY page_id) AS n FROM pages"
URL_KEY = r"regexp_replace(regexp_replace(lower(url), '^https?://(www\.)?', ''), '/+$', '')"


@query(f"""WITH l AS ({LISTED}) SELECT path, (n + 2)::INT AS linea, url AS valor, 'n' || page_id AS nombre, url,
   CASE WHEN row_number() OVER (PARTITION BY path, {URL_KEY} ORDER BY n) > 1 THEN 'duplicado' END AS motivo FROM l""")
def src_link_list(spark, sf):
    return links.link_rows(host_lists(spark, sf))


@query(f"SELECT DISTINCT {LIST_PATH} AS path, ';' AS delimitador FROM pages")
def src_sniff_delimiter(spark, sf):
    return links.delimiter(links.numbered_lines(link_lists(spark, sf)))


@query(f"SELECT DISTINCT {LIST_PATH} AS path, true AS encabezado, 1::INT AS columna FROM pages")
def src_header_detect(spark, sf):
    return links.layout(links.cells(links.numbered_lines(link_lists(spark, sf))))


@query(f"SELECT DISTINCT {LIST_PATH} AS path, true AS encabezado, 2::INT AS columna FROM pages")
def src_url_column_detect(spark, sf):
    """A column that is asked for by its name, in any case, comes before the first with a link."""
    return links.layout(links.cells(links.numbered_lines(link_lists(spark, sf))), "NOTA")


@query("SELECT doc_id, text AS texto FROM documents")
def src_decode_fallback(spark, sf):
    """Texts as files of two encodings: every other one is Latin-1 where that holds all its letters."""
    text = F.col("text")
    narrow = (F.col("doc_id") % 2 == 0) & ~text.rlike("[^\\x00-\\x7f\\xa0-\\xff]")
    raw = F.when(narrow, F.encode(F.regexp_replace(text, "[^\\x00-\\xff]", "?"), "ISO-8859-1")).otherwise(F.encode(text, "UTF-8"))
    return table(spark, sf, "documents").select("doc_id", links.decoded(raw).alias("texto"))


@query("SELECT url, substr(html, instr(html, '<title>') + 7, instr(html, '</title>') - instr(html, '<title>') - 7) AS titulo FROM pages WHERE contains(html, '</title>')")
def src_collect_inputs(spark, sf):
    """Rows of several inputs that have a title and a URL."""
    titled = table(spark, sf, "pages").select("url", F.nullif(F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1), F.lit("")).alias("titulo"))
    untitled = table(spark, sf, "documents").select(F.col("source").alias("medio"))
    return rows.union_rows(titled, untitled).where("url IS NOT NULL AND titulo IS NOT NULL").select("url", "titulo")


@query("""SELECT DISTINCT '/d/' || source || '/' || (2000 + doc_id % 7) || '/' || doc_id || '.pdf' AS path, source AS empresa, (2000 + doc_id % 7)::VARCHAR AS anio
          FROM documents WHERE doc_id % 3 <> 0""")
def src_doc_files(spark, sf):
    ending = F.when(F.col("doc_id") % 3 == 0, ".txt").otherwise(".pdf")
    year = (F.lit(2000) + F.col("doc_id") % 7).cast("string")
    way = F.concat(F.lit("/d/"), "source", F.lit("/"), year, F.lit("/"), F.col("doc_id").cast("string"), ending)
    return links.document_files(table(spark, sf, "documents").select(way.alias("path")))


# ---------------------------------------------------------------- feeds


def grouped_entries(spark, sf, entry, start: str, end: str, size: int) -> DataFrame:
    """(source, lote, body): the documents of a source in groups of up to ``size`` ids, each in the order of the ids."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))), lambda x: x["e"])
    bodies = table(spark, sf, "documents").groupBy("source", F.expr(f"doc_id div {size}").alias("lote")).agg(F.array_join(parts, "\n").alias("inner"))
    return bodies.select("source", "lote", F.concat(F.lit(start), "inner", F.lit(end)).alias("body"))


def feed_bodies(spark, sf, entry, start: str, end: str) -> DataFrame:
    """Up to ``ENTRIES`` documents of a source as a feed, in the order of their ids, with its source and number."""
    url = F.concat(F.lit("https://f/"), "source", F.lit("/"), F.col("lote").cast("string"))
    return grouped_entries(spark, sf, entry, start, end, ENTRIES).select("source", "lote", url.alias("feed_url"), "body")


def rss_bodies(spark, sf) -> DataFrame:
    at = F.col("doc_id").cast("string")
    entry = F.concat(F.lit("<item><title>T & "), "lang", F.lit("</title><link>https://a/"), at, F.lit("</link><dc:date>2026-10-07</dc:date></item>"))
    return feed_bodies(spark, sf, entry, '<rss xmlns:dc="x"><channel>', "</channel></rss>")


PLACE = f"(row_number() OVER (PARTITION BY source, doc_id // {ENTRIES} ORDER BY doc_id) - 1)::INT"


@query(f"SELECT 'https://f/' || source || '/' || doc_id // {ENTRIES} AS feed_url, {PLACE} AS pos, 'T & ' || lang AS titulo, '2026-10-07' AS fecha_raw, 'https://a/' || doc_id AS url FROM documents")
def feed_rss(spark, sf):
    """The bodies have bare ampersands, which are mended."""
    return feeds.feed_items(rss_bodies(spark, sf))


@query("SELECT 'https://f/' || source AS feed_url, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1)::INT AS pos, '' AS titulo, '2026-01-01' AS fecha_raw, 'https://a/' || doc_id AS url FROM documents")
def feed_sitemap(spark, sf):
    """All documents of a source are one sitemap, in pages of ``SPAN`` ids."""
    entry = F.concat(F.lit("<url><loc>https://a/"), F.col("doc_id").cast("string"), F.lit("</loc><lastmod>2026-01-01</lastmod></url>"))
    pages = grouped_entries(spark, sf, entry, "<urlset>", "</urlset>", SPAN)
    return feeds.feed_items(pages.select(F.concat(F.lit("https://f/"), "source").alias("feed_url"), F.col("lote").alias("pagina"), "body"))


@query(f"""WITH i AS (SELECT source, doc_id // {ENTRIES} AS lote, {PLACE} AS pos, lang, doc_id FROM documents),
   r AS (SELECT *, dense_rank() OVER (PARTITION BY source, lote // {CHILDREN} ORDER BY lote) AS n FROM i)
   SELECT 'https://i/' || source || '/' || lote // {CHILDREN} AS feed_url, pos, 'T & ' || lang AS titulo, '2026-10-07' AS fecha_raw, 'https://a/' || doc_id AS url FROM r WHERE n <= 10""")
def feed_sitemap_index(spark, sf):
    """An index of a source's feeds follows ten of its children."""
    bodies = rss_bodies(spark, sf)
    each = F.array_sort(F.collect_list(F.struct("lote", "feed_url")))
    listed = F.array_join(F.transform(each, lambda x: F.concat(F.lit("<sitemap><loc>"), x["feed_url"], F.lit("</loc></sitemap>"))), "")
    url = F.concat(F.lit("https://i/"), "source", F.lit("/"), F.col("part").cast("string"))
    indexes = bodies.groupBy("source", F.expr(f"lote div {CHILDREN}").alias("part")).agg(listed.alias("listed"))
    indexes = indexes.select(url.alias("feed_url"), F.concat(F.lit("<sitemapindex>"), "listed", F.lit("</sitemapindex>")).alias("body"))
    return feeds.feed_items(bodies.select("feed_url", "body").union(indexes)).where("startswith(feed_url, 'https://i/')")


@query("SELECT page_id AS id, 'html' AS tipo FROM pages WHERE lower(ltrim(substr(html, 1, 600))) LIKE '<!doctype html%' UNION ALL SELECT doc_id, 'feed' FROM documents")
def feed_kind_detect(spark, sf):
    p = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("body"))
    d = table(spark, sf, "documents").select("doc_id", "text")
    return p.union(d).select("id", feeds.feed_kind(F.lit("auto"), F.col("body")).alias("tipo"))


LINKS = r"""l AS (SELECT page_id, url AS base, unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href,
   generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) - 1 AS pos FROM pages)"""


@query(rf"""WITH {LINKS}, u AS (SELECT page_id, pos, regexp_extract(base, '^(https?://[^/]+)', 1) || href AS url, href FROM l)
   SELECT page_id, pos::INT AS pos, substr(href, 2) AS titulo, url FROM u WHERE regexp_matches(url, '(?i)/[a-z]{{5,}}$')
   QUALIFY row_number() OVER (PARTITION BY page_id, url ORDER BY pos) = 1""")
def feed_html_index(spark, sf):
    return html.article_links(table(spark, sf, "pages"), "/[a-z]{5,}$")


TITLE = r"""trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&lt;', '<'), '&gt;', '>'), '&amp;', '&'), '\s+', ' ', 'g'))"""


@query(rf"""SELECT page_id, CASE WHEN length({TITLE}) > 40 THEN trim(regexp_extract({TITLE}, '^(.*?)(\s[|\-–—]\s.*)?$', 1)) ELSE {TITLE} END AS titulo FROM pages""")
def page_title(spark, sf):
    return html.page_articles(table(spark, sf, "pages")).select("page_id", "titulo")


@query(r"""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '2026-10-0' || (1 + doc_id % 9) WHEN doc_id % 3 = 1 THEN '2025-01-01T00:00:00Z' ELSE '' END AS fecha FROM documents""")
def page_pubdate(spark, sf):
    """Metadata comes before what the text of a page says; what is no date is passed over."""
    day = F.concat(F.lit("2026-10-0"), (1 + F.col("doc_id") % 9).cast("string"))
    meta = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('<meta name="pubdate" content="ayer"><meta property="date" content="'), day, F.lit('">'))).otherwise("")
    time = F.when(F.col("doc_id") % 3 != 2, '<time datetime="2025-01-01T00:00:00Z">').otherwise("")
    pages = table(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.concat(meta, F.lit("<p>x</p>"), time).alias("html"))
    return html.page_articles(pages).select(F.col("page_id").alias("doc_id"), "fecha")


@query(rf"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Titular de la nota más larga' ELSE {TITLE} END AS titulo, CASE WHEN page_id % 2 = 0 THEN '2026-01-01' ELSE '' END AS fecha_raw FROM pages WHERE length({TITLE}) BETWEEN 1 AND 40")
def page_title_backfill(spark, sf):
    even = F.col("page_id") % 2 == 0
    pages = table(spark, sf, "pages")
    short = pages.where(F.length(T.unescape_clean(F.regexp_extract("html", "<title>([^<]*)</title>", 1))).between(1, 40))
    items = short.select("page_id", F.when(even, "Titular de la nota más larga").otherwise("Nota").alias("titulo"), F.when(even, "2026-01-01").otherwise("").alias("fecha_raw"))
    return html.filled_from_page(items, html.page_articles(pages), "page_id")


@query("SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'Gambling ' || lang WHEN doc_id % 5 = 1 THEN '?' END AS categoria FROM documents WHERE NOT regexp_matches(lower(strip_accents(substr(text, 1, 4000))), 'skyhigh|zscaler|webfilter|blue ?coat|url categor|forcepoint|netskope|fortiguard')")
def page_block_detect(spark, sf):
    said = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("<b>Skyhigh</b> URL Categories: Gambling "), "lang", F.lit("\n"))).when(F.col("doc_id") % 5 == 1, "Página web bloqueada ").otherwise("")
    plain = F.lower(T.fold_accents(F.substring("text", 1, 4000)))
    d = table(spark, sf, "documents").where(~plain.rlike("skyhigh|zscaler|webfilter|blue ?coat|url categor|forcepoint|netskope|fortiguard"))
    return d.select("doc_id", html.blocked_category(F.concat(said, "text")).alias("categoria"))


# ---------------------------------------------------------------- filters, sinks and stores


@query(rf"WITH {LINKS} SELECT page_id, pos::INT AS pos FROM l WHERE pos % 2 = 0")
def filt_href_scheme(spark, sf):
    """Every other link is made one of mail, which goes."""
    given = html.page_links(table(spark, sf, "pages"))
    href = F.when(F.col("pos") % 2 == 1, F.concat(F.lit("MailTo:x@"), "href")).otherwise(F.col("href"))
    return given.where(U.is_link(href)).select("page_id", "pos")


@query(f"SELECT page_id, {PATH} LIKE '/de/%' OR ({PATH} LIKE '/fr/%' AND {HOST_KEY} LIKE 'a%') AS bloqueada FROM pages")
def filt_robots(spark, sf):
    """All agents are kept from /de/; from /fr/ too on hosts with a, where our own agent has no rules."""
    hosts = table(spark, sf, "pages").select(U.host_key(F.col("url")).alias("host")).distinct()
    rule = lambda agent, n, allow, prefix: hosts.select("host", F.lit(agent).alias("agent"), F.lit(n).alias("rule_no"), F.lit(allow).alias("allow"), F.lit(prefix).alias("prefix"))
    told = rule("*", 1, False, "/de/").union(rule("*", 2, True, "/")).union(rule("*", 0, False, "/fr/"))
    own = rule("we", 1, True, "/fr/").union(rule("we", 2, False, "/de/")).where(~F.col("host").startswith("a"))
    return U.blocked_by_robots(table(spark, sf, "pages").select("page_id", "url"), told.union(own), "we").select("page_id", "bloqueada")


@query("SELECT doc_id, quality::VARCHAR AS q, CASE WHEN toxic = 1 THEN '''=1' ELSE 'a;\"b' END AS celda FROM labels")
def sink_csv(spark, sf):
    """What is written is read back."""
    cell = F.when(F.col("toxic") == 1, "=1").otherwise('a;"b')
    at = stored(spark, table(spark, sf, "labels").select("doc_id", F.col("quality").alias("q"), cell.alias("celda")), rows.write_csv)
    return spark.read.option("header", True).option("sep", ";").option("escape", '"').schema("doc_id long, q string, celda string").csv(at)


@query("""SELECT '/d/' || source || '/' || CASE WHEN doc_id % 7 > 0 THEN (2000 + doc_id % 7) || '/' ELSE '' END || doc_id || '.pdf' AS path, source AS empresa,
   CASE WHEN doc_id % 7 > 0 THEN (2000 + doc_id % 7)::VARCHAR ELSE '' END AS anio, CASE WHEN quality = 1 THEN 'IDENTIFICADOS' ELSE 'REVISAR_MANUAL' END AS ruta
   FROM documents JOIN labels USING (doc_id) WHERE quality = 1 OR toxic = 1""")
def sink_routed(spark, sf):
    """Documents as files in folders by company and, but for some, year; the manifest is read again."""
    key = F.col("doc_id").cast("string")
    year = F.when(F.col("doc_id") % 7 > 0, F.concat((F.col("doc_id") % 7 + 2000).cast("string"), F.lit("/"))).otherwise("")
    files = links.document_files(table(spark, sf, "documents").select(F.concat(F.lit("/d/"), "source", F.lit("/"), year, key, F.lit(".pdf")).alias("path")))
    found = files.withColumn("doc_id", F.regexp_extract("path", "(\\d+)[.]pdf$", 1).cast("long")).join(table(spark, sf, "labels"), "doc_id")
    routed = found.select("path", "empresa", "anio", docs.route(F.col("quality"), F.col("toxic")).alias("ruta"))
    at = stored(spark, routed, docs.write_routed)
    return spark.read.schema("path string, ruta string, empresa string, anio string").parquet(at).fillna("", ["empresa", "anio"])


@query("""WITH s AS (SELECT source AS medio, 'https://a/' || doc_id AS url FROM documents UNION SELECT 'src1', url FROM pages)
   SELECT medio, url FROM s QUALIFY row_number() OVER (PARTITION BY medio ORDER BY url DESC) <= 20000""")
def sink_seen_store(spark, sf):
    old = table(spark, sf, "documents").select(F.col("source").alias("medio"), F.concat(F.lit("https://a/"), F.col("doc_id").cast("string")).alias("url"))
    return rows.seen_store(old, table(spark, sf, "pages").select(F.lit("src1").alias("medio"), "url"))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'viejo' ELSE 'nuevo' END AS resultado FROM documents d LEFT JOIN (SELECT DISTINCT doc_id FROM labels) l USING (doc_id)")
def sink_scan_cache(spark, sf):
    """Newer results replace stored ones; the store is written and read back."""
    old = table(spark, sf, "documents").select("doc_id", F.lit("viejo").alias("resultado"), F.lit(0).alias("version"))
    new = table(spark, sf, "labels").select("doc_id", F.lit("nuevo").alias("resultado"), F.lit(1).alias("version"))
    at = stored(spark, rows.latest_per_key(old.union(new), ["doc_id"], [F.desc("version")]), lambda df, path: df.write.parquet(path))
    return spark.read.schema("doc_id long, resultado string, version int").parquet(at).select("doc_id", "resultado")


@query("SELECT page_id, url FROM pages")
def src_stream_pages(spark, sf):
    return drained(spark, streams.table_stream(spark, sf, "pages").select("page_id", "url"))


# ---------------------------------------------------------------- texts


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS limpio FROM documents WHERE NOT regexp_matches(text, '[^\x00-\x{2FF}\x{1E00}-\x{1EFF}]|[\x00-\x08\x1C-\x1F\x{85}\x{A0}\x{AA}\x{AD}\x{B2}-\x{BE}]')")
def clean_text(spark, sf):
    """Texts whose letters have no other compatible form."""
    d = table(spark, sf, "documents").where(~F.col("text").rlike("[^\\x00-\\u02FF\\u1E00-\\u1EFF]|[\\x00-\\x08\\x1C-\\x1F\\x85\\xA0\\xAA\\xAD\\xB2-\\xBE]"))
    return d.select("doc_id", T.clean_text(F.col("text")).alias("limpio"))


@query(f"SELECT n_nationkey, {NORM.format('n_name')} || ' 1⁄2' AS plano FROM nation")
def norm_compat(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", T.norm_compat(F.concat("n_name", F.lit("  ½"))).alias("plano"))


@query("SELECT doc_id, lower(strip_accents(text)) AS plano, length(text) = length(plano) AS igual_largo FROM documents")
def fold_1to1(spark, sf):
    plain = T.fold_1to1(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", plain.alias("plano"), (F.length("text") == F.length(plain)).alias("igual_largo"))


@query(r"SELECT s_suppkey, s_name || ' & <b> ñ' AS limpio FROM supplier")
def html_unescape_clean(spark, sf):
    raw = F.concat("s_name", F.lit("  &amp;\n&lt;b&gt; &ntilde; "))
    return table(spark, sf, "supplier").select("s_suppkey", T.unescape_clean(raw).alias("limpio"))


@query("SELECT page_id, CASE WHEN url = 'https://z/' || page_id THEN [url] ELSE [url, 'https://z/' || page_id] END AS urls FROM pages")
def parse_urls(spark, sf):
    said = F.concat(F.lit("ver [aquí]("), "url", F.lit("), <https://z/"), F.col("page_id").cast("string"), F.lit(">; ftp://x "), "url")
    return table(spark, sf, "pages").select("page_id", U.listed_urls(said).alias("urls"))


@query(f"SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'Sitio ' || page_id ELSE {HOST_KEY} END AS nombre FROM pages")
def site_name_default(spark, sf):
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" Sitio "), F.col("page_id").cast("string"))).otherwise("  ")
    return table(spark, sf, "pages").select("page_id", U.site_name(name, F.col("url")).alias("nombre"))


@query("SELECT p_partkey, replace(p_name, ' ', ' ') || ' x y' AS nombre FROM part")
def safe_name(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.safe_name(F.concat(F.lit(" ."), "p_name", F.lit(':*? x/\\y. '))).alias("nombre"))


@query("SELECT c_custkey, '(01) 555-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS telefono FROM customer")
def phone(spark, sf):
    number = F.concat(F.lit("sin número. Teléf: (01) 555-"), F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), F.lit(" anexo"))
    return table(spark, sf, "customer").select("c_custkey", T.phone(F.col("c_name"), number).alias("telefono"))


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN 1.0 WHEN s_suppkey % 3 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE AS parte FROM supplier")
def txt_verify(spark, sf):
    address = F.when(F.col("s_suppkey") % 3 == 0, "Av. Perú 12").when(F.col("s_suppkey") % 3 == 1, "calle inventada").otherwise("a b")
    return table(spark, sf, "supplier").select("s_suppkey", T.verified_share(address, F.lit("en la AV. PERU, calle 5")).cast("double").alias("parte"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(replace(text, '­', ''), '-[ \t]*\r?\n[ \t]*', '', 'g'), '[\x00-\x08\x0b-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')) AS limpio FROM documents""")
def txt_clean_page(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.clean_page(F.col("text")).alias("limpio"))


@query(r"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_quantity END AS cantidad,
   CASE l_returnflag WHEN 'R' THEN true WHEN 'A' THEN false END AS marca, CASE WHEN l_linestatus = 'O' THEN 'O' END AS estado,
   list_filter([CASE WHEN l_linenumber % 4 = 0 THEN 'cantidad: no es un número' END, CASE WHEN l_returnflag = 'N' THEN 'marca: no es sí o no' END,
   CASE WHEN l_linestatus <> 'O' THEN 'estado: no es una opción' END], lambda e: e IS NOT NULL) AS errores, ['sobra: desconocido'] AS avisos FROM lineitem""")
def coerce_columns(spark, sf):
    raw = table(spark, sf, "lineitem").select(
        F.col("l_orderkey"), F.col("l_linenumber"),
        F.when(F.col("l_linenumber") % 4 == 0, "mucho").otherwise(F.replace(F.col("l_quantity").cast("string"), F.lit("."), F.lit(","))).alias("cantidad"),
        F.when(F.col("l_returnflag") == "R", " Sí").when(F.col("l_returnflag") == "A", "").otherwise("quizá").alias("marca"),
        F.col("l_linestatus").alias("estado"), F.lit(1).alias("sobra"),
    )
    fields = [
        {"key": "l_orderkey", "type": "string"}, {"key": "l_linenumber", "type": "string"}, {"key": "cantidad", "type": "number"},
        {"key": "marca", "type": "boolean", "default": "no"}, {"key": "estado", "type": "select", "options": ["O", 5]},
    ]
    typed = rows.coerced(raw, fields)
    return typed.withColumns({c: F.col(c).cast("long" if c == "l_orderkey" else "int") for c in ("l_orderkey", "l_linenumber")})


@query(r"SELECT doc_id, substr(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), 1, 32767) AS celda FROM documents")
def proj_sheet_cell(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.sheet_cell(F.col("text"), "string").alias("celda"))


# ---------------------------------------------------------------- filings and reports


@query(f"SELECT n_nationkey FROM nation WHERE {NORM.format('n_name')} = 'peru' OR n_nationkey = 3")
def filt_doc_equals(spark, sf):
    wanted = table(spark, sf, "nation").where("n_nationkey = 3 OR lower(n_name) = 'peru'")
    return wanted.where(docs.same_kind(F.concat(F.lit("Dé "), "n_name"), "dE  ") | docs.same_kind(F.lit("Fusión"), "FUSION")).select("n_nationkey")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate), l_partkey ORDER BY l_orderkey, l_linenumber) = 1""")
def set_dedupe_docs(spark, sf):
    filings = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_suppkey").alias("empresa_id"), F.year("l_shipdate").alias("anio"), F.col("l_partkey").alias("url"),
        F.concat_ws("-", "l_suppkey", F.year("l_shipdate")).alias("expediente"), F.lit("d").alias("documento"),
    )
    return docs.distinct_filings(filings, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber")


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 > 0) AS con_hallazgo, count(*) FILTER (o_orderstatus = 'F' AND o_orderkey % 3 = 0) AS sin_hallazgo,
   count(*) FILTER (o_orderstatus = 'O') AS sin_leer, count(*) FILTER (o_orderstatus = 'P') AS errores, count(*) FILTER (o_totalprice > 100000) AS reusados FROM orders GROUP BY o_custkey""")
def agg_scan_stats(spark, sf):
    status = F.col("o_orderstatus")
    scans = table(spark, sf, "orders").select("o_custkey", F.when(status == "F", F.col("o_orderkey") % 3).alias("hits"), (status == "P").alias("error"), (F.col("o_totalprice") > 100000).alias("reusado"))
    return docs.scan_stats(scans, "o_custkey")


@query("""SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS descargados, count(*) FILTER (o_orderstatus = 'O') AS existentes, count(*) FILTER (o_orderstatus = 'P') AS errores,
   0::BIGINT AS sin_documentos, 0::BIGINT AS pendientes FROM orders GROUP BY o_custkey""")
def agg_download_stats(spark, sf):
    state = F.when(F.col("o_orderstatus") == "F", "descargado").when(F.col("o_orderstatus") == "O", "ya existía").otherwise("error")
    return docs.download_stats(table(spark, sf, "orders").select("o_custkey", state.alias("estado")), "o_custkey")


@query("SELECT estrategia, count(*) AS paginas FROM (SELECT CASE WHEN length(text) > 250 THEN 'article' WHEN length(text) >= 40 THEN 'todos_los_p' ELSE 'vacio' END AS estrategia FROM (SELECT trim(regexp_replace(regexp_replace(strip_accents(substr(text, 1, 300)), '[^A-Za-z ]', '', 'g'), ' +', ' ', 'g')) AS text FROM documents WHERE length(text) >= 40)) GROUP BY 1")
def agg_strategy_counts(spark, sf):
    """The letters of the documents' starts, as the one paragraph of an article."""
    plain = F.trim(F.regexp_replace(F.regexp_replace(T.fold_accents(F.substring("text", 1, 300)), "[^A-Za-z ]", ""), " +", " "))
    d = table(spark, sf, "documents").where("length(text) >= 40")
    pages = d.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("<article><p>"), plain, F.lit("</p></article>")).alias("html"))
    return html.page_articles(pages).groupBy("estrategia").agg(F.count(F.lit(1)).alias("paginas"))


@query("SELECT count(*) AS total, count(*) FILTER (quality = 1) AS relevantes, count(*) FILTER (toxic = 1) AS recurrentes, count(DISTINCT CASE WHEN toxic = 1 THEN quality END) AS grupos FROM labels")
def agg_global_summary(spark, sf):
    marked = table(spark, sf, "labels").select(
        F.col("quality").alias("ind_relevante"), F.when(F.col("toxic") == 1, "Sí").otherwise("No").alias("recurrencia"),
        F.when(F.col("toxic") == 1, F.col("quality").cast("string")).otherwise("").alias("id_recurrencia"),
    )
    return similarity.global_summary(marked)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey")
def sort_date(spark, sf):
    return similarity.sorted_by(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), "fecha", date="o_orderdate", place="o_orderkey")


@query("SELECT o_orderkey, o_orderpriority, o_orderdate FROM orders ORDER BY o_orderpriority, o_orderdate, o_orderkey")
def sort_outlet(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority", "o_orderdate")
    return similarity.sorted_by(o, "medio", date="o_orderdate", place="o_orderkey", outlet="o_orderpriority")


# ---------------------------------------------------------------- histories and streams


@query("""WITH r AS (SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
   SELECT o_custkey, l_linenumber AS node_id, l_orderkey AS run_id FROM lineitem JOIN r ON o_orderkey = l_orderkey WHERE n <= 20 AND l_returnflag <> 'R'
   QUALIFY row_number() OVER (PARTITION BY o_custkey, l_linenumber ORDER BY n) = 1""")
def win_latest_ok_result(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), "o_custkey", "o_orderdate")
    results = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("node_id"), F.when(F.col("l_returnflag") == "R", "error").otherwise("ok").alias("status"))
    return history.latest_ok_results(runs, results, "o_custkey", [F.desc("o_orderdate"), F.desc("run_id")]).select("o_custkey", "node_id", "run_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'Cada ' || (45 + o_orderkey % 3) || ' min' WHEN o_orderstatus = 'P' THEN 'Cada 3 h'
   WHEN o_orderkey % 3 = 0 THEN 'Todos los días a las 07:30' WHEN o_orderkey % 3 = 1 THEN 'Lun–Vie a las 07:30' ELSE 'Mar, Dom a las 07:30' END AS texto FROM orders""")
def sched_describe(spark, sf):
    kind = F.when(F.col("o_orderstatus").isin("F", "P"), "interval").otherwise("daily")
    every = F.when(F.col("o_orderstatus") == "P", 180).otherwise(45 + F.col("o_orderkey") % 3).cast("int")
    days = F.when(F.col("o_orderkey") % 3 == 0, "").when(F.col("o_orderkey") % 3 == 1, "0,1,2,3,4").otherwise("1,6")
    return table(spark, sf, "orders").select("o_orderkey", history.described(kind, F.lit("07:30"), days, every).alias("texto"))


@query("SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 10 MINUTES THEN 'omitida' ELSE 'iniciada' END AS resultado FROM events")
def str_late_policy(spark, sf):
    e = streams.table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return drained(spark, streams.late_policy(e, "ts", "2024-01-15 00:00:00", 10).select("event_id", "resultado"))


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 48 HOURS")
def str_recent_window(spark, sf):
    e = streams.table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return drained(spark, locks.recent(e, "ts", "2024-01-15 00:00:00", 48).select("event_id"))


@query("""WITH RECURSIVE e AS (SELECT user_id, ts, epoch_us(ts) AS us, event_type = 'error' AS bad, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
   w AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::TIMESTAMP AS ts, false AS fallo, []::BIGINT[] AS near, []::BIGINT[] AS recorded FROM events
     UNION ALL SELECT user_id, n, ts, bad, near, CASE WHEN len(near) >= 2 THEN near WHEN bad THEN list_append(near, us) ELSE [] END FROM (
       SELECT e.user_id, e.n, e.ts::TIMESTAMP AS ts, e.bad, e.us, list_filter(w.recorded, lambda t: e.us - t < 86400000000) AS near FROM w JOIN e ON e.user_id = w.user_id AND e.n = w.n + 1))
   SELECT user_id, ts, fallo, len(near) >= 2 AS bloqueado, CASE WHEN len(near) >= 2 THEN (86400000000 - (epoch_us(ts) - near[1])) // 1000000 + 1 ELSE 0 END::BIGINT AS espera FROM w WHERE n > 0""")
def str_failure_lock(spark, sf):
    """Refused attempts depend on those before; the SQL walks through them."""
    e = streams.table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = drained(spark, locks.failure_locks(e, ["user_id"], "ts", F.col("event_type") == "error", most=2, window=86400, order=F.col("event_id")))
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("""SELECT event_id, user_id, event_type, (event_id % 3)::INT AS dia FROM (
     SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3, event_id) AS r FROM events) WHERE r = 1""")
def str_arrivals(spark, sf):
    """Events that come in three lots: of each user and type, the first that comes."""
    at = f"{graph.shared_folder(spark)}/arrivals-{uuid.uuid4().hex}"
    events = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("user"), "user_id", "event_type")
    store = arrivals.SeenStore(f"{at}/store", "user", "event_type", "user string, event_type string")
    for lot in range(3):
        events.where(F.col("event_id") % 3 == lot).write.mode("append").parquet(f"{at}/in")
        stream = spark.readStream.schema(events.schema).parquet(f"{at}/in")
        arrivals.arrivals(stream, store, f"{at}/out", f"{at}/state", ["event_id"])
    out = spark.read.option("basePath", f"{at}/out").parquet(f"{at}/out")
    return out.select("event_id", "user_id", "event_type", F.col("lote").cast("int").alias("dia"))


# ---------------------------------------------------------------- results tables


@query("""SELECT o_orderkey AS page_id, l_linenumber AS pos, 'Cliente ' || o_custkey AS denominacion, CASE WHEN l_linenumber % 2 = 1 THEN 'Acta' ELSE 'Hecho' END AS documento,
   o_orderkey || '-' || l_linenumber AS expediente, o_orderstatus AS fecha, 'https://v.pe/x/d' || l_linenumber || '?k=1' AS url, 'ver ' || l_linenumber AS titulo
   FROM orders JOIN (SELECT unnest([1, 2]) AS l_linenumber) ON l_linenumber = 1 OR o_orderkey % 3 <> 0""")
def src_html_table_rows(spark, sf):
    """Each order as a page with a results table, found by its id or by its header; a customer's cell spans two rows."""
    key = F.col("o_orderkey").cast("string")
    line = lambda n, first: F.concat(F.lit("<tr>"), first, F.lit(f"<td>{'Acta' if n % 2 else ' Hecho '}</td><td>"), key, F.lit(f"-{n}</td><td>"), F.col("o_orderstatus"), F.lit(f"<a href='d{n}?k=1' title='ver {n}'>v</a>" if n < 3 else "<a href='javascript:x()'>v</a>"), F.lit("</td></tr>"))
    both = F.col("o_orderkey") % 3 != 0
    customer = F.concat(F.when(both, F.lit("<td rowspan=2>")).otherwise(F.lit("<td>")), F.lit("Cliente "), F.col("o_custkey").cast("string"), F.lit("</td>"))
    rows = F.concat(line(1, customer), F.when(both, line(2, F.lit(""))).otherwise(F.lit("<tr><td colspan=4>nada</td></tr>")), line(3, F.lit("<td>x</td>")))
    table_id = F.when(F.col("o_orderkey") % 2 == 0, F.lit("c_grdInfo")).otherwise("otra")
    html_ = F.concat(F.lit("<table><tr><td>menu</td></tr></table><table id='"), table_id, F.lit("'><tr><th>Empresa</th><th>DOCUMENTO</th><th>N</th><th>F</th></tr>"), rows, F.lit("</table>"))
    pages = table(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), F.lit("https://v.pe/x/lista").alias("url"), F.regexp_replace(html_, "<a ([^>]*)>v</a>", "<a $1></a>").alias("html"))
    return tables.result_rows(pages, "grdInfo")
