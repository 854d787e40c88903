"""Registered queries of places on pages, links and model answers, with their SQL; see ``catalogue``.

The pages are made of the supplier table: five kinds, by the key, each with another mark of its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .catalogue import query, table
from .functions import urls as U
from .operators import answers, locations
from .sources import html as pages_html
from .sources import structure

LD = '<script type="application/ld+json">{"@type":"Store","name":"T%s","telephone":"555-%s","address":{"@type":"PostalAddress","streetAddress":"Calle %s","addressLocality":"Lima","city":"lima"},"geo":{"latitude":"-12,5","longitude":-77.25},}</script>'
SCRIPT = '<script>var d = {"tiendas":[{"nombre":"J%s","direccion":"Calle Real %s interior","lat":-12.5,"lng":"-277"}]};</script>'
KINDS = [
    LD + SCRIPT,
    "<address>Av. República del Perú %s<br>Tel: (01) 555 1234</address>",
    '<p>Jr. Unión de Lima %s, piso 2</p><p>Fono 01 7654321</p><a href="https://maps.google.com/?q=-12.5,-77.25&amp;z=1">mapa</a>',
    '<div data-lat="-12,5" data-lng="-77.25" data-name="L%s" data-address="Plaza %s"></div>',
    '<a href="https://www.google.com/maps/place/Parque+%s/@-12.5,-77.25,17z">Parque</a>',
    # a mark without an address, then two named maps, of which the first stands for the place
    '<b data-latitud="-12.5" data-longitud="-77.25" aria-label="M%s"></b><a href="https://www.google.com/maps/place/Sur+%s/@-12.5,-77.25,17z">Sur</a>'
    '<a href="https://www.google.com/maps/place/Norte+%s/@-12.5,-77.25,17z">Norte</a>',
]
OPTIONS = '<select id="s"><option value="/a/%s">Uno</option><option value="2">Dos</option></select>'
ENDPOINTS = "<script>u='/api/stores/%s'; v='/locales.css'; w=\"//cdn.x/locales.json\"; x='/otra'</script>"


def filled(template: str):
    """The template with the key in each gap."""
    parts = template.split("%s")
    return F.concat(*[c for i, p in enumerate(parts) for c in ([F.col("s_suppkey").cast("string")] if i else []) + [F.lit(p)]])


def shops(spark, sf) -> DataFrame:
    kind = F.col("s_suppkey") % 6
    body = F.coalesce(*(F.when(kind == k, filled(t)) for k, t in enumerate(KINDS)))
    page = F.concat(F.lit("<html><head><title>Nuestras tiendas</title></head><body><h2>"), "s_name", F.lit("</h2>"), body, filled(OPTIONS), filled(ENDPOINTS), F.lit("</body></html>"))
    url = F.concat(F.lit("https://s"), F.col("s_suppkey").cast("string"), F.lit(".pe/"))
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("page_id"), url.alias("url"), page.alias("html"))


def parts(spark, sf) -> DataFrame:
    return structure.page_structure(shops(spark, sf))


def found(method: str, name: str, address: str, phone: str, kind: int, point: bool = True, lng: bool = True) -> str:
    lat_lng = ("-12.5::DOUBLE", "-77.25::DOUBLE" if lng else "NULL::DOUBLE") if point else ("NULL::DOUBLE", "NULL::DOUBLE")
    return f"SELECT s_suppkey AS page_id, '{method}' AS metodo, {name} AS nombre, {address} AS direccion, {phone} AS telefono, {lat_lng[0]} AS lat, {lat_lng[1]} AS lng FROM supplier WHERE s_suppkey % 6 = {kind}"


SHOWN = ["page_id", "metodo", "nombre", "direccion", "telefono", "lat", "lng"]
KEY = "s_suppkey"
FOUND = {
    "jsonld": found("jsonld", f"'T' || {KEY}", f"'Calle ' || {KEY} || ', Lima'", f"'555-' || {KEY}", 0),
    "json": found("json", f"'J' || {KEY}", f"'Calle Real ' || {KEY} || ' interior'", "''", 0, lng=False),
    "address": found("address", "s_name", f"'Av. República del Perú ' || {KEY} || ' Tel: (01) 555 1234'", "'(01) 555 1234'", 1, point=False),
    "lines": found("texto", "s_name", f"'Av. República del Perú ' || {KEY}", "'(01) 555 1234'", 1, point=False) + " UNION ALL "
    + found("texto", "s_name", f"'Jr. Unión de Lima ' || {KEY} || ', piso 2'", "'01 7654321'", 2),
    "data": found("data", f"'L' || {KEY}", f"'Plaza ' || {KEY}", "''", 3) + " UNION ALL " + found("data", f"'M' || {KEY}", "''", "''", 5),
    "map": found("mapa", "'Parque'", f"'Parque ' || {KEY}", "''", 4) + " UNION ALL " + found("mapa", "'Sur'", f"'Sur ' || {KEY}", "''", 5),
}


@query("SELECT s_suppkey AS page_id, 'Nuestras tiendas' AS titulo, s_name AS encabezado, (s_suppkey % 6 = 0)::INT AS n_ld, CASE s_suppkey % 6 WHEN 2 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 2 ELSE 0 END::INT AS n_mapas, (s_suppkey % 6 IN (3, 5))::INT AS n_datos FROM supplier")
def page_struct(spark, sf):
    heading = F.element_at(F.transform("lineas", lambda x: x["encabezado"]), -1)
    return parts(spark, sf).select("page_id", "titulo", heading.alias("encabezado"), F.size("ld").alias("n_ld"), F.size("mapas").alias("n_mapas"), F.size("datos").alias("n_datos"))


@query("SELECT s_suppkey AS page_id, '/a/' || s_suppkey AS valor, 'Uno' AS texto, 's' AS lista FROM supplier UNION ALL SELECT s_suppkey, '2', 'Dos', 's' FROM supplier")
def page_select_options(spark, sf):
    return parts(spark, sf).select("page_id", F.explode("opciones").alias("o")).select("page_id", "o.valor", "o.texto", "o.lista")


@query("SELECT s_suppkey AS page_id, ['/api/stores/' || s_suppkey, '//cdn.x/locales.json'] AS direcciones FROM supplier")
def page_endpoints(spark, sf):
    return parts(spark, sf).select("page_id", locations.endpoints(F.col("guiones")).alias("direcciones"))


@query(FOUND["jsonld"])
def loc_jsonld(spark, sf):
    return locations.json_candidates(parts(spark, sf), "jsonld").select(*SHOWN)


@query(FOUND["json"])
def loc_script_json(spark, sf):
    return locations.json_candidates(parts(spark, sf), "json").select(*SHOWN)


@query(FOUND["address"])
def loc_address_tag(spark, sf):
    return locations.address_candidates(parts(spark, sf)).select(*SHOWN)


@query(FOUND["data"])
def loc_data_attrs(spark, sf):
    return locations.data_candidates(parts(spark, sf)).select(*SHOWN)


@query(FOUND["lines"].replace("-12.5::DOUBLE", "NULL::DOUBLE").replace("-77.25::DOUBLE", "NULL::DOUBLE"))
def loc_text_lines(spark, sf):
    return locations.line_candidates(parts(spark, sf)).select(*SHOWN)


@query("""SELECT s_suppkey AS page_id, pos::INT AS pos, CASE WHEN kind = 5 THEN 2 ELSE 1 END::BIGINT AS n_mapas, -12.5::DOUBLE AS lat, -77.25::DOUBLE AS lng,
   CASE WHEN kind = 2 THEN '' ELSE name || ' ' || s_suppkey END AS consulta, name AS texto
   FROM supplier JOIN (VALUES (2, 0, 'mapa'), (4, 0, 'Parque'), (5, 0, 'Sur'), (5, 1, 'Norte')) m(kind, pos, name) ON kind = s_suppkey % 6""")
def loc_map_links(spark, sf):
    return locations.map_points(parts(spark, sf))


@query(FOUND["lines"])
def join_maps_to_texts(spark, sf):
    p = parts(spark, sf)
    return locations.with_maps(locations.line_candidates(p), locations.map_points(p)).select(*SHOWN)


@query(" UNION ALL ".join(FOUND.values()))
def loc_candidates(spark, sf):
    return locations.all_candidates(parts(spark, sf)).select(*SHOWN)


@query("""SELECT s_nationkey AS sitio, 'calle real ' || s_suppkey % 7 || ' lima' AS clave, coalesce(arg_min(s_name, s_suppkey) FILTER (s_suppkey % 2 = 1), '') AS nombre,
   coalesce(arg_min(s_suppkey / 2, s_suppkey) FILTER (s_suppkey % 3 = 1), 0.0) AS lng, bool_or(s_suppkey % 4 = 3) AS es_ubicacion,
   'https://p/' || coalesce(min(s_suppkey) FILTER (s_suppkey % 4 = 3), min(s_suppkey)) AS pagina_url FROM supplier GROUP BY s_nationkey, s_suppkey % 7""")
def agg_candidates_merge(spark, sf):
    """A coordinate of zero is a gap that a later row fills."""
    key = F.col("s_suppkey")
    rows = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("sitio"), key.alias("orden"), F.when(key % 2 == 1, F.col("s_name")).otherwise("").alias("nombre"),
        F.concat(F.lit("Calle Réal "), (key % 7).cast("string"), F.lit(", Lima")).alias("direccion"), F.lit("").alias("telefono"), F.lit("").alias("horario"),
        F.lit(0.0).alias("lat"), F.when(key % 3 == 1, key / 2).otherwise(0.0).alias("lng"), F.lit("texto").alias("metodo"), F.lit("").alias("contexto"),
        (key % 4 == 3).alias("es_ubicacion"), F.concat(F.lit("https://p/"), key.cast("string")).alias("pagina_url"),
    )
    return locations.merged(rows, "sitio", ["orden"]).select("sitio", "clave", "nombre", "lng", "es_ubicacion", "pagina_url")


@query("SELECT s_suppkey FROM supplier WHERE s_suppkey % 3 = 0 OR s_suppkey % 2 = 0")
def filt_candidate_key(spark, sf):
    key = F.col("s_suppkey")
    address = F.when(key % 3 == 0, F.concat(F.lit("Calle larga "), key.cast("string"))).otherwise("corta")
    point = F.when(key % 2 == 0, F.lit(1.5))
    return table(spark, sf, "supplier").where(locations.place_key(address, point, point).isNotNull()).select("s_suppkey")


@query("SELECT s_suppkey, s_suppkey % 4 IN (0, 2) AS linea FROM supplier")
def filt_address_line(spark, sf):
    key = F.col("s_suppkey")
    at = F.lpad(key.cast("string"), 6, "0")
    line = F.when(key % 4 == 0, F.concat(F.lit("Av. Perú "), at)).when(key % 4 == 1, F.concat(F.lit("Lote de ventas "), at, F.lit("xyz" * 90))).when(key % 4 == 2, F.concat(F.lit("Dirección: piso "), at)).otherwise("Avenida sin número ni coma")
    return table(spark, sf, "supplier").select("s_suppkey", locations.is_address_line(line).alias("linea"))


@query("""SELECT s_nationkey AS sitio, count(*) AS paginas, list_slice(list('u' || s_suppkey ORDER BY s_suppkey) FILTER (s_suppkey % 2 = 0), 1, 10) AS paginas_ubicacion,
   list_slice(list('e' || s_suppkey ORDER BY s_suppkey) FILTER (s_suppkey % 5 = 0), 1, 3) AS errores, count(*) FILTER (s_suppkey % 7 = 0) AS bloqueadas,
   count(*) FILTER (s_suppkey % 3 = 0) AS candidatos FROM supplier GROUP BY s_nationkey""")
def agg_site_summary(spark, sf):
    key = F.col("s_suppkey")
    pages = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("sitio"), key.alias("orden"), F.concat(F.lit("u"), key.cast("string")).alias("url"), (key % 2 == 0).alias("es_ubicacion"),
        F.when(key % 5 == 0, F.concat(F.lit("e"), key.cast("string"))).otherwise("").alias("error"), (key % 7 == 0).alias("bloqueada"),
    )
    rows = table(spark, sf, "supplier").where("s_suppkey % 3 = 0").select(F.col("s_nationkey").alias("sitio"))
    out = locations.site_summary(pages, rows, "sitio")
    return out.withColumns({c: F.when(F.size(c) > 0, F.col(c)) for c in ("paginas_ubicacion", "errores")})


@query("SELECT n_nationkey AS sitio FROM nation ANTI JOIN supplier ON s_nationkey = n_nationkey AND s_suppkey % 5 = 0")
def join_sites_without_rows(spark, sf):
    sites = table(spark, sf, "nation").select(F.col("n_nationkey").alias("sitio"))
    rows = table(spark, sf, "supplier").where("s_suppkey % 5 = 0").select(F.col("s_nationkey").alias("sitio"))
    return locations.sites_without_rows(sites, rows, "sitio")


@query("SELECT l_orderkey AS sitio, l_linenumber AS llegada, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_suppkey, l_linenumber)::INT AS visita FROM lineitem")
def win_frontier_rank(spark, sf):
    links = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("sitio"), F.col("l_quantity").alias("puntaje"), F.col("l_suppkey").alias("profundidad"), F.col("l_linenumber").alias("llegada"))
    return locations.frontier_rank(links, "sitio").select("sitio", "llegada", "visita")


@query("""WITH s AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n FROM lineitem GROUP BY 1)
   SELECT l_orderkey AS sitio, l_linenumber AS visita FROM lineitem JOIN s USING (l_orderkey) WHERE n < 2 AND l_linestatus = 'O'
   QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_quantity DESC, l_linenumber) <= 2""")
def win_top_pages(spark, sf):
    l = table(spark, sf, "lineitem")  # noqa: E741
    pages = l.select(F.col("l_orderkey").alias("sitio"), F.col("l_linenumber").alias("visita"), F.col("l_quantity").alias("puntaje"), (F.col("l_linestatus") == "O").alias("es_ubicacion"))
    rows = l.select(F.col("l_orderkey").alias("sitio"), F.when(F.col("l_returnflag") == "R", "jsonld").otherwise("texto").alias("metodo"))
    return locations.top_pages(pages, rows, "sitio").select("sitio", "visita")


@query("SELECT l_orderkey, 'línea ' || string_agg(DISTINCT l_shipdate::DATE::VARCHAR, chr(10) || 'línea ' ORDER BY l_shipdate::DATE::VARCHAR) || chr(10) || 'Opciones del selector: ' || string_agg(DISTINCT l_returnflag, ', ' ORDER BY l_returnflag) AS bloque FROM lineitem GROUP BY l_orderkey")
def txt_site_block(spark, sf):
    line = F.concat(F.lit("línea "), F.col("l_shipdate").cast("date").cast("string"))
    listed = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("lines"), F.collect_list("l_returnflag").alias("options"))
    return listed.select("l_orderkey", locations.site_block(F.col("lines"), F.col("options")).alias("bloque"))


ANCHOR = r"(' ' || trim(regexp_replace(lower(strip_accents(p_name)), '[^a-z0-9]+', ' ', 'g')) || ' ')"
WORDS = ["blue", "red", "réd", "small", "tion"]


@query("SELECT p_partkey, least(40, " + " + ".join(f"CASE WHEN contains({ANCHOR}, '{w.replace('é', 'e')}') THEN 10 ELSE 0 END" for w in WORDS) + " + CASE p_partkey % 3 WHEN 0 THEN 12 WHEN 1 THEN 12 ELSE 0 END)::INT AS puntaje FROM part")
def lnk_score(spark, sf):
    """Words that fold to the same text count twice, in percent escapes too."""
    kind = F.col("p_partkey") % 3
    url = F.when(kind == 0, "https://blue.pe/x/RED").when(kind == 1, "https://blue.pe/x%2/%52%C3%A9d?100%").otherwise("https://red.pe/y?z#tion")
    return table(spark, sf, "part").select("p_partkey", U.link_score(F.col("p_name"), url, [*WORDS, ""]).alias("puntaje"))


@query("SELECT p_partkey, (5 + 2 + CASE WHEN p_partkey % 2 = 0 THEN CASE p_partkey % 3 WHEN 0 THEN 8 WHEN 1 THEN 6 ELSE 0 END ELSE 0 END)::INT AS prioridad FROM part")
def lnk_boost(spark, sf):
    key = F.col("p_partkey")
    url = F.when(key % 3 == 0, "https://a.pe/tiendas/lima").otherwise("https://a.pe/otra")
    anchor = F.when(key % 3 == 1, "Siguiente »").otherwise("Ver")
    return table(spark, sf, "part").select("p_partkey", locations.link_priority(F.lit(5), anchor, F.lit("https://a.pe/tiendas/"), url, key % 2 == 0).cast("int").alias("prioridad"))


@query("SELECT p_partkey, p_partkey % 3 = 0 OR p_partkey % 5 = 0 AS es_ubicacion FROM part")
def crawl_loc_page(spark, sf):
    key = F.col("p_partkey")
    found_ = F.when(key % 3 == 0, 2).otherwise(0)
    title = F.when(key % 5 == 0, "Nuestras sucursales").otherwise("Productos")
    return table(spark, sf, "part").select("p_partkey", locations.is_location_page(found_, title, F.lit(""), F.lit("https://tienda.pe/x")).alias("es_ubicacion"))


# ---------------------------------------------------------------- model answers


def fragments(spark, sf) -> DataFrame:
    """The orders of a customer as fragments with an address each."""
    key = F.concat(F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("lote"), F.col("o_orderkey").cast("int").alias("id"), F.concat(F.lit("Calle Lima "), key).alias("direccion"), F.lit("").alias("contexto")
    )


def answer_texts(spark, sf) -> DataFrame:
    """An answer for each customer: every third has no JSON, every fourth order no object; pending ones are no place."""
    said = F.concat(
        F.lit('{"id": "'), F.col("o_orderkey").cast("string"), F.lit('", "nombre": " N  1", "es_local": '),
        F.when(F.col("o_orderstatus") == "P", "false").otherwise('"Sí"'), F.lit(', "direccion": "'),
        F.when(F.col("o_orderstatus") == "F", "").otherwise("Jirón Inventado"), F.lit('"}'),
    )
    answered = table(spark, sf, "orders").where("o_orderkey % 4 <> 0").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_list(said)), ", ").alias("objects"))
    text = F.concat(F.lit("<think>[1]</think>Aquí va: ```json\n{\"locales\": ["), "objects", F.lit(",]}\n```"))
    return answered.select(F.col("o_custkey").alias("lote"), F.when(F.col("o_custkey") % 3 == 0, "no sé").otherwise(text).alias("respuesta"))


APPLIED = """a AS (SELECT o_custkey AS lote, o_orderkey::INT AS id, 'Calle Lima ' || o_custkey || '-' || o_orderkey AS own, o_custkey % 3 <> 0 AND o_orderkey % 4 <> 0 AS answered, o_orderstatus AS f FROM orders),
   b AS (SELECT lote, id, CASE WHEN NOT answered THEN 'rastreo' WHEN f = 'P' THEN 'descartada' ELSE 'ia' END AS resultado,
     CASE WHEN NOT answered OR f = 'F' THEN own ELSE 'Jirón Inventado' END AS direccion, CASE WHEN answered THEN 'N 1' ELSE '' END AS nombre,
     CASE WHEN NOT answered OR f = 'P' THEN '' WHEN f = 'F' THEN 'sí' ELSE 'no' END AS verificada FROM a)"""


def applied(spark, sf) -> DataFrame:
    return answers.applied(answers.responses(fragments(spark, sf), answer_texts(spark, sf)))


@query("SELECT o_custkey AS lote, CASE WHEN o_custkey % 3 <> 0 THEN count(*) FILTER (o_orderkey % 4 <> 0) END AS objetos FROM orders GROUP BY o_custkey HAVING count(*) FILTER (o_orderkey % 4 <> 0) > 0")
def llm_parse_answer(spark, sf):
    size = F.size(answers.parsed_answer(F.col("respuesta")))
    return answer_texts(spark, sf).select("lote", F.when(size >= 0, size.cast("long")).alias("objetos"))


@query("SELECT o_custkey AS lote, o_orderkey::INT AS id, CASE WHEN o_custkey % 3 <> 0 AND o_orderkey % 4 <> 0 THEN 'N 1' END AS nombre FROM orders")
def join_responses(spark, sf):
    return answers.responses(fragments(spark, sf), answer_texts(spark, sf)).select("lote", "id", F.col("r.nombre").alias("nombre"))


@query(f"WITH {APPLIED} SELECT lote, id, resultado, direccion, nombre, verificada FROM b")
def llm_apply(spark, sf):
    return applied(spark, sf).select("lote", "id", "resultado", "direccion", "nombre", "verificada")


@query(f"WITH {APPLIED} SELECT lote, id, resultado AS fuente, direccion FROM b WHERE resultado = 'rastreo'")
def llm_fallback_rows(spark, sf):
    return answers.structured(applied(spark, sf)).where("fuente = 'rastreo'").select("lote", "id", "fuente", "direccion")


@query(f"""WITH {APPLIED} SELECT count(DISTINCT lote) AS consultas, count(*) FILTER (resultado = 'rastreo') AS fallos, count(*) FILTER (resultado = 'descartada') AS descartados,
   count(*) FILTER (verificada = 'no') AS sin_verificar FROM b""")
def agg_llm_stats(spark, sf):
    return answers.answer_stats(applied(spark, sf))


@query(f"""WITH {APPLIED} SELECT lote, id FROM b WHERE resultado <> 'descartada' QUALIFY row_number() OVER (PARTITION BY lote, direccion ORDER BY id) = 1""")
def set_dedupe_addresses(spark, sf):
    rows = answers.structured(applied(spark, sf))
    return answers.distinct_addresses(rows, "lote", ["id"]).select("lote", "id")
