"""The registered queries of the library, each over the given tables, and their SQL for comparison."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions import urls as U
from .operators import catalog, crawl, docs, graph, history, rows, similarity
from .plans import discards, news
from .sources import html
from .sources.tags import ASIDE_TEXT
from .streaming import events as streams
from .streaming import locks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

NORM = r"trim(regexp_replace(lower(strip_accents({})), '\s+', ' ', 'g'))"
HOST = "lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1))"
PATH = "regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1)"
STOP = "[" + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"
TERMS = f"list_filter(regexp_extract_all({NORM}, '[a-z0-9ñ]{{{{4,}}}}'), lambda x: NOT list_contains({STOP}, x))"
KEYWORDS = ["the", "der", "que", "les"]
SEARCHED = ["licen", "version", "general public"]
#: Bytes of a file that one task reads.
SPLIT = 128 << 20


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A table for work that costs much more than reading: one that gives fewer tasks than there are cores is dealt out first.

    Larger tables, with a file or a split of a file for each core or more, are read as they lie.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{sf}/{name}.parquet")
    held = at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    cores, whole = spark.sparkContext.defaultParallelism, table(spark, sf, name)
    return whole.repartition(cores) if held < cores * SPLIT and len(whole.inputFiles()) < cores else whole


# ---------------------------------------------------------------- scalar functions


@query("SELECT doc_id, strip_accents(text) AS plain FROM documents")
def fold_accents(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.fold_accents(F.col("text")).alias("plain"))


@query(f"SELECT doc_id, {NORM.format('text')} AS plain FROM documents")
def norm(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.norm(F.col("text")).alias("plain"))


@query(r"SELECT doc_id, trim(regexp_replace(lower(strip_accents(text || CASE WHEN doc_id % 2 = 0 THEN ' fin 1 2 full' ELSE '' END)), '[^a-z0-9]+', ' ', 'g')) AS plain FROM documents")
def norm_alnum(spark, sf):
    """Every other text ends with signs that only their compatible forms make letters and digits."""
    more = F.when(F.col("doc_id") % 2 == 0, " ﬁn ½ ＦＵＬＬ").otherwise("")
    return table(spark, sf, "documents").select("doc_id", T.norm_alnum(F.concat("text", more)).alias("plain"))


@query(f"SELECT page_id, {HOST} AS host, regexp_replace(split_part({HOST}, ':', 1), '^www\\.', '') AS clave FROM pages")
def host_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.host(F.col("url")).alias("host"), U.host_key(F.col("url")).alias("clave"))


@query(r"""SELECT page_id, regexp_replace(regexp_replace(lower(url), '^https?://(www\.)?', ''), '/+$', '') AS clave,
           regexp_replace(split_part(trim(url), '#', 1), '/+$', '') AS clave_noticia FROM pages""")
def url_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.url_key(F.col("url")).alias("clave"), U.news_key(F.col("url")).alias("clave_noticia"))


@query(rf"""SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN url WHEN 2 THEN 'https://' || regexp_replace(url, '^https?://', '') END AS valida,
   regexp_extract({PATH}, '^/+([^/]+)', 1) AS seccion FROM pages WHERE {HOST} LIKE '%.%'""")
def url_valid_norm(spark, sf):
    """URLs as they are, in quotes, without their scheme, and in a sentence, which is none."""
    url, kind = F.col("url"), F.col("page_id") % 4
    given = F.when(kind == 0, url).when(kind == 1, F.concat(F.lit(' "'), url, F.lit("'> "))).when(kind == 2, F.regexp_replace(url, "^https?://", "")).otherwise(F.concat(F.lit("ver "), url))
    return table(spark, sf, "pages").where(U.host(url).contains(".")).select("page_id", U.valid_url(given).alias("valida"), U.section(url).alias("seccion"))


@query(f"SELECT page_id, regexp_matches(lower({PATH}), '\\.({'|'.join(U.SKIPPED_FILES)})$') AS archivo FROM pages")
def filt_skip_ext(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.is_file(F.col("url")).alias("archivo"))


@query(f"SELECT page_id FROM pages WHERE {HOST} = 'tionsh.example.net' OR {HOST} LIKE '%.tionsh.example.net'")
def filt_same_site(spark, sf):
    return table(spark, sf, "pages").where(U.same_site(F.col("url"), "tionsh.example.net")).select("page_id")


@query("SELECT page_id FROM pages WHERE (url LIKE '%/en/%' OR url LIKE '%/de/%') AND url NOT LIKE '%utm_%'")
def filt_paths(spark, sf):
    url = F.col("url")
    return table(spark, sf, "pages").where((url.contains("/en/") | url.contains("/de/")) & ~url.contains("utm_")).select("page_id")


@query(r"""SELECT page_id, regexp_replace(regexp_replace(url, '[?]utm_source=feed$', ''), '/$', '') AS canonica FROM pages
          WHERE NOT regexp_matches(regexp_replace(url, '[?]utm_source=feed$', ''), '[?#A-Z%]|[^:/]//|^https?://[^/]*/?$')""")
def lnk_canon(spark, sf):
    plain = table(spark, sf, "pages").where(~F.regexp_replace("url", "[?]utm_source=feed$", "").rlike("[?#A-Z%]|[^:/]//|^https?://[^/]*/?$"))
    return plain.select("page_id", U.canonical(F.col("url")).alias("canonica"))


@query()
def lnk_canon_all(spark, sf):
    return table(spark, sf, "pages").select("page_id", U.canonical(F.col("url")).alias("canonica"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || '… (+' || (length(text) - 200) || ' caracteres)'
          ELSE text END AS vista FROM conversations""")
def preview_value(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", T.preview_value(F.col("text")).alias("vista"))


@query(r"SELECT p_partkey, coalesce(nullif(regexp_replace(p_brand, '\D', '', 'g'), ''), 'sin') AS cifras FROM part")
def digits_only(spark, sf):
    return table(spark, sf, "part").select("p_partkey", T.digits_only(F.col("p_brand"), "sin").alias("cifras"))


@query("SELECT c_custkey, CASE WHEN abs(c_acctbal) <= 180 THEN c_acctbal END AS grados FROM customer")
def num_coord(spark, sf):
    comma = F.replace(F.col("c_acctbal").cast("string"), F.lit("."), F.lit(","))
    return table(spark, sf, "customer").select("c_custkey", T.num_coord(comma).alias("grados"))


@query("SELECT doc_id, lower(quality::VARCHAR) IN ('true', 'si', 'sí', '1', 'yes') AS cierto FROM labels")
def truthy(spark, sf):
    return table(spark, sf, "labels").select("doc_id", T.truthy(F.col("quality")).alias("cierto"))


@query("SELECT event_id, strftime(ts, '%H:%M') AS hora FROM events")
def time_hhmm(spark, sf):
    loose = F.concat(F.hour("ts").cast("string"), F.lit(":"), F.date_format("ts", "mm"))
    return table(spark, sf, "events").select("event_id", T.time_hhmm(loose).alias("hora"))


@query("SELECT o_orderkey, o_orderdate::TIMESTAMP AS fecha FROM orders")
def parse_date(spark, sf):
    """Dates written the RFC 2822 way are read back."""
    mail = F.date_format(F.col("o_orderdate").cast("timestamp"), "EEE, dd MMM yyyy HH:mm:ss")
    return table(spark, sf, "orders").select("o_orderkey", T.parse_date(F.concat(mail, F.lit(" +0000"))).cast("timestamp_ntz").alias("fecha"))


@query("SELECT s_suppkey, list_filter(list_transform(string_split_regex(s_name, '[,;\\n#]'), lambda x: trim(x)), lambda x: x <> '') AS partes FROM supplier")
def parse_list(spark, sf):
    listed = F.replace(F.col("s_name"), F.lit("#"), F.lit(";"))
    return table(spark, sf, "supplier").select("s_suppkey", T.parse_list(listed).alias("partes"))


@query("SELECT event_id, replace(event_type, 'error', '***') AS tapado FROM events")
def mask_needles(spark, sf):
    return table(spark, sf, "events").select("event_id", T.mask_needles(F.col("event_type"), ["error", "abc"]).alias("tapado"))


@query("""SELECT s_suppkey, list_sort(['nodo' || s_suppkey % 3, 'vars']) AS raices FROM supplier""")
def tmpl_refs(spark, sf):
    node = (F.col("s_suppkey") % 3).cast("string")
    template = F.concat(F.lit("{{ vars.a }} "), F.col("s_name"), F.lit(" {{nodo"), node, F.lit(".result[0]}} {{ vars.b | default:1 }}"))
    return table(spark, sf, "supplier").select("s_suppkey", T.tmpl_refs(template).alias("raices"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS valor, coalesce(json_extract_string(props, '$.falta'), 'nada') AS falta FROM events")
def json_path(spark, sf):
    value, missing = T.json_path(F.col("props"), "k"), T.json_path(F.col("props"), "falta")
    return table(spark, sf, "events").select("event_id", value.alias("valor"), F.coalesce(missing, F.lit("nada")).alias("falta"))


# ---------------------------------------------------------------- projections and filters


@query(r"""SELECT doc_id::VARCHAR AS id, CASE WHEN text IS NULL THEN '' WHEN regexp_matches(substr(text, 1, 32000), '^[=+\-@\t\r]')
           THEN '''' || substr(text, 1, 32000) ELSE substr(text, 1, 32000) END AS texto FROM documents""")
def proj_csv_cell(spark, sf):
    return rows.csv_cells(table(spark, sf, "documents"), ["doc_id", "text"], {"doc_id": "id", "text": "texto"})


@query("SELECT l_orderkey AS pedido, l_quantity AS cantidad, l_returnflag AS marca FROM lineitem")
def proj_select_rename(spark, sf):
    chosen = table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_returnflag")
    return chosen.withColumnsRenamed({"l_orderkey": "pedido", "l_quantity": "cantidad", "l_returnflag": "marca"})


@query("SELECT doc_id, CASE WHEN coalesce(length(text), 0) = 0 THEN 'vacio' WHEN length(text) < 250 THEN 'corto' ELSE 'ok' END AS cuerpo FROM documents")
def filt_min_body(spark, sf):
    size = F.length(F.coalesce("text", F.lit("")))
    return table(spark, sf, "documents").select("doc_id", F.when(size == 0, "vacio").when(size < 250, "corto").otherwise("ok").alias("cuerpo"))


@query("SELECT d.doc_id, d.source FROM documents d SEMI JOIN (SELECT doc_id FROM labels WHERE quality = 1) l ON d.doc_id = l.doc_id")
def filt_relevant(spark, sf):
    good = table(spark, sf, "labels").where("quality = 1").select("doc_id")
    return table(spark, sf, "documents").select("doc_id", "source").join(good, "doc_id", "left_semi")


@query("SELECT event_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 24 HOURS")
def filt_time_window(spark, sf):
    e = table(spark, sf, "events")
    newest = e.agg(F.max("ts").alias("newest"))
    return e.join(F.broadcast(newest)).where(F.col("ts") >= F.col("newest") - F.expr("INTERVAL 24 HOURS")).select("event_id")


TAGGED = " OR ".join(f"regexp_matches(' ' || {NORM.format('text')} || ' ', '[^a-z0-9_]{w}[^a-z0-9_]')" for w in KEYWORDS)


@query(f"SELECT doc_id, ({TAGGED})::INT AS ind_relevante FROM documents")
def txt_kw_tag(spark, sf):
    found = T.kw_match(F.col("text"), KEYWORDS)
    return dealt(spark, sf, "documents").select("doc_id", (F.size(found) > 0).cast("int").alias("ind_relevante"))


TITLED = "substr(split_part(text, chr(10), 1), 1, 80) || ' https://' || source || '.example.com/' || lang"


@query(f"SELECT doc_id FROM documents WHERE NOT regexp_matches(' ' || {NORM.format(TITLED)} || ' ', '[^a-z0-9_](der|fr|src1)[^a-z0-9_]')")
def filt_exclude_kw(spark, sf):
    """Articles without these words in their title and URL."""
    title = F.substring(F.split("text", "\n")[0], 1, 80)
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/"), "lang")
    return table(spark, sf, "documents").where(F.size(T.kw_match(F.concat_ws(" ", title, url), ["der", "FR", "src1"])) == 0).select("doc_id")


@query("""SELECT source AS medio, count(*) FILTER (length(text) > 0 AND length(text) < 250) AS cortos,
          count(*) FILTER (coalesce(length(text), 0) = 0) AS vacios, count(*) FILTER (length(text) >= 250) AS quedan FROM documents GROUP BY source""")
def agg_discards(spark, sf):
    marked = news.reasons(news.articles(table(spark, sf, "documents")))
    return marked.groupBy("medio").agg(
        F.count_if(F.col("motivo") == "texto_corto").alias("cortos"),
        F.count_if(F.col("motivo") == "sin_texto").alias("vacios"),
        F.count_if(F.col("motivo").isNull()).alias("quedan"),
    )


SAYS = lambda text, words: f"regexp_matches(' ' || {NORM.format(text)} || ' ', '[^a-z0-9_]({words})[^a-z0-9_]')"


@query(f"""WITH a AS (SELECT doc_id, coalesce(lang, '?') AS medio, 'https://x.pe/S' || doc_id % 3 || '/der-n' || doc_id // 30 AS url, doc_id % 50 AS hour, doc_id % 11 = 0 AS undated,
     coalesce(text, '') AS body, substr(string_split(coalesce(text, ''), chr(10))[1], 1, 80) AS title FROM documents),
   e AS (SELECT *, CASE WHEN doc_id % 3 = 1 THEN 'otra_seccion' WHEN NOT undated AND hour < 5 THEN 'fuera_de_ventana' END AS early FROM a),
   f AS (SELECT *, min(doc_id) FILTER (early IS NULL) OVER (PARTITION BY medio, url) AS first FROM e),
   r AS (SELECT medio, CASE WHEN doc_id > first THEN 'duplicadas' WHEN early IS NOT NULL THEN early
     WHEN {SAYS("title || ' n' || doc_id // 30", "les|n7")} THEN 'excluidas_titulo' WHEN doc_id % 13 = 0 THEN 'errores' WHEN body = '' THEN 'cuerpo_vacio' WHEN length(body) < 250 THEN 'cuerpo_corto'
     WHEN undated AND hour < 25 THEN 'fuera_de_ventana' WHEN {SAYS("title || ' ' || body", "que")} THEN 'excluidas_contenido'
     WHEN NOT {SAYS("title || ' ' || body", "the|der")} THEN 'no_relevantes' END AS motivo FROM f)
   SELECT medio, {", ".join(f"count(*) FILTER (motivo = '{m}') AS {m}" for m in discards.REASONS)}, count(*) FILTER (motivo IS NULL) AS quedan FROM r GROUP BY medio""")
def agg_feed_discards(spark, sf):
    """Documents as the feed of their language, in the order of their ids: why they go, by all nine reasons."""
    key, start = F.col("doc_id"), "TIMESTAMP '2024-01-01 00:00:00'"
    text = F.coalesce("text", F.lit(""))
    items = table(spark, sf, "documents").select(
        key, F.coalesce("lang", F.lit("?")).alias("medio"), F.concat(F.lit("https://x.pe/S"), (key % 3).cast("string"), F.lit("/der-n"), F.expr("doc_id div 30").cast("string")).alias("url"),
        F.substring(F.split(text, "\n")[0], 1, 80).alias("titulo"), "text", text.alias("contenido"), F.when(key % 13 == 0, "HTTP").alias("error"),
        F.when(key % 11 != 0, F.expr(f"{start} + make_interval(0, 0, 0, 0, CAST(doc_id % 50 AS INT))")).alias("fecha"),
        F.expr(f"{start} + make_interval(0, 0, 0, 0, CAST(doc_id % 50 AS INT) - 20)").alias("fecha_pagina"),
    )
    rules = discards.FeedRules(exclude=["/s1/"], since="2024-01-01 05:00:00", left_out_title=["les", "n7"], left_out_text=["Qué"], relevant=["the", "der"], only_relevant=True, shortest=250)
    return discards.discard_counts(discards.feed_reasons(items, rules, "doc_id"))


# ---------------------------------------------------------------- aggregates


@query(f"""WITH d AS (SELECT source AS medio, ({TAGGED})::INT AS r FROM documents)
           SELECT medio, count(*) AS total, sum(r)::BIGINT AS relevantes FROM d GROUP BY medio""")
def agg_outlet_summary(spark, sf):
    tagged = news.relevant(news.articles(table(spark, sf, "documents")), [])
    found = T.kw_match(F.col("contenido"), KEYWORDS)
    return similarity.outlet_summary(tagged.withColumn("ind_relevante", (F.size(found) > 0).cast("int")))


@query("SELECT string_agg('  - ' || source || ': ' || n || ' noticias', chr(10) ORDER BY source) AS resumen FROM (SELECT source, count(*) AS n FROM documents GROUP BY source)")
def agg_summary_text(spark, sf):
    counts = table(spark, sf, "documents").groupBy("source").count()
    line = F.concat(F.lit("  - "), "source", F.lit(": "), F.col("count").cast("string"), F.lit(" noticias"))
    return counts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source", line.alias("line")))), lambda x: x["line"]), "\n").alias("resumen"))


@query(f"SELECT term, count(*) AS df FROM (SELECT DISTINCT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY term")
def agg_doc_freq(spark, sf):
    return similarity.document_frequencies(similarity.term_frequencies(dealt(spark, sf, "documents"), "doc_id", F.col("text")))


@query(f"SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TERMS.format('text')}) AS term FROM documents) GROUP BY doc_id, term")
def agg_term_freq(spark, sf):
    return similarity.term_frequencies(dealt(spark, sf, "documents"), "doc_id", F.col("text"))


VECTORS = f"""
  tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({TERMS.format('body')}) AS term FROM d) GROUP BY id, term),
  df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM d),
  raw AS (SELECT id, term, df, n, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS r FROM tf JOIN df USING (term), n),
  v AS (SELECT id, term, df, n, r / sqrt(sum(r * r) OVER (PARTITION BY id)) AS w FROM raw)"""
RARE = f"""{VECTORS},
  rare AS (SELECT id, term FROM v WHERE df <= greatest(3, floor(n * 0.25)) AND df BETWEEN 2 AND 60),
  cand AS (SELECT x.id AS a, y.id AS b FROM rare x JOIN rare y ON x.term = y.term AND x.id < y.id GROUP BY 1, 2 HAVING count(*) >= 2),
  sim AS (SELECT a, b, sum(x.w * y.w) AS sim FROM cand JOIN v x ON x.id = a JOIN v y ON y.id = b AND y.term = x.term GROUP BY a, b HAVING sum(x.w * y.w) >= 0.4)"""
PAIRS = f"""{VECTORS},
  sim AS (SELECT x.id AS a, y.id AS b, sum(x.w * y.w) AS sim FROM v x JOIN v y ON y.term = x.term AND x.id < y.id GROUP BY 1, 2 HAVING sum(x.w * y.w) >= 0.4)"""


@query(f"WITH d AS (SELECT doc_id AS id, text AS body FROM documents), {VECTORS} SELECT id AS doc_id, term, round(w, 6) AS w FROM v")
def txt_tfidf(spark, sf):
    return similarity.tfidf(dealt(spark, sf, "documents"), "doc_id", F.col("text")).select("doc_id", "term", F.round("w", 6).alias("w"))


@query(f"WITH d AS (SELECT doc_id AS id, text AS body FROM documents), {PAIRS} SELECT a, b, round(sim, 4) AS sim FROM sim")
def txt_similar(spark, sf):
    """All pairs of whole texts."""
    return similarity.similar_pairs(dealt(spark, sf, "documents"), "doc_id", F.col("text"))


@query(f"WITH d AS (SELECT doc_id AS id, substr(text, 1, 1200) AS body FROM documents), {RARE} SELECT a, b, round(sim, 4) AS sim FROM sim")
def join_similar_pairs(spark, sf):
    """Starts of texts by rare terms in at most 60 documents, as the daily report compares them."""
    return similarity.pairs_of_rare_terms(dealt(spark, sf, "documents"), "doc_id", F.substring("text", 1, 1200), 0.4)


NEWS = f"""WITH RECURSIVE art AS (
    SELECT doc_id AS id, source AS medio, substr(split_part(text, chr(10), 1), 1, 80) AS titulo, text,
           'https://' || source || '.example.com/' || lang || '/' || doc_id AS url
    FROM documents WHERE length(text) >= 250),
  d AS (SELECT id, medio, titulo, url, titulo || ' ' || text AS body,
        (regexp_matches(' ' || {NORM.format("titulo || ' ' || text")} || ' ', '[^a-z0-9_](tion|der|les|ciones)[^a-z0-9_]'))::INT AS rel FROM art),
  {PAIRS},
  e AS (SELECT a, b FROM sim JOIN d x ON x.id = a JOIN d y ON y.id = b WHERE x.medio <> y.medio),
  arcs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
  walk(id, root) AS (SELECT a, a FROM arcs UNION SELECT arcs.b, walk.root FROM walk JOIN arcs ON arcs.a = walk.id),
  comp AS (SELECT id, min(root) AS root FROM walk GROUP BY id),
  g AS (SELECT root, count(*) AS size, list_sort(list(DISTINCT medio)) AS outlets FROM comp JOIN d USING (id) GROUP BY root HAVING count(DISTINCT medio) >= 2),
  named AS (SELECT root, outlets, printf('REC_%04d', row_number() OVER (ORDER BY size DESC, root)) AS rec FROM g)
  SELECT d.id AS _seq, medio, titulo, url, NULL::VARCHAR AS fecha_iso, rel AS ind_relevante,
         CASE WHEN rec IS NULL THEN 'No' ELSE 'Sí' END AS recurrencia, coalesce(rec, '') AS id_recurrencia,
         coalesce(len(outlets), 1)::INT AS nro_medios, coalesce(array_to_string(outlets, ', '), medio) AS medios
  FROM d LEFT JOIN comp USING (id) LEFT JOIN named USING (root)"""


@query(NEWS)
def news_daily(spark, sf):
    return news.news_daily(dealt(spark, sf, "documents"))


@query(NEWS.replace("SELECT d.id AS _seq, medio, titulo, url, NULL::VARCHAR AS fecha_iso, rel", "SELECT row_number() OVER (ORDER BY medio, d.id) AS lugar, d.id AS _seq, medio, titulo, url, NULL::VARCHAR AS fecha_iso, rel")
       + " UNION ALL SELECT NULL, NULL, m, NULL, NULL, NULL, NULL, 'sin noticias', NULL, NULL, NULL FROM (VALUES ('src1'), ('src 99')) x(m) WHERE m NOT IN (SELECT medio FROM d)")
def txt_recurrence(spark, sf):
    """The daily report by outlet, each row with its place, and the expected outlets without news."""
    kept = news.news_daily(dealt(spark, sf, "documents"), order="medio")
    placed = similarity.numbered(kept, ["medio", "fecha_iso", "_seq"], "lugar")
    expected = spark.createDataFrame([("src1",), ("src 99",)], "medio string")
    missing = similarity.missing_outlets(kept, expected).withColumn("recurrencia", F.lit("sin noticias"))
    return placed.unionByName(missing, allowMissingColumns=True)


@query("SELECT l_orderkey, to_json(list({'id': l_linenumber, 'texto': l_returnflag} ORDER BY l_linenumber, l_returnflag)) AS lote FROM lineitem GROUP BY l_orderkey")
def agg_batch_prompt(spark, sf):
    piece = F.struct(F.col("l_linenumber").alias("id"), F.col("l_returnflag").alias("texto"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.to_json(F.array_sort(F.collect_list(piece))).alias("lote"))


@query("""SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'cancelled' WHEN bool_or(o_orderstatus = 'F' AND o_orderpriority LIKE '1%') THEN 'error'
          WHEN bool_or(o_orderstatus = 'F') THEN 'partial' ELSE 'ok' END AS estado FROM orders GROUP BY o_custkey""")
def agg_run_status(spark, sf):
    status = F.when(F.col("o_orderstatus") == "P", "cancelled").when(F.col("o_orderstatus") == "F", "error").otherwise("ok")
    on_error = F.when(F.col("o_orderpriority").startswith("1"), "stop").otherwise("continue")
    return history.run_status(table(spark, sf, "orders").select("o_custkey", status.alias("status"), on_error.alias("on_error")), "o_custkey")


@query("SELECT o_custkey, count(*) FILTER (o_orderstatus IN ('O', 'P')) AS activos FROM orders GROUP BY o_custkey")
def agg_active_count(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("activos"))


# ---------------------------------------------------------------- joins and sets


@query("SELECT c_custkey, o_orderkey, o_orderstatus FROM customer LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS p FROM orders) o ON o_custkey = c_custkey AND p = 1")
def join_last_run(spark, sf):
    runs = table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderstatus", "o_orderdate")
    newest = history.last_run(table(spark, sf, "customer").select("c_custkey"), runs, "c_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")])
    return newest.select("c_custkey", "o_orderkey", "o_orderstatus")


@query("SELECT s_suppkey, coalesce(n_name, '') AS nombre FROM supplier LEFT JOIN nation ON n_nationkey = s_nationkey")
def join_user_labels(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    met = table(spark, sf, "supplier").join(names, "s_nationkey", "left")  # the engine broadcasts it if its size allows
    return met.select("s_suppkey", F.coalesce("n_name", F.lit("")).alias("nombre"))


@query(f"""WITH l(linea) AS (SELECT n_name FROM nation UNION SELECT substr(n_name, 1, 7) FROM nation UNION SELECT '7' UNION SELECT 'nadie'),
   m AS (SELECT linea, n_nationkey::VARCHAR AS id, n_name AS nombre, {NORM.format('n_name')} AS nn, {NORM.format('linea')} AS nl FROM l, nation),
   h AS (SELECT *, regexp_matches(nl, '^[0-9]+$') OR nn = nl AS ex FROM m WHERE CASE WHEN regexp_matches(nl, '^[0-9]+$') THEN id = nl ELSE contains(nn, nl) END)
   SELECT linea, id, nombre FROM h QUALIFY ex = max(ex) OVER (PARTITION BY linea)""")
def join_name_match(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_name").alias("linea"))
    lines = names.union(names.select(F.substring("linea", 1, 7))).union(names.select(F.lit("7"))).union(names.select(F.lit("nadie"))).distinct()
    return catalog.name_match(lines, table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("nombre")))[0]


@query("SELECT s_suppkey, y::INT AS anio FROM supplier, range(2021, 2026) t(y)")
def join_entity_year(spark, sf):
    return catalog.entity_years(table(spark, sf, "supplier").select("s_suppkey"), 2021, 2025)


@query("SELECT DISTINCT o_custkey, year(o_orderdate)::INT AS anio, CASE WHEN o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) THEN 'ya existía' ELSE 'nuevo' END AS estado FROM orders")
def join_existing_files(spark, sf):
    wanted = table(spark, sf, "orders").select("o_custkey", F.year("o_orderdate").alias("anio")).distinct()
    present = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return catalog.existing_status(wanted, present, ["o_custkey"])


@query("SELECT page_id FROM pages ANTI JOIN documents ON page_id = doc_id AND length(text) >= 1000")
def join_seen_anti(spark, sf):
    seen = table(spark, sf, "documents").where("length(text) >= 1000").select(F.col("doc_id").alias("page_id"))
    return table(spark, sf, "pages").select("page_id").join(seen, "page_id", "left_anti")


@query("SELECT n_name AS medio FROM nation ANTI JOIN (SELECT n_name FROM nation JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000) USING (n_name)")
def join_expected_missing(spark, sf):
    nations = table(spark, sf, "nation")
    rich = table(spark, sf, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("n_nationkey"))
    return similarity.missing_outlets(nations.join(rich, "n_nationkey").select(F.col("n_name").alias("medio")), nations.select(F.col("n_name").alias("medio")))


@query("SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'pending' WHEN l.quality = 1 THEN 'enabled' ELSE 'changed' END AS estado FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_approved_hash(spark, sf):
    current = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("huella"))
    stored = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("huella"))
    return rows.changed_status(current, stored, "doc_id", "huella").select("doc_id", "estado")


@query("SELECT d.doc_id, coalesce(l.quality = 1 AND l.toxic = 0, false) AS reusado FROM documents d LEFT JOIN labels l USING (doc_id)")
def join_cache_reuse(spark, sf):
    current = table(spark, sf, "documents").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    return docs.reuse_cache(current, table(spark, sf, "labels"), "doc_id", ["quality", "toxic"]).select("doc_id", "reusado")


@query("SELECT doc_id AS id FROM documents UNION SELECT page_id FROM pages UNION SELECT item_id FROM benchmark")
def set_union_distinct(spark, sf):
    d, p, b = (table(spark, sf, t).select(F.col(c).alias("id")) for t, c in (("documents", "doc_id"), ("pages", "page_id"), ("benchmark", "item_id")))
    return d.union(p).union(b).distinct()


@query("SELECT doc_id AS id, lang, NULL::VARCHAR AS url FROM documents UNION ALL SELECT page_id, NULL, url FROM pages")
def set_union_all(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return rows.union_rows(d, table(spark, sf, "pages").select(F.col("page_id").alias("id"), "url"))


@query(r"""SELECT page_id, CASE WHEN row_number() OVER (PARTITION BY regexp_replace(regexp_replace(lower(url), '^https?://(www\.)?', ''), '/+$', '') ORDER BY page_id) = 1
           THEN 'queda' ELSE 'duplicado' END AS motivo FROM pages""")
def set_dedupe_links(spark, sf):
    kept, lost = rows.first_per_key(table(spark, sf, "pages").select("page_id", "url"), U.url_key(F.col("url")), ["page_id"])
    return kept.select("page_id", F.lit("queda").alias("motivo")).union(lost.select("page_id", F.lit("duplicado")))


@query("SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def set_except(spark, sf):
    return table(spark, sf, "documents").select("doc_id").subtract(table(spark, sf, "labels").select("doc_id"))


# ---------------------------------------------------------------- windows, sorts, top-k


@query("SELECT page_id, url FROM pages QUALIFY row_number() OVER (PARTITION BY regexp_replace(split_part(trim(url), '#', 1), '/+$', '') ORDER BY page_id) = 1")
def win_first_per_key(spark, sf):
    return rows.first_per_key(table(spark, sf, "pages").select("page_id", "url"), U.news_key(F.col("url")), ["page_id"])[0]


@query("""SELECT conv_id, turn, substr(concat_ws(' ', lead(text, 1) OVER w, lead(text, 2) OVER w), 1, 200) AS contexto, lag(text) OVER w AS anterior
          FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def win_context_lines(spark, sf):
    w = Window.partitionBy("conv_id").orderBy("turn")
    after = F.substring(F.concat_ws(" ", F.lead("text", 1).over(w), F.lead("text", 2).over(w)), 1, 200)
    return table(spark, sf, "conversations").select("conv_id", "turn", after.alias("contexto"), F.lag("text").over(w).alias("anterior"))


@query("SELECT user_id, event_id, event_type FROM events QUALIFY lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS DISTINCT FROM event_type")
def win_consecutive_dedupe(spark, sf):
    return rows.neighbours_differ(table(spark, sf, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type")


@query("SELECT l_orderkey, l_linenumber, ((row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) - 1) // 3)::BIGINT AS lote FROM lineitem")
def win_batch_no(spark, sf):
    return rows.batches(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), ["l_linenumber"], 3, ["l_orderkey"])


@query("SELECT o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) > 5")
def win_keep_newest(spark, sf):
    return history.beyond_newest(table(spark, sf, "orders"), "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")], 5).select("o_orderkey")


@query("""WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS us, (event_type = 'error')::INT AS bad,
     sum((event_type <> 'error')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS ses FROM events)
   SELECT event_id, (sum(bad) OVER (PARTITION BY user_id, ses ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW))::BIGINT AS fallos,
     sum(bad) OVER (PARTITION BY user_id, ses ORDER BY us RANGE BETWEEN 299999999 PRECEDING AND CURRENT ROW) >= 2 AS bloqueado FROM s""")
def win_failure_lock(spark, sf):
    locked = history.locked_out(table(spark, sf, "events"), ["user_id"], "ts", "event_id", F.col("event_type") == "error", most=2)
    return locked.select("event_id", "fallos", "bloqueado")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 43200000000 THEN 1 ELSE 0 END AS f FROM events),
   s AS (SELECT user_id, ts, (sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING))::BIGINT AS sesion FROM g)
   SELECT user_id, sesion, count(*) AS eventos, max(epoch_us(ts)) - min(epoch_us(ts)) <= 1209600000000 AS vigente FROM s GROUP BY user_id, sesion""")
def str_session_idle(spark, sf):
    return history.idle_sessions(table(spark, sf, "events"), ["user_id"], "ts", 12 * 3600, 14 * 86400)


@query("SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 30")
def topk_recent_runs(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(30)


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) ORDER BY quality NULLS LAST, doc_id")
def sort_nulls_last(spark, sf):
    met = table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return met.orderBy(F.asc_nulls_last("quality"), "doc_id")


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 7")
def limit_rows(spark, sf):
    """The first seven articles of each outlet, which is what the operator is for."""
    w = Window.partitionBy("source").orderBy("doc_id")
    return table(spark, sf, "documents").select("doc_id", F.row_number().over(w).alias("p")).where("p <= 7").select("doc_id")


# ---------------------------------------------------------------- documents as pages


PLAIN = r"lower(strip_accents(linea))"
FOUND = {t: r"(^|[^a-z0-9])" + r"\s+".join(w + "(?:es|s)?" for w in t.split()) + r"($|[^a-z0-9])" for t in SEARCHED}


@query(
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS linea FROM documents) "
    + " UNION ALL ".join(f"SELECT DISTINCT doc_id, '{t}' AS termino FROM l WHERE regexp_matches({PLAIN}, '{p}')" for t, p in FOUND.items())
)
def txt_term_search(spark, sf):
    return docs.term_hits(doc_pages(spark, sf), SEARCHED, ["doc_id", "page"]).select("doc_id", "termino").distinct()


@query(
    "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page, unnest(string_split(text, chr(10))) AS linea FROM documents) "
    + " UNION ALL ".join(
        f"SELECT doc_id, '{t}' AS termino, sum(len(regexp_extract_all({PLAIN}, '{p}')))::BIGINT AS n, list(page::INT ORDER BY page) AS paginas FROM l WHERE regexp_matches({PLAIN}, '{p}') GROUP BY doc_id"
        for t, p in FOUND.items()
    )
)
def agg_term_hits(spark, sf):
    hits = docs.term_hits(doc_pages(spark, sf), SEARCHED, ["doc_id", "page"])
    return hits.groupBy("doc_id", "termino").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list("page")).alias("paginas"))


@query(
    "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page, unnest(string_split(text, chr(10))) AS linea FROM documents), f AS (SELECT *, "
    + PLAIN + " AS plano FROM l) "
    + " UNION ALL ".join(
        f"""SELECT doc_id, page::INT AS page, '{t}' AS termino, trim(regexp_replace(substr(linea, greatest(a - 90, 1), least(a - 1, 90) + b + 90), '\\s+', ' ', 'g')) AS contexto
            FROM (SELECT *, 1 + length(regexp_extract(plano, '^(.*?(?:^|[^a-z0-9])){p[13:-13]}($|[^a-z0-9])', 1)) AS a,
                  length(regexp_extract(plano, '^(.*?(?:^|[^a-z0-9]))({p[13:-13]})($|[^a-z0-9])', 2)) AS b FROM f WHERE regexp_matches(plano, '{p}'))"""
        for t, p in FOUND.items()
    )
)
def txt_term_contexts(spark, sf):
    """What surrounds the first hit on each page."""
    hits = docs.term_hits(doc_pages(spark, sf), SEARCHED, ["doc_id", "page"])
    return hits.select("doc_id", "page", "termino", F.col("contextos")[0].alias("contexto"))


@query(r"""WITH terms AS (
      SELECT DISTINCT w[1] AS w1, w[2] AS w2 FROM (SELECT regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+') AS w FROM benchmark) WHERE len(w) >= 2 AND left(w[1], 3) <> left(w[2], 3)
    ),
    p AS (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[a-z0-9]+|[^a-z0-9]+') AS parts FROM documents),
    pairs AS (SELECT doc_id, parts[i] AS a, parts[i + 2] AS b FROM p, range(1, len(parts) - 1) r(i) WHERE regexp_full_match(parts[i], '[a-z0-9]+') AND regexp_full_match(parts[i + 1], '\s+'))
    SELECT doc_id, w1 || ' ' || w2 AS termino, count(*) AS n FROM pairs JOIN terms ON (a = w1 OR a = w1 || 's' OR a = w1 || 'es') AND (b = w2 OR b = w2 || 's' OR b = w2 || 'es') GROUP BY ALL""")
def txt_term_dictionary(spark, sf):
    """The first two words of each passage of the benchmark in all documents, as whole pages."""
    words = F.regexp_extract_all(T.fold_1to1(F.col("text")), F.lit("[a-z0-9]+"), F.lit(0))
    pairs = table(spark, sf, "benchmark").select(words.alias("w")).where("size(w) >= 2 AND left(w[0], 3) <> left(w[1], 3)")
    # a dictionary of users' terms is theirs to bound
    terms = sorted(r[0] for r in pairs.select(F.concat_ws(" ", F.col("w")[0], F.col("w")[1])).distinct().collect())
    return docs.term_hits(dealt(spark, sf, "documents"), terms, ["doc_id"]).select("doc_id", "termino", "n")


def doc_pages(spark, sf):
    """The lines of a document stand for its pages."""
    return dealt(spark, sf, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("page", "text"))


@query(
    "WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page, unnest(string_split(text, chr(10))) AS linea FROM documents), f AS (SELECT *, "
    + PLAIN + " AS plano FROM l), h AS ("
    + " UNION ALL ".join(
        f"""SELECT doc_id, page, {i} AS orden, '{t}' AS termino, linea, regexp_extract_all(plano, '.*?{p}') AS trozos, '^(.*?(?:^|[^a-z0-9]))({p[13:-13]})(?:$|[^a-z0-9])$' AS forma
            FROM f WHERE regexp_matches(plano, '{p}')"""
        for i, (t, p) in enumerate(FOUND.items())
    )
    + r"""), v AS (SELECT doc_id, page, termino, linea, i, coalesce(list_sum(list_transform(trozos[:i - 1], lambda x: length(x))), 0) + length(regexp_extract(trozos[i], forma, 1)) + 1 AS a,
            length(regexp_extract(trozos[i], forma, 2)) AS b FROM h, range(1, 3) r(i) WHERE i <= len(trozos)),
    c AS (SELECT doc_id, termino, list(trim(regexp_replace(substr(linea, greatest(a - 90, 1)::BIGINT, (least(a - 1, 90) + b + 90)::BIGINT), '\s+', ' ', 'g')) ORDER BY page, i) AS vistas
          FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, termino ORDER BY page, i) AS nth FROM v) WHERE nth <= 2 GROUP BY doc_id, termino),
    t AS (SELECT doc_id, termino, orden, sum(len(trozos)) AS n, min(page) AS primera FROM h GROUP BY ALL),
    w AS (SELECT doc_id, string_agg(termino || ' (' || n || ')', '; ' ORDER BY primera, orden) AS palabras, left(string_agg(array_to_string(vistas, ' | '), ' | ' ORDER BY primera, orden), 600) AS contextos, sum(n)::BIGINT AS total
          FROM t JOIN c USING (doc_id, termino) GROUP BY doc_id),
    q AS (SELECT doc_id, string_agg(page, ', ' ORDER BY page) AS paginas FROM (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id ORDER BY page) AS nth FROM (SELECT DISTINCT doc_id, page FROM h)) WHERE nth <= 40 GROUP BY doc_id)
    SELECT doc_id, palabras, contextos, total, q.paginas FROM w JOIN q USING (doc_id)"""
)
def agg_doc_rollup(spark, sf):
    return docs.doc_rollup(docs.term_hits(doc_pages(spark, sf), SEARCHED, ["doc_id", "page"]), "doc_id", "page")


@query(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS linea FROM documents)
           SELECT doc_id, CASE WHEN bool_or(length(regexp_replace(linea, '\s', '', 'g')) >= 25) THEN 'texto' ELSE 'escaneado' END AS tipo FROM l GROUP BY doc_id""")
def pred_doc_kind(spark, sf):
    return docs.doc_kinds(doc_pages(spark, sf), "doc_id")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity >= 25 THEN 'texto' WHEN l_linenumber >= 3 THEN 'vectorial' WHEN l_returnflag = 'R' THEN 'escaneada'
          ELSE 'vacia' END AS clase FROM lineitem""")
def pred_page_kind(spark, sf):
    kind = docs.page_kind(F.col("l_quantity"), F.col("l_linenumber") * 10, F.col("l_returnflag") == "R")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", kind.alias("clase"))


@query("""WITH d AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
          SELECT doc_id, length(replace(t, ' ', '')) AS letras, true AS completo, true AS cortos FROM d""")
def txt_chunk(spark, sf):
    """As many pieces as a text needs; together they hold all its letters."""
    plain = F.trim(F.regexp_replace("text", "\\s+", " "))
    cut = table(spark, sf, "documents").select("doc_id", plain.alias("t")).withColumn("c", docs.chunks("t", None, 3000))
    letters = F.length(F.replace(F.array_join("c.trozos", ""), F.lit(" "), F.lit("")))
    return cut.select("doc_id", letters.alias("letras"), F.col("c.completo").alias("completo"), F.forall("c.trozos", lambda x: F.length(x) <= 3000).alias("cortos"))


@query(r"""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS page, unnest(string_split(text, chr(10))) AS linea FROM documents)
   SELECT doc_id, string_agg('[p. ' || page || '] ' || trim(regexp_replace(regexp_replace(replace(linea, '­', ''), '[\x00-\x08\x0b-\x1f\x7f]', ' ', 'g'), '\s+', ' ', 'g')), chr(10) ORDER BY page) AS texto FROM l GROUP BY doc_id""")
def sink_doc_text(spark, sf):
    return docs.doc_text(doc_pages(spark, sf), "doc_id", "page")


# ---------------------------------------------------------------- graphs and histories


@query("""WITH RECURSIVE e AS (SELECT p_partkey AS node, p_partkey // 2 AS source FROM part WHERE p_partkey >= 2),
   a(node, ancestor) AS (SELECT node, source FROM e UNION SELECT a.node, e.source FROM a JOIN e ON e.node = a.ancestor) SELECT node, ancestor FROM a""")
def dag_ancestors(spark, sf):
    return graph.ancestors(part_tree(spark, sf))


def part_tree(spark, sf):
    return table(spark, sf, "part").where("p_partkey >= 2").select(F.expr("p_partkey div 2").alias("source"), F.col("p_partkey").alias("target"))


@query("SELECT p_partkey AS node, floor(log2(p_partkey) + 1e-9)::INT AS level FROM part WHERE p_partkey >= 1 AND (SELECT count(*) FROM part) > 1")
def dag_levels(spark, sf):
    return graph.levels(part_tree(spark, sf))[0]


CYCLIC = """(SELECT p_partkey AS source, (p_partkey * p_partkey + p_size) % 397 AS target FROM part UNION SELECT p_partkey, p_partkey * 2 FROM part WHERE p_partkey * 2 IN (SELECT p_partkey FROM part))"""


def part_maze(spark, sf):
    """Parts that lead to another by a rule with cycles, and to their doubles."""
    part = table(spark, sf, "part")
    doubles = part.select(F.col("p_partkey").alias("source"), (F.col("p_partkey") * 2).alias("target")).join(part.select(F.col("p_partkey").alias("target")), "target", "left_semi")
    return part.select(F.col("p_partkey").alias("source"), F.expr("(p_partkey * p_partkey + p_size) % 397").alias("target")).union(doubles.select("source", "target")).distinct()


@query(f"""WITH RECURSIVE e AS {CYCLIC}, up(node, ancestor) AS (SELECT target, source FROM e UNION SELECT up.node, e.source FROM up JOIN e ON e.target = up.ancestor),
   loops AS (SELECT DISTINCT node FROM up WHERE node = ancestor) SELECT node FROM loops UNION SELECT up.node FROM up JOIN loops ON loops.node = up.ancestor""")
def dag_cycle(spark, sf):
    """Parts on or behind a cycle."""
    return graph.levels(part_maze(spark, sf))[1]


@query("""WITH RECURSIVE e AS (SELECT l_orderkey AS a, l_partkey + 100000000 AS b FROM lineitem WHERE l_partkey % 7 = 0 AND l_quantity < 9),
   arcs AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
   walk(node, root) AS (SELECT a, a FROM arcs UNION SELECT arcs.b, walk.root FROM walk JOIN arcs ON arcs.a = walk.node WHERE walk.root < arcs.b)
   SELECT node, min(root) AS root FROM walk GROUP BY node""")
def txt_components(spark, sf):
    """Orders that share a part of some kinds, by way of others."""
    lines = table(spark, sf, "lineitem").where("l_partkey % 7 = 0 AND l_quantity < 9")
    return graph.components(lines.select(F.col("l_orderkey").alias("a"), (F.col("l_partkey") + 100000000).alias("b")))


@query("SELECT p_partkey AS node, floor(log2(p_partkey) + 1e-9)::INT AS depth FROM part WHERE p_partkey BETWEEN 1 AND 15")
def crawl_bfs(spark, sf):
    """What a walk of three links from the first part reaches."""
    tree = part_tree(spark, sf)
    return graph.reach(tree, tree.select(F.min("source").alias("node")), 3)


@query("""WITH RECURSIVE e AS (SELECT l_suppkey % 10 AS site, l_suppkey AS source, l_partkey AS target FROM lineitem WHERE l_suppkey % 10 = l_partkey % 10 UNION SELECT l_suppkey % 10, l_partkey, l_suppkey FROM lineitem WHERE l_suppkey % 10 = l_partkey % 10),
   s AS (SELECT site, min(source) AS node FROM e GROUP BY site),
   w(site, node, depth) AS (SELECT site, node, 0 FROM s UNION SELECT w.site, e.target, w.depth + 1 FROM w JOIN e ON e.site = w.site AND e.source = w.node WHERE w.depth < 3)
   SELECT site, node, min(depth)::INT AS depth FROM w GROUP BY site, node QUALIFY row_number() OVER (PARTITION BY site ORDER BY min(depth), node) <= 40""")
def crawl_sites(spark, sf):
    """Ten sites, whose pages are the keys that end alike and whose links, both ways, are order lines; there are cycles."""
    own = table(spark, sf, "lineitem").select((F.col("l_suppkey") % 10).alias("site"), F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    own = own.where("target % 10 = site")
    links = own.union(own.select("site", "target", "source")).distinct()
    return graph.crawled(links, links.groupBy("site").agg(F.min("source").alias("node")), "site", 3, 40)


@query("""WITH RECURSIVE l AS (SELECT l_suppkey AS sup, l_partkey AS par, (2 + sum(l_linenumber) % 5 * 4)::DOUBLE AS puntaje, min(l_orderkey) AS pos FROM lineitem WHERE l_suppkey % 10 = l_partkey % 10 GROUP BY 1, 2),
   e AS (SELECT sup % 10 AS site, sup AS source, par AS target, puntaje, pos FROM l UNION ALL SELECT sup % 10, par, sup, 22 - puntaje, pos FROM l),
   pages AS (SELECT site, source, min_by(struct_pack(n := -puntaje, o := pos), (pos, -puntaje)) AS x, target FROM e GROUP BY site, source, target),
   outs AS (SELECT site, source, list(struct_pack(o := x.o, t := target, n := x.n) ORDER BY x.o, target) AS links FROM pages GROUP BY site, source),
   w AS (SELECT site, 0 AS visita, NULL::BIGINT AS node, 0 AS profundidad, 0::DOUBLE AS puntaje, [struct_pack(n := -100::DOUBLE, d := 0, via := 0, o := 0::BIGINT, t := min(source)::BIGINT)] AS heap, [min(source)::BIGINT] AS queued FROM e GROUP BY site
     UNION ALL SELECT site, visita + 1, heap[1].t, heap[1].d, -heap[1].n,
       list_sort(list_concat(heap[2:], list_transform(fresh, lambda x: struct_pack(n := x.n, d := heap[1].d + 1, via := visita + 1, o := x.o, t := x.t)))), list_concat(queued, list_transform(fresh, lambda x: x.t))
       FROM (SELECT w.*, CASE WHEN w.heap[1].d < 3 THEN list_filter(outs.links, lambda x: NOT list_contains(w.queued, x.t)) ELSE [] END AS fresh FROM w LEFT JOIN outs ON outs.site = w.site AND outs.source = w.heap[1].t WHERE w.visita < 40 AND len(w.heap) > 0))
   SELECT site, node, visita::INT AS visita, profundidad::INT AS profundidad, puntaje FROM w WHERE visita > 0""")
def crawl_best_first(spark, sf):
    """The sites of ``crawl_sites``, walked by the scores of their links; the SQL pops one page of each site at a time."""
    own = table(spark, sf, "lineitem").where("l_suppkey % 10 = l_partkey % 10").groupBy("l_suppkey", "l_partkey")
    own = own.agg((F.sum("l_linenumber") % 5 * 4 + 2).cast("double").alias("puntaje"), F.min("l_orderkey").alias("pos"))
    site = (F.col("l_suppkey") % 10).alias("site")
    links = own.select(site, F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), "puntaje", "pos")
    links = links.union(own.select(site, "l_partkey", "l_suppkey", (22 - F.col("puntaje")).alias("puntaje"), "pos"))
    starts = links.groupBy("site").agg(F.min("source").alias("node")).select("site", "node", F.lit(100).alias("puntaje"), F.lit(0).alias("profundidad"), F.lit(0).alias("pos"))
    return crawl.best_first(links, starts, "site")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 90 DAYS")
def run_retention(spark, sf):
    o = table(spark, sf, "orders")
    newest = o.agg(F.max("o_orderdate").alias("newest"))
    return o.join(F.broadcast(newest)).where(F.col("o_orderdate") >= F.col("newest") - F.expr("INTERVAL 90 DAYS")).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('O', 'P') THEN 'error' ELSE 'ok' END AS estado FROM orders")
def run_mark_interrupted(spark, sf):
    status = F.when(F.col("o_orderstatus") == "O", "running").when(F.col("o_orderstatus") == "P", "queued").otherwise("ok")
    return table(spark, sf, "orders").select("o_orderkey", history.interrupted(status).alias("estado"))


@query("""WITH r AS (SELECT o_orderkey, o_custkey, o_orderdate AS s, o_orderdate + INTERVAL 30 DAYS AS f FROM orders)
   SELECT o_orderkey FROM r QUALIFY s < max(f) OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def run_overlap(spark, sf):
    runs = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")).alias("f"))
    return history.overlaps(runs, "o_custkey", "s", "f", "o_orderkey").select("o_orderkey")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def run_upsert(spark, sf):
    return rows.latest_per_key(table(spark, sf, "events"), ["user_id", "event_type"], [F.desc("ts"), F.desc("event_id")]).select("user_id", "event_id", "event_type")


@query("SELECT doc_id, CASE WHEN strlen(text) > 2000 THEN '{\"truncado\":true,\"bytes\":' || strlen(text) || '}' ELSE text END AS resultado FROM documents")
def run_result_cap(spark, sf):
    return table(spark, sf, "documents").select("doc_id", history.capped_result(F.col("text"), 2000).alias("resultado"))


@query("""SELECT o_orderkey, min(t) AS proxima FROM (SELECT o_orderkey, o_orderdate AS d, date_trunc('day', o_orderdate)::TIMESTAMP + to_days(i::INT) + INTERVAL 450 MINUTES AS t
          FROM orders, range(9) r(i)) WHERE t > d AND isodow(t) <= 5 GROUP BY o_orderkey""")
def sched_next_fire(spark, sf):
    after = F.col("o_orderdate").cast("timestamp_ntz")
    return table(spark, sf, "orders").select("o_orderkey", history.next_fire(after.cast("timestamp"), 7, 30, [0, 1, 2, 3, 4]).cast("timestamp_ntz").alias("proxima"))


# ---------------------------------------------------------------- pages


@query(r"""SELECT page_id, (generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) - 1)::INT AS pos,
   unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS href, unnest(regexp_extract_all(html, '<a href="[^"]*">([^<]*)</a>', 1)) AS texto FROM pages""")
def page_links(spark, sf):
    return html.page_links(table(spark, sf, "pages"))


# The pages have one article: a heading, then paragraphs; one that begins with <b> is not closed, so it holds all that follow it.
PAGE_PARTS = r"""
    plain AS (
      SELECT page_id, html, regexp_replace(replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '&quot;', '"'), '&amp;?', '&', 'g') AS title,
             regexp_extract_all(regexp_extract(html, '<article>(.*)</article>', 1, 's'), '<p>(?:<b>)?[^<]*<') AS parts,
             trim(regexp_replace(regexp_replace(replace(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS ad
      FROM pages
    ),
    items AS (
      SELECT page_id, i, parts[i] LIKE '<p><b>%' AS opened,
             trim(regexp_replace(regexp_replace(replace(regexp_extract(parts[i], '>([^<>]*)<$', 1), '&quot;', '"'), '&amp;?', '&', 'g'), '\s+', ' ', 'g')) AS own
      FROM plain, range(1, len(parts) + 1) r(i)
    ),
    paragraphs AS (
      SELECT page_id, i, CASE WHEN opened THEN string_agg(nullif(own, ''), ' ') OVER (PARTITION BY page_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) ELSE own END AS text
      FROM items
    ),
    {kept}
"""
#: Paragraphs of at least so many letters that are no asides and differ from the one before.
KEPT = """{name} AS (
      SELECT page_id, i, text FROM (SELECT *, lag(text) OVER (PARTITION BY page_id ORDER BY i) AS before FROM (SELECT * FROM {source} WHERE length(text) >= {least}
        AND NOT regexp_matches(lower(strip_accents(text)), '""" + ASIDE_TEXT.removeprefix("(?i)") + """')))
      WHERE before IS NULL OR before <> text
    )"""


@query(
    "WITH" + PAGE_PARTS.format(kept=KEPT.format(name="strict", source="paragraphs", least=40) + "," + KEPT.format(
        name="loose", source="(SELECT * FROM paragraphs UNION ALL SELECT page_id, 0, ad FROM plain WHERE length(ad) >= 60)", least=30)) + r"""
    , main AS (SELECT page_id, string_agg(text, chr(10) ORDER BY i) AS text, sum(length(text)) AS letters FROM strict GROUP BY page_id),
    rest AS (SELECT page_id, string_agg(text, chr(10) ORDER BY i) AS text FROM loose GROUP BY page_id)
    SELECT page_id, CASE WHEN length(title) > 40 THEN trim(regexp_split_to_array(title, '\s[|\-–—]\s')[1]) ELSE title END AS titulo,
           CASE WHEN letters > 250 THEN main.text ELSE coalesce(rest.text, '') END AS texto,
           CASE WHEN letters > 250 THEN 'article' WHEN rest.text IS NOT NULL THEN 'todos_los_p' ELSE 'vacio' END AS estrategia, '' AS fecha
    FROM (SELECT page_id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS title FROM plain) LEFT JOIN main USING (page_id) LEFT JOIN rest USING (page_id)"""
)
def page_article(spark, sf):
    return html.page_articles(dealt(spark, sf, "pages"))


@query(
    "WITH" + PAGE_PARTS.format(kept=KEPT.format(name="strict", source="(SELECT * FROM paragraphs UNION ALL SELECT page_id, 0, ad FROM plain WHERE length(ad) >= 60)", least=40)) + r"""
    SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INTEGER AS pos, text AS parrafo FROM strict"""
)
def page_paragraphs(spark, sf):
    return html.page_paragraphs(dealt(spark, sf, "pages"))


@query(
    r"""WITH lines AS (
      SELECT doc_id AS page_id, i, trim(regexp_replace(split_part(text, chr(10), i::INTEGER), '\s+', ' ', 'g')) AS text
      FROM documents, range(1, length(text) - length(replace(text, chr(10), '')) + 2) r(i)
    ),
    telling AS (SELECT page_id, count(*) AS n FROM lines WHERE length(text) >= 60 AND NOT regexp_matches(lower(strip_accents(text)), '""" + ASIDE_TEXT.removeprefix("(?i)") + r"""') GROUP BY page_id),
    """ + KEPT.format(name="strict", source="lines", least=40) + "," + KEPT.format(name="loose", source="lines", least=30) + r""",
    main AS (SELECT page_id, string_agg(text, chr(10) ORDER BY i) AS text, sum(length(text)) AS letters FROM strict GROUP BY page_id),
    rest AS (SELECT page_id, string_agg(text, chr(10) ORDER BY i) AS text FROM loose GROUP BY page_id),
    chosen AS (
      SELECT d.doc_id, main.text AS main, rest.text AS rest, trim(regexp_replace(d.text, '\s+', ' ', 'g')) AS whole,
             CASE WHEN d.doc_id % 5 = 4 THEN CASE WHEN length(d.text) > 200 THEN 'json_ld' END
                  WHEN letters > 250 THEN CASE d.doc_id % 5 WHEN 0 THEN 'pista_de_cuerpo' WHEN 1 THEN 'article' WHEN 2 THEN 'main' WHEN 3 THEN CASE WHEN telling.n > 0 THEN 'contenedor_denso' END END END AS way
      FROM documents d LEFT JOIN main ON main.page_id = d.doc_id LEFT JOIN rest ON rest.page_id = d.doc_id LEFT JOIN telling ON telling.page_id = d.doc_id
    )
    SELECT doc_id, coalesce(way, CASE WHEN doc_id % 5 <> 4 AND rest IS NOT NULL THEN 'todos_los_p' ELSE 'vacio' END) AS estrategia,
           CASE WHEN way = 'json_ld' THEN whole WHEN way IS NOT NULL THEN main WHEN doc_id % 5 = 4 THEN '' ELSE coalesce(rest, '') END AS texto
    FROM chosen"""
)
def page_article_ways(spark, sf):
    """Each document as a page, in one of five forms that the five ways to the main text are for."""
    d = dealt(spark, sf, "documents")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", "&", "&amp;"), "<", "&lt;"), ">", "&gt;")
    body = F.concat(F.lit("<p>"), F.regexp_replace(marked, "\n", "</p>\n<p>"), F.lit("</p>"))
    aside = f"<div class='related'><p>{'Another story that is no part of this one. ' * 3}</p></div>"
    ld = F.concat(F.lit('{"@graph": [{"name": "x"}, '), F.to_json(F.struct(F.col("text").alias("articleBody"))), F.lit("]}"))
    form = [
        F.concat(F.lit("<div><div class='post entry-content'>"), body, F.lit(aside + "</div></div>")),
        F.concat(F.lit("<main><article>"), body, F.lit(aside + "</article></main>")),
        F.concat(F.lit(aside + "<main><div>"), body, F.lit("</div></main>")),
        F.concat(F.lit("<nav><p>No text.</p></nav><section><div>"), body, F.lit("</div></section>")),
        F.concat(F.lit('<script type="application/ld+json">'), ld, F.lit("</script>")),
    ]
    pages = d.select(F.col("doc_id").alias("page_id"), F.element_at(F.array(*form), F.expr("cast(doc_id % 5 + 1 AS INT)")).alias("html"))
    return html.page_articles(pages).select(F.col("page_id").alias("doc_id"), "estrategia", "texto")


@query()
def page_heading_ffill(spark, sf):
    return html.page_lines(table(spark, sf, "pages"))


@query(r"""SELECT page_id, (generate_subscripts(regexp_extract_all(html, '<a href="([^"]*)">', 1), 1) - 1)::INT AS pos,
   regexp_extract(url, '^(https?://[^/]+)', 1) || unnest(regexp_extract_all(html, '<a href="([^"]*)">', 1)) AS enlace FROM pages""")
def lnk_resolve(spark, sf):
    pages = table(spark, sf, "pages")
    links = html.page_links(pages).join(pages.select("page_id", "url"), "page_id")
    return links.select("page_id", "pos", U.resolved(F.col("url"), F.col("href")).alias("enlace"))


# ---------------------------------------------------------------- streaming


def drained(spark, stream, mode="append"):
    at = f"{graph.shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    streams.drained(stream, f"{at}/out", f"{at}/state", mode)
    return spark.read.parquet(f"{at}/out")


@query("SELECT user_id, event_type FROM (SELECT DISTINCT user_id, event_type FROM events)")
def str_seen_dedupe(spark, sf):
    stream = streams.table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return drained(spark, streams.seen_once(stream, ["user_id", "event_type"], "ts", "3650 days").select("user_id", "event_type"))


@query("SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS dia, count(*) AS total FROM events GROUP BY 1, 2")
def str_outlet_counts(spark, sf):
    stream = streams.table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return drained(spark, streams.daily_counts(stream, "event_type", "ts"), "complete").withColumn("dia", F.col("dia").cast("timestamp_ntz"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) >= 43200000000 THEN 1 ELSE 0 END AS f FROM events),
   s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
   SELECT user_id, min(ts)::TIMESTAMP AS inicio, (max(ts) + INTERVAL 12 HOURS)::TIMESTAMP AS fin, count(*) AS eventos FROM s GROUP BY user_id, n""")
def str_sessions(spark, sf):
    """A stream's sessions, which end twelve hours after their last event."""
    stream = streams.table_stream(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = drained(spark, locks.sessions(stream, ["user_id"], "ts"), "complete")
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("inicio", "fin")})


from . import catalogue_places, catalogue_sources  # noqa: E402, F401  they register their queries here
