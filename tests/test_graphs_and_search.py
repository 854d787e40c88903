"""Graphs in rounds, term search by dictionary, similar stories, places: against plain forms."""

import itertools
import math
import random
import re
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.functions import urls as U
from tidewell.operators import cosine, docs, graph, locations, rows, similarity


def pairs_of(spark, pairs):
    return spark.createDataFrame(pairs, "a long, b long")


def plain_components(pairs):
    root = {x: x for p in pairs for x in p}
    changed = True
    while changed:
        changed = False
        for a, b in pairs:
            low = min(root[a], root[b])
            changed = changed or root[a] != low or root[b] != low
            root[a] = root[b] = low
    return root


@pytest.mark.parametrize("hub", [2, 50_000])
def test_components_of_random_graphs(spark, hub):
    rng = random.Random(5)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(7, i) for i in range(200, 240)] + [(500, 500)]
    got = {r.node: r.root for r in graph.components(pairs_of(spark, pairs), hub).collect()}
    assert got == plain_components(pairs)


def test_components_take_few_rounds(spark):
    chain = spark.range(4095).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    out, rounds = graph.contracted(chain)
    assert rounds <= 16 and out.count() == 4096 and out.where("root <> 0").isEmpty()
    star = spark.range(60_001).select(F.lit(30_000).cast("long").alias("a"), F.col("id").alias("b"))
    out, rounds = graph.contracted(star)
    assert rounds <= 3 and out.count() == 60_001 and out.where("root <> 0").isEmpty()


def plain_levels(edges):
    nodes = {x for e in edges for x in e}
    left, level = {n: sum(t == n for _, t in edges) for n in nodes}, {}
    ready = {n: 0 for n in nodes if not left[n]}
    while ready:
        n, at = ready.popitem()
        level[n] = at
        for s, t in edges:
            if s == n:
                left[t] -= 1
                level[t] = max(level.get(t, 0), at + 1)
                if not left[t]:
                    ready[t] = level[t]
    return {n: v for n, v in level.items() if not left[n]}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_levels_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    edges = {tuple(sorted((rng.randrange(25), rng.randrange(25)))) for _ in range(30)}
    edges = {(a, b) for a, b in edges if a != b} | ({(30, 31), (31, 32), (32, 30), (32, 33), (33, 34)} if seed > 1 else set())
    if seed == 3:
        edges |= {(b, a) for a, b in rng.sample(sorted(edges), 3)}
    levels, cyclic, _ = graph.longest_ways(spark.createDataFrame(sorted(edges), "source long, target long"))
    want = plain_levels(sorted(edges))
    assert {r.node: r.level for r in levels.collect()} == want
    assert {r.node for r in cyclic.collect()} == {x for e in edges for x in e} - set(want)


def test_levels_and_ancestors_of_a_chain_take_few_rounds(spark):
    chain = spark.range(3000).select(F.col("id").alias("source"), (F.col("id") + 1).alias("target"))
    levels, cyclic, rounds = graph.longest_ways(chain)
    assert rounds <= 20 and levels.agg(F.max("level")).first()[0] == 3000 and cyclic.isEmpty()
    above = graph.ancestors(chain.where("source < 150"))
    assert above.count() == 150 * 151 // 2


def plain_hits(text, terms):
    """(orden, termino, n, contextos), by a pattern for each term on the whole text."""
    fold = lambda s: "".join(unicodedata.normalize("NFD", c)[0].lower() for c in s)
    t = re.sub(r"-[ \t]*\r?\n[ \t]*", "", (text or "").replace("\xad", ""))
    for i, term in enumerate(terms):
        words = fold(term).split()
        found = list(re.finditer(r"(?<![a-z0-9])" + r"\s+".join(re.escape(w) + "(?:es|s)?" for w in words) + r"(?![a-z0-9])", fold(t))) if words else []
        if found:
            yield i, term, len(found), [re.sub(r"\s+", " ", t[max(0, m.start() - 90) : m.end() + 90]).strip() for m in found[:2]]


def test_term_search_equals_patterns(spark, monkeypatch):
    rng = random.Random(3)
    words = ["fusión", "FUSIONES", "alta", "altas", "de", "de", "la", "x", "C++", "s.a.", "reorgani-\n zación", "año", "Ñandú", "...", "(", "\n\n", "a" * 100, "1", "ß"]
    terms = ["fusión", "alta de", "de de", "de la", "reorganización", "c++", "s.a.", "año", "x  fusion", "ñandu", "", "la x de", "1", "de la x de la"]
    pages = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 30, 900]))) if i else None) for i in range(60)] + [(500, "de la " * 2000)]
    df = spark.createDataFrame(pages, "p int, text string").repartition(3)
    want = sorted((p, *h) for p, t in pages for h in plain_hits(t, terms))
    read = lambda: sorted((r.p, r.orden, r.termino, r.n, r.contextos) for r in docs.term_hits(df, terms, ["p"]).collect())
    assert read() == want
    monkeypatch.setattr(docs, "DICTIONARY", 1000)  # several parts
    monkeypatch.setattr(docs, "BLOCK", 7)
    assert read() == want


def test_many_terms_with_one_beginning(spark):
    df = spark.createDataFrame([(1, "the 17 and the 4999 and the 5000 " * 300)], "p int, text string")
    got = docs.term_hits(df, [f"the {i}" for i in range(5000)], ["p"]).select("termino", "n").collect()
    assert sorted(map(tuple, got)) == [("the 17", 300), ("the 4999", 300)]


def stories(copies):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghijklmnop", k=6)) for _ in range(400)]
    out = [" ".join(rng.choices(words, k=rng.choice([1, 5, 40, 120]))) for _ in range(150)]
    out += [" ".join(w for w in t.split() if rng.random() < 0.8) for t in out[:60]]
    return out + [out[3]] * copies + ["", "de la que"]


def test_similar_pairs_equal_all_pairs(spark):
    """All pairs at the threshold, with hundreds of copies of one story."""
    texts = dict(enumerate(stories(500)))
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    vectors = {}
    for r in similarity.tfidf(df, "id", F.col("text")).collect():
        vectors.setdefault(r.id, {})[r.term] = r.w
    want = {}
    for a, b in itertools.combinations(sorted(vectors), 2):
        small, large = sorted((vectors[a], vectors[b]), key=len)
        sim = sum(w * large.get(t, 0) for t, w in small.items())
        if sim >= 0.4:
            want[a, b] = round(sim, 4)
    got = {(r.a, r.b): r.sim for r in similarity.similar_pairs(df, "id", F.col("text"), 0.4).collect()}
    assert got.keys() == want.keys() and len(got) > 500 * 499 / 2
    assert all(abs(got[p] - want[p]) < 2e-4 for p in got)
    pairs, members = similarity.similar_classes(df, "id", F.col("text"), 0.4)
    assert pairs.count() < 1000 and members.groupBy("class").count().agg(F.max("count")).first()[0] >= 500


def shuffled(spark):
    """Bytes that were shuffled so far."""
    scheduler = spark.sparkContext._jsc.sc()
    scheduler.listenerBus().waitUntilEmpty(30_000)
    return scheduler.statusStore().executorList(False).head().totalShuffleWrite()


def test_pairs_that_share_terms_are_no_rows(spark, monkeypatch):
    """Nearly all pairs of these share a term of both prefixes; what is shuffled does not grow with them."""
    rng = random.Random(3)
    texts = [[f"word{rng.randrange(300)}" for _ in range(40)] for _ in range(1500)]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts + [t[:30] for t in texts[:200]])], "id long, text string")
    before = shuffled(spark)
    want = sorted(similarity.similar_classes(df, "id", F.col("text"), 0.4)[0].collect())
    assert len(want) > 100 and shuffled(spark) - before < 4 << 20
    # many small blocks, sums in many parts, terms dealt out
    for name, most in {"BLOCK": 9000, "SENT": 0, "CELLS": 1000, "PRODUCTS": 1000}.items():
        monkeypatch.setattr(cosine, name, most)
    assert sorted(similarity.similar_classes(df, "id", F.col("text"), 0.4)[0].collect()) == want


def test_copies_recur_across_outlets_only(spark):
    body = "alfa beta gamma delta epsilon zeta theta kappa lambda omega sigma"
    data = [(i, "A", body, f"http://a/{i}", body, None, 0) for i in range(70)] + [(90, "B", body, "http://b/1", body, "2026-01-02", 1), (91, "C", "otro texto distinto", "http://c/1", "nada", None, 0)]
    df = spark.createDataFrame(data, "_seq long, medio string, titulo string, url string, contenido string, fecha_iso string, ind_relevante int")
    got = similarity.recurrence(df).collect()
    assert {r._seq for r in got if r.recurrencia == "Sí"} == {*range(70), 90} and {r.medios for r in got if r.recurrencia == "Sí"} == {"A, B"}
    assert got[0]._seq == 90 and [r._seq for r in similarity.recurrence(df, order="medio").collect()] == [*range(70), 90, 91]
    # the option of the daily report: no candidates from terms in more documents
    assert similarity.recurrence(df, longest=60).where("recurrencia = 'Sí'").isEmpty()
    assert similarity.recurrence(df.where("medio = 'A'")).where("recurrencia = 'Sí'").isEmpty()


def test_weights_are_doubles_whatever_counts_are_kept_in():
    weights = cosine.Weights(10, np.array([1, 3]), np.array([0, 1]), 2)
    for kind in (np.uint8, np.uint16, np.int32):
        got = weights.of(np.array([0, 1], np.uint32), np.array([7, 5], kind))
        assert got.tolist() == pytest.approx([(1 + math.log(7)) * (math.log(11 / 2) + 1), (1 + math.log(5)) * (math.log(11 / 4) + 1)], rel=1e-12)


def test_contents_of_articles_are_not_moved(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3))
    data = [(i, f"src{i % 3}", f"titulo {i}", f"http://a/{i // 2}", " ".join(word() for _ in range(4000)), None, i % 2) for i in range(200)]
    df = spark.createDataFrame(data, "_seq long, medio string, titulo string, url string, contenido string, fecha_iso string, ind_relevante int")
    before = shuffled(spark)
    assert [r._seq for r in similarity.recurrence(df).collect()] == [*range(0, 200, 2)]
    assert similarity.recurrence(df, only_relevant=True).isEmpty() and shuffled(spark) - before < 1 << 20


def test_places_in_the_report_move_no_contents(spark):
    """The report by outlet: rows with their places, and the outlets that have none."""
    rng = random.Random(6)
    data = [(i, f"src{i % 3}", "t", f"http://a/{i}", " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(4000)), None, 0) for i in range(150)]
    df = spark.createDataFrame(data, "_seq long, medio string, titulo string, url string, contenido string, fecha_iso string, ind_relevante int")
    before = shuffled(spark)
    kept = similarity.recurrence(df, order="medio")
    got = rows.numbered(kept, ["medio", "fecha_iso", "_seq"], "lugar").orderBy("lugar").collect()
    assert [(r.lugar, r._seq) for r in got] == [*enumerate(sorted(range(150), key=lambda i: (i % 3, i)), 1)]
    expected = spark.createDataFrame([("src1",), ("src9",)], "medio string")
    assert [r.medio for r in similarity.missing_outlets(kept, expected).collect()] == ["src9"]
    assert shuffled(spark) - before < 1 << 20


def test_sorted_rows_keep_their_order(spark):
    data = [(1, "B", "2026-01-01", 0, 1), (2, "A", None, 1, 1), (3, "A", "2026-03-01", 1, 2), (4, "B", "2026-02-01", 1, 2)]
    df = spark.createDataFrame(data, "_seq long, medio string, fecha_iso string, ind_relevante int, nro_medios int").repartition(3)
    order = lambda how: [r._seq for r in similarity.sorted_by(df, how).collect()]
    assert (order("relevancia"), order("fecha"), order("medio")) == ([3, 4, 2, 1], [3, 4, 1, 2], [2, 3, 1, 4])


def test_a_map_for_a_place_without_address(spark):
    schema = "page_id long, pos int, n_mapas long, lat double, lng double, consulta string, texto string"
    maps = spark.createDataFrame([(1, 0, 3, 1.0, 1.0, "", "x"), (1, 1, 3, 2.0, 2.0, "Sur", "s"), (1, 2, 3, 3.0, 3.0, "Norte", "n"), (2, 0, 2, 4.0, 4.0, "", "y"), (2, 1, 2, 5.0, 5.0, "Este", "e")], schema)
    others = spark.createDataFrame([(1, "")], "page_id long, direccion string")
    none = spark.createDataFrame([], "page_id long")
    got = locations.map_candidates(maps, others, none).select("page_id", "direccion").collect()
    assert sorted(map(tuple, got)) == [(1, "Sur"), (2, ""), (2, "Este")]


def test_zero_coordinates_are_gaps(spark):
    schema = "sitio string, orden int, nombre string, direccion string, telefono string, horario string, lat double, lng double, metodo string, contexto string, es_ubicacion boolean, pagina_url string"
    row = lambda n, lat, lng, address="Calle Real 100": ("s", n, "", address, "", "", lat, lng, "m", "", False, "u")
    df = spark.createDataFrame([row(1, 0.0, 0.0), row(2, None, 5.0), row(3, -12.0, 7.0), row(4, 0.0, None, "Otra calle 2"), row(5, None, None, "Otra calle 2")], schema)
    got = {r.clave: (r.lat, r.lng) for r in locations.merged(df, "sitio", ["orden"]).collect()}
    assert got == {"calle real 100": (-12.0, 5.0), "otra calle 2": (0.0, None)}


def test_link_scores_of_escaped_paths(spark):
    df = spark.createDataFrame([("https://a.pe/ubicaci%C3%B3n",), ("https://a.pe/%74ienda?x=1%",), ("https://a.pe/",)], "u string")
    score = U.link_score(F.lit(""), F.col("u"), ["ubicación", "tienda", ""])
    assert [r[0] for r in df.select(score).collect()] == [6, 6, 0]


def test_compatible_forms_are_letters(spark):
    df = spark.createDataFrame([("ﬁn ½",), ("ＦＵＬＬ-Width ñ",), ("plain Text",), (None,), ("",)], "t string")
    assert [r[0] for r in df.select(T.norm_alnum(F.col("t"))).collect()] == ["fin 1 2", "full width n", "plain text", None, ""]


def test_lists_of_a_site_are_cut_before_they_are_made(spark):
    pages = spark.range(3000).select(F.lit("s").alias("sitio"), F.col("id").alias("orden"), F.concat(F.lit("u"), "id").alias("url"), (F.col("id") % 2 == 1).alias("es_ubicacion"), F.lit("").alias("error"), F.lit(False).alias("bloqueada"))
    found = pages.select("sitio").limit(5)
    got = locations.site_summary(pages, found, "sitio").first()
    assert got.paginas_ubicacion == [f"u{i}" for i in range(1, 20, 2)] and (got.paginas, got.errores, got.candidatos) == (3000, [], 5)


def test_roll_up_of_a_document(spark):
    hits = spark.createDataFrame([(1, p, 0, "fusión", 2, [f"c{p}", f"d{p}"]) for p in range(60)] + [(1, 3, 1, "de", 1, ["e"])], "doc long, page int, orden int, termino string, n long, contextos array<string>")
    got = docs.doc_rollup(hits, "doc", "page").first()
    assert (got.palabras, got.contextos, got.total) == ("fusión (120); de (1)", "c0 | d0 | e", 121)
    assert got.paginas == ", ".join(map(str, range(40)))


def test_an_empty_table_has_a_header(spark, tmp_path):
    empty = spark.createDataFrame([], "medio string, titulo string")
    rows.write_csv(empty, str(tmp_path / "x"))
    lines = [line for f in (tmp_path / "x").glob("*.csv") for line in f.read_text().splitlines()]
    assert [re.sub('"', "", line) for line in lines] == ["medio;titulo"]
