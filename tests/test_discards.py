from tidewell.plans.discards import REASONS, FeedRules, discard_counts, feed_reasons

SCHEMA = "id long, medio string, url string, titulo string, fecha timestamp_ltz, fecha_pagina timestamp_ltz, contenido string, error string"


def test_reasons_in_order(spark):
    from datetime import datetime

    old, new, body = datetime(2024, 1, 1), datetime(2024, 3, 1), "Noticia de minería " * 20
    items = [
        (1, "a", "https://a.pe/deportes/1", "t", new, None, body, None), (2, "a", "https://a.pe/eco/1", "t", old, None, body, None),
        (3, "a", "https://a.pe/eco/1", "t", new, None, body, None), (4, "a", "https://a.pe/eco/1", "t", old, None, body, None),
        (5, "b", "https://a.pe/ECO/1", "t", None, None, body, None), (6, "a", " ", "t", new, None, body, None), (7, "a", None, "t", new, None, body, None),
        (8, "a", "https://a.pe/eco/horoscopo-hoy", "t", new, None, body, None), (9, "a", "https://a.pe/eco/2", None, new, None, None, "RED"),
        (10, "a", "https://a.pe/eco/3", "t", new, None, None, None), (11, "a", "https://a.pe/eco/4", "t", new, None, "corto", None),
        (12, "a", "https://a.pe/eco/5", "t", None, old, body, None), (13, "a", "https://a.pe/eco/6", "Fútbol", new, old, body, None),
        (14, "a", "https://a.pe/eco/7", "t", new, old, "otra cosa " * 30, None), (15, "a", "https://a.pe/eco/8", "t", new, None, body, None),
        (16, None, "https://a.pe/eco/9", "t", new, None, body, None), (17, None, "https://a.pe/eco/9", "t", new, None, body, None),
    ]
    rules = FeedRules(["/eco/"], ["/vídeos/"], r"a\.PE", "2024-02-01 00:00:00", ["Horóscopo"], ["futbol"], ["mineria"], True, 50)
    df, seen = spark.createDataFrame(items, SCHEMA), spark.createDataFrame([("a", "https://a.pe/eco/8"), ("b", "https://a.pe/eco/4")], "medio string, url string")
    got = {r.id: r.motivo for r in feed_reasons(df, rules, "id", seen).collect()}
    assert got == {
        1: "otra_seccion", 2: "fuera_de_ventana", 3: None, 4: "duplicadas", 5: None, 6: "duplicadas", 7: "duplicadas", 8: "excluidas_titulo", 9: "errores",
        10: "cuerpo_vacio", 11: "cuerpo_corto", 12: "fuera_de_ventana", 13: "excluidas_contenido", 14: "no_relevantes", 15: "duplicadas", 16: None, 17: "duplicadas",
    }
    assert set(got.values()) == {None, *REASONS}
    counts = {r.medio: r for r in discard_counts(feed_reasons(df, rules, "id", seen)).collect()}
    assert (counts["a"].duplicadas, counts["a"].quedan, counts["b"].quedan, counts[None].duplicadas) == (4, 1, 1, 1)
    # without rules: what has no URL, an error or no text, and all but the first of a URL
    assert {r.id for r in feed_reasons(df, FeedRules(), "id").where("motivo IS NULL").collect()} == {1, 2, 5, 8, 11, 12, 13, 14, 15, 16}
    assert feed_reasons(df.limit(0), rules, "id").count() == 0
