"""The training-data operators against brute force, exact round trips and held-out accuracy, with odd rows."""

import base64
import hashlib
import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidewell.llm.common import Scratch
from tidewell.llm import bpe, exact_dedup, language, line_dedup, linking, near_dedup, packing, pseudonyms, url_rules, vectors, warc

VOCAB, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
DOCS = "doc_id long, text string, lang string, key string, node string"


@pytest.fixture(scope="module")
def words():
    rng = random.Random(4)
    return ["".join(rng.choices("abcdefgilmnoprst", k=rng.randint(2, 9))) for _ in range(3000)]


@pytest.fixture(scope="module")
def docs(spark, words):
    """Near and exact copies, nulls, empty and long texts, repeated rows, columns with clashing names."""
    rng, rows = random.Random(5), []
    for i in range(60):
        base = rng.choices(words, k=rng.randint(40, 120))
        rows.append((10 * i, " ".join(base)))
        if i % 3 == 0:
            near = list(base)
            near[rng.randrange(len(near))] = "changed"
            rows.append((10 * i + 1, " ".join(near)))
        if i % 5 == 0:
            rows.append((10 * i + 2, "\t\n".join(base)))
    rows += [(7001, None), (7002, ""), (7003, "  \n"), (7004, "uno"), (None, "uno"), (7005, " ".join(words) * 3), (7005, " ".join(words) * 3), (7006, "a" * 50_000)]
    return spark.createDataFrame([(i, t, "en", "k", "n") for i, t in rows], DOCS)


def test_exact_dedup(docs):
    rows = docs.select("doc_id", "text").collect()
    norm = lambda t: __import__("re").sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups = {}
    for r in rows:
        groups.setdefault(norm(r.text), []).append(r.doc_id)
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = sorted(
        repr((i, min((x for x in ids if x is not None), default=None), len(ids), hashlib.sha256(t.encode()).hexdigest())) for t, ids in groups.items() for i in ids
    )
    assert sorted(repr((r.doc_id, r.keep_id, r.group_size, r.text_sha256)) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    kept = exact_dedup.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [500, 1 << 30])
def test_trie_spills_by_subtree(limit):
    rng, trie, want = random.Random(1), exact_dedup.PatriciaTrie(limit), {}
    for i in range(3000):
        text = b"common " + bytes(rng.choices(b"ab", k=rng.randint(0, 9)))
        text = b"" if i % 500 == 0 else text
        trie.insert(text, i if i % 7 else None, 1)
        want.setdefault(text, []).append(i if i % 7 else None)
    got = {t: (i, n) for t, i, n in trie.drain()}
    assert got == {t: (min((i for i in ids if i is not None), default=None), len(ids)) for t, ids in want.items()}


def test_near_dedup_equals_brute_force(docs):
    table = near_dedup.weights_table(docs)
    idf, texts = near_dedup.Idf(*table), {}
    for r in docs.select("doc_id", "text").collect():
        texts.setdefault(r.text or "", []).append(r.doc_id)
    sets, parent = {t: near_dedup.shingles(idf, t) for t in texts}, {t: t for t in texts}

    def top(t):
        while parent[t] != t:
            t = parent[t]
        return t

    for a, b in itertools.combinations(texts, 2):
        if near_dedup.similarity(sets[a], sets[b]) >= 0.8:
            parent[top(a)] = top(b)
    classes = {}
    for t, ids in texts.items():
        classes.setdefault(top(t), []).extend(ids)
    want = sorted(repr((i, min((x for x in ids if x is not None), default=None), len(ids))) for ids in classes.values() for i in ids)
    got = near_dedup.near_duplicates(docs).collect()
    assert sorted(repr((r.doc_id, r.class_id, r.class_size)) for r in got) == want
    assert sum(r.kept for r in got) == len(classes)
    assert near_dedup.deduplicate(docs).count() == len(classes)
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0


def test_large_group_of_near_copies(spark, words):
    """The candidate search is probabilistic: at most one of the 81 copies may share no band with the others."""
    rng, base, rows = random.Random(8), words[:150], []
    for i in range(80):
        text = list(base)
        for _ in range(i % 2 + 1):
            text[rng.randrange(150)] = f"x{i}"
        rows.append((i, " ".join(text)))
    got = near_dedup.near_duplicates(spark.createDataFrame([*rows, (99, " ".join(base))], "doc_id long, text string")).collect()
    assert sum(r.class_id == 0 for r in got) >= 80


def test_large_buckets_of_many_families_lose_no_link(spark):
    """Members meet in large buckets only, and only neighbours of a family are similar."""
    rows = [(b, node) for b in (1, 2) for node in range(90)] + [(3, node) for node in range(0, 90, 7)] + [(4, 5), (4, 200)]

    class Families(linking.Verifier):
        threshold = 0.8

        def verify(self, pairs):
            return pairs.where("a div 3 = b div 3 AND b - a = 1 OR b = 200")

        def tokens(self, nodes):
            return nodes.selectExpr("node", "IF(node = 200, 1, node div 3) AS token", "1.0D AS weight")

    members = spark.createDataFrame(rows, "bucket long, node long")
    got = {r.node: r.root for r in linking.linked(members, Families(), Scratch(spark), "test").collect()}
    assert got == {node: node // 3 * 3 for node in range(90)} | {200: 3}


def test_line_dedup_equals_brute_force(spark, words):
    rng, rows = random.Random(6), []
    for i in range(40):
        lines = [" ".join(rng.choices(words, k=rng.randint(8, 30))) for _ in range(3)]
        if i % 4 == 1:
            lines.append(rows[-1][1].split("\n")[0] + " x")
        rows.append((i, "\n".join([*lines, "", "boilerplate line of the house", "\r"])))
    rows += [(90, None), (91, ""), (92, "ab\nab"), (93, "w" * 4000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    first = {}
    for i, t in rows:
        for n, line in enumerate((t or "").split("\n")):
            if line.strip():
                first.setdefault(line, (i, n))
    sets = {s: {s[k : k + 12] for k in range(max(1, len(s) - 11))} for s in first}
    parent = {s: s for s in first}

    def top(s):
        while parent[s] != s:
            s = parent[s]
        return s

    for a, b in itertools.combinations(first, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            x, y = sorted((top(a), top(b)), key=first.get)
            parent[y] = x
    text = dict(rows)
    got = line_dedup.line_classes(df).collect()
    assert {(r.doc_id, r.line_no): (r.class_doc_id, r.class_line_no) for r in got} == {
        (r.doc_id, r.line_no): first[top(text[r.doc_id].split("\n")[r.line_no])] for r in got
    }
    out = {r.doc_id: r.text for r in line_dedup.deduplicate(df).collect()}
    assert out[92] == "ab" and out[90] is None and "boilerplate" in out[0] and "boilerplate" not in out[1]


@pytest.mark.parametrize("end", ["!", " 7"])
def test_short_lines_with_edited_ends(spark, words, end):
    """Of the pairs that reach 0.8 at most the few that share no band may be missed."""
    rng, lines = random.Random(9), set()
    while len(lines) < 400:
        line = " ".join(rng.choices(words, k=12))[: rng.randint(20, 79)]
        lines.add(line.strip())
    shingles = lambda s: {s[k : k + 12] for k in range(len(s) - 11)}
    pairs = [(s, s + end) for s in sorted(lines) if len(shingles(s)) >= 0.8 * len(shingles(s + end))]
    df = spark.createDataFrame([(i, s + "\n" + t) for i, (s, t) in enumerate(pairs)], "doc_id long, text string")
    found = line_dedup.line_classes(df).where("line_no = 1 AND NOT kept AND class_doc_id = doc_id").count()
    assert len(pairs) > 300 and found >= 0.98 * len(pairs)


def test_bpe_equals_the_library(spark, docs):
    from tokenizers import Tokenizer

    library, own, rng = Tokenizer.from_file(VOCAB), bpe.Codec(VOCAB), random.Random(2)
    parts = ["a", " ", "  ", "\n", "\t", "\x1c", "\xa0", "é", "²", "漢", "😀", "'s", "12", "_", "!!", "<|endoftext|>", " the", "\r\n", "́", "\x00"]
    for _ in range(400):
        text = "".join(rng.choices(parts, k=rng.randint(0, 20)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert list(np.frombuffer(own.encode(text), "<u4")) == ids
        assert own.decode(own.encode(text)) == library.decode(ids, skip_special_tokens=False)
        assert list(np.frombuffer(packing.Encoder(VOCAB, RANKS).packed(text, 1), "<u4")) == [*ids, 1] if rng.random() < 0.02 else True
    for r in bpe.round_trip(docs, VOCAB).join(docs.select("doc_id", "text"), "doc_id").collect():
        assert r.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
    assert bpe.decode(bpe.encode(docs.limit(3), VOCAB), VOCAB).count() == 3


def test_language_is_learned_in_a_task(spark, monkeypatch):
    import os

    driver, fit = os.getpid(), language.fit

    def elsewhere(x, labels):
        assert os.getpid() != driver, "the sample came to the driver"
        return fit(x, labels)

    monkeypatch.setattr(language, "fit", elsewhere)
    d = spark.createDataFrame([(i, *(("der hund und die katze", "de") if i % 2 else ("the dog and the cat", "en"))) for i in range(400)], "doc_id long, text string, lang string")
    model = language.train(d.repartition(7))
    assert model.languages == ["de", "en"] and model.weights.shape == (language.BUCKETS, 2)
    assert [model.predict(t)[0] for t in ("die katze", "the cat")] == ["de", "en"]


def test_language(spark):
    import os

    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no tables here")
    d = spark.read.parquet(f"{folder}/documents.parquet")
    model = language.train(d)
    got = language.identify(d, model).join(d.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang_pred == r.lang for r in got) / len(got) > 0.97
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    odd = spark.createDataFrame([(None, None), (1, "123 !"), (2, "")], "doc_id long, text string")
    assert {(r.lang_pred, r.score) for r in language.identify(odd, model).collect()} == {("und", 0.0)}
    assert language.keep_known(odd.withColumn("__x", F.lit(1)), model).count() == 0
    assert language.train(d.limit(0)).languages == []


def test_pseudonyms(spark):
    f = pseudonyms.Feistel(b"key")
    assert sorted(f.permute(i, 1000, "t") for i in range(1000)) == list(range(1000))
    text = "tel +1 (988) 555-2485, 988-555-2485; 4405240589021364; 31.212.151.109; a.b9@mail0.example.com; 123-45-6789; 2019-02-28; 3/14/1990"
    new, found = pseudonyms.pseudonymise(text, f)
    assert len(new) == len(text) and found == {"email": 1, "card": 1, "phone": 2, "ssn": 1, "ip": 1, "date": 2}
    for value in ("555-2485", "4405240589021364", "31.212.151.109", "a.b9@", "123-45-6789", "2019-02-28", "3/14/1990"):
        assert value not in new
    a, b = new.split(";")[0].removeprefix("tel ").split(", ")
    assert pseudonyms.only_digits(a)[1:] == pseudonyms.only_digits(b)
    assert pseudonyms.luhn_sum(new.split("; ")[1]) == 0
    assert pseudonyms.pseudonymise("Version 2.0, 4405240589021365, 2019-02-30, 999.1.1.1", f)[1] == {}
    df = spark.createDataFrame([(1, text, "z"), (2, None, "z"), (3, "", "z")], "doc_id long, text string, n_email string")
    assert [r.n_values for r in pseudonyms.report(df, b"key").orderBy("doc_id").collect()] == [8, 0, 0]
    assert pseudonyms.with_pseudonyms(df, b"key").columns == df.columns


def test_phones_outside_the_numbering_plan():
    f = pseudonyms.Feistel(b"key")
    for area, exchange in itertools.product(("017", "152", "217"), ("055", "155", "555")):
        for shape in (f"+1 ({area}) {exchange}-7713", f"({area}) {exchange}-7713", f"{area}-{exchange}-7713", f"{area}.{exchange}.7713"):
            new, found = pseudonyms.pseudonymise(f"call {shape} now", f)
            assert found == {"phone": 1} and shape not in new and len(new) == len(f"call {shape} now")
            digits, old = pseudonyms.only_digits(new)[-10:], area + exchange + "7713"
            assert digits != old and pseudonyms.plan_number(digits) == pseudonyms.plan_number(old)
    some = [f"{i % 2}{i:02d}-555-{7 * i:04d}" for i in range(100)] + [f"9{i:02d}-{i:03d}-{7 * i:04d}" for i in range(100)]
    assert len({pseudonyms.pseudonymise(p, f)[0] for p in some}) == len(set(some))


def test_packing(spark, docs):
    rows = packing.pack(docs, VOCAB, RANKS).collect()
    own, want = packing.Encoder(VOCAB, RANKS), {}
    for r in docs.select("doc_id", "text").collect():
        want.setdefault(r.doc_id, own.packed(r.text or "", 1))
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, set()).add((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc, parts in pieces.items():
        at = 0
        for start, length, crc, tokens in sorted(parts):
            assert start == at and tokens == len(want[doc]) // 4
            assert crc == zlib.crc32(want[doc][4 * start : 4 * (start + length)])
            at += length
        assert at == len(want[doc]) // 4
    for parts in sequences.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= packing.CAPACITY


def test_nearest(spark):
    rng = np.random.default_rng(1)
    data = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    data += [(400, None), (401, [0.0] * 8), (402, [float("nan")] * 8), (None, [1.0] * 8), (403, [1.0, 2.0]), (7, data[7][1])]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    got = vectors.nearest(df, df.where("vec_id % 100 = 0"), factor=1.0).collect()
    good = [(i, np.array(v)) for i, v in data if i is not None and v and len(v) == 8 and np.isfinite(v).all() and any(v)]
    for q in (0, 100, 200, 300):
        order = sorted((float(np.sqrt(((v - data[q][1]) ** 2).sum())), i) for i, v in good if i != q)[:10]
        mine = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [(i, pytest.approx(d)) for d, i in order] == [(i, d) for _, i, d in mine]
    assert {r.query_id for r in got} == {0, 100, 200, 300}


def test_warc(spark):
    payloads = [(1, "x" * 100_000), (2, "x" * 100_000), (3, None), (4, ""), (5, "é\r\n\r\nWARC/1.1\r\n"), (None, "z"), (9, "z"), (5, "é\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame([(i, f"http://a/{i} \r\nx", t, "c") for i, t in payloads], "page_id long, url string, html string, payload string")
    files = warc.archive(df)
    digest = lambda t: base64.b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    want = [(i, len((t or "").encode()), digest(t), *kind) for (i, t), kind in zip(payloads, [("response", None), ("revisit", 1), ("response", None), ("revisit", 3), ("response", None), ("revisit", 9), ("response", None), ("response", None)], strict=True)]
    assert sorted(map(repr, map(tuple, warc.survey(files).collect()))) == sorted(map(repr, want))
    chunks = warc.read(files).where("page_id = 1").orderBy("chunk_no").collect()
    assert b"".join(bytes(c.chunk) for c in chunks) == b"x" * 100_000 and len(chunks) == 7
    assert warc.survey(warc.archive(df.limit(0))).count() == 0


def test_url_rules(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "com", "/de/")]
    urls = [(1, "https://A.example.ORG/es/1?q"), (2, "http://x.org/en"), (3, "http://x.com/de/#a"), (4, None), (5, "nada"), (6, "http://spam.net/win/9"), (7, "http://notorg/x"), (7, "http://notorg/x")]
    urls += [(100 + i, f"http://spam.net/win/{i}") for i in range(20)] + [(200 + i, f"http://fine.net/news/{i}") for i in range(20)]
    labels = [(100 + i, True) for i in range(20)] + [(200 + i, False) for i in range(20)] + [(None, None)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in urls], "page_id long, url string, tokens string")
    known = spark.createDataFrame(labels, "page_id long, blocked boolean")
    got = {(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_rules.filter_urls(pages, known, rules).collect()}
    assert {
        (1, "a.example.org", "/es/1", "example.org/es/", "block"), (2, "x.org", "/en", "org/", "allow"), (3, "x.com", "/de/", "com/de/", "block"),
        (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "spam.net", "/win/9", None, "block"), (7, "notorg", "/x", None, "allow"),
    } <= got
    assert url_rules.filter_urls(pages, known.limit(0), rules).count() == len(urls)
    assert url_rules.filter_urls(pages.limit(0), known, rules).count() == 0


def test_url_rules_take_all_segments_and_query_names(spark):
    """The deciding token comes after many that all URLs have; a part of a mined template is enough for its rule."""
    long, many = "/".join("abcdefghijklmnopqrst"), "&".join(f"n{c}=1" for c in "abcdefghijklmnopqrst")
    urls = [f"http://x.net/{long}/{'win/big' if i < 20 else 'news'}" for i in range(40)]
    urls += [f"http://y.net/s?{many}&{'spin' if i < 20 else 'read'}=1" for i in range(40)]
    labels = [(i, i % 40 < 20) for i in range(80)]
    urls += ["http://z.org/1/2/3/4/5/6/big", "http://z.org/?a&b&c&d&e&f&g&spin=9", "http://z.org/1/2/3/4/5/6/news"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_rules.filter_urls(pages, spark.createDataFrame(labels, "page_id long, blocked boolean"), []).collect()}
    assert got == {i: "block" if blocked else "allow" for i, blocked in labels} | {80: "block", 81: "block", 82: "allow"}
