"""Whole small tables against the libraries and against brute force; odd rows and odd column names for each operator."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import bpe, exact_dedup, language, line_dedup, linking, near_dedup, packing, pseudonyms, url_rules, vectors, warc
from tidewell.llm.common import Scratch

VOCAB, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(VOCAB)
    own.no_truncation()
    own.no_padding()
    return own


@pytest.fixture(scope="module")
def documents(spark):
    """The smallest documents, with a null and two texts on both sides of 2 ** 20 characters."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    d = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    rng = random.Random(3)
    words = [" the", "año", "Straße", " 12", "\n", "x" * 30, "'s", "  ", "漢字", "é"]
    long = [(900_001, "".join(rng.choices(words, k=700_000))[: (1 << 20) - 1]), (900_002, "".join(rng.choices(words, k=700_000))[: (1 << 20) + 9]), (900_003, None)]
    return d.union(spark.createDataFrame(long, "doc_id long, text string"))


def test_bpe_ids_of_a_whole_table(documents, library):
    text = {r.doc_id: r.text or "" for r in documents.collect()}
    got = bpe.round_trip(documents, VOCAB).collect()
    assert len(got) == len(text)
    for r in got:
        ids = library.encode(text[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_packed_ids_of_a_whole_table(documents, library):
    text = {r.doc_id: r.text or "" for r in documents.collect()}
    pieces = collections.defaultdict(list)
    for r in packing.pack(documents, VOCAB, RANKS).collect():
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32))
    assert set(pieces) == set(text)
    for doc, parts in pieces.items():
        ids = np.array([*library.encode(text[doc], add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for start, length, crc in sorted(parts):
            assert start == at and crc == zlib.crc32(ids[start : start + length].tobytes())
            at += length
        assert at == len(ids)


def test_url_rules_equal_all_rules(spark):
    """Every combination of tokens is a rule if its support and confidence are enough; the best one that fits decides."""
    rng, words = random.Random(12), ["win", "news", "spin", "blog", "free"]
    urls = [f"http://{rng.choice(['a', 'b', 'c'])}.net/{'/'.join(rng.sample(words, rng.randint(1, 3)))}" for _ in range(300)]
    labels = {i: "win" in u and "b.net" in u or rng.random() < 0.25 for i, u in enumerate(urls[:200])}
    sets = [frozenset(["h:" + h for h in u.split("/")[2].split(".")] + ["p:" + p for p in u.split("/")[3:]]) for u in urls]
    support, confidence, counts, blocked = 0.05, 0.5, collections.Counter(), collections.Counter()
    for i, bad in labels.items():
        for n in range(1, len(sets[i]) + 1):
            for c in itertools.combinations(sorted(sets[i]), n):
                counts[c] += 1
                blocked[c] += bad
    rules = []
    for c, n in counts.items():
        for verdict, hits in (("block", blocked[c]), ("allow", n - blocked[c])):
            if hits >= support * len(labels) and hits / n >= confidence:
                rules.append((hits / n, verdict, set(c)))
    want = {}
    for i, own in enumerate(sets):
        fits = [(conf, verdict) for conf, verdict, c in rules if c <= own]
        want[i] = max(fits)[1] if fits else "allow"
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    known = spark.createDataFrame(list(labels.items()), "page_id long, blocked boolean")
    got = {r.page_id: r.verdict for r in url_rules.filter_urls(pages, known, [], support, confidence).collect()}
    assert got == want and len(set(want.values())) == 2


def test_all_private_values_of_a_table_go(spark):
    """Each value that a plain finder sees in the documents is gone, and equal values become equal ones."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    d = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").where("text IS NOT NULL")
    new = {r.doc_id: r.text for r in pseudonyms.report(d, b"key").collect()}
    finders = [r"[\w.]+@[\w.]+\.\w+", r"\b\d{3}-\d{2}-\d{4}\b", r"\+1 \(\d{3}\) \d{3}-\d{4}", r"\bAKIA[A-Z0-9]{16}\b", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b"]
    twin, n = {}, 0
    for r in d.collect():
        assert len(new[r.doc_id]) == len(r.text)
        for m in itertools.chain.from_iterable(re.finditer(f, r.text) for f in finders):
            after = new[r.doc_id][m.start() : m.end()]
            if "-" in m[0] and m[0].count("-") == 2 and not pseudonyms.ssn_valid(int(m[0].replace("-", ""))):
                continue
            assert after != m[0] and twin.setdefault(m[0], after) == after
            n += 1
    assert n > 5 and len(set(twin.values())) == len(twin)


def test_overlapping_values(spark):
    f = pseudonyms.Feistel(b"k")
    many = ", ".join(f"a{i}@b.com 10.0.{i % 256}.{i % 200}" for i in range(3000))
    new, found = pseudonyms.pseudonymise(many, f)
    assert found == {"email": 3000, "ip": 3000} and len(new) == len(many)


def test_nearest_in_several_shards(spark, monkeypatch):
    """Regions, parts of one region, ties and repeated ids; a factor of one is exact, the query's own has high recall."""
    monkeypatch.setattr(vectors, "SHARD_COMPONENTS", 8 * 200)
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8)) * 4
    data = [(i, centres[i % 20] + rng.normal(size=8)) for i in range(3000)]
    data += [(3000 + i, np.ones(8)) for i in range(600)] + [(100, rng.normal(size=8)), (200, data[200][1])]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in data], "vec_id long, embedding array<double>")
    asking = df.where("vec_id % 100 = 0")
    matrix, ids = np.array([v for _, v in data]), np.array([i for i, _ in data])
    own = {}
    for at, (i, v) in enumerate(data):
        if i % 100 == 0 and (i not in own or v.tolist() < data[own[i]][1].tolist()):
            own[i] = at
    want = {}
    for q, at in own.items():
        d = np.sqrt(((matrix - matrix[at]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, d)) if j != at][:10]
        want[q] = [(int(ids[j]), float(d[j])) for j in order]
    exact = collections.defaultdict(list)
    for r in vectors.nearest(df, asking, factor=1.0).orderBy("query_id", "rank").collect():
        exact[r.query_id].append((r.vec_id, r.score))
    assert {q: [i for i, _ in found] for q, found in exact.items()} == {q: [i for i, _ in found] for q, found in want.items()}
    assert all(a[1] == pytest.approx(b[1], abs=1e-12) for q in want for a, b in zip(exact[q], want[q], strict=True))
    quick = {(r.query_id, r.vec_id) for r in vectors.nearest(df, asking).collect()}
    assert sum((q, i) in quick for q, found in want.items() for i, _ in found) >= 0.9 * sum(map(len, want.values()))


class Pairs(linking.Verifier):
    """Nodes are alike where both have the same third."""

    threshold = 0.8

    def __init__(self, size):
        self.size = size

    def verify(self, pairs):
        return pairs.where(f"a div {self.size} = b div {self.size}")

    def tokens(self, nodes):
        return nodes.selectExpr("node", f"node div {self.size} AS token", "1.0D AS weight")


@pytest.mark.parametrize(("members", "size"), [(40, 2), (2000, 4)])
def test_one_bucket_of_many_links(spark, members, size):
    rows = [(b, node) for b in (1, 2) for node in range(members)]
    got = {r.node: r.root for r in linking.linked(spark.createDataFrame(rows, "bucket long, node long"), Pairs(size), Scratch(spark), "t").collect()}
    assert got == {node: node // size * size for node in range(members)}


def test_small_buckets_are_compared_at_once(spark, monkeypatch):
    """Several components in each bucket, and no step after the first for them; a large bucket still is linked whole."""
    rows = [(node // 10, node) for node in range(40)] + [(100 + b, 1000 + node) for b in (1, 2) for node in range(40)]
    calls, verify = [], Pairs.verify
    monkeypatch.setattr(Pairs, "verify", lambda self, pairs: calls.append(pairs) or verify(self, pairs))
    # samples that tell nothing: before, such pairs met in the third step only
    profiles = spark.createDataFrame([(node, 1) for _, node in rows], "node long, n long").distinct()
    of = lambda some, alike: {r.node: r.root for r in linking.linked(spark.createDataFrame(some, "bucket long, node long"), Pairs(2), Scratch(spark), "t", profiles, alike, pairwise=16).collect()}
    assert of(rows[:40], lambda x, y: x("n") + y("n") < 0) == {node: node // 2 * 2 for node in range(40)} and len(calls) == 1
    assert of(rows, linking.always) == {node: node // 2 * 2 for node in [*range(40), *range(1000, 1040)]}


def test_components_of_long_paths(spark):
    path = [(i, i + 1) for i in range(200)] + [(1000 + i, 1000 + (i + 1) % 30) for i in range(30)]
    got = {r.node: r.root for r in linking.components(spark.createDataFrame(path, "a long, b long"), Scratch(spark), "t").collect()}
    assert got == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(30)}


def test_signatures_go_before_lines_are_compared(spark, monkeypatch):
    seen, verify = [], line_dedup.LineVerifier.verify

    def watched(self, pairs):
        seen.append([path for _, path in self.scratch.tables if "line-signatures" in path])
        return verify(self, pairs)

    monkeypatch.setattr(line_dedup.LineVerifier, "verify", watched)
    rows = [(i, f"a line of text that is all but the same in each of them {i}") for i in range(5)]
    assert {r.class_doc_id for r in line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {0}
    assert seen and not any(seen)


def test_lines_of_few_words(spark):
    """Lines of a few long words, and of one without spaces, with one letter changed."""
    rng, letters, rows = random.Random(5), "abcdefghijklmnopqrstuvwxyz", []
    for i in range(300):
        words = ["".join(rng.choices(letters, k=rng.randint(20, 40))) for _ in range(5 if i % 3 else 1)]
        s = " ".join(words) if i % 3 else words[0] * 1 + "".join(rng.choices(letters, k=120))
        at = rng.randrange(3)
        t = s[:at] + "#" + s[at + 1 :] if i % 2 else s + "#"
        sets = [{x[k : k + 12] for k in range(len(x) - 11)} for x in (s, t)]
        if len(sets[0] & sets[1]) >= 0.8 * len(sets[0] | sets[1]):
            rows.append((i, s + "\n" + t))
    found = line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).where("line_no = 1 AND class_doc_id = doc_id AND NOT kept").count()
    assert len(rows) > 200 and found >= 0.99 * len(rows)


def test_lines_that_repeat_themselves(spark):
    rows = [(1, "la la la " * 200), (2, "la la la " * 30), (3, "w" * 5000), (4, "w" * 300), (5, "ab" * 700 + "c"), (6, "ab" * 500 + "c")]
    got = {r.doc_id: r.class_doc_id for r in line_dedup.line_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == got[2] and got[3] == got[4]


def test_share_of_a_huge_corpus():
    for total in (10**3, 10**9, 10**11, 10**15):
        below = language.chosen_below(2000, total)
        assert below >= 1 and (total <= 2000 or abs(below / 2**63 * total - 2000) < 1)
    assert language.chosen_below(2000, 100) == 2**63 - 1


ODD = "doc_id long, text string, lang string, __p string, __id long, key string, `a.b` string, row string, id int, times int"


@pytest.fixture(scope="module")
def odd(spark):
    """Null ids and texts, empty and very long texts, repeated rows, columns whose names clash with the operators' own."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(400)]
    say = lambda n: " ".join(rng.choices(words, k=n))
    same, long = say(60), say(400_000)
    texts = [(1, same), (2, same), (2, same), (3, same + " more"), (4, None), (5, ""), (None, say(30)), (None, None), (6, long), (7, long), (8, "12 34"), (9, "call 988-555-2485 or a@b.com " + say(20))]
    return spark.createDataFrame([(i, t, "en", "p", 5, "k", "ab", "r", 3, 4) for i, t in texts], ODD)


STAGES = {
    "language": lambda d: language.keep_known(d, language.train(d)),
    "exact": exact_dedup.deduplicate,
    "near": near_dedup.deduplicate,
    "lines": line_dedup.deduplicate,
    "pseudonyms": lambda d: pseudonyms.with_pseudonyms(d, b"k"),
}


@pytest.mark.parametrize("name", STAGES)
def test_stages_carry_odd_columns(odd, name):
    got = STAGES[name](odd)
    assert got.schema.names == odd.schema.names and [f.dataType for f in got.schema] == [f.dataType for f in odd.schema]
    rows = got.collect()
    assert rows and {tuple(r)[3:] for r in rows} == {("p", 5, "k", "ab", "r", 3, 4)}
    ids = collections.Counter(r.doc_id for r in rows)
    if name == "exact":
        assert ids == {1: 1, 3: 1, 4: 1, 6: 1, 8: 1, 9: 1, None: 1}
    if name == "near":
        assert ids[1] == 1 and ids[2] == ids[3] == 0 and ids[6] == 1 and ids[7] == 0
    if name in ("pseudonyms", "lines"):
        assert len(rows) == odd.count()
    assert STAGES[name](odd.limit(0)).collect() == []


def test_operators_take_odd_rows(spark, odd):
    model = language.train(odd)
    for run, most in (
        (lambda d: language.identify(d, model), None), (lambda d: bpe.round_trip(d, VOCAB), None), (lambda d: pseudonyms.report(d, b"k"), None),
        (exact_dedup.exact_duplicates, None), (near_dedup.near_duplicates, None), (lambda d: packing.pack(d, VOCAB, RANKS), 10_000), (line_dedup.line_classes, 10_000),
    ):
        n = run(odd).count()
        assert n == odd.count() if most is None else 0 < n < most
        assert run(odd.limit(0)).count() == 0
    pages = odd.select(F.col("doc_id").alias("page_id"), F.lit("http://a.b/c").alias("url"), F.col("text").alias("html"), "__p", F.col("`a.b`"), F.lit("x").alias("payload"))
    assert warc.survey(warc.archive(pages)).count() == pages.count()


def test_archives_in_several_files(spark):
    rows = spark.createDataFrame([(i, f"http://a/{i}", str(i) * 5000) for i in range(50)], "page_id long, url string, html string").coalesce(1)
    files = warc.write(warc.chunked(warc.records(rows)), warc.fresh_path(spark, "warc"), 4000)
    assert files.count() > 3 and warc.survey(files).count() == 50


def test_empty_pipeline(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
