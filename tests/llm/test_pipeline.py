"""The corpus pipeline against a brute-force version of its stages, in Python over all rows."""

import itertools
import os
import re
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewell.llm import language, near_dedup, packing, pseudonyms
from tidewell.llm.queries import RANKS, VOCABULARY

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """The smallest documents, with nulls, empty texts, copies by white space, repeated rows and private data."""
    if not os.path.isdir(FOLDER):
        pytest.skip("no tables here")
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    copies = docs.where("doc_id % 9 = 0").select((F.col("doc_id") + 100_000).alias("doc_id"), F.regexp_replace("text", " ", " \t").alias("text"), "lang", "source", "n_chars")
    private = docs.where("doc_id % 11 = 3").select(
        (F.col("doc_id") + 200_000).alias("doc_id"), F.concat("text", F.lit(" one two six 988-555-2485, 2019-02-28")).alias("text"), "lang", "source", "n_chars"
    )
    odd = spark.createDataFrame([(300_000, None, None, None, None), (300_001, "", "en", "x", 0), (300_002, "12 !", "en", "x", 4)], docs.schema)
    folder = str(tmp_path_factory.mktemp("tables"))
    whole = docs.union(copies).union(private).union(odd).union(docs.where("doc_id = 1"))
    whole.write.parquet(f"{folder}/documents.parquet")
    return folder


def test_stages_keep_columns(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "exact_dedup", "near_dedup", "pseudonyms", "packing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), tables).columns == docs.columns
        assert stage(spark, docs.limit(0), tables).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), tables).count() == 0


def test_pipeline_equals_brute_force(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    model = language.train(docs)
    rows = [(i, t) for i, t in rows if not model.predict(t)[2]]

    exact = {}
    for i, t in sorted(rows):
        exact.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), (i, t))
    rows = list(exact.values())

    kept = spark.createDataFrame(rows, "doc_id long, text string")
    idf = near_dedup.Idf(*near_dedup.weights_table(kept))
    sets, parent = {i: near_dedup.shingles(idf, t) for i, t in rows}, {i: i for i, _ in rows}

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        if near_dedup.similarity(sets[a], sets[b]) >= near_dedup.SIMILARITY:
            x, y = sorted((top(a), top(b)))
            parent[y] = x
    rows = [(i, t) for i, t in rows if top(i) == i]
    assert 0 < len(rows) < len(sets) < docs.count()

    feistel = pseudonyms.Feistel(pseudonyms.KEY)
    own = packing.Encoder(public_tokenizers.path(VOCABULARY), public_tokenizers.path(RANKS))
    want = {i: own.packed(pseudonyms.pseudonymise(t or "", feistel)[0], packing.END_ID) for i, t in rows}

    pieces, sequences = {}, {}
    for r in corpus_pipeline.run(spark, tables).collect():
        pieces.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(want)
    for doc, parts in pieces.items():
        at = 0
        for start, length, crc in sorted(parts):
            assert start == at and crc == zlib.crc32(want[doc][4 * start : 4 * (start + length)])
            at += length
        assert at == len(want[doc]) // 4
    for parts in sequences.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= packing.CAPACITY
