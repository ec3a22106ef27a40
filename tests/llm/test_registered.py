"""The registered queries: against their SQL over the test tables, or against plain versions over small ones."""

import hashlib
import os
import random
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from tessera.llm import registry

SF = "/root/testdata/sf0.001"
HERE = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
digest = lambda s: hashlib.sha256(s.encode()).hexdigest()


def rows(columns, values):
    keep = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(repr(tuple(r[i] for i in keep)) for r in values)


@HERE
@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = entry.queries()[name](spark, SF), con.sql(entry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in registry.QUERIES] == [f"op{i}" for i in range(1, 11)] and "pipeline" in entry.queries()


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(4))
    texts = [" ".join(word() for _ in range(rng.choice([1, 40, 300]))) for _ in range(30)]
    texts += [texts[1], texts[1], texts[2] + " end", None, "", "It's  Ünï 日本 <|endoftext|>"]
    docs = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)] + [(7, texts[3], "en", "s", 1), (None, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, i % 2) for i in range(20)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    talk = [(5, 2, "assistant", "b"), (5, 1, "user", "a"), (6, 1, "user", None), (5, 0, "system", "s")]
    spark.createDataFrame(talk, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def documents(spark, folder):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]


def test_op3_tells_what_was_said(spark, folder):
    said = "</s>[INST] ok [/INST]"
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in registry.op3_chat_formatting(spark, folder).collect()}
    assert got == {
        -1: (2, digest(f"user\n{said}\nassistant\n{said}\n"), len(said), digest(said)),
        5: (3, digest("system\ns\nuser\na\nassistant\nb\n"), 1, digest("b")),
        6: (1, digest("user\n\n"), 0, digest("")),
    }


def test_op4_digests(spark, folder):
    library = Tokenizer.from_file(f"{registry.TOKENIZERS}/byte_bpe_50k.json")
    want = []
    for key, text in documents(spark, folder):
        ids = library.encode(text, add_special_tokens=False).ids
        want.append((key, len(ids), digest(",".join(map(str, ids))), digest(library.decode(ids, skip_special_tokens=False))))
    assert rows("abcd", want) == rows("abcd", [tuple(r) for r in registry.op4_bpe_round_trip(spark, folder).collect()])


def test_op7_and_the_pipeline_pack_whole_documents(spark, folder):
    library = Tokenizer.from_file(f"{registry.TOKENIZERS}/word_bpe_49k.json")
    kept = spark.read.parquet(f"{folder}/documents.parquet")
    for query, docs in ((registry.op7_packing, None), (corpus_pipeline.run, "kept")):
        if docs:
            for _, stage in corpus_pipeline.STAGES[:-1]:
                kept = stage(spark, kept, folder)
        want = sorted([library.encode(r.text or "", add_special_tokens=False).ids + [1] for r in kept.collect()])
        pieces = query(spark, folder).collect()
        assert sum(r.length for r in pieces) == sum(map(len, want))
        whole = [r for r in pieces if r.start == 0 and r.length == r.doc_tokens]
        crc = sorted(zlib.crc32(np.array(x, "<u4").tobytes()) for x in want if len(x) <= 512)
        assert sorted(r.ids_crc32 for r in whole) == crc
        by_sequence = {}
        for r in pieces:
            by_sequence.setdefault(r.sequence_id, []).append(r)
        for own in by_sequence.values():
            own.sort(key=lambda r: r.offset)
            assert [r.offset for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist() and sum(r.length for r in own) <= 2048


def test_op8_and_op10_have_a_row_for_each(spark, folder):
    docs = documents(spark, folder)
    got = registry.op8_toxicity(spark, folder).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(k) for k, _ in docs)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    counts = registry.op10_token_counts(spark, folder).collect()
    assert rows("ab", [(r.doc_id, r.n_words) for r in counts]) == rows("ab", [(k, len(t.split())) for k, t in docs])


def test_the_pipeline_over_an_empty_table(spark, folder, tmp_path):
    empty = tmp_path / "empty"
    spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False)).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet(f"{folder}/labels.parquet").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
