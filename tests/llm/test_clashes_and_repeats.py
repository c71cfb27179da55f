"""Repeated ids, clashing column names and odd signs: no row is lost, no caller's column is changed."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from alertweave.llm import minhash_dedup, packing, quality_classifier, substring_dedup

NAMES = ["text_key", "repeated_spans", "h", "p", "global_share", "host", "path", "kept", "n_words", "recipe", "row", "component_id"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in NAMES)


def prose(seed, n=150):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(2, 8))) for _ in range(n))


A, B, C = prose(1), prose(2), prose(3)
TEXTS = [(1, A), (1, B), (1, B), (2, B + " more"), (5, C), (5, A), (3, C + " end"), (None, A), (None, A), (7, None), (7, prose(4))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), *(f"{n}-{k}" for n in NAMES)) for k, (i, t) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def marks(rows):
    return sorted(tuple(r[n].split("-")[1] for n in NAMES) for r in rows)


def test_unlike_texts_of_one_id_keep_their_links(docs):
    got = minhash_dedup.near_duplicates(docs.select("doc_id", "text")).collect()
    component = {(r["doc_id"], r["component_id"]) for r in got}
    # 1 has A and B; 2 is like B; 5 has A and C; 3 is like C: all one component by their ids.
    assert component == {(1, 1), (2, 1), (5, 1), (3, 1), (None, None), (7, 7)}
    assert sorted(r["doc_id"] for r in got if r["kept"] and r["doc_id"]) == [1, 1, 1, 7, 7]


def test_near_dedup_loses_true_copies_only(spark, docs):
    left = corpus_pipeline.near_dedup(spark, docs, "")
    assert left.schema == docs.schema
    rows = left.collect()
    want = [(1, A), (1, B), (3, C + " end"), (None, A), (None, A), (7, None), (7, TEXTS[-1][1])]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in rows))) == sorted(map(repr, want))
    assert all(len({r[n].split("-")[1] for n in NAMES}) == 1 for r in rows)


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns_of_any_name(spark, tmp_path, docs, stage):
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    left = stage(spark, docs, str(tmp_path))
    assert left.schema == docs.schema
    assert all(len({r[n].split("-")[1] for n in NAMES}) == 1 and r["host"].startswith("host-") for r in left.collect())


def test_operators_keep_columns_of_any_name(spark, docs):
    cut = substring_dedup.cut(docs)
    assert all(r["text_key"].startswith("text_key-") and r["repeated_spans"].startswith("repeated_spans-") for r in cut.collect())
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1)], "doc_id long, quality int, toxic int")
    judged = quality_classifier.classified(docs, labels)
    assert all(r["h"].startswith("h-") and r["global_share"].startswith("global_share-") for r in judged.collect())
    assert judged.count() == len(TEXTS)


def test_signs_behind_odd_characters():
    path = str(public_tokenizers.path("word_bpe_49k.json"))
    tokenizer = Tokenizer.from_file(path)
    r = random.Random(6)
    odd = "\u0130\u0131\u0958\u0f43\ufb1d\ufb2a\u1e9e\u00df\u0345\u00aa\u2160\u24b6\u01c5\u0149\u0307\u0301\u200d\u00b2\u0e33\uff21"
    pool = [*odd, *"aZ9é日", *packing.SIGNS]
    texts = [" ".join("".join(r.choice(pool) for _ in range(r.randint(1, 5))) for _ in range(8)) for _ in range(4000)]
    texts += [f"{c}{s}" for c in odd for s in ("!!", ".", ",", "$.")] + [f"x{c}{s} y" for c in odd for s in ("!!", ".")]
    ids, begin = packing.token_ids(pa.array(texts), path)
    want = [e.ids + [1] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == want
    assert np.array_equal(np.diff(begin), [len(w) for w in want])
