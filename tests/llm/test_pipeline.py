"""The pipeline's stages against brute force on a small table."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from melisma.llm.common import written

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, host string, group_id long"


def jaccard(a, b):
    s, t = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.lower().split(), b.lower().split()))
    return len(s & t) / len(s | t)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, prose):
    d = tmp_path_factory.mktemp("tables")
    base = [prose(200, i, 50_000) for i in range(12)]
    items = [prose(30, 500 + i, 50_000) for i in range(3)]
    key = "0123456789abcdef" * 2
    texts = [*base, base[0], base[1].replace(base[1].split()[50], "other"), base[2] + " " + items[0], "too short", "", None, prose(120, 90, 50_000) + f" token = {key} " + prose(60, 91, 50_000), prose(200, 92, 50_000) + " " + items[1][: items[1].rindex(" ")], prose(9000, 93, 50_000)]
    rows = [(i, t, "en", f"s{i % 2}", None if t is None else len(t), "clash", 7) for i, t in enumerate(texts)]
    rows += [rows[4], (None, base[5], "en", "s0", 1, "clash", 7)]
    random.Random(1).shuffle(rows)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)) + [(9, None)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return str(d), texts, items, key


def test_stages_against_brute_force(spark, tables):
    d, texts, items, key = tables
    docs, left = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        docs = written(out, name)
        left.append(docs.collect())
    kept = {i for i, t in enumerate(texts) if t and len(t.split()) >= 50}
    assert {r["doc_id"] for r in left[0]} == kept
    one = {i for i in kept if not any(j < i and jaccard(texts[i], texts[j]) >= 0.8 for j in kept)}
    assert sorted(r["doc_id"] for r in left[1]) == sorted(one) and {12, 13} & one == set()
    clean = {i for i in one if not any(" ".join(x.split()[:20]) in texts[i] for x in items)}
    assert sorted(r["doc_id"] for r in left[2]) == sorted(clean) and 14 not in clean and 19 not in clean
    masked = {r["doc_id"]: r["text"] for r in left[3]}
    assert set(masked) == clean and key not in masked[18] and all(r["n_chars"] == len(r["text"]) for r in left[3])
    assert all(masked[i] == texts[i] for i in clean - {18})


def test_pieces_hold_every_token_of_the_kept_texts(spark, tables):
    d, texts, *_ = tables
    ids = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    got: dict[int, int] = {}
    for r in corpus_pipeline.run(spark, d).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
        assert 0 < r["length"] <= 1024 and r["offset"] + r["length"] <= 1024
    assert 12 not in got and 13 not in got and 14 not in got and 20 in got
    assert all(n == len(ids.encode(texts[i], add_special_tokens=False).ids) + 1 for i, n in got.items() if i != 18)


def test_no_documents(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
