"""The pipeline on small tables: every stage against a brute-force version of its decision."""

import base64

import pytest

import corpus_pipeline
from crestline.llm import quality

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")
ITEM = "seven bright stars shine above the quiet northern village while old clocks count the slow winter hours"


def test_pipeline(spark, tmp_path):
    rows = [(i, f"A calm sentence number {i} tells of river{i} and hill{i}, then of field{i}. " * 4) for i in range(40)]
    rows += [(i, f"Of### junk{i}$$$ " * 30) for i in range(40, 80)]
    rows += [(80, rows[3][1]), (81, "A quiet start, then " + ITEM + " and a calm end."), (82, rows[5][1] + 'Then token = "abcdef0123456789".'), (83, None), (84, "")]
    docs = spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, int(i < 40), 0) for i in range(80)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    sf = f"file://{tmp_path}"
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = {r.doc_id for r in quality.score(docs, quality.fit(docs, labels)).where("predicted = 1").collect()}
    assert set(range(40)) <= good and not good & set(range(40, 80))
    want = good - {80, 81}
    if 82 in want and 5 in want:  # near copies: the smaller id stays if they link
        a, b = (set(zip(*(t.lower().split()[k:] for k in range(5)))) for t in (rows[5][1], rows[82][1]))
        if 100 * len(a & b) >= 80 * len(a | b):
            want -= {82}
    assert set(got) == want
    path = P.path("byte_bpe_50k.tiktoken")
    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(path, "rb"))}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = {i: (t or "").replace('token = "abcdef0123456789', "[SECRET]") for i, t in rows}
    assert all(r.ids == own.encode_ordinary(texts[i]) and r.exact for i, r in got.items())


def test_classes_by_row(spark):
    words = [f"w{k}" for k in range(40)]
    texts = {"a": " ".join(words), "b": "another text that shares the id of the first and nothing else at all", "c": "a single text without any id stays", "d": "two rows without an id hold this one text"}
    rows = [(5, texts["a"]), (2, texts["a"] + " near"), (2, texts["b"]), (None, texts["a"]), (None, texts["c"]), (None, texts["d"]), (None, texts["d"]), (None, ""), (7, None), (7, "\u00a0")]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = sorted(((r.doc_id or 0), r.text or "") for r in corpus_pipeline.jaccard_classes(spark, docs, "").collect())
    assert got == sorted([(2, texts["a"] + " near"), (2, texts["b"]), (0, texts["c"]), (0, texts["d"]), (0, ""), (7, ""), (7, "\u00a0")])


def test_decontamination_by_row(spark, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame([(None, "so " + ITEM), (3, "so " + ITEM), (3, "a clean text"), (None, "another clean text")], "doc_id long, text string")
    got = sorted(r.text for r in corpus_pipeline.decontamination(spark, docs, f"file://{tmp_path}").collect())
    assert got == ["a clean text", "another clean text"]
