"""The pipeline's stages against what each may keep, change and return."""

import re

import corpus_pipeline
from pyspark.sql import functions as F

from tsengine.llm import stages


def test_stages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").cache()
    columns = docs.columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    good = stages.keep_good(spark, docs, sf).cache()
    assert good.columns == columns
    lost = docs.join(good, "doc_id", "left_anti").join(labels, "doc_id")
    assert lost.filter("quality = 1").count() <= 0.02 * labels.filter("quality = 1").count()
    assert good.join(labels, "doc_id").filter("quality = 0").count() <= 0.1 * labels.filter("quality = 0").count()

    one = stages.one_of_each_group(spark, good, sf).cache()
    sets = {}
    for r in good.collect():
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", (r["text"] or "").lower()) if x]
        sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    kept = {r["doc_id"] for r in one.select("doc_id").collect()}
    linked = lambda a, b: sets[a] and sets[b] and len(sets[a] & sets[b]) * 5 >= 4 * len(sets[a] | sets[b])
    order = sorted(sets)
    lost_ids = set(order) - kept
    for a in lost_ids:
        assert any(linked(a, b) for b in order if b != a)
    keep = sorted(kept)
    assert not any(linked(a, b) for i, a in enumerate(keep) for b in keep[:i])

    clean = stages.keep_uncontaminated(spark, one, sf)
    assert clean.columns == columns and clean.count() < one.count()
    safe = stages.redact_secrets(spark, clean, sf).cache()
    assert safe.count() == clean.count() and safe.columns == columns
    assert safe.filter(F.col("text").rlike("AKIA[A-Z0-9]{16}")).count() == 0
    assert safe.filter(F.length("text") != F.col("n_chars")).count() == 0
    out = stages.encode(spark, safe, sf)
    assert out.count() == safe.count() and "piece_ids" in out.columns


def test_repeated_and_null_ids(spark):
    t = "one two three four five six seven eight nine ten"
    rows = [(1, t), (1, t), (2, t + " x"), (3, "else entirely different words stand here now"), (None, "q w e r t y"), (4, None)]
    d = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = stages.one_of_each_group(spark, d, "").collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 1, 3, 4]


def test_copies_are_told_by_row(spark):
    t, u = "one two three four five six seven eight nine ten", "of all that was here nothing else is left to see now"
    v = "red green blue white black brown grey pink teal gold"
    rows = [(5, t), (5, u), (5, "a b c d e f g h"), (2, t + " x"), (None, v), (None, v + " y"), (None, v), (None, u), (7, "m n o p q r s t"), (7, "m n o p q r s t"), (8, " "), (8, None), (8, None), (None, ""), (None, "")]
    d = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = stages.one_of_each_group(spark, d, "")
    assert got.columns == d.columns
    found = sorted((str(r["doc_id"]), str(r["text"])) for r in got.collect())
    of_v = [x for x in found if x[1].startswith("red")]
    assert len(of_v) == 1 and of_v[0][0] == "None"
    want = [(5, u), (5, "a b c d e f g h"), (2, t + " x"), (7, "m n o p q r s t"), (8, " "), (8, None), (None, ""), (None, "")]
    assert sorted(set(found) - set(of_v)) == sorted({(str(i), str(x)) for i, x in want}) and len(found) == len(want) + 1


def test_last_stage_keeps_the_decoded_text(spark):
    import public_tokenizers
    import sentencepiece

    texts = ["one  two\tthree", "", None, "ñandú 密码 😀 <s>", "a long text " * 200_000, "end\n"]
    d = spark.createDataFrame([(i, x, "en", "s", 1) for i, x in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").coalesce(1)
    got = {r["doc_id"]: r for r in stages.encode(spark, d, "").collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        ids = library.encode(x or "") + [library.eos_id()]
        assert got[i]["piece_ids"] == ids and got[i]["decoded"] == library.decode(ids)


def test_stage_list():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "secrets", "pieces"]
