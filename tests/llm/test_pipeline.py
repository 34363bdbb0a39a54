import pytest

import corpus_pipeline
from tabweave.llm import packing, quality, queries, simhash, suffix, toxicity


def documents():
    import random

    r = random.Random(11)
    word = lambda: "".join(r.choices(["an", "er", "th", "ou", "in", "re", "st"], k=r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = prose(80)
    rows = [(i, prose(r.randint(30, 300)), "en", f"s{i % 2}") for i in range(120)]
    rows += [(200 + i, rows[i][1], "en", "s0") for i in range(10)]  # copies
    rows += [(300 + i, prose(40) + " " + shared + " " + prose(40), "en", "s1") for i in range(8)]
    rows += [(400 + i, " ".join(f"{word()}&&&%%%" for _ in range(60)), "en", "s0") for i in range(6)]  # junk
    rows += [(500 + i, prose(60) + " idiot moron scum " + prose(20), "en", "s1") for i in range(30)]
    rows += [(600, None, None, None), (601, "", "en", "s0"), (602, "too short", "en", "s0")]
    return [(i, t, a, b, None if t is None else len(t)) for i, t, a, b in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("sf"))
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(500 <= r[0] < 600)) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return base


def test_stages_take_effect_and_keep_clean_documents(spark, folder, monkeypatch):
    monkeypatch.setattr(toxicity, "OFTEN", 5)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder).persist()
        assert docs.columns == columns, name
        ids[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        assert docs.count() == len(ids[name])
    clean = set(range(120)) | set(range(300, 308))
    assert clean <= ids["quality_rules"] and not ids["quality_rules"] & {*range(400, 406), 600, 601, 602}
    assert clean <= ids["toxicity"] and len(ids["toxicity"] & set(range(500, 530))) <= 2
    assert clean <= ids["simhash_dedup"] and not ids["simhash_dedup"] & set(range(200, 210))
    assert ids["suffix_dedup"] == ids["simhash_dedup"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    whole = {r[0]: r[1] for r in documents()}
    assert all(texts[i] == whole[i] for i in range(120))
    left = sorted(len(texts[i].split()) for i in range(300, 308))  # by chance a word next to the passage repeats with it
    assert all(76 <= n <= 80 for n in left[:7]) and left[7] == 160
    assert all(r.n_chars == len(r.text) for r in docs.collect())
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    assert {p.doc_id for p in pieces} == ids["suffix_dedup"]


def test_run_equals_the_stages_operators(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {r.doc_id for r in quality.judged(docs).where("kept").collect()}
    docs = docs.where(docs.doc_id.isin(list(kept)))
    model = toxicity.fit_on_labels(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    fine = {r.doc_id for r in toxicity.scored(docs, model).collect() if r.score < toxicity.THRESHOLD}
    docs = docs.where(docs.doc_id.isin(list(fine)))
    first = {r.id for r in simhash.simhash_groups(docs).collect() if r.id == r.component}
    docs = docs.where(docs.doc_id.isin(list(first)))
    rows = packing.pack(suffix.cut_repeats(docs), queries.word_tokenizer()).collect()
    want = sorted((p.id, p.start, p.length, p.ids_crc32) for p in rows)
    got = sorted((p.doc_id, p.start, p.length, p.ids_crc32) for p in corpus_pipeline.run(spark, folder).collect())
    assert got == want


def test_empty_table(spark, tmp_path):
    base = str(tmp_path)
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    assert corpus_pipeline.run(spark, base).count() == 0
