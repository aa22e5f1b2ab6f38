from __future__ import annotations

import random
import re

import corpus_pipeline
from tallyframe.llm.common import written

BENCH = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def corpus(spark, path):
    """Clean documents beside planted ones: toxic, copied, contaminated, with personal data."""
    rng = random.Random(3)
    syll = ["ta", "ri", "mo", "len", "sha", "ve", "un", "dor", "pi", "ka"]
    text = lambda n=80: " ".join("".join(rng.choice(syll) for _ in range(rng.randint(1, 4))) for _ in range(n))
    rows, labels = [], []
    for i in range(400):
        toxic = i % 8 == 0
        t = text(60) + " grubbish snarkle " + text(5) + " snarkle" if toxic else text()
        rows.append((i, t))
        labels.append((i, int(toxic)))
    clean = [i for i, _ in rows if i % 8]
    long = text(400)
    rows += [(1000, long), (1001, long), (1002, long + " end")]
    rows += [(1100, text(30) + " " + BENCH.upper() + ", " + text(30)), (1200, text(30) + " write to jo.doe@mail.example.com now"), (1300, None), (1301, "")]
    spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, x) for i, x in labels], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, BENCH)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return clean


def test_each_stage_does_its_work_and_keeps_clean_documents(spark, tmp_path):
    d = str(tmp_path)
    clean = corpus(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, ids = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, d), f"test-{name}")
        ids[name] = sorted(r["doc_id"] for r in docs.collect())
        if name != "packing":
            assert docs.columns == columns
        if name == "personal_data":
            text = docs.filter("doc_id = 1200").first()["text"]
            assert "[EMAIL]" in text and "@" not in text
    everything = {*range(400), 1000, 1001, 1002, 1100, 1200, 1300, 1301}
    assert everything - set(ids["toxicity"]) == {i for i in range(400) if i % 8 == 0}
    assert set(ids["toxicity"]) - set(ids["near_duplicates"]) == {1001, 1002, 1301}
    assert set(ids["near_duplicates"]) - set(ids["decontamination"]) == {1100}
    assert ids["personal_data"] == ids["decontamination"] and set(clean) <= set(ids["personal_data"])
    assert set(ids["packing"]) == set(ids["personal_data"])
    whole = corpus_pipeline.run(spark, d)
    assert whole.count() == len(ids["packing"]) and not re.search("oracle", str(corpus_pipeline.ORACLE_SQL))
