"""The corpus pipeline on planted rows, and the registered queries' contract."""

from __future__ import annotations

import random

import corpus_pipeline
from anamnesis.llm.queries import ORACLES, QUERIES


def test_registered_queries():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]


def test_stages_keep_clean_rows_and_act_on_planted_ones(spark, tmp_path):
    rng = random.Random(1)
    text = lambda n: " ".join(f"w{rng.randrange(3000)}" for _ in range(n))
    docs, labels = [], []
    for i in range(200):
        bad = i % 5 == 0
        docs.append((i, text(40) + (" zonker " if bad else " ") + text(10), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    item = text(40)
    docs += [(300, docs[1][1], "en", "s", 1), (301, f"{text(30)} {item} {text(30)}", "en", "s", 1),
             (302, f"{text(20)} mail x.y@z.org {text(5)}", "en", "s", 1), (303, None, None, None, None), (304, "", "en", "s", 0),
             (None, text(12), "en", "s", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    given = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen, rows = [], given
    for _, stage in corpus_pipeline.STAGES[:-1]:
        rows = corpus_pipeline.cut_lineage(stage(spark, rows, str(tmp_path)))
        assert rows.columns == given.columns
        seen.append({r.doc_id: r.text for r in rows.collect()})
    toxic = {i for i in range(200) if i % 5 == 0}
    every = {i for i, *_ in docs}
    assert set(seen[0]) == every - toxic
    assert set(seen[1]) == every - toxic - {300}
    assert set(seen[2]) == every - toxic - {300, 301}
    assert set(seen[3]) == set(seen[2]) and "[EMAIL]" in seen[3][302] and "x.y@z.org" not in seen[3][302]
    assert {i for i in seen[3] if seen[3][i] != seen[2][i]} == {302}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(seen[3])
