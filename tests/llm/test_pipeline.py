import random

import corpus_pipeline as pipeline
from penstroke.llm.secrets import base_spans
from tests.llm.test_operators import components_by_hand, prose


def test_stages_take_effect_and_pass_the_rest(spark, tmp_path):
    r, texts = random.Random(2), prose(120, 21, 30, 80)
    toxic = [i for i in range(120) if i % 4 == 0]
    for i in toxic:
        w = texts[i].split()
        w[2], w[7] = "foulword", "vileword"
        texts[i] = " ".join(w)
    rows = [(i, t) for i, t in enumerate(texts)]
    for i in range(1, 40, 4):  # near copies of clean ones
        w = texts[i].split()
        w[-1] = "changed"
        rows.append((200 + i, " ".join(w)))
    rows += [(300, texts[3]), (301, None), (302, ""), (None, "no id here at all"), (303, "my secret = 'abcdef123456' stays hidden " + texts[5][:0] + " ".join(r.sample(texts[5].split(), 20)))]
    spark.createDataFrame([(i, t, "en", "s", len(t or ""), "extra") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, spans string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i in toxic), 1) for i in range(120)], "doc_id long, toxic int, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.collect()
        assert name == "packing" or docs.columns == pipeline.COLUMNS
    clean = {i for i, _ in rows} - set(toxic)
    assert {x["doc_id"] for x in seen["toxicity"]} == clean
    kept_rows = [(x["doc_id"], x["text"]) for x in seen["toxicity"]]
    roots = {d for d, _, c in components_by_hand(kept_rows, pipeline.WIDTH) if d == c} | {"None"}
    assert {str(x["doc_id"]) for x in seen["near_duplicates"]} == roots
    masked = {x["doc_id"]: x for x in seen["secrets"]}
    assert "<secret>" in masked[303]["text"] and masked[303]["n_chars"] == len(masked[303]["text"])
    assert not any(base_spans(x["text"] or "") for x in seen["secrets"]) and len(masked) == len(roots)
    assert {x["doc_id"] for x in seen["packing"]} == set(masked)
    whole = pipeline.run(spark, str(tmp_path))
    assert sorted((x["doc_id"] or -1, x["piece"], x["length"], x["ids_crc32"]) for x in whole.collect()) == sorted((x["doc_id"] or -1, x["piece"], x["length"], x["ids_crc32"]) for x in seen["packing"])


def test_near_duplicates_go_by_text_where_ids_repeat(spark, tmp_path):
    a, b, c = prose(3, 9, 60, 60)
    rows = [(7, a), (7, b), (7, b), (3, a + " more"), (None, c), (None, c + " more"), (9, ""), (None, None), (4, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [x["text"] for x in pipeline.near_duplicates(spark, docs, "").collect()]
    assert sum(t in (a, a + " more") for t in got) == 1 and got.count(b) == 1 and sum(t in (c, c + " more") for t in got) == 1
    assert len(got) == 5
    assert pipeline.near_duplicates(spark, docs.limit(0), "").count() == 0
