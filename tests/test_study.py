import random

from lexdrift.operators.train import W2VSettings
from lexdrift.operators.usages import HashEncoder
from lexdrift.plans.study import Study, texts_to_vectors, usages_to_drift, vectors_to_drift


def test_texts_to_drift_tables(spark, tmp_path):
    rng = random.Random(1)
    words = [f"term{chr(97 + k)}" for k in range(16)]
    rows = [(f"c{y}{k}", y, "ok" if k else "error", [" ".join(rng.choice(words) for _ in range(30)) for _ in range(4)]) for y in range(2000, 2006) for k in range(6)]
    texts = spark.createDataFrame(rows, "celex string, year int, status string, paragraphs array<string>")
    study = Study(start=2000, end=2005, skip_phrases=True, w2v=W2VSettings(vector_size=4, min_count=2, epochs=1), min_slices_global=1, min_slices_analysis=1, k=3, min_percentile=1, min_years=2, min_usages=2, min_steps=2, dip_usages=4, anchor_years=(2000, 2001))
    tables = texts_to_vectors(spark, texts, str(tmp_path), study)
    assert tables["aligned"].select("slice").distinct().count() == 2
    out = vectors_to_drift(spark, tables, str(tmp_path), study)
    assert out["shifts"].count() == 16 and out["frequency_drift"].count() > 0
    again = texts_to_vectors(spark, texts.limit(0), str(tmp_path), study)  # all stages are there
    assert again["counts"].count() == tables["counts"].count()
    paras = texts.selectExpr("celex", "year", "posexplode(paragraphs) as (para_idx, text)")
    found = usages_to_drift(spark, paras, spark.createDataFrame([(w,) for w in words[:3]], "word string"), HashEncoder(8), str(tmp_path / "u"), study)
    assert found["centroid_drift"].count() == 18 and found["monosemy"].count() == 3
