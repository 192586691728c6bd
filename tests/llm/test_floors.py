"""Least cosines come from every labelled text, whatever their number."""

import numpy as np

from proofloom.llm import language


def test_every_labelled_text_counts(spark, monkeypatch):
    texts = [f"{w} stone river meadow {k} quiet harbour" for k, w in enumerate(["winter", "summer", "autumn", "spring"] * 60)] + ["qzx jkv wqp"] * 24
    docs = spark.createDataFrame([(t, "en") for t in texts] + [("no label here", None), (None, "en")], "text string, lang string")
    langs, prototypes = language.train(docs)
    monkeypatch.setattr(language, "FLOOR_ROWS", 40, raising=False)  # a sample, if there is one, is small
    got = language.floors(docs, langs, prototypes)
    import pyarrow as pa

    best, cosine, band = language.Profiles(prototypes, language.SEED).best(pa.array(texts))
    want = np.full(language.BANDS, language.LEAST_COSINE)
    for b in range(language.BANDS):
        near = np.sort(cosine[(best >= 0) & (abs(band - b) <= 1)])
        if len(near):
            low = near[int(np.ceil(len(near) * language.FLOOR_SHARE)) - 1]
            want[b] = max(language.LEAST_COSINE, language.FLOOR_PART * np.floor(low * language.FLOOR_STEPS) / language.FLOOR_STEPS)
    assert np.allclose(got, want, atol=2 / language.FLOOR_STEPS) and (got > language.LEAST_COSINE).any()
