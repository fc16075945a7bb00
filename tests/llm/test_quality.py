import numpy as np
import pytest

from locusloom.llm import quality


@pytest.fixture(scope="module")
def net():
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("etaoinsr"), rng.integers(2, 9)))
    good = [" ".join(word() for _ in range(60)) for _ in range(60)]
    bad = [" ".join(word() + "%%%" for _ in range(60)) for _ in range(60)]
    return quality.train([quality.chunks_of(t.encode()) for t in good + bad], np.repeat([1.0, 0.0], 60)), good, bad


def test_learns_a_local_pattern_anywhere(net):
    model, good, bad = net
    tables = model.tables()
    late = ["ton " * 2000 + "%%%".join(["sin"] * 300)]
    scores = quality.score_texts([t.encode() for t in good + bad + late], model, tables)
    assert scores[:60].min() > 0.5 > scores[60:120].max()
    assert scores[120] < scores[:60].min()


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1023, 1024, 1025, 1920, 5000])
def test_chunks_cover_every_byte_and_slices_agree(net, monkeypatch, n):
    text = bytes(np.random.default_rng(n).integers(1, 255, n, dtype=np.uint8))
    rows = quality.chunks_of(text)
    step = quality.CHUNK - quality.OVERLAP
    covered = np.zeros((len(rows) - 1) * step + quality.CHUNK, np.uint8)
    for i, row in enumerate(rows):
        covered[i * step : i * step + quality.CHUNK] = row
    assert covered[:n].tobytes() == text and not covered[n:].any()
    model = net[0]
    whole = quality.score_texts([text, b"x", text], model, model.tables())
    monkeypatch.setattr(quality, "SLICE_BYTES", quality.CHUNK)
    assert np.allclose(whole, quality.score_texts([text, b"x", text], model, model.tables()))
    # the plain way: pool every chunk at once
    pooled = np.maximum(model.responses(rows, model.tables()).max(axis=1) + model.bias, 0)
    logit = np.concatenate([pooled.mean(axis=0), pooled.max(axis=0)]) @ model.weight + model.offset[0]
    assert whole[0] == pytest.approx(1 / (1 + np.exp(-np.clip(logit, -60, 60))), rel=1e-5)


def test_held_out_accuracy(spark):
    from locusloom.llm.registry import QUERIES

    sf_dir = "/root/testdata/sf0.1"
    got = QUERIES["op6_quality"](spark, sf_dir).filter("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").toPandas()
    assert (got.predicted == got.quality).mean() > 0.96
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.98


def test_odd_rows(spark, documents, odd_rows):
    labels = spark.createDataFrame([(1, 1, 0), (5, 1, 0), (6, 0, 0), (7, 0, 0), (8, None, 0), (500, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(documents(odd_rows), labels).collect()
    assert len(got) == len(odd_rows) and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if not r.text}) == 1
    none = quality.classify(documents(odd_rows), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(documents([]), labels).count() == 0
