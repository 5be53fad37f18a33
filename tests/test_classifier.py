import pytest

from labelspring import storage
from labelspring.plans import bayes, em
from labelspring.plans.classifier import Settings, TextClassifier

DOCS = [
    (1, "red apple sweet fruit", "food", 9), (2, "sweet ripe pear fruit", "food", 8), (3, "fast engine wheel car", "car", 7),
    (4, "car wheel tyre road", "car", 6), (5, "engine road fast car", None, 5), (6, "fruit pear apple", None, 4), (7, None, None, 3), (8, "", "food", 2),
]
PARAMS = bayes.Params(n_features=256, smoothing=0.1)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, text string, kind string, prediction int")


@pytest.mark.parametrize("expectation,way", [(None, "inline"), (em.EMParams(max_epoch=3), "joined")])
def test_saved_classifier_predicts_the_same(spark, docs, tmp_path, expectation, way):
    settings = Settings(label="kind", way=way)
    fitted = TextClassifier.fit(docs, PARAMS, settings, expectation)
    path = str(tmp_path / "model")
    fitted.save(path)
    loaded = TextClassifier.load(spark.newSession(), path)
    assert loaded.settings == settings and loaded.model.params == fitted.model.params
    got = {r.doc_id: r.guess for r in fitted.transform(docs, "guess").collect()}
    other = spark.newSession().createDataFrame(DOCS, docs.schema)
    back = loaded.transform(other, "guess")
    assert back.columns == [*docs.columns, "guess"]
    assert {r.doc_id: r.guess for r in back.collect()} == got
    assert got[5] == "car" and got[6] == "food" and set(got.values()) == {"car", "food"}


def test_prediction_column_is_replaced(docs):
    out = TextClassifier.fit(docs, PARAMS, Settings(label="kind")).transform(docs)
    assert out.columns == ["doc_id", "text", "kind", "prediction"] and dict(out.dtypes)["prediction"] == "string"


def test_incomplete_and_unknown_folders(spark, docs, tmp_path):
    fitted = TextClassifier.fit(docs, PARAMS, Settings(label="kind"))
    path = str(tmp_path / "model")
    fitted.save(path)
    with pytest.raises(FileExistsError):
        fitted.save(path)
    record = storage.read_record(spark, f"{path}/record")
    storage.write_record(spark, f"{path}/record", {**record, "format": 99})
    with pytest.raises(ValueError, match="99"):
        TextClassifier.load(spark, path)
    storage.remove(spark, f"{path}/record")
    with pytest.raises(FileNotFoundError):
        TextClassifier.load(spark, path)
    assert storage.children(spark, path) == ["cells", "codes"] and storage.children(spark, f"{path}/none") == []
