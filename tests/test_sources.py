import pytest
from pyspark.sql import functions as F

from labelspring.functions import vectors
from labelspring.plans import newsgroups, tweets
from labelspring.plans.bayes import Params
from labelspring.plans.em import EMParams
from labelspring.sources import corpus, labeled_points, text


def test_files_become_documents_with_topic_and_id(spark, tmp_path):
    for topic, name, body in (("sci.space", "10", "Moon landing\nagain Moon"), ("rec.autos", "11", "x\nFast car")):
        (tmp_path / topic).mkdir(exist_ok=True)
        (tmp_path / topic / name).write_text(body)
    rows = newsgroups.read_messages(spark, f"{tmp_path}/*").collect()
    assert {(r.ID, r.topic, tuple(r.words)) for r in rows} == {
        ("10", "sci.space", ("moon", "landing", "again", "moon")),
        ("11", "rec.autos", ("fast", "car")),
    }
    lines = text.with_topic_and_id(text.read_lines_with_file(spark, f"{tmp_path}/*"))
    assert {(r.topic, r.value) for r in lines.collect()} == {
        ("sci.space", "Moon landing"), ("sci.space", "again Moon"), ("rec.autos", "x"), ("rec.autos", "Fast car"),
    }


def test_newsgroup_chain(spark, tmp_path):
    words = {"a": "apple pear plum", "b": "bolt screw nut"}
    train = spark.createDataFrame(
        [(str(i), t, w.split()) for t, w in words.items() for i in range(6)], "ID string, topic string, words array<string>"
    )
    test = spark.createDataFrame(
        [("1", "a", ["apple"]), ("2", "b", ["bolt"]), ("3", "unseen", ["nut"])],
        "ID string, topic string, words array<string>",
    )
    train, test = newsgroups.index_messages(train, test)
    newsgroups.write_messages(train, test, f"{tmp_path}/train", f"{tmp_path}/test", 3, 2)
    train, test = (corpus.read_corpus(spark, f"{tmp_path}/{p}") for p in ("train", "test"))
    assert sorted(r.ind for r in train.where("topic = 'a'").collect()) == list(range(6))
    assert {r.topic for r in test.collect()} == {"a", "b"}
    grid = newsgroups.experiment(train, test, Params(64, 0.01), (1, 4), 2, 3, EMParams(max_epoch=3)).collect()
    assert len(grid) == 4
    assert all(r.acc_sup == r.acc_em == 1.0 for r in grid)


def test_delimited_fields(spark, tmp_path):
    (tmp_path / "comma.txt").write_text('1,x,y,"0,z,good  day\n2,x\n')
    rows = text.read_comma_tweets(spark, f"{tmp_path}/comma.txt").collect()
    assert [(r.polarity, r.words) for r in rows] == [('"0', ["good", "", "day"]), (None, None)]
    (tmp_path / "tab.txt").write_text("1\t0\tu\tgood day\n")
    assert text.read_tab_tweets(spark, f"{tmp_path}/tab.txt").first().words == ["good", "day"]
    assert text.read_tab_tweets(spark, f"{tmp_path}/tab.txt", labelled=False).columns == ["words"]


def test_separator_is_plain_text(spark):
    row = spark.sql(f"SELECT {text.delimited_field(repr('a|b|c'), '|', 1)} AS f").first()
    assert row.f == "b"


def test_tweet_experiment(spark):
    labelled = spark.createDataFrame(
        [(p, w.split()) for i in range(60) for p, w in (("0", "bad awful sad"), ("4", "good great fine"))],
        "polarity string, words array<string>",
    )
    labelled = tweets.without_neutral(
        labelled.unionByName(spark.createDataFrame([('"2', ["meh"]), (None, ["null"])], labelled.schema))
    )
    assert labelled.count() == 120
    free = spark.createDataFrame([(["good", "great"],), (["bad", "sad"],)] * 20, "words array<string>")
    out = tweets.experiment(labelled, free, Params(100, 0.1), em=EMParams(max_epoch=2)).collect()
    assert sorted(r.share for r in out) == [0.7, 0.8, 0.9]
    assert all(r.acc_sup == r.acc_em == 1.0 and r.n_rows > 0 for r in out)


def test_points_roundtrip(spark, tmp_path):
    rows = spark.createDataFrame([(1, [0, 3], [2, 1]), (0, [], [])], "label int, buckets array<int>, counts array<int>")
    line = labeled_points.format_point(
        F.col("label"), 5, F.col("buckets"), F.col("counts"), F.expr(vectors.one_hot("label", 2)), F.lit(1.0)
    )
    lines = rows.select(line.alias("value"))
    assert {r.value for r in lines.collect()} == {
        "(1.0, (5,[0,3],[2.0,1.0]), [0.0,1.0], 1.0)", "(0.0, (5,[],[]), [1.0,0.0], 1.0)",
    }
    labeled_points.write_points(lines, f"{tmp_path}/points")
    back = {r.label: r for r in labeled_points.read_points(spark, f"{tmp_path}/points").collect()}
    assert (back[1.0]["size"], back[1.0].buckets, back[1.0]["values"], back[1.0].weight) == (5, [0, 3], [2.0, 1.0], [0.0, 1.0])
    assert back[0.0].buckets == [] and back[0.0]._corrupt is None


@pytest.mark.parametrize(
    "line, good",
    [
        ("(1.0, (3,[0],[2.0]), [1.0], 1.0)", True),
        (" ( 1 , [0.5, 2e1] , [1,0,] , -.5 , ) ", True),
        ("(1.0, (3,[0,],[2.0]), [1.0], 1.0)", True),
        ("(1.0,, (3,[0],[2.0]), [1.0], 1.0)", False),
        ("(1.0, (3,[,0],[2.0]), [1.0], 1.0)", False),
        ("(1.0, (3,[0],[2.0], [1.0], 1.0)", False),
        ("(1.0, (3,[0],[2.0]), [1.0], 1.0", False),
        ("(1.0, (3,[0],[2.0]), [one], 1.0)", False),
        ("(x, (3,[0],[2.0]), [1.0], 1.0)", False),
        ("(1.0, (3,[0,1],[2.0]), [1.0], 1.0)", False),
        ("", False),
    ],
)
def test_point_grammar(spark, line, good):
    row = labeled_points.parse_points(spark.createDataFrame([(line,)], "value string")).first()
    assert (row._corrupt is None) == good
    assert (row.label is not None) == good


def test_parquet_sink_file_count(spark, tmp_path):
    corpus.write_corpus(spark.range(100), f"{tmp_path}/out", files=5)
    assert len(list((tmp_path / "out").glob("part-*.parquet"))) == 5
    assert corpus.read_corpus(spark, f"{tmp_path}/out").count() == 100


def test_labeled_points_reject_bad_indices(spark):
    from labelspring.sources.labeled_points import parse_points

    bad = [
        "(1.0,(10,[3000000000],[1.0]),[1.0],1.0)", "(1.0,(10,[99],[1.0]),[1.0],1.0)",
        "(1.0,(10,[3,1],[1.0,2.0]),[1.0],1.0)", "(1.0,(10,[1.7],[1.0]),[1.0],1.0)", "(1.0,(10,[1],[NaN]),[1.0],1.0)",
    ]
    rows = parse_points(spark.createDataFrame([(x,) for x in bad], "value string")).collect()
    assert sorted(r._corrupt for r in rows) == sorted(bad)
    good = parse_points(spark.createDataFrame([("(1.0,(10,[1,3],[1.0,2.0]),[1.0],1.0)",)], "value string")).first()
    assert good._corrupt is None and good.buckets == [1, 3]
