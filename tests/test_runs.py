import random

import pytest

from kinfold.config import EncoderConfig
from kinfold.plans import registry
from kinfold.plans import runs as R
from kinfold.sources.articles import read_articles, save_articles

WORDS = {"即時港聞": "harbour ferry tram bridge tower".split(), "體育": "match goal league coach striker".split()}


@pytest.fixture(scope="module")
def articles(spark, tmp_path_factory):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        cate = rng.choice(list(WORDS))
        text = " ".join(rng.choice(WORDS[cate] + ["shared", "common"]) for _ in range(30))
        rows.append((i, f"【{cate[-1]}{i % 3}（x】", text if i != 7 else "  ", cate))
    df = spark.createDataFrame(rows, "article_id long, title string, main_content string, category_publish_name string")
    path = str(tmp_path_factory.mktemp("articles") / "a.parquet")
    save_articles(df, path)
    return read_articles(spark, path)


@pytest.mark.parametrize("explicit", [False, True])
def test_whole_run(spark, articles, tmp_path, explicit):
    config = R.RunConfig(
        train_row=40,
        label="story" if explicit else "category_publish_name",
        validate_row=15,
        validation=True,
        encoder=EncoderConfig(compress_factor=3, num_epochs=1, verbose_step=1, batch_size=20),
    )
    path = str(tmp_path / "run")
    out = R.run(spark, articles, config, path, explicit=explicit, save_tsv=True)
    scores = {(r.kind, r.split, r.label_kind): r.auroc for r in out["auroc"].collect()}
    assert len(scores) == 12
    assert scores["tfidf", "train", "label_category_publish_name"] > 0.95
    assert out["similar"].count() == 5 and out["box"].count() == 24
    assert {m.split for m in out["metrics"].collect()} == {"train", "validate"}
    if not explicit:
        again = R.run(spark, articles, config, path, restore_data=True, restore_model=True)
        # The restored run goes on with the epochs and the history of the first.
        train = again["metrics"].where("split = 'train'").orderBy("epoch").collect()
        assert len({m.epoch for m in train}) == len(train) > out["metrics"].where("split = 'train'").count()
        assert train[-1].cost < train[0].cost
        keys = [r.key for r in spark.read.parquet(f"{path}/run_params").collect()]
        assert keys.count("train_row") == 2


def test_split_of_an_online_run(articles):
    config = R.RunConfig(train_row=10, validate_row=5, encoder=EncoderConfig(triplet_strategy="none"))
    bundle = R.prepare_online(articles, config)
    got = {r.article_id: r.split for r in bundle.articles.select("article_id", "split").collect()}
    assert got == {i: "train" if i < 55 else "validate" for i in range(45, 60)}


def test_registry_is_consistent():
    queries, oracles = registry.queries(), registry.oracles()
    assert set(oracles) <= set(queries) and len(queries) > 80
    assert set(queries) == set(oracles)
