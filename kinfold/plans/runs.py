"""Whole runs: prepare articles, train, encode, evaluate, compare."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.config import EncoderConfig
from kinfold.encoder.model import EncoderModel, save_encoded
from kinfold.encoder.training import DenoisingEncoder
from kinfold.operators import articles as A
from kinfold.operators import evaluate as E
from kinfold.operators import mining as M
from kinfold.operators import similarity as S
from kinfold.operators import vectorize as V
from kinfold.operators.noise import decay_noise
from kinfold.session import materialize
from kinfold.sources.articles import write_projector
from kinfold.sources.bundle import Bundle, feature_rows, write_params

LABELS = ("category_publish_name", "story")
SPLITS = ("train", "validate")


@dataclass(frozen=True)
class RunConfig:
    """Data settings of a run; ``encoder`` holds the model's."""

    train_row: int = 8000
    validate_row: int = 2000
    min_df: float = 0.0
    max_df: float = 0.99
    max_features: int | None = 10_000
    input_format: str = "binary"
    label: str = "category_publish_name"
    stop_words: str | list[str] | None = "english"
    validation: bool = False
    min_cate: int = 2
    max_cate: int | None = None
    encoder: EncoderConfig = field(default_factory=EncoderConfig)

    def __post_init__(self):
        if self.input_format not in ("binary", "tfidf") or self.label not in LABELS:
            raise ValueError(f"input_format must be binary or tfidf, label one of {LABELS}")


def labelled(articles: DataFrame, descending: bool) -> DataFrame:
    """Articles with integer labels and validity flags for story and category."""
    plain = articles.withColumn("_plain", F.col("category_publish_name"))
    plain = A.with_plain_category(plain, "_plain")
    out = A.label_valid(plain, "story", "label_story_valid")
    out = A.factorize(out, "story", "article_id", "label_story", descending, salt_on="article_id")
    out = A.label_valid(out, "category_publish_name", "label_category_publish_name_valid")
    out = A.factorize(out, "_plain", "article_id", "label_category_publish_name", descending, salt_on="article_id")
    return out.drop("_plain")


def _vectors(config: RunConfig, articles: DataFrame, roles: dict[str, str]):
    """Vocabulary fitted on the training anchors, and feature rows of all roles."""
    counted = {}
    for role, content in roles.items():
        tokens = V.tokenized(articles, "article_id", content, stop_words=config.stop_words, extra=["split"])
        counted[role] = materialize(V.counted(tokens, "article_id", ["split"]), "terms")
    train = counted["org"].filter(F.col("split") == "train")
    n_docs = train.count()
    vocab = V.fit_vocab(train, "article_id", config.min_df, config.max_df, config.max_features, n_docs)
    split = articles.select("article_id", "split")
    features = None
    for role, terms in counted.items():
        rows = V.vectorize(terms, vocab, "article_id", n_docs).join(split, "article_id")
        part = feature_rows(rows, F.col("split"), role)
        features = part if features is None else features.unionByName(part)
    idf = vocab.withColumn("idf", V.idf_of(n_docs, F.col("df")))
    return features, idf


def prepare_online(articles: DataFrame, config: RunConfig) -> Bundle:
    """The latest eligible articles, split by id, with labels and vectors."""
    rows = labelled(articles, descending=True)
    rows = A.eligible(rows, f"label_{config.label}_valid", config.encoder.triplet_strategy)
    rows = A.latest_split(rows, "article_id", config.train_row, config.validate_row)
    rows = materialize(rows, "articles")
    features, vocab = _vectors(config, rows, {"org": "main_content"})
    labels = rows.select("article_id", "label_story", "label_category_publish_name", "split")
    return Bundle(rows, features, labels, vocab)


def prepare_triplets(articles: DataFrame, config: RunConfig) -> Bundle:
    """Articles with a mined positive and negative, split by id, in three roles."""
    rows = A.eligible(labelled(articles, descending=False), f"label_{config.label}_valid")
    rows = materialize(rows, "eligible")
    mined = M.mine_triplets(
        rows, "article_id", f"label_{config.label}", "article_id", config.min_cate, config.max_cate, config.encoder.seed
    )
    valid = mined.filter(F.col("valid_triplet_data") == 1)
    valid = materialize(A.positional_split(valid, "article_id", config.train_row, config.validate_row), "articles")
    content = M.gather_triplet_content(valid, "article_id", "main_content", source=rows)
    content = materialize(content.join(valid.select("article_id", "split"), "article_id"), "content")
    roles = {"org": "main_content", "pos": "main_content_pos", "neg": "main_content_neg"}
    features, vocab = _vectors(config, content, roles)
    labels = valid.select("article_id", "label_story", "label_category_publish_name", "split")
    return Bundle(valid, features, labels, vocab)


def train_online(bundle: Bundle, config: RunConfig, resume_from: EncoderModel | None = None) -> EncoderModel:
    label = f"label_{config.label}"

    def rows(split: str) -> DataFrame:
        codes = bundle.labels.filter(F.col("split") == split).select("article_id", label)
        return bundle.rows(config.input_format, split).join(codes, "article_id")

    valid = rows("validate") if config.validation else None
    n_features = bundle.vocab.count()
    return DenoisingEncoder(config.encoder).fit(rows("train"), n_features, "article_id", label, valid, resume_from)


def train_triplets(bundle: Bundle, config: RunConfig, resume_from: EncoderModel | None = None) -> EncoderModel:
    def rows(split: str) -> DataFrame:
        out = None
        for role in ("org", "pos", "neg"):
            part = bundle.rows(config.input_format, split, role).select(
                "article_id", F.col("idx").alias(f"idx_{role}"), F.col("val").alias(f"val_{role}")
            )
            out = part if out is None else out.join(part, "article_id")
        return out

    valid = rows("validate") if config.validation else None
    n_features = bundle.vocab.count()
    return DenoisingEncoder(config.encoder).fit_triplets(rows("train"), n_features, "article_id", valid, resume_from)


def encode_bundle(model: EncoderModel, bundle: Bundle, config: RunConfig) -> DataFrame:
    """Codes of both splits; the input is scaled by the share kept in training."""
    out = None
    for split in SPLITS:
        rows = decay_noise(bundle.rows(config.input_format, split), config.encoder.corr_frac)
        part = model.transform(rows, "article_id").withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return out


def _all_kinds(bundle: Bundle, codes: dict[str, DataFrame], split: str) -> tuple[DataFrame, S.Kinds]:
    """The articles of a split with every kind of their vectors, in columns named by kind."""
    rows, kinds = None, {}
    for kind in ("tfidf", "binary"):
        part = bundle.rows(kind, split).select("article_id", F.col("idx").alias(f"idx_{kind}"), F.col("val").alias(f"val_{kind}"))
        rows = part if rows is None else rows.join(part, "article_id")
        kinds[kind] = (f"idx_{kind}", f"val_{kind}")
    for name, code in codes.items():
        own = code.filter(F.col("split") == split).select("article_id", F.col("embedding").alias(f"vec_{name}"))
        rows = rows.join(own, "article_id")
        kinds[name] = (None, f"vec_{name}")
    return rows, kinds


def score_kinds(bundle: Bundle, codes: dict[str, DataFrame]) -> DataFrame:
    """Score histogram per (kind, split, label): TF-IDF, binary and the given codes.

    ``codes`` are named ``(article_id, embedding, split)`` tables; articles
    without one of them are left out. One pass over the pairs of a split serves
    all kinds and labels.
    """
    labels = [f"label_{name}" for name in LABELS]
    out = None
    for split in SPLITS:
        lab = bundle.labels.filter(F.col("split") == split).select("article_id", *labels)
        rows, kinds = _all_kinds(bundle, codes, split)
        joined = materialize(rows.join(lab, "article_id"), "scored")
        part = S.score_histogram(joined, "article_id", labels, kinds=kinds).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return materialize(out, "histogram")


def evaluate(bundle: Bundle, codes: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``(auroc, box statistics)`` by kind, split and label."""
    hist = score_kinds(bundle, codes)
    by = ["kind", "split", "label_kind"]
    return E.auroc(hist, by), E.box_stats(hist, by)


def most_similar_report(bundle: Bundle, encoded: DataFrame, n: int = 5) -> DataFrame:
    """The first training articles with their best match by counts and by code; only these are compared with all."""
    rows, kinds = _all_kinds(bundle, {"embedding": encoded}, "train")
    shown = ["category_publish_name", "title"]
    rows = rows.join(bundle.articles.filter(F.col("split") == "train").select("article_id", *shown), "article_id")
    rows = materialize(rows, "articles")
    first = rows.select("article_id").orderBy("article_id").limit(n)
    chosen = {"count": kinds["binary"], "embedding": kinds["embedding"]}
    return S.similar_articles(rows, "article_id", shown, chosen, of=first).orderBy("article_id")


def run(
    spark: SparkSession,
    articles: DataFrame,
    config: RunConfig,
    path: str,
    explicit: bool = False,
    restore_data: bool = False,
    restore_model: bool = False,
    save_tsv: bool = False,
) -> dict[str, DataFrame]:
    """One run under ``path``: data, model, codes and results, each as tables."""
    if restore_data:
        bundle = Bundle.restore(spark, f"{path}/data")
    else:
        prepared = (prepare_triplets if explicit else prepare_online)(articles, config)
        prepared.save(f"{path}/data", mode="overwrite")
        bundle = Bundle.restore(spark, f"{path}/data")
    previous = EncoderModel.load(spark, f"{path}/model") if restore_model else None
    if previous is not None:
        previous.params()  # read before the folder is replaced
    model = (train_triplets if explicit else train_online)(bundle, config, previous)
    model.save(f"{path}/model", mode="overwrite")
    settings = {**asdict(config), **config.encoder.params()}
    settings.pop("encoder")
    write_params(spark, f"{path}/run_params", config.encoder.model_name, settings, append=restore_model)
    save_encoded(model, encode_bundle(model, bundle, config), f"{path}/codes", mode="overwrite")
    encoded = spark.read.parquet(f"{path}/codes/encoded")
    if save_tsv:
        for split in SPLITS:
            codes = encoded.filter(F.col("split") == split).select("article_id", F.col("embedding").alias("vec"))
            write_projector(codes, bundle.articles.filter(F.col("split") == split), "article_id", f"{path}/tsv/{split}")
    auroc, boxes = evaluate(bundle, {"encoded": encoded})
    return {"auroc": auroc, "box": boxes, "similar": most_similar_report(bundle, encoded), "metrics": model.metrics}


def compare_external(bundle: Bundle, external: DataFrame) -> DataFrame:
    """AUROC of an external tool's codes next to TF-IDF and binary vectors.

    ``external`` is ``(article_id, embedding, split)``.
    """
    return evaluate(bundle, {"external": external})[0]
