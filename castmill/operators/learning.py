"""Title models as ML pipelines: features, detector, reranker, comparison; and a hook for a scorer of one's own."""

import time
from collections.abc import Callable, Iterator
from functools import reduce

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import title_flags
from ..sources.stages import written
from .metrics import classification_of, ndcg_at_k, ranked
from .titles import detector_rows

EXTRA = ["title_char_len", "title_word_count", "has_emoji", "has_hashtag", "has_number", "has_question", "has_exclaim", "upper_ratio"]


def engineered(df: DataFrame) -> DataFrame:
    """Sizes and flags of a title as doubles, and the number of its countries where there is one."""
    flags = {c: v.cast("double") for c, v in title_flags("title").items()}
    n = F.col("country_count").cast("double") if "country_count" in df.columns else F.lit(0.0)
    return df.withColumns(flags | {"country_feature": F.coalesce(n, F.lit(0.0))})


def title_stages(size: int = 1 << 12) -> list:
    """Stages from a title to one vector: hashed words weighted by IDF, beside the engineered features."""
    return [
        RegexTokenizer(inputCol="title", outputCol="_words", pattern=r"(?U)\W+", minTokenLength=1),
        HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size),
        IDF(inputCol="_tf", outputCol="_idf"),
        VectorAssembler(inputCols=["_idf", *EXTRA, "country_feature"], outputCol="features"),
    ]


def fit_encoder(rows: DataFrame, text: str = "text", size: int = 1 << 10) -> PipelineModel:
    """An encoder of texts as sparse vectors _vec of length 1 of the words by IDF over all rows (zero without words)."""
    stages = [RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"(?U)\W+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=size), IDF(inputCol="_tf", outputCol="_idf"), Normalizer(inputCol="_idf", outputCol="_vec")]
    return Pipeline(stages=stages).fit(rows)


def embed_text(rows: DataFrame, text: str = "text", size: int = 1 << 10) -> DataFrame:
    """rows with vec: the vector of fit_encoder as an array. Lines and summaries go through one call, so through one encoder."""
    return fit_encoder(rows, text, size).transform(rows).withColumn("vec", vector_to_array("_vec")).drop("_words", "_tf", "_idf", "_vec")


def train_detector(train: DataFrame, estimator=None) -> PipelineModel:
    """A binary model on the labelled rows."""
    last = estimator or LogisticRegression(labelCol="viral_label", regParam=0.01)
    return Pipeline(stages=[*title_stages(), last]).fit(engineered(detector_rows(train)))


def score_detector(model: PipelineModel, rows: DataFrame) -> DataFrame:
    """rows with viral_prob and viral_label (the likelier class)."""
    found = model.transform(engineered(rows.drop("viral_label")))
    prob = vector_to_array("probability")[1]
    return found.withColumns({"viral_prob": prob, "viral_label": F.col("prediction").cast("int")}).select(*[c for c in rows.columns if c != "viral_label"], "viral_prob", "viral_label")


def train_reranker(train: DataFrame, estimator=None) -> PipelineModel:
    """A regression on the viral score of all rows."""
    last = estimator or LinearRegression(labelCol="viral_score", regParam=0.1, elasticNetParam=0.0)
    return Pipeline(stages=[*title_stages(), last]).fit(engineered(train.where("viral_score is not null")))


def score_reranker(model: PipelineModel, rows: DataFrame, out: str = "predicted_score") -> DataFrame:
    found = model.transform(engineered(rows)).withColumn(out, F.col("prediction"))
    return found.select(*[c for c in rows.columns if c != out], out)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def model_size(model: PipelineModel) -> int:
    """Numbers that the last stage has learned: coefficients with the intercept, or a split or value for each node of its trees."""
    last = model.stages[-1]
    if hasattr(last, "trees"):
        return sum(t.numNodes for t in last.trees)
    return last.coefficients.size + 1 if hasattr(last, "coefficients") else getattr(last, "numNodes", 0)


def evaluate(scored: DataFrame, k: int = 10) -> DataFrame:
    """model, then accuracy, f1 and auc of its rows with a label, spearman, mse and ndcg at k of those with a target.

    scored holds all models' rows (model, label, prob, target, pred) in long form; each measure is one aggregate over all of them."""
    binary = ranked(scored.where("label is not null"), "prob", "model").groupBy("model").agg(*classification_of("label", "prob", "rank_prob"))
    real = scored.where("target is not null").select("model", "target", "pred")
    both = ranked(ranked(real, "target", "model"), "pred", "model").groupBy("model").agg(F.corr("rank_target", "rank_pred").alias("spearman"), F.avg(F.pow(F.col("target") - F.col("pred"), 2)).alias("mse"))
    return binary.join(both.join(ndcg_at_k(real, "model", "target", "pred", k), "model"), "model", "full_outer")


def compare_models(train: DataFrame, test: DataFrame, candidates: dict[str, object], k: int = 10) -> DataFrame:
    """One row a candidate: params, auc, f1 and accuracy of a classifier, or spearman, ndcg and mse of a regression, on test, and seconds of the fit.

    The fits run one after the other; all candidates' scores are then evaluated in one pass."""
    spark, rows, scores = train.sparkSession, [], []
    none = F.lit(None).cast("double")
    for name, estimator in candidates.items():
        began = time.time()
        if estimator.getLabelCol() == "viral_label":
            model = train_detector(train, estimator)
            found = model.transform(engineered(detector_rows(test)))
            own = (F.col("viral_label").cast("double").alias("label"), vector_to_array("probability")[1].alias("prob"), none.alias("target"), none.alias("pred"))
        else:
            model = train_reranker(train, estimator)
            found = model.transform(engineered(test.where("viral_score is not null")))
            own = (none.alias("label"), none.alias("prob"), F.col("viral_score").cast("double").alias("target"), F.col("prediction").alias("pred"))
        rows.append((name, model_size(model), time.time() - began))
        scores.append(found.select(F.lit(name).alias("model"), *own))
    every = written(reduce(DataFrame.unionByName, scores))
    about = spark.createDataFrame(rows, "model string, params long, seconds double")
    found = about.join(evaluate(every, k), "model", "left")
    return found.select("model", "params", "auc", "f1", "accuracy", "spearman", "ndcg", "mse", "seconds").orderBy(F.desc("auc"), F.desc("spearman"), "mse")


def batch_scorer(load: Callable[[], Callable[[list[str]], list[tuple[float, int, float]]]], max_tokens: int = 64):
    """A column function that scores texts by a model of one's own: load() runs once a task, its result on batches of texts.

    Texts are given by their first max_tokens words, as such models take no more."""

    @F.pandas_udf("viral_prob double, viral_label int, viral_score double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = load()
        for texts in batches:
            cut = [" ".join((t or "").split()[:max_tokens]) for t in texts]
            yield pd.DataFrame(model(cut), columns=["viral_prob", "viral_label", "viral_score"])

    return score
