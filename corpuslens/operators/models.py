"""Model-backed operators on MLlib: a train-on-synthetic / test-on-real text
classifier, silver labels, hashed featuriser; topic words.

Model fits are distributed MLlib estimators; only bounded model state reaches
the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .classify import argmax_label, multiclass_metrics

# Short stop-word list for topic preprocessing.
TOPIC_STOPWORDS = ("the and for are but not you all any can had her was one our out his has him how its may "
                   "new now old see two way who did get let say she too use that with have this will your from "
                   "they know want been good much some time very when come here just like long make many more "
                   "only over such take than them well were what which their there these those would could "
                   "should about after again also because before being between both each into most other same "
                   "then through under until while where why").split()


def topic_tokens(text: Column, stopwords=TOPIC_STOPWORDS, min_len: int = 3) -> Column:
    """Lower-case, strip tags, punctuation and digits, keep words of at least
    ``min_len`` characters that are not stop words."""
    t = F.lower(text)
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    t = F.regexp_replace(t, r"(?U)[^\w\s]|_|\d", " ")
    words = F.filter(F.split(t, r"(?U)\s+"), lambda w: F.length(w) >= min_len)
    return F.filter(words, lambda w: ~w.isin(list(stopwords)))


def text_features(text_col: str = "text", num_features: int = 1 << 18):
    """Stages: lower-cased word tokens -> hashed term frequencies -> IDF."""
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    return [RegexTokenizer(inputCol=text_col, outputCol="_words", pattern=r"(?U)\w\w+", gaps=False),
            HashingTF(inputCol="_words", outputCol="_tf", numFeatures=num_features),
            IDF(inputCol="_tf", outputCol="features")]


def train_classifier(train: DataFrame, *, text_col: str = "text", label_col: str = "label",
                     max_iter: int = 30, reg: float = 0.01):
    """MLlib pipeline (hashed TF-IDF + logistic regression) fitted on ``train``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    lr = LogisticRegression(featuresCol="features", labelCol=label_col, maxIter=max_iter, regParam=reg)
    return Pipeline(stages=text_features(text_col) + [lr]).fit(train)


def predict(model, df: DataFrame, *, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """(id, ground, predicted) prediction table."""
    return model.transform(df).select(id_col, F.col(label_col).cast("int").alias("ground"),
                                      F.col("prediction").cast("int").alias("predicted"))


def train_on_synthetic_test_on_real(syn: DataFrame, real_train: DataFrame, real_test: DataFrame, *,
                                    text_col: str = "text", label_col: str = "label",
                                    id_col: str = "id") -> DataFrame:
    """Metrics of three training regimes evaluated on the real test split:
    (training_data, metric, score) - real only, synthetic only, augmented."""
    regimes = {"real": real_train, "synthetic": syn, "augmented": real_train.unionByName(syn)}
    out = None
    for name, tr in regimes.items():
        m = train_classifier(tr, text_col=text_col, label_col=label_col)
        met = multiclass_metrics(predict(m, real_test, id_col=id_col, label_col=label_col))
        long = met.select(F.lit(name).alias("training_data"), F.inline(F.array(*[
            F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("score"))
            for c in ("accuracy", "precision", "recall", "f1_macro")])))
        out = long if out is None else out.unionByName(long)
    return out


def silver_labels(model, df: DataFrame, *, out_col: str = "annotated_label") -> DataFrame:
    """Label unlabelled rows with a fitted classifier (argmax of probabilities)."""
    from pyspark.ml.functions import vector_to_array
    scored = model.transform(df)
    return scored.withColumn(out_col, argmax_label(vector_to_array("probability"))).drop(
        *[c for c in scored.columns if c.startswith("_") or c in ("features", "rawPrediction", "probability",
                                                                   "prediction")])


def hashed_embeddings(df: DataFrame, *, text_col: str = "text", dims: int = 64, num_features: int = 1 << 10):
    """Fallback sentence embeddings: hashed TF-IDF projected to ``dims`` with PCA.
    The texts are read once; the fits and every later read take the written counts."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import vector_to_array
    words, counts, idf = text_features(text_col, num_features)
    hashed = materialise(counts.transform(words.transform(df)).drop(words.getOutputCol()), "hashed-counts")
    pipe = Pipeline(stages=[idf, PCA(k=dims, inputCol="features", outputCol="_emb")]).fit(hashed.select("_tf"))
    return pipe.transform(hashed).withColumn("embedding", vector_to_array("_emb").cast("array<float>"))


def quality_report(rows: list[tuple[str, str, str, DataFrame, str]]) -> DataFrame:
    """Union of (run, metric, corpus, value) rows taken from one-row result frames:
    each entry is (run, metric, corpus, frame, column)."""
    out = None
    for run, metric, corpus, df, col in rows:
        one = df.select(F.lit(run).alias("run"), F.lit(metric).alias("metric"), F.lit(corpus).alias("corpus"),
                        F.round(F.col(col).cast("double"), 3).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out
