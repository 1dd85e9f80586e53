"""Model operators: pipelines, calibration, fusion, leakage and ablation.

Every query trains on a hashed 80 % of its table and returns metric rows of the
rest.  Vocabularies are bounded by a parameter; the queries run with its default.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial
from multiprocessing.pool import ThreadPool

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import IDF, CountVectorizer, CountVectorizerModel, ElementwiseProduct, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer, StandardScaler, StringIndexer, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import lexicons as lx
from ..functions.dialect import SPARK
from ..operators.texts import text_format_features, text_url_features
from ..operators.urls import url_features
from ..plans.catalogue import query, run_sql
from ..runtime import durable

SEED = 42


def part_of(key: Column, test_share: float = 0.2, seed: int = SEED) -> Column:
    """train or test, by a hash of the key: the same on any cluster."""
    return F.when(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(10_000)) < int(test_share * 10_000), "test").otherwise("train")


def with_class_weight(df: DataFrame, label: str = "label") -> DataFrame:
    """Weights n / (2 n_c), from a count of the two classes; a missing class counts 1."""
    n = {r[label]: r["count"] for r in df.groupBy(label).count().collect()}
    weight = F.lit(1.0)
    for value, count in n.items():
        weight = F.when(F.col(label) == value, sum(n.values()) / (2 * count)).otherwise(weight)
    return df.withColumn("weight", weight)


def positive(probability: str = "probability") -> Column:
    return vector_to_array(F.col(probability))[1]


def metrics(scored: DataFrame, model: str, label: str = "label", score: str = "score", by: Column | None = None) -> DataFrame:
    """Counts and rates at 0.5, one row for each group."""
    y, p = F.col(label) == 1, F.col(score) >= 0.5
    n = lambda c: F.count_if(c)
    rows = scored.groupBy((by if by is not None else F.lit("all")).alias("part")).agg(
        F.count(F.lit(1)).alias("n"), n(y & p).alias("tp"), n(~y & p).alias("fp"), n(y & ~p).alias("fn"), n(~y & ~p).alias("tn")
    )
    rate = lambda a, b: F.when(b == 0, 0.0).otherwise(F.round(a / b, 6))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select(F.lit(model).alias("model"), "part", "n", rate(tp + F.col("tn"), F.col("n")).alias("accuracy"), rate(tp, tp + fp).alias("precision_"), rate(tp, tp + fn).alias("recall_"), rate(2 * tp, 2 * tp + fp + fn).alias("f1"))


def char_ngrams(col: str, low: int = 3, high: int = 5, vocabulary: int = 250_000, min_df: int = 2) -> Pipeline:
    """TF-IDF of character n-grams."""
    stages = [RegexTokenizer(inputCol=col, outputCol="_chars", pattern="", gaps=True, toLowercase=True)]
    stages += [NGram(n=n, inputCol="_chars", outputCol=f"_g{n}") for n in range(low, high + 1)]
    both = ", ".join(f"_g{n}" for n in range(low, high + 1))
    stages += [SQLTransformer(statement=f"SELECT *, concat({both}) AS _grams FROM __THIS__")]
    stages += [CountVectorizer(inputCol="_grams", outputCol="_tf", vocabSize=vocabulary, minDF=min_df), IDF(inputCol="_tf", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="text_vector")]
    return Pipeline(stages=stages)


def word_ngrams(col: str, vocabulary: int = 80_000, min_df: int = 2, max_df: float = 0.98) -> Pipeline:
    """TF-IDF of words and word pairs, by the presence of a term (a term counts once a text)."""
    return Pipeline(
        stages=[
            RegexTokenizer(inputCol=col, outputCol="_words", pattern=r"(?U)\b\w\w+\b", gaps=False),
            NGram(n=2, inputCol="_words", outputCol="_pairs"),
            SQLTransformer(statement="SELECT *, concat(_words, _pairs) AS _terms FROM __THIS__"),
            CountVectorizer(inputCol="_terms", outputCol="_tf", vocabSize=vocabulary, minDF=min_df, maxDF=max_df, binary=True),
            IDF(inputCol="_tf", outputCol="_tfidf"),
            Normalizer(inputCol="_tfidf", outputCol="text_vector"),
        ]
    )


def _term_counts(splits: int):
    """mapInArrow function: (words, inside) -> for each word and pair of a batch the times (tf)
    and the texts (df) it has within each split; bit k of ``inside`` says that a text is in split k."""

    def run(batches):
        for b in batches:
            lists, inside = b.column("words"), b.column("inside").to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(lists)), pc.fill_null(lists.value_lengths(), 0).to_numpy(zero_copy_only=False))
            coded = lists.flatten().dictionary_encode()
            code, known = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary
            size = max(len(known), 1)
            first = np.nonzero(doc[:-1] == doc[1:])[0]
            keys, at = np.unique(np.concatenate([code, (code[first] + 1) * size + code[first + 1]]), return_inverse=True)
            each, times = np.unique(np.concatenate([doc, doc[first]]) * max(len(keys), 1) + at, return_counts=True)
            doc, term = each // max(len(keys), 1), each % max(len(keys), 1)
            one, two = keys[keys < size], keys[keys >= size] - size
            pairs = pc.binary_join_element_wise(known.take(pa.array(two // size)), known.take(pa.array(two % size)), " ")
            counts = []
            for k in range(splits):
                own = (inside[doc] >> k) & 1 == 1
                counts += [np.bincount(term[own], times[own], len(keys)).astype(np.int64), np.bincount(term[own], minlength=len(keys))]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([known.take(pa.array(one)), pairs]), *map(pa.array, counts)], names=["term", *(f"{c}{k}" for k in range(splits) for c in ("tf", "df"))])

    return run


def word_vectors(rows: DataFrame, splits: list[Column], vocabulary: int = 80_000, min_df: int = 2, max_df: float = 0.98) -> tuple[DataFrame, list[Pipeline]]:
    """TF-IDF as ``word_ngrams`` gives it, fitted to each of several training parts of ``rows`` at once.

    ``rows`` (durable) have their ``words``.  Returns them with the presence of every term that
    stands in one of the vocabularies (durable, ``words`` left out), and for each split the stages
    that weigh it.  A term outside a split's vocabulary weighs nothing there.  Terms are counted in
    one pass; of equally frequent ones the alphabetically first enter a vocabulary.
    """
    bits = sum((F.when(inside, 1 << k).otherwise(0) for k, inside in enumerate(splits)), F.lit(0))
    sizes = rows.agg(*[F.count_if(inside).alias(str(k)) for k, inside in enumerate(splits)]).first()
    names = [f"{c}{k}" for k in range(len(splits)) for c in ("tf", "df")]
    counted = rows.select("words", bits.cast("int").alias("inside")).mapInArrow(_term_counts(len(splits)), "term string, " + ", ".join(f"{c} bigint" for c in names))
    often = F.greatest(*[F.col(f"df{k}") for k in range(len(splits))], F.lit(0)) >= min_df
    counts = durable(counted.groupBy("term").agg(*[F.sum(c).alias(c) for c in names]).where(often), "term_counts")
    terms: dict[str, int] = {}
    found = []
    for k in range(len(splits)):
        mine = counts.where((F.col(f"df{k}") >= min_df) & (F.col(f"df{k}") <= max_df * sizes[k])).orderBy(F.desc(f"tf{k}"), "term").limit(vocabulary)
        table = mine.select("term", f"df{k}").toArrow()
        at = np.array([terms.setdefault(t, len(terms)) for t in table["term"].to_pylist()], np.int64)
        found.append((at, np.log((sizes[k] + 1) / (table[f"df{k}"].to_numpy() + 1))))
    stages = []
    for at, idf in found:
        weights = np.zeros(len(terms))
        weights[at] = idf
        stages.append(Pipeline(stages=[ElementwiseProduct(scalingVec=DenseVector(weights), inputCol="present", outputCol="_tfidf"), Normalizer(inputCol="_tfidf", outputCol="text_vector")]))
    listed = rows.sparkSession._jvm.org.apache.commons.lang3.StringUtils.split("\n".join(terms), "\n")  # one call, not one a term
    present = CountVectorizerModel._create_from_java_class("org.apache.spark.ml.feature.CountVectorizerModel", listed).setInputCol("_terms").setOutputCol("present").setBinary(True)
    paired = NGram(n=2, inputCol="words", outputCol="_pairs").transform(rows).withColumn("_terms", F.concat("words", "_pairs"))
    return durable(present.transform(paired).drop("words", "_pairs", "_terms"), "word_vectors"), stages


def _urls(spark, d) -> DataFrame:
    df = spark.read.parquet(f"{d}/url_corpus.parquet").where("url is not null and label in (0, 1)")
    best = df.groupBy("url").agg(F.max("label").alias("label"))
    return with_class_weight(best).withColumn("part", part_of(F.col("url")))


#: Numeric features of a message, beside its text (fixed values).
NUMERIC = ["url_count", "has_ip_url", "avg_url_length", "suspicious_tld_count", "shortener_count", "exclamation_count", "digit_ratio", "capital_ratio", "body_length"]


def _emails(spark, d) -> DataFrame:
    df = spark.read.parquet(f"{d}/emails.parquet").where("label in (0, 1)")
    text = F.concat_ws(" ", F.coalesce("subject", F.lit("")), F.coalesce("body", F.lit("")))
    df = df.select("record_id", F.coalesce(F.lower(F.trim("source")), F.lit("none")).alias("source"), "label", text.alias("text"))
    for plan in (text_url_features, text_format_features):
        df = df.join(run_sql(spark, d, plan(SPARK)), "record_id")
    for c in NUMERIC:
        df = df.withColumn(c, F.col(c).cast("double"))
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df = durable(df.repartition(tasks, "record_id"), "email_rows")
    return with_class_weight(df).withColumn("part", part_of(F.col("record_id")))


#: Models that are fitted side by side: a round of a fit is a short job, so one fit alone leaves cores idle.
FITS = 4


def _side_by_side(spark, fits: list[Callable[[], DataFrame]]) -> DataFrame:
    """The rows of several fits, in their order."""
    with ThreadPool(FITS) as pool:
        first, *rest = pool.map(inheritable_thread_target(spark)(lambda fit: fit()), fits, chunksize=1)
    for found in rest:
        first = first.unionByName(found)
    return first


def _email_words(spark, d) -> DataFrame:
    """Messages with their words instead of their text."""
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"(?U)\b\w\w+\b", gaps=False)
    return durable(words.transform(_emails(spark, d)).drop("text"), "email_words")


def _inside(held: str | None) -> Column:
    """Training part of the random split, or of the one that holds out a source."""
    return F.col("part") == "train" if held is None else F.col("source") != held


def _logistic(features: str = "features", iterations: int = 30) -> LogisticRegression:
    return LogisticRegression(featuresCol=features, weightCol="weight", maxIter=iterations, regParam=1e-3)


@query("ml_url_ngrams")
def ml_url_ngrams(spark, d):
    urls = _urls(spark, d)
    model = Pipeline(stages=[char_ngrams("url"), _logistic("text_vector")]).fit(urls.where("part = 'train'"))
    return metrics(model.transform(urls.where("part = 'test'")).withColumn("score", positive()), "char n-grams")


def _url_vectors(spark, d) -> DataFrame:
    features = run_sql(spark, d, url_features(SPARK)).dropDuplicates(["url"])
    return VectorAssembler(inputCols=list(lx.MODEL_FEATURES), outputCol="features").transform(_urls(spark, d).join(features, "url"))


def boosted_trees(depth: int = 6, rounds: int = 250, step: float = 0.08, leaf: int = 20) -> GBTClassifier:
    """Boosted trees of up to ``rounds`` rounds; they end where the rows marked
    ``held`` no longer gain."""
    return GBTClassifier(maxDepth=depth, stepSize=step, maxIter=rounds, minInstancesPerNode=leaf, validationIndicatorCol="held", validationTol=0.01, weightCol="weight", subsamplingRate=0.9, seed=SEED)


def with_held(df: DataFrame, key: str = "url") -> DataFrame:
    return df.withColumn("held", F.pmod(F.xxhash64(F.col(key), F.lit(SEED + 2)), F.lit(10)) == 0)


@query("ml_url_trees")
def ml_url_trees(spark, d):
    """Boosted trees on the 29 features."""
    rows = with_held(_url_vectors(spark, d))
    model = boosted_trees().fit(rows.where("part = 'train'"))
    return metrics(model.transform(rows.where("part = 'test'")).withColumn("score", positive()), "trees")


def calibrate(rows: DataFrame, base, folds: int = 3, key: str = "url"):
    """Isotonic calibration by folds: on each, the base model is fitted to the rest and
    its scores there to the labels.  Returns a function that scores with the mean."""
    fold = F.pmod(F.xxhash64(F.col(key), F.lit(SEED + 1)), F.lit(folds))
    marked = rows.withColumn("_fold", fold)
    fitted = []
    for k in range(folds):
        model = base.fit(marked.where(F.col("_fold") != k))
        held = model.transform(marked.where(F.col("_fold") == k)).select("label", positive().alias("raw")).withColumn("raw_vector", array_to_vector(F.array("raw")))
        fitted.append((model, IsotonicRegression(featuresCol="raw_vector", predictionCol="calibrated").fit(held.withColumn("label", F.col("label").cast("double")))))

    def score(df: DataFrame) -> DataFrame:
        keep = df.columns
        out = df
        for k, (model, curve) in enumerate(fitted):
            raw = model.transform(out).withColumn("raw_vector", array_to_vector(F.array(positive())))
            out = curve.transform(raw).withColumnRenamed("calibrated", f"_c{k}").select(*keep, *[f"_c{j}" for j in range(k + 1)])
        mean = sum((F.col(f"_c{k}") for k in range(folds)), F.lit(0.0)) / folds
        return out.withColumn("score", mean).select(*keep, "score")

    return score


@query("ml_url_calibrated")
def ml_url_calibrated(spark, d):
    """Isotonic calibration over boosted trees."""
    rows = with_held(_url_vectors(spark, d))
    score = calibrate(rows.where("part = 'train'"), boosted_trees())
    return metrics(score(rows.where("part = 'test'")), "isotonic")


@query("ml_email_words")
def ml_email_words(spark, d):
    """Words and pairs, with the random split and each source held out."""
    splits = (None, "nazario", "spamassassin", "enron")
    rows, texts = word_vectors(_email_words(spark, d).drop(*NUMERIC), [_inside(held) for held in splits])

    def fitted(held: str | None, text: Pipeline) -> DataFrame:
        vectors = text.fit(rows).transform(rows)
        model = _logistic("text_vector", 20).fit(vectors.where(_inside(held)))
        return metrics(model.transform(vectors.where(~_inside(held))).withColumn("score", positive()), held or "random")

    return _side_by_side(spark, [partial(fitted, held, text) for held, text in zip(splits, texts)])


def _fused(columns: list[str]) -> list:
    stages = [VectorAssembler(inputCols=columns, outputCol="_numeric"), StandardScaler(inputCol="_numeric", outputCol="_scaled", withMean=True)]
    return [*stages, VectorAssembler(inputCols=["text_vector", "_scaled"], outputCol="features")]


@query("ml_email_fused")
def ml_email_fused(spark, d):
    """Words with scaled numeric features, at several thresholds."""
    rows = _emails(spark, d)
    model = Pipeline(stages=[word_ngrams("text"), *_fused(NUMERIC), _logistic()]).fit(rows.where("part = 'train'"))
    scored = model.transform(rows.where("part = 'test'")).select("label", positive().alias("p")).withColumn("threshold", F.explode(F.array(*[F.lit(t / 10) for t in range(2, 9)])))
    at = F.when(F.col("p") >= F.col("threshold"), 1.0).otherwise(0.0)
    return metrics(scored.withColumn("score", at), "fused", by=F.col("threshold").cast("string"))


@query("ml_email_ablation")
def ml_email_ablation(spark, d):
    """F1 of text alone and of text with one feature more; the text vectors and the scaled features are made once."""
    rows, (text,) = word_vectors(_email_words(spark, d), [_inside(None)])
    numeric = Pipeline(stages=[VectorAssembler(inputCols=NUMERIC, outputCol="_numeric"), StandardScaler(inputCol="_numeric", outputCol="_all", withMean=True)])
    ready = numeric.fit(rows.where("part = 'train'")).transform(text.fit(rows).transform(rows))
    ready = durable(ready.select("label", "weight", "part", "text_vector", "_all"), "ablation_rows")

    def fitted(k: int | None, feature: str | None) -> DataFrame:
        stages = [] if feature is None else [VectorSlicer(inputCol="_all", outputCol="_scaled", indices=[k]), VectorAssembler(inputCols=["text_vector", "_scaled"], outputCol="features")]
        model = Pipeline(stages=[*stages, _logistic("features" if stages else "text_vector", 15)]).fit(ready.where("part = 'train'"))
        return metrics(model.transform(ready.where("part = 'test'")).withColumn("score", positive()), feature or "text")

    return _side_by_side(spark, [partial(fitted, k, feature) for k, feature in ((None, None), *enumerate(NUMERIC))])


@query("ml_source_leakage")
def ml_source_leakage(spark, d):
    """How well one feature alone tells the source."""
    rows = _emails(spark, d)
    rows = StringIndexer(inputCol="source", outputCol="target", stringOrderType="alphabetAsc").fit(rows).transform(rows)
    out = None
    for feature in NUMERIC:
        stages = [VectorAssembler(inputCols=[feature], outputCol="_one"), StandardScaler(inputCol="_one", outputCol="one", withMean=True), LogisticRegression(featuresCol="one", labelCol="target", family="multinomial", maxIter=20)]
        model = Pipeline(stages=stages).fit(rows.where("part = 'train'"))
        found = model.transform(rows.where("part = 'test'")).agg(F.lit(feature).alias("feature"), F.round(F.avg((F.col("prediction") == F.col("target")).cast("double")), 6).alias("accuracy"))
        out = found if out is None else out.unionByName(found)
    return out


@query("ml_top_terms")
def ml_top_terms(spark, d):
    """The terms that weigh most for and against, thirty each (a report)."""
    rows = _emails(spark, d).where("part = 'train'")
    text = word_ngrams("text").fit(rows)
    model = _logistic("text_vector", 20).fit(text.transform(rows))
    vocabulary = text.stages[3].vocabulary
    terms = spark.createDataFrame([(t, float(w)) for t, w in zip(vocabulary, model.coefficients.toArray())], "term string, weight double")
    best = terms.orderBy(F.desc("weight"), "term").limit(30).withColumn("side", F.lit("for"))
    return best.unionByName(terms.orderBy("weight", "term").limit(30).withColumn("side", F.lit("against")))


@query("ml_embedding_head")
def ml_embedding_head(spark, d):
    """A small head on frozen vectors."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet").where("embedding is not null and label is not null")
    rows = rows.select(array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"), (F.col("label") >= 5).cast("int").alias("label"), part_of(F.col("vec_id")).alias("part"))
    width = rows.select("features").first()["features"].size
    model = MultilayerPerceptronClassifier(layers=[width, 32, 2], maxIter=40, seed=SEED).fit(rows.where("part = 'train'"))
    return metrics(model.transform(rows.where("part = 'test'")).withColumn("score", positive()), "head")


def _joint_rows(spark, d) -> DataFrame:
    from ..operators.scoring import joint_features, joint_scores

    features = run_sql(spark, d, joint_features(SPARK))
    scores = run_sql(spark, d, joint_scores(SPARK)).select("record_id", "email_score", "url_score", "joint_score")
    labels = spark.read.parquet(f"{d}/emails.parquet").where("label in (0, 1)").select("record_id", "label")
    return durable(with_class_weight(labels.join(scores, "record_id").join(features, "record_id")), "joint_rows")


@query("ml_joint_meta")
def ml_joint_meta(spark, d):
    """A logistic model over the scores and heuristic features of messages."""
    rows = _joint_rows(spark, d).withColumn("part", part_of(F.col("record_id")))
    columns = sorted(c for c in rows.columns if c.startswith("h_"))
    model = Pipeline(stages=[VectorAssembler(inputCols=["email_score", "url_score", "joint_score", *columns], outputCol="features"), _logistic()]).fit(rows.where("part = 'train'"))
    return metrics(model.transform(rows.where("part = 'test'")).withColumn("score", positive()), "meta")


def _with_hashed(rows: DataFrame) -> DataFrame:
    return HashingTF(inputCol="words", outputCol="_hashed", numFeatures=1 << 14, binary=True).transform(rows)


@query("ml_variant_grid")
def ml_variant_grid(spark, d):
    """Variants by splits: text vectors that are fixed or fitted to the training part,
    alone or with the numeric features, on the random split and each source held
    out.  A split whose training or test part lacks a class is skipped, with no metrics."""
    splits = (None, "enron", "nazario", "spamassassin")
    rows, texts = word_vectors(_with_hashed(_email_words(spark, d)), [_inside(held) for held in splits])
    labels = rows.groupBy("part", "source", "label").count().drop("count").toPandas()
    frozen = Pipeline(stages=[Normalizer(inputCol="_hashed", outputCol="text_vector")])

    def fitted(held: str | None, variant: str, text: Pipeline, fused: bool) -> DataFrame:
        vectors = text.fit(rows).transform(rows)
        stages = [*_fused(NUMERIC), _logistic("features", 15)] if fused else [_logistic("text_vector", 15)]
        model = Pipeline(stages=stages).fit(vectors.where(_inside(held)))
        return metrics(model.transform(vectors.where(~_inside(held))).withColumn("score", positive()), variant, by=F.lit(held or "random")).withColumn("status", F.lit("ok"))

    def skipped(held: str | None, variant: str, *_) -> DataFrame:
        return spark.createDataFrame([(variant, held or "random", 0, None, None, None, None, "skipped")], "model string, part string, n bigint, accuracy double, precision_ double, recall_ double, f1 double, status string")

    fits = []
    for held, own in zip(splits, texts):
        inside = labels["part"] == "train" if held is None else labels["source"] != held
        valid = labels["label"][inside].nunique() == 2 and labels["label"][~inside].nunique() == 2
        for name, text in (("frozen", frozen), ("fitted", own)):
            fits += [partial(fitted if valid else skipped, held, f"{name}{'+numeric' if fused else ''}", text, fused) for fused in (False, True)]
    return _side_by_side(spark, fits)


@query("ml_repeated_evaluation")
def ml_repeated_evaluation(spark, d):
    """Mean and sample deviation of accuracy and F1 over repeated splits, by strategy
    and threshold; the meta model is fitted anew for every repeat."""
    rows = _joint_rows(spark, d).withColumn("rules", F.col("joint_score"))
    columns = ["email_score", "url_score", "joint_score", *sorted(c for c in rows.columns if c.startswith("h_"))]
    rows = VectorAssembler(inputCols=columns, outputCol="features").transform(rows)
    out = None
    for seed in lx.REPEAT_SEEDS[:5]:
        split = rows.withColumn("part", part_of(F.col("record_id"), 0.3, seed))
        scored = _logistic(iterations=15).fit(split.where("part = 'train'")).transform(split.where("part = 'test'"))
        both = scored.select("label", F.explode(F.create_map(F.lit("meta"), positive(), F.lit("rules"), F.col("rules"))).alias("strategy", "p"))
        at = F.explode(F.array(*[F.lit(t) for t in lx.MODE_THRESHOLDS.values()])).alias("threshold")
        each = both.select("*", at).withColumn("score", F.when(F.col("p") >= F.col("threshold"), 1.0).otherwise(0.0))
        found = metrics(each, str(seed), by=F.concat_ws("@", "strategy", F.col("threshold").cast("string")))
        out = found if out is None else out.unionByName(found)
    spread = lambda c: [F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.coalesce(F.stddev_samp(c), F.lit(0.0)), 6).alias(f"{c}_std")]
    name = F.split("part", "@")
    return out.groupBy(name[0].alias("strategy"), name[1].cast("double").alias("threshold")).agg(*spread("accuracy"), *spread("f1"), F.count(F.lit(1)).alias("repeats"))
