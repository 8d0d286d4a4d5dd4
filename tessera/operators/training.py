"""Training and evaluation of the authorship classifier with Spark ML."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera import params as P
from tessera.operators import products, similarity

FEATURES = ["perplexity", "burstiness", "stylometric"]
BLOCK = 1024  #: originals of a set that are paired in one task


def training_set(annotations: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, text, y) of annotated documents with text; labels other than the four are dropped."""
    y = F.when(F.col("label").isin("human", "plagiarized"), 0).when(F.col("label").isin("ai_generated", "mixed"), 1)
    rows = annotations.select("doc", y.alias("y")).where("y is not null")
    return rows.join(docs.where("text is not null").select("doc", "text"), "doc")


def gate(rows: DataFrame) -> DataFrame:
    """One row: n, n0, n1, ok."""
    out = rows.agg(F.count("*").alias("n"), F.count_if(F.col("y") == 0).alias("n0"), F.count_if(F.col("y") == 1).alias("n1"))
    return out.withColumn("ok", (F.col("n") >= P.TRAIN_MIN_ROWS) & (F.least("n0", "n1") >= P.TRAIN_MIN_CLASS))


def clean_features(rows: DataFrame) -> DataFrame:
    """Missing signals are 0; rows with no signal at all go."""
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in FEATURES})
    return rows.where(" or ".join(f"{c} != 0" for c in FEATURES))


def seeded(id_: Column, seed: int = 42) -> Column:
    """A fixed pseudo-random number of an id, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), id_.cast("string"))), 1, 8), 16, 10).cast("long")


def numbered(rows: DataFrame, group: str, order: list[Column], bin_: Column) -> DataFrame:
    """Adds _at, the place of a row in its group from 1, and _n, the group's size.

    bin_: a number of a few thousand values that grows with the order. Bins are counted first and rows are
    sorted inside their bin only, so a group is as many tasks as it has bins.
    """
    rows = rows.withColumn("_bin", bin_)
    counts = rows.groupBy(group, "_bin").agg(F.count("*").alias("n"))
    by = Window.partitionBy(group)
    ahead = F.coalesce(F.sum("n").over(by.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col(group).alias("_group"), F.col("_bin").alias("_b"), ahead.alias("_ahead"), F.sum("n").over(by).alias("_n"))
    rows = rows.join(counts, F.col(group).eqNullSafe(F.col("_group")) & (F.col("_bin") == F.col("_b")))
    inside = F.row_number().over(Window.partitionBy(group, "_bin").orderBy(*order))
    return rows.withColumn("_at", F.col("_ahead") + inside).drop("_bin", "_group", "_b", "_ahead")


def _shuffled(rows: DataFrame, seed: int) -> DataFrame:
    key = seeded(F.col("doc"), seed)
    return numbered(rows, "y", [key, F.col("doc")], F.shiftright(key, 20))  # 4096 bins of a 32-bit hash


def stratified_split(rows: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """Adds is_test: the lowest fifth of each class by seeded hash."""
    place = F.when(F.col("_n") > 1, (F.col("_at") - 1) / (F.col("_n") - 1)).otherwise(0.0)
    return _shuffled(rows, seed).withColumn("is_test", place < share).drop("_at", "_n")


def pipeline(n: int, c: float = 1.0) -> Pipeline:
    """Standardised features and logistic regression; c is the inverse penalty of n rows together."""
    return Pipeline(stages=[
        VectorAssembler(inputCols=FEATURES, outputCol="raw_features"),
        StandardScaler(inputCol="raw_features", outputCol="features", withMean=True, withStd=True),
        LogisticRegression(featuresCol="features", labelCol="y", maxIter=500, regParam=1.0 / (c * max(n, 1)), elasticNetParam=0.0, standardization=False),
    ])


def fit(rows: DataFrame, c: float = 1.0) -> PipelineModel:
    """The fitted pipeline; the rows are held while it is fitted, so their signals are computed once."""
    rows = rows.select("y", *FEATURES).persist()
    try:
        checked = gate(rows).first()
        if not checked["ok"]:
            raise ValueError(f"too few rows to train: {checked.asDict()}")
        return pipeline(checked["n"], c).fit(rows)
    finally:
        rows.unpersist()


def cross_validated_auc(rows: DataFrame, folds: int | None = None, seed: int = 42) -> tuple[float, float] | None:
    """Mean and deviation of ROC-AUC over stratified folds (2 to 5, by the smaller class); None below two folds."""
    rows = rows.select("doc", "y", *FEATURES).persist()
    try:
        g = gate(rows).first()
        k = folds if folds is not None else max(2, min(5, g["n0"], g["n1"]))
        if k < 2 or min(g["n0"], g["n1"]) < 2:
            return None
        placed = _shuffled(rows, seed).withColumn("fold", (F.col("_at") % k).cast("int")).select("y", "fold", *FEATURES)
        cv = CrossValidator(estimator=pipeline(g["n"]), estimatorParamMaps=ParamGridBuilder().build(), evaluator=BinaryClassificationEvaluator(labelCol="y"), numFolds=k, foldCol="fold")
        model = cv.fit(placed)
        return model.avgMetrics[0], model.stdMetrics[0]
    finally:
        rows.unpersist()


def confusion(flag: Column, y: Column) -> list[Column]:
    return [F.count_if(flag & (y == 1)).alias("tp"), F.count_if(flag & (y == 0)).alias("fp"), F.count_if(~flag & (y == 0)).alias("tn"), F.count_if(~flag & (y == 1)).alias("fn")]


def rates(rows: DataFrame) -> DataFrame:
    """Adds accuracy, precision, recall, f1, tpr and fpr to rows with tp, fp, tn, fn; 0 where nothing is to divide by."""
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    rows = rows.withColumns({"accuracy": share(tp + tn, tp + fp + tn + fn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "fpr": share(fp, fp + tn)})
    p, r = F.col("precision"), F.col("recall")
    return rows.withColumn("f1", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0)).withColumn("tpr", F.col("recall"))


def roc_auc(rows: DataFrame) -> DataFrame:
    """One row, auc: exact, from counts by score, so only distinct scores are ranked; 0.5 if one class is missing."""
    by = rows.groupBy("p").agg(F.count_if(F.col("y") == 1).alias("pos"), F.count_if(F.col("y") == 0).alias("neg"))
    by = by.withColumn("bin", F.floor(F.col("p") * 4096))
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # over the 4097 bins of [0, 1]
    bins = by.groupBy("bin").agg(F.sum("neg").alias("n")).select("bin", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("ahead"))
    inside = F.sum("neg").over(Window.partitionBy("bin").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    by = by.join(F.broadcast(bins), "bin")  # at most 4097 rows
    below = F.col("ahead") + F.coalesce(inside, F.lit(0))
    won = by.withColumn("below", below).agg(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("won"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    return won.select(F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("won") / (F.col("pos") * F.col("neg"))).otherwise(0.5).alias("auc"))


def classification_metrics(rows: DataFrame, cut: float = 0.5) -> DataFrame:
    """One row of metrics of (p, y) rows."""
    return rates(rows.agg(*confusion(F.col("p") >= cut, F.col("y")))).crossJoin(F.broadcast(roc_auc(rows)))  # one row each


def threshold_sweep(rows: DataFrame, cuts: tuple[float, ...] = (0.50, 0.60, 0.70, 0.80)) -> DataFrame:
    """Metrics of (p, y) rows at each cut; the cuts are a literal array, so rows are expanded in place."""
    each = rows.select("p", "y", F.explode(F.array(*map(F.lit, cuts))).alias("threshold"))
    return rates(each.groupBy("threshold").agg(*confusion(F.col("p") >= F.col("threshold"), F.col("y"))))


def feature_summary(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, n, mean, std, min, q1, median, q3, max), quartiles interpolated between neighbouring values.

    Values are counted, counts are summed over bins between least and largest value, and only the bins are ordered as a whole.
    """
    stacked = F.stack(F.lit(len(columns)), *(x for c in columns for x in (F.lit(c), F.col(c).cast("double")))).alias("feature", "x")
    long = rows.select(stacked)
    plain = long.groupBy("feature").agg(F.count("x").alias("n"), F.mean("x").alias("mean"), F.stddev("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max"))
    by = long.where("x is not null").groupBy("feature", "x").agg(F.count("*").alias("k")).join(F.broadcast(plain.select("feature", "min", "max")), "feature")  # a row a feature
    by = by.withColumn("bin", F.when(F.col("max") > F.col("min"), F.floor((F.col("x") - F.col("min")) / (F.col("max") - F.col("min")) * 4096)).otherwise(F.lit(0)))
    earlier = Window.partitionBy("feature").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = by.groupBy("feature", "bin").agg(F.sum("k").alias("b")).select("feature", "bin", F.coalesce(F.sum("b").over(earlier), F.lit(0)).alias("ahead"))
    upto = F.sum("k").over(Window.partitionBy("feature", "bin").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    placed = by.join(bins, ["feature", "bin"]).select("feature", "x", "k", (F.col("ahead") + upto).alias("upto")).join(F.broadcast(plain.select("feature", "n")), "feature")

    def value(q: float) -> Column:
        at = q * (F.col("n") - 1)
        holds = lambda i: (F.col("upto") - F.col("k") <= i) & (i < F.col("upto"))
        low, high = (F.max(F.when(holds(f(at)), F.col("x"))) for f in (F.floor, F.ceil))
        part = F.max(at - F.floor(at))
        return low + (high - low) * part

    quartiles = placed.groupBy("feature").agg(value(0.25).alias("q1"), value(0.5).alias("median"), value(0.75).alias("q3"))
    return plain.join(quartiles, "feature", "left").select("feature", "n", "mean", "std", "min", "q1", "median", "q3", "max")


def labelled_pairs(files: DataFrame, kind: str, unrelated: int | None = None, seed: int = 42, near: int = 2) -> DataFrame:
    """(class, a, b): ``kind``_orig_i with ``kind``_copy_i, and originals with other originals and other copies of their set.

    files: (set, name); only files of one set are paired. With ``unrelated``, at most so many of the latter, by seeded hash, drawn from
    the pairs of each original with the ``near`` files that follow it in the seeded order of its set, so not all pairs are made.
    """
    part = lambda g: F.regexp_extract("name", rf"^{kind}_(orig|copy)_(\d+)", g)
    rows = files.select("set", "name", part(1).alias("role"), F.expr("try_cast(" + f"regexp_extract(name, '^{kind}_(orig|copy)_([0-9]+)', 2) as int)").alias("i")).where("role != ''")
    orig = rows.where("role = 'orig'").select("set", F.col("name").alias("a"), F.col("i").alias("ia"))
    copy = rows.where("role = 'copy'").select("set", F.col("name").alias("b"), F.col("i").alias("ib"))
    copied = orig.join(copy.withColumnRenamed("ib", "ia"), ["set", "ia"]).select(F.lit(kind).alias("class"), "a", "b")
    if unrelated is None:
        others = _in_blocks(orig, rows).where("role = 'orig' and ia < ib or role = 'copy' and ia != ib").select("a", "b")
        return copied.unionByName(others.select(F.lit("unrelated").alias("class"), "a", "b"))
    order = Window.partitionBy("set").orderBy(seeded(F.col("name"), seed), "name")
    me = F.struct("name", "role", "i")
    after = rows.withColumn("ys", F.array(*(F.lead(me, k).over(order) for k in range(1, near + 1)))).where("role = 'orig'")
    after = after.withColumn("y", F.explode("ys")).where("y.i != i")
    others = after.select(F.col("name").alias("a"), F.col("y.name").alias("b")).orderBy(seeded(F.concat("a", "b"), seed), "a", "b").limit(unrelated)
    return copied.unionByName(others.select(F.lit("unrelated").alias("class"), "a", "b"))


def _in_blocks(orig: DataFrame, rows: DataFrame) -> DataFrame:
    """Every original (set, a, ia) of a set with every file (set, name, role, i) of it, as b, role and ib: originals are in blocks of some BLOCK, which each file meets, so a set is as many tasks as it has blocks."""
    blocks = F.broadcast(orig.groupBy("set").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))  # a row a set
    left = orig.join(blocks, "set").select("set", F.pmod(F.xxhash64("a"), "blocks").cast("int").alias("block"), "a", "ia")
    right = rows.join(blocks, "set").select("set", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.col("name").alias("b"), "role", F.col("i").alias("ib"))
    tasks = 8 * orig.sparkSession.sparkContext.defaultParallelism  # a fixed number: by their bytes, which are few, all would be put into one
    left, right = (x.repartition(tasks, "set", "block") for x in (left, right))
    return left.hint("shuffle_hash").join(right, ["set", "block"])  # a block's originals are held, files pass by


def class_means(pairs: DataFrame, columns: list[str]) -> DataFrame:
    return pairs.groupBy("class").agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("n"))


def shared_means(docs: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """``class_means`` of all pairs that share sentences, by the share of the shorter text that these make (fused): verbatim from 0.7, paraphrase from 0.4, else unrelated.

    docs: (batch, doc, n, c), where c is whether a text counts as having code, with vectors of sentences (_s), weighted terms (_t; tight ones with their ``scales``) and embeddings (_e). Sums are taken where
    the pairs are found, so none is a row.
    """
    columns = ["fused", "code_score", "tfidf", "semantic"]
    names = np.array(["verbatim", "paraphrase", "unrelated"])

    def run(rows: pa.Table, left: tuple[int, int], right: tuple[int, int], ok: np.ndarray, product) -> dict | None:
        x, y, fused = similarity.shared_text(rows, left, right, ok, product, "_s")
        if not len(x):
            return None
        c = rows["c"].to_numpy()
        code = np.where(c[x + left[0]] & c[y + right[0]], np.minimum(product(right, "_s", (True, True))[x, y], 10) / 10, 0.0)
        kind = np.where(fused >= 0.7, 0, np.where(fused >= 0.4, 1, 2))
        n = np.bincount(kind, minlength=3)
        some = np.flatnonzero(n)
        sums = [np.bincount(kind, v, 3)[some] for v in (fused, code, product(right, "_t")[x, y], product(right, "_e")[x, y])]
        return {"class": names[some], "n": n[some]} | dict(zip(columns, sums))

    parts = products.in_tiles(docs, run, "class string, n long, " + ", ".join(f"{c} double" for c in columns), kinds=("_s", "_t", "_e"), scales=scales)
    return parts.groupBy("class").agg(*((F.sum(c) / F.sum("n")).alias(c) for c in columns), F.sum("n").alias("n"))


class ModelRegistry:
    """Saved models by version and the events that made one of them active; the latest event counts.

    Both live under one folder, the events as append-only Parquet.
    """

    SCHEMA = "version string, event string, at timestamp, metrics map<string,double>"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _append(self, version: str, event: str, metrics: dict[str, float] | None = None) -> None:
        row = self.spark.createDataFrame([(version, event, metrics or {})], "version string, event string, metrics map<string,double>")
        row.select("version", "event", F.current_timestamp().alias("at"), "metrics").coalesce(1).write.mode("append").parquet(f"{self.path}/events")

    def save(self, version: str, model: PipelineModel, metrics: dict[str, float]) -> None:
        """Saves a model and makes it the active one."""
        model.write().save(f"{self.path}/models/{version}")
        self._append(version, "trained", metrics)
        self._append(version, "activated")

    def activate(self, version: str) -> None:
        if self.entries().where((F.col("version") == version) & (F.col("event") == "trained")).isEmpty():
            raise ValueError(f"no such version: {version}")
        self._append(version, "activated")

    def entries(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/events")

    def runs(self) -> DataFrame:
        return registry_state(self.entries())

    def active(self) -> PipelineModel | None:
        row = self.runs().where("is_active").first()
        return PipelineModel.load(f"{self.path}/models/{row['version']}") if row else None


def registry_state(events: DataFrame) -> DataFrame:
    """(version, trained_at, is_active) of event rows (version, event, at): exactly one active version once any was activated."""
    last = events.where("event = 'activated'").agg(F.max_by("version", F.struct("at", "version")).alias("last"))
    runs = events.where("event = 'trained'").groupBy("version").agg(F.min("at").alias("trained_at"))
    return runs.crossJoin(F.broadcast(last)).select("version", "trained_at", F.coalesce(F.col("version") == F.col("last"), F.lit(False)).alias("is_active"))  # last: one row


def missing_runs(registry: DataFrame, runs: DataFrame) -> DataFrame:
    return registry.join(runs.select("version"), "version", "left_anti")
