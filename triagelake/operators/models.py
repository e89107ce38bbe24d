"""Classifiers: features fitted once, four kinds of model, comparison, prediction records, a store, gated retraining."""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, NaiveBayes, NaiveBayesModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import fixed
from ..functions import text as X
from ..sources import files
from . import evaluate, features, machines

LR, NB, RF, SVM = "Logistic Regression", "Naive Bayes", "Random Forest", "Calibrated Linear SVM"
_VECTOR = T.StructType([T.StructField("v", VectorUDT())])


def sparse(size: int, indices: Column, values: Column) -> Column:
    """A sparse vector of arrays; Spark's own JSON reader makes the vector, so no Python worker takes part."""
    parts = F.struct(F.lit(0).alias("type"), F.lit(size).alias("size"), indices.alias("indices"), values.alias("values"))
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), _VECTOR)["v"]


@dataclass
class Features:
    """TF-IDF over one- and two-word terms: (1 + ln tf, or tf) * idf, rows of length 1; beside them, if asked for, the six signals."""

    terms: list[str]
    idf: list[float]
    sublinear: bool = True
    letters: bool = False

    @classmethod
    def fit(cls, rows: DataFrame, size: int = 10_000, sublinear: bool = True, letters: bool = False) -> Features:
        """The ``size`` commonest terms of ``rows`` (ticket_text, or _words), a document each, or ``_n`` equal ones; they alone reach the driver."""
        words = F.col("_words") if "_words" in rows.columns else features.words_of(F.col("ticket_text"), letters)
        times = F.col("_n") if "_n" in rows.columns else None
        found = features.vocabulary(rows, words, rows.agg((F.count("*") if times is None else F.sum(times)).alias("n")), size, times).collect()
        found.sort(key=lambda r: r.term)
        return cls([r.term for r in found] or ["ticket"], [r.idf for r in found] or [1.0], sublinear, letters)

    def width(self, with_signals: bool) -> int:
        return len(self.terms) + (len(fixed.SIGNALS) if with_signals else 0)

    def weighted(self, rows: DataFrame) -> DataFrame:
        """``rows`` with ``_at``, the places of their terms, rising, and ``_w``, their weights; words that are there already, as ``_words``, are taken as they are and go."""
        words = F.col("_words") if "_words" in rows.columns else features.words_of(F.col("ticket_text"), self.letters)
        found = rows.withColumn("_terms", features.terms_of(words))
        found = CountVectorizerModel.from_vocabulary(self.terms, inputCol="_terms", outputCol="_counts").transform(found)
        idf = F.from_json(F.lit(json.dumps(self.idf)), "array<double>")
        raw = lambda c: F.zip_with(c["indices"], c["values"], lambda i, n: ((1 + F.log(n)) if self.sublinear else n) * F.get(idf, i))
        length = lambda r: F.sqrt(F.aggregate(r, F.lit(0.0), lambda a, w: a + w * w))
        normal = lambda r: X.bound(length(r), lambda n: F.transform(r, lambda w: w / n))
        made = X.bound(F.unwrap_udt("_counts"), lambda c: F.struct(c["indices"].alias("at"), X.bound(raw(c), normal).alias("w")))
        kept = [c for c in rows.columns if c != "_words"]
        return found.select(*kept, made.alias("_made")).select(*kept, F.col("_made.at").alias("_at"), F.col("_made.w").alias("_w"))

    def long(self, weighted: DataFrame) -> DataFrame:
        """A row for each term of ``weighted``: its other columns, term, weight."""
        names = F.from_json(F.lit(json.dumps(self.terms)), "array<string>")
        rest = [c for c in weighted.columns if c not in ("_at", "_w")]
        return weighted.select(*rest, F.explode(F.arrays_zip("_at", "_w")).alias("x")).select(*rest, F.get(names, F.col("x._at")).alias("term"), F.col("x._w").alias("weight"))

    def vectors(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the vector columns ``plain`` and ``stacked``, the latter with the signals behind the terms.

        Words that are there already, as ``_words``, are taken as they are.
        """
        found, n = self.weighted(rows), len(self.terms)
        if "_signals" not in found.columns:
            found = found.withColumn("_signals", X.signals(F.col("ticket_text")))
        signals = F.array(*[F.col("_signals")[s] for s in fixed.SIGNALS])
        places = F.array(*[F.lit(n + i) for i in range(len(fixed.SIGNALS))])
        out = {"plain": sparse(n, F.col("_at"), F.col("_w")), "stacked": sparse(self.width(True), F.concat("_at", places), F.concat("_w", signals))}
        kept = [] if "_signals" in rows.columns else ["_signals"]
        return found.withColumns(out).drop("_at", "_w", *kept)


@dataclass
class Config:
    """A candidate: its kind, whether classes weigh alike, whether it sees the signals, trees, folds."""

    name: str
    kind: str
    balanced: bool = False
    signals: bool = False
    trees: int = 100
    folds: int = 5
    max_iter: int = 1000
    depth: int = 30


def production(balanced: bool) -> tuple[Config, ...]:
    """The four models that are trained for a target, in order of preference where scores are equal; priority weighs classes alike."""
    return tuple(Config(k, k, balanced and k != NB) for k in (LR, NB, RF, SVM))


#: The six candidates for priority.
CANDIDATES = (
    Config("Calibrated Linear SVM, TF-IDF", SVM, folds=3),
    Config("Logistic Regression, TF-IDF", LR),
    Config("Random Forest, TF-IDF", RF),
    Config("Logistic Regression, TF-IDF and signals", LR, balanced=True, signals=True),
    Config("Random Forest, TF-IDF and signals", RF, balanced=True, signals=True, trees=150),
    Config("Calibrated Linear SVM, TF-IDF and signals", SVM, balanced=True, signals=True, folds=3),
)


@dataclass
class Classifier:
    """A fitted model with its labels, in alphabetical order: ``score`` adds their probabilities."""

    config: Config
    labels: list[str]
    model: object = None
    weights: np.ndarray | None = None
    sigmoids: np.ndarray | None = None

    @property
    def column(self) -> str:
        return "stacked" if self.config.signals else "plain"

    def score(self, vectors: DataFrame, name: str = "probability") -> DataFrame:
        """``vectors`` with the array column ``name``, a probability for each label."""
        if self.config.kind == SVM:
            keep = [c for c in vectors.columns if c not in ("plain", "stacked")]
            # Vectors do not cross to Python as such: they go as the structs that they are made of, and become vectors again.
            inner = vectors.select(*keep, F.struct(F.unwrap_udt("plain").alias("p"), F.unwrap_udt("stacked").alias("s")).alias("_both"), F.col(self.column).alias("_features"))
            found = machines.score(inner, "_features", self.weights, self.sigmoids, len(self.labels), self.config.folds)
            back = {c: sparse_of(F.col("_both")[k]) for c, k in (("plain", "p"), ("stacked", "s"))}
            return found.withColumns(back).drop("_both").withColumnRenamed("probability", name)
        out = self.model.transform(vectors.withColumnRenamed(self.column, "features"))
        out = out.withColumn(name, vector_to_array("probability"))
        return out.drop("rawPrediction", "prediction", *(["probability"] if name != "probability" else [])).withColumnRenamed("features", self.column)

    def label(self, probability: str = "probability") -> Column:
        """The likeliest label, of equals the first."""
        return F.get(F.array(*map(F.lit, self.labels)), (F.array_position(probability, F.array_max(probability)) - 1).cast("int"))

    def distribution(self, probability: str = "probability") -> Column:
        """label -> percent, two digits."""
        return F.map_from_arrays(F.array(*map(F.lit, self.labels)), F.transform(probability, lambda p: F.round(p * 100, 2)))


def sparse_of(parts: Column) -> Column:
    """A vector of the struct that it unwraps to."""
    return F.from_json(F.to_json(F.struct(parts.alias("v"))), _VECTOR)["v"]


#: Parts in which a forest draws the rows of one vector and label: a part is in a tree's sample as a whole, as often as chance has it.
DRAWN = 1000
#: Bytes of a forest's dense rows, four for each feature, that one task holds.
FOREST_BYTES = 128 << 20


def kinds_of(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``vectors`` with ``kind``, the vectors once each under that name) for rows with vectors of their own."""
    kind = F.struct(F.unwrap_udt("plain").alias("p"), F.unwrap_udt("stacked").alias("s"))
    rows = vectors.withColumn("kind", kind)
    found = rows.select("kind").distinct()
    return rows.drop("plain", "stacked"), found.select("kind", sparse_of(F.col("kind.p")).alias("plain"), sparse_of(F.col("kind.s")).alias("stacked"))


def fit(vectors: DataFrame, target: str, config: Config, size: int, seed: int = 42, kinds: DataFrame | None = None) -> Classifier:
    """``config`` fitted to ``vectors`` (see :meth:`Features.vectors`), read several times: pass a written table.

    Rows of one vector, label and fold are one row that weighs as much, so steps cost what different rows cost; the losses
    are the same. ``kinds``: the vectors by ``kind``, where ``vectors`` has but that (:func:`prepared`).
    Strengths of penalties follow from the rows, so that each adds to the whole loss what C = 1 does.
    """
    if kinds is None:
        vectors, kinds = kinds_of(vectors)
    known = vectors.where(F.col(target).isNotNull())
    # A support vector machine's folds, a forest's parts; the other models need neither.
    parts = {SVM: config.folds, RF: DRAWN}.get(config.kind, 1)
    fold = F.pmod(F.xxhash64("ticket_id", F.lit(seed)), F.lit(parts)).cast("int")
    merged = known.groupBy("kind", target, fold.alias("fold")).agg(F.count("*").cast("double").alias("n"))
    merged = files.written(merged.join(kinds, "kind").select("plain" if not config.signals else "stacked", target, "fold", "n"), "merged")
    counts = {r[target]: int(r.n) for r in merged.groupBy(target).agg(F.sum("n").alias("n")).collect()}  # one row per class
    labels, n = sorted(counts), sum(counts.values())
    if not labels:
        raise ValueError("no row has a label")
    names = F.array(*map(F.lit, labels))
    column = "stacked" if config.signals else "plain"
    each = {c: n / (len(labels) * k) for c, k in counts.items()} if config.balanced else dict.fromkeys(labels, 1.0)
    weight = F.element_at(F.create_map(*[F.lit(x) for pair in each.items() for x in pair]), F.col(target)).cast("double") * F.col("n")
    label = (F.array_position(names, F.col(target)) - 1).cast("int")
    out = Classifier(config, labels)
    if config.kind == SVM:
        vector = F.unwrap_udt(column)
        rows = files.spread(merged.select(vector["indices"].alias("at"), vector["values"].alias("v"), label.alias("label"), "fold", weight.alias("weight"), "n"))
        cut = max(1, rows.rdd.getNumPartitions())
        rows = rows.persist()
        out.weights = machines.fit_margins(rows, size, len(labels), config.folds, cut, max_iter=config.max_iter)
        out.sigmoids = machines.fit_sigmoids(rows, out.weights, len(labels), config.folds, cut)
        rows.unpersist()
        return out
    rows = merged.select(F.col(column).alias("features"), label.cast("double").alias("label"), weight.alias("weight"))
    if config.kind == RF:
        rows = rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-merged.count() * size * 4 // FOREST_BYTES)))
    else:
        rows = files.spread(rows)
    rows = rows.persist()
    made = {
        LR: lambda: LogisticRegression(maxIter=config.max_iter, regParam=1 / n, tol=1e-4, standardization=False, family="multinomial", weightCol="weight"),
        NB: lambda: NaiveBayes(smoothing=1.0, weightCol="weight"),
        RF: lambda: RandomForestClassifier(numTrees=config.trees, maxDepth=config.depth, seed=seed, weightCol="weight", maxMemoryInMB=512),
    }
    out.model = made[config.kind]().fit(rows)
    rows.unpersist()
    return out


def predicted(classifier: Classifier, vectors: DataFrame, target: str, keep: Sequence[str] = (), kinds: DataFrame | None = None) -> DataFrame:
    """(ticket_id, truth, predicted, confidence in percent, and ``keep``); with ``kinds`` (:func:`prepared`) each vector is scored once."""
    scored = classifier.score(vectors if kinds is None else kinds)
    found = {"predicted": classifier.label(), "confidence": F.round(F.array_max("probability") * 100, 2)}
    if kinds is None:
        return scored.select("ticket_id", F.col(target).alias("truth"), *[c.alias(k) for k, c in found.items()], *keep)
    told = files.written(scored.select("kind", *[c.alias(k) for k, c in found.items()]), "scored")
    return vectors.join(told, "kind").select("ticket_id", F.col(target).alias("truth"), *found, *keep)


def by_kind(rows: DataFrame, letters: bool = False, signals: bool = True) -> tuple[DataFrame, DataFrame]:
    """(``rows`` with the number of their kind for their text, kinds: number, _words and _signals), both written.

    Words and signals are made once for each different shape of a text; signals that no model sees are not made, but 0.
    """
    seen = lambda t: X.signals(t) if signals else F.struct(*[F.lit(0.0).alias(s) for s in fixed.SIGNALS])
    kind_of, kinds = features.by_shape(rows, lambda t: F.struct(features.words_of(t, letters).alias("_words"), seen(t).alias("_signals")))
    slim = files.written(rows.withColumn("_shape", X.shape(F.col("ticket_text"))).drop("ticket_text").join(kind_of, "_shape").drop("_shape"), "rows")
    return slim, kinds.select("kind", "made._words", "made._signals")


def vectors_of(made: Features, kinds: DataFrame) -> DataFrame:
    """The vectors of every kind of :func:`by_kind`, written: what costs by the vector is done once for each."""
    return files.written(made.vectors(kinds).select("kind", "plain", "stacked"), "vectors")


def prepared(rows: DataFrame, configs: Sequence[Config], size: int = 10_000) -> tuple[Features, DataFrame, DataFrame]:
    """Features fitted to the rows of split ``train``, all rows by kind, and the vectors of the kinds, for models of ``configs``."""
    rows, kinds = by_kind(rows, signals=any(c.signals for c in configs))
    seen = rows.where("split = 'train'").groupBy("kind").agg(F.count("*").alias("_n")).join(kinds, "kind")
    made = Features.fit(files.written(seen.select("_words", "_n"), "seen"), size)
    return made, rows, vectors_of(made, kinds)


def fit_predict(rows: DataFrame, target: str, config: Config, size: int = 10_000, keep: Sequence[str] = ()) -> DataFrame:
    """Predictions of all rows outside ``train`` by a model of those inside."""
    made, vectors, kinds = prepared(rows, (config,), size)
    model = fit(vectors.where("split = 'train'"), target, config, made.width(config.signals), kinds=kinds)
    return predicted(model, vectors.where("split <> 'train'"), target, keep, kinds)


def benchmark(rows: DataFrame, target: str, configs: Sequence[Config], size: int = 10_000, splits: Sequence[str] = ("test", "holdout")) -> DataFrame:
    """(target, model, ord, split, accuracy, macro_f1, weighted_f1, rows) of every candidate on every evaluation set.

    Features are fitted and vectors written once; predictions of all candidates are scored together.
    """
    made, vectors, kinds = prepared(rows, configs, size)
    train, held = vectors.where("split = 'train'"), vectors.where(F.col("split").isin(*splits))
    found = None
    for i, config in enumerate(configs):
        model = fit(train, target, config, made.width(config.signals), kinds=kinds)
        one = predicted(model, held, target, ("split",), kinds).select(F.lit(target).alias("target"), F.lit(config.name).alias("model"), F.lit(i).alias("ord"), "split", "truth", "predicted")
        found = one if found is None else found.unionByName(one)
    return evaluate.summary(found, ["target", "model", "ord", "split"], "truth", "predicted")


EMPTY, MISSING = fixed.MESSAGES["empty_text"], fixed.MESSAGES["no_models"]


@dataclass
class Predictor:
    """Features and both classifiers; ``predict`` makes the prediction record of every row."""

    features: Features
    category: Classifier
    priority: Classifier
    metrics: dict = field(default_factory=dict)

    def predict(self, rows: DataFrame) -> DataFrame:
        """``rows`` (ticket_id, ticket_text, ...) with the prediction record.

        Words and signals are made once for each different shape of a text, vectors, probabilities and records once for each
        different pair of them. A null or blank text gives an error record: Unclassified, Medium, the general team, no
        confidences, signals or explanation.
        """
        seen = {"_words": lambda t: features.words_of(t, self.features.letters), "_signals": X.signals, "_blank": lambda t: X.strip(t) == ""}
        kind_of, kinds = features.by_shape(rows, lambda t: F.struct(*[f(t).alias(k) for k, f in seen.items()]))
        vectors = files.written(self.features.vectors(kinds.select("kind", "made._words", "made._signals")).drop("_signals"), "vectors")
        told = self.priority.score(self.category.score(vectors, "_category"), "_priority").select("kind", "_category", "_priority")
        scored = kinds.join(files.written(told, "scored"), "kind")
        blank = F.col("made._blank")
        ok = lambda c: F.when(~blank, c)
        percent = lambda p: F.round(F.array_max(p) * 100, 2)
        category, priority = self.category.label("_category"), self.priority.label("_priority")
        signals = F.col("made._signals")
        record = {
            "status": F.when(blank, "error").otherwise("success"),
            "category": F.when(blank, "Unclassified").otherwise(category),
            "category_confidence": ok(percent("_category")),
            "priority": F.when(blank, "Medium").otherwise(priority),
            "priority_confidence": ok(percent("_priority")),
            "priority_signals": ok(signals),
            "priority_explanation": ok(X.explanation(signals, priority)),
            "priority_distribution": ok(self.priority.distribution("_priority")),
            "department": X.department(F.when(~blank, category)),
            "confidence": F.when(blank, 0.0).otherwise(percent("_category")),
            "error": F.when(blank, EMPTY),
        }
        records = files.written(scored.select(F.col("kind").alias("_kind"), F.struct(*[v.alias(k) for k, v in record.items()]).alias("_record")), "records")
        found = rows.withColumn("_shape", X.shape(F.col("ticket_text"))).join(kind_of.withColumnRenamed("kind", "_kind"), "_shape").join(records, "_kind")
        return found.select(*[c for c in rows.columns if c not in record], *[F.col("_record")[k].alias(k) for k in record])


def unloaded(rows: DataFrame) -> DataFrame:
    """The records of ``rows`` where there are no models."""
    none = F.lit(None)
    names = [F.lit(None).cast("double").alias(s) for s in fixed.SIGNALS]
    record = {
        "status": F.lit("error"), "category": F.lit("Unclassified"), "category_confidence": none.cast("double"), "priority": F.lit("Medium"),
        "priority_confidence": none.cast("double"), "priority_signals": F.when(F.lit(False), F.struct(*names)), "priority_explanation": none.cast("string"),
        "priority_distribution": none.cast("map<string,double>"), "department": F.lit(fixed.DEFAULT_DEPARTMENT), "confidence": F.lit(0.0), "error": F.lit(MISSING),
    }
    return rows.select(*[c for c in rows.columns if c not in record], *[v.alias(k) for k, v in record.items()])


def train_predictor(rows: DataFrame, category: Sequence[Config] = (), priority: Sequence[Config] = (), size: int = 10_000) -> Predictor:
    """A predictor fitted to split ``train``; of several candidates for a target the one with the best weighted F1 on ``test``."""
    category, priority = category or production(False), priority or production(True)
    made, vectors, kinds = prepared(rows.select("ticket_id", "ticket_text", "category", "priority", "split"), (*category, *priority), size)
    train, test = vectors.where("split = 'train'"), vectors.where("split = 'test'")
    metrics: dict = {}

    def best(target: str, configs: Sequence[Config]) -> Classifier:
        models = [fit(train, target, c, made.width(c.signals), kinds=kinds) for c in configs]
        if len(models) == 1:
            return models[0]
        each = {m.config.name: evaluate.scores(files.written(predicted(m, test, target, kinds=kinds), "predictions"), "truth", "predicted") for m in models}
        found = max(models, key=lambda m: (each[m.config.name]["weighted_f1"], -models.index(m)))
        metrics.update({f"best_{target}_model": found.config.name, f"best_{target}_f1": each[found.config.name]["weighted_f1"], f"{target}_metrics": each})
        return found

    return Predictor(made, best("category", category), best("priority", priority), metrics)


_KINDS = {LR: LogisticRegressionModel, NB: NaiveBayesModel, RF: RandomForestClassificationModel}


def _save(spark: SparkSession, classifier: Classifier, path: str) -> None:
    described = {"config": classifier.config.__dict__, "labels": classifier.labels}
    if classifier.config.kind == SVM:
        rows = [(p, classifier.weights[:, p].tolist(), *map(float, classifier.sigmoids[:, p])) for p in range(classifier.weights.shape[1])]
        spark.createDataFrame(rows, "problem int, weights array<double>, a double, b double").write.parquet(f"{path}/model")
    else:
        classifier.model.write().save(f"{path}/model")
    files.write_json(spark, f"{path}/described.json", described)


def _load(spark: SparkSession, path: str) -> Classifier:
    described = json.loads(files.read_text(spark, f"{path}/described.json"))
    out = Classifier(Config(**described["config"]), described["labels"])
    if out.config.kind == SVM:
        rows = sorted(spark.read.parquet(f"{path}/model").collect(), key=lambda r: r.problem)  # a row for each class and fold
        out.weights, out.sigmoids = np.array([r.weights for r in rows]).T, np.array([(r.a, r.b) for r in rows]).T
    else:
        out.model = _KINDS[out.config.kind].load(f"{path}/model")
    return out


_LOADED: dict[tuple[str, str, str], Predictor] = {}


class ModelStore:
    """Versions of a predictor below a path, and which of them is active.

    A version is written whole before its name counts; ``active.json`` names the active one and is replaced in one step,
    so a reader never meets half of a model.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def save(self, predictor: Predictor, version: str, activate: bool = False) -> None:
        """Store features, both classifiers and metrics as ``version``, replacing one of that name."""
        folder = f"{version}-{uuid.uuid4().hex[:8]}"
        at = f"{self.path}/{folder}"
        described = {"terms": predictor.features.terms, "idf": predictor.features.idf, "sublinear": predictor.features.sublinear, "letters": predictor.features.letters}
        files.write_json(self.spark, f"{at}/features.json", described)
        _save(self.spark, predictor.category, f"{at}/category")
        _save(self.spark, predictor.priority, f"{at}/priority")
        files.write_json(self.spark, f"{at}/metrics.json", predictor.metrics)
        registry = self.registry()
        registry["versions"] = registry.get("versions", {}) | {version: {"folder": folder, "metrics": predictor.metrics}}
        files.write_json(self.spark, f"{self.path}/active.json", registry | ({"active": version} if activate else {}))

    def registry(self) -> dict:
        """The versions and the active one; empty where nothing is stored."""
        return files.read_json(self.spark, f"{self.path}/active.json")

    def activate(self, version: str) -> None:
        """Make a stored version the active one; raises KeyError for an unknown one."""
        registry = self.registry()
        if version not in registry.get("versions", {}):
            raise KeyError(version)
        files.write_json(self.spark, f"{self.path}/active.json", registry | {"active": version})

    def load(self, version: str | None = None) -> Predictor | None:
        """A version, by default the active one, with all its parts, or None if one is missing or damaged."""
        registry = self.registry()
        entry = registry.get("versions", {}).get(version or registry.get("active"))
        if entry is None:
            return None
        key, at = (self.spark.sparkContext.applicationId, self.path, entry["folder"]), f"{self.path}/{entry['folder']}"
        if key not in _LOADED:
            try:
                described = Features(**json.loads(files.read_text(self.spark, f"{at}/features.json")))
                found = Predictor(described, _load(self.spark, f"{at}/category"), _load(self.spark, f"{at}/priority"), files.read_json(self.spark, f"{at}/metrics.json"))
            except Exception:  # noqa: BLE001  whatever is wrong with a part, there is no model
                return None
            for old in [k for k in _LOADED if k[:2] == key[:2] and len(_LOADED) > 4]:
                del _LOADED[old]
            _LOADED[key] = found
        return _LOADED[key]

    def predict(self, rows: DataFrame) -> DataFrame:
        """The active version's prediction records, error records where there is none."""
        found = self.load()
        return found.predict(rows) if found else unloaded(rows)


def retrain(store: ModelStore, train: DataFrame, validation: DataFrame, holdout: DataFrame, feedback: DataFrame, promote: bool = False, config: Config = CANDIDATES[-1], least: float = 0.85) -> dict:
    """Train a priority candidate with validated feedback, weigh it against the active model, and promote it if asked and fit.

    Rows: (ticket_id, ticket_text, priority); feedback: (ticket_id, ticket_text, corrected_priority, validated). The active
    version's features are used as they are. The gate passes if the candidate is no worse on the holdout and good
    enough on validation; on promotion the active version stays stored under its name. Returns the decision.
    """
    active = store.load()
    if active is None:
        raise ValueError("there is no active model to compare with")
    sound = feedback.where((F.col("validated") == 1) & (F.coalesce(F.length("ticket_text"), F.lit(0)) > 0))
    more = sound.select(F.concat(F.lit("feedback "), "ticket_id").alias("ticket_id"), "ticket_text", F.col("corrected_priority").alias("priority"), F.lit("train").alias("split"))
    sets = [f.select("ticket_id", "ticket_text", "priority", F.lit(s).alias("split")) for f, s in ((train, "train"), (validation, "validation"), (holdout, "holdout"))]
    rows = sets[0].unionByName(sets[1]).unionByName(sets[2]).unionByName(more)
    vectors, kinds = by_kind(rows, active.features.letters, config.signals or active.priority.config.signals)
    kinds = vectors_of(active.features, kinds)
    model = fit(vectors.where("split = 'train'"), "priority", config, active.features.width(config.signals), kinds=kinds)
    held = vectors.where("split <> 'train'")
    both = [files.written(predicted(m, held, "priority", ("split",), kinds).withColumn("model", F.lit(n)), "predictions") for n, m in (("candidate", model), ("production", active.priority))]
    found = {(r.model, r.split): r for r in evaluate.summary(both[0].unionByName(both[1]), ["model", "split"], "truth", "predicted").collect()}  # four rows
    passed = evaluate.promotion(found["candidate", "holdout"].accuracy, found["production", "holdout"].accuracy, found["candidate", "validation"].accuracy, least)
    decision = {
        "candidate_val_accuracy": found["candidate", "validation"].accuracy, "candidate_val_macro_f1": found["candidate", "validation"].macro_f1,
        "candidate_holdout_accuracy": found["candidate", "holdout"].accuracy, "candidate_holdout_macro_f1": found["candidate", "holdout"].macro_f1,
        "production_val_accuracy": found["production", "validation"].accuracy,
        "production_holdout_accuracy": found["production", "holdout"].accuracy, "production_holdout_macro_f1": found["production", "holdout"].macro_f1,
        "validated_feedback_samples_used": sound.count(), "promotion_gate_passed": passed, "explicit_promotion_requested": promote,
        "action_taken": "Promoted to production" if promote and passed else "Retained candidate in isolation",
    }
    number = 1 + len(store.registry().get("versions", {}))
    store.save(Predictor(active.features, active.category, model, active.metrics | {"decision": decision}), f"v{number}", activate=promote and passed)
    return decision
