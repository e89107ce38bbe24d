"""Terms, their vocabulary and multinomial naive Bayes: what belongs to one document is made in its row."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..sources import files


def words_of(text: Column, letters: bool = False) -> Column:
    """The words of the preprocessed text, ``ticket`` where none is left; ``letters``: runs of two or more word characters."""
    done = X.preprocess(text)
    done = F.when(done == "", "ticket").otherwise(done)
    return F.filter(F.split(done, r"[^\p{L}\p{N}_]+"), lambda t: F.length(t) > 1) if letters else F.filter(F.split(done, " "), lambda t: t != "")


def terms_of(words: Column) -> Column:
    """Words and pairs of neighbouring words."""
    pairs = lambda w: F.zip_with(F.slice(w, F.lit(1), F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, F.lit(2), F.size(w)), lambda a, b: F.concat(a, F.lit(" "), b))
    return X.bound(words, lambda w: F.concat(w, pairs(w)))


def by_shape(rows: DataFrame, make: Callable[[Column], Column]) -> tuple[DataFrame, DataFrame]:
    """(_shape, kind) and (kind, made), both written: ``make`` of the shape (:func:`text.shape`) of ``rows``' ticket_text, once for each different one.

    What is wide is there once for each different ``made``; rows meet their shapes by a narrow table. Shapes are dealt over all
    cores, as few bytes of them may be much work.
    """
    shapes = rows.select(X.shape(F.col("ticket_text")).alias("_shape")).distinct().repartition(rows.sparkSession.sparkContext.defaultParallelism, "_shape")
    told = files.written(shapes.select("_shape", make(F.col("_shape")).alias("made")), "shapes")
    kinds = files.written(told.select("made").distinct().withColumn("kind", F.monotonically_increasing_id()), "kinds")
    return files.written(told.join(kinds, "made").select("_shape", "kind"), "kind_of"), kinds


def vocabulary(docs: DataFrame, words: Column, n_docs: DataFrame, size: int, times: Column | None = None) -> DataFrame:
    """(term, idf) of the ``size`` terms with the highest counts, ties by term; a row of ``docs`` is a document, or ``times`` equal ones, ``n_docs``: one row with n.

    A row's terms are counted in the row: only terms with their sums are shuffled, never (document, term) pairs.
    """
    first = lambda s: F.transform(s, lambda t, i: F.struct(t.alias("term"), F.when((i > 0) & (F.get(s, i - 1) == t), 0).otherwise(1).alias("first")))
    counted = docs.select((F.lit(1) if times is None else times).alias("times"), F.explode(X.bound(F.sort_array(terms_of(words)), first)).alias("x")).select("times", "x.*")
    top = counted.groupBy("term").agg(F.sum(F.col("first") * F.col("times")).alias("df"), F.sum("times").alias("total")).orderBy(F.desc("total"), F.asc("term")).limit(size)
    return top.crossJoin(n_docs).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))  # a single row beside each


def bayes_train(weighted: DataFrame, labels: DataFrame, smoothing: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """(label, prior) and (label, term, log probability) with additive smoothing; ``weighted``: (label, term, weight), ``labels``: a row a document."""
    classes = labels.groupBy("label").agg(F.count("*").alias("n"))
    priors = classes.select("label", F.log(F.col("n") / F.sum("n").over(Window.partitionBy())).alias("prior"))
    mass = files.written(weighted.groupBy("label", "term").agg(F.sum("weight").alias("mass")), "mass")
    cells = mass.select("term").distinct().crossJoin(classes.select("label")).join(mass, ["label", "term"], "left").withColumn("mass", F.coalesce("mass", F.lit(0.0)) + smoothing)  # terms x a few labels
    return priors, cells.select("label", "term", F.log(F.col("mass") / F.sum("mass").over(Window.partitionBy("label"))).alias("logp"))


def bayes_predict(weighted: DataFrame, terms: list[str], priors: DataFrame, likelihood: DataFrame) -> DataFrame:
    """``weighted`` (_at: places in ``terms``, _w: weights) with the prediction in their place: the label with the highest joint log probability, ties to the lesser.

    The likelihoods, terms times a few labels, reach the driver and go with the plan; a row is decided by itself. Rows without a known term are left out.
    """
    place = {t: i for i, t in enumerate(terms)}
    logp = {r.label: ([0.0] * len(terms), r.prior) for r in priors.orderBy("label").collect()}
    for r in likelihood.collect():
        logp[r.label][0][place[r.term]] = r.logp
    rest = [c for c in weighted.columns if c not in ("_at", "_w")]
    if not logp:
        return weighted.where(F.size("_at") > 0).select(*rest, F.lit(None).cast("string").alias("prediction"))

    def joint(terms: Column, values: list[float], prior: float) -> Column:
        of = F.from_json(F.lit(json.dumps(values)), "array<double>")
        return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x["_w"] * F.get(of, x["_at"])) + prior

    ranked = lambda terms: F.array(*[F.struct((-F.round(joint(terms, *of), 9)).alias("s"), F.lit(label).alias("label")) for label, of in logp.items()])
    # A condition on the weights would be pushed below them and make them a second time; a list of one or no predictions is not.
    told = F.when(F.size("_at") > 0, F.array(F.array_min(X.bound(F.arrays_zip("_at", "_w"), ranked))["label"]))
    return weighted.select(*rest, F.explode(told).alias("prediction"))
