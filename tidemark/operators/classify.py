"""Three-class direction models on MLlib: setting choice on inner date blocks, temperature, walk-forward predictions."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prob
from ..session import cut_lineage
from . import ranks
from .evaluate import STATISTICS, auc_bootstrap, block_bootstrap, date_blocks, month
from .frames import names
from .metrics import balanced_accuracy

TEMPERATURES = (1.0, 0.75, 1.5, 2.0)


def assembled(rows_: DataFrame, x, y: str, keep) -> DataFrame:
    """Complete rows as (keep, label, features), written once so that every fit reads the same table."""
    f = VectorAssembler(inputCols=list(x), outputCol="features").transform(rows_.dropna(subset=[*x, y]))
    return cut_lineage(f.select(*keep, F.col(y).cast("double").alias("label"), "features"))


def class_counts(train: DataFrame) -> dict[float, int]:
    """Rows per class: three numbers."""
    return {r["label"]: r["count"] for r in train.groupBy("label").count().collect()}


def fit(train: DataFrame, family: str, c: float = 0.01, balanced: bool = False, seed: int = 42, counts: dict | None = None):
    """One model; the penalty follows the sample size so that ``c`` means the same on any sample.

    Balanced weights are n / (3 n_class).
    """
    counts = counts or class_counts(train)
    n = sum(counts.values())
    weight = F.lit(1.0)
    if balanced:
        pairs = [F.lit(x) for k, m in counts.items() for x in (k, n / (3.0 * m))]
        weight = F.create_map(*pairs)[F.col("label")]
    t = train.withColumn("weight", weight)
    if family == "forest":
        return RandomForestClassifier(numTrees=40, maxDepth=5, minInstancesPerNode=20, seed=seed, weightCol="weight").fit(t)
    return LogisticRegression(family="multinomial", regParam=1.0 / (c * n), maxIter=30, tol=1e-4, weightCol="weight").fit(t)


def probabilities(model, rows_: DataFrame) -> DataFrame:
    p = vector_to_array("probability")
    return model.transform(rows_).withColumns({n: F.coalesce(F.get(p, F.lit(i)), F.lit(0.0)) for i, n in enumerate(prob.P3)}).drop(
        "rawPrediction", "probability", "prediction", "features")


def losses(scored: DataFrame, temperatures=(1.0,)) -> dict[float, tuple[float, float]]:
    """Mean log loss and accuracy at each temperature, in one pass."""
    y = F.col("label").cast("int")
    aggs = []
    for t in temperatures:
        aggs.append(F.avg(prob.log_loss(F.array(*prob.softened(temperature=t)), y)).alias(f"l{t}"))
    row = scored.agg(F.avg((prob.argmax(prob.vector()) == y).cast("double")).alias("acc"), *aggs).first()
    return {t: (row[f"l{t}"], row["acc"]) for t in temperatures}


def choose(train: DataFrame, date: str, cs=(0.003, 0.01, 0.03), weights=(False, True), splits: int = 3, block: int = 126) -> dict:
    """Setting with the lowest inner log loss (then accuracy) over validation blocks of dates, and its temperature."""
    parts = cut_lineage(date_blocks(train, date, splits, block))
    best = None
    sides = [(s, parts.filter((F.col("split") == s) & (F.col("side") == "train")).drop("split", "side"),
              parts.filter((F.col("split") == s) & (F.col("side") == "validate")).drop("split", "side")) for s in range(1, splits + 1)]
    counts = {s: class_counts(a) for s, a, _ in sides}
    settings = [(c, w) for c in cs for w in weights]
    # The fits do not depend on each other and share the cluster.
    with ThreadPoolExecutor(6) as pool:
        every = list(pool.map(lambda t: losses(probabilities(fit(t[2], "linear", t[0][0], t[0][1], counts=counts[t[1]]), t[3]), TEMPERATURES),
                              [(cw, s, a, b) for cw in settings for s, a, b in sides]))
    for i, (c, w) in enumerate(settings):
        got = every[i * len(sides):(i + 1) * len(sides)]
        mean = {t: (sum(g[t][0] for g in got) / len(got), sum(g[t][1] for g in got) / len(got)) for t in TEMPERATURES}
        key = (mean[1.0][0], -mean[1.0][1])
        if best is None or key < best["key"]:
            temp = min(TEMPERATURES, key=lambda t: mean[t][0])
            best = {"key": key, "c": c, "balanced": w, "temperature": temp, "inner_loss": mean[temp][0]}
    return best


@dataclass
class Boosted:
    """Three one-vs-rest boosters and the multinomial model that turns their margins into probabilities."""

    models: list
    calibrator: object
    trees: list[int]
    inner_loss: float

    def probabilities(self, rows_: DataFrame) -> DataFrame:
        return probabilities(self.calibrator, margins(self.models, rows_))


def _booster(k: int, trees: int, depth: int, step: float, seed: int, watched: bool) -> GBTClassifier:
    more = {"validationIndicatorCol": "_val", "validationTol": 0.0} if watched else {}
    return GBTClassifier(labelCol="_y", maxIter=trees, maxDepth=depth, stepSize=step, maxBins=32, minInstancesPerNode=20, seed=seed + k, checkpointInterval=-1, **more)


def margins(models, rows_: DataFrame) -> DataFrame:
    """``features`` replaced by the three raw margins of the one-vs-rest models."""
    out = rows_
    for k, m in enumerate(models):
        out = m.setRawPredictionCol(f"_r{k}").setProbabilityCol(f"_q{k}").setPredictionCol(f"_g{k}").transform(out)
    raw = F.array(*[F.get(vector_to_array(f"_r{k}"), F.lit(1)) for k in range(len(models))])
    return out.withColumn("features", array_to_vector(raw)).drop(*[f"{c}{k}" for c in ("_r", "_q", "_g") for k in range(len(models))])


def _calibrator(held: DataFrame):
    """Multinomial regression on the margins; a light penalty keeps it finite where a class is told apart perfectly."""
    return LogisticRegression(family="multinomial", regParam=1e-3, maxIter=50, tol=1e-6).fit(held)


def fit_boosted(train: DataFrame, date: str, splits: int = 2, block: int = 126, trees: int = 12, depth: int = 4, step: float = 0.3, seed: int = 42, threads: int = 6) -> Boosted:
    """Boosted trees for three classes, with what only past blocks can tell.

    Each class has a binary booster against the rest, which stops where the loss on the inner block of dates after its rows
    no longer falls. The margins of the three on their blocks are held out, and one multinomial model on them calibrates
    all classes together, so probabilities sum to one. ``inner_loss`` is the mean log loss over the blocks, each judged by a
    calibrator of the others. The boosters are then fitted on all rows with the mean number of trees. The fits of a round do
    not depend on each other and share the cluster.
    """
    parts = cut_lineage(date_blocks(train, date, splits, block).withColumn("_val", F.col("side") == "validate"))
    one = lambda frame, k: frame.withColumn("_y", (F.col("label") == k).cast("double"))
    tasks = [(s, k) for s in range(1, splits + 1) for k in range(3)]
    with ThreadPoolExecutor(threads) as pool:
        fitted = dict(zip(tasks, pool.map(lambda t: _booster(t[1], trees, depth, step, seed, True).fit(one(parts.filter(F.col("split") == t[0]), t[1])), tasks)))
        held = None
        for s in range(1, splits + 1):
            own = margins([fitted[s, k] for k in range(3)], parts.filter((F.col("split") == s) & F.col("_val"))).select("split", "label", "features")
            held = own if held is None else held.unionByName(own)
        held = cut_lineage(held)
        counts = [max(1, round(sum(fitted[s, k].getNumTrees for s in range(1, splits + 1)) / splits)) for k in range(3)]
        whole = list(pool.map(lambda k: _booster(k, counts[k], depth, step, seed, False).fit(one(train, k)), range(3)))
        inner = list(pool.map(lambda s: losses(probabilities(_calibrator(held.filter(F.col("split") != s)), held.filter(F.col("split") == s)))[1.0][0], range(1, splits + 1)))
    return Boosted(whole, _calibrator(held), counts, sum(inner) / len(inner))


def forest_inner_loss(train: DataFrame, date: str, splits: int = 2, block: int = 126) -> float:
    """Mean log loss of the forest over the same inner blocks."""
    parts = cut_lineage(date_blocks(train, date, splits, block))
    side = lambda s, name: parts.filter((F.col("split") == s) & (F.col("side") == name)).drop("split", "side")
    with ThreadPoolExecutor(splits) as pool:
        found = list(pool.map(lambda s: losses(probabilities(fit(side(s, "train"), "forest"), side(s, "validate")))[1.0][0], range(1, splits + 1)))
    return sum(found) / len(found)


def walk_forward(rows_: DataFrame, spans: list[tuple[str, str]], date: str, matures: str, family: str = "linear", c: float = 0.01, years: int | None = None) -> DataFrame:
    """Out-of-fold probabilities beside the training prior, one fit per test span; the fits share the cluster."""
    def one(span: tuple[str, str]) -> DataFrame:
        t0, t1 = span
        train = rows_.filter(F.col(matures) < F.lit(t0).cast("date"))
        if years:
            train = train.filter(F.col(date) >= F.add_months(F.lit(t0).cast("date"), -12 * years))
        test = rows_.filter((F.col(date) >= F.lit(t0).cast("date")) & (F.col(date) < F.lit(t1).cast("date")))
        prior = train.agg(*[F.avg((F.col("label") == k).cast("double")).alias(f"prior_{k}") for k in range(3)]).withColumn("span", F.lit(t0))
        return probabilities(fit(train, family, c), test).withColumn("span", F.lit(t0)).join(prior, "span")

    with ThreadPoolExecutor(4) as pool:
        parts = list(pool.map(one, spans))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def walk_forward_report(oof: DataFrame, by, date: str, draws: int = 2000) -> DataFrame:
    """What out-of-fold probabilities are worth, one row per group, beside the training prior of their folds.

    oof: by..., date, span, label, p_down, p_flat, p_up, prior_0..2. Balanced accuracy and log loss of model and prior, the
    area under the curve of up, and of up against down without the flat rows, shares of the classes; intervals of the log
    loss difference and of both areas come from the same draws of calendar months.
    """
    by = names(by)
    f = cut_lineage(oof.withColumn("actual_class", F.col("label").cast("int")).withColumn("block", month(date)))
    ps, priors = [F.col(p) for p in prob.P3], [F.col(f"prior_{k}") for k in range(3)]
    loss = lambda cols: -F.ln(F.greatest(F.get(F.array(*cols), F.col("actual_class")), F.lit(1e-7)))
    f = f.withColumns({"_l": loss(ps), "_p": loss(priors), "_up": F.col("actual_class") == 2, "_side": F.col("p_up") - F.col("p_down")})
    g = f.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("span").alias("folds"), F.min(date).alias("first"), F.max(date).alias("last"),
                           F.avg("_l").alias("log_loss"), F.avg("_p").alias("prior_log_loss"), *[F.avg((F.col("actual_class") == k).cast("double")).alias(f"share_{k}") for k in range(3)])
    own = balanced_accuracy(f, by).select(*by, "balanced_accuracy")
    as_prior = f.select(*by, "actual_class", *[c.alias(p) for c, p in zip(priors, prob.P3)])
    prior = balanced_accuracy(as_prior, by).select(*by, F.col("balanced_accuracy").alias("prior_balanced_accuracy"))
    moving = f.filter("actual_class <> 1")
    ci = lambda frame, name: frame.select(*by, F.col("lo").alias(f"{name}_lo"), F.col("hi").alias(f"{name}_hi"))
    gain = block_bootstrap(f, by, "block", {"x": F.col("_l") - F.col("_p"), "n": F.lit(1.0)}, STATISTICS["mean"], draws)
    parts = [own, prior, ranks.auc(f, by, "p_up", "_up").select(*by, F.col("auc").alias("auc_up")), ranks.auc(moving, by, "_side", "_up").select(*by, F.col("auc").alias("auc_up_vs_down")),
             ci(gain, "log_loss_diff"), ci(auc_bootstrap(f, by, "block", "p_up", "_up", 0.0, 1.0, draws=draws), "auc_up"),
             ci(auc_bootstrap(moving, by, "block", "_side", "_up", draws=draws), "auc_up_vs_down")]
    for part in parts:
        g = g.join(part, by, "left")
    return g


def live_direction(rows_: DataFrame, x, y: str, by, date: str, matures: str, years: int = 3, family: str = "linear", c: float = 0.01) -> DataFrame:
    """Probabilities of each group's newest row with all features, from one model of the last ``years`` of labelled rows.

    The newest row's label is not known yet; labels that mature after it are not used either, if data has been repeated.
    """
    by = names(by)
    whole = rows_.dropna(subset=list(x))
    newest = whole.groupBy(*by).agg(F.max(date).alias(date))
    last = newest.agg(F.max(date)).scalar()
    hist = whole.filter(F.col(y).isNotNull() & (F.col(matures) <= last))
    train = cut_lineage(VectorAssembler(inputCols=list(x), outputCol="features").transform(hist.filter(F.col(date) >= F.add_months(hist.agg(F.max(date)).scalar(), -12 * years))).select(
        F.col(y).cast("double").alias("label"), "features"))
    live = VectorAssembler(inputCols=list(x), outputCol="features").transform(whole.join(newest, [*by, date])).select(*by, date, "features")
    return probabilities(fit(train, family, c), live).withColumn("n_train", F.lit(train.count()))


def contributions(model, rows_: DataFrame, x, key, k: int = 5) -> DataFrame:
    """(slope up - slope down) * (value - mean) of each row and feature, largest absolute first.

    Slopes and means are one small row each; they enter as literals.
    """
    slopes = model.coefficientMatrix.toArray()
    arr = vector_to_array("features")
    f = rows_.withColumn("_x", arr)
    means = f.agg(*[F.avg(F.get("_x", F.lit(i))).alias(c) for i, c in enumerate(x)]).first()
    items = F.array(*[F.struct(F.lit(c).alias("feature"), (float(slopes[2][i] - slopes[0][i]) * (F.get("_x", F.lit(i)) - F.lit(float(means[c])))).alias("contribution"))
                      for i, c in enumerate(x)])
    o = F.array_sort(F.transform(items, lambda e: F.struct((-F.abs(e["contribution"])).alias("o"), e["feature"].alias("feature"), e["contribution"].alias("contribution"))))
    return f.select(*key, F.posexplode(F.slice(o, 1, k)).alias("rank", "e")).select(*key, "rank", "e.feature", "e.contribution")
