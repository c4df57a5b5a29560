"""Choosing between candidates by fixed rules, weights and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prob, text
from .frames import names, rows


def feature_top_k(contributions: DataFrame, by, models: int, k: int = 5) -> DataFrame:
    """Mean contribution per feature over all ``models`` (absent counts as zero), largest absolute first."""
    by = names(by)
    g = contributions.groupBy(*by, "feature").agg((F.sum("contribution") / models).alias("contribution"))
    w = Window.partitionBy(*by).orderBy(F.abs("contribution").desc(), "feature")
    return g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def last_n(df: DataFrame, by, order, n: int) -> DataFrame:
    w = Window.partitionBy(*names(by)).orderBy(*[F.col(o).desc() for o in names(order)])
    return df.withColumn("back", F.row_number().over(w)).filter(F.col("back") <= n)


def ladder_choice(scores: DataFrame, by, ladder=("rw", "drift", "ar", "var")) -> DataFrame:
    """Climb the ladder only to a model whose upper bound against the current one is below zero.

    scores: by..., model, baseline, hi. One row per pair; a group has at most ladder-size squared rows.
    """
    by = names(by)
    pairs = F.map_from_entries(F.collect_list(F.struct(F.concat_ws(">", "baseline", "model"), "hi")))
    g = scores.filter("hi is not null").groupBy(*by).agg(pairs.alias("m"))
    steps = F.array(*[F.lit(x) for x in ladder[1:]])
    pick = F.aggregate(steps, F.lit(ladder[0]), lambda now, nxt: F.when(
        F.coalesce(F.try_element_at("m", F.concat_ws(">", now, nxt)) < 0, F.lit(False)), nxt).otherwise(now))
    return g.select(*by, pick.alias("chosen"))


def select_by_inner(maes: DataFrame, by, reference: str, least_wins: int = 2) -> DataFrame:
    """Lowest mean inner error among candidates that beat the reference in enough inner blocks; else the reference.

    maes: by..., candidate, block, mae.
    """
    by = names(by)
    ref = maes.filter(F.col("candidate") == reference).select(*by, "block", F.col("mae").alias("_r"))
    j = maes.join(ref, [*by, "block"])
    g = j.groupBy(*by, "candidate").agg(F.avg("mae").alias("mean"), F.sum((F.col("mae") < F.col("_r")).cast("int")).alias("wins"), F.avg("_r").alias("ref"))
    ok = g.filter((F.col("candidate") == reference) | ((F.col("wins") >= least_wins) & (F.col("mean") < F.col("ref"))))
    return ok.groupBy(*by).agg(F.min_by("candidate", F.struct("mean", "candidate")).alias("chosen"), F.min("mean").alias("mean_mae"))


def prequential_choice(pairs: DataFrame, by, order: str, base: str, candidate: str, truth: str, least: int = 8) -> DataFrame:
    """Per row the candidate only if its past paired error is lower over at least ``least`` pairs."""
    past = rows(by, order, None, -1)
    gain = F.abs(F.col(candidate) - F.col(truth)) - F.abs(F.col(base) - F.col(truth))
    f = pairs.withColumn("_g", gain)
    ok = (F.count("_g").over(past) >= least) & (F.avg("_g").over(past) < 0) & F.col(candidate).isNotNull()
    return f.withColumn("use_candidate", F.coalesce(ok, F.lit(False))).withColumn(
        "prediction", F.when(F.col("use_candidate"), F.col(candidate)).otherwise(F.col(base))).drop("_g")


def best_weight(df: DataFrame, by, a=("a0", "a1", "a2"), b=("b0", "b1", "b2"), y="y", grid=(0.0, 0.25, 0.5, 0.75, 1.0), least: int = 20):
    """Mixing weight of two probability vectors with the lowest log loss; 0.5 with too few rows. Earlier grid points win ties."""
    by = names(by)
    losses = []
    for w in grid:
        p = F.array(*[w * F.col(x) + (1 - w) * F.col(z) for x, z in zip(a, b)])
        losses.append(F.avg(prob.log_loss(p, F.col(y))).alias(f"l{w}"))
    g = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *losses)
    items = F.array(*[F.struct(F.round(F.col(f"`l{w}`"), 12).alias("loss"), F.lit(float(w)).alias("w")) for w in grid])
    best = F.array_min(items)
    return g.select(*by, "n", F.when(F.col("n") < least, 0.5).otherwise(best["w"]).alias("weight"), best["loss"].alias("loss"))


def term_ranking(heads: DataFrame, stop=(), suffixes=(), limit: int = 10, per_term: int = 3, min_sources: int = 2, min_articles: int = 2):
    """Terms of a day's headlines by number of sources, then articles, then recency, with the newest articles of each.

    A suffix is cut only if the stem occurs by itself that day. Every step is a grouped aggregate; the top lists are
    row-number limits, which Spark applies per task before the shuffle.
    """
    h = heads.withColumn("day", F.col("time").cast("date")).withColumn("key", text.title_key(F.col("title"))).filter("key <> ''")
    first = h.groupBy("day", "key").agg(F.max_by(F.struct("doc_id", "time", "source", "title"), F.struct("time", "doc_id")).alias("h")).select("day", "h.*")
    words = first.select("day", "doc_id", "time", "source", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"([\p{L}\p{N}]{2,})"), 1))).alias("word"))
    cuts = F.filter(F.array(*[F.when(F.col("word").endswith(s) & (F.length("word") - len(s) >= 2), F.expr(f"left(word, length(word) - {len(s)})")) for s in suffixes]),
                    lambda x: x.isNotNull())
    vocab = words.select("day", F.col("word").alias("stem")).distinct()
    uniq = words.select("day", "word").distinct()
    stems = uniq.select("day", "word", F.posexplode(cuts).alias("i", "stem")).join(vocab, ["day", "stem"]).groupBy("day", "word").agg(
        F.min_by("stem", "i").alias("stem"))
    t = words.join(stems, ["day", "word"], "left").withColumn("term", F.coalesce("stem", "word"))
    t = t.filter(~F.col("term").isin(*stop) & ~F.col("word").isin(*stop)) if stop else t
    t = t.groupBy("day", "term", "doc_id").agg(F.max("time").alias("time"), F.max("source").alias("source"))
    g = t.groupBy("day", "term").agg(F.countDistinct("source").alias("sources"), F.count(F.lit(1)).alias("articles"), F.max("time").alias("latest"))
    g = g.filter((F.col("articles") >= min_articles) & (F.col("sources") >= min_sources))
    order = Window.partitionBy("day").orderBy(F.col("sources").desc(), F.col("articles").desc(), F.col("latest").desc(), F.col("term").desc())
    top = g.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= limit)
    newest = Window.partitionBy("day", "term").orderBy(F.col("time").desc(), F.col("doc_id").desc())
    news = t.join(top.select("day", "term"), ["day", "term"], "left_semi").withColumn("k", F.row_number().over(newest)).filter(F.col("k") <= per_term)
    ids = news.groupBy("day", "term").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "doc_id"))), lambda x: x["doc_id"].cast("string")), ",").alias("newest"))
    return top.join(ids, ["day", "term"])
