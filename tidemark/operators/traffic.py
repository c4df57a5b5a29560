"""Web traffic and mailing: deduplicated hits, roll-ups, audiences."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import web

DIMENSIONS = ("country", "region", "city", "referrer")


def with_day(hits: DataFrame) -> DataFrame:
    return hits.withColumn("day", F.col("ts").cast("date"))


def countable(hits: DataFrame, bots: str = web.BOTS, own=None) -> DataFrame:
    """Hits that count: no robots, and with ``own`` origins given only requests that come from them."""
    people = hits.filter(~F.coalesce(F.col("ua"), F.lit("")).rlike(bots))
    return people if own is None else people.filter(web.from_own_page(F.col("origin"), F.col("referrer"), own))


def dedup_hits(hits: DataFrame, minutes: int = 10) -> DataFrame:
    """Counted visits: none of the same visitor, page and day in the ``minutes`` before, measured from the last counted one.

    Copies of one instant fold first. A gap of ``minutes`` since the previous hit always starts anew, so each
    (visitor, page, day) falls into islands, and only an island is walked in order. At one-second
    resolution an island has at most 86,400 instants whatever the traffic.
    """
    key = ["visitor", "page", "day"]
    h = with_day(countable(hits)).groupBy(*key, "ts").agg(F.min("event_id").alias("event_id"))
    h = h.withColumn("_s", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy(*key).orderBy("_s")
    span = minutes * 60_000_000
    starts = F.when(F.coalesce(F.col("_s") - F.lag("_s").over(w) >= span, F.lit(True)), 1).otherwise(0)
    h = h.withColumn("_start", starts).withColumn("_island", F.sum("_start").over(w))
    runs = h.groupBy(*key, "_island").agg(F.array_sort(F.collect_list(F.struct("_s", "event_id"))).alias("es"))
    first = F.slice("es", 1, 1)
    kept = F.aggregate(F.slice("es", 2, F.greatest(F.size("es") - 1, F.lit(0))), first, lambda acc, e: F.when(
        e["_s"] - F.element_at(acc, -1)["_s"] >= span, F.concat(acc, F.array(e))).otherwise(acc))
    return runs.select(*key, F.explode(kept).alias("e")).select(
        *key, F.timestamp_micros("e._s").cast("timestamp_ntz").alias("ts"), "e.event_id")


def attributed_visits(hits: DataFrame, minutes: int = 10) -> DataFrame:
    """Counted visits with the first email hit among themselves and the hits that they absorbed.

    A visit that came without attribution takes it from a later hit of the same visitor and page that did not count.
    """
    key = ["visitor", "page", "day"]
    counted = dedup_hits(hits, minutes).withColumnsRenamed({"event_id": "visit"})
    every = with_day(countable(hits)).select(*key, "ts", "event_id", "source").join(counted, [*key, "ts"], "left")
    owner = F.last("visit", ignorenulls=True).over(Window.partitionBy(*key).orderBy("ts").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    email = F.when(F.col("source") == "email", F.struct("ts", "event_id"))
    return (every.withColumn("visit", owner).groupBy(*key, "visit").agg(F.min("ts").alias("ts"), F.min(email).alias("first"))
            .select(*key, "ts", F.col("visit").alias("event_id"), F.when(F.col("first").isNotNull(), "email").otherwise("").alias("source"),
                    F.col("first.event_id").alias("attributed_by")))


def running_totals(counted: DataFrame) -> DataFrame:
    return counted.groupBy("page").agg(F.count(F.lit(1)).alias("total"))


def daily_traffic(hits: DataFrame, most: int = 30) -> DataFrame:
    """Views and visitors per day and page, day and region, day and city, and the top values of each dimension.

    One pass of grouping sets; the top lists rank the already grouped rows.
    """
    f = with_day(hits).select("day", "page", *DIMENSIONS, "visitor")
    g = f.groupingSets(
        [[F.col("day"), F.col("page")], [F.col("day"), F.col("region")], [F.col("day"), F.col("city")],
         [F.col("country")], [F.col("region")], [F.col("city")], [F.col("referrer")]],
        "day", "page", *DIMENSIONS,
    ).agg(F.grouping_id().alias("gid"), F.count(F.lit(1)).alias("views"), F.countDistinct("visitor").alias("visitors"))
    dims = ["page", *DIMENSIONS]
    value = F.coalesce(*[F.col(d) for d in dims])
    bit = {d: 1 << (len(dims) - 1 - i) for i, d in enumerate(dims)}
    dim = F
    for d in dims:
        dim = dim.when((F.col("gid").bitwiseAND(bit[d])) == 0, d)
    t = g.select(dim.alias("dimension"), "day", value.alias("value"), "views", "visitors").filter((F.col("value") != "") | (F.col("dimension") == "page"))
    w = Window.partitionBy("dimension").orderBy(F.col("views").desc(), "value")
    top = t.filter("day is null").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)
    return t.filter("day is not null").withColumn("rank", F.lit(None).cast("int")).unionByName(top)


def top_dimension(hits: DataFrame, most: int = 30, dims=DIMENSIONS) -> DataFrame:
    """Most viewed values of each dimension; blanks left out."""
    long = hits.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in dims])).alias("e"))
    t = long.select("e.*").filter("value <> ''").groupBy("dimension", "value").agg(F.count(F.lit(1)).alias("views"))
    w = Window.partitionBy("dimension").orderBy(F.col("views").desc(), "value")
    return t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= most)


def email_traffic(hits: DataFrame) -> DataFrame:
    """Views of email visits by day and page, by country and by device."""
    e = with_day(hits).filter("source = 'email'")
    tag = lambda kind, a, b: F.struct(F.lit(kind).alias("report"), a.cast("string").alias("a"), b.alias("b"))
    rows = e.select(F.explode(F.array(
        tag("day_page", F.col("day"), F.col("page")), tag("country", web.country_or_unknown(F.col("country")), F.lit("")),
        tag("device", web.device_class(F.col("ua")), F.lit("")))).alias("r")).select("r.*")
    return rows.groupBy("report", "a", "b").agg(F.count(F.lit(1)).alias("views"))


def tumbling_views(hits: DataFrame, exact: bool = True) -> DataFrame:
    """Views and visitors per day window and page; streams use the approximate distinct count."""
    n = F.countDistinct("visitor") if exact else F.approx_count_distinct("visitor")
    return hits.groupBy(F.window("ts", "1 day")["start"].cast("timestamp_ntz").alias("day"), "page").agg(
        F.count(F.lit(1)).alias("views"), n.alias("visitors"))


def audience(editions: DataFrame, subscribers: DataFrame, deliveries: DataFrame, stopped: DataFrame, sections: DataFrame) -> DataFrame:
    """Due recipients: subscribed before the edition, not stopped, not yet tried, every needed section present.

    editions (edition, created_at), subscribers (email, page, since), deliveries (edition, email, attempts),
    stopped (edition), sections (edition, page). The result itself is editions times subscribers.
    """
    live = editions.join(stopped, "edition", "left_anti")
    pairs = eligible(live, subscribers)
    lacking = pairs.join(sections, ["edition", "page"], "left_anti").select("edition", "email").distinct()
    tried = deliveries.filter("attempts > 0").select("edition", "email").distinct()
    due = pairs.select("edition", "email").distinct()
    return due.join(lacking, ["edition", "email"], "left_anti").join(tried, ["edition", "email"], "left_anti")


def eligible(editions: DataFrame, subscribers: DataFrame, salts: int = 64) -> DataFrame:
    """(edition, created_at, email, page) with the subscription older than the edition.

    The answer has a row per edition and subscriber, so subscribers stay where their hash puts them and the editions, a
    calendar, are copied to every one of the ``salts`` parts; no time bucket gathers them.
    """
    parts = editions.select("edition", "created_at").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    people = subscribers.select("email", "page", "since").withColumn("_part", F.pmod(F.xxhash64("email"), F.lit(salts)).cast("int"))
    return people.join(parts, "_part").filter(F.col("since") <= F.col("created_at")).select("edition", "created_at", "email", "page")


def audience_sizes(editions: DataFrame, subscribers: DataFrame) -> DataFrame:
    """``edition`` and how many different subscribers it concerns, by a sweep: +1 on the day a subscriber first joins.

    Joins fold to instants, instants to a running count, and each edition reads the count at its time; no pairs.
    """
    from .asof import asof_join

    first = subscribers.groupBy("email").agg(F.min("since").alias("since")).filter("since is not null")
    joined = first.groupBy("since").agg(F.count(F.lit(1)).alias("n")).withColumn("_all", F.lit(1))
    month = joined.withColumn("_m", F.trunc(F.col("since").cast("date"), "MM"))
    # Running count in two steps, so that no task holds all instants: inside each month, then over months.
    own = F.sum("n").over(Window.partitionBy("_m").orderBy("since").rowsBetween(Window.unboundedPreceding, 0))
    before = F.sum("n").over(Window.partitionBy("_all").orderBy("_m").rowsBetween(Window.unboundedPreceding, -1))
    months = month.groupBy("_m", "_all").agg(F.sum("n").alias("n")).select("_m", F.coalesce(before, F.lit(0)).alias("_before"))
    running = month.withColumn("_own", own).join(months, "_m").select("_all", "since", (F.col("_own") + F.col("_before")).alias("audience"))
    met = asof_join(editions.withColumn("_all", F.lit(1)), running, "created_at", "since", "_all", ["audience"])
    return met.select("edition", F.coalesce("audience", F.lit(0)).cast("bigint").alias("audience"))


def delivery_counts(editions: DataFrame, subscribers: DataFrame, deliveries: DataFrame, stopped: DataFrame) -> DataFrame:
    """The rollup of ``delivery_history`` without its rows: audience sizes by a sweep, everything else from the deliveries.

    An edition concerns its audience and whoever has a delivery. Deliveries tell their own statuses; those of the audience
    without one are pending, or cancelled if the edition was stopped.
    """
    first = subscribers.groupBy("email").agg(F.min("since").alias("since"))
    d = deliveries.join(first, "email", "left").join(editions.select("edition", "created_at"), "edition", "left")
    inside = F.coalesce(F.col("since") <= F.col("created_at"), F.lit(False))
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    st = lambda s: n(F.col("status") == s)
    open_ = ~F.coalesce(F.col("status").isin("sent", "sending", "failed", "cancelled"), F.lit(False))
    g = d.groupBy("edition").agg(F.count(F.lit(1)).alias("_all"), n(inside).alias("_in"), n(F.col("attempts") > 0).alias("attempted"), st("sent").alias("accepted"), st("failed").alias("failed"),
                                 st("cancelled").alias("_cancelled"), st("sending").alias("sending"), n(open_).alias("_open"), F.max("sent_at").alias("last_sent"))
    j = audience_sizes(editions, subscribers).join(g, "edition", "full").join(stopped.select("edition", F.lit(True).alias("_stop")).distinct(), "edition", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    waiting = zero("audience") - zero("_in") + zero("_open")
    stop = F.coalesce("_stop", F.lit(False))
    return j.select("edition", (zero("audience") - zero("_in") + zero("_all")).alias("eligible"), zero("attempted").alias("attempted"), zero("accepted").alias("accepted"), zero("failed").alias("failed"),
                    (zero("_cancelled") + F.when(stop, waiting).otherwise(0)).alias("cancelled"), zero("sending").alias("sending"), F.when(stop, F.lit(0)).otherwise(waiting).cast("bigint").alias("remaining"),
                    "last_sent").filter("eligible > 0")


def delivery_history(editions: DataFrame, subscribers: DataFrame, deliveries: DataFrame, stopped: DataFrame) -> DataFrame:
    """Everyone an edition concerned with a derived status: the audience plus recorded deliveries."""
    people = eligible(editions, subscribers).select("edition", "email").union(deliveries.select("edition", "email")).distinct()
    s = stopped.select("edition", F.lit(1).alias("_stop"))
    j = people.join(deliveries, ["edition", "email"], "left").join(s, "edition", "left")
    status = F.when(F.col("status").isin("sent", "sending", "failed", "cancelled"), F.col("status")).when(F.col("_stop") == 1, "cancelled").otherwise("pending")
    return j.select("edition", "email", status.alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "sent_at")


def delivery_rollup(history: DataFrame) -> DataFrame:
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    st = lambda s, a: n(F.col("status") == s).alias(a)
    return history.groupBy("edition").agg(
        F.count(F.lit(1)).alias("eligible"), n(F.col("attempts") > 0).alias("attempted"), st("sent", "accepted"), st("failed", "failed"),
        st("cancelled", "cancelled"), st("sending", "sending"), st("pending", "remaining"), F.max("sent_at").alias("last_sent"))
