"""Queries of the operators for articles, labels, events and prices, and the SQL they are held against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seismark.functions import phrases
from seismark.functions import text as tx
from seismark.operators import events as ev
from seismark.operators import ingest, models, sentiment, stocks
from seismark.operators.dataset import ArticleSet, distributions, strict_date
from seismark.operators.forest import sparse_forest
from seismark.operators.gazetteer import ACCENTED, PLAIN, gazetteer, mostly_capitalised, places_in, plain_name
from seismark.session import broadcast_if_small, cut_lineage, shared_folder, spread, written
from seismark.sources import read_table
from seismark.streaming.sessions import drain, file_stream, gap_sessions

# How much more or less often than others a search term's strata are sampled.
TERM_WEIGHTS: dict[str, float] = {"pandemic": 0.5, "stock market crash": 5.0}
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where SQL can express it."""

    def register(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def _set(spark: SparkSession, folder: str) -> ArticleSet:
    return ArticleSet(read_table(spark, folder, "articles"), read_table(spark, folder, "labels"))


_DAY = "CASE WHEN regexp_full_match(dt, '\\d{4}-\\d{2}-\\d{2}') THEN try_cast(dt AS DATE) END"


@query(
    "articles_labels_inner",
    f"SELECT a.index_id, a.title, l.label_id AS label_id_label, l.event_occured = 1 AS event_occured_label, l.event AS event_label, l.impact AS impact_label, {_DAY} AS dt_label, l.country AS country_label, a.country FROM articles a JOIN labels l ON a.index_id = l.index_id",
)
def articles_labels_inner(spark: SparkSession, folder: str) -> DataFrame:
    return _set(spark, folder).joined().select("index_id", "title", "label_id_label", "event_occured_label", "event_label", "impact_label", "dt_label", "country_label", "country")


@query("filter_label_in", "SELECT index_id, label_id, event, impact FROM labels WHERE event_occured = 1 AND event IN ('flood', 'wildfire', 'earthquake') AND impact IN (3, 4, 5) AND index_id IN (SELECT index_id FROM articles)")
def filter_label_in(spark: SparkSession, folder: str) -> DataFrame:
    kept = _set(spark, folder).where_labels(event_occured=True, event=["flood", "wildfire", "earthquake"], impact=[3, 4, 5], city=[])
    return kept.labels.join(kept.articles.select("index_id"), "index_id", "left_semi").select("index_id", "label_id", "event", "impact")


@query("filter_label_null", "SELECT index_id, title FROM articles WHERE index_id IN (SELECT index_id FROM labels WHERE city IS NULL AND latitude IS NULL AND event_occured = 1)")
def filter_label_null(spark: SparkSession, folder: str) -> DataFrame:
    return _set(spark, folder).where_labels(event_occured=True, missing=["city", "latitude"]).articles.select("index_id", "title")


@query("filter_date_between", "SELECT label_id, index_id FROM labels WHERE index_id IN (SELECT index_id FROM articles WHERE query IN ('flood', 'riots', 'tsunami') AND fetched_at BETWEEN TIMESTAMPTZ '2020-01-01 00:00:00+00' AND TIMESTAMPTZ '2023-12-31 23:59:59+00')")
def filter_date_between(spark: SparkSession, folder: str) -> DataFrame:
    span = tuple(F.lit(x).cast("timestamp") for x in ("2020-01-01 00:00:00Z", "2023-12-31 23:59:59Z"))
    return _set(spark, folder).where_articles(["flood", "riots", "tsunami"], between=span).labels.select("label_id", "index_id")


@query("filter_date_in", "SELECT index_id, url FROM articles WHERE CAST(fetched_at AT TIME ZONE 'UTC' AS DATE) IN (DATE '2019-01-06', DATE '2019-01-07', DATE '2021-06-01', DATE '2022-02-02')")
def filter_date_in(spark: SparkSession, folder: str) -> DataFrame:
    days = [F.lit(d).cast("date") for d in ("2019-01-06", "2019-01-07", "2021-06-01", "2022-02-02")]
    return _set(spark, folder).where_articles(on_dates=days).articles.select("index_id", "url")


@query("semi_articles_by_label", "SELECT index_id, domain, query FROM articles WHERE index_id IN (SELECT index_id FROM labels WHERE event_occured = 1)")
def semi_articles_by_label(spark: SparkSession, folder: str) -> DataFrame:
    return _set(spark, folder).where_labels(event_occured=True).articles.select("index_id", "domain", "query")


@query("anti_unprocessed", "SELECT DISTINCT url, domain FROM links WHERE url IS NOT NULL AND url NOT IN (SELECT url FROM articles WHERE url IS NOT NULL)")
def anti_unprocessed(spark: SparkSession, folder: str) -> DataFrame:
    articles = read_table(spark, folder, "articles", "url", "content")
    stored, failed = articles.where(F.col("content").isNotNull()).select("url"), articles.where(F.col("content").isNull()).select("url")
    return ingest.unprocessed(read_table(spark, folder, "links", "url", "domain"), "url", stored, failed).distinct()


@query(
    "dist_long",
    "SELECT \"column\", value, count(*) AS n FROM (UNPIVOT (SELECT event, CAST(impact AS VARCHAR) AS impact, dt, city, state, country, CAST(event_occured AS VARCHAR) AS event_occured, labeller FROM labels) ON event, impact, dt, city, state, country, event_occured, labeller INTO NAME \"column\" VALUE value) GROUP BY ALL",
)
def dist_long(spark: SparkSession, folder: str) -> DataFrame:
    return distributions(read_table(spark, folder, "labels"), ["event", "impact", "dt", "city", "state", "country", "event_occured", "labeller"])


@query(
    "url_keep_first",
    "SELECT url, date, country, query, title, domain FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY date NULLS FIRST, country NULLS FIRST, query NULLS FIRST, title NULLS FIRST, domain NULLS FIRST) AS rn FROM links WHERE url IS NOT NULL) WHERE rn = 1",
)
def url_keep_first(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.keep_first(read_table(spark, folder, "links"), "url", ["date", "country", "query", "title", "domain"]).select("url", "date", "country", "query", "title", "domain")


@query(
    "month_task_grid",
    """
    WITH span AS (SELECT min(strptime(date, '%Y%m%dT%H%M%SZ'))::DATE AS lo, max(strptime(date, '%Y%m%dT%H%M%SZ'))::DATE AS hi FROM links),
         months AS (SELECT unnest(generate_series(date_trunc('month', lo)::TIMESTAMP, date_trunc('month', hi)::TIMESTAMP, INTERVAL 1 MONTH))::DATE AS month_start, hi FROM span)
    SELECT c.country, q.query, m.month_start, least(last_day(m.month_start), m.hi) AS month_end
    FROM months m, (SELECT DISTINCT country FROM links WHERE country IS NOT NULL) c, (SELECT DISTINCT query FROM links WHERE query IS NOT NULL) q
    WHERE NOT EXISTS (SELECT 1 FROM links k WHERE k.country = c.country AND k.query = q.query AND date_trunc('month', strptime(k.date, '%Y%m%dT%H%M%SZ'))::DATE = m.month_start)
    """,
)
def month_task_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Fetch tasks of country, search term and month that no link has come from yet.

    Each country meets the one row that holds the months and the search terms, so the grid is made where the countries lie.
    """
    links = read_table(spark, folder, "links", "country", "query", "date").select("country", "query", F.to_date(F.try_to_timestamp("date", F.lit("yyyyMMdd'T'HHmmss'Z'"))).alias("day"))
    span = links.agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.collect_set("query").alias("terms"))
    span = span.select("terms", ingest.month_tasks(F.col("lo"), F.col("hi"), F.col("hi")).alias("months"))
    grid = spread(links.select("country").where(F.col("country").isNotNull()).distinct(), "country").crossJoin(F.broadcast(span))
    grid = grid.select("country", "terms", F.explode("months").alias("m")).select("country", "m.*", F.explode("terms").alias("query"))
    done = links.select("country", "query", F.to_date(F.trunc("day", "month")).alias("month_start")).distinct()
    return grid.join(done, ["country", "query", "month_start"], "left_anti").select("country", "query", "month_start", "month_end")


_STRATA_SQL = """
    WITH us AS (SELECT * FROM links WHERE country = 'US'),
         s AS (SELECT query, substr(date, 1, 6) AS month, count(*) AS stratum_size,
                      count(*) * CASE query WHEN 'pandemic' THEN 0.5::DOUBLE WHEN 'stock market crash' THEN 5.0::DOUBLE ELSE 1.0::DOUBLE END AS weighted FROM us GROUP BY query, substr(date, 1, 6)),
         z AS (SELECT *, CAST(round_even(weighted / (SELECT sum(weighted) FROM s) * 500, 0) AS BIGINT) AS sample_size FROM s)
"""


def _strata(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    links = read_table(spark, folder, "links").where(F.col("country") == "US").withColumn("month", F.substring("date", 1, 6))
    weight = F.lit(1.0)
    for term, value in TERM_WEIGHTS.items():
        weight = F.when(F.col("query") == term, value).otherwise(weight)
    return links, ingest.strata_sample_sizes(links, ["query", "month"], weight, 500)


@query("strata_sizes", _STRATA_SQL + " SELECT query, month, stratum_size, sample_size FROM z")
def strata_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return _strata(spark, folder)[1]


@query(
    "stratified_sample",
    _STRATA_SQL
    + """ SELECT url, query, month FROM (SELECT k.url, k.query, substr(k.date, 1, 6) AS month, z.sample_size, row_number() OVER (PARTITION BY k.query, substr(k.date, 1, 6) ORDER BY md5(k.url || k.date || '42'), k.url || k.date) AS rn
          FROM (SELECT DISTINCT url, query, date FROM us WHERE url IS NOT NULL) k JOIN z ON k.query IS NOT DISTINCT FROM z.query AND substr(k.date, 1, 6) IS NOT DISTINCT FROM z.month) WHERE rn <= sample_size""",
)
def stratified_sample(spark: SparkSession, folder: str) -> DataFrame:
    links, sizes = _strata(spark, folder)
    rows = links.where(F.col("url").isNotNull()).select("url", "query", "date", "month").distinct()
    return ingest.stratified_sample(rows, ["query", "month"], sizes.select("query", "month", "sample_size"), F.concat("url", "date"), 42).select("url", "query", "month")


@query("blob_offsets", "WITH a AS (SELECT DISTINCT index_id, octet_length(encode(coalesce(content, ''))) AS n FROM articles) SELECT index_id, n, coalesce(sum(n) OVER (ORDER BY index_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\" FROM a")
def blob_offsets(spark: SparkSession, folder: str) -> DataFrame:
    sizes = read_table(spark, folder, "articles", "index_id", "content").select("index_id", F.octet_length(F.coalesce("content", F.lit(""))).alias("n")).distinct()
    return ingest.running_offsets(sizes, "index_id", F.col("n"), "offset").select("index_id", "n", "offset")


@query(
    "batch_completeness",
    "SELECT CAST(floor((a.index_id - 1) / 10) AS BIGINT) AS batch, count(*) AS items, count(l.index_id) AS done, count(*) = count(l.index_id) AS complete FROM (SELECT DISTINCT index_id FROM articles) a LEFT JOIN (SELECT DISTINCT index_id FROM labels WHERE event_occured = 1) l USING (index_id) GROUP BY ALL",
)
def batch_completeness(spark: SparkSession, folder: str) -> DataFrame:
    done = read_table(spark, folder, "labels", "index_id", "event_occured").where("event_occured = 1").select("index_id")
    return ingest.batch_completeness(read_table(spark, folder, "articles", "index_id"), "index_id", done, 10)


_RUNS_SQL = """
    WITH e AS (SELECT *, CAST(ts AS DATE) AS day FROM events),
         d AS (SELECT DISTINCT user_id, event_type, day FROM e),
         s AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER w, day) > 3 THEN 1 ELSE 0 END AS starts FROM d WINDOW w AS (PARTITION BY user_id, event_type ORDER BY day)),
         c AS (SELECT user_id, event_type, day, CAST(sum(starts) OVER (PARTITION BY user_id, event_type ORDER BY day ROWS UNBOUNDED PRECEDING) AS BIGINT) AS time_cluster FROM s)
"""


def _runs(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "events").withColumn("day", F.to_date("ts"))
    return ev.temporal_clusters(events, ["user_id", "event_type"], "day", 3)


@query("temporal_clusters", _RUNS_SQL + " SELECT e.event_id, c.time_cluster FROM e JOIN c USING (user_id, event_type, day)")
def temporal_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return _runs(spark, folder).select("event_id", F.col("time_cluster").cast("bigint"))


@query(
    "unique_events_temporal",
    _RUNS_SQL + " SELECT user_id, event_type, time_cluster, min(day) AS dt, count(*) AS n_reports, round(stddev_pop(value), 6) AS value_std, date_diff('day', min(day), max(day)) AS span_days, max(value) AS most FROM e JOIN c USING (user_id, event_type, day) GROUP BY ALL",
)
def unique_events_temporal(spark: SparkSession, folder: str) -> DataFrame:
    grouped = _runs(spark, folder).groupBy("user_id", "event_type", F.col("time_cluster").cast("bigint").alias("time_cluster"))
    return grouped.agg(F.min("day").alias("dt"), F.count(F.lit(1)).alias("n_reports"), F.round(F.stddev_pop("value"), 6).alias("value_std"), F.datediff(F.max("day"), F.min("day")).cast("bigint").alias("span_days"), F.max("value").alias("most"))




def _km_sql(a: str, b: str) -> str:
    return f"2 * 6371.0 * asin(sqrt(least(1.0, power(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat)) * power(sin(radians({b}.lon - {a}.lon) / 2), 2))))"


def _cluster_sql(where: str) -> str:
    """Clusters of the labels' points: every point takes the least point that a chain of steps of 100 km leads to."""
    return f"""
    WITH RECURSIVE pts AS (SELECT DISTINCT latitude AS lat, longitude AS lon FROM labels WHERE latitude BETWEEN -90 AND 90 AND longitude BETWEEN -180 AND 180 {where}),
         near AS (SELECT a.lat AS lat, a.lon AS lon, b.lat AS to_lat, b.lon AS to_lon FROM pts a JOIN pts b ON {_km_sql("a", "b")} <= 100.0),
         reached AS (SELECT lat, lon, lat AS to_lat, lon AS to_lon FROM pts UNION SELECT r.lat, r.lon, n.to_lat, n.to_lon FROM reached r JOIN near n ON r.to_lat = n.lat AND r.to_lon = n.lon),
         clustered AS (SELECT lat, lon, min(ROW(to_lat, to_lon)) AS least FROM reached GROUP BY lat, lon)
    """


@query("spatial_clusters", _cluster_sql("") + " SELECT lat, lon, struct_extract(least, 1) AS cluster_lat, struct_extract(least, 2) AS cluster_lon FROM clustered")
def spatial_clusters(spark: SparkSession, folder: str) -> DataFrame:
    clusters = ev.spatial_clusters(read_table(spark, folder, "labels", "latitude", "longitude"), "latitude", "longitude", 100.0)
    return clusters.select("lat", "lon", *[F.split("loc_cluster", ",")[i].cast("double").alias(f"cluster_{c}") for i, c in enumerate(("lat", "lon"))])


def _dated_labels(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "labels").where("event_occured = 1").withColumn("day", strict_date(F.col("dt")))


@query(
    "unique_events_facts",
    _cluster_sql(f"AND event_occured = 1 AND ({_DAY}) IS NOT NULL")
    + f""", r AS (SELECT l.event, {_DAY} AS day, l.impact, l.latitude, l.longitude, c.least FROM labels l JOIN clustered c ON l.latitude = c.lat AND l.longitude = c.lon WHERE l.event_occured = 1 AND ({_DAY}) IS NOT NULL),
          g AS (SELECT DISTINCT event, least, day FROM r WHERE event IS NOT NULL),
          o AS (SELECT *, CASE WHEN date_diff('day', lag(day) OVER w, day) > 3 THEN 1 ELSE 0 END AS starts FROM g WINDOW w AS (PARTITION BY event, least ORDER BY day)),
          t AS (SELECT event, least, day, sum(starts) OVER (PARTITION BY event, least ORDER BY day ROWS UNBOUNDED PRECEDING) AS run FROM o)
          SELECT r.event, min(r.day) AS dt, max(r.impact) AS impact, count(*) AS n_reports, round(sum(r.latitude), 5) AS latitudes, round(sum(r.longitude), 5) AS longitudes, date_diff('day', min(r.day), max(r.day))::INT AS span_days
          FROM r LEFT JOIN t ON r.event = t.event AND r.least = t.least AND r.day = t.day GROUP BY r.event, r.least, coalesce(t.run, -1)""",
)
def unique_events_facts(spark: SparkSession, folder: str) -> DataFrame:
    """The unique events without their score: what the reports of each agree on."""
    events = ev.unique_events(_dated_labels(spark, folder), scored=False)
    # Sums of coordinates rather than means: their last digit does not hang on the order of adding.
    return events.select("event", "dt", "impact", "n_reports", *[F.round(F.col(c) * F.col("n_reports"), 5).alias(f"{c}s") for c in ("latitude", "longitude")], "span_days")


@query("unique_events_scored")
def unique_events_scored(spark: SparkSession, folder: str) -> DataFrame:
    return ev.unique_events(_dated_labels(spark, folder))


@query("confident_events")
def confident_events(spark: SparkSession, folder: str) -> DataFrame:
    return unique_events_scored(spark, folder).where(F.col("confidence") >= 0.5)


_STEPS_SQL = f"""
    WITH days AS (SELECT ticker, date, max(close) AS close FROM prices WHERE ticker IS NOT NULL AND date IS NOT NULL GROUP BY ALL),
         steps AS (SELECT *, lead(close, 1) OVER w AS c1, lead(close, 3) OVER w AS c3, lead(close, 7) OVER w AS c7 FROM days WINDOW w AS (PARTITION BY ticker ORDER BY date)),
         asked AS (SELECT DISTINCT {_DAY} AS day FROM labels WHERE event_occured = 1),
         pairs AS (SELECT a.day, t.ticker FROM asked a, (SELECT DISTINCT ticker FROM days) t WHERE a.day IS NOT NULL),
         m AS (SELECT p.day, p.ticker, s.date, s.close, s.c1, s.c3, s.c7 FROM pairs p ASOF JOIN steps s ON p.ticker = s.ticker AND p.day <= s.date)
"""


def _matched(spark: SparkSession, folder: str) -> DataFrame:
    days = _dated_labels(spark, folder).select("day")
    return stocks.forward_asof(days, "day", stocks.price_steps(read_table(spark, folder, "prices")))


@query("asof_forward_base", _STEPS_SQL + " SELECT day, ticker, date, close FROM m")
def asof_forward_base(spark: SparkSession, folder: str) -> DataFrame:
    return _matched(spark, folder).select("day", "ticker", "date", "close")


@query("returns_1_3_7", _STEPS_SQL + " SELECT day, ticker, round((c1 - close) / nullif(close, 0), 9) AS return_1d, round((c3 - close) / nullif(close, 0), 9) AS return_3d, round((c7 - close) / nullif(close, 0), 9) AS return_7d FROM m")
def returns_1_3_7(spark: SparkSession, folder: str) -> DataFrame:
    return stocks.with_returns(_matched(spark, folder)).select("day", "ticker", *[F.round(f"return_{k}d", 9).alias(f"return_{k}d") for k in (1, 3, 7)])


@query(
    "event_return_corr",
    _STEPS_SQL
    + f""", r AS (SELECT m.day, (c1 - close) / nullif(close, 0) AS r1, (c3 - close) / nullif(close, 0) AS r3, (c7 - close) / nullif(close, 0) AS r7 FROM m),
          f AS (SELECT l.event, r.* FROM (SELECT event, {_DAY} AS day FROM labels WHERE event_occured = 1) l JOIN r USING (day) WHERE r1 IS NOT NULL AND r3 IS NOT NULL AND r7 IS NOT NULL),
          t AS (SELECT DISTINCT event AS name FROM f WHERE event IS NOT NULL),
          g AS (SELECT t.name, (f.event IS NOT DISTINCT FROM t.name)::INT::DOUBLE AS x, f.r1, f.r3, f.r7 FROM t, f)
          SELECT name AS event, round(CASE WHEN stddev_pop(x) > 0 THEN corr(x, r1) END, 6) AS corr_1d, round(CASE WHEN stddev_pop(x) > 0 THEN corr(x, r3) END, 6) AS corr_3d, round(CASE WHEN stddev_pop(x) > 0 THEN corr(x, r7) END, 6) AS corr_7d FROM g GROUP BY name""",
)
def event_return_corr(spark: SparkSession, folder: str) -> DataFrame:
    table = stocks.event_return_correlation(_dated_labels(spark, folder), "event", "day", read_table(spark, folder, "prices"))
    return table.select("event", *[F.round(f"corr_{k}d", 6).alias(f"corr_{k}d") for k in (1, 3, 7)])


@query("event_return_heatmap", f"SELECT * FROM ({ORACLES['event_return_corr']}) WHERE corr_1d IS NOT NULL AND corr_3d IS NOT NULL AND corr_7d IS NOT NULL")
def event_return_heatmap(spark: SparkSession, folder: str) -> DataFrame:
    """The correlations that a heat map can show: event types with a value in every column."""
    return event_return_corr(spark, folder).dropna()


@query("date_counts", "SELECT CAST(fetched_at AT TIME ZONE 'UTC' AS DATE) AS day, count(*) AS n FROM articles WHERE fetched_at IS NOT NULL GROUP BY 1 ORDER BY 1")
def date_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Articles per day they were fetched on, in order of the days."""
    days = read_table(spark, folder, "articles", "fetched_at").where("fetched_at IS NOT NULL").groupBy(F.to_date("fetched_at").alias("day"))
    return days.agg(F.count(F.lit(1)).alias("n")).orderBy("day")


@query("headline_case", "WITH t AS (SELECT DISTINCT index_id, list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> '') AS w FROM articles) SELECT index_id, coalesce(len(list_filter(w, lambda x: regexp_matches(x, '^\\p{Lu}'))) / nullif(len(w), 0) > 0.8, false) AS capitalised FROM t")
def headline_case(spark: SparkSession, folder: str) -> DataFrame:
    """Whether over four fifths of a headline's words are capitalised, so that capitals say nothing of names."""
    return read_table(spark, folder, "articles", "index_id", "title").distinct().select("index_id", mostly_capitalised(F.col("title")).alias("capitalised"))


@query("topic_words")
def topic_words(spark: SparkSession, folder: str) -> DataFrame:
    """The five likeliest words of each topic with their weights."""
    titles = read_table(spark, folder, "articles", "index_id", "title").where("title IS NOT NULL").dropDuplicates(["index_id"])
    model, vectors, _ = models.fitted_topics(titles, "index_id", tx.topic_tokens(F.col("title")))
    return models.topic_words(model, vectors, 5)


def _whole_text():
    return F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("content", F.lit("")))


@query("text_clean", "SELECT DISTINCT index_id, trim(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(lower(coalesce(title, '') || ' ' || coalesce(content, '')), '’', ''''), 'won''t', 'will not'), 'can''t', 'can not'), 'n''t', ' not'), '''re', ' are'), '''ve', ' have'), '''ll', ' will'), '''m', ' am'), 'it''s', 'it is'), 'that''s', 'that is'), '[\\p{P}+]', '', 'g'), '\\s+', ' ', 'g')) AS cleaned FROM articles")
def text_clean(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "articles", "index_id", "title", "content").select("index_id", tx.clean_text(_whole_text()).alias("cleaned")).distinct()


_WORDS_SQL = "WITH w AS (SELECT index_id, unnest(list_filter(string_split(regexp_replace(lower(title), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: x <> '')) AS token FROM (SELECT DISTINCT index_id, title FROM articles)), b AS (SELECT index_id, token, count(*) AS n FROM w GROUP BY ALL)"


def _title_bag(spark: SparkSession, folder: str) -> DataFrame:
    titles = read_table(spark, folder, "articles", "index_id", "title").distinct()
    return models.bag_of_words(titles, "index_id", tx.words(F.col("title")))


@query("token_df_filter", _WORDS_SQL + " SELECT token, count(*) AS docs FROM b GROUP BY token HAVING count(*) >= 5 AND count(*) <= 0.8 * (SELECT count(DISTINCT index_id) FROM b)")
def token_df_filter(spark: SparkSession, folder: str) -> DataFrame:
    return models.frequent_tokens(_title_bag(spark, folder), "index_id")


@query("tokens_topk", _WORDS_SQL + " SELECT token, sum(n)::BIGINT AS n FROM b GROUP BY token ORDER BY n DESC, token LIMIT 100")
def tokens_topk(spark: SparkSession, folder: str) -> DataFrame:
    return _title_bag(spark, folder).groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(100)


def _sql_list(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_TOPIC_SQL = f"""
    WITH a AS (SELECT DISTINCT index_id, title, list_filter(string_split(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x <> '') AS words FROM articles),
         k AS (SELECT index_id, title, list_filter(list_transform(list_filter(words, lambda w: w NOT IN ({_sql_list((*tx.STOP_WORDS, *tx.NEWS_WORDS))}) AND length(w) > 2), lambda w: regexp_replace(w, '[0-9]+', '', 'g')), lambda w: length(w) > 2) AS kept FROM a)
    SELECT index_id, array_to_string(list_transform(kept, lambda w: CASE WHEN regexp_matches(w, '..ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(?:ss|ch|sh|x)es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[^su]s$') AND length(w) > 3 THEN regexp_replace(w, 's$', '') ELSE w END), ' ') AS tokens,
           len(regexp_extract_all(title, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]'))::INT AS estimate FROM k
"""


@query("topic_tokens", _TOPIC_SQL)
def topic_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "articles", "index_id", "title").distinct().select("index_id", F.array_join(tx.topic_tokens(F.col("title")), " ").alias("tokens"), tx.token_estimate(F.col("title")).alias("estimate"))


_CONTENT_SQL = "WITH w AS (SELECT index_id, unnest(list_filter(string_split(regexp_replace(lower(content), '[^\\p{L}\\p{N}_]+', ' ', 'g'), ' '), lambda x: length(x) >= 2)) AS token FROM (SELECT DISTINCT index_id, content FROM articles)), b AS (SELECT index_id, token, count(*) AS n FROM w GROUP BY ALL)"


def _content_bag(spark: SparkSession, folder: str) -> DataFrame:
    """The words of two letters and more of every article's whole content."""
    contents = read_table(spark, folder, "articles", "index_id", "content").distinct()
    return models.bag_of_words(contents, "index_id", F.filter(tx.words(F.col("content")), lambda w: F.length(w) >= 2))


@query(
    "tfidf_sklearn",
    _CONTENT_SQL + ", d AS (SELECT token, count(*) AS df FROM b GROUP BY token), r AS (SELECT index_id, token, n * (ln((1 + (SELECT count(DISTINCT index_id) FROM articles)) / (1 + df)) + 1) AS raw FROM b JOIN d USING (token)) SELECT index_id, token, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY index_id)), 6) AS weight FROM r",
)
def tfidf_sklearn(spark: SparkSession, folder: str) -> DataFrame:
    documents = read_table(spark, folder, "articles", "index_id").distinct().count()
    return models.tfidf(_content_bag(spark, folder), "index_id", documents).select("index_id", "token", F.round("weight", 6).alias("weight"))


@query(
    "nb_multinomial",
    _CONTENT_SQL + ", q AS (SELECT DISTINCT index_id, query FROM articles WHERE query IS NOT NULL), c AS (SELECT query, token, sum(n) AS n FROM b JOIN q USING (index_id) GROUP BY ALL) SELECT query, token, round(ln((n + 1) / (sum(n) OVER (PARTITION BY query) + (SELECT count(DISTINCT token) FROM c))), 6) AS log_probability FROM c",
)
def nb_multinomial(spark: SparkSession, folder: str) -> DataFrame:
    classes = read_table(spark, folder, "articles", "index_id", "query").where("query IS NOT NULL").distinct()
    return models.naive_bayes_terms(_content_bag(spark, folder), "index_id", classes, "query").select("query", "token", F.round("log_probability", 6).alias("log_probability"))


#: Tokens of the impact models.
IMPACT_TOKENS = 10_000


_IMPACT_SQL = f"""
    {_CONTENT_SQL},
    r AS (SELECT DISTINCT label_id, index_id, impact FROM labels WHERE impact BETWEEN 0 AND 5 AND index_id IN (SELECT index_id FROM articles WHERE content IS NOT NULL)),
    s AS (SELECT *, row_number() OVER (PARTITION BY impact ORDER BY md5(CAST(label_id AS VARCHAR) || '100'), CAST(label_id AS VARCHAR)) <= ceil(count(*) OVER (PARTITION BY impact) * 0.3) AS is_test FROM r),
    t AS (SELECT index_id, count(*) AS times FROM s WHERE NOT is_test GROUP BY 1),
    v AS (SELECT token, sum(n * times) AS total, sum(times) AS df FROM b JOIN t USING (index_id) GROUP BY token ORDER BY total DESC, token LIMIT {IMPACT_TOKENS}),
    f0 AS (SELECT index_id, token, n * (ln((1 + (SELECT sum(times) FROM t)) / (1 + df)) + 1) AS raw FROM b JOIN v USING (token)),
    f1 AS (SELECT index_id, token, raw / sqrt(sum(raw * raw) OVER (PARTITION BY index_id)) AS weight FROM f0),
    h AS (SELECT DISTINCT index_id, length(content) AS content_length, len(list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x IN ({", ".join(f"'{w}'" for w in sentiment.POSITIVE)}))) AS pos_wrds,
          len(list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda x: x IN ({", ".join(f"'{w}'" for w in sentiment.NEGATIVE)}))) AS neg_wrds FROM articles WHERE content IS NOT NULL)
"""


def _impact_rows(spark: SparkSession, folder: str) -> DataFrame:
    """label_id, index_id, impact and is_test of the labels with an impact of 0 to 5 on an article with content."""
    labels = read_table(spark, folder, "labels", "label_id", "index_id", "impact").where(F.col("impact").between(0, 5)).distinct()
    held = read_table(spark, folder, "articles", "index_id", "content").where(F.col("content").isNotNull()).select("index_id").distinct()
    return cut_lineage(ingest.seeded_split(labels.join(held, "index_id", "left_semi"), ["impact"], F.col("label_id").cast("string"), 100, 0.3))


def _content_numbers(spark: SparkSession, folder: str) -> DataFrame:
    content = F.col("content")
    rows = read_table(spark, folder, "articles", "index_id", "content").where(content.isNotNull())
    return rows.select("index_id", F.length(content).alias("content_length"), sentiment.count_of(content, sentiment.POSITIVE).alias("pos_wrds"), sentiment.count_of(content, sentiment.NEGATIVE).alias("neg_wrds")).distinct()


def _impact_weights(spark: SparkSession, folder: str, rows: DataFrame) -> DataFrame:
    """index_id, token, weight: TF-IDF of the content, fitted on the training rows."""
    bag = cut_lineage(_content_bag(spark, folder).join(rows.select("index_id").distinct(), "index_id", "left_semi"))
    vocabulary, _ = models.fitted_vocabulary(bag, "index_id", rows.where("NOT is_test"), IMPACT_TOKENS)
    return cut_lineage(models.transformed(bag, "index_id", F.broadcast(cut_lineage(vocabulary))))


@query(
    "impact_features",
    _IMPACT_SQL + "SELECT s.label_id, s.impact, s.is_test, h.content_length, h.pos_wrds, h.neg_wrds, count(f1.token) AS terms, round(coalesce(sum(f1.weight), 0), 6) AS weight FROM s JOIN h USING (index_id) LEFT JOIN f1 USING (index_id) GROUP BY ALL",
)
def impact_features(spark: SparkSession, folder: str) -> DataFrame:
    """What the impact models see of each label's article: the numbers and the extent of its TF-IDF weights."""
    rows = _impact_rows(spark, folder)
    extent = _impact_weights(spark, folder, rows).groupBy("index_id").agg(F.count(F.lit(1)).alias("terms"), F.sum("weight").alias("weight"))
    joined = rows.join(_content_numbers(spark, folder), "index_id").join(extent, "index_id", "left")
    return joined.select("label_id", "impact", "is_test", "content_length", "pos_wrds", "neg_wrds", F.coalesce("terms", F.lit(0)).alias("terms"), F.round(F.coalesce("weight", F.lit(0.0)), 6).alias("weight"))


_NB_SQL = (
    _IMPACT_SQL
    + """, f AS (SELECT index_id, token, weight FROM f1 UNION ALL SELECT index_id, '#content_length', content_length FROM h UNION ALL SELECT index_id, '#pos_wrds', pos_wrds FROM h UNION ALL SELECT index_id, '#neg_wrds', neg_wrds FROM h),
    c AS (SELECT index_id, impact, count(*) AS times FROM s WHERE NOT is_test GROUP BY ALL),
    k AS (SELECT impact, token, sum(weight * times) AS held FROM f JOIN c USING (index_id) GROUP BY ALL),
    p AS (SELECT impact, sum(times) AS times FROM c GROUP BY impact), z AS (SELECT impact, sum(held) AS total FROM k GROUP BY impact),
    g AS (SELECT p.impact, a.token, ln((coalesce(k.held, 0) + 1) / (z.total + (SELECT count(DISTINCT token) FROM k))) AS chance FROM p JOIN z USING (impact) CROSS JOIN (SELECT DISTINCT token FROM k) a LEFT JOIN k ON k.impact = p.impact AND k.token = a.token),
    o AS (SELECT f.index_id, g.impact, sum(f.weight * g.chance) AS score FROM f JOIN g USING (token) WHERE f.index_id IN (SELECT index_id FROM s WHERE is_test) GROUP BY ALL),
    y AS (SELECT o.index_id, o.impact, row_number() OVER (PARTITION BY o.index_id ORDER BY o.score + ln(p.times / (SELECT sum(times) FROM p)) DESC, o.impact) AS rn FROM o JOIN p USING (impact)),
    n AS (SELECT s.label_id, s.impact, y.impact AS prediction FROM s JOIN y USING (index_id) WHERE s.is_test AND y.rn = 1)"""
)


def _bayes(spark: SparkSession, folder: str) -> DataFrame:
    rows = _impact_rows(spark, folder)
    numbers = _content_numbers(spark, folder)
    cells = F.explode(F.array(*[F.struct(F.lit(f"#{c}").alias("token"), F.col(c).cast("double").alias("weight")) for c in ("content_length", "pos_wrds", "neg_wrds")])).alias("cell")
    features = _impact_weights(spark, folder, rows).unionByName(numbers.select("index_id", cells).select("index_id", "cell.*"))
    return models.bayes_predictions(features, "index_id", rows.where("NOT is_test"), rows.where("is_test"), "label_id", "impact")


@query("nb_predict", _NB_SQL + " SELECT label_id, impact, prediction FROM n")
def nb_predict(spark: SparkSession, folder: str) -> DataFrame:
    return _bayes(spark, folder)


_REPORT_SQL = """, q AS (SELECT impact AS class FROM n UNION SELECT prediction FROM n),
    e AS (SELECT class, (SELECT count(*) FROM n WHERE impact = class) AS support, (SELECT count(*) FROM n WHERE impact = class AND prediction = class) AS hit, (SELECT count(*) FROM n WHERE prediction = class) AS said FROM q),
    m AS (SELECT class, CASE WHEN said = 0 THEN 1.0 ELSE hit / said END AS pr, CASE WHEN support = 0 THEN 1.0 ELSE hit / support END AS rc, support, hit FROM e),
    u AS (SELECT *, CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END AS f1 FROM m)
"""


@query(
    "nb_report_averages",
    _NB_SQL
    + _REPORT_SQL
    + """ SELECT 'accuracy' AS average, round(sum(hit) / sum(support), 6) AS precision, round(sum(hit) / sum(support), 6) AS recall, round(sum(hit) / sum(support), 6) AS f1, sum(support)::BIGINT AS support FROM u
          UNION ALL SELECT 'macro', round(avg(pr), 6), round(avg(rc), 6), round(avg(f1), 6), sum(support)::BIGINT FROM u
          UNION ALL SELECT 'weighted', round(sum(pr * support) / sum(support), 6), round(sum(rc * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM u""",
)
def nb_report_averages(spark: SparkSession, folder: str) -> DataFrame:
    averages = models.report_averages(models.classification_report(_bayes(spark, folder), "impact", "prediction"))
    return averages.select("average", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


def _impact_vectors(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(label_id, text_id, impact, is_test) and (text_id, features): the labels and the feature vectors of the impact
    models, fitted on the training labels.

    A text is read, counted and kept once, however many labels and copies it has.
    """
    rows = _impact_rows(spark, folder)
    content = F.col("content")
    articles = read_table(spark, folder, "articles", "index_id", "content").where(content.isNotNull()).withColumn("text_id", F.md5("content"))
    # Texts are named before any join, so that none but those to be counted are shuffled, and they once.
    named = cut_lineage(articles.select("index_id", "text_id").distinct())
    rows = cut_lineage(rows.join(named, "index_id").select("label_id", "text_id", "impact", "is_test"))
    times = rows.groupBy("text_id").agg(F.count_if(~F.col("is_test")).alias("times"))
    chosen = cut_lineage(named.groupBy("text_id").agg(F.min("index_id").alias("index_id")).join(times, "text_id"))
    texts = articles.join(chosen, ["index_id", "text_id"]).dropDuplicates(["index_id", "text_id"])
    split = texts.select("text_id", "times", F.length(content).alias("content_length"), tx.words(content).alias("words"))
    moods = [F.size(F.filter("words", lambda w: w.isin(*sentiment.POSITIVE))).alias("pos_wrds"), F.size(F.filter("words", lambda w: w.isin(*sentiment.NEGATIVE))).alias("neg_wrds")]
    counted = written(split.select("text_id", "times", F.filter("words", lambda w: F.length(w) >= 2).alias("tokens"), "content_length", *moods))
    fitted = models.tfidf_pipeline(counted.where("times > 0"), "tokens", ["content_length", "pos_wrds", "neg_wrds"], IMPACT_TOKENS, times="times")
    return rows, written(fitted.transform(counted).select("text_id", "features"))


@query("rf_impact_articles")
def rf_impact_articles(spark: SparkSession, folder: str) -> DataFrame:
    return sparse_forest(*_impact_vectors(spark, folder), "label_id", "text_id", "impact")


@query("lr_balanced_articles")
def lr_balanced_articles(spark: SparkSession, folder: str) -> DataFrame:
    return models.balanced_logistic_on_documents(*_impact_vectors(spark, folder), "label_id", "text_id", "impact")


def _event_texts(spark: SparkSession, folder: str) -> DataFrame:
    """label_id, tokens of title and content, label and is_test of each label on an article."""
    articles = read_table(spark, folder, "articles", "index_id", "title", "content").distinct().select("index_id", tx.words(tx.clean_text(_whole_text())).alias("tokens"))
    labels = read_table(spark, folder, "labels", "label_id", "index_id", "event_occured").where(F.col("event_occured").isNotNull()).distinct()
    rows = labels.join(articles, "index_id").select("label_id", "tokens", F.col("event_occured").cast("double").alias("label"))
    return cut_lineage(ingest.seeded_split(rows, ["label"], F.col("label_id").cast("string"), 103, 0.2))


@query("classifier_folds")
def classifier_folds(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy and log loss of the event classifier per fold of the training rows, for both parts, with their means."""
    train = _event_texts(spark, folder).where("NOT is_test")
    vectors = models.EventClassifier().features(train).transform(train).select("label_id", "features", "label")
    return models.fold_figures(vectors, "label_id")


@query("classifier_test")
def classifier_test(spark: SparkSession, folder: str) -> DataFrame:
    """Accuracy and log loss of the event classifier, fitted on all training rows, saved and loaded, on the test rows."""
    rows = _event_texts(spark, folder)
    path = f"{shared_folder(spark)}/classifier-{uuid.uuid4().hex}"
    models.EventClassifier().fit(rows.where("NOT is_test")).save(path)
    return models.EventClassifier.load(path).figures(rows.where("is_test"))


@query(
    "substring_label_match",
    """
    WITH p AS (SELECT DISTINCT l.label_id, a.query, l.event FROM labels l JOIN articles a USING (index_id) WHERE l.event_occured = 1),
         m AS (SELECT *, coalesce(len(list_filter(list_filter(regexp_split_to_array(replace(lower(query), '+', ' '), '\\s+'), lambda x: x <> ''),
               lambda x: len(list_filter(list_filter(regexp_split_to_array(replace(lower(event), '+', ' '), '\\s+'), lambda y: y <> ''), lambda y: contains(y, x) OR contains(x, y))) > 0)) >= 1, false) AS hit FROM p)
    SELECT query, count(*) AS labels, sum(hit::INT)::BIGINT AS matching, round(avg(hit::INT), 6) AS accuracy FROM m GROUP BY query
    """,
)
def substring_label_match(spark: SparkSession, folder: str) -> DataFrame:
    labels = read_table(spark, folder, "labels", "label_id", "index_id", "event", "event_occured").where("event_occured = 1")
    pairs = labels.join(read_table(spark, folder, "articles", "index_id", "query"), "index_id").select("label_id", "query", "event").distinct()
    hit = tx.shares_partial_word(F.col("query"), F.col("event")).cast("int")
    return pairs.groupBy("query").agg(F.count(F.lit(1)).alias("labels"), F.sum(hit).alias("matching"), F.round(F.avg(hit), 6).alias("accuracy"))


_SOFT_SQL = "CASE WHEN a IS NOT DISTINCT FROM b THEN 1 WHEN coalesce(a, '') = '' OR coalesce(b, '') = '' THEN 0 WHEN contains(lower(a), lower(b)) OR contains(lower(b), lower(a)) THEN 1 ELSE 0 END"


@query("soft_compare_acc", f"SELECT labeller, count(*) AS rows_all, sum({_SOFT_SQL})::BIGINT AS matching, round(avg({_SOFT_SQL}), 6) AS accuracy FROM (SELECT labeller, loc AS a, city AS b FROM labels) GROUP BY labeller")
def soft_compare_acc(spark: SparkSession, folder: str) -> DataFrame:
    hit = tx.soft_equal(F.col("loc"), F.col("city"))
    return read_table(spark, folder, "labels", "labeller", "loc", "city").groupBy("labeller").agg(F.count(F.lit(1)).alias("rows_all"), F.sum(hit).alias("matching"), F.round(F.avg(hit), 6).alias("accuracy"))


def _plain_sql(text: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(translate(lower({text}), '{ACCENTED}', '{PLAIN}'), '[''’]s\\b', '', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


_GAZETTEER_SQL = f"""
    WITH raw AS (SELECT unnest([country, official_name]) AS raw, 0 AS rank, 0::BIGINT AS smaller, country, 'country' AS kind FROM countries
                 UNION ALL SELECT state, 1, -coalesce(population, 0), country, 'state' FROM places UNION ALL SELECT unnest([city, alt_name]), 2, -coalesce(population, 0), country, 'city' FROM places),
         named AS (SELECT {_plain_sql("regexp_replace(raw, '(?i)^the ', '')")} AS name, rank, smaller, country, kind FROM raw WHERE raw IS NOT NULL),
         names AS (SELECT name, kind, country FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY rank, smaller, country NULLS FIRST, kind) AS rn FROM named WHERE name <> '') WHERE rn = 1),
         texts AS (SELECT DISTINCT index_id, 'title' AS part, string_split({_plain_sql("title")}, ' ') AS t FROM articles WHERE title IS NOT NULL UNION ALL SELECT DISTINCT index_id, 'content', string_split({_plain_sql("content")}, ' ') FROM articles WHERE content IS NOT NULL),
         runs AS (SELECT index_id, part, unnest(list_concat(t, list_concat(list_transform(generate_series(1, len(t) - 1), lambda i: array_to_string(t[i:i + 1], ' ')), list_transform(generate_series(1, len(t) - 2), lambda i: array_to_string(t[i:i + 2], ' '))))) AS name FROM texts),
         found AS (SELECT DISTINCT index_id, part, kind, name, country FROM runs JOIN names USING (name)),
         extracted AS (SELECT index_id, kind, name, country FROM found f WHERE part = 'title' OR NOT EXISTS (SELECT 1 FROM found g WHERE g.index_id = f.index_id AND g.part = 'title'))
"""


def _extracted_places(spark: SparkSession, folder: str) -> DataFrame:
    articles = read_table(spark, folder, "articles", "index_id", "title", "content").dropDuplicates(["index_id"])
    names = broadcast_if_small(cut_lineage(gazetteer(read_table(spark, folder, "places"), read_table(spark, folder, "countries"))), 200_000)
    titled = cut_lineage(places_in(articles, "index_id", "title", names))
    rest = articles.join(titled.select("index_id").distinct(), "index_id", "left_anti")
    return titled.unionByName(places_in(rest, "index_id", "content", names))


@query("gazetteer_extract", _GAZETTEER_SQL + " SELECT index_id, kind, name, country FROM extracted")
def gazetteer_extract(spark: SparkSession, folder: str) -> DataFrame:
    """Places of each article's title; of its content only where the title names none."""
    return _extracted_places(spark, folder).select("index_id", "kind", "name", "country").distinct()


@query(
    "location_accuracy",
    _GAZETTEER_SQL
    + f""", l AS (SELECT DISTINCT label_id, index_id, {_plain_sql("city")} AS city, {_plain_sql("country")} AS country FROM labels WHERE event_occured = 1),
         cells AS (SELECT label_id, index_id, 'city' AS field, city AS typed FROM l UNION ALL SELECT label_id, index_id, 'country', country FROM l),
         said AS (SELECT index_id, kind AS field, name FROM extracted WHERE kind IN ('city', 'country') UNION SELECT index_id, 'country', {_plain_sql("country")} FROM extracted)
         SELECT field, count(*) AS labels, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM said WHERE said.index_id = cells.index_id AND said.field = cells.field AND said.name = cells.typed)) AS matching FROM cells WHERE typed <> '' AND index_id IN (SELECT index_id FROM articles) GROUP BY field""",
)
def location_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Of the labels with a city or country on a stored article, how many name one that was found in its text."""
    places = _extracted_places(spark, folder)
    said = places.where(F.col("kind").isin("city", "country")).select("index_id", F.col("kind").alias("field"), "name").unionByName(places.select("index_id", F.lit("country").alias("field"), plain_name(F.col("country")).alias("name"))).distinct().withColumn("found", F.lit(1))
    labels = read_table(spark, folder, "labels", "label_id", "index_id", "city", "country", "event_occured").where("event_occured = 1").join(read_table(spark, folder, "articles", "index_id").distinct(), "index_id", "left_semi")
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("field"), plain_name(F.col(c)).alias("name")) for c in ("city", "country")]))
    typed = labels.select("label_id", "index_id", "city", "country").distinct().select("index_id", cells).where("name <> ''")
    return typed.join(said, ["index_id", "field", "name"], "left").groupBy("field").agg(F.count(F.lit(1)).alias("labels"), F.count("found").alias("matching"))


_RESOLVE = "list_transform(regexp_extract_all(TEXT, '" + phrases.DATE_PHRASE + "'), lambda s: CASE WHEN lower(s) = 'today' THEN p WHEN lower(s) IN ('yesterday', 'last night') THEN p - 1 WHEN regexp_matches(s, '[0-9]') THEN try_cast(s AS DATE) ELSE p - ((isodow(p) - list_position([" + ", ".join(f"'{d}'" for d in phrases.WEEKDAYS) + "], lower(s)) + 7) % 7)::INT END)"
_DATE_SQL = f"""
    WITH a AS (SELECT DISTINCT index_id, title, content, CAST(fetched_at AT TIME ZONE 'UTC' AS DATE) AS p FROM articles),
         d AS (SELECT DISTINCT index_id, coalesce(list_filter({_RESOLVE.replace("TEXT", "content")}, lambda d: d <= p)[1], list_filter({_RESOLVE.replace("TEXT", "title")}, lambda d: d <= p)[1]) AS event_day FROM a)
"""


@query("date_resolve", _DATE_SQL + " SELECT index_id, event_day FROM d")
def date_resolve(spark: SparkSession, folder: str) -> DataFrame:
    """The day an article's event fell on, from its date phrases and the day it was fetched."""
    articles = read_table(spark, folder, "articles", "index_id", "title", "content", "fetched_at")
    return articles.select("index_id", phrases.event_day(F.col("content"), F.col("title"), F.to_date("fetched_at")).alias("event_day")).distinct()


@query(
    "date_accuracy",
    _DATE_SQL + f", l AS (SELECT DISTINCT label_id, index_id, labeller, {_DAY} AS day FROM labels WHERE event_occured = 1) SELECT l.labeller, count(*) AS labels, count(d.event_day) AS resolved, count(*) FILTER (WHERE d.event_day = l.day) AS matching, round(avg((d.event_day IS NOT DISTINCT FROM l.day)::INT), 6) AS accuracy FROM l JOIN d USING (index_id) WHERE l.day IS NOT NULL GROUP BY l.labeller",
)
def date_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    """Per labeller, how often the day found in an article is the day on its label."""
    labels = _dated_labels(spark, folder).where(F.col("day").isNotNull()).select("label_id", "index_id", "labeller", "day").distinct()
    hit = F.col("event_day").eqNullSafe(F.col("day")).cast("int")
    return labels.join(date_resolve(spark, folder), "index_id").groupBy("labeller").agg(F.count(F.lit(1)).alias("labels"), F.count("event_day").alias("resolved"), F.sum(hit).alias("matching"), F.round(F.avg(hit), 6).alias("accuracy"))


_LEXICON_SQL = "len(list_filter(regexp_split_to_array(regexp_replace(lower(content), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'), ' '), lambda w: w IN ({})))"
_POS, _NEG = (_LEXICON_SQL.format(", ".join(f"'{w}'" for w in words)) for words in (sentiment.POSITIVE, sentiment.NEGATIVE))


@query(
    "vader_buckets",
    f"WITH s AS (SELECT DISTINCT index_id, {_POS} AS pos_wrds, {_NEG} AS neg_wrds FROM articles WHERE content IS NOT NULL), c AS (SELECT *, (pos_wrds - neg_wrds) / sqrt((pos_wrds - neg_wrds) * (pos_wrds - neg_wrds) + 15) AS score FROM s) SELECT index_id, pos_wrds::INT AS pos_wrds, neg_wrds::INT AS neg_wrds, CASE WHEN score <= -0.7 THEN 5 WHEN score <= -0.4 THEN 4 WHEN score <= -0.2 THEN 3 WHEN score <= 0.3 THEN 2 ELSE 0 END::INT AS impact FROM c",
)
def vader_buckets(spark: SparkSession, folder: str) -> DataFrame:
    content = F.col("content")
    counted = read_table(spark, folder, "articles", "index_id", "content").where(content.isNotNull()).select("index_id", sentiment.count_of(content, sentiment.POSITIVE).alias("pos_wrds"), sentiment.count_of(content, sentiment.NEGATIVE).alias("neg_wrds"))
    return counted.distinct().withColumn("impact", sentiment.impact_class(sentiment.compound(F.col("pos_wrds"), F.col("neg_wrds"))))


def _label_answers(spark: SparkSession, folder: str) -> DataFrame:
    """batch, items, ids, response: labels written as JSON arrays of ten in a code fence, as a model would answer."""
    labels = read_table(spark, folder, "labels", "label_id", "event_occured", "event", "impact", "dt", "loc").distinct().withColumn("batch", F.floor((F.col("label_id") - 1) / 10))
    batches = labels.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("label_id", "event_occured", "event", "impact", "dt", "loc"))).alias("rows"))
    return batches.select("batch", F.size("rows").alias("items"), F.transform("rows", lambda r: r["label_id"]).alias("ids"), F.concat(F.lit("```json\n"), F.to_json(F.transform("rows", lambda r: r.dropFields("label_id"))), F.lit("\n```")).alias("response"))


@query("llm_json_parse", "SELECT CAST(floor((label_id - 1) / 10) AS BIGINT) AS batch, label_id, event_occured, event, impact, dt, loc FROM (SELECT DISTINCT label_id, event_occured, event, impact, dt, loc FROM labels)")
def llm_json_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Labels read back from the answers, by position."""
    answers = _label_answers(spark, folder)
    parsed = tx.parse_label_response(answers, "batch", "response", "items")
    return parsed.join(answers.select("batch", "ids"), "batch").select("batch", F.get("ids", F.col("position")).alias("label_id"), "event_occured", "event", "impact", "dt", "loc")


@query(
    "llm_json_failed",
    "SELECT batch, CASE batch % 5 WHEN 1 THEN 'malformed' WHEN 2 THEN 'wrong_length' ELSE 'missing' END AS failure FROM (SELECT DISTINCT CAST(floor((label_id - 1) / 10) AS BIGINT) AS batch FROM labels) WHERE batch % 5 IN (1, 2, 3)",
)
def llm_json_failed(spark: SparkSession, folder: str) -> DataFrame:
    """Every batch is answered, some cut off, one object too many, or not at all, some in a fence that names no language."""
    kind = F.col("batch") % 5
    broken = F.when(kind == 1, F.regexp_replace("response", r"\]\s*```$", "")).when(kind == 2, F.regexp_replace("response", r"\]\s*```$", ",{}]\n```")).when(kind == 4, F.regexp_replace("response", "json", "")).when(kind == 0, F.col("response"))
    return tx.failed_responses(_label_answers(spark, folder).withColumn("response", broken), "batch", "response", "items")


@query(
    "prompt_build",
    "SELECT CAST(floor((index_id - 1) / 10) AS BIGINT) AS batch, count(*) AS items, md5(string_agg('Title: ' || coalesce(title, '') || chr(10) || 'Publish Date: ' || coalesce(date, '') || chr(10) || 'Content: ' || coalesce(content, ''), chr(10) || chr(10) ORDER BY index_id)) AS prompt FROM (SELECT DISTINCT index_id, title, date, content FROM articles) GROUP BY 1",
)
def prompt_build(spark: SparkSession, folder: str) -> DataFrame:
    articles = read_table(spark, folder, "articles", "index_id", "title", "date", "content").distinct()
    block = F.struct("index_id", tx.prompt_block(F.col("title"), F.col("date"), F.col("content")).alias("block"))
    grouped = articles.groupBy(F.floor((F.col("index_id") - 1) / 10).alias("batch")).agg(F.array_sort(F.collect_list(block)).alias("blocks"))
    return grouped.select("batch", F.size("blocks").cast("bigint").alias("items"), F.md5(F.array_join(F.transform("blocks", lambda b: b["block"]), "\n\n")).alias("prompt"))


@query(
    "confusion_report",
    """
    WITH p AS (SELECT a.query AS l, lower(b.event) AS p FROM (SELECT DISTINCT index_id, query FROM articles WHERE query IS NOT NULL) a JOIN labels b USING (index_id) WHERE b.event_occured = 1),
         s AS (SELECT l AS class, count(*) AS support, sum((l = p)::INT) AS hit FROM p GROUP BY l), d AS (SELECT p AS class, count(*) AS said FROM p WHERE p IS NOT NULL GROUP BY p),
         j AS (SELECT coalesce(s.class, d.class) AS class, coalesce(support, 0) AS support, coalesce(hit, 0) AS hit, coalesce(said, 0) AS said FROM s FULL JOIN d ON s.class = d.class),
         r AS (SELECT *, CASE WHEN said = 0 THEN 1.0 ELSE hit / said END AS pr, CASE WHEN support = 0 THEN 1.0 ELSE hit / support END AS rc FROM j)
    SELECT class, round(pr, 6) AS precision, round(rc, 6) AS recall, round(CASE WHEN pr + rc = 0 THEN 0.0 ELSE 2 * pr * rc / (pr + rc) END, 6) AS f1, support::BIGINT AS support FROM r
    """,
)
def confusion_report(spark: SparkSession, folder: str) -> DataFrame:
    articles = read_table(spark, folder, "articles", "index_id", "query").where("query IS NOT NULL").distinct()
    pairs = articles.join(read_table(spark, folder, "labels", "index_id", "event", "event_occured").where("event_occured = 1"), "index_id").select("query", F.lower("event").alias("said_event"))
    return models.classification_report(pairs, "query", "said_event").select("class", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "label_split",
    "WITH l AS (SELECT DISTINCT label_id, impact FROM labels) SELECT label_id, impact, row_number() OVER (PARTITION BY impact ORDER BY md5(CAST(label_id AS VARCHAR) || '100'), label_id) <= ceil(count(*) OVER (PARTITION BY impact) * 0.3) AS is_test FROM l",
)
def label_split(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.seeded_split(read_table(spark, folder, "labels", "label_id", "impact").distinct(), ["impact"], F.col("label_id").cast("string"), 100, 0.3).select("label_id", "impact", "is_test")


@query("cv_logistic")
def cv_logistic(spark: SparkSession, folder: str) -> DataFrame:
    rows = read_table(spark, folder, "embeddings").withColumn("is_low", (F.col("label") < 5).cast("int"))
    return models.cross_validated_logistic(rows, "vec_id", "embedding", "is_low")


def _split_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.seeded_split(read_table(spark, folder, "embeddings"), ["label"], F.col("vec_id").cast("string"), 103, 0.2)


@query("rf_impact")
def rf_impact(spark: SparkSession, folder: str) -> DataFrame:
    return models.forest_predictions(_split_vectors(spark, folder), "vec_id", "embedding", "label", trees=200, depth=30)


@query("lr_balanced")
def lr_balanced(spark: SparkSession, folder: str) -> DataFrame:
    return models.balanced_logistic_predictions(_split_vectors(spark, folder), "vec_id", "embedding", "label")


@query("lda_topics")
def lda_topics(spark: SparkSession, folder: str) -> DataFrame:
    titles = read_table(spark, folder, "articles", "index_id", "title").where("title IS NOT NULL").dropDuplicates(["index_id"])
    return models.topics(titles, "index_id", tx.topic_tokens(F.col("title")))


@query(
    "stream_gap_sessions",
    """
    WITH s AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 3 DAYS THEN 1 ELSE 0 END AS starts FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts)),
         c AS (SELECT *, sum(starts) OVER (PARTITION BY user_id, event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM s)
    SELECT user_id, event_type, min(ts) AS started, count(*) AS n FROM c GROUP BY user_id, event_type, run HAVING max(ts) + INTERVAL 3 DAYS <= (SELECT max(ts) FROM events)
    """,
)
def stream_gap_sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Sessions of the event stream that the watermark has closed, drained into a table and read back."""
    path = f"{folder}/events.parquet"
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = file_stream(spark, folder, "events.parquet", spark.read.parquet(path).schema).withColumn("ts", F.col("ts").cast("timestamp"))
    drain(gap_sessions(stream, ["user_id", "event_type"], "ts", "3 days", "0 seconds"), f"{base}/out", f"{base}/state")
    return spark.read.parquet(f"{base}/out").select("user_id", "event_type", F.col("started").cast("timestamp_ntz").alias("started"), "n")
