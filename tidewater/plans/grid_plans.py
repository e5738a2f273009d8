"""The whole grid of windows, thresholds and combination rules over the series, with lead days and ceilings."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewater.operators import regime as R
from tidewater.plans.registry import query, view
from tidewater.sources.staging import cut, staged

LOOKBACKS, DELTAS, THRESHOLDS, MIN_OBS = (60, 125, 250), (10, 20, 40), (0.8, 0.9, 0.95), 30
GAP, MIN_LEAD, MAX_LEAD, BEFORE, AFTER, RATE_CEILING, FP_CEILING = 10, 5, 60, 60, 20, 0.2, 5
#: Events with their anchors, in the order in which they count.
EVENTS = (("a", ("1996-03-01", "1996-05-15")), ("b", ("1998-04-01",)), ("c", ("2000-02-15", "2000-06-01")))
#: The combined rules use one fixed setting a series, so that nothing is picked twice.
FIXED_LOOKBACK, FIXED_THRESHOLD, SPEED_SERIES, FIXED_DELTA = 250, 0.8, "2-HIGH", 20


def _scored(src, kind, delta, lb):
    return f"""SELECT series_id, '{kind}' AS kind, {delta} AS delta, {lb} AS lookback, date, len(list_filter(v, lambda x: x<=value))/len(v)::DOUBLE AS score FROM (
  SELECT *, list(value) OVER (PARTITION BY series_id ORDER BY date ROWS {lb - 1} PRECEDING) AS v, row_number() OVER (PARTITION BY series_id ORDER BY date) AS k FROM {src}) WHERE k>={MIN_OBS}"""


for _d in DELTAS:
    view(f"gd_{_d}", f"SELECT * FROM (SELECT series_id, date, value-lag(value,{_d}) OVER (PARTITION BY series_id ORDER BY date) AS value FROM series) WHERE value IS NOT NULL")
view("gd_scores", " UNION ALL ".join([*[_scored("series", "level_pct", 0, lb) for lb in LOOKBACKS], *[_scored(f"gd_{d}", "speed_pct", d, lb) for d in DELTAS for lb in LOOKBACKS]]))
view("gd_fixed", f"SELECT series_id, date, (score>={FIXED_THRESHOLD})::INT AS fired FROM gd_scores WHERE lookback={FIXED_LOOKBACK} AND CASE WHEN series_id='{SPEED_SERIES}' THEN kind='speed_pct' AND delta={FIXED_DELTA} ELSE kind='level_pct' END")
view("gd_all", f"""
SELECT series_id||'|'||kind||'|lb='||lookback||CASE WHEN delta>0 THEN '|delta='||delta ELSE '' END AS base, date, score, t.th AS threshold, '|th='||t.tag AS tag FROM gd_scores, (VALUES {','.join(f"({x}::DOUBLE,'{x}')" for x in THRESHOLDS)}) t(th, tag)
UNION ALL SELECT 'combo|'||a.series_id||'+'||b.series_id, a.date, (a.fired+b.fired)::DOUBLE, t.th, t.tag FROM gd_fixed a JOIN gd_fixed b ON a.date=b.date AND a.series_id<b.series_id, (VALUES (1::DOUBLE,'|union'),(2::DOUBLE,'|intersect')) t(th, tag)
UNION ALL SELECT 'combo|all', date, s, k::DOUBLE, '|ge'||k FROM (SELECT date, sum(fired)::DOUBLE AS s FROM gd_fixed GROUP BY 1 HAVING count(*)=(SELECT count(DISTINCT series_id) FROM gd_fixed)), (SELECT unnest(range(1, (SELECT count(DISTINCT series_id) FROM gd_fixed)+1)) AS k)
""")
view("gd_cal", "SELECT date, row_number() OVER (ORDER BY date)-1 AS i, count(*) OVER ()-1 AS top FROM (SELECT date FROM series WHERE series_id=(SELECT min(series_id) FROM series))")
view("gd_anchor", "SELECT e.event, e.place, greatest(coalesce((SELECT max(i) FROM gd_cal WHERE date<=e.d),0),0) AS b, least(coalesce((SELECT min(i) FROM gd_cal WHERE date>=e.d),(SELECT max(top) FROM gd_cal)),(SELECT max(top) FROM gd_cal)) AS f, (SELECT max(top) FROM gd_cal) AS top FROM (VALUES "
     + ",".join(f"('{n}',{i},DATE '{a}')" for n, anchors in EVENTS for i, a in enumerate(anchors)) + ") e(event, place, d)")
view("gd_win", f"""SELECT a.event, a.place, h0.date AS h0, h1.date AS h1, q0.date AS q0, q1.date AS q1 FROM gd_anchor a JOIN gd_cal h0 ON h0.i=greatest(a.b-{MAX_LEAD},0) JOIN gd_cal h1 ON h1.i=greatest(a.b-{MIN_LEAD},0)
JOIN gd_cal q0 ON q0.i=greatest(a.b-{BEFORE},0) JOIN gd_cal q1 ON q1.i=least(a.f+{AFTER},a.top)""")
view("gd_fire", "SELECT base, threshold, tag, date, score>=threshold AS fired, row_number() OVER (PARTITION BY base, threshold ORDER BY date) AS i FROM gd_all")
view("gd_start", f"SELECT base, threshold, tag, date FROM (SELECT *, i-lag(i) OVER (PARTITION BY base, threshold ORDER BY date) AS g FROM gd_fire WHERE fired) WHERE g IS NULL OR g>{GAP + 1}")
view("gd_hit", "SELECT base, threshold, event, arg_min(date, place*100000+(date-DATE '1970-01-01')) AS d FROM gd_start JOIN gd_win ON date BETWEEN h0 AND h1 GROUP BY 1,2,3")
view("gd_n", "SELECT base, threshold, count(*) AS n, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM gd_win w WHERE s.date BETWEEN w.q0 AND w.q1)) AS fp FROM gd_start s GROUP BY 1,2")


def score_table(t):
    """base, date, score, thresholds (with their tags): single settings, pairs and counts of all series."""
    c = F.col

    def build():
        s = cut(R.window_scores(t.series, LOOKBACKS, DELTAS, MIN_OBS))
        base = F.concat_ws("|", "series_id", "kind", F.concat(F.lit("lb="), "lookback"), F.when(c("delta") > 0, F.concat(F.lit("delta="), "delta")))
        tags = lambda pairs: F.array(*[F.struct(F.lit(float(x)).alias("th"), F.lit(tag).alias("tag")) for x, tag in pairs])
        single = s.select(base.alias("base"), "date", "score", tags([(x, f"|th={x}") for x in THRESHOLDS]).alias("marks"))
        chosen = F.when(c("series_id") == SPEED_SERIES, (c("kind") == "speed_pct") & (c("delta") == FIXED_DELTA)).otherwise(c("kind") == "level_pct")
        fixed = s.where((c("lookback") == FIXED_LOOKBACK) & chosen).select("series_id", "date", (c("score") >= FIXED_THRESHOLD).cast("int").alias("fired"))
        # All series of a date meet in one row of a few entries; pairs come from that row.
        n = fixed.select("series_id").distinct().agg(F.count(F.lit(1)).alias("n_series"))
        day = fixed.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("series_id", "fired"))).alias("z")).join(F.broadcast(n))
        pairs = F.flatten(F.transform("z", lambda x, i: F.transform(F.slice("z", i + 2, F.size("z")), lambda y: F.struct(F.concat(F.lit("combo|"), x["series_id"], F.lit("+"), y["series_id"]).alias("base"), (x["fired"] + y["fired"]).cast("double").alias("score")))))
        pair = day.select("date", F.explode(pairs).alias("p")).select("p.base", "date", "p.score", tags([(1, "|union"), (2, "|intersect")]).alias("marks"))
        whole = day.where(F.size("z") == c("n_series")).select(
            F.lit("combo|all").alias("base"), "date", F.aggregate("z", F.lit(0), lambda a, x: a + x["fired"]).cast("double").alias("score"),
            F.transform(F.sequence(F.lit(1).cast("long"), "n_series"), lambda k: F.struct(k.cast("double").alias("th"), F.concat(F.lit("|ge"), k.cast("string")).alias("tag"))).alias("marks"))
        return single.unionByName(pair).unionByName(whole)

    return staged(t.spark, t.root, "grid_scores", build)


def event_windows(t):
    """(event, place, w0, w1) of lead days and (w0, w1) around each anchor, clamped to the calendar of the first series."""
    first = t.series.agg(F.min("series_id").alias("series_id"))
    days = t.series.join(F.broadcast(first), "series_id", "left_semi").select("date").withColumn("idx", F.row_number().over(Window.orderBy("date")) - 1)  # a calendar
    names = t.spark.createDataFrame([(n, i, a) for n, anchors in EVENTS for i, a in enumerate(anchors)], "event string, place int, anchor string").withColumn("anchor", F.to_date("anchor"))
    off = {k: R.day_offset(days, names.select("anchor").distinct(), k) for k in {MIN_LEAD, MAX_LEAD, BEFORE, AFTER}}
    edge = lambda k, side, out: off[k].select("anchor", F.col(side).alias(out))
    hits = names.join(edge(MAX_LEAD, "before", "w0"), "anchor").join(edge(MIN_LEAD, "before", "w1"), "anchor").drop("anchor")
    quiet = edge(BEFORE, "before", "w0").join(edge(AFTER, "after", "w1"), "anchor").drop("anchor")
    return hits, quiet


_HITS = ", ".join(f"max(CASE WHEN h.event='{n}' THEN strftime(h.d,'%Y-%m-%d') END) AS hit_{n}" for n, _ in EVENTS)


@query("reg15_full_grid", f"""
SELECT f.base||f.tag AS combo, coalesce(n.n,0) AS n_episodes, round(f.fr,4) AS fire_rate, coalesce(n.fp,0) AS false_positive_episodes, coalesce(h.k,0) AS n_events_hit, {len(EVENTS)} AS n_events_total,
  (coalesce(h.k,0)={len(EVENTS)} AND f.fr<{RATE_CEILING} AND coalesce(n.fp,0)<={FP_CEILING})::INT AS candidate, {', '.join(f'h.hit_{n}' for n, _ in EVENTS)}
FROM (SELECT base, threshold, tag, avg(fired::INT) AS fr FROM gd_fire GROUP BY 1,2,3) f LEFT JOIN gd_n n ON n.base=f.base AND n.threshold=f.threshold
LEFT JOIN (SELECT base, threshold, count(*) AS k, {_HITS} FROM gd_hit h GROUP BY 1,2) h ON h.base=f.base AND h.threshold=f.threshold""")
def reg15_full(t):
    """Every window, threshold and rule: episodes, fire rate, false positives and the first hit of each event within the lead days."""
    d = score_table(t)
    hits, quiet = event_windows(t)
    g = R.threshold_grid(d.withColumn("ths", F.transform("marks", lambda m: m["th"])), ["base"], "ths", hits, quiet, GAP)
    tags = d.groupBy("base").agg(F.first("marks").alias("m")).select("base", F.explode("m").alias("m")).select("base", F.col("m.th").alias("threshold"), F.col("m.tag").alias("tag"))
    n_hit = F.coalesce(F.size("hits"), F.lit(0))
    ok = (n_hit == len(EVENTS)) & (F.col("fire_rate") < RATE_CEILING) & (F.col("false_positives") <= FP_CEILING)
    return g.join(tags, ["base", "threshold"]).select(
        F.concat("base", "tag").alias("combo"), F.col("n_episodes").cast("bigint").alias("n_episodes"), F.round("fire_rate", 4).alias("fire_rate"), F.col("false_positives").cast("bigint").alias("false_positive_episodes"),
        n_hit.cast("bigint").alias("n_events_hit"), F.lit(len(EVENTS)).alias("n_events_total"), ok.cast("int").alias("candidate"),
        *[F.date_format(F.try_element_at("hits", F.lit(n)), "yyyy-MM-dd").alias(f"hit_{n}") for n, _ in EVENTS])
