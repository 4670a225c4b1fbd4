"""Metrics, forecast history, ledger and hash-chained logs."""
from __future__ import annotations

from pyspark.sql import functions as F

from linewell.catalog import base as b
from linewell.catalog.fields import GRADE, duck_clv, duck_profit
from linewell.functions import times
from linewell.functions.joins import materialise
from linewell.operators import chain, history, ledger, metrics
from linewell.operators.order import with_positions
from linewell.sources import log_files, writers
from linewell.sources.archive import Archive
from linewell.streaming.sinks import new_folder

S = b.SETTINGS
BOOT = 200


def _r(*names):
    return [b.r6(n).alias(n) for n in names]


def _targets(spark, sf):
    return metrics.targets(b.table(spark, sf, "preds"))


def targets_identical_rows(spark, sf):
    return _targets(spark, sf).select("game_id", "season", "target", *_r("pm", "pk"), "y")


def prob_table(spark, sf):
    return metrics.score_predictors(_targets(spark, sf)).select("target", "predictor", "n", *_r("brier", "log_loss", "ece"))


def prob_table_with_interval(spark, sf):
    return metrics.prob_table(b.table(spark, sf, "preds"), BOOT).filter("predictor like 'model minus%'").select("target", "n", *_r("brier", "ci_lo", "ci_hi"))


def season_diffs_pivot(spark, sf):
    d = metrics.season_differences(_targets(spark, sf))
    return d.select("season", *[b.r6(F.col(f"`{t}`")).alias(t.replace(" ", "_")) for t in metrics.TARGETS])


def calibration_bins(spark, sf):
    return metrics.calibration_bins(_targets(spark, sf)).select(
        "bin", "n", *_r("model_predicted", "actual"), "n_market", *_r("market_predicted", "actual_market_bins"))


def calibration_documents(spark, sf):
    return metrics.calibration_table(b.table(spark, sf, "scored"), ["grp"], "p_model").select("grp", "bin", "n", *_r("predicted", "actual"))


def ece(spark, sf):
    return metrics.ece(b.table(spark, sf, "scored"), ["grp"], "p_model").select("grp", b.r6("ece").alias("ece"))


def mae_by_season(spark, sf):
    return metrics.mae_by_season(b.table(spark, sf, "preds")).select("season", "games", *_r("mae_market", "mae_model", "mae_fair"))


def _bets(spark, sf):
    """Settled wagers as bets: flat and staked profit."""
    g = b.table(spark, sf, "games")
    d = history.with_results(b.table(spark, sf, "wagers").filter("voided is null"), g).filter("result is not null")
    d = d.join(g.select("game_id", "season", "gameday"), "game_id")
    return d.withColumn("kelly_stake", F.col("stake_units") / 4).withColumn("kelly_units", F.col("flat") * F.col("kelly_stake"))


def bet_table_grouping_sets(spark, sf):
    return metrics.bet_totals(_bets(spark, sf)).select("market", "bets", "games", "won", "lost", "pushed", *_r("flat_roi", "flat_units", "kelly_roi"))


def bet_table(spark, sf):
    return metrics.bet_table(materialise(_bets(spark, sf), "bets"), BOOT).select("market", "bets", "games", *_r("flat_roi", "roi_lo", "roi_hi", "flat_drawdown", "kelly_drawdown"))


def bet_seasons_right_join(spark, sf):
    bets = metrics.bet_seasons(_bets(spark, sf).filter("market = 'ml' and price > 0 and game_id % 5 = 0 and season > 2012"))
    seasons = b.table(spark, sf, "games").select("season").distinct()
    return bets.join(seasons, "season", "right").na.fill(0, ["bets"]).na.fill(0.0, ["flat_units"]).select("season", "bets", *_r("flat_units", "flat_roi"))


def max_drawdown(spark, sf):
    both = metrics.with_grand_total(_bets(spark, sf).withColumn("units", F.col("flat") * F.col("stake_units")))
    return metrics.max_drawdown(both, ["market"], "units", "placed_day", ["bet_id"]).select("market", b.r6("drawdown").alias("drawdown"))


def cluster_bootstrap(spark, sf):
    d = b.table(spark, sf, "scored").withColumn("sq", F.pow(F.col("p_model") - F.col("y"), 2))
    return metrics.cluster_bootstrap_hashed(d, ["grp"], "cluster", "sq", BOOT).select("grp", *_r("est", "lo", "hi"))


def cluster_bootstrap_blocks(spark, sf):
    d = _targets(spark, sf).withColumn("diff", metrics.paired_difference())
    return metrics.cluster_bootstrap(d, ["target"], "game_id", "diff", BOOT).select("target", *_r("est", "lo", "hi"))


# ---------------------------------------------------------------- history

def _fc(spark, sf):
    return b.table(spark, sf, "forecasts")



def _slate(spark, sf):
    g = b.table(spark, sf, "games").filter("season = 2025").select("game_id", "week", F.col("result").isNotNull().alias("played"))
    k = b.table(spark, sf, "slate").select("game_id", "kickoff_epoch")
    e = F.coalesce("kickoff_epoch", F.when(F.col("game_id") % 3 != 0, F.lit(b.NOW_EPOCH) + (F.col("game_id") % 5 - 2) * 3600))
    return g.join(k, "game_id", "left").select("game_id", "week", "played", F.timestamp_seconds(e).alias("kickoff"))


def horizon_select(spark, sf):
    return history.at_horizon(_fc(spark, sf), S).select("hash", "game_id", "run_id", b.r6("lead_minutes").alias("lead_minutes"))


def horizon_coverage(spark, sf):
    return history.horizon_coverage(_fc(spark, sf), S).select("game_id", "kickoff_utc", "status", "runs_considered", "selected_run", b.r6("lead_minutes").alias("lead_minutes"), "reason")


def slate_coverage(spark, sf):
    return history.slate_coverage(_slate(spark, sf), _fc(spark, sf), S, b.now()).select(
        "game_id", "week", "kickoff_utc", "status", "reason", "played", b.r6("lead_minutes").alias("lead_minutes"))


def coverage_summary(spark, sf):
    c = history.slate_coverage(_slate(spark, sf), _fc(spark, sf), S, b.now())
    return history.coverage_summary(c).select("ord", "status", "games", b.r6("pct_of_closed_windows").alias("pct"))


def market_coverage(spark, sf):
    fc = _fc(spark, sf)
    return history.market_coverage(history.slate_coverage(_slate(spark, sf), fc, S, b.now()), history.at_horizon(fc, S))


def _graded(spark, sf):
    return history.with_results(_fc(spark, sf), b.table(spark, sf, "games"))


def score_table(spark, sf):
    return history.score_table(_graded(spark, sf)).select("market", "model_version", "games", "sides", *_r("model_brier", "market_brier", "model_logloss", "market_logloss"))


def settlement_by_tier(spark, sf):
    return history.settlement_by_tier(_graded(spark, sf)).select("tier", "won", "lost", "pushed", *_r("units", "avg_clv"), "pending")


def best_side(spark, sf):
    return history.best_sides(_fc(spark, sf)).select("hash", "best")


def ledger_settled(spark, sf):
    return history.ledger_summary(b.table(spark, sf, "wagers"), b.table(spark, sf, "games")).select(
        "market", "placed", "settled", "won", "lost", "pushed", *_r("staked", "profit", "roi", "avg_clv"))


def lead_times(spark, sf):
    return history.lead_times(history.horizon_coverage(_fc(spark, sf), S)).select(*_r("lead_min", "lead_median", "lead_max"))


def forecast_tiers(spark, sf):
    return history.tier_counts(_fc(spark, sf))


def graded_days(spark, sf):
    return history.graded_days(_graded(spark, sf), b.table(spark, sf, "games")).select("gameday", "market", "bets", "won", "lost", b.r6("units").alias("units"))


def recheck(spark, sf):
    fc = _fc(spark, sf)
    rows = fc.select("hash", "game_id", "decision", F.when(F.col("price") > 0, "ref quoted").otherwise("").alias("reasons"), F.col("recorded_utc").alias("odds_time"),
                     (F.col("market") != "ml").alias("reference_live"), F.col("prediction_completed_utc").alias("reference_oldest_utc"), F.lit(1.0).alias("stake_units"))
    done = F.timestamp_seconds(F.lit(b.NOW_EPOCH - 7200))
    k = fc.groupBy("game_id").agg(F.min(times.parse_utc(F.col("kickoff_utc"))).alias("kickoff"))
    return history.recheck(rows, k, done, S).select("hash", "decision", "reasons", "stake_units", "post_kickoff")


# ---------------------------------------------------------------- ledger, archive, chains

def _requests(spark, sf):
    """One wager request per event: the id prefix of some forecast, sometimes too short or unknown."""
    e = b.table(spark, sf, "quote_parts")
    fid = F.sha2(F.col("event_id").cast("string"), 256)
    n = F.when(F.col("event_id") % 9 == 0, 6).when(F.col("event_id") % 9 == 1, 8).otherwise(16)
    kick = F.lit(b.NOW_EPOCH) + (F.col("game_id") % 7) * 2700 - 10000
    at = kick - (F.col("event_id") % 5 - 1) * 2000
    return e.select(F.col("event_id").alias("request_id"), F.when(F.col("event_id") % 71 == 0, "zzzzzzzz").otherwise(F.expr("left(sha2(cast(event_id as string), 256), case when event_id % 9 = 0 then 6 when event_id % 9 = 1 then 8 else 16 end)")).alias("forecast_id"),
                    F.when(F.col("event_id") % 37 == 0, 0.0).otherwise((F.col("event_id") % 4 + 1) / 2.0).alias("stake_units"), times.iso(F.timestamp_seconds(at)).alias("placed_utc"),
                    F.when(F.col("event_id") % 29 == 0, 50.0).alias("price"), F.when((F.col("event_id") % 33 == 0), 7.25).alias("point"))


def wager_intake_prefix(spark, sf):
    r = _requests(spark, sf)
    seen = spark.createDataFrame([], "bet_id string")
    return ledger.wager_intake(r, _fc(spark, sf), seen).select("request_id", "matches", "price", "point", "reason")


def prefix_matches(spark, sf):
    """Id prefixes of 1 to 64 characters, some unknown, some of no character."""
    e = b.table(spark, sf, "quote_parts")
    fid = F.when(F.col("event_id") % 53 == 0, "zz").when(F.col("event_id") % 59 == 0, "").otherwise(F.expr("left(sha2(cast(event_id as string), 256), cast(event_id % 64 + 1 as int))"))
    r = e.select(F.col("event_id").alias("request_id"), fid.alias("forecast_id"))
    return ledger.match_prefixes(r, _fc(spark, sf)).select("request_id", "matches", "hash")


def wager_intake_recorded(spark, sf):
    """Wagers against a ledger that holds the bets of every fifth request, each request sent twice."""
    f, r = _fc(spark, sf), _requests(spark, sf)
    none = spark.createDataFrame([], "bet_id string")
    seen = materialise(ledger.wager_intake(r.filter("request_id % 5 = 0"), f, none).filter("reason = ''").select("bet_id"), "ledger")
    twice = r.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1000000000)))).withColumn("request_id", F.col("request_id") + F.col("copy")).drop("copy")
    return ledger.wager_intake(twice, f, seen).groupBy("reason").agg(F.count(F.lit(1)).alias("requests"), F.min("request_id").alias("first"), F.max("request_id").alias("last"))


def forecast_order(spark, sf):
    """Place of every forecast in the history: by recording time, then hash."""
    return with_positions(_fc(spark, sf).select("hash", "recorded_utc"), [F.col("recorded_utc").asc_nulls_last(), F.col("hash").asc()], "place")


def ledger_order(spark, sf):
    """Place of every wager in the ledger report: largest stake first, then bet id."""
    return with_positions(b.table(spark, sf, "wagers").select("bet_id", "stake_units"), [F.col("stake_units").desc_nulls_last(), F.col("bet_id").asc()], "place")


def ledger_voids(spark, sf):
    w = b.table(spark, sf, "wagers").withColumn("row", F.xxhash64("bet_id")).drop("voided")
    v = b.table(spark, sf, "wagers").filter("voided is not null").select(F.concat(F.lit("v-"), "bet_id").alias("request_id"), "bet_id", F.col("voided").alias("note"))
    again = v.select(F.concat(F.lit("w-"), "bet_id").alias("request_id"), "bet_id", F.lit("second thoughts").alias("note"))
    ghost = v.select(F.concat(F.lit("x-"), "bet_id").alias("request_id"), F.concat(F.lit("no-"), "bet_id").alias("bet_id"), "note")
    d = ledger.ledger(w, v.unionByName(again).unionByName(ghost))
    return d.groupBy("market", "voided").agg(F.count("*").alias("bets"), b.r6(F.sum("stake_units")).alias("staked"))


WEATHER_KEY = ["game_id", "kickoff_utc", "valid_for_utc", "wind_mph", "temp_f", "source", "forecast_utc", "retrieved_utc"]


def archive_new_rows(spark, sf):
    w = b.table(spark, sf, "weather_inputs").select(*WEATHER_KEY)
    batch = w.unionByName(w)
    return ledger.unseen_rows(batch, w.filter("wind_mph <= '3'"), WEATHER_KEY)


def archive_batches(spark, sf):
    """Weather inputs archived in three overlapping batches, the second one sent twice: rows by the batch that brought their key."""
    w = b.table(spark, sf, "weather_inputs").select(*WEATHER_KEY)
    store = Archive(spark, new_folder(spark, "archive"), w.schema, WEATHER_KEY)
    for name, rows in (("b1", w.filter("wind_mph <= '2'")), ("b2", w.filter("wind_mph <= '3'")), ("b2", w), ("b3", w)):
        store.add(rows, name)
    return store.rows().select(F.col("run_id").alias("batch"), *WEATHER_KEY)


def _log_rows(spark, sf):
    d = b.table(spark, sf, "documents")
    return d.select(F.col("source").alias("log_id"), F.col("doc_id").alias("ord"), F.lit("2024-02-01T12:00:00Z").alias("recorded_utc"), F.col("lang").alias("kind"), F.col("text").alias("body"))


def chain_seal(spark, sf):
    return chain.seal(_log_rows(spark, sf)).select("log_id", "seq", "prev", "hash")


def chain_audit(spark, sf):
    """Sealed document logs, some then edited, cut or re-ordered."""
    s = materialise(chain.seal(_log_rows(spark, sf)), "log")
    h = F.conv(F.substring("hash", 1, 6), 16, 10).cast("bigint")
    t = s.withColumn("body", F.when((h % 97 == 3) & (F.col("log_id") < "src5"), F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    t = t.withColumn("pos", F.when((F.col("log_id") > "src7") & F.col("seq").isin(4, 5), 9 - F.col("seq")).otherwise(F.col("seq")))
    return chain.audit(t)


def _stored_log(spark, sf):
    """Document logs on files, appended in two goes."""
    root = new_folder(spark, "logs")
    rows = _log_rows(spark, sf)
    for part in (0, 1):
        log_files.append_records(rows.filter(F.col("ord") % 2 == 0) if part == 0 else rows.filter(F.col("ord") % 2 == 1), root)
    return root


def log_positions(spark, sf):
    """Records of stored logs with their places, read in ranges of 20,000 bytes."""
    return log_files.read_records(spark, _stored_log(spark, sf), 20_000).select("log_id", "pos", "seq", F.col("kind").alias("lang"), "prev", "hash")


def log_file_audit(spark, sf):
    """Audit of stored logs after lines were taken out of some files and swapped in others."""
    d = log_files.read_lines(spark, _stored_log(spark, sf))
    kept = d.filter(~((F.col("log_id") < "src3") & (F.col("pos") == 7)))
    moved = kept.withColumn("to", F.when((F.col("log_id") > "src6") & F.col("pos").isin(4, 5), 9 - F.col("pos")).otherwise(F.col("pos")))
    root = new_folder(spark, "logs-tampered")
    (moved.repartition("log_id").sortWithinPartitions("log_id", "to").select("log_id", F.col("line").alias("value")).write.partitionBy("log_id").text(root))
    return chain.audit(log_files.read_records(spark, root))


def run_tables(spark, sf):
    """Forecasts recorded run by run, one of them twice with other rows; what readers see."""
    f = _fc(spark, sf).select("hash", "game_id", "market", "price", "recorded_utc", "prediction_completed_utc")
    root = new_folder(spark, "runs")
    part = F.pmod(F.conv(F.substring("hash", 1, 6), 16, 10).cast("bigint"), F.lit(3))
    for k in (0, 1, 2):
        writers.append_forecasts(f.filter(part == k), root, f"run{k}")
    writers.append_forecasts(f, root, "run1")   # the run is there: adds nothing
    return writers.read_forecasts(spark, root, f.schema).groupBy("run_id", "market").agg(F.count(F.lit(1)).alias("n"), F.min("hash").alias("first"), b.r6(F.sum("price")).alias("prices"))


QUERIES = {f.__name__: f for f in (
    targets_identical_rows, prob_table, prob_table_with_interval, season_diffs_pivot, calibration_bins, calibration_documents, ece, mae_by_season,
    bet_table_grouping_sets, bet_table, bet_seasons_right_join, max_drawdown, cluster_bootstrap, cluster_bootstrap_blocks, horizon_select,
    horizon_coverage, slate_coverage, coverage_summary, market_coverage, score_table, settlement_by_tier, best_side, ledger_settled,
    lead_times, forecast_tiers, graded_days, recheck, wager_intake_prefix, wager_intake_recorded,
    prefix_matches, forecast_order, ledger_order, ledger_voids, archive_new_rows, archive_batches, chain_seal, chain_audit, log_positions, log_file_audit, run_tables)}

# ---------------------------------------------------------------- oracles

T = """tg AS (SELECT game_id, season, 'winner' AS target, p_model AS pm, p_market AS pk, CASE WHEN result > 0 THEN 1.0 ELSE 0.0 END AS y, p_ratings_only, p_home_rate FROM preds WHERE result <> 0 AND p_model IS NOT NULL AND p_market IS NOT NULL
  UNION ALL SELECT game_id, season, 'home covers', p_cover, p_cover_mkt, CASE WHEN result > spread_line THEN 1.0 ELSE 0.0 END, NULL, NULL FROM preds WHERE result <> spread_line AND p_cover IS NOT NULL AND p_cover_mkt IS NOT NULL
  UNION ALL SELECT game_id, season, 'over hits', p_over, p_over_mkt, CASE WHEN total > total_line THEN 1.0 ELSE 0.0 END, NULL, NULL FROM preds WHERE total <> total_line AND p_over IS NOT NULL AND p_over_mkt IS NOT NULL)"""
UNP = """un AS (SELECT target, 'model' AS predictor, pm AS p, y FROM tg UNION ALL SELECT target, 'market no-vig (closing)', pk, y FROM tg UNION ALL SELECT target, 'coin flip', 0.5, y FROM tg
  UNION ALL SELECT target, 'ratings only (no market)', p_ratings_only, y FROM tg WHERE target = 'winner' UNION ALL SELECT target, 'home-team base rate', p_home_rate, y FROM tg WHERE target = 'winner')"""


def _bin(p, edges=metrics.TABLE_EDGES):
    return "CASE " + " ".join(f"WHEN {p} <= CAST('{hi!r}' AS DOUBLE) THEN '({'-0.001' if lo == 0 else format(lo, 'g')}, {hi:g}]'" for lo, hi in zip(edges, edges[1:])) + " END"


def _ece(src, keys, p):
    k = ", ".join(keys)
    return f"""SELECT {k}, sum(n * abs(pr - ac)) / sum(n) AS ece FROM (SELECT {k}, {_bin(p, metrics.EVEN_EDGES)} AS bin, count(*) AS n, avg({p}) AS pr, avg(y) AS ac FROM {src} GROUP BY ALL) z GROUP BY {k}"""


BETS = f"""bets0 AS (SELECT w.*, g.season, g.gameday, g.home_score, g.spread_line, g.total_line, g.home_moneyline, g.away_moneyline, {GRADE} AS v FROM wagers w JOIN games g ON g.game_id = w.game_id WHERE w.voided IS NULL),
bets AS (SELECT *, {duck_profit('result', 'price')} AS flat, {duck_clv()} AS clv, stake_units / 4 AS kelly_stake FROM (SELECT *, CASE WHEN v > 0 THEN 'W' WHEN v = 0 THEN 'P' WHEN v < 0 THEN 'L' END AS result FROM bets0) z)"""
GRADED = f"""graded AS (SELECT *, {duck_profit('result', 'price')} AS flat, {duck_clv()} AS clv FROM (SELECT *, CASE WHEN v > 0 THEN 'W' WHEN v = 0 THEN 'P' WHEN v < 0 THEN 'L' END AS result
  FROM (SELECT f.*, g.gameday, g.home_score, g.spread_line, g.total_line, g.home_moneyline, g.away_moneyline, {GRADE} AS v FROM forecasts f LEFT JOIN games g ON g.game_id = f.game_id) y) z),
best AS (SELECT *, coalesce(is_best_side, row_number() OVER (PARTITION BY game_id, market ORDER BY ev DESC, hash DESC) = 1) AS best FROM graded)"""
HOR = f"""ft AS (SELECT *, CASE WHEN prediction_completed_utc IS NOT NULL THEN greatest({b.epoch('recorded_utc')}, {b.epoch('prediction_completed_utc')}) END AS issued, {b.epoch('kickoff_utc')} AS k,
    coalesce(run_id, 'legacy@' || recorded_utc) AS run FROM forecasts),
fl AS (SELECT *, (k - issued) / 60 AS lead, coalesce((k - issued) / 60 BETWEEN 60 AND 75, false) AS ok FROM ft),
rn AS (SELECT game_id, run, max(issued) AS issued, bool_and(ok) AS ok, min(lead) AS lead, min(kickoff_utc) AS kickoff_utc FROM fl GROUP BY ALL),
pick AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY game_id ORDER BY issued DESC, run DESC) AS r FROM rn WHERE ok) z WHERE r = 1),
cov AS (SELECT g.game_id, g.kickoff_utc, CASE WHEN p.run IS NOT NULL THEN 'eligible' ELSE 'excluded' END AS status, g.n AS runs_considered, p.run AS selected_run, p.lead AS lead_minutes,
    CASE WHEN p.run IS NOT NULL THEN '' WHEN g.timed = 0 THEN 'only legacy forecasts (completion time unknown)' WHEN g.late = g.n THEN 'all forecasts issued after the cutoff (kickoff - 60 min)'
      ELSE concat('no forecast issued inside the 15-min window (closest lead ', CAST(round_even(g.ml, 0) AS BIGINT), ' min)') END AS reason
  FROM (SELECT game_id, min(kickoff_utc) AS kickoff_utc, count(*) AS n, count(issued) AS timed, min(lead) AS ml, count(*) FILTER (lead < 60) AS late FROM rn GROUP BY 1) g LEFT JOIN pick p ON p.game_id = g.game_id)"""
_SL = f"""sl AS (SELECT g.game_id, g.week, g.result IS NOT NULL AS played, coalesce(s.kickoff_epoch, CASE WHEN g.game_id % 3 <> 0 THEN {b.NOW_EPOCH} + (g.game_id % 5 - 2) * 3600 END) AS k
  FROM games g LEFT JOIN slate s ON s.game_id = g.game_id WHERE g.season = 2025),
sc AS (SELECT sl.*, c.reason AS why, c.lead_minutes AS lm, CASE WHEN sl.k IS NULL THEN 'unknown kickoff' WHEN c.status = 'eligible' THEN 'eligible' WHEN {b.NOW_EPOCH} < sl.k - 3600 THEN 'window not closed'
  WHEN c.status IS NOT NULL THEN 'forecasts exist, none qualify' ELSE 'no forecast recorded' END AS status FROM sl LEFT JOIN cov c ON c.game_id = sl.game_id)"""
HV = ["forecasts", "games", "slate"]
iso = b.duck_iso
_DONE = b.NOW_EPOCH - 7200


def _sealed(body, extra=""):
    """Recursive CTE that chains each log; views are not needed."""
    digest = "sha256(concat_ws(chr(31), CAST(l.seq AS VARCHAR), '2024-02-01T12:00:00Z', l.lang, coalesce(l.text, ''), {prev}))"
    return f"""WITH RECURSIVE lg AS (SELECT source, lang, text, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS seq FROM documents),
sealed AS (SELECT l.source, l.lang, l.text, l.seq, repeat('0', 64) AS prev, {digest.format(prev="repeat('0', 64)")} AS hash FROM lg l WHERE seq = 0
  UNION ALL SELECT l.source, l.lang, l.text, l.seq, s.hash, {digest.format(prev='s.hash')} FROM sealed s JOIN lg l ON l.source = s.source AND l.seq = s.seq + 1){extra}
{body}"""


def _stored(body):
    """The same logs in the order of two appends: even document ids first."""
    return _sealed(body).replace("ORDER BY doc_id) - 1 AS seq", "ORDER BY doc_id % 2, doc_id) - 1 AS seq", 1)


_REQ = f"""rq AS (SELECT event_id AS request_id, CASE WHEN event_id % 71 = 0 THEN 'zzzzzzzz' ELSE left(sha256(CAST(event_id AS VARCHAR)), CASE event_id % 9 WHEN 0 THEN 6 WHEN 1 THEN 8 ELSE 16 END) END AS fid,
  CASE WHEN event_id % 37 = 0 THEN 0.0 ELSE (event_id % 4 + 1) / 2 END AS stake, {b.NOW_EPOCH} + (game_id % 7) * 2700 - 10000 - (event_id % 5 - 1) * 2000 AS at,
  CASE WHEN event_id % 29 = 0 THEN 50.0 END AS pr, CASE WHEN event_id % 33 = 0 THEN 7.25 END AS pt FROM quote_parts),
hit AS (SELECT r.request_id, count(f.hash) AS matches, min(f.hash) AS hash FROM rq r LEFT JOIN forecasts f ON starts_with(f.hash, r.fid) GROUP BY 1)"""

ORACLES = {
    "targets_identical_rows": b.oracle(["preds"], "SELECT game_id, season, target, round(pm, 6) AS pm, round(pk, 6) AS pk, CAST(y AS DOUBLE) AS y FROM tg", T),
    "prob_table": b.oracle(["preds"], f"""SELECT s.target, s.predictor, s.n, round(brier, 6) AS brier, round(log_loss, 6) AS log_loss, CASE WHEN s.predictor <> 'coin flip' THEN round(e.ece, 6) END AS ece FROM
 (SELECT target, predictor, count(*) AS n, avg((p - y) * (p - y)) AS brier, -avg(y * ln(p) + (1 - y) * ln(1 - p)) AS log_loss FROM un GROUP BY ALL) s
 JOIN ({_ece('un', ['target', 'predictor'], 'p')}) e ON e.target = s.target AND e.predictor = s.predictor""", T + ",\n" + UNP),
    "season_diffs_pivot": b.oracle(["preds"], "SELECT season, " + ", ".join(f"round(avg((pm - y) * (pm - y) - (pk - y) * (pk - y)) FILTER (target = '{t}'), 6) AS {t.replace(' ', '_')}" for t in metrics.TARGETS) + " FROM tg GROUP BY 1", T),
    "calibration_bins": b.oracle(["preds"], f"""SELECT coalesce(m.bin, k.bin) AS bin, m.n, round(mp, 6) AS model_predicted, round(ma, 6) AS actual, k.n AS n_market, round(kp, 6) AS market_predicted, round(ka, 6) AS actual_market_bins FROM
 (SELECT {_bin('pm')} AS bin, count(*) AS n, avg(pm) AS mp, avg(y) AS ma FROM tg WHERE target = 'winner' GROUP BY 1) m FULL JOIN
 (SELECT {_bin('pk')} AS bin, count(*) AS n, avg(pk) AS kp, avg(y) AS ka FROM tg WHERE target = 'winner' GROUP BY 1) k ON k.bin = m.bin""", T),
    "calibration_documents": b.oracle(["scored"], f"SELECT grp, {_bin('p_model')} AS bin, count(*) AS n, round(avg(p_model), 6) AS predicted, round(avg(y), 6) AS actual FROM scored GROUP BY 1, 2"),
    "ece": b.oracle(["scored"], f"SELECT grp, round(ece, 6) AS ece FROM ({_ece('scored', ['grp'], 'p_model')}) z"),
    "mae_by_season": b.oracle(["preds"], "SELECT season, count(*) AS games, round(avg(abs(result - spread_line)), 6) AS mae_market, round(avg(abs(result - model_margin)), 6) AS mae_model, round(avg(abs(result - fair_margin)), 6) AS mae_fair FROM preds GROUP BY 1"),
    "bet_table_grouping_sets": b.oracle(["wagers", "games"], """SELECT coalesce(market, 'all') AS market, count(*) AS bets, count(DISTINCT game_id) AS games, count(*) FILTER (result = 'W') AS won, count(*) FILTER (result = 'L') AS lost,
  count(*) FILTER (result = 'P') AS pushed, round(avg(flat), 6) AS flat_roi, round(sum(flat), 6) AS flat_units, round(sum(flat * kelly_stake) / sum(kelly_stake), 6) AS kelly_roi
FROM bets WHERE result IS NOT NULL GROUP BY GROUPING SETS ((market), ())""", BETS),
    "bet_seasons_right_join": b.oracle(["wagers", "games"], """SELECT s.season, coalesce(count(b.flat), 0) AS bets, round(coalesce(sum(b.flat), 0), 6) AS flat_units, round(avg(b.flat), 6) AS flat_roi FROM (SELECT DISTINCT season FROM games) s
LEFT JOIN (SELECT * FROM bets WHERE result IS NOT NULL AND market = 'ml' AND price > 0 AND game_id % 5 = 0 AND season > 2012) b ON b.season = s.season GROUP BY 1""", BETS),
    "max_drawdown": b.oracle(["wagers", "games"], """SELECT market, round(max(greatest(peak, 0) - c), 6) AS drawdown FROM (SELECT *, max(c) OVER (PARTITION BY market ORDER BY placed_day, bet_id ROWS UNBOUNDED PRECEDING) AS peak FROM
  (SELECT market, placed_day, bet_id, sum(flat * stake_units) OVER (PARTITION BY market ORDER BY placed_day, bet_id ROWS UNBOUNDED PRECEDING) AS c FROM
    (SELECT * FROM bets WHERE result IS NOT NULL UNION ALL SELECT * REPLACE ('all' AS market) FROM bets WHERE result IS NOT NULL) x) y) z GROUP BY 1""", BETS),
    "cluster_bootstrap": b.oracle(["scored"], f"""SELECT e.grp, round(e.est, 6) AS est, round(quantile_cont(stat, 0.025), 6) AS lo, round(quantile_cont(stat, 0.975), 6) AS hi FROM (SELECT grp, sum(s) / sum(n) AS est FROM cl GROUP BY 1) e JOIN
 (SELECT d.grp, d.rep, sum(c.s) / sum(c.n) AS stat FROM (SELECT grp, rep, CAST(floor(CAST(concat('0x', substr(sha256(concat_ws('-', rep, j)), 1, 8)) AS BIGINT) / 4294967296.0 * g) AS BIGINT) AS i
    FROM (SELECT grp, count(*) AS g FROM cl GROUP BY 1) s, range(1, {BOOT + 1}) r(rep), LATERAL (SELECT unnest(range(0, g)) AS j) jj) d
  JOIN cl c ON c.grp = d.grp AND c.i = d.i GROUP BY 1, 2) q ON q.grp = e.grp GROUP BY 1, e.est""",
                                  "cl AS (SELECT grp, cluster, sum(pow(p_model - y, 2)) AS s, count(*) AS n, row_number() OVER (PARTITION BY grp ORDER BY cluster) - 1 AS i FROM scored GROUP BY grp, cluster)"),
    "horizon_select": b.oracle(["forecasts"], "SELECT f.hash, f.game_id, f.run_id, round(f.lead, 6) AS lead_minutes FROM fl f JOIN pick p ON p.game_id = f.game_id AND p.run = f.run", HOR),
    "horizon_coverage": b.oracle(["forecasts"], "SELECT game_id, kickoff_utc, status, runs_considered, selected_run, round(lead_minutes, 6) AS lead_minutes, reason FROM cov", HOR),
    "slate_coverage": b.oracle(HV, f"""SELECT game_id, week, {iso('k')} AS kickoff_utc, status, CASE status WHEN 'unknown kickoff' THEN 'kickoff time not listed in the schedule'
  WHEN 'window not closed' THEN concat('evaluation window closes ', {iso('(k - 3600)')}) WHEN 'forecasts exist, none qualify' THEN why ELSE '' END AS reason, played, CASE WHEN status = 'eligible' THEN round(lm, 6) END AS lead_minutes FROM sc""", HOR + ",\n" + _SL),
    "coverage_summary": b.oracle(HV, """SELECT ord, d.status, count(sc.game_id) AS games, CASE WHEN ord < 3 THEN round(count(sc.game_id) / nullif((SELECT count(*) FROM sc WHERE status IN ('eligible', 'forecasts exist, none qualify', 'no forecast recorded')), 0), 6) END AS pct
FROM (VALUES (0, 'eligible'), (1, 'forecasts exist, none qualify'), (2, 'no forecast recorded'), (3, 'window not closed'), (4, 'unknown kickoff')) d(ord, status) LEFT JOIN sc ON sc.status = d.status GROUP BY 1, 2""", HOR + ",\n" + _SL),
    "market_coverage": b.oracle(HV, """SELECT m AS market, count(*) AS eligible_games, count(h.n) AS with_forecast, count(*) FILTER (h.ref) AS with_market_reference, count(*) FILTER (h.n IS NULL) AS missing,
  coalesce(string_agg(CAST(e.game_id AS VARCHAR), ',' ORDER BY e.game_id) FILTER (h.n IS NULL), '') AS missing_games FROM (SELECT game_id FROM sc WHERE status = 'eligible') e CROSS JOIN (VALUES ('spread'), ('ml'), ('total')) v(m)
LEFT JOIN (SELECT f.game_id, f.market, count(*) AS n, bool_or(market_prob IS NOT NULL) AS ref FROM fl f JOIN pick p ON p.game_id = f.game_id AND p.run = f.run GROUP BY ALL) h ON h.game_id = e.game_id AND h.market = m GROUP BY 1""", HOR + ",\n" + _SL),
    "score_table": b.oracle(["forecasts", "games"], """SELECT market, coalesce(model_version, 'unknown') AS model_version, count(DISTINCT game_id) AS games, count(*) AS sides,
  round(avg(pow(model_prob - y, 2)), 6) AS model_brier, round(avg(pow(market_prob - y, 2)), 6) AS market_brier, round(-avg(y * ln(model_prob) + (1 - y) * ln(1 - model_prob)), 6) AS model_logloss,
  round(-avg(y * ln(market_prob) + (1 - y) * ln(1 - market_prob)), 6) AS market_logloss FROM (SELECT *, CASE WHEN result = 'W' THEN 1.0 ELSE 0.0 END AS y FROM graded WHERE result IN ('W', 'L') AND model_prob IS NOT NULL AND market_prob IS NOT NULL) z GROUP BY 1, 2""", GRADED),
    "settlement_by_tier": b.oracle(["forecasts", "games"], """SELECT tier, count(*) FILTER (result = 'W') AS won, count(*) FILTER (result = 'L') AS lost, count(*) FILTER (result = 'P') AS pushed, round(sum(flat), 6) AS units,
  round(avg(clv) FILTER (result IS NOT NULL), 6) AS avg_clv, count(*) FILTER (result IS NULL) AS pending FROM best WHERE best AND tier IN ('executable', 'conditional') GROUP BY 1""", GRADED),
    "best_side": b.oracle(["forecasts", "games"], "SELECT hash, best FROM best", GRADED),
    "ledger_settled": b.oracle(["wagers", "games"], """SELECT market, count(*) AS placed, count(result) AS settled, count(*) FILTER (result = 'W') AS won, count(*) FILTER (result = 'L') AS lost, count(*) FILTER (result = 'P') AS pushed,
  round(sum(stake_units) FILTER (result IS NOT NULL), 6) AS staked, round(sum(flat * stake_units), 6) AS profit, round(sum(flat * stake_units) / sum(stake_units) FILTER (result IS NOT NULL), 6) AS roi, round(avg(clv) FILTER (result IS NOT NULL), 6) AS avg_clv FROM
  (SELECT w.*, b.result, b.flat, b.clv FROM wagers w LEFT JOIN bets b ON b.bet_id = w.bet_id WHERE w.voided IS NULL) z GROUP BY 1""", BETS),
    "lead_times": b.oracle(["forecasts"], "SELECT round(min(lead_minutes), 6) AS lead_min, round(quantile_cont(lead_minutes, 0.5), 6) AS lead_median, round(max(lead_minutes), 6) AS lead_max FROM cov WHERE status = 'eligible'", HOR),
    "forecast_tiers": b.oracle(["forecasts"], "SELECT run_id, tier, count(*) AS n FROM forecasts GROUP BY 1, 2"),
    "graded_days": b.oracle(["forecasts", "games"], """SELECT gameday, market, count(*) AS bets, count(*) FILTER (result = 'W') AS won, count(*) FILTER (result = 'L') AS lost, round(sum(flat), 6) AS units
FROM best WHERE best AND decision <> 'NO BET' AND gameday IS NOT NULL GROUP BY 1, 2""", GRADED),
    "recheck": b.oracle(["forecasts"], f"""SELECT hash, CASE WHEN late THEN 'NO BET' WHEN qold OR rold THEN 'BET IF PRICE AVAILABLE' ELSE decision END AS decision,
  concat_ws(' | ', CASE WHEN price > 0 THEN 'ref quoted' END, CASE WHEN late THEN concat('kickoff passed before the run completed at ', {iso(str(_DONE))}) WHEN qold THEN concat('quote from ', recorded_utc, ' was stale by completion (', {iso(str(_DONE))}, '); reconfirm the price')
    WHEN rold THEN concat('market reference quotes expired by completion (', {iso(str(_DONE))}, '; oldest ', coalesce(prediction_completed_utc, 'None'), '); EV is not current, reconfirm the market') END) AS reasons,
  CAST(CASE WHEN late OR decision = 'NO BET' THEN 0.0 ELSE 1.0 END AS DOUBLE) AS stake_units, late AS post_kickoff
FROM (SELECT *, ob AND NOT qold AND market <> 'ml' AND coalesce({_DONE} - {b.epoch('prediction_completed_utc')} > 1800, true) AS rold FROM
  (SELECT *, {_DONE} >= {b.epoch('kickoff_utc')} AS late, decision IN ('BET', 'BET IF CONFIRMED') AS ob, decision IN ('BET', 'BET IF CONFIRMED') AND {_DONE} - {b.epoch('recorded_utc')} > 1800 AS qold FROM forecasts) y) z"""),
    "wager_intake_prefix": b.oracle(["forecasts"], f"""SELECT r.request_id, h.matches, coalesce(r.pr, f.price) AS price, coalesce(r.pt, f.point) AS point,
  CASE WHEN h.matches <> 1 THEN concat('forecast id matches ', h.matches, ' records') WHEN r.at >= {b.epoch('f.kickoff_utc')} THEN 'placed time is not before kickoff' WHEN {b.epoch('f.recorded_utc')} > r.at THEN 'placed time is before the forecast was recorded'
    WHEN r.stake <= 0 THEN 'stake must be a positive number of units' WHEN abs(coalesce(r.pr, f.price)) < 100 THEN 'invalid price'
    WHEN f.market <> 'ml' AND NOT (abs(coalesce(r.pt, f.point) * 2 - round_even(coalesce(r.pt, f.point) * 2, 0)) <= 1e-9) THEN 'invalid point' ELSE '' END AS reason
FROM rq r JOIN hit h ON h.request_id = r.request_id LEFT JOIN forecasts f ON h.matches = 1 AND f.hash = h.hash""", _REQ),
    "prefix_matches": b.oracle(["forecasts"], """SELECT r.request_id, count(f.hash) AS matches, CASE WHEN count(f.hash) = 1 THEN min(f.hash) END AS hash
FROM rq r LEFT JOIN (SELECT DISTINCT hash FROM forecasts) f ON starts_with(f.hash, r.fid) GROUP BY 1""",
                               "rq AS (SELECT event_id AS request_id, CASE WHEN event_id % 53 = 0 THEN 'zz' WHEN event_id % 59 = 0 THEN '' ELSE left(sha256(CAST(event_id AS VARCHAR)), event_id % 64 + 1) END AS fid FROM quote_parts)"),
    "wager_intake_recorded": b.oracle(["forecasts"], f"""SELECT CASE WHEN reason = '' AND (held OR no <> request_id OR request_id > first_of_bet) THEN 'bet already recorded' ELSE reason END AS reason, count(*) AS requests, min(request_id) AS first, max(request_id) AS last
FROM (SELECT d.*, z.no, min(z.no) OVER (PARTITION BY d.bet) AS first_of_bet, bool_or(z.no % 5 = 0) OVER (PARTITION BY d.bet) AS held, z.request_id FROM (SELECT event_id AS no, unnest([event_id, event_id + 1000000000]) AS request_id FROM quote_parts) z JOIN ({{_DECIDED}}) d ON d.rid = z.no) y GROUP BY 1""".replace("{_DECIDED}", f"""SELECT r.request_id AS rid, coalesce(CASE WHEN h.matches = 1 THEN concat(f.hash, r.at, r.stake, coalesce(r.pr, f.price), coalesce(r.pt, f.point)) END, CAST(r.request_id AS VARCHAR)) AS bet,
  CASE WHEN h.matches <> 1 THEN concat('forecast id matches ', h.matches, ' records') WHEN r.at >= {b.epoch('f.kickoff_utc')} THEN 'placed time is not before kickoff' WHEN {b.epoch('f.recorded_utc')} > r.at THEN 'placed time is before the forecast was recorded'
    WHEN r.stake <= 0 THEN 'stake must be a positive number of units' WHEN abs(coalesce(r.pr, f.price)) < 100 THEN 'invalid price'
    WHEN f.market <> 'ml' AND NOT (abs(coalesce(r.pt, f.point) * 2 - round_even(coalesce(r.pt, f.point) * 2, 0)) <= 1e-9) THEN 'invalid point' ELSE '' END AS reason
FROM rq r JOIN hit h ON h.request_id = r.request_id LEFT JOIN forecasts f ON h.matches = 1 AND f.hash = h.hash"""), _REQ),
    "forecast_order": b.oracle(["forecasts"], "SELECT hash, recorded_utc, row_number() OVER (ORDER BY recorded_utc NULLS LAST, hash) - 1 AS place FROM forecasts"),
    "ledger_order": b.oracle(["wagers"], "SELECT bet_id, stake_units, row_number() OVER (ORDER BY stake_units DESC NULLS LAST, bet_id) - 1 AS place FROM wagers"),
    "log_positions": _stored("SELECT source AS log_id, seq AS pos, seq, lang, prev, hash FROM sealed"),
    "log_file_audit": _stored("""SELECT log_id, count(*) AS records, count(problem) = 0 AS intact, min(pos) FILTER (problem IS NOT NULL) AS first_bad, min_by(problem, pos) FILTER (problem IS NOT NULL) AS problem FROM (
  SELECT *, CASE WHEN seq <> pos THEN 'sequence out of order' WHEN prev <> coalesce(lag(hash) OVER (PARTITION BY log_id ORDER BY pos), repeat('0', 64)) THEN 'previous-hash link broken' END AS problem
  FROM (SELECT source AS log_id, seq, prev, hash, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN source > 'src6' AND seq IN (4, 5) THEN 9 - seq ELSE seq END) - 1 AS pos FROM sealed WHERE NOT (source < 'src3' AND seq = 7)) y) z GROUP BY 1"""),
    "run_tables": b.oracle(["forecasts"], """SELECT concat('run', CAST(concat('0x', substr(hash, 1, 6)) AS BIGINT) % 3) AS run_id, market, count(*) AS n, min(hash) AS first, round(sum(price), 6) AS prices FROM forecasts GROUP BY 1, 2"""),
    "ledger_voids": b.oracle(["wagers"], "SELECT market, voided, count(*) AS bets, round(sum(stake_units), 6) AS staked FROM wagers GROUP BY 1, 2"),
    "archive_new_rows": b.oracle(["weather_inputs"], f"SELECT DISTINCT {', '.join(WEATHER_KEY)} FROM weather_inputs WHERE NOT (wind_mph <= '3')"),
    "archive_batches": b.oracle(["weather_inputs"], f"SELECT DISTINCT CASE WHEN wind_mph <= '2' THEN 'b1' WHEN wind_mph <= '3' THEN 'b2' ELSE 'b3' END AS batch, {', '.join(WEATHER_KEY)} FROM weather_inputs"),
    "chain_seal": _sealed("SELECT source AS log_id, seq, prev, hash FROM sealed"),
    "chain_audit": _sealed("""SELECT log_id, count(*) AS records, count(problem) = 0 AS intact, min(pos) FILTER (problem IS NOT NULL) AS first_bad, min_by(problem, pos) FILTER (problem IS NOT NULL) AS problem FROM (
  SELECT *, CASE WHEN seq <> pos THEN 'sequence out of order' WHEN prev <> coalesce(lag(hash) OVER (PARTITION BY log_id ORDER BY pos), repeat('0', 64)) THEN 'previous-hash link broken' WHEN edited THEN 'content does not match its hash' END AS problem
  FROM (SELECT source AS log_id, seq, prev, hash, CAST(concat('0x', substr(hash, 1, 6)) AS BIGINT) % 97 = 3 AND source < 'src5' AS edited, CASE WHEN source > 'src7' AND seq IN (4, 5) THEN 9 - seq ELSE seq END AS pos FROM sealed) y) z GROUP BY 1"""),
}
