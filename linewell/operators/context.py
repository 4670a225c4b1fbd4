"""Decision context per game: facts, assumptions, missing inputs, conditions, blocks and risks."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewell.functions.joins import lookup, materialise
from linewell.operators import availability
from linewell.texts import text

TEAM = availability.TEAM


def _list(*items: Column) -> Column:
    return F.array_compact(F.array(*[i.cast("string") for i in items]))


def _cat(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def starter_rows(games: DataFrame) -> DataFrame:
    """Two rows per game: each side's projected starter (qb_id as in the injury feed)."""
    def side(s):
        return F.struct(F.lit(s).alias("side"), F.col(f"{s}_team").alias("team"), F.col(f"{s}_qb_id").alias("qb_id"), F.col(f"{s}_qb_name").alias("qb_name"),
                        F.col(f"{s}_qb_delta").alias("delta"))
    return games.select("game_id", "league", "season", "week", F.inline(F.array(side("away"), side("home"))))


def apply_overrides(games: DataFrame, accepted: DataFrame, names: DataFrame, ratings: DataFrame) -> DataFrame:
    """Replaces a side's projected starter by the confirmed one and recomputes its rating change and f_qb.

    accepted: game_id, team, qb_name; names: league, qb_name, qb_id (one row per name);
    ratings: league, qb_id, rating, prior. An unknown name takes the prior.
    """
    prior = ratings.groupBy("league").agg(F.max("prior").alias("_prior"))
    d = games.join(prior, "league", "left")
    for s in ("home", "away"):
        o = accepted.select("game_id", F.col("team").alias(f"{s}_team"), F.col("qb_name").alias("_name"))
        n = names.select("league", F.col("qb_name").alias("_name"), F.col("qb_id").alias("_id"))
        r = ratings.select("league", F.col("qb_id").alias("_id"), F.col("rating").alias("_rate"))
        d = d.join(o, ["game_id", f"{s}_team"], "left").join(n, ["league", "_name"], "left").join(r, ["league", "_id"], "left")
        on = F.col("_name").isNotNull()
        rating = F.coalesce("_rate", "_prior")
        d = d.withColumns({
            f"{s}_qb_id": F.when(on, F.coalesce("_id", _cat("unknown:", F.col("_name")))).otherwise(F.col(f"{s}_qb_id")),
            f"{s}_qb_name": F.when(on, F.col("_name")).otherwise(F.col(f"{s}_qb_name")),
            f"{s}_qb_delta": F.when(on, rating - F.coalesce(f"{s}_qb_base", rating)).otherwise(F.col(f"{s}_qb_delta")),
            f"{s}_qb_rating": F.when(on, rating).otherwise(F.col(f"{s}_qb_rating")), f"{s}_confirmed": on}).drop("_name", "_id", "_rate")
    return d.drop("_prior").withColumn("f_qb", F.coalesce("home_qb_delta", F.lit(0.0)) - F.coalesce("away_qb_delta", F.lit(0.0)))


def build_contexts(preds: DataFrame, injuries: DataFrame, weather: DataFrame, settings, starter_id=lambda c: c) -> DataFrame:
    """One row per predicted game with the six context lists.

    preds: predictions with league, week, teams, starters, roof, rest days and (optionally) home/away_confirmed;
    weather: accepted forecasts (game_id, wind, temp, source). ``starter_id`` maps starter ids to the injury feed's.
    """
    for s in ("home_confirmed", "away_confirmed"):
        if s not in preds.columns:
            preds = preds.withColumn(s, F.lit(False))
    c = F.col
    # only the reports of teams on the slate matter; they are read three times below
    teams = preds.select("league", "season", F.explode(F.array("away_team", "home_team")).alias("team")).distinct()
    injuries = materialise(lookup(injuries, teams, TEAM, "left_semi"), "reports")
    st = availability.starter_availability(starter_rows(preds).withColumn("qb_id", starter_id(c("qb_id"))), injuries)
    st = st.join(preds.select("game_id", "home_confirmed", "away_confirmed"), "game_id")
    confirmed = F.when(c("side") == "home", c("home_confirmed")).otherwise(c("away_confirmed"))
    nobody = c("qb_id").isNull() & ~confirmed
    out = c("state").isin("ruled_out", "questionable")
    blocks = F.when(nobody, text("starter_unnamed", c("team"))).when(~confirmed & out, text(
        "starter_doubtful", c("team"), c("qb_name"), F.replace("detail", F.lit("listed "), F.lit(""))))
    conds = F.when(~nobody & ~confirmed & (c("state") == "unknown"), text("starter_condition", c("qb_name"), c("team")))
    missing = F.when(nobody, text("starter_missing", c("team"))).when(c("state") == "unknown", text("starter_unclear", c("qb_name"), c("team"), c("detail")))
    facts = F.when(~nobody & (c("state") != "unknown"), text("starter_fact", c("qb_name"), c("detail")))
    same = F.abs("delta") < 0.02
    assume = F.when(~nobody, F.when(F.coalesce(same, F.lit(True)), text("starter_usual", c("team"), c("qb_name")))
                    .otherwise(text("starter_other", c("team"), c("qb_name"))))

    def two(x):      # two starters per game, away first
        return F.transform(F.array_sort(F.collect_list(F.when(x.isNotNull(), F.struct("side", x.alias("t"))))), lambda r: r["t"])
    per_game = st.groupBy("game_id").agg(two(blocks).alias("_block"), two(conds).alias("conditions"), two(missing).alias("_missing"), two(facts).alias("_facts"), two(assume).alias("_assume"))
    weeks = preds.select("league", "season", "week", "game_id", F.explode(F.array("away_team", "home_team")).alias("team"))
    inj = weeks.join(availability.injury_lines(weeks, injuries), [*TEAM, "week"], "left")
    body = F.when(c("issued"), F.when(F.coalesce("lines", F.lit("")) == "", text("report_clear")).otherwise(c("lines"))).otherwise(
        F.concat(text("report_practice"), F.when(F.coalesce("lines", F.lit("")) != "", text("report_absent", c("lines"))).otherwise("")))
    fact = F.when(c("report_week").isNotNull(), text("report", c("team"), c("report_week").cast("string"), F.when(c("stale"), text("report_old")).otherwise(""), body))
    lack = (F.when(c("report_week").isNull(), text("report_none", c("team"))).when(c("stale"), text("report_late", c("team"), c("week").cast("string")))
            .when(~c("issued"), text("report_unissued", c("team"), c("week").cast("string"))))
    inj = inj.groupBy("game_id").agg(F.array_sort(F.collect_list(fact)).alias("_ifacts"), F.array_sort(F.collect_list(lack)).alias("_imissing"))
    w = weather.select("game_id", F.col("wind").alias("_wind"), F.col("temp").alias("_temp"), F.col("source").alias("_wsrc"))
    d = preds.join(per_game, "game_id", "left").join(inj, "game_id", "left").join(w, "game_id", "left")
    roof_ok = F.coalesce(c("roof").isin("dome", "closed"), F.lit(False))
    has_w = c("_wind").isNotNull()
    gap, tgap = F.abs(c("model_margin") - c("spread_line")), F.abs(c("model_total") - c("total_line"))
    g = settings.gap_points
    m_gap = F.when(gap >= g, text("margin_gap", F.format_string("%.1f", gap), F.lit(f"{g:g}")))
    t_gap = F.when(tgap >= g, text("total_gap", F.format_string("%.1f", tgap), F.lit(f"{g:g}")))
    dry = F.when(~has_w & ~roof_ok, text("no_weather"))
    none = F.array().cast("array<string>")
    qb = F.coalesce("_block", none)
    return d.select(
        "game_id", F.concat(_list(text("venue", F.coalesce("roof", text("venue_unknown")), c("away_team"), F.format_string("%.0f", "away_rest"), c("home_team"), F.format_string("%.0f", "home_rest"))),
                            F.coalesce("_facts", none), F.coalesce("_ifacts", none),
                            _list(F.when(has_w, text("weather", F.format_string("%.0f", "_wind"), F.format_string("%.0f", "_temp"), F.coalesce("_wsrc", F.lit("")))))).alias("facts"),
        F.concat(F.coalesce("_assume", none), _list(text("assume_market"),
                                                    F.when(has_w, text("assume_weather")))).alias("assumptions"),
        F.concat(F.coalesce("_missing", none), F.coalesce("_imissing", none), _list(F.when(~has_w & ~roof_ok, F.when(c("roof").isNull(), text("missing_roof")).otherwise(text("missing_weather"))))).alias("missing"),
        F.coalesce("conditions", none).alias("conditions"), F.concat(qb, _list(m_gap)).alias("block_spread"), F.concat(qb, _list(m_gap)).alias("block_ml"),
        F.concat(qb, _list(dry, t_gap)).alias("block_total"),
        _list(F.when(c("week") <= 4, text("risk_early", c("week").cast("string")))).alias("risks"))


def top_drivers(preds: DataFrame, contributions: dict[str, Column], k: int = 4, least: float = 0.1) -> DataFrame:
    """The k largest contributions per game (at least ``least`` points); a handful of rows per game."""
    rows = F.array(*[F.struct(F.lit(n).alias("driver"), v.alias("points")) for n, v in contributions.items()])
    ordered = F.array_sort(F.filter(F.transform(rows, lambda r: F.struct((-F.abs(r["points"])).alias("o"), r["driver"].alias("driver"), r["points"].alias("points"))),
                                    lambda r: r["o"].isNotNull()))
    top = F.filter(F.slice(ordered, 1, k), lambda r: -r["o"] >= least)
    return preds.select("game_id", F.inline(F.transform(top, lambda r: F.struct(r["driver"].alias("driver"), r["points"].alias("points")))))


def bet_label(team: Column, market: Column, point: Column) -> Column:
    number = F.regexp_replace(point.cast("string"), r"\.0$", "")
    return (F.when(market == "spread", _cat(team, " ", F.when(point >= 0, "+").otherwise(""), number)).when(market == "ml", _cat(team, " ML")).otherwise(_cat(team, " ", number)))


def line_label(home: Column, away: Column, margin: Column) -> Column:
    return (F.when(margin.isNull(), "n/a").when(F.abs(margin) < 0.25, "PK")
            .otherwise(F.concat(F.when(margin > 0, home).otherwise(away), F.lit(" -"), F.format_string("%.1f", F.abs(margin)))))
