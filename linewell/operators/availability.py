"""Snap shares, line continuity, injury reports and starter availability."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewell.functions.joins import materialise


LINE_POSITIONS = ("T", "G", "C", "OL", "OT", "OG")     # fixed values
OUT = ("Out", "Doubtful")
UNSURE = ("Out", "Doubtful", "Questionable")
NEUTRAL_CONTINUITY = 0.96      # fixed value: continuity assumed for a team without a previous game
TEAM = ["league", "season", "team"]
PREVIOUS = 4


def crosswalk_map(crosswalk: DataFrame) -> DataFrame:
    """gsis_id -> pfr_id; rows with a missing id are ignored, the last row of an id wins."""
    return crosswalk.dropna(subset=["gsis_id", "pfr_id"]).groupBy("gsis_id").agg(F.max_by("pfr_id", "row_no").alias("pfr_id"))


def player_games(snaps: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """Per team game and player: snap shares (``off``, ``dfn``) and line snaps summed over the previous (up to 4) team games.

    game_no counts a team's games of a season from 1; ``before`` counts the rows summed, ``last_line`` are the line snaps of the game
    before. Each snap row is sent to its own and the next 4 games of its team; all keys start with the team's season, so one
    shuffle serves every step. listed (TEAM, week, pfr_player_id, times) travels along and gives ``times`` of a player's week.
    """
    c = F.col
    rows = snaps.select(*TEAM, "week", "game_id", "pfr_player_id", "offense_pct", "defense_pct", F.when(c("position").isin(*LINE_POSITIONS), c("offense_snaps")).alias("line"),
                        F.lit(None).cast("bigint").alias("times")).dropna(subset=[*TEAM, "game_id"])
    if listed is not None:
        rows = rows.unionByName(listed.dropna(subset=[*TEAM, "week", "pfr_player_id"]), allowMissingColumns=True)
    is_game = c("game_id").isNotNull()
    rows = rows.withColumn("no", F.dense_rank().over(Window.partitionBy(*TEAM).orderBy(~is_game, "week", "game_id")))
    ahead = rows.withColumn("back", F.explode(F.when(is_game, F.sequence(F.lit(0), F.lit(PREVIOUS))).otherwise(F.array(F.lit(None).cast("int")))))
    now, past = c("back") == 0, c("back") > 0
    s = (ahead.groupBy(*TEAM, (c("no") + c("back")).alias("game_no"), F.when(~is_game, c("week")).alias("report"), "pfr_player_id")
         .agg(F.max(F.when(now, F.struct("week", "game_id"))).alias("own"), F.count_if(past).alias("before"), F.sum(F.when(past, c("offense_pct"))).alias("off"),
              F.sum(F.when(past, c("defense_pct"))).alias("dfn"), F.sum(F.when(past, c("line"))).alias("line_snaps"),
              F.sum(F.when(c("back") == 1, c("line"))).alias("last_line"), F.sum("times").alias("times")))
    game = Window.partitionBy(*TEAM, "game_no")
    s = s.withColumn("rk", F.row_number().over(game.orderBy(F.desc_nulls_last("line_snaps"), "pfr_player_id"))).withColumn("game", F.max("own").over(game))
    s = s.filter("game is not null or report is not null").withColumn("week", F.coalesce("report", "game.week"))
    if listed is not None:
        s = s.withColumn("times", F.max("times").over(Window.partitionBy(*TEAM, "week", "pfr_player_id"))).filter("report is null")
    n = F.least(c("game_no") - 1, F.lit(PREVIOUS))
    return s.select(*TEAM, c("game.game_id").alias("game_id"), "week", "game_no", "pfr_player_id", "before", (c("off") / n).alias("exp_off"),
                    (c("dfn") / n).alias("exp_def"), "line_snaps", "last_line", "rk", "times")


def expected_shares(snaps: DataFrame) -> DataFrame:
    """Per team game and player: snap shares summed over the previous (up to 4) team games, per game."""
    return player_games(snaps).filter("before > 0").select(*TEAM, "game_id", "week", "game_no", "pfr_player_id", "exp_off", "exp_def", "line_snaps")


def listed_out(injuries: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Players ruled out or doubtful (starting passers aside) under their snap-feed id."""
    i = injuries.filter(F.col("report_status").isin(*OUT) & (F.col("position") != "QB"))
    return (i.join(crosswalk_map(crosswalk), "gsis_id").select(*TEAM, "week", F.col("pfr_id").alias("pfr_player_id")))


def continuity() -> Column:
    """Of a team game's players: share of the last game's line snaps taken by the 5 linemen with most snaps over the window; null without any."""
    total = F.sum("last_line")
    return F.when(total > 0, F.sum(F.when(F.col("rk") <= 5, F.col("last_line")).otherwise(0.0)) / total)


def line_continuity(snaps: DataFrame) -> DataFrame:
    """Continuity of the line per team game with line snaps in the game before."""
    return player_games(snaps).groupBy(*TEAM, "game_id").agg(continuity().alias("olc")).filter("olc is not null")


def team_game_availability(snaps: DataFrame, injuries: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """One row per (game, team): avail_off, avail_def (expected shares of listed players, 0 without history), olc (null without history)."""
    listed = listed_out(injuries, crosswalk).groupBy(*TEAM, "week", "pfr_player_id").agg(F.count("*").alias("times"))
    hit, c = F.col("before") > 0, F.col
    d = (player_games(snaps, listed).groupBy(*TEAM, "game_id")
            .agg(F.coalesce(F.sum(F.when(hit, c("exp_off") * c("times"))), F.lit(0.0)).alias("avail_off"),
                 F.coalesce(F.sum(F.when(hit, c("exp_def") * c("times"))), F.lit(0.0)).alias("avail_def"), continuity().alias("olc"))
            .select("game_id", "team", "avail_off", "avail_def", "olc"))
    return materialise(d, "availability")      # read once per side of a game


def availability_features(games: DataFrame, table: DataFrame) -> DataFrame:
    """Game features from both teams' rows: differences for the margin, sums for the total."""
    def side(name):
        return table.select("game_id", F.col("team").alias(f"{name}_team"), F.col("avail_off").alias(f"{name}_off"),
                            F.col("avail_def").alias(f"{name}_def"), F.col("olc").alias(f"{name}_olc"))
    d = games.join(side("home"), ["game_id", "home_team"], "left").join(side("away"), ["game_id", "away_team"], "left")
    zero, neutral = F.lit(0.0), F.lit(NEUTRAL_CONTINUITY)
    ho, ao = F.coalesce("home_off", zero), F.coalesce("away_off", zero)
    hd, ad = F.coalesce("home_def", zero), F.coalesce("away_def", zero)
    hl, al = F.coalesce("home_olc", neutral), F.coalesce("away_olc", neutral)
    return (d.withColumns({"f_avail": (ao + ad) - (ho + hd), "t_avail": ho + ao, "f_olc": hl - al,
                           "t_olc": hl + al - 2 * NEUTRAL_CONTINUITY})
            .drop("home_off", "home_def", "away_off", "away_def", "home_olc", "away_olc"))


# ---------------------------------------------------------------- injury reports

def latest_reports(team_weeks: DataFrame, injuries: DataFrame) -> DataFrame:
    """Per (league, season, team, week) asked for: the latest report week at or before it.

    The as-of step is one window over report weeks and asked weeks together (last report week so far),
    not a range join.
    """
    by_week = injuries.groupBy(*TEAM, "week").agg(F.max(F.col("report_status").isNotNull()).alias("issued"))
    asked = team_weeks.select(*TEAM, "week").distinct().withColumn("asked", F.lit(True))
    both = by_week.withColumn("report_week", F.col("week")).join(asked, [*TEAM, "week"], "full_outer")
    w = Window.partitionBy(*TEAM).orderBy("week").rowsBetween(Window.unboundedPreceding, 0)
    last = both.withColumn("wk", F.last("report_week", ignorenulls=True).over(w)).withColumn("iss", F.last("issued", ignorenulls=True).over(w))
    return last.filter("asked").select(*TEAM, "week", F.col("wk").alias("report_week"), F.col("iss").alias("issued"),
                                       (F.col("wk") != F.col("week")).alias("stale"))


def injury_lines(team_weeks: DataFrame, injuries: DataFrame) -> DataFrame:
    """Latest report with its player lines: designations once issued, missed practices before that."""
    rep = latest_reports(team_weeks, injuries)
    who = F.concat("full_name", F.lit(" ("), "position", F.lit(") "))
    listed = F.when(F.col("report_status").isin(*UNSURE), F.concat(who, "report_status", F.coalesce(F.concat(F.lit(" - "), "report_primary_injury"), F.lit(""))))
    dnp = F.when(F.col("practice_status").startswith("Did Not"), F.concat(who, F.lit("did not practice"), F.coalesce(F.concat(F.lit(" - "), "practice_primary_injury"), F.lit(""))))
    rows = injuries.select(*TEAM, F.col("week").alias("report_week"), listed.alias("listed"), dnp.alias("dnp"))
    lines = rows.groupBy(*TEAM, "report_week").agg(F.array_join(F.array_sort(F.collect_list("listed")), "; ").alias("listed"),
                                                   F.array_join(F.array_sort(F.collect_list("dnp")), "; ").alias("dnp"))
    return (rep.join(lines, [*TEAM, "report_week"], "left")
            .select(*TEAM, "week", "report_week", "issued", "stale", F.when(F.col("issued"), F.col("listed")).otherwise(F.col("dnp")).alias("lines")))


def starter_availability(starters: DataFrame, injuries: DataFrame) -> DataFrame:
    """State of each projected starter from the report of exactly that week.

    starters: league, season, week, team, qb_id. Adds ``state`` (available, ruled_out, questionable,
    unknown) and ``detail``. Missing data never counts as healthy.
    """
    team_week = injuries.groupBy(*TEAM, "week").agg(F.max(F.col("report_status").isNotNull()).alias("issued"))
    mine = (injuries.groupBy(*TEAM, "week", F.col("gsis_id").alias("qb_id"))
            .agg(F.max_by("report_status", F.when(F.col("report_status").isNotNull(), F.col("row_no"))).alias("status"),
                 F.max_by("practice_status", F.when(F.col("practice_status").isNotNull(), F.col("row_no"))).alias("practice")))
    d = starters.join(team_week, [*TEAM, "week"], "left").join(mine, [*TEAM, "week", "qb_id"], "left")
    s, p = F.col("status"), F.col("practice")
    state = (F.when(F.col("qb_id").isNull() | F.col("issued").isNull(), "unknown").when(s.isin(*OUT), "ruled_out")
             .when(s == "Questionable", "questionable").when(F.col("issued"), "available").otherwise("unknown"))

    def note(text: str, tail: Column) -> Column:
        return F.concat(F.lit(text), tail)
    practice = F.coalesce(F.concat(F.lit(" (practice: "), p, F.lit(")")), F.lit(""))
    detail = (F.when(F.col("qb_id").isNull(), "projected starter not listed")
              .when(F.col("issued").isNull(), F.concat(F.lit("no week "), F.col("week").cast("string"), F.lit(" injury report for "), "team", F.lit(" in the feed yet")))
              .when(s.isin(*OUT), note("listed ", s))
              .when(s == "Questionable", F.concat(F.lit("listed Questionable (practice: "), F.coalesce(p, F.lit("n/a")), F.lit(")")))
              .when(F.col("issued"), note("no game-status designation on the final report", practice))
              .otherwise(note("game statuses not issued yet", F.coalesce(F.concat(F.lit("; practice: "), p), F.lit("; not on the practice report")))))
    return d.withColumn("state", state).withColumn("detail", detail)
