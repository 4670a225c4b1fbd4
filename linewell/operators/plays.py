"""Play-level aggregation: team-game efficiency, neutral pace, passer games."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Codes of relocated or renamed teams -> current code.
RELOCATED = {"OAK": "LV", "SD": "LAC", "STL": "LA", "LAR": "LA", "JAC": "JAX", "WSH": "WAS"}
KEYS = ["game_id", "season", "week"]


def current_code(team: Column) -> Column:
    codes = F.create_map(*[F.lit(x) for kv in RELOCATED.items() for x in kv])
    return F.coalesce(F.try_element_at(codes, team), team)


def scrimmage(plays: DataFrame) -> DataFrame:
    """Passes and runs with a value, current team codes."""
    return (plays.filter(F.col("play_type").isin("pass", "run") & F.col("epa").isNotNull())
            .withColumns({"posteam": current_code(F.col("posteam")), "defteam": current_code(F.col("defteam"))}))


def competitive() -> Column:
    return (F.col("wp") > 0.05) & (F.col("wp") < 0.95)


def with_snap_gap(plays: DataFrame) -> DataFrame:
    """Seconds since the previous snap of the same game and drive (clock runs down).

    The window spans the whole game, so that aggregates by game above it need no shuffle of their own.
    """
    w = Window.partitionBy("game_id").orderBy("drive", F.desc("game_seconds_remaining"), "play_id")
    same = F.lag("drive").over(w).eqNullSafe(F.col("drive"))
    return plays.withColumn("gap", F.when(same, F.lag("game_seconds_remaining").over(w) - F.col("game_seconds_remaining")))


def neutral_state() -> Column:
    """Quarters 1-3, within a touchdown, outside the last two minutes of a half."""
    return (F.col("qtr") <= 3) & (F.abs("score_differential") <= 7) & (F.col("half_seconds_remaining") > 120)


def neutral_snap() -> Column:
    """A snap in a neutral state (``neutral``) with a plausible gap."""
    return F.col("neutral") & (F.col("gap") > 0) & (F.col("gap") <= 60)


def timed_snaps(plays: DataFrame) -> DataFrame:
    """Scrimmage plays with their gap; what is known ahead of the gap is shipped as flags."""
    return with_snap_gap(scrimmage(plays).select(
        *KEYS, "posteam", "defteam", "drive", "game_seconds_remaining", "play_id", "epa", "success", competitive().alias("comp"),
        (F.col("qb_dropback") == 1).alias("dropback"), (F.col("play_type") == "run").alias("run"), neutral_state().alias("neutral")))


def team_games(plays: DataFrame) -> DataFrame:
    """One row per (game, offense) in a single aggregation; it exists only with a competitive play."""
    d = timed_snaps(plays)
    comp, neutral, epa = F.col("comp"), neutral_snap(), F.col("epa")
    return (d.groupBy(*KEYS, F.col("posteam").alias("team"), F.col("defteam").alias("opp"))
            .agg(F.avg(F.when(comp, epa)).alias("epa"), F.avg(F.when(comp, F.col("success"))).alias("sr"),
                 F.avg(F.when(comp & F.col("dropback"), epa)).alias("pass_epa"),
                 F.avg(F.when(comp & F.col("run"), epa)).alias("rush_epa"),
                 F.count("*").alias("plays"), F.avg(F.when(neutral, F.col("gap"))).alias("neutral_spp"),
                 F.count_if(neutral).alias("neutral_n"), F.count_if(comp).alias("_comp"))
            .filter("_comp > 0").drop("_comp"))


def neutral_pace(plays: DataFrame) -> DataFrame:
    d = timed_snaps(plays).filter(neutral_snap())
    return (d.groupBy(*KEYS, F.col("posteam").alias("team"), F.col("defteam").alias("opp"))
            .agg(F.avg("gap").alias("neutral_spp"), F.count("*").alias("neutral_n")))


def passer_games(plays: DataFrame) -> DataFrame:
    """Dropbacks and value per dropback for each passer and game, competitive plays only."""
    d = plays.filter((F.col("qb_dropback") == 1) & F.col("epa").isNotNull() & F.col("passer_player_id").isNotNull() & competitive())
    return (d.groupBy(*KEYS, current_code(F.col("posteam")).alias("team"), F.col("passer_player_id").alias("qb_id"))
            .agg(F.count("*").alias("dropbacks"), F.avg("epa").alias("epa"), F.min_by("passer_player_name", "play_id").alias("name")))
