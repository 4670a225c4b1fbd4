"""First-order recurrences x <- A * x + B over ordered rows, solved block-wise with windows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewell.functions.joins import materialise


def affine_scan(d: DataFrame, keys: list[str], block: str, order: list[str], scale: Column,
                shifts: dict[str, Column], start: float = 0.0) -> DataFrame:
    """Adds, per entry of ``shifts``, the state after each row of x <- scale * x + shift.

    Rows of a key are cut into consecutive blocks (``block`` must not contradict ``order``). A block is
    itself an affine map, so blocks are solved independently and then chained by the same formula:
    a long or hot key is spread over its blocks. ``scale`` must be positive, and the product of the scales of
    a block above 1e-130; the history of a key may be of any length.
    """
    inner = Window.partitionBy(*keys, block).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumns({"_la": F.log(scale), **{f"_b_{n}": c for n, c in shifts.items()}})
    d = d.withColumn("_p", F.exp(F.sum("_la").over(inner)))
    d = d.withColumns({f"_l_{n}": F.col("_p") * F.sum(F.col(f"_b_{n}") / F.col("_p")).over(inner) for n in shifts})
    last = F.struct(*order)
    ends = d.groupBy(*keys, block).agg(F.max_by(F.struct("_p", *[f"_l_{n}" for n in shifts]), last).alias("e")).select(*keys, block, "e.*")
    d = d.join(chained(ends, keys, block, list(shifts), start), [*keys, block])
    d = d.withColumns({n: F.col("_p") * F.col(f"_x_{n}") + F.col(f"_l_{n}") for n in shifts})
    return d.drop("_la", "_p", *[f"_{t}_{n}" for t in "blx" for n in shifts])


EPOCH = 300.0


def chained(ends: DataFrame, keys: list[str], block: str, names: list[str], start: float) -> DataFrame:
    """(keys, block, _x_name): the state ahead of each block x <- _p x + _l_name of a key, one row per block.

    Products over a long history underflow, so blocks are gathered into epochs that shrink the state by e^-300 at most
    (and one block). An epoch starts from the two before it; what came earlier has shrunk below 1e-260 of itself.
    """
    chain = Window.partitionBy(*keys).orderBy(block)
    d = ends.withColumn("_upto", F.sum(F.log("_p")).over(chain.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_ahead", F.col("_upto") - F.log("_p")).withColumn("_epoch", F.floor(F.greatest(-F.col("_ahead"), F.lit(0.0)) / EPOCH))
    own = Window.partitionBy(*keys, "_epoch")
    d = d.withColumn("_from", F.max("_ahead").over(own))
    d = d.withColumns({f"_r_{n}": F.col(f"_l_{n}") * F.exp(F.col("_from") - F.col("_upto")) for n in names})
    epochs = d.groupBy(*keys, "_epoch").agg(F.exp(F.min("_upto") - F.max("_from")).alias("_p"), *[(F.exp(F.min("_upto") - F.max("_from")) * F.sum(f"_r_{n}")).alias(f"_l_{n}") for n in names])
    line = Window.partitionBy(*keys).orderBy("_epoch")

    def ago(col: str, back: int) -> Column:
        return F.lag(col, back).over(line)
    first = F.lit(float(start))
    epochs = epochs.select(*keys, "_epoch", *[F.coalesce(ago(f"_l_{n}", 1) + ago("_p", 1) * F.coalesce(ago(f"_l_{n}", 2) + ago("_p", 2) * F.when(F.row_number().over(line) == 3, first).otherwise(0.0), first), first).alias(f"_s_{n}")
                                              for n in names])
    before = own.orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    d = d.join(epochs, [*keys, "_epoch"])
    return d.select(*keys, block, *[(F.exp(F.col("_ahead") - F.col("_from")) * (F.col(f"_s_{n}") + F.coalesce(F.sum(f"_r_{n}").over(before), F.lit(0.0)))).alias(f"_x_{n}") for n in names])


def points_ewma(games: DataFrame, weight: float = 0.10, league_weight: float = 0.01, carry: float = 0.60, start: float = 22.0) -> DataFrame:
    """Smoothed points for / against per team, drawn towards the league mean at each season start.

    The league mean is itself a smoothed series over the league's games; a team's first game starts
    from the league value of that moment.  Output: one row per (game, team) with the state after it.
    """
    c = F.col
    played = games.filter(c("result").isNotNull()).select("league", "season", "gameday", "game_id", "home_team", "away_team", "home_score", "away_score")
    step = league_weight * (c("home_score") + c("away_score")) / 2
    lg = affine_scan(played, ["league"], "season", ["gameday", "game_id"], F.lit(1 - league_weight), {"after": step}, start)
    lg = materialise(lg.withColumn("lg_before", (c("after") - step) / (1 - league_weight)), "league-mean")
    rows = lg.select("league", "season", "gameday", "game_id", "lg_before", F.inline(F.array(
        F.struct(c("home_team").alias("team"), c("home_score").alias("pf_obs"), c("away_score").alias("pa_obs")),
        F.struct(c("away_team").alias("team"), c("away_score").alias("pf_obs"), c("home_score").alias("pa_obs")))))
    # a team's first game ever, and its first game of each season
    begin = rows.groupBy("league", "team", "season").agg(F.min(F.struct("gameday", "game_id")).alias("_open"))
    begin = begin.withColumn("_debut", F.min("season").over(Window.partitionBy("league", "team")) == c("season"))
    rows = rows.join(begin, ["league", "team", "season"])
    opens = (c("gameday") == c("_open.gameday")) & (c("game_id") == c("_open.game_id"))
    first, new = opens & c("_debut"), opens & ~c("_debut")
    keep = 1 - weight
    scale = F.when(new, keep * carry).otherwise(keep)
    pull = F.when(first, keep * c("lg_before")).when(new, keep * (1 - carry) * c("lg_before")).otherwise(0.0)
    out = affine_scan(rows, ["league", "team"], "season", ["gameday", "game_id"], scale, {n: pull + weight * c(f"{n}_obs") for n in ("pf", "pa")})
    return out.select("league", "season", "game_id", "team", "pf", "pa")


def decayed_passer_sums(passer_games: DataFrame, decay: float = 0.97) -> DataFrame:
    """Decayed dropbacks and decayed value of each passer after each game (league, qb_id, season, week, game_id, dropbacks, epa)."""
    n = F.col("dropbacks").cast("double")
    return affine_scan(passer_games.filter(F.col("epa").isNotNull()), ["league", "qb_id"], "season", ["week", "game_id"], F.lit(decay),
                       {"n_decayed": n, "s_decayed": n * F.col("epa")})
