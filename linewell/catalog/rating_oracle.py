"""SQL of the sequential ratings: a recursion over the games of each league with all teams' ratings as lists, then the passers.

``b`` of a list is the place of a measure times the number of teams, ``k`` the team. Used by the oracles of the rating queries.
"""
from __future__ import annotations

from linewell.operators.plays import RELOCATED

_CODE = "CASE posteam " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in RELOCATED.items()) + " ELSE posteam END"

# one row per (game, offence): the same aggregates as ``plays.team_games``, from the play view
SIDES = f"""sc AS (SELECT *, {_CODE} AS team, lag(game_seconds_remaining) OVER (PARTITION BY game_id, drive ORDER BY game_seconds_remaining DESC, play_id) - game_seconds_remaining AS gap
  FROM plays WHERE play_type IN ('pass', 'run') AND epa IS NOT NULL),
sd AS (SELECT game_id, team, avg(epa) FILTER (c) AS epa, avg(success) FILTER (c) AS sr, avg(epa) FILTER (c AND qb_dropback = 1) AS pass_epa, avg(epa) FILTER (c AND play_type = 'run') AS rush_epa,
    count(*)::DOUBLE AS plays, avg(gap) FILTER (qtr <= 3 AND abs(score_differential) <= 7 AND half_seconds_remaining > 120 AND gap > 0 AND gap <= 60) AS pace
  FROM (SELECT *, wp > 0.05 AND wp < 0.95 AS c FROM sc) z GROUP BY 1, 2 HAVING count(*) FILTER (c) > 0),
tn AS (SELECT league, team, row_number() OVER (PARTITION BY league ORDER BY team) AS k, count(*) OVER (PARTITION BY league) AS t
  FROM (SELECT league, home_team AS team FROM games UNION SELECT league, away_team FROM games) z),
gm AS MATERIALIZED (SELECT g.league, row_number() OVER (PARTITION BY g.league ORDER BY gameday, g.game_id) AS no, g.game_id, season, home_team, away_team, home_qb_id, away_qb_id, h.k AS h, a.k AS a, h.t AS t,
    result AS res, CASE WHEN location = 'Neutral' THEN 0e0 ELSE 1.7e0 END AS edge, home_score AS hs, away_score AS vs, result IS NOT NULL AND x.team IS NOT NULL AND y.team IS NOT NULL AS two,
    [x.epa, x.sr, x.pass_epa, x.rush_epa] AS xh, [y.epa, y.sr, y.pass_epa, y.rush_epa] AS xa, x.plays AS nh, y.plays AS na, x.pace AS ch, y.pace AS ca
  FROM games g JOIN tn h ON h.league = g.league AND h.team = home_team JOIN tn a ON a.league = g.league AND a.team = away_team
  LEFT JOIN sd x ON x.game_id = g.game_id AND x.team = home_team LEFT JOIN sd y ON y.game_id = g.game_id AND y.team = away_team)"""


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _open(state: str) -> str:
    """The season starts of game ``n`` on the state after the game ahead of it."""
    def each(col: str, fresh: str, carried: str) -> str:
        return f"list_transform(range(1, t + 1), lambda k: CASE WHEN k NOT IN (h, a) OR se[k] = season THEN {col}[k] WHEN se[k] IS NULL THEN {fresh} ELSE {carried} END) AS {col}"
    measure = "((i - 1) % t + 1)"
    form = ", ".join(f"list_transform(range(1, 4 * t + 1), lambda i: CASE WHEN {measure} IN (h, a) AND se[{measure}] IS NOT NULL AND se[{measure}] <> season THEN 0.6e0 * {c}[i] ELSE {c}[i] END) AS {c}" for c in ("o", "d"))
    return f"""SELECT league, no, {each('m', '0e0', '0.6e0 * m[k]')}, {form}, {each('pl', 'lg[5]', 'lg[5] + 0.6e0 * (pl[k] - lg[5])')}, {each('pf', 'lg[6]', 'lg[6] + 0.6e0 * (pf[k] - lg[6])')},
  {each('pa', 'lg[6]', 'lg[6] + 0.6e0 * (pa[k] - lg[6])')}, {each('pc', '32.5e0', 'pc[k]')}, list_transform(range(1, t + 1), lambda k: CASE WHEN k IN (h, a) THEN season ELSE se[k] END) AS se, lg FROM ({state}) z"""


_ZEROS = "list_transform(range(1, {n} + 1), lambda k: 0e0)"
_FIRST = f"""SELECT league, no, h, a, t, season, {_ZEROS.format(n='t')} AS m, {_ZEROS.format(n='4 * t')} AS o, {_ZEROS.format(n='4 * t')} AS d, {_ZEROS.format(n='t')} AS pl, {_ZEROS.format(n='t')} AS pf, {_ZEROS.format(n='t')} AS pa,
  {_ZEROS.format(n='t')} AS pc, list_transform(range(1, t + 1), lambda k: NULL::INTEGER) AS se, [0e0, 0.44e0, 0.05e0, -0.08e0, 62e0, 22e0] AS lg FROM gm WHERE no = 1"""
_J, _K = "((i - 1) // c.t + 1)", "((i - 1) % c.t + 1)"


def _form(own: str, other: str, pairs: tuple[tuple[str, str, str], ...]) -> str:
    cases = " ".join(f"WHEN {_K} = c.{k} AND c.{x}[{_J}] IS NOT NULL THEN 0.1e0 * (c.{x}[{_J}] - r.lg[{_J}] - r.{own}[i] - r.{other}[({_J} - 1) * c.t + c.{k2}])" for k, x, k2 in pairs)
    return f"CASE WHEN c.two THEN list_transform(range(1, 4 * c.t + 1), lambda i: r.{own}[i] + CASE {cases} ELSE 0e0 END) ELSE r.{own} END AS {own}"


def _level(col: str, home: str, away: str, when: str) -> str:
    return (f"list_transform(range(1, c.t + 1), lambda k: r.{col}[k] + CASE WHEN NOT ({when}) THEN 0e0 WHEN k = c.h AND {home} IS NOT NULL THEN 0.1e0 * ({home} - r.{col}[k]) "
            f"WHEN k = c.a AND {away} IS NOT NULL THEN 0.1e0 * ({away} - r.{col}[k]) ELSE 0e0 END) AS {col}")


def _applied(more: str, joins: str) -> str:
    """The state after game ``c`` on the row ``r`` ahead of it."""
    gap = "least(greatest(c.res, -24), 24) - (r.m[c.h] - r.m[c.a] + c.edge)"
    return f"""SELECT c.league, {more}, list_transform(range(1, c.t + 1), lambda k: r.m[k] + CASE WHEN c.res IS NULL THEN 0e0 WHEN k = c.h THEN 0.07e0 * ({gap}) WHEN k = c.a THEN -0.07e0 * ({gap}) ELSE 0e0 END) AS m,
  {_form('o', 'd', (('h', 'xh', 'a'), ('a', 'xa', 'h')))}, {_form('d', 'o', (('a', 'xh', 'h'), ('h', 'xa', 'a')))}, {_level('pl', 'c.nh', 'c.na', 'c.two')}, {_level('pf', 'c.hs', 'c.vs', 'c.res IS NOT NULL')},
  {_level('pa', 'c.vs', 'c.hs', 'c.res IS NOT NULL')}, {_level('pc', 'c.ch', 'c.ca', 'c.two')}, r.se AS se,
  list_transform(range(1, 7), lambda j: r.lg[j] + CASE WHEN j < 5 THEN CASE WHEN c.two AND c.xh[j] IS NOT NULL AND c.xa[j] IS NOT NULL THEN 0.01e0 * ((c.xh[j] + c.xa[j]) / 2 - r.lg[j]) ELSE 0e0 END
    WHEN j = 5 THEN CASE WHEN c.two THEN 0.01e0 * ((c.nh + c.na) / 2 - r.lg[j]) ELSE 0e0 END WHEN c.res IS NOT NULL THEN 0.01e0 * ((c.hs + c.vs) / 2 - r.lg[j]) ELSE 0e0 END) AS lg
  FROM st r JOIN gm c ON c.league = r.league AND c.no = r.no {joins}"""


TEAMS = SIDES + f""",
st AS ({_open(_FIRST)} UNION ALL {_open(_applied('n.no, n.h, n.a, n.t, n.season', 'JOIN gm n ON n.league = r.league AND n.no = r.no + 1'))}),
aft AS MATERIALIZED ({_applied('c.no', '')}),
ftr AS (SELECT g.game_id, g.league, g.no, m[h] - m[a] AS f_mrtg, (o[h] - d[h]) - (o[a] - d[a]) AS f_epa, (o[t + h] - d[t + h]) - (o[t + a] - d[t + a]) AS f_sr, (o[2 * t + h] - d[2 * t + h]) - (o[2 * t + a] - d[2 * t + a]) AS f_pass,
    (o[3 * t + h] - d[3 * t + h]) - (o[3 * t + a] - d[3 * t + a]) AS f_rush, pc[h] + pc[a] AS t_npace, o[h] + o[a] AS t_off, d[h] + d[a] AS t_def, pl[h] + pl[a] AS t_pace, (pf[h] + pa[h] + pf[a] + pa[a]) / 2 AS t_pts
  FROM gm g JOIN st ON st.league = g.league AND st.no = g.no)"""

FINAL_TEAMS = """SELECT tn.league, tn.team, round(m[k] + 1e-9, 6) AS points_rating, round(o[k] + 1e-9, 6) AS off_epa, round(d[k] + 1e-9, 6) AS def_epa_allowed, round(o[k] - d[k] + 1e-9, 6) AS net_epa, round(o[2 * t + k] + 1e-9, 6) AS pass_off, round(d[2 * t + k] + 1e-9, 6) AS pass_def,
  round(pl[k] + 1e-9, 6) AS pace, round(pf[k] + 1e-9, 6) AS pts_for, round(pa[k] + 1e-9, 6) AS pts_against FROM tn JOIN (SELECT * FROM aft QUALIFY row_number() OVER (PARTITION BY league ORDER BY no DESC) = 1) z ON z.league = tn.league"""

# key = 3 * no + slot: 0 asks ahead of the game, 1 and 2 are the passers of the home and of the away team
PASSERS = f"""pg AS (SELECT game_id, {_CODE} AS team, passer_player_id AS q, count(*)::DOUBLE AS n, avg(epa) AS epa FROM plays
  WHERE qb_dropback = 1 AND epa IS NOT NULL AND passer_player_id IS NOT NULL AND wp > 0.05 AND wp < 0.95 GROUP BY 1, 2, 3),
th AS MATERIALIZED (SELECT g.league, g.no, 1 AS slot, g.no * 3 + 1 AS key, g.h AS team, q, n, epa - aft.lg[3] - aft.d[2 * t + a] AS v FROM gm g JOIN aft ON aft.league = g.league AND aft.no = g.no JOIN pg ON pg.game_id = g.game_id AND pg.team = home_team WHERE two
  UNION ALL SELECT g.league, g.no, 2, g.no * 3 + 2, g.a, q, n, epa - aft.lg[3] - aft.d[2 * t + h] FROM gm g JOIN aft ON aft.league = g.league AND aft.no = g.no JOIN pg ON pg.game_id = g.game_id AND pg.team = away_team WHERE two),
ix AS MATERIALIZED (SELECT *, row_number() OVER w AS i, sum(n) OVER w - n AS career FROM th WINDOW w AS (PARTITION BY league, q ORDER BY key)),
sm AS MATERIALIZED (SELECT x.league, x.q, x.key, x.i, sum(y.n * pow(0.97, x.i - y.i)) AS w, sum(y.n * y.v * pow(0.97, x.i - y.i)) AS s FROM ix x JOIN ix y ON y.league = x.league AND y.q = x.q AND y.i <= x.i GROUP BY ALL),
pk AS (SELECT league, key, sum(CASE WHEN career < 150 THEN n ELSE 0 END) AS pn, sum(CASE WHEN career < 150 THEN n * v ELSE 0 END) AS pv FROM ix GROUP BY ALL),
pr AS MATERIALIZED (SELECT k.league, k.key, CASE WHEN coalesce(sum(pn) OVER w, 0) > 300 THEN sum(pv) OVER w / sum(pn) OVER w ELSE -0.05 END AS prior
  FROM (SELECT league, unnest([no * 3, no * 3 + 1, no * 3 + 2]) AS key FROM gm) k LEFT JOIN pk ON pk.league = k.league AND pk.key = k.key WINDOW w AS (PARTITION BY k.league ORDER BY k.key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rt AS (SELECT th.*, (coalesce(s, 0) + 150 * prior) / (coalesce(w, 0) + 150) AS rating FROM ix th JOIN pr ON pr.league = th.league AND pr.key = th.key LEFT JOIN sm ON sm.league = th.league AND sm.q = th.q AND sm.i = th.i - 1),
sn AS MATERIALIZED (SELECT league, no, team, sum(n * rating) / sum(n) AS seen, row_number() OVER (PARTITION BY league, team ORDER BY no) AS i FROM rt GROUP BY league, no, team),
ba AS (SELECT league, team, i, no, seen AS base FROM sn WHERE i = 1 UNION ALL SELECT s.league, s.team, s.i, s.no, b.base + 0.2 * (s.seen - b.base) FROM ba b JOIN sn s ON s.league = b.league AND s.team = b.team AND s.i = b.i + 1),
as2 AS (SELECT league, no, h AS team, home_qb_id AS q, 1 AS sign, game_id FROM gm WHERE home_qb_id IS NOT NULL UNION ALL SELECT league, no, a, away_qb_id, -1, game_id FROM gm WHERE away_qb_id IS NOT NULL),
rated AS (SELECT z.*, (coalesce(s, 0) + 150 * prior) / (coalesce(w, 0) + 150) AS rating FROM (SELECT *, no * 3 AS key FROM as2) z JOIN pr ON pr.league = z.league AND pr.key = z.key
  ASOF LEFT JOIN sm ON sm.league = z.league AND sm.q = z.q AND sm.key < z.key),
dl AS (SELECT game_id, sum(sign * coalesce(rating - base, 0)) AS f_qb FROM (SELECT x.*, b.base FROM rated x ASOF LEFT JOIN ba b ON b.league = x.league AND b.team = x.team AND b.no < x.no) z GROUP BY 1)"""

# ---------------------------------------------------------------- walk-forward ridge regressions

_MARGIN = ["f_mrtg", "f_epa", "f_sr", "f_pass", "f_qb", "f_hfa", "f_rest", "f_div"]
_TOTAL = ["t_off", "t_def", "t_pace", "t_pts", "t_dome"]
_MODELS = {"model_margin": (_MARGIN, "result"), "blend_margin": ([*_MARGIN, "spread_line"], "result"), "model_total": (_TOTAL, "total"), "blend_total": ([*_TOTAL, "total_line"], "total")}
_LONG = " UNION ALL ".join(f"SELECT game_id, season, '{m}' AS model, {len(cols)} AS d, [1e0, {', '.join(f'{c}::DOUBLE' for c in cols)}, {y}::DOUBLE] AS v, {y} IS NOT NULL AS done FROM fea WHERE {' AND '.join(f'{c} IS NOT NULL' for c in cols)}"
                           for m, (cols, y) in _MODELS.items())

# v = (1, features, target): sums of its products by season hold all that a fit needs; the equations are solved by elimination, one unknown a step
RIDGE = TEAMS + ",\n" + PASSERS + f""",
fea AS MATERIALIZED (SELECT g.game_id, g.season, result, total, spread_line, total_line, f_mrtg, f_epa, f_sr, f_pass, coalesce(f_qb, 0) AS f_qb, CASE WHEN location = 'Neutral' THEN 0e0 ELSE 1e0 END AS f_hfa,
    least(greatest(coalesce(home_rest, 7) - coalesce(away_rest, 7), -7), 7) AS f_rest, coalesce(div_game, 0.0) AS f_div, t_off, t_def, t_pace, t_pts, CASE WHEN roof IN ('dome', 'closed') THEN 1e0 ELSE 0e0 END AS t_dome
  FROM games g JOIN ftr ON ftr.game_id = g.game_id LEFT JOIN dl ON dl.game_id = g.game_id),
rowv AS MATERIALIZED ({_LONG}),
gram AS (SELECT model, d, season, i, j, sum(v[i] * v[j]) AS s FROM (SELECT *, unnest(range(1, d + 3)) AS i FROM rowv WHERE done AND season > (SELECT min(season) FROM games WHERE result IS NOT NULL)) z, (SELECT unnest(range(1, 12)) AS j) r WHERE j <= d + 2 GROUP BY ALL),
acc AS MATERIALIZED (SELECT t.season, g.model, g.d, i, j, sum(s) AS s, count(*) AS seasons FROM (SELECT DISTINCT season FROM games) t JOIN gram g ON g.season < t.season GROUP BY ALL),
head AS (SELECT season, model, d, s AS n, seasons FROM acc WHERE i = 1 AND j = 1),
cov AS (SELECT a.season, a.model, a.d, a.i, a.j, a.s - x.s * y.s / h.n AS c, h.n FROM acc a JOIN head h ON h.season = a.season AND h.model = a.model JOIN acc x ON x.season = a.season AND x.model = a.model AND x.i = 1 AND x.j = a.i
    JOIN acc y ON y.season = a.season AND y.model = a.model AND y.i = 1 AND y.j = a.j WHERE a.i BETWEEN 2 AND a.d + 1 AND a.j > 1),
sds AS (SELECT season, model, i, CASE WHEN sqrt(greatest(c, 0) / n) < 1e-9 THEN 1e0 ELSE sqrt(greatest(c, 0) / n) END AS sd FROM cov WHERE i = j),
eqs AS (SELECT season, model, d, list(r ORDER BY i) AS m FROM (SELECT c.season, c.model, c.d, c.i, list(c.c / s.sd / coalesce(t.sd, 1) + CASE WHEN c.i = c.j THEN 5 ELSE 0 END ORDER BY c.j) AS r
  FROM cov c JOIN sds s ON s.season = c.season AND s.model = c.model AND s.i = c.i LEFT JOIN sds t ON t.season = c.season AND t.model = c.model AND t.i = c.j GROUP BY ALL) z GROUP BY ALL),
el AS (SELECT season, model, d, 0::BIGINT AS k, m FROM eqs UNION ALL SELECT season, model, d, k + 1, list_transform(range(1, d + 1), lambda i: list_transform(range(1, d + 2), lambda j:
    CASE WHEN i = k + 1 THEN m[i][j] / m[i][i] ELSE m[i][j] - m[i][k + 1] * m[k + 1][j] / m[k + 1][k + 1] END)) FROM el WHERE k < d),
beta AS (SELECT e.season, e.model, s.i - 2 AS i, e.m[s.i - 1][e.d + 1] / s.sd AS coef FROM el e JOIN sds s ON s.season = e.season AND s.model = e.model WHERE e.k = e.d),
core AS MATERIALIZED (SELECT h.season, h.model, h.n, h.seasons, (y.s - sum(b.coef * x.s)) / h.n AS intercept, list(b.coef ORDER BY b.i) AS coefs FROM head h JOIN beta b ON b.season = h.season AND b.model = h.model
  JOIN acc x ON x.season = h.season AND x.model = h.model AND x.i = 1 AND x.j = b.i + 2 JOIN acc y ON y.season = h.season AND y.model = h.model AND y.i = 1 AND y.j = h.d + 2 GROUP BY h.season, h.model, h.n, h.seasons, y.s),
fitted AS MATERIALIZED (SELECT r.game_id, r.season, {', '.join(f"max(p) FILTER (r.model = '{m}') AS {m}" for m in _MODELS)}, max(seasons) FILTER (r.model = 'model_margin') AS seasons
  FROM (SELECT r.*, c.seasons, c.intercept + list_sum(list_transform(range(1, r.d + 1), lambda i: c.coefs[i] * r.v[i + 1])) AS p FROM rowv r LEFT JOIN core c ON c.season = r.season AND c.model = r.model) r GROUP BY r.game_id, r.season)"""

_MARKETS = " UNION ALL ".join(f"SELECT g.season, '{m}' AS market, f.{b} - g.{line} AS e, g.{y} - g.{line} AS d FROM fea g JOIN fitted f ON f.game_id = g.game_id WHERE f.seasons >= 3 AND g.result IS NOT NULL"
                              for m, b, line, y in (("spread", "blend_margin", "spread_line", "result"), ("total", "blend_total", "total_line", "total")))
FAIR = RIDGE + f""",
edge AS (SELECT * FROM ({_MARKETS}) z WHERE e IS NOT NULL AND d IS NOT NULL),
slope AS (SELECT season, market, CASE WHEN n < 200 OR ve * n <= 1e-12 THEN 0e0 ELSE least(greatest(ced / ve, 0), 1) END AS k FROM (
  SELECT t.season, x.market, count(*) AS n, var_pop(x.e) AS ve, covar_pop(x.e, x.d) AS ced FROM (SELECT DISTINCT season FROM core WHERE model = 'model_margin' AND seasons > 3) t JOIN edge x ON x.season < t.season GROUP BY 1, 2) z)"""
