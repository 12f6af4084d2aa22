"""SQL of the folds: recursive, a step for each row of a ride. Each ends in the SELECT that the query gives."""

from __future__ import annotations

from trackloom.sources.rides import RIDES_SQL


def stepwise(rows: str, state: dict[str, str], layers: list[str], out: str, last: str = "") -> str:
    """Recursive SQL over rows(ride_id, n from 0, ...): state columns with their first values, and layers of expressions over row and state.

    Each layer is a list of "expression AS name" that the next one can use; the last one gives every state column under its own name.
    """
    names = ", ".join(state)
    inner = f"SELECT f.ride_id, st.n, {', '.join(f'f.{c} AS {c}_' for c in state)}, st.* EXCLUDE (ride_id, n) FROM f JOIN st ON st.ride_id = f.ride_id AND st.n = f.n + 1"
    for layer in layers:
        inner = f"SELECT *, {layer} FROM ({inner})"
    start = ", ".join(f"{v} AS {c}" for c, v in state.items())
    return f"WITH RECURSIVE {RIDES_SQL}, st AS MATERIALIZED ({rows}), f AS (SELECT ride_id, -1::BIGINT AS n, {start} FROM st GROUP BY ride_id UNION ALL SELECT ride_id, n, {names} FROM ({inner})) {last} {out}"


XY = "x_mm / 1000.0::DOUBLE AS x, y_mm / 1000.0::DOUBLE AS y"
D = "NULL::DOUBLE"


def near(a: str) -> str:
    return f"sqrt(pow(x - {a}x_, 2) + pow(y - {a}y_, 2))"


FIX_FILTER = stepwise(
    f"SELECT ride_id, seq AS n, {XY}, seq::DOUBLE AS t, k / 9.0::DOUBLE AS age FROM r",
    {"ux": D, "uy": D, "ut": D, "ox": D, "oy": D, "ot": D, "ag": "0::BIGINT", "verdict": "NULL::VARCHAR"},
    [
        f"age > 10 AS stale, ut_ IS NULL OR (t > ut_ AND {near('u')} / (t - ut_) <= 60) AS ok, ut_ IS NOT NULL AND t - ut_ >= 20 AND {near('u')} >= 50 AS fresh, CASE WHEN ag_ > 0 AND t > ot_ AND {near('o')} / (t - ot_) <= 60 THEN ag_ + 1 ELSE 1 END AS agrees",
        "CASE WHEN stale THEN 'STALE' WHEN ok THEN CASE WHEN fresh THEN 'NEW_TRACK' ELSE 'ACCEPT' END WHEN agrees < 3 THEN 'GLITCH' ELSE 'NEW_TRACK' END AS verdict, NOT stale AND (ok OR agrees >= 3) AS used, NOT stale AND NOT ok AS doubtful",
        "CASE WHEN used THEN x ELSE ux_ END AS ux, CASE WHEN used THEN y ELSE uy_ END AS uy, CASE WHEN used THEN t ELSE ut_ END AS ut, CASE WHEN doubtful THEN x ELSE ox_ END AS ox, CASE WHEN doubtful THEN y ELSE oy_ END AS oy, CASE WHEN doubtful THEN t ELSE ot_ END AS ot, CASE WHEN stale THEN ag_ WHEN used THEN 0 ELSE agrees END AS ag",
    ],
    "SELECT ride_id, n AS seq, verdict FROM f WHERE n >= 0",
)

GNSS_SWITCH = stepwise(
    "SELECT ride_id, seq AS n, seq::DOUBLE AS t, CAST(floor(value) AS BIGINT) % 12 AS sats, k / 2.0::DOUBLE AS acc, gnss_ok AS fix FROM r",
    {"good": "true", "fixed": D, "weak": D, "ever": "false", "streak": "0::BIGINT", "switches": "0::BIGINT"},
    [
        "ever_ OR sats >= 4 AS ever",
        "CASE WHEN sats >= 4 OR NOT ever THEN NULL ELSE coalesce(weak_, t) END AS weak",
        "good_ AND (coalesce(t - fixed_ > 2.5, false) OR coalesce(t - weak >= 1, false)) AS lost1",
        "good_ AND NOT lost1 AS good1, CASE WHEN lost1 THEN 0 ELSE streak_ END AS streak1",
        "CASE WHEN NOT fix THEN streak1 WHEN acc > 30 OR NOT (NOT ever OR sats >= 4) THEN 0 WHEN coalesce(t - fixed_ <= 1.5, false) THEN streak1 + 1 ELSE 1 END AS streak2, CASE WHEN fix THEN t ELSE fixed_ END AS fixed",
        "fix AND NOT good1 AND streak2 >= 2 AS back, fix AND good1 AND acc > 60 AS coarse",
        "(good1 OR back) AND NOT coarse AS good2, CASE WHEN back OR coarse THEN 0 ELSE streak2 END AS streak3",
        "good2 AND (coalesce(t + 0.5 - fixed > 2.5, false) OR coalesce(t + 0.5 - weak >= 1, false)) AS lost2",
        "good2 AND NOT lost2 AS good, CASE WHEN lost2 THEN 0 ELSE streak3 END AS streak, switches_ + lost1::BIGINT + (back OR coarse)::BIGINT + lost2::BIGINT AS switches",
    ],
    "SELECT ride_id, n AS seq, CASE WHEN good THEN 'GNSS' ELSE 'DEAD_RECKONING' END AS mode, switches::INT AS switches FROM f WHERE n >= 0",
)

GYRO_BIAS = stepwise(
    "SELECT ride_id, seq * 4 + i AS n, (k + i) / 4000.0::DOUBLE AS wx, (k + i) / 8000.0::DOUBLE AS wy, value < 60 AS still FROM r, (SELECT unnest(range(4)) AS i)",
    {"m": "0::BIGINT", "sx": "0.0::DOUBLE", "sy": "0.0::DOUBLE", "qx": "0.0::DOUBLE", "qy": "0.0::DOUBLE", "ready": "false"},
    [
        "still AND wx * wx + wy * wy <= 0.05::DOUBLE * 0.05 AS used",
        "m_ + used::BIGINT AS m1, sx_ + CASE WHEN used THEN wx ELSE 0 END AS sx1, sy_ + CASE WHEN used THEN wy ELSE 0 END AS sy1",
        "used AND m1 >= 150 AS enough",
        "CASE WHEN enough THEN sx1 / m1 ELSE qx_ END AS qx1, CASE WHEN enough THEN sy1 / m1 ELSE qy_ END AS qy1",
        "enough AND degrees(sqrt(qx1 * qx1 + qy1 * qy1)) > 1 AS bad",
        "CASE WHEN bad THEN 0 ELSE m1 END AS m, CASE WHEN bad THEN 0 ELSE sx1 END AS sx, CASE WHEN bad THEN 0 ELSE sy1 END AS sy, CASE WHEN bad THEN 0 ELSE qx1 END AS qx, CASE WHEN bad THEN 0 ELSE qy1 END AS qy, NOT bad AND (enough OR ready_) AS ready",
    ],
    "SELECT ride_id, n AS seq, ready, m::INT AS n, round(qx, 9) AS bias_x FROM f WHERE n >= 0",
)

GREEDY_THINNING = stepwise(
    f"SELECT ride_id, seq AS n, x_mm, y_mm, {XY} FROM r",
    {"kx": D, "ky": D, "kept": "false", "px": "NULL::BIGINT", "py": "NULL::BIGINT"},
    [f"kx_ IS NULL OR {near('k')} > 20 AS kept", "CASE WHEN kept THEN x ELSE kx_ END AS kx, CASE WHEN kept THEN y ELSE ky_ END AS ky, x_mm AS px, y_mm AS py"],
    "SELECT ride_id, n AS seq, px AS x_mm, py AS y_mm FROM f WHERE n >= 0 AND kept",
)

MERGED_EVENTS = stepwise(
    "SELECT ride_id, row_number() OVER (PARTITION BY ride_id ORDER BY seq) - 1 AS n, d_mm / 1000.0::DOUBLE AS pos, value AS strength, seq FROM r WHERE hit",
    {"la": D, "ls": D, "li": "NULL::BIGINT", "settled": "NULL::BIGINT"},
    ["la_ IS NOT NULL AND pos - la_ < 25 AS near", "near AND NOT strength > ls_ AS keep", "CASE WHEN near THEN NULL ELSE li_ END AS settled, CASE WHEN keep THEN la_ ELSE pos END AS la, CASE WHEN keep THEN ls_ ELSE strength END AS ls, CASE WHEN keep THEN li_ ELSE seq END AS li"],
    "SELECT ride_id, settled AS seq FROM f WHERE settled IS NOT NULL UNION ALL SELECT ride_id, arg_max(li, n) FROM f WHERE n >= 0 GROUP BY ride_id",
)

MERGED_TURNS = stepwise(
    "SELECT ride_id, row_number() OVER (PARTITION BY ride_id ORDER BY seq) - 1 AS n, d_mm / 1000.0::DOUBLE AS pos, (k - 50)::DOUBLE AS a FROM r WHERE k <> 50",
    {"oa": D, "og": D, "sa": D, "sg": D},
    ["oa_ IS NOT NULL AND pos - oa_ < 15 AND (a > 0) = (og_ > 0) AS joins", "CASE WHEN joins THEN NULL ELSE oa_ END AS sa, CASE WHEN joins THEN NULL ELSE og_ END AS sg, CASE WHEN joins THEN oa_ ELSE pos END AS oa, CASE WHEN joins THEN og_ + a ELSE a END AS og"],
    "SELECT ride_id, sa AS at_m, sg AS angle_deg FROM f WHERE sa IS NOT NULL UNION ALL SELECT ride_id, arg_max(oa, n), arg_max(og, n) FROM f WHERE n >= 0 GROUP BY ride_id",
)

SPOKEN_TURNS = stepwise(
    "SELECT ride_id, seq AS n, d_mm / 1000.0::DOUBLE AS s FROM r",
    {"f0": "false", "n0": "false", "f1": "false", "n1": "false", "arr": "false", "said": "NULL::VARCHAR"},
    [
        "CASE WHEN s <= 85 THEN 0 WHEN s <= 205 THEN 1 END AS i, CASE WHEN s <= 85 THEN 80 - s WHEN s <= 205 THEN 200 - s END AS left_",
        "CASE WHEN left_ <= 30 THEN 'now' WHEN left_ <= 150 THEN 'far' END AS band",
        "coalesce(CASE WHEN i = 0 THEN CASE band WHEN 'now' THEN NOT n0_ WHEN 'far' THEN NOT f0_ END WHEN i = 1 THEN CASE band WHEN 'now' THEN NOT n1_ WHEN 'far' THEN NOT f1_ END END, false) AS turn",
        "NOT turn AND 300 - s <= 30 AND NOT arr_ AS arrives",
        "CASE WHEN turn THEN band || ' ' || i WHEN arrives THEN 'arrived' END AS said, arr_ OR arrives AS arr, f0_ OR (turn AND i = 0) AS f0, n0_ OR (turn AND i = 0 AND band = 'now') AS n0, f1_ OR (turn AND i = 1) AS f1, n1_ OR (turn AND i = 1 AND band = 'now') AS n1",
    ],
    "SELECT ride_id, n AS seq, said FROM f WHERE said IS NOT NULL",
)

CONFIDENCE_SPOKEN = stepwise(
    "SELECT ride_id, seq AS n, seq::DOUBLE AS t, CASE WHEN value < 25 THEN 'tight' WHEN value < 75 THEN 'medium' ELSE 'loose' END AS now_ FROM r",
    {"band": "NULL::VARCHAR", "pos": D, "said": "false"},
    ["band_ IS DISTINCT FROM now_ AND coalesce(t - pos_ >= 8, true) AS said", "CASE WHEN said THEN now_ ELSE band_ END AS band, CASE WHEN said THEN t ELSE pos_ END AS pos"],
    "SELECT ride_id, n AS seq, band FROM f WHERE said",
)

DIVERSE = stepwise(
    f"SELECT ride_id, row_number() OVER (PARTITION BY ride_id ORDER BY -k, seq) - 1 AS n, seq, {XY} FROM r",
    {"ax": D, "ay": D, "ox": D, "oy": D, "c": "0::INT", "took": "NULL::BIGINT"},
    [
        "c_ < 3 AND (c_ < 1 OR pow(x - ax_, 2) + pow(y - ay_, 2) >= 3600) AND (c_ < 2 OR pow(x - ox_, 2) + pow(y - oy_, 2) >= 3600) AS takes",
        "CASE WHEN takes AND c_ = 0 THEN x ELSE ax_ END AS ax, CASE WHEN takes AND c_ = 0 THEN y ELSE ay_ END AS ay, CASE WHEN takes AND c_ = 1 THEN x ELSE ox_ END AS ox, CASE WHEN takes AND c_ = 1 THEN y ELSE oy_ END AS oy, c_ + takes::INT AS c, CASE WHEN takes THEN seq END AS took",
    ],
    "SELECT ride_id, took AS seq, c AS rank FROM f WHERE took IS NOT NULL",
)

ONLINE_MATCH = f"""WITH RECURSIVE {RIDES_SQL},
mk AS MATERIALIZED (SELECT ride_id, row_number() OVER (PARTITION BY ride_id ORDER BY d_mm) - 1 AS j, d_mm / 1000.0::DOUBLE AS s FROM r WHERE seq % 10 = 0),
sn AS MATERIALIZED (SELECT ride_id, row_number() OVER (PARTITION BY ride_id ORDER BY pos) - 1 AS i, pos FROM (SELECT ride_id, d_mm / 1000.0::DOUBLE + (k - 50) / 10.0::DOUBLE AS pos FROM r WHERE hit)),
f(ride_id, i, mark, nxt) AS (SELECT ride_id, -1::BIGINT, -1::BIGINT, 0::BIGINT FROM sn GROUP BY ride_id
 UNION ALL SELECT f.ride_id, sn.i, coalesce(arg_min(mk.j, (pow(abs(mk.s - sn.pos) / 20.0::DOUBLE, 2), mk.j)) FILTER (WHERE mk.j IS NOT NULL), -1), coalesce(arg_min(mk.j, (pow(abs(mk.s - sn.pos) / 20.0::DOUBLE, 2), mk.j)) FILTER (WHERE mk.j IS NOT NULL) + 1, any_value(f.nxt))
 FROM f JOIN sn ON sn.ride_id = f.ride_id AND sn.i = f.i + 1 LEFT JOIN mk ON mk.ride_id = f.ride_id AND mk.j >= f.nxt AND abs(mk.s - sn.pos) <= 80 GROUP BY f.ride_id, sn.i)
SELECT ride_id, i::INT AS i, mark::INT AS mark FROM f WHERE i >= 0"""
