"""Oracle SQL of forests: every row walks its trees level by level in one recursive statement."""

from __future__ import annotations

from strainframe.operators import features

_KEY = "model, tree, node"


def rows_view(source: str, names: list[str]) -> str:
    """Features in millionths, weights in thousandths, targets in millionths of the charts in source (beatmap_id, train, model)."""
    values = ", ".join(f"CAST(round(round(CAST({name} AS DOUBLE), 9) * 1000000) AS BIGINT)" for name in names)
    return f"""SELECT s.model, s.beatmap_id AS id, s.train, [{values}] AS x,
               greatest(CAST(round(greatest(0.25, least(1.0, l.score_count / 100.0::DOUBLE)) * 1000) AS BIGINT), 1) AS w,
               CAST(round(round(l.mean_acc, 9) * 1000000) AS BIGINT) AS y1, CAST(round(round(l.acc_std, 9) * 1000000) AS BIGINT) AS y2,
               CAST(round(round(l.skill_gap, 9) * 1000000) AS BIGINT) AS y3
        FROM ({source}) s JOIN {"core" if len(names) == len(features.CORE_FEATURES) else "core USING (beatmap_id) JOIN burst"} USING (beatmap_id) LEFT JOIN chart_labels l USING (beatmap_id)"""


def plans_view(plans: str) -> str:
    """plans: (model, seed, trees, min_leaf, width, drawn); adds the deviations of the targets."""
    scales = ", ".join(f"greatest(CAST(round(stddev_pop(y{t})) AS BIGINT), 1) AS z{t}" for t in (1, 2, 3))
    return f"SELECT * FROM ({plans}) p JOIN (SELECT model, {scales} FROM forest_rows WHERE train GROUP BY model) USING (model)"


_SCORE = " + ".join(f"(l{t} * l{t} / wl + (s{t} - l{t}) * (s{t} - l{t}) / (wt - wl)) / (z{t} * z{t})" for t in (1, 2, 3))
_BEFORE = " + ".join(f"s{t} * s{t} / wt / (z{t} * z{t})" for t in (1, 2, 3))
_SUMS = ", ".join(f"CAST(sum(t.w * t.y{t}) AS DOUBLE) AS s{t}, CAST(sum(CASE WHEN lefts THEN t.w * t.y{t} ELSE 0 END) AS DOUBLE) AS l{t}" for t in (1, 2, 3))

#: (model, tree, node, id, train, f, gain): where each row stands at each level; f and gain belong to the node above.
WALK = f"""
    WITH RECURSIVE walk AS (
        SELECT model, CAST(unnest(range(1, trees + 1)) AS INTEGER) AS tree, '' AS node, id, train, CAST(NULL AS BIGINT) AS f, CAST(NULL AS DOUBLE) AS gain
        FROM forest_rows JOIN forest_plans USING (model)
        UNION ALL (
        WITH here AS (SELECT {_KEY}, id, train FROM walk),
        stand AS (SELECT h.model, h.tree, h.node, r.x, r.w, r.y1, r.y2, r.y3 FROM here h JOIN forest_rows r ON r.model = h.model AND r.id = h.id AND r.train WHERE h.train),
        open_nodes AS (
            SELECT {_KEY}, p.seed, p.width, p.drawn, p.min_leaf, p.z1, p.z2, p.z3 FROM (
                SELECT {_KEY}, count(*) AS n, min(y1) = max(y1) AND min(y2) = max(y2) AND min(y3) = max(y3) AS pure FROM stand GROUP BY ALL)
            JOIN forest_plans p USING (model) WHERE n >= 2 * min_leaf AND NOT pure),
        extents AS (
            SELECT {_KEY}, f, min(x[f + 1]) AS low, max(x[f + 1]) AS high
            FROM (SELECT s.*, unnest(range(0, o.width)) AS f FROM stand s JOIN open_nodes o USING ({_KEY})) GROUP BY ALL),
        hashed AS (
            SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY h, f) AS place
            FROM (SELECT *, md5(concat_ws('|', seed, tree, node, f)) AS h FROM extents JOIN open_nodes USING ({_KEY}))),
        drawn_cuts AS (
            SELECT *, CAST(low AS DOUBLE) + CAST(high - low AS DOUBLE) * (CAST(CAST('0x' || substr(h, 17, 8) AS BIGINT) AS DOUBLE) / CAST(4294967296 AS DOUBLE)) AS cut
            FROM (SELECT *, count(*) FILTER (low < high AND place <= drawn) OVER (PARTITION BY {_KEY}) AS live,
                         row_number() OVER (PARTITION BY {_KEY} ORDER BY low >= high, place) AS spare FROM hashed)
            WHERE low < high AND (place <= drawn OR (live = 0 AND spare = 1))),
        sides AS (
            SELECT {_KEY}, f, cut, min_leaf, CAST(z1 AS DOUBLE) AS z1, CAST(z2 AS DOUBLE) AS z2, CAST(z3 AS DOUBLE) AS z3, count(*) AS n, count_if(lefts) AS nl,
                   CAST(sum(t.w) AS DOUBLE) AS wt, CAST(sum(CASE WHEN lefts THEN t.w ELSE 0 END) AS DOUBLE) AS wl, {_SUMS}
            FROM (SELECT d.*, s.w, s.y1, s.y2, s.y3, CAST(s.x[d.f + 1] AS DOUBLE) <= d.cut AS lefts FROM drawn_cuts d JOIN stand s USING ({_KEY})) t GROUP BY ALL),
        best AS (
            SELECT {_KEY}, f, cut, score - before AS gain FROM (SELECT *, {_SCORE} AS score, {_BEFORE} AS before FROM sides WHERE nl >= min_leaf AND n - nl >= min_leaf)
            QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY score DESC, f) = 1)
        SELECT h.model, h.tree, h.node || CASE WHEN CAST(r.x[b.f + 1] AS DOUBLE) <= b.cut THEN 'L' ELSE 'R' END, h.id, h.train, b.f, b.gain
        FROM here h JOIN best b USING ({_KEY}) JOIN forest_rows r ON r.model = h.model AND r.id = h.id AND r.train = h.train)
    )
    SELECT * FROM walk"""

#: (model, tree, node, id, train): the leaf of each row.
LEAVES = "SELECT model, tree, id, train, max_by(node, length(node)) AS node FROM forest_walk GROUP BY ALL"

LEAF_MEANS = f"""
    SELECT {_KEY}, {", ".join(f"CAST(sum(w * y{t}) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS v{t}" for t in (1, 2, 3))}
    FROM forest_leaves JOIN forest_rows USING (model, id, train) WHERE train GROUP BY ALL"""

#: (model, id, v1, v2, v3) of the rows that no tree was grown on.
VALUES = f"""
    SELECT model, id, avg(v1) / 1000000 AS v1, avg(v2) / 1000000 AS v2, avg(v3) / 1000000 AS v3
    FROM forest_leaves JOIN leaf_means USING ({_KEY}) WHERE NOT train GROUP BY ALL"""

IMPORTANCES = """
    SELECT model, f, sum(gain / total) / any_value(grown) AS importance FROM (
        SELECT model, tree, f, gain, total, count(DISTINCT tree) OVER (PARTITION BY model) AS grown FROM (
            SELECT model, tree, f, sum(gain) AS gain, sum(sum(gain)) OVER (PARTITION BY model, tree) AS total FROM (
                SELECT DISTINCT model, tree, left(node, length(node) - 1) AS node, f, gain FROM forest_walk WHERE f IS NOT NULL) GROUP BY model, tree, f)
        WHERE total > 0) GROUP BY model, f"""


def forest_views(rows: str, plans: str) -> dict[str, str]:
    return {
        "forest_rows": rows,
        "forest_plans": plans_view(plans),
        "forest_walk": WALK,
        "forest_leaves": LEAVES,
        "leaf_means": LEAF_MEANS,
        "forest_values": VALUES,
        "forest_importances": IMPORTANCES,
    }
