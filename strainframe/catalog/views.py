"""SQL text of the domain views, used to assemble the oracle statements."""

from __future__ import annotations

import re

VIEWS = {
    "raw_notes": """
        SELECT user_id AS beatmap_id, event_id AS source_order,
               CAST(((epoch_us(ts) - 1704067200000000) // 4320000000) * 50 AS BIGINT) AS time_ms,
               CAST(regexp_extract(props, '[0-9]+') AS INT) % 4 AS col,
               CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS is_ln,
               CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 10) AS BIGINT) ELSE 0 END AS ln_length_ms
        FROM events""",
    "notes": """
        SELECT *, row_number() OVER w - 1 AS note_index,
               count(*) OVER (PARTITION BY beatmap_id, time_ms) AS chord_size,
               lag(time_ms) OVER w AS prev_time_ms,
               lag(time_ms, 2) OVER w AS prev2_time_ms,
               lag(col) OVER w AS prev_col,
               lag(col, 2) OVER w AS prev2_col,
               max(time_ms) OVER (PARTITION BY beatmap_id) AS last_time_ms
        FROM raw_notes
        WINDOW w AS (PARTITION BY beatmap_id ORDER BY time_ms, col, source_order)""",
    "note_features": """
        SELECT beatmap_id, note_index,
               time_ms / greatest(last_time_ms, 1)::DOUBLE AS time_frac,
               coalesce(time_ms - prev_time_ms, 0) / 1000.0::DOUBLE AS delta_sec,
               col / 3.0::DOUBLE AS col_frac,
               is_ln::DOUBLE AS is_ln,
               ln_length_ms / 1000.0::DOUBLE AS ln_length_sec,
               chord_size / 4.0::DOUBLE AS chord_frac
        FROM notes""",
    "scores": """
        SELECT l_partkey AS beatmap_id, 1.0::DOUBLE - l_discount * l_quantity / 50 AS accuracy FROM lineitem""",
    "maps": """
        SELECT p_partkey AS beatmap_id, p_brand AS beatmapset_id, p_name AS title, p_type AS artist,
               p_brand AS mapper, CAST(p_size AS VARCHAR) AS version, p_size::BIGINT * 1000 AS length_ms,
               90.0::DOUBLE + p_size * 3 AS bpm, p_retailprice AS difficulty_rating,
               CASE WHEN p_size % 10 = 0 THEN 0 ELSE 3 END AS mode,
               CASE WHEN p_size % 7 = 0 THEN 7 ELSE 4 END AS keys,
               3.0::DOUBLE + p_size / 10 AS hp_drain_rate,
               CASE WHEN p_size % 7 <> 3 THEN p_size / 5.0::DOUBLE END AS overall_difficulty,
               5.0::DOUBLE + p_size % 5 AS approach_rate
        FROM part""",
    "chart_scores": """
        SELECT beatmap_id, avg(accuracy) AS mean_acc, stddev_pop(accuracy) AS acc_std,
               avg(accuracy) FILTER (WHERE rn <= greatest(1, round_even(n * 0.1, 0)))
             - avg(accuracy) FILTER (WHERE rn > n - greatest(1, round_even(n * 0.5, 0))) AS skill_gap,
               quantile_cont(accuracy, 0.5) AS median_acc, quantile_cont(accuracy, 0.1) AS p10_acc,
               quantile_cont(accuracy, 0.9) AS p90_acc, count(*) AS score_count
        FROM (SELECT *, count(*) OVER (PARTITION BY beatmap_id) AS n,
                     row_number() OVER (PARTITION BY beatmap_id ORDER BY accuracy DESC) AS rn FROM scores)
        GROUP BY beatmap_id""",
    "chart_labels": """
        SELECT maps.*, mean_acc, acc_std, skill_gap, median_acc, p10_acc, p90_acc, score_count
        FROM maps JOIN chart_scores USING (beatmap_id)""",
    "predictions": """
        SELECT beatmap_id, round(mean_acc, 9) AS actual_mean_acc, 0.95::DOUBLE + (length_ms / 1000 - 25) / 1000.0::DOUBLE AS pred_mean_acc,
               round(acc_std, 9) AS actual_acc_std, 0.02::DOUBLE + (length_ms / 1000 - 25) / 5000.0::DOUBLE AS pred_acc_std,
               round(skill_gap, 9) AS actual_skill_gap, 0.045::DOUBLE + (length_ms / 1000 - 25) / 2000.0::DOUBLE AS pred_skill_gap
        FROM chart_labels""",
    "long_predictions": """
        SELECT beatmap_id, 'mean_acc' AS target, actual_mean_acc AS actual, pred_mean_acc AS pred FROM predictions
        UNION ALL
        SELECT beatmap_id, 'acc_std', actual_acc_std, pred_acc_std FROM predictions
        UNION ALL
        SELECT beatmap_id, 'skill_gap', actual_skill_gap, pred_skill_gap FROM predictions""",
    "stages": """
        SELECT * FROM (VALUES
            ('readless_beginner', 0.05, 0.08, 0.05, 0.03, 0.04, 0.02, 0.05, 0.00),
            ('beginner', 0.18, 0.20, 0.16, 0.12, 0.13, 0.10, 0.16, 0.08),
            ('novice', 0.35, 0.38, 0.32, 0.28, 0.30, 0.24, 0.34, 0.22),
            ('intermediate', 0.55, 0.58, 0.53, 0.48, 0.50, 0.45, 0.55, 0.44),
            ('advanced', 0.74, 0.76, 0.72, 0.70, 0.70, 0.66, 0.74, 0.66),
            ('dan_ready', 0.88, 0.90, 0.88, 0.86, 0.85, 0.82, 0.88, 0.82))
        AS s(stage_id, reading, speed, stamina, jack, chord, ln, accuracy, pattern_memory)""",
    "pairs": """
        SELECT o_orderkey AS pair_id, CASE WHEN o_orderstatus = 'F' THEN 'segment' ELSE 'map' END AS scope,
               (['readless_beginner', 'beginner', 'novice', 'intermediate', 'advanced', 'dan_ready',
                 'unlisted_stage'])[CAST(o_orderkey % 7 + 1 AS INT)] AS player_stage,
               o_custkey AS a_beatmap_id, o_orderkey % 150 + 1 AS b_beatmap_id,
               CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 20 AS DOUBLE) END AS start_sec,
               CASE WHEN o_orderstatus = 'F' THEN CAST(o_orderkey % 20 + 1 + o_orderkey % 4 AS DOUBLE) END AS end_sec,
               o_totalprice / 100000 AS a_peak_strain,
               CASE WHEN o_orderkey % 17 <> 0 THEN (o_totalprice % 1000.0::DOUBLE) / 100 END AS b_peak_strain,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'A' WHEN '2-HIGH' THEN 'right'
                    WHEN '3-MEDIUM' THEN ' Tie ' WHEN '5-LOW' THEN 'uncertain' ELSE '' END AS harder_choice,
               CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'n/a'
                    ELSE CAST(round(o_totalprice / 100000, 2) AS VARCHAR) END AS confidence
        FROM orders""",
    "history": """
        SELECT 'Brand#' || CAST(user_id % 25 + 1 AS VARCHAR) AS run,
               row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts, event_id) AS epoch, event_id,
               value / 100 * (0.8::DOUBLE + (event_id % 5) / 10.0::DOUBLE) AS train_loss,
               CASE WHEN event_id % 29 <> 0 THEN value / 100 END AS val_loss,
               CASE WHEN event_id % 7 <> 0 THEN value / 100 * 0.5::DOUBLE + (event_id % 3) / 1000.0::DOUBLE END AS val_mean_mae,
               CASE WHEN event_id % 5 <> 0 THEN (event_id % 100) / 100.0::DOUBLE END AS val_mean_pairwise_order_accuracy,
               CASE WHEN event_id % 3 <> 0 THEN CAST(event_id % 240 AS DOUBLE) END AS epoch_seconds,
               1.0::DOUBLE / (event_id % 10 + 1) AS lr,
               CASE WHEN user_id % 3 <> 0 THEN CAST(event_id % 20000 AS DOUBLE) END AS cuda_max_memory_mb
        FROM events""",
}


def with_views(body: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the WITH clause of every view it reaches."""
    views = {**VIEWS, **(extra or {})}
    ordered: list[str] = []

    def visit(text: str) -> None:
        for name in views:
            if name not in ordered and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(views[name])
                if name not in ordered:
                    ordered.append(name)

    visit(body)
    if not ordered:
        return body.strip()
    return "WITH " + ",\n".join(f"{name} AS ({views[name].strip()})" for name in ordered) + "\n" + body.strip()
