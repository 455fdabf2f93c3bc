"""Review and judgment queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strainframe.catalog.metrics_catalog import TARGETS, predictions, stored_labels, stored_predictions
from strainframe.catalog.registry import query, rounded
from strainframe.functions import choices
from strainframe.operators import judgments, review
from strainframe.sources import tables


@query(
    "q_predictions_labels",
    """SELECT beatmap_id, round(actual_mean_acc, 10) AS actual_mean_acc, round(pred_mean_acc, 10) AS pred_mean_acc,
              p.title, m.title AS title_label, m.artist FROM (
           SELECT *, 'run ' || CAST(beatmap_id % 3 AS VARCHAR) AS title FROM predictions
           UNION ALL SELECT *, 'extra' FROM (SELECT beatmap_id + 1000000 AS beatmap_id, * EXCLUDE beatmap_id FROM predictions)) p
       LEFT JOIN maps m USING (beatmap_id)""",
)
def q_predictions_labels(spark, folder):
    rows = predictions(spark, folder)
    named = rows.withColumn("title", F.concat(F.lit("run "), (F.col("beatmap_id") % 3).cast("string")))
    unknown = rows.withColumns({"beatmap_id": F.col("beatmap_id") + 1_000_000, "title": F.lit("extra")})
    merged = review.join_labels(named.unionByName(unknown), tables.maps(spark, folder))
    names = ["beatmap_id", "actual_mean_acc", "pred_mean_acc", "title", "title_label", "artist"]
    return rounded(merged.select(*names), "actual_mean_acc", "pred_mean_acc", digits=10)


RANKING_SQL = """
    SELECT p.*, pred_mean_acc - actual_mean_acc AS error_mean_acc, abs(pred_mean_acc - actual_mean_acc) AS abs_error_mean_acc,
           title, artist, mapper, version FROM predictions p LEFT JOIN maps USING (beatmap_id)"""


@query(
    "q_prediction_rankings",
    """SELECT ranking_section, rank, beatmap_id, title, artist, mapper, version, round(pred_mean_acc, 10) AS pred_mean_acc,
              round(actual_mean_acc, 10) AS actual_mean_acc, round(error_mean_acc, 10) AS error_mean_acc,
              round(abs_error_mean_acc, 10) AS abs_error_mean_acc FROM (
         SELECT *, 'predicted_hardest' AS ranking_section, row_number() OVER (ORDER BY pred_mean_acc, beatmap_id) AS rank FROM merged
         UNION ALL
         SELECT *, 'predicted_easiest', row_number() OVER (ORDER BY pred_mean_acc DESC, beatmap_id) FROM merged
         UNION ALL
         SELECT *, 'largest_abs_error', row_number() OVER (ORDER BY abs_error_mean_acc DESC, beatmap_id) FROM merged)
       WHERE rank <= 20""",
    extra={"merged": RANKING_SQL},
)
def q_prediction_rankings(spark, folder):
    ranked = review.prediction_rankings(stored_predictions(spark, folder), tables.maps(spark, folder), top_n=20)
    return rounded(ranked, *[n for n in ranked.columns if n.endswith("mean_acc")], digits=10)


REVIEW_VALUES = [f"{side}_{t}" for t in TARGETS for side in ("observed", "predicted", "error")]


@query(
    "q_human_review",
    "SELECT review_reason, beatmap_id, title, artist, mapper, version, "
    + ", ".join(
        f"round(actual_{t}, 10) AS observed_{t}, round(pred_{t}, 10) AS predicted_{t}, round(pred_{t} - actual_{t}, 10) AS error_{t}"
        for t in TARGETS
    )
    + """ FROM (
         SELECT *, 'model_lowest_predicted_mean_acc' AS review_reason, row_number() OVER (ORDER BY pred_mean_acc, beatmap_id) AS rn FROM predictions
         UNION ALL
         SELECT *, 'observed_lowest_mean_acc', row_number() OVER (ORDER BY actual_mean_acc, beatmap_id) FROM predictions
         UNION ALL
         SELECT *, 'largest_mean_acc_disagreement', row_number() OVER (ORDER BY abs(pred_mean_acc - actual_mean_acc) DESC, beatmap_id) FROM predictions
         UNION ALL
         SELECT *, 'largest_acc_std_disagreement', row_number() OVER (ORDER BY abs(pred_acc_std - actual_acc_std) DESC, beatmap_id) FROM predictions
         UNION ALL
         SELECT *, 'largest_skill_gap_disagreement', row_number() OVER (ORDER BY abs(pred_skill_gap - actual_skill_gap) DESC, beatmap_id) FROM predictions)
       JOIN maps USING (beatmap_id) WHERE rn <= 10""",
)
def q_human_review(spark, folder):
    rows = review.human_review(stored_predictions(spark, folder), tables.maps(spark, folder), TARGETS)
    return rounded(rows, *REVIEW_VALUES, digits=10)


PAIR_REVIEW_SQL = """
    SELECT 'pairwise_rank_disagreement' AS review_reason,
           i.beatmap_id AS model_harder_beatmap_id, mi.title AS model_harder_title, mi.artist AS model_harder_artist,
           mi.mapper AS model_harder_mapper, mi.version AS model_harder_version,
           round(i.pred_mean_acc, 10) AS model_harder_pred_mean_acc, round(i.actual_mean_acc, 10) AS model_harder_observed_mean_acc,
           j.beatmap_id AS observed_harder_beatmap_id, mj.title AS observed_harder_title, mj.artist AS observed_harder_artist,
           mj.mapper AS observed_harder_mapper, mj.version AS observed_harder_version,
           round(j.pred_mean_acc, 10) AS observed_harder_pred_mean_acc,
           round(j.actual_mean_acc, 10) AS observed_harder_observed_mean_acc,
           round(i.pred_mean_acc - j.pred_mean_acc, 10) AS predicted_acc_gap_model_minus_observed,
           round(i.actual_mean_acc - j.actual_mean_acc, 10) AS observed_acc_gap_model_minus_observed,
           round(abs(i.pred_mean_acc - j.pred_mean_acc) + abs(i.actual_mean_acc - j.actual_mean_acc), 10) AS disagreement_strength
    FROM predictions i JOIN predictions j ON i.pred_mean_acc < j.pred_mean_acc AND i.actual_mean_acc > j.actual_mean_acc
    JOIN maps mi ON mi.beatmap_id = i.beatmap_id JOIN maps mj ON mj.beatmap_id = j.beatmap_id
    WHERE abs(i.pred_mean_acc - j.pred_mean_acc) >= {p} AND abs(i.actual_mean_acc - j.actual_mean_acc) >= {a}
    ORDER BY round(abs(i.pred_mean_acc - j.pred_mean_acc) + abs(i.actual_mean_acc - j.actual_mean_acc), 9) DESC,
             i.beatmap_id, j.beatmap_id LIMIT {n}"""


def _pair_review(spark, folder, **options):
    rows = review.pairwise_review(stored_predictions(spark, folder), tables.maps(spark, folder), **options)
    numbers = [n for n in rows.columns if n.endswith("mean_acc") or "gap" in n or "strength" in n]
    return rounded(rows, *numbers, digits=10)


@query("q_pair_disagreement", PAIR_REVIEW_SQL.format(p=0, a=0, n=20))
def q_pair_disagreement(spark, folder):
    return _pair_review(spark, folder, top_n=20)


@query("q_pair_disagreement_gaps", PAIR_REVIEW_SQL.format(p=0.002, a=0.012, n=15))
def q_pair_disagreement_gaps(spark, folder):
    return _pair_review(spark, folder, top_n=15, min_abs_pred_gap=0.002, min_abs_actual_gap=0.012)


@query(
    "q_judgment_template",
    "SELECT *, '' AS human_harder_beatmap_id, '' AS human_confidence, '' AS human_notes FROM review",
    extra={"review": PAIR_REVIEW_SQL.format(p=0, a=0, n=30)},
)
def q_judgment_template(spark, folder):
    return judgments.judgment_template(_pair_review(spark, folder, top_n=30))


SLICE_NAMES = ["actual_mean", "pred_mean", "mae", "bias", "max_abs_error"]
SLICE_VIEWS = {
    "stacked": """
        SELECT beatmap_id, actual_mean_acc AS actual, pred_mean_acc AS pred, slice_column, value
        FROM predictions JOIN (
            SELECT beatmap_id, 'score_count' AS slice_column, score_count::DOUBLE AS value FROM chart_labels
            UNION ALL SELECT beatmap_id, 'length_ms', length_ms::DOUBLE FROM chart_labels
            UNION ALL SELECT beatmap_id, 'bpm', bpm FROM chart_labels
            UNION ALL SELECT beatmap_id, 'overall_difficulty', overall_difficulty FROM chart_labels) USING (beatmap_id)""",
    "binned": """
        SELECT *, CASE WHEN n <= 1 THEN 'all' WHEN value IS NULL THEN 'missing'
                       WHEN n = 2 THEN CASE WHEN r = 1 THEN 'low' ELSE 'high' END
                       WHEN 3 * (r - 1) < n - 1 THEN 'low' WHEN 3 * (r - 1) < 2 * (n - 1) THEN 'mid' ELSE 'high' END AS bin
        FROM (SELECT *, count(value) OVER (PARTITION BY slice_column) AS n,
                     row_number() OVER (PARTITION BY slice_column ORDER BY value NULLS LAST, beatmap_id) AS r FROM stacked)""",
    "slices": """
        SELECT slice_column, bin AS slice_value, count(*) AS count, avg(actual) AS actual_mean, avg(pred) AS pred_mean,
               avg(abs(pred - actual)) AS mae, avg(pred - actual) AS bias, max(abs(pred - actual)) AS max_abs_error
        FROM binned GROUP BY slice_column, bin
        UNION ALL
        SELECT 'overall', 'all', count(*), avg(actual_mean_acc), avg(pred_mean_acc), avg(abs(pred_mean_acc - actual_mean_acc)),
               avg(pred_mean_acc - actual_mean_acc), max(abs(pred_mean_acc - actual_mean_acc)) FROM predictions""",
}
SLICED = ("score_count", "num_notes", "length_ms", "bpm", "overall_difficulty")


def _slices(spark, folder):
    rows = stored_labels(spark, folder)
    return review.error_slices(predictions(spark, folder, rows), rows, slice_columns=SLICED)


@query(
    "q_error_slices",
    "SELECT slice_column, slice_value, count, " + ", ".join(f"round({n}, 10) AS {n}" for n in SLICE_NAMES) + " FROM slices",
    extra=SLICE_VIEWS,
)
def q_error_slices(spark, folder):
    return rounded(_slices(spark, folder), *SLICE_NAMES, digits=10)


@query(
    "q_quantile_bins",
    "SELECT beatmap_id, slice_column, bin FROM binned",
    extra=SLICE_VIEWS,
)
def q_quantile_bins(spark, folder):
    rows = stored_labels(spark, folder)
    entries = [
        F.struct(F.lit(n).alias("slice_column"), F.col(n).cast("double").alias("value"))
        for n in ("score_count", "length_ms", "bpm", "overall_difficulty")
    ]
    stacked = rows.select("beatmap_id", F.explode(F.array(*entries)).alias("_s"))
    stacked = stacked.select("beatmap_id", "_s.slice_column", "_s.value")
    return review.quantile_bins(stacked, ["slice_column"], "value", ["beatmap_id"]).select(
        "beatmap_id", "slice_column", "bin"
    )


@query(
    "q_worst_slices",
    """SELECT slice_column || ': ' || slice_value AS slice, count, round(mae, 10) AS mae, round(bias, 10) AS bias,
              round(max_abs_error, 10) AS max_abs_error FROM slices WHERE slice_column <> 'overall'
       ORDER BY slices.mae DESC, slices.max_abs_error DESC, slice_column, slice_value LIMIT 5""",
    extra=SLICE_VIEWS,
)
def q_worst_slices(spark, folder):
    return rounded(review.worst_slices(_slices(spark, folder)), "mae", "bias", "max_abs_error", digits=10)


# --- judgments --------------------------------------------------------------


@query(
    "q_normalize_choice",
    """SELECT pair_id, CASE WHEN lower(trim(harder_choice)) IN ('a', 'left', 'first', '1') THEN 'a'
                            WHEN lower(trim(harder_choice)) IN ('b', 'right', 'second', '2') THEN 'b' END AS side,
              coalesce(greatest(0.0, least(TRY_CAST(nullif(trim(confidence), '') AS DOUBLE), 5.0)), 1.0) AS weight FROM pairs""",
)
def q_normalize_choice(spark, folder):
    return tables.pairs(spark, folder).select(
        "pair_id",
        choices.harder_side(F.col("harder_choice")).alias("side"),
        choices.annotation_confidence(F.col("confidence")).alias("weight"),
    )


STATUS_SQL = """
    SELECT *, CASE choice WHEN 'A' THEN 'judged' WHEN 'B' THEN 'judged' WHEN 'tie' THEN 'tie' WHEN 'uncertain' THEN 'uncertain'
                          ELSE 'open' END AS status,
           greatest(coalesce(a_peak_strain, 0), coalesce(b_peak_strain, 0)) AS pair_peak
    FROM (SELECT *, CASE lower(trim(harder_choice)) WHEN 'a' THEN 'A' WHEN 'right' THEN 'B' WHEN 'tie' THEN 'tie'
                    WHEN 'uncertain' THEN 'uncertain' ELSE trim(harder_choice) END AS choice FROM pairs)"""


@query("q_label_status", "SELECT pair_id, choice, status FROM statuses", extra={"statuses": STATUS_SQL})
def q_label_status(spark, folder):
    return tables.pairs(spark, folder).select(
        "pair_id",
        choices.labeler_choice(F.col("harder_choice")).alias("choice"),
        choices.labeler_status(F.col("harder_choice")).alias("status"),
    )


USABLE_SQL = """
    SELECT * FROM (
        SELECT *, CASE WHEN harder_choice = 'A' THEN 'a' WHEN harder_choice = 'right' THEN 'b' END AS normalized_harder_choice,
               coalesce(greatest(0.0, least(TRY_CAST(nullif(trim(confidence), '') AS DOUBLE), 5.0)), 1.0) AS sample_weight FROM pairs)
    WHERE normalized_harder_choice IS NOT NULL AND sample_weight > 0"""


@query(
    "q_usable_judgments",
    "SELECT pair_id, normalized_harder_choice, sample_weight FROM usable",
    extra={"usable": USABLE_SQL},
)
def q_usable_judgments(spark, folder):
    rows = judgments.usable_judgments(tables.pairs(spark, folder))
    return rows.select("pair_id", "normalized_harder_choice", "sample_weight")


@query(
    "q_annotation_table",
    "SELECT CAST(pair_id AS VARCHAR) AS pair_id, scope, player_stage, a_beatmap_id, b_beatmap_id, "
    + ", ".join(
        f"'' AS {n}"
        for n in judgments.ANNOTATION_COLUMNS
        if n not in ("pair_id", "scope", "player_stage", "a_beatmap_id", "b_beatmap_id", "harder_choice", "confidence")
    )
    + ", harder_choice, confidence FROM pairs",
)
def q_annotation_table(spark, folder):
    rows = tables.pairs(spark, folder)
    kept = ["scope", "player_stage", "a_beatmap_id", "b_beatmap_id", "harder_choice", "confidence"]
    return judgments.annotation_table(rows.select(F.col("pair_id").cast("string").alias("pair_id"), *kept))


JUDGED_SQL = """
    SELECT o_orderkey % 25 AS run, CASE WHEN o_orderkey % 2 = 0 THEN 'holdout' ELSE 'cv_oof' END AS evaluation,
           o_custkey AS model_harder_beatmap_id, o_orderkey % 150 + 1 AS observed_harder_beatmap_id,
           CASE o_orderpriority WHEN '1-URGENT' THEN CAST(o_custkey AS VARCHAR) || '.0'
                WHEN '2-HIGH' THEN CAST(o_orderkey % 150 + 1 AS VARCHAR) WHEN '3-MEDIUM' THEN ' Same'
                WHEN '5-LOW' THEN '999999999' ELSE '' END AS human_harder_beatmap_id,
           CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN 'n/a' WHEN o_orderkey % 7 = 0 THEN '-2'
                ELSE CAST(o_orderkey % 9 AS VARCHAR) || '.5' END AS human_confidence
    FROM orders"""


def judged_pairs(spark, folder):
    key = F.col("o_orderkey")
    word = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.concat(F.col("o_custkey").cast("string"), F.lit(".0")))
        .when(F.col("o_orderpriority") == "2-HIGH", (key % 150 + 1).cast("string"))
        .when(F.col("o_orderpriority") == "3-MEDIUM", " Same")
        .when(F.col("o_orderpriority") == "5-LOW", "999999999")
        .otherwise("")
    )
    sure = (
        F.when(key % 11 == 0, "")
        .when(key % 13 == 0, "n/a")
        .when(key % 7 == 0, "-2")
        .otherwise(F.concat((key % 9).cast("string"), F.lit(".5")))
    )
    return tables.table(spark, folder, "orders").select(
        (key % 25).alias("run"),
        F.when(key % 2 == 0, "holdout").otherwise("cv_oof").alias("evaluation"),
        F.col("o_custkey").alias("model_harder_beatmap_id"),
        (key % 150 + 1).alias("observed_harder_beatmap_id"),
        word.alias("human_harder_beatmap_id"),
        sure.alias("human_confidence"),
    )


JUDGMENT_VIEWS = {
    "judged": JUDGED_SQL,
    "outcomes": """
        SELECT *, CASE WHEN chosen IS NULL THEN 'unjudged' WHEN chosen = model_harder_beatmap_id THEN 'model'
                       WHEN chosen = observed_harder_beatmap_id THEN 'proxy' ELSE 'invalid' END AS outcome,
               CASE WHEN sure > 0 THEN sure ELSE 1.0 END AS w
        FROM (SELECT *, CAST(TRY_CAST(nullif(trim(human_harder_beatmap_id), '') AS DOUBLE) AS BIGINT) AS chosen,
                     TRY_CAST(nullif(trim(human_confidence), '') AS DOUBLE) AS sure FROM judged)""",
    "judgment_counts": """
        SELECT {keys} count(*) AS row_count, count_if(outcome IN ('model', 'proxy')) AS judged_count,
               count_if(outcome = 'unjudged') AS unjudged_count, count_if(outcome = 'invalid') AS invalid_choice_count,
               count_if(outcome = 'model') AS model_agree_count, count_if(outcome = 'proxy') AS proxy_agree_count,
               coalesce(sum(w) FILTER (WHERE outcome IN ('model', 'proxy')), 0) AS wj,
               coalesce(sum(w) FILTER (WHERE outcome = 'model'), 0) AS wm,
               coalesce(sum(w) FILTER (WHERE outcome = 'proxy'), 0) AS wp
        FROM outcomes {group}""",
}


@query(
    "q_score_judgments",
    """SELECT row_count, CAST(judged_count AS BIGINT) AS judged_count, CAST(unjudged_count AS BIGINT) AS unjudged_count,
              CAST(invalid_choice_count AS BIGINT) AS invalid_choice_count, CAST(model_agree_count AS BIGINT) AS model_agree_count,
              CAST(proxy_agree_count AS BIGINT) AS proxy_agree_count,
              round(judged_count / row_count::DOUBLE, 9) AS judgment_coverage_rate,
              round(model_agree_count / judged_count::DOUBLE, 9) AS model_agreement_rate,
              round(proxy_agree_count / judged_count::DOUBLE, 9) AS proxy_agreement_rate,
              round((model_agree_count / judged_count::DOUBLE) - (proxy_agree_count / judged_count::DOUBLE), 9) AS model_vs_proxy_agreement_delta,
              wj AS confidence_weighted_judged_count, wm AS confidence_weighted_model_agree_count,
              wp AS confidence_weighted_proxy_agree_count, round(wm / wj, 9) AS confidence_weighted_model_agreement_rate,
              round(wp / wj, 9) AS confidence_weighted_proxy_agreement_rate,
              round((wm - wp) / wj, 9) AS confidence_weighted_model_vs_proxy_delta FROM judgment_counts""",
    extra={**JUDGMENT_VIEWS, "judgment_counts": JUDGMENT_VIEWS["judgment_counts"].format(keys="", group="")},
)
def q_score_judgments(spark, folder):
    scored = judgments.judgment_scores(judged_pairs(spark, folder))
    return rounded(scored, *[n for n in scored.columns if "rate" in n or "delta" in n], digits=9)


PERCENTILE_VIEWS = {
    "stacked": """SELECT a_peak_strain AS strain FROM pairs WHERE a_peak_strain IS NOT NULL
                  UNION ALL SELECT b_peak_strain FROM pairs WHERE b_peak_strain IS NOT NULL""",
    "cumulative": """SELECT strain, sum(count(*)) OVER (ORDER BY strain) AS le FROM stacked GROUP BY strain""",
}


@query(
    "q_strain_percentile",
    """SELECT pair_id, round_even(100.0::DOUBLE * (a_le / n), 1) AS a_strain_percentile,
              round_even(100.0::DOUBLE * (b_le / n), 1) AS b_strain_percentile
       FROM (SELECT pair_id, (SELECT count(*)::DOUBLE FROM stacked) AS n, x.le::DOUBLE AS a_le, y.le::DOUBLE AS b_le
             FROM pairs LEFT JOIN cumulative x ON x.strain = a_peak_strain LEFT JOIN cumulative y ON y.strain = b_peak_strain)""",
    extra=PERCENTILE_VIEWS,
)
def q_strain_percentile(spark, folder):
    rows = judgments.strain_percentiles(tables.pairs(spark, folder).select("pair_id", "a_peak_strain", "b_peak_strain"))
    return rows.select("pair_id", "a_strain_percentile", "b_strain_percentile")


@query(
    "q_pair_queue",
    """SELECT pair_id, status, round(pair_peak, 8) AS pair_peak, row_number() OVER (ORDER BY statuses.pair_peak DESC, pair_id) - 1 AS position
       FROM statuses WHERE player_stage = 'novice' AND status = 'open'""",
    extra={"statuses": STATUS_SQL},
)
def q_pair_queue(spark, folder):
    queue = judgments.pair_queue(tables.pairs(spark, folder), stage="novice", status="open")
    return rounded(queue.select("pair_id", "status", "pair_peak", "position"), "pair_peak", digits=8)


@query(
    "q_pair_queue_state",
    """SELECT count(*) AS total_count, CAST(count_if(status = 'judged') AS BIGINT) AS judged_count,
              CAST(count_if(status = 'open') AS BIGINT) AS open_count, CAST(count_if(status = 'uncertain') AS BIGINT) AS uncertain_count,
              CAST(count_if(status = 'out_of_range') AS BIGINT) AS out_of_range_count, CAST(count_if(status = 'tie') AS BIGINT) AS tie_count,
              CAST(count_if(status = 'skip') AS BIGINT) AS skip_count,
              string_agg(DISTINCT player_stage, ',' ORDER BY player_stage) AS stages, string_agg(DISTINCT scope, ',' ORDER BY scope) AS scopes,
              round_even(least(min(a_peak_strain), min(b_peak_strain)), 3) AS strain_min,
              round_even(greatest(max(a_peak_strain), max(b_peak_strain)), 3) AS strain_max,
              CAST(count_if(scope = 'map') AS BIGINT) AS filtered_count, CAST(3 AS BIGINT) AS index,
              any_value(c.pair_id) AS current_pair_id, round(any_value(c.pair_peak), 8) AS current_pair_peak,
              any_value(c.a_share) AS a_strain_percentile, any_value(c.b_share) AS b_strain_percentile
       FROM statuses CROSS JOIN current_pair c""",
    extra={
        **PERCENTILE_VIEWS,
        "statuses": STATUS_SQL,
        "current_pair": """
            SELECT s.pair_id, pair_peak, round_even(100.0::DOUBLE * (x.le::DOUBLE / n), 1) AS a_share, round_even(100.0::DOUBLE * (y.le::DOUBLE / n), 1) AS b_share
            FROM (SELECT * FROM statuses WHERE scope = 'map' ORDER BY pair_peak DESC, pair_id LIMIT 1 OFFSET 3) s CROSS JOIN (SELECT count(*)::DOUBLE AS n FROM stacked) t
            LEFT JOIN cumulative x ON x.strain = a_peak_strain LEFT JOIN cumulative y ON y.strain = b_peak_strain""",
    },
)
def q_pair_queue_state(spark, folder):
    return rounded(judgments.queue_state(tables.pairs(spark, folder), scope="map", index=3), "current_pair_peak", digits=8)


SAVE_SQL = """
    SELECT l_orderkey AS pair_id, l_shipdate, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus,
           CASE l_returnflag WHEN 'A' THEN 'A' WHEN 'R' THEN 'B' ELSE 'tie' END AS choice,
           CASE WHEN l_linenumber % 2 = 0 THEN CAST(CAST(l_quantity AS INT) AS VARCHAR) END AS sure,
           CASE WHEN l_linenumber % 3 = 0 THEN l_linestatus END AS note
    FROM lineitem WHERE l_orderkey IN (SELECT pair_id FROM pairs)"""


@query(
    "q_judgment_upsert",
    """SELECT pair_id, coalesce(c.choice, harder_choice) AS harder_choice, coalesce(s.sure, confidence) AS confidence,
              coalesce(n.note, '') AS notes
       FROM pairs LEFT JOIN last_choice c USING (pair_id) LEFT JOIN last_sure s USING (pair_id) LEFT JOIN last_note n USING (pair_id)""",
    extra={
        "saves": SAVE_SQL,
        **{
            f"last_{name}": f"""
        SELECT pair_id, {name} FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY l_shipdate DESC, l_linenumber DESC,
            l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_returnflag DESC, l_linestatus DESC) AS rn FROM saves WHERE {name} IS NOT NULL)
        WHERE rn = 1"""
            for name in ("choice", "sure", "note")
        },
    },
)
def q_judgment_upsert(spark, folder):
    pairs = tables.pairs(spark, folder).select("pair_id", "harder_choice", "confidence", F.lit("").alias("notes"))
    line = F.col("l_linenumber")
    order = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus"]
    saves = tables.table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("pair_id"),
        *order,
        F.when(F.col("l_returnflag") == "A", "left").when(F.col("l_returnflag") == "R", "b").otherwise("same").alias("harder_choice"),
        F.when(line % 2 == 0, F.col("l_quantity").cast("int").cast("string")).alias("confidence"),
        F.when(line % 3 == 0, F.col("l_linestatus")).alias("notes"),
    )
    known = saves.join(pairs.select("pair_id"), "pair_id", "left_semi")
    return judgments.upsert_judgments(pairs, known, order)
