"""Quality of predictions: confusion, panels, paired tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quernstone.functions.text import assemble
from quernstone.operators import evaluation as ev
from quernstone.plans.base import predictions, sql

def _cols():
    return F.col("gold"), F.col("pred_old"), F.col("pred_new")


def q_confusion(spark, d):
    G, OLD, NEW = _cols()
    return ev.confusion(predictions(spark, d).where("gold IN ('y', 'n')"), G, OLD)


def q_metrics_by_group(spark, d):
    G, OLD, NEW = _cols()
    return ev.confusion(predictions(spark, d).where("gold IN ('y', 'n')"), G, NEW, ["split"])


def q_metrics_decided(spark, d):
    """Metrics without undecided predictions, and how many were left out."""
    G, OLD, NEW = _cols()
    p = predictions(spark, d).where("gold IN ('y', 'n')")
    return ev.confusion(p.where("pred_new <> 'u'"), G, NEW).crossJoin(p.agg(F.count_if(NEW == "u").alias("excluded")))


def q_panel(spark, d):
    G, OLD, NEW = _cols()
    return predictions(spark, d).select("post_id", "split", ev.error_type(G, NEW).alias("error_type"), (G.isin("y", "n") & NEW.isin("y", "n") & (G == NEW)).alias("is_correct"), F.length(assemble(F.col("title"), F.col("selftext"))).alias("n_chars"))


def q_false_positives(spark, d):
    return predictions(spark, d).where("gold = 'n' AND pred_new = 'y'").select("post_id", "course_code", F.lit("replies").alias("run"))


def q_mcnemar(spark, d):
    G, OLD, NEW = _cols()
    return ev.paired(predictions(spark, d), G, OLD, NEW).select("b", "c", "n", F.round("p_value", 6).alias("p_value"))


def q_label_shift(spark, d):
    G, OLD, NEW = _cols()
    return ev.label_shift(predictions(spark, d), OLD, NEW).select(F.round("chi2", 6).alias("chi2"), "dof")


def q_prediction_distribution(spark, d):
    G, OLD, NEW = _cols()
    p = predictions(spark, d)
    return p.select(F.explode(F.array(F.struct(F.lit("old").alias("version"), OLD.alias("label")), F.struct(F.lit("new").alias("version"), NEW.alias("label")))).alias("x")).groupBy("x.version", "x.label").agg(F.count(F.lit(1)).alias("n"))


def q_gate_decision(spark, d):
    G, OLD, NEW = _cols()
    p = predictions(spark, d)
    decided = p.where("gold IN ('y', 'n')")
    tests = ev.paired(p, G, OLD, NEW)
    f1 = ev.confusion(decided, G, OLD).select(F.col("f1").alias("f1_old")).crossJoin(ev.confusion(decided, G, NEW).select(F.col("f1").alias("f1_new")))
    return tests.crossJoin(f1).select(ev.gate(F.col("b"), F.col("c"), F.col("p_value"), F.col("f1_old"), F.col("f1_new")).alias("decision"), "f1_old", "f1_new")


_K = "count(*) FILTER (gold = 'y' AND {p} = 'y') AS tp, count(*) FILTER (gold = 'n' AND {p} = 'y') AS fp, count(*) FILTER (gold = 'y' AND {p} <> 'y') AS fn, count(*) FILTER (gold = 'n' AND {p} <> 'y') AS tn"


def _metrics(pred: str, where: str = "", group: str = "") -> str:
    g = f"{group}, " if group else ""
    inner = f"SELECT {g}{_K.format(p=pred)} FROM preds WHERE gold IN ('y', 'n') {where} {'GROUP BY ' + group if group else ''}"
    pr = f"SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM ({inner})"
    return f"SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1, CASE WHEN tp + fp + fn + tn > 0 THEN (tp + tn) / (tp + fp + fn + tn) ELSE 0.0 END AS accuracy FROM ({pr})"


_BC = "SELECT count(*) FILTER (pred_old = gold AND pred_new <> gold) AS b, count(*) FILTER (pred_old <> gold AND pred_new = gold) AS c, count(*) AS n FROM preds WHERE gold IN ('y', 'n') AND pred_old IN ('y', 'n') AND pred_new IN ('y', 'n')"
_P = f"SELECT b, c, n, least(1.0, 2 * (SELECT sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) FROM (SELECT unnest(range(0, least(b, c) + 1)) AS i))) AS p_value FROM ({_BC})"
QUERIES = {k: v for k, v in globals().items() if k.startswith("q_")}
ORACLE = {
    "q_confusion": sql(_metrics("pred_old"), "preds"),
    "q_metrics_by_group": sql(_metrics("pred_new", group="split"), "preds"),
    "q_metrics_decided": sql("SELECT m.*, e.excluded FROM (" + _metrics("pred_new", "AND pred_new <> 'u'") + ") m, (SELECT count(*) FILTER (pred_new = 'u') AS excluded FROM preds WHERE gold IN ('y', 'n')) e", "preds"),
    "q_panel": sql("SELECT post_id, split, CASE WHEN gold IS NULL OR gold NOT IN ('y', 'n') THEN 'unknown' WHEN gold = 'y' THEN CASE WHEN pred_new = 'y' THEN 'tp' ELSE 'fn' END ELSE CASE WHEN pred_new = 'y' THEN 'fp' ELSE 'tn' END END AS error_type, gold IN ('y', 'n') AND pred_new IN ('y', 'n') AND gold = pred_new AS is_correct, CAST(length(CASE WHEN coalesce(selftext, '') = '' THEN coalesce(title, '') WHEN coalesce(title, '') = '' THEN selftext ELSE title || chr(10) || chr(10) || selftext END) AS INT) AS n_chars FROM preds", "preds"),
    "q_false_positives": sql("SELECT post_id, course_code, 'replies' AS run FROM preds WHERE gold = 'n' AND pred_new = 'y'", "preds"),
    "q_mcnemar": sql(f"SELECT b, c, n, round(p_value, 6) AS p_value FROM ({_P})", "preds"),
    "q_label_shift": sql("SELECT round(sum((o - eo) * (o - eo) / eo + (n - en) * (n - en) / en), 6) AS chi2, count(*) - 1 AS dof FROM (SELECT o, n, (o + n) * so / (so + sn) AS eo, (o + n) * sn / (so + sn) AS en FROM (SELECT *, sum(o) OVER () AS so, sum(n) OVER () AS sn FROM (SELECT label, count(*) FILTER (v = 'o') AS o, count(*) FILTER (v = 'n') AS n FROM (SELECT pred_old AS label, 'o' AS v FROM preds UNION ALL SELECT pred_new, 'n' FROM preds) GROUP BY 1)))", "preds"),
    "q_prediction_distribution": sql("SELECT version, label, count(*) AS n FROM (SELECT 'old' AS version, pred_old AS label FROM preds UNION ALL SELECT 'new', pred_new FROM preds) GROUP BY 1, 2", "preds"),
    "q_gate_decision": sql(f"SELECT CASE WHEN y.f1 < x.f1 THEN 'reject_f1_regression' WHEN p_value < 0.05 AND c > b THEN 'accept_improvement' ELSE 'reject_no_improvement' END AS decision, x.f1 AS f1_old, y.f1 AS f1_new FROM ({_P}), ({_metrics('pred_old')}) x, ({_metrics('pred_new')}) y", "preds"),
}
