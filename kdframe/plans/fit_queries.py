"""§2.8 linear distillation runs, run plans, pattern flags; §2.9 user maps; §2.1 sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators import evaluation as ev
from ..operators import fit as ft
from ..operators import fit_sharded as fs
from ..operators import ordering as od
from ..operators.patterns import pattern_flag
from ..operators.udf import map_rows
from ..sources import fixtures as fx
from ..sources import sinks
from ..session import ensure_checkpoint_dir
from ..sources.readers import table
from .eval_queries import ARC, GEN_ARC, SPACE_SQL, SUMMARY_SQL, _arc, _gen_arc, _summary, letter_sql, match_sql, stop_sql
from .registry import register

ITERS = 15
STUDENTS = (ft.StudentSpec("s1", tuple(range(0, 64))), ft.StudentSpec("s2", tuple(range(0, 64, 2))),
            ft.StudentSpec("s3", tuple(range(0, 16))))


TASK_SQL = """
WITH cells AS (SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS j FROM embeddings),
cm AS (SELECT label, j, avg(CAST(v AS DOUBLE)) AS m FROM cells GROUP BY 1, 2),
cent AS (SELECT label, list(m ORDER BY j) AS c FROM cm GROUP BY 1),
task AS (SELECT e.vec_id AS id, e.label, list_transform(e.embedding, lambda x: CAST(x AS DOUBLE)) AS x,
                list(-10.0 * list_sum(list_transform(list_zip(c.c, e.embedding), lambda z: (CAST(z[2] AS DOUBLE) - z[1]) * (CAST(z[2] AS DOUBLE) - z[1]))) ORDER BY c.label) AS t
         FROM embeddings e, cent c GROUP BY ALL)"""


def _lsm(z, t):
    top = f"list_max({z})"
    return f"list_transform({z}, lambda q: (q - {top}) / {t} - ln(list_sum(list_transform({z}, lambda r: exp((r - {top}) / {t})))))"


def _steps_sql(p: str, source: str, x: str, teacher: str, steps: int, t: float = 2.0, alpha: float = 0.5, lr: float = 0.5) -> list[str]:
    """CTEs of ``steps`` gradient steps from zero weights, each written out: {p}h{i} has the loss before step i,
    {p}z{i} the student's logits ``z``.  ``source`` has id, label, feats (all features) and the teacher's logits."""
    ctes, zero = [], f"list_transform({teacher}, lambda q: 0.0::DOUBLE)"
    ctes.append(f"{p}z0 AS MATERIALIZED (SELECT id, label, feats, {x} AS x, {teacher} AS t, {zero} AS z FROM {source})")
    for i in range(steps + 1):
        ctes.append(f"{p}l{i} AS MATERIALIZED (SELECT *, {_lsm('z', t)} AS st, {_lsm('t', t)} AS tt, {_lsm('z', 1.0)} AS s1 FROM {p}z{i})")
        ctes.append(f"""{p}h{i} AS MATERIALIZED (SELECT avg({alpha * t * t} * list_sum(list_transform(list_zip(tt, st), lambda q: exp(q[1]) * (q[1] - q[2])))
                     - {1 - alpha} * s1[label + 1]) AS loss FROM {p}l{i})""")
        if i < steps:
            ctes.append(f"""{p}g{i} AS MATERIALIZED (SELECT id, x, unnest(range(len(z))) AS k, unnest(list_transform(list_zip(st, tt, s1), lambda q, n:
                     {alpha * t} * (exp(q[1]) - exp(q[2])) + {1 - alpha} * (exp(q[3]) - CASE WHEN n - 1 = label THEN 1.0 ELSE 0.0 END))) AS g FROM {p}l{i})""")
            ctes.append(f"{p}w{i} AS MATERIALIZED (SELECT k, j, sum(g * v) / (SELECT count(*) FROM {source}) AS w FROM (SELECT k, g, unnest(x) AS v, unnest(range(len(x))) AS j FROM {p}g{i}) GROUP BY 1, 2)")
            ctes.append(f"{p}v{i} AS MATERIALIZED (SELECT k, list(w ORDER BY j) AS w FROM {p}w{i} GROUP BY 1)")
            ctes.append(f"{p}b{i} AS MATERIALIZED (SELECT k, avg(g) AS b FROM {p}g{i} GROUP BY 1)")
            ctes.append(f"""{p}d{i} AS MATERIALIZED (SELECT l.id, list(list_sum(list_transform(list_zip(v.w, l.x), lambda q: q[1] * q[2])) + b.b ORDER BY v.k) AS d
                     FROM {p}l{i} l, {p}v{i} v JOIN {p}b{i} b ON b.k = v.k GROUP BY 1)""")
            ctes.append(f"""{p}z{i + 1} AS MATERIALIZED (SELECT l.id, l.label, l.feats, l.x, l.t, list_transform(list_zip(l.z, d.d), lambda q: q[1] - {lr} * q[2]) AS z
                     FROM {p}l{i} l JOIN {p}d{i} d ON d.id = l.id)""")
    return ctes


FULL_SQL = f"{TASK_SQL},\nwhole AS MATERIALIZED (SELECT id, label, x AS feats, t AS teach FROM task)"


def fit_sql(steps: int) -> str:
    """(run, step, loss) of a fit over all features."""
    rows = " UNION ALL ".join(f"SELECT 'run' AS run, CAST({i} AS INTEGER) AS step, round(loss, 6) AS loss FROM h{i}" for i in range(steps + 1))
    return ",\n".join([FULL_SQL, *_steps_sql("", "whole", "feats", "teach", steps)]) + f"\n{rows}"


def schedule_sql(mode: str, steps: int) -> str:
    """Last loss and accuracy of each student of a schedule; in a cascade a student's logits teach the next one."""
    ctes, rows, source, teach, teacher = [FULL_SQL], [], "whole", "teach", "teacher"
    for i, s in enumerate(STUDENTS, start=1):
        ctes += _steps_sql(s.name, source, f"list_select(feats, {[j + 1 for j in s.features]})", teach, steps)
        rows.append(f"""SELECT '{mode}' AS mode, CAST({i} AS INTEGER) AS stage, '{teacher}' AS teacher, '{s.name}' AS student,
               round((SELECT loss FROM {s.name}h{steps}), 6) AS final_loss,
               round(avg(CAST(list_position(z, list_max(z)) - 1 = label AS DOUBLE)), 6) AS train_accuracy FROM {s.name}z{steps}""")
        if mode == "cascade":
            source, teach, teacher = f"{s.name}z{steps}", "z", s.name
    return ",\n".join(ctes) + "\n" + " UNION ALL ".join(rows)


def _folder(spark, tag: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{tag}-{uuid.uuid4().hex}"


@register("distil_linear", fit_sql(ITERS))
def q_distil_linear(spark, d):
    _, hist = ft.distil_linear(fx.linear_task(spark, d), "features", "teacher_logits", "label", 2.0, 0.5, ITERS, 0.5)
    return hist.withColumn("loss", F.round("loss", 6))


@register("distil_linear_sharded", fit_sql(5))
def q_distil_linear_sharded(spark, d):
    """Five steps with weights in blocks of three classes and rows in blocks of 300."""
    _, hist = fs.distil_linear_sharded(fx.linear_task(spark, d), "features", "teacher_logits", "label", 2.0, 0.5, 5, 0.5,
                                       class_block=3, row_block=300)
    return hist.withColumn("loss", F.round("loss", 6))


CENT_SQL = """
SELECT label, list(m ORDER BY j) AS c FROM (
  SELECT label, j, avg(CAST(v AS DOUBLE)) AS m FROM (
    SELECT label, unnest(embedding) AS v, unnest(range(len(embedding))) AS j FROM embeddings) GROUP BY 1, 2) GROUP BY 1"""


@register("score_linear", f"""
WITH c AS ({CENT_SQL}),
s AS (SELECT e.vec_id AS id, c.label AS k,
             list_sum(list_transform(list_zip(c.c, e.embedding), lambda z: 2.0 * z[1] * CAST(z[2] AS DOUBLE)))
             - list_sum(list_transform(c.c, lambda v: v * v)) AS logit
      FROM embeddings e, c)
SELECT id, CAST(arg_max(k, logit) AS INTEGER) AS pred, round(max(logit), 6) AS max_logit FROM s GROUP BY id""")
def q_score_linear(spark, d):
    cents = fx.class_centroids(spark, d).agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("_cs"))       # one row a class
    square = lambda c: F.aggregate(c, F.lit(0.0), lambda acc, v: acc + v * v)
    model = cents.select(F.transform("_cs", lambda x: F.transform(x["c"], lambda v: v * 2.0)).alias("W"),
                         F.transform("_cs", lambda x: -square(x["c"])).alias("b"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    s = ft.score_linear(e, "embedding", model)
    best = F.array_max("logits")
    return s.select("id", (F.array_position("logits", best) - 1).cast("int").alias("pred"), F.round(best, 6).alias("max_logit"))


def _rounded(summary):
    return summary.withColumn("final_loss", F.round("final_loss", 6)).withColumn("train_accuracy", F.round("train_accuracy", 6))


@register("distil_control", schedule_sql("control", ITERS))
def q_distil_control(spark, d):
    summary, _ = ft.distil_control(fx.linear_task(spark, d), STUDENTS, iters=ITERS, temperature=2.0, alpha=0.5, lr=0.5)
    return _rounded(summary)


@register("distil_cascade", schedule_sql("cascade", ITERS))
def q_distil_cascade(spark, d):
    summary, _ = ft.distil_cascade(fx.linear_task(spark, d), STUDENTS, iters=ITERS, temperature=2.0, alpha=0.5, lr=0.5)
    return _rounded(summary)


@register("run_plan", """
WITH s AS (SELECT CAST(row_number() OVER (ORDER BY p_brand) AS INTEGER) AS stage, p_brand AS student
           FROM (SELECT DISTINCT p_brand FROM part)),
g AS (SELECT m.mode, s.stage, s.student FROM s, (VALUES ('control'), ('cascade')) m(mode))
SELECT mode, stage,
       CASE WHEN mode = 'control' THEN 'teacher'
            ELSE coalesce(lag(student) OVER (PARTITION BY mode ORDER BY stage), 'teacher') END AS teacher,
       student, replace(student, '/', '_') AS label,
       mode || '/stage_' || CAST(stage AS VARCHAR) || '_' || replace(student, '/', '_') AS out_dir
FROM g""")
def q_run_plan(spark, d):
    brands = table(spark, d, "part").select(F.col("p_brand").alias("student")).distinct()
    staged = od.global_index(brands, ["student"], name="stage").withColumn("stage", F.col("stage") + 1)
    return ft.run_plan(staged, "teacher")


@register("pattern_flag", """
SELECT p_partkey, p_name AS name, len(list_filter(['red', 'bolt'], lambda p: instr(p_name, p) > 0)) > 0 AS flag FROM part""")
def q_pattern_flag(spark, d):
    return pattern_flag(fx.names(spark, d), "name", fx.patterns(spark)).select("p_partkey", "name", "flag")


@register("map_rows", f"""
SELECT doc_id, CAST(len(regexp_extract_all(text, '[^{SPACE_SQL}]+')) AS BIGINT) AS n_words FROM documents""")
def q_map_rows(spark, d):
    def words(pdf):
        return pdf.assign(n_words=pdf["text"].fillna("").str.split().str.len().astype("int64"))[["doc_id", "n_words"]]
    return map_rows(table(spark, d, "documents").select("doc_id", "text"), words, "doc_id long, n_words long")


@register("write_eval_csv", f"""
SELECT g.model, g.dataset, g.shot, g.item_id, i.question, to_json(i.choices.text) AS choices, i.answerKey AS gold,
       coalesce({letter_sql(stop_sql('g.generation'))}, {match_sql(stop_sql('g.generation'), 'i.choices.text')}) AS pred,
       coalesce(coalesce({letter_sql(stop_sql('g.generation'))}, {match_sql(stop_sql('g.generation'), 'i.choices.text')}) = i.answerKey, false) AS correct,
       {stop_sql('g.generation')} AS generation
FROM ({GEN_ARC}) g JOIN ({ARC}) i ON i.item_id = g.item_id""")
def q_write_eval_csv(spark, d):
    rows, path = ev.score_arc(_gen_arc(spark, d), _arc(spark, d)), _folder(spark, "eval-csv")
    sinks.write_eval_csv(rows, path)
    keys = ["model", "dataset", "shot"]
    back = sinks.read_csv(spark, path, StructType([f for f in sinks.eval_csv_frame(rows).schema.fields if f.name not in keys]
                                                  + [StructField(k, StringType()) for k in keys]))
    return back.select(*rows.columns)


@register("write_summary_csv", SUMMARY_SQL)
def q_write_summary_csv(spark, d):
    s, path = _summary(spark, d), _folder(spark, "summary-csv")
    sinks.write_summary_csv(s, path)
    return sinks.read_csv(spark, path, s.schema).select("model", "dataset", "shot", F.round("accuracy", 6).alias("accuracy"), "num")


@register("write_results_json", f"SELECT replace(model, 'model', 'student') AS student, model, dataset, shot, accuracy, num FROM ({SUMMARY_SQL})")
def q_write_results_json(spark, d):
    s = _summary(spark, d).withColumn("student", F.regexp_replace("model", "model", "student"))
    path = _folder(spark, "results-json")
    sinks.write_results_json(s, path)
    row = "struct<model:string,dataset:string,shot:string,accuracy:double,num:bigint>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,struct<eval_summary:array<{row}>>>").alias("m"))
    return (doc.select(F.explode("m").alias("student", "v")).select("student", F.inline("v.eval_summary"))
            .withColumn("accuracy", F.round("accuracy", 6)))


@register("write_fit_log", fit_sql(5))
def q_write_fit_log(spark, d):
    path = _folder(spark, "fit-log")
    ft.distil_and_log(fx.linear_task(spark, d), "features", "teacher_logits", "label", path, temperature=2.0, alpha=0.5, iters=5, lr=0.5)
    log = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<struct<run:string,step:int,loss:double>>").alias("l"))
    return log.select(F.inline("l")).withColumn("loss", F.round("loss", 6))
