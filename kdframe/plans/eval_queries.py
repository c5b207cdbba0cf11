"""§2.7 few-shot prompts, answer extraction, scoring and accuracy tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import evaluation as ev
from ..operators import ordering as od
from ..operators import tokens as tk
from ..sources import fixtures as fx
from ..sources.readers import literal_table, table
from .registry import register
from .sqlparts import md5_key
from .token_queries import encode_sql, vocab_sql

SEED = 42
NL = "chr(10)"
GSM = fx.GSM_SQL
ARC = fx.ARC_SQL
GEN_GSM = fx.generations_sql(GSM, "GSM8K")
GEN_ARC = fx.generations_sql(ARC, "ARC-Challenge")


# Patterns of the SQL twins, written from the semantics and sharing nothing with the library:
# white space as Unicode defines it for str.strip, digits, standalone letters, word characters.
SPACE_SQL = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
DIGITS_SQL = r"-?\d+"
LETTER_SQL = r"(?:^|[^\pL\pN_])([A-D])(?:[^\pL\pN_]|$)"
KEYWORD_SQL = rf"(?i:choice|answer)[:{SPACE_SQL}]*([ABCDabcd])"
WORDS_SQL = r"[_\pL\pN]+"


def py_strip_sql(x):
    return f"regexp_replace({x}, '^[{SPACE_SQL}]+|[{SPACE_SQL}]+$', '', 'g')"


def stop_sql(x):
    pos = (f"list_min(list_filter([instr({x}, {NL} || 'Q:'), instr({x}, {NL} || 'Question:'), "
           f"instr({x}, {NL} || 'A:')], lambda p: p > 0))")
    cut = f"(CASE WHEN {pos} IS NULL THEN coalesce({x}, '') ELSE substr({x}, 1, {pos} - 1) END)"
    return py_strip_sql(cut)


def last_int_sql(x):
    last = f"regexp_extract_all(replace({x}, ',', ''), '{DIGITS_SQL}')[-1]"
    digits = f"(CASE WHEN regexp_replace({last}, '^-?0*', '') = '' THEN '0' ELSE regexp_replace({last}, '^-?0*', '') END)"
    return (f"(CASE WHEN {last} IS NULL THEN NULL WHEN starts_with({last}, '-') AND {digits} <> '0' "
            f"THEN '-' || {digits} ELSE {digits} END)")


def letter_sql(x):
    return (f"coalesce(nullif(regexp_extract(upper({x}), '{LETTER_SQL}', 1), ''), "
            f"nullif(upper(regexp_extract({x}, '{KEYWORD_SQL}', 1)), ''))")


def _wset(x):
    return f"list_distinct(regexp_extract_all(lower({x}), '{WORDS_SQL}'))"


def match_sql(g, ch):
    sub = (f"list_filter(list_transform({ch}, lambda c, i: CASE WHEN c IS NOT NULL AND c <> '' "
           f"AND instr(lower({g}), lower(c)) > 0 THEN i - 1 ELSE NULL END), lambda v: v IS NOT NULL)[1]")
    scores = (f"list_transform({ch}, lambda c: CASE WHEN c IS NULL OR len({_wset('c')}) = 0 OR len({_wset(g)}) = 0 "
              f"THEN 0.0 ELSE len(list_intersect({_wset(g)}, {_wset('c')})) / "
              f"greatest(1, len(list_distinct(list_concat({_wset(g)}, {_wset('c')})))) END)")
    jac = (f"(CASE WHEN list_max({scores}) > 0.1 THEN list_position({scores}, list_max({scores})) - 1 END)")
    return (f"(CASE WHEN {g} IS NULL OR {g} = '' OR {ch} IS NULL OR len({ch}) = 0 THEN NULL "
            f"ELSE chr(CAST(65 + coalesce({sub}, {jac}) AS INTEGER)) END)")


def choices_sql(ch):
    return f"array_to_string(list_transform({ch}, lambda x, i: chr(CAST(64 + i AS INTEGER)) || ') ' || coalesce(x, '')), {NL})"


def _block_sql(rows_sql, demo_expr, n, sep=NL):
    return f"""
SELECT coalesce(array_to_string(list(d ORDER BY k, item_id), {sep}), '') AS demos, CAST(count(*) AS INTEGER) AS n_demos
FROM (SELECT item_id, {md5_key(SEED, 'item_id')} AS k, {demo_expr} AS d FROM ({rows_sql})
      ORDER BY k, item_id LIMIT {n})"""


Q = "coalesce(question, '')"
A = "coalesce(answer, '')"
GSM_LOOP_DEMO = f"'Question: ' || {Q} || {NL} || 'Answer: ' || {py_strip_sql(A)} || {NL}"
GSM_BUILDER_DEMO = f"'Question: ' || {py_strip_sql(Q)} || {NL} || 'Answer: ' || {py_strip_sql(A)} || {NL}"
ARC_BUILDER_DEMO = (f"'Question: ' || {py_strip_sql(Q)} || {NL} || "
                    f"{choices_sql('choices.text')} || {NL} || 'Answer: ' || coalesce(answerKey, '') || {NL}")


def arc_answer_sql():
    text, labels, key = "choices.text", "choices.label", "coalesce(answerKey, '')"
    pos = f"coalesce(list_position({labels}, {key}), 0)"
    idx = f"(CASE WHEN {key} = '' THEN NULL WHEN {pos} > 0 THEN {pos} - 1 ELSE 0 END)"
    ct = (f"(CASE WHEN {idx} IS NOT NULL AND {idx} < len({text}) THEN {text}[{idx} + 1] "
          f"WHEN len({text}) > 0 THEN {text}[1] ELSE '' END)")
    return f"(CASE WHEN coalesce({ct}, '') <> '' THEN {ct} ELSE {py_strip_sql(key)} END)"


ARC_LOOP_DEMO = f"'Question: ' || coalesce(question, '') || {NL} || {arc_answer_sql()} || {NL}"


def _gsm(spark, d):
    return fx.gsm_items(spark, d)


def _arc(spark, d):
    return fx.arc_items(spark, d)


@register("zero_shot_prompt", f"SELECT item_id, 'Question: ' || question || {NL} || 'Answer:' AS prompt FROM ({GSM})")
def q_zero_shot_prompt(spark, d):
    return _gsm(spark, d).select("item_id", tx.zero_shot_prompt("question").alias("prompt"))


@register("format_choices", f"SELECT item_id, {choices_sql('choices.text')} AS options FROM ({ARC})")
def q_format_choices(spark, d):
    return _arc(spark, d).select("item_id", tx.format_choices("choices.text").alias("options"))


@register("gsm_demo_block", _block_sql(GSM, GSM_BUILDER_DEMO, 3))
def q_gsm_demo_block(spark, d):
    return ev.gsm_demo_block(_gsm(spark, d), 3, SEED, strip_q=True)


@register("arc_demo_block", _block_sql(ARC, ARC_BUILDER_DEMO, 3))
def q_arc_demo_block(spark, d):
    return ev.arc_demo_block(_arc(spark, d), 3, SEED)


@register("arc_demo_block_text", _block_sql(ARC, ARC_LOOP_DEMO, 3))
def q_arc_demo_block_text(spark, d):
    return ev.arc_demo_block_text(_arc(spark, d), 3, SEED)


@register("shot_pool", f"""
SELECT item_id, row_number() OVER (ORDER BY {md5_key(SEED, 'item_id')}, item_id) - 1 AS pool_idx FROM ({GSM})
QUALIFY pool_idx < 50""")
def q_shot_pool(spark, d):
    return ev.shot_pool(_gsm(spark, d), 3, SEED).select("item_id", "pool_idx")


@register("few_shot_prompt_gsm", f"""
SELECT g.item_id, b.demos || {NL} || 'Question: ' || g.question || {NL} || 'Answer:' AS prompt
FROM ({GSM}) g, ({_block_sql(GSM, GSM_LOOP_DEMO, 3)}) b""")
def q_few_shot_prompt_gsm(spark, d):
    g = _gsm(spark, d)
    demos = ev.gsm_demo_block(g, 3, SEED, strip_q=False)
    fb = ev.gsm_demo_block(g, 3, SEED, strip_q=True)
    return ev.few_shot_prompt_gsm(g, demos, 3, fallback=fb).select("item_id", "prompt")


@register("few_shot_prompt_arc", f"""
SELECT a.item_id, b.demos || {NL} || 'Question: ' || a.question || {NL} || {choices_sql('a.choices.text')} || {NL} || 'Answer:' AS prompt
FROM ({ARC}) a, ({_block_sql(ARC, ARC_LOOP_DEMO, 3)}) b""")
def q_few_shot_prompt_arc(spark, d):
    a = _arc(spark, d)
    fb = ev.arc_demo_block(a, 3, SEED)
    return ev.few_shot_prompt_arc(a, ev.arc_demo_block_text(a, 3, SEED), 3, fallback=fb).select("item_id", "prompt")


@register("qa_prompt", f"""
SELECT m.item_id, b.demos || {NL} || 'Q: ' || m.problem || {NL} || 'A:' AS prompt
FROM (SELECT item_id, text AS problem FROM benchmark) m,
     (SELECT array_to_string(list('Q: ' || question || {NL} || 'A: ' || answer ORDER BY item_id), {NL}) AS demos
      FROM (SELECT * FROM ({GSM}) ORDER BY item_id LIMIT 2)) b""")
def q_qa_prompt(spark, d):
    shots = od.bounded_head(_gsm(spark, d), ["item_id"], 2)
    demos = shots.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(
        "item_id", F.concat(F.lit("Q: "), "question", F.lit("\nA: "), "answer").alias("t")))), lambda x: x["t"]), "\n").alias("demos"))
    test = fx.math_items(spark, d).withColumnRenamed("problem", "question")
    return ev.qa_prompt(test, demos).select("item_id", "prompt")


@register("eval_grid", f"""
SELECT m.model, g.item_id, s.shot FROM ({GSM}) g, (VALUES ('modelA'), ('modelB')) m(model),
       (VALUES ('0-shot'), ('1-shot'), ('3-shot')) s(shot)""")
def q_eval_grid(spark, d):
    models = literal_table(spark, [(m,) for m in fx.MODELS], "model string")
    return ev.eval_grid(spark, models, _gsm(spark, d).select("item_id")).select("model", "item_id", "shot")


@register("strip_prompt", f"""
SELECT q.item_id, array_to_string(a.ids, ' ') AS continuation
FROM ({encode_sql(GSM, 'item_id', 'question', vocab_sql())}) q JOIN ({encode_sql(GSM, 'item_id', 'answer', vocab_sql())}) a
  ON a.item_id = q.item_id""")
def q_strip_prompt(spark, d):
    g = _gsm(spark, d)
    vocab = tk.fit_vocab(table(spark, d, "documents"), "text", 4096)
    e = tk.encode_columns(g, {"q_ids": "question", "a_ids": "answer"}, vocab)
    out = e.withColumn("out_ids", F.concat("q_ids", "a_ids"))
    return out.select("item_id", F.array_join(tx.strip_prompt("out_ids", "q_ids"), " ").alias("continuation"))


STOP_TEXTS = f"""
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN replace(text, '. ', '.' || {NL} || 'Q: ')
                               WHEN 1 THEN replace(text, '. ', '.' || {NL} || 'Question: ')
                               WHEN 2 THEN replace(text, '. ', '.' || chr(8195) || {NL} || 'A: ') ELSE text END AS text
FROM documents"""


def _stop_texts(spark, d):
    """Whole documents with one of the three stop markers after every sentence for three of four."""
    doc = table(spark, d, "documents")
    t = F.col("text")
    marked = (F.when(F.col("doc_id") % 4 == 0, F.replace(t, F.lit(". "), F.lit(".\nQ: ")))
              .when(F.col("doc_id") % 4 == 1, F.replace(t, F.lit(". "), F.lit(".\nQuestion: ")))
              .when(F.col("doc_id") % 4 == 2, F.replace(t, F.lit(". "), F.lit(".\u2003\nA: "))).otherwise(t))
    return doc.select("doc_id", marked.alias("text"))


@register("truncate_at_stop", f"SELECT doc_id, {stop_sql('text')} AS cut FROM ({STOP_TEXTS})")
def q_truncate_at_stop(spark, d):
    return _stop_texts(spark, d).select("doc_id", tx.truncate_at_stop("text").alias("cut"))


@register("extract_last_integer", f"SELECT doc_id, {last_int_sql('text')} AS last_int FROM documents")
def q_extract_last_integer(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.extract_last_integer("text").alias("last_int"))


def _gen_arc(spark, d):
    return fx.generations(spark, d, _arc(spark, d), "ARC-Challenge")


def _gen_gsm(spark, d):
    return fx.generations(spark, d, _gsm(spark, d), "GSM8K")


@register("extract_choice_letter", f"SELECT model, shot, item_id, {letter_sql('generation')} AS letter FROM ({GEN_ARC})")
def q_extract_choice_letter(spark, d):
    return _gen_arc(spark, d).select("model", "shot", "item_id", tx.extract_choice_letter("generation").alias("letter"))


@register("match_choice_by_text", f"""
SELECT g.model, g.shot, g.item_id, {match_sql('g.generation', 'a.choices.text')} AS matched
FROM ({GEN_ARC}) g JOIN ({ARC}) a ON a.item_id = g.item_id""")
def q_match_choice_by_text(spark, d):
    j = _gen_arc(spark, d).join(_arc(spark, d).select("item_id", "choices"), "item_id")
    return j.select("model", "shot", "item_id", tx.match_choice_by_text("generation", "choices.text").alias("matched"))


@register("predict_choice", f"""
SELECT g.model, g.shot, g.item_id, coalesce({letter_sql('g.generation')}, {match_sql('g.generation', 'a.choices.text')}) AS pred
FROM ({GEN_ARC}) g JOIN ({ARC}) a ON a.item_id = g.item_id""")
def q_predict_choice(spark, d):
    j = _gen_arc(spark, d).join(_arc(spark, d).select("item_id", "choices"), "item_id")
    return j.select("model", "shot", "item_id", tx.predict_choice("generation", "choices.text").alias("pred"))


SCORED_GSM = f"""
SELECT g.model, g.dataset, g.shot, g.item_id, {last_int_sql('i.answer')} AS gold, {last_int_sql(stop_sql('g.generation'))} AS pred
FROM ({GEN_GSM}) g JOIN ({GSM}) i ON i.item_id = g.item_id"""

SCORED_ARC = f"""
SELECT g.model, g.dataset, g.shot, g.item_id, i.answerKey AS gold,
       coalesce({letter_sql(stop_sql('g.generation'))}, {match_sql(stop_sql('g.generation'), 'i.choices.text')}) AS pred
FROM ({GEN_ARC}) g JOIN ({ARC}) i ON i.item_id = g.item_id"""


@register("score_gsm", f"SELECT model, shot, item_id, gold, pred, coalesce(pred = gold, false) AS correct FROM ({SCORED_GSM})")
def q_score_gsm(spark, d):
    s = ev.score_gsm(_gen_gsm(spark, d), _gsm(spark, d))
    return s.select("model", "shot", "item_id", "gold", "pred", "correct")


@register("score_arc", f"SELECT model, shot, item_id, gold, pred, coalesce(pred = gold, false) AS correct FROM ({SCORED_ARC})")
def q_score_arc(spark, d):
    s = ev.score_arc(_gen_arc(spark, d), _arc(spark, d))
    return s.select("model", "shot", "item_id", "gold", "pred", "correct")


SUMMARY_SQL = f"""
WITH s AS (SELECT model, dataset, shot, coalesce(pred = gold, false) AS correct FROM ({SCORED_GSM})
           UNION ALL SELECT model, dataset, shot, coalesce(pred = gold, false) FROM ({SCORED_ARC})),
a AS (SELECT model, dataset, shot, avg(CAST(correct AS DOUBLE)) AS accuracy, count(*) AS num FROM s GROUP BY 1, 2, 3),
grid AS (SELECT m.model, ds.dataset, sh.shot FROM (VALUES ('modelA'), ('modelB'), ('modelC')) m(model),
         (VALUES ('GSM8K'), ('ARC-Challenge')) ds(dataset), (VALUES ('0-shot'), ('1-shot'), ('3-shot')) sh(shot))
SELECT grid.model, grid.dataset, grid.shot, round(coalesce(a.accuracy, 0.0), 6) AS accuracy, CAST(coalesce(a.num, 0) AS BIGINT) AS num
FROM grid LEFT JOIN a ON a.model = grid.model AND a.dataset = grid.dataset AND a.shot = grid.shot"""


def _summary(spark, d):
    scored = ev.score_gsm(_gen_gsm(spark, d), _gsm(spark, d)).select("model", "dataset", "shot", "correct").unionByName(
        ev.score_arc(_gen_arc(spark, d), _arc(spark, d)).select("model", "dataset", "shot", "correct"))
    grid = (literal_table(spark, [(m,) for m in (*fx.MODELS, "modelC")], "model string")
            .crossJoin(literal_table(spark, [("GSM8K",), ("ARC-Challenge",)], "dataset string"))
            .crossJoin(literal_table(spark, [(s,) for s in ("0-shot", "1-shot", "3-shot")], "shot string")))
    return ev.accuracy_summary(scored, grid)


@register("accuracy_summary", SUMMARY_SQL)
def q_accuracy_summary(spark, d):
    s = _summary(spark, d)
    return s.select("model", "dataset", "shot", F.round("accuracy", 6).alias("accuracy"), "num")


@register("accuracy_pivot", f"""
SELECT dataset, model, max(accuracy) FILTER (WHERE shot = '0-shot') AS "0-shot",
       max(accuracy) FILTER (WHERE shot = '1-shot') AS "1-shot", max(accuracy) FILTER (WHERE shot = '3-shot') AS "3-shot"
FROM ({SUMMARY_SQL}) GROUP BY dataset, model""")
def q_accuracy_pivot(spark, d):
    s = _summary(spark, d).withColumn("accuracy", F.round("accuracy", 6))
    return ev.accuracy_pivot(s)


@register("model_label", """
SELECT p_partkey, replace(p_brand || '/' || p_name, '/', '_') || '_control' AS label_control,
       replace(p_brand || '/' || p_name, '/', '_') || '_cascade' AS label_cascade FROM part""")
def q_model_label(spark, d):
    p = table(spark, d, "part").withColumn("_name", F.concat_ws("/", "p_brand", "p_name"))
    return p.select("p_partkey", tx.model_label("_name", suffix="_control").alias("label_control"),
                    tx.model_label("_name", suffix="_cascade").alias("label_cascade"))


@register("generate_batch", f"""
SELECT item_id, array_to_string(w[greatest(len(w) - 7, 1):], ' ') AS generation
FROM (SELECT item_id, regexp_extract_all('Question: ' || question || {NL} || 'Answer:', '[^{SPACE_SQL}]+') AS w FROM ({GSM}))""")
def q_generate_batch(spark, d):
    def last_words(prompts, n=8):
        """Stand-in generator for the hook: echoes the last n words of each prompt."""
        return [" ".join(p.split()[-n:]) for p in prompts]

    p = _gsm(spark, d).select("item_id", tx.zero_shot_prompt("question").alias("prompt"))
    return ev.generate_batch(p, last_words).select("item_id", "generation")
