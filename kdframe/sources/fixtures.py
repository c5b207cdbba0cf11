"""Representative inputs of the distillation scripts, derived from the driver tables.

Each derivation has a DataFrame form (used by the library and the registered queries) and a
plain-SQL form (``*_SQL``) that the DuckDB oracle repeats.  Both read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.arrays import idiv
from .readers import literal_table, table

# Fixed values of the derivations.
MODELS = ("modelA", "modelB")
ARC_LETTERS = ("A", "B", "C", "D")
PATTERNS = ("red", "bolt")
EX_POSITIONS = 8          # positions per example in the logit fixtures
STUDENT_LAYERS, STUDENT_DIM = 4, 16
TEACHER_LAYERS, TEACHER_DIM = 8, 8
STUDENT_VOCAB_CUT = 60
EXAMPLES_PER_BATCH = 2
PAIRS_PER_BATCH = 4
CONVS_PER_BATCH = 8
PAIR_STRIDE = 1 << 20    # pair_id = conv_id * PAIR_STRIDE + number of the pair in its conversation
VOCAB_SIZE = 4096
SPECIALS = ("<unk>", "<eos>")


def sharegpt(spark: SparkSession, d: str) -> DataFrame:
    """(conv_id, conversations ARRAY<STRUCT<from, value>>) in turn order."""
    c = table(spark, d, "conversations")
    frm = (F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt")
           .otherwise(F.col("role")))
    turns = F.array_sort(F.collect_list(F.struct("turn", frm.alias("from"), F.col("text").alias("value"))))
    return (c.groupBy("conv_id").agg(turns.alias("_t"))
            .select("conv_id", F.transform("_t", lambda x: F.struct(x["from"].alias("from"),
                                                                   x["value"].alias("value"))).alias("conversations")))


SHAREGPT_SQL = """
SELECT conv_id,
       list({'from': CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END,
             'value': text} ORDER BY turn) AS conversations
FROM conversations GROUP BY conv_id"""


def dpo_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, system, question, chosen, rejected): one pair for each two neighbouring assistant
    turns of a conversation; the question is all turns before the first of them (system turns
    apart), one a line; the system text is the first system turn."""
    c = table(spark, d, "conversations")
    g = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("_t"))
    answers = F.filter("_t", lambda x: x["role"] == "assistant")
    g = g.withColumn("_a", answers).where(F.size("_a") >= 2)
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.size("_a") - 1), lambda i: F.struct(
        i.alias("i"), F.element_at("_a", i).alias("c"), F.element_at("_a", i + 1).alias("r"))))
    g = g.select("conv_id", "_t", pair.alias("_p"))
    before = F.filter("_t", lambda x: (x["role"] != "system") & (x["turn"] < F.col("_p.c.turn")))
    system = F.filter("_t", lambda x: x["role"] == "system")
    return g.select((F.col("conv_id") * PAIR_STRIDE + F.col("_p.i")).alias("pair_id"),
                    F.coalesce(F.try_element_at(system, F.lit(1))["text"], F.lit("")).alias("system"),
                    F.array_join(F.transform(before, lambda x: x["text"]), "\n").alias("question"),
                    F.col("_p.c.text").alias("chosen"), F.col("_p.r.text").alias("rejected"))


DPO_PAIRS_SQL = f"""
SELECT a.conv_id * {PAIR_STRIDE} + a.i AS pair_id, coalesce(any_value(s.text), '') AS system,
       coalesce(string_agg(b.text, chr(10) ORDER BY b.turn), '') AS question, any_value(a.chosen) AS chosen,
       any_value(a.rejected) AS rejected
FROM (SELECT conv_id, turn, text AS chosen, lead(text) OVER w AS rejected, lead(turn) OVER w AS after, row_number() OVER w AS i
      FROM conversations WHERE role = 'assistant' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) a
LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.role <> 'system' AND b.turn < a.turn
LEFT JOIN (SELECT conv_id, arg_min(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY 1) s ON s.conv_id = a.conv_id
WHERE a.after IS NOT NULL GROUP BY a.conv_id, a.i"""


def gsm_items(spark: SparkSession, d: str) -> DataFrame:
    """Math QA from whole documents: answer = the last line and a final ``#### number`` line, question =
    everything before the last line (a single-line document is both question and answer)."""
    doc = table(spark, d, "documents")
    ans = F.substring_index("text", "\n", -1)
    q = F.when(F.instr("text", "\n") > 0, F.expr("substring(text, 1, length(text) - length(substring_index(text, '\\n', -1)) - 1)")
               ).otherwise(F.col("text"))
    number = F.concat(F.lit("\n#### "), (F.col("doc_id") * 37 % 1000).cast("string"))
    return doc.select(F.col("doc_id").alias("item_id"), q.alias("question"), F.concat(ans, number).alias("answer"))


GSM_SQL = """
SELECT doc_id AS item_id,
       CASE WHEN instr(text, chr(10)) > 0 THEN left(text, length(text) - length(string_split(text, chr(10))[-1]) - 1)
            ELSE text END AS question,
       string_split(text, chr(10))[-1] || chr(10) || '#### ' || CAST(doc_id * 37 % 1000 AS VARCHAR) AS answer FROM documents"""


def arc_items(spark: SparkSession, d: str) -> DataFrame:
    """Multiple choice: parts grouped by p_partkey div 4; options = 'p_name p_partkey' in key order."""
    p = table(spark, d, "part")
    g = (p.groupBy(idiv("p_partkey", 4).alias("item_id"))
         .agg(F.array_sort(F.collect_list(F.struct("p_partkey", F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("t")))).alias("_o")))
    letters = F.array(*[F.lit(x) for x in ARC_LETTERS])
    text = F.transform("_o", lambda x: x["t"])
    return g.select(
        "item_id",
        F.concat(F.lit("Which part is listed in group "), F.col("item_id").cast("string"), F.lit("?")).alias("question"),
        F.struct(text.alias("text"), F.slice(letters, 1, F.size("_o")).alias("label")).alias("choices"),
        F.element_at(letters, (F.col("item_id") % 4 + 1).cast("int")).alias("answerKey"))


ARC_SQL = """
SELECT item_id,
       'Which part is listed in group ' || CAST(item_id AS VARCHAR) || '?' AS question,
       {'text': list(p_name || ' ' || CAST(p_partkey AS VARCHAR) ORDER BY p_partkey),
        'label': (['A','B','C','D'])[1:count(*)]} AS choices,
       (['A','B','C','D'])[CAST(item_id % 4 AS INTEGER) + 1] AS answerKey
FROM (SELECT *, p_partkey // 4 AS item_id FROM part) GROUP BY item_id"""


def lm_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def math_items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select("item_id", F.col("text").alias("problem"))


def generations(spark: SparkSession, d: str, items: DataFrame, dataset: str) -> DataFrame:
    """(model, dataset, shot, item_id, generation): model × shot × item in seven kinds, by
    (item + shots + model) mod 7: a whole document picked by item and shot, led by 'The answer is
    (X). ' (0) or alone (1, 6); text that names an option or the gold answer (2); the option's
    words in another order, or the gold answer before a stop marker (3); one word of the option
    among many others, or a wrong number (4); a letter after a keyword and an em space (5)."""
    from ..config import SHOTS
    docs = table(spark, d, "documents").select("doc_id", "text")
    n_docs = F.broadcast(table(spark, d, "documents").agg(F.count("*").alias("_n")))     # one-row scalar
    if dataset == "ARC-Challenge":
        own = F.element_at("choices.text", (F.col("item_id") % F.size("choices.text") + 1).cast("int"))
        words = F.split("_own", " ")
        named, turned = F.concat(F.lit("it must be "), "_own"), F.concat(F.lit("perhaps "), F.array_join(F.reverse(words), " "))
        vague = F.concat(F.element_at(words, 1), F.lit(" or else one two three four five six seven eight nine ten eleven"))
    else:
        own = F.col("answer")
        named, turned = F.concat(F.lit("so it is: "), "_own"), F.concat(F.lit("1,0 and "), "_own", F.lit("\nA: 99999"))
        vague = F.concat(F.lit("-"), "_own", F.lit(" and -0"))
    grid = (items.select("item_id", own.alias("_own"))
            .crossJoin(F.broadcast(literal_table(spark, [(i, m) for i, m in enumerate(MODELS)], "m_idx int, model string")))
            .crossJoin(F.broadcast(literal_table(spark, [(s, n) for s, n in SHOTS], "shot string, n_shot int")))
            .crossJoin(n_docs))
    grid = grid.withColumn("doc_id", ((F.col("item_id") * 7 + F.col("n_shot") * 3 + F.col("m_idx")) % F.col("_n")).cast("long"))
    kind = (F.col("item_id") + F.col("n_shot") + F.col("m_idx")) % 7
    # kinds 2 to 5 show no text: they meet a document's row without one, so that texts go only where they are read
    grid = grid.withColumn("_whole", ~F.coalesce(kind.isin(2, 3, 4, 5), F.lit(False)))
    texts = docs.select("doc_id", F.inline(F.array(F.struct(F.lit(True).alias("_whole"), F.col("text")),
                                                   F.struct(F.lit(False).alias("_whole"), F.lit(None).cast("string").alias("text")))))
    # the grid is narrow but expands items 6x and meets whole texts that are scanned by regexes: one
    # exchange by the join's own key spreads it, and its number of partitions keeps AQE from putting the
    # text work, small in bytes as it is, into a few tasks
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    j = grid.repartition(parts, "doc_id", "_whole").join(texts, ["doc_id", "_whole"], "left")
    lead = F.concat(F.lit("The answer is ("), F.expr("chr(65 + cast(item_id % 4 as int))"), F.lit("). "))
    keyword = F.concat(F.lit("my choice\u2003"), F.expr("chr(97 + cast(item_id % 4 as int))"), F.lit("x is this"))
    gen = (F.when(kind == 0, F.concat(lead, F.col("text"))).when(kind == 2, named).when(kind == 3, turned)
           .when(kind == 4, vague).when(kind == 5, keyword).otherwise(F.col("text")))
    return j.select("model", F.lit(dataset).alias("dataset"), "shot", "item_id", gen.alias("generation"))


def generations_sql(items_sql: str, dataset: str) -> str:
    if dataset == "ARC-Challenge":
        own = "i.choices.text[CAST(i.item_id % len(i.choices.text) AS INTEGER) + 1]"
        named, turned = "'it must be ' || g.own", "'perhaps ' || array_to_string(list_reverse(string_split(g.own, ' ')), ' ')"
        vague = "string_split(g.own, ' ')[1] || ' or else one two three four five six seven eight nine ten eleven'"
    else:
        own = "i.answer"
        named, turned = "'so it is: ' || g.own", "'1,0 and ' || g.own || chr(10) || 'A: 99999'"
        vague = "'-' || g.own || ' and -0'"
    return f"""
SELECT g.model, '{dataset}' AS dataset, g.shot, g.item_id,
       CASE (g.item_id + g.n_shot + g.m_idx) % 7
            WHEN 0 THEN 'The answer is (' || chr(CAST(65 + g.item_id % 4 AS INTEGER)) || '). ' || doc.text
            WHEN 2 THEN {named} WHEN 3 THEN {turned} WHEN 4 THEN {vague}
            WHEN 5 THEN 'my choice' || chr(8195) || chr(CAST(97 + g.item_id % 4 AS INTEGER)) || 'x is this'
            ELSE doc.text END AS generation
FROM (SELECT i.item_id, {own} AS own, m.m_idx, m.model, s.shot, s.n_shot,
             (i.item_id * 7 + s.n_shot * 3 + m.m_idx) % (SELECT count(*) FROM documents) AS doc_id
      FROM ({items_sql}) i,
           (VALUES (0, 'modelA'), (1, 'modelB')) m(m_idx, model),
           (VALUES ('0-shot', 0), ('1-shot', 1), ('3-shot', 3)) s(shot, n_shot)) g
LEFT JOIN documents doc ON doc.doc_id = g.doc_id"""


def logits_pair(spark: SparkSession, d: str, student_vocab: int | None = None) -> DataFrame:
    """(example_id, pos, s, t): teacher = embedding × 10, student = next embedding × 10."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = F.broadcast(e.agg(F.count("*").alias("_n")))                                  # one-row scalar
    t = e.crossJoin(n).select(idiv("vec_id", EX_POSITIONS).alias("example_id"),
                 (F.col("vec_id") % EX_POSITIONS).cast("int").alias("pos"),
                 ((F.col("vec_id") + 1) % F.col("_n")).alias("_nxt"),
                 F.transform("embedding", lambda x: x.cast("double") * 10).alias("t"))
    s = e.select(F.col("vec_id").alias("_nxt"), F.transform("embedding", lambda x: x.cast("double") * 10).alias("s"))
    out = t.join(s, "_nxt").drop("_nxt")
    if student_vocab is not None:
        out = out.withColumn("s", F.slice("s", 1, student_vocab))
    return out.select("example_id", "pos", "s", "t")


def teacher_logits(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(idiv("vec_id", EX_POSITIONS).alias("example_id"),
                    (F.col("vec_id") % EX_POSITIONS).cast("int").alias("pos"),
                    F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"))


def student_logits(spark: SparkSession, d: str, vocab: int | None = None) -> DataFrame:
    """(example_id, pos, logits): an embedding is the student of the position before its own."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n = F.broadcast(e.agg(F.count("*").alias("_n")))                                  # one-row scalar
    x = F.transform("embedding", lambda x: x.cast("double") * 10)
    at = (F.col("vec_id") + F.col("_n") - 1) % F.col("_n")
    return e.crossJoin(n).withColumn("_at", at).select(
        idiv("_at", EX_POSITIONS).alias("example_id"), (F.col("_at") % EX_POSITIONS).cast("int").alias("pos"),
        (x if vocab is None else F.slice(x, 1, vocab)).alias("logits"))


def logits_pair_sql(student_vocab: int | None = None) -> str:
    s = "s.s" if student_vocab is None else f"s.s[1:{student_vocab}]"
    return f"""
SELECT t.example_id, t.pos, {s} AS s, t.t
FROM (SELECT vec_id // {EX_POSITIONS} AS example_id, CAST(vec_id % {EX_POSITIONS} AS INTEGER) AS pos,
             (vec_id + 1) % (SELECT count(*) FROM embeddings) AS nxt,
             list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10) AS t FROM embeddings) t
JOIN (SELECT vec_id AS nxt, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10) AS s FROM embeddings) s
  ON s.nxt = t.nxt"""


TEACHER_LOGITS_SQL = f"""
SELECT vec_id // {EX_POSITIONS} AS example_id, CAST(vec_id % {EX_POSITIONS} AS INTEGER) AS pos,
       list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 10) AS logits FROM embeddings"""


def labels_tok(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    return e.select(idiv("vec_id", EX_POSITIONS).alias("example_id"),
                    (F.col("vec_id") % EX_POSITIONS).cast("int").alias("pos"), F.col("label").cast("int").alias("label"))


LABELS_SQL = f"""
SELECT vec_id // {EX_POSITIONS} AS example_id, CAST(vec_id % {EX_POSITIONS} AS INTEGER) AS pos,
       CAST(label AS INTEGER) AS label FROM embeddings"""


def hidden_states(spark: SparkSession, d: str, who: str = "student") -> DataFrame:
    """(example_id, pos, layer, h): slices of the whole embedding; student 4 × 16, teacher 8 × 8."""
    layers, dim = (STUDENT_LAYERS, STUDENT_DIM) if who == "student" else (TEACHER_LAYERS, TEACHER_DIM)
    e = table(spark, d, "embeddings").select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("layer"), "embedding")
    return e.select(
        idiv("vec_id", EX_POSITIONS).alias("example_id"),
        (F.col("vec_id") % EX_POSITIONS).cast("int").alias("pos"), "layer",
        F.transform(F.slice("embedding", F.col("layer") * dim + 1, F.lit(dim)), lambda x: x.cast("double")).alias("h"))


def hidden_sql(who: str = "student") -> str:
    layers, dim = (STUDENT_LAYERS, STUDENT_DIM) if who == "student" else (TEACHER_LAYERS, TEACHER_DIM)
    return f"""
SELECT vec_id // {EX_POSITIONS} AS example_id, CAST(vec_id % {EX_POSITIONS} AS INTEGER) AS pos,
       CAST(l.layer AS INTEGER) AS layer,
       list_transform(embedding[l.layer * {dim} + 1 : l.layer * {dim} + {dim}], lambda x: CAST(x AS DOUBLE)) AS h
FROM embeddings, range({layers}) l(layer)"""


def projections(spark: SparkSession, layers: int = STUDENT_LAYERS, in_dim: int = STUDENT_DIM,
                out_dim: int = TEACHER_DIM) -> DataFrame:
    """Adapter weights (layer, out_idx, w, b): w[j] = ((7·layer + 3·out + j) % 5 − 2)/10, b = out/100."""
    g = (spark.range(layers).select(F.col("id").cast("int").alias("layer"), F.explode(F.sequence(F.lit(0), F.lit(out_dim - 1))).alias("out_idx")))
    w = F.transform(F.sequence(F.lit(0), F.lit(in_dim - 1)),
                    lambda j: (((F.col("layer") * 7 + F.col("out_idx") * 3 + j) % 5) - 2).cast("double") / 10.0)
    return g.select("layer", "out_idx", w.alias("w"), (F.col("out_idx").cast("double") / 100.0).alias("b"))


PROJECTIONS_SQL = f"""
SELECT CAST(l.layer AS INTEGER) AS layer, CAST(o.out_idx AS INTEGER) AS out_idx,
       list_transform(range({STUDENT_DIM}), lambda j: CAST(((l.layer * 7 + o.out_idx * 3 + j) % 5) - 2 AS DOUBLE) / 10.0) AS w,
       CAST(o.out_idx AS DOUBLE) / 100.0 AS b
FROM range({STUDENT_LAYERS}) l(layer), range({TEACHER_DIM}) o(out_idx)"""


def pair_logps(spark: SparkSession, d: str) -> DataFrame:
    """(pair_id, chosen, rejected, ref_chosen, ref_rejected) as signed affine maps of orders."""
    o = table(spark, d, "orders")
    k = (F.col("o_orderkey") % 17).cast("double")
    p = F.col("o_totalprice") / 10000.0
    return o.select(F.col("o_orderkey").alias("pair_id"),
                    (-p - k).alias("chosen"), (-p - (16 - k)).alias("rejected"),
                    (-p - 8.0).alias("ref_chosen"), (-p - 8.0 + (k - 8) / 4.0).alias("ref_rejected"))


PAIR_LOGPS_SQL = """
SELECT o_orderkey AS pair_id,
       -(o_totalprice / 10000.0) - CAST(o_orderkey % 17 AS DOUBLE) AS chosen,
       -(o_totalprice / 10000.0) - (16 - CAST(o_orderkey % 17 AS DOUBLE)) AS rejected,
       -(o_totalprice / 10000.0) - 8.0 AS ref_chosen,
       -(o_totalprice / 10000.0) - 8.0 + (CAST(o_orderkey % 17 AS DOUBLE) - 8) / 4.0 AS ref_rejected
FROM orders"""


def names(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name"))


def patterns(spark: SparkSession, values=PATTERNS) -> DataFrame:
    return literal_table(spark, [(v,) for v in values], "pattern string")


def pair_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Wide pair rows (batch_id, pair_id, prompt_ids/mask, chosen_ids/mask, rejected_ids/mask):
    the DPO-formatted pair encoded with the document vocabulary.  As a collator does, prompts are
    left-padded to the longest prompt of the batch and completions right-padded to its longest
    completion; nothing is cut; pad = eos."""
    from ..operators import tokens as tk
    from ..operators.conversations import dpo_format
    from ..operators.sequences import pad_pairs
    f = dpo_format(dpo_pairs(spark, d))
    vocab = tk.fit_vocab(table(spark, d, "documents"), "text", VOCAB_SIZE)
    e = tk.encode_columns(f, {"_p": "prompt", "_c": "chosen", "_r": "rejected"}, vocab)
    e = e.select(idiv("pair_id", CONVS_PER_BATCH * PAIR_STRIDE).alias("batch_id"), "pair_id", "_p", "_c", "_r")
    return pad_pairs(e, SPECIALS.index("<eos>"), "_p", "_c", "_r")


def id_scores(tokens: DataFrame, size: int) -> DataFrame:
    """Token rows with student ``logits`` and teacher ``t_logits`` over ``size`` ids, functions of id and position."""
    ids = F.sequence(F.lit(0), F.lit(size - 1))
    score = lambda a, b, m, q: F.transform(ids, lambda v: ((F.col("input_id") * a + v * b + F.col("pos")) % m).cast("double") / q)
    return tokens.withColumn("logits", score(7, 3, 11, 2.0)).withColumn("t_logits", score(5, 2, 13, 3.0))


def id_scores_sql(tokens: str, size: int) -> str:
    score = lambda a, b, m, q: f"list_transform(range({size}), lambda v: CAST((input_id * {a} + v * {b} + pos) % {m} AS DOUBLE) / {q})"
    return f"SELECT *, {score(7, 3, 11, 2.0)} AS logits, {score(5, 2, 13, 3.0)} AS t_logits FROM ({tokens})"


def pref_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Per-token preference rows from the logit fixture: each example gives both sides of one
    pair, so no row lacks a partner.  The chosen side has the example's student and teacher
    scores and labels; the rejected side has them swapped and the labels moved on by one class
    of ten.  The first 2 positions are prompt (loss_mask 0).  Columns: batch_id, pair_id, side,
    example_id (row of the stacked batch), pos, logits (student), t_logits (teacher), label,
    loss_mask."""
    p = logits_pair(spark, d).join(labels_tok(spark, d), ["example_id", "pos"])
    sides = F.explode(F.array(
        F.struct(F.lit("chosen").alias("side"), (F.col("example_id") * 2).alias("row"), F.col("s").alias("logits"),
                 F.col("t").alias("t_logits"), F.col("label").alias("label")),
        F.struct(F.lit("rejected").alias("side"), (F.col("example_id") * 2 + 1).alias("row"), F.col("t").alias("logits"),
                 F.col("s").alias("t_logits"), ((F.col("label") + 1) % 10).alias("label"))))
    p = p.select(F.col("example_id").alias("pair_id"), "pos", sides.alias("x"))
    return p.select(idiv("pair_id", PAIRS_PER_BATCH).alias("batch_id"), "pair_id", "x.side", F.col("x.row").alias("example_id"),
                    "pos", "x.logits", "x.t_logits", "x.label", (F.col("pos") >= 2).cast("int").alias("loss_mask"))


_PREF_BOTH_SQL = f"({logits_pair_sql(None)}) p JOIN ({LABELS_SQL}) l ON l.example_id = p.example_id AND l.pos = p.pos"
PREF_TOKENS_SQL = f"""
SELECT p.example_id // {PAIRS_PER_BATCH} AS batch_id, p.example_id AS pair_id, 'chosen' AS side, 2 * p.example_id AS example_id,
       p.pos, p.s AS logits, p.t AS t_logits, l.label, CAST(p.pos >= 2 AS INTEGER) AS loss_mask FROM {_PREF_BOTH_SQL}
UNION ALL
SELECT p.example_id // {PAIRS_PER_BATCH}, p.example_id, 'rejected', 2 * p.example_id + 1,
       p.pos, p.t, p.s, (l.label + 1) % 10, CAST(p.pos >= 2 AS INTEGER) FROM {_PREF_BOTH_SQL}"""


def class_centroids(spark: SparkSession, d: str) -> DataFrame:
    """(label, c ARRAY<DOUBLE>): per-class mean embedding (a hash aggregate on (label, dim))."""
    e = table(spark, d, "embeddings")
    cells = e.select("label", F.posexplode("embedding").alias("j", "v"))
    per = cells.groupBy("label", "j").agg(F.avg(F.col("v").cast("double")).alias("m"))
    return per.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("j", "m"))).alias("_c")).select(
        "label", F.transform("_c", lambda x: x["m"]).alias("c"))


def linear_task(spark: SparkSession, d: str) -> DataFrame:
    """(id, features, label, teacher_logits): teacher = −10 × squared distance to each class
    centroid, in label order.  A row's teacher logits are its distances to every class by
    definition; the centroids are one row (classes × dims), joined like any table."""
    cents = class_centroids(spark, d).agg(F.array_sort(F.collect_list(F.struct("label", "c"))).alias("_cs"))
    cents = cents.select(F.transform("_cs", lambda x: x["c"]).alias("_cs"))
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"),
                                              F.transform("embedding", lambda v: v.cast("double")).alias("features"), "label")
    j = e.crossJoin(cents)                                             # one-row side
    sq = lambda c: F.aggregate(F.zip_with("features", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    return j.select("id", "features", "label", F.transform("_cs", lambda c: -10.0 * sq(c)).alias("teacher_logits"))
