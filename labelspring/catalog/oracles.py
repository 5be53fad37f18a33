"""The SQL every deterministic query must agree with, over the same tables.

Doubles are rounded on both sides, because engines add in different orders.
"""

from __future__ import annotations

from labelspring.catalog import settings as S
from labelspring.functions.stopwords import ENGLISH_STOP_WORDS

V, LAM = S.N_FEATURES, S.SMOOTHING


def _with(*ctes: str) -> str:
    return "WITH " + ",\n".join(c for c in ctes if c) + "\n"


def _tokens_of(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[\\W+_0-9]'), lambda t: length(t) >= 2)"


def _unit(*parts: str) -> str:
    key = " || ':' || ".join(f"{p}::VARCHAR" for p in parts)
    return f"(('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0)"


def _bucket(term: str) -> str:
    return f"((('0x' || substr(md5({term}), 1, 8))::BIGINT) % {V})::INTEGER"


TOKENS = f"tokens AS MATERIALIZED (SELECT doc_id, unnest({_tokens_of('text')}) AS term FROM documents)"
TF = f"tf AS MATERIALIZED (SELECT doc_id, {_bucket('term')} AS bucket, count(*) AS tf FROM tokens GROUP BY ALL)"
LEN = """len AS MATERIALIZED (
  SELECT d.doc_id, coalesce(sum(t.tf), 0)::BIGINT AS len FROM documents d LEFT JOIN tf t USING (doc_id) GROUP BY d.doc_id)"""
COUNTS = ",\n".join([TOKENS, TF, LEN])


def index_cte(name: str, source: str, topic: str, id_expr: str) -> str:
    """``name(topic, id, n, ind)``: distinct IDs of each topic, most frequent first."""
    return f"""{name} AS MATERIALIZED (
  SELECT topic, id, n, row_number() OVER (PARTITION BY topic ORDER BY n DESC, id) - 1 AS ind
  FROM (SELECT {topic} AS topic, {id_expr} AS id, count(*) AS n FROM {source} GROUP BY ALL))"""


def model_ctes(
    s: str, assigned: str, lam: float = LAM, normalise: bool = True, bernoulli: bool = False
) -> str:
    """CTEs ``n{s}, m{s}, p{s}`` of the model fitted on ``assigned(run, doc_id, label, w, counted)``."""
    x = "1" if bernoulli else "t.tf"
    length = "(SELECT doc_id, count(*) AS len FROM tf GROUP BY doc_id)" if bernoulli else "len"
    value = f"{x}::DOUBLE / l.len" if normalise else f"{x}::DOUBLE"
    denom = f"ln(n.n + 2.0 * {lam})" if bernoulli else f"ln(coalesce(c.mass, 0) + {V} * {lam})"
    return f"""n{s} AS MATERIALIZED (
  SELECT run, label, sum(w)::DOUBLE AS n, sum(counted)::BIGINT AS n_rows FROM {assigned} GROUP BY ALL HAVING sum(w) > 0),
m{s} AS MATERIALIZED (
  SELECT a.run, a.label, t.bucket, sum(a.w * {value}) AS mass, sum(a.counted)::BIGINT AS df
  FROM {assigned} a JOIN tf t USING (doc_id) JOIN {length} l USING (doc_id) GROUP BY ALL),
p{s} AS MATERIALIZED (
  SELECT n.run, n.label, n.n, n.n_rows, coalesce(c.mass, 0) AS mass, coalesce(c.seen, 0) AS seen,
    ln(n.n + {lam}) - ln(sum(n.n) OVER (PARTITION BY n.run) + count(*) OVER (PARTITION BY n.run) * {lam}) AS pi,
    {denom} AS log_denom
  FROM n{s} n LEFT JOIN (SELECT run, label, sum(mass) AS mass, count(*) AS seen FROM m{s} GROUP BY ALL) c USING (run, label))"""


def score_ctes(s: str, wanted: str, lam: float = LAM) -> str:
    """CTEs ``s{s}(run, doc_id, label, raw, posterior)`` and ``y{s}(run, doc_id, label)``
    for the documents of ``wanted(run, doc_id)``."""
    return f"""s{s} AS MATERIALIZED (
  SELECT run, doc_id, label, raw,
    exp(raw - max(raw) OVER (PARTITION BY run, doc_id))
      / sum(exp(raw - best)) OVER (PARTITION BY run, doc_id) AS posterior
  FROM (
    SELECT *, max(raw) OVER (PARTITION BY run, doc_id) AS best FROM (
      SELECT w.run, w.doc_id, p.label,
        p.pi + l.len * (ln({lam}) - p.log_denom) + coalesce(x.s, 0) AS raw
      FROM {wanted} w JOIN p{s} p USING (run) JOIN len l USING (doc_id)
      LEFT JOIN (
        SELECT w.run, w.doc_id, m.label, sum(t.tf * (ln(m.mass + {lam}) - ln({lam}))) AS s
        FROM {wanted} w JOIN tf t USING (doc_id) JOIN m{s} m ON m.run = w.run AND m.bucket = t.bucket
        GROUP BY ALL) x ON x.run = w.run AND x.doc_id = w.doc_id AND x.label = p.label))),
y{s} AS MATERIALIZED (
  SELECT run, doc_id, min(label) AS label
  FROM (SELECT *, max(raw) OVER (PARTITION BY run, doc_id) AS top FROM s{s})
  WHERE raw >= top - 1e-9 GROUP BY ALL)"""


def log_prob_sql(s: str, lam: float = LAM) -> str:
    """``(run, model_log_prob, data_log_prob)`` of model ``s``."""
    return f"""SELECT p.run,
    -(sum(p.pi) + sum(coalesce(c.theta, 0) + ({V} - p.seen) * (ln({lam}) - p.log_denom))) / ln(2) AS model_log_prob,
    sum(p.n_rows * p.pi + coalesce(c.data, 0)) AS data_log_prob
  FROM p{s} p LEFT JOIN (
    SELECT m.run, m.label, sum(ln(m.mass + {lam}) - p.log_denom) AS theta,
      sum(m.df * (ln(m.mass + {lam}) - p.log_denom)) AS data
    FROM m{s} m JOIN p{s} p USING (run, label) GROUP BY ALL) c USING (run, label)
  GROUP BY p.run"""


def em_ctes(
    epochs: int, labelled: str, free: str, test: str, weight: float = 1.0, soft: bool = False, lam: float = LAM
) -> str:
    """Unrolled EM.  ``labelled(run, doc_id, label)``, ``free(run, doc_id)``, ``test(run, doc_id, label)``.

    Model 0 is the supervised one, model e the one after epoch e.
    """
    out = [
        f"a0 AS MATERIALIZED (SELECT run, doc_id, label, 1.0::DOUBLE AS w, 1 AS counted FROM {labelled})",
        f"wanted AS MATERIALIZED (SELECT run, doc_id FROM {labelled} UNION ALL SELECT run, doc_id FROM {free} "
        f"UNION ALL SELECT run, doc_id FROM {test})",
        model_ctes("0", "a0", lam),
    ]
    for e in range(1, epochs + 1):
        prev = str(e - 1)
        out.append(score_ctes(prev, "wanted", lam))
        if soft:
            guessed = f"""SELECT f.run, f.doc_id, s.label, s.posterior * {weight} AS w, (s.label = y.label)::INTEGER AS counted
    FROM {free} f JOIN s{prev} s USING (run, doc_id) JOIN y{prev} y ON y.run = f.run AND y.doc_id = f.doc_id"""
        else:
            guessed = f"SELECT f.run, f.doc_id, y.label, {weight}::DOUBLE AS w, 1 AS counted FROM {free} f JOIN y{prev} y USING (run, doc_id)"
        out.append(f"a{e} AS MATERIALIZED (SELECT * FROM a0 UNION ALL {guessed})")
        out.append(model_ctes(str(e), f"a{e}", lam))
    return ",\n".join(out)


def trace_cte(epochs: int, labelled: str, test: str, lam: float = LAM) -> str:
    parts = []
    for e in range(1, epochs + 1):
        y = f"y{e - 1}"
        parts.append(f"""SELECT l.run, {e} AS epoch,
    (SELECT avg((y.label = t.label)::INTEGER) FROM {test} t JOIN {y} y USING (run, doc_id) WHERE t.run = l.run) AS acc_test,
    (SELECT avg((y.label = t.label)::INTEGER) FROM {labelled} t JOIN {y} y USING (run, doc_id) WHERE t.run = l.run) AS acc_train,
    (SELECT coalesce(sum(counted), 0)::BIGINT FROM a{e} a WHERE a.run = l.run AND label = 0) AS n_label0,
    (SELECT coalesce(sum(counted), 0)::BIGINT FROM a{e} a WHERE a.run = l.run AND label = 1) AS n_label1,
    l.model_log_prob, l.data_log_prob
  FROM ({log_prob_sql(str(e), lam)}) l""")
    body = "\n  UNION ALL ".join(parts)
    return f"""trace AS MATERIALIZED (
  SELECT *, n_label0::DOUBLE / nullif(n_label0 + n_label1, 0) AS ratio, model_log_prob + data_log_prob AS log_prob,
    2 * abs(log_prob - lag(log_prob) OVER w) / (abs(log_prob) + abs(lag(log_prob) OVER w)) AS improvement
  FROM ({body}) WINDOW w AS (PARTITION BY run ORDER BY epoch))"""


TRACE_COLUMNS = """epoch::INTEGER AS epoch, round(acc_test, 6) AS acc_test, round(acc_train, 6) AS acc_train,
  n_label0, n_label1, round(ratio, 6) AS ratio, round(model_log_prob, 4) AS model_log_prob,
  round(data_log_prob, 4) AS data_log_prob, round(log_prob, 4) AS log_prob, round(improvement, 9) AS improvement"""

# The partly labelled corpus: quality labels, a tenth of them held back for testing.
SPLIT_SIDE = f"({_unit('doc_id', str(S.SEED))} >= 0.9)"
CORPUS = f"""lab AS MATERIALIZED (SELECT 0 AS run, doc_id, quality AS label FROM labels JOIN documents USING (doc_id) WHERE NOT {SPLIT_SIDE}),
tst AS MATERIALIZED (SELECT 0 AS run, doc_id, quality AS label FROM labels JOIN documents USING (doc_id) WHERE {SPLIT_SIDE}),
free AS MATERIALIZED (SELECT 0 AS run, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL))"""
ALL_LABELLED = """full_lab AS MATERIALIZED (
  SELECT 0 AS run, doc_id, quality AS label, 1.0::DOUBLE AS w, 1 AS counted FROM labels JOIN documents USING (doc_id))"""
ALL_DOCS = "every AS (SELECT 0 AS run, doc_id FROM documents)"

# Multi-class corpus: language as class, 9:1 train and test, index inside each class.
LANG_CODES = """codes AS MATERIALIZED (
  SELECT lang, (row_number() OVER (ORDER BY count(*) DESC, lang) - 1)::INTEGER AS label FROM documents GROUP BY lang)"""
LANG_TRAIN = f"""{LANG_CODES},
train AS MATERIALIZED (SELECT doc_id, label FROM documents JOIN codes USING (lang) WHERE NOT {SPLIT_SIDE}),
test AS MATERIALIZED (SELECT doc_id, label FROM documents JOIN codes USING (lang) WHERE {SPLIT_SIDE}),
{index_cte('train_ind', 'train', 'label', 'doc_id')}"""


def grid_ctes(sizes: tuple[int, ...], trials: int) -> str:
    values = ", ".join(
        f"({i}, {n}, {t})" for i, (n, t) in enumerate((n, t) for n in sizes for t in range(1, trials + 1))
    )
    u = _unit(str(S.SEED), "n_sup", "trial")
    return f"""bound AS MATERIALIZED (SELECT min(top) + 1 AS min_class FROM (SELECT max(ind) AS top FROM train_ind GROUP BY topic)),
grid AS MATERIALIZED (
  SELECT run, n_sup, trial,
    CASE WHEN min_class > n_sup THEN floor((min_class - n_sup + 1) * {u})::BIGINT ELSE 0 END AS start
  FROM (VALUES {values}) g(run, n_sup, trial), bound),
glab AS MATERIALIZED (SELECT run, id AS doc_id, topic AS label FROM grid JOIN train_ind ON ind >= start AND ind < start + n_sup),
gfree AS MATERIALIZED (SELECT run, id AS doc_id FROM grid JOIN train_ind ON ind < start OR ind >= start + n_sup),
gtest AS MATERIALIZED (SELECT run, doc_id, label FROM grid, test)"""


_GRID_EM = _with(
    COUNTS, LANG_TRAIN, grid_ctes(S.GRID_SIZES, S.GRID_TRIALS),
    em_ctes(S.GRID_EPOCHS, "glab", "gfree", "gtest"), score_ctes(str(S.GRID_EPOCHS), "gtest"),
    f"""acc AS (
  SELECT g.n_sup, g.trial, g.start, count(*) AS n_rows,
    avg((a.label = t.label)::INTEGER) AS acc_sup, avg((b.label = t.label)::INTEGER) AS acc_em
  FROM grid g JOIN gtest t USING (run) JOIN y0 a ON a.run = t.run AND a.doc_id = t.doc_id
  JOIN y{S.GRID_EPOCHS} b ON b.run = t.run AND b.doc_id = t.doc_id GROUP BY ALL)""",
)

def _hash32(*parts: str) -> str:
    key = " || ':' || ".join(f"{p}::VARCHAR" for p in parts)
    return f"('0x' || substr(md5({key}), 1, 8))::BIGINT"


def _runs(name: str, columns: str, values) -> str:
    """``name(run, columns...)``: numbered rows of Python values."""
    rows = ", ".join("(" + ", ".join(str(v) for v in (i, *row)) + ")" for i, row in enumerate(values))
    return f"{name} AS (SELECT * FROM (VALUES {rows}) v(run, {columns}))"


def _two_accuracies(test: str, epochs: int) -> str:
    """``acc2(run, n_rows, acc_sup, acc_em)`` from the models 0 and ``epochs``."""
    return f"""acc2 AS MATERIALIZED (
  SELECT t.run, count(*) AS n_rows, avg((a.label = t.label)::INTEGER) AS acc_sup, avg((b.label = t.label)::INTEGER) AS acc_em
  FROM {test} t JOIN y0 a ON a.run = t.run AND a.doc_id = t.doc_id JOIN y{epochs} b ON b.run = t.run AND b.doc_id = t.doc_id GROUP BY t.run)"""


def _rounded(*columns: str) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in columns)


def _summary(source: str, by: str, *names: str) -> str:
    each = ", ".join(f"round(avg(acc_{n}), 6) AS mean_{n}, round(stddev_pop(acc_{n}), 6) AS sd_{n}" for n in names)
    return f"SELECT {by}, count(*) AS n_trials, {each} FROM {source} GROUP BY {by}"


# Random samples of a given size, for every (size, trial).
_RANDOM = _with(
    COUNTS, LANG_TRAIN,
    _runs("draw", "n_sup, trial", [(n, t) for n in S.RANDOM_SIZES for t in range(1, S.RANDOM_TRIALS + 1)]),
    f"""placed AS MATERIALIZED (
  SELECT run, n_sup, trial, doc_id, label, row_number() OVER (PARTITION BY run ORDER BY {_hash32('doc_id', str(S.SEED), 'trial')}, doc_id) AS place
  FROM draw, train),
rlab AS MATERIALIZED (SELECT run, doc_id, label FROM placed WHERE place <= n_sup),
rfree AS MATERIALIZED (SELECT run, doc_id FROM placed WHERE place > n_sup),
rtest AS MATERIALIZED (SELECT run, doc_id, label FROM draw, test)""",
    em_ctes(S.GRID_EPOCHS, "rlab", "rfree", "rtest"), score_ctes(str(S.GRID_EPOCHS), "rtest"), _two_accuracies("rtest", S.GRID_EPOCHS),
    """random AS (
  SELECT n_sup::INTEGER AS n_sup, trial::INTEGER AS trial, n_labelled, n_label0, n_rows, acc_sup, acc_em FROM draw JOIN acc2 USING (run)
  JOIN (SELECT run, count(*) AS n_labelled, count_if(label = 0)::BIGINT AS n_label0 FROM rlab GROUP BY run) USING (run))""",
)


def _weighted() -> str:
    """``weighted(n_sup, trial, start, n_rows, acc_sup, acc_full, acc_reduced)``: two EMs over the same windows."""
    grid = ",\n".join([COUNTS, LANG_TRAIN, grid_ctes(S.GRID_SIZES, S.GRID_TRIALS)])

    def variant(weight: float) -> str:
        chain = _with(
            grid, em_ctes(S.GRID_EPOCHS, "glab", "gfree", "gtest", weight), score_ctes(str(S.GRID_EPOCHS), "gtest"),
            _two_accuracies("gtest", S.GRID_EPOCHS),
        )
        return f"({chain} SELECT n_sup::INTEGER AS n_sup, trial::INTEGER AS trial, start, n_rows, acc_sup, acc_em FROM grid JOIN acc2 USING (run))"

    return _with(f"""weighted AS MATERIALIZED (
  SELECT f.n_sup, f.trial, f.start, f.n_rows, f.acc_sup, f.acc_em AS acc_full, r.acc_em AS acc_reduced
  FROM {variant(1.0)} f JOIN {variant(S.UNLABELED_WEIGHT)} r USING (n_sup, trial))""")


# Shares of the labels, every trial with draws of its own for test, labelled and unlabelled rows.
_SHARES = _with(
    COUNTS, _runs("plan", "share, trial", [(s, t) for s in S.LABEL_SHARES for t in range(1, S.SHARE_TRIALS + 1)]),
    f"""parts AS MATERIALIZED (
  SELECT run, share, doc_id, quality AS label, {_unit('doc_id', str(S.SEED), 'trial')} AS u_test,
    {_unit('doc_id', str(S.SEED + 1), 'trial')} AS u_label, {_unit('doc_id', str(S.SEED + 2), 'trial')} AS u_free
  FROM plan, documents LEFT JOIN labels USING (doc_id)),
slab AS MATERIALIZED (SELECT run, doc_id, label FROM parts WHERE label IS NOT NULL AND u_test < 0.9 AND u_label < share),
sfree AS MATERIALIZED (SELECT run, doc_id FROM parts WHERE label IS NULL AND u_free < 0.1),
stst AS MATERIALIZED (SELECT run, doc_id, label FROM parts WHERE label IS NOT NULL AND u_test >= 0.9)""",
    em_ctes(S.GRID_EPOCHS, "slab", "sfree", "stst"), score_ctes(str(S.GRID_EPOCHS), "stst"), _two_accuracies("stst", S.GRID_EPOCHS),
    """shares AS (
  SELECT share::DOUBLE AS share, trial::INTEGER AS trial, n_labelled, n_label0, coalesce(n_unlabelled, 0) AS n_unlabelled, n_rows, acc_sup, acc_em
  FROM plan JOIN acc2 USING (run)
  JOIN (SELECT run, count(*) AS n_labelled, count_if(label = 0)::BIGINT AS n_label0 FROM slab GROUP BY run) USING (run)
  LEFT JOIN (SELECT run, count(*) AS n_unlabelled FROM sfree GROUP BY run) USING (run))""",
)

_ACC_BY = "count(*) AS n_rows, round(avg((y.label = t.label)::INTEGER), 6) AS accuracy"


def _weighting(name: str, weight: float, soft: bool) -> str:
    return f"""SELECT '{name}' AS weighting, * FROM (
  {_with(COUNTS, CORPUS, em_ctes(S.EPOCHS, 'lab', 'free', 'tst', weight, soft), trace_cte(S.EPOCHS, 'lab', 'tst'))}
  SELECT {TRACE_COLUMNS} FROM trace)"""


def _loop_sql() -> str:
    n = S.EPOCHS
    finals = "\n  UNION ALL ".join(
        f"SELECT {e} AS epoch, y.doc_id, y.label FROM yf{e} y" for e in range(1, n + 1)
    )
    scored = []
    for e in range(1, n + 1):
        block = score_ctes(str(e), "every")
        scored.append(block.replace(f"s{e} AS", f"sf{e} AS").replace(f"FROM s{e})", f"FROM sf{e})").replace(f"y{e} AS", f"yf{e} AS"))
    return _with(
        COUNTS, CORPUS, ALL_DOCS, em_ctes(n, "lab", "free", "tst"), trace_cte(n, "lab", "tst"), *scored,
        f"stop AS (SELECT coalesce(min(epoch) FILTER (improvement < {S.MIN_IMPROVEMENT}), {n}) AS epoch FROM trace)",
    ) + f"SELECT doc_id, label::INTEGER AS prediction, epoch::INTEGER AS epochs FROM ({finals}) f JOIN stop USING (epoch)"


def _points_cte() -> str:
    return f"""points AS MATERIALIZED (
  SELECT d.doc_id, l.quality AS label, coalesce(t.n, 0)::INTEGER AS n_active, coalesce(t.total, 0)::DOUBLE AS total,
    '(' || l.quality::DOUBLE || ', ({V},[' || coalesce(t.idx, '') || '],[' || coalesce(t.val, '') || ']), ['
      || (l.quality = 0)::INTEGER::DOUBLE || ',' || (l.quality = 1)::INTEGER::DOUBLE || '], 1.0)' AS line
  FROM documents d JOIN labels l USING (doc_id) LEFT JOIN (
    SELECT doc_id, count(*) AS n, sum(tf) AS total, string_agg(bucket::VARCHAR, ',' ORDER BY bucket) AS idx,
      string_agg((tf::DOUBLE)::VARCHAR, ',' ORDER BY bucket) AS val FROM tf GROUP BY doc_id) t USING (doc_id))"""


_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in ENGLISH_STOP_WORDS)


def sqls() -> dict[str, str]:
    q: dict[str, str] = {}

    # sources and sinks
    q["path_parts"] = """SELECT page_id, string_split(url, '/')[-2] AS topic, string_split(url, '/')[-1] AS item FROM pages"""
    lines = "SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents"
    q["file_provenance"] = f"SELECT 'source=' || source AS topic, count(*) AS n_lines FROM ({lines}) GROUP BY source"
    q["text_roundtrip"] = f"SELECT length(line)::BIGINT AS line_length, count(*) AS n_lines FROM ({lines}) GROUP BY ALL"
    q["delimited_fields"] = """WITH lines AS (
  SELECT 'comma' AS layout, string_split(concat_ws(',', event_id, user_id, 'q', event_type, 'u', props), ',') AS f, 4 AS p, 6 AS t FROM events
  UNION ALL
  SELECT 'tab', string_split(concat_ws(chr(9), event_id, event_type, user_id, props), chr(9)), 2, 4 FROM events)
SELECT layout, f[1] AS item, f[p] AS polarity, array_to_string(string_split(f[t], ' '), '|') AS words,
  len(string_split(f[t], ' '))::INTEGER AS n_words, (f[10] IS NULL)::INTEGER AS missing FROM lines"""
    q["labeled_point_format"] = _with(COUNTS, _points_cte()) + "SELECT doc_id, line FROM points"
    q["labeled_point_parse"] = _with(COUNTS, _points_cte()) + f"""SELECT doc_id, 'whole' AS variant, label::DOUBLE AS label, {V} AS size,
  n_active, total, (label = 0)::INTEGER::DOUBLE AS weight0, 1.0::DOUBLE AS ground_truth, 0 AS corrupt FROM points
UNION ALL SELECT doc_id, 'cut', NULL, NULL, NULL, NULL, NULL, NULL, 1 FROM points"""
    shaped = f"""SELECT doc_id, line, len(regexp_extract_all(line, '[0-9.]+')) AS n,
    list_sum(list_transform(regexp_extract_all(line, '[0-9.]+'), lambda x: x::DOUBLE)) AS total,
    replace(regexp_replace(line, '[0-9.]+', 'n', 'g'), ' ', '') AS shape FROM points"""
    whole = "NULL::VARCHAR AS error, NULL::INTEGER AS error_at"
    none = "NULL::VARCHAR AS shape_md5, NULL::INTEGER AS n_numbers, NULL::DOUBLE AS total"
    q["nested_numbers"] = _with(COUNTS, _points_cte(), f"shaped AS MATERIALIZED ({shaped})") + f"""
SELECT doc_id, 'whole' AS variant, {whole}, md5(shape) AS shape_md5, n::INTEGER AS n_numbers, round(total, 6) AS total FROM shaped
UNION ALL SELECT doc_id, 'cut', 'missing close', length(line)::INTEGER, {none} FROM shaped
UNION ALL SELECT doc_id, 'comma', 'bad comma', (instr(line, ',') + 1)::INTEGER, {none} FROM shaped
UNION ALL SELECT doc_id, 'number', 'bad number', 2, {none} FROM shaped
UNION ALL SELECT doc_id, 'deeper', {whole}, md5('((' || shape || '),[n,n,])'), (n + 2)::INTEGER, round(total + 3.5, 6) FROM shaped"""
    q["ordered_lines"] = """SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS line, md5(line) AS line_md5
FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)"""
    q["parquet_roundtrip"] = "SELECT doc_id, lang, source, n_chars, md5(text) AS text_md5 FROM documents"

    # projections and filters
    q["select_alias"] = """SELECT doc_id::VARCHAR AS "ID", source AS topic, n_chars FROM documents"""
    q["constant_column"] = """SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 0.5 ELSE 1.0 END::DOUBLE AS "groundTruth"
FROM documents d LEFT JOIN labels l USING (doc_id)"""
    q["rename_drop"] = "SELECT doc_id, quality AS label FROM labels"
    q["equality_filter"] = "SELECT doc_id, quality AS label FROM labels WHERE quality = 0"
    q["neq_filter"] = "SELECT doc_id, lang FROM documents WHERE lang <> 'en'"
    topic_index = index_cte("ind", "documents", "source", "doc_id")
    lo, n = S.WINDOW
    q["range_filter"] = _with(topic_index) + f"SELECT topic AS source, id AS doc_id, ind FROM ind WHERE ind >= {lo} AND ind < {lo + n}"
    q["or_filter"] = _with(topic_index) + f"SELECT topic AS source, id AS doc_id, ind FROM ind WHERE ind < {lo} OR ind >= {lo + n}"
    q["hide_labels"] = "SELECT doc_id FROM labels"
    q["one_hot_long"] = """SELECT doc_id, j::INTEGER AS cls, (j = quality)::INTEGER::DOUBLE AS weight
FROM labels, (SELECT unnest(range(0, (SELECT max(quality) + 1 FROM labels))) AS j)"""

    # text
    q["regex_tokens"] = f"""SELECT doc_id, len(w)::INTEGER AS n_tokens, md5(array_to_string(w, ' ')) AS words_md5
FROM (SELECT doc_id, {_tokens_of('text')} AS w FROM documents)"""
    q["space_tokens"] = """SELECT doc_id, len(w)::INTEGER AS n_tokens, len(list_filter(w, lambda t: t = ''))::INTEGER AS n_empty,
  md5(array_to_string(w, '|')) AS words_md5 FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)"""
    q["flatten_turns"] = f"""SELECT conv_id, sum(len(w))::INTEGER AS n_words,
  md5(coalesce(string_agg(array_to_string(w, ' '), ' ' ORDER BY turn) FILTER (len(w) > 0), '')) AS words_md5
FROM (SELECT conv_id, turn, {_tokens_of('text')} AS w FROM conversations) GROUP BY ALL"""
    q["flatten_lines"] = f"""SELECT doc_id, len(w)::INTEGER AS n_words, md5(array_to_string(w, ' ')) AS words_md5
FROM (SELECT doc_id, flatten(list_transform(string_split(text, chr(10)), lambda line: {_tokens_of('line')})) AS w FROM documents)"""
    q["document_terms"] = f"""SELECT conv_id, term, count(*) AS n
FROM (SELECT conv_id, unnest({_tokens_of('text')}) AS term FROM conversations) GROUP BY ALL"""
    q["document_counts"] = f"""SELECT conv_id, {_bucket('term')} AS bucket, count(*) AS tf
FROM (SELECT conv_id, unnest({_tokens_of('text')}) AS term FROM conversations) GROUP BY ALL"""
    q["stopword_removal"] = f"""SELECT doc_id, len(w)::INTEGER AS n_kept, md5(array_to_string(w, ' ')) AS words_md5
FROM (SELECT doc_id, list_filter({_tokens_of('text')}, lambda t: NOT list_contains([{_STOP}], t)) AS w FROM documents)"""
    q["ml_pipeline"] = f"""WITH codes AS (
  SELECT lang, (row_number() OVER (ORDER BY count(*) DESC, lang) - 1)::INTEGER AS label FROM documents WHERE NOT {SPLIT_SIDE} GROUP BY lang)
SELECT doc_id, label, len(list_filter({_tokens_of('text')}, lambda t: NOT list_contains([{_STOP}], t)))::BIGINT AS n_terms, 1 AS same
FROM documents JOIN codes USING (lang) WHERE {SPLIT_SIDE}"""
    q["hashed_tf"] = _with(TOKENS, TF) + "SELECT doc_id, bucket, tf FROM tf"
    q["hashed_tf_java"] = _with(TOKENS, """codes AS (
  SELECT term, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(term, ''), lambda c: unicode(c)::BIGINT)),
    lambda h, c: (h * 31 + c) % 4294967296) AS h FROM (SELECT DISTINCT term FROM tokens))""") + f"""
SELECT doc_id, ((((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % {V}) + {V}) % {V})::INTEGER AS bucket, count(*) AS tf
FROM tokens JOIN codes USING (term) GROUP BY ALL"""
    q["doc_length"] = _with(COUNTS) + "SELECT doc_id, len::INTEGER AS n_terms FROM len"
    q["length_normalised_tf"] = _with(TOKENS, TF) + "SELECT doc_id, bucket, round(tf::DOUBLE / sum(tf) OVER (PARTITION BY doc_id), 6) AS value FROM tf"
    q["feature_validation"] = _with(TOKENS, TF, """vals AS (
  SELECT 'embeddings' AS input, unnest(embedding)::DOUBLE AS x FROM embeddings
  UNION ALL SELECT 'term_counts', tf::DOUBLE FROM tf)""") + """
SELECT input, 'multinomial' AS model_type, count(*) AS n_values, count_if(x < 0)::BIGINT AS n_rejected FROM vals GROUP BY ALL
UNION ALL SELECT input, 'bernoulli', count(*), count_if(x <> 0 AND x <> 1)::BIGINT FROM vals GROUP BY ALL"""

    # labels and indexes
    def index_fit(table: str, column: str) -> str:
        return f"""SELECT '{column}' AS "column", {column} AS value, count(*) AS n,
  (row_number() OVER (ORDER BY count(*) DESC, {column}) - 1)::INTEGER AS label FROM {table} GROUP BY {column}"""

    q["label_index_fit"] = " UNION ALL ".join(
        index_fit(t, c) for t, c in (("documents", "lang"), ("documents", "source"), ("events", "event_type"))
    )
    q["label_index_apply"] = """WITH fitted AS (
  SELECT source, row_number() OVER (ORDER BY count(*) DESC, source) - 1 AS code
  FROM documents JOIN labels USING (doc_id) GROUP BY source)
SELECT doc_id, coalesce(code, (SELECT count(*) FROM fitted))::INTEGER AS label FROM documents LEFT JOIN fitted USING (source)"""
    q["topic_instance_index"] = _with(
        index_cte("turns", "conversations", "role", "conv_id"), topic_index
    ) + """SELECT 'conversations' AS input, topic, id, n, ind FROM turns
UNION ALL SELECT 'documents', topic, id, n, ind FROM ind"""
    q["train_topics_only"] = f"""WITH parts AS (SELECT doc_id, source, {SPLIT_SIDE} AS is_test FROM documents)
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS ind FROM parts
WHERE is_test AND source IN (SELECT source FROM parts WHERE NOT is_test)"""
    q["topic_profile"] = _with(index_cte("turns", "conversations", "role", "conv_id")) + """
SELECT role, min_by(conv_id, ind) AS first_id, max(ind) AS max_ind, count(*) AS n_rows FROM conversations JOIN turns ON topic = role AND id = conv_id GROUP BY role"""
    q["distinct_topics"] = "SELECT DISTINCT source AS topic FROM documents"
    q["class_count"] = f"WITH {LANG_CODES} SELECT (max(label) + 1)::BIGINT AS n_classes FROM codes"
    q["min_class_bound"] = _with(topic_index) + "SELECT min(top) + 1 AS min_class FROM (SELECT max(ind) AS top FROM ind GROUP BY topic)"

    q["newsgroup_corpus"] = f"""WITH sides AS (
  SELECT {SPLIT_SIDE}::INTEGER AS side, source AS topic, doc_id::VARCHAR AS id, len({_tokens_of('text')})::INTEGER AS n_words FROM documents)
SELECT side, topic, id AS "ID", row_number() OVER (PARTITION BY side, topic ORDER BY id) - 1 AS ind, n_words
FROM sides WHERE topic IN (SELECT topic FROM sides WHERE side = 0)"""

    # splits
    u = _unit("doc_id", str(S.SEED))
    q["hash_split"] = f"SELECT doc_id, (({u} >= 0.7)::INTEGER + ({u} >= 0.9)::INTEGER)::INTEGER AS side FROM documents"
    q["balanced_window_split"] = _with(topic_index) + f"""SELECT topic AS source, id AS doc_id, ind,
  CASE WHEN ind >= {lo} AND ind < {lo + n} THEN topic END AS label FROM ind"""
    q["stratified_split"] = f"""SELECT doc_id, lang AS label, ({_unit('doc_id', str(S.SEED), 'lang')} >= 0.25)::INTEGER AS side FROM documents"""
    q["random_split"] = "SELECT doc_id, 1::BIGINT AS n_sides FROM documents"
    share = "CASE quality " + " ".join(f"WHEN {c} THEN {f}" for c, f in S.STRATA_FRACTIONS.items()) + " ELSE 0 END"
    q["sample_strata"] = f"""SELECT doc_id, quality AS label,
  CASE WHEN {_unit('doc_id', str(S.SEED), 'quality')} < {share} THEN 0 ELSE 1 END AS side FROM labels"""
    sizes = ", ".join(f"({x})" for x in S.SWEEP_SIZES)
    q["size_sweep"] = f"""SELECT n_sup::INTEGER AS n_sup, doc_id FROM documents, (VALUES {sizes}) v(n_sup) WHERE {u} < n_sup / {S.SWEEP_BASE}.0"""

    # sets and aggregates
    q["union_all"] = "SELECT doc_id, lang, source FROM documents UNION ALL SELECT doc_id, lang, source FROM documents JOIN labels USING (doc_id)"
    q["first_documents"] = "SELECT doc_id, lang, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 20"
    q["row_counts"] = """SELECT 'documents' AS input, count(*) AS n FROM documents UNION ALL SELECT 'labelled', count(*) FROM labels
UNION ALL SELECT 'unlabelled', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
    q["conditional_counts"] = """SELECT count(*) AS n_rows, count_if(quality = 0)::BIGINT AS n_label0, count_if(quality = 1)::BIGINT AS n_label1,
  round(count_if(quality = 0)::DOUBLE / count_if(quality IN (0, 1)), 6) AS ratio FROM labels"""
    full = _with(COUNTS, ALL_LABELLED, model_ctes("0", "full_lab"))
    q["class_mass"] = full + "SELECT label, bucket, round(mass, 6) AS mass, df FROM m0"
    q["sorted_class_sums"] = full + "SELECT label, n_rows, round(mass, 6) AS mass FROM p0 ORDER BY label"

    # models
    q["nb_prior"] = full + "SELECT label, n, seen, round(pi, 6) AS pi, round(log_denom, 6) AS log_denom FROM p0"
    theta = f"round(ln(mass + {LAM}) - log_denom, 6)"
    q["nb_theta"] = full + f"""SELECT p.label, b.bucket::INTEGER AS bucket, round(ln(coalesce(m.mass, 0) + {LAM}) - p.log_denom, 6) AS log_theta
FROM p0 p CROSS JOIN range({V}) b(bucket) LEFT JOIN m0 m ON m.label = p.label AND m.bucket = b.bucket"""
    q["nb_theta_bernoulli"] = _with(COUNTS, ALL_LABELLED, model_ctes("0", "full_lab", bernoulli=True)) + f"""
SELECT p.label, b.bucket::INTEGER AS bucket, round(ln(coalesce(m.mass, 0) + {LAM}) - p.log_denom, 6) AS log_theta, round(p.pi, 6) AS pi
FROM p0 p CROSS JOIN range({V}) b(bucket) LEFT JOIN m0 m ON m.label = p.label AND m.bucket = b.bucket"""
    scored = _with(COUNTS, ALL_LABELLED, ALL_DOCS, model_ctes("0", "full_lab"), score_ctes("0", "every"))
    q["nb_score"] = scored + "SELECT doc_id, label, round(raw, 4) AS raw FROM s0"
    q["nb_posterior"] = scored + "SELECT doc_id, label, round(posterior, 6) AS posterior FROM s0"
    q["nb_predict"] = scored + "SELECT doc_id, label AS prediction FROM y0"
    q["nb_predict_bernoulli"] = _with(COUNTS, ALL_LABELLED, model_ctes("0", "full_lab", bernoulli=True), f"""
cells AS (
  SELECT p.label, p.pi, b.bucket, ln(coalesce(m.mass, 0) + {LAM}) - p.log_denom AS th
  FROM p0 p CROSS JOIN range({V}) b(bucket) LEFT JOIN m0 m ON m.label = p.label AND m.bucket = b.bucket),
base AS (SELECT label, any_value(pi) + sum(ln(1 - exp(th))) AS bias FROM cells GROUP BY label),
raws AS (
  SELECT d.doc_id, b.label, b.bias + coalesce(x.s, 0) AS raw FROM documents d CROSS JOIN base b LEFT JOIN (
    SELECT t.doc_id, c.label, sum(c.th - ln(1 - exp(c.th))) AS s FROM tf t JOIN cells c USING (bucket) GROUP BY ALL) x
  ON x.doc_id = d.doc_id AND x.label = b.label)""") + """
SELECT doc_id, min(label) AS prediction FROM (SELECT *, max(raw) OVER (PARTITION BY doc_id) AS top FROM raws) WHERE raw >= top - 1e-9 GROUP BY doc_id"""
    q["prediction_certainty"] = scored + """
SELECT doc_id, round(greatest(0, least(1, (a - b - 0.05) / 0.75)), 6) AS certainty,
  round(greatest(0, least(1, (p0 - p1 - 0.05) / 0.75)), 6) AS certainty_positional
FROM (SELECT doc_id, max(posterior) AS a, min(posterior) AS b, max(posterior) FILTER (label = 0) AS p0,
  max(posterior) FILTER (label = 1) AS p1 FROM s0 GROUP BY doc_id)"""
    q["model_log_prob"] = full + f"SELECT round(model_log_prob, 4) AS model_log_prob FROM ({log_prob_sql('0')})"
    q["data_log_prob"] = full + f"SELECT round(data_log_prob, 4) AS data_log_prob FROM ({log_prob_sql('0')})"
    a = S.DIRICHLET_ALPHA
    q["dirichlet_prior"] = full + f"""SELECT p.label, round((lgamma({V} * {a}) - {V} * lgamma({a})
    + ({a} - 1) * (coalesce(c.theta, 0) + ({V} - p.seen) * (ln({LAM}) - p.log_denom))) / ln(2), 4) AS dirichlet_log2
FROM p0 p LEFT JOIN (SELECT m.label, sum(ln(m.mass + {LAM}) - p.log_denom) AS theta FROM m0 m JOIN p0 p USING (label) GROUP BY ALL) c USING (label)"""

    q["log_gamma_values"] = """SELECT l_orderkey, l_linenumber, round(lgamma(x), 6) AS small, round(lgamma(y) / y, 6) AS large,
  round(lgamma(-x - 0.25), 6) AS negative
FROM (SELECT *, l_quantity::DOUBLE / 7 AS x, l_extendedprice::DOUBLE AS y FROM lineitem)"""

    def density(name: str, alpha: str) -> str:
        return f"""SELECT '{name}' AS alphas, label, round((lgamma(sum(al)) - sum(lgamma(al)) + sum((al - 1) * th)) / ln(2), 4) AS dirichlet_log2
FROM (SELECT p.label, {alpha} AS al, ln(coalesce(m.mass, 0) + {LAM}) - p.log_denom AS th
  FROM p0 p CROSS JOIN range({V}) b(bucket) LEFT JOIN m0 m ON m.label = p.label AND m.bucket = b.bucket) GROUP BY label"""

    q["dirichlet_by_feature"] = full + density("feature", "0.25 + (b.bucket % 4) * 0.5") + "\nUNION ALL " + density(
        "class and feature", "0.25 + (b.bucket % 4) * 0.5 + p.label")
    q["saved_classifier"] = _with(
        COUNTS, LANG_TRAIN, "upper AS (SELECT 0 AS run, doc_id, label, 1.0::DOUBLE AS w, 1 AS counted FROM train)", ALL_DOCS,
        model_ctes("0", "upper"), score_ctes("0", "every"),
    ) + "SELECT doc_id, lang AS prediction FROM y0 JOIN codes USING (label)"

    # expectation maximisation
    corpus = _with(COUNTS, CORPUS, em_ctes(S.EPOCHS, "lab", "free", "tst"), trace_cte(S.EPOCHS, "lab", "tst"))
    q["em_step"] = _with(COUNTS, CORPUS, em_ctes(1, "lab", "free", "tst")) + """
SELECT p.label, p.n, m.bucket, round(m.mass, 6) AS mass, m.df FROM m1 m JOIN p1 p USING (label)"""
    q["pseudo_labels"] = _with(COUNTS, CORPUS, em_ctes(1, "lab", "free", "tst")) + f"""
SELECT f.doc_id, y.label AS label, round(s.posterior, 6) AS weight1, {S.UNLABELED_WEIGHT}::DOUBLE AS "groundTruth"
FROM free f JOIN y0 y USING (doc_id) JOIN s0 s ON s.doc_id = f.doc_id AND s.label = 1"""
    q["em_trace"] = corpus + f"SELECT {TRACE_COLUMNS} FROM trace"
    q["em_resumed"] = _with(COUNTS, CORPUS, em_ctes(S.EPOCHS, "lab", "free", "tst"), trace_cte(S.EPOCHS, "lab", "tst")) + f"""
SELECT {TRACE_COLUMNS} FROM trace
WHERE epoch <= (SELECT coalesce(min(epoch) FILTER (improvement < {S.MIN_IMPROVEMENT}), {S.EPOCHS}) FROM trace)"""
    q["relative_change"] = corpus + "SELECT epoch::INTEGER AS epoch, round(improvement, 9) AS improvement FROM trace"
    q["em_loop"] = _loop_sql()
    q["em_weighting"] = "\nUNION ALL ".join(
        _weighting(name, w, soft)
        for name, w, soft in (("hard", 1.0, False), ("row", S.UNLABELED_WEIGHT, False), ("soft", S.UNLABELED_WEIGHT, True))
    )
    base = _with(COUNTS, CORPUS, "lab1 AS (SELECT *, 1.0::DOUBLE AS w, 1 AS counted FROM lab)", model_ctes("0", "lab1"), score_ctes("0", "tst"))
    q["supervised_baseline"] = base + f"SELECT {_ACC_BY} FROM tst t JOIN y0 y USING (run, doc_id)"
    q["all_labels_bound"] = _with(
        COUNTS, LANG_TRAIN, "upper AS (SELECT 0 AS run, doc_id, label, 1.0::DOUBLE AS w, 1 AS counted FROM train)",
        "gtest AS (SELECT 0 AS run, doc_id, label FROM test)", model_ctes("0", "upper"), score_ctes("0", "gtest"),
    ) + f"SELECT {_ACC_BY} FROM gtest t JOIN y0 y USING (run, doc_id)"

    def variant(name: str, normalise: bool) -> str:
        return f"""SELECT * FROM ({_with(COUNTS, LANG_TRAIN, grid_ctes(S.COMPARE_SIZES, 1),
            "seeds AS (SELECT *, 1.0::DOUBLE AS w, 1 AS counted FROM glab)",
            model_ctes("0", "seeds", normalise=normalise), score_ctes("0", "gtest"))}
  SELECT '{name}' AS variant, g.n_sup::INTEGER AS n_sup, {_ACC_BY}
  FROM grid g JOIN gtest t USING (run) JOIN y0 y ON y.run = t.run AND y.doc_id = t.doc_id GROUP BY g.n_sup)"""

    q["normalised_vs_stock"] = variant("normalised", True) + "\nUNION ALL " + variant("stock", False)

    # evaluation
    q["accuracy"] = scored + f"SELECT {_ACC_BY} FROM labels l JOIN (SELECT doc_id, quality AS label FROM labels) t USING (doc_id) JOIN y0 y USING (doc_id)"
    q["corpus_summary"] = """SELECT count(quality) AS n_labelled, count_if(quality = 0)::BIGINT AS n_label0,
  count_if(quality IS NULL)::BIGINT AS n_unlabelled, round(count_if(quality = 0)::DOUBLE / count(quality), 6) AS ratio
FROM documents LEFT JOIN labels USING (doc_id)"""
    q["trial_grid"] = _GRID_EM + """SELECT n_sup::INTEGER AS n_sup, trial::INTEGER AS trial, start, n_rows,
  round(acc_sup, 6) AS acc_sup, round(acc_em, 6) AS acc_em FROM acc"""
    q["trial_grid_joined"] = q["trial_grid"]
    q["trial_summary"] = _GRID_EM + """SELECT n_sup::INTEGER AS n_sup, count(*) AS n_trials, round(avg(acc_sup), 6) AS mean_sup,
  round(stddev_pop(acc_sup), 6) AS sd_sup, round(avg(acc_em), 6) AS mean_em, round(stddev_pop(acc_em), 6) AS sd_em FROM acc GROUP BY n_sup"""
    q["random_size_grid"] = _RANDOM + f"SELECT n_sup, trial, n_labelled, n_label0, n_rows, {_rounded('acc_sup', 'acc_em')} FROM random"
    q["random_size_summary"] = _RANDOM + _summary("random", "n_sup", "sup", "em")
    q["sample_bounds"] = _with(_runs("draw", "size, trial", [(n, t) for n in S.RANDOM_SIZES for t in range(1, S.RANDOM_TRIALS + 1)])) + f"""
SELECT trial::INTEGER AS trial, size::BIGINT AS size, hash, doc_id FROM (
  SELECT size, trial, doc_id, {_hash32('doc_id', str(S.SEED), 'trial')} AS hash,
    row_number() OVER (PARTITION BY run ORDER BY {_hash32('doc_id', str(S.SEED), 'trial')}, doc_id) AS place FROM draw, documents) WHERE place = size"""
    q["weighted_grid"] = _weighted() + f"SELECT n_sup, trial, start, n_rows, {_rounded('acc_sup', 'acc_full', 'acc_reduced')} FROM weighted"
    q["weighted_summary"] = _weighted() + _summary("weighted", "n_sup", "sup", "full", "reduced")
    q["share_trials"] = _SHARES + f"SELECT share, trial, n_labelled, n_label0, n_unlabelled, n_rows, {_rounded('acc_sup', 'acc_em')} FROM shares"
    q["share_summary"] = _SHARES + _summary("shares", "share", "sup", "em")
    shares = ", ".join(f"({i}, {s})" for i, s in enumerate(S.LABEL_SHARES))
    seed2, seed3 = S.SEED + 1, S.SEED + 2
    q["labelled_share_sweep"] = _with(COUNTS, CORPUS, f"""shares AS (SELECT * FROM (VALUES {shares}) v(run, share)),
slab AS MATERIALIZED (SELECT s.run, doc_id, label FROM shares s JOIN lab ON {_unit('doc_id', str(seed2))} < share),
sfree AS MATERIALIZED (SELECT s.run, doc_id FROM shares s, free f WHERE {_unit('doc_id', str(seed3))} < 0.1),
stst AS MATERIALIZED (SELECT s.run, doc_id, label FROM shares s, tst t)""",
        em_ctes(S.GRID_EPOCHS, "slab", "sfree", "stst"), score_ctes(str(S.GRID_EPOCHS), "stst")) + f"""
SELECT s.share::DOUBLE AS share, count(*) AS n_rows, round(avg((a.label = t.label)::INTEGER), 6) AS acc_sup,
  round(avg((b.label = t.label)::INTEGER), 6) AS acc_em
FROM shares s JOIN stst t USING (run) JOIN y0 a ON a.run = t.run AND a.doc_id = t.doc_id
JOIN y{S.GRID_EPOCHS} b ON b.run = t.run AND b.doc_id = t.doc_id GROUP BY s.share"""
    return q
