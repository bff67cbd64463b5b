"""DuckDB twins of the catalogue queries (the correctness oracle).

Each string runs in DuckDB over the driver tables registered as views.  The
shared fragments below spell the engine's dataset mapping in SQL.  Doubles are
rounded to 6 places and integers cast to BIGINT on both sides.
"""

from __future__ import annotations

# Word tokens: lower-case, split on runs of non letters/digits, drop empties.
TOK = r"list_filter(regexp_split_to_array(lower({t}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


def tok(text: str = "text") -> str:
    return TOK.format(t=text)


#: Stands for a NULL dataset inside the SQL of joins by name.
NO_NAME = "<none>"
LANG_ROWS = f"SELECT coalesce(lang, '{NO_NAME}') AS dataset, doc_id AS row_id, text FROM documents"
TRAIN_ROWS = "SELECT source AS dataset, doc_id AS row_id, text FROM documents"
EVAL_ROWS = ("SELECT 'bench' AS dataset, item_id AS row_id, text FROM benchmark UNION ALL "
             "SELECT 'toxic' AS dataset, doc_id AS row_id, text FROM documents "
             "WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)")


def counts_ctes(alpha: float = 1.0) -> str:
    """tc(dataset,tok,cnt), ec(eval_dataset,tok,cnt), cw(tok,C), vs(V), nt(N)."""
    return f"""
tc AS (SELECT dataset, tok, count(*) AS cnt
       FROM (SELECT dataset, unnest({tok()}) AS tok FROM ({TRAIN_ROWS})) GROUP BY ALL),
ec AS (SELECT dataset AS eval_dataset, tok, count(*) AS cnt
       FROM (SELECT dataset, unnest({tok()}) AS tok FROM ({EVAL_ROWS})) GROUP BY ALL),
cw AS (SELECT tok, sum(cnt) AS C FROM tc GROUP BY tok),
vocab AS (SELECT tok FROM tc UNION SELECT tok FROM ec),
vs AS (SELECT count(*) AS V FROM vocab),
nt AS (SELECT sum(cnt) AS N FROM tc),
nd AS (SELECT dataset, sum(cnt) AS n_d FROM tc GROUP BY dataset),
ne AS (SELECT eval_dataset, sum(cnt) AS n_e FROM ec GROUP BY eval_dataset)"""


def influence_loo(alpha: float = 1.0) -> str:
    a = float(alpha)
    return f"""
WITH {counts_ctes(alpha)},
base AS (
  SELECT ec.eval_dataset, sum(ec.cnt * (ln(nt.N + {a} * vs.V) - ln(coalesce(cw.C, 0) + {a}))) AS s
  FROM ec LEFT JOIN cw USING (tok) CROSS JOIN nt CROSS JOIN vs GROUP BY ec.eval_dataset),
loo AS (
  SELECT nd.dataset, ec.eval_dataset,
         sum(ec.cnt * (ln(nt.N - nd.n_d + {a} * vs.V)
                       - ln(coalesce(cw.C, 0) - coalesce(tc.cnt, 0) + {a}))) AS s
  FROM nd CROSS JOIN ec LEFT JOIN cw ON cw.tok = ec.tok
       LEFT JOIN tc ON tc.dataset = nd.dataset AND tc.tok = ec.tok
       CROSS JOIN nt CROSS JOIN vs
  GROUP BY nd.dataset, ec.eval_dataset)
SELECT loo.dataset AS train_dataset, loo.eval_dataset,
       round((loo.s - base.s) / ne.n_e, 6) AS influence
FROM loo JOIN base USING (eval_dataset) JOIN ne USING (eval_dataset)"""


def sample_sql(rows: str, by: list[str], key: str, cols: list[str], k: int | None = None,
               spec: str | None = None, seed=42, salt: str = "") -> str:
    """SQL twin of ``sampling.sample``: full epochs by unnest(range(q)), the
    remainder as the first r of md5(seed:by:epoch:key)."""
    b = ", ".join(by)
    on = " AND ".join(f"r.{c} IS NOT DISTINCT FROM s.{c}" for c in by)
    kexpr = f"CAST({k} AS BIGINT)" if k is not None else "sp.k"
    same = " AND ".join(f"n.{c} IS NOT DISTINCT FROM sp.{c}" for c in by)
    spec_join = f" JOIN ({spec}) sp ON {same}" if spec is not None else ""
    hk = ", ".join([f"'{seed}{salt}'"] + [f"CAST(r.{c} AS VARCHAR)" for c in by]
                   + ["CAST(s.q AS VARCHAR)", f"CAST(r.{key} AS VARCHAR)"])
    c = ", ".join(f"r.{x}" for x in cols)
    c2 = ", ".join(cols)
    return f"""
WITH r AS ({rows}),
n AS (SELECT {b}, count(*) AS n FROM r GROUP BY {b}),
s AS (SELECT {", ".join("n." + c for c in by)}, {kexpr} // n AS q, {kexpr} % n AS rr FROM n{spec_join}),
fullq AS (SELECT {c}, unnest(range(s.q)) AS epoch FROM r JOIN s ON {on} WHERE s.q > 0),
part AS (SELECT {c}, s.q AS epoch, s.rr,
                row_number() OVER (PARTITION BY {", ".join("r." + x for x in by)}
                                   ORDER BY md5(concat_ws(':', {hk})), r.{key}) AS rn
         FROM r JOIN s ON {on} WHERE s.rr > 0)
SELECT {c2}, epoch FROM fullq UNION ALL SELECT {c2}, epoch FROM part WHERE rn <= rr"""


DOC_LINES = ("SELECT d.doc_id, d.lang, d.text, u.line, u.line_no FROM documents d, "
             "LATERAL (SELECT unnest(string_split(d.text, chr(10))) AS line, "
             "generate_subscripts(string_split(d.text, chr(10)), 1) - 1 AS line_no) u")

TOXIC_RAW = f"""SELECT x.line AS generation, x.lang AS "group", l.toxic AS prompt_label,
  CAST(x.doc_id AS VARCHAR) || ':' || CAST(x.line_no AS VARCHAR) AS key
  FROM ({DOC_LINES}) x LEFT JOIN labels l ON l.doc_id = x.doc_id"""

COREF_ROWS = f"""SELECT array_to_string(string_split(x.line, ' '), ' ') AS inputs_pretokenized,
  CASE WHEN f AND NOT m THEN t || '_female' WHEN m AND NOT f THEN t || '_male' END AS dataset,
  key FROM (
   SELECT line, CASE WHEN doc_id % 2 = 0 THEN 'pro' ELSE 'anti' END AS t,
     list_has_any(string_split(line, ' '), ['the', 'that']) AS f,
     list_has_any(string_split(line, ' '), ['and', 'of']) AS m,
     CAST(doc_id AS VARCHAR) || ':' || CAST(line_no AS VARCHAR) AS key
   FROM ({DOC_LINES})) x"""

QA_RAW = """
SELECT q.text AS question,
  (['Indexical Error: Time', 'Confusion: People', 'Misconceptions', 'Law', 'Health'])[q.conv_id % 5 + 1] AS category,
  a.text AS answer,
  CAST(q.conv_id AS VARCHAR) || ':' || CAST(q.turn AS VARCHAR) || ':' || CAST(a.turn AS VARCHAR) AS key
FROM conversations q JOIN (
  SELECT * FROM (
    SELECT conv_id, turn, role, text,
           max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn
               ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS q_turn
    FROM conversations)
  WHERE role = 'assistant' AND q_turn IS NOT NULL) a
ON a.conv_id = q.conv_id AND a.q_turn = q.turn
WHERE q.role = 'user'"""

USTRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"

QA_ROWS = f"""
SELECT {USTRIP.format(x='question')} AS inputs_pretokenized,
       {USTRIP.format(x='answer')} AS targets_pretokenized,
       CASE WHEN contains(category, 'Indexical Error') THEN 'indexical_error'
            WHEN contains(category, 'Confusion') THEN 'confusion' ELSE lower(category) END AS dataset,
       key AS pair_key
FROM ({QA_RAW})"""

# The weighted-mixture fractions, in the reference's order,
# applied to sources src0 .. src7.
MIXTURE_FRACTIONS = [0.30, 0.20, 0.15, 0.10, 0.10, 0.05, 0.05, 0.05]


def vocab_sql() -> str:
    return f"""
SELECT tok, count, CAST(row_number() OVER (ORDER BY count DESC, tok) - 1 + 4 AS INTEGER) AS id
FROM (SELECT tok, count(*) AS count FROM (SELECT unnest({tok()}) AS tok FROM documents)
      GROUP BY tok)"""


def encode_sql() -> str:
    return f"""
WITH v AS ({vocab_sql()}),
t AS (SELECT dataset, row_id, unnest({tok()}) AS tok, generate_subscripts({tok()}, 1) AS pos
      FROM ({TRAIN_ROWS} UNION ALL {EVAL_ROWS}))
SELECT dataset, row_id, count(*) AS n_ids,
       CAST(sum(CASE WHEN v.id IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_unk,
       md5(string_agg(CAST(coalesce(v.id, 1) AS VARCHAR), ',' ORDER BY pos)) AS ids_md5
FROM t LEFT JOIN v USING (tok) GROUP BY dataset, row_id"""


def pack_sql(block: int, batch_docs: int, order: str = "doc_id", sep: str = " ",
             rows: str = "SELECT source AS dataset, doc_id, string_split(text, ' ') AS ids FROM documents",
             shards: int = 1) -> str:
    """With ``shards`` the list of shard sizes is written out, and a batch is
    numbered by the shards before its own."""
    numbered = f"""
n AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {order}) - 1 AS p FROM d),
o AS (SELECT *, p // {batch_docs} AS batch_id, CAST(len(ids) AS BIGINT) AS l FROM n),"""
    if shards > 1:
        numbered = f"""
c AS (SELECT dataset, count(*) AS n, least(count(*), {shards}) AS k FROM d GROUP BY dataset),
sz AS (SELECT dataset, i, n // k + CASE WHEN i < n % k THEN 1 ELSE 0 END AS size
       FROM (SELECT dataset, n, k, unnest(range(k)) AS i FROM c)),
sh AS (SELECT dataset, size,
              coalesce(sum(size) OVER w, 0) AS lo,
              coalesce(sum((size + {batch_docs} - 1) // {batch_docs}) OVER w, 0) AS before
       FROM sz WINDOW w AS (PARTITION BY dataset ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
n AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY {order}) - 1 AS p FROM d),
o AS (SELECT n.*, CAST(before + (p - lo) // {batch_docs} AS BIGINT) AS batch_id, CAST(len(ids) AS BIGINT) AS l
      FROM n JOIN sh ON n.dataset IS NOT DISTINCT FROM sh.dataset AND p >= lo AND p < lo + size),"""
    return f"""
WITH d AS ({rows}),{numbered}
s AS (SELECT *, CAST(coalesce(sum(l) OVER (PARTITION BY dataset, batch_id ORDER BY {order}
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
             CAST(sum(l) OVER (PARTITION BY dataset, batch_id) AS BIGINT) AS total FROM o),
k AS (SELECT *, CASE WHEN total >= {block} THEN total // {block} * {block} ELSE total END AS keep FROM s),
t AS (SELECT dataset, batch_id, start + p - 1 AS pos, tok, keep
      FROM (SELECT dataset, batch_id, start, keep, unnest(ids) AS tok, generate_subscripts(ids, 1) AS p FROM k))
SELECT dataset, CAST(batch_id AS BIGINT) AS batch_id, CAST(pos // {block} AS BIGINT) AS block_no,
       count(*) AS n_tokens, md5(string_agg(CAST(tok AS VARCHAR), '{sep}' ORDER BY pos)) AS block_md5
FROM t WHERE pos < keep GROUP BY ALL"""


def corpus_sql(block: int, batch_docs: int, seed=42, doc_spec: str | None = None,
               k: int | None = None, spec: str | None = None) -> str:
    """Documents (sampled by ``doc_spec``, all of a source it lacks) hashed, packed,
    numbered, and ``k`` blocks a source or by ``spec`` drawn."""
    rows = "SELECT source AS dataset, doc_id FROM documents"
    docs = f"SELECT dataset, doc_id, 0 AS epoch FROM ({rows})"
    if doc_spec is not None:
        docs = sample_sql(rows, ["dataset"], "doc_id", ["dataset", "doc_id"], seed=seed, salt="corpus", spec=f"""
            SELECT a.dataset, coalesce(b.k, a.n) AS k
            FROM (SELECT source AS dataset, count(*) AS n FROM documents GROUP BY source) a
            LEFT JOIN ({doc_spec}) b ON b.dataset IS NOT DISTINCT FROM a.dataset""")
    seqs = (f"SELECT x.dataset, x.epoch, x.doc_id, {hashed_sql('d.text')} AS ids "
            f"FROM ({docs}) x JOIN documents d ON d.doc_id = x.doc_id")
    blocks = pack_sql(block, batch_docs, "epoch, doc_id", ",", seqs)
    numbered = f"""SELECT dataset, n_tokens, n_tokens AS n_attended, block_md5,
        CAST(row_number() OVER (PARTITION BY dataset ORDER BY batch_id, block_no) - 1 AS BIGINT) AS index
        FROM ({blocks})"""
    return sample_sql(numbered, ["dataset"], "index", ["dataset", "index", "n_tokens", "n_attended", "block_md5"],
                      k=k, spec=spec, seed=seed, salt="blocks")


def task_batches_sql(rows: str, order: str, bs: int) -> str:
    """rows(dataset, <order>) -> + batch_id, pos."""
    return f"""
WITH e AS ({rows}),
per AS (SELECT dataset, min({order}) AS f, (count(*) + {bs - 1}) // {bs} AS nb FROM e GROUP BY dataset),
off AS (SELECT dataset, sum(nb) OVER (ORDER BY f, dataset) - nb AS off FROM per),
o AS (SELECT e.*, row_number() OVER (PARTITION BY dataset ORDER BY {order}) - 1 AS ord FROM e)
SELECT o.* EXCLUDE (ord), CAST(off.off + o.ord // {bs} AS BIGINT) AS batch_id,
       CAST(o.ord % {bs} AS BIGINT) AS pos
FROM o JOIN off ON o.dataset IS NOT DISTINCT FROM off.dataset"""


def lm_losses_ctes(alpha: float, bs: int) -> str:
    """ex(dataset,row_id,nll,n_tok), bl(dataset,batch_id,loss,n_rows,n_tok) on the eval rows."""
    a = float(alpha)
    return f"""{counts_ctes(alpha)},
b AS ({task_batches_sql(f"SELECT dataset, row_id FROM ({EVAL_ROWS})", "row_id", bs)}),
ex AS (SELECT x.dataset, x.row_id,
              sum(ln(nt.N + {a} * vs.V) - ln(coalesce(cw.C, 0) + {a})) AS nll, count(*) AS n_tok
       FROM (SELECT dataset, row_id, unnest({tok()}) AS tok FROM ({EVAL_ROWS})) x
       LEFT JOIN cw USING (tok) CROSS JOIN nt CROSS JOIN vs GROUP BY ALL),
l AS (SELECT b.dataset, b.batch_id, ex.row_id, ex.nll, ex.n_tok FROM b JOIN ex USING (dataset, row_id)),
bl AS (SELECT dataset, batch_id, sum(nll) / sum(n_tok) AS loss, count(*) AS n_rows,
              CAST(sum(n_tok) AS BIGINT) AS n_tok FROM l GROUP BY ALL)"""


def hashed_sql(text: str, buckets: int = 50_000) -> str:
    return (f"list_transform(string_split({text}, ' '), lambda w: CAST((('0x' || substr(md5(w), 1, 8))::BIGINT"
            f" % {buckets} + 4) AS INTEGER))")


PAIRS = """SELECT u.conv_id, u.turn, u.text AS prompt, a.text AS target
FROM conversations u LEFT JOIN conversations a
  ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
WHERE u.role = 'user'"""


def collate_causal_sql(max_len: int, sep_id: int, bs: int) -> str:
    return f"""
WITH pr AS ({PAIRS}),
t AS (SELECT conv_id, turn, target IS NOT NULL AS has,
             list_concat([2], ({hashed_sql("coalesce(prompt || ' ######## ' || target, prompt)")})[1:{max_len - 1}]) AS ids,
             (row_number() OVER (ORDER BY conv_id, turn) - 1) // {bs} AS batch_id FROM pr),
p AS (SELECT *, list_max(list_filter(range(1, len(ids) + 1), lambda i: ids[i] = {sep_id})) AS sp,
             bool_or(has) OVER (PARTITION BY batch_id) AS mode FROM t),
s AS (SELECT *, CASE WHEN sp IS NULL OR NOT mode THEN ids ELSE list_concat(ids[1:sp - 1], ids[sp + 1:]) END AS sids,
             CASE WHEN NOT mode THEN ids WHEN sp IS NULL THEN list_transform(ids, lambda x: -100)
                  ELSE list_concat(list_transform(range(sp - 1), lambda x: -100), ids[sp + 1:]) END AS lab FROM p),
m AS (SELECT *, max(len(sids)) OVER (PARTITION BY batch_id) AS L FROM s)
SELECT conv_id, turn, CAST(batch_id AS BIGINT) AS batch_id,
       array_to_string(list_resize(sids, L, 0), ',') AS input_ids,
       array_to_string(list_resize(list_transform(sids, lambda x: 1), L, 0), ',') AS attention_mask,
       array_to_string(list_resize(lab, L, -100), ',') AS labels, CASE WHEN mode THEN sp IS NOT NULL END AS sep_found
FROM m"""


def collate_seq2seq_sql(max_src: int, max_tgt: int, bs: int) -> str:
    return f"""
WITH pr AS ({PAIRS}),
t AS (SELECT conv_id, turn, ({hashed_sql("prompt")})[1:{max_src}] AS src,
             list_concat(({hashed_sql("coalesce(target, '')")})[1:{max_tgt - 1}], [3]) AS tgt,
             (row_number() OVER (ORDER BY conv_id, turn) - 1) // {bs} AS batch_id FROM pr),
m AS (SELECT *, max(len(src)) OVER (PARTITION BY batch_id) AS Ls,
                max(len(tgt)) OVER (PARTITION BY batch_id) AS Lt FROM t),
o AS (SELECT *, list_resize(tgt, Lt, -100) AS lab FROM m)
SELECT conv_id, turn, CAST(batch_id AS BIGINT) AS batch_id,
       array_to_string(list_resize(src, Ls, 0), ',') AS input_ids,
       array_to_string(list_resize(list_transform(src, lambda x: 1), Ls, 0), ',') AS attention_mask,
       array_to_string(lab, ',') AS labels,
       array_to_string(list_concat([0], list_transform(lab[1:len(lab) - 1],
                       lambda x: CASE WHEN x = -100 THEN 0 ELSE x END)), ',') AS decoder_input_ids
FROM o"""


def unlearn_sql(kind: str = "forward", opt: str = "sgd", lr: float = 5.0, steps: int = 2,
                n_micro: int = 2, accum: int = 1, clip: float = 0.0, warmup: int = 0,
                alpha: float = 1.0, eval_on: str = "eval", output: str = "influence",
                beta1: float = 0.9, beta2: float = 0.999, eps: float = 1e-8,
                eval_steps: int = 1, eval_batch: int = 8, batch_rows: int = 2,
                lr_rows: bool = False, rows: str | None = None, run_batch: int | None = None) -> str:
    """The unlearning loop unrolled as CTEs (one CTE chain per step).

    kind: forward (runs = training datasets, micro-batches = key-order slices)
          or inverse (runs = evaluation sets, every step = the mean over all
          micro-batches of ``batch_rows`` rows of the set).
    The loss of a set is the mean over its batches of ``eval_batch`` rows of
    the batch's token mean, weighted by the batch's rows.
    eval_on: eval | train - which sets the losses are measured on.
    output: influence (run, eval, step, influence) or log (run, step, eval, metric, loss).
    rows, run_batch: training rows (dataset, row_id, text) other than the sources', whose
          runs take one epoch in micro-batches of ``run_batch`` rows; ``steps`` is at least
          the longest epoch, and a run shows only its own steps.
    """
    r = repr
    parts = [counts_ctes(alpha)]
    parts.append(f"m0 AS (SELECT tok, ln(coalesce(cw.C, 0) + {r(float(alpha))}) AS theta FROM vocab LEFT JOIN cw USING (tok))")
    if kind == "forward":
        parts.append("runs AS (SELECT DISTINCT dataset AS run_id FROM tc)")
        if run_batch:
            parts.append(f"""mbrows AS (SELECT dataset AS run_id, text,
                (row_number() OVER (PARTITION BY dataset ORDER BY row_id) - 1) // {run_batch} AS b FROM ({TRAIN_ROWS}))""")
            parts.append(f"""ns AS (SELECT dataset AS run_id,
                ceil(ceil(count(*) / {float(run_batch)}) / {float(accum)}) AS n_steps FROM ({TRAIN_ROWS}) GROUP BY ALL)""")
        else:
            parts.append(f"""mbrows AS (SELECT source AS run_id, text,
            (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) * {n_micro}
              // count(*) OVER (PARTITION BY source) AS b FROM documents)""")
        parts.append(f"""mb AS (SELECT run_id, b, tok, count(*) AS cnt
            FROM (SELECT run_id, b, unnest({tok()}) AS tok FROM mbrows) GROUP BY ALL)""")
    else:
        parts.append("runs AS (SELECT DISTINCT eval_dataset AS run_id FROM ec)")
        parts.append(f"""mbrows AS (SELECT dataset AS run_id, text,
            (row_number() OVER (PARTITION BY dataset ORDER BY row_id) - 1) // {batch_rows} AS b FROM ({EVAL_ROWS}))""")
        parts.append(f"""mb AS (SELECT run_id, b, tok, count(*) AS cnt
            FROM (SELECT run_id, b, unnest({tok()}) AS tok FROM mbrows) GROUP BY ALL)""")
    parts.append(f"""evr AS (SELECT dataset, {tok()} AS toks,
        (row_number() OVER (PARTITION BY dataset ORDER BY row_id) - 1) // {eval_batch} AS b
        FROM ({EVAL_ROWS if eval_on == "eval" else TRAIN_ROWS}))""")
    parts.append("evw AS (SELECT dataset, b, count(*) / sum(len(toks)) AS w FROM evr GROUP BY ALL HAVING sum(len(toks)) > 0)")
    parts.append("""evalc AS (SELECT dataset AS eval_dataset, tok, sum(w) AS cnt
        FROM (SELECT evr.dataset, evw.w, unnest(toks) AS tok FROM evr JOIN evw USING (dataset, b)) GROUP BY ALL)""")
    parts.append("evn AS (SELECT eval_dataset, sum(cnt) AS n FROM evalc GROUP BY eval_dataset)")
    parts.append("nb AS (SELECT run_id, b, sum(cnt) AS nb FROM mb GROUP BY ALL)")
    if kind == "forward":
        parts.append(f"""q AS (SELECT run_id, b // {accum} + 1 AS step, tok, sum(cnt / nb) / {accum} AS q
            FROM mb JOIN nb USING (run_id, b) GROUP BY ALL)""")
        parts.append(f"w AS (SELECT run_id, b // {accum} + 1 AS step, count(*) / {accum} AS a FROM nb GROUP BY ALL)")
    else:
        every = f"(SELECT unnest(range(1, {steps + 1})) AS step) s"
        parts.append(f"""q AS (SELECT qq.*, s.step FROM (SELECT run_id, tok, sum(cnt / nb / n_b) AS q
            FROM mb JOIN nb USING (run_id, b) JOIN (SELECT run_id, count(*) AS n_b FROM nb GROUP BY run_id) USING (run_id)
            GROUP BY ALL) qq, {every})""")
        parts.append(f"w AS (SELECT r.run_id, s.step, 1.0 AS a FROM (SELECT DISTINCT run_id FROM nb) r, {every})")
    parts.append("p0 AS (SELECT run_id, tok, theta, 0.0 AS m, 0.0 AS v FROM runs CROSS JOIN m0)")
    parts.append("z0 AS (SELECT run_id, ln(sum(exp(theta))) AS z FROM p0 GROUP BY run_id)")
    for t in range(1, steps + 1):
        lr_t = lr * min(1.0, (t - 1) / warmup) if warmup > 0 else lr
        parts.append(f"""g{t} AS (SELECT p.run_id, p.tok, p.theta, p.m, p.v,
            coalesce(w.a, 0) * exp(p.theta - z.z) - coalesce(q.q, 0) AS g
            FROM p{t - 1} p JOIN z{t - 1} z USING (run_id)
            LEFT JOIN w ON w.run_id = p.run_id AND w.step = {t}
            LEFT JOIN q ON q.run_id = p.run_id AND q.tok = p.tok AND q.step = {t})""")
        src = f"g{t}"
        if clip > 0:
            parts.append(f"""n{t} AS (SELECT run_id, sqrt(sum(g * g)) AS gn,
                least(1.0, {r(float(clip))} / (sqrt(sum(g * g)) + 1e-06)) AS sc FROM g{t} GROUP BY run_id)""")
            parts.append(f"gc{t} AS (SELECT g.run_id, g.tok, g.theta, g.m, g.v, g.g * n.sc AS g FROM g{t} g JOIN n{t} n USING (run_id))")
            src = f"gc{t}"
        if opt == "sgd":
            parts.append(f"p{t} AS (SELECT run_id, tok, theta + {r(lr_t)} * g AS theta, m, v FROM {src})")
        elif opt == "adamw":
            bc1 = 1 - beta1 ** t
            bc2s = (1 - beta2 ** t) ** 0.5
            parts.append(f"""u{t} AS (SELECT run_id, tok, theta, {r(beta1)} * m + {r(1 - beta1)} * g AS m,
                {r(beta2)} * v + {r(1 - beta2)} * g * g AS v FROM {src})""")
            parts.append(f"""p{t} AS (SELECT run_id, tok,
                theta + {r(lr_t)} * ((m / {r(bc1)}) / (sqrt(v) / {r(bc2s)} + {r(eps)})) AS theta, m, v FROM u{t})""")
        else:
            b2 = 1.0 - t ** -0.8
            parts.append(f"""u{t} AS (SELECT run_id, tok, theta, m, g,
                {r(b2)} * v + {r(1 - b2)} * (g * g + 1e-30) AS v FROM {src})""")
            parts.append(f"rr{t} AS (SELECT run_id, sqrt(avg((g / sqrt(v)) * (g / sqrt(v)))) AS rms FROM u{t} GROUP BY run_id)")
            parts.append(f"""p{t} AS (SELECT run_id, tok,
                theta + {r(lr_t)} * ((g / sqrt(v)) / greatest(1.0, rms / 1.0)) AS theta, m, v
                FROM u{t} JOIN rr{t} USING (run_id))""")
        parts.append(f"z{t} AS (SELECT run_id, ln(sum(exp(theta))) AS z FROM p{t} GROUP BY run_id)")
    evals = [t for t in range(0, steps + 1) if t == 0 or t % eval_steps == 0 or t == steps]
    for t in evals:
        parts.append(f"""l{t} AS (SELECT p.run_id, e.eval_dataset, {t} AS step,
            z.z - sum(e.cnt * p.theta) / evn.n AS loss
            FROM evalc e JOIN p{t} p USING (tok) JOIN z{t} z USING (run_id) JOIN evn USING (eval_dataset)
            GROUP BY p.run_id, e.eval_dataset, z.z, evn.n)""")
        parts.append(f"""lo{t} AS (SELECT p.run_id, CAST(NULL AS VARCHAR) AS eval_dataset, {t} AS step,
            z.z - sum(e.cnt * p.theta) / (SELECT sum(n) FROM evn) AS loss
            FROM evalc e JOIN p{t} p USING (tok) JOIN z{t} z USING (run_id) GROUP BY p.run_id, z.z)""")
    allsteps = " UNION ALL ".join(f"SELECT * FROM l{t} UNION ALL SELECT * FROM lo{t}" for t in evals)
    parts.append(f"lall AS ({allsteps})")
    body = "WITH " + ",\n".join(parts)
    if rows is not None:
        body = body.replace(f"({TRAIN_ROWS})", f"({rows})")
        return body + f"""
SELECT nullif(l.run_id, '{NO_NAME}') AS train_dataset, l.eval_dataset, CAST(l.step AS BIGINT) AS step,
       round(l.loss - b.loss, 6) + 0.0 AS influence
FROM lall l JOIN l0 b USING (run_id, eval_dataset) JOIN ns USING (run_id) WHERE l.step BETWEEN 1 AND n_steps"""
    if output == "influence":
        rc, ec_ = ("train_dataset", "eval_dataset") if kind == "forward" else ("eval_dataset", "train_dataset")
        return body + f"""
SELECT l.run_id AS {rc}, l.eval_dataset AS {ec_}, CAST(l.step AS BIGINT) AS step,
       round(l.loss - b.loss, 6) + 0.0 AS influence
FROM lall l JOIN l0 b USING (run_id, eval_dataset) WHERE l.step > 0"""
    sel = """
SELECT run_id, CAST(step AS BIGINT) AS step, eval_dataset, 'eval_loss' AS metric, round(loss, 6) AS value FROM lall"""
    if clip > 0:
        sel += "".join(f"""
UNION ALL SELECT run_id, CAST({t} AS BIGINT), CAST(NULL AS VARCHAR), 'grad_norm', round(gn, 6) FROM n{t}"""
                       for t in range(1, steps + 1))
    if lr_rows:
        rate = {t: lr * min(1.0, t / warmup) if warmup > 0 else lr for t in evals}
        sel += "".join(f"""
UNION ALL SELECT run_id, CAST({t} AS BIGINT), CAST(NULL AS VARCHAR), 'eval_lr', round(CAST({v!r} AS DOUBLE), 6) FROM runs"""
                       for t, v in rate.items())
    return body + sel


def readout_sql(kind: str = "forward", lr: float = 5.0, steps: int = 2, mode: str = "log",
                prefix: str = "eval_loss_") -> str:
    """Read-out twins on top of the unrolled loop's per-step losses ``lall``."""
    eval_on = "eval" if kind == "forward" else "train"
    base = unlearn_sql(kind, "sgd", lr, steps=steps, n_micro=steps, eval_on=eval_on, output="log")
    body = base[:base.index("\nSELECT run_id, CAST(step AS BIGINT)")]
    name = "CASE WHEN eval_dataset IS NULL THEN 'eval_loss' ELSE 'eval_loss_' || eval_dataset END"
    ep = f"CAST(step AS DOUBLE) / {float(steps)}"
    if mode == "log":
        return body + f"""
SELECT run_id, CAST(step AS BIGINT) AS step, round({ep}, 6) AS epoch, {name} AS metric,
       round(loss, 6) AS value FROM lall"""
    if prefix.endswith("_"):
        sel = f"SELECT run_id, replace({name}, '{prefix}', '') AS ed, {ep} AS epoch, loss FROM lall WHERE starts_with({name}, '{prefix}')"
    else:
        sel = f"SELECT run_id, {name} AS ed, {ep} AS epoch, loss FROM lall WHERE {name} = '{prefix}'"
    a, b = ("train_dataset", "eval_dataset") if kind == "forward" else ("eval_dataset", "train_dataset")
    out = f""",
sel AS ({sel}),
bas AS (SELECT ed, loss AS b FROM sel WHERE epoch = 0 AND run_id = (SELECT min(run_id) FROM sel)),
inf AS (SELECT s.run_id, s.ed, s.epoch, s.loss - bas.b AS influence FROM sel s JOIN bas USING (ed) WHERE s.epoch <> 0
        UNION ALL SELECT DISTINCT run_id, ed, 0.0, 0.0 FROM sel)
SELECT run_id AS {a}, ed AS {b}, round(epoch, 6) AS epoch, round(influence, 6) AS influence FROM inf"""
    if mode == "labelled":
        return body + out.replace(
            f"SELECT run_id AS {a}, ed AS {b}, round(epoch, 6) AS epoch, round(influence, 6) AS influence FROM inf",
            f""",
lab AS (SELECT source AS dataset, arg_min(lang, (-n, lang)) AS label
        FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) GROUP BY source)
SELECT i.run_id AS train_dataset, lab.label, round(i.epoch, 6) AS epoch, round(i.influence, 6) AS influence
FROM inf i JOIN lab ON lab.dataset = i.run_id WHERE i.ed = 'bench'""").replace("FROM inf,\nlab", "FROM inf),\nlab", 1)
    return body + out


def run_key_sql(drop: list[str], abbr: list[tuple[str, str]], argv_sql: str) -> str:
    pat = "^(" + "|".join(drop) + ")"
    k = (f"array_to_string(list_transform(list_filter(list_transform(string_split({USTRIP.format(x='argv')}, '--')[2:],"
         f" lambda p: CASE WHEN contains(p, '/') THEN string_split(p, '/')[-1] ELSE p END),"
         f" lambda p: NOT regexp_matches(p, '{pat}')),"
         f" lambda p: replace(replace({USTRIP.format(x='p')}, ' ', '='), 'model=', '')), '-')")
    for a, b in abbr:
        k = f"replace({k}, '{a}', '{b}')"
    return f"SELECT dataset, argv, {k} AS run_key FROM ({argv_sql})"


def logreg_sql(buckets: int, fit_steps: int, lr: float, unlearn_steps: int = 0) -> str:
    """Logistic regression on hashed token buckets: fit by full-batch GD from 0;
    with unlearn_steps > 0, per-source ascent and influence on language sets."""
    r = repr
    hb = (f"list_transform(list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''),"
          f" lambda w: CAST((('0x' || substr(md5(w), 1, 8))::BIGINT % {buckets}) AS INTEGER))")
    parts = [f"ld AS (SELECT d.doc_id, d.source AS dataset, d.lang, d.text, CAST(l.toxic AS DOUBLE) AS y "
             f"FROM documents d JOIN labels l USING (doc_id))",
             f"x AS (SELECT DISTINCT doc_id, dataset, lang, f FROM (SELECT doc_id, dataset, lang, "
             f"unnest(list_concat({hb}, [{buckets}])) AS f FROM ld))",
             "n AS (SELECT count(*) AS n FROM ld)",
             "th0 AS (SELECT DISTINCT f, 0.0 AS theta FROM x)"]
    for t in range(1, fit_steps + 1):
        parts.append(f"""z{t} AS (SELECT x.doc_id, sum(th.theta) AS z FROM x JOIN th{t - 1} th USING (f) GROUP BY x.doc_id)""")
        parts.append(f"""e{t} AS (SELECT doc_id, 1.0 / (1.0 + exp(-z)) - y AS e FROM z{t} JOIN ld USING (doc_id))""")
        parts.append(f"""g{t} AS (SELECT f, sum(e) / (SELECT n FROM n) AS g FROM x JOIN e{t} USING (doc_id) GROUP BY f)""")
        parts.append(f"""th{t} AS (SELECT th.f, th.theta - {r(lr)} * coalesce(g.g, 0.0) AS theta
                          FROM th{t - 1} th LEFT JOIN g{t} g USING (f))""")
    if unlearn_steps == 0:
        return "WITH " + ",\n".join(parts) + f"\nSELECT f, round(theta, 6) AS theta FROM th{fit_steps}"
    parts.append("nd AS (SELECT dataset, count(*) AS n FROM ld GROUP BY dataset)")
    parts.append(f"q0 AS (SELECT nd.dataset AS run_id, th.f, th.theta FROM nd CROSS JOIN th{fit_steps} th)")
    for t in range(1, unlearn_steps + 1):
        parts.append(f"""uz{t} AS (SELECT x.dataset AS run_id, x.doc_id, sum(q.theta) AS z
            FROM x JOIN q{t - 1} q ON q.run_id = x.dataset AND q.f = x.f GROUP BY x.dataset, x.doc_id)""")
        parts.append(f"""ue{t} AS (SELECT run_id, doc_id, 1.0 / (1.0 + exp(-z)) - y AS e FROM uz{t} JOIN ld USING (doc_id))""")
        parts.append(f"""ug{t} AS (SELECT ue.run_id, x.f, sum(ue.e) / nd.n AS g FROM x JOIN ue{t} ue
            ON ue.run_id = x.dataset AND ue.doc_id = x.doc_id JOIN nd ON nd.dataset = ue.run_id GROUP BY ue.run_id, x.f, nd.n)""")
        parts.append(f"""q{t} AS (SELECT q.run_id, q.f, q.theta + {r(lr)} * coalesce(g.g, 0.0) AS theta
            FROM q{t - 1} q LEFT JOIN ug{t} g ON g.run_id = q.run_id AND g.f = q.f)""")
    for t in range(0, unlearn_steps + 1):
        parts.append(f"""ls{t} AS (SELECT run_id, lang AS eval_dataset, {t} AS step,
            avg(greatest(z, 0.0) + ln(1 + exp(-abs(z))) - y * z) AS loss
            FROM (SELECT q.run_id, x.lang, x.doc_id, sum(q.theta) AS z FROM x JOIN q{t} q USING (f)
                  GROUP BY q.run_id, x.lang, x.doc_id) JOIN (SELECT doc_id, y FROM ld) USING (doc_id)
            GROUP BY run_id, lang)""")
    allu = " UNION ALL ".join(f"SELECT * FROM ls{t}" for t in range(1, unlearn_steps + 1))
    parts.append(f"lsa AS ({allu})")
    return "WITH " + ",\n".join(parts) + """
SELECT a.run_id AS train_dataset, a.eval_dataset, CAST(a.step AS BIGINT) AS step,
       round(a.loss - b.loss, 6) AS influence
FROM lsa a JOIN ls0 b ON b.run_id = a.run_id AND b.eval_dataset = a.eval_dataset"""


def logreg_loo_sql(buckets: int, steps: int, lr: float) -> str:
    """Each source's refit on the other sources' rows against the fit on all rows:
    difference of the mean log-losses on the language sets."""
    r = repr
    body = logreg_sql(buckets, steps, lr).rsplit("\nSELECT", 1)[0]
    parts = ["nd AS (SELECT dataset, (SELECT n FROM n) - count(*) AS n FROM ld WHERE dataset IS NOT NULL GROUP BY dataset)",
             "q0 AS (SELECT nd.dataset AS run_id, th.f, 0.0 AS theta FROM nd CROSS JOIN th0 th)"]
    for t in range(1, steps + 1):
        parts.append(f"""oz{t} AS (SELECT q.run_id, x.doc_id, sum(q.theta) AS z FROM x JOIN q{t - 1} q
            ON q.f = x.f AND x.dataset IS DISTINCT FROM q.run_id GROUP BY q.run_id, x.doc_id)""")
        parts.append(f"""oe{t} AS (SELECT run_id, doc_id, 1.0 / (1.0 + exp(-z)) - y AS e FROM oz{t} JOIN ld USING (doc_id))""")
        parts.append(f"""og{t} AS (SELECT oe.run_id, x.f, sum(oe.e) / nd.n AS g FROM x JOIN oe{t} oe USING (doc_id)
            JOIN nd ON nd.dataset = oe.run_id GROUP BY oe.run_id, x.f, nd.n)""")
        parts.append(f"""q{t} AS (SELECT q.run_id, q.f, q.theta - {r(lr)} * coalesce(g.g, 0.0) AS theta
            FROM q{t - 1} q LEFT JOIN og{t} g ON g.run_id = q.run_id AND g.f = q.f)""")
    parts.append(f"""allp AS (SELECT run_id, f, theta FROM q{steps}
        UNION ALL SELECT CAST(NULL AS VARCHAR), f, theta FROM th{steps})""")
    parts.append("""ls AS (SELECT run_id, lang, avg(greatest(z, 0.0) + ln(1 + exp(-abs(z))) - y * z) AS loss
        FROM (SELECT p.run_id, x.lang, x.doc_id, sum(p.theta) AS z FROM x JOIN allp p USING (f)
              GROUP BY p.run_id, x.lang, x.doc_id) JOIN (SELECT doc_id, y FROM ld) USING (doc_id)
        GROUP BY run_id, lang)""")
    return body + ",\n" + ",\n".join(parts) + """
SELECT a.run_id AS train_dataset, a.lang AS eval_dataset, round(a.loss - b.loss, 6) AS influence
FROM ls a JOIN ls b ON b.run_id IS NULL AND b.lang = a.lang WHERE a.run_id IS NOT NULL"""


def bigram_loo_sql(alpha: float = 1.0) -> str:
    a = repr(float(alpha))
    pairs = ("SELECT dataset, t[i] AS u, t[i + 1] AS v FROM (SELECT dataset, t, unnest(range(1, len(t))) AS i "
             f"FROM (SELECT dataset, {tok()} AS t FROM (ROWS_SQL)))")
    return f"""
WITH {counts_ctes(alpha)},
tp AS (SELECT dataset, u, v, count(*) AS cnt FROM ({pairs.replace('ROWS_SQL', TRAIN_ROWS)}) GROUP BY ALL),
ep AS (SELECT dataset AS eval_dataset, u, v, count(*) AS cnt FROM ({pairs.replace('ROWS_SQL', EVAL_ROWS)}) GROUP BY ALL),
cuv AS (SELECT u, v, sum(cnt) AS C FROM tp GROUP BY ALL),
cu AS (SELECT u, sum(cnt) AS C FROM tp GROUP BY u),
du AS (SELECT dataset, u, sum(cnt) AS cnt FROM tp GROUP BY ALL),
eu AS (SELECT eval_dataset, u, sum(cnt) AS cnt FROM ep GROUP BY ALL),
ds AS (SELECT DISTINCT dataset FROM tp),
en AS (SELECT eval_dataset, sum(cnt) AS n FROM ep GROUP BY ALL),
sa AS (SELECT du.dataset, eu.eval_dataset,
              sum(eu.cnt * (ln(cu.C - du.cnt + {a} * vs.V) - ln(cu.C + {a} * vs.V))) AS s
       FROM du JOIN eu USING (u) JOIN cu USING (u) CROSS JOIN vs GROUP BY ALL),
sb AS (SELECT tp.dataset, ep.eval_dataset,
              sum(ep.cnt * (ln(cuv.C - tp.cnt + {a}) - ln(cuv.C + {a}))) AS s
       FROM tp JOIN ep USING (u, v) JOIN cuv USING (u, v) GROUP BY ALL)
SELECT ds.dataset AS train_dataset, en.eval_dataset,
       round((coalesce(sa.s, 0) - coalesce(sb.s, 0)) / en.n, 6) AS influence
FROM ds CROSS JOIN en
LEFT JOIN sa ON sa.dataset = ds.dataset AND sa.eval_dataset = en.eval_dataset
LEFT JOIN sb ON sb.dataset = ds.dataset AND sb.eval_dataset = en.eval_dataset"""


def bigram_unlearn_sql(lr: float, steps: int, clip: float = 0.0, alpha: float = 1.0) -> str:
    """Bigram unlearning unrolled: every seen pair of a run's contexts is a row,
    and one value stands for the unseen pairs of a context."""
    base = bigram_loo_sql(alpha)
    a = repr(float(alpha))
    parts = [base[base.index("WITH ") + 5:base.index(",\nsa AS (")]]
    parts.append(f"""mbrows AS (SELECT source AS run_id, {tok()} AS t,
        (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) * {steps} // count(*) OVER (PARTITION BY source) AS b
        FROM documents)""")
    parts.append("""mb AS (SELECT run_id, b, u, v, count(*) AS cnt FROM (
        SELECT run_id, b, t[i] AS u, t[i + 1] AS v FROM (SELECT run_id, b, t, unnest(range(1, len(t))) AS i FROM mbrows)) GROUP BY ALL)""")
    parts.append("nb AS (SELECT run_id, b, sum(cnt) AS nb FROM mb GROUP BY ALL)")
    parts.append("q AS (SELECT run_id, b + 1 AS step, u, v, cnt / nb AS q FROM mb JOIN nb USING (run_id, b))")
    parts.append("qc AS (SELECT run_id, step, u, sum(q) AS qc FROM q GROUP BY ALL)")
    parts.append("rc AS (SELECT DISTINCT run_id, u FROM mb)")
    parts.append("seen AS (SELECT u, count(*) AS k FROM cuv GROUP BY u)")
    parts.append(f"p0 AS (SELECT run_id, u, v, ln(C + {a}) AS theta FROM rc JOIN cuv USING (u))")
    parts.append(f"n0 AS (SELECT run_id, u, V - k AS k, ln({a}) AS theta FROM rc JOIN seen USING (u) CROSS JOIN vs)")
    for t in range(steps + 1):
        if t:
            parts.append(f"""g{t} AS (SELECT p.run_id, p.u, p.v, p.theta,
                coalesce(qc.qc, 0) * exp(p.theta - z.z) - coalesce(q.q, 0) AS g
                FROM p{t - 1} p JOIN z{t - 1} z USING (run_id, u)
                LEFT JOIN qc ON qc.run_id = p.run_id AND qc.u = p.u AND qc.step = {t}
                LEFT JOIN q ON q.run_id = p.run_id AND q.u = p.u AND q.v = p.v AND q.step = {t})""")
            parts.append(f"""h{t} AS (SELECT n.run_id, n.u, n.k, n.theta, coalesce(qc.qc, 0) * exp(n.theta - z.z) AS g
                FROM n{t - 1} n JOIN z{t - 1} z USING (run_id, u)
                LEFT JOIN qc ON qc.run_id = n.run_id AND qc.u = n.u AND qc.step = {t})""")
            scale = f"least(1.0, {clip!r} / (sqrt(sum(x)) + 1e-06))" if clip > 0 else "1.0"
            parts.append(f"""s{t} AS (SELECT run_id, {scale} AS s FROM (SELECT run_id, g * g AS x FROM g{t}
                UNION ALL SELECT run_id, k * g * g FROM h{t}) GROUP BY run_id)""")
            parts.append(f"p{t} AS (SELECT g.run_id, g.u, g.v, g.theta + {lr!r} * g.g * s.s AS theta FROM g{t} g JOIN s{t} s USING (run_id))")
            parts.append(f"n{t} AS (SELECT h.run_id, h.u, h.k, h.theta + {lr!r} * h.g * s.s AS theta FROM h{t} h JOIN s{t} s USING (run_id))")
        parts.append(f"""z{t} AS (SELECT run_id, u, ln(sum(x)) AS z FROM (SELECT run_id, u, exp(theta) AS x FROM p{t}
            UNION ALL SELECT run_id, u, k * exp(theta) FROM n{t}) GROUP BY ALL)""")
        parts.append(f"""l{t} AS (SELECT n.run_id, ep.eval_dataset, {t} AS step,
            sum(ep.cnt * (z.z - coalesce(p.theta, n.theta)
                - (ln(cu.C + {a} * vs.V) - ln(coalesce(cuv.C, 0) + {a})))) AS s
            FROM ep JOIN n{t} n USING (u) JOIN z{t} z ON z.run_id = n.run_id AND z.u = ep.u JOIN cu ON cu.u = ep.u CROSS JOIN vs
            LEFT JOIN cuv ON cuv.u = ep.u AND cuv.v = ep.v
            LEFT JOIN p{t} p ON p.run_id = n.run_id AND p.u = ep.u AND p.v = ep.v GROUP BY ALL)""")
    every = " UNION ALL ".join(f"SELECT * FROM l{t}" for t in range(1, steps + 1))
    return "WITH " + ",\n".join(parts) + f"""
SELECT r.run_id AS train_dataset, en.eval_dataset, CAST(st.step AS BIGINT) AS step,
       round((coalesce(l.s, 0) - coalesce(b.s, 0)) / en.n, 6) + 0.0 AS influence
FROM (SELECT DISTINCT run_id FROM rc) r CROSS JOIN en CROSS JOIN (SELECT unnest(range(1, {steps + 1})) AS step) st
LEFT JOIN ({every}) l ON l.run_id = r.run_id AND l.eval_dataset = en.eval_dataset AND l.step = st.step
LEFT JOIN l0 b ON b.run_id = r.run_id AND b.eval_dataset = en.eval_dataset"""


def collate_pairs_sql(max_len: int, bs: int) -> str:
    """prediction = prompt, answer = the whole reply; both hashed, truncated
    and padded per batch (no labels)."""
    return f"""
WITH pr AS ({PAIRS}),
t AS (SELECT conv_id, turn, ({hashed_sql("prompt")})[1:{max_len}] AS preds,
             ({hashed_sql("coalesce(target, '')")})[1:{max_len}] AS answers,
             (row_number() OVER (ORDER BY conv_id, turn) - 1) // {bs} AS batch_id FROM pr),
m AS (SELECT *, max(len(preds)) OVER (PARTITION BY batch_id) AS Lp,
                max(len(answers)) OVER (PARTITION BY batch_id) AS La FROM t)
SELECT conv_id, turn, CAST(batch_id AS BIGINT) AS batch_id,
       array_to_string(list_resize(preds, Lp, 0), ',') AS preds,
       array_to_string(list_resize(answers, La, 0), ',') AS answers
FROM m"""


def path_log_sql(steps: int) -> str:
    return f"""
SELECT source AS run_id, CAST(step AS BIGINT) AS step, round(step / {float(steps)}, 6) AS epoch,
       'eval_loss' AS metric, round(avg(length(text)), 6) AS value
FROM (SELECT source, doc_id, text, unnest(range(1, {steps} + 1)) AS step FROM documents)
WHERE source IS NOT NULL AND doc_id IS NOT NULL AND doc_id % {steps} < step
GROUP BY source, step"""


METRICS_MERGE = """
WITH t AS (SELECT source AS run_id, CAST(count(*) AS DOUBLE) AS n, round(avg(length(text)), 6) AS s
           FROM documents WHERE source IS NOT NULL GROUP BY source),
e AS (SELECT source AS run_id, CAST(count(*) AS DOUBLE) AS n, round(avg(length(text)), 6) AS s
      FROM documents WHERE source IS NOT NULL AND doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source),
own AS (SELECT 'train' AS split, run_id, 'train_samples' AS metric, n AS value FROM t
        UNION ALL SELECT 'train', run_id, 'train_loss', s FROM t
        UNION ALL SELECT 'train', run_id, 'rows', n FROM t
        UNION ALL SELECT 'eval', run_id, 'eval_samples', n FROM e
        UNION ALL SELECT 'eval', run_id, 'eval_loss', s FROM e
        UNION ALL SELECT 'eval', run_id, 'rows', n FROM e)
SELECT * FROM own
UNION ALL
SELECT 'all', run_id, metric, value FROM own a
WHERE NOT (split = 'train' AND metric = 'rows' AND run_id IN (SELECT run_id FROM e))"""
