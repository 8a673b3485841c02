"""Independent DuckDB formulations of the registered queries.

Each string runs on DuckDB with the given tables registered as views.
The formulations are deliberately different from the Spark plans (plain
self equi-joins, lgamma sums, global windows, string aggregation) so the
comparison checks the Spark operators, not a transliteration.
"""

from __future__ import annotations

from typing import NamedTuple

DIGITS = 9

# ---- fixed values, written down here on their own: the attempts view, the study reports
MODELS = ["deepseekcoder-1b", "codellama-7b", "deepseekcoder-7b", "codellama-13b", "deepseekcoder-33b", "codellama-34b"]
THRESHOLDS = [
    ("16bit", 420), ("8bit", 418), ("4bit", 400), ("3bit", 340), ("2bit", 220), ("3bit-finetuned", 360), ("2bit-finetuned", 300),
    ("8bit-rnd", 418), ("8bit-mixed", 419), ("8bit-code", 420), ("4bit-rnd", 400), ("4bit-mixed", 405), ("4bit-code", 403),
    ("3bit-rnd", 340), ("3bit-mixed", 370), ("3bit-code", 372), ("2bit-rnd", 220), ("2bit-mixed", 290), ("2bit-code", 285),
    ("2bit-mixed-finetuned", 330)]
ATTEMPTS = 20


class Report(NamedTuple):
    """comparisons: (base, other, first argument, second argument, family tag)."""
    models: list
    comparisons: list
    family: list | None
    sort: list


SORT_7B = ("rank", "model", ["deepseekcoder-7b", "codellama-7b"])
RQ1 = Report(["codellama-7b", "deepseekcoder-7b"],
             [("16bit", "8bit", "8bit", "16bit", ""), ("16bit", "4bit", "4bit", "16bit", ""),
              ("16bit", "3bit", "3bit", "16bit", ""), ("16bit", "2bit", "2bit", "16bit", "")], ["model", "lng"],
             [SORT_7B, ("text", "lng"), ("text", "base_precision"), ("rank", "quant_precision", ["16bit", "8bit", "4bit", "3bit", "2bit"])])
RQ1_FINETUNED = Report(["codellama-7b", "deepseekcoder-7b"],
                       [("3bit", "3bit-finetuned", "3bit", "3bit-finetuned", ""), ("2bit", "2bit-finetuned", "2bit", "2bit-finetuned", "")],
                       None, [SORT_7B, ("text", "lng"), ("text", "base_precision"), ("rank", "quant_precision", ["3bit", "2bit"])])
RQ2 = Report(["codellama-7b", "deepseekcoder-7b"],
             [(f"{b}-{x}", f"{b}-{y}", f"{b}-{x}", f"{b}-{y}", b) for b in ("8bit", "4bit", "3bit", "2bit")
              for x, y in (("rnd", "mixed"), ("rnd", "code"), ("mixed", "code"))], ["model", "lng", "family_tag"],
             [SORT_7B, ("text", "lng"), ("rank", "base_precision", [f"{b}-{x}" for b in ("8bit", "4bit", "3bit", "2bit")
                                                                    for x in ("rnd", "mixed", "code")])])
RQ3 = Report(MODELS, [("16bit", "2bit-mixed", "2bit-mixed", "16bit", ""), ("16bit", "2bit-mixed-finetuned", "2bit-mixed-finetuned", "16bit", "")],
             ["model", "lng"],
             [("rank", "model", ["deepseekcoder-1_3b", "codellama-7b", "deepseekcoder-7b", "codellama-13b", "deepseekcoder-33b", "codellama-34b"]),
              ("text", "lng"), ("text", "base_precision"), ("rank", "quant_precision", ["16bit", "2bit-mixed", "2bit-mixed-finetuned"])])


def h48(x: str) -> str:
    return f"cast('0x' || substr(md5({x}), 1, 12) as bigint)"


def _vals(items) -> str:
    out = []
    for it in items:
        if not isinstance(it, tuple):
            it = (it,)
        out.append("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in it) + ")")
    return ", ".join(out)


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def attempts_cte() -> str:
    models = _vals(MODELS)
    langs = _vals(["py", "java"])
    cfgs = _vals(THRESHOLDS)
    key_h = "concat_ws('|', m.model, c.quantization, l.language, cast(b.item_id as varchar), cast(a.attempt as varchar))"
    key_b = "concat_ws('|', m.model, l.language, cast(b.item_id as varchar), cast(a.attempt as varchar))"
    return f"""attempts_raw AS (
  SELECT b.item_id, m.model, c.quantization, l.language, cast(a.attempt as integer) AS attempt, c.thr,
         {h48(key_h)} AS h, {h48(key_b)} AS hb
  FROM benchmark b, (VALUES {models}) m(model), (VALUES {langs}) l(language),
       (VALUES {cfgs}) c(quantization, thr), range(0, {ATTEMPTS}) a(attempt)
), attempts AS (
  SELECT model, quantization, language, 'P_' || cast(item_id as varchar) AS problem, attempt,
         CASE WHEN (hb % 800) + (h % 200) < thr THEN 'OK' WHEN h % 3 = 0 THEN 'Exception'
              WHEN h % 3 = 1 THEN 'Timeout' ELSE 'SyntaxError' END AS status,
         CASE WHEN (hb % 800) + (h % 200) < thr AND h % 50 <> 0 THEN 0 ELSE 1 END AS exit_code
  FROM attempts_raw
), attempts_pass AS (
  SELECT *, CASE WHEN status = 'OK' AND exit_code = 0 THEN 1 ELSE 0 END AS pass FROM attempts
)"""


def exact_p_sql(b: str, c: str) -> str:
    n = f"({b} + {c})"
    term = f"lambda i: exp(lgamma({n} + 1) - lgamma(i + 1) - lgamma({n} - i + 1) - {n} * ln(2))"
    return (f"CASE WHEN {n} = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum(list_transform("
            f"range(0, least({b}, {c}) + 1), {term}))) END")


def odds_sql(b: str, c: str) -> str:
    return f"CASE WHEN {c} = 0 THEN NULL ELSE cast({b} as double) / {c} END"


def _sort_sql(spec) -> str:
    keys = []
    for item in spec:
        if item[0] == "rank":
            keys.append(f"nullif(coalesce(list_position({_list(item[2])}, {item[1]}), 0), 0) ASC NULLS LAST")
        else:
            keys.append(f"{item[1]} ASC NULLS LAST")
    return ", ".join(keys)


def report_sql(spec: Report) -> str:
    cmps = _vals([(j, *c) for j, c in enumerate(spec.comparisons)])
    n_l, n_c = 2, len(spec.comparisons)
    fam = spec.family
    if fam is None:
        adj = "p_value AS p_adj"
        bh = "SELECT *, p_value AS p_adj FROM stats"
    else:
        part = ", ".join(fam)
        bh = f"""SELECT *, least(1.0, min(p_value * n_fam / rk) OVER (PARTITION BY {part} ORDER BY rk
                   ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj
            FROM (SELECT *, row_number() OVER (PARTITION BY {part} ORDER BY p_value, row_id) AS rk,
                         count(*) OVER (PARTITION BY {part}) AS n_fam FROM stats)"""
    return f"""WITH {attempts_cte()},
att AS (SELECT * FROM attempts_pass WHERE model IN ({_vals(spec.models)}) AND language IN ({_vals(['py', 'java'])})),
cmp(cmp_idx, base, other, first_cfg, second_cfg, family_tag) AS (VALUES {cmps}),
pairs AS (
  SELECT f.model, f.language, cmp.cmp_idx, cmp.base, cmp.other, cmp.family_tag, f.pass AS fp, s.pass AS sp
  FROM cmp JOIN att f ON f.quantization = cmp.first_cfg
           JOIN att s ON s.quantization = cmp.second_cfg AND s.model = f.model AND s.language = f.language
                     AND s.problem = f.problem AND s.attempt = f.attempt),
cont AS (
  SELECT model, language AS lng, cmp_idx, base AS base_precision, other AS quant_precision, family_tag,
         count(*) AS n_pairs, cast(sum(CASE WHEN fp = 0 AND sp = 1 THEN 1 ELSE 0 END) as bigint) AS b,
         cast(sum(CASE WHEN fp = 1 AND sp = 0 THEN 1 ELSE 0 END) as bigint) AS c
  FROM pairs GROUP BY ALL),
stats AS (
  SELECT *, cast((list_position({_list(spec.models)}, model) - 1) * {n_l * n_c}
               + (list_position({_list(['py', 'java'])}, lng) - 1) * {n_c} + cmp_idx + 1 as integer) AS row_id,
         {exact_p_sql('b', 'c')} AS p_value, {odds_sql('b', 'c')} AS odds_ratio, (c = 0 AND b > 0) AS or_infinite
  FROM cont),
adj AS ({bh})
SELECT row_id, base_precision, quant_precision, lng, model, cast(n_pairs as bigint) AS n_pairs,
       cast(b as bigint) AS b, cast(c as bigint) AS c, round(p_value, {DIGITS}) AS p_value,
       round(p_adj, {DIGITS}) AS p_adj, round(odds_ratio, {DIGITS}) AS odds_ratio, or_infinite,
       cast(row_number() OVER (ORDER BY {_sort_sql(spec.sort)}, row_id) as integer) AS report_pos
FROM adj"""


def oracle_queries() -> dict[str, str]:
    return {
        "report_rq1": report_sql(RQ1),
        "report_rq1_finetuned": report_sql(RQ1_FINETUNED),
        "report_rq2": report_sql(RQ2),
        "report_rq3": report_sql(RQ3),
        **stats_queries(),
        **corpus_queries(),
        **stream_queries(),
        **completion_queries(),
        **job_queries(),
        **stream_queries_sql(),
    }


CONFIG = "model, quantization, language"


def _stats_cols(b="b", c="c") -> str:
    return (f"round({exact_p_sql(b, c)}, {DIGITS}) AS p_value, round({odds_sql(b, c)}, {DIGITS}) AS odds_ratio, "
            f"({c} = 0 AND {b} > 0) AS or_infinite")


def contingency_sql() -> str:
    others = [q for q, _ in THRESHOLDS if q != "16bit"]
    cmps = _vals([(q,) for q in others])
    return f"""WITH {attempts_cte()},
cmp(other) AS (VALUES {cmps})
SELECT f.model, f.language, '16bit' AS base_precision, cmp.other AS quant_precision, count(*) AS n_pairs,
  cast(sum(CASE WHEN f.pass = 0 AND s.pass = 0 THEN 1 ELSE 0 END) as bigint) AS a,
  cast(sum(CASE WHEN f.pass = 0 AND s.pass = 1 THEN 1 ELSE 0 END) as bigint) AS b,
  cast(sum(CASE WHEN f.pass = 1 AND s.pass = 0 THEN 1 ELSE 0 END) as bigint) AS c,
  cast(sum(CASE WHEN f.pass = 1 AND s.pass = 1 THEN 1 ELSE 0 END) as bigint) AS d
FROM cmp JOIN attempts_pass f ON f.quantization = cmp.other
JOIN attempts_pass s ON s.quantization = '16bit' AND s.model = f.model AND s.language = f.language
  AND s.problem = f.problem AND s.attempt = f.attempt
GROUP BY f.model, f.language, cmp.other"""


def pass_at_k_sql(k: int) -> str:
    est = (f"CASE WHEN n - c < {k} THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1.0 - list_aggregate("
           f"list_transform(range(n - c + 1, n + 1), lambda i: 1.0 - {k}.0 / i), 'product') END")
    return f"""WITH {attempts_cte()},
pp AS (SELECT {CONFIG}, problem, cast(count(*) as bigint) AS n, cast(sum(pass) as bigint) AS c
       FROM attempts_pass GROUP BY ALL)
SELECT {CONFIG}, count(*) AS num_problems, cast(min(n) as integer) AS min_completions,
       cast(max(n) as integer) AS max_completions, {k} AS k, round(avg({est}), {DIGITS}) AS pass_at_k
FROM pp GROUP BY ALL HAVING min(n) >= {k}"""


def pass_rate_sql() -> str:
    return f"""WITH {attempts_cte()}
SELECT {CONFIG}, count(*) AS n_attempts, cast(sum(pass) as bigint) AS n_pass,
       round(avg(pass), {DIGITS}) AS pass_rate
FROM attempts_pass GROUP BY ALL"""


def bh_problems_sql(base="16bit", other="2bit") -> str:
    return f"""WITH {attempts_cte()},
t AS (
  SELECT f.model, f.language, f.problem, count(*) AS n_pairs,
    cast(sum(CASE WHEN f.pass = 0 AND s.pass = 1 THEN 1 ELSE 0 END) as bigint) AS b,
    cast(sum(CASE WHEN f.pass = 1 AND s.pass = 0 THEN 1 ELSE 0 END) as bigint) AS c
  FROM attempts_pass f JOIN attempts_pass s ON f.quantization = '{other}' AND s.quantization = '{base}'
   AND s.model = f.model AND s.language = f.language AND s.problem = f.problem AND s.attempt = f.attempt
  GROUP BY ALL),
p AS (SELECT *, {exact_p_sql('b', 'c')} AS p_raw FROM t),
r AS (SELECT *, row_number() OVER (PARTITION BY model, language ORDER BY p_raw, problem) AS rk,
             count(*) OVER (PARTITION BY model, language) AS n_fam FROM p)
SELECT model, language, problem, n_pairs, b, c, {_stats_cols()},
  round(least(1.0, min(p_raw * n_fam / rk) OVER (PARTITION BY model, language ORDER BY rk
        ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), {DIGITS}) AS p_adj
FROM r"""


def outcome_flag_sql() -> str:
    return f"WITH {attempts_cte()} SELECT {CONFIG}, problem, attempt, status, exit_code, pass FROM attempts_pass"


def path_dimensions_sql() -> str:
    return f"""WITH {attempts_cte()},
f AS (SELECT DISTINCT {CONFIG}, problem FROM attempts),
p AS (SELECT CASE WHEN cast(regexp_extract(problem, '(\\d+)$', 1) as bigint) % 3 = 0 THEN 'converted-' ELSE '' END
             || model || '-' || quantization || '/' || language || '_benchmark_temperature_0.2_x/' || problem
             || '.results.json.gz' AS rel_path FROM f)
SELECT rel_path,
  replace(split_part(split_part(rel_path, '/', 1), 'b-', 1) || 'b', 'converted-', '') AS model,
  split_part(split_part(rel_path, '/', 1), 'b-', 2) AS quantization,
  split_part(split_part(rel_path, '/', 2), '_', 1) AS language
FROM p"""


def run_labels_sql() -> str:
    return f"""WITH {attempts_cte()},
f AS (SELECT DISTINCT {CONFIG}, problem,
        CASE WHEN starts_with(model, 'codellama') THEN 'org/' || model ELSE model END AS hub_name FROM attempts),
g AS (SELECT *, CASE WHEN strpos(hub_name, '/') = 0 THEN hub_name ELSE split_part(hub_name, '/', 2) END AS label,
             translate(hub_name, '/-', '__') AS safe_name FROM f),
h AS (SELECT *, language || '_benchmark_temperature_0.2_' || label AS run_dir FROM g),
i AS (SELECT *, 'out/' || safe_name || '/' || run_dir || '/' || problem || '.json.gz' AS completion_path FROM h)
SELECT model, quantization, language, problem, hub_name, label, safe_name, run_dir, completion_path,
  'out/' || safe_name || '/' || run_dir || '_cleaned/' || problem || '.json.gz' AS cleaned_path,
  'pass_result_temp_0_2_' || language || '_' || label || '.csv' AS pass_report
FROM i"""


CUSTOM_SORT_SPEC = [("rank", "model", ["deepseekcoder-1_3b", "codellama-7b", "deepseekcoder-7b",
                                       "codellama-13b", "deepseekcoder-33b", "codellama-34b"]),
                    ("text", "language"),
                    ("rank", "quantization", [q for q, _ in THRESHOLDS])]


def custom_sort_sql() -> str:
    return f"""WITH {attempts_cte()},
pr AS (SELECT {CONFIG}, count(*) AS n_attempts, cast(sum(pass) as bigint) AS n_pass,
       round(avg(pass), {DIGITS}) AS pass_rate FROM attempts_pass GROUP BY ALL)
SELECT *, cast(row_number() OVER (ORDER BY {_sort_sql(CUSTOM_SORT_SPEC)}, model) as integer) AS report_pos FROM pr"""


def experiment_grid_sql() -> str:
    cmps = _vals([c[:2] for c in RQ2.comparisons])
    return f"""WITH {attempts_cte()},
cells AS (SELECT DISTINCT model, language FROM attempts),
n AS (SELECT model, language, quantization, count(*) AS n FROM attempts GROUP BY ALL),
cmp(base_precision, quant_precision) AS (VALUES {cmps})
SELECT c.model, c.language, base_precision, quant_precision, coalesce(b.n, 0) AS n_base, coalesce(q.n, 0) AS n_quant,
       coalesce(b.n, 0) > 0 AND coalesce(q.n, 0) > 0 AS testable
FROM cells c CROSS JOIN cmp
LEFT JOIN n b ON b.model = c.model AND b.language = c.language AND b.quantization = base_precision
LEFT JOIN n q ON q.model = c.model AND q.language = c.language AND q.quantization = quant_precision"""


def label_families_sql() -> str:
    return f"""WITH {attempts_cte()}
SELECT left(quantization, 4) AS family, quantization AS label, model, language, count(*) AS n_attempts, cast(sum(pass) as bigint) AS n_pass
FROM attempts_pass WHERE regexp_matches(quantization, '^[23]bit') GROUP BY ALL"""


def completion_cap_sql(n=10) -> str:
    return f"WITH {attempts_cte()} SELECT * FROM attempts_pass WHERE attempt < {n}"


def paired_labels_sql() -> str:
    return f"""WITH t AS (
  SELECT d.lang, count(*) AS n_pairs,
    cast(sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) as bigint) AS a,
    cast(sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) as bigint) AS b,
    cast(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) as bigint) AS c,
    cast(sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) as bigint) AS d
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang),
p AS (SELECT *, {exact_p_sql('b', 'c')} AS p_raw FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY p_raw, lang) AS rk, count(*) OVER () AS n_fam FROM p)
SELECT lang, n_pairs, a, b, c, d, {_stats_cols()},
  round(least(1.0, min(p_raw * n_fam / rk) OVER (ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), {DIGITS}) AS p_adj
FROM r"""


def stats_queries() -> dict[str, str]:
    return {
        "contingency": contingency_sql(),
        "pass_at_1": pass_at_k_sql(1),
        "pass_at_10": pass_at_k_sql(10),
        "pass_rate": pass_rate_sql(),
        "bh_adjust": bh_problems_sql(),
        "outcome_flag": outcome_flag_sql(),
        "path_dimensions": path_dimensions_sql(),
        "run_labels": run_labels_sql(),
        "custom_sort": custom_sort_sql(),
        "experiment_grid": experiment_grid_sql(),
        "label_families": label_families_sql(),
        "completion_cap": completion_cap_sql(),
        "paired_labels": paired_labels_sql(),
    }


# ---------------------------------------------------------------- corpus views
CODE_CORPUS = r"""code AS (
  SELECT doc_id AS pos, text,
    CASE WHEN doc_id % 13 = 0 THEN 'not a dict' ELSE
      '{''source'': ''' || CASE WHEN doc_id % 11 = 0 THEN 'wiki' ELSE 'github' END
      || ''', ''repo_name'': ''repo' || cast((doc_id * 7) % 61 as varchar) || ''''
      || CASE doc_id % 5 WHEN 0 THEN ', ''path'': ''src/A' || cast(doc_id as varchar) || '.java'''
                         WHEN 1 THEN ', ''path'': ''lib/m' || cast(doc_id as varchar) || '.py'''
                         WHEN 2 THEN ', ''path'': ''x' || cast(doc_id as varchar) || '.js'''
                         WHEN 3 THEN ''
                         ELSE CASE WHEN doc_id % 25 = 4 THEN ', ''path'': ''py''' ELSE ', ''path'': ''T.JAVA''' END END
      || '}' END AS meta
  FROM documents)"""

QA_CORPUS = r"""qa AS (
  SELECT doc_id AS pos,
    text || CASE WHEN doc_id % 3 = 0 THEN ' python' WHEN doc_id % 7 = 0 THEN ' JavaScript' ELSE '' END AS text,
    '{''source'': ''' || CASE WHEN doc_id % 17 = 0 THEN 'wiki' ELSE 'stackexchange' END
    || ''', ''language'': ''' || lang || ''', ''url'': ''https://'
    || CASE WHEN doc_id % 4 = 0 THEN 'math.example' ELSE 'stackoverflow.com' END
    || '/questions/' || cast(doc_id as varchar) || ''''
    || CASE WHEN doc_id % 9 = 0 THEN '' ELSE ', ''question_score'': ''' || cast((doc_id * 37) % 41 as varchar) || '''' END
    || '}' AS meta
  FROM documents)"""

NTOK = r"cast(len(regexp_extract_all({t}, '\S+')) as integer)"
TOKS = r"regexp_extract_all({t}, '\s*\S+')"


def ntok(t="text"):
    return NTOK.format(t=t)


def toks(t="text"):
    return TOKS.format(t=t)


CODE_ELIGIBLE = r"""codep AS (SELECT pos, text, meta, replace(meta, '''', '"') AS js FROM code),
code_e0 AS (
  SELECT pos, text, json_extract_string(js, '$.source') AS source, json_extract_string(js, '$.path') AS path,
         json_extract_string(js, '$.repo_name') AS repo, json_exists(js, '$.path') AS has_path
  FROM codep WHERE json_valid(js)),
code_e AS (
  SELECT row_number() OVER (ORDER BY pos) AS i, pos, repo,
         CASE WHEN ends_with(path, '.java') THEN 'java' ELSE 'python' END AS language
  FROM code_e0
  WHERE source = 'github' AND has_path AND repo IS NOT NULL AND string_split(path, '.')[-1] IN ('java', 'py')
    AND """ + NTOK.format(t="text") + """ > {seqlen})"""


def greedy_quota_cte(seqlen: int, quota: int) -> str:
    """The reference's greedy loop, one row per recursion step."""
    acc = (f"(NOT list_contains(g.seen, e.repo) AND CASE WHEN e.language = 'java' "
           f"THEN g.nj < {quota} ELSE g.np < {quota} END)")
    return CODE_ELIGIBLE.format(seqlen=seqlen) + f""",
greedy(i, pos, acc, seen, nj, np) AS (
  SELECT 0, CAST(NULL AS BIGINT), false, CAST([] AS VARCHAR[]), 0, 0
  UNION ALL
  SELECT e.i, e.pos, {acc}, CASE WHEN {acc} THEN list_append(g.seen, e.repo) ELSE g.seen END,
         g.nj + CASE WHEN {acc} AND e.language = 'java' THEN 1 ELSE 0 END,
         g.np + CASE WHEN {acc} AND e.language = 'python' THEN 1 ELSE 0 END
  FROM greedy g JOIN code_e e ON e.i = g.i + 1),
chosen AS (SELECT e.pos, e.repo, e.language FROM greedy g JOIN code_e e ON e.i = g.i WHERE g.acc)"""


def heads_select(src: str, chosen: str, seqlen: int, extra: str = "") -> str:
    return f"""SELECT row_number() OVER (ORDER BY c.pos) - 1 AS sample_id, c.pos AS doc_pos, 0 AS start,
       cast(len(list_slice({toks('s.text')}, 1, {seqlen})) as integer) AS num_tokens,
       array_to_string(list_slice({toks('s.text')}, 1, {seqlen}), '') AS raw_data, s.meta{extra}
FROM {chosen} c JOIN {src} s ON s.pos = c.pos"""


def quota_sample_sql(seqlen=64, quota=20) -> str:
    return (f"WITH RECURSIVE {CODE_CORPUS},\n{greedy_quota_cte(seqlen, quota)}\n"
            + heads_select("code", "chosen", seqlen, ", c.language, c.repo"))


def stratum_counts_sql(seqlen=64, quota=20) -> str:
    return (f"WITH RECURSIVE {CODE_CORPUS},\n{greedy_quota_cte(seqlen, quota)}\n"
            "SELECT language, count(*) AS n FROM chosen GROUP BY language")


def shortage_sql(seqlen=64, quota=40) -> str:
    return (f"WITH RECURSIVE {CODE_CORPUS},\n{greedy_quota_cte(seqlen, quota)},\n"
            "req(language) AS (VALUES ('java'), ('python')),\n"
            "got AS (SELECT language, count(*) AS n FROM chosen GROUP BY language)\n"
            f"SELECT r.language, {quota} AS requested, coalesce(g.n, 0) AS obtained, "
            f"{quota} - coalesce(g.n, 0) AS missing FROM req r LEFT JOIN got g USING (language)")


QA_FILTERED = r"""qap AS (SELECT pos, text, meta, replace(meta, '''', '"') AS js FROM qa WHERE contains(meta, 'stackoverflow')),
qa_f AS (
  SELECT pos, text, meta FROM qap
  WHERE json_valid(js) AND json_extract_string(js, '$.source') = 'stackexchange'
    AND json_extract_string(js, '$.language') = 'en'
    AND try_cast(json_extract_string(js, '$.question_score') as integer) >= 10
    AND (contains(text, 'Python') OR contains(text, 'Java') OR contains(text, 'python') OR contains(text, 'java')))"""


def qa_head_sql(k=20, seqlen=64) -> str:
    return (f"WITH {QA_CORPUS},\n{QA_FILTERED},\n"
            f"top AS (SELECT pos FROM qa_f WHERE {ntok()} > {seqlen} ORDER BY pos LIMIT {k})\n"
            + heads_select("qa", "top", seqlen))


def mixed_sample_sql(nsamples=40, seqlen=64) -> str:
    n_qa = nsamples // 2
    return (f"WITH RECURSIVE {CODE_CORPUS},\n{QA_CORPUS},\n{QA_FILTERED},\n"
            f"{greedy_quota_cte(seqlen, nsamples // 4)},\n"
            f"top AS (SELECT pos FROM qa_f WHERE {ntok()} > {seqlen} ORDER BY pos LIMIT {n_qa}),\n"
            f"a AS ({heads_select('qa', 'top', seqlen)}),\n"
            f"b AS ({heads_select('code', 'chosen', seqlen)})\n"
            f"SELECT *, 'qa' AS part FROM a UNION ALL "
            f"SELECT sample_id + {n_qa} AS sample_id, doc_pos, start, num_tokens, raw_data, meta, 'code' AS part FROM b")


def meta_parse_sql() -> str:
    return f"""WITH {CODE_CORPUS},
p0 AS (SELECT pos, replace(meta, '''', '"') AS js FROM code),
p AS (SELECT pos, CASE WHEN json_valid(js) THEN js END AS jv FROM p0)
SELECT pos, jv IS NOT NULL AS meta_valid, json_extract_string(jv, '$.source') AS source,
  json_extract_string(jv, '$.repo_name') AS repo_name, json_extract_string(jv, '$.path') AS path,
  coalesce(json_exists(jv, '$.path'), false) AS has_path
FROM p"""


def meta_filters_sql() -> str:
    return f"""WITH {CODE_CORPUS}, {CODE_ELIGIBLE.format(seqlen=-1)}
SELECT pos, repo, language FROM code_e"""


def qa_filters_sql() -> str:
    return f"""WITH {QA_CORPUS}, {QA_FILTERED}
SELECT pos, {ntok()} AS n_tokens FROM qa_f"""


def token_counts_sql() -> str:
    return rf"""SELECT doc_id, {ntok()} AS n_tokens,
  array_to_string({toks()}, '') = regexp_replace(text, '\s+$', '') AS lossless
FROM documents"""


def length_gate_sql(seqlen=512, strict=True) -> str:
    op = ">" if strict else ">="
    return f"SELECT doc_id, {ntok()} AS n_tokens FROM documents WHERE {ntok()} {op} {seqlen}"


def head_tokens_sql(seqlen=64) -> str:
    return f"""SELECT doc_id, array_to_string(list_slice({toks()}, 1, {seqlen}), '') AS raw_data,
  cast(len(list_slice({toks()}, 1, {seqlen})) as integer) AS num_tokens
FROM documents WHERE {ntok()} > {seqlen}"""


def random_windows_sql(nsamples=40, seqlen=64, seed=0, strict=True, pos="doc_id") -> str:
    """Ranks over all eligible documents by a plain window."""
    op = ">" if strict else ">="
    start = f"{h48(f'concat_ws(chr(124), {seed}, k, ' + chr(39) + 'off' + chr(39) + ')')} % (n_tokens - {seqlen})"
    if not strict:
        start = f"CASE WHEN n_tokens = {seqlen} THEN 0 ELSE {start} END"
    return f"""WITH d AS (SELECT {pos} AS pos, {ntok()} AS n_tokens, text, source FROM documents),
e AS (SELECT *, row_number() OVER (ORDER BY pos) - 1 AS r, count(*) OVER () AS total FROM d WHERE n_tokens {op} {seqlen}),
w AS (SELECT k, pos, {start} AS st, text, source FROM range(0, {nsamples}) a(k)
      JOIN e ON e.r = {h48(f"concat_ws(chr(124), {seed}, k, 'doc')")} % total)
SELECT k AS sample_id, pos AS doc_pos, cast(st as integer) AS start,
       cast(len(list_slice({toks()}, st + 1, st + {seqlen})) as integer) AS num_tokens,
       array_to_string(list_slice({toks()}, st + 1, st + {seqlen}), '') AS raw_data, source AS meta FROM w"""


def validation_windows_sql(seqlen=64, n=256, seed=0) -> str:
    base = random_windows_sql(n, seqlen, seed, strict=False)
    return f"SELECT *, sample_id * {seqlen} AS offset FROM ({base})"


def train_val_sql(seqlen=64, quota=20, val_size=8, seed=0) -> str:
    key = h48(f"concat_ws(chr(124), {seed}, sample_id)")
    return (f"WITH RECURSIVE {CODE_CORPUS},\n{greedy_quota_cte(seqlen, quota)},\n"
            f"s AS ({heads_select('code', 'chosen', seqlen, ', c.language, c.repo')}),\n"
            f"v AS (SELECT sample_id FROM s ORDER BY {key}, sample_id LIMIT {val_size})\n"
            "SELECT s.*, CASE WHEN v.sample_id IS NULL THEN 'train' ELSE 'val' END AS split "
            "FROM s LEFT JOIN v USING (sample_id)")


def split_totals_sql() -> str:
    return (f"SELECT split, count(*) AS n_sequences, cast(sum(num_tokens) as bigint) AS total_tokens "
            f"FROM ({train_val_sql()}) GROUP BY split")


def pretokenized_head_sql(n=100) -> str:
    return f"""SELECT doc_id, cast(len(regexp_extract_all(text, '\\S+')) + doc_id % 4 + 1 as integer) AS n_ids
FROM documents ORDER BY doc_id LIMIT {n}"""


def corpus_queries() -> dict[str, str]:
    return {
        "meta_parse": meta_parse_sql(),
        "meta_filters": meta_filters_sql(),
        "qa_filters": qa_filters_sql(),
        "token_counts": token_counts_sql(),
        "length_gate": length_gate_sql(512, True),
        "length_gate_inclusive": length_gate_sql(512, False),
        "head_tokens": head_tokens_sql(),
        "random_windows": random_windows_sql(40, 64, 0, True),
        "random_windows_c4": random_windows_sql(40, 64, 1, False),
        "random_windows_sparse": random_windows_sql(40, 64, 2, True, "doc_id * 5003 + doc_id % 7"),
        "ordinals_sparse": "SELECT doc_id * 37 % 1000003 AS pos, row_number() OVER (ORDER BY doc_id * 37 % 1000003) - 1 AS ord FROM documents",
        "validation_windows": validation_windows_sql(),
        "quota_sample": quota_sample_sql(),
        "qa_head": qa_head_sql(),
        "mixed_sample": mixed_sample_sql(),
        "stratum_counts": stratum_counts_sql(),
        "shortage": shortage_sql(),
        "train_val_split": train_val_sql(),
        "split_token_totals": split_totals_sql(),
        "pretokenized_head": pretokenized_head_sql(),
    }


# ---------------------------------------------------------------- stream recipes
def _stream_cte(sep_sql: str, src: str = "documents", ndocs: int | None = None) -> str:
    head = f"(SELECT * FROM {src} ORDER BY doc_id LIMIT {ndocs})" if ndocs else src
    return f"""st AS (SELECT {toks(f"string_agg(text, {sep_sql} ORDER BY doc_id)")} AS t FROM {head} d)"""


NL2 = "chr(10) || chr(10)"


def stream_offsets_sql() -> str:
    return f"""SELECT doc_id AS pos, {ntok()} AS n_tokens,
  cast(coalesce(sum({ntok()}) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) as bigint) AS offset
FROM documents"""


def stream_windows_sql(nsamples=40, seqlen=64, seed=0) -> str:
    s = f"{h48(f'concat_ws(chr(124), {seed}, k, ' + chr(39) + 'off' + chr(39) + ')')} % (len(t) - {seqlen})"
    return f"""WITH {_stream_cte(NL2)},
w AS (SELECT k AS sample_id, {s} AS start, t FROM range(0, {nsamples}) r(k), st)
SELECT sample_id, start, {seqlen} AS num_tokens,
       array_to_string(list_slice(t, start + 1, start + {seqlen}), '') AS raw_data FROM w"""


def stream_chunks_sql(seqlen=64) -> str:
    return f"""WITH {_stream_cte(NL2)},
u AS (SELECT unnest(t) AS tok, generate_subscripts(t, 1) AS i FROM st)
SELECT (i - 1) // {seqlen} AS chunk_id, cast(count(*) as integer) AS num_tokens,
       string_agg(tok, '' ORDER BY i) AS raw_data
FROM u GROUP BY ALL"""


def token_budget_sql(seqlen=64, ndocs=1100, n_chunks=256) -> str:
    budget = n_chunks * seqlen
    return f"""WITH {_stream_cte("' '", ndocs=ndocs)},
b AS (SELECT list_slice(t, 1, {budget}) AS t FROM st),
c AS (SELECT unnest(range(0, (len(t) + {seqlen} - 1) // {seqlen})) AS chunk_id, t FROM b)
SELECT chunk_id, cast(len(list_slice(t, chunk_id * {seqlen} + 1, chunk_id * {seqlen} + {seqlen})) as integer) AS num_tokens,
       array_to_string(list_slice(t, chunk_id * {seqlen} + 1, chunk_id * {seqlen} + {seqlen}), '') AS raw_data
FROM c"""


def stream_queries() -> dict[str, str]:
    return {
        "stream_offsets": stream_offsets_sql(),
        "stream_windows": stream_windows_sql(),
        "stream_chunks": stream_chunks_sql(),
        "token_budget": token_budget_sql(),
    }


# ---------------------------------------------------------------- completions
REPLY = """reply AS (
  SELECT a.conv_id, a.turn, u.text AS prompt, a.text AS completion
  FROM conversations a JOIN conversations u ON u.conv_id = a.conv_id AND u.turn = a.turn - 1
  WHERE a.role = 'assistant' AND u.role = 'user')"""

def _pieces(x: str) -> str:
    """SQL for a text with $I$, $A$, $T$ and $L$ for the item, the attempt, its text and its first line."""
    columns = {"I": "i", "A": "a", "T": "t", "L": "l"}
    parts = []
    for n, t in enumerate(x.split("$")):
        parts.append(columns[t] if n % 2 else "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'")
    return " || ".join(parts)


def _by_kind(texts) -> str:
    return f"CASE kind WHEN 0 THEN {texts[0]} WHEN 1 THEN {texts[1]} ELSE {texts[2]} END"


def _code(language: str) -> str:
    """Completions with what is right for each by construction: cleaned, stripped, doc."""
    texts = ("SELECT item_id, cast(a.attempt as integer) AS attempt, cast(item_id as varchar) AS i, cast(a.attempt as varchar) AS a, "
             "translate(text, '\"''\\', '') AS t, split_part(translate(text, '\"''\\', ''), chr(10), 1) AS l, "
             f"item_id % 4 = 3 AS bare, (item_id + a.attempt) % 3 AS kind, '{language}' AS language FROM benchmark, range(0, 3) a(attempt)")
    if language == "py":
        head = 'def f$I$(\n    x,  # $L$)\n):\n    """$T$\n    """\n'
        body = '    y = """$T$\ndef no():\n"""  # "not the end\n    z = [\n$A$\n]\n# a note at the margin\n    return y, z'
        tails = ["\n", "\n\ndef extra():\n    pass\n", '\n# after\nprint("""\ndef no(): pass\n""")\n']
        bare, bare_body = "x = $I$  # $L$\n", "y = x\n# def no():"
        bare_clean = [bare_body + tails[0], bare_body + "\n\ndef extra():\n    pass", bare_body + tails[2]]
        doc_lines = "repeat(chr(10), length(t) - length(replace(t, chr(10), '')) + 1)"
        plain = [tails[0], tails[1], '\n\nprint("""\ndef no(): pass\n""")\n']
        rest = '\n    y = """$T$\ndef no():\n"""  \n    z = [\n$A$\n]\n\n    return y, z'
        front = _pieces("def f$I$(\n    x,  \n):\n    ")
        stripped = ["CASE WHEN bare THEN " + _pieces("x = $I$  \ny = x\n" + x) + f" ELSE {front} || {doc_lines} || " + _pieces(rest + x) + " END"
                    for x in plain]
    else:
        head = ('class P$I$ {\n    // $L$ {\n    static final String A = "} {";\n    P$I$() { this(1); }\n'
                "    public static <T> String f(\n        int x, char c\n    ) throws Exception {\n")
        body = ('        /* } $T$ */\n        String s = "}" + \'}\';\n        if (x > $A$) { return s; }\n'
                '        return "";\n    }')
        tails = ["\n}\n", "\n\n    static int g() { return 1; }\n}\n", "\n    // more }\n}\n"]
        bare, bare_body = "class P$I$ {\n    int v = $I$;\n", "    int w = $A$;"
        # the second function is the first one where the prompt has none
        bare_clean = [bare_body + tails[0], bare_body + "\n\n    static int g() { return 1; }", bare_body + tails[2]]
        stripped = ["''"] * 3
    bare_doc, doc = _pieces("# x = $I$  # $L$\n"), _pieces("# def f$I$(\n    ")
    return f"""cc_{language} AS (
  SELECT item_id, attempt, language, CASE WHEN bare THEN {_pieces(bare)} ELSE {_pieces(head)} END AS prompt,
    CASE WHEN bare THEN {_pieces(bare_body)} ELSE {_pieces(body)} END || {_by_kind([_pieces(x) for x in tails])} AS completion,
    CASE WHEN bare THEN {_by_kind([_pieces(x) for x in bare_clean])} ELSE {_pieces(body)} END AS cleaned,
    {_by_kind(stripped)} AS stripped,
    CASE WHEN attempt > 0 THEN '' WHEN bare THEN {bare_doc} ELSE {doc} END AS doc
  FROM ({texts}))"""


CODE_COMPLETIONS = _code("py")

TOKEN_ROWS = r"""tr AS (
  SELECT doc_id, list_concat(list_transform(range(doc_id % 4), lambda x: 0), [1],
         list_transform(regexp_extract_all(text, '\S+'), lambda w: cast(length(w) as integer))) AS ids
  FROM documents)"""

STRIP = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip_prompt_sql() -> str:
    return f"WITH {REPLY} SELECT conv_id, turn, {STRIP.format(x='prompt')} AS prompt_stripped FROM reply"


def prompt_removal_sql() -> str:
    p = STRIP.format(x="prompt")
    return (f"WITH {REPLY}, r AS (SELECT conv_id, turn, {p} AS p, completion FROM reply) "
            f"SELECT conv_id, turn, substring(p || completion, length(p) + 1) AS generated FROM r")


def stop_truncate_sql() -> str:
    stops = ["chr(46) || chr(10)", "', '"]
    hits = ", ".join(f"instr(completion, {s})" for s in stops)
    return f"""WITH {REPLY},
h AS (SELECT conv_id, turn, completion, list_min(list_filter([{hits}], lambda i: i > 0)) AS first FROM reply)
SELECT conv_id, turn, CASE WHEN first IS NULL THEN completion ELSE substring(completion, 1, first - 1) END AS truncated
FROM h"""


def left_pad_sql(batch=8) -> str:
    return f"""WITH {TOKEN_ROWS},
b AS (SELECT *, cast(max(len(ids)) OVER (PARTITION BY doc_id // {batch}) as integer) AS width FROM tr)
SELECT doc_id, width, array_to_string(list_concat(list_transform(range(width - len(ids)), lambda x: 0), ids), ',') AS padded
FROM b"""


def trim_ids_sql(max_length=1024) -> str:
    return f"""WITH {TOKEN_ROWS},
a AS (SELECT doc_id, ids, coalesce(list_position(list_transform(ids, lambda x: x NOT IN (0, 1)), true), 0) AS f FROM tr),
b AS (SELECT doc_id, ids, CASE WHEN f = 0 THEN []::INTEGER[] ELSE list_slice(ids, f, len(ids)) END AS rest FROM a),
c AS (SELECT *, coalesce(list_position(list_transform(rest, lambda x: x IN (0, 1, 2)), true), 0) AS s FROM b)
SELECT doc_id, cast(len(list_slice(ids, 1, {max_length - 1})) as integer) AS n_truncated,
       array_to_string(CASE WHEN s = 0 THEN rest ELSE list_slice(rest, 1, s - 1) END, ',') AS kept
FROM c"""


def cut_python_sql() -> str:
    return f"WITH {CODE_COMPLETIONS} SELECT item_id, attempt, cleaned FROM cc_py"


def cut_both_sql() -> str:
    return (f"WITH {CODE_COMPLETIONS}, {_code('java')} SELECT item_id, attempt, language, cleaned FROM cc_py "
            "UNION ALL SELECT item_id, attempt, language, cleaned FROM cc_java")


def strip_comments_sql() -> str:
    return f"WITH {CODE_COMPLETIONS} SELECT item_id, attempt, {STRIP.format(x='stripped')} AS stripped FROM cc_py"


def split_doc_sql() -> str:
    return (f"WITH {CODE_COMPLETIONS}, c AS (SELECT *, CASE WHEN attempt = 0 THEN '# ' ELSE '' END || prompt || completion AS code FROM cc_py) "
            "SELECT item_id, attempt, doc, substring(code, length(doc) + 1) AS func FROM c")


def regroup_sql() -> str:
    return (f"WITH c AS ({cut_python_sql()}) SELECT item_id, count(*) AS n_completions, "
            f"array_to_string(list(cleaned ORDER BY attempt), chr(30)) AS completions_joined FROM c GROUP BY item_id")


def validate_names_sql() -> str:
    return f"""WITH {attempts_cte()},
v AS (SELECT 'language' AS field, language AS value FROM attempts
      UNION ALL SELECT 'recipe' AS field,
        CASE WHEN ends_with(quantization, '-rnd') THEN 'pajama' WHEN ends_with(quantization, '-mixed') THEN 'code_technical_language'
             WHEN ends_with(quantization, '-code') THEN 'github_code' ELSE 'none' END AS value FROM attempts)
SELECT field, value, count(*) AS n_rows,
  CASE WHEN field = 'language' THEN value IN ('java', 'py') ELSE value IN ('pajama', 'github_code', 'code_technical_language') END AS valid
FROM v GROUP BY ALL"""


def tokenizer_checks_sql() -> str:
    h = h48("model")
    return f"""WITH {attempts_cte()},
m AS (SELECT model, count(*) AS n_attempts FROM attempts GROUP BY ALL),
t AS (SELECT model, n_attempts, CASE WHEN starts_with(model, 'codellama') THEN NULL ELSE {h} % 7 END AS pad_raw,
             2 + {h} % 5 AS eos_id, [0, 1, 2, 3, 4, 5, 6] AS specials FROM m)
SELECT model, n_attempts, cast(coalesce(pad_raw, eos_id) as bigint) AS pad_id, cast(eos_id as bigint) AS eos_id,
  len(specials) >= 1 AS has_specials, list_contains(specials, coalesce(pad_raw, eos_id)) AS pad_is_special,
  list_contains(specials, eos_id) AS eos_is_special
FROM t"""


def completion_queries() -> dict[str, str]:
    return {
        "strip_prompt": strip_prompt_sql(),
        "prompt_removal": prompt_removal_sql(),
        "stop_truncate": stop_truncate_sql(),
        "left_pad": left_pad_sql(),
        "trim_special_ids": trim_ids_sql(),
        "cut_first_function": cut_python_sql(),
        "cut_first_function_strict": cut_both_sql(),
        "strip_comments": strip_comments_sql(),
        "split_doc": split_doc_sql(),
        "regroup_completions": regroup_sql(),
        "validate_names": validate_names_sql(),
        "tokenizer_checks": tokenizer_checks_sql(),
    }


def clean_job_sql(language: str = "py") -> str:
    return (f"WITH {_code(language)} SELECT CASE WHEN item_id % 2 = 0 THEN 'runA' ELSE 'runB' END "
            f"|| '/{language}_benchmark/P_' || cast(item_id as varchar) || '.json.gz' AS rel_path, "
            f"'P_' || cast(item_id as varchar) AS name, count(*) FILTER (item_id % 5 <> 4) AS n_completions, "
            f"coalesce(array_to_string(list(cleaned ORDER BY attempt) FILTER (item_id % 5 <> 4), chr(30)), '') AS completions_joined, "
            f"'{language}' AS language, 0.2::DOUBLE AS temperature, 0.95::DOUBLE AS top_p, 'assert f(1)' AS tests, true AS extra_b "
            f"FROM cc_{language} GROUP BY item_id")


def job_queries() -> dict[str, str]:
    return {
        "results_csv": f"WITH {attempts_cte()} SELECT model, quantization, language, problem, attempt, pass FROM attempts_pass",
        "report_from_csv": report_sql(RQ1),
        "calibration_csv": quota_sample_sql(),
        "split_files": f"SELECT sample_id, raw_data, split FROM ({train_val_sql()})",
        "report_csv": report_sql(RQ1),
        "ingest_results": outcome_flag_sql(),
        "corpus_scan": "SELECT doc_id AS pos, text, source AS meta FROM documents WHERE lang = 'en' AND doc_id % 4 <> 0",
        "corpus_arrival": ("SELECT pos, text, meta FROM (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, text, "
                           "CAST(doc_id AS VARCHAR) AS meta, lang, doc_id FROM documents) WHERE lang = 'en' AND doc_id % 4 <> 0"),
        "corpus_arrival_parquet": ("SELECT row_number() OVER (ORDER BY doc_id) - 1 AS pos, text, CAST(doc_id AS VARCHAR) AS meta "
                                   "FROM documents"),
        "pass_report": ("SELECT *, 'pass_result_temp_0_2_' || language || '_' || translate(model || '-' || quantization, '/-', '__') || '.csv' "
                        f"AS report FROM (({pass_at_k_sql(1)}) UNION ALL ({pass_at_k_sql(10)}))"),
        "batch_job": (f"WITH s AS ({random_windows_sql(40, 64, 1, True)}), "
                      f"v AS (SELECT sample_id FROM s ORDER BY {h48('concat_ws(chr(124), 1, sample_id)')}, sample_id LIMIT 8), "
                      "t AS (SELECT s.*, CASE WHEN v.sample_id IS NULL THEN 'train' ELSE 'val' END AS split FROM s LEFT JOIN v USING (sample_id)) "
                      "SELECT t.*, count(*) OVER (PARTITION BY split) AS n_sequences, "
                      "cast(sum(num_tokens) OVER (PARTITION BY split) as bigint) AS total_tokens, 'pajama' AS recipe FROM t"),
        "keep_until": ("SELECT doc_id, array_to_string(list_concat(list_slice(ls, 1, least(len(ls), 2) - 1), "
                       "[substring(ls[least(len(ls), 2)], 1, 5)]), chr(10)) AS kept "
                       "FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)"),
        "clean_completions_job": clean_job_sql(),
        "clean_completions_java": clean_job_sql("java"),
    }


def stream_queries_sql() -> dict[str, str]:
    quota = f"WITH RECURSIVE {CODE_CORPUS},\n{greedy_quota_cte(64, 20)}\nSELECT pos, repo, language FROM chosen"
    head = f"WITH {QA_CORPUS},\n{QA_FILTERED}\nSELECT pos FROM qa_f WHERE {ntok()} > 64 ORDER BY pos LIMIT 20"
    return {
        "stream_filter": (f"WITH {CODE_CORPUS}, {CODE_ELIGIBLE.format(seqlen=64)} "
                          f"SELECT e.pos, e.repo, e.language, {ntok('c.text')} AS n_tokens "
                          f"FROM code_e e JOIN code c ON c.pos = e.pos"),
        "stream_quota": quota,
        "stream_quota_stop": quota,
        "stream_head": head,
        "stream_head_stop": head,
        "stream_pass_rate": pass_rate_sql(),
    }
