"""DuckDB SQL for the core queries, over the same tables, written independently of the Column expressions."""

from __future__ import annotations


_W = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_NL = "chr(10)"

# The wording of prompts and records, written out again so that a slip in either place shows.
_SHAPE = "Solution Explanation:\n...\nTime Complexity: O(...)\nSpace Complexity: O(...)\n```cpp\n...\n```"
_INSTRUCTION = f"Solve the algorithm problem using C++17 within the stated resource limits. The Solution Explanation section must be written in Chinese. Use this exact response structure:\n{_SHAPE}"
_CONTRACT = "resource feasibility + compile + repair tests + held-out tests"
_CLOSING = "Return a C++17 solution and structured time/space complexity analysis."
_PLACEHOLDER = "Solution Explanation:\n该候选代码未能稳定通过验证，不应作为优先答案。\nTime Complexity: unknown\nSpace Complexity: unknown\n```cpp\n#include <bits/stdc++.h>\nusing namespace std;\nint main(){return 0;}\n```"
_REJECTED_WHY = "该候选代码未通过测试验证，说明其算法、边界处理或输出格式存在问题，不应作为优先答案。"
_TAGS_BEFORE, _TAGS_AFTER = "根据题意分析输入规模和输出要求，结合 ", " 等算法思想设计解法。实现时需要按照题目给定的输入格式读取数据，并严格输出要求的结果。"
_NO_TAGS = "根据题意推导需要计算的目标，按照约束选择能在时间和空间限制内通过的方法。实现时需要准确处理输入输出格式和边界情况。"
_STRUCTURE = "Use this exact response structure:\nWrite Solution Explanation in Chinese.\nSolution Explanation:\n...\n\nTime Complexity: O(...)\nSpace Complexity: O(...)\n```cpp\n...\n```"
_REASONS = "'REPAIR_TEST_FAILED', 'COMPILE_FAILED', 'REPAIR_TEST_TIMEOUT', 'HELD_OUT_TEST_FAILED'"


def _q(s: str) -> str:
    """A SQL string literal; line ends as chr()."""
    return "('" + s.replace("'", "''").replace("\n", "' || chr(10) || '") + "')"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_W}+|{_W}+$', '', 'g')"


def _rstrip_lines(lines: str) -> str:
    return f"array_to_string(list_transform({lines}, lambda l: regexp_replace(l, '{_W}+$', '')), {_NL})"


def _norm_output(x: str) -> str:
    return f"regexp_replace({_rstrip_lines(f'string_split(replace(replace({x}, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10))')}, '\\n+$', '')"


def _norm_code(x: str) -> str:
    return _rstrip_lines(f"string_split_regex({_strip(x)}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')")


def _trim(x: str, n: int) -> str:
    return f"(CASE WHEN length({x}) <= {n} THEN {x} ELSE substr({x}, 1, {n - 3}) || '...' END)"


def _lf(x: str) -> str:
    return f"regexp_replace({x}, '\\r\\n|\\r', chr(10), 'g')"


def _extract(x: str, strict: bool) -> str:
    fence = r"(?is)```(?:cpp|c\+\+)?\s*(.*?)```"
    tail = f"CASE WHEN strpos({x}, '#include') > 0 THEN substr({x}, strpos({x}, '#include')) ELSE {chr(39) * 2 if strict else x} END"
    return f"(CASE WHEN regexp_matches({x}, '{fence}') THEN {_strip(f'regexp_extract({x}, {chr(39)}{fence}{chr(39)}, 1)')} ELSE {_strip(tail)} END)"


def _declared(x: str, kind: str) -> str:
    return rf"coalesce(nullif(regexp_extract({x}, '(?i){kind}\s+complexity\s*:\s*(o\s*\([^)]+\))', 1), ''), 'unknown')"


def _labeled(x: str, label: str) -> str:
    return rf"coalesce(nullif(regexp_extract(replace({x}, '：', ':'), '(?i){label}\s*:\s*(O\s*\([^)]+\)|unknown)', 1), ''), 'unknown')"


def _field(x: str, label: str, i: int) -> str:
    every = rf"regexp_extract_all({x}, '(?i)(O\s*\([^)]+\))', 1)"
    return f"(CASE WHEN {_labeled(x, label)} <> 'unknown' THEN {_labeled(x, label)} ELSE coalesce({every}[{i}], 'unknown') END)"


def _heading(label: str) -> str:
    return rf"(?i)(?:\A|\n)\s*(?:#{{1,6}}\s*)?{label}\s*:?\s*"


_EX, _TC, _SC = r"solution\s+explanation", r"time\s+complexity", r"space\s+complexity"


def _format_flags(x: str) -> str:
    after = rf"regexp_extract({x}, '(?is)(?:\A|\n)\s*(?:#{{1,6}}\s*)?{_EX}\s*:?\s*(.*)\z', 1)"
    return (
        f"regexp_matches({x}, '{_heading(_EX)}') AS explanation_field, "
        f"regexp_matches({x}, '{_heading(_EX)}') AND regexp_matches(coalesce(string_split_regex({after}, '{_heading(_TC)}')[1], ''), '[一-鿿]') AS chinese_explanation, "
        f"regexp_matches({x}, '{_heading(_TC)}') AND regexp_matches({x}, '{_heading(_SC)}') AS complexity_field, "
        rf"regexp_matches({x}, '(?is)```(?:cpp|c\+\+)\s*.*?```') AS cpp_code_block"
    )


# result-shaped rows

def _ok(k: str, ty: str, i: str) -> str:
    return f"({ty} = 'purchase' OR ({k} + {i}) % 3 <> 0)"


def _fails(k: str, ty: str, n: str) -> str:
    return f"list_filter(range({n}), lambda i: NOT {_ok(k, ty, 'i')})"


_RUNS = """
WITH e AS (
  SELECT event_id, user_id, event_type, value, CAST(regexp_extract(props, '[0-9]+') AS INT) AS k, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events
), a AS (SELECT 'u' || user_id || '-' || (i // 4) AS problem_id, i % 4 + 1 AS attempt, event_id, event_type, value, k FROM e),
p AS (
  SELECT problem_id, count(*) AS attempts, arg_max(event_id, attempt) AS ord, arg_max(event_type, attempt) AS lt, arg_max(value, attempt) AS lv, arg_max(k, attempt) AS lk,
    arg_min(event_type, attempt) FILTER (event_type <> 'view') AS ft, arg_max(event_type, attempt) FILTER (event_type <> 'view') AS xt,
    arg_max(value, attempt) FILTER (event_type <> 'view') AS xv, arg_max(k, attempt) FILTER (event_type <> 'view') AS xk
  FROM a GROUP BY problem_id
), r AS (
  SELECT *, CASE WHEN lt = 'purchase' THEN 'SOLVED' WHEN lk % 13 <> 0 THEN 'FAILED' END AS status, (lt = 'purchase' OR lv > 50) AS held,
    CASE WHEN lt = 'purchase' THEN NULL WHEN lt = 'error' THEN 'COMPILE_FAILED' WHEN lv > 150 THEN 'THEORETICAL_TLE' WHEN lk % 11 = 0 THEN 'HELD_OUT_TEST_FAILED' WHEN lt = 'click' THEN 'REPAIR_TEST_FAILED' WHEN lk % 2 = 0 THEN '' END AS reason,
    coalesce(ft <> 'error', false) AS first_compiled, CASE WHEN lt = 'purchase' OR lv > 50 THEN true ELSE coalesce(xt <> 'error', false) END AS final_compiled,
    coalesce(CASE WHEN xk % 4 > 0 THEN 1 - len({xf}) / (xk % 4) END, 0.0) AS repair_rate, CASE WHEN lt = 'purchase' OR lv > 50 THEN 1 - len({lf}) / 2 ELSE 0.0 END AS held_out_rate,
    {xf} AS xfails, {lf} AS lfails
  FROM p
)""".replace("{xf}", _fails("xk", "xt", "xk % 4")).replace("{lf}", _fails("lk", "lt", "2"))

_CATEGORY = """
f AS (SELECT *, xfails[1] AS i FROM r WHERE status IS DISTINCT FROM 'SOLVED'),
g AS (
  SELECT *, CASE WHEN (xk + i) % 7 = 0 THEN '' ELSE (xk + i) || ' ok' END AS expected,
    CASE WHEN (xk + i) % 5 = 0 THEN '' WHEN (xk + i) % 5 = 1 THEN (xk + i) || '  ok' ELSE (xk + i) || ' no' END AS actual FROM f
), c AS (
  SELECT *, CASE
    WHEN reason IN ('THEORETICAL_TLE', 'THEORETICAL_MLE') THEN reason
    WHEN xt IS NULL THEN coalesce(nullif(reason, ''), 'NO_CANDIDATE')
    WHEN xt = 'error' THEN 'COMPILE_ERROR'
    WHEN len(xfails) > 0 AND xv > 100 THEN 'TIMEOUT'
    WHEN reason = 'HELD_OUT_TEST_FAILED' THEN 'HELD_OUT_FAILED'
    WHEN len(xfails) = 0 AND held AND len(lfails) > 0 AND lv > 100 THEN 'HELD_OUT_TIMEOUT'
    WHEN len(xfails) = 0 AND held AND len(lfails) > 0 THEN 'HELD_OUT_FAILED'
    WHEN len(xfails) = 0 THEN coalesce(nullif(reason, ''), 'UNKNOWN_FAILURE')
    WHEN actual = '' AND expected <> '' THEN 'EMPTY_OUTPUT'
    WHEN actual <> '' AND expected = '' THEN 'EXTRA_OUTPUT'
    WHEN replace(actual, '  ', ' ') = replace(expected, '  ', ' ') AND actual <> expected THEN 'OUTPUT_FORMAT'
    ELSE 'WRONG_ANSWER' END AS category FROM g
)"""

# bundle-shaped rows


def _g(x: str) -> str:
    return rf"regexp_replace(printf('%.6f', {x}), '\.?0+$', '')"


_PROMPT = (
    "'Title: ' || coalesce(title, '') || chr(10) || chr(10) || coalesce(statement, '') || chr(10) || chr(10) || 'Input format:' || chr(10) || coalesce(input_format, '') || chr(10) || chr(10) || "
    "'Output format:' || chr(10) || coalesce(output_format, '') || chr(10) || chr(10) || 'Constraints:' || chr(10) || coalesce(array_to_string(list_transform(list_filter(constraints, lambda c: c IS NOT NULL), lambda c: '- ' || c), chr(10)), '') || chr(10) || chr(10) || "
    f"'Language: ' || coalesce(language, 'cpp17') || chr(10) || 'Time limit: ' || {_g('coalesce(time_limit_sec, 2.0)')} || ' seconds' || chr(10) || 'Memory limit: ' || coalesce(memory_limit_mb, 256) || ' MB' || chr(10) || chr(10) || {_q(_CLOSING)}"
)
_TRIMMED = _strip("coalesce(expected_complexity, '')")
_TAGS = "coalesce(array_to_string(tags, ', '), '')"
_ANSWER = (
    f"'Solution Explanation:' || chr(10) || CASE WHEN {_TAGS} <> '' THEN {_q(_TAGS_BEFORE)} || {_TAGS} || {_q(_TAGS_AFTER)} ELSE {_q(_NO_TAGS)} END || chr(10) || chr(10) || "
    f"'Time Complexity: ' || {_field(_TRIMMED, 'time', 1)} || chr(10) || 'Space Complexity: ' || {_field(_TRIMMED, 'space', 2)} || chr(10) || '```cpp' || chr(10) || cpp || chr(10) || '```'"
)
_LAST = """
s0 AS (SELECT * FROM problem_specs WHERE problem_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY spec_id DESC) = 1),
o0 AS (SELECT problem_id, tags, expected_complexity, reference_solution FROM oracle_meta WHERE problem_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY oracle_id DESC) = 1),
l0 AS (
  SELECT problem_id, count(*) AS n, arg_min(code, solution_id) FILTER (language = 'cpp17' AND verified) AS vcpp, arg_min(code, solution_id) FILTER (language = 'cpp17') AS acpp,
    arg_min(code, solution_id) FILTER (language = 'python3' AND verified) AS vpy, arg_min(code, solution_id) FILTER (language = 'python3') AS apy
  FROM solutions WHERE problem_id IS NOT NULL AND coalesce(code, '') <> '' GROUP BY problem_id
)"""
_BUNDLES = f"""
WITH {_LAST}, b0 AS (SELECT s0.problem_id, s0.spec_id, title, statement, input_format, output_format, constraints, language, time_limit_sec, memory_limit_mb, tags, expected_complexity, coalesce(vcpp, reference_solution, '') AS cpp
  FROM s0 LEFT JOIN o0 USING (problem_id) LEFT JOIN l0 USING (problem_id)),
b AS (SELECT problem_id, spec_id, cpp, {_PROMPT} AS prompt, {_ANSWER} AS answer FROM b0)"""

#: the outcome of each specification with all tests and all codes of its problem
_WHOLE = """
WITH n AS (SELECT problem_id, count(*) AS n FROM test_cases WHERE problem_id IS NOT NULL GROUP BY problem_id),
s AS (SELECT problem_id, count(*) AS m FROM solutions WHERE problem_id IS NOT NULL AND coalesce(code, '') <> '' GROUP BY problem_id),
w AS (SELECT spec_id, p.problem_id, CASE WHEN coalesce(n.n, 0) < 2 THEN 'bad_tests' WHEN m IS NULL THEN 'no_solution' ELSE 'written' END AS outcome
  FROM problem_specs p LEFT JOIN n ON n.problem_id = p.problem_id LEFT JOIN s ON s.problem_id = p.problem_id)"""

_REJ = "coalesce(rejected, '')"
_DPO = f"""{_BUNDLES},
q AS (SELECT pair_id, coalesce(problem_id, '') AS problem_id, coalesce(failure_reason, '') AS why, {_extract(_REJ, True)} AS code, {_declared(_REJ, 'time')} AS tc, {_declared(_REJ, 'space')} AS sc FROM dpo_pairs),
j AS (SELECT q.*, b.problem_id IS NOT NULL AS known, b.cpp, b.answer, {_norm_code('q.code')} AS norm, {_norm_code("coalesce(b.cpp, '')")} AS cnorm FROM q LEFT JOIN b USING (problem_id)),
k AS (SELECT *, CASE WHEN why NOT IN ({_REASONS}) THEN 'skipped_failure_reason' WHEN NOT known THEN 'skipped_no_problem' WHEN cpp = '' THEN 'skipped_no_verified_cpp' WHEN code = '' THEN 'skipped_no_failed_code' WHEN norm = cnorm THEN 'skipped_same_as_chosen' END AS o FROM j),
w AS (SELECT *, coalesce(o, CASE WHEN row_number() OVER (PARTITION BY problem_id, norm, o IS NULL ORDER BY pair_id) > 1 THEN 'skipped_duplicate' ELSE 'written' END) AS outcome FROM k)"""
_REJECTED = f"'Solution Explanation:' || chr(10) || {_q(_REJECTED_WHY)} || chr(10) || chr(10) || 'Time Complexity: ' || tc || chr(10) || 'Space Complexity: ' || sc || chr(10) || '```cpp' || chr(10) || {_strip('code')} || chr(10) || '```'"

_B1 = r"\b([a-z][a-z0-9_]*)\s*<=\s*([0-9]+(?:e[0-9]+)?)"
_B2 = r"(?:[0-9]+(?:e[0-9]+)?\s*<=\s*)?([a-z][a-z0-9_]*(?:\s+[a-z][a-z0-9_]*)*)\s*<=\s*([0-9]+(?:e[0-9]+)?)"


def _bounds(src: str, key: str) -> str:
    return f"""
x0 AS (SELECT {key}, replace(lower(unnest(constraints)), ',', ' ') AS c FROM {src}),
x1 AS (SELECT {key}, unnest(regexp_extract_all(c, '{_B1}', 1)) AS names, unnest(regexp_extract_all(c, '{_B1}', 2)) AS v FROM x0
  UNION ALL SELECT {key}, unnest(regexp_extract_all(c, '{_B2}', 1)), unnest(regexp_extract_all(c, '{_B2}', 2)) FROM x0),
x2 AS (SELECT {key}, unnest(string_split_regex(names, '\\s+')) AS variable, CAST(trunc(CAST(v AS DOUBLE)) AS BIGINT) AS v FROM x1),
bounds AS (SELECT {key}, variable, max(v) AS bound FROM x2 GROUP BY ALL)"""


def _estimate(tag: str, field: str) -> str:
    """CTEs that end in est<tag>(problem_id, e, v): the estimate of a complexity string of oracle_meta."""
    log, power = "'^log2?\\(?([a-z][a-z0-9_]*)\\)?$'", "'^([a-z][a-z0-9_]*)\\^([0-9]+)$'"
    return f"""
y{tag}0 AS (SELECT problem_id, {field} AS tc FROM s0 JOIN o0 USING (problem_id)),
y{tag}1 AS (SELECT problem_id, regexp_replace(trim(regexp_extract(replace(replace(replace(replace(lower(tc), '²', '^2'), '³', '^3'), 'time', ''), 'space', ''), 'o\\s*\\(([^)]+)\\)', 1)), '\\blog\\s+([a-z])', 'log(\\1)', 'g') AS e FROM y{tag}0),
y{tag}2 AS (SELECT problem_id, unnest(string_split(e, '+')) AS term, generate_subscripts(string_split(e, '+'), 1) AS ti FROM y{tag}1),
y{tag}3 AS (SELECT problem_id, ti, regexp_replace(regexp_replace(regexp_replace(trim(term), ' ', '*', 'g'), '\\*+', '*', 'g'), '^\\*+|\\*+$', '', 'g') AS flat FROM y{tag}2),
y{tag}4 AS (SELECT problem_id, ti, flat, unnest(string_split(flat, '*')) AS tok FROM y{tag}3),
y{tag}5 AS (SELECT problem_id, ti, flat, tok, CASE WHEN regexp_matches(tok, {log}) THEN regexp_extract(tok, {log}, 1) WHEN regexp_matches(tok, {power}) THEN regexp_extract(tok, {power}, 1) ELSE tok END AS variable FROM y{tag}4),
y{tag}6 AS (SELECT t.problem_id, ti, flat, CASE WHEN tok IN ('', '1') THEN 1.0::DOUBLE WHEN regexp_matches(tok, {log}) THEN CASE WHEN bound IS NOT NULL THEN greatest(1.0::DOUBLE, log2(greatest(2.0::DOUBLE, bound::DOUBLE))) END
  WHEN regexp_matches(tok, {power}) THEN pow(bound::DOUBLE, regexp_extract(tok, {power}, 2)::DOUBLE) WHEN regexp_matches(tok, '^[0-9]+$') THEN tok::DOUBLE ELSE bound::DOUBLE END AS f
  FROM y{tag}5 t LEFT JOIN bounds b ON b.problem_id = t.problem_id AND b.variable = t.variable),
y{tag}7 AS (SELECT problem_id, ti, CASE WHEN any_value(flat) <> '' AND count(*) = count(f) THEN ceil(product(f)) END AS v FROM y{tag}6 GROUP BY problem_id, ti),
y{tag}8 AS (SELECT problem_id, CASE WHEN count(*) = count(v) THEN sum(v) END AS total FROM y{tag}7 GROUP BY problem_id),
y{tag}9 AS (SELECT t.problem_id, e, total, (SELECT bound FROM bounds b WHERE b.problem_id = t.problem_id AND b.variable = regexp_extract(e, '2\\^([a-z][a-z0-9_]*)', 1)) AS two FROM y{tag}1 t LEFT JOIN y{tag}8 USING (problem_id)),
est{tag} AS (SELECT problem_id, e, CASE WHEN e = '' THEN NULL WHEN e = '1' THEN 1.0::DOUBLE WHEN regexp_matches(e, '2\\^([a-z][a-z0-9_]*)') THEN CASE WHEN two <= 60 THEN pow(2.0::DOUBLE, two) END ELSE total END AS v FROM y{tag}9)"""


_T = "(char|bool|short|int|float|long long|double)"


def _memory(src: str, key: str) -> str:
    """CTEs that end in mem(<key>, bytes) for rows (<key>, problem_id, code) of ``src`` with known sizes."""
    static, vector = rf"(?i)\b{_T}\s+\w+\s*((?:\[[a-z0-9_]+\])+)", rf"(?i)\bvector\s*<\s*{_T}\s*>\s+\w+\s*\(\s*([a-z0-9_]+)\s*\)"
    matrix = rf"(?i)vector\s*<\s*vector\s*<\s*{_T}\s*>\s*>\s+\w+\s*\(\s*([a-z0-9_]+)\s*,\s*vector\s*<[^>]+>\s*\(\s*([a-z0-9_]+)"
    every = lambda p, i: f"regexp_extract_all(code, '{p}', {i})"
    return rf"""
m0 AS (
  SELECT {key}, problem_id, 's' || generate_subscripts({every(static, 1)}, 1) AS d, unnest({every(static, 1)}) AS t, unnest(list_transform({every(static, 2)}, lambda x: regexp_extract_all(lower(x), '\[([a-z0-9_]+)\]', 1))) AS dims FROM {src}
  UNION ALL SELECT {key}, problem_id, 'v' || generate_subscripts({every(vector, 1)}, 1), unnest({every(vector, 1)}), unnest(list_transform({every(vector, 2)}, lambda x: [lower(x)])) FROM {src}
  UNION ALL SELECT {key}, problem_id, 'm' || generate_subscripts({every(matrix, 1)}, 1), unnest({every(matrix, 1)}), unnest(list_transform(list_zip({every(matrix, 2)}, {every(matrix, 3)}), lambda x: [lower(x[1]), lower(x[2])])) FROM {src}
), m1 AS (SELECT {key}, problem_id, d, t, unnest(dims) AS dim FROM m0),
m2 AS (SELECT m1.{key}, d, t, CASE WHEN regexp_matches(dim, '^[0-9]+$') THEN dim::DOUBLE ELSE bound::DOUBLE END AS n FROM m1 LEFT JOIN bounds b ON b.problem_id = m1.problem_id AND b.variable = m1.dim),
m3 AS (SELECT {key}, d, CASE lower(any_value(t)) WHEN 'char' THEN 1 WHEN 'bool' THEN 1 WHEN 'short' THEN 2 WHEN 'int' THEN 4 WHEN 'float' THEN 4 ELSE 8 END * product(n) AS bytes FROM m2 GROUP BY {key}, d HAVING count(*) = count(n) AND (d[1] <> 's' OR product(n) <> 0)),
mem AS (SELECT {key}, sum(bytes) AS bytes FROM m3 GROUP BY {key})"""


_EST = f"WITH {_LAST}, {_bounds('s0', 'problem_id')}, {_estimate('t', _field(_TRIMMED, 'time', 1))} SELECT problem_id, e AS expression, round(v, 0) AS operations FROM estt"
_MEMORY = f"WITH {_LAST}, {_bounds('s0', 'problem_id')}, src AS (SELECT solution_id, problem_id, coalesce(code, '') AS code FROM solutions JOIN s0 USING (problem_id) WHERE solutions.language = 'cpp17'), {_memory('src', 'solution_id')} SELECT solution_id, bytes FROM src LEFT JOIN mem USING (solution_id)"
_VERDICT = f"""WITH {_LAST}, {_bounds('s0', 'problem_id')}, {_estimate('t', _field(_TRIMMED, 'time', 1))}, {_estimate('s', _field(_TRIMMED, 'space', 2))},
src AS (SELECT problem_id, coalesce(reference_solution, '') AS code FROM s0 JOIN o0 USING (problem_id)), {_memory('src', 'problem_id').replace('SELECT problem_id, problem_id,', 'SELECT problem_id,')},
z AS (SELECT s0.problem_id, estt.v AS ops, greatest(mem.bytes, ests.v * 8) AS size, CAST(floor(coalesce(time_limit_sec, 2.0) * 100000000) AS BIGINT) AS budget, CAST(coalesce(memory_limit_mb, 256) AS BIGINT) * 1024 * 1024 AS room
  FROM s0 JOIN o0 USING (problem_id) JOIN estt USING (problem_id) JOIN ests USING (problem_id) LEFT JOIN mem USING (problem_id)),
st AS (SELECT *, CASE WHEN ops IS NULL THEN 'UNKNOWN' WHEN ops <= budget THEN 'PASS' ELSE 'FAIL' END AS ts, CASE WHEN size IS NULL THEN 'UNKNOWN' WHEN size <= room THEN 'PASS' ELSE 'FAIL' END AS ms FROM z)
SELECT problem_id, ts AS time_status, ms AS memory_status, budget AS operation_budget, room AS memory_budget_bytes, CAST(ts <> 'PASS' AS INT) + CAST(ms <> 'PASS' AS INT) AS reasons FROM st"""


def oracle_sql() -> dict[str, str]:
    rej, cho = _REJ, "coalesce(chosen, '')"
    rates = "count(*) AS num_problems, " + ", ".join(f"round(coalesce(avg(CASE WHEN {a} THEN 1.0::DOUBLE ELSE 0.0 END), 0), 9) AS {a if a != 'format_valid' else a}_rate" for a in ("format_valid", "chinese_explanation", "complexity_field", "cpp_code_block"))
    valid = "explanation_field AND chinese_explanation AND complexity_field AND cpp_code_block AS format_valid"
    r9 = lambda x, n: f"round(coalesce(avg({x}), 0), 9) AS {n}"
    b = lambda x: f"CASE WHEN {x} THEN 1.0::DOUBLE ELSE 0.0 END"
    case = "CASE WHEN strpos({c}, '{s}') > 0 THEN 0.2::DOUBLE ELSE 0.0 END"
    lang = "CASE WHEN strpos(lower(coalesce(code, '')), '#include') > 0 OR strpos(lower(coalesce(code, '')), 'using namespace std') > 0 THEN 'cpp17' WHEN strpos(lower(coalesce(code, '')), 'def ') > 0 OR strpos(lower(coalesce(code, '')), 'input(') > 0 OR strpos(lower(coalesce(code, '')), 'sys.stdin') > 0 THEN 'python3' ELSE 'unknown' END"
    lines = "list_filter(list_transform(string_split_regex(concat_ws(chr(10), statement, array_to_string(constraints, chr(10))), '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{85}\\x{2028}\\x{2029}]'), lambda l: " + _strip("l") + "), lambda l: l <> '' AND (strpos(lower(l), 'constraint') > 0 OR strpos(l, '<=') > 0 OR strpos(l, '≤') > 0))"
    flat = lambda x: f"regexp_replace({_strip(x)}, '{_W}+', ' ', 'g')"
    return {
        "metrics_summary": f"{_RUNS} SELECT count(*) AS num_problems, {r9(b('first_compiled'), 'initial_compile_rate')}, {r9(b('final_compiled'), 'final_compile_rate')}, {r9('repair_rate', 'repair_test_pass_rate')}, {r9('held_out_rate', 'held_out_test_pass_rate')}, "
        + ", ".join([r9(b("status = 'SOLVED'"), "verified_success_rate"), r9("attempts - 1", "avg_repair_turns"), r9(b("lv > 150"), "theoretical_tle_rate"), r9(b("lk = 7"), "theoretical_mle_rate"), r9(b("(lv <= 150 AND lv < 3) OR (lk <> 7 AND lv < 1)"), "complexity_unknown_rate")])
        + ", round(coalesce(avg(CASE WHEN lk % 2 = 1 THEN 1.0::DOUBLE ELSE 0.0 END) FILTER (status = 'SOLVED'), 0), 9) AS explanation_success_rate FROM r",
        "per_problem_rates": f"{_RUNS} SELECT problem_id, first_compiled, final_compiled, round(repair_rate, 9) AS repair_rate, round(held_out_rate, 9) AS held_out_rate, attempts - 1 AS turns FROM r",
        "failure_breakdown": f"{_RUNS} SELECT reason AS failure_reason, count(*) AS n, min(ord) AS first_seen FROM r WHERE coalesce(reason, '') <> '' GROUP BY reason",
        "failure_histogram": f"{_RUNS}, {_CATEGORY}, h AS (SELECT category, count(*) AS n, min(ord) AS o FROM c GROUP BY category) SELECT category, n, row_number() OVER (ORDER BY n DESC, o) AS rank FROM h",
        "failure_totals": f"{_RUNS} SELECT count(*) AS total, count(*) FILTER (status = 'SOLVED') AS solved, count(*) FILTER (status IS DISTINCT FROM 'SOLVED') AS failed, round(avg({b(chr(39).join(['status = ', 'SOLVED', '']))}), 9) AS verified_success_rate FROM r",
        "diagnostic_categories": f"{_RUNS}, {_CATEGORY} SELECT problem_id, category FROM c",
        "topk_examples": f"{_RUNS}, {_CATEGORY}, t AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ord) AS example FROM c) SELECT category, example, problem_id, 'run ended after' || chr(10) || lk AS diagnostic_summary, CASE WHEN i IS NOT NULL THEN printf('repair-%04d', i + 1) END AS test_id, CASE WHEN i IS NULL THEN '' ELSE expected END AS expected, CASE WHEN i IS NULL THEN '' ELSE actual END AS actual, 'k=' || lk AS last_trace FROM t WHERE example <= 5",
        "agent_failure_reason": f"{_RUNS} SELECT problem_id, CASE WHEN lv > 150 THEN 'THEORETICAL_TLE' WHEN lk = 7 THEN 'THEORETICAL_MLE' WHEN lt = 'view' THEN 'RESOURCE_CHECK_FAILED' WHEN lt = 'error' THEN 'COMPILE_FAILED' WHEN lv > 100 AND len({_fails('lk', 'lt', 'lk % 4')}) > 0 THEN 'REPAIR_TEST_TIMEOUT' ELSE 'REPAIR_TEST_FAILED' END AS reason FROM r",
        "held_out_summaries": f"{_RUNS} SELECT problem_id, 'Held-out evaluation failed: ' || len(lfails) || '/2 tests failed; ' || CASE WHEN lv > 100 THEN len(lfails) ELSE 0 END || ' timed out. Test inputs and expected outputs are withheld.' AS summary FROM r WHERE held",
        "normalize_output": f"SELECT case_id, {_norm_output('expected_stdout')} AS out, {_norm_output('stdin')} AS inp FROM test_cases",
        "normalize_code": f"SELECT solution_id, md5({_norm_code('code')}) AS code_md5 FROM solutions",
        "slugify": "SELECT spec_id, coalesce(nullif(substr(lower(trim(regexp_replace(title, '[^a-zA-Z0-9]+', '_', 'g'), '_')), 1, 120), ''), 'problem') AS slug FROM problem_specs",
        "trim_text": f"SELECT spec_id, {_trim(_lf('statement'), 300)} AS short, replace({_trim(_lf(flat('statement')), 160)}, '`', chr(39)) AS line FROM problem_specs",
        "constraint_lines": f"SELECT spec_id, array_to_string({lines}, '|') AS lines FROM problem_specs",
        "detect_language": f"SELECT {lang} AS detected, language, count(*) AS n FROM solutions GROUP BY ALL",
        "parse_limits": r"SELECT pair_id, coalesce(CAST(nullif(regexp_extract(regexp_extract(coalesce(prompt, ''), 'Time limit: ([^\n]*)', 1), '[0-9]+(?:\.[0-9]+)?'), '') AS DOUBLE), 2.0) AS time_limit_sec, coalesce(CAST(nullif(regexp_extract(regexp_extract(coalesce(prompt, ''), 'Memory limit: ([^\n]*)', 1), '[0-9]+'), '') AS INT), 256) AS memory_limit_mb FROM dpo_pairs",
        "extract_code": f"SELECT pair_id, md5({_extract(rej, False)}) AS lenient, md5({_extract(rej, True)}) AS strict FROM dpo_pairs",
        "complexity_fields": f"SELECT oracle_id, {_field(_TRIMMED, 'time', 1)} AS time_complexity, {_field(_TRIMMED, 'space', 2)} AS space_complexity FROM oracle_meta",
        "declared_complexity": f"SELECT pair_id, {_declared(cho, 'time')} AS time_complexity, {_declared(cho, 'space')} AS space_complexity FROM dpo_pairs",
        "output_equality": f"SELECT case_id, {flat(chr(99) + 'oalesce(expected_stdout, ' + chr(39) * 2 + ')')} = {flat('coalesce(lower(expected_stdout), ' + chr(39) + ' ' + chr(39) + ')')} AS same_tokens FROM test_cases",
        "format_adherence": f"SELECT *, {valid} FROM (SELECT pair_id, {_format_flags(rej)}, md5(substr({rej}, 1, 1000)) AS preview_md5 FROM dpo_pairs)",
        "format_rates": f"SELECT {rates} FROM (SELECT *, {valid} FROM (SELECT {_format_flags(cho)} FROM dpo_pairs))",
        "format_reward": f"SELECT pair_id, round({case.format(c=cho, s='```cpp')} + {case.format(c=cho, s='Complexity:')} + CASE WHEN strpos({cho}, '#include') > 0 AND strpos({cho}, 'int main') > 0 THEN 0.2::DOUBLE ELSE 0.0 END, 9) AS reward FROM dpo_pairs",
        "variable_bounds": f"WITH {_bounds('problem_specs', 'spec_id')} SELECT spec_id, variable, bound FROM bounds",
        "complexity_estimate": _EST,
        "code_memory": _MEMORY,
        "resource_verdict": _VERDICT,
        "case_ids": "SELECT case_id, coalesce(nullif(id, ''), nullif(name, ''), printf('repair-%04d', row_number() OVER (PARTITION BY problem_id, suite, coalesce(pos, 0) // 32 ORDER BY case_id))) AS test_id FROM test_cases",
        "split_repair_eval": "WITH n AS (SELECT problem_id, count(*) AS n FROM test_cases WHERE problem_id IS NOT NULL GROUP BY problem_id HAVING count(*) > 1), k AS (SELECT *, least(n - 1, greatest(1, CAST(round_even(n * 0.7::DOUBLE, 0) AS BIGINT))) AS k FROM n) SELECT problem_id, n, least(k, 20) AS repair, least(n - k, 10) AS eval FROM k",
        "limit_on_success": "SELECT solution_id, verified FROM (SELECT *, coalesce(sum(CASE WHEN verified AND language = 'cpp17' THEN 1 ELSE 0 END) OVER (ORDER BY solution_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done FROM solutions) WHERE done < 50",
        "verified_filter": f"WITH {_LAST} SELECT problem_id, n FROM l0 WHERE vcpp IS NOT NULL",
        "best_solution": f"WITH {_LAST} SELECT problem_id, md5(coalesce(vcpp, acpp, reference_solution, '')) AS best, md5(coalesce(vpy, apy, '')) AS best_python, md5(coalesce(vcpp, reference_solution, '')) AS training FROM l0 FULL JOIN o0 USING (problem_id)",
        "tag_union": "WITH u AS (SELECT oracle_id, list_filter(list_concat(coalesce(tags, []), [difficulty], [source]), lambda x: x IS NOT NULL AND x <> '') AS l FROM oracle_meta) SELECT oracle_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') AS tags FROM u",
        "convert_manifest": f"{_WHOLE}, o AS (SELECT outcome FROM w UNION ALL SELECT 'bad_tests' FROM problem_specs WHERE spec_id % 17 = 0 UNION ALL SELECT 'function_task' FROM problem_specs WHERE spec_id % 19 = 0) SELECT outcome, count(*) AS n FROM o GROUP BY outcome",
        "convert_bundles": f"""{_WHOLE}, z AS (SELECT problem_id, greatest(1, CAST(round_even(n * 0.7::DOUBLE, 0) AS BIGINT)) AS k0, n FROM n WHERE n > 1), k AS (SELECT problem_id, n, least(n - 1, k0) AS k FROM z),
x AS (SELECT problem_id, row_number() OVER (PARTITION BY problem_id ORDER BY case_id) AS i, coalesce(stdin, '') || chr(31) || coalesce(expected_stdout, '') AS x FROM test_cases WHERE problem_id IS NOT NULL),
td AS (SELECT problem_id, least(any_value(k), 20) AS rn, least(any_value(n) - any_value(k), 10) AS en, md5(string_agg(x, chr(30) ORDER BY i) FILTER (i <= least(k, 20))) AS rd, md5(string_agg(x, chr(30) ORDER BY i) FILTER (i > k AND i <= k + 10)) AS ed FROM x JOIN k USING (problem_id) GROUP BY problem_id),
dc AS (SELECT problem_id, code, min(solution_id) AS o FROM solutions WHERE problem_id IS NOT NULL AND coalesce(code, '') <> '' GROUP BY ALL), cd AS (SELECT problem_id, count(*) AS cn, md5(string_agg({lang} || chr(31) || code, chr(30) ORDER BY o)) AS c5 FROM dc GROUP BY problem_id)
SELECT spec_id, outcome, CASE WHEN outcome = 'written' THEN rn ELSE NULL END AS repair, CASE WHEN outcome = 'written' THEN en ELSE NULL END AS eval, CASE WHEN outcome = 'written' THEN cn ELSE NULL END AS codes, CASE WHEN outcome = 'written' THEN rd END AS repair_md5, CASE WHEN outcome = 'written' THEN ed END AS eval_md5, CASE WHEN outcome = 'written' THEN c5 END AS codes_md5
FROM w LEFT JOIN td ON td.problem_id = w.problem_id LEFT JOIN cd ON cd.problem_id = w.problem_id""",
        "prompts": f"{_BUNDLES} SELECT problem_id, md5(prompt) AS prompt_md5 FROM b",
        "sft_records": f"{_BUNDLES} SELECT problem_id, md5(prompt) AS input_md5, md5(answer) AS output_md5 FROM b WHERE cpp <> ''",
        "template_dpo_records": f"{_BUNDLES} SELECT problem_id, md5(answer) AS chosen_md5, md5({_q(_PLACEHOLDER)}) AS rejected_md5 FROM b WHERE cpp <> ''",
        "grpo_prompts": f"{_BUNDLES} SELECT problem_id, {_q(_CONTRACT)} AS reward_contract, md5(prompt) AS prompt_md5 FROM b",
        "chat_records": f"{_BUNDLES} SELECT problem_id, md5({_q('<|im_start|>system' + chr(10) + 'Answer with a verified solution.<|im_end|>' + chr(10) + '<|im_start|>user' + chr(10))} || {_q(_INSTRUCTION)} || chr(10) || prompt || {_q('<|im_end|>' + chr(10) + '<|im_start|>assistant' + chr(10))} || answer || '<|im_end|>') AS chat_md5 FROM b WHERE cpp <> ''",
        "generation_prompts": f"{_BUNDLES} SELECT problem_id, md5(prompt || chr(10) || 'Attempt: 1' || chr(10) || {_q(_STRUCTURE)} || chr(10)) AS first_md5, md5(prompt || chr(10) || 'Attempt: 2' || chr(10) || {_q(_STRUCTURE)} || chr(10) || chr(10) || 'Previous attempt feedback:' || chr(10) || substr(repeat(answer, 20), 1, 4000) || chr(10)) AS later_md5, md5(prompt || chr(10) || chr(10) || {_q(_STRUCTURE)}) AS format_md5 FROM b",
        "dpo_outcomes": f"{_DPO} SELECT pair_id, outcome FROM w",
        "dpo_skip_stats": f"{_DPO} SELECT outcome, count(*) AS n FROM w GROUP BY outcome",
        "dpo_records": f"{_DPO} SELECT pair_id, problem_id, why AS failure_reason, md5(answer) AS chosen_md5, md5({_REJECTED}) AS rejected_md5 FROM w WHERE outcome = 'written'",
        "dedupe_keep_first": f"SELECT min(solution_id) AS solution_id, problem_id FROM solutions WHERE code IS NOT NULL GROUP BY problem_id, {_norm_code('code')}",
        "resume_remaining": f"WITH {_LAST} SELECT problem_id, spec_id FROM s0 WHERE problem_id NOT IN (SELECT problem_id FROM dpo_pairs WHERE failure_reason = 'COMPILE_FAILED' AND problem_id IS NOT NULL)",
        "resume_merge": f"{_RUNS} SELECT status, count(*) AS n FROM r GROUP BY status",
        "lookup_last_wins": "SELECT pair_id, max(s.spec_id) AS spec_id FROM dpo_pairs d LEFT JOIN problem_specs s ON s.problem_id = d.problem_id GROUP BY pair_id, d.problem_id",
        "leak_guard": f"{_BUNDLES} SELECT problem_id FROM b WHERE {_strip('cpp')} <> '' AND strpos(prompt, cpp) > 0",
        "resume_stream": "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS distinct_events FROM events GROUP BY event_type",
        "run_python_oracles": "SELECT 'n' || n_nationkey AS candidate_id, n_nationkey % 7 <> 2 AS compiled, CASE WHEN n_nationkey % 7 <> 2 THEN n_nationkey % 7 = 0 END AS passed, CASE WHEN n_nationkey % 7 <> 2 THEN n_nationkey % 7 IN (1, 5) END AS endless FROM nation",
        "repair_loop": """WITH k AS (SELECT 'n' || n_nationkey AS problem_id, n_nationkey % 6 AS k, n_nationkey || ' ' || n_regionkey AS i, n_nationkey + n_regionkey AS s FROM nation)
SELECT problem_id, CASE WHEN k IN (0, 1, 4) THEN 'SOLVED' ELSE 'FAILED' END AS status, CASE k WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 3 ELSE 4 END AS attempts,
  CASE k WHEN 2 THEN 'REPAIR_TEST_FAILED' WHEN 3 THEN 'HELD_OUT_TEST_FAILED' WHEN 5 THEN 'COMPILE_FAILED' END AS failure_reason,
  CASE k WHEN 2 THEN 'Repair test failed: repair-0001' || chr(10) || 'Input:' || chr(10) || i || chr(10) || 'Expected:' || chr(10) || s || chr(10) || 'Actual:' || chr(10) || 'no' || chr(10) || 'Stderr:' || chr(10)
    WHEN 3 THEN 'Held-out evaluation failed: 1/1 tests failed; 0 timed out. Test inputs and expected outputs are withheld.' WHEN 5 THEN 'Compilation failed:' || chr(10) || 'The generator gave no program.' END AS diagnostic_summary,
  CASE k WHEN 0 THEN 5 WHEN 1 THEN 8 WHEN 3 THEN 5 WHEN 4 THEN 9 ELSE 13 END AS traces, 'language=python3; time_limit=2s; memory_limit=64MB' AS opening FROM k""",
        "verify_python_oracles": "SELECT 'n' || n_nationkey AS problem_id, CASE n_nationkey % 4 WHEN 0 THEN 'verified' WHEN 1 THEN 'verified' WHEN 2 THEN 'failed_python_solution' ELSE 'no_python_solution' END AS outcome, CASE n_nationkey % 4 WHEN 0 THEN 'true,false' WHEN 1 THEN 'false,true' WHEN 2 THEN 'false,false' ELSE 'false' END AS marks FROM nation",
        "translate_oracles": """WITH k AS (SELECT *, n_nationkey % 4 < 2 AS ok, sum(CASE WHEN n_nationkey % 4 < 2 THEN 1 ELSE 0 END) OVER (ORDER BY n_nationkey) AS nth FROM nation)
SELECT 'n' || n_nationkey AS problem_id, CASE WHEN ok THEN 'translated' ELSE 'no_verified_python' END AS outcome, CASE WHEN ok THEN 3 WHEN n_nationkey % 4 = 2 THEN 2 ELSE 1 END AS solutions, CASE WHEN ok THEN 'print(sum(map(int, input().split())))' ELSE '' END AS reference, ok AND nth <= 5 AS kept FROM k""",
    }
