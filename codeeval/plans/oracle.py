"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

Each statement reads the driver's tables as views and rebuilds the same
stand-in inputs as ``plans.fixtures`` in SQL, then computes the operator's
result independently of Spark.  Column names and types match the Spark
output (integers BIGINT, fractions DOUBLE rounded to 6 places).
"""

from __future__ import annotations

from ..functions import fixed


# ------------------------------------------------------------------ helpers
def lit(s: str) -> str:
    """SQL string literal; newlines become ``chr(10)`` so the text is exact."""
    parts = s.split("\n")
    quoted = ["'" + p.replace("'", "''") + "'" for p in parts]
    return "(" + " || chr(10) || ".join(quoted) + ")"


WS = "(" + "||".join(f"chr({ord(c)})" for c in fixed.PY_WHITESPACE) + ")"


def strip(x: str) -> str:
    return f"trim({x}, {WS})"


def preview(x: str) -> str:
    return f"CASE WHEN length({x}) <= 50 THEN {x} ELSE substr({x}, 1, 47) || '...' END"


def remove_first(x: str, needle: str) -> str:
    n = lit(needle)
    return (f"CASE WHEN strpos({x}, {n}) > 0 THEN substr({x}, 1, strpos({x}, {n}) - 1) || "
            f"substr({x}, strpos({x}, {n}) + {len(needle)}) ELSE {x} END")


def strip_backticks(x: str) -> str:
    return f"CASE WHEN starts_with({x}, '```') THEN {remove_first(f'trim({x}, chr(96))', fixed.SCALA_NEWLINE)} ELSE {x} END"


def clean_code(x: str) -> str:
    s = strip(f"replace({x}, {lit(fixed.END_OF_TEXT)}, '')")
    return (f"CASE WHEN starts_with({s}, '```scala') AND ends_with({s}, '```') "
            f"THEN {strip(f'substr({s}, 9, length({s}) - 11)')} ELSE {s} END")


def transcript_prompt(x: str) -> str:
    e = strip(f"regexp_extract({x}, '(?is){fixed.TRANSCRIPT_PROMPT_PATTERN}', 1)")
    return f"CASE WHEN {e} = '' THEN {lit(fixed.PROMPT_NOT_FOUND)} ELSE {e} END"


def transcript_code(x: str) -> str:
    e = strip(f"regexp_extract({x}, '(?is){fixed.TRANSCRIPT_CODE_PATTERN}', 1)")
    return f"CASE WHEN {e} = '' THEN {lit(fixed.CODE_NOT_FOUND)} ELSE {e} END"


def last_piece(x: str, sep: str) -> str:
    return f"string_split({x}, {sep})[-1]"


def rate(ok: str, total: str) -> str:
    return f"(CASE WHEN {total} > 0 THEN ({ok})::DOUBLE / ({total}) ELSE 0.0 END)"


# ------------------------------------------------------------------ stand-in views
MESSAGES = """messages AS (
  SELECT conv_id, turn,
         CASE lower(role) WHEN 'user' THEN 'human' WHEN 'gpt' THEN 'assistant' WHEN 'human' THEN 'human'
              WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' ELSE lower(role) END AS role,
         text
  FROM conversations)"""

ROLE_PAIRS = MESSAGES + """,
hum AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, text AS prompt
        FROM messages WHERE role = 'human'),
ast AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k, text AS code
        FROM messages WHERE role = 'assistant'),
role_pairs AS (SELECT hum.conv_id, hum.k, hum.prompt, ast.code FROM hum JOIN ast USING (conv_id, k))"""

CONTEXT_PAIRS = ROLE_PAIRS + """,
humc AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS k,
                string_agg('Human: ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prompt
         FROM messages WHERE role = 'human'),
context_pairs AS (SELECT humc.conv_id, humc.k, humc.prompt, ast.code FROM humc JOIN ast USING (conv_id, k))"""

POSITIONAL = MESSAGES + """,
pos_pairs AS (
  SELECT * FROM (
    SELECT conv_id, max(CASE WHEN turn = 0 THEN text END) AS prompt, max(CASE WHEN turn = 1 THEN text END) AS reference
    FROM messages WHERE turn < 2 GROUP BY conv_id)
  WHERE prompt IS NOT NULL AND reference IS NOT NULL)"""

FIRST_OF_ROLE = MESSAGES + """,
first_of_role AS (
  SELECT conv_id, prompt, code FROM (
    SELECT conv_id, count(*) AS n,
           arg_min(text, turn) FILTER (WHERE role = 'human') AS prompt,
           arg_min(text, turn) FILTER (WHERE role = 'assistant') AS code
    FROM messages GROUP BY conv_id)
  WHERE n >= 2 AND prompt IS NOT NULL AND code IS NOT NULL)"""

DOC_SNIPPETS = f"""doc_snippets AS (
  SELECT doc_id, doc_id AS seq, source AS variation_name, lang, doc_id % ni AS prompt_index, doc_id // ni % 5 AS variation_no,
         coalesce(b.text, '') AS prompt, {lit(fixed.BASE_SYSTEM_PROMPT)} AS system_prompt,
         CASE doc_id % 4 WHEN 0 THEN d.text
              WHEN 1 THEN '```scala' || chr(10) || d.text || chr(10) || '```'
              WHEN 2 THEN '```scala' || chr(10) || d.text || chr(10) || '```' || {lit(fixed.END_OF_TEXT)}
              ELSE '```' || d.text END AS response,
         n_chars / 1000.0::DOUBLE AS time_taken, n_chars
  FROM documents d, (SELECT count(*) AS ni FROM benchmark) LEFT JOIN benchmark b ON b.item_id = doc_id % ni)"""

TEXT_PAIRS = """text_pairs AS (
  SELECT doc_id, doc_id // 4 AS conv_id, doc_id % 4 AS k, lang AS prompt, text AS code, sha256(lang || text) AS snippet_hash
  FROM documents)"""

VERDICTS = """verdicts AS (
  SELECT doc_id, toxic = 0 AS build_ok,
         '[error] Main.scala: compilation failed for snippet ' || doc_id || chr(10)
           || '[error] (Compile / compileIncremental) Compilation failed' || chr(10) AS build_message,
         quality = 1 AS run_ok,
         CASE WHEN quality = 1 THEN 'Run completed successfully'
              ELSE '[error] Nonzero exit code returned from runner: 1' || chr(10) || '[error] snippet ' || doc_id || ' failed'
         END AS run_message
  FROM labels)"""


def apply_verdicts(src: str, name: str, code: str = "code") -> str:
    """CTE ``name``: ``src`` rows + executed / success / message (build and run)."""
    blank = f"{strip('s.' + code)} = ''"
    return f"""{name} AS (
  SELECT s.*, ({blank}) OR v.doc_id IS NOT NULL AS executed,
         CASE WHEN {blank} THEN false WHEN v.doc_id IS NOT NULL AND NOT v.build_ok THEN false
              WHEN v.doc_id IS NOT NULL THEN v.run_ok END AS success,
         CASE WHEN {blank} THEN {lit(fixed.NO_CODE_MESSAGE)}
              WHEN v.doc_id IS NOT NULL AND NOT v.build_ok THEN {lit(fixed.BUILD_FAILED_PREFIX)} || v.build_message
              WHEN v.doc_id IS NOT NULL THEN v.run_message END AS message
  FROM {src} s LEFT JOIN verdicts v USING (doc_id))"""


VERDICTED = DOC_SNIPPETS + ",\n" + VERDICTS + f""",
snip AS (SELECT *, {strip_backticks('response')} AS code FROM doc_snippets),
""" + apply_verdicts("snip", "verdicted")


def transcripts(src: str, name: str) -> str:
    return f"""{name} AS (
  SELECT *, CASE conv_id % 4
      WHEN 0 THEN 'user' || chr(10) || chr(10) || prompt || chr(10) || 'assistant' || chr(10) || chr(10) || code
      WHEN 1 THEN 'USER ' || chr(10) || chr(10) || prompt || ' ASSISTANT' || chr(10) || chr(10) || code || {lit(fixed.END_OF_TEXT)}
      WHEN 2 THEN 'assistant' || chr(10) || chr(10) || code
      ELSE code END AS generated
  FROM {src})"""


# Word rules of BLEU for RE2, which has no look-around: what a rule must not consume
# is matched and put back, and such rules run twice, for matches that touch.
_WORD, _OTHER, _SPACES = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]", r"[\x09-\x0D\x1C-\x20\x{85}\p{Z}]"
_SPLIT = [(a, b) for a, b in (("can", "not"), ("d", "'ye"), ("gim", "me"), ("gon", "na"), ("got", "ta"), ("lem", "me"),
                              ("more", "'n"))]
TOKEN_STEPS = [
    (r"([«“‘„]|`+)", r" \1 "),
    (r'\A"', "``"),
    (r"(``)", r" \1 "),
    (r"""([ (\[{<])("|'{2})""", r"\1 `` "),
    # a quote before a single letter, but not before these
    (r"'([mtsdnMTSDN\x{17F}])", "\x01\\1"),
    *[(rf"'({_WORD})({_OTHER}|\z)", r"' \1\2")] * 2,
    ("\x01", "'"),
    (rf"""([^.])(\.)([\])}}>"'»”’ ]*){_SPACES}*\z""", r"\1 \2 \3 "),
    (r"([:,])(\P{Nd})", r" \1 \2"),
    (r"([:,])\z", r" \1 "),
    (r"(\.{2,})", r" \1 "),
    (r"([;@#$%&])", r" \1 "),
    (rf"""([^.])(\.)([\])}}>"']*){_SPACES}*\z""", r"\1 \2\3 "),
    (r"([?!])", r" \1 "),
    (r"([^'])' ", r"\1 ' "),
    (r"(\*)", r" \1 "),
    (r"([\]\[(){}<>])", r" \1 "),
    (r"--", " -- "),
    (r"\A", " "), (r"\z", " "),
    (r"([»”’])", r" \1 "),
    (r"''", " '' "),
    (r'"', " '' "),
    (r"([^' ])('[sS]|'[mM]|'[dD]|') ", r"\1 \2 "),
    (r"([^' ])('ll|'LL|'re|'RE|'ve|'VE|n't|N'T) ", r"\1 \2 "),
    *[x for a, b in _SPLIT for x in [(rf"(?i)(\A|{_OTHER})({a})({b})({_OTHER}|\z)", r"\1 \2 \3 \4")] * 2],
    *[(rf"(?i)(\A|{_OTHER})(wan)(na)({_SPACES})", r"\1 \2 \3 \4")] * 2,
    *[(rf"(?i) ('t)(is)({_OTHER}|\z)", r" \1 \2 \3")] * 2,
    *[(rf"(?i) ('t)(was)({_OTHER}|\z)", r" \1 \2 \3")] * 2,
]


def word_tokens(x: str) -> str:
    quoted = lambda p: "'" + p.replace("'", "''") + "'"
    x = f"coalesce({x}, '')"
    for pattern, replacement in TOKEN_STEPS:
        x = f"regexp_replace({x}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
    return f"regexp_extract_all({x}, '[^\\x09-\\x0D\\x1C-\\x20\\x{{85}}\\p{{Z}}]+')"


def gram_expr(k: int) -> str:
    """The k-token n-gram starting at the current token (NULL past the end)."""
    return " || chr(1) || ".join(["w"] + [f"lead(w, {j}) OVER x" for j in range(1, k)])


def bleu_ctes(src: str, ids: list[str], ref: str, hyp: str, name: str) -> str:
    """CTEs ending in ``name(ids..., bleu)`` (unrounded).  Word n-grams are
    built with ``lead`` over the unnested tokens."""
    idl = ", ".join(ids)
    n = fixed.BLEU_MAX_ORDER
    ms = ", ".join(f"sum(CASE WHEN n = {k} THEN least(ch, cr) ELSE 0 END) AS m{k}" for k in range(1, n + 1))
    mc = ", ".join(f"coalesce(m.m{k}, 0) AS m{k}" for k in range(1, n + 1))
    terms, ps = [], []
    for k in range(1, n + 1):
        j = "1" + "".join(f" + (CASE WHEN m{i} = 0 THEN 1 ELSE 0 END)" for i in range(1, k))
        den = f"greatest(hl - {k - 1}, 1)::DOUBLE"
        p = (f"(CASE WHEN m{k} > 0 THEN m{k}::DOUBLE / {den} "
             f"WHEN hl > 1 THEN (1.0 / (pow(2.0, {j}) * {fixed.BLEU_SMOOTHING_K} / ln(hl::DOUBLE))) / {den} "
             f"ELSE 0.0 END)")
        ps.append(f"{p} AS p{k}")
        terms.append(f"(CASE WHEN p{k} > 0 THEN {1.0 / n} * ln(p{k}) ELSE 0.0 END)")
    return f"""{name}_t AS (
  SELECT {idl}, {word_tokens(ref)} AS rt, {word_tokens(hyp)} AS ht FROM {src}),
{name}_tok AS (
  SELECT {idl}, 1 AS h, unnest(ht) AS w, generate_subscripts(ht, 1) AS i FROM {name}_t
  UNION ALL
  SELECT {idl}, 0 AS h, unnest(rt) AS w, generate_subscripts(rt, 1) AS i FROM {name}_t),
{name}_w AS (
  SELECT {idl}, h, {", ".join(f"{gram_expr(k)} AS g{k}" for k in range(1, n + 1))}
  FROM {name}_tok WINDOW x AS (PARTITION BY {idl}, h ORDER BY i)),
{name}_g AS (
  {" UNION ALL ".join(f"SELECT {idl}, {k} AS n, g{k} AS g, h, 1 - h AS r FROM {name}_w WHERE g{k} IS NOT NULL" for k in range(1, n + 1))}),
{name}_c AS (SELECT {idl}, n, g, sum(h) AS ch, sum(r) AS cr FROM {name}_g GROUP BY {idl}, n, g),
{name}_m AS (SELECT {idl}, {ms} FROM {name}_c GROUP BY {idl}),
{name}_s AS (SELECT {", ".join("t." + i for i in ids)}, len(t.ht) AS hl, len(t.rt) AS rl, {mc}
             FROM {name}_t t LEFT JOIN {name}_m m USING ({idl})),
{name}_p AS (SELECT *, {", ".join(ps)} FROM {name}_s),
{name} AS (
  SELECT {idl}, CASE WHEN hl = 0 OR m1 = 0 THEN 0.0
         ELSE (CASE WHEN hl > rl THEN 1.0 ELSE exp(1.0 - rl::DOUBLE / hl::DOUBLE) END)
              * exp({" + ".join(terms)}) END AS bleu
  FROM {name}_p)"""


def chrf_ctes(src: str, ids: list[str], ref: str, hyp: str, name: str) -> str:
    """CTEs ending in ``name(ids..., chrf)`` (unrounded)."""
    idl = ", ".join(ids)
    n = fixed.CHRF_CHAR_ORDER
    ms = ", ".join(f"sum(CASE WHEN n = {k} THEN least(ch, cr) ELSE 0 END) AS m{k}" for k in range(1, n + 1))
    mc = ", ".join(f"coalesce(m.m{k}, 0) AS m{k}" for k in range(1, n + 1))
    sp, sr, eff = "0.0", "0.0", "0"
    for k in range(1, n + 1):
        nh, nr = f"greatest(hl - {k - 1}, 0)", f"greatest(rl - {k - 1}, 0)"
        both = f"({nh} > 0 AND {nr} > 0)"
        sp = f"({sp} + CASE WHEN {both} THEN m{k}::DOUBLE / {nh} ELSE 0.0 END)"
        sr = f"({sr} + CASE WHEN {both} THEN m{k}::DOUBLE / {nr} ELSE 0.0 END)"
        eff = f"({eff} + CASE WHEN {both} THEN 1 ELSE 0 END)"
    f = fixed.CHRF_BETA ** 2
    return f"""{name}_t AS (
  SELECT {idl}, translate(coalesce({ref}, ''), {WS}, '') AS rs, translate(coalesce({hyp}, ''), {WS}, '') AS hs
  FROM {src}),
{name}_hp AS (SELECT {idl}, hs, unnest(range(1, length(hs) + 1)) AS i FROM {name}_t),
{name}_rp AS (SELECT {idl}, rs, unnest(range(1, length(rs) + 1)) AS i FROM {name}_t),
{name}_on AS (SELECT unnest(range(1, {n + 1})) AS n),
{name}_g AS (
  SELECT {idl}, o.n, substr(hs, i, o.n) AS g, 1 AS h, 0 AS r FROM {name}_hp, {name}_on o WHERE i + o.n - 1 <= length(hs)
  UNION ALL
  SELECT {idl}, o.n, substr(rs, i, o.n) AS g, 0 AS h, 1 AS r FROM {name}_rp, {name}_on o WHERE i + o.n - 1 <= length(rs)),
{name}_c AS (SELECT {idl}, n, g, sum(h) AS ch, sum(r) AS cr FROM {name}_g GROUP BY {idl}, n, g),
{name}_m AS (SELECT {idl}, {ms} FROM {name}_c GROUP BY {idl}),
{name}_s AS (SELECT {", ".join("t." + i for i in ids)}, length(t.hs) AS hl, length(t.rs) AS rl, {mc}
             FROM {name}_t t LEFT JOIN {name}_m m USING ({idl})),
{name}_a AS (SELECT {idl}, {sp} AS sp, {sr} AS sr, {eff} AS eff FROM {name}_s),
{name}_pr AS (SELECT {idl}, CASE WHEN eff > 0 THEN sp / eff ELSE 0.0 END AS p,
                     CASE WHEN eff > 0 THEN sr / eff ELSE 0.0 END AS r FROM {name}_a),
{name} AS (SELECT {idl}, CASE WHEN p + r > 0 THEN (1 + {f}) * p * r / ({f} * p + r) ELSE 0.0 END AS chrf
           FROM {name}_pr)"""


EVAL_RESULTS = VERDICTED + ",\n" + bleu_ctes("verdicted", ["doc_id"], "prompt", "code", "eb") + """,
er AS (SELECT v.doc_id, v.seq, v.prompt, v.variation_name, eb.bleu,
              coalesce(v.success, false)::BIGINT AS successful_runs, v.executed::BIGINT AS total_runs
       FROM verdicted v JOIN eb USING (doc_id))"""

_RANK = "CASE lang WHEN 'en' THEN 64 WHEN 'de' THEN 32 WHEN 'fr' THEN 16 ELSE 8 END"

REGISTRY = VERDICTS + ",\n" + ROLE_PAIRS + ",\n" + transcripts("role_pairs", "tr") + f""",
ro AS (SELECT tr.*, conv_id AS doc_id, source || '/' || lang AS run_id FROM tr JOIN documents d ON d.doc_id = tr.conv_id),
rs AS (SELECT run_id, doc_id, conv_id, k, {clean_code(transcript_code('generated'))} AS code FROM ro),
{apply_verdicts("rs", "rv")},
{bleu_ctes("ro", ["run_id", "conv_id", "k"], "code", "generated", "rbl")},
ex AS (SELECT run_id, sum(coalesce(success, false)::BIGINT) AS successful_runs, count(*) AS total_snippets
       FROM rv GROUP BY run_id),
rb AS (SELECT run_id, avg(bleu) AS avg_bleu FROM rbl GROUP BY run_id),
rc AS (SELECT source || '/' || lang AS run_id, min(doc_id) AS seq, source, lang,
              CASE WHEN lang = 'es' THEN 'base' ELSE 'finetuned' END AS model_type,
              2 AS batch_size, 1 + CAST(substr(source, 4, 10) AS INTEGER) % 3 AS num_train_epochs, -1 AS max_steps,
              50 * (1 + CAST(substr(source, 4, 10) AS INTEGER) % 5) AS train_dataset_size, 17 AS test_dataset_size,
              {_RANK} AS lora_rank, {_RANK} * 2 AS lora_alpha
       FROM documents GROUP BY source, lang),
reg AS (
  SELECT rc.run_id, rc.seq,
         CASE WHEN model_type = 'finetuned' THEN
           sha256('batch_size=' || batch_size || '-lr=0.0002-epochs=' || num_train_epochs || '-max_steps=' || max_steps
                  || '-train_size=' || train_dataset_size || '-test_size=' || test_dataset_size
                  || '-lora_rank=' || lora_rank || '-lora_alpha=' || lora_alpha || '-lora_dropout=0')
         ELSE sha256('base_model-train_size=' || train_dataset_size || '-test_size=' || test_dataset_size) END AS model_hash,
         model_type, lora_rank, lora_alpha, train_dataset_size, test_dataset_size,
         coalesce(rb.avg_bleu, 0.0) AS avg_bleu,
         coalesce(ex.successful_runs, 0)::BIGINT AS successful_runs, coalesce(ex.total_snippets, 0)::BIGINT AS total_snippets,
         {rate('coalesce(ex.successful_runs, 0)', 'coalesce(ex.total_snippets, 0)')} AS success_rate
  FROM rc LEFT JOIN ex USING (run_id) LEFT JOIN rb USING (run_id))"""

MAIN_NEW = """main_messages AS (
  SELECT doc_id AS conv_id, 0::BIGINT AS turn, 'human' AS role, concat_ws('/', source, lang, n_chars) AS text
  FROM documents WHERE doc_id % 2 = 0
  UNION ALL
  SELECT doc_id AS conv_id, 1::BIGINT AS turn, 'assistant' AS role, text FROM documents WHERE doc_id % 2 = 0),
new_pairs AS (SELECT doc_id // 4 AS conv_id, doc_id % 4 AS k, concat_ws('/', source, lang, n_chars) AS prompt, text AS code, doc_id
              FROM documents WHERE doc_id % 2 = 1),
main_values AS (SELECT DISTINCT text AS v FROM main_messages WHERE text IS NOT NULL)"""


def nondup(src: str, name: str) -> str:
    return f"""{name} AS (SELECT * FROM {src} p
           WHERE NOT EXISTS (SELECT 1 FROM main_values m WHERE m.v = p.prompt)
             AND NOT EXISTS (SELECT 1 FROM main_values m WHERE m.v = p.code))"""


HISTORY = """hist AS (
  SELECT user_id AS run_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS step, value AS loss
  FROM events WHERE value IS NOT NULL)"""


def _instruction_parts():
    head, rest = fixed.INSTRUCTION_TEMPLATE.split("{instruction}")
    mid, tail = rest.split("{response}")
    return head.replace("{system}", fixed.INSTRUCTION_SYSTEM_PROMPT), mid.replace("{input}", ""), tail


def _segment(role: str, text: str) -> str:
    return (f"{lit(fixed.CHAT_HEADER_START)} || CASE WHEN {role} = 'human' THEN 'user' ELSE {role} END || "
            f"{lit(fixed.CHAT_HEADER_END)} || coalesce({text}, '') || {lit(fixed.CHAT_TURN_END)}")


def _header(role: str) -> str:
    return (f"{lit(fixed.CHAT_HEADER_START)} || CASE WHEN {role} = 'human' THEN 'user' ELSE {role} END || "
            f"{lit(fixed.CHAT_HEADER_END)}")


def _templates_values() -> str:
    rows = [f"({i}, {lit(name)}, {lit(tpl)})" for i, (name, tpl) in enumerate(fixed.VARIATION_TEMPLATES)]
    return "(VALUES " + ", ".join(rows) + ") AS tpl(variation_no, variation_name, template)"


PROMPT_EVALUATION = VERDICTED + f""",
ans AS (SELECT v.*, replace(template, '{fixed.BASE_PLACEHOLDER}', b.text) AS variant_prompt, tpl.variation_name AS variation
        FROM verdicted v JOIN benchmark b ON b.item_id = v.prompt_index JOIN {_templates_values()} ON tpl.variation_no = v.variation_no),
{bleu_ctes("ans", ["doc_id"], "variant_prompt", "code", "ab")},
pe AS (SELECT seq, lang AS model, prompt_index, variation AS variation_name, bleu,
              coalesce(success, false)::BIGINT AS successful_runs, executed::BIGINT AS total_runs
       FROM ans JOIN ab USING (doc_id))"""


# ------------------------------------------------------------------ the statements
def oracle_sql() -> dict[str, str]:
    head, mid, tail = _instruction_parts()
    q: dict[str, str] = {}

    # sources / sinks
    q["ingest_conversations"] = """SELECT (dense_rank() OVER (ORDER BY conv_id) - 1)::BIGINT AS conv_id, turn, role, text
FROM conversations"""
    q["ingest_eval_results"] = f"WITH {ROLE_PAIRS}, {transcripts('role_pairs', 'tr')}\n" \
        f"SELECT dense_rank() OVER (ORDER BY conv_id) - 1 AS doc_no, k AS idx, code AS reference, {transcript_prompt('generated')} AS prompt, " \
        f"{transcript_code('generated')} AS code FROM tr"
    q["generation_log"] = f"WITH {DOC_SNIPPETS}\nSELECT variation_name, prompt, system_prompt, response, round(time_taken, 6) AS time_taken FROM doc_snippets"
    numbered = "numbered AS (SELECT row_number() OVER (ORDER BY conv_id, k) AS idx, prompt, code FROM role_pairs)"
    q["pairs_long_form"] = f"""WITH {ROLE_PAIRS}, {numbered}
SELECT idx, 'prompt' AS kind, prompt AS content FROM numbered
UNION ALL SELECT idx, 'code' AS kind, code AS content FROM numbered"""
    q["pair_folder_join"] = f"""WITH {ROLE_PAIRS}, {numbered}
SELECT idx, coalesce(prompt, '') AS prompt, coalesce(code, '') AS code FROM numbered
WHERE coalesce(prompt, '') <> '' OR coalesce(code, '') <> ''"""
    as_read = lambda c: strip(f"replace(replace(coalesce({c}, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10))")
    q["pair_folder_files"] = f"""WITH {ROLE_PAIRS}, {numbered}
SELECT idx, {as_read('prompt')} AS prompt, {as_read('code')} AS code FROM numbered
WHERE {as_read('prompt')} <> '' OR {as_read('code')} <> ''"""
    q["registry_scan"] = f"""WITH {REGISTRY}
SELECT model_hash, seq, model_type, train_dataset_size, round(avg_bleu, 6) AS avg_bleu, successful_runs, total_snippets
FROM reg"""
    q["registry_scan_array"] = f"""WITH {REGISTRY}
SELECT model_hash, row_number() OVER (ORDER BY seq) - 1 AS seq, model_type, train_dataset_size, round(avg_bleu, 6) AS avg_bleu FROM reg"""
    q["ingest_conversations_array"] = q["conversations_array_file"] = q["ingest_conversations"]
    q["eval_document_roundtrip"] = f"""WITH {ROLE_PAIRS}, {transcripts('role_pairs', 'tr')},
{bleu_ctes('tr', ['conv_id', 'k'], 'code', 'generated', 'bl')}
SELECT 265 AS training_dataset_size, code AS reference, {transcript_prompt('generated')} AS prompt,
       {transcript_code('generated')} AS code, round(bleu, 6) AS bleu FROM tr JOIN bl USING (conv_id, k)"""
    q["rebuild_conversations"] = """SELECT conv_id, count(*) AS n_messages,
       CAST(to_json(list({'from': role, 'value': text} ORDER BY turn)) AS VARCHAR) AS conversations_json
FROM conversations GROUP BY conv_id"""
    q["report_lines"] = f"""WITH {EVAL_RESULTS},
per AS (SELECT variation_name, min(seq) AS f, avg(bleu) AS b, sum(successful_runs) AS ok, sum(total_runs) AS tot
        FROM er GROUP BY variation_name),
ranked AS (SELECT *, row_number() OVER (ORDER BY f) AS rk FROM per),
tot AS (SELECT coalesce(sum(successful_runs), 0) AS ok, coalesce(sum(total_runs), 0) AS tot FROM er)
SELECT 0::BIGINT AS line_no, '# Evaluation Final Report' AS line
UNION ALL SELECT 1, ''
UNION ALL SELECT 2, '## Summary'
UNION ALL SELECT 3, 'Total running code snippets: ' || ok || '/' || tot FROM tot
UNION ALL SELECT 4, ''
UNION ALL SELECT 5, '## Results by Variation Type'
UNION ALL SELECT 6, ''
UNION ALL SELECT 7 + (rk - 1) * 4, '### ' || variation_name FROM ranked
UNION ALL SELECT 8 + (rk - 1) * 4, '- Average BLEU Score: ' || printf('%.4f', b) FROM ranked
UNION ALL SELECT 9 + (rk - 1) * 4, '- Success Rate: ' || printf('%.2f', {rate('ok', 'tot')} * 100) || '% (' || ok || '/' || tot || ' snippets)' FROM ranked
UNION ALL SELECT 10 + (rk - 1) * 4, '' FROM ranked"""

    # pairing
    q["flatten_messages"] = "SELECT conv_id, turn, role, text FROM conversations"
    q["pair_positional"] = f"WITH {POSITIONAL}\nSELECT conv_id, prompt, reference FROM pos_pairs"
    q["pair_role_zip"] = f"WITH {ROLE_PAIRS}\nSELECT conv_id, k, prompt, code FROM role_pairs"
    q["pair_role_zip_context"] = f"WITH {CONTEXT_PAIRS}\nSELECT conv_id, k, prompt, code FROM context_pairs"
    q["pair_first_of_role"] = f"WITH {FIRST_OF_ROLE}\nSELECT conv_id, prompt, code FROM first_of_role"
    q["multi_snippet_profile"] = f"""WITH {CONTEXT_PAIRS},
nc AS (SELECT conv_id, count(*) AS n_snippets FROM messages WHERE role = 'assistant' GROUP BY conv_id)
SELECT conv_id, k, n_snippets, n_snippets > 1 AS is_multi, {last_piece('prompt', lit(fixed.HUMAN_PREFIX))} AS last_prompt
FROM context_pairs JOIN nc USING (conv_id)"""
    q["test_prompts"] = f"WITH {MESSAGES}\nSELECT conv_id, text AS prompt FROM messages WHERE turn = 0"
    q["validate_pairs"] = f"""WITH {ROLE_PAIRS}
SELECT conv_id, k, {strip('prompt')} AS prompt, {strip('code')} AS code FROM role_pairs
WHERE {strip('prompt')} <> '' AND {strip('code')} <> ''"""
    q["keyword_search"] = f"""WITH {POSITIONAL}
SELECT conv_id, {preview('prompt')} AS preview FROM pos_pairs
WHERE contains(lower(prompt), 'the') OR contains(lower(reference), 'the')"""
    q["keyword_search_terms"] = f"""WITH {POSITIONAL},
raw AS (SELECT unnest([split_part(text, ' ', 1), text[1:2], text[1:1]]) AS t FROM benchmark),
terms AS (SELECT DISTINCT lower({strip('t')}) AS term FROM raw WHERE {strip('t')} <> '')
SELECT term, conv_id, {preview('prompt')} AS preview FROM pos_pairs, terms
WHERE contains(lower(prompt), term) OR contains(lower(reference), term)"""
    q["preview_text"] = f"WITH {MESSAGES}\nSELECT conv_id, {preview('text')} AS preview FROM messages WHERE turn = 0"
    q["batch_edits"] = f"""WITH {POSITIONAL},
dels AS (SELECT DISTINCT conv_id FROM messages WHERE turn = 0 AND role = 'system'),
kept AS (SELECT conv_id, turn, role, text FROM messages WHERE conv_id NOT IN (SELECT conv_id FROM dels)),
upd AS (SELECT conv_id, {strip("prompt || ' (edited)'")} AS prompt, {strip('reference')} AS response FROM pos_pairs
        WHERE length(prompt) < 40 AND {strip("prompt || ' (edited)'")} <> '' AND {strip('reference')} <> ''
          AND conv_id IN (SELECT conv_id FROM kept)),
adds AS (SELECT page_id AS edit_seq, {strip('url')} AS prompt, {strip('html')} AS response FROM pages
         WHERE {strip('url')} <> '' AND {strip('html')} <> ''),
top AS (SELECT coalesce(max(conv_id), -1) AS top FROM messages),
added AS (SELECT top + row_number() OVER (ORDER BY edit_seq) AS conv_id, prompt, response FROM adds, top)
SELECT conv_id, turn, role, text FROM kept WHERE conv_id NOT IN (SELECT conv_id FROM upd)
UNION ALL SELECT conv_id, 0::BIGINT, 'human', prompt FROM upd
UNION ALL SELECT conv_id, 1::BIGINT, 'assistant', response FROM upd
UNION ALL SELECT conv_id, 0::BIGINT, 'human', prompt FROM added
UNION ALL SELECT conv_id, 1::BIGINT, 'assistant', response FROM added"""
    q["trim_first_n"] = f"""WITH {MESSAGES}
SELECT conv_id, turn, role, text FROM messages
WHERE conv_id IN (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM messages ORDER BY conv_id LIMIT 15))"""

    # cleaning
    q["extract_transcript"] = f"""WITH {ROLE_PAIRS}, {transcripts('role_pairs', 'tr')}
SELECT conv_id, k, {transcript_prompt('generated')} AS prompt, {transcript_code('generated')} AS code FROM tr"""
    q["clean_code"] = f"WITH {DOC_SNIPPETS}\nSELECT doc_id, {clean_code('response')} AS code FROM doc_snippets"
    q["strip_backticks"] = f"WITH {DOC_SNIPPETS}\nSELECT doc_id, {strip_backticks('response')} AS code FROM doc_snippets"
    gen = f"{lit(head)} || prompt || {lit(mid)} || {lit(tail)} || reference || {lit(fixed.END_OF_TEXT)}"
    q["after_marker"] = f"""WITH {POSITIONAL}
SELECT conv_id, {strip(last_piece(gen, lit(fixed.RESPONSE_MARKER)))} AS code FROM pos_pairs"""
    q["unescape_code"] = f"""WITH {ROLE_PAIRS},
mini AS (SELECT conv_id, k, replace(replace(code, chr(10), '\\n'), chr(9), '\\t') AS minified FROM role_pairs)
SELECT conv_id, k, replace(replace(minified, '\\n', chr(10)), '\\t', chr(9)) AS code FROM mini"""
    q["snippet_hash"] = f"WITH {CONTEXT_PAIRS}\nSELECT conv_id, k, sha256(prompt || code) AS snippet_hash FROM context_pairs"
    q["chat_template_text"] = f"""WITH {MESSAGES}
SELECT conv_id, {lit(fixed.CHAT_BEGIN)} || string_agg({_segment('role', 'text')}, '' ORDER BY turn) AS text
FROM messages GROUP BY conv_id"""
    q["response_spans"] = f"""WITH {MESSAGES},
seg AS (SELECT conv_id, turn, role, length({_segment('role', 'text')}) AS l, length({_header('role')}) AS hl FROM messages),
pos AS (SELECT *, coalesce(sum(l) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
                  + {len(fixed.CHAT_BEGIN)} AS before FROM seg)
SELECT conv_id, turn, (before + hl)::BIGINT AS span_start, (before + l)::BIGINT AS span_end FROM pos WHERE role = 'assistant'"""
    q["instruction_text"] = f"""WITH {FIRST_OF_ROLE}
SELECT conv_id, {lit(head)} || prompt || {lit(mid)} || code || {lit(tail)} || {lit(fixed.END_OF_TEXT)} AS text FROM first_of_role"""
    q["run_label"] = f"""WITH {REGISTRY}
SELECT run_id, 'llama3.2-r=' || lora_rank || '-alpha=' || lora_alpha || '-training_size=' || train_dataset_size AS run_label,
       'after_finetuning_trainsize' || train_dataset_size AS result_prefix FROM reg"""

    # dedup / joins
    q["ledger_runs"] = f"""WITH {TEXT_PAIRS}
SELECT conv_id, k, snippet_hash FROM (SELECT *, row_number() OVER (PARTITION BY snippet_hash ORDER BY conv_id % 2, conv_id, k) AS rn
                                      FROM text_pairs) WHERE rn = 1"""
    q["dedup_ledger"] = f"""WITH {TEXT_PAIRS},
hp AS (SELECT conv_id, k, snippet_hash FROM text_pairs),
ledger AS (SELECT snippet_hash FROM hp WHERE k = 0),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY snippet_hash ORDER BY conv_id, k) AS rn FROM hp) WHERE rn = 1)
SELECT conv_id, k, snippet_hash FROM firsts WHERE snippet_hash NOT IN (SELECT snippet_hash FROM ledger)"""
    q["dedup_stream"] = f"""WITH {TEXT_PAIRS}
SELECT conv_id, k, snippet_hash FROM (SELECT *, row_number() OVER (PARTITION BY snippet_hash ORDER BY conv_id % 2, conv_id, k) AS rn
                                      FROM text_pairs) WHERE rn = 1
AND snippet_hash NOT IN (SELECT snippet_hash FROM text_pairs WHERE k = 0)"""
    q["ledger_from_state"] = f"WITH {TEXT_PAIRS}\nSELECT DISTINCT snippet_hash FROM text_pairs"
    q["dedup_against_main"] = f"WITH {MAIN_NEW}, {nondup('new_pairs', 'nd')}\nSELECT conv_id, k, prompt, code FROM nd"
    q["append_working"] = f"""WITH {VERDICTS}, {MAIN_NEW},
{apply_verdicts('new_pairs', 'nv')},
passing AS (SELECT conv_id, k, prompt, code FROM nv WHERE success),
{nondup('passing', 'nd')},
top AS (SELECT max(conv_id) AS top FROM main_messages),
appended AS (SELECT top + row_number() OVER (ORDER BY conv_id, k) AS conv_id, prompt, code FROM nd, top WHERE top IS NOT NULL)
SELECT conv_id, turn, role, text FROM main_messages
UNION ALL SELECT conv_id, 0::BIGINT, 'human', prompt FROM appended
UNION ALL SELECT conv_id, 1::BIGINT, 'assistant', code FROM appended"""
    q["prompt_variations"] = f"""SELECT item_id AS prompt_index, variation_no, variation_name,
       replace(template, '{fixed.BASE_PLACEHOLDER}', text) AS variant_prompt, {lit(fixed.BASE_SYSTEM_PROMPT)} AS system_prompt
FROM benchmark, {_templates_values()}"""
    q["base_prompts"] = f"""SELECT item_id AS prompt_index, CAST(NULL AS VARCHAR) AS variation_name, text AS variant_prompt,
       {lit(fixed.BASE_SYSTEM_PROMPT)} AS system_prompt FROM benchmark"""
    q["apply_verdicts"] = f"WITH {VERDICTED}\nSELECT doc_id, executed, success, message FROM verdicted"

    # scoring
    q["bleu_pairs"] = f"""WITH {ROLE_PAIRS}, {transcripts('role_pairs', 'tr')},
{bleu_ctes('tr', ['conv_id', 'k'], 'code', 'generated', 'bl')}
SELECT conv_id, k, round(bleu, 6) AS bleu FROM bl"""
    q["chrf_pairs"] = f"""WITH {ROLE_PAIRS}, {transcripts('role_pairs', 'tr')},
{chrf_ctes('tr', ['conv_id', 'k'], 'code', 'generated', 'cf')}
SELECT conv_id, k, round(chrf, 6) AS chrf FROM cf"""
    q["bleu_average"] = f"""WITH {ROLE_PAIRS}, {transcripts('role_pairs', 'tr')},
{bleu_ctes('tr', ['conv_id', 'k'], 'code', 'generated', 'bl')}
SELECT count(*) AS n_pairs, round(coalesce(avg(bleu), 0.0), 6) AS avg_bleu FROM bl"""
    q["bleu_prompt_as_reference"] = f"""WITH {DOC_SNIPPETS},
snip AS (SELECT doc_id, prompt, {strip_backticks('response')} AS code FROM doc_snippets),
{bleu_ctes('snip', ['doc_id'], 'prompt', 'code', 'bl')}
SELECT doc_id, round(bleu, 6) AS bleu FROM bl"""

    # rollups
    q["execution_rate"] = f"""WITH {TEXT_PAIRS}, {VERDICTS},
s AS (SELECT doc_id, conv_id, k, prompt, code, snippet_hash AS h FROM text_pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY h ORDER BY conv_id, k) AS rn FROM s),
kept AS (SELECT * FROM ranked WHERE rn = 1),
{apply_verdicts('kept', 'kv')},
allrows AS (SELECT conv_id, coalesce(success, false)::BIGINT AS ok, executed::BIGINT AS ex FROM kv
            UNION ALL SELECT conv_id, 0, 0 FROM ranked WHERE rn > 1)
SELECT sum(ok)::BIGINT AS successful_runs, count(*) AS total_snippets, sum(ex)::BIGINT AS executed_snippets,
       count(DISTINCT conv_id) AS conversations, round({rate('sum(ok)', 'count(*)')}, 6) AS success_rate FROM allrows"""
    q["failing_snippets"] = f"""WITH {VERDICTED}
SELECT doc_id AS idx, prompt, code, message AS error_output,
       CASE WHEN message IS NULL OR message = '' THEN {lit(fixed.UNKNOWN_ERROR)} ELSE {last_piece('message', 'chr(10)')} END AS error_cause,
       {last_piece(strip("coalesce(message, '')"), 'chr(10)')} AS error_cause_stripped
FROM verdicted WHERE success = false"""
    q["failing_snippets_file"] = "SELECT idx, prompt, code, error_output, error_cause FROM (" + q["failing_snippets"] + ")"
    q["prompt_evaluation"] = f"""WITH {PROMPT_EVALUATION},
per AS (SELECT model, prompt_index, variation_name, arg_min(bleu, seq) AS bleu_first,
               arg_max(successful_runs, seq) AS successful_runs_last, arg_max(total_runs, seq) AS total_runs_last,
               sum(successful_runs) AS ok, sum(total_runs) AS tot FROM pe GROUP BY ALL)
SELECT model, prompt_index, variation_name, round(bleu_first, 6) AS bleu_first, successful_runs_last, total_runs_last,
       (sum(ok) OVER p)::BIGINT AS prompt_successful_runs, (sum(tot) OVER p)::BIGINT AS prompt_total_snippets,
       round({rate('successful_runs_last', 'total_runs_last')} * 100, 6) AS success_rate_pct
FROM per WINDOW p AS (PARTITION BY model, prompt_index)"""
    q["model_rollup"] = f"""WITH {PROMPT_EVALUATION}
SELECT model, variation_name, grouping(variation_name) = 1 AS is_total, count(*) AS n_results, round(avg(bleu), 6) AS avg_bleu,
       sum(successful_runs)::BIGINT AS successful_runs, sum(total_runs)::BIGINT AS total_runs,
       round({rate('sum(successful_runs)', 'sum(total_runs)')} * 100, 6) AS success_rate_pct
FROM pe GROUP BY GROUPING SETS ((model, variation_name), (model))"""
    q["variation_rollup"] = f"""WITH {EVAL_RESULTS}
SELECT variation_name, grouping(variation_name) = 1 AS is_total, count(*) AS n_results, round(avg(bleu), 6) AS avg_bleu,
       sum(successful_runs)::BIGINT AS successful_runs, sum(total_runs)::BIGINT AS total_runs,
       round({rate('sum(successful_runs)', 'sum(total_runs)')} * 100, 6) AS success_rate_pct
FROM er GROUP BY ROLLUP (variation_name)"""
    q["prompt_variation_summary"] = f"""WITH {EVAL_RESULTS},
per AS (SELECT prompt, variation_name, arg_min(bleu, seq) AS bleu_first, arg_max(successful_runs, seq) AS successful_runs_last,
               arg_max(total_runs, seq) AS total_runs_last FROM er GROUP BY prompt, variation_name),
tot AS (SELECT prompt, sum(successful_runs)::BIGINT AS prompt_successful_runs, sum(total_runs)::BIGINT AS prompt_total_snippets
        FROM er GROUP BY prompt)
SELECT prompt, variation_name, round(bleu_first, 6) AS bleu_first, successful_runs_last, total_runs_last,
       prompt_successful_runs, prompt_total_snippets,
       round({rate('successful_runs_last', 'total_runs_last')} * 100, 6) AS success_rate_pct
FROM per JOIN tot USING (prompt)"""
    q["dataset_size"] = f"WITH {MESSAGES}\nSELECT count(DISTINCT conv_id) AS n_conversations FROM messages"
    q["size_statistics"] = f"""WITH {REGISTRY}
SELECT train_dataset_size, count(*) AS num_models, round(max(success_rate), 6) AS max_rate,
       round(avg(success_rate), 6) AS avg_rate, round(min(success_rate), 6) AS min_rate
FROM reg GROUP BY train_dataset_size"""
    q["best_series_by_size"] = f"""WITH {REGISTRY}
SELECT train_dataset_size, round(max(avg_bleu), 6) AS best_bleu, round(max(success_rate), 6) AS best_rate
FROM reg GROUP BY train_dataset_size"""
    q["best_run_per_size"] = f"""WITH {REGISTRY},
ranked AS (SELECT *, row_number() OVER (PARTITION BY train_dataset_size ORDER BY success_rate DESC, avg_bleu DESC, seq) AS rn,
                  count(*) OVER (PARTITION BY train_dataset_size) AS num_models FROM reg)
SELECT train_dataset_size, model_hash, seq, round(success_rate, 6) AS success_rate, round(avg_bleu, 6) AS avg_bleu, num_models
FROM ranked WHERE rn = 1"""
    q["performance_trend"] = f"""WITH {REGISTRY},
per AS (SELECT train_dataset_size, max(success_rate) AS best_rate, min(seq) AS first_seq FROM reg GROUP BY train_dataset_size),
best AS (SELECT train_dataset_size AS best_size FROM per ORDER BY best_rate DESC, first_seq LIMIT 1),
lagged AS (SELECT *, lag(train_dataset_size) OVER (ORDER BY train_dataset_size) AS prev_size,
                  lag(best_rate) OVER (ORDER BY train_dataset_size) AS prev_rate FROM per)
SELECT train_dataset_size, round(best_rate, 6) AS best_rate, prev_size, train_dataset_size - prev_size AS delta_size,
       round(best_rate - prev_rate, 6) AS delta_rate, train_dataset_size = best_size AS is_best_size
FROM lagged, best"""
    q["trial_score_topk"] = f"""WITH {REGISTRY},
sc AS (SELECT model_hash, seq, avg_bleu,
              CASE WHEN total_snippets <> 0 THEN successful_runs::DOUBLE / total_snippets ELSE 0.0 END AS execution_rate
       FROM reg)
SELECT model_hash, seq, round(execution_rate, 6) AS execution_rate, round(avg_bleu, 6) AS avg_bleu,
       round({fixed.TRIAL_RATE_WEIGHT} * execution_rate + {fixed.TRIAL_BLEU_WEIGHT} * avg_bleu, 6) AS score
FROM sc ORDER BY {fixed.TRIAL_RATE_WEIGHT} * execution_rate + {fixed.TRIAL_BLEU_WEIGHT} * avg_bleu DESC, seq LIMIT 1"""
    q["registry_hash"] = f"WITH {REGISTRY}\nSELECT run_id, model_hash FROM reg"
    q["registry_record"] = f"""WITH {REGISTRY}
SELECT run_id, seq, model_hash, model_type, train_dataset_size, round(avg_bleu, 6) AS avg_bleu, successful_runs, total_snippets
FROM reg"""
    q["registry_append"] = f"""WITH {REGISTRY},
existing AS (SELECT * FROM reg WHERE ends_with(run_id, '/en')),
batch AS (SELECT * FROM reg WHERE NOT ends_with(run_id, '/en')),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_hash ORDER BY seq) AS rn FROM batch) WHERE rn = 1),
fresh AS (SELECT * FROM firsts WHERE model_hash NOT IN (SELECT model_hash FROM existing)),
top AS (SELECT coalesce(max(seq), -1) AS top FROM existing)
SELECT run_id, model_hash, seq FROM existing
UNION ALL SELECT run_id, model_hash, top + row_number() OVER (ORDER BY seq) AS seq FROM fresh, top"""

    # history
    q["loss_smoothing"] = f"""WITH {HISTORY}
SELECT run_id, step, loss,
       round(CASE WHEN count(*) OVER (PARTITION BY run_id) > {fixed.LOSS_SMOOTH_WINDOW}
                  THEN avg(loss) OVER (PARTITION BY run_id ORDER BY step ROWS BETWEEN {fixed.LOSS_SMOOTH_WINDOW - 1} PRECEDING AND CURRENT ROW)
             END, 6) AS smoothed
FROM hist"""
    q["run_series"] = f"WITH {HISTORY}\nSELECT step, run_id, loss FROM hist"
    q["run_comparison"] = f"""WITH {HISTORY},
ranked AS (SELECT *, row_number() OVER (PARTITION BY step ORDER BY loss, run_id) AS rn FROM hist)
SELECT step, count(*) AS n_runs, round(min(loss), 6) AS min_loss, round(avg(loss), 6) AS avg_loss,
       round(max(loss), 6) AS max_loss, min(CASE WHEN rn = 1 THEN run_id END) AS best_run
FROM ranked GROUP BY step"""
    series = """l AS (SELECT user_id AS run_id, row_number() OVER w AS step, value AS loss FROM events WHERE value IS NOT NULL
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
r AS (SELECT user_id AS run_id, row_number() OVER w AS step, round(value / 1000, 6) AS learning_rate FROM events
      WHERE value IS NOT NULL AND event_id % 3 <> 0 WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""
    q["metric_history"] = f"""WITH {series}
SELECT run_id, step, round(loss, 6) AS loss, learning_rate FROM l FULL JOIN r USING (run_id, step)"""
    q["learning_rate_comparison"] = f"""WITH {series}
SELECT step, count(*) AS n_runs, min(learning_rate) AS min_learning_rate, round(avg(learning_rate), 6) AS avg_learning_rate,
       max(learning_rate) AS max_learning_rate, arg_min(run_id::VARCHAR, (learning_rate, run_id::VARCHAR))::BIGINT AS best_run
FROM r GROUP BY step"""
    q["running_totals"] = q["variation_rollup"]
    words = r"regexp_extract_all(text, '[^\x09-\x0D\x1C-\x20\x{85}\p{Z}]+')"
    q["batched_tokens"] = f"""WITH c AS ({q['chat_template_text']}), w AS (SELECT conv_id, {words} AS w FROM c)
SELECT conv_id, len(w)::BIGINT AS n_tokens, w[1] AS first_token, w[-1] AS last_token FROM w"""
    return q
