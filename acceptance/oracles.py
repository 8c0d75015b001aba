"""What the queries must return, in SQL over the same tables."""

from __future__ import annotations

from acceptance.inputs import LABELS, SECONDS, TIME, WORDS_A, WORDS_B

ORACLES: dict[str, str] = {}


def _flag(words, text="text"):
    return f"regexp_matches(lower({text}), '(^|[^a-z])({'|'.join(words)})([^a-z]|$)')"


CORPUS = """corpus AS (
  SELECT d.doc_id, CAST(d.doc_id AS VARCHAR) AS id, d.text, CAST(l.toxic AS DOUBLE) AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""

SCORED = f"""{CORPUS},
models AS (SELECT * FROM (VALUES ('lexicon_a'), ('lexicon_b')) AS m(model)),
scored AS (
  SELECT c.*, m.model,
    CASE m.model WHEN 'lexicon_a' THEN {_flag(WORDS_A)} ELSE {_flag(WORDS_B)} END AS flagged
  FROM corpus c CROSS JOIN models m)"""

CORRECT = """CASE WHEN (label >= 0.5 AND flagged) OR (label < 0.5 AND NOT flagged)
  THEN 1 ELSE 0 END"""

ACCURACY = f"""WITH {SCORED}
SELECT model, COUNT(*) AS total_predictions,
  CAST(SUM({CORRECT}) AS BIGINT) AS correct_predictions,
  ROUND(SUM({CORRECT}) * 100.0::DOUBLE / COUNT(*), 2) AS accuracy_pct
FROM scored WHERE label IS NOT NULL GROUP BY model
ORDER BY accuracy_pct DESC, model"""

ORACLES["accuracy_by_model"] = ACCURACY
ORACLES["result_accuracy"] = ACCURACY

ORACLES["row_correctness"] = f"""WITH {SCORED}
SELECT doc_id, label, model, flagged, {CORRECT} AS correct FROM scored WHERE label IS NOT NULL"""

FANOUT = f"""WITH {SCORED}
SELECT id, label, model, TRUE AS success, flagged, CAST(NULL AS VARCHAR) AS error FROM scored"""
for _name in ("score_fanout", "score_fanout_pandas", "score_fanout_model"):
    ORACLES[_name] = FANOUT

ORACLES["score_conversations"] = f"""
SELECT CAST(conv_id AS VARCHAR) || '-' || CAST(turn AS VARCHAR) AS id, m.model,
  text <> '' AS success,
  CASE WHEN text = '' THEN NULL WHEN m.model = 'lexicon_a' THEN {_flag(WORDS_A)}
    ELSE {_flag(WORDS_B)} END AS flagged,
  CASE WHEN text = '' THEN 'missing_text' END AS error
FROM conversations CROSS JOIN (VALUES ('lexicon_a'), ('lexicon_b')) AS m(model)"""

ORACLES["score_errors"] = f"""WITH {SCORED}
SELECT id, model, doc_id % 9 <> 0 AS success,
  CASE WHEN doc_id % 9 <> 0 THEN flagged END AS flagged,
  CASE WHEN doc_id % 9 = 0 THEN 'missing_text' END AS error
FROM scored"""

ORACLES["score_faults"] = f"""WITH faults AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, model, {_flag(WORDS_A)} AS known,
    CASE WHEN model = 'raising' AND contains(text, 'scum') THEN 'ValueError'
      WHEN model = 'silent' AND contains(text, 'clown') THEN 'no_verdict' END AS error
  FROM documents CROSS JOIN (VALUES ('raising'), ('silent')) AS m(model))
SELECT id, model, error IS NULL AS success, CASE WHEN error IS NULL THEN known END AS flagged, error FROM faults"""

ORACLES["score_native_faults"] = f"""WITH least AS (SELECT min(text) AS least FROM documents WHERE contains(text, 'scum')),
faults AS (
  SELECT CAST(doc_id AS VARCHAR) AS id, 'raising' AS model, {_flag(WORDS_A)} AS known,
    CASE WHEN text = least THEN 'USER_RAISED_EXCEPTION' END AS error FROM documents, least
  UNION ALL SELECT CAST(doc_id AS VARCHAR), 'lexicon_b', {_flag(WORDS_B)}, NULL FROM documents)
SELECT id, model, error IS NULL AS success, CASE WHEN error IS NULL THEN known END AS flagged, error FROM faults"""

ORACLES["faulty_plans"] = """
SELECT CASE doc_id % 4 WHEN 0 THEN 'NoInputs' WHEN 1 THEN 'Malformed' ELSE 'OnInput' END AS plan,
  CASE doc_id % 4 WHEN 0 THEN 'no_inputs' WHEN 1 THEN 'bad_template' WHEN 2 THEN 'bad_template' END AS reason,
  COUNT(*) AS n
FROM documents GROUP BY ALL"""

ORACLES["parse_reply"] = "SELECT doc_id, doc_id % 7 < 3 AS yes FROM documents"

ORACLES["envelope_roundtrip"] = f"""WITH {CORPUS}
SELECT 'AB' AS plan, CAST(NULL AS VARCHAR) AS reason, id, text AS comment,
  CAST(label AS VARCHAR) AS label FROM corpus"""

ORACLES["empty_input"] = """
SELECT CAST(doc_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS reason,
  doc_id % 11 IN (7, 8, 9) AS has_input,
  CASE doc_id % 11 WHEN 7 THEN '[0]' WHEN 8 THEN '" "' WHEN 9 THEN '{"id":null}' END AS input
FROM documents"""

# Message kinds of the mixed stream: the plan goes by the number modulo 7, damage by 13.
MIXED = f"""{CORPUS},
named AS (
  SELECT *, CASE doc_id % 7 WHEN 0 THEN 'AB' WHEN 1 THEN 'Echo' WHEN 2 THEN 'Mixed'
    WHEN 3 THEN 'Broken' WHEN 4 THEN 'Nobody' WHEN 5 THEN '' END AS plan_given
  FROM corpus),
mixed AS (
  SELECT *,
    CASE WHEN doc_id % 13 IN (5, 6) THEN 'bad_message'
      WHEN doc_id % 7 IN (5, 6) THEN 'missing_plan'
      WHEN doc_id % 7 = 4 THEN 'unknown_plan'
      WHEN doc_id % 7 = 3 THEN 'unknown_step' END AS reason,
    CASE WHEN doc_id % 13 NOT IN (5, 6) THEN nullif(plan_given, '') END AS plan
  FROM named),
steps(plan, position, step, inputs) AS (VALUES
  ('AB', 0, 'lexicon_a', ['default_input']),
  ('AB', 1, 'lexicon_b', ['default_input']),
  ('AB', 2, 'store', ['lexicon_a', 'lexicon_b']),
  ('Echo', 0, 'echo', ['default_input']),
  ('Mixed', 0, 'echo', ['lexicon_a']),
  ('Mixed', 1, 'lexicon_a', ['default_input']),
  ('Mixed', 2, 'echo', ['[{{lexicon_a}},"{{{{x}}}}"]']),
  ('Mixed', 3, 'echo', ['{{nobody}} {{lexicon_a}}']),
  ('Mixed', 4, 'store', ['lexicon_a', 'echo']),
  ('Broken', 0, 'lexicon_a', ['default_input']),
  ('Broken', 1, 'nowhere', ['lexicon_a']))"""

# Object keys are written in order of their names.
_INPUT_JSON = """CASE WHEN label IS NULL THEN json_object('comment', text, 'id', id)
  ELSE json_object('comment', text, 'id', id, 'label', CAST(label AS VARCHAR)) END"""


def _answer_json(model, words):
    return f"""json_object('is_hate_speech', {_flag(words)}, 'model', '{model}', 'output',
  json_object('comment', text, 'id', id, 'label', CAST(label AS VARCHAR)), 'success', TRUE)"""


# Results of every step, as (position, name, text); the message input has position -1.
RUNS = f"""{MIXED},
runs AS (
  SELECT *, CAST({_INPUT_JSON} AS VARCHAR) AS input_json,
    CAST({_answer_json('lexicon_a', WORDS_A)} AS VARCHAR) AS a_json,
    CAST({_answer_json('lexicon_b', WORDS_B)} AS VARCHAR) AS b_json
  FROM mixed WHERE reason IS NULL),
step_results AS (
  SELECT id, plan, -1 AS position, 'default_input' AS step, input_json AS result FROM runs
  UNION ALL
  SELECT r.id, r.plan, s.position, s.step,
    CASE WHEN s.step = 'lexicon_a' THEN a_json
      WHEN s.step = 'lexicon_b' THEN b_json
      WHEN s.step = 'store' THEN '{{"inserted_records":' ||
        CASE r.plan WHEN 'AB' THEN '2' ELSE '1' END || ',"success":true}}'
      WHEN r.plan = 'Echo' THEN '{{"output":' || input_json || ',"success":true}}'
      WHEN s.position = 2 THEN '{{"output":[' || a_json || ',"{{x}}"],"success":true}}'
      ELSE '{{"error":"invalid_json","success":false}}' END
  FROM runs r JOIN steps s ON r.plan = s.plan)"""

ORACLES["routed_messages"] = f"""WITH {MIXED}
SELECT m.id, m.plan, CAST(COUNT(*) AS INTEGER) AS n_steps
FROM mixed m JOIN steps s ON m.plan = s.plan WHERE m.reason IS NULL GROUP BY m.id, m.plan"""

_INPUT_IN_ORDER = """CASE WHEN label IS NULL THEN json_object('id', id, 'comment', text)
  ELSE json_object('id', id, 'comment', text, 'label', CAST(label AS VARCHAR)) END"""
ORACLES["dead_letter_rows"] = f"""WITH {MIXED}, bodies AS (
  SELECT *, CAST(CASE WHEN plan_given IS NULL THEN json_object('input', {_INPUT_IN_ORDER})
    ELSE json_object('plan', plan_given, 'input', {_INPUT_IN_ORDER}) END AS VARCHAR) AS whole
  FROM mixed WHERE reason IS NOT NULL)
SELECT plan, reason, CASE doc_id % 13 WHEN 5 THEN whole || ' and more'
  WHEN 6 THEN '[' || whole || ']' ELSE whole END AS body FROM bodies"""

ORACLES["dead_letter_counts"] = f"""WITH {MIXED}
SELECT reason, COUNT(*) AS n FROM mixed WHERE reason IS NOT NULL GROUP BY reason"""

ORACLES["expanded_steps"] = f"""WITH {MIXED}
SELECT m.id, m.plan, s.position, s.step, array_to_string(s.inputs, '|') AS inputs
FROM mixed m JOIN steps s ON m.plan = s.plan WHERE m.reason IS NULL"""

ORACLES["unregistered_steps"] = f"""WITH {MIXED}, known(step) AS (
  VALUES ('lexicon_a'), ('lexicon_b'), ('echo'), ('store'))
SELECT m.id, m.plan, s.position, s.step FROM mixed m JOIN steps s ON m.plan = s.plan
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.step = s.step)"""

ORACLES["bound_inputs"] = f"""WITH {RUNS}, wanted AS (
  SELECT r.id, r.plan, s.position, s.step, s.inputs, n.nth, s.inputs[n.nth + 1] AS given
  FROM runs r JOIN steps s ON r.plan = s.plan
  JOIN (SELECT unnest([0, 1]) AS nth) n ON n.nth < len(s.inputs))
SELECT w.id, w.plan, w.position, w.step, w.nth,
  CASE WHEN MAX(r.position) IS NOT NULL THEN arg_max(r.result, r.position)
    WHEN w.position = 2 THEN '[' || MAX(t.result) || ',"{{x}}"]' ELSE w.given END AS bound
FROM wanted w
LEFT JOIN step_results r ON r.id = w.id AND r.step = w.given AND r.position < w.position
LEFT JOIN step_results t ON t.id = w.id AND t.step = 'lexicon_a' AND t.position < w.position
GROUP BY w.id, w.plan, w.position, w.step, w.nth, w.given"""

ORACLES["plan_results"] = f"""WITH {RUNS}
SELECT id, plan, step, arg_max(result, position) AS result
FROM step_results GROUP BY id, plan, step"""

ORACLES["message_outcome"] = f"""WITH {MIXED}
SELECT CASE WHEN doc_id % 13 NOT IN (5, 6) THEN id END AS id, plan, reason IS NULL AS completed FROM mixed"""

_NO_RESULT = """CAST(NULL AS VARCHAR) AS record_id, CAST(NULL AS DOUBLE) AS label,
  CAST(NULL AS VARCHAR) AS model, CAST(NULL AS BOOLEAN) AS flagged"""
ORACLES["mixed_plan_outcomes"] = f"""WITH {MIXED}
SELECT 'accepted' AS kind, TRUE AS first, plan, reason, id AS record_id, label,
  'lexicon_a' AS model, {_flag(WORDS_A)} AS flagged
FROM mixed WHERE reason IS NULL AND plan IN ('AB', 'Mixed')
UNION ALL SELECT 'accepted', FALSE, plan, reason, id, label, 'lexicon_b', {_flag(WORDS_B)}
FROM mixed WHERE reason IS NULL AND plan = 'AB'
UNION ALL SELECT 'rejected', FALSE, plan, 'missing_model', {_NO_RESULT}
FROM mixed WHERE reason IS NULL AND plan = 'Mixed'
UNION ALL SELECT 'empty', TRUE, plan, reason, {_NO_RESULT}
FROM mixed WHERE reason IS NULL AND plan = 'Echo'
UNION ALL SELECT 'dead', TRUE, plan, reason, {_NO_RESULT}
FROM mixed WHERE reason IS NOT NULL"""

ORACLES["split_routed_messages"] = ORACLES["routed_messages"]
for _name in ("plan_results", "bound_inputs"):
    ORACLES[f"many_{_name}"] = ORACLES[_name]
ORACLES["many_plan_outcomes"] = ORACLES["mixed_plan_outcomes"]

ORACLES["reported_rejects"] = f"""WITH {MIXED}
SELECT plan, 'missing_model' AS reason, '{{"error":"invalid_json","success":false}}' AS answer
FROM mixed WHERE reason IS NULL AND plan = 'Mixed'"""

ORACLES["reported_dead_messages"] = ORACLES["dead_letter_rows"]

ORACLES["outcome_counts"] = f"""WITH {MIXED}
SELECT plan, COUNT(*) FILTER (reason IS NULL) AS completed,
  COUNT(*) FILTER (reason IS NOT NULL) AS failed,
  CAST(SUM(CASE WHEN reason IS NOT NULL THEN 0 WHEN plan = 'AB' THEN 2 WHEN plan = 'Mixed' THEN 1
    ELSE 0 END) AS BIGINT) AS stored,
  COUNT(*) FILTER (reason IS NULL AND plan = 'Mixed') AS rejected
FROM mixed GROUP BY plan"""

ORACLES["sanitize_json"] = """
SELECT event_id, CASE WHEN event_id % 5 IN (0, 1, 4)
  THEN '{"k":' || json_extract_string(props, '$.k') || '}' END AS clean
FROM events"""

_REASONS = """reasons AS (
  SELECT *, CASE doc_id % 22 WHEN 0 THEN 'invalid_json' WHEN 2 THEN 'bad_success'
    WHEN 3 THEN 'missing_model' WHEN 4 THEN 'bad_flag' WHEN 5 THEN 'output_not_object'
    WHEN 6 THEN 'bad_output' WHEN 7 THEN 'bad_output' WHEN 8 THEN 'unbindable'
    WHEN 10 THEN 'not_object' END AS reason
  FROM corpus)"""

ORACLES["reject_reasons"] = f"""WITH {CORPUS}, {_REASONS}
SELECT reason, COUNT(*) AS n FROM reasons WHERE reason IS NOT NULL GROUP BY reason"""

ORACLES["rejected_rows"] = f"""WITH {CORPUS}, {_REASONS}
SELECT id, reason FROM reasons WHERE reason IS NOT NULL"""

ORACLES["accepted_answers"] = f"""WITH {CORPUS}, {_REASONS}
SELECT id AS record_id, text AS comment,
  CASE doc_id % 22 WHEN 12 THEN CAST(1 AS DOUBLE) WHEN 13 THEN CAST(0 AS DOUBLE) ELSE label END AS label,
  'lexicon_a' AS model, {_flag(WORDS_A)} AS flagged,
  CASE doc_id % 22 WHEN 14 THEN '{TIME}' WHEN 15 THEN '{SECONDS}' END AS input_ts
FROM reasons WHERE reason IS NULL"""

ORACLES["insert_counts"] = f"""WITH {CORPUS}, {_REASONS}
SELECT COUNT(*) AS inserted_records,
  '{{"success":true,"inserted_records":' || CAST(COUNT(*) AS VARCHAR) || '}}' AS response
FROM reasons WHERE reason IS NULL"""


def _sql_double(value):
    return "NULL" if value is None else f"CAST('{value}' AS DOUBLE)"


ORACLES["coerce_label"] = f"""
SELECT CAST(d.doc_id AS VARCHAR) AS record_id, e.label
FROM documents d JOIN (VALUES {', '.join(
    f"({i}, {_sql_double(value)})" for i, (_, value) in enumerate(LABELS))}) AS e(r, label)
ON d.doc_id % {len(LABELS)} = e.r"""

RESULTS = f"""WITH {SCORED}
SELECT id AS record_id, text AS comment, label, model, flagged,
  CAST(NULL AS VARCHAR) AS input_ts FROM scored"""
for _name in ("result_rows", "result_rows_pandas", "stream_results"):
    ORACLES[_name] = RESULTS

ORACLES["stored_results"] = f"SELECT r.* FROM ({RESULTS}) r CROSS JOIN (VALUES (1), (2)) twice(nth)"

ORACLES["stored_result_ids"] = "SELECT 4 * COUNT(*) AS n_rows, 4 * COUNT(*) AS n_ids FROM documents"

ORACLES["stream_batches"] = """
SELECT COUNT(*) AS completed, CAST(0 AS BIGINT) AS failed, 2 * COUNT(*) AS stored,
  CAST(0 AS BIGINT) AS rejected FROM documents"""

ORACLES["score_fanout_loaded"] = ORACLES["score_fanout"]

ORACLES["fitted_model_quality"] = """
SELECT COUNT(*) AS n, COUNT(d.text) AS answered, true AS fitted_well, true AS held_out_well
FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic IS NOT NULL"""

ORACLES["redelivered_results"] = f"""SELECT r.* FROM ({RESULTS}) r
WHERE CAST(record_id AS BIGINT) % 7 = 4 AND CAST(record_id AS BIGINT) % 13 NOT IN (5, 6)"""

ORACLES["merged_results"] = ORACLES["stream_results"]
ORACLES["running_accuracy"] = ACCURACY

ORACLES["bounded_batches"] = """
SELECT n // 300 AS batch_id, COUNT(*) AS completed, 2 * COUNT(*) AS stored
FROM (SELECT ROW_NUMBER() OVER () - 1 AS n FROM documents) GROUP BY n // 300"""

ORACLES["batch_outcome"] = """
SELECT doc_id // 8 AS batch_id, COUNT(*) FILTER (doc_id % 7 < 3) AS completed,
  COUNT(*) FILTER (doc_id % 7 >= 3) AS failed
FROM documents GROUP BY doc_id // 8"""

ORACLES["echo_step"] = """
SELECT event_id, CASE WHEN event_id % 3 = 0 THEN '{"error":"invalid_json","success":false}'
  ELSE '{"output":{"k":' || json_extract_string(props, '$.k') || '},"success":true}' END AS answer
FROM events"""

ORACLES["smoke_gate"] = f"""WITH {CORPUS}, labelled AS (
  SELECT *, {_flag(WORDS_A)} AS a, {_flag(WORDS_B)} AS b FROM corpus WHERE label IS NOT NULL)
SELECT 'careful' AS model, bool_and(NOT a OR label >= 0.5) AS passed FROM labelled
UNION ALL SELECT 'complete', bool_and(b OR label < 0.5) FROM labelled
UNION ALL SELECT 'unchecked', TRUE"""

ORACLES["csv_corpus"] = f"""WITH {CORPUS}
SELECT id, text AS comment, coalesce(CAST(label AS VARCHAR), '') AS label FROM corpus"""

ORACLES["large_csv"] = f"""WITH {CORPUS}
SELECT id, '"' || chr(10) || replace(text, ' ', chr(10)) || ',"' AS comment,
  coalesce(CAST(label AS VARCHAR), '') AS label FROM corpus"""

ORACLES["jsonl_input"] = "SELECT event_id, props FROM events"

ORACLES["published_messages"] = "SELECT CAST(doc_id AS VARCHAR) AS id, 'AB' AS plan FROM documents"

ORACLES["peeked_message"] = """
SELECT 'seen' AS what, CAST(1 AS BIGINT) AS n
UNION ALL SELECT 'waiting', COUNT(*) FROM documents"""

ORACLES["published_counts"] = """
SELECT 'published' AS what, COUNT(*) AS n FROM documents
UNION ALL SELECT 'waiting', COUNT(*) FROM documents
UNION ALL SELECT 'taken', LEAST(8, COUNT(*)) FROM documents"""

ORACLES["message_files"] = """
SELECT CAST(s_suppkey AS VARCHAR) AS id, 'AB' AS plan, s_name AS comment FROM supplier"""
