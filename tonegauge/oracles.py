"""SQL (DuckDB) that the queries' results are held against.

What templates are worth was derived by hand (``sources.corpus``); how it adds up,
deadlines, chains and bands are worked out here in SQL on its own terms.
"""

from __future__ import annotations

from .functions import rules
from .plans import labelled
from .plans.report import PHRASES
from .sources import corpus, pairs


def _text(s: str | None) -> str:
    return "NULL" if s is None else "'" + s.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(_text(w) for w in words) + "]"


def _bank() -> str:
    rows = [
        f"({i}, {_text(t.text)}, {t.level}, {t.surface if t.surface is not None else 'NULL::DOUBLE'}, {_text(t.request)}, {_text(t.due)}, {t.rung}::DOUBLE, {t.consequence!r}::DOUBLE, {t.dependency!r}::DOUBLE, {t.follow_up!r}::DOUBLE)"
        for i, t in enumerate(corpus.TEMPLATES)
    ]
    return "bank(template, text, level, surface, request, due, rung, consequence, dependency, follow_up) AS (VALUES " + ",\n".join(rows) + ")"


def _signature(text: str) -> str:
    forms = "MAP {" + ", ".join(f"{_text(k)}: {_text(v)}" for k, v in rules.action_forms().items()) + "}"
    return f"list_transform(list_filter(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: NOT list_contains({_list(rules.STOPWORDS.split())}, w)), lambda w: coalesce({forms}[w], w))"


_COMPLETION = " OR ".join(f"contains(lower(text), {_text(w)})" for w in rules.COMPLETION)

#: m: messages with their template's worth. Times are local milliseconds, seconds and below are zero.
MESSAGES = f"""
{_bank()},
m AS (
  SELECT 'c' || c.conv_id AS thread_id, c.turn AS ord, c.role AS sender, CASE c.role WHEN 'user' THEN 'assistant' WHEN 'assistant' THEN 'user' END AS recipient,
    CAST({corpus.sent_ms("c.conv_id", "c.turn")} AS BIGINT) AS ms, CAST({corpus.sent_ms("c.conv_id", "c.turn")} + ({corpus.offset_of("c.conv_id")}) * 60000 AS BIGINT) AS local, b.*
  FROM conversations c JOIN bank b ON b.template = {corpus.template_number("c.conv_id", "c.turn")}
)"""

_SCORED = f"""
s AS (SELECT *, CASE WHEN level = 0 THEN 'no_head_act' WHEN recipient IS NULL THEN 'unresolved_addressee' END AS suppressed FROM m),
g AS (SELECT *, CASE WHEN suppressed IS NULL THEN {_signature("request")} ELSE [] END AS sig, ({_COMPLETION}) AS done, local // 86400000 AS day FROM s),
reset AS (
  SELECT c.thread_id, c.ord, max(p.ord) AS last FROM g c JOIN g p ON p.thread_id = c.thread_id AND p.ord < c.ord AND p.sender <> c.sender AND p.sender = c.recipient AND p.done GROUP BY ALL
),
chain AS (
  SELECT c.thread_id, c.ord, count(*) AS earlier, max(p.ms) AS last_ms, list(p.ms ORDER BY p.ord DESC)[2] AS before_ms
  FROM g c JOIN g p ON p.thread_id = c.thread_id AND p.ord < c.ord AND p.sender = c.sender AND c.suppressed IS NULL AND len(p.sig) > 0
    AND len(list_intersect(p.sig, c.sig)) >= 0.3 * len(list_distinct(list_concat(p.sig, c.sig)))
  LEFT JOIN reset r ON r.thread_id = c.thread_id AND r.ord = c.ord WHERE p.ord > coalesce(r.last, -1) GROUP BY ALL
),
e AS (
  SELECT g.*, coalesce(c.earlier, 0) AS earlier,
    coalesce(c.earlier, 0) > 0 AND NOT EXISTS (SELECT 1 FROM g p WHERE p.thread_id = g.thread_id AND p.ord < g.ord AND p.sender = g.recipient AND p.ms > c.last_ms AND p.ms < g.ms) AS unanswered,
    coalesce(c.earlier, 0) > 1 AND g.ms - c.last_ms < c.last_ms - c.before_ms AS accelerating
  FROM g LEFT JOIN chain c ON c.thread_id = g.thread_id AND c.ord = g.ord
),
d AS (
  SELECT *, make_date(CAST(1970 AS BIGINT), 1, 1) + CAST(day AS INTEGER) AS date, (day + 4) % 7 AS wd FROM e
),
t AS (
  SELECT *, CASE due
      WHEN 'friday' THEN (day + (5 - wd + 7) % 7) * 86400000 + 61200000 WHEN 'tomorrow' THEN (day + 1) * 86400000 + 61200000 WHEN 'end of day' THEN day * 86400000 + 61200000
      WHEN 'now' THEN local WHEN '5pm' THEN CASE WHEN day * 86400000 + 61200000 < local THEN (day + 1) * 86400000 + 61200000 ELSE day * 86400000 + 61200000 END
      WHEN '2026-09-30' THEN epoch_ms(TIMESTAMP '2026-09-30 17:00:00')
      WHEN '15th' THEN CASE WHEN epoch_ms(date_trunc('month', date)::TIMESTAMP) + 14 * 86400000 + 61200000 < local
        THEN epoch_ms((date_trunc('month', date) + INTERVAL 1 MONTH)::TIMESTAMP) + 14 * 86400000 + 61200000 ELSE epoch_ms(date_trunc('month', date)::TIMESTAMP) + 14 * 86400000 + 61200000 END
    END AS due_at, (day * 86400000 + 61200000 - local) / 3600000.0 AS left_h FROM d
),
c AS (
  SELECT *, CASE WHEN due IS NULL THEN 0 WHEN rung >= 0 THEN rung WHEN left_h > 6 THEN 3.0 WHEN left_h >= 2 THEN 4.0 ELSE 5.0 END * 0.6 AS rung_part,
    CASE WHEN due_at IS NULL THEN 0 WHEN due_at <= local THEN 1.5 WHEN due_at - local >= 336 * 3600000 THEN 0 ELSE 1.5 * exp(-((due_at - local) / 3600000.0) / 48) END AS near_part,
    follow_up + CASE WHEN earlier >= 3 THEN 2.5 WHEN earlier = 2 THEN 1.8 WHEN earlier = 1 THEN 1.0 ELSE 0 END + CASE WHEN accelerating THEN 0.5 ELSE 0 END + CASE WHEN unanswered THEN 0.5 ELSE 0 END AS repeat_sum FROM t
),
f AS (
  SELECT *, least(3.0, repeat_sum) AS repeat_part,
    least(10.0, 3.0 + rung_part + near_part + consequence + dependency + least(3.0, repeat_sum)) AS force,
    (CASE WHEN rung_part + near_part > 0 THEN 1 ELSE 0 END) + (CASE WHEN consequence > 0 THEN 1 ELSE 0 END) + (CASE WHEN dependency > 0 THEN 1 ELSE 0 END) + (CASE WHEN repeat_sum > 0 THEN 1 ELSE 0 END) AS events FROM c
),
r AS (
  SELECT *, floor((floor(force * 10 + 0.5) / 10 - floor(surface * 10 + 0.5) / 10) * 10 + 0.5) / 10 AS gap,
    0.4 + 0.2 + 0.1 + 0.15 + CASE WHEN events >= 2 THEN 0.1 WHEN events = 1 THEN 0.05 ELSE 0 END - CASE WHEN due IS NOT NULL AND due_at IS NULL THEN 0.15 ELSE 0 END AS sure FROM f WHERE suppressed IS NULL
),
b AS (SELECT *, CASE WHEN gap >= 3 THEN 'under-phrased' WHEN gap >= 1 THEN 'mildly-under-phrased' WHEN gap > -1 THEN 'aligned' WHEN gap > -3 THEN 'mildly-over-phrased' ELSE 'over-phrased' END AS band FROM r)"""

_WITH = f"WITH {MESSAGES},{_SCORED}"
_BASIC = f"WITH {MESSAGES}"
_LEVEL_NAMES = ", ".join(f"({i + 1}, '{name}')" for i, name in enumerate(rules.LEVELS))


def _safe_rules() -> str:
    """Rules whose patterns DuckDB can read."""
    unsafe = ("(?!", "(?=", "(?<", "\\1")
    safe = [(name, r) for name, table in rules.TABLES.items() for r in table if not any(x in r.pattern for x in unsafe)]
    values = ",\n".join(f"('{name}', {r.ord}, {_text(r.pattern if r.case else '(?i)' + r.pattern)})" for name, r in safe)
    return f"rule(lexicon, rule, pattern) AS (VALUES {values})"


def _document_rule_hits() -> str:
    said = corpus.examples()
    example = lambda k: f"said[doc_id * {k} % {len(said)} + 1]"
    return f"""WITH {_safe_rules()}, e AS (SELECT {_list(said)} AS said),
d AS (SELECT {example(1)} || ' ' || coalesce(text, '') || ' ' || {example(7)} AS text FROM documents, e)
SELECT lexicon, rule, count(*) AS documents FROM d JOIN rule ON regexp_matches(d.text, rule.pattern) GROUP BY lexicon, rule"""


def _labelled_levels() -> str:
    bounds = "[" + ", ".join(str(b) for b in labelled.poisson_bounds()) + "]"
    cut = lambda name, low: f"list_sort(list({name}) FILTER (replicate > 0 AND {name} IS NOT NULL))[{{}}]".format(
        f"count({name}) FILTER (replicate > 0) // 40 + 1" if low else f"count({name}) FILTER (replicate > 0) - count({name}) FILTER (replicate > 0) // 40"
    )
    shares = ", ".join(f"round({cut(name, low)}, 9) AS {name}_{'low' if low else 'high'}" for name in ("precision", "recall") for low in (True, False))
    return f"""{_BASIC},
l AS (SELECT thread_id || '-' || ord AS msg, level, CASE WHEN (CAST(substr(thread_id, 2) AS BIGINT) * 3 + ord) % 7 = 0 THEN (level + 1) % 8 ELSE level END AS label FROM m),
w AS (
  SELECT level, label, replicate, CASE WHEN replicate = 0 THEN 1 ELSE len(list_filter({bounds}, lambda b: CAST('0x' || substr(md5(msg || ':' || replicate), 1, {labelled.DIGITS}) AS BIGINT) >= b)) END AS w
  FROM l, range({labelled.REPLICATES + 1}) AS r(replicate)
),
c AS (SELECT v.of AS of, replicate, sum(w * v.l) AS labelled, sum(w * v.f) AS found, sum(w * v.b) AS agreed
  FROM (SELECT w, replicate, unnest([{{'of': label, 'l': 1, 'f': 0, 'b': CAST(level = label AS INTEGER)}}, {{'of': level, 'l': 0, 'f': 1, 'b': 0}}]) AS v FROM w) GROUP BY 1, 2),
s AS (SELECT *, CASE WHEN found > 0 THEN agreed::DOUBLE / found END AS precision, CASE WHEN labelled > 0 THEN agreed::DOUBLE / labelled END AS recall FROM c)
SELECT of AS level, CAST(max(labelled) FILTER (replicate = 0) AS BIGINT) AS labelled, CAST(max(found) FILTER (replicate = 0) AS BIGINT) AS found, CAST(max(agreed) FILTER (replicate = 0) AS BIGINT) AS agreed,
  round(max(precision) FILTER (replicate = 0), 9) AS precision, round(max(recall) FILTER (replicate = 0), 9) AS recall, {shares} FROM s GROUP BY of"""


def _rule_hits() -> str:
    said = corpus.examples()
    return f"""{_BASIC}, {_safe_rules()},
x AS (
  SELECT text, sum(n) AS n FROM (
    SELECT text, count(*) AS n FROM m GROUP BY text UNION ALL SELECT {_list(said)}[event_id % {len(said)} + 1], count(*) FROM events GROUP BY 1
  ) GROUP BY text
)
SELECT lexicon, rule, CAST(sum(n) AS BIGINT) AS messages FROM x JOIN rule ON regexp_matches(x.text, rule.pattern) GROUP BY lexicon, rule"""


def _deadlines() -> str:
    end = "61200000"
    month = "epoch_ms(date_trunc('month', date)::TIMESTAMP)"
    due = {
        "by friday": f"(day + (5 - wd + 7) % 7) * 86400000 + {end}", "tomorrow": f"(day + 1) * 86400000 + {end}", "day after tomorrow": f"(day + 2) * 86400000 + {end}",
        "this week": f"(day + (5 - wd + 7) % 7) * 86400000 + {end}", "next week": f"(day + (5 - wd + 7) % 7 + 7) * 86400000 + {end}", "end of week": f"(day + (5 - wd + 7) % 7) * 86400000 + {end}",
        "end of the month": f"epoch_ms((date_trunc('month', date) + INTERVAL 1 MONTH)::TIMESTAMP) - 86400000 + {end}", "end of quarter": f"epoch_ms((date_trunc('quarter', date) + INTERVAL 3 MONTH)::TIMESTAMP) - 86400000 + {end}",
        "by noon": "CASE WHEN day * 86400000 + 43200000 < local THEN (day + 1) * 86400000 + 43200000 ELSE day * 86400000 + 43200000 END",
        "by 5pm": f"CASE WHEN day * 86400000 + {end} < local THEN (day + 1) * 86400000 + {end} ELSE day * 86400000 + {end} END",
        "within 3 days": "local + 3 * 86400000", "in 20 minutes": "local + 1200000",
        "by the 15th": f"CASE WHEN {month} + 14 * 86400000 + {end} < local THEN epoch_ms((date_trunc('month', date) + INTERVAL 1 MONTH)::TIMESTAMP) + 14 * 86400000 + {end} ELSE {month} + 14 * 86400000 + {end} END",
        "2026-09-30": f"epoch_ms(TIMESTAMP '2026-09-30 00:00:00') + {end}", "next monday": f"(day + CASE WHEN wd = 1 THEN 7 ELSE (1 - wd + 7) % 7 END) * 86400000 + {end}",
        "thursday at 9am": "(day + (4 - wd + 7) % 7) * 86400000 + 32400000", "sep 3": f"epoch_ms(make_date(year(date), 9, 3)::TIMESTAMP) + {end}",
    }
    cases = " ".join(f"WHEN {_text(k)} THEN {v}" for k, v in due.items())
    return f"""WITH p AS (SELECT event_id, (epoch_ms(ts) // 60000) * 60000 AS local, {_list(PHRASES)}[event_id % {len(PHRASES)} + 1] AS phrase FROM events),
q AS (SELECT *, local // 86400000 AS day, (local // 86400000 + 4) % 7 AS wd, DATE '1970-01-01' + CAST(local // 86400000 AS INTEGER) AS date FROM p)
SELECT event_id, phrase, coalesce(CAST(CASE phrase {cases} END AS BIGINT), -1) AS due_ms FROM q"""


def _pairs() -> str:
    """pair: what the sides are worth by hand; gap and checks worked out here."""
    rows = ",\n".join(f"({n * len(pairs.OBJECTS) + k}, '{family}', {a.surface}::DOUBLE, {b.surface}::DOUBLE, ({a.force})::DOUBLE, ({b.force})::DOUBLE)" for n, (family, a, b) in enumerate(pairs.PAIRS) for k in range(len(pairs.OBJECTS)))
    gap = lambda end: f"floor((floor(force_{end} * 10 + 0.5) / 10 - floor(surface_{end} * 10 + 0.5) / 10) * 10 + 0.5) / 10"
    return f"""keys AS (SELECT DISTINCT conv_id AS key FROM conversations),
bank_of_pairs(number, family, surface_a, surface_b, force_a, force_b) AS (VALUES {rows}),
pair AS (SELECT key AS pair_id, p.* EXCLUDE number FROM keys JOIN bank_of_pairs p ON number = key * 37 % {pairs.N_PAIRS}),
worth AS (SELECT *, {gap("a")} AS gap_a, {gap("b")} AS gap_b, family IN ('modality', 'strategy', 'modification') AS wording FROM pair),
checked AS (
  SELECT *, CASE WHEN wording THEN force_a = force_b ELSE surface_a = surface_b END AS stays, CASE WHEN wording THEN surface_a - surface_b ELSE force_b - force_a END >= 1 - 1e-9 AS moves, gap_a < gap_b AS direction FROM worth
)"""


_KEYS = "keys AS (SELECT DISTINCT conv_id AS key FROM conversations)"
_LEVEL_WORTH = "level_bank(level, surface) AS (VALUES (1, 10.0::DOUBLE), (2, 9.0), (3, 8.0), (4, 7.0), (5, 6.0), (6, 4.5), (7, 3.1)), level_worth AS (SELECT * FROM level_bank, keys)"
_CHECKS = ["surface trace adds up", "force trace adds up", "surface triggers are the text's", "force triggers are the text's", "scores in range", "gap is the difference", "confidence in range", "sides share no character"]


def _release_report() -> str:
    held = {
        1: ("force stays when wording changes", "sum(CAST(wording AND stays AS INT))", "sum(CAST(wording AS INT))", "checked"), 2: ("surface moves when wording changes", "sum(CAST(wording AND moves AS INT))", "sum(CAST(wording AS INT))", "checked"),
        3: ("force moves when reasons change", "sum(CAST(NOT wording AND moves AS INT))", "sum(CAST(NOT wording AS INT))", "checked"), 4: ("surface stays when reasons change", "sum(CAST(NOT wording AND stays AS INT))", "sum(CAST(NOT wording AS INT))", "checked"),
        5: ("gap moves the way it should", "sum(CAST(direction AS INT))", "count(*)", "checked"), 6: ("surface falls from level to level", "count(*)", "count(*)", "level_worth"),
        7: ("evidence adds up and quotes the text", str(len(_CHECKS) - 1), str(len(_CHECKS) - 1), "(SELECT 1)"), 8: ("no character counts on both sides", "1", "1", "(SELECT 1)"),
        9: ("a fact counts once", "count(*)", "count(*)", "keys"), 10: ("two runs give the same", "count(*)", "count(*)", "conversations"), 11: ("copy claims no intent", "count(*)", "count(*)", "keys"),
    }
    rows = " UNION ALL ".join(f"SELECT {n} AS \"check\", '{name}' AS name, CAST({ok} AS BIGINT) AS held, CAST({of} AS BIGINT) AS applicable FROM {source}" for n, (name, ok, of, source) in held.items())
    return f"""WITH {_pairs()}, {_LEVEL_WORTH}, c AS ({rows}),
s AS (SELECT *, CASE WHEN held < CASE WHEN "check" = 5 THEN 0.95 ELSE 1 END * applicable THEN 'FAIL' WHEN "check" = 6 THEN 'PARTIAL' ELSE 'PASS' END AS status FROM c)
SELECT "check", name, status, held, applicable, lpad(CAST("check" AS VARCHAR), 2, ' ') || '  ' || rpad(status, 7, ' ') || '  ' || name || '  ' || held || '/' || applicable AS report FROM s
UNION ALL SELECT 99, 'total', NULL, NULL, NULL, count(*) FILTER (status = 'PASS') || ' PASS, ' || count(*) FILTER (status = 'PARTIAL') || ' PARTIAL, ' || count(*) FILTER (status = 'FAIL') || ' FAIL' FROM s"""


def _marks() -> str:
    rows = [f"({i}, {_text(phrase)}, {_text(sub)}, {weight}::DOUBLE)" for i, t in enumerate(corpus.TEMPLATES) for phrase, sub, weight, _ in t.marks()]
    return "mark(template, phrase, subcategory, weight) AS (VALUES " + ",\n".join(rows) + ")"


def _volume() -> str:
    """The scored messages of events instead of conversations."""
    bank = "b.template = (e.user_id * 31 + e.event_id * 7) % " + str(len(corpus.TEMPLATES))
    m = f"""m AS (
  SELECT CAST(e.user_id AS VARCHAR) AS thread_id, e.event_id AS ord, CASE WHEN e.event_id % 3 = 0 THEN 'b' ELSE 'a' END AS sender, CASE WHEN e.event_id % 3 = 0 THEN 'a' ELSE 'b' END AS recipient,
    epoch_ms(date_trunc('second', e.ts)) AS ms, epoch_ms(date_trunc('second', e.ts)) AS local, b.* FROM events e JOIN bank b ON {bank}
)"""
    return f"""WITH {_bank()}, {m},{_SCORED}
SELECT b.band, s.suppressed, count(*) AS messages, round(avg(b.force), 4) AS mean_force FROM s LEFT JOIN b ON b.thread_id = s.thread_id AND b.ord = s.ord GROUP BY ALL"""


_CATEGORY = "CASE WHEN weight >= 3 THEN 'directness' WHEN weight < 0 THEN 'downgrader' ELSE 'upgrader' END"

ORACLE_SQL: dict[str, str] = {
    "masked_text": f"""WITH RECURSIVE {MESSAGES.strip()}, {_marks()},
ranked AS (SELECT *, row_number() OVER (PARTITION BY template ORDER BY length(phrase) DESC, subcategory) AS no FROM mark),
step AS (
  SELECT template, text, text AS left_, 0 AS no FROM m WHERE level > 0 AND recipient IS NOT NULL GROUP BY template, text
  UNION ALL SELECT s.template, s.text, CASE WHEN strpos(s.left_, r.phrase) > 0 THEN left(s.left_, strpos(s.left_, r.phrase) - 1) || repeat(' ', length(r.phrase)) || substring(s.left_, strpos(s.left_, r.phrase) + length(r.phrase)) ELSE s.left_ END, r.no
  FROM step s JOIN ranked r ON r.template = s.template AND r.no = s.no + 1
)
SELECT text, CAST(0 AS INTEGER) AS lost, regexp_replace(replace(arg_max(left_, no), '🎉', chr(57344) || chr(57345)), ' +', ' ', 'g') AS "left" FROM step GROUP BY text""",
    "surface_evidence": f"""{_WITH}, {_marks()} SELECT {_CATEGORY} AS category, subcategory, weight, false AS capped, count(*) AS rows FROM b JOIN mark USING (template) GROUP BY ALL""",
    "formatted_report": f"""{_WITH}
SELECT s.thread_id, s.ord, coalesce(printf('%.1f', floor(b.surface * 10 + 0.5) / 10), '—') AS surface_text, coalesce(printf('%.1f', floor(round(b.force, 9) * 10 + 0.5) / 10), '—') AS force_text,
  CASE WHEN b.gap IS NULL THEN '—' WHEN b.gap > 0 THEN printf('+%.1f', b.gap) ELSE printf('%.1f', b.gap) END AS gap_text, coalesce(CAST(CAST(floor(round(b.sure * 100, 6) + 0.5) AS BIGINT) AS VARCHAR) || '%', '—') AS confidence_text,
  CASE b.band WHEN 'aligned' THEN 'Aligned' WHEN 'under-phrased' THEN 'Under-phrased' WHEN 'over-phrased' THEN 'Over-phrased' WHEN 'mildly-under-phrased' THEN 'Mildly under-phrased' WHEN 'mildly-over-phrased' THEN 'Mildly over-phrased' END AS band_text,
  CASE s.suppressed WHEN 'no_head_act' THEN 'No request found in this message.' WHEN 'unresolved_addressee' THEN 'A request, but nobody it is addressed to.' END AS suppression_text,
  coalesce(b.force = 3, false) AS baseline_only
FROM s LEFT JOIN b ON b.thread_id = s.thread_id AND b.ord = s.ord""",
    "volume_bands": _volume(),
    "event_units": f"""{_BASIC} SELECT thread_id, ord, CAST(3 + 2 * length(regexp_replace(text, '[^;—]', '', 'g')) AS BIGINT) AS units FROM m""",
    "reduplication_hits": r"""WITH x AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+|[^a-z0-9_]+') AS w FROM documents)
SELECT doc_id FROM x WHERE len(list_filter(range(1, len(w) - 1), lambda i: w[i] = w[i + 2] AND regexp_matches(w[i], '^[a-z0-9_]') AND regexp_full_match(w[i + 1], '[\s\x0B]+'))) > 0""",
    "pair_checks": f"""WITH {_pairs()}
SELECT pair_id, family, round(surface_a, 6) AS surface_a, round(surface_b, 6) AS surface_b, round(force_a, 6) AS force_a, round(force_b, 6) AS force_b, stays, moves FROM checked""",
    "gap_direction": f"WITH {_pairs()} SELECT pair_id, round(gap_a, 1) AS gap_a, round(gap_b, 1) AS gap_b, direction FROM checked",
    "level_order": f"""WITH {_KEYS}, {_LEVEL_WORTH} SELECT level, key, level AS matched, surface, CASE WHEN level > 1 THEN true END AS below FROM level_worth""",
    "event_dedupe": f"WITH {_KEYS}, v(number, scenario, rows, events) AS (VALUES " + ", ".join(f"({i}, {_text(name)}, {n}, {events})" for i, (name, _, _, n, events) in enumerate(pairs.SCENARIOS)) + f") SELECT key, v.* EXCLUDE number FROM keys JOIN v ON number = key % {len(pairs.SCENARIOS)}",
    "determinism": "SELECT count(*) AS messages, CAST(count(*) AS BIGINT) AS identical FROM conversations",
    "release_report": _release_report(),
    "release_metrics": f"""{_WITH} SELECT "check", (SELECT count(*) FROM b) AS rows, CAST(0 AS BIGINT) AS failures FROM (SELECT unnest({_list(_CHECKS)}) AS "check")""",
    "thread_report": f"""{_WITH}
SELECT s.thread_id, s.ord, s.level AS level, round(b.surface, 6) AS surface, round(b.force, 6) AS force, round(b.gap, 1) AS gap, b.band,
  round(CAST(b.sure AS DOUBLE), 6) AS confidence, s.suppressed FROM s LEFT JOIN b ON b.thread_id = s.thread_id AND b.ord = s.ord""",
    "force_components": f"""{_WITH}
SELECT thread_id, ord, round(rung_part * k, 6) AS rung, round(near_part * k, 6) AS proximity, round(consequence * k, 6) AS consequence, round(dependency * k, 6) AS dependency, round(repeat_part * k, 6) AS escalation
FROM (SELECT *, CASE WHEN force = 10 THEN 7.0 / (rung_part + near_part + consequence + dependency + repeat_part) ELSE 1.0 END AS k FROM b)""",
    "band_distribution": f"""{_WITH}
SELECT b.band, s.suppressed, count(*) AS messages FROM s LEFT JOIN b ON b.thread_id = s.thread_id AND b.ord = s.ord GROUP BY ALL""",
    "head_act_levels": f"{_BASIC} SELECT level, name AS strategy, count(*) AS messages FROM m JOIN (VALUES {_LEVEL_NAMES}) AS l(no, name) ON l.no = m.level GROUP BY ALL",
    "suppression_counts": f"{_BASIC} SELECT CASE WHEN level = 0 THEN 'no_head_act' WHEN recipient IS NULL THEN 'unresolved_addressee' ELSE 'scored' END AS outcome, count(*) AS messages FROM m GROUP BY ALL",
    "widest_gap": f"""{_WITH}
SELECT thread_id, arg_max(ord, (abs(round(gap, 1)), -ord)) AS ord, round(arg_max(gap, (abs(round(gap, 1)), -ord)), 1) AS gap, count(*) AS scored FROM b GROUP BY thread_id""",
    "mention_chain": f"{_WITH} SELECT thread_id, ord, earlier, unanswered, accelerating FROM e WHERE suppressed IS NULL",
    "text_mentions": f"""WITH said AS (SELECT conv_id * 8 + turn AS place, min(coalesce(text, '')) AS text FROM conversations GROUP BY 1),
m AS (
  SELECT 'u' || (e.user_id % 7) AS thread_id, e.event_id AS ord, e.event_id % 5 AS who, epoch_us(e.ts) // 1000 AS ms, e.event_id % 97 = 0 AS done,
    CASE WHEN e.event_id % 2 = 0 THEN list_distinct(list_slice({_signature("coalesce(s.text, '')")}, 1, 6)) ELSE [] END AS sig
  FROM events e LEFT JOIN said s ON s.place = e.user_id % 211
), sigs AS (SELECT DISTINCT list_sort(sig) AS sig FROM m WHERE len(sig) > 0),
alike AS (SELECT a.sig AS one, b.sig AS other FROM sigs a, sigs b WHERE len(list_intersect(a.sig, b.sig)) >= 0.3 * len(list_distinct(list_concat(a.sig, b.sig)))),
r AS (SELECT thread_id, who, ord, ms, done, list_sort(sig) AS sig FROM m),
last_done AS (SELECT c.thread_id, c.ord, max(p.ord) AS reset FROM r c JOIN r p ON p.thread_id = c.thread_id AND p.done AND p.ord < c.ord AND p.who IN ((c.who + 1) % 5, (c.who + 2) % 5) WHERE len(c.sig) > 0 GROUP BY ALL),
pairs AS (
  SELECT c.thread_id, c.ord, c.who, c.ms, p.ord AS p_ord, p.ms AS p_ms, row_number() OVER (PARTITION BY c.thread_id, c.ord ORDER BY p.ord DESC) AS back
  FROM r c JOIN alike ON alike.one = c.sig JOIN r p ON p.thread_id = c.thread_id AND p.who = c.who AND p.sig = alike.other AND p.ord < c.ord
  LEFT JOIN last_done d ON d.thread_id = c.thread_id AND d.ord = c.ord WHERE p.ord > coalesce(d.reset, -1)
), chains AS (SELECT thread_id, ord, who, ms, count(*) AS earlier, max(p_ms) FILTER (back = 1) AS last_ms, coalesce(max(p_ms) FILTER (back = 2), -1) AS before_ms FROM pairs GROUP BY ALL)
SELECT thread_id, ord, earlier, last_ms, before_ms,
  NOT EXISTS (SELECT 1 FROM r p WHERE p.thread_id = c.thread_id AND p.ord < c.ord AND p.who IN ((c.who + 1) % 5, (c.who + 2) % 5) AND p.ms > c.last_ms AND p.ms < c.ms) AS unanswered FROM chains c""",
    "document_overlay": r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS size FROM documents),
c AS (SELECT doc_id, unnest(string_split_regex(text, '[A-Z][A-Za-z]*')) AS gap, generate_subscripts(string_split_regex(text, '[A-Z][A-Za-z]*'), 1) AS no, regexp_extract_all(text, '[A-Z][A-Za-z]*') AS words FROM d),
l AS (SELECT doc_id, no, length(gap) AS gap, coalesce(length(words[no]), 0) AS word, no <= len(words) AS hit FROM c),
w AS (SELECT doc_id, hit, CAST(sum(gap + word) OVER (PARTITION BY doc_id ORDER BY no) AS BIGINT) AS stop, word FROM l),
s AS (
  SELECT doc_id, stop - word AS start, stop, true AS is_word FROM w WHERE hit
  UNION ALL SELECT doc_id, (doc_id * 37 + k * 911) % size, least(size, (doc_id * 37 + k * 911) % size + 40 * k), false FROM d, range(8) r(k) WHERE size > 0
), b AS (SELECT doc_id, start AS spot FROM s UNION SELECT doc_id, stop FROM s UNION SELECT doc_id, 0 FROM d UNION SELECT doc_id, size FROM d),
p AS (SELECT doc_id, spot, lead(spot) OVER (PARTITION BY doc_id ORDER BY spot) AS next FROM b),
x AS (
  SELECT p.doc_id, p.spot, p.next, count(s.start) AS covering, count(*) FILTER (s.is_word) AS words
  FROM p LEFT JOIN s ON s.doc_id = p.doc_id AND s.start <= p.spot AND s.stop >= p.next WHERE p.next IS NOT NULL GROUP BY ALL
)
SELECT doc_id, CAST(covering AS INTEGER) AS covering, count(*) AS parts, CAST(sum(next - spot) AS BIGINT) AS chars, CAST(sum(words) AS BIGINT) AS words FROM x GROUP BY ALL""",
    "partition_overlap": f"{_WITH} SELECT count(*) AS messages, CAST(0 AS BIGINT) AS overlapping FROM b",
    "local_segments": r"""WITH p AS (SELECT conv_id, turn, string_split_regex(coalesce(text, ''), '(?i)[,;—]|\bbut\b') AS p FROM conversations)
SELECT conv_id, turn, len(p) AS segments, list_max(list_transform(p, lambda x: length(x))) AS longest FROM p""",
    "quoted_spans": f"""{_BASIC} SELECT thread_id, ord, len(regexp_extract_all(text, '"[^"]*"|“[^“”]*”')) AS quotations,
  CAST(coalesce(list_sum(list_transform(regexp_extract_all(text, '"[^"]*"|“[^“”]*”'), lambda x: length(x))), 0) AS BIGINT) AS quoted_chars FROM m""",
    "signature_tokens": f"{_BASIC} SELECT thread_id, ord, array_to_string({_signature('text')}, ' ') AS signature FROM m",
    "same_request_pairs": f"""{_BASIC}, x AS (SELECT thread_id, ord, sender, {_signature("text")} AS s FROM m)
SELECT a.thread_id, a.ord AS earlier, b.ord AS later, round(len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))), 6) AS jaccard
FROM x a JOIN x b ON a.thread_id = b.thread_id AND a.ord < b.ord AND a.sender = b.sender AND len(a.s) > 0 AND len(b.s) > 0
WHERE len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) >= 0.3""",
    "fixture_round_trip": f"SELECT item_id, {_list([*pairs.SURFACE_FAMILIES, *pairs.FORCE_FAMILIES])}[item_id % 6 + 1] AS family, text FROM benchmark",
    "rule_hits": _rule_hits(),
    "document_rule_hits": _document_rule_hits(),
    "labelled_levels": _labelled_levels(),
    "caps_hits": rf"""WITH x AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '\b[A-Z]{{3,}}\b'), lambda w: NOT list_contains({_list(rules.CAPS_EXCLUDED)}, w)) AS w FROM documents)
SELECT doc_id, len(w) AS capitals FROM x WHERE len(w) > 0""",
    "intent_guard": f"WITH {_KEYS} SELECT key, v.* FROM keys JOIN (VALUES (0, NULL), (1, 'sender_intent'), (2, 'sender_intent'), (3, 'intended_as'), (4, NULL), (5, 'reader_unmodalized'), (6, 'reader_will'), (7, NULL)) AS v(sample, claim) ON sample = key % 8",
    "proximity_bonus": "SELECT event_id, round(CASE WHEN h <= 0 THEN 1.5 WHEN h >= 336 THEN 0 ELSE 1.5 * exp(-h / 48) END, 9) AS bonus FROM (SELECT event_id, CAST(event_id % 400 - 20 AS DOUBLE) AS h FROM events)",
    "gap_bands": """WITH x AS (SELECT event_id, (event_id * 37 % 1001) / 100.0::DOUBLE AS force, (event_id * 53 % 1001) / 100.0::DOUBLE AS surface FROM events),
y AS (SELECT event_id, floor((floor(force * 10 + 0.5) / 10 - floor(surface * 10 + 0.5) / 10) * 10 + 0.5) / 10 AS gap FROM x)
SELECT event_id, round(gap, 1) AS gap, CASE WHEN gap >= 3 THEN 'under-phrased' WHEN gap >= 1 THEN 'mildly-under-phrased' WHEN gap > -1 THEN 'aligned' WHEN gap > -3 THEN 'mildly-over-phrased' ELSE 'over-phrased' END AS band FROM y""",
    "value_medians": """WITH x AS (
  SELECT 'user ' || user_id AS key, value FROM events UNION ALL SELECT 'type ' || event_type, value FROM events UNION ALL SELECT 'all', value FROM events
) SELECT key, count(*) AS n, list(value ORDER BY value)[count(*) // 2 + 1] AS median FROM x WHERE value IS NOT NULL AND isfinite(value) GROUP BY key""",
    "deadline_resolution": _deadlines(),
    "editor_threads": f"""SELECT CAST(conv_id AS VARCHAR) AS thread_id, turn AS ord, CASE WHEN turn % 2 = 0 THEN role ELSE 'Sender ' || (turn + 1) END AS sender_id, CASE WHEN turn % 3 = 0 THEN 0 ELSE 1 END AS recipients,
  strftime(make_timestamp(CAST(1767621600000 + turn * 3600000 AS BIGINT) * 1000), '%Y-%m-%dT%H:%M:%SZ') AS ts FROM conversations""",
}
