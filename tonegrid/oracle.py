"""SQL (DuckDB) for the queries over the fixture scores, from the tables alone.

At eight ticks per quarter the grids have closed forms, which stand here in place of the tables
that the Spark side looks values up in.
"""

from __future__ import annotations

from .config import CHORD_MAPS, PITCH_CLASSES

#: Which rows of compound tokens are spoiled, where, and how, in the queries of broken sequences.
OCTUPLE_SPOILED = {37: (2, "Bar_0"), 41: (1, "Position_0"), 43: (4, "Duration_None")}
CPWORD_SPOILED = {37: (1, "Position_3"), 41: (2, "Pitch_60")}
MUMIDI_SPOILED = {37: (2, "PositionPosEnc_0"), 41: (0, "Pitch_60"), 43: (0, "PAD_None")}

RAW = """notes_raw AS (
  SELECT l_suppkey AS score_id, CAST(l_linenumber - 1 AS INT) AS track_idx,
    CAST(CASE WHEN l_linenumber = 7 THEN -1 ELSE (l_linenumber - 1) * 8 END AS INT) AS program,
    (l_orderkey * 13 + l_linenumber * 11) % 61440 AS time, 30 + (l_partkey * 7 + l_linenumber * 53) % 1920 AS duration,
    CAST(15 + l_partkey % 100 AS INT) AS pitch, CAST(1 + CAST(l_quantity AS INT) * 2 AS INT) AS velocity
  FROM lineitem)"""
IN_RANGE = "CASE WHEN program = -1 THEN pitch >= 27 AND pitch < 88 ELSE pitch >= 21 AND pitch < 109 END"
VELOCITY = "CAST(4 * greatest(1, least(32, (velocity + 3) // 4)) - 1 AS INT)"


def at_eight(x: str) -> str:
    return f"CAST(round_even({x} / CAST(60 AS DOUBLE), 0) AS BIGINT)"


SNAP = "CASE WHEN ticks <= 32 THEN ticks WHEN ticks >= 96 THEN 96 ELSE ticks + ticks % 2 END"
SNAPPED = f"""snapped AS (
  SELECT score_id, track_idx, program, {at_eight("time")} AS time, greatest({at_eight("duration")}, 1) AS ticks, pitch, {VELOCITY} AS velocity
  FROM notes_raw WHERE {IN_RANGE})"""


def notes(duration: str = SNAP, dedup: bool = True) -> str:
    """CTEs up to ``notes``: prepared notes, of equal onset and pitch the shortest and softest."""
    once = "QUALIFY row_number() OVER (PARTITION BY score_id, track_idx, time, pitch ORDER BY duration, velocity) = 1" if dedup else ""
    return f"""WITH {RAW}, {SNAPPED},
lengths AS (SELECT score_id, track_idx, program, time, {duration} AS duration, pitch, velocity FROM snapped),
notes AS (SELECT * FROM lengths {once})"""


NOTES = notes()
ROWS = "score_id, program, time, duration, pitch, velocity"
ORDER = "time, track_idx, pitch, duration, velocity"


def span(d: str) -> str:
    return f"(CASE WHEN {d} < 32 THEN ({d}) // 8 || '.' || ({d}) % 8 || '.8' ELSE ({d}) // 8 || '.' || (({d}) % 8) // 2 || '.4' END)"


def shift(gap: str) -> str:
    """List of the time shifts that fill a gap, the largest first."""
    r = f"(({gap}) % 96)"
    return f"""list_concat(list_transform(range(({gap}) // 96), lambda x: 'TimeShift_12.0.4'),
    CASE WHEN {r} = 0 THEN CAST([] AS VARCHAR[]) WHEN {r} <= 32 OR {r} % 2 = 0 THEN ['TimeShift_' || {span(r)}]
    ELSE ['TimeShift_' || {span(f"({r} - 1)")}, 'TimeShift_0.1.8'] END)"""


PITCH = "(CASE WHEN program = -1 THEN 'PitchDrum_' ELSE 'Pitch_' END || pitch)"
LENGTH = f"'Duration_' || {span('duration')}"
NOTE = f"['Program_' || program, {PITCH}, 'Velocity_' || velocity, {LENGTH}]"


def laid_out(source: str, keys: str = "score_id", columns: str | None = None) -> str:
    """Rows (keys, pos, token) of ``source`` (keys, rn, toks)."""
    return f"""SELECT {columns or keys}, CAST(first + i - 1 AS BIGINT) AS pos, toks[i] AS token FROM (
  SELECT *, unnest(range(1, len(toks) + 1)) AS i FROM (
    SELECT *, sum(len(toks)) OVER (PARTITION BY {keys} ORDER BY rn) - len(toks) AS first FROM ({source})))"""


def stream(before: str, note: str = NOTE, keys: str = "score_id", order: str = ORDER) -> str:
    """Rows for :func:`laid_out`: one per note, with ``before`` (which may use prev, the onset before, or null) first."""
    return f"""SELECT *, list_concat({before}, {note}) AS toks FROM (
    SELECT *, lag(time) OVER w AS prev, row_number() OVER w AS rn FROM notes WINDOW w AS (PARTITION BY {keys} ORDER BY {order}))"""


GAP = "(time - coalesce(prev, 0))"
TSD = f"{NOTES} {laid_out(stream(shift(GAP)))}"
NEAREST = f"(CASE WHEN {GAP} <= 32 THEN {GAP} WHEN {GAP} >= 96 THEN 96 ELSE {GAP} + {GAP} % 2 END)"
STRUCTURED = f"{NOTES} {laid_out(stream(f'''[CASE WHEN {GAP} = 0 THEN 'TimeShift_0.0.1' ELSE 'TimeShift_' || {span(NEAREST)} END]'''))}"
NEW_BARS = "range(coalesce(prev // 32, -1) + 1, time // 32 + 1)"
REMI = f"""{NOTES} {laid_out(stream(f'''CASE WHEN prev = time THEN CAST([] AS VARCHAR[]) ELSE
  list_concat(list_transform({NEW_BARS}, lambda x: 'Bar_None'), ['Position_' || time % 32]) END'''))}"""
TRACK_NOTE = f"[{PITCH}, 'Velocity_' || velocity, {LENGTH}]"
TRACKS = f"""{NOTES} SELECT score_id, CAST(dense_rank() OVER (PARTITION BY score_id ORDER BY track_idx) - 1 AS INT) AS seq_idx, pos, token
FROM ({laid_out(stream(shift(GAP), NOTE, "score_id, track_idx"), "score_id, track_idx")})"""
MMM = f"""{NOTES}, bodies AS ({laid_out(stream(shift(GAP), TRACK_NOTE, "score_id, track_idx"), "score_id, track_idx", "score_id, track_idx, program")}),
whole AS (
  SELECT score_id, track_idx, 1 AS part, pos, token FROM bodies
  UNION ALL SELECT DISTINCT score_id, track_idx, 0, 0, 'Track_Start' FROM notes
  UNION ALL SELECT DISTINCT score_id, track_idx, 0, 1, 'Program_' || program FROM notes
  UNION ALL SELECT DISTINCT score_id, track_idx, 2, 0, 'Track_End' FROM notes)
SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY track_idx, part, pos) - 1 AS BIGINT) AS pos, token FROM whole"""
TICKS = notes("ticks")
MARKS = f"""{TICKS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY score_id, track_idx ORDER BY time, pitch, duration, velocity) AS seq FROM notes),
marks AS (
  SELECT score_id, track_idx, seq, time AS t, ['Program_' || program, CASE WHEN program = -1 THEN 'DrumOn_' ELSE 'NoteOn_' END || pitch, 'Velocity_' || velocity] AS own FROM numbered
  UNION ALL SELECT score_id, track_idx, seq, time + duration, ['Program_' || program, CASE WHEN program = -1 THEN 'DrumOff_' ELSE 'NoteOff_' END || pitch] FROM numbered)"""
MIDILIKE = f"""{MARKS} {laid_out(f'''SELECT *, list_concat({shift("(t - coalesce(prev, 0))")}, own) AS toks FROM (
  SELECT *, lag(t) OVER w AS prev, row_number() OVER w AS rn FROM marks WINDOW w AS (PARTITION BY score_id ORDER BY t, track_idx, seq))''')}"""
OCTUPLE = f"""{NOTES} SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY {ORDER}) - 1 AS BIGINT) AS pos,
  {PITCH} || ' Position_' || time % 32 || ' Bar_' || time // 32 || ' Velocity_' || velocity || ' ' || {LENGTH} || ' Program_' || program AS token FROM notes"""
EMPTY = "CAST([] AS VARCHAR[])"
IGNORED = " Ignore_None" * 4
CPWORD = f"""{NOTES} {laid_out(stream(f'''CASE WHEN prev = time THEN {EMPTY} ELSE list_concat(
  list_transform({NEW_BARS}, lambda x: 'Family_Metric Bar_None{IGNORED}'), ['Family_Metric Position_' || time % 32 || '{IGNORED}']) END''',
  f"['Family_Note Ignore_None ' || {PITCH} || ' Velocity_' || velocity || ' ' || {LENGTH} || ' Program_' || program]"))}"""
PLACE = "'BarPosEnc_' || time // 32 || ' PositionPosEnc_' || time % 32"
MUMIDI = f"""{NOTES} {laid_out(f'''SELECT *, list_concat(
    CASE WHEN prev = time THEN {EMPTY} ELSE list_concat(list_transform({NEW_BARS}, lambda x: 'Bar_None BarPosEnc_' || x || ' PositionPosEnc_None'), ['Position_' || time % 32 || ' ' || {PLACE}]) END,
    CASE WHEN prev = time AND before = program THEN {EMPTY} ELSE ['Program_' || program || ' ' || {PLACE}] END,
    [{PITCH} || ' ' || {PLACE} || ' Velocity_' || velocity || ' ' || {LENGTH}]) AS toks FROM (
    SELECT *, lag(time) OVER w AS prev, lag(program) OVER w AS before, row_number() OVER w AS rn FROM notes WINDOW w AS (PARTITION BY score_id ORDER BY time, program, pitch, duration, velocity))''')}"""


def rest(gap: str) -> str:
    """List of the rests that fill a gap: two-beat halves above two beats, quarters above one, eighths below."""
    whole, left = f"(({gap}) // 96)", f"(({gap}) % 96)"
    big = f"(CASE WHEN {left} >= 16 THEN {left} - {left} % 4 WHEN {left} >= 8 THEN {left} - {left} % 2 ELSE {left} END)"
    name = f"(CASE WHEN {big} >= 16 THEN {big} // 8 || '.' || ({big} % 8) // 4 || '.2' WHEN {big} >= 8 THEN '1.' || ({big} - 8) // 2 || '.4' ELSE '0.' || {big} || '.8' END)"
    small = f"({left} - {big})"
    return f"""list_concat(list_transform(range({whole}), lambda x: 'Rest_12.0.2'), CASE WHEN {big} > 0 THEN ['Rest_' || {name}] ELSE {EMPTY} END,
    CASE WHEN {small} > 0 THEN ['Rest_0.' || {small} || '.8'] ELSE {EMPTY} END)"""


SOUNDED = """sounded AS (SELECT *, lag(time) OVER w AS prev, row_number() OVER w AS rn,
  coalesce(max(time + duration) OVER (PARTITION BY score_id ORDER BY time, track_idx, pitch, duration, velocity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS reach
  FROM notes WINDOW w AS (PARTITION BY score_id ORDER BY time, track_idx, pitch, duration, velocity))"""
IDLE = "(time - reach)"
TSD_RESTS = f"""{NOTES}, {SOUNDED} {laid_out(f'''SELECT *, list_concat(CASE WHEN {GAP} = 0 THEN {EMPTY} WHEN {IDLE} >= 1 THEN {rest(IDLE)} ELSE {shift(GAP)} END, {NOTE}) AS toks FROM sounded''')}"""
REMI_RESTS = f"""{NOTES}, {SOUNDED} {laid_out(f'''SELECT *, list_concat(CASE WHEN prev = time THEN {EMPTY} ELSE list_concat(
  CASE WHEN {IDLE} >= 1 THEN {rest(IDLE)} ELSE {EMPTY} END,
  list_transform(range(greatest(coalesce(prev // 32, -1), CASE WHEN {IDLE} >= 1 THEN time // 32 ELSE -1 END) + 1, time // 32 + 1), lambda x: 'Bar_None'), ['Position_' || time % 32]) END, {NOTE}) AS toks FROM sounded''')}"""

SPAN_ID = "(CASE WHEN d < 32 THEN d - 1 ELSE 31 + (d - 32) // 2 END)"
PARTS = "string_split(substr(token, instr(token, '_') + 1), '.')"
TICKS_OF = f"(CAST({PARTS}[1] AS INT) * 8 + CAST({PARTS}[2] AS INT) * 8 // CAST({PARTS}[3] AS INT))"
VALUE = "CAST(substr(token, instr(token, '_') + 1) AS INT)"
ID = f"""CASE split_part(token, '_', 1) WHEN 'Pitch' THEN {VALUE} - 17 WHEN 'Velocity' THEN 91 + ({VALUE} + 1) // 4
  WHEN 'Duration' THEN 124 + {SPAN_ID} WHEN 'TimeShift' THEN 188 + {SPAN_ID} WHEN 'PitchDrum' THEN 225 + {VALUE} WHEN 'Program' THEN 314 + {VALUE} END"""
TOKEN_IDS = f"""WITH toks AS ({TSD}), spans AS (SELECT *, CASE WHEN token LIKE 'Duration%' OR token LIKE 'TimeShift%' THEN {TICKS_OF} END AS d FROM toks)
SELECT score_id, pos, CAST({ID.replace(VALUE, f"try_cast(substr(token, instr(token, '_') + 1) AS INT)")} AS INT) AS id FROM spans"""

FOUR = "(VALUES (0), (1), (2), (3)) AS t(k)"
TEMPOS = f"tempos_raw AS (SELECT s_suppkey AS score_id, CAST(k AS INT) AS seq, CAST(k * 15360 AS BIGINT) AS time, CAST(60000000 AS DOUBLE) / (40 + (s_suppkey * 17 + k * 29) % 211) AS mspq FROM supplier CROSS JOIN {FOUR})"
SIGNATURES = f"""signatures_raw AS (SELECT s_suppkey AS score_id, CAST(k AS INT) AS seq, CAST(k * 15360 + (k * s_suppkey) % 400 AS BIGINT) AS time,
  CAST(CASE (s_suppkey + k) % 4 WHEN 0 THEN 4 WHEN 1 THEN 3 WHEN 2 THEN 6 ELSE 2 END AS INT) AS num, CAST(CASE (s_suppkey + k) % 4 WHEN 2 THEN 8 ELSE 4 END AS INT) AS den
  FROM supplier CROSS JOIN {FOUR})"""
PEDALS = "pedals_raw AS (SELECT l_suppkey AS score_id, 0 AS program, (l_orderkey * 13) % 61440 AS time, 100 + l_partkey % 700 AS duration FROM lineitem WHERE l_linenumber = 1)"
BENDS = "bends_raw AS (SELECT l_suppkey AS score_id, 8 AS program, (l_orderkey * 13) % 61440 AS time, CAST((l_partkey * 37) % 16384 - 8192 AS INT) AS value FROM lineitem WHERE l_linenumber = 2)"
QPM = "round_even((40 + 210 / CAST(31 AS DOUBLE) * i) * 100, 0) / 100"
SNAPPED_TEMPOS = f"""{TEMPOS}, grid AS (SELECT {QPM} AS qpm, CAST(floor(60000000 / ({QPM})) AS BIGINT) AS m FROM range(32) AS r(i)),
near AS (SELECT score_id, seq, time, arg_min(qpm, abs(m - CAST(floor(mspq) AS BIGINT)) * 10000000 - m) AS qpm FROM tempos_raw CROSS JOIN grid GROUP BY score_id, seq, time)"""
TEMPOS_SNAPPED = f"WITH {SNAPPED_TEMPOS} SELECT score_id, CAST(time // 60 AS BIGINT) AS time, qpm FROM near"
BENDS_SNAPPED = f"""WITH {BENDS}, grid AS (SELECT CAST(floor(-8192 + 16383 / CAST(31 AS DOUBLE) * i) AS INT) AS b FROM range(32) AS r(i)),
near AS (SELECT score_id, program, {at_eight("time")} AS time, (SELECT arg_min(b, abs(b - value) * 100000 - b) FROM grid) AS value FROM bends_raw)
SELECT score_id, program, time, value FROM near QUALIFY row_number() OVER (PARTITION BY score_id, program, time ORDER BY abs(value) DESC, value DESC) = 1"""
PEDALS_MERGED = f"""WITH {PEDALS}, reach AS (SELECT *, max(time + duration) OVER (PARTITION BY score_id ORDER BY time, duration ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM pedals_raw),
islands AS (SELECT *, sum(CASE WHEN r >= time THEN 0 ELSE 1 END) OVER (PARTITION BY score_id ORDER BY time, duration) AS island FROM reach)
SELECT score_id, program, min(time) AS time, max(time + duration) - min(time) AS duration FROM islands GROUP BY score_id, program, island"""
DEDUP = f"WITH {RAW} SELECT {ROWS} FROM notes_raw QUALIFY row_number() OVER (PARTITION BY score_id, track_idx, time, pitch ORDER BY duration, velocity) = 1"
OVERLAPS = f"""WITH {RAW}, once AS (SELECT * FROM notes_raw QUALIFY row_number() OVER (PARTITION BY score_id, track_idx, time, pitch ORDER BY duration, velocity) = 1),
ahead AS (SELECT *, lead(time) OVER (PARTITION BY score_id, track_idx, pitch ORDER BY time, duration, velocity) AS next FROM once)
SELECT score_id, program, time, CASE WHEN next <= time + duration THEN next - time ELSE duration END AS duration, pitch, velocity FROM ahead"""


def ticks(step: int) -> str:
    return f"""{NOTES}, lasts AS (SELECT score_id, greatest(max(time), 1) AS last FROM notes GROUP BY score_id)
SELECT score_id, n, n * {step} AS tick FROM (SELECT score_id, unnest(range(0, (last + {step} - 1) // {step})) AS n FROM lasts)"""


INTERVALS = f"""{NOTES}, a AS (SELECT *, lag(time) OVER w AS t0, lag(pitch) OVER w AS p0, row_number() OVER w AS rn FROM notes WINDOW w AS (PARTITION BY score_id, track_idx ORDER BY time, pitch, duration, velocity)),
b AS (SELECT *, CASE WHEN t0 IS NULL OR t0 <> time OR abs(pitch - p0) > 16 THEN pitch END AS opened FROM a),
c AS (SELECT *, last_value(opened IGNORE NULLS) OVER (PARTITION BY score_id, track_idx ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ref FROM b),
d AS (SELECT *, CASE WHEN program = -1 OR t0 IS NULL THEN 'none' WHEN t0 <> time AND time - t0 <= 8 AND abs(pitch - ref) <= 16 THEN 'PitchIntervalTime'
  WHEN t0 = time AND abs(pitch - p0) <= 16 THEN 'PitchIntervalChord' ELSE 'none' END AS interval_type FROM c)
SELECT score_id, program, time, pitch, interval_type, CAST(CASE interval_type WHEN 'PitchIntervalTime' THEN pitch - ref WHEN 'PitchIntervalChord' THEN pitch - p0 ELSE 0 END AS INT) AS interval FROM d"""
CHANGES = f"""{NOTES}, a AS (SELECT *, lag(program, 1, -2) OVER (PARTITION BY score_id ORDER BY {ORDER}) AS before, row_number() OVER (PARTITION BY score_id ORDER BY {ORDER}) AS rn FROM notes)
SELECT score_id, row_number() OVER (PARTITION BY score_id ORDER BY rn) - 1 AS nth, time, program FROM a WHERE before <> program"""
TEMPO_NAME = "regexp_replace(printf('%.2f', qpm), '0$', '')"
EVENTS = f"""{NOTES}, a AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY {ORDER}) AS rn FROM notes),
b AS (SELECT score_id, rn, time, unnest(range(1, 5)) AS i, {NOTE} AS toks FROM a)
SELECT score_id, CAST((rn - 1) * 4 + i - 1 AS BIGINT) AS pos, time, split_part(toks[i], '_', 1) AS type, substr(toks[i], instr(toks[i], '_') + 1) AS value FROM b"""
COMPOUND_IDS = f"""{NOTES}, a AS (SELECT *, CAST(row_number() OVER (PARTITION BY score_id ORDER BY {ORDER}) - 1 AS BIGINT) AS pos FROM notes),
b AS (SELECT score_id, pos, unnest(range(6)) AS k, [CASE WHEN program = -1 THEN 92 + pitch - 27 ELSE 4 + pitch - 21 END, 4 + time % 32, 4 + time // 32, 3 + (velocity + 1) // 4,
  4 + CASE WHEN duration < 32 THEN duration - 1 ELSE 31 + (duration - 32) // 2 END, 5 + program] AS v FROM a)
SELECT score_id, pos, CAST(k AS INT) AS vocab_idx, CAST(v[k + 1] AS INT) AS id FROM b"""
TYPES = """(VALUES ('PAD', 1), ('BOS', 1), ('EOS', 1), ('MASK', 1), ('Pitch', 88), ('Velocity', 32), ('Duration', 64), ('TimeShift', 64), ('PitchDrum', 61), ('Program', 129)) AS t(type, n_ids)"""
TYPES_USED = f"""SELECT score_id, type, CAST(n_ids AS BIGINT) AS n_ids, count(DISTINCT token) AS n_used, count(*) AS n_tokens
FROM (SELECT *, split_part(token, '_', 1) AS type FROM ({TSD})) JOIN {TYPES} USING (type) GROUP BY score_id, type, n_ids"""
PAIRS = f"""WITH {RAW}, ons AS (SELECT *, row_number() OVER (PARTITION BY score_id, program, pitch ORDER BY time, velocity) AS k FROM notes_raw),
offs AS (SELECT score_id, program, pitch, time + duration AS stop, row_number() OVER (PARTITION BY score_id, program, pitch ORDER BY time + duration) AS k FROM notes_raw)
SELECT score_id, program, time, stop - time AS duration, pitch, velocity FROM ons JOIN offs USING (score_id, program, pitch, k)"""
REPEATED = f"""{notes(dedup=False)}, a AS (SELECT score_id, row_number() OVER (PARTITION BY score_id, time, program, pitch ORDER BY duration, velocity) AS n FROM notes)
SELECT score_id, CAST(sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_errors FROM a GROUP BY score_id"""


# Every score of the fixtures has a signature in eighths, so 16 ticks a quarter; each moves to the next bar line of the one before.
ALIGNED = f"""{SIGNATURES}, s AS (SELECT *, time // 30 AS t, 64 // den * num AS bar FROM signatures_raw),
wide AS (SELECT score_id, {", ".join(f"max(CASE WHEN seq = {k} THEN {c} END) AS {c}{k}" for k in range(4) for c in ("t", "bar", "num", "den"))} FROM s GROUP BY score_id),
one AS (SELECT *, t0 AS x0, t0 + (t1 - t0 + bar0 - 1) // bar0 * bar0 AS x1 FROM wide),
two AS (SELECT *, x1 + (t2 - x1 + bar1 - 1) // bar1 * bar1 AS x2 FROM one),
aligned AS (SELECT *, x2 + (t3 - x2 + bar2 - 1) // bar2 * bar2 AS x3 FROM two)"""
SIGNATURES_ALIGNED = f"""WITH {ALIGNED} SELECT score_id, CAST(k AS INT) AS seq, CAST([x0, x1, x2, x3][k + 1] AS BIGINT) AS time,
  CAST([num0, num1, num2, num3][k + 1] AS INT) AS num, CAST([den0, den1, den2, den3][k + 1] AS INT) AS den FROM aligned CROSS JOIN {FOUR}"""


def in_section(column: str, time: str) -> str:
    """The value that a column of ``aligned`` has for the section of a tick."""
    return f"(CASE WHEN {time} >= x3 THEN {column}3 WHEN {time} >= x2 THEN {column}2 WHEN {time} >= x1 THEN {column}1 ELSE {column}0 END)"


def at_sixteen(x: str) -> str:
    return f"CAST(round_even({x} / CAST(30 AS DOUBLE), 0) AS BIGINT)"


FINE = "CASE WHEN ticks >= 192 THEN 192 WHEN ticks > 64 THEN (ticks + 2) // 4 * 4 ELSE ticks + ticks % 2 END"
# Ranges of equal grids: two ticks to a position in quarters, one in eighths; at most four, numbered by the changes between them.
RESNAPPED = f"""WITH {RAW}, {ALIGNED},
f AS (SELECT score_id, [x0, x1, x2, x3] AS x, [8 // den0, 8 // den1, 8 // den2, 8 // den3] AS g FROM aligned),
r AS (SELECT score_id, x, g, [0, CASE WHEN g[2] <> g[1] THEN 1 ELSE 0 END, CASE WHEN g[2] <> g[1] THEN 1 ELSE 0 END + CASE WHEN g[3] <> g[2] THEN 1 ELSE 0 END,
  CASE WHEN g[2] <> g[1] THEN 1 ELSE 0 END + CASE WHEN g[3] <> g[2] THEN 1 ELSE 0 END + CASE WHEN g[4] <> g[3] THEN 1 ELSE 0 END] AS k FROM f),
placed AS (SELECT n.*, {at_sixteen("time")} AS t, greatest({at_sixteen("duration")}, 1) AS ticks, {VELOCITY} AS loud FROM notes_raw n WHERE {IN_RANGE}),
found AS (SELECT p.*, r.x, r.g, r.k AS ks, CASE WHEN t >= x[4] THEN 4 WHEN t >= x[3] THEN 3 WHEN t >= x[2] THEN 2 ELSE 1 END AS i FROM placed p JOIN r USING (score_id)),
own AS (SELECT *, ks[i] AS k, g[i] AS f, CAST(round_even(t / CAST(g[i] AS DOUBLE), 0) AS BIGINT) * g[i] AS at_tick, CAST(round_even(ticks / CAST(g[i] AS DOUBLE), 0) AS BIGINT) * g[i] AS d FROM found),
long AS (SELECT *, CASE WHEN d = 0 THEN f ELSE d END AS len FROM own),
seen AS (SELECT *, count(*) OVER tr AS n, max(at_tick) OVER tr AS last, row_number() OVER (PARTITION BY score_id, track_idx, program ORDER BY t, pitch, len, loud) - 1 AS nth,
  [count(*) FILTER (WHERE k <= 0) OVER tr, count(*) FILTER (WHERE k <= 1) OVER tr, count(*) FILTER (WHERE k <= 2) OVER tr, count(*) FILTER (WHERE k <= 3) OVER tr] AS upto,
  [min(at_tick) FILTER (WHERE k > 0) OVER tr, min(at_tick) FILTER (WHERE k > 1) OVER tr, min(at_tick) FILTER (WHERE k > 2) OVER tr, NULL] AS next
  FROM long WINDOW tr AS (PARTITION BY score_id, track_idx, program)),
picked AS (SELECT *, coalesce(list_filter(range(k, ks[4] + 1), lambda j: CASE WHEN j = ks[4] THEN n - 1 ELSE least(upto[j + 1], n - 1) END >= at_tick)[1], ks[4]) AS j FROM seen),
moved AS (SELECT score_id, track_idx, program, at_tick AS time, pitch, loud AS velocity, g[list_position(ks, j)] AS ff, len,
  k < ks[4] AND nth < least(upto[k + 1], n - 1) AND at_tick + len >= coalesce(next[k + 1], last) AS reaches FROM picked),
ended AS (SELECT * EXCLUDE (len), CASE WHEN reaches THEN CAST(round_even((time + len) / CAST(ff AS DOUBLE), 0) AS BIGINT) * ff - time ELSE len END AS duration FROM moved)
SELECT {ROWS} FROM ended QUALIFY row_number() OVER (PARTITION BY score_id, track_idx, time, pitch ORDER BY duration, velocity) = 1"""
SIGNED_NOTES = f"""{RAW}, {ALIGNED},
placed AS (SELECT n.score_id, track_idx, program, {at_sixteen("time")} AS t, greatest({at_sixteen("duration")}, 1) AS ticks, pitch, {VELOCITY} AS velocity FROM notes_raw n WHERE {IN_RANGE}),
gridded AS (SELECT p.*, a.*, CASE WHEN {in_section("den", "t")} = 4 THEN CAST(round_even(t / CAST(2 AS DOUBLE), 0) AS BIGINT) * 2 ELSE t END AS at_tick
  FROM placed p JOIN (SELECT score_id AS of_score, x1, x2, x3, den0, den1, den2, den3 FROM aligned) a ON p.score_id = a.of_score),
lasting AS (SELECT score_id, track_idx, program, at_tick AS time, CASE WHEN {in_section("den", "at_tick")} = 4 THEN {FINE} ELSE {SNAP} END AS duration, pitch, velocity FROM gridded),
notes AS (SELECT * FROM lasting QUALIFY row_number() OVER (PARTITION BY score_id, track_idx, time, pitch ORDER BY duration, velocity) = 1)"""
PREPARED_SIGNATURES = f"WITH {SIGNED_NOTES} SELECT {ROWS} FROM notes"
# Events of scores with signatures and tempos: each with its section (a signature has that which it ends), the bar it falls in and the place in it.
TEMPO_NAMED = "regexp_replace(printf('%.2f', qpm), '0$', '')"
SIGNED_EVENTS = f"""{SIGNED_NOTES}, {SNAPPED_TEMPOS},
lines AS (SELECT score_id, [x0, x1, x2, x3] AS x, [bar0, bar1, bar2, bar3] AS len, [num0, num1, num2, num3] AS num, [den0, den1, den2, den3] AS den,
  [0, (x1 - x0) // bar0, (x1 - x0) // bar0 + (x2 - x1) // bar1, (x1 - x0) // bar0 + (x2 - x1) // bar1 + (x3 - x2) // bar2] AS fb FROM aligned),
happening AS (
  SELECT score_id, x[k + 1] AS time, -1 AS track_idx, 0 AS src, k AS seq, 0 AS pitch, 0 AS duration, 0 AS velocity, 0 AS program, ['TimeSig_' || num[k + 1] || '/' || den[k + 1]] AS own FROM lines CROSS JOIN {FOUR}
  UNION ALL SELECT score_id, time // 30, -1, 1, seq, 0, 0, 0, 0, ['Tempo_' || {TEMPO_NAMED}] FROM near
  UNION ALL SELECT score_id, time, track_idx, 6, 0, pitch, duration, velocity, program, [] FROM notes),
located AS (SELECT h.*, l.*, CASE WHEN time - s >= x[4] THEN 4 WHEN time - s >= x[3] THEN 3 WHEN time - s >= x[2] THEN 2 ELSE 1 END AS i
  FROM (SELECT *, CASE WHEN src = 0 THEN 1 ELSE 0 END AS s FROM happening) h JOIN (SELECT score_id AS of_score, * EXCLUDE (score_id) FROM lines) l ON h.score_id = l.of_score),
events AS (SELECT score_id, time, track_idx, src, seq, pitch, duration, velocity, program, fb[i] + (time - x[i]) // len[i] AS bar, (time - x[i]) % len[i] // (CASE WHEN den[i] = 4 THEN 2 ELSE 1 END) AS place,
  num[i] || '/' || den[i] AS signature, CASE WHEN src < 6 THEN own ELSE ['Program_' || program, {PITCH}, 'Velocity_' || velocity, 'Duration_' || {span("(duration // CASE WHEN den[i] = 4 THEN 2 ELSE 1 END)")}] END AS own FROM located)"""
EVENT_ORDER = "time, track_idx, src, seq, pitch, duration, velocity"
REMI_SIGNATURES = f"""WITH {SIGNED_EVENTS} {laid_out(f'''SELECT *, list_concat(CASE WHEN prev IS NULL OR prev <> time OR prev_src = 0 THEN list_concat(
  flatten(list_transform(range(coalesce(done, -1) + 1, bar + 1), lambda n: CASE WHEN src = 0 AND n = bar THEN ['Bar_None'] ELSE ['Bar_None', 'TimeSig_' || signature] END)),
  CASE WHEN src = 0 THEN {EMPTY} ELSE ['Position_' || place] END) ELSE {EMPTY} END, own) AS toks FROM (
  SELECT *, lag(time) OVER w AS prev, lag(src) OVER w AS prev_src, lag(bar) OVER w AS done, row_number() OVER w AS rn FROM events WINDOW w AS (PARTITION BY score_id ORDER BY {EVENT_ORDER}))''')}"""
OCTUPLE_SIGNATURES = f"""WITH {SIGNED_EVENTS}, tuned AS (SELECT *, coalesce(last_value(CASE WHEN src = 1 THEN own[1] END IGNORE NULLS) OVER (PARTITION BY score_id ORDER BY {EVENT_ORDER}
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'none') AS tempo FROM events)
SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY {EVENT_ORDER}) - 1 AS BIGINT) AS pos,
  own[2] || ' Position_' || place || ' Bar_' || bar || ' ' || own[3] || ' ' || own[4] || ' ' || own[1] || ' ' || tempo || ' TimeSig_' || signature AS token FROM tuned WHERE src = 6"""


# Streams with rests, tempos, signatures, pedals and bends: everything that happens, by the tick, with what it keeps sounding (reach).
SECTION_OF = "CASE WHEN {t} >= x[4] THEN 4 WHEN {t} >= x[3] THEN 3 WHEN {t} >= x[2] THEN 2 ELSE 1 END"
ON_GRID = f"CASE WHEN den[{SECTION_OF.format(t='t')}] = 4 THEN CAST(round_even(t / CAST(2 AS DOUBLE), 0) AS BIGINT) * 2 ELSE t END"
EFFECTS = f"""{PEDALS}, {BENDS},
lines AS (SELECT score_id, [x0, x1, x2, x3] AS x, [bar0, bar1, bar2, bar3] AS len, [num0, num1, num2, num3] AS num, [den0, den1, den2, den3] AS den,
  [0, (x1 - x0) // bar0, (x1 - x0) // bar0 + (x2 - x1) // bar1, (x1 - x0) // bar0 + (x2 - x1) // bar1 + (x3 - x2) // bar2] AS fb FROM aligned),
trod AS (SELECT score_id, {ON_GRID} AS time, d FROM (SELECT score_id, {at_sixteen("time")} AS t, greatest({at_sixteen("duration")}, 1) AS d FROM pedals_raw) JOIN lines USING (score_id)),
trod_reach AS (SELECT *, max(time + d) OVER (PARTITION BY score_id ORDER BY time, d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM trod),
trod_islands AS (SELECT *, sum(CASE WHEN r >= time THEN 0 ELSE 1 END) OVER (PARTITION BY score_id ORDER BY time, d) AS island FROM trod_reach),
pedals AS (SELECT score_id, min(time) AS time, max(time + d) AS stop FROM trod_islands GROUP BY score_id, island),
bins AS (SELECT CAST(floor(-8192 + 16383 / CAST(31 AS DOUBLE) * i) AS INT) AS b FROM range(32) AS r(i)),
bent AS (SELECT score_id, {ON_GRID} AS time, value FROM (SELECT score_id, {at_sixteen("time")} AS t, (SELECT arg_min(b, abs(b - value) * 100000 - b) FROM bins) AS value FROM bends_raw) JOIN lines USING (score_id)),
bends AS (SELECT * FROM bent QUALIFY row_number() OVER (PARTITION BY score_id, time ORDER BY abs(value) DESC, value DESC) = 1)"""


def full_events(notes: str, note_rows: str) -> str:
    """CTEs up to ``steps``: the rows of all events with what came before; ``note_rows`` selects those of the notes."""
    order = "time, track_idx, src, seq, sub"
    return f"""{notes}, {SNAPPED_TEMPOS}, {EFFECTS},
numbered AS (SELECT *, row_number() OVER (PARTITION BY score_id, track_idx ORDER BY time, pitch, duration, velocity) AS seq FROM notes),
happening AS (
  SELECT score_id, x[k + 1] AS time, -1 AS track_idx, 0 AS src, k AS seq, 0 AS sub, ['TimeSig_' || num[k + 1] || '/' || den[k + 1]] AS own, x[k + 1] AS reach FROM lines CROSS JOIN {FOUR}
  UNION ALL SELECT score_id, time // 30, -1, 1, seq, 0, ['Tempo_' || {TEMPO_NAMED}], time // 30 FROM near
  UNION ALL SELECT score_id, time, 0, 3, row_number() OVER (PARTITION BY score_id ORDER BY time, stop), 0, ['Pedal_0'], time FROM pedals
  UNION ALL SELECT score_id, stop, 0, 3, row_number() OVER (PARTITION BY score_id ORDER BY time, stop), 1, ['PedalOff_0'], stop FROM pedals
  UNION ALL SELECT score_id, time, 1, 4, row_number() OVER (PARTITION BY score_id ORDER BY time, value), 0, ['Program_8', 'PitchBend_' || value], time FROM bends
  UNION ALL {note_rows}),
located AS (SELECT h.*, l.* EXCLUDE (score_id), {SECTION_OF.format(t="(h.time - CASE WHEN src = 0 THEN 1 ELSE 0 END)")} AS i FROM happening h JOIN lines l ON h.score_id = l.score_id),
steps AS (SELECT *, CASE WHEN den[i] = 4 THEN 2 ELSE 1 END AS f, fb[i] + (time - x[i]) // len[i] AS bar, (time - x[i]) % len[i] // (CASE WHEN den[i] = 4 THEN 2 ELSE 1 END) AS place, num[i] || '/' || den[i] AS signature,
  lag(time) OVER w AS prev, lag(src) OVER w AS prev_src, lag(fb[i] + (time - x[i]) // len[i]) OVER w AS done, row_number() OVER w AS rn,
  time - coalesce(max(reach) OVER (PARTITION BY score_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS idle FROM located WINDOW w AS (PARTITION BY score_id ORDER BY {order}))"""


NAMED_NOTE = f"['Program_' || n.program, CASE WHEN n.program = -1 THEN 'PitchDrum_' ELSE 'Pitch_' END || pitch, 'Velocity_' || velocity, 'Duration_' || {span('(duration // CASE WHEN den[s] = 4 THEN 2 ELSE 1 END)')}]"
HELD_NOTES = f"""SELECT n.score_id, time, track_idx, 6, seq, 0, {NAMED_NOTE}, time + duration FROM (SELECT m.*, den, {SECTION_OF.format(t="m.time")} AS s FROM numbered m JOIN lines USING (score_id)) n"""
STRUCK_NOTES = """SELECT score_id, time, track_idx, 6, seq, 0, ['Program_' || program, CASE WHEN program = -1 THEN 'DrumOn_' ELSE 'NoteOn_' END || pitch, 'Velocity_' || velocity], time + duration FROM numbered
  UNION ALL SELECT score_id, time + duration, track_idx, 6, seq, 3, ['Program_' || program, CASE WHEN program = -1 THEN 'DrumOff_' ELSE 'NoteOff_' END || pitch], time + duration FROM numbered"""
RESTED = "CASE WHEN prev = time THEN [] WHEN coalesce(prev, 0) = time THEN [] WHEN idle >= f THEN list_concat({rest}, {left}) ELSE {gap} END".format(rest=rest("(idle // f)"), left=shift("(idle % f // f)"), gap=shift("((time - coalesce(prev, 0)) // f)"))
TSD_FULL = f"WITH {full_events(SIGNED_NOTES, HELD_NOTES)} {laid_out(f'SELECT score_id, rn, list_concat({RESTED}, own) AS toks FROM steps')}"
# Signatures don't keep anything sounding here; a length is that of notes whose ends were moved.
RESNAPPED_NOTES = RESNAPPED.removeprefix("WITH ").rpartition("SELECT")[0].rstrip() + ", notes AS (SELECT * FROM ended QUALIFY row_number() OVER (PARTITION BY score_id, track_idx, time, pitch ORDER BY duration, velocity) = 1)"
MIDILIKE_FULL = f"WITH {full_events(RESNAPPED_NOTES, STRUCK_NOTES).replace('AS own, x[k + 1] AS reach', 'AS own, CAST(NULL AS BIGINT) AS reach')} {laid_out(f'SELECT score_id, rn, list_concat({RESTED}, own) AS toks FROM steps')}"
MOVED = "(prev IS NULL OR prev <> time OR prev_src = 0)"
REACHED = "(fb[i] + (time - idle % f - x[i]) // len[i])"
REMI_FULL = f"""WITH {full_events(SIGNED_NOTES, HELD_NOTES)} {laid_out(f'''SELECT score_id, rn, list_concat(CASE WHEN {MOVED} THEN list_concat(CASE WHEN idle >= f THEN {rest("(idle // f)")} ELSE {EMPTY} END,
  flatten(list_transform(range(greatest(coalesce(done, -1), CASE WHEN idle >= f THEN {REACHED} ELSE -1 END) + 1, bar + 1), lambda n: CASE WHEN src = 0 AND n = bar THEN ['Bar_None'] ELSE ['Bar_None', 'TimeSig_' || signature] END)),
  CASE WHEN src = 0 THEN {EMPTY} ELSE ['Position_' || place] END) ELSE {EMPTY} END, own) AS toks FROM steps''')}"""


def no_errors(sql: str) -> str:
    return f"SELECT score_id, CAST(sum(1) AS BIGINT) AS n_tokens, CAST(0 AS BIGINT) AS n_errors FROM ({sql}) GROUP BY score_id"


def errors_broken(sql: str, legal: str, on_off: bool = False, by_track: bool = False, damaged: bool = True) -> str:
    """Errors of sequences, with missing and repeated tokens if ``damaged``; ``legal`` lists which type may follow which.

    ``by_track`` cuts them before every ``Track_Start`` and judges each track by itself.
    """
    pairs = ", ".join(f"'{a}>{b}'" for group in legal.split() for a, ends in [group.split(">")] for b in ends.split(","))
    so_far = "OVER (PARTITION BY score_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    # A track is judged under a number of its own, that of its score and its place in it.
    cut = """tracks AS (SELECT score_id * 1000 + greatest(sum(CASE WHEN token = 'Track_Start' THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY pos, copy ROWS UNBOUNDED PRECEDING) - 1, 0) AS score_id, pos, copy, token FROM once),
"""
    cut, source = (cut, "tracks WHERE token NOT LIKE 'Track_%'") if by_track else ("", "once")
    program = f"last_value(CASE WHEN type = 'Program' THEN value END IGNORE NULLS) {so_far}"
    if by_track:
        program = "first_value(CASE WHEN type = 'Program' THEN value END IGNORE NULLS) OVER (PARTITION BY score_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    whole_id = "score_id // 1000" if by_track else "score_id"
    judged = f"""WITH toks AS ({sql}),
once AS ({"SELECT score_id, pos, token, unnest(range(CASE WHEN pos % 31 = 5 THEN 2 ELSE 1 END)) AS copy FROM toks WHERE pos % 23 <> 7" if damaged else "SELECT *, 0 AS copy FROM toks"}),
{cut}damaged AS (SELECT score_id, row_number() OVER (PARTITION BY score_id ORDER BY pos, copy) AS pos, token, split_part(token, '_', 1) AS type, try_cast(substr(token, instr(token, '_') + 1) AS INT) AS value FROM {source}),
seen AS (SELECT *, lag(type) OVER (PARTITION BY score_id ORDER BY pos) AS prev, lag(type, 2) OVER (PARTITION BY score_id ORDER BY pos) AS two,
  coalesce({program}, 0) AS program FROM damaged),
judged AS (SELECT *, prev IS NOT NULL AND NOT list_contains([{pairs}], prev || '>' || type) AS bad_type FROM seen)"""
    if on_off:  # an off without an open note takes the balance of its pitch to a new low
        return f"""{judged}, steps AS (SELECT *, sum(CASE WHEN type IN ('NoteOn', 'DrumOn') THEN 1 ELSE -1 END)
  OVER (PARTITION BY score_id, program, value ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance FROM judged WHERE type IN ('NoteOn', 'DrumOn', 'NoteOff', 'DrumOff')),
lows AS (SELECT score_id, sum(n) AS n FROM (SELECT score_id, greatest(0, -min(balance)) AS n FROM steps GROUP BY score_id, program, value) GROUP BY score_id),
whole AS (SELECT score_id, count(*) AS n_tokens, sum(CASE WHEN bad_type THEN 1 ELSE 0 END) AS n_type FROM judged GROUP BY score_id)
SELECT score_id, CAST(n_tokens AS BIGINT) AS n_tokens, CAST(n_type AS BIGINT) AS n_type, CAST(n AS BIGINT) AS n_note, CAST(0 AS BIGINT) AS n_time FROM whole JOIN lows USING (score_id)"""
    return f"""{judged}, spans AS (SELECT *, sum(CASE WHEN NOT bad_type AND type IN ('TimeShift', 'Rest', 'Position', 'Bar') THEN 1 ELSE 0 END) {so_far} AS resets,
  sum(CASE WHEN NOT bad_type AND type = 'Bar' THEN 1 ELSE 0 END) {so_far} AS bars,
  CASE WHEN NOT bad_type AND type IN ('Pitch', 'PitchDrum') THEN value END AS heard, CASE WHEN NOT bad_type AND type = 'Position' THEN value END AS place FROM judged),
marked AS (SELECT *, heard IS NOT NULL AND row_number() OVER (PARTITION BY score_id, resets, program, heard ORDER BY pos) > 1 AS bad_note,
  last_value(place IGNORE NULLS) OVER (PARTITION BY score_id, bars ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM spans)
SELECT {whole_id} AS score_id, count(*) AS n_tokens, CAST(sum(CASE WHEN bad_type THEN 1 ELSE 0 END) AS BIGINT) AS n_type, CAST(sum(CASE WHEN bad_note THEN 1 ELSE 0 END) AS BIGINT) AS n_note,
  CAST(sum(CASE WHEN place <= coalesce(last, -1) AND prev <> 'Rest' AND NOT coalesce(prev = 'TimeSig' AND two = 'Rest', false) THEN 1 ELSE 0 END) AS BIGINT) AS n_time FROM marked GROUP BY {whole_id}"""


NOTE_CHAIN = "Program>Pitch,PitchDrum Pitch>Velocity PitchDrum>Velocity Velocity>Duration"
LAST_BAR = "lasts AS (SELECT score_id, (greatest(max(time), 1) - 1) // 32 AS last FROM notes GROUP BY score_id)"
BARRED = f"{NOTES}, {LAST_BAR}, barred AS (SELECT n.*, least(time // 32, last) AS bar FROM notes n JOIN lasts USING (score_id))"
DENSITY = f"""{BARRED}, k AS (SELECT score_id, track_idx, bar, count(*) AS n FROM barred GROUP BY score_id, track_idx, bar)
SELECT score_id, track_idx, bar, CASE WHEN n >= 18 THEN 'ACBarNoteDensity_18+' ELSE 'ACBarNoteDensity_' || n END AS token FROM k"""


def polyphony(keys: str, bar: str, name: str) -> str:
    return f"""{BARRED}, k AS (SELECT {keys}, time, count(*) AS n FROM barred GROUP BY {keys}, time),
e AS (SELECT {keys}, min(n) AS lo, max(n) AS hi FROM k GROUP BY {keys})
SELECT score_id, track_idx, {bar} AS bar, '{name}Min_' || least(greatest(lo, 1), 6) AS token FROM e UNION ALL SELECT score_id, track_idx, {bar}, '{name}Max_' || least(hi, 6) FROM e"""


def lengths(keys: str, bar: str, name: str) -> str:
    names = "(VALUES ('Whole', 32), ('Half', 16), ('Quarter', 8), ('Eight', 4), ('Sixteenth', 2), ('ThirtySecond', 1)) AS l(what, d)"
    return f"""{BARRED} SELECT score_id, track_idx, {bar} AS bar, '{name}' || what || '_' || max(CASE WHEN duration = d THEN 1 ELSE 0 END) AS token
FROM barred CROSS JOIN {names} GROUP BY {keys}, what"""


NO_BAR = "CAST(NULL AS BIGINT)"
TRACK_DENSITY = f"""{BARRED}, k AS (SELECT score_id, track_idx, bar, count(*) AS n FROM barred GROUP BY score_id, track_idx, bar),
e AS (SELECT score_id, track_idx, CASE WHEN count(*) < any_value(last) + 1 THEN 0 ELSE min(n) END AS lo, max(n) AS hi FROM k JOIN lasts USING (score_id) GROUP BY score_id, track_idx)
SELECT score_id, track_idx, {NO_BAR} AS bar, 'ACTrackNoteDensityMin_' || CASE WHEN lo >= 18 THEN '18+' ELSE CAST(lo AS VARCHAR) END AS token FROM e
UNION ALL SELECT score_id, track_idx, {NO_BAR}, 'ACTrackNoteDensityMax_' || CASE WHEN hi >= 18 THEN '18+' ELSE CAST(hi AS VARCHAR) END FROM e"""
REPETITION = f"""{NOTES}, {LAST_BAR}, cells AS (SELECT DISTINCT score_id, track_idx, pitch, kind, least(t // 32, last) AS bar, t - 32 * least(t // 32, last) AS place
  FROM (SELECT score_id, track_idx, pitch, 'on' AS kind, time AS t FROM notes UNION ALL SELECT score_id, track_idx, pitch, 'off', time + duration FROM notes) JOIN lasts USING (score_id)),
filled AS (SELECT score_id, track_idx, bar, count(*) AS cells FROM cells GROUP BY score_id, track_idx, bar),
pairs AS (SELECT f.*, f.bar + k AS other FROM filled f JOIN lasts USING (score_id) CROSS JOIN (VALUES (1), (2), (3)) AS r(k) WHERE f.bar + k < last),
shared AS (SELECT p.score_id, p.track_idx, p.bar, p.other, any_value(p.cells) AS cells, count(b.pitch) AS n FROM pairs p
  JOIN cells a ON a.score_id = p.score_id AND a.track_idx = p.track_idx AND a.bar = p.bar
  LEFT JOIN cells b ON b.score_id = a.score_id AND b.track_idx = a.track_idx AND b.bar = p.other AND b.pitch = a.pitch AND b.kind = a.kind AND b.place = a.place
  GROUP BY p.score_id, p.track_idx, p.bar, p.other),
means AS (SELECT score_id, track_idx, avg(n / CAST(cells AS DOUBLE)) AS m FROM shared GROUP BY score_id, track_idx)
SELECT score_id, track_idx, {NO_BAR} AS bar, 'ACTrackRepetition_' || printf('%.2f', (SELECT arg_min(i / CAST(9 AS DOUBLE), abs(i / CAST(9 AS DOUBLE) - m)) FROM range(10) AS r(i))) AS token FROM means"""
BARRED_TSD = stream(shift(GAP)).replace("FROM notes WINDOW", "FROM barred WINDOW")
SPLIT = f"{BARRED} {laid_out(BARRED_TSD, columns='score_id, bar AS part')}"
SPLIT_TRACKS = f"""SELECT score_id, CAST(part - 1 AS INT) AS seq_idx, row_number() OVER (PARTITION BY score_id, part ORDER BY pos) - 1 AS pos, token FROM (
  SELECT *, sum(CASE WHEN token = 'Track_Start' THEN 1 ELSE 0 END) OVER (PARTITION BY score_id ORDER BY pos) AS part FROM ({MMM})) WHERE token NOT LIKE 'Track_%'"""


# Controls of the track, pitch classes of every bar, densities of bars 0, 2, 5 and 6; kind -1, 0 and 1: of the track, of a bar, a note.
MARKED = f"""{BARRED}, onsets AS (SELECT score_id, track_idx, time, count(*) AS n FROM notes GROUP BY score_id, track_idx, time),
slotted AS (SELECT score_id, track_idx, bar, max(bar) OVER (PARTITION BY score_id, track_idx) AS reach FROM barred),
dense AS (SELECT score_id, track_idx, list_min(list_filter([0, 2, 5, 6], lambda b: b >= bar AND b <= reach)) AS slot FROM slotted),
marked AS (
  SELECT score_id, track_idx, -1 AS kind, 0 AS time, 0 AS place, 0 AS pitch, 0 AS duration, 0 AS velocity,
    ['ACTrackOnsetPolyphonyMin_' || least(greatest(min(n), 1), 6), 'ACTrackOnsetPolyphonyMax_' || least(max(n), 6)] AS own FROM onsets GROUP BY score_id, track_idx
  UNION ALL SELECT score_id, track_idx, 0, bar * 32, pitch % 12, 0, 0, 0, ['ACBarPitchClass_' || pitch % 12] FROM barred GROUP BY score_id, track_idx, bar, pitch % 12
  UNION ALL SELECT score_id, track_idx, 0, slot * 32, 12, 0, 0, 0, ['ACBarNoteDensity_' || CASE WHEN count(*) >= 18 THEN '18+' ELSE CAST(count(*) AS VARCHAR) END]
    FROM dense WHERE slot IS NOT NULL GROUP BY score_id, track_idx, slot
  UNION ALL SELECT score_id, track_idx, 1, time, 0, pitch, duration, velocity, {NOTE} FROM notes),
steps AS (SELECT *, lag(kind) OVER w AS prev_kind, row_number() OVER w AS rn,
  last_value(CASE WHEN kind >= 0 THEN time END IGNORE NULLS) OVER (PARTITION BY score_id, track_idx ORDER BY kind < 0 DESC, time, kind, place, pitch, duration, velocity ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev
  FROM marked WINDOW w AS (PARTITION BY score_id, track_idx ORDER BY kind < 0 DESC, time, kind, place, pitch, duration, velocity))"""


def controlled(before: str) -> str:
    return f"""{MARKED} SELECT score_id, CAST(dense_rank() OVER (PARTITION BY score_id ORDER BY track_idx) - 1 AS INT) AS seq_idx, pos, token
FROM ({laid_out(f"SELECT *, list_concat({before}, own) AS toks FROM steps", "score_id, track_idx")})"""


TSD_CONTROLS = controlled(shift(GAP))
HERE = "['Position_' || time % 32]"
REMI_CONTROLS = controlled(f"""CASE WHEN kind = -1 THEN {EMPTY} WHEN prev = time THEN CASE WHEN kind = 1 AND prev_kind = 0 THEN {HERE} ELSE {EMPTY} END
  ELSE list_concat(list_transform({NEW_BARS}, lambda x: 'Bar_None'), CASE WHEN kind = 1 THEN {HERE} ELSE {EMPTY} END) END""")


BPE = f"""WITH toks AS ({TSD}), ahead AS (SELECT *, lead(token) OVER w AS next, lag(token) OVER w AS prev FROM toks WINDOW w AS (PARTITION BY score_id ORDER BY pos)),
judged AS (SELECT *, {" AND ".join(("split_part(token, '_', 2) IN ('-1', '0', '8') AND token LIKE 'Program%'", "next = CASE WHEN token = 'Program_-1' THEN 'PitchDrum_' ELSE 'Pitch_' END || split_part(next, '_', 2)", "try_cast(split_part(next, '_', 2) AS INT) BETWEEN 30 AND 79"))} AS merged FROM ahead),
marked AS (SELECT *, coalesce(lag(merged) OVER (PARTITION BY score_id ORDER BY pos), false) AS taken FROM judged)"""
BPE_TOKENS = f"""{BPE} SELECT score_id, CAST(row_number() OVER (PARTITION BY score_id ORDER BY pos) - 1 AS BIGINT) AS pos, CASE WHEN merged THEN token || ' ' || next ELSE token END AS piece FROM marked WHERE NOT taken"""
MERGED_ID = "442 + (CASE token WHEN 'Program_-1' THEN 0 WHEN 'Program_0' THEN 50 ELSE 100 END) + try_cast(split_part(next, '_', 2) AS INT) - 30"
BPE_IDS = f"""{BPE}, ids AS ({TOKEN_IDS}) SELECT score_id, row_number() OVER (PARTITION BY score_id ORDER BY pos) - 1 AS pos, CAST(CASE WHEN merged THEN {MERGED_ID} ELSE id END AS INT) AS id
FROM marked JOIN ids USING (score_id, pos) WHERE NOT taken"""
PEDALS_OUT = f"""WITH merged AS ({PEDALS_MERGED}) SELECT score_id, program, time, CAST(64 AS INT) AS number, CAST(127 AS INT) AS value FROM merged
UNION ALL SELECT score_id, program, time + duration, 64, 0 FROM merged"""
MIDI_GLOBALS = f"""WITH {TEMPOS}, {SIGNATURES}, t AS (SELECT score_id, time, CAST(round_even(mspq, 0) AS BIGINT) AS mspq FROM tempos_raw WHERE time > 0 OR score_id % 2 = 0),
s AS (SELECT score_id, time, num, den FROM signatures_raw WHERE seq > 0 OR score_id % 3 = 0)
SELECT score_id, 'tempo' AS kind, time, CAST(0 AS INT) AS a, CAST(0 AS INT) AS b, mspq FROM t
UNION ALL SELECT s_suppkey, 'tempo', 0, 0, 0, 500000 FROM supplier WHERE s_suppkey NOT IN (SELECT score_id FROM t WHERE time = 0)
UNION ALL SELECT score_id, 'signature', time, num, den, 0 FROM s
UNION ALL SELECT s_suppkey, 'signature', 0, 4, 4, 0 FROM supplier WHERE s_suppkey NOT IN (SELECT score_id FROM s WHERE time = 0)"""


def chord_rows(notes: str) -> str:
    """Chords among the rows of a CTE ``notes``: the steps of all notes, followed from the first one."""
    track = "score_id, track_idx, program"
    known = " ".join(f"WHEN '{','.join(map(str, shape))}' THEN '{name}'" for name, shape in CHORD_MAPS)
    roots = "[" + ", ".join(f"'{p}'" for p in PITCH_CLASSES) + "]"
    return f"""WITH RECURSIVE {notes},
a AS (SELECT {track}, time AS t, pitch AS p, time + duration AS e, row_number() OVER w AS i, count(*) OVER (PARTITION BY {track} ORDER BY time) AS upto
  FROM notes WHERE program <> -1 WINDOW w AS (PARTITION BY {track} ORDER BY time, pitch, duration, velocity)),
b AS (SELECT *, list({{'t': t, 'p': p, 'e': e, 'upto': upto}}) OVER (PARTITION BY {track} ORDER BY i ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING) AS ahead FROM a),
c AS (SELECT *, list_filter(ahead, lambda n: n.t <= b.t + 1) AS near FROM b),
d AS (SELECT *, len(list_filter(near, lambda n: abs(n.e - c.e) > 4)) > 0 AS passed, CASE WHEN e - t <= 4 THEN list_filter(near, lambda n: n.t = c.t) ELSE near END AS kept FROM c),
s AS (SELECT {track}, i, t, CASE WHEN passed THEN i + len(near) ELSE kept[-1].upto + 1 END AS next, CASE WHEN NOT passed AND len(kept) BETWEEN 3 AND 5 AND kept[-1].p - p <= 24
  THEN {roots}[p % 12 + 1] || ':' || CASE array_to_string(list_transform(kept, lambda n: n.p - d.p), ',') {known} ELSE 'ukn' || len(kept) END END AS chord FROM d),
v AS (SELECT {track}, CAST(1 AS BIGINT) AS i FROM s WHERE i = 1 UNION ALL SELECT v.score_id, v.track_idx, v.program, s.next FROM v JOIN s USING ({track}, i))
SELECT {track}, CAST(row_number() OVER (PARTITION BY {track} ORDER BY i) - 1 AS BIGINT) AS seq, t AS time, chord FROM v JOIN s USING ({track}, i) WHERE chord IS NOT NULL"""


STEPS = "CASE pitch % 5 WHEN 0 THEN [0, 4, 7] WHEN 1 THEN [0, 3, 7] WHEN 2 THEN [0, 4, 7, 11] WHEN 3 THEN [0, 5] ELSE [0, 2, 9] END"
TRIADS = f"""{RAW}, spread AS (SELECT *, unnest(range(len({STEPS}))) AS i FROM notes_raw WHERE program <> -1),
notes AS (SELECT score_id, track_idx, program, time // 60 + CASE WHEN velocity % 7 = 0 AND i = 2 THEN 1 ELSE 0 END AS time, CAST(pitch + ({STEPS})[i + 1] AS INT) AS pitch,
  2 + duration % 31 + CASE WHEN velocity % 11 = 0 AND i = 1 THEN 9 ELSE 0 END AS duration, velocity FROM spread)"""

INSTRUMENT = """CASE program WHEN -1 THEN 'Drums' WHEN 0 THEN 'Acoustic Grand Piano' WHEN 8 THEN 'Celesta' WHEN 16 THEN 'Drawbar Organ'
  WHEN 24 THEN 'Acoustic Guitar (nylon)' WHEN 32 THEN 'Acoustic Bass' WHEN 40 THEN 'Violin' END"""


def merged(effects: bool) -> str:
    """Tracks of programs in common, and what belongs to them: of all of them, or of the first."""
    common = "CAST(CASE WHEN program = -1 THEN -1 ELSE program % 16 END AS INT)"
    rows = lambda kind, source, idx, a, b: f"SELECT r.score_id, first AS track_idx, p.program, '{kind}' AS kind, time, CAST({a} AS BIGINT) AS a, CAST({b} AS BIGINT) AS b, '' AS name FROM {source} r JOIN p ON p.score_id = r.score_id AND p.track_idx = {idx}{'' if effects else ' AND p.first = p.track_idx'}"
    return f"""WITH {RAW}, {PEDALS}, {BENDS}, t AS (SELECT DISTINCT score_id, track_idx, {common} AS program, {INSTRUMENT} || ' ' || track_idx AS name FROM notes_raw),
p AS (SELECT *, min(track_idx) OVER (PARTITION BY score_id, program) AS first FROM t)
SELECT score_id, CAST(first AS INT) AS track_idx, program, 'track' AS kind, CAST(0 AS BIGINT) AS time, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS b, string_agg(name, ' / ' ORDER BY track_idx) AS name FROM p GROUP BY score_id, first, program
UNION ALL {rows("pedal", "pedals_raw", "0", "duration", "0")}
UNION ALL {rows("bend", "bends_raw", "1", "value", "0")}
UNION ALL {rows("control", "(SELECT * FROM notes_raw WHERE track_idx IN (1, 3, 6))", "r.track_idx", "pitch", "velocity")}"""


def spoiled(sql: str, places: dict[int, tuple[int, str]]) -> str:
    """CTE ``rows`` (score_id, pos, l): compound rows missing, said twice or with another token at one place."""
    cases = " ".join(f"WHEN pos % {n} = {n - 3} THEN list_concat(l[1 : {at}], ['{name}'], l[{at + 2} :])" for n, (at, name) in reversed(places.items()))
    return f"""WITH told AS (SELECT score_id, pos, string_split(token, ' ') AS l FROM ({sql})),
twice AS (SELECT score_id, pos, CASE {cases} ELSE l END AS l, unnest(range(CASE WHEN pos % 31 = 5 THEN 2 ELSE 1 END)) AS copy FROM told WHERE pos % 23 <> 7),
rows AS (SELECT score_id, row_number() OVER (PARTITION BY score_id ORDER BY pos, copy) - 1 AS pos, l FROM twice)"""


EARLIER, SO_FAR = "ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING", "ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
OUT = "SELECT score_id, pos, bad_type, bad_note, bad_time FROM judged WHERE bad_type OR bad_note OR bad_time"


def place_of(i: int) -> str:
    return f"try_cast(split_part(l[{i}], '_', 2) AS INT)"


def legal_after(groups: str) -> str:
    pairs = ", ".join(f"'{a}>{b}'" for g in groups.split() for a, ends in [g.split(">")] for b in ends.split(","))
    return f"prev IS NULL OR list_contains([{pairs}], prev || '>' || type)"


def octuple_spoiled(places: dict[int, tuple[int, str]]) -> str:
    whole = "CASE WHEN missing THEN NULL ELSE"
    return f"""{spoiled(OCTUPLE, places)}, a AS (SELECT *, len(list_filter(l, lambda t: t LIKE '%_None')) > 0 AS missing FROM rows),
b AS (SELECT *, {whole} {place_of(1)} END AS pitch, {whole} {place_of(2)} END AS place, {whole} {place_of(3)} END AS bar, split_part(l[6], '_', 2) AS program FROM a),
c AS (SELECT *, coalesce(max(bar) OVER (PARTITION BY score_id {EARLIER}), -1) AS reached FROM b),
d AS (SELECT *, greatest(reached, coalesce(bar, -1)) AS bar_now FROM c),
e AS (SELECT *, coalesce(max(place) OVER (PARTITION BY score_id, bar_now {EARLIER}), -1) AS placed FROM d),
f AS (SELECT *, greatest(placed, coalesce(place, -1)) AS place_now, coalesce(bar < reached OR place < placed, false) AS bad_time FROM e),
judged AS (SELECT *, missing AS bad_type, NOT bad_time AND pitch IS NOT NULL AND row_number() OVER (PARTITION BY score_id, bar_now, place_now, program, pitch ORDER BY pos) > 1 AS bad_note FROM f) {OUT}"""


def cpword_spoiled(places: dict[int, tuple[int, str]]) -> str:
    return f"""{spoiled(CPWORD, places)}, a AS (SELECT *, CASE WHEN l[1] = 'Family_Note' THEN l[3] ELSE l[2] END AS kind, split_part(l[6], '_', 2) AS program FROM rows),
b AS (SELECT *, split_part(kind, '_', 1) AS type, split_part(kind, '_', 2) AS value FROM a),
c AS (SELECT *, lag(type) OVER (PARTITION BY score_id ORDER BY pos) AS prev FROM b),
d AS (SELECT *, {legal_after("Bar>Position,Bar Position>Pitch,PitchDrum Pitch>Pitch,PitchDrum,Bar,Position PitchDrum>Pitch,PitchDrum,Bar,Position")} AS good FROM c),
e AS (SELECT *, sum(CASE WHEN good AND type IN ('Bar', 'Position') THEN 1 ELSE 0 END) OVER (PARTITION BY score_id {SO_FAR}) AS resets, sum(CASE WHEN good AND type = 'Bar' THEN 1 ELSE 0 END) OVER (PARTITION BY score_id {SO_FAR}) AS bars,
  CASE WHEN good AND type IN ('Pitch', 'PitchDrum') THEN value END AS heard, CASE WHEN good AND type = 'Position' THEN CAST(value AS INT) END AS place FROM d),
f AS (SELECT *, coalesce(last_value(place IGNORE NULLS) OVER (PARTITION BY score_id, bars {EARLIER}), -1) AS last FROM e),
judged AS (SELECT *, NOT good AS bad_type, heard IS NOT NULL AND row_number() OVER (PARTITION BY score_id, resets, program, heard ORDER BY pos) > 1 AS bad_note,
  coalesce(place <= last AND prev IS NOT NULL, false) AS bad_time FROM f) {OUT}"""


def mumidi_spoiled(places: dict[int, tuple[int, str]]) -> str:
    kinds = "Bar,Position,Program,Pitch,PitchDrum,PAD"
    return f"""{spoiled(MUMIDI, places)}, a AS (SELECT *, split_part(l[1], '_', 1) AS type, split_part(l[1], '_', 2) AS value, coalesce({place_of(3)}, -1) AS told,
  len(list_filter(l, lambda t: starts_with(t, 'PAD_'))) > 0 AS padded FROM rows),
b AS (SELECT *, lag(type) OVER (PARTITION BY score_id ORDER BY pos) AS prev FROM a),
c AS (SELECT *, {legal_after(f"Bar>Bar,Position,PAD Position>Program,PAD Program>Pitch,PitchDrum,PAD Pitch>Pitch,Program,Bar,Position,PAD PitchDrum>PitchDrum,Program,Bar,Position,PAD PAD>{kinds}")} AS good FROM b),
d AS (SELECT *, sum(CASE WHEN good AND type IN ('Bar', 'Position', 'Program') THEN 1 ELSE 0 END) OVER (PARTITION BY score_id {SO_FAR}) AS resets, sum(CASE WHEN good AND type = 'Bar' THEN 1 ELSE 0 END) OVER (PARTITION BY score_id {SO_FAR}) AS bars,
  CASE WHEN good AND type = 'Pitch' THEN value END AS heard, CASE WHEN good AND type = 'Position' THEN CAST(value AS INT) END AS own FROM c),
e AS (SELECT *, coalesce(max(own) OVER (PARTITION BY score_id, bars {EARLIER}), -1) AS last FROM d),
judged AS (SELECT *, NOT good OR padded AS bad_type, heard IS NOT NULL AND row_number() OVER (PARTITION BY score_id, resets, heard ORDER BY pos) > 1 AS bad_note,
  coalesce(own <= last OR own <> told, false) OR (good AND prev IS NOT NULL AND told < last AND type <> 'Bar') AS bad_time FROM e) {OUT}"""


def nearest_step(gap: str) -> str:
    """The nearest step of a fortieth of a whole, an eightieth beyond it; the shorter of two as near."""
    return f"(CASE WHEN {gap} <= 1280 THEN 40 * greatest(1, CAST(ceil({gap} / CAST(40 AS DOUBLE) - 0.5) AS BIGINT)) ELSE least(3760, 1280 + 80 * CAST(ceil(({gap} - 1280) / CAST(80 AS DOUBLE) - 0.5) AS BIGINT)) END)"


def step_name(ticks: str) -> str:
    return f"({ticks} // 320 || '.' || {ticks} % 320 || '.320')"


# At 320 ticks a quarter; a bar begins 20 ticks before its line, and the clock of a bar moves by the steps that were written.
PERTOK = f"""WITH RECURSIVE {RAW}, s AS (SELECT score_id, track_idx, program, CAST(round_even(time * 320 / CAST(480 AS DOUBLE), 0) AS BIGINT) AS time,
  greatest(CAST(round_even(duration * 320 / CAST(480 AS DOUBLE), 0) AS BIGINT), 1) AS duration, pitch, {VELOCITY} AS velocity FROM notes_raw WHERE {IN_RANGE}),
n AS (SELECT *, greatest(CAST(ceil((time + 20) / CAST(1280 AS DOUBLE)) AS BIGINT) - 1, 0) AS bar FROM s QUALIFY row_number() OVER (PARTITION BY score_id, track_idx, time, pitch ORDER BY duration, velocity) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY score_id ORDER BY {ORDER}) AS rn, row_number() OVER (PARTITION BY score_id, bar ORDER BY {ORDER}) AS k, time - bar * 1280 AS t, {nearest_step("duration")} AS lasting FROM n),
c AS (SELECT DISTINCT score_id, bar, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS clock, CAST(0 AS BIGINT) AS step FROM o
  UNION ALL SELECT o.score_id, o.bar, o.k, CASE WHEN t - clock >= 20 THEN clock + {nearest_step("(t - clock)")} ELSE clock END, CASE WHEN t - clock >= 20 THEN {nearest_step("(t - clock)")} ELSE 0 END
  FROM c JOIN o ON o.score_id = c.score_id AND o.bar = c.bar AND o.k = c.k + 1),
placed AS (SELECT o.*, clock, step, lag(o.bar, 1, 0) OVER (PARTITION BY o.score_id ORDER BY rn) AS before FROM o JOIN c USING (score_id, bar, k))"""
PERTOK_TOKENS = f"""{PERTOK} {laid_out(f'''SELECT *, list_concat(list_transform(range(bar - before), lambda x: 'Bar_None'), ['Program_' || program],
  CASE WHEN step > 0 THEN ['TimeShift_' || {step_name("step")}] ELSE {EMPTY} END, [{PITCH}, 'Velocity_' || velocity, 'Duration_' || {step_name("lasting")}]) AS toks FROM placed''')}"""
FIELDS = f"""WITH toks AS ({TSD_FULL}), parts AS (SELECT *, split_part(token, '_', 1) AS type, substr(token, instr(token, '_') + 1) AS value FROM toks),
cut AS (SELECT *, CASE WHEN type IN ('Duration', 'TimeShift', 'Rest') THEN string_split(value, '.') END AS s, CASE WHEN type = 'TimeSig' THEN string_split(value, '/') END AS n FROM parts)
SELECT score_id, pos, type, value, CAST(s[1] AS INT) AS beats, CAST(s[2] AS INT) AS position, CAST(s[3] AS INT) AS resolution, CAST(n[1] AS INT) AS num, CAST(n[2] AS INT) AS den,
  CASE WHEN regexp_full_match(value, '-?[0-9]+') THEN CAST(value AS INT) END AS number, (CAST(s[1] AS BIGINT) * CAST(s[3] AS BIGINT) + CAST(s[2] AS BIGINT)) * 16 // CAST(s[3] AS BIGINT) AS ticks FROM cut"""
OTHERS = {
    "token_fields": FIELDS,
    "tsd_tokens_full": TSD_FULL,
    "midilike_tokens_full": MIDILIKE_FULL,
    "remi_tokens_full": REMI_FULL,
    "pertok_tokens": PERTOK_TOKENS,
    "pertok_decoded": f"{PERTOK} SELECT score_id, program, CAST(bar * 1280 + clock AS BIGINT) AS time, CAST(lasting AS BIGINT) AS duration, pitch, velocity FROM placed",
    "pertok_errors": no_errors(PERTOK_TOKENS),
    "durations_resnapped": RESNAPPED,
    "remi_tokens_signatures": REMI_SIGNATURES,
    "octuple_tokens_signatures": OCTUPLE_SIGNATURES,
    "remi_decoded_signatures": PREPARED_SIGNATURES,
    "octuple_decoded_signatures": PREPARED_SIGNATURES,
    "octuple_tokens_clipped": OCTUPLE + " WHERE time // 32 < 20",
    "chords": chord_rows(NOTES.removeprefix("WITH ")),
    "chords_triads": chord_rows(TRIADS),
    "midi_round_trip": OVERLAPS,
    "midi_globals": MIDI_GLOBALS,
    "pedal_controls": PEDALS_OUT,
    "tempos_default": f"""WITH {TEMPOS}, late AS (SELECT score_id, time, mspq FROM tempos_raw WHERE NOT (time = 0 AND score_id % 3 = 1))
SELECT score_id, time, mspq FROM late UNION ALL SELECT s_suppkey, 0, 500000 FROM supplier WHERE s_suppkey NOT IN (SELECT score_id FROM late WHERE time = 0)""",
    "bpe_tokens": BPE_TOKENS,
    "bpe_ids": BPE_IDS,
    "sequences_completed": f"SELECT t.score_id, t.pos, t.token, i.id FROM ({TSD}) t JOIN ({TOKEN_IDS}) i ON t.score_id = i.score_id AND t.pos = i.pos",
    "sequences_equal": f"""SELECT score_id, bool_and(NOT (score_id % 2 = 0 AND pos = score_id % 50 AND token <> 'Velocity_127') AND NOT (score_id % 5 = 3 AND pos % 9 = 4)) AS equal
FROM ({TSD}) GROUP BY score_id""",
    "sequence_sizes": f"SELECT score_id, count(*) FILTER (WHERE score_id % 2 = 0 OR pos % 3 = 0) AS size FROM ({TSD}) GROUP BY score_id",
    "signatures_outside": f"WITH {SIGNATURES} SELECT score_id, bool_or(den = 8 AND num + score_id // 4 % 3 <> 6) AS outside FROM signatures_raw GROUP BY score_id",
    "velocity_histogram": f"""WITH {RAW}, bins AS (SELECT score_id, unnest(range(8)) AS bin FROM (SELECT DISTINCT score_id FROM notes_raw)),
counts AS (SELECT score_id, least((velocity - 3) // 12, 7) AS bin, count(*) AS n FROM notes_raw WHERE velocity BETWEEN 3 AND 99 GROUP BY 1, 2)
SELECT score_id, CAST(bin AS INT) AS bin, coalesce(n, 0) AS n FROM bins LEFT JOIN counts USING (score_id, bin)""",
    "tracks_merged_effects": merged(True),
    "tracks_merged_plain": merged(False),
    "instrument_names": f"WITH {RAW} SELECT DISTINCT score_id, track_idx, {INSTRUMENT} AS name FROM notes_raw",
    "tsd_error_counts": f"SELECT score_id, n_tokens, n_type + n_note + n_time AS n_errors FROM ({errors_broken(TSD, f'{NOTE_CHAIN} Duration>Program,TimeShift TimeShift>Program,TimeShift')})",
    "tsd_decoded_programs": f"""{NOTES}, streams AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY score_id ORDER BY track_idx) - 1 AS INT) AS seq_idx FROM notes)
SELECT score_id, seq_idx, CAST(CASE WHEN seq_idx < 3 THEN 5 + seq_idx ELSE 0 END AS INT) AS program, count(*) AS n_notes, CAST(sum(time) AS BIGINT) AS ticks FROM streams GROUP BY score_id, seq_idx""",
}


def oracle_sql() -> dict[str, str]:
    rows = lambda cte: f"{cte} SELECT {ROWS} FROM notes"
    velocity = f"WITH {RAW} SELECT score_id, program, time, duration, pitch, {VELOCITY} AS velocity FROM notes_raw"
    out = {
        "notes_pitch_filter": f"WITH {RAW} SELECT {ROWS} FROM notes_raw WHERE {IN_RANGE}",
        "notes_velocity_quantized": velocity,
        "notes_resampled": f"WITH {RAW} SELECT score_id, program, {at_eight('time')} AS time, greatest({at_eight('duration')}, 1) AS duration, pitch, velocity FROM notes_raw",
        "notes_dedup": DEDUP,
        "notes_prepared": rows(NOTES),
        "tracks_merged": f"""WITH {RAW}, a AS (SELECT * REPLACE (CAST(CASE WHEN program = -1 THEN -1 ELSE program % 16 END AS INT) AS program) FROM notes_raw)
SELECT score_id, CAST(min(track_idx) OVER (PARTITION BY score_id, program) AS INT) AS track_idx, program, time, duration, pitch, velocity FROM a""",
        "tracks_nonempty": f"{NOTES} SELECT DISTINCT score_id, track_idx, program FROM notes",
        "overlaps_fixed": OVERLAPS,
        "pedals_merged": PEDALS_MERGED,
        "tempos_snapped": TEMPOS_SNAPPED,
        "bends_snapped": BENDS_SNAPPED,
        "signatures_supported": f"WITH {SIGNATURES} SELECT score_id, time, num, den FROM signatures_raw WHERE den = 4 AND num IN (3, 4)",
        "signatures_default": f"""WITH {SIGNATURES}, late AS (SELECT * FROM signatures_raw WHERE NOT (time = 0 AND num = 3))
SELECT score_id, time, num, den FROM late UNION ALL SELECT s_suppkey, 0, 4, 4 FROM supplier WHERE s_suppkey NOT IN (SELECT score_id FROM late WHERE time = 0)""",
        "signatures_aligned": SIGNATURES_ALIGNED,
        "notes_prepared_signatures": PREPARED_SIGNATURES,
        "bars_ticks": ticks(32),
        "beats_ticks": ticks(8),
        "notes_bar_position": f"{NOTES} SELECT score_id, program, time, pitch, time // 32 AS bar, time % 32 AS position FROM notes",
        "pitch_intervals": INTERVALS,
        "program_changes": CHANGES,
        "global_events": f"WITH {SNAPPED_TEMPOS} SELECT score_id, CAST(time // 60 AS BIGINT) AS time, 'Tempo' AS type, {TEMPO_NAME} AS value FROM near",
        "events_sorted": EVENTS,
        "token_ids": TOKEN_IDS,
        "ids_to_tokens": TSD,
        "token_bytes": TSD,
        "compound_ids": COMPOUND_IDS,
        "vocab_types": TYPES_USED,
        "note_on_off_pairs": PAIRS,
        "dup_note_errors": REPEATED,
        "split_by_bar": SPLIT,
        "split_by_track": SPLIT_TRACKS,
        "sliced_and_joined": TSD,
        "bpe_decoded": TOKEN_IDS,
        "tsd_tokens": TSD,
        "midilike_tokens": MIDILIKE,
        "structured_tokens": STRUCTURED,
        "remi_tokens": REMI,
        "mmm_tokens": MMM,
        "octuple_tokens": OCTUPLE,
        "cpword_tokens": CPWORD,
        "mumidi_tokens": MUMIDI,
        "tsd_tokens_rests": TSD_RESTS,
        "remi_tokens_rests": REMI_RESTS,
        "tsd_tokens_tracks": TRACKS,
        "tsd_tokens_controls": TSD_CONTROLS,
        "remi_tokens_controls": REMI_CONTROLS,
        "bar_density": DENSITY,
        "bar_polyphony": polyphony("score_id, track_idx, bar", "bar", "ACBarOnsetPolyphony"),
        "bar_pitch_class": f"{BARRED} SELECT DISTINCT score_id, track_idx, bar, 'ACBarPitchClass_' || pitch % 12 AS token FROM barred",
        "bar_durations": lengths("score_id, track_idx, bar", "bar", "ACBarNoteDuration"),
        "track_polyphony": polyphony("score_id, track_idx", NO_BAR, "ACTrackOnsetPolyphony"),
        "track_density": TRACK_DENSITY,
        "track_durations": lengths("score_id, track_idx", NO_BAR, "ACTrackNoteDuration"),
        "track_repetition": REPETITION,
    }
    for name, sql in (("tsd", TSD), ("remi", REMI), ("octuple", OCTUPLE), ("cpword", CPWORD), ("mumidi", MUMIDI)):
        out[f"{name}_decoded"] = rows(NOTES)
        out[f"{name}_errors"] = no_errors(sql)
    out |= {
        "midilike_decoded": f"""{TICKS}, ons AS (SELECT *, row_number() OVER (PARTITION BY score_id, program, pitch ORDER BY time) AS k FROM notes),
offs AS (SELECT score_id, program, pitch, time + duration AS stop, row_number() OVER (PARTITION BY score_id, program, pitch ORDER BY time + duration) AS k FROM notes)
SELECT score_id, program, time, stop - time AS duration, pitch, velocity FROM ons JOIN offs USING (score_id, program, pitch, k)""",
        "structured_decoded": f"""{NOTES}, a AS (SELECT *, lag(time) OVER w AS prev, row_number() OVER w AS rn FROM notes WINDOW w AS (PARTITION BY score_id ORDER BY {ORDER}))
SELECT score_id, program, CAST(sum({NEAREST}) OVER (PARTITION BY score_id ORDER BY rn) AS BIGINT) AS time, duration, pitch, velocity FROM a""",
        "mmm_errors": no_errors(f"SELECT * FROM ({MMM}) WHERE token NOT LIKE 'Track_%'"),
    }
    pedals = "Pedal>Pedal,Program,Rest,{0} PedalOff>Pedal,PedalOff,Program,Rest,{0} PitchBend>Program,Rest,{0}"
    shifts = f"{pedals.format('TimeShift')} Rest>Pedal,PedalOff,PitchBend,Program,Rest,Tempo,TimeShift,TimeSig Tempo>Pedal,PedalOff,Program,Rest,TimeShift TimeShift>Pedal,PedalOff,Program,Tempo,TimeShift,TimeSig TimeSig>Pedal,PedalOff,Program,Rest,Tempo,TimeShift"
    whole = lambda sql, legal, on_off=False: f"SELECT score_id, n_tokens, n_type + n_note + n_time AS n_errors FROM ({errors_broken(sql, legal, on_off, damaged=False)})"
    out |= {
        "tsd_errors_full": whole(TSD_FULL, f"{shifts} Program>Pitch,PitchBend,PitchDrum Pitch>Velocity PitchDrum>Velocity Velocity>Duration Duration>Program,Rest,TimeShift"),
        "midilike_errors_full": whole(
            MIDILIKE_FULL,
            f"{shifts} Program>DrumOff,DrumOn,NoteOff,NoteOn,PitchBend NoteOn>Velocity DrumOn>Velocity Velocity>Program,Rest,TimeShift NoteOff>DrumOff,NoteOff,Program,Rest,TimeShift DrumOff>DrumOff,NoteOff,Program,Rest,TimeShift",
            True,
        ),
        "remi_errors_full": whole(
            REMI_FULL,
            f"{pedals.format('Bar,Position')} Rest>Bar,Pedal,PedalOff,PitchBend,Position,Program,Rest,Tempo,TimeSig Tempo>Bar,Pedal,PedalOff,Position,Program,Rest,TimeSig TimeSig>Bar,Pedal,PedalOff,Position,Program,Rest "
            "Bar>TimeSig Position>Pedal,PedalOff,Program,Tempo Program>Pitch,PitchBend,PitchDrum Pitch>Velocity PitchDrum>Velocity Velocity>Duration Duration>Bar,Position,Program,Rest",
        ),
        "structured_errors_broken": errors_broken(STRUCTURED, "Program>Pitch,PitchDrum Pitch>Velocity PitchDrum>Velocity Velocity>Duration Duration>TimeShift TimeShift>Program"),
        "mmm_errors_broken": errors_broken(MMM, "Program>Pitch,PitchDrum,TimeShift Pitch>Velocity PitchDrum>Velocity Velocity>Duration Duration>Pitch,PitchDrum,Program,TimeShift TimeShift>Pitch,PitchDrum,Program,TimeShift", by_track=True),
        "octuple_errors_broken": octuple_spoiled(OCTUPLE_SPOILED),
        "cpword_errors_broken": cpword_spoiled(CPWORD_SPOILED),
        "mumidi_errors_broken": mumidi_spoiled(MUMIDI_SPOILED),
        "tsd_errors_broken": errors_broken(TSD, f"{NOTE_CHAIN} Duration>Program,TimeShift TimeShift>Program,TimeShift"),
        "remi_errors_broken": errors_broken(REMI, f"{NOTE_CHAIN} Duration>Program,Bar,Position Position>Program Bar>Bar,Position"),
        "midilike_errors_broken": errors_broken(
            MIDILIKE,
            "Program>NoteOn,DrumOn,NoteOff,DrumOff NoteOn>Velocity DrumOn>Velocity Velocity>Program,TimeShift NoteOff>NoteOff,DrumOff,Program,TimeShift DrumOff>NoteOff,DrumOff,Program,TimeShift TimeShift>Program,TimeShift",
            on_off=True,
        ),
    }
    out |= {"mmm_decoded": rows(NOTES), "tsd_decoded_rests": rows(NOTES), "remi_decoded_rests": rows(NOTES), "tsd_decoded_intervals": rows(NOTES), "structured_errors": no_errors(STRUCTURED), "midilike_errors": no_errors(MIDILIKE)}
    return out | OTHERS
