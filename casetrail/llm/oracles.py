"""SQL for the operators that SQL can express, as DuckDB runs it."""

from __future__ import annotations

from . import chat, mixing

_S, _E = chat.START, chat.END

PREFERENCE = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
last AS (
  SELECT conv_id, max(i) AS k, arg_max(text, i) AS reply FROM t WHERE role = '{chat.TRAINED_ROLE}' GROUP BY conv_id),
pair AS (
  SELECT a.conv_id, b.conv_id AS partner_id, a.k, b.reply
  FROM last a JOIN last b ON b.conv_id = xor(a.conv_id, 1)),
side AS (
  SELECT p.conv_id, p.partner_id, t.i, t.role, t.text,
         CASE WHEN t.i = p.k THEN p.reply ELSE t.text END AS other
  FROM pair p JOIN t ON t.conv_id = p.conv_id AND t.i <= p.k),
marked AS (
  SELECT *, bool_or(text <> other) OVER (PARTITION BY conv_id ORDER BY i) AS apart,
         '{_S}' || replace(role, '{chat.MARKER}', '{chat.BROKEN}') || chr(10) AS head,
         replace(text, '{chat.MARKER}', '{chat.BROKEN}') || '{_E}' AS body,
         replace(other, '{chat.MARKER}', '{chat.BROKEN}') || '{_E}' AS other_body
  FROM side),
placed AS (
  SELECT *, length(head) + coalesce(sum(CASE WHEN apart THEN length(head || body) + 1 ELSE 0 END) OVER before, 0) AS pos,
         length(head) + coalesce(sum(CASE WHEN apart THEN length(head || other_body) + 1 ELSE 0 END) OVER before, 0)
           AS other_at
  FROM marked
  WINDOW before AS (PARTITION BY conv_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT conv_id, partner_id, (count(*) FILTER (NOT apart))::INT AS prompt_turns,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (NOT apart), '') AS prompt,
  coalesce(string_agg(head || body || chr(10), '' ORDER BY i) FILTER (apart), '') AS chosen,
  coalesce(string_agg(head || other_body || chr(10), '' ORDER BY i) FILTER (apart), '') AS rejected,
  coalesce(string_agg(pos::BIGINT || ':' || (pos + length(body))::BIGINT, ',' ORDER BY i)
    FILTER (apart AND role = '{chat.TRAINED_ROLE}'), '') AS chosen_spans,
  coalesce(string_agg(other_at::BIGINT || ':' || (other_at + length(other_body))::BIGINT, ',' ORDER BY i)
    FILTER (apart AND role = '{chat.TRAINED_ROLE}'), '') AS rejected_spans
FROM placed GROUP BY conv_id, partner_id
"""


def _hash(*parts: str) -> str:
    state = f"{mixing.SEED}::BIGINT"
    for part in parts:
        state = f"(({state} * 48271 + (({part}) % {mixing.PRIME}) * 69621 + 12345) % {mixing.PRIME})"
    return f"(({state} * 16807 + 1) % {mixing.OTHER_PRIME})"


def _permuted(rounds: int) -> str:
    """Common table expressions p0 to p<rounds>: x moves from its slot to its block."""
    steps = []
    for i in range(1, rounds + 1):
        key = ("sid", "pass", str(i))
        steps.append(f"""q{i} AS (SELECT *, ({_hash(*key)} % blocks - x + blocks) % blocks AS o FROM p{i - 1}),
p{i} AS (SELECT shard, sid, blocks, pass,
  CASE WHEN {_hash(*key, "greatest(x, o)")} % 2 = 1 THEN o ELSE x END AS x FROM q{i})""")
    return ",\n".join(steps)


_W = ", ".join(f"{w}.0" for w in mixing.WEIGHTS)
_B, _N = mixing.BLOCK, mixing.SLOTS

MIXING = f"""
WITH rows AS (
  SELECT doc_id, source, coalesce(length(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         row_number() OVER () AS r
  FROM documents),
buckets AS (SELECT count(*) // {mixing.BUCKET_ROWS} + 1 AS n FROM rows),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM rows GROUP BY source),
weighed AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS sid, source_size * {mixing.REPEAT} AS cap,
         [{_W}][((row_number() OVER (ORDER BY source IS NULL, source) - 1) % {len(mixing.WEIGHTS)} + 1)::INT] AS weight
  FROM sums),
filling AS (
  SELECT *, row_number() OVER (ORDER BY cap / weight, sid) AS step,
    (sum(source_size) OVER () * {mixing.SHARE} - coalesce(sum(cap) OVER before, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER before, 0)) AS level
  FROM weighed
  WINDOW before AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
reached AS (SELECT arg_min(level, step) AS level FROM filling WHERE level * weight <= cap),
sources AS (
  SELECT sid, source, source_size, least(cap, coalesce((SELECT level FROM reached) * weight, cap))::DOUBLE AS target
  FROM filling),
quotas AS (
  SELECT *, floor(target * blocks / source_size + 0.5)::BIGINT AS quota
  FROM (SELECT *, ceil(source_size / {_B})::BIGINT AS blocks FROM sources WHERE source_size > 0)),
total AS (SELECT sum(quota)::BIGINT AS all_slots FROM quotas),
kinds AS (
  SELECT s.*, k.kind, k.n, quota * k.n // all_slots AS base, quota * k.n % all_slots AS odd, all_slots
  FROM quotas s, total, (SELECT 'full' AS kind, {_N} AS n UNION ALL SELECT 'last', all_slots % {_N} FROM total) k
  WHERE all_slots > 0),
odds AS (
  SELECT *, n - sum(base) OVER (PARTITION BY kind) AS rest, sum(odd) OVER (PARTITION BY kind) AS whole,
         coalesce(sum(odd) OVER (PARTITION BY kind ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo
  FROM kinds),
shards AS (
  SELECT o.*, g.shard FROM odds o, total, (SELECT unnest(range((all_slots + {_N - 1}) // {_N})) AS shard FROM total) g
  WHERE (g.shard = total.all_slots // {_N}) = (kind = 'last')),
counts AS (
  SELECT shard, sid, blocks, quota, base + (
    SELECT count(*) FROM (SELECT unnest(range(1, rest::BIGINT + 1)) AS i) d
    WHERE {_hash("shard", "i")} / {mixing.OTHER_PRIME}.0 * whole >= lo
      AND {_hash("shard", "i")} / {mixing.OTHER_PRIME}.0 * whole < lo + odd) AS n
  FROM shards),
firsts AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY sid ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    AS first FROM counts),
drawn AS (SELECT shard, sid, blocks, quota, first::BIGINT + unnest(range(n::BIGINT)) AS j FROM firsts),
freed AS (SELECT row_number() OVER (ORDER BY shard, sid, j) AS f, shard FROM drawn WHERE j >= quota),
short AS (SELECT row_number() OVER (ORDER BY sid, j) AS f, sid, blocks, j FROM (
  SELECT sid, blocks, unnest(range(sum(n)::BIGINT, quota)) AS j FROM firsts GROUP BY sid, blocks, quota)),
slots AS (SELECT shard, sid, blocks, j FROM drawn WHERE j < quota
  UNION ALL SELECT f.shard, s.sid, s.blocks, s.j FROM freed f JOIN short s USING (f)),
p0 AS (SELECT shard, sid, blocks, j // blocks AS pass, j % blocks AS x FROM slots),
{_permuted(mixing.ROUNDS)},
uses AS (SELECT sid, x AS block, count(*) AS uses FROM p{mixing.ROUNDS} GROUP BY ALL),
placed AS (
  SELECT r.*, s.sid, s.source_size, s.target, coalesce(sum(size) OVER (
    PARTITION BY s.sid ORDER BY coalesce(doc_id, 0) % n + CASE WHEN doc_id < 0 AND doc_id % n <> 0 THEN n ELSE 0 END,
      doc_id NULLS FIRST, size, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM rows r JOIN sources s ON r.source IS NOT DISTINCT FROM s.source, buckets),
cut AS (
  SELECT r, sid, start, size, unnest(range(start // {_B}, (start + size - 1) // {_B} + 1)) AS block
  FROM placed WHERE size > 0),
got AS (
  SELECT r, sum((least(start + size, (c.block + 1) * {_B}) - greatest(start, c.block * {_B})) * uses) AS taken
  FROM cut c JOIN uses USING (sid, block) GROUP BY r)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken
FROM placed LEFT JOIN got USING (r)
"""
