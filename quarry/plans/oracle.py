"""The oracle's own reading of the rules, as SQL over the star schema: written from the rules, not from the engine's plans."""

import re

from quarry.sources.star import FACTS

#: Modules as made up by the facts: known from where a file was put, without any rule of module identity.
WITH = f"""WITH RECURSIVE {FACTS.replace(' STRING', ' VARCHAR').replace(' concat(', ' concat(')},
placed AS (
  SELECT id, project_no, lang, path, nation,
    CASE lang WHEN 'go' THEN 'package:n' || nation || '/p' || (id % 5) WHEN 'php' THEN 'namespace:n' || nation || '/f' || id WHEN 'typescript' THEN 'relative:n' || nation || '/f' || id ELSE 'n' || nation || '.f' || id END AS module,
    regexp_replace(path, '/[^/]*$', '') AS package
  FROM files),
named AS (SELECT s.id, s.file_id, s.target, s.symbol, s.alias, p.module AS module_abs FROM spelled s JOIN placed p ON p.id = s.target),
nodes AS (SELECT id, file_id, kind, name, start_byte, end_byte, body_end FROM defs UNION ALL SELECT id, id, 'module', module, 0, 0, 0 FROM placed)"""



def within(files: str) -> str:
    """WITH, for the definitions and references of some files alone: a condition on {}, a file's id. Imports and modules stay as they are."""
    facts, rest = WITH.split(",\nplaced AS", 1)
    facts = re.sub(r"\b(defs|refs)\b", r"\g<1>_of_all", facts)
    few = ", ".join(f"{t} AS (SELECT * FROM {t}_of_all WHERE {files.format('file_id')})" for t in ("defs", "refs"))
    return f"{facts},\n{few},\nplaced AS" + rest.replace("0, 0, 0 FROM placed)", f"0, 0, 0 FROM placed WHERE {files.format('id')})")


CONTAIN = """,
parent AS (
  SELECT a.id, arg_min(b.id, (b.body_end - b.start_byte) * 10000000000 + b.id) AS parent
  FROM defs a JOIN defs b ON a.file_id = b.file_id AND a.id <> b.id AND b.start_byte <= a.start_byte AND a.start_byte < b.body_end GROUP BY a.id),
enclosing AS (
  SELECT r.id AS ref_id, arg_min(b.id, (b.body_end - b.start_byte) * 10000000000 + b.id) AS enclosing
  FROM refs r JOIN defs b ON r.file_id = b.file_id AND b.start_byte <= r.site AND r.site < b.body_end GROUP BY r.id),
up AS (
  SELECT id, id AS at FROM defs UNION ALL SELECT up.id, parent.parent FROM up JOIN parent ON parent.id = up.at JOIN defs d ON d.id = up.at WHERE d.kind <> 'class'),
class_of AS (SELECT up.id, up.at AS class_id FROM up JOIN defs d ON d.id = up.at WHERE d.kind = 'class')"""

#: The whole pool of every reference, narrowed and rated row by row.
RESOLVE = CONTAIN + """,
r AS (
  SELECT refs.*, p.module AS own_module, p.package AS own_package, (NOT is_member OR receiver IN ('self', 'this', '$this', 'cls', 'me', 'static', 'parent', 'super') OR receiver_self) AS open
  FROM refs JOIN placed p ON p.id = refs.file_id),
names AS (
  SELECT file_id, local, arg_max(module_abs, id) AS module FROM (
    SELECT id, file_id, module_abs, CASE WHEN symbol <> '' AND alias <> '' THEN alias WHEN symbol <> '' THEN symbol ELSE alias END AS local FROM named) WHERE local <> '' GROUP BY file_id, local),
aims AS (
  SELECT r.id AS ref_id, n.module_abs AS module FROM r JOIN named n USING (file_id)
  WHERE NOT open AND receiver <> '' AND CASE WHEN n.module_abs LIKE 'namespace:%' THEN lower(receiver) = regexp_extract(n.module_abs, '[^/]*$') WHEN n.module_abs LIKE '%:%' THEN receiver = regexp_extract(n.module_abs, '[^/]*$') ELSE receiver = regexp_extract(n.module_abs, '[^.]*$') END
  UNION SELECT r.id, names.module FROM r JOIN names ON names.file_id = r.file_id AND local = receiver WHERE NOT open AND receiver <> ''
  UNION SELECT r.id, names.module || CASE WHEN names.module LIKE '%:%' THEN '/' ELSE '.' END || receiver FROM r JOIN names ON names.file_id = r.file_id AND local = receiver WHERE NOT open AND receiver <> ''),
pool AS (SELECT d.id AS dst, d.name, d.file_id AS d_file, p.module AS d_module, p.package AS d_package FROM defs d JOIN placed p ON p.id = d.file_id),
met AS (
  SELECT r.id AS ref_id, pool.*, r.file_id AS r_file, r.own_package FROM r JOIN pool USING (name) WHERE open
  UNION ALL SELECT r.id, pool.*, r.file_id, r.own_package FROM r JOIN pool USING (name) JOIN aims ON aims.ref_id = r.id AND aims.module = d_module WHERE NOT open),
rated AS (
  SELECT m.ref_id, m.dst,
    CASE WHEN d_file = r_file THEN CASE WHEN pa.parent = c.class_id THEN 0.95::DOUBLE ELSE 0.9::DOUBLE END
      WHEN names.module = d_module THEN 0.85::DOUBLE WHEN EXISTS (SELECT 1 FROM named n WHERE n.file_id = r_file AND n.module_abs = d_module) THEN 0.7::DOUBLE WHEN own_package = d_package THEN 0.4::DOUBLE END AS tier,
    0.3::DOUBLE / count(*) OVER (PARTITION BY m.ref_id) AS share
  FROM met m LEFT JOIN names ON names.file_id = r_file AND names.local = m.name LEFT JOIN parent pa ON pa.id = m.dst LEFT JOIN enclosing e ON e.ref_id = m.ref_id LEFT JOIN class_of c ON c.id = e.enclosing),
kept AS (
  SELECT ref_id, dst, coalesce(tier, share) AS confidence,
    CASE WHEN tier IS NULL THEN 'global' WHEN tier = 0.95::DOUBLE THEN 'same_class' WHEN tier = 0.9::DOUBLE THEN 'same_file' WHEN tier = 0.4::DOUBLE THEN 'package' ELSE 'import' END AS evidence
  FROM (SELECT *, max(tier) OVER (PARTITION BY ref_id) AS best FROM rated) WHERE CASE WHEN best IS NULL THEN share >= 0.05::DOUBLE ELSE tier = best END),
resolved AS (SELECT *, count(*) OVER (PARTITION BY ref_id) AS candidate_count, count(*) OVER (PARTITION BY ref_id) = 1 AS resolved FROM kept)"""

#: Calls, references and implementations by reference, from the enclosing definition or else the file's module.
LINKS = RESOLVE + """,
links AS (
  SELECT coalesce(e.enclosing, r.file_id) AS src, z.dst, r.kind, z.confidence, z.evidence, z.candidate_count, z.resolved, r.id AS ref_id
  FROM resolved z JOIN r ON r.id = z.ref_id LEFT JOIN enclosing e ON e.ref_id = r.id),
file_links AS (SELECT DISTINCT n.file_id AS src, p.id AS dst FROM named n JOIN placed p ON p.module = n.module_abs WHERE p.id <> n.file_id)"""
