"""The general problems' queries in SQL."""

_BLANK = "(coalesce(trim(regexp_replace({0}, '\\s+', ' ', 'g')), '') = '')"


def _p1() -> str:
    day = (
        "coalesce(try_cast(regexp_extract(trim({v}), '^(\\d{{4}}-\\d{{1,2}}-\\d{{1,2}})', 1) AS DATE),"
        " CAST(try_strptime(trim({v}), '%d/%m/%Y') AS DATE), CAST(try_strptime(trim({v}), '%d-%b-%Y') AS DATE))"
    )
    number = "try_cast(replace(replace(trim({v}), '£', ''), ',', '') AS DECIMAL(28, 8))"
    boolean = "CASE WHEN lower(trim({v})) IN ('true', 't', 'yes', 'y', '1') THEN 'true' WHEN lower(trim({v})) IN ('false', 'f', 'no', 'n', '0') THEN 'false' END"
    text = "nfc_normalize(lower(nfc_normalize(trim(regexp_replace({v}, '\\s+', ' ', 'g')))))"
    meant = (
        "coalesce(CASE WHEN k IN ('dateOfBirth', 'startDate', 'endDate', 'attemptDate') THEN CAST(" + day + " AS VARCHAR)"
        " WHEN k IN ('yearOfStudy', 'grossFee', 'netFee', 'credits', 'mark') THEN CAST(" + number + " AS VARCHAR)"
        " WHEN k IN ('isActive', 'isCore', 'resit') THEN " + boolean + " END, " + text + ")"
    )
    return f"""
WITH latest AS (
  SELECT * FROM canonical_record WHERE side IN ('a', 'b')
  QUALIFY row_number() OVER (PARTITION BY side, entity, id ORDER BY projected_at DESC NULLS LAST, row_id DESC) = 1),
a AS (SELECT * FROM latest WHERE side = 'a'), b AS (SELECT * FROM latest WHERE side = 'b'),
both_sides AS (SELECT a.entity, a.id, a.fields fa, b.fields fb FROM a JOIN b ON a.entity IS NOT DISTINCT FROM b.entity AND a.id IS NOT DISTINCT FROM b.id),
names AS (SELECT entity, id, fa, fb, unnest(list_distinct(list_concat(map_keys(fa), map_keys(fb)))) k FROM both_sides),
vals AS (SELECT entity, id, k, fa[k] x, fb[k] y FROM names),
said AS (
  SELECT entity, id, k, CASE WHEN {_BLANK.format("x")} AND {_BLANK.format("y")} THEN NULL WHEN {_BLANK.format("x")} THEN 'null-in-a' WHEN {_BLANK.format("y")} THEN 'null-in-b'
    WHEN {meant.format(v="x")} <> {meant.format(v="y")} THEN 'mismatch' END status FROM vals)
SELECT entity, id, k AS field_name, status FROM said WHERE status IS NOT NULL
UNION ALL SELECT entity, id, '<record>', 'missing-in-b' FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.entity IS NOT DISTINCT FROM b.entity AND a.id IS NOT DISTINCT FROM b.id)
UNION ALL SELECT entity, id, '<record>', 'missing-in-a' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.entity IS NOT DISTINCT FROM b.entity AND a.id IS NOT DISTINCT FROM b.id)
"""


_P4 = """
WITH s0 AS (SELECT *, regexp_replace(sgbstdn_term_code_eff, '[\\s/-]', '', 'g') term FROM sgbstdn WHERE sgbstdn_pidm IS NOT NULL),
s1 AS (SELECT CAST(sgbstdn_pidm AS VARCHAR) k, term, {'a': sgbstdn_stst_code, 'b': sgbstdn_styp_code, 'c': sgbstdn_majr_code_1, 'd': sgbstdn_camp_code, 'e': sgbstdn_resd_code, 'f': sgbstdn_mode_code} v
  FROM s0 WHERE regexp_full_match(term, '[0-9]{6}')
  QUALIFY row_number() OVER (PARTITION BY sgbstdn_pidm, term ORDER BY sgbstdn_activity_date DESC NULLS LAST, row_id DESC) = 1),
s2 AS (SELECT *, lag(v) OVER w IS NOT DISTINCT FROM v AND lag(k) OVER w IS NOT NULL same FROM s1 WINDOW w AS (PARTITION BY k ORDER BY term)),
p1 AS (SELECT CAST(spriden_pidm AS VARCHAR) k, strftime(spriden_activity_date, '%Y-%m-%d') d, {'a': spriden_id, 'b': spriden_last_name, 'c': spriden_first_name, 'd': spriden_mi} v
  FROM spriden WHERE spriden_activity_date IS NOT NULL AND spriden_pidm IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY spriden_pidm, CAST(spriden_activity_date AS DATE) ORDER BY spriden_change_ind IS NULL DESC, row_id DESC) = 1),
p2 AS (SELECT *, lag(v) OVER w IS NOT DISTINCT FROM v AND lag(k) OVER w IS NOT NULL same FROM p1 WINDOW w AS (PARTITION BY k ORDER BY d)),
c0 AS (SELECT map_id || '|' || sourcecode k, coalesce(nullif(trim(activefrom), ''), '0001-01-01') f, coalesce(nullif(trim(activeto), ''), '9999-12-31') t, targetcode v, entry_id FROM codeset_map_entry),
c1 AS (SELECT * FROM c0 WHERE t > f AND k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY k, f ORDER BY entry_id DESC) = 1),
c2 AS (SELECT k, f, v, least(t, coalesce(lead(f) OVER (PARTITION BY k ORDER BY f), '9999-12-31')) t FROM c1),
c3 AS (SELECT *, lag(v) OVER w IS NOT DISTINCT FROM v AND coalesce(lag(t) OVER w = f, false) same FROM c2 WINDOW w AS (PARTITION BY k ORDER BY f)),
c4 AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY k ORDER BY f) g FROM c3)
SELECT 'sgbstdn' AS source_table, k AS entity_key, term AS valid_from, coalesce(lead(term) OVER (PARTITION BY k ORDER BY term), '999999') AS valid_to FROM s2 WHERE NOT same
UNION ALL SELECT 'spriden', k, d, coalesce(lead(d) OVER (PARTITION BY k ORDER BY d), '9999-12-31') FROM p2 WHERE NOT same
UNION ALL SELECT 'codeset_map_entry', k, min(f), max(t) FROM c4 GROUP BY k, g
"""

_P5_PARTS = """
WITH refs AS (
  SELECT 'sgbstdn' t, row_id, CAST(sgbstdn_pidm AS VARCHAR) k, loaded_at FROM sgbstdn
  UNION ALL SELECT 'engagement', row_id, nullif(lower(regexp_replace(studentid, '[\\s{}]', '', 'g')), ''), loaded_at FROM engagement
  UNION ALL SELECT 't1_ar_customer', row_id, nullif(regexp_replace(upper(regexp_replace(customercode, '[\\s-]', '', 'g')), '^([A-Z]*)0+([0-9])', '\\1\\2'), ''), loaded_at FROM t1_ar_customer WHERE upper(trim(customertypecode)) = 'STU'),
rows_of AS (
  SELECT 'sgbstdn' t, CAST(spriden_pidm AS VARCHAR) k, spriden_change_ind IS NULL live, loaded_at FROM spriden
  UNION ALL SELECT 'engagement', nullif(lower(regexp_replace(id, '[\\s{}]', '', 'g')), ''), deleted_at IS NULL, loaded_at FROM student
  UNION ALL SELECT 't1_ar_customer', nullif(regexp_replace(upper(regexp_replace(stu_code, '[\\s-]', '', 'g')), '^([A-Z]*)0+([0-9])', '\\1\\2'), ''), deleted_at IS NULL, loaded_at FROM stu),
parents AS (SELECT t, k, bool_or(live) live, min(loaded_at) first_at FROM rows_of WHERE k IS NOT NULL GROUP BY t, k),
said AS (
  SELECT r.t child_table, r.row_id, r.loaded_at, CASE WHEN p.k IS NULL THEN 'missing' WHEN NOT p.live THEN 'deleted' WHEN p.first_at > r.loaded_at THEN 'late' END kind
  FROM refs r LEFT JOIN parents p ON r.t = p.t AND r.k = p.k WHERE r.k IS NOT NULL)
"""

_P6_PARTS = """
WITH runs AS (
  SELECT tenant_id, run_id, max(delivery) last_one, row_number() OVER (PARTITION BY tenant_id ORDER BY max(run_started_at), run_id) seq, lead(run_id) OVER (PARTITION BY tenant_id ORDER BY max(run_started_at), run_id) run_after
  FROM finding GROUP BY tenant_id, run_id),
items AS (
  SELECT f.tenant_id, f.run_id, r.seq, r.run_after, f.severity, f.message, f.rule_predicate, list_sort(map_entries(f.evidence)) ev,
    concat(f.rule_id, '::', f.entity_type, '::', f.subject_id, '::', coalesce(array_to_string(list_transform(list_sort(map_entries(f.native_keys)), lambda e: e.key || '=' || coalesce(e.value, '')), '|'), '')) k
  FROM finding f JOIN runs r ON f.tenant_id = r.tenant_id AND f.run_id = r.run_id AND f.delivery = r.last_one
  QUALIFY row_number() OVER (PARTITION BY f.tenant_id, f.run_id, k ORDER BY f.detected_at DESC NULLS LAST, f.row_id DESC) = 1),
delta AS (
  SELECT c.run_id, c.k delta_key, CASE WHEN p.k IS NULL THEN 'new' WHEN (c.severity, c.message, c.rule_predicate, c.ev) IS DISTINCT FROM (p.severity, p.message, p.rule_predicate, p.ev) THEN 'changed' END kind
  FROM items c LEFT JOIN items p ON c.tenant_id = p.tenant_id AND c.seq = p.seq + 1 AND c.k = p.k WHERE c.seq > 1
  UNION ALL SELECT p.run_after, p.k, 'resolved' FROM items p LEFT JOIN items c ON c.tenant_id = p.tenant_id AND c.seq = p.seq + 1 AND c.k = p.k WHERE p.run_after IS NOT NULL AND c.k IS NULL)
"""

_WORDS = "('', '-', '--', '.', '?', 'n/a', 'na', 'n/k', 'nk', 'none', 'nil', 'null', 'nan', 'unknown', 'not known', 'tbc', 'tbd', 'x', 'xx', 'xxx'"
_P7 = f"""
WITH s AS (
  SELECT tenant_id, load_id, load_date, dateofbirth b, nationality c,
    b IS NULL OR lower(trim(b)) IN {_WORDS}, '0000-00-00', '0001-01-01', '1111-11-11', '1900-01-01', '9999-12-31', '9999-99-99') bm,
    c IS NULL OR lower(trim(c)) IN {_WORDS}, '000', '999') cm,
    CASE WHEN NOT bm AND regexp_full_match(b, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(b AS DATE) END d,
    CASE WHEN NOT cm AND regexp_full_match(c, '\\d{{3}}') THEN c END w FROM student),
o AS (SELECT load_id, lag(load_id) OVER (PARTITION BY tenant_id ORDER BY load_date, load_id) prev FROM (SELECT DISTINCT tenant_id, load_id, load_date FROM s)),
l AS (
  SELECT load_id, count(*) n, count(*) FILTER (bm) bm, count(*) FILTER (cm) cm, count(d) bw, count(w) cw, median(year(d)) med,
    count(*) FILTER (d IS NOT NULL AND NOT (year(load_date) - year(d) BETWEEN 15 AND 90)) oor FROM s GROUP BY load_id),
h AS (SELECT load_id, max(n) top FROM (SELECT load_id, d, count(*) n FROM s WHERE d IS NOT NULL GROUP BY load_id, d) GROUP BY load_id),
sh AS (SELECT load_id, w, count(*) * 1.0 / sum(count(*)) OVER (PARTITION BY load_id) share FROM s WHERE w IS NOT NULL GROUP BY load_id, w),
pairs AS (SELECT o.load_id, sh.w, sh.share x, 0.0 y FROM o JOIN sh ON sh.load_id = o.load_id WHERE prev IS NOT NULL UNION ALL SELECT o.load_id, sh.w, 0.0, sh.share FROM o JOIN sh ON sh.load_id = o.prev),
tv AS (SELECT load_id, sum(abs(x - y)) / 2 tv FROM (SELECT load_id, w, sum(x) x, sum(y) y FROM pairs GROUP BY load_id, w) GROUP BY load_id HAVING sum(x) > 0.5 AND sum(y) > 0.5),
e AS (SELECT tenant_id, load_id, load_date, count(*) FILTER (dhp IS NOT NULL AND (isnan(dhp) OR dhp < 0 OR dhp > 1)) bad, avg(CASE WHEN NOT isnan(dhp) AND dhp BETWEEN 0 AND 1 THEN dhp END) m FROM entity_dhp GROUP BY ALL),
e2 AS (SELECT *, lag(m) OVER (PARTITION BY tenant_id ORDER BY load_date, load_id) mb FROM e)
SELECT load_id, 'dateofbirth' AS column_name, 'missing' AS issue FROM l WHERE bm > 0.15 * n
UNION ALL SELECT load_id, 'nationality', 'missing' FROM l WHERE cm > 0.15 * n
UNION ALL SELECT load_id, 'dateofbirth', 'pattern' FROM l WHERE n - bm - bw > 0.15 * (n - bm)
UNION ALL SELECT load_id, 'nationality', 'pattern' FROM l WHERE n - cm - cw > 0.15 * (n - cm)
UNION ALL SELECT load_id, 'dateofbirth', 'range' FROM l WHERE oor > 0.15 * bw
UNION ALL SELECT load_id, 'dhp', 'range' FROM e WHERE bad > 0
UNION ALL SELECT load_id, 'dateofbirth', 'heap' FROM l JOIN h USING (load_id) WHERE top > 0.15 * bw
UNION ALL SELECT o.load_id, 'dateofbirth', 'shift' FROM o JOIN l a ON a.load_id = o.load_id JOIN l b ON b.load_id = o.prev WHERE abs(a.med - b.med) > 6
UNION ALL SELECT load_id, 'nationality', 'shift' FROM tv WHERE tv > 0.35
UNION ALL SELECT load_id, 'dhp', 'shift' FROM e2 WHERE abs(m - mb) > 0.1
"""

_P7_PROFILE = f"""
WITH s AS (
  SELECT tenant_id, load_id, load_date, dateofbirth b, nationality c,
    b IS NULL OR lower(trim(b)) IN {_WORDS}, '0000-00-00', '0001-01-01', '1111-11-11', '1900-01-01', '9999-12-31', '9999-99-99') bm,
    c IS NULL OR lower(trim(c)) IN {_WORDS}, '000', '999') cm,
    CASE WHEN NOT bm AND regexp_full_match(b, '\\d{{4}}-\\d{{2}}-\\d{{2}}') THEN try_cast(b AS DATE) END d,
    CASE WHEN NOT cm AND regexp_full_match(c, '\\d{{3}}') THEN CAST(c AS DOUBLE) END w FROM student),
v AS (
  SELECT 'dateofbirth' column_name, tenant_id, load_id, load_date, b AS value, bm AS missing, CAST(year(d) AS DOUBLE) m, d IS NOT NULL AND NOT (year(load_date) - year(d) BETWEEN 15 AND 90) oor FROM s
  UNION ALL SELECT 'nationality', tenant_id, load_id, load_date, c, cm, w, false FROM s
  UNION ALL SELECT 'dhp', tenant_id, load_id, load_date, CAST(dhp AS VARCHAR), dhp IS NULL, CASE WHEN NOT isnan(dhp) AND dhp BETWEEN 0 AND 1 THEN dhp END, dhp IS NOT NULL AND (isnan(dhp) OR NOT dhp BETWEEN 0 AND 1) FROM entity_dhp),
f AS (
  SELECT column_name, min(tenant_id) tenant, load_id, min(load_date) load_date, count(*) "rows", count(*) FILTER (missing) missing, count(*) FILTER (NOT missing AND m IS NULL) ill_formed, count(m) well_formed, count(*) FILTER (oor) out_of_range,
    count(DISTINCT value) FILTER (m IS NOT NULL) AS "distinct", min(m) low, max(m) high, median(m) median, avg(m) mean FROM v GROUP BY column_name, load_id),
h AS (SELECT column_name, load_id, max(n) top FROM (SELECT column_name, load_id, value, count(*) n FROM v WHERE m IS NOT NULL GROUP BY ALL) GROUP BY ALL),
p AS (SELECT *, lag(load_id) OVER w previous_load, lag(median) OVER w median_before, lag(mean) OVER w mean_before, lag(well_formed) OVER w wb FROM f WINDOW w AS (PARTITION BY column_name, tenant ORDER BY load_date, load_id)),
x AS (
  SELECT p.column_name, p.load_id, v.m, v.value, 1.0 / p.well_formed a, 0.0 b FROM p JOIN v ON v.column_name = p.column_name AND v.load_id = p.load_id AND v.m IS NOT NULL WHERE p.wb > 0
  UNION ALL SELECT p.column_name, p.load_id, v.m, v.value, 0.0, 1.0 / p.wb FROM p JOIN v ON v.column_name = p.column_name AND v.load_id = p.previous_load AND v.m IS NOT NULL WHERE p.well_formed > 0),
y AS (SELECT column_name, load_id, m, value, sum(a) a, sum(b) b FROM x GROUP BY ALL),
tv AS (SELECT column_name, load_id, sum(abs(a - b)) / 2 tv FROM y GROUP BY ALL),
ks AS (SELECT column_name, load_id, max(abs(d)) ks FROM (SELECT column_name, load_id, sum(sum(a) - sum(b)) OVER (PARTITION BY column_name, load_id ORDER BY m) d FROM y GROUP BY column_name, load_id, m) GROUP BY ALL)
SELECT p.column_name, p.tenant, p.load_id, CAST(p.load_date AS VARCHAR) AS load_date, p."rows", p.missing, p.ill_formed, p.well_formed, p.out_of_range, p."distinct", round(p.low, 9) AS low, round(p.high, 9) AS high, round(p.median, 9) AS median, round(p.mean, 9) AS mean,
  round(h.top / p.well_formed, 9) AS heap, CAST(p.previous_load AS VARCHAR) AS previous_load, round(p.median_before, 9) AS median_before, round(p.mean_before, 9) AS mean_before, round(ks.ks, 9) AS ks, round(tv.tv, 9) AS tv
FROM p LEFT JOIN h USING (column_name, load_id) LEFT JOIN ks USING (column_name, load_id) LEFT JOIN tv USING (column_name, load_id)
"""

SQL = {
    "p1_found": _p1(),
    "p4_found": _P4,
    "p5_found": _P5_PARTS + "SELECT child_table, row_id, kind FROM said WHERE kind IS NOT NULL",
    "p5_counts": _P5_PARTS + "SELECT child_table, strftime(loaded_at, '%Y-%m') AS period, kind, count(*) AS n FROM said WHERE kind IS NOT NULL GROUP BY ALL",
    "p6_found": _P6_PARTS + "SELECT run_id, delta_key, kind FROM delta WHERE kind IS NOT NULL",
    "p6_counts": _P6_PARTS + "SELECT run_id, count(*) FILTER (kind = 'new') AS new_count, count(*) FILTER (kind = 'resolved') AS resolved_count, count(*) FILTER (kind = 'changed') AS changed_count FROM delta WHERE kind IS NOT NULL GROUP BY run_id",
    "p7_found": _P7,
    "p7_profile": _P7_PROFILE,
}
