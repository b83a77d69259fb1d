"""Pieces of DuckDB SQL shared by the query checks."""


def pmod(x: str, m: str = "360") -> str:
    return f"(CASE WHEN ({x}) % {m} < 0 THEN (({x}) % {m}) + {m} ELSE ({x}) % {m} END)"


def wrap(x: str) -> str:
    return f"({pmod(f'({x}) + 180.0::DOUBLE')} - 180.0::DOUBLE)"


def inter(a: str, b: str) -> str:
    return (f"(GREATEST(0.0::DOUBLE, LEAST({a}.x1,{b}.x1) - GREATEST({a}.x0,{b}.x0)) * "
            f"GREATEST(0.0::DOUBLE, LEAST({a}.y1,{b}.y1) - GREATEST({a}.y0,{b}.y0)))")


def area(a: str) -> str:
    return f"(({a}.x1-{a}.x0)*({a}.y1-{a}.y0))"


def iou(a: str, b: str) -> str:
    i = inter(a, b)
    return f"(CASE WHEN {i} > 0 THEN {i} / ({area(a)} + {area(b)} - {i}) ELSE 0 END)"


def cont(a: str, b: str) -> str:
    i = inter(a, b)
    return f"(CASE WHEN {i} > 0 THEN {i} / LEAST({area(a)}, {area(b)}) ELSE 0 END)"


def flip_x(axis: str) -> str:
    return f"({axis} IN ('v','both'))"


def flip_y(axis: str) -> str:
    return f"({axis} IN ('h','both'))"


def mirrored_box(a: str, w: str, h: str, axis: str) -> str:
    fx, fy = flip_x(axis), flip_y(axis)
    return (f"CASE WHEN {fx} THEN {w}-{a}.x1 ELSE {a}.x0 END AS x0, CASE WHEN {fy} THEN {h}-{a}.y1 ELSE {a}.y0 END AS y0, "
            f"CASE WHEN {fx} THEN {w}-{a}.x0 ELSE {a}.x1 END AS x1, CASE WHEN {fy} THEN {h}-{a}.y0 ELSE {a}.y1 END AS y1")


AXIS_OF_SHEET = "CASE sheet_id % 3 WHEN 0 THEN 'v' WHEN 1 THEN 'h' ELSE 'both' END"


def mirrored_direction(dx: str, dy: str, axis: str) -> tuple[str, str]:
    rx = f"(CASE WHEN {flip_x(axis)} THEN -({dx}) ELSE {dx} END)"
    ry = f"(CASE WHEN {flip_y(axis)} THEN -({dy}) ELSE {dy} END)"
    ok = f"({rx} > 1e-6 OR ({rx} >= -1e-6 AND {ry} < 1e-6))"
    return f"(CASE WHEN {ok} THEN {rx} ELSE -{rx} END)", f"(CASE WHEN {ok} THEN {ry} ELSE -{ry} END)"


def mirrored_angle(angle: str, axis: str) -> str:
    dx, dy = mirrored_direction(f"COS(RADIANS({angle}))", f"(-SIN(RADIANS({angle})))", axis)
    return f"(ROUND(-DEGREES(ATAN2({dy}, {dx})), 6) + 0.0::DOUBLE)"


DASH = "\\-‐-―"
TRAIL = f"^(.*?)[\\s{DASH}]*(\\d+)$"


def fold(x: str) -> str:
    out = f"LOWER({x})"
    for a, b in (("ø", "o"), ("æ", "ae"), ("å", "aa"), ("ö", "o"), ("ä", "ae"), ("ß", "ss")):
        out = f"REPLACE({out}, '{a}', '{b}')"
    return f"STRIP_ACCENTS({out})"


def snap_steps(source: str, text: str) -> str:
    """Steps ending in ``snapped`` (all columns of source + text_out, kind, changed, confidence, warned)."""
    return f"""
s_base AS (SELECT *, REGEXP_REPLACE(REGEXP_REPLACE({text}, '^\\s+|\\s+$', '', 'g'), '^[{DASH}]+|[{DASH}]+$', '', 'g') AS t FROM {source}),
s_split AS (SELECT *, CASE WHEN REGEXP_MATCHES(t, '{TRAIL}') THEN REGEXP_EXTRACT(t, '{TRAIL}', 1) ELSE t END AS head,
  CASE WHEN REGEXP_MATCHES(t, '{TRAIL}') THEN ' ' || REGEXP_EXTRACT(t, '{TRAIL}', 2) ELSE '' END AS tail FROM s_base),
s_rooms AS (SELECT ord, word, LOWER(word) AS lw, {fold('word')} AS fw FROM rooms),
s_low AS (SELECT lw, MIN(word) AS low_word FROM s_rooms GROUP BY lw HAVING COUNT(*) = 1),
s_fold AS (SELECT fw, MIN(word) AS fold_word FROM s_rooms GROUP BY fw HAVING COUNT(*) = 1),
s_abbr AS (SELECT * FROM (VALUES ('vaer','Vær.'),('vr.','Vær.'),('kok','Køkken'),('bad/toilet','Bad/WC')) AS a(fa, abbr_word)),
s_heads AS (SELECT DISTINCT head, {fold('head')} AS fh FROM s_split),
s_best AS (SELECT head, word AS fuzzy_word, score FROM (
  SELECT h.head, r.word, 100 * (1 - LEVENSHTEIN(h.fh, r.fw)::DOUBLE / GREATEST(LENGTH(h.fh), LENGTH(r.fw))) AS score,
    ROW_NUMBER() OVER (PARTITION BY h.head ORDER BY LEVENSHTEIN(h.fh, r.fw)::DOUBLE / GREATEST(LENGTH(h.fh), LENGTH(r.fw)), r.ord) AS rn
  FROM s_heads AS h CROSS JOIN s_rooms AS r WHERE LENGTH(h.fh) >= 3) WHERE rn = 1),
s_all AS (SELECT s.*, COALESCE(l.low_word, f.fold_word) AS word, a.abbr_word, b.fuzzy_word, b.score,
    EXISTS (SELECT 1 FROM rooms AS r WHERE r.word = s.head) AS exact
  FROM s_split AS s LEFT JOIN s_low AS l ON l.lw = LOWER(s.head) LEFT JOIN s_heads AS h ON h.head = s.head
  LEFT JOIN s_fold AS f ON f.fw = h.fh LEFT JOIN s_abbr AS a ON a.fa = h.fh LEFT JOIN s_best AS b ON b.head = s.head),
s_tier AS (SELECT *, CASE WHEN REGEXP_FULL_MATCH(t, '\\d{{2,5}}') THEN 'dim'
    WHEN REGEXP_FULL_MATCH(t, '\\d{{1,3}}(?:[,.]\\d{{1,2}})?\\s*m[²2]?') THEN 'area'
    WHEN t IN ('H*','HS','EL','VVB','GA','ST','T') THEN 'note' WHEN exact THEN 'exact' WHEN word IS NOT NULL THEN 'word'
    WHEN abbr_word IS NOT NULL THEN 'abbr' WHEN score >= 70 THEN 'fuzzy' WHEN conf < 0.85::DOUBLE AND t = '1' THEN 'swap'
    ELSE 'none' END AS tier FROM s_all),
snapped AS (SELECT *, CASE tier WHEN 'word' THEN word || tail WHEN 'abbr' THEN abbr_word || tail
      WHEN 'fuzzy' THEN fuzzy_word || tail WHEN 'swap' THEN 'T' ELSE t END AS text_out,
    CASE tier WHEN 'dim' THEN 'dimension' WHEN 'area' THEN 'area' WHEN 'note' THEN 'annotation' WHEN 'swap' THEN 'annotation'
      WHEN 'none' THEN 'unknown' ELSE 'room' END AS kind,
    CASE tier WHEN 'word' THEN word || tail <> t WHEN 'abbr' THEN abbr_word || tail <> t
      WHEN 'fuzzy' THEN fuzzy_word || tail <> t WHEN 'swap' THEN TRUE ELSE FALSE END AS changed,
    CASE tier WHEN 'abbr' THEN 0.9::DOUBLE WHEN 'fuzzy' THEN score / 100 WHEN 'swap' THEN conf WHEN 'none' THEN 0::DOUBLE ELSE 1::DOUBLE END AS confidence,
    CASE tier WHEN 'dim' THEN NOT (t::INT BETWEEN 200 AND 20000) WHEN 'swap' THEN TRUE WHEN 'none' THEN TRUE ELSE FALSE END AS warned
  FROM s_tier)
"""


SYMBOL = ("(NOT REGEXP_MATCHES({x}, '[\\p{{L}}\\p{{N}}]') OR REGEXP_MATCHES({x}, "
          "'[\\x{{0400}}-\\x{{04FF}}\\x{{0590}}-\\x{{08FF}}\\x{{2E80}}-\\x{{9FFF}}\\x{{AC00}}-\\x{{D7A3}}]'))")


def symbol(x: str) -> str:
    return SYMBOL.format(x=x)
