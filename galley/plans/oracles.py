"""The queries again in DuckDB's SQL, by other ways: windows for arrays, recursion for folds, sentinels for look-behind."""

from __future__ import annotations

from galley.plans.queries import MAX_CHARS, MODELS, NUM_CTX, OVERLAY, VRAM
from galley.plans.values import ALIASES, ARTEFACTS, DANGLING, FOREIGN, FORMATS, PLAIN, RANGES, SOURCE_LANGUAGE, STOPWORDS, SUFFIX, TIERS, WS


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _strip(t: str) -> str:
    return f"regexp_replace({t}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def _squeeze(t: str) -> str:
    return f"regexp_replace({_strip(t)}, '[{WS}]+', ' ', 'g')"


def _n(t: str, cls: str) -> str:
    return f"length(regexp_replace({t}, '[^{cls}]', '', 'g'))"


def _share(part: str, latin: str) -> str:
    return f"CASE WHEN {part} + {latin} > 0 THEN {part} * 1.0::DOUBLE / ({part} + {latin}) ELSE 0.0::DOUBLE END"


def _foreign(t: str) -> str:
    return _share(_n(t, FOREIGN), _n(t, RANGES["latin"]))


def _in(values) -> str:
    return "(" + ", ".join(_q(v) for v in values) + ")"


_ORDER = "chapter_ord, seg_index, seg_id"
_JOBS = "seg_index, span_index, job_id"


# --- scores -----------------------------------------------------------------
def _edge(p: str) -> str:
    return rf"(^|[^\p{{L}}\p{{N}}_])({p})([^\p{{L}}\p{{N}}_]|$)"


def _artefacts(t: str) -> str:
    cases = []
    for p, weight, whole in ARTEFACTS:
        cases.append(f"CASE WHEN regexp_matches({t}, {_q(_edge(p) if whole else p)}, 'i') THEN {weight} ELSE 0 END")
    return " + ".join(cases)


def _boiler(t: str) -> str:
    s = _strip(t)
    return rf"(length({s}) < 2 OR regexp_matches({s}, '^(page[{WS}]*)?\p{{Nd}}+([{WS}]*/[{WS}]*\p{{Nd}}+)?$|^(copyright|contents|cover|title page)$', 'i') OR NOT regexp_matches({t}, '\p{{L}}'))"


_HEADINGS = "('h1','h2','h3','h4','h5','h6')"


def _dirt(t: str, tag: str, mode: str = "polish", hit: str = "FALSE") -> str:
    base = f"(CASE WHEN {hit} THEN 2 ELSE 0 END + CASE WHEN regexp_matches({t}, '[{RANGES['han']}]') THEN 3 ELSE 0 END + {_artefacts(t)})"
    score = f"CASE WHEN {tag} IN {_HEADINGS} THEN greatest(0, {base} - 1) ELSE {base} END"
    far = f"WHEN {_foreign(t)} >= 0.18 THEN 10 " if mode == "translate" else ""
    return f"(CASE WHEN {_boiler(t)} THEN 0 {far}ELSE {score} END)"


def _needs(t: str, tag: str, mode: str, least: int) -> str:
    wanted = "TRUE" if least <= 0 else f"({_foreign(t)} >= 0.08 OR {_dirt(t, tag, mode)} >= 1)" if mode == "translate" else f"{_dirt(t, tag, mode)} >= {least}"
    return f"(coalesce({tag} NOT IN ('pre','code','samp'), TRUE) AND NOT {_boiler(t)} AND {wanted})"


# --- units: sentinels instead of a look-behind, windows instead of folds ---------
_CL = "[\"''”’)]*"


def _sentences(source: str, keys: str, t: str = "text") -> str:
    """(keys, unit_pos, text): marks after a digit and three dots are hidden, then ends are cut."""
    a = rf"regexp_replace({t}, '\.\.\.({_CL})([{WS}]+|$)', chr(57345) || '\1\2' || chr(57344), 'g')"
    for mark, sign in ((r"\.", 57346), ("!", 57347), (r"\?", 57348)):
        a = rf"regexp_replace({a}, '(\p{{Nd}}){mark}', '\1' || chr({sign}), 'g')"
    a = rf"regexp_replace({a}, '((?:…|[.!?]|[。！？]){_CL}(?:[{WS}]+|$))', '\1' || chr(57344), 'g')"
    back = "u"
    for sign, mark in ((57345, "..."), (57346, "."), (57347, "!"), (57348, "?")):
        back = f"replace({back}, chr({sign}), '{mark}')"
    return f"SELECT {keys}, row_number() OVER (PARTITION BY seg_id ORDER BY i) - 1 AS unit_pos, {back} AS text FROM (SELECT {keys}, unnest(string_split(x, chr(57344))) AS u, generate_subscripts(string_split(x, chr(57344)), 1) AS i FROM (SELECT {keys}, {a} AS x FROM {source})) WHERE u <> ''"


def _long(units: str, keys: str) -> str:
    """Stage after stage: units over 240 divided at each sign, at last by length."""
    step = f"SELECT {keys}, ARRAY[unit_pos] AS p, text FROM ({units})"
    for sign in ("; ", " — ", " - ", ", "):
        cut = f"string_split(replace(text, '{sign}', '{sign}' || chr(57344)), chr(57344))"
        step = f"SELECT {keys}, list_append(p, i) AS p, u AS text FROM (SELECT {keys}, p, unnest(CASE WHEN length(text) > 240 THEN {cut} ELSE [text] END) AS u, generate_subscripts(CASE WHEN length(text) > 240 THEN {cut} ELSE [text] END, 1) AS i FROM ({step})) WHERE u <> ''"
    step = f"SELECT {keys}, list_append(p, i) AS p, substring(text, i * 240 + 1, 240) AS text FROM (SELECT {keys}, p, text, unnest(range(0, (length(text) - 1) // 240 + 1)) AS i FROM ({step}))"
    return f"SELECT {keys}, row_number() OVER (PARTITION BY seg_id ORDER BY p) - 1 AS unit_pos, text FROM ({step})"


def _attach(units: str, keys: str) -> str:
    new = f"(unit_pos = 0 OR length({_strip('text')}) >= 12 OR regexp_matches({_strip('text')}, '[.!?。！？]{_CL}$'))::INT"
    return f"SELECT {keys}, row_number() OVER (PARTITION BY seg_id ORDER BY g) - 1 AS unit_pos, text FROM (SELECT {keys}, g, string_agg(text, '' ORDER BY unit_pos) AS text FROM (SELECT *, sum({new}) OVER (PARTITION BY seg_id ORDER BY unit_pos) AS g FROM ({units})) GROUP BY {keys}, g)"


def _units(source: str, keys: str = "seg_id") -> str:
    return _attach(_long(_sentences(source, keys), keys), keys)


# --- programs ------------------------------------------------------------------
def _runs(spans: str) -> str:
    """Neighbours of one kind joined: gaps and islands."""
    return f"SELECT seg_id, row_number() OVER (PARTITION BY seg_id ORDER BY g) - 1 AS span_index, kind, text FROM (SELECT seg_id, g, any_value(kind) AS kind, string_agg(text, '' ORDER BY span_index) AS text FROM (SELECT *, sum(c) OVER (PARTITION BY seg_id ORDER BY span_index) AS g FROM (SELECT *, (kind IS DISTINCT FROM lag(kind) OVER (PARTITION BY seg_id ORDER BY span_index))::INT AS c FROM ({spans}))) GROUP BY seg_id, g)"


def _absorb(spans: str) -> str:
    flip = f"SELECT seg_id, span_index, CASE WHEN span_index > 0 AND span_index < n - 1 AND length({_strip('text')}) < 48 THEN 'REPLACE' ELSE kind END AS kind, text FROM (SELECT *, count(*) OVER (PARTITION BY seg_id) AS n FROM ({_runs(spans)}))"
    return _runs(flip)


def _program(source: str, least: int, routed: str, hit: str = "FALSE") -> str:
    """Programs of the rows (seg_id, tag, text) of ``source`` where ``routed`` holds, with one unit forced."""
    rows = f"SELECT seg_id, tag, text FROM {source} WHERE {routed}"
    parts = f"{_units(f'(SELECT * FROM ({rows}) WHERE tag NOT IN {_HEADINGS})', 'seg_id, tag')} UNION ALL SELECT seg_id, tag, 0, text FROM ({rows}) WHERE tag IN {_HEADINGS}"
    scored = f"SELECT *, max(score) OVER (PARTITION BY seg_id) AS top FROM (SELECT *, {_dirt('text', 'tag', hit=hit)} AS score FROM ({parts}) u)"
    first = f"SELECT *, row_number() OVER (PARTITION BY seg_id ORDER BY score DESC, unit_pos) AS r FROM ({scored})"
    label = f"SELECT seg_id, unit_pos AS span_index, CASE WHEN score >= {least} OR (top < {least} AND r = 1) THEN 'REPLACE' ELSE 'KEEP' END AS kind, text FROM ({first})"
    joined = f"SELECT *, sum(CASE WHEN kind = 'KEEP' THEN length(text) ELSE 0 END) OVER (PARTITION BY seg_id) * 1.0 / sum(length(text)) OVER (PARTITION BY seg_id) AS keep FROM ({_absorb(label)})"
    whole = f"SELECT seg_id, 0 AS span_index, 'REPLACE' AS kind, string_agg(text, '' ORDER BY span_index) AS text FROM j WHERE keep < 0.22 GROUP BY seg_id"
    return f"WITH j AS MATERIALIZED ({joined}) SELECT seg_id, span_index, kind, text FROM j WHERE keep >= 0.22 UNION ALL {whole}"


_ROUTED = _needs("text", "tag", "polish", 1)
_EDIT = _program("segments", 1, f"text IS NOT NULL AND {_ROUTED}")
_STORED = "SELECT seg_id, span_index, kind, text FROM (SELECT *, row_number() OVER (PARTITION BY seg_id, span_index ORDER BY span_id) AS r FROM spans) WHERE r = 1"


def _clip(t: str, tail: bool) -> str:
    s = _strip(t)
    return f"CASE WHEN length({s}) <= 280 THEN {s} ELSE " + (f"'…' || right({s}, 280)" if tail else f"left({s}, 280) || '…'") + " END"


def _jobs_of(spans: str) -> str:
    near = lambda f, tail: f"CASE WHEN {f}(kind) OVER w = 'KEEP' THEN {_clip(f'{f}(text) OVER w', tail)} ELSE '' END"
    return f"SELECT seg_id, span_index, text, before, after FROM (SELECT seg_id, span_index, kind, text, {near('lag', True)} AS before, {near('lead', False)} AS after FROM ({spans}) WINDOW w AS (PARTITION BY seg_id ORDER BY span_index)) WHERE kind = 'REPLACE'"


# --- packs: a recursion down the ordered items ------------------------------------
def _packs(items: str, budget: int, order: str, alone: str = "") -> str:
    """``items`` (item_id, order..., cost) with pack_no; ``alone`` names a flag that decides instead of the cost."""
    shut = (lambda t: f"{t}{alone}") if alone else (lambda t: f"{t}cost > {budget}")
    return f"""WITH RECURSIVE o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY {order}) AS rn FROM ({items})),
f AS (SELECT item_id, rn, cost, 0 AS pack_no, {shut('')} AS shut, cost AS size FROM o WHERE rn = 1
UNION ALL SELECT o.item_id, o.rn, o.cost, CASE WHEN {shut('o.')} OR f.shut OR f.size + o.cost > {budget} THEN f.pack_no + 1 ELSE f.pack_no END, {shut('o.')},
CASE WHEN {shut('o.')} OR f.shut OR f.size + o.cost > {budget} THEN o.cost ELSE f.size + o.cost END FROM f JOIN o ON o.item_id = f.item_id AND o.rn = f.rn + 1)
SELECT o.*, f.pack_no::BIGINT AS pack_no FROM o JOIN f USING (item_id, rn)"""


def _tokens(t: str) -> str:
    f = _n(t, FOREIGN)
    return f"(CASE WHEN length({t}) = 0 THEN 0 ELSE greatest(1, trunc({f} * 1.08::DOUBLE + (length({t}) - {f}) / 2.6::DOUBLE)::BIGINT + 1) END)"


def _prompt(t: str, b: str, a: str, label: str) -> str:
    ctx = lambda name, x: f"CASE WHEN {_strip(x)} <> '' THEN 'KEEP {name} (do not output):' || chr(10) || {_strip(x)} END"
    return f"concat_ws(chr(10), '[' || {label} || ']', {ctx('before', b)}, 'REPLACE:' || chr(10) || {t}, {ctx('after', a)})"


_T, _B, _A = "coalesce(text, '')", "coalesce(before, '')", "coalesce(after, '')"
_COST = f"length({_T}) + length({_B}) + length({_A}) + 32"
_CHAR_ITEMS = f"SELECT job_id, item_id, seg_index, span_index, {_COST} AS cost, {_T} AS t FROM span_jobs"
_SPAN_ITEMS = f"SELECT item_id, seg_index, span_index, seg_id, {_T} AS t, {_B} AS b, {_A} AS a, {_COST} AS cost FROM (SELECT j.*, s.seg_id, row_number() OVER (PARTITION BY j.item_id, j.seg_index, j.span_index, s.seg_id ORDER BY job_id) AS r FROM span_jobs j JOIN spans s USING (span_id)) WHERE r = 1"
_SPAN_PACKS = _packs(_SPAN_ITEMS, MAX_CHARS, "seg_index, span_index, seg_id")
_LABELLED = f"SELECT *, row_number() OVER (PARTITION BY item_id, pack_no ORDER BY rn) AS k FROM ({_SPAN_PACKS})"
_PACK_ROWS = f"""SELECT item_id, pack_no, coalesce(item_id, '') || ':cd' || pack_no || ':' || arg_min(seg_index, rn) || ':' || arg_min(span_index, rn) || '-' || arg_max(seg_index, rn) || ':' || arg_max(span_index, rn) || ':' || count(*) AS chunk_id,
count(*) AS n_jobs, string_agg({_prompt('t', 'b', 'a', 'k')}, chr(10) || chr(10) ORDER BY rn) AS prompt FROM ({_LABELLED}) GROUP BY item_id, pack_no"""


def _whole(limit: int, source: str = "segments") -> str:
    """(segment's keys, parts): texts over the limit at the separators, each stage folded again up to the limit."""
    parts = "[t]"
    for sign in ("chr(10) || chr(10)", "chr(10)", "'。'", "'！'", "'？'", "'. '", "'! '", "'? '"):
        glued = f"list_transform(string_split(p, {sign}), lambda x, i: [x || CASE WHEN i < len(string_split(p, {sign})) THEN {sign} ELSE '' END])"
        fold = f"list_reduce({glued}, lambda a, x: CASE WHEN a[-1] <> '' AND length(a[-1]) + length(x[1]) > {limit} THEN list_concat(a, x) ELSE list_concat(a[:-2], [a[-1] || x[1]]) END)"
        parts = f"flatten(list_transform({parts}, lambda p: CASE WHEN length(p) > {limit} THEN list_filter({fold}, lambda y: y <> '') ELSE [p] END))"
    cut = f"flatten(list_transform({parts}, lambda p: CASE WHEN length(p) > {limit} THEN list_transform(range(0, (length(p) - 1) // {limit} + 1), lambda k: substring(p, k * {limit} + 1, {limit})) ELSE [p] END))"
    return f"SELECT seg_id, item_id, chapter_ord, seg_index, CASE WHEN length(t) > {limit} THEN list_filter(list_transform({cut}, lambda p: {_strip('p')}), lambda p: p <> '') ELSE [t] END AS parts FROM (SELECT *, coalesce(text, '') AS t FROM {source})"


def _segment_packs(limit: int, budget: int, cost: str, source: str = "segments", order: str = _ORDER) -> str:
    items = f"SELECT seg_id, item_id, chapter_ord, seg_index, alone, piece_no, t, {cost} AS cost FROM (SELECT *, len(parts) > 1 AS alone, unnest(parts) AS t, generate_subscripts(parts, 1) - 1 AS piece_no FROM ({_whole(limit, source)}))"
    return _packs(items, budget, f"{order}, piece_no", "alone")


_BY_CHARS = _segment_packs(MAX_CHARS, MAX_CHARS, "length(t) + 8")
_BY_TOKENS = _segment_packs(6000, 400, f"{_tokens('(chr(91) || 1 || chr(93) || chr(10) || t)')} + 2")


# --- what a rewriter answers --------------------------------------------------------
def _clean(block: str) -> str:
    head = rf"(?i)^(REPLACE|KEEP( before| after)?)[{WS}]*"
    lines = rf"list_filter(list_transform(regexp_split_to_array({block}, '\r\n|[\n\r\x{{b}}\x{{c}}\x{{1c}}-\x{{1e}}\x{{85}}\x{{2028}}\x{{2029}}]'), lambda x: {_strip('x')}), lambda x: NOT regexp_matches(x, '{head}:?$'))"
    text = _strip(f"array_to_string(list_transform({lines}, lambda x: regexp_replace(x, '{head}:[{WS}]*', '')), chr(10))")
    text = _strip(rf"regexp_replace({text}, '(?is)(\ndo not (add|remove|change|repeat)|\(this is the correct format)([^\p{{L}}\p{{N}}_].*)?$', '')")
    labels = _strip(rf"regexp_replace({text}, '[{WS}]*\[\p{{Nd}}+\][{WS}]*', ' ', 'g')")
    return f"regexp_replace({labels}, ' +', ' ', 'g')"


_RAW = f"CASE edit_id % 4 WHEN 0 THEN '**[2]** ' || a || chr(10) || '**[1]**' || chr(10) || b WHEN 1 THEN '<think>no</think>[1] REPLACE:' || chr(10) || b || chr(10) || chr(10) || '[2]' || chr(10) || a WHEN 2 THEN b || chr(10) || chr(10) || a ELSE '[1] ' || b || chr(10) || '[1] again' || chr(10) || '[7] ' || a END"
_QUIET = _strip(rf"regexp_replace(regexp_replace({_RAW}, '(?is)<think(ing)?>.*?</think(ing)?>', '', 'g'), '(?m)^```[^\n]*$\n?', '', 'g')")
_AFTER_LABEL = rf"regexp_replace(part, '(?s)^.*?\[\p{{Nd}}+\][{WS}]*', '')"
# Every label on a new line begins a part, unless it follows a label at once; of a part counts what follows its first label.
_PARSED = rf"""WITH q AS (SELECT edit_id, regexp_replace({_QUIET}, '\*+\[(\p{{Nd}}+)\]\*+', '[\1]', 'g') AS t FROM (SELECT edit_id, coalesce(before, '') AS b, coalesce(after, '') AS a FROM edits)),
p AS (SELECT edit_id, unnest(x) AS part, generate_subscripts(x, 1) AS i FROM (SELECT edit_id, string_split(regexp_replace(regexp_replace(t, '(\[\p{{Nd}}+\])[{WS}]*\n[{WS}]*(\[\p{{Nd}}+\])', '\1 \2', 'g'), '(\n[{WS}]*\[\p{{Nd}}+\])', chr(57344) || '\1', 'g'), chr(57344)) AS x FROM q)),
n AS (SELECT edit_id, i, TRY_CAST(regexp_extract(part, '\[(\p{{Nd}}+)\]', 1) AS INT) AS n, {_clean(_AFTER_LABEL)} AS body FROM p WHERE regexp_matches(part, '\[\p{{Nd}}+\]')),
f AS (SELECT edit_id, count(DISTINCT n) AS d, arg_min(body, i) FILTER (n = 1) AS one, arg_min(body, i) FILTER (n = 2) AS two FROM n WHERE body <> '' AND n BETWEEN 1 AND 2 GROUP BY edit_id),
l AS (SELECT edit_id, list_filter(list_transform(regexp_split_to_array(t, '\n[{WS}]*\n'), lambda z: {_clean('z')}), lambda z: z <> '') AS parts FROM q)
SELECT edit_id, md5(CASE WHEN coalesce(d, 0) = 2 THEN one || '|' || two WHEN coalesce(d, 0) = 0 AND len(parts) = 2 THEN parts[1] || '|' || parts[2] END) AS digest FROM l LEFT JOIN f USING (edit_id)"""


# --- the gate ---------------------------------------------------------------------
_S = "coalesce(before, '')"
_O = _strip("coalesce(after, '')")
_LEAK = r"\[(\p{Nd}+|n)\]|KEEP (before|after)|(^|\n)[" + WS + r"]*REPLACE[" + WS + r"]*:|" + "|".join(_edge(x) for x in ("do not (add|remove|change|repeat|invent)", "this is the correct format", "only the replace text")) + r"|(^|[^\p{L}\p{N}_])keep the same \[n\]"


def _count(t: str) -> str:
    cut = f"string_split(regexp_replace({_strip(t)}, '([.!?])[\"''”’)]*[{WS}]+', '\\1' || chr(57344), 'g'), chr(57344))"
    return f"CASE WHEN {_strip(t)} = '' THEN 0 ELSE greatest(1, len(list_filter({cut}, lambda p: {_strip('p')} <> ''))) END"


def _times(t: str, sign: str) -> str:
    return f"(length({t}) - length(replace({t}, '{sign}', '')))"


def _takes(parts: str, head: str) -> str:
    return f"(SELECT len(l) >= 2 AND length({head.format('l[1]')}) >= 20 AND len(list_filter(l[2:], lambda p: starts_with(p, left(l[1], 24)))) > 0 FROM (SELECT list_filter(list_transform({parts}, lambda p: {_strip('p')}), lambda p: p <> '') AS l))"


def _words(t: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all({t}, '[A-Za-z]+(?:''[A-Za-z]+)?|[\\x{{3400}}-\\x{{9fff}}]'), lambda w: lower(w)), lambda w: length(w) > 1 AND w NOT IN {_in(STOPWORDS)})"


def _bare(t: str) -> str:
    return rf"regexp_replace({t}, '''s([^\p{{L}}\p{{N}}_]|$)', '\1', 'g')"


_NAMES = rf"regexp_extract_all(b, '(?:^|[^\p{{L}}\p{{N}}_])([A-Z][a-z]+(?:[{WS}]+[A-Z][a-z]+)+)(?:[^\p{{L}}\p{{N}}_]|$)', 1)"
def _gate(keys: str, pairs: str) -> str:
    """(keys, reason) of ``pairs`` (keys, s, o): a source and a stripped rewrite."""
    return f"""SELECT {keys}, CASE
WHEN o = '' OR length(o) * 1.0 / greatest(length(s), 1) NOT BETWEEN 0.45 AND 2.2 THEN 'length'
WHEN regexp_matches(o, {_q(_LEAK)}, 'i') THEN 'leak'
WHEN {_squeeze('s')} <> '' AND contains({_squeeze('o')}, {_squeeze('s')}) AND length({_squeeze('o')}) >= length({_squeeze('s')}) + 24 THEN 'echo'
WHEN {_count('o')} > {_count('s')} + 1 THEN 'sentences'
WHEN {_times('o', '"')} % 2 = 1 OR {_times('o', '“')} <> {_times('o', '”')} OR regexp_matches(o, '[,:;]$') OR lower(regexp_extract(o, '[A-Za-z'']+$')) IN {_in([*STOPWORDS, *DANGLING])}
 OR (right(regexp_replace(s, '[{WS}]+$', ''), 1) IN ('', '.', '!', '?', '。', '"', '”', '’') AND regexp_matches(o, '[A-Za-z\\x{{3400}}-\\x{{9fff}}]$')) THEN 'truncated'
WHEN {_takes(f"regexp_split_to_array(o, '[{WS}]*\\[\\p{{Nd}}+\\][{WS}]*|\\n\\n+')", 'left({0}, 48)')}
 OR {_takes(f"string_split(regexp_replace(o, '([.!?])[{WS}]+', '\\1' || chr(57344), 'g'), chr(57344))", '{0}')} THEN 'duplicate'
WHEN len(list_filter({_NAMES}, lambda n: NOT contains(lower(h), lower(n)))) > 0
 OR len(list_filter(regexp_extract_all(s, '[“”"''「」『』]([\\x{{3400}}-\\x{{9fff}}]+)[“”"''「」『』]', 1), lambda n: NOT contains(o, n))) > 0 THEN 'anchors'
WHEN len(sw) >= 4 AND len(list_filter(sw, lambda a: len(list_filter(ow, lambda b: a = b OR (length(a) >= 4 AND length(b) >= 4 AND (starts_with(a, b) OR starts_with(b, a))))) > 0)) * 1.0 / len(sw) < 0.35 THEN 'overlap'
ELSE 'accepted' END AS reason
FROM (SELECT *, {_bare('s')} AS b, {_bare('o')} AS h, {_words('s')} AS sw, {_words('o')} AS ow FROM ({pairs}))"""


_GATE = _gate("edit_id", f"SELECT edit_id, {_S} AS s, {_O} AS o FROM edits")


def _paragraph(high: float) -> str:
    return f"(regexp_matches({_A}, '[^{WS}]') AND length({_A}) * 1.0 / greatest(length({_S}), 1) BETWEEN 0.35 AND {high})"


def _plain(t: str) -> str:
    for old, new in PLAIN:
        t = f"replace({t}, {_q(old)}, {_q(new)})"
    return t


# --- rewriting by rule ----------------------------------------------------------------
def _trimmed(o: str, t: str, b: str, a: str) -> str:
    hd, tl = _strip(f"regexp_replace({_strip(b)}, '^…+', '')"), _strip(f"regexp_replace({_strip(a)}, '…+$', '')")
    x = f"CASE WHEN {hd} <> '' AND starts_with({_strip(o)}, {hd}) THEN regexp_replace(substring({_strip(o)}, length({hd}) + 1), '^[{WS}]+', '') ELSE {_strip(o)} END"
    y = f"CASE WHEN {tl} <> '' AND ends_with({x}, {tl}) THEN regexp_replace(left({x}, length({x}) - length({tl})), '[{WS}]+$', '') ELSE {x} END"
    return f"CASE WHEN {_strip(t)} <> '' AND contains({y}, {_strip(t)}) AND length({y}) > length({t}) * 2.4 THEN {t} WHEN {y} <> '' THEN {y} ELSE {_strip(o)} END"


def _finals(jobs: str, keys: str) -> str:
    """(keys, s, o, reason) of ``jobs`` (keys, t, b, a): every job by itself."""
    said = f"SELECT {keys}, t, b, a, {_clean(_plain('t'))} AS x FROM ({jobs})"
    return _gate(f"{keys}, s, o", f"SELECT {keys}, t AS s, {_trimmed('x', 't', 'b', 'a')} AS o FROM ({said})")


# A job that fails where another of its pack passes keeps the gate's reason; elsewhere it is halved down and exhausted.
_RETRIED = f"SELECT seg_id, span_index, CASE WHEN reason = 'accepted' THEN o ELSE s END AS final, reason = 'accepted' AS accepted, CASE WHEN reason = 'accepted' THEN NULL WHEN any_ THEN reason ELSE 'exhausted' END AS reason FROM (SELECT *, bool_or(reason = 'accepted') OVER (PARTITION BY item_id, pack_no) AS any_ FROM ({_finals(f'SELECT item_id, pack_no, seg_id, span_index, t, b, a FROM ({_SPAN_PACKS})', 'item_id, pack_no, seg_id, span_index')}))"
_POLISHED = f"""WITH e AS MATERIALIZED ({_EDIT}), r AS ({_finals(f'SELECT seg_id, span_index, text AS t, before AS b, after AS a FROM ({_jobs_of("SELECT * FROM e")})', 'seg_id, span_index')})
SELECT seg_id, string_agg(CASE WHEN reason = 'accepted' THEN o ELSE text END, '' ORDER BY span_index) AS new_text FROM e LEFT JOIN r USING (seg_id, span_index) GROUP BY seg_id"""

# --- glossary -----------------------------------------------------------------------
_OVERLAY = ", ".join(f"({1000 + i}, {_q(a)}, {_q(b)})" for i, (a, b) in enumerate(OVERLAY))
_TERMS = f"(SELECT book_id, ord::BIGINT AS ord, source, target, kind, notes FROM glossary UNION ALL SELECT book_id, v.ord, v.source, v.target, 'overlay', NULL FROM books, (VALUES {_OVERLAY}) v(ord, source, target))"
_BOTH = f"(SELECT *, (kind <> 'person')::INT AS g FROM {_TERMS} WHERE source IS NOT NULL AND kind IS NOT NULL)"


def _merged(overwrite: bool) -> str:
    target = "arg_max(target, (g, ord))" if overwrite else "arg_min(target, (g, ord))"
    one = (lambda c: f"coalesce(arg_max({c}, (g, ord)) FILTER (coalesce({c}, '') <> ''), first({c} ORDER BY g, ord))") if overwrite else (lambda c: f"first({c} ORDER BY g, ord)")
    target = target.replace("arg_max(target, (g, ord))", "first(target ORDER BY g DESC, ord DESC)").replace("arg_min(target, (g, ord))", "first(target ORDER BY g, ord)")
    return f"SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY p) AS ord, source, target, kind, notes FROM (SELECT book_id, lower(source) AS k, min((g, ord)) AS p, first(source ORDER BY g, ord) AS source, {target} AS target, {one('kind')} AS kind, {one('notes')} AS notes FROM {_BOTH} GROUP BY book_id, lower(source))"


_RELEVANT = f"SELECT * FROM (SELECT s.seg_id, t.ord, t.source, t.target, row_number() OVER (PARTITION BY s.seg_id ORDER BY length(t.source) DESC, t.ord) AS rank FROM segments s JOIN {_TERMS} t ON s.book_id = t.book_id AND length(t.source) > 0 AND contains(lower(s.text), lower(t.source))) WHERE rank <= 80"

_BLOCK = f"SELECT book_id, string_agg(l, chr(10) ORDER BY r) AS block FROM (SELECT book_id, '- ' || source || ' → ' || target || CASE WHEN coalesce(notes, '') <> '' THEN ' (' || notes || ')' ELSE '' END AS l, row_number() OVER (PARTITION BY book_id ORDER BY length(source) DESC, k, ord) AS r FROM (SELECT book_id, lower(source) AS k, target, min(ord) AS ord, first(source ORDER BY ord) AS source, first(notes ORDER BY ord) AS notes FROM {_TERMS} WHERE length(source) > 0 AND length(target) > 0 AND source <> target GROUP BY book_id, lower(source), target)) WHERE r <= 80 GROUP BY book_id"
_WANTED = f"EXISTS (SELECT 1 FROM {_TERMS} t JOIN segments z USING (book_id) WHERE z.seg_id = u.seg_id AND length(t.source) > 0 AND t.source <> t.target AND contains(lower(u.text), lower(t.source)))"
_IN_WORD = lambda at: f"regexp_matches(substr(text, {at}, 1), '[\\p{{L}}\\p{{N}}_]')"
_EDGE_AT = lambda at: f"(({at} > 1 AND {_IN_WORD(f'{at} - 1')}) <> {_IN_WORD(at)})"
# Every place of every term, the best at each place, then from one to the next that does not overlap it.
_PUT = f"""WITH RECURSIVE t AS (SELECT book_id, ord, source, target, lower(source) AS low, regexp_matches(source, '[{FOREIGN}]') AS free FROM {_TERMS} WHERE length(source) > 0 AND length(target) > 0 AND source <> target),
p AS (SELECT seg_id, text, lower(text) AS l, t.*, unnest(range(1, length(text) - length(low) + 2)) AS pos FROM segments JOIN t USING (book_id) WHERE contains(lower(text), low)),
q AS (SELECT seg_id, pos, length(low) AS n, ord, source, target, substr(text, pos, length(low)) AS f FROM p WHERE substr(l, pos, length(low)) = low AND (free OR ({_EDGE_AT('pos')} AND {_EDGE_AT('pos + length(low)')}))),
b AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY seg_id, pos ORDER BY n DESC, (source = f OR lower(source) = f) DESC, ord) AS r FROM q) WHERE r = 1),
x AS MATERIALIZED (SELECT a.seg_id, a.pos, min(c.pos) AS nx FROM b a LEFT JOIN b c ON a.seg_id = c.seg_id AND c.pos >= a.pos + a.n GROUP BY 1, 2),
chain AS (SELECT seg_id, min(pos) AS pos FROM b GROUP BY seg_id UNION ALL SELECT chain.seg_id, x.nx FROM chain JOIN x USING (seg_id, pos) WHERE x.nx IS NOT NULL),
done AS (SELECT b.* FROM chain JOIN b USING (seg_id, pos))"""
_PUT_TEXT = "SELECT seg_id, string_agg(substr(text, pe, pos - pe) || target, '' ORDER BY pos) || substr(any_value(text), max(pos + n)) AS new, count(*) AS k FROM (SELECT done.*, text, coalesce(lag(pos + n) OVER (PARTITION BY seg_id ORDER BY pos), 1) AS pe FROM done JOIN segments USING (seg_id)) GROUP BY seg_id"

# --- samples, formats and the rest ------------------------------------------------------
_PARTS = f"SELECT book_id, {_strip('text')} AS part, row_number() OVER (PARTITION BY book_id ORDER BY {_ORDER}) AS n FROM segments WHERE text IS NOT NULL AND {_strip('text')} <> ''"


def _sample(limit: int) -> str:
    return f"SELECT book_id, string_agg(part, chr(10) ORDER BY n) AS text FROM (SELECT *, sum(length(part)) OVER (PARTITION BY book_id ORDER BY n) - length(part) AS b FROM ({_PARTS})) WHERE b < {limit} GROUP BY book_id"


_SCRIPT = f"[{', '.join(_n('text', RANGES[s]) for s, _ in SOURCE_LANGUAGE)}]"
_FMT = "CASE " + " ".join(f"WHEN f = '{a}' THEN '{b}'" for a, b in {**{f: f for f in FORMATS}, **ALIASES}.items()) + " END"
_EXT = "CASE fmt " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in SUFFIX.items()) + " END"
_TXT = f"regexp_replace(regexp_replace(text, '^\\x{{FEFF}}', ''), '\\r\\n?', chr(10), 'g')"
_MODEL_SIZE = r"CASE WHEN regexp_extract(lower(model), '(\d+(?:\.\d+)?)\s*b(?:[^\p{L}\p{N}_]|$)', 1) <> '' THEN regexp_extract(lower(model), '(\d+(?:\.\d+)?)\s*b(?:[^\p{L}\p{N}_]|$)', 1)::DOUBLE WHEN regexp_matches(lower(model), 'e4b|e2b') THEN 4.0::DOUBLE WHEN contains(lower(model), 'e1b') THEN 1.0::DOUBLE END"
_REASONS = "regexp_matches(lower(model), 'deepseek-r1|qwq|thinking|:r1|reasoner')"
_CHAPTERS = "(SELECT book_id AS doc_id, regexp_replace(href, '#.*$', '') AS file_name FROM chapters)"


def _tier(k: int) -> str:
    v = [repr(t[k]) if k != 5 else _q(t[k]) for t in TIERS]
    return "CASE " + " ".join(f"WHEN u >= {t[0]} THEN {x}" for t, x in zip(TIERS, v)) + " END"


# Lines, what each is, where a block begins, then chapters at the top headings.
_MD = f"""WITH l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '^\\x{{FEFF}}', ''), '\\r\\n|[\\n\\r\\x{{b}}\\x{{c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'), chr(10)) AS a FROM documents WHERE text <> '')),
k AS (SELECT *, starts_with(line, '```') AS fence, sum(starts_with(line, '```')::INT) OVER (PARTITION BY doc_id ORDER BY i) AS f FROM l),
t AS (SELECT *, CASE WHEN fence AND f % 2 = 1 THEN 'pre' WHEN fence THEN 'end' WHEN f % 2 = 1 THEN 'code' WHEN regexp_matches(line, '^#{{1,6}}[{WS}]') THEN 'h' WHEN regexp_matches({_strip('line')}, '^([-*+]|\\p{{Nd}}+\\.)[{WS}]') THEN 'li' WHEN {_strip('line')} = '' THEN '' ELSE 'p' END AS kind FROM k),
s AS (SELECT *, sum(start) OVER (PARTITION BY doc_id ORDER BY i) AS bl FROM (SELECT *, (kind IN ('h', 'li', 'pre') OR (kind = 'p' AND lag(kind) OVER (PARTITION BY doc_id ORDER BY i) IS DISTINCT FROM 'p'))::INT AS start FROM t)),
g AS (SELECT doc_id, bl, arg_min(kind, i) AS kind, arg_min(line, i) AS head, string_agg(line, chr(10) ORDER BY i) FILTER (kind = 'code') AS code, string_agg({_strip('line')}, ' ' ORDER BY i) AS para FROM s WHERE bl > 0 AND kind NOT IN ('', 'end') GROUP BY doc_id, bl),
c AS (SELECT doc_id, bl, CASE WHEN kind = 'h' THEN 'h' || length(regexp_extract(head, '^#+')) ELSE kind END AS tag, CASE kind WHEN 'h' THEN {_strip("regexp_replace(head, '^#+', '')")} WHEN 'li' THEN regexp_replace({_strip('head')}, '^([-*+]|\\p{{Nd}}+\\.)[{WS}]+', '') WHEN 'pre' THEN coalesce(code, '') ELSE para END AS text FROM g),
h AS (SELECT *, sum((tag = 'h1' AND bl > 1)::INT) OVER (PARTITION BY doc_id ORDER BY bl) AS chapter FROM c),
n AS (SELECT doc_id, 'md' || chapter AS item_id, first_value(CASE WHEN tag = 'h1' THEN text ELSE 'doc' || doc_id END) OVER w AS title, row_number() OVER w - 1 AS seg_index, tag, text FROM h WINDOW w AS (PARTITION BY doc_id, chapter ORDER BY bl))
SELECT * FROM n WHERE regexp_matches(text, '[^{WS}]')"""
_WRITTEN = f"SELECT item_id, chapter_ord, seg_index * 10000000::BIGINT + seg_id AS o, tag, text, regexp_replace(text, '[{WS}]+$', '') AS r, lead(chapter_ord) OVER (PARTITION BY item_id ORDER BY chapter_ord, seg_index * 10000000::BIGINT + seg_id) AS following FROM segments WHERE text IS NOT NULL AND {_strip('text')} <> ''"
_GAP = "CASE WHEN tag = 'li' AND coalesce(following, chapter_ord) = chapter_ord THEN chr(10) ELSE chr(10) || chr(10) END"
_MD_BLOCK = f"CASE WHEN tag = 'pre' THEN '```' || chr(10) || r || chr(10) || '```' WHEN regexp_matches(tag, '^h[1-6]$') THEN repeat('#', substring(tag, 2, 1)::INT) || ' ' || r WHEN tag = 'li' THEN '- ' || r ELSE r END"
_HTML_TAG = "CASE WHEN tag IN ('p', 'h1', 'h2', 'h3', 'h4', 'h5', 'h6', 'li', 'blockquote', 'pre') THEN tag ELSE 'p' END"
_HTML_LINE = f"'<' || {_HTML_TAG} || '>' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br/>') || '</' || {_HTML_TAG} || '>'"
_RECORD = "CASE WHEN tag IS NULL THEN to_json({'chapter': item_id, 'text': text}) ELSE to_json({'chapter': item_id, 'tag': tag, 'text': text}) END"


def _digest_of(content: str) -> str:
    return f"SELECT item_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT item_id, {content} AS c FROM ({_WRITTEN}) GROUP BY item_id)"


_FENCE = "repeat('`', greatest(3, coalesce(list_max(list_transform(regexp_extract_all(concat_ws(chr(10) || chr(10), before, after), '`+'), lambda x: length(x))), 0) + 1)::INT)"

# A line begins a paragraph where the line before ends in a final mark.
_UNBROKEN = _strip(r"regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '([\p{L}\p{N}_])-\n([\p{L}\p{N}_])', '\1\2', 'g')")
_PAGES = rf"""WITH c AS (SELECT doc_id, unnest(x) AS chunk, generate_subscripts(x, 1) AS k FROM (SELECT doc_id, regexp_split_to_array({_UNBROKEN}, '\n[{WS}]*\n') AS x FROM documents WHERE text IS NOT NULL)),
l AS (SELECT doc_id, k, unnest(y) AS line, generate_subscripts(y, 1) AS i FROM (SELECT doc_id, k, list_filter(list_transform(string_split(chunk, chr(10)), lambda x: {_strip('x')}), lambda x: x <> '') AS y FROM c)),
g AS (SELECT *, sum(s) OVER (PARTITION BY doc_id, k ORDER BY i) AS g FROM (SELECT *, coalesce(regexp_matches(lag(line) OVER (PARTITION BY doc_id, k ORDER BY i), '[.!?。！？:;"”’]$'), FALSE)::INT AS s FROM l))
SELECT doc_id, 'page1' AS item_id, row_number() OVER (PARTITION BY doc_id ORDER BY k, g) - 1 AS seg_index, text FROM (SELECT doc_id, k, g, string_agg(line, ' ' ORDER BY i) AS text FROM g GROUP BY doc_id, k, g)"""

_SPANS_BUDGET = lambda est: f"greatest(k * 48, least({est}, {min(max(128, NUM_CTX // 2), 2048)}))::BIGINT"
_PASSAGE_BUDGET = lambda est: f"greatest(96, least({est}, {min(max(128, NUM_CTX // 2), 3072)}))::BIGINT"

SQL: dict[str, str] = {
    "script_ratio": f"SELECT seg_id, {', '.join(f'coalesce({_n('text', v)}, 0) AS n_{k}' for k, v in RANGES.items())}, round({_share(_n('text', RANGES['han']), _n('text', RANGES['latin']))}, 6) AS han_share, round({_foreign('text')}, 6) AS foreign_share FROM segments",
    "sample_text": f"SELECT book_id, length(text) AS n_chars, md5(text) AS digest FROM ({_sample(2000)})",
    "detect_mode": f"SELECT book_id, CASE WHEN {_foreign('text')} >= 0.28 THEN 'translate' ELSE 'polish' END AS mode, CASE WHEN list_max(c) > 0 THEN {[n for _, n in SOURCE_LANGUAGE]}[list_position(c, list_max(c))] ELSE 'zho_Hans' END AS src_lang FROM (SELECT *, {_SCRIPT} AS c FROM ({_sample(8000)}))",
    "stride_excerpts": f"SELECT book_id, length(x) AS n_chars, md5(x) AS digest FROM (SELECT book_id, CASE WHEN any_value(n) <= 10 THEN left(string_agg(t, chr(10) || chr(10) ORDER BY i), 7000) ELSE string_agg(left(t, 700), chr(10) || chr(10) ORDER BY i) FILTER (i % step = 0 AND i // step < 10) END AS x FROM (SELECT *, greatest(n // 10, 1) AS step FROM (SELECT book_id, coalesce(text, '') AS t, row_number() OVER (PARTITION BY book_id ORDER BY {_ORDER}) - 1 AS i, count(*) OVER (PARTITION BY book_id) AS n FROM segments)) GROUP BY book_id)",
    "boilerplate_filter": f"SELECT seg_id, tag FROM segments WHERE {_boiler('text')}",
    "mtl_score": f"SELECT seg_id, CASE WHEN text IS NOT NULL THEN {_dirt('text', 'tag')} ELSE 0 END::BIGINT AS polish, CASE WHEN text IS NOT NULL THEN {_dirt('text', 'tag', 'translate')} ELSE 0 END::BIGINT AS translate FROM segments",
    "route_segments": "SELECT seg_id, " + ", ".join(f"text IS NOT NULL AND {_needs('text', 'tag', m, k)} AS {n}" for n, m, k in (("auto", "polish", 1), ("aggressive", "polish", 2), ("off_", "polish", 0), ("translate", "translate", 1))) + " FROM segments",
    "wants_polish": f"SELECT seg_id FROM segments WHERE NOT {_boiler('text')} AND {_dirt('text', _q('p'))} >= 1 AND NOT (length({_strip('text')}) < 80 AND NOT regexp_matches({_strip('text')}, '[{WS}]'))",
    "sentence_units": _sentences("segments", "seg_id"),
    "long_unit_split": _long(_sentences("segments", "seg_id"), "seg_id"),
    "attach_short": _units("segments"),
    "coalesce_runs": _runs(_STORED),
    "absorb_bridges": _absorb(_STORED),
    "edit_programs": _EDIT,
    "force_dirty_argmax": _program("(SELECT seg_id, 'p' AS tag, text FROM segments)", 2, f"text IS NOT NULL AND NOT {_boiler('text')}"),
    "keep_ratio_rollup": f"SELECT book_id, sum(CASE WHEN kind = 'KEEP' THEN length(p.text) ELSE 0 END)::BIGINT AS keep_chars, sum(CASE WHEN kind = 'REPLACE' THEN length(p.text) ELSE 0 END)::BIGINT AS replace_chars, count(*) FILTER (kind = 'REPLACE') AS n_jobs, round(sum(CASE WHEN kind = 'KEEP' THEN length(p.text) ELSE 0 END) * 1.0::DOUBLE / sum(length(p.text)), 6) AS keep_ratio FROM ({_EDIT}) p JOIN segments s USING (seg_id) GROUP BY book_id",
    "span_jobs_context": _jobs_of(_STORED),
    "token_estimate": f"SELECT job_id, {_tokens('text')} AS tokens FROM span_jobs",
    "pack_chars": f"SELECT job_id, item_id, pack_no FROM ({_packs(_CHAR_ITEMS, MAX_CHARS, _JOBS)})",
    "pack_tokens": f"SELECT job_id, item_id, pack_no FROM ({_packs(f'SELECT job_id, item_id, seg_index, span_index, {_tokens('x')} + 2 AS cost FROM (SELECT *, {_prompt(_T, _B, _A, '1')} AS x FROM span_jobs)', 260, _JOBS)})",
    "max_tokens": f"""SELECT item_id, pack_no, {_SPANS_BUDGET('trunc(chars * 0.85::DOUBLE) + 32 * k')} AS span_chars, {_SPANS_BUDGET('trunc(tokens * 1.35::DOUBLE) + 24 * k')} AS span_tokens, {_PASSAGE_BUDGET('trunc(chars * 0.55::DOUBLE) + 80')} AS polish_chars, {_PASSAGE_BUDGET('trunc(chars * 1.1::DOUBLE) + 80')} AS translate_chars, {_PASSAGE_BUDGET('trunc(tokens * 1.2::DOUBLE) + 24')} AS translate_tokens
FROM (SELECT item_id, pack_no, count(*) AS k, sum(length(t)) AS chars, sum({_tokens('t')}) AS tokens FROM ({_packs(_CHAR_ITEMS, MAX_CHARS, _JOBS)}) GROUP BY item_id, pack_no)""",
    "chunk_ids": f"SELECT item_id, pack_no, chunk_id, n_jobs FROM ({_PACK_ROWS})",
    "span_prompts": f"SELECT chunk_id, length(prompt) AS n_chars, md5(prompt) AS digest FROM ({_PACK_ROWS})",
    "trim_echo": f"""SELECT job_id, CASE WHEN {_strip('t')} <> '' AND contains(y, {_strip('t')}) AND length(y) > length(t) * 2.4 THEN t WHEN y <> '' THEN y ELSE {_strip('o')} END AS trimmed FROM (SELECT *, CASE WHEN tl <> '' AND ends_with(x, tl) THEN regexp_replace(left(x, length(x) - length(tl)), '[{WS}]+$', '') ELSE x END AS y FROM (SELECT *, CASE WHEN hd <> '' AND starts_with({_strip('o')}, hd) THEN regexp_replace(substring({_strip('o')}, length(hd) + 1), '^[{WS}]+', '') ELSE {_strip('o')} END AS x FROM (SELECT job_id, {_T} AS t,
CASE job_id % 3 WHEN 0 THEN {_B} || ' ' || {_T} || ' ' || {_A} WHEN 1 THEN {_B} || ' ' || {_T} ELSE {_T} || ' ' || {_A} END AS o, {_strip(f"regexp_replace({_strip(_B)}, '^…+', '')")} AS hd, {_strip(f"regexp_replace({_strip(_A)}, '…+$', '')")} AS tl FROM span_jobs)))""",
    "gate_reasons": _GATE,
    "paragraph_gate": f"SELECT edit_id, {_paragraph(2.6)} AS polish, {_paragraph(4.5)} AS translate FROM edits",
    "stitch": f"SELECT seg_id, string_agg(CASE WHEN kind = 'KEEP' THEN text ELSE {_strip(_plain('text'))} END, '' ORDER BY span_index) AS new_text FROM ({_STORED}) GROUP BY seg_id",
    "edits_log": f"SELECT edit_id, chapter_id, kind FROM edits WHERE {_squeeze(_S)} <> {_squeeze(_A)}",
    "change_summary": f"SELECT book_id, count(*) AS sent, count(*) FILTER ({_squeeze(_S)} = {_squeeze(_A)}) AS unchanged, count(*) FILTER ({_squeeze(_S)} <> {_squeeze(_A)}) AS edits, count(DISTINCT chapter_id) FILTER ({_squeeze(_S)} <> {_squeeze(_A)}) AS chapters_edited FROM edits GROUP BY book_id",
    "sorted_edits": r"SELECT edit_id, book_id, n AS href_no, row_number() OVER (PARTITION BY book_id ORDER BY n, href COLLATE C, para, kind, edit_id) AS rank FROM (SELECT *, coalesce(list_last(regexp_extract_all(href, '\d+'))::BIGINT, 0) AS n FROM edits)".replace(" COLLATE C", ""),
    "glossary_merge": _merged(False),
    "glossary_overwrite": _merged(True),
    "glossary_relevant_topk": _RELEVANT,
    "glossary_unapplied": f"SELECT seg_id, count(*) AS n FROM ({_RELEVANT}) WHERE source <> target GROUP BY seg_id",
    "glossary_prompt": _BLOCK,
    "glossary_routing": f"SELECT seg_id, CASE WHEN text IS NOT NULL THEN {_dirt('text', 'tag', hit=_WANTED)} ELSE 0 END::BIGINT AS score, text IS NOT NULL AND coalesce(tag NOT IN ('pre','code','samp'), TRUE) AND NOT {_boiler('text')} AND {_dirt('text', 'tag', hit=_WANTED)} >= 2 AS sent FROM segments u",
    "glossary_programs": _program("segments u", 1, f"text IS NOT NULL AND coalesce(tag NOT IN ('pre','code','samp'), TRUE) AND NOT {_boiler('text')} AND {_dirt('text', 'tag', hit=_WANTED)} >= 1", _WANTED),
    "glossary_system": "SELECT book_id, 'You correct English that a machine translated. Rewrite the REPLACE parts only; names, meaning and tone stay. Answer with the numbered blocks and no other words.' || chr(10) || chr(10) || 'Style notes:' || chr(10) || 'Stay within the vocabulary and register of the text.' || chr(10) || chr(10) || block AS system FROM (" + _BLOCK + ")",
    "glossary_apply": f"{_PUT} SELECT seg_id, md5(coalesce(new, text)) AS digest, coalesce(k, 0) AS n_hits FROM segments LEFT JOIN ({_PUT_TEXT}) USING (seg_id)",
    "glossary_hits": f"{_PUT} SELECT source || ' → ' || target AS term, count(*) AS n FROM done GROUP BY 1",
    "glossary_json": f"SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY ord) - 1 AS place, source, target, kind, nullif(notes, '') AS notes FROM {_TERMS} WHERE coalesce(source, '') <> '' AND coalesce(target, '') <> ''",
    "checkpoint_pending": "SELECT DISTINCT item_id AS chunk_id FROM span_jobs WHERE item_id IS NOT NULL AND item_id NOT IN (SELECT item_id FROM chapters WHERE chapter_ord % 2 = 0)",
    "file_fingerprint": "SELECT book_id, left(sha256(path || ':' || length(path) || ':' || epoch(added_at)::BIGINT), 16) AS fingerprint FROM books",
    "format_names": rf"SELECT book_id, fmt, regexp_replace(list_last(string_split(path, '/')), '\.[^.]*$', '') AS stem, regexp_replace(path, '\.[^./]*$', '') || CASE WHEN work_mode = 'translate' THEN '.en' ELSE '.polished' END || {_EXT} AS output FROM (SELECT *, {_FMT} AS fmt FROM (SELECT * EXCLUDE (fmt), regexp_replace(lower(trim(fmt)), '^\.', '') AS f FROM books))",
    "selectable_chapters": "SELECT book_id, item_id, n FROM (SELECT book_id, item_id, row_number() OVER (PARTITION BY book_id ORDER BY chapter_ord) AS n FROM chapters WHERE NOT is_skipped AND item_id IN (SELECT item_id FROM segments)) WHERE n BETWEEN 2 AND 4",
    "zip_member_match": f"""WITH w AS (SELECT DISTINCT * FROM {_CHAPTERS}), m AS (SELECT DISTINCT doc_id, unnest(['OEBPS/' || file_name, regexp_replace('OEBPS/' || file_name, '^OEBPS/text/', 'OEBPS/old/')]) AS member FROM {_CHAPTERS})
SELECT doc_id, file_name, CASE WHEN e > 0 THEN file_name WHEN n2 = 1 THEN s WHEN n3 = 1 THEN b END AS member FROM (SELECT w.doc_id, w.file_name, count(*) FILTER (member = file_name) AS e, count(*) FILTER (ends_with(member, '/' || file_name)) AS n2, min(member) FILTER (ends_with(member, '/' || file_name)) AS s, count(member) FILTER (list_last(string_split(member, '/')) = list_last(string_split(file_name, '/'))) AS n3, min(member) FILTER (list_last(string_split(member, '/')) = list_last(string_split(file_name, '/'))) AS b FROM w LEFT JOIN m ON w.doc_id = m.doc_id GROUP BY w.doc_id, w.file_name)""",
    "model_pick": f"SELECT k, model FROM (SELECT k, model, row_number() OVER (PARTITION BY k ORDER BY c, CASE WHEN c = 0 THEN -s END, CASE WHEN c = 0 THEN model END DESC, ord) AS r FROM (SELECT *, CASE WHEN {_REASONS} THEN 2 WHEN s <= 14.2 THEN 0 ELSE 1 END AS c FROM (SELECT *, {_MODEL_SIZE} AS s FROM (VALUES {', '.join(f'({_q(k)}, {i}, {_q(m)})' for i, (k, m) in enumerate(MODELS))}) v(k, ord, model)))) WHERE r = 1",
    "device_tier": f"""SELECT vram_mb, backend, model, cap, CASE WHEN cap >= 12 THEN 14 WHEN cap >= 7 THEN 7 ELSE 3 END AS weights_b, CASE WHEN big THEN least(ctx, 2048) WHEN snug THEN least(ctx, 4096) ELSE ctx END AS num_ctx, CASE WHEN big THEN least(chars, 900) WHEN snug THEN least(chars, 1800) ELSE chars END AS max_chars,
CASE WHEN {_REASONS} OR s IS NULL OR big OR snug THEN 1 WHEN s <= 8 AND gpu AND vram_mb >= 10500 THEN greatest(w, 2) ELSE w END AS workers, CASE WHEN coalesce(big, FALSE) OR {_REASONS} THEN 'aggressive' ELSE sk END AS skip_mode
FROM (SELECT *, s > cap + 0.1 AS big, s >= 12 AND gpu AND vram_mb < 16000 AS snug FROM (SELECT *, ({_tier(1)})::DOUBLE AS cap, {_tier(2)} AS ctx, {_tier(3)} AS chars, {_tier(4)} AS w, {_tier(5)} AS sk, backend IN ('cuda', 'vulkan') AS gpu, {_MODEL_SIZE} AS s FROM (SELECT *, greatest(vram_mb - 900, 2048) AS u FROM (VALUES {', '.join(f'({v}, {_q(b)}, {_q(m)})' for v, b, m in VRAM)}) v(vram_mb, backend, model))))""",
    "plan_report": f"""WITH r AS (SELECT item_id, count(*) AS paragraphs, count(*) FILTER (text IS NOT NULL AND {_ROUTED}) AS dirty FROM segments GROUP BY item_id),
j AS MATERIALIZED (SELECT item_id, j.seg_id, seg_index, span_index, length(j.text) + length(before) + length(after) + 32 AS cost FROM ({_jobs_of(_EDIT)}) j JOIN segments s USING (seg_id)),
p AS (SELECT item_id, count(*) AS n_jobs, max(pack_no) + 1 AS packs FROM ({_packs('SELECT * FROM j', MAX_CHARS, 'seg_index, span_index, seg_id')}) GROUP BY item_id),
a AS (SELECT item_id, paragraphs, dirty, coalesce(n_jobs, 0) AS n_jobs, coalesce(packs, 0) AS packs FROM r LEFT JOIN p USING (item_id))
SELECT item_id, grouping(item_id)::INT AS is_total, sum(paragraphs)::BIGINT AS paragraphs, sum(dirty)::BIGINT AS dirty, sum(paragraphs - dirty)::BIGINT AS skipped, sum(n_jobs)::BIGINT AS n_jobs, sum(packs)::BIGINT AS packs FROM a GROUP BY ROLLUP (item_id)""",
    "plan_translation": f"""WITH z AS MATERIALIZED (SELECT *, text IS NOT NULL AND {_needs('text', 'tag', 'translate', 1)} AS dirty FROM segments), r AS (SELECT item_id, count(*) AS paragraphs, count(*) FILTER (dirty) AS dirty FROM z GROUP BY item_id),
p AS (SELECT item_id, count(*) AS n_jobs, max(pack_no) + 1 AS packs FROM ({_segment_packs(MAX_CHARS, MAX_CHARS, "length(t) + 8", "(SELECT * FROM z WHERE dirty)", "seg_index, seg_id")}) GROUP BY item_id),
a AS (SELECT item_id, paragraphs, dirty, coalesce(n_jobs, 0) AS n_jobs, coalesce(packs, 0) AS packs FROM r LEFT JOIN p USING (item_id))
SELECT item_id, grouping(item_id)::INT AS is_total, sum(paragraphs)::BIGINT AS paragraphs, sum(dirty)::BIGINT AS dirty, sum(paragraphs - dirty)::BIGINT AS skipped, sum(n_jobs)::BIGINT AS n_jobs, sum(packs)::BIGINT AS packs FROM a GROUP BY ROLLUP (item_id)""",
    "txt_paragraphs": f"SELECT doc_id, 'p' || k AS item_id, row_number() OVER (PARTITION BY doc_id, k ORDER BY i) - 1 AS seg_index, p AS text FROM (SELECT doc_id, k, i, array_to_string(list_filter(list_transform(string_split(c, chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), ' ') AS p FROM (SELECT doc_id, k, unnest(regexp_split_to_array({_strip('sec')}, '\\n[{WS}]*\\n')) AS c, generate_subscripts(regexp_split_to_array({_strip('sec')}, '\\n[{WS}]*\\n'), 1) AS i FROM (SELECT doc_id, unnest(string_split(x, chr(12))) AS sec, generate_subscripts(string_split(x, chr(12)), 1) - 1 AS k FROM (SELECT doc_id, {_TXT} AS x FROM documents WHERE text IS NOT NULL)))) WHERE p <> ''",
    "json_chapters": f"SELECT replace(substring(book_id, 4), '-', '')::BIGINT AS doc_id, dense_rank() OVER (PARTITION BY book_id ORDER BY f) - 1 AS chapter_ord, item_id AS title, row_number() OVER (PARTITION BY book_id, item_id ORDER BY o) - 1 AS seg_index, tag, text FROM (SELECT *, min(o) OVER (PARTITION BY book_id, item_id) AS f FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY loaded_at, seg_id) AS o FROM segments) WHERE text IS NOT NULL AND {_strip('text')} <> '')",
    "write_txt": _digest_of(f"regexp_replace(string_agg(text, chr(10) || chr(10) ORDER BY chapter_ord, o), '[{WS}]+$', '') || chr(10)"),
    "pack_segments": f"SELECT seg_id, item_id, piece_no, md5(t) AS digest, pack_no FROM ({_BY_CHARS})",
    "pack_segments_tokens": f"SELECT seg_id, item_id, piece_no, md5(t) AS digest, pack_no FROM ({_BY_TOKENS})",
    "carry_context": f"SELECT item_id, pack_no, md5(coalesce(lag(right(x, 500)) OVER (PARTITION BY item_id ORDER BY pack_no), '')) AS previous FROM (SELECT item_id, pack_no, string_agg(t, chr(10) || chr(10) ORDER BY {_ORDER}, piece_no) AS x FROM ({_BY_CHARS}) GROUP BY item_id, pack_no)",
    "parse_numbered": _PARSED,
    "retry_rounds": _RETRIED,
    "polished_segments": _POLISHED,
    "page_paragraphs": _PAGES,
    "html_blocks": f"SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY chapter_ord, o) - 1 AS seg_index, tag, x AS text FROM (SELECT item_id, chapter_ord, o, {_HTML_TAG} AS tag, {_squeeze('text')} AS x FROM ({_WRITTEN})) WHERE tag <> 'pre' AND length(x) >= 2",
    "write_markdown": _digest_of(f"regexp_replace(string_agg({_MD_BLOCK} || {_GAP}, '' ORDER BY chapter_ord, o), '[{WS}]+$', '') || chr(10)"),
    "write_html": _digest_of(f"'<!DOCTYPE html>' || chr(10) || '<html><body>' || chr(10) || string_agg({_HTML_LINE}, chr(10) ORDER BY chapter_ord, o) || chr(10) || '</body></html>' || chr(10)"),
    "write_jsonl": _digest_of(f"string_agg({_RECORD}, chr(10) ORDER BY chapter_ord, o) || chr(10)"),
    "md_blocks": _MD,
    "change_report": f"SELECT edit_id, md5('### Paragraph ' || para || chr(10) || chr(10) || 'Before:' || chr(10) || chr(10) || f || chr(10) || {_S} || chr(10) || f || chr(10) || chr(10) || 'After:' || chr(10) || chr(10) || f || chr(10) || coalesce(after, '') || chr(10) || f) AS digest FROM (SELECT *, {_FENCE} AS f FROM edits) WHERE {_squeeze(_S)} <> {_squeeze(_A)}",
    "change_log": f"""{_PUT}, n AS (SELECT book_id, source || ' → ' || target AS term, count(*) AS n FROM done JOIN (SELECT seg_id, book_id FROM segments) USING (seg_id) GROUP BY 1, 2),
tl AS (SELECT book_id, '- Terms put in:' || chr(10) || string_agg('  - ' || term || ': ' || n, chr(10) ORDER BY r) FILTER (r <= 3) || CASE WHEN max(r) > 3 THEN chr(10) || '  - … ' || (max(r) - 3) || ' more' ELSE '' END || chr(10) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY n DESC, term) AS r FROM n) GROUP BY book_id),
e AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY coalesce(list_last(regexp_extract_all(href, '\\d+'))::BIGINT, 0), href, para, kind, edit_id) AS pl, {_FENCE} AS f FROM edits WHERE {_squeeze(_S)} <> {_squeeze(_A)}),
h AS (SELECT *, min(pl) OVER w AS fst, count(*) OVER w AS many FROM e WINDOW w AS (PARTITION BY book_id, href, chapter_title, chapter_id)),
bd AS (SELECT book_id, string_agg(CASE WHEN pl = fst THEN '## ' || coalesce(chapter_title, '') || chr(10) || '*' || coalesce(href, '') || ' · ' || many || '*' || chr(10) || chr(10) ELSE '' END || '### Paragraph ' || para || ' (' || kind || ')' || chr(10) || chr(10)
 || 'Before:' || chr(10) || chr(10) || f || chr(10) || {_S} || chr(10) || f || chr(10) || chr(10) || 'After:' || chr(10) || chr(10) || f || chr(10) || coalesce(after, '') || chr(10) || f, chr(10) || chr(10) ORDER BY fst, pl) AS body FROM h GROUP BY book_id)
SELECT s.book_id, md5('# Change log' || chr(10) || chr(10) || '- Sent: ' || sent || chr(10) || '- Rewritten: ' || edits || ' (left as they were: ' || unchanged || ')' || chr(10) || '- Chapters with edits: ' || chapters_edited || chr(10) || coalesce(terms, '') || chr(10) || coalesce(body, 'Nothing was rewritten.') || chr(10)) AS digest
FROM (SELECT book_id, count(*) AS sent, count(*) FILTER ({_squeeze(_S)} = {_squeeze(_A)}) AS unchanged, count(*) FILTER ({_squeeze(_S)} <> {_squeeze(_A)}) AS edits, count(DISTINCT chapter_id) FILTER ({_squeeze(_S)} <> {_squeeze(_A)}) AS chapters_edited FROM edits GROUP BY book_id) s LEFT JOIN bd USING (book_id) LEFT JOIN tl USING (book_id)""",
    "full_prompts": f"""SELECT chunk_id, md5('You correct English that a machine translated. Rewrite the REPLACE parts only; names, meaning and tone stay. Answer with the numbered blocks and no other words.' || chr(10) || chr(10) || 'Style notes:' || chr(10) || 'Stay within the vocabulary and register of the text.'
|| 'Rewrite each REPLACE part. Give only its new wording, under its number. Leave out the KEEP parts.' || chr(10) || chr(10) || 'Spans:' || chr(10) || chr(10) || prompt) AS digest FROM ({_PACK_ROWS})""",
}
