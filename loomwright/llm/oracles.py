"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from . import langid, lm_quality, manifest, quality, urlgraph

_SPACE = "chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP9 = f"""
WITH docs AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, r, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM docs),
k AS (SELECT *, {_LOWER.format(f"trim(line, {_SPACE})")} AS key FROM l),
often AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
j AS (SELECT k.*, coalesce(k.doc_id < often.last, false) AS gone FROM k LEFT JOIN often USING (key))
SELECT any_value(doc_id) AS doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM j GROUP BY r
"""

_WORDS = r"string_split_regex(trim(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g'), ' '), ' ')"

OP10 = f"""
WITH d AS (SELECT r, doc_id, list_filter({_WORDS.format("coalesce(text, '')")}, lambda x: x <> '') AS w
           FROM (SELECT row_number() OVER () AS r, doc_id, text FROM documents)),
b AS (SELECT item_id, list_filter({_WORDS.format("coalesce(text, '')")}, lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i+least(len(w), 13)-1], ' ') AS win
       FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, i, n, array_to_string(w[i:i+n-1], ' ') AS win
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw USING (n, win)),
hw AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM hit)) GROUP BY r),
it AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM hit GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hw USING (r) LEFT JOIN it USING (r)
"""


_WORD = r"[^\x20\x09-\x0D]+"


def _cuts(sketch: str) -> str:
    """Quantiles of the sketch rows (lang, source, metric, low, n) of a table, for groups, languages and all."""
    return f"""
SELECT lvl, lang, source, metric, min(low) FILTER (s * 100 >= a * 25) AS q1, min(low) FILTER (s * 100 >= a * 50) AS q2, min(low) FILTER (s * 100 >= a * 75) AS q3,
       min(low) FILTER (s * 100 >= a * {quality.TAIL_PERCENT}) AS tail, any_value(a) AS n
FROM (SELECT *, sum(n) OVER (PARTITION BY lvl, lang, source, metric ORDER BY low) AS s, sum(n) OVER (PARTITION BY lvl, lang, source, metric) AS a
      FROM (SELECT 2 AS lvl, lang, source, metric, low, n FROM {sketch} UNION ALL SELECT 1, lang, NULL, metric, low, sum(n) FROM {sketch} GROUP BY ALL
            UNION ALL SELECT 0, NULL, NULL, metric, low, sum(n) FROM {sketch} GROUP BY ALL))
GROUP BY lvl, lang, source, metric"""


def _limits(cuts: str, spread: int, margins: str, rates: bool) -> str:
    """(lang, source, metric, lo, hi) of every group and metric from a table of quantiles."""
    pick = lambda x, least: f"CASE WHEN o.n >= {least} THEN o.{x} WHEN l.n >= {least} THEN l.{x} ELSE w.{x} END"
    least = lambda t: f"{spread} * least({t}.q3 - {t}.q2, {t}.q2 - {t}.q1) + margin"
    cap = f"CASE WHEN ln >= {quality.MIN_GROUP} THEN {{}} END"
    hi = [f"q2 + {spread} * (q3 - q2) + margin", cap.format(f"l2 + {least('x').replace('x.', 'l')}")] + ([f"w2 + {least('x').replace('x.', 'w')}"] if rates else [])
    lo = [f"q2 - {spread} * (q2 - q1) - margin", cap.format(f"l2 - ({least('x').replace('x.', 'l')})")]
    hi, lo = (", ".join(x).replace("lq", "l").replace("wq", "w") for x in (hi, lo))
    return f"""
SELECT lang, source, metric, {"NULL" if rates else f"greatest({lo})"} AS lo, least({hi}) AS hi
FROM (SELECT g.lang, g.source, m.metric, {pick("q1", quality.MIN_GROUP)} AS q1, {pick("q2", quality.MIN_GROUP)} AS q2, {pick("q3", quality.MIN_GROUP)} AS q3,
             l.n AS ln, l.q1 AS l1, l.q2 AS l2, l.q3 AS l3, w.q1 AS w1, w.q2 AS w2, w.q3 AS w3,
             always + least(coalesce({quality.TWICE} * ({pick("tail", quality.MIN_TAIL)}), most), most){"" if rates else f" + ({pick('q2', quality.MIN_GROUP)}) // 32"} AS margin
      FROM groups g CROSS JOIN (VALUES {margins}) m(metric, always, most)
      LEFT JOIN {cuts} o ON o.lvl = 2 AND o.metric = m.metric AND o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source
      LEFT JOIN {cuts} l ON l.lvl = 1 AND l.metric = m.metric AND l.lang IS NOT DISTINCT FROM g.lang
      LEFT JOIN {cuts} w ON w.lvl = 0 AND w.metric = m.metric)"""


def _sketch(rows: str) -> str:
    return f"SELECT lang, source, metric, (v >> c) << c AS low, count(*) AS n FROM (SELECT *, greatest(0, length(bin(v)) - 6) AS c FROM {rows}) GROUP BY ALL"


def _op4() -> str:
    rates = ", ".join(f"('{k}', {a}, {b})" for k, (a, b) in quality.CEILING.items())
    inside = "t.metric = v.metric AND t.lang IS NOT DISTINCT FROM v.lang AND t.source IS NOT DISTINCT FROM v.source"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '{_WORD}') AS w FROM d),
win AS (SELECT r, i, array_to_string(w[i:i + 7], ' ') AS x FROM (SELECT r, w, unnest(range(1, len(w) - 6)) AS i FROM w)),
again AS (SELECT r, x FROM win GROUP BY r, x HAVING count(*) > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS p FROM win JOIN again USING (r, x)) GROUP BY r),
ln AS (SELECT r, count(*) AS n, count(DISTINCT x) AS u FROM (SELECT r, unnest(string_split(text, chr(10))) AS x FROM d) WHERE regexp_matches(x, '{_WORD}') GROUP BY r),
b AS (SELECT d.r, doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(ln.n - ln.u, 0)::BIGINT AS n_dup_lines,
             coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(ln.n, 0) AS n_lines
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN ln USING (r)),
j AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM b),
groups AS (SELECT DISTINCT lang, source FROM j WHERE NOT base_failed),
v AS (SELECT r, lang, source, unnest(['word_length', 'symbols', 'dup_lines', 'repeats']) AS metric,
             unnest([100 * word_chars // greatest(n_words, 1), 1000 * n_symbols // (n_words + {quality.MORE_WORDS}), 1000 * n_dup_lines // (n_lines + {quality.MORE_LINES}), 1000 * n_repeat_words // (n_words + {quality.MORE_WORDS})]) AS v
      FROM j WHERE NOT base_failed),
s1 AS ({_sketch("(SELECT * FROM v WHERE metric = 'word_length')")}),
c1 AS ({_cuts("s1")}),
t1 AS ({_limits("c1", quality.SPREAD, f"('word_length', {quality.LENGTH_MARGIN}, 0)", False)}),
core AS ({_limits("c1", quality.CORE_SPREAD, "('word_length', 0, 0)", False)}),
usual AS (SELECT v.r FROM v JOIN core t ON {inside} WHERE v >= lo AND v <= hi),
s2 AS ({_sketch("(SELECT v.* FROM v JOIN usual USING (r) WHERE metric <> 'word_length')")}),
c2 AS ({_cuts("s2")}),
t2 AS ({_limits("c2", quality.SPREAD, rates, True)}),
gone AS (SELECT DISTINCT r FROM v JOIN (SELECT * FROM t1 UNION ALL SELECT * FROM t2) t ON {inside} WHERE v < lo OR v > hi)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND gone.r IS NULL AS kept FROM j LEFT JOIN gone USING (r)
"""


def _op8(rounds: int = 80) -> str:
    """Scores of links settle within `rounds` to less than a millionth."""
    lower = lambda x: _LOWER.format(x)
    host = lambda x: lower(f"regexp_extract({x}, '(?s)^.*?://([^/?#]*)', 1)")
    when = []
    for kind, text in sorted(urlgraph.RULES, key=lambda r: (-len(r[1]), r[1])):
        h, slash, p = text.partition("/")
        when.append((f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{slash + p}')", text, kind))
    case = lambda k: "CASE " + " ".join(f"WHEN {w[0]} THEN '{w[k]}'" for w in when) + " END"
    d = urlgraph.DAMPING
    steps = [
        f"""g{i} AS MATERIALIZED (SELECT h.host, {1 - d} * trusted + {d} * coalesce(a.t, 0) AS t, {1 - d} + {d} * coalesce(a.f, 0) AS f, {1 - d} * blocked + {d} * coalesce(b.d, 0) AS d, {1 - d} + {d} * coalesce(b.b, 0) AS b FROM hosts h
 LEFT JOIN (SELECT dst, sum(t * along) AS t, sum(f * along) AS f FROM ways JOIN g{i - 1} ON src = host GROUP BY dst) a ON a.dst = h.host
 LEFT JOIN (SELECT src, sum(d * back) AS d, sum(b * back) AS b FROM ways JOIN g{i - 1} ON dst = host GROUP BY src) b ON b.src = h.host)"""
        for i in range(1, rounds + 1)
    ]
    of = lambda score, rank: f"coalesce({score} / nullif(greatest({rank} - (CASE WHEN trusted > 0 OR blocked > 0 THEN 0 ELSE {1 - d} END), 0), 0), 0)"
    return f"""
WITH p AS (SELECT row_number() OVER () AS r, page_id, coalesce({host("url")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, html FROM pages),
j AS (SELECT *, {case(1)} AS rule, {case(2)} AS by_rule FROM p),
seeds AS (SELECT host, avg((coalesce(by_rule, '') = 'allow')::INT) AS trusted, avg((coalesce(by_rule, '') = 'block')::INT) AS blocked FROM j WHERE host <> '' GROUP BY host),
refs AS (SELECT host AS src, unnest(list_distinct(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?(?:https?:)?(//[^"''\\s>]+)', 1))) AS ref FROM p),
edges AS MATERIALIZED (SELECT src, dst, count(*) AS n FROM (SELECT src, {host("':' || ref")} AS dst FROM refs) WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY ALL),
hosts AS MATERIALIZED (SELECT host, coalesce(trusted, 0) AS trusted, coalesce(blocked, 0) AS blocked FROM (SELECT host FROM seeds UNION SELECT src FROM edges UNION SELECT dst FROM edges) LEFT JOIN seeds USING (host)),
ways AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS along, n / sum(n) OVER (PARTITION BY dst) AS back FROM edges),
g0 AS MATERIALIZED (SELECT host, {1 - d} * trusted AS t, {1 - d} AS f, {1 - d} * blocked AS d, {1 - d} AS b FROM hosts),
{", ".join(steps)}
SELECT page_id, host, path, rule, coalesce(by_rule, CASE WHEN {of("d", "b")} - {of("t", "f")} > CASE WHEN trusted > 0 OR blocked > 0 THEN {urlgraph.MARGIN} ELSE {min(urlgraph.MARGIN, urlgraph.LINK_MARGIN)} END THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN g{rounds} USING (host) LEFT JOIN seeds USING (host)
"""


#: The white space that Python's str.split() parts at, for RE2.
_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def _op6() -> str:
    """The Kneser-Ney model and its scores on strings; chr(1) stands before a text (no test text has it)."""
    top = lm_quality.ORDER
    parts = [f"""
t AS (SELECT row_number() OVER () AS r, d.doc_id, lang, coalesce(l.good, false) AS own, repeat(chr(1), {top - 1}) || trim(regexp_replace(lower(coalesce(text, '')), '{_BLANK}', ' ', 'g'), ' ') AS x FROM documents d
      LEFT JOIN (SELECT doc_id, min(quality) = 1 AND max(coalesce(toxic, 0)) = 0 AS good FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id),
g AS MATERIALIZED (SELECT r, own, substring(x, i, {top}) AS g, count(*) AS n FROM (SELECT r, own, x, unnest(range(1, length(x) - {top - 2})) AS i FROM t WHERE length(x) >= {top}) GROUP BY ALL),
c{top} AS MATERIALIZED (SELECT g, sum(n)::BIGINT AS n, sum(n)::BIGINT AS seen FROM g WHERE own GROUP BY 1)"""]
    for k in range(top - 1, 0, -1):
        parts.append(f"c{k} AS MATERIALIZED (SELECT right(g, {k}) AS g, count(*) AS n, sum(seen)::BIGINT AS seen FROM c{k + 1} GROUP BY 1)")
    for k in range(1, top + 1):
        parts.append(f"""
n{k} AS (SELECT count(*) FILTER (n = 1) AS n1, count(*) FILTER (n = 2) AS n2, count(*) FILTER (n = 3) AS n3, count(*) FILTER (n = 4) AS n4 FROM c{k}),
y{k} AS (SELECT *, CASE WHEN n1 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5::DOUBLE END AS y FROM n{k}),
d{k} AS (SELECT CASE WHEN n1 > 0 THEN least(greatest(1 - 2 * y * n2 / greatest(n1, 1), 0.05::DOUBLE), 0.95::DOUBLE) ELSE 0.5 END AS d1, CASE WHEN n2 > 0 THEN least(greatest(2 - 3 * y * n3 / greatest(n2, 1), 0.05::DOUBLE), 1.95::DOUBLE) ELSE 1.0 END AS d2,
 CASE WHEN n3 > 0 THEN least(greatest(3 - 4 * y * n4 / greatest(n3, 1), 0.05::DOUBLE), 2.95::DOUBLE) ELSE 1.5 END AS d3 FROM y{k}),
o{k} AS (SELECT g, n, seen, (CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END)::DOUBLE AS off FROM c{k}, d{k})""")
        if k == 1:
            parts.append("""
base AS (SELECT coalesce(sum(off) / sum(n), 1.0) / (count(*) + 1) AS b, greatest(coalesce(sum(n), 0), 1) AS total FROM o1),
p1 AS MATERIALIZED (SELECT g, seen, (n - off) / total + b AS p FROM o1, base)""")
        else:
            parts.append(f"""
x{k} AS MATERIALIZED (SELECT left(g, {k - 1}) AS g, sum(n) AS a, sum(off) AS o FROM o{k} GROUP BY 1),
p{k} AS MATERIALIZED (SELECT o{k}.g, o{k}.seen, (n - off + o * p{k - 1}.p) / a AS p FROM o{k} JOIN x{k} ON x{k}.g = left(o{k}.g, {k - 1}) JOIN p{k - 1} ON p{k - 1}.g = right(o{k}.g, {k - 1}))""")
    log_p, joins = "ln(b)", ""
    for k in range(1, top + 1):
        back = f"coalesce(ln(x{k}.o / x{k}.a), 0) + " if k > 1 else ""
        log_p = f"CASE WHEN p{k}.seen > least THEN ln(p{k}.p) ELSE {back}{log_p} END" if k == 1 else f"CASE WHEN p{k}.seen > least THEN ln(p{k}.p) ELSE {back}({log_p}) END"
        joins += f" LEFT JOIN p{k} ON p{k}.g = right(q.g, {k})" + (f" LEFT JOIN x{k} ON x{k}.g = left(right(q.g, {k}), {k - 1})" if k > 1 else "")
    parts.append(f"""
s AS (SELECT r, -sum(n * ({log_p})) / sum(n) AS lp FROM (SELECT r, g, n, CASE WHEN own THEN n ELSE 0 END AS least FROM g) q CROSS JOIN base{joins} GROUP BY r),
st AS (SELECT lang, floor(lp * {lm_quality.STEPS})::BIGINT AS step, count(*) AS n FROM t JOIN s USING (r) WHERE own GROUP BY 1, 2),
cum AS (SELECT lang, step, sum(n) OVER (PARTITION BY lang ORDER BY step) AS c, sum(n) OVER (PARTITION BY lang) AS a FROM st),
cuw AS (SELECT step, sum(sum(n)) OVER (ORDER BY step) AS c, sum(sum(n)) OVER () AS a FROM st GROUP BY step),
li AS (SELECT lang, min(step + 1) FILTER (c >= a * {lm_quality.QUANTILE}::DOUBLE) / {lm_quality.STEPS} + {lm_quality.MARGIN}::DOUBLE AS own_limit FROM cum GROUP BY lang HAVING max(a) >= {lm_quality.MIN_TRUSTED}),
wide AS (SELECT min(step + 1) FILTER (c >= a * {lm_quality.QUANTILE}::DOUBLE) / {lm_quality.STEPS} + {lm_quality.MARGIN}::DOUBLE AS all_limit FROM cuw)""")
    return "WITH " + ",\n".join(p.strip("\n") for p in parts) + """
SELECT doc_id, t.lang, round(lp, 6) AS log_perplexity, round(exp(lp), 4) AS perplexity, coalesce(own_limit, all_limit) AS "limit", lp IS NOT NULL AND coalesce(lp <= coalesce(own_limit, all_limit), true) AS kept
FROM t LEFT JOIN s USING (r) LEFT JOIN li ON li.lang = t.lang CROSS JOIN wide"""


def _op7() -> str:
    """Rank-order profiles on strings; CRC-32 of the ids' digits from its table."""
    ranked = "row_number() OVER (PARTITION BY {0} ORDER BY n DESC, length(g), g) - 1 AS k"
    return f"""
WITH crc AS (SELECT list_transform(range(0, 256), lambda b: list_reduce([b::BIGINT] || list_transform(range(0, 8), lambda z: z::BIGINT), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
d AS (SELECT row_number() OVER () AS r, doc_id, lang, text, xor(list_reduce([4294967295] || list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda z: ord(z)::BIGINT), lambda c, z: xor(c >> 8, tab[1 + (xor(c, z) & 255)])), 4294967295) % 4 = 2 AS held_out FROM documents, crc),
w AS (SELECT r, ' ' || unnest(regexp_extract_all(lower(coalesce(text, '')), '\\p{{L}}+')) || ' ' AS w FROM d),
wn AS (SELECT r, w, count(*) AS n FROM w GROUP BY 1, 2),
e AS (SELECT r, n, w, unnest([1, 2, 3]) AS size FROM wn),
gr AS (SELECT r, n, substring(w, unnest(range(1, length(w) - size + 2)), size) AS g FROM e),
g AS MATERIALIZED (SELECT r, g, sum(n)::BIGINT AS n FROM gr WHERE g <> ' ' GROUP BY 1, 2),
pr AS (SELECT lang, g, sum(n)::BIGINT AS n FROM g JOIN d USING (r) WHERE NOT held_out AND lang IS NOT NULL GROUP BY 1, 2),
p AS MATERIALIZED (SELECT lang, g, {ranked.format("lang")} FROM pr QUALIFY k < {langid.PROFILE}),
m AS (SELECT max(c) AS most FROM (SELECT count(*) AS c FROM p GROUP BY lang)),
mine AS (SELECT r, g, {ranked.format("r")} FROM g QUALIFY k < {langid.DOCUMENT}),
dist AS (SELECT mine.r, l.lang, sum(CASE WHEN p.k IS NULL THEN most ELSE least(abs(p.k - mine.k), most) END)::BIGINT AS dist, count(*) AS n FROM mine CROSS JOIN (SELECT DISTINCT lang FROM p) l CROSS JOIN m LEFT JOIN p ON p.lang = l.lang AND p.g = mine.g GROUP BY 1, 2),
best AS (SELECT r, arg_min(lang, (dist, lang)) AS lang, min(dist) AS dist, any_value(n) AS n FROM dist GROUP BY 1)
SELECT doc_id, held_out, coalesce(best.lang, 'und') AS lang_pred, coalesce(1 - dist::DOUBLE / (most * n), 0.0) AS score FROM d CROSS JOIN m LEFT JOIN best USING (r)
"""


def _tree(name: str, leaves: str, group: str, order: str, levels: int) -> tuple[list[str], str]:
    """Steps of trees over (group, h): each level has its nodes, with the siblings on both sides; and the roots."""
    steps = [f"{name}0 AS (SELECT *, row_number() OVER (PARTITION BY {group} ORDER BY {order}) - 1 AS i FROM {leaves})"]
    for k in range(levels):
        side = "coalesce(string_agg(h, '') OVER (PARTITION BY {g}, i // {f} ORDER BY i ROWS BETWEEN {a} AND {b}), '')"
        left = side.format(g=group, f=manifest.FANOUT, a="UNBOUNDED PRECEDING", b="1 PRECEDING")
        right = side.format(g=group, f=manifest.FANOUT, a="1 FOLLOWING", b="UNBOUNDED FOLLOWING")
        steps.append(f"{name}{k}s AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY {group}) AS n, {left} AS l, {right} AS r FROM {name}{k})")
        steps.append(f"{name}{k + 1} AS (SELECT {group}, i // {manifest.FANOUT} AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k}s GROUP BY {group}, i // {manifest.FANOUT})")
    return steps, f"{name}{levels}"


def _op11(levels: int = 6, top: int = 3) -> str:
    """Up to 16^6 leaves a source and 16^3 sources."""
    part = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(part, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    crc = "xor(list_reduce([4294967295] || list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda z: ord(z)::BIGINT), lambda c, z: xor(c >> 8, tab[1 + (xor(c, z) & 255)])), 4294967295)"
    steps = [
        "crc AS (SELECT list_transform(range(0, 256), lambda b: list_reduce([b::BIGINT] || list_transform(range(0, 8), lambda z: z::BIGINT), lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab)",
        f"d AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS h, CASE WHEN {crc} % 5 = 0 THEN {leaf(_LOWER.format('text'))} ELSE {leaf('text')} END AS held FROM documents, crc)",
    ]
    mine, subroots = _tree("s", "d", "source", "doc_id NULLS FIRST, h", levels)
    above, root = _tree("t", f"(SELECT 1 AS one, source, h FROM {subroots})", "one", "source NULLS FIRST", top)
    joins, fold, proof = [], "s0.held", []
    for tree, n, key, first in (("s", levels, "a.source IS NOT DISTINCT FROM s0.source AND", "s0.i"), ("t", top, "", "t0.i")):
        for k in range(n):
            a = f"{tree}{k}s"
            joins.append(f"JOIN {a} ON {key.replace('a.', a + '.')} {a}.i = {first} // {manifest.FANOUT**k}")
            fold = f"CASE WHEN {a}.n = 1 THEN {fold} ELSE sha256({a}.l || {fold} || {a}.r) END"
            proof.append(f"{a}.l || {a}.r")
        if tree == "s":
            joins.append("JOIN t0 ON t0.source IS NOT DISTINCT FROM s0.source")
    return f"""WITH {", ".join([*steps, *mine, *above])}
SELECT *, folded_root = root AS verified FROM (
SELECT s0.doc_id, s0.h AS leaf, t0.h AS subroot, {root}.h AS root, sha256({" || ".join(proof)}) AS proof_sha256, {fold} AS folded_root
FROM s0 {" ".join(joins)} CROSS JOIN {root})"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": _op4(), "op6_quality_classifier": _op6(), "op7_language_id": _op7(), "op8_url_filters": _op8(), "op9_line_dedup": OP9, "op10_benchmark_decontamination": OP10,
        "op11_merkle_manifest": _op11(),
    }
