"""SQL for the queries that SQL can express."""

from __future__ import annotations

from .url_reputation import TWO_LABEL_SUFFIXES, suffix_pattern

_S = suffix_pattern(TWO_LABEL_SUFFIXES)


def _fits(host: str, path: str) -> str:
    return f"((host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}'))"


def _strength(groups: str) -> str:
    return f"(SELECT round(1 / least(greatest(coalesce(sum(pow(k - n * p, 2) - n * p * (1 - p)) / nullif(sum(n * (n - 1) * p * (1 - p)), 0), 1e-4), 1e-4), 0.999) - 1, 6) FROM {groups})"


def url_reputation(rules, max_bad: float = 0.3, z: float = 1.645) -> str:
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))
    rule = " ".join(f"WHEN {_fits(h, p)} THEN '{h + p}'" for _, h, p in ordered)
    verdict = " ".join(f"WHEN {_fits(h, p)} THEN '{a}'" for a, h, p in ordered)
    return f"""WITH pg AS (SELECT page_id, coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
worst AS (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY 1),
h0 AS (SELECT host, count(bad) AS n, CAST(coalesce(sum(bad), 0) AS BIGINT) AS k FROM pg LEFT JOIN worst ON page_id = doc_id GROUP BY 1),
h1 AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?\\.?$', '') AS name FROM h0),
h2 AS (SELECT host, n, k, CASE WHEN regexp_matches(name, '^[0-9.]+$') OR regexp_extract(name, '([^.]+\\.(?:{_S}))$', 1) = '' THEN name ELSE regexp_extract(name, '([^.]+\\.(?:{_S}))$', 1) END AS domain, CASE WHEN regexp_matches(name, '^[0-9.]+$') THEN name ELSE regexp_extract(name, '(?:^|\\.)({_S})$', 1) END AS suffix FROM h1),
s0 AS (SELECT suffix, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k, (SELECT (sum(k) + 1) / (sum(n) + 2) FROM h2) AS p FROM h2 GROUP BY 1),
s1 AS (SELECT suffix, ({_strength('s0')} * p + k) / ({_strength('s0')} + n) AS p FROM s0),
d0 AS (SELECT domain, suffix, n, k, p FROM (SELECT domain, suffix, sum(n)::DOUBLE AS n, sum(k)::DOUBLE AS k FROM h2 GROUP BY 1, 2) JOIN s1 USING (suffix)),
d1 AS (SELECT domain, suffix, ({_strength('d0')} * p + k) / ({_strength('d0')} + n) AS p FROM d0),
h3 AS (SELECT host, n::DOUBLE AS n, k::DOUBLE AS k, p FROM h2 JOIN d1 USING (domain, suffix)),
h4 AS (SELECT host, {_strength('h3')} * p + k AS a, {_strength('h3')} * (1 - p) + n - k AS b FROM h3),
h5 AS (SELECT host, round(a / (a + b), 6) AS host_bad, round(a / (a + b) - {z}::DOUBLE * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 6) AS host_bad_low FROM h4)
SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} WHEN host_bad_low > {max_bad} THEN 'block' ELSE 'allow' END AS verdict, host_bad, host_bad_low FROM pg JOIN h5 USING (host)"""


def mixing(target_entropy: float, max_repeats: float, block_tokens: int, seed: int) -> str:
    """Without a budget: every document at least once."""

    def bisect(name: str, test: str) -> str:
        return f"""{name}_a(a) AS (SELECT unnest([0.0::DOUBLE, 1.0::DOUBLE])),
{name}_v AS (SELECT a, sum(pow(p, a)) AS z, sum(pow(p, a) * ln(p)) AS e, min(pow(p, a - 1)) AS least, max(pow(p, a - 1)) AS most FROM {name}_a, live GROUP BY 1),
{name}(i, lo, hi) AS (SELECT 0, CASE WHEN (SELECT {test} FROM {name}_v WHERE a = 1) THEN 1.0::DOUBLE ELSE 0 END, CASE WHEN (SELECT {test} FROM {name}_v WHERE a = 1) THEN 1.0::DOUBLE WHEN NOT (SELECT {test} FROM {name}_v WHERE a = 0) THEN 0 ELSE 1 END
UNION ALL SELECT i + 1, CASE WHEN {test} THEN a ELSE lo END, CASE WHEN {test} THEN hi ELSE a END FROM (SELECT i, lo, hi, (lo + hi) / 2 AS a, sum(pow(p, (lo + hi) / 2)) AS z, sum(pow(p, (lo + hi) / 2) * ln(p)) AS e, min(pow(p, (lo + hi) / 2 - 1)) AS least, max(pow(p, (lo + hi) / 2 - 1)) AS most FROM {name}, live WHERE i < 30 GROUP BY 1, 2, 3))"""

    return f"""WITH RECURSIVE slim AS (SELECT source, doc_id, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))) AS BIGINT) AS tokens FROM documents GROUP BY 1, 2),
src AS (SELECT source, CAST(sum(tokens) AS BIGINT) AS total, sum(tokens) / (SELECT sum(tokens) FROM slim)::DOUBLE AS p FROM slim GROUP BY 1), live AS (SELECT * FROM src WHERE total > 0),
{bisect('ent', f'ln(z) - a * e / z >= {target_entropy}::DOUBLE * ln((SELECT count(*) FROM live))')}, {bisect('rep', f'most / least > {max_repeats}::DOUBLE')},
ex AS (SELECT round(greatest((SELECT lo FROM ent WHERE i = 30), (SELECT lo FROM rep WHERE i = 30)), 6) AS a),
r0 AS (SELECT src.*, coalesce(CASE WHEN total > 0 THEN round(pow(p, a - 1) / (SELECT min(pow(p, a - 1)) FROM live), 9) END, 1) AS repeats FROM src, ex),
r1 AS (SELECT *, CAST(floor(repeats) AS INTEGER) AS whole, CAST(floor((repeats - floor(repeats)) * total) AS BIGINT) AS part FROM r0),
nb AS (SELECT greatest(1, CAST(ceil(sum(whole * total + part) / {block_tokens}) AS BIGINT)) AS blocks FROM r1),
c0 AS (SELECT s.*, r1.total, whole, part, CAST(unnest(range(0, whole + CASE WHEN part > 0 THEN 1 ELSE 0 END)) AS INTEGER) AS copy FROM slim s JOIN r1 ON s.source IS NOT DISTINCT FROM r1.source),
c1 AS (SELECT *, md5('{seed}:' || copy || ':' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS digest FROM c0),
c2 AS (SELECT *, CAST('0x' || substr(digest, 1, 15) AS BIGINT) AS k, CAST('0x' || substr(digest, 16, 15) AS BIGINT) AS shuffle FROM c1),
c3 AS (SELECT *, CAST(coalesce(sum(tokens) OVER (PARTITION BY source, copy ORDER BY k, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) AS at_ FROM c2),
c4 AS (SELECT doc_id, source, copy, tokens, shuffle, CAST(CASE WHEN whole * total + part > 0 THEN least(blocks - 1, (copy * total + at_) * blocks // (whole * total + part)) ELSE k % blocks END AS BIGINT) AS block FROM c3, nb WHERE copy < whole OR at_ < part)
SELECT doc_id, source, copy, tokens, block, row_number() OVER (PARTITION BY block ORDER BY shuffle, doc_id, source, copy) AS position FROM c4"""


CHAT_ROTATION = """WITH t AS (SELECT DISTINCT conv_id, turn, replace(coalesce(role, 'unknown'), '<|', '< |') AS speaker, replace(coalesce(text, ''), '<|', '< |') AS text FROM conversations),
p AS (SELECT *, row_number() OVER w - 1 AS place, coalesce(sum(length(text)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS said FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, speaker, md5(text))),
d AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY place // 256 + CAST(said AS BIGINT) // 1000000) - 1 AS part FROM p),
who AS (SELECT DISTINCT conv_id, speaker AS perspective FROM t WHERE speaker <> 'system'),
s AS (SELECT d.*, perspective, CASE WHEN speaker = perspective THEN '<|assistant|>' || chr(10) WHEN speaker = 'system' THEN '<|system|>' || chr(10) ELSE '<|user name=' || speaker || '|>' || chr(10) END AS head, text || '<|end|>' || chr(10) AS body FROM d JOIN who ON d.conv_id IS NOT DISTINCT FROM who.conv_id),
o AS (SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at_, length(head) AS h FROM s),
b AS (SELECT *, min(at_) OVER (PARTITION BY conv_id, perspective, part) AS start FROM o)
SELECT conv_id, perspective, part, min(place) AS first_turn, CAST(any_value(start) AS BIGINT) AS start, count(*) AS n_turns, count(*) FILTER (speaker = perspective) AS n_own, string_agg(head || body, '' ORDER BY place) AS text, coalesce(string_agg((at_ - start + h) || ':' || (at_ - start + h + length(body)), ',' ORDER BY place) FILTER (speaker = perspective), '') AS loss_spans FROM b GROUP BY conv_id, perspective, part"""


def suffix_merge(length: int) -> str:
    """Every string of `length` bytes; all but the first of equal ones mark what they cover."""
    return f"""
WITH t AS MATERIALIZED (SELECT doc_id, encode(coalesce(text, '')) AS h FROM documents),
s AS (SELECT doc_id, h, unnest(range(0, greatest(0, octet_length(h) - {length - 1}))) AS pos FROM t),
w AS MATERIALIZED (SELECT doc_id, pos, md5_number(h[pos + 1 : pos + {length}]) AS k FROM s),
m AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) AS r FROM w) WHERE r > 1),
g AS (SELECT doc_id, pos, sum(CASE WHEN pos > last + {length} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS part FROM (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS last FROM m)),
span AS (SELECT doc_id, min(pos) AS a, max(pos) + {length} AS b FROM g GROUP BY doc_id, part),
piece AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p FROM span),
cut AS (SELECT doc_id, string_agg(CASE WHEN a > p THEN hex(h[p + 1 : a]) ELSE '' END, '' ORDER BY a) AS head, max(b) AS stop, sum(b - a) AS gone, count(*) AS n FROM piece JOIN t USING (doc_id) GROUP BY doc_id)
SELECT t.doc_id, CAST(octet_length(h) AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(CASE WHEN n IS NULL THEN h ELSE unhex(head || CASE WHEN stop < octet_length(h) THEN hex(h[stop + 1 : octet_length(h)]) ELSE '' END) END) AS kept_sha256
FROM t LEFT JOIN cut USING (doc_id)"""


def spelling(thin: int, min_letters: int, min_count: int, ratio: int) -> str:
    """CRC-32 from a table of 256 entries made by its rule; near words by words with one letter left out or masked."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""
WITH RECURSIVE steps AS MATERIALIZED (SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) t(i)),
tok AS (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
low AS (SELECT doc_id, translate(w, '{upper}', '{upper.lower()}') AS w, count(*) AS n FROM tok GROUP BY 1, 2),
raw AS (SELECT w, n, hex(encode(CAST(doc_id AS VARCHAR) || ':' || w)) AS x FROM low),
crc AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, tab[CAST(xor(c, b) & 255 AS BIGINT) + 1])), 4294967295) AS h FROM raw, steps),
thinned AS (SELECT CASE WHEN h % {thin} = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM crc),
v AS MATERIALIZED (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM thinned GROUP BY 1 HAVING length(word) >= {min_letters} AND sum(n) >= {min_count}),
holes AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest, length(word) AS len FROM v, (SELECT unnest(range(1, (SELECT max(length(word)) + 1 FROM v))) AS i) WHERE i <= length(word)),
pairs AS (SELECT a.word, b.word AS near, b.n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.len = b.len AND a.word <> b.word
          UNION SELECT a.word, b.word, b.n FROM holes a JOIN v b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM holes a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, min_by(near, (-n, near)) AS near, max(n) AS near_n FROM pairs GROUP BY 1),
forms AS MATERIALIZED (SELECT word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {ratio} * v.n THEN near END AS form, CASE WHEN near_n >= {ratio} * v.n THEN near_n END AS form_n FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root FROM forms UNION ALL SELECT walk.word, forms.form FROM walk JOIN forms ON forms.word = walk.root WHERE forms.form IS NOT NULL)
SELECT f.word, f.form, walk.root, f.n, f.n_near, f.form_n FROM forms f JOIN walk USING (word) JOIN forms e ON e.word = walk.root WHERE e.form IS NULL"""
