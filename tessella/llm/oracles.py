"""DuckDB SQL that computes, over whole tables, what some of the queries return."""

from __future__ import annotations

from tessella.llm import licenses, mixing, quality, ranks, sharding, spelling, suffix_dedup

_SPLIT = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_WORDS = _SPLIT.format("coalesce(text, '')")
_HEX, _LAST = 2 * suffix_dedup.LENGTH, suffix_dedup.LENGTH - 1  # a byte is two digits
_NO_WORD = r"NOT regexp_matches(l, '[^\x20\x09-\x0D]')"


def _hash(seed: int, *cols: str) -> str:
    key = ", ".join([f"'{seed}'", *[f"coalesce(CAST({c} AS VARCHAR), '')" for c in cols]])
    return f"CAST('0x' || md5(concat_ws('|', {key}))[1:{ranks.HASH_BITS // 4}] AS BIGINT)"


#: Sources by cap per weight; each in turn is closed at its cap while that is below what its weight would fetch.
OP1 = f"""WITH r AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, text FROM documents),
h AS (SELECT *, {_hash(mixing.SEED, 'doc_id', 'size')} AS h FROM r),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 + 1.0::DOUBLE AS w FROM h GROUP BY source),
c AS (SELECT *, {mixing.MAX_EPOCHS}::DOUBLE * source_size AS cap FROM s),
o AS (SELECT *, cap / w AS ratio, (SELECT sum(source_size)::DOUBLE FROM s) - coalesce(sum(cap) OVER p, 0) AS room, (SELECT sum(w) FROM s) - coalesce(sum(w) OVER p, 0) AS open FROM c WINDOW p AS (ORDER BY cap / w, source IS NULL, encode(source) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT *, (SELECT room / open FROM o WHERE room / open < ratio ORDER BY ratio, source IS NULL, encode(source) LIMIT 1) AS rate FROM o),
t AS (SELECT source, source_size, least(cap, coalesce(rate * w, cap)) AS target FROM q),
a AS (SELECT doc_id, size, source_size, target, coalesce(sum(size) OVER (PARTITION BY h.source ORDER BY h, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM h JOIN t ON h.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(greatest(0, least(size, round(target) - start)) + greatest(0, least(size, round(target) - start - source_size)) + greatest(0, least(size, round(target) - start - 2 * source_size)) AS BIGINT) AS taken FROM a"""

#: Windows of 8 words that occur again, the words inside them, and the rules of the cascade.
OP3 = f"""WITH w AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {quality.WINDOW - 2}), lambda i: md5(array_to_string(list_slice(w, i, i + {quality.WINDOW - 1}), ' ')))) AS g, unnest(range(1, len(w) - {quality.WINDOW - 2})) AS i FROM w WHERE len(w) >= {quality.WINDOW}),
k AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
d AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM k, range(0, {quality.WINDOW}) t(j) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT *, list_filter(string_split(text, chr(10)), lambda l: NOT {_NO_WORD}) AS lines FROM w),
b AS (SELECT doc_id, text, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(len(regexp_extract_all(text, '[{quality.SYMBOLS}]')) AS BIGINT) AS n_symbols, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM l LEFT JOIN d USING (doc_id)),
f AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed, len(regexp_extract_all(text, '\\p{{L}}')) AS letters, len(regexp_extract_all(text, '\\p{{Lu}}')) AS capitals, len(regexp_extract_all(text, '[!?]')) AS marks FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
NOT (base_failed OR n_symbols * 10 > n_words OR n_dup_lines * 2 > n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR capitals * 2 > letters OR marks * 2 > n_words OR letters * 4 < length(text)) AS kept FROM f"""

#: Every window of 100 bytes by a digest; those that start earlier elsewhere mark bytes; marks become spans, the rest is put together.
OP5 = f"""WITH d AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS x FROM documents),
v AS (SELECT doc_id, x, n, unnest(range(0, n - {_LAST}, {suffix_dedup.LENGTH})) AS base FROM d WHERE n > {_LAST}),
z AS (SELECT doc_id, n, base, substr(x, CAST(2 * base + 1 AS BIGINT), {2 * _HEX}) AS part FROM v),
u AS (SELECT doc_id, base, part, unnest(range(0, least({suffix_dedup.LENGTH}, n - {_LAST} - base))) AS r FROM z),
w AS (SELECT doc_id, base + r AS i, md5(substr(part, CAST(2 * r + 1 AS BIGINT), {_HEX})) AS g FROM u),
m AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
s AS (SELECT *, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {suffix_dedup.LENGTH} THEN 0 ELSE 1 END AS opens FROM m),
p AS (SELECT doc_id, min(i) AS a, max(i) + {suffix_dedup.LENGTH} AS b FROM (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM s) GROUP BY doc_id, k),
e AS (SELECT doc_id, a AS stop, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM p UNION ALL SELECT doc_id, n, coalesce((SELECT max(b) FROM p WHERE p.doc_id = d.doc_id), 0) FROM d),
j AS (SELECT doc_id, string_agg(substr(x, CAST(2 * start + 1 AS BIGINT), CAST(2 * (stop - start) AS BIGINT)), '' ORDER BY start) AS kept FROM e JOIN d USING (doc_id) GROUP BY doc_id),
c AS (SELECT doc_id, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM p GROUP BY doc_id)
SELECT d.doc_id, CAST(n AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM d JOIN j USING (doc_id) LEFT JOIN c USING (doc_id)"""

#: Sets of 4-word shingles, overlaps counted through shared shingles, and what can be reached by links.
OP6 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_SPLIT.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents),
g AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 4 THEN w ELSE list_slice(w, i, i + 3) END AS g FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM r WHERE a = doc_id), doc_id)) AS component_id FROM documents LEFT JOIN n USING (doc_id)"""


def _crc_table() -> str:
    """CRC-32 of single bytes as an SQL list, by the polynomial's rule."""

    def entry(c: int) -> int:
        for _ in range(8):
            c = c >> 1 ^ (0xEDB88320 if c & 1 else 0)
        return c

    return f"[{', '.join(str(entry(b)) for b in range(256))}]::BIGINT[]"


def _crc(hexed: str) -> str:
    """CRC-32 of bytes given in hexadecimal, byte by byte."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all({hexed}, '..'), lambda p: CAST('0x' || p AS BIGINT))), lambda a, b: xor(a >> 8, ({_crc_table()})[(xor(a, b) & 255) + 1])), 4294967295)"


#: Checksums of the texts; ranks within sources, then over all by fraction.
OP10 = f"""WITH d AS (SELECT doc_id, source, octet_length(encode(coalesce(text, ''))) + 1 AS size, hex(encode(coalesce(text, ''))) AS x FROM documents),
c AS (SELECT doc_id, source, size::BIGINT AS size, {_crc('x')} AS text_crc32 FROM d),
h AS (SELECT *, {_hash(sharding.SEED, 'doc_id', 'text_crc32')} AS h FROM c),
r AS (SELECT *, (row_number() OVER (PARTITION BY source ORDER BY h, doc_id, size, text_crc32) - 1 + 0.5::DOUBLE) / count(*) OVER (PARTITION BY source) AS spot FROM h),
p AS (SELECT *, row_number() OVER (ORDER BY spot, h, source NULLS FIRST, doc_id, size, text_crc32) - 1 AS position, count(*) OVER () AS n FROM r),
s AS (SELECT *, position * 16 // n AS shard FROM p)
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(shard AS INTEGER) AS shard, position - (shard * n + 15) // 16 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s"""

_LOW = f"translate(coalesce(text, ''), '{spelling.UPPER}', '{spelling.LOWER}')"

#: Words after the slips; those that leave the same string after a deletion; roots by following forms.
OP11 = f"""WITH RECURSIVE r AS (SELECT doc_id, unnest(regexp_extract_all({_LOW}, '[{spelling.LETTERS}]+')) AS run FROM documents),
u AS (SELECT doc_id, run, count(*) AS n FROM r WHERE length(run) >= {spelling.LEAST_CHARS} GROUP BY ALL),
h AS (SELECT run, n, {_crc("hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run))")} AS h FROM u),
d AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM d WHERE length(word) >= {spelling.LEAST_CHARS} GROUP BY word HAVING sum(n) >= {spelling.LEAST_COUNT}),
p AS (SELECT word, n, unnest(range(length(word))) AS i FROM w),
k AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM p),
e AS (SELECT a.word AS a, b.word AS b, b.n AS n FROM k a JOIN k b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
 UNION SELECT k.word, w.word, w.n FROM k JOIN w ON k.rest = w.word UNION SELECT w.word, k.word, k.n FROM k JOIN w ON k.rest = w.word),
b AS (SELECT a, b, n, row_number() OVER (PARTITION BY a ORDER BY n DESC, encode(b)) AS r, count(*) OVER (PARTITION BY a) AS n_near FROM e),
f AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= {spelling.TIMES} * w.n THEN b.b END AS form, CASE WHEN b.n >= {spelling.TIMES} * w.n THEN b.n END AS form_n FROM w LEFT JOIN b ON b.a = w.word AND b.r = 1),
t AS (SELECT word, word AS root, form AS up FROM f UNION ALL SELECT t.word, f.word, f.form FROM t JOIN f ON f.word = t.up)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN t ON t.word = f.word AND t.up IS NULL"""


def _template_rows() -> str:
    """Each template's words: its number, label, whether it is a base phrase, place, word, whether mandatory."""
    rows = []
    for t, template in enumerate(licenses.TEMPLATES):
        must = {p + j for p, key in template.mandatory() for j in range(len(key))}
        rows += [f"({t}, '{template.label}', {template.base}, {j}, '{w}', {j in must})" for j, w in enumerate(template.words)]
    return ", ".join(rows)


#: Every word of every template at every place of the texts; where all mandatory ones agree, the share by rarity.
OP13 = f"""WITH t(t, label, base, j, word, must) AS (VALUES {_template_rows()}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOW}, '{licenses.WORD}') AS w FROM documents),
u AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS i FROM d),
h AS (SELECT * FROM u WHERE word IN (SELECT word FROM t)),
n AS (SELECT word, count(DISTINCT r) AS n FROM h GROUP BY word),
x AS (SELECT t.*, ln(((SELECT count(*) FROM d) + 1) / (coalesce(n, 0) + 1)) + 1 AS x FROM t LEFT JOIN n USING (word)),
s AS (SELECT t, sum(x) AS total, count(*) FILTER (must) AS must FROM x GROUP BY t),
m AS (SELECT r, x.t, label, base, i - j AS start, sum(x) AS found, count(*) FILTER (must) AS musts FROM h JOIN x ON x.word = h.word GROUP BY ALL),
f AS (SELECT r, label, base, start, round(found / total, {licenses.PLACES}) AS score FROM m JOIN s USING (t) WHERE musts = must),
g AS (SELECT r, count(*) FILTER (base) AS n_base, min(start) FILTER (base) AS first_word, max(start) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base OR score >= {licenses.LEAST_SHARE}) AS labels, max(score) AS score FROM f GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score FROM d LEFT JOIN g USING (r)"""
