"""SQL twins of the operators that SQL can express, over the whole documents table."""

from __future__ import annotations

WORD = "[^\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The reflected polynomial of the checksum.
POLYNOMIAL = 0xEDB88320

SHARDS = f"""WITH codes AS (
  SELECT list(code ORDER BY b) AS codes FROM (
    SELECT b, list_reduce(list_concat([b], range(8)),
      lambda c, k: xor(c >> 1, {POLYNOMIAL} * (c & 1))) AS code
    FROM (SELECT unnest(range(256)) AS b))),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 16 AS size,
    list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'),
                   lambda h: ('0x' || h)::BIGINT) AS bytes
  FROM documents),
summed AS (
  SELECT doc_id, size, xor(4294967295, list_reduce(list_concat([4294967295], bytes),
      lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1]))) AS text_crc32,
    sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS total
  FROM sized, codes),
placed AS (
  SELECT *, least((2 * upto - size) * 40 // (2 * total), 39)::INT AS shard FROM summed)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, NULL::INT AS grown_shard
FROM placed"""

QUALITY = f"""WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents),
placed AS (
  SELECT doc_id, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
windows AS (
  SELECT doc_id, i, w = lag(w) OVER p AS stutter,
    CASE WHEN lead(w, 4) OVER p IS NOT NULL THEN
      [w, lead(w) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p, lead(w, 4) OVER p] END AS g
  FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
twice AS (
  SELECT doc_id, i FROM windows WHERE g IS NOT NULL
  QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, range(5) AS r(d) GROUP BY doc_id),
stutters AS (SELECT doc_id, count(*) FILTER (WHERE stutter) AS n FROM windows GROUP BY doc_id),
measured AS (
  SELECT s.doc_id, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words,
    len(lines) AS n_lines, coalesce(t.n, 0) AS n_stutter
  FROM split s LEFT JOIN covered c USING (doc_id) LEFT JOIN stutters t USING (doc_id)),
failing AS (
  SELECT *, (n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT
    + 4 * (10 * n_symbols > n_words)::INT + 8 * (10 * n_stutter > 3 * n_words)::INT
    + 16 * (100 * n_dup_lines > 30 * n_lines)::INT + 32 * (2 * word_chars < 5 * n_words)::INT
    + 64 * (word_chars > 15 * n_words)::INT AS failed
  FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  failed & 3 <> 0 AS base_failed, failed & 15 = 0 AS kept, failed, n_lines, n_stutter
FROM failing"""

JACCARD = f"""WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS words
  FROM documents),
placed AS (
  SELECT doc_id, len(words) AS n, unnest(words) AS w, generate_subscripts(words, 1) AS i FROM split),
shingled AS (
  SELECT doc_id, concat_ws(' ', w, lead(w) OVER p, lead(w, 2) OVER p, lead(w, 3) OVER p) AS shingle
  FROM placed WINDOW p AS (PARTITION BY doc_id ORDER BY i)
  QUALIFY i = 1 OR i <= n - 3),
sets AS (
  SELECT doc_id, list_sort(list_distinct(coalesce(shingles, []))) AS shingles
  FROM split LEFT JOIN (SELECT doc_id, list(shingle) AS shingles FROM shingled GROUP BY doc_id) USING (doc_id)),
classes AS (
  SELECT min(doc_id) AS least, len(shingles) AS n, shingles FROM sets WHERE len(shingles) > 0 GROUP BY shingles),
items AS (SELECT least, n, unnest(shingles) AS shingle FROM classes),
links AS (
  SELECT a.least AS a, b.least AS b FROM items a JOIN items b ON a.shingle = b.shingle AND a.least <> b.least
  GROUP BY a.least, b.least, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reached AS (
  SELECT least AS node, least AS other FROM classes
  UNION SELECT r.node, l.b FROM reached r JOIN links l ON r.other = l.a),
roots AS (SELECT node, min(other) AS component_id FROM reached GROUP BY node)
SELECT s.doc_id, len(s.shingles) AS n_shingles, coalesce(r.component_id, s.doc_id) AS component_id
FROM sets s LEFT JOIN classes c ON c.shingles = s.shingles LEFT JOIN roots r ON r.node = c.least"""

MIXING = f"""WITH told AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines
  FROM documents),
keyed AS (
  SELECT doc_id, source, size, -ln((('0x' || left(md5('11:' || coalesce(doc_id::VARCHAR, '') || ':' || text), 13))::BIGINT
      + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
    / (greatest(size, 1)::DOUBLE / (greatest(size, 1) + 4 * length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))
       + 8 * (len(lines) - len(list_distinct(lines))))::DOUBLE) AS key
  FROM told),
sources AS (
  SELECT source, sum(size) AS size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM keyed GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][((place - 1) % 3 + 1)::INT]::HUGEINT AS weight FROM sources),
summed AS (
  SELECT *, sum(size) OVER () AS everything, sum(3 * size) OVER (o ROWS UNBOUNDED PRECEDING) - 3 * size AS filled,
    sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS waiting
  FROM weighed WINDOW o AS (ORDER BY size::DOUBLE / weight::DOUBLE, place)),
decided AS (SELECT *, 3 * size * waiting + weight * filled <= weight * everything AS is_full FROM summed),
targets AS (
  SELECT source, size AS source_size, CASE WHEN is_full THEN (3 * size)::DOUBLE ELSE
    (everything - coalesce(sum(3 * size) FILTER (WHERE is_full) OVER (), 0))::DOUBLE * weight::DOUBLE
    / (sum(weight) FILTER (WHERE NOT is_full) OVER ())::DOUBLE END AS target
  FROM decided),
placed AS (
  SELECT k.doc_id, k.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size::DOUBLE) ELSE 0 END AS whole,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS FIRST, k.size ROWS UNBOUNDED PRECEDING) AS upto
  FROM keyed k JOIN targets t ON k.source IS NOT DISTINCT FROM t.source),
counted AS (
  SELECT *, (whole + (2 * upto - size < 2 * (target - whole * source_size))::INT)::BIGINT AS times FROM placed)
SELECT doc_id, size, source_size::BIGINT AS source_size, target, (size * times)::BIGINT AS taken,
  CASE WHEN size > 0 THEN times ELSE 0 END AS epochs
FROM counted"""

TERM = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
SEARCH = f"""WITH words AS (
  SELECT row_number() OVER () AS row, doc_id,
    regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS words
  FROM documents),
sized AS (SELECT row, doc_id, words, len(words)::BIGINT AS n FROM words WHERE len(words) > 0),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS everything FROM sized),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term
  FROM benchmark),
single AS (SELECT row, doc_id, n, unnest(words) AS term FROM sized),
counted AS (
  SELECT row, doc_id, n, term, count(*)::BIGINT AS tf FROM single
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
  FROM counted, totals GROUP BY term, docs),
scored AS (
  SELECT item_id, row, doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // everything))))::BIGINT AS score
  FROM counted JOIN weights USING (term) JOIN asked USING (term), totals GROUP BY item_id, row, doc_id)
SELECT item_id, (row_number() OVER o)::INT AS rank, doc_id, score FROM scored WHERE score > 0
WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)
QUALIFY row_number() OVER o <= 50"""

SPELLING = f"""WITH RECURSIVE codes AS (
  SELECT list(code ORDER BY b) AS codes FROM (
    SELECT b, list_reduce(list_concat([b], range(8)),
      lambda c, k: xor(c >> 1, {POLYNOMIAL} * (c & 1))) AS code
    FROM (SELECT unnest(range(256)) AS b))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) AS run
  FROM documents),
grouped AS (SELECT doc_id, run, count(*) AS times FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, times, xor(4294967295, list_reduce(list_concat([4294967295],
      list_transform(regexp_extract_all(hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)), '..'),
        lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, codes[(xor(c, b) & 255) + 1]))) AS h
  FROM grouped, codes),
written AS (
  SELECT times, CASE WHEN h % 199 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
    ELSE run END AS word
  FROM hashed),
words AS (
  SELECT word, sum(times)::BIGINT AS n FROM written WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
shorter AS (
  SELECT word, i, left(word, i - 1) || substr(word, i + 1) AS rest
  FROM (SELECT word, unnest(range(1, length(word) + 1))::INT AS i FROM words)),
near AS (
  SELECT a.word, b.word AS other FROM shorter a JOIN shorter b
    ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word AND length(a.word) = length(b.word)
  UNION SELECT s.word, w.word FROM shorter s JOIN words w ON s.rest = w.word
  UNION SELECT w.word, s.word FROM shorter s JOIN words w ON s.rest = w.word),
best AS (
  SELECT e.word, w.word AS form, w.n AS form_n, count(*) OVER (PARTITION BY e.word) AS n_near
  FROM near e JOIN words w ON w.word = e.other
  QUALIFY row_number() OVER (PARTITION BY e.word ORDER BY w.n DESC, w.word) = 1),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 5 * w.n THEN form END AS form,
    CASE WHEN form_n >= 5 * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best USING (word)),
walked AS (
  SELECT word, word AS node, 0 AS step FROM formed
  UNION ALL SELECT k.word, f.form, step + 1 FROM walked k JOIN formed f ON k.node = f.word WHERE f.form IS NOT NULL)
SELECT f.word, form, root, n, n_near::BIGINT AS n_near, form_n
FROM formed f JOIN (SELECT word, arg_max(node, step) AS root FROM walked GROUP BY word) USING (word)"""

ORACLE = {
    "op1_sharding": SHARDS, "op3_quality": QUALITY, "op4_jaccard": JACCARD,
    "op11_mixing": MIXING, "op12_search": SEARCH, "op13_spelling": SPELLING,
}
