"""The operators in SQL, for those that SQL can express."""

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

LINES = r"""
WITH pages AS (
    SELECT row_number() OVER () AS page, doc_id, source, text, string_split(text, chr(10)) AS all_lines FROM documents
), each AS (
    SELECT page, doc_id, source, text, unnest(all_lines) AS line, generate_subscripts(all_lines, 1) AS at FROM pages
), bare AS (
    SELECT *, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS trimmed FROM each
), totals AS (
    SELECT source, count(*) AS host_pages FROM documents GROUP BY source
), counted AS (
    SELECT source, trimmed, count(DISTINCT page) AS pages,
           CASE WHEN len(regexp_extract_all(trimmed, '[^\x20\x09-\x0D]+')) >= 8 THEN count(DISTINCT text) ELSE 0 END AS texts
    FROM bare WHERE trimmed <> '' GROUP BY source, trimmed
), dropped AS (
    SELECT c.source, c.trimmed FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
    WHERE c.pages >= 5 AND (c.pages > 0.2 * t.host_pages OR (c.texts >= 5 AND c.texts > 0.01 * t.host_pages))
), kept AS (
    SELECT b.page, string_agg(b.line, chr(10) ORDER BY b.at) FILTER (WHERE d.trimmed IS NULL) AS text,
           count(*) AS n_lines, count(d.trimmed) AS n_dropped
    FROM bare b LEFT JOIN dropped d ON b.source IS NOT DISTINCT FROM d.source AND b.trimmed = d.trimmed
    GROUP BY b.page
)
SELECT p.doc_id, CASE WHEN p.all_lines IS NULL THEN NULL ELSE coalesce(k.text, '') END AS text,
       coalesce(k.n_lines, 0)::BIGINT AS n_lines, coalesce(k.n_dropped, 0)::BIGINT AS n_dropped
FROM pages p LEFT JOIN kept k ON p.page = k.page
"""

WINDOWS = f"""
WITH docs AS (
    SELECT row_number() OVER () AS n, doc_id,
           regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ITEM_WORD}') AS words
    FROM documents
), items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{ITEM_WORD}') AS words
    FROM benchmark
), grams AS (
    SELECT DISTINCT item_id, least(len(words), 10) AS size,
           unnest([array_to_string(words[i:i + least(len(words), 10) - 1], ' ')
                   FOR i IN range(1, len(words) - least(len(words), 10) + 2)]) AS gram
    FROM items WHERE len(words) > 0
), sizes AS (
    SELECT DISTINCT size FROM grams
), windows AS (
    SELECT n, size, pos, array_to_string(words[pos:pos + size - 1], ' ') AS gram
    FROM (SELECT n, words, size, unnest(range(1, len(words) - size + 2)) AS pos FROM docs, sizes WHERE len(words) >= size)
), hits AS (
    SELECT w.n, w.pos, w.size, g.item_id FROM windows w JOIN grams g ON w.gram = g.gram AND w.size = g.size
), covered AS (
    SELECT n, count(DISTINCT word) AS n_hit
    FROM (SELECT n, unnest(range(pos, pos + size)) AS word FROM (SELECT DISTINCT n, pos, size FROM hits)) GROUP BY n
), named AS (
    SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
    FROM (SELECT DISTINCT n, CAST(item_id AS VARCHAR) AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY n
)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit,
       coalesce(i.n_items, 0)::BIGINT AS n_items, sha256(coalesce(i.items, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.n = c.n LEFT JOIN named i ON d.n = i.n
"""

VARIANTS = f"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(
        range(8), lambda c, step: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS steps
), runs AS (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{{7,}}')), '{UPPER}', '{LOWER}') AS run
    FROM documents
), keyed AS (
    SELECT id, run, count(*) AS n, flatten(list_transform(list_transform(string_split(id || ':' || run, ''), lambda c: ord(c)),
           lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 | (c >> 6), 128 | (c & 63)] END))::BIGINT[] AS bytes
    FROM runs GROUP BY id, run
), hashed AS (
    SELECT run, n, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, steps[xor(c & 255, b) + 1]), 4294967295), 4294967295) AS h
    FROM keyed, crc
), typed AS (
    SELECT n, CASE WHEN h % 31 = 0 THEN run[:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word FROM hashed
), words AS (
    SELECT word, sum(n)::BIGINT AS n FROM typed WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), places AS (
    SELECT word, unnest(range(1, length(word) + 1)) AS pos FROM words
), shorter AS (
    SELECT word, pos, word[:pos - 1] || word[pos + 1:] AS rest FROM places
), replaced AS (
    SELECT a.word, b.word AS other FROM shorter a JOIN shorter b ON a.pos = b.pos AND a.rest = b.rest AND a.word <> b.word
), left_out AS (
    SELECT DISTINCT s.word, w.word AS other FROM shorter s JOIN words w ON s.rest = w.word
), near AS (
    SELECT * FROM replaced UNION ALL SELECT * FROM left_out UNION ALL SELECT other, word FROM left_out
), ordered AS (
    SELECT x.word, x.other, o.n AS other_n, count(*) OVER (PARTITION BY x.word) AS n_near,
           row_number() OVER (PARTITION BY x.word ORDER BY o.n DESC, x.other) AS place
    FROM near x JOIN words o ON x.other = o.word
), formed AS (
    SELECT w.word, w.n, coalesce(o.n_near, 0) AS n_near,
           CASE WHEN o.other_n >= 10 * w.n THEN o.other END AS form, CASE WHEN o.other_n >= 10 * w.n THEN o.other_n END AS form_n
    FROM words w LEFT JOIN ordered o ON w.word = o.word AND o.place = 1
), ways AS (
    SELECT word, word AS last FROM formed
    UNION ALL
    SELECT y.word, f.form FROM ways y JOIN formed f ON y.last = f.word WHERE f.form IS NOT NULL
)
SELECT f.word, f.form, y.last AS root, f.n, f.n_near, f.form_n
FROM formed f JOIN ways y ON f.word = y.word JOIN formed e ON y.last = e.word AND e.form IS NULL
"""

PHRASES = rf"""
WITH cut AS (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), pieces AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM cut
), starts AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS pos FROM pieces
), counts AS (
    SELECT lang, array_to_string(words[pos:pos + k - 1], ' ') AS phrase, k, count(*) AS f
    FROM starts, (VALUES (1), (2), (3), (4), (5)) sizes(k) WHERE pos + k - 1 <= len(words) GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE k = 1 GROUP BY lang
), candidates AS (
    SELECT lang, phrase, k, f AS a, string_split(phrase, ' ') AS words FROM counts WHERE k > 1 AND f >= 100
), inner_parts AS (
    SELECT lang, k, a, words, unnest(range(1, k)) AS first FROM candidates WHERE k > 2
), covering AS (
    SELECT lang, array_to_string(words[first:last], ' ') AS phrase, max(a) AS longer
    FROM (SELECT lang, k, a, words, first, unnest(range(first + 1, k + 1)) AS last FROM inner_parts)
    WHERE last - first + 1 < k GROUP BY 1, 2
), kept AS (
    SELECT c.* FROM candidates c LEFT JOIN covering v ON c.lang = v.lang AND c.phrase = v.phrase
    WHERE v.longer IS NULL OR 100 * v.longer < 100 * c.a
), cuts AS (
    SELECT lang, phrase, a, pos, array_to_string(words[:pos], ' ') AS head, array_to_string(words[pos + 1:], ' ') AS tail
    FROM (SELECT *, unnest(range(1, k)) AS pos FROM kept)
), scored AS (
    SELECT x.lang, x.phrase, x.a, x.pos, h.f AS l, t.f AS r, n.n,
           ((1000::HUGEINT * x.a::HUGEINT * n.n::HUGEINT) // (h.f::HUGEINT * t.f::HUGEINT))::BIGINT AS score
    FROM cuts x JOIN counts h ON x.lang = h.lang AND x.head = h.phrase
    JOIN counts t ON x.lang = t.lang AND x.tail = t.phrase JOIN totals n ON x.lang = n.lang
), lowest AS (
    SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, pos) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM lowest QUALIFY rank <= 2000
"""
