"""DuckDB statements for the operators that SQL can express."""

SQL_DECONTAMINATE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
starts AS (
  SELECT item_id, words, least(len(words), 10) AS size, unnest(range(1, greatest(len(words) - 8, 2))) AS i
  FROM items WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, size, array_to_string(words[i:i + size - 1], ' ') AS gram FROM starts),
sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM docs, sizes WHERE len(words) >= size),
grams AS (SELECT rid, size, i, array_to_string(words[i:i + size - 1], ' ') AS gram FROM places),
hits AS (SELECT rid, size, i, item_id FROM grams JOIN windows USING (size, gram)),
hit_places AS (SELECT DISTINCT rid, size, i FROM hits),
hit_words AS (SELECT DISTINCT rid, unnest(range(i, i + size)) AS w FROM hit_places),
n_hit AS (SELECT rid, count(*) AS n FROM hit_words GROUP BY rid),
met AS (
  SELECT rid, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(met.n, 0) AS BIGINT) AS n_items, sha256(coalesce(met.ids, '')) AS items_sha256,
       coalesce(n_hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN n_hit USING (rid) LEFT JOIN met USING (rid)
"""

SQL_CHAT = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
escaped AS (
  SELECT *, regexp_replace(text, '([\[<])(\\*)(/?INST\]|ROLE [A-Za-z0-9+/=]*\]|/ROLE\]|/?s>|<SYS>>|</SYS>>)',
                           '\1\\\2\3', 'g') AS body,
         CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 WHEN 'system' THEN 17
              ELSE 16 + length(base64(encode(role))) END AS marks
  FROM turns)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(body) + marks) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id
"""

SQL_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents),
found AS (
  SELECT lang, source, rid, term, count(*) AS n
  FROM (SELECT lang, source, rid, unnest(words) AS term FROM docs) GROUP BY ALL),
kept AS (SELECT lang, term, CAST(sum(n) AS HUGEINT) AS n FROM found GROUP BY lang, term HAVING count(*) >= 3),
groups AS (SELECT DISTINCT lang, source FROM docs),
grid AS (
  SELECT groups.lang, groups.source, kept.term, CAST(coalesce(c.n, 0) AS HUGEINT) AS n
  FROM groups JOIN kept USING (lang)
  LEFT JOIN (SELECT lang, source, term, sum(n) AS n FROM found GROUP BY ALL) c
    ON c.lang = groups.lang AND c.source = groups.source AND c.term = kept.term),
shares AS (
  SELECT lang, source, term, n, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER g + count(*) OVER g)::HUGEINT AS p
  FROM grid WINDOW g AS (PARTITION BY lang, source)),
whole AS (
  SELECT lang, term, 1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER l + count(*) OVER l)::HUGEINT AS q
  FROM kept WINDOW l AS (PARTITION BY lang)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT)
  FROM shares JOIN whole USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value,
       CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM every QUALIFY part = 'pair' OR rank <= 200
"""

SQL_FILTERS = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
firsts AS (SELECT text, min(doc_id) AS doc_id FROM docs GROUP BY text),
marks AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
verdicts AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CASE WHEN len(words) < 100 THEN 'A' ELSE '' END
         || CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END
         || CASE WHEN 100 * length(regexp_replace(docs.text, '[^A-Z]', '', 'g')) > 10 * length(docs.text) THEN 'C' ELSE '' END
         || CASE WHEN regexp_matches(docs.text, '[#$%&*|]') THEN 'D' ELSE '' END
         || CASE WHEN docs.doc_id > firsts.doc_id THEN 'E' ELSE '' END AS fails
  FROM docs JOIN firsts USING (text) LEFT JOIN marks ON marks.doc_id = docs.doc_id),
counts AS (
  SELECT part, fails, count(*) AS n, count(*) FILTER (WHERE good) AS good, count(*) FILTER (WHERE toxic) AS toxic
  FROM verdicts GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order
  FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM orders),
met AS (
  SELECT part, filter_order, step, n, good, toxic, contains(fails, filter_order[step]) AS failed,
         length(translate(fails, filter_order[1:step - 1], '')) < length(fails) AS gone,
         fails = filter_order[step] AS lone
  FROM counts, steps),
rows AS (
  SELECT part, filter_order, step,
         coalesce(sum(n) FILTER (WHERE NOT gone AND NOT failed), 0) AS kept,
         coalesce(sum(n) FILTER (WHERE NOT gone AND failed), 0) AS removed,
         coalesce(sum(n) FILTER (WHERE gone AND failed), 0) AS redundant,
         coalesce(sum(n) FILTER (WHERE lone), 0) AS unique_fails,
         coalesce(sum(good) FILTER (WHERE NOT gone AND failed), 0) AS good_lost,
         coalesce(sum(toxic) FILTER (WHERE NOT gone AND failed), 0) AS toxic_lost
  FROM met GROUP BY part, filter_order, step)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept,
       CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
       CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, filter_order[step]) AS BIGINT) AS shapley
FROM rows
"""
