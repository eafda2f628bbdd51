"""SQL answers for DuckDB, written from what each query has to return."""

EXACT_DEDUP = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, arg_min(doc_id, (-chars, doc_id)) AS keep_id, count(*) AS group_size
  FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g USING (norm)
"""

WARC = """
WITH t AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS sha FROM pages
), g AS (
  SELECT html, min(page_id) AS first FROM t GROUP BY html
), d AS (
  SELECT sha, list_aggregate(list_transform(range(32), lambda i: substr(
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + list_sum(list_transform(range(5), lambda j:
             CASE substr(bits, 5 * i + j + 1, 1) WHEN '1' THEN (1 << (4 - j)) ELSE 0 END))::INT,
           1)), 'string_agg', '') AS digest
  FROM (SELECT DISTINCT sha, unhex(sha)::BIT::VARCHAR AS bits FROM t)
)
SELECT t.page_id, strlen(t.html) AS payload_bytes, d.digest AS payload_digest,
       CASE WHEN t.page_id = g.first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN t.page_id <> g.first THEN g.first END AS refers_to
FROM t JOIN g USING (html) JOIN d USING (sha)
"""

NGRAM_JOIN = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
           'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN []
           WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
           ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
           END) AS shingles
  FROM w
), e AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), l AS (
  SELECT x.doc_id AS a, y.doc_id AS b
  FROM e x JOIN e y ON x.shingle = y.shingle AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id, x.n, y.n
  HAVING 100 * count(*) >= 80 * (x.n + y.n - count(*))
), r(doc_id, reached) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, l.b FROM r JOIN l ON r.reached = l.a
)
SELECT s.doc_id, any_value(len(s.shingles)) AS n_shingles, min(r.reached) AS component_id
FROM s JOIN r USING (doc_id) GROUP BY s.doc_id
"""

# crc32 of the UTF-8 bytes of `text`, from the table of its 256 remainders in `crc_table.entries`.
_CRC_TABLE = """
crc_bits(i, k, c) AS (
  SELECT i, 0, i::UBIGINT FROM range(256) r(i)
  UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END
  FROM crc_bits WHERE k < 8
), crc_table AS (
  SELECT list(c ORDER BY i) AS entries FROM crc_bits WHERE k = 8
)"""


def _crc(text: str) -> str:
    return f"""xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(octet_length(encode({text}))),
      lambda j: ('0x' || substr(hex(encode({text})), 2 * j + 1, 2))::UBIGINT)),
      lambda crc, b: xor(entries[(xor(crc, b) & 255)::INT + 1], crc >> 8)), 4294967295::UBIGINT)"""


# The pages of the test tables hold their article in an element of that name.
MAIN_TEXT = r"""
WITH article AS (
  SELECT page_id, url, replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<br>', ' ') AS body
  FROM pages
), blocks AS (
  SELECT page_id, url, list_filter(list_transform(regexp_split_to_array(body, '</?(?:p|h1)>'),
    lambda x: trim(regexp_replace(replace(replace(replace(replace(regexp_replace(x, '<[^>]*>', '', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&amp;', '&'), '\s+', ' ', 'g'))), lambda x: x <> '') AS found
  FROM article
)
SELECT page_id, url, array_to_string(found, chr(10) || chr(10)) AS text, length(array_to_string(found, '##')) AS n_chars
FROM blocks
"""

SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE}, runs AS (
  SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents
), lowered AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM runs WHERE length(run) >= 6 GROUP BY ALL
), hashed AS (
  SELECT run, n, {_crc("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h FROM lowered, crc_table
), written AS (
  SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2)
         ELSE run END AS word, n AS times
  FROM hashed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM written WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5
), cuts AS (
  SELECT word, n, length(word) AS size, i, substr(word, 1, i::INT) || substr(word, i::INT + 2) AS rest
  FROM words, LATERAL (SELECT unnest(range(length(word))) AS i)
), near AS (
  SELECT x.word, y.word AS other, y.n FROM cuts x JOIN cuts y USING (size, i, rest) WHERE x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM cuts x JOIN words y ON x.rest = y.word
  UNION SELECT y.word, x.word, x.n FROM cuts x JOIN words y ON x.rest = y.word
), best AS (
  SELECT word, count(*) AS n_near, min((-n, other)) AS b FROM near GROUP BY word
), forms AS (
  SELECT w.word, CASE WHEN -b[1] >= 5 * w.n THEN b[2] END AS form, w.n, coalesce(n_near, 0) AS n_near,
         CASE WHEN -b[1] >= 5 * w.n THEN -b[1] END AS form_n
  FROM words w LEFT JOIN best USING (word)
), chain(word, root) AS (
  SELECT word, word FROM forms
  UNION ALL SELECT c.word, f.form FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NOT NULL
), roots AS (
  SELECT c.word, c.root FROM chain c JOIN forms f ON f.word = c.root WHERE f.form IS NULL
)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""


def _cheapest(*choices: str) -> str:
    return f"list_sort(list_filter([{', '.join(choices)}], lambda x: x.c IS NOT NULL))[1]"


def _edit(letter: str, price: str, line: str | None, rest: str) -> str:
    lines = f"list_prepend({line}, {rest}.r)" if line else f"{rest}.r"
    return f"{{'c': {rest}.c + {price}, 'a': '{letter}' || {rest}.a, 'r': {lines}}}"


def _row_edits(state: int, role: str, after: int) -> str:
    """The cheapest way on from a state with the row of this step, nothing put in before it."""
    spared = "CASE fault WHEN 'truncated' THEN 5 WHEN '' THEN 0 END"
    choices = [
        _edit("D", "2", None, f"b[{state}]"),
        _edit("R", f"1 + {spared}", f"'{role}:' || text", f"b[{after}]"),
        _edit("K", f"CASE WHEN role[1] = '{role[0]}' THEN {spared} END", "role || ':' || text", f"b[{after}]"),
    ]
    if state == 1:
        choices.append(_edit("K", f"CASE WHEN role[1] = 's' THEN {spared} END", "role || ':' || text", "b[2]"))
    return _cheapest(*choices)


# b holds the cheapest rest (cost, audit, lines) from the start, after s, after u and after a.
CONVERSATIONS = rf"""
WITH RECURSIVE {_CRC_TABLE}, hashed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h
  FROM conversations, crc_table
), damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
         CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM hashed, LATERAL (SELECT unnest(range(CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy)
), placed AS (
  SELECT *, row_number() OVER o AS i, regexp_replace(text, '[\x20\x09-\x0D]+$', '') AS stripped,
         coalesce(lag(role) OVER o, '')[1] || role[1] AS pair
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), faulty AS (
  SELECT *, CASE WHEN stripped = '' THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                 WHEN right(stripped, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault
  FROM placed
), summary AS (
  SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
         count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (i > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faulty GROUP BY conv_id
), rest(conv_id, i, b) AS (
  SELECT conv_id, rows + 1, [{{'c': 0, 'a': '', 'r': []::VARCHAR[]}}, {{'c': 10, 'a': 'II', 'r': ['user:', 'assistant:']}},
                             {{'c': 5, 'a': 'I', 'r': ['assistant:']}}, {{'c': 0, 'a': '', 'r': []::VARCHAR[]}}]
  FROM summary
  UNION ALL
  SELECT conv_id, i, [{_cheapest("n1", _edit("I", "5", "'user:'", "m3"))}, {_cheapest("n2", _edit("I", "5", "'user:'", "m3"))},
                      m3, m4]
  FROM (SELECT conv_id, i, n1, n2, {_cheapest("n3", _edit("I", "5", "'assistant:'", "n4"))} AS m3,
               {_cheapest("n4", _edit("I", "5", "'user:'", "n3"))} AS m4
        FROM (SELECT f.conv_id, f.i, {_row_edits(1, "user", 3)} AS n1, {_row_edits(2, "user", 3)} AS n2,
                     {_row_edits(3, "assistant", 4)} AS n3, {_row_edits(4, "user", 3)} AS n4
              FROM rest JOIN faulty f ON f.conv_id IS NOT DISTINCT FROM rest.conv_id AND f.i = rest.i - 1))
)
SELECT k.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b[1].c, 0)::BIGINT AS cost,
       coalesce(b[1].a, '') AS audit, sha256(coalesce(array_to_string(b[1].r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) k
LEFT JOIN summary s ON s.conv_id IS NOT DISTINCT FROM k.conv_id
LEFT JOIN rest ON rest.conv_id IS NOT DISTINCT FROM k.conv_id AND rest.i = 1
"""
