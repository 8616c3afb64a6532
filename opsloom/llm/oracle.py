"""SQL of the corpus queries where SQL can express them over whole tables."""

from __future__ import annotations

ORACLE: dict[str, str] = {}

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# The table of the CRC-32 of one byte, and the checksum of texts given in hexadecimal as x.
_CRC_TABLE = """code AS (SELECT list(c ORDER BY b) AS t FROM (SELECT b, list_reduce(range(0, 8),
           lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, b) AS c
         FROM (SELECT unnest(range(0, 256)) AS b)))"""
_CRC = """xor(4294967295, list_reduce(list_transform(range(0, len(x) // 2), lambda i:
             16 * (instr('0123456789ABCDEF', x[2 * i + 1]) - 1) + instr('0123456789ABCDEF', x[2 * i + 2]) - 1),
             lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), 4294967295))"""

ORACLE["op4_decontamination"] = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM documents),
b AS (SELECT item_id, w, least(13, len(w)) AS n
      FROM (SELECT item_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM benchmark) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS gram
       FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)),
sizes AS (SELECT DISTINCT n FROM b),
dw AS (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
       FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, n, i, item_id FROM dw JOIN bw USING (n, gram)),
word AS (SELECT doc_id, count(DISTINCT p) AS n_hit
         FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
         FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hit) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN word USING (doc_id) LEFT JOIN item USING (doc_id)
"""

ORACLE["op2_line_dedup"] = """
WITH lines AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line,
                      generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
filled AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq
           FROM lines WHERE trim(line, ' ') <> ''),
starts AS (SELECT a.doc_id, a.seq, row_number() OVER (PARTITION BY a.line, b.line ORDER BY a.doc_id, a.seq) AS copy
           FROM filled a JOIN filled b ON a.doc_id = b.doc_id AND b.seq = a.seq + 1),
gone AS (SELECT DISTINCT doc_id, unnest([seq, seq + 1]) AS seq FROM starts WHERE copy > 1),
marked AS (SELECT l.doc_id, l.i, l.line, f.seq, g.seq IS NOT NULL AS removed
           FROM lines l LEFT JOIN filled f ON l.doc_id = f.doc_id AND l.i = f.i
           LEFT JOIN gone g ON g.doc_id = f.doc_id AND g.seq = f.seq)
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT removed), '') AS text,
       count(seq) AS n_lines, count(*) FILTER (WHERE removed) AS n_removed
FROM marked GROUP BY doc_id
"""

# SHA-1 in hexadecimal, read as 32 groups of 5 bits.
ORACLE["op9_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, strlen(html) AS payload_bytes, sha1(html) AS hex FROM p),
bits AS (SELECT DISTINCT hex, array_to_string(list_transform(range(1, 41),
           lambda i: lpad(bin(instr('0123456789abcdef', substr(hex, i, 1)) - 1), 4, '0')), '') AS b FROM h),
code AS (SELECT hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + CAST(list_sum(list_transform(range(0, 5),
             lambda j: CAST(substr(b, 5 * i + j + 1, 1) AS INT) * (16 >> j))) AS INT), 1)), '') AS payload_digest FROM bits),
r AS (SELECT h.page_id, payload_bytes, payload_digest,
             max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM h JOIN code USING (hex))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> original THEN original END AS refers_to, true AS intact FROM r
"""

ORACLE["op11_resampling"] = f"""
WITH {_CRC_TABLE},
words AS (SELECT 's' AS side, doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w, row_number() OVER () AS k FROM documents
          UNION ALL SELECT 't', NULL, regexp_extract_all({_FOLD}, '{_WORD}'), NULL FROM benchmark),
features AS (SELECT side, k, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
counted AS (SELECT side, k, f, count(*) AS n FROM features GROUP BY ALL),
hex AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM counted)),
bucket AS (SELECT f, {_CRC} % 10000 AS b FROM hex, code),
sums AS (SELECT b, coalesce(sum(n) FILTER (side = 's'), 0) AS s, coalesce(sum(n) FILTER (side = 't'), 0) AS t
         FROM counted JOIN bucket USING (f) GROUP BY b),
gain AS (SELECT b, CAST(floor(1000 * ln(CAST((t + 1) * (sum(s) OVER () + 10000) AS DOUBLE)
                                      / CAST((s + 1) * (sum(t) OVER () + 10000) AS DOUBLE))) AS BIGINT) AS g FROM sums),
total AS (SELECT k, sum(n * g) AS g, sum(n) AS n FROM counted JOIN bucket USING (f) JOIN gain USING (b)
          WHERE side = 's' GROUP BY k),
scored AS (SELECT doc_id, len(w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features,
                  CAST(coalesce((g - ((g % n) + n) % n) // n, 0) AS BIGINT) AS weight,
                  CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h
           FROM words LEFT JOIN total USING (k) WHERE side = 's'),
final AS (SELECT doc_id, n_words, n_features, weight,
                 weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM scored),
ranked AS (SELECT *, row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id NULLS LAST) AS r,
                  count(*) FILTER (n_words >= 20) OVER () * 25 // 100 AS wanted FROM final)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= wanted THEN r END AS rank FROM ranked
"""


def _repair_sql() -> str:
    """Forwards: the cheapest edits up to each turn by state, with audit and repaired text, the least of them kept."""
    none = "{'c': 1000000000, 'a': '', 'r': ''}"

    def edit(state: int, cost: str, letter: str, line: str = "''", of: str = "f") -> str:
        return f"{{'c': {of}[{state + 1}].c + {cost}, 'a': {of}[{state + 1}].a || '{letter}', 'r': {of}[{state + 1}].r || {line}}}"

    def least(*options: str) -> str:
        return f"list_sort([{', '.join(options)}])[1]"

    due = ("user", "user", "assistant", "user")

    def inserts(of: str) -> str:
        user, both = "chr(10) || 'user:'", "chr(10) || 'user:' || chr(10) || 'assistant:'"
        return f"""[{of}[1], {of}[2],
          {least(f"{of}[3]", *[edit(q, "3", "I", user, of) for q in (0, 1, 3)])},
          {least(f"{of}[4]", edit(2, "3", "I", "chr(10) || 'assistant:'", of), *[edit(q, "6", "II", both, of) for q in (0, 1)])}]"""

    def arrive(state: int, before: dict[int, str], rerole: tuple[int, ...]) -> str:
        options = [edit(state, "4", "D")]
        for q, initial in before.items():
            kept = edit(q, "extra", "K", "chr(10) || role || ':' || text")
            options.append(f"CASE WHEN initial = '{initial}' AND NOT fixed THEN {kept} ELSE {none} END")
        for q in rerole:
            changed = edit(q, "3 + extra", "R", f"chr(10) || '{due[q]}:' || text")
            options.append(f"CASE WHEN NOT fixed THEN {changed} ELSE {none} END")
        return least(*options)

    step = (arrive(0, {}, ()), arrive(1, {0: "s"}, ()), arrive(2, {0: "u", 1: "u", 3: "u"}, (0, 1, 3)), arrive(3, {2: "a"}, (2,)))
    blank = r"[ \t\n\x0b\x0c\r]"
    return f"""
WITH RECURSIVE {_CRC_TABLE},
named AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                 hex(encode(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))) AS x
          FROM conversations),
kinds AS (SELECT *, {_CRC} % 20 AS kind FROM named, code),
damaged AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(0, CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM kinds),
placed AS (SELECT *, substr(role, 1, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
                  md5(coalesce('c' || CAST(conv_id AS VARCHAR), 'n') || chr(0) || role || chr(0) || text)) AS i FROM damaged),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS copy_no,
                regexp_replace(text, '{blank}+$', '') AS bare,
                lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS previous FROM placed),
turns AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN copy_no > 1 THEN 'duplicate'
                         WHEN right(bare, 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault FROM seen),
marked AS (SELECT conv_id, i, role, text, initial, coalesce(fault IN ('blank', 'duplicate'), false) AS fixed,
                  CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS extra FROM turns),
path AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT) AS i, {inserts(f"[{{'c': 0, 'a': '', 'r': ''}}, {none}, {none}, {none}]")} AS f FROM marked
         UNION ALL
         SELECT conv_id, i, {inserts("w")} FROM (
           SELECT m.conv_id, m.i, [{", ".join(step)}] AS w
           FROM path p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1)),
best AS (SELECT conv_id, {least("f[1]", "f[4]")} AS b FROM
         (SELECT conv_id, arg_max(f, i) AS f FROM path GROUP BY conv_id)),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                  count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
                  count(*) FILTER (fault = 'truncated') AS truncated,
                  count(*) FILTER (i > 1 AND previous || initial NOT IN ('su', 'ua', 'au')) AS illegal
           FROM turns GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
       coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.c, 0) AS cost,
       coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""


ORACLE["op12_conversation_repair"] = _repair_sql()

# The marks of the template; a mark within a text costs one backslash.
_MARK = r"\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<s>|</s>|\[ROLE\]|\[/ROLE\]|\[END\]"

ORACLE["op13_chat_formatting"] = f"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -1, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
               FROM (SELECT unnest([0, 1]) AS i)),
sized AS (SELECT *, md5(role || chr(0) || text) AS tie, length(text) + len(regexp_extract_all(text, '{_MARK}'))
            + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 17 WHEN 'assistant' THEN 9
                        ELSE 23 + length(role) + len(regexp_extract_all(role, '{_MARK}')) END AS chars FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, tie)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, tie) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
