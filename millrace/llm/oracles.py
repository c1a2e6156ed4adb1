"""DuckDB SQL for the registered queries of this folder."""

from millrace.llm.quality_rules import BASE_RULES, RULES, STOP_WORDS, SYMBOLS

ORACLES = {}

_WHITE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

ORACLES["op5_line_dedup"] = f"""
WITH whole AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (
    SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS position FROM whole),
keyed AS (
    SELECT *, translate(trim(line, {_WHITE}), '{_UPPER}', '{_UPPER.lower()}') AS key FROM line),
repeated AS (
    SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
    GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
    SELECT k.*, coalesce(k.doc_id <> r.keeper, false) AS dropped
    FROM keyed k LEFT JOIN repeated r USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY position) FILTER (NOT dropped), ''))
        AS kept_sha256
FROM judged GROUP BY doc_id
"""

_CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]"

ORACLES["op7_chat_format"] = rf"""
WITH turns AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations
    UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
    UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
ordered AS (
    SELECT *, length(regexp_replace(text, '(\\*({_CONTROL}))', '\\\1', 'g')) AS chars,
        length(regexp_replace(role, '(\\*({_CONTROL}))', '\\\1', 'g')) AS role_chars,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before
    FROM turns)
SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), ''
        ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text)
        FILTER (role = 'assistant'), '')) AS loss_sha256,
    (5 + sum(chars + CASE WHEN before IS NULL THEN 11 + role_chars WHEN before = role THEN 8
        ELSE 16 + role_chars END))::BIGINT AS formatted_chars
FROM ordered GROUP BY conv_id
"""


def _broken(rule):
    ends = [f"({rule.measure}) < {rule.least}"] if rule.least is not None else []
    ends += [f"({rule.measure}) > {rule.most}"] if rule.most is not None else []
    return " OR ".join(ends)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)

ORACLES["op10_quality_rules"] = rf"""
WITH whole AS (
    SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
        list_filter(string_split(coalesce(text, ''), chr(10)),
            lambda x: trim(x, {_WHITE}) <> '') AS lines
    FROM documents),
place AS (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM whole),
window3 AS (
    SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM place),
repeated AS (
    SELECT doc_id, i FROM window3 QUALIFY count(*) OVER (PARTITION BY doc_id, k) >= 2),
covered AS (
    SELECT doc_id, count(DISTINCT j) AS n
    FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM repeated) GROUP BY doc_id),
measured AS (
    SELECT doc_id, len(words) AS n_words,
        length(translate(text, {_WHITE}, '')) AS word_chars,
        length(text) - length(translate(text, '{SYMBOLS}', '')) AS n_symbols,
        len(lines) - len(list_distinct(lines)) AS n_dup_lines,
        coalesce(n, 0) AS n_repeat_words, strlen(text) AS n_bytes, len(lines) AS n_lines,
        len(list_filter(words, lambda x: lower(x) IN ({_STOP}))) AS n_stop_words,
        len(list_filter(lines, lambda x:
            regexp_matches(trim(x, {_WHITE}), '^[-*•]'))) AS n_bullet_lines,
        len(list_filter(lines, lambda x:
            ends_with(rtrim(x), '...') OR ends_with(rtrim(x), '…'))) AS n_open_lines
    FROM whole LEFT JOIN covered USING (doc_id))
SELECT *, coalesce({" OR ".join(map(_broken, BASE_RULES))}, false) AS base_failed,
    NOT coalesce({" OR ".join(map(_broken, BASE_RULES + RULES))}, false) AS kept
FROM measured
"""

_WORDS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), "
    r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
)

ORACLES["op6_decontaminate"] = f"""
WITH item AS (
    SELECT item_id, words, least(10, len(words)) AS n
    FROM (SELECT item_id, {_WORDS} AS words FROM benchmark) WHERE len(words) > 0),
string AS (
    SELECT DISTINCT item_id, n, words[i:i + n - 1] AS s
    FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i FROM item)),
document AS (SELECT doc_id, {_WORDS} AS words FROM documents),
place AS (
    SELECT doc_id, n, i, words[i:i + n - 1] AS s
    FROM (SELECT *, unnest(range(1, len(words) - n + 2)) AS i
          FROM document, (SELECT DISTINCT n FROM string))),
found AS (SELECT doc_id, n, i, item_id FROM place JOIN string USING (n, s)),
hit AS (
    SELECT doc_id, count(DISTINCT j) AS n_hit
    FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM found) GROUP BY doc_id),
listed AS (
    SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
    FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM document LEFT JOIN hit USING (doc_id) LEFT JOIN listed USING (doc_id)
"""

# Texts as hexadecimal digits: two for each byte.
ORACLES["op3_suffix_dedup"] = """
WITH document AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
string AS (
    SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS digest
    FROM (SELECT *, unnest(range(0, len(h) // 2 - 99)) AS i FROM document)),
later AS (
    SELECT doc_id, i FROM string
    QUALIFY row_number() OVER (PARTITION BY digest ORDER BY doc_id, i) > 1),
apart AS (
    SELECT doc_id, i, coalesce(i - lag(i) OVER w > 100, true) AS begins
    FROM later WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (
    SELECT doc_id, i, count(*) FILTER (begins) OVER (PARTITION BY doc_id ORDER BY i) AS span
    FROM apart),
span AS (
    SELECT doc_id, span, min(i) AS start, max(i) + 100 AS stop FROM numbered GROUP BY doc_id, span),
gap AS (
    SELECT s.doc_id, s.start,
        substr(h, 2 * coalesce(lag(stop) OVER w, 0) + 1,
            2 * (s.start - coalesce(lag(stop) OVER w, 0))) AS before,
        CASE WHEN lead(s.start) OVER w IS NULL THEN substr(h, 2 * stop + 1) ELSE '' END AS after,
        stop - s.start AS removed
    FROM span s JOIN document d ON d.doc_id = s.doc_id
    WINDOW w AS (PARTITION BY s.doc_id ORDER BY s.start)),
kept AS (
    SELECT doc_id, sum(removed)::BIGINT AS n_removed, count(*) AS n_spans,
        string_agg(before || after, '' ORDER BY start) AS rest
    FROM gap GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed,
    coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM document LEFT JOIN kept USING (doc_id)
"""

_TERMS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

ORACLES["op11_lexical_search"] = f"""
WITH occurrence AS (SELECT doc_id, unnest({_TERMS}) AS term FROM documents),
frequency AS (SELECT doc_id, term, count(*) AS tf FROM occurrence GROUP BY doc_id, term),
measure AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM frequency GROUP BY doc_id),
corpus AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM measure),
weight AS (
    SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
    FROM frequency, corpus GROUP BY term),
document AS (SELECT doc_id, 100 - 25 + (25 * n * docs) // terms AS m FROM measure, corpus),
asked AS (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (
    SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
    FROM asked JOIN frequency USING (term) JOIN weight USING (term) JOIN document USING (doc_id)
    GROUP BY item_id, doc_id),
ranked AS (
    SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER
        AS rank, doc_id, score
    FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

_LETTERS = (
    f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_UPPER.lower()}'), "
    r"'[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
)
_SHARE = "(1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * terms))::BIGINT"

ORACLES["op12_divergence"] = f"""
WITH document AS (
    SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        {_LETTERS} AS found FROM documents),
occurrence AS (SELECT doc_id, lang, source, unnest(found) AS term FROM document),
kept AS (
    SELECT lang, term FROM occurrence GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 10),
size AS (SELECT lang, count(*) AS terms FROM kept GROUP BY lang),
grp AS (SELECT DISTINCT lang, source FROM document),
present AS (
    SELECT lang, source, term, count(*) AS n
    FROM occurrence JOIN kept USING (lang, term) GROUP BY lang, source, term),
counted AS (
    SELECT lang, source, term, coalesce(n, 0) AS n
    FROM grp JOIN kept USING (lang) LEFT JOIN present USING (lang, source, term)),
shared AS (
    SELECT lang, source, term, n, {_SHARE} AS p
    FROM (SELECT *, sum(n) OVER (PARTITION BY lang, source) AS total FROM counted)
    JOIN size USING (lang)),
language AS (
    SELECT lang, term, {_SHARE} AS q
    FROM (SELECT *, sum(n) OVER (PARTITION BY lang) AS total
          FROM (SELECT lang, term, sum(n) AS n FROM counted GROUP BY lang, term))
    JOIN size USING (lang)),
pair AS (
    SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
    FROM shared a JOIN shared b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
    GROUP BY a.lang, a.source, b.source),
value AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value
    FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
    UNION ALL
    SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q)
    FROM shared JOIN language USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (
    SELECT *, row_number() OVER (
        PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM value)
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 10
"""
