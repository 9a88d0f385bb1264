"""DuckDB SQL for the queries that SQL can express over whole tables."""

from docledger.llm.mixing import MAX_EPOCHS, SEED

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Bucket of a non-negative integer: its eight leading bits, the rest cleared.
_BUCKET = "(value >> greatest(length(bin(value)) - 8, 0)) << greatest(length(bin(value)) - 8, 0)"


def _fences(name: str, group: str) -> str:
    """Fences of each group by its sketch: quantile and so many times its distance to the median."""
    by = f"{group}, metric" if group else "metric"

    def rank(q: int) -> str:
        return f"min(CASE WHEN 100 * below >= {q} * total THEN bucket END) AS q{q}"

    def step(q: int) -> str:
        return f"greatest(abs(q{q} - q50), q{q} // 128, 1)"

    return f"""
{name}_running AS (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY bucket) AS below, sum(n) OVER (PARTITION BY {by}) AS total
  FROM (SELECT {by}, bucket, sum(n)::BIGINT AS n FROM sketch GROUP BY ALL)),
{name}_quantiles AS (SELECT {by}, max(total)::BIGINT AS total, {rank(10)}, {rank(50)}, {rank(90)}, {rank(99)} FROM {name}_running GROUP BY {by}),
{name} AS (SELECT {group + "," if group else ""} max(total) AS n,
  max(CASE WHEN metric = 'symbol_rate' THEN q90 + 3 * {step(90)} END) AS f1,
  max(CASE WHEN metric = 'dup_line_rate' THEN q99 + {step(99)} END) AS f2,
  max(CASE WHEN metric = 'repeat_rate' THEN q99 + {step(99)} END) AS f3,
  max(CASE WHEN metric = 'word_length' THEN q90 + 3 * {step(90)} END) AS f4,
  max(CASE WHEN metric = 'word_length' THEN greatest(q10 - 3 * {step(10)}, 0) END) AS f5
  FROM {name}_quantiles {"GROUP BY " + group if group else ""})"""


_DRAWN = ", ".join(
    f"(o.n * o.f{i} + 100 * ((w.n * w.f{i} + 100 * a.f{i}) // (w.n + 100))) // (o.n + 100) AS f{i}" for i in range(1, 6)
)

QUALITY = rf"""
WITH split AS (SELECT doc_id, lang, source, text, {WORDS} AS w,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
five AS (SELECT doc_id, i, w[i:i + 4] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM five) WHERE n > 1),
spans AS (SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM twice),
repeats AS (SELECT doc_id, sum(n)::BIGINT AS n FROM spans GROUP BY doc_id),
counted AS (SELECT s.doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
  len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols, len(l)::BIGINT AS n_lines,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN repeats r ON s.doc_id = r.doc_id),
based AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  n_symbols * 1000 // greatest(word_chars, 1) AS symbol_rate, n_dup_lines * 1000 // greatest(n_lines, 1) AS dup_line_rate,
  n_repeat_words * 1000 // greatest(n_words, 1) AS repeat_rate, word_chars * 1000 // greatest(n_words, 1) AS word_length FROM counted),
metrics AS (UNPIVOT (SELECT lang, source, symbol_rate, dup_line_rate, repeat_rate, word_length FROM based WHERE NOT base_failed)
  ON symbol_rate, dup_line_rate, repeat_rate, word_length INTO NAME metric VALUE value),
sketch AS (SELECT lang, source, metric, {_BUCKET} AS bucket, count(*) AS n FROM metrics GROUP BY ALL),{_fences("own", "lang, source")},{_fences("whole", "lang")},{_fences("every", "")},
fences AS (SELECT o.lang, o.source, {_DRAWN} FROM own o JOIN whole w ON o.lang IS NOT DISTINCT FROM w.lang CROSS JOIN every a)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed
  AND coalesce(symbol_rate <= f1 AND dup_line_rate <= f2 AND repeat_rate <= f3 AND word_length <= f4 AND word_length >= f5, true) AS kept
FROM based b LEFT JOIN fences f ON b.lang IS NOT DISTINCT FROM f.lang AND b.source IS NOT DISTINCT FROM f.source
"""

MIX = f"""
WITH best AS (SELECT doc_id, max(quality) AS q FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
sized AS (SELECT d.doc_id, source, len({WORDS})::BIGINT AS size, CASE WHEN q > 0 THEN 2.0 WHEN q IS NULL THEN 1.0 ELSE 0.5 END AS weight,
  md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null:' || md5(coalesce(d.text, '')))) AS digest FROM documents d LEFT JOIN best b ON d.doc_id = b.doc_id),
keyed AS (SELECT doc_id, source, size,
  -ln((('0x' || substr(digest, 1, 13))::BIGINT::DOUBLE + 1) / 4503599627370496.0) / weight AS k FROM sized),
sources AS (SELECT source, sum(size)::BIGINT AS source_size FROM keyed GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS r FROM sources),
weighed AS (SELECT *, ((r - 1) % 3 + 1)::DOUBLE AS w, {MAX_EPOCHS} * source_size::DOUBLE AS cap FROM ranked),
levelled AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER before, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER before, 0)) AS level
  FROM weighed WINDOW before AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, CASE WHEN cap / w > level THEN w * max(CASE WHEN cap / w > level THEN level END) OVER () ELSE cap END AS target FROM levelled),
placed AS (SELECT doc_id, size, source_size, target, floor(target / greatest(source_size, 1)) AS whole,
  coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY k, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2.0 AS pos
  FROM keyed k JOIN goals g ON k.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
  (size * least(whole + CASE WHEN pos < target - whole * source_size THEN 1 ELSE 0 END, {MAX_EPOCHS}))::BIGINT AS taken FROM placed
"""

_ESCAPED = r"""regexp_replace({}, '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>)', '\1\\\2\3', 'g')"""

CHAT = f"""
WITH said AS (SELECT conv_id, turn, coalesce(role, '') AS role, role AS r, coalesce(text, '') AS text, text AS t FROM (
  SELECT conv_id, turn, role, text FROM conversations UNION ALL
  VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
joined AS (SELECT conv_id, count(*) AS n_turns,
  string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST) AS turns,
  coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, r NULLS FIRST, t NULLS FIRST), '') AS loss,
  sum(length('<|im_start|><|im_end|>') + 2 + length({_ESCAPED.format(r"replace(replace(role, '\\', '\\\\'), chr(10), '\\n')")}) + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM joined
"""

_TERMS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

LEXICAL = f"""
WITH split AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS w FROM documents),
docs AS (SELECT row, doc_id, len(w)::BIGINT AS n FROM split WHERE len(w) > 0),
whole AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM docs),
counts AS (SELECT row, term, count(*)::BIGINT AS tf FROM (SELECT row, unnest(w) AS term FROM split) GROUP BY ALL),
held AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
weights AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w
  FROM (SELECT term, count(*)::BIGINT AS df FROM counts WHERE term IN (SELECT term FROM held) GROUP BY term), whole),
scored AS (SELECT item_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::BIGINT AS score
  FROM held JOIN weights USING (term) JOIN counts USING (term) JOIN docs USING (row), whole GROUP BY item_id, row)
SELECT item_id, rank, doc_id, score FROM (SELECT item_id, doc_id, score,
  row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank
  FROM scored JOIN docs USING (row) WHERE score > 0) WHERE rank <= 10
"""

#: CRC-32 of an ASCII string, bit by bit.
_CRC = (
    "xor(list_reduce([4294967295] || list_transform(string_split({}, ''), lambda x: ascii(x)::BIGINT), lambda c, b: "
    "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"
)


def _and(way: str, cost: str, letter: str) -> str:
    """A way into a state, as its cost in nine digits and its letters, with one more edit."""
    return f"(lpad((left({way}, 9)::INT + {cost})::VARCHAR, 9, '0') || substr({way}, 10) || '{letter}')"


def _keep_or_rerole(way: str, initial: str) -> str:
    return f"CASE WHEN NOT gone THEN CASE WHEN initial = '{initial}' THEN {_and(way, 'late', 'K')} ELSE {_and(way, '3 + late', 'R')} END END"


REPAIR = rf"""
WITH RECURSIVE hashed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS h FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) FROM hashed WHERE h > 0)),
lined AS (SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
  rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS said FROM damaged),
seen AS (SELECT *, CASE WHEN said = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate' WHEN right(said, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
  coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM lined),
rows_in AS MATERIALIZED (SELECT *, fault IN ('blank', 'duplicate') AS gone, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS late FROM seen),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, '000000000' AS v0, NULL::VARCHAR AS v1, '000000003I' AS v2, '000000006II' AS v3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, v0, v1, v2, least(v3, {_and("v2", "3", "I")}) FROM (
    SELECT conv_id, i, v0, v1, least(v2, {_and("v0", "3", "I")}, {_and("v1", "3", "I")}, {_and("v3", "3", "I")}) AS v2, v3 FROM (
      SELECT s.conv_id, r.i, {_and("v0", "4", "D")} AS v0,
        least({_and("v1", "4", "D")}, CASE WHEN NOT gone AND initial = 's' THEN {_and("v0", "late", "K")} END) AS v1,
        least({_and("v2", "4", "D")}, {_keep_or_rerole("v0", "u")}, {_keep_or_rerole("v1", "u")}, {_keep_or_rerole("v3", "u")}) AS v2,
        least({_and("v3", "4", "D")}, {_keep_or_rerole("v2", "a")}) AS v3
      FROM ways s JOIN rows_in r ON s.conv_id IS NOT DISTINCT FROM r.conv_id AND r.i = s.i + 1))),
last AS (SELECT conv_id, max_by(least(v0, v3), i) AS best FROM ways GROUP BY conv_id),
edits AS (SELECT conv_id, unnest(string_split(substr(best, 10), '')) AS edit, generate_subscripts(string_split(substr(best, 10), ''), 1) AS pos FROM last WHERE length(best) > 9),
placed AS (SELECT *, sum((edit <> 'I')::INT) OVER w AS i, sum((edit <> 'D')::INT) OVER w AS left_over FROM edits WINDOW w AS (PARTITION BY conv_id ORDER BY pos)),
named AS (SELECT p.conv_id, pos, edit, left_over, CASE WHEN edit = 'K' THEN r.role END AS role, CASE WHEN edit = 'I' THEN '' ELSE r.text END AS text
  FROM placed p LEFT JOIN rows_in r ON p.conv_id IS NOT DISTINCT FROM r.conv_id AND p.i = r.i WHERE edit <> 'D'),
repaired AS (SELECT conv_id, string_agg(coalesce(role, CASE WHEN (left_over - (first_role = 's')::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END) || ':' || text, chr(10) ORDER BY pos) AS whole
  FROM (SELECT *, coalesce(left(first_value(role) OVER (PARTITION BY conv_id ORDER BY pos), 1), 'u') AS first_role FROM named) GROUP BY conv_id),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, sum((fault = 'blank')::INT)::BIGINT AS blank,
  sum((fault = 'duplicate')::INT)::BIGINT AS duplicate, sum((fault = 'truncated')::INT)::BIGINT AS truncated, sum(illegal::INT)::BIGINT AS illegal
  FROM rows_in GROUP BY conv_id)
SELECT l.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, left(best, 9)::BIGINT AS cost, substr(best, 10) AS audit, sha256(coalesce(whole, '')) AS repaired_sha256
FROM last l LEFT JOIN counted c ON l.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN repaired r ON l.conv_id IS NOT DISTINCT FROM r.conv_id
"""

SQL = {
    "op9_chat_format": CHAT,
    "op3_quality_rules": QUALITY,
    "op8_source_mix": MIX,
    "op11_lexical_search": LEXICAL,
    "op13_repair": REPAIR,
}
