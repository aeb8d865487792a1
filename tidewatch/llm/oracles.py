"""The operators that SQL can express, in DuckDB's SQL."""

from __future__ import annotations

from tidewatch.llm import warc
from tidewatch.llm.quality import CLASSES, COMMON, STEPS, WINDOW, Rules

_rules = Rules()
_white = r"[\x20\x09-\x0D]"
_sets = {
    "lower": "[a-z]",
    "white": _white,
    "upper": "[A-Z]",
    "digit": "[0-9]",
    "symbol": r"[#*$%&|<>]",
    "point": r"[.,;:!?'\"()\-]".replace("'", "''"),
}
_counts = ", ".join(f"length(t) - length(regexp_replace(t, '{_sets[c]}', '', 'g'))" for c in CLASSES)
_every = "[" + "".join(_sets[c][1:-1] for c in CLASSES) + "]"
_listed = " ".join(f"WHEN '{lang}' THEN {common.split()!r}" for lang, common in COMMON.items())
_class_bins = len(CLASSES) + 1


def _distance(own: str, reference: str) -> str:
    p, q = f"x / list_sum({own})", f"{reference}[i] / list_sum({reference})"
    both = f"({p} + {q})"
    return f"""CASE WHEN list_sum({own}) > 0 AND list_sum({reference}) > 0 THEN
        sqrt(greatest(0, list_sum(list_transform({own}, lambda x, i:
            (CASE WHEN x > 0 THEN {p} * log2(2 * ({p}) / {both}) ELSE 0 END
             + CASE WHEN {reference}[i] > 0 THEN {q} * log2(2 * ({q}) / {both}) ELSE 0 END) / 2)))) END"""


def _shares(own: str) -> str:
    return f"list_transform({own}, lambda c: c * {STEPS} // list_sum({own}))"


QUALITY = f"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+') AS w,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    [{_counts}, length(regexp_replace(t, '{_every}', '', 'g'))] AS classes,
    CASE lang {_listed} END AS listed
  FROM texts
), counted AS (
  SELECT r, doc_id, lang, t, len(w) AS n_words, w, classes,
    classes[{list(CLASSES).index("symbol") + 1}] AS n_symbols,
    length(t) - classes[{list(CLASSES).index("white") + 1}] AS word_chars,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines,
    CASE WHEN listed IS NOT NULL THEN list_concat(
      list_transform(listed, lambda c: len(list_filter(w, lambda x: x = c))),
      [len(list_filter(w, lambda x: list_contains(listed, x) IS NOT TRUE))]) END AS commons
  FROM split
), windows AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, words) AS n
  FROM (
    SELECT r, unnest(range(1, n_words - {WINDOW - 2})) AS i,
      unnest(list_transform(range(1, n_words - {WINDOW - 2}), lambda i: array_to_string(w[i:i + {WINDOW - 1}], ' '))) AS words
    FROM counted WHERE n_words >= {WINDOW})
), repeats AS (
  SELECT r, sum(least({WINDOW}, coalesce(after - i, {WINDOW}))) AS n
  FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS after FROM windows WHERE n > 1) GROUP BY r
), based AS (
  SELECT counted.*, coalesce(repeats.n, 0) AS n_repeat_words,
    n_words < {_rules.least_words} OR 100 * coalesce(repeats.n, 0) > {_rules.repeat_percent} * n_words AS base_failed
  FROM counted LEFT JOIN repeats USING (r)
), different AS (
  SELECT lang, any_value(classes) AS classes, any_value(commons) AS commons
  FROM based WHERE n_words >= {_rules.least_words_compared} AND NOT base_failed AND commons IS NOT NULL GROUP BY lang, t
), bins AS (
  SELECT lang, unnest(range(1, len(shares) + 1)) AS bin, unnest(shares) AS share
  FROM (SELECT lang, list_concat({_shares("classes")}, {_shares("commons")}) AS shares FROM different)
), medians AS (
  SELECT lang, bin, list_sort(list(share))[(count(*) + 1) // 2] AS share FROM bins GROUP BY lang, bin
), refs AS (
  SELECT lang AS ref_lang, list(share ORDER BY bin) FILTER (bin <= {_class_bins}) AS ref_classes,
    list(share ORDER BY bin) FILTER (bin > {_class_bins}) AS ref_commons
  FROM medians GROUP BY lang
), scored AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    {_distance("classes", "ref_classes")} AS class_distance,
    {_distance("commons", "ref_commons")} AS word_distance
  FROM based LEFT JOIN refs ON lang = ref_lang
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols,
  n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(n_words >= {_rules.least_words_compared}
    AND (class_distance > {_rules.class_distance} OR word_distance > {_rules.word_distance}), false) AS kept
FROM scored
"""


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _identifier(*parts: str) -> str:
    h = f"md5(concat_ws('|', {', '.join(parts)}))"
    cut = ", ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || concat_ws('-', {cut}) || '>'"


def _field(name: str, value: str) -> str:
    return f"CASE WHEN {value} = '' THEN '' ELSE '{name}: ' || {value} || chr(13) || chr(10) END"


_text = f"regexp_replace(payload, {_quoted(warc.HIDDEN)}, '', 'g')"
_text = f"regexp_replace({_text}, '[ \\t\\r\\n\\f\\x0b]+', ' ', 'g')"
_text = f"regexp_replace(regexp_replace({_text}, {_quoted(warc.LINES)}, chr(10), 'g'), {_quoted(warc.TAGS)}, '', 'g')"
for _name, _sign in warc.ENTITIES:
    _text = f"replace({_text}, {_quoted(_name)}, {_quoted(_sign)})"
_text = f"trim(regexp_replace(regexp_replace({_text}, ' +', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ' || chr(10))"
_title = f"regexp_extract(payload, {_quoted(warc.TITLE)}, 1)"


def _value(tag: str, name: str) -> str:
    """A pattern for an attribute's value, in quotes of either kind or bare."""
    pattern = rf"""(?i)<{tag}(?:\s[^<>]*?)?\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'<>]+)"""
    return _quoted(pattern)


def _bare(value: str) -> str:
    return f"""CASE WHEN left({value}, 1) IN (chr(34), chr(39)) THEN substr({value}, 2, length({value}) - 2) ELSE {value} END"""


_lang = _bare(f"regexp_extract(payload, {_value('html', 'lang')}, 1)")
_link = _value("a", "href")
_end = "chr(13) || chr(10)"

WARC = f"""
WITH pages_in AS (
  SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages
), digested AS (
  SELECT *, 'sha256:' || sha256(payload) AS source_payload_digest FROM pages_in
), response AS (
  SELECT *, {_identifier("'response'", "coalesce(page_id::VARCHAR, '')", "target_uri", "source_payload_digest")} AS refers_to
  FROM digested
), made AS (
  SELECT *, 'metadata' AS warc_type, 'source-payload-digest: ' || source_payload_digest || {_end}
    || 'source-http-header: HTTP/1.1 200 OK' || {_end}
    || 'source-http-header: Content-Type: text/html; charset=utf-8' || {_end}
    || 'source-http-header: Content-Length: ' || strlen(payload) || {_end}
    || {_field("language", f"({_lang})")} || {_field("title", f"regexp_replace({_title}, '[\\r\\n]+', ' ', 'g')")}
    || array_to_string(list_transform(regexp_extract_all(payload, {_link}, 1), lambda x: 'outlink: ' || {_bare("x")} || {_end}), '') AS block
  FROM response
  UNION ALL SELECT *, 'conversion', {_text} FROM response
)
SELECT page_id, warc_type, {_identifier("warc_type", "refers_to")} AS record_id, refers_to, target_uri,
  strlen(block)::BIGINT AS content_length, 'sha256:' || sha256(block) AS block_digest, source_payload_digest
FROM made
"""
