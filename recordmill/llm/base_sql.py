"""DuckDB SQL for what patterns alone decide: the base statistics and counts of operators 3, 5 and 10."""

from __future__ import annotations



def _either(word: str) -> str:
    """The letters in either case, ASCII only, where RE2 would fold others as well."""
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = "|".join(_either(w) for w in ("password", "passwd", "secret", "token")) + "|" + _either("api") + "_?" + _either("key")

TEXT_STATISTICS = r"""
    WITH texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
    words AS (SELECT r, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM texts),
    grams AS (SELECT r, unnest(range(1, len(w) - 3)) AS i, w FROM words WHERE len(w) >= 5),
    found AS (SELECT r, i, count(*) OVER (PARTITION BY r, array_to_string(w[i : i + 4], ' ')) AS n FROM grams),
    covered AS (SELECT r, least(5, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 5)) AS n FROM found WHERE n > 1),
    repeated AS (SELECT r, CAST(sum(n) AS BIGINT) AS n FROM covered GROUP BY r),
    counted AS (
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
            coalesce(n, 0) AS n_repeat_words
        FROM words LEFT JOIN repeated USING (r))
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted"""

PERSONAL_COUNTS = r"""
    WITH found AS (
        SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+') AS email,
            regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)') AS ip,
            list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS card,
            list_transform(regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) AS phone
        FROM documents)
    SELECT doc_id, CAST(len(email) AS BIGINT) AS n_email,
        CAST(len(list_filter(ip, lambda x: len(list_filter(string_split(x, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(left(ltrim(p, '0'), 3) AS INT), 0) > 255)) = 0)) AS BIGINT) AS n_ip,
        CAST(len(list_filter(card, lambda x: length(x) BETWEEN 13 AND 19 AND list_sum(list_transform(range(0, length(x)), lambda k:
            CASE WHEN k % 2 = 0 THEN CAST(x[length(x) - k] AS INT) WHEN CAST(x[length(x) - k] AS INT) > 4 THEN 2 * CAST(x[length(x) - k] AS INT) - 9 ELSE 2 * CAST(x[length(x) - k] AS INT) END)) % 10 = 0)) AS BIGINT) AS n_card,
        CAST(len(list_filter(phone, lambda x: length(x) BETWEEN 9 AND 15)) AS BIGINT) AS n_phone
    FROM found"""

SECRET_COUNTS = f"""
    SELECT doc_id,
        CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '({_ASSIGN})["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
        CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS BIGINT) AS n_access,
        CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS BIGINT) AS n_hex
    FROM documents"""
