"""DuckDB SQL for the queries that SQL expresses over whole tables."""

OP3 = r"""
WITH rules(verdict, host, path, rule) AS (VALUES
  ('block', 'com', '/en/', 'com/en/'), ('allow', 'example.com', '/en/7', 'example.com/en/7'),
  ('allow', 'net', '/de/', 'net/de/'), ('block', 'example.net', '/de/8', 'example.net/de/8'),
  ('block', 'org', '/es/', 'org/es/')),
parts AS (
  SELECT page_id, url,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages),
split AS (
  SELECT page_id, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM parts),
fits AS (
  SELECT s.page_id, s.host, s.path, r.rule, r.verdict,
    row_number() OVER (PARTITION BY s.page_id, s.host, s.path ORDER BY length(r.host) DESC NULLS LAST, length(r.path) DESC) AS k
  FROM split s LEFT JOIN rules r ON (s.host = r.host OR ends_with(s.host, '.' || r.host)) AND starts_with(s.path, r.path))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""

OP4 = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha256(html) AS h FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first FROM d)
SELECT page_id, n::BIGINT AS payload_bytes, h AS payload_digest,
  CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM f
"""

OP6 = r"""
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

OP11 = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, doc_id, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents WHERE text IS NOT NULL),
w AS (SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces),
total AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
stood AS (SELECT p, lang, unnest(ws) AS w1, generate_subscripts(ws, 1) AS i FROM w),
five AS (
  SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3, lead(w1, 3) OVER o AS w4, lead(w1, 4) OVER o AS w5
  FROM stood WINDOW o AS (PARTITION BY p ORDER BY i)),
grams AS (
  SELECT lang, 1 AS k, w1 AS phrase FROM five
  UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM five WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, 3, w1 || ' ' || w2 || ' ' || w3 FROM five WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, 4, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 FROM five WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, 5, w1 || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 FROM five WHERE w5 IS NOT NULL),
counts AS MATERIALIZED (SELECT lang, k, phrase, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= 100),
f AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS ws FROM counts),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, l.f AS l, r.f AS r, n, (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f) AS score,
    row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000::HUGEINT * c.f * n) // (l.f::HUGEINT * r.f), t.i) AS o
  FROM f c JOIN range(1, 5) t(i) ON t.i < c.k JOIN total USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1 : t.i], ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[t.i + 1 : c.k], ' ')),
inside AS (
  SELECT DISTINCT s.lang, s.phrase FROM f s
  JOIN (SELECT b.lang, b.f, array_to_string(b.ws[t.i : u.j], ' ') AS phrase FROM f b JOIN range(1, 5) t(i) ON true JOIN range(2, 6) u(j) ON u.j > t.i AND u.j <= b.k AND u.j - t.i + 1 < b.k) b
  ON b.lang = s.lang AND b.phrase = s.phrase AND 100 * b.f >= 100 * s.f),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score::BIGINT AS score
  FROM cuts ANTI JOIN inside USING (lang, phrase) WHERE o = 1)
SELECT * FROM ranked WHERE rank <= 2000
"""


def _op12() -> str:
    """Each template as a pattern over the words of a text, with one space on either side of each word."""
    import re

    from .licenses import PHRASES, TEMPLATES

    def pattern(text: str) -> str:
        out = ""
        for part in re.split(r"(<<[^>]*>>)", text.lower()):
            if part in ("<<optional>>", "<<end>>"):
                out += "(?:" if part == "<<optional>>" else ")?"
            elif part.startswith("<<"):
                most, match = re.fullmatch(r"<<var most=(\d+)(?: match=(.*))?>>", part).groups()
                out += f"(?: {match or '[^ ]+'}){{1,{most}}}"
            else:
                out += "".join(" " + w for w in re.findall("[0-9a-z]+", part))
        return out + " "

    def mandatory(text: str) -> int:
        while "<<optional>>" in text:
            text = re.sub(r"<<optional>>(?:(?!<<optional>>|<<end>>).)*<<end>>", " ", text)
        return len(re.findall("[0-9a-z]+", re.sub("<<[^>]*>>", " ", text.lower())))

    rules = ", ".join(f"('{label}', '{pattern(t)}', {mandatory(t)}, false)" for label, t in TEMPLATES)
    phrases = ", ".join(f"('{label}', '{p}', {p.count(' ') + 1})" for p, label in PHRASES)
    return rf"""
WITH rules(label, pattern, m, base) AS (VALUES {rules}),
phrases(label, phrase, m) AS (VALUES {phrases}),
w AS (SELECT row_number() OVER () AS rn, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
stood AS (SELECT rn, unnest(ws) AS word, generate_subscripts(ws, 1) - 1 AS i FROM w),
four AS (
  SELECT rn, i, word, word || ' ' || coalesce(lead(word) OVER o, '') AS two, word || ' ' || coalesce(lead(word) OVER o, '') || ' ' || coalesce(lead(word, 2) OVER o, '') || ' ' || coalesce(lead(word, 3) OVER o, '') AS four
  FROM stood WINDOW o AS (PARTITION BY rn ORDER BY i)),
places AS (SELECT rn, i, label, m FROM four JOIN phrases ON phrase = CASE m WHEN 2 THEN two ELSE four END),
matches AS (SELECT rn, label, m FROM w JOIN rules ON regexp_matches(' ' || array_to_string(ws, ' ') || ' ', pattern)),
base AS (SELECT rn, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY rn),
whole AS (SELECT rn, max(m) AS m, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT rn, label, m FROM places UNION ALL SELECT * FROM matches) GROUP BY rn)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(m, 0)::DOUBLE / (coalesce(m, 0) + 5) AS score
FROM w LEFT JOIN base USING (rn) LEFT JOIN whole USING (rn)
"""


OP13 = r"""
WITH bits AS (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)),
tab AS (SELECT list(v ORDER BY i) AS t FROM bits),
w AS (
  SELECT row_number() OVER () AS rn, false AS target, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
  UNION ALL SELECT row_number() OVER (), true, NULL,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') FROM benchmark),
features AS (
  SELECT target, rn, unnest(ws) AS x FROM w
  UNION ALL SELECT target, rn, unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) FROM w),
hexed AS (SELECT x, lower(hex(encode(x))) AS h FROM (SELECT DISTINCT x FROM features)),
coded AS (SELECT x, list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)) AS b FROM hexed),
bucket AS (SELECT x, xor(list_reduce(b, lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS k FROM coded, tab),
held AS (SELECT target, rn, k FROM features JOIN bucket USING (x)),
sums AS (SELECT k, count(*) FILTER (WHERE NOT target) AS s, count(*) FILTER (WHERE target) AS t FROM held GROUP BY k),
alls AS (SELECT sum(s)::DOUBLE AS s_all, sum(t)::DOUBLE AS t_all FROM sums),
gain AS (SELECT k, floor(1000 * ln((t + 1.0::DOUBLE) * (s_all + 10000) / ((s + 1.0::DOUBLE) * (t_all + 10000))))::BIGINT AS g FROM sums, alls),
weighed AS (SELECT rn, count(*) AS n_features, floor(sum(g)::DOUBLE / count(*))::BIGINT AS weight FROM held JOIN gain USING (k) WHERE NOT target GROUP BY rn),
scored AS (
  SELECT doc_id, len(ws) >= 20 AS able, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('7:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM w LEFT JOIN weighed USING (rn) WHERE NOT target),
ranked AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS r, count(*) OVER (PARTITION BY able) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 25 * n // 100 THEN r END AS rank FROM ranked
"""

ORACLE = {"op3_url_filters": OP3, "op4_warc": OP4, "op6_knn_join": OP6, "op11_collocations": OP11, "op12_licenses": _op12(), "op13_resample": OP13}
