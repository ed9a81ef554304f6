"""Queries of the corpus operators, by name."""

from __future__ import annotations

from .decontamination import op8_decontamination
from .divergence import LEAST_DOCS, PRIOR, SCALE, TOP, op13_source_divergence
from .language import op3_language_id
from .licenses import GAP, LOWER, TEMPLATES, UPPER, op9_license_scan, template_words
from .media import op6_media
from .near_dedup import op10_near_dedup
from .packing import op7_best_fit_packing
from .quality import op5_quality
from .sharding import op12_resharding
from .substring_dedup import op4_substring_dedup
from .url_filter import op2_url_filter
from .warc import op1_warc
from .whitening import op11_whitening

QUERIES = {
    "op1_warc": op1_warc,
    "op9_license_scan": op9_license_scan,
    "op6_media": op6_media,
    "op5_quality": op5_quality,
    "op2_url_filter": op2_url_filter,
    "op8_decontamination": op8_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op3_language_id": op3_language_id,
    "op4_substring_dedup": op4_substring_dedup,
    "op10_near_dedup": op10_near_dedup,
    "op11_whitening": op11_whitening,
    "op12_resharding": op12_resharding,
    "op13_source_divergence": op13_source_divergence,
}


def _templates(k: int = 4) -> str:
    """Rows (template, label, positions, place, gram) of the license templates."""
    rows = []
    for i, (label, text) in enumerate(TEMPLATES):
        words = template_words(text)
        n = len(words) - k + 1
        rows += [f"({i}, '{label}', {n}, {at}, '{' '.join(words[at : at + k])}')" for at in range(n)]
    return ", ".join(rows)


#: DuckDB SQL where it can express the query; the others have trained scores, XXH64, token ids or
#: encoded files in their rows.
ORACLE_SQL: dict[str, str] = {
    "op9_license_scan": f"""
        WITH t(template, label, positions, place, gram) AS (VALUES {_templates()}),
        d AS (SELECT doc_id, [x FOR x IN string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{GAP}') IF x <> ''] AS l FROM documents),
        w AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) - 1 AS i FROM d),
        g AS (SELECT *, lead(x, 1) OVER o AS x1, lead(x, 2) OVER o AS x2, lead(x, 3) OVER o AS x3 FROM w WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
        p AS (SELECT doc_id, i, CASE WHEN x = 'mit' AND x1 = 'license' THEN 'mit' WHEN x = 'apache' AND x1 = 'license' THEN 'apache' WHEN x = 'general' AND x1 = 'public' AND x2 = 'license' THEN 'gpl' END AS label FROM g),
        b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS own FROM p WHERE label IS NOT NULL GROUP BY doc_id),
        v AS (SELECT doc_id, template, label, positions, i AS pos, place, i - place AS d FROM g JOIN t ON gram = x || ' ' || x1 || ' ' || x2 || ' ' || x3),
        a AS (SELECT *, CASE WHEN d - lag(d) OVER (PARTITION BY doc_id, template ORDER BY d) <= 3 THEN 0 ELSE 1 END AS fresh FROM (SELECT DISTINCT doc_id, template, d FROM v)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, template ORDER BY d) AS island FROM a),
        m AS (SELECT v.doc_id, v.label, v.positions, count(DISTINCT place) / v.positions AS share, max(pos) - min(pos) + 4 AS width FROM v JOIN s ON v.doc_id = s.doc_id AND v.template = s.template AND v.d = s.d GROUP BY v.doc_id, v.template, v.label, v.positions, s.island),
        o AS (SELECT doc_id, list(DISTINCT label) AS own, max(share) AS share FROM m WHERE share >= 0.6 AND width <= 1.5 * (positions + 3) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(l) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(array_to_string(list_sort(b.own), ','), '') AS base_labels,
        coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.own, []), coalesce(o.own, [])))), ','), '') AS labels, greatest(coalesce(o.share, 0.0), CASE WHEN n_base > 0 THEN 0.5 ELSE 0.0 END) AS score
        FROM d LEFT JOIN b USING (doc_id) LEFT JOIN o USING (doc_id)""",
    "op1_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, ''))) AS n, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS best FROM pages)
        SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN n >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> best THEN best END AS refers_to FROM p""",
    "op4_substring_dedup": """
        WITH t AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\x0B\\f\\r]+') AS l FROM documents)),
        x AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n, string_agg(w, ' ') OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) AS win FROM t),
        r AS (SELECT doc_id, i, w, n, CASE WHEN i + 19 <= n AND row_number() OVER (PARTITION BY i + 19 <= n, win ORDER BY doc_id, i) > 1 THEN 1 ELSE 0 END AS again FROM x),
        c AS (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r),
        g AS (SELECT doc_id, count(*) AS n_words, CAST(sum(gone) AS BIGINT) AS n_removed, sha256(coalesce(string_agg(w, ' ' ORDER BY i) FILTER (gone = 0), '')) AS kept_sha256 FROM c GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, coalesce(kept_sha256, sha256('')) AS kept_sha256 FROM documents d LEFT JOIN g USING (doc_id)""",
    "op13_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS nr, coalesce(lang, '') AS lang, coalesce(source, '') AS source, string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x40\x5B-\x60\x7B-\x7F]+') AS l FROM documents),
        w AS (SELECT nr, lang, source, term FROM (SELECT nr, lang, source, unnest(l) AS term FROM d) WHERE term <> ''),
        k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT nr) >= {LEAST_DOCS}),
        v AS (SELECT lang, count(*) AS V FROM k GROUP BY lang),
        c AS (SELECT w.lang, w.source, w.term, count(*) AS n FROM w JOIN k ON w.lang = k.lang AND w.term = k.term GROUP BY w.lang, w.source, w.term),
        g AS (SELECT DISTINCT lang, source FROM d),
        gn AS (SELECT g.lang, g.source, coalesce(any_value(V), 0) AS V, coalesce(sum(c.n), 0) AS N FROM g LEFT JOIN v ON g.lang = v.lang LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
        ln AS (SELECT lang, sum(N) AS N FROM gn GROUP BY lang),
        p AS (SELECT gn.lang, gn.source, k.term, coalesce(c.n, 0) AS n, 1 + ({SCALE}::HUGEINT * (coalesce(c.n, 0) + {PRIOR})) // (gn.N + {PRIOR} * gn.V) AS p FROM gn JOIN k ON gn.lang = k.lang LEFT JOIN c ON c.lang = gn.lang AND c.source = gn.source AND c.term = k.term),
        q AS (SELECT x.lang, x.term, 1 + ({SCALE}::HUGEINT * (x.n + {PRIOR})) // (ln.N + {PRIOR} * v.V) AS q FROM (SELECT lang, term, sum(n) AS n FROM p GROUP BY lang, term) x JOIN ln ON x.lang = ln.lang JOIN v ON x.lang = v.lang),
        f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
        s AS (SELECT a.lang, a.source, b.source AS item, coalesce(f.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source),
        t AS (SELECT p.lang, p.source, p.term AS item, p - q AS value FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE n > 0 AND p > q),
        r AS (SELECT lang, source, 'pair' AS part, item, value FROM s UNION ALL SELECT lang, source, 'term', item, value FROM t)
        SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM r) WHERE part = 'pair' OR rank <= {TOP}""",
}
