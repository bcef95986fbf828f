"""DuckDB SQL of the registered queries that SQL can express.

Not here: token ids (6, 10), the labels of the license scan's method (8) and language-model
verdicts (9); tests hold those against plain Python.
"""

from __future__ import annotations

_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = rf"regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+')"

ORACLE: dict[str, str] = {
    "op1_chat_formatting": r"""
        WITH messages AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
            UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
        joined AS (
            SELECT conv_id, count(*) AS n_turns,
                   string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                   coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                   sum(length('<|im_start|>') + length(role) + 1 + length('<|im_end|>') + 1
                       + length(regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g'))) AS formatted_chars
            FROM messages GROUP BY conv_id)
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
               formatted_chars::BIGINT AS formatted_chars
        FROM joined""",
    "op2_decontamination": rf"""
        WITH d AS (SELECT doc_id, {_ALNUM} AS w FROM documents),
        b AS (SELECT item_id::VARCHAR AS item, {_ALNUM} AS w FROM benchmark),
        sized AS (SELECT item, w, least(13, len(w)) AS size FROM b WHERE len(w) > 0),
        starts AS (SELECT item, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM sized),
        grams AS (SELECT DISTINCT item, size, array_to_string(w[k:k + size - 1], ' ') AS gram FROM starts),
        sizes AS (SELECT DISTINCT size FROM grams),
        places AS (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size),
        hits AS (SELECT p.doc_id, p.k, p.size, g.item FROM places p JOIN grams g
                 ON g.size = p.size AND g.gram = array_to_string(p.w[p.k:p.k + p.size - 1], ' ')),
        words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + size)) AS k FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
                  FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
        SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
               sha256(coalesce(names, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
        FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op3_warc_index": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
        largest AS (SELECT html, max(page_id) AS page FROM p WHERE octet_length(encode(html)) >= 1000 GROUP BY html)
        SELECT page_id, octet_length(encode(p.html))::BIGINT AS payload_bytes, sha1(p.html) AS payload_digest,
               CASE WHEN page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page <> page_id THEN page END AS refers_to
        FROM p LEFT JOIN largest USING (html)""",
    "op4_substring_dedup": """
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
        cuts AS (SELECT doc_id, length(h) // 2 AS n, h, unnest(range(0, length(h) // 2, 256)) AS c FROM d),
        cut AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, 612) AS h FROM cuts),
        bytes AS (SELECT doc_id, n, c, h, unnest(range(0, least(256, n - c))) AS k FROM cut),
        marked AS (SELECT doc_id, c + k AS k, substr(h, 2 * k + 1, 2) AS b,
                          CASE WHEN c + k + 50 <= n THEN min(doc_id) OVER (PARTITION BY substr(h, 2 * k + 1, 100)) < doc_id
                               ELSE false END AS later FROM bytes),
        gone AS (SELECT doc_id, k, b, bool_or(later) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
                 FROM marked),
        runs AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), false) AS opens FROM gone),
        kept AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
                        string_agg(b, '' ORDER BY k) FILTER (NOT gone) AS kept FROM runs GROUP BY doc_id)
        SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               sha256(unhex(coalesce(kept, ''))) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_line_dedup": r"""
        WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
        w AS (SELECT doc_id, l, unnest(range(1, len(l) - 1)) AS k FROM d),
        later AS (SELECT doc_id, k FROM w WHERE regexp_matches(l[k] || l[k + 1] || l[k + 2], '[^\x20\x09-\x0D]')
                  QUALIFY row_number() OVER (PARTITION BY l[k], l[k + 1], l[k + 2] ORDER BY doc_id, k) > 1),
        gone AS (SELECT DISTINCT doc_id, k + unnest([0, 1, 2]) AS k FROM later),
        lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS k, unnest(l) AS line FROM d),
        runs AS (SELECT lines.*, gone.k IS NOT NULL AS gone FROM lines LEFT JOIN gone USING (doc_id, k)),
        opened AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY k), false) AS opens FROM runs),
        kept AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans,
                        coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '') AS kept FROM opened GROUP BY doc_id)
        SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
               length(kept)::BIGINT AS kept_chars, sha256(kept) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op7_jaccard_join": rf"""
        WITH RECURSIVE d AS (SELECT doc_id, {_SPACED} AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS g
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS k FROM d WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n, string_agg(g, chr(10) ORDER BY g) AS whole FROM s GROUP BY doc_id),
        common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        sides AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach AS (SELECT doc_id, doc_id AS root FROM d UNION SELECT sides.b, reach.root FROM reach JOIN sides ON sides.a = reach.doc_id),
        classes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY whole) AS class_id FROM n)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(class_id, d.doc_id) AS class_id, min(root) AS component_id
        FROM d LEFT JOIN n USING (doc_id) LEFT JOIN classes USING (doc_id) JOIN reach USING (doc_id)
        GROUP BY d.doc_id, n.n, class_id""",
    "op11_source_divergence": rf"""
        WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          regexp_extract_all({_FOLD.format("coalesce(text, '')")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
        words AS (SELECT doc, lang, source, unnest(w) AS term FROM d),
        kept AS (SELECT lang, term FROM words GROUP BY ALL HAVING count(DISTINCT doc) >= 10),
        counts AS (SELECT lang, source, term, count(*)::HUGEINT AS c FROM words JOIN kept USING (lang, term) GROUP BY ALL),
        langs AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
        groups AS (SELECT DISTINCT d.lang, d.source, coalesce(v, 0)::HUGEINT AS v FROM d LEFT JOIN langs USING (lang)),
        sized AS (SELECT g.lang, g.source, any_value(v) AS v, coalesce(sum(c), 0)::HUGEINT AS n FROM groups g LEFT JOIN counts USING (lang, source) GROUP BY ALL),
        whole AS (SELECT lang, any_value(v) AS v, sum(n)::HUGEINT AS n FROM sized GROUP BY lang),
        p AS (SELECT s.lang, s.source, k.term, coalesce(c, 0) AS c, 1 + (1000000000 * (coalesce(c, 0) + 2)) // (s.n + 2 * s.v) AS p
              FROM sized s JOIN kept k USING (lang) LEFT JOIN counts USING (lang, source, term)),
        q AS (SELECT lang, term, 1 + (1000000000 * (sum(c)::HUGEINT + 2)) // (any_value(w.n) + 2 * any_value(w.v)) AS q
              FROM counts JOIN whole w USING (lang) GROUP BY lang, term),
        pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item,
                         coalesce((SELECT sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) FROM p x JOIN p y USING (lang, term)
                                   WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0)::BIGINT AS value
                  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source),
        terms AS (SELECT lang, source, 'term' AS part, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value
                  FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank
                   FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
        SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10""",
    "op12_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || doc_id) AS h,
                          regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u FROM documents),
        cut AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS r1, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS r2,
                       CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') OR ('0x' || h[17:24])::BIGINT % 100 >= 50 THEN 'plain'
                            WHEN ('0x' || h[25:32])::BIGINT % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
        parts AS (SELECT *, array_to_string(u[1:least(r1, r2)], '') AS prefix, array_to_string(u[least(r1, r2) + 1:greatest(r1, r2)], '') AS middle,
                         array_to_string(u[greatest(r1, r2) + 1:], '') AS suffix FROM cut)
        SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                      ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
        FROM parts""",
}
