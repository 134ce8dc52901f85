"""SQL twins (DuckDB) of the queries that SQL can express, over the driver's views."""

from __future__ import annotations

from weekcast.llm.quality_rules import BUCKETS, RAW_SHARE, THRESHOLD

#: Every window of 50 bytes as hex, the least id that has it, runs of windows of documents with larger ids.
SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
-- by blocks of 500 bytes first: taking a part of a long string costs its length
block AS (SELECT doc_id, k, substr(h, CAST(1000 * k + 1 AS BIGINT), 1098) AS part
          FROM (SELECT doc_id, h, unnest(range(0, length(h) // 1000 + 1)) AS k FROM d)),
w AS (SELECT doc_id, 500 * k + j AS i, substr(part, CAST(2 * j + 1 AS BIGINT), 100) AS s
      FROM (SELECT doc_id, k, part, unnest(range(0, least(500, length(part) // 2 - 49))) AS j FROM block)),
least AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.i FROM w JOIN least USING (s) WHERE w.doc_id > least.first_id),
edge AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit),
island AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM edge),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM island GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, b, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS before FROM span),
cut AS (SELECT gap.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS last_b,
        string_agg(substr(h, CAST(2 * before + 1 AS BIGINT), CAST(2 * (a - before) AS BIGINT)), '' ORDER BY a) AS head
        FROM gap JOIN d ON d.doc_id = gap.doc_id GROUP BY gap.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head, '') || substr(h, CAST(2 * coalesce(last_b, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
"""

QUALITY_RULES = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
           hex(encode(coalesce(text, ''))) AS h FROM documents),
five AS (SELECT doc_id, i, array_to_string(words[i:i + 4], ' ') AS g
         FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM d)),
again AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM five) WHERE n > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest([0, 1, 2, 3, 4]) AS k) GROUP BY doc_id),
line AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d)
         WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         coalesce(line.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words
         FROM d LEFT JOIN line ON line.doc_id = d.doc_id LEFT JOIN repeated ON repeated.doc_id = d.doc_id),
block AS (SELECT doc_id, substr(h, CAST(1000 * k + 1 AS BIGINT), 1006) AS part
          FROM (SELECT doc_id, h, unnest(range(0, length(h) // 1000 + 1)) AS k FROM d)),
gram AS (SELECT doc_id, CAST('0x' || substr(g, 7, 2) || substr(g, 5, 2) || substr(g, 3, 2) || substr(g, 1, 2) AS BIGINT) AS code
         FROM (SELECT doc_id, substr(part, CAST(2 * j + 1 AS BIGINT), 8) AS g
               FROM (SELECT doc_id, part, unnest(range(0, least(500, length(part) // 2 - 3))) AS j FROM block))),
hashed AS (SELECT doc_id, ((CAST(code AS HUGEINT) * 2654435761) % 4294967296) // 32768 % {BUCKETS} AS bucket FROM gram),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1),
counted AS (SELECT bucket, count(*) AS r, count(trusted.doc_id) AS t FROM hashed LEFT JOIN trusted USING (doc_id) GROUP BY bucket),
weight AS (SELECT bucket, CASE WHEN sum(t) OVER () = 0 THEN 0.0 ELSE ln({1 - RAW_SHARE} * ((1.0 + t) / (sum(t) OVER () + {BUCKETS}))
           / ((1.0 + r) / (sum(r) OVER () + {BUCKETS})) + {RAW_SHARE}) END AS w FROM counted),
ratio AS (SELECT doc_id, sum(w) / count(*) AS llr FROM hashed JOIN weight USING (bucket) GROUP BY doc_id),
failed AS (SELECT base.*, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, coalesce(llr, 0.0) AS llr
           FROM base LEFT JOIN ratio ON ratio.doc_id = base.doc_id)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND llr >= {THRESHOLD} AS kept, round(llr, 6) AS llr FROM failed
"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
           AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
           FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10
"""

#: Base32 from the hex digest: five hex digits are twenty bits, four letters.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex_digest FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 +
      (CAST('0x' || substr(hex_digest, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) // (32768 // CAST(pow(32, i % 4) AS BIGINT))) % 32 AS BIGINT), 1)), '')
      AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last_id FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN page_id = last_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> last_id THEN last_id END AS refers_to FROM b
"""



def _crc32(text: str) -> str:
    """CRC-32 of an ASCII text: each byte enters, then eight shifts."""
    steps = f"flatten(list_transform(range(1, length({text}) + 1), lambda i: [CAST(ascii(substr({text}, i, 1)) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {steps}), lambda c, o: CASE WHEN o >= 0 THEN xor(c, o) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"


def _leaf(*values: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen(CAST({v} AS VARCHAR)) || ':' || CAST({v} AS VARCHAR), '-')" for v in values) + ")"


#: Trees level by level; a path is a document's row for each level, its side and sibling null where it stands alone.
MERKLE = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf("doc_id", "source", "lang", "n_chars", "text")} AS leaf,
       CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("doc_id", "source", "lang", "n_chars + 1", "text")} END AS tampered FROM documents),
base AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id, leaf) - 1 AS pos FROM d),
node AS (SELECT 0 AS lvl, tree, pos, leaf AS h FROM base
         UNION ALL SELECT lvl + 1, tree, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
         FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM node) WHERE n > 1 GROUP BY lvl, tree, pos // 2),
depth AS (SELECT tree, max(lvl) AS depth FROM node GROUP BY tree),
sub AS (SELECT node.tree, h, depth, row_number() OVER (ORDER BY node.tree) - 1 AS pos FROM node JOIN depth ON depth.tree = node.tree AND lvl = depth),
high AS (SELECT 0 AS lvl, pos, h FROM sub
         UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos))
         FROM (SELECT *, count(*) OVER () AS n FROM high) WHERE n > 1 GROUP BY lvl, pos // 2),
root AS (SELECT h FROM high ORDER BY lvl DESC LIMIT 1),
low_path AS (SELECT base.doc_id, lvls.lvl AS step, (base.pos >> lvls.lvl) & 1 AS odd, node.h AS sib
             FROM base JOIN depth USING (tree) JOIN (SELECT unnest(range(0, 64)) AS lvl) lvls ON lvls.lvl < depth.depth
             LEFT JOIN node ON node.tree = base.tree AND node.lvl = lvls.lvl AND node.pos = xor(base.pos >> lvls.lvl, 1)),
high_path AS (SELECT base.doc_id, sub.depth + lvls.lvl AS step, (sub.pos >> lvls.lvl) & 1 AS odd, high.h AS sib
              FROM base JOIN sub USING (tree) JOIN (SELECT unnest(range(0, 64)) AS lvl) lvls ON lvls.lvl < (SELECT max(lvl) FROM high)
              LEFT JOIN high ON high.lvl = lvls.lvl AND high.pos = xor(sub.pos >> lvls.lvl, 1)),
path AS (SELECT * FROM low_path UNION ALL SELECT * FROM high_path),
proof AS (SELECT doc_id, sha256(coalesce(string_agg(sib, '' ORDER BY step), '')) AS proof_sha256, count(*) AS steps FROM path GROUP BY doc_id),
folded AS (SELECT doc_id, CAST(0 AS BIGINT) AS step, coalesce(tampered, leaf) AS h FROM d
           UNION ALL SELECT f.doc_id, f.step + 1, sha256(CASE WHEN p.sib IS NULL THEN f.h WHEN p.odd = 1 THEN p.sib || f.h ELSE f.h || p.sib END)
           FROM folded f JOIN path p ON p.doc_id = f.doc_id AND p.step = f.step),
last AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM folded GROUP BY doc_id)
SELECT base.doc_id, leaf, sub.h AS subroot, root.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root.h AS verified
FROM base JOIN sub USING (tree) CROSS JOIN root LEFT JOIN proof ON proof.doc_id = base.doc_id JOIN last ON last.doc_id = base.doc_id
"""

#: Rows of a conversation one by one; for each state of the grammar the least (cost, audit) and what it leaves.
#: Between two rows at most two inserts: a third leads back to a state that one leads to.
CONVERSATION_REPAIR = f"""
WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("w")} % 20 AS k
       FROM (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS w FROM conversations)),
damaged AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
                   CASE WHEN k = 1 THEN '' WHEN k = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
            FROM c, (SELECT unnest([1, 2]) AS time) WHERE k <> 0 AND (time = 1 OR k = 3)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM damaged),
fact AS (SELECT conv_id, turn, role, text, i, substr(role, 1, 1) AS ini, lag(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY i) || substr(role, 1, 1) AS pair,
                CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
                     WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
                     WHEN regexp_matches(text, '[^.!?\\x20\\x09-\\x0D][\\x20\\x09-\\x0D]*$') THEN 't' ELSE '' END AS fault FROM numbered),
stats AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
                 count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                 count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM fact GROUP BY conv_id),
inserts(src, dst, k, rows) AS (VALUES (0, 0, 0, []), (1, 1, 0, []), (2, 2, 0, []), (3, 3, 0, []),
       (0, 2, 1, ['user:']), (1, 2, 1, ['user:']), (2, 3, 1, ['assistant:']), (3, 2, 1, ['user:']),
       (0, 3, 2, ['user:', 'assistant:']), (1, 3, 2, ['user:', 'assistant:'])),
edit(op, src, dst, ini, role) AS (VALUES ('D', 0, 0, NULL, NULL), ('D', 1, 1, NULL, NULL), ('D', 2, 2, NULL, NULL), ('D', 3, 3, NULL, NULL),
       ('K', 0, 1, 's', NULL), ('K', 0, 2, 'u', NULL), ('K', 1, 2, 'u', NULL), ('K', 2, 3, 'a', NULL), ('K', 3, 2, 'u', NULL),
       ('R', 0, 2, NULL, 'user'), ('R', 1, 2, NULL, 'user'), ('R', 2, 3, NULL, 'assistant'), ('R', 3, 2, NULL, 'user')),
best AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, 0 AS state, CAST(0 AS BIGINT) AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS body FROM stats
         UNION ALL
         SELECT conv_id, i, state, arg_min(cost, rank), arg_min(audit, rank), arg_min(body, rank) FROM (
           SELECT *, lpad(CAST(cost AS VARCHAR), 12, '0') || audit AS rank FROM (
             SELECT f.conv_id, f.i, e.dst AS state,
                    b.cost + 2 * s.k + CASE e.op WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END + CASE WHEN e.op <> 'D' AND f.fault = 't' THEN 1 ELSE 0 END AS cost,
                    b.audit || repeat('I', s.k) || e.op AS audit,
                    list_concat(b.body, s.rows, CASE e.op WHEN 'D' THEN [] WHEN 'K' THEN [f.role || ':' || f.text] ELSE [e.role || ':' || f.text] END) AS body
             FROM best b JOIN fact f ON f.conv_id IS NOT DISTINCT FROM b.conv_id AND f.i = b.i + 1 JOIN inserts s ON s.src = b.state
             JOIN edit e ON e.src = s.dst AND (e.op = 'D' OR f.fault NOT IN ('b', 'd')) AND (e.op <> 'K' OR e.ini = f.ini)))
         GROUP BY conv_id, i, state),
done AS (SELECT conv_id, arg_min(cost, rank) AS cost, arg_min(audit, rank) AS audit, arg_min(body, rank) AS body FROM (
           SELECT *, lpad(CAST(cost AS VARCHAR), 12, '0') || audit AS rank FROM (
             SELECT b.conv_id, b.cost + 2 * s.k AS cost, b.audit || repeat('I', s.k) AS audit, list_concat(b.body, s.rows) AS body
             FROM best b JOIN stats ON stats.conv_id IS NOT DISTINCT FROM b.conv_id AND stats.n = b.i JOIN inserts s ON s.src = b.state AND s.dst IN (0, 3)))
         GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
       coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(body, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN done ON done.conv_id IS NOT DISTINCT FROM o.conv_id
"""

#: Every window of 50 words, the least id that has it, and the words that windows of documents with larger ids cover.
SUBSTRING_DEDUP = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
w AS (SELECT doc_id, i, array_to_string(words[i:i + 49], ' ') AS s FROM (SELECT doc_id, words, unnest(range(1, len(words) - 48)) AS i FROM d)),
least AS (SELECT s, min(doc_id) AS first_id FROM w GROUP BY s),
hit AS (SELECT w.doc_id, w.i FROM w JOIN least USING (s) WHERE w.doc_id > least.first_id),
word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM d),
near AS (SELECT word.doc_id, word.word, word.i, max(hit.i) OVER (PARTITION BY word.doc_id ORDER BY word.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) IS NULL AS stays
         FROM word LEFT JOIN hit ON hit.doc_id = word.doc_id AND hit.i = word.i),
cut AS (SELECT doc_id, count(*) FILTER (NOT stays) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (stays) AS kept FROM near GROUP BY doc_id)
SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN cut ON cut.doc_id = d.doc_id
"""

SQL = {
    "op13_substring_dedup": SUBSTRING_DEDUP,
    "op12_conversation_repair": CONVERSATION_REPAIR,
    "op11_merkle": MERKLE,
    "op1_suffix_dedup": SUFFIX_DEDUP,
    "op3_quality_rules": QUALITY_RULES,
    "op6_topk": TOP_K,
    "op9_warc": WARC,
}
