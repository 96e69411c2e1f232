"""SQL twins, for DuckDB over the same tables, of the operators that SQL can express."""

SHARDING = """
WITH RECURSIVE steps AS (
    SELECT b, b AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b)
    UNION ALL
    SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
bytes AS (SELECT *, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bs FROM documents),
rows AS (
    SELECT doc_id, len(bs) + 8 AS size,
        xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) AS text_crc32,
        coalesce('=' || source, '') AS stratum, md5('mix:' || coalesce(doc_id::VARCHAR, '')) AS draw
    FROM bytes, crc_table
),
placed AS (
    SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY draw, doc_id, text_crc32, size) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS place
    FROM rows
),
cut AS (SELECT *, row_number() OVER (ORDER BY place, stratum, draw, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM placed)
SELECT doc_id, size, text_crc32, 'rows' AS law, (pos * 24 // n)::INTEGER AS shard,
    pos - ((pos * 24 // n) * n + 23) // 24 AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""

REPEATS = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 400)) AS m FROM (SELECT doc_id, h, unnest(range(0, greatest(length(h) // 2 - 199, 0))) AS i FROM d)),
r AS (SELECT doc_id, i FROM w QUALIFY count(*) OVER (PARTITION BY m) > 1),
f AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 200 THEN 1 ELSE 0 END AS fresh FROM r),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM f),
s AS (SELECT doc_id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY doc_id, grp),
p AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS c FROM s),
k AS (
    SELECT doc_id, string_agg(substr(h, 2 * c + 1, 2 * (a - c)), '' ORDER BY a) AS head, max(b) AS b, sum(b - a) AS n_removed, count(*) AS n_spans
    FROM p JOIN d USING (doc_id) GROUP BY doc_id
)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(b, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""

MANIFEST = """
WITH RECURSIVE steps AS (
    SELECT b, b AS c, 0 AS k FROM (SELECT unnest(range(256)) AS b)
    UNION ALL
    SELECT b, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, k + 1 FROM steps WHERE k < 8
),
crc_table AS (SELECT list(c ORDER BY b) AS t FROM steps WHERE k = 8),
d AS (
    SELECT doc_id, source, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda x: ('0x' || x)::BIGINT) AS bs,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-')
            || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
        coalesce(strlen(text) || ':' || text, '-') AS body,
        coalesce(strlen(text) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low
    FROM documents
),
h AS (
    SELECT doc_id, coalesce('=' || source, '') AS s, sha256(head || body) AS leaf,
        CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, bs), lambda a, x: xor(a // 256, t[xor(a % 256, x) + 1])), 4294967295) % 5 = 0
            THEN sha256(head || low) ELSE sha256(head || body) END AS claim
    FROM d, crc_table
),
leaves AS (
    SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY s) AS n, dense_rank() OVER (ORDER BY s) - 1 AS tree
    FROM h
),
lv AS (
    SELECT tree, 0 AS lvl, pos, n, leaf AS dig FROM leaves
    UNION ALL
    SELECT tree, lvl + 1, pos // 16, max(n + 15) // 16, sha256(string_agg(dig, '' ORDER BY pos)) FROM lv WHERE n > 1 GROUP BY tree, lvl, pos // 16
),
sub AS (SELECT tree, lvl AS height, dig AS subroot, count(*) OVER () AS trees FROM lv WHERE n = 1),
top AS (
    SELECT 0 AS lvl, tree AS pos, trees AS n, subroot AS dig FROM sub
    UNION ALL
    SELECT lvl + 1, pos // 16, max(n + 15) // 16, sha256(string_agg(dig, '' ORDER BY pos)) FROM top WHERE n > 1 GROUP BY lvl, pos // 16
),
runs AS (
    SELECT tree, lvl, pos, coalesce(string_agg(dig, '') OVER (PARTITION BY tree, lvl, pos // 16 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
        coalesce(string_agg(dig, '') OVER (PARTITION BY tree, lvl, pos // 16 ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
    FROM (SELECT tree, lvl, pos, dig FROM lv WHERE n > 1 UNION ALL SELECT -1, lvl, pos, dig FROM top WHERE n > 1)
),
walk AS (
    SELECT tree, tree AS here, 0 AS lvl, pos, n, pos AS own, '' AS proof, claim AS acc FROM leaves
    UNION ALL
    SELECT w.tree, CASE WHEN w.n = 1 THEN -1 ELSE w.here END, CASE WHEN w.n = 1 THEN 0 ELSE w.lvl + 1 END, CASE WHEN w.n = 1 THEN w.tree ELSE w.pos // 16 END,
        CASE WHEN w.n = 1 THEN sub.trees ELSE (w.n + 15) // 16 END, w.own, w.proof || coalesce(r.before || r.after, ''),
        CASE WHEN w.n = 1 THEN w.acc ELSE sha256(r.before || w.acc || r.after) END
    FROM walk w JOIN sub ON sub.tree = w.tree LEFT JOIN runs r ON r.tree = w.here AND r.lvl = w.lvl AND r.pos = w.pos WHERE w.n > 1 OR w.here >= 0
),
done AS (SELECT tree, own, sha256(proof) AS proof_sha256, acc AS folded_root FROM walk WHERE here = -1 AND n = 1),
root AS (SELECT dig AS root FROM top WHERE n = 1)
SELECT l.doc_id, l.leaf, sub.subroot, root.root, done.proof_sha256, done.folded_root, done.folded_root = root.root AS verified
FROM leaves l JOIN sub USING (tree) JOIN done ON done.tree = l.tree AND done.own = l.pos CROSS JOIN root
"""

RANKED = r"""
WITH lowered AS (SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x FROM documents),
items AS (
    SELECT DISTINCT item_id, t FROM (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS t FROM benchmark
    )
),
d AS (SELECT row_number() OVER () AS r, doc_id, ts, len(ts) AS n FROM (SELECT doc_id, regexp_extract_all(x, '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts FROM lowered) WHERE len(ts) > 0),
size AS (SELECT count(*) AS docs, sum(n)::BIGINT AS len FROM d),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM items) GROUP BY r, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
w AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, size),
m AS (SELECT r, doc_id, n, 100 - 50 + (50 * n * docs) // len AS m FROM d, size),
s AS (
    SELECT item_id, r, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
    FROM items JOIN tf USING (t) JOIN w USING (t) JOIN m USING (r) GROUP BY item_id, r
),
k AS (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS FIRST, n) AS rank FROM s JOIN d USING (r) WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM k WHERE rank <= 50
"""
