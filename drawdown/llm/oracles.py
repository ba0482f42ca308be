"""DuckDB SQL of the corpus queries that SQL can express on whole tables."""

DECONTAMINATION = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
ip AS (SELECT item, w, least(10,len(w)) AS n, unnest(range(len(w)-least(10,len(w))+1)) AS i FROM iw WHERE len(w) > 0),
pt AS (SELECT DISTINCT item, n, array_to_string(w[i+1:i+n],' ') AS g FROM ip),
sz AS (SELECT DISTINCT n FROM pt),
dp AS (SELECT doc_id, w, n, unnest(range(len(w)-n+1)) AS j FROM dw, sz WHERE len(w) >= n),
ds AS (SELECT doc_id, n, j, array_to_string(w[j+1:j+n],' ') AS g FROM dp),
oc AS (SELECT doc_id, j, d.n, item FROM ds d JOIN pt USING (n, g)),
ht AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(j,j+n)) AS p FROM oc) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item,',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM oc) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, sha256(coalesce(items,'')) AS items_sha256, coalesce(n_hit,0) > 0 AS contaminated FROM dw LEFT JOIN ht USING (doc_id) LEFT JOIN it USING (doc_id)"""


def _clusters(rounds: int = 3) -> str:
    """Three rounds over (vec_id, d, x) rows, unrolled."""
    steps = ["""WITH kept AS (SELECT row_number() OVER () AS r, vec_id, embedding FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
v AS MATERIALIZED (SELECT r, vec_id, d, CAST(floor(64 * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, 65) t(d)),
s AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS c FROM kept QUALIFY c < 16),
c0 AS MATERIALIZED (SELECT c, d, x AS m FROM v JOIN s USING (r))"""]
    for i in range(rounds + 1):
        steps.append(f"""f{i} AS (SELECT r, any_value(vec_id) AS vec_id, c, CAST(sum((x - m) * (x - m)) AS BIGINT) AS far FROM v JOIN c{i} USING (d) GROUP BY r, c),
a{i} AS MATERIALIZED (SELECT * FROM f{i} QUALIFY row_number() OVER (PARTITION BY r ORDER BY far, c) = 1)""")
        if i < rounds:
            steps.append(f"""n{i} AS (SELECT c, d, CAST(sum(x) AS BIGINT) AS t, count(*) AS n FROM v JOIN a{i} USING (r) GROUP BY c, d),
c{i + 1} AS MATERIALIZED (SELECT c, d, coalesce((t - ((t % n) + n) % n) // n, m) AS m FROM c{i} LEFT JOIN n{i} USING (c, d))""")
    last = f"c{rounds}"
    return ",\n".join(steps) + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, far AS distance, CAST(sum(far) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(far) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} JOIN (SELECT c, sha256(string_agg(CAST(m AS VARCHAR), ',' ORDER BY d)) AS h FROM {last} GROUP BY c) USING (c)"""


CENTROIDS = _clusters()

#: The checksum of a number's digits is a fold over [start, byte, -1 eight times, byte, ...]: a byte is mixed in, -1 shifts by one bit.
TRIE = r"""
WITH t AS (SELECT conv_id AS c, role, txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, substr(sha256(CAST(strlen(role) AS VARCHAR) || ':' || role || txt), 1, 32)) - 1 AS pos
  FROM (SELECT conv_id, turn, coalesce(role,'') AS role, coalesce(text,'') AS txt FROM conversations WHERE conv_id IS NOT NULL)),
h AS (SELECT c, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: [CAST(ord(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, (a & 1) * 3988292384) END), 4294967295) % 4 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT h.c, 0 AS own, pos, role, txt FROM h JOIN t ON t.c = h.c - h.c % 20 AND pos < h UNION ALL SELECT h.c, 1, pos, role, txt FROM h JOIN t ON t.c = h.c AND pos >= h),
p AS (SELECT h.c, coalesce(list({'role': role, 'txt': txt} ORDER BY own, pos) FILTER (own IS NOT NULL), []) AS path FROM h LEFT JOIN r ON r.c = h.c GROUP BY h.c),
m AS (SELECT c, d, len(path) = d AS last, path[1:d] AS k FROM p, LATERAL (SELECT unnest(range(0, len(path) + 1)) AS d)),
n AS MATERIALIZED (SELECT k, d, min(c) AS c, count(*) AS n, (count(*) - 1) * CASE WHEN d = 0 THEN 0 ELSE len(regexp_extract_all(k[d].txt, '[^\x20\x09-\x0D]+')) END AS w,
  coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (last), '') AS ends FROM m GROUP BY k, d),
b AS (SELECT k[1:d-1] AS k, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1),
f AS MATERIALIZED (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN b USING (k)),
u AS (SELECT k[1:e] AS k, sum((n_children = 0)::INT) AS leaves, sum(w) AS saved FROM f, LATERAL (SELECT unnest(range(0, d + 1)) AS e) GROUP BY 1)
SELECT f.c AS conv_id, f.d AS depth, q.c AS parent_conv_id, f.n AS n_convs, f.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(f.ends) AS ends_sha256
FROM f JOIN u USING (k) LEFT JOIN n q ON f.d > 0 AND q.k = f.k[1:f.d-1]"""
