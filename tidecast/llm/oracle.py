"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

#: Words without ASCII white space, A-Z lower-cased (fixed values of the queries' contract).
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORD = r"[^\x20\x09-\x0D]+"

JACCARD = f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(coalesce({_LOWER}, ''), '{_WORD}') AS w FROM documents),
sets AS (
    SELECT doc_id, list_distinct(CASE
        WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s
    FROM words),
elements AS (SELECT doc_id, len(s) AS n, unnest(s) AS e FROM sets),
links AS (
    SELECT a.doc_id AS a, b.doc_id AS b FROM elements a JOIN elements b ON a.e = b.e AND a.doc_id < b.doc_id
    GROUP BY a.doc_id, b.doc_id, a.n, b.n
    HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (
    SELECT a, b FROM edges
    UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a)
SELECT doc_id, len(s) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id
FROM sets LEFT JOIN (SELECT a, min(b) AS low FROM reach GROUP BY a) ON a = doc_id"""

TOP_PRODUCTS = """
WITH vectors AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id AND q.vec_id % 100 = 0),
ranked AS (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 10"""

MIX = f"""
WITH counted AS (
    SELECT doc_id, coalesce(source, '') AS source,
           len(regexp_extract_all(coalesce(text, ''), '{_WORD}')) AS n_tokens
    FROM documents),
totals AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM counted GROUP BY source),
shares AS (SELECT *, tokens / (SELECT sum(tokens) FROM totals) AS p FROM totals WHERE tokens > 0),
tried AS (
    SELECT i / 10000 AS a, ln(sum(p ** (i / 10000))) - i / 10000 * sum(p ** (i / 10000) * ln(p)) / sum(p ** (i / 10000))
               >= 0.97 * ln(count(*)) AS even,
           (max(p) / min(p)) ** (1 - i / 10000) <= 2.0 AS rare
    FROM shares, range(0, 10001) AS grid(i) GROUP BY i),
chosen AS (
    SELECT greatest(coalesce(max(a) FILTER (even), 0), coalesce(min(a) FILTER (rare), 1)) AS a FROM tried),
weighted AS (SELECT source, p ** a / sum(p ** a) OVER () AS weight FROM shares, chosen),
budgets AS (
    SELECT source, tokens, greatest(1, ceil(tokens / 1000000))::BIGINT AS blocks,
           CASE WHEN tokens > 0 THEN greatest(round(weight * max(tokens / weight) OVER ())::BIGINT, tokens)
                ELSE 0 END AS budget
    FROM totals LEFT JOIN weighted USING (source)),
dealt AS (
    SELECT *, ('0x' || substr(md5(doc_id || ':1'), 1, 8))::BIGINT % blocks AS block,
           CASE WHEN tokens > 0 THEN ceil(budget / tokens)::INTEGER ELSE 1 END AS epochs
    FROM counted JOIN budgets USING (source)),
visits AS (SELECT *, unnest(range(0, epochs))::INTEGER AS epoch FROM dealt),
placed AS (
    SELECT *, coalesce(sum(n_tokens) OVER (
               PARTITION BY source
               ORDER BY epoch, md5(source || ':' || block || ':' || epoch || ':1'),
                        md5(doc_id || ':' || epoch || ':1'), n_tokens
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
    FROM visits)
SELECT doc_id, source, epoch, block, start, n_tokens FROM placed
WHERE start < budget OR (n_tokens = 0 AND start <= budget)"""

#: CRC-32 of the bytes of ``text``, bit by bit; the number is its reversed polynomial (fixed value).
_CRC = """
    xor(list_reduce(
        list_transform(range(0, strlen({text})), lambda i: ('0x' || substr(hex({text}), 2 * i + 1, 2))::BIGINT),
        lambda c, b: list_reduce(
            [0::BIGINT, 0, 0, 0, 0, 0, 0, 0],
            lambda z, q: CASE WHEN z & 1 = 1 THEN xor(z >> 1, 3988292384) ELSE z >> 1 END,
            xor(c, b)),
        4294967295::BIGINT), 4294967295::BIGINT)"""

SPELLING = f"""
WITH RECURSIVE spelled AS (
    SELECT doc_id, {_LOWER.replace("text", "run")} AS run, count(*) AS n
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]+')) AS run FROM documents)
    WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT *, doc_id || ':' || run AS t FROM spelled),
checked AS (SELECT run, n, coalesce({_CRC.format(text="t")}, 1) AS h FROM hashed),
thinned AS (
    SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
           ELSE run END AS word, n
    FROM checked),
words AS (
    SELECT word, sum(n)::BIGINT AS n FROM thinned WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
shorter AS (
    SELECT word, i, substr(word, 1, i) || substr(word, i + 2) AS v
    FROM (SELECT word, unnest(range(0, length(word))) AS i FROM words)),
less AS (SELECT DISTINCT s.word AS a, w.word AS b FROM shorter s JOIN words w ON s.v = w.word),
pairs AS (
    SELECT a, b FROM less UNION SELECT b, a FROM less
    UNION SELECT s.word, r.word FROM shorter s JOIN shorter r ON s.v = r.v AND s.i = r.i AND s.word <> r.word),
ranked AS (
    SELECT a AS word, b AS form, n AS form_n, count(*) OVER (PARTITION BY a) AS n_near
    FROM pairs JOIN words ON b = word QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, b) = 1),
formed AS (
    SELECT w.word, n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * n THEN form END AS form,
           CASE WHEN form_n >= 10 * n THEN form_n END AS form_n
    FROM words w LEFT JOIN ranked USING (word)),
walked AS (
    SELECT word, word AS root, form AS up FROM formed
    UNION ALL SELECT w.word, f.word, f.form FROM walked w JOIN formed f ON w.up = f.word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN (SELECT * FROM walked WHERE up IS NULL) USING (word)"""


def _clusters(rounds: int) -> str:
    """Assignments and moves of the centroids, one after the other."""

    def assigned(i: int) -> str:
        return f"""
a{i} AS MATERIALIZED (
    SELECT row, vec_id, v, k, d FROM (
        SELECT row, x.vec_id, x.v, c.k, list_sum(list_transform(x.v, lambda e, i: (e - c.v[i]) * (e - c.v[i])))::BIGINT AS d
        FROM kept x, c{i} c)
    QUALIFY row_number() OVER (PARTITION BY row ORDER BY d, k) = 1)"""

    moves = "".join(
        f"""{assigned(i)},
c{i + 1} AS MATERIALIZED (
    SELECT k, coalesce(m, v) AS v FROM c{i} LEFT JOIN (
        SELECT k, list(((s - (s % n + n) % n) // n)::BIGINT ORDER BY i) AS m FROM (
            SELECT k, i, sum(e) AS s, count(*) AS n
            FROM (SELECT k, unnest(v) AS e, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY k, i)
        GROUP BY k) USING (k)),"""
        for i in range(rounds)
    )
    return f"""
WITH kept AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) = 64
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
    SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), v) - 1 AS k, v FROM kept QUALIFY k < 40),{moves}{assigned(rounds)}
SELECT vec_id, k::INTEGER AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
       (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} c USING (k)"""


CLUSTERS = _clusters(5)

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard": JACCARD,
    "op3_temperature_mix": MIX,
    "op7_norm_bucket_topk": TOP_PRODUCTS,
    "op11_spelling_forms": SPELLING,
    "op12_threshold_clusters": CLUSTERS,
}
