"""SQL that DuckDB runs for the same rows as a query, where SQL can express it."""

from __future__ import annotations

#: Fixed values of the queries' parameters, written out apart from the operators', so that one checks the other: character
#: classes in the order in which they are taken out, common words of a language, words that a reference and a verdict need,
#: distances above which a document goes, and bytes from which an equal payload is a revisit.
CLASSES = ("[a-z]+", "[A-Z]+", "[0-9]+", r"\p{L}+", r"[.,;:!?'\"()\-]+")
COMMON, REFERENCE_WORDS, MIN_WORDS, CLASS_DISTANCE, WORD_DISTANCE, REVISIT_BYTES = 20, 2000, 60, 0.30, 0.40, 1000
_WHITE = r"[\x20\x09-\x0D]+"


def _classes(column: str) -> tuple[str, list[str]]:
    """CTE columns that take one class after another out of a column, and the expressions of their counts."""
    steps, left = [], column
    counts = []
    for i, pattern in enumerate(CLASSES):
        quoted = pattern.replace("'", "''")
        steps.append(f"regexp_replace({left}, '{quoted}', '', 'g') AS l{i}")
        counts.append(f"(length({left}) - length(l{i}))")
        left = f"l{i}"
    return ", ".join(steps), [*counts, f"length({left})"]


def _distance(p: str, q: str) -> str:
    part = lambda a, m: f"CASE WHEN {a} > 0 THEN {a} * log2({a} / {m}) / 2 ELSE 0 END"
    m = f"(({p}[i] + {q}[i]) / 2)"
    return f"sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {part(f'{p}[i]', m)} + {part(f'{q}[i]', m)}))))"


def op3() -> str:
    word_steps, word_counts = _classes("word")
    doc_steps, doc_counts = _classes("solid")
    n = range(len(word_counts))
    k = COMMON
    share = lambda counts, total: f"list_transform([{', '.join(counts)}], lambda c: CASE WHEN {total} > 0 THEN c / CAST({total} AS DOUBLE) ELSE 0 END)"
    sums = ", ".join(f"sum(c{i}) AS c{i}" for i in n)
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, doc_id, lang, text, regexp_replace(text, '{_WHITE}', '', 'g') AS solid, list_filter(regexp_split_to_array(text, '{_WHITE}'), lambda x: x <> '') AS w FROM d),
counted AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(w) AS word FROM w) GROUP BY lang, word),
classed AS (SELECT *, {word_steps} FROM counted),
low AS (SELECT lang, lower(word) AS word, sum(n) AS n, {', '.join(f'sum({c} * n) AS c{i}' for i, c in enumerate(word_counts))} FROM classed GROUP BY lang, lower(word)),
totals AS (SELECT lang, sum(n) AS total, {sums} FROM low GROUP BY lang),
own AS (SELECT * FROM totals WHERE total >= {REFERENCE_WORDS} AND lang IS NOT NULL),
top AS (SELECT lang, list(word ORDER BY n DESC, word) AS words, list(n ORDER BY n DESC, word) AS ns FROM (SELECT lang, word, n FROM low WHERE lang IS NOT NULL QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {k}) GROUP BY lang),
every AS (SELECT list(word ORDER BY n DESC, word) AS words, list(n ORDER BY n DESC, word) AS ns FROM (SELECT word, sum(n) AS n FROM low GROUP BY word ORDER BY n DESC, word LIMIT {k})),
refsrc AS (SELECT lang, total, {', '.join(f'c{i}' for i in n)}, words, ns FROM own JOIN top USING (lang)
    UNION ALL SELECT NULL, t.*, words, ns FROM (SELECT sum(total) AS total, {sums} FROM totals) t, every WHERE total > 0),
refs AS (SELECT lang AS ref_lang, {share([f'c{i}' for i in n], '(' + ' + '.join(f'c{i}' for i in n) + ')')} AS ref_classes, words AS ref_words,
    list_append(list_transform(ns, lambda x: x / CAST(total AS DOUBLE)), 1 - list_sum(list_transform(ns, lambda x: x / CAST(total AS DOUBLE)))) AS ref_shares FROM refsrc),
m AS (SELECT *, {doc_steps} FROM w),
j AS (SELECT m.*, len(w) AS n_words, r.* FROM m JOIN refs r ON (CASE WHEN lang IN (SELECT ref_lang FROM refs WHERE ref_lang IS NOT NULL) THEN lang END) IS NOT DISTINCT FROM r.ref_lang),
h AS (SELECT *, {share(doc_counts, 'length(solid)')} AS p, list_transform(ref_words, lambda r: len(list_filter(w, lambda x: lower(x) = r)) / CAST(n_words AS DOUBLE)) AS q0 FROM j),
q AS (SELECT *, list_append(q0, 1 - len(list_filter(w, lambda x: list_contains(ref_words, lower(x)))) / CAST(n_words AS DOUBLE)) AS q FROM h),
grams AS (SELECT rid, i, w[i:i + 4] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w WHERE len(w) >= 5)),
again AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS times FROM grams) WHERE times > 1),
rep AS (SELECT rid, sum(least(5, i - before)) AS n_repeat_words FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 5) AS before FROM again) GROUP BY rid),
v AS (SELECT q.rid, doc_id, n_words, length(solid) AS word_chars, length(solid) - length(translate(solid, '#*$%&|<>', '')) AS n_symbols, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, CASE WHEN n_words >= {MIN_WORDS} THEN {_distance('p', 'ref_classes')} END AS cd, CASE WHEN n_words >= {MIN_WORDS} THEN {_distance('q', 'ref_shares')} END AS wd FROM q LEFT JOIN rep USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    round(cd, 6) AS class_distance, round(wd, 6) AS word_distance, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT coalesce(cd > {CLASS_DISTANCE} OR wd > {WORD_DISTANCE}, false) AS kept FROM v"""


OP4 = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
s AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS payload_digest FROM p),
k AS (SELECT *, CASE WHEN payload_bytes >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY payload_digest) END AS keeper FROM s)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN keeper IS NOT NULL AND page_id IS DISTINCT FROM keeper THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN page_id IS DISTINCT FROM keeper THEN keeper END AS refers_to FROM k"""

OP9 = """
WITH RECURSIVE e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM low LEFT JOIN n USING (vec_id)"""


def op11(parts: int = 4, width: int = 16, entries: int = 256, rounds: int = 4) -> str:
    """Lloyd's rounds over all pairs of a part and an entry. Floored division is spelt out, as // cuts towards zero."""
    nearest = "SELECT rid, p, min({{'d': list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 'j': j}}) AS best FROM parts JOIN b{r} USING (p) GROUP BY rid, p"
    steps = ""
    for r in range(rounds):
        steps += f"""
a{r} AS MATERIALIZED ({nearest.format(r=r)}),
m{r} AS (SELECT p, best.j AS j, i, sum(x[i]) AS s, count(*) AS n FROM a{r} JOIN parts USING (rid, p), range(1, {width + 1}) AS t(i) GROUP BY ALL),
f{r} AS (SELECT p, j, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY i) AS c FROM m{r} GROUP BY p, j),
b{r + 1} AS MATERIALIZED (SELECT b.p, b.j, coalesce(f.c, b.c) AS c FROM b{r} b LEFT JOIN f{r} f ON b.p = f.p AND b.j = f.j),"""
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
parts AS MATERIALIZED (SELECT rid, vec_id, p, q[{width} * p + 1:{width} * p + {width}] AS x FROM kept, range({parts}) AS t(p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS j, x AS c FROM parts QUALIFY j < {entries}),{steps}
last AS ({nearest.format(r=rounds)}),
coded AS (SELECT rid, string_agg(lower(printf('%02x', best.j)), '' ORDER BY p) AS code, CAST(sum(best.d) AS BIGINT) AS error FROM last GROUP BY rid),
said AS (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, j, i)) AS codebooks_sha256 FROM (SELECT p, j, unnest(c) AS v, generate_subscripts(c, 1) AS i FROM b{rounds}))
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM kept JOIN coded USING (rid), said"""


OP13 = """
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS pid, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM p),
t AS (SELECT lang, pid, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w),
x AS (SELECT lang, word AS w1, lead(word, 1) OVER o AS w2, lead(word, 2) OVER o AS w3, lead(word, 3) OVER o AS w4, lead(word, 4) OVER o AS w5 FROM t WINDOW o AS (PARTITION BY pid ORDER BY i)),
g AS (SELECT lang, 1 AS m, w1 AS phrase FROM x UNION ALL SELECT lang, 2, w1 || ' ' || w2 FROM x WHERE w2 IS NOT NULL UNION ALL SELECT lang, 3, concat_ws(' ', w1, w2, w3) FROM x WHERE w3 IS NOT NULL
    UNION ALL SELECT lang, 4, concat_ws(' ', w1, w2, w3, w4) FROM x WHERE w4 IS NOT NULL UNION ALL SELECT lang, 5, concat_ws(' ', w1, w2, w3, w4, w5) FROM x WHERE w5 IS NOT NULL),
f AS MATERIALIZED (SELECT lang, m, phrase, string_split(phrase, ' ') AS g, f FROM (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase)),
n AS (SELECT lang, sum(f) AS n FROM f WHERE m = 1 GROUP BY lang),
c AS MATERIALIZED (SELECT * FROM f WHERE m > 1 AND f >= 100),
pairs AS (SELECT lang, phrase, f, k, array_to_string(g[1:k], ' ') AS head, array_to_string(g[k + 1:], ' ') AS tail FROM (SELECT *, unnest(range(1, m)) AS k FROM c)),
cuts AS (SELECT lang, pairs.phrase, k, pairs.f AS a, l.f AS l, r.f AS r, n, CAST(1000 AS HUGEINT) * pairs.f * n // (CAST(l.f AS HUGEINT) * r.f) AS score
    FROM pairs JOIN (SELECT lang, phrase AS head, f FROM f) AS l USING (lang, head) JOIN (SELECT lang, phrase AS tail, f FROM f) AS r USING (lang, tail) JOIN n USING (lang)),
low AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inner_ AS (SELECT lang, f, array_to_string(g[i:i + j - 1], ' ') AS phrase FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c))),
held AS (SELECT DISTINCT lang, phrase FROM inner_ JOIN c USING (lang, phrase) WHERE 100 * inner_.f >= 100 * c.f),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM low ANTI JOIN held USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked WHERE rank <= 2000"""

SQL = {"op3_distribution_divergence": op3(), "op4_warc_normaliser": OP4, "op9_embedding_pigeonhole": OP9, "op11_hamerly_codes": op11(), "op13_pivot_collocations": OP13}
