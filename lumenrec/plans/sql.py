"""Common table expressions (DuckDB) from which the queries' SQL is put together."""

from __future__ import annotations

#: name -> (names it needs, body); the order of the dictionary is a valid order of definition.
CTE: dict[str, tuple[str, str]] = {
    "ix_raw": ("", "SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(ceil(l_quantity / 10) AS INTEGER) AS rating, o_orderdate AS ts FROM lineitem JOIN orders ON l_orderkey = o_orderkey"),
    "ix": ("ix_raw", "SELECT user_id, item_id, min(ts) AS ts FROM ix_raw WHERE rating >= 4 GROUP BY 1, 2"),
    "r1u": ("ix", "SELECT * FROM ix WHERE user_id IN (SELECT user_id FROM ix GROUP BY 1 HAVING count(*) >= 10)"),
    "r1": ("r1u", "SELECT * FROM r1u WHERE item_id IN (SELECT item_id FROM r1u GROUP BY 1 HAVING count(*) >= 5)"),
    "r2u": ("r1", "SELECT * FROM r1 WHERE user_id IN (SELECT user_id FROM r1 GROUP BY 1 HAVING count(*) >= 10)"),
    "r2": ("r2u", "SELECT * FROM r2u WHERE item_id IN (SELECT item_id FROM r2u GROUP BY 1 HAVING count(*) >= 5)"),
    "r3u": ("r2", "SELECT * FROM r2 WHERE user_id IN (SELECT user_id FROM r2 GROUP BY 1 HAVING count(*) >= 10)"),
    "ixk": ("r3u", "SELECT * FROM r3u WHERE item_id IN (SELECT item_id FROM r3u GROUP BY 1 HAVING count(*) >= 5)"),
    "sp0": ("ixk", "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, item_id) AS rn, count(*) OVER (PARTITION BY user_id) AS n FROM ixk"),
    "sp1": ("sp0", "SELECT *, CAST(floor(n * CAST(0.7 AS DOUBLE)) AS BIGINT) AS nt, greatest(1, CAST(floor(n * CAST(0.1 AS DOUBLE)) AS BIGINT)) AS nv0 FROM sp0"),
    "sp2": ("sp1", "SELECT *, CASE WHEN nt + nv0 >= n THEN greatest(1, n - nt - 1) ELSE nv0 END AS nv FROM sp1"),
    "splits": ("sp2", "SELECT user_id, item_id, ts, CASE WHEN rn <= nt THEN 'train' WHEN rn <= nt + nv THEN 'val' ELSE 'test' END AS split FROM sp2"),
    "train": ("splits", "SELECT user_id, item_id, ts FROM splits WHERE split = 'train'"),
    "val": ("splits", "SELECT user_id, item_id, ts FROM splits WHERE split = 'val'"),
    "test": ("splits", "SELECT user_id, item_id, ts FROM splits WHERE split = 'test'"),
    "pop": ("train", "SELECT item_id, count(*) AS popularity FROM train GROUP BY 1"),
    "aged": ("train", "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS age FROM train"),
    "pairs": ("train", "SELECT x.item_id AS a, y.item_id AS b, count(*) AS n FROM train x JOIN train y ON x.user_id = y.user_id AND x.item_id < y.item_id GROUP BY 1, 2"),
    "cosine": ("pairs pop", "SELECT a, b, n, n / sqrt(CAST(p.popularity * q.popularity AS DOUBLE)) AS sim FROM pairs JOIN pop p ON a = p.item_id JOIN pop q ON b = q.item_id"),
    "both_sim": ("cosine", "SELECT a, b, sim FROM cosine UNION ALL SELECT b, a, sim FROM cosine"),
    "cf_pos": ("both_sim train", "SELECT t.user_id, s.b AS item_id, sum(sim) AS score FROM train t JOIN both_sim s ON t.item_id = s.a WHERE NOT EXISTS (SELECT 1 FROM train e WHERE e.user_id = t.user_id AND e.item_id = s.b) GROUP BY 1, 2"),
    "cf_all": ("cf_pos train", """SELECT u.user_id, i.item_id, coalesce(c.score, 0.0) AS score, c.score IS NOT NULL AS scored
        FROM (SELECT DISTINCT user_id FROM train) u CROSS JOIN (SELECT DISTINCT item_id FROM train) i
        LEFT JOIN cf_pos c ON c.user_id = u.user_id AND c.item_id = i.item_id
        WHERE NOT EXISTS (SELECT 1 FROM train e WHERE e.user_id = u.user_id AND e.item_id = i.item_id)"""),
    "cf": ("cf_all", "SELECT * FROM (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY scored DESC, round(score, 6) DESC, item_id) AS rank FROM cf_all) WHERE rank <= 100"),
    "vec0": ("", "SELECT vec_id AS item_id, CAST(embedding AS DOUBLE[]) AS v, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings"),
    "vec": ("vec0", "SELECT item_id, v, [x / CASE WHEN n > 0 THEN n ELSE 1.0 END FOR x IN v] AS u FROM vec0"),
    "uvec": ("vec", "SELECT item_id, unnest(u) AS x, generate_subscripts(u, 1) AS p FROM vec"),
    "hist20": ("aged", "SELECT user_id, item_id, age FROM aged WHERE age <= 20"),
    "prof0": ("hist20 uvec", "SELECT user_id, p, avg(x) AS x FROM hist20 JOIN uvec USING (item_id) GROUP BY 1, 2"),
    "prof1": ("prof0", "SELECT user_id, list(x ORDER BY p) AS m, sqrt(sum(x * x)) AS n FROM prof0 GROUP BY 1"),
    "prof": ("prof1", "SELECT user_id, [x / CASE WHEN n > 0 THEN n ELSE 1.0 END FOR x IN m] AS q FROM prof1"),
    "kg_all": ("prof vec train", "SELECT * FROM (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item_id) AS rank FROM (SELECT prof.user_id, vec.item_id, list_inner_product(q, u) AS score FROM prof CROSS JOIN vec WHERE NOT EXISTS (SELECT 1 FROM train e WHERE e.user_id = prof.user_id AND e.item_id = vec.item_id))) WHERE rank <= 200"),
    "kgr": ("kg_all", "SELECT * FROM kg_all WHERE rank <= 50"),
    "merged0": ("cf kgr", """SELECT coalesce(c.user_id, k.user_id) AS user_id, coalesce(c.item_id, k.item_id) AS item_id, coalesce(c.score, 0.0) AS cf_score, coalesce(k.score, 0.0) AS kg_score,
        CASE WHEN k.item_id IS NULL THEN 'cf' WHEN c.item_id IS NULL THEN 'kg' ELSE 'both' END AS source
        FROM (SELECT * FROM cf WHERE rank <= 70) c FULL OUTER JOIN kgr k ON c.user_id = k.user_id AND c.item_id = k.item_id"""),
    "merged": ("merged0", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source = 'kg', round(CASE WHEN source = 'kg' THEN kg_score ELSE cf_score END, 6) DESC, item_id) AS rank FROM merged0) WHERE rank <= 100"),
    "meta": ("", """SELECT p_partkey AS item_id, p_name AS title, list_concat([p_type], string_split(p_name, ' ')) AS genres, p_brand AS director,
        CAST(floor(p_size / 10) * 10 AS INTEGER) AS decade, coalesce(list_transform_actors, []) AS actors, coalesce(vote_count, 0) AS vote_count
        FROM part LEFT JOIN (SELECT l_partkey, count(*) AS vote_count, list_sort(list(DISTINCT l_suppkey))[1:5] AS list_transform_actors FROM lineitem GROUP BY 1) ON p_partkey = l_partkey"""),
    "t_meta": ("meta", """SELECT DISTINCT 'movie_' || item_id AS head, 'has_genre' AS relation, 'genre_' || g AS tail FROM (SELECT item_id, trim(unnest(genres)) AS g FROM meta) WHERE g <> ''
        UNION ALL SELECT DISTINCT 'movie_' || item_id, 'acted_by', 'actor_' || a FROM (SELECT item_id, unnest(actors) AS a FROM meta)
        UNION ALL SELECT DISTINCT 'movie_' || item_id, 'directed_by', 'director_' || trim(director) FROM meta WHERE trim(director) <> ''"""),
    "t_decade": ("meta", "SELECT 'movie_' || item_id AS head, 'released_in_decade' AS relation, 'decade_' || decade || 's' AS tail FROM meta WHERE decade IS NOT NULL"),
    "t_co": ("pairs", "SELECT 'movie_' || a AS head, 'co_liked' AS relation, 'movie_' || b AS tail FROM (SELECT a, b FROM pairs WHERE n >= 2 ORDER BY n DESC, a, b LIMIT 100000)"),
    "kg": ("t_meta t_decade t_co", "SELECT * FROM t_meta UNION ALL SELECT * FROM t_decade UNION ALL SELECT * FROM t_co"),
    "und": ("kg", "SELECT DISTINCT src, relation, dst FROM (SELECT head AS src, relation, tail AS dst FROM kg UNION ALL SELECT tail, relation, head FROM kg)"),
    "idf": ("und", "SELECT src AS entity, count(DISTINCT dst) AS df, ln((SELECT count(DISTINCT src) FROM und WHERE src LIKE 'movie\\_%' ESCAPE '\\') / CAST(count(DISTINCT dst) AS DOUBLE)) AS idf FROM und WHERE src NOT LIKE 'movie\\_%' ESCAPE '\\' AND dst LIKE 'movie\\_%' ESCAPE '\\' GROUP BY 1"),
    "cands": ("merged", "SELECT user_id, item_id FROM merged"),
    "hp": ("cands hist20", "SELECT c.user_id, c.item_id, h.item_id AS source, h.age FROM cands c JOIN hist20 h ON c.user_id = h.user_id"),
    "wanted": ("hp", "SELECT DISTINCT source AS a, item_id AS b FROM hp"),
    "common": ("wanted und idf", """SELECT w.a, w.b, x.relation, x.dst, idf FROM wanted w JOIN und x ON x.src = 'movie_' || w.a AND x.relation <> 'co_liked'
        JOIN und y ON y.src = 'movie_' || w.b AND y.relation = x.relation AND y.dst = x.dst JOIN idf ON idf.entity = x.dst"""),
    "pf0": ("common", """SELECT a, b, count(*) FILTER (WHERE relation = 'acted_by') AS shared_actor_count, max(CASE WHEN relation = 'directed_by' THEN 1 ELSE 0 END) AS same_director,
        count(*) FILTER (WHERE relation = 'has_genre') AS same_genre_count, sum(idf) FILTER (WHERE relation = 'acted_by') AS shared_actor_idf,
        sum(idf) FILTER (WHERE relation = 'directed_by') AS same_director_idf, sum(idf) FILTER (WHERE relation = 'has_genre') AS same_genre_idf,
        max(CASE WHEN relation = 'released_in_decade' THEN 1 ELSE 0 END) AS same_decade FROM common GROUP BY 1, 2"""),
    "pf": ("wanted pf0 und", """SELECT w.a, w.b, CAST(coalesce(shared_actor_count, 0) AS BIGINT) AS shared_actor_count, CAST(coalesce(same_director, 0) AS BIGINT) AS same_director,
        CAST(coalesce(same_genre_count, 0) AS BIGINT) AS same_genre_count, CAST(coalesce(same_decade, 0) AS BIGINT) AS same_decade,
        CAST(CASE WHEN EXISTS (SELECT 1 FROM und WHERE relation = 'co_liked' AND src = 'movie_' || w.a AND dst = 'movie_' || w.b) THEN 1 ELSE 0 END AS BIGINT) AS co_liked,
        coalesce(shared_actor_idf, 0.0) AS shared_actor_idf, coalesce(same_director_idf, 0.0) AS same_director_idf, coalesce(same_genre_idf, 0.0) AS same_genre_idf
        FROM wanted w LEFT JOIN pf0 USING (a, b)"""),
    "kgf": ("hp pf", """SELECT user_id, item_id, CAST(sum(shared_actor_count) AS BIGINT) AS kg_shared_actor_count_sum, max(shared_actor_count) AS kg_shared_actor_count_max, max(same_director) AS kg_same_director_max,
        CAST(sum(same_genre_count) AS BIGINT) AS kg_same_genre_count_sum, max(same_genre_count) AS kg_same_genre_count_max, sum(shared_actor_idf) AS kg_shared_actor_idf_sum,
        max(same_director_idf) AS kg_same_director_idf_max, sum(same_genre_idf) AS kg_same_genre_idf_sum, CAST(sum(co_liked) AS BIGINT) AS kg_co_liked_sum,
        sum(same_decade) / CAST(count(*) AS DOUBLE) AS kg_same_decade_ratio FROM hp JOIN pf ON pf.a = hp.source AND pf.b = hp.item_id GROUP BY 1, 2"""),
    "known": ("train vec", "SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, item_id DESC) AS age FROM train WHERE item_id IN (SELECT item_id FROM vec)"),
    "cprof0": ("known uvec", "SELECT user_id, p, avg(x) AS x FROM known JOIN uvec USING (item_id) WHERE age <= 20 GROUP BY 1, 2"),
    "cprof": ("cprof0", "SELECT user_id, list(x ORDER BY p) AS m FROM cprof0 GROUP BY 1"),
    "gt": ("test", "SELECT DISTINCT user_id, item_id FROM test"),
    "gtn": ("gt", "SELECT user_id, count(*) AS n_gt FROM gt GROUP BY 1"),
    "kk": ("", "SELECT unnest([1, 5, 10]) AS k"),
    "mhits": ("merged gt gtn", "SELECT m.user_id, m.item_id, m.rank, n_gt, g.item_id IS NOT NULL AS rel FROM merged m JOIN gtn USING (user_id) LEFT JOIN gt g ON g.user_id = m.user_id AND g.item_id = m.item_id"),
    "mper": ("mhits kk", """SELECT k, user_id, n_gt, count(*) FILTER (WHERE rel AND rank <= k) AS hits, coalesce(sum(1 / log2(CAST(rank + 1 AS DOUBLE))) FILTER (WHERE rel AND rank <= k), 0.0) AS dcg,
        min(rank) FILTER (WHERE rel AND rank <= k) AS first FROM mhits CROSS JOIN kk GROUP BY 1, 2, 3"""),
    "metrics": ("mper", """SELECT k, user_id, CAST(hits > 0 AS INTEGER) AS hit, dcg / list_sum([1 / log2(i + 1.0) FOR i IN range(1, least(n_gt, k) + 1)]) AS ndcg,
        hits / CAST(n_gt AS DOUBLE) AS recall, coalesce(1 / CAST(first AS DOUBLE), 0.0) AS mrr FROM mper"""),
    "strata": ("pop", "SELECT item_id, CASE WHEN popularity <= (SELECT median(popularity) FROM pop) THEN 'tail' ELSE 'head' END AS stratum FROM pop"),
    "ent0": ("train meta", "SELECT user_id, g, count(*) AS c FROM (SELECT user_id, unnest(genres) AS g FROM train JOIN meta USING (item_id)) GROUP BY 1, 2"),
    "ent1": ("ent0", "SELECT *, c / CAST(sum(c) OVER (PARTITION BY user_id) AS DOUBLE) AS p FROM ent0"),
    "entropy": ("ent1 train", "SELECT u.user_id, coalesce(e, 0.0) AS entropy FROM (SELECT DISTINCT user_id FROM train) u LEFT JOIN (SELECT user_id, -sum(p * log2(p)) AS e FROM ent1 GROUP BY 1) x ON x.user_id = u.user_id"),
    "turnp": ("", "SELECT s.conv_id AS user_id, s.turn AS movie_id, s.text AS explanation, u.text AS evidence FROM conversations s JOIN conversations u ON u.conv_id = s.conv_id AND u.turn + 1 = s.turn WHERE s.role = 'assistant' AND u.role = 'user'"),
    "tok": ("turnp", r"""SELECT *, list_distinct([t FOR t IN string_split_regex(lower(explanation), '\s+') IF t <> '']) AS et, list_distinct([t FOR t IN string_split_regex(lower(evidence), '\s+') IF t <> '']) AS vt FROM turnp"""),
    "stop": ("", "SELECT string_split('the a an is are was were in on at to for of and or but it this that with by from as be has have had do does did will would can could not no so if its also than then', ' ') AS sw"),
    "scored": ("tok stop", "SELECT user_id, movie_id, explanation, evidence, [t FOR t IN et IF NOT list_contains(sw, t)] AS e2, [t FOR t IN vt IF NOT list_contains(sw, t)] AS v2 FROM tok, stop"),
    "ovl": ("scored", "SELECT user_id, movie_id, CASE WHEN len(e2) > 0 THEN len(list_intersect(e2, v2)) / CAST(len(e2) AS DOUBLE) ELSE 0.0 END AS evidence_overlap, len(e2) AS n_words FROM scored"),
    "sent": ("", r"""SELECT doc_id AS source_id, [trim(s) FOR s IN string_split(regexp_replace(trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) IF trim(s) <> ''] AS parts FROM documents"""),
    "bdoc": ("", r"SELECT doc_id, [t FOR t IN string_split_regex(lower(text), '\s+') IF t <> ''] AS toks FROM documents"),
    "btf": ("bdoc", "SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS w FROM bdoc) GROUP BY 1, 2"),
    "bstat": ("bdoc", "SELECT count(*) AS n, avg(len(toks)) AS avgdl FROM bdoc"),
    "braw": ("btf bstat", "SELECT w, ln(n - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM btf, bstat GROUP BY w, n"),
    "bidf": ("braw", "SELECT w, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM braw) ELSE raw END AS idf FROM braw"),
    "bq": ("", r"SELECT item_id AS q, w, count(*) AS qn FROM (SELECT item_id, unnest([t FOR t IN string_split_regex(lower(text), '\s+') IF t <> '']) AS w FROM benchmark) GROUP BY 1, 2"),
    "bm": ("bq bidf btf bdoc bstat", "SELECT q, doc_id, sum(qn * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(toks) / avgdl))) AS score FROM bq JOIN bidf USING (w) JOIN btf USING (w) JOIN bdoc USING (doc_id), bstat GROUP BY 1, 2"),
}


def with_(names: str, body: str) -> str:
    """``body`` behind a WITH of the named expressions and all that they need."""
    need: set[str] = set()

    def add(name: str) -> None:
        if name not in need:
            need.add(name)
            for n in CTE[name][0].split():
                add(n)

    for n in names.split():
        add(n)
    heads = [f"{n} AS ({CTE[n][1]})" for n in CTE if n in need]
    return f"WITH {', '.join(heads)} {body}" if heads else body
