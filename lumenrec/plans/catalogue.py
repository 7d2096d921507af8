"""All queries of the library, each with its SQL where SQL can state it."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenrec.functions import metrics, stats
from lumenrec.functions import strings as S
from lumenrec.functions import vectors as V
from lumenrec.operators import embed, explain, features, graph, prep, ranker, recall, text
from lumenrec.plans import storage
from lumenrec.plans.registry import oracle_sql, queries, query
from lumenrec.plans.sql import with_
from lumenrec.sources import fixtures as X
from lumenrec.sources import readers, sinks
from lumenrec.sources.workspace import root, stored
from lumenrec.streaming import resume

__all__ = ["oracle_sql", "queries", "storage"]
#: The synthetic interactions are thin: two shared users make a pair co-liked.
CO_LIKED = 2


def r6(c, name: str):
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, 6) + 0.0).alias(name)


# ---------------------------------------------------------------- stage tables


def _cf(s, d):
    return stored(s, d, "cf", lambda: recall.item_cf(X.train(s, d), 100))


def _kg_route(s, d):
    return stored(s, d, "kg-route", lambda: recall.vector_recall(X.train(s, d), X.vectors(s, d), 200))


def _merged(s, d):
    return stored(s, d, "merged", lambda: recall.merge_routes(_cf(s, d), _kg_route(s, d)))


def _kg(s, d):
    return stored(s, d, "kg", lambda: graph.triples(X.metadata(s, d), X.train(s, d), CO_LIKED))


def _candidates(s, d):
    return _merged(s, d).select("user_id", "item_id")


def _history(s, d):
    return prep.last_n(X.train(s, d), 20).select("user_id", F.col("item_id").alias("source"), "age")


def _hist_pairs(s, d):
    return _candidates(s, d).join(_history(s, d), "user_id")


# ---------------------------------------------------------------- ingest


@query(with_("ix", "SELECT user_id, item_id, ts FROM ix"))
def positive_filter(s, d):
    return X.interactions(s, d)


@query(with_("ixk", "SELECT user_id, item_id, ts FROM ixk"))
def kcore_interactions(s, d):
    return prep.k_core(X.interactions(s, d))


@query(with_("splits", "SELECT user_id, item_id, split FROM splits"))
def time_split_rows(s, d):
    return X.split(s, d).select("user_id", "item_id", "split")


@query(with_("splits", "SELECT split, count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(DISTINCT item_id) AS n_items FROM splits GROUP BY 1"))
def time_split_counts(s, d):
    return X.split(s, d).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"), F.count_distinct("item_id").alias("n_items"))


@query(r"""WITH t AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) || ' (' || (1950 + page_id % 60) || ')' AS title FROM pages)
SELECT page_id, title, nullif(regexp_extract(title, '\((\d{4})\)$', 1), '') AS year, regexp_replace(title, '\s*\(\d{4}\)$', '') AS clean_title FROM t""")
def title_year_extract(s, d):
    title = F.concat(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(" ("), (F.lit(1950) + F.col("page_id") % 60).cast("string"), F.lit(")"))
    t = readers.parquet(s, d, "pages").select("page_id", title.alias("title"))
    return t.select("page_id", "title", readers.title_year(F.col("title")).alias("year"), readers.clean_title(F.col("title")).alias("clean_title"))


@query("SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def json_props_scan(s, d):
    e = readers.parquet(s, d, "events").select("event_type", F.from_json("props", "k bigint")["k"].alias("k"), "value")
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(with_("aged", "SELECT user_id, list(item_id ORDER BY age DESC) AS history FROM aged WHERE age <= 20 GROUP BY 1"))
def user_history_last20(s, d):
    return prep.histories(X.train(s, d), 20)


# ---------------------------------------------------------------- identifiers and dimensions


@query("""SELECT p_partkey, p_partkey AS from_int, CAST(CAST(p_partkey AS DOUBLE) AS BIGINT) AS from_float, p_partkey AS from_text FROM part""")
def id_normalize(s, d):
    p = readers.parquet(s, d, "part")
    k = F.col("p_partkey")
    return p.select("p_partkey", prep.normalise_id(k).alias("from_int"), prep.normalise_id(k.cast("double")).alias("from_float"), prep.normalise_id(F.concat(F.lit(" "), k.cast("string"), F.lit(".0 "))).alias("from_text"))


@query("""SELECT l_orderkey, l_linenumber, coalesce(p_name, 'Movie ' || (l_partkey * 2)) AS title, coalesce(p_type, '') AS genres
FROM lineitem LEFT JOIN part ON p_partkey = l_partkey * 2""")
def movie_info_lookup(s, d):
    lines = readers.parquet(s, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") * 2).alias("m"))
    part = readers.parquet(s, d, "part").select(F.col("p_partkey").alias("m"), "p_name", "p_type")
    return lines.join(part, "m", "left").select("l_orderkey", "l_linenumber", F.coalesce("p_name", F.concat(F.lit("Movie "), F.col("m").cast("string"))).alias("title"), F.coalesce("p_type", F.lit("")).alias("genres"))


@query(with_("ix_raw", """SELECT user_id, movie_id, round(cf_score, 6) AS cf_score, kg_recall_score, rank FROM (
SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY cf_score DESC, movie_id) AS rank FROM (
SELECT user_id, item_id AS movie_id, avg(rating) + item_id * 1e-6 AS cf_score, CAST(0.0 AS DOUBLE) AS kg_recall_score FROM ix_raw GROUP BY 1, item_id)) WHERE rank <= 5"""))
def score_column_standardize(s, d):
    raw = X.interactions_raw(s, d).groupBy("user_id", F.col("item_id").alias("movie_id")).agg(F.avg("rating").alias("a"))
    scored = readers.standard_scores(raw.select("user_id", "movie_id", (F.col("a") + F.col("movie_id") * 1e-6).alias("lgcn_score")))
    return readers.ranked_recommendations(scored, 5).select("user_id", "movie_id", r6("cf_score", "cf_score"), "kg_recall_score", "rank")


# ---------------------------------------------------------------- item CF


@query(with_("cosine", "SELECT a, b, n, round(sim, 6) AS sim FROM cosine"))
def item_similarity(s, d):
    return recall.item_cosine(X.train(s, d)).select("a", "b", "n", r6("sim", "sim"))


@query(with_("cf", "SELECT user_id, item_id, round(score, 6) AS score, rank FROM cf WHERE rank <= 10"))
def item_cf_topk(s, d):
    return recall.item_cf(X.train(s, d), 10).select("user_id", "item_id", r6("score", "score"), "rank")


@query(with_("cf", "SELECT user_id, item_id, round(score, 6) AS score, rank FROM cf"))
def item_cf_top100(s, d):
    return _cf(s, d).select("user_id", "item_id", r6("score", "score"), "rank")


@query(with_("pop", "SELECT item_id, popularity FROM pop"))
def popularity(s, d):
    return prep.popularity(X.train(s, d))


# ---------------------------------------------------------------- graph


@query(with_("t_meta", "SELECT head, relation, tail FROM t_meta"))
def kg_triples_meta(s, d):
    return graph.metadata_triples(X.metadata(s, d))


@query(with_("t_decade", "SELECT head, relation, tail FROM t_decade"))
def kg_triples_decade(s, d):
    return graph.decade_triples(X.metadata(s, d))


@query(with_("t_co", "SELECT head, relation, tail FROM t_co"))
def kg_co_liked(s, d):
    return graph.co_liked_triples(X.train(s, d), CO_LIKED)


@query(with_("kg", "SELECT relation, count(*) AS n FROM kg GROUP BY 1"))
def kg_relation_counts(s, d):
    return graph.relation_counts(_kg(s, d))


@query(with_("kg", """SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS entity_id, string_split(entity, '_')[1] AS type
FROM (SELECT head AS entity FROM kg UNION SELECT tail FROM kg)"""))
def kg_entity_ids(s, d):
    return graph.entities(_kg(s, d))


@query(with_("und", """SELECT string_split(src, '_')[1] AS type, count(DISTINCT src) AS nodes, count(*) AS degree FROM und GROUP BY 1"""))
def kg_type_stats(s, d):
    u = graph.undirected(_kg(s, d))
    return u.groupBy(graph.entity_type(F.col("src")).alias("type")).agg(F.count_distinct("src").alias("nodes"), F.count(F.lit(1)).alias("degree"))


@query(with_("idf", "SELECT entity, df, round(idf, 6) AS idf FROM idf"))
def kg_entity_idf(s, d):
    return graph.entity_idf(_kg(s, d)).select("entity", "df", r6("idf", "idf"))


@query(with_("und", "SELECT relation, dst AS neighbour FROM und WHERE src = 'movie_7'"))
def kg_neighbors(s, d):
    return graph.neighbours(_kg(s, d), "movie_7")


@query(with_("und", """, e AS (SELECT DISTINCT src, dst FROM und), s AS (SELECT 'movie_1' AS node UNION ALL SELECT 'movie_2'),
one AS (SELECT DISTINCT dst AS node FROM e JOIN s ON src = node WHERE dst NOT IN (SELECT node FROM s)),
two AS (SELECT DISTINCT dst AS node FROM e JOIN one ON src = node WHERE dst NOT IN (SELECT node FROM s) AND dst NOT IN (SELECT node FROM one))
SELECT node, 0 AS depth FROM s UNION ALL SELECT node, 1 FROM one UNION ALL SELECT node, 2 FROM two"""))
def kg_bfs_2hop(s, d):
    seeds = s.createDataFrame([("movie_1",), ("movie_2",)], "node string")
    return graph.bfs(_kg(s, d), seeds, 2)


def _best_ten(s, d):
    return _merged(s, d).filter("rank <= 10").select("user_id", "item_id")


def _paths(s, d):
    """Paths to the ten recommendations of each user from the ten newest items."""
    return graph.user_paths(_kg(s, d), _best_ten(s, d), _history(s, d).filter("age <= 10"))


def _oldest(s, d):
    """The first ten of each user's last twenty items."""
    place = F.count(F.lit(1)).over(Window.partitionBy("user_id")) - F.col("age")  # 0 is the oldest of the window
    return _history(s, d).withColumn("place", place).filter("place < 10").select("user_id", "source")


@query(with_("merged hist20 und", """, e AS (SELECT DISTINCT src, dst FROM und), h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY age DESC) AS place FROM hist20),
p AS (SELECT c.user_id, c.item_id, 'movie_' || h.item_id AS s, 'movie_' || c.item_id AS t FROM merged c JOIN h USING (user_id) WHERE c.rank <= 10 AND h.place <= 10),
st AS (SELECT DISTINCT s, t FROM p), f1 AS (SELECT DISTINCT s, dst AS node FROM (SELECT DISTINCT s FROM st) JOIN e ON src = s), b1 AS (SELECT DISTINCT t, dst AS node FROM (SELECT DISTINCT t FROM st) JOIN e ON src = t),
near AS (SELECT s, t, min(h) AS h FROM (SELECT s, t, 0 AS h FROM st WHERE s = t UNION ALL SELECT s, t, 1 FROM st JOIN e ON src = s AND dst = t UNION ALL SELECT s, t, 2 FROM st JOIN f1 USING (s) JOIN b1 USING (t, node)) GROUP BY 1, 2),
told AS (SELECT user_id, item_id, min(h) AS hops FROM p LEFT JOIN near USING (s, t) GROUP BY 1, 2), far AS (SELECT user_id, item_id, s, t FROM p JOIN told USING (user_id, item_id) WHERE hops IS NULL),
bfs AS (SELECT DISTINCT s AS root, s AS node, 0 AS d FROM far UNION SELECT b.root, e.dst, b.d + 1 FROM bfs b JOIN e ON e.src = b.node WHERE NOT EXISTS (SELECT 1 FROM recurring.bfs r WHERE r.root = b.root AND r.node = e.dst)),
late AS (SELECT user_id, item_id, min(d) AS hops FROM far JOIN bfs ON root = s AND node = t GROUP BY 1, 2)
SELECT user_id, item_id, coalesce(told.hops, late.hops) AS hops FROM told LEFT JOIN late USING (user_id, item_id)""").replace("bfs AS (", "bfs(root, node, d) USING KEY (root, node) AS (").replace("WITH ", "WITH RECURSIVE ", 1))
def kg_shortest_path_len(s, d):
    return graph.user_path_lengths(_kg(s, d), _best_ten(s, d), _oldest(s, d))


_PATHS = """, p AS (SELECT c.user_id, c.item_id, h.item_id AS source, h.age, 'movie_' || h.item_id AS s, 'movie_' || c.item_id AS t FROM merged c JOIN hist20 h USING (user_id) WHERE c.rank <= 10 AND h.age <= 10 AND h.item_id <> c.item_id),
st AS (SELECT DISTINCT s, t FROM p),
pa AS (SELECT st.*, x.relation AS rel1, NULL AS mid, NULL AS rel2 FROM st JOIN und x ON x.src = s AND x.dst = t
UNION ALL SELECT st.*, x.relation, x.dst, y.relation FROM st JOIN und x ON x.src = s JOIN und y ON y.src = x.dst AND y.dst = t WHERE x.dst <> s AND x.dst <> t),
paths AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id, item_id ORDER BY age DESC, mid IS NOT NULL, mid, rel1, rel2) AS n FROM p JOIN pa USING (s, t)) WHERE n <= 5) """


@query(with_("merged hist20 und", _PATHS + "SELECT user_id, item_id, source, rel1, mid, rel2, n FROM paths"))
def kg_paths_2hop(s, d):
    return _paths(s, d)


@query(with_("merged hist20 und", _PATHS + """SELECT user_id, item_id, n, CASE
WHEN rel2 IS NULL THEN '''' || st.p_name || ''' connects to ''' || tt.p_name || ''' via ' || replace(rel1, '_', ' ') || '.'
WHEN rel1 = 'has_genre' AND rel2 = 'has_genre' THEN '''' || st.p_name || ''' and ''' || tt.p_name || ''' both belong to the ' || substr(mid, 7) || ' genre.'
WHEN rel1 = 'co_liked' AND rel2 = 'co_liked' THEN 'Users who watched ''' || st.p_name || ''' also frequently watched ''' || mt.p_name || ''', and fans of ''' || mt.p_name || ''' often enjoy ''' || tt.p_name || ''' as well.'
ELSE '''' || st.p_name || ''' connects to ''' || tt.p_name || ''' via ' || replace(rel1, '_', ' ') || ' → ' || coalesce(mt.p_name, mid) || ' → ' || replace(rel2, '_', ' ') || '.' END AS text
FROM paths JOIN part st ON st.p_partkey = source JOIN part tt ON tt.p_partkey = item_id LEFT JOIN part mt ON 'movie_' || mt.p_partkey = mid"""))
def kg_path_text(s, d):
    paths = _paths(s, d)
    title = readers.parquet(s, d, "part").select("p_partkey", "p_name")
    named = (
        paths.join(title.select(F.col("p_partkey").alias("source"), F.col("p_name").alias("st")), "source")
        .join(title.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("tt")), "item_id")
        .join(title.select(F.concat(F.lit("movie_"), "p_partkey").alias("mid"), F.col("p_name").alias("mt")), "mid", "left")
    )
    return named.select("user_id", "item_id", "n", S.path_sentence(F.col("rel1"), F.col("mid"), F.col("rel2"), F.col("st"), F.col("mt"), F.col("tt")).alias("text"))


@query(with_("hp und", """, q AS (SELECT user_id, item_id, source, 'movie_' || source AS s, 'movie_' || item_id AS t FROM hp),
c AS (SELECT user_id, item_id, count(DISTINCT CASE WHEN x.relation = 'acted_by' THEN x.dst END) AS n_actors, count(DISTINCT CASE WHEN x.relation = 'directed_by' THEN x.dst END) AS n_directors,
count(DISTINCT CASE WHEN x.relation = 'has_genre' THEN x.dst END) AS n_genres, count(DISTINCT CASE WHEN x.relation = 'released_in_decade' THEN source END) AS n_decade
FROM q JOIN und x ON x.src = t AND x.relation <> 'co_liked' JOIN und y ON y.src = s AND y.relation = x.relation AND y.dst = x.dst GROUP BY 1, 2),
l AS (SELECT user_id, item_id, count(DISTINCT source) AS n_co_liked FROM q JOIN und ON src = s AND dst = t AND relation = 'co_liked' GROUP BY 1, 2),
n AS (SELECT user_id, item_id, count(*) AS n_history FROM hp GROUP BY 1, 2)
SELECT user_id, item_id, n_history, coalesce(n_actors, 0) AS n_actors, coalesce(n_directors, 0) AS n_directors, coalesce(n_genres, 0) AS n_genres, coalesce(n_decade, 0) AS n_decade, coalesce(n_co_liked, 0) AS n_co_liked
FROM n LEFT JOIN c USING (user_id, item_id) LEFT JOIN l USING (user_id, item_id)"""))
def shared_entity_explain(s, d):
    return graph.shared_entities(_kg(s, d), _candidates(s, d), _history(s, d))


_PF = "a, b, shared_actor_count, same_director, same_genre_count, same_decade, co_liked"


@query(with_("pf", f"SELECT {_PF}, round(shared_actor_idf, 6) AS shared_actor_idf, round(same_director_idf, 6) AS same_director_idf, round(same_genre_idf, 6) AS same_genre_idf FROM pf"))
def kg_pairwise_features(s, d):
    pairs = _hist_pairs(s, d).select(F.col("source").alias("a"), F.col("item_id").alias("b"))
    out = graph.pairwise(_kg(s, d), pairs)
    return out.select(*_PF.split(", "), *[r6(c, c) for c in ("shared_actor_idf", "same_director_idf", "same_genre_idf")])


_KGI = "kg_shared_actor_count_sum, kg_shared_actor_count_max, kg_same_director_max, kg_same_genre_count_sum, kg_same_genre_count_max, kg_co_liked_sum".split(", ")
_KGD = "kg_shared_actor_idf_sum, kg_same_director_idf_max, kg_same_genre_idf_sum, kg_same_decade_ratio".split(", ")


def _kg_features(s, d):
    return stored(s, d, "kg-features", lambda: graph.user_candidate_features(_kg(s, d), _candidates(s, d), _history(s, d)))


@query(with_("kgf", f"SELECT user_id, item_id, {', '.join(_KGI)}, {', '.join(f'round({c}, 6) AS {c}' for c in _KGD)} FROM kgf"))
def kg_user_item_features(s, d):
    return _kg_features(s, d).select("user_id", "item_id", *_KGI, *[r6(c, c) for c in _KGD])


_MD5 = "CAST('0x' || substr(md5(%s || ':42'), 1, 8) AS BIGINT)"


@query(with_("kg", f"SELECT head, relation, tail FROM (SELECT *, row_number() OVER (PARTITION BY relation ORDER BY {_MD5 % "head || ':' || tail"}, head, tail) AS rn FROM kg) WHERE rn <= 50"))
def kg_balanced_sample(s, d):
    return embed.balanced(_kg(s, d), 50)


@query(with_("kg", f""", en AS (SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS entity_id, count(*) OVER () AS n FROM (SELECT head AS entity FROM kg UNION SELECT tail FROM kg)),
z AS (SELECT *, {_MD5 % "head || ':' || relation || ':' || tail"} % (SELECT max(n) FROM en) AS k, CAST('0x' || substr(md5(tail || ':' || relation || ':' || head || ':43'), 1, 8) AS BIGINT) % 2 AS side FROM kg)
SELECT head, relation, tail, CASE WHEN side = 0 THEN entity ELSE head END AS nh, CASE WHEN side = 0 THEN tail ELSE entity END AS nt FROM z JOIN en ON entity_id = k"""))
def kg_corrupted(s, d):
    return embed.corrupted(_kg(s, d), graph.entities(_kg(s, d)), 42)


@query(with_("t_meta t_decade pairs", """, kc AS (SELECT * FROM t_meta UNION ALL SELECT * FROM t_decade UNION ALL SELECT 'movie_' || a, 'co_liked', 'movie_' || b FROM (SELECT a, b FROM pairs WHERE n >= 2 ORDER BY n DESC, a, b LIMIT 500))
SELECT entity, row_number() OVER (ORDER BY entity) - 1 AS entity_id, string_split(entity, '_')[1] AS type FROM (SELECT head AS entity FROM kc UNION SELECT tail FROM kc)"""))
def kg_rebuild_capped(s, d):
    """The graph with capped co-liked edges; entities come from its own triples."""
    return graph.entities(graph.triples(X.metadata(s, d), X.train(s, d), CO_LIKED, 500))


@query(with_("kg", "SELECT head, relation, tail FROM kg"))
def kg_stored(s, d):
    """The graph as an edge table, written by the sink and read back as a required source."""
    path = f"{root(s)}/kg-{uuid.uuid4().hex}"
    sinks.overwrite(_kg(s, d), path, ["relation"])
    return readers.required(s, path).select("head", "relation", "tail")


# ---------------------------------------------------------------- vectors


@query(with_("vec", "SELECT * FROM (SELECT x.item_id AS q, y.item_id, round(list_inner_product(x.u, y.u), 6) AS score, row_number() OVER (PARTITION BY x.item_id ORDER BY round(list_inner_product(x.u, y.u), 6) DESC, y.item_id) AS rank FROM vec x CROSS JOIN vec y WHERE x.item_id % 10 = 0) WHERE rank <= 10"))
def mips_topk(s, d):
    units = X.vectors(s, d).select("item_id", V.unit(F.col("vector")).alias("vector"))
    asked = units.filter("item_id % 10 = 0").select(F.col("item_id").alias("q"), "vector")  # the stated query set
    return V.top_inner_products(asked, units, 10).select("q", "item_id", r6("score", "score"), "rank")


@query(with_("cands cprof vec", "SELECT c.user_id, c.item_id, round(coalesce(list_inner_product(m, u), 0.0), 6) + 0.0 AS content_similarity FROM cands c LEFT JOIN cprof USING (user_id) LEFT JOIN vec USING (item_id)"))
def content_similarity(s, d):
    return features.content_similarity(_candidates(s, d), X.train(s, d), X.vectors(s, d)).select("user_id", "item_id", r6("content_similarity", "content_similarity"))


@query(with_("kgr", "SELECT user_id, item_id, round(score, 6) AS score, rank FROM kgr"))
def vector_recall_topk(s, d):
    return _kg_route(s, d).filter("rank <= 50").select("user_id", "item_id", r6("score", "score"), "rank")


@query(with_("cands hist20 vec prof", """, h AS (SELECT user_id, v, u FROM hist20 JOIN vec USING (item_id)),
mv0 AS (SELECT user_id, p, avg(x) AS x FROM (SELECT user_id, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM h) GROUP BY 1, 2), mv AS (SELECT user_id, list(x ORDER BY p) AS m FROM mv0 GROUP BY 1),
k AS (SELECT c.user_id, c.item_id, v, u FROM cands c JOIN vec USING (item_id)),
n AS (SELECT k.user_id, k.item_id, min(list_distance(k.v, h.v)) AS mind, max(list_inner_product(k.u, h.u)) AS maxc FROM k JOIN h USING (user_id) GROUP BY 1, 2),
a AS (SELECT k.user_id, k.item_id, list_distance(k.v, m) AS md, list_inner_product(q, u) AS mc FROM k JOIN mv USING (user_id) JOIN prof USING (user_id))
SELECT c.user_id, c.item_id, round(coalesce(md, 0.0), 6) + 0.0 AS kg_emb_mean_dist, round(coalesce(mc, 0.0), 6) + 0.0 AS kg_emb_mean_cos, round(coalesce(mind, 0.0), 6) + 0.0 AS kg_emb_min_dist, round(coalesce(maxc, 0.0), 6) + 0.0 AS kg_emb_max_cos
FROM cands c LEFT JOIN n USING (user_id, item_id) LEFT JOIN a USING (user_id, item_id)"""))
def kg_emb_features(s, d):
    out = features.embedding_features(_candidates(s, d), X.train(s, d), X.vectors(s, d))
    return out.select("user_id", "item_id", *[r6(c, c) for c in ("kg_emb_mean_dist", "kg_emb_mean_cos", "kg_emb_min_dist", "kg_emb_max_cos")])


@query(with_("vec", "SELECT x.item_id, round(avg(list_inner_product(x.u, y.u)), 6) + 0.0 AS semantic_sim FROM vec x JOIN vec y ON y.item_id BETWEEN x.item_id + 1 AND x.item_id + 3 GROUP BY 1"))
def semantic_sim(s, d):
    v = X.vectors(s, d)
    near = v.select(F.explode(F.array(*[F.col("item_id") - k for k in (1, 2, 3)])).alias("item_id"), F.col("vector").alias("e")).groupBy("item_id").agg(F.collect_list("e").alias("evidence_vectors"))
    return text.semantic_similarity(v.join(near, "item_id"), ["item_id"]).select("item_id", r6("semantic_sim", "semantic_sim"))


# ---------------------------------------------------------------- candidates


@query(with_("merged", "SELECT user_id, item_id, round(cf_score, 6) AS cf_score, round(kg_score, 6) + 0.0 AS kg_score, source, rank FROM merged"))
def multi_recall_merge(s, d):
    return _merged(s, d).select("user_id", "item_id", r6("cf_score", "cf_score"), r6("kg_score", "kg_score"), "source", "rank")


@query(with_("merged", "SELECT source, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct, count(DISTINCT item_id) AS n_items FROM merged GROUP BY 1"))
def recall_source_breakdown(s, d):
    return recall.source_breakdown(_merged(s, d)).select("source", "n", r6("pct", "pct"), "n_items")


@query(with_("merged", "SELECT user_id, item_id, CASE WHEN cf_score > 0 AND kg_score = 0 THEN 'cf_only' WHEN cf_score = 0 AND kg_score > 0 THEN 'kg_only' WHEN cf_score > 0 AND kg_score > 0 THEN 'both' ELSE 'none' END AS kind FROM merged"))
def source_by_score_sign(s, d):
    return _merged(s, d).select("user_id", "item_id", features.source_of(F.col("cf_score"), F.col("kg_score")).alias("kind"))


@query(with_("merged", "SELECT min(n) AS least, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT user_id, count(*) AS n FROM merged GROUP BY 1)"))
def candidates_per_user(s, d):
    by = _merged(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return by.agg(F.min("n").alias("least"), F.max("n").alias("most"), r6(F.avg("n"), "mean"))


_IMPROVED = """, idf1 AS (SELECT item_id, ln((SELECT count(DISTINCT user_id) FROM train) / CAST(count(DISTINCT user_id) + 1 AS DOUBLE)) AS idf FROM train GROUP BY 1),
hv AS (SELECT t.user_id, t.item_id, row_number() OVER (PARTITION BY t.user_id ORDER BY t.age DESC) AS pos, count(*) OVER (PARTITION BY t.user_id) AS n FROM aged t WHERE t.item_id IN (SELECT item_id FROM vec)),
w AS (SELECT hv.user_id, hv.item_id, idf * exp(-2.0 * (1.0 - CASE WHEN n > 1 THEN (pos - 1) / CAST(n - 1 AS DOUBLE) ELSE 1.0 END)) AS w FROM hv JOIN idf1 USING (item_id)),
ip0 AS (SELECT user_id, p, sum(w * x) / sum(w) AS x FROM w JOIN uvec USING (item_id) GROUP BY 1, 2), ip1 AS (SELECT user_id, list(x ORDER BY p) AS m, sqrt(sum(x * x)) AS nn FROM ip0 GROUP BY 1),
iprof AS (SELECT user_id, [x / CASE WHEN nn > 0 THEN nn ELSE 1.0 END FOR x IN m] AS q FROM ip1),
ikg AS (SELECT * FROM (SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 6) DESC, item_id) AS rank FROM (SELECT iprof.user_id, vec.item_id, list_inner_product(q, u) AS score FROM iprof CROSS JOIN vec WHERE NOT EXISTS (SELECT 1 FROM train e WHERE e.user_id = iprof.user_id AND e.item_id = vec.item_id))) WHERE rank <= 50),
icf AS (SELECT * FROM cf WHERE rank <= 70 OR (rank <= 100 AND user_id NOT IN (SELECT user_id FROM ikg))),
im0 AS (SELECT coalesce(c.user_id, k.user_id) AS user_id, coalesce(c.item_id, k.item_id) AS item_id, coalesce(c.score, 0.0) AS cf_score, coalesce(k.score, 0.0) AS kg_score, CASE WHEN k.item_id IS NULL THEN 'cf' WHEN c.item_id IS NULL THEN 'kg' ELSE 'both' END AS source
FROM icf c FULL OUTER JOIN ikg k ON c.user_id = k.user_id AND c.item_id = k.item_id)
SELECT user_id, item_id, round(cf_score, 6) AS cf_score, round(kg_score, 6) + 0.0 AS kg_score, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY source = 'kg', round(CASE WHEN source = 'kg' THEN kg_score ELSE cf_score END, 6) DESC, item_id) AS rank FROM im0) WHERE rank <= 100"""


@query(with_("cf aged uvec", _IMPROVED))
def improved_profile_recall(s, d):
    kg = recall.vector_recall(X.train(s, d), X.vectors(s, d), 50, None, idf=True, decay=True)
    out = recall.merge_routes(_cf(s, d), kg, cf_only_users=True)
    return out.select("user_id", "item_id", r6("cf_score", "cf_score"), r6("kg_score", "kg_score"), "source", "rank")


@query(with_("cf kg_all", """, own AS (SELECT user_id, item_id FROM cf WHERE rank <= 70), nc AS (SELECT user_id, count(*) AS n FROM own GROUP BY 1),
z AS (SELECT k.*, n, coalesce(sum(CASE WHEN o.item_id IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY k.user_id ORDER BY k.rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS fresh
FROM kg_all k JOIN nc USING (user_id) LEFT JOIN own o ON o.user_id = k.user_id AND o.item_id = k.item_id)
SELECT user_id, item_id, round(score, 6) AS score, rank FROM z WHERE rank <= 50 OR n + fresh < 100"""))
def compensated_recall(s, d):
    return recall.compensated_kg(_cf(s, d), _kg_route(s, d)).select("user_id", "item_id", r6("score", "score"), "rank")


@query(with_("merged gt", "SELECT m.user_id, m.item_id, CAST(g.item_id IS NOT NULL AS INTEGER) AS label FROM merged m LEFT JOIN gt g ON g.user_id = m.user_id AND g.item_id = m.item_id"))
def candidate_labels(s, d):
    return recall.label(_merged(s, d), X.part_of(s, d, "test")).select("user_id", "item_id", "label")


@query(with_("merged gt", "SELECT count(*) AS n, count(g.item_id) AS n_pos, round(count(g.item_id) / CAST(count(*) AS DOUBLE), 6) AS pos_rate FROM merged m LEFT JOIN gt g ON g.user_id = m.user_id AND g.item_id = m.item_id"))
def label_balance(s, d):
    rows = recall.label(_merged(s, d), X.part_of(s, d, "test"))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("n_pos"), r6(F.avg("label"), "pos_rate"))


@query(with_("train", "SELECT user_id, row_number() OVER (ORDER BY md5(user_id || ':42'), user_id) <= CAST(floor(count(*) OVER () * CAST(0.2 AS DOUBLE)) AS BIGINT) AS is_val FROM (SELECT DISTINCT user_id FROM train)"))
def user_train_val_split(s, d):
    return prep.user_hash_split(X.train(s, d))


def _frame(s, d):
    """The feature frame of all merged candidates, with ``is_val`` users and the labels of validation and test."""

    def make():
        cand = _merged(s, d).select("user_id", "item_id", "cf_score", F.col("kg_score").alias("kg_recall_score"))
        train, labels = X.train(s, d), {"label_val": X.part_of(s, d, "val"), "label_test": X.part_of(s, d, "test")}
        return features.frame(cand, train, X.metadata(s, d), X.vectors(s, d), _kg_features(s, d), prep.user_hash_split(train), labels)

    return stored(s, d, "frame", make)


def _fit_rows(s, d):
    """Candidates with validation labels and ``is_val`` users: what rankers are fitted on."""
    return _frame(s, d).drop("label_test").withColumnRenamed("label_val", "label")


def _test_rows(s, d):
    return _frame(s, d).drop("label_val", "is_val").withColumnRenamed("label_test", "label")


@query(with_("merged pop meta kgf cprof vec gt", """SELECT c.user_id, c.item_id, round(cf_score, 6) AS cf_score, round(kg_score, 6) + 0.0 AS kg_recall_score, coalesce(popularity, 0) AS popularity, coalesce(vote_count, 0) AS vote_count,
round(coalesce(list_inner_product(m, u), 0.0), 6) + 0.0 AS content_similarity, kg_co_liked_sum, round(kg_same_genre_idf_sum, 6) AS kg_same_genre_idf_sum, CAST(g.item_id IS NOT NULL AS INTEGER) AS label
FROM merged c LEFT JOIN pop USING (item_id) LEFT JOIN meta USING (item_id) LEFT JOIN kgf ON kgf.user_id = c.user_id AND kgf.item_id = c.item_id
LEFT JOIN cprof ON cprof.user_id = c.user_id LEFT JOIN vec ON vec.item_id = c.item_id LEFT JOIN gt g ON g.user_id = c.user_id AND g.item_id = c.item_id"""))
def feature_assembly(s, d):
    return _test_rows(s, d).select("user_id", "item_id", r6("cf_score", "cf_score"), r6("kg_recall_score", "kg_recall_score"), "popularity", "vote_count", r6("content_similarity", "content_similarity"), "kg_co_liked_sum", r6("kg_same_genre_idf_sum", "kg_same_genre_idf_sum"), "label")


@query(with_("kgf", " UNION ALL ".join(f"SELECT '{c}' AS feature, round(avg({c}), 6) AS mean, count(*) FILTER (WHERE {c} <> 0) AS nonzero FROM kgf" for c in _KGI + _KGD)))
def feature_stats(s, d):
    return features.column_stats(_kg_features(s, d), _KGI + _KGD).select("feature", r6("mean", "mean"), "nonzero")


# ---------------------------------------------------------------- metrics


@query(with_("merged gt", f"SELECT user_id, item_id, label FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY label DESC, {_MD5 % "user_id || ':' || item_id"}, item_id) AS rn FROM (SELECT m.user_id, m.item_id, CAST(g.item_id IS NOT NULL AS INTEGER) AS label FROM merged m LEFT JOIN gt g ON g.user_id = m.user_id AND g.item_id = m.item_id)) WHERE rn <= 30"))
def group_cap(s, d):
    return ranker.cap_groups(recall.label(_merged(s, d), X.part_of(s, d, "test")), 30).select("user_id", "item_id", "label")


@query(with_("merged gt aged", f""", r AS (SELECT m.user_id, m.item_id, m.rank, g.item_id IS NOT NULL AS hit FROM merged m LEFT JOIN gt g ON g.user_id = m.user_id AND g.item_id = m.item_id WHERE m.rank <= 10),
u AS (SELECT user_id, list(item_id ORDER BY rank) AS movies, max(hit) AS hit FROM r GROUP BY 1), h AS (SELECT user_id, list(item_id ORDER BY age DESC) AS history FROM aged WHERE age <= 10 GROUP BY 1)
SELECT u.user_id, history, movies FROM (SELECT * FROM u ORDER BY hit DESC, {_MD5 % "user_id"}, user_id LIMIT 200) u LEFT JOIN h ON h.user_id = u.user_id"""))
def evaluation_users(s, d):
    """Two hundred users, those with a hit first: their histories and their ten recommendations."""
    top = recall.label(_merged(s, d), _truth(s, d)).filter("rank <= 10").withColumn("pred_score", -F.col("rank").cast("double"))
    out = ranker.eval_set(ranker.export_top(top.drop("rank"), 10), prep.histories(X.train(s, d), 10), 200)
    return out.select("user_id", "history", F.transform("recommendations", lambda r: r["movie_id"]).alias("movies"))


def _truth(s, d):
    return X.part_of(s, d, "test")


@query(with_("metrics", "SELECT k, count(*) AS users, round(avg(hit), 6) AS hit, round(avg(ndcg), 6) AS ndcg, round(avg(recall), 6) AS recall, round(avg(mrr), 6) AS mrr FROM metrics GROUP BY 1"))
def rank_metrics_at_k(s, d):
    return metrics.at_k(_merged(s, d), _truth(s, d), [1, 5, 10]).select("k", "users", *[r6(c, c) for c in ("hit", "ndcg", "recall", "mrr")])


@query(with_("metrics", "SELECT user_id, hit, round(ndcg, 6) AS ndcg, round(recall, 6) AS recall, round(mrr, 6) AS mrr FROM metrics WHERE k = 10"))
def rank_metrics_per_user(s, d):
    return metrics.per_user(_merged(s, d), _truth(s, d), 10).select("user_id", "hit", *[r6(c, c) for c in ("ndcg", "recall", "mrr")])


@query(with_("merged train kk", "SELECT k, round(count(DISTINCT CASE WHEN rank <= k THEN item_id END) / CAST((SELECT count(DISTINCT item_id) FROM train) AS DOUBLE), 6) AS coverage FROM merged CROSS JOIN kk GROUP BY 1"))
def catalog_coverage(s, d):
    return metrics.coverage(_merged(s, d), X.train(s, d), [1, 5, 10]).select("k", r6("coverage", "coverage"))


@query(with_("merged gt", """SELECT source, count(*) AS n, round(avg(h), 6) AS hit_rate, round(coalesce(avg(CASE WHEN kg_score > 0 AND h = 1 THEN kg_score END), 0), 6) AS pos_mean, round(coalesce(avg(CASE WHEN kg_score > 0 AND h = 0 THEN kg_score END), 0), 6) AS neg_mean,
round(coalesce(avg(CASE WHEN kg_score > 0 AND h = 1 THEN kg_score END), 0) - coalesce(avg(CASE WHEN kg_score > 0 AND h = 0 THEN kg_score END), 0), 6) AS discrimination, round(coalesce(stddev_samp(CASE WHEN kg_score > 0 THEN kg_score END), 0), 6) AS score_std
FROM (SELECT m.*, CASE WHEN g.item_id IS NULL THEN 0 ELSE 1 END AS h FROM merged m LEFT JOIN gt g ON g.user_id = m.user_id AND g.item_id = m.item_id) GROUP BY 1"""))
def recall_quality_by_source(s, d):
    return metrics.source_quality(_merged(s, d), _truth(s, d)).select("source", "n", *[r6(c, c) for c in ("hit_rate", "pos_mean", "neg_mean", "discrimination", "score_std")])


_STRATA = """SELECT stratum, count(*) AS users, round(avg(r), 6) AS recall FROM (SELECT stratum, g.user_id, count(m.item_id) / CAST(count(*) AS DOUBLE) AS r
FROM gt g JOIN strata USING (item_id) LEFT JOIN (SELECT * FROM merged WHERE rank <= 10) m ON m.user_id = g.user_id AND m.item_id = g.item_id WHERE g.user_id IN (SELECT user_id FROM merged) GROUP BY 1, 2) GROUP BY 1"""


@query(with_("gt strata merged", _STRATA))
def head_tail_recall(s, d):
    strata = metrics.head_tail(prep.popularity(X.train(s, d)))
    return metrics.stratified_recall(_merged(s, d), _truth(s, d), strata, 10).select("stratum", "users", r6("recall", "recall"))


@query(with_("entropy", "SELECT user_id, round(entropy, 6) AS entropy FROM entropy"))
def user_genre_entropy(s, d):
    return metrics.user_entropy(X.train(s, d), X.metadata(s, d)).select("user_id", r6("entropy", "entropy"))


@query(with_("metrics entropy", """, z AS (SELECT m.user_id, recall, entropy FROM metrics m JOIN entropy e USING (user_id) WHERE k = 10), c AS (SELECT quantile_cont(entropy, 0.333) AS t1, quantile_cont(entropy, 0.667) AS t2 FROM z)
SELECT CASE WHEN round(entropy, 9) <= round(t1, 9) THEN 'low' WHEN round(entropy, 9) <= round(t2, 9) THEN 'mid' ELSE 'high' END AS tercile, count(*) AS users, round(avg(recall), 6) AS recall FROM z, c GROUP BY 1"""))
def entropy_tercile_recall(s, d):
    ent = metrics.user_entropy(X.train(s, d), X.metadata(s, d))
    return metrics.tercile_recall(_merged(s, d), _truth(s, d), ent, 10).select("tercile", "users", r6("recall", "recall"))


def _variant_table(s, d):
    """Head and tail recall of three candidate orders: merged, CF alone, vectors alone."""
    strata = metrics.head_tail(prep.popularity(X.train(s, d)))
    out = None
    for name, ranked in (("merged", _merged(s, d)), ("cf", _cf(s, d)), ("kg", _kg_route(s, d))):
        r = metrics.stratified_recall(ranked, _truth(s, d), strata, 10)
        row = r.agg(F.max(F.when(F.col("stratum") == "head", F.col("recall"))).alias("head"), F.max(F.when(F.col("stratum") == "tail", F.col("recall"))).alias("tail")).select(F.lit(name).alias("variant"), "*")
        out = row if out is None else out.unionByName(row)
    return out


_VARIANTS = """, vr AS (SELECT 'merged' AS variant, user_id, item_id, rank FROM merged UNION ALL SELECT 'cf', user_id, item_id, rank FROM cf UNION ALL SELECT 'kg', user_id, item_id, rank FROM kg_all),
vu AS (SELECT DISTINCT variant, user_id FROM vr),
vs AS (SELECT vu.variant, stratum, g.user_id, count(m.item_id) / CAST(count(*) AS DOUBLE) AS r FROM gt g JOIN strata USING (item_id) JOIN vu ON vu.user_id = g.user_id LEFT JOIN vr m ON m.variant = vu.variant AND m.user_id = g.user_id AND m.item_id = g.item_id AND m.rank <= 10 GROUP BY 1, 2, 3),
vt AS (SELECT variant, avg(r) FILTER (WHERE stratum = 'head') AS head, avg(r) FILTER (WHERE stratum = 'tail') AS tail FROM vs GROUP BY 1) """


@query(with_("merged cf kg_all gt strata", _VARIANTS + """SELECT v.variant, round(v.head - b.head, 6) + 0.0 AS head_lift, round(v.tail - b.tail, 6) + 0.0 AS tail_lift, v.tail - b.tail > v.head - b.head AS tail_gains_more FROM vt v, vt b WHERE b.variant = 'kg' AND v.variant <> 'kg'"""))
def lift_vs_baseline(s, d):
    return metrics.lift(_variant_table(s, d), "kg").select("variant", r6("head_lift", "head_lift"), r6("tail_lift", "tail_lift"), "tail_gains_more")


@query(with_("merged cf kg_all gt strata", _VARIANTS + """, a AS (SELECT 'head' AS metric, head AS v, variant FROM vt UNION ALL SELECT 'tail', tail, variant FROM vt)
SELECT x.metric, round(x.v, 6) AS before, round(y.v, 6) AS after, round(100.0 * (y.v - x.v) / greatest(abs(x.v), 1e-9), 4) + 0.0 AS pct FROM a x JOIN a y USING (metric) WHERE x.variant = 'cf' AND y.variant = 'merged'"""))
def relative_change(s, d):
    t = _variant_table(s, d)
    long = t.select("variant", F.explode(F.array(F.struct(F.lit("head").alias("metric"), F.col("head").alias("value")), F.struct(F.lit("tail").alias("metric"), F.col("tail").alias("value")))).alias("m")).select("variant", "m.*")
    out = metrics.relative_change(long.filter("variant = 'cf'").drop("variant"), long.filter("variant = 'merged'").drop("variant"))
    return out.select("metric", r6("before", "before"), r6("after", "after"), (F.round("pct", 4) + 0.0).alias("pct"))


_IMPORTANCE = [("cf_score", 5.0), ("kg_recall_score", 2.0), ("kg_co_liked_sum", 1.5), ("popularity", 3.0), ("vote_count", 0.5), ("kg_emb_max_cos", 1.0)]


@query("""WITH i(feature, importance) AS (VALUES ('cf_score', 5.0), ('kg_recall_score', 2.0), ('kg_co_liked_sum', 1.5), ('popularity', 3.0), ('vote_count', 0.5), ('kg_emb_max_cos', 1.0))
SELECT CASE WHEN starts_with(feature, 'kg_') THEN 'KG' WHEN feature IN ('cf_score', 'kg_recall_score') THEN 'CF' ELSE 'Content' END AS category, round(CAST(100.0 * sum(importance) / (SELECT sum(importance) FROM i) AS DOUBLE), 6) AS pct FROM i GROUP BY 1""")
def importance_share(s, d):
    return features.importance_share(s.createDataFrame(_IMPORTANCE, "feature string, importance double")).select("category", r6("pct", "pct"))


# ---------------------------------------------------------------- statistics


def _overlap_scores(s, d):
    """Overlap and word counts of each assistant turn, a stand-in for stored explanation scores."""
    p = X.turn_pairs(s, d)
    stop = F.array(*[F.lit(w) for w in S.STOP_WORDS])
    return p.select("user_id", "movie_id", text.overlap(F.col("explanation"), F.array("evidence")).alias("evidence_overlap"), F.size(F.array_except(S.tokens(F.col("explanation")), stop)).alias("n_words"))


_LEFTRIGHT = """, l AS (SELECT user_id, max_by(evidence_overlap, movie_id) AS l FROM ovl WHERE movie_id % 4 = 1 GROUP BY 1), r AS (SELECT user_id, max_by(evidence_overlap, movie_id) AS r FROM ovl WHERE movie_id % 4 = 3 GROUP BY 1) """


def _aligned(s, d):
    """First against second question of a conversation; of several the last one counts."""
    rows = _overlap_scores(s, d).withColumn("seq", F.col("movie_id"))
    left = rows.filter("movie_id % 4 = 1").withColumn("movie_id", F.lit(0))
    right = rows.filter("movie_id % 4 = 3").withColumn("movie_id", F.lit(0))
    return stats.align(left, right, "evidence_overlap")


@query(with_("ovl", _LEFTRIGHT + "SELECT user_id, round(l, 6) AS left_value, round(r, 6) AS right_value FROM l JOIN r USING (user_id)"))
def pair_alignment(s, d):
    return _aligned(s, d).select("user_id", r6("left_value", "left_value"), r6("right_value", "right_value"))


@query(with_("ovl", _LEFTRIGHT + "SELECT count(*) AS pair_count, round(avg(l), 6) AS left_mean, round(avg(r), 6) AS right_mean, round(avg(l - r), 6) + 0.0 AS mean_difference, round(avg(l - r) / (stddev_samp(l - r) / sqrt(count(*))), 6) AS t_statistic FROM l JOIN r USING (user_id)"))
def paired_ttest_stat(s, d):
    return stats.paired_t(_aligned(s, d)).select("pair_count", *[r6(c, c) for c in ("left_mean", "right_mean", "mean_difference", "t_statistic")])


def _long_scores(s, d):
    rows = _overlap_scores(s, d).select(F.concat(F.lit("E"), (F.floor(F.col("movie_id") / 2) % 4 + 1).cast("string")).alias("label"), "user_id", F.lit(0).alias("movie_id"), "evidence_overlap", F.col("n_words").cast("double").alias("n_words"))
    long = rows.select("label", "user_id", "movie_id", F.explode(F.array(F.struct(F.lit("overlap").alias("metric"), F.col("evidence_overlap").alias("value")), F.struct(F.lit("n_words").alias("metric"), F.col("n_words").alias("value")))).alias("m"))
    return long.select("label", "user_id", "movie_id", "m.*").groupBy("label", "user_id", "movie_id", "metric").agg(F.avg("value").alias("value"))


@query(with_("ovl", """, lg AS (SELECT label, user_id, metric, avg(value) AS value FROM (SELECT 'E' || (movie_id // 2 % 4 + 1) AS label, user_id, 'overlap' AS metric, evidence_overlap AS value FROM ovl UNION ALL SELECT 'E' || (movie_id // 2 % 4 + 1), user_id, 'n_words', CAST(n_words AS DOUBLE) FROM ovl) GROUP BY 1, 2, 3)
SELECT l.label AS left_label, r.label AS right_label, l.metric, count(*) AS pair_count, round(avg(l.value), 6) AS left_mean, round(avg(r.value), 6) AS right_mean, round(avg(l.value - r.value), 6) + 0.0 AS mean_difference,
CASE WHEN stddev_samp(l.value - r.value) > 0 THEN round(avg(l.value - r.value) / (stddev_samp(l.value - r.value) / sqrt(count(*))), 5) END AS t_statistic
FROM lg l JOIN lg r ON l.user_id = r.user_id AND l.metric = r.metric AND l.label = 'E1' AND r.label IN ('E2', 'E3', 'E4') GROUP BY 1, 2, 3"""))
def comparison_matrix(s, d):
    out = stats.comparison_matrix(_long_scores(s, d), [("E1", "E2"), ("E1", "E3"), ("E1", "E4")])
    return out.select("left_label", "right_label", "metric", "pair_count", *[r6(c, c) for c in ("left_mean", "right_mean", "mean_difference")], F.round("t_statistic", 5).alias("t_statistic"))


# ---------------------------------------------------------------- text


_CHUNKS = """, pieces AS (SELECT source_id, unnest(parts) AS s, generate_subscripts(parts, 1) AS p FROM sent),
grp AS (SELECT *, sum(CASE WHEN p = 1 OR length(s) >= 20 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY p) AS g FROM pieces),
chunks AS (SELECT source_id, CAST(g - 1 AS INTEGER) AS pos, string_agg(s, ' ' ORDER BY p) AS text FROM grp GROUP BY 1, 2) """


def _chunks(s, d):
    return text.sentence_chunks(readers.parquet(s, d, "documents").select(F.col("doc_id").alias("source_id"), "text"))


@query(with_("sent", _CHUNKS + "SELECT source_id, pos, text FROM chunks"))
def corpus_chunks(s, d):
    return _chunks(s, d)


@query(with_("sent", _CHUNKS + "SELECT row_number() OVER (ORDER BY source_id, pos) - 1 AS doc_id, source_id, pos, text FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_id, pos) AS rn FROM chunks) WHERE rn = 1"))
def corpus_dedupe(s, d):
    return text.build_corpus(_chunks(s, d), ["source_id", "pos"]).select("doc_id", "source_id", "pos", "text")


@query(with_("sent", _CHUNKS + "SELECT row_number() OVER (ORDER BY source_id, pos) - 1 AS doc_id, source_id AS movie_id FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY source_id, pos) AS rn FROM chunks) WHERE rn = 1"))
def corpus_sink(s, d):
    """The corpus and its document-to-movie map, written; the map read back."""
    path = f"{root(s)}/corpus-{uuid.uuid4().hex}"
    sinks.corpus(text.build_corpus(_chunks(s, d), ["source_id", "pos"]).withColumnRenamed("source_id", "movie_id"), path)
    return readers.required(s, f"{path}/doc_to_movie")


@query("""SELECT item_id AS movie_id, text, source FROM (
SELECT p_partkey AS item_id, p_name || ': ' || p_name || ' by ' || p_brand || '.' AS text, 'overview' AS source FROM part
UNION ALL SELECT p_partkey, p_name || ' — "' || p_type || '"', 'tagline' FROM part WHERE length(trim(p_type)) > 3
UNION ALL SELECT p_partkey, p_name || ' is a ' || p_type || ', ' || replace(p_name, ' ', ', ') || ' film.', 'genre' FROM part
UNION ALL SELECT p_partkey, p_name || ' is directed by ' || p_brand || '.', 'cast' FROM part)""")
def metadata_chunks(s, d):
    p = readers.parquet(s, d, "part")
    meta = p.select(
        F.col("p_partkey").alias("movie_id"), F.col("p_name").alias("title"), F.concat("p_name", F.lit(" by "), "p_brand", F.lit(".")).alias("overview"), F.col("p_type").alias("tagline"),
        F.concat(F.array("p_type"), F.split("p_name", " ")).alias("genres"), F.array().cast("array<string>").alias("actors"), F.array("p_brand").alias("directors"),
    )
    return text.metadata_chunks(meta).select("movie_id", "text", "source")


@query(with_("bm", "SELECT q, doc_id, round(score, 5) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(score, 5) DESC, doc_id) AS rank FROM bm) WHERE rank <= 10"))
def bm25_topk(s, d):
    docs = readers.parquet(s, d, "documents").select("doc_id", "text")
    asked = readers.parquet(s, d, "benchmark").select(F.col("item_id").alias("q"), "text")
    return text.top_docs(text.bm25(docs, asked), 10, 5).select("q", "doc_id", F.round("score", 5).alias("score"), "rank")


def _doc_vectors(s, d):
    """Documents borrow the vector table by id; documents beyond it have none and score 0 in the dense route."""
    return X.vectors(s, d).withColumnRenamed("item_id", "doc_id")


@query(with_("bm vec", """, qv AS (SELECT b.item_id AS q, u AS qu FROM benchmark b LEFT JOIN vec ON vec.item_id = b.item_id),
dense AS (SELECT q, item_id AS doc_id FROM (SELECT q, item_id, row_number() OVER (PARTITION BY q ORDER BY round(list_inner_product(qu, u), 6) DESC, item_id) AS rn FROM qv CROSS JOIN vec WHERE qu IS NOT NULL) WHERE rn <= 40),
nb AS (SELECT q, doc_id, score / CASE WHEN max(score) OVER (PARTITION BY q) > 0 THEN max(score) OVER (PARTITION BY q) ELSE 1.0 END AS s FROM bm),
sp AS (SELECT q, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 6) DESC, doc_id) AS rn FROM nb WHERE s > 0) WHERE rn <= 40),
f AS (SELECT * FROM dense UNION SELECT * FROM sp),
z AS (SELECT f.q, f.doc_id, d.text, coalesce(list_inner_product(qu, u), 0.0) AS dn, coalesce(s, 0.0) AS s FROM f JOIN qv USING (q) LEFT JOIN vec ON vec.item_id = f.doc_id LEFT JOIN nb ON nb.q = f.q AND nb.doc_id = f.doc_id JOIN documents d ON d.doc_id = f.doc_id),
y AS (SELECT q, doc_id, text, round(dn, 4) + 0.0 AS dense_score, round(s, 4) AS bm25_score, round(CAST(0.6 AS DOUBLE) * dn + CAST(0.4 AS DOUBLE) * s, 4) + 0.0 AS score FROM z),
x AS (SELECT *, row_number() OVER (PARTITION BY q, text ORDER BY score DESC, doc_id) AS n FROM y)
SELECT q, doc_id, dense_score, bm25_score, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM x WHERE n = 1) WHERE rank <= 8"""))
def hybrid_topk(s, d):
    docs = readers.parquet(s, d, "documents").select("doc_id", "text")
    asked = readers.parquet(s, d, "benchmark").select(F.col("item_id").alias("q"), "text").join(X.vectors(s, d).withColumnRenamed("item_id", "q"), "q", "left")
    out = text.hybrid(docs, asked, _doc_vectors(s, d).join(docs.select("doc_id"), "doc_id", "left_semi"))
    return out.select("q", "doc_id", (F.col("dense_score") + 0.0).alias("dense_score"), "bm25_score", (F.col("score") + 0.0).alias("score"), "rank")


@query("""SELECT p_partkey, 'Why should someone who enjoyed ' || array_to_string(h, ', ') || ' watch ' || p_name || '?' || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' The movie is a ' || p_type || ', ' || replace(p_name, ' ', ', ') || ' film.' END AS query
FROM (SELECT p_partkey, p_name, p_type, [p_name, p_brand, p_type, p_name, p_brand, p_type][1:5] AS h FROM part)""")
def retrieval_query_text(s, d):
    p = readers.parquet(s, d, "part")
    history = F.array("p_name", "p_brand", "p_type", "p_name", "p_brand", "p_type")
    genres = F.when(F.col("p_partkey") % 5 == 0, F.array().cast("array<string>")).otherwise(F.concat(F.array("p_type"), F.split("p_name", " ")))
    return p.select("p_partkey", S.retrieval_query(F.col("p_name"), genres, history).alias("query"))


@query(with_("ovl", "SELECT user_id, movie_id, round(evidence_overlap, 6) AS evidence_overlap FROM ovl"))
def evidence_overlap(s, d):
    return _overlap_scores(s, d).select("user_id", "movie_id", r6("evidence_overlap", "evidence_overlap"))


def _records(s, d):
    """A record per conversation: its turns as evidence, assistant turns as reference where the conversation id is even."""
    c = readers.parquet(s, d, "conversations")
    item = F.struct(
        F.when(F.col("turn") % 3 > 0, 100 - F.col("turn")).alias("doc_id"), F.col("turn").alias("movie_id"), "text", F.col("role").alias("source"),
        F.lit(0.0).alias("dense_score"), F.lit(0.0).alias("bm25_score"), (F.pmod(F.col("turn") * 7 + F.col("conv_id"), F.lit(11)) / 10.0).alias("score"),
    )
    rows = c.withColumn("item", item).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "item"))).alias("x"), F.max("turn").alias("last"))
    used = F.transform("x", lambda e: e["item"])
    ref = F.when(F.col("conv_id") % 2 == 0, F.filter(used, lambda e: e["source"] == "assistant"))
    return rows.select(F.col("conv_id").alias("user_id"), F.col("last").alias("movie_id"), used.alias("evidence_used"), ref.alias("reference_evidence"))


_REC = """it AS (SELECT conv_id, turn, CASE WHEN turn % 3 > 0 THEN 100 - turn END AS doc_id, text, role, (turn * 7 + conv_id) % 11 / CAST(10.0 AS DOUBLE) AS score FROM conversations)"""


@query(f"""WITH {_REC}, src AS (SELECT * FROM it WHERE conv_id % 2 <> 0 OR role = 'assistant' OR conv_id NOT IN (SELECT conv_id FROM it WHERE role = 'assistant'))
, o AS (SELECT conv_id, doc_id, trim(text) AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM src)
SELECT c.conv_id AS user_id, coalesce(list(o.text ORDER BY CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END, coalesce(doc_id, i), i) FILTER (WHERE o.text <> ''), ['']) AS evidence
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN o ON o.conv_id = c.conv_id GROUP BY 1""")
def canonical_evidence(s, d):
    def slim(c):
        return F.transform(c, lambda e: F.struct(e["doc_id"].cast("bigint").alias("doc_id"), e["text"].alias("text")))

    return _records(s, d).select("user_id", text.canonical_evidence(slim(F.col("reference_evidence")), slim(F.col("evidence_used"))).alias("evidence"))


@query(f"""WITH {_REC}, n AS (SELECT conv_id, count(*) AS used, count(*) FILTER (WHERE role = 'assistant') AS said FROM it GROUP BY 1)
SELECT conv_id AS user_id, CASE WHEN conv_id % 2 = 0 AND said > 0 THEN said WHEN conv_id % 3 = 0 THEN 1 ELSE used END AS n_reference FROM n""")
def reference_fallback(s, d):
    records = _records(s, d)
    table = records.filter("user_id % 3 = 0").select("user_id", "movie_id", F.slice("evidence_used", 1, 1).alias("evidence_used"))
    return explain.with_reference(records, table).select("user_id", F.size("reference_evidence").cast("bigint").alias("n_reference"))


# ---------------------------------------------------------------- explanations


@query(f"""WITH {_REC}, u AS (SELECT conv_id, list(text ORDER BY turn) AS t FROM it GROUP BY 1)
SELECT conv_id AS user_id, array_to_string(list_concat(['path a', 'path b'], t), '|') AS hybrid, 'path a|path b' AS kg_only, array_to_string(t, '|') AS retrieval_only FROM u""")
def evidence_bundle(s, d):
    r = _records(s, d).withColumn("kg", explain.kg_evidence(F.array(F.lit("path a"), F.lit(""), F.lit("path b"), F.lit("path c")), F.col("movie_id")))

    def texts(mode):
        return F.array_join(F.transform(explain.bundle(F.col("evidence_used"), F.col("kg"), mode), lambda e: e["text"]), "|").alias(mode)

    return r.select("user_id", *[texts(m) for m in ("hybrid", "kg_only", "retrieval_only")])


@query(f"""WITH {_REC}, o AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY score, turn DESC) AS rn FROM it)
SELECT conv_id AS user_id, coalesce(array_to_string(list(CAST(turn AS VARCHAR) ORDER BY rn) FILTER (WHERE rn <= n - greatest(1, n // 2)), ','), '') AS kept FROM o GROUP BY 1""")
def perturb_e2(s, d):
    out = explain.perturb(_records(s, d), "E2", "retrieval_only")
    return out.select("user_id", F.array_join(F.transform("evidence_used", lambda e: e["movie_id"].cast("string")), ",").alias("kept"))


@query(with_("merged hist20 und", _PATHS + "SELECT c.user_id, c.item_id AS movie_id FROM merged c WHERE rank <= 10 AND EXISTS (SELECT 1 FROM paths p WHERE p.user_id = c.user_id AND p.item_id = c.item_id)"))
def kg_only_filter(s, d):
    paths = _paths(s, d).select("user_id", F.col("item_id").alias("movie_id"))
    recs = _merged(s, d).filter("rank <= 10").select("user_id", F.col("item_id").alias("movie_id"))
    return explain.explainable(recs, paths, "kg_only")[0]


@query(with_("turnp", "SELECT user_id, movie_id FROM turnp WHERE user_id % 3 <> 0"))
def resume_antijoin(s, d):
    pairs = X.turn_pairs(s, d).select("user_id", "movie_id")
    return explain.pending(pairs, pairs.filter("user_id % 3 = 0"))


@query(with_("ovl", "SELECT 'E' || (movie_id // 2 % 4 + 1) AS condition, count(*) AS n, round(avg(evidence_overlap), 4) AS evidence_overlap FROM ovl GROUP BY 1"))
def faithfulness_summary(s, d):
    rows = _overlap_scores(s, d).withColumn("condition", F.concat(F.lit("E"), (F.floor(F.col("movie_id") / 2) % 4 + 1).cast("string")))
    return text.summarise(rows.select("condition", "evidence_overlap"))


_HASH = "CAST('0x' || substr(md5(%s || ':42'), 1, 8) AS BIGINT)"


@query(f"""WITH {_REC}, l AS (SELECT conv_id, max(turn) AS last FROM it GROUP BY 1), o AS (SELECT it.conv_id, turn, row_number() OVER (PARTITION BY it.conv_id ORDER BY turn) - 1 AS i, last FROM it JOIN l ON l.conv_id = it.conv_id)
SELECT conv_id AS user_id, list(turn ORDER BY {_HASH % "conv_id || '_' || last || ':' || i"}, i) AS turns FROM o GROUP BY 1""")
def perturb_e3(s, d):
    out = explain.perturb(_records(s, d), "E3", "retrieval_only")
    return out.select("user_id", F.transform("evidence_used", lambda e: e["movie_id"]).alias("turns"))


@query(f"""WITH {_REC}, rec AS (SELECT conv_id AS user_id, max(turn) AS movie_id, count(*) AS k FROM it GROUP BY 1), c AS (SELECT doc_id, row_number() OVER (ORDER BY {_HASH % "doc_id"}, doc_id) - 1 AS place, count(*) OVER () AS n FROM documents),
z AS (SELECT user_id, movie_id, k, doc_id, row_number() OVER (PARTITION BY user_id, movie_id ORDER BY (place - {_HASH % "user_id || ':' || movie_id"} % n + n) % n) AS r FROM rec JOIN c ON c.doc_id <> rec.movie_id)
SELECT user_id, movie_id, list(doc_id ORDER BY r) AS doc_ids FROM z WHERE r <= k GROUP BY 1, 2""")
def perturb_e4(s, d):
    docs = readers.parquet(s, d, "documents").select("doc_id", F.col("doc_id").alias("movie_id"), "text", "source")
    out = explain.perturb(_records(s, d), "E4", "retrieval_only", docs)
    return out.select("user_id", "movie_id", F.transform("evidence_used", lambda e: e["doc_id"]).alias("doc_ids"))


_LCS = r""", w AS (SELECT user_id, movie_id, [x FOR x IN string_split_regex(lower(explanation), '\s+') IF x <> ''] AS h, [x FOR x IN string_split_regex(lower(evidence), '\s+') IF x <> ''] AS r FROM turnp),
lcs AS (SELECT user_id, movie_id, h, r, 0 AS j, [0 FOR x IN r] AS best FROM w WHERE len(h) > 0 AND len(r) > 0
UNION ALL SELECT user_id, movie_id, h, r, j + 1, [list_max([greatest(best[p], CASE WHEN r[p] = h[j + 1] THEN coalesce(best[p - 1], 0) + 1 ELSE 0 END) FOR p IN range(1, i + 1)]) FOR i IN range(1, len(r) + 1)] FROM lcs WHERE j < len(h))
SELECT w.user_id, w.movie_id, round(coalesce(best[len(w.r)] / CAST(len(w.h) AS DOUBLE), 0.0), 6) AS rouge_l FROM w LEFT JOIN lcs ON lcs.user_id = w.user_id AND lcs.movie_id = w.movie_id AND j = len(w.h)"""


@query(f"""WITH {_REC}, n AS (SELECT conv_id, count(*) AS n FROM it GROUP BY 1)
SELECT c AS condition, CAST(sum(CASE WHEN c = 'E2' THEN n - greatest(1, n // 2) ELSE n END) AS BIGINT) AS n_items FROM n, (SELECT unnest(['E1', 'E2', 'E3', 'E4']) AS c) GROUP BY 1""")
def perturb_conditions(s, d):
    """All four conditions through the dispatcher: how much evidence each leaves."""
    docs = readers.parquet(s, d, "documents").select("doc_id", F.col("doc_id").alias("movie_id"), "text", "source")
    out = None
    for c in ("E1", "E2", "E3", "E4"):
        n = explain.perturb(_records(s, d), c, "retrieval_only", docs).agg(F.sum(F.size("evidence_used")).alias("n_items")).select(F.lit(c).alias("condition"), "n_items")
        out = n if out is None else out.unionByName(n)
    return out


@query(with_("turnp", _LCS).replace("WITH ", "WITH RECURSIVE ", 1))
def rouge_l(s, d):
    return X.turn_pairs(s, d).select("user_id", "movie_id", F.round(text.rouge_l(F.col("explanation"), F.array("evidence")), 6).alias("rouge_l"))


@query()
def bertscore_like(s, d):
    rows = X.turn_pairs(s, d).select("user_id", "movie_id", "explanation", F.array("evidence").alias("evidence"))
    return text.bertscore(rows).select("user_id", "movie_id", F.round("bert_score_f1", 6).alias("bert_score_f1"))


@query()
def faithfulness_evaluate(s, d):
    p = X.turn_pairs(s, d)
    one = F.array(F.struct(F.lit(1).cast("bigint").alias("doc_id"), F.col("evidence").alias("text")))
    return text.evaluate(p.select("user_id", "movie_id", F.lit("rag").alias("condition"), "explanation", one.alias("reference_evidence"), one.alias("evidence_used"))).drop("explanation")


# ---------------------------------------------------------------- learned: rows only, or SQL over a stored score


def _names(s, d):
    return features.resolve(features.FEATURE_SETS["V4"], _frame(s, d).columns)


_SCORED = ["user_id", "item_id", "label"]


def _pointwise(s, d):
    """Test candidates scored by the pointwise ranker, which saw validation labels only."""
    return stored(s, d, "pointwise", lambda: ranker.Pointwise(_names(s, d), POINT_ROUNDS).fit(_fit_rows(s, d)).score(_test_rows(s, d), _SCORED))


@query()
def gbt_pointwise(s, d):
    return ranker.ranked(_pointwise(s, d), 10).select("user_id", "item_id", F.round("pred_score", 6).alias("pred_score"), "rank")


@query()
def lambdamart(s, d):
    fit = _fit_rows(s, d)
    model = ranker.LambdaMart(_names(s, d), LAMBDA_ROUNDS, patience=LAMBDA_PATIENCE).fit(ranker.cap_groups(fit.filter("NOT is_val")), fit.filter("is_val"))
    return ranker.ranked(model.score(_test_rows(s, d), _SCORED), 10).select("user_id", "item_id", F.round("pred_score", 6).alias("pred_score"), "rank")


@query()
def grid_search(s, d):
    """All eight combinations of the grid, each with early stopping, on validation users."""
    fit = _fit_rows(s, d)
    found = ranker.grid(_names(s, d), fit, fit.filter("is_val"), *ranker.GRID, rounds=GRID_ROUNDS)
    return s.createDataFrame([(r["depth"], r["rate"], r["min_child"], round(r["ndcg"], 6)) for r in found], "depth int, rate double, min_child int, ndcg double")


@query()
def ranker_metrics(s, d):
    """Re-ranking metrics at 1, 5 and 10 on test users."""
    return ranker.evaluate(_pointwise(s, d), [1, 5, 10]).select("k", "users", *[r6(c, c) for c in ("hit", "ndcg", "recall", "mrr")])


@query()
def export_topk(s, d):
    """The ten best by the ranker's own score, and the evaluation set made of them."""
    recs = ranker.export_top(_pointwise(s, d), 10)
    return ranker.eval_set(recs, prep.histories(X.train(s, d), 10), 200).select("user_id", F.size("history").alias("n_history"), F.size("recommendations").alias("n_recommendations"))


#: Reduced settings of registered learned queries (their cost is in the README); the operators' defaults are larger.
POINT_ROUNDS, LAMBDA_ROUNDS, LAMBDA_PATIENCE, GRID_ROUNDS = 30, 20, 5, 10
EMBED_DIM, EMBED_EPOCHS = 32, 10


@query()
def als_recall(s, d):
    return embed.als_top(X.train(s, d), 20).select("user_id", "item_id", F.round("score", 4).alias("score"), "rank")


@query()
def bpr_mf(s, d):
    users, items, _ = embed.bpr(X.train(s, d), EMBED_DIM, EMBED_EPOCHS)
    return embed.factor_top(users, items, X.train(s, d), 10).select("user_id", "item_id", F.round("score", 4).alias("score"), "rank")


@query(with_("train", """, e AS (SELECT t.user_id, t.item_id, 1 / sqrt(CAST(u.n * i.n AS DOUBLE)) AS w FROM train t JOIN (SELECT user_id, count(*) AS n FROM train GROUP BY 1) u USING (user_id) JOIN (SELECT item_id, count(*) AS n FROM train GROUP BY 1) i USING (item_id)),
b AS (SELECT 'u' || user_id AS src, 'i' || item_id AS dst, w FROM e UNION ALL SELECT 'i' || item_id, 'u' || user_id, w FROM e),
x0 AS (SELECT DISTINCT src AS id, CAST(length(src) AS DOUBLE) AS e0, CASE WHEN src LIKE 'u%' THEN 1.0 ELSE -1.0 END AS e1 FROM b),
x1 AS (SELECT dst AS id, sum(w * e0) AS e0, sum(w * e1) AS e1 FROM b JOIN x0 ON src = id GROUP BY 1), x2 AS (SELECT dst AS id, sum(w * e0) AS e0, sum(w * e1) AS e1 FROM b JOIN x1 ON src = id GROUP BY 1)
SELECT id, round(sum(e0) / 3, 6) + 0.0 AS e0, round(sum(e1) / 3, 6) + 0.0 AS e1 FROM (SELECT * FROM x0 UNION ALL SELECT * FROM x1 UNION ALL SELECT * FROM x2) GROUP BY 1"""))
def lightgcn_propagation(s, d):
    edges = embed.normalised_edges(X.train(s, d))
    nodes = edges.select(F.col("src").alias("id")).distinct().select("id", F.length("id").cast("double").alias("e0"), F.when(F.col("id").startswith("u"), 1.0).otherwise(-1.0).alias("e1"))
    return embed.layer_mean(edges, nodes, 2, 2).select("id", r6("e0", "e0"), r6("e1", "e1"))


@query()
def lightgcn_fit(s, d):
    out, losses = embed.lightgcn(X.train(s, d), 16, 3, 3)
    return out.select("id", *[F.round(f"e{k}", 6).alias(f"e{k}") for k in range(16)])


def _kg_embedding(s, d, model):
    kg = _kg(s, d)
    vec, _, _ = embed.train_kg(kg, graph.entities(kg), model, EMBED_DIM, EMBED_EPOCHS)
    return vec.select("id", F.transform("vector", lambda x: F.round(x, 5)).alias("vector"))


@query()
def transe_embed(s, d):
    return _kg_embedding(s, d, "transe")


@query()
def rotate_embed(s, d):
    return _kg_embedding(s, d, "rotate")


@query(with_("ovl", _LEFTRIGHT + f""", b AS (SELECT user_id, l - r AS d, unnest(range(500)) AS block FROM l JOIN r USING (user_id)), hb AS (SELECT d, block, md5(user_id || ':0:' || block || ':42') AS x FROM b),
dr AS (SELECT d, block * 4 + k AS round, (CAST('0x' || substr(x, CAST(8 * k + 1 AS INTEGER), 8) AS BIGINT) + 0.5) / CAST(4294967296.0 AS DOUBLE) AS u FROM hb, (SELECT unnest(range(4)) AS k)),
wt AS (SELECT round, d, {" + ".join(f"CASE WHEN u > CAST({end!r} AS DOUBLE) THEN 1 ELSE 0 END" for end in stats.POISSON_ENDS)} AS w FROM dr), ms AS (SELECT round, sum(w * d) / CAST(nullif(sum(w), 0) AS DOUBLE) AS m FROM wt GROUP BY 1)
SELECT round(quantile_cont(m, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(m, 0.975), 6) + 0.0 AS ci_high FROM ms"""))
def bootstrap_ci(s, d):
    return stats.bootstrap_distributed(_aligned(s, d)).select(r6("ci_low", "ci_low"), r6("ci_high", "ci_high"))


@query("""SELECT p_partkey, p_name || ' suits this user. ' || CASE WHEN p_partkey % 4 = 0 THEN 'It matches what this user likes.' ELSE 'As noted: ' || p_name || ' is a ' || p_type || ' film.' END AS explanation FROM part""".replace("p_name || ' suits", "p_name || CASE WHEN p_partkey % 4 = 0 THEN ' (' || p_type || ')' ELSE '' END || ' suits"))
def generate_explanations(s, d):
    p = readers.parquet(s, d, "part")
    titles, genres = F.array("p_name", "p_brand"), F.array("p_type")
    evidence = F.array(F.struct(F.concat("p_name", F.lit(" is a "), "p_type", F.lit(" film.")).alias("text")))
    prompt = F.when(F.col("p_partkey") % 4 == 0, explain.plain_prompt(titles, F.col("p_name"), genres)).otherwise(explain.rag_prompt(titles, F.col("p_name"), evidence))
    asked = p.select("p_partkey", F.lit(explain.RAG_SYSTEM).alias("system"), prompt.alias("prompt"))
    return explain.generate(asked, explain.TemplateBackend()).select("p_partkey", "explanation")


@query("SELECT p_partkey AS user_id, p_size AS movie_id FROM part")
def streaming_resume(s, d):
    """Two runs of the resumable stream over the same requests: each pair is answered once."""
    base = f"{root(s)}/stream-{uuid.uuid4().hex}"
    p = readers.parquet(s, d, "part").select(F.col("p_partkey").alias("user_id"), F.col("p_size").alias("movie_id"), F.lit(explain.RAG_SYSTEM).alias("system"), F.col("p_name").alias("prompt"))
    for part in ("user_id % 2 = 0", "true"):
        p.filter(part).write.mode("append").parquet(f"{base}/requests")
        resume.run(s, f"{base}/requests", p.schema, f"{base}/results", f"{base}/checkpoint", explain.TemplateBackend()).awaitTermination()
    return s.read.parquet(f"{base}/results").select("user_id", "movie_id")
