"""Every query by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import graph, metrics, ordering, sampling, scoring, similarity, training, walks
from ..sources import adjacency, bundles, logs, shared
from . import graphs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def r(column, digits: int = 6):
    return F.round(column, digits)


def long_form(frame: DataFrame, name: str, digits: int = 8) -> DataFrame:
    """(idx, d, value) of (idx, name)."""
    return frame.select("idx", F.posexplode(name).alias("d", "x")).select("idx", "d", r("x", digits).alias("value"))


# ---- common table expressions of the SQL

HASH = "('0x' || substr(md5({0}), 1, 8))::BIGINT"


def h(*parts: str) -> str:
    return HASH.format("concat_ws(':', " + ", ".join(f"({p})::VARCHAR" for p in parts) + ")")


G1 = "g1 AS (SELECT 'c' || o_custkey AS src, 'p' || l_partkey AS dst FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
G2 = "g2 AS (SELECT event_id, src, dst FROM (SELECT event_id, lag(user_id) OVER (ORDER BY ts, event_id) AS src, user_id AS dst FROM events) WHERE src IS NOT NULL)"
G1_BOTH = "both_ways AS (SELECT src, dst FROM g1 UNION ALL SELECT dst, src FROM g1)"
G2_INDEX = """seen AS (SELECT src AS node, 2 * event_id AS key FROM g2 UNION ALL SELECT dst, 2 * event_id + 1 FROM g2),
 idx AS (SELECT node, row_number() OVER (ORDER BY key, node) - 1 AS idx FROM (SELECT node, min(key) AS key FROM seen GROUP BY node))"""
G2_CODED = "coded AS (SELECT a.idx AS src, b.idx AS dst FROM g2 JOIN idx a ON g2.src = a.node JOIN idx b ON g2.dst = b.node)"
G1_SPLIT = f"""copies AS (SELECT src, dst, row_number() OVER (PARTITION BY src, dst) AS dup_no FROM g1),
 ranked AS (SELECT src, dst, dup_no, row_number() OVER (ORDER BY {h("42", "src", "dst", "dup_no")}, src, dst, dup_no) - 1 AS rank FROM copies)"""
SPLIT = "split AS (SELECT src, dst, dup_no, CASE WHEN rank < greatest(1, floor((SELECT count(*) FROM g1) * 0.05)) THEN 'val' ELSE 'train' END AS part FROM ranked)"
SCORED = "s AS (SELECT (doc_id * 7919 % 101) / 100.0::DOUBLE AS score, quality::INT AS label FROM labels WHERE quality IS NOT NULL AND doc_id IS NOT NULL)"
GRID = "grid AS (SELECT 0.05::DOUBLE + k * 0.010000000000000002::DOUBLE AS threshold FROM range(91) t(k))"
SWEEP = """counts AS (SELECT threshold, count(*) FILTER (WHERE score >= threshold AND label = 1) AS tp, count(*) FILTER (WHERE score >= threshold AND label = 0) AS fp,
  count(*) FILTER (WHERE score < threshold AND label = 1) AS fn FROM grid CROSS JOIN s GROUP BY threshold),
 pr AS (SELECT *, tp / (tp + fp + 1e-8::DOUBLE) AS p, tp / (tp + fn + 1e-8::DOUBLE) AS rc FROM counts),
 swept AS (SELECT threshold, tp, fp, fn, p, rc, 2.0::DOUBLE * p * rc / (p + rc + 1e-8::DOUBLE) AS f1 FROM pr)"""
AUC = """ranks AS (SELECT score, label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS rk FROM s),
 auc AS (SELECT (sum(rk) FILTER (WHERE label = 1) - c.p * (c.p + 1) / 2.0::DOUBLE) / (c.p * c.n) AS auc
  FROM ranks CROSS JOIN (SELECT count(*) FILTER (WHERE label = 1)::DOUBLE AS p, count(*) FILTER (WHERE label = 0)::DOUBLE AS n FROM s) c GROUP BY c.p, c.n)"""
AP = """cuts AS (SELECT score, sum(label)::DOUBLE AS pos, count(*)::DOUBLE AS n FROM s GROUP BY score),
 cum AS (SELECT pos, sum(pos) OVER (ORDER BY score DESC) / sum(n) OVER (ORDER BY score DESC) AS prec FROM cuts),
 ap AS (SELECT sum(pos * prec) / sum(pos) AS ap FROM cum)"""
BEST = "best AS (SELECT coalesce(max(f1), 0.0) AS f1, coalesce((SELECT min(threshold) FROM swept w WHERE w.f1 = (SELECT max(f1) FROM swept) AND w.f1 > 0), 0.5) AS threshold FROM swept)"
MEANS = "means AS (SELECT avg(score) FILTER (WHERE label = 1) AS pos_mean, avg(score) FILTER (WHERE label = 0) AS neg_mean FROM s)"
VEC = "vec AS (SELECT vec_id AS idx, embedding::DOUBLE[] AS vec FROM embeddings)"
NEXT = "nxt AS (SELECT vec_id - 1 AS idx, embedding::DOUBLE[] AS vec FROM embeddings)"
PAIRS = "pairs AS (SELECT vec_id AS src, vec_id + 1 AS dst, 1 AS label FROM embeddings UNION ALL SELECT vec_id, vec_id * 7 % 251, 0 FROM embeddings)"
SYM = "sc AS (SELECT p.src, p.dst, p.label, a.vec AS av, b.vec AS bv, list_dot_product(a.vec, b.vec) AS x FROM pairs p JOIN vec a ON p.src = a.idx JOIN vec b ON p.dst = b.idx)"
DIR = "sc AS (SELECT p.src, p.dst, p.label, a.vec AS av, b.vec AS bv, list_dot_product(a.vec, b.vec) AS x FROM pairs p JOIN vec a ON p.src = a.idx JOIN nxt b ON p.dst = b.idx)"
BCE_GRAD = f"""WITH {VEC}, {PAIRS}, {SYM}, g AS (SELECT *, (1 / (1 + exp(-x)) - label) / count(*) OVER () AS g FROM sc),
 parts AS (SELECT src AS idx, bv AS v, g FROM g UNION ALL SELECT dst, av, g FROM g),
 el AS (SELECT idx, unnest(v) AS v, unnest(range(len(v))) AS d, g FROM parts),
 grad AS (SELECT idx, d, sum(v * g) AS grad FROM el GROUP BY idx, d)"""
WALK = """nb AS (SELECT src AS node, dst AS nbr, row_number() OVER (PARTITION BY src ORDER BY dst) - 1 AS k, count(*) OVER (PARTITION BY src) AS degree FROM {edges}),
 w AS (SELECT node || ':0' AS walk_id, 0 AS pos, node FROM starts
  UNION ALL SELECT w.walk_id, w.pos + 1, nb.nbr FROM w JOIN nb ON nb.node = w.node AND nb.k = {hash} % nb.degree WHERE w.pos < {last})"""
WALK_HASH = HASH.format("concat_ws(':', '42', w.walk_id, (w.pos + 1)::VARCHAR)")
SIMILAR = f"""WITH {G1}, e AS (SELECT DISTINCT src, dst FROM g1), d AS (SELECT src, count(*) AS d FROM e GROUP BY src),
 c AS (SELECT a.src AS u, b.src AS v, count(*) AS common FROM e a JOIN e b ON a.dst = b.dst AND a.src <> b.src GROUP BY 1, 2)"""
JACCARD = SIMILAR + """, sim AS (SELECT u, v, common, common::DOUBLE / (du.d + dv.d - common) AS sim FROM c JOIN d du ON u = du.src JOIN d dv ON v = dv.src),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY sim DESC, v) AS rank FROM sim) WHERE rank <= 5)"""
LINES = """lines AS (SELECT event_id AS line, CASE event_id % 4 WHEN 0 THEN 'Epoch 1/20 | Step ' || event_id || ' | Loss: ' || (event_id % 97) || '.25 | Pairs: 99'
  WHEN 1 THEN '  [VAL] Step ' || event_id || ' | AUC: 0.' || (event_id % 89 + 10) || ' | AP: 0.5 | F1: 0.' || (event_id % 7) || ' | Threshold: 0.5'
  WHEN 2 THEN 'Step ' || event_id || '/2000 | Loss: 0.' || (event_id % 10) || ' | LR: 0.009' ELSE '  [VAL] Step 7 | AUC: nan | AP: 0.6 | F1: 0.7' END AS value FROM events)"""


def log_lines(spark, sf_dir) -> DataFrame:
    e = graphs.table(spark, sf_dir, "events").select("event_id")
    i = F.col("event_id")
    s = lambda c: c.cast("string")
    value = (
        F.when(i % 4 == 0, F.concat(F.lit("Epoch 1/20 | Step "), s(i), F.lit(" | Loss: "), s(i % 97), F.lit(".25 | Pairs: 99")))
        .when(i % 4 == 1, F.concat(F.lit("  [VAL] Step "), s(i), F.lit(" | AUC: 0."), s(i % 89 + 10), F.lit(" | AP: 0.5 | F1: 0."), s(i % 7), F.lit(" | Threshold: 0.5")))
        .when(i % 4 == 2, F.concat(F.lit("Step "), s(i), F.lit("/2000 | Loss: 0."), s(i % 10), F.lit(" | LR: 0.009")))
        .otherwise(F.lit("  [VAL] Step 7 | AUC: nan | AP: 0.6 | F1: 0.7"))
    )
    return e.select(i.alias("line"), value.alias("value"))


# ---- graph core


@query(f"""WITH {G1}, n AS (SELECT src AS node FROM g1 UNION SELECT dst FROM g1), i AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM n)
SELECT g1.src, g1.dst, a.idx AS src_idx, b.idx AS dst_idx FROM g1 JOIN i a ON g1.src = a.node JOIN i b ON g1.dst = b.node""")
def edge_list(spark, sf_dir):
    edges = graphs.purchases(spark, sf_dir)
    return graph.encode(edges, graph.index_by_name(edges)).select("src", "dst", "src_idx", "dst_idx")


@query(f"WITH {G1} SELECT src, count(*) AS n_nbrs, string_agg(dst, ',' ORDER BY dst) AS nbrs FROM g1 GROUP BY src")
def adjacency_lists(spark, sf_dir):
    lists = graph.adjacency_lists(graphs.purchases(spark, sf_dir))
    return lists.select("src", F.size("nbrs").cast("long").alias("n_nbrs"), F.array_join("nbrs", ",").alias("nbrs"))


@query(f"WITH {G1}, {G1_BOTH} SELECT src, count(*) AS n_nbrs, string_agg(dst, ',' ORDER BY dst) AS nbrs FROM both_ways GROUP BY src")
def bidirectional_adjacency(spark, sf_dir):
    lists = graph.adjacency_lists(graph.both_ways(graphs.purchases(spark, sf_dir)))
    return lists.select("src", F.size("nbrs").cast("long").alias("n_nbrs"), F.array_join("nbrs", ",").alias("nbrs"))


@query(f"WITH {G2}, {G2_INDEX} SELECT node, idx FROM idx")
def node_index(spark, sf_dir):
    return graph.index_by_key(graphs.handover_occurrences(graphs.handovers(spark, sf_dir)))


@query(f"""WITH {G2}, {G2_INDEX}, b AS (SELECT src, dst FROM g2 UNION ALL SELECT dst, src FROM g2), d AS (SELECT src AS node, count(*) AS degree FROM b GROUP BY src)
SELECT idx.node, idx.idx, coalesce(degree, 0) AS degree, (coalesce(sum(degree) OVER (ORDER BY idx.idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS csr_offset
FROM idx LEFT JOIN d USING (node)""")
def csr_offsets(spark, sf_dir):
    edges = graphs.handovers(spark, sf_dir)
    nodes = graph.index_by_key(graphs.handover_occurrences(edges))
    return graph.csr(edges, nodes).withColumnRenamed("offset", "csr_offset")


NODES = "nodes AS (SELECT 'c' || c_custkey AS node FROM customer UNION ALL SELECT 'p' || p_partkey FROM part)"
DEGREES = f"{G1}, {G1_BOTH}, {NODES}, deg AS (SELECT node, count(src) AS degree FROM nodes LEFT JOIN both_ways ON node = src GROUP BY node)"


@query(f"WITH {DEGREES} SELECT node, degree FROM deg")
def degree_stats(spark, sf_dir):
    return graph.degrees(graphs.purchases(spark, sf_dir), graphs.shoppers_and_parts(spark, sf_dir))


@query(f"""WITH {DEGREES} SELECT count(*) AS nodes, count(*) FILTER (WHERE degree > 0) AS reachable, round(100.0::DOUBLE * count(*) FILTER (WHERE degree > 0) / count(*), 6) AS percent,
 round(sum(degree)::DOUBLE / greatest(count(*) FILTER (WHERE degree > 0), 1), 6) AS average_degree FROM deg""")
def reachability(spark, sf_dir):
    return graph.reachability(graph.degrees(graphs.purchases(spark, sf_dir), graphs.shoppers_and_parts(spark, sf_dir)))


@query(f"WITH {G2} SELECT count(*) AS edges, (SELECT count(*) FROM (SELECT DISTINCT src, dst FROM g2)) AS distinct_edges, count(*) FILTER (WHERE src = dst) AS self_loops FROM g2")
def edge_counts(spark, sf_dir):
    return graph.edge_counts(graphs.handovers(spark, sf_dir))


# ---- sampling


def _coded(spark, sf_dir):
    edges = graphs.handovers(spark, sf_dir)
    index = shared.store(graph.index_by_key(graphs.handover_occurrences(edges)), "index")
    coded = graph.encode(edges, index).select(F.col("src_idx").alias("src"), F.col("dst_idx").alias("dst"))
    return shared.store(coded, "coded"), index.count()


NEGATIVES = f"""cand AS (SELECT i AS cand_id, {h("43", "'u'", "i")} % (SELECT count(*) FROM idx) AS src, {h("43", "'v'", "i")} % (SELECT count(*) FROM idx) AS dst FROM (SELECT unnest(range(8 * (SELECT count(*) FROM coded) + 4096)) AS i)),
 neg AS (SELECT cand_id, src, dst FROM (SELECT *, row_number() OVER (ORDER BY cand_id) AS place FROM cand WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM coded c WHERE c.src = cand.src AND c.dst = cand.dst))
  WHERE place <= (SELECT count(*) FROM coded))"""


@query(f"WITH {G2}, {G2_INDEX}, {G2_CODED}, {NEGATIVES} SELECT cand_id, src, dst FROM neg")
def negative_edges(spark, sf_dir):
    coded, n = _coded(spark, sf_dir)
    return sampling.negatives(spark, coded, n, coded.count()).select("cand_id", "src", "dst")


@query(f"WITH {G2}, {G2_INDEX}, {G2_CODED}, {NEGATIVES} SELECT src, dst, 1 AS label FROM coded UNION ALL SELECT src, dst, 0 FROM neg")
def labelled_edges(spark, sf_dir):
    coded, n = _coded(spark, sf_dir)
    negative = sampling.negatives(spark, coded, n, coded.count())
    return coded.select("src", "dst", F.lit(1).alias("label")).unionByName(negative.select("src", "dst", F.lit(0).alias("label")))


@query(f"WITH {G1}, {G1_SPLIT}, {SPLIT} SELECT src, dst, dup_no, part FROM split")
def train_val_split(spark, sf_dir):
    return sampling.split_edges(graphs.purchases(spark, sf_dir))


@query(f"""WITH {G1}, {G1_SPLIT}, {SPLIT}, p AS (SELECT src, dst, count(DISTINCT part) AS sides, count(*) AS copies FROM split GROUP BY src, dst)
SELECT count(*) FILTER (WHERE sides > 1) AS straddling_pairs, count(*) FILTER (WHERE copies > 1) AS repeated_pairs FROM p""")
def split_leakage(spark, sf_dir):
    return sampling.leakage(sampling.split_edges(graphs.purchases(spark, sf_dir)))


@query(f"""WITH {G1}, {G1_SPLIT}, draw AS (SELECT i AS draw, {h("42", "1", "i")} % (SELECT count(*) FROM g1) AS rank FROM range(2000) t(i))
SELECT draw, src, dst FROM draw JOIN ranked USING (rank)""")
def minibatch_positives(spark, sf_dir):
    ranked = sampling.ranked_edges(graphs.purchases(spark, sf_dir))
    return sampling.minibatch(ranked, ranked.count(), 2000, 1)


@query(f"""WITH {G2}, {G2_INDEX} SELECT event_id AS pair_id, src AS center, j::INT AS j, {h("42", "event_id", "j")} % (SELECT count(*) FROM idx) AS neg FROM g2 CROSS JOIN range(5) t(j)""")
def skipgram_negatives(spark, sf_dir):
    edges = graphs.handovers(spark, sf_dir)
    nodes = graph.index_by_key(graphs.handover_occurrences(edges)).count()
    return sampling.context_negatives(edges.select(F.col("event_id").alias("pair_id"), F.col("src").alias("center")), nodes)


@query(f"""WITH {G1}, {G1_SPLIT.replace("'42'", "'44'").replace("(42)", "(44)")}, draw AS (SELECT i AS cand_id, {h("44", "'a'", "i")} % (SELECT count(*) FROM g1) AS a, {h("44", "'b'", "i")} % (SELECT count(*) FROM g1) AS b FROM range(3000) t(i)),
 c AS (SELECT cand_id, x.src, y.dst FROM draw JOIN ranked x ON x.rank = a JOIN ranked y ON y.rank = b)
SELECT cand_id, src, dst FROM c WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM g1 WHERE g1.src = c.src AND g1.dst = c.dst)""")
def degree_weighted_negatives(spark, sf_dir):
    return sampling.degree_weighted_negatives(spark, graphs.purchases(spark, sf_dir), 3000)


@query(f"""WITH {G2}, {G2_INDEX}, r AS (SELECT idx, row_number() OVER (ORDER BY {h("42", "3", "idx")}, 3, idx) - 1 AS rank FROM idx) SELECT idx, (rank // 64)::BIGINT AS batch FROM r""")
def node_batches(spark, sf_dir):
    return sampling.node_batches(graph.index_by_key(graphs.handover_occurrences(graphs.handovers(spark, sf_dir))).select("idx"), 64, 3)


def _uniform_sql(bound: str) -> str:
    return f"SELECT vec_id AS idx, d::INT AS d, round(({h('42', 'vec_id', 'd')} / 4294967296.0::DOUBLE - 0.5) * (2 * {bound}), 8) AS value FROM embeddings CROSS JOIN range(16) t(d)"


@query(_uniform_sql("0.5::DOUBLE"))
def init_uniform(spark, sf_dir):
    return long_form(sampling.uniform_vectors(graphs.vectors(spark, sf_dir).select("idx"), 16), "vec")


@query(_uniform_sql("(6.0::DOUBLE / ((SELECT count(*) FROM embeddings) + 16)) ** 0.5"))
def init_xavier(spark, sf_dir):
    nodes = graphs.vectors(spark, sf_dir).select("idx")
    return long_form(sampling.xavier_vectors(nodes, nodes.count(), 16), "vec")


# ---- walks


def _neighbours(edges):
    return shared.store(graph.neighbour_table(edges), "neighbours")


@query(f"""WITH RECURSIVE {G1}, {G1_BOTH}, starts AS (SELECT DISTINCT src AS node FROM both_ways), {WALK.format(edges="both_ways", hash=WALK_HASH, last=7)}
SELECT walk_id, pos, node FROM w""")
def random_walks(spark, sf_dir):
    neighbours = _neighbours(graph.both_ways(graphs.purchases(spark, sf_dir)))
    return walks.random_walks(neighbours, neighbours.select("node").distinct(), 8)


@query(f"""WITH RECURSIVE {G1}, starts AS (SELECT DISTINCT src AS node FROM g1), {WALK.format(edges="g1", hash=WALK_HASH, last=3)}
SELECT walk_id, pos, node FROM w""")
def forward_walks(spark, sf_dir):
    neighbours = _neighbours(graphs.purchases(spark, sf_dir))
    return walks.random_walks(neighbours, neighbours.select("node").distinct(), 4)


@query(f"""WITH RECURSIVE {G1}, {G1_BOTH}, starts AS (SELECT DISTINCT src AS node FROM both_ways), {WALK.format(edges="both_ways", hash=WALK_HASH, last=5)}
SELECT a.walk_id, a.pos, (b.pos - a.pos)::INT AS w, a.node AS center, b.node AS context FROM w a JOIN w b ON a.walk_id = b.walk_id AND b.pos > a.pos AND b.pos <= a.pos + 3""")
def context_pairs(spark, sf_dir):
    neighbours = _neighbours(graph.both_ways(graphs.purchases(spark, sf_dir)))
    hops = walks.hop_tables(neighbours)
    return walks.context_pairs(walks.moved(walks.walk_paths(*hops, hops[1].select("node"), 6)), 3)


@query(f"WITH {G1} SELECT DISTINCT src || ':0' AS walk_id, 2 AS nodes FROM g1")
def moved_walks(spark, sf_dir):
    """From all nodes along purchases: walks from parts stay where they are and go."""
    hops = walks.hop_tables(_neighbours(graphs.purchases(spark, sf_dir)))
    paths = walks.moved(walks.walk_paths(*hops, graphs.shoppers_and_parts(spark, sf_dir), 5))
    return paths.select("walk_id", F.size("nodes").alias("nodes"))


# ---- similarity


@query(f"WITH {G1}, e AS (SELECT DISTINCT src, dst FROM g1) SELECT a, b, count(*) AS common FROM (SELECT x.src AS a, y.src AS b FROM e x JOIN e y ON x.dst = y.dst AND x.src < y.src) GROUP BY a, b")
def common_neighbors(spark, sf_dir):
    return similarity.common_neighbours(graphs.purchases(spark, sf_dir))


@query(JACCARD + " SELECT u, v, common, round(sim, 6) AS sim, rank::INT AS rank FROM top")
def topk_similar(spark, sf_dir):
    return similarity.top_similar(graphs.purchases(spark, sf_dir)).select("u", "v", "common", r("sim").alias("sim"), "rank")


@query(SIMILAR + """, sim AS (SELECT u, v, common, common::DOUBLE / sqrt((du.d * dv.d)::DOUBLE) AS sim FROM c JOIN d du ON u = du.src JOIN d dv ON v = dv.src)
SELECT u, v, common, round(sim, 6) AS sim, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY u ORDER BY sim DESC, v) AS rank FROM sim) WHERE rank <= 5""")
def topk_similar_cosine(spark, sf_dir):
    return similarity.top_similar(graphs.purchases(spark, sf_dir), 5, "cosine").select("u", "v", "common", r("sim").alias("sim"), "rank")


@query(JACCARD + """, n AS (SELECT u, count(*) AS peers FROM top GROUP BY u), vt AS (SELECT u, dst, count(*) AS votes FROM top JOIN e ON top.v = e.src GROUP BY u, dst)
SELECT u, dst, votes, peers, (2 * votes > peers)::INT AS predicted FROM vt JOIN n USING (u)""")
def peer_vote(spark, sf_dir):
    edges = graphs.purchases(spark, sf_dir)
    peers = shared.store(similarity.top_similar(edges).select("u", "v"), "peers")
    return similarity.peer_vote(peers, edges)


# ---- scores and predictions


@query(f"WITH {VEC}, {PAIRS}, {SYM} SELECT src, dst, round(x, 6) AS logit FROM sc")
def edge_scores_symmetric(spark, sf_dir):
    return scoring.logits(graphs.vector_pairs(spark, sf_dir), graphs.vectors(spark, sf_dir)).select("src", "dst", r("logit").alias("logit"))


@query(f"WITH {VEC}, {NEXT}, {PAIRS}, {DIR} SELECT src, dst, round(x, 6) AS logit, round(1 / (1 + exp(-x)), 6) AS prob FROM sc")
def edge_scores_directed(spark, sf_dir):
    scored = scoring.logits(graphs.vector_pairs(spark, sf_dir), graphs.vectors(spark, sf_dir), graphs.vectors(spark, sf_dir, 1))
    return scored.select("src", "dst", r("logit").alias("logit"), r(scalar.sigmoid(F.col("logit"))).alias("prob"))


TEST = """t AS (SELECT vec_id::VARCHAR AS id, 'n' || vec_id AS u, 'n' || (vec_id * 3 + 5) AS v FROM embeddings),
 b AS (SELECT 'n' || a.idx AS node, a.vec AS src_vec, n.vec AS dst_vec FROM vec a JOIN nxt n ON a.idx = n.idx),
 p AS (SELECT t.id, x.node IS NULL OR y.node IS NULL AS missing, list_dot_product(x.src_vec, y.dst_vec) AS x FROM t LEFT JOIN b x ON t.u = x.node LEFT JOIN b y ON t.v = y.node),
 pr AS (SELECT id, missing::INT AS missing, CASE WHEN missing THEN 0.0 ELSE 1 / (1 + exp(-x)) END AS prob FROM p)"""


def _predicted(spark, sf_dir):
    e = graphs.table(spark, sf_dir, "embeddings")
    test = e.select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("n"), F.col("vec_id")).alias("u"), F.concat(F.lit("n"), F.col("vec_id") * 3 + 5).alias("v"))
    a, b = graphs.vectors(spark, sf_dir), graphs.vectors(spark, sf_dir, 1)
    bundle = a.select("idx", F.col("vec").alias("src_vec")).join(b.select("idx", F.col("vec").alias("dst_vec")), "idx").withColumn("node", F.concat(F.lit("n"), F.col("idx")))
    return scoring.predict(test, bundle)


@query(f"WITH {VEC}, {NEXT}, {TEST} SELECT id, round(prob, 6) AS prob, missing, (prob >= 0.5)::INT AS prediction FROM pr")
def predict_edges(spark, sf_dir):
    return _predicted(spark, sf_dir).select("id", r("prob").alias("prob"), "missing", scalar.decide(F.col("prob"), 0.5).alias("prediction"))


@query(f"""WITH {VEC}, {NEXT}, {TEST} SELECT count(*) AS total, count(*) FILTER (WHERE prob >= 0.5) AS positive, count(*) FILTER (WHERE prob < 0.5) AS negative, (sum(missing))::BIGINT AS missing FROM pr""")
def prediction_summary(spark, sf_dir):
    return scoring.summary(_predicted(spark, sf_dir), 0.5)


@query(f"WITH {VEC}, {NEXT}, {TEST} SELECT id AS \"Id\", (prob >= 0.5)::INT AS \"Predictions\" FROM pr")
def prediction_csv(spark, sf_dir):
    path = shared.fresh(spark, "predictions")
    adjacency.write_predictions(scoring.decisions(_predicted(spark, sf_dir), 0.5), path)
    return adjacency.read_predictions(spark, path)


# ---- metrics


@query(f"WITH {SCORED}, {AUC} SELECT round(auc, 6) AS auc FROM auc")
def roc_auc(spark, sf_dir):
    return metrics.roc_auc(graphs.scored_labels(spark, sf_dir)).select(r("auc").alias("auc"))


@query(f"WITH {SCORED}, {AP} SELECT round(ap, 6) AS ap FROM ap")
def average_precision(spark, sf_dir):
    return metrics.average_precision(graphs.scored_labels(spark, sf_dir)).select(r("ap").alias("ap"))


@query(f"WITH {SCORED}, {GRID}, {SWEEP} SELECT round(threshold, 6) AS threshold, tp, fp, fn, round(p, 6) AS precision, round(rc, 6) AS recall, round(f1, 6) AS f1 FROM swept")
def threshold_sweep(spark, sf_dir):
    rounded = {c: r(c) for c in ("threshold", "precision", "recall", "f1")}
    return metrics.sweep(graphs.scored_labels(spark, sf_dir)).withColumns(rounded)


@query(f"WITH {SCORED}, {GRID}, {SWEEP}, {BEST} SELECT round(f1, 6) AS f1, round(threshold, 6) AS threshold FROM best")
def best_f1_threshold(spark, sf_dir):
    return metrics.best_threshold(metrics.sweep(graphs.scored_labels(spark, sf_dir))).select(r("f1").alias("f1"), r("threshold").alias("threshold"))


@query(f"WITH {SCORED}, {MEANS} SELECT round(pos_mean, 6) AS pos_mean, round(neg_mean, 6) AS neg_mean FROM means")
def score_means(spark, sf_dir):
    return metrics.score_means(graphs.scored_labels(spark, sf_dir)).select(r("pos_mean").alias("pos_mean"), r("neg_mean").alias("neg_mean"))


@query(f"""WITH {SCORED}, {GRID}, {SWEEP}, {BEST}, {AUC}, {AP}, {MEANS}
SELECT round(auc, 6) AS auc, round(ap, 6) AS ap, round(f1, 6) AS f1, round(threshold, 6) AS threshold, round(pos_mean, 6) AS pos_mean, round(neg_mean, 6) AS neg_mean FROM auc, ap, best, means""")
def evaluate(spark, sf_dir):
    out = metrics.evaluate(graphs.scored_labels(spark, sf_dir))
    return out.select(*(r(c).alias(c) for c in out.columns))


HISTORY = "hist AS (SELECT event_id AS step, (event_id * 37 % 100) / 100.0::DOUBLE AS f1 FROM events)"


def _history(spark, sf_dir):
    return graphs.table(spark, sf_dir, "events").select(F.col("event_id").alias("step"), (F.col("event_id") * 37 % 100 / F.lit(100.0)).alias("f1"))


@query(f"WITH {HISTORY} SELECT step, f1 FROM hist ORDER BY f1 DESC, step DESC LIMIT 1")
def best_metrics(spark, sf_dir):
    return metrics.keep(_history(spark, sf_dir), "best")


@query(f"WITH {HISTORY} SELECT step, f1 FROM hist ORDER BY step DESC LIMIT 1")
def last_metrics(spark, sf_dir):
    return metrics.keep(_history(spark, sf_dir), "last")


# ---- losses, gradients, optimizers


@query(f"WITH {VEC}, {PAIRS}, {SYM} SELECT round(avg(greatest(x, 0) - x * label + ln(1 + exp(-abs(x)))), 8) AS loss FROM sc")
def bce_loss(spark, sf_dir):
    return training.bce_loss(graphs.vector_pairs(spark, sf_dir), graphs.vectors(spark, sf_dir)).select(r("loss", 8).alias("loss"))


def _skipgram(spark, sf_dir):
    pairs = graphs.vector_pairs(spark, sf_dir)
    near = graphs.vectors(spark, sf_dir)
    ids = near.select(F.col("idx").alias("dst"))
    good = pairs.filter("label = 1").join(ids, "dst").join(ids.select(F.col("dst").alias("i2")), F.col("src") == F.col("i2"), "left_semi")
    good = good.join(ids.select((F.col("dst") - 1).alias("dst")), "dst", "left_semi")
    bad = pairs.filter("label = 0")
    return good.select(F.col("src").alias("center"), F.col("dst").alias("context")), bad.select(F.col("src").alias("center"), F.col("dst").alias("neg")), near, graphs.vectors(spark, sf_dir, 1)


@query(f"""WITH {VEC}, {NEXT}, {PAIRS}, {DIR} SELECT round(sum(CASE label WHEN 1 THEN greatest(-x, 0) + ln(1 + exp(-abs(x))) ELSE greatest(x, 0) + ln(1 + exp(-abs(x))) END) / count(*) FILTER (WHERE label = 1), 8) AS loss FROM sc""")
def skipgram_loss(spark, sf_dir):
    return training.skipgram_loss(*_skipgram(spark, sf_dir)).select(r("loss", 8).alias("loss"))


@query(f"""WITH {VEC}, {NEXT}, {PAIRS}, {DIR}, g AS (SELECT *, (1 / (1 + exp(-x)) - label) / count(*) FILTER (WHERE label = 1) OVER () AS g FROM sc),
 parts AS (SELECT 'in' AS side, src AS idx, bv AS v, g FROM g UNION ALL SELECT 'out', dst, av, g FROM g), el AS (SELECT side, idx, unnest(v) AS v, unnest(range(len(v))) AS d, g FROM parts)
SELECT side, idx, d::INT AS d, round(sum(v * g), 8) AS value FROM el GROUP BY side, idx, d""")
def skipgram_gradient(spark, sf_dir):
    into, out = training.skipgram_gradient(*_skipgram(spark, sf_dir))
    both = long_form(into, "grad").withColumn("side", F.lit("in")).unionByName(long_form(out, "grad").withColumn("side", F.lit("out")))
    return both.select("side", "idx", "d", "value")


@query(BCE_GRAD + " SELECT idx, d::INT AS d, round(grad, 8) AS value FROM grad")
def bce_gradient(spark, sf_dir):
    return long_form(training.bce_gradient(graphs.vector_pairs(spark, sf_dir), graphs.vectors(spark, sf_dir)), "grad")


@query(BCE_GRAD + ", n AS (SELECT sqrt(sum(grad * grad)) AS norm FROM grad) SELECT round(norm, 8) AS norm, round(least(1.0, 0.05 / (norm + 1e-6)), 8) AS factor FROM n")
def clip_norm(spark, sf_dir):
    gradient = training.bce_gradient(graphs.vector_pairs(spark, sf_dir), graphs.vectors(spark, sf_dir))
    return training.clip_factor(gradient, 0.05).select(r("norm", 8).alias("norm"), r("factor", 8).alias("factor"))


# gradient of every other row: its own vector; state: m = vec / 10, v = 0.01
ADAM = """WITH el AS (SELECT vec_id AS idx, unnest(embedding::DOUBLE[]) AS x, unnest(range(len(embedding))) AS d FROM embeddings),
 st AS (SELECT *, CASE WHEN idx % 2 = 0 THEN x ELSE 0.0 END AS g, x / 10 AS m, 0.01::DOUBLE AS v FROM el),
 mv AS (SELECT *, m * 0.9 + g * 0.1 AS m2, v * 0.999 + g * g * 0.001 AS v2 FROM st),
 nx AS (SELECT *, x - 0.01 * (m2 / 0.271) / (sqrt(v2 / 0.002997001) + 1e-8) AS y FROM mv)"""


def _adam(spark, sf_dir, sparse):
    x = graphs.vectors(spark, sf_dir)
    state = x.select("idx", "vec", F.transform("vec", lambda a: a / 10).alias("m"), F.transform("vec", lambda _: F.lit(0.01)).alias("v"))
    gradient = x.filter("idx % 2 = 0").select("idx", F.col("vec").alias("grad"))
    return long_form(training.adam(state, gradient, 3, 0.01, sparse), "vec", 6)


@query(ADAM + " SELECT idx, d::INT AS d, round(y, 6) AS value FROM nx")
def adam_step(spark, sf_dir):
    return _adam(spark, sf_dir, False)


@query(ADAM + " SELECT idx, d::INT AS d, round(CASE WHEN idx % 2 = 0 THEN y ELSE x END, 6) AS value FROM nx")
def sparse_adam_step(spark, sf_dir):
    return _adam(spark, sf_dir, True)


@query("SELECT t AS step, round(1e-5 + (0.01 - 1e-5) * (1 + cos(pi() * t / 2000.0)) / 2, 10) AS rate FROM range(2001) r(t)")
def lr_schedule(spark, sf_dir):
    return spark.range(2001).select(F.col("id").alias("step"), r(scalar.cosine_rate(F.col("id"), 2000, 0.01), 10).alias("rate"))


@query(f"""WITH {VEC}, {NEXT}, el AS (SELECT a.idx, unnest(a.vec) AS x, unnest(n.vec) AS y, unnest(range(len(a.vec))) AS d FROM vec a JOIN nxt n ON a.idx = n.idx)
SELECT idx, d::INT AS d, round((x + y) / 2, 8) AS value FROM el""")
def merged_embeddings(spark, sf_dir):
    a, b = graphs.vectors(spark, sf_dir), graphs.vectors(spark, sf_dir, 1).withColumnRenamed("vec", "other")
    return long_form(a.join(b, "idx").select("idx", scalar.mean_vector(F.col("vec"), F.col("other")).alias("merged")), "merged")


TRAIN_EDGES = f"""{G2}, g AS (SELECT src::VARCHAR AS src, dst::VARCHAR AS dst FROM g2),
 names AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx FROM (SELECT src AS node FROM g UNION SELECT dst FROM g)),
 enc AS (SELECT a.idx AS src, b.idx AS dst FROM g JOIN names a ON g.src = a.node JOIN names b ON g.dst = b.node),
 ec AS (SELECT src, dst, row_number() OVER (PARTITION BY src, dst) AS dup_no FROM enc),
 er AS (SELECT src, dst, row_number() OVER (ORDER BY {h("42", "src", "dst", "dup_no")}, src, dst, dup_no) - 1 AS rank FROM ec),
 tr AS MATERIALIZED (SELECT src, dst FROM er WHERE rank >= greatest(1, floor((SELECT count(*) FROM enc) * 0.05))),
 k AS MATERIALIZED (SELECT (SELECT count(*) FROM names) AS n, count(*) AS m, least(count(*), 65536) AS size FROM tr)"""


def _initial(seed: str, bound: str) -> str:
    return f"SELECT idx, d, ({h(seed, 'idx', 'd')} / 4294967296.0::DOUBLE - 0.5) * (2 * {bound}) AS x, 0.0::DOUBLE AS m, 0.0::DOUBLE AS v FROM names CROSS JOIN range(8) t(d)"


def _bce_step(t: int, rate: str) -> str:
    """State st{t} from st{t - 1}: a batch of training edges and as many non-edges, gradient, clipping, dense Adam."""
    seed, old = str(42000 + t), f"st{t - 1}"
    return f"""c{t} AS (SELECT i, {h(seed, "'u'", "i")} % n AS src, {h(seed, "'v'", "i")} % n AS dst FROM (SELECT unnest(range(8 * size + 4096)) AS i, n FROM k)),
 ng{t} AS (SELECT src, dst FROM (SELECT *, row_number() OVER (ORDER BY i) AS place FROM c{t} WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM tr WHERE tr.src = c{t}.src AND tr.dst = c{t}.dst)), k WHERE place <= size),
 b{t} AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM (SELECT src, dst, 1 AS label FROM (SELECT {h("42", str(t), "i")} % m AS rank FROM (SELECT unnest(range(size)) AS i, m FROM k)) JOIN trk USING (rank) UNION ALL SELECT src, dst, 0 FROM ng{t})),
 z{t} AS (SELECT r, b.src, b.dst, label, sum(s.x * o.x) AS z FROM b{t} b JOIN {old} s ON s.idx = b.src JOIN {old} o ON o.idx = b.dst AND o.d = s.d GROUP BY ALL),
 e{t} AS MATERIALIZED (SELECT src, dst, (1 / (1 + exp(-z)) - label) / count(*) OVER () AS g FROM z{t}),
 gr{t} AS MATERIALIZED (SELECT idx, d, sum(y) AS g FROM (SELECT e.src AS idx, o.d, e.g * o.x AS y FROM e{t} e JOIN {old} o ON o.idx = e.dst UNION ALL SELECT e.dst, s.d, e.g * s.x FROM e{t} e JOIN {old} s ON s.idx = e.src) GROUP BY idx, d),
 f{t} AS (SELECT least(1.0, 1.0 / (sqrt(sum(g * g)) + 1e-6)) AS f FROM gr{t}),
 mv{t} AS (SELECT idx, d, x, m * 0.9::DOUBLE + y * 0.1::DOUBLE AS m, v * 0.999::DOUBLE + y * y * 0.001::DOUBLE AS v FROM (SELECT s.*, coalesce(g * f, 0.0) AS y FROM {old} s LEFT JOIN gr{t} USING (idx, d) CROSS JOIN f{t})),
 st{t} AS MATERIALIZED (SELECT idx, d, x - (m / (1 - 0.9::DOUBLE ** {t})) / (sqrt(v / (1 - 0.999::DOUBLE ** {t})) + 1e-8) * {rate} AS x, m, v FROM mv{t})"""


TRAIN_BCE = f"""WITH {TRAIN_EDGES}, tc AS (SELECT src, dst, row_number() OVER (PARTITION BY src, dst) AS dup_no FROM tr),
 trk AS MATERIALIZED (SELECT src, dst, row_number() OVER (ORDER BY {h("42", "src", "dst", "dup_no")}, src, dst, dup_no) - 1 AS rank FROM tc),
 st0 AS MATERIALIZED ({_initial("42", "sqrt(6.0::DOUBLE / ((SELECT n FROM k) + 8))")}), {_bce_step(1, "0.01::DOUBLE")}, {_bce_step(2, "0.005005::DOUBLE")}
SELECT idx, d::INT AS d, round(x, 6) AS value FROM st2"""


def _user_edges(spark, sf_dir):
    return graphs.handovers(spark, sf_dir).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))


@query(TRAIN_BCE)
def train_bce(spark, sf_dir):
    """The vectors after two steps, a batch as large as the training edges (65,536 at most)."""
    return long_form(training.train_bce(_user_edges(spark, sf_dir), training.BceConfig(steps=2, dim=8, validate_every=2))[0], "vec", 6)


@query(TRAIN_BCE)
def train_resumed(spark, sf_dir):
    """The same in two runs: the second one goes on from the checkpoint of the first."""
    at = training.Run(shared.fresh(spark, "checkpoint"), save_every=1)
    for steps in (1, 2):
        vectors = training.train_bce(_user_edges(spark, sf_dir), training.BceConfig(steps=steps, dim=8, validate_every=2), at)[0]
    return long_form(vectors, "vec", 6)


def _walk_side(side: str, gradient: str) -> str:
    return f"SELECT '{side}' AS side, idx, d::INT AS d, round(CASE WHEN g IS NULL THEN x ELSE x - (g * 0.1::DOUBLE / (1 - 0.9::DOUBLE)) / (sqrt(g * g * 0.001::DOUBLE / (1 - 0.999::DOUBLE)) + 1e-8) * 0.003::DOUBLE END, 6) AS value FROM {side}0 LEFT JOIN {gradient} USING (idx, d)"


@query(f"""WITH RECURSIVE {TRAIN_EDGES}, bw AS (SELECT src, dst FROM tr UNION ALL SELECT dst, src FROM tr), starts AS (SELECT idx AS node FROM names),
 {WALK.format(edges="bw", hash=HASH.format("concat_ws(':', '42000', w.walk_id, (w.pos + 1)::VARCHAR)"), last=4)},
 pr AS MATERIALIZED (SELECT a.walk_id || ':' || a.pos || ':' || (b.pos - a.pos) AS pair_id, a.node AS center, b.node AS context FROM w a JOIN w b ON a.walk_id = b.walk_id AND b.pos > a.pos AND b.pos <= a.pos + 2),
 ev AS MATERIALIZED (SELECT row_number() OVER () AS r, * FROM (SELECT center AS src, context AS dst, 1 AS y FROM pr UNION ALL SELECT center, {h("42000", "pair_id", "j")} % (SELECT n FROM k), 0 FROM pr CROSS JOIN range(2) t(j))),
 src0 AS MATERIALIZED ({_initial("42", "0.5::DOUBLE")}), dst0 AS MATERIALIZED ({_initial("43", "0.5::DOUBLE")}),
 z AS (SELECT r, ev.src, ev.dst, y, sum(s.x * o.x) AS z FROM ev JOIN src0 s ON s.idx = ev.src JOIN dst0 o ON o.idx = ev.dst AND o.d = s.d GROUP BY ALL),
 e AS MATERIALIZED (SELECT src, dst, (1 / (1 + exp(-z)) - y) / (SELECT count(*) FROM pr) AS g FROM z),
 gs AS (SELECT e.src AS idx, d, sum(e.g * x) AS g FROM e JOIN dst0 ON idx = e.dst GROUP BY ALL), gd AS (SELECT e.dst AS idx, d, sum(e.g * x) AS g FROM e JOIN src0 ON idx = e.src GROUP BY ALL)
{_walk_side("src", "gs")} UNION ALL {_walk_side("dst", "gd")}""")
def train_deepwalk(spark, sf_dir):
    """Source and target vectors after an epoch of one batch of all nodes."""
    config = training.WalkConfig(dim=8, length=5, window=2, walks=1, negatives=2, batch_nodes=1 << 40, epochs=1)
    source, target, *_ = training.train_walks(_user_edges(spark, sf_dir), config)
    sides = [long_form(v, "vec", 6).withColumn("side", F.lit(side)) for v, side in ((source, "src"), (target, "dst"))]
    return sides[0].unionByName(sides[1]).select("side", "idx", "d", "value")


# ---- files


@query(f"WITH {G1} SELECT src, count(*) AS n_nbrs, string_agg(dst, ',' ORDER BY dst) AS nbrs FROM g1 GROUP BY src")
def adjacency_file(spark, sf_dir):
    path = shared.fresh(spark, "adjacency")
    adjacency.write_adjacency(graph.adjacency_lists(graphs.purchases(spark, sf_dir)), path)
    return adjacency.read_adjacency(spark, path).select("src", F.size("nbrs").cast("long").alias("n_nbrs"), F.array_join("nbrs", ",").alias("nbrs"))


@query(f"WITH {G1} SELECT src, (row_number() OVER (PARTITION BY src ORDER BY dst) - 1)::INT AS pos, dst FROM g1")
def flattened_file(spark, sf_dir):
    path = shared.fresh(spark, "adjacency")
    adjacency.write_adjacency(graph.adjacency_lists(graphs.purchases(spark, sf_dir)), path)
    return graph.edges_of(adjacency.read_adjacency(spark, path)).select("src", "pos", "dst")


@query("""SELECT line, src, nbrs FROM (SELECT (row_number() OVER (ORDER BY event_id) - 1)::BIGINT AS line, 'e,' || event_id AS src, 'x"y||' || user_id || '|a"b' AS nbrs FROM events WHERE event_id % 5 <> 0)""")
def odd_adjacency_file(spark, sf_dir):
    """Blank lines, quoted and empty fields, quotes within fields."""
    path = shared.fresh(spark, "adjacency")
    e = graphs.table(spark, sf_dir, "events").select("event_id", "user_id")
    value = F.when(F.col("event_id") % 5 == 0, "").otherwise(F.concat(F.lit('"e,'), F.col("event_id"), F.lit('","x""y",,'), F.col("user_id"), F.lit(',a"b')))
    ordering.ordered(e.withColumn("value", value), "event_id").orderBy("part_", "place_").select("value").write.text(path)
    return adjacency.read_adjacency(spark, path).select("line", "src", F.array_join("nbrs", "|").alias("nbrs"))


@query("""SELECT vec_id::VARCHAR AS id, 'a,"' || vec_id AS u, ' b' AS v FROM embeddings""")
def pair_file(spark, sf_dir):
    path = shared.fresh(spark, "pairs")
    e = graphs.table(spark, sf_dir, "embeddings")
    rows = e.select(F.concat(F.col("vec_id"), F.lit(',"a,""'), F.col("vec_id"), F.lit('", b')).alias("Id,a,b"))
    rows.write.option("header", True).option("quote", "").option("sep", "\u0001").csv(path)
    return adjacency.read_pairs(spark, path)


@query("""SELECT event_id, printf('%.2f', value::DOUBLE) AS two, printf('%.4f', value::DOUBLE) AS four, printf('%.6f', value::DOUBLE * 1000) AS six FROM events""")
def number_formats(spark, sf_dir):
    x = F.col("value").cast("double")
    return graphs.table(spark, sf_dir, "events").select("event_id", scalar.fixed(x, 2).alias("two"), scalar.fixed(x, 4).alias("four"), scalar.fixed(x * 1000, 6).alias("six"))


def _index(spark, sf_dir):
    return graphs.vectors(spark, sf_dir).select(F.concat(F.lit("n"), F.col("idx")).alias("node"), "idx")


@query(f"WITH {VEC}, {NEXT} SELECT 'n' || a.idx AS node, round(list_dot_product(a.vec, n.vec), 6) AS own_score, 0.25::DOUBLE AS threshold FROM vec a JOIN nxt n ON a.idx = n.idx")
def bundle_roundtrip(spark, sf_dir):
    path = shared.fresh(spark, "bundle")
    bundles.write_bundle(path, _index(spark, sf_dir), graphs.vectors(spark, sf_dir), graphs.vectors(spark, sf_dir, 1), {"threshold": 0.25})
    table, threshold, _ = bundles.read_bundle(spark, path)
    return table.select("node", r(scalar.dot(F.col("src_vec"), F.col("dst_vec"))).alias("own_score"), F.lit(threshold).alias("threshold"))


@query(f"WITH {VEC} SELECT 'n' || idx AS node, round(list_dot_product(vec, vec), 6) AS own_score FROM vec")
def bundle_single_table(spark, sf_dir):
    path = shared.fresh(spark, "bundle")
    bundles.write_bundle(path, _index(spark, sf_dir), graphs.vectors(spark, sf_dir))
    return bundles.read_bundle(spark, path)[0].select("node", r(scalar.dot(F.col("src_vec"), F.col("dst_vec"))).alias("own_score"))


@query(f"WITH {VEC}, {NEXT} SELECT 'n' || a.idx AS node, round(list_sum(a.vec), 6) AS src_sum, round(list_sum(n.vec), 6) AS dst_sum FROM vec a JOIN nxt n ON a.idx = n.idx")
def export_bundle(spark, sf_dir):
    checkpoint, path = shared.fresh(spark, "checkpoint"), shared.fresh(spark, "bundle")
    states = {"source": graphs.vectors(spark, sf_dir), "target": graphs.vectors(spark, sf_dir, 1)}
    for step in (5, 10):
        bundles.save_checkpoint(checkpoint, step, _index(spark, sf_dir), states, {"config": {"dim": 64}, "metrics": {"threshold": 0.3}})
    bundles.export(spark, checkpoint, path)
    total = lambda c: r(F.aggregate(c, F.lit(0.0), lambda s, x: s + x))
    return bundles.read_bundle(spark, path)[0].select("node", total("src_vec").alias("src_sum"), total("dst_vec").alias("dst_sum"))


@query(f"""WITH {LINES} SELECT line, regexp_extract(value, 'Step (\\d+) \\| Loss: ([\\d.]+) \\| Pairs', 1)::BIGINT AS "Step", regexp_extract(value, 'Step (\\d+) \\| Loss: ([\\d.]+) \\| Pairs', 2)::DOUBLE AS "Loss"
FROM lines WHERE regexp_matches(value, 'Step (\\d+) \\| Loss: ([\\d.]+) \\| Pairs: \\d+')""")
def parse_log_train(spark, sf_dir):
    return logs.training_rows(log_lines(spark, sf_dir))


@query(f"""WITH {LINES} SELECT line, regexp_extract(value, 'Step (\\d+)/', 1)::BIGINT AS "Step", regexp_extract(value, 'Loss: ([\\d.]+)', 1)::DOUBLE AS "Loss" FROM lines WHERE value LIKE '%| LR: %'""")
def parse_log_train_single(spark, sf_dir):
    return logs.training_rows(log_lines(spark, sf_dir), logs.TRAIN_SINGLE)


VAL_RE = "'\\[VAL\\] Step (\\d+) \\| AUC: ([\\d.]+) \\| AP: ([\\d.]+) \\| F1: ([\\d.]+)'"


@query(f"""WITH {LINES} SELECT line, regexp_extract(value, {VAL_RE}, 1)::BIGINT AS "Step", regexp_extract(value, {VAL_RE}, 2)::DOUBLE AS "AUC", regexp_extract(value, {VAL_RE}, 3)::DOUBLE AS "AP",
 regexp_extract(value, {VAL_RE}, 4)::DOUBLE AS "F1" FROM lines WHERE regexp_matches(value, {VAL_RE})""")
def parse_log_validation(spark, sf_dir):
    return logs.validation_rows(log_lines(spark, sf_dir))


@query(f"WITH {LINES} SELECT (row_number() OVER (ORDER BY line) - 1)::BIGINT AS line, value FROM lines")
def log_file(spark, sf_dir):
    path = shared.fresh(spark, "log")
    ordering.ordered(log_lines(spark, sf_dir), "line").orderBy("part_", "place_").select("value").write.text(path)
    return logs.read_log(spark, path)


@query("""SELECT event_id AS line, round(CASE WHEN count(*) OVER w = 5 THEN avg(value) OVER w END, 6) AS trend FROM events WINDOW w AS (ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")
def loss_rolling_mean(spark, sf_dir):
    rows = graphs.table(spark, sf_dir, "events").select(F.col("event_id").alias("line"), F.col("value").alias("Loss"))
    return logs.rolling_loss(rows).select("line", r("trend").alias("trend"))


@query("SELECT event_id // 100 AS epoch, round(avg(value), 6) AS mean_loss FROM events GROUP BY 1")
def epoch_mean_loss(spark, sf_dir):
    losses = graphs.table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("epoch"), F.col("value").alias("loss"))
    return logs.epoch_means(losses).select("epoch", r("mean_loss").alias("mean_loss"))
