"""Tokens, features, similarity, labels, clusters, classifiers and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from textmill.functions import tokens
from textmill.operators import classify, clustering, evaluate, features, labelling, similarity
from textmill.plans import labelling as label_runs
from textmill.plans import training
from textmill.sources.scratch import new_path
from workload import sqltext as q
from workload.registry import query
from workload.views import NEGATIVES, POSITIVES, load, oracle


def documents(spark, sf_dir):
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "text")


DOCS = "docs AS (SELECT doc_id AS row_idx, text FROM documents)"

# --- tokens and features ----------------------------------------------------------------------


@query(
    "tokenize_words",
    f"SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct, array_to_string(ws, ' ') AS words FROM (SELECT doc_id, {q.words('text')} AS ws FROM documents)",
)
def tokenize_words(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").select("doc_id", tokens.words(F.col("text")).alias("ws"), tokens.word_set(F.col("text")).alias("set"))
    return docs.select(
        "doc_id", F.size("ws").cast("bigint").alias("n_words"), F.size("set").cast("bigint").alias("n_distinct"), F.array_join("ws", " ").alias("words")
    )


@query(
    "ngram_tokens",
    oracle(
        "", f"w AS (SELECT doc_id, {q.words('text')} AS ws FROM documents)",
        f"""SELECT doc_id, array_to_string({q.grams('ws', 'bigram', False)}, ' ') AS bigrams,
                   array_to_string({q.grams('ws', 'trigram', False)}, ' ') AS trigrams FROM w""",
    ),
)
def ngram_tokens(spark, sf_dir):
    ws = tokens.words(F.col("text"))
    gram = lambda n: F.array_join(tokens.ngrams(ws, n), " ").alias(f"{n}s")
    return load(spark, sf_dir, "documents").select("doc_id", gram("bigram"), gram("trigram"))


@query(
    "term_counts",
    oracle(
        "", f"w AS (SELECT doc_id AS row_idx, {q.words('text')} AS ws FROM documents)",
        """SELECT row_idx, token, 'count' AS rep, count(*) AS n FROM (SELECT row_idx, unnest(ws) AS token FROM w) GROUP BY ALL
           UNION ALL SELECT row_idx, unnest(list_distinct(ws)), 'binary', 1 FROM w""",
    ),
)
def term_counts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    part = lambda rep: features.term_counts(docs, "text", feature_rep=rep).withColumn("rep", F.lit(rep))
    return part("count").unionByName(part("binary"))


@query("tfidf_weights", oracle("", f"{DOCS}, {q.tfidf('docs', 'text')}", "SELECT row_idx, term, round(weight, 6) AS weight FROM weights"))
def tfidf_weights(spark, sf_dir):
    return features.tfidf(documents(spark, sf_dir), "text").select("row_idx", "term", F.round("weight", 6).alias("weight"))


@query("vocab_topn", oracle("", f"{DOCS}, {q.tfidf('docs', 'text')}", "SELECT term, freq, df FROM vocab"))
def vocab_topn(spark, sf_dir):
    return features.vocabulary(features.document_terms(documents(spark, sf_dir), "text"), 5000)


# --- similarity -------------------------------------------------------------------------------

REPLIES = """
  replies AS (SELECT a.row_idx AS i, b.row_idx AS j, a.text AS x, b.text AS y
              FROM turns a JOIN turns b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""
JACCARD = "CASE WHEN len(s) + len(t) = 0 THEN 0.0 ELSE 1.0 - len(list_intersect(s, t)) / CAST(len(list_distinct(list_concat(s, t))) AS DOUBLE) END"


def reply_pairs(turns):
    """(i, j) of each turn and the next one of its conversation."""
    follows = turns.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("row_idx").alias("j"))
    return turns.join(follows, ["conv_id", "turn"]).select(F.col("row_idx").alias("i"), "j")


@query(
    "jaccard_distance",
    oracle("turns", f"{REPLIES}, sets AS (SELECT i, j, list_distinct({q.words('x')}) AS s, list_distinct({q.words('y')}) AS t FROM replies)", f"SELECT i, j, {JACCARD} AS distance FROM sets"),
)
def jaccard_distance(spark, sf_dir):
    turns = load(spark, sf_dir, "turns")
    return similarity.pairwise_distances(turns, reply_pairs(turns), "text")


@query(
    "pairwise_custom_distance",
    oracle("turns", REPLIES, "SELECT i, j, abs(length(x) - length(y)) / CAST(greatest(length(x), length(y), 1) AS DOUBLE) AS distance FROM replies"),
)
def pairwise_custom_distance(spark, sf_dir):
    turns = load(spark, sf_dir, "turns")
    by_length = lambda a, b: F.abs(F.length(a) - F.length(b)) / F.greatest(F.length(a), F.length(b), F.lit(1))
    return similarity.pairwise_distances(turns, reply_pairs(turns), "text", by_length)


NEAR_COLUMNS = "i, j, round(distance, 9) AS distance, copies_i, copies_j"


@query("pairwise_jaccard", oracle("", f"{DOCS}, {q.all_pairs('docs', 'text')}", f"SELECT {NEAR_COLUMNS} FROM near"))
def pairwise_jaccard(spark, sf_dir):
    return similarity.all_pairs(documents(spark, sf_dir), "text").withColumn("distance", F.round("distance", 9))


@query("jaccard_threshold_join", oracle("", f"{DOCS}, {q.near_pairs('docs', 'text', 0.4)}", f"SELECT {NEAR_COLUMNS} FROM near"))
def jaccard_threshold_join(spark, sf_dir):
    return similarity.near_pairs(documents(spark, sf_dir), "text", 0.4).withColumn("distance", F.round("distance", 9))


@query(
    "equal_set_members",
    oracle("", f"{DOCS}, s AS (SELECT row_idx, list_sort(list_distinct({q.words('text')})) AS ws FROM docs)", "SELECT row_idx, min(row_idx) OVER (PARTITION BY ws) AS gid FROM s"),
)
def equal_set_members(spark, sf_dir):
    return similarity.set_members(documents(spark, sf_dir), "text")


# --- labels -----------------------------------------------------------------------------------

MANUAL = "last_label AS (SELECT row_idx, max_by(label, seq) AS label FROM annotations GROUP BY row_idx)"


@query(
    "label_manual",
    oracle("annotations", MANUAL, "SELECT d.doc_id AS row_idx, coalesce(label, -1) AS target FROM documents d LEFT JOIN last_label l ON l.row_idx = d.doc_id"),
)
def label_manual(spark, sf_dir):
    return labelling.label_manual(documents(spark, sf_dir).select("row_idx"), load(spark, sf_dir, "annotations"))


@query(
    "label_manual_stop_early",
    oracle("annotations", MANUAL, "SELECT d.doc_id AS row_idx, label AS target FROM documents d JOIN last_label l ON l.row_idx = d.doc_id"),
)
def label_manual_stop_early(spark, sf_dir):
    return labelling.label_manual(documents(spark, sf_dir).select("row_idx"), load(spark, sf_dir, "annotations"), stop_early=True)


KEYWORD_MAP = {"positives": POSITIVES, "negatives": NEGATIVES, "other": ["und", "les", "que"]}
KEYWORD_HITS = f"h AS (SELECT doc_id, {q.hits('text', POSITIVES)} AS p, {q.hits('text', NEGATIVES)} AS n, {q.hits('text', KEYWORD_MAP['other'])} AS o FROM documents)"


@query(
    "label_keywords",
    oracle("", KEYWORD_HITS, "SELECT doc_id, CASE WHEN greatest(p, n, o) = 0 THEN 2 WHEN p >= greatest(n, o) THEN 4 WHEN n >= o THEN 0 ELSE 2 END AS target FROM h"),
)
def label_keywords(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", labelling.label_by_keywords(F.col("text"), KEYWORD_MAP).alias("target"))


LISTED = """listed AS (SELECT DISTINCT item_id % 3 AS o, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM benchmark),
    hits AS (SELECT doc_id, o, count(*) AS n FROM documents JOIN listed ON word <> '' AND contains(lower(text), word) GROUP BY doc_id, o),
    best AS (SELECT doc_id, arg_min(o, [-n, o]) AS o FROM hits GROUP BY doc_id)"""


@query(
    "label_keyword_tables",
    oracle("", LISTED, "SELECT doc_id, CASE o WHEN 0 THEN 4 WHEN 1 THEN 0 ELSE 2 END AS target FROM documents LEFT JOIN best USING (doc_id)"),
)
def label_keyword_tables(spark, sf_dir):
    """Word lists as tables: the words of all benchmark items, dealt to three labels."""
    items = load(spark, sf_dir, "benchmark")
    words = items.select((F.col("item_id") % 3).alias("o"), F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    tables = {name: words.filter(F.col("o") == o).select("word") for o, name in enumerate(("positives", "negatives", "other"))}
    documents_ = load(spark, sf_dir, "documents").select("doc_id", "text")
    return labelling.label_by_keyword_tables(documents_, "text", tables, "doc_id").select("doc_id", "target")


@query("keyword_classify", oracle("", KEYWORD_HITS, "SELECT doc_id, CASE WHEN p > n THEN 4 WHEN n > p THEN 0 ELSE 2 END AS predicted FROM h"))
def keyword_classify(spark, sf_dir):
    label = labelling.classify_by_keywords(F.col("text"), POSITIVES + POSITIVES[:1], NEGATIVES)
    return load(spark, sf_dir, "documents").select("doc_id", label.alias("predicted"))


@query(
    "map_clusters_to_labels",
    oracle(
        "clustered", "ids AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS r FROM (SELECT DISTINCT cluster FROM clustered WHERE cluster >= 0))",
        "SELECT row_idx, c.cluster, CASE r WHEN 1 THEN 0 WHEN 3 THEN 4 ELSE 2 END AS target FROM clustered c LEFT JOIN ids ON ids.cluster = c.cluster",
    ),
)
def map_clusters_to_labels(spark, sf_dir):
    return labelling.label_clusters(load(spark, sf_dir, "clustered").select("row_idx", "cluster"))


@query(
    "align_clusters",
    oracle(
        "clustered",
        """ids AS (SELECT DISTINCT cluster FROM clustered),
           cell AS (SELECT i.cluster, l.target, count(c.row_idx) AS n FROM ids i CROSS JOIN (SELECT DISTINCT target FROM clustered) l
                    LEFT JOIN clustered c ON c.cluster = i.cluster AND c.target = l.target GROUP BY ALL),
           best AS (SELECT a.cluster AS c0, b.cluster AS c2, c.cluster AS c4 FROM cell a, cell b, cell c
                    WHERE a.target = 0 AND b.target = 2 AND c.target = 4 AND a.cluster <> b.cluster AND a.cluster <> c.cluster
                      AND b.cluster <> c.cluster ORDER BY a.n + b.n + c.n DESC, c0, c2, c4 LIMIT 1)""",
        "SELECT row_idx, CASE cluster WHEN c2 THEN 2 WHEN c4 THEN 4 ELSE 0 END AS aligned FROM clustered, best",
    ),
)
def align_clusters(spark, sf_dir):
    return labelling.align_clusters(load(spark, sf_dir, "clustered"), "target", "cluster").select("row_idx", "aligned")


@query(
    "label_summary",
    oracle(
        "tweets", "",
        """SELECT count(*) AS total, count(*) FILTER (target IN (0, 4)) AS labeled, count(*) FILTER (target = 2) AS neutral,
             count(*) FILTER (target IS NULL) AS unlabeled_rows, count(target) AS labeled_rows, count(*) FILTER (target = 0) AS label_0,
             count(*) FILTER (target = 2) AS label_2, count(*) FILTER (target = 4) AS label_4 FROM tweets""",
    ),
)
def label_summary(spark, sf_dir):
    return labelling.label_summary(load(spark, sf_dir, "tweets"))


@query(
    "label_percentages",
    oracle(
        "labelled", "",
        "SELECT l.label, count(row_idx) AS n, round(count(row_idx) * 100.0 / (SELECT count(*) FROM labelled), 6) AS percent FROM (VALUES (0), (2), (4)) l(label) LEFT JOIN labelled ON target = l.label GROUP BY l.label",
    ),
)
def label_percentages(spark, sf_dir):
    return labelling.label_percentages(load(spark, sf_dir, "labelled")).withColumn("percent", F.round("percent", 6))


@query("cluster_sizes", oracle("clustered", "", "SELECT cluster, count(*) AS n FROM clustered GROUP BY cluster"))
def cluster_sizes(spark, sf_dir):
    return labelling.cluster_sizes(load(spark, sf_dir, "clustered"))


# --- clustering -------------------------------------------------------------------------------


@query("label_kmeans")
def label_kmeans(spark, sf_dir):
    clusters = clustering.kmeans(documents(spark, sf_dir), "text")
    return labelling.label_clusters(clusters).select("row_idx", "cluster", "target")


DBSCAN = f"""
  {DOCS}, {q.tfidf('docs', 'text')},
  dots AS (SELECT a.row_idx AS i, b.row_idx AS j FROM weights a JOIN weights b ON a.term = b.term AND a.row_idx <> b.row_idx
           GROUP BY ALL HAVING round(sum(a.weight * b.weight), 9) >= 1 - 0.5 * 0.5 / 2),
  bare AS (SELECT row_idx FROM docs WHERE row_idx NOT IN (SELECT row_idx FROM weights)),
  adj AS (SELECT i, j FROM dots UNION ALL SELECT a.row_idx, b.row_idx FROM bare a JOIN bare b ON a.row_idx <> b.row_idx),
  core AS (SELECT row_idx FROM docs LEFT JOIN adj ON i = row_idx GROUP BY row_idx HAVING count(j) + 1 >= 5),
  reach AS (SELECT row_idx AS i, row_idx AS j FROM core
            UNION SELECT r.i, a.j FROM reach r JOIN adj a ON a.i = r.j JOIN core c ON c.row_idx = a.j),
  comp AS (SELECT i AS row_idx, min(j) AS cluster FROM reach GROUP BY i),
  border AS (SELECT a.i AS row_idx, min(cluster) AS cluster FROM adj a JOIN comp c ON c.row_idx = a.j
             WHERE a.i NOT IN (SELECT row_idx FROM core) GROUP BY a.i),
  found AS (SELECT * FROM comp UNION ALL SELECT * FROM border)"""


@query("label_dbscan", oracle("", DBSCAN, "SELECT row_idx, coalesce(cluster, -1) AS cluster FROM docs LEFT JOIN found USING (row_idx)"))
def label_dbscan(spark, sf_dir):
    return clustering.dbscan(documents(spark, sf_dir), "text")


@query("label_agglomerative")
def label_agglomerative(spark, sf_dir):
    clusters = clustering.agglomerative(documents(spark, sf_dir), "text")
    return labelling.label_clusters(clusters).select("row_idx", "cluster", "target")


@query("label_hierarchical")
def label_hierarchical(spark, sf_dir):
    turns = load(spark, sf_dir, "turns").select("row_idx", "text")
    return labelling.label_clusters(clustering.hierarchical(turns, "text"))


# --- classification ---------------------------------------------------------------------------


def parts(spark, sf_dir):
    split = classify.stratified_split(load(spark, sf_dir, "labelled"))
    return split.filter(~F.col("is_validation")), split.filter("is_validation")


@query("stratified_split", oracle("labelled", q.split(), "SELECT row_idx, target, is_validation FROM parts"))
def stratified_split(spark, sf_dir):
    return classify.stratified_split(load(spark, sf_dir, "labelled")).select("row_idx", "target", "is_validation")


@query("nb_fit_priors", oracle("labelled", f"{q.split()}, {q.naive_bayes()}", "SELECT target, rows, CAST(total AS BIGINT) AS total, round(log_prior, 6) AS log_prior, v AS vocabulary FROM classes, vocab_size"))
def nb_fit_priors(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    return classify.fit_naive_bayes(train, "text").classes.withColumn("log_prior", F.round("log_prior", 6))


@query(
    "nb_fit_likelihood",
    oracle(
        "labelled", f"{q.split()}, {q.naive_bayes('bigram', True)}",
        """SELECT v.token, c.target, round(ln((coalesce(t.n, 0) + 1) / (c.total + (SELECT v FROM vocab_size))), 6) AS log_likelihood
           FROM (SELECT DISTINCT token FROM counts) v CROSS JOIN classes c LEFT JOIN counts t ON t.token = v.token AND t.target = c.target""",
    ),
)
def nb_fit_likelihood(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    model = classify.fit_naive_bayes(train, "text", ngram="bigram", feature_rep="binary")
    return classify.naive_bayes_likelihood(model).withColumn("log_likelihood", F.round("log_likelihood", 6))


def _register_naive_bayes(ngram, rep):
    sql = oracle("labelled", f"{q.split()}, {q.naive_bayes(ngram, rep == 'binary')}", "SELECT row_idx, predicted, round(score, 4) AS score FROM best")

    @query(f"nb_classify_{ngram}_{rep}", sql)
    def run(spark, sf_dir):
        train, validation = parts(spark, sf_dir)
        model = classify.fit_naive_bayes(train, "text", ngram=ngram, feature_rep=rep)
        return classify.predict_naive_bayes(model, validation, "text").withColumn("score", F.round("score", 4))


for _ngram in ("unigram", "bigram", "trigram"):
    for _rep in ("count", "binary"):
        _register_naive_bayes(_ngram, _rep)


@query("knn_neighbours", oracle("labelled", f"{q.split()}, {q.neighbours()}", "SELECT row_idx, rank, neighbour, target, round(distance, 9) AS distance FROM found"))
def knn_neighbours(spark, sf_dir):
    train, validation = parts(spark, sf_dir)
    model = classify.fit_neighbours(train, "text")
    return classify.nearest_neighbours(model, validation, "text").withColumn("distance", F.round("distance", 9))


@query("knn_classify", oracle("labelled", f"{q.split()}, {q.neighbours(7)}", "SELECT row_idx, predicted, votes FROM best"))
def knn_classify(spark, sf_dir):
    train, validation = parts(spark, sf_dir)
    return classify.predict_neighbours(classify.fit_neighbours(train, "text", k=7), validation, "text")


@query("decision_tree_classify")
def decision_tree_classify(spark, sf_dir):
    train, validation = parts(spark, sf_dir)
    return classify.predict_tree(classify.fit_tree(train, "text"), validation, "text")


@query("model_roundtrip", oracle("labelled", f"{q.split()}, {q.naive_bayes()}", "SELECT row_idx, predicted, round(score, 4) AS score FROM best"))
def model_roundtrip(spark, sf_dir):
    train, validation = parts(spark, sf_dir)
    path = new_path(spark, "model")
    classify.save_model(classify.fit_naive_bayes(train, "text"), path)
    scored = classify.predict_naive_bayes(classify.load_model(spark, path), validation, "text")
    return scored.withColumn("score", F.round("score", 4))


REPORT = "SELECT accuracy, precision, recall, f1, error_rate FROM one"
JUDGED = "judged_rows AS (SELECT target AS actual, predicted FROM best JOIN parts USING (row_idx))"


def _rounded(report):
    return report.select(*(F.round(c, 6).alias(c) for c in ("accuracy", "precision", "recall", "f1", "error_rate")))


@query("train_eval_nb", oracle("labelled", f"{q.split()}, {q.naive_bayes('bigram', True)}, {JUDGED}, {q.metrics('judged_rows')}", REPORT))
def train_eval_nb(spark, sf_dir):
    run = training.train(load(spark, sf_dir, "labelled"), "naive_bayes", ngram="bigram", feature_rep="binary")
    return _rounded(run.metrics)


@query("train_eval_knn", oracle("labelled", f"{q.split()}, {q.neighbours()}, {JUDGED}, {q.metrics('judged_rows')}", REPORT))
def train_eval_knn(spark, sf_dir):
    return _rounded(training.train(load(spark, sf_dir, "labelled"), "knn").metrics)


KEYWORD_CASE = f"CASE WHEN {q.hits('text', POSITIVES)} > {q.hits('text', NEGATIVES)} THEN 4 WHEN {q.hits('text', POSITIVES)} < {q.hits('text', NEGATIVES)} THEN 0 ELSE 2 END"


@query(
    "train_eval_keywords",
    oracle("labelled", f"{q.split()}, judged_rows AS (SELECT target AS actual, {KEYWORD_CASE} AS predicted FROM parts WHERE is_validation), {q.metrics('judged_rows')}", REPORT),
)
def train_eval_keywords(spark, sf_dir):
    run = training.train(load(spark, sf_dir, "labelled"), "naive_automatic", positives=POSITIVES, negatives=NEGATIVES)
    return _rounded(run.metrics)


ALL_DOCS = "SELECT doc_id AS row_idx, text FROM documents"


def _trained(spark, sf_dir):
    train, _ = parts(spark, sf_dir)
    return classify.fit_naive_bayes(train, "text")


@query("predict_dataset", oracle("labelled", f"{q.split()}, {q.naive_bayes(scored=ALL_DOCS)}", "SELECT row_idx, predicted FROM best"))
def predict_dataset(spark, sf_dir):
    return training.predict_dataset(_trained(spark, sf_dir), documents(spark, sf_dir)).predictions


@query(
    "predict_preview",
    oracle(
        "labelled", f"{q.split()}, {q.naive_bayes(scored=ALL_DOCS)}",
        """SELECT row_idx, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '...' ELSE text END AS tweet, predicted AS predicted_label
           FROM best JOIN scored USING (row_idx) ORDER BY row_idx LIMIT 100""",
    ),
)
def predict_preview(spark, sf_dir):
    return training.predict_dataset(_trained(spark, sf_dir), documents(spark, sf_dir)).preview


@query(
    "predict_distribution",
    oracle(
        "labelled", f"{q.split()}, {q.naive_bayes(scored=ALL_DOCS)}",
        "SELECT l.label, count(row_idx) AS n, round(count(row_idx) * 100.0 / (SELECT count(*) FROM best), 6) AS percent FROM (VALUES (0), (2), (4)) l(label) LEFT JOIN best ON predicted = l.label GROUP BY l.label",
    ),
)
def predict_distribution(spark, sf_dir):
    shares = training.predict_dataset(_trained(spark, sf_dir), documents(spark, sf_dir)).percentages
    return shares.withColumn("percent", F.round("percent", 6))


@query(
    "predict_metrics",
    oracle("labelled", f"{q.split()}, {q.naive_bayes(scored='SELECT row_idx, text FROM labelled')}, {JUDGED}, {q.metrics('judged_rows')}", REPORT),
)
def predict_metrics(spark, sf_dir):
    return _rounded(training.predict_dataset(_trained(spark, sf_dir), load(spark, sf_dir, "labelled")).metrics)


@query(
    "predict_texts",
    oracle("labelled turns", f"{q.split()}, {q.naive_bayes(scored='SELECT row_idx, text FROM turns')}", "SELECT row_idx, text, predicted FROM best JOIN scored USING (row_idx)"),
)
def predict_texts(spark, sf_dir):
    return training.predict_texts(_trained(spark, sf_dir), load(spark, sf_dir, "turns"))


RAND = """round((SELECT (pairs + 2 * same - a - p) / pairs FROM (SELECT
    (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM judged_rows GROUP BY actual, predicted)) AS same,
    (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM judged_rows GROUP BY actual)) AS a,
    (SELECT sum(n * (n - 1) / 2) FROM (SELECT count(*) AS n FROM judged_rows GROUP BY predicted)) AS p,
    (SELECT count(*) * (count(*) - 1) / 2 FROM judged_rows) AS pairs)), 6) AS rand_index"""


def _stored(spark, sf_dir, *runs):
    """A store after the given training runs on the labelled documents, one minute apart."""
    store = new_path(spark, "store")
    load(spark, sf_dir, "labelled").write.parquet(f"{store}/labelled")
    artefacts = spark.createDataFrame([("", "", f"{store}/labelled")], "original_file string, cleaned_file string, labeled_file string")
    for minute, (algorithm, options) in enumerate(runs):
        training.train_and_store(artefacts, store, "s", algorithm, f"2025-01-01 00:{minute:02d}:00", **options)
    return store


NB_BINARY = ("naive_bayes", {"ngram": "bigram", "feature_rep": "binary"})
KEYWORDS = ("naive_automatic", {"positives": POSITIVES, "negatives": NEGATIVES})
STORED = oracle(
    "labelled", f"{q.split()}, {q.naive_bayes('bigram', True)}, {JUDGED}, {q.metrics('judged_rows')}",
    f"SELECT 's' AS session_id, 'naive_bayes' AS algorithm, {REPORT.removeprefix('SELECT ').removesuffix(' FROM one')}, {RAND} FROM one",
)


@query("train_and_store", STORED)
def train_and_store(spark, sf_dir):
    runs = training.read_runs(spark, _stored(spark, sf_dir, NB_BINARY))
    rounded = (F.round(c, 6).alias(c) for c in (*training.REPORTED, "rand_index"))
    return runs.select("session_id", "algorithm", *rounded)


@query("evaluation_report", STORED)
def evaluation_report(spark, sf_dir):
    runs = training.read_runs(spark, _stored(spark, sf_dir, KEYWORDS, NB_BINARY))
    rounded = (F.round(c, 6).alias(c) for c in (*training.REPORTED, "rand_index"))
    return training.evaluation_report(runs).select("session_id", "algorithm", *rounded)


@query("predict_latest", oracle("labelled", f"{q.split()}, {q.naive_bayes(scored=ALL_DOCS)}", "SELECT row_idx, predicted FROM best"))
def predict_latest(spark, sf_dir):
    store = _stored(spark, sf_dir, KEYWORDS, ("naive_bayes", {}))
    return training.predict_latest(spark, store, "s", documents(spark, sf_dir)).predictions


LABEL_COUNTS = """SELECT count(*) AS total, count(*) FILTER (target IN (0, 4)) AS labeled, count(*) FILTER (target = 2) AS neutral,
    count(*) FILTER (target IS NULL OR target = -1) AS unlabeled_rows, count(*) FILTER (target IS NOT NULL AND target <> -1) AS labeled_rows,
    count(*) FILTER (target = 0) AS label_0, count(*) FILTER (target = 2) AS label_2, count(*) FILTER (target = 4) AS label_4"""


@query(
    "label_run_keywords",
    oracle("", f"{KEYWORD_HITS}, t AS (SELECT CASE WHEN greatest(p, n, o) = 0 THEN 2 WHEN p >= greatest(n, o) THEN 4 WHEN n >= o THEN 0 ELSE 2 END AS target FROM h)", f"{LABEL_COUNTS} FROM t"),
)
def label_run_keywords(spark, sf_dir):
    return label_runs.label_with_keywords(load(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_idx"), "text"), KEYWORD_MAP).summary


@query(
    "label_run_clusters",
    oracle(
        "", f"""{DBSCAN}, placed AS (SELECT row_idx, coalesce(cluster, -1) AS cluster FROM docs LEFT JOIN found USING (row_idx)),
          ids AS (SELECT cluster, row_number() OVER (ORDER BY cluster) AS r FROM (SELECT DISTINCT cluster FROM placed WHERE cluster >= 0)),
          t AS (SELECT CASE r WHEN 1 THEN 0 WHEN 3 THEN 4 ELSE 2 END AS target FROM placed p LEFT JOIN ids USING (cluster))""",
        f"{LABEL_COUNTS} FROM t",
    ),
)
def label_run_clusters(spark, sf_dir):
    return label_runs.label_with_clusters(documents(spark, sf_dir), "dbscan").summary


# --- evaluation -------------------------------------------------------------------------------


def predictions(spark, sf_dir):
    label = labelling.classify_by_keywords(F.col("text"), POSITIVES, NEGATIVES)
    return load(spark, sf_dir, "labelled").select(F.col("target").alias("actual"), label.alias("predicted"))


METRICS = f"preds AS (SELECT target AS actual, {KEYWORD_CASE} AS predicted FROM labelled), {q.metrics('preds')}"


@query("confusion_matrix", oracle("labelled", METRICS, "SELECT actual, predicted, n FROM grid"))
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(predictions(spark, sf_dir))


@query(
    "confusion_matrix_wide",
    oracle("labelled", METRICS, "SELECT actual, " + ", ".join(f"CAST(sum(n) FILTER (predicted = {v}) AS BIGINT) AS pred_{v}" for v in (0, 2, 4)) + " FROM grid GROUP BY actual"),
)
def confusion_matrix_wide(spark, sf_dir):
    return evaluate.confusion_matrix_wide(predictions(spark, sf_dir), labelling.LABELS)


@query(
    "confusion_heat",
    oracle(
        "labelled", METRICS + ", names AS (SELECT * FROM (VALUES (0, 'Negative'), (2, 'Neutral'), (4, 'Positive')) t(v, name))",
        """SELECT a.name AS actual_name, p.name AS predicted_name, n, round(n / (SELECT max(n) FROM grid), 6) AS heat
           FROM grid JOIN names a ON a.v = actual JOIN names p ON p.v = predicted""",
    ),
)
def confusion_heat(spark, sf_dir):
    return evaluate.confusion_heat(predictions(spark, sf_dir)).withColumn("heat", F.round("heat", 6))


@query("accuracy_error", oracle("labelled", METRICS, "SELECT accuracy, error_rate FROM one"))
def accuracy_error(spark, sf_dir):
    return evaluate.accuracy_error(predictions(spark, sf_dir)).select(*(F.round(c, 6).alias(c) for c in ("accuracy", "error_rate")))


@query("weighted_prf", oracle("labelled", METRICS, "SELECT precision, recall, f1 FROM one"))
def weighted_prf(spark, sf_dir):
    return evaluate.weighted_prf(predictions(spark, sf_dir)).select(*(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("metric_report", oracle("labelled", METRICS, REPORT))
def metric_report(spark, sf_dir):
    return _rounded(evaluate.metric_report(predictions(spark, sf_dir)))


@query(
    "rand_index",
    oracle(
        "clustered",
        """ct AS (SELECT target, cluster, count(*) AS n FROM clustered GROUP BY ALL),
           p AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM ct) AS both_same,
             (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM ct GROUP BY target)) AS same_t,
             (SELECT sum(m * (m - 1) / 2) FROM (SELECT sum(n) AS m FROM ct GROUP BY cluster)) AS same_c,
             (SELECT count(*) * (count(*) - 1) / 2 FROM clustered) AS pairs)""",
        "SELECT round((pairs + 2 * both_same - same_t - same_c) / pairs, 6) AS rand_index FROM p",
    ),
)
def rand_index(spark, sf_dir):
    index = evaluate.rand_index(load(spark, sf_dir, "clustered"), "target", "cluster")
    return index.select(F.round("rand_index", 6).alias("rand_index"))
