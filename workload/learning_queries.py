"""Queries over splits, features, models and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from forumloom.operators import bayes, columns, features, metrics, models, neighbours, split, tokens
from forumloom.operators.features import Terms
from forumloom.session import cut, ship_package, spread, stage, staging_path
from forumloom.sources import readers, writers
from workload import tables as t
from workload.registry import query

WITH = t.WITH_COMMENTS

# Splits ----------------------------------------------------------------------------------------------


@query("p1_random_split", f"{WITH} SELECT comment_id, split FROM ({t.sql_split('comments')})")
def p1(spark, folder):
    return split.random_split(t.comments(spark, folder).select("comment_id"))


@query(
    "p1_random_split_with_counts",
    f"""{WITH} SELECT comment_id, CASE WHEN r <= 100 THEN 'test' WHEN r <= 600 THEN 'train' END AS split
    FROM (SELECT comment_id, row_number() OVER (ORDER BY md5('7:' || comment_id)) AS r FROM comments)""",
)
def p1_counts(spark, folder):
    return split.random_split(t.comments(spark, folder).select("comment_id"), test_size=100, train_size=500, seed=7)


@query(
    "p2_ordered_split",
    f"""{WITH} SELECT comment_id, CASE WHEN row_number() OVER (ORDER BY comment_id) <= count(*) OVER () -
      ceil(0.25 * count(*) OVER ()) THEN 'train' ELSE 'test' END AS split FROM comments""",
)
def p2(spark, folder):
    return split.ordered_split(t.comments(spark, folder).select("comment_id"), ["comment_id"])


@query(
    "p3_stratified_split",
    f"""{WITH}, c AS (SELECT subreddit, count(*) AS n FROM comments GROUP BY subreddit),
    w AS (SELECT CAST(ceil(0.25 * sum(n)) AS BIGINT) AS wanted, CAST(sum(n) AS BIGINT) AS total FROM c),
    f AS (SELECT subreddit, (n * wanted) // total AS base, (n * wanted) % total AS rem, wanted FROM c, w),
    a AS (SELECT subreddit, base + CASE WHEN row_number() OVER (ORDER BY rem DESC, subreddit) <=
      wanted - sum(base) OVER () THEN 1 ELSE 0 END AS take FROM f)
    SELECT comment_id, subreddit, CASE WHEN row_number() OVER (PARTITION BY subreddit ORDER BY md5('42:' || comment_id))
      <= take THEN 'test' ELSE 'train' END AS split FROM comments JOIN a USING (subreddit)""",
)
def p3(spark, folder):
    return split.stratified_split(t.comments(spark, folder).select("comment_id", "subreddit"), "subreddit")


@query(
    "p4_approximate_split",
    f"""{WITH} SELECT comment_id, CASE WHEN {t.sql_hash("'42:' || comment_id")} < 1073741824 THEN 'test' ELSE 'train' END
    AS split FROM comments""",
)
def p4(spark, folder):
    return split.approximate_split(t.comments(spark, folder).select("comment_id"))


# Features --------------------------------------------------------------------------------------------

PAIRS = f"""{WITH}, parts AS ({t.sql_split('comments')}),
words AS (SELECT comment_id, split, unnest({t.sql_words('text')}) AS term FROM parts),
pairs AS MATERIALIZED (SELECT comment_id, split, term, count(*) AS n FROM words GROUP BY ALL),
vocabulary AS MATERIALIZED (SELECT term, df, total, row_number() OVER (ORDER BY term) - 1 AS term_idx FROM (
  SELECT term, count(*) AS df, CAST(sum(n) AS BIGINT) AS total FROM pairs WHERE split = 'train' GROUP BY term)),
sizes AS (SELECT count(*) FILTER (split = 'train') AS n_train FROM parts)"""


def _parts(spark, folder):
    return split.random_split(t.comments(spark, folder).select("comment_id", "text"))


def _train(parts):
    return parts.where("split = 'train'")


@query("f1_term_counts", f"{PAIRS} SELECT comment_id, term_idx, CAST(n AS DOUBLE) AS value FROM pairs JOIN vocabulary USING (term)")
def f1(spark, folder):
    parts = _parts(spark, folder)
    return features.count_vectors(parts, features.fit_vocabulary(_train(parts)))


@query("f2_vocabulary_index", f"{PAIRS} SELECT term, term_idx, df AS doc_freq FROM vocabulary")
def f2(spark, folder):
    return features.fit_vocabulary(_train(_parts(spark, folder))).table.select("term", "term_idx", "doc_freq")


_GRAMS = f"""grams AS (
  SELECT comment_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term
  FROM (SELECT comment_id, {t.sql_words('text')} AS ws FROM comments))"""


@query(
    "f3_word_bigrams",
    f"{WITH}, {_GRAMS} SELECT term, count(*) AS n, count(DISTINCT comment_id) AS docs FROM grams GROUP BY term",
)
def f3(spark, folder):
    return features.term_totals(t.comments(spark, folder), Terms(ngram_range=(1, 2)))


_SPACED = rf"regexp_replace(lower(text), '[{t.SPACE}]{{2,}}', ' ', 'g')"


@query(
    "f3_char_trigrams",
    f"""{WITH}, chars AS (SELECT comment_id, {_SPACED} AS s FROM comments),
    grams AS (SELECT comment_id, substr(s, i, 3) AS term FROM (
      SELECT comment_id, s, unnest(range(1, length(s) - 1)) AS i FROM chars))
    SELECT term, count(*) AS n, count(DISTINCT comment_id) AS docs FROM grams GROUP BY term""",
)
def f3_chars(spark, folder):
    return features.term_totals(t.comments(spark, folder), Terms(analyzer="char", ngram_range=(3, 3)))


@query(
    "f3_char_ngrams_in_words",
    f"""{WITH}, ws AS (SELECT comment_id, unnest({t.sql_tokens('lower(text)')}) AS w FROM comments),
    padded AS (SELECT comment_id, ' ' || w || ' ' AS p FROM ws),
    grams AS (SELECT comment_id, CASE WHEN length(p) >= 4 THEN substr(p, i, 4) ELSE p END AS term FROM (
      SELECT comment_id, p, unnest(range(1, greatest(length(p) - 3, 1) + 1)) AS i FROM padded))
    SELECT term, count(*) AS n, count(DISTINCT comment_id) AS docs FROM grams GROUP BY term""",
)
def f3_chars_in_words(spark, folder):
    return features.term_totals(t.comments(spark, folder), Terms(analyzer="char_wb", ngram_range=(4, 4)))


@query(
    "f3_binary_fixed_vocabulary",
    f"""{WITH}, v AS (SELECT w AS term, row_number() OVER (ORDER BY w) - 1 AS term_idx FROM
      (VALUES ('the'), ('und'), ('que'), ('les'), ('and')) AS x(w)),
    words AS (SELECT DISTINCT comment_id, unnest({t.sql_words('text')}) AS term FROM comments)
    SELECT comment_id, term_idx, CAST(1 AS DOUBLE) AS value FROM words JOIN v USING (term)""",
)
def f3_fixed(spark, folder):
    terms = Terms(binary=True, vocabulary=("the", "und", "que", "les", "and"))
    docs = t.comments(spark, folder)
    return features.count_vectors(docs, features.fit_vocabulary(docs, terms), terms)


@query(
    "f4_pruned_vocabulary",
    f"""{PAIRS}, kept AS (SELECT term, df, total FROM vocabulary, sizes WHERE df >= 3 AND df <= 0.6 * n_train
      ORDER BY total DESC, term LIMIT 5000)
    SELECT term, df AS doc_freq, row_number() OVER (ORDER BY term) - 1 AS term_idx FROM kept""",
)
def f4(spark, folder):
    terms = Terms(min_df=3, max_df=0.6, max_features=5000)
    return features.fit_vocabulary(_train(_parts(spark, folder)), terms).table.select("term", "doc_freq", "term_idx")


_HASHED = f"""{WITH}, words AS (SELECT comment_id, unnest({t.sql_words('text')}) AS term FROM comments),
pairs AS (SELECT comment_id, term, count(*) AS n FROM words GROUP BY ALL),
cells AS (SELECT comment_id, {t.sql_hash('term')} % 1048576 AS term_idx,
  sum(CASE WHEN CAST('0x' || substr(md5(term), 9, 1) AS BIGINT) % 2 = 0 THEN n ELSE -n END) AS v FROM pairs GROUP BY ALL)"""


@query(
    "f5_hashed_counts",
    f"""{_HASHED} SELECT comment_id, term_idx, round(v / sqrt(sum(v * v) OVER (PARTITION BY comment_id)), 6) AS value
    FROM cells WHERE v <> 0""",
)
def f5(spark, folder):
    out = features.hashed_vectors(t.comments(spark, folder))
    return out.withColumn("value", F.round("value", 6))


_IDF = "(ln((1 + n_train) / (1 + df)) + 1)"
_NORMED = "round(v / sqrt(sum(v * v) OVER (PARTITION BY comment_id)), 6)"


@query(
    "f6_tfidf_from_counts",
    f"""{PAIRS}, w AS (SELECT comment_id, term_idx, (1 + ln(n)) * {_IDF} AS v
      FROM pairs JOIN vocabulary USING (term), sizes)
    SELECT comment_id, term_idx, {_NORMED} AS value FROM w""",
)
def f6(spark, folder):
    parts = _parts(spark, folder)
    train = _train(parts)
    vocabulary = features.fit_vocabulary(train)
    counts, fitted = features.count_vectors(parts, vocabulary), features.count_vectors(train, vocabulary)
    out = features.tfidf_transform(counts, fitted, vocabulary.n_docs, sublinear_tf=True)
    return out.withColumn("value", F.round("value", 6))


@query(
    "f6_tfidf_without_smoothing",
    f"""{PAIRS}, w AS (SELECT comment_id, term_idx, n * (ln(n_train / df) + 1) AS v
      FROM pairs JOIN vocabulary USING (term), sizes WHERE split = 'train')
    SELECT comment_id, term_idx, round(v / sum(abs(v)) OVER (PARTITION BY comment_id), 6) AS value FROM w""",
)
def f6_plain(spark, folder):
    train = _train(_parts(spark, folder))
    vocabulary = features.fit_vocabulary(train)
    counts = features.count_vectors(train, vocabulary)
    out = features.tfidf_transform(counts, None, vocabulary.n_docs, norm="l1", smooth_idf=False)
    return out.withColumn("value", F.round("value", 6))


_TFIDF = f"""{PAIRS}, w AS (SELECT comment_id, split, term_idx, n * {_IDF} AS v
  FROM pairs JOIN vocabulary USING (term), sizes)"""


@query("f7_tfidf_from_text", f"{_TFIDF} SELECT comment_id, term_idx, {_NORMED} AS value FROM w")
def f7(spark, folder):
    parts = _parts(spark, folder)
    out = features.tfidf_vectors(parts, features.fit_vocabulary(_train(parts)))
    return out.withColumn("value", F.round("value", 6))


@query(
    "f8_l1_rows",
    f"""{PAIRS} SELECT comment_id, term_idx, round(n / sum(n) OVER (PARTITION BY comment_id), 6) AS value
    FROM pairs JOIN vocabulary USING (term)""",
)
def f8(spark, folder):
    parts = _parts(spark, folder)
    counts = features.count_vectors(parts, features.fit_vocabulary(_train(parts)))
    return features.normalize_rows(counts, "l1").withColumn("value", F.round("value", 6))


@query(
    "a7_write_features_of_both_splits",
    f"""{PAIRS} SELECT comment_id, term_idx, CAST(n AS DOUBLE) AS value, split FROM pairs JOIN vocabulary USING (term)
    WHERE split IS NOT NULL""",
)
def a7_both(spark, folder):
    parts = cut(_parts(spark, folder))
    vocabulary = features.fit_vocabulary(_train(parts))
    path = staging_path(spark, "features")
    for name in ("train", "test"):  # a split is known before its texts are counted, so nothing is joined back
        counts = features.count_vectors(parts.where(F.col("split") == name), vocabulary)
        writers.write_features(counts.withColumn("split", F.lit(name)), path, mode="append")
    train, test = (readers.read_features(spark, path, name) for name in ("train", "test"))
    return train.unionByName(test)


@query(
    "a7_write_features",
    f"""{PAIRS} SELECT comment_id, term_idx, CAST(n AS DOUBLE) AS value, split FROM pairs JOIN vocabulary USING (term)
    WHERE split = 'test'""",
)
def a7(spark, folder):
    parts = cut(_parts(spark, folder))
    counts = features.count_vectors(parts, features.fit_vocabulary(_train(parts)))
    path = staging_path(spark, "features")
    writers.write_features(counts.join(parts.select("comment_id", "split"), "comment_id"), path)
    return readers.read_features(spark, path, "test")


WITH_VECTORS = f"""{WITH}, tokens AS MATERIALIZED (SELECT comment_id, unnest({t.sql_tokens('text')}) AS token FROM comments),
vocabulary AS MATERIALIZED (
  SELECT token, row_number() OVER (ORDER BY token) - 1 AS term_idx FROM (SELECT DISTINCT token FROM tokens)),
vectors AS MATERIALIZED (SELECT token, embedding AS vector FROM vocabulary JOIN embeddings
  ON vec_id = term_idx % (SELECT count(*) FROM embeddings) WHERE length(token) <= 9)"""


def _vectors(spark, folder, vocabulary):
    """Vectors for all but the longest tokens."""
    table = t.table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    number = F.col("term_idx") % F.lit(table.count())
    return (
        vocabulary.where(F.length("token") <= 9)
        .withColumn("vec_id", number)
        .join(table, "vec_id")
        .select("token", "vector")
    )


@query(
    "f9_embedding_table",
    f"""{WITH_VECTORS} SELECT v.token, v.term_idx, round(coalesce(CAST(vector[1] AS DOUBLE), 0), 6) AS first,
      round(coalesce(CAST(vector[64] AS DOUBLE), 0), 6) AS last,
      round(coalesce(list_sum(list_transform(vector, lambda x: CAST(x AS DOUBLE) * x)), 0), 6) AS squares
    FROM vocabulary v LEFT JOIN vectors USING (token)""",
)
def f9(spark, folder):
    vocabulary = tokens.vocabulary(t.comments(spark, folder))
    out = features.embedding_table(vocabulary, _vectors(spark, folder, vocabulary))
    squares = F.aggregate("vector", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    return out.select(
        "token",
        "term_idx",
        F.round(F.get("vector", F.lit(0)).cast("double"), 6).alias("first"),
        F.round(F.get("vector", F.lit(63)).cast("double"), 6).alias("last"),
        F.round(squares, 6).alias("squares"),
    )


@query(
    "f10_document_vectors",
    f"""{WITH_VECTORS}, counts AS (SELECT comment_id, token, count(*) AS n FROM tokens GROUP BY ALL),
    sizes AS (SELECT comment_id, coalesce(sum(n), 1) AS total FROM comments LEFT JOIN counts USING (comment_id) GROUP BY comment_id),
    dims AS (SELECT token, unnest(range(64)) AS dim, unnest(vector) AS x FROM vectors),
    sums AS (SELECT comment_id, dim, sum(n * CAST(x AS DOUBLE)) AS s FROM counts JOIN dims USING (token) GROUP BY ALL)
    SELECT comment_id, dim, round(coalesce(s, 0) / total, 6) AS value
    FROM (SELECT comment_id, total, unnest(range(64)) AS dim FROM sizes) LEFT JOIN sums USING (comment_id, dim)""",
)
def f10(spark, folder):
    docs = t.comments(spark, folder)
    vectors = _vectors(spark, folder, tokens.vocabulary(docs))
    out = features.document_vectors(docs, vectors)
    return out.select("comment_id", F.posexplode("vector").alias("dim", "value")).select(
        "comment_id", F.col("dim").cast("long").alias("dim"), F.round("value", 6).alias("value")
    )


@query(
    "f12_max_abs_scaler",
    f"""{PAIRS}, c AS MATERIALIZED (SELECT comment_id, split, term_idx, n FROM pairs JOIN vocabulary USING (term)),
    m AS (SELECT term_idx, max(n) AS scale FROM c WHERE split = 'train' GROUP BY term_idx)
    SELECT comment_id, term_idx, round(n / scale, 6) AS value FROM c JOIN m USING (term_idx)""",
)
def f12(spark, folder):
    parts = _parts(spark, folder)
    vocabulary = features.fit_vocabulary(_train(parts))
    scaler = features.fit_scaler(features.count_vectors(_train(parts), vocabulary), vocabulary.n_docs)
    scaled = features.apply_scaler(features.count_vectors(parts, vocabulary), scaler)
    return scaled.withColumn("value", F.round("value", 6))


@query(
    "f12_standard_scaler",
    f"""{PAIRS}, c AS MATERIALIZED (SELECT comment_id, split, term_idx, n FROM pairs JOIN vocabulary USING (term)),
    m AS (SELECT term_idx, sqrt(greatest(sum(n * n) / n_train - (sum(n) / n_train) * (sum(n) / n_train), 0)) AS scale
      FROM c, sizes WHERE split = 'train' GROUP BY term_idx, n_train)
    SELECT comment_id, term_idx, round(n / CASE WHEN scale = 0 THEN 1 ELSE scale END, 6) AS value
    FROM c JOIN m USING (term_idx)""",
)
def f12_standard(spark, folder):
    parts = _parts(spark, folder)
    vocabulary = features.fit_vocabulary(_train(parts))
    fitted = features.fit_scaler(features.count_vectors(_train(parts), vocabulary), vocabulary.n_docs, "standard")
    scaled = features.apply_scaler(features.count_vectors(parts, vocabulary), fitted)
    return scaled.withColumn("value", F.round("value", 6))


@query(
    "f13_sparse_vectors",
    f"""{_HASHED} SELECT comment_id, count(*) AS n_cells, CAST(sum(v * (term_idx % 1000)) AS DOUBLE) AS checksum
    FROM cells WHERE v <> 0 GROUP BY comment_id""",
)
def f13(spark, folder):
    long = features.hashed_vectors(t.comments(spark, folder), norm=None)
    vectors = features.sparse_vectors(long, 1 << 20)
    cells = F.from_json(F.get_json_object(F.to_json(F.struct("features")), "$.features.indices"), "array<bigint>")
    values = F.from_json(F.get_json_object(F.to_json(F.struct("features")), "$.features.values"), "array<double>")
    weighted = F.zip_with(cells, values, lambda i, v: (i % 1000) * v)
    return vectors.select(
        "comment_id",
        F.size(cells).cast("long").alias("n_cells"),
        F.aggregate(weighted, F.lit(0.0), lambda acc, x: acc + x).alias("checksum"),
    )


# Models ----------------------------------------------------------------------------------------------


WIDTH = 1 << 20
"""Hashed features of the learners: the operator's own default."""

BOUNDED_WIDTH = 1 << 12
"""Hashed features of the perceptron, which keeps a number per hidden unit and feature."""


def _labelled(spark, folder, width=WIDTH, norm="l2"):
    """Hashed features of the documents, with the language as class and the length as target.

    The vectors are as wide as there are hashed columns with a value in the train documents.
    """
    docs = t.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("comment_id"), "text", "lang", F.col("n_chars").cast("double").alias("n_chars")
    )
    bags = features.hashed_bags(spread(split.random_split(docs)).where("comment_id IS NOT NULL"), width, norm=norm)
    bags = stage(bags, "bags")
    sizes = bags.groupBy("comment_id").agg(F.count(F.lit(1)).alias("n"))
    if not sizes.where("n > 1").isEmpty():  # ids that repeat share their cells, and each row meets each
        shared = bags.groupBy("comment_id").agg(F.sort_array(F.flatten(F.collect_list("cells"))).alias("cells"))
        bags = stage(bags.drop("cells").join(bags.select("comment_id"), "comment_id").join(shared, "comment_id"), "bags")
    occurring = columns.fit_columns(_train(bags).select(F.inline("cells")))
    rows = columns.vectors_in_rows(bags, occurring)
    return cut(models.fit_label_index(bags.select("lang"), "lang").transform(rows))


def _classified(name, width=WIDTH, **params):
    def run(spark, folder):
        rows = _labelled(spark, folder, width)
        model = models.fit(name, _train(rows), **params)
        return models.predict(model, rows.where("split = 'test'")).select("comment_id", "label", "prediction")

    return run


def _regressed(name, width=WIDTH, **params):
    def run(spark, folder):
        rows = _labelled(spark, folder, width, norm=None).withColumn("label", F.col("n_chars"))
        model = models.fit(name, _train(rows), regression=True, **params)
        return models.predict(model, rows.where("split = 'test'")).select(
            "comment_id", "label", F.round("prediction", 3).alias("prediction")
        )

    return run


query("t2_logistic_regression")(_classified("logistic_regression"))
query("t3_linear_svm")(_classified("linear_svm"))
query("t3_sgd_hinge")(_classified("sgd"))
query("t3_sgd_log_loss")(_classified("sgd", loss="log_loss"))
query("t4_decision_tree")(_classified("decision_tree"))
query("t4_decision_tree_regression")(_regressed("decision_tree"))
query("t5_random_forest")(_classified("random_forest"))
query("t5_random_forest_regression")(_regressed("random_forest"))
query("t6_boosted_trees")(_classified("boosted_trees"))
query("t6_boosted_trees_regression")(_regressed("boosted_trees"))
query("t9_perceptron")(_classified("perceptron", BOUNDED_WIDTH))
query("t10_linear_regression")(_regressed("linear"))
query("t10_ridge")(_regressed("ridge"))
query("t10_lasso")(_regressed("lasso"))
query("t10_elastic_net")(_regressed("elastic_net"))
query("t10_sgd_regression")(_regressed("sgd"))
query("t11_huber")(_regressed("huber"))
query("t12_ridge_classifier")(_classified("ridge"))
query("t13_ada_boost")(_classified("ada_boost"))


@query("t14_fit_and_predict")
def t14(spark, folder):
    from pyspark.ml.functions import vector_to_array

    rows = _labelled(spark, folder)
    model = models.fit("logistic_regression", _train(rows))
    judged = models.predict(model, rows.where("split = 'test'"))
    probability = F.get(vector_to_array("probability"), F.col("prediction").cast("int"))
    return judged.select("comment_id", "label", "prediction", F.round(probability, 6).alias("probability"))


@query(
    "t15_label_index",
    """SELECT CAST(doc_id AS STRING) AS comment_id, lang, CAST(dense_rank() OVER (ORDER BY lang) - 1 AS DOUBLE) AS label,
    lang AS name FROM documents""",
)
def t15(spark, folder):
    docs = t.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("comment_id"), "lang")
    index = models.fit_label_index(docs, "lang")
    return models.class_names(index, index.transform(docs), "label", "name")


@query(
    "t7_naive_bayes",
    f"""{PAIRS}, langs AS (SELECT CAST(doc_id AS STRING) AS comment_id, lang FROM documents),
    c AS (SELECT comment_id, split, lang, term_idx, n FROM pairs JOIN vocabulary USING (term) JOIN langs USING (comment_id)),
    priors AS (SELECT lang, ln(count(*) / sum(count(*)) OVER ()) AS prior
      FROM parts JOIN langs USING (comment_id) WHERE split = 'train' GROUP BY lang),
    sums AS (SELECT lang, term_idx, sum(n) AS s FROM c WHERE split = 'train' GROUP BY ALL),
    totals AS (SELECT lang, sum(s) AS s_all FROM sums GROUP BY lang),
    scores AS (SELECT comment_id, p.lang, any_value(prior) + sum(n * (ln(coalesce(s, 0) + 1) -
        ln(s_all + (SELECT count(*) FROM vocabulary)))) AS score
      FROM (SELECT * EXCLUDE (lang) FROM c WHERE split = 'test') x CROSS JOIN priors p JOIN totals USING (lang)
      LEFT JOIN sums ON sums.lang = p.lang AND sums.term_idx = x.term_idx GROUP BY comment_id, p.lang)
    SELECT comment_id, lang AS prediction, round(score, 4) AS score FROM scores
    QUALIFY row_number() OVER (PARTITION BY comment_id ORDER BY round(score, 6) DESC, lang) = 1""",
)
def t7(spark, folder):
    langs = t.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("comment_id"), "lang")
    parts = _parts(spark, folder)
    vocabulary = features.fit_vocabulary(_train(parts))
    counts = features.count_vectors(parts, vocabulary)
    marked = counts.join(parts.select("comment_id", "split"), "comment_id").join(langs, "comment_id", "left_semi")
    marked = stage(marked, "marked")  # texts are counted once for the fit and the scores
    train = _train(marked).drop("split")
    train_labels = langs.join(_train(parts).select("comment_id"), "comment_id", "left_semi")
    model = bayes.fit_bayes(train, train_labels, "lang", n_terms=vocabulary.table.count())
    test = marked.where("split = 'test'").drop("split")
    ids = parts.where("split = 'test'").join(langs, "comment_id", "left_semi")
    scored = stage(bayes.bayes_scores(model, test, "lang", ids=ids), "scores")
    best = bayes.best_classes(scored, "lang", digits=6)
    scores = scored.withColumnRenamed("lang", "prediction")
    return best.join(scores, ["comment_id", "prediction"]).withColumn("score", F.round("score", 4))


_NEAR = f"""WITH parts AS ({t.sql_split('(SELECT vec_id, embedding, label FROM embeddings)', 'vec_id')}),
near AS (SELECT q.vec_id AS query, q.label AS truth, x.vec_id AS neighbour, x.label AS target,
    list_distance(CAST(q.embedding AS DOUBLE[]), CAST(x.embedding AS DOUBLE[])) AS distance
  FROM parts q, parts x WHERE q.split = 'test' AND x.split = 'train'
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY distance, x.vec_id) <= 5)"""


def _near(spark, folder):
    ship_package(spark)
    parts = cut(split.random_split(t.table(spark, folder, "embeddings"), "vec_id"))
    return neighbours.nearest_neighbours(parts.where("split = 'test'"), _train(parts), "label", block_rows=256)


@query("t8_nearest_neighbours", f"{_NEAR} SELECT query, neighbour, target, round(distance, 6) AS distance FROM near")
def t8_near(spark, folder):
    return _near(spark, folder).select("query", "neighbour", "target", F.round("distance", 6).alias("distance"))


@query(
    "t8_neighbour_vote",
    f"""{_NEAR}, votes AS (SELECT query, target, count(*) AS n FROM near GROUP BY ALL)
    SELECT query, target AS prediction FROM votes QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, target) = 1""",
)
def t8_vote(spark, folder):
    return neighbours.vote(_near(spark, folder))


@query("t8_neighbour_average", f"{_NEAR} SELECT query, round(avg(target), 6) AS prediction FROM near GROUP BY query")
def t8_average(spark, folder):
    return neighbours.average(_near(spark, folder)).withColumn("prediction", F.round("prediction", 6))


# Metrics ---------------------------------------------------------------------------------------------

_MC = t.WITH_MULTICLASS
_BIN = t.WITH_BINARY


def _counts(with_sql):
    return f"""{with_sql}, ls AS (SELECT y_true AS label FROM preds UNION SELECT y_pred FROM preds),
    k AS (SELECT label, (SELECT count(*) FROM preds WHERE y_true = label AND y_pred = label) AS tp,
      (SELECT count(*) FROM preds WHERE y_pred = label) AS np, (SELECT count(*) FROM preds WHERE y_true = label) AS sup FROM ls),
    m AS (SELECT label, CASE WHEN np = 0 THEN 0 ELSE tp / np END AS precision, CASE WHEN sup = 0 THEN 0 ELSE tp / sup END
      AS recall, CASE WHEN np + sup = 0 THEN 0 ELSE 2 * tp / (np + sup) END AS f1, sup AS support FROM k)"""


_MCC, _BINC = _counts(_MC), _counts(_BIN)


@query("m1_accuracy", f"{_MC} SELECT round(avg(CASE WHEN y_true = y_pred THEN 1 ELSE 0 END), 6) AS accuracy FROM preds")
def m1(spark, folder):
    return metrics.accuracy(t.multiclass(spark, folder)).select(F.round("accuracy", 6).alias("accuracy"))


def _matrix(value):
    return f"""{_MC}, ls AS (SELECT DISTINCT lang AS l FROM documents),
    g AS (SELECT a.l AS y_true, b.l AS y_pred, count(p.y_true) AS n FROM ls a CROSS JOIN ls b
      LEFT JOIN preds p ON p.y_true = a.l AND p.y_pred = b.l GROUP BY a.l, b.l)
    SELECT y_true, y_pred, {value} AS value FROM g"""


for _how, _value in {
    None: "n",
    "true": "round(n / sum(n) OVER (PARTITION BY y_true), 6)",
    "pred": "round(n / sum(n) OVER (PARTITION BY y_pred), 6)",
    "all": "round(n / sum(n) OVER (), 6)",
}.items():

    def _m2(spark, folder, how=_how):
        matrix = metrics.confusion_matrix(t.multiclass(spark, folder), how)
        return matrix if how is None else matrix.withColumn("value", F.round("value", 6))

    query(f"m2_confusion_matrix_{_how or 'counts'}", _matrix(_value))(_m2)


def _averages(name):
    return f"""{_MCC} SELECT 'micro' AS average, round((SELECT sum(tp) / sum(np) FROM k), 6) AS value
    UNION ALL SELECT 'macro', round((SELECT avg({name}) FROM m), 6)
    UNION ALL SELECT 'weighted', round((SELECT sum({name} * support) / sum(support) FROM m), 6)
    UNION ALL SELECT label, round({name}, 6) FROM m"""


for _number, _score in (("m3", "precision"), ("m4", "recall"), ("m5", "f1")):

    def _averaged(spark, folder, name=_score):
        preds = t.multiclass(spark, folder)
        rows = metrics.score(preds, name, None).select(F.col("label").alias("average"), "value")
        for average in ("micro", "macro", "weighted"):
            value = metrics.score(preds, name, average).select(F.lit(average).alias("average"), "value")
            rows = rows.unionByName(value)
        return rows.withColumn("value", F.round("value", 6))

    query(f"{_number}_{_score}", _averages(_score))(_averaged)

    def _binary(spark, folder, name=_score):
        return metrics.score(t.binary(spark, folder), name, "binary").select(F.round("value", 6).alias("value"))

    query(f"{_number}_{_score}_binary", f"{_BINC} SELECT round({_score}, 6) AS value FROM m WHERE label = 1")(_binary)


@query("m6_log_loss", f"{_BIN} SELECT round(avg(-ln(p_true)), 6) AS log_loss FROM preds")
def m6(spark, folder):
    return metrics.log_loss(t.binary(spark, folder)).select(F.round("log_loss", 6).alias("log_loss"))


_FOUR = "round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1"


@query("m7_class_table", f"{_MCC} SELECT label, {_FOUR}, support FROM m")
def m7(spark, folder):
    table = metrics.class_table(t.multiclass(spark, folder))
    return table.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "m8_classification_report",
    f"""{_MCC}, acc AS (SELECT sum(tp) / sum(sup) AS a, CAST(sum(sup) AS BIGINT) AS s FROM k)
    SELECT label AS row, {_FOUR}, support FROM m
    UNION ALL SELECT 'accuracy', round(a, 6), round(a, 6), round(a, 6), s FROM acc
    UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM m
    UNION ALL SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6),
      round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM m""",
)
def m8(spark, folder):
    table = metrics.classification_report(t.multiclass(spark, folder))
    return table.select("row", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


WANTED = [
    ("accuracy_score", None, {}),
    ("log_loss", None, {}),
    ("precision_score", "macro", {"average": "macro"}),
    ("recall_score", "weighted", {"average": "weighted"}),
    ("f1_score", "micro", {"average": "micro"}),
    ("f1_score", None, {}),
]


@query(
    "m9_metric_list",
    f"""{_BINC} SELECT (SELECT round(sum(tp) / sum(sup), 6) FROM k) AS accuracy_score,
    (SELECT round(avg(-ln(p_true)), 6) FROM preds) AS log_loss,
    (SELECT round(avg(precision), 6) FROM m) AS precision_score_macro,
    (SELECT round(sum(recall * support) / sum(support), 6) FROM m) AS recall_score_weighted,
    (SELECT round(2 * sum(tp) / (sum(np) + sum(sup)), 6) FROM k) AS f1_score_micro,
    (SELECT round(f1, 6) FROM m WHERE label = 1) AS f1_score""",
)
def m9(spark, folder):
    row = metrics.evaluate(t.binary(spark, folder), WANTED)
    return row.select(*[F.round(c, 6).alias(c) for c in row.columns])


@query(
    "a8_write_predictions",
    f"""{_BIN} SELECT comment_id, CASE y_true WHEN 1 THEN 'good' ELSE 'bad' END AS y_true,
    CASE y_pred WHEN 1 THEN 'good' ELSE 'bad' END AS y_pred, CAST(y_true = y_pred AS INT) AS is_correct FROM preds""",
)
def a8(spark, folder):
    path = staging_path(spark, "predictions")
    names = spark.createDataFrame([(0, "bad"), (1, "good")], "index int, name string")
    writers.write_predictions(t.binary(spark, folder), names, path)
    return spark.read.parquet(path)


