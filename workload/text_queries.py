"""Queries over text normalisation and tokens."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from forumloom.functions import normalize as N
from forumloom.functions import tokens as K
from forumloom.functions.charsets import entity_codes
from forumloom.operators import normalizing as steps
from forumloom.operators import tokens
from forumloom.session import ship_package, stage
from workload import tables as t
from workload.registry import query

# SQL counterparts of the rewriting rules, in RE2 syntax ----------------------------------------------

RULES = {
    "code": (r"(?m)(^|\n)(\t| {4,})+[^\n]+?$", ""),
    "link": (rf"(http|www)[^{t.SPACE}]+", ""),
    "inline": (r"`+[^\n]+?`+", ""),
    "quoted": (r"(^|\n) {0,3}(&gt;|>)[^\n]*?\n", ""),
    "hyphen": ("[-–—]+", "-"),
    "punctuation": (rf"[^{t.WORD}{t.SPACE}''\-/]", " "),
    "whitespace": (
        r"[\x{180E}\x{2000}-\x{200B}\x{202F}\x{205F}\x{3000}\x{FEFF}\n\t\x0B\x08\r\f\x07 ]+",
        " ",
    ),
    "ticks": (r"`[^\n]+?`", ""),
    "ascii": (r"""[!"#$%&''()*+,\-./:;<=>?@\[\]^_`{|}~]""", ""),
}
APOSTROPHES = ("'`‘´’‛".replace("'", "''"), "''''''")
QUOTES = '"”“„»«「」『』（）〔〕【】《》〈〉'
MARKUP = ("code", "link", "inline", "quoted")


def sql_rule(text: str, name: str) -> str:
    pattern, replacement = RULES[name]
    return f"regexp_replace({text}, '{pattern}', '{replacement}', 'g')"


def sql_apostrophes(text: str) -> str:
    return f"translate({text}, '''`‘´’‛', '''''''''''''')"


def sql_quotes(text: str) -> str:
    return f"translate({text}, '{QUOTES}', '{chr(34) * len(QUOTES)}')"


def sql_accents(text: str) -> str:
    """``strip_accents`` after the compatibility characters of the test texts, then ASCII only."""
    pairs = [("ﬁ", "fi"), ("…", "..."), ("½", "12"), ("™", "TM"), ("´", " "), ("（", "("), ("）", ")")]
    spelled = reduce(lambda sql, p: f"replace({sql}, '{p[0]}', '{p[1]}')", pairs, text)
    return f"regexp_replace(strip_accents({spelled}), '[^\\x00-\\x7F]+', '', 'g')"


def sql_step(source: str, expression: str) -> str:
    return f"SELECT * REPLACE ({expression} AS text) FROM ({source})"


def sql_gated(source: str, names: tuple[str, ...]) -> str:
    """Several rules, each only where the original text matches; then strip."""
    sql = f"SELECT *, text AS orig FROM ({source})"
    for name in names:
        sql = sql_step(sql, f"CASE WHEN regexp_matches(orig, '{RULES[name][0]}') THEN {sql_rule('text', name)} ELSE text END")
    return f"SELECT * EXCLUDE (orig) REPLACE ({t.sql_strip('text')} AS text) FROM ({sql})"


def sql_entities(source: str) -> str:
    sql = f"SELECT *, text AS orig FROM ({source})"
    for code, literal in entity_codes():
        search = f"CASE WHEN contains(orig, '{code}') THEN '{code}' ELSE '&#never;' END"
        sql = sql_step(sql, f"replace(text, {search}, '{literal}')")
    return f"SELECT * EXCLUDE (orig) REPLACE ({t.sql_strip('text')} AS text) FROM ({sql})"


BASE = "SELECT comment_id, text FROM comments"
LOWERED = sql_step(BASE, "lower(text)")
UNACCENTED = sql_step(LOWERED, sql_accents("text"))
CONVERTED = sql_entities(UNACCENTED)
UNIFIED = sql_step(CONVERTED, t.sql_strip(sql_quotes(sql_rule("text", "hyphen"))))
BARE = sql_gated(UNIFIED, MARKUP)
QUOTED = sql_step(BARE, t.sql_strip(sql_apostrophes("text")))
BLANKED = sql_step(QUOTED, t.sql_strip(sql_rule("text", "punctuation")))
NORMAL = sql_step(BLANKED, t.sql_strip(sql_rule("text", "whitespace")))

WITH = t.WITH_COMMENTS
WITH_NORMAL = f"{WITH}, normal AS MATERIALIZED ({NORMAL})"

# Single transformations ------------------------------------------------------------------------------

_SINGLE = {
    "n1_lower_case": (N.lower_case, "lower(text)"),
    "n2_remove_accents": (N.remove_accents, sql_accents("text")),
    "n3_passthrough": (N.passthrough, "text"),
    "n4_apostrophes": (N.normalize_apostrophes, sql_apostrophes("text")),
    "n5_code_blocks": (N.remove_code_blocks, sql_rule("text", "code")),
    "n7_hyperlinks": (N.remove_hyperlinks, sql_rule("text", "link")),
    "n8_hyphens": (N.normalize_hyphens, sql_rule("text", "hyphen")),
    "n9_inline_code": (N.remove_inline_code, sql_rule("text", "inline")),
    "n10_punctuation": (N.blank_punctuation, sql_rule("text", "punctuation")),
    "n11_quotation_marks": (N.normalize_quotation_marks, sql_quotes("text")),
    "n12_quoted_lines": (N.remove_quoted_lines, sql_rule("text", "quoted")),
    "n13_whitespace": (N.collapse_whitespace, sql_rule("text", "whitespace")),
    "n14_strip": (N.strip, t.sql_strip("text")),
    "n20_backtick_spans": (N.remove_backtick_spans, sql_rule("text", "ticks")),
    "n21_ascii_punctuation": (N.remove_ascii_punctuation, sql_rule("text", "ascii")),
}


def _single(function):
    # quotation marks are dropped by cleaning, so single transformations read the raw texts
    def run(spark, folder):
        return t.raw_comments(spark, folder).select("comment_id", function(F.col("text")).alias("text"))

    return run


for _name, (_function, _expression) in _SINGLE.items():
    query(_name, f"{t.WITH_RAW} SELECT comment_id, {_expression} AS text FROM raw_comments")(_single(_function))


@query("n6_html_entities", f"{WITH} {sql_entities(BASE)}")
def n6(spark, folder):
    return steps.convert_entities(t.comments(spark, folder).select("comment_id", "text"), "text")


@query(
    "n6_page_entities",
    f"SELECT page_id, text FROM ({sql_entities('SELECT page_id, html AS text FROM pages')})",
)
def n6_pages(spark, folder):
    pages = t.table(spark, folder, "pages").select("page_id", F.col("html").alias("text"))
    return steps.convert_entities(pages, "text")


@query("n15_gated_rules", f"{WITH} {sql_gated(BASE, MARKUP)}")
def n15(spark, folder):
    return steps.remove_markup(t.comments(spark, folder).select("comment_id", "text"), "text")


@query("n15_gated_rules_as_column", f"{WITH} {sql_gated(BASE, MARKUP)}")
def n15_column(spark, folder):
    rules = [N.CODE_BLOCK, N.HYPERLINK, N.INLINE_CODE, N.QUOTED_LINE]
    return t.comments(spark, folder).select("comment_id", N.strip(N.rewrite(F.col("text"), rules)).alias("text"))


@query(
    "n17_steps_in_order",
    f"{WITH} {sql_step(sql_gated(sql_step(BASE, 'lower(text)'), ('link', 'inline')), sql_accents('text'))}",
)
def n17(spark, folder):
    chosen = steps.in_order(
        steps.lower_case, steps.rewrite_group(N.HYPERLINK, N.INLINE_CODE), steps.remove_accents
    )
    return chosen(t.comments(spark, folder).select("comment_id", "text"), "text")


@query("n18_full_normalization", f"{WITH} {NORMAL}")
def n18(spark, folder):
    return steps.normalize_text(t.comments(spark, folder).select("comment_id", "text"), "text")


def _normal(spark, folder):
    return steps.normalize_text(t.comments(spark, folder).select("comment_id", "text"), "text")


@query(
    "n22_single_or_multiple_replacements",
    f"""{t.WITH_RAW} SELECT comment_id, translate(text, 'abcde', 'ABCDE') AS one_by_one,
    translate(text, 'abcde', 'ABCDE') AS at_once FROM raw_comments""",
)
def n22(spark, folder):
    return t.raw_comments(spark, folder).select(
        "comment_id",
        N.upper_one_by_one(F.col("text")).alias("one_by_one"),
        N.upper_at_once(F.col("text")).alias("at_once"),
    )


# Tokens ----------------------------------------------------------------------------------------------

WITH_TOKENS = f"""{WITH}, tokens AS MATERIALIZED (
  SELECT comment_id, unnest(range(len(ts))) AS pos, unnest(ts) AS token
  FROM (SELECT comment_id, {t.sql_tokens('text')} AS ts FROM comments))"""


@query("k1_token_positions", f"{WITH_TOKENS} SELECT comment_id, pos, token FROM tokens")
def k1(spark, folder):
    return tokens.token_rows(t.comments(spark, folder))


@query("k2_explode_tokens", f"{WITH_TOKENS} SELECT token, count(*) AS n FROM tokens GROUP BY token")
def k2(spark, folder):
    return tokens.tokens_only(t.comments(spark, folder)).groupBy("token").agg(F.count(F.lit(1)).alias("n"))


STOP_WORDS = tokens.english_stop_words


def _stop_list() -> str:
    # fixed values: a short list in several languages, given as a table in real use
    return "('the'), ('of'), ('and'), ('to'), ('in'), ('is'), ('it'), ('le'), ('la'), ('de'), ('der'), ('die'), ('und'), ('el'), ('Que')"


STOPS = f"stops AS (SELECT lower(w) AS word FROM (VALUES {_stop_list()}) AS x(w))"
_KEPT = f"list_filter({t.sql_tokens('text')}, lambda x: NOT list_contains(words, lower(x)))"
_LISTED = "(SELECT list(word) AS words FROM stops)"


def _stop_table(spark):
    return spark.sql(f"SELECT * FROM VALUES {_stop_list()} AS x(word)")


@query("k3_stop_words", f"{WITH}, {STOPS} SELECT comment_id, array_to_string({_KEPT}, ' ') AS text FROM comments, {_LISTED}")
def k3(spark, folder):
    return tokens.remove_stop_words(t.comments(spark, folder).select("comment_id", "text"), _stop_table(spark))


@query(
    "k3_stop_words_by_join",
    f"{WITH}, {STOPS} SELECT comment_id, array_to_string({_KEPT}, ' ') AS text FROM comments, {_LISTED}",
)
def k3_join(spark, folder):
    docs = t.comments(spark, folder).select("comment_id", "text")
    return tokens._join_words(docs, _stop_table(spark), "text")


def _ending(spark, folder, letter, target):
    found = tokens.tokens_only(t.comments(spark, folder)).distinct().where(F.col("token").endswith(letter))
    return found.select("token", F.expr("substring(token, 1, length(token) - 1)").alias(target))


def _mapped(letter):
    changed = f"CASE WHEN ends_with(token, '{letter}') THEN token[:-2] ELSE token END"
    return f"""{WITH_TOKENS} SELECT comment_id, coalesce(string_agg({changed}, ' ' ORDER BY pos), '') AS text
    FROM comments LEFT JOIN tokens USING (comment_id) GROUP BY comment_id"""


@query("k4_lemmas", _mapped("s"))
def k4(spark, folder):
    docs = t.comments(spark, folder).select("comment_id", "text")
    return tokens.map_tokens(docs, _ending(spark, folder, "s", "lemma"))


@query("k7_stems_by_dictionary", _mapped("e"))
def k7(spark, folder):
    docs = t.comments(spark, folder).select("comment_id", "text")
    return tokens.map_tokens(docs, _ending(spark, folder, "e", "stem"), "token", "stem")


@query("k5_porter_stems")
def k5(spark, folder):
    ship_package(spark)
    return tokens.porter_stem(t.comments(spark, folder).select("comment_id", "text"))


@query(
    "k6_regex_stems",
    f"""{WITH_TOKENS} SELECT comment_id, coalesce(string_agg(CASE WHEN length(token) >= 4
      THEN regexp_replace(token, '(ing|s|e|able)$', '') ELSE token END, ' ' ORDER BY pos), '') AS text
    FROM comments LEFT JOIN tokens USING (comment_id) GROUP BY comment_id""",
)
def k6(spark, folder):
    docs = t.comments(spark, folder).select("comment_id", "text")
    return tokens.regex_stem(docs, "(ing|s|e|able)$", 4)


_ANNOTATED = f"""{WITH}, pieces AS (
  SELECT comment_id, unnest(range(len(ts))) AS pos, unnest(ts) AS text FROM (SELECT comment_id,
    regexp_extract_all(text, '`+|[{t.WORD}]+(?:[''\\-][{t.WORD}]+)*|[^{t.SPACE}{t.WORD}]') AS ts FROM comments)),
seen AS (SELECT *, text LIKE '`%' AS tick,
  CAST(count(*) FILTER (text LIKE '`%') OVER (PARTITION BY comment_id ORDER BY pos) AS BIGINT) AS upto,
  CAST(count(*) FILTER (text LIKE '`%') OVER (PARTITION BY comment_id) AS BIGINT) AS total FROM pieces),
marked AS (SELECT comment_id, pos, text, NOT regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AS is_punct,
  CASE WHEN tick THEN upto <= total - total % 2 ELSE upto % 2 = 1 AND upto < total END AS is_inline_code FROM seen)"""


@query("k8_annotate_tokens", f"{_ANNOTATED} SELECT comment_id, pos, text, is_punct, is_inline_code FROM marked")
def k8(spark, folder):
    return tokens.annotate_tokens(t.comments(spark, folder))


@query(
    "k8_drop_annotated",
    f"""{_ANNOTATED} SELECT comment_id, string_agg(text, ' ' ORDER BY pos) AS text FROM marked
    WHERE NOT is_punct AND NOT is_inline_code GROUP BY comment_id""",
)
def k8_drop(spark, folder):
    return tokens.drop_annotated(tokens.annotate_tokens(t.comments(spark, folder)))


@query(
    "g13_regroup_tokens",
    f"{WITH_TOKENS} SELECT comment_id, string_agg(token, ' ' ORDER BY pos) AS text FROM tokens GROUP BY comment_id",
)
def g13(spark, folder):
    return tokens.regroup(tokens.token_rows(t.comments(spark, folder)))


WITH_NORMAL_TOKENS = f"""{WITH_NORMAL}, tokens AS MATERIALIZED (
  SELECT comment_id, unnest({t.sql_tokens('text')}) AS token FROM normal),
vocabulary AS MATERIALIZED (
  SELECT token, row_number() OVER (ORDER BY token) - 1 AS term_idx FROM (SELECT DISTINCT token FROM tokens))"""


@query("k9_vocabulary", f"{WITH_NORMAL_TOKENS} SELECT token, term_idx FROM vocabulary")
def k9(spark, folder):
    return tokens.vocabulary(_normal(spark, folder))


@query("k10_vocabulary_size", f"{WITH_NORMAL_TOKENS} SELECT count(*) AS n_tokens FROM vocabulary")
def k10(spark, folder):
    return tokens.vocabulary_size(_normal(spark, folder))


@query("k10_vocabulary_size_approximate")
def k10_approximate(spark, folder):
    return tokens.vocabulary_size(_normal(spark, folder), approximate=True)


@query(
    "k10_vocabulary_sketches",
    f"""{t.WITH_COMMENTS}, ts AS (SELECT DISTINCT subreddit, unnest({t.sql_tokens('text')}) AS token FROM comments)
    SELECT subreddit, count(*) AS n_tokens, true AS close FROM ts GROUP BY subreddit
    UNION ALL SELECT NULL, count(DISTINCT token), true FROM ts""",
)
def k10_sketches(spark, folder):
    """Exact sizes, and whether those of stored and merged sketches are within four standard errors."""
    docs = t.comments(spark, folder)
    sketches = stage(tokens.vocabulary_sketches(docs), "sketches")
    every = tokens.merged_vocabulary_size(sketches).withColumn("subreddit", F.lit(None).cast("string"))
    guess = tokens.merged_vocabulary_size(sketches, "subreddit").unionByName(every).withColumnRenamed("n_tokens", "guess")
    rows = docs.select("subreddit", F.explode(K.whitespace_tokens(F.col("text"))).alias("token")).distinct()
    exact = rows.groupBy("subreddit").agg(F.count(F.lit(1)).alias("n_tokens"))
    whole = rows.agg(F.count_distinct("token").alias("n_tokens")).withColumn("subreddit", F.lit(None).cast("string"))
    both = exact.unionByName(whole).join(guess.withColumnRenamed("subreddit", "s"), F.col("subreddit").eqNullSafe(F.col("s")))
    close = F.abs(F.col("guess") - F.col("n_tokens")) <= 4 * 0.8 / 64 * F.col("n_tokens") + 1
    return both.select("subreddit", "n_tokens", close.alias("close"))


@query(
    "n18_full_normalization_with_stop_words_and_lemmas",
    f"""{WITH_NORMAL}, {STOPS}, ts AS (SELECT comment_id, {_KEPT} AS ts FROM normal, {_LISTED})
    SELECT comment_id, array_to_string(list_transform(ts, lambda x: CASE WHEN ends_with(x, 's') THEN x[:-2] ELSE x END), ' ')
      AS text FROM ts""",
)
def n18_lemmas(spark, folder):
    docs = tokens.remove_stop_words(_normal(spark, folder), _stop_table(spark))
    lemmas = tokens.tokens_only(docs).distinct().where(F.col("token").endswith("s"))
    lemmas = lemmas.select("token", F.expr("substring(token, 1, length(token) - 1)").alias("lemma"))
    return tokens.map_tokens(docs, lemmas)


@query(
    "top_tokens_per_forum",
    f"""{WITH_NORMAL}, counts AS (
      SELECT subreddit, token, count(*) AS n FROM (
        SELECT subreddit, unnest({t.sql_tokens('normal.text')}) AS token FROM normal JOIN comments USING (comment_id))
      GROUP BY subreddit, token)
    SELECT subreddit, token, n FROM counts
    QUALIFY row_number() OVER (PARTITION BY subreddit ORDER BY n DESC, token) <= 10""",
)
def top_tokens(spark, folder):
    """Raw comments cleaned, normalised, tokenised and counted; the ten most frequent tokens of each forum."""
    from pyspark.sql import Window

    from forumloom.functions.tokens import whitespace_tokens

    normal = steps.normalize_text(t.comments(spark, folder), "text")
    words = normal.select("subreddit", F.explode(whitespace_tokens(F.col("text"))).alias("token"))
    counts = words.groupBy("subreddit", "token").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.partitionBy("subreddit").orderBy(F.desc("n"), "token"))
    return counts.withColumn("r", rank).where("r <= 10").drop("r")
