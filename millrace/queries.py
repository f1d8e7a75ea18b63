"""Queries of the engine's own operators over the test tables, with the same results in SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import sequences as S
from millrace.functions import text as X
from millrace.operators import align, counting, evaluate, lines, lm, matching, mining, projection, tagged, tagger
from millrace.operators.grammar import buckets_rows, collocation_grammar, default_grammar
from millrace.plans.scratch import materialise, new_path, spread
from millrace.sources import lines as L
from millrace.sources import tables
from millrace.sources.lines import numbered, split_columns

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return put


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_words(c: str) -> Column:
    """Lower-cased runs of ASCII letters."""
    return F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]+"), F.lit(0)), lambda x: F.lower(x))


WORDS = "list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: lower(x))"


def doc_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", ascii_words("text").alias("words"))


def turns(spark: SparkSession, sf_dir: str, role: str) -> DataFrame:
    """(conv_id, k, text): the k-th turn of a role in each conversation."""
    rows = read(spark, sf_dir, "conversations").filter(F.col("role") == role)
    return rows.withColumn("k", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "text"))).select("conv_id", "k", "text")


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = turns(spark, sf_dir, "user"), turns(spark, sf_dir, "assistant")
    return a.withColumnRenamed("text", "a").join(b.withColumnRenamed("text", "b"), ["conv_id", "k"]).select("conv_id", "k", ascii_words("a").alias("src"), ascii_words("b").alias("tgt"))


TURNS = """t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS k FROM conversations),
pairs AS (SELECT a.conv_id, a.k, list_transform(regexp_extract_all(a.text, '[A-Za-z]+'), lambda x: lower(x)) AS src,
  list_transform(regexp_extract_all(b.text, '[A-Za-z]+'), lambda x: lower(x)) AS tgt
  FROM t a JOIN t b ON a.conv_id = b.conv_id AND a.k = b.k WHERE a.role = 'user' AND b.role = 'assistant')"""


@query(f"""
WITH d AS (SELECT {WORDS} AS w FROM documents),
p AS (SELECT w[i] AS key, w[i + 1] AS pat FROM d, unnest(range(1, greatest(len(w), 1))) AS r(i)),
c AS (SELECT key, pat, count(*) AS cnt FROM p GROUP BY ALL),
s AS (SELECT key, sum(cnt) AS freq, avg(cnt) AS a, stddev_pop(cnt) AS dev FROM c GROUP BY key)
SELECT c.key, c.pat, c.cnt, freq::BIGINT AS freq, round(a, 6) AS avg_freq, round(dev, 6) AS dev
FROM c JOIN s USING (key) WHERE dev > 0 AND cnt > 5 AND (cnt - a) / dev > 1""")
def good_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mining.good_neighbours(read(spark, sf_dir, "documents"))
    return out.withColumns({"avg_freq": F.round("avg_freq", 6), "dev": F.round("dev", 6)})


@query(f"""
WITH d AS (SELECT {WORDS} AS w FROM documents),
g AS (SELECT array_to_string(w[i:i + n - 1], ' ') AS zh_seg,
  array_to_string(list_transform(w[i:i + n - 1], lambda x: length(x)::VARCHAR), ' ') AS tag
  FROM d, unnest(range(1, 6)) AS o(n), unnest(range(1, greatest(len(w) - n + 2, 1))) AS r(i)),
c AS (SELECT zh_seg, tag, count(*) AS count FROM g GROUP BY ALL)
SELECT replace(zh_seg, ' ', '') AS zh, zh_seg, tag, count, round(ln(count / sum(count) OVER ()), 6) AS pr FROM c""")
def phrase_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_words(spark, sf_dir).withColumn("tags", F.transform("words", lambda w: F.length(w).cast("string")))
    return counting.phrase_counts(rows).withColumn("pr", F.round("pr", 6))


ORDERED = "l AS (SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) - 1 AS line_no, text AS value FROM conversations)"


def conversation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    return numbered(rows, "conv_id", "turn", "role", "text").select("line_no", F.col("text").alias("value"))


@query(f"WITH {ORDERED}, n AS (SELECT count(*) // 3 AS g FROM l) SELECT line_no // 3 AS line_no, value FROM l, n WHERE line_no % 3 = 1 AND line_no // 3 < g")
def stanza_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.slice_groups(conversation_lines(spark, sf_dir), 3, 1)


@query(f"WITH {ORDERED}, n AS (SELECT count(*) // 30 AS g FROM l) SELECT line_no, CASE WHEN line_no % 30 < 27 THEN 'train' ELSE 'test' END AS part FROM l, n WHERE line_no // 30 < g")
def fold_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.fold_split(conversation_lines(spark, sf_dir)).select("line_no", "part")


@query("""
WITH l AS (SELECT role, row_number() OVER (PARTITION BY role ORDER BY conv_id, turn, text) - 1 AS n, text FROM conversations WHERE role IN ('user', 'assistant')),
z AS (SELECT a.n, a.text AS a, b.text AS b FROM l a JOIN l b ON a.n = b.n WHERE a.role = 'user' AND b.role = 'assistant')
SELECT n * 3 AS line_no, a AS value FROM z UNION ALL SELECT n * 3 + 1, b FROM z UNION ALL SELECT n * 3 + 2, '' FROM z""")
def zip_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    one = lambda role: numbered(rows.filter(F.col("role") == role), "conv_id", "turn", "text").select("line_no", F.col("text").alias("value"))
    return lines.interleave(one("user"), one("assistant"))


@query("""
WITH p AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS n, p_name, p_brand, p_type FROM part)
SELECT n * 4 AS line_no, p_name AS value FROM p UNION ALL SELECT n * 4 + 1, p_brand FROM p UNION ALL SELECT n * 4 + 2, p_type FROM p UNION ALL SELECT n * 4 + 3, '' FROM p""")
def tsv_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(read(spark, sf_dir, "part"), "p_partkey").select("line_no", F.concat_ws("\t", "p_name", "p_brand", "p_type").alias("value"))
    return lines.unpivot_columns(split_columns(rows, 3))


@query("SELECT doc_id, text AS tgt FROM documents WHERE length(text) <= 119")
def length_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.prune_long(read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("tgt")))


@query("""
WITH e AS (SELECT user_id, list(CASE WHEN event_type = 'purchase' THEN 'B-VP' ELSE 'B-NP' END ORDER BY ts, event_id) AS c FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN c[1] = 'B-VP' THEN 'vp' WHEN NOT list_contains(c, 'B-VP') THEN 'pure_np' ELSE 'np' END AS route FROM e""")
def route_three_way(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = F.when(F.col("event_type") == "purchase", "B-VP").otherwise("B-NP")
    rows = read(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", chunk.alias("c")))).alias("_e"))
    return lines.route_chunks(rows.select("user_id", F.transform("_e", lambda x: x["c"]).alias("chunks"))).select("user_id", "route")


@query(f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), p AS (SELECT doc_id, (i - 1)::INTEGER AS "at", w[i] AS item FROM d, unnest(range(1, len(w) + 1)) AS r(i))
SELECT doc_id, "at", CASE WHEN count(*) OVER (PARTITION BY doc_id, item) > 1
  THEN item || row_number() OVER (PARTITION BY doc_id, item ORDER BY "at") ELSE item END AS item FROM p""")
def dup_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tagged.number_repeats(doc_words(spark, sf_dir), "doc_id", "words")


TAGS = "list_transform(w, lambda x: CASE length(x) % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'B-NP' ELSE 'I-NP' END)"


@query(f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), t AS (SELECT doc_id, {TAGS} AS t FROM d)
SELECT doc_id, array_to_string(list_transform(t, lambda x, i: CASE WHEN x = 'O' THEN 'O'
  WHEN coalesce(t[i + 1], 'O') LIKE 'I-%' THEN 'I-NP' ELSE 'H-NP' END), ' ') AS chunks FROM t""")
def chunk_iih(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda x: F.when(F.length(x) % 3 == 0, "O").when(F.length(x) % 3 == 1, "B-NP").otherwise("I-NP")
    rows = doc_words(spark, sf_dir).withColumn("t", F.transform("words", tag))
    return rows.select("doc_id", F.array_join(S.to_inside_head(F.col("t")), " ").alias("chunks"))


@query("""
SELECT l_partkey, l_suppkey, l_discount AS prob, l_orderkey, l_linenumber FROM (
  SELECT *, row_number() OVER (PARTITION BY l_partkey, l_suppkey ORDER BY l_discount DESC, l_orderkey, l_linenumber) AS r FROM lineitem) WHERE r = 1 AND l_discount > 1e-10""")
def best_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey", F.col("l_discount").alias("prob"), "l_orderkey", "l_linenumber").filter("prob > 1e-10")
    return counting.best_per_group(rows, ["l_partkey", "l_suppkey"], [F.desc("prob"), F.col("l_orderkey"), F.col("l_linenumber")])


@query("""
WITH n AS (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY ALL)
SELECT p_type, sum(n)::BIGINT AS total, string_agg(p_brand || ':' || n, ' ' ORDER BY n DESC, p_brand) AS members FROM n GROUP BY p_type""")
def invert_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counting.invert_sum(read(spark, sf_dir, "part").withColumn("one", F.lit(1)), "p_brand", "p_type", "one")
    return out.select("p_type", "total", F.array_join(F.transform("members", lambda m: F.concat_ws(":", m["value"], m["n"].cast("string"))), " ").alias("members"))


@query("""
WITH p AS (SELECT item_id, w, unnest(range(1, len(w) - 1)) AS i FROM (SELECT item_id, list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> '') AS w FROM benchmark)),
r AS (SELECT item_id || ':' || i AS phrase_id, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS ph, list_distinct([w[i] || ' ' || w[i + 1], w[i + 1] || ' ' || w[i + 2]]) AS grams FROM p),
b AS (SELECT doc_id, list_filter(string_split_regex(text, '[ \\t\\n]+'), lambda x: x <> '') AS w FROM documents),
d AS (SELECT DISTINCT doc_id, gram FROM (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS gram FROM b)),
m AS (SELECT phrase_id, ph, doc_id FROM (SELECT phrase_id, ph, len(grams) AS n, unnest(grams) AS gram FROM r) JOIN d USING (gram) GROUP BY phrase_id, ph, n, doc_id HAVING count(*) = n)
SELECT phrase_id, doc_id AS line_no FROM m JOIN documents USING (doc_id) WHERE contains(text, ph)""")
def sentence_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a run of three words of a benchmark item, for every such run."""
    words = F.filter(F.split("text", r"[ \t\n]+"), lambda x: x != "")
    runs = read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(S.ngrams(words, 3)).alias("at", "en_phrase"))
    phrases = runs.select(F.concat_ws(":", "item_id", F.col("at") + 1).alias("phrase_id"), "en_phrase", F.lit("").alias("ch_phrase"))
    sents = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("line_no"), F.col("text").alias("en"), F.lit("").alias("ch"))
    return projection.sentence_matches(phrases, sents).select("phrase_id", "line_no")


@query(f"""
WITH {TURNS} SELECT conv_id, k, round(CASE WHEN len(list_distinct(src || tgt)) = 0 THEN 0
  ELSE len(list_intersect(list_distinct(src), list_distinct(tgt))) / len(list_distinct(src || tgt)) * len(list_distinct(src)) END, 6) AS score FROM pairs""")
def jaccard_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turn_pairs(spark, sf_dir).select("conv_id", "k", F.round(S.overlap_score(F.col("src"), F.col("tgt")), 6).alias("score"))


JOINERS = "[-/.﹒~—─=*&_’]*"


@query(f"""
SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^[\\s\\pZ]+|[\\s\\pZ]+$', '', 'g'), '[{X.NUMERALS}]+|[0-9]+', chr(1), 'g'),
  '{JOINERS}(?:[A-Za-z]+{JOINERS})+', '{{{{FW}}}}', 'g'), chr(1), '{{{{CD}}}}', 'g') AS value FROM documents""")
def placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", X.mark(X.squeeze(F.col("text"))).alias("value"))


@query("SELECT doc_id, text AS value FROM documents")
def fullwidth(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = F.translate("text", "0123456789ABCabc!?", "０１２３４５６７８９ＡＢＣａｂｃ！？")
    return read(spark, sf_dir, "documents").select("doc_id", X.to_half_width(wide).alias("value"))


@query("SELECT doc_id, rtrim(regexp_replace(regexp_replace(text, '[\\s\\pZ\\x0B\\x85]', '', 'g'), '(.)', '\\1 ', 'g')) AS tokens FROM documents")
def char_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(X.char_tokens(F.col("text")), " ").alias("tokens"))


@query("""
WITH c AS (SELECT doc_id, regexp_extract_all(text, '[^;!?:。,]*[;!?:。,]|[^;!?:。,]+') AS c FROM documents)
SELECT doc_id, (i - 1)::INTEGER AS "at", c[i] AS clause FROM c, unnest(range(1, len(c) + 1)) AS r(i)""")
def sentence_tokenise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.clause_split(F.col("text"))).alias("at", "clause"))


PART = "w AS (SELECT p_partkey, string_split(p_name, ' ') AS w, string_split(p_type, ' ') AS t FROM part)"


@query(f"""
WITH {PART} SELECT p_partkey, array_to_string(list_transform(range(1, least(len(w), len(t)) + 1), lambda i: w[i] || '/' || t[i]), ' ') AS joined,
  array_to_string(list_transform(range(1, least(len(w), len(t)) + 1), lambda i: string_split(w[i], '/')[1]), ' ') AS stripped FROM w""")
def slash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", S.slash_joined(X.tokens(F.col("p_name")), X.tokens(F.col("p_type"))).alias("joined"))
    return rows.withColumn("stripped", lines.strip_tags(F.col("joined")))


@query("""
WITH v AS (SELECT p_partkey AS line_no, 'a [-' || p_name || '-] {+' || p_type || '+} b [-x y-] {+z+}' AS v FROM part),
s AS (SELECT line_no, unnest(regexp_extract_all(v, '\\[-.*?-\\] \\{\\+.*?\\+\\}')) AS span FROM v)
SELECT line_no, unnest(string_split(regexp_extract(span, '^\\[-(.*)-\\]', 1), ' ')) AS word FROM s""")
def error_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("a [-"), "p_name", F.lit("-] {+"), "p_type", F.lit("+} b [-x y-] {+z+}"))
    return evaluate.error_words(evaluate.error_spans(read(spark, sf_dir, "part").select(F.col("p_partkey").alias("line_no"), value.alias("value"))))


@query(f"""
WITH v AS (SELECT DISTINCT unnest({WORDS}) AS word FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest({WORDS}) AS word FROM documents)
SELECT DISTINCT doc_id FROM d JOIN v USING (word)""")
def semi_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocab = read(spark, sf_dir, "benchmark").select(F.explode(ascii_words("text")).alias("word")).distinct()
    return counting.vocabulary_gate(doc_words(spark, sf_dir), vocab, "doc_id", F.col("words")).select("doc_id")


@query()
def sample_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.sample_lines(read(spark, sf_dir, "documents").select("doc_id", "text"), 100)


RAW = "regexp_extract_all(text, '[A-Za-z]+')"


@query(f"""
WITH d AS (SELECT {RAW} AS w FROM documents), c AS (SELECT word, count(*) AS n FROM (SELECT unnest(w[2:]) AS word FROM d) GROUP BY word)
SELECT lower(word) AS lower, word, n FROM c QUALIFY row_number() OVER (PARTITION BY lower(word) ORDER BY n DESC, word) = 1""")
def truecase_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.truecase_model(read(spark, sf_dir, "documents").select(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)).alias("words")))


@query(f"""
WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM conversations) GROUP BY word)
SELECT row_number() OVER (ORDER BY n DESC, word) + 1 AS id, word, n FROM c""")
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.vocabulary(read(spark, sf_dir, "conversations").select(ascii_words("text").alias("words")))


@query(f"""
WITH {{}}, c AS (SELECT word, count(*) AS n FROM (SELECT unnest({WORDS.replace('text', 'value')}) AS word FROM l) GROUP BY word),
v AS (SELECT row_number() OVER (ORDER BY n DESC, word) + 1 AS id, word FROM c), d AS (SELECT line_no, {WORDS.replace('text', 'value')} AS w FROM l),
f AS (SELECT line_no, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(i))
SELECT line_no, string_agg(id::VARCHAR, ' ' ORDER BY i) AS ids FROM f JOIN v USING (word) GROUP BY line_no""".replace("{}", ORDERED))
def numericalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(conversation_lines(spark, sf_dir).select("line_no", ascii_words("value").alias("words")), "lines")
    out = counting.numericalise(rows, counting.vocabulary(rows), "line_no")
    return out.select("line_no", F.array_join(F.transform("ids", lambda i: i.cast("string")), " ").alias("ids"))


@query(f"WITH {TURNS} SELECT DISTINCT s AS src, t AS tgt FROM (SELECT unnest(list_distinct(src)) AS s, tgt FROM pairs), unnest(list_distinct(tgt)) AS r(t)")
def cooc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counting.cooccurrence(turn_pairs(spark, sf_dir))


@query(f"""
WITH d AS (SELECT ['<s>'] || {WORDS} || ['</s>'] AS w FROM documents),
b AS (SELECT h, w, count(*) AS n FROM (SELECT w[i] AS h, w[i + 1] AS w FROM d, unnest(range(1, len(w))) AS r(i)) GROUP BY ALL),
u AS (SELECT w, count(*) AS n FROM b GROUP BY w),
ub AS (SELECT count(*) FILTER (n = 1)::DOUBLE a, count(*) FILTER (n = 2)::DOUBLE b, count(*) FILTER (n = 3)::DOUBLE c, count(*) FILTER (n = 4)::DOUBLE d FROM u),
bb AS (SELECT count(*) FILTER (n = 1)::DOUBLE a, count(*) FILTER (n = 2)::DOUBLE b, count(*) FILTER (n = 3)::DOUBLE c, count(*) FILTER (n = 4)::DOUBLE d FROM b),
ud0 AS (SELECT a * b * c * d > 0 AS ok, 1 - 2 * (a / (a + 2 * b)) * b / a AS x, 2 - 3 * (a / (a + 2 * b)) * c / b AS y, 3 - 4 * (a / (a + 2 * b)) * d / c AS z FROM ub),
bd0 AS (SELECT a * b * c * d > 0 AS ok, 1 - 2 * (a / (a + 2 * b)) * b / a AS x, 2 - 3 * (a / (a + 2 * b)) * c / b AS y, 3 - 4 * (a / (a + 2 * b)) * d / c AS z FROM bb),
ud AS (SELECT CASE WHEN g THEN x ELSE 0.2 END d1, CASE WHEN g THEN y ELSE 0.2 END d2, CASE WHEN g THEN z ELSE 0.2 END d3 FROM (SELECT *, coalesce(ok AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 2 AND z BETWEEN 0 AND 3, false) AS g FROM ud0)),
bd AS (SELECT CASE WHEN g THEN x ELSE 0.2 END d1, CASE WHEN g THEN y ELSE 0.2 END d2, CASE WHEN g THEN z ELSE 0.2 END d3 FROM (SELECT *, coalesce(ok AND x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 2 AND z BETWEEN 0 AND 3, false) AS g FROM bd0)),
uc AS (SELECT w, n, CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS c FROM u, ud),
up AS (SELECT w, (n - c) / sum(n) OVER () + sum(c) OVER () / sum(n) OVER () / (count(*) OVER () + 1) AS p FROM uc),
bc AS (SELECT h, b.w, n, CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END AS c FROM b, bd)
SELECT h || ' ' || bc.w AS gram, round(log10((n - c) / sum(n) OVER (PARTITION BY h) + sum(c) OVER (PARTITION BY h) / sum(n) OVER (PARTITION BY h) * p), 6) AS prob
FROM bc JOIN up ON bc.w = up.w""")
def lm_bigram_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.kneser_ney(doc_words(spark, sf_dir), 2).filter("n = 2").select("gram", F.round("prob", 6).alias("prob"))


@query()
def lm_kn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders up to the default of six, with back-off weights."""
    return lm.kneser_ney(doc_words(spark, sf_dir)).select("n", "gram", F.round("prob", 6).alias("prob"), F.round("backoff", 6).alias("backoff"))


ROUNDS = ",\n".join(
    f"""p{k} AS (SELECT s, t, c / sum(c) OVER (PARTITION BY s) AS p FROM c{k}),
c{k + 1} AS (SELECT s, t, sum(q) AS c FROM (SELECT a.s, a.t, p * a * b / sum(p * a) OVER (PARTITION BY conv_id, k, a.t) AS q FROM a JOIN p{k} ON a.s = p{k}.s AND a.t = p{k}.t) GROUP BY ALL)"""
    for k in range(1, 5)
)


@query(f"""
WITH {TURNS}, s AS (SELECT conv_id, k, unnest(src) AS s, tgt FROM pairs),
w AS (SELECT conv_id, k, s, t, count(*) AS n FROM s, unnest(tgt) AS r(t) GROUP BY ALL),
m AS (SELECT conv_id, k, t, count(*)::DOUBLE AS b FROM (SELECT conv_id, k, unnest(tgt) AS t FROM pairs) GROUP BY ALL),
a AS (SELECT w.conv_id, w.k, s, w.t, n / b AS a, b FROM w JOIN m ON w.conv_id = m.conv_id AND w.k = m.k AND w.t = m.t),
c1 AS (SELECT s, t, sum(q) AS c FROM (SELECT s, t, a * b / sum(a) OVER (PARTITION BY conv_id, k, t) AS q FROM a) GROUP BY ALL),
{ROUNDS}
SELECT s, t, round(c / sum(c) OVER (PARTITION BY s), 6) AS p FROM c5""")
def ibm1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = turn_pairs(spark, sf_dir).withColumn("pair_id", F.xxhash64("conv_id", "k"))
    return align.model_one(pairs, 5).select("s", "t", F.round("p", 6).alias("p"))


#: Characters that stand for a to z in toktag, neither Latin nor numerals nor clause marks.
UNSPACED = "甲乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥天地人和"


@query()
def toktag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names as unspaced text, a character for each letter: Latin words would fold to one placeholder before the lookup."""
    words = F.transform(X.tokens(F.col("p_name")), lambda w: F.translate(F.lower(w), "abcdefghijklmnopqrstuvwxyz", UNSPACED))
    rows = read(spark, sf_dir, "part").select("p_partkey", words.alias("words"), F.transform(words, lambda w: F.concat(F.lit("L"), F.length(w).cast("string"))).alias("tags"), F.array_join(words, "").alias("value"))
    phrases = counting.phrase_counts(rows)
    model = lm.BackoffModel.collected(lm.kneser_ney(rows.select(F.col("tags").alias("words")), 3))
    return tagger.tag_lines(rows.select("p_partkey", "value"), tagger.first_phrases(phrases), model).drop("value")


def tagged_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents with tags by a rule on word lengths: text without a tagger."""
    line = spread(read(spark, sf_dir, "documents")).select("doc_id", F.explode(F.split("text", "\n")).alias("l"))
    words = line.select("doc_id", X.tokens(F.col("l")).alias("words"))  # a filter would make the words twice; empty lines match nothing
    kinds = F.array(*(F.lit(x) for x in ("NN", "VBP", "IN", "JJ", "DT", "NN", "VBG", "TO", "NNS")))
    chunks = F.array(*(F.lit(x) for x in ("H-NP", "H-VP", "H-PP", "I-NP", "I-NP", "H-NP", "H-VP", "H-PP", "H-NP")))
    by_length = lambda table: F.transform("words", lambda w: F.get(table, (F.length(w) % 9).cast("int")))
    return words.select("words", F.transform("words", lambda w: F.lower(w)).alias("lemmas"), by_length(kinds).alias("poss"), by_length(chunks).alias("chunks"))


@query()
def pattern_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(matching.pattern_rows(tagged_documents(spark, sf_dir), default_grammar(), None), "pattern_rows")
    return mining.pretty(mining.example_rollup(rows, mining.good_patterns(rows)))


@query()
def collocation_mine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = matching.pattern_rows(tagged_documents(spark, sf_dir), collocation_grammar(), None, "collocation", instances=False)
    return mining.good_patterns(rows)


SPG = """
WITH p AS (SELECT w, array_to_string(w, ' ') AS en FROM (SELECT string_split_regex(trim(text), '\\s+') AS w FROM benchmark) WHERE len(w) >= 3),
r AS (SELECT DISTINCT w[i] AS keyword, array_to_string(w[i:i + 2], ' ') AS run FROM (SELECT w, unnest(range(1, len(w) - 1)) AS i FROM p)),
best AS (SELECT keyword, min(en) AS en FROM r JOIN p ON contains(' ' || en || ' ', ' ' || run || ' ') GROUP BY keyword)"""


@query(f"""{SPG}
SELECT keyword, 1::BIGINT AS keyword_count, 'V sth' AS pattern, 1::BIGINT AS pattern_count, 'x' || keyword || ':V sth' AS ch_pattern, 0.25::DOUBLE AS phrase_prob,
  0.25::DOUBLE AS lex_prob, 0.0625::DOUBLE AS prob, en AS en_phrase, array_to_string(list_transform(string_split(en, ' '), lambda x: 'x' || x), ' ') AS ch_phrase FROM best""")
def spg_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run of three words as an instance of its first word."""
    words = X.tokens(F.col("text"))
    items = read(spark, sf_dir, "benchmark").withColumn("w", words).filter(F.size("w") >= 3)
    tags = F.create_map(F.lit("0"), F.lit("V"), F.lit("2"), F.lit("sth"))
    runs = items.select(F.explode(S.ngrams(F.col("w"), 3)).alias("run")).distinct()
    patterns = runs.select(F.substring_index("run", " ", 1).alias("keyword"), F.lit(1).cast("long").alias("keyword_count"), F.lit("V sth").alias("pattern"), F.lit(1).cast("long").alias("pattern_count"), F.array(F.struct(F.col("run").alias("instance"), tags.alias("tag"))).alias("instances"))
    at = F.transform("w", lambda x, i: F.concat_ws("-", i.cast("string"), i.cast("string")))
    phrases = items.select(F.array_join("w", " ").alias("en"), F.array_join(F.transform("w", lambda x: F.concat(F.lit("x"), x)), " ").alias("ch"), S.align_map(at).alias("aligns"), F.array(*(F.lit(0.5) for _ in range(4))).alias("scores"))
    return projection.ranked(projection.project(patterns, phrases))


@query(f"""{SPG} SELECT ' |||  ||| V sth ||| x' || keyword || ':V sth ||| 0.0625' || chr(10) AS value FROM best""")
def spg_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spg_project(spark, sf_dir).withColumn("sents", F.lit(None).cast("array<array<string>>"))
    return projection.rendered(projection.flattened(projection.nested(rows)))


def part_lines(spark: SparkSession, sf_dir: str, value: Column) -> DataFrame:
    return numbered(read(spark, sf_dir, "part"), "p_partkey").select("line_no", value.alias("value"))


PART_LINES = "l AS (SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS line_no, * FROM part)"


@query(f"WITH {PART_LINES} SELECT line_no, p_name AS value FROM l")
def lines_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "lines")
    L.write_lines(part_lines(spark, sf_dir, F.col("p_name")), path)
    return L.read_lines(spark, path)


@query(f"WITH {PART_LINES} SELECT line_no, p_name AS left, p_brand || chr(9) || p_type AS right FROM l")
def tsv_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.split_two(part_lines(spark, sf_dir, F.concat_ws("\t", "p_name", "p_brand", "p_type")))


@query(f"WITH {PART_LINES} SELECT line_no, p_name || ' ' || p_brand AS text, p_type AS tag FROM l")
def bar_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.split_bar_tags(part_lines(spark, sf_dir, F.concat("p_name", F.lit("\t"), "p_brand", F.lit("|||"), "p_type")))


@query(f"""
WITH {PART_LINES} SELECT line_no, p_type AS en, p_name AS ch, p_size / 4.0::DOUBLE AS third, 0.5::DOUBLE AS first, '1:0 2:0,1' AS aligns FROM l""")
def moses_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = (F.col("p_size") / 4).cast("string")
    rows = part_lines(spark, sf_dir, F.concat("p_name", F.lit(" ||| "), "p_type", F.lit(" ||| "), score, F.lit(" 0.25 0.5 0.75 2.718 ||| 0-1 0-2 1-2 ||| 1 1")))
    out = tables.phrase_table(rows, reverse=True)
    shown = F.array_join(F.transform(F.map_entries("aligns"), lambda e: F.concat_ws(":", e["key"].cast("string"), F.array_join(F.transform(e["value"], lambda v: v.cast("string")), ","))), " ")
    return out.select("line_no", "en", "ch", F.get("scores", F.lit(2)).alias("third"), F.get("scores", F.lit(0)).alias("first"), shown.alias("aligns"))


@query(f"WITH {PART_LINES} SELECT p_brand AS src, p_name AS tgt, p_size / 2.0::DOUBLE AS prob FROM l")
def lexical_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.lexical_table(part_lines(spark, sf_dir, F.concat_ws(" ", "p_brand", "p_name", (F.col("p_size") / 2).cast("string"))))


@query("SELECT p_brand AS keyword, p_size::BIGINT AS keyword_count, p_type AS pattern, p_name AS instance, p_type AS tag FROM part")
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("keyword"), F.col("p_size").cast("long").alias("keyword_count"), F.col("p_type").alias("pattern"), F.lit(1).cast("long").alias("pattern_count"), F.array(F.struct(F.col("p_name").alias("instance"), F.create_map(F.lit("7"), "p_type").alias("tag"))).alias("instances"))
    path = new_path(spark, "json")
    tables.write_json_lines(rows, path)
    return tables.read_json_lines(spark, path).select("keyword", "keyword_count", "pattern", F.explode("instances").alias("i")).select("keyword", "keyword_count", "pattern", "i.instance", F.element_at(tables.int_keys(F.col("i.tag")), 7).alias("tag"))


@query(f"""
WITH {PART_LINES}, w AS (SELECT line_no, p_name, string_split(p_name, ' ') AS w FROM l)
SELECT line_no AS record, p_name AS words, upper(p_name) AS lemmas, array_to_string(list_transform(w, lambda x, i: CASE WHEN i = len(w) THEN 'H-NP' ELSE 'I-NP' END), ' ') AS chunks FROM w""")
def tagger_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A block of word, lemma, tag, chunk, entity lines for each name, then a blank line."""
    rows = numbered(read(spark, sf_dir, "part"), "p_partkey")
    block = F.concat(F.transform(X.tokens(F.col("p_name")), lambda w, i: F.concat_ws("\t", w, F.upper(w), F.lit("NN"), F.when(i == 0, "B-NP").otherwise("I-NP"), F.lit("O"))), F.array(F.lit("")))
    flat = numbered(rows.select("line_no", F.posexplode(block).alias("at", "value")).withColumnRenamed("line_no", "n"), "n", "at").select("line_no", "value")
    return tagged.from_blocks(flat).select("record", *(F.array_join(c, " ").alias(c) for c in ("words", "lemmas", "chunks")))


@query("SELECT p_partkey FROM part WHERE len(string_split(p_name, ' ')) <> len(string_split(p_type, ' '))")
def malformed(spark: SparkSession, sf_dir: str) -> DataFrame:
    words, tags = X.tokens(F.col("p_name")), X.tokens(F.col("p_type"))
    return tagged.malformed(read(spark, sf_dir, "part").select("p_partkey", words.alias("words"), words.alias("lemmas"), tags.alias("poss"), tags.alias("chunks"))).select("p_partkey")


@query("SELECT DISTINCT p_type AS word FROM part")
def vocabulary_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "vocabulary")
    L.write_lines(part_lines(spark, sf_dir, F.concat("p_type", F.lit(" \t"))), path)
    return L.read_vocabulary(spark, path)


@query(f"""
WITH {PART_LINES}, w AS (SELECT replace(p_name, ' ', '_') AS v FROM l)
SELECT v, split_part(v, '_', 1) AS verb, len(string_split(v, '_'))::INTEGER AS n_words, substr(v, strpos(v, '_') + 1) AS rest FROM w""")
def phrasal_verbs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = part_lines(spark, sf_dir, F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit(" ")))
    return L.phrasal_verbs(rows).withColumn("v", F.when(F.col("n_words") > 1, F.concat_ws("_", "verb", "rest")).otherwise(F.col("verb")))


@query("SELECT p_partkey, p_name || chr(9) || p_type AS tab, array_to_string(list_transform(range(1, least(len(a), len(b)) + 1), lambda i: a[i] || '/' || b[i]), ' ') AS slash FROM (SELECT *, string_split(p_name, ' ') AS a, string_split(p_type, ' ') AS b FROM part)")
def output_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("zh_seg"), F.col("p_type").alias("tag"))
    return rows.select("p_partkey", tables.cli_format("tab").alias("tab"), tables.cli_format("/").alias("slash"))


@query(f"WITH {PART_LINES}, n AS (SELECT count(*) // 3 AS g FROM l) SELECT line_no // 3 AS record, string_agg(p_name, '|' ORDER BY line_no) AS v FROM l, n WHERE line_no // 3 < g GROUP BY line_no // 3")
def line_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.groups_of(part_lines(spark, sf_dir, F.col("p_name")), 3).select("record", F.array_join("values", "|").alias("v"))


@query(f"WITH {PART_LINES}, n AS (SELECT count(*) // 3 AS g FROM l) SELECT line_no // 3 AS line_no, CASE line_no % 3 WHEN 0 THEN 'src' ELSE 'tgt' END AS side, p_name AS value FROM l, n WHERE line_no % 3 < 2 AND line_no // 3 < g")
def split_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = lines.split_pairs(part_lines(spark, sf_dir, F.col("p_name")))
    return a.withColumn("side", F.lit("src")).unionByName(b.withColumn("side", F.lit("tgt"))).select("line_no", "side", "value")


@query("SELECT p_partkey, replace(p_name, ' ', '') AS joined, p_type AS bare FROM part")
def separators(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part")
    return rows.select("p_partkey", lines.remove_separator(F.col("p_name")).alias("joined"), lines.strip_stops(F.concat(F.lit("。。"), "p_type", F.lit("。"))).alias("bare"))


@query("SELECT doc_id, text AS numbers, text AS latin FROM documents")
def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return read(spark, sf_dir, "documents").select("doc_id", X.restore(X.mark_numbers(t), X.NUMBER, X.number_originals(t)).alias("numbers"), X.restore(X.mark_latin(t), X.LATIN, X.latin_originals(t)).alias("latin"))


@query("SELECT p_partkey, TRY_CAST(p_name AS DOUBLE) IS NOT NULL AS name, TRY_CAST(p_size || '.5' AS DOUBLE) IS NOT NULL AS size, lower(p_type[1]) || p_type[2:] AS lower FROM part")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", X.is_number(F.col("p_name")).alias("name"), X.is_number(F.concat(F.col("p_size").cast("string"), F.lit(".5"))).alias("size"), X.lower_first(F.col("p_type")).alias("lower"))


@query(f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents)
SELECT doc_id, (list_position(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), w[3] || ' ' || w[4]) - 1)::INTEGER AS "at" FROM d WHERE len(w) >= 4""")
def locate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_words(spark, sf_dir).filter(F.size("words") >= 4)
    return rows.select("doc_id", S.locate_run(F.col("words"), F.slice("words", 3, 2)).alias("at"))


@query("""
WITH c AS (SELECT doc_id, list_filter(regexp_extract_all(replace(text, '.', '。'), '(?:「[^」]*」|[^。！？；])*[。！？；]*'), lambda x: x <> '') AS c FROM documents)
SELECT doc_id, (i - 1)::INTEGER AS "at", c[i] AS sentence FROM c, unnest(range(1, len(c) + 1)) AS r(i)""")
def chinese_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.posexplode(X.chinese_sentences(F.replace("text", F.lit("."), F.lit("。")))).alias("at", "sentence"))


@query("""
WITH t AS (SELECT p_partkey, string_split(p_name || ' ' || p_type || ' ' || p_name, ' ') AS w FROM part), f AS (SELECT p_partkey, i, w[i] AS x FROM t, unnest(range(1, len(w) + 1)) AS r(i)),
n AS (SELECT *, count(*) OVER (PARTITION BY p_partkey, x) AS k, row_number() OVER (PARTITION BY p_partkey, x ORDER BY i) AS j FROM f)
SELECT p_partkey, string_agg(CASE WHEN k > 1 THEN x || j ELSE x END, ' ' ORDER BY i) AS pattern FROM n GROUP BY p_partkey""")
def numbered_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", projection.numbered_pattern(F.concat_ws(" ", "p_name", "p_type", "p_name")).alias("pattern"))


@query("""
WITH e AS (SELECT p_brand AS wordpos, p_type AS pat, p_size::VARCHAR AS iocs, p_name AS example, count(*) AS k FROM part GROUP BY ALL),
i AS (SELECT wordpos, pat, iocs, sum(k)::BIGINT AS iocs_cnt, max(k) AS example_cnt FROM e GROUP BY ALL),
x AS (SELECT i.*, (SELECT min(example) FROM e WHERE e.wordpos = i.wordpos AND e.pat = i.pat AND e.iocs = i.iocs AND e.k = i.example_cnt) AS example,
  row_number() OVER (PARTITION BY wordpos, pat ORDER BY iocs_cnt DESC, iocs)::INTEGER AS rank FROM i)
SELECT wordpos, pat, rank, iocs, iocs_cnt, example, example_cnt FROM x WHERE rank <= 3""")
def top_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "part").select(F.col("p_brand").alias("wordpos"), F.col("p_type").alias("pat"), F.col("p_size").cast("string").alias("iocs"), F.col("p_name").alias("example"))
    return mining.top_instances(rows, rows.select("wordpos", "pat").distinct())


@query(f"""
WITH {ORDERED}, w AS (SELECT line_no, regexp_extract_all(value, '[A-Za-z]+') AS w FROM l), c AS (SELECT word, count(*) AS n FROM (SELECT unnest(w[2:]) AS word FROM w) GROUP BY word),
m AS (SELECT lower(word) AS lower, word AS usual FROM c QUALIFY row_number() OVER (PARTITION BY lower(word) ORDER BY n DESC, word) = 1),
f AS (SELECT line_no, i, w[i] AS x FROM w, unnest(range(1, len(w) + 1)) AS r(i))
SELECT line_no, string_agg(CASE WHEN i = 1 THEN coalesce(usual, x) ELSE x END, ' ' ORDER BY i) AS value FROM f LEFT JOIN m ON lower(x) = m.lower GROUP BY line_no""")
def truecase(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = materialise(conversation_lines(spark, sf_dir).select("line_no", F.regexp_extract_all("value", F.lit("[A-Za-z]+"), F.lit(0)).alias("words")), "lines")
    return counting.truecase(rows, counting.truecase_model(rows), "line_no")


@query()
def grammar_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(buckets_rows(default_grammar()), "keyword string, pattern string, length int, at int, grp string")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
