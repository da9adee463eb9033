"""Spelling variants by an even-partition pigeonhole join.

Words are runs of Latin letters that come often enough. A word of length l is cut evenly into two segments, of l // 2 code points and of the rest; one edit leaves
one of them whole. So each word is indexed under (its length, which segment, the segment), and each word of the same length or one longer probes with the
substrings that stand where an edit of the other half would leave them: its start, and its end shifted by the difference of the lengths. Pairs that meet are
verified (exactly one edit between what is left of both) and, as an insertion at the cut is found by both segments, taken once.

A segment that more than `FEW` words of one length share is hot: their pairs aren't formed, but what is left of these words is cut evenly again, by the same
rule, until few share a segment or one code point is left; then all that share it are near each other, and there are no more of them than letters.
So no group's pairs are formed that aren't nearly all results, and no word or pair is dropped. Words with many near words are met by partial aggregates.

A word's form is its most frequent near word, if that is `FACTOR` times as frequent; roots follow forms by pointer doubling, in as many rounds as the logarithm
of the longest chain, which is itself no longer than the logarithm of the largest count.

Null or empty text has no word. A null doc_id counts as an empty string where `<doc_id>:<run>` is hashed. Repeated rows count again. Ties between equally
frequent near words go to the smaller in code-point order. Words of any length are treated alike. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, forget, pick, written

RUN = "[A-Za-zÀ-ÿ]"
LEAST_CHARS, LEAST_COUNT, FACTOR = 6, 5, 5
#: A run whose hash this number divides loses one code point.
SPOILT = 199
#: Words of one length that may share a segment before what is left of them is cut again.
FEW = 32
#: Longer rests are compared by the length of their common start: counting edits takes the square of the length.
LONG = 64


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of all words of `docs`."""
    texts = pick(docs, doc_id="long", text="string")
    runs = texts.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"{RUN}{{{least_chars},}}"), F.lit(0))).alias("run"))
    named = runs.select("doc_id", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run").cast("binary"))
    at = (F.col("h") % F.char_length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
    words = named.withColumn("h", h).select(F.when(F.col("h") % SPOILT == 0, cut).otherwise(F.col("run")).alias("word"))
    return words.filter(F.char_length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= least_count)


def _classes(words: DataFrame) -> DataFrame:
    """(key, longer, m, word, n, rest): each word in the class of its length, and as the longer one in the class of one less; m is the length that the rest of
    the shorter words of a class has."""
    size = F.char_length("word")
    both = F.array(F.struct(size.alias("m"), F.lit(False).alias("longer")), F.struct((size - 1).alias("m"), F.lit(True).alias("longer")))
    rows = words.select("word", "n", F.explode(both).alias("c"))
    return rows.select(F.col("c.m").cast("string").alias("key"), "c.longer", "c.m", "word", "n", F.col("word").alias("rest"))


def _cut(rows: DataFrame) -> DataFrame:
    """Each row under its two segments, with what is left of it beside them. A longer word's second segment is shifted by one."""
    half, m = F.floor(F.col("m") / 2).cast("int"), F.col("m")
    after = half + F.col("longer").cast("int")
    rest = lambda start, count: F.substring("rest", start, count)
    first = F.struct(F.concat("key", F.lit("<"), rest(F.lit(1), half)).alias("key"), (m - half).alias("m"), rest(half + 1, m + 1).alias("rest"))
    second = F.struct(F.concat("key", F.lit(">"), rest(after + 1, m + 1)).alias("key"), half.alias("m"), rest(F.lit(1), after).alias("rest"))
    return rows.select("longer", "word", "n", F.explode(F.array(first, second)).alias("c")).select("c.key", "longer", "c.m", "word", "n", "c.rest")


def _one_edit(a: Column, b: Column, longer: Column) -> Column:
    """Whether different a and b, of which b is the longer by one or neither is, are one edit apart."""
    start = F.aggregate(
        F.array(*(F.lit(1 << k) for k in range(30, -1, -1))), F.lit(0),
        lambda have, k: F.when(F.substring(a, F.lit(1), have + k) == F.substring(b, F.lit(1), have + k), have + k).otherwise(have),
    )
    after = lambda c, skip: F.substring(c, start + 1 + skip, F.char_length(b))
    return F.when(F.char_length(a) <= LONG, F.levenshtein(a, b, 1) == 1).otherwise(after(a, F.when(longer, 0).otherwise(1)) == after(b, F.lit(1)))


def near_pairs(words: DataFrame, few: int = FEW) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of different `words` (word, n) that are one edit apart, each once."""
    rows, found = _classes(words), None
    while True:
        rows = written(_cut(rows), "spelling-segments")
        met = rows.groupBy("key").agg(F.count_if(~F.col("longer")).alias("indexed"), F.max("m").alias("m"))
        hot = written(met.filter((F.col("indexed") > few) & (F.col("m") > 1)).select("key", F.lit(True).alias("hot")), "spelling-hot")
        more = hot.count()
        told = rows.join(hot, "key", "left") if more else rows.withColumn("hot", F.lit(None).cast("boolean"))
        cool = told.filter(F.col("hot").isNull())
        one = cool.filter(~F.col("longer")).select("key", F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("rest").alias("a_rest"))
        other = cool.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("rest").alias("b_rest"))
        near = (F.col("longer") | (F.col("a") < F.col("b"))) & _one_edit(F.col("a_rest"), F.col("b_rest"), F.col("longer"))
        pairs = one.join(other, "key").filter(near).select("a", "a_n", "b", "b_n")
        found = pairs if found is None else found.unionAll(pairs)
        if not more:
            return found.distinct()
        rows = told.filter("hot").drop("hot")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form: (word, root) with root the form, followed to the last."""
    now = written(links, "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = written(now.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        forget(now)
        moved = after.filter("moved").count()
        now = after.drop("moved")
        now._quill_path = after._quill_path
        if not moved:
            return now


def variants(words: DataFrame, factor: int = FACTOR, few: int = FEW) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of `words` (word, n)."""
    words = written(words, "spelling-words")
    pairs = near_pairs(words, few)
    side = lambda a, b: F.struct(F.col(a).alias("word"), F.col(b).alias("near"), F.col(f"{b}_n").alias("near_n"))
    both = pairs.select(F.explode(F.array(side("a", "b"), side("b", "a"))).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    joined = words.join(best, "word", "left")
    good = -F.col("best.less") >= factor * F.col("n")
    told = written(
        joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")),
        "spelling-forms",
    )
    roots = _roots(told.filter(F.col("form").isNotNull()).select("word", F.col("form").alias("root")))
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(spark.read.parquet(f"{sf_dir}/documents.parquet")))


#: The checksum's table is built by its rule; near words meet over a word less one code point, or with one code point left open.
OP11_SQL = rf"""
WITH c AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(3988292384, x >> 1) ELSE x >> 1 END) AS v FROM range(256) r(i))),
l AS (SELECT doc_id, translate(unnest(regexp_extract_all("text", '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), '{UPPER}', '{LOWER}') AS run FROM documents),
g AS (SELECT doc_id, run, count(*) AS k, hex(encode(doc_id || ':' || run)) AS x FROM l WHERE length(run) >= {LEAST_CHARS} GROUP BY 1, 2),
h AS (SELECT run, k, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
        lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h FROM g, c),
w AS (SELECT CASE WHEN h % {SPOILT} = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, CAST(sum(k) AS BIGINT) AS n
      FROM h GROUP BY 1 HAVING length(word) >= {LEAST_CHARS} AND sum(k) >= {LEAST_COUNT}),
p AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS less FROM w, LATERAL unnest(range(length(word))) u(i)),
q AS (SELECT a.word, b.word AS near, b.n AS m FROM p a JOIN p b ON a.less = b.less AND a.i = b.i AND a.word <> b.word
      UNION SELECT a.word, b.word, b.n FROM p a JOIN w b ON a.less = b.word UNION SELECT b.word, a.word, a.n FROM p a JOIN w b ON a.less = b.word),
f AS (SELECT word, count(*) AS n_near, max(m) AS m, arg_min(near, (-m, near)) AS near FROM q GROUP BY 1),
r AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= {FACTOR} * w.n THEN near END AS form, CASE WHEN m >= {FACTOR} * w.n THEN m END AS form_n FROM w LEFT JOIN f ON f.word = w.word),
s AS (WITH RECURSIVE s(word, root) AS (SELECT word, word FROM r UNION ALL SELECT s.word, r.form FROM s JOIN r ON r.word = s.root WHERE r.form IS NOT NULL) SELECT s.word, root FROM s JOIN r ON r.word = root WHERE r.form IS NULL)
SELECT r.word, form, root, n, n_near, form_n FROM r JOIN s ON s.word = r.word
"""
