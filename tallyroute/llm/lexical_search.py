"""Ranked lexical search of benchmark items over all documents, scored once per bag class.

Scoring (integer BM25 variant, the fixed formula of the contract):

* terms: maximal runs of ASCII letters and digits and of any non-ASCII code point, only A-Z
  lower-cased; a null text has none;
* N: documents with at least one term; L: all their terms, repeats counted; n: a document's terms;
  df: documents holding the term; tf: its occurrences in the document;
* w = floor(1000 * ln((2N + 2) / (2 df + 1))) in doubles, everything else 64-bit integers;
* m = 50 + (50 n N) div L;
* score = sum over the item's distinct terms of w * ((10^9 tf) div (1000 tf + 20 m)).

Method, bag deduplication: a document's score for any item depends only on its term counts
restricted to the vocabulary of all items and on m. Documents are cut down to that vocabulary,
their (tf vector, m) is hashed, and the hash is verified: every hash group must hold one vector
(checked by one aggregate, min = max); on a collision the key widens to two hashes. Each class is
scored once per item; the 50 best classes per item by (score, smallest doc_id) are the only ones
that can hold a top-50 document, and each of them gives at most its 50 smallest doc_ids.

Scale: the vocabulary is joined by broadcast only under `MAX_BROADCAST_ROWS`, else by a shuffle
join; term counts are taken inside each row before any row is exploded; per-item and per-class
top-50 cuts are `row_number` windows that Spark limits in each map task before the shuffle, so a
hot item or a class of a third of all rows is cut to 50 rows a task.

Edge cases: null or empty texts have no terms (counted neither in N nor L, never returned); a
null doc_id is a document like any other and sorts after all ids at equal score; repeated rows are
separate documents (both counted, both returned); rows of benchmark sharing an item_id are one
item whose terms are the union; a null benchmark text has no terms; empty tables give no rows;
extra columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyroute.llm.common import let, stored, with_row
from tallyroute.plans.sizing import MAX_BROADCAST_ROWS

# Fixed values of the contract.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
TOP = 50
SEED = 42


def terms(text: Column) -> Column:
    """Terms of a text, in order, repeats kept; empty for null."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), 0)


def _term_counts(t: Column) -> Column:
    """array<struct<term, tf>> of the distinct terms of an array, sorted, from one in-row sort."""
    empty = F.array().cast("array<struct<term: string, tf: bigint>>")

    def counted(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))).otherwise(
            F.array().cast("array<int>")
        )
        first = F.filter(places, lambda i: (i == 1) | (F.try_element_at(s, i) != F.try_element_at(s, i - 1)))
        return let(
            first,
            lambda b: F.when(F.size(b) == 0, empty).otherwise(
                F.transform(
                    b,
                    lambda at, j: F.struct(
                        F.element_at(s, at).alias("term"),
                        (F.coalesce(F.try_element_at(b, j + 2), F.size(s) + 1) - at)
                        .cast("long")
                        .alias("tf"),
                    ),
                )
            ),
        )

    return let(F.sort_array(t), counted)


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= MAX_BROADCAST_ROWS else df


def search(docs: DataFrame, benchmark: DataFrame, top: int = TOP) -> DataFrame:
    """Each item's `top` best documents with score above 0: item_id, rank, doc_id, score."""
    row = "_lex_row"
    items = (
        benchmark.select(F.col("item_id").cast("long").alias("item_id"), terms(F.col("text")).alias("t"))
        .select("item_id", F.explode(F.array_distinct("t")).alias("term"))
        .distinct()
    )
    items = stored(items, "lexical-items")
    vocab = items.select("term").distinct().withColumn("_in", F.lit(True))
    n_vocab = vocab.count()

    # Every text is read and cut into terms once: one stored row per document with n and its
    # counts of vocabulary terms (empty when it holds none), gathered per document before the shuffle.
    counted = with_row(docs.select("doc_id", "text"), row).select(
        F.col(row), F.col("doc_id").cast("long").alias("doc_id"), terms(F.col("text")).alias("t")
    )
    pairs = counted.select(
        row, "doc_id", F.size("t").cast("long").alias("n"), F.posexplode_outer(_term_counts(F.col("t"))).alias("at", "p")
    )
    # Each document keeps its first pair, in the vocabulary or not: n counts without a match.
    bags = stored(
        pairs.join(_small(vocab, n_vocab), F.col("p.term") == F.col("term"), "left")
        .filter(F.col("_in").isNotNull() | (F.coalesce("at", F.lit(0)) == 0))
        .groupBy(row, "doc_id", "n")
        .agg(F.sort_array(F.collect_list(F.when(F.col("_in"), F.col("p")))).alias("vec")),
        "lexical-bags",
    )
    totals = bags.agg(
        F.count(F.when(F.col("n") > 0, 1)).alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")
    ).first()
    big_n, big_l = int(totals["N"]), int(totals["L"])
    if big_n == 0 or n_vocab == 0:
        return _empty(docs)

    df_of = bags.select(F.explode("vec").alias("p")).groupBy(F.col("p.term").alias("term")).agg(
        F.count(F.lit(1)).alias("df")
    )
    weights = stored(
        items.join(df_of, "term").select(
            "item_id",
            "term",
            F.floor(
                F.lit(1000.0) * F.log((2.0 * big_n + 2.0) / (2.0 * F.col("df").cast("double") + 1.0))
            )
            .cast("long")
            .alias("w"),
        ),
        "lexical-weights",
    )
    n_weights = weights.count()
    m = F.lit(50) + F.expr(f"(50 * n * {big_n}L) div {big_l}L")
    bags = bags.filter(F.size("vec") > 0).select(row, "doc_id", m.alias("m"), "vec")

    bags, keys, classes = _classes(bags)
    scored = (
        classes.select(*keys, "m", "size", "first_id", F.explode("vec").alias("p"))
        .select(*keys, "m", "size", "first_id", F.col("p.term").alias("term"), F.col("p.tf").alias("tf"))
        .join(_small(weights, n_weights), "term")
        .groupBy("item_id", *keys, "first_id")
        .agg(
            F.sum(
                F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 20L * m)")
            ).alias("score")
        )
        .filter("score > 0")
    )
    best_classes = F.row_number().over(
        _by("item_id").orderBy(
            F.desc("score"), F.asc_nulls_last("first_id"), *[F.asc(k) for k in keys]
        )
    )
    top_classes = stored(
        scored.withColumn("_r", best_classes).filter(F.col("_r") <= top).drop("_r"),
        "lexical-top-classes",
    )
    n_top = top_classes.count()
    wanted = top_classes.select(*keys).distinct()
    first_members = F.row_number().over(
        _by(*keys).orderBy(F.asc_nulls_last("doc_id"), F.asc(row))
    )
    members = (
        bags.select(row, "doc_id", *_key_columns(keys))
        .join(_small(wanted, n_top), keys, "left_semi")
        .withColumn("_r", first_members)
        .filter(F.col("_r") <= top)
        .select(*keys, row, "doc_id")
    )
    ranked = F.row_number().over(
        _by("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), F.asc(row))
    )
    return (
        top_classes.select("item_id", *keys, "score")
        .join(members, keys)
        .withColumn("rank", ranked.cast("int"))
        .filter(F.col("rank") <= top)
        .select("item_id", "rank", "doc_id", F.col("score").cast("long").alias("score"))
    )


def _by(*cols: str):
    from pyspark.sql import Window

    return Window.partitionBy(*cols)


def _key_columns(keys: list[str]) -> list[Column]:
    return [F.col(k) for k in keys]


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "m", "vec")


def _classes(bags: DataFrame) -> tuple[DataFrame, list[str], DataFrame]:
    """Bags keyed by hashes of (m, vec), verified to hold one vector a key; widened on collision."""
    keys: list[str] = []
    seed = SEED
    while True:
        name = f"_h{len(keys)}"
        bags = bags.withColumn(name, _hash(seed))
        keys.append(name)
        whole = F.struct("m", "vec")
        classes = stored(
            bags.groupBy(*keys).agg(
                F.count(F.lit(1)).alias("size"),
                F.min("doc_id").alias("first_id"),
                F.min(whole).alias("_lo"),
                F.max(whole).alias("_hi"),
            ),
            "lexical-classes",
        )
        if classes.filter(F.col("_lo") != F.col("_hi")).limit(1).count() == 0:
            classes = classes.select(
                *keys, "size", "first_id", F.col("_lo.m").alias("m"), F.col("_lo.vec").alias("vec")
            )
            return bags, keys, classes
        seed += 1


def _empty(docs: DataFrame) -> DataFrame:
    spark = docs.sparkSession
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")


ORACLE = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, CAST(doc_id AS BIGINT) AS doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS t
  FROM documents
), dn AS (SELECT rid, doc_id, t, CAST(len(t) AS BIGINT) AS n FROM d),
tot AS (SELECT CAST(count(*) FILTER (WHERE n > 0) AS BIGINT) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM dn),
it AS (
  SELECT DISTINCT CAST(item_id AS BIGINT) AS item_id, unnest(regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark
), occ AS (SELECT rid, unnest(t) AS term FROM dn),
tf AS (
  SELECT rid, term, CAST(count(*) AS BIGINT) AS tf FROM occ
  WHERE term IN (SELECT term FROM it) GROUP BY rid, term
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (
  SELECT it.item_id, it.term,
    CAST(floor(1000 * ln((2.0 * tot.big_n + 2) / (2.0 * df.df + 1))) AS BIGINT) AS w
  FROM it JOIN df ON it.term = df.term CROSS JOIN tot
), m AS (
  SELECT rid, doc_id, 50 + (50 * n * tot.big_n) // tot.big_l AS m FROM dn CROSS JOIN tot WHERE n > 0
), s AS (
  SELECT w.item_id, m.rid, m.doc_id,
    CAST(sum(w.w * ((1000000000 * tf.tf) // (1000 * tf.tf + 20 * m.m))) AS BIGINT) AS score
  FROM tf JOIN m ON tf.rid = m.rid JOIN w ON w.term = tf.term
  GROUP BY w.item_id, m.rid, m.doc_id
), r AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank
  FROM s WHERE score > 0
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= 50
"""
