"""Benchmark passages in training text by spaced seeds.

A seed is a window of tokens of which a fixed mask ignores some places, so that a substituted word at an ignored place
leaves the seed's hash as it is. Hashes of the benchmark's seeds meet those of every window of the training text; a
hit names a document, an item and the shift between them. The two are laid side by side at that shift, and the best
run, one point for an equal token and one off for a substituted one, decides. Of a seed that an item repeats, its first
and last place stand for all; of a place of an item that hits a run of neighbouring windows (a repeated word), the
run's ends do. So repetitive texts give hits in proportion to their length. Items too short for a mask are found whole,
by the hash of all their tokens. Only built-in functions run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import written

MASKS = ("11101101011", "11011010111")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda t: t != "")


def seeds(rows: DataFrame, keys: list[str], masks: tuple[str, ...]) -> DataFrame:
    """keys, mask, pos, seed: one row per window and mask of the token array `t`."""
    def of(mask: str) -> Column:
        places = [i for i, bit in enumerate(mask) if bit == "1"]
        starts = F.when(F.size("t") >= len(mask), F.sequence(F.lit(0), F.size("t") - len(mask))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get("t", i + p) for p in places), F.lit(mask)))

    by_mask = rows.select(*keys, F.posexplode(F.array(*(of(m) for m in masks))).alias("mask", "windows"))
    return by_mask.select(*keys, "mask", F.posexplode("windows").alias("pos", "seed"))


def short_items(items: DataFrame, masks: tuple[str, ...], shortest: int) -> DataFrame:
    """Items (item_id, item) with `shortest` tokens at least that no mask fits."""
    return items.where(F.size("item").between(shortest, min(map(len, masks)) - 1))


def skipped_items(benchmark: DataFrame, shortest: int = 5, item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, n_tokens of the items that `contaminated` does not look for, as they have fewer than `shortest` tokens."""
    rows = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), F.size(tokens(F.col(item_text_col))).alias("n_tokens"))
    return rows.where(F.col("n_tokens") < shortest)


def whole_matches(texts: DataFrame, items: DataFrame, most_items: int) -> DataFrame | None:
    """doc_id, item_id, shift, matched, score: the first place where all tokens of a short item stand; None without such
    items. They are sent to every task if they were counted to be `most_items` at most."""
    counts = {r[0]: r[1] for r in items.groupBy(F.size("item")).count().collect()}  # by length, fewer than a mask's
    if not counts:
        return None

    def windows(n: int) -> Column:
        starts = F.when(F.size("t") >= n, F.sequence(F.lit(0), F.size("t") - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(*(F.get("t", i + j) for j in range(n)), F.lit(n)))

    places = texts.select("doc_id", F.explode(F.array(*map(windows, sorted(counts)))).alias("w")).select("doc_id", F.posexplode("w").alias("shift", "whole"))
    of_item = F.coalesce(*(F.when(F.size("item") == n, F.xxhash64(*(F.get("item", F.lit(j)) for j in range(n)), F.lit(n))) for n in sorted(counts)))
    keys = items.select("item_id", F.size("item").alias("n"), of_item.alias("whole"))
    found = places.join(F.broadcast(keys) if sum(counts.values()) <= most_items else keys, "whole")
    return found.groupBy("doc_id", "item_id", "n").agg(F.min("shift").alias("shift")).select("doc_id", "item_id", "shift", F.col("n").alias("matched"), F.col("n").alias("score"))


def contaminated(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, least: int = 12, shortest: int = 5, most_seeds: int = 2_000_000, id_col: str = "doc_id",
                 text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """doc_id, item_id, shift, matched, score (long): one row per document and item that overlap, the best shift (ties:
    the smallest). The run's score reaches `least` tokens, or the item's length if that is less.

    Items shorter than a mask match where all their tokens stand, the first such place; items with fewer than `shortest`
    tokens are no evidence and match nothing (`skipped_items` lists them). Null and empty texts have no tokens; rows
    without an id are left out; repeated rows of one id give one row. The benchmark's seeds and items are sent to every
    task if they were counted to be at most `most_seeds` rows; a larger benchmark is joined by shuffling.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("long").alias("item_id"), tokens(F.col(item_text_col)).alias("item"))
    repeated = seeds(items.withColumnRenamed("item", "t"), ["item_id"], masks).groupBy("item_id", "seed").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"))
    item_seeds = repeated.select("item_id", "seed", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("item_pos"))
    small = item_seeds.count() <= most_seeds
    bounded = F.broadcast if small else lambda df: df
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), tokens(F.col(text_col)).alias("t"))
    hits = seeds(texts, ["doc_id"], masks).join(bounded(item_seeds), "seed").drop("seed")
    run = Window.partitionBy("doc_id", "item_id", "item_pos", "mask").orderBy("pos")
    inside = (F.col("pos") - F.lag("pos").over(run) == 1) & (F.lead("pos").over(run) - F.col("pos") == 1)
    ends = hits.withColumn("inside", F.coalesce(inside, F.lit(False))).where("NOT inside")
    hits = written(ends.select("doc_id", "item_id", (F.col("pos") - F.col("item_pos")).alias("shift")).distinct(), "hits")
    rows = texts.join(F.broadcast(hits) if hits.count() <= most_seeds else hits, "doc_id").join(bounded(items), "item_id")

    lo_doc, lo_item = F.greatest("shift", F.lit(0)), F.greatest(-F.col("shift"), F.lit(0))
    length = F.least(F.size("t") - lo_doc, F.size("item") - lo_item)
    equal = F.zip_with(F.slice("t", lo_doc + 1, length), F.slice("item", lo_item + 1, length), lambda x, y: F.when(x == y, 1).otherwise(-1))

    def step(best: Column, x: Column) -> Column:
        run = F.greatest(best["run"] + x, F.lit(0))
        return F.struct(run.alias("run"), F.greatest(best["top"], run).alias("top"), (best["matched"] + (x > 0).cast("int")).alias("matched"))

    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("top"), F.lit(0).alias("matched"))
    scored = rows.select("doc_id", "item_id", "shift", F.size("item").alias("n_item"), F.aggregate(equal, start, step).alias("best"))
    scored = scored.where(F.col("best.top") >= F.least(F.lit(least), "n_item"))
    scored = scored.select("doc_id", "item_id", "shift", "best.matched", F.col("best.top").alias("score"))
    whole = whole_matches(texts, short_items(items, masks, shortest), most_seeds)
    order = F.struct("score", (-F.col("shift")).alias("back"), "matched")
    return ((scored if whole is None else scored.unionByName(whole)).groupBy("doc_id", "item_id").agg(F.max(order).alias("top"))
            .select("doc_id", "item_id", (-F.col("top.back")).cast("long").alias("shift"), F.col("top.matched").cast("long").alias("matched"), F.col("top.score").cast("long").alias("score")))


def _seed_sql(table: str, key: str, mask: str) -> str:
    parts = ", ".join(f"t[p + {i}]" for i, bit in enumerate(mask) if bit == "1")
    return f"SELECT {key}, p, '{mask}' AS mask, concat_ws('|', '{mask}', {parts}) AS seed FROM (SELECT {key}, t, unnest(range(1, len(t) - {len(mask)} + 2)) AS p FROM {table})"


TWIN = f"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM documents WHERE doc_id IS NOT NULL),
items AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS t FROM benchmark WHERE item_id IS NOT NULL),
doc_seeds AS ({" UNION ALL ".join(_seed_sql("docs", "doc_id", m) for m in MASKS)}),
item_seeds AS ({" UNION ALL ".join(_seed_sql("items", "item_id", m) for m in MASKS)}),
places AS (SELECT item_id, seed, min(p) AS p FROM item_seeds GROUP BY ALL UNION SELECT item_id, seed, max(p) FROM item_seeds GROUP BY ALL),
found AS (SELECT doc_id, item_id, mask, d.p AS dp, i.p AS ip, d.p - lag(d.p) OVER w AS back, lead(d.p) OVER w - d.p AS ahead FROM doc_seeds d JOIN places i USING (seed)
          WINDOW w AS (PARTITION BY doc_id, item_id, i.p, mask ORDER BY d.p)),
hits AS (SELECT DISTINCT doc_id, item_id, dp - ip AS shift FROM found WHERE coalesce(back, 0) <> 1 OR coalesce(ahead, 0) <> 1),
side AS (SELECT doc_id, item_id, shift, len(i.t) AS n_item, d.t AS dt, i.t AS it, unnest(range(greatest(shift, 0) + 1, least(len(d.t), len(i.t) + shift) + 1)) AS p
         FROM hits JOIN docs d USING (doc_id) JOIN items i USING (item_id)),
marks AS (SELECT doc_id, item_id, shift, n_item, p, CASE WHEN dt[p] = it[p - shift] THEN 1 ELSE -1 END AS x FROM side),
sums AS (SELECT *, sum(x) OVER w AS s FROM marks WINDOW w AS (PARTITION BY doc_id, item_id, shift ORDER BY p)),
runs AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id, item_id, shift ORDER BY p)) AS run FROM sums),
short AS (SELECT item_id, t, len(t) AS n FROM items WHERE len(t) BETWEEN 5 AND 10),
whole AS (SELECT doc_id, item_id, min(p) AS shift, n FROM (SELECT doc_id, s.item_id, s.n, s.t AS it, d.t AS dt, unnest(range(0, len(d.t) - s.n + 1)) AS p FROM docs d, short s)
          WHERE dt[p + 1 : p + n] = it GROUP BY ALL),
scores AS (SELECT doc_id, item_id, shift, n_item, max(run) AS score, count(*) FILTER (x = 1) AS matched FROM runs GROUP BY ALL
           UNION ALL SELECT doc_id, item_id, shift, n, n, n FROM whole),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY score DESC, shift) AS r FROM scores WHERE score >= least(12, n_item))
SELECT doc_id, item_id, shift::BIGINT AS shift, matched::BIGINT AS matched, score::BIGINT AS score FROM ranked WHERE r = 1
"""
