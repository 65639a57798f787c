"""Benchmark decontamination as a prefix-filtered set join over word shingles, in DataFrame expressions only.

A window is a run of ``WINDOW`` consecutive item words (a shorter item is one
window). Its shingles are its runs of ``SHINGLE`` words. One pass over the
documents keeps the places of all shingles that occur in any item; from them come
the shingles' counts over the whole corpus, which order each window's shingles by
rarity. As a window must occur whole, its prefix is one token: its rarest shingle.
Joining it gives start positions, bounded by the document's length; a window is
confirmed when each of its shingles stands, word for word, at its place.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .storage import bounded_broadcast, stash

WINDOW = 10
SHINGLE = 3
#: Shingles of all items that are broadcast at most (about 60 bytes each); beyond, the join is a shuffled one.
BROADCAST_SHINGLES = 500_000


def words(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, runs of digits, letters and whatever is not ASCII."""
    lowered = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _inner(w: Column) -> tuple[Column, Column]:
    """Of the result of ``words``: index of the first word, and their number; a separator at an end leaves an empty string there."""
    first = F.when(F.element_at(w, 1) == "", 1).otherwise(0)
    end = F.size(w) - F.when((F.size(w) > 1) & (F.element_at(w, -1) == ""), 1).otherwise(0)
    return first, F.greatest(end - first, F.lit(0))


def _gram(w: Column, at: Column, n: int) -> Column:
    return F.concat_ws(" ", *[F.get(w, at + k) for k in range(n)])


def item_windows(benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """(item_id, window_id, len, n, off, gram): every shingle of every window of every item; items without words have none."""
    w = F.col("w")
    clean = benchmark.select("item_id", words(F.col("text")).alias("w")).withColumns({"f": _inner(w)[0], "m": _inner(w)[1]}).where("m > 0")
    clean = clean.select("item_id", F.slice(w, F.col("f") + 1, F.col("m")).alias("w"), "m")
    runs = clean.withColumn("len", F.least("m", F.lit(window))).select("item_id", "w", "len", F.explode(F.sequence(F.lit(0), F.col("m") - F.col("len"))).alias("at"))
    runs = runs.select("item_id", F.slice(F.col("w"), F.col("at") + 1, F.col("len")).alias("win"), "len").distinct()
    n = F.least("len", F.lit(shingle))
    return (
        runs.select("item_id", F.array_join("win", " ").alias("window_id"), "win", "len", n.alias("n"))
        .select("*", F.explode(F.sequence(F.lit(0), F.col("len") - F.col("n"))).alias("off"))
        .select("item_id", "window_id", "len", "n", "off", F.array_join(F.slice("win", F.col("off") + 1, F.col("n")), " ").alias("gram"))
    )


def _places(docs: DataFrame, grams: DataFrame, sizes: dict[int, int]) -> DataFrame:
    """(rid, doc_id, n_words, pos, gram, n) of every place of a known shingle of ``sizes`` words, and a row of null gram for every document.

    All lengths are looked up in one pass over ``docs``, so that a document has one rid.
    """
    w = F.col("w")
    first, size = _inner(w)
    base = docs.select("rid", "doc_id", words(F.col("text")).alias("w")).withColumns({"f": first, "n_words": size})
    here = lambda n: F.xxhash64(*[F.get(w, F.col("pos") + k) for k in range(n)])
    spread = base.select("rid", "doc_id", "n_words", "f", "w", F.posexplode("w").alias("pos", "word"))
    if len(sizes) == 1:
        (only,) = sizes
        spread = spread.withColumns({"n": F.lit(only), "h": here(only)})
    else:
        spread = spread.withColumn("x", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), here(n).alias("h")) for n in sorted(sizes)]))).withColumns({"n": F.col("x.n"), "h": F.col("x.h")}).drop("x")
    own = F.lit(None).cast("long")
    for n in sorted(sizes):
        parts = F.split("gram", " ")
        own = F.when(F.col("n") == n, F.xxhash64(*[parts[k] for k in range(n)])).otherwise(own)
    known = bounded_broadcast(grams.select(own.alias("h"), "n", F.col("gram").alias("known")), sum(sizes.values()), BROADCAST_SHINGLES)
    met = spread.join(known, ["h", "n"], "left")
    same = F.lit(False)
    for n in sorted(sizes):
        same = F.when(F.col("n") == n, F.col("known") == _gram(w, F.col("pos"), n)).otherwise(same)
    here = (F.col("pos") >= F.col("f")) & (F.col("pos") + F.col("n") <= F.col("f") + F.col("n_words")) & same
    met = met.where(F.col("known").isNotNull() | (F.col("pos") == 0))
    return met.select("rid", "doc_id", F.col("n_words").cast("long"), (F.col("pos") - F.col("f")).alias("pos"), F.when(here, F.col("known")).alias("gram"), (F.col("pos") == 0).alias("head"), "n")


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """One row per row of ``documents`` (doc_id, text): n_words, n_hit, n_items, items_sha256, contaminated.

    Null or empty texts have no words and are clean; a null or wordless item has
    no window. Repeated documents and ids keep a row each, repeated items of one
    id count once, items of null id are counted as the item ''. An empty
    benchmark leaves all documents clean; an empty table gives an empty result.
    Other columns are ignored.
    """
    items = stash(item_windows(benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text"), window, shingle), "windows")
    sizes = {r["n"]: r["c"] for r in items.groupBy("n").agg(F.count_distinct("gram").alias("c")).collect()} or {shingle: 0}
    docs = documents.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    places = stash(_places(docs, items.select("gram", "n").distinct(), sizes), "places")
    heads = places.where(F.col("head") & (F.col("n") == min(sizes))).select("rid", "doc_id", "n_words").dropDuplicates(["rid"])
    hits = places.where("gram is not null").select("rid", "n_words", "pos", "gram", "n").distinct()

    rarity = hits.groupBy("n", "gram").agg(F.count(F.lit(1)).alias("corpus"))
    rare = Window.partitionBy("item_id", "window_id").orderBy("corpus", "gram", "off")
    # A window that has a shingle without any place in the corpus cannot occur: the inner join leaves fewer shingles than it has.
    known = items.join(rarity, ["n", "gram"]).withColumn("have", F.count(F.lit(1)).over(Window.partitionBy("item_id", "window_id"))).where("have = len - n + 1")
    prefix = known.withColumn("rank", F.row_number().over(rare)).where("rank = 1").select("item_id", "window_id", "len", "n", "gram", "off")
    starts = (
        hits.join(prefix, ["n", "gram"])
        .withColumn("start", F.col("pos") - F.col("off"))
        .where("start >= 0 and start + len <= n_words")
        .select("rid", "item_id", "window_id", "len", "n", "start")
    )
    # Verification asks once for each place and window, however many items have it.
    asked = starts.select("rid", "window_id", "len", "n", "start").distinct()
    grams = items.select("window_id", "off", "gram").distinct()
    confirmed = (
        asked.join(grams, "window_id")
        .withColumn("pos", F.col("start") + F.col("off"))
        .join(hits.select("rid", "pos", "gram", "n"), ["rid", "pos", "gram", "n"], "left_semi")
        .groupBy("rid", "window_id", "len", "n", "start")
        .agg(F.count(F.lit(1)).alias("met"))
        .where("met = len - n + 1")
        .select("rid", "window_id", "len", "start")
    )
    confirmed = stash(confirmed, "confirmed")
    covered = confirmed.select("rid", F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("pos")).distinct().groupBy("rid").agg(F.count(F.lit(1)).alias("n_hit"))
    named = (
        confirmed.select("rid", "window_id").distinct().join(items.select("window_id", "item_id").distinct(), "window_id").select("rid", "item_id").distinct()
        .groupBy("rid").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item_id")), ",").alias("ids"))
    )
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return (
        heads.join(covered, "rid", "left")
        .join(named, "rid", "left")
        .select(
            "doc_id",
            "n_words",
            n_hit.alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
            F.sha2(F.coalesce("ids", F.lit("")), 256).alias("items_sha256"),
            (n_hit > 0).alias("contaminated"),
        )
    )


ORACLE = r"""
with iw as (
  select cast(item_id as varchar) as item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark
), win as (
  select distinct item_id, least(len(w), 10) as m, array_to_string(list_slice(w, i, i + least(len(w), 10) - 1), ' ') as g
  from (select item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) as i from iw where len(w) > 0)
), dw as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from documents
), dg as (
  select doc_id, m, i, array_to_string(list_slice(w, i, i + m - 1), ' ') as g
  from (select doc_id, w, m, unnest(range(1, len(w) - m + 2)) as i from dw, (select distinct m from win) where len(w) >= m)
), hit as (
  select dg.doc_id, win.item_id, dg.i, dg.m from dg join win using (m, g)
), cov as (
  select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + m)) as p from hit) group by doc_id
), its as (
  select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids from (select distinct doc_id, item_id from hit) group by doc_id
)
select dw.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join cov using (doc_id) left join its using (doc_id)
"""
