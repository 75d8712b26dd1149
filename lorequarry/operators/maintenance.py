"""Upkeep of a chunk store: change detection, resume joins, scans for broken or sensitive chunks, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

SECRET = r"AKIA[0-9A-Z]{16}|(?i:password|passwd|token|secret|api_key)\s*[=:]\s*\S{6,}"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"
INTERNAL_URL = r"https?://(?:localhost|[A-Za-z0-9.-]+\.(?:internal|local|corp))(?:[:/]\S*)?"


def not_yet(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys aren't done."""
    return rows.join(done.select(*keys), keys, "left_anti")


def not_contextualized(chunks: DataFrame, contexts: DataFrame) -> DataFrame:
    """Chunks without a context; an empty one counts as missing."""
    return not_yet(chunks, contexts.filter("context <> ''"), ["source_id", "chunk_index"])


def merge_contexts(old: DataFrame, new: DataFrame, keys: list[str], value: str = "context") -> DataFrame:
    """Values of both, new ones winning."""
    n = new.select(*keys, F.col(value).alias("_new"))
    o = old.select(*keys, F.col(value).alias("_old"))
    return o.join(n, keys, "full_outer").select(*keys, F.coalesce("_new", "_old").alias(value))


def changes(old: DataFrame, new: DataFrame, key: str, text: str) -> DataFrame:
    """(key, change): added, removed, changed or same, by content hash."""
    o = old.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("_old"))
    n = new.select(key, F.sha2(F.coalesce(text, F.lit("")), 256).alias("_new"))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(F.col("_old") != F.col("_new"), "changed").otherwise("same")
    return o.join(n, key, "full_outer").select(key, kind.alias("change"))


def orphan_flags(content: Column, heading_path: Column) -> dict[str, Column]:
    """Signs that a chunk lost its surroundings."""
    return {
        "mid_sentence": F.trim(content).rlike(r"^[a-z,;)]"),
        "headless_rows": F.lower(content).rlike(r"(?s)^\s*<tr\b") | (F.contains(F.lower(content), F.lit("<table")) & ~F.contains(F.lower(content), F.lit("<th"))),
        "no_heading": F.coalesce(F.size(heading_path), F.lit(0)) <= 0,
    }


def has_secret(text: Column) -> Column:
    return F.coalesce(text.rlike(SECRET), F.lit(False))


def redact(text: Column) -> Column:
    """Text with secrets, e-mail addresses and internal addresses masked."""
    text = F.regexp_replace(text, SECRET, "[secret]")
    return F.regexp_replace(F.regexp_replace(text, EMAIL, "[email]"), INTERNAL_URL, "[url]")


def is_blob(content: Column, limit: int = 200) -> Column:
    """Whether content holds an unbroken run longer than limit characters, as encoded data does."""
    return F.coalesce(content.rlike(rf"\S{{{limit + 1},}}"), F.lit(False))


def is_image_only(html: Column) -> Column:
    """Whether markup holds an image and no text."""
    bare = F.trim(F.regexp_replace(F.coalesce(html, F.lit("")), "(?s)<[^>]*>", ""))
    return F.lower(F.coalesce(html, F.lit(""))).rlike(r"<img\b") & (bare == "")


def is_noise(text: Column, min_words: int = 3) -> Column:
    """Messages that carry nothing: too short, or thanks and greetings only."""
    return (F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")) < min_words) | F.lower(F.trim(text)).rlike(r"^(thanks|thank you|hi|hello|ok|okay)\b.{0,20}$")


def distinct_results(hits: DataFrame, text: str) -> DataFrame:
    """Of hits of a query with equal text, the best."""
    order = Window.partitionBy("query_id", F.md5(F.coalesce(text, F.lit("")))).orderBy("rank")
    return hits.withColumn("_row", F.row_number().over(order)).filter("_row = 1").drop("_row")


def dissimilar_results(hits: DataFrame, text: str, threshold: float = 0.8) -> DataFrame:
    """Hits of each query in the order of their rank, without those whose word set is as similar (Jaccard) as the threshold to one kept before.

    A query's hits are a result list, so they are gathered: as many as were asked for.
    """
    words = F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"))
    listed = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", words.alias("words")))).alias("hits"))

    def close(a: Column, b: Column) -> Column:
        same = F.size(F.array_intersect(a["words"], b["words"]))
        return same >= threshold * (F.size(a["words"]) + F.size(b["words"]) - same)

    kept = F.aggregate("hits", F.slice("hits", F.lit(1), F.lit(0)), lambda done, h: F.when(F.exists(done, lambda d: close(d, h)), done).otherwise(F.array_append(done, h)))
    return hits.join(listed.select("query_id", F.explode(F.transform(kept, lambda k: k["rank"])).alias("rank")), ["query_id", "rank"], "left_semi")


def neighbours(hits: DataFrame, chunks: DataFrame, reach: int = 1) -> DataFrame:
    """Hits (query_id, document_id, chunk_index) with the chunks up to reach places around them, each once."""
    around = hits.select("query_id", "document_id", F.explode(F.sequence(F.col("chunk_index") - reach, F.col("chunk_index") + reach)).alias("chunk_index")).distinct()
    return around.join(chunks, ["document_id", "chunk_index"])


def table_summaries(rows: DataFrame, table_id: str, columns: list[str]) -> DataFrame:
    """One describing chunk per table, with its row count and columns, linked to its rows by table id."""
    text = F.concat(F.lit("Table with "), F.count("*").cast("string"), F.lit(" rows and columns " + ", ".join(columns) + "."))
    return rows.groupBy(F.col(table_id).alias("parent_table_id")).agg(text.alias("content"), F.count("*").alias("n_rows"))


def with_previous_sentence(chunks: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """Chunks with the last sentence of the one before them in the document."""
    last = F.regexp_extract(F.trim(F.col(content)), r"([^.!?]*[.!?]?)$", 1)
    return chunks.withColumn("previous_sentence", F.coalesce(F.lag(F.trim(last)).over(Window.partitionBy(key).orderBy(order)), F.lit("")))


def explicit_links(docs: DataFrame, key: str, links: str) -> DataFrame:
    """(key, target, mutual): stated links, and whether the target links back."""
    stated = docs.select(key, F.explode(links).alias("target")).distinct()
    back = stated.select(F.col("target").alias(key), F.col(key).alias("target"), F.lit(True).alias("mutual"))
    return stated.join(back, [key, "target"], "left").fillna(False, ["mutual"])


#: Titles with a word among their rarest that a task compares with as many others.
TITLES_AT_ONCE = 2_000
#: Ids of equal titles in a block, about; a task makes and holds the pairs of two blocks at once.
BLOCK_IDS = 128


def title_words(title: Column) -> Column:
    """The distinct words of a title in lower case, sorted."""
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(F.coalesce(title, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")))


def title_classes(docs: DataFrame, key: str, title: str) -> DataFrame:
    """(id, class_id, words): documents whose titles have the same words are a class, named by its smallest id; titles without words have none."""
    words = docs.select(F.col(key).alias("id"), title_words(F.col(title)).alias("words")).filter("size(words) > 0")
    names = words.groupBy("words").agg(F.min("id").alias("class_id"))
    return words.join(names, "words").select("id", "class_id", "words")


def class_links(classes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(a, b, similarity): pairs of classes (class_id, words) whose word sets have a Jaccard similarity of threshold or more, a < b.

    Prefix filtering: two sets that similar share one of the rarest words of each, as many as the
    threshold leaves room for, in one order of words for all. Two sets are compared at the first such word that they
    share, if their sizes and the places of the word leave room for the similarity. The sets of a frequent word are
    cut into parts, and a pair of parts is a unit of work, so that no task meets all of them.
    """
    sets = classes.groupBy("class_id").agg(F.first("words").alias("words"))
    spread = sets.select("class_id", F.explode("words").alias("word"))
    counts = spread.groupBy("word").agg(F.count("*").alias("df"))
    ordered = spread.join(counts, "word").groupBy("class_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "word"))), lambda x: x["word"]).alias("words"))
    size = F.size("words")
    room = size - F.ceil(F.lit(threshold) * size).cast("int") + 1
    keys = ordered.select("class_id", "words", F.posexplode(F.slice("words", F.lit(1), room)).alias("at", "word"))
    shared = keys.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1").select("word", F.ceil(F.col("n") / TITLES_AT_ONCE).cast("int").alias("parts"))
    keys = keys.join(shared, "word").withColumn("part", F.pmod(F.xxhash64("class_id"), F.col("parts")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    a = keys.select("word", F.col("part").alias("i"), every.alias("j"), F.col("class_id").alias("a"), F.col("words").alias("wa"), F.col("at").alias("at_a"))
    b = keys.select("word", every.alias("i"), F.col("part").alias("j"), F.col("class_id").alias("b"), F.col("words").alias("wb"), F.col("at").alias("at_b"))
    na, nb = F.size("wa"), F.size("wb")
    fits = nb.between(F.ceil(F.lit(threshold) * na), F.floor(na / threshold))
    # what the two may still share from this word on, itself included
    most = F.least(na - F.col("at_a"), nb - F.col("at_b"))
    reach = most >= F.ceil((na + nb) * threshold / (1 + threshold) - 1e-9)
    pairs = a.join(b, ["word", "i", "j"]).filter((F.col("a") < F.col("b")) & fits & reach)
    common = F.array_intersect("wa", "wb")
    same = F.size(common)
    similarity = same / (na + nb - same)
    first = F.element_at(common, 1) == F.col("word")  # both are in one order, so a pair counts once
    return pairs.filter(first & (similarity >= threshold)).select("a", "b", F.round(similarity, 6).alias("similarity"))


def title_links(docs: DataFrame, key: str, title: str, threshold: float = 0.5) -> DataFrame:
    """(a, b, similarity): documents whose titles' word sets have a Jaccard similarity of threshold or more, a < b.

    All pairs of documents, those of equal titles too, so its rows grow with the square of the titles that are equal;
    `title_classes` and `class_links` say the same by classes, which stays small. Here a class is named by its words. Its
    ids are cut into blocks, and a pair of blocks, which makes about BLOCK_IDS squared rows at most, is what is dealt out:
    tasks get like shares of the pairs, and only blocks are shuffled.
    """
    titles = docs.select(F.col(key).alias("id"), title_words(F.col(title)).alias("words")).filter("id is not null and size(words) > 0")
    named = materialize(titles.select("id", F.array_join("words", " ").alias("name")), "title-names")
    sizes = materialize(named.groupBy("name").agg(F.ceil(F.count("*") / BLOCK_IDS).cast("int").alias("parts")), "title-sizes")
    blocks = named.join(sizes, "name").groupBy("name", F.pmod(F.xxhash64("id"), "parts").cast("int").alias("part")).agg(F.collect_list("id").alias("ids"))
    links = class_links(sizes.select(F.col("name").alias("class_id"), F.split("name", " ").alias("words")), threshold)
    links = links.unionByName(sizes.select(F.col("name").alias("a"), F.col("name").alias("b"), F.lit(1.0).alias("similarity")))
    every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    for end, part in (("a", "i"), ("b", "j")):
        links = links.join(sizes.withColumnRenamed("name", end), end).withColumn(part, every).drop("parts")
    cells = links.filter("a <> b or i <= j").repartition("a", "i")
    cells = cells.join(blocks.select(F.col("name").alias("a"), F.col("part").alias("i"), F.col("ids").alias("ids_a")), ["a", "i"])
    # a number that is given stays: by their bytes, which are few beside the pairs they make, cells would come to too few tasks
    cells = cells.repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), "b", "j")
    cells = cells.join(blocks.select(F.col("name").alias("b"), F.col("part").alias("j"), F.col("ids").alias("ids_b")), ["b", "j"])
    pairs = cells.select(F.expr("a = b and i = j").alias("itself"), "similarity", "ids_b", F.explode("ids_a").alias("x"))
    pairs = pairs.select("itself", "similarity", "x", F.explode("ids_b").alias("y")).filter("x <> y and (x < y or not itself)")
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "similarity")
