"""Metadata of articles: heading outline, flags, constants, category counts."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import html_ops as H
from ..functions import text as X


def outline_column(html: Column) -> Column:
    """(level, text) of an article's headings, by elements or named anchors."""
    return H.column(H.outline, H.OUTLINE_TYPE, "array<struct<level:int,text:string>>")(html)


def enrich(articles: DataFrame, acl: str = "public", tier: int = 1, category: str = "va_manual") -> DataFrame:
    """articles (source_id, html, ...) with heading_outline, heading_count, contains_table, contains_list and constants."""
    flags = X.content_flags(F.col("html"))
    out = articles.withColumn("heading_outline", outline_column(F.col("html")))
    return out.withColumns(
        {
            "heading_count": F.size("heading_outline"), "contains_table": flags["contains_table"], "contains_list": flags["contains_list"],
            "acl": F.lit(acl), "source_authority_tier": F.lit(tier), "content_category": F.coalesce(F.col("content_category"), F.lit(category)) if "content_category" in articles.columns else F.lit(category),
        }
    )


def category_counts(articles: DataFrame) -> DataFrame:
    """Articles by category, most first, ties by name."""
    return articles.groupBy("content_category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "content_category")


def heading_stats(articles: DataFrame, count: str = "heading_count") -> DataFrame:
    """Articles, those with headings, and headings per article that has any."""
    return articles.agg(F.count("*").alias("articles"), F.count_if(F.col(count) > 0).alias("with_headings"), (F.sum(count) / F.nullif(F.count_if(F.col(count) > 0), F.lit(0))).alias("mean_headings"))


def article_fields(xml: Column) -> Column:
    """Fields of an article response; content unescaped, breadcrumb, attributes and attachments by pattern."""
    block = F.regexp_extract(xml, r'(?s)<(?:ns2:)?article\s[^>]*id="\d+"[^>]*>(.*)</(?:ns2:)?article>', 1)
    crumbs = F.regexp_extract_all(F.regexp_extract(block, r"(?s)<topicBreadcrumb>(.*?)</topicBreadcrumb>", 1), F.lit(r"<name>(.*?)</name>"), F.lit(1))
    attributes = F.regexp_extract_all(block, F.lit(r"(?s)<(?:ns2:)?customAttribute>(.*?)</(?:ns2:)?customAttribute>"), F.lit(1))
    named = F.filter(F.transform(attributes, lambda a: F.struct(X.xml_value(a, "attributeName").alias("key"), X.xml_value(a, "attributeValue").alias("value"))), lambda a: a["key"] != "")
    last = F.aggregate(named, F.create_map().cast("map<string,string>"), lambda m, a: F.map_concat(F.map_filter(m, lambda k, v: k != a["key"]), F.create_map(a["key"], a["value"])))
    files = F.regexp_extract_all(block, F.lit(r"(?s)<(?:ns2:)?attachment>(.*?)</(?:ns2:)?attachment>"), F.lit(1))
    attachments = F.filter(F.transform(files, lambda a: F.struct(X.xml_value(a, "name").alias("name"), X.xml_value(a, "url").alias("url"))), lambda a: a["name"] != "")
    content = H.column(H.article_content, pa.string(), "string")(block)
    simple = {c: X.xml_value(block, t) for c, t in (("name", "name"), ("description", "description"), ("keywords", "keywords"), ("created_date", "createdDate"), ("last_modified_date", "lastModifiedDate"), ("state", "state"), ("version", "version"), ("alternate_id", "alternateId"))}
    return F.struct(
        F.regexp_extract(xml, r'<(?:ns2:)?article\s[^>]*id="(\d+)"', 1).alias("id"), content.alias("content_html"), crumbs.alias("topic_breadcrumb"), last.alias("custom_attributes"), attachments.alias("attachments"),
        *[v.alias(k) for k, v in simple.items()],
    )


def topics(xml: DataFrame, column: str = "value") -> DataFrame:
    """(id, child_count, name, parent_id, article_count, total_article_count) of topic responses; of repeated ids the first by response order."""
    found = F.regexp_extract_all(F.col(column), F.lit(r'(?s)<ns2:topic\s[^>]*?id="\d+".*?(?=<ns2:topic\s|\z)'), F.lit(0))
    rows = xml.select(F.monotonically_increasing_id().alias("_page"), F.posexplode(found).alias("_at", "t"))
    value = lambda tag: X.xml_value(F.col("t"), tag, namespace=True)
    parsed = rows.select(
        F.struct("_page", "_at").alias("_order"), F.regexp_extract("t", r'\bid="(\d+)"', 1).alias("id"), F.regexp_extract("t", r'childCount="(\d+)"', 1).try_cast("int").alias("child_count"),
        value("name").alias("name"), F.nullif(value("parentTopicId"), F.lit("")).alias("parent_id"), value("articleCount").try_cast("int").alias("article_count"), value("articleTotalCount").try_cast("int").alias("total_article_count"),
    )
    fields = [c for c in parsed.columns if c not in ("_order", "id")]
    return parsed.groupBy("id").agg(F.min_by(F.struct(*fields), "_order").alias("f")).select("id", "f.*")


def listing(xml: Column) -> Column:
    """count, max_range and (id, name) articles of a listing response."""
    articles = F.regexp_extract_all(xml, F.lit(r'(?s)<(?:ns2:)?article\s[^>]*id="\d+".*?</(?:ns2:)?article>'), F.lit(0))
    rows = F.transform(articles, lambda a: F.struct(F.regexp_extract(a, r'id="(\d+)"', 1).alias("id"), X.xml_value(a, "name").alias("name")))
    return F.struct(X.xml_value(xml, "count").try_cast("int").alias("count"), X.xml_value(xml, "maxRange").try_cast("int").alias("max_range"), rows.alias("articles"))


def source_metadata(articles: DataFrame, base_url: str) -> DataFrame:
    """Sidecar columns of parsed articles (article struct, html, topic columns)."""
    flags = X.content_flags(F.col("article.content_html"))
    return articles.select(
        F.col("article.id").alias("article_id"), F.nullif(F.col("article.alternate_id"), F.lit("")).alias("alternate_id"), F.lit("va_manual").alias("source_type"),
        F.concat(F.lit(base_url), F.col("article.id")).alias("source_url"), F.col("article.topic_breadcrumb").alias("topic_breadcrumb"), F.col("article.name").alias("title"),
        F.nullif(F.col("article.description"), F.lit("")).alias("description"), F.col("article.last_modified_date").alias("last_modified"), F.col("article.created_date").alias("created"),
        F.col("article.version").alias("version"), F.col("article.state").alias("state"), flags["contains_table"].alias("contains_table"), flags["contains_list"].alias("contains_list"),
        outline_column(F.col("article.content_html")).alias("heading_outline"), F.col("article.attachments").alias("attachments"),
    )
