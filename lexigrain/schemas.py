"""Explicit schemas; no reader in this package infers types."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _D, _I = T.StringType(), T.LongType(), T.DoubleType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


FEED_CATALOGUE = _struct(feed_name=_S, feed_link=_S)

FEED_ENTRY = _struct(entry_id=_S, link=_S, published=T.TimestampType())

CRAWLED_ARTICLE = _struct(run_id=_L, feed_name=_S, feed_link=_S, article_id=_S,
                          article_link=_S, publish_time=_L, text=_S)

RUN_LOG = _struct(run_id=_L, feed_name=_S, feed_time=_D, article_count=_I, article_avg=_D)

ERROR_LOG = _struct(feed_name=_S, article_id=_S, article_link=_S, error=_S)

NEWS_JSON = T.StructType([T.StructField(name, _S) for name in
                          ("id", "media-type", "source", "published", "content")])

# one record per document, before tokenising
RAW_DOCUMENT = _struct(id=_S, dataset=_S, cat=_S, source=_S, url=_S, published=_S, content=_S)

# the common document table all sources reach
DOCUMENT = _struct(id=_S, dataset=_S, cat=_S, source=_S, url=_S,
                   published=T.TimestampType(), words=T.ArrayType(_S))

LINK = _struct(href=_S, text=_S)

ENCYCLOPEDIA_DOC = _struct(url=_S, id=_S, title=_S, links=T.ArrayType(LINK), text=_S)

DUMP_PAGE = T.StructType([
    T.StructField("id", _L),
    T.StructField("title", _S),
    T.StructField("ns", _I),
    T.StructField("redirect", T.StructType([T.StructField("_title", _S)])),
    T.StructField("revision", T.StructType([
        T.StructField("id", _L),
        T.StructField("text", T.StructType([
            T.StructField("_VALUE", _S)])),
    ])),
])

RSS_ITEM = _struct(guid=_S, link=_S, title=_S, description=_S, pubDate=_S)

CODE_DICTIONARY = _struct(code=_S, description=_S)
