"""Search results of several sources in one schema."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: For each source, the fields of its JSON and where the common columns come from.
SCHEMAS = {
    "OpenAlex": ("struct<id:string,doi:string,title:string,publication_year:int,primary_location:struct<landing_page_url:string,source:struct<display_name:string>>,authorships:array<struct<author:struct<display_name:string>>>>",
                 {"url": "coalesce(j.primary_location.landing_page_url, j.doi, j.id)", "title": "j.title", "source": "j.primary_location.source.display_name", "author": "j.authorships[0].author.display_name", "date": "cast(j.publication_year as string)", "doi": "j.doi"}),
    "Crossref": ("struct<URL:string,DOI:string,title:array<string>,`container-title`:array<string>,author:array<struct<given:string,family:string>>,abstract:string>",
                 {"url": "j.URL", "title": "get(j.title, 0)", "source": "get(j.`container-title`, 0)", "author": "concat_ws(' ', get(j.author, 0).given, get(j.author, 0).family)", "doi": "j.DOI", "excerpt": "j.abstract"}),
    "Semantic Scholar": ("struct<url:string,title:string,venue:string,year:int,abstract:string,authors:array<struct<name:string>>,externalIds:struct<DOI:string>>",
                         {"url": "j.url", "title": "j.title", "source": "j.venue", "author": "get(j.authors, 0).name", "date": "cast(j.year as string)", "doi": "j.externalIds.DOI", "excerpt": "j.abstract"}),
    "CORE": ("struct<downloadUrl:string,title:string,publisher:string,yearPublished:int,abstract:string,doi:string>", {"url": "j.downloadUrl", "title": "j.title", "source": "j.publisher", "date": "cast(j.yearPublished as string)", "doi": "j.doi", "excerpt": "j.abstract"}),
    "GDELT": ("struct<url:string,title:string,domain:string,seendate:string>", {"url": "j.url", "title": "j.title", "source": "j.domain", "date": "regexp_replace(j.seendate, '^([0-9]{4})([0-9]{2})([0-9]{2}).*$', '$1-$2-$3')"}),
    "Unpaywall": ("struct<doi:string,title:string,best_oa_location:struct<url:string>,journal_name:string,year:int>", {"url": "j.best_oa_location.url", "title": "j.title", "source": "j.journal_name", "date": "cast(j.year as string)", "doi": "j.doi"}),
    "Exa": ("struct<url:string,title:string,author:string,publishedDate:string,text:string,score:double>", {"url": "j.url", "title": "j.title", "author": "j.author", "date": "j.publishedDate", "excerpt": "j.text", "score": "j.score"}),
    "Tavily": ("struct<url:string,title:string,content:string,score:double,published_date:string>", {"url": "j.url", "title": "j.title", "date": "j.published_date", "excerpt": "j.content", "score": "j.score"}),
}
COLUMNS = {"url": "string", "title": "string", "source": "string", "author": "string", "date": "string", "doi": "string", "excerpt": "string", "score": "double"}


def normalise(raw: DataFrame) -> DataFrame:
    """raw (adapter, raw JSON text) as url, title, source, author, date, doi, excerpt, score, adapter; rows without a URL are left out."""

    def one(adapter: str) -> DataFrame:
        schema, fields = SCHEMAS[adapter]
        rows = raw.filter(F.col("adapter") == adapter).withColumn("j", F.from_json("raw", schema))
        return rows.select("adapter", *(F.expr(fields[c]).cast(k).alias(c) if c in fields else F.lit(None).cast(k).alias(c) for c, k in COLUMNS.items()))

    return reduce(lambda a, b: a.unionByName(b), (one(a) for a in SCHEMAS)).filter("url <> ''")
