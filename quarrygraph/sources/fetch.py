"""Source files by manifest: which entries count, how their text is fetched, and what is there already.

Fetching is a plug-in: a function from a URL to (content, content type, final URL).
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator, MutableMapping
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import markup

Fetch = Callable[[str], tuple[bytes, str, str]]
_FETCHED = "filename string, url string, content binary, content_type string"


def load_env(path: str, env: MutableMapping[str, str] = os.environ) -> dict[str, str]:
    """KEY=VALUE lines of a file that aren't set yet, now set; comments, blank lines and a missing file are nothing."""
    file = Path(path)
    pairs = (line.partition("=") for line in (file.read_text("utf-8").splitlines() if file.exists() else ()) if "=" in line and not line.lstrip().startswith("#"))
    new = {k.strip(): v.strip().strip("\"'") for k, _, v in pairs if k.strip() and k.strip() not in env}
    env.update(new)
    return new


def _there(spark: SparkSession, path: str | None) -> bool:
    if not path:
        return False
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def load_manifest(spark: SparkSession, default: str | None = None, custom: str | None = None, example: str | None = None) -> DataFrame:
    """The default manifest with the custom one over it, or else the example; a custom path must exist, and entries must be there."""
    if custom and not _there(spark, custom):
        raise FileNotFoundError(f"no manifest at {custom}")
    found = [p for p in (default, custom) if _there(spark, p)] or [p for p in (example,) if _there(spark, p)]
    rows = markup.overlay(*[markup.read_manifest(spark, p) for p in found]) if found else None
    if rows is None or rows.isEmpty():
        raise ValueError("the manifest has no entries")
    return rows


def metadata(manifest: DataFrame) -> DataFrame:
    """(filename, metadata): an entry as a map without its empty values; unknown keys are kept."""
    known = F.create_map(*[x for k in markup.KNOWN for x in (F.lit(k), F.col(k))])
    return manifest.select("filename", F.map_filter(F.map_concat("extra", known), lambda _, v: F.coalesce(v, F.lit("")) != "").alias("metadata"))


def _fetched(rows: DataFrame, fetch: Fetch) -> DataFrame:
    """``rows`` (filename, urls): the first URL whose content is wanted; only the last is taken whatever it is."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for name, urls in zip(part["filename"], part["urls"], strict=True):
                for i, url in enumerate(urls):
                    content, kind, final = fetch(url)
                    document = content[:4] == b"%PDF" or content[:2] == b"PK"
                    if document or i + 1 == len(urls):
                        out.append((name, final or url, content, kind))
                        break
            yield pd.DataFrame(out, columns=["filename", "url", "content", "content_type"])

    return rows.select("filename", "urls").mapInPandas(run, _FETCHED)


def fetched_files(manifest: DataFrame, fetch: Fetch, most: int = 12) -> DataFrame:
    """(filename, url, content, content_type): the source of each entry.

    A page is followed to the first of its ``most`` best links that is a PDF or DOCX
    file, one shown in an office viewer before all; a page without such a link stands for itself.
    """
    first = _fetched(manifest.filter(F.coalesce("source_url", F.lit("")) != "").select("filename", F.array(markup.viewer_source(F.col("source_url"))).alias("urls")), fetch)
    first = first.withColumn("kind", markup.file_kind(F.col("url"), F.col("content_type"), F.col("content"))).persist()  # so that a page isn't fetched again
    pages = first.filter("kind = 'html'")
    viewed = pages.select("filename", markup.viewer_source_in(F.col("content").cast("string")).alias("viewed"))
    links = markup.links(pages.select(F.col("filename").alias("page_id"), "url", F.col("content").cast("string").alias("html"))).filter("priority > 0")
    ranked = markup.best_links(links, most=most).groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("rank", markup.viewer_source(F.col("url")).alias("url")))).alias("c"))
    ranked = viewed.join(ranked.withColumnRenamed("page_id", "filename"), "filename", "left")
    urls = F.array_distinct(F.array_compact(F.concat(F.array("viewed"), F.coalesce(F.transform("c", lambda x: x["url"]), F.array().cast("array<string>")))))
    followed = _fetched(ranked.select("filename", urls.alias("urls")).filter("size(urls) > 0"), fetch)
    followed = followed.withColumn("kind", markup.file_kind(F.col("url"), F.col("content_type"), F.col("content"))).filter("kind <> 'html'").persist()
    return first.join(followed.select("filename"), "filename", "left_anti").unionByName(followed)


def materialise(spark: SparkSession, manifest: DataFrame, fetch: Fetch, out: str, force: bool = False) -> DataFrame:
    """Markdown of each entry's source under ``out`` (Parquet: filename, url, kind, markdown); what is there isn't fetched again."""
    todo = manifest
    if not force and _there(spark, out):
        todo = manifest.join(spark.read.parquet(out).select("filename"), "filename", "left_anti")
    files = fetched_files(todo, fetch)
    texts = markup.file_texts(files.withColumn("path", F.col("url")))
    rows = texts.join(todo.select("filename", "company", "quarter"), "filename")
    title = F.concat_ws(" ", "company", "quarter")
    rows.select("filename", "url", "kind", markup.render_markdown(title, F.col("url"), F.col("text")).alias("markdown")).write.mode("overwrite" if force else "append").parquet(out)
    return spark.read.parquet(out)
