"""Paged web services, as rows: one request per page, tried again, cached, resumable.

The engine has no network of its own. A caller gives `fetch(url, key) -> (status, text)`; requests are
spread over the executors, so a service's rate is `requests per second x tasks`, and `per_task` says how
many tasks may ask at once.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "page_key string, page int, status int, body string, attempts int"


def fetch_pages(
    requests: DataFrame,
    fetch: Callable[[str, str], tuple[int, str]],
    keys: list[str],
    tasks: int = 1,
    pause: float = 0.0,
    tries: int = 4,
    sleep: Callable[[float], None] = time.sleep,
) -> DataFrame:
    """requests(page_key, page, url) -> (page_key, page, status, body, attempts). A refused key (401, 403)
    gives way to the next one, 429 and 5xx wait twice as long each time; the last answer is kept, so a
    page that failed is a row with its status and no body."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at = 0
        for pdf in batches:
            out = []
            for page_key, page, url in zip(pdf["page_key"], pdf["page"], pdf["url"]):
                wait, status, body, n = max(pause, 0.5), 0, None, 0
                for n in range(1, tries + 1):
                    status, body = fetch(url, keys[at % len(keys)] if keys else "")
                    if status == 200:
                        break
                    body = None
                    if status in (401, 403):
                        at += 1
                    elif status == 429 or status >= 500:
                        sleep(wait)
                        wait *= 2
                    else:
                        break
                out.append((page_key, page, status, body, n))
                if pause:
                    sleep(pause)
            yield pd.DataFrame(out, columns=["page_key", "page", "status", "body", "attempts"]).astype({"page": "int32", "status": "int32", "attempts": "int32"})

    return requests.select("page_key", F.col("page").cast("int").alias("page"), "url").repartition(tasks, "page_key", "page").mapInPandas(run, _SCHEMA)


def resume(requests: DataFrame, cached: DataFrame) -> DataFrame:
    """The requests whose page is not cached with a body yet."""
    done = cached.where("status = 200").select("page_key", "page").distinct()
    return requests.join(done, ["page_key", "page"], "left_anti")


def scan(spark: SparkSession, requests: DataFrame, cache: str, fetch, keys: list[str], **options) -> DataFrame:
    """Cache-aside: fetches what the cache at a path lacks, adds it, and gives all pages with a body."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    exists = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    cached = spark.read.schema(_SCHEMA).parquet(cache) if exists else spark.createDataFrame([], _SCHEMA)
    fetch_pages(resume(requests, cached), fetch, keys, **options).write.mode("append").parquet(cache)
    all_ = spark.read.schema(_SCHEMA).parquet(cache).where("status = 200")
    return all_.groupBy("page_key", "page").agg(F.max("body").alias("body"))


def follow_links(first: str, fetch: Callable[[str, str], tuple[int, str]], key: str, most: int = 2000) -> tuple[list[str], str]:
    """(bodies, state) of a chain of pages, each naming the next: inherently one after the other. The
    state is complete, partial (the ceiling was reached) or failed."""
    url, bodies = first, []
    while url and len(bodies) < most:
        status, body = fetch(url, key)
        if status != 200:
            return bodies, "failed"
        bodies.append(body)
        url = json.loads(body).get("next")
    return bodies, "partial" if url else "complete"
